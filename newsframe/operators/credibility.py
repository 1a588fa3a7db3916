"""Credibility scorers as DataFrame operators (D1, D1d, D2).

D1's scalar parts (cue hits, punctuation, length, source) are row-wise
expressions; the repetition part needs word counts, computed on the
document-local layout (one repartition on the id, no other exchange)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import scores as S
from newsframe.functions import text as T
from newsframe.operators.tokens import by_document
from newsframe.operators.wordstats import top_counts_sum, word_counts

PARTS = ("clickbait", "exclamations", "punct_runs", "has_source", "n_words")


def top3_repetition(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                    out: str = "repetition", partitioned: bool = False,
                    carry: tuple[str, ...] = (), tokens_col: str | None = None) -> DataFrame:
    """D1d: sum of the 3 largest word counts that exceed 5, per document.
    ``tokens_col``: an already tokenized array column to count instead."""
    dd = df if partitioned else by_document(df.select(id_col, text_col, *carry), id_col)
    words = F.col(tokens_col) if tokens_col else T.tokens(text_col)
    counts = word_counts(dd, id_col, words, carry)
    return top_counts_sum(counts, id_col, L.REPETITION_TOP, L.REPETITION_MIN_COUNT, out, carry)


def credibility_heuristic(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                          out: str = "credibility",
                          clickbait: Sequence[str] = L.CLICKBAIT_PHRASES,
                          sources: Sequence[str] = L.SOURCE_PHRASES,
                          with_parts: bool = False, partitioned: bool = False) -> DataFrame:
    """D1 per document: (id, [parts], credibility)."""
    dd = df if partitioned else by_document(df.select(id_col, text_col), id_col)
    lt = S.lowered_stripped(text_col)
    prep = dd.select(id_col, lt.alias("_lt"))
    prep = prep.select(id_col, "_lt", T.tokens("_lt").alias("_toks"))
    prep = prep.select(id_col, "_toks",
                       S.clickbait_hits("_lt", clickbait).alias("clickbait"),
                       S.exclamation_count("_lt").alias("exclamations"),
                       S.punct_runs("_lt").alias("punct_runs"),
                       S.has_source("_lt", sources).alias("has_source"),
                       F.size("_toks").cast("long").alias("n_words"))
    rep = top3_repetition(prep, "_lt", id_col, "repetition", partitioned=True, carry=PARTS, tokens_col="_toks")
    score = S.combine_credibility(F.col("clickbait"), F.col("exclamations"), F.col("punct_runs"),
                                  F.col("repetition"), F.col("has_source"), F.col("n_words"))
    cols = [id_col] + (["clickbait", "exclamations", "punct_runs", "repetition", "has_source", "n_words"]
                       if with_parts else [])
    return rep.select(*cols, score.alias(out))


def credibility_penalty(df: DataFrame, text_col: str = "text", out: str = "credibility",
                        cues: Sequence[str] = L.PENALTY_CUES) -> DataFrame:
    """D2 per row: 100 minus 10 per cue occurrence, floored at 0."""
    return df.withColumn(out, S.credibility_penalty(text_col, cues))
