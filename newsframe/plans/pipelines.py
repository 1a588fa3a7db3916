"""Composed jobs over many articles at once.

P1 ``analyze_articles``: page -> content (E9) -> summary (M2), keywords (K5),
credibility (D1, rounded to 2) -> one row per page.
P2 ``cli_summarize``: page -> content (E9) -> lead summary (M1), penalty
credibility (D2), frequency keywords (K1), plus id and creation time.
P3 ``ingest_batch``: feed documents -> entries (S2) -> near-duplicate removal
(U3) on the cleaned summary.

Each job hash-partitions the raw (id, html) once; content extraction and all
per-document work then run next to their document. P2 is a single branch;
P1's branches (summary, keywords, credibility) are joined back on the id."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import html as H
from newsframe.functions import scores as S
from newsframe.functions import summary as M
from newsframe.functions import text as T
from newsframe.operators.credibility import credibility_heuristic
from newsframe.operators.keywords import extract_keywords, keywords_freq
from newsframe.operators.summarize import Backend, summarize
from newsframe.operators.tokens import by_document


def page_content(pages: DataFrame, id_col: str = "page_id", keep: Sequence[str] = ()) -> DataFrame:
    """(id, keep..., content) with content = E9 of the page, on the
    document-local layout."""
    dd = by_document(pages.select(id_col, "html", *keep), id_col)
    return dd.select(id_col, *keep, H.paragraph_text_all("html").alias("content"))


def cli_summarize(pages: DataFrame, id_col: str = "page_id", with_meta: bool = False) -> DataFrame:
    """(id, summary, credibility 0-100, keywords array[, id, created_at]).

    One branch: the content is extracted once; summary and credibility ride
    on each document's first token row only (NULL elsewhere, so nothing is
    copied per token), survive the (doc, word) count as a NULL-skipping max,
    and meet the ranked keywords in the final per-document aggregate."""
    c = page_content(pages, id_col)
    words = F.filter(T.tokens("content"), lambda w: w.rlike(f"^[a-z]{{{L.FREQ_KEYWORD_MIN_LEN},}}$"))
    prep = c.select(id_col, M.summary_lead("content").alias("_s"),
                    S.credibility_penalty("content").alias("_c"), words.alias("_w"))
    tk = prep.select(id_col, "_s", "_c", F.posexplode_outer("_w").alias("p", "w"))
    head = F.col("p").isNull() | (F.col("p") == 0)
    tk = tk.select(id_col, "p", "w", F.when(head, F.col("_s")).alias("_s"), F.when(head, F.col("_c")).alias("_c"))
    counts = tk.groupBy(id_col, "w").agg(F.count("p").alias("n"), F.min("p").alias("first"),
                                         F.max("_s").alias("_s"), F.max("_c").alias("_c"))
    rank = F.row_number().over(Window.partitionBy(id_col).orderBy(F.col("n").desc(), F.col("first").asc()))
    ranked = counts.withColumn("_rn", rank).filter((F.col("_rn") <= L.FREQ_KEYWORDS_TOP) | F.col("_s").isNotNull())
    keep = F.col("w").isNotNull() & (F.col("_rn") <= L.FREQ_KEYWORDS_TOP)
    out = ranked.groupBy(id_col).agg(
        F.max("_s").alias("summary"), F.max("_c").alias("credibility"),
        F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("_rn", "w")))), lambda x: x["w"])
        .alias("keywords"))
    if with_meta:
        out = out.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp())
    return out


def analyze_articles(pages: DataFrame, vectors: DataFrame, stop_words: Sequence[str], key=None,
                     id_col: str = "page_id", backend: Backend | None = None,
                     fallback: Backend | None = None) -> DataFrame:
    """(id, url, summary, keywords array, credibility rounded to 2)."""
    c = page_content(pages, id_col, keep=("url",))
    summ = summarize(c, "content", id_col, backend=backend, fallback=fallback).select(id_col, "summary")
    kw = extract_keywords(c, vectors, stop_words, "content", id_col, key=key, partitioned=True)
    cred = credibility_heuristic(c, "content", id_col, partitioned=True)
    return (c.select(id_col, "url").join(summ, id_col).join(kw, id_col).join(cred, id_col)
            .select(id_col, "url", "summary", "keywords", "credibility"))
