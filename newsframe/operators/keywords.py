"""Keyword operators: frequency (K1), RAKE (K2), word-vector similarity
(K3), post-processing (K4) and the combined extractor (K5).

All run on the document-local layout: the narrow (id, text) frame is
hash-partitioned on the id once; explode, per-(doc, word) aggregates,
phrase windows and rankings are then keyed by the id and need no further
exchange. Stop lists are broadcast after a size check."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import keywords as KWF
from newsframe.functions import text as T
from newsframe.operators.tokens import by_document
from newsframe.operators.vectors import VECTOR_BROADCAST_MAX_VALUES, VectorTable, best_words, dot
from newsframe.operators.wordstats import top_words, word_counts
from newsframe.session import small_table, written_table


def _layout(df: DataFrame, id_col: str, text_col: str, clean: bool, partitioned: bool) -> DataFrame:
    """Hash-partition the raw (id, text) on the id first, then prepare the
    text, so the cleaning runs after the exchange, spread over all tasks."""
    narrow = df.select(id_col, F.col(text_col).alias("_raw"))
    narrow = narrow if partitioned else by_document(narrow, id_col)
    expr = T.clean_for_keywords("_raw") if clean else F.col("_raw")
    return narrow.select(id_col, expr.alias("_t"))


def keywords_freq(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                  top_n: int = L.FREQ_KEYWORDS_TOP, out: str = "keywords",
                  partitioned: bool = False) -> DataFrame:
    """K1: (id, keywords array) — ASCII-letter words of 4+ letters by count
    desc, ties by first occurrence."""
    dd = _layout(df, id_col, text_col, False, partitioned)
    words = F.filter(T.tokens("_t"), lambda w: w.rlike(f"^[a-z]{{{L.FREQ_KEYWORD_MIN_LEN},}}$"))
    return top_words(word_counts(dd, id_col, words), id_col, top_n, out)


def stop_frame(spark: SparkSession, words: Sequence[str]) -> DataFrame:
    uniq = sorted(set(words))
    return small_table(spark.createDataFrame([(w,) for w in uniq], "w string"), known_rows=len(uniq))


def word_alternation(words: Sequence[str]) -> str:
    """Regex alternation of ``words`` shaped as a trie (shared prefixes
    factored out), so matching costs about the word length, not the list
    length."""
    trie: dict = {}
    for w in sorted(set(words)):
        node = trie
        for ch in w:
            node = node.setdefault(ch, {})
        node[""] = {}

    def emit(node: dict) -> str:
        end = "" in node
        alts = [re.escape(ch) + emit(child) for ch, child in sorted(node.items()) if ch]
        if not alts:
            return ""
        body = alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"
        return f"(?:{body})?" if end else body

    return emit(trie)


PHRASE_BREAK = "\u0004"


def rake_phrases(dd: DataFrame, stop: DataFrame | Sequence[str], id_col: str = "doc_id") -> DataFrame:
    """RAKE phrase occurrences of the prepared (C5) text in ``_t``:
    (id, pid, phrase, score). Stop words split phrases; a word's score is
    degree / frequency over the document's phrase occurrences; a phrase
    scores the sum over its words (Rose et al., 2010).

    With a stop list given as words, phrases are cut inside the row (one
    trie-shaped regex marks the stop words); word statistics are one window
    keyed by (doc, word) on the document partitioning, and phrase scores one
    aggregate, so nothing is shuffled after the document repartition. A stop
    list given as a DataFrame is joined instead."""
    if isinstance(stop, DataFrame):
        return _rake_phrases_joined(dd, stop, id_col)
    words = [w for w in set(stop) if w]
    marked = F.col("_t")
    if words:
        marked = F.regexp_replace(marked, f"(?<![^ ])(?:{word_alternation(words)})(?![^ ])", PHRASE_BREAK)
    phrases = F.filter(F.transform(F.split(marked, PHRASE_BREAK), lambda p: F.trim(p)), lambda p: p != F.lit(""))
    # documents without phrases keep one row with a NULL phrase
    ph = dd.select(id_col, F.posexplode_outer(phrases).alias("pid", "phrase"))
    ws = F.filter(F.split("phrase", " "), lambda w: w != F.lit(""))
    # the phrase goes with its first word only, so the sorts below hold it once
    occ = ph.select(id_col, "pid", "phrase", F.size(ws).alias("plen"), F.posexplode_outer(ws).alias("at", "w")).select(
        id_col, "pid", "plen", "w", F.when(F.coalesce("at", F.lit(0)) == 0, F.col("phrase")).alias("phrase"))
    # degree / frequency of each word over the document: a window keyed by
    # (doc, word), which the document partitioning already satisfies (a join
    # on both keys would shuffle again)
    byword = Window.partitionBy(id_col, "w")
    occ = occ.withColumn("ratio", F.sum("plen").over(byword).cast("double")
                         / F.count(F.lit(1)).over(byword).cast("double"))
    return occ.groupBy(id_col, "pid").agg(T.pyround(F.sum("ratio"), 6).alias("score"),
                                          F.any_value("phrase", True).alias("phrase"))


def _rake_phrases_joined(dd: DataFrame, stop: DataFrame, id_col: str) -> DataFrame:
    toks = F.filter(F.split("_t", " "), lambda w: w != F.lit(""))
    tk = dd.select(id_col, F.posexplode(toks).alias("pos", "w"))
    flagged = tk.join(stop.select("w", F.lit(1).alias("_stop")), "w", "left")
    run = Window.partitionBy(id_col).orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    flagged = flagged.withColumn("pid", F.sum(F.coalesce(F.col("_stop"), F.lit(0))).over(run))
    words = flagged.filter(F.col("_stop").isNull())
    words = words.withColumn("plen", F.count(F.lit(1)).over(Window.partitionBy(id_col, "pid")))
    byword = Window.partitionBy(id_col, "w")
    words = (words.withColumn("freq", F.count(F.lit(1)).over(byword))
             .withColumn("deg", F.sum("plen").over(byword)))
    ratio = F.col("deg").cast("double") / F.col("freq").cast("double")
    return words.groupBy(id_col, "pid").agg(
        T.pyround(F.sum(ratio), 6).alias("score"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "w"))), lambda s: s["w"]), " ")
        .alias("phrase"))


def rank_phrases(phrases: DataFrame, id_col: str, top_n: int, out: str) -> DataFrame:
    """Top ``top_n`` phrase occurrences by (score desc, phrase desc), as an
    ordered array."""
    w = Window.partitionBy(id_col).orderBy(F.col("score").desc_nulls_last(), F.col("phrase").desc_nulls_last())
    ranked = phrases.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") <= top_n)
    picked = F.collect_list(F.when(F.col("phrase").isNotNull(), F.struct("_rn", "phrase")))
    return ranked.groupBy(id_col).agg(F.transform(F.array_sort(picked), lambda s: s["phrase"]).alias(out))


def _with_all_ids(dd: DataFrame, res: DataFrame, id_col: str, out: str) -> DataFrame:
    ids = dd.select(id_col)
    return ids.join(res, id_col, "left").select(
        id_col, F.coalesce(F.col(out), F.array().cast("array<string>")).alias(out))


def keywords_rake(df: DataFrame, stop_words: Sequence[str] | DataFrame, text_col: str = "text",
                  id_col: str = "doc_id", top_n: int = L.KEYWORDS_TOP, out: str = "keywords",
                  clean: bool = True, partitioned: bool = False) -> DataFrame:
    """K2: (id, ranked phrases) from RAKE over the C5-cleaned text (or the
    text as given when ``clean=False``)."""
    spark = df.sparkSession
    dd = _layout(df, id_col, text_col, clean, partitioned)
    res = rank_phrases(rake_phrases(dd, stop_words, id_col), id_col, top_n, out)
    if isinstance(stop_words, DataFrame):
        return _with_all_ids(dd, res, id_col, out)
    return res


def postprocess(df: DataFrame, col: str, stop_words: Sequence[str], out: str | None = None) -> DataFrame:
    """K4 as an operator over an array column of phrases."""
    return df.withColumn(out or col, KWF.postprocess_keywords(col, stop_words))


# ------------------------------------------------------------------- K3

def hashed_vector_key(word_col, n_rows):
    """Row index for a word in a vector table of ``n_rows`` rows: first 8 hex
    digits of md5(word) modulo the row count (portable across engines)."""
    h = F.conv(F.substring(F.md5(word_col), 1, 8), 16, 10).cast("long")
    return F.pmod(h, n_rows if not isinstance(n_rows, int) else F.lit(n_rows))


def keywords_embedding(df: DataFrame, vectors: DataFrame, stop_words: Sequence[str],
                       text_col: str = "text", id_col: str = "doc_id", top_n: int = L.KEYWORDS_TOP,
                       key=None, out: str = "keywords", clean: bool = True,
                       partitioned: bool = False) -> DataFrame:
    """K3: candidate words (2+ characters, not stop words) ranked by cosine
    to the document vector (sum of its tokens' word vectors, which has the
    direction of their mean); top ``top_n``, ties by word.

    ``vectors`` is (key, vec); ``key`` maps a word column to that key
    (default: the word itself). Per-(doc, word) counts are joined to the table, the
    document vector is their aggregate, and the cosine a column; counts, vectors and
    ranks all stay on the document partitioning. A table that is too large for a broadcast
    is met in blocks (``best_words``). A word whose vector or whose
    document's vector is zero ranks last."""
    dd = _layout(df, id_col, text_col, clean, partitioned)
    toks = F.filter(F.split("_t", " "), lambda w: w != F.lit(""))
    counts = dd.select(id_col, F.explode_outer(toks).alias("w")).groupBy(id_col, "w").agg(
        F.count(F.lit(1)).alias("n"))
    stop = sorted(set(stop_words))
    cand = F.length("w") >= 2
    if stop:
        cand = cand & ~F.col("w").isin(stop)
    table = VectorTable(vectors, key, VECTOR_BROADCAST_MAX_VALUES)
    if not table.fits:
        keyed = counts.select(id_col, "w", "n", (key(F.col("w")) if key is not None else F.col("w")).alias("key"),
                              F.coalesce(cand, F.lit(False)).alias("cand"))
        return best_words(keyed, vectors, id_col, top_n, out)
    # one vector per document, joined on the partitioning that both sides have
    rows = counts.join(table.summed(counts, id_col).hint("shuffle_hash"), id_col, "left")
    rows = table.to_words(rows).withColumn("_cand", F.coalesce(cand & F.col("vec").isNotNull(), F.lit(False)))
    cos = dot(F.col("vec"), F.col("dvec")) / F.nullif(F.col("vnorm") * F.col("dnorm"), F.lit(0.0))
    scored = rows.select(id_col, "w", "_cand", F.when(F.col("_cand"), cos).alias("_cos"))   # once, rounding reads it often
    scored = scored.withColumn("_score", T.pyround("_cos", 6))
    # words that are no candidates come last, so each document keeps a row
    best = Window.partitionBy(id_col).orderBy(F.col("_cand").desc(), F.col("_score").desc_nulls_last(), F.col("w"))
    top = scored.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") <= top_n)
    picked = F.collect_list(F.when(F.col("_cand"), F.struct("_rn", "w")))
    return top.groupBy(id_col).agg(F.transform(F.array_sort(picked), lambda x: x["w"]).alias(out))


def extract_keywords(df: DataFrame, vectors: DataFrame, stop_words: Sequence[str], text_col: str = "text",
                     id_col: str = "doc_id", top_n: int = L.KEYWORDS_TOP, key=None,
                     out: str = "keywords", partitioned: bool = False) -> DataFrame:
    """K5: unstripped length < 100 -> []; else K3 on the C5 text, RAKE (K2)
    where K3 finds nothing (and only there), then K4 post-processing."""
    dd = df.select(id_col, text_col)
    dd = dd if partitioned else by_document(dd, id_col)
    live = dd.filter(~T.too_short(text_col, L.GUARD_KEYWORDS_MIN, stripped=False))
    k3 = written_table(keywords_embedding(live, vectors, stop_words, text_col, id_col, top_n, key, "kw",
                                          partitioned=True), "k3")
    none = k3.filter(F.size("kw") == 0).select(id_col)
    k2 = keywords_rake(live.join(none, id_col, "left_semi"), stop_words, text_col, id_col, top_n, "kw")
    picked = k3.filter(F.size("kw") > 0).union(k2).select(
        id_col, KWF.postprocess_keywords(F.col("kw"), stop_words).alias(out))
    return dd.select(id_col).join(picked, id_col, "left").select(
        id_col, F.coalesce(F.col(out), F.array().cast("array<string>")).alias(out))
