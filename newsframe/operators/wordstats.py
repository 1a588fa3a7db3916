"""Per-document word statistics on the document-local layout.

Input is a frame already hash-partitioned on the document id (see
``tokens.by_document``). Tokens are exploded next to their document, counted
by a code-generated hash aggregate and ranked by a window; every step is
keyed by the document id, so no step after the single repartition moves
data between tasks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def word_counts(dd: DataFrame, id_col: str, words: Column,
                carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, carry..., w, n, first): count and first position of each word.
    A document without words keeps one row with ``w`` NULL and ``n`` 0."""
    tk = dd.select(id_col, *carry, F.posexplode_outer(words).alias("p", "w"))
    aggs = [F.any_value(c).alias(c) for c in carry]
    return tk.groupBy(id_col, "w").agg(*aggs, F.count("p").alias("n"), F.min("p").alias("first"))


def top_words(counts: DataFrame, id_col: str, k: int, out: str = "keywords",
              carry: tuple[str, ...] = ()) -> DataFrame:
    """Top ``k`` words per document by count desc, ties by first occurrence,
    as an ordered array (empty if none)."""
    w = Window.partitionBy(id_col).orderBy(F.col("n").desc(), F.col("first").asc())
    ranked = counts.withColumn("_rn", F.row_number().over(w)).filter((F.col("_rn") <= k) | F.col("w").isNull())
    picked = F.collect_list(F.when(F.col("w").isNotNull(), F.struct(F.col("_rn"), F.col("w"))))
    return ranked.groupBy(id_col).agg(*[F.any_value(c).alias(c) for c in carry],
                                      F.transform(F.array_sort(picked), lambda s: s["w"]).alias(out))


def top_counts_sum(counts: DataFrame, id_col: str, k: int, min_count: int, out: str,
                   carry: tuple[str, ...] = ()) -> DataFrame:
    """Sum of the ``k`` largest word counts per document, each only if it
    exceeds ``min_count`` (ties do not change the sum)."""
    w = Window.partitionBy(id_col).orderBy(F.col("n").desc())
    ranked = counts.withColumn("_rn", F.row_number().over(w))
    keep = F.when((F.col("_rn") <= k) & (F.col("n") > min_count), F.col("n")).otherwise(F.lit(0))
    return ranked.groupBy(id_col).agg(*[F.any_value(c).alias(c) for c in carry],
                                      F.sum(keep).cast("long").alias(out))
