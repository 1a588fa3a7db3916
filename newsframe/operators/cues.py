"""Cue counts with a large lexicon (D3).

The column form (``functions.scores.bias_cue_count``) is a sum as long as the list. Here
the list is a table: each cue is filed under one of its q-grams (the one that the fewest
cues share), documents are exploded into their distinct q-grams of the lengths that the
cues are filed under, and only cues whose q-gram a document has are counted in it.
Exact: a text that holds a cue holds all its q-grams. The plan does not depend on the number of cues."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe.functions import text as T
from newsframe.session import small_table, written_table

Q = 5       # characters of a gram; shorter cues are their own gram


def _grams(text: Column, q: int) -> Column:
    """All overlapping stretches of q characters, in one pass."""
    return F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{q}}}))"), F.lit(1))


def cue_index(cues: DataFrame, cue_col: str = "cue") -> DataFrame:
    """(gram, cue): each distinct, non-empty, lower-cased cue under its rarest gram."""
    c = cues.select(F.lower(cue_col).alias("cue")).filter("cue <> ''").distinct()
    grams = F.when(F.length("cue") < Q, F.array("cue")).otherwise(_grams(F.col("cue"), Q))
    each = c.select("cue", F.explode(F.array_distinct(grams)).alias("gram"))
    shared = each.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("gram")))
    return shared.groupBy("cue").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))


def cue_counts(df: DataFrame, cues: DataFrame, text_col: str = "text", id_col: str = "doc_id",
               cue_col: str = "cue") -> DataFrame:
    """(id, cue, n): how often (without overlaps) each cue occurs in the C4-cleaned
    text, for cues that occur. Ids must be unique and not null."""
    docs = df.select(id_col, T.clean_for_bias(text_col).alias("_t"))
    index = written_table(cue_index(cues, cue_col), "cue-index")
    lengths = sorted(r["q"] for r in index.select(F.length("gram").alias("q")).distinct().collect()) or [Q]   # at most Q rows
    index = small_table(index)
    grams = F.array_distinct(F.concat(*[_grams(F.col("_t"), q) for q in lengths]))
    held = docs.select(id_col, F.explode(grams).alias("gram")).join(index, "gram").select(id_col, "cue")
    # one row per document crosses to its text, with as many cues as it may hold
    maybe = held.groupBy(id_col).agg(F.collect_list("cue").alias("_cues"))
    texts = docs.join(maybe, id_col).select(id_col, "_t", "_cues")
    return texts.mapInArrow(_count_cues, texts.select(id_col, F.lit("").alias("cue"), F.lit(0).cast("long").alias("n")).schema)


def _count_cues(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(id, cue, n) of rows (id, text, cues). The same number as the length that removing
    the cue takes, over its own: both go left to right without overlaps."""
    for batch in batches:
        ids, texts, lists = batch.columns
        cues = lists.flatten()
        of = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
        text = texts.cast(pa.binary()).to_pylist()
        n = np.array([text[k].count(c) for k, c in zip(of.tolist(), cues.cast(pa.binary()).to_pylist())], dtype=np.int64)
        held = pa.array(np.nonzero(n)[0])
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(of)).take(held), cues.take(held), pa.array(n).take(held)],
                                         names=[batch.schema.names[0], "cue", "n"])


def bias_cue_count(df: DataFrame, cues: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                   out: str = "cue_count", cue_col: str = "cue") -> DataFrame:
    """D3 with a table of cues: (id, out), 0 for documents without a cue."""
    sums = cue_counts(df, cues, text_col, id_col, cue_col).groupBy(id_col).agg(F.sum("n").alias(out))
    return df.select(id_col).join(sums, id_col, "left").select(id_col, F.coalesce(out, F.lit(0).cast("long")).alias(out))
