"""Per-document word statistics computed inside the row.

A document's words never need to meet another document's words for these
statistics, so instead of exploding tokens into rows and shuffling them by
document, the token array is sorted inside the row and equal neighbours are
counted (run-length encoding). Everything stays in JVM built-ins, O(n log n)
per document, no exchange. Lambdas never refer to arrays outside their own
arguments, so each step is linear.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def word_runs(tokens: Column) -> Column:
    """array<string> -> array<struct<w, n, first>> sorted by ``w``:
    each distinct word, its count and the 0-based position of its first
    occurrence."""
    s = F.array_sort(F.transform(tokens, lambda x, i: F.struct(x.alias("w"), i.alias("p"))))
    prev = F.concat(F.array(F.lit(None).cast("string")), F.transform(s, lambda e: e["w"]))
    # zip_with pads the shorter array with NULL: flags has size(s)+1 entries,
    # the last one false.
    flags = F.zip_with(s, prev, lambda e, pw: F.coalesce(e.isNotNull() & (pw.isNull() | (e["w"] != pw)), F.lit(False)))
    heads = F.filter(F.zip_with(s, flags, lambda e, f: F.when(f, e)), lambda e: e.isNotNull())
    starts = F.filter(F.transform(flags, lambda f, i: F.when(f, i).otherwise(F.lit(-1))), lambda i: i >= 0)
    ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts), F.lit(1))), F.array(F.size(s)))
    counts = F.zip_with(starts, ends, lambda a, b: b - a)
    runs = F.zip_with(heads, counts, lambda h, n: F.struct(h["w"].alias("w"), n.alias("n"), h["p"].alias("first")))
    return F.filter(runs, lambda r: r["w"].isNotNull())


def top_words(runs: Column, k: int) -> Column:
    """Top ``k`` words by count desc, ties by first occurrence (a stable sort
    over insertion order)."""
    keyed = F.transform(runs, lambda r: F.struct((-r["n"]).alias("neg"), r["first"].alias("first"), r["w"].alias("w")))
    return F.transform(F.slice(F.array_sort(keyed), 1, k), lambda r: r["w"])


def top_counts_sum(runs: Column, k: int, min_count: int) -> Column:
    """Sum of the ``k`` largest word counts, each only if > ``min_count``."""
    counts = F.sort_array(F.transform(runs, lambda r: r["n"]), asc=False)
    top = F.filter(F.slice(counts, 1, k), lambda n: n > min_count)
    return F.aggregate(top, F.lit(0), lambda acc, n: acc + n).cast("long")
