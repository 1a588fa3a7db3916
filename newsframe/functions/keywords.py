"""Keyword list helpers as column expressions (K1 in-row, K4)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions.text import WS_RUN, _c, tokens
from newsframe.functions.words import top_words, word_runs


def keywords_freq(text, top_n: int = L.FREQ_KEYWORDS_TOP,
                  min_len: int = L.FREQ_KEYWORD_MIN_LEN) -> Column:
    """K1: ASCII-letter words of at least ``min_len`` letters, by count desc,
    ties by first occurrence; top ``top_n``. Computed inside the row."""
    words = F.filter(tokens(text), lambda w: w.rlike(f"^[a-z]{{{min_len},}}$"))
    return top_words(word_runs(words), top_n)


def postprocess_keywords(phrases, stop_words: Sequence[str],
                         min_chars: int = L.KEYWORD_MIN_CHARS,
                         cap: int = L.KEYWORDS_CAP) -> Column:
    """K4: drop phrases shorter than ``min_chars``; remove stop words inside;
    drop empties; distinct; order by (length desc, text asc); first ``cap``."""
    stop = F.array(*[F.lit(w) for w in sorted(set(stop_words))]) if stop_words else F.array().cast("array<string>")
    kept = F.filter(F.coalesce(_c(phrases), F.array().cast("array<string>")),
                    lambda p: F.length(p) >= min_chars)
    cleaned = F.transform(kept, lambda p: F.array_join(
        F.filter(F.split(p, WS_RUN), lambda w: (w != F.lit("")) & ~F.array_contains(stop, w)), " "))
    uniq = F.array_distinct(F.filter(cleaned, lambda p: p != F.lit("")))
    ordered = F.array_sort(uniq, lambda a, b: F.when(F.length(a) > F.length(b), -1)
                           .when(F.length(a) < F.length(b), 1)
                           .when(a < b, -1).when(a > b, 1).otherwise(0))
    return F.slice(ordered, 1, cap)
