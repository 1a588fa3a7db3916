"""Row-wise scorers (D1a-c, D1e-f, D1, D2, D3, D5, D6, D8 label) as native
column expressions. Cue lists are parameters; defaults in ``lexicons``."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions.text import _c, count_substr, pyround, strip, tokens
from newsframe.functions.words import top_counts_sum, word_runs


def lowered_stripped(c) -> Column:
    return strip(F.lower(F.coalesce(_c(c), F.lit(""))))


def clickbait_hits(t, phrases: Sequence[str] = L.CLICKBAIT_PHRASES) -> Column:
    """Number of distinct cue phrases present (on prepared text)."""
    x = _c(t)
    out = F.lit(0).cast("long")
    for p in dict.fromkeys(phrases):
        out = out + x.contains(p).cast("long")
    return out


def exclamation_count(t) -> Column:
    """count('!') + count('!!!'), non-overlapping."""
    return count_substr(t, "!") + count_substr(t, "!!!")


def punct_runs(t) -> Column:
    """Number of ``[!?]{2,}`` matches."""
    return F.regexp_count(F.coalesce(_c(t), F.lit("")), F.lit(r"[!?]{2,}")).cast("long")


def has_source(t, phrases: Sequence[str] = L.SOURCE_PHRASES) -> Column:
    """D1e: any source phrase occurs."""
    x = _c(t)
    out = F.lit(False)
    for p in phrases:
        out = out | x.contains(p)
    return out


def length_score(n_words: Column, ideal: int = L.CREDIBILITY_IDEAL_WORDS) -> Column:
    """D1f: min(words / ideal, 1)."""
    return F.least(n_words.cast("double") / F.lit(float(ideal)), F.lit(1.0))


def top_repetition(t) -> Column:
    """D1d (in-row): sum of the 3 largest word counts that exceed 5."""
    return top_counts_sum(word_runs(tokens(t)), L.REPETITION_TOP, L.REPETITION_MIN_COUNT)


def credibility_parts(text, clickbait: Sequence[str] = L.CLICKBAIT_PHRASES,
                      sources: Sequence[str] = L.SOURCE_PHRASES) -> dict[str, Column]:
    """The D1 components on lower-cased, stripped text."""
    t = lowered_stripped(text)
    toks = tokens(t)
    return {
        "clickbait": clickbait_hits(t, clickbait),
        "exclamations": exclamation_count(t),
        "punct_runs": punct_runs(t),
        "repetition": top_counts_sum(word_runs(toks), L.REPETITION_TOP, L.REPETITION_MIN_COUNT),
        "has_source": has_source(t, sources),
        "n_words": F.size(toks).cast("long"),
    }


def combine_credibility(clickbait, exclamations, runs, repetition, source, n_words) -> Column:
    """0.4*min(words/300,1) + 0.2*source + 0.4/(1+penalties), clamped to
    [0, 1], rounded to 2 decimals."""
    raw = (length_score(n_words) * F.lit(L.CREDIBILITY_W_LENGTH)
           + source.cast("int").cast("double") * F.lit(L.CREDIBILITY_W_SOURCE)
           + (F.lit(1.0) / (F.lit(1.0) + (clickbait + exclamations + runs + repetition).cast("double")))
           * F.lit(L.CREDIBILITY_W_PENALTY))
    return pyround(F.least(F.greatest(raw, F.lit(0.0)), F.lit(1.0)), 2)


def credibility_heuristic(text, clickbait: Sequence[str] = L.CLICKBAIT_PHRASES,
                          sources: Sequence[str] = L.SOURCE_PHRASES) -> Column:
    p = credibility_parts(text, clickbait, sources)
    return combine_credibility(p["clickbait"], p["exclamations"], p["punct_runs"],
                               p["repetition"], p["has_source"], p["n_words"])


def penalty_hits(text, cues: Sequence[str] = L.PENALTY_CUES) -> Column:
    t = F.lower(F.coalesce(_c(text), F.lit("")))
    out = F.lit(0).cast("long")
    for cue in cues:
        out = out + count_substr(t, cue.lower())
    return out


def credibility_penalty(text, cues: Sequence[str] = L.PENALTY_CUES) -> Column:
    """max(100 - 10 * sum of cue counts, 0) on lower text."""
    return F.greatest(F.lit(L.PENALTY_START) - penalty_hits(text, cues).cast("double") * F.lit(L.PENALTY_PER_HIT),
                      F.lit(0.0))


def bias_cue_count(clean_text, cues: Sequence[str] | None = None) -> Column:
    """D3: sum of non-overlapping substring counts of every cue (C4 text)."""
    cues = list(cues) if cues is not None else L.BIAS_LOADED_PHRASES + L.BIAS_EMOTION_WORDS
    out = F.lit(0).cast("long")
    for cue in cues:
        out = out + count_substr(clean_text, cue.lower())
    return out


def bias_score(cues: Column, polarity: Column) -> Column:
    """round(0.7*cues + |polarity| * 10 * 0.3, 2), multiplied in that order."""
    return pyround(cues.cast("double") * F.lit(L.BIAS_CUE_WEIGHT)
                   + F.abs(polarity) * F.lit(L.BIAS_POLARITY_SCALE) * F.lit(L.BIAS_POLARITY_WEIGHT), 2)


def bias_label(score: Column) -> Column:
    """<2 Low, <4 Moderate, else High."""
    (b1, l1), (b2, l2) = L.BIAS_LABELS
    return F.when(score < b1, l1).when(score < b2, l2).otherwise(L.BIAS_LABEL_HIGH)


def sentiment_score(polarity: Column) -> Column:
    """round((p + 1) * 5, 2)."""
    return pyround((polarity + F.lit(1.0)) * F.lit(5.0), 2)


def sentiment_label(polarity: Column) -> Column:
    return (F.when(polarity < L.SENTIMENT_NEGATIVE_BELOW, "Negative")
            .when(polarity > L.SENTIMENT_POSITIVE_ABOVE, "Positive").otherwise("Neutral"))
