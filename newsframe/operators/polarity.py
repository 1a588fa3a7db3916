"""Lexicon polarity (D4) and the bias / sentiment analyses built on it
(D5-D8).

Plan: tokens and their predecessor are paired inside the row (no window),
exploded where they are read, inner-joined with the broadcast lexicon and then
the modifier table (hash joins, sizes checked), so only matches go on, and
summed per document. The aggregate runs a map-side partial step in the same
stage, so only one small row per document is shuffled. Sums are exact decimals, so the mean does not
depend on summation order.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import scores as S
from newsframe.functions import text as T
from newsframe.session import small_table

DEC = "decimal(12,6)"


def lexicon_frame(spark: SparkSession, pairs: Sequence[tuple[str, float]]) -> DataFrame:
    return spark.createDataFrame([(w, float(p)) for w, p in pairs], "word string, polarity double")


def modifier_frame(spark: SparkSession, negators: Sequence[str] = (),
                   intensifiers: Sequence[tuple[str, float]] = (),
                   negation_factor: float = -0.5) -> DataFrame:
    rows = {w: negation_factor for w in negators}
    rows.update({w: float(f) for w, f in intensifiers})
    return spark.createDataFrame(sorted(rows.items()), "word string, factor double")


def polarity(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None,
             text_col: str = "text", id_col: str = "doc_id", out: str = "polarity",
             keep: Sequence[str] = ()) -> DataFrame:
    """Mean of matched word polarities; a word right after a modifier is
    multiplied by its factor (negators -0.5) and clamped to [-1, 1]; no match
    gives 0. Returns ``id_col``, ``keep`` columns and ``out``."""
    toks = T.tokens(text_col)
    prev = F.concat(F.array(F.lit(None).cast("string")), toks)
    # one element more than tokens: its word is the empty one, which the lexicon
    # below matches without a polarity, so that every document keeps a row
    pairs = F.zip_with(toks, prev, lambda w, p: F.struct(F.coalesce(w, F.lit("")).alias("w"), p.alias("prev")))
    exploded = df.select(id_col, *keep, F.inline(pairs))
    known = lexicon.select(F.col("word").alias("w"), F.col("polarity").cast(DEC).alias("pol")).filter("w <> ''")
    none = df.sparkSession.createDataFrame([("", None)], "w string, pol " + DEC)
    joined = exploded.join(small_table(known.unionByName(none)), "w")
    factor = F.lit(1).cast(DEC)
    if modifiers is not None:
        mods = small_table(modifiers.select(F.col("word").alias("prev"), F.col("factor").cast(DEC).alias("factor")))
        joined = joined.join(mods, "prev", "left")
        factor = F.coalesce(F.col("factor"), factor)
    # least/greatest skip NULLs, so only matched words are clamped
    value = F.when(F.col("pol").isNotNull(),
                   F.greatest(F.least(F.col("pol") * factor, F.lit(1).cast(DEC)), F.lit(-1).cast(DEC)))
    agg = joined.groupBy(id_col).agg(*[F.any_value(k).alias(k) for k in keep],
                                     F.sum(value).alias("_s"), F.count("pol").alias("_n"))
    pol = F.when(F.col("_n") > 0, F.col("_s").cast("double") / F.col("_n").cast("double")).otherwise(F.lit(0.0))
    return agg.select(id_col, *keep, pol.alias(out))


def analyze_bias(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None,
                 text_col: str = "text", id_col: str = "doc_id",
                 cues: Sequence[str] | None = None, with_parts: bool = False) -> DataFrame:
    """Guard (stripped length < 100), else D5 score and D6 label, with
    cues and polarity both taken on the C4-cleaned text."""
    prep = df.select(id_col, T.clean_for_bias(text_col).alias("_clean"),
                     T.too_short(text_col, L.GUARD_BIAS_MIN).alias("_short"))
    prep = prep.select(id_col, "_clean", "_short", S.bias_cue_count("_clean", cues).alias("cue_count"))
    pol = polarity(prep, lexicon, modifiers, "_clean", id_col, "polarity", keep=["_short", "cue_count"])
    score = S.bias_score(F.col("cue_count"), F.col("polarity"))
    res = pol.select(id_col, "cue_count", "polarity",
                     F.when(F.col("_short"), F.lit(0.0)).otherwise(score).alias("bias_score"),
                     F.when(F.col("_short"), F.lit(L.NOT_ENOUGH_TEXT))
                     .otherwise(S.bias_label(score)).alias("bias_label"))
    return res if with_parts else res.drop("cue_count", "polarity")


def analyze_sentiment(df: DataFrame, lexicon: DataFrame, modifiers: DataFrame | None = None,
                      text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Guard (stripped length < 50); score round((p+1)*5, 2); label by
    strict bounds -0.2 / 0.2. Polarity on the raw text."""
    prep = df.select(id_col, text_col, T.too_short(text_col, L.GUARD_SENTIMENT_MIN).alias("_short"))
    pol = polarity(prep, lexicon, modifiers, text_col, id_col, "polarity", keep=["_short"])
    p = F.col("polarity")
    return pol.select(
        id_col,
        F.when(F.col("_short"), F.lit(0.0)).otherwise(S.sentiment_score(p)).alias("sentiment_score"),
        F.when(F.col("_short"), F.lit(L.NOT_ENOUGH_TEXT)).otherwise(S.sentiment_label(p)).alias("sentiment_label"))
