"""Batch summarization hook (M2).

Guard and truncation run as native expressions; the summarizer itself is a
pluggable backend called per Arrow batch through ``mapInPandas``; a factory
loads a model once per task, not per batch or row. A primary backend may be
backed by a fallback; every row carries a status instead of relying on the
text of the summary."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import text as T

# A backend maps a Series of texts to (summaries, ok flags).
Backend = Callable[[pd.Series], tuple[pd.Series, pd.Series]]

_SENT_SPLIT = re.compile(r"(?<=[.!?]) +")


def lead_backend(k: int = L.LEAD_SENTENCES) -> Backend:
    """First ``k`` sentences (the M1 rule), needs no model."""
    def run(texts: pd.Series) -> tuple[pd.Series, pd.Series]:
        out = texts.fillna("").map(lambda t: " ".join(_SENT_SPLIT.split(t)[:k]).strip())
        return out, pd.Series(True, index=texts.index)
    return run


def summarize(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
              backend: Backend | None = None, fallback: Backend | None = None,
              max_words: int = L.TRUNCATE_REMOTE_WORDS, fallback_words: int = L.TRUNCATE_LOCAL_WORDS,
              out: str = "summary", factory: Callable[[], Backend] | None = None,
              fallback_factory: Callable[[], Backend] | None = None) -> DataFrame:
    """M2: (id, summary, status). Texts shorter than 100 characters (after
    strip) get the fixed answer and status 'short'; others go to ``backend``
    cut to ``max_words`` words and, where it fails, to ``fallback`` cut to
    ``fallback_words`` (status 'fallback'); rows neither could do get 'failed'.
    A ``factory`` makes the backend (it loads a model, say) and is called once in
    each task, at the first text that needs it, however many batches follow.
    Without a backend the first sentences of the shorter cut are the summary,
    as a plain column expression."""
    short = T.too_short(text_col, L.GUARD_SUMMARY_MIN)
    if backend is None and factory is None:
        from newsframe.functions.summary import summary_lead as lead
        return df.select(id_col, F.when(short, F.lit(L.TOO_SHORT_SUMMARY)).otherwise(
            lead(T.truncate_words(text_col, fallback_words))).alias(out),
            F.when(short, F.lit("short")).otherwise("ok").alias("status"))
    prep = df.select(id_col, short.alias("_short"), T.truncate_words(text_col, max_words).alias("_in"),
                     T.truncate_words(text_col, fallback_words).alias("_less"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        first, second = backend, fallback
        for pdf in batches:
            res = pd.Series(L.TOO_SHORT_SUMMARY, index=pdf.index, dtype=object)
            status = pd.Series("short", index=pdf.index, dtype=object)
            live = ~pdf["_short"].astype(bool)
            if live.any():
                first = first or factory()
                s, ok = first(pdf.loc[live, "_in"])
                res[live] = s
                status[live] = ok.map({True: "ok", False: "failed"})
                failed = live & (status == "failed")
                if failed.any() and (second is not None or fallback_factory is not None):
                    second = second or fallback_factory()
                    s2, ok2 = second(pdf.loc[failed, "_less"])
                    res[failed] = s2
                    status[failed] = ok2.map({True: "fallback", False: "failed"})
            yield pd.DataFrame({id_col: pdf[id_col], out: res, "status": status})

    id_type = df.schema[id_col].dataType.simpleString()
    return prep.mapInPandas(run, schema=f"`{id_col}` {id_type}, `{out}` string, status string")


def summary_lead(df: DataFrame, text_col: str = "text", out: str = "summary") -> DataFrame:
    """M1 as an operator (native expression)."""
    from newsframe.functions.summary import summary_lead as lead
    return df.withColumn(out, lead(F.col(text_col)))
