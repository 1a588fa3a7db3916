"""Registered queries: cleaning (C2, C4-C6), guards (F1), truncation (F2),
lead summary (M1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import summary as M
from newsframe.functions import text as T
from newsframe.operators.tokens import tokenize
from newsframe.plans import sqlkit as K
from newsframe.plans.registry import register
from newsframe.sources.tables import read_table


def _docs(spark, base):
    return read_table(spark, base, "documents")


@register("normalize_text", f"SELECT doc_id, {K.normalize('text')} AS text_norm FROM documents")
def normalize_text(spark, base):
    return _docs(spark, base).select("doc_id", T.normalize_text("text").alias("text_norm"))


@register("clean_for_bias", f"SELECT doc_id, {K.clean_bias('text')} AS text_clean FROM documents")
def clean_for_bias(spark, base):
    return _docs(spark, base).select("doc_id", T.clean_for_bias("text").alias("text_clean"))


@register("clean_for_keywords", f"SELECT doc_id, {K.clean_keywords('text')} AS text_clean FROM documents")
def clean_for_keywords(spark, base):
    return _docs(spark, base).select("doc_id", T.clean_for_keywords("text").alias("text_clean"))


@register("tokenize", f"""
SELECT doc_id, unnest(range(len(toks)))::BIGINT AS pos, unnest(toks) AS token
FROM (SELECT doc_id, {K.tokens('text')} AS toks FROM documents)
""")
def tokenize_q(spark, base):
    return tokenize(_docs(spark, base)).select("doc_id", F.col("pos").cast("long").alias("pos"), "token")


def _slen(x):
    return f"length({K.strip(f'coalesce({x}, {K.q(str())})')})"


@register("short_text_guards", f"""
SELECT doc_id,
  {_slen('text')} < {L.GUARD_BIAS_MIN} AS bias_guard,
  {_slen('text')} < {L.GUARD_SENTIMENT_MIN} AS sentiment_guard,
  {_slen('text')} < {L.GUARD_SUMMARY_MIN} AS summary_guard,
  length(coalesce(text, '')) < {L.GUARD_KEYWORDS_MIN} AS keywords_guard
FROM documents""")
def short_text_guards(spark, base):
    return _docs(spark, base).select(
        "doc_id",
        T.too_short("text", L.GUARD_BIAS_MIN).alias("bias_guard"),
        T.too_short("text", L.GUARD_SENTIMENT_MIN).alias("sentiment_guard"),
        T.too_short("text", L.GUARD_SUMMARY_MIN).alias("summary_guard"),
        T.too_short("text", L.GUARD_KEYWORDS_MIN, stripped=False).alias("keywords_guard"))


def _trunc_sql(n):
    words = f"list_filter(regexp_split_to_array(text, '[{T.WS}]+'), lambda w: w <> '')"
    return f"CASE WHEN len({words}) > {n} THEN array_to_string({words}[1:{n}], ' ') ELSE text END"


@register("truncate_words", f"""
SELECT doc_id, {_trunc_sql(L.TRUNCATE_LOCAL_WORDS)} AS text_local,
       {_trunc_sql(L.TRUNCATE_REMOTE_WORDS)} AS text_remote FROM documents""")
def truncate_words(spark, base):
    return _docs(spark, base).select(
        "doc_id", T.truncate_words("text", L.TRUNCATE_LOCAL_WORDS).alias("text_local"),
        T.truncate_words("text", L.TRUNCATE_REMOTE_WORDS).alias("text_remote"))


def lead_sql(x, k=L.LEAD_SENTENCES):
    marked = f"regexp_replace(coalesce({x}, ''), '([.!?]) +', '\\1' || chr(2), 'g')"
    return K.strip(f"array_to_string(string_split({marked}, chr(2))[1:{k}], ' ')")


@register("summary_lead", f"SELECT doc_id, {lead_sql('text')} AS summary FROM documents")
def summary_lead(spark, base):
    return _docs(spark, base).select("doc_id", M.summary_lead("text").alias("summary"))


@register("summary_batch_model", f"""SELECT doc_id,
  CASE WHEN length({K.strip("coalesce(text, '')")}) < {L.GUARD_SUMMARY_MIN} THEN {K.q(L.TOO_SHORT_SUMMARY)}
       ELSE {lead_sql(f"({_trunc_sql(L.TRUNCATE_LOCAL_WORDS)})")} END AS summary,
  CASE WHEN length({K.strip("coalesce(text, '')")}) < {L.GUARD_SUMMARY_MIN} THEN 'short' ELSE 'ok' END AS status
FROM documents""")
def summary_batch_model(spark, base):
    from newsframe.operators.summarize import summarize
    return summarize(_docs(spark, base))
