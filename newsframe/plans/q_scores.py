"""Registered queries: credibility (D1, D1a-f, D2), bias and sentiment
(D3-D8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import scores as S
from newsframe.functions import text as T
from newsframe.operators import polarity as P
from newsframe.operators.credibility import credibility_heuristic as d1_op
from newsframe.operators.credibility import top3_repetition as top3_repetition_op
from newsframe.plans import params as PR
from newsframe.plans import sqlkit as K
from newsframe.operators import cues
from newsframe.plans.registry import register
from newsframe.sources.tables import read_table

TOKEN = T.TOKEN


def _docs(spark, base):
    return read_table(spark, base, "documents")


# ---------------------------------------------------------------- SQL parts

def _lt(x="text"):
    return K.strip(f"lower(coalesce({x}, ''))")


def _contains_any_sum(x, phrases):
    return "(" + " + ".join(f"contains({x}, {K.q(p)})::BIGINT" for p in dict.fromkeys(phrases)) + ")"


def _d1_sql(clickbait, sources):
    return "WITH " + d1_ctes(clickbait, sources) + """
SELECT doc_id, clickbait, exclamations, punct_runs, repetition, has_source, n_words, credibility FROM d1"""


def d1_ctes(clickbait=L.CLICKBAIT_PHRASES, sources=L.SOURCE_PHRASES, src_table="documents", text="text"):
    """CTEs ending in ``d1(doc_id, parts..., credibility)``."""
    src = " OR ".join(f"contains(lt, {K.q(p)})" for p in sources)
    return f"""
base AS (SELECT doc_id, {_lt(text)} AS lt FROM {src_table}),
tk AS (SELECT doc_id, unnest(regexp_extract_all(lt, '{TOKEN}')) AS w FROM base),
wc AS (SELECT doc_id, w, count(*) AS n FROM tk GROUP BY doc_id, w),
rk AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS rn FROM wc),
rep AS (SELECT doc_id, sum(CASE WHEN rn <= {L.REPETITION_TOP} AND n > {L.REPETITION_MIN_COUNT} THEN n ELSE 0 END)::BIGINT AS repetition
        FROM rk GROUP BY doc_id),
parts AS (
  SELECT b.doc_id,
    {_contains_any_sum('lt', clickbait)} AS clickbait,
    ({K.count_substr('lt', '!')} + {K.count_substr('lt', '!!!')})::BIGINT AS exclamations,
    len(regexp_extract_all(lt, '[!?]{{2,}}'))::BIGINT AS punct_runs,
    coalesce(rep.repetition, 0)::BIGINT AS repetition,
    ({src}) AS has_source,
    len(regexp_extract_all(lt, '{TOKEN}'))::BIGINT AS n_words
  FROM base b LEFT JOIN rep ON b.doc_id = rep.doc_id),
d1 AS (SELECT doc_id, clickbait, exclamations, punct_runs, repetition, has_source, n_words,
  {K.pyround('''least(greatest(
      least(n_words::DOUBLE / 300.0::DOUBLE, 1.0::DOUBLE) * 0.4::DOUBLE
      + has_source::INT::DOUBLE * 0.2::DOUBLE
      + (1.0::DOUBLE / (1.0::DOUBLE + (clickbait + exclamations + punct_runs + repetition)::DOUBLE)) * 0.4::DOUBLE,
      0.0::DOUBLE), 1.0::DOUBLE)''', 2)} AS credibility
FROM parts)"""


@register("credibility_heuristic", _d1_sql(L.CLICKBAIT_PHRASES, L.SOURCE_PHRASES))
def credibility_heuristic(spark, base):
    return d1_op(_docs(spark, base), with_parts=True)


@register("credibility_heuristic_data_cues", _d1_sql(PR.DATA_CUES, PR.DATA_SOURCE_PHRASES))
def credibility_heuristic_data(spark, base):
    return d1_op(_docs(spark, base), with_parts=True,
                 clickbait=PR.DATA_CUES, sources=PR.DATA_SOURCE_PHRASES)


@register("clickbait_hits", f"SELECT doc_id, {_contains_any_sum(_lt(), PR.DATA_CUES)} AS clickbait FROM documents")
def clickbait_hits(spark, base):
    return _docs(spark, base).select("doc_id", S.clickbait_hits(S.lowered_stripped("text"), PR.DATA_CUES).alias("clickbait"))


@register("exclamation_count", f"""SELECT doc_id, ({K.count_substr(_lt(), '!')} + {K.count_substr(_lt(), '!!!')})::BIGINT
  AS exclamations FROM documents""")
def exclamation_count(spark, base):
    return _docs(spark, base).select("doc_id", S.exclamation_count(S.lowered_stripped("text")).alias("exclamations"))


@register("punct_runs", f"SELECT doc_id, len(regexp_extract_all({_lt()}, '[!?]{{2,}}'))::BIGINT AS punct_runs FROM documents")
def punct_runs(spark, base):
    return _docs(spark, base).select("doc_id", S.punct_runs(S.lowered_stripped("text")).alias("punct_runs"))


@register("top3_repetition", f"""
WITH tk AS (SELECT doc_id, unnest(regexp_extract_all({_lt()}, '{TOKEN}')) AS w FROM documents),
wc AS (SELECT doc_id, w, count(*) AS n FROM tk GROUP BY doc_id, w),
rk AS (SELECT doc_id, n, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC) AS rn FROM wc),
rep AS (SELECT doc_id, sum(CASE WHEN rn <= 3 AND n > 5 THEN n ELSE 0 END)::BIGINT AS repetition FROM rk GROUP BY doc_id)
SELECT d.doc_id, coalesce(rep.repetition, 0)::BIGINT AS repetition FROM documents d LEFT JOIN rep ON d.doc_id = rep.doc_id""")
def top3_repetition(spark, base):
    return top3_repetition_op(_docs(spark, base))


@register("has_source", f"""SELECT doc_id, ({' OR '.join(f"contains({_lt()}, {K.q(p)})" for p in PR.DATA_SOURCE_PHRASES)})
  AS has_source FROM documents""")
def has_source(spark, base):
    return _docs(spark, base).select("doc_id", S.has_source(S.lowered_stripped("text"), PR.DATA_SOURCE_PHRASES).alias("has_source"))


@register("length_score", f"""SELECT doc_id,
  least(len(regexp_extract_all({_lt()}, '{TOKEN}'))::DOUBLE / 300.0::DOUBLE, 1.0::DOUBLE) AS length_score FROM documents""")
def length_score(spark, base):
    return _docs(spark, base).select("doc_id", S.length_score(F.size(T.tokens(S.lowered_stripped("text")))).alias("length_score"))


def _penalty_sql(cues):
    lt = "lower(coalesce(text, ''))"
    hits = " + ".join(K.count_substr(lt, c) for c in cues)
    return f"SELECT doc_id, greatest(100.0::DOUBLE - ({hits})::DOUBLE * 10.0::DOUBLE, 0.0::DOUBLE) AS credibility FROM documents"


@register("credibility_penalty", _penalty_sql(L.PENALTY_CUES))
def credibility_penalty(spark, base):
    return _docs(spark, base).select("doc_id", S.credibility_penalty("text").alias("credibility"))


@register("credibility_penalty_data_cues", _penalty_sql(PR.DATA_CUES))
def credibility_penalty_data(spark, base):
    return _docs(spark, base).select("doc_id", S.credibility_penalty("text", PR.DATA_CUES).alias("credibility"))


def _cue_sql(x, cues):
    return "(" + " + ".join(K.count_substr(x, c) for c in cues) + ")::BIGINT"


BIAS_DATA_CUES = L.BIAS_LOADED_PHRASES + L.BIAS_EMOTION_WORDS + PR.DATA_CUES


@register("bias_cue_count", f"""SELECT doc_id, {_cue_sql(K.clean_bias('text'), L.BIAS_LOADED_PHRASES + L.BIAS_EMOTION_WORDS)} AS cue_count,
  {_cue_sql(K.clean_bias('text'), BIAS_DATA_CUES)} AS cue_count_data FROM documents""")
def bias_cue_count(spark, base):
    c = T.clean_for_bias("text")
    return _docs(spark, base).select("doc_id", S.bias_cue_count(c).alias("cue_count"),
                                     S.bias_cue_count(c, BIAS_DATA_CUES).alias("cue_count_data"))


@register("bias_cue_count_lexicon", f"""WITH cues AS (SELECT DISTINCT unnest({K.tokens('text')}) AS cue FROM benchmark),
c AS (SELECT doc_id, {K.clean_bias('text')} AS t FROM documents)
SELECT doc_id, coalesce(sum((length(t) - length(replace(t, cue, ''))) // length(cue)), 0)::BIGINT AS cue_count
FROM c, cues WHERE length(cue) >= 5 GROUP BY doc_id""")
def bias_cue_count_lexicon(spark, base):
    """D3 with the words of five letters and more of the benchmark table as cues."""
    words = read_table(spark, base, "benchmark").select(F.explode(T.tokens("text")).alias("cue"))
    return cues.bias_cue_count(_docs(spark, base), words.filter(F.length("cue") >= 5))


# ------------------------------------------------------------- polarity SQL

DEC = "DECIMAL(12,6)"


def _lex_sql():
    vals = ", ".join(f"({K.q(w)}, {p})" for w, p in PR.POLARITY_LEXICON)
    return f"(VALUES {vals}) AS lex(word, polarity)"


def _mods_sql():
    rows = {w: -0.5 for w in PR.NEGATORS}
    rows.update(dict(PR.INTENSIFIERS))
    vals = ", ".join(f"({K.q(w)}, {f})" for w, f in sorted(rows.items()))
    return f"(VALUES {vals}) AS mods(word, factor)"


def polarity_ctes(src: str, text_expr: str, prefix: str = "p") -> str:
    """CTEs ``{prefix}_pol(doc_id, polarity)`` over every row of ``src``."""
    return f"""
{prefix}_t AS (
  SELECT doc_id, unnest(toks) AS w, unnest(list_prepend(NULL::VARCHAR, toks)[1:len(toks)]) AS prev
  FROM (SELECT doc_id, regexp_extract_all(lower(coalesce({text_expr}, '')), '{TOKEN}') AS toks FROM {src})),
{prefix}_s AS (
  SELECT t.doc_id,
    sum(CASE WHEN lex.polarity IS NOT NULL THEN
        greatest(least(lex.polarity::{DEC} * coalesce(mods.factor::{DEC}, 1::{DEC}), 1::{DEC}), -1::{DEC}) END) AS s,
    count(lex.polarity) AS n
  FROM {prefix}_t t LEFT JOIN {_lex_sql()} ON t.w = lex.word LEFT JOIN {_mods_sql()} ON t.prev = mods.word
  GROUP BY t.doc_id),
{prefix}_pol AS (
  SELECT s0.doc_id, CASE WHEN coalesce(ps.n, 0) > 0 THEN ps.s::DOUBLE / ps.n::DOUBLE ELSE 0.0::DOUBLE END AS polarity
  FROM {src} s0 LEFT JOIN {prefix}_s ps ON s0.doc_id = ps.doc_id)"""


def _lex(spark):
    return P.lexicon_frame(spark, PR.POLARITY_LEXICON)


def _mods(spark):
    return P.modifier_frame(spark, PR.NEGATORS, PR.INTENSIFIERS)


@register("polarity", f"WITH {polarity_ctes('documents', 'text')} SELECT doc_id, polarity FROM p_pol")
def polarity_q(spark, base):
    return P.polarity(_docs(spark, base).select("doc_id", "text"), _lex(spark), _mods(spark))


_BIAS_CTES = f"""
WITH cb AS (SELECT doc_id, {K.clean_bias('text')} AS clean, length({K.strip("coalesce(text, '')")}) < {L.GUARD_BIAS_MIN} AS short
            FROM documents),
{polarity_ctes('cb', 'clean')},
sc AS (SELECT cb.doc_id, cb.short, {_cue_sql('cb.clean', L.BIAS_LOADED_PHRASES + L.BIAS_EMOTION_WORDS)} AS cue_count, p.polarity,
         {K.pyround(f"({_cue_sql('cb.clean', L.BIAS_LOADED_PHRASES + L.BIAS_EMOTION_WORDS)})::DOUBLE * 0.7::DOUBLE + abs(p.polarity) * 10.0::DOUBLE * 0.3::DOUBLE", 2)} AS score
       FROM cb JOIN p_pol p ON cb.doc_id = p.doc_id)"""

_LABEL = "CASE WHEN score < 2.0 THEN 'Low Bias' WHEN score < 4.0 THEN 'Moderate Bias' ELSE 'High Bias' END"


@register("bias_score", f"{_BIAS_CTES} SELECT doc_id, cue_count, polarity, score AS bias_score FROM sc")
def bias_score(spark, base):
    r = P.analyze_bias(_docs(spark, base), _lex(spark), _mods(spark), with_parts=True)
    return r.select("doc_id", "cue_count", "polarity",
                    S.bias_score(F.col("cue_count"), F.col("polarity")).alias("bias_score"))


@register("bias_label", f"{_BIAS_CTES} SELECT doc_id, score AS bias_score, {_LABEL} AS bias_label FROM sc")
def bias_label(spark, base):
    r = P.analyze_bias(_docs(spark, base), _lex(spark), _mods(spark), with_parts=True)
    s = S.bias_score(F.col("cue_count"), F.col("polarity"))
    return r.select("doc_id", s.alias("bias_score"), S.bias_label(s).alias("bias_label"))


@register("analyze_bias", f"""{_BIAS_CTES}
SELECT doc_id, CASE WHEN short THEN 0.0::DOUBLE ELSE score END AS bias_score,
       CASE WHEN short THEN 'Not enough text' ELSE {_LABEL} END AS bias_label FROM sc""")
def analyze_bias(spark, base):
    return P.analyze_bias(_docs(spark, base), _lex(spark), _mods(spark))


@register("analyze_sentiment", f"""
WITH {polarity_ctes('documents', 'text')}
SELECT d.doc_id,
  CASE WHEN length({K.strip("coalesce(d.text, '')")}) < {L.GUARD_SENTIMENT_MIN} THEN 0.0::DOUBLE
       ELSE {K.pyround('(p.polarity + 1.0::DOUBLE) * 5.0::DOUBLE', 2)} END AS sentiment_score,
  CASE WHEN length({K.strip("coalesce(d.text, '')")}) < {L.GUARD_SENTIMENT_MIN} THEN 'Not enough text'
       WHEN p.polarity < -0.2::DOUBLE THEN 'Negative' WHEN p.polarity > 0.2::DOUBLE THEN 'Positive'
       ELSE 'Neutral' END AS sentiment_label
FROM documents d JOIN p_pol p ON d.doc_id = p.doc_id""")
def analyze_sentiment(spark, base):
    return P.analyze_sentiment(_docs(spark, base), _lex(spark), _mods(spark))
