"""Registered queries: keywords (K1-K5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe.functions import keywords as KW
from newsframe.functions import text as T
from newsframe.plans import sqlkit as K
from newsframe.plans.registry import register
from newsframe.sources.tables import read_table

TOKEN = T.TOKEN


def _docs(spark, base):
    return read_table(spark, base, "documents")


def k1_ctes(src="documents", text="text", n=5, prefix="k1"):
    """CTE ``{prefix}_kw(doc_id, keywords)`` (comma-joined) over every row."""
    return f"""
{prefix}_t AS (SELECT doc_id, unnest(toks) AS w, unnest(range(len(toks))) AS p
          FROM (SELECT doc_id, regexp_extract_all(lower(coalesce({text}, '')), '{TOKEN}') AS toks FROM {src})),
{prefix}_c AS (SELECT doc_id, w, count(*) AS n, min(p) AS first FROM {prefix}_t
          WHERE regexp_full_match(w, '[a-z]{{4,}}') GROUP BY doc_id, w),
{prefix}_r AS (SELECT doc_id, w, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS rn FROM {prefix}_c),
{prefix}_kw AS (SELECT s.doc_id, coalesce(string_agg(r.w, ',' ORDER BY r.rn), '') AS keywords
          FROM {src} s LEFT JOIN {prefix}_r r ON s.doc_id = r.doc_id AND r.rn <= {n} GROUP BY s.doc_id)"""


@register("keywords_freq", f"WITH {k1_ctes()} SELECT doc_id, keywords FROM k1_kw")
def keywords_freq(spark, base):
    from newsframe.operators.keywords import keywords_freq as k1
    return k1(_docs(spark, base)).select("doc_id", F.array_join("keywords", ",").alias("keywords"))


# --------------------------------------------------------------- K2 / K4

from newsframe import lexicons as L  # noqa: E402
from newsframe.operators import keywords as KO  # noqa: E402
from newsframe.plans import params as PR  # noqa: E402


def _stop_values(words):
    return "(VALUES " + ", ".join(f"({K.q(w)})" for w in sorted(set(words))) + ") AS sw(word)"


def rake_ctes(src="documents", text="text", stop=PR.STOP_WORDS_20, n=10, prefix="rk", clean=True):
    """CTE ``{prefix}_kw(doc_id, keywords)`` with RAKE phrases comma-joined."""
    t = K.clean_keywords(text) if clean else text
    return f"""
{prefix}_c AS (SELECT doc_id, {t} AS ct FROM {src}),
{prefix}_t AS (SELECT doc_id, unnest(toks) AS w, unnest(range(len(toks))) AS pos
      FROM (SELECT doc_id, list_filter(string_split(ct, ' '), lambda x: x <> '') AS toks FROM {prefix}_c)),
{prefix}_f AS (SELECT t.doc_id, t.pos, t.w, (sw.word IS NOT NULL) AS is_stop
      FROM {prefix}_t t LEFT JOIN {_stop_values(stop)} ON t.w = sw.word),
{prefix}_g AS (SELECT *, sum(is_stop::INT) OVER (PARTITION BY doc_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS pid FROM {prefix}_f),
{prefix}_l AS (SELECT *, count(*) OVER (PARTITION BY doc_id, pid) AS plen FROM {prefix}_g WHERE NOT is_stop),
{prefix}_d AS (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS freq,
      sum(plen) OVER (PARTITION BY doc_id, w) AS deg FROM {prefix}_l),
{prefix}_p AS (SELECT doc_id, pid, {K.pyround('sum(deg::DOUBLE / freq::DOUBLE)', 6)} AS score,
      string_agg(w, ' ' ORDER BY pos) AS phrase FROM {prefix}_d GROUP BY doc_id, pid),
{prefix}_r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, phrase DESC) AS rn FROM {prefix}_p),
{prefix}_kw AS (SELECT s.doc_id, coalesce(string_agg(r.phrase, ',' ORDER BY r.rn), '') AS keywords
      FROM {src} s LEFT JOIN {prefix}_r r ON s.doc_id = r.doc_id AND r.rn <= {n} GROUP BY s.doc_id)"""


@register("keywords_rake", f"WITH {rake_ctes()} SELECT doc_id, keywords FROM rk_kw")
def keywords_rake(spark, base):
    r = KO.keywords_rake(_docs(spark, base), PR.STOP_WORDS_20)
    return r.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def k4_sql(list_expr, stop=PR.STOP_WORDS_20, cap=L.KEYWORDS_CAP):
    """DuckDB K4 over a VARCHAR[] expression -> VARCHAR[]."""
    stop_list = "[" + ", ".join(K.q(w) for w in sorted(set(stop))) + "]"
    cleaned = (f"list_transform(list_filter({list_expr}, lambda p: length(p) >= {L.KEYWORD_MIN_CHARS}), "
               f"lambda p: array_to_string(list_filter(regexp_split_to_array(p, '[{T.WS}]+'), "
               f"lambda w: w <> '' AND NOT list_contains({stop_list}, w)), ' '))")
    uniq = f"list_distinct(list_filter({cleaned}, lambda p: p <> ''))"
    # order by (length desc, text asc): sort by a composite key string
    return (f"list_transform(list_sort(list_transform({uniq}, lambda p: {{'k': -length(p), 'p': p}})), "
            f"lambda s: s.p)[1:{cap}]")


@register("keywords_postprocess", f"""
WITH {rake_ctes(n=25)}
SELECT doc_id, array_to_string({k4_sql("list_filter(string_split(keywords, ','), lambda x: x <> '')")}, ',') AS keywords
FROM rk_kw""")
def keywords_postprocess(spark, base):
    r = KO.keywords_rake(_docs(spark, base), PR.STOP_WORDS_20, top_n=25)
    r = KO.postprocess(r, "keywords", PR.STOP_WORDS_20)
    return r.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


# --------------------------------------------------------------- K3 / K5

def _vectors(spark, base):
    emb = read_table(spark, base, "embeddings")
    return emb.select(F.col("vec_id").alias("key"), F.col("embedding").alias("vec")), emb.count()


def k3_ctes(src="documents", text="text", stop=PR.STOP_WORDS_20, n=10, prefix="k3"):
    stop_list = "[" + ", ".join(K.q(w) for w in sorted(set(stop))) + "]"
    return f"""
{prefix}_c AS (SELECT doc_id, {K.clean_keywords(text)} AS ct FROM {src}),
{prefix}_t AS (SELECT doc_id, w, count(*) AS n FROM (SELECT doc_id,
      unnest(list_filter(string_split(ct, ' '), lambda x: x <> '')) AS w FROM {prefix}_c) GROUP BY doc_id, w),
{prefix}_v AS (SELECT t.doc_id, t.w, t.n, e.embedding::DOUBLE[] AS vec FROM {prefix}_t t JOIN embeddings e
      ON e.vec_id = ('0x' || substr(md5(t.w), 1, 8))::BIGINT % (SELECT count(*) FROM embeddings)),
{prefix}_dv AS (SELECT doc_id, list(s ORDER BY k) AS dvec FROM (SELECT doc_id, k, sum(n * x) AS s FROM
      (SELECT doc_id, n, unnest(vec) AS x, unnest(range(len(vec))) AS k FROM {prefix}_v) GROUP BY doc_id, k)
      GROUP BY doc_id),
{prefix}_s AS (SELECT v.doc_id, v.w, {K.pyround('list_dot_product(v.vec, d.dvec) / (sqrt(list_dot_product(v.vec, v.vec)) * sqrt(list_dot_product(d.dvec, d.dvec)))', 6)} AS score
      FROM {prefix}_v v JOIN {prefix}_dv d ON v.doc_id = d.doc_id
      WHERE length(v.w) >= 2 AND NOT list_contains({stop_list}, v.w)),
{prefix}_r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, w) AS rn FROM {prefix}_s),
{prefix}_kw AS (SELECT s.doc_id, coalesce(string_agg(r.w, ',' ORDER BY r.rn), '') AS keywords
      FROM {src} s LEFT JOIN {prefix}_r r ON s.doc_id = r.doc_id AND r.rn <= {n} GROUP BY s.doc_id)"""


@register("keywords_embedding", f"WITH {k3_ctes()} SELECT doc_id, keywords FROM k3_kw")
def keywords_embedding(spark, base):
    vec, n = _vectors(spark, base)
    r = KO.keywords_embedding(_docs(spark, base), vec, PR.STOP_WORDS_20,
                              key=lambda w: KO.hashed_vector_key(w, n))
    return r.select("doc_id", F.array_join("keywords", ",").alias("keywords"))


def k5_sql(src="documents", text="text"):
    live = f"(SELECT doc_id, {text} AS text FROM {src} WHERE length(coalesce({text}, '')) >= {L.GUARD_KEYWORDS_MIN})"
    return f"""WITH lv AS {live}, {k3_ctes('lv', 'text')}, {rake_ctes('lv', 'text')},
pick AS (SELECT a.doc_id, CASE WHEN a.keywords <> '' THEN a.keywords ELSE b.keywords END AS kw
         FROM k3_kw a JOIN rk_kw b ON a.doc_id = b.doc_id),
pp AS (SELECT doc_id, array_to_string({k4_sql("list_filter(string_split(kw, ','), lambda x: x <> '')")}, ',') AS keywords FROM pick)
SELECT s.doc_id, coalesce(pp.keywords, '') AS keywords FROM {src} s LEFT JOIN pp ON s.doc_id = pp.doc_id"""


@register("extract_keywords", k5_sql())
def extract_keywords(spark, base):
    vec, n = _vectors(spark, base)
    r = KO.extract_keywords(_docs(spark, base), vec, PR.STOP_WORDS_20, key=lambda w: KO.hashed_vector_key(w, n))
    return r.select("doc_id", F.array_join("keywords", ",").alias("keywords"))
