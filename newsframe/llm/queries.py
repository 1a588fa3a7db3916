"""Registered queries of the training-data operators, one per operator, each
over its whole table, and their SQL for DuckDB where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe.llm import (alignment, layout, licenses, minhash, packing, periodic, pieces, quality, secrets, topk, toxicity,
                           urlrules, warc)
from newsframe.sources.tables import read_table


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(read_table(spark, sf_dir, "documents"))


OP1_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, [x FOR x IN regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+') IF x <> ''] AS ws FROM documents),
sh AS (SELECT doc_id, list_distinct(CASE WHEN ws IS NULL OR len(ws) = 0 THEN []::VARCHAR[]
  WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
  ELSE [array_to_string(ws[i:i + 4], ' ') FOR i IN range(1, len(ws) - 3)] END) AS s FROM w),
n AS (SELECT doc_id, len(s) AS n FROM sh),
x AS (SELECT doc_id, unnest(s) AS g FROM sh),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM x a JOIN x b USING (g) WHERE a.doc_id <> b.doc_id
  GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b
  WHERE 100 * c >= 75 * (na.n + nb.n - c)),
reach AS (SELECT doc_id AS node, doc_id AS start FROM n UNION
  SELECT links.b, reach.start FROM reach JOIN links ON links.a = reach.node),
comp AS (SELECT node, min(start) AS component_id FROM reach GROUP BY node)
SELECT doc_id, n AS n_shingles, component_id, doc_id = component_id AS kept FROM n JOIN comp ON node = doc_id
"""


def op2_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"))


def op3_sentencepiece_dropout(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return pieces.round_trip(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"),
                             seed=1, dropout=0.1)


def op4_layout_rendering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.rendered(read_table(spark, sf_dir, "pages"))


def op5_url_association_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urlrules.judge(read_table(spark, sf_dir, "pages"))


def op6_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_best_two_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(read_table(spark, sf_dir, "embeddings"), F.col("id") % 20 == 0)


OP8_SQL = r"""
WITH e AS (SELECT vec_id, min([CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding]) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id,
    CAST(list_dot_product(CAST(q.v AS DOUBLE[]), CAST(c.v AS DOUBLE[])) AS BIGINT) AS score
  FROM e q JOIN e c ON c.vec_id <> q.vec_id AND len(c.v) = len(q.v) WHERE q.vec_id % 20 = 0),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
    vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def op9_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op10_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(read_table(spark, sf_dir, "pages"))


OP10_SQL = r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, octet_length(encode(body)) AS payload_bytes, sha1(body) AS payload_digest FROM p),
r AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS last FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> last THEN last END AS refers_to FROM r
"""


def op11_license_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.labelled(read_table(spark, sf_dir, "documents"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return alignment.align_digest(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"),
                                  public_tokenizers.path("piece_bpe_32k.model"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.digest(read_table(spark, sf_dir, "documents"))


_QUERIES = {f.__name__: f for f in (
    op1_minhash_near_dedup, op2_quality_divergence, op3_sentencepiece_dropout, op4_layout_rendering,
    op5_url_association_rules, op6_weak_toxicity, op7_best_two_fit_packing, op8_exact_top_k, op9_secret_forest,
    op10_warc_boundary_chain, op11_license_join, op12_tokenizer_alignment, op13_periodic_runs)}
_SQL = {"op1_minhash_near_dedup": OP1_SQL, "op8_exact_top_k": OP8_SQL, "op10_warc_boundary_chain": OP10_SQL,
        "op11_license_join": licenses.oracle()}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)
