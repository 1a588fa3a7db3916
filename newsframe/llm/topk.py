"""Exact top-k inner-product search (operator 8).

Queries and candidates are dealt into a grid of cells. A cell holds one
group of queries and one shard of candidates, both of bounded size, and
multiplies them tile by tile; each tile keeps only its k best candidates per
query (partial selection, no full sort). Cells emit at most k rows per query,
and the per-query lists are merged as a tree: first over groups of shards,
then over the groups.

Defined cases: vectors that are null, hold a null or a non-finite component,
or have a null id take no part. Rows that repeat an id count once (the
smallest vector). Ties go to the smaller id. Only vectors of equal length are
compared; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SHARD_ROWS = 8192     # candidates of one cell
QUERY_ROWS = 4096     # queries of one cell
TILE_QUERIES = 512    # queries multiplied at once
MERGE_FANIN = 32      # shard lists merged per tree node


def quantised(df: DataFrame, id_col: str, vec_col: str, scale: float) -> DataFrame:
    """(id, v): v = floor(scale * x) per component, as integers."""
    finite = F.forall(vec_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    v = F.transform(vec_col, lambda x: F.floor(x.cast("double") * F.lit(float(scale))))
    return (df.where(F.col(id_col).isNotNull() & F.col(vec_col).isNotNull() & finite)
              .groupBy(F.col(id_col).cast("long").alias("id")).agg(F.min(v).alias("v")))


def _matrix(t: pa.Table, id_name: str, vec_name: str, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of one cell side, ordered by id."""
    ids = t.column(id_name).to_numpy()
    col = t.column(vec_name).combine_chunks()
    if isinstance(col, pa.ChunkedArray):
        col = pa.concat_arrays(col.chunks)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return ids[order], flat.reshape(len(ids), dim)[order]


def _select(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best scores per row (ties: smaller column), best first."""
    n = scores.shape[1]
    if np.abs(scores[np.isfinite(scores)]).max(initial=0.0) * n < 2 ** 52:
        key = scores * n - np.arange(n)  # exact in doubles: score first, then column
        if k < n:
            part = np.argpartition(-key, k - 1, axis=1)[:, :k]
        else:
            part = np.broadcast_to(np.arange(n), scores.shape)
        order = np.argsort(-np.take_along_axis(key, part, 1), axis=1, kind="stable")
        return np.take_along_axis(part, order, 1)
    return np.argsort(-scores, axis=1, kind="stable")[:, :k]


def _cell(k: int):
    schema = pa.schema([("query_id", pa.int64()), ("g", pa.int32()), ("vec_id", pa.int64()), ("score", pa.int64())])

    def run(key, queries: pa.Table, shard: pa.Table) -> pa.Table:
        if not queries.num_rows or not shard.num_rows:
            return schema.empty_table()
        dim = key[2].as_py()
        qi, qv = _matrix(queries, "id", "v", dim)
        ci, cv = _matrix(shard, "cid", "cv", dim)
        bound = int(np.abs(qv).max(initial=0)) * int(np.abs(cv).max(initial=0)) * max(1, qv.shape[1])
        exact = bound < 2 ** 53  # double products are exact up to here
        left, right = (qv.astype(float), cv.astype(float).T) if exact else (qv, cv.T)
        out = []
        for a in range(0, len(qi), TILE_QUERIES):
            ids = qi[a:a + TILE_QUERIES]
            s = left[a:a + TILE_QUERIES] @ right
            at = np.minimum(np.searchsorted(ci, ids), len(ci) - 1)
            own = np.flatnonzero(ci[at] == ids)
            f = s.astype(float) if exact else s.astype(object)
            f[own, at[own]] = -math.inf
            if exact:
                best = _select(f, min(k, len(ci)))
            else:
                best = np.array([sorted(range(len(ci)), key=lambda j: (-r[j], j))[:k] for r in f])
            q = np.repeat(ids, best.shape[1])
            c = ci[best].ravel()
            keep = q != c
            out.append((q[keep], c[keep], np.take_along_axis(s, best, 1).ravel()[keep].astype(np.int64)))
        q, c, s = (np.concatenate(x) for x in zip(*out, strict=True))
        return pa.table([q, np.full(len(q), key[0].as_py(), np.int32), c, s], schema=schema)
    return run


def top_k(df: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vec_col: str = "embedding",
          scale: float = 64.0, shard_rows: int = SHARD_ROWS, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The k best candidates of every query row: (query_id, rank, vec_id, score).

    ``is_query`` is a condition on the column ``id``. Candidates are all rows
    but the query's own."""
    rows = quantised(df, id_col, vec_col, scale).withColumn("dim", F.size("v"))
    n = df.count()  # sizes the grid only
    nq = df.select(F.col(id_col).cast("long").alias("id")).where(is_query).count()
    shards, groups = max(1, math.ceil(n / shard_rows)), max(1, math.ceil(nq / query_rows))

    def deal(cells, salt):
        return F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(cells)).cast("int")

    def every(cells):
        return F.explode(F.sequence(F.lit(0), F.lit(cells - 1)))

    cand = rows.select(F.col("id").alias("cid"), F.col("v").alias("cv"), F.col("dim").alias("cdim"),
                       deal(shards, 1).alias("cg"), every(groups).alias("ch"))
    query = rows.where(is_query).select("id", "v", "dim", every(shards).alias("g"), deal(groups, 2).alias("h"))
    lists = (query.groupBy("g", "h", "dim").cogroup(cand.groupBy("cg", "ch", "cdim"))
                  .applyInArrow(_cell(k), "query_id long, g int, vec_id long, score long"))

    def merged(part, keys):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "vec_id")
        return part.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)

    if shards > MERGE_FANIN:
        lists = merged(lists.withColumn("node", F.floor(F.col("g") / MERGE_FANIN)), ["query_id", "node"])
    return merged(lists, ["query_id"]).select("query_id", "rank", "vec_id", "score")
