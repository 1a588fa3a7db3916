"""Token frames (C6) and the document-local layout used by lexicon operators.

``by_document`` hash-partitions a narrow (id, text) frame on the document id
once. Every later window, aggregate and join keyed by (id, ...) is then
satisfied by that partitioning and needs no further exchange, and exploded
token rows never cross the network."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.functions.text import tokens


#: Input bytes (as stored) that one part of ``by_document`` is meant for.
PART_BYTES = 4 << 20
UNKNOWN_BYTES = 1 << 62     # Spark's default size of a relation is larger


def input_bytes(df: DataFrame) -> int:
    """Stored size of the tables that ``df`` reads, from the plan's statistics;
    relations of unknown size count as nothing."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    sizes = [int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size())]
    return sum(s for s in sizes if s < UNKNOWN_BYTES)


def document_parts(df: DataFrame) -> int:
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200"))
    return max(least, -(-input_bytes(df) // PART_BYTES))


def by_document(df: DataFrame, id_col: str = "doc_id", partitions: int | None = None) -> DataFrame:
    """Hash-partition on the id into ``partitions`` parts: by default one per
    ``PART_BYTES`` of input, and no fewer than ``spark.sql.shuffle.partitions``.
    The count is given explicitly so adaptive execution does not merge
    partitions: on small inputs the per-document work after the shuffle is heavy
    beside its bytes, so it needs the tasks."""
    return df.repartition(partitions or document_parts(df), id_col)


def tokenize(df: DataFrame, text_col: str = "text", id_col: str = "doc_id",
             pos_col: str = "pos", token_col: str = "token") -> DataFrame:
    """One row per token (lower-cased ``[\\p{L}\\p{N}_]+`` runs) with its
    0-based position."""
    return df.select(id_col, F.posexplode(tokens(text_col)).alias(pos_col, token_col))
