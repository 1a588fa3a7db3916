"""Corpus pipeline: from ``documents`` to packed training sequences.

1. toxicity: documents predicted toxic go;
2. quality: documents that the quality rules reject go;
3. near duplicates: the smallest document of each group stays;
4. secrets: confirmed secrets are replaced in the texts, all documents stay;
5. packing: the texts become pieces of sequences.

Each stage takes (spark, docs, sf_dir) and works on all that the one before
kept; its result is written as Parquet and read again. All but the last keep
the columns of ``documents``. A verdict goes by a row's id and text, so rows of
null and repeated ids are judged one by one; of rows that repeat both, the near
duplicates leave one. Null and empty texts and empty tables are treated as each
operator's docstring says.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from newsframe.llm import minhash, packing, quality, secrets, toxicity
from newsframe.session import written_table
from newsframe.sources.tables import read_table


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.accepted(docs, read_table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.accepted(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return minhash.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redacted(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("toxicity", toxic), ("quality", quality_rules), ("near_duplicates", near_duplicates),
          ("secrets", secret_scan), ("packing", packed)]

#: The trained and hashed stages cannot be told in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; the packed pieces."""
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written_table(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
