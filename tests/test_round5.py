"""Memory of an executor's Python workers: batches and caches stay bounded."""

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from newsframe.llm import common
from newsframe.session import BATCH_BYTES, BATCH_BYTES_CONF, written_table


def sizes(docs):
    """(size, n) of the batches that a written table passes to Python."""
    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.nbytes]), pa.array([b.num_rows])], names=["size", "n"])
    return written_table(docs.mapInArrow(run, "size long, n long"), "sizes").collect()


def test_texts_reach_python_in_batches_of_bounded_bytes(spark):
    old = spark.conf.get(BATCH_BYTES_CONF)
    docs = spark.range(60, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 50_000).alias("text"))
    got = sizes(docs)
    assert sum(r["n"] for r in got) == 60
    assert max(r["size"] for r in got) <= BATCH_BYTES + 600_000
    assert spark.conf.get(BATCH_BYTES_CONF) == old


def test_a_lower_bound_of_the_session_is_kept_and_a_failed_write_restores_it(spark):
    old = spark.conf.get(BATCH_BYTES_CONF)
    docs = spark.range(20, numPartitions=1).select("id", F.repeat(F.lit("0123456789"), 10_000).alias("text"))
    try:
        spark.conf.set(BATCH_BYTES_CONF, "1m")
        got = sizes(docs)
        assert max(r["size"] for r in got) <= 1_200_000 and sum(r["n"] for r in got) == 20
    finally:
        spark.conf.set(BATCH_BYTES_CONF, old)
    with pytest.raises(Exception):
        written_table(docs.select(F.raise_error(F.lit("no"))), "fails")
    assert spark.conf.get(BATCH_BYTES_CONF) == old


def test_a_stage_empties_the_caches_that_earlier_stages_left():
    left = common.worker_cache("packing")
    left["word"] = b"ids"
    list(common.chunks(iter([]), cache="packing"))
    assert left
    list(common.chunks(iter([])))
    assert not left
