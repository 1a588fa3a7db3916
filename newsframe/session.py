"""Session helpers: building a session for tests/bench, checkpoint folder,
and size-checked broadcast."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Largest lookup table (rows) that operators will hint for broadcast.
# Lexicons, stop lists and rule tables are small by construction; anything
# bigger is joined by shuffle and AQE may still pick a broadcast at runtime
# from measured sizes.
BROADCAST_MAX_ROWS = 200_000

# Most bytes of rows that go to a Python worker at once. The session's own bound
# may be lower, and is then kept.
BATCH_BYTES_CONF = "spark.sql.execution.arrow.maxBytesPerBatch"
BATCH_BYTES = 4 << 20


def build_session(master: str | None = None, shuffle_partitions: int = 8,
                  app: str = "newsframe") -> SparkSession:
    """Session for tests and the benchmark. On a cluster the caller's own
    session is used and nothing here is needed."""
    master = master or os.environ.get("NEWSFRAME_MASTER", "local[8]")
    spark = (
        SparkSession.builder.master(master).appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("NEWSFRAME_DRIVER_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Return the cluster's shared checkpoint folder (``spark.checkpoint.dir``).

    Only a local session (tests) without one gets a scratch folder; on a
    cluster a machine-local folder would be lost with its machine, so a
    missing setting is an error there."""
    sc = spark.sparkContext
    current = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if current:
        if not sc.getCheckpointDir():
            sc.setCheckpointDir(current)
        return current
    if not re.fullmatch(r"local(\[.*\])?", sc.master):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    path = tempfile.mkdtemp(prefix="newsframe-ckpt-")
    sc.setCheckpointDir(path)
    return path


def checkpoint_path(spark: SparkSession, name: str) -> str:
    """A sub-folder of the shared checkpoint folder, for written tables that
    cut lineage (streaming checkpoints, materialized intermediates)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    return f"{base}/{name}"


@contextmanager
def bounded_batches(spark: SparkSession) -> Iterator[None]:
    """Jobs started inside pass texts to Python in batches of BATCH_BYTES, so an
    executor holds a few MB of them per task however long the texts are."""
    old = spark.conf.get(BATCH_BYTES_CONF)
    if 0 < spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(old) <= BATCH_BYTES:
        yield
        return
    spark.conf.set(BATCH_BYTES_CONF, str(BATCH_BYTES))
    try:
        yield
    finally:
        spark.conf.set(BATCH_BYTES_CONF, old)


def written_table(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it
    back: cuts lineage, survives lost executors, computes the input once and
    gives the planner true sizes."""
    spark = df.sparkSession
    path = checkpoint_path(spark, f"newsframe-{name}-{uuid.uuid4().hex}")
    with bounded_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_table(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS,
                known_rows: int | None = None) -> DataFrame:
    """Broadcast-hint ``df`` only after checking its row count.

    Used for lexicons, stop lists and rule tables. ``known_rows`` skips the
    count when the size is known on the driver (tables built from a Python
    list). Above the bound the table is returned unhinted and joins run as
    shuffle joins (AQE may still broadcast from measured sizes)."""
    n = known_rows if known_rows is not None else df.limit(max_rows + 1).count()
    return F.broadcast(df) if n <= max_rows else df
