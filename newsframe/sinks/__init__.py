"""Writers (W1-W7). All append; each adds the write time. Array columns are
joined with ',' where the format cannot hold arrays (CSV, text tables)."""

from __future__ import annotations

import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from newsframe.session import written_table

COMMITS = "_commits"        # beside the partitions; readers skip names that begin so


def with_timestamp(df: DataFrame, col: str = "timestamp") -> DataFrame:
    return df.withColumn(col, F.current_timestamp())


def flatten_arrays(df: DataFrame, sep: str = ",") -> DataFrame:
    """Join every array<string> column with ``sep`` (the stored keyword form)."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, ArrayType):
            cols.append(F.array_join(F.col(f.name).cast("array<string>"), sep).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


def sink_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object per line, appended, with a UTC ``timestamp``."""
    with_timestamp(df).write.mode("append").json(path)


def sink_csv(df: DataFrame, path: str) -> None:
    """CSV with header, appended; arrays joined with ','."""
    flatten_arrays(with_timestamp(df)).write.mode("append").option("header", True).csv(path)


def sink_table_articles(df: DataFrame, path: str | None = None, table: str | None = None) -> None:
    """Append (summary, credibility, keywords joined with ',', timestamp)."""
    out = flatten_arrays(with_timestamp(df.select("summary", "credibility", "keywords")))
    w = out.write.mode("append")
    w.saveAsTable(table) if table else w.parquet(path)


def summary_records(df: DataFrame, run_id: str | None = None) -> DataFrame:
    """Add a generated text id and the creation time (W4 record shape). With a
    ``run_id`` the id is a hash of it, the record and (for equal records) their
    number, so a repeated run generates the same ids."""
    if run_id is None:
        return df.withColumn("id", F.expr("uuid()")).withColumn("created_at", F.current_timestamp())
    own = F.sha2(F.to_json(F.struct(*df.columns)), 256)
    n = F.row_number().over(Window.partitionBy("_own").orderBy("_own"))
    h = F.md5(F.concat_ws("/", F.lit(run_id), "_own", n.cast("string")))
    return df.withColumn("_own", own).withColumn("id", h).drop("_own").withColumn("created_at", F.current_timestamp())


# ---------------------------------------------------- stored once

def _stored(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.option("basePath", path).parquet(path)
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def committed(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the runs that ``append_once`` has committed under ``path``."""
    runs = spark.read.schema("run_id string, stored_rows long").json(f"{path}/{COMMITS}/*")
    return spark.read.option("basePath", path).parquet(path).withColumn("run_id", F.col("run_id").cast("string")).join(
        F.broadcast(runs.select("run_id").distinct()), "run_id", "left_semi").drop("run_id")


def append_once(df: DataFrame, path: str, run_id: str, id_col: str = "id") -> int:
    """Append ``df`` as the partition of its run, so that a job that is repeated with
    the same ``run_id`` stores nothing twice; returns the number of rows stored.

    Rows whose id a committed run has already stored are left out (anti-join on the
    id). Ids repeated within ``df`` are refused, and so are ids that another,
    unfinished run has written: each run writes its rows first and looks for the
    others' afterwards, so of two concurrent runs at least one sees the other. Only a
    run with a commit record counts (see ``committed``), so a refused or broken run leaves nothing
    visible, and its repetition replaces its own partition."""
    spark = df.sparkSession
    if not re.fullmatch(r"[A-Za-z0-9_.-]+", run_id):
        raise ValueError(f"run id {run_id!r}: letters, digits, _ . - only")
    done = _commits(spark, path)
    before = _stored(spark, path)
    new = df
    if before is not None and done:
        old = committed(spark, path) if run_id not in done else before.filter(F.col("run_id") != run_id)
        new = df.join(old.select(id_col).distinct(), id_col, "left_anti")
    new = written_table(new.withColumn("run_id", F.lit(run_id)), "append")
    if not duplicate_ids(new, id_col).isEmpty():
        raise ValueError(f"repeated {id_col} in the rows of run {run_id!r}")
    (new.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("run_id").parquet(path))
    others = spark.read.option("basePath", path).parquet(path).filter(F.col("run_id").cast("string") != run_id)
    if not new.join(others.select(id_col), id_col, "left_semi").isEmpty():
        raise ValueError(f"another run has written some {id_col} of run {run_id!r}")
    n = new.count()
    spark.createDataFrame([(run_id, n)], "run_id string, stored_rows long").coalesce(1).write.mode("overwrite").json(
        f"{path}/{COMMITS}/{run_id}")
    return n


def _commits(spark: SparkSession, path: str) -> set[str]:
    """Run ids with a commit record (one small row per run)."""
    try:
        rows = spark.read.schema("run_id string, stored_rows long").json(f"{path}/{COMMITS}/*").select("run_id").distinct()
        return {r["run_id"] for r in rows.collect()}
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return set()


def sink_articles_once(df: DataFrame, path: str, run_id: str, id_col: str = "url") -> int:
    """W3, stored once: (id, summary, credibility, keywords, timestamp)."""
    return append_once(flatten_arrays(with_timestamp(df.select(id_col, "summary", "credibility", "keywords"))), path,
                       run_id, id_col)


def sink_summaries_once(df: DataFrame, path: str, run_id: str) -> int:
    """W4, stored once: ids follow from the run and the record."""
    out = summary_records(df.select("summary", "credibility", "keywords"), run_id)
    return append_once(flatten_arrays(out.select("id", "summary", "credibility", "keywords", "created_at")), path, run_id)


def sink_table_summaries(df: DataFrame, path: str | None = None, table: str | None = None) -> None:
    """Append (id, summary, credibility, keywords, created_at) with a
    generated unique id."""
    out = flatten_arrays(summary_records(df).select("id", "summary", "credibility", "keywords", "created_at"))
    w = out.write.mode("append")
    w.saveAsTable(table) if table else w.parquet(path)


def duplicate_ids(stored: DataFrame, id_col: str = "id") -> DataFrame:
    """Ids stored more than once (should be empty)."""
    return stored.groupBy(id_col).count().filter(F.col("count") > 1)


def report_text(id_c: Column, created: Column, summary: Column, cred: Column, keywords: Column) -> Column:
    """W6 block: five lines and a blank line; credibility with 2 decimals,
    keywords joined with ', '."""
    return F.format_string(
        "=== Summary ID: %s ===\nCreated At: %s\nSummary: %s\nCredibility Score: %.2f\nKeywords: %s\n",
        id_c, created, summary, cred, F.array_join(keywords, ", "))


def sink_text_report(df: DataFrame, path: str, id_col: str = "id", time_col: str = "created_at") -> None:
    """The formatted blocks appended as text."""
    df.select(report_text(F.col(id_col).cast("string"), F.col(time_col).cast("string"), F.col("summary"),
                          F.col("credibility"), F.col("keywords")).alias("value")).write.mode("append").text(path)


#: Modes of the analysis service and of the command line, and further ones for both.
SINKS = {"json": sink_jsonl, "jsonl": sink_jsonl, "csv": sink_csv, "db": sink_table_articles,
         "table": sink_table_articles, "summaries": sink_table_summaries, "txt": sink_text_report}
FAMILIES = {"api": SINKS, "cli": {"db": sink_table_summaries, "json": sink_jsonl, "txt": sink_text_report}}
#: Modes that need a data source of another package on the class path.
FORMATS = {"mongo": "mongodb"}


def sink_router(df: DataFrame, mode: str, path: str, family: str = "api", **options) -> None:
    """Dispatch by mode; ``format:<name>`` writes with any Spark data
    source, and ``mongo`` with the one of that store. ``db`` holds articles for the
    service (``family="api"``) and summary records for the command line
    (``family="cli"``), which knows db, json and txt only. An unknown mode raises and
    writes nothing. (The one-file JSON array of the command line is re-aimed to ``json`` lines:
    rewriting one file per record does not distribute.)"""
    if family not in FAMILIES:
        raise ValueError(f"unknown family {family!r}")
    if mode.startswith("format:"):
        with_timestamp(df).write.mode("append").format(mode.split(":", 1)[1]).options(**options).save(path)
        return
    if family == "api" and mode in FORMATS:
        try:
            with_timestamp(df).write.mode("append").format(FORMATS[mode]).options(**options).save(path)
        except Exception as e:
            if "DATA_SOURCE_NOT_FOUND" not in str(e):
                raise
            raise ValueError(f"storage mode {mode!r} needs the data source {FORMATS[mode]!r} on the class path") from e
        return
    fn = FAMILIES[family].get(mode)
    if fn is None:
        raise ValueError(f"unknown storage mode {mode!r}")
    fn(df, path)
