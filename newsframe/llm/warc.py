"""WARC archives: writer and reader (operator 10).

The writer builds one record per row with column functions and stores the
archives with Spark's text writer, whose line separator is the blank lines
that end a record.

The reader lets Spark cut the archives at the version line (``WARC/1.1``) in
parallel byte ranges. That line may also occur inside a payload, so every cut
is only a candidate record. Each candidate states its successor's offset
(header length + Content-Length + 4). The boundary chain from the start of
the file decides: candidates are joined into runs inside each byte range, and
pointer jumping over the runs (the jump length doubles per round) keeps the
records that the chain from offset 0 reaches. Offsets come from prefix sums
of segment sizes, first inside a byte range, then over a file's ranges, so
no task needs a whole file.

Defined cases: null html is an empty payload; null urls have no target
line; null ids are written as ``null`` and read back as null; rows that
repeat an id are separate records (of equal payloads, all rows with the
largest id are responses). Empty tables give empty archives.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from newsframe.session import checkpoint_path, written_table

MAGIC = "WARC/1.1\r\n"
END = "\r\n\r\n"
REVISIT_MIN_BYTES = 1000
RECORD_DATE = "2000-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---------------------------------------------------------------- writing

def records(pages: DataFrame, min_bytes: int = REVISIT_MIN_BYTES) -> DataFrame:
    """One row per page with its record type and, for revisits, the response
    it refers to: (page_id, url, body, payload_bytes, payload_digest,
    record_type, refers_to)."""
    body = F.coalesce(F.col("html").cast("string"), F.lit(""))
    p = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                     body.alias("body"), F.octet_length(body).cast("long").alias("payload_bytes"),
                     F.sha1(body).alias("payload_digest"))
    # Only payloads that several rows share are joined back; the written table
    # has a known size, so a small one is broadcast and the pages stay put.
    shared = written_table(
        p.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
         .agg(F.max("page_id").alias("response_id"), F.count("*").alias("n"))
         .where(F.col("n") > 1).drop("n"), "warc-shared")
    p = p.join(shared, "payload_digest", "left")
    revisit = (F.col("payload_bytes") >= min_bytes) & F.col("response_id").isNotNull() \
        & ~F.col("page_id").eqNullSafe(F.col("response_id"))
    return (p.withColumn("record_type", F.when(revisit, "revisit").otherwise("response"))
             .withColumn("refers_to", F.when(revisit, F.col("response_id"))).drop("response_id"))


def _urn(page_id: Column) -> Column:
    return F.concat(F.lit("<urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null")), F.lit(">"))


def record_text(r: DataFrame) -> Column:
    """The record up to, but without, the blank lines that end it."""
    def line(name, value):
        return F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))

    revisit = F.col("record_type") == "revisit"
    uri = F.regexp_replace("url", r"[\x00-\x20\x7f]", "%20")
    return F.concat(
        F.lit(MAGIC),
        line("WARC-Type", F.col("record_type")),
        line("WARC-Record-ID", _urn(F.col("page_id"))),
        line("WARC-Date", F.lit(RECORD_DATE)),
        F.coalesce(line("WARC-Target-URI", uri), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("payload_digest"))),
        line("WARC-Payload-Length", F.col("payload_bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)),
                                 line("WARC-Refers-To", _urn(F.col("refers_to"))))).otherwise(""),
        line("Content-Type", F.lit("text/html; charset=utf-8")),
        line("Content-Length", F.when(revisit, "0").otherwise(F.col("payload_bytes").cast("string"))),
        F.lit("\r\n"), F.when(revisit, "").otherwise(F.col("body")))


def write_archives(pages: DataFrame, path: str, min_bytes: int = REVISIT_MIN_BYTES) -> None:
    """Write the pages as WARC files (one per task) under ``path``."""
    r = records(pages, min_bytes)
    r.select(record_text(r).alias("value")).write.option("lineSep", END).text(path)


# ---------------------------------------------------------------- reading

def segments(spark: SparkSession, path: str) -> DataFrame:
    """The archives cut at the version line, in order inside each byte range:
    (file, block, seq, n, value). ``value`` starts after the version line."""
    return (spark.read.option("lineSep", MAGIC).text(path)
            .select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
                    F.monotonically_increasing_id().alias("seq"),
                    F.octet_length("value").cast("long").alias("n"), "value"))


def located(segs: DataFrame) -> DataFrame:
    """Adds ``off``, the byte offset of each segment's version line: size sums
    inside a range, plus the sizes of the file's earlier ranges. The text
    before a file's first version line is dropped."""
    size = F.col("n") + len(MAGIC)
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    base = (segs.groupBy("file", "block").agg(F.sum(size).alias("size"))
                .select("file", "block", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("base")))
    inside = Window.partitionBy("file", "block").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    at = F.coalesce(F.sum(size).over(inside), F.lit(0)).alias("inside")
    return (segs.select("*", at).join(base, ["file", "block"])
                .withColumn("off", F.col("base") + F.col("inside") - len(MAGIC))
                .where("off >= 0").drop("base", "inside", "seq"))


def _field(head: Column, name: str, pattern: str) -> Column:
    got = F.regexp_extract(head, rf"(?i)(?:^|\n){name}:[ \t]*{pattern}", 1)
    return F.when(got != "", got)


def candidates(segs: DataFrame) -> DataFrame:
    """Header fields of each segment and the size it claims. ``whole``: the
    segment holds the whole payload; ``sha1`` is then the payload's digest."""
    head = F.substring_index("value", END, 1)
    c = segs.withColumn("head", head).withColumn("hb", F.octet_length("head") + len(END))
    length = _field(F.col("head"), "Content-Length", r"(\d{1,18})").cast("long")
    c = c.withColumn("length", F.when(F.col("hb") <= F.col("n"), length))
    c = c.withColumn("whole", F.coalesce(F.col("hb") + F.col("length") <= F.col("n"), F.lit(False)))
    payload = F.expr("substring(cast(value AS binary), hb + 1, cast(length AS int))")
    return c.select(
        "file", "block", "seq", "n", "length", "whole", "hb",
        (F.lit(len(MAGIC)) + F.col("hb") + F.col("length") + len(END)).alias("claims"),
        F.when(F.col("whole"), F.sha1(payload)).alias("sha1"),
        _field(F.col("head"), "WARC-Type", r"(\w+)").alias("record_type"),
        _field(F.col("head"), "WARC-Record-ID", r"<urn:page:(-?\d+)>").cast("long").alias("page_id"),
        _field(F.col("head"), "WARC-Refers-To", r"<urn:page:(-?\d+)>").cast("long").alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest", r"sha1:(\w+)").alias("stated_digest"),
        _field(F.col("head"), "WARC-Payload-Length", r"(\d{1,18})").cast("long").alias("stated_length"))


def reachable(c: DataFrame) -> DataFrame:
    """The candidates that the boundary chain from the file start reaches.

    ``c``: (file, block, off, claims, ...). A run is a maximal sequence of
    candidates of one byte range in which each is the successor of the one
    before and the target of no other; runs are entered at their head only."""
    c = c.withColumn("succ", F.col("off") + F.col("claims"))
    w = Window.partitionBy("file", "block").orderBy("off")
    c = c.withColumn("prev", F.lag("succ").over(w)).withColumn("next", F.lead("off").over(w))
    jumps = (c.where("succ IS NOT NULL AND (next IS NULL OR succ <> next)")
              .select("file", F.col("succ").alias("off"), F.lit(True).alias("aimed")).distinct())
    c = c.join(jumps, ["file", "off"], "left")
    head = F.coalesce("aimed", F.lit(False)) | F.col("prev").isNull() | (F.col("prev") != F.col("off"))
    c = c.withColumn("run", F.max(F.when(head, F.col("off"))).over(w))
    c = written_table(c.drop("prev", "next", "aimed"), "warc-runs")
    runs = c.groupBy("file", "run").agg(F.max_by("succ", "off").alias("to"))
    jump = written_table(runs, "warc-jump")
    reached = jump.where("run = 0").select("file", "run")
    total, known = jump.count(), reached.count()
    while 0 < known < total:
        # reached runs step along the current jump; then every jump doubles
        stepped = (reached.join(jump, ["file", "run"]).select("file", F.col("to").alias("run"))
                          .join(runs.select("file", "run"), ["file", "run"], "left_semi"))
        reached = written_table(reached.union(stepped).distinct(), "warc-reached")
        now = reached.count()
        if now == known:
            break
        known = now
        nxt = jump.select("file", F.col("run").alias("to"), F.col("to").alias("to2"))
        jump = written_table(jump.join(nxt, ["file", "to"]).select("file", "run", F.col("to2").alias("to")),
                             "warc-jump")
    return c.join(reached, ["file", "run"], "left_semi")


def _rejoined(spark: SparkSession, path: str, chain: DataFrame, c: DataFrame) -> DataFrame:
    """Digests of reached records whose payload holds version lines: their
    segments are read again and put together. (file, off, sha1)"""
    broken = chain.where("NOT whole").select("file", "off", "hb", "length")
    files = written_table(broken.select("file").distinct(), "warc-broken")
    raw = _with_offsets(written_table(segments(spark, path).join(files, "file", "left_semi")
                                      .withColumn("value", F.col("value").cast("binary")), "warc-raw"))
    owner = (c.join(files, "file", "left_semi").select("file", "off")
              .join(chain.select("file", "off", F.col("off").alias("own")), ["file", "off"], "left"))
    w = Window.partitionBy("file").orderBy("off").rowsBetween(Window.unboundedPreceding, 0)
    owner = owner.select("file", "off", F.last("own", ignorenulls=True).over(w).alias("own"))
    parts = owner.join(broken.select("file", F.col("off").alias("own"), "hb", "length"), ["file", "own"])
    parts = parts.join(raw, ["file", "off"])
    whole = (parts.groupBy("file", "own", "hb", "length")
             .agg(F.array_sort(F.collect_list(F.struct("off", "value"))).alias("parts"))
             .withColumn("bytes", F.aggregate(
                 "parts", F.lit(b""),
                 lambda acc, x: F.when(F.octet_length(acc) == 0, x["value"])
                                 .otherwise(F.concat(acc, F.lit(MAGIC.encode()), x["value"])))))
    payload = F.expr("substring(bytes, hb + 1, cast(length AS int))")
    return whole.select("file", F.col("own").alias("off"), F.sha1(payload).alias("rejoined"))


def _with_offsets(raw: DataFrame) -> DataFrame:
    """``located`` for segments that still carry their bytes: offsets are
    computed on the narrow columns and joined to the bytes by position."""
    spots = located(raw.select("file", "block", "seq", "n", F.col("seq").alias("at")))
    return (raw.withColumnRenamed("seq", "at").select("file", "block", "at", "value")
               .join(spots.select("file", "block", "at", "off"), ["file", "block", "at"])
               .select("file", "off", "value"))


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """The records of the archives: (file, off, page_id, payload_bytes,
    payload_digest, record_type, refers_to). A response's digest is computed
    from its payload; a revisit states the digest of the payload it shares."""
    segs = written_table(candidates(segments(spark, path)), "warc-segments")
    c = located(segs)
    chain = reachable(c.where("claims IS NOT NULL"))
    chain = chain.where("record_type IS NOT NULL")
    if chain.where("NOT whole").isEmpty():
        chain = chain.withColumn("rejoined", F.lit(None).cast("string"))
    else:
        chain = chain.join(_rejoined(spark, path, chain, c), ["file", "off"], "left")
    revisit = F.col("record_type") == "revisit"
    return chain.select(
        "file", "off", "page_id",
        F.when(revisit, F.col("stated_length")).otherwise(F.col("length")).alias("payload_bytes"),
        F.when(revisit, F.col("stated_digest")).otherwise(F.coalesce("sha1", "rejoined")).alias("payload_digest"),
        "record_type", "refers_to")


def archive_round_trip(pages: DataFrame, path: str | None = None) -> DataFrame:
    """Write the pages as archives in the shared folder and read them back."""
    spark = pages.sparkSession
    path = path or checkpoint_path(spark, f"newsframe-warc-{uuid.uuid4().hex}")
    write_archives(pages, path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
