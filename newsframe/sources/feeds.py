"""Feed sources (S2): RSS/Atom documents -> entry rows.

Feeds are read with Spark's XML source (``rowTag`` channel / feed), as files
(batch or stream) or from a column of XML strings (``from_xml``). Entries
keep their feed and position so "first" is well defined downstream."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import text as T

RSS_SCHEMA = ("title string, item array<struct<title:string, link:string, description:string, "
              "`content:encoded`:string, pubDate:string, guid:string>>")
ATOM_SCHEMA = ("title string, entry array<struct<title:string, link:array<struct<_href:string, _rel:string>>, "
               "summary:string, content:string, published:string, updated:string>>")


def read_rss(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    r = spark.readStream if stream else spark.read
    return (r.format("xml").option("rowTag", "channel").schema(RSS_SCHEMA).load(path)
            .withColumn("feed", F.input_file_name()))


def read_atom(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    r = spark.readStream if stream else spark.read
    return (r.format("xml").option("rowTag", "feed").schema(ATOM_SCHEMA).load(path)
            .withColumn("feed", F.input_file_name()))


def parse_rss_strings(df: DataFrame, xml_col: str = "xml", feed_col: str = "feed") -> DataFrame:
    """RSS channel documents held in a string column -> channel rows."""
    c = F.from_xml(F.col(xml_col), RSS_SCHEMA)
    return df.select(F.col(feed_col).alias("feed"), c.alias("_c")).select("feed", "_c.*")


def published_ts(raw: Column) -> Column:
    """RFC-822 dates ('Tue, 22 Jul 2025 10:00:00 +0000') and ISO-8601
    (Atom) -> TIMESTAMP; NULL when unparsable (the raw text is kept)."""
    rfc = F.try_to_timestamp(F.regexp_replace(raw, r"^[A-Za-z]{3},\s*", ""), F.lit("d MMM yyyy HH:mm:ss Z"))
    return F.coalesce(rfc, F.try_to_timestamp(raw))


def _first_text(first: Column, second: Column) -> Column:
    """The first text, or the second if that is null or empty ('' without both)."""
    return F.when(F.coalesce(first, F.lit("")) != "", first).otherwise(F.coalesce(second, F.lit("")))


def rss_entries(channels: DataFrame) -> DataFrame:
    """S2 for RSS: (feed, pos, title, link, summary, published, source,
    published_ts). Title trimmed (default ''), link default '', summary =
    C3 of the description, or of ``content:encoded`` if that is missing or empty,
    published raw (default ''), source = channel title (default 'Unknown')."""
    e = channels.select("feed", F.coalesce(F.col("title"), F.lit(L.FEED_SOURCE_DEFAULT)).alias("source"),
                        F.posexplode_outer("item").alias("pos", "it"))
    # not the inner form: it adds a filter on the items below, which parses the XML again
    return e.filter("pos IS NOT NULL").select(
        "feed", F.col("pos").cast("long").alias("pos"),
        T.strip(F.coalesce(F.col("it.title"), F.lit(""))).alias("title"),
        F.coalesce(F.col("it.link"), F.lit("")).alias("link"),
        T.clean_article_text(_first_text(F.col("it.description"), F.col("it.`content:encoded`"))).alias("summary"),
        F.coalesce(F.col("it.pubDate"), F.lit("")).alias("published"),
        "source", published_ts(F.col("it.pubDate")).alias("published_ts"))


def atom_entries(feeds: DataFrame) -> DataFrame:
    """S2 for Atom: as ``rss_entries``; summary falls back to the content. Of
    several links the first ``alternate`` one counts (that is also what a link
    without ``rel`` is), else the first."""
    e = feeds.select("feed", F.coalesce(F.col("title"), F.lit(L.FEED_SOURCE_DEFAULT)).alias("source"),
                     F.posexplode("entry").alias("pos", "it"))
    links = F.filter("it.link", lambda x: x["_href"].isNotNull())
    page = F.filter(links, lambda x: F.coalesce(x["_rel"], F.lit("alternate")) == "alternate")
    link = F.coalesce(F.try_element_at(page, F.lit(1))["_href"], F.try_element_at(links, F.lit(1))["_href"], F.lit(""))
    pub = F.coalesce(F.col("it.published"), F.col("it.updated"))
    return e.select(
        "feed", F.col("pos").cast("long").alias("pos"),
        T.strip(F.coalesce(F.col("it.title"), F.lit(""))).alias("title"),
        link.alias("link"),
        T.clean_article_text(_first_text(F.col("it.summary"), F.col("it.content"))).alias("summary"),
        F.coalesce(pub, F.lit("")).alias("published"), "source", published_ts(pub).alias("published_ts"))


def feed_entries(spark: SparkSession, paths: str | Sequence[str], fmt: str = "any", stream: bool = False) -> DataFrame:
    """S2 over one or several folders (or files) of feed documents. ``fmt``: 'rss',
    'atom', or 'any' for folders that hold both kinds (a document of one kind has no
    rows for the other's reader)."""
    if fmt not in ("rss", "atom", "any"):
        raise ValueError(f"unknown feed format {fmt!r}")
    parts = []
    for path in [paths] if isinstance(paths, str) else paths:
        if fmt != "atom":
            parts.append(rss_entries(read_rss(spark, path, stream)))
        if fmt != "rss":
            parts.append(atom_entries(read_atom(spark, path, stream)))
    return reduce(DataFrame.unionByName, parts)


def with_entry_id(entries: DataFrame, out: str = "entry_id") -> DataFrame:
    """Sortable entry id: feed name, then the zero-padded position, so
    comparing ids follows feed order and entry order (no global window). A
    hash of the entry tells apart channels that share a file."""
    own = F.hex(F.xxhash64("source", "title", "link", "summary", "published"))
    return entries.withColumn(out, F.concat(F.col("feed"), F.lit("#"), F.lpad(F.col("pos").cast("string"), 9, "0"),
                                            F.lit("#"), own))
