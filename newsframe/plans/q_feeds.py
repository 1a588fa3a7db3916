"""Registered queries: feed ingest (S2) and batch ingest with duplicate
removal (P3). Feed documents are derived from the pages: each page becomes
an RSS channel (title = host) with one item (title = h1, link = URL,
description or content:encoded = the article markup, in turns, and a date that
comes from the id), serialized with ``to_xml`` and parsed
back with ``from_xml``, so the XML path is exercised on data that grows
with the tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe.functions import html as H
from newsframe.operators.dedup import drop_near_duplicates
from newsframe.plans import sqlkit as K
from newsframe.plans.q_dedup import tf_ctes
from newsframe.plans.q_html import _first_text_sql, s_drop_code, s_host
from newsframe.plans.q_store import FIRST_DAY
from newsframe.plans.registry import register
from newsframe.session import written_table
from newsframe.sources.feeds import parse_rss_strings, rss_entries
from newsframe.sources.tables import read_table


CONTENT = "content:encoded"


def feed_documents(pages):
    pages = pages.select("page_id", "url", H.drop_code("html").alias("html"))      # once for title and body
    body, odd = H.container("html", "article", cleaned=True), F.col("page_id") % 2 == 1
    when = F.date_format(F.to_utc_timestamp(F.timestamp_seconds(F.lit(FIRST_DAY) + F.col("page_id") * 3600),
                                            F.current_timezone()), "EEE, dd MMM yyyy HH:mm:ss")
    item = F.struct(H.first_element_text("html", "h1", cleaned=True).alias("title"), F.col("url").alias("link"),
                    F.when(~odd, body).alias("description"), F.when(odd, body).alias(CONTENT.replace(":", "_")),
                    F.concat(when, F.lit(" +0000")).alias("pubDate"), F.lit(None).cast("string").alias("guid"))
    ch = F.struct(H.url_host("url").alias("title"), F.array(item).alias("item"))
    xml = F.to_xml(ch, {"rowTag": "channel"})      # writes no prefixed names
    return pages.select(F.format_string("page-%09d", F.col("page_id")).alias("feed"),
                        F.replace(xml, F.lit(CONTENT.replace(":", "_") + ">"), F.lit(CONTENT + ">")).alias("xml"))


def _entries(spark, base):
    return rss_entries(parse_rss_strings(feed_documents(read_table(spark, base, "pages"))))


_REGION = f"regexp_extract({s_drop_code('html')}, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)"
ENTRIES_SQL = f"""entries AS (SELECT 'page-' || lpad(page_id::VARCHAR, 9, '0') AS feed, 0::BIGINT AS pos,
  {K.strip(f"coalesce({_first_text_sql('h1')}, '')")} AS title, url AS link,
  SUMMARY_EXPR AS summary, strftime(to_timestamp({FIRST_DAY} + page_id * 3600) AT TIME ZONE 'UTC',
    '%a, %d %b %Y %H:%M:%S +0000') AS published, {FIRST_DAY} + page_id * 3600 AS published_s, {s_host('url')} AS source
  FROM pages)"""


def _entries_sql():
    from newsframe.plans.q_html import s_clean_html
    return ENTRIES_SQL.replace("SUMMARY_EXPR", K.normalize(s_clean_html(_REGION)))


@register("feed_ingest", f"""WITH {_entries_sql()}
SELECT feed, pos, title, link, summary, published, published_s::BIGINT AS published_s, source FROM entries""")
def feed_ingest(spark, base):
    return _entries(spark, base).select("feed", "pos", "title", "link", "summary", "published",
                                        F.unix_seconds("published_ts").alias("published_s"), "source")


@register("ingest_batch", f"""WITH {_entries_sql()},
docs AS (SELECT feed || '#' || lpad(pos::VARCHAR, 9, '0') AS doc_id, summary AS text FROM entries),
{tf_ctes('docs', 'text')},
later AS (SELECT DISTINCT j FROM pairs WHERE c >= 0.9::DOUBLE)
SELECT e.feed, e.pos, e.title, e.link FROM entries e JOIN reps r ON r.doc_id = e.feed || '#' || lpad(e.pos::VARCHAR, 9, '0')
WHERE r.doc_id NOT IN (SELECT j FROM later)""")
def ingest_batch(spark, base):
    from newsframe.sources.feeds import with_entry_id
    # read three times below: the XML is built, parsed and cleaned once
    e = written_table(with_entry_id(_entries(spark, base)), "entries")
    return drop_near_duplicates(e, text_col="summary", id_col="entry_id").select("feed", "pos", "title", "link")
