"""Registered queries: stored-record listings (S3, S4) and the text report
column (W6), over records derived from the pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import html as H
from newsframe.functions import summary as M
from newsframe.plans import pipelines as PL
from newsframe.plans import sqlkit as K
from newsframe.plans.q_html import E9_SQL, _first_text_sql, s_host
from newsframe.plans.q_keywords import k1_ctes
from newsframe.plans.q_text import lead_sql
from newsframe.plans.registry import register
from newsframe.sinks import flatten_arrays, report_text
from newsframe.sources.store import stored_articles, stored_records
from newsframe.sources.tables import read_table

REPORT_TIME = "2025-01-01T00:00:00"
FIRST_DAY = 1735689600      # 2025-01-01 00:00 UTC


def day_of(id_col):
    """A day from an id (many ids share one)."""
    return F.timestamp_seconds(F.lit(FIRST_DAY) + F.col(id_col) % 50 * 86400)


def s_day_of(x):
    return f"make_timestamp(({FIRST_DAY} + {x} % 50 * 86400) * 1000000)"


def _articles(spark, base):
    """Stored-article rows derived from the pages. The pages hold no dates, so
    ``date_published`` comes from the id: 50 days that repeat, every seventh NULL."""
    p = read_table(spark, base, "pages")
    return p.select(F.col("page_id").alias("id"),
                    F.coalesce(H.first_element_text("html", "h1"), F.lit("No Title")).alias("title"),
                    "url", M.summary_lead(H.paragraph_text_all("html")).alias("summary"),
                    H.url_host("url").alias("source"), F.when(F.col("page_id") % 7 != 0, day_of("page_id")).alias("date_published"))


@register("stored_articles", f"""SELECT page_id AS id, coalesce({_first_text_sql('h1')}, 'No Title') AS title, url,
  {lead_sql(E9_SQL)} AS summary, {s_host('url')} AS source, epoch(d)::BIGINT AS published_s,
  row_number() OVER (ORDER BY d DESC NULLS LAST, page_id) AS rank
FROM (SELECT *, CASE WHEN page_id % 7 <> 0 THEN {s_day_of('page_id')} END AS d FROM pages)""")
def stored_articles_q(spark, base):
    a = stored_articles(_articles(spark, base), ranked=True)
    return a.select("id", "title", "url", "summary", "source",
                    F.unix_seconds("date_published").alias("published_s"), F.col("rank").cast("long").alias("rank"))


def _records(spark, base):
    r = PL.cli_summarize(read_table(spark, base, "pages"))
    return flatten_arrays(r.select(F.col("page_id").cast("string").alias("id"), "summary", "credibility",
                                   "keywords", day_of("page_id").alias("created_at")))


_PEN = " + ".join(K.count_substr("lower(coalesce(c.content, ''))", x) for x in L.PENALTY_CUES)
_REC_SQL = f"""WITH content AS (SELECT page_id AS doc_id, {E9_SQL} AS content FROM pages),
{k1_ctes('content', 'content')},
rec AS (SELECT c.doc_id::VARCHAR AS id, {s_day_of('c.doc_id')} AS created_at, {lead_sql('c.content')} AS summary,
  greatest(100.0::DOUBLE - ({_PEN})::DOUBLE * 10.0::DOUBLE, 0.0::DOUBLE) AS credibility,
  k.keywords AS keywords FROM content c JOIN k1_kw k ON c.doc_id = k.doc_id)"""


@register("stored_records", f"""{_REC_SQL}
SELECT id, summary, credibility, len(string_split(keywords, ','))::BIGINT AS n_keywords,
  (SELECT count(*) FROM rec)::BIGINT AS count, epoch(created_at)::BIGINT AS created_s,
  row_number() OVER (ORDER BY created_at DESC, id) AS rank FROM rec""")
def stored_records_q(spark, base):
    r = stored_records(_records(spark, base), ranked=True)
    return r.select("id", "summary", "credibility", F.size("keywords").cast("long").alias("n_keywords"),
                    F.col("count").cast("long").alias("count"), F.unix_seconds("created_at").alias("created_s"),
                    F.col("rank").cast("long").alias("rank"))


@register("sink_text_report", f"""{_REC_SQL}
SELECT id, '=== Summary ID: ' || id || ' ===' || chr(10) || 'Created At: {REPORT_TIME}' || chr(10) ||
  'Summary: ' || summary || chr(10) || 'Credibility Score: ' || printf('%.2f', credibility) || chr(10) ||
  'Keywords: ' || replace(keywords, ',', ', ') || chr(10) AS report FROM rec""")
def sink_text_report_q(spark, base):
    r = PL.cli_summarize(read_table(spark, base, "pages"))
    i = F.col("page_id").cast("string")
    return r.select(i.alias("id"), report_text(i, F.lit(REPORT_TIME), F.col("summary"), F.col("credibility"),
                                               F.col("keywords")).alias("report"))
