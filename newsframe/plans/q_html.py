"""Registered queries: page scan (S1), markup cleaning (C1, C3), links
(E1-E6), article extraction (E7-E10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import html as H
from newsframe.functions import text as T
from newsframe.operators import pages as PG
from newsframe.plans import sqlkit as K
from newsframe.plans.registry import register
from newsframe.sources.tables import read_table

WS = T.WS
SEP1, SEP2 = H.P_OPEN, H.P_CLOSE


def _pages(spark, base):
    return read_table(spark, base, "pages")


# ------------------------------------------------------------- SQL pieces

def s_drop_code(x):
    h = f"coalesce({x}, '')"
    for tag in ("script", "style"):
        h = f"regexp_replace({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', ' ', 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', ' ', 'g')"
    return f"regexp_replace({h}, '<[!?][^>]*>', ' ', 'g')"


def s_inner_text(x):
    t = f"regexp_replace({x}, '<[^>]*>', '', 'g')"
    return K.strip(f"regexp_replace({K.decode_entities(t)}, '[{WS}]+', ' ', 'g')")


def s_paragraphs(region):
    m = f"regexp_replace({region}, '(?i)</p\\s*>', '{SEP2}', 'g')"
    m = f"regexp_replace({m}, '(?i)<p(?:\\s[^>]*)?>', '{SEP1}', 'g')"
    m = f"({m} || '{SEP2}')"
    raw = f"regexp_extract_all({m}, '{SEP1}([^{SEP1}{SEP2}]*)', 1)"
    return f"list_transform({raw}, lambda p: {s_inner_text('p')})"


def s_clean_html(x):
    h = f"coalesce({x}, '')"
    for tag in ("script", "style", "noscript", "iframe"):
        h = f"regexp_replace({h}, '(?is)<{tag}\\b[^>]*>.*?</{tag}\\s*>', chr(1), 'g')"
    h = f"regexp_replace({h}, '(?s)<!--.*?-->', chr(1), 'g')"
    h = f"regexp_replace({h}, '<[!?][^>]*>', chr(1), 'g')"
    h = f"regexp_replace({h}, '</?[A-Za-z][^>]*>', chr(1), 'g')"
    nodes = f"list_transform(string_split({h}, chr(1)), lambda p: {K.strip(K.decode_entities('p'))})"
    return f"array_to_string(list_filter({nodes}, lambda p: p <> ''), ' ')"


URL_RE = H.URL_RE


def s_url_part(x, i):
    return f"regexp_extract({x}, '{URL_RE}', {i})"


def s_host(x):
    return f"lower(regexp_replace({s_url_part(x, 2)}, '^//(?:[^@/]*@)?|:\\d+$', '', 'g'))"


#: A segment other than '..' followed by '/../'; the pages' links nest no deeper.
_DOTDOT = r"/(?:[^/.][^/]*|\.[^/.][^/]*|\.\.[^/]+)/\.\./"


def s_remove_dots(x):
    p = f"regexp_replace({x}, '/\\./', '/', 'g')"
    p = f"regexp_replace({p}, '/\\.$', '/')"
    for _ in range(4):
        p = f"regexp_replace({p}, '{_DOTDOT}', '/', 'g')"
    return f"regexp_replace({p}, '^/(\\.\\./)+', '/')"


def s_resolve(b, h):
    scheme, auth, path, query = (s_url_part(b, i) for i in (1, 2, 3, 4))
    origin = f"({scheme} || ':' || {auth})"
    bdir = f"regexp_replace({path}, '[^/]*$', '')"
    bdir = f"(CASE WHEN {bdir} = '' THEN '/' ELSE {bdir} END)"
    return f"""(CASE WHEN {h} IS NULL THEN NULL WHEN {h} = '' THEN {b}
      WHEN regexp_matches({h}, '^[A-Za-z][A-Za-z0-9+.\\-]*:') THEN {h}
      WHEN starts_with({h}, '//') THEN {scheme} || ':' || {h}
      WHEN starts_with({h}, '/') THEN {origin} || {s_remove_dots(h)}
      WHEN starts_with({h}, '?') THEN {origin} || {path} || {h}
      WHEN starts_with({h}, '#') THEN {origin} || {path} || {query} || {h}
      ELSE {origin} || {s_remove_dots(bdir + ' || ' + h)} END)"""


def s_attr(a, name):
    pat = f"""(?is)(?:^|\\s){name}\\s*=\\s*(?:"([^"]*)"|''([^'']*)''|([^\\s"''>]+))"""
    val = f"(regexp_extract({a}, '{pat}', 1) || regexp_extract({a}, '{pat}', 2) || regexp_extract({a}, '{pat}', 3))"
    return f"(CASE WHEN regexp_matches({a}, '(?is)(?:^|\\s){name}\\s*=') THEN {K.decode_entities(val)} END)"


LINKS_SQL = f"""
lk AS (SELECT page_id, url AS page_url, unnest(a) AS attrs, unnest(range(len(a)))::BIGINT AS pos
       FROM (SELECT page_id, url, regexp_extract_all({s_drop_code('html')}, '(?is)<a\\b([^>]*)>', 1) AS a FROM pages)),
links AS (SELECT page_id, page_url, pos, {s_attr('attrs', 'href')} AS href FROM lk)"""


# ---------------------------------------------------------------- queries

@register("scan_pages", f"SELECT page_id, url, {s_host('url')} AS host, length(html)::BIGINT AS n_chars FROM pages")
def scan_pages(spark, base):
    return PG.scan_pages(_pages(spark, base))


@register("clean_html", f"SELECT page_id, {s_clean_html('html')} AS text FROM pages")
def clean_html(spark, base):
    return _pages(spark, base).select("page_id", T.clean_html("html").alias("text"))


@register("clean_article_text", f"SELECT page_id, {K.normalize(s_clean_html('html'))} AS text FROM pages")
def clean_article_text(spark, base):
    return _pages(spark, base).select("page_id", T.clean_article_text("html").alias("text"))


@register("extract_links", f"""WITH {LINKS_SQL}
SELECT page_id, pos, href FROM links WHERE href IS NOT NULL AND href <> ''""")
def extract_links(spark, base):
    return PG.extract_links(_pages(spark, base)).select("page_id", "pos", "href")


@register("resolve_links", f"""WITH {LINKS_SQL}
SELECT page_id, pos, href, {s_resolve('page_url', 'href')} AS link,
       split_part({s_resolve('page_url', 'href')}, '?', 1) AS link_noquery
FROM links WHERE href IS NOT NULL AND href <> ''""")
def resolve_links(spark, base):
    r = PG.extract_links(_pages(spark, base))
    r = r.withColumn("link", H.resolve_url(F.col("page_url"), F.col("href")))
    return r.select("page_id", "pos", "href", "link", H.strip_query("link").alias("link_noquery"))


PAGE_RULE = PG.SiteRule(site="pages", host="*", link_prefix="/", link_contains="/th", resolve=True,
                        title_default="No Title", author_tag="a", author_cond=PG.class_cond("byline-component__link"),
                        body_tag="article", body_class="")


def _rule_filter_sql(rule):
    conds = ["href IS NOT NULL", "href <> ''"]
    if rule.link_prefix:
        conds.append(f"starts_with(href, {K.q(rule.link_prefix)})")
    link = s_resolve("page_url", "href") if rule.resolve else "href"
    if rule.link_contains:
        conds.append(f"contains({link}, {K.q(rule.link_contains)})")
    if rule.strip_query:
        link = f"split_part({link}, '?', 1)"
    return link, " AND ".join(conds)


_LINK, _COND = _rule_filter_sql(PAGE_RULE)
SITE_LINKS_SQL = f"""{LINKS_SQL},
site_links AS (SELECT page_id, pos, {s_host('page_url')} AS host, {_LINK} AS link FROM links WHERE {_COND})"""


@register("filter_links_by_site", f"WITH {SITE_LINKS_SQL} SELECT page_id, pos, link FROM site_links")
def filter_links_by_site(spark, base):
    return PG.site_links(_pages(spark, base), [PAGE_RULE]).select("page_id", "pos", "link")


@register("distinct_links_topn", f"""WITH {SITE_LINKS_SQL},
firsts AS (SELECT host, link, min(page_id) AS page_id FROM site_links GROUP BY host, link),
firsts2 AS (SELECT f.host, f.link, f.page_id, min(s.pos) AS pos FROM firsts f
            JOIN site_links s ON s.host = f.host AND s.link = f.link AND s.page_id = f.page_id GROUP BY ALL),
rk AS (SELECT host, link, row_number() OVER (PARTITION BY host ORDER BY page_id, pos, link) AS rank FROM firsts2)
SELECT host, link, rank::BIGINT AS rank FROM rk WHERE rank <= {L.ARTICLE_LIMIT}""")
def distinct_links_topn(spark, base):
    links = PG.site_links(_pages(spark, base), [PAGE_RULE])
    return PG.distinct_links_topn(links, L.ARTICLE_LIMIT).select("host", "link", "rank")


@register("url_path", f"""SELECT page_id,
  '/' || regexp_replace({s_url_part('url', 3)}, '^/+', '') AS path_collapse,
  CASE WHEN {s_url_part('url', 3)} = '' THEN '/' ELSE {s_url_part('url', 3)} END AS path_keep,
  replace(url, {s_url_part('url', 1)} || ':' || {s_url_part('url', 2)} || '/', '/') AS path_replace_base
FROM pages""")
def url_path(spark, base):
    p = _pages(spark, base)
    origin = F.concat(H.url_part("url", 1), F.lit(":"), H.url_part("url", 2), F.lit("/"))
    return p.select("page_id", H.url_path("url", "collapse").alias("path_collapse"),
                    H.url_path("url", "keep").alias("path_keep"),
                    F.replace(F.col("url"), origin, F.lit("/")).alias("path_replace_base"))


ROBOTS_SQL = f"""{SITE_LINKS_SQL},
hosts AS (SELECT DISTINCT host FROM site_links),
policy AS (SELECT h.host, r.seq, r.prefix, r.allow FROM hosts h,
           (VALUES {', '.join(f"({s}, {K.q(p)}, {str(a).upper()})" for s, p, a in PG.ROBOTS_TEMPLATE)}) AS r(seq, prefix, allow)
           WHERE NOT h.host LIKE '%.org' AND NOT h.host LIKE '%.net'),
known AS (SELECT host FROM hosts WHERE NOT host LIKE '%.org'),
cand AS (SELECT DISTINCT s.host, s.link, '/' || regexp_replace({s_url_part('s.link', 3)}, '^/+', '') AS path
         FROM site_links s JOIN known k ON s.host = k.host),
m AS (SELECT c.host, c.link, arg_min(p.allow, p.seq) AS allow FROM cand c
      LEFT JOIN policy p ON c.host = p.host AND starts_with(c.path, p.prefix) GROUP BY c.host, c.link)
SELECT host, link FROM m WHERE coalesce(allow, TRUE)"""


@register("robots_filter", "WITH " + ROBOTS_SQL)
def robots_filter(spark, base):
    links = PG.site_links(_pages(spark, base), [PAGE_RULE])
    rules = PG.robots_rules_for_hosts(links)
    return PG.robots_filter(links.select("host", "link").distinct(), rules, mode="collapse").select("host", "link")


def _article_sql_region(x):
    return f"regexp_extract({x}, '(?is)<article(?:\\s[^>]*)?>(.*?)</article\\s*>', 1)"


E8_SQL = f"""(CASE WHEN regexp_matches({s_drop_code('html')}, '(?is)<article(?:\\s[^>]*)?>')
  THEN array_to_string({s_paragraphs(_article_sql_region(s_drop_code('html')))}, chr(10)) ELSE '' END)"""


@register("paragraph_text_container", f"SELECT page_id, {E8_SQL} AS content FROM pages")
def paragraph_text_container(spark, base):
    return _pages(spark, base).select("page_id", H.paragraph_text_container("html", "article").alias("content"))


@register("paragraph_text_all", f"""SELECT page_id,
  {K.strip(f"regexp_replace(array_to_string({s_paragraphs(s_drop_code('html'))}, ' '), '[{WS}]+', ' ', 'g')")} AS content FROM pages""")
def paragraph_text_all(spark, base):
    return _pages(spark, base).select("page_id", H.paragraph_text_all("html").alias("content"))


def _first_text_sql(tag, cond=""):
    h = s_drop_code("html")
    start = f"(?is)<{tag}\\b[^>]*{cond}[^>]*>" if cond else f"(?is)<{tag}\\b[^>]*>"
    pat = f"{start}(.*?)</{tag}\\s*>"
    return f"(CASE WHEN regexp_matches({h}, '{start}') THEN {s_inner_text(f'regexp_extract({h}, {K.q(pat)}, 1)')} END)"


_TIME_ATTRS = f"""(CASE WHEN regexp_matches({s_drop_code('html')}, '(?is)<time\\b')
  THEN regexp_extract({s_drop_code('html')}, '(?is)<time\\b([^>]*)>', 1) END)"""


def article_sql(src: str = "pages") -> str:
    return f"""SELECT page_id, url,
  coalesce({_first_text_sql('h1')}, {K.q(PAGE_RULE.title_default)}) AS title,
  coalesce({_first_text_sql('a', PG.class_cond('byline-component__link').replace("'", "''"))}, 'Unknown') AS author,
  {s_attr(_TIME_ATTRS, 'datetime')} AS published,
  {E8_SQL} AS content
FROM {src}"""


@register("extract_article", article_sql())
def extract_article(spark, base):
    return PG.extract_article(_pages(spark, base), PAGE_RULE).select(
        "page_id", "url", "title", "author", "published", "content")


@register("scrape_site", f"""WITH {SITE_LINKS_SQL},
firsts AS (SELECT host, link, min(page_id) AS page_id FROM site_links GROUP BY host, link),
firsts2 AS (SELECT f.host, f.link, f.page_id, min(s.pos) AS pos FROM firsts f
            JOIN site_links s ON s.host = f.host AND s.link = f.link AND s.page_id = f.page_id GROUP BY ALL),
rk AS (SELECT host, link, row_number() OVER (PARTITION BY host ORDER BY page_id, pos, link) AS rank FROM firsts2),
fetched AS (SELECT p.* FROM pages p JOIN (SELECT DISTINCT link FROM rk WHERE rank <= {L.ARTICLE_LIMIT}) l
            ON p.url = l.link),
arts AS ({article_sql('fetched')})
SELECT page_id, url, 'pages' AS site, title, author, published, content FROM arts""")
def scrape_site(spark, base):
    return PG.scrape_site(_pages(spark, base), _pages(spark, base), [PAGE_RULE], L.ARTICLE_LIMIT).select(
        "page_id", "url", "site", "title", "author", "published", "content")


# --------------------------------------------------------------- pipelines

from newsframe.plans import params as PR  # noqa: E402
from newsframe.plans import pipelines as PL  # noqa: E402
from newsframe.plans.q_keywords import _vectors, k1_ctes, k5_sql  # noqa: E402
from newsframe.plans.q_scores import d1_ctes  # noqa: E402
from newsframe.plans.q_text import _trunc_sql, lead_sql  # noqa: E402
from newsframe.operators.keywords import hashed_vector_key  # noqa: E402

E9_SQL = K.strip(f"regexp_replace(array_to_string({s_paragraphs(s_drop_code('html'))}, ' '), '[{WS}]+', ' ', 'g')")
_PENALTY = " + ".join(K.count_substr("lower(coalesce(content, ''))", c) for c in L.PENALTY_CUES)


@register("cli_summarize", f"""WITH content AS (SELECT page_id AS doc_id, {E9_SQL} AS content FROM pages),
{k1_ctes('content', 'content')}
SELECT c.doc_id AS page_id, {lead_sql('c.content')} AS summary,
  greatest(100.0::DOUBLE - ({_PENALTY.replace('content', 'c.content')})::DOUBLE * 10.0::DOUBLE, 0.0::DOUBLE) AS credibility,
  k.keywords FROM content c JOIN k1_kw k ON c.doc_id = k.doc_id""")
def cli_summarize(spark, base):
    r = PL.cli_summarize(_pages(spark, base))
    return r.select("page_id", "summary", "credibility", F.array_join("keywords", ",").alias("keywords"))


_K5 = k5_sql("content", "content")
_P1_SQL = f"""WITH content AS (SELECT page_id AS doc_id, url, {E9_SQL} AS content FROM pages),
{d1_ctes(src_table='content', text='content')},
kw AS ({_K5}),
sm AS (SELECT doc_id,
  CASE WHEN length({K.strip("coalesce(content, '')")}) < {L.GUARD_SUMMARY_MIN} THEN {K.q(L.TOO_SHORT_SUMMARY)}
       ELSE {lead_sql(f"({_trunc_sql(L.TRUNCATE_LOCAL_WORDS).replace('text', 'content')})")} END AS summary
  FROM content)
SELECT c.doc_id AS page_id, c.url, sm.summary, kw.keywords, d1.credibility
FROM content c JOIN sm ON c.doc_id = sm.doc_id JOIN kw ON c.doc_id = kw.doc_id JOIN d1 ON c.doc_id = d1.doc_id"""


@register("analyze_articles", _P1_SQL)
def analyze_articles(spark, base):
    vec, n = _vectors(spark, base)
    r = PL.analyze_articles(_pages(spark, base), vec, PR.STOP_WORDS_20, key=lambda w: hashed_vector_key(w, n))
    return r.select("page_id", "url", "summary", F.array_join("keywords", ",").alias("keywords"), "credibility")
