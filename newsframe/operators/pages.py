"""Page operators: scan (S1), links (E1-E5), article extraction.

Site rules are small driver-side configuration. They are applied in a single
pass over the pages: each rule's expressions use literal patterns, and a
CASE on the page host picks the rule, so pages are scanned once whatever the
number of rules."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions import html as H
from newsframe.session import small_table


def class_cond(cls: str) -> str:
    """Regex fragment (inside a start tag) requiring class ``cls``."""
    return rf"""\bclass\s*=\s*["']?(?:[^"'>]*\s)?{cls}[\s"']"""


def attr_cond(name: str, value: str) -> str:
    return rf"""\b{name}\s*=\s*["']?{value}[\s"']"""


@dataclass(frozen=True)
class SiteRule:
    site: str
    host: str                      # '*' applies to hosts without a rule of their own
    link_cond: str = ""            # regex the anchor's attributes must match
    link_prefix: str = ""          # href must start with this
    link_contains: str = ""        # resolved link must contain this
    resolve: bool = True           # resolve href against the page URL
    strip_query: bool = False      # cut the link at '?'
    path_mode: str = "collapse"    # E6 mode for the robots check
    base: str = ""                 # site base (for path_mode 'replace_base')
    title_default: str = "No Title"
    author_tag: str = "a"
    author_cond: str = ""
    time_required: bool = False    # a <time> without datetime drops the article
    body_tag: str = "article"
    body_class: str = ""


def site_rules() -> list[SiteRule]:
    """The four site rules of ``lexicons.SITE_RULES`` as ``SiteRule``s."""
    out = []
    for r in L.SITE_RULES:
        link_attr = r["link_attr_regex"]
        if link_attr and "=" in link_attr:
            name, value = link_attr.split("=", 1)
            link_cond = attr_cond(name, value.strip('"'))
        else:
            link_cond = class_cond(link_attr) if link_attr else ""
        a = r["author_attr_regex"]
        if a and "=" in a:
            name, value = a.split("=", 1)
            author_cond = attr_cond(name, value.strip('"'))
        else:
            author_cond = class_cond(a) if a else ""
        out.append(SiteRule(site=r["site"], host=r["host"], link_cond=link_cond, link_prefix=r["link_prefix"],
                            link_contains=r["link_contains"], resolve=r["resolve"], strip_query=r["strip_query"],
                            path_mode=r["path_mode"], base=r["base"], title_default=r["title_default"],
                            author_tag=r["author_tag"], author_cond=author_cond,
                            time_required=r["time_required"], body_tag=r["body_tag"], body_class=r["body_class"]))
    return out


def scan_pages(pages: DataFrame) -> DataFrame:
    """(page_id, url, host, n_chars)."""
    return pages.select("page_id", "url", H.url_host("url").alias("host"),
                        F.length("html").cast("long").alias("n_chars"))


def extract_links(pages: DataFrame) -> DataFrame:
    """One row per anchor with a non-empty href, in page order:
    (page_id, page_url, pos, attrs, href)."""
    a = pages.select("page_id", F.col("url").alias("page_url"),
                     F.posexplode(H.anchors("html")).alias("pos", "attrs"))
    a = a.withColumn("pos", F.col("pos").cast("long")).withColumn("href", H.attr(F.col("attrs"), "href"))
    return a.filter(F.col("href").isNotNull() & (F.col("href") != ""))


def _rule_index(host: Column, rules: Sequence[SiteRule]) -> Column:
    idx = None
    for i, r in enumerate(rules):
        if r.host == "*":
            continue
        idx = F.when(host == r.host, F.lit(i)) if idx is None else idx.when(host == r.host, F.lit(i))
    wild = [i for i, r in enumerate(rules) if r.host == "*"]
    default = F.lit(wild[0]) if wild else F.lit(None).cast("int")
    return default if idx is None else idx.otherwise(default)


def _by_rule(ix: Column, rules: Sequence[SiteRule], fn) -> Column:
    out = None
    for i, r in enumerate(rules):
        v = fn(r)
        out = F.when(ix == i, v) if out is None else out.when(ix == i, v)
    return out


def _rule_link(r: SiteRule) -> tuple[Column, Column]:
    href = F.col("href")
    link = H.resolve_url(F.col("page_url"), href) if r.resolve else href
    cond = F.lit(True)
    if r.link_cond:
        cond = cond & F.col("attrs").rlike("(?is)" + r.link_cond)
    if r.link_prefix:
        cond = cond & href.startswith(r.link_prefix)
    if r.link_contains:
        cond = cond & link.contains(r.link_contains)
    if r.strip_query:
        link = H.strip_query(link)
    return link, cond


def site_links(pages: DataFrame, rules: Sequence[SiteRule]) -> DataFrame:
    """E2 + E3: links that satisfy the rule of their page's host, resolved:
    (page_id, pos, host, site, link)."""
    lk = extract_links(pages).withColumn("host", H.url_host("page_url"))
    ix = _rule_index(F.col("host"), rules)
    lk = lk.withColumn("_rule", ix).filter(F.col("_rule").isNotNull())
    link = _by_rule(F.col("_rule"), rules, lambda r: _rule_link(r)[0])
    cond = _by_rule(F.col("_rule"), rules, lambda r: _rule_link(r)[1])
    site = _by_rule(F.col("_rule"), rules, lambda r: F.lit(r.site))
    return lk.filter(cond).select("page_id", "pos", "host", site.alias("site"), link.alias("link"))


def distinct_links_topn(links: DataFrame, limit: int = L.ARTICLE_LIMIT, salts: int = 64) -> DataFrame:
    """Distinct links per host, first ``limit`` by first appearance
    (page, position) then link. Top-k runs in two phases (per host and salt,
    then per host over at most ``salts * limit`` rows) so a host holding most
    links is spread over many tasks; the result is exact."""
    firsts = links.groupBy("host", "link").agg(F.min(F.struct("page_id", "pos")).alias("first"))
    order = [F.col("first").asc(), F.col("link").asc()]
    salt = F.pmod(F.xxhash64("link"), F.lit(salts))
    local = (firsts.withColumn("_salt", salt)
             .withColumn("_rn", F.row_number().over(Window.partitionBy("host", "_salt").orderBy(*order)))
             .filter(F.col("_rn") <= limit))
    ranked = local.withColumn("rank", F.row_number().over(Window.partitionBy("host").orderBy(*order)))
    return ranked.filter(F.col("rank") <= limit).select("host", "link", F.col("rank").cast("long").alias("rank"),
                                                      F.col("first.page_id").alias("page_id"))


# Robots rules used by the registered check: every host gets this policy,
# except '.net' hosts (known, empty policy: allow all) and '.org' hosts (no
# readable policy: disallow all).
ROBOTS_TEMPLATE = [(1, "/the", False), (2, "/t", True), (3, "/a", False)]


def robots_rules_for_hosts(links: DataFrame) -> DataFrame:
    """Policy table (host, seq, prefix, allow) for the hosts of ``links``;
    a row with NULL prefix marks a known host without rules."""
    tmpl = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(p).alias("prefix"), F.lit(a).alias("allow"))
                     for s, p, a in ROBOTS_TEMPLATE])
    hosts = links.select("host").distinct().filter(~F.col("host").endswith(".org"))
    ruled = hosts.filter(~F.col("host").endswith(".net")).select("host", F.inline(tmpl))
    empty = hosts.filter(F.col("host").endswith(".net")).select(
        "host", F.lit(None).cast("int").alias("seq"), F.lit(None).cast("string").alias("prefix"),
        F.lit(None).cast("boolean").alias("allow"))
    return ruled.select("host", "seq", "prefix", "allow").unionByName(empty)


def robots_filter(urls: DataFrame, rules: DataFrame, mode: str = "collapse", base: str = "",
                  link_col: str = "link") -> DataFrame:
    """E5: keep URLs their host's policy allows. First matching rule (by
    ``seq``) wins; no matching rule allows; hosts absent from the policy
    table are disallowed."""
    rules = small_table(rules)
    known = rules.select("host").distinct()
    cand = urls.join(known, "host", "left_semi").withColumn("_path", H.url_path(F.col(link_col), mode, base))
    r = rules.filter(F.col("prefix").isNotNull()).select(
        F.col("host").alias("_h"), "seq", "prefix", "allow")
    m = cand.join(r, (cand["host"] == r["_h"]) & cand["_path"].startswith(r["prefix"]), "left")
    keys = [c for c in urls.columns]
    dec = m.groupBy(*keys).agg(F.min_by("allow", "seq").alias("_allow"))
    return dec.filter(F.coalesce(F.col("_allow"), F.lit(True))).drop("_allow")


def _article_cols(r: SiteRule) -> dict[str, Column]:
    html = F.col("_clean")
    time_attrs = F.col("_time")
    return {
        "title": F.coalesce(H.first_element_text(html, "h1", cleaned=True), F.lit(r.title_default)),
        "author": F.coalesce(H.first_element_text(html, r.author_tag, r.author_cond, cleaned=True),
                             F.lit(L.AUTHOR_DEFAULT)),
        "published": H.attr(time_attrs, "datetime"),
        "content": H.paragraph_text_container(html, r.body_tag, r.body_class, cleaned=True),
        "_drop": (F.lit(r.time_required) & time_attrs.isNotNull() & H.attr(time_attrs, "datetime").isNull()),
    }


def extract_article(pages: DataFrame, rules: SiteRule | Sequence[SiteRule]) -> DataFrame:
    """(page_id, url, site, title, author, published, content) by the
    rule of each page's host; pages without a rule, and tc-style pages whose
    <time> lacks a datetime, are dropped."""
    rules = [rules] if isinstance(rules, SiteRule) else list(rules)
    p = pages.withColumn("_rule", _rule_index(H.url_host("url"), rules)).filter(F.col("_rule").isNotNull())
    # scripts, styles and comments are removed once per page; every field
    # reads the cleaned markup
    p = p.select("page_id", "url", "_rule", H.drop_code("html").alias("_clean"))
    p = p.withColumn("_time", H.first_tag_attrs(F.col("_clean"), "time", cleaned=True))
    ix = F.col("_rule")
    cols = {k: _by_rule(ix, rules, lambda r, k=k: _article_cols(r)[k]) for k in
            ("title", "author", "published", "content", "_drop")}
    site = _by_rule(ix, rules, lambda r: F.lit(r.site))
    out = p.select("page_id", "url", site.alias("site"), *[v.alias(k) for k, v in cols.items()])
    return out.filter(~F.col("_drop")).drop("_drop")


def scrape_site(home_pages: DataFrame, pages: DataFrame, rules: Sequence[SiteRule],
                limit: int = L.ARTICLE_LIMIT, robots: DataFrame | None = None) -> DataFrame:
    """Links of the home pages -> site rule -> first ``limit`` per host
    -> robots policy (if given) -> fetched pages (inner join on URL) ->
    article rows."""
    links = distinct_links_topn(site_links(home_pages, rules), limit)
    if robots is not None:
        links = robots_filter(links, robots)
    fetched = pages.join(links.select(F.col("link").alias("url")).distinct(), "url", "inner")
    return extract_article(fetched, rules)
