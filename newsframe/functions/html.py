"""Markup extraction as native column expressions.

Decisions (fixed once, applied everywhere):
* script/style blocks, comments and declarations are removed before anything
  else (scripts in real pages hide strings such as "</p>");
* a paragraph ends at ``</p>``, at the next ``<p>`` or at the end of its
  container (the HTML5 rule), so an unclosed ``<p>`` never swallows the next
  paragraphs and text outside paragraphs never leaks in;
* inline tags are removed (text kept, no separator), entities decoded,
  whitespace runs collapsed, paragraphs stripped.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsframe.functions.text import WS_RUN, _c, decode_entities, strip

P_OPEN = "\u0001"
P_CLOSE = "\u0002"
DIV_MARK = "\u0003"


def drop_code(html) -> Column:
    """Remove script/style blocks, comments and declarations."""
    h = F.coalesce(_c(html), F.lit(""))
    for tag in ("script", "style"):
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", " ")
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", " ")
    return F.regexp_replace(h, r"<[!?][^>]*>", " ")


def inner_text(fragment) -> Column:
    """Tags removed (no separator), entities decoded, whitespace collapsed,
    stripped."""
    t = F.regexp_replace(_c(fragment), r"<[^>]*>", "")
    return strip(F.regexp_replace(decode_entities(t), WS_RUN, " "))


def anchors(html) -> Column:
    """Attribute strings of every ``<a ...>`` start tag, in page order."""
    return F.regexp_extract_all(drop_code(html), F.lit(r"(?is)<a\b([^>]*)>"), 1)


def attr(attrs, name: str) -> Column:
    """Value of attribute ``name`` in an attribute string (quoted or not),
    entities decoded; NULL if absent."""
    a = _c(attrs)
    pat = rf"""(?is)(?:^|\s){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    present = a.rlike(rf"(?is)(?:^|\s){name}\s*=")
    val = F.concat(F.regexp_extract(a, pat, 1), F.regexp_extract(a, pat, 2), F.regexp_extract(a, pat, 3))
    return F.when(present, decode_entities(val))


def has_class(attrs, cls: str) -> Column:
    c = attr(attrs, "class")
    return F.coalesce(F.array_contains(F.split(strip(c), WS_RUN), F.lit(cls)), F.lit(False))


# ----------------------------------------------------------------- URLs

URL_RE = r"^([A-Za-z][A-Za-z0-9+.\-]*):(//[^/?#]*)?([^?#]*)(\?[^#]*)?(#.*)?$"


def url_part(url, idx: int) -> Column:
    return F.regexp_extract(_c(url), URL_RE, idx)


def _remove_dots(path: Column) -> Column:
    """Fold the segments of the path (up to a query or fragment): ``.`` goes,
    ``..`` takes the segment before it along, at any depth."""
    own = F.regexp_extract(path, r"^[^?#]*", 0)
    segs = F.split(own, "/")
    kept = F.aggregate(segs, F.array().cast("array<string>"), lambda acc, x: F.when(
        x == "..", F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(1)))).when(x == ".", acc)
        .otherwise(F.array_append(acc, x)))
    kept = F.when(F.element_at(segs, -1).isin(".", ".."), F.array_append(kept, F.lit(""))).otherwise(kept)
    dotted = own.rlike(r"(?:^|/)\.\.?(?:/|$)")
    return F.when(dotted, F.concat(F.array_join(kept, "/"), F.substr(path, F.length(own) + 1))).otherwise(path)


def resolve_url(base, href) -> Column:
    """Resolve ``href`` against ``base`` (absolute, network-path,
    absolute-path, query, fragment and relative-path references)."""
    b, h = _c(base), F.trim(_c(href))
    scheme, auth, path, query = url_part(b, 1), url_part(b, 2), url_part(b, 3), url_part(b, 4)
    origin = F.concat(scheme, F.lit(":"), auth)
    base_dir = F.regexp_replace(path, r"[^/]*$", "")
    base_dir = F.when(base_dir == "", F.lit("/")).otherwise(base_dir)
    merged = F.concat(base_dir, h)  # a relative path loses its empty segments
    merged_path = F.regexp_extract(merged, r"^[^?#]*", 0)
    rel = _remove_dots(F.concat(F.regexp_replace(merged_path, r"/{2,}", "/"), F.substr(merged, F.length(merged_path) + 1)))
    return (F.when(h.isNull(), F.lit(None))
            .when(h == "", b)
            .when(h.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*:"), h)
            .when(h.startswith("//"), F.concat(scheme, F.lit(":"), h))
            .when(h.startswith("/"), F.concat(origin, _remove_dots(h)))
            .when(h.startswith("?"), F.concat(origin, path, h))
            .when(h.startswith("#"), F.concat(origin, path, query, h))
            .otherwise(F.concat(origin, rel)))


def strip_query(url) -> Column:
    return F.split_part(_c(url), F.lit("?"), F.lit(1))


def url_host(url) -> Column:
    return F.lower(F.regexp_replace(url_part(url, 2), r"^//(?:[^@/]*@)?|:\d+$", ""))


def url_path(url, mode: str, base: str = "") -> Column:
    """Path handed to the robots check. ``collapse``: leading slashes
    collapsed to one; ``keep``: the path ('/' when empty); ``replace_base``:
    the URL with the site base replaced by '/'."""
    p = url_part(url, 3)
    if mode == "collapse":
        return F.concat(F.lit("/"), F.regexp_replace(p, r"^/+", ""))
    if mode == "keep":
        return F.when(p == "", F.lit("/")).otherwise(p)
    if mode == "replace_base":
        return F.replace(_c(url), F.lit(base), F.lit("/"))
    raise ValueError(f"unknown path mode {mode}")


# ------------------------------------------------------------ paragraphs

def _paragraphs(region: Column) -> Column:
    m = F.regexp_replace(region, r"(?i)</p\s*>", P_CLOSE)
    m = F.regexp_replace(m, r"(?i)<p(?:\s[^>]*)?>", P_OPEN)
    m = F.concat(m, F.lit(P_CLOSE))
    raw = F.regexp_extract_all(m, F.lit(f"{P_OPEN}([^{P_OPEN}{P_CLOSE}]*)"), 1)
    return F.transform(raw, lambda p: inner_text(p))


def container(html, tag: str, cls: str = "", cleaned: bool = False) -> Column:
    """Inner markup of the first ``<tag>`` (with class ``cls``), up to its
    balanced end tag (or the end of the page); NULL if there is none.
    ``cleaned``: the input already went through ``drop_code``."""
    h = _c(html) if cleaned else drop_code(html)
    cond = (rf"""[^>]*\bclass\s*=\s*["']?(?:[^"'>]*\s)?{cls}[\s"'][^>]*""" if cls else r"(?:\s[^>]*)?")
    start_re = rf"(?is)<{tag}{cond}>"
    found = h.rlike(start_re)
    rest = F.regexp_extract(h, rf"{start_re}(.*)$", 1)
    marked = F.regexp_replace(rest, rf"(?i)(</?{tag}\b)", DIV_MARK + "$1")
    chunks = F.split(marked, DIV_MARK)
    # depth fold: the first chunk that closes the container ends it
    step = F.aggregate(
        chunks,
        F.struct(F.lit(1).alias("d"), F.lit(-1).alias("end"), F.lit(0).alias("i")),
        lambda acc, c: F.struct(
            F.when(acc["end"] >= 0, acc["d"])
             .when(c.rlike(rf"(?i)^</{tag}"), acc["d"] - 1)
             .when(c.rlike(rf"(?i)^<{tag}"), acc["d"] + 1).otherwise(acc["d"]).alias("d"),
            F.when(acc["end"] >= 0, acc["end"])
             .when(c.rlike(rf"(?i)^</{tag}") & (acc["d"] == 1), acc["i"]).otherwise(F.lit(-1)).alias("end"),
            (acc["i"] + 1).alias("i")))
    end = step["end"]
    inner = F.when(end < 0, F.array_join(chunks, "")).otherwise(
        F.array_join(F.slice(chunks, 1, F.greatest(end, F.lit(0))), ""))
    inner = F.when(end == 0, F.lit("")).otherwise(inner)
    return F.when(found, F.regexp_replace(inner, DIV_MARK, ""))


def paragraph_text_container(html, tag: str, cls: str = "", cleaned: bool = False) -> Column:
    """Paragraphs of the body container joined by newlines; '' if the
    container is missing. Empty paragraphs stay as empty lines."""
    c = container(html, tag, cls, cleaned)
    return F.when(c.isNull(), F.lit("")).otherwise(F.array_join(_paragraphs(c), "\n"))


def paragraph_text_all(html) -> Column:
    """Every paragraph of the page joined with a space, whitespace runs
    collapsed, stripped."""
    joined = F.array_join(_paragraphs(drop_code(html)), " ")
    return strip(F.regexp_replace(joined, WS_RUN, " "))


def first_element_text(html, tag: str, cond: str = "", cleaned: bool = False) -> Column:
    """Text of the first ``<tag cond...>`` element (to its first end tag);
    NULL if none."""
    h = _c(html) if cleaned else drop_code(html)
    c = cond if cond else ""
    pat = rf"(?is)<{tag}\b[^>]*{c}[^>]*>(.*?)</{tag}\s*>" if c else rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}\s*>"
    start = rf"(?is)<{tag}\b[^>]*{c}[^>]*>" if c else rf"(?is)<{tag}\b[^>]*>"
    return F.when(h.rlike(start), inner_text(F.regexp_extract(h, pat, 1)))


def first_tag_attrs(html, tag: str, cleaned: bool = False) -> Column:
    """Attribute string of the first ``<tag ...>``; NULL if none."""
    h = _c(html) if cleaned else drop_code(html)
    return F.when(h.rlike(rf"(?is)<{tag}\b"), F.regexp_extract(h, rf"(?is)<{tag}\b([^>]*)>", 1))
