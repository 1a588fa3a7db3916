"""Text cleaning, guards and truncation as native column expressions.

Python's ``\\s`` and ``str.strip`` use Unicode whitespace while Java's ``\\s`` is
ASCII; ``WS`` below is the Unicode set written so that Java regex and RE2
read it the same way.
"""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsframe import lexicons as L

# Unicode whitespace (the set Python's re and str.strip use).
WS = r"\s\p{Z}\x0B\x1C-\x1F\x85"
WS_RUN = f"[{WS}]+"
NON_WS = f"[^{WS}]"
EDGE_WS = f"^[{WS}]+|[{WS}]+$"
# Token: a maximal run of letters, digits and underscore (Python's \w+).
TOKEN = r"[\p{L}\p{N}_]+"
# A text node separator used while flattening markup (never in clean text).
NODE_SEP = "\u0001"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pyround(c, digits: int) -> Column:
    """Round like Python's ``round(x, d)`` for doubles, that is by the exact
    binary value: 1.115 is a little under its decimal, so it gives 1.11.

    The scaled value is itself rounded, which can make a tie of a near-tie (and
    nothing else: ties are doubles and rounding keeps order). So at a tie the
    sign of the product's error decides; the error is exact, as the value is
    split into halves whose products with the scale need no rounding (Dekker)."""
    x, k = _c(c), F.lit(float(10 ** digits))
    scaled = x * k
    big = x * F.lit(float(2 ** 27 + 1))
    high = big - (big - x)
    error = (high * k - scaled) + (x - high) * k
    down = F.floor(scaled).cast("double")
    tie = scaled - down == F.lit(0.5)
    whole = F.when(tie & (error < 0), down).when(tie & (error > 0), down + F.lit(1.0)).otherwise(F.rint(scaled))
    return whole / k


def strip(c) -> Column:
    """Python ``str.strip()``: remove Unicode whitespace at both ends."""
    return F.regexp_replace(_c(c), EDGE_WS, "")


def stripped_length(c) -> Column:
    return F.length(strip(F.coalesce(_c(c), F.lit(""))))


#: Named character references: those of HTML 4 (public table) and the page set.
NAMED = {f"&{n};": chr(c) for n, c in name2codepoint.items()} | dict(L.HTML_ENTITIES)
_NAMES = "".join(n + ch for n, ch in NAMED.items())   # each name, then its character
ENTITY = r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]{1,7});"


def _decoded(ref: Column) -> Column:
    """One character reference -> its text. Numbers outside Unicode,
    surrogates and 0 give U+FFFD; unknown names stay."""
    digits = F.regexp_extract(ref, r"^&#[xX]?0*([0-9a-fA-F]{0,7});$", 1)
    code = F.when(ref.rlike("^&#[xX]"), F.conv(digits, 16, 10)).otherwise(digits).try_cast("long")
    good = lambda c: c.between(1, 0xD7FF) | c.between(0xE000, 0x10FFFF)
    char = F.transform(F.array(code), lambda c: F.decode(F.unhex(F.lpad(F.hex(  # names the code once
        F.when(good(c), c).otherwise(F.lit(0xFFFD))), 8, "0")), "UTF-32"))[0]
    at = F.position(ref, F.lit(_NAMES))
    named = F.when(at > 0, F.substr(F.lit(_NAMES), at + F.length(ref), F.lit(1))).otherwise(ref)
    return F.when(ref.startswith("&#"), char).otherwise(named)


def decode_entities(c) -> Column:
    """Decode character references in one pass (so '&#38;lt;' gives '&lt;').
    Only texts with a reference do the work: split around the references,
    convert, interleave."""
    x = _c(c)
    refs = F.transform(F.regexp_extract_all(x, F.lit(ENTITY), 0), _decoded)
    joined = F.array_join(F.zip_with(F.split(x, ENTITY, -1), refs, lambda p, r: F.concat(p, F.coalesce(r, F.lit("")))), "")
    return F.when(x.contains("&"), joined).otherwise(x)


def normalize_text(c) -> Column:
    """Whitespace runs -> one space, drop control characters, strip."""
    t = F.regexp_replace(_c(c), WS_RUN, " ")
    t = F.regexp_replace(t, r"[\x00-\x1F\x7F]", "")
    return strip(t)


def _drop_blocks(html: Column) -> Column:
    h = html
    for tag in ("script", "style", "noscript", "iframe"):
        h = F.regexp_replace(h, rf"(?is)<{tag}\b[^>]*>.*?</{tag}\s*>", NODE_SEP)
    h = F.regexp_replace(h, r"(?s)<!--.*?-->", NODE_SEP)
    h = F.regexp_replace(h, r"<[!?][^>]*>", NODE_SEP)
    return h


def text_nodes(html) -> Column:
    """Markup -> array of text nodes (script/style/noscript/iframe subtrees,
    comments and declarations removed; entities decoded; each node stripped;
    empty nodes dropped)."""
    h = _drop_blocks(_c(html))
    h = F.regexp_replace(h, r"</?[A-Za-z][^>]*>", NODE_SEP)
    nodes = F.transform(F.split(h, NODE_SEP), lambda p: strip(decode_entities(p)))
    return F.filter(nodes, lambda p: p != F.lit(""))


def clean_html(html) -> Column:
    """Text nodes of the markup joined with one space."""
    return F.array_join(text_nodes(F.coalesce(_c(html), F.lit(""))), " ")


def clean_article_text(html) -> Column:
    """C3 = C2(C1(html))."""
    return normalize_text(clean_html(html))


def _strip_urls_and_punct(c: Column) -> Column:
    t = F.regexp_replace(c, rf"http{NON_WS}+|www[^\n]{NON_WS}+", "")
    return F.regexp_replace(t, rf"[^a-zA-Z0-9{WS}]", "")


def clean_for_bias(c) -> Column:
    """C4: drop URLs and every character but ASCII letters, digits and
    whitespace; strip; lower. Whitespace is kept as it is."""
    return F.lower(strip(_strip_urls_and_punct(F.coalesce(_c(c), F.lit("")))))


def clean_for_keywords(c) -> Column:
    """C4 with whitespace runs collapsed to one space."""
    t = _strip_urls_and_punct(F.coalesce(_c(c), F.lit("")))
    return F.lower(strip(F.regexp_replace(t, WS_RUN, " ")))


def tokens(c) -> Column:
    """C6 (in-row form): word tokens of the lower-cased text."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(c), F.lit(""))), F.lit(TOKEN), 0)


def too_short(c, min_len: int, stripped: bool = True) -> Column:
    """F1 guard: NULL/empty, or (stripped) length below ``min_len``."""
    x = F.coalesce(_c(c), F.lit(""))
    n = F.length(strip(x)) if stripped else F.length(x)
    return n < F.lit(min_len)


def truncate_words(c, max_words: int) -> Column:
    """more than ``max_words`` whitespace-separated words -> the first
    ``max_words`` joined by single spaces; otherwise the text unchanged."""
    x = _c(c)
    words = F.filter(F.split(x, WS_RUN), lambda w: w != F.lit(""))
    return F.when(F.size(words) > max_words,
                  F.array_join(F.slice(words, 1, max_words), " ")).otherwise(x)


def count_substr(c, needle: str) -> Column:
    """Non-overlapping occurrences of ``needle`` (``str.count``)."""
    x = F.coalesce(_c(c), F.lit(""))
    if not needle:
        return F.length(x) + 1
    removed = F.length(x) - F.length(F.replace(x, F.lit(needle), F.lit("")))
    return (removed / F.lit(len(needle))).cast("long")
