"""DuckDB spellings of the column functions, used to write the oracle SQL
(an independent formulation of each query, checked side by side)."""

from __future__ import annotations

from newsframe.functions.text import TOKEN, WS

NODE_SEP_SQL = "chr(1)"


def q(s: str) -> str:
    """SQL string literal."""
    return "'" + s.replace("'", "''") + "'"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[{WS}]+|[{WS}]+$', '', 'g')"


def pyround(x: str, d: int) -> str:
    """By way of the printed decimal, which rounds the exact binary value."""
    return f"CAST(format('{{:.{d}f}}', ({x})) AS DOUBLE)"


def count_substr(x: str, needle: str) -> str:
    return f"((length({x}) - length(replace({x}, {q(needle)}, ''))) // {len(needle)})"


def normalize(x: str) -> str:
    t = f"regexp_replace({x}, '[{WS}]+', ' ', 'g')"
    t = f"regexp_replace({t}, '[\\x00-\\x1F\\x7F]', '', 'g')"
    return strip(t)


def strip_urls_punct(x: str) -> str:
    t = f"regexp_replace({x}, 'http[^{WS}]+|www[^\\n][^{WS}]+', '', 'g')"
    return f"regexp_replace({t}, '[^a-zA-Z0-9{WS}]', '', 'g')"


def clean_bias(x: str) -> str:
    t = strip_urls_punct("coalesce(" + x + ", '')")
    return "lower(" + strip(t) + ")"


def clean_keywords(x: str) -> str:
    t = strip_urls_punct("coalesce(" + x + ", '')")
    t = "regexp_replace(" + t + ", '[" + WS + "]+', ' ', 'g')"
    return "lower(" + strip(t) + ")"


def tokens(x: str) -> str:
    return f"regexp_extract_all(lower(coalesce({x}, '')), '{TOKEN}')"


def decode_entities(x: str) -> str:
    from newsframe import lexicons as L
    out = x
    for ent, ch in L.HTML_ENTITIES:
        rep = f"chr({ord(ch)})" if ord(ch) > 127 or ch in "'" else q(ch)
        out = f"replace({out}, {q(ent)}, {rep})"
    return out
