"""Lead summary (M1) as a column expression."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.functions.text import _c, strip

SENT_SEP = "\u0002"


def sentences(text) -> Column:
    """Split after '.', '!' or '?' at the run of spaces that follows."""
    marked = F.regexp_replace(F.coalesce(_c(text), F.lit("")), r"([.!?]) +", "$1" + SENT_SEP)
    return F.split(marked, SENT_SEP)


def summary_lead(text, k: int = L.LEAD_SENTENCES) -> Column:
    """M1: first ``k`` sentences joined with one space, stripped."""
    return strip(F.array_join(F.slice(sentences(text), 1, k), " "))
