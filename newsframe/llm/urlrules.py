"""URL filter by association rules (operator 5).

Explicit (host, path) rules judge the urls they fit; the longest wins. The
urls they judge are the labelled rows from which Spark's FP-growth mines
combinations of url tokens that lead to ``block``. Rules under the confidence
or support limit go, and so does any rule that a part of its tokens already
justifies as well. The others judge the remaining urls: an inverted index
holds each rule under its rarest token, and a url is blocked if a rule found
through one of its tokens has all its tokens in the url.

Sizes: tokens are taken from the whole url. Only tokens that reach the support
limit among the blocked labelled rows (an exact count) can be in a rule and are
mined: at most the mean number of a url's tokens / support. Tokens that the
same labelled rows have are mined as one, since each alone justifies what they
justify together; so a long common path does not multiply the itemsets. Urls
with equal kept tokens are matched once.

Defined cases: null urls and urls without ``://`` have empty host and path and
no tokens, and are allowed; without labelled rows of both kinds there are no
mined rules and every unjudged url is allowed; rows that repeat an id are
judged one by one; an empty table gives an empty result. Extra columns are
ignored.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.session import written_table

#: (host, path, verdict); a rule fits its host and all subdomains.
RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"),
         ("com", "/fr/", "allow"), ("com", "/de/", "block")]
MIN_SUPPORT = 0.01      # share of the labelled rows
MIN_ROWS = 5            # labelled rows, at least
MIN_CONFIDENCE = 0.9
BLOCK = "=block"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ``://``; empty without one."""
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(_rest(url), r"^[^/?#]*", 0), _UPPER, _LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def explicit(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits the columns host and path."""
    rule = verdict = None
    for h, p, v in sorted(rules, key=lambda r: (-len(r[0] + r[1]), r)):
        fits = ((F.col("host") == h) | F.col("host").endswith("." + h)) & F.col("path").startswith(p)
        rule = F.when(fits, h + p) if rule is None else rule.when(fits, h + p)
        verdict = F.when(fits, v) if verdict is None else verdict.when(fits, v)
    return rule, verdict


def tokens(url: Column) -> Column:
    """The distinct tokens of the columns host and path and of the url: host
    labels with their place from the right, path segments with their place
    (numbers by first digit and size), a file ending, query keys, query keys
    with their values, and whether there is a fragment."""
    labels = F.reverse(F.split("host", r"\."))
    segs = F.filter(F.split("path", "/"), lambda s: s != "")
    plain = F.transform(segs, lambda s, i: F.concat(
        F.lit("p"), i.cast("string"), F.lit(":"),
        F.when(s.rlike(r"^\d"), F.concat(F.lit("#"), F.length(F.regexp_extract(s, r"^\d+", 0)).cast("string")))
         .otherwise(s)))
    first = F.transform(F.filter(segs, lambda s: s.rlike(r"^\d")), lambda s: F.concat(F.lit("d:"), F.substring(s, 1, 1)))
    query = F.regexp_extract(_rest(url), r"^[^?#]*\?([^#]*)", 1)
    pairs = F.filter(F.split(query, "&"), lambda k: k != "")
    keys = F.transform(pairs, lambda k: F.concat(F.lit("q:"), F.substring_index(k, "=", 1)))
    values = F.transform(F.filter(pairs, lambda k: k.contains("=")), lambda k: F.concat(F.lit("v:"), k))
    ending = F.regexp_extract("path", r"\.([A-Za-z0-9]{1,5})$", 1)
    extra = F.array(F.when(ending != "", F.concat(F.lit("e:"), ending)),
                    F.when(_rest(url).contains("#"), F.lit("fragment")))
    return F.array_distinct(F.concat(
        F.transform(F.filter(labels, lambda x: x != ""), lambda x, i: F.concat(F.lit("h"), i.cast("string"), F.lit(":"), x)),
        plain, first, keys, values, F.array_compact(extra)))


def frequent(labelled: DataFrame, min_support: float = MIN_SUPPORT) -> dict[str, str]:
    """Token -> the token that stands for it, for all tokens with enough blocked
    labelled rows; the tokens of the same labelled rows have one that stands
    for them."""
    least = max(min_support * labelled.count(), MIN_ROWS)
    mark = F.pmod(F.xxhash64("tokens", "verdict"), F.lit(1 << 40))
    rows = (labelled.select(F.explode("tokens").alias("token"), "verdict", mark.alias("mark")).groupBy("token")
                    .agg(F.count("*").alias("n"), F.sum(F.col("mark").cast("decimal(38,0)")).alias("marks"),
                         F.count_if(F.col("verdict") == "block").alias("blocked"))
                    .where(F.col("blocked") >= least - 1e-6).orderBy("token").collect())
    stands: dict[tuple, str] = {}
    return {r["token"]: stands.setdefault((r["n"], r["marks"]), r["token"]) for r in rows}


def kept(stands: dict[str, str]) -> Column:
    """The column tokens with only the keys of ``stands``, replaced by what
    stands for them, in order."""
    if not stands:
        return F.array().cast("array<string>")
    out = F.array_intersect("tokens", F.array(*map(F.lit, stands)))
    if moved := [x for t, r in stands.items() if t != r for x in (F.lit(t), F.lit(r))]:
        out = F.transform(out, lambda t: F.coalesce(F.try_element_at(F.create_map(*moved), t), t))
    return F.array_sort(F.array_distinct(out))


def mine(labelled: DataFrame, min_support: float = MIN_SUPPORT, min_confidence: float = MIN_CONFIDENCE) -> DataFrame | None:
    """Pruned rules (id, items, first, confidence, support) that lead to
    ``block``; ``first`` is the rule's rarest token. ``labelled``: (tokens,
    verdict). None without rows of both kinds."""
    counts = {r["verdict"]: r["count"] for r in labelled.groupBy("verdict").count().collect()}
    if not counts.get("block") or not counts.get("allow"):
        return None
    n = sum(counts.values())
    rows = labelled.select(F.when(F.col("verdict") == "block", F.array_append("tokens", F.lit(BLOCK)))
                            .otherwise(F.col("tokens")).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=min(1.0, max(min_support, MIN_ROWS / n)),
                     minConfidence=min_confidence).fit(rows)
    found = written_table(model.associationRules.where(F.col("consequent")[0] == BLOCK)
                          .select(F.array_sort("antecedent").alias("items"), "confidence", "support"), "url-found")
    freq = (rows.select(F.explode("items").alias("item")).groupBy("item").count()
                .join(found.select(F.explode("items").alias("item")).distinct(), "item", "left_semi"))
    rarest = (found.select("items", F.explode("items").alias("item")).join(freq, "item")
                   .groupBy("items").agg(F.min(F.struct("count", "item"))["item"].alias("first")))
    found = written_table(found.join(rarest, "items").withColumn("id", F.xxhash64("items")), "url-rules")
    # a rule goes if another one with a part of its tokens is as confident
    part = found.select(F.col("items").alias("less"), F.col("first").alias("token"), F.col("confidence").alias("c"))
    idle = (found.select("id", "items", "confidence", F.explode("items").alias("token")).join(part, "token")
                 .where((F.size("less") < F.size("items")) & (F.col("c") >= F.col("confidence"))
                        & (F.size(F.array_except("less", "items")) == 0)).select("id").distinct())
    return written_table(found.join(idle, "id", "left_anti"), "url-pruned")


def match(sets: DataFrame, rules: DataFrame) -> DataFrame:
    """The token sets (tokens) that a rule fits, by inverted index."""
    index = rules.select(F.col("first").alias("token"), "items")
    return (sets.select("tokens", F.explode("tokens").alias("token")).join(index, "token")
                .where(F.size(F.array_except("items", "tokens")) == 0).select("tokens").distinct())


def judge(pages: DataFrame, rules=RULES, min_support: float = MIN_SUPPORT,
          min_confidence: float = MIN_CONFIDENCE) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of ``pages``."""
    url = F.col("url").cast("string")
    p = pages.select("page_id", url.alias("url")).withColumns({
        "host": F.coalesce(host(F.col("url")), F.lit("")), "path": F.coalesce(path(F.col("url")), F.lit(""))})
    rule, verdict = explicit(rules)
    p = p.withColumns({"rule": rule, "verdict": verdict, "tokens": F.coalesce(tokens(F.col("url")), F.array())})
    p = written_table(p.drop("url"), "url-tokens")
    labelled = p.where("verdict IS NOT NULL").select("tokens", "verdict")
    stands = frequent(labelled, min_support)
    mined = mine(labelled.select(kept(stands).alias("tokens"), "verdict"), min_support, min_confidence)
    if mined is None:
        return p.select("page_id", "host", "path", "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"))
    known = {r["item"] for r in mined.select(F.explode("items").alias("item")).distinct().collect()}  # frequent tokens
    p = p.withColumn("tokens", kept({t: r for t, r in stands.items() if r in known}))
    sets = p.where("verdict IS NULL").select("tokens").distinct()
    hit = written_table(match(sets, mined), "url-hit").withColumn("hit", F.lit("block"))
    return (p.join(hit, "tokens", "left")
             .select("page_id", "host", "path", "rule", F.coalesce("verdict", "hit", F.lit("allow")).alias("verdict")))
