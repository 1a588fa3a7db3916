"""Goldens for URL folding, character references, the stream's link filter
and the summarizer's cuts."""

from html import unescape
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import functions as F

from newsframe.functions import scores as S
from newsframe.functions.html import resolve_url
from newsframe.functions.text import decode_entities, pyround
from newsframe.operators.summarize import summarize
from newsframe.sources.feeds import with_entry_id
from newsframe.streaming.feeds import feed_stream


def test_resolve_url_folds_any_depth(spark):
    base = "https://h/a/b/c/d/e/f"
    refs = ["../../../../../x", "././x", "..", "x/..", "x/.", "../../../../../../../../y", "/a/../../z", "x/../y?p=../q",
            "a//b/../c", "...", "..x/y", "/"]
    df = spark.createDataFrame([(r,) for r in refs], "r string").select("r", resolve_url(F.lit(base), F.col("r")).alias("u"))
    for r in df.collect():
        assert r["u"] == urljoin(base, r["r"]), r["r"]


def test_character_references_in_one_pass(spark):
    texts = ["&rsquo;&mdash;&eacute;&hellip;", "&#38;lt;", "&#9999999;", "&#xD800;", "&#00000039;", "&#0;", "&#x1F600;",
             "&amp;#39;", "&nosuch; & &;", "&#99999999999999999999;", "a&lt;b", None]
    want = [None if t is None else {"&#xD800;": "�", "&#0;": "�"}.get(t) or unescape(t) for t in texts]
    got = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select(
        "i", decode_entities(F.col("t")).alias("d")).orderBy("i").collect()
    assert [r["d"] for r in got] == want


def channel(title, items):
    body = "".join(f"<item><title>{t}</title><link>{u}</link><description>{d}</description><pubDate>{p}</pubDate></item>"
                   for t, u, d, p in items)
    return f"<channel><title>{title}</title>{body}</channel>"


def test_link_filter_keeps_every_distinct_entry(spark, tmp_path):
    feeds, out = tmp_path / "feeds", str(tmp_path / "out")
    feeds.mkdir()
    polls = [[("Far", "http://x/1", "far future", "Tue, 22 Jul 2099 10:00:00 +0000")],
             [("New", "http://x/2", "a new one", "Tue, 22 Jul 2025 10:00:00 +0000"),
              ("Old", "http://x/3", "an old one", "Tue, 22 Jul 2003 10:00:00 +0000"),
              ("NoLink", "", "first without link", ""), ("NoLink2", "", "second without a link", ""),
              ("Far", "http://x/1", "far future", "Tue, 22 Jul 2099 10:00:00 +0000")]]
    for i, items in enumerate(polls):
        (feeds / f"{i}.xml").write_text(f'<rss version="2.0">{channel("A", items)}</rss>')
        q = feed_stream(spark, str(feeds), out, name=f"t2-{tmp_path.name}", dedup_links=True)
        q.awaitTermination(120)
    assert sorted(r["title"] for r in spark.read.parquet(out).collect()) == ["Far", "New", "NoLink", "NoLink2", "Old"]


def test_entry_ids_tell_channels_of_one_file_apart(spark):
    rows = [("f", 0, "A", "t", "u", "s", ""), ("f", 0, "B", "t2", "u2", "s2", "")]
    e = with_entry_id(spark.createDataFrame(rows, "feed string, pos long, source string, title string, link string, "
                                                  "summary string, published string"))
    assert e.select("entry_id").distinct().count() == 2


def test_each_backend_gets_its_own_cut(spark):
    def count(texts):
        n = texts.str.split().map(len)
        return n.astype(str), n <= 1024

    df = spark.createDataFrame([("a", "w " * 5000), ("b", "w " * 500), ("c", "short")], "id string, text string")
    got = {r["id"]: (r["summary"], r["status"]) for r in summarize(df, id_col="id", backend=count, fallback=count).collect()}
    assert got["a"] == ("1024", "fallback") and got["b"] == ("500", "ok") and got["c"][1] == "short"
    first = summarize(df, id_col="id", backend=lambda t: (t.str.split().map(len).astype(str), pd.Series(True, index=t.index)))
    assert {r["id"]: r["summary"] for r in first.collect()}["a"] == "3000"
    assert summarize(df, id_col="id").where("status = 'ok'").count() == 2


def test_rounding_is_pythons(spark):
    ties = [i / 1000 for i in range(-2000, 12001)] + [i / 8 for i in range(-80, 80)] + [1.115, 2.675, 0.0, 1e-9, 99.995]
    df = spark.createDataFrame([(x,) for x in ties], "x double")
    got = df.select("x", *(pyround("x", d).alias(f"r{d}") for d in (2, 4, 6))).collect()
    assert [[r["r2"], r["r4"], r["r6"]] for r in got] == [[round(r["x"], d) for d in (2, 4, 6)] for r in got]
    nulls = spark.createDataFrame([(None,), (float("nan"),)], "x double").select(pyround("x", 2).alias("r")).collect()
    assert nulls[0]["r"] is None and nulls[1]["r"] != nulls[1]["r"]


def test_scores_round_like_the_plain_formulas(spark):
    grid = [(c, p / 1000) for c in range(0, 6) for p in range(-1000, 1001)]
    df = spark.createDataFrame(grid, "c long, p double")
    for r in df.select("c", "p", S.bias_score(F.col("c"), F.col("p")).alias("b"), S.sentiment_score(F.col("p")).alias("s")).collect():
        assert r["b"] == round(r["c"] * 0.7 + abs(r["p"]) * 10 * 0.3, 2)
        assert r["s"] == round((r["p"] + 1) * 5, 2)
