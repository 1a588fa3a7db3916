"""Feeds of both kinds, history across polls, per-document scores on streams, global
ranks, tables stored once, model backends, dense vectors, large cue lists."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from newsframe import sinks
from newsframe.operators import cues, summarize, vectors
from newsframe.operators.keywords import keywords_embedding
from newsframe.sources.feeds import feed_entries
from newsframe.sources.store import with_global_rank
from newsframe.streaming import feeds as ST
from test_history import variants

RSS = """<rss version="2.0" xmlns:content="http://purl.org/rss/1.0/modules/content/"><channel><title>R</title>
{items}</channel></rss>"""
ITEM = "<item><title>{t}</title><link>http://x/{t}</link>{body}<pubDate>Tue, 22 Jul 2025 10:00:00 +0000</pubDate></item>"
ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>A</title>
<entry><title>A1</title><link rel="edit" href="http://y/edit"/><link rel="alternate" href="http://y/1"/>
<link rel="self" href="http://y/self"/><content type="html">&lt;p&gt;Body&lt;/p&gt;</content></entry>
<entry><title>A2</title><link href="http://y/2"/><summary>S</summary></entry>
<entry><title>A3</title><link rel="enclosure" href="http://y/3.mp3"/><summary>T</summary></entry>
<entry><title>A4</title><summary>U</summary></entry></feed>"""


def rss(path, items):
    path.write_text(RSS.format(items="".join(ITEM.format(t=t, body=b) for t, b in items)))


def described(text):
    return f"<description>{text}</description>"


def test_both_kinds_of_feeds_in_one_folder(spark, tmp_path):
    rss(tmp_path / "r.xml", [("R1", described("plain")), ("R2", "<content:encoded>&lt;p&gt;Full &lt;b&gt;text&lt;/b&gt;&lt;/p&gt;</content:encoded>"),
                             ("R3", "<description></description><content:encoded>C</content:encoded>")])
    (tmp_path / "a.xml").write_text(ATOM)
    got = {r["title"]: r for r in feed_entries(spark, str(tmp_path)).collect()}
    assert {t: (r["link"], r["summary"], r["source"]) for t, r in got.items()} == {
        "R1": ("http://x/R1", "plain", "R"), "R2": ("http://x/R2", "Full text", "R"), "R3": ("http://x/R3", "C", "R"),
        "A1": ("http://y/1", "Body", "A"), "A2": ("http://y/2", "S", "A"), "A3": ("http://y/3.mp3", "T", "A"),
        "A4": ("", "U", "A")}
    assert feed_entries(spark, [str(tmp_path)], "atom").count() == 4
    with pytest.raises(ValueError):
        feed_entries(spark, str(tmp_path), "json")


def test_history_drops_what_an_earlier_poll_had(spark, tmp_path):
    (base,), (near,) = variants(1, 0, 1, 300), variants(1, 3, 1, 300)
    other = variants(1, 0, 77, 300)[0][1]
    src, out = tmp_path / "in", str(tmp_path / "out")
    src.mkdir()

    def poll():
        ST.feed_stream(spark, str(src), out, name=f"{tmp_path.name}-h", history=str(tmp_path / "history")).awaitTermination(300)
        return sorted(r["title"] for r in spark.read.parquet(out).collect())

    rss(src / "1.xml", [("first", described(base[1])), ("second", described("something quite short"))])
    assert poll() == ["first", "second"]
    # three words changed, an exact copy, and news; a copy of a dropped entry within the poll
    rss(src / "2.xml", [("near", described(near[1])), ("copy", described("something quite short")), ("news", described(other))])
    assert poll() == ["first", "news", "second"]
    assert poll() == ["first", "news", "second"]        # restart: nothing new
    # an atom feed joins the next poll; it repeats what poll 2 had dropped
    (src / "3.xml").write_text(f"<feed><title>A</title><entry><title>again</title><summary>{near[1]}</summary></entry></feed>")
    assert poll() == ["first", "news", "second"]


def test_replayed_poll_changes_nothing(spark, tmp_path):
    from newsframe.operators.history import DuplicateHistory
    h = DuplicateHistory(spark, str(tmp_path / "h"), text_col="text", id_col="doc_id")
    one = spark.createDataFrame([("a", variants(1, 0, 1, 200)[0][1]), ("b", None), ("c", "")], "doc_id string, text string")
    two = spark.createDataFrame([("d", variants(1, 2, 1, 200)[0][1]), ("e", ""), ("f", "brand new words")], "doc_id string, text string")
    assert {r["doc_id"] for r in h.fresh(one, 0).collect()} == {"a", "b", "c"}
    for _ in range(2):
        assert {r["doc_id"] for r in h.fresh(two, 1).collect()} == {"f"}
        assert {r["doc_id"] for r in h.fresh(one, 0).collect()} == {"a", "b", "c"}
        assert spark.read.parquet(str(tmp_path / "h" / "copies")).count() == 5
    late = spark.createDataFrame([("g", "brand new words"), ("i", variants(1, 0, 1, 200)[0][1])], "doc_id string, text string")
    near = DuplicateHistory(spark, str(tmp_path / "h"), text_col="text", id_col="doc_id", horizon=1)
    # the horizon leaves poll 0 out, but poll 1 had a variant of its text
    assert {tuple(r) for r in near.repeats(late, near.index(late, 2) or 2).collect()} == {("g", "f"), ("i", "d")}


def test_document_scores_on_a_stream_equal_the_batch(spark, tmp_path):
    rng = random.Random(3)
    words = ["good", "bad", "not", "very", "alpha", "beta", "gamma", "delta", "shocking"]
    rows = [(i, " ".join(rng.choices(words, k=40)) + "!!") for i in range(12)] + [(50, None), (51, "")]
    lex = spark.createDataFrame([("good", 0.7), ("bad", -0.7)], "word string, polarity double")
    vec = spark.createDataFrame([(w, [float(i), 1.0, -float(i * i)]) for i, w in enumerate(words)], "key string, vec array<double>")
    scorers = ST.document_scorers(lex, None, vec, ["not"])
    schema = "doc_id long, text string"
    src = tmp_path / "src"
    out = str(tmp_path / "out")
    for part in (rows[:7], rows[7:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(str(src))
        for _ in range(2):      # the second run finds nothing new
            stream = spark.readStream.schema(schema).parquet(str(src))
            ST.score_stream(stream, scorers, out, f"{tmp_path.name}-scores").awaitTermination(300)
    batch = spark.createDataFrame(rows, schema)
    for name, scorer in scorers.items():
        got = spark.read.parquet(f"{out}/{name}").drop("batch_id")
        want = scorer(batch)
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect())), name


def test_global_rank_is_exact(spark):
    rows = [(i, None if i % 9 == 0 else i % 4) for i in range(500)]
    df = spark.createDataFrame(rows, "id long, day int").repartition(5)
    got = with_global_rank(df, [F.col("day").desc_nulls_last(), F.col("id").asc()], parts=7).collect()
    want = sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))
    assert [(r["id"], r["day"]) for r in sorted(got, key=lambda r: r["rank"])] == want
    assert sorted(r["rank"] for r in got) == list(range(1, 501))


def test_rows_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("u1", "s1", 0.5, ["a", "b"]), ("u2", "s2", 0.7, None)],
                               "url string, summary string, credibility double, keywords array<string>")
    path = str(tmp_path / "articles")
    assert sinks.sink_articles_once(df, path, "run-1") == 2
    assert sinks.sink_articles_once(df, path, "run-1") == 2                     # repeated job
    more = df.union(spark.createDataFrame([("u3", "s3", 0.1, [])], df.schema))
    assert sinks.sink_articles_once(more, path, "run-2") == 1                   # u1 and u2 are known
    back = sinks.committed(spark, path)
    assert sorted(r["url"] for r in back.collect()) == ["u1", "u2", "u3"]
    with pytest.raises(ValueError):
        sinks.sink_articles_once(df.union(df), path + "2", "run-1")
    with pytest.raises(ValueError):
        sinks.sink_articles_once(df, path, "../run")
    # a run that has written but not committed refuses others with its ids
    (df.withColumn("timestamp", F.current_timestamp()).withColumn("keywords", F.lit("")).withColumn("run_id", F.lit("open"))
       .withColumn("url", F.concat(F.col("url"), F.lit("x"))).write.mode("append").partitionBy("run_id").parquet(path))
    with pytest.raises(ValueError):
        sinks.sink_articles_once(df.withColumn("url", F.concat(F.col("url"), F.lit("x"))), path, "run-3")
    assert sinks.committed(spark, path).count() == 3


def test_summaries_are_stored_once(spark, tmp_path):
    df = spark.createDataFrame([("same", 0.5, ["a"]), ("same", 0.5, ["a"]), ("other", 0.7, [])],
                               "summary string, credibility double, keywords array<string>")
    for _ in range(2):
        assert sinks.sink_summaries_once(df, str(tmp_path / "t"), "r") == 3
    stored = sinks.committed(spark, str(tmp_path / "t"))
    assert stored.count() == 3 and sinks.duplicate_ids(stored).count() == 0


def test_every_router_mode(spark, tmp_path):
    df = spark.createDataFrame([("i", "s1", 0.5, ["a", "b"], "2025")],
                               "id string, summary string, credibility double, keywords array<string>, created_at string")
    for mode, family, fmt in (("json", "api", "json"), ("csv", "api", "csv"), ("db", "api", "parquet"), ("txt", "api", "text"),
                              ("db", "cli", "parquet"), ("json", "cli", "json"), ("txt", "cli", "text"),
                              ("table", "api", "parquet"), ("format:orc", "api", "orc")):
        out = str(tmp_path / f"{family}-{mode.replace(':', '-')}")
        sinks.sink_router(df, mode, out, family=family)
        back = spark.read.option("header", fmt == "csv").format(fmt).load(out)
        assert back.count() == (6 if fmt == "text" else 1), mode
        if mode == "db":
            assert ("id" in back.columns) == (family == "cli")
    text = [r["value"] for r in spark.read.text(str(tmp_path / "api-txt")).collect()]
    assert text[0] == "=== Summary ID: i ===" and text[3] == "Credibility Score: 0.50" and text[4] == "Keywords: a, b"
    for mode, family in (("nope", "api"), ("csv", "cli"), ("mongo", "cli"), ("json", "web")):
        with pytest.raises(ValueError):
            sinks.sink_router(df, mode, str(tmp_path / "none"), family=family)
    with pytest.raises(ValueError, match="class path"):      # no such data source here
        sinks.sink_router(df, "mongo", str(tmp_path / "none"))
    assert not (tmp_path / "none").exists()


def test_a_backend_is_loaded_once_per_task(spark, tmp_path):
    loads = str(tmp_path)

    def factory():
        import uuid
        open(f"{loads}/{uuid.uuid4().hex}", "w").close()
        return summarize.lead_backend(1)

    rows = [(f"id{i}", f"Text number {i} is here. " * 10) for i in range(400)] + [("short", "x")]
    df = spark.createDataFrame(rows, "doc_id string, text string").coalesce(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "20")
    try:
        got = {r["doc_id"]: (r["summary"], r["status"]) for r in summarize.summarize(df, factory=factory).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert len(list(tmp_path.iterdir())) == 2 and len(got) == 401
    assert got["id7"] == ("Text number 7 is here.", "ok") and got["short"][1] == "short"


def test_dense_vectors_and_string_ids(spark):
    vec = spark.createDataFrame([("up", [0.0, 2.0]), ("right", [3.0, 0.0]), ("left", [-3.0, 0.0])], "key string, vec array<double>")
    rows = [("a", "up up right"), ("b", None), ("c", "nothing known"), ("d", "left right"), ("e", "Up")]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    got = {r["doc_id"]: r["embedding"] for r in vectors.embed_texts_dense(df, vec).collect()}
    assert np.allclose(got["a"], [0.6, 0.8]) and np.allclose(got["e"], [0, 1])
    assert got["b"] is None and got["c"] is None and got["d"] is None
    wide = spark.createDataFrame([("up", [0.0] * 300 + [2.0])], "key string, vec array<double>")
    assert np.allclose(next(r["embedding"] for r in vectors.embed_texts_dense(df, wide).collect() if r["doc_id"] == "a"), [0.0] * 300 + [1.0])
    kw = {r["doc_id"]: r["keywords"] for r in keywords_embedding(df, vec, ["right"]).collect()}
    assert kw == {"a": ["up"], "b": [], "c": [], "d": ["left"], "e": ["up"]}

    def factory():
        return lambda texts: np.array([[len(t), 0.0] for t in texts])

    got = {r["doc_id"]: r["embedding"] for r in vectors.embed_with_model(df, factory).collect()}
    assert got["a"] == [1.0, 0.0] and got["b"] is None


def test_large_cue_lists_equal_the_sum(spark):
    rng = random.Random(6)
    letters = "abcdeé "
    listed = {"".join(rng.choices("abcde ", k=rng.randrange(1, 9))).strip() for _ in range(20000)} - {""}
    rows = [(i, "".join(rng.choices(letters, k=rng.randrange(0, 400)))) for i in range(300)] + [(900, None), (901, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    table = spark.createDataFrame([(c,) for c in sorted(listed)] + [("",), (None,)], "cue string")
    got = {r["doc_id"]: r["cue_count"] for r in cues.bias_cue_count(df, table).collect()}
    from newsframe.functions import text as T
    clean = {r["doc_id"]: r["t"] for r in df.select("doc_id", T.clean_for_bias("text").alias("t")).collect()}
    assert got == {i: sum(t.count(c) for c in listed) for i, t in clean.items()}

    def size(n):
        few = spark.createDataFrame([(c,) for c in sorted(listed)[:n]], "cue string")
        return len(cues.bias_cue_count(df, few)._jdf.queryExecution().optimizedPlan().treeString().split("\n"))

    assert size(10) == size(5000)
