"""Sinks read back; feed parsing; streaming restart behaviour."""

import shutil

from pyspark.sql import functions as F

FEED_A = """<rss version="2.0"><channel><title>Feed A</title>
<item><title> One </title><link>http://x/1</link><description>&lt;p&gt;Hi &lt;b&gt;there&lt;/b&gt;&lt;/p&gt;</description><pubDate>Tue, 22 Jul 2025 10:00:00 +0000</pubDate></item>
<item><title>Two</title><link>http://x/2</link><description>d</description><pubDate>Tue, 22 Jul 2025 11:00:00 +0000</pubDate></item>
</channel></rss>"""
FEED_B = """<rss version="2.0"><channel>
<item><title>Again</title><link>http://x/1</link><description>something else entirely new</description><pubDate>bad date</pubDate></item>
</channel></rss>"""


def test_sinks_read_back(spark, tmp_path):
    from newsframe.sinks import sink_csv, sink_jsonl, sink_table_summaries, duplicate_ids
    df = spark.createDataFrame([("s1", 0.5, ["a", "b"]), ("s2", 0.7, [])],
                               "summary string, credibility double, keywords array<string>")
    sink_jsonl(df, str(tmp_path / "j"))
    back = spark.read.json(str(tmp_path / "j"))
    assert back.count() == 2 and "timestamp" in back.columns
    sink_csv(df, str(tmp_path / "c"))
    sink_csv(df, str(tmp_path / "c"))
    back = spark.read.option("header", True).csv(str(tmp_path / "c"))
    assert back.count() == 4 and {r.keywords for r in back.collect()} == {"a,b", None}
    sink_table_summaries(df, str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2 and duplicate_ids(stored).count() == 0


def test_router_reaches_the_summaries(spark, tmp_path):
    from newsframe.sinks import sink_router
    df = spark.createDataFrame([("s1", 0.5, ["a", "b"])], "summary string, credibility double, keywords array<string>")
    for _ in range(2):
        sink_router(df, "summaries", str(tmp_path / "t"))
    stored = spark.read.parquet(str(tmp_path / "t"))
    assert stored.count() == 2 and stored.select("id").distinct().count() == 2


def test_feed_entries(spark, tmp_path):
    from newsframe.sources.feeds import read_rss, rss_entries
    d = tmp_path / "feeds"
    d.mkdir()
    (d / "a.xml").write_text(FEED_A)
    (d / "b.xml").write_text(FEED_B)
    rows = {(r.title, r.link): r for r in rss_entries(read_rss(spark, str(d))).collect()}
    one = rows[("One", "http://x/1")]
    assert one.summary == "Hi there" and one.source == "Feed A"
    assert str(one.published_ts) == "2025-07-22 10:00:00"
    again = rows[("Again", "http://x/1")]
    assert again.source == "Unknown" and again.published_ts is None and again.published == "bad date"


def _run_stream(spark, src, out, name, dedup_links):
    from newsframe.streaming.feeds import feed_stream
    q = feed_stream(spark, str(src), str(out), name=name, dedup_links=dedup_links)
    q.awaitTermination(120)


def test_feed_stream_restart(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.xml").write_text(FEED_A)
    for dedup, expected in ((False, 2), (True, 1)):
        out = tmp_path / f"out{dedup}"
        name = f"{tmp_path.name}-{dedup}"
        _run_stream(spark, src, out, name, dedup)
        # restart with nothing new: no poll is stored twice
        _run_stream(spark, src, out, name, dedup)
        assert spark.read.parquet(str(out)).filter(F.col("link") == "http://x/1").count() == 1
        (src / f"b{dedup}.xml").write_text(FEED_B)
        _run_stream(spark, src, out, name, dedup)
        got = spark.read.parquet(str(out)).filter(F.col("link") == "http://x/1").count()
        assert got == expected
        shutil.move(str(src / f"b{dedup}.xml"), str(tmp_path / f"done{dedup}.xml"))


def test_stream_scores_match_batch(spark, tmp_path):
    from newsframe.streaming.feeds import stream_scores
    rows = [(1, "Shocking!!! Rumor says it is clearly a disaster."), (2, "short"),
            (3, "A calm and factual report according to officials. " * 3)]
    src = tmp_path / "docs"
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(src))
    stream = spark.readStream.schema("doc_id long, text string").parquet(str(src))
    q = stream_scores(stream).writeStream.format("memory").queryName("t3_scores").start()
    q.processAllAvailable()
    q.stop()
    got = sorted(tuple(r) for r in spark.sql("SELECT * FROM t3_scores").collect())
    want = sorted(tuple(r) for r in stream_scores(spark.read.parquet(str(src))).collect())
    assert got == want and len(got) == 3


ATOM = """<feed xmlns="http://www.w3.org/2005/Atom"><title>Atom Feed</title>
<entry><title>A1</title><link href="http://y/1"/><content>&lt;p&gt;Body &lt;i&gt;text&lt;/i&gt;&lt;/p&gt;</content>
<updated>2025-07-22T10:00:00Z</updated></entry>
<entry><title>A2</title><link href="http://y/2"/><summary>Short summary</summary><content>ignored</content>
<published>2025-07-22T11:00:00Z</published></entry>
</feed>"""


def test_atom_entries(spark, tmp_path):
    from newsframe.sources.feeds import atom_entries, read_atom
    d = tmp_path / "atom"
    d.mkdir()
    (d / "a.xml").write_text(ATOM)
    rows = {r.title: r for r in atom_entries(read_atom(spark, str(d))).collect()}
    assert rows["A1"].summary == "Body text" and rows["A1"].link == "http://y/1"
    assert rows["A2"].summary == "Short summary" and rows["A2"].source == "Atom Feed"
    assert str(rows["A2"].published_ts) == "2025-07-22 11:00:00"
