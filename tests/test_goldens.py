"""Hand-made goldens (FIXTURES.md section 4)."""

import pytest
from pyspark.sql import functions as F

from newsframe.functions import html as H
from newsframe.functions import keywords as KWF
from newsframe.functions import scores as S
from newsframe.functions import summary as M
from newsframe.functions import text as T
from newsframe.operators import credibility as C
from newsframe.operators import dedup as D
from newsframe.operators import keywords as KO
from newsframe.operators import polarity as P


def one(spark, col, value):
    return spark.createDataFrame([(value,)], "x string").select(col.alias("r")).first()["r"]


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_credibility_goldens(spark):
    d = docs(spark, ["Shocking!!! You won't believe it", "",
                     " ".join(f"w{i}" for i in range(398)) + " according to",
                     " ".join(f"w{i}" for i in range(400))])
    r = {x.doc_id: x.credibility for x in C.credibility_heuristic(d).collect()}
    assert r == {0: 0.06, 1: 0.4, 2: 1.0, 3: 0.8}


def test_top3_repetition(spark):
    text = " ".join(["a"] * 9 + ["b"] * 7 + ["c"] * 6 + ["d"] * 6 + ["e"] * 2)
    text2 = " ".join(["a"] * 6 + ["b"] * 5 + ["c"] * 5)
    r = {x.doc_id: x.repetition for x in C.top3_repetition(docs(spark, [text, text2])).collect()}
    assert r == {0: 22, 1: 6}


def test_penalty_and_bias_cues(spark):
    assert one(spark, S.credibility_penalty(F.col("x")), "Rumor: allegedly X, reportedly Y") == 70.0
    assert one(spark, S.credibility_penalty(F.col("x")), "rumor " * 11) == 0.0
    assert one(spark, S.bias_cue_count(T.clean_for_bias(F.col("x"))), "evil devil corruption") == 3


def test_polarity_goldens(spark):
    lex = P.lexicon_frame(spark, [("good", 0.7), ("bad", -0.7)])
    mods = P.modifier_frame(spark, ["not"], [("very", 1.3)])
    d = docs(spark, ["good bad", "not good", "very good", "nothing here"])
    r = {x.doc_id: round(x.polarity, 6) for x in P.polarity(d, lex, mods).collect()}
    assert r == {0: 0.0, 1: -0.35, 2: 0.91, 3: 0.0}


def test_bias_score_and_labels(spark):
    df = spark.createDataFrame([(2, 0.5), (2, -0.5)], "c long, p double")
    assert [x.s for x in df.select(S.bias_score(F.col("c"), F.col("p")).alias("s")).collect()] == [2.9, 2.9]
    lab = spark.createDataFrame([(1.99,), (2.0,), (3.99,), (4.0,)], "s double").select(
        S.bias_label(F.col("s")).alias("l")).collect()
    assert [x.l for x in lab] == ["Low Bias", "Moderate Bias", "Moderate Bias", "High Bias"]


def test_sentiment_bounds(spark):
    df = spark.createDataFrame([(-0.2,), (0.2,), (0.21,)], "p double")
    r = df.select(S.sentiment_score(F.col("p")).alias("s"), S.sentiment_label(F.col("p")).alias("l")).collect()
    assert [(x.s, x.l) for x in r] == [(4.0, "Neutral"), (6.0, "Neutral"), (6.05, "Positive")]


def test_guards(spark):
    assert one(spark, T.too_short(F.col("x"), 50), "a" * 49)
    assert not one(spark, T.too_short(F.col("x"), 50), "a" * 50)
    assert one(spark, T.too_short(F.col("x"), 100), "  " + "a" * 99 + "  ")
    assert one(spark, T.too_short(F.col("x"), 100), None)


def test_truncate(spark):
    assert one(spark, T.truncate_words(F.col("x"), 3), "a  b c d e") == "a b c"
    assert one(spark, T.truncate_words(F.col("x"), 3), "a  b c") == "a  b c"


def test_keywords_freq(spark):
    d = docs(spark, ["data lake data spark lake tool data", "café word_1 data"])
    r = {x.doc_id: x.keywords for x in KO.keywords_freq(d).collect()}
    assert r == {0: ["data", "lake", "spark", "tool"], 1: ["data"]}


def test_rake(spark):
    d = docs(spark, ["deep learning model for deep networks"])
    dd = d.select("doc_id", F.col("text").alias("_t"))
    for stop in (KO.stop_frame(spark, ["for"]), ["for"]):
        ph = {x.phrase: x.score for x in KO.rake_phrases(dd, stop).collect()}
        assert ph == {"deep learning model": 8.5, "deep networks": 4.5}


def test_postprocess(spark):
    r = one(spark, KWF.postprocess_keywords(F.split(F.col("x"), "\\|"), ["the"]), "the model|ai|model|gpu cluster")
    assert r == ["gpu cluster", "model"]
    many = "|".join(f"phrase{i:02d}" + "x" * i for i in range(12))
    r = one(spark, KWF.postprocess_keywords(F.split(F.col("x"), "\\|"), []), many)
    assert len(r) == 10 and r[0].startswith("phrase11")


def test_lead_summary(spark):
    assert one(spark, M.summary_lead(F.col("x")), "One. Two!  Three? four.Five. ") == "One. Two! Three? four.Five."
    assert one(spark, M.summary_lead(F.col("x")), "A. B. C. D. E. F.") == "A. B. C. D. E."


def test_clean_html(spark):
    html = '<script>var t="</p>";</script><p>Hi <b>you</b></p><!-- x -->'
    assert one(spark, T.clean_html(F.col("x")), html) == "Hi you"


def test_paragraph_container(spark):
    html = "<article><p>a <b>b</b> c<p>d</p><p></p>junk</article><footer>x</footer>"
    assert one(spark, H.paragraph_text_container(F.col("x"), "article"), html) == "a b c\nd\n"
    assert one(spark, H.paragraph_text_container(F.col("x"), "div", "missing"), html) == ""


def test_nested_container(spark):
    html = ('<div class="article-content"><div><p>in</p></div><p>two</p></div><p>out</p>')
    assert one(spark, H.paragraph_text_container(F.col("x"), "div", "article-content"), html) == "in\ntwo"


def test_resolve(spark):
    df = spark.createDataFrame([("https://h/a/b", "/x"), ("https://h/a/b", "//h2/y"),
                                ("https://h/a/b", "https://h/z?q=1"), ("https://h/a/b", "c/../d")],
                               "base string, href string")
    r = [x.u for x in df.select(H.strip_query(H.resolve_url(F.col("base"), F.col("href"))).alias("u")).collect()]
    assert r == ["https://h/x", "https://h2/y", "https://h/z", "https://h/a/d"]


def test_robots(spark):
    from newsframe.operators.pages import robots_filter
    urls = spark.createDataFrame([("h", "https://h/private/ok/x"), ("h", "https://h/a"), ("g", "https://g/a")],
                                 "host string, link string")
    rules = spark.createDataFrame([("h", 1, "/private", False), ("h", 2, "/private/ok", True)],
                                  "host string, seq int, prefix string, allow boolean")
    kept = {x.link for x in robots_filter(urls, rules).collect()}
    assert kept == {"https://h/a"}


def test_drop_near_duplicates_chain(spark):
    d = docs(spark, ["x y", "y z", "z w"])
    pairs = spark.createDataFrame([(0, 1, 0.95), (1, 2, 0.95)], "i long, j long, sim double")
    kept = {x.doc_id for x in D.drop_near_duplicates(d, pairs=pairs).collect()}
    assert kept == {0}


def test_exact_copies_keep_first(spark):
    rows = [(3, "same text here"), (7, "same text here"), (9, "same text here"), (4, "other words entirely")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {x.doc_id for x in D.drop_near_duplicates(d).collect()}
    assert kept == {3, 4}


def test_vector_pairs(spark):
    rows = [(0, [1.0, 0.0]), (1, [0.99, 0.141]), (2, [0.0, 1.0])]
    v = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    r = {(x.i, x.j) for x in D.similar_vector_pairs(v, 0.9, block_rows=1).collect()}
    assert r == {(0, 1)}


def test_stored_records_split(spark):
    from newsframe.sources.store import stored_records
    df = spark.createDataFrame([("a", "s", 1.0, "", None), ("b", "s", 1.0, "a,b", None)],
                               "id string, summary string, credibility double, keywords string, created_at timestamp")
    r = {x.id: (x.keywords, x["count"]) for x in stored_records(df).collect()}
    assert r == {"a": ([""], 2), "b": (["a", "b"], 2)}


def test_sink_router_unknown_mode(spark, tmp_path):
    from newsframe.sinks import sink_router
    df = spark.createDataFrame([("s", 1.0, ["k"])], "summary string, credibility double, keywords array<string>")
    with pytest.raises(ValueError):
        sink_router(df, "mongo", str(tmp_path / "x"))
    assert not (tmp_path / "x").exists()


def test_entities(spark):
    assert one(spark, T.decode_entities(F.col("x")), "&#233;t&#xE9; &#8217;x&amp;#39; &lt;b&gt;") == "été ’x&#39; <b>"
    assert one(spark, T.decode_entities(F.col("x")), "plain") == "plain"


def test_embedding_paths_agree(spark, monkeypatch):
    texts = ["alpha beta gamma delta alpha beta", "gamma delta epsilon zeta eta theta", "the of and"]
    d = docs(spark, texts)
    vocab = sorted({w for t in texts for w in t.split()})
    vec = spark.createDataFrame([(w, [float((i * 7 + k) % 5) - 2.0 for k in range(4)]) for i, w in enumerate(vocab)],
                                "key string, vec array<float>")
    a = {r.doc_id: r.keywords for r in KO.keywords_embedding(d, vec, ["the", "of", "and"], top_n=3).collect()}
    monkeypatch.setattr(KO, "VECTOR_BROADCAST_MAX_VALUES", 0)
    b = {r.doc_id: r.keywords for r in KO.keywords_embedding(d, vec, ["the", "of", "and"], top_n=3).collect()}
    assert a == b and a[2] == [] and len(a[0]) == 3


def test_copies_and_representatives(spark):
    rows = [(i, "hot text") for i in range(10, 40)] + [(i, f"cold {i}") for i in range(5)] + [(50, "cold 1")]
    rows += [(60, None), (61, ""), (62, "!?")]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.rep for r in D.exact_copies(d).collect()}
    assert got == {i: 10 for i in range(11, 40)} | {50: 1, 61: 60}
    reps = {r.doc_id: r.has_term for r in D.representatives(d).collect()}
    assert reps == {i: True for i in (10, *range(5))} | {60: False, 62: False}
