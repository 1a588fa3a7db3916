"""Near duplicates by pairs of document blocks, against the rule itself."""

import math
import random
from collections import Counter

import pytest

from newsframe.operators import blocks as B
from newsframe.operators import dedup as D


def brute(rows, threshold):
    texts = {}
    for i, t in rows:
        texts[t] = min(i, texts.get(t, i))
    docs = {i: Counter(t.lower().split()) for t, i in texts.items() if t.split()}
    df = Counter(w for c in docs.values() for w in c)
    vec = {i: {w: n * (math.log((len(docs) + 1) / (df[w] + 1)) + 1) for w, n in c.items()} for i, c in docs.items()}
    norm = {i: math.sqrt(sum(x * x for x in v.values())) for i, v in vec.items()}
    cos = {(a, b): sum(x * vec[b].get(w, 0) for w, x in vec[a].items()) / (norm[a] * norm[b]) for a in vec for b in vec if a < b}
    return {p: round(c, 4) for p, c in cos.items() if c >= threshold}, texts


def some_rows(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.7))}" for _ in range(3000)]
    rows = [(f"d{i:04d}", " ".join(rng.choices(words, k=rng.choice([5, 40, 400])))) for i in range(90)]
    for n in range(60):
        t = rows[rng.randrange(len(rows))][1].split()
        for _ in range(rng.choice([0, 1, 3, 9])):
            t[rng.randrange(len(t))] = rng.choice(words)
        rows.append((f"c{n:04d}", " ".join(t)))
    return rows


@pytest.mark.parametrize("seed,threshold,terms", [(1, 0.9, 10 ** 6), (2, 0.8, 1500), (3, 0.6, 1000)])
def test_blocks_find_all_pairs_and_the_earliest_partners(spark, monkeypatch, seed, threshold, terms):
    monkeypatch.setattr(B, "PREFIX_TERMS", terms)
    monkeypatch.setattr(B, "VECTOR_TERMS", terms)
    monkeypatch.setattr(B, "ROWS", 500)
    monkeypatch.setattr(B, "CELLS", 400)
    monkeypatch.setattr(D, "FREQUENT_TERMS", 50)
    rows = some_rows(seed)
    df = spark.createDataFrame(rows, "doc_id string, text string")
    pairs, texts = brute(rows, threshold)
    got = {(r.i, r.j): r.sim for r in D.similar_pairs(df, threshold).collect()}
    assert set(got) == set(pairs) and all(abs(got[p] - pairs[p]) < 1.5e-4 for p in got)
    first = {}
    for a, b in sorted(pairs, reverse=True):
        first[b] = a
    want = {i: first.get(texts[t], texts[t]) for i, t in rows if texts[t] in first or i != texts[t]}
    assert {r.doc_id: r.duplicate_of for r in D.duplicate_of(df, threshold).collect()} == want


def test_long_documents_of_one_vocabulary_give_few_rows(spark):
    """Long texts share rare terms without being alike: a row for each shared prefix term
    of a pair, as the query made them, is far more than what leaves the block tasks."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(4000)]
    weights = [1 / (i + 1) for i in range(4000)]
    rows = [(i, " ".join(rng.choices(words, weights, k=900))) for i in range(150)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    vectors, w = D.term_vectors(df, "text", "doc_id", D.representatives(df))
    found = B.candidates(B.prefixes(vectors, w, 0.9), 0.9, first=False).count()
    pre = D.prefix_terms(D.weighted_terms(tf := D.tf_vectors(df), D.term_frequencies(tf), D.F.lit(150)), 0.9)
    terms = [r.n for r in pre.groupBy("term").agg(D.F.count("*").alias("n")).collect()]
    assert sum(n * (n - 1) // 2 for n in terms) > 1000 > 10 * found
    assert "Join" not in B.candidates(B.prefixes(vectors, w, 0.9), 0.9, first=False)._jdf.queryExecution().toString()


def test_cues_are_counted_by_grams_of_the_lengths_in_use(spark):
    from newsframe.operators import cues as Q
    docs = spark.createDataFrame([(1, "banana bandana \u00e9t\u00e9\u00e9t\u00e9\u00e9t aaaaaaaaaaa"), (2, None), (3, "none here")], "doc_id long, text string")
    words = ["banana", "ana", "aaaaa", "\u00e9t\u00e9\u00e9t", "a", "zzzzzz"]
    table = spark.createDataFrame([(w,) for w in words], "cue string")
    text = docs.select(Q.T.clean_for_bias("text")).first()[0]
    got = {(r.doc_id, r.cue): r.n for r in Q.cue_counts(docs, table).collect()}
    assert {c: got.get((1, c), 0) for c in words} == {c: text.count(c) for c in words}
    assert all(i != 2 for i, _ in got)
    long = spark.createDataFrame([("bandana",)], "cue string")
    plan = Q.cue_counts(docs, long)._jdf.queryExecution().toString()
    assert "(.{5})" in plan and not any(f"(.{{{q}}})" in plan for q in range(1, 5))


def test_document_parts_sort_in_memory(spark, tmp_path):
    """A part of 64 MB as stored was some GB as exploded words, and spilled in each sort."""
    from newsframe.operators import tokens as TK
    assert TK.PART_BYTES <= 4 << 20


def test_rake_carries_a_phrase_once(spark):
    from newsframe.operators import keywords as KO
    dd = spark.createDataFrame([(1, "big red dog and big red cat and dog"), (2, ""), (3, None)], "doc_id long, _t string")
    res = KO.rake_phrases(dd, ["and"])
    got = {(r.doc_id, r.pid): (r.phrase, r.score) for r in res.collect()}
    assert got[1, 0] == ("big red dog", 8.0) and got[1, 1] == ("big red cat", 9.0) and got[1, 2] == ("dog", 2.0)
    plan = res._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("CASE WHEN (coalesce(at") == 1


def test_rejected_rows_leave_without_a_shuffle_of_the_texts(spark):
    """The rejected rows outgrow Spark's own limit long before the bound of small tables."""
    from newsframe.llm import common
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(50)] + [(None, "x")], "doc_id long, text string")
    bad = docs.where("doc_id % 3 = 0 OR doc_id IS NULL").select("doc_id", common.text_key().alias("key"))
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        left = common.without(docs, bad, "test-bad")
        assert "Exchange hashpartitioning" not in left._jdf.queryExecution().executedPlan().toString()
        assert sorted(r.doc_id for r in left.collect()) == [i for i in range(50) if i % 3]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
