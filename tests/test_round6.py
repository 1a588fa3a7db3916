"""Work that must not grow with a table's size: vectors, vote sets, prefixes."""

import random

import pytest

from newsframe.operators import keywords as KO
from newsframe.operators import vectors as V


def test_a_large_vector_table_is_met_in_blocks(spark, monkeypatch):
    """Repeated and null keys, null ids, zero vectors and words without a vector, as the
    broadcast path has them; no row with a vector is shuffled by its key."""
    rng = random.Random(31)
    vocab = [f"w{k:02d}" for k in range(60)]
    rows = [(i, " ".join(rng.choices(vocab, k=rng.choice([1, 4, 30])))) for i in range(40)]
    rows += [(3, "w01 w02 w02"), (None, "w05 w04 w06"), (100, None), (101, "zz the"), (102, "w59")]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    table = [(w, [rng.uniform(-1, 1) for _ in range(5)]) for w in vocab[:-1]] + [("w59", [0.0] * 5), (None, [1.0] * 5)]
    table += [("w07", [0.5] * 5), ("w08", table[8][1])]
    vec = spark.createDataFrame(table, "key string, vec array<float>")
    got = []
    for most in (V.VECTOR_BROADCAST_MAX_VALUES, 0):
        monkeypatch.setattr(KO, "VECTOR_BROADCAST_MAX_VALUES", most)
        monkeypatch.setattr(V, "BLOCK_VALUES", 40)
        df = KO.keywords_embedding(d, vec, ["the"], top_n=6)
        got.append(sorted(((r.doc_id, r.keywords) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0)))
        plan = df._jdf.queryExecution().executedPlan().toString()
    assert got[0] == got[1] and len(got[0]) == 44
    assert "_key" not in plan and plan.count("Exchange hashpartitioning") == 0
    none = KO.keywords_embedding(d, vec.limit(0), ["the"])
    assert {tuple(r.keywords) for r in none.collect()} == {()} and none.count() == 44


@pytest.mark.parametrize("x", [0.1234565, 1.115, -0.0000005, 0.9999995, 0.3333335])
def test_rounding_of_arrays_is_python_rounding(x):
    assert V.pyround(V.np.array([x, -x]), 6).tolist() == [round(x, 6), round(-x, 6)]


def test_prefix_blocks_and_texts_are_shuffled_once(spark, monkeypatch):
    """However many blocks there are, a prefix row is dealt to one of them and read there."""
    from newsframe.operators import blocks as B
    from newsframe.operators import dedup as D
    rng = random.Random(32)
    words = [f"w{k}" for k in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=25))) for i in range(60)]
    rows += [(100 + i, rows[i][1] + (" w1" if i % 2 else "")) for i in range(10)] + [(1, "w1 w2"), (None, "w3"), (200, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    plans = {}
    real = D.written_table

    def keep(frame, name):
        plans[name] = frame._jdf.queryExecution().executedPlan().toString()
        return real(frame, name)
    monkeypatch.setattr(D, "written_table", keep)
    monkeypatch.setattr(B, "written_table", keep)
    want = {(r.i, r.j, r.sim) for r in D.similar_pairs(df, 0.6).collect()}
    monkeypatch.setattr(B, "PREFIX_TERMS", 200)
    assert {(r.i, r.j, r.sim) for r in D.similar_pairs(df, 0.6).collect()} == want and len(want) >= 5
    assert "Generate" not in plans["dedup-candidates"] and "RoundRobinPartitioning" in plans["dedup-candidates"]
    texts = [x for x in plans["dedup-counts"].split("\n") if "Exchange hashpartitioning(doc_id" in x]
    assert len(texts) == 2                                    # the texts' and their ids'


def test_feed_entries_are_parsed_once(spark):
    """Duplicate removal reads its input three times; the XML is not parsed again for it."""
    import __spark_entry__ as entry
    plan = entry.queries()["ingest_batch"](spark, entry.SMOKE_DIR)._jdf.queryExecution().optimizedPlan().toString()
    assert "xml" not in plan.lower() and "regexp" not in plan.lower()
