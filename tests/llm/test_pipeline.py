"""The pipeline against its stages' own results on whole small tables."""

import random

import corpus_pipeline
from newsframe.llm import minhash, quality, queries, toxicity
from newsframe.sources.tables import read_table

SF = "/root/testdata/sf0.001"


def test_pipeline_stages_take_effect(spark):
    docs = read_table(spark, SF, "documents")
    seen = [{r["doc_id"]: r["text"] for r in docs.collect()}]
    df = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, df = df, stage(spark, df, SF)
        assert df.columns == docs.columns
        seen.append({r["doc_id"]: r["text"] for r in df.collect()})
        if name == "toxicity":
            gone = toxicity.toxicity(before, read_table(spark, SF, "labels")).where("predicted = 1")
        elif name == "quality":
            gone = quality.quality(before).where("NOT kept")
        elif name == "near_duplicates":
            gone = minhash.near_duplicates(before).where("NOT kept")
        else:
            assert seen[-1].keys() == seen[-2].keys()
            continue
        assert seen[-1].keys() == seen[-2].keys() - {r["doc_id"] for r in gone.collect()}
    out = corpus_pipeline.run(spark, SF).collect()
    assert {r["doc_id"] for r in out} == seen[-1].keys()


def test_pipeline_on_an_empty_table(spark, tmp_path):
    docs = read_table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs2 = stage(spark, docs, SF)
        assert docs2.count() == 0


def test_registered_queries():
    assert [q.split("_")[0] for q in queries.queries()] == [f"op{i}" for i in range(1, 14)]
    assert len(corpus_pipeline.STAGES) == 5


def test_filters_judge_rows_of_null_and_repeated_ids(spark):
    rng = random.Random(5)
    words = [f"word{i}" for i in range(500)]
    text = [" ".join(rng.choices(words, k=120)) for _ in range(40)]
    rows = [(i, t, "en") for i, t in enumerate(text)]
    rows += [(None, text[39] + " more", "en"),                  # near copy of 39
             (None, text[0][::-1], "en"), (None, text[0][::-1], "en"),     # exact copies, null id
             (7, text[7], "en"), (7, text[7], "en"),            # the same row again
             (8, text[0][::-1] + " end", "en"),                 # other text of a repeated id, near the null ones
             (9, "too short", "en"), (None, "short", "en"), (None, None, None), (10, "", None)]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows],
                                 "doc_id long, text string, lang string, bad_id string, own string, key int")
    got = [tuple(r)[:2] for r in minhash.deduplicated(docs).collect()]
    assert len(got) == len(set(got))
    ids = [i for i, _ in got]
    assert ids.count(7) == 1 and (39, text[39]) in got and (None, text[39] + " more") not in got
    back = [g for g in got if g[1] and g[1].startswith(text[0][::-1])]
    assert len(back) == 1                                       # one of the three near copies
    assert {(i, t) for i, t in enumerate(text)} <= set(got) and {(None, "short"), (None, None), (9, "too short")} <= set(got)
    kept = [tuple(r)[:2] for r in quality.accepted(docs).collect()]
    assert (9, "too short") not in kept and (9, text[9]) in kept and (None, "short") not in kept
    assert (None, None) not in kept and kept.count((7, text[7])) == 3
    insult = "you are a stupid idiot and a moron, shut up " * 3
    rude = [(i, insult + text[i % 40], "en") for i in range(100, 160)] + [(None, insult, "en"), (3, insult, "en")]
    mixed = docs.union(spark.createDataFrame([(*r, "x", "y", 1) for r in rude], docs.schema))
    labels = spark.createDataFrame([(i, int(i >= 100)) for i in [*range(11, 40), *range(100, 160)]], "doc_id long, toxic int")
    calm = [tuple(r)[:2] for r in toxicity.accepted(mixed, labels).collect()]
    assert (None, insult) not in calm and (3, insult) not in calm and (3, text[3]) in calm and len(calm) == len(rows)
