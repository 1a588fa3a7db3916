"""Plan shape guards: per-document operators shuffle once (on the id)."""

import re

import pytest

from newsframe.plans import params as PR

BASE = "/root/testdata/sf0.001"


def _hash_exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return re.findall(r"Exchange hashpartitioning\(([^)]*)\)", plan)


@pytest.mark.parametrize("op", ["d1", "d1d", "k1", "k2", "d4"])
def test_single_document_exchange(spark, op):
    from newsframe.operators import credibility as C
    from newsframe.operators import keywords as KO
    from newsframe.operators import polarity as P
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    df = {
        "d1": lambda: C.credibility_heuristic(docs),
        "d1d": lambda: C.top3_repetition(docs),
        "k1": lambda: KO.keywords_freq(docs),
        "k2": lambda: KO.keywords_rake(docs, PR.STOP_WORDS_20),
        "d4": lambda: P.polarity(docs, P.lexicon_frame(spark, PR.POLARITY_LEXICON),
                                 P.modifier_frame(spark, PR.NEGATORS, PR.INTENSIFIERS)),
    }[op]()
    ex = _hash_exchanges(df)
    assert len(ex) == 1 and ex[0].startswith("doc_id"), ex


def test_scans_are_pruned(spark):
    from newsframe.operators import credibility as C
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    plan = C.credibility_heuristic(docs)._jdf.queryExecution().executedPlan().toString()
    schemas = re.findall(r"ReadSchema: (struct<[^>]*>)", plan)
    assert schemas and all(s == "struct<doc_id:bigint,text:string>" for s in schemas), schemas


def test_cli_summarize_single_branch(spark):
    from newsframe.plans.pipelines import cli_summarize
    pages = spark.read.parquet(f"{BASE}/pages.parquet")
    ex = _hash_exchanges(cli_summarize(pages))
    assert len(ex) == 1 and ex[0].startswith("page_id"), ex


def test_polarity_shuffles_one_small_row_per_document(spark):
    from newsframe.operators import polarity as P
    docs = spark.read.parquet(f"{BASE}/documents.parquet")
    lex, mods = P.lexicon_frame(spark, PR.POLARITY_LEXICON), P.modifier_frame(spark, PR.NEGATORS, PR.INTENSIFIERS)
    for df in (P.polarity(docs, lex, mods), P.analyze_bias(docs, lex, mods), P.analyze_sentiment(docs, lex, mods)):
        lines = df._jdf.queryExecution().executedPlan().toString().splitlines()
        below = [lines[i + 1] for i, line in enumerate(lines) if "Exchange hashpartitioning" in line]
        assert len(below) == 1 and "HashAggregate" in below[0] and "text" not in below[0], below


def test_document_exchange_grows_with_the_input(spark, monkeypatch):
    from newsframe.operators import tokens as TK
    docs = spark.read.parquet(f"{BASE}/documents.parquet").select("doc_id", "text")
    size = TK.input_bytes(docs)
    assert size > 100_000
    monkeypatch.setattr(TK, "PART_BYTES", size // 50)
    ex = _hash_exchanges(TK.by_document(docs))
    assert len(ex) == 1 and int(ex[0].split(",")[1]) >= 50, ex
