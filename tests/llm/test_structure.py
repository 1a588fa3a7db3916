"""License blocks, tokenizer alignment and periodic runs against brute force,
with nulls, empty and long texts, ties, repeated rows, empty tables and extra
columns."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import public_tokenizers
import pytest

from newsframe.llm import alignment, licenses, periodic

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, n_words string, pairs string"
A_JSON, B_MODEL = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))


def frame(spark, rows, schema=DOCS):
    """Rows as documents, with columns whose names clash with the operators' own."""
    return spark.createDataFrame([(*r, *["x"] * (schema.count(",") + 1 - len(r))) for r in rows], schema)


def edge_rows():
    return [(1, None), (2, ""), (3, "  \n "), (4, "one"), (5, "a b c d e"), (5, "a b c d e"), (6, "x " * 40000),
            (7, "é ü"), (None, "no id here at all"), (None, "no id here at all"), (8, "y" * 30000)]


def sample(n):
    return [tuple(r) for r in duckdb.sql(f"select doc_id, text from '{SF}/documents.parquet' order by doc_id limit {n}").fetchall()]


# ------------------------------------------------------------ 11: licenses

def brute_labelled(text):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
    base = [(i, label) for p, label in licenses.PHRASES for i in range(len(w)) if w[i:i + len(p.split())] == p.split()]
    met, score = set(), 0.0
    for _, label, t in licenses.TEMPLATES:
        words = [x.decode() for x in licenses.words_of(t)]
        step = next(2 ** k for k in range(20) if 2 ** k >= len(words))
        for k in range(len(w) // step + 1):
            overlap = len(set(words) & set(w[k * step:(k + 2) * step]))
            if overlap >= math.ceil(licenses.THRESHOLD * len(set(words)) - 1e-9):
                met.add(label)
                score = max(score, overlap / len(set(words)))
    names = {x for _, x in base}
    at = [i for i, _ in base]
    return (len(w), len(base), min(at, default=None), max(at, default=None), ",".join(sorted(names)), ",".join(sorted(names | met)), score)


def license_rows():
    rng = random.Random(4)
    rows = edge_rows() + [(100 + i, t) for i, (_, t) in enumerate(sample(60))]
    words = sorted({w for _, _, t in licenses.TEMPLATES for w in t.split()})
    for k, (_, _, t) in enumerate(licenses.TEMPLATES):
        ws = t.split()
        for drop in (0, 1, len(ws) // 12, len(ws) // 8, len(ws) // 3):
            kept = sorted(rng.sample(range(len(ws)), len(ws) - drop))
            sep = rng.choice([" ", "\n", "  * "])
            front = rng.choices(words, k=rng.randrange(0, 70))
            rows.append((1000 + 10 * k + drop, " ".join(front) + "\n" + sep.join(ws[i] for i in kept) + "\ntail " * rng.randrange(40)))
    rows += [(3000, "MIT LICENSE mit-license; the\x00MIT\tLicense"), (3001, "general public\nlicense apache license " * 2),
             (3002, "Released under the Apache License"), (3003, " ".join(rng.choices(words, k=30000)))]
    return rows


def test_license_labels_match_brute_force(spark):
    rows = license_rows()
    got = licenses.labelled(frame(spark, rows)).collect()
    want = Counter((i, *brute_labelled(t)) for i, t in rows)
    assert Counter(tuple(r) for r in got) == want
    by = {r["doc_id"]: r for r in got}
    assert by[3002]["labels"] == "apache" and by[3002]["n_base"] == 1
    for k, (_, label, _) in enumerate(licenses.TEMPLATES):
        assert label in by[1000 + 10 * k]["labels"].split(",")


def test_license_join_equals_all_pairs_at_lower_thresholds(spark):
    """The filters lose nothing whatever the threshold and the order of tokens."""
    rows = license_rows()[:90]
    for threshold in (0.3, 0.6, 1.0):
        index = licenses.Index(licenses.TEMPLATES, {b"the": 9, b"of": 7, b"license": 1}, threshold)
        for _, text in rows:
            w = licenses.words_of(text)
            held = [(i, index.rank[x]) for i, x in enumerate(w) if x in index.rank]
            pos, rank = (np.array([h[k] for h in held], np.int64) for k in (0, 1))
            got = set(licenses.matching_blocks(np.zeros(len(pos), np.int64), pos, rank, np.array([len(w)]), index))
            want = set()
            for t, (_, _, tt) in enumerate(licenses.TEMPLATES):
                ws = licenses.words_of(tt)
                step = licenses.window_step(len(ws))
                for k in range(len(w) // step + 1):
                    o = len(set(ws) & set(w[k * step:(k + 2) * step]))
                    if o >= licenses.least_overlap(len(set(ws)), threshold):
                        want.add((0, t, k * step, min(2 * step, len(w) - k * step), o))
            assert got == want


def test_license_scan_edges(spark):
    assert licenses.labelled(frame(spark, [])).count() == 0
    plain = licenses.labelled(frame(spark, [(1, "the MIT license"), (2, None)]), templates=[]).collect()
    assert [(r["labels"], r["score"]) for r in sorted(plain)] == [("mit", 0.0), ("", 0.0)]


# ------------------------------------------------------------ 12: alignment

@pytest.fixture(scope="module")
def aligner():
    spec, model = alignment._read(A_JSON, B_MODEL)
    a, b = alignment.byte_level_tokens(spec), alignment.piece_tokens(model)
    return alignment.Aligner(spec, model, alignment.Vocabulary(a), alignment.Vocabulary(b)), a, b


def brute_groups(aligner, text):
    tool, tokens_a, tokens_b = aligner
    if not text:
        return []
    a = tool.bpe.tok.encode(" " + text, add_special_tokens=False).ids
    b = tool.sp.encode(text)
    whole = (" " + text).encode()
    if b"".join(tokens_a[i] for i in a) != whole or b"".join(tokens_b[i] for i in b) != whole:
        return []
    ends_a, ends_b = (np.cumsum([len(t[i]) for i in x]) for t, x in ((tokens_a, a), (tokens_b, b)))
    cuts = sorted(set(ends_a.tolist()) & set(ends_b.tolist()))
    at_a, at_b = ([0, *(np.searchsorted(e, cuts) + 1).tolist()] for e in (ends_a, ends_b))
    return [(a[x:y], list(b[u:v])) for x, y, u, v in zip(at_a, at_a[1:], at_b, at_b[1:])]


def alignment_rows():
    rng = random.Random(9)
    odd = ["a▁b", "  x ", "\x00nul\n\n", "<s> </s> <unk> <|endoftext|>", "日本語😀 ñandú", "x" * 9000,
           "".join(rng.choices("ab éß日\n\t😀'12", k=20000))]
    return edge_rows() + [(200 + i, t) for i, t in enumerate(odd)] + sample(40)


def test_alignment_matches_brute_force(spark, aligner):
    rows = alignment_rows()
    groups = [brute_groups(aligner, t) for _, t in rows]
    links = Counter((a[-1], b[-1]) for g in groups for a, b in g)
    most = defaultdict(int)
    for (_, b), n in links.items():
        most[b] = max(most[b], n)
    want = Counter()
    for (i, _), g in zip(rows, groups):
        own = [(a[-1], b[-1]) for a, b in g]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        want[i, sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(own),
             hashlib.sha256(text.encode()).hexdigest() if g else "", sum(links[p] == most[p[1]] for p in own),
             sum(links[p] for p in own)] += 1
    got = alignment.align_digest(frame(spark, rows), A_JSON, B_MODEL)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "count_sum"]
    assert Counter(tuple(r) for r in got.collect()) == want
    assert alignment.align_digest(frame(spark, []), A_JSON, B_MODEL).count() == 0


def test_both_byte_bpe_libraries_agree(aligner):
    bpe, rng = aligner[0].bpe, random.Random(8)
    latin = "".join(map(chr, range(0x250)))
    texts = [t or "" for _, t in alignment_rows()] + [latin, latin[::-1], "'S 're 'LL I've  \u00a0\u0085\x1c x ²½ 1234567"]
    texts += ["".join(rng.choices(latin + " \n'" * 40 + "etaoin" * 30, k=400)) for _ in range(150)]
    texts += [r[0] for r in duckdb.sql("select text from '/root/testdata/sf0.01/documents.parquet'").fetchall()]
    fast = 0
    for t in texts:
        fast += not bpe.OTHER.search(" " + t)
        assert bpe.ids(" " + t).tolist() == bpe.tok.encode(" " + t, add_special_tokens=False).ids
    assert fast > 1100


def test_alignment_groups_cover_the_text(spark, aligner):
    rows = alignment_rows()
    want = Counter((i, str([(x, y) for x, y in brute_groups(aligner, t)])) for i, t in rows)
    got = Counter()
    for r in alignment.alignments(frame(spark, rows), A_JSON, B_MODEL).collect():
        at_a, at_b = [0, *r["a_cuts"]], [0, *r["b_cuts"]]
        assert at_a[-1] == len(r["a_ids"]) and at_b[-1] == len(r["b_ids"])
        groups = [(r["a_ids"][x:y], r["b_ids"][u:v]) for x, y, u, v in zip(at_a, at_a[1:], at_b, at_b[1:])]
        got[r["doc_id"], str(groups)] += 1
    assert got == want


def test_lockstep_equals_set_intersection():
    rng = np.random.default_rng(2)
    for size in (1, 50, 30000):
        starts = np.arange(0, 20 * size, size)
        ends = [np.unique(np.concatenate([rng.integers(1, 20 * size + 1, 9 * size), starts + size])) for _ in range(2)]
        a, b = alignment.lockstep_links(*ends, starts, starts + size)
        both = np.intersect1d(*ends)
        assert (ends[0][a] == both).all() and (ends[1][b] == both).all() and len(a) == len(b) == len(both)


# ------------------------------------------------------------ 13: runs

def brute_runs(w):
    best = {}
    for q in range(1, len(w) // periodic.MIN_EXPONENT + 1):
        i = 0
        while i + q < len(w):
            s = i
            while i + q < len(w) and w[i] == w[i + q]:
                i += 1
            if i - s + q >= max(periodic.MIN_LENGTH, periodic.MIN_EXPONENT * q):
                best.setdefault((s, i - s + q), q)
            i += 1
    return sorted(((s, n, q) for (s, n), q in best.items()), key=lambda r: (r[0], r[2]))


def run_texts(rng, n):
    out = []
    for _ in range(n):
        w = [b"%d" % rng.randrange(rng.choice([1, 2, 3, 60])) for _ in range(rng.randrange(0, 150))]
        for _ in range(rng.randrange(0, 5)):
            a, p = rng.randrange(len(w) + 1), rng.randrange(1, 25)
            w[a:a] = w[a:a + p] * rng.randrange(1, 8)
        out.append(w)
    return out


def test_runs_match_brute_force():
    rng = random.Random(11)
    for _ in range(120):
        texts = run_texts(rng, rng.randrange(1, 9))
        assert periodic.runs_of_texts(texts) == [brute_runs(w) for w in texts]
    for w in ([b"a"] * 3000, ([b"a"] * 40 + [b"b"]) * 30, [b"a", b"b"] * 700 + [b"a"] * 5):
        assert periodic.runs_of_texts([w]) == [brute_runs(w)]


def test_transform_is_a_correlation():
    rng = np.random.default_rng(6)
    for b in (1, 2, 8, 32):
        words = rng.integers(0, 2, 12 * b)
        got = set(zip(*(x.tolist() for x in periodic.zero_mismatches(words, b))))
        want = {(i, d) for i in range(10) for d in range(b, 2 * b)
                if (words[i * b:(i + 1) * b] == words[i * b + d:(i + 1) * b + d]).all()}
        assert got == want
    x = rng.integers(0, periodic.PRIME, (64, 3)).astype(np.uint64)
    back = periodic.inverse_ntt(periodic.ntt(x.copy()))
    assert ((back * np.uint64(pow(64, periodic.PRIME - 2, periodic.PRIME))) % np.uint64(periodic.PRIME) == x).all()


def brute_digest(i, text):
    w = [x.encode() for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and w:
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    runs = brute_runs(w)
    gone = {k for s, n, q in runs for k in range(s + q, s + n)}
    s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
    return (i, len(runs), s, n, q, 1000 * n // q if q else None, hashlib.sha256(lines.encode()).hexdigest(),
            hashlib.sha256(kept).hexdigest())


def test_run_digests_match_brute_force(spark):
    rng = random.Random(12)
    rows = edge_rows()[:6] + edge_rows()[7:] + sample(25) + [(6, "x " * 2000)]
    rows += [(1000 + i, b" ".join(w).decode()) for i, w in enumerate(run_texts(rng, 80))]
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i, t in rows if t) > 5
    got = periodic.digest(frame(spark, rows)).collect()
    assert Counter(tuple(r) for r in got) == Counter(brute_digest(i, t) for i, t in rows)
    assert periodic.digest(frame(spark, [])).count() == 0


def test_runs_of_whole_texts(spark):
    rows = [(1, "so so so so so so good"), (2, None), (None, "a b a b a b a b"), (3, "x " * 100000)]
    got = {r["doc_id"]: r for r in periodic.periodic_runs(frame(spark, rows)).collect()}
    assert [tuple(r) for r in got[1]["runs"]] == [(0, 6, 1)] and got[1]["collapsed"] == "so good"
    assert got[None]["collapsed"] == "a b" and got[2]["runs"] == [] and got[2]["collapsed"] == ""
    assert got[3]["collapsed"] == "x" and got[3]["n_words"] == 100000
