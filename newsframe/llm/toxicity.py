"""Toxicity by weak supervision (operator 6).

Many weak voters look at a text: lexicons, patterns, and words or word
beginnings mined from labelled rows. A generative label model over all
documents' votes is fitted by EM and gives each document a posterior. It has
latent kinds (clean texts, texts with named insults, and one kind of toxic text
per mined voter, as vocabularies of abuse exclude each other), each with one
table per voter, and a joint table for pairs of voters that stay correlated
within a kind; labelled training rows keep to the kinds of their label. A linear classifier over the mined
vocabulary is then trained on those posteriors and scores every document.

Every mined word family votes. A document's votes are a set of voters; equal
sets are counted over all documents, and each round of EM needs only sums over
them per voter and kind: on the driver up to ``DRIVER_SETS`` distinct sets, in
Spark tasks beyond. Which voters are correlated is seen on all sets too, from
sums per pair of voters and kind. Mining uses a bounded sample of the labelled training rows
(``MINE_ROWS``), the classifier a bounded sample of the training rows
(``FIT_ROWS``). A labelled toxic training row that no voter marks keeps its
label in the classifier's training. Held-out rows (``crc32(doc_id as text) mod 3 = 1``) lend no label.

Defined cases: null and empty texts have no votes and get the score of a text
without features; rows that repeat an id are scored one by one; a null id is
never held out and lends no label; without labelled rows of either class the
lexicons and patterns alone vote; an empty table gives an empty result. Extra
columns are ignored.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks, text_key, without
from newsframe.session import bounded_batches, written_table

MINE_ROWS = 12_000      # labelled rows that voters are mined from, at most (about)
FIT_ROWS = 40_000       # rows that the classifier is fitted on, at most (about)
DRIVER_SETS = 50_000    # distinct vote sets that EM works on in the driver, at most
CELLS = 2_000_000       # numbers in a block's matrices, at most (about)
MAX_VOCABULARY = 4096   # features of the classifier
STEMS = range(3, 9)     # lengths of word beginnings that are mined
TIMES = (2, 3)          # a feature also counts as met so many times in a text
MIN_LIFT = 10           # a mined voter is so many times likelier in toxic rows, at least
MIN_CORRELATION = 0.1   # within a class, from which two voters get a joint table
EM_ROUNDS = 60
FLAG_AT = 0.7           # score from which a document is predicted toxic
CACHE_WORDS = 100_000   # chunks between spaces whose features a task keeps

#: General insults, one lexicon per theme.
LEXICONS = {
    "intellect": ["idiot", "moron", "stupid", "imbecile", "dumb", "dumbass", "fool", "clown"],
    "worth": ["loser", "worthless", "pathetic", "trash", "garbage", "scum", "scumbag"],
    "disgust": ["disgusting", "vile", "filthy", "repulsive", "nasty"],
}
#: Patterns over the whole lower-cased text.
PATTERNS = {
    "attack": r"\b(?:kill yourself|shut up|go to hell|screw you|hate you|you(?: are|'re) (?:a |an |so )?(?:idiot|moron|stupid|loser|trash))\b",
    "shouting": r"!!",
}
LETTERS = re.compile(r"[^\W\d_]+")


def _features(word: str) -> list[str]:
    """A word and its beginnings (marked with a star)."""
    return [word, *(word[:k] + "*" for k in STEMS if len(word) >= k)]


class Features(dict):
    """Chunk between spaces -> its features that are in the vocabulary."""

    def __init__(self, vocabulary: set[str] | None):
        self.vocabulary = vocabulary

    def __missing__(self, chunk: str) -> tuple[str, ...]:
        found = dict.fromkeys(f for w in LETTERS.findall(chunk) for f in _features(w))
        got = tuple(found) if self.vocabulary is None else tuple(f for f in found if f in self.vocabulary)
        if len(self) > CACHE_WORDS:
            self.clear()
        self[chunk] = got
        return got


def _of(text: str | None, known: Features) -> set[str]:
    """A text's features; ``f#n`` for one that it holds n times."""
    times = Counter()
    for got in map(known.__getitem__, (text or "").lower().split()):
        if got:
            times.update(got)
    return {*times, *(f"{f}#{n}" for f, m in times.items() if m > 1 for n in TIMES if n <= m)}


def _base(feature: str) -> str:
    return feature.split("#")[0]


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows that lend no label."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


# ------------------------------------------------------------ mining

def _training(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic 0 or 1) of the rows whose labels may be learned from."""
    return (labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
                  .groupBy(F.col("doc_id").cast("long").alias("doc_id"))
                  .agg(F.max((F.col("toxic") > 0).cast("int")).alias("toxic")))


def mined(docs: DataFrame, labels: DataFrame, max_rows: int = MINE_ROWS) -> tuple[list, int, int]:
    """Features of labelled training rows as (feature, toxic rows with it,
    clean rows with it), those likelier in toxic rows; and both row counts."""
    train = _training(labels)
    n = train.count()
    part = F.pmod(F.xxhash64("doc_id", F.lit("mine")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, max_rows / max(n, 1)))
    sample = written_table(train.where(part), "toxic-sample")  # about max_rows rows: may be broadcast
    rows = (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
                .join(F.broadcast(sample), "doc_id"))
    sizes = {bool(r["toxic"]): r["count"] for r in sample.groupBy("toxic").count().collect()}

    def count(only: set[str] | None):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            known = Features(only and {_base(f) for f in only})
            for _, texts in chunks(batches):
                seen = Counter()
                for t in texts:
                    seen.update(f for f in _of(t, known) if only is None or f in only)
                yield pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())],
                                                 names=["f", "n"])
        return run

    def total(side: DataFrame, only=None) -> DataFrame:
        return side.select("text").mapInArrow(count(only), "f string, n long").groupBy("f").agg(F.sum("n").alias("n"))

    nt, nc = sizes.get(True, 0), sizes.get(False, 0)
    least = max(5, nt // 200)
    with bounded_batches(docs.sparkSession):
        toxic = {r["f"]: r["n"] for r in total(rows.where("toxic = 1")).where(F.col("n") >= least).collect()}
        clean = {r["f"]: r["n"] for r in total(rows.where("toxic = 0"), set(toxic)).collect()} if toxic else {}

    def lift(f):
        return (toxic[f] / nt) / ((clean.get(f, 0) + 0.5) / (nc + 1))
    good = sorted((f for f in toxic if lift(f) >= MIN_LIFT), key=lambda f: (-toxic[f] * np.log(lift(f)), f))
    return [(f, toxic[f], clean.get(f, 0)) for f in good[:MAX_VOCABULARY]], nt, nc


def voters(found: list) -> list[str]:
    """The best mined feature of each family (no two where one begins
    with the other), without the lexicons' words."""
    named = {w for words in LEXICONS.values() for w in words}
    out, stems = [], []
    for f, _, _ in found:
        stem = _base(f).rstrip("*")
        if any(w.startswith(stem) for w in named) or \
                any(stem.startswith(o) or o.startswith(stem) for o in stems):
            continue
        out.append(f)
        stems.append(stem)
    return out


# ------------------------------------------------------------ votes

def votes(docs: DataFrame, vocabulary: list[str], mined_voters: list[str]) -> DataFrame:
    """(doc_id, key, votes, features): the voters that mark a text, in order, and
    the text's features and hash."""
    words = {w: i for i, ws in enumerate(LEXICONS.values()) for w in ws}
    patterns = [(re.compile(p), len(LEXICONS) + i) for i, p in enumerate(PATTERNS.values())]
    first = len(LEXICONS) + len(PATTERNS)
    words |= {f: first + i for i, f in enumerate(mined_voters)}
    vocab = set(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Features({_base(f) for f in vocab | set(words)})
        for part, texts in chunks(batches):
            marks, feats = [], []
            for t in texts:
                got = _of(t, known)
                low = (t or "").lower()
                marks.append(sorted({words[f] for f in got if f in words} | {i for p, i in patterns if p.search(low)}))
                feats.append(sorted(got & vocab))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(marks, pa.list_(pa.int32())),
                                              pa.array(feats, pa.list_(pa.string()))],
                                             names=["doc_id", "key", "votes", "features"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"),
                       text_key().alias("key"))
    return rows.mapInArrow(run, "doc_id long, key long, votes array<int>, features array<string>")


# ------------------------------------------------------------ label model

class Block:
    """Some vote sets: ``row`` and ``col`` of each vote, and per set its label
    (1 toxic, 0 clean, -1 unknown) and count."""

    def __init__(self, votes: list, labels: list, counts: list):
        self.row = np.repeat(np.arange(len(votes)), [*map(len, votes)])
        self.col = np.array([v for x in votes for v in x], np.int64)
        self.label, self.count = np.array(labels, np.int64), np.array(counts, float)


def _blocks(rows: Iterator[tuple], n_kinds: int) -> Iterator[Block]:
    """Blocks with bounded matrices of (votes, label, count)."""
    part, size = [], 0
    for r in rows:
        part.append(r)
        size += max(len(r[0]), 1) * n_kinds
        if size >= CELLS:
            yield Block(*zip(*part, strict=True))
            part, size = [], 0
    if part:
        yield Block(*zip(*part, strict=True))


def _sums(at: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows with the same ``at`` (ascending)."""
    out = np.zeros((n, rows.shape[1]))
    if len(at):
        first = np.flatnonzero(np.diff(at, prepend=-1))
        out[at[first]] = np.add.reduceat(rows, first, axis=0)
    return out


class LabelModel:
    """Mixture over vote sets. Kind 0 is toxic with named insults, kind
    1 + i is toxic and starts from mined voter i, the last kind is clean.
    Voters are independent within a kind but for ``pairs``, which have a joint
    table; a pair's common votes are a column of their own after the voters'.

    The fit needs only sums over the vote sets: the kinds' weights and, per
    column and kind, the weight of the sets with that column."""

    def __init__(self, n_voters: int, any_toxic: bool, any_clean: bool):
        self.n_voters, self.n_kinds = n_voters, 2 + n_voters - len(LEXICONS) - len(PATTERNS)
        self.any_toxic, self.any_clean = any_toxic, any_clean
        self.pairs: list[tuple[int, int]] = []
        self.base = self.delta = None       # log odds; none before the first fit

    def _columns(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Row and column of all votes and common votes of pairs."""
        if not self.pairs:
            return b.row, b.col
        other, own = np.full(self.n_voters, -1), np.zeros(self.n_voters, np.int64)
        for k, (i, j) in enumerate(self.pairs):
            other[i], own[i] = j, self.n_voters + k
        at = np.flatnonzero(other[b.col] >= 0)
        at = at[np.isin(b.row[at] * self.n_voters + other[b.col[at]], b.row * self.n_voters + b.col)]
        row, col = np.append(b.row, b.row[at]), np.append(b.col, own[b.col[at]])
        order = np.argsort(row, kind="stable")
        return row[order], col[order]

    def _marks(self, b: Block) -> tuple[np.ndarray, np.ndarray]:
        """Per set the kind of its first mark, and whether it has none."""
        named, first = len(LEXICONS), len(LEXICONS) + len(PATTERNS)
        kind = np.full(len(b.label), self.n_kinds)
        some = (b.col < named) | (b.col >= first)
        np.minimum.at(kind, b.row[some], np.where(b.col[some] < named, 0, 1 + b.col[some] - first))
        return kind, kind == self.n_kinds

    def free(self, b: Block) -> np.ndarray:
        """Probability of each kind by the votes alone."""
        row, col = self._columns(b)
        delta = self.delta if len(self.delta) > self.n_voters or not self.pairs else \
            np.vstack([self.delta, np.zeros((len(self.pairs), self.n_kinds))])
        logs = self.base + _sums(row, delta[col], len(b.label))
        return self._normal(logs)

    @staticmethod
    def _normal(logs: np.ndarray) -> np.ndarray:
        p = np.exp(logs - logs.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)

    def weights(self, b: Block) -> np.ndarray:
        """Share of each kind in each set. Labelled rows keep to the kinds of
        their label. Unmarked texts count as clean: no voter can tell them
        apart, and they would pull the toxic kinds towards no votes. Before the
        first fit: the labelled rows, toxic ones by their first mark; without
        labelled toxic rows, every row with a named insult."""
        kind, quiet = self._marks(b)
        w, clean = np.zeros((len(b.label), self.n_kinds)), self.n_kinds - 1
        if self.base is None:
            kind = np.where(quiet, 0, kind)
            known = b.label == 1
            if not self.any_toxic:
                known |= (b.label == -1) & ~quiet & (kind == 0)
            w[np.flatnonzero(known), kind[known]] = 1
            w[(b.label == 0) | (not self.any_clean) & quiet & (b.label == -1), clean] = 1
            return w
        fixed = (b.label == 0) | quiet & (b.label != 1)
        w[fixed, clean] = 1
        if not fixed.all():
            row = np.cumsum(~fixed) - 1
            mine = ~fixed[b.row]
            part = Block([], [], [])
            part.row, part.col, part.label = row[b.row[mine]], b.col[mine], b.label[~fixed]
            p = self.free(part)
            p[part.label == 1, clean] = 0
            w[~fixed] = p / np.maximum(p.sum(1, keepdims=True), 1e-300)
        return w

    def sums(self, blocks: Iterator[Block]) -> np.ndarray:
        """Weight of the kinds (first row) and of the columns per kind."""
        out = np.zeros((1 + self.n_voters + len(self.pairs), self.n_kinds))
        for b in blocks:
            w = self.weights(b) * b.count[:, None]
            row, col = self._columns(b)
            order = np.argsort(col, kind="stable")
            out[0] += w.sum(0)
            out[1:] += _sums(col[order], w[row[order]], len(out) - 1)
        return out

    def update(self, sums: np.ndarray) -> None:
        """The kinds' tables from sums."""
        total, n = sums[0], sums[1:]
        self.base = np.log((total + 0.5) / (total.sum() + 0.5 * self.n_kinds))
        one = np.log((n[:self.n_voters] + 0.1) / (total + 0.2))
        none = np.log((total - n[:self.n_voters] + 0.1) / (total + 0.2))
        both = np.zeros((len(self.pairs), self.n_kinds))
        for k, (i, j) in enumerate(self.pairs):
            b = n[self.n_voters + k]
            t = [np.log((np.maximum(x, 0) + 0.1) / (total + 0.4)) for x in (total - n[i] - n[j] + b, n[i] - b, n[j] - b, b)]
            none[i], none[j], one[i], one[j] = t[0], 0, t[1], t[2] - t[0]
            both[k] = t[3] - t[1] - t[2] + t[0]
        self.base = self.base + none.sum(0)
        self.delta = np.vstack([one - none, both])

    def posterior(self, b: Block) -> np.ndarray:
        """Probability of being toxic by the votes alone."""
        return np.where(self._marks(b)[1], 0.0, 1 - self.free(b)[:, -1])

    def moments(self, blocks: Iterator[Block]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """Per kind the weight of the sets that hold both voters of a pair, as ascending
        codes (i * n_voters + j, i <= j; i = j for one voter, -1 for all sets) and sums."""
        out: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in blocks:
            w = self.weights(b) * b.count[:, None]
            for y in np.flatnonzero(w.max(0) > 1e-6):
                chosen = w[:, y] > 1e-6
                total = w[chosen, y].sum()
                hit = chosen[b.row]
                row, place = np.unique(b.row[hit], return_inverse=True)
                seen, col = np.unique(b.col[hit], return_inverse=True)
                x = np.zeros((len(row), len(seen)))
                x[place, col] = 1
                both = np.triu((x * w[row, y][:, None]).T @ x)
                i, j = np.nonzero(both)
                codes, sums = np.append(-1, seen[i] * self.n_voters + seen[j]), np.append(total, both[i, j])
                if int(y) in out:
                    codes, sums = np.append(out[y][0], codes), np.append(out[y][1], sums)
                    codes, at = np.unique(codes, return_inverse=True)
                    sums = np.bincount(at, weights=sums, minlength=len(codes))
                out[int(y)] = codes, sums
        return out

    def correlations(self, moments: Iterator[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        """Voters' correlations within the kinds, the largest of them, from the
        ``moments`` over all sets, one kind at a time."""
        out = np.zeros((self.n_voters,) * 2)
        for codes, sums in moments:
            total = sums[codes == -1].sum()
            if total < 1:
                continue
            sums, codes = sums[codes >= 0] / total, codes[codes >= 0]
            i, j = np.divmod(codes, self.n_voters)
            seen = np.unique(i[i == j])
            i, j = np.searchsorted(seen, i), np.searchsorted(seen, j)
            moment = np.zeros((len(seen),) * 2)
            moment[i, j] = moment[j, i] = sums
            mean = np.diag(moment)
            cov = moment - np.outer(mean, mean)
            sd = np.sqrt(np.maximum(np.diag(cov), 1e-12))
            at = np.ix_(seen, seen)
            out[at] = np.maximum(out[at], np.abs(cov / np.outer(sd, sd)))
        return out

    def join_correlated(self, moments: Iterator[tuple[np.ndarray, np.ndarray]], least: float = MIN_CORRELATION) -> None:
        """Give the most correlated pairs a joint table (each voter in one)."""
        corr = np.triu(self.correlations(moments), 1)
        used: set[int] = set()
        at = np.flatnonzero(corr >= least)
        for k in at[np.argsort(-corr.flat[at], kind="stable")]:
            i, j = divmod(int(k), len(corr))
            if not {i, j} & used:
                self.pairs.append((i, j))
                used |= {i, j}


def label_model(cast: DataFrame, labels: DataFrame, n_voters: int, driver_sets: int = DRIVER_SETS) -> LabelModel:
    """The label model fitted to the vote sets of all documents."""
    known = _training(labels).select(F.col("doc_id").alias("_id"), "toxic")
    sets = written_table(cast.join(known, F.col("doc_id") == F.col("_id"), "left")
                         .groupBy("votes", F.coalesce("toxic", F.lit(-1)).alias("label")).count(), "toxic-sets")
    n = sets.count()
    with_label = {r["label"] for r in sets.select("label").distinct().collect()}
    model = LabelModel(n_voters, 1 in with_label, 0 in with_label)
    blocks, spread = [], None
    if n > driver_sets:
        spread = written_table(sets.repartition(min(64, -(-n // driver_sets))), "toxic-spread")
    else:
        blocks = list(_blocks(sorted((list(r["votes"]), r["label"], r["count"]) for r in sets.toLocalIterator()), model.n_kinds))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[Block]:
        return _blocks((r for b in batches for r in zip(*(b.column(c).to_pylist() for c in ("votes", "label", "count")), strict=True)),
                       model.n_kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield pa.RecordBatch.from_arrays([pa.array([model.sums(rows(batches)).tobytes()], pa.binary())], names=["sums"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for kind, (codes, weights) in model.moments(rows(batches)).items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), kind)), pa.array(codes), pa.array(weights)],
                                             names=["kind", "code", "weight"])

    def moments() -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Those of all vote sets, kind by kind."""
        if spread is None:
            yield from model.moments(blocks).values()
            return
        found = (spread.mapInArrow(pairs, "kind long, code long, weight double").groupBy("kind", "code")
                 .agg(F.sum("weight").alias("weight")))
        found = written_table(found, "toxic-moments").orderBy("kind").toLocalIterator()
        for _, group in itertools.groupby(found, lambda r: r["kind"]):
            codes, weights = zip(*((r["code"], r["weight"]) for r in group), strict=True)
            yield np.array(codes, np.int64), np.array(weights)

    def sums() -> np.ndarray:
        if spread is None:
            return model.sums(blocks)
        return sum(np.frombuffer(r["sums"]).reshape(-1, model.n_kinds)
                   for r in spread.mapInArrow(run, "sums binary").toLocalIterator())

    def fit() -> None:
        for _ in range(EM_ROUNDS):
            model.update(sums())

    fit()
    model.join_correlated(moments())
    fit()
    return model


# ------------------------------------------------------------ classifier

def toxicity(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> DataFrame:
    """(doc_id, held_out, score, predicted, key) per row of ``docs``; key is the text's hash."""
    found, _, _ = mined(docs, labels)
    own = voters(found)
    vocabulary = sorted({f for f, _, _ in found} | {w for ws in LEXICONS.values() for w in ws})
    cast = written_table(votes(docs, vocabulary, own), "toxic-votes")
    n = cast.count()
    out = cast.select("doc_id", "key", held_out().alias("held_out"), "features")
    if not n:
        return out.select("doc_id", "held_out", F.lit(0.0).alias("score"), F.lit(0).alias("predicted"), "key")
    model = label_model(cast, labels, len(LEXICONS) + len(PATTERNS) + len(own))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = zip(b.column("votes").to_pylist(), b.column("toxic").to_pylist(), [1] * b.num_rows, strict=True)
            # a labelled toxic row that no voter marks keeps its label
            p = [np.where(model._marks(x)[1] & (x.label == 1), 1.0, model.posterior(x)) for x in _blocks(rows, model.n_kinds)]
            yield pa.RecordBatch.from_arrays([b.column("features"), pa.array(np.concatenate([np.zeros(0), *p]))],
                                             names=["features", "p"])

    part = F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(1_000_000)) < int(1_000_000 * min(1.0, fit_rows / n))
    known = _training(labels).select(F.col("doc_id").alias("_id"), "toxic")
    train = (cast.where(part & ~held_out()).join(known, F.col("doc_id") == F.col("_id"), "left")
                 .select("votes", "features", F.coalesce("toxic", F.lit(-1)).alias("toxic"))
                 .mapInArrow(weigh, "features array<string>, p double")
                 .select("features", F.explode(F.array(F.struct(F.lit(1.0).alias("label"), F.col("p").alias("w")),
                                                       F.struct(F.lit(0.0).alias("label"), (1 - F.col("p")).alias("w"))))
                         .alias("x")).select("features", "x.label", "x.w").where("w > 0.0001"))
    vectors = CountVectorizerModel.from_vocabulary(vocabulary, inputCol="features", outputCol="vector")
    vectors.setBinary(True).setMinTF(0.0)
    fit = LogisticRegression(featuresCol="vector", weightCol="w", regParam=1e-4, maxIter=60, standardization=False)
    train = written_table(train, "toxic-train")
    if train.isEmpty():
        scored = out.withColumn("score", F.lit(0.0))
    else:
        fitted = fit.fit(vectors.transform(train))
        fitted.setProbabilityCol("prob").setRawPredictionCol("").setPredictionCol("")
        scored = fitted.transform(vectors.transform(out)).withColumn("score", vector_to_array("prob")[1])
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= FLAG_AT).cast("int").alias("predicted"),
                         "key")


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are not predicted toxic, null and repeated ids
    included: a row's verdict goes by its id and text."""
    return without(docs, toxicity(docs, labels).where("predicted = 1"), "toxic-bad")
