"""Periodic runs of words, by block convolution (operator 13).

A run is a longest stretch of words with smallest period q and a length of at
least max(6, 4 q). For each dyadic scale b the words are cut into aligned
blocks of b. A run whose period lies in [b, 2 b) holds one of these blocks and its
copy q words later. The copies of a block among the distances b to 2 b - 1 are
where the squared differences to the two following blocks sum to zero, and the
sums of all distances come from one correlation, worked out exactly with a
number-theoretic transform modulo a prime. A sum that is not zero but a multiple
of the prime would only add a seed; seeds are compared word by word.

The transforms of a scale run over all blocks of all texts of a chunk at once.
Words are numbered per chunk and a number of its own ends each text, so no match
reaches into another text. Longer texts come first, so a scale reads only the
front that holds texts of four blocks and more (others have no run there).

Blocks that match at the same distance one after another are one seed; its
ends are extended by fewer than b words, as the next block on either side has no match. A
seed within a known run of smaller period is left out: its stretch is at least
as long as both periods, so its period is a multiple and its run the known one.

Defined cases: null and empty texts have no words and no runs; rows that repeat
an id are judged one by one; a null id is kept, and plants nothing; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks

MIN_LENGTH = 6
MIN_EXPONENT = 4
PRIME = 2013265921          # 15 * 2**27 + 1, so transforms of up to 2**27 words
GENERATOR = 31
TILE = 1 << 16              # numbers of one transform tile, within a core's cache
COMPARED = 1 << 20          # words compared at once when seeds are extended

_P = np.uint64(PRIME)


# ------------------------------------------------------------ transforms

def _mod(x: np.ndarray) -> np.ndarray:
    return x - x // _P * _P


def _less(x: np.ndarray) -> np.ndarray:
    """x modulo the prime, for x below twice the prime."""
    return np.minimum(x, x - _P)


@lru_cache(maxsize=None)
def _roots(size: int, inverse: bool) -> np.ndarray:
    """Powers 0 .. size/2 - 1 of a primitive root of unity of order ``size``."""
    root = pow(GENERATOR, (PRIME - 1) // size, PRIME)
    if inverse:
        root = pow(root, PRIME - 2, PRIME)
    out = np.ones(1, np.uint64)
    while len(out) < size // 2:
        out = np.concatenate([out, _mod(out * np.uint64(pow(root, len(out), PRIME)))])
    return out.reshape(-1, 1)


def ntt(x: np.ndarray) -> np.ndarray:
    """Transform of each column (in place); frequencies in bit-reversed order."""
    size, cols = x.shape
    while size > 1:
        half = size // 2
        y = x.reshape(-1, size, cols)
        u, v = y[:, :half], y[:, half:]
        low = _less(u + v)
        y[:, half:] = _mod((u + (_P - v)) * _roots(size, False))
        y[:, :half] = low
        size = half
    return x


def inverse_ntt(x: np.ndarray) -> np.ndarray:
    """Inverse of ``ntt`` (in place), but for the factor 1 / rows."""
    rows, cols = x.shape
    size = 2
    while size <= rows:
        half = size // 2
        y = x.reshape(-1, size, cols)
        u, v = y[:, :half], _mod(y[:, half:] * _roots(size, True))
        high = _less(u + (_P - v))
        y[:, :half] = _less(u + v)
        y[:, half:] = high
        size *= 2
    return x


@lru_cache(maxsize=None)
def _negated(rows: int) -> np.ndarray:
    """Where the frequency -k stands, for each place of the bit-reversed order:
    each stretch from 2**j to 2**(j+1) is turned round."""
    at = np.arange(rows)
    top = 1 << (np.frexp(np.maximum(at, 1))[1].astype(np.int64) - 1)
    return np.where(at > 0, 3 * top - 1 - at, 0)


def zero_mismatches(words: np.ndarray, b: int) -> tuple[np.ndarray, np.ndarray]:
    """(block, distance) of all places where an aligned block of ``b`` words
    occurs again b to 2 b - 1 words later. ``words`` holds whole blocks, the last
    two of which are only looked into; numbers are below the prime."""
    n = len(words) // b
    x = words.astype(np.uint64)
    squares = np.concatenate([[0], np.cumsum(_mod(x * x))]).astype(np.uint64)
    per_window = squares[b:] - squares[:-b]             # sums of b squares from each place on
    scale = np.uint64(pow(2 * b, PRIME - 2, PRIME) * 2 % PRIME)
    blocks, distances = [], []
    step = max(64, TILE // (2 * b))
    for a in range(0, n - 2, step):
        z = min(a + step, n - 2)
        f = np.zeros((2 * b, z - a + 2), np.uint64)
        f[:b] = x[a * b:(z + 2) * b].reshape(-1, b).T
        ntt(f)
        own, one, two = f[:, :-2], f[:, 1:-1], f[:, 2:]
        # the two following blocks as one input: the second is shifted by b, which
        # is a factor of 1 at even frequencies (front half) and -1 at odd ones
        window = np.concatenate([_less(one[:b] + two[:b]), _less(one[b:] + (_P - two[b:]))])
        products = inverse_ntt(_mod(window * own[_negated(2 * b)]))[:b]
        here = per_window[a * b:z * b:b]
        there = per_window[(a + 1) * b:(z + 1) * b].reshape(-1, b).T
        e, i = np.nonzero(_mod(here + there) == _mod(products * scale))
        blocks.append(i + a)
        distances.append(e + b)
    return (np.concatenate([np.empty(0, np.int64), *x]) for x in (blocks, distances))


# ------------------------------------------------------------ seeds to runs

def _equal_steps(words: np.ndarray, at: np.ndarray, d: np.ndarray, way: int, most: int) -> np.ndarray:
    """How many words from ``at`` on, going ``way`` (1 or -1), equal those d
    later; at most ``most``. The stretches looked at double until one differs."""
    out = np.zeros(len(at), np.int64)
    for a in range(0, len(at), max(1, COMPARED // most)):
        part = slice(a, a + max(1, COMPARED // most))
        live, width = np.arange(len(at))[part], 1
        while len(live):
            x = at[live, None] + way * (out[live, None] + np.arange(width))
            y = x + d[live, None]
            same = (x >= 0) & (y < len(words))
            same &= words[np.maximum(x, 0)] == words[np.minimum(y, len(words) - 1)]
            whole = same.all(axis=1)
            out[live] += np.where(whole, width, same.argmin(axis=1))
            live = live[whole & (out[live] < most)]
            width *= 2
    return np.minimum(out, most)


def _covered(start: np.ndarray, stop: np.ndarray, runs: np.ndarray) -> np.ndarray:
    """Whether one of the runs (start, stop, period) holds the whole stretch."""
    if not len(runs):
        return np.zeros(len(start), bool)
    order = np.argsort(runs[:, 0], kind="stable")
    reach = np.maximum.accumulate(runs[order, 1])
    i = np.searchsorted(runs[order, 0], start, "right") - 1
    return (i >= 0) & (reach[np.maximum(i, 0)] >= stop)


def find_runs(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """All runs (start, stop, period) of texts that stand in ``words`` one after
    another, each with a closing number of its own. ``lengths``: their numbers of
    words, the closing number not included, longest first."""
    runs = np.empty((0, 3), np.int64)
    bounds = np.concatenate([[0], np.cumsum(lengths + 1)])
    b = 1
    while len(lengths) and MIN_EXPONENT * b <= lengths[0]:
        front = int(bounds[np.searchsorted(-lengths, -max(MIN_EXPONENT * b, MIN_LENGTH), "right")])
        if not front:
            break
        fill = 2 * b + -front % b                       # two blocks to look into
        own = len(words) + np.arange(fill)              # numbers that no word has
        x = np.concatenate([words[:front], own])
        block, d = zero_mismatches(x, b)
        order = np.lexsort((block, d))
        block, d = block[order], d[order]
        first = np.ones(len(block), bool)
        first[1:] = (np.diff(block) != 1) | (np.diff(d) != 0)
        at = np.flatnonzero(first)
        start, d = block[at] * b, d[at]
        stop = (block[np.append(at[1:], len(block))[:len(at)] - 1] + 1) * b
        new = ~_covered(start, stop + d, runs)
        start, stop, d = start[new], stop[new], d[new]
        start = start - _equal_steps(x, start - 1, d, -1, b)
        stop = stop + _equal_steps(x, stop, d, 1, b) + d
        keep = (stop - start >= np.maximum(MIN_LENGTH, MIN_EXPONENT * d)) & ~_covered(start, stop, runs)
        runs = np.concatenate([runs, np.stack([start[keep], stop[keep], d[keep]], axis=1)])
        b *= 2
    return runs


def runs_of_texts(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each text, by start and period."""
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    number: dict[bytes, int] = {}
    for t in texts:
        for w in t:
            number.setdefault(w, len(number))
    lengths = np.array([len(texts[i]) for i in order], np.int64)
    # words, then closing numbers, are all below the number of places in ``words``
    words = np.empty(int(lengths.sum()) + len(texts), np.int64)
    at = 0
    for k, i in enumerate(order):
        n = len(texts[i])
        words[at:at + n] = np.fromiter(map(number.__getitem__, texts[i]), np.int64, n)
        words[at + n] = len(number) + k
        at += n + 1
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    starts = np.concatenate([[0], np.cumsum(lengths + 1)])
    runs = find_runs(words, lengths)
    for s, e, q, k in zip(*runs.T.tolist(), (np.searchsorted(starts, runs[:, 0], "right") - 1).tolist(), strict=True):
        out[order[k]].append((s - int(starts[k]), e - s, q))
    for found in out:
        found.sort(key=lambda r: (r[0], r[2]))
    return out


def without_repeats(words: list[bytes], runs: list[tuple[int, int, int]]) -> list[bytes]:
    """The words but for those that a run holds after its first period."""
    if not runs:
        return words
    keep = np.ones(len(words), bool)
    for start, length, q in runs:
        keep[start + q:start + length] = False
    return [words[i] for i in np.flatnonzero(keep).tolist()]


# ------------------------------------------------------------ Spark jobs

def planted(words: list[bytes], doc_id: int | None) -> list[bytes]:
    """The words with the period that the id asks for, if any."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


RUNS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()),
                  ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))),
                  ("collapsed", pa.string())])
_RUNS_SQL = "doc_id long, n_words long, runs array<struct<start long, length long, period long>>, collapsed string"

DIGEST = pa.schema([("doc_id", pa.int64()), ("n_runs", pa.int64()), ("start", pa.int64()), ("length", pa.int64()),
                    ("period", pa.int64()), ("exponent_milli", pa.int64()), ("runs_sha256", pa.string()),
                    ("collapsed_sha256", pa.string())])
_DIGEST_SQL = ("doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, "
               "collapsed_sha256 string")


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema, strict=True)], schema=schema)


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def periodic_runs(docs: DataFrame) -> DataFrame:
    """(doc_id, n_words, runs, collapsed): the runs of each text, and the text
    without their repeats (kept words joined by one space)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            words = [(t or "").encode().split() for t in texts]
            rows = []
            for doc, w, runs in zip(part.column("doc_id").to_pylist(), words, runs_of_texts(words), strict=True):
                found = [dict(zip(("start", "length", "period"), r, strict=True)) for r in runs]
                rows.append((doc, len(w), found, b" ".join(without_repeats(w, runs)).decode()))
            yield _batch(rows, RUNS)

    return _texts(docs).mapInArrow(run, _RUNS_SQL)


def digest(docs: DataFrame) -> DataFrame:
    """The runs of each text after ``planted``: how many, the longest, and
    hashes of all of them and of the text without their repeats."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches):
            ids = part.column("doc_id").to_pylist()
            words = [planted((t or "").encode().split(), i) for t, i in zip(texts, ids, strict=True)]
            rows = []
            for doc, w, runs in zip(ids, words, runs_of_texts(words), strict=True):
                s, n, q = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
                lines = "".join("%d,%d,%d\n" % r for r in runs)
                rows.append((doc, len(runs), s, n, q, 1000 * n // q if q else None, hashlib.sha256(lines.encode()).hexdigest(),
                             hashlib.sha256(b" ".join(without_repeats(w, runs))).hexdigest()))
            yield _batch(rows, DIGEST)

    return _texts(docs).mapInArrow(run, _DIGEST_SQL)
