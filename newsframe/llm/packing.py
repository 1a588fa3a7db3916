"""Best-two-fit packing of tokenized documents (operator 7).

Tasks tokenize the documents and cut those over the capacity. How pieces pack
depends on their lengths alone, so the packing is worked out on the histogram
of lengths (one count per length up to the capacity, whatever the input):
each sequence starts with the largest piece left and is filled greedily with
the largest piece that fits; where a gap stays, its smallest piece gives way
to the two unpacked pieces that fill the expanded gap best, as long as that
fills the sequence further. A filling is used as often as its lengths last,
so the plan stays small. Pieces then get a rank among those of equal length
(counted per salted block, so a frequent length is not one task's work) and
take the plan's places by rank.

Defined cases: a null or empty text is one piece holding only the end id;
rows that repeat an id are packed one by one; null ids are kept; an empty
table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from newsframe.llm.common import chunks, release_memory, worker_cache
from newsframe.session import written_table

CAPACITY = 4096
END_ID = 1
CACHE_WORDS = 250_000       # words with known ids that a worker keeps
WORD_END = "</w>"           # ends a vocabulary entry that ends a word
RANK_BLOCK = 100_000        # pieces ranked in one block, on average

PIECE = "doc_id long, piece int, start long, length long, ids_crc32 long"


# ------------------------------------------------------------ tokenizing

def _byte_of_character() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for:
    printable bytes stand for themselves, the others for U+0100 and onwards."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b != 173]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(sorted({*range(256)} - {*shown}))}


class WordTokenizer:
    """Ids of texts for a word-level BPE tokenizer whose pre-tokenizer drops
    white space: a text's ids are the ids of its words, one after another, so
    each distinct word is tokenized once and kept.

    Latin words are encoded many at a time by a faster library from the same
    vocabulary: a blank stands for the end-of-word mark, as no word holds one.
    Both libraries merge alike, as each vocabulary entry is encoded as itself
    (tested). Other words, and those that hold a special token, are left to
    the tokenizer."""

    #: Pre-tokenizer of the vocabulary (fixed value).
    PARTS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    #: Characters whose white space, case or normal form the libraries may see differently.
    OTHER = r"[^\x21-\x7e\xa1-\u012f\u0131-\u024f]"

    def __init__(self, tokenizer_json: str, cache: dict):
        import regex
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(tokenizer_json)
        special = {t.content for t in self.tok.get_added_tokens_decoder().values()}
        self.parts = regex.compile(self.PARTS)
        self.other = re.compile("|".join([self.OTHER, *map(re.escape, special)]))
        vocab = {t: i for t, i in self.tok.get_vocab().items() if t not in special}
        self.ends = np.zeros(max(vocab.values()) + 1, bool)  # ids that end a word
        self.ends[[i for t, i in vocab.items() if t.endswith(WORD_END)]] = True
        byte = _byte_of_character()
        ranks = {bytes(map(byte.__getitem__, t.removesuffix(WORD_END))) + b" " * t.endswith(WORD_END): i
                 for t, i in vocab.items()}
        self.fast = tiktoken.Encoding("words", pat_str=r"[^ \n]+ ", mergeable_ranks=ranks, special_tokens={})
        self.cache = cache

    def learn(self, words: Iterable[bytes]) -> None:
        """Put the ids of the words into the cache."""
        rest, latin, spelled = [], [], []
        for w in words:
            s = w.decode()
            if self.other.search(s):
                rest.append(w)
            else:
                latin.append(w)
                spelled.append(s.lower())
        marked = self.parts.sub(r"\g<0> ", "\n".join(spelled))
        ids = np.array(self.fast.encode_ordinary(marked), "<u4")
        ends = np.append(0, np.flatnonzero(self.ends[ids]) + 1)
        parts = np.cumsum([line.count(" ") for line in marked.split("\n")])
        raw, a = ids.tobytes(), 0
        for w, b in zip(latin, (4 * ends[parts]).tolist(), strict=bool(latin)):
            self.cache[w] = raw[a:b]
            a = b
        encoded = self.tok.encode_batch([w.decode() for w in rest], add_special_tokens=False)
        for w, e in zip(rest, encoded, strict=True):
            self.cache[w] = np.array(e.ids, "<u4").tobytes()

    def ids(self, texts: list[str | None]) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        words = [(t or "").encode().split() for t in texts]
        missing = set().union(*words).difference(self.cache)
        if missing and len(self.cache) > CACHE_WORDS:
            self.cache.clear()
            missing = set().union(*words)
        self.learn(missing)
        for w in words:
            yield b"".join(map(self.cache.__getitem__, w))


def tokenized_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece of each document's ids, the end id included."""
    with open(tokenizer_path, encoding="utf-8") as f:  # a vocabulary file of fixed size
        spec = f.read()
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = None
        for part, texts in chunks(batches, cache="packing"):
            tok = tok or WordTokenizer(spec, worker_cache("packing"))
            out = []
            for doc, ids in zip(part.column("doc_id").to_pylist(), tok.ids(texts), strict=True):
                ids += END_ID.to_bytes(4, "little")
                for i, a in enumerate(range(0, len(ids), 4 * capacity)):
                    x = ids[a:a + 4 * capacity]
                    out.append((doc, i, a // 4, len(x) // 4, zlib.crc32(x)))
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema, strict=True)],
                                             schema=schema)
        del tok     # the worker waits for its next task without the vocabulary
        release_memory()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, PIECE)


# ------------------------------------------------------------ the plan

def _fill(c: np.ndarray, capacity: int) -> list[int]:
    """Lengths of one sequence, largest first, from the counts c (changed)."""
    def take(x):
        c[x] -= 1
        return int(x)

    def largest(most):
        i = int(np.searchsorted(avail, most, "right")) - 1
        while i >= 0 and c[avail[i]] <= 0:
            i -= 1
        return int(avail[i]) if i >= 0 else 0

    avail = np.flatnonzero(c > 0)
    if not len(avail):
        return []
    pat, gap = [], capacity
    while gap and (x := largest(gap)):
        pat.append(take(x))
        gap -= x
    while gap and len(pat) > 1:
        small = min(pat)
        space = gap + small
        c[small] += 1
        left = avail[c[avail] > 0]
        c[small] -= 1
        left = left[left < space]
        if not len(left):
            break
        at = np.searchsorted(left, np.minimum(left, space - left), "right") - 1
        twice = (at >= 0) & (left[at] == left) & (c[left] + (left == small) < 2)
        at = np.where(twice, at - 1, at)
        both = np.where(at >= 0, left + left[np.maximum(at, 0)], 0)
        best = int(np.argmax(both))
        if both[best] <= small:
            break
        pat.remove(small)
        c[small] += 1
        pat += [take(left[best]), take(left[at[best]])]
        gap = space - int(both[best])
    return sorted(pat, reverse=True)


def best_two_fit(counts: np.ndarray, capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """The plan for ``counts[length]`` pieces: (lengths of a sequence, how
    many sequences are filled so)."""
    c, plan = counts.copy(), []
    while True:
        before = c.copy()
        pat = _fill(c, capacity)
        if not pat:
            return plan
        uses = Counter(pat)
        m = min(int(before[x]) // u for x, u in uses.items())
        for x, u in uses.items():
            c[x] = before[x] - u * m
        plan.append((pat, m))


def _places(plan: list[tuple[list[int], int]]) -> tuple[np.ndarray, ...]:
    """The plan by length: entry key (length and first rank), pieces of that
    length per sequence, first sequence id, and the places in a sequence."""
    entries, used, first = [], Counter(), 0
    for pat, m in plan:
        at, offsets = 0, {}
        for x in pat:
            offsets.setdefault(x, []).append(at)
            at += x
        for x, places in offsets.items():
            entries.append((x, used[x], len(places), first, places))
            used[x] += len(places) * m
        first += m
    entries.sort(key=lambda e: e[:2])
    length, rank, k, base = (np.array([e[i] for e in entries], np.int64) for i in range(4))
    flat = np.array([p for e in entries for p in e[4]], np.int64)
    return length, rank, k, base, np.cumsum(k) - k, flat


# ------------------------------------------------------------ packing

def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset)."""
    spark = docs.sparkSession
    pieces = written_table(tokenized_pieces(docs, tokenizer_path, capacity), "pieces")
    counts = np.zeros(capacity + 1, np.int64)
    for r in pieces.groupBy("length").count().collect():  # at most `capacity` rows
        counts[r["length"]] = r["count"]
    if not counts.sum():
        return spark.createDataFrame([], PIECE + ", sequence_id long, offset long")
    plan = spark.sparkContext.broadcast(_places(best_two_fit(counts, capacity)))

    blocks = 16 + int(counts.sum()) // RANK_BLOCK
    p = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(blocks)))
    before = Window.partitionBy("length").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = (p.groupBy("length", "block").count()
               .select("length", "block", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("first")))
    own = Window.partitionBy("length", "block").orderBy("doc_id", "piece", "ids_crc32")
    ranked = (p.withColumn("own", F.row_number().over(own) - 1).join(starts, ["length", "block"])
               .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("first") + F.col("own")).alias("rank")))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, k, base, at, flat = plan.value
        starts = np.searchsorted(length, np.arange(capacity + 2))
        for b in batches:
            x, r = (b.column(n).to_numpy() for n in ("length", "rank"))
            e = np.empty(len(x), np.int64)
            for v in np.unique(x):
                mine = x == v
                lo, hi = starts[v], starts[v + 1]
                e[mine] = lo + np.searchsorted(first[lo:hi], r[mine], "right") - 1
            i = r - first[e]
            seq, off = base[e] + i // k[e], flat[at[e] + i % k[e]]
            yield pa.RecordBatch.from_arrays(
                [*(b.column(n) for n in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(seq),
                 pa.array(off)], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.mapInArrow(place, PIECE + ", sequence_id long, offset long")
