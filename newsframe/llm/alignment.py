"""Alignment of two tokenizers' segmentations of the same texts (operator 12).

Tasks encode space + text with a byte-level BPE tokenizer (A) and the text
with a SentencePiece model (B, which adds the space itself), and turn both
into byte ends. The ends are merged in lockstep: the state is one NumPy vector
of A and B pointers with a lane for each document of the chunk (a long document
has a lane for each byte range of ``LANE_BYTES``, as pointers into sorted ends can
start anywhere). A step compares the ends under all pointers at once; equal
ends are links and cut the document there, the pointer of the smaller end
advances (both at a link), and lanes at their end are compacted away.

A link's tokens end together, so the bytes of one are a suffix of the other's.
The id pairs that can be linked are therefore known from the vocabularies (some
300,000 for those given) and get dense numbers: a document's links are stored
as such numbers, and what tasks need of the corpus-wide counts is one vector
of that bounded length.

Defined cases: texts that are null, empty, or whose joined token bytes differ
from space + text (a normalizing model, a literal U+2581) have no tokens; rows
that repeat an id are aligned one by one and each counts; null ids are kept; an
empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks
from newsframe.session import written_table

LANE_BYTES = 2048
JOIN_TOKENS = 250_000       # tokens whose bytes are joined at once
SPACE = "▁"


# ------------------------------------------------------------ vocabularies

def _byte_of_char() -> dict[str, int]:
    """Byte-level BPE writes each byte as one visible character: printable
    Latin-1 bytes as themselves, the others as U+0100 onwards."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """Token bytes by id, as one buffer with offsets and lengths."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.offset = np.cumsum(self.length) - self.length
        self.blob = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of the tokens, one after another."""
        parts = [np.empty(0, np.uint8)]
        for a in range(0, len(ids), JOIN_TOKENS):
            n = self.length[ids[a:a + JOIN_TOKENS]]
            first = self.offset[ids[a:a + JOIN_TOKENS]] - (np.cumsum(n) - n)
            parts.append(self.blob[np.repeat(first, n) + np.arange(n.sum())])
        return np.concatenate(parts)


def byte_level_tokens(spec: str) -> list[bytes]:
    """Bytes of each id of a byte-level BPE tokenizer."""
    from tokenizers import Tokenizer
    vocab = Tokenizer.from_str(spec).get_vocab(with_added_tokens=True)
    byte = _byte_of_char()
    out = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        out[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
    return out


def piece_tokens(model: bytes) -> list[bytes]:
    """Bytes of each id of a SentencePiece model with byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_proto=model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    return [bytes([int(p[3:5], 16)]) if sp.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(pieces)]


def linkable_pairs(a: list[bytes], b: list[bytes]) -> np.ndarray:
    """The id pairs whose tokens can end together, as sorted numbers
    a_id * len(b) + b_id. One token's bytes end with the other's, so there are
    at most as many as all tokens have suffixes, times ids of equal bytes."""
    by_bytes: list[dict[bytes, list[int]]] = []
    for tokens in (a, b):
        ids = defaultdict(list)
        for i, t in enumerate(tokens):
            if t:
                ids[t].append(i)
        by_bytes.append(ids)
    of_a, of_b = by_bytes
    keys = [i * len(b) + j for t, ids in of_a.items() for k in range(len(t)) for j in of_b.get(t[k:], ()) for i in ids]
    keys += [i * len(b) + j for t, ids in of_b.items() for k in range(1, len(t)) for i in of_a.get(t[k:], ()) for j in ids]
    return np.unique(np.array(keys, np.int64))


# ------------------------------------------------------------ merging

def lockstep_links(ends_a: np.ndarray, ends_b: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> tuple[np.ndarray, ...]:
    """Places (in ends_a, in ends_b) of equal ends, ascending. Both inputs are
    ascending over all documents; a document's ends lie in (start, stop]."""
    n = -(-(stops - starts) // LANE_BYTES)
    lane = np.repeat(np.arange(len(starts)), n)
    at = starts[lane] + LANE_BYTES * (np.arange(len(lane)) - np.repeat(np.cumsum(n) - n, n))
    to = np.minimum(at + LANE_BYTES, stops[lane])
    ia, ib, stop_a, stop_b = (np.searchsorted(e, x, "right") for x in (at, to) for e in (ends_a, ends_b))
    links_a, links_b = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
    while len(ia):
        live = (ia < stop_a) & (ib < stop_b)
        if not live.all():
            ia, ib, stop_a, stop_b = ia[live], ib[live], stop_a[live], stop_b[live]
        x, y = ends_a[ia], ends_b[ib]
        met = x == y
        links_a.append(ia[met])
        links_b.append(ib[met])
        ia, ib = ia + (x <= y), ib + (y <= x)
    return np.sort(np.concatenate(links_a)), np.sort(np.concatenate(links_b))


class ByteBpe:
    """Ids of a byte-level BPE tokenizer. Latin texts go to a faster library that
    takes the same vocabulary as ranks; the letter and digit classes of the two
    libraries can only differ in scripts that Unicode still extends, so texts with
    other characters, and very long ones, go to the tokenizer itself."""

    OTHER = re.compile("[^\\x00-\u024f\u2010-\u2027\u20ac]")
    PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    LONG = 200_000

    def __init__(self, spec: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"      # a task has one core
        import tiktoken
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_str(spec)
        self.tok.encode_special_tokens = True
        special = self.tok.get_added_tokens_decoder()
        ranks = {t: i for i, t in enumerate(byte_level_tokens(spec)) if i not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=self.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str) -> np.ndarray:
        if len(text) > self.LONG or self.OTHER.search(text):
            return np.array(self.tok.encode(text, add_special_tokens=False).ids, np.int32)
        return np.array(self.fast.encode_ordinary(text), np.int32)


class Aligner:
    """Encodes the texts of a chunk with both tokenizers and aligns them."""

    def __init__(self, spec: str, model: bytes, a: Vocabulary, b: Vocabulary):
        import sentencepiece
        self.bpe = ByteBpe(spec)
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.a, self.b = a, b

    def align(self, texts: list[str | None]) -> Aligned:
        none = np.empty(0, np.int32)
        ids_a, ids_b = [none] * len(texts), [none] * len(texts)
        for i, text in enumerate(texts):
            if not text:
                continue
            x, y = self.bpe.ids(" " + text), np.array(self.sp.encode(text), np.int32)
            want = np.frombuffer(b" " + text.encode(), np.uint8)
            if np.array_equal(self.a.joined(x), want) and np.array_equal(self.b.joined(y), want):
                ids_a[i], ids_b[i] = x, y
        return Aligned(ids_a, ids_b, self.a, self.b)


class Aligned:
    """The aligned segmentations of a chunk's texts, in flat arrays; ``at_a``,
    ``at_b`` and ``at_link`` are the bounds of each text in them."""

    def __init__(self, ids_a: list[np.ndarray], ids_b: list[np.ndarray], a: Vocabulary, b: Vocabulary):
        self.at_a = np.cumsum([0, *map(len, ids_a)])
        self.at_b = np.cumsum([0, *map(len, ids_b)])
        self.a = np.concatenate(ids_a) if ids_a else np.empty(0, np.int32)
        self.b = np.concatenate(ids_b) if ids_b else np.empty(0, np.int32)
        ends_a, ends_b = np.cumsum(a.length[self.a]), np.cumsum(b.length[self.b])
        bounds = np.concatenate([[0], ends_a])[self.at_a]
        self.link_a, self.link_b = lockstep_links(ends_a, ends_b, bounds[:-1], bounds[1:])
        self.at_link = np.searchsorted(self.link_a, self.at_a, "left")

    def group_texts(self, table: DigitTable) -> Iterator[memoryview]:
        """Each text's groups as ``a1,a2|b1;a3|b2,b3``."""
        last_a, last_b = np.zeros(len(self.a), np.int64), np.zeros(len(self.b), np.int64)
        last_a[self.link_a] = last_b[self.link_b] = 1
        group_a, group_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        last_b[self.at_b[1:][np.diff(self.at_b) > 0] - 1] = 2
        before_b = np.concatenate([[0], self.link_b + 1])
        rows = np.empty(len(self.a) + len(self.b), np.int64)
        rows[np.arange(len(self.a)) + before_b[group_a]] = table.a_rows(self.a, last_a)
        rows[np.arange(len(self.b)) + self.link_a[group_b] + 1] = table.b_rows(self.b, last_b)
        flat = memoryview(table.text(rows))
        bounds = np.concatenate([[0], np.cumsum(table.length[rows])])[self.at_a + self.at_b]
        for x, y in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield flat[x:y]


class DigitTable:
    """Decimal ids followed by a sign, as rows of bytes: A ids with ``,`` or
    ``|``, B ids with ``,``, ``;`` or nothing (the last of a text)."""

    def __init__(self, n_a: int, n_b: int):
        words = [b"%d%s" % (i, s) for i in range(n_a) for s in (b",", b"|")]
        words += [b"%d%s" % (i, s) for i in range(n_b) for s in (b",", b";", b"")]
        self.first_b = 2 * n_a
        self.length = np.array([len(w) for w in words], np.int64)
        width = int(self.length.max())
        self.bytes = np.array(words, f"S{width}").view(np.uint8).reshape(len(words), width)

    def a_rows(self, ids: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return 2 * ids.astype(np.int64) + kind

    def b_rows(self, ids: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return self.first_b + 3 * ids.astype(np.int64) + kind

    def text(self, rows: np.ndarray) -> bytes:
        parts = []
        for a in range(0, len(rows), JOIN_TOKENS):
            some = rows[a:a + JOIN_TOKENS]
            parts.append(self.bytes[some][np.arange(self.bytes.shape[1]) < self.length[some, None]].tobytes())
        return b"".join(parts)


# ------------------------------------------------------------ Spark jobs

def _read(a_json: str, b_model: str) -> tuple[str, bytes]:
    with open(a_json, encoding="utf-8") as f, open(b_model, "rb") as g:  # vocabulary files of fixed size
        return f.read(), g.read()


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def alignments(docs: DataFrame, a_json: str, b_model: str) -> DataFrame:
    """(doc_id, a_ids, b_ids, a_cuts, b_cuts): both segmentations, and for each
    group the number of A and of B tokens up to its end. The last tokens of a
    group are linked."""
    spec, model = _read(a_json, b_model)
    a, b = Vocabulary(byte_level_tokens(spec)), Vocabulary(piece_tokens(model))
    ints = pa.list_(pa.int32())
    schema = pa.schema([("doc_id", pa.int64()), *((n, ints) for n in ("a_ids", "b_ids", "a_cuts", "b_cuts"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = None
        for part, texts in chunks(batches):
            aligner = aligner or Aligner(spec, model, a, b)
            x = aligner.align(texts)
            n = np.diff(x.at_link)
            cuts_a = x.link_a + 1 - np.repeat(x.at_a[:-1], n)
            cuts_b = x.link_b + 1 - np.repeat(x.at_b[:-1], n)
            lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(v, pa.int32())) for at, v in
                     ((x.at_a, x.a), (x.at_b, x.b), (x.at_link, cuts_a), (x.at_link, cuts_b))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), *lists], schema=schema)

    return _rows(docs).mapInArrow(run, "doc_id long, a_ids array<int>, b_ids array<int>, a_cuts array<int>, b_cuts array<int>")


DIGEST = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"


def _stored_links(docs: DataFrame, spec: str, model: bytes, tokens_a: list[bytes], tokens_b: list[bytes],
                  pairs: np.ndarray) -> DataFrame:
    """DIGEST and ``pairs``: the dense numbers of the document's links."""
    shared = docs.sparkSession.sparkContext.broadcast((Vocabulary(tokens_a), Vocabulary(tokens_b), pairs))
    n_b = len(tokens_b)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = table = None
        for part, texts in chunks(batches):
            if aligner is None:
                a, b, numbers = shared.value
                aligner, table = Aligner(spec, model, a, b), DigitTable(len(a.length), len(b.length))
            x = aligner.align(texts)
            sha = [hashlib.sha256(t).hexdigest() if len(t) else "" for t in x.group_texts(table)]
            links = np.searchsorted(numbers, x.a[x.link_a].astype(np.int64) * n_b + x.b[x.link_b])
            n = np.diff(x.at_link)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id"), pa.array(np.diff(x.at_a)), pa.array(np.diff(x.at_b)), pa.array(n), pa.array(n),
                 pa.array(sha, pa.string()),
                 pa.ListArray.from_arrays(pa.array(x.at_link, pa.int32()), pa.array(links, pa.int32()))],
                names=["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs"])

    return _rows(docs).mapInArrow(run, DIGEST + ", pairs array<int>")


def link_counts(stored: DataFrame) -> DataFrame:
    """(pair, n): how many links of the corpus hold the pair."""
    return stored.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n"))


def align_digest(docs: DataFrame, a_json: str, b_model: str) -> DataFrame:
    """DIGEST, n_best (links whose pair is its B id's most frequent one, ties
    included) and count_sum (corpus-wide counts summed over the links)."""
    spec, model = _read(a_json, b_model)
    tokens_a, tokens_b = byte_level_tokens(spec), piece_tokens(model)
    pairs = linkable_pairs(tokens_a, tokens_b)
    stored = written_table(_stored_links(docs, spec, model, tokens_a, tokens_b, pairs), "alignment")
    counts = np.zeros(len(pairs), np.int64)
    seen = link_counts(stored).toArrow()    # at most len(pairs) rows, whatever the corpus
    counts[seen["pair"].to_numpy()] = seen["n"].to_numpy()
    most = np.zeros(len(tokens_b), np.int64)
    np.maximum.at(most, pairs % len(tokens_b), counts)
    shared = docs.sparkSession.sparkContext.broadcast((counts, counts == most[pairs % len(tokens_b)]))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, best = shared.value
        for batch in batches:
            lists = batch.column("pairs")
            flat, at = lists.flatten().to_numpy(), np.concatenate([[0], np.cumsum(lists.value_lengths().to_numpy())])
            sums = [np.concatenate([[0], np.cumsum(v[flat], dtype=np.int64)]) for v in (best, n)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *(pa.array(s[at[1:]] - s[at[:-1]]) for s in sums)],
                                             names=[*batch.schema.names[:-1], "n_best", "count_sum"])

    return stored.mapInArrow(score, DIGEST + ", n_best long, count_sum long")
