"""SentencePiece BPE encoding with seeded merge-dropout, and decoding (operator 3).

Encoding works off an agenda of adjacent pairs, best score first. With
dropout, the t-th pair that a word's agenda yields is skipped if a hash keyed by
seed, document id, the word's place in the document and t falls under the
dropout rate. So the same seed gives the same segmentation anywhere, and every
occurrence of a word draws its own. Without dropout the ids are those of the
library.

Pieces never reach from one word into the next, so a word's segmentation is
settled by the word and the steps at which it skips. A word of n characters
merges n - 1 times at most: only the steps up to its (n - 1)-th merge count.
Words of a chunk that agree in both are merged once, and each worker keeps the
segmentations without skips. All are merged together: their agendas are the rows
of a matrix, and every step
takes each row's best pair. Segmentations are ranges of one array of ids, and a
chunk's ids are gathered from it at once.

Decoding joins the pieces' bytes. It is lossless for every text: characters
without a piece are byte pieces, and so is a literal U+2581, which would
otherwise be read as a space.

Defined cases: null and empty texts have no ids and decode to the empty text;
rows that repeat an id are encoded one by one, with the same key; a null id
counts as 0 in the key; an empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks, worker_cache

SPACE = "▁"
CACHE_WORDS = 400_000   # undropped segmentations that a worker keeps
STEPS = 63              # steps whose skips are told apart; words that may take more are merged one by one
WIDTHS = (4, 6, 8, 11, 16, 32, 64)    # agenda matrices by word length; longer words one by one
_M = (1 << 64) - 1
NONE = np.int32(2 ** 31 - 1)
_K = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F, 0xBF58476D1CE4E5B9)
LITERAL = ""            # cache key of a literal SPACE


def read_model(path: str) -> dict:
    """Pieces and scores of a BPE model file with byte fallback."""
    import sentencepiece
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    n = sp.get_piece_size()
    pieces = [sp.id_to_piece(i) for i in range(n)]
    special = [sp.is_control(i) or sp.is_unknown(i) for i in range(n)]
    scores = {p: sp.get_score(i) for i, p in enumerate(pieces) if not special[i] and not sp.is_byte(i)}
    if any(SPACE in p.lstrip(SPACE) for p in scores):
        raise ValueError("pieces that reach across words are not supported")
    return {"pieces": pieces, "special": special, "scores": scores, "ids": {p: i for i, p in enumerate(pieces)},
            "bytes": [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]}


class Encoder:
    def __init__(self, model: dict, seed: int = 0, dropout: float = 0.0, cache: dict | None = None):
        self.scores, self.ids, self.bytes = model["scores"], model["ids"], model["bytes"]
        self.seed, self.limit = seed, int(dropout * 2 ** 32)
        self.cache = {} if cache is None else cache
        self.byte_id = np.array(self.bytes, np.int32)
        # symbols: pieces by id, then the characters that occur in pieces only
        symbols = {p: self.ids[p] for p in self.scores}
        for p in self.scores:
            for c in p:
                symbols.setdefault(c, len(self.ids) + len(symbols))
        self.base = max(symbols.values()) + 1
        self.code = np.full(0x110000, -1, np.int32)
        for x, i in symbols.items():
            if len(x) == 1:
                self.code[ord(x)] = i
        # pairs by key; their rank orders them by score, best first
        pairs = [(symbols[p[:i]] * self.base + symbols[p[i:]], -s, self.ids[p]) for p, s in self.scores.items()
                 for i in range(1, len(p)) if p[:i] in symbols and p[i:] in symbols]
        keys, cost, into = (np.array(x) for x in zip(*pairs, strict=True))
        order = np.argsort(keys)
        distinct, rank = np.unique(cost, return_inverse=True)  # equal scores share a rank: leftmost first
        self.pair_key, self.pair_rank, self.pair_id = keys[order], rank[order].astype(np.int32), into[order].astype(np.int32)
        # where a pair stands, by open addressing; a quarter of the slots is in use at most
        bits = int(len(keys)).bit_length() + 2
        self.shift, self.slots = np.uint64(64 - bits), np.full(1 << bits, -1, np.int32)
        rest, slot = np.arange(len(keys)), self._slot(self.pair_key)
        while len(rest):
            free = self.slots[slot] < 0
            self.slots[slot[free]] = rest[free]
            left = self.slots[slot] != rest
            rest, slot = rest[left], (slot[left] + 1) % len(self.slots)

    def _skips(self, key: np.ndarray, step: int) -> np.ndarray:
        """Whether the pair that the agendas with these keys yield at a step is skipped."""
        h = key + np.uint64((step + 1) * _K[0] & _M)
        h = (h ^ (h >> np.uint64(31))) * np.uint64(_K[3])
        return ((h ^ (h >> np.uint64(29))) >> np.uint64(32)) < np.uint64(self.limit)

    def keys(self, docs: list[int], counts: np.ndarray) -> np.ndarray:
        """One key per word of documents with so many words each."""
        doc = np.array([xxhash.xxh64_intdigest(str(d), self.seed & _M) for d in docs], np.uint64)
        place = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
        h = np.repeat(doc, counts) + place.astype(np.uint64) * np.uint64(_K[1])
        h = (h ^ (h >> np.uint64(32))) * np.uint64(_K[2])
        return h ^ (h >> np.uint64(29))

    def steps(self, key: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The steps (as bits) at which words of so many characters skip, and
        which words may take more than STEPS steps."""
        skipped, more = np.zeros(len(key), np.uint64), np.zeros(len(key), bool)
        rows = np.flatnonzero(size > 1)
        key, merges = key[rows], size[rows] - 1
        for step in range(STEPS):
            skip = self._skips(key, step)
            skipped[rows[skip]] |= np.uint64(1 << step)
            merges = merges - ~skip
            live = merges > 0
            rows, key, merges = rows[live], key[live], merges[live]
        more[rows] = True
        return skipped, more

    def merge(self, word: str, key: int | None = None) -> list[int]:
        """Ids of one word by a heap as agenda; without a key none is skipped."""
        n, scores, step = len(word), self.scores, 0
        # symbols are spans [i, end[i]); start[e] is the symbol that ends at e
        end, start, agenda = list(range(1, n + 1)), list(range(-1, n)), []

        def offer(a, b):
            if (s := scores.get(word[a:end[b]])) is not None:
                heapq.heappush(agenda, (-s, a, b, end[b]))

        for i in range(n - 1):
            offer(i, i + 1)
        while agenda:
            _, a, b, e = heapq.heappop(agenda)
            if end[a] != b or end[b] != e:
                continue  # one side has been merged since
            if key is not None:
                step += 1
                h = key + step * _K[0] & _M
                h = (h ^ (h >> 31)) * _K[3] & _M
                if (h ^ (h >> 29)) >> 32 < self.limit:
                    continue
            end[a], end[b], start[e] = e, 0, a
            if a > 0:
                offer(start[a], a)
            if e < n:
                offer(a, e)
        out, i = [], 0
        while i < n:
            out += self._ids(word[i:end[i]])
            i = end[i]
        return out

    def _ids(self, symbol: str) -> list[int]:
        return [self.ids[symbol]] if symbol in self.scores else [self.bytes[x] for x in symbol.encode()]

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(_K[0]) >> self.shift).astype(np.int64)

    def _find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Places of the pairs of symbols that merge, -1 for the others."""
        k = left.astype(np.int64) * self.base + right
        slot = self._slot(k)
        at = self.slots[slot]
        at[(left < 0) | (right < 0)] = -1
        rest = np.flatnonzero((at >= 0) & (self.pair_key[at] != k))
        while len(rest):
            slot[rest] = (slot[rest] + 1) % len(self.slots)
            at[rest] = self.slots[slot[rest]]
            rest = rest[(at[rest] >= 0) & (self.pair_key[at[rest]] != k[rest])]
        return at

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of pairs of symbols, NONE for those that do not merge."""
        at = self._find(left.ravel(), right.ravel())
        return np.where(at >= 0, self.pair_rank[at], NONE).reshape(left.shape)

    def _merge_rows(self, sym: np.ndarray, n: np.ndarray, key: np.ndarray | None) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their starts after all merges; one word of n symbols per
        row, padded with -2. Every step takes one pair off each live row's agenda."""
        total, width = sym.shape
        out, out_start = np.full_like(sym, -2), np.zeros(sym.shape, np.int16)
        start = np.minimum(np.arange(width), n[:, None]).astype(np.int16)
        rank = self._pairs(sym[:, :-1], sym[:, 1:])
        row, step = np.arange(total), 0
        while True:
            best = rank.argmin(1)
            live = rank[np.arange(len(row)), best] != NONE
            if np.count_nonzero(live) < 0.75 * len(row):  # settled rows go, many at a time
                done, w = row[~live], sym.shape[1]
                out[done, :w], out_start[done, :w] = sym[~live], start[~live]
                row, n, best, sym, start, rank = (x[live] for x in (row, n, best, sym, start, rank))
                key, live = key if key is None else key[live], live[live]
            if not len(row):
                return out, out_start
            merged = np.flatnonzero(live)
            if key is not None:
                skip = self._skips(key[merged], step)
                rank[merged[skip], best[merged[skip]]] = NONE
                merged = merged[~skip]
            step += 1
            if not len(merged):
                continue
            best, m, w = best[merged], len(merged), sym.shape[1]
            sym[merged, best] = self.pair_id[self._find(sym[merged, best], sym[merged, best + 1])]
            keep = np.ones((m, w), bool)
            keep[np.arange(m), best + 1] = False
            for x in (sym, start):
                x[merged, :-1] = x[merged][keep].reshape(m, w - 1)
            sym[merged, -1] = -2
            keep = np.ones((m, w - 1), bool)
            keep[np.arange(m), best] = False
            rank[merged, :-1] = rank[merged][keep].reshape(m, w - 2)
            rank[merged, -1] = NONE
            n[merged] -= 1
            for j, rows in ((best - 1, best > 0), (best, best < w - 2)):
                j, rows = j[rows], merged[rows]
                rank[rows, j] = self._pairs(sym[rows, j], sym[rows, j + 1])
            if (w := max(int(n.max()), 2)) < sym.shape[1]:
                sym, start, rank = sym[:, :w].copy(), start[:, :w].copy(), rank[:, :w - 1].copy()

    def learn(self, words: list[str], keys: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An array of ids, and the start and number of each word's in it."""
        flat, first, size = [np.zeros(0, np.int32)], np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        length = np.fromiter(map(len, words), np.int64, len(words))
        slot, total = np.searchsorted(WIDTHS, length), 0
        for i in np.flatnonzero(slot == len(WIDTHS)).tolist():
            flat.append(np.array(self.merge(words[i], None if keys is None else int(keys[i])), np.int32))
            first[i], size[i] = total, len(flat[-1])
            total += len(flat[-1])
        for j, width in enumerate(WIDTHS):
            at = np.flatnonzero(slot == j)
            if not len(at):
                continue
            n = length[at]
            filled = np.arange(width) < n[:, None]
            chars = np.zeros((len(at), width), np.uint32)
            chars[filled] = np.frombuffer("".join([words[i] for i in at.tolist()]).encode("utf-32-le"), np.uint32)
            sym = np.where(filled, self.code[chars], np.int32(-2))
            ids, size[at] = self._flat(*self._merge_rows(sym, n, None if keys is None else keys[at]), chars)
            flat.append(ids)
            first[at] = total + np.cumsum(size[at]) - size[at]
            total += len(ids)
        return np.concatenate(flat), first, size

    def _flat(self, sym: np.ndarray, start: np.ndarray, chars: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rows' ids in one array, and their number by row. Characters without a piece become bytes."""
        some = sym != -2
        ids, size = sym[some], some.sum(1)
        odd = (ids < 0) | (ids >= len(self.ids))
        if not odd.any():
            return ids, size
        point = np.where(odd, chars[np.nonzero(some)[0], start[some]], 0).astype(np.int64)
        n = 1 + (point > 0x7F) + (point > 0x7FF) + (point > 0xFFFF)
        each = np.zeros(sym.shape, np.int64)
        each[some] = n
        nth = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        ids, odd, point, n = (np.repeat(x, n) for x in (ids, odd, point, n))
        lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[n]
        byte = np.where(nth == 0, lead, 0x80) | np.where((nth == 0) | (n == 1), point >> 6 * (n - 1), point >> 6 * (n - 1 - nth) & 0x3F)
        ids[odd] = self.byte_id[byte[odd]]
        return ids, each.sum(1)

    def words(self, text: str | None) -> list[str]:
        """A text's words; each takes the spaces before it."""
        if not text:
            return []
        if SPACE in text:  # SPACE marks a space from here on; a literal one is a word of its own
            first, *rest = text.split(SPACE)
            out = self._words(" " + first)
            for x in rest:
                out += [LITERAL, *self._words(x)]
            return out
        return self._words(" " + text)

    def _words(self, text: str) -> list[str]:
        units = text.replace(" ", " " + SPACE).split(" ")
        if not units[0]:
            del units[0]
        if SPACE in units:  # runs of spaces belong to what follows
            joined, run = [], ""
            for u in units:
                run += u
                if u != SPACE:
                    joined.append(run)
                    run = ""
            units = joined + [run] * bool(run)
        return units

    def _plain(self, words: list[str]) -> np.ndarray:
        """Places of the undropped segmentations of distinct words in the worker's store."""
        if len(self.cache.get("places", ())) > CACHE_WORDS:
            self.cache.clear()
        if not self.cache:
            literal = self.byte_id[list(SPACE.encode())]
            self.cache.update(places={LITERAL: 0}, flat=literal, first=np.zeros(1, np.int64), size=np.array([len(literal)]))
        places = self.cache["places"]
        new = [w for w in words if w not in places]
        flat, first, size = self.learn(new, None)
        places.update(zip(new, range(len(places), len(places) + len(new)), strict=True))
        self._add(self.cache, flat, first, size)
        return np.fromiter(map(places.__getitem__, words), np.int64, len(words))

    @staticmethod
    def _add(store: dict, flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> None:
        first = first + len(store["flat"])
        for name, x in (("flat", flat), ("first", first), ("size", size)):
            store[name] = np.concatenate([store[name], x])

    def encode_many(self, texts: list[str | None], docs: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts in one array, and where each text's begin and the last's end."""
        by_doc = [*map(self.words, texts)]
        counts = np.fromiter(map(len, by_doc), np.int64, len(by_doc))
        words = [w for ws in by_doc for w in ws]
        distinct = [*dict.fromkeys(words)]
        number = dict(zip(distinct, range(len(distinct)), strict=True))
        word = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        skipped, more, keys = np.zeros(len(words), np.uint64), np.zeros(len(words), bool), None
        if self.limit:
            keys = self.keys(docs, counts)
            skipped, more = self.steps(keys, np.fromiter(map(len, distinct), np.int64, len(distinct))[word])
        place = np.zeros(len(words), np.int64)
        plain = (skipped == 0) & ~more
        used = np.zeros(len(distinct), bool)
        used[word[plain]] = True
        of = np.zeros(len(distinct), np.int64)
        of[used] = self._plain([distinct[i] for i in np.flatnonzero(used).tolist()])
        place[plain] = of[word[plain]]
        store = {k: self.cache[k] for k in ("flat", "first", "size")}
        some = np.flatnonzero(~plain & ~more)
        some = some[np.lexsort((skipped[some], word[some]))]  # equal words that skip alike stand together
        head = np.ones(len(some), bool)
        head[1:] = (np.diff(word[some]) != 0) | (np.diff(skipped[some]) != 0)
        for at, which in ((some[head], (some, np.cumsum(head) - 1)), (np.flatnonzero(more), None)):
            if len(at):
                rows, nth = which or (at, np.arange(len(at)))
                place[rows] = len(store["first"]) + nth
                self._add(store, *self.learn([words[i] for i in at.tolist()], keys[at]))
        size = store["size"][place]
        ends = np.concatenate([[0], np.cumsum(size)])
        ids = store["flat"][np.repeat(store["first"][place] - ends[:-1], size) + np.arange(ends[-1])]
        return ids, ends[np.concatenate([[0], np.cumsum(counts)])]


class Decoder:
    def __init__(self, model: dict):
        value = {i: bytes([b]) for b, i in enumerate(model["bytes"])}
        table = [b"" if model["special"][i] else value.get(i) or p.replace(SPACE, " ").encode()
                 for i, p in enumerate(model["pieces"])]
        self.flat = np.frombuffer(b"".join(table), np.uint8)
        self.size = np.fromiter(map(len, table), np.int64, len(table))
        self.first = np.cumsum(self.size) - self.size

    def decode_many(self, ids: np.ndarray, ends: np.ndarray) -> list[str]:
        """Texts of the ids between one end and the next."""
        size = self.size[ids]
        at = np.concatenate([[0], np.cumsum(size)])
        raw = self.flat[np.repeat(self.first[ids] - at[:-1], size) + np.arange(at[-1])].tobytes()
        cut = at[ends].tolist()
        return [raw[a + (raw[a:a + 1] == b" " and a < b):b].decode(errors="replace") for a, b in pairwise(cut)]


def encode(docs: DataFrame, model_path: str, seed: int = 0, dropout: float = 0.0, id_col: str = "doc_id",
           text_col: str = "text") -> DataFrame:
    """(doc_id, ids) per row of ``docs``."""
    model = read_model(model_path)  # a vocabulary of fixed size, read on the driver and sent along
    own = f"pieces-{model_path}-{seed}-{dropout}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model, seed, dropout, worker_cache(own))
        for part, texts in chunks(batches, cache=own):
            ids, ends = coder.encode_many(texts, [d or 0 for d in part.column("doc_id").to_pylist()])
            ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), ids], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) per row of (doc_id, ids); null ids give an empty text."""
    model = read_model(model_path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(model)
        for b in batches:
            ids = b.column("ids").to_pylist()
            ends = np.cumsum([0, *(len(x or ()) for x in ids)])
            texts = coder.decode_many(np.array([i for x in ids for i in x or ()], np.int64), ends)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, model_path: str, seed: int = 0, dropout: float = 0.1) -> DataFrame:
    """(doc_id, n_ids, ids, lossless): encoded with dropout, and whether
    decoding gives the text back."""
    model = read_model(model_path)
    own = f"pieces-{model_path}-{seed}-{dropout}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(model, seed, dropout, worker_cache(own))
        back = Decoder(model)
        for part, texts in chunks(batches, cache=own):
            ids, ends = coder.encode_many(texts, [d or 0 for d in part.column("doc_id").to_pylist()])
            same = [x == (t or "") for x, t in zip(back.decode_many(ids, ends), texts, strict=True)]
            lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(ids))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.diff(ends), pa.int64()), lists,
                                              pa.array(same)], names=["doc_id", "n_ids", "ids", "lossless"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids array<int>, lossless boolean")
