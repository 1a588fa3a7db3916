"""MinHash near-duplicate detection with odd sketches (operator 1).

One pass over the texts gives each document its set size, the band keys of
its MinHash signature and an odd sketch: every (sample, minimum) pair toggles
one bit of a parity bitmap, so the population count of two sketches' XOR
estimates the number of differing samples, most precisely at high similarity
(Mitzenmacher, Pagh, Pham 2014). A second bitmap takes the whole set in the
same way: two of those never differ in more bits than the sets in shingles, so
a pair whose bitmaps differ in too many bits cannot reach the threshold; for
sets that are small beside the bitmap this is almost as sharp as the sets
themselves. Documents of equal word sequences collapse
to one representative before any pairing. Candidates come from equal band
keys; the estimate and the bound remove those that are below the threshold, and
the rest is confirmed on the full shingle sets.

Pairing stays linear in hot bands: in each of ``HUB_ROUNDS`` rounds every
document is compared with one hub, the most central document (that meets most
others in its bands) of a band, chosen by how many bands they share. Links
make components; afterwards just the pairs of a band that lie in different
components are left, and in each band they have a side outside the band's
largest component. Those are all checked, so no pair of a band is skipped.

A shingle is the hash (64 bits) of five words; documents with fewer words
have their whole sequence as the only shingle. Words are
``[^\\x20\\x09-\\x0D]+`` with A-Z lower-cased.

Defined cases: null and empty texts have no shingles and link with nothing;
rows with a null id are kept, with null component; rows that repeat an id are
one document in the links (linked if any of their texts is); an empty table
gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks, fresh, text_key, worker_cache
from newsframe.session import small_table, written_table

SHINGLE_WORDS = 5
SAMPLES = 256                   # MinHash samples, all in the sketch
BANDS, ROWS = 32, 4             # bands of samples: a pair at 0.75 is missed with 5e-6
SKETCH_BITS = 1024
HUB_ROUNDS = 2
SIGMAS = 5                      # a pair at the threshold fails the sketch filter with under 1e-6
THRESHOLD = (75, 100)           # similarity as a fraction
CACHE_WORDS = 50_000            # hashes that a worker keeps: cheap to make again
MAX_ROUNDS = 64                 # of the components' star steps, which end when nothing changes


# ---------------------------------------------------- shingles and sketches

def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


class WordHashes(dict):
    """Word -> 64-bit hash, worked out at the first use."""

    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh64_intdigest(word)
        return h


def shingles(words: list[bytes], hashes: dict, k: int = SHINGLE_WORDS) -> np.ndarray:
    """The distinct shingle hashes of a word sequence, sorted."""
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    n = max(1, len(h) - k + 1)
    s = np.full(n, min(len(h), k), np.uint64)
    for j in range(min(k, len(h))):
        s = _mix(s * np.uint64(0x9E3779B97F4A7C15) + h[j:j + n])
    return np.unique(s)


def signature(sets: np.ndarray, mult: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The MinHash samples of a set of hashes."""
    x = (sets ^ (sets >> np.uint64(32))).astype(np.uint32)
    low = np.full(len(mult), 0xFFFFFFFF, np.uint32)
    for a in range(0, len(x), 2048):
        np.minimum(low, ((x[a:a + 2048, None] ^ add) * mult).min(0), out=low)
    return low


def odd_sketch(sig: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """Parity bitmap of the samples, as signed 64-bit words."""
    return _parity(_mix(sig.astype(np.uint64) + (np.arange(len(sig), dtype=np.uint64) << np.uint64(32))), bits)


def _parity(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    odd = np.bincount((hashes % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def _split(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []  # bytes: ASCII letters and spaces only


def _hashes() -> WordHashes:
    """The worker's word hashes; emptied when they have grown large."""
    home = worker_cache("minhash")
    known = home.setdefault("hashes", WordHashes())
    if len(known) > CACHE_WORDS:
        known.clear()
    return known


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, seq, n_shingles, bands, sketch, whole): seq is a 128-bit digest
    of the word sequence (null without words), whole the set's own bitmap."""
    schema = pa.schema([("doc_id", pa.int64()), ("seq", pa.binary()), ("n_shingles", pa.int64()),
                        ("bands", pa.list_(pa.int64())), ("sketch", pa.list_(pa.int64())),
                        ("whole", pa.list_(pa.int64()))])
    rng = np.random.default_rng(20240229)
    mult = rng.integers(0, 2 ** 31, SAMPLES, np.uint32) * np.uint32(2) + np.uint32(1)
    add = rng.integers(0, 2 ** 32, SAMPLES, np.uint32)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, cache="minhash"):
            seq, size, bands, odd, whole = [], [], [], [], []
            for text in texts:
                words, known = _split(text), _hashes()
                sets = shingles(words, known)
                size.append(len(sets))
                if not len(sets):
                    seq.append(None), bands.append([]), odd.append([]), whole.append([])
                    continue
                seq.append(xxhash.xxh3_128_digest(b" ".join(words)))
                sig = signature(sets, mult, add)
                key = np.arange(BANDS, dtype=np.uint64)
                for col in sig[:BANDS * ROWS].reshape(-1, ROWS).T:
                    key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + col)
                bands.append(key.view(np.int64)), odd.append(odd_sketch(sig)), whole.append(_parity(sets))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(seq, pa.binary()), pa.array(size),
                                              pa.array(bands, schema[3].type), pa.array(odd, schema[4].type),
                                              pa.array(whole, schema[5].type)],
                                             schema=schema)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, "doc_id long, seq binary, n_shingles long, bands array<long>, sketch array<long>, "
                                "whole array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """(doc_id, shingles): the whole sets, for the documents of candidate pairs."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, cache="minhash"):
            sets = [shingles(_split(t), _hashes()).view(np.int64) for t in texts]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["doc_id", "shingles"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, shingles array<long>")


# ---------------------------------------------------- candidates and links

def _odd_bits(a: str, b: str) -> Column:
    """Population count of the XOR of two sketches."""
    out = F.lit(0)
    for i in range(SKETCH_BITS // 64):
        out = out + F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i]))
    return out


def _most_odd_bits(num: int, den: int) -> int:
    """Odd bits that a pair at the threshold stays within: differing samples
    at SIGMAS standard deviations, then the bitmap's own deviation."""
    j = num / den
    differ = SAMPLES * (1 - j) + SIGMAS * math.sqrt(SAMPLES * j * (1 - j))
    expected = SKETCH_BITS * (1 - math.exp(-4 * differ / SKETCH_BITS)) / 2
    return math.ceil(expected + 2 * math.sqrt(expected))


def _plausible(num: int, den: int) -> Column:
    """Set sizes, sketches and whole bitmaps allow a link between the sides a
    and b. Linked sets differ in at most (den - num) / (den + num) of their sizes' sum."""
    sizes = F.least("n_a", "n_b") * den >= F.greatest("n_a", "n_b") * num
    differ = _odd_bits("w_a", "w_b") * (den + num) <= (F.col("n_a") + F.col("n_b")) * (den - num)
    return sizes & (_odd_bits("s_a", "s_b") <= _most_odd_bits(num, den)) & differ


def verified(pairs: DataFrame, docs: DataFrame, num: int, den: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold."""
    need = written_table(pairs.select(F.explode(F.array("a", "b")).alias("doc_id")).distinct(), "minhash-need")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    texts = texts.join(need, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    sets = written_table(full_sets(texts), "minhash-sets")
    got = (pairs.select("a", "b").join(sets.withColumnsRenamed({"doc_id": "a", "shingles": "sa"}), "a")
                .join(sets.withColumnsRenamed({"doc_id": "b", "shingles": "sb"}), "b"))
    both = F.size(F.array_intersect("sa", "sb"))
    link = both * den >= (F.size("sa") + F.size("sb") - both) * num
    return got.where(link).select("a", "b").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the smallest node reachable over the links (a, b), by
    alternating large-star and small-star steps (Kiveris et al. 2014)."""
    edges = written_table(links.where("a <> b").select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi"))
                          .distinct(), "stars")
    for _ in range(MAX_ROUNDS):
        both = edges.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(edges.select("hi", "lo"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("m").alias("lo"), F.col("v").alias("hi"))
        large = large.where("lo <> hi").distinct()
        least = large.groupBy("hi").agg(F.min("lo").alias("m"))
        small = (large.join(least, "hi").select(F.col("m").alias("lo"), F.explode(F.array("lo", "hi")).alias("hi"))
                      .where("lo <> hi").distinct())
        new = written_table(small, "stars")
        # stable when each node has one, smaller, neighbour that is no one's child
        chained = new.join(new.select(F.col("hi").alias("lo")).distinct(), "lo", "left_semi")
        edges = new
        if chained.isEmpty() and new.groupBy("hi").count().where("count > 1").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("hi").alias("node"), F.col("lo").alias("comp"))


def _labelled(nodes: DataFrame, comp: DataFrame) -> DataFrame:
    return (nodes.join(comp.withColumnRenamed("node", "rep"), "rep", "left")
                 .withColumn("comp", F.coalesce("comp", "rep")))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def _hub_pairs(lab: DataFrame, tested: DataFrame | None) -> DataFrame:
    """(a, b): each document b with the hub a that it meets in most bands, if
    that is of another component. ``lab``: (band, rep, comp, degree)."""
    hub = lab.groupBy("band").agg(F.max_by(F.struct("rep", "comp"), F.struct("degree", -F.col("rep"))).alias("hub"))
    met = (lab.join(hub, "band").where(F.col("comp") != F.col("hub.comp"))
              .groupBy(F.col("rep").alias("b"), F.col("hub.rep").alias("a")).agg(F.count("*").alias("bands")))
    if tested is not None:
        met = met.join(tested, ["a", "b"], "left_anti")
    return met.groupBy("b").agg(F.max_by("a", F.struct("bands", -F.col("a"))).alias("a")).select("a", "b")


def near_duplicates(docs: DataFrame, num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row of ``docs``; documents
    link when their sets' similarity is at least num / den."""
    sk = written_table(sketches(docs), "minhash-sketches")
    named = sk.where("seq IS NOT NULL AND doc_id IS NOT NULL")
    classes = written_table(named.groupBy("seq").agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_rows")),
                            "minhash-classes")
    # the smallest id of each class stands for it
    reps = (named.join(classes.select("seq", F.col("rep").alias("doc_id")), ["seq", "doc_id"], "left_semi")
                 .dropDuplicates(["seq"])
                 .select(F.col("doc_id").alias("rep"), F.col("n_shingles").alias("n"), "sketch", "whole", "bands"))
    band = reps.select("rep", F.explode("bands").alias("band"))
    shared = band.groupBy("band").agg(F.count_distinct("rep").alias("size")).where("size > 1")
    member = written_table(band.join(shared, "band"), "minhash-bands")
    degree = member.groupBy("rep").agg(F.sum("size").alias("degree"))
    part = written_table(reps.drop("bands").join(degree, "rep"), "minhash-parts")

    def side(x):
        return part.select(F.col("rep").alias(x), F.col("n").alias(f"n_{x}"), F.col("sketch").alias(f"s_{x}"),
                           F.col("whole").alias(f"w_{x}"))

    # 1: each document with a hub of its bands, in rounds
    links = written_table(_same_id(classes, named), "minhash-links")
    comp, tested = components(links), None
    for _ in range(HUB_ROUNDS):
        lab = _labelled(member.select("band", "rep"), comp)
        pairs = _hub_pairs(lab.join(part.select("rep", "degree"), "rep"), tested)
        pairs = written_table(pairs.join(side("b"), "b").join(side("a"), "a").where(_plausible(num, den))
                              .select("a", "b"), "minhash-pairs")
        tested = pairs if tested is None else tested.union(pairs)
        links = written_table(links.union(verified(pairs, docs, num, den)), "minhash-links")
        comp = components(links)

    # 2: what is left between components of the same band
    lab = _labelled(member.select("band", "rep"), comp)
    per = lab.groupBy("band", "comp").count()
    mixed = per.groupBy("band").agg(F.max_by("comp", F.struct("count", "comp")).alias("main"),
                                    F.count("*").alias("comps")).where("comps > 1").drop("comps")
    open_ = written_table(lab.join(mixed, "band").join(part, "rep"), "minhash-open")
    x, y = (open_.select("band", "main", *(F.col(c).alias(f"{c}_{s}") for c in ("rep", "comp")),
                         F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"),
                         F.col("whole").alias(f"w_{s}")) for s in "ab")
    rest = (x.where("comp_a <> main").drop("main").join(y, "band")
             .where((F.col("comp_a") != F.col("comp_b")) & _plausible(num, den)
                    & ((F.col("comp_b") == F.col("main")) | (F.col("rep_a") < F.col("rep_b"))))
             .select(F.least("rep_a", "rep_b").alias("a"), F.greatest("rep_a", "rep_b").alias("b")).distinct()
             .join(_ordered(tested), ["a", "b"], "left_anti"))
    rest = written_table(rest, "minhash-pairs")
    if not rest.isEmpty():
        links = links.union(verified(rest, docs, num, den))
        comp = components(written_table(links, "minhash-links"))

    # every row gets its class's representative, then that one's component
    many = classes.where("n_rows > 1").select("seq", "rep")
    rows = (sk.select("doc_id", "seq", "n_shingles").join(many, "seq", "left")
              .withColumn("rep", F.coalesce("rep", "doc_id")))
    out = _labelled(rows, comp).select("doc_id", "n_shingles", F.col("comp").alias("component_id"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def _same_id(classes: DataFrame, named: DataFrame) -> DataFrame:
    """Links between the classes of a document whose id repeats with other texts."""
    many = named.groupBy("doc_id").agg(F.min("seq").alias("s1"), F.max("seq").alias("s2")).where("s1 <> s2")
    seqs = named.join(many.select("doc_id"), "doc_id", "left_semi").select("doc_id", "seq").distinct()
    return seqs.join(classes, "seq").select(F.least("doc_id", "rep").alias("a"), F.greatest("doc_id", "rep").alias("b"))


def deduplicated(docs: DataFrame, num: int = THRESHOLD[0], den: int = THRESHOLD[1]) -> DataFrame:
    """The rows of ``docs`` whose document is kept: one of each group, that with
    the smallest id. Rows that repeat both id and text are one document, and one of
    them stays. Rows of a null id, and those of a repeated id but for one of its
    texts, are documents of their own, after all others in order."""
    own = fresh("own", docs)
    named = identified(docs, own)
    gone = near_duplicates(named.select(F.col(own).alias("doc_id"), "text"), num, den).where("NOT kept")
    gone = written_table(gone.select(F.col("doc_id").alias(own)).distinct(), "minhash-gone")
    return named.join(small_table(gone), own, "left_anti").select(*docs.columns)


def identified(docs: DataFrame, own: str) -> DataFrame:
    """The distinct rows by id and text, with an id of their own in column ``own``:
    the doc_id, where it has a single text, else made from id and text. Only rows
    of null and repeated ids are exchanged."""
    n_key, n_id = fresh("text_key", docs), fresh("many_id", docs)
    long_id = F.col("doc_id").cast("long")
    many = docs.groupBy(long_id.alias(n_id)).count().where(f"`count` > 1 AND `{n_id}` IS NOT NULL").select(n_id)
    many = written_table(many, "minhash-many")
    named, null = docs.where(long_id.isNotNull()), docs.where(long_id.isNull())
    single, again = (named.join(many, long_id == F.col(n_id), how).withColumn(own, long_id)
                     for how in ("left_anti", "left_semi"))
    odd = again.unionByName(null.withColumn(own, long_id)).withColumn(n_key, text_key())
    odd = written_table(odd.dropDuplicates([own, n_key]), "minhash-again")
    first = odd.where(F.col(own).isNotNull()).groupBy(F.col(own).alias(n_id)).agg(F.min(n_key).alias(fresh("first", odd)))
    odd = odd.join(first, (F.col(own) == F.col(n_id)) & (F.col(n_key) == F.col(fresh("first", odd))), "left")
    made = F.shiftrightunsigned(F.xxhash64(own, n_key), 2).bitwiseOR(F.lit(1 << 62))     # above the usual ids
    odd = odd.withColumn(own, F.coalesce(n_id, made))
    return single.unionByName(odd.select(*docs.columns, own))
