"""Quality rules by distribution divergence (operator 2).

A document's histogram over character classes and its histogram over its
language's common words are compared with the language's reference
histograms by Jensen-Shannon distance. The references are means over all
documents of the language that pass the base rules. Common words are those
with a share of at least ``SHARE`` of the language's words, found exactly in
two passes: every block of text reports the words with half that share in
the block (a word with the full share overall has half the share in blocks
that hold half of it at least), the second pass counts the reported ones
everywhere.

Guards: documents under ``MIN_WORDS`` words fail the base rules, and the
allowed distances are wider for short texts, whose histograms are noisy:
``limit + slack / sqrt(n_words)``. A language has a reference if at least
``LANG_DOCS`` of its documents pass the base rules, whatever its share of the
corpus. Language marks can be missing or wrong, so a document is judged by the
reference that suits it best; one that is marked with a language that has no
reference is judged by the base rules alone, as all are without any reference.
Its distances are 0.

The driver holds at most 2 / SHARE words and their shares per language with
``LANG_DOCS`` documents; a document's counts hold only the words it has.

Defined cases: null and empty texts have no words and fail; rows that repeat
an id are judged one by one; null ids are kept; an empty table gives an empty
result. Extra columns are ignored.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsframe.llm.common import chunks, text_key, without
from newsframe.session import written_table

MIN_WORDS = 50
MAX_REPEAT = (50, 100)      # repeated words as a fraction of all words
SHARE = 0.005               # share of a language's words that makes a word common
LANG_DOCS = 30              # passing documents from which a language has a reference
CLASS_LIMIT = (0.20, 0.8)   # character classes: limit and slack
WORD_LIMIT = (0.20, 1.0)    # common words: limit and slack
BLOCK_WORDS = 2_000_000     # words per reported block

SYMBOLS = "#*$%&|<>"
#: Character classes: lower, upper, other letters, digits, spaces, line ends,
#: sentence marks, symbols, everything else.
N_CLASSES = 9
JUDGE_ROWS = 1_000      # rows whose shares are compared at once
_TABLE_SIZE = 0x250         # code points classified by table; others by str methods


def _class_of(ch: str) -> int:
    if ch.islower():
        return 0
    if ch.isupper():
        return 1
    if ch.isalpha():
        return 2
    if ch.isdigit():
        return 3
    if ch == "\n":
        return 5
    if ch.isspace():
        return 4
    if ch in ".,;:!?'\"()-":
        return 6
    return 7 if ch in SYMBOLS else 8


def _class_counts(text: str, table: np.ndarray) -> np.ndarray:
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = code < len(table)
    out = np.bincount(table[code[low]], minlength=N_CLASSES)
    if not low.all():
        for c, n in zip(*np.unique(code[~low], return_counts=True), strict=True):
            out[_class_of(chr(c))] += n
    return out


def _table() -> np.ndarray:
    return np.array([_class_of(chr(c)) for c in range(_TABLE_SIZE)])


def base_counts(text: str, words: list[bytes]) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    n = len(words)
    lines = [x for x in text.encode().split(b"\n") if x.strip(b" \t\r\x0b\x0c")]
    chars = len(text) - sum(map(text.count, " \t\n\x0b\x0c\r"))
    symbols = sum(map(text.count, SYMBOLS))
    repeat = 0
    if n >= 3:
        _, ids = np.unique(np.fromiter(map(hash, words), np.int64, n), return_inverse=True)
        m = int(ids.max()) + 1
        pairs = ids[:-1].astype(np.int64) * m + ids[1:]
        _, pair = np.unique(pairs, return_inverse=True)
        _, at, count = np.unique(pair[:-1].astype(np.int64) * m + ids[2:], return_inverse=True, return_counts=True)
        hit = np.zeros(n, bool)
        first = np.flatnonzero(count[at] > 1)
        for j in range(3):
            hit[first + j] = True
        repeat = int(hit.sum())
    return n, chars, symbols, len(lines) - len(set(lines)), repeat


def _rows(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"),
                       F.col("text").cast("string").alias("text"), text_key().alias("key"))


def common_words(docs: DataFrame, share: float = SHARE) -> dict[str | None, list[bytes]]:
    """Per language of LANG_DOCS documents, at most 2 / share words, among them
    every word with a share of ``share``."""
    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, total = defaultdict(Counter), Counter()

        def flush():
            out = []
            for lang, words in seen.items():
                out.append((lang, None, total[lang]))
                out += [(lang, w, n) for w, n in words.items() if n >= share / 2 * total[lang]]
            seen.clear(), total.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in out], pa.string()),
                                               pa.array([r[1] for r in out], pa.binary()),
                                               pa.array([r[2] for r in out], pa.int64())], names=["lang", "word", "n"])

        for part, texts in chunks(batches):
            for lang, text in zip(part.column("lang").to_pylist(), texts, strict=True):
                words = (text or "").encode().lower().split()
                seen[lang].update(words)
                total[lang] += len(words)
                if sum(total.values()) >= BLOCK_WORDS:
                    yield flush()
        yield flush()

    said = (_rows(docs).mapInArrow(report, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))
    said = written_table(said, "quality-words")
    total = said.where("word IS NULL").select(F.col("lang").alias("_lang"), F.col("n").alias("total"))
    kept = said.where("word IS NOT NULL").join(total, F.col("lang").eqNullSafe(F.col("_lang")))
    langs = _rows(docs).groupBy("lang").count()
    large = langs.where((F.col("count") >= LANG_DOCS) & F.col("lang").isNotNull()).select("lang")
    out = {r["lang"]: [] for r in large.collect()}
    for r in kept.where(F.col("n") >= share / 2 * F.col("total")).join(large, "lang", "left_semi").collect():
        out[r["lang"]].append(bytes(r["word"]))
    return {lang: sorted(out[lang]) for lang in sorted(out)}


def _places(common: dict[str, list[bytes]]) -> dict[bytes, int]:
    """The candidate words of all languages, numbered."""
    return {w: i for i, w in enumerate(sorted(set().union(*common.values())))}


def features(docs: DataFrame, common: dict[str, list[bytes]]) -> DataFrame:
    """Base counts, class histogram, and the candidate words of any language
    that the text has (``at``, as numbered by _places) with their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _table()
        wanted = _places(common)
        for part, texts in chunks(batches):
            out = []
            for doc, key, lang, text in zip(*(part.column(c).to_pylist() for c in ("doc_id", "key", "lang")), texts,
                                            strict=True):
                text = text or ""
                words = text.encode().split()
                base = base_counts(text, words)
                count = Counter(filter(wanted.__contains__, text.encode().lower().split()))
                out.append((doc, key, lang, *base, _class_counts(text, table),
                            [wanted[w] for w in count], list(count.values())))
            cols = list(zip(*out, strict=True))
            types = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 5, pa.list_(pa.int64()), pa.list_(pa.int32()),
                     pa.list_(pa.int64())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                             names=["doc_id", "key", "lang", "n_words", "word_chars", "n_symbols",
                                                    "n_dup_lines", "n_repeat_words", "classes", "at", "words"])

    return _rows(docs).mapInArrow(run, "doc_id long, key long, lang string, n_words long, word_chars long, n_symbols long, "
                                       "n_dup_lines long, n_repeat_words long, classes array<long>, "
                                       "at array<int>, words array<long>")


def _shares(counts: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Histogram with the rest as its last cell, as shares of the total."""
    rest = total[:, None] - counts.sum(1, keepdims=True)
    return np.hstack([counts, rest]) / np.maximum(total, 1)[:, None]


def js_distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance (base 2, 0 to 1) of each row of p to q."""
    m = (p + q) / 2

    def kl(a):
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(a > 0, a * np.log2(a / m), 0.0).sum(1)
    return np.sqrt(np.maximum((kl(p) + kl(q * np.ones_like(p))) / 2, 0))


def references(feats: DataFrame, common: dict[str, list[bytes]], share: float = SHARE) -> dict[str, dict]:
    """Per language with LANG_DOCS documents that pass the base rules: their
    mean class shares and mean word shares, and which candidate words are common."""
    ok = feats.where(~F.col("base_failed") & F.col("lang").isNotNull())
    size = {r["lang"]: r for r in ok.groupBy("lang").agg(F.count("*").alias("docs"), F.sum("n_words").alias("n")).where(
        F.col("docs") >= LANG_DOCS).collect()}
    if not size:
        return {}
    places = _places(common)
    own = F.broadcast(feats.sparkSession.createDataFrame(  # at most 2 / share words per language
        [(lang, places[w], i) for lang in size for i, w in enumerate(common[lang])], "lang string, place int, i int"))
    ok = ok.join(F.broadcast(own.select("lang").distinct()), "lang", "left_semi")
    n_chars = F.aggregate("classes", F.lit(0).cast("long"), lambda a, x: a + x)
    cls = (ok.select("lang", F.posexplode("classes").alias("i", "n"), n_chars.alias("of"))
             .groupBy("lang", "i").agg(F.avg(F.col("n") / F.greatest("of", F.lit(1))).alias("mean")))
    word = (ok.select("lang", "n_words", F.explode(F.arrays_zip("at", "words")).alias("x"))
              .select("lang", "n_words", F.col("x.at").alias("place"), F.col("x.words").alias("n"))
              .join(own, ["lang", "place"])
              .groupBy("lang", "i").agg(F.sum(F.col("n") / F.col("n_words")).alias("part"), F.sum("n").alias("n")))
    out = {lang: {"classes": np.zeros(N_CLASSES), "words": np.zeros(len(common[lang])),
                  "common": np.zeros(len(common[lang]), bool)} for lang in sorted(size)}
    for r in cls.collect():     # one row per language and class
        out[r["lang"]]["classes"][r["i"]] = r["mean"]
    for r in word.collect():    # one row per language and candidate word
        ref, of = out[r["lang"]], size[r["lang"]]
        ref["common"][r["i"]] = r["n"] / of["n"] >= share
        ref["words"][r["i"]] = r["part"] / of["docs"]
    for lang, ref in out.items():
        words = ref["words"][ref["common"]]
        ref["at"] = np.array([places[w] for w in common[lang]], np.int64)[ref.pop("common")]
        ref["words"] = np.append(words, max(0.0, 1 - words.sum()))
    return out


def quality(docs: DataFrame, class_limit: tuple = CLASS_LIMIT, word_limit: tuple = WORD_LIMIT) -> DataFrame:
    """(doc_id, base counts, base_failed, class_distance, word_distance, kept,
    key) per row of ``docs``; key is the text's hash."""
    if "lang" not in docs.columns:
        docs = docs.withColumn("lang", F.lit(None).cast("string"))
    common = common_words(docs)
    num, den = MAX_REPEAT
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * den > F.col("n_words") * num)
    feats = written_table(features(docs, common).withColumn("base_failed", failed), "quality-features")
    refs = references(feats, common)
    n_places = len(_places(common))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (x.slice(i, JUDGE_ROWS) for x in batches for i in range(0, x.num_rows, JUDGE_ROWS)):
            n = b.num_rows
            n_words = b.column("n_words").to_numpy()
            short = 1 / np.sqrt(np.maximum(n_words, 1))
            most = np.array([class_limit[0] + class_limit[1] * short, word_limit[0] + word_limit[1] * short])
            classes = np.array(b.column("classes").to_pylist(), float).reshape(n, N_CLASSES)
            classes /= np.maximum(classes.sum(1, keepdims=True), 1)
            at, count = b.column("at").flatten().to_numpy(), b.column("words").flatten().to_numpy()
            row = np.repeat(np.arange(n), pc.list_value_length(b.column("at")).to_numpy())
            best = np.full((2, n), np.inf)
            for ref in refs.values():
                col = np.full(n_places, -1)
                col[ref["at"]] = np.arange(len(ref["at"]))
                col = col[at]
                own = np.zeros((n, len(ref["at"])))
                own[row[col >= 0], col[col >= 0]] = count[col >= 0]
                d = np.array([js_distance(classes, ref["classes"]), js_distance(_shares(own, n_words), ref["words"])])
                best = np.where((d / most).max(0) < (best / most).max(0), d, best)
            alone = np.array([x is not None and x not in refs for x in b.column("lang").to_pylist()], bool)
            best[:, alone | ~np.isfinite(best[0])] = 0.0  # no reference
            bad = np.array(b.column("base_failed").to_pylist(), bool)
            kept = ~bad & (best <= most).all(0)
            names = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
            yield pa.RecordBatch.from_arrays([*(b.column(x) for x in names), *map(pa.array, (*best, kept)), b.column("key")],
                                             names=[*names, "class_distance", "word_distance", "kept", "key"])

    return feats.mapInArrow(judge, "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, "
                                   "n_repeat_words long, base_failed boolean, class_distance double, "
                                   "word_distance double, kept boolean, key long")


def accepted(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that the rules keep, null and repeated ids included:
    a row's verdict goes by its id and text (of rows that repeat both, in
    several languages, all go if one is rejected)."""
    return without(docs, quality(docs).where("NOT kept"), "quality-bad")
