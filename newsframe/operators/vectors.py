"""Dense text vectors from a word-vector table (U1, K3) or a model.

The table (key, vec) is joined to the words of the documents: by broadcast while it
is small (checked), else by shuffle on the key. A document's vector is the sum of its
words' vectors, an aggregate on the document's own partitioning; nothing is
collected and no Python runs. A model instead of a table is called over Arrow
batches in the tasks (``embed_with_model``)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from newsframe.functions import text as T
from newsframe.operators.tokens import by_document
from newsframe.session import small_table, written_table

#: A vector table of up to so many values (rows x dimensions) is broadcast.
VECTOR_BROADCAST_MAX_VALUES = 10_000_000
SUMMED_COLUMNS = 256


def dot(a: Column, b: Column) -> Column:
    """Inner product of two arrays of doubles."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x * x))


class VectorTable:
    """A word-vector table (key, vec), ready to be joined to words. ``key`` maps a word
    column to the table's key (default: the word itself)."""

    def __init__(self, vectors: DataFrame, key: Callable[[Column], Column] | None = None,
                 broadcast_values: int = VECTOR_BROADCAST_MAX_VALUES):
        first = vectors.select(F.size("vec").alias("dim")).first()      # one row
        self.dim = max(int(first["dim"]), 1) if first is not None and first["dim"] is not None else 1
        self.key = key
        table = vectors.select(F.col("key").alias("_key"), F.col("vec").cast("array<double>").alias("vec"))
        rows = broadcast_values // self.dim
        n = table.limit(rows + 1).count()
        self.fits = n <= rows
        self.table = small_table(table, rows, n)
        self.table_with_norm = small_table(table.withColumn("vnorm", norm(F.col("vec"))), rows, n)

    def _keyed(self, words: DataFrame, word_col: str) -> DataFrame:
        return words.withColumn("_key", self.key(F.col(word_col)) if self.key is not None else F.col(word_col))

    def to_words(self, words: DataFrame, word_col: str = "w") -> DataFrame:
        """Add ``vec`` and its length ``vnorm`` (null for words without a vector)."""
        return self._keyed(words, word_col).join(self.table_with_norm, "_key", "left").drop("_key")

    def summed(self, counts: DataFrame, id_col: str, word_col: str = "w", weight: str = "n") -> DataFrame:
        """(id, dvec, dnorm): per document the direction of the weighted sum of its
        words' vectors, and its length; no row for documents without a vector.
        Tables of up to SUMMED_COLUMNS dimensions are summed as that many columns of
        a generated hash aggregate, wider ones by the vector summarizer."""
        rows = self._keyed(counts, word_col).join(self.table, "_key").filter(F.col("vec").isNotNull())
        if self.dim <= SUMMED_COLUMNS:
            sums = rows.groupBy(id_col).agg(*[F.sum(F.col("vec")[k] * F.col(weight)).alias(f"_s{k}")
                                              for k in range(self.dim)])
            out = sums.select(id_col, F.array(*[F.col(f"_s{k}") for k in range(self.dim)]).alias("dvec"))
        else:
            mean = Summarizer.metrics("mean").summary(array_to_vector(F.col("vec")), F.col(weight).cast("double"))
            out = rows.groupBy(id_col).agg(mean.alias("_m")).select(id_col, vector_to_array("_m.mean").alias("dvec"))
        return out.withColumn("dnorm", norm(F.col("dvec")))


def embed_texts_dense(df: DataFrame, vectors: DataFrame, text_col: str = "text", id_col: str = "doc_id",
                      key: Callable[[Column], Column] | None = None, out: str = "embedding") -> DataFrame:
    """U1 (dense form): (id, unit vector) for each row's text, the direction of the
    sum of its tokens' word vectors. A text without a token that has a vector, and
    one whose vectors sum to zero, has no direction: its embedding is null. Rows that
    repeat an id count as one text. Ids may have any type."""
    dd = by_document(df.select(id_col, F.col(text_col).alias("_t")), id_col)
    counts = dd.select(id_col, F.explode(T.tokens("_t")).alias("w")).groupBy(id_col, "w").agg(
        F.count(F.lit(1)).alias("n"))
    ids = dd.select(id_col).groupBy(id_col).agg(F.count(F.lit(1)).alias("_n")).select(id_col)
    sums = ids.join(VectorTable(vectors, key).summed(counts, id_col), id_col, "left")
    return sums.select(id_col, F.when(F.col("dnorm") > 0, F.transform("dvec", lambda x: x / F.col("dnorm"))).alias(out))


#: Makes a model's encoder: texts to a matrix with one row each. Called once per task.
EncoderFactory = Callable[[], Callable[[list[str]], np.ndarray]]


def embed_with_model(df: DataFrame, factory: EncoderFactory, text_col: str = "text", id_col: str = "doc_id",
                     out: str = "embedding") -> DataFrame:
    """U1 with a model: (id, unit vector). ``factory`` runs once in each task (it loads
    the model there), its encoder once per Arrow batch. Null texts count as empty;
    a zero vector gives null."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = None
        for pdf in batches:
            encode = encode or factory()
            mat = np.asarray(encode(pdf[text_col].fillna("").tolist()), np.float64).reshape(len(pdf), -1)
            length = np.sqrt((mat * mat).sum(axis=1))
            yield pd.DataFrame({id_col: pdf[id_col],
                                out: [row / n if n > 0 else None for row, n in zip(mat, length, strict=True)]})

    id_type = df.schema[id_col].dataType.simpleString()
    return df.select(id_col, text_col).mapInPandas(run, f"`{id_col}` {id_type}, `{out}` array<double>")


# ------------------------------------------------------------ word scores by blocks

#: Values (rows x dimensions) of one block of a vector table.
BLOCK_VALUES = 4_000_000


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(blob: bytes) -> pa.Table:
    return pa.ipc.open_stream(blob).read_all()


def _cells(name: str, blobs: Iterator[bytes]) -> Iterator[pa.RecordBatch]:
    for blob in blobs:
        yield pa.RecordBatch.from_arrays([pa.array([blob], pa.binary())], names=[name])


class _Block:
    """Vectors of some keys, the rows of a repeated key next to each other."""

    def __init__(self, blob: bytes):
        t = _unpacked(blob).combine_chunks()
        codes = t.column("key").combine_chunks().dictionary_encode()
        codes = codes.combine_chunks() if isinstance(codes, pa.ChunkedArray) else codes
        self.keys = codes.dictionary
        code = codes.indices.to_numpy(zero_copy_only=False)
        order = np.argsort(code, kind="stable")
        self.count = np.bincount(code, minlength=len(self.keys))
        self.start = np.cumsum(self.count) - self.count
        self.vec = _matrix(t.column("vec"))[order]

    def rows(self, keys: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Places of ``keys`` that are met here, and the row of each one's vectors."""
        at = pc.index_in(keys, value_set=self.keys)
        met = np.flatnonzero(at.is_valid().to_numpy(zero_copy_only=False))
        code = at.drop_null().to_numpy(zero_copy_only=False)
        n = self.count[code]
        rep = np.repeat(np.arange(len(code)), n)
        return met[rep], np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + self.start[code][rep]


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    arr = column.combine_chunks()
    arr = pa.concat_arrays(arr.chunks) if isinstance(arr, pa.ChunkedArray) else arr
    return arr.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(arr), -1)


def _steps(n: int, width: int) -> Iterator[slice]:
    """A bounded number of values at a time."""
    wide = max(1, BLOCK_VALUES // max(width, 1))
    return (slice(k, k + wide) for k in range(0, n, wide))


def pyround(x: np.ndarray, digits: int) -> np.ndarray:
    """``text.pyround`` of an array."""
    k = float(10 ** digits)
    scaled, big = x * k, x * float(2 ** 27 + 1)
    high = big - (big - x)
    error = (high * k - scaled) + (x - high) * k
    down = np.floor(scaled)
    tie = scaled - down == 0.5
    return np.where(tie & (error < 0), down, np.where(tie & (error > 0), down + 1.0, np.rint(scaled))) / k


def best_words(words: DataFrame, vectors: DataFrame, id_col: str, top_n: int, out: str) -> DataFrame:
    """(id, out): per document its ``top_n`` candidates by the cosine of a word's vector and
    the document's, rounded to 6 places, ties by word; words without an angle last.
    ``words`` (id, w, n, key, cand) holds whole documents in each of its partitions, one row
    per document and word at least; ``vectors`` is (key, vec).

    A partition's words are one packed row, the vector table packed blocks. Every
    partition meets the blocks one after the other, first for the documents' vectors,
    then for the cosines: a task holds its documents and one block, however large the
    table is, and no row with a vector is shuffled."""
    spark = words.sparkSession
    table = vectors.select("key", "vec").filter(F.col("key").isNotNull() & F.col("vec").isNotNull())

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut():
            part, size = [], 0
            for b in batches:
                values = max(1, pc.list_value_length(b.column("vec"))[0].as_py() if b.num_rows else 1)
                wide = max(1, BLOCK_VALUES // values)
                for k in range(0, b.num_rows, wide):
                    part.append(b.slice(k, wide))
                    size += part[-1].num_rows * values
                    if size >= BLOCK_VALUES:
                        yield _packed(pa.Table.from_batches(part))
                        part, size = [], 0
            if part:
                yield _packed(pa.Table.from_batches(part))
        yield from _cells("block", cut())

    def documents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = [b for b in batches if b.num_rows]
        if part:
            yield from _cells("docs", [_packed(pa.Table.from_batches(part))])

    def meet(docs: DataFrame) -> DataFrame:
        return parts.coalesce(1).crossJoin(docs.hint("shuffle_replicate_nl"))

    def codes(t: pa.Table) -> tuple[np.ndarray, pa.Array]:
        ids = t.column(id_col).combine_chunks().dictionary_encode(null_encoding="encode")
        ids = ids.combine_chunks() if isinstance(ids, pa.ChunkedArray) else ids
        return ids.indices.to_numpy(zero_copy_only=False), ids.dictionary

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[bytes, np.ndarray] = {}
        for b in batches:
            for blob, packed in zip(b.column("block").to_pylist(), b.column("docs").to_pylist(), strict=True):
                block, t = _Block(blob), _unpacked(packed)
                own, ids = codes(t)
                n = t.column("n").to_numpy().astype(np.float64)
                total = sums.setdefault(packed, np.zeros((len(ids), block.vec.shape[1])))
                at, row = block.rows(t.column("key").combine_chunks())
                order = np.argsort(own[at], kind="stable")
                at, row = at[order], row[order]
                for s in _steps(len(at), block.vec.shape[1]):
                    doc = own[at[s]]
                    first = np.flatnonzero(np.diff(doc, prepend=-1))
                    total[doc[first]] += np.add.reduceat(block.vec[row[s]] * n[at[s], None], first, axis=0)
        for packed, total in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([packed], pa.binary()), pa.array([total.tobytes()], pa.binary())],
                                             names=["docs", "sums"])

    schema = words.select(id_col, F.array("w").alias(out)).schema

    def ranked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[bytes, list] = {}
        sums: dict[bytes, bytes] = {}
        for b in batches:
            for blob, packed, total in zip(*(b.column(c).to_pylist() for c in ("block", "docs", "sums")), strict=True):
                block, t = _Block(blob), _unpacked(packed)
                sums[packed] = total
                own, ids = codes(t)
                d = np.frombuffer(total).reshape(len(ids), -1)
                length = np.sqrt((d * d).sum(axis=1))
                length[~ids.is_valid().to_numpy(zero_copy_only=False)] = 0     # a null id has no vector
                cand = np.flatnonzero(t.column("cand").to_numpy())
                at, row = block.rows(t.column("key").combine_chunks().take(pa.array(cand)))
                at = cand[at]
                own_norm = np.sqrt((block.vec * block.vec).sum(axis=1))
                score = np.zeros(len(at))
                for s in _steps(len(at), block.vec.shape[1]):
                    doc = own[at[s]]
                    norm = own_norm[row[s]] * length[doc]
                    dots = np.einsum("ij,ij->i", block.vec[row[s]], d[doc])
                    score[s] = np.where(norm == 0, -np.inf, pyround(dots / np.where(norm == 0, 1, norm), 6))
                score[np.isnan(score)] = np.inf                                # as Spark orders them
                word = t.column("w").take(pa.array(at))
                held = found.setdefault(packed, [])
                held.append(best(pa.table({"own": own[at], "score": score, "w": word})))
                if len(held) > 1:
                    found[packed] = [best(pa.concat_tables(held))]
        for packed, held in found.items():
            _, ids = codes(_unpacked(packed))
            own, word = held[0].column("own").to_numpy(), held[0].column("w").combine_chunks()
            offsets = np.searchsorted(own, np.arange(len(ids) + 1))
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), word if isinstance(word, pa.Array) else pa.concat_arrays(word.chunks))
            yield pa.RecordBatch.from_arrays([ids, lists], names=[id_col, out])

    def best(t: pa.Table) -> pa.Table:
        t = t.take(pc.sort_indices(t, sort_keys=[("own", "ascending"), ("score", "descending"), ("w", "ascending")]))
        own = t.column("own").to_numpy()
        place = np.arange(len(own)) - np.searchsorted(own, own)
        return t.filter(pa.array(place < top_n))

    parts = written_table(table.mapInArrow(blocks, "block binary"), "word-blocks")
    docs = words.select(id_col, "w", "n", "key", "cand").mapInArrow(documents, "docs binary")
    if parts.isEmpty():
        return words.select(id_col).distinct().select(id_col, F.array().cast("array<string>").alias(out))
    held = written_table(meet(docs).mapInArrow(summed, "docs binary, sums binary"), "word-sums")
    return meet(held).mapInArrow(ranked, schema)
