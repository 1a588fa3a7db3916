"""Near duplicates against what earlier polls have seen.

``DuplicateHistory`` keeps an index of all entries under a folder, one partition
per poll (``batch_id``):

* ``copies``: hash of each text and its first entry;
* ``vectors``: the TF-IDF terms of each distinct text;
* ``postings``: its prefix terms, sorted by term (see ``operators.dedup``).

A poll is probed by joins: texts by hash, then prefix terms with the postings,
candidates by the exact bound, and the full dot product. Vectors of different polls must
be comparable, so document frequencies are a snapshot (``terms``), taken from the
first poll or a given background, and fixed from then on; terms that it lacks count
as held by no document, which makes them the rarest.

The rule is U3's over all polls together: an entry goes if any earlier entry, kept
or not, has the same or a similar text. So the index holds every entry seen.

A poll reads only partitions of smaller ``batch_id`` and overwrites only its own,
so replaying a poll after a failure reads the same history and stores nothing twice.
Probing shuffles the poll and the postings of its terms: the poll's terms are
broadcast as a filter of the postings scan while they are few (checked).
``horizon`` limits the probe to the last so many polls.

Defined cases: null and empty texts are copies of each other; a text without a
token is similar to none; an empty poll leaves the history as it is."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from newsframe import lexicons as L
from newsframe.operators import dedup as D
from newsframe.session import small_table, written_table

_TABLES = {"copies": "_k string, id string", "vectors": "d string, term string, wt double",
           "postings": "d string, term string, wt double, ex double, n double"}
_TERMS = "term string, df long, batch_id long"


class DuplicateHistory:
    """An index of entries under ``path``, see the module. Ids are compared as
    strings and must be unique over all polls."""

    def __init__(self, spark: SparkSession, path: str, threshold: float = L.DUPLICATE_THRESHOLD,
                 text_col: str = "summary", id_col: str = "entry_id", horizon: int | None = None,
                 background: DataFrame | None = None):
        self.spark, self.path, self.threshold = spark, path.rstrip("/"), threshold
        self.text_col, self.id_col, self.horizon, self.background = text_col, id_col, horizon, background

    # -------------------------------------------------------- stored tables

    def _read(self, name: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def _earlier(self, name: str, batch_id: int) -> DataFrame:
        stored = self._read(name, _TABLES[name] + ", batch_id long").filter(F.col("batch_id") < batch_id)
        if self.horizon is not None:
            stored = stored.filter(F.col("batch_id") >= batch_id - self.horizon)
        return stored.drop("batch_id")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(f"{self.path}/{name}"))

    def _terms(self, tf: DataFrame, batch_id: int) -> DataFrame:
        """The snapshot (term, df); a row without a term holds the number of
        documents. The poll that wrote it may write it again (same rows)."""
        stored = self._read("terms", _TERMS)
        owner = stored.filter("term IS NULL").first()
        if owner is None or owner["batch_id"] == batch_id:
            if self.background is not None:
                ids = self.background.withColumn("_id", F.monotonically_increasing_id().cast("string"))
                tf = D.tf_vectors(ids, self.text_col, "_id").withColumnRenamed("_id", "id")
            total = tf.agg(F.lit(None).cast("string").alias("term"), F.count_distinct("id").alias("df"))
            rows = D.term_frequencies(tf).union(total).withColumn("batch_id", F.lit(batch_id).cast("long"))
            rows.write.mode("overwrite").parquet(f"{self.path}/terms")
            stored = self._read("terms", _TERMS)
        return stored.drop("batch_id")

    # -------------------------------------------------------- a poll

    def index(self, batch: DataFrame, batch_id: int) -> None:
        """Store the poll's distinct texts. Done before ``repeats`` reads them."""
        rows = batch.select(F.col(self.id_col).cast("string").alias("id"), F.col(self.text_col).alias("text"))
        keyed = rows.groupBy(D.text_key("text").alias("_k")).agg(F.min("id").alias("id"))
        self._write(keyed.select("_k", "id"), "copies", batch_id)
        reps = written_table(rows.join(keyed.select("id"), "id", "left_semi").dropDuplicates(["id"]), "history-reps")
        tf = written_table(D.tf_vectors(reps, "text", "id"), "history-tf")
        terms = self._terms(tf, batch_id)
        n_docs = F.lit(terms.filter("term IS NULL").first()["df"])
        base = written_table(D.weighted_terms(tf, terms.filter("term IS NOT NULL"), n_docs, "id", "left"), "history-terms")
        self._write(base.select("d", "term", "wt"), "vectors", batch_id)
        self._write(D.prefix_terms(base, self.threshold).sortWithinPartitions("term"), "postings", batch_id)

    def _own(self, name: str, batch_id: int) -> DataFrame:
        return self._read(name, _TABLES[name] + ", batch_id long").filter(F.col("batch_id") == batch_id).drop("batch_id")

    def repeats(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """(id, partner): entries of the (indexed) poll whose text an earlier poll
        has, or one with cosine >= the threshold, and one such earlier entry."""
        own = self._own("copies", batch_id)
        copies = own.join(self._earlier("copies", batch_id).groupBy("_k").agg(F.min("id").alias("partner")), "_k")
        copies = written_table(copies.select(F.col("id").alias("d"), "partner"), "history-copies")
        later = self._own("postings", batch_id).join(copies, "d", "left_anti")
        asked = small_table(later.select("term").distinct())
        lists = self._earlier("postings", batch_id).join(asked, "term", "left_semi")
        near = D.partners(later.withColumn("lim", F.lit(None).cast("string")), self._own("vectors", batch_id),
                          lists, self._earlier("vectors", batch_id), self.threshold, earliest=False)
        found = copies.union(near).withColumnsRenamed({"d": "rep"})
        rows = batch.select(F.col(self.id_col).cast("string").alias("id"), D.text_key(self.text_col).alias("_k"))
        return (rows.join(own.withColumnRenamed("id", "rep"), "_k").join(found, "rep").select("id", "partner"))

    def fresh(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """Index the poll, and give its rows but for those with an earlier partner."""
        self.index(batch, batch_id)
        gone = written_table(self.repeats(batch, batch_id).select(F.col("id").alias("_gone")), "history-gone")
        return batch.join(gone, F.col(self.id_col).cast("string") == F.col("_gone"), "left_anti")
