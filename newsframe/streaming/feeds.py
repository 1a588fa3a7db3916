"""Feed ingest as Structured Streaming (T1, T2) and scores on a stream.

One micro-batch stands for one poll. Inside ``foreachBatch`` the batch is
de-duplicated (U3) and appended; the batch id is written with the rows and
a replayed batch overwrites only its own partition, so a restart after a
lost executor or driver does not store a poll twice. Checkpoints live under
the cluster's shared ``spark.checkpoint.dir``."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from newsframe import lexicons as L
from newsframe.functions import scores as S
from newsframe.functions import summary as M
from newsframe.functions import text as T
from newsframe.operators.credibility import credibility_heuristic
from newsframe.operators.dedup import drop_near_duplicates
from newsframe.operators.history import DuplicateHistory
from newsframe.operators.keywords import keywords_embedding, keywords_freq, keywords_rake
from newsframe.operators.polarity import analyze_bias, analyze_sentiment, polarity
from newsframe.session import checkpoint_path
from newsframe.sources.feeds import feed_entries, with_entry_id


def dedup_batch(batch: DataFrame, threshold: float = L.DUPLICATE_THRESHOLD) -> DataFrame:
    """U3 on one poll: entries ordered by (feed, position)."""
    return drop_near_duplicates(with_entry_id(batch), threshold, text_col="summary", id_col="entry_id")


def _store(df: DataFrame, path: str, batch_id: int) -> None:
    """Write a poll's rows as the partition of its ``batch_id``, replacing what an
    earlier run of the same poll wrote."""
    (df.withColumn("batch_id", F.lit(batch_id).cast("long")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("batch_id").parquet(path))


def _writer(out_path: str, threshold: float, history: DuplicateHistory | None):
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()  # U3 reads the poll several times; parse it once
        try:
            kept = dedup_batch(batch, threshold)
            if history is not None:
                history.index(with_entry_id(batch), batch_id)
                gone = history.repeats(with_entry_id(batch), batch_id).select(F.col("id").alias("_gone"))
                kept = with_entry_id(kept).join(gone, F.col("entry_id") == F.col("_gone"), "left_anti")
            _store(kept, out_path, batch_id)
        finally:
            batch.unpersist()
    return write


def _started(df: DataFrame, write, name: str, trigger: str | None) -> StreamingQuery:
    w = df.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint_path(df.sparkSession, name))
    w = w.trigger(availableNow=True) if trigger is None else w.trigger(processingTime=trigger)
    return w.start()


def feed_stream(spark: SparkSession, feed_dir: str | Sequence[str], out_path: str, name: str = "feed_stream",
                trigger: str | None = None, dedup_links: bool = False, watermark: str = "7 days",
                threshold: float = L.DUPLICATE_THRESHOLD, fmt: str = "any", history: str | None = None,
                horizon: int | None = None) -> StreamingQuery:
    """T1 (``dedup_links=False``): every poll is de-duplicated within itself
    and stored; a link repeated in a later poll is stored again.
    T2 (``dedup_links=True``): entries already seen within the watermark are
    dropped across polls (``dropDuplicatesWithinWatermark``). The watermark
    runs on the time of ingest, so no publication date can close it early; the
    key is the link, and for entries without one a hash of source, title and
    summary. With ``history`` (a folder) entries whose summary repeats that of
    an entry of an earlier poll, or nearly so, go too (``DuplicateHistory``;
    ``horizon``: of the last so many polls).
    ``feed_dir``: one folder or several; all of them are one poll. ``fmt``: 'rss',
    'atom' or 'any'. ``trigger``: None = process what is there and stop
    (availableNow), or an interval such as '30 minutes'."""
    entries = feed_entries(spark, feed_dir, fmt, stream=True)
    if dedup_links:
        key = F.when(F.col("link") != "", F.col("link")).otherwise(
            F.sha2(F.to_json(F.struct("source", "title", "summary")), 256))
        entries = (entries.withColumns({"_wm": F.current_timestamp(), "_key": key})
                   .withWatermark("_wm", watermark).dropDuplicatesWithinWatermark(["_key"]).drop("_wm", "_key"))
    seen = DuplicateHistory(spark, history, threshold, horizon=horizon) if history else None
    return _started(entries, _writer(out_path, threshold, seen), name, trigger)


def stream_scores(stream: DataFrame, text_col: str = "text") -> DataFrame:
    """Row-wise operators that need no per-document aggregation, as
    plain projections usable on a stream."""
    t = F.col(text_col)
    low = S.lowered_stripped(t)
    return stream.select(
        "*",
        T.clean_html(t).alias("clean_html"),
        T.normalize_text(t).alias("normalized"),
        T.clean_article_text(t).alias("clean_article"),
        T.clean_for_bias(t).alias("clean_bias"),
        T.clean_for_keywords(t).alias("clean_keywords"),
        T.truncate_words(t, L.TRUNCATE_REMOTE_WORDS).alias("truncated"),
        M.summary_lead(t).alias("summary"),
        S.credibility_penalty(t).alias("credibility_penalty"),
        S.clickbait_hits(low).alias("clickbait"),
        S.exclamation_count(low).alias("exclamations"),
        S.punct_runs(low).alias("punct_runs"),
        S.has_source(low).alias("has_source"),
        S.length_score(F.size(T.tokens(low))).alias("length_score"),
        S.bias_cue_count(T.clean_for_bias(t)).alias("bias_cues"),
        T.too_short(t, L.GUARD_BIAS_MIN).alias("bias_guard"),
        T.too_short(t, L.GUARD_SENTIMENT_MIN).alias("sentiment_guard"))


#: A scorer gives one row per document, keyed by the id column.
Scorer = Callable[[DataFrame], DataFrame]


def document_scorers(lexicon: DataFrame, modifiers: DataFrame | None = None, vectors: DataFrame | None = None,
                     stop_words: Sequence[str] = (), key=None, text_col: str = "text",
                     id_col: str = "doc_id") -> dict[str, Scorer]:
    """The operators that count or rank words within a document: D1 (with D1d),
    D4, D7 (with D3, D5, D6), D8, K1, K2, and with a vector table K3."""
    args = {"text_col": text_col, "id_col": id_col}
    out: dict[str, Scorer] = {
        "credibility": lambda df: credibility_heuristic(df, with_parts=True, **args),
        "polarity": lambda df: polarity(df, lexicon, modifiers, **args),
        "bias": lambda df: analyze_bias(df, lexicon, modifiers, with_parts=True, **args),
        "sentiment": lambda df: analyze_sentiment(df, lexicon, modifiers, **args),
        "keywords_freq": lambda df: keywords_freq(df, **args),
        "keywords_rake": lambda df: keywords_rake(df, stop_words, **args)}
    if vectors is not None:
        out["keywords_embedding"] = lambda df: keywords_embedding(df, vectors, stop_words, key=key, **args)
    return out


def score_stream(stream: DataFrame, scorers: dict[str, Scorer], out_path: str, name: str = "score_stream",
                 trigger: str | None = None) -> StreamingQuery:
    """T3 for operators that aggregate within a document: each micro-batch is
    scored as a batch job, one table per scorer under ``out_path``. A table's rows
    carry the ``batch_id``; a batch replayed after a failure replaces its own rows in
    every table, so each document is stored once whichever scorer had been reached."""
    def write(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            for key, scorer in scorers.items():
                _store(scorer(batch), f"{out_path}/{key}", batch_id)
        finally:
            batch.unpersist()

    return _started(stream, write, name, trigger)
