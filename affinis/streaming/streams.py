"""Structured Streaming versions of the ingest operators (ST1-ST6).

Sources are file streams with a fixed schema; sinks are Parquet tables in
the shared folder, written exactly once per micro-batch:
  * stateless / append streams use the file sink with a checkpoint;
  * stateful aggregates run in ``update`` mode through ``foreachBatch``:
    each batch overwrites its own ``_batch=<id>`` partition (a re-run of a
    batch id replaces, never duplicates), and the current table is the
    latest row per key (``max_by`` over ``_batch``).
State is bounded by watermarks; a finished stream equals the batch
operator over the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import implicit_rating
from ..operators import prep, quality
from ..session import materialize
from ..sources.ratings_log import RatingsLog

EVENTS_SCHEMA = "event_id BIGINT, ts TIMESTAMP_NTZ, user_id BIGINT, event_type STRING, value DOUBLE, props STRING"


def event_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Stream of the feedback events of a table: one Parquet file or a folder
    of part files (fixed schema, no inference).

    The path is given as a pattern that only it matches: for a plain path
    the file source insists on a folder.
    """
    path = path.rstrip("/")
    r = spark.readStream.format("parquet").schema(EVENTS_SCHEMA)
    if max_files:
        r = r.option("maxFilesPerTrigger", max_files)
    ev = r.load(f"{path[:-1]}[{path[-1]}]")
    return ev.select("event_id", "user_id",
                     F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                     F.col("event_type").alias("interaction_type"),
                     F.col("ts").cast("timestamp").alias("ts"))


def implicit_ratings(events: DataFrame) -> DataFrame:
    """ST2: stateless mapping of feedback events to implicit ratings."""
    return events.select("event_id", "user_id", "item_id",
                         implicit_rating("interaction_type").alias("rating"), "ts",
                         F.lit("implicit").alias("source")).where(F.col("rating").isNotNull())


def ab_counters(exposures: DataFrame, window: str = "1 day", delay: str = "1 day") -> DataFrame:
    """ST4: running impressions / conversions per (test, group, window)."""
    return (exposures.withWatermark("ts", delay)
            .groupBy("test_id", "group", F.window("ts", window).alias("w"))
            .agg(F.count_if("impression").alias("impressions"),
                 F.count_if("conversion").alias("conversions")))


def sliding_item_counts(ratings: DataFrame, length: str = "7 days", slide: str = "1 day",
                        delay: str = "1 day") -> DataFrame:
    """ST5: interactions per item in sliding windows (trending input)."""
    return (ratings.withWatermark("ts", delay)
            .groupBy(F.window("ts", length, slide).alias("w"), "item_id")
            .agg(F.count(F.lit(1)).alias("n_interactions")))


def user_sessions(events: DataFrame, gap: str = "1 hour", delay: str = "1 day") -> DataFrame:
    """ST6: sessions per user (events closer than ``gap`` merge)."""
    return (events.withWatermark("ts", delay)
            .groupBy("user_id", F.session_window("ts", gap).alias("s"))
            .agg(F.count(F.lit(1)).alias("n_events")))


# --------------------------------------------------------------------------
# sinks
# --------------------------------------------------------------------------
def run_append(stream: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Run an append stream to completion (availableNow) into Parquet."""
    q = (stream.writeStream.format("parquet").option("path", path)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return stream.sparkSession.read.parquet(path)


def run_update(stream: DataFrame, path: str, checkpoint: str, keys: list[str]) -> DataFrame:
    """Run an aggregating stream (update mode) to completion; returns the
    current table = newest row per key."""
    def write(batch: DataFrame, batch_id: int) -> None:
        (batch.withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path))

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .outputMode("update").trigger(availableNow=True).start())
    q.awaitTermination()
    t = stream.sparkSession.read.parquet(path)
    vals = [c for c in t.columns if c not in keys and c != "_batch"]
    latest = t.groupBy(*keys).agg(F.max_by(F.struct(*vals), "_batch").alias("_v"))
    return latest.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in vals])


def run_latest(stream: DataFrame, path: str, checkpoint: str, keys: list[str], order: list[str]) -> DataFrame:
    """ST3: duplicate rows of ``keys`` dropped, the last by ``order`` kept.

    Each micro-batch writes its own last rows to its ``_batch`` partition (a
    replayed batch replaces them); the current table is the last row per
    key over all batches, so late and out-of-order rows need no watermark
    and no state.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        (prep.dedup_keep_last(batch, keys, order).withColumn("_batch", F.lit(batch_id)).write.mode("overwrite")
         .option("partitionOverwriteMode", "dynamic").partitionBy("_batch").parquet(path))

    q = (stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return prep.dedup_keep_last(stream.sparkSession.read.parquet(path).drop("_batch"), keys, order)


def complete_sessions(closed: DataFrame, events: DataFrame, gap: str = "1 hour") -> DataFrame:
    """ST6, finished: the sessions a stream has closed, and the open ones.

    The next event of a user after a closed session starts a new one, so
    the events at or after a user's last closed end, put through the batch
    operator, are exactly the open sessions.  That holds unless the stream
    dropped an event behind its watermark or closed a session before an
    event of it came: where a user's events are not as many as the closed
    sessions and the open events hold, or closed sessions overlap, the batch
    operator makes all sessions of the user anew.
    """
    by_start = Window.partitionBy("user_id").orderBy("s.start", "s.end")
    over = F.coalesce(F.col("s.start") < F.lag("s.end").over(by_start), F.lit(False))
    ends = closed.select("user_id", "s", "n_events", over.alias("_over")).groupBy(F.col("user_id").alias("_u")) \
        .agg(F.max("s.end").alias("_end"), F.sum("n_events").alias("_n"), F.max("_over").alias("_over"))
    known = events.where(F.col("ts").isNotNull()).join(ends, F.col("user_id").eqNullSafe(F.col("_u")), "left") \
        .withColumn("_open", F.col("_end").isNull() | (F.col("ts") >= F.col("_end")))
    wrong = known.where("_end IS NOT NULL").groupBy(F.col("user_id").alias("_w")) \
        .agg(F.count(F.lit(1)).alias("_all"), F.count_if("_open").alias("_after"), F.max("_n").alias("_n"),
             F.max("_over").alias("_over")) \
        .where(F.col("_over") | (F.col("_all") != F.col("_n") + F.col("_after"))).select("_w", F.lit(True).alias("_anew"))
    same_user = F.col("user_id").eqNullSafe(F.col("_w"))
    left = known.select("user_id", "ts", "_open").join(wrong, same_user, "left").where(F.col("_open") | F.col("_anew"))
    again = left.groupBy("user_id", F.session_window("ts", gap).alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    return closed.join(wrong, same_user, "left_anti").select("user_id", "s", "n_events").unionByName(again)


# --------------------------------------------------------------------------
# continuous ingest (ST1): a log of validated batches over the main table
# --------------------------------------------------------------------------
def write_main(ratings: DataFrame, path: str) -> None:
    """Start a ratings log from one row per (user, item)."""
    RatingsLog.create(ratings, path)


def current_ratings(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """V-7 on read: the last row per (user, item), later batches winning."""
    return RatingsLog(spark, path).current(before)


def compact(spark: SparkSession, path: str, to: str) -> None:
    """Write the current table as a new log without batches; readers move on to it."""
    write_main(current_ratings(spark, path), to)


def run_ingest(new_ratings: DataFrame, table_path: str, checkpoint: str) -> DataFrame:
    """ST1: continuous ingest into a ratings log.

    Each micro-batch is written once, validated (V-1..V-5, F4, F5) against
    the statistics of the table as it stood before, and appended to the log
    (``sources.ratings_log``).  The statistics are maintained by batch, so
    a micro-batch reads the buckets of its own keys and no other ratings; no
    file of another batch is rewritten.  A replayed batch replaces its own
    partitions and is judged by the same earlier batches.  Readers merge on
    read; ``compact`` bounds what they merge.
    """
    spark = new_ratings.sparkSession

    def write(batch: DataFrame, batch_id: int) -> None:
        log = RatingsLog(spark, table_path)
        rows = materialize(batch.select("user_id", "item_id", "rating", "ts"), "batch")
        stats = materialize(log.stats(batch_id), "stats")
        report = materialize(quality.validation_report(rows, stats), "report")
        log.append(quality.filter_invalid(rows, report, stats), batch_id)

    q = (new_ratings.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return current_ratings(spark, table_path)
