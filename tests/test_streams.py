"""Streams over part files and several micro-batches equal the batch operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from affinis.operators import prep
from affinis.streaming import streams
from conftest import SF001, rows


@pytest.fixture()
def parts(spark, tmp_dir):
    """Events as a folder of four part files in arbitrary time order, and a null user."""
    path = f"{tmp_dir}/events.parquet"
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    extra = ev.limit(3).withColumn("user_id", F.lit(None).cast("long")).withColumn("event_id", -F.col("event_id") - 1)
    ev.unionByName(extra).repartition(4, "event_id").write.parquet(path)
    return path


def batch(spark, path):
    ev = spark.read.parquet(path)
    return ev.select("event_id", "user_id", F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
                     F.col("event_type").alias("interaction_type"), F.col("ts").cast("timestamp").alias("ts"))


def test_folder_and_file_tables_stream(spark, parts, tmp_dir):
    got = streams.run_append(streams.implicit_ratings(streams.event_stream(spark, parts, 1)), f"{tmp_dir}/o", f"{tmp_dir}/c")
    assert rows(got) == rows(streams.implicit_ratings(batch(spark, parts))) and got.count() > 100
    one = streams.run_append(streams.implicit_ratings(streams.event_stream(spark, f"{SF001}/events.parquet")),
                             f"{tmp_dir}/o1", f"{tmp_dir}/c1")
    assert one.count() > 100


def test_last_duplicate_wins_over_batches(spark, parts, tmp_dir):
    cols = ["user_id", "item_id", "rating", "ts"]
    st = streams.implicit_ratings(streams.event_stream(spark, parts, 1)).select(cols)
    got = streams.run_latest(st, f"{tmp_dir}/o", f"{tmp_dir}/c", ["user_id", "item_id"], ["ts", "rating"])
    want = prep.dedup_keep_last(streams.implicit_ratings(batch(spark, parts)).select(cols))
    key = lambda r: tuple(str(x) for x in r)
    assert sorted(map(tuple, got.select(cols).collect()), key=key) == sorted(map(tuple, want.collect()), key=key)


def test_sessions_leave_no_event_out(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    closed = streams.run_append(streams.user_sessions(streams.event_stream(spark, f"{SF001}/events.parquet")),
                                f"{tmp_dir}/o", f"{tmp_dir}/c")
    events = ev.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.complete_sessions(closed, events)
    want = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    assert rows(out, "user_id", "s.start", "n_events") == rows(want, "user_id", "s.start", "n_events")
    assert out.agg(F.sum("n_events")).first()[0] == ev.count() and closed.count() < out.count()


def test_ingest_appends_and_replays(spark, tmp_dir):
    t0 = dt.datetime(2024, 1, 1)
    main = spark.createDataFrame([(u, i, 1.0 + (u + i) % 5, t0) for u in range(6) for i in range(5)],
                                 "user_id long, item_id long, rating double, ts timestamp")
    path, new = f"{tmp_dir}/main", f"{tmp_dir}/new"
    streams.write_main(main, path)
    schema = "user_id long, item_id long, rating double, ts timestamp"
    batches = [[(1, 1, 4.0, t0 + dt.timedelta(days=k)), (2, k, 5.0, t0 + dt.timedelta(days=1)), (9, 9, 99.0, t0)]
               for k in range(3)]
    for b in batches:
        spark.createDataFrame(b, schema).coalesce(1).write.mode("append").parquet(new)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(new)
    before = sorted(f for f in spark.read.parquet(path).inputFiles())
    got = streams.run_ingest(stream, path, f"{tmp_dir}/ck")
    log = spark.read.parquet(path)
    assert set(before) <= set(log.inputFiles())  # no file of the main table is rewritten
    assert rows(log.groupBy("_batch").count().where("_batch >= 0"), "_batch") == [(0,), (1,), (2,)]
    assert got.count() == 30 and not got.where("rating > 5").count()
    assert rows(got.where("user_id = 1 and item_id = 1"), "rating") == [(4.0,)]
    kept = rows(got)
    again = streams.run_ingest(stream, path, f"{tmp_dir}/ck2")  # every batch replayed
    assert rows(again) == kept
    streams.compact(spark, path, f"{tmp_dir}/compacted")
    assert rows(streams.current_ratings(spark, f"{tmp_dir}/compacted")) == kept


def test_sessions_of_files_out_of_time_order(spark, tmp_dir):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    ev = ev.unionByName(ev.limit(20).withColumn("user_id", F.lit(None).cast("long")))
    half = ev.agg(F.expr("percentile(unix_micros(cast(ts as timestamp)), 0.5)")).first()[0]
    late = F.unix_micros(F.col("ts").cast("timestamp")) >= half
    path = f"{tmp_dir}/events.parquet"
    odd = F.col("event_id") % 2 == 1
    for part in (ev.where(late & odd), ev.where(late & ~odd), ev.where(~late)):  # the old events come behind the watermark
        part.coalesce(1).write.mode("append").parquet(path)
    closed = streams.run_append(streams.user_sessions(streams.event_stream(spark, path, 1)), f"{tmp_dir}/o", f"{tmp_dir}/c")
    events = ev.select("user_id", F.col("ts").cast("timestamp").alias("ts"))
    out = streams.complete_sessions(closed, events)
    want = events.groupBy("user_id", F.session_window("ts", "1 hour").alias("s")).agg(F.count(F.lit(1)).alias("n_events"))
    key = lambda r: tuple(str(x) for x in r)
    got = [sorted(map(tuple, d.select("user_id", "s.start", "s.end", "n_events").collect()), key=key) for d in (out, want)]
    assert got[0] == got[1]


def test_a_session_closed_too_early_is_made_anew(spark):
    t0 = dt.datetime(2024, 1, 1)
    at = lambda m: t0 + dt.timedelta(minutes=m)
    events = spark.createDataFrame([(1, at(0)), (1, at(50)), (2, at(0))], "user_id long, ts timestamp")
    closed = spark.createDataFrame([(1, (at(0), at(60)), 1), (1, (at(50), at(110)), 1), (2, (at(0), at(60)), 1)],
                                   "user_id long, s struct<start: timestamp, end: timestamp>, n_events long")
    assert rows(streams.complete_sessions(closed, events), "user_id", "s.start", "s.end", "n_events") == [
        (1, at(0), at(110), 2), (2, at(0), at(60), 1)]
