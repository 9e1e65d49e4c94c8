"""Maintained statistics of the ratings log against a full recompute."""

import datetime as dt
import random

from pyspark.sql import functions as F

from affinis.operators import profile
from affinis.sources.ratings_log import BASE, RatingsLog
from conftest import rows

SCHEMA = "user_id string, item_id long, rating double, ts timestamp"
T0 = dt.datetime(2024, 1, 1)


def some(r, n, users=40, items=25, values=(1.0, 2.0, 3.5, 5.0)):
    return [(r.choice([f"u{r.randrange(users)}", f"u{r.randrange(3)}", None]), r.choice([r.randrange(items), None]),
             r.choice([*values, None]), T0 + dt.timedelta(hours=r.randrange(500))) for _ in range(n)]


def equal(log, before=None):
    got, want = log.stats(before).first().asDict(), profile.dataset_stats(log.current(before)).first().asDict()
    for k, v in want.items():
        assert got[k] == v if k == "rating_distribution" or v is None else abs(got[k] - v) < 1e-9, k


def by_hand(batches):
    """Later batches win, inside one the last (ts, rating)."""
    table = {}
    for b in batches:
        mine = {}
        for u, i, r, t in b:
            if (u, i) not in mine or (t, r is not None, r or 0) > mine[u, i][:3]:
                mine[u, i] = (t, r is not None, r or 0, r)
        table.update(mine)
    return sorted(((u or "", -1 if i is None else i, -1 if v[3] is None else v[3]) for (u, i), v in table.items()))


def held(df):
    return sorted((r.user_id or "", -1 if r.item_id is None else r.item_id, -1 if r.rating is None else r.rating)
                  for r in df.collect())


def test_ten_batches_with_replays_equal_a_recompute(spark, tmp_dir):
    r = random.Random(1)
    batches = [some(r, 150)] + [some(r, r.choice([1, 20, 60]), values=(0.5, 2.0, 4.0, 9.0)[:1 + k % 4]) for k in range(10)]
    log = RatingsLog.create(spark.createDataFrame(batches[0], SCHEMA), f"{tmp_dir}/log", buckets=4)
    equal(log)
    for k, b in enumerate(batches[1:]):
        df = spark.createDataFrame(b, SCHEMA)
        log.append(df, k)
        if k == 4:  # the same batch comes again
            log.append(df, k)
    log.append(spark.createDataFrame(batches[3], SCHEMA), 2)  # and an early one after later ones
    equal(log)
    equal(log, before=5)
    assert held(log.current()) == by_hand(batches)
    assert held(log.current(5)) == by_hand(batches[:6])


def test_a_replaced_extreme_goes(spark, tmp_dir):
    base = [("a", 1, 1.0, T0), ("a", 2, 9.0, T0), ("b", 1, 3.0, T0)]
    log = RatingsLog.create(spark.createDataFrame(base, SCHEMA), f"{tmp_dir}/log")
    assert log.stats().first()["max_rating"] == 9.0
    log.append(spark.createDataFrame([("a", 2, 2.0, T0 - dt.timedelta(days=900))], SCHEMA), 0)  # old, but arrives later
    row = log.stats().first()
    assert (row["min_rating"], row["max_rating"], row["total_ratings"]) == (1.0, 3.0, 3)
    assert rows(log.current().where("item_id = 2"), "rating") == [(2.0,)]


def test_purge_takes_a_batch_back(spark, tmp_dir):
    r = random.Random(2)
    batches = [some(r, 80)] + [some(r, 30, users=60) for _ in range(4)]
    log = RatingsLog.create(spark.createDataFrame(batches[0], SCHEMA), f"{tmp_dir}/log", buckets=4)
    for k, b in enumerate(batches[1:]):
        log.append(spark.createDataFrame(b, SCHEMA), k)
    log.purge(1, 4)
    log.purge(1, 4)  # replayed
    left = [b for k, b in enumerate(batches) if k != 2]
    equal(log)
    assert held(log.current()) == by_hand(left)
    log.append(spark.createDataFrame(batches[2], SCHEMA), 5)
    equal(log)
    assert held(log.current()) == by_hand([*left, batches[2]])
    assert held(log.current(4)) == by_hand(batches)  # readers of the earlier state still have it


def test_a_batch_reads_its_own_buckets_only(spark, tmp_dir, monkeypatch):
    base = [(f"u{k}", k, 1.0 + k % 5, T0) for k in range(400)]
    log = RatingsLog.create(spark.createDataFrame(base, SCHEMA), f"{tmp_dir}/log", buckets=32)
    read = []
    current = RatingsLog.current

    def watched(self, *args, **kwargs):
        out = current(self, *args, **kwargs)
        read.append((out.inputFiles(), out._jdf.queryExecution().executedPlan().toString()))
        return out

    monkeypatch.setattr(RatingsLog, "current", watched)
    log.append(spark.createDataFrame([("u1", 1, 5.0, T0), ("new", 7, 2.0, T0)], SCHEMA), 0)
    (_, plan), = read
    own = {r[0] for r in log._rows().where("_batch = 0").select("_bucket").distinct().collect()}
    assert len(own) <= 2 and "PartitionFilters" in plan and "_bucket" in plan
    scanned = log._rows().where(F.col("_bucket").isin(sorted(own)) & (F.col("_batch") < 0)).count()
    assert scanned < 60
    equal(log)
    # a batch whose commit is missing does not count
    assert log.last() == 0 and BASE == -1


def test_empty_tables(spark, tmp_dir):
    log = RatingsLog.create(spark.createDataFrame([], SCHEMA), f"{tmp_dir}/log")
    row = log.stats().first()
    assert row["total_ratings"] == 0 and row["min_rating"] is None and row["sparsity"] is None
    log.append(spark.createDataFrame([], SCHEMA), 0)
    log.append(spark.createDataFrame([("a", 1, 2.0, T0)], SCHEMA), 1)
    assert log.stats().first()["total_users"] == 1 and log.current().count() == 1
