"""Cleaning, filtering, splitting, deduplication and indexing.

Scale notes
-----------
* No operator here uses an un-partitioned window over the interactions.
  Global positions (dense indices, the exact time split) come from a
  range-partitioned sort plus per-partition offsets
  (``global_row_number``); only the tiny per-partition count table is
  ordered as a whole.
* Keep-last deduplication is an aggregate (``max`` of a struct) so it is
  combined map-side; a hot (user, item) pair never lands whole in one
  task.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import stable_hash
from ..session import cut_lineage

POS_BITS = 33  # monotonically_increasing_id layout: partition id << 33 | row


# --------------------------------------------------------------------------
# positions
# --------------------------------------------------------------------------
def global_row_number(df: DataFrame, order_cols: list, out: str = "pos") -> DataFrame:
    """0-based position of each row in the total order ``order_cols``.

    orderBy = range shuffle + local sort (balanced by sampled bounds), then
    ``monotonically_increasing_id`` gives (partition, offset-in-partition).
    The sorted table is checkpointed so both the offset table and the rows
    read the same partitioning.  Offsets: one row per partition, summed in
    a window over that tiny table and broadcast (bounded by the number of
    partitions).
    """
    ordered = df.orderBy(*order_cols).withColumn("_mid", F.monotonically_increasing_id())
    ordered = cut_lineage(ordered)
    with_pid = ordered.withColumn("_pid", F.shiftright("_mid", POS_BITS)) \
                      .withColumn("_in", F.col("_mid").bitwiseAND((1 << POS_BITS) - 1))
    sizes = with_pid.groupBy("_pid").agg(F.count(F.lit(1)).alias("_n"))
    offs = sizes.withColumn(
        "_off", F.coalesce(F.sum("_n").over(
            Window.orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    return (with_pid.join(F.broadcast(offs.select("_pid", "_off")), "_pid")
            .withColumn(out, (F.col("_off") + F.col("_in")).cast("bigint"))
            .drop("_pid", "_in", "_off", "_mid"))


def dense_index(df: DataFrame, key: str, out: str | None = None) -> DataFrame:
    """Dense 0-based index of the distinct values of ``key``, by id order.

    Returns ``(key, out)``; join it (inner, J3) to map ids to indices and
    back.  Order rule: ascending id (deterministic, unlike first
    appearance).
    """
    out = out or f"{key}_idx"
    ids = df.select(key).where(F.col(key).isNotNull()).distinct()
    index = F.when(F.col(out) < 2**31, F.col(out).cast("int")).otherwise(
        F.raise_error(F.lit(f"{key}: more than 2^31 distinct values do not fit a dense INT index")))
    return global_row_number(ids, [key], out).select(key, index.alias(out))


# --------------------------------------------------------------------------
# cleaning
# --------------------------------------------------------------------------
def add_domain(df: DataFrame, domain: str, dataset: str | None = None) -> DataFrame:
    """Constant domain (and dataset) tag."""
    df = df.withColumn("domain", F.lit(domain))
    return df.withColumn("dataset", F.lit(dataset)) if dataset is not None else df


def epoch_to_timestamp(df: DataFrame, col: str = "timestamp", out: str = "ts") -> DataFrame:
    """P5: numeric epoch -> timestamp; unit ms when the column max > 1e12.

    The max is a one-row aggregate cross-joined (broadcast) back, so the
    decision is taken per data set without a driver round trip.
    """
    mx = df.agg(F.max(F.col(col).cast("double")).alias("_mx"))
    return (df.crossJoin(F.broadcast(mx))
            .withColumn(out, F.when(F.col("_mx") > 1e12,
                                    F.timestamp_millis(F.col(col).cast("bigint")))
                        .otherwise(F.timestamp_seconds(F.col(col).cast("bigint"))))
            .drop("_mx"))


def coerce_ratings(df: DataFrame, policy: str = "drop", col: str = "rating") -> DataFrame:
    """Numeric coercion of ratings.

    policy ``drop``: non-numeric -> dropped (loader rule).
    policy ``zero``: non-numeric -> 0.0 (new-ratings reader rule).
    """
    cast = F.expr(f"try_cast(`{col}` AS DOUBLE)")
    if policy == "drop":
        return df.withColumn(col, cast).where(F.col(col).isNotNull())
    if policy == "zero":
        return df.withColumn(col, F.coalesce(cast, F.lit(0.0)))
    raise ValueError(policy)


def filter_min_ratings(df: DataFrame, min_ratings: int = 10, key: str = "item_id") -> DataFrame:
    """Keep rows whose ``key`` has at least ``min_ratings`` rows.

    Count per key is a partial+final aggregate; the semi join is on the
    key (AQE broadcasts the valid-key list when it is small).
    """
    valid = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") >= min_ratings)
    return df.join(valid.select(key), key, "left_semi")


def recent(df: DataFrame, days: int = 90, ts: str = "ts") -> DataFrame:
    """rows within ``days`` of the data set's newest timestamp."""
    mx = df.agg(F.max(ts).alias("_mx"))
    return (df.crossJoin(F.broadcast(mx))
            .where(F.col(ts) >= F.col("_mx") - F.expr(f"INTERVAL {int(days)} DAYS"))
            .drop("_mx"))


# --------------------------------------------------------------------------
# splitting
# --------------------------------------------------------------------------
def time_split(df: DataFrame, test_size: float = 0.2, ts: str = "ts",
               tie_break: tuple = ("user_id", "item_id", "rating")) -> DataFrame:
    """Exact time-ordered split; first ``int((1-test)*n)`` rows are train.

    Adds ``split`` ('train'/'test'); every input row gets one.  Rows without
    a time come last, as in a sort that puts nulls last.  Plan: rows per
    day (partial agg), cumulative counts over the small day table, then
    only the boundary day is numbered, by the distributed
    ``global_row_number``; other rows are labelled without any shuffle.
    """
    never = F.to_date(F.lit("9999-12-31"))
    day = F.coalesce(F.to_date(F.col(ts)), never)
    per_day = df.groupBy(day.alias("_day")).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy("_day")
    cum = per_day.select(
        "_day", "_n",
        F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)),
                   F.lit(0)).alias("_before"),
        F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("_total"))
    cum = cum.withColumn("_cut", F.floor((1 - F.lit(float(test_size))) * F.col("_total")).cast("bigint"))
    bound = cum.where((F.col("_before") < F.col("_cut")) &
                      (F.col("_before") + F.col("_n") >= F.col("_cut"))).select(
        "_day", "_before", "_cut").collect()
    if not bound:  # cut == 0: everything is test
        return df.withColumn("split", F.lit("test"))
    bday, need = F.lit(bound[0]["_day"]), bound[0]["_cut"] - bound[0]["_before"]
    rest = df.where(day != bday).withColumn(
        "split", F.when(day < bday, F.lit("train")).otherwise(F.lit("test")))
    order = [F.col(ts).asc_nulls_last(), *[F.col(c).asc_nulls_last() for c in tie_break]]
    edge = global_row_number(df.where(day == bday), order, "_pos").withColumn(
        "split", F.when(F.col("_pos") < need, F.lit("train")).otherwise(F.lit("test"))).drop("_pos")
    return rest.unionByName(edge.select(*rest.columns))


def hash_split(df: DataFrame, test_size: float = 0.2, seed: int = 42,
               keys: tuple = ("user_id", "item_id")) -> DataFrame:
    """T5: reproducible random split by a hash of ``keys`` (no shuffle)."""
    h = F.pmod(stable_hash(*keys, seed=seed), F.lit(1_000_000))
    return df.withColumn("split", F.when(h < int(round(test_size * 1_000_000)), F.lit("test"))
                         .otherwise(F.lit("train")))


def exact_split(df: DataFrame, test_size: float = 0.2, seed: int = 42, keys: tuple = ("user_id", "item_id"),
                tie_break: tuple = ("ts", "rating")) -> DataFrame:
    """T5: reproducible random split with an exact number of test rows,
    ``ceil(test_size * n)``: the first ones in the order of a hash of
    ``keys``, numbered by the distributed ``global_row_number``."""
    n_test = math.ceil(test_size * df.count())
    order = [F.col("_h"), *[F.col(c) for c in (*keys, *tie_break)]]
    pos = global_row_number(df.withColumn("_h", stable_hash(*keys, seed=seed)), order, "_pos")
    return pos.withColumn("split", F.when(F.col("_pos") < n_test, F.lit("test")).otherwise(F.lit("train"))) \
        .drop("_h", "_pos")


def train_test(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    return (df.where(F.col("split") == "train").drop("split"),
            df.where(F.col("split") == "test").drop("split"))


# --------------------------------------------------------------------------
# dedup, set ops, seen items
# --------------------------------------------------------------------------
def dedup_keep_last(df: DataFrame, keys=("user_id", "item_id"),
                    order=("ts", "rating"), seq: str | None = None) -> DataFrame:
    """One row per ``keys``; the last by (seq, order...) wins.

    ``max(struct(order..., payload...))`` is an associative aggregate, so
    Spark combines it map-side; group size never matters.
    """
    keys = list(keys)
    order = ([seq] if seq else []) + list(order)
    payload = [c for c in df.columns if c not in keys and c not in order]
    s = F.max(F.struct(*[F.col(c) for c in order + payload])).alias("_last")
    out = df.groupBy(*keys).agg(s)
    return out.select(*keys, *[F.col(f"_last.{c}").alias(c) for c in order + payload]) \
              .select(*[c for c in df.columns])


def union_all(*dfs: DataFrame) -> DataFrame:
    """By-name union, missing columns as NULL."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def new_entities(current: DataFrame, reference: DataFrame, key: str) -> DataFrame:
    """Distinct ``key`` values of ``current`` absent from ``reference``."""
    return current.select(key).distinct().join(reference.select(key).distinct(), key, "left_anti")


def remove_seen(recs: DataFrame, seen: DataFrame, keys=("user_id", "item_id")) -> DataFrame:
    """Drop (user, item) pairs present in ``seen``."""
    return recs.join(seen.select(*keys).distinct(), list(keys), "left_anti")


def users_with_ratings(users: DataFrame, *tables: DataFrame, key: str = "user_id") -> DataFrame:
    """``users`` rows that have a rating in any of ``tables``."""
    keys = union_all(*[t.select(key) for t in tables])
    return users.join(keys, key, "left_semi")


def active_users(df: DataFrame, min_count: int = 20, fallback_cap: int = 5,
                 key: str = "user_id") -> DataFrame:
    """users with >= ``min_count`` rows; if none, threshold min(5, max)."""
    cnt = df.groupBy(key).agg(F.count(F.lit(1)).alias("n_ratings"))
    mx = cnt.agg(F.max("n_ratings").alias("_mx"))
    thr = F.when(F.col("_mx") >= min_count, F.lit(min_count)).otherwise(
        F.least(F.lit(fallback_cap), F.col("_mx")))
    return (cnt.crossJoin(F.broadcast(mx)).where(F.col("n_ratings") >= thr)
            .select(key, "n_ratings"))
