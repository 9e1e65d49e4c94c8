"""User, item and interaction features (one aggregate pass each).

The data-set-wide scalars (newest timestamp, 90-day cutoff) are one-row
aggregates broadcast into the per-entity aggregate — no driver round trip.
User features take the newest timestamp from their own per-user maxima;
item features need the cutoff before aggregating, which costs one extra
scan pruned to the timestamp column.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import days_between, is_weekend, weekday_mon0
from ..session import materialize


def user_features(df: DataFrame, ts: str | None = "ts") -> DataFrame:
    """A1-A3: per-user count, mean, sample std (0 for one rating), max, min,
    days since the user's last rating (vs data-set max) and rating
    frequency = count / max(1, span days)."""
    aggs = [
        F.count(F.lit(1)).alias("user_rating_count"),
        F.avg("rating").alias("user_avg_rating"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("user_rating_std"),
        F.max("rating").alias("user_max_rating"),
        F.min("rating").alias("user_min_rating"),
    ]
    if ts is None:
        return df.groupBy("user_id").agg(*aggs)
    # written once: the data-set max is the max of the per-user maxima, without a second scan of the rows
    out = materialize(df.groupBy("user_id").agg(*aggs, F.max(ts).alias("_last"), F.min(ts).alias("_first")), "users")
    gmax = out.agg(F.max("_last").alias("_gmax"))
    return (out.crossJoin(F.broadcast(gmax))
            .withColumn("days_since_last_rating", days_between("_gmax", "_last"))
            .withColumn("rating_frequency", F.col("user_rating_count") /
                        F.greatest(F.lit(1.0), days_between("_last", "_first")))
            .drop("_last", "_first", "_gmax"))


def item_features(df: DataFrame, ts: str | None = "ts", recent_days: int = 90) -> DataFrame:
    """A4-A5 (+F6, J4): per-item count, mean, std, popularity, recent
    popularity (rows within ``recent_days`` of the data-set max; 0 when
    none) and popularity trend = recent / max(1, count)."""
    aggs = [
        F.count(F.lit(1)).alias("item_rating_count"),
        F.avg("rating").alias("item_avg_rating"),
        F.coalesce(F.stddev_samp("rating"), F.lit(0.0)).alias("item_rating_std"),
        F.count(F.lit(1)).alias("popularity"),
    ]
    if ts is None:
        return df.groupBy("item_id").agg(*aggs)
    gmax = df.agg(F.max(ts).alias("_gmax"))
    cutoff = F.col("_gmax") - F.expr(f"INTERVAL {int(recent_days)} DAYS")
    out = (df.crossJoin(F.broadcast(gmax))
           .groupBy("item_id")
           .agg(*aggs, F.count_if(F.col(ts) >= cutoff).alias("recent_popularity")))
    return out.withColumn("popularity_trend",
                          F.col("recent_popularity") / F.greatest(F.lit(1), F.col("item_rating_count")))


def interaction_features(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Hour, weekday (Mon=0), weekend flag, month — projections only."""
    return (df.withColumn("hour", F.hour(ts))
            .withColumn("day_of_week", weekday_mon0(ts))
            .withColumn("is_weekend", is_weekend(ts))
            .withColumn("month", F.month(ts)))


def create_features(train: DataFrame, test: DataFrame | None = None,
                    scope: str = "train") -> dict[str, DataFrame]:
    """Feature tables for a split.

    ``scope='all'`` reproduces the reference (train and test together;
    leaks test information), ``scope='train'`` uses train only.
    """
    data = train if (scope == "train" or test is None) else train.unionByName(test)
    return {"user_features": user_features(data),
            "item_features": item_features(data),
            "interaction_features": interaction_features(data)}


def indicator_features(entities: DataFrame, key: str, columns: list[str],
                       keep: DataFrame | None = None) -> DataFrame:
    """``(key, feature)`` with feature = '{column}_{value}'.

    Only entities present in ``keep`` (e.g. train) are kept (left semi).
    """
    stacked = entities.select(
        key, F.explode(F.array(*[
            F.concat_ws("_", F.lit(c), F.col(c).cast("string")) for c in columns])).alias("feature"))
    stacked = stacked.where(F.col("feature").isNotNull())
    if keep is not None:
        stacked = stacked.join(keep.select(key).distinct(), key, "left_semi")
    return stacked.distinct()
