"""Quality gate for new ratings (V-1..V-5, F4, F5) and the merge (V-7).

``stats`` is the one-row output of ``profile.dataset_stats`` for the main
table; it is broadcast into every check, so a validation pass is one scan
of the new batch plus two small group-bys.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .prep import dedup_keep_last, union_all
from .profile import rating_distribution

# Thresholds of the quality gate.
OUTLIER_FACTOR = 5.0          # counts above 5 x the per-entity average
ANOMALY_THRESHOLD = 0.3       # mean |current - expected| share per bucket
WARNING_INVALID_PCT = 10.0
CRITICAL_INVALID_PCT = 30.0
WARNING_OUTLIER_USER_SHARE = 0.1


def user_outliers(ratings: DataFrame, stats: DataFrame, key: str = "user_id",
                  avg_col: str = "avg_ratings_per_user", factor: float = OUTLIER_FACTOR) -> DataFrame:
    """V-3 / V-4: ``(key, n_ratings)`` with count > factor x average per entity."""
    thr = F.broadcast(stats.select((F.col(avg_col) * factor).alias("_max")))
    cnt = ratings.groupBy(key).agg(F.count(F.lit(1)).alias("n_ratings"))
    return cnt.crossJoin(thr).where(F.col("n_ratings") > F.col("_max")).drop("_max")


def item_outliers(ratings: DataFrame, stats: DataFrame, factor: float = OUTLIER_FACTOR) -> DataFrame:
    return user_outliers(ratings, stats, "item_id", "avg_ratings_per_item", factor)


def validation_report(ratings: DataFrame, stats: DataFrame) -> DataFrame:
    """V-1, V-2, V-5 (+ counts of V-3/V-4): one row.

    invalid = rating outside [min_rating, max_rating] of the main table;
    distribution difference = mean |current share - expected share| over
    the 5 buckets of [min, max]; status: 'critical' when invalid > 30 %,
    'warning' when invalid > 10 % or anomalous or outlier users exceed 10 %
    of the batch's distinct users, else 'valid'.
    """
    s = F.broadcast(stats.select("min_rating", "max_rating", "rating_distribution",
                                 "avg_ratings_per_user", "avg_ratings_per_item"))
    base = ratings.crossJoin(s).agg(
        F.count(F.lit(1)).alias("total_ratings"),
        F.count_if((F.col("rating") < F.col("min_rating")) | (F.col("rating") > F.col("max_rating")))
        .alias("invalid_count"),
        F.count_distinct("user_id").alias("distinct_users"))
    cur = rating_distribution(ratings, stats, out="current_distribution")
    nu = user_outliers(ratings, stats).agg(F.count(F.lit(1)).alias("outlier_users"))
    ni = item_outliers(ratings, stats).agg(F.count(F.lit(1)).alias("outlier_items"))
    row = base.crossJoin(cur).crossJoin(s.select(
        F.col("rating_distribution").alias("expected_distribution"),
        F.col("min_rating").alias("min_allowed"), F.col("max_rating").alias("max_allowed"),
        (F.col("avg_ratings_per_user") * OUTLIER_FACTOR).alias("max_expected_per_user"),
        (F.col("avg_ratings_per_item") * OUTLIER_FACTOR).alias("max_expected_per_item"))) \
        .crossJoin(nu).crossJoin(ni)
    diff = F.aggregate(F.zip_with("current_distribution", "expected_distribution",
                                  lambda a, b: F.abs(a - b)), F.lit(0.0), lambda acc, x: acc + x) / 5.0
    pct = F.when(F.col("total_ratings") > 0,
                 F.col("invalid_count") * 100.0 / F.col("total_ratings")).otherwise(F.lit(0.0))
    row = row.withColumn("invalid_percent", pct).withColumn("distribution_difference", diff) \
             .withColumn("is_anomalous", F.col("distribution_difference") > ANOMALY_THRESHOLD)
    status = (F.when(F.col("invalid_percent") > CRITICAL_INVALID_PCT, F.lit("critical"))
              .when((F.col("invalid_percent") > WARNING_INVALID_PCT) | F.col("is_anomalous") |
                    (F.col("outlier_users") > F.col("distinct_users") * WARNING_OUTLIER_USER_SHARE),
                    F.lit("warning"))
              .otherwise(F.lit("valid")))
    return row.withColumn("status", status)


def filter_invalid(ratings: DataFrame, report: DataFrame, stats: DataFrame) -> DataFrame:
    """F4 + F5: keep ratings inside [min, max]; when the report status is
    critical also drop all rows of outlier users (ids compared as the
    same type, so the filter really removes them)."""
    r = F.broadcast(report.select("min_allowed", "max_allowed", "status"))
    kept = ratings.crossJoin(r).where(F.col("rating").between(F.col("min_allowed"), F.col("max_allowed")))
    out_users = user_outliers(ratings, stats).select("user_id").crossJoin(
        report.select("status")).where(F.col("status") == "critical").select("user_id")
    return kept.drop("min_allowed", "max_allowed", "status").join(out_users, "user_id", "left_anti")


def merge_ratings(existing: DataFrame, new: DataFrame,
                  keys=("user_id", "item_id")) -> DataFrame:
    """V-7: existing then new, keep the last row per (user, item).

    Position in the reference is "existing before new, later rows win";
    here that is an explicit ``batch_seq`` (0 existing, 1 new) followed by
    the event time, so the rule no longer depends on file order.
    """
    e = existing.withColumn("batch_seq", F.lit(0))
    n = new.withColumn("batch_seq", F.lit(1))
    both = union_all(e, n)
    return dedup_keep_last(both, keys, order=("ts", "rating"), seq="batch_seq").drop("batch_seq")
