"""A/B tests as tables (B-1..B-4, F11).

Exposures are an append-only event table ``(test_id, group, user_id,
impression BOOLEAN, conversion BOOLEAN, ...)``; counters are aggregates of
it instead of mutable files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.expr import stable_hash

MIN_IMPROVEMENT = 0.05  # fixed value: winner must be > 5 % better


def assign_groups(users: DataFrame, test_id: str, traffic_split: float = 0.5) -> DataFrame:
    """B-4: deterministic group per user from a hash of (user_id, test_id);
    share ``traffic_split`` goes to 'a'.  No shuffle."""
    b = F.pmod(stable_hash("user_id", seed=test_id), F.lit(10000))
    return users.withColumn("test_id", F.lit(test_id)).withColumn(
        "group", F.when(b < int(round(traffic_split * 10000)), F.lit("a")).otherwise(F.lit("b")))


def counters(exposures: DataFrame) -> DataFrame:
    """B-1: impressions and conversions per (test_id, group)."""
    return exposures.groupBy("test_id", "group").agg(
        F.count_if(F.col("impression")).alias("impressions"),
        F.count_if(F.col("conversion")).alias("conversions"))


def conclude(counts: DataFrame) -> DataFrame:
    """B-2: per test the conversion rates, relative improvement of b over
    a (NULL when a has no conversions), and the winner ('a', 'b', 'tie').
    A side with conversions beats a side with none (no division by 0)."""
    p = counts.groupBy("test_id").pivot("group", ["a", "b"]).agg(
        F.first("impressions").alias("impressions"), F.first("conversions").alias("conversions"))
    ia, ca = F.coalesce(F.col("a_impressions"), F.lit(0)), F.coalesce(F.col("a_conversions"), F.lit(0))
    ib, cb = F.coalesce(F.col("b_impressions"), F.lit(0)), F.coalesce(F.col("b_conversions"), F.lit(0))
    ra = F.when(ia > 0, ca / ia).otherwise(F.lit(0.0))
    rb = F.when(ib > 0, cb / ib).otherwise(F.lit(0.0))
    out = p.select("test_id", ia.alias("impressions_a"), ca.alias("conversions_a"),
                   ib.alias("impressions_b"), cb.alias("conversions_b"),
                   ra.alias("conversion_rate_a"), rb.alias("conversion_rate_b"))
    a, b = F.col("conversion_rate_a"), F.col("conversion_rate_b")
    out = out.withColumn("relative_improvement", F.when(a > 0, (b - a) / a))
    winner = (F.when((b > a) & ((a == 0) | ((b - a) / a > MIN_IMPROVEMENT)), F.lit("b"))
              .when((a > b) & ((b == 0) | ((a - b) / b > MIN_IMPROVEMENT)), F.lit("a"))
              .otherwise(F.lit("tie")))
    return out.withColumn("winner", winner)


def active_tests(tests: DataFrame, now_epoch: float) -> DataFrame:
    """status active and end time after ``now_epoch``."""
    return tests.where((F.col("status") == "active") & (F.col("end_time") > F.lit(now_epoch)))


def champion(conclusions: DataFrame, models: DataFrame) -> DataFrame:
    """B-3: per (domain, dataset) the newest concluded winner's model, else
    the latest trained model.  ``conclusions``: (domain, dataset, concluded_at,
    winning_model); ``models``: (domain, dataset, algorithm, version, timestamp)."""
    won = conclusions.where(F.col("winning_model").isNotNull()).select(
        "domain", "dataset", F.col("winning_model").alias("model"),
        F.lit(0).alias("_prio"), F.col("concluded_at").cast("double").alias("_t"))
    latest = models.select("domain", "dataset", F.col("algorithm").alias("model"),
                           F.lit(1).alias("_prio"), F.col("timestamp").cast("double").alias("_t"))
    both = won.unionByName(latest)
    return both.groupBy("domain", "dataset").agg(
        F.min_by(F.struct("model", F.col("_prio").alias("source")),
                 F.struct(F.col("_prio"), -F.col("_t"))).alias("_b")) \
        .select("domain", "dataset", F.col("_b.model").alias("model"),
                F.when(F.col("_b.source") == 0, F.lit("ab_test")).otherwise(F.lit("latest")).alias("source"))
