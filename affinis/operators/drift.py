"""Drift detection and retrain decision (D-1..D-3).

Current and training statistics are one-row frames from
``profile.dataset_stats`` (plus a ``stats_time`` epoch column); the report
is one row whose ``reasons`` array lists the significant shifts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Significance thresholds.
VOLUME_PCT = 10.0
DIST_SHIFT = 0.05
USERS_PCT = 15.0
ITEMS_PCT = 15.0
AGE_DAYS = 30.0


def _pct(cur, prev):
    return F.when(prev > 0, (cur - prev) * 100.0 / prev).otherwise(F.lit(100.0))


def drift_report(current: DataFrame, training: DataFrame, now_epoch: float | None = None) -> DataFrame:
    """D-1: one row with percent changes, distribution shift, age and
    ``should_retrain`` / ``reasons``.  ``now_epoch`` is a parameter (no
    wall clock inside the plan); without it the age check is skipped."""
    c = current.select(*[F.col(x).alias(f"c_{x}") for x in current.columns])
    t = training.select(*[F.col(x).alias(f"t_{x}") for x in training.columns])
    row = c.crossJoin(t)
    row = row.select(
        F.col("t_total_ratings").alias("previous_ratings"), F.col("c_total_ratings").alias("current_ratings"),
        _pct(F.col("c_total_ratings"), F.col("t_total_ratings")).alias("ratings_change_pct"),
        _pct(F.col("c_total_users"), F.col("t_total_users")).alias("users_change_pct"),
        _pct(F.col("c_total_items"), F.col("t_total_items")).alias("items_change_pct"),
        F.when(F.size("c_rating_distribution") == F.size("t_rating_distribution"),
               F.aggregate(F.zip_with("c_rating_distribution", "t_rating_distribution",
                                      lambda a, b: F.abs(a - b)), F.lit(0.0), lambda s, x: s + x)
               / F.size("c_rating_distribution")).alias("distribution_shift"),
        (((F.lit(float(now_epoch)) - F.col("t_stats_time")) / 86400.0) if (
            now_epoch is not None and "stats_time" in training.columns) else F.lit(None).cast("double"))
        .alias("days_elapsed"))
    reasons = F.array_compact(F.array(
        F.when(F.col("ratings_change_pct") > VOLUME_PCT, F.lit("data_volume")),
        F.when(F.col("distribution_shift") > DIST_SHIFT, F.lit("rating_distribution")),
        F.when(F.col("users_change_pct") > USERS_PCT, F.lit("user_base")),
        F.when(F.col("items_change_pct") > ITEMS_PCT, F.lit("item_catalog")),
        F.when(F.col("days_elapsed") > AGE_DAYS, F.lit("time_elapsed"))))
    return row.withColumn("reasons", reasons).withColumn("should_retrain", F.size("reasons") > 0)


def retrain_decision(report: DataFrame, has_model: DataFrame, active_tests: DataFrame) -> DataFrame:
    """D-2: retrain when drift says so or no model exists; flag active A/B
    tests.  ``has_model`` one row (has_model BOOLEAN); ``active_tests`` any
    table of active tests."""
    n_active = active_tests.agg(F.count(F.lit(1)).alias("active_ab_tests"))
    return report.crossJoin(has_model).crossJoin(n_active).select(
        (F.col("should_retrain") | ~F.col("has_model")).alias("retrain"),
        F.when(~F.col("has_model"), F.array(F.lit("no_model"))).otherwise(F.col("reasons")).alias("reasons"),
        "active_ab_tests")


def training_baseline(stats_history: DataFrame, current: DataFrame, stats_time: float) -> DataFrame:
    """D-3: append the current stats as the new training baseline row
    (role='training'); the newest such row is the baseline."""
    row = current.withColumn("stats_time", F.lit(float(stats_time))).withColumn("role", F.lit("training"))
    return stats_history.unionByName(row, allowMissingColumns=True)
