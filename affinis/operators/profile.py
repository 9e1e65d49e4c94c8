"""Data-set statistics and the model-selection profile.

All profile numbers are exact and come from a handful of aggregates:
per-entity counts are a partial+final aggregate, and the distribution
measures (entropy, Gini) are computed from the *histogram of counts*
``(count value, frequency)`` — never from a global sort of entities.

Gini identity: for sorted values x'_1..x'_n (x' = x + 1e-7, shifted when
negative) and index i, sum (2i - n - 1) x'_i = sum over distinct values v
with frequency f and prefix P (entities with a smaller value) of
x'_v * f * (2P + f - n).  P is a running sum over the histogram, whose
size is the number of distinct count values (small).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.expr import bucket5, epoch_seconds
from ..session import materialize

GINI_EPS = 1e-7


def count_histogram(counts: DataFrame, value: str) -> DataFrame:
    """(value, freq) — entities per distinct count value."""
    return counts.groupBy(value).agg(F.count(F.lit(1)).alias("freq"))


def entropy_and_gini(counts: DataFrame, value: str, prefix: str) -> DataFrame:
    """A14 + A15 from per-entity ``counts`` -> one row."""
    h = count_histogram(counts, value)
    w = Window.orderBy(value)
    h = h.withColumn("_P", F.coalesce(F.sum("freq").over(
        w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    tot = h.agg(F.sum("freq").alias("_n"), F.min(value).alias("_min"))
    h = h.crossJoin(F.broadcast(tot))
    shift = F.when(F.col("_min") < 0, -F.col("_min")).otherwise(F.lit(0))
    x = F.col(value).cast("double") + shift + F.lit(GINI_EPS)
    p = F.col("freq") / F.col("_n")
    return h.agg(
        (-F.sum(p * F.ln(p))).alias(f"{prefix}_entropy"),
        (F.sum(x * F.col("freq") * (2 * F.col("_P") + F.col("freq") - F.col("_n")))
         / (F.first("_n") * F.sum(x * F.col("freq")))).alias(f"{prefix}_gini"))


def dataset_stats(df: DataFrame) -> DataFrame:
    """A9 + A10: one row of totals, min/max/mean, per-user and per-item
    averages, sparsity and the normalised 5-bucket rating histogram
    (``rating_distribution`` ARRAY<DOUBLE>, last bucket closed)."""
    base = df.agg(
        F.count(F.lit(1)).alias("total_ratings"),
        F.count_distinct("user_id").alias("total_users"),
        F.count_distinct("item_id").alias("total_items"),
        F.min("rating").cast("double").alias("min_rating"),
        F.max("rating").cast("double").alias("max_rating"),
        F.avg("rating").alias("avg_rating"))
    base = materialize(base, "stats-base")  # one row, used twice: the table is not scanned again for it
    hist = rating_distribution(df, base)
    out = base.crossJoin(hist)
    return out.select(
        "total_ratings", "total_users", "total_items", "min_rating", "max_rating", "avg_rating",
        "rating_distribution",
        (F.col("total_ratings") / F.col("total_users")).alias("avg_ratings_per_user"),
        (F.col("total_ratings") / F.col("total_items")).alias("avg_ratings_per_item"),
        (F.lit(1.0) - F.col("total_ratings") / (F.col("total_users") * F.col("total_items"))).alias("sparsity"))


def rating_distribution(df: DataFrame, bounds: DataFrame, lo: str = "min_rating",
                        hi: str = "max_rating", out: str = "rating_distribution") -> DataFrame:
    """A10: share of rows per equal-width bucket on [lo, hi] (one row,
    ARRAY<DOUBLE> of 5); rows outside the range are ignored; all zeros
    when no row is in range.  ``bounds`` is a one-row frame."""
    b = F.broadcast(bounds.select(lo, hi))
    x = df.select("rating").crossJoin(b).select(bucket5("rating", lo, hi).alias("_b"))
    counts = x.agg(*[F.count_if(F.col("_b") == i).alias(f"_c{i}") for i in range(5)])
    tot = sum(F.col(f"_c{i}") for i in range(5))
    return counts.select(F.array(*[
        F.when(tot > 0, F.col(f"_c{i}") / tot).otherwise(F.lit(0.0)) for i in range(5)]).alias(out))


def rating_histogram(df: DataFrame) -> DataFrame:
    """Rows per rating value."""
    return df.groupBy("rating").agg(F.count(F.lit(1)).alias("n_ratings"))


def interaction_gaps(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Mean and sample std (seconds) of the gaps between consecutive
    interactions of each user, over all gaps of all users.

    Rows are grouped by (user, day): gaps inside a day come from ``lag``,
    gaps between days from one row per user and day.  A task holds a day of
    a user, not a history, however hot the user.
    """
    x = df.select("user_id", epoch_seconds(ts).alias("_t")).where(F.col("user_id").isNotNull() & F.col("_t").isNotNull()) \
        .withColumn("_d", F.floor(F.col("_t") / 86400))
    inside = x.select((F.col("_t") - F.lag("_t").over(Window.partitionBy("user_id", "_d").orderBy("_t"))).alias("_g"))
    days = x.groupBy("user_id", "_d").agg(F.min("_t").alias("_first"), F.max("_t").alias("_last"))
    between = days.select(
        (F.col("_first") - F.lag("_last").over(Window.partitionBy("user_id").orderBy("_d"))).alias("_g"))
    return inside.unionByName(between).where(F.col("_g").isNotNull()).agg(
        F.coalesce(F.avg("_g"), F.lit(0.0)).alias("avg_time_between_interactions"),
        F.coalesce(F.stddev_samp("_g"), F.lit(0.0)).alias("temporal_interaction_std"))


def feature_richness(spark: SparkSession, features: DataFrame | None, key: str, prefix: str) -> DataFrame:
    """Number of feature columns and share of NULL cells."""
    spark_cols = [c for c in features.columns if c != key] if features is not None else []
    if features is None or not spark_cols:
        return spark.range(1).select(F.lit(0).cast("bigint").alias(f"num_{prefix}_features"),
                                     F.lit(1.0).alias(f"{prefix}_feature_sparsity"))
    nulls = sum(F.count_if(F.col(c).isNull()) for c in spark_cols)
    return features.agg((nulls / (F.count(F.lit(1)) * len(spark_cols))).alias(f"{prefix}_feature_sparsity")) \
                   .select(F.lit(len(spark_cols)).cast("bigint").alias(f"num_{prefix}_features"),
                           f"{prefix}_feature_sparsity")


def dataset_profile(train: DataFrame, test: DataFrame | None = None,
                    user_features: DataFrame | None = None,
                    item_features: DataFrame | None = None, ts: str | None = "ts") -> DataFrame:
    """The one-row data-set profile used by the rule-based selector."""
    pairs = train.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("_n"))
    uc = pairs.groupBy("user_id").agg(F.sum("_n").alias("cnt"), F.count(F.lit(1)).alias("_dist"))
    ic = pairs.groupBy("item_id").agg(F.sum("_n").alias("cnt"), F.count(F.lit(1)).alias("_dist"))
    size = train.agg(
        F.count(F.lit(1)).alias("num_interactions"),
        F.avg("rating").alias("rating_mean"), F.stddev_samp("rating").alias("rating_std"),
        F.min("rating").cast("double").alias("rating_min"),
        F.max("rating").cast("double").alias("rating_max"),
        F.count_distinct("rating").alias("rating_unique"),
        F.bool_and(F.col("rating") >= 0).alias("_nonneg"),
        *([F.min(epoch_seconds(ts)).alias("_tmin"), F.max(epoch_seconds(ts)).alias("_tmax")] if ts else []))
    ua = uc.agg(F.count(F.lit(1)).alias("num_users"),
                F.avg("cnt").alias("user_activity_mean"), F.stddev_samp("cnt").alias("user_activity_std"),
                F.min("cnt").alias("user_activity_min"), F.max("cnt").alias("user_activity_max"),
                F.avg("_dist").alias("avg_items_per_user"))
    ia = ic.agg(F.count(F.lit(1)).alias("num_items"),
                F.avg("cnt").alias("item_popularity_mean"), F.stddev_samp("cnt").alias("item_popularity_std"),
                F.min("cnt").alias("item_popularity_min"), F.max("cnt").alias("item_popularity_max"),
                F.avg("_dist").alias("avg_users_per_item"))
    row = (size.crossJoin(ua).crossJoin(ia)
           .crossJoin(entropy_and_gini(uc, "cnt", "user_activity"))
           .crossJoin(entropy_and_gini(ic, "cnt", "item_popularity")))
    if ts:
        row = row.crossJoin(interaction_gaps(train, ts)).withColumn("has_temporal_data", F.lit(True)) \
                 .withColumn("temporal_span_days", (F.col("_tmax") - F.col("_tmin")) / 86400.0) \
                 .withColumn("interactions_per_day", F.col("num_interactions") / F.col("temporal_span_days"))
    else:
        row = row.withColumn("has_temporal_data", F.lit(False))
    if test is not None:
        tu = test.select("user_id").distinct()
        ti = test.select("item_id").distinct()
        cold = tu.agg(F.count(F.lit(1)).alias("_tu")).crossJoin(
            tu.join(train.select("user_id").distinct(), "user_id", "left_anti").agg(
                F.count(F.lit(1)).alias("_nu"))).crossJoin(
            ti.agg(F.count(F.lit(1)).alias("_ti"))).crossJoin(
            ti.join(train.select("item_id").distinct(), "item_id", "left_anti").agg(
                F.count(F.lit(1)).alias("_ni")))
        cold = cold.select((F.col("_nu") / F.col("_tu")).alias("cold_start_ratio_users"),
                           (F.col("_ni") / F.col("_ti")).alias("cold_start_ratio_items"))
    else:
        cold = train.sparkSession.range(1).select(F.lit(0.0).alias("cold_start_ratio_users"),
                                                  F.lit(0.0).alias("cold_start_ratio_items"))
    row = row.crossJoin(cold).crossJoin(feature_richness(train.sparkSession, user_features, "user_id", "user")) \
             .crossJoin(feature_richness(train.sparkSession, item_features, "item_id", "item"))
    row = row.withColumn("sparsity", F.lit(1.0) - F.col("num_interactions") /
                         (F.col("num_users") * F.col("num_items")))
    row = row.withColumn("binary_ratings", F.col("rating_unique") <= 2) \
             .withColumn("explicit_ratings", F.col("rating_unique") > 5) \
             .withColumn("implicit_feedback", F.col("binary_ratings") | F.col("_nonneg")) \
             .withColumn("recommendation_difficulty", F.pow(
                 F.col("sparsity") * F.col("item_popularity_gini") * F.col("user_activity_gini"), 0.33))
    return row.drop("_nonneg", "_tmin", "_tmax")
