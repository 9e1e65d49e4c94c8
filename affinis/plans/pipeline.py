"""Composed batch jobs: preparation (lifecycle a), update loop (V-8).

Each function wires operators into one lazy plan per output and writes
results to the given root; the driver only sees small reports.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import features, prep, profile, quality
from ..session import materialize
from ..sources import store


def prepare(raw: DataFrame, root: str, domain: str, dataset: str, min_ratings: int = 10,
            test_size: float = 0.2, force: bool = False) -> DataFrame:
    """S -> F1 -> W3 -> P7 -> S9 (reuse unless forced) -> S10 features."""
    if "ts" in raw.columns:
        split = prep.time_split(prep.filter_min_ratings(raw, min_ratings), test_size)
    else:
        split = prep.hash_split(prep.filter_min_ratings(raw, min_ratings), test_size)
    split = prep.add_domain(split, domain)
    processed = store.processed_cache(split, root, domain, dataset, force)
    train, test = prep.train_test(processed)
    store.save_features(features.create_features(train.drop("domain"), test.drop("domain")), root, domain, dataset)
    return processed


def update_dataset(spark: SparkSession, root: str, main_path: str, domain: str, dataset: str,
                   batch_id: str, since_epoch: int | None, snapshot_path: str,
                   ingested_since: int | None = None, ingested_before: int | None = None) -> DataFrame:
    """V-8: stage -> validate -> merge -> new snapshot; returns the report.

    The staged batch is the new-ratings store since ``since_epoch``; the
    merge writes a new snapshot directory (the previous main table is the
    backup).  Rows that earlier batches have staged are left out.  With
    ``ingested_since`` / ``ingested_before`` a run takes what arrived in
    between: such runs share no row, so earlier batches are not read.
    """
    new = store.new_ratings(spark, root, domain, dataset, since_epoch, ingested_since, ingested_before)
    new = new.select("user_id", "item_id", "rating",
                     F.timestamp_seconds("timestamp").alias("ts"))
    if ingested_since is None or ingested_before is None:
        new = store.not_yet_staged(new, root, domain, dataset, batch_id)
    store.stage(new, root, domain, dataset, batch_id)
    staged = spark.read.parquet(f"{root}/staging").where(
        (F.col("domain") == domain) & (F.col("dataset") == dataset) & (F.col("batch_id") == batch_id)) \
        .select("user_id", "item_id", "rating", "ts")
    main = spark.read.parquet(main_path)
    stats = materialize(profile.dataset_stats(main), "stats")
    rep = materialize(quality.validation_report(staged, stats), "report")
    valid = quality.filter_invalid(staged, rep, stats)
    merged = quality.merge_ratings(main.select("user_id", "item_id", "rating", "ts"), valid)
    merged.write.mode("overwrite").parquet(snapshot_path)
    after = profile.dataset_stats(spark.read.parquet(snapshot_path))
    return rep.select("total_ratings", "invalid_count", "status").crossJoin(
        after.select(F.col("total_ratings").alias("merged_total"))).withColumn("batch_id", F.lit(batch_id))
