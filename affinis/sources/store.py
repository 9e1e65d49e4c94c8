"""Ratings store, staging, processed/feature caches and report sinks
(S9-S16, F2, F3, P10).

Layout (all Parquet, partition columns in the path):
  <root>/new/domain=../dataset=../ingest_date=../      appended new ratings, by day of arrival
  <root>/staging/domain=../dataset=../batch_id=../     staged batches
  <root>/processed/domain=../dataset=../split=../      processed split
  <root>/features/domain=../dataset=../table=../       feature tables
Partition pruning turns "this domain / dataset / since" into directory
selection; writes are idempotent per partition (dynamic overwrite).
"""

from __future__ import annotations

import time

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MAX_RECORDS_PER_FILE = 1_000_000  # replaces the 10 MB file rotation


def _exists(spark: SparkSession, path: str) -> bool:
    try:
        spark.read.text(path)
        return True
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return False


def validate_batch(df: DataFrame, now_epoch: int) -> DataFrame:
    """P10: drop rows lacking user/item/rating; default timestamp and source."""
    return (df.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull() & F.col("rating").isNotNull())
            .withColumn("timestamp", F.coalesce(F.col("timestamp").cast("bigint"), F.lit(now_epoch)))
            .withColumn("source", F.coalesce(F.col("source"), F.lit("explicit"))))


def append_ratings(df: DataFrame, root: str, domain: str, dataset: str, now_epoch: int | None = None) -> None:
    """Append (one or many) ratings that come in now.

    ``ingest_epoch`` is the time of the append and ``ingest_date`` its day,
    whatever the time of the event: a late rating of an old event lies in
    today's folder, where the next update looks for it.
    """
    now = int(time.time()) if now_epoch is None else now_epoch
    out = (df.withColumn("domain", F.lit(domain)).withColumn("dataset", F.lit(dataset))
           .withColumn("ingest_epoch", F.lit(now).cast("bigint"))
           .withColumn("ingest_date", F.to_date(F.timestamp_seconds(F.col("ingest_epoch")))))
    (out.write.mode("append").option("maxRecordsPerFile", MAX_RECORDS_PER_FILE)
     .partitionBy("domain", "dataset", "ingest_date").parquet(f"{root}/new"))


def new_ratings(spark: SparkSession, root: str, domain: str, dataset: str,
                since_epoch: int | None = None, ingested_since: int | None = None,
                ingested_before: int | None = None) -> DataFrame:
    """new ratings of a domain/dataset.

    ``since_epoch`` is a cut-off on the event; ``ingested_since`` (from,
    inclusive) and ``ingested_before`` (to, exclusive) are cut-offs on the
    arrival, whose day filter prunes directories.  Runs that take turns
    over arrival times see every rating once.
    """
    df = spark.read.parquet(f"{root}/new").where((F.col("domain") == domain) & (F.col("dataset") == dataset))
    day = lambda epoch: F.to_date(F.timestamp_seconds(F.lit(epoch)))
    if since_epoch is not None:
        df = df.where(F.col("timestamp") >= since_epoch)
    if ingested_since is not None:
        df = df.where((F.col("ingest_date") >= day(ingested_since)) & (F.col("ingest_epoch") >= ingested_since))
    if ingested_before is not None:
        df = df.where((F.col("ingest_date") <= day(ingested_before)) & (F.col("ingest_epoch") < ingested_before))
    return df


def purge_before(spark: SparkSession, root: str, domain: str, dataset: str,
                 before_epoch: int, dest: str) -> tuple[DataFrame, int]:
    """a new snapshot at ``dest`` without rows ``timestamp < before``;
    returns (snapshot, removed count).  The old snapshot stays until the
    caller swaps the pointer (no in-place delete)."""
    cur = new_ratings(spark, root, domain, dataset)
    removed = cur.where(F.col("timestamp") < before_epoch).count()
    keep = cur.where(F.col("timestamp") >= before_epoch)
    keep.write.mode("overwrite").partitionBy("domain", "dataset", "ingest_date").parquet(dest)
    return spark.read.parquet(dest), removed


def stage(df: DataFrame, root: str, domain: str, dataset: str, batch_id: str) -> str:
    """Write a staged batch under batch_id=...; re-running the same
    batch id overwrites only that partition (idempotent)."""
    (df.withColumn("domain", F.lit(domain)).withColumn("dataset", F.lit(dataset))
     .withColumn("batch_id", F.lit(batch_id))
     .write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
     .partitionBy("domain", "dataset", "batch_id").parquet(f"{root}/staging"))
    return batch_id


def purge_staged(spark: SparkSession, root: str, domain: str, dataset: str, batch_id: str, dest: str) -> tuple[DataFrame, int]:
    """Purge by batch: a new snapshot of the new ratings at ``dest`` without
    the rows that the batch has staged (as a multiset); (snapshot, removed
    count).  The old snapshot stays until the caller swaps the pointer."""
    staged = spark.read.parquet(f"{root}/staging").where(
        (F.col("domain") == domain) & (F.col("dataset") == dataset) & (F.col("batch_id") == batch_id)) \
        .select("user_id", "item_id", "rating", F.unix_seconds("ts").alias("timestamp"))
    cur = new_ratings(spark, root, domain, dataset)
    key = ["user_id", "item_id", "rating", "timestamp"]
    # the k-th equal row of the store against the k-th of the batch
    nth = F.row_number().over(Window.partitionBy(*key).orderBy("ingest_epoch"))
    gone = staged.groupBy(*[F.col(c).alias(f"_{c}") for c in key]).agg(F.count(F.lit(1)).alias("_n"))
    same = F.lit(True)
    for c in key:
        same = same & F.col(c).eqNullSafe(F.col(f"_{c}"))
    keep = cur.withColumn("_nth", nth).join(gone, same & (F.col("_nth") <= F.col("_n")), "left_anti").drop("_nth")
    keep.write.mode("overwrite").partitionBy("domain", "dataset", "ingest_date").parquet(dest)
    kept = spark.read.parquet(dest)
    return kept, cur.count() - kept.count()


def not_yet_staged(df: DataFrame, root: str, domain: str, dataset: str, batch_id: str) -> DataFrame:
    """V-8 purge: rows of ``df`` that no other batch has staged (counted as a
    multiset).  Nothing is deleted, so a batch can be run again."""
    spark = df.sparkSession
    if not _exists(spark, f"{root}/staging"):
        return df
    done = spark.read.parquet(f"{root}/staging").where(
        (F.col("domain") == domain) & (F.col("dataset") == dataset) & (F.col("batch_id") != batch_id))
    return df.exceptAll(done.select(*df.columns))


def newest_staged(spark: SparkSession, root: str, domain: str, dataset: str) -> DataFrame:
    """V-6 input: rows of the newest batch_id of a domain/dataset."""
    st = spark.read.parquet(f"{root}/staging").where(
        (F.col("domain") == domain) & (F.col("dataset") == dataset))
    newest = st.agg(F.max("batch_id").alias("batch_id"))
    return st.join(F.broadcast(newest), "batch_id")


def processed_cache(df_split: DataFrame, root: str, domain: str, dataset: str,
                    force: bool = False) -> DataFrame:
    """Processed split, reused when its _SUCCESS marker exists."""
    spark = df_split.sparkSession
    path = f"{root}/processed/domain={domain}/dataset={dataset}"
    if force or not _exists(spark, f"{path}/_SUCCESS"):
        df_split.write.mode("overwrite").partitionBy("split").parquet(path)
    return spark.read.parquet(path)


def save_features(tables: dict[str, DataFrame], root: str, domain: str, dataset: str) -> None:
    """Feature tables to Parquet."""
    for name, df in tables.items():
        df.write.mode("overwrite").parquet(f"{root}/features/domain={domain}/dataset={dataset}/table={name}")


def load_features(spark: SparkSession, root: str, domain: str, dataset: str,
                  names=("user_features", "item_features", "interaction_features")) -> dict[str, DataFrame]:
    return {n: spark.read.parquet(f"{root}/features/domain={domain}/dataset={dataset}/table={n}")
            for n in names}


def write_report(df: DataFrame, path: str, mode: str = "append") -> None:
    """Report rows (validation, stats, tuning, profile) as JSON lines."""
    df.write.mode(mode).json(path)


def inventory(layers: dict[str, DataFrame]) -> DataFrame:
    """Row counts per (domain, dataset, layer) over the given tables."""
    parts = [df.select("domain", "dataset").withColumn("layer", F.lit(name)) for name, df in layers.items()]
    allp = parts[0]
    for p in parts[1:]:
        allp = allp.unionByName(p)
    return allp.groupBy("domain", "dataset", "layer").agg(F.count(F.lit(1)).alias("n_rows"))
