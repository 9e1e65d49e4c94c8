"""Driver tables and the interaction views derived from them.

Mapping (fixed by the test data contract):
  interactions = lineitem JOIN orders ON l_orderkey = o_orderkey
      user_id = o_custkey, item_id = l_partkey,
      rating  = 1 + floor((l_quantity - 1) / 10)   (1..5, DOUBLE),
      ts      = l_shipdate
  feedback     = events; item_id = props.$.k; click -> 3, purchase -> 5,
                 other event types are rejected (see functions.expr).

Only the columns a view needs are selected, so the Parquet scans carry a
pruned ReadSchema; filters placed on top are pushed into the scan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders",
          "lineitem", "events", "documents", "embeddings", "pages",
          "benchmark", "labels", "conversations")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if name not in TABLES:
        raise ValueError(f"unknown table {name!r}")
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def interactions(spark: SparkSession, sf_dir: str, domain: str | None = None) -> DataFrame:
    """Row-per-interaction table ``(user_id, item_id, rating, ts)``.

    Both sides are scanned with pruned columns; the join is on the order
    key (AQE picks broadcast or sort-merge from runtime sizes).
    """
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey",
                                                 "l_quantity", "l_shipdate")
    od = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    df = li.join(od, li.l_orderkey == od.o_orderkey).select(
        F.col("o_custkey").alias("user_id"),
        F.col("l_partkey").alias("item_id"),
        (F.floor((F.col("l_quantity") - 1) / 10) + 1).cast("double").alias("rating"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    if domain is not None:
        df = df.withColumn("domain", F.lit(domain))
    return df


def feedback_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw feedback events ``(event_id, user_id, item_id, interaction_type, ts)``."""
    ev = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type",
                                               "props", "ts")
    return ev.select(
        "event_id", "user_id",
        F.get_json_object("props", "$.k").cast("bigint").alias("item_id"),
        F.col("event_type").alias("interaction_type"),
        F.col("ts").cast("timestamp").alias("ts"),
    )


def item_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item attributes from ``part`` keyed by ``item_id``."""
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("item_id"), F.col("p_brand").alias("brand"),
        F.col("p_type").alias("type"), F.col("p_size").alias("size"))


def user_attributes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """User attributes from ``customer`` keyed by ``user_id``."""
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("segment"),
        F.col("c_nationkey").cast("string").alias("nation"))


def item_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Item feature vectors ``(item_id, features ARRAY<DOUBLE>)`` from embeddings."""
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("item_id"),
        F.col("embedding").cast("array<double>").alias("features"))
