"""Top-N, nesting and popularity listings.

Top-N per group uses ``row_number`` over a window partitioned by the
group with a ``rank <= n`` filter; Spark rewrites that into a
WindowGroupLimit that already trims each map partition to n rows per
group before the shuffle, so a hot user never ships all its candidates.
Scores are ordered at 1e-9 precision (``SCORE_DIGITS``) with the item id
as tie-break, which makes the order independent of floating-point
summation order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.expr import stable_hash

SCORE_DIGITS = 9


def top_n(df: DataFrame, n: int, group: str | list[str] = "user_id", score: str = "score",
          tie: str = "item_id", rank: str = "rank") -> DataFrame:
    """Best ``n`` rows per ``group`` by score desc, ``tie`` asc."""
    w = Window.partitionBy(*([group] if isinstance(group, str) else group)).orderBy(F.round(F.col(score), SCORE_DIGITS).desc(), F.col(tie).asc())
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= n)


def nest_recommendations(recs: DataFrame, users: DataFrame | None = None,
                         reason: str = "model", key: str = "user_id") -> DataFrame:
    """One row per requested user with an ordered list
    ``ARRAY<STRUCT<rank, item_id, score, reason>>`` and a status
    (``ok`` / ``cold_start`` when the list is empty).  Lists are bounded
    by n, so ``collect_list`` per user is bounded too."""
    nested = recs.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(
        F.col("rank"), F.col("item_id"), F.col("score"),
        F.lit(reason).alias("reason")))).alias("recommendations"))
    if users is not None:
        nested = users.select(key).distinct().join(nested, key, "left")
    rec = F.coalesce(F.col("recommendations"), F.array().cast(nested.schema["recommendations"].dataType))
    return nested.select(key, rec.alias("recommendations"),
                         F.when(F.size(rec) == 0, F.lit("cold_start")).otherwise(F.lit("ok")).alias("status"))


def trending(df: DataFrame, n: int = 10, since=None, ts: str = "ts") -> DataFrame:
    """Top ``n`` items by interaction count; score = mean rating."""
    if since is not None:
        df = df.where(F.col(ts) >= F.lit(since))
    agg = df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_interactions"),
                                    F.avg("rating").alias("score"))
    return agg.orderBy(F.col("n_interactions").desc(), F.col("item_id").asc()).limit(n)


def most_active_users(df: DataFrame, n: int = 10) -> DataFrame:
    """Top ``n`` users by number of ratings (TakeOrdered)."""
    agg = df.groupBy("user_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    return agg.orderBy(F.col("n_ratings").desc(), F.col("user_id").asc()).limit(n)


def most_popular_items(df: DataFrame, n: int = 20) -> DataFrame:
    """Top ``n`` items by number of ratings."""
    agg = df.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_ratings"))
    return agg.orderBy(F.col("n_ratings").desc(), F.col("item_id").asc()).limit(n)


def hash_sample(df: DataFrame, n: int | None, key: str = "user_id", seed: int = 0) -> DataFrame:
    """Deterministic sample of ``n`` distinct keys (all when None):
    order by ``stable_hash(key, seed)`` and take n (TakeOrdered, bounded)."""
    keys = df.select(key).distinct()
    if n is None:
        return keys
    return (keys.withColumn("_h", stable_hash(key, seed=seed))
            .orderBy("_h", key).limit(n).drop("_h"))


def random_similar_fallback(items: DataFrame, query_items: DataFrame, n: int = 10,
                            seed: int = 0) -> DataFrame:
    """Fallback neighbours for items without a similarity list.

    Candidates are the first ``n + 1`` items in ``stable_hash(item, seed)``
    order (a TakeOrdered, so a proven bound of n + 1 rows that is then
    broadcast); per query item its own id is dropped and the first n kept,
    with pseudo-similarity max(0.1, 0.9 - 0.1 * i) for the i-th (0-based)
    pick, flagged ``is_fallback``.
    """
    cands = (items.select("item_id").distinct()
             .withColumn("_h", stable_hash("item_id", seed=seed))
             .orderBy("_h", "item_id").limit(n + 1)
             .withColumn("_o", F.row_number().over(Window.orderBy("_h", "item_id"))))
    q = query_items.select(F.col("item_id").alias("query_item_id")).distinct()
    pairs = q.join(F.broadcast(cands), F.col("query_item_id") != F.col("item_id"))
    w = Window.partitionBy("query_item_id").orderBy("_o")
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("query_item_id", "rank", "item_id",
                      F.greatest(F.lit(0.1), F.lit(0.9) - F.lit(0.1) * (F.col("rank") - 1)).alias("score"),
                      F.lit(True).alias("is_fallback"))
