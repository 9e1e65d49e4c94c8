"""Popularity baseline (M1-M3) and user-mean predictor (M2).

Fitted state = DataFrames: item popularity with a global rank, user
means, the global mean and the seen (user, item) table.

Top-N minus seen (M1) is exact without a candidate cap: see ``recommend``.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators.prep import global_row_number


@dataclass
class PopularityModel:
    popularity: DataFrame   # item_id, popularity_score, prank (1-based)
    user_means: DataFrame   # user_id, mean_rating
    global_mean: DataFrame  # one row: global_mean
    seen: DataFrame         # user_id, item_id (distinct)

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Model tables to Parquet under ``path``."""
        for name in ("popularity", "user_means", "global_mean", "seen"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "PopularityModel":
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in
                     ("popularity", "user_means", "global_mean", "seen")))


def item_popularity(train: DataFrame) -> DataFrame:
    """Rows per item, with a dense 1-based rank (count desc, id asc)."""
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("popularity_score"))
    ranked = global_row_number(pop, [F.col("popularity_score").desc(), F.col("item_id").asc()], "prank")
    return ranked.withColumn("prank", F.col("prank") + 1)


def fit(train: DataFrame) -> PopularityModel:
    return PopularityModel(
        popularity=item_popularity(train),
        user_means=train.groupBy("user_id").agg(F.avg("rating").alias("mean_rating")),
        global_mean=train.agg(F.avg("rating").alias("global_mean")),
        seen=train.select("user_id", "item_id").distinct(),
    )


def unseen_ranks(ranks: DataFrame, users: DataFrame, n: int, total: int) -> DataFrame:
    """``(user_id, rank, prank)``: the first ``n`` ranks of 1..total that a user has not seen.

    ``ranks(user_id, prank)`` are the seen ranks.  Between the (k-1)-th and
    the k-th seen rank lies a gap, before which ``prank - k`` ranks of the
    gap's left end are unseen; only gaps that begin before the n-th unseen
    rank are opened, so every user yields at most ``n`` rows however long
    the history is.
    """
    by_rank = Window.partitionBy("user_id").orderBy("prank")
    before = F.lag("prank", 1, 0).over(by_rank)
    gaps = ranks.select("user_id", before.alias("_left"), (F.col("prank") - 1).alias("_right"),
                        (before - (F.row_number().over(by_rank) - 1)).alias("_done"))
    last = ranks.groupBy("user_id").agg(F.max("prank").alias("_max"), F.count(F.lit(1)).alias("_h"))
    tail = users.join(last, "user_id", "left").select(
        "user_id", F.coalesce("_max", F.lit(0)).alias("_left"), F.lit(total).cast("bigint").alias("_right"),
        (F.coalesce("_max", F.lit(0)) - F.coalesce("_h", F.lit(0))).alias("_done"))
    opened = gaps.join(users, "user_id", "left_semi").unionByName(tail) \
        .withColumn("_to", F.least(F.col("_right"), F.col("_left") + F.lit(n) - F.col("_done"))) \
        .where((F.col("_done") < n) & (F.col("_to") > F.col("_left")))
    return opened.select("user_id", "_left", "_done", F.explode(F.sequence(F.col("_left") + 1, F.col("_to"))).alias("prank")) \
        .select("user_id", (F.col("_done") + F.col("prank") - F.col("_left")).cast("int").alias("rank"), "prank")


def recommend(model: PopularityModel, users: DataFrame | None = None, n: int = 10,
              remove_seen: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """M1: ``(user_id, rank, item_id, score)``; score = popularity count.

    Exact: the first n unseen popularity ranks of every user, found from
    the gaps between the seen ranks.  With ``candidates`` the best n of
    those (user, item) pairs (F8).
    """
    pop = model.popularity
    users = (model.seen.select("user_id") if users is None else users.select("user_id")).distinct()
    score = F.col("popularity_score").cast("double").alias("score")
    if candidates is not None:
        pairs = candidates.select("user_id", "item_id").distinct().join(users, "user_id", "left_semi")
        if remove_seen:
            pairs = pairs.join(model.seen, ["user_id", "item_id"], "left_anti")
        ranked = pairs.join(pop, "item_id").withColumn(
            "rank", F.row_number().over(Window.partitionBy("user_id").orderBy("prank")))
        return ranked.where(F.col("rank") <= n).select("user_id", "rank", "item_id", score)
    seen = model.seen.join(pop.select("item_id", "prank"), "item_id").select("user_id", "prank")
    ranks = unseen_ranks(seen if remove_seen else seen.where(F.lit(False)), users, n, pop.count())
    return ranks.join(pop, "prank").select("user_id", "rank", "item_id", score)


def predict_user_mean(model: PopularityModel, pairs: DataFrame, unknown_item: str = "omit") -> DataFrame:
    """M2: score = user mean, unknown user -> global mean.

    ``unknown_item='omit'`` drops pairs whose item is not in the model
    (predict path); ``'global_mean'`` scores them with the global mean
    (evaluation path of the reference).
    """
    known_items = model.popularity.select("item_id")
    p = pairs.join(model.user_means, "user_id", "left").crossJoin(F.broadcast(model.global_mean))
    if unknown_item == "omit":
        p = p.join(known_items, "item_id", "left_semi")
        score = F.coalesce(F.col("mean_rating"), F.col("global_mean"))
    else:
        p = p.join(known_items.withColumn("_known", F.lit(True)), "item_id", "left")
        score = F.when(F.col("_known").isNull(), F.col("global_mean")).otherwise(
            F.coalesce(F.col("mean_rating"), F.col("global_mean")))
    return p.withColumn("prediction", score).drop("mean_rating", "global_mean", "_known")


def similar_items(model: PopularityModel, items: DataFrame | None = None, n: int = 10) -> DataFrame:
    """M3: per query item, the ``n`` most popular other items.

    Candidates are the top ``n + 1`` ranks (a parameter bound, broadcast);
    dropping the query item leaves at least n.
    """
    q = (model.popularity if items is None else items).select(
        F.col("item_id").alias("query_item_id")).distinct()
    top = F.broadcast(model.popularity.where(F.col("prank") <= n + 1))
    pairs = q.join(top, F.col("query_item_id") != F.col("item_id"))
    w = Window.partitionBy("query_item_id").orderBy("prank")
    out = pairs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    return out.select("query_item_id", "rank", "item_id",
                      F.col("popularity_score").cast("double").alias("score"))
