"""Implicit-feedback ALS (M9-M11) on Spark ML.

Ids are mapped to dense INT indices (P15, id order) because Spark's ALS
needs integer ids below 2^31; the factor tables are joined back to the
original ids, so everything downstream keys on the user's own ids.

Note: Spark's implicit ALS uses confidence 1 + alpha * r and scales the
regularisation by the number of ratings, so hyperparameters do not carry
over one to one from other implicit-ALS libraries.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prep import dense_index
from ..session import checkpoint_dir, materialize
from .scoring import top_n_scores


#: Ratings of a block on average at most, and blocks of each side at least.
BLOCK_RATINGS, BLOCKS = 4_000_000, 10


@dataclass
class FactorModel:
    user_factors: DataFrame   # user_id, features ARRAY<FLOAT>
    item_factors: DataFrame   # item_id, features ARRAY<FLOAT>
    seen: DataFrame           # user_id, item_id
    rank: int

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Factor tables to Parquet."""
        for name in ("user_factors", "item_factors", "seen"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str, rank: int) -> "FactorModel":
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in
                     ("user_factors", "item_factors", "seen")), rank)


def indexed(train: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(train with uidx/iidx, user index, item index): dense indexes (P15), whatever the ids are."""
    ui = dense_index(train, "user_id", "uidx")
    ii = dense_index(train, "item_id", "iidx")
    return train.join(ui, "user_id").join(ii, "item_id"), ui, ii


def fit(train: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.01,
        alpha: float = 1.0, implicit: bool = True, seed: int = 42) -> FactorModel:
    """M9: ALS on (user, item, rating) — rating is the confidence when
    ``implicit``.  Duplicate (user, item) rows are summed first."""
    checkpoint_dir(train.sparkSession)
    agg = materialize(train.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating")), "als-ratings")
    t, ui, ii = indexed(agg)
    # a task holds one block with the factors that it needs
    blocks = max(BLOCKS, math.ceil(agg.count() / BLOCK_RATINGS))
    # the lineage of one iteration only, so that the shuffle files of earlier ones can go
    als = ALS(rank=rank, maxIter=max_iter, regParam=reg, alpha=alpha, implicitPrefs=implicit,
              userCol="uidx", itemCol="iidx", ratingCol="rating", seed=seed,
              numUserBlocks=blocks, numItemBlocks=blocks, coldStartStrategy="drop", checkpointInterval=1, nonnegative=False)
    m = als.fit(t)
    uf = m.userFactors.join(ui, F.col("id") == F.col("uidx")).select("user_id", "features")
    itf = m.itemFactors.join(ii, F.col("id") == F.col("iidx")).select("item_id", "features")
    return FactorModel(uf, itf, train.select("user_id", "item_id").distinct(), rank)


def recommend(model: FactorModel, n: int = 10, users: DataFrame | None = None,
              remove_seen: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """Top-n by p_u . q_i, seen items removed; unknown users -> no rows.
    With ``candidates`` only those (user, item) pairs are ranked (F8)."""
    uf = model.user_factors if users is None else model.user_factors.join(
        users.select("user_id").distinct(), "user_id", "left_semi")
    return top_n_scores(uf, model.item_factors, n, model.seen if remove_seen else None, candidates)


def normalized(factors: DataFrame, key: str) -> DataFrame:
    norm = F.sqrt(F.aggregate("features", F.lit(0.0), lambda a, x: a + x * x))
    return factors.select(key, F.transform("features", lambda x: x / norm).alias("features"))


def similar_items(model: FactorModel, n: int = 10) -> DataFrame:
    """Per item the n most cosine-similar items (query item dropped).

    Items play the "user" role of the factor scorer with unit vectors;
    the query item itself is passed as its only seen item.
    """
    unit = normalized(model.item_factors, "item_id")
    q = unit.withColumnRenamed("item_id", "user_id")
    self_pairs = unit.select(F.col("item_id").alias("user_id"), "item_id")
    out = top_n_scores(q, unit, n, self_pairs)
    return out.withColumnRenamed("user_id", "query_item_id")
