"""Biased matrix factorisation (M12-M13): mu + b_u + b_i + p_u . q_i.

Re-aimed for Spark: the biases are damped means computed by aggregates
(b_i = sum(r - mu) / (lambda_i + n_i), then b_u = sum(r - mu - b_i) /
(lambda_u + n_u)), and the factors come from explicit ALS fitted on the
residuals r - mu - b_u - b_i.  Same prediction form as an SGD-trained
biased MF, but every step is a distributed job.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import als as alsm
from .scoring import top_n_scores


@dataclass
class BiasedMF:
    mu: DataFrame            # one row: mu
    user_bias: DataFrame     # user_id, b_u
    item_bias: DataFrame     # item_id, b_i
    factors: alsm.FactorModel


def biases(train: DataFrame, damping_item: float = 5.0, damping_user: float = 5.0) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(mu, user_bias, item_bias): damped means, items first, then users on what items leave."""
    mu = train.agg(F.avg("rating").alias("mu"))
    t = train.crossJoin(F.broadcast(mu))
    bi = t.groupBy("item_id").agg(
        (F.sum(F.col("rating") - F.col("mu")) / (F.lit(damping_item) + F.count(F.lit(1)))).alias("b_i"))
    bu = t.join(bi, "item_id").groupBy("user_id").agg(
        (F.sum(F.col("rating") - F.col("mu") - F.col("b_i")) /
         (F.lit(damping_user) + F.count(F.lit(1)))).alias("b_u"))
    return mu, bu, bi


def residuals(train: DataFrame, mu: DataFrame, user_bias: DataFrame, item_bias: DataFrame) -> DataFrame:
    """Ratings minus what mean and biases explain."""
    return train.crossJoin(F.broadcast(mu)).join(item_bias, "item_id").join(user_bias, "user_id").select(
        "user_id", "item_id", (F.col("rating") - F.col("mu") - F.col("b_u") - F.col("b_i")).alias("rating"))


def fit(train: DataFrame, rank: int = 10, max_iter: int = 10, reg: float = 0.05,
        damping_item: float = 5.0, damping_user: float = 5.0, seed: int = 42) -> BiasedMF:
    """Biases, then explicit ALS on what they leave."""
    mu, bu, bi = biases(train, damping_item, damping_user)
    fm = alsm.fit(residuals(train, mu, bu, bi), rank=rank, max_iter=max_iter, reg=reg, implicit=False, seed=seed)
    return BiasedMF(mu, bu, bi, fm)


def mean_user(model: BiasedMF) -> DataFrame:
    """One row ``(_mp, _mbu)``: mean factors and mean bias, which stand for an unknown user."""
    mean_p = model.factors.user_factors.select(F.posexplode("features").alias("k", "x")) \
        .groupBy("k").agg(F.avg("x").alias("x")) \
        .agg(F.array_sort(F.collect_list(F.struct("k", "x"))).alias("_mp")) \
        .select(F.transform("_mp", lambda s: s["x"]).alias("_mp"))
    return mean_p.crossJoin(model.user_bias.agg(F.avg("b_u").alias("_mbu")))


def predict(model: BiasedMF, pairs: DataFrame) -> DataFrame:
    """M13 for pairs: unknown user -> mean factors and mean user bias;
    unknown item -> no prediction (row kept, prediction NULL)."""
    uf, itf = model.factors.user_factors, model.factors.item_factors
    p = (pairs.join(uf.withColumnRenamed("features", "_p"), "user_id", "left")
         .join(model.user_bias, "user_id", "left")
         .join(itf.withColumnRenamed("features", "_q"), "item_id", "left")
         .join(model.item_bias, "item_id", "left")
         .crossJoin(F.broadcast(model.mu)).crossJoin(F.broadcast(mean_user(model))))
    pu = F.coalesce(F.col("_p"), F.col("_mp"))
    dot = F.aggregate(F.zip_with(pu, "_q", lambda a, b: a * b), F.lit(0.0), lambda s, x: s + x)
    pred = F.when(F.col("_q").isNull(), F.lit(None).cast("double")).otherwise(
        F.col("mu") + F.coalesce(F.col("b_u"), F.col("_mbu")) + F.col("b_i") + dot)
    return p.withColumn("prediction", pred).drop("_p", "_q", "_mp", "_mbu", "mu", "b_u", "b_i")


def recommend(model: BiasedMF, n: int = 10, users: DataFrame | None = None,
              candidates: DataFrame | None = None) -> DataFrame:
    """M13 top-n: ranks by b_i + p_u . q_i (mu + b_u is constant per user),
    then adds mu + b_u to the reported score; seen items removed.  Unknown
    users among ``users`` get the list of the mean user.  With
    ``candidates`` only those (user, item) pairs are ranked (F8)."""
    uf = model.factors.user_factors.join(model.user_bias, "user_id", "left")
    if users is not None:
        uf = users.select("user_id").distinct().join(uf, "user_id", "left")
    uf = uf.crossJoin(F.broadcast(mean_user(model))).select(
        "user_id", F.coalesce(F.col("features").cast("array<double>"), F.col("_mp")).alias("features"),
        F.coalesce("b_u", "_mbu").alias("_bu"))
    itf = model.factors.item_factors.join(model.item_bias.withColumnRenamed("b_i", "bias"), "item_id")
    out = top_n_scores(uf, itf, n, model.factors.seen, candidates)
    return (out.join(uf.select("user_id", "_bu"), "user_id").crossJoin(F.broadcast(model.mu))
            .select("user_id", "rank", "item_id", (F.col("score") + F.col("mu") + F.col("_bu")).alias("score")))


def save(model: BiasedMF, path: str, mode: str = "overwrite") -> None:
    """Bias and factor tables to Parquet."""
    for name in ("mu", "user_bias", "item_bias"):
        getattr(model, name).write.mode(mode).parquet(f"{path}/{name}")
    model.factors.save(f"{path}/factors", mode)


def load(spark, path: str, rank: int) -> BiasedMF:
    tables = [spark.read.parquet(f"{path}/{name}") for name in ("mu", "user_bias", "item_bias")]
    return BiasedMF(*tables, alsm.FactorModel.load(spark, f"{path}/factors", rank))
