"""Rule-based model scores, model choice, tuning summaries (X2, X3, A23,
A24, P16, P18, P19, W6).

All inputs are DataFrames (profile row, metrics/tuning tables); the
outputs are DataFrames.  Nothing loops over rows on the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Rule weights per algorithm (criterion -> points).
MODEL_PRIORITIES = {
    "als": {"large_sparse": 10, "implicit_feedback": 8, "extreme_sparsity": 9,
            "balanced_distribution": 7},
    "svd": {"explicit_feedback": 10, "small_dataset": 9, "dense_interactions": 8,
            "balanced_distribution": 6},
    "lightfm": {"long_tail": 10, "hybrid_data": 9, "cold_start_potential": 8,
                "feature_rich": 7},
    "sar": {"time_series": 10, "session_based": 9, "high_temporal_dynamics": 8,
            "item_similarity_focused": 7},
    "baseline": {"cold_start": 10, "very_small_dataset": 9, "new_system": 8,
                 "popularity_driven": 7},
}
MODEL_ORDER = ("als", "svd", "lightfm", "sar", "baseline")

# Default hyperparameters per chosen algorithm.  Values in
# a pair are (implicit feedback, explicit feedback) or, for use_timedecay,
# (temporal data, no temporal data).
DEFAULT_HYPERPARAMETERS = {
    "als": {"factors": "100", "regularization": "0.01", "iterations": "15",
            "alpha": ("40.0", "1.0")},
    "svd": {"n_factors": "100", "n_epochs": "20", "lr_all": "0.005", "reg_all": "0.02"},
    "lightfm": {"no_components": "64", "loss": ("bpr", "warp"), "learning_rate": "0.05",
                "item_alpha": "0.001", "user_alpha": "0.001", "epochs": "20"},
    "sar": {"similarity_type": "jaccard", "time_decay_coefficient": "30",
            "use_timedecay": ("true", "false"), "remove_seen": "true"},
    "baseline": {"recommendation_strategy": "popularity", "remove_seen": "true"},
}


def _pts(cond, model: str, crit: str):
    return F.when(cond, F.lit(MODEL_PRIORITIES[model][crit])).otherwise(F.lit(0))


def model_scores(profile: DataFrame) -> DataFrame:
    """``(model, score)`` from the one-row profile (five rows)."""
    c = F.col
    gini = c("item_popularity_gini")
    has_uf, has_if = c("num_user_features") > 0, c("num_item_features") > 0
    cold = (c("cold_start_ratio_users") > 0.1) | (c("cold_start_ratio_items") > 0.1)
    balanced = F.abs(gini - 0.5) < 0.3
    avg_gap = F.coalesce(c("avg_time_between_interactions"), F.lit(float("inf"))) \
        if "avg_time_between_interactions" in profile.columns else F.lit(float("inf"))
    tstd = F.coalesce(c("temporal_interaction_std"), F.lit(0.0)) \
        if "temporal_interaction_std" in profile.columns else F.lit(0.0)
    scores = {
        "als": _pts((c("num_interactions") > 100000) & (c("sparsity") > 0.995), "als", "large_sparse")
        + _pts(c("implicit_feedback"), "als", "implicit_feedback")
        + _pts(c("sparsity") > 0.999, "als", "extreme_sparsity")
        + _pts(balanced, "als", "balanced_distribution"),
        "svd": _pts(c("explicit_ratings"), "svd", "explicit_feedback")
        + _pts(c("num_interactions") < 50000, "svd", "small_dataset")
        + _pts(c("sparsity") < 0.98, "svd", "dense_interactions")
        + _pts(balanced, "svd", "balanced_distribution"),
        "lightfm": _pts(gini > 0.8, "lightfm", "long_tail")
        + _pts(has_uf | has_if, "lightfm", "hybrid_data")
        + _pts(cold, "lightfm", "cold_start_potential")
        + _pts((has_uf & has_if) | (c("num_item_features") > 5), "lightfm", "feature_rich"),
        "sar": _pts(c("has_temporal_data"), "sar", "time_series")
        + _pts(avg_gap < 3600, "sar", "session_based")
        + _pts(tstd > 86400, "sar", "high_temporal_dynamics")
        + _pts(c("avg_items_per_user") < 10, "sar", "item_similarity_focused"),
        "baseline": _pts(cold, "baseline", "cold_start")
        + _pts(c("num_interactions") < 1000, "baseline", "very_small_dataset")
        + _pts(c("num_users") < 100, "baseline", "new_system")
        + _pts(gini > 0.9, "baseline", "popularity_driven"),
    }
    wide = profile.select(*[v.cast("bigint").alias(k) for k, v in scores.items()])
    return wide.unpivot([], list(MODEL_ORDER), "model", "score")


def select_model(scores: DataFrame, tuning: DataFrame | None = None,
                 metric: str = "map_at_k", profile: DataFrame | None = None) -> DataFrame:
    """Choose an algorithm.

    With tuning results ``(model, metric, value[, hyperparameters])``: best value of
    ``metric`` (lower is better for rmse/mae), falling back through
    map_at_k, coverage, novelty, diversity.  Otherwise the highest rule
    score, ties broken in the order als, svd, lightfm, sar, baseline.
    Returns one row ``(model, reason, hyperparameters MAP)``: the tuned
    parameters of a tuned choice, else the model's defaults.
    """
    order = F.create_map(*[x for i, m in enumerate(MODEL_ORDER) for x in (F.lit(m), F.lit(i))])
    by_rule = scores.withColumn("_o", order[F.col("model")]).withColumn(
        "_p", F.lit(99)).select("model", F.lit("rule_score").alias("reason"),
                               F.col("score").cast("double").alias("_v"), "_p", "_o",
                               F.lit(None).cast("map<string,string>").alias("_tuned"))
    cands = by_rule
    if tuning is not None:
        chain = [metric] + [m for m in ("map_at_k", "coverage", "novelty", "diversity") if m != metric]
        prio = F.create_map(*[x for i, m in enumerate(chain) for x in (F.lit(m), F.lit(i))])
        t = tuning.where(F.col("metric").isin(*chain)).withColumn("_p", prio[F.col("metric")])
        lower = F.col("metric").isin("rmse", "mae")
        t = t.select("model", F.concat(F.lit("tuned_"), F.col("metric")).alias("reason"),
                     F.when(lower, -F.col("value")).otherwise(F.col("value")).alias("_v"), "_p",
                     order[F.col("model")].alias("_o"),
                     (F.col("hyperparameters") if "hyperparameters" in t.columns
                      else F.lit(None).cast("map<string,string>")).alias("_tuned"))
        cands = by_rule.unionByName(t)
    w = Window.orderBy(F.col("_p").asc(), F.col("_v").desc(), F.col("_o").asc())
    best = cands.withColumn("_r", F.row_number().over(w)).where(F.col("_r") == 1)
    if profile is not None:
        flags = profile.select(F.col("implicit_feedback").alias("_imp"),
                               F.col("has_temporal_data").alias("_tmp"))
    else:
        flags = scores.sparkSession.range(1).select(F.lit(False).alias("_imp"), F.lit(False).alias("_tmp"))
    best = best.crossJoin(F.broadcast(flags))

    def val(k, v):
        if isinstance(v, tuple):
            flag = F.col("_tmp") if k == "use_timedecay" else F.col("_imp")
            return F.when(flag, F.lit(v[0])).otherwise(F.lit(v[1]))
        return F.lit(v)
    defaults = F.create_map(*[x for m in MODEL_ORDER for x in (
        F.lit(m), F.create_map(*[y for k, v in DEFAULT_HYPERPARAMETERS[m].items()
                                 for y in (F.lit(k), val(k, v))]))])
    return best.select("model", "reason", F.coalesce("_tuned", defaults[F.col("model")]).alias("hyperparameters"))


def latest_versions(metrics: DataFrame, n: int = 10, group=("algorithm",),
                    version: str = "version") -> DataFrame:
    """Newest ``n`` versions per algorithm, version compared as a
    number (``rank`` 1 = latest)."""
    w = Window.partitionBy(*group).orderBy(F.col(version).cast("double").desc(), F.col("timestamp").desc())
    return metrics.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)


def tuning_summary(results: DataFrame, params: list[str], metric: str, n: int = 10) -> DataFrame:
    """Mean metric per parameter combination, top ``n``."""
    return (results.groupBy(*params).agg(F.avg(metric).alias(f"mean_{metric}"))
            .orderBy(F.col(f"mean_{metric}").desc(), *params).limit(n))


def metric_spread(results: DataFrame, param: str, metric: str) -> DataFrame:
    """Min / quartiles / max of ``metric`` per value of ``param``."""
    return results.groupBy(param).agg(
        F.percentile(metric, F.array(*[F.lit(q) for q in (0.0, 0.25, 0.5, 0.75, 1.0)])).alias("_q")
    ).select(param, *[F.col("_q")[i].alias(nm) for i, nm in enumerate(("min", "q1", "median", "q3", "max"))])


def normalise_metrics(df: DataFrame, metrics: list[str], time_col: str | None = "training_time") -> DataFrame:
    """Divide each metric by its column max; training time becomes
    1 - t / max(t) (faster is better)."""
    mx = df.agg(*[F.max(m).alias(f"_mx_{m}") for m in metrics + ([time_col] if time_col else [])])
    out = df.crossJoin(F.broadcast(mx))
    for m in metrics:
        out = out.withColumn(m, F.when(F.col(f"_mx_{m}") != 0, F.col(m) / F.col(f"_mx_{m}")).otherwise(0.0))
    if time_col:
        out = out.withColumn(time_col, F.when(F.col(f"_mx_{time_col}") != 0,
                                              1 - F.col(time_col) / F.col(f"_mx_{time_col}")).otherwise(0.0))
    return out.drop(*[c for c in out.columns if c.startswith("_mx_")])


def wide_to_long(df: DataFrame, ids: list[str], values: list[str],
                 var: str = "metric", val: str = "value") -> DataFrame:
    """Unpivot metric columns."""
    return df.unpivot(ids, values, var, val)


def pivot_metric(results: DataFrame, row: str, column: str, metric: str,
                 per: str | None = None) -> DataFrame:
    """``row`` x ``column`` grid of ``metric`` (first value), per ``per``."""
    keys = [per, row] if per else [row]
    return results.groupBy(*keys).pivot(column).agg(F.first(metric))
