"""Train / evaluate / tune jobs (X5, X6, X7) and model-version tables.

Every fit and evaluation is a distributed Spark job over the (written)
train and test tables; only one metric row per fit reaches the driver.
The factorisations are fitted and scored for all points of a grid in one
pass (``models.grid_mf``), co-occurrence lists of all points made in one
(``cooccurrence.recommend_points``).  The points of other models may run
concurrently from a small thread pool (each thread submits its own jobs;
use FAIR scheduling on a shared cluster).
"""

from __future__ import annotations

import time
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..models import als, biased_mf, fm, grid_mf, hybrid
from ..models import cooccurrence as cooc
from ..models import popularity as popm
from ..operators import metrics, profile, selection
from ..session import materialize

METRIC_COLS = ["precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k", "coverage", "novelty", "diversity"]

# The tuning grids.
GRIDS = {
    "als": {"factors": [50, 100, 150], "regularization": [0.01, 0.1, 0.5], "alpha": [1.0, 10.0, 40.0],
            "iterations": [15]},
    "svd": {"n_factors": [50, 100, 150], "n_epochs": [15, 20, 25], "lr_all": [0.002, 0.005, 0.01],
            "reg_all": [0.01, 0.02, 0.05]},
    "lightfm": {"no_components": [32, 64], "loss": ["warp", "bpr"], "learning_rate": [0.05, 0.1],
                "item_alpha": [0.0001, 0.001], "user_alpha": [0.0001, 0.001], "epochs": [20]},
    "sar": {"similarity_type": ["jaccard", "lift", "counts"], "time_decay_coefficient": [7, 30, 90],
            "use_timedecay": [True, False], "remove_seen": [True, False]},
    "baseline": {"recommendation_strategy": ["popularity", "user_mean"], "remove_seen": [True, False]},
}
# Fixed value: without decay its coefficient has no effect; this one stands for all.
GRID_RULES = {"sar": "use_timedecay OR time_decay_coefficient = 30"}

# Grid parameters without a counterpart in Spark: explicit ALS has no learning rate, and the machine
# one loss (logistic) and no penalty per side.  Their values are no points of their own.
NO_COUNTERPART = {"svd": ("lr_all",), "lightfm": ("loss", "item_alpha", "user_alpha")}


def grid(spark: SparkSession, model: str) -> DataFrame:
    """The parameter points of a model, one row each."""
    points = spark.range(1).select()
    for name, values in GRIDS[model].items():
        points = points.crossJoin(spark.range(1).select(F.explode(F.array(*map(F.lit, values))).alias(name)))
    return points.where(GRID_RULES.get(model, "true"))


def tuned_params(model: str) -> list[str]:
    """The grid parameters that a fit in Spark honours."""
    return [p for p in GRIDS[model] if p not in NO_COUNTERPART.get(model, ())]


def grid_points(spark: SparkSession, model: str) -> list[dict]:
    """The points of the grid that differ in an honoured parameter."""
    return [r.asDict() for r in grid(spark, model).select(*tuned_params(model)).distinct()
            .orderBy(*tuned_params(model)).collect()]


def evaluate_points(recs: DataFrame, train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """One metric row per value of ``point``, all in one pass; as ``evaluate`` for each."""
    by = ("point",)
    ranked = metrics.ranking_metrics(recs, test, k, by=by).drop("n_users")
    return metrics.beyond_accuracy(recs, train, by=by).join(ranked, "point", "left").fillna(0.0, METRIC_COLS)


def evaluate(recs: DataFrame, train: DataFrame, test: DataFrame, k: int = 10) -> DataFrame:
    """One metric row: E1-E4 (default variants) + E5, E6, E8."""
    return metrics.ranking_metrics(recs, test, k).drop("n_users").crossJoin(
        metrics.beyond_accuracy(recs, train))


def _model_name(sim: str) -> str:
    # the reference's "lift" branch computes cosine (see models.cooccurrence)
    return {"lift": "cosine"}.get(sim, sim)


#: Attribute tables keyed by user_id and by item_id; only the hybrid model fits them.
Features = tuple[DataFrame | None, DataFrame | None]
NO_FEATURES: Features = (None, None)


def _number(params: dict, name: str, default: float) -> float:
    return float(params.get(name, default))


def _flag(params: dict, name: str) -> bool:
    return str(params.get(name, "true")).lower() == "true"


def _popularity(train: DataFrame, k: int, params: dict, features: Features = NO_FEATURES,
                model: popm.PopularityModel | None = None) -> DataFrame:
    strategy = params.get("recommendation_strategy", "popularity")
    if strategy not in GRIDS["baseline"]["recommendation_strategy"]:
        raise ValueError(f"unknown recommendation_strategy {strategy!r}")
    m = model or popm.fit(train)
    if strategy == "user_mean":
        # as in the reference: the most popular items, seen or not, scored by the user's mean
        return popm.recommend(m, n=k, remove_seen=False).join(m.user_means, "user_id").select(
            "user_id", "rank", "item_id", F.col("mean_rating").alias("score"))
    return popm.recommend(m, n=k, remove_seen=_flag(params, "remove_seen"))


def _cooccurrence_point(params: dict) -> tuple[str, float | None, bool]:
    """(similarity, half-life in days or None, remove_seen) of a parameter point."""
    kind = _model_name(params.get("similarity_type", "jaccard"))
    if kind not in cooc.SIMILARITIES:
        raise ValueError(kind)
    days = _number(params, "time_decay_coefficient", 30)
    return kind, days if _flag(params, "use_timedecay") else None, _flag(params, "remove_seen")


def _cooccurrence(train: DataFrame, k: int, params: dict, features: Features = NO_FEATURES) -> DataFrame:
    kind, days, remove_seen = _cooccurrence_point(params)
    m = cooc.fit(train, kind=kind, time_decay=days is not None, half_life_days=30.0 if days is None else days)
    return cooc.recommend(m, n=k, remove_seen=remove_seen)


def _als(train: DataFrame, k: int, params: dict, features: Features = NO_FEATURES) -> DataFrame:
    return als.recommend(als.fit(train, rank=int(_number(params, "factors", 10)),
                                 max_iter=int(_number(params, "iterations", 10)),
                                 reg=_number(params, "regularization", 0.01), alpha=_number(params, "alpha", 1.0)), k)


def _biased_mf(train: DataFrame, k: int, params: dict, features: Features = NO_FEATURES) -> DataFrame:
    return biased_mf.recommend(biased_mf.fit(train, rank=int(_number(params, "n_factors", 10)),
                                             max_iter=int(_number(params, "n_epochs", 10)),
                                             reg=_number(params, "reg_all", 0.05)), k)


def _columns(table: DataFrame | None, key: str) -> list[str]:
    return [c for c in table.columns if c != key] if table is not None else []


def _attributes(features: Features) -> tuple:
    users, items = features
    return users, _columns(users, "user_id"), items, _columns(items, "item_id")


def _hybrid(train: DataFrame, k: int, params: dict, features: Features = NO_FEATURES,
            pairs: fm.Pairs | None = None) -> DataFrame:
    return hybrid.recommend(hybrid.fit(train, *_attributes(features), factor_size=int(_number(params, "no_components", 8)),
                                       max_iter=int(_number(params, "epochs", 30)),
                                       step=_number(params, "learning_rate", 0.05), pairs=pairs), k)


#: Fit and list functions by model name (both names of a model work).
LISTS = {"popularity": _popularity, "baseline": _popularity, "cooccurrence": _cooccurrence, "sar": _cooccurrence,
         "als": _als, "biased_mf": _biased_mf, "svd": _biased_mf, "hybrid": _hybrid, "lightfm": _hybrid}


def _result_rows(spark: SparkSession, model: str, rows: list[dict]) -> DataFrame:
    """Result table of a grid: parameters, metrics, time, error."""
    names = tuned_params(model)
    kinds = grid(spark, model).select(*names).schema
    schema = ", ".join([f"{f.name} {f.dataType.simpleString()}" for f in kinds]
                       + [f"{c} double" for c in METRIC_COLS] + ["total_time double", "error string"])
    return spark.createDataFrame(
        [tuple(r[c] for c in [*names, *METRIC_COLS, "total_time", "error"]) for r in rows], schema)


def fit_grid(model: str, train: DataFrame, test: DataFrame, points: list[dict], k: int = 10,
             stop_at: tuple[int, ...] = (), metric: str = "map_at_k") -> DataFrame:
    """Lists of all users at every point of a factorisation grid, ``point`` the place in ``points``.

    One run for all points.  At the iterations ``stop_at`` the worse half
    of the points of a rank stops; it is judged by ``metric`` on a sample of users
    that doubles each time and ends with half of them.  The lists that
    are returned are those of all users, from a point's last iteration.
    """
    if model == "als":
        grid_of = [grid_mf.Point(int(_number(p, "factors", 10)), _number(p, "regularization", 0.01),
                                 _number(p, "alpha", 1.0), int(_number(p, "iterations", 10))) for p in points]
        ratings, item_bias = train, None
    else:
        grid_of = [grid_mf.Point(int(_number(p, "n_factors", 10)), _number(p, "reg_all", 0.05), 1.0,
                                 int(_number(p, "n_epochs", 10))) for p in points]
        known = tuple(materialize(b, "grid-biases") for b in biased_mf.biases(train))
        ratings, item_bias = biased_mf.residuals(train, *known), known[2]
    seen = train.select("user_id", "item_id")

    def judge(m: grid_mf.GridModel, at: list[int], nth: int) -> dict[int, float]:
        part = 1 << (len(stop_at) - nth)
        users = m.user_index.where(F.pmod(F.xxhash64("user_id"), F.lit(part)) == 0)
        recs = materialize(grid_mf.top_n_points(m, seen, k, at, item_bias, users), "grid-judged")
        value = {r["point"]: r[metric] for r in evaluate_points(recs, train, test, k).collect()}
        return {p: value.get(p, 0.0) for p in at}

    m = grid_mf.fit_points(ratings, grid_of, implicit=model == "als", stop_at=stop_at, judge=judge)
    return grid_mf.top_n_points(m, seen, k, item_bias=item_bias)


def tune_factors(model: str, train: DataFrame, test: DataFrame, k: int = 10, points: list[dict] | None = None,
                 stop_at: tuple[int, ...] = ()) -> DataFrame:
    """X6 of the factorisations (als, svd): all points in one run, times shared evenly."""
    t0 = time.time()
    points = points or grid_points(train.sparkSession, model)
    recs = materialize(fit_grid(model, train, test, points, k, stop_at), "grid_recs")
    found = {r["point"]: r.asDict() for r in evaluate_points(recs, train, test, k).collect()}
    spent = (time.time() - t0) / len(points)
    zero = {c: 0.0 for c in METRIC_COLS}
    return _result_rows(train.sparkSession, model, [
        {**p, **{c: found.get(n, zero)[c] for c in METRIC_COLS}, "total_time": spent, "error": None}
        for n, p in enumerate(points)])


def tune(model: str, train: DataFrame, test: DataFrame, k: int = 10, points: list[dict] | None = None,
         parallelism: int = 4, features: Features = NO_FEATURES) -> DataFrame:
    """One result row per grid point (parameters, metrics, time, error).

    A point that fails has its error in its row; if all fail, the last
    error is raised.
    """
    if model in ("als", "svd"):
        return tune_factors(model, train, test, k, points)
    if LISTS[model] is _cooccurrence:
        return tune_cooccurrence(train, test, k, points)
    spark = train.sparkSession
    points = points or grid_points(spark, model)
    fit = LISTS[model]
    failed = []
    if fit is _hybrid:
        # the same for every point
        fit = partial(fit, pairs=hybrid.training_pairs(train, *_attributes(features)))
    if fit is _popularity:
        m = popm.fit(train)
        fit = partial(fit, model=popm.PopularityModel(*(materialize(t, "grid-popularity") for t in (
            m.popularity, m.user_means, m.global_mean, m.seen))))

    def run(n: int) -> tuple[DataFrame | None, float, str | None]:
        t0 = time.time()
        try:
            recs = materialize(fit(train, k, points[n], features).withColumn("point", F.lit(n)), "grid_recs")
            return recs, time.time() - t0, None
        except Exception as e:  # noqa: BLE001 — recorded per grid point
            failed.append(e)
            return None, time.time() - t0, f"{type(e).__name__}: {e}"

    with ThreadPoolExecutor(max(1, parallelism)) as ex:
        fitted = list(ex.map(run, range(len(points))))
    if len(failed) == len(points):
        raise failed[-1]
    # the lists of all points are scored together
    t0 = time.time()
    lists = [recs.select("point", "user_id", "rank", "item_id") for recs, _, _ in fitted if recs is not None]
    scored = {r["point"]: r.asDict() for r in evaluate_points(reduce(DataFrame.unionByName, lists), train, test, k).collect()}
    share = (time.time() - t0) / len(lists)
    none, zero = {c: None for c in METRIC_COLS}, {c: 0.0 for c in METRIC_COLS}
    rows = []
    for n, (recs, spent, error) in enumerate(fitted):
        row = none if recs is None else scored.get(n, zero)
        rows.append({**points[n], **{c: row[c] for c in METRIC_COLS}, "total_time": spent + share, "error": error})
    return _result_rows(spark, model, rows)


def tune_cooccurrence(train: DataFrame, test: DataFrame, k: int = 10, points: list[dict] | None = None) -> DataFrame:
    """X6 of the co-occurrence model: lists of all points in one pass, times shared evenly."""
    t0 = time.time()
    points = points or grid_points(train.sparkSession, "sar")
    known, errors = {}, {}
    for n, p in enumerate(points):
        try:
            known[n] = _cooccurrence_point(p)
        except ValueError as e:
            errors[n] = e
    if not known:
        raise errors[max(errors)]
    recs = cooc.recommend_points(train, known, k, cooc.written_cells(train))
    scored = {r["point"]: r.asDict() for r in evaluate_points(recs, train, test, k).collect()}
    spent = (time.time() - t0) / len(points)
    none, zero = {c: None for c in METRIC_COLS}, {c: 0.0 for c in METRIC_COLS}
    rows = []
    for n, p in enumerate(points):
        row = none if n in errors else scored.get(n, zero)
        rows.append({**p, **{c: row[c] for c in METRIC_COLS}, "total_time": spent,
                     "error": f"ValueError: {errors[n]}" if n in errors else None})
    return _result_rows(train.sparkSession, "sar", rows)


def train_evaluate(algorithm: str, train: DataFrame, test: DataFrame, k: int = 10,
                   version: int = 1, sample_users: int = 5, params: dict | None = None,
                   features: Features = NO_FEATURES) -> tuple[DataFrame, DataFrame]:
    """Fit, evaluate, and return (metrics record, sample lists).

    The metrics record has the model-metrics schema (algorithm, version,
    timestamp, metrics..., training_time, hyperparameters MAP)."""
    t0 = time.time()
    params = params or {}
    recs = LISTS[algorithm](train, k, params, features)
    recs = materialize(recs, f"recs_{algorithm}")
    fit_time = time.time() - t0
    row = evaluate(recs, train, test, k)
    rec = row.select(F.lit(algorithm).alias("algorithm"), F.lit(version).alias("version"),
                     F.lit(float(t0)).alias("timestamp"), *METRIC_COLS,
                     F.lit(fit_time).alias("training_time"),
                     (F.create_map(*[F.lit(str(x)) for kv in params.items() for x in kv]) if params
                      else F.create_map().cast("map<string,string>")).alias("hyperparameters"))
    from ..operators.ranking import hash_sample, nest_recommendations
    sample = nest_recommendations(recs, hash_sample(recs, sample_users), reason=algorithm)
    return rec, sample


def profile_and_select(train: DataFrame, test: DataFrame, tuning: DataFrame | None = None,
                       metric: str = "map_at_k", features: Features = NO_FEATURES) -> DataFrame:
    """X5, first half: profile -> rule scores -> choice (tuning results first)."""
    p = profile.dataset_profile(train, test, *features)
    return selection.select_model(selection.model_scores(p), tuning, metric, profile=p)


def fit_selected(train: DataFrame, test: DataFrame, tuning: DataFrame | None = None, metric: str = "map_at_k",
                 k: int = 10, features: Features = NO_FEATURES) -> tuple[DataFrame, DataFrame]:
    """(choice, lists) of the selected model, fitted with the chosen parameters.

    ``features`` count in the profile, and the hybrid model is fitted with them."""
    choice = materialize(profile_and_select(train, test, tuning, metric, features), "choice")
    row = choice.first()
    return choice, LISTS[row["model"]](train, k, row["hyperparameters"], features)


def tuning_long(results: DataFrame, model: str, params: list[str]) -> DataFrame:
    """Best point per metric as ``(model, metric, value, hyperparameters MAP)`` for ``select_model``.

    Lower is better for rmse and mae.
    """
    point = F.map_from_arrays(F.array(*[F.lit(p) for p in params]), F.array(*[F.col(p).cast("string") for p in params]))
    rows = results.where(F.col("error").isNull()).select(
        F.lit(model).alias("model"), point.alias("hyperparameters"),
        F.explode(F.map_from_arrays(F.array(*[F.lit(c) for c in METRIC_COLS]),
                                    F.array(*[F.col(c) for c in METRIC_COLS]))).alias("metric", "value"))
    good = F.when(F.col("metric").isin("rmse", "mae"), -F.col("value")).otherwise(F.col("value"))
    # equal values: the point whose parameters come first in text order
    order = F.row_number().over(Window.partitionBy("model", "metric").orderBy(
        F.round(good, 9).desc_nulls_last(), F.to_json("hyperparameters")))
    return rows.withColumn("_n", order).where("_n = 1").select("model", "metric", "value", "hyperparameters")
