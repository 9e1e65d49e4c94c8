"""Grids, tuned choices and the factor models on planted low-rank data."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.models import als, biased_mf, hybrid
from affinis.models import popularity as popm
from affinis.operators import metrics, prep, selection
from affinis.plans import tuning
from conftest import rows


def test_grid_sizes(spark):
    assert [tuning.grid(spark, m).count() for m in ("als", "svd", "sar", "lightfm", "baseline")] == [27, 81, 24, 32, 4]
    off = tuning.grid(spark, "sar").where("not use_timedecay")
    assert rows(off.select("time_decay_coefficient").distinct()) == [(30,)]


def test_tuned_choice_carries_its_parameters(spark):
    cols = ", ".join(f"{c} double" for c in tuning.METRIC_COLS)
    data = [("jaccard", 7, *[0.1] * 7, None), ("lift", 90, *[0.4] * 7, None), ("counts", 30, *[0.9] * 7, "boom")]
    res = spark.createDataFrame(data, f"similarity_type string, time_decay_coefficient int, {cols}, error string")
    best = tuning.tuning_long(res, "sar", ["similarity_type", "time_decay_coefficient"])
    scores = spark.createDataFrame([(m, 5) for m in selection.MODEL_ORDER], "model string, score long")
    row = selection.select_model(scores, best).first()
    assert (row["model"], row["reason"]) == ("sar", "tuned_map_at_k")
    assert row["hyperparameters"] == {"similarity_type": "lift", "time_decay_coefficient": "90"}
    assert selection.select_model(scores).first()["hyperparameters"]["factors"] == "100"


@pytest.fixture(scope="module")
def planted(spark):
    """Two tastes: users of one side rate its items; a fifth of the pairs is held out."""
    r = np.random.default_rng(3)
    data = []
    for u in range(60):
        for i in range(40):
            if (u % 2 == i % 2 and r.random() < 0.7) or r.random() < 0.04:
                data.append((u, i, 5.0 if u % 2 == i % 2 else 1.0, dt.datetime(2024, 1, 1)))
    df = spark.createDataFrame(data, "user_id long, item_id long, rating double, ts timestamp")
    held = F.pmod(F.xxhash64("user_id", "item_id"), F.lit(5)) == 0
    return df.where(~held).cache(), df.where(held & (F.col("rating") > 3)).cache()


@pytest.mark.parametrize("name", ["als", "biased_mf", "hybrid"])
def test_factor_models_beat_popularity(planted, name):
    train, test = planted
    recs = {"als": lambda: als.recommend(als.fit(train, rank=4, reg=0.1, alpha=10.0), 5),
            "biased_mf": lambda: biased_mf.recommend(biased_mf.fit(train, rank=4, max_iter=8), 5),
            "hybrid": lambda: hybrid.recommend(hybrid.fit(train, factor_size=4, max_iter=60, step=0.1), 5)}[name]()
    base = popm.recommend(popm.fit(train), n=5)
    ndcg = lambda r: metrics.ranking_metrics(r, test, 5).first()["ndcg_at_k"]
    assert ndcg(recs) > ndcg(base) + 0.1
    assert not prep.remove_seen(recs, recs).count() and recs.join(train, ["user_id", "item_id"]).count() == 0


def test_biased_mf_unknown_user_and_round_trip(spark, planted, tmp_dir):
    train, _ = planted
    m = biased_mf.fit(train, rank=2, max_iter=3)
    users = spark.createDataFrame([(0,), (777,)], "user_id long")
    got = biased_mf.recommend(m, 3, users)
    assert rows(got.groupBy("user_id").count()) == [(0, 3), (777, 3)]
    biased_mf.save(m, f"{tmp_dir}/m")
    again = biased_mf.recommend(biased_mf.load(spark, f"{tmp_dir}/m", 2), 3, users)
    assert rows(again, "user_id", "rank", "item_id") == rows(got, "user_id", "rank", "item_id")


def test_unseen_ranks_of_a_hot_user(spark):
    seen = spark.range(1, 20_001).where("id % 7 <> 0").select(F.lit(1).cast("long").alias("user_id"), F.col("id").alias("prank"))
    users = spark.createDataFrame([(1,), (2,)], "user_id long")
    got = rows(popm.unseen_ranks(seen, users, 4, 30_000), "user_id", "rank", "prank")
    assert got == [(1, k, 7 * k) for k in range(1, 5)] + [(2, k, k) for k in range(1, 5)]
    assert rows(popm.unseen_ranks(seen.where("prank < 3"), users, 4, 3), "user_id", "rank", "prank") == [
        (1, 1, 3), (2, 1, 1), (2, 2, 2), (2, 3, 3)]


@pytest.mark.parametrize("m", [1, 3])
def test_negatives_are_exact_and_unseen(spark, m):
    pos = spark.createDataFrame([(u, i) for u in range(4) for i in range(0, 20, u + 1)] + [(9, 5)], "user_id long, item_id long")
    items = spark.range(20).select(F.col("id").alias("item_id"))
    neg = hybrid.negative_samples(pos, items, m)
    assert neg.join(pos, ["user_id", "item_id"]).count() == 0 and neg.distinct().count() == neg.count()
    own = dict(rows(pos.groupBy("user_id").count()))
    got = dict(rows(neg.groupBy("user_id").count()))
    assert got == {u: min(m * h, 20 - h) for u, h in own.items() if h < 20}


def test_feature_tables_reach_the_rules_and_the_hybrid_model(spark, planted, monkeypatch):
    train, test = planted
    train = train.withColumn("ts", F.col("ts") + F.make_dt_interval(F.col("user_id").cast("int")))
    users = train.select("user_id").distinct().withColumn("side", F.col("user_id") % 2)
    items = train.select("item_id").distinct().withColumn("side", F.col("item_id") % 2)
    chosen = spark.createDataFrame([("lightfm", "map_at_k", 1.0, {"no_components": "2", "epochs": "2"})],
                                   "model string, metric string, value double, hyperparameters map<string,string>")
    given, fit = [], hybrid.fit
    monkeypatch.setattr(hybrid, "fit", lambda *a, **k: given.append(a) or fit(*a, **k))
    choice, recs = tuning.fit_selected(train, test, chosen, k=3, features=(users, items))
    assert choice.first()["model"] == "lightfm" and recs.count() > 0
    assert given[0][1:] == (users, ["side"], items, ["side"])
    seen, model_scores = [], selection.model_scores
    monkeypatch.setattr(selection, "model_scores", lambda p: seen.append(p) or model_scores(p))
    tuning.profile_and_select(train, test, features=(users, items)).first()
    row = seen[0].first()
    assert (row["num_user_features"], row["num_item_features"], row["user_feature_sparsity"]) == (1, 1, 0.0)
    plain = tuning.profile.dataset_profile(train, test)
    lightfm = [dict(rows(model_scores(p)))["lightfm"] for p in (plain, seen[0])]
    assert lightfm[1] - lightfm[0] == 16


def test_registered_selection_queries_pass_the_attributes(spark, monkeypatch):
    from affinis.plans import catalog
    given = []
    monkeypatch.setattr(tuning, "fit_selected", lambda *a, **k: given.append(k["features"]) or (None, None))
    catalog.REGISTRY["model_fit_selected"][0](spark, "/root/testdata/sf0.001")
    assert [f.columns for f in given[0]] == [["user_id", "segment", "nation"], ["item_id", "brand", "type", "size"]]


def test_user_mean_lists_are_honoured(planted):
    train, _ = planted
    plain, mean = (tuning.LISTS["baseline"](train, 3, {"recommendation_strategy": s, "remove_seen": "false"})
                   for s in ("popularity", "user_mean"))
    assert rows(plain, "user_id", "rank", "item_id") == rows(mean, "user_id", "rank", "item_id")
    means = train.groupBy("user_id").agg(F.avg("rating").alias("score"))
    assert rows(mean.select("user_id", F.round("score", 9)).distinct()) == rows(means.select("user_id", F.round("score", 9)))
    with pytest.raises(ValueError):
        tuning.LISTS["baseline"](train, 3, {"recommendation_strategy": "median"})


@pytest.mark.parametrize("model, points, n", [
    ("als", {"factors": [2, 3], "regularization": [0.1], "alpha": [1.0], "iterations": [2]}, 2),
    ("svd", {"n_factors": [2], "n_epochs": [2], "lr_all": [0.002, 0.005], "reg_all": [0.02, 0.05]}, 2),
    ("lightfm", {"no_components": [2], "loss": ["warp", "bpr"], "learning_rate": [0.05, 0.1], "item_alpha": [0.1],
                 "user_alpha": [0.1], "epochs": [2]}, 2),
    ("baseline", tuning.GRIDS["baseline"], 4)])
def test_every_grid_is_fitted(planted, monkeypatch, model, points, n):
    train, test = planted
    monkeypatch.setitem(tuning.GRIDS, model, points)
    got = tuning.tune(model, train, test, 5).collect()
    assert len(got) == n == len({tuple(r[p] for p in tuning.tuned_params(model)) for r in got})
    assert [r["error"] for r in got] == [None] * n and all(r["recall_at_k"] is not None for r in got)


def test_points_of_the_whole_grids(spark):
    assert [len(tuning.grid_points(spark, m)) for m in ("als", "svd", "sar", "lightfm", "baseline")] == [27, 27, 24, 4, 4]


def test_popularity_grid_is_fitted_once(spark, monkeypatch):
    from affinis.models import popularity
    made, fit = [], popularity.fit
    monkeypatch.setattr(popularity, "fit", lambda train: made.append(1) or fit(train))
    train = spark.createDataFrame([(u, i, float(1 + (u + i) % 5)) for u in range(6) for i in range(9) if (u * i) % 4 != 1],
                                  "user_id long, item_id long, rating double")
    test = spark.createDataFrame([(u, u + 2) for u in range(6)], "user_id long, item_id long")
    rows = tuning.tune("baseline", train, test, 3).collect()
    assert len(made) == 1 and len(rows) == 4 and all(r.error is None for r in rows)
    for r in rows:
        recs = tuning.LISTS["baseline"](train, 3, {"recommendation_strategy": r.recommendation_strategy, "remove_seen": r.remove_seen})
        alone = tuning.evaluate(recs, train, test, 3).first()
        assert all(abs(r[c] - alone[c]) < 1e-9 for c in tuning.METRIC_COLS)


def test_cooccurrence_grid_sends_the_pairs_once(spark, monkeypatch):
    from affinis.models import cooccurrence, scoring
    monkeypatch.setattr(scoring, "STEP", 40)
    made, send = [], cooccurrence.grid_products
    monkeypatch.setattr(cooccurrence, "grid_products", lambda *a, **k: made.append(1) or send(*a, **k))
    day = 86400.0
    # repeated pairs and an unknown user
    train = spark.createDataFrame([(f"u{u}" if u else None, f"i{i}", float(1 + (u + i) % 5), day * ((7 * u + 3 * i) % 50))
                                   for u in range(14) for i in [*range(12), 3] if (u * i) % 4 != 1],
                                  "user_id string, item_id string, rating double, at double") \
        .withColumn("ts", F.timestamp_seconds("at")).drop("at")
    test = spark.createDataFrame([(f"u{u}", f"i{(5 * u + 1) % 12}") for u in range(14)], "user_id string, item_id string")
    points = tuning.grid_points(spark, "sar")
    got = tuning.tune("sar", train, test, 3, [*points, {**points[0], "similarity_type": "none"}]).collect()
    assert len(made) == 1
    assert [r["error"] for r in got] == [None] * 24 + ["ValueError: none"] and got[24]["map_at_k"] is None
    for p, r in list(zip(points, got))[::5]:
        alone = tuning.evaluate(tuning.LISTS["sar"](train, 3, p), train, test, 3).first()
        assert all(abs(r[c] - alone[c]) < 1e-9 for c in tuning.METRIC_COLS)
    with pytest.raises(ValueError):
        tuning.tune("sar", train, test, 3, [{**points[0], "similarity_type": "none"}])


def test_als_keeps_the_lineage_of_one_iteration(planted, monkeypatch):
    made, make = [], als.ALS
    monkeypatch.setattr(als, "ALS", lambda **k: made.append(make(**k)) or made[-1])
    train, _ = planted
    assert als.fit(train, rank=2, max_iter=2).user_factors.count() > 0
    assert [m.getCheckpointInterval() for m in made] == [1]
