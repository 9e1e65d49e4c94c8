"""Factorisations of a whole grid in one run against separate ones, brute force and Spark ML."""

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from affinis.models import als, grid_mf
from affinis.models.grid_mf import Point
from affinis.plans import tuning


def planted(users=60, items=40, seed=0, hot=False):
    r = np.random.default_rng(seed)
    group = r.integers(0, 3, users)
    rows = [(f"u{u}", int(i), float(r.integers(1, 6))) for u in range(users) for i in range(items)
            if r.random() < (0.45 if i % 3 == group[u] else 0.05)]
    if hot:  # one user has a third of all rows
        rows += [("u0", 1000 + i, float(1 + i % 5)) for i in range(len(rows) // 2)]
    return pd.DataFrame(rows, columns=["user_id", "item_id", "rating"])


def brute(rows, point, implicit, seed=42):
    """Plain alternating least squares from the same start."""
    t = rows.groupby(["user_id", "item_id"], as_index=False)["rating"].sum()
    u_ids, u = np.unique(t["user_id"], return_inverse=True)
    i_ids, i = np.unique(t["item_id"], return_inverse=True)
    m = np.zeros((len(u_ids), len(i_ids)))
    known = np.zeros(m.shape, bool)
    m[u, i], known[u, i] = t["rating"], True
    y = grid_mf.start_vectors(np.arange(len(i_ids)), point.rank, seed)
    eye = np.eye(point.rank)

    def half(y, m, known):
        out = []
        for r, k in zip(m, known):
            f, v = y[k], r[k]
            if implicit:
                a = y.T @ y + (f * (point.alpha * np.abs(v))[:, None]).T @ f + point.reg * (v > 0).sum() * eye
                b = np.where(v > 0, 1 + point.alpha * np.abs(v), 0) @ f
            else:
                a, b = f.T @ f + point.reg * len(v) * eye, v @ f
            out.append(np.linalg.solve(a, b))
        return np.array(out)

    for _ in range(point.iterations):
        x = half(y, m, known)
        y = half(x, m.T, known.T)
    return u_ids, i_ids, x, y


def scores(model, p):
    x, y = (t.toPandas() for t in grid_mf.factors_of(model, p))
    x, y = x.sort_values("user_id"), y.sort_values("item_id")
    return np.stack(x["features"]) @ np.stack(y["features"]).T


@pytest.mark.parametrize("implicit,hot", [(True, False), (False, False), (True, True), (False, True)])
def test_points_equal_brute_force(spark, implicit, hot):
    rows = planted(hot=hot)
    points = [Point(3, 0.05, 1.0, 2), Point(3, 0.05, 1.0, 4), Point(3, 0.5, 10.0, 4), Point(12, 0.1, 2.0, 3)]
    model = grid_mf.fit_points(spark.createDataFrame(rows), points, implicit, block=100, hot=60)
    assert [model.iterations[k] for k in range(4)] == [2, 4, 4, 3]
    for k, p in enumerate(points):
        _, _, x, y = brute(rows, p, implicit)
        # factors are kept as 32-bit floats between half-iterations
        assert np.abs(scores(model, k) - x @ y.T).max() < 2e-4


def test_points_equal_separate_runs(spark):
    rows = spark.createDataFrame(planted(seed=3))
    points = [Point(3, g, a, 3) for g in (0.01, 0.5) for a in (1.0, 40.0)]
    model = grid_mf.fit_points(rows, points)
    for k, p in enumerate(points):
        assert np.abs(scores(model, k) - scores(grid_mf.fit_points(rows, [p]), 0)).max() < 1e-6


def test_objective_is_that_of_spark(spark):
    """From another start Spark ML ends at a loss within 2 %."""
    rows = planted(80, 50, 5)
    p = Point(4, 0.05, 5.0, 15)
    model = grid_mf.fit_points(spark.createDataFrame(rows), [p])
    other = als.fit(spark.createDataFrame(rows), 4, 15, 0.05, 5.0)

    def loss(x, y):
        x, y = x.toPandas().set_index("user_id")["features"], y.toPandas().set_index("item_id")["features"]
        u, i = x.index.to_numpy(), y.index.to_numpy()
        xm, ym = np.stack(x.to_numpy()).astype(float), np.stack(y.to_numpy()).astype(float)
        t = rows.groupby(["user_id", "item_id"])["rating"].sum()
        r = np.zeros((len(u), len(i)))
        r[pd.Index(u).get_indexer(t.index.get_level_values(0)), pd.Index(i).get_indexer(t.index.get_level_values(1))] = t
        fit = ((1 + p.alpha * r) * ((r > 0) - xm @ ym.T) ** 2).sum()
        return fit + p.reg * (((r > 0).sum(1) * (xm ** 2).sum(1)).sum() + ((r > 0).sum(0) * (ym ** 2).sum(1)).sum())

    own, spark_ml = loss(*grid_mf.factors_of(model, 0)), loss(other.user_factors, other.item_factors)
    assert abs(own - spark_ml) < 0.02 * spark_ml


def test_lists_and_metrics_of_all_points(spark):
    rows = planted(seed=7, hot=True)
    train, test = rows.sample(frac=0.7, random_state=1), rows.drop(rows.sample(frac=0.7, random_state=1).index)
    t, h = spark.createDataFrame(train), spark.createDataFrame(test)
    points = [{"factors": r, "regularization": g, "alpha": a, "iterations": 3} for r in (2, 5) for g in (0.01, 0.5)
              for a in (1.0, 40.0)]
    recs = tuning.fit_grid("als", t, h, points, 10)
    got = recs.toPandas()
    model = grid_mf.fit_points(t, [Point(5, 0.5, 40.0, 3)])
    want = als.recommend(als.FactorModel(*grid_mf.factors_of(model, 0), t.select("user_id", "item_id").distinct(), 5), 10)
    key = ["user_id", "rank", "item_id"]
    assert got[got["point"] == 7][key].sort_values(key).values.tolist() == want.toPandas()[key].sort_values(key).values.tolist()
    # every user has a list at every point, nothing seen is listed
    assert got.groupby("point")["user_id"].nunique().tolist() == [train["user_id"].nunique()] * 8
    assert not len(got.merge(train, on=["user_id", "item_id"]))
    out = tuning.evaluate_points(spark.createDataFrame(got), t, h, 10).orderBy("point").toPandas()
    for p in range(8):
        one = tuning.evaluate(spark.createDataFrame(got[got["point"] == p].drop(columns="point")), t, h, 10).toPandas()
        assert np.allclose(out[out["point"] == p][tuning.METRIC_COLS], one[tuning.METRIC_COLS], atol=1e-12)
    sql = duckdb.sql("""
      WITH hits AS (SELECT point, g.user_id, count(t.user_id) AS h, count(*) AS n
                    FROM got g LEFT JOIN (SELECT DISTINCT user_id, item_id FROM test) t USING (user_id, item_id)
                    GROUP BY ALL)
      SELECT point, avg(h / least(n, 10)) AS p FROM hits WHERE user_id IN (SELECT user_id FROM test)
      GROUP BY point ORDER BY point""").df()
    assert np.allclose(sql["p"], out["precision_at_k"])


def test_weak_points_stop(spark):
    rows = planted(seed=9)
    t = spark.createDataFrame(rows)
    points = [Point(4, 0.05, 1.0, 8), Point(4, 500.0, 1.0, 8), Point(4, 0.1, 1.0, 8), Point(4, 900.0, 1.0, 8)]
    calls = []

    def judge(model, at, nth):
        calls.append((sorted(at), nth))
        return {k: -points[k].reg for k in at}

    model = grid_mf.fit_points(t, points, stop_at=(2, 4), judge=judge)
    assert calls == [([0, 1, 2, 3], 0), ([0, 2], 1)]
    assert model.iterations == {0: 8, 1: 2, 2: 4, 3: 2}
    assert np.abs(scores(model, 0) - scores(grid_mf.fit_points(t, points[:1]), 0)).max() < 1e-6
    assert grid_mf.top_n_points(model, t, 5).select("point").distinct().count() == 4


def test_biased_grid_and_empty_table(spark):
    rows = spark.createDataFrame(planted(seed=11))
    points = [{"n_factors": 3, "n_epochs": e, "reg_all": 0.02} for e in (2, 3)]
    out = tuning.tune("svd", rows, rows.limit(200), 5, points).collect()
    assert [r["n_epochs"] for r in out] == [2, 3] and all(r["error"] is None and r["coverage"] > 0 for r in out)
    assert not grid_mf.fit_points(rows.where("false"), [Point(2, 0.1)]).at


def test_a_grid_that_fails_everywhere_raises(spark, monkeypatch):
    def broken(*_):
        raise ValueError("no such thing")

    monkeypatch.setitem(tuning.LISTS, "baseline", broken)
    rows = spark.createDataFrame(planted())
    with pytest.raises(ValueError):
        tuning.tune("baseline", rows, rows, 5)


def test_lists_equal_brute_force_on_near_ties(spark):
    """Scores that 32 bits do not tell apart, biases, seen items and chosen users, over several blocks and cells."""
    rows = planted(70, 45, 13)
    model = grid_mf.fit_points(spark.createDataFrame(rows), [Point(3, 0.1, 2.0, 1), Point(5, 0.1, 2.0, 2)])
    bias = pd.DataFrame({"item_id": np.arange(45), "b_i": 7.0 + 1e-7 * (np.arange(45) * 17 % 45)})
    some = pd.DataFrame({"user_id": [f"u{u}" for u in range(0, 70, 3)] + ["none"]})
    seen = set(zip(rows["user_id"], rows["item_id"]))
    for users in (None, some):
        got = grid_mf.top_n_points(model, spark.createDataFrame(rows), 6, item_bias=spark.createDataFrame(bias), user_block=20,
                                   users=None if users is None else spark.createDataFrame(users), item_block=7).toPandas()
        for p in range(2):
            x, y = (t.toPandas() for t in grid_mf.factors_of(model, p))
            want = []
            for u, f in zip(x["user_id"], x["features"]):
                if users is not None and u not in set(users["user_id"]):
                    continue
                s = [(-round(float(f @ q + bias["b_i"][i]), 9), i) for i, q in zip(y["item_id"], y["features"]) if (u, i) not in seen]
                want += [(u, k + 1, i) for k, (_, i) in enumerate(sorted(s)[:6])]
            mine = got[got["point"] == p][["user_id", "rank", "item_id"]]
            assert sorted(map(tuple, mine.values.tolist())) == sorted(want)


def test_tables_of_earlier_iterations_go(spark):
    from affinis.session import checkpoint_dir
    import pathlib

    base = pathlib.Path(checkpoint_dir(spark).removeprefix("file:"))
    before = {p.name for p in base.glob("grid-*")}
    model = grid_mf.fit_points(spark.createDataFrame(planted(seed=15)), [Point(2, 0.1, 1.0, 2), Point(2, 0.1, 1.0, 5)])
    left = [p.name for p in base.glob("grid-*") if p.name not in before]
    # users and items of iterations 2 and 5; before, those of all 5
    assert sum(name.startswith("grid-factors") for name in left) == 4 and not any(name.startswith("grid-start") for name in left)
    assert len(scores(model, 0)) == len(scores(model, 1)) == 60


def test_a_row_is_sent_once_to_a_place():
    """All ratings of a place share one copy of a row, and rows it does not need stay away."""
    ids, f = np.array([3, 8, 9]), np.arange(6.0).reshape(3, 2)
    to, pos = np.array([0, 0, 4]), np.array([0, 2, 1])
    sent = [r for b in grid_mf._send(grid_mf._result(7, 1, ids, f, to, pos, False)) for r in b.to_pylist()]
    assert [(r["run"], r["b"], np.frombuffer(r["parts"][0], np.int32).tolist(), np.frombuffer(r["parts"][1], np.float32).tolist())
            for r in sent] == [(7, 0, [3, 9], [0, 1, 4, 5]), (7, 4, [8], [2, 3])]
