"""Factorisation machine by blocks against a plain one."""

import numpy as np
import pytest

from affinis.models import fm, hybrid
from affinis.models.grid_mf import normals


def brute(pairs, users, items, uf, itf, factors, iterations, step, seed=7):
    """Dense AdamW on the same start."""
    names = sorted({f for x in (uf, itf) for fs in x.values() for f in fs})
    nu, ni = len(users), len(items)
    sets = {("u", u): [2 * k] for k, u in enumerate(users)} | {("i", i): [2 * k + 1] for k, i in enumerate(items)}
    own = np.array(sorted(x[0] for x in sets.values()))
    column = {e: k for k, e in enumerate(own)}
    m = len(own) + len(names)
    x = np.zeros((len(pairs), m))
    for r, (u, i, _) in enumerate(pairs):
        x[r, column[sets["u", u][0]]] = x[r, column[sets["i", i][0]]] = 1
        for f in uf.get(u, []) + itf.get(i, []):
            x[r, len(own) + names.index(f)] = 1
    y = np.array([p[2] for p in pairs])
    v = fm.STD * np.concatenate((normals(own, factors, seed), normals(np.arange(1, len(names) + 1), factors, seed + 1)))
    theta = np.concatenate((v.ravel(), np.zeros(m + 1)))
    a = b = np.zeros(len(theta))
    for t in range(1, iterations + 1):
        v, w, w0 = theta[:m * factors].reshape(m, factors), theta[m * factors:-1], theta[-1]
        s = x @ v
        logit = w0 + x @ w + 0.5 * (s ** 2 - (x ** 2) @ (v ** 2)).sum(1)
        g = (1 / (1 + np.exp(-logit)) - y) / len(y)
        dv = x.T @ (g[:, None] * s) - (x.T @ g)[:, None] * v
        theta, a, b = fm.adam(theta, a, b, np.concatenate((dv.ravel(), x.T @ g, [g.sum()])), step, t)
    v, w = theta[:m * factors].reshape(m, factors), theta[m * factors:-1]

    def of(key, attrs):
        rows = [column[sets[key][0]]] + [len(own) + names.index(f) for f in attrs]
        return v[rows].sum(0), w[rows].sum() + 0.5 * (v[rows].sum(0) ** 2 - (v[rows] ** 2).sum(0)).sum()

    return {u: of(("u", u), uf.get(u, []))[0] for u in users}, {i: of(("i", i), itf.get(i, [])) for i in items}


@pytest.mark.parametrize("attributes", [True, False])
def test_blocks_equal_a_dense_machine(spark, monkeypatch, attributes):
    for name, value in {"LEAST_PAIRS": 40, "LEAST": 5, "STEP": 60}.items():
        monkeypatch.setattr(fm, name, value)
    r = np.random.default_rng(0)
    users, items = [f"é{u:02d}" for u in range(20)], list(range(100, 130))
    pairs = [(u, i, float((a + b) % 3 == 0)) for a, u in enumerate(users) for b, i in enumerate(items) if r.random() < 0.4]
    uf = {u: [f"side_{k % 2}"] for k, u in enumerate(users[:-1])} if attributes else {}
    itf = {i: [f"kind_{k % 3}", f"size_{k % 4}"] for k, i in enumerate(items)} if attributes else {}
    table = lambda x, key, kind: spark.createDataFrame([(k, f) for k, fs in x.items() for f in fs], f"{key} {kind}, feature string")
    df = spark.createDataFrame(pairs, "user_id string, item_id long, label double")
    data = fm.prepare(df, df, table(uf, "user_id", "string"), table(itf, "item_id", "long"))
    assert data.blocks.count() > 1
    got_u, got_i = fm.train(data, 3, 5, 0.1)
    want_u, want_i = brute(pairs, users, items, uf, itf, 3, 5, 0.1)
    got_u, got_i = {x[0]: x[1] for x in got_u.collect()}, {x[0]: (x[1], x[2]) for x in got_i.collect()}
    assert set(got_u) == set(users) and set(got_i) == set(items)
    assert all(np.allclose(got_u[u], want_u[u], atol=1e-4) for u in users)
    assert all(np.allclose(got_i[i][0], want_i[i][0], atol=1e-4) and abs(got_i[i][1] - want_i[i][1]) < 1e-4 for i in items)


def test_no_id_reaches_the_driver(spark, monkeypatch):
    """Rows of the driver's collects do not grow with the ids."""
    from pyspark.sql.classic.dataframe import DataFrame
    taken, collect = [], DataFrame.collect
    monkeypatch.setattr(DataFrame, "collect", lambda self: taken.append(collect(self)) or taken[-1])
    made, create = [], type(spark).createDataFrame
    monkeypatch.setattr(type(spark), "createDataFrame", lambda self, data, *a, **k: made.append(len(data)) or create(self, data, *a, **k))
    train = spark.range(3000).selectExpr("id % 300 as user_id", "(id * 7) % 211 as item_id")
    m = hybrid.fit(train, factor_size=2, max_iter=2)
    assert m.user_vectors.count() == 300 and m.item_vectors.count() == 211
    assert max([len(t) for t in taken] + made + [0]) < 100
