"""Blocked products and top-n lists against plain numpy."""

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.models import cooccurrence, scoring


def brute(affinity, pairs, n, remove_seen, wanted=None):
    both = pd.concat([pairs, pairs.rename(columns={"i": "j", "j": "i"})])
    t = affinity.merge(both, left_on="item_id", right_on="i")
    t["score"] = t["affinity"] * t["sim"]
    t = t.groupby(["user_id", "j"], as_index=False)["score"].sum().rename(columns={"j": "item_id"})
    t = t[t["score"] != 0]
    if wanted is not None:
        t = t.merge(wanted.drop_duplicates(), on=["user_id", "item_id"])
    if remove_seen:
        seen = set(zip(affinity["user_id"], affinity["item_id"]))
        t = t[[k not in seen for k in zip(t["user_id"], t["item_id"])]]
    t["_r"] = -t["score"].round(9)
    t = t.sort_values(["user_id", "_r", "item_id"])
    t["rank"] = t.groupby("user_id").cumcount() + 1
    t = t[t["rank"] <= n]
    return sorted(zip(t["user_id"], t["rank"], t["item_id"], t["score"].round(7)))


def table(seed, users, items, text=False, hot=False):
    r = np.random.default_rng(seed)
    name = (lambda x: f"é{x:03d}") if text else int
    a = [(name(u), name(i), float(r.integers(1, 5))) for u in range(users) for i in range(items) if r.random() < 0.1]
    if hot:  # one user with about a third of all rows
        a = [x for x in a if x[0] != name(0)]
        a += [(name(0), name(i), 1.0 + i % 3) for i in range(min(items, len(a) // 2))]
    p = [(name(i), name(j), float(r.integers(1, 9)) / 8) for i in range(items) for j in range(i + 1, items) if r.random() < 0.2]
    return (pd.DataFrame(a, columns=["user_id", "item_id", "affinity"]), pd.DataFrame(p, columns=["i", "j", "sim"]))


@pytest.mark.parametrize("text,hot,blocks,remove", [(False, False, {}, True), (True, False, {"user_block": 7, "item_block": 9}, True),
                                                   (False, True, {"user_block": 5, "item_block": 20}, True),
                                                   (True, True, {"user_block": 50, "item_block": 6}, False)])
def test_product_equals_brute_force(spark, monkeypatch, text, hot, blocks, remove):
    monkeypatch.setattr(scoring, "PACK", 11)
    a, p = table(1, 30, 60, text, hot)
    out = scoring.top_n_products(spark.createDataFrame(a), spark.createDataFrame(p), 5, remove, **blocks).collect()
    assert sorted((r.user_id, r["rank"], r.item_id, round(r.score, 7)) for r in out) == brute(a, p, 5, remove)


def test_candidates_are_joined(spark):
    a, p = table(2, 25, 40)
    r = np.random.default_rng(3)
    wanted = pd.DataFrame({"user_id": r.integers(0, 30, 300), "item_id": r.integers(0, 45, 300)})
    for remove in (True, False):
        df = scoring.top_n_products(spark.createDataFrame(a), spark.createDataFrame(p), 4, remove, spark.createDataFrame(wanted))
        assert sorted((x.user_id, x["rank"], x.item_id, round(x.score, 7)) for x in df.collect()) == brute(a, p, 4, remove, wanted)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" not in plan and "FlatMapGroups" not in plan


def test_factor_candidates_are_joined(spark):
    r = np.random.default_rng(4)
    x, y = r.standard_normal((6, 3)), r.standard_normal((9, 3))
    users = spark.createDataFrame([(u, v.tolist()) for u, v in enumerate(x)], "user_id long, features array<double>")
    items = spark.createDataFrame([(i, v.tolist(), i / 10) for i, v in enumerate(y)], "item_id long, features array<double>, bias double")
    seen = spark.createDataFrame([(0, 1), (2, 3)], "user_id long, item_id long")
    wanted = spark.createDataFrame([(u, i) for u in range(8) for i in range(0, 12, 2)] + [(0, 1), (0, 2)], "user_id long, item_id long")
    df = scoring.top_n_scores(users, items, 3, seen, wanted)
    whole = scoring.top_n_scores(users, items, 100, seen)
    only = whole.join(wanted.distinct(), ["user_id", "item_id"]).toPandas().sort_values(["user_id", "score"], ascending=[True, False])
    want = only.groupby("user_id").head(3)
    got = df.toPandas().sort_values(["user_id", "rank"])
    assert got[["user_id", "item_id"]].values.tolist() == want[["user_id", "item_id"]].values.tolist()
    assert np.allclose(got["score"], want["score"])
    assert "FlatMapGroups" not in df._jdf.queryExecution().executedPlan().toString()


@settings(max_examples=80, deadline=None)
@given(st.integers(1, 6), st.integers(0, 40), st.integers(1, 4), st.integers(0, 10_000))
def test_best_of_equals_sorting(rows, wide, n, seed):
    r = np.random.default_rng(seed)
    s = r.integers(-3, 3, (rows, wide)) + r.choice([0.0, 1e-10, -1e-10, 5e-10], (rows, wide))
    s[r.random((rows, wide)) < 0.3] = -np.inf
    got = scoring.best_of(s, np.arange(rows), np.arange(wide), n)
    want = []
    for u in range(rows):
        cells = sorted((-np.round(s[u, i], 9), i) for i in range(wide) if np.isfinite(s[u, i]))
        want += [(u, i) for _, i in cells[:n]]
    assert list(zip(got["user_id"], got["item_id"])) == want


def test_cooccurrence_hot_user(spark):
    """Lists of the whole model with a user who owns a third of the rows."""
    a, _ = table(6, 40, 50, hot=True)
    train = spark.createDataFrame(a.rename(columns={"affinity": "rating"}))
    m = cooccurrence.fit(train, "jaccard", time_decay=False)
    sims, own = m.sim_half.toPandas(), m.affinity.toPandas()
    out = cooccurrence.recommend(m, n=5).collect()
    assert sorted((r.user_id, r["rank"], r.item_id, round(r.score, 7)) for r in out) == brute(own, sims, 5, True)
    assert cooccurrence.recommend(cooccurrence.fit(train.where("false"), time_decay=False), n=5).count() == 0


@pytest.mark.parametrize("text", [False, True])
def test_scores_send_users_once(spark, monkeypatch, text):
    """Many cells, ties, biases and seen items against numpy; only items are copied, one to each block of users."""
    monkeypatch.setattr(scoring, "TILE", 8)
    r = np.random.default_rng(5)
    name = (lambda x: f"é{x:03d}") if text else int
    x, y, b = r.integers(-3, 4, (40, 3)) / 2, r.integers(-3, 4, (70, 3)) / 2, r.integers(0, 3, 70) / 4
    kind = "string" if text else "long"
    users = spark.createDataFrame([(name(u), v.tolist()) for u, v in enumerate(x)], f"user_id {kind}, features array<double>")
    items = spark.createDataFrame([(name(i), v.tolist(), float(c)) for i, (v, c) in enumerate(zip(y, b))],
                                  f"item_id {kind}, features array<double>, bias double")
    pairs = [(int(u), int(i)) for u, i in zip(r.integers(0, 40, 600), r.integers(0, 70, 600))] + [(3, i) for i in range(65)]
    seen = spark.createDataFrame([(name(u), name(i)) for u, i in pairs], f"user_id {kind}, item_id {kind}")
    scores = np.round(x @ y.T + b, 9)
    scores[tuple(zip(*pairs))] = -np.inf
    want = [(name(u), n + 1, name(i), scores[u, i]) for u in range(40)
            for n, i in enumerate(k for k in np.lexsort((np.arange(70), -scores[u]))[:7] if np.isfinite(scores[u, k]))]
    df = scoring.top_n_scores(users, items, 7, seen, user_block=11, item_block=4)
    assert sorted((a.user_id, a["rank"], a.item_id, round(a.score, 9)) for a in df.collect()) == sorted(want)
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") == 1 and "FlatMapGroups" not in plan


@pytest.mark.parametrize("text", [False, True])
def test_pairs_stay_in_their_block(spark, monkeypatch, text):
    """Counts, lists and products from many small cells against pandas; no pair is shuffled to be summed."""
    for name, value in (("INCREMENTS", 300), ("LEAST", 50), ("BLOCKS", 2), ("CELL", 40), ("STEP", 70)):
        monkeypatch.setattr(cooccurrence, name, value)
    monkeypatch.setattr(scoring, "SIMILAR", 900)
    a, _ = table(8, 40, 50, text, hot=True)
    a = pd.concat([a, a.sample(60, random_state=1)]).rename(columns={"affinity": "rating"})
    train = spark.createDataFrame(a)
    n = a.groupby(["user_id", "item_id"]).size().rename("n").reset_index()
    both = n.merge(n, on="user_id")
    both["c"] = both["n_x"] * both["n_y"]
    c = both.groupby(["item_id_x", "item_id_y"])["c"].sum()
    half = {(i, j): int(v) for (i, j), v in c.items() if i < j}
    counts, _ = cooccurrence.cooccurrence(train, chunk=30)
    assert sorted(map(tuple, counts.collect())) == sorted((i, j, v) for (i, j), v in half.items())
    assert "Aggregate [i#" not in counts._jdf.queryExecution().optimizedPlan().toString()

    m = cooccurrence.fit(train, "cosine", time_decay=False, chunk=30)
    sim = pd.DataFrame([(i, j, v / np.sqrt(float(c[i, i]) * float(c[j, j]))) for (i, j), v in half.items()], columns=["i", "j", "sim"])
    full = pd.concat([sim, sim.rename(columns={"i": "j", "j": "i"})])
    full["r"] = -full["sim"].round(9)
    best = full.sort_values(["i", "r", "j"]).groupby("i").head(4)
    got = cooccurrence.similar_items(m, 4).collect()
    assert sorted((x.query_item_id, x.item_id, round(x.score, 8)) for x in got) == \
        sorted((i, j, round(v, 8)) for i, j, v in zip(best["i"], best["j"], best["sim"]))
    out = cooccurrence.recommend(m, n=5)
    assert sorted((x.user_id, x["rank"], x.item_id, round(x.score, 7)) for x in out.collect()) == brute(m.affinity.toPandas(), sim, 5, True)
    # similarities go once to their group; only users are copied
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Generate explode") == 1


def test_rounding_of_merged_lists_is_that_of_spark(spark):
    from pyspark.sql import functions as F
    # exact halves of the last digit
    x = [k * 2.0 ** -10 * s for k in (3.0, 5.0, 7.0, 1001.0) for s in (1, -1)] + [0.0, 1e-12, 123456.7890123456, 9e7 + 0.1]
    want = [r[0] for r in spark.createDataFrame([(v,) for v in x], "v double").select(F.round("v", scoring.DIGITS)).collect()]
    assert scoring.half_up(np.array(x)).tolist() == want
