"""Rankers and metrics on hand-computed toy data and invariants."""

import datetime as dt
import math

from pyspark.sql import functions as F

from affinis.models import cooccurrence as cooc
from affinis.models import popularity as popm
from affinis.models.scoring import top_n_products, top_n_scores
from affinis.operators import metrics, prep
from affinis.operators.ranking import top_n
from conftest import rows

T0 = dt.datetime(2024, 1, 1)


def inter(spark, pairs):
    return spark.createDataFrame([(u, i, 1.0, T0) for u, i in pairs],
                                 "user_id string, item_id string, rating double, ts timestamp")


def test_cooccurrence_toy(spark):
    # A = [[1,1,0],[1,1,1],[0,1,1]] over items 1,2,3
    df = inter(spark, [("a", "1"), ("a", "2"), ("b", "1"), ("b", "2"), ("b", "3"), ("c", "2"), ("c", "3")])
    c, s = cooc.cooccurrence(df)
    assert rows(c) == [("1", "2", 2), ("1", "3", 1), ("2", "3", 2)]
    assert rows(s) == [("1", 2), ("2", 3), ("3", 2)]
    sim = cooc.similarity(c, s, "jaccard")
    got = {(r["i"], r["j"]): r["sim"] for r in sim.collect()}
    assert math.isclose(got[("1", "2")], 2 / 3) and math.isclose(got[("1", "3")], 1 / 3)


def test_cooccurrence_chunked_equals_plain(spark):
    pairs = [("u%d" % (k % 4), "i%d" % (k % 23)) for k in range(90)]
    df = inter(spark, pairs)
    a, _ = cooc.cooccurrence(df, chunk=4096)
    b, _ = cooc.cooccurrence(df, chunk=3)   # forces several chunks per user
    assert rows(a) == rows(b)


def test_similarity_symmetric_and_recommend_no_seen(spark):
    pairs = [("u%d" % (k % 6), "i%d" % ((k * 7) % 11)) for k in range(40)]
    df = inter(spark, pairs)
    m = cooc.fit(df, time_decay=False)
    sim = {(r["i"], r["j"]): r["sim"] for r in m.similarity.collect()}
    assert all(math.isclose(v, sim[(j, i)]) for (i, j), v in sim.items())
    recs = cooc.recommend(m, n=3)
    seen = set(rows(df.select("user_id", "item_id").distinct()))
    assert not (set(rows(recs, "user_id", "item_id")) & seen)
    # the block sums equal the join and aggregate, and do not depend on the blocks
    plain = top_n(prep.remove_seen(cooc.score(m), df).where("score <> 0"), 3)
    small = top_n_products(m.affinity, m.sim_half, 3, user_block=2, item_block=3)
    expected = rows(plain, "user_id", "rank", "item_id")
    assert rows(recs, "user_id", "rank", "item_id") == rows(small, "user_id", "rank", "item_id") == expected


def test_candidates_restrict_every_scorer(spark):
    pairs = [("u%d" % (k % 6), "i%d" % ((k * 7) % 11)) for k in range(40)]
    df = inter(spark, pairs)
    m = cooc.fit(df, time_decay=False)
    some = cooc.recommend(m, n=9).where("rank > 2").select("user_id", "item_id")
    got = cooc.recommend(m, n=9, candidates=some)
    assert rows(got, "user_id", "item_id") == rows(some)
    pop = popm.recommend(popm.fit(df), n=2, candidates=some)
    assert set(rows(pop, "user_id", "item_id")) <= set(rows(some)) and pop.count() > 0


def test_popularity_minus_seen_exact(spark):
    # item popularity: x(3) > y(2) > z(1) > w(1)
    df = inter(spark, [("a", "x"), ("b", "x"), ("c", "x"), ("a", "y"), ("b", "y"), ("c", "z"), ("d", "w")])
    recs = popm.recommend(popm.fit(df), n=2)
    got = rows(recs, "user_id", "rank", "item_id")
    assert ("a", 1, "w") in got and ("a", 2, "z") in got or ("a", 1, "z") in got
    assert ("d", 1, "x") in got and ("d", 2, "y") in got
    assert rows(recs.groupBy("user_id").count()) == [(u, 2) for u in "abcd"]


def test_ranking_metrics_hand_computed(spark):
    recs = spark.createDataFrame([("u", 1, "a", 1.0), ("u", 2, "b", 1.0), ("u", 3, "c", 1.0)],
                                 "user_id string, rank int, item_id string, score double")
    truth = spark.createDataFrame([("u", "b"), ("u", "c"), ("u", "d")], "user_id string, item_id string")
    m = metrics.ranking_metrics(recs, truth, k=3).collect()[0]
    assert math.isclose(m["precision_at_k"], 2 / 3)
    assert math.isclose(m["recall_at_k"], 2 / 3)
    dcg = 1 / math.log2(3) + 1 / math.log2(4)
    idcg = 1 + 1 / math.log2(3) + 1 / math.log2(4)
    assert math.isclose(m["ndcg_at_k"], dcg / idcg)
    assert math.isclose(m["map_at_k"], (1 / 2 + 2 / 3) / 3)


def test_diversity_vectors_matches_pairwise(spark):
    recs = spark.createDataFrame([("u", 1, 1), ("u", 2, 2), ("u", 3, 3)], "user_id string, rank int, item_id long")
    vec = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, [1.0, 1.0])], "item_id long, features array<double>")
    d = metrics.diversity(recs, vec).collect()[0][0]
    c = [0.0, 1 / math.sqrt(2), 1 / math.sqrt(2)]
    assert math.isclose(d, sum(1 - x for x in c) / 3)


def test_factor_scorer_chunks_and_seen(spark):
    uf = spark.createDataFrame([("u%d" % k, [float(k), 1.0]) for k in range(5)], "user_id string, features array<double>")
    itf = spark.createDataFrame([("i%d" % k, [1.0, float(k)]) for k in range(7)], "item_id string, features array<double>")
    seen = spark.createDataFrame([("u4", "i6")], "user_id string, item_id string")
    one = top_n_scores(uf, itf, 2, seen)
    many = top_n_scores(uf, itf, 2, seen, user_block=2, item_block=2)
    assert rows(one) == rows(many)
    got = rows(one.where(F.col("user_id") == "u4"), "rank", "item_id")
    assert got == [(1, "i5"), (2, "i4")]
    only = spark.createDataFrame([("u4", "i6"), ("u4", "i1"), ("u1", "i0")], "user_id string, item_id string")
    assert rows(top_n_scores(uf, itf, 2, seen, only), "user_id", "rank", "item_id") == [("u1", 1, "i0"), ("u4", 1, "i1")]


def test_near_ties_do_not_depend_on_partitions(spark):
    uf = spark.createDataFrame([(2**60 + 1, [1.0])], "user_id long, features array<double>")
    itf = spark.createDataFrame([(2**60 + k, [0.3 + (k == 2) * 1e-12]) for k in range(1, 5)],
                                "item_id long, features array<double>")
    for parts in (1, 2, 4):
        for block in (1, 2, 100):
            got = rows(top_n_scores(uf, itf.repartition(parts), 1, item_block=block), "user_id", "item_id")
            assert got == [(2**60 + 1, 2**60 + 1)]


def test_histories_go_to_many_blocks_in_few_parts():
    """500 blocks get 60,000 rows in a part each (fifteen each when 4,096 rows were packed together)."""
    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(3)
    user, item = np.repeat(np.arange(1500), 40), rng.integers(0, 20_000, 60_000)
    one = np.ones(len(user), np.int64)
    rows = pa.record_batch([pa.array(user), pa.array(item), pa.array(one), pa.array(one), pa.array((item % 500).astype(np.int32))],
                           names=["user_id", "item_id", "n", "support", "block"])
    batches = [rows.slice(at, 10_000) for at in range(0, len(user), 10_000)]
    parts = [b.column("block")[0].as_py() for b in cooc._histories(iter(batches), cooc._together(500))]
    assert sorted(parts) == list(range(500))
