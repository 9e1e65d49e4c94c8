"""Rounds of the co-occurrence steps, packing, and shuffle files (round 4)."""
import time
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from affinis.models import cooccurrence as cooc
from affinis.models import scoring
from affinis.session import materialize

from conftest import rows


@pytest.fixture()
def ratings(spark):
    rng = np.random.default_rng(7)
    user, item = rng.integers(0, 60, 900), (rng.random(900) ** 2 * 40).astype(int)
    day = rng.integers(0, 200, 900)
    return materialize(spark.createDataFrame(
        [(int(u), int(i), float(1 + (u + i) % 5), int(d)) for u, i, d in zip(user, item, day)],
        "user_id long, item_id long, rating double, d int").select(
            "user_id", "item_id", "rating", F.timestamp_seconds(F.col("d") * 86400).alias("ts")), "test-ratings")


def _all(train):
    m = cooc.fit(train)
    c, support = cooc.cooccurrence(train)
    similar = [rows(cooc.similar_items(cooc.fit(train, kind=k, materialize=False), n=5)) for k in cooc.SIMILARITIES]
    grid = cooc.recommend_points(train, {0: ("jaccard", 30.0, True), 1: ("counts", None, False), 2: ("cosine", 7.0, True)}, 4)
    return [rows(cooc.recommend(m, n=4)), rows(cooc.recommend(m, n=4, remove_seen=False)), rows(c), rows(support), *similar, rows(grid)]


def test_rounds_change_no_row(ratings, monkeypatch):
    whole = _all(ratings)
    monkeypatch.setattr(cooc, "ROUND", 4_000)
    monkeypatch.setattr(cooc, "LEAST", 500)
    monkeypatch.setattr(scoring, "ROUND", 10_000)
    assert len(cooc.pair_rounds(ratings)[0]) > 1
    for a, b in zip(whole, _all(ratings)):
        assert [r[:-1] for r in a] == [r[:-1] for r in b]
        assert [r[-1] for r in a] == pytest.approx([r[-1] for r in b])


def test_lists_do_not_make_users_times_items():
    """500 users with 2 items of 100,000 each: 400 MB of scores before."""
    n = 100_000
    pack = lambda **c: scoring._pack(pa.table(c))
    at = np.arange(n)
    product = scoring._Product([pack(i=at, j=at[::-1].copy(), v=np.ones(n))], 3, [(0, 0, 0, True)])
    user = np.repeat(np.arange(500), 2)
    tracemalloc.start()
    found = list(product.lists([pack(u=user, i=np.arange(1000) * 7, v=np.ones(1000))]))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(map(len, found)) == 1000 and peak < 4e6


def test_best_of_rows_with_seen_ones():
    rng = np.random.default_rng(1)
    for _ in range(50):
        many = rng.integers(1, 300, 8)
        first = np.concatenate(([0], np.cumsum(many)))
        scores, known = np.round(rng.random(first[-1]) * 50) / 10, rng.random(first[-1]) < 0.3
        at = set(scoring._Ragged(first, 5).candidates(scores, known).tolist())
        for lo, hi in zip(first, first[1:]):
            place = sorted(range(lo, hi), key=lambda k: -scores[k])
            assert set(place[:5]) <= at and set([k for k in place if not known[k]][:5]) <= at


def test_packed_whole_numbers_come_back():
    x = np.array([5, 5, -3, 2**62, -2**62, 0, 1], np.int64)
    t = np.array([True, False, True, True, False, False, True])
    got = scoring._unpack(scoring._pack_whole({"x": x, "t": t, "s": np.array(list("abcdefg"), object), "y": x[::-1].copy()}))
    assert got[0].tolist() == x.tolist() and got[1].tolist() == t.tolist() and got[3].tolist() == x[::-1].tolist()
    assert got[2].tolist() == list("abcdefg")
    empty = scoring._unpack(scoring._pack_whole({"x": x[:0], "y": x[:0]}))
    assert [len(c) for c in empty] == [0, 0]


def test_shuffle_files_go_with_their_job(spark):
    disk = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    def left() -> int:
        files = disk.getAllFiles()
        return sum(files.apply(k).getName().endswith(".data") for k in range(files.size()))

    before = left()
    t = materialize(spark.range(1000).repartition(7, "id"), "shuffled")
    assert t.count() == 1000
    for _ in range(50):
        if left() <= before:
            break
        time.sleep(0.1)
    assert left() <= before


def test_factor_lists_in_rounds_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(5)
    factors = lambda key, n: materialize(spark.createDataFrame(
        [(k, [float(x) for x in rng.normal(size=4)]) for k in range(n)], f"{key} long, features array<float>"), "test-factors")
    users, items = factors("user_id", 200), factors("item_id", 70)
    seen = spark.createDataFrame([(u, int(i)) for u in range(200) for i in rng.integers(0, 70, 5)], "user_id long, item_id long")
    cores = spark.sparkContext.defaultParallelism
    once = rows(scoring.top_n_scores(users, items, 5, seen, user_block=200 // (3 * cores)))
    written, write = [], scoring.materialize
    monkeypatch.setattr(scoring, "materialize", lambda df, name: written.append(name) or write(df, name))
    monkeypatch.setattr(scoring, "ROUND", 1000)
    assert rows(scoring.top_n_scores(users, items, 5, seen, user_block=200 // (3 * cores))) == once
    assert written.count("lists") >= 3 and len(once) == 1000


def test_als_blocks_grow_with_the_ratings(ratings, monkeypatch):
    from affinis.models import als
    made = []
    monkeypatch.setattr(als, "ALS", lambda **k: made.append(k) or _Stop())
    for most in (4_000_000, 20):
        monkeypatch.setattr(als, "BLOCK_RATINGS", most)
        with pytest.raises(StopIteration):
            als.fit(ratings)
    n = ratings.select("user_id", "item_id").distinct().count()
    assert [(k["numUserBlocks"], k["numItemBlocks"]) for k in made] == [(10, 10), (-(-n // 20),) * 2]


class _Stop:
    def fit(self, df):
        raise StopIteration


def test_buckets_of_the_machine_are_bounded_by_their_links(ratings, monkeypatch):
    """A bucket held the links of all its entities, which grow with the blocks of pairs."""
    from affinis.models import fm, hybrid
    pairs = hybrid.training_pairs(ratings)
    whole = fm.train(pairs, 3, 2, 0.05)
    most, write = [], fm.materialize
    monkeypatch.setattr(fm, "materialize", lambda df, name, *a: _kept(write(df, name, *a), name, most))
    monkeypatch.setattr(fm, "LINKS", 100)
    parts = fm.train(pairs, 3, 2, 0.05)
    assert max(most) > 1
    for a, b in zip(whole, parts):
        for x, y in zip(rows(a), rows(b)):
            assert x[0] == y[0] and x[1] == pytest.approx(y[1], abs=1e-6)


def _kept(table, name, most):
    if name == "fm-state":
        most.append(table.select("at").where("kind = 0").distinct().count())
    return table


def test_scores_without_a_rating_hide_best_ones():
    """As when all targets had a score: NaN takes places of the list, n groups of columns with NaN leave none."""
    n, wide = 3, 60
    rng = np.random.default_rng(2)
    for many in (0, 1, 2, 40):
        scores = np.round(rng.random((5, wide)), 3)
        scores[1, rng.permutation(wide)[:many]] = np.nan
        want = [scoring.best_of(scores[[k]].copy(), np.array([k]), np.arange(wide), n)["item_id"].tolist() for k in range(5)]
        row, target = np.divmod(np.arange(5 * wide), wide)
        limit = scoring._nan_limits(scores.ravel(), row, 5, target, wide, n)
        got = []
        for k in range(5):
            at = [i for i in range(wide) if scores[k, i] >= limit[k]]
            got.append(sorted(at, key=lambda i: (-scores[k, i], i))[:n])
        assert got == want
