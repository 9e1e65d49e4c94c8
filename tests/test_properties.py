"""Property checks against brute force on small random fixtures
(hypothesis-generated interaction sets)."""

import datetime as dt
import math
from collections import Counter, defaultdict

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from affinis.models import cooccurrence as cooc
from affinis.models import popularity as popm
from affinis.operators import metrics, prep
from conftest import rows

pairs_st = st.lists(st.tuples(st.integers(0, 6), st.integers(0, 9), st.integers(1, 5), st.integers(0, 30)),
                    min_size=1, max_size=40)
SETTINGS = settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))


def frame(spark, data):
    return spark.createDataFrame(
        [(u, i, float(r), dt.datetime(2024, 1, 1) + dt.timedelta(hours=t)) for u, i, r, t in data],
        "user_id long, item_id long, rating double, ts timestamp")


@SETTINGS
@given(pairs_st, st.integers(1, 4))
def test_popularity_matches_brute_force(spark, data, n):
    df = frame(spark, data)
    got = rows(popm.recommend(popm.fit(df), n=n), "user_id", "rank", "item_id")
    pop = Counter(i for _, i, _, _ in data)
    order = sorted(pop, key=lambda i: (-pop[i], i))
    seen = defaultdict(set)
    for u, i, _, _ in data:
        seen[u].add(i)
    exp = sorted((u, k + 1, i) for u in seen for k, i in enumerate([x for x in order if x not in seen[u]][:n]))
    assert got == exp


@SETTINGS
@given(pairs_st)
def test_cooccurrence_matches_brute_force(spark, data):
    df = frame(spark, data)
    c, s = cooc.cooccurrence(df, chunk=2)   # tiny chunks: every user is split
    a = defaultdict(Counter)
    for u, i, _, _ in data:
        a[u][i] += 1
    exp = Counter()
    for items in a.values():
        for i in items:
            for j in items:
                if i < j:
                    exp[(i, j)] += items[i] * items[j]
    assert rows(c) == sorted((i, j, v) for (i, j), v in exp.items())
    sup = Counter()
    for items in a.values():
        for i, k in items.items():
            sup[i] += k * k
    assert rows(s) == sorted(sup.items())


@SETTINGS
@given(pairs_st, st.sampled_from([0.1, 0.2, 0.5]))
def test_time_split_is_exact_prefix(spark, data, test_size):
    df = frame(spark, data)
    s = prep.time_split(df, test_size)
    got = rows(s, "ts", "user_id", "item_id", "rating", "split")
    cut = int((1 - test_size) * len(data))
    exp_order = sorted(got, key=lambda r: (r[0], r[1], r[2], r[3]))
    assert [r[4] for r in exp_order] == ["train"] * cut + ["test"] * (len(data) - cut)


@SETTINGS
@given(pairs_st)
def test_metrics_bounded_and_recs_unseen(spark, data):
    df = frame(spark, data)
    m = popm.fit(df)
    recs = popm.recommend(m, n=3)
    seen = {(u, i) for u, i, _, _ in data}
    assert not ({(r[0], r[1]) for r in rows(recs, "user_id", "item_id")} & seen)
    ranks = defaultdict(list)
    for u, r in rows(recs, "user_id", "rank"):
        ranks[u].append(r)
    assert all(v == list(range(1, len(v) + 1)) for v in ranks.values())
    row = metrics.ranking_metrics(recs, df, 3).collect()[0]
    for k in ("precision_at_k", "recall_at_k", "ndcg_at_k", "map_at_k"):
        assert 0.0 <= row[k] <= 1.0 and not math.isnan(row[k])
