"""Checksums by position and importance resampling against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from affinis.llm import crc, importance

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def runs(text, low, high):
    w = WORD.findall((text or "").translate(LOWER))
    return [" ".join(w[i:i + n]) for n in range(low, high + 1) for i in range(len(w) - n + 1)]


def bucket(run, m=importance.BUCKETS):
    return zlib.crc32(run.encode()) % m


@settings(max_examples=60, deadline=None)
@given(st.lists(st.binary(max_size=700), max_size=12))
def test_checksums_equal_the_library(spans):
    end = np.cumsum([len(s) for s in spans], dtype=np.int64)
    start = end - [len(s) for s in spans]
    got = crc.span_crcs(np.frombuffer(b"".join(spans), np.uint8), start.astype(np.int64), end)
    assert got.tolist() == [zlib.crc32(s) for s in spans]


@pytest.mark.parametrize("n", [255, 256, 257, 511, 512, 513, 256 * 4096 - 1, 256 * 4096, 256 * 4096 + 5, 3_000_001])
def test_long_spans_fold_by_blocks(n):
    data = np.random.default_rng(n).integers(0, 256, n, dtype=np.uint8)
    assert crc.span_crcs(data, np.array([0]), np.array([n]))[0] == zlib.crc32(data.tobytes())


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2), (2, 3)])
def test_runs_of_short_and_long_texts(low, high, monkeypatch):
    monkeypatch.setattr(importance, "PIECE", 200)
    r = random.Random(low * 10 + high)
    texts = [None, "", " -- ", "One", "One TWO", "É é ß İ 日本 x1y2", "a" * 900, "a" * 900 + " b " + "c" * 450 + " d"]
    texts += [" ".join("W" + str(r.randrange(50)) * r.randrange(1, 60) for _ in range(r.randrange(0, 80)))
              + "-" * r.randrange(0, 500) for _ in range(60)]
    import pyarrow as pa
    got = [Counter() for _ in texts]
    words = [0] * len(texts)
    for x, y, who, what, n in importance._features(pa.array(texts, pa.string()), low, high, 997):
        for d, b in zip(who, what):
            got[x + d][int(b)] += 1
        for k in range(y - x):
            words[x + k] += int(n[k])
    assert got == [Counter(bucket(f, 997) for f in runs(t, low, high)) for t in texts]
    assert words == [len(WORD.findall((t or "").translate(LOWER))) for t in texts]


def by_hand(docs, target, low=1, high=1):
    s, t = (Counter(bucket(f) for x in side for f in runs(x, low, high)) for side in ([d for _, d in docs], target))
    big_s, big_t = sum(s.values()), sum(t.values())
    gain = {b: math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in s}
    rows = []
    for i, text in docs:
        f = runs(text, low, high)
        weight = sum(gain[bucket(x)] for x in f)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append((i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))),
                     len(WORD.findall((text or "").translate(LOWER)))))
    enough = sorted((r for r in rows if r[4] >= 20), key=lambda r: (-r[3], -1 if r[0] is None else r[0]))
    drawn = Counter()
    ranks = {}
    for k, r in enumerate(enough[:len(enough) * 10 // 100]):
        ranks[r[:4], drawn[r[:4]]] = k + 1
        drawn[r[:4]] += 1
    return rows, sorted(ranks.values()), {k[0] for k in ranks}


@pytest.mark.parametrize("low,high", [(1, 1), (1, 2)])
def test_cases(spark, low, high):
    r = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma", "dé", "x", "1999", "日本"]
    docs = [(i, " ".join(r.choice(vocabulary) for _ in range(r.choice([0, 5, 20, 40, 80])))) for i in range(150)]
    docs += [(3, docs[3][1]), (3, "another text of this id " * 9), (None, "a null id " * 10), (None, None), (900, None),
             (901, ""), (902, "\x00 \x01"), (903, "long " * 60_000), (904, "x" * 300_000 + " y" * 30)]
    target = ["alpha beta", None, "", "gamma 1999 gamma"]
    kind = "doc_id long, text string"
    names = ("rank", "score", "weight", "bucket", "n", "t", "s", "_at", "_most", "n_words")
    df = spark.createDataFrame(docs, kind).withColumns({c: F.lit("7") for c in names}).repartition(5)
    goal = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, goal, low, high)
    assert got.columns == ["doc_id", "n_features", "n_words", "weight", "score", "rank"]
    got = got.collect()
    rows, ranks, drawn = by_hand(docs, target, low, high)
    key = lambda x: (x[0] is None, x[0] or 0, *x[1:])
    assert sorted(((g.doc_id, g.n_features, g.weight, g.score, g.n_words) for g in got), key=key) == sorted(rows, key=key)
    assert sorted(g.rank for g in got if g.rank) == ranks
    assert {(g.doc_id, g.n_features, g.weight, g.score) for g in got if g.rank} == drawn
    assert importance.resample(df.where("false"), goal).count() == 0
    assert {x.weight for x in importance.resample(df, goal.where("false")).where("n_features = 0").collect()} == {0}
