"""The conversation trie against plain Python."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from affinis.llm import prefix_trie


def by_hand(rows, group=100, shared=5):
    turns = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            turns[c].append((t is not None, t or 0, role or "", text or ""))
    own = {c: [x[2:] for x in sorted(v)] for c, v in turns.items()}
    made = {}
    for c, v in own.items():
        h = zlib.crc32(str(c).encode()) % (shared + 1)
        made[c] = tuple(own.get(c - c % group, [])[:h] + v[h:])
    members = defaultdict(list)
    for c in sorted(made):
        for d in range(len(made[c]) + 1):
            members[made[c][:d]].append(c)
    children = defaultdict(int)
    for p in members:
        if p:
            children[p[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (len(p[-1][1]) if p else 0)
    return sorted((m[0], len(p), members[p[:-1]][0] if p else -1, len(m), children[p], leaves[p], saved[p],
                   hashlib.sha256(",".join(str(c) for c in m if made[c] == p).encode()).hexdigest())
                  for p, m in members.items())


def run(spark, rows, **options):
    names = ("depth", "k1", "k2", "_part", "length", "chars", "weight", "n")
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string") \
        .withColumns({c: F.lit("x") for c in names}).repartition(4)
    out = prefix_trie.prefix_trie(df, **options)
    assert out.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                           "ends_sha256"]
    return sorted((r[0], r[1], -1 if r[2] is None else r[2], *r[3:]) for r in out.collect())


def talk(r, c, n, words="abé"):
    return [(c, t, r.choice(["user", "bot", None]), r.choice(words) * r.randrange(3)) for t in range(n)]


@pytest.mark.parametrize("seed,options", [(0, {}), (1, {"local": 6, "chunk": 3}), (2, {"local": 40, "chunk": 5}),
                                          (3, {"local": 1, "chunk": 2})])
def test_equals_brute_force(spark, seed, options):
    r = random.Random(seed)
    rows = [x for c in range(180) if c % 7 for x in talk(r, c * 3, r.randrange(0, 9))]
    rows += [x for c in range(600, 640) for x in talk(r, c, 12, "a")]
    assert run(spark, rows, **options) == by_hand(rows)


@pytest.mark.parametrize("local", [50, 1 << 16])
def test_one_conversation_holds_a_third(spark, local):
    r = random.Random(4)
    rows = [(700, t, "user", f"t{t}") for t in range(300)] + [(801, t, "user", f"t{t}") for t in range(290)]
    rows += [x for c in range(705, 760) for x in talk(r, c, 6)]
    rows += [(c, t, "user", "same") for c in range(1000, 1060) for t in range(3)]
    assert run(spark, rows, local=local, chunk=64) == by_hand(rows)


def test_cases(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (None, 1, "user", "x"), (2, None, None, None), (2, 5, "bot", "z"),
            (2, None, "", ""), (305, 1, "user", "long " * 50_000), (400, 7, "", ""), (401, 1, None, ""), (402, 1, None, "")]
    assert run(spark, rows) == by_hand(rows)
    assert run(spark, rows, local=2) == by_hand(rows)
    assert run(spark, [(None, 1, "user", "x")]) == [] and run(spark, []) == []
    # bases are missing and all own turns are among the first h: turnless members of the root
    alone = [(c, 0, "user", "q") for c in range(101, 130)]
    assert run(spark, alone) == by_hand(alone)


def test_a_component_settles_in_logarithmic_steps():
    """A path of 5000 nodes with a bush at each: totals equal those of a walk from the leaves."""
    n = 5000
    conv = np.concatenate((np.zeros(n, np.int64), np.arange(1, n + 1)))
    depth = np.concatenate((np.arange(n), np.arange(1, n + 1)))
    up = np.zeros(2 * n, np.int64)
    weight = np.concatenate((2 * np.arange(n, 0, -1), np.ones(n, np.int64)))
    value = np.random.default_rng(0).integers(0, 9, 2 * n)
    top = (conv == 0) & (depth == 0)
    got, = prefix_trie.settle(conv, depth, up, top, weight, [value])
    want = value.copy()
    for d in range(n - 1, -1, -1):
        want[d] += value[n + d] + (want[d + 1] if d + 1 < n else 0)
    assert got.tolist() == want.tolist()
