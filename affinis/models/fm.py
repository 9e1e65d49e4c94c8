"""Factorisation machine on (user, item) pairs, trained without a vector per id on the driver.

The model, the objective and the optimiser are those of Spark ML's
``FMClassifier``: logistic loss averaged over all pairs, full gradients,
AdamW without penalty (its step test, a change below 1e-6 of the norm, is
left out), factors from a normal distribution of 0.01, linear terms from 0.
Start factors depend on the feature and the seed only.

An entity (user or item) has a feature of its own and attribute features.
With V and a the sum of an entity's factors, and of its linear terms and
inner pairs, the logit of a pair is a_u + a_i + <V_u, V_i> (the intercept is
an attribute of the users without factors).  With g the slope of a pair's
loss, the gradients of a feature f are the sums of g and of
g (V_u + V_i - v_f) over its pairs: an entity needs from its pairs the sums
G of g and T of g (V_u + V_i) only, an attribute those of its entities.

An iteration is two jobs.  In the first buckets of entities send V and a
to the blocks of pairs that have them, blocks send back T and G, and buckets
step their own features and give parts of T and G by attribute; in the
second the attributes step.  Messages are packed, one for each bucket and
block, in 32-bit floats; parameters are 64-bit.  A block has whole users,
whose pairs differ, so that a user adds at most the number of items twice.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.prep import dense_index
from ..session import drop_intermediates, materialize
from .grid_mf import normals

#: Pairs of a block on average at most and at least, parameters of a bucket, entities of a bucket at least.
PAIRS, LEAST_PAIRS, NUMBERS, LEAST = 1_500_000, 20_000, 4_000_000, 2000
#: Links of a bucket on average at most (its entities have one to each block that they are in).
LINKS = 3_000_000
#: Numbers of a block that are worked on at once, buckets of attributes.
STEP, ATTRIBUTE_BUCKETS = 2_000_000, 16
STD, BETA1, BETA2, EPSILON = 0.01, 0.9, 0.999, 1e-8
#: The intercept among the attributes.
INTERCEPT = 0
_STATE = "kind int, at long, a binary, b binary, c binary, d binary, e binary"
_NAMES = ["kind", "at", "a", "b", "c", "d", "e"]
_BUCKET, _ATTRIBUTE = 0, 1


@dataclass
class Pairs:
    """Training pairs in blocks and what the entities have, written once; independent of the model's size."""

    users: DataFrame      # user_id, _e
    items: DataFrame      # item_id, _e
    blocks: DataFrame     # block, u, i, y (packed)
    links: DataFrame      # e, kind (0 itself, 1 a block, 2 an attribute), x
    attributes: DataFrame  # feature, f
    n: int
    entities: int


def prepare(pairs: DataFrame, known: DataFrame, user_features: DataFrame, item_features: DataFrame) -> Pairs:
    """Index and block ``pairs(user_id, item_id, label)``.

    ``known(user_id, item_id)`` has all entities; ``user_features(user_id,
    feature)`` and ``item_features(item_id, feature)`` the attributes.
    """
    # users have even numbers, items odd ones
    users, items = (materialize(dense_index(known, key, "_x").select(key, (F.col("_x").cast("long") * 2 + odd).alias("_e")), "fm-index")
                    for key, odd in (("user_id", 0), ("item_id", 1)))
    features = [user_features.join(users, "user_id"), item_features.join(items, "item_id")]
    names = features[0].select("feature").union(features[1].select("feature"))
    attributes = materialize(dense_index(names, "feature", "_f").select("feature", (F.col("_f").cast("long") + 1).alias("f")), "fm-attributes")
    numbered = materialize(pairs.join(users.withColumnRenamed("_e", "u"), "user_id").join(items.withColumnRenamed("_e", "i"), "item_id")
                           .select("u", "i", F.col("label").cast("double").alias("y")), "fm-pairs")
    n = numbered.count()
    cores = numbered.sparkSession.sparkContext.defaultParallelism
    blocks = max(1, math.ceil(n / PAIRS), min(cores, n // LEAST_PAIRS))
    placed = numbered.withColumn("block", F.pmod(F.xxhash64("u"), F.lit(blocks)))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["u", "i"])
        return pd.DataFrame({"block": g["block"].iloc[:1].to_numpy(), "u": [g["u"].to_numpy(np.uint32).tobytes()],
                             "i": [g["i"].to_numpy(np.uint32).tobytes()], "y": [g["y"].to_numpy(np.float32).tobytes()]})

    packed = materialize(placed.groupBy("block").applyInPandas(pack, "block long, u binary, i binary, y binary"), "fm-blocks")
    link = lambda df, e, kind, x: df.select(F.col(e).cast("long").alias("e"), F.lit(kind).alias("kind"), x.cast("long").alias("x"))
    parts = [link(users, "_e", 0, F.lit(0)), link(items, "_e", 0, F.lit(0)), link(users, "_e", 2, F.lit(INTERCEPT))]
    parts += [link(placed.select(side, "block").distinct(), side, 1, F.col("block")) for side in ("u", "i")]
    parts += [link(f.join(attributes, "feature").select("_e", "f").distinct(), "_e", 2, F.col("f")) for f in features]
    links = parts[0]
    for p in parts[1:]:
        links = links.union(p)
    return Pairs(users, items, packed, materialize(links, "fm-links"), attributes, n, users.count() + items.count())


def _numbers(packed: bytes, wide: int, kind=np.float64) -> np.ndarray:
    return np.frombuffer(packed, kind).reshape(-1, wide).astype(np.float64)


def _add(total: np.ndarray, at: np.ndarray, values: np.ndarray) -> None:
    """Add rows of ``values`` to the rows ``at`` of ``total``."""
    if len(at):
        order = np.argsort(at, kind="stable")
        s = at[order]
        first = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        total[s[first]] += np.add.reduceat(values[order], first, axis=0)


def adam(theta: np.ndarray, m: np.ndarray, v: np.ndarray, slope: np.ndarray, step: float, t: int) -> tuple[np.ndarray, ...]:
    """Parameters and moments after step ``t`` (from 1)."""
    m, v = BETA1 * m + (1 - BETA1) * slope, BETA2 * v + (1 - BETA2) * slope ** 2
    return theta - step * (m / (1 - BETA1 ** t)) / (np.sqrt(v / (1 - BETA2 ** t)) + EPSILON), m, v


def block_sums(u: np.ndarray, i: np.ndarray, y: np.ndarray, sent: np.ndarray, n: int) -> np.ndarray:
    """(T, G) of the entities from their (V, a) in ``sent`` and the pairs of a block, ``u`` and ``i`` places in it."""
    out = np.zeros(sent.shape)
    rows = max(1, STEP // sent.shape[1])
    for at in range(0, len(u), rows):
        uu, ii = u[at:at + rows], i[at:at + rows]
        p, q = sent[uu].astype(np.float64), sent[ii].astype(np.float64)
        logit = p[:, -1] + q[:, -1] + np.einsum("nk,nk->n", p[:, :-1], q[:, :-1])
        g = (1 / (1 + np.exp(-np.clip(logit, -700, 700))) - y[at:at + rows]) / n
        p += q
        p[:, -1] = 1.0
        p *= g[:, None]
        _add(out, uu, p)
        _add(out, ii, p)
    return out


def train(data: Pairs, factors: int, iterations: int, step: float, seed: int = 7) -> tuple[DataFrame, DataFrame]:
    """``(user_id, features)`` and ``(item_id, features, bias)`` after full-batch AdamW steps."""
    spark, n, wide = data.links.sparkSession, data.n, factors + 1
    cores = spark.sparkContext.defaultParallelism
    buckets = max(1, math.ceil(data.entities * wide / NUMBERS), math.ceil(data.links.count() / LINKS),
                  min(cores, data.entities // LEAST))

    def start(numbers: np.ndarray, salt: int) -> np.ndarray:
        return np.column_stack((STD * normals(numbers, factors, seed + salt), np.zeros(len(numbers))))

    def pack(g: pd.DataFrame) -> pd.DataFrame:
        kind, e, x = (g[c].to_numpy() for c in ("kind", "e", "x"))
        own = np.sort(e[kind == 0])
        links = [np.column_stack((np.searchsorted(own, e[kind == k]), x[kind == k])) for k in (1, 2)]
        theta = start(own, 0)
        # an entity without pairs has no feature of its own
        theta[np.setdiff1d(np.arange(len(own)), links[0][:, 0])] = 0.0
        zero = np.zeros(theta.shape)
        return pd.DataFrame([(_BUCKET, int(g["_bucket"].iloc[0]), own.tobytes(), *(np.ascontiguousarray(k, np.int64).tobytes() for k in links),
                              np.stack((theta, zero, zero)).tobytes(), None)], columns=_NAMES)

    def start_attributes(batches):
        for g in batches:
            f = g["f"].to_numpy()
            theta = start(f, 1)
            theta[f == INTERCEPT] = 0.0
            yield pd.DataFrame({"f": f, "p": [np.concatenate((x, np.zeros(2 * wide))).tobytes() for x in theta]})

    state = materialize(data.links.withColumn("_bucket", F.pmod(F.xxhash64("e"), F.lit(buckets))).groupBy("_bucket").applyInPandas(pack, _STATE), "fm-state")
    ids = data.attributes.select("f").union(spark.range(INTERCEPT, INTERCEPT + 1).toDF("f"))
    attributes = materialize(ids.mapInPandas(start_attributes, "f long, p binary"), "fm-steps")
    needs = materialize(data.links.where("kind = 2").select(F.pmod(F.xxhash64("e"), F.lit(buckets)).alias("at"), F.col("x").alias("f")).distinct(), "fm-needs")

    def sums(row, given: pd.DataFrame) -> tuple[np.ndarray, ...]:
        """Numbers of a bucket's entities, their routes and attributes, and (V, a)."""
        own, routes, has = (np.frombuffer(row[c], np.int64) for c in "abc")
        routes, has = routes.reshape(-1, 2), has.reshape(-1, 2)
        theta = _numbers(row["d"], wide)[:len(own)]
        given = given.sort_values("f")
        p = np.stack([np.frombuffer(x, np.float64)[:wide] for x in given["p"]]) if len(given) else np.zeros((0, wide))
        p = p[np.searchsorted(given["f"].to_numpy(), has[:, 1])]
        total, square = theta.copy(), theta[:, :-1] ** 2
        _add(total, has[:, 0], p)
        _add(square, has[:, 0], p[:, :-1] ** 2)
        total[:, -1] += 0.5 * (total[:, :-1] ** 2 - square).sum(1)
        return own, routes, has, total

    def send(state_row: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(state_row):
            return pd.DataFrame({"block": [], "at": [], "e": [], "v": []})
        own, routes, _, total = sums(state_row.iloc[0], given)
        routes = routes[np.lexsort((routes[:, 0], routes[:, 1]))]
        cuts = np.flatnonzero(np.diff(routes[:, 1])) + 1
        return pd.DataFrame([(int(r[0, 1]), int(state_row["at"].iloc[0]), own[r[:, 0]].astype(np.uint32).tobytes(),
                              total[r[:, 0]].astype(np.float32).tobytes()) for r in np.split(routes, cuts) if len(r)],
                            columns=["block", "at", "e", "v"])

    def slopes(block: pd.DataFrame, sent: pd.DataFrame) -> pd.DataFrame:
        if not len(block):
            return pd.DataFrame({"at": [], "e": [], "g": []})
        u, i, y = (np.frombuffer(block[c].iloc[0], kind) for c, kind in (("u", np.uint32), ("i", np.uint32), ("y", np.float32)))
        e = np.frombuffer(b"".join(sent["e"]), np.uint32)
        v = np.frombuffer(b"".join(sent["v"]), np.float32).reshape(len(e), wide)
        order = np.argsort(e)
        place = lambda x: order[np.searchsorted(e, x, sorter=order)]
        out = block_sums(place(u), place(i), y, v, n).astype(np.float32)
        ends = np.cumsum([len(x) // 4 for x in sent["e"]])[:-1]
        return pd.DataFrame({"at": sent["at"].to_numpy(), "e": sent["e"].to_numpy(), "g": [x.tobytes() for x in np.split(out, ends)]})

    def stepper(t: int):
        def update(state_row: pd.DataFrame, back: pd.DataFrame) -> pd.DataFrame:
            row = state_row.iloc[0]
            own, has = np.frombuffer(row["a"], np.int64), np.frombuffer(row["c"], np.int64).reshape(-1, 2)
            total = np.zeros((len(own), wide))
            for e, g in zip(back["e"], back["g"]):
                total[np.searchsorted(own, np.frombuffer(e, np.uint32).astype(np.int64))] += _numbers(g, wide, np.float32)
            theta, m, v = np.frombuffer(row["d"], np.float64).reshape(3, len(own), wide)
            slope = total.copy()
            slope[:, :-1] -= total[:, -1:] * theta[:, :-1]
            new = np.stack(adam(theta, m, v, slope, step, t))
            f, at = np.unique(has[:, 1], return_inverse=True)
            parts = np.zeros((len(f), wide))
            _add(parts, at, total[has[:, 0]])
            return pd.DataFrame([(_BUCKET, row["at"], row["a"], row["b"], row["c"], new.tobytes(), None)]
                                + [(_ATTRIBUTE, int(k), None, None, None, None, p.tobytes()) for k, p in zip(f, parts)], columns=_NAMES)

        def update_attributes(now: pd.DataFrame, parts: pd.DataFrame) -> pd.DataFrame:
            now = now.sort_values("f")
            f = now["f"].to_numpy()
            total = np.zeros((len(f), wide))
            if len(parts):
                parts = parts.sort_values(["at", "e"])
                _add(total, np.searchsorted(f, parts["at"].to_numpy()), np.stack([np.frombuffer(x, np.float64) for x in parts["e"]]))
            theta, m, v = np.stack([np.frombuffer(x, np.float64) for x in now["p"]]).reshape(len(f), 3, wide).transpose(1, 0, 2)
            slope = total.copy()
            slope[:, :-1] -= total[:, -1:] * theta[:, :-1]
            slope[f == INTERCEPT, :-1] = 0.0
            new = np.stack(adam(theta, m, v, slope, step, t), 1)
            return pd.DataFrame({"f": f, "p": [x.tobytes() for x in new]})

        return update, update_attributes

    def given_to(state: DataFrame, attributes: DataFrame):
        given = needs.join(attributes, "f").select("at", "f", "p")
        return state.where(F.col("kind") == _BUCKET).groupBy("at").cogroup(given.groupBy("at"))

    for t in range(1, iterations + 1):
        update, update_attributes = stepper(t)
        sent = given_to(state, attributes).applyInPandas(send, "block long, at long, e binary, v binary")
        back = data.blocks.groupBy("block").cogroup(sent.groupBy("block")).applyInPandas(slopes, "at long, e binary, g binary")
        new = materialize(state.where(F.col("kind") == _BUCKET).groupBy("at").cogroup(back.groupBy("at")).applyInPandas(update, _STATE), "fm-state")
        bucket = lambda c: F.pmod(F.xxhash64(c), F.lit(ATTRIBUTE_BUCKETS)).alias("_b")
        parts = new.where(F.col("kind") == _ATTRIBUTE).select("at", "e")
        stepped = materialize(attributes.groupBy(bucket("f")).cogroup(parts.groupBy(bucket("at")))
                              .applyInPandas(update_attributes, "f long, p binary"), "fm-steps")
        # the tables of the iteration before are not read again
        _drop(state, attributes)
        state, attributes = new, stepped

    def last(state_row: pd.DataFrame, given: pd.DataFrame) -> pd.DataFrame:
        if not len(state_row):
            return pd.DataFrame({"_e": [], "features": [], "bias": []})
        own, routes, has, total = sums(state_row.iloc[0], given)
        keep = np.union1d(routes[:, 0], has[has[:, 1] != INTERCEPT, 0]).astype(int)
        return pd.DataFrame({"_e": own[keep], "features": list(total[keep, :-1]), "bias": total[keep, -1]})

    vectors = materialize(given_to(state, attributes).applyInPandas(last, "_e long, features array<double>, bias double"), "fm-vectors")
    return (vectors.join(data.users, "_e").select("user_id", "features"),
            vectors.join(data.items, "_e").select("item_id", "features", "bias"))


def _drop(*tables: DataFrame) -> None:
    """Delete written tables of the iteration before."""
    spark = tables[0].sparkSession
    folders = {f.rsplit("/", 1)[0] for t in tables for f in t.inputFiles()}
    names = {f.rstrip("/").rsplit("/", 1)[1] for f in folders}
    drop_intermediates(spark, named=names)
