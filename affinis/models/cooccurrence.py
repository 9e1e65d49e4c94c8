"""Item co-occurrence recommender (M4-M8): similarity x affinity.

Co-occurrence C = A^T A with A[u, i] = number of rows of (u, i) (the
sparse product of the reference sums duplicates), so
c_ij = sum_u n_ui n_uj and the support c_ii = sum_u n_ui^2.

Scale plan for C (J5)
---------------------
C has sum_u h_u^2 increments, and few pairs occur twice, so pairs are not
shuffled.  Items are hashed to blocks of about ``INCREMENTS`` increments;
the packed history of a user goes once to each block that it has an item
in, with the supports of its items.  A block is summed in one task, a
bounded number of increments at a time, which holds its own rows of C only.
The result stays packed by block (``pair_cells``): similarities, lists of
similar items and products are made from the cells, without another
shuffle of pairs.  A user's history is whole in one task, at most one row
an item; its pairs are spread over the blocks of its items.

Scoring (J6) streams the users past groups of cells
(``scoring.products_of_cells``); given candidates are scored by joins, so
that only their terms are made.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, LongType, StructField, StructType

from ..functions.expr import epoch_seconds
from ..operators.ranking import top_n
from ..session import materialize as materialize_table
from .scoring import DIGITS, _block, _groups, _pack_whole, _unpack, grid_products, products_of_cells, top_n_products

SIMILARITIES = ("jaccard", "cosine", "lift", "counts")
#: Pair increments of a block on average, least of a block, and blocks for each core if they have these.
INCREMENTS, LEAST, BLOCKS = 8_000_000, 200_000, 4
#: Pairs in a packed cell at most, and increments that are expanded at once.
CELL, STEP = 500_000, 4_000_000
#: Increments of a round.
ROUND = 400_000_000
#: Rows of histories that are packed together for each block there is, and at most.
ROWS, MOST = 256, 2_000_000


@dataclass
class CooccurrenceModel:
    sim_half: DataFrame     # i < j, sim  (the stored, symmetric half)
    affinity: DataFrame     # user_id, item_id, affinity
    support: DataFrame      # item_id, support (c_ii)
    popularity: DataFrame   # item_id, popularity (share of rows)
    cells: DataFrame | None = None  # packed rows of C by block, as ``pair_cells`` makes them
    kind: str = "jaccard"
    rounds: list[DataFrame] | None = None  # ``cells`` in parts that are made one after the other

    @property
    def similarity(self) -> DataFrame:
        """``(i, j, sim)`` in both directions (mirror added lazily)."""
        h = self.sim_half
        return h.unionByName(h.select(F.col("j").alias("i"), F.col("i").alias("j"), "sim"))

    def save(self, path: str, mode: str = "overwrite") -> None:
        """Model tables to Parquet."""
        for name in ("sim_half", "affinity", "support", "popularity"):
            getattr(self, name).write.mode(mode).parquet(f"{path}/{name}")

    @classmethod
    def load(cls, spark, path: str) -> "CooccurrenceModel":
        return cls(*(spark.read.parquet(f"{path}/{n}") for n in
                     ("sim_half", "affinity", "support", "popularity")))


def user_item_counts(train: DataFrame) -> DataFrame:
    """A as coordinates: (user_id, item_id, n) with n = rows per pair."""
    return train.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))


def _sums(i: np.ndarray, j: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (i, j) in order, with their sums of ``c``; i and j are numbers from 0."""
    wide = int(j.max()) + 1 if len(j) else 1
    key = i.astype(np.int64) * wide + j
    if (c == 1).all():
        key = np.sort(key)
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, int)
        total = np.diff(np.append(first, len(key)))
    else:
        order = np.argsort(key, kind="stable")
        key = key[order]
        first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
        total = np.add.reduceat(c[order], first)
    return *np.divmod(key[first], wide), total


class _Block:
    """Rows of C of one block of items, summed from packed histories."""

    def __init__(self):
        self.items = self.support = None
        self.i = self.j = self.c = np.zeros(0, np.int64)
        self.waiting, self.size = [], 0

    def take(self, packed: bytes) -> None:
        part = _unpack(packed)
        self.waiting.append(part)
        # the increments of the part: a row of the block meets its user's whole history
        self.size += int(np.bincount(part[0])[part[0][part[4]]].sum())
        if self.size >= 2 * INCREMENTS:
            self.add()

    def add(self) -> None:
        """Add what waits; items get numbers in id order."""
        if not self.waiting:
            return
        item = np.concatenate([p[1] for p in self.waiting] + ([] if self.items is None else [self.items]))
        support = np.concatenate([p[3] for p in self.waiting] + ([] if self.items is None else [self.support]))
        code, ids = pd.factorize(item, sort=True)
        self.support = np.zeros(len(ids), np.int64)
        self.support[code] = support
        if self.items is not None:
            old = code[len(code) - len(self.items):]
            self.i, self.j = old[self.i], old[self.j]
        self.items = np.asarray(ids)
        found, at = [(self.i, self.j, self.c)], 0
        for user, item, n, _, own in self.waiting:
            codes, at = code[at:at + len(item)], at + len(item)
            first = np.flatnonzero(np.concatenate(([True], user[1:] != user[:-1])))
            many = np.diff(np.append(first, len(user)))
            of = np.cumsum(np.concatenate(([False], user[1:] != user[:-1])))
            own = np.flatnonzero(own)
            ends = np.cumsum(many[of[own]])
            cuts = np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP), "right").tolist()
            for lo, hi in zip([0, *cuts], [*cuts, len(own)]):
                left = own[lo:hi]
                m = many[of[left]]
                right = np.repeat(first[of[left]] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
                left = np.repeat(left, m)
                other = left != right
                left, right = left[other], right[other]
                found.append(_sums(codes[left], codes[right], n[left] * n[right]))
        self.i, self.j, self.c = _sums(*(np.concatenate(x) for x in zip(*found)))
        self.waiting, self.size = [], 0

    def cells(self) -> Iterator[dict[str, np.ndarray]]:
        """Parts of the rows: columns i, j, c and the supports si, sj, by (i, j)."""
        self.add()
        for at in range(0, len(self.c), CELL):
            i, j = self.i[at:at + CELL], self.j[at:at + CELL]
            yield {"i": self.items[i], "j": self.items[j], "c": self.c[at:at + CELL],
                            "si": self.support[i], "sj": self.support[j]}


def _together(blocks: int) -> int:
    """Rows of histories that are packed together for so many blocks."""
    return max(4096, min(ROWS * blocks, MOST))


def _whole(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.Table]:
    """Rows that come by user, about ``chunk`` at a time, each user's together."""
    rest = None
    for b in batches:
        if not b.num_rows:
            continue
        t = pa.Table.from_batches([b]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([b])])
        rest = t
        if t.num_rows >= chunk:
            # the last user may go on
            user = b.column("user_id").to_numpy(zero_copy_only=False)
            whole = t.num_rows - b.num_rows + int(np.flatnonzero(user != user[-1])[-1]) + 1 if (user != user[-1]).any() else 0
            if whole:
                yield t.slice(0, whole)
                rest = t.slice(whole)
    if rest is not None and rest.num_rows:
        yield rest


def _columns(t: pa.Table) -> tuple[np.ndarray, ...]:
    """Users as numbers from 0, items, n, supports and blocks."""
    block, item, n, support = (t.column(c).to_numpy() for c in ("block", "item_id", "n", "support"))
    return pd.factorize(t.column("user_id").to_numpy())[0], item, n, support, block


def _deal(user: np.ndarray, item: np.ndarray, n: np.ndarray, support: np.ndarray, block: np.ndarray,
          blocks: tuple[int, int] | None = None) -> Iterator[pa.RecordBatch]:
    """(block, packed): the histories of the users with items in a block, for all blocks or those from the first up to the second.

    Packed are the user, the item, n, the support, and whether the item is of the block.
    """
    first = np.flatnonzero(np.concatenate(([True], user[1:] != user[:-1])))
    many = np.diff(np.append(first, len(user)))
    wide = len(first)
    key = block.astype(np.int64) * wide + user
    if blocks is not None:
        key = key[(block >= blocks[0]) & (block < blocks[1])]
    to, who = np.divmod(np.unique(key), wide)
    cuts = np.concatenate(([0], np.flatnonzero(np.diff(to)) + 1, [len(to)])) if len(to) else [0]
    for lo, hi in zip(cuts, cuts[1:]):
        u = who[lo:hi]
        m = many[u]
        at = np.repeat(first[u] - np.cumsum(m) + m, m) + np.arange(int(m.sum()))
        part = _pack_whole({"user": np.repeat(np.arange(len(u)), m), "item": item[at], "n": n[at], "support": support[at],
                            "own": block[at] == to[lo]})
        yield pa.RecordBatch.from_arrays([pa.array([to[lo]], pa.int64()), pa.array([part], pa.binary())], names=["block", "packed"])


def _histories(batches: Iterator[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    """(block, packed) of rows that come by user, about ``chunk`` packed together."""
    for t in _whole(batches, chunk):
        yield from _deal(*_columns(t))


def supports(train: DataFrame) -> DataFrame:
    """``(item_id, support)``."""
    return user_item_counts(train).groupBy("item_id").agg(F.sum(F.col("n") * F.col("n")).alias("support"))


def pair_rounds(train: DataFrame, chunk: int | None = None) -> tuple[list[DataFrame], DataFrame]:
    """M4, packed: ``(cell, size, packed)``, some blocks at a time, and ``(item_id, support)``.

    A packed row has pairs (i, j, c, si, sj) of the items i of block
    ``cell``, in both directions over all cells; ``size`` is their number.
    About ``chunk`` rows of histories are packed together; if not given, the
    more the more blocks there are: they are dealt to all blocks, and many
    small parts would cost more than their pairs.  A round has about
    ``ROUND`` increments, so that the histories of all blocks do not lie on
    disk at once if its results are written before the next.
    """
    spark = train.sparkSession
    a = user_item_counts(train)
    support = supports(train)
    known = a.where(F.col("user_id").isNotNull())
    h = known.groupBy("user_id").agg(F.count(F.lit(1)).cast("double").alias("_h"))
    total = h.agg(F.coalesce(F.sum(F.col("_h") * F.col("_h")), F.lit(0.0))).first()[0]
    few = min(BLOCKS * spark.sparkContext.defaultParallelism, total // LEAST)
    blocks = int(max(1, few, math.ceil(total / INCREMENTS)))
    rounds = max(1, math.ceil(total / ROUND))
    tasks = min(blocks, 16 * spark.sparkContext.defaultParallelism)
    together = chunk or _together(blocks)
    rows = known.join(support, "item_id").withColumn("block", _block("item_id", blocks)) \
        .select("user_id", "item_id", "n", "support", "block").repartition(tasks, "user_id").sortWithinPartitions("user_id", "item_id")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, _Block()

        def done() -> Iterator[pa.RecordBatch]:
            for t in held.cells():
                yield pa.RecordBatch.from_arrays([pa.array([now], pa.int64()), pa.array([len(t["i"])], pa.int64()),
                                                  pa.array([_pack_whole(t)], pa.binary())], names=["cell", "size", "packed"])

        for b in batches:
            for block, packed in zip(b.column("block").to_pylist(), b.column("packed").to_pylist()):
                if block != now:
                    yield from done()
                    now, held = block, _Block()
                held.take(packed)
        yield from done()

    def summed(sent: DataFrame, tasks: int) -> DataFrame:
        return sent.repartitionById(tasks, F.pmod("block", F.lit(tasks)).cast("int")).sortWithinPartitions("block") \
            .mapInArrow(add, "cell long, size long, packed binary")

    if rounds == 1:
        return [summed(rows.mapInArrow(lambda batches: _histories(batches, together), "block long, packed binary"), tasks)], support

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in _whole(batches, together):
            part = _pack_whole(dict(zip(("user", "item", "n", "support", "block"), _columns(t))))
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.binary())], names=["packed"])

    # whole histories, packed once
    chunks = materialize_table(rows.mapInArrow(packed, "packed binary"), "histories")

    def some(lo: int, hi: int) -> DataFrame:
        def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for part in b.column("packed").to_pylist():
                    yield from _deal(*_unpack(part), (lo, hi))

        return summed(chunks.mapInArrow(deal, "block long, packed binary"), min(hi - lo, tasks))

    cuts = [blocks * r // rounds for r in range(rounds + 1)]
    return [some(lo, hi) for lo, hi in zip(cuts, cuts[1:])], support


def pair_cells(train: DataFrame, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pair_rounds``, the cells in one table."""
    rounds, support = pair_rounds(train, chunk)
    return reduce(DataFrame.union, rounds), support


def written_cells(train: DataFrame, chunk: int | None = None) -> tuple[DataFrame, DataFrame]:
    """``pair_cells``, written round by round."""
    rounds, support = pair_rounds(train, chunk)
    return _written(rounds, "pairs"), support


def _written(rounds: list[DataFrame], name: str) -> DataFrame:
    return reduce(DataFrame.union, [materialize_table(r, name) for r in rounds])


def _from_cells(cells: DataFrame, rows: Callable[..., dict], schema: StructType) -> DataFrame:
    """Rows made of each packed cell: ``rows(i, j, c, si, sj)`` gives the columns of ``schema``."""
    arrow = to_arrow_schema(schema)

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column("packed").to_pylist():
                found = rows(*_unpack(packed))
                yield pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in arrow], schema=arrow)

    return cells.select("packed").mapInArrow(unpack, schema)


def _like(kind: str, c: np.ndarray, si: np.ndarray, sj: np.ndarray) -> np.ndarray:
    """``similarity`` of pairs in arrays."""
    c, si, sj = (x.astype(np.float64) for x in (c, si, sj))
    return {"jaccard": lambda: c / (si + sj - c), "cosine": lambda: c / np.sqrt(si * sj),
            "lift": lambda: c / (si * sj), "counts": lambda: c}[kind]()


def cooccurrence(train: DataFrame, chunk: int | None = None, write: bool = True) -> tuple[DataFrame, DataFrame]:
    """M4: ``(i, j, c)`` for i < j with c > 0, and ``(item_id, support)``.

    Pairs that take several rounds are written packed, unless not to ``write`` them is asked for."""
    rounds, support = pair_rounds(train, chunk)
    if len(rounds) == 1 or not write:
        return half_counts(reduce(DataFrame.union, rounds), train), support

    def half(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for packed in b.column("packed").to_pylist():
                t = dict(zip("ijc", _unpack(packed)))
                first = t["i"] < t["j"]
                yield pa.RecordBatch.from_arrays([pa.array([_pack_whole({
                    **{k: x[first] for k, x in t.items()}, **dict.fromkeys(("si", "sj"), np.zeros(int(first.sum()), int))})], pa.binary())],
                    names=["packed"])

    halves = _written([r.select("packed").mapInArrow(half, "packed binary") for r in rounds], "pairs")
    return half_counts(halves, train), support


def half_counts(cells: DataFrame, train: DataFrame) -> DataFrame:
    """``(i, j, c)`` for i < j of packed cells."""
    def half(i, j, c, si, sj):
        first = i < j
        return {"i": i[first], "j": j[first], "c": c[first]}

    item = train.schema["item_id"].dataType
    return _from_cells(cells, half, StructType([StructField("i", item), StructField("j", item), StructField("c", LongType())]))


def half_similarity(cells: DataFrame, train: DataFrame, kind: str) -> DataFrame:
    """``(i, j, sim)`` for i < j of packed cells."""
    def half(i, j, c, si, sj):
        first = i < j
        return {"i": i[first], "j": j[first], "sim": _like(kind, c, si, sj)[first]}

    item = train.schema["item_id"].dataType
    return _from_cells(cells, half, StructType([StructField("i", item), StructField("j", item), StructField("sim", DoubleType())]))


def similarity(c: DataFrame, support: DataFrame, kind: str = "jaccard") -> DataFrame:
    """M5: ``(i, j, sim)`` for i < j (symmetric; diagonal removed).

    jaccard c/(c_ii + c_jj - c); cosine c/sqrt(c_ii c_jj) (what the
    reference's "lift" branch computes); lift c/(c_ii c_jj) (its
    documented formula); counts c.
    """
    if kind not in SIMILARITIES:
        raise ValueError(kind)
    si = support.select(F.col("item_id").alias("i"), F.col("support").alias("_si"))
    sj = support.select(F.col("item_id").alias("j"), F.col("support").alias("_sj"))
    x = c.join(si, "i").join(sj, "j")
    cc, a, b = F.col("c").cast("double"), F.col("_si"), F.col("_sj")
    sim = {"jaccard": cc / (a + b - cc), "cosine": cc / F.sqrt(a * b),
           "lift": cc / (a * b), "counts": cc}[kind]
    return x.select("i", "j", sim.alias("sim"))


def affinity(train: DataFrame, time_decay: bool = True, half_life_days: float = 30.0,
             t0=None) -> DataFrame:
    """M6: sum of rating * 0.5 ** ((t0 - t) / (half_life days)) per
    (user, item); t0 = newest timestamp of ``train`` unless given (as
    epoch seconds).  Without decay: sum of ratings."""
    if not time_decay:
        return train.groupBy("user_id", "item_id").agg(F.sum("rating").alias("affinity"))
    t = epoch_seconds("ts")
    if t0 is None:
        ref = train.agg(F.max(t).alias("_t0"))
    else:
        ref = train.sparkSession.range(1).select(F.lit(float(t0)).alias("_t0"))
    x = train.crossJoin(F.broadcast(ref))
    decay = F.pow(F.lit(0.5), (F.col("_t0") - t) / F.lit(86400.0) / F.lit(float(half_life_days)))
    return x.groupBy("user_id", "item_id").agg(F.sum(F.col("rating") * decay).alias("affinity"))


def fit(train: DataFrame, kind: str = "jaccard", time_decay: bool = True,
        half_life_days: float = 30.0, t0=None, chunk: int | None = None,
        materialize: bool = True, counts: tuple[DataFrame, DataFrame] | None = None) -> CooccurrenceModel:
    """Fit; with ``materialize`` the packed pairs and the affinity table are
    written once to the shared checkpoint folder (scoring reads them
    several times).  Callers that read the pairs once (similar items) pass
    ``materialize=False``.  ``counts`` are those of ``pair_cells``, already
    written."""
    if kind not in SIMILARITIES:
        raise ValueError(kind)
    rounds, support = ([counts[0]], counts[1]) if counts is not None else pair_rounds(train, chunk)
    total = train.agg(F.count(F.lit(1)).alias("_t"))
    pop = train.groupBy("item_id").agg(F.count(F.lit(1)).alias("_n")).crossJoin(F.broadcast(total)) \
               .select("item_id", (F.col("_n") / F.col("_t")).alias("popularity"))  # A8
    aff = affinity(train, time_decay, half_life_days, t0)
    if materialize:
        aff = materialize_table(aff, "affinity")
        if counts is None:
            rounds = [_written(rounds, "pairs")]
    cells = reduce(DataFrame.union, rounds)
    return CooccurrenceModel(half_similarity(cells, train, kind), aff, support, pop, cells, kind, rounds)


def score(model: CooccurrenceModel, users: DataFrame | None = None) -> DataFrame:
    """``(user_id, item_id, score)`` = sum_i affinity(u, i) sim(i, j)."""
    aff = model.affinity if users is None else model.affinity.join(
        users.select("user_id").distinct(), "user_id", "left_semi")
    j = aff.join(model.similarity.withColumnRenamed("i", "item_id"), "item_id")
    return j.groupBy("user_id", F.col("j").alias("item_id")).agg(
        F.sum(F.col("affinity") * F.col("sim")).alias("score"))


def recommend(model: CooccurrenceModel, users: DataFrame | None = None, n: int = 10,
              remove_seen: bool = True, candidates: DataFrame | None = None) -> DataFrame:
    """M7: top ``n`` per user among items with evidence (score != 0);
    unknown users get no rows (use ``nest_recommendations`` for lists).
    With ``candidates`` only those (user, item) pairs are ranked (F8)."""
    aff = model.affinity if users is None else model.affinity.join(
        users.select("user_id").distinct(), "user_id", "left_semi")
    if model.cells is None or candidates is not None:
        return top_n_products(aff, model.sim_half, n, remove_seen, candidates)
    size = model.cells.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("cell"), F.lit(0)) + 1).first()
    groups = min(_groups(size[0], aff), size[1])
    kind = model.kind
    return products_of_cells(aff, model.cells.select(F.pmod("cell", F.lit(groups)).alias("cell"), "packed"), groups, n, remove_seen,
                             like=lambda c, si, sj: [_like(kind, c, si, sj)], similarities=size[0])


def affinities(train: DataFrame, half_lives: list[float | None]) -> DataFrame:
    """M6 for several half-lives (None: no decay) at once: ``(user_id, item_id, v0, v1, ...)``."""
    t = epoch_seconds("ts")
    x = train.crossJoin(F.broadcast(train.agg(F.max(t).alias("_t0")))) if any(h is not None for h in half_lives) else train
    ago = (F.col("_t0") - t) / F.lit(86400.0)
    return x.groupBy("user_id", "item_id").agg(*(
        F.sum("rating" if h is None else F.col("rating") * F.pow(F.lit(0.5), ago / F.lit(float(h)))).alias(f"v{k}")
        for k, h in enumerate(half_lives)))


def recommend_points(train: DataFrame, points: dict[int, tuple[str, float | None, bool]], n: int = 10,
                     counts: tuple[DataFrame, DataFrame] | None = None) -> DataFrame:
    """M7 for many points in one pass: ``(point, user_id, rank, item_id, score)``.

    A point is (similarity, half-life in days or None, remove_seen).  The
    packed pairs and the users are sent once for all points; points that
    differ in ``remove_seen`` only share their sums.  ``counts`` as in ``fit``.
    """
    kinds = sorted({p[0] for p in points.values()})
    for kind in kinds:
        if kind not in SIMILARITIES:
            raise ValueError(kind)
    lives = sorted({p[1] for p in points.values()}, key=lambda h: (h is None, h))
    cells = counts[0] if counts is not None else written_cells(train)[0]
    aff = materialize_table(affinities(train, lives), "affinities")
    size = cells.agg(F.coalesce(F.sum("size"), F.lit(0)), F.coalesce(F.max("cell"), F.lit(0)) + 1).first()
    # lists of every pair leave a group: no more groups than cores if the similarities fit
    groups = min(_groups(size[0], aff, 1), size[1])

    def like(c: np.ndarray, si: np.ndarray, sj: np.ndarray) -> list[np.ndarray]:
        return [_like(kind, c, si, sj) for kind in kinds]

    return grid_products(aff, cells.select(F.pmod("cell", F.lit(groups)).alias("cell"), "packed"), groups,
                         [(k, kinds.index(kind), lives.index(h), seen) for k, (kind, h, seen) in points.items()], n, like,
                         similarities=size[0])


def similar_items(model: CooccurrenceModel, n: int = 10, items: DataFrame | None = None) -> DataFrame:
    """M8: per item, the ``n`` most similar items with similarity > 0."""
    if model.cells is not None:
        kind, item = model.kind, model.sim_half.schema["i"].dataType

        def best(i, j, c, si, sj):
            # pairs come by (i, j): equal similarities keep the smaller j
            sim = _like(kind, c, si, sj)
            at = np.cumsum(np.concatenate(([False], i[1:] != i[:-1])))
            order = np.lexsort((np.arange(len(i)), -np.round(sim, DIGITS), at))
            order = order[(np.arange(len(i)) - np.searchsorted(at[order], at[order]) < n) & (sim[order] > 0)]
            return {"i": i[order], "j": j[order], "sim": sim[order]}

        # the best of each cell; an item's pairs may lie in several of a round
        schema = StructType([StructField("i", item), StructField("j", item), StructField("sim", DoubleType())])
        sims = [_from_cells(r, best, schema) for r in model.rounds or [model.cells]]
    else:
        sims = [model.similarity.where(F.col("sim") > 0)]

    def lists(s: DataFrame) -> DataFrame:
        if items is not None:
            s = s.join(items.select(F.col("item_id").alias("i")).distinct(), "i", "left_semi")
        out = top_n(s.select(F.col("i").alias("query_item_id"), F.col("j").alias("item_id"),
                             F.col("sim").alias("score")), n, group="query_item_id")
        return out.select("query_item_id", "rank", "item_id", "score")

    return lists(sims[0]) if len(sims) == 1 else _written([lists(s) for s in sims], "similar")
