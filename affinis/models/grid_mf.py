"""Factorisations for many parameter points in one pass.

All points of a grid share one alternating least squares run: the ratings
are indexed and blocked once, and a half-iteration is one job that solves
every row of one side for every point.  The objective is that of
``als.fit``: confidence 1 + alpha |r| for implicit feedback,
regularisation scaled by the ratings of a row.

Points that differ in the number of iterations only are one *run*, read at
several iterations.  A task solves a block of rows for one run:

* ratings are packed into blocks once, each row with the places of the
  other side that need its factors;
* factors stay packed: a packet holds some rows of a block, written once,
  and only the rows that a place needs go there, once, as one part;
* implicit feedback needs the Gram matrix of the other side.  It is summed
  from per-block parts, and its eigenvectors turn it and the
  regularisation into a diagonal, so that a row with fewer ratings than
  factors is solved in the space of its ratings.

Lists: a task holds a block of users for one point, their seen items and
best n so far, and all items stream past it in cells.

Hot rows: one with more than ``hot`` ratings is cut into pieces by the
other side's ids; the pieces give parts of its normal equations, which are
summed per run.  To the driver come counts only; the Gram matrices, whose
size depends on the points alone, are broadcast to the blocks.

``stop_at`` prunes the grid: at the given iterations only the better half
of the runs of each rank goes on (successive halving, judged by the
caller's function); a stopped point keeps its last factors.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import drop_intermediates, materialize
from .als import indexed
from .scoring import DIGITS, SEEN, _cells, _unpack, half_up

#: Ratings of a block, and of a row or piece of a row.
BLOCK_RATINGS, HOT_RATINGS = 2_000_000, 200_000
#: Factor rows of the other side that a block may need; with more of them it has as many ratings at most.
OTHER_ROWS = 400_000
#: Rows of a packet.
PACKET = 8192
#: Doubles of the padded arrays that are solved together; they stay in a core's cache.
STEP = 250_000
#: For lists: users of a block and items of a cell at most, users that are multiplied at once, pairs scored anew at once.
USER_BLOCK, ITEM_BLOCK, TILE, PAIRS = 131_072, 2048, 512, 100_000
_SCHEMA = "kind int, run int, b long, parts array<binary>"
_ARROW = pa.schema([("kind", pa.int32()), ("run", pa.int32()), ("b", pa.int64()), ("parts", pa.list_(pa.binary()))])
_FACTORS, _GRAM, _PART, _BLOCK = range(4)


@dataclass(frozen=True)
class Point:
    rank: int
    reg: float
    alpha: float = 1.0
    iterations: int = 10


@dataclass
class GridModel:
    """Factor tables by point: ``at[p]`` is (user table, item table, run, name of the tables) of point p.

    The tables have packets (run, parts), parts the ids and their vectors as bytes of 32-bit floats.
    """

    user_index: DataFrame
    item_index: DataFrame
    at: dict[int, tuple[DataFrame, DataFrame, int, tuple]] = field(default_factory=dict)
    iterations: dict[int, int] = field(default_factory=dict)


def normals(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """Normal numbers per id that depend on the id and the seed only."""
    with np.errstate(over="ignore"):
        x = (ids.astype(np.uint64)[:, None] * np.uint64(2 * rank) + np.arange(2 * rank, dtype=np.uint64)[None, :]
             + np.uint64(seed) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(0x632BE59BD9B4E019))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        x ^= x >> np.uint64(31)
    u = ((x >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    return np.sqrt(-2 * np.log(u[:, :rank])) * np.cos(2 * np.pi * u[:, rank:])


def start_vectors(ids: np.ndarray, rank: int, seed: int) -> np.ndarray:
    """A unit vector per id that depends on the id and the seed only."""
    normal = normals(ids, rank, seed)
    return normal / np.linalg.norm(normal, axis=1, keepdims=True)


def solve_block(y: np.ndarray, ptr: np.ndarray, cols: np.ndarray, vals: np.ndarray, point: Point,
                gram: tuple[np.ndarray, np.ndarray] | None) -> np.ndarray:
    """Least squares of each row against its columns' factors ``y``.

    ``gram`` has eigenvalues and eigenvectors of the Gram matrix of all
    columns for implicit feedback, where ``y`` is given in terms of the
    eigenvectors, None for explicit.
    """
    n = np.diff(ptr)
    out = np.empty((len(n), point.rank))
    order = np.argsort(n, kind="stable")
    at = 0
    while at < len(order):
        # rows of similar length, padded with zeros, which change nothing
        end = at + 1
        while end < len(order) and (end + 1 - at) * n[order[end]] * max(point.rank, n[order[end]]) <= STEP:
            end += 1
        rows = order[at:end]
        wide = int(n[rows[-1]])
        slot = np.arange(wide)[None, :]
        inside = slot < n[rows][:, None]
        pick = np.where(inside, ptr[rows][:, None] + slot, 0)
        r = np.where(inside, vals[pick], 0.0)
        f = y[cols[pick]]
        if gram is None and n[rows[0]] < wide:
            f *= inside[:, :, None]
        out[rows] = (_explicit if gram is None else _implicit)(f, r, n[rows], point, gram)
        at = end
    return out if gram is None else out @ gram[1].T


def _explicit(f: np.ndarray, r: np.ndarray, n: np.ndarray, point: Point, _) -> np.ndarray:
    ridge = np.maximum(point.reg * n, 1e-12)[:, None, None]
    t = f.transpose(0, 2, 1)
    if f.shape[1] < f.shape[2]:
        inner = f @ t + ridge * np.eye(f.shape[1])
        return (t @ np.linalg.solve(inner, r[:, :, None]))[:, :, 0]
    return np.linalg.solve(t @ f + ridge * np.eye(f.shape[2]), t @ r[:, :, None])[:, :, 0]


def _implicit(f: np.ndarray, r: np.ndarray, n: np.ndarray, point: Point, gram) -> np.ndarray:
    """With S the factors by the roots of the extra confidence, S^T c is the right side; ``f`` is overwritten.

    Padding has no confidence, so its factors do not matter.
    """
    extra = point.alpha * np.abs(r)
    liked = r > 0
    diagonal = np.maximum(np.maximum(gram[0], 0.0)[None, :] + point.reg * liked.sum(1)[:, None], 1e-12)
    # a rating without extra confidence still has its right side
    extra = np.where(liked, np.maximum(extra, 1e-200), extra)
    c = np.where(liked, (1 + extra) / np.sqrt(np.where(liked, extra, 1.0)), 0.0)[:, :, None]
    s = np.sqrt(extra)[:, :, None]
    t = f.transpose(0, 2, 1)
    if f.shape[1] < f.shape[2]:
        root = 1 / np.sqrt(diagonal)
        f *= root[:, None, :]
        # the roots of the confidence scale the small matrix, not the factors
        inner = f @ t
        inner *= s
        inner *= s.transpose(0, 2, 1)
        at = np.arange(f.shape[1])
        inner[:, at, at] += 1.0
        return (t @ (s * np.linalg.solve(inner, c)))[:, :, 0] * root
    f *= s
    a = t @ f
    at = np.arange(f.shape[2])
    a[:, at, at] += diagonal
    return np.linalg.solve(a, t @ c)[:, :, 0]


def _bytes(*arrays: np.ndarray) -> list[bytes]:
    return [np.ascontiguousarray(a).tobytes() for a in arrays]


def _arrays(parts: list[bytes], *kinds: type) -> list[np.ndarray]:
    return [np.frombuffer(p, kind) for p, kind in zip(parts, kinds)]


def _rows(*rows: tuple) -> pa.RecordBatch:
    """Rows of ``_SCHEMA``."""
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW)], schema=_ARROW)


def _result(run: int, b: int, ids: np.ndarray, factors: np.ndarray, to: np.ndarray, pos: np.ndarray,
            implicit: bool) -> Iterator[pa.RecordBatch]:
    """Packets of a block's factor rows, and its part of the Gram matrix.

    ``to`` and ``pos`` say which places need which row, in order; a packet
    has the ids, the vectors, its places, their counts and positions.
    """
    factors = factors.astype(np.float32)
    places, first = np.unique(to, return_index=True)
    ends = np.append(first[1:], len(to))
    for lo in range(0, len(ids), PACKET):
        hi = min(lo + PACKET, len(ids))
        found = [pos[a + np.searchsorted(pos[a:e], lo):a + np.searchsorted(pos[a:e], hi)] - lo for a, e in zip(first, ends)]
        yield _rows((_FACTORS, run, b, _bytes(
            ids[lo:hi].astype(np.int32), factors[lo:hi], places.astype(np.int64), np.array([len(f) for f in found], np.int64),
            np.concatenate([*found, np.zeros(0, np.int32)]).astype(np.int32))))
    if implicit:
        factors = factors.astype(np.float64)
        yield _rows((_GRAM, run, -1, _bytes(factors.T @ factors)))


def _send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of each packet that a place needs, for each place."""
    for batch in batches:
        for row in range(batch.num_rows):
            run, parts = batch.column("run")[row].as_py(), batch.column("parts")[row].as_py()
            ids, f, places, many, pos = _arrays(parts, np.int32, np.float32, np.int64, np.int64, np.int32)
            f = f.reshape(len(ids), -1)
            for b, at in zip(places.tolist(), np.split(pos, np.cumsum(many)[:-1])):
                if len(at):
                    yield _rows((_FACTORS, run, b, _bytes(ids[at], f[at])))


def _part(f: np.ndarray, r: np.ndarray, run: Point, implicit: bool) -> bytes:
    """Normal equations of a piece of a hot row: matrix, right side, ratings."""
    if not implicit:
        return np.concatenate(((f.T @ f).ravel(), r @ f, [len(r)])).tobytes()
    extra, liked = run.alpha * np.abs(r), r > 0
    return np.concatenate((((f * extra[:, None]).T @ f).ravel(), np.where(liked, 1 + extra, 0.0) @ f,
                           [liked.sum()])).tobytes()


def _places(ratings: DataFrame, row: str, col: str, out: str, blocks: int, hot: int) -> tuple[DataFrame, int]:
    """(ratings with the place ``out`` that solves their row, number of hot rows).

    Places below ``blocks`` are blocks of rows; each piece of a hot row has one of its own.
    """
    many = ratings.groupBy(row).agg(F.ceil(F.count(F.lit(1)) / hot).alias("_pieces")).where(F.col("_pieces") > 1)
    n, stride = many.agg(F.count(F.lit(1)), F.max("_pieces")).first()
    place = F.pmod(F.xxhash64(row), F.lit(blocks))
    if not n:
        return ratings.withColumn(out, place), 0
    piece = F.lit(blocks) + F.col(row).cast("long") * stride + F.pmod(F.xxhash64(col), F.col("_pieces"))
    return ratings.join(many, row, "left").withColumn(
        out, F.when(F.col("_pieces").isNull(), place).otherwise(piece)).drop("_pieces"), n


class _Side:
    """Ratings of one side in blocks, with the routes of its factors; both written once."""

    def __init__(self, ratings: DataFrame, row: str, col: str, at: str, to: str, blocks: int, hot: int):
        self.hot, self.n = hot, blocks

        def pack(g: pd.DataFrame) -> pd.DataFrame:
            g = g.sort_values(["row", "col"])
            ids, first, which = np.unique(g["row"].to_numpy(), return_index=True, return_inverse=True)
            routes = pd.DataFrame({"to": g["to"].to_numpy(), "pos": which}).drop_duplicates().sort_values(["to", "pos"])
            parts = _bytes(ids.astype(np.int32), np.append(first, len(g)).astype(np.int64), g["col"].to_numpy(np.int32),
                           g["rating"].to_numpy(np.float64), routes["to"].to_numpy(np.int64), routes["pos"].to_numpy(np.int32))
            return pd.DataFrame({"b": g["b"].iloc[:1].to_numpy(), "parts": [parts]})

        self.blocks = materialize(
            ratings.select(F.col(at).alias("b"), F.col(row).alias("row"), F.col(col).alias("col"), F.col(to).alias("to"), "rating")
            .groupBy("b").applyInPandas(pack, "b long, parts array<binary>"), "grid-blocks")
        #: (b, ids, to, pos) of the blocks, and of each hot row as a whole
        take = lambda *n: F.array(*(F.col("parts")[k] for k in n)).alias("parts")
        self.sources = self.blocks.where(F.col("b") < blocks).select("b", take(0, 4, 5))
        if hot:
            def whole(g: pd.DataFrame) -> pd.DataFrame:
                to = np.unique(np.concatenate([np.frombuffer(p[1], np.int64) for p in g["parts"]]))
                parts = [bytes(g["ids"].iloc[0]), *_bytes(to, np.zeros(len(to), np.int32))]
                return pd.DataFrame({"b": [-1 - int(np.frombuffer(parts[0], np.int32)[0])], "parts": [parts]})

            pieces = self.blocks.where(F.col("b") >= blocks).select(F.col("parts")[0].alias("ids"), take(0, 4))
            self.whole = materialize(pieces.groupBy("ids").applyInPandas(whole, "b long, parts array<binary>"), "grid-whole")
            self.sources = self.sources.union(self.whole)

    def solve(self, other: DataFrame, runs: dict[int, Point], implicit: bool) -> DataFrame:
        """Rows of ``_SCHEMA`` of this side from those of the other side, one job."""
        every = other.sparkSession.createDataFrame([(r, None) for r in runs], "run int, gram binary")
        if implicit:
            every = eigen_grams(other, runs)

        def one(run: int, b: int, block: list[bytes], packets: list[list[bytes]]) -> Iterator[pa.RecordBatch]:
            p = runs[run]
            rows, ptr, cols, vals, to, pos = _arrays(block, np.int32, np.int64, np.int32, np.float64, np.int64, np.int32)
            gram = _eigen(block[6], p.rank) if b >= 0 else None
            sent = sorted((_arrays(x, np.int32, np.float32) for x in packets), key=lambda x: x[0][0])
            y = np.empty((sum(len(ids) for ids, _ in sent), p.rank))
            place, at = np.zeros(max(int(ids.max()) for ids, _ in sent) + 1, np.int32), 0
            for ids, f in sent:
                f = f.reshape(len(ids), -1).astype(np.float64)
                y[at:at + len(ids)] = f if gram is None else f @ gram[1]
                place[ids] = np.arange(at, at + len(ids))
                at += len(ids)
            del sent, packets
            cols = place[cols]
            if b < 0:
                yield _rows((_PART, run, -1 - int(rows[0]), [_part(y[cols], vals, p, implicit)]))
            else:
                yield from _result(run, b, rows, solve_block(y, ptr, cols, vals, p, gram), to, pos, implicit)

        def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, block, packets = None, None, []
            for batch in batches:
                for row in range(batch.num_rows):
                    kind, *at = (batch.column(c)[row].as_py() for c in ("kind", "run", "b"))
                    if now is not None and at != now and block is not None:
                        yield from one(now[0], now[1] if now[1] < blocks else -1, block, packets)
                    if at != now:
                        now, block, packets = at, None, []
                    parts = batch.column("parts")[row].as_py()
                    if kind == _BLOCK:
                        block = parts
                    else:
                        packets.append(parts)
            if block is not None:
                yield from one(now[0], now[1] if now[1] < blocks else -1, block, packets)

        def solve_hot(g: pd.DataFrame) -> pd.DataFrame:
            run, b = int(g["run"].iloc[0]), int(g["b"].iloc[0])
            rank = runs[run].rank
            total = sum(np.frombuffer(p[0], np.float64) for p in g["parts"])
            a, right, n = total[:rank ** 2].reshape(rank, rank), total[rank ** 2:-1], total[-1]
            if implicit:
                values, vectors = _eigen(g["gram"].iloc[0], rank)
                a = a + (vectors * np.maximum(values, 0.0)) @ vectors.T
            x = np.linalg.solve(a + max(runs[run].reg * n, 1e-12) * np.eye(rank), right)
            ids, to, pos = _arrays(g["route"].iloc[0], np.int32, np.int64, np.int32)
            return pa.Table.from_batches(_result(run, b, ids, x[None, :], to, pos, implicit)).to_pandas()

        blocks, tasks = self.n, self.n * len(runs)
        # one row per run: at most some hundred times rank squared numbers
        work = self.blocks.crossJoin(F.broadcast(every)).select(
            F.lit(_BLOCK).alias("kind"), "run", "b", F.concat("parts", F.array("gram")).alias("parts"))
        sent = other.where(F.col("kind") == _FACTORS).select("run", "parts").mapInArrow(_send, _SCHEMA)
        task = F.when(F.col("b") < blocks, (_number("run", runs) * blocks + F.col("b"))).otherwise(
            F.pmod(F.xxhash64("run", "b"), F.lit(tasks))).cast("int")
        out = materialize(work.union(sent).repartitionById(tasks, task).sortWithinPartitions("run", "b")
                          .mapInArrow(solve, _SCHEMA), "grid-factors", ["kind"])
        if self.hot:
            route = self.whole.select("b", F.col("parts").alias("route"))
            parts = out.where(F.col("kind") == _PART).select("run", "b", "parts").join(F.broadcast(every), "run").join(route, "b") \
                .groupBy("run", "b").applyInPandas(solve_hot, _SCHEMA)
            out = out.where(F.col("kind") != _PART).unionByName(materialize(parts, "grid-hot", ["kind"]))
        return out


def _number(column: str, names) -> Column:
    """Place of the column's value among ``names``."""
    return F.array_position(F.array(*map(F.lit, sorted(names))), F.col(column)) - 1


def _eigen(gram: bytes | None, rank: int) -> tuple[np.ndarray, np.ndarray] | None:
    if gram is None:
        return None
    both = np.frombuffer(gram, np.float64)
    return both[:rank], both[rank:].reshape(rank, rank)


def eigen_grams(table: DataFrame, runs: dict[int, Point]) -> DataFrame:
    """(run, gram): eigenvalues and eigenvectors of each run's Gram matrix, summed from the parts in ``table``."""
    def add(key: tuple, g: pd.DataFrame) -> pd.DataFrame:
        rank = runs[int(key[0])].rank
        values, vectors = np.linalg.eigh(sum(np.frombuffer(f, np.float64) for f in g["f"]).reshape(rank, rank))
        return pd.DataFrame({"run": [key[0]], "gram": [values.tobytes() + vectors.tobytes()]})

    return table.where(F.col("kind") == _GRAM).select("run", F.col("parts")[0].alias("f")).groupBy("run").applyInPandas(
        add, "run int, gram binary")


def _start(side: _Side, runs: dict[int, Point], seed: int) -> DataFrame:
    """Start factors of one side with Gram parts; runs of equal rank start alike."""
    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                b, parts = batch.column("b")[row].as_py(), batch.column("parts")[row].as_py()
                ids, to, pos = _arrays(parts, np.int32, np.int64, np.int32)
                of = {rank: start_vectors(ids, rank, seed) for rank in {p.rank for p in runs.values()}}
                for run, p in runs.items():
                    yield from _result(run, b, ids, of[p.rank], to, pos, True)

    return materialize(side.sources.mapInArrow(start, _SCHEMA), "grid-start", ["kind"])


def fit_points(train: DataFrame, points: list[Point], implicit: bool = True, seed: int = 42,
               block: int = BLOCK_RATINGS, hot: int = HOT_RATINGS, stop_at: tuple[int, ...] = (),
               judge: Callable[[GridModel, list[int], int], dict[int, float]] | None = None) -> GridModel:
    """Factors of every point; equal rows of ``train`` are summed first.

    ``stop_at`` with ``judge(model, points, round) -> value per point``
    stops the worse half of the runs of each rank after these iterations;
    ties keep the earlier point.  An empty table has no factors.
    """
    ratings = materialize(train.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating")), "grid-ratings")
    placed, users, items = indexed(ratings)
    placed, users, items = (materialize(t, "grid-index") for t in (placed.select("uidx", "iidx", "rating"), users, items))
    model = GridModel(users, items)
    n = placed.count()
    if not n:
        return model

    of: dict[Point, list[int]] = {}  # points that differ in iterations only are one run
    for k, p in enumerate(points):
        of.setdefault(Point(p.rank, p.reg, p.alpha, 0), []).append(k)
    runs = dict(enumerate(of))
    members = dict(enumerate(of.values()))
    cores = placed.sparkSession.sparkContext.defaultParallelism

    def blocks(others: int) -> int:
        # the tasks of all runs keep the cores busy, if the data are not small
        return max(math.ceil(n / (block if others <= OTHER_ROWS else min(block, OTHER_ROWS))),
                   min(math.ceil(3 * cores / len(runs)), n // 50_000), 1)

    nu, ni = blocks(items.count()), blocks(users.count())
    both, hot_users = _places(placed, "uidx", "iidx", "_u", nu, hot)
    both, hot_items = _places(both, "iidx", "uidx", "_i", ni, hot)
    both = materialize(both, "grid-places")
    by_user = _Side(both, "uidx", "iidx", "_u", "_i", nu, hot_users)
    by_item = _Side(both, "iidx", "uidx", "_i", "_u", ni, hot_items)

    def chain(runs: dict[int, Point]) -> None:
        item_f = _start(by_item, runs, seed)
        spent = [item_f]  # factors of the iteration before, unless a point ends there
        for it in range(1, max(points[k].iterations for run in runs for k in members[run]) + 1):
            user_f = by_user.solve(item_f, runs, implicit)
            item_f = by_item.solve(user_f, runs, implicit)
            _drop(spent)
            spent = [user_f, item_f]

            def keep(wanted: Callable[[int], bool]) -> None:
                tables = [t.where(F.col("kind") == _FACTORS).select("run", "parts") for t in (user_f, item_f)]
                for run in runs:
                    for k in members[run]:
                        if wanted(points[k].iterations):
                            model.at[k], model.iterations[k] = (*tables, run, (it, min(runs))), it
                            spent.clear()

            keep(lambda end: end == it)
            left = [run for run in runs if max(points[k].iterations for k in members[run]) > it]
            if it in stop_at and judge is not None and len(left) > 1:
                keep(lambda end: end > it)
                last = {run: max(members[run], key=lambda k: points[k].iterations) for run in left}
                value = judge(model, list(last.values()), stop_at.index(it))
                left = sorted(sorted(left, key=lambda run: (-value[last[run]], last[run]))[:math.ceil(len(left) / 2)])
            if len(left) < len(runs):
                runs = {run: runs[run] for run in left}
                item_f = item_f.where(F.col("run").isin(left))
            if not runs:
                return

    # runs of one rank take equally long: each rank is a chain of jobs of its own
    chains = [{run: p for run, p in runs.items() if p.rank == rank} for rank in sorted({p.rank for p in of})]
    with ThreadPoolExecutor(len(chains)) as pool:
        list(pool.map(chain, chains))
    return model


def _drop(tables: list[DataFrame]) -> None:
    """Delete written tables that nothing reads any more."""
    for t in tables:
        drop_intermediates(t.sparkSession, named={name for f in t.inputFiles() for name in f.split("/")})


def factors_of(model: GridModel, point: int) -> tuple[DataFrame, DataFrame]:
    """((user_id, features), (item_id, features)) of one point, as the factor models have them."""
    user_f, item_f, run, _ = model.at[point]

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for parts in batch.column("parts"):
                ids, f = _arrays(parts.as_py(), np.int32, np.float32)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int32()), pa.array(list(f.reshape(len(ids), -1).astype(np.float64)), pa.list_(pa.float64()))],
                    names=["id", "features"])

    def one(table: DataFrame, index: DataFrame, idx: str, key: str) -> DataFrame:
        rows = table.where(F.col("run") == run).select("parts").mapInArrow(unpack, "id int, features array<double>")
        return rows.join(index, F.col("id") == F.col(idx)).select(key, "features")

    return one(user_f, model.user_index, "uidx", "user_id"), one(item_f, model.item_index, "iidx", "item_id")


class _Lists:
    """Best items of a block of users at one point, while the cells of items come one after the other.

    Scores are made in 32 bits first.  Those that reach the n-th best so
    far within the error of 32 bits are made anew in 64 bits, so the lists
    are those of 64 bits.
    """

    def __init__(self, n: int, wide: int, cell: list[tuple[int, list[bytes]]]):
        """The users of the block with what they have seen; ``wide`` ids make a cell of items."""
        self.n, self.wide = n, wide
        self.ids, self.p = _stacked([p for kind, p in cell if kind == _USERS])
        if any(kind == _WANTED for kind, _ in cell):
            wanted = np.concatenate([_unpack(p[0])[0] for kind, p in cell if kind == _WANTED])
            self.ids, self.p = (x[np.isin(self.ids, wanted)] for x in (self.ids, self.p))
        elif any(kind == _NONE for kind, _ in cell):
            self.ids, self.p = self.ids[:0], self.p[:0]
        self.length = np.sqrt((self.p.astype(np.float64) ** 2).sum(1))
        self.least = np.full(len(self.ids), -np.inf)
        self.tiles = [[] for _ in range(0, len(self.ids), TILE)]
        seen = [_unpack(p[0]) for kind, p in cell if kind == _OWN]
        user, item = (np.concatenate(c) for c in zip(*seen)) if seen and len(self.ids) else (np.zeros(0, int),) * 2
        if len(user):
            slot = np.minimum(np.searchsorted(self.ids, user), len(self.ids) - 1)
            known = self.ids[slot] == user
            slot, item = slot[known], item[known]
            order = np.lexsort((slot, item // wide))
            user, item = slot[order], item[order]
        self.slot, self.item = user, item

    def items(self, c: int, cell: list[tuple[int, list[bytes]]]) -> None:
        """A cell of items with their biases."""
        ids, q = _stacked([p for kind, p in cell if kind == _ITEMS])
        if not len(ids) or not len(self.ids):
            return
        bias = np.zeros(self.wide)
        for kind, p in cell:
            if kind == _BIAS:
                item, b = _unpack(p[0])
                bias[item - c * self.wide] = b
        bias = bias[ids - c * self.wide]
        q64, far = q.astype(np.float64), np.abs(bias).max()
        most = self.length * np.sqrt((q64 ** 2).sum(1).max()) + far
        # rounding of a product of so many terms, and of the bias
        error = (q.shape[1] + 8) * 2.0 ** -24 * most
        column = np.full(self.wide, -1)
        column[ids - c * self.wide] = np.arange(len(ids))
        own = slice(*np.searchsorted(self.item // self.wide, (c, c + 1)))
        slot, col = self.slot[own], column[self.item[own] - c * self.wide]
        slot, col = slot[col >= 0], col[col >= 0]
        for t in range(len(self.tiles)):
            lo, hi = t * TILE, min((t + 1) * TILE, len(self.ids))
            if (most[lo:hi] + error[lo:hi] < self.least[lo:hi]).all():
                continue
            scores = self.p[lo:hi] @ q.T
            if far:
                scores += bias.astype(np.float32)
            gone = slice(*np.searchsorted(slot, (lo, hi)))
            scores[slot[gone] - lo, col[gone]] = -np.inf
            row, at = np.divmod(np.flatnonzero(scores >= self._bound(scores, lo, hi, error)[:, None]), len(ids))
            if not len(row):
                continue
            again = np.concatenate([np.einsum("ij,ij->i", self.p[lo + row[k:k + PAIRS]].astype(np.float64), q64[at[k:k + PAIRS]])
                                    for k in range(0, len(row), PAIRS)]) + bias[at]
            self.tiles[t].append((row, ids[at], again))
            if np.isneginf(self.least[lo:hi]).any() or sum(len(p[0]) for p in self.tiles[t]) >= 1.5 * self.n * (hi - lo):
                self._cut(t)

    def _bound(self, scores: np.ndarray, lo: int, hi: int, error: np.ndarray) -> np.ndarray:
        """What a score in 32 bits must reach to be among the best n of its row."""
        error, wide = error[lo:hi], scores.shape[1]
        bound = self.least[lo:hi] - error
        if wide > self.n and np.isneginf(bound).any():
            # the n-th best of the maxima of some column groups is no better than the n-th best
            lanes = min(wide, 8 * self.n)
            top = scores[:, :lanes].copy()
            for at in range(lanes, wide, lanes):
                w = min(lanes, wide - at)
                np.maximum(top[:, :w], scores[:, at:at + w], out=top[:, :w])
            nth = np.partition(top, lanes - self.n, axis=1)[:, lanes - self.n].astype(np.float64)
            bound = np.maximum(bound, nth - 2 * error - 2 * 10.0 ** -DIGITS)
        low = np.finfo(np.float32).min
        return np.maximum(np.nextafter(bound.astype(np.float32), np.float32(-np.inf)), low)

    def _cut(self, t: int) -> None:
        """Keep the best n of each user of a tile, in order."""
        row, item, score = (np.concatenate(c) for c in zip(*self.tiles[t]))
        r = half_up(score)
        order = np.lexsort((item, -r, row))
        row, item, score, r = row[order], item[order], score[order], r[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep, last = nth < self.n, nth == self.n - 1
        self.tiles[t] = [(row[keep], item[keep], score[keep])]
        self.least[t * TILE + row[last]] = r[last] - 2 * 10.0 ** -DIGITS

    def best(self, point: int) -> Iterator[pa.RecordBatch]:
        for t in range(len(self.tiles)):
            if self.tiles[t]:
                self._cut(t)
                row, item, score = self.tiles[t][0]
                rank = np.arange(len(row)) - np.searchsorted(row, row) + 1
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(row), point), pa.int32()), pa.array(self.ids[t * TILE + row], pa.int32()),
                     pa.array(rank, pa.int32()), pa.array(item, pa.int32()), pa.array(score, pa.float64())],
                    names=["point", "_user", "rank", "_item", "score"])


_USERS, _OWN, _WANTED, _NONE, _ITEMS, _BIAS = range(6)


def _stacked(packets: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray]:
    """(ids in order, their vectors)."""
    if not packets:
        return np.zeros(0, int), np.zeros((0, 1), np.float32)
    found = [_arrays(p, np.int32, np.float32) for p in packets]
    ids = np.concatenate([i for i, _ in found]).astype(np.int64)
    order = np.argsort(ids)
    return ids[order], np.concatenate([f.reshape(len(i), -1) for i, f in found])[order]


def top_n_points(model: GridModel, seen: DataFrame, n: int = 10, points: list[int] | None = None,
                 item_bias: DataFrame | None = None, users: DataFrame | None = None,
                 user_block: int = USER_BLOCK, item_block: int = ITEM_BLOCK) -> DataFrame:
    """``(point, user_id, rank, item_id, score)``: the best n unseen items of every user at every point.

    Users are dealt to blocks; a task holds one for one point with what
    they have seen, and all items stream past in cells of ``item_block``
    ids.  So an item is sent once to a block of users, and no score leaves
    a task but the best n of each user; ``users`` restricts the lists.
    """
    spark = model.user_index.sparkSession
    points = sorted(model.at) if points is None else sorted(points)
    pairs = seen.select("user_id", "item_id").distinct().join(model.user_index, "user_id").join(model.item_index, "item_id") \
        .select(F.col("uidx").alias("user"), F.col("iidx").alias("item"))
    n_users = model.user_index.count()
    few = min(math.ceil(4 * spark.sparkContext.defaultParallelism / len(points)), math.ceil(n_users / TILE))
    nu = max(1, few, math.ceil(n_users / user_block), math.ceil(pairs.count() / SEEN))
    ni = max(1, math.ceil(model.item_index.count() / item_block))

    def deal(modulus: int, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        """Packets by ``id % modulus`` or, with ``width``, by ``id // width``."""
        def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for row in range(batch.num_rows):
                    ids, f = _arrays(batch.column("parts")[row].as_py(), np.int32, np.float32)
                    f, cell = f.reshape(len(ids), -1), ids // width if width else ids % modulus
                    order = np.argsort(cell, kind="stable")
                    cells, first = np.unique(cell[order], return_index=True)
                    for c, at in zip(cells.tolist(), np.split(order, first[1:])):
                        yield _rows((0, batch.column("run")[row].as_py(), c, _bytes(ids[at], f[at])))
        return parts

    # points read at the same iteration share their factor tables
    tables: dict[tuple, list[int]] = {}
    for p in points:
        tables.setdefault(model.at[p][3], []).append(p)
    every = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    row = lambda p, u, m, kind, parts: (p, u, F.col(m).cast("long").alias("_m"), F.lit(kind).alias("kind"), parts)
    point, block = F.col("point"), F.col("b").cast("int").alias("_u")
    stream = []
    for group in tables.values():
        names = F.broadcast(spark.createDataFrame([(p, model.at[p][2]) for p in group], "point int, run int"))
        user_f, item_f = (t.join(names, "run").select("parts", point.alias("run")) for t in model.at[group[0]][:2])
        u = user_f.mapInArrow(deal(nu, 0), _SCHEMA).select(F.col("run").alias("point"), "b", "parts", F.lit(-1).alias("_m"))
        i = item_f.mapInArrow(deal(0, item_block), _SCHEMA).select(F.col("run").alias("point"), "b", "parts", every(nu).alias("_u"))
        stream += [u.select(*row(point, block, "_m", _USERS, "parts")), i.select(*row(point, "_u", "b", _ITEMS, "parts"))]
    listed = F.broadcast(spark.createDataFrame([(p,) for p in points], "point int"))

    def to_all(df: DataFrame, cell: Column, kind: int) -> DataFrame:
        packed = _cells(df, cell, df.columns).select(F.col("cell").alias("b"), F.array("packed").alias("parts"), F.lit(-1).alias("_m"))
        packed = packed.crossJoin(listed)
        return packed.select(*row(point, block, "_m", kind, "parts")) if kind != _BIAS else \
            packed.withColumn("_u", every(nu)).select(*row(point, "_u", "b", kind, "parts"))

    stream.append(to_all(pairs, F.pmod("user", F.lit(nu)), _OWN))
    if item_bias is not None:
        known = model.item_index.join(item_bias, "item_id").where("b_i IS NOT NULL").select(
            F.col("iidx").alias("item"), F.col("b_i").cast("double").alias("b_i"))
        stream.append(to_all(known, F.floor(F.col("item") / item_block), _BIAS))
    if users is not None:
        wanted = model.user_index.join(users.select("user_id").distinct(), "user_id", "left_semi").select(F.col("uidx").alias("user"))
        stream.append(to_all(wanted, F.pmod("user", F.lit(nu)), _WANTED))
        # a block without any of them has no lists
        stream.append(spark.range(nu).withColumnRenamed("id", "b").crossJoin(listed).select(
            point, block, F.lit(-1).cast("long").alias("_m"), F.lit(_NONE).alias("kind"), F.array().cast("array<binary>").alias("parts")))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, held = None, [], None

        def done() -> None:
            nonlocal held
            if now[2] < 0:
                held = _Lists(n, item_block, cell)
            elif held is not None:
                held.items(now[2], cell)

        for batch in batches:
            for r in range(batch.num_rows):
                *at, kind = (batch.column(c)[r].as_py() for c in ("point", "_u", "_m", "kind"))
                if now is not None and at != now:
                    done()
                    if at[:2] != now[:2]:
                        if held is not None:
                            yield from held.best(now[0])
                        held = None
                    cell = []
                now = at
                cell.append((kind, batch.column("parts")[r].as_py()))
        if now is not None:
            done()
            if held is not None:
                yield from held.best(now[0])

    whole = stream[0]
    for s in stream[1:]:
        whole = whole.union(s)
    tasks = nu * len(points)
    best = whole.repartitionById(tasks, (_number("point", points) * nu + F.col("_u")).cast("int")) \
        .sortWithinPartitions("point", "_u", "_m") \
        .mapInArrow(lists, "point int, _user int, rank int, _item int, score double")
    return best.join(model.user_index, F.col("_user") == F.col("uidx")).join(model.item_index, F.col("_item") == F.col("iidx")) \
        .select("point", "user_id", "rank", "item_id", "score")
