"""Exact top-n lists from user x item scores, computed block by block.

Factor scores: users are hashed to blocks, each of which is a task that
holds its users' vectors, seen items and best items so far, while all items
stream past it, packed by cells of similar vectors.  So an item is sent once
to a block of users, a user once in all, and no score leaves a task but the
best n of each user.  A cell is left out for the users whose n-th score so
far is above what any vector of the cell can reach.  Given candidates are
scored by joins instead, and no other pair is made.

To the driver come counts, from which the numbers of blocks follow, and the
vectors that cells are made around, a bounded sample.  Scores are compared
rounded to 1e-9 in every cut, ties go to the smaller item id, so lists do
not depend on the partitioning.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from ..operators.ranking import top_n
from ..session import materialize

#: Users of a block of factor scores at most, items of a block, and users that are multiplied at once.
USER_BLOCK, ITEM_BLOCK, TILE = 131_072, 512, 512
#: User blocks for each core, if they have this many users at least.
SCORE_TASKS, LEAST_USERS = 4, 512
#: Seen pairs of a user block on average at most, and cells of items at most.
SEEN, PIVOTS = 8_000_000, 4096
#: For products: users of a cell and target items of a group at most.
PRODUCT_USERS, PRODUCT_ITEMS = 16_384, 65_536
#: Similarities of a group of target items and rows of a cell of users on average at most, and groups for each core.
SIMILAR, USER_ROWS, PRODUCT_TASKS = 24_000_000, 50_000, 2
#: Bytes of users and lists that groups get and give in one round, unless the similarities have more; bytes of
#: items that blocks of users get in one.
ROUND = 4_000_000_000
#: Rows in a packed cell at most.
PACK = 100_000
_USERS, _ITEMS, _OWN = range(3)
DIGITS = 9
#: Scores that are held at once, and products that are added at once.
SCORES, STEP = 500_000, 2_000_000


def _block(column: str, n: int):
    return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")


def _count_blocks(df: DataFrame, column: str, size: int) -> int:
    return max(1, math.ceil(df.select(column).distinct().count() / size))


def _best_cells(scores: np.ndarray, n: int, least: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the cells that may be among the best n of their row, at least those that are.

    ``least`` has a known lower bound of each row, minus infinity if there is none.
    The n-th best of the maxima of some column groups bounds a row's n-th
    best score from below, too; only cells that reach both are looked at.
    """
    wide = scores.shape[1]
    bound = np.full(len(scores), -np.inf) if least is None else least
    if scores.size and wide > n and np.isneginf(bound).any():
        lanes = min(wide, 8 * n)
        top = scores[:, :lanes].copy()
        for at in range(lanes, wide, lanes):
            w = min(lanes, wide - at)
            np.maximum(top[:, :w], scores[:, at:at + w], out=top[:, :w])
        bound = np.maximum(bound, np.partition(top, lanes - n, axis=1)[:, lanes - n] - 2 * 10.0 ** -DIGITS)
    elif least is None:
        return np.nonzero(np.isfinite(scores))
    found = np.flatnonzero(scores >= np.maximum(bound, np.finfo(float).min)[:, None])
    return np.divmod(found, max(wide, 1))


def best_of(scores: np.ndarray, users: np.ndarray, items: np.ndarray, n: int) -> pd.DataFrame:
    """Best n finite scores of each row; columns stand in ascending item order."""
    row, col = _best_cells(scores, n)
    r = np.round(scores[row, col], DIGITS)
    order = np.lexsort((col, -r, row))
    row, col = row[order], col[order]
    keep = np.arange(len(row)) - np.searchsorted(row, row) < n
    return _frame(users[row[keep]], items[col[keep]], scores[row, col][keep])


def _frame(users: np.ndarray, items: np.ndarray, scores: np.ndarray) -> pd.DataFrame:
    """Result rows; text ids stay plain objects."""
    return pd.DataFrame({"user_id": pd.Series(users, dtype=users.dtype), "item_id": pd.Series(items, dtype=items.dtype),
                         "score": scores})


def half_up(x: np.ndarray) -> np.ndarray:
    """Rounded as Spark's ``round`` does, which ``top_n`` compares: halves away from zero."""
    y = np.abs(x) * 10.0 ** DIGITS
    # larger numbers have no more digits
    return np.where(y < 2.0 ** 52, np.copysign(np.floor(y + 0.5) / 10.0 ** DIGITS, x), x)


def mask_pairs(scores: np.ndarray, users: np.ndarray, items: np.ndarray, seen: pd.DataFrame) -> None:
    """Minus infinity at seen pairs."""
    u, i = pd.Index(users).get_indexer(seen["user_id"]), pd.Index(items).get_indexer(seen["item_id"])
    ok = (u >= 0) & (i >= 0)
    scores[u[ok], i[ok]] = -np.inf


def _spread(df: DataFrame, other: str, n: int, first: int = 0) -> DataFrame:
    """A copy of every row for each block of the other side, from ``first`` on."""
    return df.withColumn(other, F.explode(F.sequence(F.lit(first), F.lit(n - 1))))


def score_candidates(user_factors: DataFrame, item_factors: DataFrame, candidates: DataFrame, n: int = 10,
                     seen: DataFrame | None = None) -> DataFrame:
    """J7 for given pairs (F8): the factors are joined to the pairs asked for."""
    pairs = candidates.select("user_id", "item_id").distinct()
    if seen is not None:
        pairs = pairs.join(seen.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
    bias = F.col("bias").cast("double") if "bias" in item_factors.columns else F.lit(0.0)
    both = pairs.join(user_factors.select("user_id", F.col("features").alias("_p")), "user_id") \
        .join(item_factors.select("item_id", F.col("features").alias("_q"), bias.alias("_b")), "item_id")
    product = F.zip_with("_p", "_q", lambda x, y: x.cast("double") * y.cast("double"))
    scored = both.withColumn("score", F.aggregate(product, F.lit(0.0), lambda a, x: a + x) + F.col("_b"))
    return top_n(scored.select("user_id", "item_id", "score"), n).select("user_id", "rank", "item_id", "score")


def _vectors(features: np.ndarray, bias: np.ndarray | float) -> np.ndarray:
    """Item vectors with the bias, user vectors with 1 as last number."""
    f = np.stack(features).astype(np.float64)
    return np.column_stack((f, np.broadcast_to(bias, len(f))))


def _nearest(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Place of the nearest pivot of each vector."""
    half = (pivots ** 2).sum(1) / 2
    return np.concatenate([(vectors[at:at + TILE] @ pivots.T - half).argmax(1) for at in range(0, len(vectors), TILE)])


def _similar_cells(items: DataFrame, size: int) -> tuple[DataFrame, np.ndarray]:
    """(packed items by cell, pivots): each item is in the cell of the nearest pivot.

    Pivots are the first items in hash order, one for ``size`` items but
    ``PIVOTS`` at most; long ones have the first cells.  A large cell is
    packed in several parts.
    """
    n = min(PIVOTS, _count_blocks(items, "item_id", size))
    rows = items.orderBy(F.xxhash64("item_id"), "item_id").limit(n).select("features", "b").collect()
    if not rows:
        return _cells(items, F.lit(0), ["item_id", "features", "b"]), np.zeros((1, 1))
    pivots = _vectors(np.array([r[0] for r in rows]), np.array([r[1] for r in rows], float))
    pivots = pivots[np.argsort(-(pivots ** 2).sum(1), kind="stable")]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                v = _vectors(b.column("features").to_numpy(zero_copy_only=False), b.column("b").to_numpy(zero_copy_only=False))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(_nearest(v, pivots), pa.int64())],
                                                 names=[*b.schema.names, "at"])

    kinds = dict(items.dtypes)
    placed = items.mapInArrow(place, ", ".join(f"{c} {kinds[c]}" for c in items.columns) + ", at long")
    return _cells(placed, F.col("at"), ["item_id", "features", "b"], size), pivots


def top_n_scores(user_factors: DataFrame, item_factors: DataFrame, n: int = 10, seen: DataFrame | None = None,
                 candidates: DataFrame | None = None, user_block: int = USER_BLOCK,
                 item_block: int = ITEM_BLOCK) -> DataFrame:
    """``(user_id, rank, item_id, score)``, the best n unseen items per user.

    score(u, i) = p_u . q_i + b_i with ``user_factors(user_id, features)``
    and ``item_factors(item_id, features [, bias])``.  ``seen`` pairs are
    left out (F7); with ``candidates`` only those pairs are scored, by two
    joins (F8).
    """
    if candidates is not None:
        return score_candidates(user_factors, item_factors, candidates, n, seen)
    spark = user_factors.sparkSession
    n_users = user_factors.select("user_id").distinct().count()
    few = min(SCORE_TASKS * spark.sparkContext.defaultParallelism, math.ceil(n_users / LEAST_USERS))
    many = 0 if seen is None else math.ceil(seen.count() / SEEN)
    nu = max(1, few, many, math.ceil(n_users / user_block))
    bias = F.col("bias").cast("double") if "bias" in item_factors.columns else F.lit(0.0)
    users = _cells(user_factors.select("user_id", "features"), _block("user_id", nu), ["user_id", "features"])
    items, pivots = _similar_cells(item_factors.select("item_id", "features", bias.alias("b")), item_block)
    ni = len(pivots)
    pairs = None if seen is None else _cells(seen.select("user_id", "item_id").distinct(), _block("user_id", nu), ["user_id", "item_id"])
    place = lambda u, m: (u * (ni + 1) + m).cast("long").alias("_at")
    fields = [user_factors.schema["user_id"], item_factors.schema["item_id"]]
    schema = to_arrow_schema(StructType([StructField(f.name, f.dataType) for f in fields] + [StructField("score", DoubleType())]))

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, held = None, [], _TopScores(n, pivots)
        for b in batches:
            for place, kind, packed in zip(b.column("_at").to_pylist(), b.column("kind").to_pylist(), b.column("packed")):
                if place != now:
                    held.take(cell)
                    if now is not None and place // (ni + 1) != now // (ni + 1):
                        yield from held.best(schema)
                        held = _TopScores(n, pivots)
                    now, cell = place, []
                cell.append((kind, packed.as_py()))
        held.take(cell)
        yield from held.best(schema)

    kinds = [f.dataType.simpleString() for f in fields]

    def of_blocks(lo: int, hi: int) -> DataFrame:
        u, first = F.col("cell").alias("_u"), place(F.col("cell"), F.lit(0))
        own = lambda df: df.where((F.col("cell") >= lo) & (F.col("cell") < hi))
        stream = own(users).select(u, first, F.lit(_USERS).alias("kind"), "packed") \
            .union(_spread(items, "_u", hi, lo).select("_u", place(F.col("_u"), F.col("cell") + 1), F.lit(_ITEMS), "packed"))
        if pairs is not None:
            stream = stream.union(own(pairs).select(u, first, F.lit(_OWN), "packed"))
        best = stream.repartitionById(hi - lo, (F.col("_u") - lo).cast("int")).sortWithinPartitions("_at").select("_at", "kind", "packed") \
            .mapInArrow(lists, f"user_id {kinds[0]}, item_id {kinds[1]}, score double")
        return top_n(best, n).select("user_id", "rank", "item_id", "score")

    # the copies of the items for all blocks of users do not lie on disk at once
    sent = nu * item_factors.count() * 8 * (pivots.shape[1] + 1)
    rounds = max(1, min(math.ceil(sent / ROUND), nu // spark.sparkContext.defaultParallelism))
    if rounds == 1:
        return of_blocks(0, nu)
    users, items, pairs = (None if t is None else materialize(t, "score-cells") for t in (users, items, pairs))
    cuts = [nu * r // rounds for r in range(rounds + 1)]
    return reduce(DataFrame.union, [materialize(of_blocks(lo, hi), "lists") for lo, hi in zip(cuts, cuts[1:])])


def _unpack(packed: bytes) -> list[np.ndarray]:
    """Columns of ``_pack`` or ``_pack_whole``."""
    t = pa.ipc.open_stream(packed).read_all()
    out, planes = [], []
    for field, c in zip(t.schema, t.columns):
        kind = (field.metadata or {}).get(b"bytes")
        if kind is None:
            out.append(c.to_numpy())
            continue
        planes.append(c.to_numpy())
        if kind == b"last":
            x = np.zeros((t.num_rows, 8), np.uint8)
            for k, plane in enumerate(planes):
                x[:, k] = plane
            x = x.view("<u8").ravel()
            out.append(np.cumsum((x >> np.uint64(1)).view(np.int64) ^ -(x & np.uint64(1)).view(np.int64)))
            planes = []
    return out


def _pack_whole(columns: dict[str, np.ndarray]) -> bytes:
    """``_pack`` that takes whole numbers as differences, byte by byte, which needs less space if neighbours are close."""
    fields, arrays = [], []
    for name, x in columns.items():
        if x.dtype.kind not in "iu":
            arrays.append(pa.array(x))
            fields.append(pa.field(name, arrays[-1].type))
            continue
        d = np.diff(x.astype(np.int64), prepend=np.int64(0))
        z = np.ascontiguousarray(((d << 1) ^ (d >> 63)).astype("<u8"))
        wide = max(1, -(-int(z.max()).bit_length() // 8)) if len(z) else 1
        planes = z.view(np.uint8).reshape(len(z), 8)
        for k in range(wide):
            arrays.append(pa.array(np.ascontiguousarray(planes[:, k])))
            fields.append(pa.field(f"{name}{k}", pa.uint8(), metadata={"bytes": "last" if k == wide - 1 else "more"}))
    return _pack(pa.Table.from_arrays(arrays, schema=pa.schema(fields)))


def _pack(t: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, t.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_table(t.combine_chunks())
    return sink.getvalue().to_pybytes()


def _cells(df: DataFrame, cell: Column, columns: list[str], target: int = PACK) -> DataFrame:
    """(cell, packed): rows of each cell as packed columns, at most ``target`` rows in one."""
    def pack(cell: int, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([cell]), pa.array([_pack(pa.Table.from_batches(parts))], pa.binary())],
                                          names=["cell", "packed"])

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0
        for b in batches:
            place = b.column("cell").to_numpy()
            b = b.select(columns)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(place)) + 1, [len(place)]))
            for lo, hi in zip(cuts, cuts[1:]):
                if hi == lo:
                    continue
                if parts and (place[lo] != now or size >= target):
                    yield pack(now, parts)
                    parts, size = [], 0
                now, size = int(place[lo]), size + hi - lo
                parts.append(b.slice(lo, hi - lo))
        if parts:
            yield pack(now, parts)

    # sorted by one number
    return df.withColumn("cell", cell.cast("long")).select("cell", *columns).repartition("cell") \
        .sortWithinPartitions("cell").mapInArrow(cells, "cell long, packed binary")


def _by_kind(cell: list[tuple[int, bytes]]) -> dict[int, list[np.ndarray]]:
    """Columns of the packed rows of a cell, by kind."""
    parts = {kind: [_unpack(p) for k, p in cell if k == kind] for kind in {k for k, _ in cell}}
    return {kind: [np.concatenate(c) for c in zip(*found)] for kind, found in parts.items()}


class _TopScores:
    """Best items of one block of users, while the cells of items come one after the other.

    Held are the users' vectors and seen items, n items of each user with
    the n-th score as the bound that further items must reach, and one cell.
    """

    def __init__(self, n: int, pivots: np.ndarray):
        self.n, self.pivots = n, pivots
        self.users: np.ndarray | None = None

    def take(self, cell: list[tuple[int, bytes]]) -> None:
        """The users with what they have seen, or a cell of items."""
        if any(kind == _USERS for kind, _ in cell):
            parts = _by_kind(cell)
            ids, features = parts[_USERS]
            p = _vectors(features, 1.0)
            # like users side by side
            order = np.argsort(_nearest(p, self.pivots), kind="stable") if self.pivots.shape[1] == p.shape[1] else np.arange(len(p))
            self.users, self.p = ids[order], p[order]
            self.length = np.sqrt((self.p ** 2).sum(1))
            self.least = np.full(len(ids), -np.inf)
            self.tiles = [[] for _ in range(0, len(ids), TILE)]
            self.slot, self.item = np.zeros(0, int), np.zeros(0, int)
            if _OWN in parts:
                user, item = parts.pop(_OWN)
                slot = pd.Index(self.users).get_indexer(user).astype(np.int32)
                del user
                known = (slot >= 0) & pd.notna(item)
                if not known.all():
                    slot, item = slot[known], item[known]
                order = np.argsort(item, kind="stable")
                self.slot, self.item = slot[order], item[order]
            return
        for kind, packed in cell:
            if kind == _ITEMS and self.users is not None:
                self._items(*_unpack(packed))

    def _items(self, ids: np.ndarray, features: np.ndarray, bias: np.ndarray) -> None:
        order = pd.Series(ids).sort_values(kind="stable").index.to_numpy()
        ids, q = ids[order], _vectors(features, bias)[order]
        may = ~(self._reach(q) < self.least)
        if not may.any():
            return
        slot = col = np.zeros(0, int)
        if len(self.item):
            known = ids[pd.notna(ids)]
            first = np.searchsorted(self.item, known)
            many = np.searchsorted(self.item, known, "right") - first
            col = np.repeat(np.arange(len(known)), many)
            slot = self.slot[np.repeat(first - np.cumsum(many) + many, many) + np.arange(len(col))]
            order = np.argsort(slot, kind="stable")
            slot, col = slot[order], col[order]
        for t in np.unique(np.flatnonzero(may) // TILE):
            lo, hi = t * TILE, min((t + 1) * TILE, len(self.users))
            rows = np.flatnonzero(may[lo:hi])
            scores = self.p[lo + rows] @ q.T
            own = slice(*np.searchsorted(slot, (lo, hi)))
            at = np.minimum(np.searchsorted(rows, slot[own] - lo), len(rows) - 1)
            hit = rows[at] == slot[own] - lo
            scores[at[hit], col[own][hit]] = -np.inf
            row, at = _best_cells(scores, self.n, self.least[lo + rows])
            if len(row):
                self.tiles[t].append((rows[row], ids[at], scores[row, at]))
                if sum(len(p[0]) for p in self.tiles[t]) >= 1.5 * self.n * (hi - lo):
                    self._cut(t)

    def _reach(self, q: np.ndarray) -> np.ndarray:
        """What the scores of a user with vectors ``q`` cannot exceed, from their ball and their cone."""
        middle = q.mean(0)
        long, norm = np.sqrt((q ** 2).sum(1)), np.sqrt((middle ** 2).sum())
        dot = self.p @ middle
        ball = dot + self.length * np.sqrt(((q - middle) ** 2).sum(1).max())
        with np.errstate(divide="ignore", invalid="ignore"):
            wide = np.clip((q @ middle / (long * norm)).min(), -1.0, 1.0)
            cos = np.clip(dot / (self.length * norm), -1.0, 1.0)
        near = cos * wide + np.sqrt((1 - cos ** 2) * (1 - wide ** 2))
        cone = self.length * long.max() * np.where(cos >= wide, 1.0, np.maximum(near, 0.0))
        # rounding of bounds and scores
        return np.fmin(ball, cone) + 1e-9 * (1 + self.length * long.max())

    def _cut(self, t: int) -> None:
        """Keep the best n of each user of a tile."""
        row, item, score = (np.concatenate(c) for c in zip(*self.tiles[t]))
        r = np.round(score, DIGITS)
        order = np.lexsort((pd.factorize(item, sort=True)[0] if item.dtype == object else item, -r, row))
        row, item, score, r = row[order], item[order], score[order], r[order]
        nth = np.arange(len(row)) - np.searchsorted(row, row)
        keep, last = nth < self.n, nth == self.n - 1
        self.tiles[t] = [(row[keep], item[keep], score[keep])]
        self.least[t * TILE + row[last]] = r[last] - 2 * 10.0 ** -DIGITS

    def best(self, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
        for t in range(0 if self.users is None else len(self.tiles)):
            if self.tiles[t]:
                self._cut(t)
                row, item, score = self.tiles[t][0]
                yield pa.RecordBatch.from_pandas(_frame(self.users[t * TILE + row], item, score), schema, preserve_index=False)


def _narrow(x: np.ndarray) -> np.ndarray:
    """Integers in the smallest type that holds them."""
    if x.dtype.kind not in "iu" or not len(x) or x.max() >= 1 << 32:
        return x
    return x.astype(np.promote_types(np.min_scalar_type(x.min()), np.min_scalar_type(x.max())))


def _coded(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, place of each key among them); keys are numbers from 0."""
    bits = len(key).bit_length()
    if not len(key) or int(key.max()).bit_length() + bits > 63:
        return np.unique(key, return_inverse=True)
    # keys and places sorted as one number
    both = np.sort((key.astype(np.uint64) << np.uint64(bits)) | np.arange(len(key), dtype=np.uint64))
    found = both >> np.uint64(bits)
    first = np.concatenate(([True], found[1:] != found[:-1]))
    code = np.empty(len(key), np.int64)
    code[(both & np.uint64((1 << bits) - 1)).astype(np.int64)] = np.cumsum(first) - 1
    return found[first].astype(np.int64), code


class _Ragged:
    """Best n of each row of scores that lie one row after the other; ``first`` has the rows' places and the end."""

    def __init__(self, first: np.ndarray, n: int):
        self.first, self.n, self.many = first, n, np.diff(first)
        # pieces of a row, some times n of them at most
        size = np.maximum(1, -(-self.many // (8 * n)))
        self.pieces = -(-self.many // size)
        self.row = np.repeat(np.arange(len(self.many)), self.pieces)
        self.nth = np.arange(len(self.row)) - np.repeat(np.cumsum(self.pieces) - self.pieces, self.pieces)
        self.at = first[self.row] + self.nth * size[self.row]

    def candidates(self, scores: np.ndarray, hidden: np.ndarray) -> np.ndarray:
        """Places that may be among the best n of their row, or among the best n of it that are not hidden.

        The n-th best of the pieces' maxima bounds a row's n-th best score from below.
        """
        if not len(scores):
            return np.zeros(0, int)
        bound = np.full(len(self.many), -np.inf)
        if len(self.many) and self.pieces.max() >= self.n:
            open_ = np.where(np.isnan(scores), -np.inf, scores)
            open_[hidden] = -np.inf
            top = np.full((len(self.many), int(self.pieces.max())), -np.inf)
            top[self.row, self.nth] = np.maximum.reduceat(open_, self.at)
            bound = np.partition(top, top.shape[1] - self.n, axis=1)[:, top.shape[1] - self.n] - 2 * 10.0 ** -DIGITS
        return np.flatnonzero(scores >= np.repeat(np.maximum(bound, np.finfo(float).min), self.many))


def _nan_limits(scores: np.ndarray, row: np.ndarray, rows: int, target: np.ndarray, wide: int, n: int) -> np.ndarray:
    """What the scores of a row must reach if some of the row are NaN (affinities without a rating).

    These count as best ones without a place in the list: the limit is the
    n-th best of the maxima of column groups, and a row with n groups that
    have one has no list.
    """
    limit = np.full(rows, -np.inf)
    bad = np.unique(row[np.isnan(scores)])
    if len(bad) and wide > n:
        lanes = min(wide, 8 * n)
        place = np.full(rows, -1)
        place[bad] = np.arange(len(bad))
        at = np.flatnonzero(place[row] >= 0)
        top = np.full((len(bad), lanes), -np.inf)
        np.maximum.at(top, (place[row[at]], target[at] % lanes), scores[at])
        nth = np.partition(top, lanes - n, axis=1)[:, lanes - n] - 2 * 10.0 ** -DIGITS
        limit[bad] = np.where(np.isnan(nth), np.inf, nth)
    return limit


class _Product:
    """Lists of all users among one group of target items, for every pair of a similarity and an affinity.

    Held are the similarities of the group, ordered by middle item, one cell
    of users, and the scores that some users have (users x targets are not
    made).  A point is (name, place of its similarity, place of its
    affinity, remove_seen); ``like`` makes the similarities of the packed
    columns after target and middle, which are held in their smallest types.
    """

    def __init__(self, parts: list[bytes], n: int, points: list[tuple[int, int, int, bool]],
                 like: Callable[..., list[np.ndarray]] | None = None):
        self.n, self.points, self.like = n, points, like
        columns = [list(c) for c in zip(*([_narrow(x) for x in _unpack(p)] for p in parts))]
        for k, c in enumerate(columns):
            columns[k] = np.concatenate(c)
            c.clear()
        target, middle = columns[:2]
        del columns[:2]
        wide = lambda ids: ids.astype(np.int64) if ids.dtype.kind in "iu" else ids
        to, self.targets = pd.factorize(target, sort=True)
        to, self.targets = to.astype(np.int32), wide(self.targets)
        del target
        source, self.middle = pd.factorize(middle, sort=True)
        self.middle = wide(self.middle)
        del middle
        self.first = np.concatenate(([0], np.cumsum(np.bincount(source, minlength=len(self.middle)))))
        bits = len(source).bit_length()
        # by middle item, in the order they came
        order = source.astype(np.uint64)
        del source
        order <<= np.uint64(bits)
        order |= np.arange(len(order), dtype=np.uint64)
        order.sort()
        order &= np.uint64((1 << bits) - 1)
        order = order.view(np.int64)
        self.to = to[order]
        del to
        for k, c in enumerate(columns):
            columns[k] = c[order]
        self.columns = columns

    @staticmethod
    def _find(known: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        return at, known[at] == values

    def lists(self, parts: list[bytes]) -> Iterator[pd.DataFrame]:
        """Best n of each user of a cell for every pair, with and without seen items as its points ask for."""
        user, item, *values = (np.concatenate(c) for c in zip(*map(_unpack, parts)))
        slot, users = pd.factorize(user, sort=True)
        order = np.argsort(slot, kind="stable")
        slot, item, values = slot[order], item[order], [v[order] for v in values]
        at, has = self._find(self.middle, item)
        lo = self.first[at]
        many = np.where(has, self.first[at + 1] - lo, 0)
        own, seen = self._find(self.targets, item)
        wide = len(self.targets)
        # users with about STEP terms, one at least
        start = np.searchsorted(slot, np.arange(len(users) + 1))
        ends, u = np.concatenate(([0], np.cumsum(many)))[start], 0
        while u < len(users):
            v = max(u + 1, int(np.searchsorted(ends, ends[u] + STEP, "right")) - 1)
            rows, u = slice(start[u], start[v]), v
            keys, sums = self._sums(slot[rows], lo[rows], many[rows], [x[rows] for x in values])
            if not len(keys):
                continue
            mine = np.sort(slot[rows][seen[rows]] * wide + own[rows][seen[rows]])
            at = np.minimum(np.searchsorted(keys, mine), len(keys) - 1)
            known = np.zeros(len(keys), bool)
            known[at[keys[at] == mine]] = True
            row, target = np.divmod(keys, wide)
            new = np.concatenate(([True], row[1:] != row[:-1]))
            best, nth_row = _Ragged(np.append(np.flatnonzero(new), len(row)), self.n), np.cumsum(new) - 1
            for pair, scores in sums.items():
                kept = {p[3] for p in self.points if p[1:3] == pair}
                at = best.candidates(scores, known if True in kept else np.zeros(0, int))
                at = at[scores[at] != 0]
                if False not in kept:
                    at = at[~known[at]]
                at = at[np.lexsort((at, -half_up(scores[at]), row[at]))]
                nth, unseen = _places(row[at], known[at])
                keep, nan = np.zeros(len(at), bool), np.isnan(scores).any()
                for removed in kept:
                    part = (unseen < self.n) & ~known[at] if removed else nth < self.n
                    if nan:
                        open_ = np.where((known & removed) | (scores == 0), -np.inf, scores)
                        part &= scores[at] >= _nan_limits(open_, nth_row, len(best.many), target, wide, self.n)[nth_row[at]]
                    keep |= part
                at = at[keep]
                yield _frame(users[row[at]], self.targets[target[at]], scores[at]).assign(
                    seen=known[at], pair=np.int32(pair[0] * len(values) + pair[1]))

    def _sums(self, slot: np.ndarray, lo: np.ndarray, many: np.ndarray,
              values: list[np.ndarray]) -> tuple[np.ndarray, dict[tuple[int, int], np.ndarray]]:
        """(places ``slot * targets + target`` in order, their scores by similarity and affinity).

        Each item adds its affinity times its similarities, about STEP terms at a time.
        """
        wide, keys, total = len(self.targets), np.zeros(0, np.int64), {}
        pairs = sorted({p[1:3] for p in self.points})
        ends = np.cumsum(many)
        cuts = np.searchsorted(ends, np.arange(STEP, ends[-1] if len(ends) else 0, STEP), "right").tolist()
        for a, b in zip([0, *cuts], [*cuts, len(many)]):
            m = many[a:b]
            n = int(m.sum())
            if not n:
                continue
            at = np.repeat(lo[a:b] - np.cumsum(m) + m, m) + np.arange(n)
            found, code = _coded(np.repeat(slot[a:b] * wide, m) + self.to[at])
            sims = [c[at] for c in self.columns]
            sims = sims if self.like is None else self.like(*sims)
            part = {}
            for v in sorted({v for _, v in pairs}):
                value = np.repeat(values[v][a:b], m)
                for pair in (p for p in pairs if p[1] == v):
                    part[pair] = np.bincount(code, value * sims[pair[0]], len(found))
            if len(keys):
                keys, code = _coded(np.concatenate((keys, found)))
                total = {pair: np.bincount(code, np.concatenate((total[pair], part[pair])), len(keys)) for pair in pairs}
            else:
                keys, total = found, part
        return keys, total


def _places(row: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places from 0 of each row's entries, which come in order, among all and among those not known."""
    first = np.searchsorted(row, row)
    before = np.cumsum(~known) - ~known
    return np.arange(len(row)) - first, before - (before[first] if len(row) else 0)


def product_candidates(affinity: DataFrame, similarity: DataFrame, candidates: DataFrame, n: int = 10,
                       remove_seen: bool = True) -> DataFrame:
    """J6 for given pairs (F8): two joins make the terms of the pairs asked for, and no others."""
    pairs = candidates.select("user_id", F.col("item_id").alias("_j")).distinct()
    if remove_seen:
        pairs = pairs.join(affinity.select("user_id", F.col("item_id").alias("_j")), ["user_id", "_j"], "left_anti")
    terms = pairs.join(affinity.select("user_id", "item_id", "affinity"), "user_id") \
        .join(similarity.select(F.col("i").alias("item_id"), F.col("j").alias("_j"), "sim"), ["item_id", "_j"])
    scored = terms.groupBy("user_id", F.col("_j").alias("item_id")).agg(
        F.sum(F.col("affinity") * F.col("sim")).alias("score")).where("score <> 0")
    return top_n(scored, n).select("user_id", "rank", "item_id", "score")


def top_n_products(affinity: DataFrame, pairs: DataFrame, n: int = 10, remove_seen: bool = True,
                   candidates: DataFrame | None = None, user_block: int = PRODUCT_USERS,
                   item_block: int = PRODUCT_ITEMS) -> DataFrame:
    """``(user_id, rank, item_id, score)`` with score(u, j) = sum_i affinity(u, i) similarity(i, j).

    ``affinity(user_id, item_id, affinity)``; ``pairs(i, j, sim)`` has each
    pair of items once and counts in both directions.  Pairs without
    evidence (score 0) are not ranked.  With ``candidates`` only those
    pairs are made, by joins.  See ``products_of_cells``.
    """
    both = pairs.select("i", "j", "sim").union(pairs.select("j", "i", "sim"))
    if candidates is not None:
        return product_candidates(affinity, both, candidates, n, remove_seen)
    groups = max(_groups(2 * pairs.count(), affinity), _count_blocks(both, "j", item_block))
    sims = _cells(both.select("j", "i", F.col("sim").cast("double").alias("v")), _block("j", groups), ["j", "i", "v"])
    return products_of_cells(affinity, sims, groups, n, remove_seen, user_block)


def _groups(similarities: int, affinity: DataFrame, tasks: int = PRODUCT_TASKS) -> int:
    """Groups of target items for so many similarities."""
    few = min(tasks * affinity.sparkSession.sparkContext.defaultParallelism, similarities // 100_000)
    return max(1, few, math.ceil(similarities / SIMILAR))


def _in_rounds(affinities: DataFrame, groups: int, similarities: int, pairs: int, n: int,
               lists: Callable[[DataFrame], DataFrame], write: bool = False) -> DataFrame:
    """``lists(affinities)``, made for some of the users at a time if their copies need more disk than the similarities.

    What a round shuffles is gone when its lists are written.
    """
    rows, users = affinities.agg(F.count(F.lit(1)), F.approx_count_distinct("user_id")).first()
    sent = groups * (rows * 6 * (len(affinities.columns) - 1) + users * pairs * n * 20)
    rounds = math.ceil(sent / max(ROUND, 4 * similarities))
    if rounds <= 1:
        return materialize(lists(affinities), "lists") if write else lists(affinities)
    # hashed twice: the blocks of users go by their hash
    part = F.pmod(F.xxhash64(F.xxhash64("user_id")), F.lit(rounds))
    return reduce(DataFrame.union, [materialize(lists(affinities.where(part == r)), "lists") for r in range(rounds)])


def products_of_cells(affinity: DataFrame, sims: DataFrame, groups: int, n: int = 10, remove_seen: bool = True,
                      user_block: int = PRODUCT_USERS, like: Callable[..., list[np.ndarray]] | None = None,
                      similarities: int = 0) -> DataFrame:
    """Lists from packed similarities ``(cell, packed)``, ``cell`` a group of target items and packed the
    columns target, middle item and similarity, or what ``like`` makes it of.

    A task holds the similarities of a group (about ``SIMILAR``), past which
    all users stream, packed by cells.  So a similarity is sent once, an
    affinity once to each group, no product becomes a row, and only the
    best n of each user and group leave the task.  Of users one cell is
    held: about ``USER_ROWS`` rows, or one long history.  Many users are
    taken in rounds, ``similarities`` the number of those in ``sims``.
    """
    one = affinity.select("user_id", "item_id", F.col("affinity").alias("v0"))
    fields = [affinity.schema["user_id"], affinity.schema["item_id"], StructField("score", DoubleType())]
    schema = to_arrow_schema(StructType([StructField(f.name, f.dataType) for f in fields]))

    def rows(cell: int, found: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        for f in found:
            yield pa.RecordBatch.from_pandas(f[schema.names], schema, preserve_index=False)

    kinds = [f.dataType.simpleString() for f in fields]

    def lists(some: DataFrame) -> DataFrame:
        best = _products(some, sims, groups, [(0, 0, 0, remove_seen)], n, like, user_block, rows,
                         f"user_id {kinds[0]}, item_id {kinds[1]}, score double")
        return top_n(best, n).select("user_id", "rank", "item_id", "score")

    return _in_rounds(one, groups, similarities, 1, n, lists)


def grid_products(affinities: DataFrame, cells: DataFrame, groups: int, points: list[tuple[int, int, int, bool]],
                  n: int = 10, like: Callable[..., list[np.ndarray]] | None = None,
                  user_block: int = PRODUCT_USERS, similarities: int = 0) -> DataFrame:
    """``products_of_cells`` for many points in one pass, written: ``(point, user_id, rank, item_id, score)``.

    ``affinities`` has a column v0, v1, ... for each affinity, ``cells`` the
    packed columns target, middle item and similarities, or what ``like``
    makes these of; ``points`` are (name, similarity, affinity, remove_seen).
    Similarities and users are sent once for all points.  The best n of a
    group go packed to the task of the cell of users, which holds the best
    so far and some parts.
    """
    spark = affinities.sparkSession
    wide = len([c for c in affinities.columns if c not in ("user_id", "item_id")])
    ids = to_arrow_schema(StructType([affinities.schema["user_id"], affinities.schema["item_id"]]))
    found_schema = pa.schema([*ids, ("score", pa.float64()), ("seen", pa.bool_()), ("pair", pa.int32())])

    def pack(cell: int, found: Iterator[pd.DataFrame]) -> Iterator[pa.RecordBatch]:
        if found := [f for f in found if len(f)]:
            part = pa.Table.from_pandas(pd.concat(found)[found_schema.names], found_schema, preserve_index=False)
            yield pa.RecordBatch.from_arrays([pa.array([cell], pa.int64()), pa.array([_pack(part)], pa.binary())],
                                             names=["cell", "packed"])

    wanted = {}
    for name, s, v, removed in points:
        wanted.setdefault(s * wide + v, []).append((name, removed))

    def cut(parts: list[pd.DataFrame]) -> pd.DataFrame:
        """Rows in order, with their places ``all`` and ``unseen``, those beyond all lists left out."""
        f = pd.concat(parts, ignore_index=True)
        f = f.assign(_r=-half_up(f["score"].to_numpy())).sort_values(["pair", "user_id", "_r", "item_id"]).drop(columns="_r")
        by = [f["pair"], f["user_id"]]
        f["all"] = f.groupby(by, sort=False).cumcount() + 1
        f["unseen"] = (~f["seen"]).astype(int).groupby(by, sort=False).cumsum().where(~f["seen"], n + 1)
        return f[(f["all"] <= n) | (f["unseen"] <= n)]

    schema = pa.schema([("point", pa.int32()), ids.field(0), ("rank", pa.int32()), ids.field(1), ("score", pa.float64())])

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts, size = None, [], 0

        def done() -> Iterator[pa.RecordBatch]:
            for pair, f in cut(parts).groupby("pair") if parts else ():
                for name, removed in wanted[pair]:
                    f["rank"], f["point"] = f["unseen" if removed else "all"], name
                    yield pa.RecordBatch.from_pandas(f[f["rank"] <= n][schema.names], schema, preserve_index=False)

        for b in batches:
            for cell, packed in zip(b.column("cell").to_pylist(), b.column("packed").to_pylist()):
                if cell != now:
                    yield from done()
                    now, parts, size = cell, [], 0
                parts.append(pa.ipc.open_stream(packed).read_pandas())
                size += len(parts[-1])
                if size >= STEP:
                    held = cut(parts)
                    # what is held does not count
                    parts, size = [held[found_schema.names]], 0
        yield from done()

    kinds = [affinities.schema[c].dataType.simpleString() for c in ("user_id", "item_id")]
    tasks = 4 * spark.sparkContext.defaultParallelism

    def of_some(some: DataFrame) -> DataFrame:
        best = _products(some, cells, groups, points, n, like, user_block, pack, "cell long, packed binary")
        return best.repartitionById(tasks, F.pmod("cell", F.lit(tasks)).cast("int")).sortWithinPartitions("cell") \
            .mapInArrow(lists, f"point int, user_id {kinds[0]}, rank int, item_id {kinds[1]}, score double")

    return _in_rounds(affinities, groups, similarities, len({p[1:3] for p in points}), n, of_some, True)


def _products(affinities: DataFrame, cells: DataFrame, groups: int, points: list[tuple[int, int, int, bool]], n: int,
              like: Callable[..., list[np.ndarray]] | None, user_block: int, give: Callable, schema: str) -> DataFrame:
    """What ``give(cell of users, best of the group)`` makes for every group and cell of users."""
    spark = affinities.sparkSession
    values = [c for c in affinities.columns if c not in ("user_id", "item_id")]
    known = affinities.where(F.col("user_id").isNotNull() & F.col("item_id").isNotNull())
    nu = max(_count_blocks(known, "user_id", user_block), math.ceil(known.count() / USER_ROWS))
    own = _cells(known.select("user_id", "item_id", *(F.col(c).cast("double").alias(c) for c in values)),
                 _block("user_id", nu), ["user_id", "item_id", *values])
    stream = cells.select((F.col("cell") * (nu + 1)).cast("long").alias("_at"), "packed") \
        .union(_spread(own, "_g", groups).select((F.col("_g").cast("long") * (nu + 1) + F.col("cell") + 1).alias("_at"), "packed"))

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell, product = None, [], None

        def done() -> Iterator[pa.RecordBatch]:
            if product is not None and now % (nu + 1):
                yield from give(now % (nu + 1) - 1, product.lists(cell))

        for b in batches:
            for place, packed in zip(b.column("_at").to_pylist(), b.column("packed")):
                if place != now:
                    yield from done()
                    if now is not None and now % (nu + 1) == 0:
                        product = None
                        product = _Product(cell, n, points, like)
                    if now is None or place // (nu + 1) != now // (nu + 1):
                        product = None  # a group without similarities has no lists
                    now, cell = place, []
                cell.append(packed.as_py())
        yield from done()

    tasks = min(groups, 16 * spark.sparkContext.defaultParallelism)
    return stream.repartitionById(tasks, F.pmod(F.floor(F.col("_at") / (nu + 1)), F.lit(tasks)).cast("int")) \
        .sortWithinPartitions("_at").mapInArrow(multiply, schema)
