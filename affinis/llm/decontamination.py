"""Benchmark decontamination by size-partitioned MinHash containment search.

Finds short test items inside long documents.  Words are lower-cased runs
of letters and digits, so case and punctuation do not hide a copy.

MinHash estimates Jaccard similarity, which is tiny between a short item
and a long document.  Items are therefore partitioned by size: for items
of up to S = 2, 4, 8, ... shingles a document is cut into segments of 2 S
shingles at a stride of S, so that some segment holds the whole passage
and is at most four times as long as the item.  Block minima of S shingles
are merged pairwise into the segments of this and the next size.  One equal
coordinate of ``COORDS`` makes a candidate; a passage with the required
containment misses all of them with a probability near 1e-6.  Candidates
are verified by exact containment: the share of the item's shingles that
the document has.

Items are dealt by hash to blocks of bounded size and searched against all
documents; each block is one pass over the documents without a shuffle, and
its hits are written before the next block is loaded.

Cases: items and documents without words match nothing; items shorter than
a shingle are one shingle of their own length; repeated items or documents
give repeated rows; null texts count as empty, null ids stay null; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.words import (U64, Words, find_words, gram_starts, grams, slices, text_bytes, word_hashes)
from affinis.session import materialize

COORDS = 64
#: Shingles of the items of one block: bounds what is sent to the tasks (8 bytes each).
BLOCK_SHINGLES = 250_000

_rng = np.random.default_rng(11)
_MUL = _rng.integers(1, 2**64, COORDS, dtype=U64) | U64(1)
_ADD = _rng.integers(1, 2**64, COORDS, dtype=U64)
_INSIDE = np.array([(48 <= b <= 57) or (97 <= b <= 122) or b >= 128 for b in range(256)])


def _words(column: pa.Array) -> tuple[Words, np.ndarray]:
    data, bounds = text_bytes(pc.utf8_lower(column.fill_null("")))
    w = find_words(data, bounds, _INSIDE[data])
    return w, word_hashes(w)


class Group(NamedTuple):
    """Items of one size: their numbers and, per coordinate, values in order with their owners."""

    size: int
    values: np.ndarray  # COORDS x items
    owners: np.ndarray
    table: np.ndarray   # COORDS x 2**bits: a value with these low bits exists
    mask: U64


class Items(NamedTuple):
    ids: list
    sets: list[np.ndarray]
    groups: list[Group]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # words -> (hash, item number), in hash order


def index_items(ids: list, lengths: list[int], sets: list[np.ndarray], shingle: int) -> Items:
    by_size: dict[int, list[int]] = {}
    short: dict[int, list[int]] = {}
    for i, (n, s) in enumerate(zip(lengths, sets)):
        if n >= shingle:
            by_size.setdefault(1 << max(1, (len(s) - 1).bit_length()), []).append(i)
        elif n:
            short.setdefault(n, []).append(i)
    groups = []
    for size, members in sorted(by_size.items()):
        least = np.array([[(sets[i] * _MUL[k] + _ADD[k]).min() for i in members] for k in range(COORDS)], U64)
        order = np.argsort(least, axis=1, kind="stable")
        mask = U64((1 << max(12, (16 * len(members)).bit_length())) - 1)
        table = np.zeros((COORDS, int(mask) + 1), bool)
        np.put_along_axis(table, (least & mask).astype(np.int64), True, axis=1)
        groups.append(Group(size, np.take_along_axis(least, order, 1), np.array(members)[order], table, mask))
    few = {}
    for n, members in short.items():
        h = np.array([sets[i][0] for i in members], U64)
        order = np.argsort(h, kind="stable")
        few[n] = h[order], np.array(members)[order]
    return Items(ids, sets, groups, few)


def _minima(g: np.ndarray, ptr: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(COORDS x blocks) minima of ``size`` shingles each, and the first block of each document."""
    n = np.diff(ptr)
    blocks = -(-n // size)
    first = np.concatenate(([0], np.cumsum(blocks)))
    inside = np.arange(first[-1]) - np.repeat(first[:-1], blocks)
    starts = np.repeat(ptr[:-1], blocks) + inside * size
    out = np.empty((COORDS, len(starts)), U64)
    for k in range(COORDS if len(starts) else 0):
        out[k] = np.minimum.reduceat(g * _MUL[k] + _ADD[k], starts)
    return out, first


def _merge(least: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of twice the size."""
    blocks = np.diff(first)
    half = -(-blocks // 2)
    new = np.concatenate(([0], np.cumsum(half)))
    left = np.repeat(first[:-1], half) + 2 * (np.arange(new[-1]) - np.repeat(new[:-1], half))
    right = np.minimum(left + 1, np.repeat(first[1:], half) - 1)
    return np.minimum(least[:, left], least[:, right]), new


def candidates(g: np.ndarray, ptr: np.ndarray, items: Items) -> set[tuple[int, int]]:
    """(document, item) pairs of the slice with an equal coordinate in some segment."""
    found: set[tuple[int, int]] = set()
    if not items.groups or not len(g):
        return found
    size = items.groups[0].size
    least, first = _minima(g, ptr, size)
    for group in items.groups:
        while size < group.size:
            least, first = _merge(least, first)
            size *= 2
        last = np.zeros(least.shape[1], bool)
        last[first[1:][np.diff(first) > 0] - 1] = True
        after = np.minimum(np.arange(least.shape[1]) + 1, least.shape[1] - 1)
        segment = np.where(last, least, np.minimum(least, least[:, after]))
        hit = np.take_along_axis(group.table, (segment & group.mask).astype(np.int64), 1)
        for k, at in zip(*np.nonzero(hit)):
            lo, hi = (np.searchsorted(group.values[k], segment[k, at], side) for side in ("left", "right"))
            if hi > lo:
                doc = int(np.searchsorted(first, at, "right")) - 1
                found.update((doc, int(i)) for i in group.owners[k, lo:hi])
    return found


def _search(items: Items, shingle: int, containment: float, id_type: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for x, y in slices(texts):
                w, h = _words(texts.slice(x, y - x))
                every = grams(h, shingle)
                ok = gram_starts(w.ptr, shingle)[:len(every)]
                g = every[ok]
                ptr = np.concatenate(([0], np.cumsum(ok)))[np.minimum(w.ptr, len(ok))]
                rows, sets = [], {}
                for doc, item in sorted(candidates(g, ptr, items)):
                    own = sets.get(doc)
                    if own is None:
                        own = sets[doc] = np.unique(g[ptr[doc]:ptr[doc + 1]])
                    s = items.sets[item]
                    shared = int(np.isin(s, own, assume_unique=True).sum())
                    if shared >= containment * len(s):
                        rows.append((doc, item, len(s), shared))
                for n, (values, owners) in items.short.items():
                    every = grams(h, n)
                    ok = gram_starts(w.ptr, n)[:len(every)]
                    at = np.searchsorted(values, every)
                    ok &= values[np.minimum(at, len(values) - 1)] == every
                    for p in np.flatnonzero(ok):
                        doc = int(np.searchsorted(w.ptr, p, "right")) - 1
                        for q in range(int(at[p]), int(np.searchsorted(values, every[p], "right"))):
                            rows.append((doc, int(owners[q]), 1, 1))
                rows = sorted(set(rows))
                yield pa.RecordBatch.from_arrays(
                    [ids.take(pa.array([x + r[0] for r in rows], pa.int64())),
                     pa.array([items.ids[r[1]] for r in rows], id_type),
                     pa.array([r[2] for r in rows], pa.int64()), pa.array([r[3] for r in rows], pa.int64())],
                    names=["doc_id", "item_id", "n_item_shingles", "n_shared"])
    return run


def _item_sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in slices(b.column(1)):
                w, h = _words(b.column(1).slice(x, y - x))
                sets, lengths = [], np.diff(w.ptr)
                for d, n in enumerate(lengths):
                    own = h[w.ptr[d]:w.ptr[d + 1]]
                    sets.append(np.unique(grams(own, min(n, shingle))).view(np.int64) if n else np.zeros(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(lengths, pa.int64()),
                     pa.array(sets, pa.list_(pa.int64()))], names=["item_id", "n_words", "shingles"])
    return run


def contaminated(docs: DataFrame, items: DataFrame, shingle: int = 5, containment: float = 0.8,
                 doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
                 item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, n_item_shingles, n_shared, containment) of every item found in a document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    items = items.select(F.col(item_id).alias("item_id"), F.col(item_text).cast("string").alias("text"))
    doc_kind, item_kind = (d.schema[0].dataType.simpleString() for d in (docs, items))
    prepared = materialize(items.mapInArrow(
        _item_sets(shingle), f"item_id {item_kind}, n_words long, shingles array<long>")
        .where("n_words > 0"), "items")
    # blocks by hash, as many as the size of all items asks for, however the items are partitioned
    whole = prepared.agg(F.coalesce(F.sum(F.size("shingles")), F.lit(0))).first()[0]
    blocks = math.ceil(whole / BLOCK_SHINGLES)
    block_of = F.pmod(F.xxhash64("item_id", "n_words", "shingles"), F.lit(max(1, blocks)))
    found = []
    for block in range(blocks):
        rows = prepared.where(block_of == block).toArrow()
        if not rows.num_rows:
            continue
        sets = [np.array(s, np.int64).view(U64) for s in rows["shingles"].to_pylist()]
        index = index_items(rows["item_id"].to_pylist(), rows["n_words"].to_pylist(), sets, shingle)
        # the hits are written before the next block is loaded: the driver holds one block
        found.append(materialize(docs.mapInArrow(
            _search(index, shingle, containment, rows["item_id"].type),
            f"doc_id {doc_kind}, item_id {item_kind}, n_item_shingles long, n_shared long"), "item-hits"))
    if not found:
        found = [docs.select("doc_id").join(items.select("item_id"), F.lit(False))
                 .select("doc_id", "item_id", F.lit(0).cast("long").alias("n_item_shingles"),
                         F.lit(0).cast("long").alias("n_shared"))]
    return reduce(DataFrame.unionAll, found).withColumn(
        "containment", F.col("n_shared") / F.col("n_item_shingles"))


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(spark.read.parquet(f"{sf_dir}/documents.parquet"),
                        spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def _shingles_sql(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, unnest(CASE WHEN len(ws) >= 5 THEN
           [array_to_string(list_slice(ws, i, i + 4), ' ') for i in range(1, len(ws) - 3)]
         WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g
  FROM (SELECT {key}, regexp_extract_all(lower(coalesce(text, '')), '(?:[a-z0-9]|[^\\x00-\\x7F])+') AS ws FROM {table})"""


#: Items of five words and more, as all items of the tables have.
OP3_SQL = f"""
WITH i AS ({_shingles_sql('benchmark', 'item_id')}),
d AS ({_shingles_sql('documents', 'doc_id')}),
n AS (SELECT item_id, count(*) AS n FROM i GROUP BY item_id),
c AS (SELECT doc_id, item_id, count(*) AS k FROM d JOIN i ON d.g = i.g GROUP BY doc_id, item_id)
SELECT doc_id, c.item_id, n AS n_item_shingles, k AS n_shared, k / n AS containment
FROM c JOIN n ON c.item_id = n.item_id WHERE k >= 0.8 * n
"""
