"""MinHash near-duplicates by a signature-coordinate inverted join.

1. Every document gets its set of word shingles, a digest of the set and a
   MinHash signature.  Documents with equal sets are one class; only one
   document of each class goes on.
2. Classes are posted under their (coordinate, value) pairs.  A pair of
   classes above the match threshold ``matches`` of ``COORDS`` shares one of
   any ``COORDS - matches + 1`` coordinates of either, so each class is
   posted under that many of its values only, the rarest first (prefix);
   values that no other class has are not posted at all (skip).  A list
   counts the collisions of its members over whole signatures and returns a
   spanning forest of the pairs above the threshold.  Lists longer than
   ``BLOCK`` are split into pairs of blocks.
3. Clusters of that candidate graph get their texts; all pairs inside a
   cluster are compared on full shingle sets (again in pairs of blocks for
   large clusters), and a forest of the links is returned.  Since links are
   candidates, no link leaves a cluster.
4. Components of the links, and the smallest document id of each.

``matches`` is the largest count that a pair exactly at the similarity
threshold misses with probability at most ``MISS``.

Cases: null, empty and white-space texts have no shingles and are linked
with nothing; shorter texts than a shingle have their whole sequence as the
one shingle; repeated rows are one class; a null id never is a component's
id unless all ids of the component are null; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.graph import connected_components
from affinis.llm.words import (U64, find_words, lower_ascii, shingle_sets, slices, text_bytes, word_hashes)
from affinis.session import materialize

COORDS = 64
MISS = 1e-6
BLOCK = 512
SETS_BYTES = 64 << 20

_rng = np.random.default_rng(7)
_MUL = _rng.integers(1, 2**64, COORDS, dtype=U64) | U64(1)
_ADD = _rng.integers(1, 2**64, COORDS, dtype=U64)


def match_threshold(similarity: float, coords: int = COORDS, miss: float = MISS) -> int:
    """Largest count that a pair at ``similarity`` reaches but for probability ``miss``."""
    below, t = 0.0, 0
    while t < coords:
        below += comb(coords, t) * similarity**t * (1 - similarity) ** (coords - t)
        if below > miss:
            break
        t += 1
    return max(1, t)


def _sets(column: pa.Array, shingle: int) -> list[np.ndarray]:
    data, bounds = text_bytes(column)
    w = find_words(lower_ascii(data), bounds)
    return shingle_sets(w, word_hashes(w), shingle)


def _digest(s: np.ndarray) -> bytes:
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def _signatures(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for x, y in slices(texts):
                sets = _sets(texts.slice(x, y - x), shingle)
                size = np.array([len(s) for s in sets], np.int64)
                some = np.flatnonzero(size)
                sig = np.zeros((len(sets), COORDS), np.int32)
                if len(some):
                    flat = np.concatenate([sets[i] for i in some])
                    starts = np.concatenate(([0], np.cumsum(size[some])[:-1]))
                    for k in range(COORDS):
                        least = np.minimum.reduceat(flat * _MUL[k] + _ADD[k], starts)
                        sig[some, k] = (least >> U64(32)).astype(np.uint32).view(np.int32)
                keys = [_digest(s) if len(s) else None for s in sets]
                offsets = pa.array(np.arange(len(sets) + 1, dtype=np.int32) * COORDS)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(x, y - x), b.column(2).slice(x, y - x), pa.array(size), pa.array(keys, pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(sig.ravel()))],
                    names=["doc_id", "text_key", "n_shingles", "set_key", "sig"])
    return run


def _roots(linked: np.ndarray) -> np.ndarray:
    """Least member of each component of a symmetric link matrix."""
    n = len(linked)
    linked = linked | np.eye(n, dtype=bool)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(1)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _runs(batches: Iterator[pa.RecordBatch], n_keys: int, columns: int) -> Iterator[list[pa.Array]]:
    """Columns of each run of equal keys in sorted batches."""
    held: pa.Table | None = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if held is not None:
            t = pa.concat_tables([held, t])
            held = None
        if not t.num_rows:
            continue
        change = np.zeros(t.num_rows, bool)
        for k in range(n_keys):
            v = t.column(k).to_numpy()
            change[1:] |= v[1:] != v[:-1]
        cuts = np.concatenate(([0], np.flatnonzero(change), [t.num_rows]))
        t = t.combine_chunks()
        cols = [t.column(c).chunk(0) for c in range(columns)]
        for a, z in zip(cuts[:-2], cuts[1:-1]):
            yield [c.slice(a, z - a) for c in cols]
        held = t.slice(int(cuts[-2]))
    if held is not None and held.num_rows:
        held = held.combine_chunks()
        yield [held.column(c).chunk(0) for c in range(columns)]


EDGE_DDL = "u long, v long"


def _edges(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    u = np.concatenate([f[0] for f in found]) if found else np.zeros(0, np.int64)
    v = np.concatenate([f[1] for f in found]) if found else np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], names=["u", "v"])


def _forest(node: np.ndarray, linked: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
    root = _roots(linked)
    own = root != np.arange(len(root))
    return (node[own], node[root[own]]) if own.any() else None


def _collide(matches: int, similarity: float):
    """Posting lists (token, bi, bj, block, nid, n, sig), sorted by the first three."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list = []
        for cols in _runs(batches, 3, 7):
            m = len(cols[0])
            if m < 2:
                continue
            node, size = cols[4].to_numpy(), cols[5].to_numpy()
            sig = np.frombuffer(b"".join(cols[6].to_pylist()), np.uint8).reshape(m, COORDS)
            linked = np.zeros((m, m), bool)
            for a in range(0, m, 64):
                linked[a:a + 64] = (sig[a:a + 64, None, :] == sig[None, :, :]).sum(2, dtype=np.uint8) >= matches
            small, large = np.minimum(size[:, None], size), np.maximum(size[:, None], size)
            linked &= small >= similarity * large - 1e-9 * large
            if (f := _forest(node, linked)) is not None:
                found.append(f)
            if len(found) >= 1000:
                yield _edges(found)
                found = []
        yield _edges(found)
    return run


def overlaps(sets: list[np.ndarray]) -> np.ndarray:
    """Matrix of intersection sizes."""
    m = len(sets)
    out = np.zeros((m, m))
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(m), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    flat, owner = flat[order], owner[order]
    new = np.concatenate(([True], flat[1:] != flat[:-1])) if len(flat) else np.zeros(0, bool)
    shared = ~(new & np.concatenate((new[1:], [True]))) if len(flat) else new
    owner, number = owner[shared], np.cumsum(new[shared]) - 1
    step = max(64, (8 << 20) // max(1, 4 * m))
    for lo in range(0, int(number[-1]) + 1 if len(number) else 0, step):
        a, z = np.searchsorted(number, (lo, lo + step))
        x = np.zeros((step, m), np.float32)
        x[number[a:z] - lo, owner[a:z]] = 1
        out += x.T @ x
    np.fill_diagonal(out, [len(s) for s in sets])
    return out


def _verify(shingle: int, similarity: float):
    """Cluster members (cid, bi, bj, block, nid, set_key, text), sorted by the first three."""
    percent = round(similarity * 1_000_000)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for cols in _runs(batches, 3, 7):
            node, sets, seen = [], [], set()
            for x, y in slices(cols[6]):
                for i, s in zip(range(x, y), _sets(cols[6].slice(x, y - x), shingle)):
                    nid = cols[4][i].as_py()
                    # ids that repeat with another text bring texts that are not the class's
                    if nid not in seen and _digest(s) == cols[5][i].as_py():
                        seen.add(nid)
                        node.append(nid)
                        sets.append(s)
            if len(sets) < 2:
                continue
            common = overlaps(sets)
            size = np.array([len(s) for s in sets], float)
            linked = 1_000_000 * common >= percent * (size[:, None] + size - common)
            if (f := _forest(np.array(node, np.int64), linked)) is not None:
                yield _edges([f])
    return run


def _blocks(rows: DataFrame, count: str, node: str, block: int) -> DataFrame:
    """One copy of a row for each pair of blocks of its group (one pair for small groups)."""
    n = F.ceil(F.col(count) / F.lit(block)).cast("int")
    return rows.withColumn("block", F.pmod(F.hash(node), n).cast("int")) \
        .withColumn("_x", F.explode(F.sequence(F.lit(0), n - 1))) \
        .withColumn("bi", F.least("block", "_x")).withColumn("bj", F.greatest("block", "_x"))


def near_duplicates(docs: DataFrame, shingle: int = 5, similarity: float = 0.8, doc_id: str = "doc_id",
                    text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_shingles, component_id, kept) per document; ``text_key`` is xxhash64 of the text
    (null: empty)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    matches = match_threshold(similarity)
    signed = materialize(docs.withColumn("text_key", F.xxhash64(F.coalesce("text", F.lit("")))).select("doc_id", "text", "text_key").mapInArrow(
        _signatures(shingle), f"doc_id {kind}, text_key long, n_shingles long, set_key binary, sig array<int>"), "signed")

    classes = signed.where("set_key is not null").groupBy("set_key").agg(
        F.min("doc_id").alias("rep_id"), F.first("n_shingles").alias("n"), F.first("sig").alias("sig"))
    # numbers of a written table stay the same in every later read
    classes = materialize(classes.withColumn("nid", F.monotonically_increasing_id()), "classes")

    # postings: rarest values first
    tokens = classes.select("nid", F.posexplode("sig").alias("_k", "_v")).select(
        "nid", (F.shiftleft(F.col("_k").cast("long"), 32) + (F.col("_v").cast("long") + F.lit(1 << 31))).alias("token"))
    shared = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("cnt")).where("cnt > 1")
    prefix = COORDS - matches + 1
    chosen = tokens.join(shared, "token").groupBy("nid").agg(
        F.array_sort(F.collect_list(F.struct("cnt", "token"))).alias("_t")) \
        .withColumn("_take", F.lit(prefix - COORDS) + F.size("_t")).where("_take > 0") \
        .select("nid", F.explode(F.slice("_t", F.lit(1), F.col("_take"))).alias("_t")) \
        .select("nid", F.col("_t.token").alias("token"), F.col("_t.cnt").alias("cnt"))
    short = F.to_binary(F.array_join(F.transform("sig", lambda v: F.lpad(F.hex(F.pmod(v, F.lit(256))), 2, "0")), ""),
                        F.lit("hex")).alias("sig8")
    posted = chosen.join(classes.select("nid", "n", short), "nid")
    lists = _blocks(posted, "cnt", "nid", BLOCK).select("token", "bi", "bj", "block", "nid", "n", "sig8")
    candidates = lists.repartition("token", "bi", "bj").sortWithinPartitions("token", "bi", "bj") \
        .mapInArrow(_collide(matches, similarity), EDGE_DDL)
    clusters = connected_components(candidates)

    # full sets of clustered classes
    sizes = clusters.groupBy(F.col("component").alias("cid")).agg(F.count(F.lit(1)).alias("cnt"))
    members = clusters.join(sizes, clusters["component"] == sizes["cid"]).select("node", "cid", "cnt") \
        .join(classes.select("nid", "rep_id", "set_key"), F.col("node") == F.col("nid")) \
        .select("cid", "cnt", "nid", "rep_id", "set_key")
    texts = docs.join(members, docs["doc_id"].eqNullSafe(members["rep_id"]))
    groups = _blocks(texts, "cnt", "nid", BLOCK // 2).select("cid", "bi", "bj", "block", "nid", "set_key", "text")
    links = groups.repartition("cid", "bi", "bj").sortWithinPartitions("cid", "bi", "bj") \
        .mapInArrow(_verify(shingle, similarity), EDGE_DDL)
    linked = connected_components(links)

    # smallest id of each component, for every document of its classes
    of = classes.select("nid", "rep_id", F.col("set_key").alias("_key")) \
        .join(linked, F.col("nid") == F.col("node"), "left") \
        .withColumn("_c", F.coalesce("component", "nid"))
    least = of.groupBy("_c").agg(F.min("rep_id").alias("_least"))
    of = of.join(least, "_c").select("_key", "_least")
    out = signed.drop("sig").join(of, signed["set_key"] == of["_key"], "left")
    component = F.when(F.col("set_key").isNull(), F.col("doc_id")).otherwise(F.col("_least"))
    return out.select("doc_id", "text_key", "n_shingles", component.alias("component_id"),
                      F.col("doc_id").eqNullSafe(component).alias("kept"))


def op7_minhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=3,
                           similarity=0.85).drop("text_key")


OP7_SQL = """
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                                              'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS ws
  FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 3 THEN [array_to_string(ws, ' ')]
    ELSE [ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] for i in range(1, len(ws) - 1)] END) AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s),
p AS (SELECT doc_id, unnest(sh) AS g FROM s),
f AS (SELECT g FROM p GROUP BY g HAVING count(*) > 1),
q AS (SELECT p.* FROM p SEMI JOIN f ON p.g = f.g),
c AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM q a JOIN q b ON a.g = b.g AND a.doc_id <> b.doc_id
      GROUP BY ALL),
e AS (SELECT x, y FROM c JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * k >= 85 * (a.n + b.n - k)),
r(x, y) AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
m AS (SELECT x, min(y) AS least FROM r GROUP BY x)
SELECT n.doc_id, n.n AS n_shingles, least(n.doc_id, coalesce(m.least, n.doc_id)) AS component_id,
       n.doc_id = least(n.doc_id, coalesce(m.least, n.doc_id)) AS kept
FROM n LEFT JOIN m ON m.x = n.doc_id
"""
