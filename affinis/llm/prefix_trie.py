"""Prefix trie of conversations with subtree totals by centroid decomposition.

A node is a distinct sequence of first turns.  Its key is the depth and the
exclusive or of two hashes per (depth, role, text), 128 bits; prefix keys
are running aggregates, made in chunks of a conversation and carried over
the chunks, so a conversation may hold any share of the rows.  The
smallest member and the depth name a node, too: members of a node share
its whole path, so the nodes of one smallest member lie on one path.

Totals go up the parent edges in a logarithmic number of steps.  A node's
weight, the turns of its members from its depth on, is one aggregate.  A
component is a top node with what lies below it; its centroid is the
deepest node that still has 2**k of its weight, 2**k the largest power of
two within the weight.  The path from the centroid to the top is settled
in one step: what hangs off the path are components below 2**k, whose
totals are added first, and running sums along the path give the totals of
all its nodes.  Each step down at least halves the power, so a node lies
under at most log2(turns) centroids, however deep the trie is.

Components of at most ``local`` weight are split and added up inside a
task, many at a time.  The nodes above them go through the same steps as
Spark jobs, one for each power of two: they are few, unless single
conversations are very long, and such paths are summed in blocks.

Cases: rows without conv_id belong to no conversation; null turns come
first, null roles and texts are empty; equal turns are put in the order of
a hash of role and text; repeated rows are turns of their own; a
conversation that is rebuilt without turns is a member of the root; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.session import materialize

#: Fixed values of the rebuilt conversations: ids to a base, turns shared at most.
GROUP, SHARED = 100, 5
#: Turns of a conversation, or nodes of a path, in one window.
CHUNK = 4096
#: Largest weight of a component that a task settles by itself.
LOCAL = 1 << 16
_KEY = ["depth", "k1", "k2"]
_BEFORE = (Window.unboundedPreceding, -1)
_UP_TO = (Window.unboundedPreceding, Window.currentRow)


def _hashes(*of: Column, seed: int) -> tuple[Column, Column]:
    """Two 64-bit hashes of the same values."""
    return F.xxhash64(F.lit(seed), *of), F.xxhash64(F.lit(seed + 1), *of)


def ordered_turns(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, _part, nth, h1, h2, chars) per turn and (conv_id, _part, _ahead, n) per conversation and part.

    A turn's position is ``_ahead`` + ``nth``; ``n`` are the turns of the
    whole conversation.  Texts are hashed before any exchange.
    """
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    h1, h2 = _hashes(empty("role"), empty("text"), seed=1)
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", h1.alias("h1"), h2.alias("h2"),
        F.length(empty("text")).cast("long").alias("chars"), F.rand(1).alias("_tie"))
    order = [F.col("turn").asc_nulls_first(), F.col("h1"), F.col("h2"), F.col("_tie")]
    placed = materialize(turns.repartitionByRange(F.col("conv_id"), *order)
                         .withColumn("_part", F.spark_partition_id()), "trie-turns")
    nth = F.row_number().over(Window.partitionBy("_part", "conv_id").orderBy(*order))
    of = Window.partitionBy("conv_id")
    parts = placed.groupBy("conv_id", "_part").agg(F.count(F.lit(1)).alias("_n")) \
        .withColumn("_ahead", F.coalesce(F.sum("_n").over(of.orderBy("_part").rowsBetween(*_BEFORE)), F.lit(0))) \
        .withColumn("n", F.sum("_n").over(of)).drop("_n")
    return placed.select("conv_id", "_part", nth.cast("long").alias("nth"), "h1", "h2", "chars"), parts


def rebuilt(conversations: DataFrame, group: int = GROUP, shared: int = SHARED) -> tuple[DataFrame, DataFrame]:
    """Conversations that begin with turns of their base, ``conv_id - conv_id % group``.

    Returns (conv_id, length) per conversation, also of length 0, and
    (conv_id, depth, length, h1, h2, chars) per turn, depth from 1.
    """
    turns, parts = ordered_turns(conversations)
    head = F.crc32(F.col("conv_id").cast("string").cast("binary")) % (shared + 1)
    parts = materialize(parts.withColumn("_head", head)
                        .withColumn("_base", F.col("conv_id") - F.col("conv_id") % group), "trie-parts")
    convs = parts.groupBy("conv_id", "_head", "_base").agg(F.max("n").alias("n"))
    bases = convs.where("conv_id = _base").select(F.col("conv_id").alias("_base"), F.col("n").alias("_of_base"))
    convs = convs.join(bases, "_base", "left") \
        .withColumn("_shared", F.least("_head", F.coalesce("_of_base", F.lit(0)))) \
        .withColumn("length", F.col("_shared") + F.greatest(F.col("n") - F.col("_head"), F.lit(0)))
    convs = materialize(convs.select("conv_id", "_base", "_head", "_shared", "length"), "trie-conversations")

    spans = parts.select("conv_id", "_part", "_ahead").join(convs, "conv_id")
    turns = turns.join(spans, ["conv_id", "_part"]).withColumn("_at", F.col("_ahead") + F.col("nth"))
    own = turns.where("_at > _head").select(
        "conv_id", (F.col("_at") - F.col("_head") + F.col("_shared")).alias("depth"), "length", "h1", "h2", "chars")
    # at most ``shared`` turns of a base meet at most ``group`` conversations (twice that around id 0)
    first = turns.where((F.col("conv_id") == F.col("_base")) & (F.col("_at") <= shared)) \
        .select("_base", F.col("_at").alias("depth"), "h1", "h2", "chars")
    taken = first.join(convs, "_base").where("depth <= _shared").select(
        "conv_id", "depth", "length", "h1", "h2", "chars")
    return convs.select("conv_id", "length"), own.union(taken)


def prefix_keys(turns: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Adds k1, k2 (the prefix that ends with the turn) and q1, q2 (the prefix before it).

    The table is written; of long conversations the chunks after the first
    are joined to the sums of those before.
    """
    g = _hashes(F.col("depth"), F.col("h1"), F.col("h2"), seed=3)
    rows = turns.withColumns({"g1": g[0], "g2": g[1], "_chunk": F.floor((F.col("depth") - 1) / chunk)})
    run = Window.partitionBy("conv_id", "_chunk").orderBy("depth").rowsBetween(*_UP_TO)
    rows = materialize(rows.select("conv_id", "depth", "length", "chars", "_chunk", "g1", "g2", *[
        F.bit_xor(f"g{i}").over(run).alias(f"k{i}") for i in (1, 2)]), "trie-prefixes")
    ahead = Window.partitionBy("conv_id").orderBy("_chunk").rowsBetween(*_BEFORE)
    before = rows.where(F.col("length") > chunk).groupBy("conv_id", "_chunk").agg(
        F.bit_xor("g1").alias("o1"), F.bit_xor("g2").alias("o2")) \
        .select("conv_id", "_chunk", *[F.bit_xor(f"o{i}").over(ahead).alias(f"o{i}") for i in (1, 2)])
    later = rows.where("_chunk > 0").join(before.where("_chunk > 0"), ["conv_id", "_chunk"]) \
        .withColumns({f"k{i}": F.col(f"k{i}").bitwiseXOR(F.col(f"o{i}")) for i in (1, 2)}).select(*rows.columns)
    return rows.where("_chunk = 0").union(later).select(
        "conv_id", "depth", "length", "chars", "k1", "k2",
        F.col("k1").bitwiseXOR(F.col("g1")).alias("q1"), F.col("k2").bitwiseXOR(F.col("g2")).alias("q2"))


def trie_nodes(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, conv_id, n_convs, chars, weight, parent_conv_id, parent_weight, n_children) per node, written."""
    left = (F.col("length") - F.col("depth") + 1).alias("_left")
    nodes = prefixes.select(*_KEY, "conv_id", "chars", "q1", "q2", left).groupBy(*_KEY).agg(
        F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"), F.max("chars").alias("chars"),
        F.sum("_left").alias("weight"), F.min("q1").alias("q1"), F.min("q2").alias("q2"))
    zero = F.lit(0).cast("long")
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_convs"),
                     F.sum(F.col("length") + 1).alias("weight")).where("n_convs > 0") \
        .select(zero.alias("depth"), zero.alias("k1"), zero.alias("k2"), "conv_id", "n_convs",
                zero.alias("chars"), "weight", F.lit(None).cast("long").alias("q1"), F.lit(None).cast("long").alias("q2"))
    nodes = materialize(nodes.unionByName(root), "trie-nodes")
    children = nodes.where("depth > 0").groupBy((F.col("depth") - 1).alias("depth"), F.col("q1").alias("k1"),
                                                F.col("q2").alias("k2")).agg(F.count(F.lit(1)).alias("n_children"))
    nodes = nodes.join(children, _KEY, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    up = nodes.select((F.col("depth") + 1).alias("depth"), F.col("k1").alias("q1"), F.col("k2").alias("q2"),
                      F.col("conv_id").alias("parent_conv_id"), F.col("weight").alias("parent_weight"))
    # the root has most children: one row, sent to all instead of joined by key
    top = nodes.where("depth <= 1").join(F.broadcast(up.where("depth = 1").drop("q1", "q2")), "depth", "left")
    deep = nodes.where("depth > 1").join(up.where("depth > 1"), ["depth", "q1", "q2"])
    return materialize(top.unionByName(deep).drop("q1", "q2"), "trie-tree")


def settle(conv: np.ndarray, depth: np.ndarray, parent_conv: np.ndarray, top: np.ndarray, weight: np.ndarray,
           values: list[np.ndarray]) -> list[np.ndarray]:
    """Subtree totals of whole components in arrays; ``top`` marks nodes whose parent lies outside."""
    n = len(conv)
    _, number = np.unique(np.concatenate((conv, parent_conv)), return_inverse=True)
    wide = int(depth.max()) + 2
    own, up = number[:n] * wide + depth, number[n:] * wide + depth - 1
    order = np.argsort(own)
    parent = np.where(top, np.arange(n), order[np.minimum(np.searchsorted(own, up, sorter=order), n - 1)])
    power = np.frexp(weight.astype(np.float64))[1]
    head = np.where(power[parent] == power, parent, np.arange(n))
    while True:  # the top of each centroid path
        further = head[head]
        if np.array_equal(further, head):
            break
        head = further
    order = np.lexsort((-depth, head, power))
    values = [v.copy() for v in values]
    for part in np.split(order, np.flatnonzero(np.diff(power[order])) + 1):
        first = np.flatnonzero(np.concatenate(([True], np.diff(head[part]) != 0)))
        size = np.diff(np.concatenate((first, [len(part)])))
        heads = head[part[first]]
        inner = heads[~top[heads]]
        for v in values:
            run = np.cumsum(v[part])
            v[part] = run - np.repeat(run[first] - v[part[first]], size)
            np.add.at(v, parent[inner], v[inner])
    return values


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Tables of whole components from rows sorted by top."""
    rest = None
    for b in batches:
        t = pa.Table.from_batches([b])
        t = t if rest is None else pa.concat_tables([rest, t])
        a, d = (t.column(c).to_numpy() for c in ("top_conv", "top_depth"))
        new = np.flatnonzero((np.diff(a) != 0) | (np.diff(d) != 0))
        cut = int(new[-1]) + 1 if len(new) else 0
        if cut:
            yield t.slice(0, cut)
        rest = t.slice(cut)
    if rest is not None and rest.num_rows:
        yield rest


def _settle_light(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for t in _whole(batches):
        c = {name: t.column(name).to_numpy() for name in t.column_names if name not in ("parent_conv_id", "parent_weight")}
        up = pc.fill_null(t.column("parent_conv_id"), -1).to_numpy()
        top = (c["conv_id"] == c["top_conv"]) & (c["depth"] == c["top_depth"])
        a, b = settle(c["conv_id"], c["depth"], up, top, c["weight"], [c["n_leaves"], c["saved_tokens"]])
        t = t.combine_chunks()
        yield from pa.table({"conv_id": t["conv_id"], "depth": t["depth"], "parent_conv_id": t["parent_conv_id"],
                             "parent_weight": t["parent_weight"], "is_top": top, "n_leaves": a,
                             "saved_tokens": b}).to_batches()


def _power(weight: str) -> Column:
    return F.length(F.bin(F.col(weight))) - 1


def subtree_totals(prefixes: DataFrame, tree: DataFrame, local: int = LOCAL, block: int = CHUNK) -> DataFrame:
    """(conv_id, depth, n_leaves, saved_tokens): both summed over every node's subtree."""
    totals = ["n_leaves", "saved_tokens"]
    sums = [F.sum(v).cast("long").alias(v) for v in totals]
    tree = tree.select(*_KEY, "conv_id", "weight", "parent_conv_id", "parent_weight",
                       F.when(F.col("n_children") == 0, 1).otherwise(0).cast("long").alias("n_leaves"),
                       ((F.col("n_convs") - 1) * F.col("chars")).alias("saved_tokens"))
    heavy, light = tree.where(F.col("weight") > local), tree.where(F.col("weight") <= local)
    root = tree.where("depth = 0").select("conv_id", "weight").first()
    if root is None:
        return tree.select("conv_id", "depth", *totals)

    # heavy nodes and tops of light components, seen from the conversations that pass them
    marks = tree.where((F.col("weight") > local) | (F.col("parent_weight") > local)) \
        .select(*_KEY, F.col("conv_id").alias("_owner"), "weight")
    seen = materialize(prefixes.select(*_KEY, "conv_id").join(marks, _KEY).select(
        "conv_id", "depth", "_owner", "weight"), "trie-marks")
    tops = seen.where(F.col("weight") <= local).select(
        "conv_id", F.col("_owner").alias("top_conv"), F.col("depth").alias("top_depth"))
    settled = light.join(tops, "conv_id", "left") \
        .withColumn("top_conv", F.coalesce("top_conv", F.lit(root["conv_id"]))) \
        .withColumn("top_depth", F.coalesce("top_depth", F.lit(0).cast("long"))) \
        .select("conv_id", "depth", "weight", "parent_conv_id", "parent_weight", *totals, "top_conv", "top_depth") \
        .repartition("top_conv", "top_depth").sortWithinPartitions("top_conv", "top_depth") \
        .mapInArrow(_settle_light, "conv_id long, depth long, parent_conv_id long, parent_weight long, "
                                   "is_top boolean, n_leaves long, saved_tokens long")
    settled = materialize(settled, "trie-light")
    found = [settled.select("conv_id", "depth", *totals)]
    if root["weight"] <= local:
        return found[0]

    def upward(tops: DataFrame) -> DataFrame:
        """What components add to the node above them."""
        return tops.where(F.col("parent_conv_id").isNotNull()).select(
            F.col("parent_conv_id").alias("conv_id"), (F.col("depth") - 1).alias("depth"),
            _power("parent_weight").alias("_power"), *totals)

    power = _power("weight")
    heads = seen.where(F.col("weight") > local).groupBy("conv_id", power.alias("_power")) \
        .agg(F.min(F.struct("depth", "_owner")).alias("_head"))
    head = F.coalesce("_head", F.struct("depth", F.col("conv_id").alias("_owner")))
    # the root has no row among the prefixes; its children of the same power go on its path
    at_root = F.struct(F.lit(0).cast("long").alias("depth"), F.lit(root["conv_id"]).alias("_owner"))
    top_power = root["weight"].bit_length() - 1
    heavy = heavy.withColumn("_power", power).join(heads, ["conv_id", "_power"], "left") \
        .withColumn("_head", F.when((F.col("_power") == top_power) & (head["depth"] <= 1), at_root).otherwise(head))
    heavy = materialize(heavy.drop("k1", "k2"), "trie-heavy")
    hanging = [upward(settled.where("is_top"))]
    for k in sorted(r[0] for r in heavy.select("_power").distinct().collect()):
        # an outer level is added up only when all inner ones are written
        added = hanging[0]
        for more in hanging[1:]:
            added = added.unionByName(more)
        added = added.where(F.col("_power") == k).groupBy("conv_id", "depth").agg(
            *[F.sum(v).alias(f"_{v}") for v in totals])
        nodes = heavy.where(F.col("_power") == k).join(added, ["conv_id", "depth"], "left") \
            .withColumns({v: F.col(v) + F.coalesce(f"_{v}", F.lit(0)) for v in totals}) \
            .withColumn("_block", F.floor(F.col("depth") / block))
        inside = Window.partitionBy("_head", "_block").orderBy(F.col("depth").desc()).rowsBetween(*_UP_TO)
        below = Window.partitionBy("_head").orderBy(F.col("_block").desc()).rowsBetween(*_BEFORE)
        sums_below = nodes.groupBy("_head", "_block").agg(*sums).select("_head", "_block", *[
            F.coalesce(F.sum(v).over(below), F.lit(0)).alias(f"_below_{v}") for v in totals])
        nodes = nodes.withColumns({v: F.sum(v).over(inside) for v in totals}).join(sums_below, ["_head", "_block"]) \
            .withColumns({v: F.col(v) + F.col(f"_below_{v}") for v in totals})
        nodes = materialize(nodes.select("conv_id", "depth", "parent_conv_id", "parent_weight", *totals,
                                         (F.col("depth") == F.col("_head.depth")).alias("is_top")), "trie-path")
        found.append(nodes.select("conv_id", "depth", *totals))
        hanging.append(upward(nodes.where("is_top")))
    out = found[0]
    for more in found[1:]:
        out = out.union(more)
    return out


def _join_ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows to one row per run of equal keys: its first id and its ids, comma-joined."""
    for b in batches:
        if not b.num_rows:
            continue
        key = [b.column(i).to_numpy() for i in range(3)]
        new = np.flatnonzero(np.any([np.diff(k) != 0 for k in key], axis=0)) + 1
        first = np.concatenate(([0], new))
        ids = b.column(3).cast(pa.string()).to_pylist()
        text = [",".join(ids[x:y]) for x, y in zip(first, [*new, len(ids)])]
        yield pa.RecordBatch.from_arrays([pa.array(k[first]) for k in key] + [b.column(3).take(pa.array(first)), pa.array(text)],
                                         names=[*_KEY, "first", "ids"])


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Running SHA-256 over the parts of each key, which come sorted."""
    now, state = None, None
    for b in batches:
        out = []
        for *key, ids in zip(*[b.column(i).to_pylist() for i in (0, 1, 2, 4)]):
            if key == now:
                state.update(b"," + ids.encode())
            else:
                if now is not None:
                    out.append((*now, state.hexdigest()))
                now, state = key, hashlib.sha256(ids.encode())
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], names=[*_KEY, "ends_sha256"])
    if now is not None:
        yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*now, state.hexdigest())], names=[*_KEY, "ends_sha256"])


def end_digests(convs: DataFrame, prefixes: DataFrame) -> DataFrame:
    """(depth, k1, k2, ends_sha256) of nodes where conversations end.

    Ids are sorted by range, so that equal conversations are joined to
    strings in many tasks; one task then hashes the strings of a node as
    they come, without holding them.
    """
    zero = F.lit(0).cast("long")
    ends = prefixes.where("depth = length").select(*_KEY, "conv_id").union(
        convs.where("length = 0").select(zero, zero, zero, "conv_id"))
    key = "depth long, k1 long, k2 long, "
    return ends.repartitionByRange(*_KEY, "conv_id").sortWithinPartitions(*_KEY, "conv_id") \
        .mapInArrow(_join_ids, key + "first long, ids string") \
        .repartition(*_KEY).sortWithinPartitions(*_KEY, "first").mapInArrow(_digest, key + "ends_sha256 string")


def prefix_trie(conversations: DataFrame, group: int = GROUP, shared: int = SHARED, local: int = LOCAL,
                chunk: int = CHUNK) -> DataFrame:
    """One row per node: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children,
    n_leaves and saved_tokens of its subtree, ends_sha256."""
    convs, turns = rebuilt(conversations, group, shared)
    prefixes = prefix_keys(turns, chunk)
    tree = trie_nodes(convs, prefixes)
    totals = subtree_totals(prefixes, tree, local, chunk)
    return tree.join(totals, ["conv_id", "depth"]).join(end_digests(convs, prefixes), _KEY, "left").select(
        "conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
        F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


#: The checksum of an id goes bit by bit; a node's subtree are the nodes whose smallest member passes it.
OP12_SQL = r"""
WITH RECURSIVE
crc0(b, k, c) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM crc0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc0 WHERE k = 8),
turns AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (
            PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 100 AS base, count(*) AS n, hex(encode(CAST(conv_id AS VARCHAR))) AS x
      FROM turns GROUP BY conv_id),
h AS (SELECT conv_id, base, n, xor(list_reduce(list_transform(range(0, CAST(length(x) / 2 AS BIGINT)),
             lambda i: CAST(concat('0x', substring(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
           lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) % 6 AS h
      FROM c, tab),
i AS (SELECT h.conv_id, h.base, h.h, least(h.h, coalesce(b.n, 0)) AS shared FROM h LEFT JOIN h b ON b.conv_id = h.base),
r AS (SELECT i.conv_id, t.pos AS d, t.role, t.text FROM i JOIN turns t ON t.conv_id = i.base AND t.pos <= i.h
      UNION ALL
      SELECT i.conv_id, t.pos - i.h + i.shared, t.role, t.text FROM i JOIN turns t ON t.conv_id = i.conv_id AND t.pos > i.h),
k AS (SELECT conv_id, d, length(text) AS chars, string_agg(sha256(concat(length(role), ':', role, text)), '') OVER (
        PARTITION BY conv_id ORDER BY d) AS k FROM r
      UNION ALL SELECT conv_id, 0, 0, '' FROM i),
nodes AS (SELECT d, k, min(conv_id) AS node, count(*) AS n, max(chars) AS chars FROM k GROUP BY d, k),
a AS (SELECT k.conv_id, k.d, nodes.node, nodes.n, nodes.chars, max(k.d) OVER (PARTITION BY k.conv_id) AS len
      FROM k JOIN nodes ON k.d = nodes.d AND k.k = nodes.k),
u AS (SELECT x.node, x.d, x.n, x.chars, p.node AS parent FROM a x LEFT JOIN a p ON p.conv_id = x.node AND p.d = x.d - 1
      WHERE x.conv_id = x.node),
ch AS (SELECT parent AS node, d - 1 AS d, count(*) AS children FROM u WHERE parent IS NOT NULL GROUP BY 1, 2),
v AS (SELECT u.*, coalesce(ch.children, 0) AS children FROM u LEFT JOIN ch ON ch.node = u.node AND ch.d = u.d),
s AS (SELECT a.node, a.d, count(*) FILTER (v.children = 0) AS leaves, sum((v.n - 1) * v.chars) AS saved
      FROM v JOIN a ON a.conv_id = v.node AND a.d <= v.d GROUP BY a.node, a.d),
e AS (SELECT node, d, sha256(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id)) AS ends
      FROM a WHERE d = len GROUP BY node, d)
SELECT v.node AS conv_id, CAST(v.d AS BIGINT) AS depth, v.parent AS parent_conv_id, v.n AS n_convs, v.children AS n_children,
       s.leaves AS n_leaves, CAST(s.saved AS BIGINT) AS saved_tokens, coalesce(e.ends, sha256('')) AS ends_sha256
FROM v JOIN s ON s.node = v.node AND s.d = v.d LEFT JOIN e ON e.node = v.node AND e.d = v.d
"""
