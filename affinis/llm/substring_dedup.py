"""Removal of repeated passages by anchors of least hash.

A window is ``WINDOW`` consecutive words of one document.  A word goes if a
window covers it whose word sequence also starts earlier, in a document
with a smaller id or earlier in the same document.

1. Anchors: a window's anchors are those of its ``PERIOD`` runs of
   ``ANCHOR`` words whose hash is the least.  They follow from the words of
   the window alone, so equal windows have equal anchors, and neighbouring
   windows mostly share theirs: about 2 positions in ``PERIOD + 1`` are an
   anchor of some window.  Anchors that occur once are done with.
2. Extension: windows whose own anchor is repeated are hashed in full (96
   bits); of each hash the earliest occurrence stays and the others are
   repeats.
3. Words covered by repeats are removed.

Anchors and windows are grouped inside a slice of a task first, so a passage
that a third of the documents share reaches the shuffle once per slice.
What a slice already knows travels as one row per document.  The text is
shuffled once, by document id; both joins read that exchange.

Cases: null or empty texts have no words (digest of the empty string);
repeated rows of one id are not earlier than each other, all of them get
the same result; null ids sort first; other columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.words import U64, Words, find_words, grams, mix, slices, text_bytes, word_hashes
from affinis.session import materialize

WINDOW = 20
PERIOD = 13
ANCHOR = WINDOW - PERIOD + 1
#: ``at`` packs a tag of the text (for ids that are not unique), 32 bits of a second window hash and the
#: word position; narrow rows keep the shuffles small.
TAG_BITS, POS_BITS = 23, 40
_CHECK = U64(0xA0761D6478BD642F | 1)


def _tags(part: pa.Array) -> np.ndarray:
    """23 bits of each text's digest, above the position bits."""
    out = [int.from_bytes(hashlib.blake2b((t or "").encode(), digest_size=4).digest(), "big") >> (32 - TAG_BITS)
           for t in part.to_pylist()]
    return np.array(out, np.int64) << POS_BITS


def _owner(w: Words) -> np.ndarray:
    return np.repeat(np.arange(len(w.ptr) - 1), np.diff(w.ptr))


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """Least of ``n`` values from each position (positions that have as many)."""
    k = 1
    while 2 * k <= n:
        x, k = np.minimum(x[:-k], x[k:]), 2 * k
    return np.minimum(x[:max(0, len(x) - n + k)], x[n - k:])


def _chosen(g: np.ndarray, inside: np.ndarray) -> np.ndarray:
    """Mask of the hashes that are the least of a window; ``inside`` marks the windows within one document."""
    least = np.zeros(len(g) + PERIOD - 1, U64)
    least[PERIOD - 1:len(g)][inside] = _least(g, PERIOD)[inside]
    # the greatest of the windows around a position, as the least of the complements
    return ~_least(~least, PERIOD) == g


def _grouped(doc: np.ndarray, pos: np.ndarray, n_docs: int) -> list[bytes | None]:
    """Positions of each document as bytes, None where there are none."""
    order = np.lexsort((pos, doc))
    cut = np.searchsorted(doc[order], np.arange(n_docs + 1))
    p = pos[order].astype(np.uint32)
    return [p[a:b].tobytes() if b > a else None for a, b in zip(cut, cut[1:])]


def _schema(kind: str, tagged: bool) -> str:
    return f"h long, p long, doc_id {kind}, known binary" + ", tag long" * tagged


def _batch(ids: pa.Array, h: np.ndarray, p: np.ndarray, doc: np.ndarray, known: list[bytes | None],
           tags: np.ndarray | None) -> pa.RecordBatch:
    """Open occurrences, then one row per document with known positions."""
    have = np.array([i for i, k in enumerate(known) if k is not None], np.int64)
    spread = mix(have.astype(U64) * U64(0x9E3779B97F4A7C15) + U64(len(doc)))
    owner = np.concatenate((doc, have))
    cols = [pa.array(np.concatenate((h, spread)).view(np.int64)),
            pa.array(np.concatenate((p, np.zeros(len(have), np.int64)))), ids.take(pa.array(owner)),
            pa.array([None] * len(doc) + [known[i] for i in have], pa.binary())]
    names = ["h", "p", "doc_id", "known"]
    if tags is not None:
        cols.append(pa.array(tags[owner]))
        names.append("tag")
    return pa.RecordBatch.from_arrays(cols, names=names)


def _anchors(tagged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for x, y in slices(texts):
                part = texts.slice(x, y - x)
                w = find_words(*text_bytes(part))
                n_docs = y - x
                h = word_hashes(w)
                if len(h) < WINDOW:
                    continue
                g = grams(h, ANCHOR)
                doc = _owner(w)[:len(g)]
                pos = np.arange(len(g)) - w.ptr[doc]
                n = np.diff(w.ptr)[doc]
                inside = (pos + WINDOW <= n)[:len(h) - WINDOW + 1]
                use = np.flatnonzero(_chosen(g, inside) & (pos + ANCHOR <= n) & (n >= WINDOW))
                g, doc, pos = g[use], doc[use], pos[use]
                _, first, count = np.unique(g, return_index=True, return_counts=True)
                rest = np.ones(len(g), bool)
                rest[first] = False
                yield _batch(ids.slice(x, n_docs), g[first], pos[first] << 1 | (count > 1), doc[first],
                             _grouped(doc[rest], pos[rest], n_docs), _tags(part) if tagged else None)
    return run


def _marks(at: list[int] | None, known: list[bytes] | None, tag: int, n: int, tagged: bool) -> np.ndarray:
    """Positions below ``n`` listed for one document as a mask."""
    mask = np.zeros(n, bool)
    if at:
        a = np.array(at, np.int64)
        if tagged:
            a = a[(a >> POS_BITS) == tag >> POS_BITS]
        a &= (1 << POS_BITS) - 1
        mask[a[a < n]] = True
    for k in known or ():
        if tagged:
            if int.from_bytes(k[:8], "little") != tag:
                continue
            k = k[8:]
        a = np.frombuffer(k, np.uint32)
        mask[a[a < n]] = True
    return mask


def _windows(tagged: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for x, y in slices(texts):
                part, n_docs = texts.slice(x, y - x), y - x
                w = find_words(*text_bytes(part))
                tags = _tags(part) if tagged else np.zeros(n_docs, np.int64)
                h = word_hashes(w)
                if len(h) < WINDOW:
                    continue
                mask = np.zeros(len(h), bool)
                for d in range(n_docs):
                    a, z = int(w.ptr[d]), int(w.ptr[d + 1])
                    if z - a >= WINDOW:
                        mask[a:z] = _marks(b.column(2)[x + d].as_py(), b.column(3)[x + d].as_py(), int(tags[d]),
                                           z - a, tagged)
                g = grams(h, ANCHOR)
                m = len(h) - WINDOW + 1
                doc = _owner(w)[:m]
                pos = np.arange(m) - w.ptr[doc]
                n = np.diff(w.ptr)[doc]
                again = _least(np.where(mask[:len(g)], g, ~U64(0)), PERIOD) == _least(g, PERIOD)
                at = np.flatnonzero(again & (pos + WINDOW <= n))
                if not len(at):
                    continue
                doc, pos = doc[at], pos[at]
                h0 = grams(h, WINDOW)[at]
                h1 = (grams(mix(h ^ _CHECK), WINDOW)[at] >> U64(32)).astype(np.uint32)
                own = ids.slice(x, n_docs)
                values = own.to_pylist()
                ranks = {v: i for i, v in enumerate(sorted({v for v in values if v is not None}), 1)}
                rank = np.array([ranks.get(v, 0) for v in values], np.int64)
                key = (rank[doc] << 32) + pos
                _, back = np.unique(h0 ^ (h1.astype(U64) << U64(17)), return_inverse=True)
                least = np.full(int(back.max()) + 1, np.iinfo(np.int64).max)
                np.minimum.at(least, back, key)
                first = key == least[back]
                known = _grouped(doc[~first], pos[~first], n_docs)
                p = h1[first].astype(np.int64) << 32 | pos[first]
                yield _batch(own, h0[first], p, doc[first], known, tags if tagged else None)
    return run


def _kept(tagged: bool, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1)
            for x, y in slices(texts):
                part = texts.slice(x, y - x)
                tags = _tags(part) if tagged else np.zeros(y - x, np.int64)
                n_words, gone, digest, kept = [], [], [], []
                for d, t in enumerate(part.to_pylist()):
                    words = (t or "").encode().split()
                    n = len(words)
                    mask = _marks(b.column(2)[x + d].as_py(), b.column(3)[x + d].as_py(), int(tags[d]), n, tagged)
                    edge = np.zeros(n + WINDOW + 1, np.int64)
                    starts = np.flatnonzero(mask)
                    edge[starts] += 1
                    np.subtract.at(edge, starts + WINDOW, 1)
                    cover = np.cumsum(edge)[:n] > 0
                    left = b" ".join(compress(words, ~cover)) if len(starts) else b" ".join(words)
                    n_words.append(n)
                    gone.append(int(cover.sum()))
                    digest.append(hashlib.sha256(left).hexdigest())
                    kept.append(left.decode() if with_text else None)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), pa.array(n_words, pa.int64()), pa.array(gone, pa.int64()),
                     pa.array(digest), pa.array(kept, pa.string())],
                    names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept"])
    return run


def _by_document(rows: DataFrame, pos, tagged: bool) -> DataFrame:
    """Positions of each document; a document's list is bounded by its length."""
    at, known = pos, F.col("known")
    if tagged:
        at = F.col("tag").bitwiseOR(pos)
        # the tag in front, in the byte order of the mask
        known = F.concat(*[F.unhex(F.substring(F.lpad(F.hex("tag"), 16, "0"), k, 2)) for k in range(15, 0, -2)], known)
    return rows.groupBy(F.col("doc_id").alias("_id")).agg(
        F.collect_list(F.when(F.col("known").isNull(), at)).alias("ats"),
        F.collect_list(F.when(F.col("known").isNotNull(), known)).alias("knowns"))


def _release(spark: SparkSession) -> None:
    """Lets Spark delete the shuffle files of finished jobs that nothing refers to.

    They go when the driver's JVM next collects its garbage, which a small
    driver may not do for long; the files would then add up on disk.
    """
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256[, kept]) per document."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = docs.schema["doc_id"].dataType.simpleString()
    # ids that repeat need a tag of the text beside the position
    tagged = bool(docs.groupBy("doc_id").count().where("count > 1 or doc_id is null").head(1))
    schema = _schema(kind, tagged)

    rows = docs.mapInArrow(_anchors(tagged), schema)
    near = Window.partitionBy("h").orderBy("doc_id", "p")
    rows = rows.withColumn("_dup", (F.col("p").bitwiseAND(F.lit(1)) == 1) | F.col("known").isNotNull()
                           | F.lag("h").over(near).isNotNull() | F.lead("h").over(near).isNotNull()).where("_dup")
    anchors = materialize(_by_document(rows, F.shiftright("p", 1), tagged), "anchors")
    _release(docs.sparkSession)

    joined = lambda found: docs.join(
        found, docs["doc_id"].eqNullSafe(found["_id"]), "left").select("doc_id", "text", "ats", "knowns")
    # dealt by the first hash alone; the second one is taken out of the packed column afterwards
    rows = joined(anchors).where(F.col("ats").isNotNull()).mapInArrow(_windows(tagged), schema).repartition("h") \
        .withColumn("check", F.shiftright("p", 32)).withColumn("pos", F.col("p").bitwiseAND(F.lit(0x7FFFFFFF)))
    order = Window.partitionBy("h", "check").orderBy(F.col("doc_id").asc_nulls_first(), "pos")
    rows = rows.withColumn("_nth", F.rank().over(order)).where("_nth > 1 or known is not null")
    repeats = _by_document(rows, F.col("pos"), tagged)

    out = joined(repeats).mapInArrow(
        _kept(tagged, with_text), f"doc_id {kind}, n_words long, n_removed long, kept_sha256 string, kept string")
    return out if with_text else out.drop("kept")


def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP10_SQL = """
WITH w AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS ws FROM documents),
g AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(ws, i, i + 19), ' ')) AS h
  FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 18)) AS i FROM w WHERE len(ws) >= 20)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY h ORDER BY doc_id, i) AS nth FROM g),
c AS (SELECT DISTINCT doc_id, i + k AS j FROM r, (SELECT unnest(range(0, 20)) AS k) WHERE nth > 1),
p AS (SELECT doc_id, ws[j] AS word, j FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS j FROM w)),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.j) AS kept, count(*) AS n
      FROM p ANTI JOIN c ON p.doc_id = c.doc_id AND p.j = c.j GROUP BY p.doc_id)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(len(ws) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept, '')) AS kept_sha256
FROM w LEFT JOIN k ON w.doc_id = k.doc_id
"""
