"""Resampling of documents by their importance for a target distribution.

Features of a text are its runs of ``low`` to ``high`` consecutive words,
joined by one space; A-Z are lower-cased first and a word is a run of
digits, letters a-z and code points beyond ASCII.  A feature's bucket is
the CRC-32 of its UTF-8 bytes modulo ``buckets`` (``crc.span_crcs``).  Both
corpora are counted by bucket, one table of at most ``buckets`` rows; its
gains go to every task, an array of fixed length.  Texts are read twice,
once to count and once to weigh, and never shuffled.  The draw is a
Gumbel top-k: scores are sorted by range with the id alone, so no task
holds all of them.

Memory follows ``PIECE`` bytes, not the text: longer texts are taken in
pieces that end between words and share ``high`` - 1 words.

Cases: null or empty texts have no feature and weight 0; a null id counts
as the empty string in the hash and ranks before other ids; repeated rows
are separate documents; ties go to the smaller id; empty tables count 0;
an empty corpus gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.llm.crc import span_crcs
from affinis.llm.words import find_words, lower_ascii, slices, text_bytes
from affinis.operators.prep import global_row_number
from affinis.session import materialize

#: Bytes of a text that are looked at together.
PIECE = 1 << 20
BUCKETS = 10_000
SEED = 2024

_byte = np.arange(256)
_INSIDE = ((_byte >= 48) & (_byte <= 57)) | ((_byte >= 97) & (_byte <= 122)) | (_byte >= 128)


def _after(data: np.ndarray, at: int, inside: bool) -> int:
    """Position of the first byte from ``at`` that is (not) in a word, or the end."""
    while at < len(data):
        found = np.flatnonzero(_INSIDE[lower_ascii(data[at:at + PIECE])] == inside)
        if len(found):
            return at + int(found[0])
        at += PIECE
    return len(data)


def pieces(data: np.ndarray, overlap: int) -> Iterator[tuple[np.ndarray, int]]:
    """(lower-case bytes, words that the piece before had too) of one text; pieces end between words.

    Every piece but the last has a word of its own; a word of more than
    ``PIECE`` bytes stays whole.
    """
    at, shared = 0, 0
    while at < len(data):
        stop = _after(data, min(at + PIECE, len(data)), False)
        while True:
            part = lower_ascii(data[at:stop])
            w = find_words(part, np.array([0, len(part)]), _INSIDE[part])
            if len(w.start) > shared or stop >= len(data):
                break
            stop = _after(data, _after(data, stop, True), False)
        yield part, shared
        if stop >= len(data):
            return
        shared = min(overlap, len(w.start))
        at = at + int(w.start[-shared]) if shared else stop


def run_buckets(data: np.ndarray, bounds: np.ndarray, low: int, high: int, buckets: int,
                shared: int = 0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, bucket) of every run and the words of each document.

    Runs that end within the first ``shared`` words are left out.
    """
    w = find_words(data, bounds, _INSIDE[data])
    words = np.diff(w.ptr)
    size = w.end - w.start
    if high > 1:  # write the words with one space between them, as runs are joined
        start = np.concatenate(([0], np.cumsum(size + 1)[:-1])).astype(np.int64)
        at = np.arange(int(size.sum())) + np.repeat(w.start - (start - np.arange(len(start))), size)
        joined = np.full(int((size + 1).sum()), 32, np.uint8)
        joined[np.arange(len(at)) + np.repeat(np.arange(len(size)), size)] = data[at]
    else:
        start, joined = w.start, data
    end = start + size
    owner = np.repeat(np.arange(len(words)), words)
    left = np.repeat(w.ptr[1:], words) - np.arange(len(owner))
    who, what = [], []
    for n in range(low, high + 1):
        for phase in range(n):  # runs of one phase do not overlap
            first = np.arange(phase, len(owner), n)
            first = first[(left[first] >= n) & (first + n > shared)]
            who.append(owner[first])
            what.append(span_crcs(joined, start[first], end[first + n - 1]) % np.uint32(buckets))
    return np.concatenate(who), np.concatenate(what).astype(np.int64), words


def _features(column: pa.Array, low: int, high: int, buckets: int) -> Iterator[tuple]:
    """(rows, document within the rows, bucket, words of the documents) by slice or piece."""
    for x, y in slices(column, PIECE):
        data, bounds = text_bytes(column.slice(x, y - x))
        if len(data) <= PIECE:
            yield (x, y, *run_buckets(lower_ascii(data), bounds, low, high, buckets))
            continue
        for part, shared in pieces(data, high - 1):  # one long text
            who, what, words = run_buckets(part, np.array([0, len(part)]), low, high, buckets, shared)
            yield x, y, who, what, words - shared


def bucket_counts(df: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS, text: str = "text") -> DataFrame:
    """(bucket, n) of all features of all rows; only buckets that occur."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(buckets, np.int64)
        for b in batches:
            for *_, what, _words in _features(b.column(0), low, high, buckets):
                n += np.bincount(what, minlength=buckets)
        some = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(n[some])], names=["bucket", "n"])

    return df.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "bucket long, n long") \
        .groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(target: DataFrame, source: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain): how much likelier a bucket is in the target, in thousandths of a natural logarithm.

    One row for every bucket; both sides get one count more in each.
    """
    both = target.select("bucket", F.col("n").alias("t"), F.lit(0).cast("long").alias("s")) \
        .union(source.select("bucket", F.lit(0).cast("long"), F.col("n"))) \
        .union(target.sparkSession.range(buckets).select("id", F.lit(0).cast("long"), F.lit(0).cast("long"))) \
        .groupBy("bucket").agg(F.sum("t").alias("t"), F.sum("s").alias("s"))
    every = Window.partitionBy()
    d = lambda c: c.cast("double")
    return both.withColumn("tt", F.sum("t").over(every)).withColumn("ss", F.sum("s").over(every)).select(
        "bucket", F.floor(1000 * F.log(d(F.col("t") + 1) * d(F.col("ss") + buckets)
                                       / (d(F.col("s") + 1) * d(F.col("tt") + buckets)))).cast("long").alias("gain"))


def importance_weights(df: DataFrame, gains: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS,
                       doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight) per row.

    ``gains`` has one row per bucket; the array of ``buckets`` numbers goes
    to the tasks.
    """
    table = np.zeros(buckets, np.int64)
    known = gains.select("bucket", "gain").toArrow()
    table[known.column(0).to_numpy()] = known.column(1).to_numpy()

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros((3, b.num_rows), np.int64)
            for x, y, who, what, words in _features(b.column(1), low, high, buckets):
                out[0, x:y] += np.bincount(who, minlength=y - x)
                out[1, x:y] += words
                run = np.concatenate(([0], np.cumsum(table[what[(order := np.argsort(who, kind="stable"))]])))
                ends = np.searchsorted(who[order], np.arange(y - x + 1))
                out[2, x:y] += run[ends[1:]] - run[ends[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, out)],
                                             names=["doc_id", "n_features", "n_words", "weight"])

    kind = df.schema[doc_id].dataType.simpleString()
    return df.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(
        weigh, f"doc_id {kind}, n_features long, n_words long, weight long")


def gumbel_scores(weighted: DataFrame, seed: int = SEED) -> DataFrame:
    """Adds ``score``: the weight plus Gumbel noise from a hash of the id, in thousandths."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    return weighted.withColumn("score", (F.col("weight") + noise).cast("long"))


def draw(scored: DataFrame, per_cent: int = 10, least_words: int = 20) -> DataFrame:
    """Adds ``rank`` (1, 2, 3 ...) to the highest scores of the documents with enough words; else null.

    ``scored`` is written first, as its texts would be read again.
    """
    scored = materialize(scored, "importance-scores")
    enough = scored.where(F.col("n_words") >= least_words)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_first(), F.col("n_features"), F.col("weight")]
    ranked = global_row_number(enough, order, "_at")
    most = ranked.agg(F.floor(F.count(F.lit(1)) * per_cent / F.lit(100)).alias("_most"))
    rank = F.when(F.col("_at") < F.col("_most"), F.col("_at") + 1).cast("long")
    few = scored.where(F.col("n_words") < least_words).withColumn("rank", F.lit(None).cast("long"))
    return ranked.crossJoin(F.broadcast(most)).withColumn("rank", rank).drop("_at", "_most").unionByName(few)


def resample(docs: DataFrame, target: DataFrame, low: int = 1, high: int = 1, buckets: int = BUCKETS,
             seed: int = SEED, per_cent: int = 10, least_words: int = 20, doc_id: str = "doc_id",
             text: str = "text", target_text: str = "text") -> DataFrame:
    """(doc_id, n_features, n_words, weight, score, rank) per document of ``docs``.

    Documents that look like ``target`` are drawn without replacement, with
    odds that follow their weight.
    """
    gains = bucket_gains(bucket_counts(target, low, high, buckets, target_text),
                         bucket_counts(docs, low, high, buckets, text), buckets)
    weighted = importance_weights(docs, gains, low, high, buckets, doc_id, text)
    return draw(gumbel_scores(weighted, seed), per_cent, least_words)


def op13_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    target = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return resample(docs, target).select("doc_id", "n_features", "weight", "score", "rank")


#: The checksum of each distinct word, bit by bit from its bytes (CRC-32, reflected).
OP13_SQL = r"""
WITH RECURSIVE
crc0(b, k, c) AS (
  SELECT b, 0, CAST(b AS BIGINT) FROM range(256) r(b)
  UNION ALL
  SELECT b, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, CAST(3988292384 AS BIGINT)) ELSE c >> 1 END FROM crc0 WHERE k < 8),
tab AS (SELECT list(c ORDER BY b) AS t FROM crc0 WHERE k = 8),
w AS (
  SELECT 0 AS side, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS word FROM documents
  UNION ALL
  SELECT 1, NULL, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                           '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark),
words AS (SELECT word, hex(encode(word)) AS x FROM (SELECT DISTINCT word FROM w)),
crcs AS (
  SELECT word, xor(list_reduce(list_transform(range(0, CAST(length(x) / 2 AS BIGINT)),
             lambda i: CAST(concat('0x', substring(x, CAST(2 * i + 1 AS BIGINT), 2)) AS BIGINT)),
           lambda a, b: xor(a >> 8, t[CAST(xor(a & 255, b) AS BIGINT) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS crc
  FROM words, tab),
f AS (SELECT w.side, w.doc_id, c.crc % 10000 AS bucket FROM w JOIN crcs c ON w.word = c.word),
n AS (SELECT bucket, count(*) FILTER (side = 0) AS s, count(*) FILTER (side = 1) AS t FROM f GROUP BY bucket),
g AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * ((SELECT sum(s) FROM n) + 10000)
                    / (CAST(s + 1 AS DOUBLE) * ((SELECT sum(t) FROM n) + 10000)))) AS BIGINT) AS gain FROM n),
d AS (SELECT doc_id, count(*) AS n_features, sum(gain) AS weight FROM f JOIN g USING (bucket) WHERE side = 0 GROUP BY doc_id),
h AS (SELECT doc_id, CAST(concat('0x', substring(sha256(concat('2024:', doc_id)), 1, 8)) AS BIGINT) AS h FROM documents),
sc AS (SELECT h.doc_id, coalesce(n_features, 0) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
              CAST(coalesce(weight, 0) AS BIGINT)
              + CAST(floor(-1000 * ln(-ln((h.h + CAST(0.5 AS DOUBLE)) / CAST(4294967296 AS DOUBLE)))) AS BIGINT) AS score
       FROM h LEFT JOIN d USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank, count(*) OVER () AS n
      FROM sc WHERE n_features >= 20)
SELECT sc.doc_id, n_features, weight, score, CASE WHEN rank <= n * 10 // 100 THEN rank END AS rank
FROM sc LEFT JOIN r USING (doc_id)
"""
