"""Document fingerprints by consistent weighted sampling.

A text is a set of weighted terms: its distinct words, each with weight
1 + ln(count).  For sample j every term draws r, c ~ Gamma(2, 1) and
b ~ U(0, 1) from hashes of (term, j); with t = floor(ln(weight) / r + b)
its key is ln c - r (t - b) - r.  The sample is the pair (term, t) with the
least key.  Two texts agree on a sample with a probability equal to the
generalised Jaccard similarity (sum of least weights over sum of greatest
weights) of their terms, so the share of equal samples estimates it.

Only DataFrame functions run: words are exploded and counted per document,
draws are column expressions, and samples are plain minima of one long
that holds the key above 32 bits of the (term, t) hash.  A document's draws
are shared by its text and its edited text.

Documents are dealt to ranges of ids (bounds from approximate quantiles),
each range also gets the first documents of the next one, and all windows
and aggregates keep that one partitioning: texts are shuffled once.

Cases: null texts count as empty; a text without words has the empty
fingerprint, alike to each other (1) and to nothing else (0); repeated ids
follow each other in the order of their texts; null ids come first; the
only document is its own next one; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

SAMPLES = 64
#: Samples of one block; more would make the generated method too long to be compiled.
BLOCK = 4
#: Parameter: cells of the quantile tables of Gamma(2, 1); the first ``EXACT`` cells of ln c are computed.
CELLS, EXACT = 256, 16
#: Parameter: weights of the first counts come from a table.
COUNTS = 64
ROWS_PER_RANGE = 2000
#: Bounds of ids that may reach the driver and the plan; beyond it ranges grow, and sorts inside them spill.
MAX_RANGES = 1 << 16
SEPARATOR = r"[\x20\x09-\x0D]+"
#: Key scale: keys lie in about [-50, 60]; 2**24 steps a unit fit 31 bits.
_SCALE, _SHIFT = float(1 << 24), 64.0
_MASK = 0xFFFFFFFF


def gamma2_quantile(p: float) -> float:
    """Quantile of Gamma(2, 1), whose distribution function is 1 - (1 + x) exp(-x)."""
    lo, hi = 0.0, 60.0
    for _ in range(60):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if 1 - (1 + mid) * math.exp(-mid) < p else (lo, mid)
    return (lo + hi) / 2


def _table(values: list[float]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def _sure(value: Column) -> Column:
    """The value without null checks in what follows."""
    return F.coalesce(value, F.lit(0.0))


def _pick(values: list[float], at: Column) -> Column:
    return _sure(F.get(_table(values), at))


def _unit(bits: Column, n: int) -> Column:
    """Uniform in (0, 1) from the ``n`` low bits."""
    return (bits.bitwiseAND(F.lit((1 << n) - 1)).cast("double") + 0.5) / float(1 << n)


def ln_gamma2(cell: Column, part: Column) -> Column:
    """ln c for c ~ Gamma(2, 1): linear between quantiles, the series of the quantile in the first cells."""
    edge = [math.log(gamma2_quantile(max(i, 0.5) / CELLS)) for i in range(CELLS)]
    edge.append(math.log(gamma2_quantile(1 - 0.25 / CELLS)))
    s = F.sqrt((cell + part) * (2.0 / CELLS))
    series = s * (1 + s * (1 / 3 + s * (11 / 72 + s * (43 / 540))))
    return F.when(cell < EXACT, _sure(F.ln(series))).otherwise(
        _pick(edge, cell) + _pick([b - a for a, b in zip(edge, edge[1:])], cell) * part)


def sample_minima(terms: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, side, term, w) -> per key, side and block the least packed keys ``m0..`` of BLOCK samples.

    The projections are kept apart so that each draw is computed once.
    """
    i = range(BLOCK)
    keep = [*keys, "side", "block", "term", "w"]
    rows = terms.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(SAMPLES // BLOCK - 1))))
    rows = rows.select(*keep, *[F.xxhash64("term", F.col("block") * BLOCK + k).alias(f"h{k}") for k in i])
    r = [gamma2_quantile((c + 0.5) / CELLS) for c in range(CELLS)]
    rows = rows.select(
        *keep,
        *[_pick(r, F.shiftrightunsigned(f"h{k}", 56).cast("int")).alias(f"r{k}") for k in i],
        *[_unit(F.shiftrightunsigned(f"h{k}", 32), 24).alias(f"b{k}") for k in i],
        *[F.shiftrightunsigned(f"h{k}", 24).bitwiseAND(F.lit(CELLS - 1)).cast("int").alias(f"c{k}") for k in i],
        *[_unit(F.col(f"h{k}"), 24).alias(f"u{k}") for k in i])
    rows = rows.select(
        *keep, *[f"r{k}" for k in i], *[f"b{k}" for k in i],
        *[F.floor(F.col("w") / F.col(f"r{k}") + F.col(f"b{k}")).alias(f"t{k}") for k in i],
        *[ln_gamma2(F.col(f"c{k}"), F.col(f"u{k}")).alias(f"l{k}") for k in i])

    def packed(k: int) -> Column:
        r, b, t, ln_c = (F.col(f"{x}{k}") for x in "rbtl")
        key = ln_c - r * (t - b) - r
        tag = F.col("term").bitwiseXOR(t * 2654435761).bitwiseAND(F.lit(_MASK))
        return F.shiftleft(((key + _SHIFT) * _SCALE).cast("long"), 32).bitwiseOR(tag)

    return rows.groupBy(*keys, "side", "block").agg(*[F.min(packed(k)).alias(f"m{k}") for k in i])


def _range_of(value: Column, cuts: list, kind: T.DataType) -> Column:
    """Number of cuts at or below the value, found by chunk and then inside the chunk; 0 for null."""
    step = max(1, math.isqrt(len(cuts)))
    chunks = [cuts[i:i + step] for i in range(0, len(cuts), step)] or [[]]
    array = T.ArrayType(kind)
    bounds = lambda c: F.array(*[F.lit(x) for x in c]).cast(array)
    below = lambda a: F.size(F.filter(a, lambda c: c <= value))
    chunk = below(bounds([c[0] for c in chunks[1:]]))
    inside = below(F.get(F.array(*[bounds(c) for c in chunks]), chunk))
    return F.when(value.isNotNull(), chunk * step + inside).otherwise(F.lit(0))


def with_next(docs: DataFrame, ranges: int) -> DataFrame:
    """(range, nth, copy, doc_id, text, next_text): every document with its successor's text.

    ``copy`` marks the first documents of the next range, kept for their
    fingerprints.  Ids are bounded by at most ``ranges`` quantiles.
    """
    kind = docs.schema["doc_id"].dataType
    if not isinstance(kind, T.NumericType):
        raise TypeError("document ids are numbers")
    cuts: list = []
    if ranges > 1:
        cuts = docs.select(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 16 * ranges)).first()[0]
    slot = _range_of(F.col("doc_id"), sorted(set(cuts or [])), kind)
    # never null, so that no null filter keeps the two readers of the exchange apart
    dealt = docs.withColumn("range", F.coalesce(slot.cast("int"), F.lit(0)))
    # first id of each range: at most ``ranges`` rows, and the range before it (the last wraps round)
    firsts = dealt.groupBy("range").agg(
        F.min("doc_id").alias("_first"), F.max(F.col("doc_id").isNull()).alias("_null"))
    order = Window.orderBy("range")
    firsts = firsts.select(
        F.when(F.col("_null"), F.lit(None).cast(kind)).otherwise(F.col("_first")).alias("_first"),
        F.coalesce(F.lag("range").over(order), F.max("range").over(Window.partitionBy()), F.lit(0)).alias("_to"))
    copies = dealt.join(F.broadcast(firsts), F.col("doc_id").eqNullSafe(F.col("_first"))) \
        .select("doc_id", "text", F.col("_to").alias("range"), F.lit(True).alias("copy"))
    rows = dealt.select("doc_id", "text", "range", F.lit(False).alias("copy")).unionByName(copies)
    inside = Window.partitionBy("range").orderBy("copy", F.col("doc_id").asc_nulls_first(), "text")
    return rows.withColumn("nth", F.row_number().over(inside)) \
        .withColumn("next_text", F.lead("text").over(inside))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next)."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    ranges = min(MAX_RANGES, max(1, math.ceil(docs.count() / ROWS_PER_RANGE)))
    rows = with_next(docs, ranges)
    n = F.length("text")
    cut = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - cut),
                      F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), cut))
    rows = rows.select("range", "nth", "copy", "doc_id", "text", n.cast("long").alias("n_chars"), edited.alias("edited"))
    heads = rows.select("range", "nth", "copy", "doc_id", "n_chars",
                        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"))
    key = ["range", "nth"]
    words = rows.select(*key, F.posexplode(F.array("text", "edited")).alias("side", "body")) \
        .select(*key, "side", F.explode(F.split("body", SEPARATOR)).alias("word")).where("word <> ''") \
        .select(*key, "side", F.xxhash64("word").alias("term"))
    terms = words.groupBy(*key, "term").agg(
        F.sum(F.when(F.col("side") == 0, 1).otherwise(0)).cast("int").alias("n0"),
        F.sum(F.when(F.col("side") == 1, 1).otherwise(0)).cast("int").alias("n1"))
    # a term with one weight in both texts (side 2) is drawn once
    sides = F.when(F.col("n0") == F.col("n1"), F.array(F.lit(2))).when(F.col("n1") == 0, F.array(F.lit(0))) \
        .when(F.col("n0") == 0, F.array(F.lit(1))).otherwise(F.array(F.lit(0), F.lit(1)))
    count = F.when(F.col("side") == 1, F.col("n1")).otherwise(F.col("n0"))
    known = [math.log(1 + math.log(max(1, c))) for c in range(COUNTS)]
    terms = terms.select(*key, "term", "n0", "n1", F.explode(sides).alias("side")) \
        .select(*key, "side", "term", count.alias("n")) \
        .select(*key, "side", "term", F.when(F.col("n") < COUNTS, _pick(known, F.col("n")))
                .otherwise(_sure(F.ln(1 + F.ln("n")))).alias("w"))
    mins = sample_minima(terms, key)
    # text and edited text of each block, then the blocks of each document
    least = lambda other: F.array(*[
        F.min(F.when(F.col("side") != other, F.col(f"m{k}"))).bitwiseAND(F.lit(_MASK)) for k in range(BLOCK)])
    blocks = mins.groupBy(*key, "block").agg(least(1).alias("own"), least(0).alias("edited"))
    prints = blocks.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("block", "own", "edited"))).alias("_b"))
    samples = lambda side: F.coalesce(F.filter(
        F.flatten(F.transform("_b", lambda b: b[side])), lambda v: v.isNotNull()), F.array().cast("array<long>"))
    # texts without words have no samples
    prints = heads.join(prints, key, "left").select(*heads.columns, samples("own").alias("_own"),
                                                    samples("edited").alias("_edited"))
    follow = Window.partitionBy("range").orderBy("nth")
    prints = prints.withColumn("_next", F.lead("_own").over(follow)).where(~F.col("copy"))

    def likeness(a: str, b: str) -> Column:
        same = F.aggregate(F.zip_with(a, b, lambda x, y: (x == y).cast("int")), F.lit(0), lambda s, x: s + x)
        return F.when((F.size(a) == 0) | (F.size(b) == 0),
                      ((F.size(a) == 0) & (F.size(b) == 0)).cast("double")).otherwise(same / float(SAMPLES))

    text_of = lambda a: F.lower(F.array_join(F.transform(a, lambda x: F.lpad(F.hex(x), 8, "0")), ""))
    return prints.select(
        "doc_id", "n_chars", "edited_sha256", text_of("_own").alias("fingerprint"),
        text_of("_edited").alias("edited_fingerprint"), likeness("_own", "_edited").alias("near_edited"),
        likeness("_own", "_next").alias("near_next"))


def op2_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(spark.read.parquet(f"{sf_dir}/documents.parquet"))
