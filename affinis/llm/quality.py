"""Quality classifier with hierarchical empirical Bayes.

Document evidence: two sparse logistic models (low quality, toxic) on
hashed features of words (the word, its first 4 and 5 bytes, its ending
and its shape) and on binned shares of shapes and repetition.  They are
fitted by FTRL with an L1 penalty on at most ``SAMPLE`` labelled rows.

Site evidence: every document counts with its classifier probability.  The
rate of a host is shrunk toward the global rate, and the rate of a path of
the host toward the host's; the strength of either prior follows from the
spread of the rates (moments), so sparse sites stay near their parent.
The posterior log odds of a document are those of its classifier, less the
sample's base rate, plus those of its path.

Sites are counted by grouped aggregation; the site table is joined back
under ``SALTS`` salts, so a host with a third of all rows is split.

Cases: null texts count as empty; an empty text has only its own shape
features; null hosts and paths are sites of their own; labels without a
document or with null classes are not used; without labels of both classes
a model says the base rate; repeated rows are scored alike; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from affinis.llm.words import U64, Words, _power, _BYTE, find_words, lower_ascii, mix, slices, text_bytes
from affinis.session import materialize

#: Parameter: bound of the labelled rows that the models are fitted on.
SAMPLE = 12_000
BITS = 18
EPOCHS = 5
ALPHA, BETA, L2 = 0.3, 1.0, 1.0
#: L1 penalty of each model; few words tell toxicity, so its model is the sparser one.
L1 = {"low": 4.0, "toxic": 8.0}
SALTS = 16
PREFIXES = (4, 5)
_N_SHARES, _BINS = 8, 12


def _span_hash(total: np.ndarray, inv: np.ndarray, start: np.ndarray, end: np.ndarray, kind: int) -> np.ndarray:
    h = mix((total[end] - total[start]) * inv[start] ^ U64(kind << 56))
    return (h >> U64(64 - BITS)).astype(np.int64)


def _shares(w: Words, doc: np.ndarray, raw: np.ndarray, same: np.ndarray) -> np.ndarray:
    """Per document: shares of words by shape, and of repeated words."""
    n_docs = len(w.ptr) - 1
    n = np.maximum(1, np.diff(w.ptr))
    first, last = raw[w.start], raw[w.end - 1]
    upper = (raw >= 65) & (raw <= 90)
    lower = (raw >= 97) & (raw <= 122)
    letter = upper | lower | (raw >= 128)
    count = lambda m: np.concatenate(([0], np.cumsum(m)))
    up, lo, le = count(upper), count(lower), count(letter)
    inside = lambda c: c[w.end] - c[w.start]
    length = w.end - w.start
    shapes = (
        (inside(up) > 1) & (inside(lo) == 0),          # capitals
        inside(le) == 0,                               # no letters
        (length > 2) & (last == raw[w.end - 2]) & ~letter[w.end - 1],  # ends in a repeated sign
        ~letter[w.end - 1],                            # ends in a sign
        upper[w.start],                                # capital first
        length > 14,
        (first >= 48) & (first <= 57),
    )
    out = np.zeros((_N_SHARES, n_docs))
    for i, m in enumerate(shapes):
        out[i] = np.bincount(doc, m, n_docs) / n
    out[7] = 1 - np.bincount(doc, same, n_docs) / n
    return out


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of each document: concatenated ids and document bounds."""
    raw, bounds = text_bytes(column)
    data = lower_ascii(raw)
    w = find_words(data, bounds)
    n_docs = len(bounds) - 1
    doc = np.repeat(np.arange(n_docs), np.diff(w.ptr))
    pw, inv = _power(len(data) + 1)
    total = np.zeros(len(data) + 1, U64)
    np.cumsum(_BYTE[data] * pw[:len(data)], out=total[1:])
    length = w.end - w.start
    parts = [(doc, _span_hash(total, inv, w.start, w.end, 1))]
    for p in PREFIXES:
        long = length > p
        parts.append((doc[long], _span_hash(total, inv, w.start[long], w.start[long] + p, 1 + p)))
    parts.append((doc, _span_hash(total, inv, np.maximum(w.start, w.end - 2), w.end, 99)))
    # a word that the document has had before
    key = (doc << BITS) | parts[0][1]
    _, at = np.unique(key, return_index=True)
    new = np.zeros(len(doc), bool)
    new[at] = True
    shares = _shares(w, doc, raw, new)
    bins = np.ceil(np.minimum(shares, 1) * (_BINS - 1)).astype(np.int64)
    size = np.minimum(_BINS - 1, np.log2(np.maximum(1, np.diff(w.ptr))).astype(np.int64))
    for i, b in enumerate([*bins, size]):
        # each bin, and all bins below it: thresholds
        for t in range(_BINS):
            has = np.flatnonzero(b >= t)
            parts.append((has, np.full(len(has), ((i + 1) * 7919 + t * 104729) % (1 << BITS), np.int64)))
    every = np.unique(np.concatenate([(d << BITS) | f for d, f in parts]))
    return every & ((1 << BITS) - 1), np.searchsorted(every >> BITS, np.arange(n_docs + 1))


def fit(rows: list[np.ndarray], y: np.ndarray, l1: float, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """FTRL-proximal logistic regression on binary features; (weights, base log odds)."""
    z, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    rate = (y.sum() + 0.5) / (len(y) + 1)
    base = float(np.log(rate / (1 - rate)))
    if len(np.unique(y)) < 2:
        return np.zeros(1 << BITS), base

    def weights(zi, ni):
        return np.where(np.abs(zi) <= l1, 0.0, -(zi - np.sign(zi) * l1) / ((BETA + np.sqrt(ni)) / ALPHA + L2))

    boost = np.sqrt((1 - rate) / rate)
    order = np.random.default_rng(5)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            f = rows[i]
            zi, ni = z[f], n[f]
            w = weights(zi, ni)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + base, -30, 30)))
            g = (p - y[i]) * (boost if y[i] else 1.0)
            s = (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA
            z[f] += g - s * w
            n[f] += g * g
    return weights(z, n), base


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict[str, tuple[np.ndarray, float]]:
    """Models of ``low`` (quality 0) and ``toxic`` from at most ``sample`` labelled rows or so."""
    labels = labels.select("doc_id", "quality", "toxic").where(
        "doc_id is not null and quality is not null and toxic is not null")
    n = labels.count()
    share = min(1.0, 0.95 * sample / max(1, n))
    picked = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int(share * (1 << 20)) + (share == 1.0))

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in slices(b.column(3)):
                ids, bounds = features(b.column(3).slice(x, y - x))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).slice(x, y - x), b.column(1).slice(x, y - x), b.column(2).slice(x, y - x),
                     pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(ids, pa.int32()))],
                    names=["doc_id", "quality", "toxic", "f"])

    rows = picked.join(docs.select("doc_id", "text"), "doc_id").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"),
        F.col("toxic").cast("int").alias("toxic"), "text") \
        .mapInArrow(make, "doc_id long, quality int, toxic int, f array<int>").toArrow()
    order = np.argsort(rows["doc_id"].to_numpy(), kind="stable")
    lists = rows["f"].combine_chunks()
    values, bounds = lists.flatten().to_numpy(), np.concatenate(([0], np.cumsum(
        np.diff(lists.offsets.to_numpy())))) if len(lists) else np.zeros(1, int)
    feats = [values[bounds[i]:bounds[i + 1]] for i in order]
    quality, toxic = (rows[c].to_numpy()[order] for c in ("quality", "toxic"))
    return {"low": fit(feats, (quality == 0).astype(float), L1["low"]),
            "toxic": fit(feats, (toxic == 1).astype(float), L1["toxic"])}


def score(docs: DataFrame, models: dict[str, tuple[np.ndarray, float]]) -> DataFrame:
    """Adds ``low`` and ``toxic``, the classifiers' log odds, to (doc_id, host, path, text); drops the text."""
    low, toxic = ((w.astype(np.float32), b) for w, b in (models["low"], models["toxic"]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x, y in slices(b.column(3)):
                ids, bounds = features(b.column(3).slice(x, y - x))
                out = [b.column(c).slice(x, y - x) for c in range(3)]
                for w, base in (low, toxic):
                    total = np.concatenate(([0], np.cumsum(w[ids], dtype=np.float64)))
                    out.append(pa.array(np.round(total[bounds[1:]] - total[bounds[:-1]] + base, 6)))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "host", "path", "low", "toxic"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "host", "path", "text").mapInArrow(
        run, f"doc_id {kind}, host string, path string, low double, toxic double")


def _logit(p):
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.ln(p / (1 - p))


def _strength(rows: DataFrame, rate: str, parent: str, n: str) -> F.Column:
    """Prior strength by moments: p (1 - p) / spread - 1, where the spread is beyond the sampling noise."""
    noise = F.sum(F.col(parent) * (1 - F.col(parent)))
    spread = F.sum(F.col(n) * F.pow(F.col(rate) - F.col(parent), 2)) - noise
    scale = F.sum(F.col(n) - 1) + 1e-9
    tau = F.greatest(F.lit(1e-6), spread / scale)
    mean = F.sum(F.col(n) * F.col(parent) * (1 - F.col(parent))) / F.sum(n)
    return F.greatest(F.lit(1.0), mean / tau - 1)


def site_posteriors(scored: DataFrame) -> DataFrame:
    """(host, path, n, low_rate, toxic_rate): shrunk rates of every path."""
    heads = ("low", "toxic")
    p = lambda c: 1 / (1 + F.exp(-F.col(c)))
    paths = materialize(scored.groupBy("host", "path").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(p(h)).alias(f"{h}_sum") for h in heads]), "sites")
    hosts = paths.groupBy("host").agg(F.sum("n").alias("host_n"),
                                      *[F.sum(f"{h}_sum").alias(f"{h}_host_sum") for h in heads])
    every = hosts.agg(F.sum("host_n").alias("all_n"), *[F.sum(f"{h}_host_sum").alias(f"{h}_all") for h in heads])
    hosts = hosts.crossJoin(F.broadcast(every))
    for h in heads:
        hosts = hosts.withColumn(f"{h}_global", F.col(f"{h}_all") / F.col("all_n")) \
            .withColumn(f"{h}_raw", F.col(f"{h}_host_sum") / F.col("host_n"))
    strength = hosts.agg(*[_strength(hosts, f"{h}_raw", f"{h}_global", "host_n").alias(f"{h}_m") for h in heads])
    hosts = hosts.crossJoin(F.broadcast(strength))
    hosts = hosts.select(F.col("host").alias("_host"), *[
        ((F.col(f"{h}_host_sum") + F.col(f"{h}_m") * F.col(f"{h}_global"))
         / (F.col("host_n") + F.col(f"{h}_m"))).alias(f"{h}_host") for h in heads])
    paths = paths.join(hosts, F.col("host").eqNullSafe(F.col("_host"))).drop("_host")
    for h in heads:
        paths = paths.withColumn(f"{h}_raw", F.col(f"{h}_sum") / F.col("n"))
    strength = paths.agg(*[_strength(paths, f"{h}_raw", f"{h}_host", "n").alias(f"{h}_m") for h in heads])
    return paths.crossJoin(F.broadcast(strength)).select("host", "path", "n", *[
        ((F.col(f"{h}_sum") + F.col(f"{h}_m") * F.col(f"{h}_host"))
         / (F.col("n") + F.col(f"{h}_m"))).alias(f"{h}_rate") for h in heads])


def classify(docs: DataFrame, models: dict[str, tuple[np.ndarray, float]], host: str = "source", path: str = "lang",
             doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, p_low, p_toxic, low_rate, toxic_rate, keep) per document, with the models of ``train``."""
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"),
                       F.col(path).cast("string").alias("path"), F.col(text).cast("string").alias("text"))
    scored = materialize(score(docs, models), "scored")
    sites = site_posteriors(scored).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))) \
        .withColumnsRenamed({"host": "_host", "path": "_path"})
    rows = scored.withColumn("_s", F.pmod(F.hash("doc_id", "low"), F.lit(SALTS)))
    joined = rows.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path"))
                       & (F.col("_s") == F.col("_salt")))
    post = lambda h: 1 / (1 + F.exp(-(F.col(h) - models[h][1] + _logit(F.col(f"{h}_rate")))))
    return joined.select("doc_id", post("low").alias("p_low"), post("toxic").alias("p_toxic"), "low_rate", "toxic_rate") \
        .withColumn("keep", (F.col("p_low") < 0.5) & (F.col("p_toxic") < 0.5))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
