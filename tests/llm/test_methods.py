"""Operators against brute force, exact round trips and held-out accuracy."""

import hashlib
import math
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import (decontamination, fingerprints, graph, html_blocks, mixing, near_dup, quality, secrets,
                         substring_dedup, warc)

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(limit=""):
    return duckdb.sql(f"SELECT doc_id, text FROM '{SF}/documents.parquet' ORDER BY doc_id {limit}").fetchall()


def test_items_are_searched_block_by_block(spark, monkeypatch):
    """64 input partitions of items make as many passes as their size asks for, with the same hits."""
    passes = []
    search = decontamination._search
    monkeypatch.setattr(decontamination, "_search", lambda *a: passes.append(1) or search(*a))
    words = [f"w{i % 251}x{i % 17}" for i in range(4000)]
    docs = spark.createDataFrame([(d, " ".join(words[d * 50:d * 50 + 400])) for d in range(60)], "doc_id long, text string")
    items = spark.createDataFrame([(i, " ".join(words[i * 60:i * 60 + 5 + i % 40])) for i in range(64)],
                                  "item_id long, text string").repartition(64)
    hits = lambda: sorted(map(tuple, decontamination.contaminated(docs, items).collect()))
    one = hits()
    assert len(passes) == 1 and len(one) > 100
    monkeypatch.setattr(decontamination, "BLOCK_SHINGLES", 300)
    assert hits() == one and len(passes) <= 7


# --- 1 ---------------------------------------------------------------------
BASE = (("assign", re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                              re.A), 8),
        ("access", re.compile(r"(AKIA[A-Z0-9]+)"), 16), ("hex", re.compile(r"([0-9a-f]+)"), 32))


def test_secret_spans_equal_brute_force(spark):
    r = random.Random(2)
    parts = ["password", "TOKEN", "api_key", " : ", "=", "\"", "'", "AKIA", "ABCD1234EFGH5678", "0123456789abcdef" * 2,
             "x\x01y", "\x02", "\x03", "é😀", " ", "user=bob", "deadbeef", "zz", "secret=short", "= \"longenough1\""]
    docs = [(i, "".join(r.choice(parts) for _ in range(r.randint(0, 25)))) for i in range(1500)] + documents()
    got = {(x.doc_id, x.n_assign, x.n_access, x.n_hex): [(s.start, s.stop, s.kind) for s in x.spans]
           for x in secrets.scan(spark.createDataFrame(docs[:1500], "doc_id long, text string")).collect()}
    for i, t in docs[:1500]:
        spans = sorted((m.start(), k, m.end(), name) for k, (name, p, least) in enumerate(BASE)
                       for m in p.finditer(t) if len(m[1]) >= least)
        n = [sum(s[1] == k for s in spans) for k in range(3)]
        base = [s for s in got[(i, *n)] if s[2] in secrets.BASE]
        assert base == [(a, b, name) for a, _, b, name in spans]


def test_a_string_inside_an_address_is_no_secret(spark):
    path = "See https://github.com/Abc1/Def2Ghi3Jkl4Mno5Pqr6 and user: joe today"
    docs = [(0, path), (1, path + " Ab3dEf6hIj9kLmN0pQrSt"), (2, "host=db.example.com user=bob x?Ab3dEf6hIj9kLmN0pQrSt")]
    out = {r.doc_id: [s.kind for s in r.spans] for r in
           secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == [] and out[1] == ["endpoint", "ident", "weak"] and out[2] == ["endpoint", "ident", "weak"]


def test_weak_parts_need_a_complement(spark):
    weak = "Ab3dEf6hIj9kLmN0pQrSt"
    far = "." * 300
    docs = [(0, f"user=bob {weak}"), (1, f"user=bob {far} {weak}"), (2, f"{weak} {weak}"), (3, "user=bob host=db.example.com"),
            (4, f"host=db.example.com user=bob {weak}"), (5, "user=bob token=abcdefgh1"),
            (6, " ".join(["user=bob", weak] * 3000))]
    out = {r.doc_id: [s.kind for s in r.spans] for r in
           secrets.scan(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert out[0] == ["ident", "weak"] and out[1] == out[2] == out[3] == []
    assert out[4] == ["endpoint", "ident", "weak"] and out[5] == ["ident", "assign"] and len(out[6]) == 6000


# --- 2 ---------------------------------------------------------------------
def weights(text):
    n = {}
    for w in WORD.findall(text):
        n[w] = n.get(w, 0) + 1
    return {w: 1 + math.log(c) for w, c in n.items()}


def jaccard(a, b):
    a, b = weights(a), weights(b)
    keys = set(a) | set(b)
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


def test_fingerprints_estimate_generalised_jaccard(spark, monkeypatch):
    docs = documents("LIMIT 300")
    monkeypatch.setattr(fingerprints, "ROWS_PER_RANGE", 40)  # many ranges
    out = {r.doc_id: r for r in fingerprints.fingerprints(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    errors, spread = [], []
    for k, (i, t) in enumerate(docs):
        follow = docs[(k + 1) % len(docs)][1]
        cut = len(t) // 4
        edited = t[:len(t) - cut] + follow[:cut]
        assert out[i].n_chars == len(t) and out[i].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        for got, true in ((out[i].near_edited, jaccard(t, edited)), (out[i].near_next, jaccard(t, follow))):
            errors.append(got - true)
            spread.append(true * (1 - true) / fingerprints.SAMPLES)
    assert abs(np.mean(errors)) < 0.02 and np.std(errors) < 1.3 * math.sqrt(np.mean(spread))
    same = {}
    for i, t in docs:
        assert same.setdefault(t, out[i].fingerprint) == out[i].fingerprint
    # different texts share a fingerprint only if nearly all words are the same
    by_print = {}
    for t, p in same.items():
        assert jaccard(by_print.setdefault(p, t), t) > 0.85


# --- 3 ---------------------------------------------------------------------
def test_short_items_in_long_documents(spark):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(r.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(r.choice((3, 6, 12, 30, 90))))) for i in range(60)]
    docs, exp = [], set()
    for d in range(40):
        words = [word() for _ in range(r.choice((10, 200, 8000)))]
        for i in r.sample(range(60), 3):
            at = r.randint(0, len(words))
            words[at:at] = (items[i][1].upper() + "!").split()
        docs.append((d, " ".join(words)))
    norm = lambda t: re.findall("[a-z0-9]+", t.lower())
    grams = lambda w, n: {tuple(w[k:k + n]) for k in range(len(w) - n + 1)}
    for d, t in docs:
        w = norm(t)
        for i, u in items:
            v = norm(u)
            n = min(5, len(v))
            s = grams(v, n)
            if len(s & grams(w, n)) >= 0.8 * len(s):
                exp.add((d, i))
    out = decontamination.contaminated(spark.createDataFrame(docs, "doc_id long, text string"),
                                       spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x.doc_id, x.item_id) for x in out} == exp and len(out) == len(exp) > 60


# --- 4 ---------------------------------------------------------------------
def test_chunks_round_trip(spark, tmp_dir, monkeypatch):
    monkeypatch.setattr(warc, "RECORDS_PER_FILE", 5)  # records end in other files than they begin
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    warc.write_archives(pages.repartition(2), f"{tmp_dir}/w", chunk_chars=700)
    chunks = warc.read_chunks(spark, f"{tmp_dir}/w")
    whole = chunks.groupBy("record_id").agg(
        F.max("page_id").cast("long").alias("page_id"),
        F.array_sort(F.collect_list(F.struct("chunk_no", "data"))).alias("c")).collect()
    html = {r.page_id: r.html.encode() for r in pages.collect()}
    assert {r.page_id: b"".join(bytes(c.data) for c in r.c) for r in whole} == html
    assert max(len(r.c) for r in whole) > 10
    got = {int(r.page_id): (r.payload_bytes, r.payload_digest) for r in warc.read_records(spark, f"{tmp_dir}/w").collect()}
    assert got == {i: (len(h), hashlib.sha256(h).hexdigest()) for i, h in html.items()}


def test_payload_that_looks_like_records(spark, tmp_dir):
    trap = "WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    pages = spark.createDataFrame([(1, "u", trap * 100), (2, "u", "\r\n\r\n")], "page_id long, url string, html string")
    warc.write_archives(pages, f"{tmp_dir}/w", chunk_chars=64)
    got = {r.page_id: r.payload_digest for r in warc.read_records(spark, f"{tmp_dir}/w").collect()}
    assert got == {str(i): hashlib.sha256(h.encode()).hexdigest() for i, h in ((1, trap * 100), (2, "\r\n\r\n"))}


# --- 5 ---------------------------------------------------------------------
def test_classifier_holds_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet")
    held = F.pmod(F.xxhash64("doc_id"), F.lit(5)) == 0
    out = quality.classify(docs, quality.train(docs, labels.where(~held)))
    n = out.join(labels.where(held), "doc_id").select(
        (F.col("keep") == ((F.col("quality") == 1) & (F.col("toxic") == 0))).alias("ok"),
        ((F.col("quality") == 1) & (F.col("toxic") == 0)).alias("clean")).groupBy("clean").agg(
        F.avg(F.col("ok").cast("int")).alias("share")).collect()
    share = {r.clean: r.share for r in n}
    assert share[True] > 0.98 and share[False] > 0.9


def test_sparse_sites_shrink(spark):
    rows = [("big", "a", i, 3.0 if i % 2 else -3.0, -5.0) for i in range(400)] + [("tiny", "a", 900, 3.0, -5.0)] + [
        (f"h{k}", "a", 1000 + k * 50 + i, -3.0, -5.0) for k in range(10) for i in range(50)]
    scored = spark.createDataFrame(rows, "host string, path string, doc_id long, low double, toxic double")
    rate = {r.host: r.low_rate for r in quality.site_posteriors(scored).collect()}
    assert abs(rate["big"] - 0.5) < 0.02 and rate["tiny"] < 0.9 and rate["h1"] < 0.1


def test_posteriors_equal_brute_force(spark, monkeypatch):
    """Moments, both levels of shrinking and the combined odds, recomputed in numpy from given log odds."""
    r = np.random.default_rng(8)
    size = {("a", "x"): 300, ("a", "y"): 3, ("b", "x"): 1, (None, "x"): 40, ("c", None): 25, ("", ""): 7, ("d", "z"): 120}
    rows = [(k, h, p, float(np.round(r.normal(len(h or "q") - 1.5 * (p == "x"), 2), 6)), float(np.round(r.normal(-2, 1), 6)))
            for k, (h, p) in enumerate(key for key, n in size.items() for _ in range(n))]
    base = {"low": -1.25, "toxic": -3.0}
    sig, logit = (lambda x: 1 / (1 + np.exp(-x))), (lambda p: math.log(p / (1 - p)))

    def strength(rate, parent, n):
        noise = sum(p * (1 - p) for p in parent)
        spread = sum(w * (a - p) ** 2 for a, p, w in zip(rate, parent, n)) - noise
        tau = max(1e-6, spread / (sum(w - 1 for w in n) + 1e-9))
        return max(1.0, sum(w * p * (1 - p) for p, w in zip(parent, n)) / sum(n) / tau - 1)

    want = {}
    for col, head in ((3, "low"), (4, "toxic")):
        paths, hosts = {}, {}
        for row in rows:
            for table, key in ((paths, row[1:3]), (hosts, row[1])):
                n, total = table.get(key, (0, 0.0))
                table[key] = n + 1, total + sig(row[col])
        world = sum(t for _, t in hosts.values()) / len(rows)
        m = strength([t / n for n, t in hosts.values()], [world] * len(hosts), [n for n, _ in hosts.values()])
        of_host = {h: (t + m * world) / (n + m) for h, (n, t) in hosts.items()}
        m = strength([t / n for n, t in paths.values()], [of_host[h] for h, _ in paths], [n for n, _ in paths.values()])
        rate = {k: (t + m * of_host[k[0]]) / (n + m) for k, (n, t) in paths.items()}
        for row in rows:
            want.setdefault(row[0], []).extend((rate[row[1:3]], sig(row[col] - base[head] + logit(rate[row[1:3]]))))

    scored = spark.createDataFrame(rows, "doc_id long, host string, path string, low double, toxic double").repartition(5)
    monkeypatch.setattr(quality, "score", lambda docs, models: scored)
    docs = spark.createDataFrame([(k, h, p, "") for k, h, p, *_ in rows], "doc_id long, source string, lang string, text string")
    got = quality.classify(docs, {h: (np.zeros(1), b) for h, b in base.items()}).collect()
    assert len(got) == len(rows)
    for x in got:
        assert (x.low_rate, x.p_low, x.toxic_rate, x.p_toxic) == pytest.approx(want[x.doc_id], abs=1e-9)
        assert x.keep == (x.p_low < 0.5 and x.p_toxic < 0.5)


# --- 6 ---------------------------------------------------------------------
def test_targets_equal_repeated_sharing(spark):
    sizes = {"a": 10, "b": 1000, "c": 5, None: 300, "d": 0, "e": 7}
    weight = dict(zip(["a", "b", "c", "d", "e", None], [5, 2, 1, 5, 2, 1]))
    target, left, open_ = dict.fromkeys(sizes, 0.0), float(sum(sizes.values())), set(sizes)
    while left > 1e-9 and open_:
        total = sum(weight[s] for s in open_)
        for s in open_:
            target[s] += left * weight[s] / total
        left = sum(max(0, target[s] - 3 * sizes[s]) for s in open_)
        for s in list(open_):
            if target[s] >= 3 * sizes[s]:
                target[s] = 3 * sizes[s]
                open_.discard(s)
    got = {r.source: r.target for r in mixing.source_targets(
        spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()}
    assert got == pytest.approx(target)


def test_positions_follow_the_schedule(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = mixing.mix(docs, rows_per_bucket=7).collect()
    for s in {r.source for r in out}:
        rows = [r for r in out if r.source == s]
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    every = np.sort([p for r in out if r.source == "src0" for p in r.positions])
    assert 0 <= every[0] and every[-1] <= 1
    assert (every < 0.5).mean() > 0.6  # the first sources come early
    again = mixing.mix(docs.repartition(5), rows_per_bucket=7).collect()
    assert sorted((r.doc_id, r.taken) for r in out) == sorted((r.doc_id, r.taken) for r in again)


# --- 7 ---------------------------------------------------------------------
def near_copies(r, groups=12, size=14, words=60):
    out = []
    for g in range(groups):
        base = [f"g{g}w{r.randint(0, 500)}" for _ in range(words)]
        for _ in range(size):
            t = list(base)
            for _ in range(r.randint(0, 4)):
                t[r.randrange(len(t))] = f"n{r.randint(0, 10**6)}"
            out.append(" ".join(t))
    return [(i, t) for i, t in enumerate(r.sample(out, len(out)))]


@pytest.mark.parametrize("shingle,percent,block", [(3, 85, 512), (5, 80, 4)])
def test_components_equal_all_pairs(spark, monkeypatch, shingle, percent, block):
    monkeypatch.setattr(near_dup, "BLOCK", block)  # small blocks: lists and clusters are split
    docs = near_copies(random.Random(shingle))
    sets = []
    for _, t in docs:
        w = t.split()
        sets.append({tuple(w[k:k + shingle]) for k in range(len(w) - shingle + 1)})
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            k = len(sets[a] & sets[b])
            if 100 * k >= percent * (len(sets[a]) + len(sets[b]) - k):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    out = near_dup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), shingle, percent / 100).collect()
    assert {r.doc_id: r.component_id for r in out} == {i: root(i) for i in range(len(docs))}


def test_connected_components(spark):
    r = random.Random(1)
    edges = [(k, k + 1) for k in range(200)] + [(1000 + r.randint(0, 300), 1000 + r.randint(0, 300)) for _ in range(250)]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    out = graph.connected_components(spark.createDataFrame(edges, "u long, v long")).collect()
    assert {x.node: x.component for x in out} == {v: root(v) for v in parent} and len(out) == len(parent)


# --- 8 ---------------------------------------------------------------------
def test_blocks_of_held_out_layouts():
    model = html_blocks.train([])
    r = np.random.default_rng(99)
    right = total = 0
    for _ in range(200):
        text, main = html_blocks.generated_page(r)
        cut = html_blocks.blocks(text)
        label = model.label([cut])[0] > 0.5
        right += sum(bool(p) == (b.text in main) for p, b in zip(label, cut))
        total += len(cut)
    assert right / total > 0.98


def test_pages_give_their_article(spark):
    import html
    out = {r.page_id: r.text for r in html_blocks.op8_html_blocks(spark, SF).collect()}
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        inner = re.sub(r"<[a-zA-Z/][^>]*\Z", "", re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1])
        parts = [re.sub(r"\s+", " ", html.unescape(re.sub("<[^>]*>", "", b))).strip()
                 for b in re.split("</?(?:p|h1|br)[^>]*>", inner)]
        assert out[r.page_id] == " ".join(p for p in parts if p)


# --- 9 ---------------------------------------------------------------------
def test_every_prefix_equals_the_library():
    import public_tokenizers
    from sentencepiece import SentencePieceProcessor

    from affinis.llm.token_counts import counter, total
    model = str(public_tokenizers.path("piece_bpe_32k.model"))
    sp, c, r = SentencePieceProcessor(model_file=model), counter(model), random.Random(1)
    signs = "abcdefgh THE the  \n.,é一😀▁123()%$\x00"
    texts = ["", " ", "<s> <unk>", "a\n\nb", "   x", " " * 40, "日本語 " * 3] + [
        "".join(r.choice(signs) for _ in range(r.randint(1, 40))) for _ in range(800)]
    for t in texts:
        changes = c.prefix_changes(t)
        assert len(changes) == len(t)
        assert [total(changes[:k]) for k in range(len(t) + 1)] == [len(x) for x in sp.encode([t[:k] for k in range(len(t) + 1)])]


# --- 10 --------------------------------------------------------------------
def test_repeats_equal_brute_force(spark):
    r = random.Random(4)
    words = [f"w{k}" for k in range(400)]
    base = [r.choice(words) for _ in range(300)]
    docs = []
    for i in range(60):
        t = []
        for _ in range(r.randint(0, 6)):
            if r.random() < .5:
                a = r.randint(0, 250)
                t += base[a:a + r.randint(5, 50)]
            else:
                t += [r.choice(words) for _ in range(r.randint(0, 40))]
        docs.append((i * 3, r.choice([" ", "\n", "\t ", "  "]).join(t)))
    docs += [(5, None), (9, docs[3][1]), (9, docs[4][1]), (None, " ".join(base)), (500, "a " * 60), (501, "x " + "a " * 19 + "y")]
    cut = [(-1 if i is None else i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in cut:
        for k in range(len(w) - 19):
            s = tuple(w[k:k + 20])
            first[s] = min(first.get(s, (10**9, 0)), (i, k))
    exp = []
    for (i, w), (own, _) in zip(cut, docs):
        gone = {j for k in range(len(w) - 19) if first[tuple(w[k:k + 20])] < (i, k) for j in range(k, k + 20)}
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        exp.append((str(own), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    out = [(str(x.doc_id), x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup.remove_repeats(df).collect()]
    assert sorted(out) == sorted(exp) and sum(e[2] for e in exp) > 500


# --- pipeline --------------------------------------------------------------
def test_pipeline_keeps_what_its_stages_should(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = corpus_pipeline.materialize(stage(spark, docs, SF), "test")
        sizes.append(docs.count())
        texts = {r.doc_id: r.text for r in before.collect()}
        left = {r.doc_id for r in docs.collect()}
        gone = [texts[i] for i in texts if i not in left]
        if name == "MinHash near-dedup":
            sets = {i: {tuple(w[k:k + 5]) for k in range(max(1, len(w) - 4))} for i, t in texts.items() if (w := t.lower().split())}
            for i in left:
                assert all(len(sets[i] & sets[j]) < 0.8 * len(sets[i] | sets[j]) for j in left if j < i)
        if name == "benchmark decontamination":
            marks = [r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            assert not any(m in texts[i] for i in left for m in marks) and gone
        if name == "secret scans":
            assert not any(len(m[1]) >= n for i in left for _, p, n in BASE for m in p.finditer(texts[i])) and gone
    assert sizes[0] > 700 and docs.orderBy("mix_position").count() == sizes[-1]
    assert abs(docs.select("doc_id", "mix_taken").distinct().agg(F.sum("mix_taken")).first()[0]
               - before.select(F.sum(F.size(F.split(F.trim("text"), r"\s+")))).first()[0]) < 50


def test_substring_anchors_are_few_and_shared():
    """A random text has about 2 anchors in 14 positions; equal windows have the same ones wherever they lie."""
    import pyarrow as pa

    sd = substring_dedup
    rng = np.random.default_rng(5)
    words = [f"w{k}" for k in rng.integers(0, 5000, 4000)]
    shared = words[1000:1040]
    texts = [" ".join(words), " ".join(["x", "y", "z", *shared, "q"]), "too short", None, " ".join(["la"] * 60)]
    # a batch each: within one batch a repeated anchor is listed once
    batches = [pa.RecordBatch.from_arrays([pa.array([d]), pa.array([t], pa.string())], names=["doc_id", "text"])
               for d, t in enumerate(texts, 1)]
    out = pa.Table.from_batches(list(sd._anchors(False)(batches))).to_pylist()
    at = {d: {r["p"] >> 1: r["h"] for r in out if r["doc_id"] == d and r["known"] is None} for d in (1, 2, 3, 4, 5)}
    assert len(at[1]) < 0.2 * len(words) and not at[3] and not at[4] and at[5]
    for start in range(len(shared) - sd.WINDOW + 1):
        both = [{p - start - off: h for p, h in at[d].items() if 0 <= p - start - off < sd.PERIOD}
                for d, off in ((1, 1000), (2, 3))]
        assert set(both[0].items()) & set(both[1].items())
