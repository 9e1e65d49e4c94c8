"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing column names for every operator."""

import hashlib

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from affinis.llm import (decontamination, fingerprints, html_blocks, mixing, near_dup, quality, secrets,
                         substring_dedup, token_counts, warc)

LONG = " ".join(f"word{i % 977}" for i in range(60_000))
ROWS = [
    (1, "a short text of a few words", "en", "s1"), (1, "a short text of a few words", "en", "s1"),
    (1, "the same id with another text", "en", "s1"), (2, None, None, None), (3, "", "en", "s1"), (4, " \n\t ", "", ""),
    (None, "a null id with a text of its own", "de", "s2"), (None, None, None, None), (5, LONG, "en", "s1"),
    (6, LONG + " more", "en", None), (7, "\x00\x01\x02\x03 é 😀 ▁", "fr", "s3"), (8, "x" * 50_000, "en", "s1"),
]
#: Names that the operators use inside.
CLASH = ("range", "nth", "copy", "h", "p", "known", "size", "target", "token", "n", "rank", "kind", "side", "term",
         "html_", "text_key", "component", "cid", "low", "toxic", "host", "path", "_id", "_key", "position")


def table(spark, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    return df.withColumn("n_chars", F.length("text").cast("long")).withColumns({c: F.lit(9) for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark):
    return table(spark, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return table(spark, [])


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1, 0), (3, None, 0), (5, 0, 1), (None, 1, 1), (99, 1, 0)],
                                 "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def model():
    import public_tokenizers
    return str(public_tokenizers.path("piece_bpe_32k.model"))


def items(spark):
    return spark.createDataFrame([(1, "text of its own"), (1, "text of its own"), (2, None), (3, ""), (4, "Short!"),
                                  (None, "a few words")], "item_id long, text string").withColumn("doc_id", F.lit(1))


def both(call, docs, none):
    """Rows of the cases, after the empty table went through."""
    assert call(none).count() == 0
    return call(docs).collect()


def test_secrets(docs, none):
    out = both(secrets.scan, docs, none)
    assert len(out) == len(ROWS) and all(not r.spans for r in out)


def test_fingerprints(docs, none):
    out = both(fingerprints.fingerprints, docs, none)
    assert sorted((r.doc_id or 0, r.n_chars) for r in out) == sorted((i or 0, len(t or "")) for i, t, *_ in ROWS)
    empty = [r for r in out if not r.fingerprint]
    assert {r.doc_id for r in empty} == {2, 3, 4, None} and len(empty) == 4
    twins = [r.fingerprint for r in out if r.doc_id == 1 and r.n_chars == 27]
    assert len(twins) == 2 and len(set(twins)) == 1


def test_decontamination(spark, docs, none):
    assert decontamination.contaminated(docs, items(spark).where("false")).count() == 0
    out = both(lambda d: decontamination.contaminated(d, items(spark)), docs, none)
    got = sorted((r.doc_id or 0, r.item_id or 0) for r in out)
    # a repeated document gives its rows again; the two equal items are two items
    assert got == [(0, 1), (0, 1), (1, 0), (1, 0), (1, 4), (1, 4)]


def test_warc(spark, tmp_dir):
    rows = [(1, "u", "<p>" + "x" * 200), (1, "u", "<p>" + "x" * 200), (2, None, "<p>" + "x" * 200), (3, "a\r\nb", None),
            (None, "n", "<p>" + "y" * 200), (4, "u", ""), (5, "u", "tiny"), (6, "u", "tiny"), (7, "u", "é😀" * 5000)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("value", F.lit(1))
    warc.write_archives(pages, f"{tmp_dir}/w", chunk_chars=1000)
    out = warc.read_records(spark, f"{tmp_dir}/w").collect()
    got = sorted((r.page_id or "", r.payload_bytes, r.payload_digest, r.record_type, r.refers_to or "") for r in out)
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    exp = sorted((str(i or ""), len((h or "").encode()), sha(h), "revisit" if i == 2 else "response", "1" if i == 2 else "")
                 for i, _, h in rows)
    assert got == exp
    warc.write_archives(pages.where("false"), f"{tmp_dir}/e")
    assert warc.read_records(spark, f"{tmp_dir}/e").count() == 0


def test_quality(docs, none, labels):
    models = quality.train(docs, labels)
    out = both(lambda d: quality.classify(d, models), docs, none)
    assert len(out) == len(ROWS) and all(0 <= r.p_low <= 1 and r.keep is not None for r in out)
    w, base = quality.train(docs, labels.where("false"))["low"]
    assert not w.any() and base == 0


def test_mixing(docs, none):
    out = both(mixing.mix, docs, none)
    assert len(out) == len(ROWS)
    assert all(r.taken == 0 and not r.positions for r in out if r.size == 0)
    assert all(r.taken <= 3 * r.size for r in out)


def test_near_duplicates(docs, none):
    out = both(near_dup.near_duplicates, docs, none)
    assert len(out) == len(ROWS)
    of = {(r.doc_id, r.n_shingles): r.component_id for r in out}
    long = next(r.component_id for r in out if r.doc_id == 6)
    assert long == 5 and all(of[i, 0] == i for i in (2, 3, 4))


def test_html(spark):
    rows = [(1, "u", "<p>one<b>two</b> three &amp &lt;x&gt;<p>four"), (1, None, None), (None, "u", ""),
            (2, "u", "<div><script>var a='</p>'"), (3, "u", "<p>" + "long text " * 30_000), (4, "u", "a < b <p"),
            (5, "u", "<table><tr><td>x<td>y</table><textarea><p>no</textarea>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit(1))
    out = html_blocks.extract(pages).collect()
    assert len(out) == len(rows) and all(r.n_chars == len(r.text) for r in out)
    assert html_blocks.extract(pages.where("false")).count() == 0
    assert [b.text for b in html_blocks.blocks(rows[0][2])] == ["onetwo three & <x>", "four"]
    assert [b.text for b in html_blocks.blocks("a < b <p")] == ["a < b"]
    assert [b.text for b in html_blocks.blocks(rows[6][2])] == ["x", "y"]


def test_token_counts(docs, none, model):
    from sentencepiece import SentencePieceProcessor
    sp = SentencePieceProcessor(model_file=model)
    out = both(lambda d: token_counts.document_token_counts(d, model, 4096), docs, none)
    assert sorted((r.doc_id or 0, r.n_bytes, r.n_tokens) for r in out) == sorted(
        (i or 0, len((t or "").encode()), len(sp.encode(t or ""))) for i, t, *_ in ROWS)
    kept = token_counts.prefix_token_counts(docs, model).select(
        "text", token_counts.token_total("prefix_changes").alias("all"),
        token_counts.tokens_at("prefix_changes", F.lit(10)).alias("ten"),
        token_counts.longest_prefix("prefix_changes", F.lit(3)).alias("fits")).collect()
    for r in kept:
        t = r.text or ""
        assert r.all == len(sp.encode(t)) and r.ten == len(sp.encode(t[:10]))
        assert len(sp.encode(t[:r.fits])) <= 3


def test_substring(docs, none):
    out = both(substring_dedup.remove_repeats, docs, none)
    assert len(out) == len(ROWS)
    gone = {r.doc_id: (r.n_words, r.n_removed) for r in out}
    assert gone[6] == (60_001, 60_000) and gone[2] == (0, 0)
    assert gone[5][1] == 60_000 - 977


def test_pipeline(spark, docs, none, labels, tmp_dir):
    labels.write.parquet(f"{tmp_dir}/labels.parquet")
    items(spark).write.parquet(f"{tmp_dir}/benchmark.parquet")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, tmp_dir).count() == 0, name
        out = stage(spark, docs, tmp_dir)
        assert out.columns[:len(docs.columns)] == docs.columns, name
        assert out.select("doc_id", "text").distinct().count() <= len(ROWS) - 1
    near = {(r.doc_id, r.text) for r in corpus_pipeline.minhash_neardup(spark, docs, tmp_dir).collect()}
    assert near == {(i, t) for i, t, *_ in ROWS if i != 6}
    # items of fewer than five words drop no document
    assert corpus_pipeline.benchmark_decontamination(spark, docs, tmp_dir).count() == len(ROWS)


def test_pipeline_drops_by_passages_only(spark, docs, tmp_dir):
    texts = ["yes", "in the year", "A short TEXT, of a few words!", None, ""]
    spark.createDataFrame(list(enumerate(texts)), "item_id long, text string").write.parquet(f"{tmp_dir}/benchmark.parquet")
    more = table(spark, [(50, "Yes, that was in the year 1999 they said", "en", "s1"), (51, "yes", "en", "s1")])
    left = [(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, docs.unionByName(more), tmp_dir).collect()]
    assert len(left) == len(ROWS) and {50, 51} <= {i for i, _ in left}
    assert (1, ROWS[2][1]) in left and (1, ROWS[0][1]) not in left
