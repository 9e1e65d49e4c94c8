"""Secret scans with multipart credential linking.

Base kinds (``assign``, ``access``, ``hex``) are reported wherever they
match.  Weak kinds prove nothing alone: ``ident`` (an account or key
name), ``weak`` (a random-looking string) and ``endpoint`` (an address).
An interval join within scopes of ``SCOPE`` code points links them: an
identifier is reported beside a secret, a random-looking string beside an
identifier, an endpoint beside both.  A random-looking string that starts
inside an address is part of a path and no secret.

Only DataFrame functions run.  A regular expression marks the matches of a
kind in the text; cutting the text at the marks gives lengths, and running
sums of lengths give code point offsets.  The interval join deals parts to
scope-wide buckets, keeps the first and last start of each class per
bucket, and looks at the bucket and its two neighbours, so a document with
thousands of parts makes no pairs.

Cases: null and empty texts have no spans (digest of the empty string);
rows that repeat an id and a text get equal results, rows that share only
the id their own; control characters U+0001 to U+0003 count as one
character and match nothing; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.session import materialize

SCOPE = 200
#: Kinds in order, patterns (last group: the value) and least lengths of the value.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9+/_.=-]+)""", 8),
    # whole runs, so the least length can stand in the pattern: a run that is too short holds no match either
    ("access", r"()(AKIA[A-Z0-9]{12,})", 16),
    ("hex", r"()([0-9a-f]{32,})", 32),
    ("ident", r"""((?i:user(?:name)?|login|account|client_?id|key_?id)["']?\x20*[:=]\x20*["']?)([A-Za-z0-9@._-]+)""", 3),
    ("weak", r"()((?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2})", 20),
    ("endpoint", r"""((?i:host(?:name)?|endpoint|server)["']?\x20*[:=]\x20*["']?|(?i:https?|jdbc:[a-z]+|postgres(?:ql)?"""
                 r"""|mysql|mongodb|redis|amqps?|s3)://)([A-Za-z0-9@.:/_-]+)""", 4),
)
BASE = ("assign", "access", "hex")
IDENTIFIERS, SECRETS = ("access", "ident"), ("assign", "hex", "weak")
START, VALUE, END = "\x01", "\x03", "\x02"


def _clean(text: Column) -> Column:
    marks = START + VALUE + END
    return F.when(text.rlike(f"[{marks}]"), F.translate(text, marks, "\x04\x04\x04")).otherwise(text)


def _pieces(text: Column, pattern: str) -> Column:
    """(length, end of the match, end of its value) of the text's pieces; only the first one has no match."""
    marked = F.regexp_replace(text, F.lit(pattern), F.lit(f"{START}$1{VALUE}$2{END}"))
    return F.transform(F.split(marked, START), lambda p: F.struct(
        F.length(p).alias("n"), F.instr(p, VALUE).alias("v"), F.instr(p, END).alias("e")))


def find_spans(docs: DataFrame, kinds=KINDS) -> DataFrame:
    """(doc_id, text_key, rank, kind, start, stop) of the matches that are long enough."""
    clean = docs.select("doc_id", F.xxhash64("text").alias("text_key"), _clean(F.col("text")).alias("text")) \
        .where("text <> ''")
    found = clean.select("doc_id", "text_key", F.explode(F.array(*[
        F.struct(F.lit(i).alias("rank"), _pieces(F.col("text"), p).alias("pieces"))
        for i, (_, p, _) in enumerate(kinds)])).alias("_f")) \
        .select("doc_id", "text_key", "_f.rank", "_f.pieces").where(F.size("pieces") > 1) \
        .select("doc_id", "text_key", "rank", F.posexplode("pieces").alias("nth", "_p")) \
        .select("doc_id", "text_key", "rank", "nth", "_p.*").distinct()
    before = Window.partitionBy("doc_id", "text_key", "rank").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    # markers are no characters of the text
    own = F.when(F.col("nth") == 0, F.col("n")).otherwise(F.col("n") - 2)
    least = F.element_at(F.array(*[F.lit(m) for _, _, m in kinds]), F.col("rank") + 1)
    name = F.element_at(F.array(*[F.lit(k) for k, _, _ in kinds]), F.col("rank") + 1)
    return found.withColumn("start", F.sum(own).over(before)) \
        .where((F.col("nth") > 0) & (F.col("e") - F.col("v") - 1 >= least)) \
        .select("doc_id", "text_key", "rank", name.alias("kind"), "start",
                (F.col("start") + F.col("e") - 2).alias("stop"))


def link_parts(spans: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Base spans, and weak ones whose complementary parts start within ``scope``."""
    so_far = Window.partitionBy("doc_id", "text_key").orderBy("start", "rank").rowsBetween(Window.unboundedPreceding, 0)
    address = F.last(F.when(F.col("kind") == "endpoint", F.col("stop")), ignorenulls=True).over(so_far)
    spans = spans.withColumn("_address", F.coalesce(address, F.lit(0))) \
        .where((F.col("kind") != "weak") | (F.col("_address") <= F.col("start"))).drop("_address")
    place = F.floor(F.col("start") / scope)
    spans = spans.withColumn("bucket", place)
    classes = {"i": F.col("kind").isin(*IDENTIFIERS), "s": F.col("kind").isin(*SECRETS)}
    ends = [f(F.when(is_in, F.col("start"))).alias(f"{c}_{n}")
            for c, is_in in classes.items() for n, f in (("first", F.min), ("last", F.max))]
    buckets = spans.groupBy("doc_id", "text_key", "bucket").agg(*ends)
    # what lies before, in and after a bucket
    near = buckets.withColumn("_step", F.explode(F.array(F.lit(-1), F.lit(0), F.lit(1))))
    about = near.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"),
                         (F.col("bucket") + F.col("_step")).alias("_bucket")).agg(*[
        F.max(F.when(F.col("_step") == step, F.col(f"{c}_{n}"))).alias(f"{c}_{name}")
        for c in classes for step, n, name in ((1, "last", "before"), (0, "first", "here"), (-1, "first", "after"))])
    weak = spans.where(~F.col("kind").isin(*BASE))
    linked = weak.join(about, weak["doc_id"].eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
                       & (F.col("bucket") == F.col("_bucket")))

    def beside(c: str) -> Column:
        return F.coalesce(F.col(f"{c}_here").isNotNull() | (F.col(f"{c}_before") >= F.col("start") - scope)
                          | (F.col(f"{c}_after") <= F.col("start") + scope), F.lit(False))

    kept = linked.where(
        ((F.col("kind") == "ident") & beside("s")) | ((F.col("kind") == "weak") & beside("i"))
        | ((F.col("kind") == "endpoint") & beside("s") & beside("i")))
    columns = ["doc_id", "text_key", "rank", "kind", "start", "stop"]
    return spans.where(F.col("kind").isin(*BASE)).select(columns).unionByName(kept.select(columns))


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, text_key, n_assign, n_access, n_hex, spans) per document.

    ``spans`` holds (start, rank, stop, kind) in order; ``text_key`` tells
    rows apart that share an id.
    """
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    spans = link_parts(materialize(find_spans(docs), "spans"))
    count = lambda kind: F.count(F.when(F.col("kind") == kind, 1)).alias(f"n_{kind}")
    found = spans.groupBy(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")).agg(
        *[count(k) for k in BASE], F.sort_array(F.collect_list(F.struct("start", "rank", "stop", "kind"))).alias("spans"))
    keys = docs.select("doc_id", F.xxhash64("text").alias("text_key"))
    out = keys.join(found, keys["doc_id"].eqNullSafe(found["_id"]) & (keys["text_key"] == found["_key"]), "left")
    none = F.array().cast(found.schema["spans"].dataType)
    return out.select("doc_id", "text_key", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in BASE],
                      F.coalesce("spans", none).alias("spans"))


def _joined(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["stop"])), ",")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(_joined(base), 256).alias("base_sha256"),
                        _joined(F.col("spans")).alias("spans"))


def _kinds_sql() -> str:
    """The kinds as SQL rows; the look-ahead of ``weak`` becomes a test of the match."""
    plain = {"weak": "()([A-Za-z0-9+/_-]{20,}={0,2})"}
    quoted = lambda t: "'" + t.replace("'", "''") + "'"
    return ", ".join(f"({i}, '{k}', {quoted(plain.get(k, p))}, {least})" for i, (k, p, least) in enumerate(KINDS))


OP1_SQL = f"""
WITH k(rank, kind, pat, least) AS (VALUES {_kinds_sql()}),
m AS (SELECT doc_id, rank, kind, least, string_split(regexp_replace(
        translate(coalesce(text, ''), chr(1) || chr(2) || chr(3), chr(4) || chr(4) || chr(4)), pat,
        chr(1) || '\\1' || chr(3) || '\\2' || chr(2), 'g'), chr(1)) AS ps FROM documents, k),
p AS (SELECT doc_id, rank, kind, least, i, ps[i] AS p FROM (SELECT *, unnest(range(1, len(ps) + 1)) AS i FROM m)),
s AS (SELECT *, instr(p, chr(3)) AS v, instr(p, chr(2)) AS e,
        sum(CASE WHEN i = 1 THEN length(p) ELSE length(p) - 2 END) OVER (
          PARTITION BY doc_id, rank ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start FROM p),
f0 AS (SELECT doc_id, rank, kind, CAST(start AS BIGINT) AS start, CAST(start + e - 2 AS BIGINT) AS stop FROM s
      WHERE i > 1 AND e - v - 1 >= least AND (kind <> 'weak' OR (
        regexp_matches(substr(p, v + 1, e - v - 1), '[0-9]') AND regexp_matches(substr(p, v + 1, e - v - 1), '[A-Z]')
        AND regexp_matches(substr(p, v + 1, e - v - 1), '[a-z]')))),
f AS (SELECT * FROM f0 WHERE kind <> 'weak' OR NOT EXISTS (
        SELECT 1 FROM f0 o WHERE o.doc_id = f0.doc_id AND o.kind = 'endpoint' AND o.start <= f0.start AND o.stop > f0.start)),
g AS (SELECT *, EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.kind IN ('access', 'ident')
                        AND abs(o.start - f.start) <= {SCOPE}) AS near_i,
             EXISTS (SELECT 1 FROM f o WHERE o.doc_id = f.doc_id AND o.kind IN ('assign', 'hex', 'weak')
                     AND abs(o.start - f.start) <= {SCOPE}) AS near_s FROM f),
h AS (SELECT *, kind || ':' || start || ':' || stop AS t FROM g
      WHERE rank <= 2 OR (kind = 'ident' AND near_s) OR (kind = 'weak' AND near_i) OR (kind = 'endpoint' AND near_i AND near_s)),
a AS (SELECT doc_id, count(*) FILTER (WHERE rank = 0) AS n_assign, count(*) FILTER (WHERE rank = 1) AS n_access,
             count(*) FILTER (WHERE rank = 2) AS n_hex,
             string_agg(t, ',' ORDER BY start, rank) FILTER (WHERE rank <= 2) AS base,
             string_agg(t, ',' ORDER BY start, rank) AS spans FROM h GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN a ON d.doc_id = a.doc_id
"""
