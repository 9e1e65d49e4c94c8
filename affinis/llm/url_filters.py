"""URL rules by a sort-merge range join over reversed-host keys.

A rule is an action, a host and a path; it fits its host and all
subdomains, if the url's path starts with the rule's path.  Written with
its labels reversed, "org.example.", a host is a prefix of all its
subdomains, so a rule's host is an interval of keys and intervals nest.
Urls and the two ends of every interval are sorted together by range, and
a sweep keeps the stack of open intervals: the depth is a running sum of
the ends, and the entry of a level is the last interval that opened there.
An interval that spans several ranges is opened anew at the start of each.

Two sweeps find the rules.  The first gives a url the rule hosts above it;
its key goes on with the path, so that a host with a third of all urls is
spread over ranges.  In the second a key is a rule host with the url's
path, intervals are the rules, and the top of the stack is the longest
path.  Rules are never all joined to a url: it meets the hosts above it
and one rule of each.

Only DataFrame functions are used.  Equal urls are judged once.  Keys are
compared as bytes; 0xFE and 0xFF, which UTF-8 never has, end them.

Cases: a null url or one without "://" has an empty host and path; an
empty rule host fits every url; null parts of rules are empty; of rules
with equal host and path block wins, of rules of equal length that with
the longer host; without rules every url gets the default verdict;
repeated rows and null ids are judged row by row; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from affinis.session import materialize

#: Fixed rules of the query: action, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)
DEFAULT = "allow"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_OPEN, _CLOSE, _POINT = 0, 1, 2


def url_host(url: Column) -> Column:
    return F.translate(F.coalesce(F.regexp_extract(url, URL, 1), F.lit("")), UPPER, LOWER)


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, URL, 2), F.lit(""))


def host_key(host: Column) -> Column:
    """Labels from the last to the first, each closed by a dot; the empty rule host is above all."""
    return F.concat(F.array_join(F.reverse(F.split(host, r"\.")), "."), F.lit("."))


def rule_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(host_key(host))


def _bytes(*parts: Column) -> Column:
    return F.concat(*[p.cast("binary") for p in parts])


def open_intervals(points: DataFrame, prefixes: DataFrame, innermost: bool = False) -> DataFrame:
    """Sorted sweep: the prefixes that a key starts with, one row each.

    ``points`` has ``at`` (binary, best without repeats) and ``point``;
    ``prefixes`` has ``low`` (binary, each once) and ``item``.  Returns
    (point, level, item), level 1 for the shortest prefix; with
    ``innermost`` the longest prefix only.
    """
    opened = prefixes.select(F.col("low").alias("at"), F.lit(_OPEN).alias("kind"), "low", "item")
    closed = prefixes.select(_bytes(F.col("low"), F.lit(bytearray([255]))).alias("at"), F.lit(_CLOSE).alias("kind"),
                             "low", "item")
    asked = points.select("at", F.lit(_POINT).alias("kind"), "point")
    placed = opened.unionByName(closed).unionByName(asked, allowMissingColumns=True) \
        .repartitionByRange("at", "kind").withColumn("_part", F.spark_partition_id())
    placed = materialize(placed, "url-sweep").withColumn("_again", F.lit(1))

    # an interval that is open where a range starts is opened there again, outer ones first
    part = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("_part")))
    spans = placed.where(F.col("kind") != _POINT).groupBy("low").agg(
        part(_OPEN).alias("_a"), part(_CLOSE).alias("_b"), F.first("item").alias("item")).where("_b > _a")
    again = spans.select(F.col("low").alias("at"), F.lit(_OPEN).alias("kind"), "low", "item",
                         F.explode(F.sequence(F.col("_a") + 1, F.col("_b"))).alias("_part"), F.lit(0).alias("_again"))
    order = ["_again", "at", "kind"]
    step = F.when(F.col("kind") == _OPEN, 1).when(F.col("kind") == _CLOSE, -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("_part").orderBy(*order)
                             .rowsBetween(Window.unboundedPreceding, Window.currentRow)).cast("int")
    rows = placed.unionByName(again, allowMissingColumns=True).withColumn("_depth", depth) \
        .where((F.col("kind") != _CLOSE) & (F.col("_depth") > 0))
    own = F.array("_depth")
    if not innermost:
        own = F.when(F.col("kind") == _POINT, F.sequence(F.lit(1), F.col("_depth"))).otherwise(own)
    rows = rows.withColumn("level", F.explode(own))
    entry = F.last(F.when(F.col("kind") == _OPEN, F.col("item")), ignorenulls=True).over(
        Window.partitionBy("_part", "level").orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.withColumn("item", entry).where(F.col("kind") == _POINT).select("point", "level", "item")


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    return spark.createDataFrame(list(rules), "action string, host string, path string")


def judge(pages: DataFrame, rules: DataFrame, default: str = DEFAULT, url: str = "url",
          keep: tuple[str, ...] = ("page_id",)) -> DataFrame:
    """(kept columns, host, path, rule, verdict) per row of ``pages``.

    ``rules`` has action (allow or block), host and path.  The longest
    fitting rule wins; without one ``rule`` is null and the verdict is
    ``default``.
    """
    text = F.col(url).cast("string")
    named = pages.select(*keep, url_host(text).alias("host"), url_path(text).alias("path"))
    keys = named.select("host", "path").distinct()

    empty = lambda c: F.coalesce(F.col(c), F.lit(""))
    rules = rules.select("action", F.translate(empty("host"), UPPER, LOWER).alias("host"), empty("path").alias("path")) \
        .groupBy("host", "path").agg(F.max("action").alias("action")) \
        .withColumn("_key", rule_key(F.col("host")))
    hosts = rules.select(_bytes(F.col("_key")).alias("low"), F.struct("_key").alias("item")).distinct()
    above = open_intervals(
        keys.select(_bytes(host_key(F.col("host")), F.col("path")).alias("at"), F.struct("host", "path").alias("point")),
        hosts)

    at = _bytes(F.col("item._key"), F.lit(bytearray([254])), F.col("point.path"), F.lit(bytearray([254])),
                F.col("point.host"))
    whole = F.concat("host", "path")
    by_path = rules.select(_bytes(F.col("_key"), F.lit(bytearray([254])), F.col("path")).alias("low"), F.struct(
        F.length(whole).alias("n"), F.length("host").alias("h"), "action", whole.alias("rule")).alias("item"))
    best = open_intervals(above.select(at.alias("at"), "point"), by_path, innermost=True) \
        .groupBy("point").agg(F.max("item").alias("_best")) \
        .select(F.col("point.host").alias("_host"), F.col("point.path").alias("_path"), "_best")
    return named.join(best, (F.col("host") == F.col("_host")) & (F.col("path") == F.col("_path")), "left").select(
        *keep, "host", "path", F.col("_best.rule").alias("rule"),
        F.coalesce(F.col("_best.action"), F.lit(default)).alias("verdict"))


def op11_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), rule_table(spark))


OP11_SQL = r"""
WITH rules(action, host, path) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'),
  ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (SELECT page_id, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), ''),
               'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
             coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
m AS (SELECT u.page_id, u.host, u.path, concat(r.host, r.path) AS rule, r.action, row_number() OVER (
        PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.host) + length(r.path) DESC, length(r.host) DESC) AS nth
      FROM u LEFT JOIN rules r ON (u.host = r.host OR ends_with(u.host, concat('.', r.host)))
                              AND starts_with(u.path, r.path))
SELECT page_id, host, path, CASE WHEN action IS NOT NULL THEN rule END AS rule, coalesce(action, 'allow') AS verdict
FROM m WHERE nth = 1
"""
