"""URL rules against every rule tried on every url."""

import random

import pytest
from pyspark.sql import functions as F

from affinis.llm import url_filters

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    n = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    m = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return rest[:n].translate(LOWER), rest[n:max(n, m)]


def verdict(url, rules, default):
    host, path = parts(url)
    fits = []
    for action, h, p in rules:
        h, p = (h or "").translate(LOWER), p or ""
        if (not h or host == h or host.endswith("." + h)) and path.startswith(p):
            fits.append((len(h + p), len(h), action, h + p))
    return (host, path, max(fits)[3], max(fits)[2]) if fits else (host, path, None, default)


def run(spark, urls, rules, default="allow"):
    rows = [(i % 7 or None, u) for i, u in enumerate(urls)]
    names = ("host", "path", "rule", "verdict", "at", "kind", "item", "level", "low", "point", "_part")
    pages = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit(1) for c in names}).repartition(3)
    table = spark.createDataFrame(rules, "action string, host string, path string")
    out = url_filters.judge(pages, table, default)
    assert out.columns == ["page_id", "host", "path", "rule", "verdict"]
    key = lambda r: tuple((x is None, x if x is not None else "") for x in r)
    got = sorted((tuple(r) for r in out.collect()), key=key)
    assert got == sorted(((i, *verdict(u, rules, default)) for i, u in rows), key=key)
    return got


def some_rules(r, hosts, paths, n):
    return [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(paths)) for _ in range(n)]


@pytest.mark.parametrize("seed", range(3))
def test_equals_brute_force(spark, seed):
    r = random.Random(seed)
    hosts = ["com", "example.com", "a.example.com", "b-a.example.com", "xample.com", "com.example", "EXAMPLE.org", "org",
             "é.org", "a-b.com", "b.com", "b.com.", ".com", "a..com", ""]
    paths = ["", "/", "/e", "/es", "/es/", "/es/1", "/es/11", "/é", "/es/1/2/3", "/z~", "/ES/"]
    urls = [None, "", "no scheme", "://", "x://", "x://a://b/c", "http://com", "http://com?x=/es/", "http://com#/es/",
            "http://u@example.com:80/es/", "http://Example.COM/es/\n1?y", "http://b.com\u0130/es/", "http://example.com/" + "x" * 5000]
    urls += ["http://" + "a." * 3000 + "com/es/"]
    urls += [f"http://{r.choice(['', 'www.', 'a.', 'b-a.'])}{r.choice(hosts)}{r.choice(paths)}{r.choice(['', '1', '?q', '#f'])}"
             for _ in range(600)]
    run(spark, urls, some_rules(r, hosts, paths, 60))


def test_deep_nests_span_ranges(spark):
    """Every label and every letter of a path has a rule; one host has most urls."""
    labels = [f"l{i}" for i in range(12)]
    rules = [("block" if i % 2 else "allow", ".".join(labels[-i:]), "/") for i in range(1, 13)]
    rules += [("block" if i % 3 else "allow", "l11", "/" + "a" * i) for i in range(40)]
    rules += [("allow", None, "/" + "a" * 60), ("block", "", None)]
    urls = [f"http://{'.'.join(labels[-(i % 13):] if i % 13 else ['zz'])}/{'a' * (i % 70)}{i if i % 4 else ''}" for i in range(1500)]
    urls += [f"http://l11/{i}" for i in range(1500)] + ["http://l11/same"] * 500
    run(spark, urls, rules)


def test_cases(spark):
    assert run(spark, ["http://a.com/x", None], [])[0][3] is None
    assert run(spark, [], [("block", "com", "/")]) == []
    got = run(spark, ["http://a.com/x"] * 3, [("allow", "com", "/x"), ("block", "com", "/x"), ("block", "COM", "/")], "block")
    assert {r[3:] for r in got} == {("com/x", "block")} and len(got) == 3
    # equal lengths: the longer host
    assert run(spark, ["http://a.com/xyz"], [("allow", "a.com", "/x"), ("block", "com", "/xyz")])[0][3:] == ("a.com/x", "allow")
    assert run(spark, ["http://com"], [("allow", "com", "/")])[0][3:] == (None, "allow")


def test_no_python_and_no_all_pairs(spark):
    pages = spark.createDataFrame([(1, "http://a.org/es/")], "page_id long, url string")
    plan = url_filters.judge(pages, url_filters.rule_table(spark))._jdf.queryExecution().toString()
    for word in ("Python", "Arrow", "CartesianProduct", "NestedLoop"):
        assert word not in plan
