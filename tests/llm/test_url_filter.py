from __future__ import annotations

import pytest
from pyspark.sql import types as T

from turnwise.llm import url_filter as U
from turnwise.llm.common import prepare

PAGES = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("host", T.StringType()), T.StructField("n", T.IntegerType())])


@pytest.fixture
def pages(spark):
    prepare(spark)
    return lambda rows: spark.createDataFrame([(*r, "clash", 1) for r in rows], PAGES).repartition(2)


@pytest.mark.parametrize(
    ("url", "host", "path", "rule", "action"),
    [
        ("http://A.Example.NET/en/x?q#f", "a.example.net", "/en/x", "example.net/en/", "allow"),
        ("http://example.net/de/", "example.net", "/de/", "net/", "block"),
        ("http://myexample.net/en/", "myexample.net", "/en/", "net/", "block"),
        ("https://x.example.com/de/1", "x.example.com", "/de/1", "example.com/de/", "block"),
        ("https://x.example.com/en/1", "x.example.com", "/en/1", None, None),
        ("http://a.org/fr/1", "a.org", "/fr/1", "org/fr/", "allow"),
        ("http://a.net?x", "a.net", "", None, None),
        ("no scheme", "", "", None, None), (None, "", "", None, None), ("", "", "", None, None), ("http://", "", "", None, None),
        ("http://h/p\nq?r://z", "h", "/p\nq", None, None),
    ],
)
def test_rules(pages, url, host, path, rule, action):
    row = U.matched(pages([(1, url, "")])).first()
    assert (row.host, row.path, row.rule, row.action) == (host, path, rule, action)


def test_edges(pages):
    html = "<a href='/x'>1</a><A class=b HREF=\"HTTP://B.com/y\">2</a><a href=//c.com>3</a><a href=mailto:x@y.z>4</a><a href='/z'>"
    got = {(r.src, r.dst, r.links) for r in U.host_edges(pages([(1, "http://a.com/", html), (2, None, html), (3, "http://a.com/", None)])).collect()}
    assert got == {("a.com", "b.com", 1), ("a.com", "c.com", 1)}


def brute(edges, trust, distrust):
    out = {}
    for a, b, n in edges:
        out.setdefault(a, []).append((b, n))
    part = {a: [(b, n / sum(k for _, k in to)) for b, n in to] for a, to in out.items()}
    forward = [dict(trust), dict.fromkeys(trust, 1.0)]
    seeds, back = [trust, dict.fromkeys(trust, 1.0)], dict(distrust)
    for _ in range(U.ROUNDS):
        forward = [{h: (1 - U.DAMPING) * s[h] + U.DAMPING * sum(f[a] * p for a, to in part.items() for b, p in to if b == h) for h in s} for f, s in zip(forward, seeds, strict=True)]
        back = {h: max(distrust[h], U.DAMPING * sum(p * back[b] for b, p in part.get(h, []))) for h in distrust}
    return *forward, back


def test_ranks_equal_brute_force(spark):
    edges = [("a", "b", 3), ("b", "c", 1), ("b", "d", 2), ("c", "a", 1), ("d", "a", 5), ("d", "c", 1)]
    seeds = [(h, float(h == "a"), {"c": 1.0, "d": 0.25}.get(h, 0.0)) for h in "abcde"]
    got = {r.host: r for r in U.propagate(spark.createDataFrame(edges, "src string, dst string, links long"), spark.createDataFrame(seeds, "host string, trust double, distrust double"), "test").collect()}
    trust, plain, distrust = brute(edges, {h: t for h, t, _ in seeds}, {h: d for h, _, d in seeds})
    for h in "abcde":
        assert (got[h].trust, got[h].plain, got[h].distrust) == pytest.approx((trust[h], plain[h], distrust[h]))


def test_farms_of_every_size_are_blocked_and_single_links_are_not(pages):
    """Farms of 1 to 100 hosts that link to one blocked host each; half of all other hosts are blocked; own links do not dilute."""
    link = lambda to: f"<a href='http://{to}/'>x</a>"
    own, rows, farm, neutral, page = "<a href='/x'>x</a>" * 20, [], [], [], 0
    for size in (1, 2, 10, 100):
        rows.append((page := page + 1, f"http://b{size}.net/", own))
        for k in range(size):
            farm.append(page := page + 1)
            rows.append((page, f"http://f{k}.farm{size}.com/", own + link(f"b{size}.net")))
    for k in range(9):
        neutral.append(page := page + 1)
        rows.append((page, f"http://n{k}.info/", own + link("b1.net") + "".join(link(f"n{j}.info") for j in range(9))))
    rows += [(1000 + k, f"http://spam{k}.net/", link(f"n{k % 9}.info")) for k in range(100)]
    got = {r.id: r.verdict for r in U.judged(pages(rows), "test").collect()}
    assert {got[i] for i in farm} == {"block"} and {got[i] for i in neutral} == {"allow"}


def test_distrust_reaches_hosts_that_link_to_blocked_ones(pages):
    link = lambda to: f"<a href='http://{to}/'>x</a>"
    rows = [(i, f"http://spam{i}.net/", "") for i in range(3)]
    rows += [(10, "http://farm.example.com/x", "".join(link(f"spam{i}.net") for i in range(3)) * 5)]
    rows += [(20 + i, f"http://good{i}.org/fr/", link(f"good{(i + 1) % 9}.org")) for i in range(9)]
    rows += [(40, "http://quiet.com/", link("good1.org")), (41, None, None), (41, None, None)]
    got = {r.id: r.verdict for r in U.judged(pages(rows), "test").collect()}
    assert got[10] == "block" and got[40] == "allow" and got[41] == "allow" and got[0] == "block" and got[20] == "allow"


def test_empty_table(pages):
    assert U.judged(pages([]), "test").count() == 0


def test_no_python_in_the_plan(pages):
    plan = U.judged(pages([(1, "http://a.net/", "<a href='/x'>")]), "test")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
