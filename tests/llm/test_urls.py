from collections import Counter

import pytest

from climspark.llm import urls as op

URLS = [
    (1, "https://www.Example.com/en/x?a#b"), (2, "http://blog.example.com/en/"), (3, "http://example.com/en"), (4, "http://a.com"),
    (5, "http://a.com/"), (6, "http://b.net/es/1"), (7, "http://b.net/de/1"), (8, "http://c.net/fr/?x"), (9, "ftp://xexample.com/en/"),
    (10, None), (11, "no scheme/path"), (12, "http://?q"), (13, "://h/p://q"), (14, "http://net/es/"), (15, "http://d.org/es/"), (6, "http://b.net/es/1"),
]


def brute(url):
    host, path = "", ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut])
        rest = rest[cut:]
        path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [(v, h + p) for v, h, p in op.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    verdict, rule = max(fits, key=lambda f: len(f[1]), default=(None, None))
    return host, path, rule, verdict


def test_rules_against_brute_force(spark):
    pages = spark.createDataFrame([(i, u, None) for i, u in URLS], "page_id long, url string, html string")
    got = op.op2_urls(pages).collect()
    assert len(got) == len(URLS)
    for r in got:
        host, path, rule, verdict = brute(dict(URLS)[r.page_id])
        assert (r.host, r.path, r.rule) == (host, path, rule)
        assert r.verdict == (verdict or ("block" if r.distrust > r.trust else "allow"))
    verdicts = {r.page_id: r.verdict for r in got}
    assert verdicts[7] == "block" and verdicts[15] == "allow" and verdicts[10] == "allow"


def brute_rank(edges, seeds, rounds=op.ROUNDS):
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    mass = dict(seeds)
    for _ in range(rounds):
        got = Counter()
        for (a, b), n in edges.items():
            got[b] += op.DAMPING * mass.get(a, 0) * n / out[a]
        kept = sum(got.values())
        mass = {h: got[h] + seeds.get(h, 0) * (1 - kept) for h in {*got, *seeds}}
    return mass


def test_ranks_against_brute_force(spark):
    edges = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("a", "d"): 1, ("e", "a"): 5}
    seeds = {"a": 0.75, "e": 0.25}
    got = op.personalised_rank(
        spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"),
        spark.createDataFrame(list(seeds.items()), "host string, seed double"),
    )
    got = {r.host: r.mass for r in got.collect()}
    want = {h: m for h, m in brute_rank(edges, seeds).items() if m > 0}
    assert set(got) == set(want) and all(got[h] == pytest.approx(want[h], abs=1e-9) for h in want)


def test_links_carry_trust_and_distrust(spark):
    rows = [
        (1, "http://good.com/", '<a href="http://liked.org/x">x</a> <a HREF=\'/own\'>y</a> <a href="//Other.org">z</a>'),
        (2, "http://bad.net/es/", "<p>none</p>"),
        (3, "http://spam.org/", '<a href="http://bad.net/es/1">x</a><a href="http://bad.net/">y</a>'),
        (4, "http://liked.org/", None),
        (5, "http://other.org/", ""),
        (6, "http://lone.org/", "<a href='#top'>t</a>"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    assert {(r.src, r.dst, r.n) for r in op.host_edges(pages).collect()} == {
        ("good.com", "liked.org", 1), ("good.com", "other.org", 1), ("spam.org", "bad.net", 2)
    }
    got = {r.page_id: r for r in op.filter_urls(pages).collect()}
    assert [got[i].verdict for i in range(1, 7)] == ["allow", "block", "block", "allow", "allow", "allow"]
    assert got[4].trust > 0 == got[6].trust and got[3].distrust > 0


def test_no_python_on_the_main_path(spark):
    pages = spark.createDataFrame([(i, u, "") for i, u in URLS], "page_id long, url string, html string")
    plan = op.op2_urls(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_clashing_and_empty(spark):
    schema = "page_id long, url string, html string, host string, rule int, verdict string, src string"
    pages = spark.createDataFrame([(1, "http://a.com/", "", "x", 1, "y", "z")], schema)
    assert op.op2_urls(pages).first().verdict == "allow"
    assert op.op2_urls(pages.limit(0)).count() == 0


def brute_rest(edges, seeds, damping):
    """The fixed point: rounds until no mass changes by more than 1e-13 of itself."""
    out = Counter()
    for (a, _), n in edges.items():
        out[a] += n
    mass = dict(seeds)
    while True:
        got = Counter()
        for (a, b), n in edges.items():
            got[b] += damping * mass.get(a, 0) * n / out[a]
        kept = sum(got.values())
        new = {h: got[h] + seeds.get(h, 0) * (1 - kept) for h in {*got, *seeds}}
        if all(abs(new[h] - mass.get(h, 0)) <= 1e-13 * new[h] for h in new):
            return new
        mass = new


@pytest.mark.parametrize("damping", [0.4, 0.001])
def test_ranks_rest_at_the_fixed_point(spark, damping):
    """Circles, hosts without links, and hosts whose mass lies far below the tolerance."""
    edges = {("a", "b"): 2, ("b", "c"): 1, ("c", "a"): 1, ("a", "d"): 1, ("e", "a"): 5} | {("d", "x0"): 1}
    edges |= {(f"x{i}", f"x{i + 1}"): 1 for i in range(7)}
    seeds = {"a": 0.75, "e": 0.25}
    got = op.resting_rank(
        spark.createDataFrame([(*k, n) for k, n in edges.items()], "src string, dst string, n long"),
        spark.createDataFrame(list(seeds.items()), "host string, seed double"),
        damping,
    )
    got, want = {r.host: r.mass for r in got.collect()}, brute_rest(edges, seeds, damping)
    assert set(got) == set(want) and all(got[h] == pytest.approx(want[h], rel=1e-8) for h in want)


def test_no_host_is_lost_by_underflow(spark):
    edges = spark.createDataFrame([("a", "b", 1), ("b", "c", 1), ("c", "d", 1)], "src string, dst string, n long")
    got = op.resting_rank(edges, spark.createDataFrame([("a", 1.0)], "host string, seed double"), 1e-200).collect()
    assert {r.host for r in got} == set("abcd") and all(r.mass > 0 for r in got)


def test_distrust_reaches_the_end_of_a_long_chain(spark):
    n = 24
    rows = [(0, "http://bad.net/es/", "")] + [
        (i, f"http://h{i}.org/", f'<a href="http://{f"h{i - 1}.org" if i > 1 else "bad.net"}/">x</a>') for i in range(1, n + 1)
    ]
    pages = spark.createDataFrame([*rows, (n + 1, "http://lone.org/", "")], "page_id long, url string, html string")
    got = {r.page_id: r for r in op.filter_urls(pages).collect()}
    assert [got[i].verdict for i in range(n + 2)] == ["block"] * (n + 1) + ["allow"]
    chain = {("bad", 1): 1} | {(i, i + 1): 1 for i in range(1, n)}
    want = brute_rest(chain, {"bad": 1.0}, op.DAMPING)
    assert all(got[i].distrust == pytest.approx(want[i], rel=1e-8) for i in range(1, n + 1))
