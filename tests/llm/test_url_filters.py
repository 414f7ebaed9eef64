import random

from brute import least_reachable

from longspark.llm import url_filters
from longspark.llm.components import connected_components


def verdicts(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, verdict int")
    return {r.page_id: (r.rule, r.verdict) for r in url_filters.judge(pages).collect()}


def test_aliases(spark):
    canonical = lambda u: f"<html><link href='{u}' rel=\"canonical\">"
    refresh = lambda u: f'<META http-equiv="refresh" content="0; URL={u}">'
    rows = [
        (1, "http://x.org/a", canonical("http://y.net/es/1"), 0),  # to a blocked page
        (2, "http://x.org/b", refresh("/a"), 0),  # alias of an alias
        (3, "http://z.com/", canonical("http://y.net/es/1"), 0),  # an allow in the same component
        (4, "http://q.org/1", refresh("http://q.net/fr/?x=1&amp;y=2#top"), 0),
        (5, "http://q.net/fr/?x=1&y=2", "", 0),
        (6, "http://r.org/", "<!-- " + canonical("http://q.net/fr/") + " --><script>" + canonical("http://q.net/fr/") + "</script>", 0),
        (7, "http://www.example.com/en/x", canonical("http://q.net/fr/?x=1&y=2"), 0),
        (8, "http://s.org/p/q", canonical("//t.net/es/2"), 0),
        (9, None, canonical("http://q.net/fr/"), 0),
        (10, "nothing", None, 0),
        (11, "http://s.org/p/r", canonical("q"), 0),
        (12, "http://s.org/p/r", canonical("http://s.org/p/r"), 0),
        (12, "http://s.org/p/r", canonical("http://s.org/p/r"), 0),
    ]
    got = verdicts(spark, rows)
    assert got[1] == (None, "allow") and got[2] == (None, "allow") and got[3] == ("com/", "allow")
    assert got[4] == (None, "allow") and got[5] == ("net/fr/", "block") and got[7] == ("www.example.com/en/", "allow")
    assert got[6] == (None, "allow") and got[9] == (None, "allow") and got[10] == (None, "allow")
    assert got[8] == (None, "block") and got[11] == (None, "block") and got[12] == (None, "block")
    alone = verdicts(spark, [r for r in rows if r[0] not in (3, 7)])
    assert alone[1] == alone[2] == alone[4] == (None, "block")
    assert verdicts(spark, [r for r in rows if r[0] < 0]) == {}


def test_hosts_and_paths(spark):
    rows = [(1, "HTTP://A.Com?x", "", 0), (2, "http://a.com/", "", 0), (3, "http://notexample.com/en/", "", 0), (4, "http://b.EXAMPLE.com/en/z", "", 0)]
    got = verdicts(spark, rows)
    assert got == {1: (None, "allow"), 2: ("com/", "allow"), 3: ("com/", "allow"), 4: ("example.com/en/", "block")}


def test_components(spark):
    rng = random.Random(4)
    edges = [(0, i) for i in range(1, 60)] + [(i, i + 1) for i in range(100, 140)] + [(rng.randrange(200, 300), rng.randrange(200, 300)) for _ in range(70)]
    edges += [(5, None), (7, 7), (1, 0)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long"), "a", "b").collect()}
    real = [(a, b) for a, b in edges if b is not None and a != b]
    nodes = sorted({x for e in real for x in e})
    at = {n: i for i, n in enumerate(nodes)}
    want = least_reachable(len(nodes), [(at[a], at[b]) for a, b in real], nodes)
    assert got == dict(zip(nodes, want))
    assert connected_components(spark.createDataFrame([], "a long, b long"), "a", "b").count() == 0
