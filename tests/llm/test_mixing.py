import re

import pytest
from pyspark.sql import functions as F

from longspark.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, target string"


def plain(docs, weights, share=150, epochs=2):
    """(source, words, target) by dealing anew until no source is above its limit."""
    size = {}
    for _, text, source in docs:
        size[source] = size.get(source, 0) + len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(size.values()) * share / 100, set()
    while True:
        left = total - sum(size[s] * epochs for s in full)
        rest = sum(weight[s] for s in order if s not in full)
        target = {s: size[s] * epochs if s in full else weight[s] * left / rest for s in order}
        new = {s for s in order if target[s] > size[s] * epochs}
        if not new:
            return size, target
        full |= new


def frame(spark, docs):
    return spark.createDataFrame([(d, t, s, "other", None) for d, t, s in docs], SCHEMA).repartition(3)


def mixed(spark, docs, **options):
    planned = mixing.mix(frame(spark, docs), (3, 1, 2), **options)
    return planned.select("id", "source", "size", "source_size", "target", "start", "taken").collect()


DOCS = [(i, " ".join(f"w{i}" for _ in range(i % 17)), ["a", "b", "é", None, "Z"][i % 5] if i % 3 else "b") for i in range(300)]
ODD = [(None, None, "a"), (None, "", "a"), (7, "x\ty\x0bz q", "a"), (7, "x\ty\x0bz q", "a"), (8, "long " * 50_000, "Z"), (None, "p q", None)]


@pytest.mark.parametrize("docs", [DOCS, DOCS + ODD, ODD], ids=["plain", "odd too", "odd"])
def test_targets_and_budgets(spark, docs):
    size, target = plain(docs, (3, 1, 2))
    rows = mixed(spark, docs)
    assert len(rows) == len(docs)
    for source, words in size.items():
        own = [r for r in rows if r.source == source]
        assert {r.source_size for r in own} == {words}
        assert all(r.target == pytest.approx(target[source], rel=1e-12) for r in own)
        assert sum(r.taken for r in own) == int(target[source] + 0.5)
        assert all(0 <= r.taken <= 2 * r.size for r in own)
        # one document of a source is cut at most, and the prefix sums have no gap
        full = int(target[source] + 0.5) // max(words, 1)
        assert sum(r.taken not in (full * r.size, (full + 1) * r.size) for r in own) <= 1
        at = 0
        for r in sorted((r for r in own if r.size), key=lambda r: r.start):
            assert r.start == at
            at += r.size
        assert at == words


def test_same_in_any_order(spark):
    docs = DOCS + ODD
    first, second = mixed(spark, docs), mixed(spark, docs[::-1])
    assert sorted(map(repr, first)) == sorted(map(repr, second))
    other = mixed(spark, docs, seed="other")
    assert sorted(map(repr, first)) != sorted(map(repr, other))


def test_many_copies_of_a_row(spark):
    docs = [(5, "one two three", "a")] * 400 + [(i, "four five", "b") for i in range(200)]
    rows = mixed(spark, docs)
    size, target = plain(docs, (3, 1, 2))
    for s in size:
        assert sum(r.taken for r in rows if r.source == s) == int(target[s] + 0.5)
    assert len(rows) == 600 and {r.taken for r in rows if r.source == "a"} <= set(range(7))


def test_limits_and_weights(spark):
    rows = mixed(spark, DOCS, share=500)
    assert all(r.taken == 2 * r.size and r.target == 2 * r.source_size for r in rows)
    sized = mixing.sized(frame(spark, DOCS))
    sources = mixing.source_sizes(sized)
    weight = F.when(F.col("source") == "a", F.lit(None)).when(F.col("source") == "b", -1).when(F.col("source") == "Z", 0).otherwise(1)
    target = {r.source: r.target for r in mixing.targets(sources, weight, 50).collect()}
    assert target["a"] == target["b"] == target["Z"] == 0 and target["é"] > 0 and target[None] > 0
    assert all(r.taken == 0 for r in mixing.plan(sized, mixing.targets(sources, F.lit(0))).collect())


def test_empty_tables(spark):
    assert mixed(spark, []) == []
    assert [r.taken for r in mixed(spark, [(1, None, None), (2, "", "a")])] == [0, 0]


def test_texts(spark):
    docs = DOCS + ODD
    planned = mixing.mix(frame(spark, docs), (3, 1, 2))
    rows = mixing.texts(frame(spark, docs), planned).collect()
    taken = {}
    for r in rows:
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r.text))
        taken[r.source] = taken.get(r.source, 0) + n
        assert any(d == r.id and s == r.source and (t or "").startswith(r.text) for d, t, s in docs)
        assert r.epoch in (1, 2)
    want = {}
    for r in planned.collect():
        want[r.source] = want.get(r.source, 0) + r.taken
    assert taken == {s: n for s, n in want.items() if n}
