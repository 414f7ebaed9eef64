import random
import re

import pytest
from brute import lower

from longspark.llm import decontaminate

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def brute(docs, bench):
    windows = {}
    for item, text in bench:
        w = re.findall(WORD, lower(text or ""))
        n = min(len(w), 13)
        for i in range(len(w) - n + 1 if n else 0):
            windows.setdefault(tuple(w[i : i + n]), set()).add(str(item))
    out = {}
    for d, text in docs:
        w = re.findall(WORD, lower(text or ""))
        hit, items = set(), set()
        for i in range(len(w)):
            for n in range(1, 14):
                found = windows.get(tuple(w[i : i + n])) if i + n <= len(w) else None
                if found:
                    hit |= set(range(i, i + n))
                    items |= found
        out[d] = (len(w), len(hit), sorted(items))
    return out


@pytest.fixture(scope="module")
def data():
    rng = random.Random(1)
    words = ["the", "of", "Éa", "ing", "12", "naïve", "x"]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    bench = [(i, text(rng.choice([2, 5, 13, 14, 30]))) for i in range(8)] + [(90, None), (91, ""), (92, "--")]
    planted = lambda: f"{text(rng.randint(0, 30))},{rng.choice(bench[:8])[1].replace("the", "THE")}! {text(20)}"
    docs = [(i, planted() if rng.random() < 0.6 else text(40)) for i in range(60)]
    return docs + [(700, None), (701, ""), (702, "...")], bench


@pytest.mark.parametrize("literal", [200_000, 0])
def test_hits(spark, monkeypatch, literal, data):
    docs, bench = data
    monkeypatch.setattr(decontaminate, "LITERAL_WINDOWS", literal)
    d = spark.createDataFrame([(*x, 1) for x in docs], "doc_id long, text string, hash int").repartition(3)
    b = spark.createDataFrame(bench, "item_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_hit, list(r["items"])) for r in decontaminate.find_hits(d, b).collect()}
    assert got == brute(docs, bench)
    assert decontaminate.find_hits(d.limit(0), b).count() == 0
    assert {r.n_hit for r in decontaminate.find_hits(d, b.limit(0)).collect()} == {0}


def test_removal(spark):
    passage = " ".join(f"w{i}" for i in range(20))
    long = " ".join(f"z{i}" for i in range(900))
    rows = [(1, f"start {passage} end", 1), (2, f"{long} {passage}", 2), (2, f"{long} {passage}", 2), (3, None, 3), (4, "clean", 4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, words int")
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    kept = decontaminate.decontaminate(docs, bench)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 2, 3, 4]
    cut = {r.doc_id: r.text for r in decontaminate.decontaminate(docs, bench, remove="spans").collect()}
    assert cut == {1: "start end", 2: long, 3: None, 4: "clean"}
