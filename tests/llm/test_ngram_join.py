import random

import numpy as np
import pytest
from brute import jaccard_components

from longspark.llm import ngram_join


def compare(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r[0]: (r[1], r[2]) for r in ngram_join.components(docs).collect()}
    assert got == jaccard_components(rows)
    return got


def near_copies(rng, n, words, edits):
    base = [f"{rng.randrange(10**6)}" for _ in range(words)]
    out = [base]
    for _ in range(n - 1):
        copy = list(base)
        for _ in range(rng.randint(0, edits)):
            copy[rng.randrange(words)] = f"{rng.randrange(10**6)}"
        out.append(copy)
    return [" ".join(c) for c in out]


@pytest.mark.parametrize("rounds", [0, 4])
def test_groups_of_near_copies(spark, monkeypatch, rounds):
    monkeypatch.setattr(ngram_join, "ROUNDS", rounds)
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(60))
    texts = near_copies(rng, 40, 60, 2) + near_copies(rng, 20, 200, 12) + near_copies(rng, 12, 25, 1)
    texts += [passage + " " + " ".join(f"{rng.randrange(10**6)}" for _ in range(rng.randint(0, 40))) for _ in range(40)]
    texts += ["one", "One", "one two", "one two", "", "  \n", "one two three", None] + ["the of and " * rng.randint(1, 30) for _ in range(10)]
    ids = rng.sample(range(10_000), len(texts))
    got = compare(spark, list(zip(ids, texts)))
    assert len({c for _, c in got.values()}) > 20


def test_odd_rows(spark):
    rows = [(None, "a b c d", 1), (None, "a b c d", 2), (7, "a b c d", 3), (5, "A B c d", 4), (5, "A B c d", 5), (9, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n int")
    got = sorted(ngram_join.components(docs).collect(), key=str)
    assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in got), key=str) == sorted(
        [(None, 2, None), (None, 2, None), (7, 2, 5), (5, 2, 5), (5, 2, 5), (9, 0, 9)], key=str
    )
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == [5, 9, None, None]
    assert ngram_join.components(docs.limit(0)).count() == 0


def test_copies_between_the_two_thresholds(spark):
    rng = random.Random(12)
    rows = []
    for i in range(0, 60, 3):
        base = [f"{rng.randrange(10**6)}" for _ in range(200)]
        rows.append((i, " ".join(base)))
        for k in (1, 2):  # 4 of 200 words apart: 0.81 of the fives, 0.89 of the threes
            copy = list(base)
            for at in (20, 70, 120, 170):
                copy[at + k] = f"{rng.randrange(10**6)}"
            rows.append((i + k, " ".join(copy)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    want = {d for d, (_, c) in jaccard_components(rows, 5, 80).items() if c == d}
    assert len(want) == 20 and all(c == d for d, (_, c) in jaccard_components(rows).items())
    assert {r.doc_id for r in ngram_join.keep_one(docs).collect()} == want


def test_texts_of_one_id_stay(spark):
    words = [f"w{i}" for i in range(40)]
    rows = [(1, " ".join(words)), (3, " ".join(words)), (3, "quite another text of its own"), (3, "quite another text of its own"), (4, None), (4, None), (5, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, ngram_join.keep_one(docs).collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[2], rows[4], rows[6]], key=str)
    assert ngram_join.keep_one(docs.limit(0)).count() == 0


@pytest.mark.parametrize("size, similarity", [(3, 90), (5, 80), (2, 50)])
def test_merged_lists_lose_no_partner(size, similarity):
    rng = random.Random(similarity)
    hashes, counts = ngram_join._Hashes(), np.array([rng.randrange(9) for _ in range(1 << ngram_join.SKETCH_BITS)], np.int32)
    texts = [t for n in (4, 12, 40, 150) for _ in range(8) for t in near_copies(rng, 6, n, 1 + n // 12)]
    split = [ngram_join._divided(ngram_join.word_hashes(t, hashes), size, similarity, counts) for t in texts]
    lists = ngram_join._Lists([(short, len(whole), i, 0) for i, (whole, short) in enumerate(split)])
    links = 0
    for i, (whole, short) in enumerate(split):
        reached = set(lists.reaching(short, len(whole), i, similarity).tolist())
        for j, (other, _) in enumerate(split):
            both = len(np.intersect1d(whole, other))
            alike = i != j and 100 * both >= similarity * (len(whole) + len(other) - both)
            assert not alike or (j in reached and ngram_join._similar(whole, other, similarity))
            links += alike
    assert links > 20
