import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from longspark.llm import codes

SCHEMA = "vec_id long, embedding array<float>, label int, code string, error string"


def plain(rows, parts=4, entries=256, rounds=4):
    """[(vec_id, label, code, error)] and the books, looking at every pair of part and entry."""
    whole = [(i, np.floor(np.array(v, np.float32).astype(float) * 1024).astype(np.int64), label) for i, v, label in rows]
    width = len(whole[0][1])
    at = [k * width // parts for k in range(parts + 1)]
    first = sorted(whole, key=lambda r: (r[0] is None, r[0] or 0, tuple(r[1])))[:entries]
    books = [np.array([r[1][a:b] for r in first]) for a, b in zip(at, at[1:])]

    def assign():
        found = []
        for p, book in enumerate(books):
            mine = np.array([r[1][at[p] : at[p + 1]] for r in whole])
            found.append(((mine[:, None, :] - book[None]) ** 2).sum(2))
        return found

    for _ in range(rounds):
        for p, away in enumerate(assign()):
            best = away.argmin(1)
            for e in set(best):
                mine = [r[1][at[p] : at[p + 1]] for r, b in zip(whole, best) if b == e]
                books[p][e] = [int(s) // len(mine) for s in np.sum(mine, 0)]
    last = assign()
    out = [
        (r[0], r[2], "".join(f"{a[i].argmin():02x}" for a in last), int(sum(a[i].min() for a in last))) for i, r in enumerate(whole)
    ]
    return out, books


def key(row):
    return repr(tuple(row))


@pytest.mark.parametrize("entries,width,count", [(256, 16, 700), (7, 8, 300), (3, 6, 200), (256, 4, 40)])
def test_against_all_pairs(spark, entries, width, count):
    rng = np.random.default_rng(entries + width)
    vectors = (rng.integers(-3, 4, size=(count, width)) / 1024).tolist() if width < 16 else rng.normal(size=(count, width)).round(2).tolist()
    rows = [(int(i) if i % 9 else None, v, int(i) % 3 if i % 4 else None) for i, v in enumerate(vectors)]
    rows += [(5, vectors[0], 1)] * (count // 2)
    bad = [(-1, None, 1), (-2, [None] * width, 1), (-3, [math.nan] * width, 1), (-4, [math.inf] + [0.0] * (width - 1), 2), (-5, [], 1), (-6, [1.0], 2)]
    df = spark.createDataFrame([(i, v, label, "old", "old") for i, v, label in rows + bad], SCHEMA).repartition(4)
    coded, books = codes.compress(df, entries=entries)
    want, want_books = plain(rows, entries=entries)
    assert all((a == b).all() for a, b in zip(books, want_books))
    got = coded.select("vec_id", "label", "code", "error").collect()
    assert sorted(map(key, got)) == sorted(map(key, want))
    totals = codes.with_total(coded, "label", F.col("error"), "label_error").collect()
    for r in totals:
        assert r.label_error == sum(w[3] for w in want if w[1] == r.label)
    text = ",".join(str(v) for b in want_books for v in b.ravel())
    assert codes.books_digest(books) == hashlib.sha256(text.encode()).hexdigest()


def test_trie_takes_the_first_of_equals():
    book = np.array([[1, 1], [0, 0], [1, 1], [0, 2]])
    parts, number = codes.distinct_rows(np.array([[1, 1], [0, 1], [9, 9], [1, 1], [0, -5]]))
    found, away = codes.nearest(parts, book)
    assert list(found[number]) == [0, 0, 0, 0, 1] and list(away[number]) == [0, 1, 128, 0, 25]


def test_decode(spark):
    df = spark.createDataFrame([(i, [float(i % 5), 1.0, -2.0, i / 3], i, None, None) for i in range(60)], SCHEMA)
    coded, books = codes.compress(df)
    exact = codes.decode(coded, books).select("decoded", "error").collect()
    assert any(r.error == 0 for r in exact) and all(len(r.decoded) == 4 for r in exact)
    x, _ = codes.integers(df)
    both = codes.decode(codes.encode(x, books), books).collect()
    assert all(sum((a - b) ** 2 for a, b in zip(r.x, r.decoded)) == r.error for r in both)


def test_no_vectors(spark):
    for rows in ([], [(1, None, 1, "", "")]):
        coded, _ = codes.compress(spark.createDataFrame(rows, SCHEMA))
        assert coded.count() == 0 and coded.columns == ["vec_id", "label", "code", "error"]
        assert codes.with_total(coded, "label", F.col("error"), "label_error").count() == 0
    with pytest.raises(ValueError):
        codes.compress(spark.createDataFrame([], SCHEMA), entries=300)


def test_extreme_entries(spark):
    coded, _ = codes.compress(spark.createDataFrame([(1, [3.0e38] * 4, 1, "", ""), (2, [-3.0e38] * 4, 1, "", "")], SCHEMA), entries=1)
    assert all(r.error >= 0 for r in coded.collect())
