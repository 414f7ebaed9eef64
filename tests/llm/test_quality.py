import random

import numpy as np
import pytest

from longspark.llm import quality


def longest_repeats(words):
    """By comparing all pairs of places."""
    n, out = len(words), [0] * len(words)
    for i in range(n):
        for j in range(n):
            if i != j:
                k = 0
                while max(i, j) + k < n and words[i + k] == words[j + k]:
                    k += 1
                out[i] = max(out[i], k)
    return out


@pytest.mark.parametrize("alphabet", ["ab", "abcd", "abcdefghij"])
def test_suffix_repeats(alphabet):
    rng = random.Random(alphabet)
    for _ in range(60):
        words = [alphabet.index(rng.choice(alphabet)) for _ in range(rng.randint(4, 60))]
        array = np.array(words, np.int64)
        got = quality.suffix_repeats(array, quality.triples(array))
        want = longest_repeats(words)
        assert [g for g in got] == [w if w >= 3 else 0 for w in want]
        for least in (3, 5):
            covered = {p for i, w in enumerate(want) if w >= least for p in range(i, i + w)}
            assert quality.covered_words(got, least) == len(covered)


def test_many_different_words():
    words = np.arange(3_000, dtype=np.int64) * 2_000_003
    words[1500:1520] = words[:20]
    assert int(quality.suffix_repeats(words, quality.triples(words)).max()) == 20


def test_one_word_over_and_over():
    words = np.zeros(5000, np.int64)
    got = quality.suffix_repeats(words, quality.triples(words))
    assert got[0] == 4999 and quality.covered_words(got, 10) == 5000


def test_frames(spark):
    clean = " ".join(f"w{i}" for i in range(80))
    rows = [
        (1, None, 0),
        (2, "", 0),
        (3, clean, 0),
        (3, clean, 0),
        (4, (clean + "\n") * 2, 0),
        (5, clean + "\n" + " ".join(f"w{i}" for i in range(12)), 0),
        (6, " \n\t ", 0),
        (7, "x#y &|\nsame line\n\nsame line\n \n", 0),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, kept int")
    got = {r.doc_id: r for r in quality.measure(docs).collect()}
    assert got[1].n_words == got[2].n_words == got[6].n_words == 0 and got[1].base_failed and not got[1].kept
    assert got[3].kept and got[3].n_repeat_words == 0
    assert got[4].longest_repeat == 80 and got[4].base_failed and got[4].n_dup_lines == 1
    assert got[5].kept and got[5].n_covered == 24 and got[5].longest_repeat == 12
    assert (got[7].n_symbols, got[7].n_dup_lines, got[7].word_chars) == (3, 1, 21)
    assert sorted(r.doc_id for r in quality.keep_good(docs).collect()) == [3, 3, 5]
    assert quality.keep_good(docs).columns == docs.columns
    assert quality.measure(docs.limit(0)).count() == 0


def test_refused_by_one_limit_alone(spark):
    words = lambda a, b: " ".join(f"w{i}" for i in range(a, b))
    rows = [
        (1, f"{words(0, 80)} {words(0, 20)}"),  # 40 of 100 words covered
        (2, f"{words(0, 900)} {words(0, 101)}"),  # a fifth covered, but by a repeat of 101 words
        (3, f"{words(0, 900)} {words(0, 100)}"),
        (4, f"{words(0, 85)} {words(0, 15)}"),  # 30 of 100
        (5, f"{words(0, 84)} {words(0, 16)}"),
        (6, f"{words(0, 80)} " + " ".join(f"{words(i, i + 9)} x{i}" for i in range(0, 18, 9))),  # short repeats cover nothing
    ]
    got = {r.doc_id: r for r in quality.measure(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert not any(r.base_failed for r in got.values())
    assert {d: r.kept for d, r in got.items()} == {1: False, 2: False, 3: True, 4: True, 5: False, 6: True}
    assert (got[1].n_covered, got[1].longest_repeat, got[2].n_covered, got[2].longest_repeat) == (40, 20, 202, 101)
    assert got[6].n_covered == 0 < got[6].n_repeat_words
