import os
import random

import pytest
from brute import deduped_lines, distance
from pyspark.sql import functions as F

from longspark.llm import line_dedup, ngram_join
from longspark.session import materialize, work_folder


def changed(rng, text, most, letters):
    out = list(text)
    for _ in range(rng.randint(0, most)):
        at, kind = rng.randint(0, len(out)), rng.random()
        if kind < 0.35:
            out.insert(at, rng.choice(letters))
        elif out and kind < 0.7:
            out.pop(min(at, len(out) - 1))
        elif out:
            out[min(at, len(out) - 1)] = rng.choice(letters)
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(edits)
    pairs = []
    for _ in range(800):
        a = "".join(rng.choice("abé") for _ in range(rng.randint(0, 14)))
        pairs.append(sorted((a, changed(rng, a, 4, "abcé")), key=len, reverse=True))
    pairs = [p for p in pairs if len(p[0]) - len(p[1]) <= edits]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(2)
    for r in df.select("a", "b", line_dedup.edit_distance(F.col("a"), F.col("b"), edits).alias("d")).collect():
        assert min(r.d, edits + 1) == min(distance(r.a, r.b), edits + 1)


@pytest.mark.parametrize("seed", [3, 4])
def test_lines(spark, seed):
    rng = random.Random(seed)
    words = ["the", "of", "thion", "erand", "éa", "12"]
    base = [" ".join(rng.choice(words) for _ in range(rng.randint(3, 9))) for _ in range(30)]
    rows = [
        (i, "\n".join(changed(rng, rng.choice(base), 3, "xyz ") if rng.random() < 0.8 else "" for _ in range(rng.randint(0, 6))))
        for i in range(100)
    ] + [(500, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").coalesce(2)
    got = {r[0]: (r.n_lines, r.n_exact, r.n_near, r.text) for r in line_dedup.dedup_lines(docs).collect()}
    want = deduped_lines(rows)
    assert got == want and sum(w[2] for w in want.values()) > 20


def test_odd_rows(spark):
    line = "a line of more than twenty characters"
    rows = [(None, line, 1), (2, line, 2), (2, line, 3), (3, line + "\r\nshort\n" + line, 4), (4, "", 5), (5, None, 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, near int")
    got = {r.near_: (r.text, r.n_exact, r.n_near) for r in line_dedup.dedup_lines(docs.withColumnRenamed("near", "near_")).collect()}
    # the line feed is the only line end, so the copy with a carriage return is a near line
    assert got == {1: (line, 0, 0), 2: ("", 1, 0), 3: ("", 1, 0), 4: ("short", 1, 1), 5: ("", 0, 0), 6: (None, 0, 0)}
    assert line_dedup.dedup_lines(docs).where("doc_id = 3").first().near == 4
    assert line_dedup.dedup_lines(docs.limit(0)).count() == 0


def test_counts_of_any_letters(spark):
    lines = ["r" * 200 + "d" * 300, "d" * 10, "r" * 255, "r" * 256 + "d" * 255, ""]
    pairs = [(a, b) for a in lines for b in lines]
    df = spark.createDataFrame(pairs, "a string, b string").coalesce(1)
    counts = [line_dedup._letter_counts(F.col(c)) for c in "ab"]
    for r in df.select("a", "b", line_dedup._counts_differ(*counts).alias("d")).collect():
        gaps = [abs(r.a.count(c) - r.b.count(c)) % 16 for c in "dr"]
        assert r.d == sum(min(g, 16 - g) for g in gaps)


def test_what_was_written_goes_when_it_has_been_read(spark):
    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    line = "a line that is long enough, number "
    docs = spark.createDataFrame([(i, f"{line}{i % 7}\n{line}{i:04d}") for i in range(40)], "doc_id long, text string").coalesce(2)
    frames = lambda: set(os.listdir(work_folder(spark)))
    before, own = frames(), spark.conf.get(setting, None)
    result = line_dedup.dedup_lines(docs)
    # repeated lines, near lines and what goes
    assert len(frames() - before) == 3
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(line_dedup.dedup_lines(docs, apart=True)) == rows(result)
    assert result.count() == 40 and spark.conf.get(setting, None) == own
    before = frames()
    left = ngram_join.keep_one(docs)
    # links and steps of the components are small; sets and lists of whole texts go
    kept = [spark.read.parquet(f"{work_folder(spark)}/{f}").columns for f in frames() - before]
    assert not any("short" in c or "token" in c for c in kept) and left.count() <= 40


def test_shuffle_files_of_a_written_frame_go(spark):
    def cleaned(df):
        return df._jdf.queryExecution().shuffleCleanupMode().toString()

    seen = []

    class Watched:
        sparkSession = spark

        class write:
            @staticmethod
            def parquet(path):
                seen.append(cleaned(spark.range(3)))
                spark.range(3).write.parquet(path)

    assert materialize(Watched).count() == 3
    assert seen == ["RemoveShuffleFiles"] and cleaned(spark.range(3)) != "RemoveShuffleFiles"
