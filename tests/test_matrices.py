import numpy as np
import pytest
from pyspark.sql import functions as F

from longspark.operators import matrices, resample, variance


def cells(spark, rows=5, cols=7, holes=(), seed=3, labels="int"):
    rng = np.random.default_rng(seed)
    out = []
    for g in ("a", "b"):
        x, y = rng.normal(size=(rows, cols)).round(2), rng.normal(size=(rows, cols)).round(1)
        for i in range(rows):
            for j in range(cols):
                if (g, i, j) not in holes:
                    out.append((g, f"r{i}" if labels == "text" else i, j, float(x[i, j]), float(x[i, j] + y[i, j]), 1.0))
    kind = "string" if labels == "text" else "int"
    return spark.createDataFrame(out, f"g string, i_ {kind}, j_ int, x double, y double, e double").repartition(3)


HOLES = {("a", 1, 1), ("b", 0, 3), ("b", 4, 6)}


def near(got, want, keys):
    a = {tuple(r[k] for k in keys): r for r in got.collect()}
    b = {tuple(r[k] for k in keys): r for r in want.select(got.columns).collect()}
    assert a.keys() == b.keys() and a
    for k, r in a.items():
        for c in got.columns:
            if isinstance(r[c], float):
                assert r[c] == pytest.approx(b[k][c], abs=1e-9), (k, c)
            else:
                assert r[c] == b[k][c], (k, c)


@pytest.mark.parametrize("labels", ["int", "text"])
@pytest.mark.parametrize("holes", [(), HOLES])
def test_permutations_equal_the_joined_form(spark, monkeypatch, labels, holes):
    df = cells(spark, holes=holes, labels=labels)
    fast = resample.crossed_permutation(df, ["g"], "i_", "j_", "x", "y", resamples=120, seed=5)
    monkeypatch.setattr(matrices, "MAX_CELLS", 3)
    near(fast, resample.crossed_permutation(df, ["g"], "i_", "j_", "x", "y", resamples=120, seed=5), ["g"])


def test_blocks_of_replicates_give_the_same(spark, monkeypatch):
    df = cells(spark)
    one = resample.crossed_permutation(df, ["g"], "i_", "j_", "x", "y", resamples=150, seed=5).collect()
    monkeypatch.setattr(matrices, "REPLICATES", 40)
    monkeypatch.setattr(matrices, "MAX_DOUBLES", 400)
    many = resample.crossed_permutation(df, ["g"], "i_", "j_", "x", "y", resamples=150, seed=5).collect()
    assert sorted(map(repr, one)) == sorted(map(repr, many))


@pytest.mark.parametrize("holes", [(), HOLES])
def test_omissions_equal_the_joined_form(spark, monkeypatch, holes):
    df = cells(spark, holes=holes, labels="text")
    fast = variance.leave_one_out(df, ["g"], "i_", "j_", "x", "y")
    assert fast.count() == 24
    monkeypatch.setattr(matrices, "MAX_CELLS", 3)
    near(fast, variance.leave_one_out(df, ["g"], "i_", "j_", "x", "y"), ["g", "omitted_axis", "omitted_level"])


def test_crossed_bootstrap_equals_the_joined_form(spark, monkeypatch):
    df = cells(spark).withColumn("w", F.col("y") - F.col("x"))
    options = {"standard": "x", "forced": "y", "effect": "w", "resamples": 80}
    fast = resample.crossed_bootstrap(df, ["g"], "i_", "j_", **options)
    monkeypatch.setattr(matrices, "MAX_CELLS", 3)
    near(fast, resample.crossed_bootstrap(df, ["g"], "i_", "j_", **options), ["g"])


def test_screens_equal_the_joined_form(spark, monkeypatch):
    df = cells(spark).withColumn("z", F.col("x") * 2 + F.col("j_"))
    options = {"resamples": 60, "seed": 2}
    fast = variance.association_screen(df, ["g"], "i_", "j_", "y", ["x", "z"], ["e"], **options)
    monkeypatch.setattr(matrices, "MAX_CELLS", 3)
    near(fast.select(sorted(fast.columns)), variance.association_screen(df, ["g"], "i_", "j_", "y", ["x", "z"], ["e"], **options), ["g", "mechanism"])


def test_repeated_cells_and_null_labels_take_the_joined_form(spark):
    df = cells(spark)
    assert matrices.shape(df, ["g"], "i_", "j_") == matrices.Shape(35, False, True)
    assert not matrices.shape(df.union(df.limit(1)), ["g"], "i_", "j_").fits
    assert not matrices.shape(cells(spark, holes=HOLES), ["g"], "i_", "j_").complete
    assert matrices.shape(df.where("false"), ["g"], "i_", "j_").largest == 0
    empty = resample.crossed_permutation(df.where("false"), ["g"], "i_", "j_", "x", "y", resamples=10)
    assert empty.count() == 0


def test_units_in_many_blocks_are_drawn_multinomially(spark):
    n, block, count = 1000, 64, 250
    shares = [resample._block_counts(7, block, n, b, 1, count) for b in range(-(-n // block))]
    assert (np.sum(shares, 0) == n).all()
    sizes = [min(block, n - b * block) for b in range(len(shares))]
    for got, size in zip(shares, sizes):
        p = size / n
        assert abs(got.mean() - n * p) < 5 * np.sqrt(n * p * (1 - p) / count)
        assert 0.6 < got.var() / (n * p * (1 - p)) < 1.5
    values = np.random.default_rng(1).exponential(size=n)
    df = spark.createDataFrame([(f"u{i:04d}", float(v)) for i, v in enumerate(values)], "unit string, v double").repartition(5)
    means = [r.mean for r in resample.bootstrap_means(df, [], "unit", "v", resamples=600, block=block).collect()]
    again = [r.mean for r in resample.bootstrap_means(df.repartition(2), [], "unit", "v", resamples=600, block=block).collect()]
    assert len(means) == 600 and sorted(means) == pytest.approx(sorted(again))
    assert np.mean(means) == pytest.approx(values.mean(), abs=5 * values.std() / np.sqrt(n * 600))
    assert np.std(means) == pytest.approx(values.std() / np.sqrt(n), rel=0.15)


def test_dominance_equals_the_joined_form(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(g, f"u{i:02d}", i % 2, i % 3, float(rng.normal() + (i % 3) * (g == "a"))) for g in "ab" for i in range(18)]
    df = spark.createDataFrame(rows, "g string, unit string, p int, q int, v double")
    factors = {"p": [0, 1], "q": [0, 1, 2]}
    fast = resample.bootstrap_dominance(df, ["g"], "unit", factors, "v", resamples=60)
    assert {r.resamples for r in fast.collect()} == {60}
    fast = {(r.g, r.factor): r.largest_count for r in fast.collect()}
    monkeypatch.setattr(resample, "BLOCK", 3)
    slow = resample.bootstrap_dominance(df, ["g"], "unit", factors, "v", resamples=60).collect()
    assert fast == {(r.g, r.factor): r.largest_count for r in slow} and fast["a", "q"] > 30
