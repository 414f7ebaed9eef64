import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longspark.operators.quantiles import quantiles
from longspark.operators.scan import Run, add_chunks, running
from longspark.operators.variance import average_ranks


@pytest.fixture(scope="module")
def heavy(spark):
    """One key with two thirds of all rows."""
    rng = np.random.default_rng(1)
    rows = [("hot", i, None if i % 7 == 0 else float(rng.integers(0, 50))) for i in range(200)]
    rows += [(f"k{j}", i, float(rng.integers(0, 50))) for j in range(10) for i in range(10)]
    return pd.DataFrame(rows, columns=["k", "t", "v"])


SPECS = {
    "n": lambda: Run("count"),
    "n_before": lambda: Run("count", inclusive=False),
    "n_after": lambda: Run("count", inclusive=False, reverse=True),
    "total": lambda: Run("sum", F.col("v")),
    "low": lambda: Run("min", F.col("v")),
    "high_later": lambda: Run("max", F.col("v"), reverse=True),
    "previous": lambda: Run("last", F.col("v"), inclusive=False),
    "following": lambda: Run("last", F.col("v"), inclusive=False, reverse=True),
    "row_before": lambda: Run("last", F.struct("t", "v"), inclusive=False),
}


def frame(spark, heavy):
    rows = [(k, int(t), None if np.isnan(v) else v) for k, t, v in heavy.itertuples(index=False)]
    return spark.createDataFrame(rows, "k string, t int, v double")


def _collect(df):
    return sorted(df.collect(), key=lambda r: (r.k, r.t))


@pytest.mark.parametrize("max_rows", [3, 17, 60])
def test_a_cut_key_gives_the_same_running_values(spark, heavy, max_rows):
    df = frame(spark, heavy)
    plain = running(df, ["k"], ["t"], {n: f() for n, f in SPECS.items()})
    cut, chunk = add_chunks(df, ["k"], "t", max_rows=max_rows)
    assert chunk is not None
    assert cut.groupBy("k", chunk).count().agg(F.max("count")).first()[0] <= max_rows
    parts = running(cut, ["k"], ["t"], {n: f() for n, f in SPECS.items()}, chunk=chunk).drop(chunk)
    assert _collect(plain.select(parts.columns)) == _collect(parts)


def test_no_heavy_key_means_no_cut(spark, heavy):
    df = frame(spark, heavy)
    out, chunk = add_chunks(df, ["k"], "t", max_rows=1000)
    assert chunk is None and out is df


def test_equal_order_values_stay_together(spark):
    df = spark.createDataFrame([("a", 5, float(i)) for i in range(50)] + [("a", i, 0.0) for i in range(50)], "k string, t int, v double")
    cut, chunk = add_chunks(df, ["k"], "t", max_rows=8)
    assert cut.where("t = 5").select(chunk).distinct().count() == 1


def test_a_composite_cuts_equal_order_values(spark):
    rows = [("a", 5, i) for i in range(400)] + [(None, 1, i) for i in range(30)] + [("b", 1, 0)]
    df = spark.createDataFrame(rows, "k string, t int, v int").repartition(7)
    cut, chunk = add_chunks(df, ["k"], "t", ties=("v",), max_rows=20)
    got = {(r.k, r[chunk]): r.n for r in cut.groupBy("k", chunk).agg(F.count("*").alias("n")).collect()}
    assert got == {("a", i): 20 for i in range(20)} | {(None, 0): 20, (None, 1): 10, ("b", 0): 1}
    out = running(cut, ["k"], ["t", "v"], {"n": Run("count")}, chunk=chunk)
    assert all(r.n == r.v + 1 for r in out.collect())


@pytest.mark.parametrize("label", ["name-{:03d}", "é{:03d}"])
def test_text_orders_are_cut(spark, label):
    df = spark.createDataFrame([("a", label.format(i)) for i in range(100)], "k string, t string").repartition(5)
    cut, chunk = add_chunks(df, ["k"], "t", max_rows=9)
    for r in cut.collect():
        assert r[chunk] == int(r.t[-3:]) // 9


def test_a_chunk_does_not_hang_on_the_layout(spark, heavy):
    df = frame(spark, heavy)
    cuts = []
    for spread in (df.repartition(1), df.repartition(13), df.orderBy(F.desc("v"))):
        cut, chunk = add_chunks(spread, ["k"], "v", ties=("t",), max_rows=7)
        cuts.append(sorted((r.k, r.t, r[chunk]) for r in cut.collect()))
    assert cuts[0] == cuts[1] == cuts[2]


def test_a_broadcast_is_not_needed(spark, heavy, monkeypatch):
    from longspark.operators import scan

    monkeypatch.setattr(scan, "MAX_BROADCAST_KEYS", 0)
    df = frame(spark, heavy)
    cut, chunk = add_chunks(df, ["k"], "t", max_rows=17)
    got = _collect(running(cut, ["k"], ["t"], {"n": Run("count")}, chunk=chunk).select("k", "t", "n"))
    assert got == _collect(running(df, ["k"], ["t"], {"n": Run("count")}).select("k", "t", "n"))


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_quantiles_match_numpy(spark, heavy, max_rows):
    df = frame(spark, heavy)
    out = quantiles(
        df, ["k"], {"q25": ("v", 0.25), "q90": ("v", 0.9)}, extra=[F.count("v").alias("n")], max_rows=max_rows
    )
    for row in out.collect():
        values = heavy[heavy.k == row.k].v.dropna()
        assert row.n == len(values)
        assert row.q25 == pytest.approx(np.quantile(values, 0.25))
        assert row.q90 == pytest.approx(np.quantile(values, 0.9))


def test_quantiles_have_the_same_bits_however_they_are_found(spark, heavy):
    df = frame(spark, heavy).withColumn("v", F.col("v") / 3 + F.col("t") * 0.7).withColumn("k", F.when(F.col("k") != "k3", F.col("k")))
    wanted = {f"q{p}": ("v", p / 1000) for p in (25, 100, 333, 500, 975)}
    results = [sorted(map(repr, quantiles(df, ["k"], wanted, max_rows=n).collect())) for n in (5, 40, 1000)]
    assert results[0] == results[1] == results[2] and len(results[0]) == 11


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_quantiles_without_keys_and_with_null_keys(spark, heavy, max_rows):
    df = frame(spark, heavy)
    row = quantiles(df, [], {"m": ("v", 0.5)}, max_rows=max_rows).first()
    assert row.m == pytest.approx(heavy.v.median())
    nulls = df.withColumn("k", F.when(F.col("k") != "hot", F.col("k")))
    got = {r.k: r.m for r in quantiles(nulls, ["k"], {"m": ("v", 0.5)}, max_rows=max_rows).collect()}
    assert got[None] == pytest.approx(heavy[heavy.k == "hot"].v.median())


@pytest.mark.parametrize("max_rows", [5, 1000])
def test_average_ranks_match_pandas(spark, heavy, max_rows):
    rows = heavy.dropna()
    out = average_ranks(spark.createDataFrame(rows), ["k"], "v", "r", max_rows=max_rows).toPandas()
    want = rows.assign(r=rows.groupby("k").v.rank())
    merged = out.merge(want, on=["k", "t"])
    assert len(merged) == len(rows)
    assert np.allclose(merged.r_x, merged.r_y)
