import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from longspark.operators import resample, variance

VALUES = [0.3, -0.1, 0.2, 0.5, 0.0, 0.4, -0.2, 0.1, 0.6, 0.25]


@pytest.fixture(scope="module")
def units(spark):
    return spark.createDataFrame([("s", i, v) for i, v in enumerate(VALUES)], "study string, unit int, effect double")


def test_bootstrap_interval_is_near_the_exact_one_and_repeats(spark, units):
    out = resample.bootstrap_mean_ci(units, ["study"], "unit", "effect", resamples=4000, seed=1).first()
    rng = np.random.default_rng(0)
    means = np.asarray(VALUES)[rng.integers(0, 10, size=(20000, 10))].mean(1)
    assert [out.ci_lower, out.ci_upper] == pytest.approx(np.quantile(means, [0.025, 0.975]), abs=0.02)
    again = resample.bootstrap_mean_ci(units.repartition(3), ["study"], "unit", "effect", resamples=4000, seed=1).first()
    assert out.ci_lower == pytest.approx(again.ci_lower, abs=1e-12)
    assert out.resamples == 4000 and out.units == 10


def test_constant_effects_give_a_point_interval(spark):
    df = spark.createDataFrame([(i, 0.7) for i in range(5)], "unit int, effect double")
    out = resample.bootstrap_mean_ci(df, [], "unit", "effect", resamples=50).first()
    assert (out.ci_lower, out.ci_upper) == (pytest.approx(0.7), pytest.approx(0.7))


@pytest.mark.parametrize("wins,losses,ties,p", [(8, 2, 0, 0.0546875), (10, 0, 0, 1 / 1024), (0, 3, 1, 1.0), (0, 0, 4, 1.0), (5, 5, 0, 0.623046875)])
def test_sign_test(spark, wins, losses, ties, p):
    rows = [(1.0,)] * wins + [(-1.0,)] * losses + [(0.0,)] * ties
    out = resample.sign_test(spark.createDataFrame(rows, "v double"), [], "v").first()
    assert (out.wins, out.losses, out.ties) == (wins, losses, ties)
    assert out.p_value == pytest.approx(p)


@pytest.mark.parametrize("max_rows", [2, 100])
def test_holm(spark, max_rows):
    rows = [("f", n, p) for n, p in (("a", 0.01), ("b", 0.04), ("c", 0.03), ("d", 0.005), ("e", 0.9))]
    df = spark.createDataFrame(rows, "f string, n string, p double")
    out = {r.n: r.holm_p_value for r in resample.holm_adjust(df, ["f"], "p", "n", max_rows=max_rows).collect()}
    assert out == pytest.approx({"d": 0.025, "a": 0.04, "c": 0.09, "b": 0.09, "e": 0.9})


def test_holm_cuts_equal_p_values(spark):
    rows = [("f", f"n{i:03d}", 0.001 if i < 150 else 0.0001) for i in range(200)]
    df = spark.createDataFrame(rows, "f string, n string, p double")
    whole = {r.n: r.holm_p_value for r in resample.holm_adjust(df, ["f"], "p", "n").collect()}
    cut = {r.n: r.holm_p_value for r in resample.holm_adjust(df, ["f"], "p", "n", max_rows=20).collect()}
    assert whole == cut and cut["n199"] == pytest.approx(200 * 0.0001) and cut["n149"] == pytest.approx(150 * 0.001)


def test_units_with_text_labels_are_numbered(spark):
    df = spark.createDataFrame([("s", f"unit-{i:03d}") for i in range(90)], "study string, unit string")
    out = resample.number_units(df, ["study"], "unit", max_rows=8)
    assert {r.unit: (r.k, r.n) for r in out.collect()} == {f"unit-{i:03d}": (i + 1, 90) for i in range(90)}


def matrix(spark, x, y):
    rows = [(i, j, float(x[i, j]), float(y[i, j])) for i in range(x.shape[0]) for j in range(x.shape[1])]
    return spark.createDataFrame(rows, "i_ int, j_ int, x double, y double")


def test_residuals_of_an_additive_matrix_are_zero(spark):
    x = np.add.outer(np.arange(4.0), 10 * np.arange(5.0))
    out = variance.two_way_residuals(matrix(spark, x, x), [], "i_", "j_", ["x"])
    assert out.agg(F.max(F.abs("x_residual"))).first()[0] < 1e-12
    ratio = resample.residual_sd_ratio(matrix(spark, x, x), [], "i_", "j_", "x", "y").first()
    assert ratio.ratio is None


def test_residual_ratio_matches_numpy(spark):
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(5, 10)), 2 * rng.normal(size=(5, 10))

    def sd(m):
        r = m - m.mean(1, keepdims=True) - m.mean(0, keepdims=True) + m.mean()
        return r.std(ddof=1)

    out = resample.residual_sd_ratio(matrix(spark, x, y), [], "i_", "j_", "x", "y").first()
    assert out.ratio == pytest.approx(sd(y) / sd(x))


def test_crossed_bootstrap_recomputes_margins_inside_replicates(spark):
    x = np.add.outer(np.arange(4.0), np.arange(5.0))
    df = matrix(spark, x, x).withColumn("g", F.lit(1.0))
    out = resample.crossed_bootstrap(df, [], "i_", "j_", standard="x", forced="y", effect="g", resamples=40).first()
    # an additive matrix stays additive however it is resampled, so no ratio exists
    assert out.valid_replicates == 0 and out.ratio_ci_lower is None
    assert out.mean_ci_lower == pytest.approx(1.0) and out.resamples == 40


def test_scaling_one_side_scales_the_ratio_interval(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(5, 6))
    df = matrix(spark, x, 3 * x).withColumn("g", F.col("x"))
    out = resample.crossed_bootstrap(df, [], "i_", "j_", standard="x", forced="y", effect="g", resamples=60).first()
    assert (out.ratio_ci_lower, out.ratio_ci_upper) == (pytest.approx(3.0), pytest.approx(3.0))


def test_permutation_of_a_planted_and_of_no_association(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(5, 10))
    noise = rng.normal(size=(5, 10))
    for y, small in ((x + 0.1 * noise, True), (np.ones((5, 10)), False)):
        rest = variance.two_way_residuals(matrix(spark, x, y), [], "i_", "j_", ["x", "y"])
        rest = rest.withColumns({c: F.round(c, 10) for c in ("x_residual", "y_residual")})
        out = resample.crossed_permutation(rest, [], "i_", "j_", "x_residual", "y_residual", resamples=99, seed=1).first()
        assert (out.p_value == pytest.approx(0.01)) if small else (out.p_value == 1.0)


def array(effect):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(5):
        for j in range(5):
            k = (i + j) % 5
            rows.append((i * 5 + j, i, j, k, float(effect[k] + 0.01 * rng.normal())))
    return pd.DataFrame(rows, columns=["unit", "cohort", "subset", "model", "value"])


FACTORS = {"cohort": list(range(5)), "subset": list(range(5)), "model": list(range(5))}


def lstsq_ss(df):
    def design(factors):
        cols = [np.ones(len(df))] + [(df[f] == v).astype(float) for f in factors for v in range(1, 5)]
        return np.column_stack(cols)

    def sse(factors):
        d = design(factors)
        r = df.value - d @ np.linalg.lstsq(d, df.value, rcond=None)[0]
        return float(r @ r)

    full = sse(list(FACTORS))
    return {f: sse([g for g in FACTORS if g != f]) - full for f in FACTORS}, full


@pytest.mark.parametrize("keep", [25, 19])
def test_factor_ss_matches_least_squares(spark, keep):
    df = array([0.0, 1.0, 0.5, -1.0, 0.2]).head(keep)
    want, rest = lstsq_ss(df)
    s = spark.createDataFrame(df).withColumn("g", F.lit(1))
    got = {r.component: r.sum_squares for r in variance.factor_ss_general(s, ["g"], FACTORS, "value").collect()}
    assert got == pytest.approx({**want, "residual": rest}, abs=1e-9)
    if keep == 25:
        closed = {r.component: r.sum_squares for r in variance.factor_ss(s, ["g"], list(FACTORS), "value").collect()}
        assert closed == pytest.approx(got, abs=1e-9)


def test_a_planted_factor_dominates_its_resamples(spark):
    df = spark.createDataFrame(array([0.0, 1.0, 0.5, -1.0, 0.2])).withColumn("g", F.lit("s"))
    out = resample.bootstrap_dominance(df, ["g"], "unit", FACTORS, "value", resamples=60)
    freq = {r.factor: r.largest_frequency for r in out.collect()}
    assert freq["model"] > 0.9 and sum(freq.values()) == pytest.approx(1.0)
    classes = variance.factor_class(variance.factor_ss(df, ["g"], list(FACTORS), "value"), out, ["g"])
    labels = {r.component: r.factor_classification for r in classes.collect()}
    assert labels["model"] == "dominant" and "weak" in labels.values()


def test_no_variation_is_unresolved(spark):
    df = spark.createDataFrame(array([0.0] * 5).assign(value=1.0)).withColumn("g", F.lit("s"))
    parts = variance.factor_ss(df, ["g"], list(FACTORS), "value")
    freq = spark.createDataFrame([("s", f, 1 / 3) for f in FACTORS], "g string, factor string, largest_frequency double")
    assert {r.factor_classification for r in variance.factor_class(parts, freq, ["g"]).collect()} == {"unresolved"}


@pytest.mark.parametrize("rows", [[(1.0, 2.0), (2.0, 1.0)], [(1.0, 1.0), (1.0, 2.0), (1.0, 3.0)]])
def test_correlation_is_null_for_few_or_constant_rows(spark, rows):
    df = spark.createDataFrame(rows, "x double, y double").withColumn("g", F.lit(1))
    out = variance.safe_corr(df, ["g"], "x", "y").first()
    assert out.pearson is None and out.spearman is None


def test_leave_one_out_counts(spark):
    rng = np.random.default_rng(9)
    df = matrix(spark, rng.normal(size=(5, 10)), rng.normal(size=(5, 10))).withColumn("g", F.lit(1))
    out = variance.leave_one_out(df, ["g"], "i_", "j_", "x", "y")
    assert {(r.omitted_axis, r.n) for r in out.collect()} == {("context", 40), ("model", 45)}
    assert out.count() == 15


def test_correlation_of_a_whole_table(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 4.0), (3.0, 7.0), (4.0, 7.5)], "x double, y double")
    out = variance.safe_corr(df, [], "x", "y").first()
    assert out.n == 4 and out.spearman == pytest.approx(1.0) and out.pearson == pytest.approx(np.corrcoef([1, 2, 3, 4], [2, 4, 7, 7.5])[0, 1])
