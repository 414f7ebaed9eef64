import math

import pytest
from pyspark.sql import functions as F

from longspark.operators import gates, tidy

SIZES = (5, 10, 20, 40)


def curve(spark, rows):
    return spark.createDataFrame(rows, "m string, n_train int, value double")


def test_area_of_a_flat_curve_is_its_height(spark):
    out = gates.naulc(curve(spark, [("a", n, 0.4) for n in SIZES]), ["m"])
    assert out.first().naulc == pytest.approx(0.4)


def test_area_of_a_line_in_log_n_is_its_midpoint(spark):
    out = gates.naulc(curve(spark, [("a", n, math.log(n)) for n in SIZES]), ["m"])
    assert out.first().naulc == pytest.approx((math.log(5) + math.log(40)) / 2)


@pytest.mark.parametrize(
    "rows",
    [
        [("a", n, 0.4) for n in SIZES[:3]],
        [("a", n, 0.4) for n in (*SIZES, 5)],
        [("a", n, float("nan") if n == 10 else 0.4) for n in SIZES],
        [("a", n, None if n == 10 else 0.4) for n in SIZES],
    ],
)
def test_area_needs_one_finite_value_per_size(spark, rows):
    assert gates.naulc(curve(spark, rows), ["m"]).first().naulc is None


def pairs(spark, effects):
    rows = [("s", i, 1.0 - e, 1.0, e, e) for i, e in enumerate(effects)]
    return spark.createDataFrame(rows, "study string, b int, naulc_candidate double, naulc_comparator double, effect double, relative double")


@pytest.mark.parametrize(
    "effects,passed",
    [
        ([0.1, 0.1, 0.1, 0.1, -0.1], True),
        ([0.1, 0.1, 0.1, -0.1, -0.1], False),
        ([0.01, 0.01, 0.01, 0.01, -0.2], False),
        ([0.01] * 5, False),
        ([0.1] * 4, False),
    ],
)
def test_development_gate(spark, effects, passed):
    out = gates.development_gate(pairs(spark, effects), ["study"], min_relative_effect=0.02).first()
    assert out.passed is passed


def table(spark, rows):
    return spark.createDataFrame(
        [("s", *r) for r in rows],
        "study string, candidate string, passed boolean, candidate_mean_aulc double, mean_relative_improvement double, trainable_parameters int",
    )


@pytest.mark.parametrize(
    "rows,chosen",
    [
        ([("a", False, 0.1, 0.5, 1), ("b", False, 0.2, 0.4, 1)], None),
        ([("a", False, 0.1, 0.5, 1), ("b", True, 0.2, 0.4, 1)], "b"),
        ([("a", True, 0.1, 0.5, 9), ("b", True, 0.2, 0.4, 1)], "a"),
        ([("a", True, 0.1, 0.500, 9), ("b", True, 0.2, 0.498, 1)], "b"),
        ([("b", True, 0.1, 0.5, 9), ("a", True, 0.1, 0.5, 9)], "a"),
    ],
)
def test_selection_prefers_area_then_parsimony(spark, rows, chosen):
    out = gates.select_candidate(table(spark, rows), ["study"])
    assert [r.candidate for r in out.where("selected").collect()] == ([chosen] if chosen else [])
    assert out.count() == len(rows)


def test_many_studies_are_judged_at_once(spark):
    one = pairs(spark, [0.1] * 5)
    both = one.unionByName(one.withColumn("study", F.lit("t")).withColumn("effect", -F.col("effect")))
    out = {r.study: r.passed for r in gates.development_gate(both, ["study"], min_relative_effect=0.0).collect()}
    assert out == {"s": True, "t": False}


def test_noise_floor_by_hand(spark):
    rows = [("g", float(v)) for v in (1, 2, 3, 4, 5)]
    out = gates.noise_floor(spark.createDataFrame(rows, "g string, value double"), ["g"], configured=0.5).first()
    assert out.noise_floor == pytest.approx(1.4826 * 1 / (3 * math.sqrt(5)))
    assert out.locked_threshold == 0.5


def test_noise_floor_rejects_a_zero_median(spark):
    rows = [("g", float(v)) for v in (-1, 0, 0, 0, 5)]
    assert gates.noise_floor(spark.createDataFrame(rows, "g string, value double"), ["g"]).first().noise_floor is None


def test_gate_flag_is_unknown_without_a_comparator(spark):
    df = spark.createDataFrame([("w", "c", 1.0), ("w", "k", 2.0)], "world string, model string, value double")
    assert tidy.gate_summary(df, ["world"], "c", ["k", "l"]).first().beats_all is None
    assert tidy.gate_summary(df, ["world"], "c", ["k"]).first().beats_all is True


def test_coverage_is_oriented_by_its_distance(spark):
    df = spark.createDataFrame([("coverage_90", 0.7, 0.95), ("mae", 1.0, 0.5), ("latent_aligned_r2", 0.2, 0.5)], "metric string, a double, b double")
    from longspark.functions.numeric import oriented

    got = [r[0] for r in df.select(oriented(F.col("metric"), F.col("a"), F.col("b"))).collect()]
    assert got == pytest.approx([0.15, 0.5, 0.3])


def test_an_undeclared_category_is_an_error(spark):
    df = spark.createDataFrame([("x",)], "world string")
    with pytest.raises(Exception, match="unexpected world"):
        tidy.locked_order(df, "world", ["a"]).collect()


def test_best_control_is_the_first_on_a_tie(spark):
    rows = [("w", 1, 2, 3, m, v) for m, v in (("c", 0.5), ("k", 0.4), ("l", 0.4))]
    df = spark.createDataFrame(rows, "world string, cohort_seed int, subset_seed int, model_seed int, model string, naulc double")
    out = gates.misspecification(df, "c", ["k", "l"]).first()
    assert out.best_control == "k" and out.relative_excess == pytest.approx(0.25)


def test_changed_records_are_found(spark):
    a = spark.createDataFrame([("x", 1.0, True), ("y", 2.0, True), ("z", 3.0, False)], "k string, v double, f boolean")
    b = spark.createDataFrame([("x", 1.0 + 1e-13, True), ("y", 2.0, False), ("w", 3.0, False)], "k string, v double, f boolean")
    out = {r.k: r.status for r in gates.verify_gate(a, b, ["k"], ["v"], ["f"]).collect()}
    assert out == {"x": "verified", "y": "differs", "z": "unexpected", "w": "missing"}
