import math

import pytest
from pyspark.sql import functions as F

from longspark.functions.draws import driver_draw, driver_normal, draw, normal, uniform
from longspark.operators import missingness, sampling
from longspark.plans import grids


@pytest.fixture(scope="module")
def people(spark):
    return spark.range(103).select(F.col("id").cast("string").alias("patient_id"), (F.col("id") % 3).alias("site")).persist()


def test_split_is_exact_disjoint_and_repeatable(spark, people):
    one = sampling.split_entities(people, seed=1)
    sizes = {r.split: r["count"] for r in one.groupBy("split").count().collect()}
    assert sizes == {"train": 72, "val": 10, "test": 21}
    assert one.select("patient_id").distinct().count() == 103
    assert one.exceptAll(sampling.split_entities(people.repartition(7), seed=1)).count() == 0
    assert one.exceptAll(sampling.split_entities(people, seed=2)).count() > 0


def test_rank_does_not_depend_on_the_slices(spark, people):
    a = sampling.ranked(people, ["site"], "patient_id", 5, "x", slices=1)
    b = sampling.ranked(people, ["site"], "patient_id", 5, "x", slices=256)
    assert a.exceptAll(b).count() == 0
    assert a.groupBy("site").agg(F.max("rank").alias("m"), F.max("pool_size").alias("n")).where("m <> n").count() == 0


def test_split_rejects_bad_fractions(people):
    for train, val in ((0.0, 0.1), (1.0, 0.0), (0.9, 0.1)):
        with pytest.raises(ValueError):
            sampling.split_entities(people, train_fraction=train, val_fraction=val)


@pytest.mark.parametrize("n,fit,held", [(5, 4, 1), (10, 8, 2), (20, 16, 4), (40, 32, 8), (100, 80, 20), (2, 1, 1)])
def test_budget_sizes(spark, people, n, fit, held):
    out = sampling.fit_val_budget(people, n, 3).groupBy("role").count().collect()
    assert {r.role: r["count"] for r in out} == {"fit": fit, "validation": held}


def test_large_samples_by_rank_equal_small_ones_by_sort(spark, people, monkeypatch):
    small = sampling.sample_entities(people, 30, 9).select("patient_id")
    monkeypatch.setattr(sampling, "TOP_N_LIMIT", 0)
    assert small.exceptAll(sampling.sample_entities(people, 30, 9).select("patient_id")).count() == 0


def test_budgets_are_nested_per_seed(spark, people):
    out = sampling.budgets(people, [5, 20], [1, 2])
    small = out.where("n_train = 5").select("subset_seed", "patient_id")
    large = out.where("n_train = 20").select("subset_seed", "patient_id")
    assert small.count() == 10 and small.exceptAll(large).count() == 0


def test_other_sites_are_all_test(spark, people):
    out = sampling.site_split(people, train_site=0)
    assert {r.role for r in out.where("site <> 0").select("role").distinct().collect()} == {"test"}
    assert out.where("role = 'development'").count() == int(35 * 0.8)
    assert [r.site for r in sampling.missing_sites(people, [0, 1, 7]).collect()] == [7]


def test_site_split_refuses_repeats_and_empty_sites(spark):
    people = spark.createDataFrame([(f"p{i}", i % 3) for i in range(60)], "patient_id string, site int")
    assert sampling.site_split(people, sites=[0, 1, 2]).count() == 60
    cases = [
        (people.union(people.limit(4)), {}, "4 entities are repeated"),
        (people.unionByName(spark.createDataFrame([("p0", 2)], "patient_id string, site int")), {}, "1 entities are repeated"),
        (people, {"sites": [0, 9, 7]}, "no entity at site 7, 9"),
        (people, {"train_site": 5}, "site 5 cannot be split"),
        (people, {"train_fraction": 0.01}, "site 0 cannot be split"),
    ]
    for rows, options, message in cases:
        with pytest.raises(Exception, match=message):
            sampling.site_split(rows, **options).collect()
    with pytest.raises(ValueError):
        sampling.site_split(people, train_fraction=1.0)


def test_driver_draws_equal_column_draws(spark):
    row = spark.range(1).select(draw(3, "x", F.lit(4)).alias("d"), normal(3, "x", F.lit(4)).alias("z")).first()
    assert row.d == driver_draw(3, "x", 4)
    assert row.z == pytest.approx(driver_normal(3, "x", 4), abs=1e-12)


def test_nearest_match_prefers_the_smaller_on_a_tie(spark):
    targets = spark.createDataFrame([("g", 1, 5.0), ("g", 2, 100.0), ("h", 3, 1.0)], "g string, t int, v double")
    offers = spark.createDataFrame([("g", 10, 4.0), ("g", 11, 6.0), ("g", 12, 6.0)], "g string, c int, v double")
    out = sampling.nearest_match(targets, offers, "v", by=["g"], target_id="t", candidate_id="c")
    assert {r.t: r.c for r in out.collect()} == {1: 10, 2: 11, 3: None}


def test_nearest_match_cuts_equal_values(spark):
    targets = spark.createDataFrame([("g", i, float(i % 3)) for i in range(300)], "g string, t int, v double")
    offers = spark.createDataFrame([("g", 10 + i, i * 0.7) for i in range(6)], "g string, c int, v double")
    options = {"by": ["g"], "target_id": "t", "candidate_id": "c"}
    whole = sampling.nearest_match(targets, offers, "v", **options)
    cut = sampling.nearest_match(targets, offers, "v", max_rows=40, **options)
    assert sorted(map(repr, whole.collect())) == sorted(map(repr, cut.collect()))
    assert {r.t % 3: r.c for r in cut.collect()} == {0: 10, 1: 11, 2: 13}


@pytest.mark.parametrize("max_rows", [20, 100_000])
def test_mar_mask_equals_the_sequential_rule(spark, max_rows):
    rows = [(f"p{i % 3}" if i % 4 else "hot", i * 10, i, "a", i % 2, math.sin(i)) for i in range(600)]
    df = spark.createDataFrame(rows, "patient_id string, us bigint, seq bigint, code string, site int, state double")
    out = missingness.apply_missingness(df, "mar", ("a", "b", "c"), seed=4, max_rows=max_rows)
    got = {r.seq: r.kept for r in out.collect()}
    u = {r.seq: r.u for r in df.withColumn("u", uniform(4, "keep", F.col("patient_id"), F.col("us"), F.col("seq"))).collect()}
    assert len(got) == 600
    previous = {}
    for p, _, seq, _, _, state in rows:
        logit = -0.6 + 0.8 * previous.get(p, 0.0)
        kept = u[seq] < min(max(1 / (1 + math.exp(-logit)), 0.02), 0.98)
        assert got[seq] == kept
        if kept:
            previous[p] = state


def test_unknown_regime_is_rejected():
    with pytest.raises(ValueError):
        missingness.keep_probability("other", ("a",), None)


def test_noise_scale_by_site_and_code(spark):
    df = spark.createDataFrame([("p", 0, 0, "b", 1, 1.0)], "patient_id string, us bigint, seq bigint, code string, site int, value double")
    assert missingness.add_noise(df, "site_shift", ("a", "b", "c"), base_scale=2.0).first().noise_scale == pytest.approx(1.4)
    assert missingness.add_noise(df, "mcar", ("a", "b", "c"), base_scale=2.0).first().noise_scale == 2.0


def test_unequal_seed_lists_are_an_error(spark):
    df = spark.createDataFrame([([1, 2], [3])], "a array<bigint>, b array<bigint>")
    with pytest.raises(Exception, match="equal lengths"):
        grids.zip_seeds(df, ["a", "b"]).collect()


def test_an_empty_first_list_takes_the_default(spark):
    df = spark.createDataFrame([([], [3])], "a array<bigint>, b array<bigint>")
    assert [tuple(r) for r in grids.zip_seeds(df, ["a", "b"], default=7).collect()] == [(0, 7, 3)]


@pytest.mark.parametrize("m", [1, 2])
def test_each_pair_of_factors_meets_once_in_an_orthogonal_array(spark, m):
    levels = F.array(*[F.lit(i) for i in range(5)])
    out = grids.plan_orthogonal(spark.range(1), levels, levels, levels, multiplier=m)
    assert out.count() == 25
    for pair in (["cohort_seed", "model_seed"], ["subset_seed", "model_seed"]):
        assert out.select(pair).distinct().count() == 25


def test_plan_hash_ignores_order_and_sees_content(spark, people):
    h = lambda df: grids.plan_hash(df, ["patient_id", "site"]).first()
    assert h(people) == h(people.orderBy(F.desc("patient_id")))
    assert h(people) != h(people.where("patient_id <> '5'"))


def test_plan_hash_tells_separators_and_nulls_apart(spark):
    rows = [("a|b", "c"), ("a", "b|c"), ("", None), (None, "")]
    plans = [spark.createDataFrame([r], "x string, y string") for r in rows]
    assert len({grids.plan_hash(p, ["x", "y"]).first().plan_sha256 for p in plans}) == 4


def test_short_pools_and_repeated_entities_are_not_passed_over(spark):
    pool = spark.range(8).select(F.col("id").cast("string").alias("patient_id"))
    out = sampling.budgets(pool, [5, 10], [1, 2])
    short = out.where("role = 'shortfall'").select("subset_seed", "n_train", "patient_id").collect()
    assert sorted(tuple(r) for r in short) == [(1, 10, None), (2, 10, None)]
    assert out.where("n_train = 5").count() == 10
    assert sampling.budgets(pool.limit(0), [5], [1]).collect()[0].role == "shortfall"
    assert sampling.sample_entities(pool, 8, 1).count() == 8
    for action in (sampling.sample_entities(pool, 9, 1), sampling.split_entities(pool.union(pool))):
        with pytest.raises(Exception, match="wanted from a pool|are repeated"):
            action.collect()
