import pytest
from pyspark.sql import functions as F

from longspark.operators import asof, history, timeline
from longspark.schema import Task

DAY = 86_400_000_000
TASK = Task(("a", "b"), "intervention", 3.0, ("drug",))
SCHEMA = (
    "patient_id string, us bigint, seq bigint, code string, value double, event_type string, opportunity boolean"
)


def make(spark, rows):
    full = [(p, int(t * DAY), i, c, v, k, o) for i, (p, t, c, v, k, o) in enumerate(rows)]
    return spark.createDataFrame(full, SCHEMA)


def obs(p, t, c, v):
    return (p, t, c, v, "observation", False)


def drug(p, t):
    return (p, t, "drug", None, "intervention", False)


def anchor(p, t):
    return (p, t, "visit", None, "encounter", True)


def by_step(df, *columns):
    return [tuple(r) for r in df.orderBy("patient_id", "us").select(*columns).collect()]


def test_last_of_equal_time_and_code_wins(spark):
    e = make(spark, [obs("p", 0, "a", 1.0), obs("p", 0, "a", 2.0), obs("p", 0, "b", 5.0)])
    s = timeline.group_instants(e, TASK)
    assert by_step(s, "value_a", "mask_a", "value_b", "n_a", "n_events") == [(2.0, 1, 5.0, 2, 3)]


def test_null_and_nan_values_are_not_observed(spark):
    e = make(spark, [obs("p", 0, "a", None), obs("p", 0, "b", float("nan")), obs("p", 0, "c", 1.0)])
    s = timeline.group_instants(e, TASK)
    assert by_step(s, "mask_a", "mask_b", "value_a", "value_b", "update_mask") == [(0, 0, 0.0, 0.0, 1)]


def test_only_measurement_opportunities_leave_the_state_alone(spark):
    s = timeline.group_instants(make(spark, [anchor("p", 0), anchor("p", 1)]), TASK)
    assert by_step(s, "update_mask", "mask_a", "is_encounter") == [(0, 0, 1), (0, 0, 1)]


def test_an_anchor_beside_an_observation_updates(spark):
    s = timeline.group_instants(make(spark, [anchor("p", 0), obs("p", 0, "a", 1.0)]), TASK)
    assert by_step(s, "update_mask") == [(1,)]


def test_horizon_excludes_now_and_includes_its_end(spark):
    e = make(spark, [drug("p", 0), obs("p", 1, "a", 1.0), drug("p", 4), obs("p", 4.5, "a", 1.0), obs("p", 7.5, "a", 1.0)])
    out = timeline.horizon_label(timeline.group_instants(e, TASK), TASK)
    # day 0: none in (0, 3]; day 1: the one at exactly 4; day 4.5: valid up to exactly 7.5
    assert by_step(out, "horizon_label", "horizon_valid") == [(0, 1), (1, 1), (0, 1), (0, 1), (0, 0)]


def test_jump_needs_an_allowed_intervention_code(spark):
    e = make(spark, [drug("p", 0), ("p", 1, "other", None, "intervention", False)])
    assert by_step(timeline.group_instants(e, TASK), "jump_eligible") == [(1,), (0,)]


def test_strict_history_ignores_the_instant_and_inclusive_counts_it(spark):
    e = make(spark, [obs("p", 0, "a", 1.0), obs("p", 2, "a", 3.0), drug("p", 2), obs("p", 5, "b", 9.0)])
    s = timeline.group_instants(e, TASK)
    strict = history.history_features(s, TASK, strict=True)
    inclusive = history.history_features(s, TASK, strict=False)
    names = ("last_a", "since_a", "count_a", "count_intervention", "elapsed_days")
    assert by_step(strict, *names) == [(0.0, 0.0, 0, 0, 0.0), (1.0, 2.0, 1, 0, 2.0), (3.0, 3.0, 2, 1, 5.0)]
    assert by_step(inclusive, *names) == [(1.0, 0.0, 1, 0, 0.0), (3.0, 0.0, 2, 1, 2.0), (3.0, 3.0, 2, 1, 5.0)]


def test_a_code_never_seen_takes_elapsed_time(spark):
    e = make(spark, [obs("p", 0, "a", 1.0), obs("p", 4, "a", 1.0)])
    out = history.history_features(timeline.group_instants(e, TASK), TASK)
    assert by_step(out, "last_b", "since_b", "count_b") == [(0.0, 0.0, 0), (0.0, 4.0, 0)]


PAST = [obs("p", 0, "a", 1.0), drug("p", 1), obs("p", 2, "b", 2.0), obs("q", 1, "a", 5.0)]
FUTURE = [obs("p", 9, "a", 99.0), drug("p", 9), obs("q", 8, "b", 77.0)]


@pytest.mark.parametrize("strict", [True, False])
def test_future_rows_never_change_a_feature(spark, strict):
    names = ["patient_id", "us", *history.feature_names(TASK)]
    before = history.history_features(timeline.group_instants(make(spark, PAST), TASK), TASK, strict=strict)
    after = history.history_features(timeline.group_instants(make(spark, PAST + FUTURE), TASK), TASK, strict=strict)
    assert by_step(before, *names) == by_step(after.where(F.col("us") < 8 * DAY), *names)


def test_the_label_does_not_depend_on_how_often_one_looks(spark):
    dense = PAST + FUTURE + [obs("p", t / 10, "a", 1.0) for t in range(1, 80)]
    thin = timeline.horizon_label(timeline.group_instants(make(spark, PAST + FUTURE), TASK), TASK)
    full = timeline.horizon_label(timeline.group_instants(make(spark, dense), TASK), TASK)
    keep = ["patient_id", "us", "horizon_label", "horizon_valid"]
    assert thin.select(keep).exceptAll(full.select(keep)).count() == 0


def test_next_targets_end_with_zeros(spark):
    e = make(spark, [obs("p", 0, "a", 1.0), obs("p", 1, "a", 7.0)])
    out = timeline.next_targets(timeline.group_instants(e, TASK), TASK)
    assert by_step(out, "next_value_a", "next_mask_a") == [(7.0, 1), (0.0, 0)]


def test_gap_saturation(spark):
    e = make(spark, [obs("p", 0, "a", 1.0), obs("p", 30, "a", 1.0)])
    out = timeline.gap_features(timeline.group_instants(e, TASK), tau_days=30.0)
    assert by_step(out, "gap_days", "gap_saturation") == [(0.0, 0.0), (30.0, 0.5)]


def test_empty_table(spark):
    assert history.cohort_sequences(make(spark, []), TASK).count() == 0


def test_one_row(spark):
    out = history.cohort_sequences(make(spark, [obs("p", 0, "a", 1.0)]), TASK)
    assert by_step(out, "step", "elapsed_days", "gap_days", "horizon_valid", "next_mask_a") == [(0, 0.0, 0.0, 0, 0)]


@pytest.fixture(scope="module")
def busy(spark):
    """One entity with most of the events, and a few quiet ones."""
    rows = []
    for i in range(400):
        kind = i % 5
        rows.append(drug("hot", i / 7) if kind == 4 else obs("hot", i / 7, "ab"[i % 2], float(i % 13)))
    rows += [obs(f"p{i % 20}", i / 3, "a", float(i)) for i in range(100)]
    return make(spark, rows).persist()


def same(a, b):
    columns = a.columns
    return a.exceptAll(b.select(columns)).count() == 0 and b.select(columns).exceptAll(a).count() == 0


def test_a_heavy_entity_in_chunks_gives_the_same_sequences(spark, busy):
    plain = history.cohort_sequences(busy, TASK, representation_dims=3)
    cut = history.cohort_sequences(busy, TASK, representation_dims=3, max_rows=40)
    assert same(plain, cut)


def test_a_heavy_entity_in_chunks_gives_the_same_lookups(spark, busy):
    steps = timeline.group_instants(busy.where("us % 2 = 0"), TASK)
    truth = busy.where("event_type = 'observation'").select("patient_id", "us", "seq", "code", "value")
    for find in (asof.next_truth_asof, asof.nearest_asof):
        assert same(find(steps, truth, TASK), find(steps, truth, TASK, max_rows=40))


def test_a_long_timeline_comes_in_bounded_parts(spark, busy):
    parts = timeline.timeline_array(busy, max_rows=50)
    assert parts.agg(F.max(F.size("events"))).first()[0] <= 50
    assert parts.agg(F.sum(F.size("events"))).first()[0] == busy.count()


def test_one_instant_and_equal_events_are_cut(spark):
    rows = [("p", 7, i // 2, "a", float(i // 4), "observation") for i in range(400)] + [("q", 1, 0, "a", 1.0, "observation")]
    df = spark.createDataFrame(rows, "patient_id string, us bigint, seq bigint, code string, value double, event_type string")
    answers = []
    for spread in (df.repartition(1), df.repartition(9)):
        out = timeline.timeline_array(spread, max_rows=50, cell_rows=90).orderBy("patient_id", "part").collect()
        assert [(r.patient_id, r.part, len(r.events)) for r in out] == [("p", i, 50) for i in range(8)] + [("q", 0, 1)]
        assert [e.seq for r in out[:8] for e in r.events] == sorted(i // 2 for i in range(400))
        answers.append([repr(r) for r in out])
    assert answers[0] == answers[1]
    whole = timeline.timeline_array(df).orderBy("patient_id").collect()
    assert [(r.part, len(r.events)) for r in whole] == [(0, 400), (0, 1)]
    with pytest.raises(ValueError):
        timeline.timeline_array(df, max_rows=0)


def test_nearest_takes_the_earlier_on_a_tie(spark):
    steps = timeline.group_instants(make(spark, [drug("p", 2)]), TASK)
    truth = make(spark, [obs("p", 1, "a", 10.0), obs("p", 3, "a", 30.0)])
    assert by_step(asof.nearest_asof(steps, truth, TASK), "truth_value_a") == [(10.0,)]
    assert by_step(asof.next_truth_asof(steps, truth, TASK), "truth_value_a", "truth_value_b") == [(30.0, None)]


def test_truth_at_the_instant_is_nearest_but_not_next(spark):
    steps = timeline.group_instants(make(spark, [drug("p", 2)]), TASK)
    truth = make(spark, [obs("p", 2, "a", 20.0), obs("p", 3, "a", 30.0)])
    assert by_step(asof.nearest_asof(steps, truth, TASK), "truth_value_a") == [(20.0,)]
    assert by_step(asof.next_truth_asof(steps, truth, TASK), "truth_value_a") == [(30.0,)]


def test_padding_keeps_every_step(spark, busy):
    steps = timeline.group_instants(busy, TASK)
    out = timeline.pad_sequences(steps, ["value_a"], 64, max_rows=40)
    assert out.agg(F.min(F.size("value_a")), F.max(F.size("value_a"))).first() == (64, 64)
    valid = F.aggregate("valid", F.lit(0.0), lambda a, x: a + x)
    assert out.agg(F.sum(valid)).first()[0] == steps.count()


def test_task_rejects_bad_arguments():
    for bad in (((),), (("a", "a"),), (("a",), "other"), (("a",), "encounter", 0.0)):
        with pytest.raises(ValueError):
            Task(*bad)
