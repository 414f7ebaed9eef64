import pytest
from pyspark.sql import functions as F

from longspark.operators import decisions, traces


def staged(spark, deltas):
    rows = [("s", n, float(d)) for n, ds in deltas.items() for d in ds]
    return spark.createDataFrame(rows, "study string, n_train int, delta_mae double").withColumn("delta_r2", F.lit(0.0))


@pytest.mark.parametrize(
    "final,small,label",
    [
        ([1, 1, 1, 1, -1], [-1] * 5, "reproduced"),
        ([1, 1, 1, -1, -1], [-1] * 5, "ambiguous"),
        ([1, 1, -1, -1, -5], [-1] * 5, "not_reproduced"),
        ([9, 9, -1, -1, -1], [-1] * 5, "not_reproduced"),
        ([1, 1, 1, 1, 1], [1] * 5, "ambiguous"),
    ],
)
def test_reproduction_class(spark, final, small, label):
    table = staged(spark, {5: small, 10: [-1] * 5, 20: [0] * 5, 40: final})
    assert decisions.reproduction_class(table, ["study"]).first().classification == label


def stats(spark, **changes):
    base = dict(
        mean_g=0.1, mean_ci_lower=0.01, positive_contexts=5, positive_models=9, valid_replicates=100, resamples=100,
        ratio=0.8, ratio_ci_upper=0.9,
    )
    base.update(changes)
    return spark.createDataFrame([tuple(base.values())], _ddl(base))


def _ddl(base):
    return ", ".join(f"{k} {'bigint' if isinstance(v, int) else 'double'}" for k, v in base.items())


@pytest.mark.parametrize(
    "changes,label",
    [
        ({}, "effect_and_heterogeneity"),
        ({"mean_g": -0.1}, "not_established"),
        ({"mean_ci_lower": 0.0}, "not_established"),
        ({"positive_contexts": 3}, "not_established"),
        ({"positive_models": 7}, "not_established"),
        ({"valid_replicates": 99}, "effect_only"),
        ({"ratio": 1.0}, "effect_only"),
        ({"ratio_ci_upper": 1.1}, "effect_only"),
    ],
)
def test_interaction_class(spark, changes, label):
    assert decisions.interaction_class(stats(spark, **changes)).first().classification == label


def test_null_ratio_fails_closed(spark):
    df = stats(spark).withColumn("ratio_ci_upper", F.lit(None).cast("double"))
    assert decisions.interaction_class(df).first().classification == "effect_only"


ROUTE = {
    "interaction_ambiguity": False, "checkpoint_state": "unresolved", "state_model": "unresolved", "state_subset": "unresolved",
    "state_cohort": "unresolved", "sample_complexity_state": "absent", "disconnect_state": "unresolved",
}


@pytest.mark.parametrize(
    "changes,triggered",
    [
        ({}, []),
        ({"state_model": "strengthened"}, ["D4_OPTIMIZATION"]),
        ({"interaction_ambiguity": True, "checkpoint_state": "strengthened"}, ["D2B", "D4_CHECKPOINT"]),
        ({"state_cohort": "strengthened", "sample_complexity_state": "partial"}, ["D4_DATA_REGIME", "D4_CAPACITY_TIME"]),
        ({"disconnect_state": "strengthened"}, ["D4_CAPACITY_TIME"]),
    ],
)
def test_route(spark, changes, triggered):
    row = {**ROUTE, **changes}
    ddl = ", ".join(f"{k} {'boolean' if isinstance(v, bool) else 'string'}" for k, v in row.items())
    out = decisions.route(spark.createDataFrame([tuple(row.values())], ddl)).first()
    assert out.triggered == triggered and out.next_stage == (triggered[0] if triggered else "STOP")


@pytest.mark.parametrize("lower,models,label", [(0.1, 10, "stable"), (-0.1, 10, "ambiguous"), (0.1, 4, "fragile")])
def test_stability_class(spark, lower, models, label):
    rows = [(c, m, 1.0 if m < models else -0.5) for c in range(5) for m in range(10)]
    effects = spark.createDataFrame(rows, "context int, model int, delta_mae double")
    interval = spark.createDataFrame([(lower, 1.0)], "ci_lower double, ci_upper double")
    assert decisions.stability_class(effects, interval, [], row="context", col="model").first().classification == label


def test_array_agreement(spark):
    rows = [("a", 5, "model", "weak"), ("a", 40, "model", "dominant"), ("b", 5, "cohort", "weak"), ("b", 40, "model", "dominant")]
    ddl = "design string, n_train int, component string, factor_classification string"
    assert decisions.array_agreement(spark.createDataFrame(rows, ddl), []).first().evidence == "sufficient"
    rows[3] = ("b", 40, "model", "weak")
    assert decisions.array_agreement(spark.createDataFrame(rows, ddl), []).first().evidence == "insufficient"


LOSSES = [5.0, 4.0, 4.0, 4.5, 3.0, 3.5, 3.4, 3.3, 3.2]


@pytest.mark.parametrize("max_rows", [3, 100])
def test_best_so_far_and_patience(spark, max_rows):
    rows = [("r", i + 1, v, 10.0 - i) for i, v in enumerate(LOSSES)]
    trace = spark.createDataFrame(rows, "run string, epoch int, loss double, mae double")
    best = traces.best_so_far(trace, ["run"], "loss", shadow="mae", max_rows=max_rows)
    got = [(r.best_epoch, r.stale_epochs) for r in best.orderBy("epoch").collect()]
    assert got == [(1, 0), (2, 0), (2, 1), (2, 2), (5, 0), (5, 1), (5, 2), (5, 3), (5, 4)]
    assert traces.patience_stop(best, ["run"], 3).first().patience_epoch == 8
    assert traces.patience_stop(best, ["run"], 9).first().patience_epoch is None
    out = traces.run_summary(best, ["run"], "loss", "mae", 3).first()
    assert tuple(out)[1:] == (5, 8, 8, "patience_exhausted")


def test_trace_check_finds_each_fault(spark):
    rows = [("ok", 0, 1, 1.0), ("ok", 1, 2, 1.0), ("bad", 0, 2, 1.0), ("bad", 1, 2, float("inf")), ("bad", 2, 0, None)]
    trace = spark.createDataFrame(rows, "run string, at int, epoch int, loss double")
    ends = spark.createDataFrame(
        [("ok", 2, 1, 1), ("bad", 9, 1, 1), ("gone", 1, 1, 1)],
        "run string, stop_epoch int, selected_checkpoint_epoch int, shadow_mae_checkpoint_epoch int",
    )
    out = {r.run: tuple(r)[1:] for r in traces.trace_check(trace, ends, ["run"], ["loss"], order="at").collect()}
    assert out == {"ok": (0, 0, 0, True), "bad": (2, 1, 2, False), "gone": (0, 0, 0, False)}
