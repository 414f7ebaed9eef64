"""Queries over fits, forecasts and their metrics."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from longspark.catalog.fixtures import (
    EV,
    H_US,
    TASK,
    R,
    events,
    r6,
    rounded,
    table,
)
from longspark.catalog.registry import query
from longspark.catalog.sampling import ENT, _entities, _rank
from longspark.catalog.timelines import _HORIZON, EXAMPLES, examples
from longspark.operators import fit, history, metrics, timeline
from longspark.plans import benchmark
from longspark.session import materialize

# point forecasts: last value, with the code's overall scale
PTS = (
    f"{EXAMPLES}, pts AS (SELECT patient_id, us, step, code, target AS y, last_value AS mean, running_mean,"
    " ln(stddev_samp(target) OVER (PARTITION BY code)) AS log_scale FROM ex)"
)


def points(spark, sf):
    return _points(materialize(examples(spark, sf)))


def _points(ex):
    scale = ex.groupBy("code").agg(F.log(F.stddev_samp("target")).alias("log_scale"))
    # one row per value code of the task
    return ex.join(F.broadcast(scale), "code").select(
        "patient_id",
        "us",
        "step",
        "code",
        F.col("target").alias("y"),
        F.col("last_value").alias("mean"),
        "running_mean",
        "log_scale",
        *[c for c in ex.columns if c == "site"],
    )


RISK = (
    f"{EXAMPLES}, {_HORIZON}, risk AS (SELECT r.patient_id, r.us, CAST(r.patient_id AS BIGINT) % 10 AS cohort,"
    " CAST(h.ok AND h.hit AS BIGINT) AS label, CAST(h.ok AS BIGINT) AS valid,"
    " least(coalesce(sum(r.n_intervention) OVER (PARTITION BY r.patient_id ORDER BY r.us"
    " ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) / (r.step + 1)::DOUBLE, 1.0::DOUBLE) AS probability"
    " FROM run r JOIN h ON h.patient_id = r.patient_id AND h.us = r.us)"
)


def risks(spark, sf):
    return _risks(history.cohort_sequences(events(spark, sf, hourly=True), TASK, strict=True))


def _risks(seq):
    rate = F.col("count_intervention") / (F.col("step") + 1).cast("double")
    return seq.select(
        "patient_id",
        "us",
        (F.col("patient_id").cast("bigint") % 10).alias("cohort"),
        F.col("horizon_label").alias("label"),
        F.col("horizon_valid").alias("valid"),
        F.least(rate, F.lit(1.0)).alias("probability"),
    )


def _by_code(name: str, sql: str, column):
    @query(name, f"WITH {PTS} SELECT code, {R(sql)} AS {name} FROM pts GROUP BY code")
    def _(spark, sf):
        out = points(spark, sf).groupBy("code").agg(
            column(F.col("y"), F.col("mean"), F.col("log_scale")).alias(name)
        )
        return rounded(out, name)


_S = "least(greatest(log_scale, -7.0::DOUBLE), 7.0::DOUBLE)"
_NLL = f"(0.5::DOUBLE * power((y - mean) / exp({_S}), 2) + {_S} + 0.5::DOUBLE * ln(2.0::DOUBLE * pi()))"
_HALF = "(0.5::DOUBLE * power(y - mean, 2))"
_IN90 = (
    f"CASE WHEN y >= mean - 1.6448536269514722::DOUBLE * exp({_S}) AND y <= mean + 1.6448536269514722::DOUBLE * exp({_S})"
    " THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
)
_by_code("mae", "avg(abs(y - mean))", lambda y, m, s: metrics.mae(y, m))
_by_code("rmse", "sqrt(avg(power(y - mean, 2)))", lambda y, m, s: metrics.rmse(y, m))
_by_code("gaussian_nll", f"avg({_NLL})", metrics.gaussian_nll)
_by_code("coverage_90", f"avg({_IN90})", metrics.coverage_90)
_by_code(
    "interval_coverage",
    "avg(CASE WHEN y BETWEEN mean - exp(log_scale) AND mean + exp(log_scale) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)",
    lambda y, m, s: metrics.interval_coverage(y, m - F.exp(s), m + F.exp(s)),
)

_Q = "least(greatest(probability, 1e-7::DOUBLE), (1.0 - 1e-7)::DOUBLE)"
_BRIER = f"avg(power({_Q} - label, 2))"
_LOG = f"-avg(label * ln({_Q}) + (1 - label) * ln(1.0::DOUBLE - {_Q}))"


@query("brier", f"WITH {RISK} SELECT cohort, {R(_BRIER)} AS brier FROM risk WHERE valid = 1 GROUP BY cohort")
def _(spark, sf):
    rows = risks(spark, sf).where("valid = 1").groupBy("cohort")
    out = rows.agg(metrics.brier(F.col("label"), F.col("probability")).alias("brier"))
    return rounded(out, "brier")


@query("log_loss", f"WITH {RISK} SELECT cohort, {R(_LOG)} AS log_loss FROM risk WHERE valid = 1 GROUP BY cohort")
def _(spark, sf):
    rows = risks(spark, sf).where("valid = 1").groupBy("cohort")
    y = F.col("label").cast("double")
    return rounded(rows.agg(metrics.log_loss(y, F.col("probability")).alias("log_loss")), "log_loss")


def _auc_sql(source: str, by: str) -> str:
    # mid-ranks of the pooled scores
    return (
        f"(SELECT {by}, CASE WHEN sum(label) > 0 AND sum(1 - label) > 0 THEN"
        " (sum(CASE WHEN label = 1 THEN mid ELSE 0.0::DOUBLE END) - sum(label) * (sum(label) + 1) / 2.0::DOUBLE)"
        " / (sum(label) * sum(1 - label))::DOUBLE END AS auc FROM"
        f" (SELECT {by}, label, rank() OVER (PARTITION BY {by} ORDER BY score)"
        f" + (count(*) OVER (PARTITION BY {by}, score) - 1) / 2.0::DOUBLE AS mid FROM ({source})) GROUP BY {by})"
    )


@query(
    "roc_auc",
    "SELECT source, CASE WHEN auc IS NULL THEN NULL ELSE "
    + R("auc")
    + " END AS roc_auc FROM "
    + _auc_sql(
        "SELECT d.source, CAST(l.quality AS BIGINT) AS label, d.n_chars::DOUBLE AS score FROM labels l JOIN documents d ON d.doc_id = l.doc_id",
        "source",
    ),
)
def _(spark, sf):
    rows = table(spark, sf, "labels").join(table(spark, sf, "documents"), "doc_id")
    out = metrics.roc_auc(rows, ["source"], "quality", F.col("n_chars").cast("double"))
    return rounded(out, "roc_auc")


_EVENT_AUC = _auc_sql(f"SELECT cohort, label, {_Q} AS score FROM risk WHERE valid = 1", "cohort")
_EVENT = (
    f"evm AS (SELECT cohort, {_BRIER} AS b, {_LOG} AS l FROM risk WHERE valid = 1 GROUP BY cohort), auc AS {_EVENT_AUC}"
)


@query(
    "event_metrics",
    f"WITH {RISK}, {_EVENT} SELECT cohort, {R('b')} AS event_brier, {R('l')} AS event_log_loss,"
    f" {R('auc')} AS event_roc_auc FROM evm JOIN auc USING (cohort)",
)
def _(spark, sf):
    out = metrics.event_metrics(risks(spark, sf), ["cohort"])
    return rounded(out, "event_brier", "event_log_loss", "event_roc_auc")


@query(
    "evaluate",
    f"WITH {RISK}, {_EVENT}, pts AS (SELECT *, target AS y, last_value AS mean,"
    " CAST(patient_id AS BIGINT) % 10 AS cohort, ln(stddev_samp(target) OVER (PARTITION BY code)) AS log_scale FROM ex),"
    f" pm AS (SELECT cohort, avg(abs(y - mean)) AS mae, sqrt(avg(power(y - mean, 2))) AS rmse, avg({_NLL}) AS nll,"
    f" avg({_IN90}) AS cov FROM pts GROUP BY cohort)"
    f" SELECT cohort, {R('mae')} AS mae, {R('rmse')} AS rmse, {R('nll')} AS nll, {R('cov')} AS coverage_90,"
    f" {R('b')} AS event_brier, {R('l')} AS event_log_loss, {R('auc')} AS event_roc_auc"
    " FROM pm JOIN evm USING (cohort) JOIN auc USING (cohort)",
)
def evaluate_query(spark, sf):
    seq = materialize(history.cohort_sequences(events(spark, sf, hourly=True), TASK))
    pts = _points(history.forecast_examples(seq, TASK, []))
    pts = pts.withColumn("cohort", F.col("patient_id").cast("bigint") % 10)
    out = metrics.evaluate(pts, _risks(seq), ["cohort"])
    return rounded(out, *[c for c in out.columns if c != "cohort"])


_MASK = "CASE WHEN step % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


def _masked(term: str) -> str:
    return f"sum({term} * {_MASK}) / greatest(sum({_MASK}), 1.0::DOUBLE)"


@query(
    "masked_mean_loss",
    f"WITH {PTS} SELECT code, {R(_masked(_NLL))} AS gaussian, {R(_masked(_HALF))} AS half_mse,"
    f" {R(_masked(_NLL.replace('(y - mean)', '(y - running_mean)')))} AS residual FROM pts GROUP BY code",
)
def _(spark, sf):
    mask = (F.col("step") % 2 == 0).cast("int")
    y, m, s = F.col("y"), F.col("mean"), F.col("log_scale")
    residual = y - F.col("running_mean")
    out = points(spark, sf).groupBy("code").agg(
        metrics.masked_mean(metrics.gaussian_term(y, m, s), mask).alias("gaussian"),
        metrics.masked_mean(metrics.half_squared_term(y, m), mask).alias("half_mse"),
        metrics.masked_mean(metrics.gaussian_term(residual, F.lit(0.0), s), mask).alias("residual"),
    )
    return rounded(out, "gaussian", "half_mse", "residual")


_LOGIT = "(4.0::DOUBLE * probability - 2.0::DOUBLE)"


def _bce(y: str) -> str:
    return f"(greatest({_LOGIT}, 0.0::DOUBLE) - {_LOGIT} * {y} + ln(1.0::DOUBLE + exp(-abs({_LOGIT}))))"


_LOSS = (
    f"loss AS (SELECT cohort, sum({_bce('label')} * valid) / greatest(sum(valid), 1)::DOUBLE AS event_bce FROM risk GROUP BY cohort),"
    " obs AS (SELECT r.cohort, q.mask, r.probability FROM risk r JOIN ("
    + " UNION ALL ".join(
        f"SELECT patient_id, us, mask_{c} AS mask FROM run" for c in TASK.value_codes
    )
    + ") q ON q.patient_id = r.patient_id AND q.us = r.us),"
    f" ol AS (SELECT cohort, avg({_bce('mask')}) AS observation_bce FROM obs GROUP BY cohort)"
)


@query(
    "masked_bce",
    f"WITH {RISK}, {_LOSS} SELECT cohort, {R('event_bce')} AS event_bce, {R('observation_bce')} AS observation_bce"
    " FROM loss JOIN ol USING (cohort)",
)
def _(spark, sf):
    return rounded(_bce_frame(spark, sf), "event_bce", "observation_bce")


def _bce_frame(spark, sf):
    seq = history.cohort_sequences(events(spark, sf, hourly=True), TASK, strict=True)
    rate = F.least(F.col("count_intervention") / (F.col("step") + 1).cast("double"), F.lit(1.0))
    logit = F.lit(4.0) * rate - F.lit(2.0)
    per_code = [
        F.avg(metrics.logit_term(F.col(f"mask_{c}").cast("double"), logit)) for c in TASK.value_codes
    ]
    mean = per_code[0]
    for c in per_code[1:]:
        mean = mean + c
    cohort = (F.col("patient_id").cast("bigint") % 10).alias("cohort")
    return seq.groupBy(cohort).agg(
        metrics.masked_mean(
            metrics.logit_term(F.col("horizon_label").cast("double"), logit), F.col("horizon_valid")
        ).alias("event_bce"),
        (mean / F.lit(float(len(TASK.value_codes)))).alias("observation_bce"),
    )


@query(
    "total_loss",
    f"WITH {RISK}, {_LOSS}, v AS (SELECT CAST(patient_id AS BIGINT) % 10 AS cohort,"
    " avg(0.5::DOUBLE * power(target - last_value, 2)) AS value_loss FROM ex GROUP BY 1)"
    f" SELECT cohort, {R('value_loss + 1.0::DOUBLE * event_bce + 0.2::DOUBLE * observation_bce')} AS total_loss"
    " FROM v JOIN loss USING (cohort) JOIN ol USING (cohort)",
)
def _(spark, sf):
    value = (
        points(spark, sf)
        .groupBy((F.col("patient_id").cast("bigint") % 10).alias("cohort"))
        .agg(metrics.masked_mean(metrics.half_squared_term(F.col("y"), F.col("mean")), F.lit(1)).alias("v"))
    )
    joined = value.join(_bce_frame(spark, sf), "cohort")
    total = metrics.total_loss(F.col("v"), F.col("event_bce"), F.col("observation_bce"))
    return rounded(joined.select("cohort", total.alias("total_loss")), "total_loss")


@query(
    "naive_baselines",
    f"WITH {EXAMPLES} SELECT code, {R('avg(abs(target - last_value))')} AS last_value_mae,"
    f" {R('avg(abs(target - running_mean))')} AS running_mean_mae FROM ex GROUP BY code",
)
def _(spark, sf):
    y = F.col("target")
    out = examples(spark, sf).groupBy("code").agg(
        metrics.mae(y, F.col("last_value")).alias("last_value_mae"),
        metrics.mae(y, F.col("running_mean")).alias("running_mean_mae"),
    )
    return rounded(out, "last_value_mae", "running_mean_mae")


@query(
    "metric_rows",
    f"WITH {PTS} SELECT code, 'mae' AS metric, {R('avg(abs(y - mean))')} AS value FROM pts GROUP BY code UNION ALL"
    f" SELECT code, 'rmse', {R('sqrt(avg(power(y - mean, 2)))')} FROM pts GROUP BY code UNION ALL"
    f" SELECT code, 'nll', {R(f'avg({_NLL})')} FROM pts GROUP BY code UNION ALL"
    f" SELECT code, 'coverage_90', {R(f'avg({_IN90})')} FROM pts GROUP BY code",
)
def _(spark, sf):
    wide = points(spark, sf).groupBy("code").agg(
        *metrics.point_aggregates(F.col("y"), F.col("mean"), F.col("log_scale"))
    )
    return rounded(metrics.metric_rows(wide, ["mae", "rmse", "nll", "coverage_90"]), "value")


def _ridge_sql(source: str, x1: str, x2: str, y: str, by: str) -> str:
    """Closed form of a two-feature ridge with penalty 1."""
    n = "count(*)"
    a, b, c = f"({n} * var_pop({x1}) + 1)", f"({n} * covar_pop({x1}, {x2}))", f"({n} * var_pop({x2}) + 1)"
    u, v = f"({n} * covar_pop({x1}, {y}))", f"({n} * covar_pop({x2}, {y}))"
    return (
        f"SELECT {by}, n, w1, w2, my - m1 * w1 - m2 * w2 AS w0 FROM (SELECT {by}, count(*) AS n,"
        f" avg({x1}) AS m1, avg({x2}) AS m2, avg({y}) AS my,"
        f" ({c} * {u} - {b} * {v}) / ({a} * {c} - {b} * {b}) AS w1,"
        f" ({a} * {v} - {b} * {u}) / ({a} * {c} - {b} * {b}) AS w2 FROM {source} GROUP BY {by})"
    )


def _unpack_fit(out, by):
    return rounded(
        out.select(
            *by,
            "n",
            F.col("coefficients")[0].alias("w1"),
            F.col("coefficients")[1].alias("w2"),
            F.col("intercept").alias("w0"),
        ),
        "w0",
        "w1",
        "w2",
    )


@query(
    "fit_ridge",
    f"WITH {EXAMPLES}, f AS ({_ridge_sql('(SELECT *, 1 AS one FROM ex)', 'last_value', 'running_mean', 'target', 'one')})"
    f" SELECT n, {R('w0')} AS w0, {R('w1')} AS w1, {R('w2')} AS w2 FROM f",
)
def _(spark, sf):
    out = fit.fit_ridge(examples(spark, sf), ["last_value", "running_mean"], "target")
    return _unpack_fit(out, [])


@query(
    "fit_ridge_grouped",
    "WITH f AS ("
    + _ridge_sql("lineitem", "l_quantity", "l_discount", "l_tax", "l_suppkey")
    + f") SELECT l_suppkey, n, {R('w0')} AS w0, {R('w1')} AS w1, {R('w2')} AS w2 FROM f",
)
def _(spark, sf):
    out = fit.fit_ridge(
        table(spark, sf, "lineitem"), ["l_quantity", "l_discount"], "l_tax", by=("l_suppkey",)
    )
    return _unpack_fit(out, ["l_suppkey"])


_RISK_FEATURES = ["count_click", "count_view", "elapsed_days"]


@query("fit_logistic_balanced")
def _(spark, sf):
    seq = history.cohort_sequences(events(spark, sf, hourly=True), TASK).where("horizon_valid = 1")
    model = fit.fit_logistic_balanced(seq, _RISK_FEATURES, "horizon_label")
    out = fit.predict_model(
        model, seq.withColumnRenamed("horizon_label", "label"), _RISK_FEATURES
    )
    rows = out.select("patient_id", "us", "label", _second(out).alias("p"))
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_probability"))


def _second(out):
    from pyspark.ml.functions import vector_to_array

    return vector_to_array(out["probability"])[1]


_RETURNED = ["l_quantity", "l_discount", "l_tax"]


@query(
    "fit_logistic_grouped",
    # at the optimum of a convex loss its slope is zero in every direction
    "WITH g AS (SELECT l_suppkey, count(*) AS n, count(*) FILTER (WHERE l_returnflag = 'R') AS n_positive FROM lineitem GROUP BY 1)"
    " SELECT l_suppkey, n, n_positive, n_positive NOT IN (0, n) AS converged, "
    + ", ".join(f"CASE WHEN n_positive NOT IN (0, n) THEN 0.0::DOUBLE END AS slope{i}" for i in range(len(_RETURNED) + 1))
    + " FROM g",
)
def _(spark, sf):
    label = (F.col("l_returnflag") == "R").cast("int").alias("returned")
    rows = table(spark, sf, "lineitem").select("l_suppkey", *_RETURNED, label)
    fits = fit.fit_logistic_grouped(rows, _RETURNED, "returned", by=["l_suppkey"])
    out = fit.predict_logistic(rows, fits, _RETURNED, by=["l_suppkey"], name="p").join(fits, "l_suppkey")
    weight = F.col("n") / (2 * F.when(F.col("returned") == 1, F.col("n_positive")).otherwise(F.col("n") - F.col("n_positive")))
    off = weight * (F.col("p") - F.col("returned"))
    slopes = [F.sum(off * (F.col(_RETURNED[i - 1]).cast("double") if i else 1.0)) for i in range(len(_RETURNED) + 1)]
    keys = ["l_suppkey", "n", "n_positive", "converged", "coefficients"]
    out = out.groupBy(keys).agg(*[s.alias(f"s{i}") for i, s in enumerate(slopes)])
    slope = lambda i: F.col(f"s{i}") + (F.col("coefficients")[i] if i else 0.0)
    return out.select(*keys[:4], *[F.round(F.abs(slope(i)), 5).alias(f"slope{i}") for i in range(len(slopes))])


@query("fit_gbt")
def _(spark, sf):
    ex = examples(spark, sf)
    names = ["last_value", "running_mean", "elapsed_days"]
    model = fit.fit_gbt(ex, names, "target", trees=10, depth=3)
    out = fit.predict_model(model, ex, names)
    return out.groupBy("code").agg(metrics.mae(F.col("target"), F.col("prediction")).alias("mae"))


_SIZES, _SEEDS = [5, 10, 20, 40], [11, 12]
_FEATURES = ["last_value", "running_mean"]

_CELLS = (
    f"{EXAMPLES}, {ENT}, sp AS (SELECT *, {_rank('0', 'split', 'PARTITION BY site')} AS rk, count(*) OVER (PARTITION BY site) AS n FROM ent),"
    " pool AS (SELECT patient_id, site FROM sp WHERE rk <= floor(n * 0.8::DOUBLE)),"
    f" br AS (SELECT p.*, subset_seed, {_rank('subset_seed', 'sample', 'PARTITION BY site, subset_seed')} AS rk,"
    " count(*) OVER (PARTITION BY site, subset_seed) AS pn FROM pool p, (SELECT unnest([11, 12]) AS subset_seed)),"
    " bm AS (SELECT br.patient_id, br.site, br.subset_seed, n_train FROM br JOIN (SELECT unnest([5, 10, 20, 40]) AS n_train)"
    " ON rk <= n_train AND pn >= n_train),"
    f" bv AS (SELECT *, {_rank('subset_seed + 1', 'validation', 'PARTITION BY site, subset_seed, n_train')} AS vk FROM bm),"
    " fm AS (SELECT * FROM bv WHERE vk > greatest(1, least(n_train - 1, CAST(round_even(n_train * 0.2::DOUBLE, 0) AS BIGINT)))),"
    " fitx AS (SELECT ex.*, fm.site, fm.subset_seed, fm.n_train FROM ex JOIN fm ON fm.patient_id = ex.patient_id),"
    f" fits AS ({_ridge_sql('fitx', 'last_value', 'running_mean', 'target', 'site, subset_seed, n_train')}),"
    " test AS (SELECT ex.*, sp.site FROM ex JOIN sp ON sp.patient_id = ex.patient_id WHERE sp.rk > floor(sp.n * 0.8::DOUBLE)),"
    " sc AS (SELECT t.site, f.subset_seed, f.n_train, t.code, t.target, t.last_value AS p1, t.running_mean AS p2,"
    " f.w0 + f.w1 * t.last_value + f.w2 * t.running_mean AS p3 FROM test t JOIN fits f ON f.site = t.site),"
    " lng AS ("
    + " UNION ALL ".join(
        f"SELECT site, subset_seed, n_train, '{m}' AS model, abs(target - {p}) AS e FROM sc"
        for m, p in (("last_value", "p1"), ("running_mean", "p2"), ("ridge", "p3"))
    )
    + ")"
)
_CELL_KEYS = "site, CAST(subset_seed AS BIGINT) AS subset_seed, CAST(n_train AS BIGINT) AS n_train, model"


@query(
    "benchmark_cells",
    f"WITH {_CELLS} SELECT {_CELL_KEYS}, 'mae' AS metric, {R('avg(e)')} AS value FROM lng GROUP BY ALL UNION ALL"
    f" SELECT {_CELL_KEYS}, 'rmse', {R('sqrt(avg(e * e))')} FROM lng GROUP BY ALL",
)
def benchmark_query(spark, sf):
    out = benchmark.benchmark_cells(
        examples_with_site(spark, sf), _entities(spark, sf), _FEATURES, sizes=_SIZES, seeds=_SEEDS
    )
    return rounded(out, "value")


def examples_with_site(spark, sf):
    return examples(spark, sf).join(_entities(spark, sf), "patient_id")


#: Fits of site 0 only, for the test rows of both sites.
_TRANSFER = _CELLS.replace("JOIN fits f ON f.site = t.site", "JOIN fits f ON f.site = 0")


@query(
    "shift_benchmark",
    f"WITH {_TRANSFER}, m AS (SELECT {_CELL_KEYS}, avg(e) AS v FROM lng GROUP BY ALL)"
    f" SELECT subset_seed, n_train, model, 'site_' || site AS site_or_shift, {R('v')} AS value FROM m UNION ALL"
    f" SELECT a.subset_seed, a.n_train, a.model, 'site_1_minus_site_0', {R('a.v - b.v')} FROM m a JOIN m b"
    " USING (subset_seed, n_train, model) WHERE a.site = 1 AND b.site = 0",
)
def _(spark, sf):
    tidy = benchmark.benchmark_cells(
        examples_with_site(spark, sf), _entities(spark, sf), _FEATURES, sizes=_SIZES, seeds=_SEEDS, fit_on=0
    ).where("metric = 'mae'")
    return rounded(
        benchmark.shift_rows(tidy, ["subset_seed", "n_train", "model"]), "value"
    )


_C = {
    "a": "var_pop(l_discount)",
    "b": "covar_pop(l_discount, l_tax)",
    "c": "var_pop(l_tax)",
    "u1": "covar_pop(l_discount, l_quantity)",
    "u2": "covar_pop(l_tax, l_quantity)",
    "v1": "covar_pop(l_discount, l_extendedprice)",
    "v2": "covar_pop(l_tax, l_extendedprice)",
    "s": "var_pop(l_quantity)",
    "t": "var_pop(l_extendedprice)",
}
_MOMENTS = "SELECT l_suppkey, count(*) AS n, " + ", ".join(f"{v} AS {k}" for k, v in _C.items()) + " FROM lineitem GROUP BY 1"


def _quad(x, y):
    return f"(({x} * {x} * c - 2 * {x} * {y} * b + {y} * {y} * a) / (a * c - b * b))"


def _aligned(spark, sf):
    return metrics.latent_alignment(
        table(spark, sf, "lineitem"),
        ["l_suppkey"],
        ["l_quantity", "l_extendedprice"],
        ["l_discount", "l_tax"],
    )


@query(
    "aligned_r2",
    f"WITH m AS ({_MOMENTS}) SELECT l_suppkey, n, {R('(' + _quad('u1', 'u2') + ' + ' + _quad('v1', 'v2') + ') / (s + t)')} AS aligned_r2 FROM m",
)
def _(spark, sf):
    return rounded(_aligned(spark, sf).drop("procrustes"), "aligned_r2")


@query(
    "procrustes_error",
    f"WITH m AS ({_MOMENTS}) SELECT l_suppkey, n,"
    f" {R('1 - (u1 * u1 + u2 * u2 + v1 * v1 + v2 * v2 + 2 * abs(u1 * v2 - u2 * v1)) / ((s + t) * (a + c))')} AS procrustes FROM m",
)
def _(spark, sf):
    return rounded(_aligned(spark, sf).drop("aligned_r2"), "procrustes")
