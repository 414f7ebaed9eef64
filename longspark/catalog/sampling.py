"""Queries over splits, budgets, plans and missingness."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspark.catalog.fixtures import (
    EV1,
    TASK,
    R,
    events,
    r6,
    rounded,
    sql_draw,
    sql_normal,
    sql_uniform,
    table,
)
from longspark.catalog.registry import query
from longspark.functions.text import joined_name
from longspark.operators import missingness, sampling
from longspark.plans import grids

ENT = "ent AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS patient_id, user_id % 2 AS site FROM events)"


def _entities(spark, sf):
    return events(spark, sf).select("patient_id", "site").distinct()


def _rank(seed: str, stream: str, part: str = "") -> str:
    d = sql_draw(seed, f"'{stream}'", "patient_id")
    return f"row_number() OVER ({part} ORDER BY {d}, patient_id)"


@query(
    "split_entities",
    f"WITH {ENT}, r AS (SELECT *, {_rank('7', 'split')} AS rk, count(*) OVER () AS n FROM ent)"
    " SELECT patient_id, CASE WHEN rk <= floor(n * 0.7::DOUBLE) THEN 'train'"
    " WHEN rk <= floor(n * 0.7::DOUBLE) + floor(n * 0.1::DOUBLE) THEN 'val' ELSE 'test' END AS split FROM r",
)
def _(spark, sf):
    return sampling.split_entities(_entities(spark, sf), seed=7).select("patient_id", "split")


@query(
    "sample_entities",
    f"WITH {ENT}, r AS (SELECT *, {_rank('3', 'sample')} AS rk FROM ent) SELECT patient_id FROM r WHERE rk <= 10",
)
def _(spark, sf):
    return sampling.sample_entities(_entities(spark, sf), 10, 3).select("patient_id")


@query(
    "fit_val_budget",
    f"WITH {ENT}, r AS (SELECT *, {_rank('5', 'sample')} AS rk FROM ent),"
    f" v AS (SELECT *, {_rank('6', 'validation')} AS vk FROM r WHERE rk <= 12)"
    " SELECT patient_id, CASE WHEN vk <= 2 THEN 'validation' ELSE 'fit' END AS role FROM v",
)
def _(spark, sf):
    return sampling.fit_val_budget(_entities(spark, sf), 12, 5).select("patient_id", "role")


@query(
    "nested_budgets",
    f"WITH {ENT}, s AS (SELECT unnest([11, 12, 13]) AS subset_seed),"
    f" r AS (SELECT *, {_rank('subset_seed', 'sample', 'PARTITION BY site, subset_seed')} AS rk,"
    " count(*) OVER (PARTITION BY site, subset_seed) AS pool FROM ent, s),"
    " b AS (SELECT r.*, n.n_train FROM r JOIN (SELECT unnest([5, 10, 20, 40]) AS n_train) n ON rk <= n_train AND pool >= n_train),"
    f" v AS (SELECT *, {_rank('subset_seed + 1', 'validation', 'PARTITION BY site, subset_seed, n_train')} AS vk FROM b)"
    " SELECT site, CAST(subset_seed AS BIGINT) AS subset_seed, CAST(n_train AS BIGINT) AS n_train, patient_id,"
    " CASE WHEN vk <= greatest(1, least(n_train - 1, CAST(round_even(n_train * 0.2::DOUBLE, 0) AS BIGINT)))"
    " THEN 'validation' ELSE 'fit' END AS role FROM v"
    " UNION ALL SELECT site, CAST(subset_seed AS BIGINT), CAST(n_train AS BIGINT), NULL, 'shortfall'"
    " FROM (SELECT site, count(*) AS pool FROM ent GROUP BY 1), s, (SELECT unnest([5, 10, 20, 40]) AS n_train) WHERE pool < n_train",
)
def _(spark, sf):
    return sampling.budgets(
        _entities(spark, sf), [5, 10, 20, 40], [11, 12, 13], by=("site",)
    ).select("site", "subset_seed", "n_train", "patient_id", "role")


@query(
    "site_split",
    f"WITH {ENT}, r AS (SELECT *, {_rank('0', 'split', 'PARTITION BY site')} AS rk,"
    " count(*) OVER (PARTITION BY site) AS n FROM ent) SELECT patient_id, site,"
    " CASE WHEN site = 0 AND rk <= floor(n * 0.8::DOUBLE) THEN 'development' ELSE 'test' END AS role FROM r",
)
def _(spark, sf):
    return sampling.site_split(_entities(spark, sf)).select("patient_id", "site", "role")


_SEEDS = (
    "SELECT l_returnflag AS world, list_sort(list(DISTINCT 401 + l_suppkey % 10)) AS c,"
    " list_sort(list(DISTINCT 501 + l_suppkey % 10)) AS s, list_sort(list(DISTINCT 601 + l_suppkey % 10)) AS m"
    " FROM lineitem GROUP BY 1"
)


def _bundles(spark, sf):
    unit = F.col("l_suppkey") % 10
    lists = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("world"))
        .agg(
            *[
                F.sort_array(F.collect_set((unit + base).cast("bigint"))).alias(name)
                for name, base in (("cohort_seed", 401), ("subset_seed", 501), ("model_seed", 601))
            ]
        )
    )
    return grids.zip_seeds(lists, ["cohort_seed", "subset_seed", "model_seed"], default=7)


_BUNDLES = (
    f"raw AS ({_SEEDS}), bundles AS (SELECT world, i - 1 AS bundle, c[i] AS cohort_seed, s[i] AS subset_seed,"
    " m[i] AS model_seed FROM raw, LATERAL (SELECT unnest(range(1, len(c) + 1)) AS i))"
)


@query("zip_seeds", f"WITH {_BUNDLES} SELECT * FROM bundles")
def _(spark, sf):
    return _bundles(spark, sf)


_MODELS = ["adapter", "adapter_observing", "linear"]
_ABLATIONS = ["none", "no_flow", "no_observation_head"]


def _lit(values) -> str:
    return "[" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + "]"


@query(
    "plan_grid",
    f"WITH {_BUNDLES} SELECT b.world, b.cohort_seed, b.subset_seed, b.model_seed, n_train, model, ablation"
    f" FROM bundles b, (SELECT unnest([5, 10, 20, 40]) AS n_train), (SELECT unnest({_lit(_MODELS)}) AS model),"
    f" (SELECT unnest({_lit(_ABLATIONS)}) AS ablation)"
    " WHERE (model LIKE 'adapter%' OR ablation = 'none')"
    " AND (ablation <> 'no_observation_head' OR model = 'adapter_observing')",
)
def _(spark, sf):
    return grids.plan_grid(
        _bundles(spark, sf).drop("bundle"),
        {"n_train": [5, 10, 20, 40], "model": _MODELS, "ablation": _ABLATIONS},
        allowed=grids.benchmark_rules("adapter", "adapter_observing"),
    )


def _stage(spark, sf):
    bundles = _bundles(spark, sf).drop("bundle", "world").distinct()
    return grids.plan_stage(
        bundles, "d1", ["smooth", "jumps"], [5, 10, 20, 40], {"flow_mode": ["none", "time_scaled"]}
    )


_STAGE = (
    "stage AS (SELECT cohort_seed, subset_seed, model_seed, 'd1' AS stage, w.world, n.n_train, f.flow_mode,"
    " concat_ws('__', 'd1', w.world, 'cohort' || cohort_seed, 'subset' || subset_seed, 'model' || model_seed,"
    " 'n' || n_train, flow_mode) AS cell_id FROM (SELECT DISTINCT cohort_seed, subset_seed, model_seed FROM bundles), (SELECT unnest(['smooth', 'jumps']) AS world) w,"
    " (SELECT unnest([5, 10, 20, 40]) AS n_train) n, (SELECT unnest(['none', 'time_scaled']) AS flow_mode) f)"
)


@query("plan_stage", f"WITH {_BUNDLES}, {_STAGE} SELECT * FROM stage")
def _(spark, sf):
    return _stage(spark, sf)


@query(
    "plan_orthogonal",
    "WITH lv AS (SELECT l_returnflag AS world, list_sort(list(DISTINCT l_suppkey % 5)) AS c,"
    " list_sort(list(DISTINCT l_partkey % 5)) AS s FROM lineitem GROUP BY 1),"
    " g AS (SELECT world, c, i, j, s, m FROM lv, (SELECT unnest([1, 2]) AS m),"
    " LATERAL (SELECT unnest(range(0, len(c))) AS i), LATERAL (SELECT unnest(range(0, len(s))) AS j))"
    " SELECT world, CAST(m AS BIGINT) AS multiplier, 401 + c[i + 1] AS cohort_seed, 501 + s[j + 1] AS subset_seed,"
    " 601 + c[(i + m * j) % len(c) + 1] AS model_seed FROM g",
)
def _(spark, sf):
    levels = (
        table(spark, sf, "lineitem")
        .groupBy(F.col("l_returnflag").alias("world"))
        .agg(
            F.sort_array(F.collect_set(F.col("l_suppkey") % 5)).alias("c"),
            F.sort_array(F.collect_set(F.col("l_partkey") % 5)).alias("s"),
        )
    )

    def plan(m):
        out = grids.plan_orthogonal(
            levels,
            F.transform("c", lambda x: x + 401),
            F.transform("s", lambda x: x + 501),
            F.transform("c", lambda x: x + 601),
            multiplier=m,
        )
        return out.drop("c", "s").withColumn("multiplier", F.lit(m).cast("bigint"))

    return plan(1).unionByName(plan(2))


_DONE = "SELECT DISTINCT 401 + l_suppkey % 10 AS cohort_seed, 501 + l_suppkey % 10 AS subset_seed, 601 + l_suppkey % 10 AS model_seed, CASE WHEN l_linestatus = 'F' THEN 5 ELSE 40 END AS n_train FROM lineitem WHERE l_quantity > 49"


@query(
    "pending_cells",
    f"WITH {_BUNDLES}, {_STAGE}, done AS ({_DONE}) SELECT cell_id FROM stage s WHERE NOT EXISTS (SELECT 1 FROM done d"
    " WHERE d.cohort_seed = s.cohort_seed AND d.subset_seed = s.subset_seed AND d.model_seed = s.model_seed"
    " AND d.n_train = s.n_train)",
)
def _(spark, sf):
    unit = F.col("l_suppkey") % 10
    done = (
        table(spark, sf, "lineitem")
        .where("l_quantity > 49")
        .select(
            (unit + 401).alias("cohort_seed"),
            (unit + 501).alias("subset_seed"),
            (unit + 601).alias("model_seed"),
            F.when(F.col("l_linestatus") == "F", 5).otherwise(40).alias("n_train"),
        )
        .distinct()
    )
    key = ["cohort_seed", "subset_seed", "model_seed", "n_train"]
    return grids.pending_cells(_stage(spark, sf), done, key).select("cell_id")


@query(
    "plan_hash",
    "WITH h AS (SELECT o_orderstatus AS plan, count(*) AS n_cells,"
    " sum(CAST('0x' || substr(md5(concat_ws('|', 'v' || length(o_orderkey::VARCHAR) || ':' || o_orderkey, 'v' || length(o_custkey::VARCHAR) || ':' || o_custkey,"
    " 'v' || length(o_orderpriority) || ':' || o_orderpriority)), 1, 15) AS HUGEINT)) AS s"
    " FROM orders GROUP BY 1)"
    " SELECT plan, n_cells, sha256(concat_ws('|', n_cells, s)) AS plan_sha256 FROM h",
)
def _(spark, sf):
    plan = table(spark, sf, "orders").withColumnRenamed("o_orderstatus", "plan")
    return grids.plan_hash(plan, ["o_orderkey", "o_custkey", "o_orderpriority"], by=("plan",))


@query(
    "nearest_match",
    "WITH c AS (SELECT s_nationkey AS nation, s_acctbal AS v, min(s_suppkey) AS s_suppkey FROM supplier GROUP BY 1, 2),"
    " m AS (SELECT c_nationkey AS nation, c_custkey, c_acctbal, c.s_suppkey, c.v, row_number() OVER"
    " (PARTITION BY c_custkey ORDER BY abs(c.v - c_acctbal), c.v) AS rn FROM customer LEFT JOIN c ON c.nation = c_nationkey)"
    " SELECT nation, c_custkey, c_acctbal AS target_value, s_suppkey, v AS candidate_value,"
    f" {R('abs(v - c_acctbal)')} AS mismatch, {R('abs(v - c_acctbal) / abs(c_acctbal)')} AS relative_mismatch"
    " FROM m WHERE rn = 1",
)
def _(spark, sf):
    targets = table(spark, sf, "customer").select(
        F.col("c_nationkey").alias("nation"), "c_custkey", F.col("c_acctbal").alias("v")
    )
    offers = table(spark, sf, "supplier").select(
        F.col("s_nationkey").alias("nation"), "s_suppkey", F.col("s_acctbal").alias("v")
    )
    out = sampling.nearest_match(
        targets, offers, "v", by=["nation"], target_id="c_custkey", candidate_id="s_suppkey"
    )
    return rounded(out, "mismatch", "relative_mismatch")


_OBS = (
    f"{EV1}, obs AS (SELECT *, (value - 10.0::DOUBLE) / 10.0::DOUBLE AS state,"
    f" {sql_uniform('3', chr(39) + 'keep' + chr(39), 'patient_id', 'us', 'seq')} AS u"
    " FROM ev1 WHERE event_type = 'observation')"
)


def _p(logit: str) -> str:
    return f"least(greatest(1.0::DOUBLE / (1.0::DOUBLE + exp(-({logit}))), 0.02::DOUBLE), 0.98::DOUBLE)"


_SITE_LOGIT = (
    "(CASE WHEN site % 2 = 0 THEN -0.35::DOUBLE ELSE -0.65::DOUBLE END)"
    " + (CASE WHEN site % 2 = 0 THEN CASE code WHEN 'click' THEN 0.9::DOUBLE WHEN 'error' THEN -0.7::DOUBLE ELSE 0.1::DOUBLE END"
    " ELSE CASE code WHEN 'click' THEN -0.8::DOUBLE WHEN 'error' THEN 0.8::DOUBLE ELSE -0.2::DOUBLE END END)"
    " + 0.7::DOUBLE * state"
)

_MISSING_SQL = (
    f"WITH RECURSIVE {_OBS}, o AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY us, seq) AS rn FROM obs),"
    f" w AS (SELECT patient_id, rn, seq, u < {_p('-0.6::DOUBLE')} AS kept,"
    f" CASE WHEN u < {_p('-0.6::DOUBLE')} THEN state END AS prev FROM o WHERE rn = 1"
    f" UNION ALL SELECT o.patient_id, o.rn, o.seq, o.u < {_p('-0.6::DOUBLE + 0.8::DOUBLE * coalesce(w.prev, 0.0::DOUBLE)')},"
    f" CASE WHEN o.u < {_p('-0.6::DOUBLE + 0.8::DOUBLE * coalesce(w.prev, 0.0::DOUBLE)')} THEN o.state ELSE w.prev END"
    " FROM w JOIN o ON o.patient_id = w.patient_id AND o.rn = w.rn + 1)"
    " SELECT 'mar' AS regime, patient_id, seq, kept FROM w"
    f" UNION ALL SELECT 'mcar', patient_id, seq, u < {_p('-0.2::DOUBLE')} FROM obs"
    f" UNION ALL SELECT 'mnar', patient_id, seq, u < {_p('-0.8::DOUBLE + 1.1::DOUBLE * state')} FROM obs"
    f" UNION ALL SELECT 'site_shift', patient_id, seq, u < {_p(_SITE_LOGIT)} FROM obs"
)


def observations(spark, sf):
    e = events(spark, sf).where(F.col("event_type") == "observation")
    return e.withColumn("state", (F.col("value") - 10.0) / 10.0)


@query("apply_missingness", _MISSING_SQL)
def _(spark, sf):
    rows = observations(spark, sf)
    out = None
    for regime in missingness.REGIMES:
        part = missingness.apply_missingness(rows, regime, TASK.value_codes, seed=3)
        part = part.select(F.lit(regime).alias("regime"), "patient_id", "seq", "kept")
        out = part if out is None else out.unionByName(part)
    return out


_MULT = (
    "CASE WHEN site % 2 = 0 THEN CASE code WHEN 'click' THEN 0.6::DOUBLE WHEN 'error' THEN 1.5::DOUBLE ELSE 0.9::DOUBLE END"
    " ELSE CASE code WHEN 'click' THEN 1.6::DOUBLE WHEN 'error' THEN 0.7::DOUBLE ELSE 1.3::DOUBLE END END"
)
_NOISE = sql_normal("5", "'noise'", "patient_id", "us", "seq")


@query(
    "add_noise",
    f"WITH {EV1} SELECT patient_id, seq, {R(f'0.5::DOUBLE * ({_MULT})')} AS noise_scale,"
    f" {R(f'value + 0.5::DOUBLE * ({_MULT}) * {_NOISE}')} AS noisy_value FROM ev1 WHERE event_type = 'observation'",
)
def _(spark, sf):
    out = missingness.add_noise(
        observations(spark, sf), "site_shift", TASK.value_codes, base_scale=0.5, seed=5
    )
    return rounded(
        out.select("patient_id", "seq", "noise_scale", "noisy_value"), "noise_scale", "noisy_value"
    )


_WORLD = (
    "CASE event_type WHEN 'click' THEN 'smooth' WHEN 'error' THEN 'jumps' WHEN 'view' THEN 'informative_observation'"
    " WHEN 'signup' THEN 'site_shift' ELSE 'misspecified' END"
)


@query(
    "world_overrides",
    f"WITH w AS (SELECT event_id, {_WORLD} AS world FROM events) SELECT event_id, world,"
    " CASE world WHEN 'smooth' THEN 0.01::DOUBLE WHEN 'jumps' THEN 0.15::DOUBLE WHEN 'misspecified' THEN 0.12::DOUBLE"
    " ELSE 0.05::DOUBLE END AS intervention_rate,"
    " CASE world WHEN 'smooth' THEN 'mcar' WHEN 'jumps' THEN 'mar' WHEN 'site_shift' THEN 'site_shift' ELSE 'mnar' END"
    " AS observation_regime,"
    " CASE world WHEN 'misspecified' THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS heterogeneity_scale,"
    " world = 'misspecified' AS hidden_regime_switch FROM w",
)
def _(spark, sf):
    rows = table(spark, sf, "events").select("event_id", F.expr(_WORLD).alias("world"))
    settings = {
        "smooth": {"intervention_rate": 0.01, "observation_regime": "mcar"},
        "jumps": {"intervention_rate": 0.15, "observation_regime": "mar"},
        "site_shift": {"observation_regime": "site_shift"},
        "misspecified": {"intervention_rate": 0.12, "heterogeneity_scale": 2.0, "hidden_regime_switch": True},
    }
    return missingness.world_overrides(
        rows,
        settings,
        {
            "intervention_rate": 0.05,
            "observation_regime": "mnar",
            "heterogeneity_scale": 1.0,
            "hidden_regime_switch": False,
        },
    )


@query(
    "variant_name",
    "SELECT l_orderkey, l_linenumber, l_partkey, concat_ws('__', l_returnflag, l_linestatus, 'deterministic') AS variant,"
    " concat_ws('__', 'low_n', l_returnflag, 'cohort' || (l_suppkey % 10), 'n' || l_linenumber) AS cell_id FROM lineitem",
)
def _(spark, sf):
    li = table(spark, sf, "lineitem")
    return li.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        joined_name(F.col("l_returnflag"), F.col("l_linestatus"), F.lit("deterministic")).alias("variant"),
        joined_name(
            F.lit("low_n"),
            F.col("l_returnflag"),
            F.concat(F.lit("cohort"), F.col("l_suppkey") % 10),
            F.concat(F.lit("n"), F.col("l_linenumber")),
        ).alias("cell_id"),
    )
