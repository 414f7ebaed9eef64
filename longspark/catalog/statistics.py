"""Queries over resampling, tests, variance shares and correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from longspark.catalog.fixtures import R, r6, rounded, sql_draw, table
from longspark.catalog.gates import PAIRS, pairs
from longspark.catalog.registry import query
from longspark.operators import resample, variance

REPS = 10_000
SCALE = 1.0471975511965976
_E = f"abs(l_discount - l_tax) * {SCALE}::DOUBLE"


def _error():
    return F.abs(F.col("l_discount") - F.col("l_tax")) * F.lit(SCALE)


# a 5 x 10 matrix of paired values, per policy
CX = (
    "cx AS (SELECT l_suppkey % 5 AS context, l_partkey % 10 AS model_seed, CASE l_returnflag WHEN 'A' THEN 'control' ELSE 'candidate' END AS variant,"
    f" CASE l_linestatus WHEN 'F' THEN 'standard' ELSE 'forced' END AS policy, avg({_E}) AS value FROM lineitem GROUP BY 1, 2, 3, 4),"
    " iw AS (SELECT context, model_seed, "
    + ", ".join(
        f"max(value) FILTER (WHERE variant = '{v}' AND policy = '{p}') AS mae_{v}_{p}"
        for v in ("control", "candidate")
        for p in ("standard", "forced")
    )
    + " FROM cx GROUP BY 1, 2), ip AS (SELECT *, mae_control_standard - mae_candidate_standard AS delta_standard,"
    " mae_control_forced - mae_candidate_forced AS delta_forced,"
    " (mae_control_forced - mae_candidate_forced) - (mae_control_standard - mae_candidate_standard) AS g,"
    " mae_candidate_standard - mae_candidate_forced AS h_candidate, mae_control_standard - mae_control_forced AS h_control FROM iw)"
)


def crossed(spark, sf):
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            (F.col("l_suppkey") % 5).alias("context"),
            (F.col("l_partkey") % 10).alias("model_seed"),
            F.when(F.col("l_returnflag") == "A", "control").otherwise("candidate").alias("variant"),
            F.when(F.col("l_linestatus") == "F", "standard").otherwise("forced").alias("policy"),
        )
        .agg(F.avg(_error()).alias("value"))
    )


def interaction(spark, sf):
    from longspark.operators.decisions import interaction_pairs

    return interaction_pairs(
        crossed(spark, sf), ["context", "model_seed"], control="control", candidate="candidate",
        standard="standard", forced="forced",
    )


# two orthogonal arrays of 25 combinations at two sizes
AR = (
    "ar AS (SELECT CASE l_orderkey % 2 WHEN 0 THEN 'a' ELSE 'b' END AS design, CASE l_linenumber % 2 WHEN 1 THEN 5 ELSE 40 END::BIGINT AS n_train,"
    " l_suppkey % 5 AS cohort, l_partkey % 5 AS subset,"
    " CASE l_orderkey % 2 WHEN 0 THEN (l_suppkey % 5 + l_partkey % 5) % 5 ELSE (l_suppkey % 5 + 2 * (l_partkey % 5)) % 5 END AS model,"
    f" avg({_E}) FILTER (WHERE l_linestatus = 'F') - avg({_E}) FILTER (WHERE l_linestatus = 'O') AS delta_mae FROM lineitem GROUP BY 1, 2, 3, 4, 5)"
)
FACTORS = ["cohort", "subset", "model"]


def arrays(spark, sf):
    i, j = F.col("l_suppkey") % 5, F.col("l_partkey") % 5
    even = F.col("l_orderkey") % 2 == 0
    status = F.col("l_linestatus")
    e = _error()
    return (
        table(spark, sf, "lineitem")
        .groupBy(
            F.when(even, "a").otherwise("b").alias("design"),
            F.when(F.col("l_linenumber") % 2 == 1, 5).otherwise(40).cast("bigint").alias("n_train"),
            i.alias("cohort"),
            j.alias("subset"),
            F.when(even, (i + j) % 5).otherwise((i + 2 * j) % 5).alias("model"),
        )
        .agg((F.avg(F.when(status == "F", e)) - F.avg(F.when(status == "O", e))).alias("delta_mae"))
    )


def _units(source: str, by: str, unit: str) -> str:
    return (
        f"(SELECT *, row_number() OVER (PARTITION BY {by} ORDER BY {unit}) AS k, count(*) OVER (PARTITION BY {by}) AS n FROM {source})"
    )


def _boot(source: str, by: str, unit: str, value: str, seed: int) -> str:
    """CTEs u, bm, ci over a source relation."""
    d = sql_draw(str(seed), "rep", "u.k")
    on = " AND ".join(f"u.{b.strip()} = v.{b.strip()}" for b in by.split(","))
    ub = ", ".join(f"u.{b.strip()}" for b in by.split(","))
    return (
        f"u AS {_units(source, by, unit)}, bm AS (SELECT {ub}, rep, avg(v.{value}) AS m FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep) r, u v"
        f" WHERE {on} AND v.k = {d} % u.n + 1 GROUP BY {ub}, rep),"
        f" ci AS (SELECT {by}, quantile_cont(m, 0.025) AS lo, quantile_cont(m, 0.975) AS hi, count(*) AS resamples FROM bm GROUP BY {by}),"
        f" ob AS (SELECT {by}, avg({value}) AS m, count({value}) AS units FROM {source} GROUP BY {by})"
    )


_CI = f"{R('m')} AS mean_effect, units, {R('lo')} AS ci_lower, {R('hi')} AS ci_upper, resamples"


@query(
    "bootstrap_mean_ci",
    f"WITH {PAIRS}, {_boot('pr', 'world, comparator', 'cohort_seed', 'effect', 20260824)}"
    f" SELECT world, comparator, {_CI} FROM ob JOIN ci USING (world, comparator)",
)
def _(spark, sf):
    out = resample.bootstrap_mean_ci(
        pairs(spark, sf), ["world", "comparator"], "cohort_seed", "effect", resamples=REPS
    )
    return rounded(out, "mean_effect", "ci_lower", "ci_upper")


@query(
    "cluster_bootstrap",
    f"WITH {CX}, cl AS (SELECT 1 AS one, model_seed, avg(delta_standard) AS d FROM ip GROUP BY 2), {_boot('cl', 'one', 'model_seed', 'd', 20260827)}"
    f" SELECT {_CI} FROM ob JOIN ci USING (one)",
)
def _(spark, sf):
    out = resample.cluster_bootstrap(interaction(spark, sf), [], "model_seed", "delta_standard", resamples=REPS)
    return rounded(out, "mean_effect", "ci_lower", "ci_upper")


_NI = "count(DISTINCT context) OVER ()"
_SS = lambda v: (
    f"sum(power({v} - r_{v} - c_{v} + g_{v}, 2))"
)
_CROSSED = (
    f"{CX}, ni AS (SELECT context, row_number() OVER (ORDER BY context) AS i FROM (SELECT DISTINCT context FROM ip)),"
    " nj AS (SELECT model_seed, row_number() OVER (ORDER BY model_seed) AS j FROM (SELECT DISTINCT model_seed FROM ip)),"
    " mx AS (SELECT i, j, delta_standard AS s, delta_forced AS f, g FROM ip JOIN ni USING (context) JOIN nj USING (model_seed)),"
    f" sl AS (SELECT rep, i AS si, j AS sj, {sql_draw('20260827', 'rep', chr(39) + 'row' + chr(39), 'i')} % (SELECT max(i) FROM mx) + 1 AS di,"
    f" {sql_draw('20260827', 'rep', chr(39) + 'column' + chr(39), 'j')} % (SELECT max(j) FROM mx) + 1 AS dj FROM mx, (SELECT unnest(range(1, {REPS + 1})) AS rep)),"
    " sm AS (SELECT sl.rep, si, sj, m.s, m.f, m.g FROM sl JOIN mx m ON m.i = di AND m.j = dj),"
    " rs AS (SELECT rep, g, s, f, "
    + ", ".join(
        f"avg({v}) OVER (PARTITION BY rep, si) AS r_{v}, avg({v}) OVER (PARTITION BY rep, sj) AS c_{v}, avg({v}) OVER (PARTITION BY rep) AS g_{v}"
        for v in ("s", "f")
    )
    + " FROM sm), rp AS (SELECT rep, avg(g) AS mg,"
    f" CASE WHEN {_SS('s')} <= 1e-12 * count(*) * var_pop(s) THEN 0.0::DOUBLE ELSE {_SS('s')} END AS ss,"
    f" CASE WHEN {_SS('f')} <= 1e-12 * count(*) * var_pop(f) THEN 0.0::DOUBLE ELSE {_SS('f')} END AS sf FROM rs GROUP BY rep),"
    " cb AS (SELECT quantile_cont(mg, 0.025) AS mean_ci_lower, quantile_cont(mg, 0.975) AS mean_ci_upper, count(*) AS resamples,"
    " count(*) FILTER (WHERE ss > 0) AS valid_replicates,"
    " CASE WHEN count(*) = count(*) FILTER (WHERE ss > 0) THEN quantile_cont(CASE WHEN ss > 0 THEN sqrt(sf / ss) END, 0.025) END AS ratio_ci_lower,"
    " CASE WHEN count(*) = count(*) FILTER (WHERE ss > 0) THEN quantile_cont(CASE WHEN ss > 0 THEN sqrt(sf / ss) END, 0.975) END AS ratio_ci_upper FROM rp)"
)


def _or_null(c: str) -> str:
    return f"CASE WHEN {c} IS NULL THEN NULL ELSE {R(c)} END AS {c}"


@query(
    "crossed_bootstrap",
    f"WITH {_CROSSED} SELECT resamples, valid_replicates, {R('mean_ci_lower')} AS mean_ci_lower, {R('mean_ci_upper')} AS mean_ci_upper,"
    f" {_or_null('ratio_ci_lower')}, {_or_null('ratio_ci_upper')} FROM cb",
)
def _(spark, sf):
    out = resample.crossed_bootstrap(interaction(spark, sf), [], "context", "model_seed", resamples=REPS)
    return rounded(out, "mean_ci_lower", "mean_ci_upper", "ratio_ci_lower", "ratio_ci_upper")


LEVELS = {f: [0, 1, 2, 3, 4] for f in FACTORS}


def dominance(spark, sf, reps=REPS):
    rows = arrays(spark, sf).withColumn("unit", F.col("cohort") * 5 + F.col("subset"))
    return resample.bootstrap_dominance(
        rows, ["design", "n_train"], "unit", LEVELS, "delta_mae", resamples=reps
    )


@query("bootstrap_dominance")
def _(spark, sf):
    return dominance(spark, sf)


_SHIFT = (
    f"{AR}, sh AS (SELECT design, cohort, subset, model, max(delta_mae) FILTER (WHERE n_train = 5) AS delta_low,"
    " max(delta_mae) FILTER (WHERE n_train = 40) AS delta_high FROM ar GROUP BY 1, 2, 3, 4),"
    " ts AS (SELECT *, delta_high - delta_low AS t, cohort * 5 + subset AS unit FROM sh WHERE delta_high IS NOT NULL AND delta_low IS NOT NULL)"
)


def shifts(spark, sf):
    return variance.n_shift(arrays(spark, sf), ["design", *FACTORS])


@query(
    "shift_bootstrap",
    f"WITH {_SHIFT}, {_boot('ts', 'design', 'unit', 't', 20260827)} SELECT design, {_CI} FROM ob JOIN ci USING (design)",
)
def _(spark, sf):
    rows = shifts(spark, sf).withColumn("unit", F.col("cohort") * 5 + F.col("subset"))
    out = resample.bootstrap_mean_ci(rows, ["design"], "unit", "t", resamples=REPS, seed=20260827)
    return rounded(out, "mean_effect", "ci_lower", "ci_upper")


_SIGN = (
    f"{PAIRS}, sg AS (SELECT world, comparator, count(*) FILTER (WHERE effect > 0) AS wins, count(*) FILTER (WHERE effect < 0) AS losses,"
    " count(*) FILTER (WHERE effect = 0) AS ties FROM pr GROUP BY 1, 2),"
    " sp AS (SELECT *, wins + losses AS n, CASE WHEN wins + losses = 0 THEN 1.0::DOUBLE ELSE"
    " (SELECT sum(exp(lgamma(wins + losses + 1.0) - lgamma(k + 1.0) - lgamma(wins + losses - k + 1.0) - (wins + losses) * ln(2.0::DOUBLE)))"
    " FROM (SELECT unnest(range(wins, wins + losses + 1)) AS k)) END AS p FROM sg)"
)


def _signs(spark, sf):
    return resample.sign_test(pairs(spark, sf), ["world", "comparator"], "effect")


@query("sign_test", f"WITH {_SIGN} SELECT world, comparator, wins, losses, ties, n, {R('p')} AS p_value FROM sp")
def _(spark, sf):
    return rounded(_signs(spark, sf), "p_value")


@query(
    "holm_adjust",
    f"WITH {_SIGN}, h AS (SELECT *, world || comparator AS id, row_number() OVER (ORDER BY p, world || comparator) AS r, count(*) OVER () AS m FROM sp)"
    f" SELECT world, comparator, {R('p')} AS p_value, {R('least(1.0::DOUBLE, (SELECT max((m - r + 1) * p) FROM h x WHERE x.r <= h.r))')} AS holm_p_value FROM h",
)
def _(spark, sf):
    # rounded first: the order of equal p-values must not hang on their last bits
    p = _signs(spark, sf).withColumn("id", F.concat("world", "comparator")).withColumn("p_value", F.round("p_value", 12))
    out = resample.holm_adjust(p, [], "p_value", "id")
    return rounded(out.select("world", "comparator", "p_value", "holm_p_value"), "p_value", "holm_p_value")


_LEVELS = (
    f"{AR}, lv AS ("
    + " UNION ALL ".join(
        f"SELECT design, n_train, '{f}' AS factor, CAST({f} AS VARCHAR) AS level, avg(delta_mae) AS mean, count(*) AS n FROM ar GROUP BY design, n_train, {f}"
        for f in FACTORS
    )
    + "), gr AS (SELECT design, n_train, avg(delta_mae) AS g, count(*) * var_pop(delta_mae) AS total FROM ar GROUP BY 1, 2),"
    " mn AS (SELECT design, n_train, factor AS component, sum(n * power(mean - g, 2)) AS sum_squares FROM lv JOIN gr USING (design, n_train) GROUP BY 1, 2, 3),"
    " cp AS (SELECT *, sum_squares / total AS variance_share FROM (SELECT * FROM mn UNION ALL"
    " SELECT design, n_train, 'residual', greatest(0.0::DOUBLE, any_value(total) - sum(sum_squares)) FROM mn JOIN gr USING (design, n_train) GROUP BY 1, 2)"
    " JOIN gr USING (design, n_train))"
)


@query(
    "factor_levels",
    f"WITH {_LEVELS} SELECT design, n_train, factor, level, n, {R('mean')} AS mean, {R('mean - g')} AS centered_effect FROM lv JOIN gr USING (design, n_train)",
)
def _(spark, sf):
    out = variance.factor_levels(arrays(spark, sf), ["design", "n_train"], FACTORS, "delta_mae")
    return rounded(out, "mean", "centered_effect")


def components(spark, sf):
    return variance.factor_ss(arrays(spark, sf), ["design", "n_train"], FACTORS, "delta_mae")


@query(
    "factor_ss",
    f"WITH {_LEVELS} SELECT design, n_train, component, {R('sum_squares')} AS sum_squares, {R('total')} AS total_ss,"
    f" {R('variance_share')} AS variance_share FROM cp",
)
def _(spark, sf):
    return rounded(components(spark, sf), "sum_squares", "total_ss", "variance_share")


@query(
    "factor_ss_general",
    f"WITH {_LEVELS} SELECT design, n_train, component, {R('sum_squares')} AS sum_squares, {R('total')} AS total_ss,"
    f" {R('variance_share')} AS variance_share FROM cp",
)
def _(spark, sf):
    # on a balanced array dropping a factor from the fit gives the closed form
    out = variance.factor_ss_general(arrays(spark, sf), ["design", "n_train"], LEVELS, "delta_mae")
    return rounded(
        out.select("design", "n_train", "component", "sum_squares", "total_ss", "variance_share"),
        "sum_squares", "total_ss", "variance_share",
    )


# two factors of two levels have a closed form: the effect of one is its mean difference inside the levels of the other
TWO = ["first", "second"]
_TWO = (
    "tw AS (SELECT l_returnflag AS design, l_partkey % 24 AS unit, l_partkey % 24 % 2 AS first, l_partkey % 24 // 2 % 2 AS second,"
    f" avg({_E}) AS value FROM lineitem GROUP BY 1, 2, 3, 4)"
)


def _two_sums(source: str, keys: str) -> str:
    """Sums of squares ``s1``, ``s2`` of both factors and ``total`` per group of rows (first, second, value)."""

    def effect(f: str, g: str) -> str:
        n = {(i, j): f"count(*) FILTER (WHERE {f} = {i} AND {g} = {j})" for i in (0, 1) for j in (0, 1)}
        m = {(i, j): f"avg(value) FILTER (WHERE {f} = {i} AND {g} = {j})" for i in (0, 1) for j in (0, 1)}
        w = [f"coalesce({n[0, j]} * {n[1, j]}::DOUBLE / nullif({n[0, j]} + {n[1, j]}, 0), 0)" for j in (0, 1)]
        d = [f"coalesce({m[1, j]} - {m[0, j]}, 0)" for j in (0, 1)]
        up = " + ".join(f"{w[j]} * {d[j]}" for j in (0, 1))
        return f"coalesce(power({up}, 2) / nullif({w[0]} + {w[1]}, 0), 0)"

    raw = f"SELECT {keys}, {effect('first', 'second')} AS r1, {effect('second', 'first')} AS r2, var_pop(value) * count(*) AS total FROM {source} GROUP BY {keys}"
    return (
        f"SELECT {keys}, CASE WHEN r1 <= 1e-12 * total THEN 0 ELSE r1 END AS s1, CASE WHEN r2 <= 1e-12 * total THEN 0 ELSE r2 END AS s2, total FROM ({raw})"
    )


_TWO_FREQ = (
    f"{_TWO}, u AS {_units('tw', 'design', 'unit')}, pk AS (SELECT u.design, rep, v.first, v.second, v.value"
    f" FROM u, (SELECT unnest(range(1, {REPS + 1})) AS rep) r, u v WHERE u.design = v.design AND v.k = {sql_draw('20260827', 'rep', 'u.k')} % u.n + 1),"
    f" rs AS ({_two_sums('pk', 'design, rep')}), fq AS (SELECT design, factor, count(*) AS resamples, count(*) FILTER (WHERE (s1 >= s2) = (factor = 'first')) AS largest_count"
    " FROM rs, (VALUES ('first'), ('second')) AS t(factor) GROUP BY 1, 2)"
)


def _two(spark, sf):
    unit = F.col("l_partkey") % 24
    keys = [F.col("l_returnflag").alias("design"), unit.alias("unit"), (unit % 2).alias("first"), F.floor(unit / 2 % 2).cast("bigint").alias("second")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(F.avg(_error()).alias("value"))


def _two_frequencies(spark, sf):
    return resample.bootstrap_dominance(_two(spark, sf), ["design"], "unit", {f: [0, 1] for f in TWO}, "value", resamples=REPS)


@query(
    "dominance_two_level",
    f"WITH {_TWO_FREQ} SELECT design, factor, resamples, largest_count, largest_count / resamples AS largest_frequency FROM fq",
)
def _(spark, sf):
    return _two_frequencies(spark, sf)


@query(
    "factor_class_bootstrap",
    f"WITH {_TWO_FREQ}, fs AS ({_two_sums('tw', 'design')}), lg AS (SELECT design, factor, largest_count / resamples AS f,"
    " CASE factor WHEN 'first' THEN s1 ELSE s2 END / total AS share, CASE factor WHEN 'first' THEN s2 ELSE s1 END / total AS other, total FROM fs JOIN fq USING (design))"
    f" SELECT design, factor AS component, {R('share')} AS variance_share, f AS largest_frequency,"
    " CASE WHEN total <= 2.220446049250313e-16 THEN 'unresolved' WHEN share <= other + 1e-8 + 1e-5 * abs(other) AND f <= 0.2 THEN 'weak'"
    " WHEN share >= other AND share > 0 AND share >= 2 * other AND f >= 0.8 THEN 'dominant' ELSE 'unresolved' END AS factor_classification FROM lg",
)
def _(spark, sf):
    parts = variance.factor_ss_general(_two(spark, sf), ["design"], {f: [0, 1] for f in TWO}, "value")
    out = variance.factor_class(parts, _two_frequencies(spark, sf), ["design"])
    return rounded(out.select("design", "component", "variance_share", "largest_frequency", "factor_classification"), "variance_share")


# the largest share of a design stands in for a bootstrap frequency of 1
CLASSES = (
    f"{_LEVELS}, nm AS (SELECT *, max(variance_share) OVER w AS mx, min(variance_share) OVER w AS mi,"
    " row_number() OVER (PARTITION BY design, n_train ORDER BY variance_share DESC) AS rk,"
    " nth_value(variance_share, 2) OVER (PARTITION BY design, n_train ORDER BY variance_share DESC ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS nx"
    " FROM cp WHERE component <> 'residual' WINDOW w AS (PARTITION BY design, n_train)),"
    " fc AS (SELECT design, n_train, component, variance_share, CASE WHEN rk = 1 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS largest_frequency,"
    " CASE WHEN total <= 2.220446049250313e-16 THEN 'unresolved' WHEN abs(variance_share - mi) <= 1e-8 + 1e-5 * abs(mi) AND rk <> 1 THEN 'weak'"
    " WHEN rk = 1 AND variance_share > 0 AND variance_share >= 2 * nx THEN 'dominant' ELSE 'unresolved' END AS factor_classification FROM nm)"
)


def classes(spark, sf):
    parts = components(spark, sf)
    named = parts.where("component <> 'residual'")
    best = named.groupBy("design", "n_train").agg(F.max_by("component", "variance_share").alias("top"))
    freq = named.join(best, ["design", "n_train"]).select(
        "design", "n_train", F.col("component").alias("factor"),
        F.when(F.col("component") == F.col("top"), 1.0).otherwise(0.0).alias("largest_frequency"),
    )
    return variance.factor_class(parts, freq, ["design", "n_train"])


@query(
    "factor_class",
    f"WITH {CLASSES} SELECT * REPLACE ({R('variance_share')} AS variance_share) FROM fc",
)
def _(spark, sf):
    out = classes(spark, sf).select(
        "design", "n_train", "component", "variance_share", "largest_frequency", "factor_classification"
    )
    return rounded(out, "variance_share")


@query(
    "n_shift",
    f"WITH {_SHIFT} SELECT design, cohort, subset, model, {R('delta_low')} AS delta_low, {R('delta_high')} AS delta_high, {R('t')} AS t FROM ts",
)
def _(spark, sf):
    return rounded(shifts(spark, sf), "delta_low", "delta_high", "t")


@query(
    "n_shift_summary",
    f"WITH {_SHIFT} SELECT design, {R('avg(t)')} AS mean_t, count(*) FILTER (WHERE t > 0) AS positive_t_count, count(*) AS pair_count,"
    f" {R('avg(delta_low)')} AS mean_delta_low, {R('avg(delta_high)')} AS mean_delta_high FROM ts GROUP BY 1",
)
def _(spark, sf):
    out = variance.n_shift_summary(shifts(spark, sf), ["design"])
    return rounded(out, "mean_t", "mean_delta_low", "mean_delta_high")


def _resid(v: str, over: str = "") -> str:
    p = f"{over}, " if over else ""
    g = f"OVER (PARTITION BY {over})" if over else "OVER ()"
    return (
        f"{v} - avg({v}) OVER (PARTITION BY {p}context) - avg({v}) OVER (PARTITION BY {p}model_seed) + avg({v}) {g}"
    )


@query(
    "two_way_residuals",
    f"WITH {CX} SELECT context, model_seed, {R('g')} AS g, {R(_resid('g'))} AS g_residual FROM ip",
)
def _(spark, sf):
    out = variance.two_way_residuals(interaction(spark, sf), [], "context", "model_seed", ["g"])
    return rounded(out.select("context", "model_seed", "g", "g_residual"), "g", "g_residual")


@query(
    "residual_sd_ratio",
    f"WITH {CX}, r AS (SELECT {_resid('delta_standard')} AS s, {_resid('delta_forced')} AS f FROM ip)"
    f" SELECT count(*) AS cells, {R('stddev_samp(s)')} AS standard_sd, {R('stddev_samp(f)')} AS forced_sd,"
    f" {R('stddev_samp(f) / nullif(stddev_samp(s), 0)')} AS ratio FROM r",
)
def _(spark, sf):
    out = resample.residual_sd_ratio(
        interaction(spark, sf), [], "context", "model_seed", "delta_standard", "delta_forced"
    )
    return rounded(out, "standard_sd", "forced_sd", "ratio")


def _avg_rank(v: str, by: str) -> str:
    return (
        f"rank() OVER (PARTITION BY {by} ORDER BY {v}) + (count(*) OVER (PARTITION BY {by}, {v}) - 1) / 2.0::DOUBLE"
    )


@query(
    "safe_corr",
    "WITH r AS (SELECT l_suppkey, l_quantity AS x, l_extendedprice AS y, "
    + f"{_avg_rank('l_quantity', 'l_suppkey')} AS rx, {_avg_rank('l_extendedprice', 'l_suppkey')} AS ry FROM lineitem)"
    f" SELECT l_suppkey, count(*) AS n, {R('corr(x, y)')} AS pearson, {R('corr(rx, ry)')} AS spearman FROM r GROUP BY 1",
)
def _(spark, sf):
    out = variance.safe_corr(table(spark, sf, "lineitem"), ["l_suppkey"], "l_quantity", "l_extendedprice")
    return rounded(out, "pearson", "spearman")


@query(
    "context_demean",
    f"WITH {CX} SELECT context, model_seed, {R('g - avg(g) OVER (PARTITION BY context)')} AS g_demeaned FROM ip",
)
def _(spark, sf):
    out = variance.context_demean(interaction(spark, sf), ["context"], "g")
    return rounded(out.select("context", "model_seed", "g_demeaned"), "g_demeaned")


def _perm_sql(source: str, key: str, reps: int, prefix: str = "") -> str:
    """CTEs of a permutation test over ``source(key, context, model_seed, x, y)`` residuals."""
    di = sql_draw("20260827", "rep", "'i'", "i")
    dj = sql_draw("20260827", "rep", "'j'", "j")
    return (
        f"qi AS (SELECT {key}, context, row_number() OVER (PARTITION BY {key} ORDER BY context) AS i FROM (SELECT DISTINCT {key}, context FROM {source})),"
        f" qj AS (SELECT {key}, model_seed, row_number() OVER (PARTITION BY {key} ORDER BY model_seed) AS j FROM (SELECT DISTINCT {key}, model_seed FROM {source})),"
        f" qm AS (SELECT {key}, i, j, x, y FROM {source} JOIN qi USING ({key}, context) JOIN qj USING ({key}, model_seed)),"
        f" rp AS (SELECT unnest(range(1, {reps + 1})) AS rep),"
        f" pi AS (SELECT {key}, rep, i, row_number() OVER (PARTITION BY {key}, rep ORDER BY {di}, i) AS p FROM qi, rp),"
        f" pj AS (SELECT {key}, rep, j, row_number() OVER (PARTITION BY {key}, rep ORDER BY {dj}, j) AS p FROM qj, rp),"
        f" ob AS (SELECT {key}, CASE WHEN count(*) >= 3 AND max(x) > min(x) AND max(y) > min(y) THEN corr(x, y) END AS observed FROM qm GROUP BY 1),"
        f" st AS (SELECT m.{key}, pi.rep, corr(s.x, m.y) AS r FROM qm m JOIN pi ON pi.{key} = m.{key} AND pi.i = m.i"
        f" JOIN pj ON pj.{key} = m.{key} AND pj.j = m.j AND pj.rep = pi.rep JOIN qm s ON s.{key} = m.{key} AND s.i = pi.p AND s.j = pj.p GROUP BY 1, 2),"
        f" pv AS (SELECT {key}, any_value(observed) AS observed, count(*) FILTER (WHERE abs(r) >= abs(observed) - 1e-12) AS exceedances,"
        f" CASE WHEN any_value(observed) IS NULL THEN 1.0::DOUBLE ELSE (count(*) FILTER (WHERE abs(r) >= abs(observed) - 1e-12) + 1) / {reps + 1}.0::DOUBLE END AS p"
        f" FROM ob JOIN st USING ({key}) GROUP BY 1)"
    )


@query(
    "crossed_permutation",
    f"WITH {CX}, rz AS (SELECT 1 AS one, context, model_seed, {_resid('delta_standard')} AS x, {_resid('delta_forced')} AS y FROM ip),"
    f" {_perm_sql('rz', 'one', REPS)} SELECT {R('observed')} AS observed, exceedances, {R('p')} AS p_value FROM pv",
)
def _(spark, sf):
    rows = variance.two_way_residuals(
        interaction(spark, sf), [], "context", "model_seed", ["delta_standard", "delta_forced"]
    )
    out = resample.crossed_permutation(
        rows, [], "context", "model_seed", "delta_standard_residual", "delta_forced_residual", resamples=REPS
    )
    return rounded(out, "observed", "p_value")


def _loo_sql(source: str, key: str) -> str:
    """CTE lo over ``source(key, context, model_seed, x, y)`` raw values."""
    over = f"{key}, omitted_axis, omitted_level"
    return (
        f"om AS (SELECT s.*, 'context' AS omitted_axis, CAST(o.context AS VARCHAR) AS omitted_level FROM {source} s"
        f" JOIN (SELECT DISTINCT {key}, context FROM {source}) o ON o.{key} = s.{key} AND o.context <> s.context UNION ALL"
        f" SELECT s.*, 'model', CAST(o.model_seed AS VARCHAR) FROM {source} s"
        f" JOIN (SELECT DISTINCT {key}, model_seed FROM {source}) o ON o.{key} = s.{key} AND o.model_seed <> s.model_seed),"
        f" lr AS (SELECT {over}, round({_resid('x', over)}, 12) AS x, round({_resid('y', over)}, 12) AS y FROM om),"
        f" lk AS (SELECT *, {_avg_rank('x', over)} AS rx, {_avg_rank('y', over)} AS ry FROM lr),"
        f" lo AS (SELECT {over}, count(*) AS n, CASE WHEN max(x) > min(x) AND max(y) > min(y) AND count(*) >= 3 THEN corr(x, y) END AS pearson,"
        f" CASE WHEN max(x) > min(x) AND max(y) > min(y) AND count(*) >= 3 THEN corr(rx, ry) END AS spearman FROM lk GROUP BY {over})"
    )


@query(
    "leave_one_out",
    f"WITH {CX}, src AS (SELECT 1 AS one, context, model_seed, delta_standard AS x, delta_forced AS y FROM ip), {_loo_sql('src', 'one')}"
    f" SELECT omitted_axis, omitted_level, n, {R('pearson')} AS pearson, {R('spearman')} AS spearman FROM lo",
)
def _(spark, sf):
    rows = interaction(spark, sf).withColumn("one", F.lit(1))
    out = variance.leave_one_out(rows, ["one"], "context", "model_seed", "delta_standard", "delta_forced")
    return rounded(out.drop("one"), "pearson", "spearman")


_MECH = {"m_standard": "mae_candidate_standard - mae_control_standard", "m_forced": "mae_candidate_forced - mae_control_forced"}
_SECOND = {"m_h": "h_candidate"}
_SCREEN_REPS = 10_000
_SCREEN = (
    f"{CX}, src AS ("
    + " UNION ALL ".join(
        f"SELECT '{k}' AS mechanism, context, model_seed, {v} AS x, h_control AS y FROM ip" for k, v in {**_MECH, **_SECOND}.items()
    )
    + f"), raw AS (SELECT *, {_avg_rank('x', 'mechanism')} AS rx, {_avg_rank('y', 'mechanism')} AS ry FROM src),"
    " rw AS (SELECT mechanism, corr(x, y) AS raw_pearson, corr(rx, ry) AS raw_spearman FROM raw GROUP BY 1),"
    " dm AS (SELECT mechanism, round(x - avg(x) OVER w, 12) AS x, round(y - avg(y) OVER w, 12) AS y FROM src WINDOW w AS (PARTITION BY mechanism, context)),"
    f" dk AS (SELECT *, {_avg_rank('x', 'mechanism')} AS rx, {_avg_rank('y', 'mechanism')} AS ry FROM dm),"
    " dc AS (SELECT mechanism, corr(x, y) AS context_pearson, corr(rx, ry) AS context_spearman FROM dk GROUP BY 1),"
    f" rz AS (SELECT mechanism, context, model_seed, round({_resid('x', 'mechanism')}, 12) AS x, round({_resid('y', 'mechanism')}, 12) AS y FROM src),"
    f" rk AS (SELECT *, {_avg_rank('x', 'mechanism')} AS rx, {_avg_rank('y', 'mechanism')} AS ry FROM rz),"
    " tw AS (SELECT mechanism, corr(x, y) AS pearson, corr(rx, ry) AS spearman FROM rk GROUP BY 1),"
    f" {_perm_sql('rz', 'mechanism', _SCREEN_REPS)}, {_loo_sql('src', 'mechanism')},"
    " hm AS (SELECT mechanism, p, row_number() OVER (ORDER BY p, mechanism) AS r, count(*) OVER () AS m FROM pv WHERE mechanism <> 'm_h'),"
    " ha AS (SELECT mechanism, least(1.0::DOUBLE, (SELECT max((m - r + 1) * p) FROM hm x WHERE x.r <= hm.r)) AS holm FROM hm),"
    " ss AS (SELECT mechanism, avg(CASE WHEN sign(lo.pearson) = sign(tw.pearson) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE omitted_axis = 'context') AS sc,"
    " avg(CASE WHEN sign(lo.pearson) = sign(tw.pearson) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) FILTER (WHERE omitted_axis = 'model') AS sm"
    " FROM lo JOIN tw USING (mechanism) GROUP BY 1)"
)
_SCREEN_NUM = ["raw_pearson", "raw_spearman", "context_pearson", "context_spearman", "pearson", "spearman"]


@query(
    "association_screen",
    f"WITH {_SCREEN} SELECT mechanism, CASE mechanism WHEN 'm_h' THEN 'secondary' ELSE 'primary' END AS family, "
    + ", ".join(f"{R(c)} AS {c}" for c in _SCREEN_NUM)
    + f", {R('p')} AS permutation_p, CASE WHEN holm IS NULL THEN NULL ELSE {R('holm')} END AS permutation_p_holm, {R('sc')} AS same_sign_context, {R('sm')} AS same_sign_model,"
    " coalesce(abs(pearson) >= 0.35 AND abs(spearman) >= 0.30 AND pearson * spearman > 0 AND holm <= 0.05 AND sc >= 0.8 AND sm >= 0.8, false) AS passes"
    " FROM rw JOIN dc USING (mechanism) JOIN tw USING (mechanism) JOIN pv USING (mechanism) JOIN ss USING (mechanism) LEFT JOIN ha USING (mechanism)",
)
def _(spark, sf):
    rows = interaction(spark, sf).withColumns(
        {k: F.expr(v) for k, v in {**_MECH, **_SECOND}.items()}
    )
    out = variance.association_screen(
        rows, [], "context", "model_seed", "h_control", list(_MECH), list(_SECOND), resamples=_SCREEN_REPS
    )
    return rounded(
        out, *_SCREEN_NUM, "permutation_p", "permutation_p_holm", "same_sign_context", "same_sign_model"
    )
