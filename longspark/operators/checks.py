"""Data-quality checks that return findings instead of stopping at the first."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspark.functions.numeric import finite


def check_row(code: str, ok: Column, subject: Column, detail: Column) -> list[Column]:
    return [F.lit(code).alias("code"), ok.alias("ok"), subject.alias("subject"), detail.alias("detail")]


def header_columns(spark: SparkSession, path: str) -> DataFrame:
    """``(path, columns)`` of every CSV file of a delivery, from its first line."""
    lines = spark.read.text(path, recursiveFileLookup=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("at"), "value"
    )
    # the first split of a file starts with the header line
    first = lines.where("at = 0").groupBy("path").agg(F.first("value").alias("header"))
    return first.select("path", F.split("header", ",").alias("columns"))


def schema_drift(headers: DataFrame, required: list[str]) -> DataFrame:
    """Files that lack required columns, with the columns they lack."""
    wanted = F.array(*[F.lit(c) for c in required])
    names = F.transform("columns", lambda c: F.trim(F.regexp_replace(c, '"', "")))
    out = headers.withColumn("missing", F.array_sort(F.array_except(wanted, names)))
    return out.where(F.size("missing") > 0).select("path", "missing")


def check_unique(df: DataFrame, key: list[str]) -> DataFrame:
    """Keys that occur more than once, with their count."""
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_finite(
    df: DataFrame, columns: list[str], *, by: tuple[str, ...] = (), non_negative: bool = False, integer: bool = False, positive: bool = False
) -> DataFrame:
    """Per column: how many values are missing, not finite, or break the sign or integer rule."""
    pairs = F.explode(
        F.array(*[F.struct(F.lit(c).alias("column"), F.expr(f"try_cast(`{c}` AS double)").alias("x")) for c in columns])
    ).alias("_p")
    long = df.select(*by, pairs).select(*by, "_p.column", "_p.x")
    x = F.col("x")
    good = finite(x)
    return long.groupBy(*by, "column").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count_if(~F.coalesce(good, F.lit(False))).alias("not_finite"),
        F.count_if(good & (x < 0) if non_negative else F.lit(False)).alias("negative"),
        F.count_if(good & (x <= 0) if positive else F.lit(False)).alias("not_positive"),
        F.count_if(good & (x % 1 != 0) if integer else F.lit(False)).alias("not_integer"),
    )


def check_domain(df: DataFrame, column: str, allowed: list, *, exact: bool = False) -> DataFrame:
    """Values outside the declared list and, when ``exact``, declared values that never occur."""
    seen = df.groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    unexpected = seen.where(~F.coalesce(F.col(column).isin(*allowed), F.lit(False))).select(
        F.col(column).cast("string").alias("value"), F.lit("unexpected").alias("finding"), "n"
    )
    if not exact:
        return unexpected
    declared = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, allowed))).alias(column))
    absent = declared.join(seen, column, "left_anti").select(
        F.col(column).cast("string").alias("value"), F.lit("absent").alias("finding"), F.lit(0).cast("bigint").alias("n")
    )
    return unexpected.unionByName(absent)


def key_sets(left: DataFrame, right: DataFrame, key: list[str]) -> DataFrame:
    """Distinct keys of both sides with their row counts; one shuffle."""
    both = left.select(*key, F.lit(1).alias("_l"), F.lit(0).alias("_r")).unionByName(
        right.select(*key, F.lit(0).alias("_l"), F.lit(1).alias("_r"))
    )
    return both.groupBy(*key).agg(F.sum("_l").alias("left_rows"), F.sum("_r").alias("right_rows"))


def check_plan(plan: DataFrame, observed: DataFrame, key: list[str], *, by: tuple[str, ...] = ()) -> DataFrame:
    """Planned against observed keys: matched, missing and unexpected counts."""
    keys = key_sets(plan, observed, key)
    return keys.groupBy(*by).agg(
        F.count_if((F.col("left_rows") > 0) & (F.col("right_rows") > 0)).alias("matched"),
        F.count_if(F.col("right_rows") == 0).alias("missing"),
        F.count_if(F.col("left_rows") == 0).alias("unexpected"),
        F.count_if((F.col("left_rows") > 0) & (F.col("right_rows") > 1)).alias("repeated"),
    )


def check_group_size(df: DataFrame, keys: list[str], members: list[str], expected: int) -> DataFrame:
    """Groups without exactly ``expected`` rows and as many distinct members."""
    distinct = df.groupBy(*keys, *members).agg(F.count(F.lit(1)).alias("_n"))
    sizes = distinct.groupBy(*keys).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("members"))
    return sizes.where((F.col("rows") != expected) | (F.col("members") != expected))


def check_constant(df: DataFrame, keys: list[str], column: str) -> DataFrame:
    """Smallest and largest value per group, and whether they are one value."""
    out = df.groupBy(*keys).agg(F.min(column).alias("smallest"), F.max(column).alias("largest"))
    return out.withColumn("constant", F.coalesce(F.col("smallest") == F.col("largest"), F.lit(False)))


def check_reserved_keys(df: DataFrame, reserved: dict[str, list[int]]) -> DataFrame:
    """Rows that use a protected value in any of the named columns, with the columns hit."""
    hits = F.array_compact(
        F.array(*[F.when(F.col(c).isin(*values), F.lit(c)) for c, values in reserved.items()])
    )
    return df.withColumn("reserved_columns", hits).where(F.size("reserved_columns") > 0)


STRING_FIELDS = ("ablation", "benchmark", "metric", "model", "site_or_shift", "split", "world")
INTEGER_FIELDS = (
    "cohort_seed", "model_seed", "n_fit", "n_train", "n_validation", "seed", "subset_seed", "trainable_parameters",
)


def check_metric_row(rows: DataFrame) -> DataFrame:
    """Metric rows read as text, with the rules each breaks in ``reasons``."""
    def empty(c: str) -> Column:
        return F.col(c).isNull() | (F.col(c) == "")

    rules = [(empty(c), f"empty_{c}") for c in STRING_FIELDS]
    rules += [(~F.coalesce(F.col(c).rlike(r"^-?\d+$"), F.lit(False)), f"not_integer_{c}") for c in INTEGER_FIELDS]
    number = F.expr("try_cast(value AS double)")
    rules += [
        (F.col("value").isNotNull() & ~F.coalesce(finite(number), F.lit(False)), "not_finite_value"),
        (F.coalesce(F.col("backend") == "", F.lit(False)), "empty_backend"),
        (~F.col("seed").eqNullSafe(F.col("subset_seed")), "seed_differs"),
    ]
    reasons = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, n in rules]))
    return rows.withColumn("reasons", reasons)


def flag_summary(df: DataFrame, by: list[str], flag: Column) -> DataFrame:
    """Any passed, how many passed, and whether exactly one row is marked."""
    f = df.withColumn("_f", flag).groupBy(*by)
    passed = F.count_if(F.coalesce(F.col("_f"), F.lit(False)))
    return f.agg(
        F.coalesce(F.bool_or("_f"), F.lit(False)).alias("any_passed"),
        passed.alias("passed"),
        (passed == 1).alias("exactly_one"),
        F.count_if(F.col("_f").isNull()).alias("unreadable"),
    )


def union_checks(parts: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
