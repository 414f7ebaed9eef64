"""How the registered queries turn the given tables into the library's input shapes.

Each adapter has a Spark form and an SQL form that state the same rule.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspark.schema import Task

HOUR = 3_600_000_000
TASK = Task(
    value_codes=("click", "error", "view"),
    event_target_type="intervention",
    event_horizon_days=3.0,
    jump_codes=("purchase",),
)
H_US = TASK.horizon_us


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def micros(column: str) -> Column:
    """Micros of a wall-clock column taken as UTC, whatever the session's zone."""
    instant = F.col(column).cast("timestamp")
    return F.unix_micros(F.from_utc_timestamp(instant, F.current_timezone()))


def events(spark: SparkSession, sf: str, *, hourly: bool = False) -> DataFrame:
    """The event table; ``hourly`` truncates the instants so that events share steps."""
    raw = table(spark, sf, "events")
    us = micros("ts")
    if hourly:
        us = us - us % F.lit(HOUR)
    kind = (
        F.when(F.col("event_type") == "purchase", "intervention")
        .when(F.col("event_type") == "signup", "encounter")
        .otherwise("observation")
    )
    even = F.get_json_object("props", "$.k").cast("int") % 2 == 0
    return raw.select(
        F.col("user_id").cast("string").alias("patient_id"),
        us.alias("us"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("code"),
        F.col("value"),
        kind.alias("event_type"),
        (F.col("user_id") % 2).alias("site"),
        ((F.col("event_type") == "signup") & even).alias("opportunity"),
        F.col("props").alias("metadata"),
    )


def _ev_sql(us: str) -> str:
    return f"""SELECT CAST(user_id AS VARCHAR) AS patient_id, {us} AS us, event_id AS seq,
 event_type AS code, value,
 CASE event_type WHEN 'purchase' THEN 'intervention' WHEN 'signup' THEN 'encounter'
  ELSE 'observation' END AS event_type,
 user_id % 2 AS site,
 (event_type = 'signup' AND CAST(json_extract_string(props, '$.k') AS INTEGER) % 2 = 0) AS opportunity,
 props AS metadata FROM events"""


EV1 = f"ev1 AS ({_ev_sql('epoch_us(ts)')})"
EV = f"ev AS ({_ev_sql(f'epoch_us(ts) - epoch_us(ts) % {HOUR}')})"


def _steps_sql() -> str:
    parts = []
    for c in TASK.value_codes:
        seen = f"event_type = 'observation' AND code = '{c}' AND value IS NOT NULL"
        parts.append(
            f"coalesce(arg_max(value, seq) FILTER (WHERE {seen}), 0.0::DOUBLE) AS value_{c},"
            f" CAST(count(*) FILTER (WHERE {seen}) > 0 AS BIGINT) AS mask_{c},"
            f" count(*) FILTER (WHERE {seen}) AS n_{c}"
        )
    for t in ("observation", "intervention", "encounter"):
        parts.append(f"CAST(bool_or(event_type = '{t}') AS BIGINT) AS is_{t}")
    parts.append(
        "CAST(bool_or(NOT (event_type = 'encounter' AND opportunity)) AS BIGINT) AS update_mask"
    )
    parts.append(
        "CAST(bool_or(event_type = 'intervention' AND code = 'purchase') AS BIGINT) AS jump_eligible"
    )
    parts.append("count(*) FILTER (WHERE event_type = 'intervention') AS n_intervention")
    parts.append("count(*) AS n_events")
    return (
        "steps AS (SELECT patient_id, us, row_number() OVER (PARTITION BY patient_id ORDER BY us) - 1"
        " AS step, " + ", ".join(parts) + " FROM ev GROUP BY patient_id, us)"
    )


STEPS = f"{EV}, {_steps_sql()}"


def R(expr: str) -> str:
    """Six decimals, without a negative zero."""
    return f"(CASE WHEN round({expr}, 6) = 0 THEN 0.0::DOUBLE ELSE CAST(round({expr}, 6) AS DOUBLE) END)"


def r6(column: str | Column) -> Column:
    c = F.col(column) if isinstance(column, str) else column
    c = F.round(c.cast("double"), 6)
    return F.when(c == 0, F.lit(0.0)).otherwise(c)


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: r6(n) for n in names})


def sql_draw(*parts: str) -> str:
    return f"CAST('0x' || substr(md5(concat_ws('|', {', '.join(parts)})), 1, 15) AS BIGINT)"


def sql_uniform(*parts: str) -> str:
    return f"((CAST({sql_draw(*parts)} AS DOUBLE) + 0.5::DOUBLE) / 1152921504606846976.0::DOUBLE)"


def sql_normal(*parts: str) -> str:
    return (
        f"(sqrt(-2.0::DOUBLE * ln({sql_uniform(*parts, chr(39) + 'radius' + chr(39))}))"
        f" * cos(6.283185307179586::DOUBLE * {sql_uniform(*parts, chr(39) + 'angle' + chr(39))}))"
    )
