"""Streaming queries over the event table, run to the end of what is there."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from longspark.catalog.checks import _RAW, _REASONS, raw_events
from longspark.catalog.fixtures import EV1, H_US, R, TASK, events, micros, rounded, table
from longspark.catalog.registry import query
from longspark.session import work_folder
from longspark.streaming import stateful, streams

DELAY = "1 day"
DAY_US = 86_400_000_000


def _folders(spark):
    base = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    return f"{base}/table", f"{base}/checkpoint"


def _stream(spark, sf):
    schema = table(spark, sf, "events").schema
    raw = streams.file_stream(spark, sf, schema, pattern="events.parquet")
    kind = (
        F.when(F.col("event_type") == "purchase", "intervention")
        .when(F.col("event_type") == "signup", "encounter")
        .otherwise("observation")
    )
    return raw.select(
        F.col("user_id").cast("string").alias("patient_id"),
        micros("ts").alias("us"),
        F.col("event_id").alias("seq"),
        F.col("event_type").alias("code"),
        "value",
        kind.alias("event_type"),
    )


# windows that end before the final watermark are emitted
_MARK = f"(SELECT (max(us) // 1000) * 1000 - {DAY_US} AS w FROM ev1)"


@query(
    "stream_windows",
    f"WITH {EV1}, t AS (SELECT code, us - us % {DAY_US} AS start_us FROM ev1)"
    f" SELECT code, start_us, start_us + {DAY_US} AS end_us, count(*) AS n FROM t WHERE start_us + {DAY_US} <= {_MARK} GROUP BY 1, 2",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    streams.run_to_table(streams.windows(_stream(spark, sf), ["code"], length="1 day", delay=DELAY), out, checkpoint)
    return spark.read.parquet(out)


_SLIDE = DAY_US // 4


@query(
    "stream_sliding_windows",
    f"WITH {EV1}, t AS (SELECT code, us - us % {_SLIDE} - k * {_SLIDE} AS start_us FROM ev1, (SELECT unnest(range(0, 4)) AS k))"
    f" SELECT code, start_us, start_us + {DAY_US} AS end_us, count(*) AS n FROM t WHERE start_us + {DAY_US} <= {_MARK} GROUP BY 1, 2",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    windows = streams.windows(_stream(spark, sf), ["code"], length="1 day", slide="6 hours", delay=DELAY)
    streams.run_to_table(windows, out, checkpoint)
    return spark.read.parquet(out)


_GAP = 12 * 3_600_000_000


@query(
    "stream_sessions",
    f"WITH {EV1}, g AS (SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY patient_id ORDER BY us) < {_GAP} THEN 0 ELSE 1 END AS b FROM ev1),"
    " s AS (SELECT *, sum(b) OVER (PARTITION BY patient_id ORDER BY us ROWS UNBOUNDED PRECEDING) AS k FROM g)"
    f" SELECT patient_id, min(us) AS start_us, max(us) + {_GAP} AS end_us, count(*) AS n FROM s GROUP BY patient_id, k HAVING max(us) + {_GAP} <= {_MARK}",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    streams.run_to_table(streams.sessions(_stream(spark, sf), ["patient_id"], gap="12 hours", delay=DELAY), out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_history",
    f"WITH {EV1} SELECT patient_id, code, arg_max(value, [us, seq]) AS last_value, max(us) AS last_us, count(*) AS count, min(us) AS first_us"
    " FROM ev1 WHERE event_type = 'observation' GROUP BY 1, 2",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    keys = ["patient_id", "code"]
    rows = _stream(spark, sf).where("event_type = 'observation'")
    streams.run_to_latest(streams.history(rows, keys), out, checkpoint)
    return streams.latest(spark, out, keys)


# the stream holds observations only, so they alone move its watermark
_DAYS = f"{DAY_US}.0::DOUBLE"


@query(
    "stream_running_history",
    f"WITH {EV1}, o AS (SELECT *, row_number() OVER w AS k, first_value(us) OVER w AS f, lag(us) OVER w AS p, lag(value) OVER w AS last_value FROM ev1"
    " WHERE event_type = 'observation' WINDOW w AS (PARTITION BY patient_id, code ORDER BY us, seq))"
    " SELECT patient_id, code, us, seq, value, last_value, p AS last_us, k - 1 AS n_before,"
    f" {R(f'(us - f) / {_DAYS}')} AS elapsed_days, CASE WHEN p IS NULL THEN NULL ELSE {R(f'(us - p) / {_DAYS}')} END AS gap_days"
    " FROM o WHERE us <= " + _MARK.replace("FROM ev1", "FROM ev1 WHERE event_type = 'observation'"),
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    rows = _stream(spark, sf).where("event_type = 'observation'")
    stateful.run_keyed(stateful.running_history(rows, ["patient_id", "code"], delay=DELAY), out, checkpoint)
    return rounded(spark.read.parquet(out), "elapsed_days", "gap_days")


_HIT = (
    "SELECT s.patient_id, s.us, s.seq, EXISTS (SELECT 1 FROM ev1 t WHERE t.patient_id = s.patient_id AND t.event_type = 'intervention'"
    f" AND t.us > s.us AND t.us <= s.us + {H_US}) AS hit FROM ev1 s"
)


@query(
    "stream_horizon",
    f"WITH {EV1}, h AS ({_HIT}) SELECT patient_id, us, seq, CAST(hit AS BIGINT) AS horizon_label FROM h WHERE us + {H_US} < {_MARK}",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    steps = _stream(spark, sf).select("patient_id", "us", "seq")
    target = F.col("event_type") == "intervention"
    joined = streams.horizon(steps, _stream(spark, sf), target, days=TASK.event_horizon_days, delay=DELAY)
    streams.run_to_table(joined, out, checkpoint)
    labels = streams.horizon_labels(spark.read.parquet(out))
    # a hit is known early; labels count once the whole horizon has passed
    mark = events(spark, sf).agg((F.floor(F.max("us") / 1000) * 1000 - DAY_US).alias("_w"))
    one = F.lit(1)
    passed = labels.withColumn("_one", one).join(F.broadcast(mark.withColumn("_one", one)), "_one")
    return passed.where(F.col("us") + H_US < F.col("_w")).drop("_w", "_one")


@query(
    "stream_horizon_labels",
    f"WITH {EV1}, h AS ({_HIT}) SELECT patient_id, us, seq, CAST(hit AS BIGINT) AS horizon_label FROM h WHERE us + {H_US} <= {_MARK}",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    labels = stateful.horizon_labels(
        _stream(spark, sf), F.col("event_type") == "intervention", days=TASK.event_horizon_days, delay=DELAY
    )
    stateful.run_keyed(labels, out, checkpoint)
    return spark.read.parquet(out)


@query(
    "stream_check_events",
    f"WITH {_RAW} SELECT {_REASONS} AS reasons, count(*) AS n FROM raw GROUP BY 1",
)
def _(spark, sf):
    source, _ = _folders(spark)
    raw_events(spark, sf).write.parquet(source)
    good, checkpoint = _folders(spark)
    bad = f"{good}-bad"
    stream = streams.file_stream(spark, source, spark.read.parquet(source).schema)
    streams.check_in_flight(stream, good, bad, checkpoint)
    count = F.count(F.lit(1)).alias("n")
    kept = spark.read.parquet(good).agg(count).select(F.lit("").alias("reasons"), "n")
    held = spark.read.parquet(bad).groupBy(F.array_join("reasons", ",").alias("reasons")).agg(count)
    return kept.unionByName(held)


def _cell_documents(spark, sf):
    """A small document per (size, mode, unit) with a share of broken ones."""
    li = table(spark, sf, "lineitem")
    cell = li.select(
        F.when(F.col("l_linenumber") % 2 == 1, 5).otherwise(40).alias("n_train"),
        F.when(F.col("l_linestatus") == "F", "none").otherwise("time_scaled").alias("flow_mode"),
        (F.col("l_suppkey") % 5).alias("u"),
    ).distinct()
    name = F.concat(F.lit("d2a__smooth__cohort"), "u", F.lit("__subset"), "u", F.lit("__model"), "u", F.lit("__n"), "n_train", F.lit("__"), "flow_mode")
    doc = F.to_json(F.struct(F.struct(name.alias("cell_id"), F.col("n_train"), F.col("flow_mode")).alias("cell")))
    return cell.select(name.alias("cell_id"), F.when(F.col("u") == 0, "{broken").otherwise(doc).alias("value"))


_CELLS = "(SELECT DISTINCT CASE WHEN l_linenumber % 2 = 1 THEN 5 ELSE 40 END AS n_train, CASE l_linestatus WHEN 'F' THEN 'none' ELSE 'time_scaled' END AS flow_mode, l_suppkey % 5 AS u FROM lineitem)"


@query(
    "stream_progress",
    f"SELECT CAST(n_train AS BIGINT) AS n_train, flow_mode, count(*) AS done, CAST(0 AS BIGINT) AS invalid, CAST(25 AS BIGINT) AS expected FROM {_CELLS} WHERE u <> 0 GROUP BY 1, 2"
    f" UNION ALL SELECT NULL, NULL, 0, count(*), NULL FROM {_CELLS} WHERE u = 0",
)
def _(spark, sf):
    source, _ = _folders(spark)
    _cell_documents(spark, sf).repartition("cell_id").write.partitionBy("cell_id").text(source)
    out, checkpoint = _folders(spark)
    plan = _cell_documents(spark, sf).select(
        F.regexp_extract("cell_id", r"__n(\d+)__", 1).cast("bigint").alias("n_train"),
        F.regexp_extract("cell_id", r"__n\d+__(.+)$", 1).alias("flow_mode"),
    )
    expected = plan.distinct().withColumn("expected", F.lit(25).cast("bigint"))
    done = streams.progress(streams.cell_stream(spark, source), expected, modes=["none", "time_scaled"], sizes=[5, 40])
    streams.run_to_latest(done, out, checkpoint)
    return streams.latest(spark, out, ["n_train", "flow_mode"])


@query(
    "stream_cells_once",
    "SELECT o_custkey, count(*) AS n FROM (SELECT DISTINCT o_custkey FROM orders) GROUP BY 1",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    schema = table(spark, sf, "orders").schema
    raw = streams.file_stream(spark, sf, schema, pattern="orders.parquet")
    copies = raw.select("o_custkey", F.timestamp_micros(micros("o_orderdate")).alias("arrived"))
    streams.run_to_table(streams.cells_once(copies, ["o_custkey"], delay="3650 days"), out, checkpoint)
    return spark.read.parquet(out).groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"))


@query(
    "stream_first_copies",
    "WITH c AS (SELECT o_custkey, (epoch_us(o_orderdate::TIMESTAMP))::BIGINT AS arrived_us, sha256(concat_ws('|', o_orderstatus, o_orderpriority)) AS digest FROM orders),"
    " f AS (SELECT o_custkey, arg_min(digest, (arrived_us, digest)) AS digest_1, min(arrived_us) AS us_1 FROM c GROUP BY 1)"
    " SELECT o_custkey, us_1 AS arrived_us, digest_1 AS digest, 'first' AS status FROM f"
    " UNION ALL SELECT o_custkey, arrived_us, digest, 'conflict' FROM c JOIN f USING (o_custkey) WHERE digest <> digest_1",
)
def _(spark, sf):
    out, checkpoint = _folders(spark)
    raw = streams.file_stream(spark, sf, table(spark, sf, "orders").schema, pattern="orders.parquet")
    copies = raw.withColumn("arrived", F.timestamp_micros(micros("o_orderdate")))
    content = F.concat_ws("|", "o_orderstatus", "o_orderpriority").cast("binary")
    found = stateful.first_copies(copies, ["o_custkey"], content, keep_days=3650.0)
    stateful.run_keyed(found, out, checkpoint)
    return spark.read.parquet(out)
