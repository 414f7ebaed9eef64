"""Structured Streaming forms of the event and result operators.

Stateful work is left to Spark's own aggregations, windows, deduplication and interval joins;
their state is keyed, checkpointed and bounded by the watermark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspark.schema import MICROS_PER_DAY
from longspark.sources import cells, events

TIME = "event_time"


def file_stream(spark: SparkSession, path: str, schema: T.StructType, *, pattern: str = "*.parquet", files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format("parquet").schema(schema).option("pathGlobFilter", pattern)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.load(path)


def cell_stream(spark: SparkSession, path: str) -> DataFrame:
    """Arriving cell files as ``(path, content, arrived)``."""
    raw = (
        spark.readStream.format("text")
        .schema("value string")
        .option("wholetext", "true")
        .option("recursiveFileLookup", "true")
        .load(path)
    )
    return raw.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("value").alias("content"),
        F.col("_metadata.file_modification_time").alias("arrived"),
    )


def with_time(stream: DataFrame, *, delay: str) -> DataFrame:
    """Event time of the micros column, with a watermark."""
    return stream.withColumn(TIME, F.timestamp_micros("us")).withWatermark(TIME, delay)


def progress(files: DataFrame, expected: DataFrame, *, modes: list[str], sizes: list[int]) -> DataFrame:
    """Done, invalid and expected cells per size and mode; for update or complete mode.

    ``expected`` is a static table ``(n_train, flow_mode, expected)``.
    """
    parsed = cells.parse_cells(files)
    cell = F.col("doc.cell")
    valid = (
        (F.length(cell["cell_id"]) > 0)
        & (cell["cell_id"] == cells.cell_of_path(F.col("path")))
        & cell["n_train"].isin(*sizes)
        & cell["flow_mode"].isin(*modes)
    )
    valid = F.coalesce(valid, F.lit(False))
    counts = parsed.groupBy(
        F.when(valid, cell["n_train"]).alias("n_train"), F.when(valid, cell["flow_mode"]).alias("flow_mode")
    ).agg(F.count_if(valid).alias("done"), F.count_if(~valid).alias("invalid"))
    return counts.join(expected, ["n_train", "flow_mode"], "left")


def cells_once(stream: DataFrame, key: list[str], *, delay: str) -> DataFrame:
    """The first copy of every cell within the watermark; conflicts show in the batch check."""
    return stream.withWatermark("arrived", delay).dropDuplicatesWithinWatermark(key)


def history(stream: DataFrame, keys: list[str]) -> DataFrame:
    """Running last value, its time, count and first time per key; for update or complete mode.

    A keyed aggregation: partial results combine before the shuffle, so a busy key is no
    bottleneck, and late rows still find their place.
    """
    seen = F.col("value").isNotNull() & ~F.isnan("value")
    order = F.when(seen, F.struct("us", "seq"))
    return stream.groupBy(*keys).agg(
        F.max_by("value", order).alias("last_value"),
        F.max(F.when(seen, F.col("us"))).alias("last_us"),
        F.count(F.when(seen, 1)).alias("count"),
        F.min("us").alias("first_us"),
    )


def horizon(steps: DataFrame, events_: DataFrame, target: Column, *, days: float, delay: str) -> DataFrame:
    """Steps joined with the target events in (t, t+h]; a step without one comes out with null
    once the watermark has passed its horizon. Collapse with ``horizon_labels``."""
    h = int(days * MICROS_PER_DAY)
    left = with_time(steps, delay=delay)
    # rare targets must not hold the watermark back: it advances on all events, and the filter
    # names the event time so that it is not pushed below the watermark
    seen = with_time(events_, delay=delay).where(F.when(F.col(TIME).isNotNull(), target))
    right = seen.select(
        F.col("patient_id").alias("_id"), F.col(TIME).alias("target_time"), F.col("us").alias("target_us")
    )
    span = F.expr(f"INTERVAL {h} MICROSECONDS")
    condition = (
        (F.col("patient_id") == F.col("_id"))
        & (F.col("target_time") > F.col(TIME))
        & (F.col("target_time") <= F.col(TIME) + span)
    )
    return left.join(right, condition, "leftOuter").select("patient_id", "us", "seq", "target_us")


def horizon_labels(joined: DataFrame) -> DataFrame:
    """One row per step: whether any target fell into its horizon."""
    return joined.groupBy("patient_id", "us", "seq").agg(
        F.max(F.col("target_us").isNotNull().cast("bigint")).alias("horizon_label")
    )


def windows(stream: DataFrame, keys: list[str], *, length: str, slide: str | None = None, delay: str) -> DataFrame:
    """Event counts of tumbling or sliding windows."""
    timed = with_time(stream, delay=delay)
    span = F.window(TIME, length, slide) if slide else F.window(TIME, length)
    out = timed.groupBy(*keys, span).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, *_bounds("window"), "n")


def sessions(stream: DataFrame, keys: list[str], *, gap: str, delay: str) -> DataFrame:
    """Event counts of sessions that end after a gap."""
    timed = with_time(stream, delay=delay)
    out = timed.groupBy(*keys, F.session_window(TIME, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*keys, *_bounds("session_window"), "n")


def _bounds(name: str) -> list:
    return [
        F.unix_micros(F.col(f"{name}.start")).alias("start_us"),
        F.unix_micros(F.col(f"{name}.end")).alias("end_us"),
    ]


def run_to_table(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available and append to a Parquet table."""
    query = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def run_to_latest(stream: DataFrame, path: str, checkpoint: str) -> None:
    """Process everything available; keep every batch of an updating result under its number.

    A batch that is run again after a failure overwrites its own folder.
    """

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    run_batches(stream, keep, checkpoint, mode="update")


def latest(spark: SparkSession, path: str, keys: list[str]) -> DataFrame:
    """The last update of every key."""
    rows = spark.read.option("basePath", path).parquet(path)
    values = [c for c in rows.columns if c not in (*keys, "batch")]
    best = rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "batch").alias("_v"))
    return best.select(*keys, *[F.col(f"_v.{c}").alias(c) for c in values])


def run_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, *, mode: str = "append") -> None:
    query = (
        stream.writeStream.outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .foreachBatch(each)
        .start()
    )
    query.awaitTermination()


def check_in_flight(raw: DataFrame, good: str, bad: str, checkpoint: str) -> None:
    """Type arriving text rows; accepted rows and quarantined rows go to two tables.

    Each batch owns its folder, so a repeated batch does not write twice.
    """

    def split(batch: DataFrame, number: int) -> None:
        typed = events.type_events(batch)
        events.accepted(typed).write.mode("overwrite").parquet(f"{good}/batch={number}")
        events.quarantine(typed).write.mode("overwrite").parquet(f"{bad}/batch={number}")

    run_batches(raw, split, checkpoint)
