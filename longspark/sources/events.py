"""Event files: text rows to typed events with reject reasons, and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from longspark.operators.scan import exact_starts
from longspark.schema import EVENT_FILE_COLUMNS, EVENT_FILE_SCHEMA, EVENT_TYPES
from longspark.session import materialize

# ISO-8601 date and time with an explicit offset
_ZONED = r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$"

# quotes inside a quoted field are doubled
_CSV = {"header": "true", "quote": '"', "escape": '"'}


#: Blocks of files whose first numbers may be broadcast.
MAX_BROADCAST_BLOCKS = 500_000


def in_file_order(raw: DataFrame, name: str = "seq") -> DataFrame:
    """Number the rows of a file-based frame from 0 by (path, place in the file), however Spark has split the files.

    A row knows its file and block, and rows of a block are read in order. The rows are written once with these; counts of
    blocks are added up over the blocks before, so no task sees all rows. ``raw`` must come straight from a file reader.
    """
    marked = raw.withColumns(
        {"_path": F.col("_metadata.file_path"), "_block": F.col("_metadata.file_block_start"), "_read": F.monotonically_increasing_id()}
    )
    rows = materialize(marked)
    counted = rows.groupBy("_path", "_block").agg(F.min("_read").alias("_least"), F.count(F.lit(1)).alias("_rows"))
    blocks = materialize(counted)
    number = blocks.count()
    starts = exact_starts(blocks, [], ["_path", "_block"], number, weight="_rows")
    starts = F.broadcast(starts) if number <= MAX_BROADCAST_BLOCKS else starts
    placed = rows.join(starts, ["_path", "_block"])
    place = F.col("_start") + F.col("_read") - F.col("_least")
    return placed.select(*[c for c in raw.columns if c != name], place.alias(name))


def read_event_files(spark: SparkSession, path: str) -> DataFrame:
    """Event CSV files as text columns; ``seq`` numbers rows from 0 in file order, files by path."""
    reader = spark.read.schema(EVENT_FILE_SCHEMA).options(**_CSV)
    return in_file_order(reader.csv(path, enforceSchema=False))


def blank(c: Column) -> Column:
    return c.isNull() | (F.trim(c) == "")


def type_events(raw: DataFrame) -> DataFrame:
    """Typed events with ``reasons``, the list of rules a row breaks (empty when it is good)."""
    text = {c: F.col(c).cast("string") for c in EVENT_FILE_COLUMNS}
    zoned = text["start_time"].rlike(_ZONED)
    instant = F.when(zoned, F.try_to_timestamp(text["start_time"]))
    number = F.expr("try_cast(value AS double)")
    metadata = F.when(blank(text["metadata"]), F.lit("{}")).otherwise(text["metadata"])
    # a type is one of the list as it stands; other case or spaces are another type
    kind = text["event_type"]
    rules = [
        (blank(text["patient_id"]), "empty_patient_id"),
        (blank(text["code"]), "empty_code"),
        (blank(text["start_time"]) | (~zoned), "time_without_zone"),
        (zoned & instant.isNull(), "bad_time"),
        (~F.coalesce(kind.isin(*EVENT_TYPES), F.lit(False)), "unknown_event_type"),
        (F.get_json_object(metadata, "$").isNull(), "bad_metadata"),
    ]
    reasons = F.array_compact(
        F.array(*[F.when(F.coalesce(c, F.lit(True)), F.lit(n)) for c, n in rules])
    )
    flag = F.lower(F.get_json_object(metadata, "$.measurement_opportunity"))
    return raw.select(
        text["patient_id"].alias("patient_id"),
        F.unix_micros(instant).alias("us"),
        F.col("seq"),
        text["code"].alias("code"),
        text["value"].alias("value_raw"),
        F.when(~F.isnan(number), number).alias("value"),
        F.when(~blank(text["unit"]), text["unit"]).alias("unit"),
        kind.alias("event_type"),
        text["source"].alias("source"),
        metadata.alias("metadata"),
        F.coalesce(flag == "true", F.lit(False)).alias("opportunity"),
        reasons.alias("reasons"),
    )


def accepted(typed: DataFrame) -> DataFrame:
    return typed.where(F.size("reasons") == 0).drop("reasons")


def quarantine(typed: DataFrame) -> DataFrame:
    return typed.where(F.size("reasons") > 0)


def canonical_json(metadata: Column) -> Column:
    """The object with its keys in order."""
    entries = F.map_entries(F.from_json(metadata, "map<string,string>"))
    return F.to_json(F.map_from_entries(F.array_sort(entries)))


def event_rows(events: DataFrame) -> DataFrame:
    """Typed events as the eight text columns of an event file."""
    wall = F.to_utc_timestamp(F.timestamp_micros("us"), F.current_timezone())
    iso = F.concat(F.date_format(wall, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z"))

    def column(name: str) -> Column:
        return F.col(name).cast("string") if name in events.columns else F.lit(None).cast("string")

    value = F.coalesce(column("value_raw"), column("value"))
    return events.select(
        column("patient_id").alias("patient_id"),
        iso.alias("start_time"),
        column("code").alias("code"),
        value.alias("value"),
        column("unit").alias("unit"),
        column("event_type").alias("event_type"),
        column("source").alias("source"),
        canonical_json(F.col("metadata")).alias("metadata"),
    )


def write_event_files(events: DataFrame, path: str) -> None:
    event_rows(events).write.options(**_CSV).csv(path)
