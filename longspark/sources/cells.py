"""Result files of experiment cells: nested JSON, per-cell CSV traces, file names."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspark.schema import METRIC_SCHEMA

CELL_SCHEMA = T.StructType(
    [
        T.StructField("schema_version", T.LongType()),
        T.StructField(
            "cell",
            T.StructType(
                [
                    T.StructField("cell_id", T.StringType()),
                    T.StructField("model", T.StringType()),
                    T.StructField("n_train", T.LongType()),
                    T.StructField("variant", T.StringType()),
                    T.StructField("flow_mode", T.StringType()),
                ]
            ),
        ),
        T.StructField(
            "metric_rows",
            T.ArrayType(
                T.StructType(
                    [
                        *METRIC_SCHEMA.fields,
                        T.StructField("stage", T.StringType()),
                        T.StructField("variant", T.StringType()),
                    ]
                )
            ),
        ),
    ]
)


def read_files(spark: SparkSession, path: str, pattern: str = "*.json") -> DataFrame:
    """``(path, content)`` of every file below ``path`` that matches the pattern."""
    raw = spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", pattern)
    return raw.text(path, wholetext=True).select(
        F.col("_metadata.file_path").alias("path"), F.col("value").alias("content")
    )


def parse_cells(files: DataFrame) -> DataFrame:
    """Files with their parsed JSON in ``doc``; a file that is not valid JSON gives nulls."""
    return files.withColumn("doc", F.from_json("content", CELL_SCHEMA, {"mode": "PERMISSIVE"}))


def cell_metrics(cells: DataFrame) -> DataFrame:
    """One row per metric row of every cell."""
    names = [f.name for f in CELL_SCHEMA["metric_rows"].dataType.elementType.fields]
    rows = cells.select(F.col("doc.cell.cell_id").alias("cell_id"), F.explode("doc.metric_rows").alias("m"))
    return rows.select("cell_id", *[F.col(f"m.{n}").alias(n) for n in names])


def file_stem(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+?)(\.[A-Za-z0-9]+)?$", 1)


def cell_of_path(path: Column) -> Column:
    """The cell a file belongs to: its stem, or the ``cell_id=`` folder it lies in."""
    return F.regexp_extract(path, r"(?:^|/)(?:cell_id=)?([^/=]+?__n\d+__[^/]+?)(?:\.[A-Za-z]+)?(?:/|$)", 1)


def parse_cell_name(name: Column) -> dict[str, Column]:
    """Identity columns of ``stage__world__cohortX__subsetY__modelZ__nN__variant``."""
    part = F.split(name, "__")

    def number(prefix: str) -> Column:
        return F.regexp_extract(name, rf"__{prefix}(\d+)(__|$)", 1).cast("bigint")

    return {
        "stage": part[0],
        "world": part[1],
        "cohort_seed": number("cohort"),
        "subset_seed": number("subset"),
        "model_seed": number("model"),
        "n_train": number("n"),
        "variant": F.regexp_extract(name, r"__n\d+__(.+)$", 1),
    }


def cell_index(files: DataFrame) -> DataFrame:
    """One row per file: digest, size, cell id and number of metric rows."""
    parsed = parse_cells(files)
    return parsed.select(
        "path",
        F.sha2(F.col("content").cast("binary"), 256).alias("sha256"),
        F.octet_length("content").cast("bigint").alias("bytes"),
        F.col("doc.cell.cell_id").alias("cell_id"),
        F.coalesce(F.size("doc.metric_rows"), F.lit(0)).cast("bigint").alias("n_metric_rows"),
    )


def write_index(index: DataFrame, path: str) -> None:
    index.write.json(path)


def read_cell_summaries(spark: SparkSession, path: str, plan: DataFrame, schema: T.StructType | str) -> DataFrame:
    """One JSON object per planned cell, prefixed with the cell's planned identity.

    Every planned cell has a row; ``summary_status`` is ``ok``, ``missing`` (no file), ``unreadable`` (no JSON object
    of the schema) or ``repeated`` (several files, a row each).
    """
    schema = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    corrupt = "_corrupt_record"
    parsed = F.from_json("content", T.StructType([*schema.fields, T.StructField(corrupt, T.StringType())]), {"columnNameOfCorruptRecord": corrupt})
    rows = read_files(spark, path).select(cell_of_path(F.col("path")).alias("cell_id"), parsed.alias("s"))
    copies = rows.groupBy("cell_id").agg(F.count(F.lit(1)).alias("_copies"))
    rows = plan.join(rows.withColumn("_found", F.lit(True)), "cell_id", "left").join(copies, "cell_id", "left")
    bad = F.col("s").isNull() | F.col(f"s.{corrupt}").isNotNull()
    status = (
        F.when(F.col("_found").isNull(), "missing")
        .when(bad, "unreadable")
        .when(F.col("_copies") > 1, "repeated")
        .otherwise("ok")
    )
    return rows.select(*plan.columns, *[F.col(f"s.{f.name}") for f in schema.fields], status.alias("summary_status"))


def read_cell_traces(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The CSV traces of a directory, with the identity columns of each file's name.

    A file whose header does not name the columns of the schema in their order is an error when it is read.
    """
    reader = spark.read.schema(schema).option("recursiveFileLookup", "true").option("enforceSchema", "false")
    rows = reader.csv(path, header=True)
    rows = rows.select("*", cell_of_path(F.col("_metadata.file_path")).alias("cell_id"))
    return rows.withColumns(parse_cell_name(F.col("cell_id")))


def load_archive(
    spark: SparkSession, effects: str, summaries: str, traces: str, *, plan: DataFrame,
    effect_schema: T.StructType, summary_schema: T.StructType, trace_schema: T.StructType,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Effects, run summaries and traces of one archive."""
    return (
        spark.read.schema(effect_schema).csv(effects, header=True),
        read_cell_summaries(spark, summaries, plan, summary_schema),
        read_cell_traces(spark, traces, trace_schema),
    )


def check_cell_identity(cells: DataFrame) -> DataFrame:
    """Per file: does the cell id inside equal its name, and do its metric rows agree with it?"""
    stem = file_stem(F.col("path"))
    inner = F.col("doc.cell")
    rows_agree = F.forall(
        F.coalesce(F.col("doc.metric_rows"), F.array().cast(CELL_SCHEMA["metric_rows"].dataType)),
        lambda r: (r["n_train"] == inner["n_train"]) & (r["model"] == inner["model"]),
    )
    readable = inner["cell_id"].isNotNull()
    return cells.select(
        "path",
        readable.alias("readable"),
        F.coalesce(inner["cell_id"] == stem, F.lit(False)).alias("name_matches"),
        (readable & F.coalesce(rows_agree, F.lit(False))).alias("rows_match"),
    )
