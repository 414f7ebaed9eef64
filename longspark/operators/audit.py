"""Content hashes, table diffs, file digests and reproduction verdicts."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from longspark.functions.text import normalize_text
from longspark.operators.checks import check_row, key_sets


def row_text(df: DataFrame, columns: list[str]) -> Column:
    """A row as text; null and NaN are the same, and differ from an empty string.

    Every value is preceded by its length, so no value can be taken for the border of two.
    """
    kinds = {f.name: f.dataType for f in df.schema}

    def part(c: str) -> Column:
        x = F.col(c)
        if isinstance(kinds[c], (T.DoubleType, T.FloatType)):
            x = F.when(~F.isnan(x), x)
        text = F.to_json(x) if isinstance(kinds[c], (T.ArrayType, T.MapType, T.StructType)) else x.cast("string")
        return F.coalesce(F.concat(F.lit("v"), F.length(text).cast("string"), F.lit(":"), text), F.lit("n"))

    return F.concat_ws("|", *[part(c) for c in columns])


def content_hash(df: DataFrame, columns: list[str], *, by: tuple[str, ...] = ()) -> DataFrame:
    """Row count and digest of a table's content, whatever its row order.

    Row digests are summed exactly where they are; repeated rows count.
    """
    digest = F.md5(row_text(df, columns).cast("binary"))
    halves = [F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)") for at in (1, 16)]
    out = df.select(*by, halves[0].alias("_a"), halves[1].alias("_b")).groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_rows"), F.sum("_a").alias("_a"), F.sum("_b").alias("_b")
    )
    seal = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("0")) for c in ("n_rows", "_a", "_b")])
    return out.select(*by, "n_rows", F.sha2(seal.cast("binary"), 256).alias("content_sha256"))


def lineage_hashes(inputs: dict[str, DataFrame]) -> DataFrame:
    """One row per input table: name, rows, digest; stored beside a decision and compared later."""
    parts = [
        content_hash(df, sorted(df.columns)).withColumn("input", F.lit(name)) for name, df in inputs.items()
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def compare_lineage(stored: DataFrame, current: DataFrame) -> DataFrame:
    left = stored.select("input", F.col("content_sha256").alias("stored"))
    right = current.select("input", F.col("content_sha256").alias("current"))
    return left.join(right, "input", "full").withColumn("ok", F.col("stored").eqNullSafe(F.col("current")))


def diff_structure(
    official: DataFrame, rerun: DataFrame, key: list[str], required: list[str], *, subject: str
) -> DataFrame:
    """Check rows: required columns, unique keys and equal key sets."""
    spark = official.sparkSession
    rows = []
    for label, df in (("official", official), ("rerun", rerun)):
        missing = [c for c in required if c not in df.columns]
        rows.append((f"required_columns_{label}", not missing, subject, ",".join(missing)))
    checks = spark.createDataFrame(rows, "code string, ok boolean, subject string, detail string")
    keys = key_sets(official, rerun, key)
    counts = keys.agg(
        F.count_if(F.col("left_rows") > 1).alias("d1"),
        F.count_if(F.col("right_rows") > 1).alias("d2"),
        F.count_if(F.col("right_rows") == 0).alias("missing"),
        F.count_if(F.col("left_rows") == 0).alias("unexpected"),
    )
    text = F.lit(subject)
    entries = F.array(
        F.struct(*check_row("unique_keys_official", F.col("d1") == 0, text, F.concat(F.lit("duplicates="), F.col("d1")))),
        F.struct(*check_row("unique_keys_rerun", F.col("d2") == 0, text, F.concat(F.lit("duplicates="), F.col("d2")))),
        F.struct(
            *check_row(
                "key_sets",
                (F.col("missing") == 0) & (F.col("unexpected") == 0),
                text,
                F.concat(F.lit("missing="), F.col("missing"), F.lit(" unexpected="), F.col("unexpected")),
            )
        ),
    )
    return checks.unionByName(counts.select(F.explode(entries).alias("c")).select("c.*"))


@dataclass(frozen=True)
class Tolerance:
    column: str
    atol: float = 0.0
    rtol: float = 0.0
    equal_nan: bool = True


def diff_numeric(official: DataFrame, rerun: DataFrame, key: list[str], fields: list[Tolerance]) -> DataFrame:
    """Per field: values further apart than ``atol + rtol * |rerun|``, and the largest gap of finite values.

    Keys that one side lacks and keys that a side repeats are counted, and with any of them no field is ok;
    values are compared for keys that stand once on both sides. A value that is no number is a mismatch, even
    against the same text. Null keys are keys like others.
    """

    def side(df: DataFrame, tag: str) -> DataFrame:
        values = []
        for f in fields:
            number = F.col(f"`{f.column}`").try_cast("double")
            values += [
                F.first(number).alias(f"_{tag}_{f.column}"),
                F.first(F.col(f"`{f.column}`").isNotNull() & number.isNull()).alias(f"_{tag}x_{f.column}"),
            ]
        return df.groupBy(*key).agg(F.count(F.lit(1)).alias(f"_{tag}"), *values)

    a, b = side(official, "a"), side(rerun, "b").withColumnsRenamed({k: f"_k_{k}" for k in key})
    same_key = F.lit(True)
    for k in key:
        same_key = same_key & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    both = a.join(b, same_key, "full")
    matched = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    once = matched & (F.col("_a") == 1) & (F.col("_b") == 1)
    aggs = [F.count_if(~matched).alias("_unmatched"), F.count_if((F.col("_a") > 1) | (F.col("_b") > 1)).alias("_repeated")]
    for f in fields:
        a, b = F.col(f"_a_{f.column}"), F.col(f"_b_{f.column}")
        bad = F.col(f"_ax_{f.column}") | F.col(f"_bx_{f.column}")
        none_a, none_b = a.isNull() | F.isnan(a), b.isNull() | F.isnan(b)
        finite = ~none_a & ~none_b & (F.abs(a) != float("inf")) & (F.abs(b) != float("inf"))
        close = finite & (F.abs(a - b) <= F.lit(f.atol) + F.lit(f.rtol) * F.abs(b))
        same = (
            F.when(bad, F.lit(False))
            .when(none_a & none_b, F.lit(f.equal_nan))
            .when(none_a | none_b, F.lit(False))
            .otherwise((a == b) | close)
        )
        aggs += [
            F.count_if(once & ~same).alias(f"_m_{f.column}"),
            F.max(F.when(once & finite, F.abs(a - b))).alias(f"_g_{f.column}"),
        ]
    out = both.agg(F.count_if(once).alias("compared"), *aggs)
    entries = F.array(
        *[
            F.struct(
                F.lit(f.column).alias("field"),
                F.col(f"_m_{f.column}").alias("mismatches"),
                F.col(f"_g_{f.column}").alias("max_abs_error"),
            )
            for f in fields
        ]
    )
    rows = out.select(
        "compared", F.col("_unmatched").alias("unmatched_keys"), F.col("_repeated").alias("repeated_keys"), F.explode(entries).alias("e")
    )
    ok = (F.col("e.mismatches") == 0) & (F.col("unmatched_keys") == 0) & (F.col("repeated_keys") == 0)
    return rows.select("e.field", "compared", "unmatched_keys", "repeated_keys", "e.mismatches", "e.max_abs_error", ok.alias("ok"))


def multiset_equal(left: DataFrame, right: DataFrame, columns: list[str]) -> DataFrame:
    """Surplus rows of each side, counting repeats; NaN equals null."""
    def tagged(df: DataFrame, side: str) -> DataFrame:
        other = "_r" if side == "_l" else "_l"
        return df.select(row_text(df, columns).alias("_row"), F.lit(1).alias(side), F.lit(0).alias(other))

    counts = tagged(left, "_l").unionByName(tagged(right, "_r")).groupBy("_row").agg(
        (F.sum("_l") - F.sum("_r")).alias("_d")
    )
    zero = F.lit(0).cast("bigint")
    return counts.agg(
        F.coalesce(F.sum(F.greatest("_d", zero)), zero).alias("left_surplus"),
        F.coalesce(F.sum(F.greatest(-F.col("_d"), zero)), zero).alias("right_surplus"),
    ).withColumn("equal", (F.col("left_surplus") == 0) & (F.col("right_surplus") == 0))


def file_digests(spark: SparkSession, path: str, *, pattern: str = "*") -> DataFrame:
    """``(relative, sha256, bytes)`` of the files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", pattern).load(path)
    return files.select(relative_path(F.col("path"), path).alias("relative"), F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))


def file_names(spark: SparkSession, path: str) -> DataFrame:
    """Listing only: the content column is not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select(relative_path(F.col("path"), path).alias("relative"), F.col("length").alias("bytes"))


def relative_path(path: Column, root: str) -> Column:
    return F.element_at(F.split(path, F.lit(root.rstrip("/") + "/"), 2), 2)


def diff_exact(official: DataFrame, rerun: DataFrame) -> DataFrame:
    """Files of both trees by relative path: same bytes, differing, or on one side only."""
    a = official.select("relative", F.col("sha256").alias("official"))
    b = rerun.select("relative", F.col("sha256").alias("rerun"))
    status = (
        F.when(F.col("rerun").isNull(), "missing")
        .when(F.col("official").isNull(), "unexpected")
        .when(F.col("official") == F.col("rerun"), "same")
        .otherwise("differs")
    )
    out = a.join(b, "relative", "full").withColumn("status", status)
    return out.withColumn("ok", F.col("status") == "same")


def diff_verdict(layers: DataFrame, by: list[str]) -> DataFrame:
    """Verdict per run from its layers (structural, exact, numerical, scientific)."""
    def ok(layer: str) -> Column:
        return F.coalesce(F.bool_and(F.when(F.col("layer") == layer, F.col("ok"))), F.lit(True))

    flags = layers.groupBy(*by).agg(
        *[ok(n).alias(n) for n in ("structural", "exact", "numerical", "scientific")]
    )
    # Verdict names.
    verdict = (
        F.when(~F.col("scientific"), "FAILED_REPRODUCTION")
        .when(F.col("structural") & F.col("exact") & F.col("numerical"), "EXACT")
        .when(F.col("structural") & F.col("numerical"), "NUMERICALLY_REPRODUCED")
        .otherwise("SCIENTIFICALLY_REPRODUCED")
    )
    return flags.withColumn("verdict", verdict)


def diff_decision(records: DataFrame, text: str, expected: str) -> DataFrame:
    """Does the record, normalised, contain the normalised expected decision?"""
    hit = F.contains(normalize_text(F.col(text)), normalize_text(F.col(expected)))
    return records.withColumn("ok", F.coalesce(hit, F.lit(False)))


def parse_manifest(lines: DataFrame) -> DataFrame:
    """Lines ``digest  path`` with a status for the malformed ones; blank lines are skipped."""
    line = F.trim("value")
    digest = F.regexp_extract(line, r"^(\S+)\s+(.+)$", 1)
    path = F.regexp_replace(F.trim(F.regexp_extract(line, r"^(\S+)\s+(.+)$", 2)), r"^\*", "")
    unsafe = (
        F.contains(path, F.lit("\\")) | path.rlike(r"^[A-Za-z]:") | F.startswith(path, F.lit("/"))
        | F.array_contains(F.split(path, "/"), "..")
    )
    status = (
        F.when(digest == "", "invalid_manifest_line")
        .when(~digest.rlike("^[0-9a-f]{64}$"), "invalid_sha")
        .when(unsafe, "unsafe_manifest_path")
    )
    return lines.where(line != "").select(
        "value", digest.alias("digest"), path.alias("relative"), status.alias("status")
    )


def checksum_audit(lines: DataFrame, digests: DataFrame, *, unavailable: list[str] = ()) -> DataFrame:
    """Every manifest line against the files: match, mismatch, missing or declared unavailable."""
    parsed = parse_manifest(lines)
    found = parsed.join(digests.select("relative", "sha256"), "relative", "left")
    excused = F.lit(False)
    for pattern in unavailable:
        excused = excused | F.col("relative").rlike(_glob(pattern))
    code = (
        F.when(F.col("status").isNotNull(), F.col("status"))
        .when(F.col("sha256").isNull() & excused, "manifest_target_unavailable")
        .when(F.col("sha256").isNull(), "missing_path")
        .when(F.col("sha256") == F.col("digest"), "sha256_match")
        .otherwise("sha256_mismatch")
    )
    ok = code.isin("sha256_match", "manifest_target_unavailable")
    subject = F.when(F.col("relative") == "", F.col("value")).otherwise(F.col("relative"))
    return found.select(code.alias("code"), ok.alias("ok"), subject.alias("subject"), F.col("sha256").alias("detail"))


def _glob(pattern: str) -> str:
    """A path pattern matched from the right, as a regular expression."""
    body = "".join("[^/]*" if c == "*" else "[^/]" if c == "?" else "\\" + c if not c.isalnum() and c not in "/_-" else c for c in pattern)
    return f"(^|/){body}$"


def path_audit(declared: DataFrame, names: DataFrame) -> DataFrame:
    """Declared files present or missing."""
    found = declared.join(names.select("relative", F.lit(True).alias("_there")), "relative", "left")
    there = F.coalesce(F.col("_there"), F.lit(False))
    return found.select(
        F.when(there, "path_present").otherwise("missing_path").alias("code"), there.alias("ok"), F.col("relative").alias("subject")
    )


def status_rollup(checks: DataFrame, by: list[str]) -> DataFrame:
    """All checks ok, and how many are not, per group."""
    return checks.groupBy(*by).agg(
        F.bool_and("ok").alias("ok"),
        F.count(F.lit(1)).alias("checks"),
        F.count_if(~F.col("ok")).alias("failed"),
    )
