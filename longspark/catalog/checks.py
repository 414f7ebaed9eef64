"""Queries over sources, data-quality checks and audits."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from longspark.catalog.fixtures import EV1, R, events, rounded, table
from longspark.catalog.decisions import _EFF, TRACE
from longspark.catalog.registry import query
from longspark.catalog.studies import MAE, STUDY, mae, study
from longspark.functions.text import normalize_text, parse_flag
from longspark.operators import audit, checks
from longspark.plans import grids
from longspark.schema import METRIC_KEY
from longspark.session import work_folder
from longspark.sources import cells, tables
from longspark.sources import events as event_source

# --- event files -----------------------------------------------------------

_ISO = "strftime(ts, '%Y-%m-%dT%H:%M:%S.%f')"
_RAW = (
    "raw AS (SELECT CASE WHEN event_id % 50 = 0 THEN '' ELSE CAST(user_id AS VARCHAR) END AS patient_id,"
    f" {_ISO} || CASE WHEN event_id % 40 = 1 THEN '' ELSE 'Z' END AS start_time, event_type AS code,"
    " CASE WHEN event_id % 30 = 2 THEN 'high' WHEN event_id % 30 = 3 THEN NULL ELSE CAST(event_id % 7 AS VARCHAR) END AS value,"
    " CASE WHEN event_id % 4 = 0 THEN ' ' ELSE 'mg' END AS unit,"
    " CASE event_id % 60 WHEN 3 THEN 'visit' WHEN 33 THEN ' Observation' ELSE 'observation' END AS event_type, 'app' AS source,"
    " CASE WHEN event_id % 5 = 0 THEN NULL ELSE props END AS metadata, event_id AS seq, epoch_us(ts) AS us FROM events)"
)


def raw_events(spark, sf):
    """Events as the text columns of a file, with broken rows mixed in."""
    i = F.col("event_id")
    e = table(spark, sf, "events")
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return e.select(
        F.when(i % 50 == 0, "").otherwise(F.col("user_id").cast("string")).alias("patient_id"),
        F.concat(iso, F.when(i % 40 == 1, "").otherwise("Z")).alias("start_time"),
        F.col("event_type").alias("code"),
        F.when(i % 30 == 2, "high").when(i % 30 == 3, F.lit(None)).otherwise((i % 7).cast("string")).alias("value"),
        F.when(i % 4 == 0, " ").otherwise("mg").alias("unit"),
        F.when(i % 60 == 3, "visit").when(i % 60 == 33, " Observation").otherwise("observation").alias("event_type"),
        F.lit("app").alias("source"),
        F.when(i % 5 != 0, F.col("props")).alias("metadata"),
        i.alias("seq"),
    )


_REASONS = (
    "array_to_string(list_filter([CASE WHEN patient_id = '' THEN 'empty_patient_id' END,"
    " CASE WHEN NOT start_time LIKE '%Z' THEN 'time_without_zone' END,"
    " CASE WHEN event_type <> 'observation' THEN 'unknown_event_type' END], lambda x: x IS NOT NULL), ',')"
)


@query(
    "read_events",
    f"WITH {_RAW} SELECT seq, patient_id, us, code, value, unit, event_type, metadata FROM (SELECT row_number() OVER (ORDER BY seq) - 1 AS seq,"
    " patient_id, us, code, TRY_CAST(value AS DOUBLE) AS value, CASE WHEN trim(unit) = '' THEN NULL ELSE unit END AS unit,"
    f" event_type, coalesce(metadata, '{{}}') AS metadata, {_REASONS} AS reasons FROM raw) WHERE reasons = ''",
)
def _(spark, sf):
    # files in the order of the events, as a delivery would have them
    path = f"{work_folder(spark)}/{uuid.uuid4().hex}"
    ordered = raw_events(spark, sf).repartitionByRange("seq").sortWithinPartitions("seq")
    ordered.drop("seq").write.options(header="true", quote='"', escape='"').csv(path)
    out = event_source.accepted(event_source.type_events(event_source.read_event_files(spark, path)))
    return out.select("seq", "patient_id", "us", "code", "value", "unit", "event_type", "metadata")


@query("check_events", f"WITH {_RAW} SELECT seq, {_REASONS} AS reasons FROM raw WHERE {_REASONS} <> ''")
def _(spark, sf):
    out = event_source.quarantine(event_source.type_events(raw_events(spark, sf)))
    return out.select("seq", F.array_join("reasons", ",").alias("reasons"))


@query(
    "write_events",
    f"WITH {EV1} SELECT patient_id, strftime(make_timestamp(us), '%Y-%m-%dT%H:%M:%S.%fZ') AS start_time, code,"
    " event_type, 'seq=' || seq AS source, '{\"k\":\"' || json_extract_string(metadata, '$.k') || '\"}' AS metadata FROM ev1",
)
def _(spark, sf):
    e = events(spark, sf).withColumn("source", F.concat(F.lit("seq="), F.col("seq")))
    return event_source.event_rows(e).drop("value", "unit")


@query(
    "schema_drift",
    "SELECT CAST(doc_id AS VARCHAR) AS path, array_to_string(list_sort(list_filter(['doc_id', 'lang', 'source', 'text'],"
    " lambda c: NOT list_contains(CASE WHEN doc_id % 3 = 0 THEN ['doc_id', 'text'] WHEN lang = 'en' THEN ['doc_id', 'lang', 'source', 'text'] ELSE ['text', 'lang', 'doc_id'] END, c))), ',') AS missing"
    " FROM documents WHERE doc_id % 3 = 0 OR lang <> 'en'",
)
def _(spark, sf):
    full_header = F.array(*map(F.lit, ("doc_id", "lang", "source", "text")))
    headers = table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("path"),
        F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("doc_id"), F.lit("text")))
        .when(F.col("lang") == "en", full_header)
        .otherwise(F.array(F.lit("text"), F.lit("lang"), F.lit(' "doc_id"')))
        .alias("columns"),
    )
    out = checks.schema_drift(headers, ["doc_id", "lang", "source", "text"])
    return out.select("path", F.array_join("missing", ",").alias("missing"))


# --- cells -----------------------------------------------------------------

_CELL_ID = (
    "concat_ws('__', 'flow', world, 'cohort' || cohort_seed, 'subset' || subset_seed, 'model' || model_seed, 'n' || n_train, model, ablation)"
)


def cell_id():
    return F.concat_ws(
        "__",
        F.lit("flow"),
        F.col("world"),
        F.concat(F.lit("cohort"), "cohort_seed"),
        F.concat(F.lit("subset"), "subset_seed"),
        F.concat(F.lit("model"), "model_seed"),
        F.concat(F.lit("n"), "n_train"),
        F.col("model"),
        F.col("ablation"),
    )


def cell_files(spark, sf):
    """One JSON document per cell, as it would lie in a file named after the cell."""
    rows = study(spark, sf).where("site_or_shift = 'all'").withColumn("cell_id", cell_id())
    row = F.struct(*[F.col(c) for c in METRIC_KEY], "value", "n_fit", "n_validation", "seed", "trainable_parameters", "backend")
    docs = rows.groupBy("cell_id", "model", "n_train", F.col("ablation").alias("variant")).agg(
        F.sort_array(F.collect_list(F.struct(F.col("metric").alias("_m"), row.alias("r")))).alias("rows")
    )
    doc = F.struct(
        F.lit(1).alias("schema_version"),
        F.struct("cell_id", "model", "n_train", "variant").alias("cell"),
        F.col("rows.r").alias("metric_rows"),
    )
    return docs.select(F.concat(F.lit("/cells/"), "cell_id", F.lit(".json")).alias("path"), F.to_json(doc).alias("content"))


@query(
    "read_cell_metrics",
    f"WITH {STUDY} SELECT {_CELL_ID} AS cell_id, metric, n_train, n_fit, seed, {R('value')} AS value, trainable_parameters FROM study WHERE site_or_shift = 'all'",
)
def _(spark, sf):
    out = cells.cell_metrics(cells.parse_cells(cell_files(spark, sf)))
    return rounded(out.select("cell_id", "metric", "n_train", "n_fit", "seed", "value", "trainable_parameters"), "value")


@query(
    "parse_cell_name",
    f"WITH {STUDY} SELECT DISTINCT {_CELL_ID} AS cell_id, 'flow' AS stage, world, cohort_seed, subset_seed, model_seed, n_train,"
    " concat_ws('__', model, ablation) AS variant FROM study WHERE site_or_shift = 'all'",
)
def _(spark, sf):
    stem = cells.file_stem(F.col("path"))
    names = cell_files(spark, sf).select(stem.alias("cell_id"))
    return names.withColumns(cells.parse_cell_name(F.col("cell_id")))


@query(
    "cell_index",
    f"WITH {STUDY} SELECT '/cells/' || {_CELL_ID} || '.json' AS path, {_CELL_ID} AS cell_id, count(*) AS n_metric_rows FROM study WHERE site_or_shift = 'all' GROUP BY 1, 2",
)
def _(spark, sf):
    out = cells.cell_index(cell_files(spark, sf))
    return out.where((F.length("sha256") == 64) & (F.col("bytes") > 0)).select("path", "cell_id", "n_metric_rows")


@query(
    "cell_sha256",
    "SELECT '/p/' || page_id AS path, sha256(html) AS sha256, CAST(octet_length(encode(html)) AS BIGINT) AS bytes FROM pages",
)
def _(spark, sf):
    files = table(spark, sf, "pages").select(F.concat(F.lit("/p/"), "page_id").alias("path"), F.col("html").alias("content"))
    return cells.cell_index(files).select("path", "sha256", "bytes")


@query(
    "check_cell_identity",
    f"WITH {STUDY} SELECT DISTINCT {_CELL_ID} AS cell_id, true AS readable, world <> 'R' AS name_matches, true AS rows_match FROM study WHERE site_or_shift = 'all'",
)
def _(spark, sf):
    files = cell_files(spark, sf)
    # the files of one world were renamed
    renamed = F.when(F.contains("path", F.lit("__R__")), F.concat(F.col("path"), F.lit(".bak.json"))).otherwise(F.col("path"))
    out = cells.check_cell_identity(cells.parse_cells(files.withColumn("path", renamed)))
    stem = F.replace(F.replace(cells.file_stem(F.col("path")), F.lit(".bak"), F.lit("")), F.lit(".json"), F.lit(""))
    return out.select(stem.alias("cell_id"), "readable", "name_matches", "rows_match")


@query(
    "collect_metrics",
    f"WITH {MAE}, c AS (SELECT *, {_CELL_ID} AS cell_id FROM mae) SELECT 'kept' AS finding, count(*) AS n FROM c WHERE world <> 'N'"
    " UNION ALL SELECT 'unplanned', count(DISTINCT cell_id) FROM c WHERE world = 'N'"
    " UNION ALL SELECT 'duplicate', count(*) FROM c WHERE world = 'A' AND n_train = 5",
)
def _(spark, sf):
    rows = mae(spark, sf).withColumn("cell_id", cell_id())
    repeated = rows.unionByName(rows.where("world = 'A' AND n_train = 5"))
    plan = rows.where("world <> 'N'").select("cell_id").distinct()
    kept, findings = tables.collect_metrics(repeated, plan)
    kept = kept.dropDuplicates(["cell_id", "metric"]).agg(F.count(F.lit(1)).alias("n")).select(F.lit("kept").alias("finding"), "n")
    return kept.unionByName(findings.groupBy("finding").agg(F.count(F.lit(1)).alias("n")))


@query(
    "union_metrics",
    f"WITH {MAE} SELECT world, n_train, model, cohort_seed, {R('value')} AS value, CAST(NULL AS VARCHAR) AS stage FROM mae WHERE world = 'A'"
    f" UNION ALL SELECT world, n_train, model, cohort_seed, {R('value')}, 'flow' FROM mae WHERE world <> 'A'",
)
def _(spark, sf):
    rows = mae(spark, sf).select("world", "n_train", "model", "cohort_seed", "value")
    parts = [rows.where("world = 'A'"), rows.where("world <> 'A'").withColumn("stage", F.lit("flow"))]
    return rounded(tables.union_metrics(parts, ["world", "n_train", "model", "cohort_seed"]), "value")


def _folder(spark):
    return f"{work_folder(spark)}/{uuid.uuid4().hex}"


@query("publish_tables", f"WITH {MAE} SELECT world, model, count(*) AS n FROM mae GROUP BY 1, 2")
def _(spark, sf):
    root = _folder(spark)
    summary = mae(spark, sf).groupBy("world", "model").agg(F.count(F.lit(1)).alias("n"))
    tables.publish_tables({"summary": summary}, root, "1")
    return tables.read_published(spark, root, "summary")


@query("write_once", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    path = _folder(spark)
    counts = table(spark, sf, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"))
    tables.write_once(counts, path)
    tables.write_once(counts, path)
    return spark.read.parquet(path)


@query("write_tables", "SELECT o_orderkey, o_custkey, o_orderstatus FROM orders")
def _(spark, sf):
    path = _folder(spark)
    tables.write_tables(table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderstatus"), path, ["o_custkey", "o_orderkey"])
    return spark.read.parquet(path)


def _run_cells(spark, sf):
    """Run summaries and traces of the crossed design, with a cell id per run."""
    from longspark.catalog import decisions

    name = F.concat(
        F.lit("d4b__smooth__cohort"), "context", F.lit("__subset"), "context", F.lit("__model"), "model_seed",
        F.lit("__n40__"), "variant",
    ).alias("cell_id")
    s = decisions.summaries(spark, sf).select(name, "selected_checkpoint_epoch", "stop_epoch", "early_stop_reason")
    t = decisions.trace(spark, sf).select(name, "epoch", "core_loss", "validation_mae")
    return s, t


_RUN_ID = "'d4b__smooth__cohort' || context || '__subset' || context || '__model' || model_seed || '__n40__' || variant"
SUMMARY_SCHEMA = "selected_checkpoint_epoch BIGINT, stop_epoch BIGINT, early_stop_reason STRING"
TRACE_SCHEMA = "epoch BIGINT, core_loss DOUBLE, validation_mae DOUBLE"


def _write_runs(spark, sf):
    """The same as files: one folder of JSON and one of CSV per cell."""
    root = _folder(spark)
    s, t = _run_cells(spark, sf)
    s.write.partitionBy("cell_id").json(f"{root}/summaries")
    t.repartition("cell_id").write.partitionBy("cell_id").csv(f"{root}/traces", header=True)
    return root, s.select("cell_id")


@query(
    "read_cell_summaries",
    f"WITH {TRACE} SELECT {_RUN_ID} AS cell_id, selected_checkpoint_epoch, stop_epoch, early_stop_reason, 'ok' AS summary_status FROM sm"
    f" UNION ALL SELECT 'gone__' || {_RUN_ID}, NULL, NULL, NULL, 'missing' FROM sm",
)
def _(spark, sf):
    root, plan = _write_runs(spark, sf)
    # a planned cell without a file for each that has one
    plan = plan.union(plan.select(F.concat(F.lit("gone__"), "cell_id")))
    return cells.read_cell_summaries(spark, f"{root}/summaries", plan, SUMMARY_SCHEMA)


@query(
    "read_cell_traces",
    f"WITH {TRACE} SELECT {_RUN_ID} AS cell_id, 'd4b' AS stage, 'smooth' AS world, context AS cohort_seed, context AS subset_seed, model_seed,"
    f" CAST(40 AS BIGINT) AS n_train, variant, epoch, {R('core_loss')} AS core_loss, {R('validation_mae')} AS validation_mae FROM tr",
)
def _(spark, sf):
    root, _ = _write_runs(spark, sf)
    return rounded(cells.read_cell_traces(spark, f"{root}/traces", TRACE_SCHEMA), "core_loss", "validation_mae")


@query(
    "load_archive",
    f"WITH {_EFF}, e AS (SELECT count(*) AS n FROM ef) SELECT 'effects' AS part, n FROM e UNION ALL SELECT 'summaries', count(*) FROM sm"
    " UNION ALL SELECT 'traces', count(*) FROM tr",
)
def _(spark, sf):
    from longspark.catalog import decisions

    root, plan = _write_runs(spark, sf)
    decisions.stability(spark, sf).select("context", "model_seed", "delta_mae").write.csv(f"{root}/effects", header=True)
    parts = cells.load_archive(
        spark, f"{root}/effects", f"{root}/summaries", f"{root}/traces", plan=plan,
        effect_schema="context BIGINT, model_seed BIGINT, delta_mae DOUBLE",
        summary_schema=SUMMARY_SCHEMA, trace_schema=TRACE_SCHEMA,
    )
    out = None
    for name, df in zip(("effects", "summaries", "traces"), parts):
        row = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = row if out is None else out.unionByName(row)
    return out


# --- checks ----------------------------------------------------------------


@query("check_unique", "SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 1")
def _(spark, sf):
    return checks.check_unique(table(spark, sf, "events"), ["user_id", "event_type"])


_NUM = "SELECT o_orderstatus, CASE WHEN o_orderkey % 11 = 0 THEN 'NaN' WHEN o_orderkey % 13 = 0 THEN 'inf' WHEN o_orderkey % 17 = 0 THEN '-1.5' WHEN o_orderkey % 19 = 0 THEN '0' ELSE CAST(o_custkey AS VARCHAR) END AS x FROM orders"


@query(
    "check_finite",
    f"WITH r AS ({_NUM}), n AS (SELECT o_orderstatus, x IN ('NaN', 'inf') AS bad, CASE WHEN x NOT IN ('NaN', 'inf') THEN CAST(x AS DOUBLE) END AS v FROM r)"
    " SELECT o_orderstatus, 'x' AS \"column\", count(*) AS rows, count(*) FILTER (WHERE bad) AS not_finite, count(*) FILTER (WHERE v < 0) AS negative,"
    " count(*) FILTER (WHERE v <= 0) AS not_positive, count(*) FILTER (WHERE v % 1 <> 0) AS not_integer FROM n GROUP BY 1",
)
def _(spark, sf):
    k = F.col("o_orderkey")
    x = (
        F.when(k % 11 == 0, "NaN").when(k % 13 == 0, "Infinity").when(k % 17 == 0, "-1.5").when(k % 19 == 0, "0")
        .otherwise(F.col("o_custkey").cast("string"))
    )
    rows = table(spark, sf, "orders").select("o_orderstatus", x.alias("x"))
    return checks.check_finite(rows, ["x"], by=("o_orderstatus",), non_negative=True, integer=True, positive=True)


@query(
    "check_domain",
    "SELECT event_type AS value, 'unexpected' AS finding, count(*) AS n FROM events WHERE event_type NOT IN ('click', 'view', 'refund') GROUP BY 1"
    " UNION ALL SELECT 'refund', 'absent', 0",
)
def _(spark, sf):
    return checks.check_domain(table(spark, sf, "events"), "event_type", ["click", "view", "refund"], exact=True)


@query(
    "check_plan",
    "WITH p AS (SELECT DISTINCT l_returnflag AS world, l_suppkey % 10 AS b, l_partkey % 25 AS m FROM lineitem WHERE l_quantity < 40),"
    " o AS (SELECT l_returnflag AS world, l_suppkey % 10 AS b, l_partkey % 25 AS m, count(*) AS c FROM lineitem WHERE l_quantity > 48 GROUP BY 1, 2, 3)"
    " SELECT coalesce(p.world, o.world) AS world, count(*) FILTER (WHERE p.b IS NOT NULL AND o.b IS NOT NULL) AS matched,"
    " count(*) FILTER (WHERE o.b IS NULL) AS missing, count(*) FILTER (WHERE p.b IS NULL) AS unexpected,"
    " count(*) FILTER (WHERE p.b IS NOT NULL AND c > 1) AS repeated FROM p FULL JOIN o ON o.world = p.world AND o.b = p.b AND o.m = p.m GROUP BY 1",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select(
        F.col("l_returnflag").alias("world"), (F.col("l_suppkey") % 10).alias("b"), (F.col("l_partkey") % 25).alias("m"), "l_quantity"
    )
    key = ["world", "b", "m"]
    plan = rows.where("l_quantity < 40").select(*key).distinct()
    return checks.check_plan(plan, rows.where("l_quantity > 48"), key, by=("world",))


@query(
    "check_group_size",
    "SELECT l_orderkey, count(*) AS rows, count(DISTINCT l_linenumber) AS members FROM lineitem GROUP BY 1 HAVING count(*) <> 4 OR count(DISTINCT l_linenumber) <> 4",
)
def _(spark, sf):
    return checks.check_group_size(table(spark, sf, "lineitem"), ["l_orderkey"], ["l_linenumber"], 4)


@query(
    "check_constant",
    f"WITH {STUDY} SELECT model, ablation, min(trainable_parameters) AS smallest, max(trainable_parameters) AS largest, true AS constant FROM study GROUP BY 1, 2",
)
def _(spark, sf):
    return checks.check_constant(study(spark, sf), ["model", "ablation"], "trainable_parameters")


@query(
    "check_reserved_keys",
    "SELECT l_orderkey, l_linenumber, l_partkey, array_to_string(list_filter([CASE WHEN l_suppkey IN (3, 7) THEN 'l_suppkey' END,"
    " CASE WHEN l_linenumber IN (6) THEN 'l_linenumber' END], lambda x: x IS NOT NULL), ',') AS hit FROM lineitem WHERE l_suppkey IN (3, 7) OR l_linenumber IN (6)",
)
def _(spark, sf):
    out = checks.check_reserved_keys(table(spark, sf, "lineitem"), {"l_suppkey": [3, 7], "l_linenumber": [6]})
    return out.select("l_orderkey", "l_linenumber", "l_partkey", F.array_join("reserved_columns", ",").alias("hit"))


@query(
    "check_metric_row",
    f"WITH {STUDY}, b AS (SELECT *, array_to_string(list_filter([CASE WHEN world = 'A' AND metric = 'nll' THEN 'empty_model' END,"
    " CASE WHEN world = 'N' AND n_train = 40 THEN 'not_integer_n_fit' END, CASE WHEN metric = 'rmse' THEN 'not_finite_value' END,"
    " CASE WHEN world = 'R' AND cohort_seed = 403 THEN 'seed_differs' END], lambda x: x IS NOT NULL), ',') AS reasons FROM study)"
    " SELECT reasons, count(*) AS n FROM b GROUP BY 1",
)
def _(spark, sf):
    rows = study(spark, sf).select(*[F.col(c).cast("string").alias(c) for c in study(spark, sf).columns])
    broken = rows.withColumns(
        {
            "model": F.when((F.col("world") == "A") & (F.col("metric") == "nll"), "").otherwise(F.col("model")),
            "n_fit": F.when((F.col("world") == "N") & (F.col("n_train") == "40"), "32.5").otherwise(F.col("n_fit")),
            "value": F.when(F.col("metric") == "rmse", "NaN").otherwise(F.col("value")),
            "seed": F.when((F.col("world") == "R") & (F.col("cohort_seed") == "403"), "1").otherwise(F.col("seed")),
        }
    )
    out = checks.check_metric_row(broken)
    return out.groupBy(F.array_join("reasons", ",").alias("reasons")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "parse_flag",
    "WITH f AS (SELECT l_suppkey, CASE l_linenumber WHEN 1 THEN ' TRUE' WHEN 2 THEN '0' WHEN 3 THEN 'False ' WHEN 4 THEN '1' ELSE 'maybe' END AS t, l_quantity FROM lineitem),"
    " g AS (SELECT l_suppkey, CASE WHEN lower(trim(t)) IN ('true', '1') THEN l_quantity > 49 WHEN lower(trim(t)) IN ('false', '0') THEN false END AS f FROM f)"
    " SELECT l_suppkey, coalesce(bool_or(f), false) AS any_passed, count(*) FILTER (WHERE f) AS passed, count(*) FILTER (WHERE f) = 1 AS exactly_one,"
    " count(*) FILTER (WHERE f IS NULL) AS unreadable FROM g GROUP BY 1",
)
def _(spark, sf):
    n = F.col("l_linenumber")
    text = F.when(n == 1, " TRUE").when(n == 2, "0").when(n == 3, "False ").when(n == 4, "1").otherwise("maybe")
    rows = table(spark, sf, "lineitem").withColumn("t", text)
    flag = parse_flag(F.col("t"))
    return checks.flag_summary(rows, ["l_suppkey"], F.when(flag, F.col("l_quantity") > 49).otherwise(flag))


@query(
    "normalize_text",
    "SELECT conv_id, turn, trim(regexp_replace(lower(replace(translate(text, '—–−', '---'), '→', '->')), '\\s+', ' ', 'g')) AS text FROM conversations",
)
def _(spark, sf):
    return table(spark, sf, "conversations").select("conv_id", "turn", normalize_text(F.col("text")).alias("text"))


# --- audits ----------------------------------------------------------------

_HALVES = ", ".join(
    f"sum(CAST('0x' || substr(md5(t), {at}, 15) AS HUGEINT)) AS s{at}" for at in (1, 16)
)


def _hash_sql(text: str, source: str, by: str = "") -> str:
    group = f" GROUP BY {by}" if by else ""
    keys = f"{by}, " if by else ""
    return (
        f"SELECT {keys}count(*) AS n_rows, {_HALVES} FROM (SELECT {keys}{text} AS t FROM {source}){group}"
    )


def _row_text_sql(*columns: str) -> str:
    return "concat_ws('|', " + ", ".join(f"'v' || length({c}::VARCHAR) || ':' || {c}" for c in columns) + ")"


_ORDER_TEXT = _row_text_sql("o_orderkey", "o_custkey", "o_orderpriority")


@query(
    "content_hash",
    f"SELECT o_orderstatus, n_rows, sha256(concat_ws('|', n_rows, s1, s16)) AS content_sha256 FROM ({_hash_sql(_ORDER_TEXT, 'orders', 'o_orderstatus')})",
)
def _(spark, sf):
    return audit.content_hash(
        table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_orderpriority"], by=("o_orderstatus",)
    )


@query(
    "lineage_hashes",
    f"WITH a AS ({_hash_sql(_row_text_sql('o_custkey', 'o_orderkey', 'o_orderpriority'), 'orders')}),"
    f" b AS ({_hash_sql(_row_text_sql('n_name', 'n_nationkey', 'n_regionkey'), 'nation')})"
    " SELECT 'nation' AS input, true AS ok, sha256(concat_ws('|', n_rows, s1, s16)) AS current FROM b"
    " UNION ALL SELECT 'orders', false, sha256(concat_ws('|', n_rows, s1, s16)) FROM a",
)
def _(spark, sf):
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_orderpriority")
    nation = table(spark, sf, "nation").select("n_name", "n_nationkey", "n_regionkey")
    stored = audit.lineage_hashes({"orders": orders.where("o_custkey > 5"), "nation": nation})
    now = audit.lineage_hashes({"orders": orders, "nation": nation})
    return audit.compare_lineage(stored, now).select("input", "ok", "current")


def _reruns(spark, sf):
    """The order table and a rerun: some prices moved, some orders gone."""
    official = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    moved = F.when(F.col("o_orderkey") % 97 == 0, F.col("o_totalprice") + 0.5).otherwise(F.col("o_totalprice"))
    return official, official.where("o_orderkey % 101 <> 0").withColumn("o_totalprice", moved)


@query(
    "diff_structure",
    "WITH m AS (SELECT count(*) AS n FROM orders WHERE o_orderkey % 101 = 0) SELECT 'key_sets' AS code, n = 0 AS ok, 'orders' AS subject, 'missing=' || n || ' unexpected=0' AS detail FROM m"
    " UNION ALL SELECT unnest(['unique_keys_official', 'unique_keys_rerun']), true, 'orders', 'duplicates=0'"
    " UNION ALL SELECT 'required_columns_official', true, 'orders', '' UNION ALL SELECT 'required_columns_rerun', true, 'orders', ''",
)
def _(spark, sf):
    official, rerun = _reruns(spark, sf)
    return audit.diff_structure(official, rerun, ["o_orderkey"], ["o_orderkey", "o_totalprice"], subject="orders")


#: A rerun lacks some orders, repeats some, moves some prices; a few customers are text that is no number.
_DIFF = (
    "j AS (SELECT o_orderkey % 101 <> 0 AS matched, o_orderkey % 101 <> 0 AND o_orderkey % 103 <> 0 AS once, o_orderkey % 101 <> 0 AND o_orderkey % 103 = 0 AS twice,"
    " o_orderkey % 89 = 0 AS text, o_totalprice AS a, CASE WHEN o_orderkey % 97 = 0 THEN o_totalprice + 0.5 ELSE o_totalprice END AS b FROM orders)"
)
_COUNTS = "count(*) FILTER (WHERE once) AS compared, count(*) FILTER (WHERE NOT matched) AS unmatched_keys, count(*) FILTER (WHERE twice) AS repeated_keys"


@query(
    "diff_numeric",
    f"WITH {_DIFF} SELECT 'o_totalprice' AS field, {_COUNTS},"
    f" count(*) FILTER (WHERE once AND abs(a - b) > 0.01 + 1e-6 * abs(b)) AS mismatches, {R('max(abs(a - b)) FILTER (WHERE once)')} AS max_abs_error, false AS ok FROM j"
    f" UNION ALL SELECT 'customer', {_COUNTS}, count(*) FILTER (WHERE once AND text), 0.0::DOUBLE, false FROM j",
)
def diff_numeric_query(spark, sf):
    official, rerun = _reruns(spark, sf)
    customer = F.when(F.col("o_orderkey") % 89 == 0, "none").otherwise(F.col("o_custkey").cast("string"))
    official, rerun = (df.withColumn("customer", customer) for df in (official, rerun))
    rerun = rerun.unionByName(rerun.where("o_orderkey % 103 = 0"))
    fields = [audit.Tolerance("o_totalprice", atol=0.01, rtol=1e-6), audit.Tolerance("customer")]
    return rounded(audit.diff_numeric(official, rerun, ["o_orderkey"], fields), "max_abs_error")


@query(
    "diff_exact",
    "WITH f AS (SELECT 'p/' || page_id AS relative, sha256(html) AS a, CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 7 = 0 THEN sha256(html || ' ') ELSE sha256(html) END AS b FROM pages)"
    " SELECT relative, a AS official, b AS rerun, CASE WHEN b IS NULL THEN 'missing' WHEN a = b THEN 'same' ELSE 'differs' END AS status, b IS NOT NULL AND a = b AS ok FROM f",
)
def _(spark, sf):
    name = F.concat(F.lit("p/"), F.col("page_id")).alias("relative")
    pages = table(spark, sf, "pages")
    official = pages.select(name, F.sha2(F.col("html").cast("binary"), 256).alias("sha256"))
    changed = F.when(F.col("page_id") % 7 == 0, F.concat("html", F.lit(" "))).otherwise(F.col("html"))
    rerun = pages.where("page_id % 9 <> 0").select(name, F.sha2(changed.cast("binary"), 256).alias("sha256"))
    return audit.diff_exact(official, rerun)


@query(
    "diff_verdict",
    "WITH l AS (SELECT o_custkey, bool_and(o_orderkey % 3 <> 0) AS structural, bool_and(o_orderkey % 5 <> 0) AS exact,"
    " bool_and(o_orderkey % 7 <> 0) AS numerical, bool_and(o_orderkey % 11 <> 0) AS scientific FROM orders GROUP BY 1)"
    " SELECT *, CASE WHEN NOT scientific THEN 'FAILED_REPRODUCTION' WHEN structural AND exact AND numerical THEN 'EXACT'"
    " WHEN structural AND numerical THEN 'NUMERICALLY_REPRODUCED' ELSE 'SCIENTIFICALLY_REPRODUCED' END AS verdict FROM l",
)
def _(spark, sf):
    layer = [("structural", 3), ("exact", 5), ("numerical", 7), ("scientific", 11)]
    entries = F.array(*[F.struct(F.lit(n).alias("layer"), (F.col("o_orderkey") % m != 0).alias("ok")) for n, m in layer])
    rows = table(spark, sf, "orders").select("o_custkey", F.explode(entries).alias("e")).select("o_custkey", "e.*")
    return audit.diff_verdict(rows, ["o_custkey"])


@query(
    "diff_decision",
    "SELECT doc_id, contains(trim(regexp_replace(lower(text), '\\s+', ' ', 'g')), trim(regexp_replace(lower(' ' || lang || ' '), '\\s+', ' ', 'g'))) AS ok FROM documents",
)
def _(spark, sf):
    rows = table(spark, sf, "documents").withColumn("expected", F.concat(F.lit(" "), F.col("lang"), F.lit(" ")))
    return audit.diff_decision(rows, "text", "expected").select("doc_id", "ok")


@query(
    "multiset_equal",
    "WITH a AS (SELECT l_suppkey, l_returnflag FROM lineitem), b AS (SELECT l_suppkey, CASE WHEN l_quantity > 45 THEN 'Z' ELSE l_returnflag END AS l_returnflag FROM lineitem WHERE l_linenumber < 7)"
    " SELECT (SELECT count(*) FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b)) AS left_surplus,"
    " (SELECT count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) AS right_surplus, false AS equal",
)
def _(spark, sf):
    rows = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", "l_linenumber")
    changed = F.when(F.col("l_quantity") > 45, "Z").otherwise(F.col("l_returnflag"))
    other = rows.where("l_linenumber < 7").withColumn("l_returnflag", changed)
    return audit.multiset_equal(rows, other, ["l_suppkey", "l_returnflag"])


_PATH = "CASE page_id % 6 WHEN 0 THEN '../p/' WHEN 1 THEN 'gone/' ELSE 'p/' END || page_id || '.html'"
_LINE_CODE = (
    "CASE WHEN page_id % 6 = 0 THEN 'unsafe_manifest_path' WHEN page_id % 6 = 1 THEN 'missing_path' WHEN page_id % 6 = 2 THEN 'sha256_mismatch' ELSE 'sha256_match' END"
)


@query(
    "checksum_audit",
    f"SELECT {_PATH} AS subject, {_LINE_CODE} AS code, page_id % 6 > 2 AS ok FROM pages",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    digest = F.sha2(F.col("html").cast("binary"), 256)
    name = F.expr(_PATH)
    wrong = F.when(F.col("page_id") % 6 == 2, F.sha2(F.lit("x").cast("binary"), 256)).otherwise(digest)
    lines = pages.select(F.concat(wrong, F.lit("  *"), name).alias("value"))
    files = pages.select(F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("relative"), digest.alias("sha256"))
    return audit.checksum_audit(lines, files).select("subject", "code", "ok")


@query(
    "path_audit",
    f"SELECT {_PATH} AS subject, CASE WHEN page_id % 6 > 1 THEN 'path_present' ELSE 'missing_path' END AS code, page_id % 6 > 1 AS ok FROM pages",
)
def _(spark, sf):
    pages = table(spark, sf, "pages")
    names = pages.select(F.concat(F.lit("p/"), "page_id", F.lit(".html")).alias("relative"))
    return audit.path_audit(pages.select(F.expr(_PATH).alias("relative")), names)


@query(
    "status_rollup",
    "SELECT o_orderpriority AS layer, bool_and(o_orderstatus <> 'P') AS ok, count(*) AS checks, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed FROM orders GROUP BY 1",
)
def _(spark, sf):
    rows = table(spark, sf, "orders").select(
        F.col("o_orderpriority").alias("layer"), (F.col("o_orderstatus") != "P").alias("ok")
    )
    return audit.status_rollup(rows, ["layer"])
