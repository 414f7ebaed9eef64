import hashlib
import json

import pytest
from pyspark.sql import functions as F

from longspark.operators import audit, checks
from longspark.sources import cells, events, tables

HEADER = "patient_id,start_time,code,value,unit,event_type,source,metadata\n"


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return path


def test_event_files_are_typed_and_bad_rows_are_kept_apart(spark, tmp_path):
    write(
        tmp_path / "in" / "e.csv",
        HEADER
        + 'p1,2024-01-02T03:04:05+02:00,a,1.5,mg,observation,x,"{""site_id"": 3, ""measurement_opportunity"": true}"\n'
        + "p1,2024-01-02T03:04:05Z,a,high,,observation,x,\n"
        + "p3,2024-01-02T03:04:05Z,a,1,,Observation,x,\n"
        + "p4,2024-01-02T03:04:05Z,a,1,, observation,x,\n"
        + "p2,2024-01-02T03:04:05,a,1,,observation,x,\n"
        + ",2024-01-02T03:04:05Z,,1,,visit,x,{bad\n",
    )
    typed = events.type_events(events.read_event_files(spark, str(tmp_path / "in")))
    good = events.accepted(typed).orderBy("us").collect()
    assert [(r.us, r.value, r.value_raw, r.unit, r.opportunity) for r in good] == [
        (1704157445000000, 1.5, "1.5", "mg", True),
        (1704164645000000, None, "high", None, False),
    ]
    bad = {r.patient_id: r.reasons for r in events.quarantine(typed).collect()}
    assert bad["p2"] == ["time_without_zone"]
    # another case or a space is not a known type
    assert bad["p3"] == bad["p4"] == ["unknown_event_type"]
    assert bad[None] == ["empty_patient_id", "empty_code", "unknown_event_type", "bad_metadata"]


@pytest.mark.parametrize("size", ["2000", "100000", "1g"])
def test_rows_are_numbered_in_file_order_under_any_split(spark, tmp_path, size):
    for k, n in (("b", 300), ("a", 200), ("d", 0), ("c", 1)):
        lines = "".join(f"p{k}{i},2024-01-02T03:04:05Z,{'x' * (i % 40)}c,1,,observation,s,\n" for i in range(n))
        write(tmp_path / "in" / f"{k}.csv", HEADER + lines)
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    before = {n: spark.conf.get(n) for n in names}
    try:
        spark.conf.set(names[0], size)
        spark.conf.set(names[1], "100")
        out = {r.seq: r.patient_id for r in events.read_event_files(spark, str(tmp_path / "in")).collect()}
    finally:
        for n, v in before.items():
            spark.conf.set(n, v)
    want = [f"pa{i}" for i in range(200)] + [f"pb{i}" for i in range(300)] + ["pc0"]
    assert out == dict(enumerate(want))


def test_no_event_files_rows(spark, tmp_path):
    write(tmp_path / "in" / "e.csv", HEADER)
    assert events.read_event_files(spark, str(tmp_path / "in")).count() == 0


def test_event_files_round_trip(spark, tmp_path):
    write(
        tmp_path / "in" / "e.csv",
        HEADER + 'p1,2024-01-02T03:04:05.000001Z,a,1.5,mg,observation,x,"{""b"":""2"",""a"":""1""}"\np1,2024-01-03T00:00:00Z,b,,,encounter,y,\n',
    )
    one = events.accepted(events.type_events(events.read_event_files(spark, str(tmp_path / "in"))))
    events.write_event_files(one, str(tmp_path / "out"))
    two = events.accepted(events.type_events(events.read_event_files(spark, str(tmp_path / "out"))))
    columns = ["patient_id", "us", "code", "value", "unit", "event_type", "source"]
    assert one.select(columns).exceptAll(two.select(columns)).count() == 0
    assert two.where("code = 'a'").first().metadata == '{"a":"1","b":"2"}'


def test_headers_of_a_delivery_are_compared(spark, tmp_path):
    write(tmp_path / "a.csv", HEADER + "x,,,,,,,\n")
    write(tmp_path / "b.csv", "patient_id,code\nx,y\n")
    out = checks.schema_drift(checks.header_columns(spark, str(tmp_path)), ["patient_id", "start_time", "code"])
    assert [(r.path.split("/")[-1], r.missing) for r in out.collect()] == [("b.csv", ["start_time"])]


def cell(cell_id, rows=1, **changes):
    row = {"metric": "mae", "value": 0.5, "n_train": 5, "model": "m", "world": "w", "cohort_seed": 1}
    doc = {"schema_version": 1, "cell": {"cell_id": cell_id, "n_train": 5, "model": "m"}, "metric_rows": [{**row, **changes}] * rows}
    return json.dumps(doc)


NAME = "flow__w__cohort1__subset2__model3__n5__m__none"


def test_cell_files_are_read_indexed_and_checked(spark, tmp_path):
    good = write(tmp_path / f"{NAME}.json", cell(NAME, 2))
    write(tmp_path / "flow__w__cohort9__subset2__model3__n5__m__none.json", cell(NAME))
    write(tmp_path / "flow__w__cohort8__subset2__model3__n5__m__none.json", "{broken")
    files = cells.read_files(spark, str(tmp_path))
    parsed = cells.parse_cells(files)
    assert cells.cell_metrics(parsed).count() == 3
    index = {r.path.split("/")[-1]: r for r in cells.cell_index(files).collect()}
    assert index[good.name].sha256 == hashlib.sha256(good.read_bytes()).hexdigest()
    assert (index[good.name].n_metric_rows, index[good.name].bytes) == (2, good.stat().st_size)
    found = {r.path.split("cohort")[1][0]: tuple(r)[1:] for r in cells.check_cell_identity(parsed).collect()}
    assert found == {"1": (True, True, True), "9": (True, False, True), "8": (False, False, False)}


def test_traces_take_their_identity_from_the_name(spark, tmp_path):
    write(tmp_path / "traces" / f"{NAME}.csv", "epoch,loss\n1,0.5\n2,0.4\n")
    out = cells.read_cell_traces(spark, str(tmp_path / "traces"), "epoch BIGINT, loss DOUBLE")
    row = out.where("epoch = 2").first()
    assert (row.loss, row.cell_id, row.cohort_seed, row.model_seed, row.n_train, row.variant) == (0.4, NAME, 1, 3, 5, "m__none")


def test_traces_with_columns_in_another_order_are_refused(spark, tmp_path):
    write(tmp_path / "traces" / f"{NAME}.csv", "loss,epoch\n0.5,1\n")
    with pytest.raises(Exception, match="(?i)header"):
        cells.read_cell_traces(spark, str(tmp_path / "traces"), "epoch BIGINT, loss DOUBLE").collect()


def test_readers_follow_the_last_published_generation(spark, tmp_path):
    with pytest.raises(ValueError, match="nothing is published"):
        tables.read_published(spark, str(tmp_path), "t")
    for n, name in enumerate(("b", "a", "c")):
        tables.publish_tables({"t": spark.range(n + 1)}, str(tmp_path), name)
        assert tables.read_published(spark, str(tmp_path), "t").count() == n + 1


def test_summaries_join_their_plan(spark, tmp_path):
    write(tmp_path / f"{NAME}.json", '{"stop_epoch": 7}')
    write(tmp_path / f"{NAME}3.json", '{"stop_epoch": ')
    write(tmp_path / "again" / f"{NAME}2.json", '{"stop_epoch": 8}')
    write(tmp_path / f"{NAME}2.json", '{"stop_epoch": 9}')
    plan = spark.createDataFrame([(NAME, "w"), (f"{NAME}2", "w"), (f"{NAME}3", "w"), ("gone", "w")], "cell_id string, world string")
    out = cells.read_cell_summaries(spark, str(tmp_path), plan, "stop_epoch BIGINT")
    assert sorted(tuple(r) for r in out.fillna(-1).collect()) == sorted(
        [(NAME, "w", 7, "ok"), (f"{NAME}2", "w", 8, "repeated"), (f"{NAME}2", "w", 9, "repeated"), (f"{NAME}3", "w", -1, "unreadable"), ("gone", "w", -1, "missing")]
    )


def test_collecting_reports_unplanned_and_duplicate_rows(spark):
    rows = spark.createDataFrame([("a", "mae"), ("a", "mae"), ("b", "mae")], "cell_id string, metric string")
    kept, findings = tables.collect_metrics(rows, spark.createDataFrame([("a",)], "cell_id string"))
    assert kept.count() == 2
    assert {r.finding for r in findings.collect()} == {"unplanned", "duplicate"}
    with pytest.raises(ValueError):
        tables.require_clean(findings)


def test_write_once_accepts_the_same_and_rejects_other_content(spark, tmp_path):
    df = spark.createDataFrame([(1, "x"), (2, None)], "a int, b string")
    path = str(tmp_path / "t")
    assert tables.write_once(df, path) is True
    assert tables.write_once(df.orderBy(F.desc("a")).select("b", "a"), path) is False
    with pytest.raises(ValueError, match="other content"):
        tables.write_once(df.where("a = 1"), path)
    with pytest.raises(ValueError, match="other columns"):
        tables.write_once(df.drop("b"), path)


def test_readers_follow_the_published_generation(spark, tmp_path):
    root = str(tmp_path / "pub")
    tables.publish_tables({"t": spark.range(2)}, root, "1")
    tables.publish_tables({"t": spark.range(5)}, root, "2")
    assert tables.read_published(spark, root, "t").count() == 5
    with pytest.raises(Exception):
        tables.publish_tables({"t": spark.range(5)}, root, "2")


def test_small_tables_are_one_sorted_file(spark, tmp_path):
    tables.write_tables(spark.range(10).orderBy(F.desc("id")), str(tmp_path / "c"), ["id"], small=True)
    files = list((tmp_path / "c").glob("*.csv"))
    assert len(files) == 1 and files[0].read_text().split()[1:] == [str(i) for i in range(10)]


def test_checksum_audit_of_a_folder(spark, tmp_path):
    data = tmp_path / "data"
    one = write(data / "a" / "one.txt", "one")
    write(data / "two.txt", "two")
    digest = hashlib.sha256(one.read_bytes()).hexdigest()
    lines = [
        f"{digest}  a/one.txt", f"{digest} *two.txt", f"{digest}  gone.txt", f"{digest}  big/x.bin",
        "abc  two.txt", "justoneword", f"{digest}  ../up.txt", f"{digest}  /abs.txt", f"{digest}  c:\\\\x", "",
    ]
    manifest = spark.createDataFrame([(line,) for line in lines], "value string")
    out = audit.checksum_audit(manifest, audit.file_digests(spark, str(data)), unavailable=["big/*.bin"])
    got = sorted((r.code, r.ok) for r in out.collect())
    assert got == sorted(
        [
            ("sha256_match", True), ("sha256_mismatch", False), ("missing_path", False), ("manifest_target_unavailable", True),
            ("invalid_sha", False), ("invalid_manifest_line", False),
            ("unsafe_manifest_path", False), ("unsafe_manifest_path", False), ("unsafe_manifest_path", False),
        ]
    )


def test_tree_diff_and_path_audit(spark, tmp_path):
    for tree in ("a", "b"):
        write(tmp_path / tree / "same.txt", "s")
        write(tmp_path / tree / "sub" / "moved.txt", tree)
    write(tmp_path / "a" / "old.txt", "x")
    diff = audit.diff_exact(audit.file_digests(spark, str(tmp_path / "a")), audit.file_digests(spark, str(tmp_path / "b")))
    assert {r.relative: r.status for r in diff.collect()} == {"same.txt": "same", "sub/moved.txt": "differs", "old.txt": "missing"}
    declared = spark.createDataFrame([("same.txt",), ("nope.txt",)], "relative string")
    out = audit.path_audit(declared, audit.file_names(spark, str(tmp_path / "a")))
    assert {r.subject: r.ok for r in out.collect()} == {"same.txt": True, "nope.txt": False}


def test_content_hash_ignores_order_but_not_repeats_or_nulls(spark):
    df = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "x int, y string")
    h = lambda d: audit.content_hash(d, ["x", "y"]).first().content_sha256
    assert h(df) == h(df.orderBy(F.desc("x")))
    assert h(df) != h(df.distinct())
    assert h(df) != h(df.fillna(""))
    assert h(df.limit(0)) != h(df)


def test_numeric_diff_uses_the_rerun_for_relative_tolerance(spark):
    a = spark.createDataFrame([("k", 100.0), ("n", float("nan"))], "k string, v double")
    b = spark.createDataFrame([("k", 110.0), ("n", float("nan"))], "k string, v double")
    ok = lambda x, y, **t: audit.diff_numeric(x, y, ["k"], [audit.Tolerance("v", **t)]).first().ok
    assert ok(a, b, rtol=10 / 110) and not ok(b, a, rtol=10 / 110)
    assert not ok(a, b, rtol=0.1, equal_nan=False)
    assert not ok(a, b.where("k = 'k'"), rtol=0.1)


def test_numeric_diff_of_text_repeats_and_infinity(spark):
    frame = lambda rows: spark.createDataFrame(rows, "k string, v string")
    diff = lambda x, y: audit.diff_numeric(frame(x), frame(y), ["k"], [audit.Tolerance("v")]).first()
    assert diff([("a", "1")], [("a", "1.0")]).ok
    assert not diff([("a", "abc")], [("a", "xyz")]).ok and not diff([("a", "abc")], [("a", "abc")]).ok
    twice = diff([("a", "1"), ("a", "1")], [("a", "1")])
    assert not twice.ok and (twice.repeated_keys, twice.compared) == (1, 0)
    equal = diff([("a", "Infinity"), ("b", "1")], [("a", "Infinity"), ("b", "1")])
    assert equal.ok and equal.max_abs_error == 0.0
    assert not diff([("a", "Infinity")], [("a", "1")]).ok
    assert diff([(None, "1")], [(None, "1")]).ok and not diff([(None, "1")], [("a", "1")]).ok


def test_values_with_separators_are_told_apart(spark):
    a = spark.createDataFrame([("a|vb", "c")], "x string, y string")
    b = spark.createDataFrame([("a", "b|vc")], "x string, y string")
    assert not audit.multiset_equal(a, b, ["x", "y"]).first().equal
    h = lambda df: audit.content_hash(df, ["x", "y"]).first().content_sha256
    assert h(a) != h(b)
    assert not audit.compare_lineage(audit.lineage_hashes({"t": a}), audit.lineage_hashes({"t": b})).first().ok


def test_multisets_count_repeats(spark):
    a = spark.createDataFrame([(1.0,), (1.0,), (float("nan"),)], "x double")
    b = spark.createDataFrame([(1.0,), (None,), (2.0,)], "x double")
    assert tuple(audit.multiset_equal(a, b, ["x"]).first()) == (1, 1, False)
    assert tuple(audit.multiset_equal(a, a, ["x"]).first()) == (0, 0, True)


def test_decisions_match_after_normalising(spark):
    df = spark.createDataFrame([("Result:  AMBIGUOUS → STOP —  now", "ambiguous -> stop"), ("other", "ambiguous -> stop")], "t string, e string")
    assert [r.ok for r in audit.diff_decision(df, "t", "e").collect()] == [True, False]


@pytest.mark.parametrize(
    "flags,verdict",
    [
        ((True, True, True, True), "EXACT"),
        ((True, False, True, True), "NUMERICALLY_REPRODUCED"),
        ((False, True, True, True), "SCIENTIFICALLY_REPRODUCED"),
        ((True, True, True, False), "FAILED_REPRODUCTION"),
    ],
)
def test_verdict(spark, flags, verdict):
    rows = [("r", n, f) for n, f in zip(("structural", "exact", "numerical", "scientific"), flags)]
    df = spark.createDataFrame(rows, "run string, layer string, ok boolean")
    assert audit.diff_verdict(df, ["run"]).first().verdict == verdict
