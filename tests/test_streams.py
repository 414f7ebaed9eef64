import pytest
from pyspark.sql import functions as F

from longspark.streaming import streams

DAY = 86_400_000_000
SCHEMA = "patient_id string, us bigint, seq bigint, code string, value double"


def rows(spark, data):
    full = [(p, int(t * DAY), i, "a", v) for i, (p, t, v) in enumerate(data)]
    return spark.createDataFrame(full, SCHEMA)


@pytest.fixture
def inbox(spark, tmp_path):
    """A folder that takes one file per call, and a stream over it."""

    class Inbox:
        path = str(tmp_path / "in")
        count = 0

        def add(self, data):
            rows(spark, data).coalesce(1).write.mode("append").parquet(self.path)

        def stream(self):
            return streams.file_stream(spark, self.path, rows(spark, []).schema, files_per_trigger=1)

    return Inbox()


def test_history_updates_across_runs_and_takes_late_rows(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in ([("p", 1, 1.0), ("q", 1, 9.0)], [("p", 3, 3.0), ("p", 2, None)], [("p", 0.5, 0.5)]):
        inbox.add(batch)
        streams.run_to_latest(streams.history(inbox.stream(), ["patient_id", "code"]), out, checkpoint)
    got = {r.patient_id: (r.last_value, r["count"], r.first_us) for r in streams.latest(spark, out, ["patient_id", "code"]).collect()}
    assert got == {"p": (3.0, 3, DAY // 2), "q": (9.0, 1, DAY)}


def test_rows_behind_the_watermark_are_dropped(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in ([("p", 1.5, 1.0), ("p", 9.5, 1.0)], [("p", 1.6, 1.0), ("p", 9.1, 1.0)], [("p", 20.0, 1.0)]):
        inbox.add(batch)
        streams.run_to_table(streams.windows(inbox.stream(), ["patient_id"], length="1 day", delay="1 day"), out, checkpoint)
    got = {r.start_us // DAY: r.n for r in spark.read.parquet(out).collect()}
    assert got == {1: 1, 9: 2}


def test_horizon_label_waits_for_the_watermark(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")

    def run():
        steps = inbox.stream().select("patient_id", "us", "seq")
        joined = streams.horizon(steps, inbox.stream(), F.col("value") > 0, days=3.0, delay="1 day")
        streams.run_to_table(joined, out, checkpoint)
        return {r.us / DAY: r.horizon_label for r in streams.horizon_labels(spark.read.parquet(out)).collect()}

    inbox.add([("p", 1.0, 0.0), ("p", 2.0, 1.0)])
    first = run()
    assert first[1.0] == 1 and 2.0 not in first
    inbox.add([("p", 30.0, 0.0)])
    assert run()[2.0] == 0


def test_the_first_copy_of_a_cell_is_kept(spark, inbox, tmp_path):
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "cp")
    for batch in ([("c1", 1, 1.0), ("c2", 1, 1.0)], [("c1", 1.5, 2.0)]):
        inbox.add(batch)
        cells = inbox.stream().withColumn("arrived", F.timestamp_micros("us"))
        streams.run_to_table(streams.cells_once(cells, ["patient_id"], delay="2 days"), out, checkpoint)
    assert sorted((r.patient_id, r.value) for r in spark.read.parquet(out).collect()) == [("c1", 1.0), ("c2", 1.0)]


def test_bad_rows_are_held_back_in_flight(spark, tmp_path):
    source, good, bad, checkpoint = (str(tmp_path / n) for n in ("src", "good", "bad", "cp"))
    columns = "patient_id string, start_time string, code string, value string, unit string, event_type string, source string, metadata string, seq bigint"
    data = [("p", "2024-01-01T00:00:00Z", "a", "1", None, "observation", "s", None, 1), ("", "2024-01-01", "a", "1", None, "visit", "s", None, 2)]
    raw = spark.createDataFrame(data, columns)
    raw.write.parquet(source)
    for _ in range(2):
        streams.check_in_flight(streams.file_stream(spark, source, raw.schema), good, bad, checkpoint)
    assert spark.read.parquet(good).count() == 1
    assert spark.read.parquet(bad).first().reasons == ["empty_patient_id", "time_without_zone", "unknown_event_type"]
