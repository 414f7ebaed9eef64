import pytest
from pyspark.sql import functions as F
from test_streams import DAY, inbox  # noqa: F401

from longspark.streaming import stateful

PROVIDER = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture
def folders(tmp_path):
    return str(tmp_path / "out"), str(tmp_path / "cp")


def test_history_orders_late_rows_and_goes_on_after_a_restart(spark, inbox, folders):  # noqa: F811
    out, checkpoint = folders
    before = spark.conf.get(PROVIDER, None)

    def run(idle=3650.0):
        stream = stateful.running_history(inbox.stream(), ["patient_id"], delay="2 days", idle_days=idle)
        stateful.run_keyed(stream, out, checkpoint)
        rows = spark.read.parquet(out).where("patient_id = 'p'").orderBy("us", "seq").collect()
        return [(r.us / DAY, r.value, r.last_value, r.n_before, r.elapsed_days, r.gap_days) for r in rows]

    # the second run is another query on the same checkpoint; its first row is late, but within the delay
    inbox.add([("p", 1, 1.0), ("p", 4, 4.0), ("q", 5, 0.0)])
    assert run() == [(1.0, 1.0, None, 0, 0.0, None)]
    inbox.add([("p", 3.5, 3.5), ("p", 4.5, None), ("p", 5, float("nan")), ("q", 10, 0.0)])
    got = run()
    assert [g[0] for g in got] == [1.0, 3.5, 4.0, 4.5, 5.0]
    assert [g[2:4] for g in got] == [(None, 0), (1.0, 1), (3.5, 2), (4.0, 3), (4.0, 3)]
    assert [g[4] for g in got] == [0.0, 2.5, 3.0, 3.5, 4.0] and [g[5] for g in got] == [None, 2.5, 0.5, 0.5, 0.5]
    # behind the watermark: dropped
    inbox.add([("p", 2, 2.0), ("p", 9, 9.0), ("q", 20, 0.0)])
    assert run()[-1] == (9.0, 9.0, 4.0, 3, 8.0, 4.0) and len(run()) == 6
    assert spark.conf.get(PROVIDER, None) == before


def test_an_idle_key_starts_anew(spark, inbox, folders):  # noqa: F811
    out, checkpoint = folders
    for batch in ([("p", 1, 1.0), ("q", 3, 0.0)], [("q", 30, 0.0)], [("p", 40, 40.0), ("q", 50, 0.0)]):
        inbox.add(batch)
        stateful.run_keyed(stateful.running_history(inbox.stream(), ["patient_id"], delay="1 day", idle_days=5.0), out, checkpoint)
    got = {(r.patient_id, r.us // DAY): (r.last_value, r.n_before, r.gap_days) for r in spark.read.parquet(out).collect()}
    assert got["p", 1] == got["p", 40] == (None, 0, None)
    assert got["q", 3] == (None, 0, None) and got["q", 30] == (None, 0, None)


def test_labels_come_once_their_horizon_has_passed(spark, inbox, folders):  # noqa: F811
    out, checkpoint = folders

    def run():
        labels = stateful.horizon_labels(inbox.stream(), F.col("value") > 0, days=3.0, delay="2 days")
        stateful.run_keyed(labels, out, checkpoint)
        return {(r.patient_id, r.us / DAY): r.horizon_label for r in spark.read.parquet(out).collect()}

    inbox.add([("p", 1.0, 0.0), ("p", 2.0, None), ("p", 2.5, 0.0), ("r", 6.0, 0.0)])
    assert run() == {("p", 1.0): 0}
    # a target that comes late, within the delay, still counts
    inbox.add([("p", 4.5, 1.0), ("r", 8.0, 1.0)])
    assert run() == {("p", 1.0): 0, ("p", 2.0): 1, ("p", 2.5): 1}
    inbox.add([("r", 30.0, 0.0)])
    got = run()
    assert got["p", 4.5] == 0 and got["r", 6.0] == 1 and got["r", 8.0] == 0 and len(got) == 6


def test_a_different_second_copy_is_flagged(spark, inbox, folders):  # noqa: F811
    out, checkpoint = folders
    batches = ([("c", 1, 1.0), ("c", 1.5, 1.0), ("d", 1, 1.0)], [("c", 2, 1.0), ("c", 2.5, 7.0), ("d", 2, 1.0)], [("c", 90, 7.0), ("z", 200, 0.0)], [("c", 201, 9.0)])
    for batch in batches:
        inbox.add(batch)
        copies = inbox.stream().withColumn("arrived", F.timestamp_micros("us"))
        found = stateful.first_copies(copies, ["patient_id"], F.col("value").cast("string").cast("binary"), keep_days=100.0)
        stateful.run_keyed(found, out, checkpoint)
    got = sorted((r.patient_id, r.arrived_us / DAY, r.status) for r in spark.read.parquet(out).collect())
    # after its time the first copy is forgotten, and another one is the first
    assert got == [("c", 1.0, "first"), ("c", 2.5, "conflict"), ("c", 90.0, "conflict"), ("c", 201.0, "first"), ("d", 1.0, "first"), ("z", 200.0, "first")]


def test_keys_of_one_group_stay_apart(spark, inbox, folders, monkeypatch):  # noqa: F811
    out, checkpoint = folders
    monkeypatch.setattr(stateful, "GROUPS", 1)
    for batch in ([("p", 1, 1.0), ("q", 1, 5.0), ("q", 2, 6.0)], [("p", 2, 2.0), (None, 3, 3.0), ("q", 9, 0.0)], [("q", 50, 0.0)]):
        inbox.add(batch)
        stateful.run_keyed(stateful.running_history(inbox.stream(), ["patient_id"], delay="3 days"), out, checkpoint)
    got = {(r.patient_id, r.us // DAY): (r.last_value, r.n_before, r.gap_days) for r in spark.read.parquet(out).collect()}
    assert got == {
        ("p", 1): (None, 0, None), ("p", 2): (1.0, 1, 1.0), (None, 3): (None, 0, None),
        ("q", 1): (None, 0, None), ("q", 2): (5.0, 1, 1.0), ("q", 9): (6.0, 2, 7.0),
    }
