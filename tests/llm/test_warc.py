import random

import pytest
from pyspark.sql import functions as F

from longspark.llm import warc


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 16])
def test_loser_tree(k):
    rng = random.Random(k)
    runs = [sorted(rng.randrange(50) for _ in range(rng.randrange(20))) for _ in range(k)]
    assert list(warc.LoserTree(runs, lambda x: x)) == sorted(x for r in runs for x in r)


def test_url_key():
    assert warc.url_key("HTTP://www.Example.com:80/a?b#c") == "com,example)/a?b"
    assert warc.url_key(None) == "" and warc.url_key("no url") == "no url"


def test_round_trip(spark):
    big = "é" * 600
    rows = [
        (1, "http://a.example/\r\nX: y", big, "n"),
        (9, "http://b.example/", big, "n"),
        (9, "http://b.example/", big, "n"),
        (4, None, "small", "n"),
        (5, "http://a.example/", "small", "n"),
        (6, "http://a.example/", None, "n"),
        (None, "http://c.example/", big, "n"),
        (7, "x", "line\r\n\r\nline" * 300, "n"),
    ]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest string").repartition(3)
    index = warc.archive(pages)
    keys = [(r.urlkey, r.page_id or 0) for r in index.collect()]
    assert len(keys) == 8
    got = sorted(((r.page_id, r.record_type, r.refers_to, r.payload_bytes, r.payload) for r in warc.read_archives(index).collect()), key=str)
    want = [
        (1, "revisit", 9, 1200, None),
        (9, "response", None, 1200, big.encode()),
        (9, "response", None, 1200, big.encode()),
        (4, "response", None, 5, b"small"),
        (5, "response", None, 5, b"small"),
        (6, "response", None, 0, b""),
        (None, "revisit", 9, 1200, None),
        (7, "response", None, 3600, ("line\r\n\r\nline" * 300).encode()),
    ]
    assert [g[:4] + (None if g[4] is None else bytes(g[4]),) for g in got] == sorted(want, key=str)
    assert warc.read_archives(warc.archive(pages.limit(0))).count() == 0


def test_index_is_globally_ordered(spark):
    rng = random.Random(2)
    rows = [(i, f"http://{rng.choice('abc')}.example/{rng.choice(['', 'x'])}", "t") for i in range(300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    runs = warc.write_archives(pages.withColumn("ts", pages["page_id"] % 7), _folder(spark), records=20)
    assert runs.select("run").distinct().count() >= 15
    order = [(r.urlkey, r.ts, r.page_id) for r in warc.merge_runs(runs).collect()]
    assert order == sorted(order) and len(order) == 300


def test_tasks_follow_the_size(spark, monkeypatch):
    rows = [(i, f"http://{'abc'[i % 3]}.example/", "t" * 50) for i in range(400)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(2)
    own = spark.sparkContext.defaultParallelism
    index = warc.archive(pages)
    assert warc.read_archives(index).rdd.getNumPartitions() == own
    monkeypatch.setattr(warc, "RANGE", 10)
    monkeypatch.setattr(warc, "READ_BYTES", index.groupBy().sum("length").first()[0] // 30)
    runs = warc.write_archives(pages.withColumn("ts", pages["page_id"] % 7), _folder(spark), records=30)
    merged = warc.merge_runs(runs)
    assert merged.rdd.getNumPartitions() >= 39  # ranges of equal entries may be one
    held = merged.withColumn("task", F.spark_partition_id()).groupBy("task").count()
    assert max(r["count"] for r in held.collect()) <= 30
    order = [(r.urlkey, r.ts, r.page_id) for r in merged.collect()]
    assert order == sorted(order) and len(order) == 400
    read = warc.read_archives(index)
    assert read.rdd.getNumPartitions() >= 29 and sorted(r.page_id for r in read.collect()) == list(range(400))


def _folder(spark):
    from longspark.session import work_folder

    return f"{work_folder(spark)}/warc-test-{random.random()}"
