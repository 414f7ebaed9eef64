import numpy as np
import pytest
from pyspark.sql import functions as F

from longspark.llm import token_output


@pytest.mark.parametrize("n", [1, 2, 3, 5, 17, 1000, 4097])
def test_permutation(n):
    out = token_output.permute(np.arange(n), n, 9)
    assert sorted(out) == list(range(n))
    assert (token_output.permute(out, n, 9, back=True) == np.arange(n)).all()


def test_keys_give_other_orders():
    a, b = (token_output.permute(np.arange(500), 500, k) for k in (1, 2))
    assert (a != b).mean() > 0.9 and abs(np.corrcoef(np.arange(500), a)[0, 1]) < 0.2


@pytest.mark.parametrize("width", [1, 4])
def test_shards(spark, width):
    rows = [(3, b"abcdefghij"), (1, b""), (2, None), (2, None), (None, b"xyz"), (7, bytes(range(90)))]
    packed = [(d, None if t is None else b"".join(bytes([b]) + b"\0" * (width - 1) for b in t)) for d, t in rows]
    docs = spark.createDataFrame(packed, "doc_id long, start binary").repartition(3)
    options = {"width": width, "length": 8, "per_shard": 3, "separator": 200, "padding": 201}
    manifest, count = token_output.materialise(docs, F.col("start"), **options)
    unit = lambda b: bytes([b]) + b"\0" * (width - 1)
    ordered = sorted(packed, key=lambda r: -1 if r[0] is None else r[0])
    stream = b"".join((t or b"") + unit(200) for _, t in ordered)
    want = -(-len(stream) // (8 * width))
    stream += unit(201) * (want * 8 - len(stream) // width)
    assert count == want and manifest.count() == -(-want // 3)
    got = token_output.read_shards(manifest, count, length=8, width=width).orderBy("slot").collect()
    assert [r.slot for r in got] == list(range(want))
    for r in got:
        assert bytes(r.ids) == stream[r.sequence * 8 * width : (r.sequence + 1) * 8 * width]
    late = token_output.read_shards(manifest, count, length=8, width=width, from_slot=4).orderBy("slot").collect()
    assert [(r.slot, r.sequence) for r in late] == [(r.slot, r.sequence) for r in got[4:]]


def test_no_documents(spark):
    manifest, count = token_output.materialise(spark.createDataFrame([], "doc_id long, t binary"), F.col("t"))
    assert count == 0 and token_output.read_shards(manifest, count).count() == 0


def test_ranges_of_shards(spark, monkeypatch):
    """As many tasks as there are bytes, whatever the size of the manifest; each has neighbouring shards."""
    docs = spark.createDataFrame([(i, bytes(range(100))) for i in range(40)], "doc_id long, t binary")
    options = {"length": 8, "per_shard": 4, "separator": 200, "padding": 201}
    manifest, count = token_output.materialise(docs, F.col("t"), **options)
    assert manifest.count() == -(-count // 4) == 127
    own = spark.sparkContext.defaultParallelism
    assert token_output.read_shards(manifest, count, length=8).rdd.getNumPartitions() == own
    monkeypatch.setattr(token_output, "RANGE_BYTES", 128)
    found = token_output.read_shards(manifest, count, length=8)
    assert found.rdd.getNumPartitions() == 32  # 127 shards of 32 bytes
    tasks = found.withColumn("task", F.spark_partition_id()).groupBy("task").agg(F.min("slot").alias("a"), F.max("slot").alias("b"))
    spans = sorted((r.a, r.b) for r in tasks.collect())
    assert len(spans) == 32 and all(x[1] < y[0] for x, y in zip(spans, spans[1:]))
    late = token_output.read_shards(manifest, count, length=8, from_slot=count - 3)
    assert sorted(r.slot for r in late.collect()) == [count - 3, count - 2, count - 1]
