"""Training-order materialisation of token ids: fixed-stride shards in a keyed random order.

Documents are laid end to end, each closed by a separator, and cut into sequences of equal length. A
keyed Feistel network permutes the sequence numbers (cycle-walking keeps them inside their range), so every
sequence has one slot in the training order, and its slot can be computed back. A shard holds a range of
slots at a fixed stride: the place of a slot is known without an index, and a reader resumes at any slot.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from longspark.llm.common import broadcast_if_small
from longspark.session import materialize, work_folder

#: Token ids of a sequence, and sequences of a shard.
LENGTH = 2048
PER_SHARD = 4096
#: Bytes of shards that a task writes or reads, and tasks at most.
RANGE_BYTES = 64 << 20
MOST_RANGES = 100_000
_ROUNDS = 6
_MANIFEST = "shard long, first_slot long, sequences long, file string, sha256 string"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _half_bits(count: int) -> int:
    return max(1, (max(count - 1, 1).bit_length() + 1) // 2)


def _feistel(x: np.ndarray, bits: int, key: int, back: bool) -> np.ndarray:
    """One pass of the network over 2 * bits bits, or its inverse."""
    low = np.uint64((1 << bits) - 1)
    left, right = x >> np.uint64(bits), x & low
    for r in reversed(range(_ROUNDS)) if back else range(_ROUNDS):
        salt = np.uint64(((key * 0x9E3779B97F4A7C15) ^ (r * 0xD1B54A32D192ED03)) & (1 << 64) - 1)
        if back:
            left, right = right ^ (_mix(left + salt) & low), left
        else:
            left, right = right, left ^ (_mix(right + salt) & low)
    return (left << np.uint64(bits)) | right


def permute(numbers: np.ndarray, count: int, key: int, back: bool = False) -> np.ndarray:
    """A keyed permutation of 0 .. count - 1, or its inverse; walks on while it is outside the range."""
    bits = _half_bits(count)
    out = _feistel(numbers.astype(np.uint64), bits, key, back)
    while (outside := out >= count).any():
        out[outside] = _feistel(out[outside], bits, key, back)
    return out.astype(np.int64)


def stream_offsets(sizes: DataFrame) -> tuple[DataFrame, int]:
    """Where each document begins when all are laid end to end by (id, hash): (id, hash, n, start), and the total.

    Sums run inside ranges of the order; only one sum per range meets in one place. Rows that repeat id and
    text stand one after another and count ``copies`` times.
    """
    merged = sizes.groupBy("id", "hash").agg(F.max("size").alias("n"), F.count("*").alias("copies"))
    ranged = merged.repartitionByRange("id", "hash").withColumn("range", F.spark_partition_id())
    ranged = materialize(ranged)
    sums = ranged.groupBy("range").agg(F.sum(F.col("n") * F.col("copies")).alias("tokens")).collect()  # a row a range
    before, total = {}, 0
    for r in sorted(sums):
        before[r["range"]], total = total, total + r["tokens"]
    base = ranged.sparkSession.createDataFrame([(k, v) for k, v in before.items()] or [(0, 0)], "range int, base long")
    run = Window.partitionBy("range").orderBy("id", "hash").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum(F.col("n") * F.col("copies")).over(run), F.lit(0))
    placed = ranged.join(F.broadcast(base), "range").withColumn("start", F.col("base") + inside)
    return placed.select("id", "hash", "n", "copies", "start"), total


def write_shards(
    docs: DataFrame,
    folder: str,
    tokens: Column,
    id_: str = "doc_id",
    width: int = 1,
    separator: int = 0xFF,
    padding: int = 0xFE,
    length: int = LENGTH,
    per_shard: int = PER_SHARD,
    key: int = 1,
) -> tuple[DataFrame, int]:
    """Write all documents' tokens as shards into ``folder``; their manifest (written), and the sequences.

    ``tokens``: packed ids of ``width`` bytes each, little-endian; a document without tokens (null or empty)
    is its separator alone. The last sequence is filled up with ``padding``. Documents that repeat a row repeat
    its tokens; a null id comes first. No documents, no shards.

    A shard is written under a name of its own attempt and named by the manifest only when its task has
    committed; the tasks of lost executors are simply run again. Every shard but the last has
    ``per_shard * length * width`` bytes, and slot ``s`` stands in shard ``s // per_shard``.
    """
    close = F.lit(separator.to_bytes(width, "little"))
    packed = F.concat(F.coalesce(tokens, F.lit(b"")), close)
    rows = docs.select(F.col(id_).alias("id"), F.xxhash64(packed).alias("hash"), packed.alias("tokens"))
    sizes = rows.select("id", "hash", (F.octet_length("tokens") / width).cast("long").alias("size"))
    offsets, total = stream_offsets(sizes)
    count = -(-total // length)
    # copies of a row: one row stands for all
    offsets = materialize(offsets)
    placed = rows.join(
        broadcast_if_small(offsets.withColumnsRenamed({"id": "id_", "hash": "hash_"})),
        (F.col("hash") == F.col("hash_")) & F.col("id").eqNullSafe(F.col("id_")),
    )
    if not offsets.where("copies > 1").isEmpty():
        placed = placed.dropDuplicates(["id", "hash"])
    placed = placed.select("start", "copies", "n", "tokens")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def out(pieces: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
            slots = permute(np.array([p[0] for p in pieces], np.int64), count, key)
            kinds = (pa.int64(), pa.int64(), pa.int32(), pa.binary())
            columns = (slots // per_shard, slots, [p[1] for p in pieces], [p[2] for p in pieces])
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["shard", "slot", "at", "ids"])

        for batch in batches:
            pieces, size = [], 0
            for start, copies, n, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                for c in range(copies):
                    begin, done = start + c * n, 0
                    while done < n:
                        number, at = divmod(begin + done, length)
                        take = min(length - at, n - done)
                        pieces.append((number, at, ids[done * width : (done + take) * width]))
                        done += take
                        size += take * width
                        if size > 8 << 20:
                            yield out(pieces)
                            pieces, size = [], 0
            if pieces:
                yield out(pieces)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        shard = stream = file = None
        slot = at = first = written = 0
        digest = hashlib.sha256()

        def put(data: bytes) -> None:
            nonlocal written
            stream.write(data)
            digest.update(data)
            written += len(data)

        def end() -> pa.RecordBatch:
            tail = (slot - first + 1) * length * width - written
            if tail and slot != last_slot:
                raise ValueError(f"slot {slot} lacks {tail} bytes")
            put(padding.to_bytes(width, "little") * (tail // width))
            stream.close()
            row = [[shard], [first], [slot - first + 1], [f"{folder}/{file}"], [digest.hexdigest()]]
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(row, kinds)], names=[f.split()[0] for f in _MANIFEST.split(", ")])

        # the last sequence of the stream is the only one that is not full
        last_slot = int(permute(np.array([count - 1]), count, key)[0]) if count else -1
        for batch in batches:
            for s, t, a, ids in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if s != shard:
                    if shard is not None:
                        yield end()
                    fs.create_dir(root, recursive=True)
                    shard, file, digest, written = s, f"shard-{s:08d}-{uuid.uuid4().hex}.bin", hashlib.sha256(), 0
                    stream = fs.open_output_stream(f"{root}/{file}", compression=None)
                    first, slot, at = t, t, 0
                elif t != slot:
                    if at < length:
                        if slot != last_slot:
                            raise ValueError(f"slot {slot} ends at {at}")
                        put(padding.to_bytes(width, "little") * (length - at))
                    if t != slot + 1:
                        raise ValueError(f"no slot {slot + 1}")
                    slot, at = t, 0
                if a != at:
                    raise ValueError(f"slot {t} goes on at {a}, not {at}")
                put(ids)
                at += len(ids) // width
        if shard is not None:
            yield end()

    pieces = placed.mapInArrow(cut, "shard long, slot long, at int, ids binary")
    shards = -(-count // per_shard)
    ordered = _by_range(pieces, 0, shards, shards * per_shard * length * width).sortWithinPartitions("shard", "slot", "at")
    return materialize(ordered.mapInArrow(write, _MANIFEST)), count


def _by_range(rows: DataFrame, first: int, shards: int, size: int) -> DataFrame:
    """``rows`` dealt by equal ranges of ``shards`` shards from ``first`` on, of ``size`` bytes in all.

    Slots are random, so equal ranges are equal work and need no sample; their number is set and never coalesced.
    """
    least = rows.sparkSession.sparkContext.defaultParallelism
    n = max(1, min(shards, MOST_RANGES, max(least, -(-size // RANGE_BYTES))))
    return rows.repartitionById(n, F.floor((F.col("shard") - first) * n / max(1, shards)).cast("int"))


def read_shards(manifest: DataFrame, count: int, length: int = LENGTH, width: int = 1, key: int = 1, from_slot: int = 0) -> DataFrame:
    """The sequences from ``from_slot`` on: (slot, sequence, ids); each shard is read from front to back.

    Tasks read ranges of neighbouring shards, of about ``RANGE_BYTES`` each. An empty manifest gives no rows.
    """
    step = length * width

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, n, file in zip(*(batch.column(c).to_pylist() for c in ("first_slot", "sequences", "file"))):
                fs, path = pafs.FileSystem.from_uri(file)
                with fs.open_input_file(path) as source:
                    skip = max(0, from_slot - first)
                    source.seek(skip * step)
                    for at in range(first + skip, first + n, 1024):
                        slots = np.arange(at, min(at + 1024, first + n))
                        data = source.read(len(slots) * step)
                        ids = [data[i * step : (i + 1) * step] for i in range(len(slots))]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(slots, pa.int64()), pa.array(permute(slots, count, key, back=True)), pa.array(ids, pa.binary())],
                            names=["slot", "sequence", "ids"],
                        )

    files = manifest.where(F.col("first_slot") + F.col("sequences") > from_slot)
    least, most, sequences = files.agg(F.min("shard"), F.max("shard"), F.sum("sequences")).first()
    if least is not None:
        files = _by_range(files, least, most - least + 1, sequences * step).sortWithinPartitions("shard")
    return files.mapInArrow(read, "slot long, sequence long, ids binary")


def materialise(docs: DataFrame, tokens: Column, **options) -> tuple[DataFrame, int]:
    """``write_shards`` into a new folder below the shared one."""
    folder = f"{work_folder(docs.sparkSession)}/shards-{uuid.uuid4().hex}"
    return write_shards(docs, folder, tokens, **options)
