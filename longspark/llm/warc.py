"""WARC archives of pages, and their capture index by external merging.

Tasks write their pages into archives of their own, a gzip member per record, and with each archive a run
of index entries sorted by (URL key, timestamp, page). The runs are dealt out by ranges of that order, as many
as keep a range small; each merges the sorted slices it has got from the runs in a loser tree, so the index as a whole is one
globally ordered list of capture histories. Archives are read back by their index entries.

A file gets a name of its own for every attempt of a task, and only what committed attempts report is read:
tasks that are lost and run again leave files behind that nothing refers to.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import broadcast_if_small
from longspark.session import materialize, work_folder

#: Payloads of at least so many bytes are stored once.
LEAST_REVISIT = 1000
#: Records of one archive at most; its index entries are sorted in memory.
RECORDS = 50_000
#: Index entries of a range about, which a task holds to merge them; bytes of archives that a task reads.
RANGE = 100_000
READ_BYTES = 64 << 20

_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_INDEX = "run string, file string, offset long, length long, urlkey string, ts long, page_id long"


def url_key(url: str | None) -> str:
    """Host labels from the right, then the rest, in lower case: pages of a site are neighbours."""
    m = re.match(r"[a-z][a-z0-9+.-]*://(?:www\.)?([^/?#:]*)(?::\d+)?([^#]*)", (url or "").lower(), re.S)
    return ",".join(reversed(m[1].split("."))) + ")" + (m[2] or "/") if m else (url or "")


def record(page_id, url, html, digest, size, kind, refers_to, ts) -> bytes:
    """One gzip member with a WARC/1.1 record; a revisit has no payload of its own."""
    name = lambda page: f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page}:{digest}')}>"
    block = _HTTP + (html.encode() if kind == "response" else b"")
    date = _iso(ts if ts is not None and 0 <= ts < 1 << 37 else 0)  # the field is required; the index keeps ts
    head = [
        "WARC/1.1",
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {name(page_id)}",
        f"WARC-Date: {date}",
        f"WARC-Payload-Digest: sha1:{base64.b32encode(bytes.fromhex(digest)).decode()}",
        f"X-Payload-Length: {size}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        # controls and spaces would break the header
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f-\x9f  ]", lambda m: f"%{ord(m[0]):02X}", url))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if kind == "revisit":
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: {name(refers_to)}", f"X-Refers-To-Page-ID: {refers_to}"]
    raw = "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"
    z = zlib.compressobj(4, zlib.DEFLATED, 31)
    return z.compress(raw) + z.flush()


def _iso(seconds: int) -> str:
    from datetime import UTC, datetime, timedelta

    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(seconds=seconds)).strftime("%Y-%m-%dT%H:%M:%SZ")


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record; a payload that does not fit its digest is an error."""
    raw = zlib.decompress(member, 31)
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    payload = rest[: int(fields["Content-Length"])].partition(b"\r\n\r\n")[2]
    if fields["WARC-Type"] == "response":
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        if fields["WARC-Payload-Digest"] != f"sha1:{digest}":
            raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return fields, payload


def with_record_types(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """Add payload size and digest, ``record_type`` and ``refers_to`` to (page_id, url, html, ts).

    Of equal payloads of ``least`` bytes or more the row with the largest page id is the response; rows that
    repeat it are responses too. Null pages have the empty payload. A null page id is never the largest.
    """
    body = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.withColumns({"html": body, "size": F.octet_length(body).cast("long"), "digest": F.sha1(body)})
    groups = rows.where(F.col("size") >= least).groupBy("digest", "size")
    groups = groups.agg(F.max("page_id").alias("_response"), F.count("*").alias("_n"))
    groups = materialize(groups.where("_n > 1 and _response is not null").drop("_n"))
    rows = rows.join(broadcast_if_small(groups), ["digest", "size"], "left")
    other = F.col("_response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("_response"))
    return rows.withColumns(
        {"record_type": F.when(other, "revisit").otherwise("response"), "refers_to": F.when(other, F.col("_response"))}
    ).drop("_response")


def write_archives(pages: DataFrame, folder: str, records: int = RECORDS) -> DataFrame:
    """Write (page_id, url, html, ts) rows as WARC archives into ``folder``; their index runs, written.

    A run is one archive's entries, sorted. An empty table writes nothing.
    """
    names = ["page_id", "url", "html", "digest", "size", "record_type", "refers_to", "ts"]

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pafs.FileSystem.from_uri(folder)
        out, entries, offset, file = None, [], 0, ""
        for batch in batches:
            for row in zip(*(batch.column(i).to_pylist() for i in range(len(names)))):
                if out is None:
                    file = f"{uuid.uuid4().hex}.warc.gz"
                    fs.create_dir(root, recursive=True)
                    out, entries, offset = fs.open_output_stream(f"{root}/{file}", compression=None), [], 0
                member = record(*row)
                out.write(member)
                entries.append((url_key(row[1]), row[7], row[0], offset, len(member)))
                offset += len(member)
                if len(entries) == records:
                    out.close()
                    out = None
                    yield run(file, entries)
        if out is not None:
            out.close()
            yield run(file, entries)

    def run(file: str, entries: list[tuple]) -> pa.RecordBatch:
        entries.sort(key=_order)
        keys, times, ids, offsets, lengths = zip(*entries)
        columns = [[file] * len(entries), [f"{folder}/{file}"] * len(entries), offsets, lengths, keys, times, ids]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        return pa.RecordBatch.from_arrays(
            [pa.array(c, k) for c, k in zip(columns, kinds)], names=[f.split()[0] for f in _INDEX.split(", ")]
        )

    return materialize(with_record_types(pages).select(names).mapInArrow(write, _INDEX))


def _order(entry: tuple) -> tuple:
    """By key, time and page; nulls first."""
    key, ts, page = entry[:3]
    return key, ts is not None, ts or 0, page is not None, page or 0, entry[3]


class LoserTree:
    """Merges sorted lists: each inner node keeps the loser of its match, the winner moves up."""

    def __init__(self, runs: list[list], key):
        self.key, self.k = key, len(runs)
        self.runs = [iter(r) for r in runs]
        self.head = [self._next(i) for i in range(self.k)]
        self.loser = [-1] * max(1, self.k)
        self.winner = self._play(1) if self.k else -1

    def _next(self, i: int):
        item = next(self.runs[i], None)
        return None if item is None else (self.key(item), i, item)

    def _beats(self, a: int, b: int) -> bool:
        x, y = self.head[a], self.head[b]
        return y is None or (x is not None and x[:2] <= y[:2])

    def _play(self, node: int) -> int:
        """The winner below a node; leaves are the nodes from k on."""
        if node >= self.k:
            return node - self.k
        a, b = self._play(2 * node), self._play(2 * node + 1)
        win, self.loser[node] = (a, b) if self._beats(a, b) else (b, a)
        return win

    def __iter__(self):
        while self.winner >= 0 and self.head[self.winner] is not None:
            i = self.winner
            yield self.head[i][2]
            self.head[i] = self._next(i)
            node = (i + self.k) // 2
            while node >= 1:  # replay the path of the leaf
                if self._beats(self.loser[node], i):
                    i, self.loser[node] = self.loser[node], i
                node //= 2
            self.winner = i


def merge_runs(runs: DataFrame) -> DataFrame:
    """The capture index: all entries, ordered by (urlkey, ts, page_id) within and across partitions.

    Ranges cut histories too, so that a URL captured very often does not fill a task. Their number follows the number of entries,
    so what a task holds does not grow with the index.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slices: dict[str, list[list[tuple]]] = {}
        schema = None
        for batch in batches:
            schema = batch.schema
            for run, file, offset, length, key, ts, page in zip(*(c.to_pylist() for c in batch.columns)):
                entry = (key, ts, page, offset, length, run, file)
                item, parts = (_order(entry), entry), slices.setdefault(run, [[]])
                if parts[-1] and item[0] < parts[-1][-1][0]:
                    parts.append([])  # a slice comes sorted; where its blocks come in another order, each is a slice
                parts[-1].append(item)
        rows = []
        for _, (key, ts, page, offset, length, run, file) in LoserTree([p for parts in slices.values() for p in parts], lambda item: item[0]):
            rows.append((run, file, offset, length, key, ts, page))
            if len(rows) == 10_000:
                yield _batch(rows, schema)
                rows = []
        if rows:
            yield _batch(rows, schema)

    n = max(runs.sparkSession.sparkContext.defaultParallelism, -(-runs.count() // RANGE))
    return runs.repartitionByRange(n, "urlkey", "ts", "page_id", "offset").mapInArrow(merge, _INDEX)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def read_archives(index: DataFrame) -> DataFrame:
    """The records that index entries name: (page_id, url, record_type, refers_to, payload_bytes,
    payload_digest, payload). A revisit has the size and digest of what it refers to, and no payload.

    Tasks read ranges of (file, offset) of about ``READ_BYTES``, or ``RECORDS`` records where these are short.
    """
    schema = (
        "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"
    )
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.binary()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened, source = None, None
        for batch in batches:
            rows, size = [], 0
            for file, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if file != opened:
                    fs, path = pafs.FileSystem.from_uri(file)
                    opened, source = file, fs.open_input_file(path)
                source.seek(offset)
                fields, payload = parse(source.read(length))
                page, other = fields.get("X-Page-ID"), fields.get("X-Refers-To-Page-ID")
                digest = base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
                response = fields["WARC-Type"] == "response"
                rows.append(
                    (
                        None if page is None else int(page),
                        fields.get("WARC-Target-URI"),
                        fields["WARC-Type"],
                        None if other is None else int(other),
                        len(payload) if response else int(fields["X-Payload-Length"]),
                        digest,
                        payload if response else None,
                    )
                )
                size += len(payload)
                if size > 8 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    names = [f.split()[0] for f in schema.split(", ")]
    size, records = index.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    n = max(index.sparkSession.sparkContext.defaultParallelism, -(-size // READ_BYTES), -(-records // RECORDS))
    rows = index.select("file", "offset", "length").repartitionByRange(n, "file", "offset")
    return rows.sortWithinPartitions("file", "offset").mapInArrow(read, schema)


def archive(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html", ts: Column | None = None) -> DataFrame:
    """Write the pages as archives into the shared folder and return their merged capture index, written.

    ``ts``: seconds of capture; null where not given.
    """
    folder = f"{work_folder(pages.sparkSession)}/warc-{uuid.uuid4().hex}"
    when = F.lit(None) if ts is None else ts
    rows = pages.select(
        F.col(page_id).cast("long").alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"), when.cast("long").alias("ts")
    )
    return materialize(merge_runs(write_archives(rows, folder)))
