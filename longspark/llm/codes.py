"""Product codes of vectors: parts are assigned to codebook entries through a trie over their distinct values.

Vectors of integers are cut into parts. The distinct parts of all rows, with their counts, are written in
lexicographic order. A task walks the trie that such a run of parts spans: depth first, each node adds its own dimension
to the distances of its parent to all entries, so parts that begin alike share that work; a leaf takes the nearest entry and adds
its weighted components to that entry's sums. Below a node that leads to one part alone, the rest of the part is added at
once. The driver sees only codebooks and sums of their size.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm import vectors
from longspark.llm.common import broadcast_if_small
from longspark.session import materialize

SCALE = 1024
#: Scaled entries beyond it stand at it; distances then fit into 63 bits.
LIMIT = 1 << 27
PARTS = 4
ENTRIES = 256
ROUNDS = 4

#: Leaves below one node that are looked at together.
_LEAVES = 256


def nearest(parts: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of ``parts`` the nearest row of ``book`` (the first of several) and the squared distance.

    The rows of ``parts`` are different, and sorted with the first column first.
    """
    rows, width = parts.shape
    codes, errors = np.zeros(rows, np.int64), np.zeros(rows, np.int64)
    if not rows:
        return codes, errors
    entries = np.ascontiguousarray(book.T)
    todo: list[tuple[int, int, int, np.ndarray]] = [(0, rows, 0, np.zeros(len(book), np.int64))]
    while todo:
        first, end, depth, above = todo.pop()
        if depth == width or end - first == 1:
            # a leaf at the root, or vectors without any entry
            rest = np.square(parts[first, depth:, None] - entries[depth:]).sum(0) + above
            codes[first:end], errors[first:end] = rest.argmin(), rest.min()
            continue
        column = parts[first:end, depth]
        starts = np.concatenate([[0], np.flatnonzero(column[1:] != column[:-1]) + 1, [end - first]])
        sizes = np.diff(starts)
        alone = starts[:-1][sizes == 1] + first
        for at in range(0, len(alone), _LEAVES):
            chosen = alone[at : at + _LEAVES]
            total = np.repeat(above[None, :], len(chosen), 0)
            for k in range(depth, width):
                total += np.square(parts[chosen, k, None] - entries[k])
            best = total.argmin(1)
            codes[chosen], errors[chosen] = best, total[np.arange(len(chosen)), best]
        for i in np.flatnonzero(sizes > 1):
            begin = first + int(starts[i])
            shared = above + np.square(int(column[starts[i]]) - entries[depth])
            todo.append((begin, begin + int(sizes[i]), depth + 1, shared))
    return codes, errors


def distinct_rows(parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different rows in lexicographic order, and for each row the number of its own among them."""
    if not len(parts):
        return parts, np.zeros(0, np.int64)
    order = np.lexsort(parts.T[::-1])
    ordered = parts[order]
    new = np.concatenate([[True], (ordered[1:] != ordered[:-1]).any(1)])
    number = np.empty(len(parts), np.int64)
    number[order] = np.cumsum(new) - 1
    return ordered[new], number


def cuts(width: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin, and its end; where it cannot be cut equally the later parts are longer."""
    return [i * width // parts for i in range(parts + 1)]


def integers(rows: DataFrame, vector: str = "embedding", name: str = "x") -> tuple[DataFrame, int]:
    """The rows whose vector is whole, with the integers of its entries as ``name``; the length of the vectors.

    Null, empty and not finite vectors go, and those that are shorter or longer than most.
    """
    kept = rows.where(vectors.is_whole(F.col(vector)))
    width = vectors.usual_length(kept, vector)
    return kept.where(F.size(vector) == width).withColumn(name, vectors.scaled(F.col(vector), SCALE, LIMIT)), width


def first_books(kept: DataFrame, width: int, id_: str, x: str = "x", parts: int = PARTS, entries: int = ENTRIES) -> list[np.ndarray]:
    """The parts of the rows with the least ids as first codebooks: fewer rows, fewer entries; equal ids by their vectors, null ids last."""
    chosen = kept.orderBy(F.col(id_).asc_nulls_last(), F.col(x)).limit(entries).select(x).collect()
    whole = np.array([r[0] for r in chosen], np.int64).reshape(len(chosen), width)
    at = cuts(width, parts)
    return [whole[:, a:b].copy() for a, b in zip(at, at[1:])]


def distinct_parts(kept: DataFrame, width: int, x: str = "x", parts: int = PARTS) -> DataFrame:
    """(position, part, copies), written in lexicographic order; copies are counted before the shuffle."""
    at = cuts(width, parts)
    slices = F.array(*[F.slice(x, a + 1, b - a) for a, b in zip(at, at[1:])])
    found = kept.select(F.posexplode(slices).alias("position", "part")).groupBy("position", "part").agg(F.count("*").alias("copies"))
    return materialize(found.repartitionByRange("position", "part").sortWithinPartitions("position", "part"))


def train(distinct: DataFrame, books: list[np.ndarray], rounds: int = ROUNDS) -> list[np.ndarray]:
    """``rounds`` times: assign every distinct part, then move each entry to the floor of its parts' mean; unused ones stay."""
    for _ in range(rounds):
        books = [b.copy() for b in books]
        widest = max(b.shape[1] for b in books)
        summed = distinct.mapInArrow(_sums(books), "position int, entry int, copies long, sums array<long>")
        total = summed.groupBy("position", "entry").agg(
            F.sum("copies").alias("copies"), F.array(*[F.sum(F.get("sums", F.lit(i))) for i in range(widest)]).alias("sums")
        )
        # at most one row for each entry
        for r in total.collect():
            book = books[r["position"]]
            book[r["entry"]] = np.array(r["sums"][: book.shape[1]], np.int64) // r["copies"]
    return books


def _sums(books: list[np.ndarray]):
    """One pass over sorted parts: the trie of each batch, then one row for each entry that the partition uses."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = [np.zeros(len(b), np.int64) for b in books]
        sums = [np.zeros(b.shape, np.int64) for b in books]
        for batch in batches:
            positions = batch.column(0).to_numpy()
            copies = batch.column(2).to_numpy()
            for p in np.unique(positions):
                here = np.flatnonzero(positions == p)
                parts, number = distinct_rows(vectors.matrix(batch.column(1).take(pa.array(here)), books[p].shape[1]))
                weight = np.zeros(len(parts), np.int64)
                np.add.at(weight, number, copies[here])
                codes, _ = nearest(parts, books[p])
                np.add.at(counts[p], codes, weight)
                np.add.at(sums[p], codes, parts * weight[:, None])
        for p, n in enumerate(counts):
            used = np.flatnonzero(n)
            kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
            columns = ([p] * len(used), used, n[used], sums[p][used].tolist())
            names = ["position", "entry", "copies", "sums"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def encode(rows: DataFrame, books: list[np.ndarray], x: str = "x", prefix: str = "") -> DataFrame:
    """Add ``code`` (two hex digits a part) and ``error`` (squared distance to the entries) to rows with integers ``x``.

    Nothing is shuffled: each batch of rows has a trie of its own over its distinct parts. Other columns and repeated rows
    stay; columns of these names are replaced.
    """
    widths = [b.shape[1] for b in books]
    starts = np.concatenate([[0], np.cumsum(widths)])

    @F.arrow_udf("code string, error long")
    def run(column: pa.Array) -> pa.Array:
        whole = vectors.matrix(column, int(starts[-1]))
        errors = np.zeros(len(whole), np.int64)
        digits = np.zeros((len(whole), len(books)), np.uint8)
        for p, book in enumerate(books):
            parts, number = distinct_rows(whole[:, starts[p] : starts[p + 1]])
            codes, away = nearest(parts, book)
            digits[:, p] = codes[number]
            errors += away[number]
        return pa.StructArray.from_arrays([pa.array([d.tobytes().hex() for d in digits], pa.string()), pa.array(errors)], names=["code", "error"])

    names = [f"{prefix}code", f"{prefix}error"]
    rows = rows.drop(*names)
    out = rows.withColumn("_corpus_coded", run(F.col(x)))
    return out.select(*rows.columns, F.col("_corpus_coded.code").alias(names[0]), F.col("_corpus_coded.error").alias(names[1]))


def decode(rows: DataFrame, books: list[np.ndarray], code: str = "code", name: str = "decoded") -> DataFrame:
    """Add the integers that a code stands for; null for a null code."""
    tables = [F.array(*[F.array(*[F.lit(int(v)).cast("long") for v in entry]) for entry in book]) for book in books]
    pieces = [F.get(t, F.conv(F.substring(code, 2 * p + 1, 2), 16, 10).cast("int")) for p, t in enumerate(tables)]
    return rows.withColumn(name, F.when(F.col(code).isNotNull(), F.concat(*pieces)))


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components as decimal numbers by part, entry and place, with commas between."""
    return hashlib.sha256(",".join(str(v) for b in books for v in b.ravel().tolist()).encode()).hexdigest()


def with_total(rows: DataFrame, key: str, value: Column, name: str) -> DataFrame:
    """Add ``value`` summed over the rows with an equal ``key`` (nulls together); ``rows`` should be written.

    The sums are combined before they are shuffled and written, so a key with very many rows is not gathered anywhere.
    """
    totals = materialize(rows.groupBy(F.col(key).alias("_corpus_key")).agg(F.sum(value).alias(name)))
    joined = rows.drop(name).join(broadcast_if_small(totals), F.col(key).eqNullSafe(F.col("_corpus_key")), "left")
    return joined.drop("_corpus_key")


def compress(
    rows: DataFrame,
    vector: str = "embedding",
    id_: str = "vec_id",
    parts: int = PARTS,
    entries: int = ENTRIES,
    rounds: int = ROUNDS,
) -> tuple[DataFrame, list[np.ndarray]]:
    """Train codebooks on all rows and encode all rows: the rows without ``vector`` with (code, error), written; the books.

    Rows whose vector is null, empty, of unusual length or not finite are left out; no rows, no entries. Repeated rows, null ids and
    other columns stay; columns named code and error are replaced. At most 256 entries, as a code has two digits a part.
    """
    if not 0 < entries <= 256:
        raise ValueError("a codebook has 1 to 256 entries")
    x = "_corpus_x"
    plain = rows.select(*[c for c in rows.columns if c not in ("code", "error", x)])
    kept, width = integers(plain, vector, x)
    books = first_books(kept, width, id_, x, parts, entries)
    if not len(books[0]):
        return kept.drop(vector, x).withColumns({"code": F.lit(None).cast("string"), "error": F.lit(None).cast("long")}), books
    books = train(distinct_parts(kept, width, x, parts), books, rounds)
    return materialize(encode(kept.drop(vector), books, x).drop(x)), books
