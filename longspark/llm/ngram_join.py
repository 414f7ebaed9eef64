"""Jaccard join of documents on word shingles, by T-occurrence search.

Each document is a set of shingles. To reach the similarity, a partner has to occur in T of the inverted
lists of the set. As in DivideSkip, the lists are divided by length: of a document's n lists all but T - 1
are merged, the shortest; whoever occurs in too few of them cannot reach T. The T - 1 long lists are not
read: whether a candidate occurs in them is found by binary probes of its sorted set. Lengths of lists are
estimated by a sketch of fixed size over all documents; any order of the lists gives the same links.

Only the components of the links are wanted, so not every pair of a list is a candidate. Equal sets are
one class. In each list the member with the longest lists (the centre of a group of near copies) is
compared with the others; a list whose members are then in one component is done. In the other lists, all
members outside the list's largest component are queries against all members of lists with that component,
which leaves no pair of different components unseen. Blocks of queries of about one size have inverted lists of their
own: the short lists of the members travel to them and are merged, by sorting, and only members that occur
often enough there are sent as texts, once for a part of a block, not for a pair.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import broadcast_if_small, small_batches, worker_cache
from longspark.llm.components import connected_components
from longspark.session import materialize, release

SHINGLE = 3
#: Per cent of the union that two sets share at least.
SIMILARITY = 90
#: The same two for documents of which one stays.
NEAR_SHINGLE = 5
NEAR_SIMILARITY = 80
#: Counters of the sketch (2 to this, 4 bytes each), and counters that a row of it carries.
SKETCH_BITS = 21
_BLOCK = 1 << 13
#: Members that are compared with one copy of a list's centre.
MEMBERS = 500
#: Entries of short lists in a block of queries, and of members that are searched with one copy of it.
BLOCK = 1 << 19
SEARCHED = 1 << 20
#: Parts of a block whose whole sets are held together.
SUBS = 16
#: Rounds with one centre a list at most, as long as they find links and leave more than so many pairs for a list entry.
ROUNDS = 4
FEW = 64

_KNOWN_WORDS = 200_000
#: Larger counts of the sketch are not told apart.
_MOST = (1 << 31) - 1


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str | None, hashes: dict) -> np.ndarray:
    """64-bit hashes of the words between ASCII space, A-Z in lower case."""
    words = text.encode().lower().split() if text else []  # bytes: ASCII letters and spaces only
    if len(hashes) > _KNOWN_WORDS:
        hashes.clear()
    return np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))


def shingle_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """A 64-bit hash of each shingle in turn; fewer words than ``size`` are one shingle."""
    size = min(size, len(words))
    n = len(words) - size + 1 if size else 0
    h = _mix(words[:n] + np.uint64(size))
    for i in range(1, size):
        h = _mix(h * np.uint64(0x9E3779B97F4A7C15) + words[i : i + n])
    return h


def shingle_set(text: str | None, size: int, hashes: dict) -> np.ndarray:
    """The sorted distinct hashes of a text's shingles; none without words."""
    return np.unique(shingle_hashes(word_hashes(text, hashes), size))


def occurrences(n, similarity: int = SIMILARITY):
    """T: in so many lists of a set of ``n`` a similar partner occurs at least."""
    return (similarity * n + 99) // 100


def _sketch(docs: DataFrame, text: str) -> np.ndarray:
    """How often words occur, by the first bits of their hash; every document counts."""
    shift, blocks = np.uint64(64 - SKETCH_BITS), (1 << SKETCH_BITS) // _BLOCK

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = worker_cache("shingle words", _Hashes)
        counts = np.zeros(1 << SKETCH_BITS, np.int64)
        for batch in batches:
            words = [word_hashes(t, hashes) for t in batch.column(0).to_pylist()]
            places = (np.concatenate([np.empty(0, np.uint64), *words]) >> shift).astype(np.int64)
            counts += np.bincount(places, minlength=1 << SKETCH_BITS)
        own = np.minimum(counts, _MOST).astype(np.int32).reshape(blocks, _BLOCK)
        yield from _block_rows([(b, own[b]) for b in range(blocks) if own[b].any()])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for b, c in zip(batch.column(0).to_pylist(), batch.column(1)):
                c = np.frombuffer(c.as_buffer(), np.int32)
                sums[b] = np.minimum(sums.get(b, 0) + c.astype(np.int64), _MOST).astype(np.int32)
        yield from _block_rows(list(sums.items()))

    rows = docs.select(text).mapInArrow(count, "block int, counts binary")
    # blocks are added in two steps: no task reads one block from every task of a large scan
    for salt in (F.pmod(F.spark_partition_id(), F.lit(64)), F.lit(0)):
        rows = rows.withColumn("salt", salt).repartition("block", "salt").select("block", "counts")
        rows = rows.mapInArrow(add, "block int, counts binary")
    out = np.zeros((blocks, _BLOCK), np.int32)
    for b, c in rows.collect():  # of fixed size
        out[b] = np.frombuffer(c, np.int32)
    return out.reshape(-1)


def _block_rows(blocks: list[tuple[int, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    yield pa.RecordBatch.from_arrays(
        [pa.array([b for b, _ in blocks], pa.int32()), pa.array([c.tobytes() for _, c in blocks], pa.binary())],
        names=["block", "counts"],
    )


def _divided(words: np.ndarray, size: int, similarity: int, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The sorted set of shingles, and those of them whose lists are the short ones (all but T - 1), shortest first."""
    s, at = np.unique(shingle_hashes(words, size), return_index=True)
    if not len(s):
        return s, s
    often = counts[(words >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
    rarest = often[at]
    for i in range(1, min(size, len(words))):
        rarest = np.minimum(rarest, often[at + i])
    return s, s[np.lexsort((s, rarest))[: len(s) - occurrences(len(s), similarity) + 1]]


def _sets(docs: DataFrame, sketch, id_: str, text: str, size: int, similarity: int) -> DataFrame:
    """(doc, n, digest, short): the size, a digest of the set, and the hashes of its short lists."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts = worker_cache("shingle words", _Hashes), sketch.value
        for batch in batches:
            sizes, digests, shorts = [], [], []
            for t in batch.column(1).to_pylist():
                s, short = _divided(word_hashes(t, hashes), size, similarity, counts)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_hexdigest(s.tobytes()) if len(s) else None)
                shorts.append(short.view(np.int64))
            ends = np.cumsum([0, *map(len, shorts)]).astype(np.int32)
            short = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int64), *shorts])))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.string()), short],
                names=["doc", "n", "digest", "short"],
            )

    rows = docs.select(F.col(id_).cast("long").alias("doc"), F.col(text))
    return materialize(rows.mapInArrow(run, "doc long, n long, digest string, short array<long>"))


def _similar_size(a: str, b: str, similarity: int):
    return (100 * F.col(a) >= similarity * F.col(b)) & (100 * F.col(b) >= similarity * F.col(a))


def _linked(docs: DataFrame, pairs: DataFrame, id_: str, text: str, size: int, similarity: int) -> DataFrame:
    """The pairs (q, doc) whose whole sets are similar enough.

    A ``q`` with many partners is copied once for every ``MEMBERS`` of them, so none fills a task.
    """
    slots = pairs.groupBy("q").agg(F.ceil(F.count("*") / MEMBERS).alias("slots"))
    salted = pairs.join(slots, "q").withColumn("salt", F.pmod(F.xxhash64("doc"), F.col("slots")))
    salted = materialize(salted.select("q", "salt", "doc"))
    need = salted.select(F.col("doc").alias("id"), "q", "salt", F.lit(1).alias("kind")).union(
        salted.select(F.col("q").alias("id"), "q", "salt", F.lit(0).alias("kind")).distinct()
    )
    need = materialize(need)
    texts = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(broadcast_if_small(need), "id")
    # large texts: as many partitions as their number asks for, not as the key columns do
    rows = rows.repartition("q", "salt").sortWithinPartitions("q", "salt", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, centre = worker_cache("shingle words", _Hashes), None, np.empty(0, np.uint64)
        for batch in batches:
            found = []
            for q, salt, kind, doc, t in zip(*(batch.column(i).to_pylist() for i in range(5))):
                own = shingle_set(t, size, hashes)
                if kind == 0:
                    at, centre = (q, salt), own
                elif at == (q, salt) and len(own) and len(centre) and _similar(centre, own, similarity):
                    found.append((q, doc))
            yield pa.RecordBatch.from_arrays(
                [pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["q", "doc"]
            )

    links = materialize(rows.select("q", "salt", "kind", "id", "text").mapInArrow(probe, "q long, doc long"))
    release(salted, need)
    return links


def _searched(
    docs: DataFrame, sets: DataFrame, members: DataFrame, sketch, id_: str, text: str, size: int, similarity: int
) -> DataFrame:
    """Similar pairs (q, doc) that join different parts, of ``members`` (main, doc, n, part) of the same ``main``.

    Queries are the members whose part is not ``main``. They are dealt by (main, band of size), as sizes further than a
    band apart are never similar, and then by hash to blocks. First only short lists travel and are merged; the texts follow for the
    members and queries that reach the count, and their long lists are probed. One pair is enough for two parts.
    """
    band = F.floor(F.log("n") / (max(math.log(100 / similarity), 0.01) * 1.0001))
    entries = F.sum(F.col("n") - F.floor((similarity * F.col("n") + 99) / 100) + 1)
    keys, h = ["main", "band"], F.xxhash64("doc")
    members = members.withColumn("band", band)
    asking = members.where("part <> main")
    blocks = materialize(asking.groupBy(keys).agg(F.ceil(entries / BLOCK).alias("blocks")))
    met = members.withColumn("band", F.explode(F.array(F.col("band") - 1, F.col("band"), F.col("band") + 1)))
    met = materialize(met.join(broadcast_if_small(blocks), keys))
    shares = met.groupBy(keys).agg(F.first("blocks").alias("blocks"), F.ceil(entries / SEARCHED).alias("shares"))
    dealt = broadcast_if_small(materialize(shares))
    spread = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    sub = F.pmod(h, F.col("blocks") * SUBS)
    queries = asking.join(dealt, keys).withColumn("sub", sub).withColumn("block", F.pmod("sub", "blocks"))
    queries = queries.withColumn("share", spread("shares")).withColumn("kind", F.lit(0))
    others = met.drop("blocks").join(dealt, keys).withColumn("sub", F.lit(-1).cast("long")).withColumn("block", spread("blocks"))
    others = others.withColumn("share", F.pmod(h, F.col("shares"))).withColumn("kind", F.lit(1))
    columns = [*keys, "block", "share", "kind", "doc", "n", "part", "sub"]
    need = materialize(queries.select(columns).union(others.select(columns)))
    rows = sets.select("doc", "short").join(broadcast_if_small(need), "doc").repartition(*columns[:4]).sortWithinPartitions(*columns[:5])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, index, asked = None, None, []
        for batch in batches:
            found = []
            ends, tokens = batch.column(9).offsets.to_numpy(), batch.column(9).values.to_numpy().view(np.uint64)
            for i, (main, band, block, share, kind, doc, n, part, sub) in enumerate(zip(*(c.to_pylist() for c in batch.columns[:9]))):
                if at != (main, band, block, share):
                    at, index, asked = (main, band, block, share), None, []
                short = tokens[ends[i] : ends[i + 1]]
                if kind == 0:
                    asked.append((short, n, part, sub, doc))
                    continue
                if index is None:
                    index, named = _Lists(asked), set()
                who = index.reaching(short, n, part, similarity)
                found += [(main, band, int(s), 1, doc) for s in np.unique(index.subs[who])]
                for k in who:
                    if k not in named:
                        named.add(k)
                        found.append((main, band, asked[k][3], 0, asked[k][4]))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], k) for i, k in enumerate(kinds)], names=[*keys, "sub", "kind", "doc"])

    reached = rows.select(*columns, "short").mapInArrow(merge, "main long, band long, sub long, kind int, doc long")
    reached = materialize(reached.distinct())
    release(need, met)
    parts = materialize(members.select("main", "doc", "part").distinct())
    keys = [*keys, "sub"]
    copies = reached.where("kind = 1").groupBy(keys).agg(F.ceil(F.count("*") / MEMBERS).alias("shares"))
    copies = broadcast_if_small(materialize(copies))
    share = F.when(F.col("kind") == 0, F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).otherwise(F.array(F.pmod(h, F.col("shares"))))
    need = reached.join(copies, keys).withColumn("share", F.explode(share)).join(parts, ["main", "doc"])
    need = materialize(need.select(*keys, "share", "kind", F.col("doc").alias("id"), "part"))
    texts = docs.select(F.col(id_).cast("long").alias("id"), F.col(text).alias("text"))
    rows = texts.join(broadcast_if_small(need), "id").repartition(*keys, "share").sortWithinPartitions(*keys, "share", "kind")

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, at, index, asked, linked = worker_cache("shingle words", _Hashes), None, None, [], set()
        for batch in batches:
            found = []
            for *key, kind, doc, part, t in zip(*(c.to_pylist() for c in batch.columns)):
                if at != key:
                    at, index, asked, linked = key, None, [], set()
                own, short = _divided(word_hashes(t, hashes), size, similarity, sketch.value)
                if kind == 0:
                    asked.append((short, len(own), part, own, doc))
                    continue
                index = index or _Lists(asked)
                for k in index.reaching(short, len(own), part, similarity):
                    _, n, other, whole, q = asked[k]
                    if (other, part) not in linked and _similar(whole, own, similarity):
                        linked.add((other, part))
                        found.append((q, doc))
            yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in found], pa.int64()) for i in range(2)], names=["q", "doc"])

    links = materialize(rows.select(*keys, "share", "kind", "id", "part", "text").mapInArrow(probe, "q long, doc long"))
    release(need, reached, parts)
    return links


class _Lists:
    """Inverted lists of the short part of several sets: tuples that begin with (short, size, part, sub)."""

    def __init__(self, sets: list[tuple]):
        lengths = [len(s[0]) for s in sets]
        tokens, owner = np.concatenate([np.empty(0, np.uint64), *(s[0] for s in sets)]), np.repeat(np.arange(len(sets)), lengths)
        order = np.argsort(tokens, kind="stable")
        self.tokens, self.owner = tokens[order], owner[order]
        self.sizes = np.array([s[1] for s in sets], np.int64)
        self.parts = np.array([s[2] for s in sets], np.int64)
        self.subs = np.array([s[3] if np.isscalar(s[3]) else 0 for s in sets], np.int64)

    def reaching(self, short: np.ndarray, n: int, part: int, similarity: int) -> np.ndarray:
        """Which sets of other parts occur in enough of the merged lists of ``short``.

        All short parts go by one order, so of two sets that share ``least`` shingles those of one set beyond its short part
        are T - 1, and the others stand in both short parts.
        """
        first, end = np.searchsorted(self.tokens, short, "left"), np.searchsorted(self.tokens, short, "right")
        lengths = end - first
        before = np.cumsum(lengths) - lengths
        places = np.repeat(first - before, lengths) + np.arange(int(lengths.sum()))
        who, count = np.unique(self.owner[places], return_counts=True)
        sizes = self.sizes[who]
        least = -(-similarity * (sizes + n) // (100 + similarity))
        most = np.maximum(occurrences(sizes, similarity), occurrences(n, similarity))
        fits = (100 * sizes >= similarity * n) & (100 * n >= similarity * sizes)
        return who[(count >= least - most + 1) & fits & (self.parts[who] != part)]


def _similar(a: np.ndarray, b: np.ndarray, similarity: int) -> bool:
    """Two sorted sets: the smaller one's members are probed in the larger one."""
    small, large = (a, b) if len(a) < len(b) else (b, a)
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    both = int((large[place] == small).sum())
    return 100 * both >= similarity * (len(a) + len(b) - both)


def components(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = SHINGLE, similarity: int = SIMILARITY
) -> DataFrame:
    """One row per document row: (doc_id, n_shingles, component_id).

    ``component_id`` is the least id that links lead to, a document's own included. A document without
    words or text has no shingles and is alone. Rows that repeat an id are one document and one row each;
    rows without an id are linked with nothing and have no component. An empty table gives no rows.
    """
    return _components(docs, id_, text, size, similarity)[0]


def _components(docs: DataFrame, id_: str, text: str, size: int, similarity: int) -> tuple[DataFrame, list[DataFrame]]:
    """``components`` and the written frames that it reads."""
    small_batches(docs.sparkSession)
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(docs, text))
    sets = _sets(docs, sketch, id_, text, size, similarity)
    able = sets.where("doc is not null and n > 0")
    classes = able.groupBy("digest").agg(F.min("doc").alias("rep"), F.count("*").alias("m")).where("m > 1")
    written = materialize(classes.select("digest", "rep"))
    classes = broadcast_if_small(written)
    members = sets.select("doc", "n", "digest").join(classes, "digest", "left")
    members = members.withColumn("rep", F.when(F.col("doc").isNotNull(), F.coalesce("rep", "doc")))
    alone = able.join(classes, "digest", "left_anti").select("doc", "n", "short")
    heads = able.join(classes, "digest").where("doc = rep")
    heads = heads.dropDuplicates(["digest", "doc"]).select("doc", "n", "short")

    entries = alone.union(heads).select(F.explode("short").alias("token"), "doc", "n")
    # written, so that the join of a very long list can be split
    lists = materialize(entries.groupBy("token").agg(F.count("*").alias("length")).where("length > 1"))
    live = materialize(entries.join(lists, "token"))
    release(lists)
    links = _all_links(docs, sets, live, sketch, id_, text, size, similarity)
    labels = materialize(connected_components(links, "q", "doc"))
    release(live)
    out = members.join(labels, members["rep"] == labels["node"], "left")
    out = out.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "rep").alias("component_id")
    )
    return out, [sets, written, labels]


def _all_links(
    docs: DataFrame, sets: DataFrame, live: DataFrame, sketch, id_: str, text: str, size: int, similarity: int
) -> DataFrame:
    """Links that connect whatever the lists' members are connected by."""
    weight = live.groupBy("doc").agg(F.sum("length").alias("weight"))
    open_ = materialize(live.join(weight, "doc").withColumn("part", F.col("doc")))
    links, few = None, False
    for turn in range(ROUNDS + 1):
        parts = open_.groupBy("token", "part").agg(F.count("*").alias("m"))
        largest = parts.groupBy("token").agg(
            F.max(F.struct("m", F.col("part"))).alias("top"), F.sum("m").alias("all"), F.count("*").alias("parts")
        )
        largest = materialize(largest.where("parts > 1").select("token", F.col("top.part").alias("main"), F.col("top.m"), "all"))
        rows = open_.join(largest.select("token", "main"), "token")
        left, entries = largest.agg(
            F.coalesce(F.sum((F.col("all") - F.col("m")) * F.col("all")), F.lit(0)), F.coalesce(F.sum("all"), F.lit(0))
        ).first()
        if not entries:
            release(open_, largest)
            break
        if turn == ROUNDS or few or (turn and left <= FEW * entries):
            members = materialize(rows.select("main", "doc", "n", "part").distinct())
            release(open_, largest)
            found = _searched(docs, sets, members, sketch, id_, text, size, similarity)
            release(members)
            links = found if links is None else materialize(links.union(found))
            break
        centre = F.max(F.struct(F.col("part") != F.col("main") if turn else F.lit(True), "weight", "doc", "n", "part")).alias("c")
        centres = rows.groupBy("token").agg(centre)
        centres = centres.select("token", F.col("c.doc").alias("q"), F.col("c.n").alias("nq"), F.col("c.part").alias("pq"))
        pairs = rows.join(centres, "token").where("part <> pq")
        pairs = pairs.where(_similar_size("n", "nq", similarity)).select("q", "doc").distinct()
        pairs = materialize(pairs)
        found = _linked(docs, pairs, id_, text, size, similarity)
        # where centres link little, further centres would not either
        few = 20 * found.count() < pairs.count()
        release(pairs)
        links = found if links is None else materialize(links.union(found))
        labels = materialize(connected_components(links, "q", "doc"))
        rows = rows.drop("main").join(labels, rows["doc"] == labels["node"], "left")
        rows = rows.withColumn("part", F.coalesce("component", "doc")).drop("node", "component")
        before, open_ = open_, materialize(rows)
        release(before, labels, largest)
    return live.select(F.col("doc").alias("q"), "doc").limit(0) if links is None else links


def keep_one(
    docs: DataFrame, id_: str = "doc_id", text: str = "text", size: int = NEAR_SHINGLE, similarity: int = NEAR_SIMILARITY
) -> DataFrame:
    """One document of each component, that with the least id; documents that are alone all stay.

    Of rows with equal id and text one stays. Where an id has several texts, each of them stays: the id does not tell
    which of them is meant. Rows without an id stay. Other columns stay, of any name; null and empty texts are alone.
    """
    labelled, read = _components(docs, id_, text, size, similarity)
    found = materialize(labelled)
    release(*read)
    gone = materialize(found.where("component_id <> doc_id").select(F.col("doc_id").alias("_corpus_gone")).distinct())
    name = "_corpus_twice"
    copies = docs.where(F.col(id_).isNotNull()).groupBy(F.col(id_).alias(name)).agg(
        F.count("*").alias("n"), F.min(F.xxhash64(text)).alias("a"), F.max(F.xxhash64(text)).alias("b")
    )
    copies = materialize(copies.where("n > 1"))
    many, twice = copies.where("a <> b").select(name), copies.select(name)
    gone = gone.join(many, F.col("_corpus_gone") == F.col(name), "left_anti")
    left = docs.join(broadcast_if_small(materialize(gone)), F.col(id_) == F.col("_corpus_gone"), "left_anti")
    once = left.join(broadcast_if_small(twice), F.col(id_) == F.col(name), "left_anti")
    more = left.join(broadcast_if_small(twice), F.col(id_) == F.col(name), "left_semi")
    return once.union(more.dropDuplicates([id_, text]))
