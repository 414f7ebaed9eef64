"""Mixing sources to target weights: hash-random order inside each source, prefix sums of words, exact cuts.

Every row gets a random key from a hash of its id and text. The keys are uniform, so equal slices of their range cut
a source of ``n`` rows into about ``sqrt(n)`` slices of ``sqrt(n)`` rows, however large a source is. Rows are ordered
inside a slice, and the totals of the slices before it are carried in: the sum of the words in front of a row is known
without any task ordering a whole source. A source's budget is some whole epochs and a rest; the row at which the rest
runs out gives just the words that are left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longspark.llm.common import broadcast_if_small
from longspark.session import materialize

#: Characters between words; everything else belongs to words.
WORD = r"[^\x20\x09-\x0D]+"
#: Per cent of all words that the mix takes, and the most epochs of one source.
SHARE = 150
EPOCHS = 2
SEED = "mix"

_KEY_BITS = 60
_MOST_SLICES = 1 << 20


def words(text: Column) -> Column:
    """Words of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def random_key(id_: Column, text: Column, seed: str = SEED) -> Column:
    """A uniform integer under 2^60 that hangs on the id and the text alone."""
    parts = F.concat_ws("|", F.lit(seed), F.coalesce(id_.cast("string"), F.lit("")), F.md5(F.coalesce(text, F.lit("")).cast("binary")))
    return F.conv(F.substring(F.md5(parts.cast("binary")), 1, _KEY_BITS // 4), 16, 10).cast("long")


def sized(docs: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED) -> DataFrame:
    """The one pass over the texts, written: (source, id, key, size, copies), one row for rows that are equal in all of them."""
    rows = docs.select(
        F.col(source).alias("source"), F.col(id_).alias("id"), random_key(F.col(id_), F.col(text), seed).alias("key"), words(F.col(text)).alias("size")
    )
    return materialize(rows.groupBy("source", "id", "key", "size").agg(F.count("*").alias("copies")))


def source_sizes(rows: DataFrame) -> DataFrame:
    """(source, source_size, source_rows, at) of ``sized`` rows, written; ``at`` numbers the sources by code point, null last."""
    sums = rows.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("source_size"), F.count("*").alias("source_rows"))
    sums = materialize(sums)
    order = sums.select("source").orderBy(F.col("source").asc_nulls_last())
    # numbered by a distributed sort, as a window over all sources would be one task
    at = order.rdd.zipWithIndex().map(lambda r: (r[0][0], r[1])).toDF(f"source_ {sums.schema['source'].dataType.simpleString()}, at long")
    return materialize(sums.join(at, F.col("source").eqNullSafe(F.col("source_"))).drop("source_"))


def cycled(at: Column, weights: tuple[int, ...]) -> Column:
    """The weight of source number ``at`` where the weights repeat."""
    return F.get(F.array(*[F.lit(w) for w in weights]), (at % len(weights)).cast("int"))


def targets(sources: DataFrame, weight: Column, share: int = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """Add ``target`` to the sources: ``share`` per cent of all words dealt by weight, none above ``epochs`` times its size.

    What a source cannot take is dealt again by weight among the others, until none is above; a round reads one row
    of sums. Null, negative and zero weights get nothing. Where the limits leave too little room, each source that has a weight
    stands at its limit.
    """
    rows = materialize(sources.withColumn("_weight", F.greatest(F.coalesce(weight, F.lit(0)), F.lit(0)).cast("double")))
    limit = (F.col("source_size") * epochs).cast("double")
    whole = rows.agg(F.sum("source_size")).first()[0] or 0
    total, full, open_weight, n_full = whole * share / 100, 0.0, rows.agg(F.sum("_weight")).first()[0] or 0.0, 0
    while True:
        level = F.col("_weight") * F.lit(total - full) / F.lit(open_weight or 1.0)
        above = F.lit(open_weight == 0) | (level > limit)
        spent, left, n = rows.agg(
            F.sum(F.when(above & (F.col("_weight") > 0), limit)), F.sum(F.when(~above, F.col("_weight"))), F.count(F.when(above, 1))
        ).first()
        if n == n_full or open_weight == 0:
            break
        full, open_weight, n_full = spent or 0.0, left or 0.0, n
    target = F.when(F.col("_weight") == 0, F.lit(0.0)).when(above, limit).otherwise(level)
    return rows.withColumn("target", target).drop("_weight")


def plan(rows: DataFrame, sources: DataFrame) -> DataFrame:
    """What the mix takes of each row: (id, source, key, size, source_size, target, start, taken).

    ``rows`` from ``sized``, ``sources`` from ``targets``. ``start``: the words in front of the row in its source's
    order; ``taken``: its words times the whole epochs of the source, and as many again as are left of the rest at ``start``.
    Copies of a row stand one behind the other, so one may be taken oftener than the other. The taken words of a source add
    up to its target, rounded.
    """
    slices = F.least(F.ceil(F.sqrt("source_rows")), F.lit(_MOST_SLICES)).cast("long")
    named = broadcast_if_small(materialize(sources.withColumn("slices", slices).withColumnRenamed("source", "source_")))
    half = _KEY_BITS // 2
    rows = rows.join(named, F.col("source").eqNullSafe(F.col("source_")))
    rows = rows.withColumn("slice", F.shiftright(F.shiftright("key", half) * F.col("slices"), half))
    block = F.col("size") * F.col("copies")
    # the source's number stands for its name: not null, and short
    totals = materialize(rows.groupBy("at", "slice").agg(F.sum(block).alias("words")))
    before = Window.partitionBy("at").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = materialize(totals.select("at", "slice", F.coalesce(F.sum("words").over(before), F.lit(0)).alias("carried")))
    inside = Window.partitionBy("at", "slice").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = rows.select(*rows.columns, F.coalesce(F.sum(block).over(inside), F.lit(0)).alias("_inside"))
    placed = placed.join(carried, ["at", "slice"])
    placed = placed.withColumn("_copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    start = F.col("carried") + F.col("_inside") + F.col("_copy") * F.col("size")
    budget = F.floor(F.col("target") + 0.5)
    placed = placed.withColumns({"start": start, "_budget": budget})
    # a source without words has no budget
    whole = F.expr("_budget div greatest(source_size, 1)")
    rest = F.col("_budget") - whole * F.col("source_size")
    taken = whole * F.col("size") + F.greatest(F.least(F.col("size"), rest - F.col("start")), F.lit(0))
    return placed.select("id", "source", "key", "size", "source_size", "target", "start", taken.cast("long").alias("taken"))


def mix(
    docs: DataFrame,
    weights: tuple[int, ...],
    id_: str = "doc_id",
    text: str = "text",
    source: str = "source",
    share: int = SHARE,
    epochs: int = EPOCHS,
    seed: str = SEED,
) -> DataFrame:
    """The plan of a mix whose sources, by code point and null last, weigh ``weights``, repeating.

    One row a document, see ``plan``. Null ids and sources are values like others, a null text has no words, repeated
    rows each have their own row, other columns are not read, no documents give no rows. The same rows give the
    same mix, in whatever order they come.
    """
    rows = sized(docs, id_, text, source, seed)
    sources = source_sizes(rows)
    return plan(rows, targets(sources, cycled(F.col("at"), weights), share, epochs))


def texts(
    docs: DataFrame, planned: DataFrame, id_: str = "doc_id", text: str = "text", source: str = "source", seed: str = SEED
) -> DataFrame:
    """The mix itself: (epoch, start, source, id, text), a row for each time that words of a document are taken.

    A document that is cut keeps the words in front with what stands between them. Sorted by (epoch, start) inside a source,
    it is the order in which the source is read; documents without words are not in the mix.
    """
    whole = docs.select(F.col(source).alias("_source"), F.col(id_).alias("_id"), random_key(F.col(id_), F.col(text), seed).alias("_key"), F.col(text).alias("text"))
    whole = whole.dropDuplicates(["_source", "_id", "_key"])
    used = planned.where("taken > 0")
    same = (F.col("key") == F.col("_key")) & F.col("id").eqNullSafe(F.col("_id")) & F.col("source").eqNullSafe(F.col("_source"))
    rows = used.join(whole, same)
    times = F.ceil(F.col("taken") / F.col("size")).cast("int")
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), times)))
    left = F.least(F.col("size"), F.col("taken") - (F.col("epoch") - 1) * F.col("size")).cast("int")
    ends = F.split("text", r"(?<=[^\x20\x09-\x0D])(?=[\x20\x09-\x0D])")
    cut = F.when(left < F.col("size"), F.array_join(F.slice(ends, F.lit(1), left), "")).otherwise(F.col("text"))
    return rows.select("epoch", "start", "source", "id", cut.alias("text"))
