"""Line dedup: lines equal to an earlier line, or within a few edits of one, are removed.

Near lines are found by a segment-partition join. A line cut into K + 1 segments keeps one of them
unchanged under K edits, so each line is indexed under (length, number, content) of its segments, and looked
up with those of its own substrings that can match a segment of a line up to K shorter. What meets under a
key is first compared by counts of a few letters, then verified with a banded bit-parallel edit distance.
Only keys, hashes and counts are shuffled; texts are fetched for the lines that met. All of it is DataFrame
functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import broadcast_if_small
from longspark.session import materialize, release

#: Edits within which two lines count as the same.
EDITS = 2
#: Shorter lines are left alone.
MIN_CHARS = 20
#: Letters whose counts are compared before any text is; the two most frequent ones, the slowest to count, are
#: left out.
_LETTERS = "aoinshrdlcmgbkfp"
#: Characters of the blocks in which a common beginning is left out.
_SAME = 16


def _key(line: Column, length: Column, number: Column, shift: Column, edits: int) -> Column:
    """The key of segment ``number`` (from 1) of a line of ``length``, read in ``line`` at its place plus ``shift``.

    The last segments, as many as the division leaves, are one character longer.
    """
    base = F.call_function("div", length, F.lit(edits + 1)).cast("int")
    plain = edits + 1 - (length - base * (edits + 1))  # segments that are not longer
    at = base * (number - 1) + F.greatest(F.lit(0), number - 1 - plain)
    size = base + (number > plain).cast("int")
    return F.xxhash64(number, length, F.substring(line, at + shift + 1, size))


def shifts(number: int, shorter: int, edits: int) -> range:
    """Where a segment of a line ``shorter`` by so many can stand: what lies left and right of it has to
    get along with the edits that earlier and later segments leave."""
    left, right = number - 1, edits + 1 - number
    return range(max(-left, shorter - right), min(left, shorter + right) + 1)


def _letter_bits(rests: list[Column]) -> Column:
    """Counts of the letters modulo 16, four bits for each, from a line and what is left of it after each letter."""
    bits = [
        F.shiftleft((F.octet_length(x) - F.octet_length(y)).bitwiseAND(15).cast("long"), 4 * i)
        for i, (x, y) in enumerate(zip(rests, rests[1:]))
    ]
    return reduce(lambda x, y: x.bitwiseOR(y), bits)


def _letter_counts(line: Column) -> Column:
    """The counts as one expression."""
    rests = [line]
    for c in _LETTERS:
        rests.append(F.replace(rests[-1], F.lit(c), F.lit("")))
    return _letter_bits(rests)


def _with_letters(rows: DataFrame) -> DataFrame:
    """Add ``letters``, the counts of ``line``: a column for each rest, so that each search goes over a shorter one, once."""
    rests, out = [F.col("line")], rows
    for i, c in enumerate(_LETTERS):
        out = out.withColumn(f"_rest{i}", F.replace(rests[-1], F.lit(c), F.lit("")))
        rests.append(F.col(f"_rest{i}"))
    return out.select(*rows.columns, _letter_bits(rests).alias("letters"))


def _counts_differ(a: Column, b: Column) -> Column:
    """A lower bound of twice the edits: one edit moves two counts by one at most."""

    def differ(i: int) -> Column:
        count = lambda x: F.shiftrightunsigned(x, 4 * i).bitwiseAND(15)
        d = (count(a) - count(b)).bitwiseAND(15)
        return F.least(d, 16 - d)

    return reduce(lambda x, y: x + y, [differ(i) for i in range(len(_LETTERS))])


def edit_distance(longer: Column, shorter: Column, edits: int) -> Column:
    """Edit distance of two strings whose lengths differ by ``edits`` at most; exact up to ``edits``,
    above it some larger number.

    The band of 2 * edits + 1 diagonals moves one row with every character; its vertical differences are
    bits of two numbers. Along the diagonal of the last cell the distance grows where the diagonal
    difference is not zero; once it is over ``edits`` the rest is passed over. What both begin with is left
    out beforehand, in blocks.
    """
    width = 2 * edits + 1
    mask = (1 << width) - 1

    def step(chars: Column, column: Column):
        def go(acc: Column, c: Column) -> Column:
            bits = [
                F.when(F.coalesce(F.get(chars, acc["j"] - edits + t) == c, F.lit(False)), 1 << t).otherwise(0)
                for t in range(width)
            ]
            x = reduce(lambda a, b: a + b, bits)
            vp, vn = acc["vp"], acc["vn"]

            def with_x(s: Column) -> Column:
                x = s["x"]
                zero = ((x.bitwiseAND(vp) + vp).bitwiseXOR(vp)).bitwiseOR(x).bitwiseOR(vn).bitwiseAND(mask)
                return _let(F.struct(zero.alias("d0")), with_zero)

            def with_zero(s: Column) -> Column:
                d0 = s["d0"]
                plus = vn.bitwiseOR(F.bitwise_not(d0.bitwiseOR(vp))).bitwiseAND(mask)
                minus = d0.bitwiseAND(vp)
                below = F.shiftright(d0, 1)
                grows = 1 - F.call_function("shiftright", d0, acc["on"]).bitwiseAND(1)
                return F.struct(
                    (acc["j"] + 1).alias("j"),
                    minus.bitwiseOR(F.bitwise_not(below.bitwiseOR(plus)).bitwiseAND(mask)).alias("vp"),
                    below.bitwiseAND(plus).alias("vn"),
                    acc["on"].alias("on"),
                    (acc["far"] + grows).alias("far"),
                )

            return F.when(acc["far"] > edits, acc).otherwise(_let(F.struct(x.alias("x")), with_x))

        gap = F.length(longer) - F.length(shorter)
        start = F.struct(
            F.lit(0).alias("j"),
            F.lit(mask ^ ((1 << edits) - 1)).alias("vp"),
            F.lit(0).alias("vn"),
            (gap + edits).alias("on"),
            gap.alias("far"),
        )
        return F.aggregate(column, start, go, lambda acc: acc["far"])

    def rest(both: Column) -> Column:
        a, b = both["a"], both["b"]
        blocks = F.sequence(F.lit(0), F.floor(F.length(b) / _SAME).cast("int"))
        same = F.aggregate(
            blocks,
            F.lit(0),
            lambda n, i: F.when(
                (n == i * _SAME) & (n + _SAME <= F.length(b)) & (F.substring(a, n + 1, F.lit(_SAME)) == F.substring(b, n + 1, F.lit(_SAME))),
                n + _SAME,
            ).otherwise(n),
        )
        return _let(same, lambda n: F.struct(F.substring(a, n + 1, F.length(a)).alias("a"), F.substring(b, n + 1, F.length(b)).alias("b")))

    def measured(tails: Column) -> Column:
        letters = F.struct(F.split(tails["a"], "").alias("a"), F.split(tails["b"], "").alias("b"))
        return _let(letters, lambda s: step(s["a"], F.filter(s["b"], lambda c: c != "")))

    return _let(F.struct(longer.alias("a"), shorter.alias("b")), lambda both: _let(rest(both), measured))


def _let(value: Column, use) -> Column:
    return F.element_at(F.transform(F.array(value), use), 1)


def _lines(docs: DataFrame, id_: str, text: str) -> DataFrame:
    """A row per line that counts: its place, and two hashes of it."""
    rows = docs.where(F.col(text).isNotNull()).select(
        F.struct(F.col(id_).alias("id"), F.xxhash64(text).alias("hash")).alias("doc"),
        F.posexplode(F.split(F.col(text), "\n", -1)).alias("no", "line"),
    )
    rows = rows.where(F.length("line") >= MIN_CHARS)
    return rows.select("doc", "no", "line", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(1), "line").alias("h2"))


def near_pairs(lines: DataFrame, edits: int = EDITS, apart: bool = False) -> DataFrame:
    """Pairs (a, b) of hashes of different lines that share a segment and nearly share letter counts, written.

    ``lines`` holds each line once: (h, line), and ``letters`` where they have been counted. ``apart``: one segment at a time,
    which reads the lines again for each and holds the shuffle files of one only.
    """
    counted = lines if "letters" in lines.columns else _with_letters(lines)
    rows = counted.select("h", "line", F.length("line").alias("len"), "letters")

    def keyed(which: list[tuple[int, int, int]], names: tuple[str, str]) -> DataFrame:
        # a row per key to compute, so that the generated code stays small enough to be compiled
        wanted = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(d).alias("d"), F.lit(s).alias("s")) for i, d, s in which])
        each = rows.select("*", F.explode(wanted).alias("w")).where(F.col("len") - F.col("w.d") >= MIN_CHARS)
        key = _key(F.col("line"), F.col("len") - F.col("w.d"), F.col("w.i"), F.col("w.s"), edits)
        return each.select(key.alias("key"), F.col("h").alias(names[0]), F.col("letters").alias(names[1]))

    found = []
    # keys of different segments never meet
    every = range(1, edits + 2)
    for numbers in [[i] for i in every] if apart else [every]:
        own = [(i, 0, 0) for i in numbers]
        others = [(i, d, s) for d in range(edits + 1) for i in numbers for s in shifts(i, d, edits)]
        met = keyed(own, ("a", "la")).join(keyed(others, ("b", "lb")), "key")
        met = met.where((F.col("a") != F.col("b")) & (_counts_differ(F.col("la"), F.col("lb")) <= 2 * edits))
        found.append(materialize(met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()))
    pairs = materialize(reduce(DataFrame.union, found).distinct())
    release(*found)
    return pairs


def verified(pairs: DataFrame, texts: DataFrame, edits: int = EDITS) -> DataFrame:
    """The pairs within ``edits``: (h_a, h2_a, first_a, h_b, h2_b, first_b)."""
    left = texts.select(*[F.col(c).alias(f"{c}_a") for c in texts.columns])
    right = texts.select(*[F.col(c).alias(f"{c}_b") for c in texts.columns])
    both = pairs.join(left, F.col("a") == F.col("h_a")).join(right, F.col("b") == F.col("h_b"))
    swap = F.length("line_a") < F.length("line_b")
    longer = F.when(swap, F.col("line_b")).otherwise(F.col("line_a"))
    shorter = F.when(swap, F.col("line_a")).otherwise(F.col("line_b"))
    both = both.withColumn("longer", longer).withColumn("shorter", shorter)
    both = both.where(F.length("longer") - F.length("shorter") <= edits)
    return both.where(edit_distance(F.col("longer"), F.col("shorter"), edits) <= edits)


def removals(docs: DataFrame, id_: str = "doc_id", text: str = "text", edits: int = EDITS, apart: bool = False) -> DataFrame:
    """Line numbers to remove: (doc, exact, near), for documents that lose any.

    ``doc`` is (id, hash of the text). A line goes as ``exact`` if an equal line stands earlier, in the order
    of id, text hash and line number; all copies of a line go as ``near`` if the first copy of a line within
    ``edits`` of it stands earlier than its own first copy.
    """
    lines = _lines(docs, id_, text)
    place = F.struct("doc", "no")
    first = lines.groupBy("h", "h2").agg(F.min(place).alias("first"), F.count("*").alias("n"))
    again = materialize(first.where("n > 1").select("h", "h2", "first"))
    lines = lines.join(broadcast_if_small(again), ["h", "h2"], "left")
    once = lines.where(F.col("first").isNull() | (F.col("first") == place))
    # split, hashed and counted once: the keys of both sides and the texts start from the written lines
    once = materialize(_with_letters(once.select("h", "h2", "line", place.alias("at"))))
    pairs = near_pairs(once, edits, apart)
    met = materialize(pairs.select(F.col("a").alias("h")).union(pairs.select("b")).distinct())
    texts = once.join(broadcast_if_small(met), "h", "left_semi")
    texts = materialize(texts.select("h", "h2", "line", "at"))
    release(once, met)
    close = materialize(verified(pairs, texts, edits).select("h_a", "h2_a", "at_a", "h_b", "h2_b", "at_b"))
    release(pairs, texts)
    late = close.where("at_a < at_b").select(F.col("h_b").alias("h"), F.col("h2_b").alias("h2"))
    late = materialize(late.union(close.where("at_b < at_a").select("h_a", "h2_a")).distinct().withColumn("near", F.lit(True)))
    release(close)
    marked = lines.join(broadcast_if_small(late), ["h", "h2"], "left")
    marked = marked.where(F.col("near") | (F.col("first") != place))
    return marked.groupBy("doc").agg(
        F.collect_set(F.when(F.col("near").isNull(), F.col("no"))).alias("exact"),
        F.collect_set(F.when(F.col("near"), F.col("no"))).alias("near"),
    )


def dedup_lines(docs: DataFrame, id_: str = "doc_id", text: str = "text", edits: int = EDITS, apart: bool = False) -> DataFrame:
    """Each document row, its text without repeated and nearly repeated lines, with ``n_lines``, ``n_exact`` and
    ``n_near`` (lines removed).

    Lines end at a line feed; lines under ``MIN_CHARS`` characters always stay. Null texts stay null, rows that
    are equal lose the same lines, other columns stay; columns of the given names are replaced. ``apart``: see ``near_pairs``.
    """
    gone = materialize(removals(docs, id_, text, edits, apart))
    gone = gone.select(*[F.col(c).alias(f"_gone_{c}") for c in gone.columns])
    docs = docs.drop("n_lines", "n_exact", "n_near")
    rows = docs.withColumn("_doc", F.struct(F.col(id_).alias("id"), F.xxhash64(text).alias("hash")))
    # null-safe: an id of null is a key like any other
    rows = rows.join(broadcast_if_small(gone, 200_000), F.col("_doc").eqNullSafe(F.col("_gone_doc")), "left")
    lines = F.split(F.col(text), "\n", -1)
    kept = F.filter(lines, lambda line, i: ~F.array_contains(F.concat("_gone_exact", "_gone_near"), i))
    lost = F.col("_gone_doc").isNotNull()
    return rows.select(
        *[F.when(lost, F.array_join(kept, "\n")).otherwise(F.col(c)).alias(c) if c == text else F.col(c) for c in docs.columns],
        F.when(F.col(text).isNull(), 0).otherwise(F.size(lines)).cast("long").alias("n_lines"),
        F.when(lost, F.size("_gone_exact")).otherwise(0).cast("long").alias("n_exact"),
        F.when(lost, F.size("_gone_near")).otherwise(0).cast("long").alias("n_near"),
    )
