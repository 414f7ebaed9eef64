"""Benchmark decontamination: windows of benchmark words found in training documents.

The benchmark's windows are hashed into one set that travels with the plan; every document scans its own
token windows against that set inside the scan stage, and only windows that hit are compared word by
word. Nothing but the keys of the documents is shuffled. All of it is DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import ascii_lower, broadcast_if_small
from longspark.session import materialize

WINDOW = 13
#: A document is contaminated from one hit word in so many words on.
SHARE = 20
#: Up to so many windows the set of hashes is a literal of the plan (8 bytes each); beyond it the windows
#: of the documents are joined with the benchmark's by a shuffle.
LITERAL_WINDOWS = 200_000

_SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def tokens(text: Column) -> Column:
    """Runs of digits, letters and non-ASCII characters, A-Z in lower case; null has none."""
    words = F.split(ascii_lower(F.coalesce(text, F.lit(""))), _SEPARATORS)
    return F.filter(words, lambda w: w != "")


def benchmark_windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", size: int = WINDOW) -> DataFrame:
    """The distinct windows of each item: (item, words, len, hash). A short item is one window."""
    words = benchmark.select(F.col(item).alias("item"), tokens(F.col(text)).alias("w")).where(F.size("w") > 0)
    width = F.least(F.size("w"), F.lit(size))
    starts = F.sequence(F.lit(1), F.size("w") - width + 1)
    rows = words.select("item", "w", width.alias("len"), F.explode(starts).alias("at"))
    rows = rows.select("item", F.slice("w", F.col("at"), F.col("len")).alias("words"), "len")
    return rows.distinct().withColumn("hash", F.xxhash64("words"))


def _positions(words: Column, n: int, hashes: list[int], ends: list[tuple[str, str]]) -> Column:
    """First positions of the windows of ``n`` words whose hash is in the set.

    The outer words are looked up first: most windows need no hash.
    """
    first, last = sorted({a for a, _ in ends}), sorted({b for _, b in ends})

    def hit(i: Column) -> Column:
        return (
            words[i - 1].isin(first)
            & words[i + (n - 2)].isin(last)
            & F.xxhash64(F.slice(words, i, n)).isin(hashes)
        )

    none = F.array().cast("array<int>")
    return F.when(F.size(words) >= n, F.filter(F.sequence(F.lit(1), F.size(words) - (n - 1)), hit)).otherwise(none)


def _row_key(docs: DataFrame) -> Column:
    """Tells rows apart; equal rows share it, and their results too."""
    return F.struct(F.xxhash64(*docs.columns), F.xxhash64(F.lit(1), *docs.columns))


def _candidates(words: str, windows: DataFrame) -> Column:
    """The windows of a document that may be the benchmark's: an array of (at, len, words)."""
    none = F.array().cast("array<int>")
    if windows.limit(LITERAL_WINDOWS + 1).count() <= LITERAL_WINDOWS:
        known = windows.select("len", "hash", F.col("words")[0], F.element_at("words", -1)).distinct().collect()
        by_len: dict[int, list] = {}
        for n, h, a, b in known:
            by_len.setdefault(n, []).append((h, a, b))
        starts = {
            n: _positions(F.col(words), n, sorted({h for h, _, _ in rows}), [(a, b) for _, a, b in rows])
            for n, rows in sorted(by_len.items())
        }
    else:
        sizes = sorted(r[0] for r in windows.select("len").distinct().collect())
        starts = {
            n: F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - (n - 1))).otherwise(none) for n in sizes
        }
    empty = F.array().cast("array<struct<at:int,len:int,words:array<string>>>")
    return reduce(F.concat, [_picked(words, n, at) for n, at in starts.items()], empty)


def _picked(words: str, n: int, starts: Column) -> Column:
    return F.transform(
        starts,
        lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), F.slice(words, i, F.lit(n)).alias("words")),
    )


def find_hits(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", item: str = "item_id", size: int = WINDOW
) -> DataFrame:
    """Each document row without its text, with ``n_words``, ``spans`` (verified windows: at, len; from
    1), ``items`` (ids of the items, sorted as strings), ``n_hit`` (words inside any window) and ``row_key``.

    Null and empty texts have no words and no hits; an empty benchmark hits nothing. Equal rows stay as
    many rows as they were. Other columns are kept, columns of the given names are replaced.
    """
    windows = materialize(benchmark_windows(benchmark, item, size=size))
    kept = [c for c in docs.columns if c not in (text, "n_words", "spans", "items", "n_hit", "row_key")]
    scanned = docs.withColumn("row_key", _row_key(docs)).withColumn("_w", tokens(F.col(text)))
    scanned = scanned.select(
        *kept, "row_key", F.size("_w").cast("long").alias("n_words"), _candidates("_w", windows).alias("_windows")
    )
    scanned = materialize(scanned)
    rows = scanned.where(F.size("_windows") > 0).select("row_key", F.explode("_windows").alias("s"))
    rows = rows.select("row_key", "s.at", "s.len", "s.words")
    # the hash is the key of the join, the words decide
    hits = rows.withColumn("hash", F.xxhash64("words")).join(windows, ["hash", "len", "words"])
    hits = hits.groupBy("row_key").agg(
        F.array_sort(F.collect_set(F.struct("at", "len"))).alias("spans"),
        F.array_sort(F.collect_set(F.col("item").cast("string"))).alias("items"),
    )
    out = scanned.drop("_windows").join(hits, "row_key", "left")
    return out.select(
        *kept,
        "n_words",
        F.coalesce("spans", F.array().cast("array<struct<at:int,len:int>>")).alias("spans"),
        F.coalesce("items", F.array().cast("array<string>")).alias("items"),
        F.coalesce(F.when(F.col("spans").isNotNull(), F.size(F.array_distinct(_words_of("spans")))), F.lit(0))
        .cast("long")
        .alias("n_hit"),
        "row_key",
    )


def _words_of(spans: str) -> Column:
    return F.flatten(F.transform(spans, lambda s: F.sequence(s["at"], s["at"] + s["len"] - 1)))


def contaminated(n_hit: Column, n_words: Column) -> Column:
    return (n_hit > 0) & (SHARE * n_hit >= n_words)


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text: str = "text") -> DataFrame:
    """``docs`` without contaminated documents, or with the hit words of all documents cut out.

    ``remove="documents"`` drops the documents whose share of hit words reaches the limit and leaves all
    others as they are. ``remove="spans"`` cuts the hit words out of every text and joins what stays with
    single spaces, in lower case; documents without hits are not touched.
    """
    found = find_hits(docs, benchmark, text)
    keyed = docs.withColumn("_key", _row_key(docs))
    if remove == "documents":
        bad = found.where(contaminated(F.col("n_hit"), F.col("n_words")))
        bad = materialize(bad.select(F.col("row_key").alias("_key")).distinct())
        return keyed.join(broadcast_if_small(bad), "_key", "left_anti").select(docs.columns)
    if remove != "spans":
        raise ValueError(f"remove is 'documents' or 'spans', not {remove!r}")
    cuts = found.where("n_hit > 0").select(F.col("row_key").alias("_key"), _words_of("spans").alias("_hit")).distinct()
    numbered = F.transform(tokens(F.col(text)), lambda w, i: F.struct(w.alias("w"), (i + 1).alias("i")))
    rest = F.filter(numbered, lambda x: ~F.array_contains("_hit", x["i"]))
    cut = F.concat_ws(" ", F.transform(rest, lambda x: x["w"]))
    joined = keyed.join(broadcast_if_small(materialize(cuts), 50_000), "_key", "left")
    return joined.withColumn(text, F.when(F.col("_hit").isNotNull(), cut).otherwise(F.col(text))).select(docs.columns)
