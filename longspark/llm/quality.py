"""Quality rules: plain counts of a text, and its repetition from a suffix array of its words.

The suffix array of a document's words is built by prefix doubling; neighbouring suffixes give the longest
common prefixes, and the deepest common-prefix interval around a suffix is the longest repeat that starts
there. The spans of all repeats of ``MIN_REPEAT`` words or more are united; a document is kept if they
cover little of it and none is too long.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import small_batches, worker_cache

#: Words of a repeat that counts.
MIN_REPEAT = 10
#: Per cent of the words that such repeats may cover. Clearly under the 50 of the base rule, which counts all of these words
#: too: a sentence that happens to stand twice in a short text stays, a passage that makes up a third of it does not.
MAX_COVERED = 30
#: Words of the longest repeat that is let through: a paragraph that stands twice is refused in a text of any length.
MAX_LENGTH = 100
#: Base rules: fewest words, and per cent of words in repeated windows of three.
MIN_WORDS = 50
MAX_REPEAT_WORDS = 50

_SYMBOLS = "#*$%&|<>"
_SPACE = " \t\n\v\f\r"
_KNOWN_WORDS = 200_000


class _Numbers(dict):
    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def _ranks(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order of the keys, and each key's rank among the distinct ones."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    new = np.empty(len(keys), np.int64)
    new[0] = 0
    new[1:] = ordered[1:] != ordered[:-1]
    ranks = np.empty(len(keys), np.int64)
    ranks[order] = np.cumsum(new)
    return order, ranks


def triples(words: np.ndarray) -> np.ndarray:
    """The ranks of all windows of three words, padded at the end; equal windows have equal ranks."""
    n = int(words.max()) + 2
    a = np.concatenate([words + 1, np.zeros(2, np.int64)])
    if n >= 1 << 21:
        a = np.unique(a, return_inverse=True)[1].astype(np.int64)
        n = int(a.max()) + 1
    if n < 1 << 21:
        return _ranks((a[:-2] * n + a[1:-1]) * n + a[2:])[1]
    pairs = np.unique(a[:-2] * n + a[1:-1], return_inverse=True)[1].astype(np.int64)
    return _ranks(pairs * n + a[2:])[1]


def repeated_words(ranks: np.ndarray) -> int:
    """Words inside windows of three that occur twice or more; ``ranks`` of all windows."""
    k = len(ranks) - 2
    if k < 2:
        return 0
    twice = np.bincount(ranks[:k])[ranks[:k]] > 1
    hit = np.zeros(len(ranks), bool)
    for shift in range(3):
        hit[shift : shift + k] |= twice
    return int(hit.sum())


def suffix_repeats(words: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """For each place, the words of the longest repeat that starts there (0 if under three).

    ``ranks`` are those of the windows of three words.
    """
    n = len(words)
    levels, width = [ranks], 3
    order = None
    while int(levels[-1].max()) < n - 1:
        last = levels[-1]
        second = np.zeros(n, np.int64)
        second[: max(0, n - width)] = last[width:] + 1
        order, ranks = _ranks(last * (n + 1) + second)
        levels.append(ranks)
        width *= 2
    if order is None:
        order = np.argsort(ranks)
    left, right = order[:-1].copy(), order[1:].copy()
    common = np.zeros(n - 1, np.int64)
    for level in reversed(levels[:-1]):
        width //= 2
        level = np.concatenate([level, [-1]])  # behind the end: equal to nothing below
        a, b = np.minimum(left + common, n), np.minimum(right + common, n)
        same = (level[a] == level[b]) & (a < n) & (b < n)
        common += np.where(same, width, 0)
    padded = np.concatenate([words, [-1]])
    alive = common > 0
    for _ in range(2):
        a, b = np.minimum(left + common, n), np.minimum(right + common, n)
        alive &= (padded[a] == padded[b]) & (a < n) & (b < n)
        common += alive
    longest = np.zeros(n, np.int64)
    longest[order[:-1]] = common
    longest[order[1:]] = np.maximum(longest[order[1:]], common)
    return longest


def covered_words(longest: np.ndarray, least: int) -> int:
    """Words inside the union of the repeats of ``least`` words or more."""
    at = np.flatnonzero(longest >= least)
    if not len(at):
        return 0
    n = len(longest)
    open_ = np.bincount(at, minlength=n + 1) - np.bincount(at + longest[at], minlength=n + 1)
    return int((np.cumsum(open_)[:n] > 0).sum())


def text_counts(text: str, numbers: _Numbers) -> tuple[int, ...]:
    """The columns of ``measure`` for one text."""
    raw = text.encode().split()  # bytes split at space, tab, \\n, \\v, \\f, \\r
    symbols = sum(map(text.count, _SYMBOLS))
    chars = len(text) - sum(map(text.count, _SPACE))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    repeat_words = covered = longest = 0
    if len(raw) > 3:
        if len(numbers) > _KNOWN_WORDS:
            numbers.clear()
        words = np.fromiter(map(numbers.__getitem__, raw), np.int64, len(raw))
        ranks = triples(words)
        repeat_words = repeated_words(ranks)
        if repeat_words:
            repeats = suffix_repeats(words, ranks)
            covered, longest = covered_words(repeats, MIN_REPEAT), int(repeats.max())
    return len(raw), chars, symbols, len(lines) - len(set(lines)), repeat_words, covered, longest


_FIELDS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_covered long, longest_repeat long"


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add the counts of every whole text, ``base_failed`` and ``kept``.

    ``n_covered``: words in repeats of ``MIN_REPEAT`` words or more; ``longest_repeat``: words of the longest
    repeat of three words or more. Null and empty texts have zero counts and fail the base rules. Other
    columns and repeated rows stay; columns of the given names are replaced.
    """

    small_batches(docs.sparkSession)

    @F.pandas_udf(_FIELDS)
    def run(texts: pd.Series) -> pd.DataFrame:
        numbers = worker_cache("word numbers", _Numbers)
        rows = [text_counts(t, numbers) for t in texts]
        return pd.DataFrame(rows, columns=[f.split()[0] for f in _FIELDS.split(", ")], dtype="int64")

    names = [f.split()[0] for f in _FIELDS.split(", ")]
    docs = docs.drop(*names, "base_failed", "kept", "_counts")
    out = docs.withColumn("_counts", run(F.coalesce(F.col(text), F.lit(""))))
    out = out.select(*docs.columns, *[F.col(f"_counts.{n}").alias(n) for n in names])
    failed = base_failed(F.col("n_words"), F.col("n_repeat_words"))
    return out.withColumns({"base_failed": failed, "kept": ~failed & repeats_allowed()})


def base_failed(n_words: Column, n_repeat_words: Column) -> Column:
    return (n_words < MIN_WORDS) | (100 * n_repeat_words > MAX_REPEAT_WORDS * n_words)


def repeats_allowed() -> Column:
    return (100 * F.col("n_covered") <= MAX_COVERED * F.col("n_words")) & (F.col("longest_repeat") <= MAX_LENGTH)


def keep_good(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents that pass all rules, with their own columns."""
    return measure(docs, text).where("kept").select(docs.columns)
