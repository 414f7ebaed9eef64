"""Keyed state with timeouts: running histories, horizon labels and first copies, a row for each input row.

The state of a key holds what the watermark has not passed yet and a summary of what it has; a timeout at the
earliest waiting time hands rows on in order of event time, late ones within the delay at their place. A key that stays idle is
forgotten. State is checkpointed with the query, so a restart goes on where it stopped.

Keys are dealt by hash to ``GROUPS`` groups, whose states come and go with their rows: so many calls of Python at most in a batch,
not some for each key, value and timer. A batch passes over the state of all keys of the groups that it meets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from longspark.schema import MICROS_PER_DAY
from longspark.streaming.streams import TIME, run_to_table, with_time

#: Groups of keys.
GROUPS = 1 << 14
#: Rows handed back at once.
_ROWS = 10_000

_PROVIDER = "spark.sql.streaming.stateStore.providerClass"
_ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def keyed_state(spark: SparkSession):
    """State of many keys is kept in RocksDB, outside of the heap; the session's own setting comes back afterwards."""
    before = spark.conf.get(_PROVIDER, None)
    spark.conf.set(_PROVIDER, _ROCKS)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_PROVIDER)
        else:
            spark.conf.set(_PROVIDER, before)


def run_keyed(stream: DataFrame, path: str, checkpoint: str) -> None:
    """``run_to_table`` for the operators of this module."""
    with keyed_state(stream.sparkSession):
        run_to_table(stream, path, checkpoint)


def _due(us: int) -> int:
    """The first millisecond at which a watermark has passed ``us``."""
    return int(-(-int(us) // 1000))


def _whole(name: str) -> list[Column]:
    """A whole number that may be null, for pandas: with a column for that, or one null made doubles of a batch."""
    return [F.coalesce(F.col(name), F.lit(0)).cast("bigint").alias(name), F.col(name).isNull().alias(f"_no_{name}")]


def _read(pdf: pd.DataFrame, names: list[str]) -> list[tuple]:
    """Rows as tuples; null and NaN are None."""
    columns = []
    for n in names:
        values = pdf[n].tolist()
        if f"_no_{n}" in pdf:
            values = [None if no else v for v, no in zip(values, pdf[f"_no_{n}"].tolist())]
        columns.append([None if v is None or v != v else v for v in values])
    return list(zip(*columns))


def _per_key(rows: DataFrame, keys: list[str], names: list[str], step: Callable, schema: T.StructType, kept: str) -> DataFrame:
    """``step`` for the new rows of each key in a batch, and where its time has come.

    It gets (key, rows with ``names``, what is kept of the key, watermark) and returns the rows that go out, what is kept from now on
    (None: nothing) and the millisecond of the watermark at which it wants to be called again.
    """
    n, columns = len(keys), schema.names
    plain = [k for k in keys if not isinstance(rows.schema[k].dataType, T.StringType)]  # as text: pandas has its own ideas of them
    rows = rows.select(
        *[F.col(c).cast("string").alias(c) if c in plain else F.col(c) for c in rows.columns],
        F.pmod(F.xxhash64(*keys), F.lit(GROUPS)).cast("int").alias("_group"),
    )

    def run(group: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        mark = state.getCurrentWatermarkMs()
        held = {tuple(r[:n]): (r[n], r[n + 1]) for r in state.get[0]} if state.exists else {}
        new: dict[tuple, list] = {key: [] for key, (due, _) in held.items() if due <= mark}
        for pdf in frames:
            for r in _read(pdf, keys + names):
                new.setdefault(r[:n], []).append(r[n:])
        out = []
        for key, own in new.items():
            found, value, due = step(key, own, held.pop(key, (0, None))[1], mark)
            out += found
            if value is not None:
                held[key] = (due, value)
        if held:
            state.update(([(*key, *value) for key, value in held.items()],))
            # Spark calls once the watermark is over the timeout
            state.setTimeoutTimestamp(max(min(due for due, _ in held.values()) - 1, 1))
        elif state.exists:
            state.remove()
        for at in range(0, len(out), _ROWS):
            yield pd.DataFrame(out[at : at + _ROWS], columns=columns, dtype=object)

    written = T.StructType([T.StructField(f.name, T.StringType()) if f.name in plain else f for f in schema])
    fields = ",".join(f"k{i}:string" for i in range(n))
    state = f"held array<struct<{fields},due:bigint,kept:{kept}>>"
    out = rows.groupBy("_group").applyInPandasWithState(run, written, state, "append", GroupStateTimeout.EventTimeTimeout)
    return out.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


class _Waiting:
    """Rows of a key wait until the watermark has passed them; ``passed`` sees them in order.

    It gets and returns what is kept of a key besides (None: nothing), and the times at which it wants to be called again.
    """

    summary = ""

    def __init__(self, waiting: str, idle_ms: int):
        self.idle_ms = idle_ms
        self.names = [f.split(":")[0] for f in waiting.split(",")]
        self.kept = f"struct<waiting:array<struct<{waiting}>>,summary:{self.summary}>"

    def passed(self, key: tuple, ready: list, summary, mark: int) -> tuple[list, object, list[int]]:
        raise NotImplementedError

    def step(self, key: tuple, rows: list[tuple], kept, mark: int) -> tuple[list, object, int | None]:
        waiting, summary = kept or ([], None)
        ready, rest = [], []
        for r in [*map(tuple, waiting), *rows]:
            (ready if _due(r[0]) <= mark else rest).append(r)
        ready.sort(key=lambda r: (r[0], r[1]))
        out, summary, following = self.passed(key, ready, summary, mark)
        if not rest and summary is None:
            return out, None, None
        return out, (rest, summary), min([_due(r[0]) for r in rest] + following)


class _History(_Waiting):
    summary = "struct<last_value:double,last_us:bigint,n:bigint,first_us:bigint,seen_us:bigint>"

    def passed(self, key: tuple, ready: list, summary, mark: int) -> tuple[list, object, list[int]]:
        """A key whose last row is ``idle_ms`` behind the watermark starts anew."""
        value, at, n, first, seen = summary or (None, None, 0, None, None)
        out = []
        for us, seq, v in ready:
            first = us if first is None else first
            out.append((*key, us, seq, v, value, at, n, (us - first) / MICROS_PER_DAY, None if seen is None else (us - seen) / MICROS_PER_DAY))
            seen = us
            if v is not None:
                value, at, n = float(v), us, n + 1
        end = None if seen is None else _due(seen) + self.idle_ms
        if end is None or end <= mark:
            return out, None, []
        return out, (value, at, n, first, seen), [end]


def _fields(stream: DataFrame, keys: list[str]) -> list[T.StructField]:
    return [T.StructField(k, stream.schema[k].dataType) for k in keys]


def running_history(stream: DataFrame, keys: list[str], *, delay: str, idle_days: float = 3650.0) -> DataFrame:
    """For each row the last value, its time and the number of values strictly before it, and the days since the first and the last row.

    Rows come out once the watermark has passed them, ordered by (us, seq); late ones within ``delay`` take their place, later
    ones are dropped. Nulls and NaN are rows but no values. After ``idle_days`` without a row a key's history starts anew.
    """
    out = [("us", "bigint"), ("seq", "bigint"), ("value", "double"), ("last_value", "double"), ("last_us", "bigint"), ("n_before", "bigint")]
    out += [("elapsed_days", "double"), ("gap_days", "double")]
    schema = T.StructType(_fields(stream, keys) + [T.StructField(n, T.LongType() if k == "bigint" else T.DoubleType()) for n, k in out])
    timed = with_time(stream.select(*keys, "us", *_whole("seq"), F.col("value").cast("double").alias("value")), delay=delay)
    history = _History("us:bigint,seq:bigint,value:double", int(idle_days * MICROS_PER_DAY / 1000))
    return _per_key(timed, keys, history.names, history.step, schema, history.kept)


class _Horizon(_Waiting):
    """Steps and targets of a key; a step is labelled when its horizon has passed."""

    summary = "array<struct<us:bigint,seq:bigint,hit:bigint>>"

    def passed(self, key: tuple, ready: list, summary, mark: int) -> tuple[list, object, list[int]]:
        # in order of time, so each target only looks back on open steps
        steps = [list(r) for r in summary or []]
        for us, seq, is_target in ready:
            if is_target:
                for s in reversed(steps):
                    if s[0] + self.idle_ms * 1000 < us or s[2] and s[0] < us:
                        break
                    if s[0] < us:
                        s[2] = 1
            steps.append([us, seq, 0])
        # the step's own instant counts for none, and a step without a later target waits for its end
        done = [s for s in steps if _due(s[0] + self.idle_ms * 1000) <= mark]
        rest = [tuple(s) for s in steps if _due(s[0] + self.idle_ms * 1000) > mark]
        return [(*key, *s) for s in done], rest or None, [_due(s[0] + self.idle_ms * 1000) for s in rest]


def horizon_labels(stream: DataFrame, target: Column, *, days: float, delay: str, key: str = "patient_id") -> DataFrame:
    """One row for each row of the stream: whether a target row of its key follows in (us, us + days].

    A row comes out once the watermark has passed its whole horizon. A key's state is its rows of the last horizon; no row
    is paired with another one outside of it.
    """
    schema = T.StructType(_fields(stream, [key]) + [T.StructField(n, T.LongType()) for n in ("us", "seq", "horizon_label")])
    rows = stream.select(key, "us", *_whole("seq"), F.coalesce(target, F.lit(False)).cast("bigint").alias("is_target"))
    horizon = _Horizon("us:bigint,seq:bigint,is_target:bigint", int(days * MICROS_PER_DAY / 1000))
    return _per_key(with_time(rows, delay=delay), [key], horizon.names, horizon.step, schema, horizon.kept)


def _first_copy(key: tuple, copies: list[tuple], kept, mark: int, keep_ms: int) -> tuple[list, object, int | None]:
    known, due = kept or (None, None)
    out = []
    for us, digest in sorted(copies, key=lambda c: tuple((v is None, v or 0) for v in c)):
        if known is None:
            known, due = digest, _due(us) + keep_ms
            out.append((*key, int(us), digest, "first"))
        elif digest != known:
            out.append((*key, int(us), digest, "conflict"))
    return (out, (known, due), due) if due is not None and due > mark else (out, None, None)


def first_copies(stream: DataFrame, key: list[str], content: Column, *, arrived: str = "arrived", keep_days: float = 30.0, delay: str = "1 day") -> DataFrame:
    """(key, arrived_us, digest, status): the first copy of each key, and every later copy whose content differs from it.

    Equal copies give no row. Of copies in one batch the earliest is the first, with the lesser digest on a tie. The state of a key is one
    digest, kept for ``keep_days`` after the first copy's arrival.
    """
    schema = T.StructType(
        _fields(stream, key) + [T.StructField("arrived_us", T.LongType()), T.StructField("digest", T.StringType()), T.StructField("status", T.StringType())]
    )
    rows = stream.select(*key, F.col(arrived).alias(TIME), F.unix_micros(arrived).alias("arrived_us"), F.sha2(content, 256).alias("digest"))
    rows = rows.select(*key, TIME, *_whole("arrived_us"), "digest").withWatermark(TIME, delay)
    step = partial(_first_copy, keep_ms=int(keep_days * MICROS_PER_DAY / 1000))
    return _per_key(rows, key, ["arrived_us", "digest"], step, schema, "struct<digest:string,due:bigint>")
