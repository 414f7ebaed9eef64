"""Byte-level BPE as a finite-state transducer, and streaming decoding.

A token sequence is the BPE encoding of its bytes exactly if every token encodes to itself and every two
neighbours do: merges inside tokens never look across a boundary that no merge crosses. The encoder is
therefore a transducer over bytes whose threads are (place in the token trie, last token before it);
a thread may end a token only if that token may follow the last one. Its subset construction is done
lazily: a state is the set of live threads with the tokens they have not yet agreed on, a token is emitted
as soon as all live threads share it, and the transitions met first are kept. Since every prefix has one
encoding, exactly one thread stands at a token boundary after each byte, and the lookahead is bounded by
the threads' tokens. When as many transitions are known as are kept, a piece that needs another one is run
on from there with its threads; results do not change.
"""

from __future__ import annotations

import base64
import codecs
import re
from array import array
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longspark.llm.common import small_batches, worker_cache

#: Kept at most, per Python worker: transitions, pairs and merge traces of the transducer, and twice so many
#: encodings of chunks.
MAX_TRANSITIONS = 120_000
MAX_PAIRS = 200_000
MAX_TRACES = 25_000
MAX_CHUNKS = 90_000
#: Chunks of more characters are not kept.
LONG_CHUNK = 40

_NEVER = 1 << 40
#: Rows handed back at once.
_ROWS = 500


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks of a file with a base64 token and its rank on each line."""
    return {base64.b64decode(t): int(r) for t, r in (line.split() for line in data.splitlines() if line)}


class Transducer:
    """Encodes pieces; see the module's text.

    A state is a tuple of threads (trie node, last token). Since one thread stands at a boundary after each
    byte, the transition need only name its token: where all threads agree, at the latest at the end of the
    piece, the tokens up to there are read off backwards.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.tokens = {r: t for t, r in ranks.items()}
        self.size = {r: len(t) for t, r in ranks.items()}
        child: dict[int, int] = {}  # node << 8 | byte -> node
        token = [-1]
        for text, rank in ranks.items():
            node = 0
            for b in text:
                key = node << 8 | b
                node = child.get(key, -1)
                if node < 0:
                    node = child[key] = len(token)
                    token.append(-1)
            token[node] = rank
        self.child, self.token = child, token
        self.inner = bytearray(len(token))
        for key in child:
            self.inner[key >> 8] = 1
        self.follows: dict[int, bool] = {}
        self.traces: dict[int, tuple | None] = {}
        self.states = [((0, -1),)]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, tuple[int, int]] = {}

    def _state(self, threads: tuple) -> int:
        known = self.number.get(threads)
        if known is None:
            known = self.number[threads] = len(self.states)
            self.states.append(threads)
        return known

    def _trace(self, token: int, end: int) -> tuple | None:
        """The merges of a token in their order: a rank, then what stands at its left (0) or right (-1) end.

        Starts with the byte at that end. None if the token does not encode to itself.
        """
        key = token << 1 | (end == 0)
        if key not in self.traces:
            text = self.tokens[token]
            parts = [text[i : i + 1] for i in range(len(text))]
            steps = [_NEVER, parts[end]]
            pairs = [self.ranks.get(a + b, _NEVER) for a, b in zip(parts, parts[1:])]
            while pairs and (best := min(pairs)) != _NEVER:
                at = pairs.index(best)
                parts[at : at + 2] = [parts[at] + parts[at + 1]]
                del pairs[at]
                if at:
                    pairs[at - 1] = self.ranks.get(parts[at - 1] + parts[at], _NEVER)
                if at < len(pairs):
                    pairs[at] = self.ranks.get(parts[at] + parts[at + 1], _NEVER)
                steps += (best, parts[end])
            if len(self.traces) > MAX_TRACES:
                self.traces.clear()
            self.traces[key] = tuple(steps) if len(parts) == 1 else None
        return self.traces[key]

    def may_follow(self, left: int, right: int) -> bool:
        """The two tokens stay as they are when merged together; ``left`` is -1 at the start of a piece."""
        key = left << 32 | right
        known = self.follows.get(key)
        if known is None:
            if len(self.follows) > MAX_PAIRS:
                self.follows.clear()
            if left >= 0 and self.tokens[left] + self.tokens[right] in self.ranks:
                known = False
            else:
                b = self._trace(right, 0)
                known = b is not None and (left < 0 or self._stay_apart(self._trace(left, -1), b))
            self.follows[key] = known
        return known

    def _stay_apart(self, a: tuple, b: tuple) -> bool:
        """Side by side, both run through their own merges: no merge across comes first at any time."""
        rank = self.ranks.get
        i, j, n, m = 2, 2, len(a), len(b)
        while True:
            across = rank(a[i - 1] + b[j - 1], _NEVER)
            next_a = a[i] if i < n else _NEVER
            next_b = b[j] if j < m else _NEVER
            if across < next_a and across <= next_b:
                return False
            if next_a == next_b == _NEVER:
                return True
            if next_a <= next_b:
                i += 2
            else:
                j += 2

    def _step(self, threads: list | tuple, byte: int) -> tuple[list, int]:
        """The threads after a byte, the one at a boundary last, and the token that ends there."""
        out, boundary = [], -1
        child, token, inner, follows = self.child.get, self.token, self.inner, self.follows.get
        for node, last in threads:
            node = child(node << 8 | byte)
            if node is None:
                continue
            t = token[node]
            if t >= 0 and boundary < 0:
                fits = follows(last << 32 | t)
                if fits or (fits is None and self.may_follow(last, t)):
                    boundary = t
            if inner[node]:
                out.append((node, last))
        out.append((0, boundary))
        return out, boundary

    def _move(self, state: int, byte: int) -> tuple[int, int]:
        """The transition, which is kept: the next state and the token that ends."""
        out, boundary = self._step(self.states[state], byte)
        threads = tuple(out)
        known = self.number.get(threads)
        if known is None:
            known = self.number[threads] = len(self.states)
            self.states.append(threads)
        move = self.moves[state << 8 | byte] = (known, boundary)
        return move

    def encode(self, piece: bytes) -> list[int]:
        """The ids of one piece."""
        state, ends, moves = 0, [], self.moves
        for at, byte in enumerate(piece):
            move = moves.get(state << 8 | byte)
            if move is None:
                if len(moves) >= MAX_TRANSITIONS:
                    return self._run_on(self.states[state], piece, at, ends)
                move = self._move(state, byte)
            state, token = move
            ends.append(token)
        return self._read_off(ends)

    def _run_on(self, threads: tuple | list, piece: bytes, at: int, ends: list[int]) -> list[int]:
        """The ids of a piece whose first ``at`` bytes have been run; long ones are read off on the way."""
        out, step = [], self._step
        for byte in piece[at:]:
            threads, token = step(threads, byte)
            ends.append(token)
            if len(ends) > 4096 and len(threads) == 1:  # all agree
                out += self._read_off(ends)
                ends = []
        return out + self._read_off(ends)

    def _read_off(self, ends: list[int]) -> list[int]:
        """The tokens of an agreed stretch, from the token that ends at each of its bytes."""
        tokens, at = [], len(ends) - 1
        while at >= 0:
            tokens.append(ends[at])
            at -= self.size[ends[at]]
        return tokens[::-1]


class _Recent(dict):
    """Results by text, computed when first asked for; those asked for lately are kept."""

    def __init__(self, compute):
        super().__init__()
        self.compute, self.older = compute, {}

    def __missing__(self, text: str):
        result = self.older.get(text)
        if result is None:
            result = self.compute(text)
            if len(text) > LONG_CHUNK:
                return result
        if len(self) >= MAX_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[text] = result
        return result


class Encoder:
    """Encodes texts: pieces by the pattern, each piece by the transducer.

    The pattern is one of the usual kind: letters with a space before them are a piece, so are punctuation
    marks, and a piece starts at every space that a non-space follows. Texts are cut into chunks there.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.transducer = Transducer(ranks)
        self.find = regex.compile(pattern).findall
        self.unsafe = re.compile(r" (?=\s|\Z)").search
        self.split = re.compile(r" (?=\S)").split
        self.mark = {m: self._piece(m) for m in ".,;:!?"}
        self.chunk = _Recent(self._chunk)

    def _piece(self, piece: str) -> bytes:
        return array("I", self.transducer.encode(piece.encode())).tobytes()

    def pieces(self, text: str) -> bytes:
        return b"".join(map(self._piece, self.find(text)))

    def _chunk(self, chunk: str) -> bytes:
        """A chunk with the space before it; letters, and letters with a mark, are no work for the pattern."""
        if chunk.isalpha():
            return self._piece(" " + chunk)
        mark = self.mark.get(chunk[-1:])
        if mark is not None and chunk[:-1].isalpha():
            return self.chunk[chunk[:-1]] + mark
        return self.pieces(" " + chunk)

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        chunks = self.split(text) if self.unsafe(text) else text.split(" ")
        return self.pieces(chunks[0]) + b"".join(map(self.chunk.__getitem__, chunks[1:]))


class Decoder:
    """Ids back to text, a block at a time; a code point may be cut by the end of a block.

    The incremental UTF-8 state machine holds its first bytes until the rest comes; bytes that are no
    UTF-8 become U+FFFD.
    """

    BLOCK = 4096

    def __init__(self, ranks: dict[bytes, int]):
        self.token = {r: t for t, r in ranks.items()}.__getitem__

    def decode(self, packed: bytes) -> str:
        ids = memoryview(packed).cast("I")
        machine = codecs.getincrementaldecoder("utf-8")(errors="replace")
        blocks = range(0, len(ids), self.BLOCK)
        text = [machine.decode(b"".join(map(self.token, ids[i : i + self.BLOCK]))) for i in blocks]
        return "".join([*text, machine.decode(b"", final=True)])


def _rank_data(df: DataFrame, rank_file: str):
    small_batches(df.sparkSession)
    with open(rank_file, "rb") as f:  # a vocabulary of bounded size, installed beside the driver
        return df.sparkSession.sparkContext.broadcast(f.read())


def encode(docs: DataFrame, rank_file: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Add ``ids``: the encoding of every whole text, packed as little-endian unsigned 32-bit integers.

    Each match of ``pattern`` is encoded separately, without special tokens. Null and empty texts have
    no ids (an empty binary). Other columns and repeated rows stay as they are.
    """
    data = _rank_data(docs, rank_file)

    @F.pandas_udf("binary")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        encoder = worker_cache(f"encoder {rank_file} {pattern}", lambda: Encoder(read_ranks(data.value), pattern))
        for texts in batches:
            for at in range(0, len(texts), _ROWS):
                yield pd.Series([encoder.encode(t) for t in texts[at : at + _ROWS]], dtype=object)

    return docs.withColumn(ids, run(F.coalesce(F.col(text), F.lit(""))))


def decode(df: DataFrame, rank_file: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Add ``text``: packed ids turned back into text; null and empty ids give an empty text."""
    data = _rank_data(df, rank_file)

    # an iterator function is never evaluated within another: the ids are computed once
    @F.pandas_udf("string")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        decoder = worker_cache(f"decoder {rank_file}", lambda: Decoder(read_ranks(data.value)))
        for packed in batches:
            for at in range(0, len(packed), _ROWS):
                yield pd.Series([decoder.decode(p) if p is not None else "" for p in packed[at : at + _ROWS]], dtype=object)

    return df.withColumn(text, run(F.col(ids)))


def n_tokens(ids: Column) -> Column:
    return (F.octet_length(ids) / 4).cast("long")
