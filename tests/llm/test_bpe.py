import random

import public_tokenizers
import pytest
import tiktoken

from longspark.llm import bpe

FILE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def parts():
    with open(FILE, "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return library, bpe.Encoder(ranks, public_tokenizers.PATTERN), bpe.Decoder(ranks)


def check(parts, text):
    library, encoder, decoder = parts
    packed = encoder.encode(text)
    assert list(memoryview(packed).cast("I")) == library.encode_ordinary(text)
    assert decoder.decode(packed) == text


def test_random_texts(parts):
    rng = random.Random(5)
    for alphabet in (" \n\tab'sdre1!\x1c é漢  ", "the of ing 12", "\U0001f600é́ x"):
        for _ in range(1500):
            check(parts, "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 16))))


def test_all_code_points(parts):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    for at in range(0, len(points), 4000):
        check(parts, "".join(f"a{c} {c}1 " for c in points[at : at + 4000]))


@pytest.mark.parametrize("text", ["", " ", "a" * 5000, "abcabd" * 700, "é" * 999, " " * 2000, "=-" * 900, "<|endoftext|>"])
def test_long_and_odd_pieces(parts, text):
    check(parts, text)


def test_small_memory(parts, monkeypatch):
    for name in ("MAX_TRANSITIONS", "MAX_PAIRS", "MAX_TRACES", "MAX_CHUNKS"):
        monkeypatch.setattr(bpe, name, 20)
    library, encoder, decoder = parts
    small = bpe.Encoder(encoder.transducer.ranks, public_tokenizers.PATTERN)
    rng = random.Random(6)
    for n in (30, 300, 3000):
        check((library, small, decoder), "".join(rng.choice("theofing  xq") for _ in range(n)))


def test_broken_utf8_and_cut_code_points(parts, monkeypatch):
    _, encoder, decoder = parts
    monkeypatch.setattr(bpe.Decoder, "BLOCK", 1)
    ranks = encoder.transducer.ranks
    ids = [ranks[bytes([b])] for b in "é漢".encode()]
    pack = lambda ids: b"".join(i.to_bytes(4, "little") for i in ids)
    assert decoder.decode(pack(ids)) == "é漢"
    assert decoder.decode(pack(ids[:1])) == "�"


def test_frames(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Été at 12", "z"), (3, "Été at 12", "z")]
    docs = spark.createDataFrame(rows, "id long, text string, decoded_ string")
    out = bpe.decode(bpe.encode(docs, FILE, public_tokenizers.PATTERN), FILE)
    got = [(r.id, r.decoded) for r in out.orderBy("id").collect()]
    assert got == [(1, ""), (2, ""), (3, "Été at 12"), (3, "Été at 12")]
    assert out.columns == ["id", "text", "decoded_", "ids", "decoded"]
    assert bpe.encode(docs.limit(0), FILE, public_tokenizers.PATTERN).count() == 0
