"""The pipeline against plain code, stage by stage, on a small corpus with everything planted."""

import hashlib
import random
import re

import corpus_pipeline
import public_tokenizers
import tiktoken
from brute import deduped_lines, jaccard_components

from longspark.llm import bpe, quality
from longspark.llm.decontaminate import SHARE


def corpus():
    rng = random.Random(21)
    word = lambda: f"{rng.choice('abcdefgh')}{rng.randrange(10**5)}"
    line = lambda n: " ".join(word() for _ in range(n))
    bench = [(i, line(30)) for i in range(3)]
    footer = line(12)
    rows = []
    for i in range(40):
        rows.append((i, "\n".join([line(30), line(40), footer])))
    for i in range(40, 46):
        rows.append((i, rows[i - 40][1]))  # exact copies
    for i in range(46, 52):
        rows.append((i, rows[i - 46][1].replace(" ", "  ", 1).replace(footer, line(9))))
    near = line(120).split()
    for i in range(52, 56):  # copies that differ by a word, on one line
        near[rng.randrange(len(near))] = word()
        rows.append((i, " ".join(near)))
    for i in range(56, 60):
        rows.append((i, line(60) + "\n" + bench[i % 3][1]))  # contaminated
    rows += [(60, line(10)), (61, (line(12) + "\n") * 9), (62, None), (63, "")]
    return rows, bench


def test_pipeline(spark, tmp_path):
    rows, bench = corpus()
    full = [(d, t, "en", "s", len(t or "")) for d, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").coalesce(2).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}

    numbers = quality._Numbers()
    counts = {d: quality.text_counts(t or "", numbers) for d, t in rows}
    kept = [(d, t) for d, t in rows if (c := counts[d])[0] >= 50 and 2 * c[4] <= c[0] and 10 * c[5] <= 3 * c[0] and c[6] <= 100]
    lines = deduped_lines(kept)
    kept = [(d, lines[d][3]) for d, _ in kept if lines[d][3].strip() or lines[d][1] + lines[d][2] == 0]
    comp = jaccard_components(kept, 5, 80)
    kept = [(d, t) for d, t in kept if comp[d][1] == d]
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    windows = {tuple(w[i : i + 13]) for _, t in bench for w in [re.findall(pattern, t)] for i in range(len(w) - 12)}
    clean = []
    for d, t in kept:
        w = re.findall(pattern, t)
        hit = {p for i in range(len(w) - 12) if tuple(w[i : i + 13]) in windows for p in range(i, i + 13)}
        if not hit or SHARE * len(hit) < len(w):
            clean.append((d, t))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = {d: library.encode_ordinary(t) for d, t in clean}
    assert {d: list(memoryview(bytes(r.ids)).cast("I")) for d, r in got.items()} == want
    assert 36 <= len(want) < len(rows) - 15


def test_tokens_hold_one_python_worker_a_task(spark, tmp_path):
    rows = [(1, "Été at 12"), (2, None), (3, ""), (3, "twice  x"), (3, "twice  x"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    out = corpus_pipeline.tokens(spark, docs, str(tmp_path))
    assert out._jdf.queryExecution().executedPlan().toString().count("ArrowEvalPython") == 1
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = [(r.doc_id, list(memoryview(bytes(r.ids)).cast("I")), r.n_tokens, r.decoded_sha256) for r in out.collect()]
    ids = [(d, library.encode_ordinary(t or ""), hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows]
    assert sorted(got, key=str) == sorted([(d, i, len(i), h) for d, i, h in ids], key=str)
