"""Registered queries of the corpus operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from longspark.llm import (
    bpe,
    codes,
    decontaminate,
    licenses,
    line_dedup,
    mixing,
    ngram_join,
    pii,
    quality,
    token_output,
    url_filters,
    warc,
    whitening,
)
from longspark.llm.common import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


_OP1 = r"""
WITH RECURSIVE tags AS (
  SELECT url, unnest(regexp_extract_all(regexp_replace(html, '(?is)<!--.*?-->|<script\b.*?</script>', '', 'g'),
    '(?i)<(?:link|meta)\s[^>]*>')) AS tag
  FROM pages WHERE contains(url, '://') AND regexp_matches(html, '(?i)canonical|http-equiv')
), targets AS (
  SELECT url, replace(CASE
    WHEN regexp_matches(tag, '(?i)\srel\s*=\s*["'']?canonical\b') THEN regexp_extract(tag, '(?i)\shref\s*=\s*["'']?([^"''\s>]+)', 1)
    WHEN regexp_matches(tag, '(?i)\shttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(tag, '(?i)url\s*=\s*["'']?([^"''\s>]+)', 1)
    END, '&amp;', '&') AS target FROM tags
), links AS (
  SELECT regexp_replace(url, '#.*$', '') AS a, regexp_replace(target, '#.*$', '') AS b FROM targets WHERE contains(target, '://')
), both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links
), reach AS (
  SELECT a AS start, a AS node FROM both_ways UNION SELECT reach.start, both_ways.b FROM reach JOIN both_ways ON reach.node = both_ways.a
), rules(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')
), urls AS (
  SELECT DISTINCT u FROM (SELECT url AS u FROM pages UNION ALL SELECT node FROM reach)
), parts AS (
  SELECT u, lower(regexp_extract(coalesce(u, ''), '(?s)^.*?://([^/?#]*)', 1)) AS host,
    regexp_extract(coalesce(u, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM urls
), fits AS (
  SELECT u, host, path, h || p AS rule, v, row_number() OVER (PARTITION BY u ORDER BY length(h || p) DESC) AS k
  FROM parts LEFT JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p)
), own AS (SELECT * FROM fits WHERE k = 1
), aliases AS (
  SELECT start, bool_or(coalesce(v = 'allow', false)) AS allowed, bool_or(coalesce(v = 'block', false)) AS blocked
  FROM reach JOIN own ON own.u = reach.node GROUP BY start
)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN allowed THEN 'allow' WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM pages JOIN own ON own.u IS NOT DISTINCT FROM pages.url LEFT JOIN aliases ON aliases.start = regexp_replace(pages.url, '#.*$', '')
"""


@_query("op1_redirect_equivalence", _OP1)
def op1(spark: SparkSession, sf: str) -> DataFrame:
    return url_filters.judge(table(spark, sf, "pages")).drop("url")


def _vocabulary() -> tuple[str, str]:
    """Place and pattern of the tokenizer that the queries use."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


@_query("op2_byte_level_bpe")
def op2(spark: SparkSession, sf: str) -> DataFrame:
    ranks, pattern = _vocabulary()
    docs = table(spark, sf, "documents").select("doc_id", "text")
    encoded = bpe.encode(docs, ranks, pattern).drop("text")
    return bpe.decode(encoded, ranks).select(
        "doc_id",
        bpe.n_tokens(F.col("ids")).alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


_OP4 = r"""
WITH docs AS (
  SELECT doc_id, text AS t, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents
), positions AS (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM docs
), windows AS (
  SELECT doc_id, i, CASE WHEN i + 2 <= len(w) THEN array_to_string(w[i:i + 2], ' ') END AS three,
    CASE WHEN i + 9 <= len(w) THEN md5(array_to_string(w[i:i + 9], ' ')) END AS ten,
    CASE WHEN i + 100 <= len(w) THEN md5(array_to_string(w[i:i + 100], ' ')) END AS long FROM positions
), counted AS (
  SELECT doc_id, i, three IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, three) > 1 AS r3,
    ten IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, ten) > 1 AS r10,
    long IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, long) > 1 AS r101 FROM windows
), spans AS (
  SELECT doc_id, bool_or(r3) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS c3,
    bool_or(r10) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS c10, r101 FROM counted
), sums AS (
  SELECT doc_id, count(*) FILTER (WHERE c3) AS n3, count(*) FILTER (WHERE c10) AS n10, bool_or(r101) AS too_long FROM spans GROUP BY 1
), lines AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS dups FROM (SELECT doc_id, unnest(string_split(coalesce(t, ''), chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY 1
), base AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')), 0)::BIGINT AS word_chars,
    coalesce(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')), 0)::BIGINT AS n_symbols, coalesce(dups, 0)::BIGINT AS n_dup_lines,
    coalesce(n3, 0)::BIGINT AS n_repeat_words, coalesce(n10, 0)::BIGINT AS n_covered, coalesce(too_long, false) AS too_long
  FROM docs LEFT JOIN sums USING (doc_id) LEFT JOIN lines USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_covered,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND 100 * n_covered <= 30 * n_words AND NOT too_long AS kept
FROM base
"""


@_query("op4_suffix_array_repetition", _OP4)
def op4(spark: SparkSession, sf: str) -> DataFrame:
    return quality.measure(table(spark, sf, "documents").select("doc_id", "text")).drop("text", "longest_repeat")


_OP6 = r"""
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents
), bench AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark
), starts AS (
  SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, len(w) - least(len(w), 13) + 2)) AS i FROM bench WHERE len(w) > 0
), windows AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM starts
), positions AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, (SELECT DISTINCT n FROM windows) WHERE len(w) >= n)
), hits AS (SELECT doc_id, i, positions.n, item_id FROM positions JOIN windows USING (n, win)
), covered AS (
  SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1
), items AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS joined
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY 1
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(joined, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM docs LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


@_query("op6_benchmark_decontamination", _OP6)
def op6(spark: SparkSession, sf: str) -> DataFrame:
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    found = decontaminate.find_hits(docs.select("doc_id", "text"), bench)
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        decontaminate.contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


@_query("op5_ngram_jaccard_join")
def op5(spark: SparkSession, sf: str) -> DataFrame:
    return ngram_join.components(table(spark, sf, "documents").select("doc_id", "text"))


@_query("op10_pii_boosted_trees")
def op10(spark: SparkSession, sf: str) -> DataFrame:
    found = pii.find_spans(table(spark, sf, "documents").select("doc_id", "text"))
    count = [F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{n}") for k, n in enumerate(pii.KINDS)]
    kinds = F.array(*[F.lit(k) for k in (*pii.KINDS, "other")])
    more = F.transform("added", lambda s: F.struct(s["start"].alias("start"), F.lit(len(pii.KINDS)).alias("kind"), s["end"].alias("end")))

    def joined(spans):
        each = F.transform(spans, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"].cast("string"), s["end"].cast("string")))
        return F.array_join(each, ",")

    spans = F.array_sort(F.concat("base", more))
    return found.select("doc_id", *count, F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(spans).alias("spans"))


@_query("op8_segment_edit_join")
def op8(spark: SparkSession, sf: str) -> DataFrame:
    found = line_dedup.dedup_lines(table(spark, sf, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_lines", "n_exact", "n_near", F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256"))


@_query("op9_warc_index_merge")
def op9(spark: SparkSession, sf: str) -> DataFrame:
    # the pages have no capture time: one a second, in the order of their ids
    index = warc.archive(table(spark, sf, "pages"), ts=F.lit(1_700_000_000) + F.coalesce("page_id", F.lit(0)))
    return warc.read_archives(index).drop("payload", "url")


ORACLES["op9_warc_index_merge"] = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS payload_digest FROM p
), g AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS top FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM g
"""


@_query("op3_training_order")
def op3(spark: SparkSession, sf: str) -> DataFrame:
    # byte-level ids: the UTF-8 bytes; 0xFF and 0xFE never occur in them
    docs = table(spark, sf, "documents").select("doc_id", "text")
    manifest, count = token_output.materialise(docs, F.col("text").cast("binary"))
    found = token_output.read_shards(manifest, count)
    return found.select("slot", "sequence", F.sha2("ids", 256).alias("ids_sha256"))


def _op7_sql() -> str:
    known = ", ".join(f"('{k}', '{v}')" for k, v in licenses.SENTENCES.items())
    steps, left, names = [], "ids", []
    for i, (name, pattern) in enumerate(licenses.RULES):
        names.append(f"CASE WHEN regexp_matches(l{i}, '{pattern}') THEN '{name}' END")
        steps.append(f"r{i + 1} AS (SELECT *, regexp_replace(l{i}, '{pattern}', '.', 'g') AS l{i + 1} FROM r{i})")
    return f"""
WITH known(id, sentence) AS (VALUES {known}
), docs AS (
  SELECT doc_id, coalesce(text, '') AS t, regexp_matches(coalesce(text, ''), '(?i)licen[sc]e|redistribut|permission is hereby|rights reserved') AS hint
  FROM documents
), sources AS (
  SELECT doc_id, 1 AS kind, t FROM docs WHERE hint
  UNION ALL SELECT doc_id, 2, replace(replace(replace(t, chr(10) || chr(10), chr(1)), chr(10), ' '), chr(1), chr(10) || chr(10)) FROM docs WHERE hint
), cut AS (
  SELECT doc_id, kind, unnest(string_split_regex(regexp_replace(t, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r]+')) AS s,
    generate_subscripts(string_split_regex(regexp_replace(t, '([.!?;:])\\s+', '\\1' || chr(10), 'g'), '[\\n\\r]+'), 1) AS i FROM sources
), hits AS (
  SELECT doc_id, kind, string_agg(id, '' ORDER BY i) AS ids
  FROM cut JOIN known ON sentence = trim(regexp_replace(lower(s), '[^a-z0-9]+', ' ', 'g')) GROUP BY ALL
), best AS (SELECT doc_id, arg_max(ids, 2 * length(ids) - kind) AS ids FROM hits GROUP BY 1
), r0 AS (SELECT doc_id, coalesce(ids, '') AS ids, coalesce(ids, '') AS l0 FROM docs LEFT JOIN best USING (doc_id)
), {", ".join(steps)}
SELECT doc_id, ids AS sentence_ids, array_to_string(list_filter(list_distinct_in_order, lambda x: x IS NOT NULL), ',') AS licenses
FROM (SELECT *, [{", ".join(names)}] AS list_distinct_in_order FROM r{len(licenses.RULES)})
"""


@_query("op7_sentence_rules", _op7_sql())
def op7(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents").select("doc_id", "text")).drop("text")


_OP11 = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    ('0x' || substr(md5('mix|' || coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS key FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, ([3, 1, 2])[(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
  FROM d GROUP BY source
), levels(round, gone, rest, n) AS (
  SELECT 0, 0::DOUBLE, (SELECT sum(w) FROM s), 0::BIGINT
  UNION ALL
  SELECT round + 1, sum(CASE WHEN above THEN 2.0::DOUBLE * source_size ELSE 0 END), sum(CASE WHEN above THEN 0 ELSE w END), count(*) FILTER (above)
  FROM (SELECT *, w * ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - gone) / rest > 2 * source_size AS above FROM levels, s)
  GROUP BY round, n HAVING count(*) FILTER (above) > n
), t AS (
  SELECT source, source_size, least(w * ((SELECT sum(source_size) FROM s) * 1.5::DOUBLE - gone) / rest, 2.0::DOUBLE * source_size) AS target
  FROM s, (SELECT * FROM levels ORDER BY round DESC LIMIT 1)
), p AS (
  SELECT d.*, source_size, target, floor(target + 0.5)::BIGINT AS budget, (sum(size) OVER (PARTITION BY d.source ORDER BY key, doc_id, size ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS start
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target, CASE WHEN source_size = 0 THEN 0::BIGINT ELSE
  size * (budget // source_size) + greatest(least(size, budget % source_size - start), 0) END AS taken FROM p
"""


@_query("op11_source_mix", _OP11)
def op11(spark: SparkSession, sf: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf, "documents"), (3, 1, 2), share=150, epochs=2)
    return mixed.select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


@_query("op12_embedding_whitening")
def op12(spark: SparkSession, sf: str) -> DataFrame:
    found = whitening.whiten(table(spark, sf, "embeddings").select("vec_id", "embedding"))
    return found.select("vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error")


def _op13_sql() -> str:
    steps = ["b0 AS (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, v FROM cut WHERE vec_id IN (SELECT vec_id FROM first))"]
    for r in range(5):
        away = "list_sum(list_transform(range(1, 17), lambda i: (parts.v[i] - b.v[i]) * (parts.v[i] - b.v[i])))::BIGINT"
        steps.append(f"""a{r} AS MATERIALIZED (
  SELECT p, v, min(away * 256 + e)::BIGINT AS best FROM (SELECT parts.p, parts.v, b.e, {away} AS away FROM parts JOIN b{r} AS b ON parts.p = b.p) GROUP BY p, v)""")
        if r < 4:
            steps.append(f"""m{r} AS (
  SELECT p, e, list(c ORDER BY i) AS v FROM (
    SELECT p, best % 256 AS e, i, floor(sum(v[i] * n)::DOUBLE / sum(n))::BIGINT AS c FROM a{r} JOIN parts USING (p, v), range(1, 17) AS t(i) GROUP BY ALL) GROUP BY p, e
), b{r + 1} AS MATERIALIZED (SELECT b{r}.p, b{r}.e, coalesce(m{r}.v, b{r}.v) AS v FROM b{r} LEFT JOIN m{r} ON b{r}.p = m{r}.p AND b{r}.e = m{r}.e)""")
    return f"""
WITH kept AS (
  SELECT vec_id, label, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), first AS (SELECT vec_id FROM kept ORDER BY vec_id LIMIT 256
), cut AS MATERIALIZED (SELECT vec_id, p, v[16 * p + 1:16 * p + 16] AS v FROM kept, range(4) AS t(p)
), parts AS MATERIALIZED (SELECT p, v, count(*) AS n FROM cut GROUP BY p, v
), {", ".join(steps)}
, coded AS (
  SELECT vec_id, string_agg(printf('%02x', best % 256), '' ORDER BY p) AS code, sum(best // 256)::BIGINT AS error FROM cut JOIN a4 USING (p, v) GROUP BY vec_id
), digest AS (
  SELECT sha256(string_agg(c::VARCHAR, ',' ORDER BY p, e, i)) AS codebooks_sha256 FROM (SELECT p, e, unnest(v) AS c, generate_subscripts(v, 1) AS i FROM b4)
)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256
FROM kept JOIN coded USING (vec_id), digest
"""


@_query("op13_trie_codes", _op13_sql())
def op13(spark: SparkSession, sf: str) -> DataFrame:
    coded, books = codes.compress(table(spark, sf, "embeddings").select("vec_id", "label", "embedding"))
    summed = codes.with_total(coded, "label", F.col("error"), "label_error")
    return summed.select("vec_id", "code", "error", "label_error", F.lit(codes.books_digest(books)).alias("codebooks_sha256"))


@_query("pipeline")
def pipeline(spark: SparkSession, sf: str) -> DataFrame:
    return corpus_pipeline.run(spark, sf)


if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES["pipeline"] = corpus_pipeline.ORACLE_SQL
