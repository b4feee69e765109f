"""Queries of this subpackage's operators over the whole tables, with SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import collocations, embeddings, html, mixing, packing, pii, quality, resampling, sharding, simhash, tok, tokenbin, urls, warc
from tessera.llm.common import read

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query("op1_simhash")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read(spark, sf_dir, "documents"))


@query("op2_sharding")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(read(spark, sf_dir, "documents"), n_shards=24, vnodes=64, epsilon=0.0)


@query(
    "op3_warc",
    """
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS d FROM pages),
f AS (SELECT d, min(page_id) AS first FROM p WHERE n >= 100 GROUP BY d)
SELECT page_id, n::BIGINT AS payload_bytes, p.d AS payload_digest,
       CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM p LEFT JOIN f ON p.d = f.d AND n >= 100
""",
)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read(spark, sf_dir, "pages"))


@query("op4_token_shards")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenbin.round_trip(read(spark, sf_dir, "documents"), tok.default_tokenizer(), end_id=2)


@query("op5_pii")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.find(read(spark, sf_dir, "documents"))


_OP6 = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS w,
             list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines FROM t),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS g
      FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
h AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
r AS (SELECT doc_id, count(*) AS n_repeat_words FROM
      (SELECT DISTINCT doc_id, i + k AS p FROM h, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1) GROUP BY doc_id),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines)::BIGINT AS n_lines,
             length(regexp_replace(text, '[^!]', '', 'g'))::BIGINT AS n_bangs,
             coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
      FROM w LEFT JOIN r ON w.doc_id = r.doc_id),
b AS (SELECT *, n_words < 50 AS b0, 100 * n_repeat_words > 50 * n_words AS b1, 5 * n_symbols > n_words AS b2,
             2 * n_bangs > n_words AS b3, word_chars < 2 * n_words AS b4, word_chars > 15 * n_words AS b5,
             n_lines >= 4 AND 2 * n_dup_lines > n_lines AS b6 FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, b0 OR b1 AS base_failed,
       NOT (b0 OR b1 OR b2 OR b3 OR b4 OR b5 OR b6) AS kept,
       (b0::INT + 2 * b1::INT + 4 * b2::INT + 8 * b3::INT + 16 * b4::INT + 32 * b5::INT + 64 * b6::INT)::BIGINT AS failed_mask
FROM b
"""


@query("op6_quality_rules", _OP6)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality.apply_policy(quality.ledger(read(spark, sf_dir, "documents")), "v2")
    base = F.col("failed_mask").bitwiseAND(F.lit(quality.BASE_MASK)) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"), "kept", "failed_mask")


@query(
    "op7_embedding_near_duplicates",
    """
WITH RECURSIVE v AS (SELECT vec_id, embedding::DOUBLE[] AS e, label FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
l AS (SELECT a.vec_id AS u, b.vec_id AS w FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id, vec_id AS other FROM embeddings UNION SELECT r.vec_id, l.w FROM r JOIN l ON r.other = l.u),
c AS (SELECT vec_id, min(other) AS component_id FROM r GROUP BY vec_id),
n AS (SELECT u, count(*) AS n_links FROM l GROUP BY u)
SELECT c.vec_id, coalesce(n_links, 0) AS n_links, component_id, c.vec_id = component_id AS kept FROM c LEFT JOIN n ON c.vec_id = n.u
""",
)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(read(spark, sf_dir, "embeddings"), threshold=0.93)


@query("op8_html_extraction")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(read(spark, sf_dir, "pages"))


#: Equal shares of the 20 sources, and languages as a multilingual corpus would want them.
TARGETS = mixing.Targets(source={f"src{i}": 1 / 20 for i in range(20)}, lang={"en": 0.5, "de": 0.2, "fr": 0.2, "es": 0.1}, topics=8, temper=0.75, keep=0.5)


@query("op9_source_mixing")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(read(spark, sf_dir, "documents"), TARGETS)


@query("op10_best_fit_packing")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), tok.default_tokenizer(), capacity=2048, end_id=0)


_OP11 = r"""
WITH t AS (SELECT list_transform(range(256), lambda i: list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
d AS (SELECT doc_id, true AS own, text FROM documents UNION ALL SELECT NULL, false, text FROM benchmark),
w AS (SELECT doc_id, own, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM d),
f AS (SELECT doc_id, own, w, count(*) AS n FROM w GROUP BY ALL),
e AS (SELECT w, hex(encode(w)) AS h FROM (SELECT DISTINCT w FROM f)),
b AS (SELECT w, xor(4294967295, list_reduce(list_concat([4294967295], list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, 2 * i + 1, 2))::BIGINT)),
        lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1]))) % 10000 AS b FROM e, t),
c AS (SELECT b, coalesce(sum(n) FILTER (own), 0) AS s, coalesce(sum(n) FILTER (NOT own), 0) AS t FROM f JOIN b USING (w) GROUP BY b),
a AS (SELECT coalesce(sum(s), 0) AS s, coalesce(sum(t), 0) AS t FROM c),
g AS (SELECT b, floor(1000 * ln((c.t + 1)::DOUBLE * (a.s + 10000)::DOUBLE / ((c.s + 1)::DOUBLE * (a.t + 10000)::DOUBLE)))::BIGINT AS g FROM c, a),
m AS (SELECT doc_id, sum(n)::BIGINT AS n_features, floor(sum(n * g)::DOUBLE / sum(n))::BIGINT AS weight FROM f JOIN b USING (w) JOIN g USING (b) WHERE own GROUP BY doc_id),
o AS (SELECT d.doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
        coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || substr(sha256('2024:' || d.doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
      FROM documents d LEFT JOIN m ON d.doc_id = m.doc_id),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM o WHERE n_features >= 20)
SELECT o.doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM o LEFT JOIN r ON o.doc_id = r.doc_id
"""


@query("op11_importance_resampling", _OP11)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), buckets=10_000, longest=1, seed=2024, at_least=20, percent=10)


_OP12 = r"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS p FROM documents),
w AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM p),
s AS (SELECT lang, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM w, (SELECT unnest([1, 2, 3, 4, 5]) AS m)),
f AS (SELECT lang, array_to_string(w[i : i + m - 1], ' ') AS phrase, m, count(*) AS a FROM s GROUP BY ALL HAVING count(*) >= 100),
n AS (SELECT lang, sum(len(w))::BIGINT AS n FROM w GROUP BY lang),
c AS (SELECT lang, phrase, m, a, string_split(phrase, ' ') AS w FROM f WHERE m > 1),
k AS (SELECT *, unnest(range(1, m)) AS k FROM c),
x AS (SELECT k.lang, k.phrase, k.m, k.a, k, l.a AS l, r.a AS r, n, 1000::HUGEINT * k.a * n // (l.a::HUGEINT * r.a) AS score
      FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.w[1 : k], ' ')
             JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.w[k + 1 : k.m], ' ') JOIN n ON n.lang = k.lang),
y AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS nth FROM x),
i AS (SELECT lang, array_to_string(w[i : i + j - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, m - j + 2)) AS i FROM (SELECT *, unnest(range(2, m)) AS j FROM c)) GROUP BY ALL),
z AS (SELECT y.lang, y.phrase, a, l, r, n, score FROM y LEFT JOIN i ON i.lang = y.lang AND i.phrase = y.phrase
      WHERE nth = 1 AND (longer IS NULL OR 100 * longer < 100 * a)),
o AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM z)
SELECT lang, rank, phrase, a, l, r, n, score::BIGINT AS score FROM o WHERE rank <= 2000
"""


@query("op12_collocations", _OP12)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.mine(read(spark, sf_dir, "documents"), min_count=100, longest=5, top=2000, inside=100)


URL_RULES = [urls.Rule("block", "net", "/"), urls.Rule("allow", "example.net", "/en/"), urls.Rule("block", "example.com", "/de/"), urls.Rule("allow", "org", "/fr/")]


@query(
    "op13_url_filter",
    r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
c AS (SELECT page_id, regexp_extract(rest, '^[^?#]*') AS rest FROM u),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '/(.|
|)*$') AS path FROM c),
r AS (SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) AS r(rule_host, rule_path, verdict)),
m AS (SELECT page_id, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS verdict
      FROM h JOIN r ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path) GROUP BY page_id)
SELECT h.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM h LEFT JOIN m ON h.page_id = m.page_id
""",
)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(read(spark, sf_dir, "pages"), URL_RULES, default="allow")
