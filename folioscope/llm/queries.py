"""The contract queries of this subpackage and their DuckDB counterparts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, fingerprint, lines, quality, simhash, substring, url_filter, warc

#: The public tokenizer's files; where they lie is a parameter.
RANKS = "byte_bpe_50k.tiktoken"

URL_RULES = [
    url_filter.site_rule("net/", "block"),
    url_filter.site_rule("example.net/en/", "allow"),
    url_filter.site_rule("example.com/de/", "block"),
    url_filter.site_rule("org/fr/", "allow"),
    url_filter.pattern_rule(r"(?s)\A[^/]*/(?:.*/)?casino(?:/|\Z)", "block", ["casino"]),
    url_filter.pattern_rule(r"(?s)\A(?:.*\.)?adserver\.[^/]*/", "block", ["adserver"]),
]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(table(spark, sf_dir, "pages"), URL_RULES)


OP1_SQL = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages)
), r AS (
  SELECT * FROM (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')) v(h, p, verdict)
), j AS (
  SELECT u.*, r.h || r.p AS rule, r.verdict AS v,
    row_number() OVER (PARTITION BY u.page_id, u.host, u.path ORDER BY length(r.h || r.p) DESC NULLS LAST, length(r.h) DESC, r.h || r.p) AS k
  FROM u LEFT JOIN r ON (u.host = r.h OR ends_with(u.host, '.' || r.h)) AND starts_with(u.path, r.p)
)
SELECT page_id, host, path, rule,
  coalesce(v, CASE WHEN regexp_matches(host || path, '^[^/]*/(.*/)?casino(/|$)') OR regexp_matches(host || path, '^(.*\.)?adserver\.[^/]*/') THEN 'block' ELSE 'allow' END) AS verdict,
  CASE WHEN v IS NOT NULL THEN NULL
       WHEN regexp_matches(host || path, '^[^/]*/(.*/)?casino(/|$)') THEN '(?s)\A[^/]*/(?:.*/)?casino(?:/|\Z)'
       WHEN regexp_matches(host || path, '^(.*\.)?adserver\.[^/]*/') THEN '(?s)\A(?:.*\.)?adserver\.[^/]*/' END AS pattern
FROM j WHERE k = 1
"""


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    archive = warc.write_archive(table(spark, sf_dir, "pages"), min_bytes=0)
    return warc.read_archive(archive).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "url", "intact")


OP3_SQL = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages
), d AS (
  SELECT page_id, url, CAST(octet_length(encode(html)) AS BIGINT) AS payload_bytes,
    list_aggregate(list_transform(range(0, 8), lambda g: list_aggregate(list_transform(range(0, 4), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(hex, CAST(g * 5 + 1 AS INT), 5) AS INT) >> CAST(15 - 5 * k AS INT)) & 31), 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest
  FROM p
), f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest, url, true AS intact,
  CASE WHEN page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to
FROM f
"""


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(table(spark, sf_dir, "documents"), window=13)


OP4_SQL = r"""
WITH d AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 12], ' ') AS k FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d)
), m AS (SELECT *, min(doc_id) OVER (PARTITION BY k) AS first FROM g),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p FROM m WHERE first < doc_id),
x AS (SELECT doc_id, list_sort(list(p)) AS gone FROM c GROUP BY doc_id),
k AS (
  SELECT d.doc_id, len(w) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda v, j: NOT list_contains(gone, j)) END AS kept
  FROM d LEFT JOIN x ON d.doc_id = x.doc_id
)
SELECT doc_id, n_words, n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k
"""


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprint.fingerprints(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = decontaminate.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return done.select("doc_id", F.col("_contaminated").alias("contaminated"), F.col("_items").alias("n_items"), F.col("_item_id").alias("item_id"), F.col("_share").alias("share"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality.fit(docs, table(spark, sf_dir, "labels"))
    scored = quality.classify(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), F.col("_score").alias("score"), F.col("_predicted").alias("predicted"))


#: Sites a line must stand on to be boilerplate.
LINE_SITES = 10


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = lines.dedup_lines(table(spark, sf_dir, "documents"), LINE_SITES)
    return done.select("doc_id", F.col("_lines").alias("n_lines"), F.col("_removed").alias("n_removed"), F.sha2("text", 256).alias("kept_sha256"))


OP8_SQL = r"""
WITH l AS (
  SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n FROM documents
), s AS (
  SELECT trim(line) AS t, count(DISTINCT source) AS sites FROM l WHERE trim(line) <> '' GROUP BY 1
), r AS (
  SELECT l.*, CASE WHEN sites >= 10 THEN row_number() OVER (PARTITION BY trim(line) ORDER BY doc_id, n) ELSE 1 END AS k
  FROM l LEFT JOIN s ON trim(l.line) = s.t
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (k > 1) AS n_removed,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (k = 1), '')) AS kept_sha256
FROM r GROUP BY doc_id
UNION ALL SELECT doc_id, 0, 0, NULL FROM documents WHERE text IS NULL
"""


def op9_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = chat.rotate(table(spark, sf_dir, "conversations"))
    spans = F.array_join(F.transform("mask", lambda m: F.concat_ws(":", m["start"].cast("string"), m["length"].cast("string"))), ",")
    return done.select("conv_id", "perspective", "n_turns", "n_trained", spans.alias("mask"), "text", "trained")


OP9_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS who, replace(coalesce(text, ''), '<|', '< |') || '<|im_end|>' || chr(10) AS body,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, 'unknown'), coalesce(text, '')) AS k
  FROM conversations
), p AS (SELECT DISTINCT conv_id, who AS perspective FROM t WHERE who <> 'system'),
r AS (
  SELECT p.conv_id, p.perspective, t.k, t.body, t.who = p.perspective AS own,
    '<|im_start|>' || CASE WHEN t.who = 'system' THEN t.who WHEN t.who = p.perspective THEN 'assistant'
      ELSE 'user name=' || replace(replace(replace(replace(replace(t.who, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), chr(10), '&#10;'), chr(13), '&#13;') END || chr(10) AS head
  FROM p JOIN t ON p.conv_id = t.conv_id
), o AS (
  SELECT *, coalesce(sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + length(head) AS begins FROM r
)
SELECT conv_id, perspective, count(*) AS n_turns,
  CAST(coalesce(sum(length(body)) FILTER (own), 0) AS BIGINT) AS n_trained,
  coalesce(string_agg(CAST(begins AS BIGINT) || ':' || length(body), ',' ORDER BY k) FILTER (own), '') AS mask,
  string_agg(head || body, '' ORDER BY k) AS text,
  coalesce(string_agg(body, '' ORDER BY k) FILTER (own), '') AS trained
FROM o GROUP BY conv_id, perspective
"""


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = simhash.near_duplicates(table(spark, sf_dir, "documents"), shingle=3, max_distance=2)
    return done.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def queries():
    return {
        "op1_url_filters": op1_url_filters,
        "op2_bpe": op2_bpe,
        "op3_warc": op3_warc,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_fingerprints": op5_fingerprints,
        "op6_decontamination": op6_decontamination,
        "op7_quality": op7_quality,
        "op8_line_dedup": op8_line_dedup,
        "op9_chat_formatting": op9_chat_formatting,
        "op10_simhash": op10_simhash,
    }


def oracle_sql():
    return {
        "op1_url_filters": OP1_SQL,
        "op3_warc": OP3_SQL,
        "op4_substring_dedup": OP4_SQL,
        "op8_line_dedup": OP8_SQL,
        "op9_chat_formatting": OP9_SQL,
    }
