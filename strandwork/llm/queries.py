"""The thin queries of the training-data operators, one for each, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..registry import Registry
from . import bpe, decontaminate, jaccard, langid, linededup, quality, secrets, substrings, tokencounts, urlfilter

REGISTRY = Registry()
#: File name of the rank file in the installed collection of public tokenizers.
VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@REGISTRY.query("op1_decontaminate")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents and the benchmark items whose passages they hold."""
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


@REGISTRY.query("op2_secret_scan")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document."""
    return secrets.scan(_table(spark, sf_dir, "documents"))


@REGISTRY.query("op3_quality_rules")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict on every document by its lines."""
    return quality.assess(_table(spark, sf_dir, "documents"))


@REGISTRY.query("op4_line_dedup", linededup.SQL)
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document that are kept elsewhere."""
    found = linededup.line_dedup(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@REGISTRY.query("op5_jaccard_join")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents with alike 5-word shingle sets."""
    return jaccard.jaccard_components(_table(spark, sf_dir, "documents"))


@REGISTRY.query("op6_substring_dedup")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Long passages that documents repeat, with their clusters."""
    return substrings.repeated_passages(_table(spark, sf_dir, "documents"))


@REGISTRY.query("op7_bpe")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the token ids of every document and of the bytes that they decode to."""
    return bpe.digest(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@REGISTRY.query("op8_token_counts")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document by line."""
    return tokencounts.count(_table(spark, sf_dir, "documents"), public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN)


@REGISTRY.query("op9_language_id")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predicted language of every document, and whether it is rejected."""
    docs = _table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


#: Of page_id, as the pages have neither fetch times nor lists: a page is fetched page_id mod 365 days and mod 24 hours
#: after the start of 2024; each host of the pages is listed by its least page_id m, from day m mod 97 on, as a whole
#: or (m mod 5 = 0 or 1) by its first one or two path steps, and (m mod 3 = 0) taken off the list 60 + m mod 101 days later.
def _captures(pages: DataFrame) -> DataFrame:
    at = F.expr("timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast(page_id % 365 AS int), cast(page_id % 24 AS int))")
    return pages.select("page_id", "url", at.alias("fetched_at"))


def _changes(pages: DataFrame) -> DataFrame:
    host = F.expr("lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1))")
    steps = F.expr("array_remove(split(lower(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)', 1)), '/'), '')")
    hosts = pages.select(host.alias("host"), steps.alias("steps"), "page_id").where("host <> ''").groupBy("host").agg(F.min(F.struct("page_id", "steps")).alias("x"))
    m = hosts.select("host", F.col("x.page_id").alias("m"), F.col("x.steps").alias("steps"))
    entry = F.expr("CASE WHEN m % 5 <= 1 AND size(steps) > 0 THEN concat(host, '/', concat_ws('/', slice(steps, 1, cast(m % 5 + 1 AS int)))) ELSE host END")
    day = "timestamp_ntz '2024-01-01 00:00:00' + make_interval(0, 0, 0, cast({} AS int))"
    category = F.expr("element_at(array('spam', 'malware', 'adult', 'piracy'), cast(m % 4 AS int) + 1)")
    add = m.select(entry.alias("entry"), category.alias("category"), F.lit("add").alias("action"), F.expr(day.format("m % 97")).alias("listed_at"))
    off = m.where("m % 3 = 0").select(entry.alias("entry"), category.alias("category"), F.lit("remove").alias("action"), F.expr(day.format("m % 97 + 60 + m % 101")).alias("listed_at"))
    return add.union(off)


OP10_SQL = r"""
WITH p AS (
  SELECT page_id, TIMESTAMP '2024-01-01' + to_days(CAST(page_id % 365 AS INT)) + to_hours(page_id % 24) AS fetched_at,
         lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host,
         list_filter(string_split(lower(regexp_extract(url, '^[^:]*://[^/?#]*(/[^?#]*)', 1)), '/'), x -> x <> '') AS steps FROM pages),
m AS (SELECT host, min(page_id) AS m, arg_min(steps, page_id) AS steps FROM p WHERE host <> '' GROUP BY host),
e AS (
  SELECT CASE WHEN m % 5 <= 1 AND len(steps) > 0 THEN host || '/' || array_to_string(list_slice(steps, 1, m % 5 + 1), '/') ELSE host END AS entry,
         ['spam', 'malware', 'adult', 'piracy'][CAST(m % 4 AS INT) + 1] AS category,
         TIMESTAMP '2024-01-01' + to_days(CAST(m % 97 AS INT)) AS valid_from,
         CASE WHEN m % 3 = 0 THEN TIMESTAMP '2024-01-01' + to_days(CAST(m % 97 + 60 + m % 101 AS INT)) END AS valid_until FROM m),
t AS (
  SELECT page_id, fetched_at, array_to_string(list_slice(string_split(host, '.'), i, 99), '.') AS entry
  FROM (SELECT page_id, fetched_at, host, unnest(range(1, len(string_split(host, '.')) + 1)) AS i FROM p WHERE host <> '')
  UNION SELECT page_id, fetched_at, host || '/' || array_to_string(list_slice(steps, 1, i), '/')
  FROM (SELECT page_id, fetched_at, host, steps, unnest(range(1, len(steps) + 1)) AS i FROM p WHERE host <> '')),
h AS (
  SELECT page_id, e.*, row_number() OVER (PARTITION BY page_id ORDER BY length(e.entry) DESC, e.entry DESC) AS k
  FROM t JOIN e ON t.entry = e.entry AND fetched_at >= valid_from AND (valid_until IS NULL OR fetched_at < valid_until))
SELECT p.page_id, h.entry IS NOT NULL AS blocked, h.entry, h.category, h.valid_from AS listed_from
FROM p LEFT JOIN h ON p.page_id = h.page_id AND h.k = 1
"""


@REGISTRY.query("op10_url_filter", OP10_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages whose URLs were listed when they were fetched."""
    pages = _table(spark, sf_dir, "pages")
    return urlfilter.filter_urls(_captures(pages), _changes(pages))
