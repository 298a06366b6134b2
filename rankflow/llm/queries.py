"""Queries of the training-data operators on the driver's tables, with SQL where it can check."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankflow.llm import (
    decontaminate,
    embeddings,
    filter_audit,
    language_model,
    licenses,
    merkle,
    neighbours,
    packing,
    pii,
    quality,
    simhash,
    tokens,
    url_filter,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def wrap(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return wrap


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_license_scan", licenses.scan_sql())
def license_scan(spark, sf_dir):
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


@query("op3_pii")
def find_personal_data(spark, sf_dir):
    return pii.pii_digest(table(spark, sf_dir, "documents"))


# The pages have no fetch dates and there is no list, so both follow from hashes of the
# URLs: every URL has a day of 2024, and a quarter of the hosts, domains and first path
# segments are listed, some of them taken off and listed again.
def _hash(column: str, start: int) -> str:
    return f"conv(substr(md5({column}), {start}, 4), 16, 10)"


def page_captures(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select(
        "page_id", "url",
        F.expr(f"date_add(DATE '2024-01-01', CAST({_hash('url', 1)} AS INT) % 366)").alias("fetched"))


def derived_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "pages").select(
        F.explode(url_filter.url_keys(F.col("url"))).alias("key")).distinct()
    h = keys.select("key", *[F.expr(f"CAST({_hash('key', 1 + 4 * i)} AS INT)").alias(f"h{i}")
                             for i in range(5)]).where("h0 % 4 = 0")
    first = F.col("h1") % 300
    gone = first + 20 + F.col("h2") % 60
    events = F.array(
        F.struct(F.lit("add").alias("action"), first.alias("d")),
        F.struct(F.when(F.col("h3") % 3 > 0, "remove").alias("action"), gone.alias("d")),
        F.struct(F.when(F.col("h3") % 3 > 1, "add").alias("action"), (gone + 30).alias("d")))
    return h.select("key", F.when(F.col("h4") % 5 == 0, "allow").otherwise("block").alias("list"),
                    F.explode(events).alias("_e")).where("_e.action IS NOT NULL").select(
        "key", "list", "_e.action", F.expr("date_add(DATE '2024-01-01', _e.d)").alias("day"))


_SQL_HASH = "('0x' || substr(md5({0}), {1}, 4))::INT"
_SQL_HOST = r"lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)(?::[0-9]*)?([^?#]*)', {0}))"
_SQL_URLS = f"""
WITH parts AS (
  SELECT page_id, url, DATE '2024-01-01' + {_SQL_HASH.format('url', 1)} % 366 AS fetched,
         {_SQL_HOST.format(1)} AS host, {_SQL_HOST.format(2)} AS path FROM pages),
keys AS (
  SELECT page_id, url, fetched, unnest(list_distinct(list_concat(
      list_transform(range(1, greatest(len(string_split(host, '.')) - 1, 1) + 1),
                     lambda i: array_to_string(string_split(host, '.')[i:], '.')),
      list_transform(range(1, len(list_filter(string_split(path, '/'), lambda p: p <> '')) + 1),
                     lambda i: host || '/' || array_to_string(
                       list_filter(string_split(path, '/'), lambda p: p <> '')[1:i], '/'))))) AS key
  FROM parts WHERE host <> ''),
listed AS (
  SELECT *, h1 % 300 AS d1, h1 % 300 + 20 + h2 % 60 AS d2 FROM (
    SELECT key, {', '.join(f"{_SQL_HASH.format('key', 1 + 4 * i)} AS h{i}" for i in range(5))}
    FROM (SELECT DISTINCT key FROM keys)) WHERE h0 % 4 = 0),
spans AS (
  SELECT key, CASE WHEN h4 % 5 = 0 THEN 'allow' ELSE 'block' END AS list, d1 AS since,
         CASE WHEN h3 % 3 > 0 THEN d2 ELSE 100000 END AS until FROM listed
  UNION ALL
  SELECT key, CASE WHEN h4 % 5 = 0 THEN 'allow' ELSE 'block' END, d2 + 30, 100000
  FROM listed WHERE h3 % 3 > 1),
met AS (
  SELECT page_id, url, fetched, count(DISTINCT key || ' ' || list) AS n_active,
         arg_max(list, (length(key), list = 'allow', key)) AS decision,
         arg_max(key, (length(key), list = 'allow', key)) AS rule
  FROM keys JOIN spans USING (key)
  WHERE fetched - DATE '2024-01-01' >= since AND fetched - DATE '2024-01-01' < until
  GROUP BY ALL)
SELECT page_id, url, fetched, coalesce(n_active, 0)::BIGINT AS n_active,
       coalesce(decision, 'none') AS decision, rule
FROM parts LEFT JOIN met USING (page_id, url, fetched)"""


@query("op5_url_filter", _SQL_URLS)
def url_decisions(spark, sf_dir):
    return url_filter.filter_urls(page_captures(spark, sf_dir), derived_entries(spark, sf_dir),
                                  "page_id", "url", "fetched")


@query("op6_simhash")
def simhash_groups(spark, sf_dir):
    return simhash.simhash_digest(table(spark, sf_dir, "documents"))


@query("op10_embedding_copies")
def embedding_copies(spark, sf_dir):
    return embeddings.near_vectors(table(spark, sf_dir, "embeddings"))


@query("op2_decontamination")
def contaminated_documents(spark, sf_dir):
    return decontaminate.mark_contaminated(table(spark, sf_dir, "documents"),
                                           table(spark, sf_dir, "benchmark"))


@query("op8_packing")
def packed_documents(spark, sf_dir):
    return packing.pack_documents(table(spark, sf_dir, "documents"),
                                  public_tokenizers.path("byte_bpe_50k.json"))


@query("op9_token_counts")
def token_counts(spark, sf_dir):
    return tokens.count_tokens(table(spark, sf_dir, "documents"),
                               public_tokenizers.path("piece_bpe_32k.model"))


@query("op4_quality")
def quality_scores(spark, sf_dir):
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op7_language_model")
def language_model_scores(spark, sf_dir):
    return language_model.score_documents(table(spark, sf_dir, "documents"))


@query("op11_filter_audit", filter_audit.audit_sql())
def filter_interactions(spark, sf_dir):
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op12_merkle_manifest", merkle.manifest_sql())
def merkle_manifest(spark, sf_dir):
    return merkle.manifest(table(spark, sf_dir, "documents"))


@query("op13_nearest_vectors")
def nearest_vectors(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 20 = 0"))
