"""Registered queries of the training-data operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, extraction, langid, mixing, quality_rules, sharding, simhash, toxicity, url_filter, vector_queries, weak_quality

#: Byte limits of a shard in the registered query: a 64th of all bytes, within these.
LEAST_SHARD, MOST_SHARD = 64 << 10, 128 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    total = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first()["b"]
    return sharding.assign_shards(docs, limit=min(MOST_SHARD, max(LEAST_SHARD, -(-total // 64)))).select(
        "doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("bytes"), "shard", "shard_bytes", "shard_documents"
    )


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return extraction.extract(pages, extraction.fit(pages))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_rules.fit(docs, table(spark, sf_dir, "labels"))
    return quality_rules.judge(docs, model).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Captures fetched on day page_id mod 365 of 2024, against two dated lists made of the corpus' own hosts."""
    own = table(spark, sf_dir, "pages").select("page_id", "url")
    captures = own.withColumn("fetched", F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(cast(coalesce(page_id, 0) % 365 as int))"))
    hosts = own.select(url_filter.host(F.col("url")).alias("host")).where("host is not null").distinct()
    code = F.conv(F.substring(F.md5(F.col("host").cast("binary")), 1, 6), 16, 10).cast("int")
    listed = hosts.withColumn("code", code).where("code % 4 = 0")
    day = "timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval({})"
    steps = [("add", "(code div 4) % 120"), ("remove", "(code div 4) % 120 + 60 + code % 90"), ("add", "(code div 4) % 120 + 200")]
    dated = F.array(*[F.struct(F.lit(a).alias("action"), F.expr(day.format(f"cast({d} as int)")).alias("at")) for a, d in steps])
    hosted = listed.select(F.lit("hosts").alias("list"), F.concat(F.lit("d:"), "host").alias("pattern"), F.explode(dated).alias("e")).select("list", "pattern", "e.*")
    parents = spark.sql(
        "select 'zones' as list, 'd:example.net' as pattern, action, at from values ('add', timestamp_ntz'2024-03-01 00:00:00'), ('remove', timestamp_ntz'2024-05-01 00:00:00') as t(action, at)"
    )
    return url_filter.evaluate(captures, hosted.union(parents))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = mixing.plan_mix(table(spark, sf_dir, "documents"))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_weak_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return weak_quality.score_documents(docs, weak_quality.fit(docs)[1])


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return langid.identify(docs, langid.fit(docs))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score_documents(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


OP1_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(strlen(text), 0) AS bytes,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT) AS h
  FROM documents
), cap AS (
  SELECT least({MOST_SHARD}, greatest({LEAST_SHARD}, (coalesce(sum(bytes), 0) + 63) // 64)) AS most FROM d
), node AS (
  SELECT 0 AS depth, CAST(0 AS BIGINT) AS prefix, sum(bytes) AS bytes, count(*) AS documents FROM d HAVING count(*) > 0
  UNION ALL
  SELECT n.depth + 1, d.h >> (60 - n.depth - 1), sum(d.bytes) , count(*)
  FROM node n JOIN d ON (d.h >> (60 - n.depth)) = n.prefix
  WHERE n.bytes > (SELECT most FROM cap) AND n.documents > 1 AND n.depth < 60
  GROUP BY n.depth, d.h >> (60 - n.depth - 1)
), leaf AS (SELECT * FROM node WHERE bytes <= (SELECT most FROM cap) OR documents = 1)
SELECT d.doc_id, d.bytes,
       CASE WHEN leaf.depth = 0 THEN '' ELSE lpad(bin(leaf.prefix), leaf.depth, '0') END AS shard,
       CAST(leaf.bytes AS BIGINT) AS shard_bytes, CAST(leaf.documents AS BIGINT) AS shard_documents
FROM d JOIN leaf ON (d.h >> (60 - leaf.depth)) = leaf.prefix
"""

OP5_SQL = r"""
WITH c AS (
  SELECT page_id, url, TIMESTAMP '2024-01-01' + to_days(CAST(coalesce(page_id, 0) % 365 AS INT)) AS fetched,
         nullif(lower(rtrim(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1), '.')), '') AS host
  FROM pages
), h AS (
  SELECT host, CAST('0x' || substr(md5(host), 1, 6) AS BIGINT) AS code FROM (SELECT DISTINCT host FROM c WHERE host IS NOT NULL)
), listed AS (SELECT host, code, (code // 4) % 120 AS d FROM h WHERE code % 4 = 0
), e AS (
  SELECT 'd:' || host AS pattern, 'add' AS action, d AS day FROM listed
  UNION ALL SELECT 'd:' || host, 'remove', d + 60 + code % 90 FROM listed
  UNION ALL SELECT 'd:' || host, 'add', d + 200 FROM listed
  UNION ALL SELECT 'd:example.net', 'add', 60 UNION ALL SELECT 'd:example.net', 'remove', 121
), v AS (
  SELECT pattern, action, TIMESTAMP '2024-01-01' + to_days(CAST(day AS INT)) AS valid_from,
         TIMESTAMP '2024-01-01' + to_days(CAST(lead(day) OVER (PARTITION BY pattern ORDER BY day, action) AS INT)) AS valid_to
  FROM e
), k AS (
  SELECT DISTINCT url, fetched, 'd:' || array_to_string(string_split(host, '.')[i:], '.') AS pattern
  FROM c, unnest(range(1, len(string_split(host, '.')) + 1)) AS t(i) WHERE host IS NOT NULL
), m AS (
  SELECT url, fetched, count(*) AS n, min(k.pattern) AS p FROM k JOIN v USING (pattern)
  WHERE action = 'add' AND valid_from <= fetched AND (valid_to IS NULL OR fetched < valid_to) GROUP BY ALL
)
SELECT page_id, c.url, c.fetched, coalesce(n, 0) AS n_active, p AS first_pattern, n IS NOT NULL AS blocked
FROM c LEFT JOIN m ON c.url = m.url AND c.fetched = m.fetched
"""

OP6_SQL = r"""
WITH d AS (
  SELECT doc_id, source, md5(text) AS digest, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS size FROM documents
), s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, CAST(2 * sum(size) AS BIGINT) AS cap FROM d GROUP BY source
), w AS (
  SELECT *, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS weight FROM s
), r AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(weight) OVER (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         (SELECT sum(source_size) FROM s) * CAST(1.5 AS DOUBLE) AS total
  FROM w
), l AS (SELECT *, (total - CAST(below AS DOUBLE)) / CAST(above AS DOUBLE) AS level FROM r
), m AS (SELECT first(level ORDER BY cap / weight, source NULLS LAST) FILTER (WHERE level * weight <= cap) AS met FROM l
), f AS (
  SELECT source, l.source_size, CASE WHEN met IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), weight * met) END AS target FROM l, m
), p AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, CASE WHEN f.source_size > 0 THEN f.target / f.source_size ELSE 0.0 END AS rate,
         CAST('0x' || substr(md5('mix|' || coalesce(CAST(d.doc_id AS VARCHAR), '') || '|' || coalesce(d.digest, '')), 1, 13) AS BIGINT) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source
)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
       CAST(CASE WHEN size > 0 THEN size * (floor(rate) + CASE WHEN u < rate - floor(rate) THEN 1 ELSE 0 END) ELSE 0 END AS BIGINT) AS taken
FROM p
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_sharding": op1_sharding, "op2_simhash": op2_simhash, "op3_extraction": op3_extraction, "op4_quality_rules": op4_quality_rules, "op5_url_filter": op5_url_filter, "op6_mixing": op6_mixing,
        "op7_decontaminate": op7_decontaminate, "op8_weak_quality": op8_weak_quality, "op9_language": op9_language, "op10_toxicity": op10_toxicity,
    } | vector_queries.queries()


def oracle_sql() -> dict[str, str]:
    return {"op1_sharding": OP1_SQL, "op5_url_filter": OP5_SQL, "op6_mixing": OP6_SQL} | vector_queries.oracle_sql()
