"""Registered queries of the operators on embeddings, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import hard_negatives, vector_codes, vector_copies


def embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/embeddings.parquet")


def op11_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row divisible by 50 is an anchor; labels of rows divisible by 7 are one further."""
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(embeddings(spark, sf_dir).withColumn("label", moved), F.col("vec_id") % 50 == 0)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of the contract; how many distances were computed is the operator's own to tell."""
    return vector_codes.compress(embeddings(spark, sf_dir)).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def op13_vector_copies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_copies.near_vectors(embeddings(spark, sf_dir))


#: Whether a vector v holds nothing but finite numbers.
_FINITE = "{v} IS NOT NULL AND len(list_filter({v}, lambda x: x IS NULL OR NOT isfinite(x))) = 0"


def _codes_sql(rounds: int = 6) -> str:
    """Every round written out as a pair of tables: assignments a, codebooks c."""
    distance = "CAST(list_sum(list_transform(range(1, len(p.v) + 1), lambda i: (p.v[i] - c.v[i]) * (p.v[i] - c.v[i]))) AS BIGINT)"
    steps = []
    for k in range(rounds + 1):
        best = f"SELECT p.rid, p.part, min(struct_pack(d := {distance}, e := c.entry)) AS b FROM p JOIN c{k} c ON p.part = c.part GROUP BY p.rid, p.part"
        steps.append(f"a{k} AS MATERIALIZED ({best})")
        if k < rounds:
            sums = f"SELECT p.part, a.b.e AS entry, i, CAST(floor(sum(p.v[i]) / count(*)) AS BIGINT) AS x FROM a{k} a JOIN p USING (rid, part), (SELECT unnest(range(1, (SELECT max(len(v)) FROM p) + 1)) AS i) GROUP BY ALL"
            steps.append(f"m{k} AS (SELECT part, entry, list(x ORDER BY i) AS v FROM ({sums}) GROUP BY part, entry)")
            steps.append(f"c{k + 1} AS MATERIALIZED (SELECT c.part, c.entry, coalesce(m.v, c.v) AS v FROM c{k} c LEFT JOIN m{k} m USING (part, entry))")
    return f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, label, list_transform(embedding, lambda x: CAST(floor(CAST(x AS DOUBLE) * 4096) AS BIGINT)) AS z
  FROM embeddings WHERE {_FINITE.format(v="embedding")}
), p AS MATERIALIZED (
  SELECT rid, part, z[part * len(z) // 8 + 1 : (part + 1) * len(z) // 8] AS v FROM k, (SELECT unnest(range(8)) AS part)
), f AS (SELECT rid, row_number() OVER (ORDER BY vec_id, z) - 1 AS entry FROM k QUALIFY entry < 16
), c0 AS MATERIALIZED (SELECT part, entry, v FROM p JOIN f USING (rid)
), {", ".join(steps)},
e AS (SELECT rid, lower(string_agg(printf('%02x', b.e), '' ORDER BY part)) AS code, CAST(sum(b.d) AS BIGINT) AS error FROM a{rounds} GROUP BY rid
), h AS (SELECT sha256(string_agg(array_to_string(v, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM k JOIN e USING (rid), h
"""


_NEGATIVES_SQL = f"""
WITH k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(CAST(x AS DOUBLE) * 256)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND {_FINITE.format(v="embedding")}
), s AS MATERIALIZED (
  SELECT a.rid AS a, a.vec_id AS anchor_id, b.rid AS b, b.vec_id AS other_id, a.label = b.label AS same, CAST(list_dot_product(a.v, b.v) AS BIGINT) AS score
  FROM k a JOIN k b ON a.rid <> b.rid WHERE a.vec_id % 50 = 0
), p AS (SELECT a, b, other_id, score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY score DESC, other_id) <= 5
), n AS (
  SELECT s.anchor_id, p.other_id AS positive_id, s.other_id AS negative_id, p.score AS positive_score, s.score AS negative_score,
         row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.score DESC, s.other_id) AS place
  FROM p JOIN s ON p.a = s.a WHERE NOT s.same AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
)
SELECT anchor_id, positive_id, CAST(place AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE place <= 3
"""

_COPIES_SQL = f"""
WITH RECURSIVE k AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, CASE WHEN {_FINITE.format(v="embedding")} THEN list_transform(embedding, lambda x: CAST(x AS DOUBLE)) END AS v FROM embeddings
), u AS MATERIALIZED (SELECT rid, vec_id, v, sqrt(list_dot_product(v, v)) AS n FROM k WHERE v IS NOT NULL AND list_dot_product(v, v) > 0
), l AS MATERIALIZED (SELECT a.rid AS a, b.rid AS b FROM u a JOIN u b ON a.rid <> b.rid AND list_dot_product(a.v, b.v) / (a.n * b.n) >= 0.9
), r(a, b) AS (SELECT rid, rid FROM k UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a
), c AS (SELECT r.a AS rid, min(k.vec_id) AS component_id FROM r JOIN k ON r.b = k.rid GROUP BY r.a
), n AS (SELECT a AS rid, count(*) AS n_links FROM l GROUP BY a)
SELECT vec_id, coalesce(n_links, 0) AS n_links, component_id, vec_id IS NOT DISTINCT FROM component_id AS kept
FROM k JOIN c USING (rid) LEFT JOIN n USING (rid)
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"op11_hard_negatives": op11_hard_negatives, "op12_vector_codes": op12_vector_codes, "op13_vector_copies": op13_vector_copies}


def oracle_sql() -> dict[str, str]:
    return {"op11_hard_negatives": _NEGATIVES_SQL, "op12_vector_codes": _codes_sql(), "op13_vector_copies": _COPIES_SQL}
