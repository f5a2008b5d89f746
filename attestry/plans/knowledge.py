"""Registered queries of evidence, entities, models, transfer, federation and feeds with their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import dates
from attestry.functions import text as tx
from attestry.operators import entities as en
from attestry.operators import evidence as ev
from attestry.operators import federation as fd
from attestry.operators import models as mm
from attestry.operators import transfer as tr
from attestry.plans.retrieval import E as ENTRIES
from attestry.sources import profiles, tables
from attestry.sources.store import Store, shared_folder
from attestry.streaming import feeds

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _events(spark, base):
    return tables.table(spark, base, "events")


# ---- texts ----------------------------------------------------------------------------


@query("SELECT event_id + 1 AS entry_id, 'at' AS temporal_relation, strftime(ts, '%Y-%m-%d') AS start_time, 'day' AS precision FROM events")
def temporal_extract(spark, base):
    found = dates.extract_evidence(tables.evidence_texts(spark, base))
    return found.where("temporal_relation = 'at' and precision = 'day'").select("entry_id", "temporal_relation", "start_time", "precision")


@query("SELECT event_id + 1 AS entry_id, 'Case ' || event_id AS subject, 'open' AS previous, event_type || ' on ' || strftime(ts, '%Y-%m-%d') AS new, 'state_change' AS kind FROM events")
def state_change_extract(spark, base):
    return tables.evidence_texts(spark, base).select("entry_id", F.explode(dates.change_column(F.col("text"))).alias("c")).select("entry_id", "c.*")


@query("SELECT event_id AS id, CASE WHEN event_id % 3 = 0 THEN ['bounds_without_precision'] ELSE [] END AS errors FROM events")
def evidence_rules(spark, base):
    rows = _events(spark, base).select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 3 == 0, "unknown").otherwise("day").alias("precision"), F.lit("observed").alias("evidence_kind"), F.date_format("ts", "yyyy-MM-dd").alias("start_time"), F.lit(None).cast("string").alias("end_time"), F.lit(0.5).alias("confidence")
    )
    return dates.evidence_errors(rows).select("id", "errors")


# ---- evidence -------------------------------------------------------------------------

NORM = r"trim(regexp_replace(regexp_replace(replace(lower({0}), 'ß', 'ss'), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+', ' ', 'g'))"
BENCH = f"WITH b AS (SELECT item_id AS id, text FROM benchmark UNION ALL SELECT 100000 + item_id, upper(text) || '!' FROM benchmark WHERE item_id % 3 = 0 UNION ALL SELECT 200000 + item_id, text || ' extra words' FROM benchmark WHERE item_id % 4 = 0), n AS (SELECT id, {NORM.format('text')} AS n FROM b), t AS (SELECT id, n, list_distinct(list_filter(string_split(n, ' '), lambda x: x <> '')) AS t FROM n)"


def _bench(spark, base):
    b = tables.table(spark, base, "benchmark").select(F.col("item_id").alias("id"), "text")
    return b.union(b.where("id % 3 = 0").select(F.col("id") + 100000, F.concat(F.upper("text"), F.lit("!")))).union(b.where("id % 4 = 0").select(F.col("id") + 200000, F.concat("text", F.lit(" extra words"))))


@query(BENCH + " , l AS (SELECT min(id) AS id, n, any_value(t) AS t FROM t GROUP BY n) SELECT a.id AS left_id, b.id AS right_id, len(list_intersect(a.t, b.t)) / len(list_distinct(list_concat(a.t, b.t))) AS jaccard FROM l a JOIN l b ON a.id < b.id WHERE len(list_intersect(a.t, b.t)) >= 0.75 * len(list_distinct(list_concat(a.t, b.t)))")
def token_jaccard_pairs(spark, base):
    return ev.jaccard_pairs(_bench(spark, base))


@query()
def near_duplicates(spark, base):
    return ev.near_duplicates(_bench(spark, base))


@query(BENCH + " SELECT id, sha256(n) AS h FROM t")
def observation_hashes(spark, base):
    return _bench(spark, base).select("id", tx.observation_hash(F.col("text")).alias("h"))


SIG = ", ".join(f"((event_id * {i + 3}) % 101) / 100.0::DOUBLE AS {k}" for i, k in enumerate(ev.SIGNALS))
SCORE = " + ".join(f"{k} * {w}::DOUBLE" for k, w in ev.SIGNALS.items())


@query(f"WITH s AS (SELECT event_id, {SIG} FROM events) SELECT event_id, round({SCORE}, 9) AS score, round({SCORE}, 12) >= 0.8::DOUBLE AS is_candidate, list_sort(list_filter([" + ", ".join(f"CASE WHEN {k} >= 0.8::DOUBLE THEN 'high_{k}' END" for k in ev.NAMED) + ", CASE WHEN provenance_completeness < 1 THEN 'incomplete_provenance' END], lambda x: x IS NOT NULL)) AS reasons FROM s")
def observation_similarity(spark, base):
    rows = _events(spark, base).select("event_id", *[((F.col("event_id") * (i + 3)) % 101 / F.lit(100.0)).alias(k) for i, k in enumerate(ev.SIGNALS)])
    return ev.similarity(rows).select("event_id", F.round("score", 9).alias("score"), "is_candidate", "reasons")


EV = """
WITH e AS (
  SELECT user_id AS candidate_id, event_id + 1 AS evidence_id, 'p' || (user_id + event_id) % 5 AS source_profile, CASE WHEN event_id % 11 = 0 THEN 'revoked' WHEN event_id % 13 = 0 THEN 'validated' ELSE 'promoted' END AS lifecycle_state,
    event_id % 97 <> 0 AS source_memory_exists, event_id % 89 <> 0 AS source_profile_authorized, event_id % 83 <> 0 AS provenance_complete, event_id % 79 = 0 AS is_derived, CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_id % 701 <> 1 END AS temporal_compatible,
    (event_id % 10) / 10.0::DOUBLE AS confidence, (event_id % 7) / 7.0::DOUBLE AS precision, CASE WHEN event_id % 3 <> 0 THEN 0.5::DOUBLE END AS source_reliability, CASE WHEN event_id % 4 <> 0 THEN 0.25::DOUBLE END AS temporal_recency, event_id % 5 AS corroboration_count, event_id % 4 AS independent_source_count, event_type
  FROM events
), v AS (
  SELECT *, list_sort(list_filter([CASE WHEN NOT source_memory_exists THEN 'source_memory_missing' END, CASE WHEN NOT source_profile_authorized THEN 'source_profile_unauthorized' END, CASE WHEN NOT provenance_complete THEN 'incomplete_provenance' END,
    CASE WHEN is_derived THEN 'derived_statement_not_evidence' END, CASE WHEN lifecycle_state = 'revoked' THEN 'evidence_revoked' END, CASE WHEN lifecycle_state <> 'promoted' THEN 'evidence_not_promoted' END, CASE WHEN NOT temporal_compatible THEN 'temporal_incompatibility' END], lambda x: x IS NOT NULL)) AS reasons FROM e
), vv AS (SELECT *, len(reasons) = 0 AS valid FROM v
), co AS (SELECT candidate_id, list_sort(list(evidence_id)) AS contradictory_evidence_ids FROM e WHERE event_type = 'error' GROUP BY 1
), rs AS (SELECT candidate_id, list_sort(list(DISTINCT r)) AS rr FROM (SELECT candidate_id, unnest(reasons) AS r FROM vv) GROUP BY 1
), oc AS (
  SELECT candidate_id, coalesce(list_sort(list(evidence_id) FILTER (WHERE valid)), []) AS valid_evidence_ids, coalesce(list_sort(list(evidence_id) FILTER (WHERE NOT valid)), []) AS invalid_evidence_ids, bool_and(provenance_complete) AS provenance_complete, bool_and(lifecycle_state = 'promoted') AS all_support_current FROM vv GROUP BY 1
), outcomes AS (
  SELECT oc.candidate_id, valid_evidence_ids, invalid_evidence_ids, provenance_complete, all_support_current, coalesce(contradictory_evidence_ids, []) AS contradictory_evidence_ids,
    list_sort(list_concat(coalesce(rr, []), CASE WHEN co.candidate_id IS NOT NULL THEN ['contradictory_evidence_present'] ELSE [] END)) AS reasons,
    CASE WHEN co.candidate_id IS NOT NULL THEN 'conflict' WHEN list_contains(rr, 'temporal_incompatibility') THEN 'review_required' WHEN len(invalid_evidence_ids) > 0 THEN 'rejected' ELSE 'eligible' END AS outcome
  FROM oc LEFT JOIN rs USING (candidate_id) LEFT JOIN co ON co.candidate_id = oc.candidate_id
), wt AS (
  SELECT *, CASE WHEN valid THEN 'current' WHEN lifecycle_state = 'revoked' THEN 'historical' ELSE 'ineligible' END AS status,
    CASE WHEN valid THEN round(confidence * 0.2::DOUBLE + precision * 0.15::DOUBLE + coalesce(source_reliability, 0) * 0.15::DOUBLE + coalesce(temporal_recency, 0) * 0.1::DOUBLE + least(corroboration_count / 3.0::DOUBLE, 1) * 0.15::DOUBLE + least(independent_source_count / 3.0::DOUBLE, 1) * 0.1::DOUBLE + CASE WHEN provenance_complete THEN 0.15::DOUBLE ELSE 0 END, 12) ELSE 0 END AS composite_weight FROM vv
), tot AS (SELECT candidate_id, round(least(sum(CASE WHEN status = 'current' THEN composite_weight ELSE 0 END), 1), 12) AS total_current_weight, count(*) FILTER (WHERE status = 'current') AS current_support_count, count(DISTINCT source_profile) FILTER (WHERE status = 'current') AS independent_profile_count, bool_or(lifecycle_state = 'revoked') AS recalculation_required FROM wt GROUP BY 1
), cp AS (
  SELECT l.candidate_id, l.evidence_id AS left_id, r.evidence_id AS right_id, l.source_profile AS left_profile, r.source_profile AS right_profile, ['direct', 'temporal', 'evidence'][(l.evidence_id % 3) + 1] AS kind, CASE WHEN (l.evidence_id + r.evidence_id) % 4 = 0 THEN NULL ELSE l.candidate_id % 2 = 0 END AS res
  FROM e l JOIN e r ON l.candidate_id = r.candidate_id AND l.evidence_id < r.evidence_id AND l.event_type = 'error' AND r.event_type = 'error'
), ca AS (SELECT candidate_id, bool_and(coalesce(res, false)) AS resolved, bool_or(res IS NULL) AS unk, bool_or(kind = 'direct') AS d, bool_or(kind = 'evidence') AS ev, bool_or(kind = 'temporal') AS t, list_sort(list_distinct(flatten(list([left_id, right_id])))) AS ids FROM cp GROUP BY 1
), ct AS (
  SELECT c.candidate_id, CASE WHEN resolved IS NULL THEN 'no_contradiction' WHEN resolved THEN 'temporally_separate' WHEN unk THEN 'review_required' ELSE 'conflict' END AS outcome,
    CASE WHEN resolved IS NULL THEN 'none' WHEN resolved THEN CASE WHEN t THEN 'temporal' ELSE 'direct' END WHEN unk THEN CASE WHEN t THEN 'temporal' ELSE 'unknown' END WHEN d THEN 'direct' WHEN ev THEN 'evidence' ELSE 'temporal' END AS kind, coalesce(ids, []) AS contradictory_evidence_ids,
    coalesce(NOT resolved, false) AS requires_review FROM (SELECT DISTINCT candidate_id FROM e) c LEFT JOIN ca USING (candidate_id)
)"""


def _evidence(spark, base):
    i = F.col("event_id")
    return _events(spark, base).select(
        F.col("user_id").alias("candidate_id"), (i + 1).alias("evidence_id"), F.concat(F.lit("p"), ((F.col("user_id") + i) % 5).cast("string")).alias("source_profile"),
        F.when(i % 11 == 0, "revoked").when(i % 13 == 0, "validated").otherwise("promoted").alias("lifecycle_state"), (i % 97 != 0).alias("source_memory_exists"), (i % 89 != 0).alias("source_profile_authorized"),
        (i % 83 != 0).alias("provenance_complete"), (i % 79 == 0).alias("is_derived"), F.when(i % 5 != 0, i % 701 != 1).alias("temporal_compatible"), (i % 10 / F.lit(10.0)).alias("confidence"), (i % 7 / F.lit(7.0)).alias("precision"),
        F.when(i % 3 != 0, F.lit(0.5)).alias("source_reliability"), F.when(i % 4 != 0, F.lit(0.25)).alias("temporal_recency"), (i % 5).alias("corroboration_count"), (i % 4).alias("independent_source_count"), "event_type",
    )


def _contradictory(spark, base):
    return _evidence(spark, base).where("event_type = 'error'").select("candidate_id", "evidence_id")


def _contradiction_pairs(spark, base):
    e = _evidence(spark, base).where("event_type = 'error'")
    l, r = e.alias("l"), e.alias("r")
    kinds = F.element_at(F.array(*map(F.lit, ("direct", "temporal", "evidence"))), (F.col("l.evidence_id") % 3 + 1).cast("int"))
    return l.join(r, (F.col("l.candidate_id") == F.col("r.candidate_id")) & (F.col("l.evidence_id") < F.col("r.evidence_id"))).select(
        F.col("l.candidate_id").alias("candidate_id"), F.col("l.evidence_id").alias("left_id"), F.col("r.evidence_id").alias("right_id"), F.col("l.source_profile").alias("left_profile"), F.col("r.source_profile").alias("right_profile"),
        kinds.alias("kind"), F.when((F.col("l.evidence_id") + F.col("r.evidence_id")) % 4 != 0, F.col("l.candidate_id") % 2 == 0).alias("temporal_resolution"),
    )


@query(EV + " SELECT * FROM outcomes")
def evidence_validation(spark, base):
    return ev.validation_outcomes(ev.validate(_evidence(spark, base)), _contradictory(spark, base)).drop("proposed_outcome")


@query(EV + " SELECT candidate_id, evidence_id, status, round(composite_weight, 9) AS composite_weight FROM wt")
def evidence_weighting(spark, base):
    return ev.weigh(ev.validate(_evidence(spark, base))).select("candidate_id", "evidence_id", "status", F.round("composite_weight", 9).alias("composite_weight"))


@query(EV + " SELECT candidate_id, round(total_current_weight, 9) AS total_current_weight, current_support_count, independent_profile_count, recalculation_required FROM tot")
def evidence_weight_totals(spark, base):
    return ev.weight_totals(ev.weigh(ev.validate(_evidence(spark, base)))).withColumn("total_current_weight", F.round("total_current_weight", 9))


@query(EV + " SELECT candidate_id, outcome, kind, contradictory_evidence_ids, requires_review FROM ct")
def contradiction_outcomes(spark, base):
    c = _evidence(spark, base).select("candidate_id").distinct()
    return ev.contradiction_outcomes(c, _contradiction_pairs(spark, base)).drop("reasons")


@query(EV + """ SELECT o.candidate_id || ':synthesis' AS synthesis_id, o.candidate_id, CASE WHEN c.outcome = 'conflict' THEN 'conflict' WHEN c.outcome = 'review_required' THEN 'review_required' WHEN o.outcome = 'rejected' THEN 'invalidated' WHEN c.outcome = 'temporally_separate' THEN 'keep_separate' ELSE 'synthesized' END AS outcome,
  round(CASE WHEN c.outcome NOT IN ('conflict', 'review_required', 'temporally_separate') AND o.outcome <> 'rejected' THEN total_current_weight ELSE 0 END, 9) AS confidence, cur AS current_evidence_ids, his AS historical_evidence_ids
  FROM outcomes o JOIN ct c USING (candidate_id) JOIN tot USING (candidate_id) JOIN (SELECT candidate_id, coalesce(list_sort(list(evidence_id) FILTER (WHERE status = 'current')), []) AS cur, coalesce(list_sort(list(evidence_id) FILTER (WHERE status = 'historical')), []) AS his FROM wt GROUP BY 1) USING (candidate_id)""")
def synthesis(spark, base):
    weighed = ev.weigh(ev.validate(_evidence(spark, base)))
    outcomes = ev.validation_outcomes(weighed, _contradictory(spark, base))
    c = ev.contradiction_outcomes(outcomes.select("candidate_id"), _contradiction_pairs(spark, base))
    return ev.synthesize(outcomes, ev.weight_totals(weighed), c, weighed).withColumn("confidence", F.round("confidence", 9))


@query("SELECT user_id AS candidate_id, list_sort(list(DISTINCT event_id)) AS observation_ids, list_sort(list(DISTINCT 'p' || event_id % 4)) AS source_profiles, max((event_id % 50) / 50.0::DOUBLE) AS confidence, count(DISTINCT event_id % 4) > 1 AS is_cross_profile FROM events GROUP BY 1 HAVING count(DISTINCT event_id) >= 2")
def consolidation_candidates(spark, base):
    rows = _events(spark, base).select(F.col("user_id").alias("candidate_id"), F.col("event_id").alias("observation_id"), F.concat(F.lit("p"), (F.col("event_id") % 4).cast("string")).alias("source_profile"), (F.col("event_id") % 50 / F.lit(50.0)).alias("score"))
    return ev.consolidation_candidates(rows)


# ---- entities -------------------------------------------------------------------------

ENT = r"""
WITH en AS (SELECT 's' || s_suppkey AS entity_id, s_name AS canonical_name, 'supplier' AS entity_type, CASE WHEN s_suppkey % 10 = 0 THEN 'merged' ELSE 'active' END AS status FROM supplier
  UNION ALL SELECT 'p' || p_partkey, CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_name || ' ' || p_partkey END, 'part', 'active' FROM part
), me AS (
  SELECT 'm' || l_orderkey || '-' || l_linenumber AS mention_id, l_orderkey AS collective_entry_id, 'agent' || l_orderkey % 3 AS source_profile, CAST(l_orderkey AS VARCHAR) AS source_memory_id, upper(CASE WHEN p_partkey % 10 = 0 THEN p_name ELSE p_name || ' ' || p_partkey END) AS mention_text, 'part' AS entity_type, 0.9::DOUBLE AS confidence, 'table' AS extraction_method
  FROM lineitem JOIN part ON p_partkey = l_partkey
), nk AS (SELECT *, trim(regexp_replace(replace(lower(mention_text), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key FROM me
), ek AS (SELECT entity_type, trim(regexp_replace(replace(lower(canonical_name), 'ß', 'ss'), '[^\p{L}\p{N}]+', ' ', 'g')) AS key, count(DISTINCT entity_id) AS n, min(entity_id) AS entity_id FROM en WHERE status = 'active' GROUP BY 1, 2
), re AS (SELECT mention_id, CASE WHEN n = 1 THEN ek.entity_id END AS proposed_entity_id, CASE WHEN n = 1 THEN 'same_entity' WHEN n > 1 THEN 'ambiguous' ELSE 'new_entity' END AS decision, CASE WHEN n > 1 THEN 0 ELSE 1 END AS confidence FROM nk LEFT JOIN ek USING (entity_type, key))"""


def _part_name():
    return F.when(F.col("p_partkey") % 10 == 0, F.col("p_name")).otherwise(F.concat_ws(" ", "p_name", F.col("p_partkey").cast("string")))


def _entities(spark, base):
    s = tables.table(spark, base, "supplier").select(F.concat(F.lit("s"), F.col("s_suppkey").cast("string")).alias("entity_id"), F.col("s_name").alias("canonical_name"), F.lit("supplier").alias("entity_type"), F.when(F.col("s_suppkey") % 10 == 0, "merged").otherwise("active").alias("status"))
    p = tables.table(spark, base, "part").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")), _part_name(), F.lit("part"), F.lit("active"))
    return s.union(p)


def _mentions(spark, base):
    l, p = tables.table(spark, base, "lineitem"), tables.table(spark, base, "part")
    return l.join(p, F.col("p_partkey") == F.col("l_partkey")).select(
        F.concat(F.lit("m"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string")).alias("mention_id"), F.col("l_orderkey").alias("collective_entry_id"), F.concat(F.lit("agent"), (F.col("l_orderkey") % 3).cast("string")).alias("source_profile"),
        F.col("l_orderkey").cast("string").alias("source_memory_id"), F.upper(_part_name()).alias("mention_text"), F.lit("part").alias("entity_type"), F.lit(0.9).alias("confidence"), F.lit("table").alias("extraction_method"),
    )


@query(ENT + " SELECT mention_id, proposed_entity_id, decision, confidence::DOUBLE AS confidence FROM re")
def entity_resolution(spark, base):
    return en.resolve(_mentions(spark, base), _entities(spark, base)).drop("method")


@query(ENT + " SELECT entity_type, (min((collective_entry_id, mention_text)))[2] AS canonical_name, count(*) AS mention_count FROM nk WHERE key <> '' GROUP BY entity_type, key")
def entity_bootstrap(spark, base):
    return en.bootstrap(_mentions(spark, base)).select("entity_type", "canonical_name", "mention_count")


@query(ENT + " SELECT DISTINCT proposed_entity_id AS entity_id, collective_entry_id, source_memory_id, source_profile, mention_text AS original_mention FROM me JOIN re USING (mention_id) WHERE decision = 'same_entity'")
def entity_evidence(spark, base):
    m = _mentions(spark, base)
    return en.entity_evidence(m, en.resolve(m, _entities(spark, base))).select("entity_id", "collective_entry_id", "source_memory_id", "source_profile", "original_mention")


def _orders(spark, base):
    return tables.table(spark, base, "orders").where("o_orderkey % 5 <> 0").select(F.col("o_orderkey").alias("id"))


@query(ENT + " SELECT entity_id, canonical_name, entity_type, count(*) AS mention_count, list_sort(list(DISTINCT source_profile)) AS source_profiles FROM en JOIN re ON proposed_entity_id = entity_id AND decision = 'same_entity' JOIN me USING (mention_id) JOIN orders ON o_orderkey = collective_entry_id WHERE o_orderkey % 5 <> 0 AND status = 'active' GROUP BY 1, 2, 3".replace("en.entity_type", "entity_type").replace("canonical_name, entity_type, count", "canonical_name, en.entity_type AS entity_type, count"))
def entity_graph_nodes(spark, base):
    m, e = _mentions(spark, base), _entities(spark, base)
    return en.graph_nodes(e, m, en.resolve(m, e), _orders(spark, base))


@query(ENT + """ SELECT DISTINCT 'entry:' || collective_entry_id AS source, 'entity:' || proposed_entity_id AS target, 'mentions' AS edge_type, 0.9::DOUBLE AS confidence FROM me JOIN re USING (mention_id) JOIN en ON entity_id = proposed_entity_id JOIN orders ON o_orderkey = collective_entry_id WHERE decision = 'same_entity' AND status = 'active' AND o_orderkey % 5 <> 0
UNION ALL SELECT DISTINCT 'entity:s' || l_suppkey, 'entity:p' || l_partkey, 'uses', 0.95::DOUBLE FROM lineitem WHERE l_suppkey % 10 <> 0""")
def entity_graph_edges(spark, base):
    m, e = _mentions(spark, base), _entities(spark, base)
    r = tables.table(spark, base, "lineitem").select(F.concat(F.lit("s"), F.col("l_suppkey").cast("string")).alias("subject_entity_id"), F.lit("uses").alias("predicate"), F.concat(F.lit("p"), F.col("l_partkey").cast("string")).alias("object_entity_id"), F.lit(0.95).alias("confidence"), F.lit("active").alias("status")).distinct()
    return en.graph_edges(e, m, en.resolve(m, e), r, _orders(spark, base))


def _said(spark, base):
    """One of three texts an order: facts, facts beside conjecture, and facts of versioned names."""
    o = tables.table(spark, base, "orders")
    k = F.col("o_orderkey") % 3
    text = (
        F.when(k == 0, F.concat(F.lit("The Blue Harbor project uses Python. It may contain SQLite. Git depends on Linux and part of "), F.col("o_orderpriority"), F.lit(".")))
        .when(k == 1, "The Blue Harbor project is old and its code implies that Python uses SQLite. FastAPI contains JSON. Nothing indicating that Git contains HTTP.")
        .otherwise("Ubuntu is maintained by Linux. GPT-4 is derived from Qwen2; Git appears to use HTTP.")
    )
    e = o.select(F.col("o_orderkey").alias("id"), F.concat(F.lit("agent"), (F.col("o_orderkey") % 3).cast("string")).alias("source_profile"), F.col("o_orderkey").cast("string").alias("origin_memory_id"), F.lit(True).alias("is_promoted"), F.lit(False).alias("is_revoked"))
    return e, o.select(F.concat(F.lit("agent"), (F.col("o_orderkey") % 3).cast("string")).alias("source_profile"), F.col("o_orderkey").cast("string").alias("origin_memory_id"), text.alias("content"))


@query("""SELECT o_orderkey AS collective_entry_id, t.a AS mention_text, t.b AS entity_type FROM orders, (VALUES (0, 'Blue Harbor', 'project'), (0, 'Python', 'technology'), (0, 'SQLite', 'technology'), (0, 'Git', 'technology'), (0, 'Linux', 'technology'),
  (1, 'Blue Harbor', 'project'), (1, 'Python', 'technology'), (1, 'SQLite', 'technology'), (1, 'FastAPI', 'technology'), (1, 'JSON', 'technology'), (1, 'Git', 'technology'), (1, 'HTTP', 'technology'),
  (2, 'Ubuntu', 'technology'), (2, 'Linux', 'technology'), (2, 'GPT-4', 'technology'), (2, 'Qwen2', 'technology'), (2, 'Git', 'technology'), (2, 'HTTP', 'technology')) AS t(k, a, b) WHERE o_orderkey % 3 = t.k""")
def mention_extract(spark, base):
    return en.extract_mentions(*_said(spark, base)).select("collective_entry_id", "mention_text", "entity_type")


RELATIONS = """(VALUES (0, 'Blue Harbor', 'uses', 'Python'), (0, 'Git', 'depends_on', 'Linux'), (1, 'FastAPI', 'contains', 'JSON'), (2, 'Ubuntu', 'maintained_by', 'Linux'), (2, 'GPT-4', 'derived_from', 'Qwen2'), (2, 'Git', 'uses', 'HTTP')) AS t(k, a, b, c)"""


@query(f"SELECT o_orderkey AS collective_entry_id, t.a AS subject, t.b AS predicate, t.c AS object FROM orders, {RELATIONS} WHERE o_orderkey % 3 = t.k")
def relationship_extract(spark, base):
    return en.said_in_texts(*_said(spark, base)).select("collective_entry_id", "subject", "predicate", "object")


@query(f"SELECT t.b AS predicate, count(*) AS evidence FROM orders, {RELATIONS} WHERE o_orderkey % 3 = t.k GROUP BY 1")
def relationship_rebuild(spark, base):
    store = _rebuilt(spark, base)
    r = store.read("relationships").select("relationship_id", "predicate")
    return store.read("relationship_evidence").join(r, "relationship_id").groupBy("predicate").agg(F.count("*").alias("evidence"))


def _rebuilt(spark, base):
    e, m = _said(spark, base)
    store = Store(spark, f"{shared_folder(spark)}/attestry-knowledge-{uuid.uuid4().hex}")
    en.rebuild_into(store, e, m)
    return store


@query("""WITH t(k, mentions) AS (VALUES (0, 5), (1, 7), (2, 6)), r(k, said) AS (VALUES (0, 2), (1, 1), (2, 3)), o AS (SELECT o_orderkey % 3 AS k, o_orderkey % 11 = 0 AS mixed FROM orders)
SELECT CAST(count(*) + count(*) FILTER (WHERE mixed) AS BIGINT) AS entries, CAST(sum(mentions * CASE WHEN mixed THEN 2 ELSE 1 END) AS BIGINT) AS mentions, CAST(11 AS BIGINT) AS entities, CAST(0 AS BIGINT) AS ambiguous,
  CAST(sum(said) FILTER (WHERE NOT mixed) AS BIGINT) AS relationship_evidence, CAST(6 AS BIGINT) AS relationships, count(*) FILTER (WHERE mixed) AS failed FROM o JOIN t USING (k) JOIN r USING (k)""")
def rebuild_report(spark, base):
    """Counts of a rebuild in which every eleventh order has a second source, which fails it."""
    e, m = _said(spark, base)
    again = F.concat(F.col("source_profile"), F.lit("b"))
    e = e.union(e.where("id % 11 = 0").withColumn("source_profile", again))
    m = m.union(m.where("cast(origin_memory_id as long) % 11 = 0").withColumn("source_profile", again))
    store = Store(spark, f"{shared_folder(spark)}/attestry-knowledge-{uuid.uuid4().hex}")
    en.rebuild_into(store, e, m)
    return store.read("report").select("entries", "mentions", "entities", "ambiguous", "relationship_evidence", "relationships", "failed")


# ---- models ---------------------------------------------------------------------------

OBS = """
WITH o AS (SELECT event_id, 'o' || event_id AS observation_id, 'p' || user_id % 5 AS source_profile, 'm' || event_id AS source_memory_id, ['e' || event_id % 500] AS evidence_ids, ['n' || user_id % 7] AS entity_ids, CASE WHEN event_id % 2 = 0 THEN ['r' || user_id % 3, 's'] ELSE [] END AS relationship_ids,
  [strftime(ts, '%Y-%m-%d')] AS temporal_scope, event_type AS concept_key, CASE WHEN event_id % 3 = 0 THEN 'expectation' ELSE 'fact' END AS observation_type, least(greatest(coalesce(value, 0), 0) / 200, 1) AS confidence FROM events
), k AS (
  SELECT 'concept' AS model_type, 'concept:' || concept_key AS key, * FROM o
  UNION ALL SELECT 'pattern', 'pattern:(''' || observation_type || ''', (''' || array_to_string(relationship_ids, ''', ''') || '''), (''' || entity_ids[1] || ''',))', * FROM o WHERE len(relationship_ids) > 0
  UNION ALL SELECT 'temporal', 'temporal:' || concept_key, * FROM o
  UNION ALL SELECT 'expectation', 'expectation:' || concept_key, * FROM o WHERE observation_type = 'expectation'
)"""


def _observations(spark, base):
    i, u = F.col("event_id"), F.col("user_id")
    t = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    return _events(spark, base).select(
        t("o", i).alias("observation_id"), t("p", u % 5).alias("source_profile"), t("m", i).alias("source_memory_id"), F.array(t("e", i % 500)).alias("evidence_ids"), F.array(t("n", u % 7)).alias("entity_ids"),
        F.when(i % 2 == 0, F.array(t("r", u % 3), F.lit("s"))).otherwise(F.array().cast("array<string>")).alias("relationship_ids"), F.array(F.date_format("ts", "yyyy-MM-dd")).alias("temporal_scope"), F.col("event_type").alias("concept_key"),
        F.when(i % 3 == 0, "expectation").otherwise("fact").alias("observation_type"), F.least(F.greatest(F.coalesce("value", F.lit(0.0)), F.lit(0.0)) / 200, F.lit(1.0)).alias("confidence"),
    )


@query(OBS + " SELECT 'mm-candidate-' || substr(sha256(model_type || ':' || key), 1, 24) AS model_id, model_type, count(*) AS observations, round(avg(confidence), 6) AS confidence, count(DISTINCT evidence_ids[1]) AS evidence, list_sort(list(DISTINCT source_profile)) AS source_profiles, count(DISTINCT temporal_scope[1]) AS scopes FROM k GROUP BY model_type, key HAVING count(*) >= 2 AND count(DISTINCT evidence_ids[1]) >= 2 AND (model_type <> 'temporal' OR count(DISTINCT temporal_scope[1]) >= 2)")
def model_candidates(spark, base):
    out = mm.candidates(_observations(spark, base))
    return out.select("model_id", "model_type", "observations", F.round("confidence", 6).alias("confidence"), F.size("evidence_ids").cast("long").alias("evidence"), "source_profiles", F.size("temporal_scope").cast("long").alias("scopes"))


@query("SELECT 'mm-candidate-' || substr(sha256('relationship:relationship:' || l_suppkey || '|uses|' || l_partkey), 1, 24) AS model_id, count(*) AS relationships, count(DISTINCT l_orderkey) AS evidence FROM lineitem GROUP BY l_suppkey, l_partkey HAVING count(*) >= 2 AND count(DISTINCT l_orderkey) >= 2")
def model_relationship_candidates(spark, base):
    t = lambda c: F.col(c).cast("string")
    r = tables.table(spark, base, "lineitem").select(
        F.concat_ws("-", t("l_orderkey"), t("l_linenumber")).alias("relationship_id"), t("l_suppkey").alias("subject_entity_id"), F.lit("uses").alias("relationship_type"), t("l_partkey").alias("object_entity_id"), F.array(t("l_orderkey")).alias("evidence_ids"), F.array(t("l_orderkey")).alias("supporting_observation_ids"),
        F.lit("p").alias("source_profile"), t("l_orderkey").alias("source_memory_id"), F.array(F.lit("2024")).alias("temporal_scope"),
    )
    return mm.relationship_candidates(r).select("model_id", "relationships", F.size("evidence_ids").cast("long").alias("evidence"))


MODEL = """
WITH e AS (SELECT user_id AS model_id, event_id, 'e' || event_id AS evidence_id, 'p' || CASE WHEN user_id % 3 = 0 THEN event_id % 2 ELSE 0 END AS source_profile, event_id % 41 = 0 AS revoked, event_id % 43 <> 0 AS promoted, event_id % 47 <> 0 AS memory_current, CASE WHEN event_id % 53 = 0 THEN 0.5 ELSE 0.9 END AS quality, event_id % 59 = 0 AS contradictory, event_id % 61 <> 0 AS temporally_compatible FROM events
), j AS (SELECT *, CASE WHEN revoked THEN 'revoked_evidence' WHEN NOT promoted THEN 'unpromoted_evidence' WHEN NOT memory_current THEN 'missing_or_unauthorized_source_memory' WHEN quality < 0.7 THEN 'insufficient_evidence_quality' WHEN contradictory THEN 'contradictory_evidence' WHEN NOT temporally_compatible THEN 'temporal_incompatibility' END AS rj FROM e
), a AS (SELECT model_id, coalesce(list_sort(list(evidence_id) FILTER (WHERE rj IS NULL)), []) AS acc, coalesce(list_sort(list(evidence_id) FILTER (WHERE rj IS NOT NULL)), []) AS rej, coalesce(list(rj || ':' || evidence_id) FILTER (WHERE rj IS NOT NULL), []) AS r, count(DISTINCT source_profile) FILTER (WHERE rj IS NULL) AS profiles FROM j GROUP BY 1
), z AS (SELECT model_id, acc, rej, list_sort(list_concat(r, list_filter([CASE WHEN len(acc) < 2 THEN 'insufficient_current_support' END, CASE WHEN len(acc) < 2 THEN 'insufficient_independent_corroboration' END, CASE WHEN profiles > 1 THEN 'cross_profile_validation_not_authorized' END], lambda x: x IS NOT NULL))) AS reasons FROM a)"""


def _model_evidence(spark, base):
    i = F.col("event_id")
    return _events(spark, base).select(
        F.col("user_id").alias("model_id"), F.concat(F.lit("e"), i.cast("string")).alias("evidence_id"), F.concat(F.lit("p"), F.when(F.col("user_id") % 3 == 0, i % 2).otherwise(0).cast("string")).alias("source_profile"), (i % 47 != 0).alias("memory_current"), (i % 41 == 0).alias("revoked"),
        (i % 43 != 0).alias("promoted"), F.when(i % 53 == 0, 0.5).otherwise(0.9).alias("quality"), (i % 59 == 0).alias("contradictory"), (i % 61 != 0).alias("temporally_compatible"), F.lit(None).cast("string").alias("independent_group"),
    )


@query(MODEL + " SELECT model_id, len(reasons) = 0 AS valid, reasons, acc AS accepted_evidence_ids, rej AS rejected_evidence_ids FROM z")
def model_validation(spark, base):
    e = _model_evidence(spark, base)
    models = e.groupBy("model_id").agg(F.collect_set("evidence_id").alias("supporting_evidence_ids"), F.collect_set("source_profile").alias("source_profiles"))
    return mm.validate(models, e)


@query("WITH e AS (SELECT user_id AS model_id, event_id % 7 <> 0 AND event_id % 11 <> 0 AS g, event_type <> 'error' AS s FROM events) SELECT model_id, count(*) FILTER (WHERE g AND s) AS supporting_evidence, count(*) FILTER (WHERE g AND NOT s) AS contradicting_evidence, count(*) FILTER (WHERE g) AS governed_evidence, CASE WHEN count(*) FILTER (WHERE g) > 0 THEN round(count(*) FILTER (WHERE g AND s) / count(*) FILTER (WHERE g), 6) ELSE 0 END AS score FROM e GROUP BY 1")
def model_confidence(spark, base):
    i = F.col("event_id")
    rows = _events(spark, base).select(F.col("user_id").alias("model_id"), F.when(i % 7 != 0, True).alias("is_promoted"), (i % 11 == 0).alias("is_revoked"), F.when(F.col("event_type") != "error", "supporting").otherwise("contradicting").alias("polarity"))
    return mm.confidence(rows)


DEP = """
WITH m AS (SELECT user_id AS model_id, list_sort(list(DISTINCT 'd' || event_id % 50)) AS dependencies FROM events GROUP BY 1
), c AS (SELECT user_id AS model_id, list_sort(list(DISTINCT 'd' || event_id % 50)) AS now FROM events WHERE event_id % 9 <> 0 OR user_id % 2 = 0 GROUP BY 1
), s AS (SELECT model_id, list_sort(list_filter(coalesce(now, []), lambda x: NOT list_contains(dependencies, x))) AS added, list_sort(list_filter(dependencies, lambda x: NOT list_contains(coalesce(now, []), x))) AS removed, list_sort(list_filter(dependencies, lambda x: x IN ('d3', 'd7'))) AS revoked FROM m LEFT JOIN c USING (model_id)
), st AS (SELECT *, len(added) + len(removed) > 0 OR len(revoked) > 0 AS stale, list_filter([CASE WHEN len(added) + len(removed) > 0 THEN 'dependency_changed' END, CASE WHEN len(revoked) > 0 THEN 'dependency_revoked' END], lambda x: x IS NOT NULL) AS reasons FROM s)"""


def _dependencies(spark, base):
    d = F.sort_array(F.collect_set(F.concat(F.lit("d"), (F.col("event_id") % 50).cast("string")))).alias("dependencies")
    e = _events(spark, base)
    return (
        e.groupBy(F.col("user_id").alias("model_id")).agg(d), e.where("event_id % 9 <> 0 or user_id % 2 = 0").groupBy(F.col("user_id").alias("model_id")).agg(d), spark.createDataFrame([("d3",), ("d7",)], "dependency_id string"),
    )


@query(DEP + " SELECT * FROM st")
def model_staleness(spark, base):
    return mm.staleness(*_dependencies(spark, base))


@query(DEP + " SELECT model_id, unnest(['superseded', 'active']) AS status, unnest([1, 2]) AS version FROM st WHERE stale AND len(revoked) = 0")
def model_refresh(spark, base):
    m, c, r = _dependencies(spark, base)
    return mm.refresh(m.withColumn("version", F.lit(1)), mm.staleness(m, c, r), c).select("model_id", "status", "version")


@query(DEP + " SELECT model_id, CASE WHEN len(revoked) > 0 THEN 'revoked' ELSE 'active' END AS status FROM st")
def model_revocation(spark, base):
    m, _, r = _dependencies(spark, base)
    return mm.propagate_revocation(m.withColumn("status", F.lit("active")), r).select("model_id", "status")


# ---- transfer -------------------------------------------------------------------------

TRANS = """
WITH s AS (SELECT DISTINCT 'src' || user_id % 20 AS source_profile, event_type || ':' || user_id AS knowledge_id FROM events
), d AS (SELECT DISTINCT source AS destination_profile FROM documents
), c AS (SELECT source_profile, destination_profile, knowledge_id, 'tc-' || substr(sha256(source_profile || '|' || destination_profile || '|' || knowledge_id), 1, 24) AS candidate_id FROM s JOIN d ON source_profile <> destination_profile
)"""


def _transfer(spark, base):
    s = _events(spark, base).select(F.concat(F.lit("src"), (F.col("user_id") % 20).cast("string")).alias("source_profile"), F.concat_ws(":", "event_type", F.col("user_id").cast("string")).alias("knowledge_id")).distinct()
    return tr.candidates(s, tables.table(spark, base, "documents").select(F.col("source").alias("destination_profile")))


@query(TRANS + " SELECT *, 'tr-' || substr(sha256(candidate_id), 1, 24) AS transfer_id, 'candidate' AS status FROM c")
def transfer_candidates(spark, base):
    return _transfer(spark, base)


SIGS = {"destination_knowledge_gap": 7, "novelty": 11, "evidence_quality": 13, "entity_overlap": 17, "relationship_overlap": 19, "temporal_compatibility": 23, "prior_transfer_redundancy": 29}
SG = ", ".join(f"1 - (event_id % {n}) / (2.0::DOUBLE * {n}) AS {k}" for k, n in SIGS.items() if k != "prior_transfer_redundancy") + ", (event_id % 29) / 58.0::DOUBLE AS prior_transfer_redundancy"
BEN = "(" + " + ".join(f"{k} * {w}::DOUBLE" for k, w in tr.BENEFIT.items()) + ") * (1 - 0.5::DOUBLE * prior_transfer_redundancy)"
APP = " + ".join(f"{k} * {w}::DOUBLE" for k, w in tr.APPLICABLE.items())


@query(f"WITH s AS (SELECT event_id, CASE WHEN event_id % 37 = 0 THEN 'strong' WHEN event_id % 31 = 0 THEN 'possible' ELSE 'none' END AS contradiction, {SG} FROM events) SELECT event_id, round({BEN}, 6) AS benefit_score, round({APP}, 6) AS applicability_score, CASE WHEN contradiction = 'strong' THEN 'review_required' WHEN round({APP}, 12) >= 0.6 AND round({BEN}, 12) >= 0.6 THEN 'applicable' ELSE 'not_applicable' END AS decision FROM s")
def transfer_applicability(spark, base):
    i = F.col("event_id")
    sig = [(1 - (i % n) / F.lit(2.0 * n)).alias(k) for k, n in SIGS.items() if k != "prior_transfer_redundancy"] + [(i % 29 / F.lit(58.0)).alias("prior_transfer_redundancy")]
    rows = _events(spark, base).select("event_id", F.when(i % 37 == 0, "strong").when(i % 31 == 0, "possible").otherwise("none").alias("contradiction"), *sig)
    return tr.applicability(rows).select("event_id", F.round("benefit_score", 6).alias("benefit_score"), F.round("applicability_score", 6).alias("applicability_score"), "decision")


@query("SELECT event_id AS candidate_id, CASE WHEN event_id % 4 = 0 THEN false WHEN event_id % 4 = 1 AND event_id % 3 <> 0 THEN false ELSE true END AS allowed FROM events")
def transfer_authorization(spark, base):
    i = F.col("event_id")
    rows = _events(spark, base).select(i.alias("candidate_id"), F.lit("candidate").alias("status"), F.when(i % 4 == 0, "not_applicable").when(i % 4 == 1, "review_required").otherwise("applicable").alias("decision"), F.when(i % 3 == 0, "review_approval").otherwise("explicit").alias("mechanism"), F.lit("a").alias("actor"), F.lit("s").alias("scope"))
    return tr.authorize(rows).select("candidate_id", "allowed")


CONF = """
WITH c AS (SELECT event_id, ['e' || event_id % 5, 'e' || event_id % 3] AS a, ['e' || event_id % 4, 'e' || event_id % 6] AS b, ['n' || event_id % 2] AS na, ['n' || event_id % 3] AS nb, CASE WHEN event_id % 7 = 0 THEN NULL ELSE 'k' || event_id % 10 END AS k, CASE WHEN event_id % 13 = 0 THEN 'conflict' WHEN event_id % 11 = 0 THEN 'temporally_separate' END AS co FROM events
), j AS (SELECT event_id, k, co, CASE WHEN k IS NULL THEN 0 ELSE len(list_intersect(a, b)) / len(list_distinct(list_concat(a, b))) END AS eo, CASE WHEN k IS NULL THEN 0 ELSE len(list_intersect(na, nb)) / len(list_distinct(list_concat(na, nb))) END AS no, CASE WHEN k IS NULL THEN 0 ELSE 1 END AS ro FROM c)"""


@query(CONF + " SELECT event_id, eo AS evidence_overlap, no AS entity_overlap, ro::DOUBLE AS relationship_overlap, CASE WHEN k IS NULL THEN 'no_conflict' WHEN co IS NOT NULL THEN co WHEN no = 1 THEN 'keep_existing' ELSE 'adopt_alongside' END AS outcome FROM j")
def transfer_conflicts(spark, base):
    i = F.col("event_id")
    t = lambda p, n: F.concat(F.lit(p), (i % n).cast("string"))
    none = F.array().cast("array<string>")
    rows = _events(spark, base).select(
        "event_id", F.lit("t").alias("transfer_id"), t("c", 100).alias("candidate_id"), F.lit("p").alias("source_profile"), F.array(t("e", 5), t("e", 3)).alias("evidence_ids"), F.array(t("e", 4), t("e", 6)).alias("d_evidence_ids"), F.array(t("n", 2)).alias("entity_ids"), F.array(t("n", 3)).alias("d_entity_ids"),
        none.alias("relationship_ids"), none.alias("d_relationship_ids"), none.alias("temporal_scope"), none.alias("d_temporal_scope"), F.array(F.lit("q")).alias("d_source_profiles"), F.when(i % 7 != 0, t("k", 10)).alias("d_knowledge_id"),
        F.when(i % 13 == 0, "conflict").when(i % 11 == 0, "temporally_separate").alias("contradiction_outcome"),
    )
    return tr.conflicts(rows).select("event_id", "evidence_overlap", "entity_overlap", "relationship_overlap", "outcome")


@query("SELECT event_id AS candidate_id, event_id % 5 <> 0 AND event_id % 7 <> 0 AND event_id % 3 <> 0 AS adoptable FROM events")
def transfer_adoptable(spark, base):
    i = F.col("event_id")
    ids = F.array(i.cast("string"))
    rows = _events(spark, base).select(
        i.alias("candidate_id"), i.alias("a_candidate_id"), F.lit("candidate").alias("status"), F.when(i % 5 == 0, "review_required").otherwise("applicable").alias("decision"), (i % 7 == 0).alias("revoked"), F.col("ts").alias("authorized_at"), F.expr("ts + interval 2 days").alias("expires_at"),
        F.when(i % 3 == 0, F.expr("ts + interval 3 days")).otherwise(F.expr("ts + interval 2 days")).alias("adopted_at"), ids.alias("evidence_ids"), ids.alias("provenance_evidence_ids"), ids.alias("memory_ids"), ids.alias("provenance_memory_ids"), F.lit("m").alias("mental_model_id"), F.lit("m").alias("model_id"), F.lit("p").alias("source_profile"), F.array(F.lit("p")).alias("model_profiles"),
    )
    return tr.adopt(rows).select("candidate_id", "adoptable")


@query("SELECT event_id AS transfer_id, CASE WHEN event_id % 3 = 0 AND event_id % 2 = 0 OR event_id % 3 = 1 AND event_id % 5 = 0 OR event_id % 3 = 2 THEN 'revoked' ELSE 'adopted' END AS new_status FROM events")
def transfer_revocation(spark, base):
    i = F.col("event_id")
    rows = _events(spark, base).select(
        i.alias("transfer_id"), i.alias("r_transfer_id"), F.lit("adopted").alias("status"), F.lit("adopted").alias("representation_status"), F.when(i % 3 == 0, "authorization_revoked").when(i % 3 == 1, "source_dependency_revoked").otherwise("explicit_rollback").alias("reason"),
        (i % 2 == 0).alias("authorization_revoked"), F.when(i % 5 == 0, "revoked").alias("model_status"), (i % 3 == 2).alias("rollback"),
    )
    return tr.revoke(rows).select("transfer_id", "new_status")


# ---- federation and discovery ---------------------------------------------------------

AUD = "WITH r AS (SELECT event_id AS audit_id, event_type AS event_kind, CASE WHEN event_id % 6 = 0 THEN 'refused' ELSE 'ok' END AS outcome, 'u' || user_id % 20 AS participant_id FROM events)"


def _audit(spark, base):
    return _events(spark, base).select(F.col("event_id").alias("audit_id"), F.col("event_type").alias("event_kind"), F.when(F.col("event_id") % 6 == 0, "refused").otherwise("ok").alias("outcome"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("participant_id"), F.lit("a").alias("actor_id"))


@query(AUD + " SELECT 'event_kind' AS dimension, event_kind AS value, count(*) AS n FROM r GROUP BY 2 UNION ALL SELECT 'outcome', outcome, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'participant_id', participant_id, count(*) FROM r GROUP BY 2 UNION ALL SELECT 'all', '', count(*) FROM r")
def federation_diagnostics(spark, base):
    return fd.diagnostics(_audit(spark, base))


@query(AUD + " SELECT count(*) AS total_events, count(*) AS attributable_events, count(DISTINCT audit_id) = count(*) AS audit_healthy FROM r")
def federation_audit_health(spark, base):
    return fd.audit_health(_audit(spark, base))


def _exchanges(spark, base):
    w = W.partitionBy("user_id").orderBy("ts", "event_id")
    rows = _events(spark, base).withColumn("sequence", F.row_number().over(w).cast("long")).where("event_id % 170 <> 0")
    rows = rows.select(F.col("user_id").cast("string").alias("participant_id"), F.col("event_id").cast("string").alias("exchange_id"), "sequence", F.col("sequence").alias("version"), (F.col("sequence") * 2).alias("arrival"))
    return rows.union(rows.where("cast(exchange_id as long) % 19 = 0").withColumn("arrival", F.col("arrival") + 1))


@query("""WITH s AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS q FROM events), k AS (SELECT * FROM s WHERE event_id % 170 <> 0
), g AS (SELECT user_id, min(q) FILTER (WHERE event_id % 170 = 0) AS gap FROM s GROUP BY 1), o AS (SELECT k.user_id, q, event_id, gap IS NULL OR q < gap AS ok FROM k JOIN g USING (user_id)
), u AS (SELECT user_id, CASE WHEN ok THEN 'applied' ELSE 'retry' END AS outcome FROM o UNION ALL SELECT user_id, CASE WHEN ok THEN 'duplicate' ELSE 'retry' END FROM o WHERE event_id % 19 = 0)
SELECT CAST(user_id AS VARCHAR) AS participant_id, outcome, count(*) AS n FROM u GROUP BY 1, 2""")
def federation_sync_batch(spark, base):
    return fd.sync_batch(_exchanges(spark, base)).groupBy("participant_id", "outcome").agg(F.count("*").alias("n"))


@query("SELECT event_id AS exchange_id, CASE WHEN event_id % 5 = 0 THEN 'refused' WHEN event_id % 7 = 0 THEN 'refused' WHEN event_id % 3 = 0 THEN 'rejected' ELSE 'validated' END AS state FROM events")
def federation_receipts(spark, base):
    i = F.col("event_id")
    rows = _events(spark, base).select(i.alias("exchange_id"), F.lit("a").alias("receiver_id"), F.when(i % 3 == 0, "b").otherwise("a").alias("recipient_id"), F.lit(0).alias("authenticated_at"), F.when(i % 5 == 0, 10).otherwise(11).alias("expires_at"), F.when(i % 7 == 0, F.array(F.lit("send"))).otherwise(F.array(F.lit("receive_knowledge"))).alias("capabilities"))
    return fd.receive(rows, 10).select("exchange_id", "state")


@query("SELECT event_id AS participant_id, CASE event_type WHEN 'signup' THEN 'trust_established' WHEN 'error' THEN 'blocked' ELSE 'identified' END AS peer_state FROM events")
def federation_trust(spark, base):
    rows = _events(spark, base).select(F.col("event_id").alias("participant_id"), F.when(F.col("event_type") == "signup", "trusted").when(F.col("event_type") == "error", "blocked").otherwise("untrusted").alias("state"))
    return fd.peer_states(rows).select("participant_id", "peer_state")


def _packets(spark, base):
    i = F.col("event_id")
    return _events(spark, base).select(F.col("user_id").cast("string").alias("client_id"), F.when(i % 3 != 0, F.concat(F.lit("h"), i.cast("string"))).alias("hostname"), F.concat(F.lit("v"), (i % 4).cast("string")).alias("installed_version"), F.col("ts").alias("last_seen"))


@query("SELECT CAST(user_id AS VARCHAR) AS client_id, min(ts) AS first_seen, max(ts) AS last_seen FROM events GROUP BY 1")
def discovery_latest(spark, base):
    return feeds.latest_clients(_packets(spark, base)).select("client_id", "first_seen", "last_seen")


@query("WITH c AS (SELECT CAST(user_id AS VARCHAR) AS client_id, max(ts) AS last_seen, CASE WHEN user_id % 4 = 0 THEN 'ADOPTED' ELSE 'DISCOVERED' END AS state FROM events GROUP BY user_id) SELECT client_id, state, last_seen < TIMESTAMP '2024-01-30' - INTERVAL 30 SECOND AS stale FROM c WHERE state = 'ADOPTED' OR last_seen >= TIMESTAMP '2024-01-30' - INTERVAL 30 SECOND")
def discovery_staleness(spark, base):
    r = feeds.latest_clients(_packets(spark, base)).withColumn("state", F.when(F.col("client_id").cast("long") % 4 == 0, "ADOPTED").otherwise("DISCOVERED"))
    return feeds.visible(r, F.expr("timestamp_ntz'2024-01-30 00:00:00'")).select("client_id", "state", "stale")


@query("SELECT event_id AS id, event_id % 5 <> 0 AND event_id % 7 <> 0 AS valid FROM events")
def discovery_packets(spark, base):
    i = F.col("event_id")
    uuid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(i.cast("string"), 12, "0"))
    payload = F.when(i % 5 == 0, F.concat(F.lit('{"client_id": "x'), i.cast("string"), F.lit('"}'))).when(i % 7 == 0, F.concat(F.lit('{"client_id": "'), uuid, F.lit('", "secret": "1"}'))).otherwise(F.concat(F.lit('{"client_id": "'), uuid, F.lit('", "api_port": 8000}')))
    return _events(spark, base).select(i.alias("id"), feeds.valid_packet(payload).alias("valid"))


@query(ENTRIES + " SELECT source_profile, count(*) AS memory_count FROM entries GROUP BY 1")
def memory_inventory(spark, base):
    return profiles.inventory(tables.memories(spark, base)).select("source_profile", "memory_count")


@query(ENTRIES + " SELECT id, false AS failed FROM entries WHERE embedding IS NULL")
def embedding_backfill(spark, base):
    return profiles.backfill_embeddings(tables.entries(spark, base, True), tables.memories(spark, base), 64).select("id", "failed")


def _packet_stream(spark, base):
    raw = spark.readStream.schema("event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string").option("pathGlobFilter", "events.parquet").parquet(base)
    return raw.select(F.col("user_id").cast("string").alias("client_id"), F.lit(None).cast("string").alias("hostname"), F.col("event_type").alias("installed_version"), F.col("ts").cast("timestamp").alias("last_seen"))


def _run_stream(spark, rows, mode, sink, store):
    q = rows.writeStream.outputMode(mode).foreachBatch(sink).option("checkpointLocation", f"{store.root}/stream").trigger(availableNow=True).start()
    q.awaitTermination()


@query("SELECT CAST(user_id AS VARCHAR) AS client_id, min(ts)::TIMESTAMP AS first_seen, max(ts)::TIMESTAMP AS last_seen FROM events GROUP BY 1")
def discovery_stream(spark, base):
    """The discovery feed as a stream of files, run to its end; the registry of clients it leaves."""
    store = Store(spark, f"{shared_folder(spark)}/attestry-registry-{uuid.uuid4().hex}")
    _run_stream(spark, _packet_stream(spark, base), "append", feeds.registry_sink(store), store)
    return store.read("registry").select("client_id", F.col("first_seen").cast("timestamp_ntz").alias("first_seen"), F.col("last_seen").cast("timestamp_ntz").alias("last_seen"))


@query("""WITH e AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS client_id, date_trunc('millisecond', ts) AS t FROM events
), g AS (SELECT client_id, t, lag(t) OVER w AS before, lead(t) OVER w AS after, max(t) OVER () AS watermark FROM e WINDOW w AS (PARTITION BY client_id ORDER BY t))
SELECT client_id, 'seen' AS status, t AS "at" FROM g WHERE before IS NULL OR t - before > INTERVAL 1 DAY
UNION ALL SELECT client_id, 'stale', t + INTERVAL 1 DAY FROM g WHERE coalesce(after, watermark) - t > INTERVAL 1 DAY""")
def discovery_liveness(spark, base):
    """Clients that are first seen, go stale after a day without a packet, or come back, told by timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    store = Store(spark, f"{shared_folder(spark)}/attestry-liveness-{uuid.uuid4().hex}")
    _run_stream(spark, feeds.liveness(_packet_stream(spark, base), 86_400, 40 * 86_400), "update", feeds.changes_sink(store, "changes"), store)
    return store.read("changes").select("client_id", "status", F.col("at").cast("timestamp_ntz").alias("at"))


# ---- further reads --------------------------------------------------------------------


@query("SELECT event_id AS request_id, event_id % 3 <> 0 AND event_id % 5 <> 0 AND event_id % 7 <> 0 AS allowed FROM events")
def capability_checks(spark, base):
    from attestry.operators import governance as gv

    i = F.col("event_id")
    rows = _events(spark, base).select(
        i.alias("request_id"), F.when(i % 3 != 0, True).alias("authenticated"), F.lit("p").alias("participant_id"), F.when(i % 5 == 0, "q").otherwise("p").alias("session_participant_id"), F.lit("read").alias("capability"),
        F.when(i % 7 == 0, F.array(F.lit("write"))).otherwise(F.array(F.lit("read"), F.lit("write"))).alias("capabilities"),
    )
    return gv.capability_allowed(rows).select("request_id", "allowed")


@query(ENTRIES + " SELECT e.event_id FROM (SELECT event_id, event_id % (SELECT count(*) FROM documents) + 1 AS entry_id FROM events WHERE event_id % 7 <> 0) e JOIN gov ON gov.id = entry_id WHERE validated_at IS NOT NULL")
def strict_evidence(spark, base):
    from attestry.operators import governance as gv

    e = tables.entries(spark, base)
    n = tables.table(spark, base, "documents").count()
    ev_rows = _events(spark, base).select("event_id", (F.col("event_id") % n + 1).alias("entry_id"))
    known = e.select(F.col("id").alias("entry_id"), "source_profile", F.col("origin_memory_id").alias("source_memory_id"))
    rows = ev_rows.join(known, "entry_id").withColumn("source_profile", F.when(F.col("event_id") % 7 == 0, "wrong").otherwise(F.col("source_profile")))
    return gv.strict_evidence(rows, e).select("event_id")


@query(ENTRIES + " SELECT source_profile, origin_memory_id, min(id) AS id FROM entries GROUP BY 1, 2")
def entries_by_source(spark, base):
    from attestry.operators import governance as gv

    return gv.first_by_source(tables.entries(spark, base))


@query("SELECT user_id AS participant_id, list_sort(list_distinct(list_concat(['read'], CASE WHEN user_id % 2 = 0 THEN ['write'] ELSE [] END))) AS capabilities FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0 UNION ALL SELECT user_id, CASE WHEN user_id % 2 = 0 THEN ['write'] ELSE [] END FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 = 0")
def capability_changes(spark, base):
    none = F.array().cast("array<string>")
    u = _events(spark, base).select(F.col("user_id").alias("participant_id")).distinct()
    rows = u.select("participant_id", F.array(F.lit("read")).alias("capabilities"), F.when(F.col("participant_id") % 2 == 0, F.array(F.lit("write"))).otherwise(none).alias("add"), F.when(F.col("participant_id") % 3 == 0, F.array(F.lit("read"))).otherwise(none).alias("remove"))
    return fd.change_capabilities(rows)


@query("WITH e AS (SELECT user_id AS c, min(event_id) FILTER (WHERE event_type = 'view') AS a, max(event_id) FILTER (WHERE event_type = 'purchase') AS r FROM events GROUP BY 1) SELECT c AS conflict_id, CASE WHEN a IS NOT NULL AND r > a THEN 'resolved' WHEN a IS NOT NULL THEN 'acknowledged' ELSE 'open' END AS state FROM e")
def conflict_states(spark, base):
    rows = _events(spark, base).select(F.col("user_id").alias("conflict_id"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "view", "acknowledge").when(F.col("event_type") == "purchase", "resolve").otherwise("note").alias("action"))
    return fd.conflict_states(rows)


@query("SELECT event_id AS exchange_id, 'tc-' || substr(sha256('p' || user_id % 5 || '|p' || event_id % 5 || '|k' || event_id), 1, 24) AS candidate_id, 'proposed' AS projection_state FROM events WHERE event_id % 4 <> 0 AND user_id % 5 <> event_id % 5")
def federation_adoption_proposals(spark, base):
    t = lambda p, c: F.concat(F.lit(p), c.cast("string"))
    i = F.col("event_id")
    return fd.propose_adoption(_events(spark, base).select(i.alias("exchange_id"), F.when(i % 4 != 0, "validated").otherwise("rejected").alias("state"), t("p", F.col("user_id") % 5).alias("source_profile"), t("p", i % 5).alias("destination_profile"), t("k", i).alias("knowledge_id")))


@query("SELECT event_id AS exchange_id, 'revoked' AS status FROM events WHERE event_id % 6 = 0 AND event_id % 4 <> 0")
def federation_revocations(spark, base):
    i = F.col("event_id")
    a = _events(spark, base).select(i.alias("exchange_id"), F.lit("p").alias("source_profile"), i.cast("string").alias("knowledge_id"), F.lit("adopted").alias("status"))
    r = a.where("exchange_id % 6 = 0").withColumn("source_profile", F.when(F.col("exchange_id") % 4 == 0, "other").otherwise("p")).drop("status")
    return fd.propagate_revocations(r, a).select("exchange_id", "status")


@query("SELECT 'm' || user_id AS model_id, 'T' || user_id AS title FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 <> 0 AND user_id % 2 = 0")
def current_models(spark, base):
    u = _events(spark, base).select("user_id").distinct()
    t = lambda p: F.concat(F.lit(p), F.col("user_id").cast("string"))
    rows = u.select(t("m").alias("model_id"), t("T").alias("title"), F.lit(1).alias("version"), F.when(F.col("user_id") % 3 == 0, "stale").otherwise("active").alias("status"), F.array(F.when(F.col("user_id") % 2 == 0, "p").otherwise("q")).alias("source_profiles"))
    return mm.current_models(rows, profile="p").select("model_id", "title")


@query("""WITH e AS (SELECT user_id AS candidate_id, list_sort(list(CAST(event_id AS VARCHAR)) FILTER (WHERE event_type IN ('click', 'view'))) AS s, list_sort(list(CAST(event_id AS VARCHAR)) FILTER (WHERE event_type = 'error')) AS c,
  list_sort(list(CAST(event_id AS VARCHAR)) FILTER (WHERE event_type IN ('click', 'view', 'error') AND event_id % 50 <> 7)) AS v, list(CAST(event_id AS VARCHAR)) FILTER (WHERE event_type = 'view' OR event_id % 40 = 3) AS k, list(CAST(event_id AS VARCHAR)) FILTER (WHERE event_id % 60 <> 11) AS u FROM events GROUP BY 1)
SELECT candidate_id, list_filter([CASE WHEN len(list_intersect(coalesce(c, []), coalesce(k, []))) > 0 THEN 'contradictory_and_current' END, CASE WHEN len(coalesce(u, [])) = 0 OR len(list_filter(coalesce(s, []), lambda x: NOT list_contains(coalesce(u, []), x))) > 0 THEN 'missing_support' END,
  CASE WHEN list_sort(list_concat(coalesce(s, []), coalesce(c, []))) <> coalesce(v, []) THEN 'not_what_was_validated' END], lambda x: x IS NOT NULL) AS errors FROM e""")
def candidate_rules(spark, base):
    i = F.col("event_id")
    ids = lambda when: F.collect_list(F.when(when, i))
    t = F.col("event_type")
    rows = _events(spark, base).groupBy(F.col("user_id").alias("candidate_id")).agg(
        ids(t.isin("click", "view")).alias("supporting_evidence_ids"), ids(t == "error").alias("contradictory_evidence_ids"),
        ids(t.isin("click", "view", "error") & (i % 50 != 7)).alias("validated_evidence_ids"), ids((t == "view") | (i % 40 == 3)).alias("current_evidence_ids"),
        ids(i % 60 != 11).alias("supplied_evidence_ids"),
    )
    return ev.candidate_errors(rows).select("candidate_id", "errors")


@query(ENT + """, qn AS (SELECT p_name || ' ' || p_partkey AS q FROM part WHERE p_partkey = 1), hit AS (SELECT entity_id FROM en, qn WHERE status = 'active' AND lower(canonical_name) = lower(q))
SELECT entry_id, source_memory_id, row_number() OVER (ORDER BY entry_id) AS rank FROM (SELECT DISTINCT collective_entry_id AS entry_id, source_memory_id FROM me JOIN re USING (mention_id) WHERE decision = 'same_entity' AND proposed_entity_id IN (SELECT entity_id FROM hit) AND collective_entry_id % 5 <> 0) QUALIFY rank <= 50""")
def entity_channel(spark, base):
    from attestry.operators import retrieval as rt

    name = tables.table(spark, base, "part").where("p_partkey = 1").select(_part_name().alias("n")).first()["n"]
    e, m = _entities(spark, base), _mentions(spark, base)
    entries = tables.table(spark, base, "orders").select(F.col("o_orderkey").alias("id"), F.concat(F.lit("agent"), (F.col("o_orderkey") % 3).cast("string")).alias("source_profile"), (F.col("o_orderkey") % 5 != 0).alias("is_promoted"), F.lit(False).alias("is_revoked"))
    return rt.entity_channel(entries, e, en.resolve(m, e), m, name.lower()).select("entry_id", "source_memory_id", "rank")


@query("""SELECT event_id AS entry_id, t.r AS temporal_relation, t.a AS start_time, t.b AS end_time, t.p AS precision FROM events, (VALUES ('click', 'during', '2024-01-05', '2024-01-09', 'day'), ('click', 'ongoing', NULL, NULL, 'unknown'),
  ('view', 'at', '2023-03', NULL, 'month'), ('view', 'at', '1999', NULL, 'year'), ('error', 'before', NULL, NULL, 'unknown'), ('error', 'at', '2024-02-03', NULL, 'day'), ('purchase', 'during', NULL, NULL, 'unknown')) AS t(e, r, a, b, p) WHERE event_type = t.e""")
def temporal_forms(spark, base):
    """Ranges, months, years, bare words and changes of state."""
    said = (
        F.when(F.col("event_type") == "click", "From 2024-01-05 to January 9, 2024 it ran, ongoing since.").when(F.col("event_type") == "view", "Seen in March 2023 and again in 1999.")
        .when(F.col("event_type") == "error", "Before 2024-02-03.").when(F.col("event_type") == "purchase", "The order was replaced by another one.").otherwise("No date here.")
    )
    found = dates.extract_evidence(_events(spark, base).select(F.col("event_id").alias("entry_id"), said.alias("text")))
    return found.select("entry_id", "temporal_relation", "start_time", "end_time", "precision")
