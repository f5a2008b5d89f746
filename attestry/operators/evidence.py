"""Evidence consolidation: similarity, near-duplicates, validation, weighting, contradiction, synthesis.

Candidates are rows (candidate_id, supporting_evidence_ids, contradictory_evidence_ids);
evidence is a child table of one row per (candidate_id, evidence_id).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx

#: Signals and their weights; they add up to 1 (fixed values).
SIGNALS = {
    "lexical": 0.20, "semantic": 0.20, "entity_overlap": 0.10, "relationship_overlap": 0.10, "temporal_overlap": 0.10, "evidence_overlap": 0.05,
    "source_overlap": 0.05, "profile_overlap": 0.05, "confidence_similarity": 0.05, "precision_similarity": 0.05, "provenance_completeness": 0.05,
}
NAMED = ("lexical", "semantic", "entity_overlap", "relationship_overlap", "temporal_overlap", "evidence_overlap")
#: Evidence weights (fixed values).
WEIGHTS = {"confidence": 0.20, "precision": 0.15, "reliability": 0.15, "recency": 0.10, "corroboration": 0.15, "independence": 0.10, "provenance": 0.15}


def listed(**reasons: Column) -> Column:
    """Sorted names of the conditions that hold."""
    return F.sort_array(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in reasons.items()]), lambda x: x.isNotNull()))


def similarity(pairs: DataFrame, threshold: float = 0.80) -> DataFrame:
    """Weighted score of eleven signals in [0, 1], whether the pair is a candidate, and why."""
    score = sum((F.col(k) * w for k, w in SIGNALS.items()), F.lit(0.0))
    reasons = {f"high_{k}": F.col(k) >= threshold for k in NAMED} | {"incomplete_provenance": F.col("provenance_completeness") < 1}
    return pairs.withColumn("score", score).withColumn("is_candidate", F.round("score", 12) >= threshold).withColumn("reasons", listed(**reasons))


def jaccard_pairs(texts: DataFrame, threshold: float = 0.75, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """All pairs of texts whose normalized token sets overlap by threshold or more, without loss.

    A pair that alike shares one of its n - ceil(threshold * n) + 1 rarest tokens, so only
    those are joined; texts that are equal after normalization are compared once through
    the smallest id and expanded by hash, never by token. Returns (left_id, right_id, jaccard).
    """
    rows = texts.select(F.col(id_col).alias("id"), tx.tokens(F.col(text_col)).alias("t"), tx.observation_hash(F.col(text_col)).alias("h"))
    lead = rows.groupBy("h").agg(F.min("id").alias("id"), F.min_by("t", "id").alias("t")).where(F.size("t") > 0)
    counts = lead.select(F.explode("t").alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    each = lead.select("id", F.size("t").alias("size"), F.explode("t").alias("token")).join(counts, "token")
    ordered = each.groupBy("id", "size").agg(F.sort_array(F.collect_list(F.struct("n", "token"))).alias("o"))
    prefix = ordered.select("id", "size", F.explode(F.slice("o", F.lit(1), (F.col("size") - F.ceil(F.col("size") * threshold - 1e-9) + 1).cast("int"))).alias("x")).select("id", "size", "x.token")
    a, b = prefix.alias("a"), prefix.alias("b")
    near = a.join(b, (F.col("a.token") == F.col("b.token")) & (F.col("a.id") < F.col("b.id")) & (F.col("a.size") >= F.col("b.size") * threshold - 1e-9) & (F.col("b.size") >= F.col("a.size") * threshold - 1e-9))
    pairs = near.select(F.col("a.id").alias("left_id"), F.col("b.id").alias("right_id")).distinct()
    sets = lead.select("id", "t")
    scored = pairs.join(sets.select(F.col("id").alias("left_id"), F.col("t").alias("lt")), "left_id").join(sets.select(F.col("id").alias("right_id"), F.col("t").alias("rt")), "right_id")
    return scored.withColumn("jaccard", tx.jaccard(F.col("lt"), F.col("rt"))).where(F.col("jaccard") >= threshold - 1e-12).select("left_id", "right_id", "jaccard")


def near_duplicates(texts: DataFrame, near: float = 0.88, least_jaccard: float = 0.75, id_col: str = "id", text_col: str = "text") -> DataFrame:
    """Exact and near duplicates by normalized text: (left_id, right_id, kind, jaccard, sequence).

    Equal normalized texts are linked to the smallest id of their group ('exact'); between
    groups, pairs of enough token overlap are compared as sequences ('near' from near on).
    """
    rows = texts.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), tx.observation_hash(F.col(text_col)).alias("h"))
    lead = rows.groupBy("h").agg(F.min("id").alias("lead"))
    exact = rows.join(lead, "h").where("id <> lead").select(F.col("lead").alias("left_id"), F.col("id").alias("right_id"), F.lit("exact").alias("kind"), F.lit(1.0).alias("jaccard"), F.lit(1.0).alias("sequence"))
    pairs = jaccard_pairs(texts, least_jaccard, id_col, text_col)
    body = rows.select("id", tx.normalize_observation(F.col("text")).alias("n"))
    joined = pairs.join(body.select(F.col("id").alias("left_id"), F.col("n").alias("a")), "left_id").join(body.select(F.col("id").alias("right_id"), F.col("n").alias("b")), "right_id")
    scored = joined.withColumn("sequence", tx.sequence_similarity(F.col("a"), F.col("b"), near)).where(F.col("sequence") >= near)
    kind = F.when(F.col("sequence") >= 1.0, "exact").otherwise("near")
    return exact.union(scored.select("left_id", "right_id", kind, "jaccard", "sequence"))


def consolidation_candidates(pairs: DataFrame) -> DataFrame:
    """Candidates of scored pairs(candidate_id, observation_id, source_profile, score): two observations or more, profiles as a sorted set."""
    out = pairs.groupBy("candidate_id").agg(
        F.sort_array(F.collect_set("observation_id")).alias("observation_ids"), F.sort_array(F.collect_set("source_profile")).alias("source_profiles"), F.max("score").alias("confidence")
    )
    return out.where(F.size("observation_ids") >= 2).withColumn("is_cross_profile", F.size("source_profiles") > 1)


def validate(evidence: DataFrame, require_temporal: bool = False) -> DataFrame:
    """Evidence rows with valid and reasons, by seven rules.

    evidence: candidate_id, evidence_id, source_profile, lifecycle_state, source_memory_exists,
    source_profile_authorized, provenance_complete, is_derived, temporal_compatible (nullable).
    """
    rules = {
        "source_memory_missing": ~F.col("source_memory_exists"), "source_profile_unauthorized": ~F.col("source_profile_authorized"), "incomplete_provenance": ~F.col("provenance_complete"),
        "derived_statement_not_evidence": F.col("is_derived"), "evidence_revoked": F.col("lifecycle_state") == "revoked", "evidence_not_promoted": F.col("lifecycle_state") != "promoted",
        "temporal_incompatibility": F.col("temporal_compatible").isNotNull() & ~F.col("temporal_compatible"),
    }
    if require_temporal:
        rules["temporal_compatibility_unknown"] = F.col("temporal_compatible").isNull()
    return evidence.withColumn("reasons", listed(**rules)).withColumn("valid", F.size("reasons") == 0)


def _ids(when: Column) -> Column:
    return F.sort_array(F.collect_set(F.when(when, F.col("evidence_id"))))


def validation_outcomes(validated: DataFrame, contradictory: DataFrame | None = None) -> DataFrame:
    """Per candidate: valid and invalid ids, reasons and the outcome; conflict before review before rejected before eligible.

    contradictory: (candidate_id, evidence_id) known to contradict.
    """
    out = validated.groupBy("candidate_id").agg(
        _ids(F.col("valid")).alias("valid_evidence_ids"), _ids(~F.col("valid")).alias("invalid_evidence_ids"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("reasons")))).alias("reasons"),
        F.bool_and("provenance_complete").alias("provenance_complete"), F.bool_and(F.col("lifecycle_state") == "promoted").alias("all_support_current"),
    )
    if contradictory is None:
        out = out.withColumn("contradictory_evidence_ids", F.array().cast("array<long>"))
    else:
        ids = contradictory.groupBy("candidate_id").agg(F.sort_array(F.collect_set("evidence_id")).alias("contradictory_evidence_ids"))
        out = out.join(ids, "candidate_id", "left").withColumn("contradictory_evidence_ids", F.coalesce("contradictory_evidence_ids", F.array().cast("array<long>")))
    conflict = F.size("contradictory_evidence_ids") > 0
    outcome = F.when(conflict, "conflict").when(F.array_contains("reasons", "temporal_incompatibility"), "review_required").when(F.size("invalid_evidence_ids") > 0, "rejected").otherwise("eligible")
    out = out.withColumn("reasons", F.array_sort(F.when(conflict, F.array_append("reasons", "contradictory_evidence_present")).otherwise(F.col("reasons"))))
    proposed = F.when(F.col("outcome") == "conflict", "conflict").when(F.col("outcome") == "eligible", "candidate").otherwise("review_required")
    return out.withColumn("outcome", outcome).withColumn("proposed_outcome", proposed)


def weigh(validated: DataFrame) -> DataFrame:
    """Composite weight of each validated evidence row, from confidence, precision, source_reliability, temporal_recency, corroboration_count and independent_source_count.

    Missing optional signals count 0 and are named; evidence that isn't current weighs 0,
    revoked evidence stays as historical. Ranks go by weight, then id.
    """
    from pyspark.sql import Window as W

    status = F.when(F.col("valid"), "current").when(F.col("lifecycle_state") == "revoked", "historical").otherwise("ineligible")
    third = lambda c: F.least(F.col(c) / 3.0, F.lit(1.0))
    parts = {
        "confidence": F.col("confidence"), "precision": F.col("precision"), "reliability": F.coalesce("source_reliability", F.lit(0.0)), "recency": F.coalesce("temporal_recency", F.lit(0.0)),
        "corroboration": third("corroboration_count"), "independence": third("independent_source_count"), "provenance": F.when(F.col("provenance_complete"), 1.0).otherwise(0.0),
    }
    total = sum((parts[k] * w for k, w in WEIGHTS.items()), F.lit(0.0))
    missing = listed(source_reliability=F.col("source_reliability").isNull(), temporal_recency=F.col("temporal_recency").isNull())
    out = validated.withColumn("status", status).withColumn("composite_weight", F.when(F.col("status") == "current", F.round(total, 12)).otherwise(0.0)).withColumn("unavailable_signals", missing)
    return out.withColumn("weight_rank", F.row_number().over(W.partitionBy("candidate_id").orderBy(F.desc("composite_weight"), "evidence_id")).cast("long"))


def weight_totals(weighed: DataFrame) -> DataFrame:
    """Per candidate: total current weight (at most 1), current support, distinct profiles, whether revoked evidence asks for recalculation."""
    current = F.col("status") == "current"
    return weighed.groupBy("candidate_id").agg(
        F.round(F.least(F.sum(F.when(current, F.col("composite_weight")).otherwise(0.0)), F.lit(1.0)), 12).alias("total_current_weight"), F.count_if(current).alias("current_support_count"),
        F.countDistinct(F.when(current, F.col("source_profile"))).alias("independent_profile_count"), F.bool_or(F.col("lifecycle_state") == "revoked").alias("recalculation_required"),
    )


def contradiction_outcomes(candidates: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per candidate the kind and outcome of its contradiction pairs(candidate_id, left_id, right_id, left_profile, right_profile, kind, temporal_resolution).

    No pair: no_contradiction. All resolved in time: temporally_separate. Any unknown:
    review_required. Else conflict. Pairs are preserved whatever weights say.
    """
    has = lambda k: F.bool_or(F.col("kind") == k)
    sides = pairs.withColumn("__ids", F.array("left_id", "right_id")).withColumn("__profiles", F.array("left_profile", "right_profile"))
    agg = sides.groupBy("candidate_id").agg(
        F.bool_and(F.coalesce("temporal_resolution", F.lit(False))).alias("resolved"), F.bool_or(F.col("temporal_resolution").isNull()).alias("unknown"), has("direct").alias("direct"),
        has("evidence").alias("evidence"), has("temporal").alias("temporal"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("__ids")))).alias("contradictory_evidence_ids"),
        F.size(F.array_distinct(F.flatten(F.collect_set("__profiles")))).alias("profiles"), F.bool_or(~F.col("temporal_resolution")).alias("unresolved"),
    )
    out = candidates.select("candidate_id").join(agg, "candidate_id", "left")
    none = F.col("resolved").isNull()
    outcome = F.when(none, "no_contradiction").when(F.col("resolved"), "temporally_separate").when(F.col("unknown"), "review_required").otherwise("conflict")
    kind = (
        F.when(none, "none").when(F.col("resolved"), F.when(F.col("temporal"), "temporal").otherwise("direct")).when(F.col("unknown"), F.when(F.col("temporal"), "temporal").otherwise("unknown"))
        .when(F.col("direct"), "direct").when(F.col("evidence"), "evidence").when(F.col("temporal"), "temporal").otherwise("unknown")
    )
    several, settled, review = F.col("profiles") > 1, F.col("resolved"), F.col("unknown") & ~F.col("resolved")
    conflict = ~none & ~settled & ~review
    steps = [
        (none, "no_contradiction_detected"), (~none, "contradictory_evidence_preserved"), (several, "contradictory_evidence_from_independent_profiles"), (settled, "contradiction_resolved_by_explicit_temporal_evidence"),
        (review, "temporal_resolution_unknown"), (review, "temporal_bounds_not_invented"), (conflict & F.col("unresolved"), "temporal_evidence_does_not_resolve_contradiction"),
        (conflict & several, "independent_profile_conflict_requires_preservation"), (conflict, "evidence_weighting_cannot_suppress_contradiction"),
    ]
    reasons = F.filter(F.array(*[F.when(c, F.lit(r)) for c, r in steps]), lambda x: x.isNotNull())
    return out.select(
        "candidate_id", outcome.alias("outcome"), kind.alias("kind"), F.coalesce("contradictory_evidence_ids", F.array().cast("array<long>")).alias("contradictory_evidence_ids"), reasons.alias("reasons"),
        F.coalesce(review | conflict, F.lit(False)).alias("requires_review"),
    )


def synthesize(outcomes: DataFrame, totals: DataFrame, contradictions: DataFrame, weighed: DataFrame) -> DataFrame:
    """Outcome of each candidate: conflict or review, then invalidated, kept separate, or synthesized; only the last has a confidence."""
    current = weighed.groupBy("candidate_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("status") == "current", F.col("evidence_id")))).alias("current_evidence_ids"), F.sort_array(F.collect_set(F.when(F.col("status") == "historical", F.col("evidence_id")))).alias("historical_evidence_ids")
    )
    c = contradictions.select("candidate_id", F.col("outcome").alias("c"))
    rows = outcomes.select("candidate_id", F.col("outcome").alias("v")).join(c, "candidate_id").join(totals.select("candidate_id", "total_current_weight"), "candidate_id").join(current, "candidate_id")
    outcome = F.when(F.col("c") == "conflict", "conflict").when(F.col("c") == "review_required", "review_required").when(F.col("v") == "rejected", "invalidated").when(F.col("c") == "temporally_separate", "keep_separate").otherwise("synthesized")
    out = rows.withColumn("outcome", outcome)
    return out.select(
        F.concat(F.col("candidate_id").cast("string"), F.lit(":synthesis")).alias("synthesis_id"), "candidate_id", "outcome",
        F.when(F.col("outcome") == "synthesized", F.col("total_current_weight")).otherwise(0.0).alias("confidence"), "current_evidence_ids", "historical_evidence_ids",
    )


def candidate_errors(candidates: DataFrame) -> DataFrame:
    """Candidates with the rules that their id lists break.

    Columns: supporting_evidence_ids, contradictory_evidence_ids, validated_evidence_ids,
    current_evidence_ids and supplied_evidence_ids. All support must be supplied, nothing
    current may contradict, and support and contradiction together must be what was
    validated. Null lists count as empty, nulls in a list as absent.
    """
    none = F.array().cast("array<string>")
    ids = {k: F.coalesce(F.filter(F.transform(f"{k}_evidence_ids", lambda x: x.cast("string")), lambda x: x.isNotNull()), none) for k in ("supporting", "contradictory", "validated", "current", "supplied")}
    both = F.array_sort(F.array_union(ids["supporting"], ids["contradictory"]))
    return candidates.withColumn("errors", listed(
        missing_support=(F.size(ids["supplied"]) == 0) | (F.size(F.array_except(ids["supporting"], ids["supplied"])) > 0),
        contradictory_and_current=F.size(F.array_intersect(ids["contradictory"], ids["current"])) > 0, not_what_was_validated=both != F.array_sort(F.array_distinct(ids["validated"])),
    ))
