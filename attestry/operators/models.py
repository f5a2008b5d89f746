"""Mental models: candidates, validation, confidence, lifecycle, synthesis and reads.

Observations: observation_id, source_profile, source_memory_id, evidence_ids, entity_ids,
relationship_ids, temporal_scope (arrays of strings), concept_key, observation_type, confidence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as tx

OBSERVATIONS, EVIDENCE, CONFIDENCE = 2, 2, 0.0
_ARRAYS = ("entity_ids", "relationship_ids", "evidence_ids", "temporal_scope")


def _quoted(value: Column) -> Column:
    return F.concat(F.lit("'"), value, F.lit("'"))


def tuple_text(values: Column) -> Column:
    """An array as a key text: quoted items in brackets, a comma after a single one."""
    items = F.array_join(F.transform(values, _quoted), ", ")
    return F.concat(F.lit("("), items, F.when(F.size(values) == 1, ",").otherwise(""), F.lit(")"))


def _distinct(name: str) -> Column:
    return F.array_sort(F.array_distinct(F.flatten(F.collect_set(name))))


def _group(rows: DataFrame, model_type: str, key: Column, observations: int, evidence: int, confidence: float) -> DataFrame:
    keyed = rows.withColumn("key", F.concat(F.lit(model_type + ":"), key))
    out = keyed.groupBy("key").agg(
        F.count("*").alias("observations"), F.avg("confidence").alias("confidence"), F.sort_array(F.collect_set("observation_id")).alias("supporting_observation_ids"),
        F.sort_array(F.collect_set("source_memory_id")).alias("supporting_memory_ids"), F.sort_array(F.collect_set("source_profile")).alias("source_profiles"), *[_distinct(a).alias(a) for a in _ARRAYS],
    )
    out = out.where((F.col("observations") >= observations) & (F.size("evidence_ids") >= evidence) & (F.col("confidence") >= confidence))
    return out.withColumn("model_type", F.lit(model_type)).withColumn("model_id", tx.short_id("mm-candidate-", 24, F.concat(F.lit(model_type + ":"), "key")))


def candidates(observations: DataFrame, least_observations: int = OBSERVATIONS, least_evidence: int = EVIDENCE, least_confidence: float = CONFIDENCE) -> DataFrame:
    """Candidates of the four kinds that observations make: concept, pattern, temporal and expectation.

    A group needs least_observations rows, repeats included, and least_evidence distinct
    evidence ids; a temporal one two distinct scopes.
    """
    limits = (least_observations, least_evidence, least_confidence)
    o = observations.withColumn("observation_type", F.nullif("observation_type", F.lit(""))).withColumn("concept_key", F.nullif("concept_key", F.lit("")))
    concept = _group(o.where("concept_key is not null"), "concept", F.col("concept_key"), *limits)
    key = F.concat(F.lit("("), _quoted(F.coalesce("observation_type", F.lit("unknown"))), F.lit(", "), tuple_text(F.col("relationship_ids")), F.lit(", "), tuple_text(F.col("entity_ids")), F.lit(")"))
    pattern = _group(o.where("size(relationship_ids) > 0 and size(entity_ids) > 0"), "pattern", key, *limits)
    other = F.concat(F.lit("("), tuple_text(F.col("entity_ids")), F.lit(", "), tuple_text(F.col("relationship_ids")), F.lit(", "), F.coalesce(_quoted(F.col("observation_type")), F.lit("None")), F.lit(")"))
    temporal = _group(o.where("size(temporal_scope) > 0"), "temporal", F.coalesce("concept_key", other), *limits).where(F.size("temporal_scope") >= 2)
    expectation = _group(o.where("observation_type = 'expectation' and concept_key is not null"), "expectation", F.col("concept_key"), *limits)
    return concept.unionByName(pattern).unionByName(temporal).unionByName(expectation)


def relationship_candidates(relationships: DataFrame, least_relationships: int = 2, least_observations: int = OBSERVATIONS, least_evidence: int = EVIDENCE) -> DataFrame:
    """Candidates of relationships(relationship_id, subject_entity_id, relationship_type, object_entity_id, evidence_ids, supporting_observation_ids, source_profile, source_memory_id, temporal_scope)."""
    out = relationships.groupBy("subject_entity_id", "relationship_type", "object_entity_id").agg(
        F.count("*").alias("relationships"), _distinct("evidence_ids").alias("evidence_ids"), _distinct("supporting_observation_ids").alias("supporting_observation_ids"), F.sort_array(F.collect_set("relationship_id")).alias("relationship_ids"),
        F.sort_array(F.collect_set("source_profile")).alias("source_profiles"), F.sort_array(F.collect_set("source_memory_id")).alias("supporting_memory_ids"), _distinct("temporal_scope").alias("temporal_scope"),
    )
    out = out.where((F.col("relationships") >= least_relationships) & (F.size("evidence_ids") >= least_evidence) & (F.size("supporting_observation_ids") >= least_observations))
    key = F.concat(F.lit("relationship:"), F.concat_ws("|", "subject_entity_id", "relationship_type", "object_entity_id"))
    return out.withColumn("model_type", F.lit("relationship")).withColumn("confidence", F.lit(1.0)).withColumn("model_id", tx.short_id("mm-candidate-", 24, F.concat(F.lit("relationship:"), key)))


def validate(models: DataFrame, evidence: DataFrame, least_evidence: int = 2, least_groups: int = 2, least_quality: float = 0.70, cross_profile: bool = False, require_temporal: bool = True) -> DataFrame:
    """Models(model_id, supporting_evidence_ids, source_profiles) judged by their evidence.

    evidence: model_id, evidence_id, source_profile, memory_current, revoked, promoted, quality,
    contradictory, temporally_compatible, independent_group. One rejected item fails the model.
    """
    expected = models.select("model_id", F.explode("supporting_evidence_ids").alias("evidence_id"), "source_profiles")
    rows = expected.join(evidence.withColumn("supplied", F.lit(True)), ["model_id", "evidence_id"], "left")
    reject = (
        F.when(F.col("revoked"), "revoked_evidence").when(~F.col("promoted"), "unpromoted_evidence").when(~F.col("memory_current"), "missing_or_unauthorized_source_memory")
        .when(~F.array_contains("source_profiles", F.col("source_profile")), "unauthorized_profile").when(F.col("quality") < least_quality, "insufficient_evidence_quality")
        .when(F.col("contradictory"), "contradictory_evidence").when(F.lit(require_temporal) & ~F.col("temporally_compatible"), "temporal_incompatibility")
    )
    rows = rows.withColumn("reject", F.when(F.col("supplied"), reject)).withColumn("accepted", F.coalesce(F.col("supplied"), F.lit(False)) & F.col("reject").isNull())
    agg = rows.groupBy("model_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("accepted"), F.col("evidence_id")))).alias("accepted_evidence_ids"), F.sort_array(F.collect_set(F.when(F.col("reject").isNotNull(), F.col("evidence_id")))).alias("rejected_evidence_ids"),
        F.collect_set(F.when(F.col("reject").isNotNull(), F.concat_ws(":", "reject", "evidence_id"))).alias("r"), F.bool_or(F.col("supplied").isNull()).alias("missing"),
        F.countDistinct(F.when(F.col("accepted"), F.coalesce("independent_group", "evidence_id"))).alias("groups"), F.countDistinct(F.when(F.col("accepted"), F.col("source_profile"))).alias("profiles"),
    )
    also = [
        (F.col("missing"), "missing_supporting_evidence"), (F.size("accepted_evidence_ids") < least_evidence, "insufficient_current_support"), (F.col("groups") < least_groups, "insufficient_independent_corroboration"),
        (F.lit(not cross_profile) & (F.col("profiles") > 1), "cross_profile_validation_not_authorized"),
    ]
    reasons = F.array_sort(F.concat("r", F.filter(F.array(*[F.when(c, F.lit(n)) for c, n in also]), lambda x: x.isNotNull())))
    return agg.select("model_id", (F.size(reasons) == 0).alias("valid"), reasons.alias("reasons"), "accepted_evidence_ids", "rejected_evidence_ids")


def confidence(evidence: DataFrame) -> DataFrame:
    """Share of supporting among governed evidence(model_id, is_promoted, is_revoked, polarity), six digits; 0 without any. Both flags must be known."""
    governed = F.coalesce(F.col("is_promoted"), F.lit(False)) & F.coalesce(~F.col("is_revoked"), F.lit(False))
    sup, con = governed & (F.col("polarity") == "supporting"), governed & (F.col("polarity") != "supporting")
    out = evidence.groupBy("model_id").agg(F.count_if(sup).alias("supporting_evidence"), F.count_if(con).alias("contradicting_evidence"), F.count_if(governed).alias("governed_evidence"))
    return out.withColumn("score", F.when(F.col("governed_evidence") > 0, F.bround(F.col("supporting_evidence") / F.col("governed_evidence"), 6)).otherwise(0.0))


def staleness(models: DataFrame, current: DataFrame, revoked: DataFrame) -> DataFrame:
    """Models(model_id, dependencies) against current(model_id, dependencies): what was added or removed, what of it is revoked(dependency_id), and whether that makes the version stale."""
    now = current.select("model_id", F.col("dependencies").alias("now"))
    rows = models.select("model_id", "dependencies").join(now, "model_id", "left").withColumn("now", F.coalesce("now", F.array().cast("array<string>")))
    lost = models.select("model_id", F.explode("dependencies").alias("dependency_id")).join(revoked.select("dependency_id").distinct(), "dependency_id", "left_semi").groupBy("model_id").agg(F.sort_array(F.collect_set("dependency_id")).alias("revoked"))
    rows = rows.join(lost, "model_id", "left").withColumn("revoked", F.coalesce("revoked", F.array().cast("array<string>")))
    rows = rows.select("model_id", F.array_sort(F.array_except("now", "dependencies")).alias("added"), F.array_sort(F.array_except("dependencies", "now")).alias("removed"), "revoked")
    changed, gone = (F.size("added") + F.size("removed")) > 0, F.size("revoked") > 0
    reasons = F.filter(F.array(F.when(changed, F.lit("dependency_changed")), F.when(gone, F.lit("dependency_revoked"))), lambda x: x.isNotNull())
    return rows.withColumn("stale", changed | gone).withColumn("reasons", reasons)


def refresh(models: DataFrame, stale: DataFrame, current: DataFrame) -> DataFrame:
    """Stale versions with nothing revoked as two rows: the old one superseded, and version + 1 active with today's dependencies. Others are left alone."""
    ready = stale.where("stale and size(revoked) = 0").select("model_id")
    rows = models.join(ready, "model_id", "left_semi").join(current.select("model_id", F.col("dependencies").alias("now")), "model_id")
    both = F.explode(F.array(F.struct(F.lit("superseded").alias("status"), F.col("version").alias("version"), F.col("dependencies").alias("dependencies")), F.struct(F.lit("active").alias("status"), (F.col("version") + 1).alias("version"), F.col("now").alias("dependencies"))))
    return rows.select("model_id", both.alias("v")).select("model_id", "v.*")


def propagate_revocation(models: DataFrame, revoked: DataFrame) -> DataFrame:
    """Models that lean on a revoked dependency become revoked, unless their state is final."""
    hit = models.select("model_id", F.explode("dependencies").alias("dependency_id")).join(revoked.select("dependency_id").distinct(), "dependency_id", "left_semi").select("model_id").distinct().withColumn("__hit", F.lit(True))
    live = F.col("status").isin("candidate", "validated", "active", "stale")
    return models.join(hit, "model_id", "left").withColumn("status", F.when(F.col("__hit") & live, "revoked").otherwise(F.col("status"))).drop("__hit")


def activate(models: DataFrame) -> DataFrame:
    """Validated models become active, ids copied; others don't pass."""
    return models.where("status = 'validated'").withColumn("status", F.lit("active"))


def current_models(models: DataFrame, profile: str | None = None, model_type: str | None = None) -> DataFrame:
    """Validated and active models in order of title (case aside), id and version."""
    out = models.where(F.col("status").isin("validated", "active"))
    if profile is not None:
        out = out.where(F.array_contains("source_profiles", profile))
    if model_type is not None:
        out = out.where(F.col("model_type") == model_type)
    return out.orderBy(F.lower("title"), "model_id", "version")
