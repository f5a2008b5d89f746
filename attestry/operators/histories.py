"""Comparison, consensus, synthesis and trajectories of state histories.

A history is long-form rows (subject_type, subject_id, history_id, position, evidence_id,
state); position counts from 0. has_temporal_uncertainty per history comes in a table of
its own, (subject_type, subject_id, history_id, uncertain), where a caller has it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SUBJECT = ["subject_type", "subject_id"]


def compare_histories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Index-aligned rows of two histories a subject: full outer join on position.

    kind is matching, divergent, left_only or right_only; positions that one history lacks
    count as divergent too. Only subjects that both sides know are compared.
    """
    known = left.select(*SUBJECT).distinct().join(right.select(*SUBJECT).distinct(), SUBJECT)
    l = left.join(known, SUBJECT, "left_semi").select(*SUBJECT, "position", F.col("evidence_id").alias("left_evidence_id"), F.col("state").alias("left_state"))
    r = right.join(known, SUBJECT, "left_semi").select(*SUBJECT, "position", F.col("evidence_id").alias("right_evidence_id"), F.col("state").alias("right_state"))
    kind = F.when(F.col("right_state").isNull(), "left_only").when(F.col("left_state").isNull(), "right_only").when(F.col("left_state") == F.col("right_state"), "matching").otherwise("divergent")
    return l.join(r, [*SUBJECT, "position"], "full_outer").withColumn("kind", kind)


def divergence(compared: DataFrame) -> DataFrame:
    """Counts and ratios over the longer history, and the first index that isn't matching."""
    differs = F.col("kind") != "matching"
    out = compared.groupBy(*SUBJECT).agg(
        F.count("*").alias("comparison_count"), F.count_if(~differs).alias("shared_state_count"), F.count_if(differs).alias("divergent_state_count"),
        F.count_if(F.col("kind") == "left_only").alias("left_only_count"), F.count_if(F.col("kind") == "right_only").alias("right_only_count"),
        F.min(F.when(differs, F.col("position"))).alias("first_divergence_index"),
    )
    return out.withColumns({
        "agreement_ratio": F.col("shared_state_count") / F.col("comparison_count"), "divergence_ratio": F.col("divergent_state_count") / F.col("comparison_count"),
        "has_divergence": F.col("divergent_state_count") > 0, "has_asymmetric_observations": F.col("left_only_count") + F.col("right_only_count") > 0,
    })


def consensus_positions(histories: DataFrame) -> DataFrame:
    """Per subject and position: distinct states in order of history, largest support, and outcome.

    A position that a history doesn't reach is incomplete whatever the others say.
    """
    total = histories.groupBy(*SUBJECT).agg(F.countDistinct("history_id").alias("history_count"))
    votes = histories.groupBy(*SUBJECT, "position", "state").agg(F.count("*").alias("n"), F.min("history_id").alias("first"))
    each = votes.groupBy(*SUBJECT, "position").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("first", "state"))), lambda x: x["state"]).alias("states"),
        F.max("n").alias("supporting_history_count"), F.sum("n").alias("observed"),
    )
    outcome = F.when(F.col("observed") < F.col("history_count"), "incomplete").when(F.size("states") == 1, "consensus").otherwise("disagreement")
    return each.join(total, SUBJECT).select(*SUBJECT, "position", "states", "supporting_history_count", F.col("history_count").alias("total_history_count"), outcome.alias("outcome"))


def history_consensus(positions: DataFrame) -> DataFrame:
    """Counts of consensus, disagreement and incomplete positions."""
    counts = {k: F.count_if(F.col("outcome") == k) for k in ("consensus", "disagreement", "incomplete")}
    out = positions.groupBy(*SUBJECT).agg(
        F.max("total_history_count").alias("history_count"), F.count("*").alias("comparison_count"), *[c.alias(f"{k}_position_count") for k, c in counts.items()]
    )
    return out.withColumns({"has_disagreement": F.col("disagreement_position_count") > 0, "has_incomplete_history": F.col("incomplete_position_count") > 0})


def synthesize(histories: DataFrame) -> DataFrame:
    """Descriptive synthesis of a subject's histories: states agreed on, positions that differ or lack a history, ratios."""
    positions = consensus_positions(histories)

    def at(outcome: str, field: str) -> Column:
        return F.transform(F.sort_array(F.collect_list(F.when(F.col("outcome") == outcome, F.struct("position", F.element_at("states", 1).alias("state"))))), lambda x: x[field])

    made = positions.groupBy(*SUBJECT).agg(
        F.max("total_history_count").alias("history_count"), F.count("*").alias("comparison_count"), at("consensus", "state").alias("consensus_states"),
        at("disagreement", "position").alias("divergent_positions"), at("incomplete", "position").alias("incomplete_positions"),
    )
    ends = histories.groupBy(*SUBJECT, "history_id").agg(F.count("*").alias("n"), F.min_by("state", "position").alias("first"), F.max_by("state", "position").alias("last"))
    listed = ends.groupBy(*SUBJECT).agg(F.sum("n").alias("observation_count"), F.sort_array(F.collect_list(F.struct("history_id", "first", "last"))).alias("h"))
    states = histories.groupBy(*SUBJECT).agg(F.countDistinct("state").alias("distinct_state_count"))
    out = made.join(listed, SUBJECT).join(states, SUBJECT)
    return out.select(
        *SUBJECT, "history_count", "observation_count", "distinct_state_count", F.transform("h", lambda x: x["first"]).alias("initial_states"),
        F.transform("h", lambda x: x["last"]).alias("final_states"), "consensus_states", "divergent_positions", "incomplete_positions",
        (F.size("consensus_states") / F.col("comparison_count")).alias("consensus_ratio"), (F.size("divergent_positions") / F.col("comparison_count")).alias("disagreement_ratio"),
        (F.col("observation_count") / (F.col("history_count") * F.col("comparison_count"))).alias("coverage_ratio"),
        (F.size("divergent_positions") > 0).alias("has_divergence"), (F.size("incomplete_positions") > 0).alias("has_incomplete_history"),
    )


def movement_counts(sequence: DataFrame, keys: list[str]) -> DataFrame:
    """Transitions, reversals (A B A) and oscillations (A B A B) of ordered states, by offsets."""
    w = W.partitionBy(*keys).orderBy("position")
    rows = sequence.withColumns({f"__{k}": F.lag("state", k).over(w) for k in (1, 2, 3)})
    s, p1, p2, p3 = F.col("state"), F.col("__1"), F.col("__2"), F.col("__3")
    return rows.groupBy(*keys).agg(
        F.count("*").alias("observation_count"), F.countDistinct("state").alias("distinct_state_count"), F.count_if(s != p1).alias("transition_count"),
        F.count_if((s == p2) & (s != p1)).alias("reversal_count"), F.count_if((s == p2) & (p1 == p3) & (s != p1)).alias("oscillation_count"),
    )


def trajectories(histories: DataFrame, uncertain: DataFrame | None = None) -> DataFrame:
    """One trajectory a subject over all its histories.

    kind by precedence: divergent, incomplete, uncertain, else what the agreed states do:
    stable, oscillation, reversal, transition. Movement counts add up over histories.
    """
    positions = consensus_positions(histories)
    flags = positions.groupBy(*SUBJECT).agg(
        F.max("total_history_count").alias("history_count"), F.bool_or(F.col("outcome") == "disagreement").alias("has_divergence"), F.bool_or(F.col("outcome") == "incomplete").alias("has_incomplete_history")
    )
    agreed = movement_counts(positions.where("outcome = 'consensus'").withColumn("state", F.element_at("states", 1)), SUBJECT).select(
        *SUBJECT, F.col("distinct_state_count").alias("a_states"), F.col("transition_count").alias("a_moves"), F.col("reversal_count").alias("a_back"), F.col("oscillation_count").alias("a_swing")
    )
    own = movement_counts(histories, [*SUBJECT, "history_id"])
    sums = own.groupBy(*SUBJECT).agg(*[F.sum(c).alias(c) for c in ("observation_count", "transition_count", "reversal_count", "oscillation_count")])
    states = histories.groupBy(*SUBJECT).agg(F.countDistinct("state").alias("distinct_state_count"))
    out = sums.join(states, SUBJECT).join(flags, SUBJECT).join(agreed, SUBJECT, "left")
    if uncertain is None:
        out = out.withColumn("has_temporal_uncertainty", F.lit(False))
    else:
        seen = uncertain.groupBy(*SUBJECT).agg(F.bool_or("uncertain").alias("has_temporal_uncertainty"))
        out = out.join(seen, SUBJECT, "left").withColumn("has_temporal_uncertainty", F.coalesce("has_temporal_uncertainty", F.lit(False)))
    kind = (
        F.when(F.col("observation_count") == 0, "empty").when(F.col("has_divergence"), "divergent").when(F.col("has_incomplete_history"), "incomplete")
        .when(F.col("has_temporal_uncertainty"), "uncertain").when(F.col("a_states").isNull(), "empty").when(F.col("a_states") == 1, "stable")
        .when(F.col("a_swing") > 0, "oscillation").when(F.col("a_back") > 0, "reversal").when(F.col("a_moves") > 0, "transition").otherwise("stable")
    )
    return out.withColumn("kind", kind).select(
        *SUBJECT, "kind", "observation_count", "distinct_state_count", "transition_count", "reversal_count", "oscillation_count", "history_count",
        "has_divergence", "has_incomplete_history", "has_temporal_uncertainty",
    )


def compare_trajectories(left: DataFrame, right: DataFrame) -> DataFrame:
    """Nine differences between two trajectories of a subject."""
    pairs = {
        "kind_divergence": "kind", "observation_divergence": "observation_count", "state_divergence": "distinct_state_count", "transition_divergence": "transition_count",
        "reversal_divergence": "reversal_count", "oscillation_divergence": "oscillation_count", "uncertainty_divergence": "has_temporal_uncertainty",
        "incompleteness_divergence": "has_incomplete_history", "divergence_flag_difference": "has_divergence",
    }
    joined = left.alias("l").join(right.alias("r"), SUBJECT)
    return joined.select(*SUBJECT, F.col("l.kind").alias("left_kind"), F.col("r.kind").alias("right_kind"), *[(F.col(f"l.{c}") != F.col(f"r.{c}")).alias(k) for k, c in pairs.items()])


def trajectory_consensus(all_trajectories: DataFrame) -> DataFrame:
    """Agreement among several trajectories of a subject: support of the largest kind, and what is left."""
    kinds = all_trajectories.groupBy(*SUBJECT, "kind").agg(F.count("*").alias("n"), F.bool_or("has_temporal_uncertainty").alias("u"), F.bool_or("has_incomplete_history").alias("i"))
    out = kinds.groupBy(*SUBJECT).agg(
        F.sum("n").alias("trajectory_count"), F.count("*").alias("kind_count"), F.max("n").alias("consensus_trajectory_count"),
        F.bool_or("u").alias("has_temporal_uncertainty"), F.bool_or("i").alias("has_incompleteness"),
    )
    return out.withColumns({"disagreement_trajectory_count": F.col("trajectory_count") - F.col("consensus_trajectory_count"), "has_disagreement": F.col("kind_count") > 1})


def evidence_backed(histories: DataFrame, trajectory: DataFrame) -> DataFrame:
    """Trajectories with the evidence under them, where history and trajectory count the same observations and all evidence ids are positive."""
    listed = histories.groupBy(*SUBJECT).agg(
        F.count("*").alias("n"), F.transform(F.sort_array(F.collect_list(F.struct("history_id", "position", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"), F.min("evidence_id").alias("least")
    )
    return trajectory.join(listed, SUBJECT).where("n = observation_count and least > 0").drop("n", "least").withColumn("evidence_count", F.size("evidence_ids").cast("long"))


def historical_synthesis(trajectory: DataFrame, histories: DataFrame, changes: DataFrame, runs: DataFrame) -> DataFrame:
    """Per subject: sums of observations, change points and persistent ones, longest run, sorted states and kinds."""
    states = histories.groupBy(*SUBJECT).agg(F.sort_array(F.collect_set("state")).alias("distinct_states"), F.count("*").alias("evidence_count"))
    moved = changes.groupBy(*SUBJECT).agg(F.count("*").alias("c"), F.count_if("persistent").alias("p"))
    longest = runs.groupBy(*SUBJECT).agg(F.max("length").alias("longest_stable_run"))
    kinds = trajectory.groupBy(*SUBJECT).agg(
        F.count("*").alias("analysis_count"), F.sum("observation_count").alias("observation_count"), F.sort_array(F.collect_set("kind")).alias("trajectory_kinds"),
        F.bool_or("has_temporal_uncertainty").alias("has_uncertainty"), F.bool_or("has_incomplete_history").alias("has_incompleteness"), F.bool_or("has_divergence").alias("has_divergence"),
    )
    out = kinds.join(states, SUBJECT).join(longest, SUBJECT).join(moved, SUBJECT, "left")
    return out.withColumns({"change_point_count": F.coalesce("c", F.lit(0)), "persistent_change_point_count": F.coalesce("p", F.lit(0))}).drop("c", "p")


def _text_order(with_state: bool = True) -> list[Column]:
    out = [F.col("valid_from").isNull(), F.coalesce("valid_from", F.lit("")), F.col("valid_to").isNull(), F.coalesce("valid_to", F.lit(""))]
    names = ["state"] * with_state + ["evidence_id", "source_profile", "source_memory_id"]
    return out + [F.col(n).cast("string") for n in names]


def entity_history(observations: DataFrame) -> DataFrame:
    """Observations(entity_id, state, valid_from, valid_to, evidence_id, source_profile, source_memory_id) in history order: unknown bounds last."""
    return observations.withColumn("position", (F.row_number().over(W.partitionBy("entity_id").orderBy(*_text_order())) - 1).cast("long"))


def entity_transitions(history: DataFrame) -> DataFrame:
    """Moves between neighbouring observations of different states."""
    w = W.partitionBy("entity_id").orderBy("position")
    names = ("state", "evidence_id", "valid_from")
    rows = history.withColumns({f"p_{n}": F.lag(n).over(w) for n in names}).where("p_state <> state")
    return rows.select(
        "entity_id", F.col("p_state").alias("from_state"), F.col("state").alias("to_state"), F.col("p_evidence_id").alias("from_evidence_id"),
        F.col("evidence_id").alias("to_evidence_id"), F.col("p_valid_from").alias("from_valid_from"), F.col("valid_from").alias("to_valid_from"),
    )


def entity_summary(history: DataFrame) -> DataFrame:
    """Counts of an entity's history; complete if all observations have a known start."""
    w = W.partitionBy("entity_id").orderBy("position")
    moved = history.withColumn("__m", F.coalesce(F.lag("state").over(w) != F.col("state"), F.lit(False)))
    return moved.groupBy("entity_id").agg(
        F.count("*").alias("observation_count"), F.count_if("__m").alias("transition_count"), F.count("valid_from").alias("known_timed_observations"),
        F.count_if(F.col("valid_from").isNull()).alias("unknown_timed_observations"), F.bool_and(F.col("valid_from").isNotNull()).alias("complete"),
    )


def relationship_history(observations: DataFrame) -> DataFrame:
    """Observations of (source_entity_id, target_entity_id, relation) summed up; a gap is unknown, so no transition is ever inferred."""
    return observations.groupBy("source_entity_id", "target_entity_id", "relation").agg(
        F.count("*").alias("observation_count"), F.count("valid_from").alias("known_timed_observations"), F.count_if(F.col("valid_from").isNull()).alias("unknown_timed_observations"),
        F.bool_and(F.col("valid_from").isNotNull()).alias("complete"), F.lit(0).cast("long").alias("transition_count"), F.lit(True).alias("observed_active"),
    )


def summary_sentences(history: DataFrame) -> DataFrame:
    """One sentence per observed state and per transition of an entity, with its evidence ids in order."""
    states = history.groupBy("entity_id", "state").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", "evidence_id"))), lambda x: x["evidence_id"]).alias("evidence_ids"))
    seen = states.select("entity_id", F.format_string("Entity %s was observed in state '%s'.", F.col("entity_id").cast("string"), "state").alias("statement"), "evidence_ids")
    moves = entity_transitions(history).select(
        "entity_id", F.format_string("Entity %s has an evidence-backed observed transition from '%s' to '%s'.", F.col("entity_id").cast("string"), "from_state", "to_state").alias("statement"),
        F.array("from_evidence_id", "to_evidence_id").alias("evidence_ids"),
    )
    return seen.union(moves)
