"""Intervals, relations, timelines, runs and contradictions of dated assertions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Order of a subject's assertions.
ORDER = ("start", "end", "evidence_id")
DEFINITE_OVERLAPS = ("overlaps", "at", "contains", "during", "starts", "started_by", "ends", "ended_by")


def _ntz(column: Column) -> Column:
    return column.cast("timestamp_ntz")


def parse_time(value: Column, precision: Column) -> Column:
    """A time of stated precision; years and months only where the precision says so, else null."""
    text = F.trim(value)
    padded = F.when((precision == "year") & (F.length(text) == 4), F.concat(text, F.lit("-01-01"))).when(
        (precision == "month") & (F.length(text) == 7), F.concat(text, F.lit("-01"))
    ).when(F.length(text) >= 10, F.regexp_replace(text, "Z$", ""))
    return padded.try_cast("timestamp_ntz")


def precision_end(start: Column, precision: Column) -> Column:
    """Last microsecond of the unit that starts at or holds start; a second has no length."""
    micro = F.expr("interval 1 microsecond")

    def end(unit: str, step: str) -> Column:
        return _ntz(F.date_trunc(unit, start)) + F.expr(f"interval 1 {step}") - micro

    return (
        F.when(precision == "year", end("year", "year")).when(precision == "month", end("month", "month")).when(precision == "day", end("day", "day"))
        .when(precision == "hour", end("hour", "hour")).when(precision == "minute", end("minute", "minute")).when(precision == "second", start)
    )


def precision_intervals(evidence: DataFrame) -> DataFrame:
    """Semantic bounds start and end of evidence(start_time, end_time, precision).

    Evidence without start or of unknown precision is left out; an explicit end widens
    with the same precision, and one before the start is rejected (left out).
    """
    unit = F.col("precision")
    out = evidence.withColumn("start", parse_time(F.col("start_time"), unit)).withColumn("__last", parse_time(F.col("end_time"), unit))
    out = out.where(F.col("start").isNotNull() & (F.col("end_time").isNull() | (F.col("__last") >= F.col("start"))))
    return out.withColumn("end", precision_end(F.coalesce("__last", "start"), unit)).where("end is not null").drop("__last")


def plain_intervals(evidence: DataFrame) -> DataFrame:
    """Exact bounds: unknown precision and missing starts are left out, the end defaults to the start, dates of reduced form are refused."""
    def exact(name: str) -> Column:
        return F.when(F.length(F.trim(name)) >= 10, F.regexp_replace(F.trim(name), "Z$", "")).try_cast("timestamp_ntz")

    out = evidence.where("precision <> 'unknown' and start_time is not null").withColumn("start", exact("start_time"))
    return out.withColumn("end", F.when(F.col("end_time").isNull(), F.col("start")).otherwise(exact("end_time"))).where("start is not null and end is not null")


def _sides(left: str, right: str) -> tuple[Column, Column, Column, Column]:
    return F.col(f"{left}start"), F.col(f"{left}end"), F.col(f"{right}start"), F.col(f"{right}end")


def interval_relation(left: str = "l.", right: str = "r.") -> Column:
    """Relation of two exact intervals; branches count in this order (fixed values)."""
    a, b, c, d = _sides(left, right)
    return (
        F.when(b < c, "before").when((b > d) & (a > c), "after").when(b == c, "meets").when(a == d, "after").when((a == c) & (b == d), "at")
        .when((a <= c) & (b >= d), F.when(a == c, "started_by").when(b == d, "ended_by").otherwise("contains"))
        .when((c <= a) & (d >= b), F.when(a == c, "starts").when(b == d, "ends").otherwise("during"))
        .when((a < d) & (b > c), "overlaps").when(a > d, "after").otherwise("before")
    )


def precision_relation(left: str = "l.", right: str = "r.") -> Column:
    """Relation of two semantic intervals; only partial overlap is indeterminate."""
    a, b, c, d = _sides(left, right)
    return (
        F.when(b < c, "before").when(a > d, "after").when(b == c, "meets").when((a == c) & (b == d), "at")
        .when((a <= c) & (b >= d), F.when(a == c, "started_by").when(b == d, "ended_by").otherwise("contains"))
        .when((c <= a) & (d >= b), F.when(a == c, "starts").when(b == d, "ends").otherwise("during")).otherwise("overlaps")
    )


def certainty(relation: Column) -> Column:
    return F.when(relation == "overlaps", "indeterminate").otherwise("definite")


def pair_relations(rows: DataFrame, keys: list[str], exact: bool = True) -> DataFrame:
    """Relations of all ordered pairs (by evidence_id) of a group's intervals; groups join on their keys."""
    l, r = rows.alias("l"), rows.alias("r")
    same = F.lit(True)
    for k in keys:
        same = same & (F.col(f"l.{k}") == F.col(f"r.{k}"))
    pairs = l.join(r, same & (F.col("l.evidence_id") < F.col("r.evidence_id")))
    relation = interval_relation() if exact else precision_relation()
    out = [F.col(f"l.{k}").alias(k) for k in keys]
    made = pairs.select(*out, F.col("l.evidence_id").alias("left_id"), F.col("r.evidence_id").alias("right_id"), relation.alias("relation"))
    return made if exact else made.withColumn("certainty", certainty(F.col("relation")))


def micros(time: Column) -> Column:
    """Microseconds of a time without zone since 1970, whatever the session's zone."""
    day = F.unix_date(F.to_date(time)).cast("long") * 86_400_000_000
    return day + (F.hour(time) * 3600 + F.minute(time) * 60).cast("long") * 1_000_000 + (F.extract(F.lit("SECOND"), time) * 1_000_000).cast("long")


def overlapping(rows: DataFrame, keys: list[str]) -> DataFrame:
    """All pairs (l, r) of rows(evidence_id, start, end, ...) of equal keys whose intervals share a point, as structs, l with the smaller id.

    Time is cut into bins, for intervals of about one length (a power of two) into bins of
    that length, so an interval lies in two of its own at most. Each interval is looked for
    among those of its own length and longer ones, in their bins. A pair that shares several
    bins is told in the one that holds the later start. So one subject's intervals meet in as
    many tasks as they fill bins, and only neighbours meet.
    """
    own = rows.withColumn("__s", micros(F.col("start"))).withColumn("__e", micros(F.col("end")))
    own = own.withColumn("__level", F.ceil(F.log2((F.col("__e") - F.col("__s") + 1).cast("double"))).cast("int")).where("__e >= __s")
    levels = sorted(r[0] for r in own.select("__level").distinct().collect())  # at most 64 numbers
    row = F.struct(*[c for c in rows.columns], "__s", "__e")

    def bins(level: Column) -> Column:
        width = F.call_function("shiftleft", F.lit(1).cast("long"), level)
        return F.sequence(F.floor(F.col("__s") / width), F.floor(F.col("__e") / width))

    host = own.select(*keys, F.col("__level").alias("__at"), F.explode(bins(F.col("__level"))).alias("__bin"), row.alias("h"))
    known = F.array(*[F.lit(x) for x in levels]) if levels else F.array().cast("array<int>")
    guest = own.withColumn("__at", F.explode(F.filter(known, lambda x: x >= F.col("__level"))))
    guest = guest.select(*keys, "__at", F.col("__level").alias("__own"), F.explode(bins(F.col("__at"))).alias("__bin"), row.alias("g"))
    met = guest.join(host, [*keys, "__at", "__bin"])
    width = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("__at"))
    met = met.where(
        (F.col("g.__s") <= F.col("h.__e")) & (F.col("h.__s") <= F.col("g.__e")) & (F.floor(F.greatest("g.__s", "h.__s") / width) == F.col("__bin"))
        & F.when(F.col("__own") == F.col("__at"), F.col("g.evidence_id") < F.col("h.evidence_id")).otherwise(F.col("g.evidence_id") != F.col("h.evidence_id"))
    )
    first = F.col("g.evidence_id") < F.col("h.evidence_id")
    return met.select(F.when(first, F.col("g")).otherwise(F.col("h")).alias("l"), F.when(first, F.col("h")).otherwise(F.col("g")).alias("r"))


def contradictions(rows: DataFrame) -> DataFrame:
    """Pairs of one subject whose different states hold at the same time for certain.

    Only containment and equality count: a partial overlap is indeterminate and two
    intervals that touch don't overlap. Pairs come from overlapping(), so a subject with very
    many assertions is no single task and none of its pairs outside an overlap is built.
    """
    made = overlapping(rows, ["subject_type", "subject_id"]).where("l.state <> r.state").select(
        F.col("l.subject_type").alias("subject_type"), F.col("l.subject_id").alias("subject_id"), F.col("l.evidence_id").alias("left_id"),
        F.col("r.evidence_id").alias("right_id"), F.col("l.state").alias("left_state"), F.col("r.state").alias("right_state"), precision_relation().alias("relation"),
    )
    return made.where(F.col("relation").isin(*[x for x in DEFINITE_OVERLAPS if x != "overlaps"]))


def consistency_report(rows: DataFrame) -> DataFrame:
    """Per subject: assertions, compared pairs, relations by certainty and conflicts, which are never declared here."""
    pairs = pair_relations(rows, ["subject_type", "subject_id"], exact=False)
    counts = pairs.groupBy("subject_type", "subject_id").agg(
        F.count("*").alias("comparisons"), F.count_if(F.col("certainty") == "definite").alias("definite"), F.count_if(F.col("certainty") != "definite").alias("indeterminate")
    )
    sizes = rows.groupBy("subject_type", "subject_id").agg(F.count("*").alias("assertions"))
    filled = [F.coalesce(c, F.lit(0)).alias(c) for c in ("comparisons", "definite", "indeterminate")]
    return sizes.join(counts, ["subject_type", "subject_id"], "left").select("subject_type", "subject_id", "assertions", *filled, F.lit(0).cast("long").alias("conflicts"))


def _subject_window() -> W:
    return W.partitionBy("subject_type", "subject_id").orderBy(*ORDER)


def timeline(rows: DataFrame) -> DataFrame:
    """Entries of each subject in order, with the position and the next entry's relation."""
    w = _subject_window()
    nexts = {c: F.lead(c).over(w) for c in ("evidence_id", "state", "start", "end")}
    out = rows.withColumn("position", (F.row_number().over(w) - 1).cast("long"))
    for c, n in nexts.items():
        out = out.withColumn(f"n_{c}", n)
    relation = F.when(F.col("n_evidence_id").isNotNull(), precision_relation("", "n_"))
    return out.select(
        "subject_type", "subject_id", "position", "evidence_id", "state", "start", "end", F.col("n_evidence_id").alias("next_evidence_id"), F.col("n_state").alias("next_state"), relation.alias("relation")
    ).withColumn("certainty", F.when(F.col("relation").isNotNull(), certainty(F.col("relation"))))


def transition_analysis(lines: DataFrame) -> DataFrame:
    """Counts of changed, unchanged, definite and indeterminate transitions of each subject's timeline."""
    moved = F.col("next_evidence_id").isNotNull()
    return lines.groupBy("subject_type", "subject_id").agg(
        F.count_if(moved).alias("transitions"), F.count_if(moved & (F.col("state") != F.col("next_state"))).alias("changed"),
        F.count_if(moved & (F.col("state") == F.col("next_state"))).alias("unchanged"),
        F.count_if(F.col("certainty") == "definite").alias("definite"), F.count_if(F.col("certainty") == "indeterminate").alias("indeterminate"),
    )


def state_history(lines: DataFrame) -> DataFrame:
    """Summary of each subject's timeline: observations, states in between, first and last state, transition counts."""
    moved = F.col("next_evidence_id").isNotNull()
    return lines.groupBy("subject_type", "subject_id").agg(
        F.count("*").alias("observation_count"), F.countDistinct("state").alias("distinct_state_count"),
        F.min_by("state", "position").alias("initial_state"), F.max_by("state", "position").alias("final_state"),
        F.count_if(moved).alias("transition_count"), F.count_if(moved & (F.col("state") != F.col("next_state"))).alias("change_count"),
        F.count_if(F.col("certainty") == "indeterminate").alias("indeterminate_count"),
        F.coalesce(F.bool_or(F.col("certainty") == "indeterminate"), F.lit(False)).alias("has_temporal_uncertainty"),
    )


def grouped_evidence(rows: DataFrame, by_state: bool = False) -> DataFrame:
    """Ordered evidence ids of each subject, or of each of its states."""
    keys = ["subject_type", "subject_id"] + (["state"] if by_state else [])
    listed = F.sort_array(F.collect_list(F.struct(*ORDER)))
    return rows.groupBy(*keys).agg(F.count("*").alias("assertions"), F.transform(listed, lambda x: x["evidence_id"]).alias("evidence_ids"))


def stable_runs(lines: DataFrame) -> DataFrame:
    """Maximal runs of one state, by counting changes along the timeline."""
    w = W.partitionBy("subject_type", "subject_id").orderBy("position")
    changed = F.coalesce((F.lag("state").over(w) != F.col("state")).cast("long"), F.lit(0))
    runs = lines.withColumn("__c", changed).withColumn("run", F.sum("__c").over(w.rowsBetween(W.unboundedPreceding, 0)))
    return runs.groupBy("subject_type", "subject_id", "run").agg(
        F.min_by("state", "position").alias("state"), F.min("position").alias("first_position"), F.max("position").alias("last_position"), F.count("*").alias("length")
    )


def change_points(runs: DataFrame) -> DataFrame:
    """Where a run follows another: 1-based index of the new state, states, and the adjacent run lengths' minimum as significance."""
    w = W.partitionBy("subject_type", "subject_id").orderBy("run")
    out = runs.withColumn("previous_state", F.lag("state").over(w)).withColumn("before", F.lag("length").over(w)).where("run > 0")
    return out.select(
        "subject_type", "subject_id", (F.col("first_position") + 1).alias("index"), "previous_state", F.col("state").alias("new_state"),
        F.col("before").alias("length_before"), F.col("length").alias("length_after"), F.least("before", "length").alias("score"), (F.least("before", "length") > 1).alias("persistent"),
    )


def transition_persistence(runs: DataFrame) -> DataFrame:
    """Runs, repeated runs (longer than one), total and longest length of each subject."""
    return runs.groupBy("subject_type", "subject_id").agg(
        F.count("*").alias("run_count"), F.count_if(F.col("length") > 1).alias("repeated_run_count"), F.max("length").alias("longest_run"), F.sum("length").alias("observations")
    )


def longest_run(runs: DataFrame) -> DataFrame:
    """The longest run of each subject; the earliest of equal ones."""
    w = W.partitionBy("subject_type", "subject_id").orderBy(F.desc("length"), "run")
    return runs.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")
