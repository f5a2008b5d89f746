"""Who may be seen: lifecycle states, governance filters, ingestion and counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.schema import TRANSITIONS


def live() -> Column:
    return F.coalesce(F.col("is_promoted"), F.lit(False)) & ~F.coalesce(F.col("is_revoked"), F.lit(False))


def governed_entries(entries: DataFrame, profile: str | None = None) -> DataFrame:
    """Promoted and not revoked entries, of one profile where named. Every operator reads entries through this."""
    out = entries.where(live())
    return out if profile is None else out.where(F.col("source_profile") == profile)


def strict_evidence(evidence: DataFrame, entries: DataFrame, validated: bool = True) -> DataFrame:
    """Evidence(entry_id, source_profile, source_memory_id, ...) whose governed entry has the same profile and memory, and is validated."""
    known = governed_entries(entries)
    if validated:
        known = known.where("validated_at is not null")
    keys = known.select(F.col("id").alias("__id"), F.col("source_profile").alias("__profile"), F.col("origin_memory_id").alias("__memory"))
    return evidence.join(keys, (F.col("entry_id") == F.col("__id")) & (F.col("source_profile") == F.col("__profile")) & (F.col("source_memory_id") == F.col("__memory")), "left_semi")


def lifecycle_states(entries: DataFrame) -> DataFrame:
    """(state, id) of every state an entry is in; states overlap."""
    revoked, promoted, seen = F.coalesce("is_revoked", F.lit(False)), F.coalesce("is_promoted", F.lit(False)), F.col("validated_at").isNotNull()
    states = {"proposed": ~seen & ~revoked, "validated": seen & ~revoked, "rejected": revoked & ~seen, "promoted": promoted, "revoked": revoked}
    return entries.select("id", F.explode(F.filter(F.array(*[F.when(c, F.lit(k)) for k, c in states.items()]), lambda x: x.isNotNull())).alias("state"))


def collective_counts(entries: DataFrame) -> DataFrame:
    """Total, promoted, proposed, revoked and embedded entries, 0 for none."""
    revoked = F.coalesce("is_revoked", F.lit(False))
    embedded = F.col("embedding").isNotNull() if "embedding" in entries.columns else F.lit(False)
    return entries.agg(
        F.count("*").alias("total"), F.count_if("is_promoted").alias("promoted"), F.count_if(F.col("validated_at").isNull() & ~revoked).alias("proposed"),
        F.count_if(revoked).alias("revoked"), F.count_if(embedded).alias("embedded"),
    )


def collective_profiles(entries: DataFrame) -> DataFrame:
    return entries.groupBy("source_profile").agg(F.count("*").alias("memory_count"))


def first_by_source(entries: DataFrame) -> DataFrame:
    """The lowest id of each (source_profile, origin_memory_id)."""
    return entries.groupBy("source_profile", "origin_memory_id").agg(F.min("id").alias("id"))


def resolve_profile(entries: DataFrame, name: str) -> str:
    """A qualified profile as is; a short one by its only ':name' match, ASCII case aside. Ambiguous names raise."""
    if ":" in name:
        return name
    pattern = "%:" + name
    found = [r[0] for r in entries.select("source_profile").distinct().where(F.col("source_profile").ilike(pattern)).limit(2).collect()]
    if len(found) > 1:
        raise ValueError(f"ambiguous profile {name}")
    return found[0] if found else name


def short_profile(profile: Column) -> Column:
    return F.element_at(F.split(profile, ":"), -1)


def profile_events(entries: DataFrame, profile: str | None) -> DataFrame:
    return entries if profile is None else entries.where((F.col("source_profile") == profile) | F.col("source_profile").ilike("%:" + profile))


def timeline_events(entries: DataFrame, memories: DataFrame, profile: str | None = None) -> DataFrame:
    """Entries with the date of their memory: the first that isn't null or empty of event date, timestamps and proposal."""
    m = memories.select("source_profile", "origin_memory_id", *[c for c in ("event_date", "timestamp", "created_at") if c in memories.columns])
    rows = profile_events(entries, profile).join(m, ["source_profile", "origin_memory_id"], "left")
    dates = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in ("event_date", "timestamp", "created_at", "proposed_at") if c in rows.columns]
    return rows.select("id", "source_profile", short_profile(F.col("source_profile")).alias("profile"), "origin_memory_id", F.coalesce(*dates).alias("memory_date"))


def ui_filter(events: DataFrame, profile: str | None = None, search: str | None = None, first: str | None = None, last: str | None = None, text_col: str = "content") -> DataFrame:
    """Events of a profile, holding a text in any case, on days from first to last inclusive; without a date only where no bound is set."""
    out = events
    if profile:
        out = out.where(F.col("source_profile") == profile)
    if search:
        out = out.where(F.contains(F.lower(F.col(text_col)), F.lit(search.lower())))
    if first:
        out = out.where(F.col("memory_date") >= first)
    if last:
        out = out.where(F.substring("memory_date", 1, 10) <= last)
    return out


def ingest(memories: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Memories with status proposed or duplicate: the first of a content hash in (profile, id) order is proposed.

    Memories that already have an entry are skipped as existing. Null contents are not
    memories. The first of a hash is found by a map-side combined minimum, so a content
    repeated without end costs one row a task.
    """
    rows = memories.where("content is not null").withColumn("content_hash", tx.content_hash(F.col("content")))
    lead = rows.groupBy("content_hash").agg(F.min(F.struct("source_profile", "origin_memory_id")).alias("lead"))
    out = rows.join(lead, "content_hash").withColumn("status", F.when(F.struct("source_profile", "origin_memory_id") == F.col("lead"), "proposed").otherwise("duplicate"))
    if existing is not None:
        seen = existing.select("source_profile", "origin_memory_id", F.lit(True).alias("__seen")).distinct()
        out = out.join(seen, ["source_profile", "origin_memory_id"], "left").withColumn("status", F.when(F.col("__seen"), "existing").otherwise(F.col("status")))
    return out.select("source_profile", "origin_memory_id", "content_hash", "status")


def ingest_report(ingested: DataFrame) -> DataFrame:
    return ingested.groupBy("source_profile").agg(
        F.count("*").alias("discovered"), F.count_if(F.col("status") == "proposed").alias("proposed"), F.count_if(F.col("status") == "duplicate").alias("duplicates"), F.count_if(F.col("status") == "existing").alias("existing")
    )


def duplicate_revocations(entries: DataFrame, memories: DataFrame) -> DataFrame:
    """Entries not revoked whose content another, lower id already holds, with the reason for revocation."""
    rows = entries.where(~F.coalesce("is_revoked", F.lit(False))).join(memories.where("content is not null"), ["source_profile", "origin_memory_id"]).select("id", tx.content_hash(F.col("content")).alias("content_hash"))
    keeper = rows.groupBy("content_hash").agg(F.min("id").alias("kept_id"))
    return rows.join(keeper, "content_hash").where("id <> kept_id").select("id", "kept_id", F.concat(F.lit("Exact duplicate of collective entry "), F.col("kept_id").cast("string")).alias("revocation_reason"))


def unseen(inventory: DataFrame, entries: DataFrame) -> DataFrame:
    """Inventory rows (source_profile, origin_memory_id) that no entry refers to."""
    return inventory.join(entries.select("source_profile", "origin_memory_id"), ["source_profile", "origin_memory_id"], "left_anti")


def scan_report(inventory: DataFrame, entries: DataFrame) -> DataFrame:
    """Per profile: memories scanned, already known and new."""
    seen = entries.select("source_profile", "origin_memory_id").distinct().withColumn("__seen", F.lit(True))
    return inventory.join(seen, ["source_profile", "origin_memory_id"], "left").groupBy("source_profile").agg(
        F.count("*").alias("scanned"), F.count("__seen").alias("existing"), F.count_if(F.col("__seen").isNull()).alias("inserted")
    )


def privacy_masking(memories: DataFrame) -> DataFrame:
    """Memories that hold something to mask, masked, with what was found."""
    fields = tx.masked_fields(F.col("content"))
    return memories.withColumn("masked_fields", fields).where(F.size("masked_fields") > 0).select("source_profile", "origin_memory_id", "masked_fields", tx.masked(F.col("content")).alias("sanitized"))


def validate_proposals(proposals: DataFrame, threshold: float = 0.75) -> DataFrame:
    """Score and decision of proposals(source_profile, expected_profile, text, score): a wrong profile or no text scores 0."""
    score = F.when(F.col("source_profile") != F.col("expected_profile"), 0.0).when(F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0, 0.0).otherwise(F.col("score"))
    return proposals.withColumn("validation_score", score).withColumn("accepted", F.col("validation_score") >= threshold)


def mediate(proposals: DataFrame) -> DataFrame:
    """Code and state of proposals(authenticated, text, score): 401 unknown caller, 400 no text, then 422 for private data or a low score, else 200."""
    blank = F.coalesce(F.length(F.trim("text")), F.lit(0)) == 0
    private = F.size(tx.masked_fields(F.col("text"))) > 0
    code = F.when(~F.coalesce("authenticated", F.lit(False)), 401).when(blank, 400).when(private | (F.col("score") < 0.75), 422).otherwise(200)
    return proposals.withColumn("code", code).withColumn("state", F.when(F.col("code") == 200, "READY_FOR_PROMOTION").when(F.col("code") == 422, "REJECTED"))


def allowed_moves(moves: DataFrame, machine: str) -> DataFrame:
    """moves(from_state, to_state) with allowed; the table of the machine is a handful of rows and is sent along."""
    spark = moves.sparkSession
    known = spark.createDataFrame([(a, b, True) for a, b in TRANSITIONS[machine]], "from_state string, to_state string, allowed boolean")
    return moves.join(F.broadcast(known), ["from_state", "to_state"], "left").withColumn("allowed", F.coalesce("allowed", F.lit(False)))


def fold_commands(commands: DataFrame) -> DataFrame:
    """Outcome of a log of propose, validate, reject, revoke and promote commands(id, seq, command), id by id in order.

    Each row gets accepted and the error that the guard raised. Guards look at what accepted
    commands before left. No fold is needed for that: a command of a kind is accepted once at
    most, so the whole state of an id is the place of its first proposal, of the first
    validation after it that no rejection or revocation precedes, of what revokes it and of
    the first promotion in between. Each is a minimum, which tasks combine before anything is
    shuffled, so one id's log may be any part of the table. Commands of one seq go by name;
    of equal rows the first is judged, the others find its effect. A null command is
    unknown; rows with a null seq come first.
    """
    place = F.struct(F.coalesce("seq", F.lit(-(1 << 63))).alias("seq"), F.coalesce("command", F.lit("")).alias("command"))
    rows = commands.groupBy("id", "seq", "command").agg(F.count("*").alias("times")).withColumn("at", place)
    first = lambda name, when: F.min(F.when((F.col("command") == name) & when, F.col("at")))

    def after(known: DataFrame, **firsts: Column) -> DataFrame:
        """known(id, ...) with the first places of later commands."""
        met = rows.join(known, F.col("id").eqNullSafe(F.col("key")))
        kept = [F.any_value(c).alias(c) for c in known.columns if c != "key"]
        return met.groupBy("key").agg(*kept, *[c.alias(k) for k, c in firsts.items()])

    before = lambda a, b: a.isNotNull() & (b.isNull() | (a < b))
    proposed = rows.groupBy(F.col("id").alias("key")).agg(first("propose", F.lit(True)).alias("proposed"))
    later = F.col("at") > F.col("proposed")
    known = after(proposed, v=first("validate", later), j=first("reject", later), k=first("revoke", later))
    known = known.withColumn("revoked", F.least("k", F.when(before(F.col("j"), F.col("v")), F.col("j"))))
    known = known.withColumn("validated", F.when(before(F.col("v"), F.col("revoked")), F.col("v"))).select("key", "proposed", "revoked", "validated")
    within = (F.col("at") > F.col("validated")) & (F.col("revoked").isNull() | (F.col("at") < F.col("revoked")))
    known = after(known, promoted=first("promote", within))

    def judged(again: bool) -> Column:
        past = lambda c: F.coalesce((F.col("at") >= F.col(c)) if again else (F.col("at") > F.col(c)), F.lit(False))
        named = lambda c: F.col("command") == c
        return (
            F.when(named("propose"), F.when(past("proposed"), "already proposed")).when(~past("proposed"), "unknown entry")
            .when(named("validate"), F.when(past("revoked"), "revoked").when(past("promoted"), "promoted").when(past("validated"), "already validated"))
            .when(named("reject"), F.when(past("validated"), "already validated").when(past("revoked"), "revoked"))
            .when(named("revoke"), F.when(past("revoked"), "already revoked"))
            .when(named("promote"), F.when(~past("validated"), "not validated").when(past("revoked"), "revoked").when(past("promoted"), "already promoted"))
            .otherwise("unknown command")
        )

    out = rows.join(known, F.col("id").eqNullSafe(F.col("key"))).withColumns({"once": judged(False), "again": judged(True)})
    out = out.withColumn("n", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times"))))
    error = F.when(F.col("n") == 1, F.col("once")).otherwise(F.col("again"))
    return out.select("id", "seq", "command", error.isNull().alias("accepted"), error.alias("error"))


def proposal_metrics(proposals: DataFrame) -> DataFrame:
    """Count and mean latency (ms, whole) by state of proposals(state, created, finished)."""
    ms = ((F.unix_micros(F.col("finished").cast("timestamp")) - F.unix_micros(F.col("created").cast("timestamp"))) / 1000).cast("long")
    return proposals.groupBy("state").agg(F.count("*").alias("n"), F.avg(ms).alias("mean_latency_ms"))


def tile_share(entries: DataFrame) -> DataFrame:
    """Per profile: its memories and share of all."""
    counts = collective_profiles(entries)
    total = entries.agg(F.count("*").alias("total"))
    return counts.crossJoin(F.broadcast(total)).withColumn("share", F.col("memory_count") / F.col("total")).drop("total")


def tile_validation(entries: DataFrame) -> DataFrame:
    """Per profile: promoted, validated, revoked and pending entries."""
    revoked, seen, promoted = F.coalesce("is_revoked", F.lit(False)), F.col("validated_at").isNotNull(), F.coalesce("is_promoted", F.lit(False))
    return entries.groupBy("source_profile").agg(
        F.count_if(promoted & ~revoked).alias("promoted"), F.count_if(seen & ~revoked).alias("validated"), F.count_if(revoked).alias("revoked"), F.count_if(~seen & ~revoked & ~promoted).alias("pending")
    )


def tile_activity(events: DataFrame, last: int = 8) -> DataFrame:
    """The latest events of all, newest first by (memory_date, id)."""
    rows = events.where("memory_date is not null").orderBy(F.desc("memory_date"), F.desc("id")).limit(last)
    return rows.withColumn("rank", F.row_number().over(W.orderBy(F.desc("memory_date"), F.desc("id"))).cast("long"))


def authorization_active(rows: DataFrame, at: Column) -> DataFrame:
    """transfer_active holds to the expiry inclusive and needs no revocation; session_active ends before it."""
    return rows.withColumn("transfer_active", F.col("revoked_at").isNull() & (F.col("starts_at") <= at) & (at <= F.col("expires_at"))).withColumn(
        "session_active", (F.col("starts_at") <= at) & (at < F.col("expires_at"))
    )


def capability_allowed(requests: DataFrame) -> DataFrame:
    """Requests(authenticated, participant_id, session_participant_id, capability, capabilities): allowed only if all are known to hold."""
    ok = F.col("authenticated") & (F.col("participant_id") == F.col("session_participant_id")) & F.array_contains("capabilities", F.col("capability"))
    return requests.withColumn("allowed", F.coalesce(ok, F.lit(False)))
