"""Federation between instances: synchronization, receipts, trust, capabilities, conflicts, audit."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Peer state that a trust state stands for (fixed values).
TRUST = {"blocked": "blocked", "revoked": "revoked", "expired": "expired", "trusted": "trust_established"}


class Checkpoint:
    """Where a participant's stream stands: next sequence, version, and the exchanges seen.

    Sequences below next are duplicates by themselves, so only ids from next on could be
    new; of those seen, ids are kept in the state.
    """

    def __init__(self, next_sequence: int = 1, version: int = 0, seen=None):
        """seen holds ids: a set, or anything with add and in."""
        self.next, self.version, self.seen = next_sequence, version, set() if seen is None else seen

    def step(self, exchange_id: str, sequence: int, version: int) -> str:
        """Outcome of one exchange, in this order of tests; only an applied one moves the checkpoint."""
        if exchange_id in self.seen or sequence < self.next:
            return "duplicate"
        if sequence > self.next:
            return "retry"
        if version < self.version:
            return "duplicate"
        if version > self.version + 1:
            return "diverged"
        self.seen.add(exchange_id)
        self.next, self.version = sequence + 1, version
        return "applied"


def sync_batch(exchanges: DataFrame) -> DataFrame:
    """Outcome of exchanges(participant_id, exchange_id, sequence, version, arrival) in order of arrival; participants are independent folds."""

    def fold(log: pd.DataFrame) -> pd.DataFrame:
        log = log.sort_values(["arrival", "exchange_id"], kind="stable")
        at = Checkpoint()
        log["outcome"] = [at.step(e, int(s), int(v)) for e, s, v in zip(log["exchange_id"], log["sequence"], log["version"])]
        log["next_sequence"] = at.next
        return log[["participant_id", "exchange_id", "sequence", "version", "arrival", "outcome", "next_sequence"]]

    rows = exchanges.select("participant_id", "exchange_id", F.col("sequence").cast("long").alias("sequence"), F.col("version").cast("long").alias("version"), F.col("arrival").cast("long").alias("arrival"))
    return rows.groupBy("participant_id").applyInPandas(fold, "participant_id string, exchange_id string, sequence long, version long, arrival long, outcome string, next_sequence long")


def retries(synced: DataFrame) -> DataFrame:
    """Exchanges to be asked for again; no checkpoint moves."""
    return synced.where("outcome = 'retry'").select("participant_id", "exchange_id", "sequence", F.col("next_sequence").alias("expected"))


def receive(envelopes: DataFrame, at: int) -> DataFrame:
    """Receipts of envelopes(exchange_id, recipient_id, receiver_id, authenticated_at, expires_at, capabilities): an inactive session or a missing capability refuses, another's mail is rejected; a receipt never adopts."""
    active = (F.col("authenticated_at") <= at) & (F.lit(at) < F.col("expires_at"))
    state = F.when(~F.coalesce(active, F.lit(False)), "refused").when(~F.array_contains("capabilities", "receive_knowledge"), "refused").when(F.col("recipient_id") != F.col("receiver_id"), "rejected").otherwise("validated")
    reason = F.when(~F.coalesce(active, F.lit(False)), "session is not active").when(~F.array_contains("capabilities", "receive_knowledge"), "capability is not granted").when(F.col("recipient_id") != F.col("receiver_id"), "recipient mismatch")
    return envelopes.select("exchange_id", state.alias("state"), reason.alias("rejection_reason"), F.lit(False).alias("adoptable"))


def peer_states(trust: DataFrame) -> DataFrame:
    """Peer state of trust(participant_id, state); an unknown one is identified only, and trust alone makes no exchange eligible."""
    known = F.create_map(*[F.lit(x) for p in TRUST.items() for x in p])
    return trust.select("participant_id", F.coalesce(known[F.col("state")], F.lit("identified")).alias("peer_state"), F.lit(False).alias("exchange_eligible"))


def change_capabilities(grants: DataFrame) -> DataFrame:
    """grants(participant_id, capabilities, add, remove) with the sorted set after both."""
    return grants.select("participant_id", F.array_sort(F.array_except(F.array_union("capabilities", "add"), "remove")).alias("capabilities"))


def conflict_states(events: DataFrame) -> DataFrame:
    """State of each conflict after acknowledge and resolve events in order: open, acknowledged, resolved; resolving needs an acknowledgement first, and no winner is named."""
    first = events.groupBy("conflict_id").agg(F.min(F.when(F.col("action") == "acknowledge", F.col("seq"))).alias("a"), F.max(F.when(F.col("action") == "resolve", F.col("seq"))).alias("r"))
    return first.select("conflict_id", F.when(F.col("a").isNotNull() & (F.col("r") > F.col("a")), "resolved").when(F.col("a").isNotNull(), "acknowledged").otherwise("open").alias("state"))


def append_audit(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Audit rows that may be appended: ids that exist already, or come twice, are refused (left out)."""
    return new.dropDuplicates(["audit_id"]).join(existing.select("audit_id"), "audit_id", "left_anti")


def diagnostics(records: DataFrame) -> DataFrame:
    """(dimension, value, n): counts by event kind, outcome and participant, and all, in one pass over audit records."""
    rows = records.groupingSets([["event_kind"], ["outcome"], ["participant_id"], []], "event_kind", "outcome", "participant_id").agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    dimension = F.when(F.col("g") == 3, "event_kind").when(F.col("g") == 5, "outcome").when(F.col("g") == 6, "participant_id").otherwise("all")
    return rows.select(dimension.alias("dimension"), F.coalesce("event_kind", "outcome", "participant_id", F.lit("")).alias("value"), "n")


def audit_health(records: DataFrame) -> DataFrame:
    """Totals of audit records; healthy if all are attributable and no id repeats."""
    named = (F.coalesce(F.length(F.trim("actor_id")), F.lit(0)) > 0) & (F.coalesce(F.length(F.trim("participant_id")), F.lit(0)) > 0)
    out = records.agg(F.count("*").alias("total_events"), F.count_if(named).alias("attributable_events"), F.countDistinct("audit_id").alias("ids"))
    return out.select("total_events", "attributable_events", ((F.col("attributable_events") == F.col("total_events")) & (F.col("ids") == F.col("total_events"))).alias("audit_healthy"))


def propose_adoption(receipts: DataFrame) -> DataFrame:
    """Validated receipts(exchange_id, state, source_profile, destination_profile, knowledge_id) as transfer candidates in state proposed."""
    from attestry.functions import text as tx

    ok = receipts.where("state = 'validated' and source_profile <> destination_profile")
    return ok.select("exchange_id", tx.short_id("tc-", 24, F.col("source_profile"), F.col("destination_profile"), F.col("knowledge_id")).alias("candidate_id"), F.lit("proposed").alias("projection_state"))


def propagate_revocations(revocations: DataFrame, adoptions: DataFrame) -> DataFrame:
    """Adoptions hit by a remote revocation whose whole lineage (exchange, source profile, knowledge) is the same."""
    keys = ["exchange_id", "source_profile", "knowledge_id"]
    return adoptions.join(revocations.select(*keys).distinct(), keys, "left_semi").withColumn("status", F.lit("revoked"))
