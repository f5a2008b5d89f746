"""Names that rows of the engine may carry, and the rules between them."""

from __future__ import annotations

# Vocabularies of the data model.
EVIDENCE_LIFECYCLE = ("proposed", "validated", "promoted", "rejected", "revoked")
PRECISIONS = ("year", "month", "day", "hour", "minute", "second")
CHANNELS = ("keyword", "semantic", "temporal", "entity", "graph")

#: States of a machine that no move reaches or leaves.
FINAL = {"peer": ("blocked", "revoked", "expired")}
#: Allowed moves of the state machines, as machine: (from, to) pairs.
TRANSITIONS = {
    "mediation": (
        ("PROPOSED", "PRIVACY_FILTERING"), ("PRIVACY_FILTERING", "VALIDATING"), ("VALIDATING", "REJECTED"),
        ("VALIDATING", "READY_FOR_PROMOTION"), ("VALIDATING", "MANUAL_REVIEW"), ("MANUAL_REVIEW", "READY_FOR_PROMOTION"),
    ),
    "peer": (
        ("discovered", "identified"), ("identified", "trust_established"), ("trust_established", "authenticated"),
        ("authenticated", "authorized"), ("authorized", "exchange_eligible"),
    ),
    "model": (
        ("candidate", "validated"), ("candidate", "revoked"), ("validated", "active"), ("validated", "revoked"), ("active", "stale"),
        ("active", "superseded"), ("active", "revoked"), ("stale", "active"), ("stale", "superseded"), ("stale", "revoked"),
    ),
    "transfer": (
        ("available", "eligible"), ("eligible", "candidate"), ("eligible", "rejected"), ("candidate", "authorized"), ("candidate", "rejected"),
        ("candidate", "revoked"), ("authorized", "adopted"), ("authorized", "rejected"), ("authorized", "revoked"), ("adopted", "stale"),
        ("adopted", "superseded"), ("adopted", "revoked"), ("stale", "adopted"), ("stale", "superseded"), ("stale", "revoked"),
    ),
}
