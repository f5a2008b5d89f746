"""Closed forms of folds, overlap joins and fail-closed rules against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from attestry.functions import dates
from attestry.operators import evidence as ev
from attestry.operators import governance as gv
from attestry.operators import temporal as tp
from attestry.operators import transfer as tr


def slow_fold(log):
    """Commands of one id in order of (seq, command), one by one."""
    known = validated = promoted = revoked = False
    out = []
    for seq, command in sorted(log, key=lambda x: (x[0] if x[0] is not None else -(1 << 63), x[1] or "")):
        error = None
        if command == "propose":
            error, known = ("already proposed", known) if known else (None, True)
        elif not known:
            error = "unknown entry"
        elif command == "validate":
            error = "revoked" if revoked else "promoted" if promoted else "already validated" if validated else None
            validated |= error is None
        elif command == "reject":
            error = "already validated" if validated else "revoked" if revoked else None
            revoked |= error is None
        elif command == "revoke":
            error = "already revoked" if revoked else None
            revoked |= error is None
        elif command == "promote":
            error = "not validated" if not validated else "revoked" if revoked else "already promoted" if promoted else None
            promoted |= error is None
        else:
            error = "unknown command"
        out.append((seq, command, error is None, error))
    return out


def test_lifecycle_without_a_fold(spark):
    """Short random logs of many ids: null ids, seqs and commands, ties and repeated rows."""
    rng = random.Random(5)
    kinds = ["propose", "validate", "reject", "revoke", "promote", "else", None]
    rows = [(i if i else None, rng.choice([None, *range(9)]) if i % 5 == 0 else s, rng.choice(kinds)) for i in range(400) for s in range(rng.randrange(9))]
    rows += [(i, s, c) for i, s, c in rows if i and i % 3 == 0]
    got = gv.fold_commands(spark.createDataFrame(rows, "id long, seq long, command string"))
    assert got.columns == ["id", "seq", "command", "accepted", "error"]
    want = [(i, *r) for i in {r[0] for r in rows} for r in slow_fold([(s, c) for k, s, c in rows if k == i])]
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, want))
    assert gv.fold_commands(spark.createDataFrame([], "id long, seq long, command string")).count() == 0


def test_one_id_may_be_the_whole_log(spark):
    """A log of a million rows of one id is folded without a task that holds it, and without Python."""
    n = 1_000_000
    kind = F.element_at(F.array(*[F.lit(x) for x in ("validate", "promote", "propose", "reject", "revoke")]), (F.col("id") % 5 + 1).cast("int"))
    log = spark.range(n).select(F.lit(7).alias("id"), F.col("id").alias("seq"), F.when(F.col("id") < n // 2, F.lit("promote")).otherwise(kind).alias("command"))
    out = gv.fold_commands(log)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Pandas" not in plan and "Window" not in plan
    assert {(r["seq"], r["command"]) for r in out.where("accepted").collect()} == {(n // 2 + 2, "propose"), (n // 2 + 3, "reject")}
    assert out.count() == n


INTERVAL = "evidence_id long, subject_type string, subject_id string, state string, start timestamp_ntz, end timestamp_ntz"


def test_overlaps_against_all_pairs(spark):
    from datetime import datetime, timedelta

    rng = random.Random(3)
    zero = datetime(1969, 12, 28)
    rows = []
    for i in range(160):
        start = zero + timedelta(microseconds=rng.choice([rng.randrange(10**12), 3600 * 10**6 * rng.randrange(200)]))
        rows.append((i % 150, "user", "ab"[i % 2], "xyz"[i % 3], start, start + timedelta(microseconds=rng.choice([0, 1, 10**6, 3599999999, 86399999999, 10**12]))))
    got = tp.overlapping(spark.createDataFrame(rows, INTERVAL), ["subject_type", "subject_id"]).select("l.evidence_id", "r.evidence_id", "l.start", "r.start")
    want = [(min(a[0], b[0]), max(a[0], b[0])) for k, a in enumerate(rows) for b in rows[k + 1 :] if a[2] == b[2] and a[0] != b[0] and a[4] <= b[5] and b[4] <= a[5]]
    assert sorted((r[0], r[1]) for r in got.collect()) == sorted(want) and len(want) > 300
    assert tp.overlapping(spark.createDataFrame([], INTERVAL), ["subject_id"]).count() == 0


def test_a_hot_subject_fills_many_bins(spark):
    """40,000 intervals of one subject: pairs meet by bin, not by subject."""
    start = F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, cast(id as decimal(18, 6)))")
    long = spark.range(40_000).select(F.col("id").alias("evidence_id"), F.col("id").cast("string").alias("state"), start.alias("start"))
    short = spark.range(0, 40_000, 10).select((F.col("id") + 200_000).alias("evidence_id"), F.lit("other").alias("state"), start.alias("start"))
    rows = long.withColumn("end", F.col("start") + F.expr("interval 59 seconds")).union(short.withColumn("end", F.col("start") + F.expr("interval 30 seconds")))
    got = tp.contradictions(rows.withColumns({"subject_type": F.lit("user"), "subject_id": F.lit("s")}))
    assert "__bin" in got._jdf.queryExecution().executedPlan().toString()
    # a short interval lies within those of the half minute before it
    assert got.count() == sum(min(k, 29) + 1 for k in range(0, 40_000, 10))


def test_support_must_be_supplied(spark):
    rows = [(1, ["a", "b"], [], ["a", "b"], [], ["a"]), (2, ["a"], [], ["a"], [], ["a", "z"]), (3, ["a"], ["c", None], ["a", "c"], [None], ["a"]), (4, [], [], [], [], []), (5, None, None, None, None, None), (6, ["a"], ["c"], ["a", "c"], [None, "c"], ["a"])]
    lists = ", ".join(f"{k}_evidence_ids array<string>" for k in ("supporting", "contradictory", "validated", "current", "supplied"))
    got = {r["candidate_id"]: r["errors"] for r in ev.candidate_errors(spark.createDataFrame(rows, f"candidate_id long, {lists}")).collect()}
    assert got == {1: ["missing_support"], 2: [], 3: [], 4: ["missing_support"], 5: ["missing_support"], 6: ["contradictory_and_current"]}


def test_unknown_conditions_are_refused(spark):
    asked = spark.createDataFrame([("c", None, None, "m", "a", "s"), ("c", "candidate", None, "m", "a", "s"), ("c", "candidate", "review_required", None, "a", "s"), ("c", "candidate", "applicable", None, "a", "s")], "candidate_id string, status string, decision string, mechanism string, actor string, scope string")
    assert [(r["allowed"], r["error"]) for r in tr.authorize(asked).collect()] == [(False, "not_a_candidate"), (False, "decided_against"), (False, "review_pending"), (True, None)]
    kinds = "status string, decision string, candidate_id string, authorized_at long, expires_at long, revoked boolean, adopted_at long, evidence_ids array<string>, source_profile string, model_profiles array<string>, model_id string"
    whole = ("candidate", "applicable", "c", 1, 9, False, 5, ["e"], "p", ["p"], "m")
    for k, name in enumerate(kinds.split(", ")[:10]):
        if k == 2:
            continue
        row = spark.createDataFrame([tuple(None if i == k else x for i, x in enumerate(whole))], kinds)
        assert not tr.adopt(row).first()["adoptable"], name
    assert tr.adopt(spark.createDataFrame([whole], kinds)).first()["adoptable"]
    asks = "status string, representation_status string, transfer_id string, r_transfer_id string, reason string, authorization_revoked boolean, model_status string, rollback boolean"
    for row, error in (((None, "adopted", "t", "t", "authorization_revoked", True, None, False), "not_adopted"), (("adopted", "adopted", "t", None, "authorization_revoked", True, None, False), "other_transfer"), (("adopted", "adopted", "t", "t", "authorization_revoked", None, None, False), "authorization_stands"), (("adopted", "adopted", "t", "t", None, True, None, False), "reason")):
        assert tr.revoke(spark.createDataFrame([row], asks)).first()["error"] == error


@pytest.mark.parametrize("text", ["  became active.", "x became  .", ""])
def test_changes_need_a_subject_and_a_state(text):
    assert all(c["subject"] and c["new"] for c in dates.changes(text))
