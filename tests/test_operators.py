from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attestry.functions import text as tx
from attestry.operators import entities as en
from attestry.operators import evidence as ev
from attestry.operators import federation as fd
from attestry.operators import governance as gv
from attestry.operators import graph as gr
from attestry.operators import histories as hs
from attestry.operators import models as mm
from attestry.operators import retrieval as rt
from attestry.operators import temporal as tp
from attestry.operators import transfer as tr
from attestry.sources import profiles

ENTRY = "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean, validated_at string"


@pytest.fixture(scope="module")
def entries(spark):
    return spark.createDataFrame([
        (1, "h:a", "m1", True, False, "2024"), (2, "h:a", "m2", True, False, None), (3, "h:b", "m1", True, True, "2024"), (4, "h:b", "m2", False, False, "2024"), (5, "h:b", "m3", None, None, None), (6, "h:a", "m1", True, False, "2024"),
    ], ENTRY)


@pytest.fixture(scope="module")
def memories(spark):
    return spark.createDataFrame([
        ("h:a", "m1", "red apple tree", "2024-01-05", "day"), ("h:a", "m2", "green apple apple", "bad", "day"), ("h:b", "m1", "red", "2024-01-05", "day"), ("h:b", "m2", "  ", None, "unknown"), ("h:b", "m3", "red  apple tree", "2024-01-06", "unknown"),
    ], "source_profile string, origin_memory_id string, content string, event_date string, event_date_precision string")


def ids(df, c="entry_id"):
    return [r[c] for r in df.orderBy("rank").collect()]


def test_governance_and_states(entries):
    assert sorted(r["id"] for r in gv.governed_entries(entries).collect()) == [1, 2, 6]
    states = {(r["state"], r["id"]) for r in gv.lifecycle_states(entries).collect()}
    assert {("proposed", 2), ("promoted", 3), ("revoked", 3), ("validated", 4), ("proposed", 5)} <= states and ("validated", 3) not in states and ("rejected", 3) not in states
    empty = gv.collective_counts(entries.where("false")).first()
    assert (empty["total"], empty["promoted"]) == (0, 0)


def test_profile_resolution(entries):
    assert gv.resolve_profile(entries, "a") == "h:a" and gv.resolve_profile(entries, "x:y") == "x:y" and gv.resolve_profile(entries, "zz") == "zz"
    other = entries.union(entries.limit(1).withColumn("source_profile", F.lit("k:A")))
    with pytest.raises(ValueError):
        gv.resolve_profile(other, "a")


def test_ingest_first_hash_wins(entries, memories):
    got = {(r["source_profile"], r["origin_memory_id"]): r["status"] for r in gv.ingest(memories).collect()}
    assert got["h:a", "m1"] == "proposed" and got["h:b", "m3"] == "duplicate"
    known = gv.ingest(memories, entries.where("id = 2"))
    assert {r["status"] for r in known.where("origin_memory_id = 'm2' and source_profile = 'h:a'").collect()} == {"existing"}
    revoked = gv.duplicate_revocations(entries, memories).collect()
    assert {(r["id"], r["kept_id"]) for r in revoked} == {(5, 1), (6, 1)}


def test_command_fold(spark):
    log = [(1, 1, "validate"), (1, 2, "propose"), (1, 3, "promote"), (1, 4, "validate"), (1, 5, "promote"), (1, 6, "promote"), (1, 7, "revoke"), (2, 1, "propose"), (2, 2, "reject"), (2, 3, "validate")]
    got = {(r["id"], r["seq"]): r["error"] for r in gv.fold_commands(spark.createDataFrame(log, "id long, seq long, command string")).collect()}
    assert got == {(1, 1): "unknown entry", (1, 2): None, (1, 3): "not validated", (1, 4): None, (1, 5): None, (1, 6): "already promoted", (1, 7): None, (2, 1): None, (2, 2): None, (2, 3): "revoked"}


def test_boundaries_of_authorizations(spark):
    t = lambda d: datetime(2024, 1, d)
    rows = spark.createDataFrame([(t(1), t(5), None), (t(1), t(4), t(2)), (t(6), t(9), None)], "starts_at timestamp, expires_at timestamp, revoked_at timestamp")
    got = gv.authorization_active(rows, F.lit(t(5)).cast("timestamp")).collect()
    assert [(r["transfer_active"], r["session_active"]) for r in got] == [(True, False), (False, False), (False, False)]


def test_keyword_orders_and_limits(entries, memories):
    assert ids(rt.bm25(entries, memories, "apple")) == [2, 1, 6]
    assert ids(rt.bm25(entries, memories, "Red!", profile="h:a")) == [1, 6]
    assert rt.bm25(entries, memories, "apple", limit=0).count() == 0 and rt.bm25(entries, memories, "?!").count() == 0
    assert ids(rt.bm25(entries, memories, "apples", stem=True)) == [2, 1, 6]


def test_semantic_skips_unusable_vectors(spark, entries):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 0.0]), (6, [1.0, 0.0]), (3, [1.0, 0.0]), (4, [1.0])], "id long, embedding array<float>")
    e = entries.join(v, "id", "left")
    assert ids(rt.semantic(e, [1.0, 0.0])) == [1, 6]
    assert ids(rt.legacy_vector_search(e, [0.0, 0.0])) == [2, 1, 6]
    with pytest.raises(ValueError):
        rt.semantic(e, [0.0, 0.0])


def test_event_window_and_recency(entries, memories):
    assert ids(rt.event_window(entries, memories, "2024-01-05", "2024-01-05")) == [1, 6]
    m = memories.withColumn("timestamp", F.lit("x")).withColumn("created_at", F.col("event_date"))
    got = rt.recency(entries, m, "2024-01-06 00:00:00").orderBy("rank").collect()
    assert [r["entry_id"] for r in got] == [6, 1] and got[0]["score"] == pytest.approx(0.5)


def test_fusion_arithmetic(spark):
    rows = [("keyword", 1, 1), ("semantic", 1, 1), ("graph", 1, 1), ("temporal", 1, 1), ("keyword", 2, 2), ("keyword", 2, 5), ("semantic", 3, 2)]
    ch = spark.createDataFrame(rows, "channel string, entry_id long, rank long").withColumn("score", F.lit(1.0))
    got = {r["entry_id"]: r for r in rt.fuse(ch).collect()}
    assert got[1]["fused_score"] == pytest.approx(4 / 61) and got[2]["fused_score"] == pytest.approx(1 / 62) and got[2]["fused_rank"] == 2 and got[3]["fused_rank"] == 3
    only = rt.fuse(ch, spark.createDataFrame([(2,), (3,)], "entry_id long"), weights={"keyword": 2.0})
    assert {r["entry_id"]: r["fused_score"] for r in only.collect()} == {2: pytest.approx(2 / 61), 3: pytest.approx(1 / 61)}
    assert [r["entry_id"] for r in rt.candidates(ch, 2).orderBy("rank").collect()] == [1, 2]


def test_rerank_and_metrics(spark):
    fused = spark.createDataFrame([(1, 0.3, 1), (2, 0.2, 2), (3, 0.1, 3)], "entry_id long, fused_score double, fused_rank long")
    text = spark.createDataFrame([(1, "nothing"), (2, "green apple"), (3, "apple")], "entry_id long, content string")
    got = rt.rerank(fused, text, rt.lexical_score("green apple"), 3, 2).orderBy("reranker_rank").collect()
    assert [(r["entry_id"], r["rank_change"]) for r in got] == [(2, 1), (3, 1)]
    with pytest.raises(Exception, match="candidate without content"):
        rt.rerank(fused, text.where("entry_id > 1"), rt.lexical_score("x")).collect()
    with pytest.raises(Exception, match="not finite"):
        rt.rerank(fused, text, lambda c: F.lit(float("nan"))).collect()
    by_model = rt.rerank(fused, text, rt.model_scorer(lambda pairs: [len(t) for _, t in pairs], "q"), 3, 3)
    assert by_model.orderBy("reranker_rank").first()["entry_id"] == 2
    res = spark.createDataFrame([(1, 10, 1), (1, 11, 2), (2, 20, 1)], "query_id long, entry_id long, rank long")
    rel = spark.createDataFrame([(1, 11), (1, 12), (2, 21), (3, 30)], "query_id long, entry_id long")
    m = {r["query_id"]: (r["precision"], r["recall"], r["reciprocal_rank"]) for r in rt.retrieval_metrics(res, rel, 5).collect()}
    assert m == {1: (0.5, 0.5, 0.5), 2: (0.0, 0.0, 0.0), 3: (0.0, 0.0, 0.0)}
    assert rt.macro_average(rt.retrieval_metrics(res, rel, 5)).first()["mean_recall"] == pytest.approx(0.5 / 3)


def test_hybrid_checks_limits(entries, memories):
    with pytest.raises(ValueError):
        rt.hybrid(entries, memories, "x", limit=51)
    got = rt.hybrid(entries, memories, "apple", window=("2024-01-05", "2024-01-05"))
    assert {r["entry_id"]: r["temporal_relevant"] for r in got.collect()} == {1: True, 2: False, 6: True}


def test_graph_edges_and_first_seed(spark, entries):
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.99, 0.1]), (6, [0.0, 1.0]), (3, [1.0, 0.0])], "id long, embedding array<float>")
    e = entries.join(v, "id", "left")
    for block in (1, 2, 100):
        got = {(r["source_id"], r["target_id"]) for r in gr.similarity_edges(e, 0.5, block=block).collect()}
        assert got == {(1, 2), (2, 1)}
    edges = spark.createDataFrame([(1, 2, 0.6), (6, 2, 0.9), (1, 4, 0.99), (1, 6, 0.5)], "source_id long, target_id long, similarity double")
    seeds = spark.createDataFrame([(1, 1), (6, 2)], "entry_id long, seed_pos long")
    got = {r["entry_id"]: r["score"] for r in gr.expand(seeds, edges, e, 2).collect()}
    assert got == {2: 0.6}  # the ungoverned neighbour took a place; the first seed's score stays
    assert gr.nodes(e).count() == 2


def spans(spark, rows):
    return spark.createDataFrame(rows, "evidence_id long, state string, start_time string, end_time string, precision string").withColumns({"subject_type": F.lit("s"), "subject_id": F.lit("1")})


@pytest.mark.parametrize("a,b,want", [
    (("2024-01-01", "2024-01-02"), ("2024-01-03", "2024-01-04"), "before"), (("2024-01-01", "2024-01-03"), ("2024-01-03", "2024-01-04"), "meets"), (("2024-01-01", None), ("2024-01-01", None), "meets"),
    (("2024-01-02", "2024-01-05"), ("2024-01-01", "2024-01-04"), "after"), (("2024-01-01", "2024-01-05"), ("2024-01-01", "2024-01-05"), "at"), (("2024-01-01", "2024-01-05"), ("2024-01-02", "2024-01-03"), "contains"),
    (("2024-01-01", "2024-01-05"), ("2024-01-01", "2024-01-03"), "started_by"), (("2024-01-02", "2024-01-03"), ("2024-01-01", "2024-01-05"), "during"), (("2024-01-01", "2024-01-03"), ("2024-01-02", "2024-01-05"), "overlaps"),
])
def test_exact_relations(spark, a, b, want):
    rows = spans(spark, [(1, "x", *a, "day"), (2, "y", *b, "day")])
    assert tp.pair_relations(tp.plain_intervals(rows), ["subject_id"]).first()["relation"] == want


def test_precision_bounds(spark):
    rows = spans(spark, [(1, "x", "2024", None, "year"), (2, "x", "2024-02", None, "month"), (3, "x", "2024-02-03", "2024-02-05", "day"), (4, "x", "2024-02-03T04:05:06Z", None, "second"), (5, "x", "2024", None, "day"), (6, "x", None, None, "day"), (7, "x", "2024-01-01", None, "unknown"), (8, "x", "2024-02-05", "2024-02-03", "day")])
    got = {r["evidence_id"]: (str(r["start"]), str(r["end"])) for r in tp.precision_intervals(rows).collect()}
    assert got == {
        1: ("2024-01-01 00:00:00", "2024-12-31 23:59:59.999999"), 2: ("2024-02-01 00:00:00", "2024-02-29 23:59:59.999999"), 3: ("2024-02-03 00:00:00", "2024-02-05 23:59:59.999999"), 4: ("2024-02-03 04:05:06", "2024-02-03 04:05:06"),
    }
    assert tp.plain_intervals(rows).where("evidence_id in (1, 2, 5)").count() == 0


def test_contradictions_need_certain_overlap(spark):
    rows = spans(spark, [(1, "open", "2024-01-01", None, "day"), (2, "shut", "2024-01-01", None, "day"), (3, "shut", "2024-01-01T05:00:00", None, "hour"), (4, "open", "2024-01-02", None, "day")])
    got = {(r["left_id"], r["right_id"], r["relation"]) for r in tp.contradictions(tp.precision_intervals(rows)).collect()}
    assert got == {(1, 2, "at"), (1, 3, "contains")}
    part = spans(spark, [(1, "a", "2024-01-01", "2024-01-03", "day"), (2, "b", "2024-01-02", "2024-01-05", "day")])
    assert tp.contradictions(tp.precision_intervals(part)).count() == 0


def history(spark, *states):
    rows = [("s", "1", h, i, h * 100 + i + 1, s) for h, seq in enumerate(states) for i, s in enumerate(seq)]
    return spark.createDataFrame(rows, "subject_type string, subject_id string, history_id long, position long, evidence_id long, state string")


@pytest.mark.parametrize("states,kind", [
    (["aaa"], "stable"), (["ab"], "transition"), (["aba"], "reversal"), (["abab"], "oscillation"), (["ab", "ac"], "divergent"), (["ab", "a"], "incomplete"), (["ab", "ab"], "transition"),
])
def test_trajectory_kinds(spark, states, kind):
    assert hs.trajectories(history(spark, *states)).first()["kind"] == kind


def test_uncertain_trajectory_and_runs(spark):
    h = history(spark, "aabbbc")
    flag = spark.createDataFrame([("s", "1", 0, True)], "subject_type string, subject_id string, history_id long, uncertain boolean")
    assert hs.trajectories(h, flag).first()["kind"] == "uncertain"
    runs = tp.stable_runs(h)
    assert [(r["state"], r["length"]) for r in runs.orderBy("run").collect()] == [("a", 2), ("b", 3), ("c", 1)]
    assert [(r["index"], r["score"], r["persistent"]) for r in tp.change_points(runs).orderBy("index").collect()] == [(3, 2, True), (6, 1, False)]


def test_history_comparison_counts_tails_twice(spark):
    h = history(spark, "abc", "ax")
    d = hs.divergence(hs.compare_histories(h.where("history_id = 0"), h.where("history_id = 1"))).first()
    assert (d["comparison_count"], d["shared_state_count"], d["divergent_state_count"], d["left_only_count"], d["first_divergence_index"]) == (3, 1, 2, 1, 1)


def test_similarity_threshold_edge(spark):
    rows = spark.createDataFrame([tuple([1.0] * 11), tuple([0.8] * 11), tuple([0.79] * 11)], ", ".join(f"{k} double" for k in ev.SIGNALS))
    got = ev.similarity(rows).collect()
    assert [r["is_candidate"] for r in got] == [True, True, False] and got[0]["score"] == pytest.approx(1.0) and "incomplete_provenance" in got[1]["reasons"]


def test_near_duplicates(spark):
    rows = [(1, "The quick brown fox jumps over it"), (2, "the QUICK brown fox, jumps over it!"), (3, "The quick brown fox jumped over it"), (4, "other words altogether here"), (5, ""), (6, None)]
    got = {(r["left_id"], r["right_id"]): r["kind"] for r in ev.near_duplicates(spark.createDataFrame(rows, "id long, text string")).collect()}
    assert got == {(1, 2): "exact", (1, 3): "near"}


def test_jaccard_pairs_lose_nothing(spark):
    import random

    rng = random.Random(0)
    rows = [(i, " ".join(rng.sample("abcdefghijkl", rng.randint(1, 9)))) for i in range(120)]
    got = {(r["left_id"], r["right_id"]) for r in ev.jaccard_pairs(spark.createDataFrame(rows, "id long, text string"), 0.6).collect()}
    seen, lead = {}, []
    for i, t in rows:
        if seen.setdefault(t, i) == i:
            lead.append((i, set(t.split())))
    assert got == {(a, b) for a, x in lead for b, y in lead if a < b and len(x & y) / len(x | y) >= 0.6}


def test_mentions_and_relations(spark):
    assert en.find_mentions("The Blue Harbor project uses python and Python.") == [("Blue Harbor", "project", 0.9), ("python", "technology", 0.95)]
    assert en.find_mentions("The Current State repository") == [] and en.find_mentions(None) == []
    assert en.find_relationships("Git uses Linux.", ["Git", "Linux"]) == [("Git", "uses", "Linux", 0.95)]
    assert en.find_relationships("It may be that Git uses Linux.", ["Git", "Linux"]) == []
    assert en.find_relationships("Git stops. It uses Linux.", ["Git", "Linux"]) == [] and en.find_relationships("Git one two three four five uses Linux", ["Git", "Linux"]) == []


def test_resolution_and_rebuild(spark, entries):
    m = spark.createDataFrame([("h:a", "m1", "Git uses Linux."), ("h:a", "m2", "The Red Barn project uses Git.")], "source_profile string, origin_memory_id string, content string")
    out = en.rebuild(entries.where("id < 6"), m)
    assert {(r["canonical_name"], r["mention_count"]) for r in out["entities"].collect()} == {("Git", 2), ("Linux", 1), ("Red Barn", 1)}
    assert {r["decision"] for r in out["resolutions"].collect()} == {"same_entity"}
    assert out["relationships"].count() == 2 and out["relationship_evidence"].count() == 2 and out["entity_evidence"].count() == 4
    two = spark.createDataFrame([("1", "Git", "technology", "active"), ("2", "GIT", "technology", "active")], "entity_id string, canonical_name string, entity_type string, status string")
    assert {r["decision"] for r in en.resolve(out["mentions"].where("mention_text in ('Git', 'Linux')"), two).collect()} == {"ambiguous", "new_entity"}


def test_model_minimums(spark):
    schema = "observation_id string, source_profile string, source_memory_id string, evidence_ids array<string>, entity_ids array<string>, relationship_ids array<string>, temporal_scope array<string>, concept_key string, observation_type string, confidence double"
    rows = [("o1", "p", "m", ["e1"], ["x"], [], [], "k", "fact", 0.5), ("o2", "p", "m", ["e2"], ["x"], [], [], "k", "fact", 1.0), ("o3", "p", "m", ["e3"], [], [], [], "solo", "fact", 1.0), ("o4", "p", "m", ["e4"], [], [], [], "same", "fact", 1.0), ("o5", "p", "m", ["e4"], [], [], [], "same", "fact", 1.0)]
    got = mm.candidates(spark.createDataFrame(rows, schema)).collect()
    assert [(r["key"], r["confidence"]) for r in got] == [("concept:k", 0.75)]
    texts = spark.createDataFrame([(["x"],), (["x", "y"],), ([],)], "v array<string>").select(mm.tuple_text(F.col("v")).alias("t")).collect()
    assert [r["t"] for r in texts] == [repr(("x",)), repr(("x", "y")), repr(())]


def test_transfer_rules(spark):
    s = spark.createDataFrame([("a", "k1"), ("a", "k1"), ("b", "k2")], "source_profile string, knowledge_id string")
    c = tr.candidates(s, spark.createDataFrame([("a",), ("b",)], "destination_profile string"))
    assert {(r["source_profile"], r["destination_profile"]) for r in c.collect()} == {("a", "b"), ("b", "a")} and c.count() == 2
    names = sorted({*tr.BENEFIT, *tr.APPLICABLE})
    row = {n: 1.0 for n in names} | {"prior_transfer_redundancy": 0.0, "contradiction": "none", "i": 1}
    rows = [row, row | {"contradiction": "strong", "i": 2}, row | {"temporal_compatibility": 0.0, "i": 3}, {n: 0.0 for n in names} | {"prior_transfer_redundancy": 0.0, "contradiction": "none", "i": 4}]
    got = {r["i"]: r for r in tr.applicability(spark.createDataFrame(rows)).collect()}
    assert [got[i]["decision"] for i in (1, 2, 3, 4)] == ["applicable", "review_required", "not_applicable", "not_applicable"] and got[4]["reasons"] == ["insufficient_applicability_signals"]


def test_sync_outcomes(spark):
    steps = [("e1", 1, 1, "applied"), ("e1", 1, 1, "duplicate"), ("e3", 3, 2, "retry"), ("e2", 2, 4, "diverged"), ("e2", 2, 2, "applied"), ("e0", 1, 9, "duplicate"), ("e4", 3, 1, "duplicate"), ("e5", 3, 2, "applied")]
    rows = [("p", e, s, v, i) for i, (e, s, v, _) in enumerate(steps)] + [("q", "e1", 2, 1, 0)]
    got = fd.sync_batch(spark.createDataFrame(rows, "participant_id string, exchange_id string, sequence long, version long, arrival long"))
    assert [r["outcome"] for r in got.where("participant_id = 'p'").orderBy("arrival").collect()] == [s[3] for s in steps]
    assert fd.retries(got).count() == 2


def test_sources(spark, tmp_path, memories):
    base = str(tmp_path / "profiles")
    memories.select(F.col("source_profile").alias("profile"), F.col("origin_memory_id").alias("id"), "content").write.partitionBy("profile").parquet(base)
    assert profiles.read_profiles(spark, base).count() == 5
    local = memories.select(F.col("source_profile").alias("profile"), F.col("origin_memory_id").alias("id"), "content")
    assert profiles.gather(local, local).where("agent = 'h' and profile = 'a'").count() == 2
    found = profiles.look_up(spark.createDataFrame([("x:a", "m1"), ("x:a", "zz")], "source_profile string, origin_memory_id string"), memories)
    assert sorted(r["content"] or "" for r in found.collect()) == ["", "red apple tree"]
    memories.createOrReplaceTempView("memory")
    with pytest.raises(ValueError):
        profiles.infer_memory_table(spark)
    log = str(tmp_path / "audit")
    rows = spark.createDataFrame([("1", "x"), ("2", "y")], "audit_id string, what string")
    profiles.append_audit(rows, log)
    profiles.append_audit(rows.union(spark.createDataFrame([("3", "z")], rows.schema)), log)
    assert spark.read.parquet(log).count() == 3


def test_rebuild_is_all_or_nothing(spark, tmp_path, entries, memories):
    path = str(tmp_path / "vectors")
    good = entries.where("id in (1, 2)")
    assert profiles.rebuild_embeddings(good, memories, path, 8) == 0 and spark.read.parquet(path).count() == 2
    bad = memories.withColumn("content", F.when(F.col("origin_memory_id") == "m2", "!!").otherwise(F.col("content")))
    assert profiles.rebuild_embeddings(good, bad, path, 8) == 1
    assert spark.read.parquet(path).count() == 2


def test_adoption_asks_all_that_must_agree(spark):
    """Every pair of AGREEMENTS alone stops an adoption, and each error has its code."""
    base = {
        "status": "candidate", "decision": "applicable", "authorized_at": 1, "adopted_at": 2, "expires_at": 3, "revoked": False, "source_profile": "p", "model_profiles": ["p"], "model_status": "active",
    }
    for _, one, two in tr.AGREEMENTS:
        value = ["x"] if one.endswith("_ids") or one == "temporal_scope" else base.get(one, "k")
        base |= {one: value, two: value}
    rows = [("fine", base)]
    for code, one, two in tr.AGREEMENTS:
        rows.append((code, base | {two: ["y"] if isinstance(base[two], list) else "other"}))
    rows += [("not_a_candidate", base | {"status": "adopted"}), ("not_applicable", base | {"decision": "review_required"}), ("authorization_revoked", base | {"revoked": True}), ("before_authorization", base | {"adopted_at": 0}),
             ("authorization_expired", base | {"adopted_at": 9}), ("model_of_other_profile", base | {"model_profiles": ["q"]}), ("model_not_current", base | {"model_status": "stale"}), ("analysis_of_other_candidate", base | {"n_candidate_id": None})]
    kind = lambda v: "array<string>" if isinstance(v, list) else "boolean" if isinstance(v, bool) else "int" if isinstance(v, int) else "string"
    schema = "want string, " + ", ".join(f"{k} {kind(v)}" for k, v in base.items())
    got = tr.adopt(spark.createDataFrame([(w, *r.values()) for w, r in rows], schema)).collect()
    for r in got:
        assert r["errors"] == ([] if r["want"] == "fine" else [r["want"]]) and r["adoptable"] == (r["want"] == "fine"), r["want"]


def test_every_cue_of_conjecture_suppresses():
    for cue in ("suggests", "suggest", "suggesting", "implies", "imply that", "implying", "indicates", "indicating", "appears to say", "appear to say", "seems to say", "probably", "possibly", "perhaps", "likely", "may", "might", "could"):
        found = en.find_relationships(f"It {cue} Python uses SQLite.", ["Python", "SQLite"])
        assert bool(found) == (cue == "imply that"), cue
    assert en.find_relationships("It appears. Python uses SQLite.", ["Python", "SQLite"]) and en.find_relationships("It seems so, Python uses SQLite.", ["Python", "SQLite"])


def test_versioned_names_and_unicode_keys(spark):
    assert [m[0] for m in en.find_mentions("GPT-4.1 and Qwen3, beside Devstral and Uvicorn.")] == ["Devstral", "GPT-4.1", "Qwen3", "Uvicorn"]
    rows = spark.createDataFrame([("\ufb01le \u2460",), ("FILE 1",), ("Stra\u00dfe",), ("STRASSE",), (None,)], "t string")
    keys = [r[0] for r in rows.select(tx.entity_key(rows["t"])).collect()]
    assert keys == ["file 1", "file 1", "strasse", "strasse", None]


def test_search_routes_reranks_and_explains(spark):
    entries = spark.createDataFrame([(i, "a:p", str(i), True, False, None) for i in range(1, 9)], "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean, validated_at date")
    memories = spark.createDataFrame([("a:p", str(i), "alpha beta " * (i % 3 + 1) + ("gamma" if i % 2 else "delta " * 6), "2024-01-0%d" % i, "day") for i in range(1, 9)], "source_profile string, origin_memory_id string, content string, event_date string, event_date_precision string")
    evidence = spark.createDataFrame([(1, "observed", 0.5), (1, "inferred", None)], "entry_id long, evidence_kind string, confidence double")
    seen = spark.createDataFrame([(1, "a:p", "1", "2024"), (1, "a:p", "1", "2024"), (2, "a:p", "9", "2024")], "entry_id long, source_profile string, origin_memory_id string, created_at string")
    out = {r["entry_id"]: r for r in rt.search(entries, memories, "gamma", limit=5, rerank_with=rt.lexical_score("gamma"), provenance=seen, evidence=evidence, window=("2024-01-01", "2024-01-02")).collect()}
    assert sorted(out) == [1, 2, 3, 5, 7] and sorted(r["rank"] for r in out.values()) == [1, 2, 3, 4, 5]
    assert out[2]["channels"] == ["temporal"] and out[3]["channels"] == ["keyword"]  # a channel that is asked for takes part whatever the route
    assert {i for i, r in out.items() if r["date_source"] == "event_date"} == {1, 2} and rt.search(entries, memories, " \n").count() == 0
    assert len(out[1]["provenance"]) == 1 and out[1]["evidence_count"] == 2 and out[3]["evidence_count"] is None and out[3]["provenance"] == []
    assert rt.admission("semantic") == ("keyword", "semantic", "graph", "entity", "temporal") and rt.admission("temporal") == ("keyword", "semantic", "temporal", "graph", "entity")
    assert rt.admission("relationship") == ("keyword", "semantic", "entity", "graph", "temporal") and rt.admission("hybrid") == ("keyword", "semantic", "temporal", "entity", "graph")
    assert tx.latin_only("plain caf\u00e9 1") and not tx.latin_only("mixed \u4e2d") and tx.intent_of("Who is  it") == "entity" and tx.intent_of("when, exactly") == "hybrid"
    asked = rt.search(entries, memories, "gamma", limit=5, route=False, window=("2024-01-01", "2024-01-02")).collect()
    assert {r["entry_id"] for r in asked if "temporal" in r["channels"]} <= {1, 2} and any(r["date_source"] == "event_date" for r in asked)
