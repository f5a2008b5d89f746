"""Relations found in the pass over the texts that finds their mentions."""

from attestry.operators import entities as en

ENTRY = "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean"
MEMORY = "source_profile string, origin_memory_id string, content string"
TEXT = "Git depends on Linux. The Blue Harbor project uses Python."


def test_one_pass_gives_what_two_give(spark):
    entries = spark.createDataFrame([(1, "p", "a", True, False), (2, "p", "b", True, False), (2, "q", "b", True, False), (3, "p", "c", True, True), (4, "p", "d", True, False), (4, "p", "d", True, False), (5, "p", "e", True, False)], ENTRY)
    memories = spark.createDataFrame([("p", "a", TEXT), ("p", "b", TEXT), ("q", "b", "Blue Harbor uses git."), ("p", "c", TEXT), ("p", "d", None), ("p", "e", TEXT), ("p", "e", "git uses linux")], MEMORY)
    columns = ["collective_entry_id", "source_profile", "source_memory_id", "subject", "predicate", "object"]
    want = en.extract_relationships(entries, memories, en.extract_mentions(entries, memories)).select(*columns).collect()
    got = en.said_in_texts(entries, memories).select(*columns).collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and len(want) > 8


def test_texts_of_single_entries_meet_one_join(spark):
    entries, memories = spark.createDataFrame([(1, "p", "a", True, False)], ENTRY), spark.createDataFrame([("p", "a", TEXT)], MEMORY)
    plan = en.said_in_texts(entries, memories)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and plan.count("ArrowEvalPython") == 1
