"""Derived tables rebuilt as one version."""

import pytest

from attestry.operators import entities as en
from attestry.sources.store import Change, Store

ENTRY = "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean"
MEMORY = "source_profile string, origin_memory_id string, content string"


def tables(spark, text="Git depends on Linux. FastAPI contains JSON."):
    entries = spark.createDataFrame([(1, "p", "a", True, False), (2, "p", "b", True, False), (2, "q", "b", True, False), (3, "p", "c", True, True)], ENTRY)
    return entries, spark.createDataFrame([("p", "a", text), ("p", "b", text), ("q", "b", text), ("p", "c", text)], MEMORY)


def test_one_version_holds_all_tables(spark, tmp_path):
    store = Store(spark, f"file://{tmp_path}/k")
    assert en.rebuild_into(store, *tables(spark)) == 1
    assert set(store.manifest()["tables"]) == set(en.REBUILT)
    report = store.read("report").first().asDict()
    assert report == {"entries": 3, "mentions": 12, "entities": 4, "resolutions": 12, "ambiguous": 0, "entity_evidence": 12, "said": 2, "relationships": 2, "relationship_evidence": 2, "failed": 1}
    assert [r["collective_entry_id"] for r in store.read("failures").collect()] == [2]
    again = {r["relationship_id"] for r in store.read("relationships").collect()}
    assert en.rebuild_into(store, *tables(spark)) == 2 and {r["relationship_id"] for r in store.read("relationships").collect()} == again


@pytest.mark.parametrize("step", ["mentions", "entities", "entity_evidence", "relationships", "report"])
def test_a_crash_leaves_the_version_before(spark, tmp_path, monkeypatch, step):
    store = Store(spark, f"file://{tmp_path}/k")
    en.rebuild_into(store, *tables(spark))
    before = {n: sorted(map(str, store.read(n).collect())) for n in en.REBUILT}
    real = Change.replace

    def broken(self, name, rows, by=()):
        if name == step:
            raise OSError("lost")
        return real(self, name, rows, by)

    monkeypatch.setattr(Change, "replace", broken)
    with pytest.raises(OSError):
        en.rebuild_into(store, *tables(spark, "Python uses SQLite."))
    assert store.versions() == [1] and {n: sorted(map(str, store.read(n).collect())) for n in en.REBUILT} == before


def test_texts_are_extracted_once(spark, tmp_path, monkeypatch):
    asked = []
    real = en.extract_mentions
    monkeypatch.setattr(en, "extract_mentions", lambda *a, **k: asked.append(1) or real(*a, **k))
    store = Store(spark, f"file://{tmp_path}/k")
    en.rebuild_into(store, *tables(spark))
    assert len(asked) == 1
    plan = store.read("relationships")._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" not in plan


def test_mention_ids_are_made_on_reading(spark, tmp_path):
    """Neither mentions nor resolutions write an id a row, and both show the ids of a plain rebuild."""
    import uuid

    store = Store(spark, f"file://{tmp_path}/k")
    entries, memories = tables(spark)
    en.rebuild_into(store, entries, memories)
    manifest, plain = store.manifest(), en.rebuild(entries, memories)
    for name in ("mentions", "resolutions"):
        written = spark.read.parquet(*[f"{store.root}/{f}" for f in manifest["tables"][name]])
        assert "mention_id" not in written.columns
        assert store.read(name).columns == plain[name].columns and store.read(name).dtypes == plain[name].dtypes
        assert sorted(map(str, store.read(name).collect())) == sorted(map(str, plain[name].collect()))
    for r in store.read("mentions").collect():
        assert r["mention_id"] == str(uuid.uuid5(uuid.UUID(en.NAMESPACE), "|".join(str(r[c]) for c in en.MENTION_KEY)))
    entries = spark.createDataFrame([(None, "p", None, True, False), (7, None, "a", True, False)], ENTRY)
    each = entries.selectExpr("id as collective_entry_id", "source_profile", "origin_memory_id as source_memory_id", "named_struct('mention_text', 'Git', 'entity_type', 'technology', 'confidence', 0.95D) as m")
    made = en._with_ids(each)
    assert made.selectExpr(en.MENTION_ID, "mention_id as m").where("mention_id <> m").count() == 0
