import uuid
from difflib import SequenceMatcher

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.functions import dates
from attestry.functions import text as tx
from attestry.functions import vectors as vx


def one(spark, value, f, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(f(F.col("v")).alias("r")).first()["r"]


@pytest.mark.parametrize("text,want", [("Straße,  NICHT!", "strasse nicht"), ("a_b  c", "a_b c"), ("Ärger—über", "ärger über"), ("", ""), (None, None)])
def test_normalize_observation(spark, text, want):
    assert one(spark, text, tx.normalize_observation) == want


@pytest.mark.parametrize("a,b,want", [("x y", "y x", 1.0), ("", "", 1.0), ("x", "", 0.0), ("a b c", "b c d", 0.5)])
def test_jaccard(spark, a, b, want):
    r = spark.createDataFrame([(a, b)], "a string, b string").select(tx.jaccard(tx.tokens(F.col("a")), tx.tokens(F.col("b"))).alias("j")).first()["j"]
    assert r == pytest.approx(want)


def test_sequence_ratio_is_the_library_ratio_above_its_bound(spark):
    a, b = "the quick brown fox", "the quick brown fix"
    assert tx.sequence_ratio(a, b, 0.5) == SequenceMatcher(None, a, b, autojunk=False).ratio()
    assert tx.sequence_ratio("abc", "xyz", 0.88) == 0.0
    r = spark.createDataFrame([(a, b), (None, b)], "a string, b string").select(tx.sequence_similarity(F.col("a"), F.col("b")).alias("s")).collect()
    assert [x["s"] for x in r] == [pytest.approx(0.947, abs=1e-3), None]


def test_uuid5_is_pythons(spark):
    ns = uuid.uuid4()
    assert one(spark, "a|b|ü", lambda c: tx.uuid5(ns.hex, c)) == str(uuid.uuid5(ns, "a|b|ü"))


@pytest.mark.parametrize("query,want", [
    ("when did it start", "temporal"), ("who is Ada", "entity"), ("what depends on this", "relationship"), ("exact words", "lexical"), ("plain words", "semantic"), ("who is related to Ada", "hybrid"), ("about ada", "entity"),
])
def test_query_intent(spark, query, want):
    assert one(spark, query, tx.query_intent) == want
    assert one(spark, query, lambda c: tx.route(tx.query_intent(c))) == tx.ROUTES[want]


@pytest.mark.parametrize("text,want", [("abc", "latin"), ("где", "non_latin"), ("abc где", "mixed"), ("12 !", "unknown")])
def test_script(spark, text, want):
    assert one(spark, text, tx.script) == want
    assert one(spark, text, tx.semantic_supported) == (want in ("latin", "unknown"))


def test_masking_handles_several_matches(spark):
    text = "a@b.c and d@e.f or 555-123-4567"
    assert one(spark, text, tx.masked) == "[REDACTED] and [REDACTED] or [REDACTED]"
    assert one(spark, text, tx.masked_fields) == ["email", "phone"]


@pytest.mark.parametrize("word,want", [("caresses", "caress"), ("ponies", "poni"), ("hopping", "hop"), ("hoping", "hope"), ("relational", "relat"), ("happy", "happi"), ("agreed", "agre"), ("sky", "sky"), ("straße", "straße")])
def test_stem(word, want):
    assert tx.stem(word) == want


def test_names(spark):
    assert one(spark, "  Foo_Bar (v2) ", tx.normalize_name) == "foo bar v2"
    assert one(spark, "ﬁne Ⅷ", tx.normalize_name_nfkc) == "fine viii"
    assert tx.match_terms("Foo-bar  a_b !!") == ["foobar", "a_b"]


def test_vectors(spark):
    v = vx.encode_text("Alpha beta, alpha", 16)
    assert np.linalg.norm(v) == pytest.approx(1.0) and (v == vx.encode_text("alpha BETA alpha", 16)).all()
    rows = spark.createDataFrame([([1.0, 0.0],), ([float("nan"), 1.0],), ([0.0, 0.0],), ([1.0],), (None,)], "e array<float>")
    assert [bool(r[0]) for r in rows.select(vx.usable(F.col("e"), 2)).collect()] == [True, False, False, False, False]
    with pytest.raises(ValueError):
        vx.literal([0.0, 0.0])
    enc = spark.createDataFrame([("hi there",), ("!!",), (None,)], "t string").select(vx.encode(F.col("t"), 8).alias("e")).collect()
    assert len(enc[0]["e"]) == 8 and enc[1]["e"] is None and enc[2]["e"] is None


@pytest.mark.parametrize("text,want", [
    ("It was on March 3, 2021.", [("at", "2021-03-03", None, "day")]), ("In March 2021", [("at", "2021-03", None, "month")]), ("since 1999", [("at", "1999", None, "year")]),
    ("from 2020-01-02 to 2020-02-03", [("during", "2020-01-02", "2020-02-03", "day")]), ("before the rain", [("before", None, None, "unknown")]), ("until then", []), ("", []), (None, []),
])
def test_temporal_expressions(text, want):
    assert [(e["relation"], e["start_time"], e["end_time"], e["precision"]) for e in dates.expressions(text)] == want


def test_dates_that_do_not_exist_raise():
    with pytest.raises(ValueError):
        dates.expressions("on February 30, 2020")


@pytest.mark.parametrize("text,want", [
    ("The door changed from open to shut.", [("The door", "open", "shut", "state_change")]), ("It was red, then became blue.", [("It", "red", "blue", "state_change")]),
    ("The unit became active.", [("The unit", None, "active", "activation")]), ("Plan A was replaced by plan B!", [("Plan A", None, "plan B", "replacement")]), ("Nothing here.", []),
])
def test_changes(text, want):
    assert [tuple(c.values()) for c in dates.changes(text)] == want
