"""Stemmed search without an index."""

import math

import pytest

from attestry.operators import retrieval as rt


def test_texts_without_words_count_and_no_word_is_shuffled(spark):
    entries = spark.createDataFrame([(i, "p", str(i), True, False) for i in (1, 2, 3)], "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean")
    memories = spark.createDataFrame([("p", "1", "Apples pie"), ("p", "2", "!!!"), ("p", "3", "pear")], "source_profile string, origin_memory_id string, content string")
    found = rt.bm25(entries, memories, "apple", stem=True)
    assert [(r["entry_id"], r["score"]) for r in found.collect()] == [(1, pytest.approx(math.log(2.5 / 1.5) * 2.2 / 3.1))]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan and plan.count("ArrowEvalPython") == 2
