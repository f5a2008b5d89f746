"""Sharding, mixing and URL filters against plain Python."""

import hashlib
from collections import defaultdict
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from attestry.llm import mixing, sharding, url_filter

DOCS = "doc_id long, text string, source string"


def bits(doc_id):
    return f"{int(hashlib.md5(str('' if doc_id is None else doc_id).encode()).hexdigest()[:15], 16):060b}"


def slow_shards(rows, limit):
    out = {}

    def split(prefix, members):
        if sum(len((t or "").encode()) for _, t in members) <= limit or len({bits(d) for d, _ in members}) == 1:
            out.update({d: prefix for d, _ in members})
            return
        for b in "01":
            part = [m for m in members if bits(m[0])[len(prefix)] == b]
            if part:
                split(prefix + b, part)

    split("", rows)
    return out


@pytest.mark.parametrize(("limit", "most"), [(10_000_000, 100), (4000, 100), (700, 100), (4000, 3), (700, 1)])
def test_shards_split_only_where_too_large(spark, limit, most):
    """Also with the directory broadcast in parts."""
    rows = [(i, "x" * (i * 37 % 500)) for i in range(300)] + [(1000, "y" * 5000), (1001, None), (None, "z"), (1002, "")]
    df = spark.createDataFrame([(d, t, "s", "clash") for d, t in rows], "doc_id long, text string, source string, shard string")
    got = sharding.assign_shards(df, limit=limit, most_broadcast=most).collect()
    assert len(got) == len(rows)
    want = slow_shards(rows, limit)
    assert {r["doc_id"]: r["shard"] for r in got} == want
    size = defaultdict(int)
    for r in got:
        size[r["shard"]] += len((r["text"] or "").encode())
    for r in got:
        assert r["shard_bytes"] == size[r["shard"]]
        assert size[r["shard"]] <= limit or r["shard_documents"] == 1


def test_rows_of_one_id_fill_overflow_pages(spark):
    rows = [(1, "x" * 90)] * 200 + [(2, "y" * 50)] * 3 + [(3, "z" * 400)] * 4
    got = sharding.assign_shards(spark.createDataFrame(rows, "doc_id long, text string"), limit=300).collect()
    assert len(got) == len(rows)
    size, count = defaultdict(int), defaultdict(int)
    for r in got:
        size[r["shard"]] += len(r["text"])
        count[r["shard"]] += 1
    assert all(s <= 300 or count[k] == 1 for k, s in size.items())
    assert all(r["shard_bytes"] == size[r["shard"]] and r["shard_documents"] == count[r["shard"]] for r in got)


def test_no_documents(spark):
    df = spark.createDataFrame([], DOCS)
    assert sharding.assign_shards(df).count() == 0
    assert mixing.plan_mix(df).count() == 0
    assert mixing.mix(df).columns == df.columns


def test_sharding_stays_native(spark):
    plan = sharding.assign_shards(spark.createDataFrame([(1, "a")], "doc_id long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def slow_targets(sizes):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    left, open_, target = 1.5 * sum(sizes.values()), set(order), {}
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if weight[s] * level > 2 * sizes[s]}
        if not over:
            target |= {s: weight[s] * level for s in open_}
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        open_ -= over
    return target


def test_targets_stop_at_twice_the_source(spark):
    sizes = {"a": 10, "b": 1000, "B": 30, "ä": 500, None: 77, "zz": 0}
    rows = [(i, " ".join(["w"] * n), s) for i, (s, n) in enumerate(sizes.items())] + [(9, None, "a"), (10, "", "b")]
    planned = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).collect()
    want = slow_targets(sizes)
    assert len(planned) == len(rows)
    for r in planned:
        assert r["target"] == pytest.approx(want[r["source"]])
        assert r["source_size"] == sizes[r["source"]]
        assert 0 <= r["copies"] <= 2


def test_taken_words_come_near_targets_and_reruns_agree(spark):
    rows = [(i, " ".join(["w"] * (1 + i % 9)), "s%d" % (i % 4)) for i in range(8000)]
    df = spark.createDataFrame(rows, DOCS)
    planned = mixing.plan_mix(df)
    got = planned.groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.06)
    once = sorted((r["doc_id"] for r in mixing.mix(df).collect()))
    assert once == sorted(r["doc_id"] for r in mixing.mix(df.repartition(7)).collect())


def test_url_patterns_and_intervals(spark):
    t = lambda d: datetime(2024, 1, d)
    entries = [
        ("l", "d:example.com", "add", t(3)), ("l", "d:example.com", "remove", t(10)), ("l", "d:example.com", "add", t(20)), ("l", "d:example.com", "add", t(20)), ("l", "p:other.org/a/b", "add", t(5)),
        ("l", "d:gone.org", "add", t(4)), ("l", "d:gone.org", "remove", t(4)), ("l", None, "add", t(1)), ("l", "d:x.org", "add", None),
    ]
    caps = [
        (1, "https://www.EXAMPLE.com/x?q", t(3)), (2, "http://example.com", t(10)), (3, "http://a.b.example.com./", t(25)), (4, "http://notexample.com/", t(5)), (5, "http://other.org/a/b/c#d", t(6)),
        (6, "http://other.org/a", t(6)), (7, "http://gone.org/", t(6)), (8, None, t(6)), (9, "not a url", t(6)), (10, "http://example.com", None), (1, "https://www.EXAMPLE.com/x?q", t(3)),
    ]
    e = spark.createDataFrame(entries, "list string, pattern string, action string, at timestamp")
    c = spark.createDataFrame(caps, "page_id long, url string, fetched timestamp")
    for most in (0, 100):
        got = url_filter.evaluate(c, e, most_broadcast=most).collect()
        assert sorted((r["page_id"], r["blocked"]) for r in got) == [(1, True), (1, True), (2, False), (3, True), (4, False), (5, True), (6, False), (7, False), (8, False), (9, False), (10, False)]
    assert url_filter.evaluate(c, e.where("false")).where("blocked").count() == 0


def test_copies_of_one_id_are_decided_by_their_text_too(spark):
    rows = [(7 if i % 2 else None, f"word {i}", "s%d" % (i % 2)) for i in range(4000)]
    got = mixing.plan_mix(spark.createDataFrame(rows, DOCS)).groupBy("source").agg(F.sum(F.col("size") * F.col("copies")).alias("taken"), F.first("target").alias("target")).collect()
    for r in got:
        assert r["taken"] == pytest.approx(r["target"], rel=0.1)


def test_a_host_with_most_captures_meets_the_list(spark):
    rows = [(i, "http://big.com/a", datetime(2024, 1, 1 + i % 2)) for i in range(600)] + [(1000 + i, f"http://big.com/{i}", datetime(2024, 1, 1 + i % 3)) for i in range(600)] + [(5000 + i, None, None) for i in range(300)]
    c = spark.createDataFrame(rows, "page_id long, url string, fetched timestamp")
    e = spark.createDataFrame([("l", "d:big.com", "add", datetime(2024, 1, 2)), ("l", "p:big.com/7", "add", datetime(2024, 1, 1))], "list string, pattern string, action string, at timestamp")
    want = {i: f.day >= 2 or u == "http://big.com/7" if u else False for i, u, f in rows}
    for most in (0, 100):
        got = url_filter.evaluate(c, e, most_broadcast=most).collect()
        assert len(got) == len(rows) and {r["page_id"]: r["blocked"] for r in got} == want
