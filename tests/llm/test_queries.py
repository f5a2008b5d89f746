"""Registered queries and the pipeline over a small set of tables, against plain versions."""

import importlib
import random
import re
import zlib

import pytest

from attestry.llm import decontaminate, mixing, queries, sharding, toxicity
from tests.llm.test_near_copies import slow_near_groups
from tests.llm.test_simhash import slow_groups
from tests.llm.test_texts import EN, PAGE, prose, slow_leaks


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    base = str(tmp_path_factory.mktemp("sf"))
    vocabulary = EN + ["x%d" % i for i in range(400)]
    bench = [(i, prose(rng, vocabulary, 30)) for i in range(6)]
    docs = []
    for i in range(160):
        text = prose(rng, vocabulary, rng.randint(20, 120))
        if i % 10 == 3:
            text += " vermin brute vermin"
        if i % 17 == 5:
            text += " " + bench[i % 6][1]
        if i % 8 == 7:
            words = docs[-1][1].split()
            words[rng.randrange(len(words))] = "altered"
            text = " ".join(words) if i % 16 == 7 else docs[-1][1]
        docs.append((i, text, "en" if i % 5 else None, f"s{i % 4}", len(text)))
    docs += [(500, None, None, None, None), (501, "", "en", "s1", 0), (502, "line\n" * 3000, "de", "s2", 15000), (7, docs[7][1], "en", "s3", 1), (None, "only words", "en", "s0", 10)]
    labels = [(i, int(i % 3 != 0), int(i % 10 == 3)) for i in range(160)]
    pages = [(i, f"http://h{i % 7}.example.{'net' if i % 2 else 'com'}/a/{i}", PAGE.replace("Quoted", f"Quoted {i}")) for i in range(40)] + [(99, None, None)]
    vectors = [(i, [rng.gauss(0, 1) for _ in range(16)], i % 3) for i in range(120)] + [(200, None, 1), (201, [0.0] * 16, None)]
    for name, rows, schema in (
        ("embeddings", vectors, "vec_id long, embedding array<float>, label int"),
        ("documents", docs, "doc_id long, text string, lang string, source string, n_chars long"), ("labels", labels, "doc_id long, quality int, toxic int"),
        ("benchmark", bench, "item_id long, text string"), ("pages", pages, "page_id long, url string, html string"),
    ):
        spark.createDataFrame(rows, schema).coalesce(2).write.parquet(f"{base}/{name}.parquet")
    return base, docs, bench, labels


COLUMNS = {
    "op1_sharding": {"doc_id", "shard"}, "op2_simhash": {"doc_id", "fingerprint", "component_id"}, "op3_extraction": {"page_id", "url", "text", "n_chars"},
    "op4_quality_rules": {"doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"}, "op5_url_filter": {"page_id", "blocked"},
    "op6_mixing": {"doc_id", "size", "source_size", "target", "taken"}, "op7_decontaminate": {"doc_id", "item_id"}, "op8_weak_quality": {"doc_id", "score", "kept"},
    "op9_language": {"doc_id", "held_out", "lang_pred", "score"}, "op10_toxicity": {"doc_id", "held_out", "score", "predicted"},
    "op11_hard_negatives": {"anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"}, "op12_vector_codes": {"vec_id", "code", "error", "label_error", "codebooks_sha256"},
    "op13_vector_copies": {"vec_id", "n_links", "component_id", "kept"},
}


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_covers_its_table(spark, tables, name):
    base, docs, bench, _ = tables
    df = queries.queries()[name](spark, base)
    assert COLUMNS[name] <= set(df.columns)
    n = df.count()
    if name in ("op11_hard_negatives", "op12_vector_codes", "op13_vector_copies"):
        assert n == {"11": n, "12": 121, "13": 122}[name[2:4]]
    elif name != "op7_decontaminate":
        assert n == (41 if name in ("op3_extraction", "op5_url_filter") else len(docs))


def test_simhash_query_against_brute_force(spark, tables):
    base, docs, _, _ = tables
    want = slow_groups([(d[0], d[1]) for d in docs])
    for r in queries.op2_simhash(spark, base).collect():
        assert r["component_id"] == want[r["doc_id"], r["fingerprint"]]


def test_leak_query_against_brute_force(spark, tables):
    base, docs, bench, _ = tables
    got = {(r["doc_id"], r["item_id"]) for r in queries.op7_decontaminate(spark, base).collect()}
    assert got == {(d[0], i) for d in docs for i in slow_leaks(d[1], bench)} and got


def test_quality_query_base_columns(spark, tables):
    base, docs, _, _ = tables
    by = {}
    for r in queries.op4_quality_rules(spark, base).collect():
        by[r["doc_id"]] = r
        assert not (r["base_failed"] and r["kept"])
    for d, text, *_ in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        many = {x for x in runs if runs.count(x) > 1} if len(runs) < 500 else set(runs)
        covered = {j for i, x in enumerate(runs) if x in many for j in range(i, i + 5)}
        lines = [x for x in (text or "").split("\n") if x.strip("\x20\x09\x0a\x0b\x0c\x0d")]
        r = by[d]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (
            len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered),
        )
        assert r["base_failed"] == (len(words) < 10 or 100 * len(covered) > 20 * len(words))


def test_held_out_columns(spark, tables):
    base, docs, _, _ = tables
    for name, n, k in (("op9_language", 5, 0), ("op10_toxicity", 3, 1)):
        for r in queries.queries()[name](spark, base).collect():
            assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % n == k)


def test_pipeline_against_brute_force(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    base, docs, bench, labels = tables
    assert [n for n, _ in pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "mixing", "sharding"]
    frame = spark.read.parquet(f"{base}/documents.parquet")
    model = toxicity.fit(frame, spark.read.parquet(f"{base}/labels.parquet"))
    left = [d for d in docs if model.score(d[1]) < 0.7]
    assert {3, 13, 23} & {d[0] for d in docs} - {d[0] for d in left}
    left = sorted(left, key=lambda d: (d[0] is None, d[0] or 0))
    first = {}
    for d, group in zip(left, slow_near_groups([d[1] for d in left])):
        first.setdefault(group, d)
    left = [d for d in first.values() if not slow_leaks(d[1], bench)]
    planned = mixing.plan_mix(spark.createDataFrame(left, frame.schema)).select("doc_id", "copies").collect()
    want = sorted((r["doc_id"] for r in planned for _ in range(r["copies"])), key=str)
    got = pipeline.run(spark, base)
    assert set(frame.columns) <= set(got.columns) and "shard" in got.columns
    rows = got.collect()
    assert sorted((r["doc_id"] for r in rows), key=str) == want
    assert {r["shard"] for r in rows} == {r["shard"] for r in sharding.assign_shards(spark.createDataFrame(left, frame.schema), limit=pipeline.SHARD_LIMIT).collect()}


def test_stages_keep_columns_and_take_empty_tables(spark, tables):
    pipeline = pytest.importorskip("corpus_pipeline")
    base = tables[0]
    docs = spark.read.parquet(f"{base}/documents.parquet").where("false")
    for name, stage in pipeline.STAGES:
        out = stage(spark, docs, base)
        assert out.count() == 0
        if name != "sharding":
            assert out.columns == docs.columns


def test_entry_adds_the_queries():
    entry = importlib.import_module("__spark_entry__")
    assert set(queries.queries()) <= set(entry.queries())
    assert set(queries.oracle_sql()) <= set(entry.oracle_sql())
    assert decontaminate.BenchmarkIndex.build([]).leaks([b"text", None]) == [[], []]


def test_codes_query_returns_the_columns_of_its_sql(spark, tables):
    base = tables[0]
    assert queries.queries()["op12_vector_codes"](spark, base).columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
