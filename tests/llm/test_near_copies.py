"""Near copies against all pairs compared by definition."""

import random

import numpy as np
import pandas as pd
import pytest

from attestry.llm import near_copies, simhash
from attestry.llm.common import materialize, sample_rows

SCHEMA = "doc_id long, text string"


def shingle_set(text, n=5):
    words = (text or "").encode().lower().split()
    k = min(n, len(words))
    return {b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)} if k else set()


def slow_near_groups(texts, percent=80):
    """Smallest position reachable over pairs that share percent of their shingles; wordless texts are one group."""
    sets, label = [shingle_set(t) for t in texts], list(range(len(texts)))
    changed = True
    while changed:
        changed = False
        for i in range(len(texts)):
            for j in range(i):
                same = 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]) if sets[i] | sets[j] else True
                if label[i] != label[j] and same:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    return label


def edited(seed=2, n=150):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(900)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = rng.choice(rows[:40])[1].split()
            for _ in range(max(1, len(base) // rng.choice((30, 45, 60, 90)))):
                base[rng.randrange(len(base))] = rng.choice(words)
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(60, 300)))))
    return rows


def test_words_and_shingles_are_those_of_the_definition():
    long = "x" * 1500
    texts = ["A b\x0bc d  E", "a B c d e", "", None, " \n", "one", "a\x00b", "Ä ä", long + "y " + long, long + " y" + long]
    words = [near_copies.word_hashes(t.encode() if t is not None else None) for t in texts]
    plain = [tuple((t or "").encode().lower().split()) for t in texts]
    for i in range(len(texts)):
        assert len(words[i]) == len(plain[i])
        for j in range(len(texts)):
            assert (words[i].tobytes() == words[j].tobytes()) == (plain[i] == plain[j])
    assert len(near_copies.runs(words[0], 5)) == 1 and not len(near_copies.runs(words[2], 5))


def test_wide_code_is_the_majority_of_its_hashes():
    words = near_copies.word_hashes(" ".join(str(i) for i in range(700)).encode())
    marks = near_copies.runs(words, 2)
    hashes = near_copies._mix(marks[:, None] + near_copies._TURN[None, 8:16])
    want = np.unpackbits(hashes.view(np.uint8).reshape(len(marks), -1), axis=1).sum(axis=0, dtype=np.int64) * 2 > len(marks)
    assert (np.unpackbits(near_copies.wide_code(words, 8).view(np.uint8)) == want).all()


def test_gray_index_gives_all_pairs():
    rng = np.random.default_rng(4)
    codes = rng.integers(0, 1 << 63, 30, dtype=np.uint64)[rng.integers(0, 30, 400)]
    for _ in range(6):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 400, dtype=np.uint64))
    fixed = np.uint64(0xF << 60)
    got = [(min(p), max(p)) for a, b in simhash.GrayIndex(codes).pairs(9, fixed, 50) for p in zip(a.tolist(), b.tolist())]
    apart = codes[:, None] ^ codes[None, :]
    want = {(i, j) for i, j in zip(*np.nonzero((np.bitwise_count(apart) <= 9) & ((apart & fixed) == 0))) if i < j}
    assert set(got) == want and len(got) == len(want)


@pytest.mark.parametrize("how", [{}, {"nearest": 1, "crowded": 4}])
def test_groups_match_all_pairs(spark, how):
    """Also with buckets cut into cells and one partner a code and round."""
    rows = edited()
    docs = spark.createDataFrame(rows, SCHEMA)
    keyed = materialize(docs.selectExpr("text as t", "doc_id as __r1", "doc_id as __r2"))
    code = near_copies.code_column(docs["text"], 8).alias("p")
    classes = materialize(docs.select("doc_id", code).selectExpr("doc_id as c", "doc_id as r1", "doc_id as r2", "p.hi", "p.lo", "p.code", "p.sketch"))
    found = {r["c"]: r["grp"] for r in near_copies.link_texts(keyed, classes, "t", **how).collect()}
    got = [found.get(i, i) for i in range(len(rows))]
    want = slow_near_groups([t for _, t in rows])
    assert len({(a, b) for a, b in zip(got, want)}) == len(set(want)) == len(set(got)) < len(rows) - 20


@pytest.mark.parametrize("most_bytes", [0, 1 << 20])
def test_hubs_are_verified_in_salted_copies_or_by_broadcast(spark, most_bytes):
    marks = spark.createDataFrame([(c, [1, 2, 3, 4 + c % 2]) for c in range(40)], "c long, marks array<bigint>")
    pairs = spark.createDataFrame([(0, c) for c in range(1, 40)], "a long, b long")
    got = {(r["a"], r["b"]): r["near"] for r in near_copies.verified(pairs, marks, 80, heavy=5, most_bytes=most_bytes).collect()}
    assert got == {(0, c): c % 2 == 0 for c in range(1, 40)}


def test_keep_first_keeps_the_smallest_row_of_a_group(spark):
    base = " ".join(f"a{i}" for i in range(100))
    near = base.replace("a50 ", "b50 ")
    far = " ".join(f"c{i}" for i in range(100))
    rows = [(5, near, 1, "k"), (3, base.upper(), 2, "k"), (None, base, 3, "k"), (9, None, 4, "k"), (8, "", 5, "k"), (4, far, 6, "k"), (4, far, 6, "k"), (2, "one", 7, "k"), (6, "ONE", 8, "k"), (7, "one two", 9, "k")]
    rows.append((10, " ".join(f"v{i % 7000}" for i in range(60_000)), 10, "k"))
    df = spark.createDataFrame(rows, "doc_id long, text string, __r1 int, lead string")  # clashing names
    kept = near_copies.keep_first(df)
    assert kept.columns == df.columns
    assert sorted((r["doc_id"], r["__r1"]) for r in kept.collect()) == [(2, 7), (3, 2), (4, 6), (7, 9), (8, 5), (10, 10)]
    assert near_copies.keep_first(df.where("false")).count() == 0


def test_rows_that_differ_only_in_where_a_null_stands(spark):
    """Neither a null text nor a null column makes two rows one."""
    rows = [(1, None, "alpha beta gamma delta", "x"), (1, "alpha beta gamma delta", None, "x"), (2, "other words are here now", None, "x"), (2, "other words are here now", None, "x")]
    got = near_copies.keep_first(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"))
    assert sorted((tuple(r) for r in got.collect()), key=str) == sorted(set(rows), key=str)


def test_sample_passes_over_what_does_not_fit(spark):
    docs = spark.createDataFrame([(i, "x" * (50_000 if i == 3 else 10)) for i in range(20)], SCHEMA)
    got = sample_rows(docs, docs.select(docs["doc_id"].alias("__id")), "doc_id", "text", most_bytes=1000)
    assert sorted(got["__id"]) == [i for i in range(20) if i != 3]


def connected(n, links):
    root = list(range(n))
    for _ in range(n):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def test_family_gives_links_not_pairs():
    """Texts 0.6 to 1 alike: fewer links than texts, connecting what all pairs connect, also from chunk to chunk."""
    words = [f"w{i}" for i in range(120)]
    texts = [" ".join(words[: 100 - k] + [f"x{i}_{k}" for k in range(k)]) for i, k in enumerate((0, 1, 1, 2, 3, 8, 8, 15, 15, 25, 25, 40))]
    sets = [np.unique(near_copies.runs(near_copies.word_hashes(t.encode()), 5)).view(np.int64) for t in texts]
    rows = pd.DataFrame({"fam": 1, "low": 0, "high": 0, "chunk": 0, "c": range(len(texts)), "marks": sets})
    links = near_copies.family_links(rows, 80)
    want = slow_near_groups(texts)
    assert connected(len(texts), links.to_numpy().tolist()) == want and len(links) == len(texts) - len(set(want))
    rows["chunk"] = rows["c"] % 3
    cells = [rows[rows["chunk"].isin((x, y))].assign(low=x, high=y) for x in range(3) for y in range(x, 3)]
    assert connected(len(texts), near_copies.family_links(pd.concat(cells), 80).to_numpy().tolist()) == want


def test_bucket_of_many_near_codes_gives_few_links():
    rng, n = np.random.default_rng(3), 300
    first = np.uint64(0xABCD) ^ (np.uint64(1) << rng.integers(16, 64, n, dtype=np.uint64))
    bucket = pd.DataFrame({"tab": 0, "block": 0, "part": 0xABCD, "first": first.view(np.int64), "second": 0, "c": np.arange(n), "cell": 0})
    got = pd.concat(near_copies.search_pairs(iter([bucket]), [0xFFFF, 0, 0, 0], 1))[["a", "b"]]
    assert len(got) <= 2 * n and connected(n, got.to_numpy().tolist()) == [0] * n


def test_large_families_and_buckets_are_cut_into_chunks(spark):
    rows = edited(seed=5, n=90)
    keyed = materialize(spark.createDataFrame(rows, SCHEMA).selectExpr("text as t", "doc_id as __r1", "doc_id as __r2"))
    code = near_copies.code_column(keyed["t"], 8, None).alias("p")
    classes = materialize(keyed.select("__r1", code).selectExpr("__r1 as c", "__r1 as r1", "__r1 as r2", "p.code"))
    found = {r["c"]: r["grp"] for r in near_copies.link_texts(keyed, classes, "t", crowded=3, most_texts=3).collect()}
    assert [found.get(i, i) for i in range(len(rows))] == slow_near_groups([t for _, t in rows])
