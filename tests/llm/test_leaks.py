"""Decontamination of texts shorter than an item, and benchmarks of several blocks."""

import random
from collections import Counter

import numpy as np
import pytest

from attestry.llm import decontaminate


def slow_short_leaks(text, items, threshold=0.8):
    """Items longer than the text, against the whole text as their one window."""
    sets = [(i, Counter(tuple(w[j : j + min(5, len(w))]) for j in range(len(w) - min(5, len(w)) + 1))) for i, w in ((i, t.split()) for i, t in items) if w]
    spread = Counter(s for _, c in sets for s in c)
    weight = lambda s: np.log(1 + len(sets) / spread.get(s, 1))
    words, found = text.split(), {}
    for i, own in sets:
        k = len(next(iter(own)))
        c = Counter(tuple(words[j : j + k]) for j in range(len(words) - k + 1))
        if 0 < c.total() < own.total():
            both = sum(weight(s) * min(n, own[s]) for s, n in c.items())
            s = both / (sum(weight(s) * n for s, n in c.items()) + sum(weight(s) * n for s, n in own.items()) - both)
            if s >= threshold - 1e-9:
                found[i] = s
    return found


def test_texts_shorter_than_an_item_are_compared_whole():
    rng = random.Random(4)
    items = [(i, " ".join(f"v{rng.randrange(60)}" for _ in range(rng.randint(3, 40)))) for i in range(40)]
    items += [(40 + i, "one two three four five six seven " + t) for i, t in items[:20]]
    texts = []
    for _, t in items:
        words = t.split()
        texts += [" ".join(words[cut:-1]) for cut in range(min(8, len(words) - 1))] + [" ".join(words[:-1] + words[:2])]
    index = decontaminate.BenchmarkIndex.build(items)
    size = {i: len(t.split()) for i, t in items}
    n = 0
    for text, found in zip(texts, index.leaks([t.encode() for t in texts])):
        got = {f["item_id"]: f["similarity"] for f in found if size[f["item_id"]] > len(text.split())}
        want = slow_short_leaks(text, items)
        assert got == pytest.approx(want)
        n += len(want)
    assert n > 100


def test_a_trimmed_item_is_dropped(spark):
    passage = " ".join(f"w{j}" for j in range(30))
    docs = spark.createDataFrame([(1, passage.rsplit(" ", 1)[0]), (2, passage.split(" ", 2)[2]), (3, " ".join(passage.split()[:18])), (4, "")], "doc_id long, text string")
    bench = spark.createDataFrame([(9, passage)], "item_id long, text string")
    assert sorted((r["doc_id"], r["item_id"], r["start"]) for r in decontaminate.find_leaks(docs, bench).collect()) == [(1, 9, 0), (2, 9, 0)]
    assert sorted(r["doc_id"] for r in decontaminate.drop_leaks(docs, bench).collect()) == [3, 4]


def test_blocks_weigh_shingles_by_the_whole_benchmark(spark):
    rng = random.Random(6)
    common = "read the passage below and choose the answer that fits it best of all"
    items = [(i, common + " " + " ".join(f"v{rng.randrange(900)}" for _ in range(12))) for i in range(9)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    texts = [" ".join(t.split()[: len(t.split()) - cut] + ["end"] * cut) for _, t in items for cut in range(1, 6)] + [t.replace("choose", "pick") for _, t in items]
    want = decontaminate.BenchmarkIndex.build(items).leaks([t.encode() for t in texts])
    got = [[] for _ in texts]
    for index in decontaminate.item_blocks(bench, block=2):
        assert len(index.ids) <= 2
        for found, more in zip(got, index.leaks([t.encode() for t in texts])):
            found += more
    flat = lambda rows: [{(f["item_id"], round(f["similarity"], 9), f["start"]) for f in r} for r in rows]
    assert flat(got) == flat(want) and any(flat(want)) and not all(flat(want))


def test_items_of_repeated_and_null_ids_all_count(spark):
    passage = lambda k: " ".join(f"p{k}w{j}" for j in range(20))
    bench = spark.createDataFrame([(7, passage(k)) for k in range(5)] + [(None, passage(5)), (8, None), (9, "")], "item_id long, text string")
    docs = spark.createDataFrame([(k, "so " + passage(k)) for k in range(7)], "doc_id long, text string")
    assert sum(len(i.ids) for i in decontaminate.item_blocks(bench, block=2)) == 6
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(docs, bench, block=2).collect()) == [(0, 7), (1, 7), (2, 7), (3, 7), (4, 7), (5, None)]
    assert [r["doc_id"] for r in decontaminate.drop_leaks(docs, bench, block=2).collect()] == [6]


def test_block_lookups_are_those_of_all_pairs():
    rng = np.random.default_rng(5)
    prints = rng.integers(0, 1 << 63, 300, dtype=np.uint64)
    asked = prints[rng.integers(0, 300, 200)]
    for _ in range(16):
        asked = asked ^ (np.uint64(1) << rng.integers(0, 64, 200, dtype=np.uint64))
    apart = np.bitwise_count(asked[:, None] ^ prints[None, :])
    for radius in (0, 7, 20):
        for most in (1, 1 << 22):
            w, i = decontaminate.BlockLookup.build(np.arange(300) * 2, prints, radius).near(asked, most)
            assert set(zip(w.tolist(), (i // 2).tolist())) == set(zip(*np.nonzero(apart <= radius))) and len(w) == (apart <= radius).sum()


def test_edited_passages_are_found():
    """Of passages whose exact similarity is 0.8 or more at least 95 % are found (all of 151 on the benchmark of sf0.1)."""
    rng = random.Random(12)
    items = [(i, " ".join(f"v{rng.randrange(4000)}" for _ in range(rng.randint(40, 90)))) for i in range(150)]
    index = decontaminate.BenchmarkIndex.build(items)
    texts, want = [], []
    for i, t in items:
        words = t.split()
        for _ in range(rng.randint(1, max(1, len(words) // 25))):
            words[rng.randrange(len(words))] = f"n{rng.randrange(4000)}"
        texts.append(" ".join([f"h{rng.randrange(99)}" for _ in range(40)] + words + ["end"] * 10).encode())
        marks = decontaminate.item_shingles(" ".join(words).encode(), 5)[0]
        want.append(index.similarity(marks.tolist(), i) >= 0.8)
    found = [i in {f["item_id"] for f in f} for (i, _), f in zip(items, index.leaks(texts))]
    assert sum(want) > 50 and sum(f and w for f, w in zip(found, want)) >= 0.95 * sum(want)
