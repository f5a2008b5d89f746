import random

import numpy as np
import pytest
import xxhash

from attestry.llm import simhash
from attestry.llm.common import local_components
from attestry.llm.components import connected_components

SCHEMA = "doc_id long, text string"


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64_intdigest(s, seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_groups(rows, radius=4):
    prints = [slow_fingerprint(t) for _, t in rows]
    label = list(range(len(rows)))
    changed = True
    while changed:
        changed = False
        for i in range(len(rows)):
            for j in range(len(rows)):
                if bin(prints[i] ^ prints[j]).count("1") <= radius and label[i] != label[j]:
                    label[i] = label[j] = min(label[i], label[j])
                    changed = True
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[i] and rows[j][0] is not None]
        out.setdefault((d, f"{prints[i]:016x}"), min(ids) if ids else None)
    return out


def corpus(seed=5, n=60):
    rng = random.Random(seed)
    words = ["w%d" % i for i in range(300)]
    rows = []
    for i in range(n):
        if i % 3 and rows:
            base = rng.choice(rows)[1].split()
            if base:
                base[rng.randrange(len(base))] = "changed"
            rows.append((i, " ".join(base)))
        else:
            rows.append((i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 400)))))
    return rows + [(n, ""), (n + 1, None), (n + 2, "one"), (n + 3, "ONE"), (n + 4, "a b\x0bc"), (7, rows[7][1]), (None, "a b c")]


def test_fingerprint_matches_definition():
    for _, text in corpus():
        assert simhash.fingerprint(text.encode() if text else None) == slow_fingerprint(text)


def test_long_text_sums_bits_in_parts():
    text = " ".join(str(i) for i in range(40_000))
    assert simhash.fingerprint(text.encode()) == slow_fingerprint(text)


def test_groups_match_brute_force(spark):
    rows = corpus()
    want = slow_groups(rows)
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["component_id"] == want[r["doc_id"], r["fingerprint"]]


@pytest.mark.parametrize("fixed", [0, 0xFFF << 52, (1 << 13) - 1])
@pytest.mark.parametrize("seed", range(4))
def test_gray_index_finds_what_all_pairs_connect(seed, fixed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 1 << 63, 20, dtype=np.uint64)
    codes = base[rng.integers(0, 20, 300)]
    for _ in range(seed):
        codes = codes ^ (np.uint64(1) << rng.integers(0, 64, 300, dtype=np.uint64))
    codes = np.unique(codes)
    rng.shuffle(codes)
    a, b = simhash.GrayIndex(codes).links(4, np.uint64(fixed))
    near = (np.bitwise_count(codes[:, None] ^ codes[None, :]) <= 4) & (((codes[:, None] ^ codes[None, :]) & np.uint64(fixed)) == 0)
    assert near[a, b].all()
    i, j = np.nonzero(near)
    assert (local_components(len(codes), a, b) == local_components(len(codes), i, j)).all()


@pytest.mark.parametrize("extra", [1, 2])
def test_block_masks_meet_every_pair(extra):
    rng = random.Random(extra)
    masks = simhash.block_masks(4, extra)
    for _ in range(300):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        assert any((a ^ b) & m == 0 for m in masks)


@pytest.mark.parametrize("extra", [1, 2])
def test_links_over_partitions(spark, extra):
    rng = np.random.default_rng(3)
    base = rng.integers(0, 1 << 62, 200, dtype=np.int64)
    codes = np.unique(np.concatenate([base, base ^ 5, base ^ (7 << 40)]))
    links = simhash.link_fingerprints(spark.createDataFrame([(int(c),) for c in codes], "fp long"), 4, extra, buffer=64).collect()
    at = {int(c): i for i, c in enumerate(codes)}
    a, b = np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links])
    u = codes.astype(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    assert (local_components(len(codes), a, b) == local_components(len(codes), i, j)).all()


def test_crowded_groups_are_split_by_more_blocks(spark):
    rng = np.random.default_rng(9)
    base = np.int64(0x5A5A5A5A5A5A5A5A)
    codes = np.unique(np.concatenate([base ^ (rng.integers(0, 1 << 51, 300, dtype=np.int64)), base ^ (np.int64(1) << rng.integers(0, 20, 40))]))
    links = simhash.link_fingerprints(spark.createDataFrame([(int(c),) for c in codes], "fp long"), 4, 1, crowded=20).collect()
    at = {int(c): i for i, c in enumerate(codes)}
    a, b = np.array([at[r["a"]] for r in links]), np.array([at[r["b"]] for r in links])
    u = codes.view(np.uint64)
    i, j = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    assert (local_components(len(codes), a, b) == local_components(len(codes), i, j)).all() and len(i) > len(codes)


def test_a_heavy_fingerprint_keeps_its_rows(spark):
    rows = [(i, "same words here") for i in range(1, 400)] + [(500 + i, f"other {i}") for i in range(30)]
    got = simhash.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(d for d, _ in rows)
    assert {r["component_id"] for r in got if r["doc_id"] < 500} == {1}


def test_empty_table(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert simhash.near_duplicates(df).count() == 0


@pytest.mark.parametrize("most", [0, 1000])
def test_components_of_a_long_chain_and_a_hub(spark, most):
    edges = [(i, i + 1) for i in range(100, 160)] + [(0, i) for i in range(1, 50)] + [(7, 7)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), most_local=most).collect()}
    assert all(got[i] == 100 for i in range(100, 161)) and all(got[i] == 0 for i in range(50))
    assert connected_components(spark.createDataFrame([], "a long, b long"), most_local=most).count() == 0
