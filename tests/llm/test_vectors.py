"""Operators on embeddings against plain versions: nulls, non-finite and short vectors, ties, repeated rows, empty tables, clashing names."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import dense, hard_negatives, vector_codes, vector_copies

SCHEMA = "vec_id long, embedding array<float>, label int, `a.b` string, v int, r long, id string"


def rows_of(seed=1, n=260, dims=16):
    """Clusters, copies, near copies, ties, and everything that takes no part."""
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((9, dims))
    out = []
    for i in range(n):
        x = base[i % 9] + rng.standard_normal(dims) * (0.8 if i % 3 else 0.05)
        x = out[-1][1] if i % 11 == 4 else (x / np.linalg.norm(x)).astype(np.float32).tolist()
        out.append((i, x, i % 4 if i % 13 else None))
    odd = [(1000, None, 1), (1001, [0.0] * dims, 1), (1002, [math.nan] + [1.0] * (dims - 1), 2), (1003, [math.inf] + [1.0] * (dims - 1), 2), (1004, [None] + [1.0] * (dims - 1), 0), (1050, [0.5] * (dims - 3), 3)]
    out += [*odd, (1005, [], 0), out[3], out[3], (50, out[50][1], out[50][2]), (None, out[7][1], 1)]
    return [(*r, "clash", k, -k, "x") for k, r in enumerate(out)]


def whole(vector, dims=16):
    """A vector in float32 as doubles, padded; None where it takes no part."""
    if vector is None or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return np.pad(np.asarray(vector, np.float32).astype(np.float64), (0, dims - len(vector)))


def slow_negatives(rows, positives=5, negatives=3):
    kept = [(r[0], np.floor(whole(r[1]) * 256).astype(int), r[2]) for r in rows if r[0] is not None and r[2] is not None and whole(r[1]) is not None]
    out = []
    for k, (a, q, label) in enumerate(kept):
        if a % 50:
            continue
        score = [(-int(q @ v), i, j, lab) for j, (i, v, lab) in enumerate(kept) if j != k]
        for ps, p, _, _ in sorted(s for s in score if s[3] == label)[:positives]:
            window = [s for s in sorted(score) if s[3] != label and 50 * -ps <= 100 * -s[0] <= 95 * -ps][:negatives]
            out += [(a, p, n, s[1], -ps, -s[0]) for n, s in enumerate(window, 1)]
    return sorted(out)


@pytest.mark.parametrize(("lists", "block"), [(2048, 4096), (3, 16)])
def test_negatives_against_brute_force(spark, monkeypatch, lists, block):
    """Also with few lists cut into many blocks and packs, and one probe."""
    monkeypatch.setattr(hard_negatives, "BLOCK", block)
    monkeypatch.setattr(hard_negatives, "PACK", 4 if block == 16 else 1024)
    rows = rows_of()
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0, most_lists=lists)
    assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    want = slow_negatives(rows)
    assert sorted(tuple(r) for r in got.collect()) == want and len(want) > 20


def test_lists_out_of_bounds_are_not_visited(spark):
    """Far clusters are ruled out, and the result stays whole."""
    rng = np.random.default_rng(3)
    base = 4 * np.linalg.qr(rng.standard_normal((32, 32)))[0]
    rows = [(i, (base[i % 32] + rng.standard_normal(32) * 0.01).astype(np.float32).tolist(), i % 2, "", 0, 0, "") for i in range(1600)]
    got = hard_negatives.mine(spark.createDataFrame(rows, SCHEMA), F.col("vec_id") % 50 == 0)
    work = got._attestry_work
    assert all(v < 0.5 * 32 * work["lists"] for v in work["visits"])
    kept = np.floor(np.array([r[1] for r in rows]) * 256).astype(int)
    first = kept[0] @ kept.T
    same = sorted((-first[i], i) for i in range(1, 1600) if i % 2 == 0)[:5]
    assert {r["positive_id"] for r in got.where("anchor_id = 0").collect()} <= {i for _, i in same}


def test_bounds_hold():
    rng = np.random.default_rng(5)
    x, q, centers = rng.integers(-300, 300, (500, 12)).astype(float), rng.integers(-300, 300, (40, 12)).astype(float), rng.integers(-200, 200, (7, 12)).astype(float)
    own = dense.nearest(x, centers)
    radius = np.array([np.sqrt(((x[own == k] - centers[k]) ** 2).sum(1).max(initial=0)) for k in range(7)])
    low, high = hard_negatives.bounds(q, centers, radius)
    score = q @ x.T
    assert (score >= low[:, own]).all() and (score <= high[:, own]).all()


def slow_codes(rows, parts=8, entries=16, rounds=6):
    kept = sorted(((r[0] is None, r[0] or 0, np.floor(whole(r[1]) * 4096).astype(int).tolist(), r[2], r[0]) for r in rows if whole(r[1]) is not None), key=lambda t: t[:3])
    x = np.array([k[2] for k in kept]).reshape(len(kept), parts, -1)
    book = x[:entries].transpose(1, 0, 2).copy()

    def nearest():
        d = ((x[:, :, None] - book[None]) ** 2).sum(3)
        return d.argmin(2), d.min(2)

    for _ in range(rounds):
        code, _ = nearest()
        for p in range(parts):
            for e in range(book.shape[1]):
                own = x[code[:, p] == e, p]
                if len(own):
                    book[p, e] = own.sum(0) // len(own)
    code, d = nearest()
    error = d.sum(1)
    labels = {}
    for k, e in zip(kept, error):
        labels[k[3]] = labels.get(k[3], 0) + int(e)
    digest = hashlib.sha256(",".join(map(str, book.ravel())).encode()).hexdigest()
    return sorted(((k[4], "".join(f"{c:02x}" for c in cs), int(e), labels[k[3]], digest) for k, cs, e in zip(kept, code, error)), key=str)


@pytest.mark.parametrize("n", [5, 260])
def test_codes_against_brute_force(spark, n):
    """Fewer rows than entries, and ties between copies."""
    rows = rows_of(2, n) if n > 50 else rows_of(2, 60)[:n]
    got = vector_codes.compress(spark.createDataFrame(rows, SCHEMA))
    assert sorted((tuple(r)[:5] for r in got.collect()), key=str) == slow_codes(rows)
    if n > 50:
        assert got.first()["distances"] < 0.9 * 7 * 8 * 16 * got.count()


def test_assignment_scans_only_what_bounds_leave():
    """Codes equal a full search in each round while entries move, ties included."""
    rng = np.random.default_rng(8)
    x = (rng.integers(-6, 6, (400, 2, 3)) + 40 * rng.integers(0, 3, (400, 1, 1))).astype(np.int16)
    book = vector_codes.Codebook.start(x[:16].reshape(16, -1), 2, 4)
    code = lower = None
    for _ in range(6):
        code, lower, best, done = vector_codes.assign(x, code, lower, book)
        d = ((x[:, :, None].astype(int) - book.entries[None]) ** 2).sum(3)
        assert (code == d.argmin(2)).all() and (best == d.min(2)).all()
        sums = {(p, e): (int((code[:, p] == e).sum()), x[code[:, p] == e, p].astype(int).sum(0).tolist()) for p in range(2) for e in range(16) if (code[:, p] == e).any()}
        book = book.moved(sums)
    assert done < 400 * 2 * 16


def slow_links(rows, threshold=0.9):
    v = [whole(r[1]) for r in rows]
    use = [k for k, x in enumerate(v) if x is not None and x.any()]
    n, root = [0] * len(rows), list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, a in enumerate(use):
        for b in use[i + 1 :]:
            if v[a] @ v[b] / (np.linalg.norm(v[a]) * np.linalg.norm(v[b])) >= threshold:
                n[a], n[b], root[find(a)] = n[a] + 1, n[b] + 1, find(b)
    least = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            least[find(k)] = min(least.get(find(k), 1 << 60), r[0])
    return sorted(((r[0], n[k], least.get(find(k)), r[0] == least.get(find(k))) for k, r in enumerate(rows)), key=str)


@pytest.mark.parametrize("block", [8192, 16])
def test_links_against_brute_force(spark, block):
    """In one tile and in many blocks around several centres."""
    rows = rows_of(4)
    got = vector_copies.near_vectors(spark.createDataFrame(rows, SCHEMA), block=block)
    assert got.columns == ["vec_id", "n_links", "component_id", "kept"]
    assert sorted((tuple(r) for r in got.collect()), key=str) == slow_links(rows)


def test_far_lists_meet_in_no_tile(spark):
    rng = np.random.default_rng(6)
    base = np.linalg.qr(rng.standard_normal((24, 24)))[0]
    rows = [(i, (base[i % 24] + rng.standard_normal(24) * 0.02).astype(np.float32).tolist(), 0, "", 0, 0, "") for i in range(960)]
    got = vector_copies.near_vectors(spark.createDataFrame(rows, SCHEMA), block=40)
    assert got._attestry_work["bounded"] < 0.25 * 960 * 960
    assert got.where("kept").count() == 24 and {r["n_links"] for r in got.collect()} == {39}


def test_copies_are_one_class(spark):
    """A third of all rows are one vector: links are counted, not listed."""
    rows = [(i, [1.0, 2.0] if i % 3 == 0 else [float(i), -1.0 - i * i], 0, "", 0, 0, "") for i in range(600)]
    got = vector_copies.near_vectors(spark.createDataFrame(rows, SCHEMA))
    assert got._attestry_work["classes"] <= 401
    assert got.where("vec_id = 3").first()["n_links"] >= 199 and got.where("vec_id = 0").first()["kept"]


def test_quantised_products_never_miss():
    """The error bound holds for spread, spiky and tiny components."""
    rng = np.random.default_rng(9)
    x = np.concatenate([rng.standard_normal((60, 33)), rng.standard_normal((60, 33)) ** 7, 1e-200 * rng.standard_normal((20, 33)), 1e200 * rng.standard_normal((20, 33))])
    x = np.concatenate([x, x + 0.1 * np.abs(x).mean(1, keepdims=True) * rng.standard_normal(x.shape)])
    u = vector_copies.normed(x)
    q, s, e = vector_copies.quantise(u)
    about = s[:, None] * s[None] * vector_copies.integer_products(q, q)
    exact = u @ u.T
    assert (np.abs(about - exact) <= e[:, None] + e[None] * (1 + e[:, None]) + 1e-12).all()
    for threshold in (0.3, 0.9, 0.99):
        side = (q, s, e, u)
        got = {(i, j) for a, b, _, _ in vector_copies.close_pairs(side, side, threshold, step=50) for i, j in zip(a.tolist(), b.tolist())}
        sure = {(i, j) for i, j in zip(*np.nonzero(exact >= threshold + 1e-9))}
        assert sure <= got <= {(i, j) for i, j in zip(*np.nonzero(exact >= threshold - 1e-9))}


def test_empty_tables(spark):
    empty = spark.createDataFrame([], SCHEMA)
    odd = spark.createDataFrame([(1, None, 1, "", 0, 0, ""), (2, [math.nan], None, "", 0, 0, "")], SCHEMA)
    for df, n in ((empty, 0), (odd, 2)):
        assert hard_negatives.mine(df, F.col("vec_id") % 50 == 0).count() == 0
        assert vector_codes.compress(df).count() == 0
        assert vector_copies.near_vectors(df).count() == n
    assert all(r["kept"] and r["n_links"] == 0 for r in vector_copies.near_vectors(odd).collect())


def test_components_too_large_for_exact_sums_raise(spark):
    df = spark.createDataFrame([(0, [1e30] * 8, 1)], "vec_id long, embedding array<float>, label int")
    with pytest.raises(ValueError, match="too large"):
        vector_codes.compress(df)
    assert vector_copies.near_vectors(df).count() == 1
