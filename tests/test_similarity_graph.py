"""The kept similarity graph against all pairs."""

import numpy as np
import pytest

from attestry.operators import graph as gr
from attestry.operators import similarity as sm

SCHEMA = "id long, source_profile string, origin_memory_id string, is_promoted boolean, is_revoked boolean, embedding array<float>"


def table(spark, vectors, revoked=()):
    return spark.createDataFrame([(i, "p", str(i), True, i in revoked, v) for i, v in vectors.items()], SCHEMA)


def slow_links(vectors, threshold, revoked=()):
    kept = {i: np.array(v, np.float32).astype(float) for i, v in vectors.items() if v is not None and np.isfinite(v).all() and any(v) and i not in revoked}
    out = {}
    for a, x in kept.items():
        for b, y in kept.items():
            s = x @ y / np.linalg.norm(x) / np.linalg.norm(y)
            if a != b and s >= threshold:
                out[a, b] = pytest.approx(s)
    return out


def links(graph):
    return {(r["source_id"], r["target_id"]): r["similarity"] for r in graph.edges().collect()}


def clustered(seed, n, dims=24, centers=30):
    rng = np.random.default_rng(seed)
    base = rng.standard_normal((centers, dims))
    return {i: (base[i % centers] + rng.standard_normal(dims) * 0.25).tolist() for i in range(n)}


@pytest.mark.parametrize("block", [2048, 7])
def test_refreshes_equal_all_pairs(spark, tmp_path, monkeypatch, block):
    """New, changed, revoked and returning vectors, and such as can't be compared."""
    monkeypatch.setattr(sm, "BLOCK", block)
    vectors = clustered(1, 240) | {900: None, 901: [0.0] * 24, 902: [float("nan")] * 24}
    graph = sm.SimilarityGraph(spark, f"file://{tmp_path}/g", 0.6)
    early = {i: v for i, v in vectors.items() if i % 5}
    first = graph.refresh(table(spark, early))
    assert first.new == 192 and first.gone == 0 and links(graph) == slow_links(early, 0.6)
    vectors |= {7: vectors[8], 11: vectors[3]}
    second = graph.refresh(table(spark, vectors, revoked={1, 2, 13}))
    assert (second.new, second.gone) == (48 + 2, 3 + 2) and links(graph) == slow_links(vectors, 0.6, {1, 2, 13})
    third = graph.refresh(table(spark, vectors))
    assert (third.new, third.gone) == (3, 0) and links(graph) == slow_links(vectors, 0.6)
    assert third.compared <= 3 * 240 and graph.refresh(table(spark, vectors)).compared == 0
    same = {(r["source_id"], r["target_id"]) for r in gr.similarity_edges(table(spark, vectors), 0.6).collect()}
    assert set(links(graph)) == same and {r["source_id"] for r in graph.neighbours([5, 6]).collect()} <= {5, 6}


def test_most_pairs_of_clusters_are_ruled_out(spark, tmp_path):
    vectors = clustered(2, 1500, dims=32, centers=40)
    graph = sm.SimilarityGraph(spark, f"file://{tmp_path}/g", 0.9)
    report = graph.refresh(table(spark, vectors))
    assert report.pairs == 1500 * 1499 // 2 and report.compared < report.pairs / 5
    assert links(graph).keys() == slow_links(vectors, 0.9).keys()


def test_empty_and_other_threshold(spark, tmp_path):
    graph = sm.SimilarityGraph(spark, f"file://{tmp_path}/g", 0.6)
    assert graph.refresh(table(spark, {1: None})).pairs == 0 and graph.edges().count() == 0
    with pytest.raises(ValueError, match="threshold"):
        sm.SimilarityGraph(spark, f"file://{tmp_path}/g", 0.7).refresh(table(spark, {1: [1.0, 0.0]}))


def test_a_vector_is_sent_once_to_a_group_of_lists():
    """With every list open a vector goes to each group after its own once, however many lists a group has."""
    rng = np.random.default_rng(4)
    x, pivots = rng.standard_normal((20, 8)), rng.standard_normal((12, 8))
    batch = sm.pa.RecordBatch.from_arrays(
        [sm.pa.array(np.arange(20) % 3, sm.pa.int32()), sm.pa.array(np.arange(20) % 3 * 3, sm.pa.int32()), sm.pa.array(range(20), sm.pa.int64()), sm.pa.array([r.tobytes() for r in x], sm.pa.binary())], ["x", "pivot", "id", "v"]
    )
    member = np.repeat(np.eye(4, dtype=bool), 3, axis=1)
    for later in (True, False):
        sent = next(sm._visit(iter([batch]), pivots, np.full(12, 9.0), 9.0, member, later)).to_pylist()
        assert sorted((r["id"], r["y"]) for r in sent) == [(i, y) for i in range(20) for y in range(i % 3 + 1 if later else 0, 4)]


def test_a_list_of_copies_is_parted_among_groups(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(sm, "BLOCK", 10)
    vectors = clustered(3, 200, dims=8) | {i: [1.0] * 8 for i in range(400, 500)}
    graph = sm.SimilarityGraph(spark, f"file://{tmp_path}/g", 0.1)
    assert graph.refresh(table(spark, {i: v for i, v in vectors.items() if i % 3})).new == 200
    graph.refresh(table(spark, vectors))
    assert links(graph) == slow_links(vectors, 0.1)


def test_links_of_seeds_need_no_graph(spark):
    """The same links as all pairs have, of the seeds alone; seeds without a vector have none."""
    vectors = clustered(5, 120) | {900: None, 901: [0.0] * 24}
    rows = table(spark, vectors, revoked={6})
    seeds = spark.createDataFrame([(i,) for i in (3, 6, 40, 900, 901)], "entry_id long")
    got = {(r["source_id"], r["target_id"]): r["similarity"] for r in sm.links_of(seeds, rows, 0.6).collect()}
    assert got == {k: v for k, v in slow_links(vectors, 0.6, {6}).items() if k[0] in (3, 40)}


def test_best_edges_are_served_without_shuffling_all(spark):
    """The best edges between governed entries, though the first edges lead to revoked ones, at any depth."""
    rng = np.random.default_rng(6)
    pairs = sorted({(int(a), int(b)) for a, b in rng.integers(0, 60, (900, 2)) if a < b})
    edges = [(a, b, 0.9 if a in (1, 2) else float(rng.random() * 0.8)) for a, b in pairs]
    both = spark.createDataFrame(edges + [(b, a, s) for a, b, s in edges], "source_id long, target_id long, similarity double")
    for revoked, limit in (({1, 2}, 3), (set(range(0, 58)), 5), (set(), 10_000)):
        entries = table(spark, {i: [1.0] for i in range(60)}, revoked)
        want = sorted(((-s, a, b) for a, b, s in edges if not {a, b} & revoked))[:limit]
        served = gr.serve(both, entries, None, limit)
        assert [(-r["similarity"], r["source_id"], r["target_id"]) for r in served.collect()] == want
