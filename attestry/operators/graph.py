"""Similarity graph, expansion, graph serving and the temporal graph."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from attestry.functions import vectors as vx
from attestry.operators.governance import governed_entries

#: Ids that are sent whole to each task (some 50 bytes each) rather than edges to ids.
FEW_IDS = 2_000_000


def nodes(entries: DataFrame) -> DataFrame:
    """Governed entries as graph nodes; of several with one profile and memory the last id stands for all."""
    return governed_entries(entries).groupBy(F.concat_ws(":", "source_profile", "origin_memory_id").alias("graph_id")).agg(
        F.max("id").alias("id"), F.max_by("source_profile", "id").alias("source_profile"), F.max_by("origin_memory_id", "id").alias("origin_memory_id")
    )


def similarity_edges(entries: DataFrame, threshold: float = 0.75, dimensions: int | None = None, block: int = 4096) -> DataFrame:
    """(source_id, target_id, similarity) both ways for usable vectors of governed entries with cosine of threshold or more.

    Exact: vectors are dealt into blocks, every pair of blocks meets once in a task as a
    matrix product, and only pairs over the threshold leave it. Work is quadratic by
    definition; rows shuffled are (blocks + 1) x vectors, memory a task two blocks.
    """
    rows = governed_entries(entries).where("embedding is not null")
    size = F.lit(dimensions) if dimensions else F.size("embedding")
    rows = rows.where((F.size("embedding") == size) & F.forall("embedding", lambda x: ~F.isnan(x)) & (vx.norm(F.col("embedding")) > 0)).select("id", "embedding")
    count = rows.count()
    parts = max(1, -(-count // block))
    dealt = rows.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts)).cast("int"))
    left = dealt.select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("o"), "b", "id", "embedding").select(F.least("b", "o").alias("x"), F.greatest("b", "o").alias("y"), "b", "id", "embedding")

    def product(frame: pd.DataFrame) -> pd.DataFrame:
        x, y = int(frame["x"].iloc[0]), int(frame["y"].iloc[0])

        def unit(part: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
            part = part.sort_values("id")
            m = np.stack(part["embedding"].to_numpy()).astype(np.float64) if len(part) else np.zeros((0, 1))
            return part["id"].to_numpy(), m / np.linalg.norm(m, axis=1, keepdims=True) if len(part) else m

        ia, a = unit(frame[frame["b"] == x])
        ib, b = (ia, a) if x == y else unit(frame[frame["b"] == y])
        if not len(ia) or not len(ib):
            return pd.DataFrame({"source_id": [], "target_id": [], "similarity": []}).astype({"source_id": "int64", "target_id": "int64"})
        s = a @ b.T
        i, j = np.nonzero(s >= threshold)
        if x == y:
            keep = i != j
            i, j = i[keep], j[keep]
            return pd.DataFrame({"source_id": ia[i], "target_id": ib[j], "similarity": s[i, j]})
        return pd.DataFrame({"source_id": np.append(ia[i], ib[j]), "target_id": np.append(ib[j], ia[i]), "similarity": np.append(s[i, j], s[i, j])})

    return left.groupBy("x", "y").applyInPandas(product, "source_id long, target_id long, similarity double")


def neighbours(edges: DataFrame, limit: int) -> DataFrame:
    """The limit nearest targets of each source by similarity, then id."""
    w = W.partitionBy("source_id").orderBy(F.desc("similarity"), "target_id")
    return edges.withColumn("place", F.row_number().over(w).cast("long")).where(F.col("place") <= limit)


def expand(seeds: DataFrame, edges: DataFrame, entries: DataFrame, limit_per_seed: int = 5, profile: str | None = None) -> DataFrame:
    """Graph channel: one hop from seeds(entry_id, seed_pos).

    Each seed's nearest are cut first and governed after; an entry that several seeds
    reach keeps the similarity to the first of them.
    """
    side = seeds.select(F.col("entry_id").alias("source_id"), "seed_pos")
    near = edges.join(F.broadcast(side) if side.count() <= 100_000 else side, "source_id")
    near = neighbours(near, limit_per_seed)
    gov = governed_entries(entries, profile).select(F.col("id").alias("target_id"))
    reached = near.join(gov, "target_id", "left_semi").groupBy(F.col("target_id").alias("entry_id")).agg(F.min_by("similarity", "seed_pos").alias("score"))
    return reached.withColumn("rank", F.row_number().over(W.orderBy(F.desc("score"), "entry_id")).cast("long"))


def serve(edges: DataFrame, entries: DataFrame, profile: str | None = None, edge_limit: int | None = None, cut_first: bool = False) -> DataFrame:
    """Edges between kept nodes. By default nodes are filtered, by full or short profile, before the edge limit; cut_first limits first and takes exact profiles only."""
    kept = governed_entries(entries)
    if profile is not None:
        same = F.col("source_profile") == profile
        kept = kept.where(same if cut_first else same | F.endswith("source_profile", F.lit(":" + profile)))
    ids = kept.select("id")
    order = [F.desc("similarity"), F.asc("source_id"), F.asc("target_id")]
    rows = edges.where("source_id < target_id")
    if profile is None and edge_limit is not None and not cut_first:
        best = _best_kept(rows, ids, order, edge_limit)
        if best is not None:
            return best
    if cut_first and edge_limit is not None:
        rows = rows.orderBy(*order).limit(edge_limit)
    rows = rows.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
    if not cut_first and edge_limit is not None:
        rows = rows.orderBy(*order).limit(edge_limit)
    return rows.select("source_id", "target_id", "similarity")


def _best_kept(edges: DataFrame, ids: DataFrame, order: list, limit: int, most: int = 10_000) -> DataFrame | None:
    """The first limit edges by order between ids, looked for among the first few; None where more than most of them would be needed."""
    taken = max(4 * limit, 1)
    while taken <= most:
        rows = edges.select("source_id", "target_id", "similarity").orderBy(*order).limit(taken)
        top = edges.sparkSession.createDataFrame(rows.collect(), rows.schema)  # at most most rows
        ends = top.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
        known = F.broadcast(ids.join(F.broadcast(ends), "id", "left_semi"))
        kept = top.join(known.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(known.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
        if top.count() < taken or kept.count() >= limit:
            return kept.select("source_id", "target_id", "similarity").orderBy(*order).limit(limit)
        taken *= 10
    return None


def diagnostics(edges: DataFrame, entries: DataFrame) -> DataFrame:
    return nodes(entries).agg(F.count("*").alias("nodes")).crossJoin(edges.where("source_id < target_id").agg(F.count("*").alias("edges")))


def temporal_edges(pairs: DataFrame, left_profile: str = "left_profile", right_profile: str = "right_profile") -> DataFrame:
    """Edges 'temporal:<relation>' between the entries of related evidence of one profile, endpoints in order."""
    rows = pairs.where(F.col(left_profile) == F.col(right_profile)).where("left_entry <> right_entry")
    return rows.select(F.least("left_entry", "right_entry").alias("source"), F.greatest("left_entry", "right_entry").alias("target"), F.concat(F.lit("temporal:"), "relation").alias("edge_type"), "left_id", "right_id")


def filter_by_events(edges: DataFrame, events: DataFrame) -> DataFrame:
    """Edges whose two ends are both among the events(id) that a view shows."""
    ids = events.select("id").distinct()
    if ids.count() <= FEW_IDS:
        ids = F.broadcast(ids)
    return edges.join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi").select(*edges.columns)


def statistics(memories: DataFrame, entries: DataFrame, edges: DataFrame) -> DataFrame:
    """One row: profiles and memories at the sources, nodes and edges of the graph, 0 for none."""
    own = memories.agg(F.countDistinct("source_profile").alias("profiles"), F.count("*").alias("memories"))
    return own.crossJoin(diagnostics(edges, entries))


def circle(kept: DataFrame, radius: float = 1.0, ranges: int = 4096) -> DataFrame:
    """Nodes(id) on a circle in the order of their ids: position, x and y. Positions come from counts of equal ranges of ids, so no task orders all nodes."""
    ends = kept.agg(F.count("*").alias("n"), F.min("id").alias("low"), F.max("id").alias("high")).first()
    low, width = ends["low"] or 0, max(1, -(-((ends["high"] or 0) - (ends["low"] or 0) + 1) // ranges))
    placed = kept.select("id", F.floor((F.col("id") - low) / width).cast("long").alias("p"))
    sizes = placed.groupBy("p").agg(F.count("*").alias("k"))  # at most ranges rows
    before = sizes.select("p", (F.sum("k").over(W.orderBy("p")) - F.col("k")).alias("before"))
    within = placed.withColumn("m", F.row_number().over(W.partitionBy("p").orderBy("id")) - 1)
    at = within.join(F.broadcast(before), "p").select("id", (F.col("before") + F.col("m")).alias("position"))
    turn = F.col("position") * (2 * np.pi / max(1, ends["n"]))
    return at.select("id", "position", (F.cos(turn) * radius).alias("x"), (F.sin(turn) * radius).alias("y"))
