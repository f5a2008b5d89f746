"""Connected components of a distributed edge list."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, join_weighed, local_components, materialize


def _fingerprint(edges: DataFrame) -> tuple:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)")).alias("h")).first()
    return row["n"], row["h"]


def _in_one_task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    whole = pd.concat([pd.DataFrame({"u": [], "v": []}, dtype=np.int64), *frames])
    nodes, at = np.unique(whole[["u", "v"]].to_numpy(), return_inverse=True)
    at = at.reshape(-1, 2)
    yield pd.DataFrame({"node": nodes, "component": nodes[local_components(len(nodes), at[:, 0], at[:, 1])]})


def connected_components(edges: DataFrame, max_rounds: int = 60, most_local: int = 1 << 20) -> DataFrame:
    """Label every node of edges(a, b) (long) with the smallest node it reaches.

    Up to most_local links (counted; 16 MB) are joined in one task. Beyond, rounds of joins:

    alternates large-star and small-star steps (Kiveris et al., 2014): every step keeps
    at most one link per old link, so hubs never expand into pairs, and each round is
    written to the shared folder. Self links and repeated links are harmless. Returns
    (node, component) for nodes that have a link to another node; empty for no edges.
    """
    current = materialize(
        edges.where("a <> b and a is not null and b is not null")
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    )
    before = _fingerprint(current)
    if before[0] <= most_local:
        out = materialize(current.coalesce(1).mapInPandas(_in_one_task, "node long, component long"))
        discard(current)
        return out
    for _ in range(max_rounds):
        if before[0] == 0:
            break
        # large star: neighbours above u go to the smallest of u and its neighbours
        both = current.select("u", "v").union(current.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", "n", F.least("u", "m").alias("m"))
        large = join_weighed(both, low, ["u"], 2 * before[0]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        # small star: neighbours below u go to the smallest of them, and so does u
        large = materialize(large)
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        joined = join_weighed(large, least, ["u"], 2 * before[0])
        small = (
            joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
            .union(least.select("u", F.col("m").alias("v"))).distinct()
        )
        new = materialize(small)
        after = _fingerprint(new)
        discard(current)
        discard(large)
        current = new
        if after == before:
            break
        before = after
    else:
        raise RuntimeError("components did not settle")
    members = current.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.union(current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
