"""Near copies of vectors by cosine: int8 tile products with proven error bounds, exact products only where they can't decide."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Positional, Scratch, checked_broadcast, join_weighed, local_components, materialize
from .components import connected_components
from .dense import as_binary, extent, fields, finite, fit_centers, from_binary, nearest, padded, sample, small_batches

#: Rows of a tile's sides, and products of integers of this many components at most, which are exact in 32-bit floats (127 x 127 x 1024 < 2^24).
BLOCK, EXACT = 8192, 1024
#: Bound of the rounding of doubles in a product or norm of unit vectors.
ROUNDING = 1e-12


def quantise(unit: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Int8 rows, their scales and the norms of what quantising lost: |unit - scale * int8|."""
    scale = np.abs(unit).max(1, initial=0.0) / 127.0
    whole = np.rint(unit / np.where(scale > 0, scale, 1.0)[:, None]).astype(np.int8)
    lost = unit - scale[:, None] * whole
    return whole, scale, np.sqrt((lost * lost).sum(1)) + ROUNDING


def normed(values: np.ndarray) -> np.ndarray:
    """Rows of norm 1; safe for components of any finite size."""
    big = np.abs(values).max(1, initial=0.0)
    out = values / np.where(big > 0, big, 1.0)[:, None]
    length = np.sqrt((out * out).sum(1))
    return out / np.where(length > 0, length, 1.0)[:, None]


def integer_products(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Exact products of int8 rows, as floats."""
    if one.shape[1] <= EXACT:
        return one.astype(np.float32) @ two.astype(np.float32).T
    return one.astype(np.float64) @ two.astype(np.float64).T


def close_pairs(one: tuple, two: tuple, threshold: float, step: int = 512) -> Iterator[tuple[np.ndarray, np.ndarray, int, int]]:
    """Pairs (i, j) of rows of two sides (int8, scale, lost, unit) with a product of threshold or more, and how many pairs were bounded and recomputed.

    |x.y - sx sy qx.qy| <= lost_x + lost_y (1 + lost_x) for unit x and y: pairs that this bound
    puts above the threshold are taken, those it puts below are left, the others are
    multiplied in double precision.
    """
    q1, s1, e1, u1 = one
    q2, s2, e2, u2 = two
    most_s, most_e = s2.max(initial=0.0), e2.max(initial=0.0)
    for low in range(0, len(q1), step):
        at = slice(low, low + step)
        g = integer_products(q1[at], q2)
        least = threshold - ROUNDING - e1[at] - most_e * (1 + e1[at])  # of any row of the other side
        cut = np.where(s1[at] * most_s > 0, least / np.maximum(s1[at] * most_s, 1e-300), -np.inf) if threshold > 0 else np.full(len(g), -np.inf)
        cut = np.where(least > 0, cut, -np.inf).astype(np.float32)
        i, j = np.nonzero(g >= np.nextafter(cut, np.float32(-np.inf))[:, None])
        if not len(i):
            yield i, j, g.size, 0
            continue
        about = s1[at][i] * s2[j] * g[i, j].astype(np.float64)
        slack = e1[at][i] + e2[j] * (1 + e1[at][i]) + ROUNDING
        sure, open_ = about - slack >= threshold, np.abs(about - threshold) < slack
        doubt = np.flatnonzero(open_ & ~sure)
        for k in range(0, len(doubt), 1 << 16):
            own = doubt[k : k + (1 << 16)]
            sure[own] = np.einsum("ij,ij->i", u1[at][i[own]], u2[j[own]]) >= threshold
        yield i[sure] + low, j[sure], g.size, len(doubt)


def _side(rows: pa.StructArray, dims: int) -> tuple[np.ndarray, np.ndarray, tuple]:
    field = {f.name: rows.field(k) for k, f in enumerate(rows.type)}
    unit = from_binary(field["u"], np.dtype(np.float64), dims)
    return field["c"].to_numpy(), field["n"].to_numpy(), (*quantise(unit), unit)


def _tiles(batches: Iterator[pa.RecordBatch], dims: int, threshold: float) -> Iterator[pa.RecordBatch]:
    """Of each tile: per row its linked weight and the smallest row its links reach inside the tile; tile counts where c is null."""
    for batch in batches:
        same = batch["same"].to_pylist()
        for own, left, right in zip(same, fields(batch, "visitors"), fields(batch, "rows")):
            c1, n1, one = _side(left, dims)
            c2, n2, two = (c1, n1, one) if own else _side(right, dims)
            c, links = np.concatenate([c1, c2]), np.zeros(len(c1) + len(c2))
            ends, bounded, exact = (np.zeros(0, np.int64), np.zeros(0, np.int64)), 0, 0
            for i, j, pairs, again in close_pairs(one, two, threshold):
                bounded, exact = bounded + pairs, exact + again
                if own:
                    i, j = i[i < j], j[i < j]
                links[: len(c1)] += np.bincount(i, n2[j], len(c1))
                links[len(c1) :] += np.bincount(j, n1[i], len(c2))
                if len(i):  # what is joined so far is kept as one link a row
                    a, b = np.concatenate([ends[0], i]), np.concatenate([ends[1], j + (0 if own else len(c1))])
                    root = local_components(len(c), a, b)
                    ends = (moved := np.flatnonzero(root != np.arange(len(c))), root[moved])
            if own:
                links[: len(c1)] += links[len(c1) :]
                c, links = c1, links[: len(c1)]
            head = np.arange(len(c))
            head[ends[0]] = ends[1]
            low = c.copy()
            np.minimum.at(low, head, c)
            at = np.flatnonzero(links > 0)
            yield pa.RecordBatch.from_arrays(
                [pa.array([*c[at].tolist(), None], pa.int64()), pa.array([*low[head[at]].tolist(), exact], pa.int64()), pa.array([*links[at].astype(np.int64).tolist(), bounded], pa.int64())], ["c", "low", "links"]
            )


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = 0.9, block: int = BLOCK, most_centers: int = 1024, most_sample: int = 16384) -> DataFrame:
    """One row per vector: id, n_links (other vectors with a cosine of threshold or more), component_id (smallest id reachable by links), kept (id = component_id).

    Equal vectors are one class and meet nothing but through it. Classes fall to the nearest
    of some centres, fitted on about most_sample classes (one a block of classes, at most
    most_centers). A class visits a later centre's list only if its distance to the
    centre is within the list's radius plus the distance that the threshold allows, so no
    pair is lost; lists and their visitors meet in tiles of block x block rows. A tile tells
    a row's number of links and the smallest row it reaches, never its pairs. Work is
    quadratic where the centres rule nothing out; memory a task is two blocks.

    Vectors that are null, zero, empty or hold null or non-finite components link with
    nothing and stay; shorter vectors end in zeros. Repeated rows link with each other; a
    null id is its own component and reaches others under their ids. An empty table gives
    an empty result; other columns are left out. threshold is over 0 and at most 1.
    """
    if not 0 < threshold <= 1:
        raise ValueError("threshold must be over 0 and at most 1")
    spark, scratch = vectors.sparkSession, Scratch()
    own = Positional(vectors.select(id_col, vector_col))
    v = F.col(own(vector_col))
    sound = finite(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = own.frame.select(F.col(own(id_col)).cast("long").alias("id"), F.when(sound, v).alias("v"))
    _, dims, _ = extent(rows, "v")
    keys = [F.xxhash64(F.lit(k), F.col("v")).alias(f"h{k}") for k in (1, 2)]
    keyed = scratch(rows.select("id", *[F.when(F.col("v").isNotNull(), k).alias(f"h{i}") for i, k in enumerate(keys, 1)]))
    distinct = rows.where("v is not null").select("id", "v", *keys).groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("least"), F.any_value("v").alias("v"))
    classes = scratch(distinct.select(F.monotonically_increasing_id().alias("c"), "h1", "h2", "n", "least", _unit(dims)(F.col("v")).alias("u")))
    count = classes.count()
    picked = [r["u"] for r in sample(classes, "c", count, most_sample).select("c", "u").orderBy("c").collect()]
    points = np.frombuffer(b"".join(picked), np.float64).reshape(len(picked), dims) if dims else np.zeros((0, 0))
    centers = fit_centers(points, max(1, min(most_centers, -(-count // block)))) if len(points) else np.zeros((1, dims))
    placed = scratch(classes.select("c", "n", "u").mapInArrow(partial(_place, centers=centers), "c long, n long, u binary, own int, distance double"))
    sizes = {r["own"]: (r["k"], r["r"]) for r in placed.groupBy("own").agg(F.count("*").alias("k"), F.max("distance").alias("r")).collect()}  # a row a centre
    radius = np.array([sizes[k][1] if k in sizes else -np.inf for k in range(len(centers))])
    parts = [-(-sizes[k][0] // block) if k in sizes else 0 for k in range(len(centers))]
    reach = math.sqrt(2 - 2 * threshold) + 1e-9
    blocks = F.array(*[F.lit(p) for p in parts])
    dealt = placed.withColumn("at", F.pmod(F.xxhash64(F.lit(3), F.col("c")), blocks[F.col("own")]).cast("int"))
    packed = F.collect_list(F.struct("c", "n", "u"))
    lists = scratch(dealt.groupBy("own", "at").agg(packed.alias("rows")))
    visit = partial(_visit, centers=centers, radius=radius, reach=reach)
    visits = dealt.mapInArrow(visit, "own int, home int, chunk int, c long, n long, u binary")
    packs = visits.groupBy("own", "home", "chunk").agg(packed.alias("visitors"))
    each = packs.withColumn("at", F.explode(F.sequence(F.lit(0), blocks[F.col("own")] - 1))).select("own", "at", "visitors")
    others = each.hint("merge").join(lists, ["own", "at"]).select(F.lit(False).alias("same"), "visitors", "rows")
    inner = lists.select("own", F.col("at").alias("chunk"), F.col("rows").alias("visitors")).withColumn("at", F.explode(F.sequence(F.col("chunk"), blocks[F.col("own")] - 1)))
    none = F.array().cast(lists.schema["rows"].dataType)
    selves = inner.where("at = chunk").select(F.lit(True).alias("same"), "visitors", none.alias("rows"))
    inside = inner.where("at > chunk").hint("merge").join(lists, ["own", "at"]).select(F.lit(False).alias("same"), "visitors", "rows")
    tiles = selves.union(inside).union(others)
    with small_batches(spark, 1):
        found = scratch(tiles.mapInArrow(partial(_tiles, dims=dims, threshold=threshold), "c long, low long, links long"))
    edges = found.where("c <> low").select(F.col("c").alias("a"), F.col("low").alias("b"))
    groups = connected_components(edges)
    scratch.tables.append(groups)
    told = found.where("c is not null").groupBy("c").agg(F.sum("links").alias("links"))
    marked = classes.select("c", "h1", "h2", "n", "least").join(told, "c", "left").join(groups.withColumnRenamed("node", "c"), "c", "left")
    marked = scratch(marked.select("h1", "h2", "n", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "c").alias("component")))
    lowest = marked.groupBy("component").agg(F.count("*").alias("n"), F.min("least").alias("component_id"))
    labelled = join_weighed(marked.select("h1", "h2", F.col("n").alias("rows"), "n_links", "component"), lowest, ["component"], count)
    labelled = scratch(labelled.select("h1", "h2", F.col("rows").alias("n"), "n_links", "component_id"))
    known = join_weighed(keyed.where("h1 is not null"), labelled, ["h1", "h2"], keyed.count()).select("id", "n_links", "component_id")
    alone = keyed.where("h1 is null").select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    out = materialize(known.union(alone).select(F.col("id").alias(id_col), "n_links", "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")))
    work = found.where("c is null").agg(F.sum("links").alias("bounded"), F.sum("low").alias("recomputed")).first()
    out._attestry_work = {"classes": count, "bounded": work["bounded"] or 0, "recomputed": work["recomputed"] or 0}
    scratch.clear()
    return out


def _unit(dims: int):
    """Vectors of norm 1 as packed doubles."""

    @F.arrow_udf("binary")
    def run(values: pa.Array) -> pa.Array:
        return as_binary(normed(padded(values, dims)))

    return run


def _place(batches: Iterator[pa.RecordBatch], centers: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Each class with its nearest centre and the distance to it, rounded up."""
    for batch in batches:
        u = from_binary(batch["u"], np.dtype(np.float64), centers.shape[1])
        own = nearest(u, centers)
        away = np.sqrt(((u - centers[own]) ** 2).sum(1)) + 1e-9
        yield pa.RecordBatch.from_arrays([batch["c"], batch["n"], batch["u"], pa.array(own.astype(np.int32)), pa.array(away)], ["c", "n", "u", "own", "distance"])


def _visit(batches: Iterator[pa.RecordBatch], centers: np.ndarray, radius: np.ndarray, reach: float) -> Iterator[pa.RecordBatch]:
    """Each class once for every later centre whose list may hold a vector within reach of it."""
    for batch in batches:
        u, home = from_binary(batch["u"], np.dtype(np.float64), centers.shape[1]), batch["own"].to_numpy()
        squared = (u * u).sum(1)[:, None] + (centers * centers).sum(1)[None] - 2 * u @ centers.T
        away = np.sqrt(np.maximum(squared, 0.0)) - 1e-6
        i, to = np.nonzero((np.arange(len(centers))[None] > home[:, None]) & (away <= radius[None] + reach))
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), batch["own"].take(at), *[batch[c].take(at) for c in ("at", "c", "n", "u")]], ["own", "home", "chunk", "c", "n", "u"])
