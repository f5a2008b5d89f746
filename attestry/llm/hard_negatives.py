"""Hard negatives by exact search of k-means inverted lists that centroid radii bound."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Positional, Scratch, checked_broadcast, materialize
from .dense import cluster_count, extent, fields, finite, fit_centers, floored, from_binary, integer_type, nearest, packed, sample, small_batches

#: Rows of a list's block and anchors of a pack at most (about, for hashes deal them out).
BLOCK, PACK = 4096, 1024
#: Lists that each anchor visits before its thresholds rule others out.
PROBES = 8
NONE, LOWEST = np.iinfo(np.int64).max, np.iinfo(np.int64).min


def _place(batches: Iterator[pa.RecordBatch], centers: np.ndarray, dtype: np.dtype) -> Iterator[pa.RecordBatch]:
    """Each row with its nearest centre and the squared distance to it, exact."""
    for batch in batches:
        x = from_binary(batch["v"], dtype, centers.shape[1]).astype(np.float64)
        own = nearest(x, centers)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own.astype(np.int32)), pa.array(((x - centers[own]) ** 2).sum(1))], [*batch.schema.names, "list", "d2"])


def bounds(q: np.ndarray, centers: np.ndarray, radius: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """No less and no more than the inner products of q with the rows of each list: centre product +- |q| radius (Cauchy-Schwarz). All integers, held exactly."""
    at = q @ centers.T
    far = np.ceil(np.sqrt((q * q).sum(1))[:, None] * radius[None] * (1 + 1e-12))
    return at - far, at + far


def _visit(batches: Iterator[pa.RecordBatch], centers: np.ndarray, radius: np.ndarray, dtype: np.dtype, rest: bool) -> Iterator[pa.RecordBatch]:
    """An anchor with each list to visit. Its windows are arrays low, high and held: scores sought and the score of the last place held so far.

    First the PROBES lists of the highest upper bounds that reach into any window; then, as
    rest, all others whose upper bound isn't strictly below what some window still asks for.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        q = from_binary(batch["v"], dtype, centers.shape[1]).astype(np.float64)
        least, most = bounds(q, centers, radius)
        low, high, held = (batch[c].flatten().to_numpy().reshape(len(q), -1) for c in ("low", "high", "held"))
        asked = np.zeros(least.shape, bool)
        first = np.zeros(least.shape, bool)
        for w in range(low.shape[1]):
            meets = (most >= low[:, w, None]) & (least <= high[:, w, None]) & (low[:, w] <= high[:, w])[:, None]
            first |= meets
            asked |= meets & (most >= held[:, w, None])
        order = np.argsort(np.where(first, -most, np.inf), axis=1, kind="stable")[:, :PROBES]
        probed = np.zeros(least.shape, bool)
        np.put_along_axis(probed, order, True, axis=1)
        i, to = np.nonzero(asked & ~probed if rest else first & probed)
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([pa.array(to.astype(np.int32)), *[batch[c].take(at) for c in batch.schema.names]], ["list", *batch.schema.names])


def _search(batches: Iterator[pa.RecordBatch], dims: int, dtype: np.dtype, same: bool, take: int) -> Iterator[pa.RecordBatch]:
    """Of each pack of anchors and block of a list: the best take rows (a, w, r, id, score) of each window, by score, then id."""
    for batch in batches:
        for anchors, rows in zip(fields(batch, "anchors"), fields(batch, "rows")):
            a, x = ({f.name: s.field(k) for k, f in enumerate(s.type)} for s in (anchors, rows))
            q, v = (from_binary(s["v"], dtype, dims).astype(np.float64) for s in (a, x))
            score = (q @ v.T).astype(np.int64)
            mine, other = a["r"].to_numpy(), x["r"].to_numpy()
            fits = a["label"].to_numpy()[:, None] == x["label"].to_numpy()[None]
            fits = fits & (mine[:, None] != other[None]) if same else ~fits
            ids = x["id"].to_numpy()
            low, high, held = (a[c].flatten().to_numpy().reshape(len(q), -1) for c in ("low", "high", "held"))
            for w in range(low.shape[1]):
                ok = fits & (score >= np.maximum(low[:, w], held[:, w])[:, None]) & (score <= high[:, w, None])
                alive = np.flatnonzero(ok.any(1))
                if not len(alive):
                    continue
                own, ok = score[alive], ok[alive]
                if own.shape[1] > take:
                    floor = -np.partition(np.where(ok, -own, NONE), take - 1, axis=1)[:, take - 1]
                    ok &= own >= np.where(floor == -NONE, LOWEST, floor)[:, None]
                i, j = np.nonzero(ok)
                s = own[i, j]
                order = np.lexsort((other[j], ids[j], -s, i))
                i, j, s = i[order], j[order], s[order]
                best = np.arange(len(i)) - np.searchsorted(i, i, side="left") < take
                i, j, s = i[best], j[best], s[best]
                yield pa.RecordBatch.from_arrays([pa.array(mine[alive[i]]), pa.array(np.full(len(i), w, np.int32)), pa.array(other[j]), pa.array(ids[j]), pa.array(s)], ["a", "w", "r", "id", "score"])


class _Lists:
    """Rows in inverted lists: centres and radii (a row a list), and blocks of rows keyed by list and block."""

    def __init__(self, rows: DataFrame, n: int, dims: int, dtype: np.dtype, scratch: Scratch, most_lists: int, most_sample: int):
        picked = sample(rows, "r", n, most_sample).select("r", "v").orderBy("r").collect()
        points = np.frombuffer(b"".join(p["v"] for p in picked), dtype).reshape(len(picked), dims).astype(np.float64)
        self.centers = np.rint(fit_centers(points, cluster_count(n, most_lists))) if len(points) else np.zeros((1, dims))
        self.dims, self.dtype, self.scratch = dims, dtype, scratch
        placed = scratch(rows.mapInArrow(partial(_place, centers=self.centers, dtype=dtype), "r long, id long, label long, anchor boolean, v binary, list int, d2 double"))
        sizes = {s["list"]: s for s in placed.groupBy("list").agg(F.count("*").alias("n"), F.max("d2").alias("d2")).collect()}
        count = len(self.centers)
        self.radius = np.array([np.sqrt(sizes[k]["d2"]) if k in sizes else 0.0 for k in range(count)])
        self.blocks = F.array(*[F.lit(-(-sizes[k]["n"] // BLOCK) if k in sizes else 0) for k in range(count)])
        dealt = placed.withColumn("block", F.pmod(F.xxhash64("r"), self.blocks[F.col("list")]).cast("int"))
        self.rows = scratch(dealt.groupBy("list", "block").agg(F.collect_list(F.struct("r", "id", "label", "v")).alias("rows")))
        self.work: list[int] = []

    def best(self, anchors: DataFrame, take: int, same: bool) -> DataFrame:
        """(a, w, r, id, score, rank) of the best take rows of each window of anchors(r, label, v, low, high)."""
        found = None
        for rest in (False, True):
            held = F.transform("low", lambda _: F.lit(int(LOWEST)))
            if rest:
                last = found.where(F.col("rank") == take).groupBy("a").agg(F.map_from_entries(F.collect_list(F.struct("w", "score"))).alias("last")).withColumnRenamed("a", "r")
                asked = anchors.join(last, "r", "left")
                held = F.transform("low", lambda _, w: F.coalesce(F.col("last")[w.cast("int")], F.lit(int(LOWEST))))
            else:
                asked = anchors
            asked = asked.select("r", "label", "v", "low", "high", held.alias("held"))
            step = partial(_visit, centers=self.centers, radius=self.radius, dtype=self.dtype, rest=rest)
            window = "array<bigint>"
            visits = self.scratch(asked.mapInArrow(step, f"list int, r long, label long, v binary, low {window}, high {window}, held {window}"))
            counts = visits.groupBy("list").agg(F.count("*").alias("n"))  # a row a list
            self.work.append(visits.count())
            packs = visits.join(F.broadcast(counts), "list").withColumn("pack", F.pmod(F.xxhash64(F.lit(5), "r"), F.ceil(F.col("n") / PACK)).cast("int"))
            packs = packs.groupBy("list", "pack").agg(F.collect_list(F.struct("r", "label", "v", "low", "high", "held")).alias("anchors"))
            each = packs.where(self.blocks[F.col("list")] > 0).withColumn("block", F.explode(F.sequence(F.lit(0), self.blocks[F.col("list")] - 1)))
            with small_batches(visits.sparkSession, 8):
                new = self.scratch(each.hint("merge").join(self.rows, ["list", "block"]).select("anchors", "rows").mapInArrow(
                    partial(_search, dims=self.dims, dtype=self.dtype, same=same, take=take), "a long, w int, r long, id long, score long"
                ))
            listed = new if found is None else found.drop("rank").union(new)
            place = F.row_number().over(W.partitionBy("a", "w").orderBy(F.desc("score"), "id", "r"))
            found = self.scratch(listed.withColumn("rank", place).where(F.col("rank") <= take))
        return found


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 256,
    positives: int = 5, negatives: int = 3, least: int = 50, most: int = 95, most_lists: int = 2048, most_sample: int = 32768,
) -> DataFrame:
    """Hard negatives (anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of the rows that anchor marks.

    Scores are inner products of the integers floor(scale x). An anchor's positives are its
    best other rows of the same label; a positive's negatives the best rows of other labels
    with a score from least to most percent of the positive's. Higher scores first, ties
    by smaller id; ranks from 1.

    All rows lie in the inverted lists of k-means centres (as many as the root of the rows, at
    most most_lists), fitted on about most_sample rows; each list stores its radius. An
    anchor visits the lists of the highest Cauchy-Schwarz bounds first; then its thresholds
    are known and only lists go on whose bound isn't strictly below them and that reach into
    a window. The search is exact whatever the centres are. Anchors and lists meet in packs
    and blocks of bounded size, so a list or label with most of the rows is many tasks.

    Rows with a null id, label or vector, or with null or non-finite components take no
    part; shorter vectors end in zeros; a null mark is no anchor. Of repeated rows each
    counts, so a copy of an anchor may be its positive. A positive without negatives, an
    anchor without positives and an empty table give no rows; other columns are left out.
    Labels are whole numbers. Components too large for exact integer sums raise.
    """
    scratch = Scratch()
    marked = vectors.select(F.col(f"`{id_col}`"), F.col(f"`{vector_col}`"), F.col(f"`{label_col}`"), anchor.alias("__anchor"))
    own = Positional(marked)
    v = F.col(own(vector_col))
    usable = own.frame.where(finite(v) & F.col(own(id_col)).isNotNull() & F.col(own(label_col)).isNotNull())
    usable = usable.select(F.col(own(id_col)).cast("long").alias("id"), F.col(own(label_col)).cast("long").alias("label"), F.coalesce(F.col(own("__anchor")), F.lit(False)).alias("anchor"), floored(v, scale).alias("v"))
    n, dims, largest = extent(usable, "v")
    dims = max(1, dims)
    dtype = integer_type(largest, dims)
    rows = scratch(usable.select(F.monotonically_increasing_id().alias("r"), "id", "label", "anchor", packed(F.col("v"), dtype, dims).alias("v")))
    lists = _Lists(rows, n, dims, dtype, scratch, most_lists, most_sample)
    anchors = rows.where("anchor").select("r", "id", "label", "v")
    whole = [F.array(F.lit(int(x))) for x in (LOWEST, NONE)]
    near = lists.best(anchors.select("r", "label", "v", whole[0].alias("low"), whole[1].alias("high")), positives, same=True)
    scores = near.groupBy(F.col("a").alias("r")).agg(F.map_from_entries(F.collect_list(F.struct("rank", "score"))).alias("p"))
    places = F.sequence(F.lit(1), F.lit(positives))

    def limit(percent: int, up: int, none: int):
        """A percentage of each positive's score as a whole number; of a negative or missing one a window that holds nothing."""
        score = lambda k: F.col("p")[k]
        return F.transform(places, lambda k: F.coalesce(F.when(score(k) >= 0, F.call_function("div", F.lit(percent) * score(k) + up, F.lit(100).cast("long"))), F.lit(none).cast("long")))

    low, high = limit(least, 99, 1), limit(most, 0, 0)
    windows = anchors.join(scores, "r").select("r", "label", "v", low.alias("low"), high.alias("high"))
    far = lists.best(windows, negatives, same=False)
    pairs = near.select("a", (F.col("rank") - 1).alias("w"), F.col("id").alias("positive_id"), F.col("score").alias("positive_score"))
    out = pairs.join(far.select("a", "w", "rank", F.col("id").alias("negative_id"), F.col("score").alias("negative_score")), ["a", "w"])
    out = out.join(anchors.select(F.col("r").alias("a"), F.col("id").alias("anchor_id")), "a")
    out = materialize(out.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"))
    out._attestry_work = {"rows": n, "lists": len(lists.centers), "visits": lists.work}
    scratch.clear()
    return out
