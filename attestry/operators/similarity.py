"""The similarity graph kept between calls: exact links by pivots and the triangle inequality, refreshed for what is new."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import vectors as vx
from attestry.operators.governance import governed_entries
from attestry.sources.store import Store, arrow_batches

#: Rows of a block, pivots at most and vectors they are fitted on, about.
BLOCK, MOST_PIVOTS, FITTED = 2048, 1024, 16384
#: Groups of lists, and bytes of a group's vectors at which there become more groups.
GROUPS, GROUP_BYTES = 8, 1 << 26
PLACED = "id long, v binary, pivot int, distance double"


def usable_vectors(entries: DataFrame, dimensions: int | None = None) -> DataFrame:
    """(id, embedding) of governed entries whose vector is finite, not zero and of the stated length."""
    rows = governed_entries(entries).where("embedding is not null")
    size = F.lit(dimensions) if dimensions else F.size("embedding")
    finite = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))
    return rows.where((F.size("embedding") == size) & finite & (vx.norm(F.col("embedding")) > 0)).select("id", "embedding")


def fit_pivots(points: np.ndarray, count: int, rounds: int = 4) -> np.ndarray:
    """Means of groups of a bounded sample of unit vectors, by a few rounds of nearest assignment."""
    _, first = np.unique(points, axis=0, return_index=True)
    pivots = points[np.sort(first)[:count]].copy()
    for _ in range(rounds):
        own = (points @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)
        total, n = np.zeros_like(pivots), np.bincount(own, minlength=len(pivots))
        np.add.at(total, own, points)
        pivots[n > 0] = total[n > 0] / n[n > 0, None]
    return pivots


def _rows(values: pa.Array, dims: int) -> np.ndarray:
    values = values.cast(pa.binary())
    if not len(values):
        return np.zeros((0, dims))
    at = np.frombuffer(values.buffers()[1], np.int32)[values.offset : values.offset + len(values) + 1]
    return np.frombuffer(values.buffers()[2], np.uint8)[at[0] : at[-1]].view(np.float64).reshape(len(values), dims)


def _place(batches: Iterator[pa.RecordBatch], pivots: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Unit vectors with their nearest pivot and the distance to it, rounded up."""
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch["embedding"]
        x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        own = (x @ pivots.T - (pivots * pivots).sum(1) / 2).argmax(1)
        away = np.linalg.norm(x - pivots[own], axis=1) + 1e-9
        yield pa.RecordBatch.from_arrays([batch["id"], pa.array([r.tobytes() for r in x], pa.binary()), pa.array(own.astype(np.int32)), pa.array(away)], ["id", "v", "pivot", "distance"])


def _open(x: np.ndarray, pivots: np.ndarray, radius: np.ndarray, reach: float) -> np.ndarray:
    """Which lists may hold a vector within reach of each row."""
    away = np.sqrt(np.maximum((x * x).sum(1)[:, None] + (pivots * pivots).sum(1)[None] - 2 * x @ pivots.T, 0.0)) - 1e-6
    return away <= radius[None] + reach


def _visit(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, reach: float, member: np.ndarray, later: bool) -> Iterator[pa.RecordBatch]:
    """Each vector once for every group of lists that may hold one within reach of it; with later, of the groups after its own."""
    for batch in batches:
        x, home, own = _rows(batch["v"], pivots.shape[1]), batch["pivot"].to_numpy(), batch["x"].to_numpy()
        open_ = _open(x, pivots, radius, reach)
        if later:
            open_ &= np.arange(len(pivots))[None] >= home[:, None]
        to = open_.astype(np.float32) @ member.T.astype(np.float32) > 0
        if later:
            to &= np.arange(len(member))[None] > own[:, None]
        i, y = np.nonzero(to)
        at = pa.array(i)
        yield pa.RecordBatch.from_arrays([batch["x"].take(at), pa.array(y.astype(np.int32)), pa.array(np.zeros(len(i), np.int32)), *[batch[c].take(at) for c in ("pivot", "id", "v")]], ["x", "y", "side", "pivot", "id", "v"])


def _pairs(ia: np.ndarray, a: np.ndarray, ib: np.ndarray, b: np.ndarray, own: bool, threshold: float) -> pa.RecordBatch:
    """Pairs (a, b, similarity) over the threshold, and with a null a how many were compared; of a list with itself those in the order of ids."""
    s = a @ b.T
    i, j = np.nonzero(s >= threshold)
    compared = s.size
    if own:
        i, j = i[ia[i] < ib[j]], j[ia[i] < ib[j]]
        compared = int((ia[:, None] < ib[None]).sum())
    last = np.zeros(len(i) + 1, bool)
    last[-1] = True
    return pa.RecordBatch.from_arrays([pa.array(np.append(ia[i], 0), pa.int64(), mask=last), pa.array(np.append(ib[j], compared), pa.int64()), pa.array(np.append(s[i, j], 0.0))], ["a", "b", "similarity"])


def _meet(batches: Iterator[pa.RecordBatch], pivots: np.ndarray, radius: np.ndarray, reach: float, threshold: float, same: bool) -> Iterator[pa.RecordBatch]:
    """Visitors (side 0) against the lists of one group (side 1), block by block; of one table with itself each pair once."""
    rows = pa.Table.from_batches(batches).combine_chunks()
    if not rows.num_rows:
        return
    within = same and rows["x"][0].as_py() == rows["y"][0].as_py()
    side, pivot, ids = (rows[c].combine_chunks().to_numpy() for c in ("side", "pivot", "id"))
    v = _rows(rows["v"].combine_chunks(), pivots.shape[1])
    ours, theirs = (np.arange(len(ids)), np.arange(len(ids))) if within else (np.flatnonzero(side == 0), np.flatnonzero(side == 1))
    ours, theirs = ours[np.lexsort((ids[ours], pivot[ours]))], theirs[np.lexsort((ids[theirs], pivot[theirs]))]
    lists = np.unique(pivot[theirs])
    begin, end = np.searchsorted(pivot[theirs], lists), np.searchsorted(pivot[theirs], lists, "right")
    for start in range(0, len(ours), BLOCK):
        block = ours[start : start + BLOCK]
        open_ = _open(v[block], pivots[lists], radius[lists], reach)
        if same:
            open_ &= pivot[block][:, None] < lists[None]
            open_ |= pivot[block][:, None] == lists[None]
        if open_.mean() > 0.5:  # bounds rule out little: whole blocks are one product each, of a group with itself those from this block on
            for low in range(start if within else 0, len(theirs), BLOCK):
                there = theirs[low : low + BLOCK]
                yield _pairs(ids[block], v[block], ids[there], v[there], within and low == start, threshold)
            continue
        for k in np.flatnonzero(open_.any(0)):
            come = block[open_[:, k]]
            home = pivot[come] == lists[k]
            for low in range(begin[k], end[k], BLOCK):
                there = theirs[low : min(end[k], low + BLOCK)]
                # within a group a list meets itself in the order of ids; else its parts lie in two groups
                for some, own in ((come[~home], False), (come[home], within)) if same else ((come, False),):
                    if len(some):
                        yield _pairs(ids[some], v[some], ids[there], v[there], own, threshold)


@dataclass
class Pivots:
    """Lists of unit vectors around pivots, and the exact join on them."""

    pivots: np.ndarray
    threshold: float

    @classmethod
    def fit(cls, rows: DataFrame, threshold: float) -> Pivots:
        """Pivots of rows(id, embedding): as many as the root of the rows, at most MOST_PIVOTS, from about FITTED of them."""
        count = rows.count()
        some = rows if count <= FITTED else rows.where(F.pmod(F.xxhash64(F.lit(11), "id"), F.lit(1 << 30)) < int(FITTED / count * (1 << 30)))
        points = np.array([r["embedding"] for r in some.orderBy("id").collect()], dtype=np.float64)
        if not len(points):
            return cls(np.zeros((1, 1)), threshold)
        points /= np.linalg.norm(points, axis=1, keepdims=True)
        return cls(fit_pivots(points, max(1, min(MOST_PIVOTS, math.isqrt(count)))), threshold)

    def place(self, rows: DataFrame) -> DataFrame:
        return rows.select("id", F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(partial(_place, pivots=self.pivots), PLACED)

    def join(self, visitors: DataFrame, listed: DataFrame, same: bool) -> DataFrame:
        """(a, b, similarity) of pairs over the threshold, and counts (null, compared, 0); of one table with itself each pair once.

        A visitor goes to the lists whose radius, stretched by the distance that the
        threshold allows, reaches it: d(x, y) >= d(x, pivot) - d(y, pivot) proves that the
        others hold nothing. Neighbouring lists lie in groups, and a vector is sent once to a
        group, however many of its lists are open: GROUPS times at most, until a group's
        vectors would fill GROUP_BYTES. From there groups keep that size and grow in number.
        """
        dims, count = self.pivots.shape[1], len(self.pivots)
        sizes = {r["pivot"]: r for r in listed.groupBy("pivot").agg(F.count("*").alias("n"), F.max("distance").alias("r")).collect()}  # a row a pivot
        radius = np.array([sizes[k]["r"] if k in sizes else -np.inf for k in range(count)])
        held = [sizes[k]["n"] if k in sizes else 0 for k in range(count)]
        size = lambda n: max(1, min(max(BLOCK // 8, -(-n // GROUPS)), max(BLOCK, GROUP_BYTES // (8 * dims))))  # noqa: E731  rows of a group
        most = size(sum(held))
        chunks = [max(1, -(-n // most)) for n in held]
        starts, groups, filled = [], 0, 0
        for n, parts in zip(held, chunks):  # lists in turn fill groups; one that is too long for a group has groups of its own
            if filled and filled + n > most:
                groups, filled = groups + 1, 0
            starts.append(groups)
            groups, filled = (groups + parts, 0) if parts > 1 else (groups, filled + n)
        groups += 1
        member = np.zeros((groups, count), bool)
        for k, (at, parts) in enumerate(zip(starts, chunks)):
            member[at : at + parts, k] = held[k] > 0
        number = lambda values: F.array(*[F.lit(x) for x in values])[F.col("pivot")]
        chunk = lambda n: F.pmod(F.xxhash64(F.lit(3), "id"), n).cast("int")
        grouped = listed.withColumn("y", number(starts) + chunk(number(chunks)))
        if same:
            ours = grouped.withColumnRenamed("y", "x")
            across = F.sequence(F.lit(0), F.col("y"))
        else:
            n = visitors.count()
            parts = -(-n // size(n)) if n else 1
            ours = visitors.withColumn("x", chunk(F.lit(parts)))
            across = F.sequence(F.lit(0), F.lit(parts - 1))
        columns = ["x", "y", "side", "pivot", "id", "v"]
        sent = ours.select("x", "pivot", "id", "v").mapInArrow(partial(_visit, pivots=self.pivots, radius=radius, reach=_reach(self.threshold), member=member, later=same), "x int, y int, side int, pivot int, id long, v binary")
        stay = grouped.withColumn("x", F.explode(across)).withColumn("side", F.lit(1)).select(*columns)
        pivots, reach, threshold = self.pivots, _reach(self.threshold), self.threshold

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            return _meet(batches, pivots, radius, reach, threshold, same)

        return sent.union(stay).groupBy("x", "y").applyInArrow(meet, "a long, b long, similarity double")


def _reach(threshold: float) -> float:
    """The distance of unit vectors whose cosine is the threshold."""
    return math.sqrt(max(0.0, 2 - 2 * threshold)) + 1e-9


@dataclass
class Refreshed:
    """New vectors, vectors that left or changed, pairs compared, and all pairs there are."""

    new: int
    gone: int
    compared: int
    pairs: int


class SimilarityGraph:
    """Links of cosine of threshold or more between governed entries, in one folder. A refresh compares new vectors only."""

    def __init__(self, spark: SparkSession, root: str, threshold: float = 0.75) -> None:
        self.spark, self.store, self.threshold = spark, Store(spark, root), threshold

    def refresh(self, entries: DataFrame) -> Refreshed:
        """Bring the links up to date with entries(id, embedding, lifecycle).

        Vectors that weren't here, or were other ones, meet all; links of those that left go.
        The first call fits the pivots, which later ones keep: bounds hold for any.
        """
        change = self.store.begin()
        now = usable_vectors(entries)
        known = "pivots" in change.base["notes"]
        if known:
            pivots = Pivots(np.array(change.base["notes"]["pivots"]), change.base["notes"]["threshold"])
            if pivots.threshold != self.threshold:
                raise ValueError(f"the graph was built for a threshold of {pivots.threshold}")
            old = change.read("vectors")
        else:
            pivots = Pivots.fit(now, self.threshold)
            old = self.spark.createDataFrame([], PLACED)
        with arrow_batches(self.spark, 4096):
            fresh = change.append("placed", pivots.place(now))
        stay = old.join(fresh.select("id", "v"), ["id", "v"], "left_semi")
        new = fresh.join(old.select("id", "v"), ["id", "v"], "left_anti")
        kept, added = old.count(), new.count()
        stayed = stay.count()
        with arrow_batches(self.spark, 1, "64m"):
            found = pivots.join(new, new, True)
            if stayed:
                found = found.union(pivots.join(new, stay, False))
            raw = change.append("found", found)
        compared = raw.where("a is null").agg(F.coalesce(F.sum("b"), F.lit(0)).alias("n")).first()["n"]
        links = raw.where("a is not null").select(F.least("a", "b").alias("source_id"), F.greatest("a", "b").alias("target_id"), "similarity")
        links = links.union(links.select("target_id", "source_id", "similarity"))
        if known:
            ids = stay.select("id")
            held = change.read("links").join(ids.withColumnRenamed("id", "source_id"), "source_id", "left_semi").join(ids.withColumnRenamed("id", "target_id"), "target_id", "left_semi")
            links = held.select("source_id", "target_id", "similarity").union(links)
        change.replace("links", links.repartitionByRange("source_id").sortWithinPartitions("source_id"))
        change.replace("vectors", fresh)
        for name in ("placed", "found"):
            change.tables.pop(name)
        change.commit(pivots=pivots.pivots.tolist(), threshold=self.threshold)
        n = stayed + added
        return Refreshed(added, kept - stayed, compared, n * (n - 1) // 2)

    def edges(self) -> DataFrame:
        """(source_id, target_id, similarity) both ways, as of the last refresh."""
        return self.store.read("links").select("source_id", "target_id", "similarity")

    def neighbours(self, ids: list[int]) -> DataFrame:
        """Links of a few entries; only their part of the files is read."""
        return self.edges().where(F.col("source_id").isin(ids))



def links_of(seeds: DataFrame, entries: DataFrame, threshold: float) -> DataFrame:
    """(source_id, target_id, similarity) of the links of a few seeds(entry_id): their vectors meet all others in one pass, no graph is built."""
    rows = usable_vectors(entries)
    asked = rows.join(F.broadcast(seeds.select(F.col("entry_id").alias("id")).distinct()), "id", "left_semi").collect()  # a row a seed
    ids = np.array([r["id"] for r in asked], np.int64)
    units = [np.array(r["embedding"], np.float64) for r in asked]
    units = [x / np.linalg.norm(x) for x in units]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not units:
                continue
            lists, targets = batch["embedding"], batch["id"].to_numpy()
            x = lists.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(lists), -1)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            s = np.stack(units) @ x.T
            i, j = np.nonzero((s >= threshold) & (ids[:, None] != targets[None]))
            yield pa.RecordBatch.from_arrays([pa.array(ids[i]), pa.array(targets[j]), pa.array(s[i, j])], ["source_id", "target_id", "similarity"])

    return rows.select("id", "embedding").mapInArrow(meet, "source_id long, target_id long, similarity double")
