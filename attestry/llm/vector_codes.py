"""Product codes of vectors: integer codebooks by Lloyd's rounds that skip what Yinyang bounds rule out."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Positional, Scratch, discard, join_weighed, materialize
from .dense import as_binary, extent, finite, floored, from_binary, integer_type, packed

#: Relative slack of a bound for each float operation on it.
SLACK = 1e-6


@dataclass
class Codebook:
    """Integer entries (part, entry, position), the group of each entry and how far each moved in the last round."""

    entries: np.ndarray
    groups: np.ndarray
    drift: np.ndarray

    @classmethod
    def start(cls, first: np.ndarray, parts: int, groups: int) -> Codebook:
        """Entries are the parts of the first vectors; each part's entries fall into groups by the nearest of spread-out seeds."""
        entries = first.reshape(len(first), parts, first.shape[1] // parts).transpose(1, 0, 2).astype(np.int64)
        own = np.zeros(entries.shape[:2], np.int64)
        for p, rows in enumerate(entries):
            seeds = [0] if len(rows) else []
            far = ((rows[:, None] - rows[None, seeds]) ** 2).sum(2).min(1) if len(rows) else np.zeros(0)
            while len(seeds) < min(groups, len(rows)):
                seeds.append(int(far.argmax()))
                far = np.minimum(far, ((rows - rows[seeds[-1]]) ** 2).sum(1))
            if len(rows):
                own[p] = ((rows[:, None] - rows[None, seeds]) ** 2).sum(2).argmin(1)
        return cls(entries, own, np.zeros(entries.shape[:2]))

    def moved(self, sums: dict[tuple[int, int], tuple[int, list[int]]]) -> Codebook:
        """Entries at floor(sum / count) of their parts; unused ones stay."""
        new = self.entries.copy()
        for (p, e), (n, total) in sums.items():
            new[p, e] = [int(t) // n for t in total]
        return Codebook(new, self.groups, np.sqrt(((new - self.entries) ** 2).sum(2)) * (1 + SLACK))

    def digest(self) -> str:
        """SHA-256 of all components by part, entry and position, as decimals between commas."""
        return hashlib.sha256(",".join(str(int(x)) for x in self.entries.ravel()).encode()).hexdigest()


def assign(vectors: np.ndarray, code: np.ndarray | None, lower: np.ndarray | None, book: Codebook) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Nearest entries of all parts: codes, lower bounds a group, squared distances, and the distances computed.

    vectors is (rows, parts, width) of integers. lower holds a bound below the distance from
    the part to every entry of a group but its own; it falls by the group's largest drift.
    Only groups whose bound isn't above the distance to the own entry are scanned, in
    integers, where the lower index wins a tie. Without codes all groups are.
    """
    n, parts, width = vectors.shape
    count = int(book.groups.max()) + 1 if book.groups.size else 1
    new_code, new_lower, best = np.zeros((n, parts), np.uint8), np.zeros((n, parts, count), np.float32), np.zeros((n, parts), np.int64)
    done = 0
    for p in range(parts):
        x, entries, group = vectors[:, p].astype(np.int64), book.entries[p], book.groups[p]
        members = [np.flatnonzero(group == g) for g in range(count)]
        if code is None:
            own, bound = np.zeros(n, np.int64), np.zeros((n, count))
            held = ((x - entries[0]) ** 2).sum(1)
        else:
            own = code[:, p].astype(np.int64)
            fall = np.array([book.drift[p][m].max() if len(m) else 0.0 for m in members])
            bound = np.maximum(lower[:, p].astype(np.float64) - fall, 0.0) * (1 - SLACK)
            held = ((x - entries[own]) ** 2).sum(1)
        done += n
        reach = np.sqrt(held.astype(np.float64)) * (1 + SLACK)
        to, least, second, scanned = own.copy(), held.copy(), [], []
        for g, m in enumerate(members):
            rows = np.flatnonzero(bound[:, g] <= reach) if len(m) else np.zeros(0, np.int64)
            d = ((x[rows][:, None] - entries[m][None]) ** 2).sum(2) if len(rows) else np.zeros((0, len(m)), np.int64)
            done += d.size
            scanned.append((rows, d))
            if len(rows):
                at = d.argmin(1)
                near, entry = d[np.arange(len(rows)), at], m[at]
                better = (near < least[rows]) | ((near == least[rows]) & (entry < to[rows]))
                to[rows[better]], least[rows[better]] = entry[better], near[better]
        for g, (m, (rows, d)) in enumerate(zip(members, scanned)):
            if len(rows):  # the least distance to a member that isn't the own entry
                other = np.where(m[None] == to[rows][:, None], np.iinfo(np.int64).max, d).min(1)
                bound[rows, g] = np.sqrt(other.astype(np.float64))
            left = np.flatnonzero((group[own] == g) & (to != own))  # the entry left behind counts among the others now
            bound[left, g] = np.minimum(bound[left, g], np.sqrt(held[left].astype(np.float64)))
        new_code[:, p], best[:, p] = to, least
        new_lower[:, p] = np.nextafter((bound * (1 - SLACK)).astype(np.float32), np.float32(0))
    return new_code, new_lower, best, done


def _round(batches: Iterator[pa.RecordBatch], book: Codebook, dtype: np.dtype, parts: int, width: int, first: bool, last: bool) -> Iterator[pa.RecordBatch]:
    """One assignment: the rows with their new codes and bounds, then sums of the parts of each entry (kind 1)."""
    count = int(book.groups.max()) + 1 if book.groups.size else 1
    sums, used, done = np.zeros(book.entries.shape, np.int64), np.zeros(book.entries.shape[:2], np.int64), 0
    names = ["kind", "id", "label", "v", "code", "bound", "error", "entry", "n", "total"]
    kinds = [pa.int32(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.int64())]

    def table(size: int, **columns) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([columns.get(c, pa.nulls(size, k)) for c, k in zip(names, kinds)], names)

    for batch in batches:
        if not batch.num_rows:
            continue
        v = from_binary(batch["v"], dtype, parts * width).reshape(-1, parts, width)
        code = lower = None
        if not first:
            code = from_binary(batch["code"], np.dtype(np.uint8), parts)
            lower = from_binary(batch["bound"], np.dtype(np.float32), parts * count).reshape(-1, parts, count)
        code, lower, best, work = assign(v, code, lower, book)
        done += work
        n = len(v)
        kept = {"code": as_binary(code), "error": pa.array(best.sum(1))} if last else {"v": batch["v"], "code": as_binary(code), "bound": as_binary(lower.reshape(n, -1))}
        yield table(n, kind=pa.array(np.zeros(n, np.int32)), id=batch["id"], label=batch["label"], **kept)
        if not last:
            for p in range(parts):
                np.add.at(sums[p], code[:, p], v[:, p])
                used[p] += np.bincount(code[:, p], minlength=used.shape[1])
    at = np.flatnonzero(used.ravel())
    yield table(len(at), kind=pa.array(np.ones(len(at), np.int32)), entry=pa.array(at.astype(np.int32)), n=pa.array(used.ravel()[at]), total=pa.array(list(sums.reshape(-1, width)[at]), pa.list_(pa.int64())))
    yield table(1, kind=pa.array([2], pa.int32()), n=pa.array([done]))


SCHEMA = "kind int, id long, label string, v binary, code binary, bound binary, error long, entry int, n long, total array<bigint>"


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: int = 4096, parts: int = 8, entries: int = 16, rounds: int = 6, groups: int = 4) -> DataFrame:
    """Product codes: (id, code, error, label_error, codebooks_sha256, distances) of every usable vector.

    Vectors become integers floor(scale x) and are cut into parts; each part's codebook
    starts as the parts of the first vectors by id (rows of one id by their components) and
    is refined in rounds of nearest assignment and floored means, then parts are assigned
    once more. code is two hex digits a part; error sums the squared distances; label_error
    sums errors over equal labels, nulls together; distances is how many distances all
    rounds computed, of rows x parts x entries x (rounds + 1) without bounds.

    A round reads the rows with their codes and bounds and writes them anew with each task's
    sums, so nothing but sums is shuffled, the driver sees one row an entry, and a lost
    executor costs a task of the present round. Vectors that are null or hold null or
    non-finite components are left out; shorter ones end in zeros up to the longest, and so
    does a length that parts don't divide. Fewer rows than entries give fewer entries;
    repeated rows count each; an empty table gives an empty result. Components too large
    for exact integer sums raise.
    """
    own = Positional(vectors.select(id_col, vector_col, label_col))
    usable = own.frame.where(finite(F.col(own(vector_col)))).select(F.col(own(id_col)).alias("id"), F.col(own(label_col)).alias("label"), floored(F.col(own(vector_col)), scale).alias("v"))
    n, dims, largest = extent(usable, "v")
    width = max(1, -(-dims // parts))
    dims, dtype = parts * width, integer_type(largest, parts * width)
    scratch = Scratch()
    order = F.transform("v", lambda x: x.cast("long"))
    head = usable.select("id", order.alias("v")).orderBy(F.col("id").asc_nulls_last(), "v").limit(entries).collect()
    first = np.zeros((len(head), dims), np.int64)
    for k, row in enumerate(head):
        first[k, : len(row["v"])] = row["v"]
    book, work, held = Codebook.start(first, parts, groups), 0, None
    now = usable.select(F.col("id").cast("long").alias("id"), F.col("label").cast("string").alias("label"), packed(F.col("v"), dtype, dims).alias("v"))
    for k in range(rounds + 1):
        step = partial(_round, book=book, dtype=dtype, parts=parts, width=width, first=k == 0, last=k == rounds)
        new = scratch(now.mapInArrow(step, SCHEMA))
        if held is not None:
            discard(held)
        held, now = new, new.where("kind = 0").select("id", "label", "v", "code", "bound")
        work += new.where("kind = 2").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
        if k < rounds:
            sums = [F.sum(F.col("total")[i].cast("decimal(38,0)")).alias(f"t{i}") for i in range(width)]
            totals = new.where("kind = 1").groupBy("entry").agg(F.sum("n").alias("n"), *sums).collect()  # a row an entry
            book = book.moved({divmod(r["entry"], book.entries.shape[1]): (r["n"], [r[f"t{i}"] for i in range(width)]) for r in totals})
    coded = held.where("kind = 0").select("id", F.concat(F.lit("="), "label").alias("key"), F.lower(F.hex("code")).alias("code"), "error").fillna("", ["key"])
    total = coded.groupBy("key").agg(F.count("*").alias("n"), F.sum("error").alias("label_error"))
    out = materialize(join_weighed(coded, total, ["key"], n).select(F.col("id").alias(id_col), "code", "error", "label_error"))
    scratch.clear()
    return out.withColumns({"codebooks_sha256": F.lit(book.digest()), "distances": F.lit(work).cast("long")})
