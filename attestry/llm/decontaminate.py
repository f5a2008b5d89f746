"""Benchmark decontamination: SimHash of item-sized windows, multi-index blocks, exact verification."""

from __future__ import annotations

from collections import Counter, defaultdict
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize

#: Bytes as words see them: A-Z lowered, ASCII white space and marks parting words (0).
_MAP = np.arange(256, dtype=np.uint8)
_MAP[65:91] += 32
_MAP[[b for b in range(128) if not chr(b).isalnum()]] = 0
_RANDOM = np.random.default_rng(20240101)
_PLACE = _RANDOM.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RANDOM.integers(0, 1 << 63, 8, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_SPAN = 2 << 20
_FILTER_BITS = 22


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0x9E3779B97F4A7C15)
    return h ^ (h >> np.uint64(29))


def hashed_words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words in a run of bytes, and where they start."""
    seen = _MAP[data]
    edge = np.diff((seen > 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64), start
    inside = np.flatnonzero(seen)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(len(inside)) - np.repeat(first, length)
    part = seen[inside].astype(np.uint64) * _PLACE[place & 511] + (place >> 9).astype(np.uint64)
    return _mix(np.add.reduceat(part, first)), start


def shingles(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words."""
    n = len(words) - size + 1
    if n < 1:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h + words[k : k + n] * _TURN[k]
    return _mix(h)


def item_shingles(text: bytes | None, size: int) -> tuple[np.ndarray, int]:
    """Shingle hashes of an item and the words of each: size, or all words of a shorter item; 0 without words."""
    words, _ = hashed_words(np.frombuffer(text or b"", np.uint8))
    k = min(size, len(words))
    return (shingles(words, k), k) if k else (words, 0)


def window_fingerprints(marks: np.ndarray, weights: np.ndarray, size: int) -> np.ndarray:
    """Weighted SimHash of every run of size shingles."""
    bits = np.unpackbits(marks.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
    total = np.concatenate((np.zeros((1, 64)), np.cumsum((bits * 2.0 - 1.0) * weights[:, None], axis=0)))
    # sums are compared with a slack, so that equal windows agree whatever stood before them
    return np.packbits(total[size:] - total[:-size] > 1e-6, axis=1).view(">u8").reshape(-1).astype(np.uint64)


@cache
def _near_values(bits: int) -> np.ndarray:
    """The bytes within so many bits of each byte, as many for every one."""
    byte = np.arange(256, dtype=np.uint8)
    return np.array([np.flatnonzero(np.bitwise_count(byte ^ v) <= bits) for v in byte], dtype=np.uint8)


@dataclass
class BlockLookup:
    """Fingerprints by the values of their 8 blocks of 8 bits.

    Two fingerprints within radius differ in at most radius // 8 bits of some block, so
    each is filed in every block under all values so near, and a look-up of the 8 values
    of another finds it.
    """

    items: np.ndarray
    prints: np.ndarray
    starts: list[np.ndarray]
    filed: list[np.ndarray]
    radius: int

    @classmethod
    def build(cls, items: np.ndarray, prints: np.ndarray, radius: int) -> BlockLookup:
        near = _near_values(radius // 8)
        starts, filed = [], []
        for value in prints.astype(">u8").view(np.uint8).reshape(-1, 8).T:
            under = near[value].reshape(-1)
            order = np.argsort(under, kind="stable")
            starts.append(np.searchsorted(under[order], np.arange(257)))
            filed.append((order // near.shape[1]).astype(np.int32))
        return cls(items, prints, starts, filed, radius)

    def near(self, prints: np.ndarray, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray]:
        """(position, item) of all within the radius, some prints at a time so that at most about most look-ups are held."""
        step, left, right = max(1, most // max(1, 8 * len(self.items))), [], []
        for at in range(0, len(prints), step):
            own = prints[at : at + step]
            keys = []
            for b, value in enumerate(own.astype(">u8").view(np.uint8).reshape(-1, 8).T):
                low, count = self.starts[b][value], self.starts[b][value.astype(np.int64) + 1] - self.starts[b][value]
                place = np.repeat(low - np.cumsum(count) + count, count) + np.arange(count.sum())
                keys.append(np.repeat(np.arange(len(own)), count) * len(self.items) + self.filed[b][place])
            window, k = np.divmod(np.unique(np.concatenate(keys)), max(1, len(self.items)))
            close = np.bitwise_count(own[window] ^ self.prints[k]) <= self.radius
            left.append(window[close] + at)
            right.append(self.items[k[close]])
        return np.concatenate(left) if left else np.zeros(0, np.int64), np.concatenate(right) if right else np.zeros(0, np.int64)


@dataclass
class BenchmarkIndex:
    """Items by number of shingles with their fingerprints in Hamming blocks."""

    ids: list
    counts: list[Counter]
    weight: dict[int, float]
    other: float
    totals: list[float]
    radius: int
    threshold: float
    keys: dict[int, np.ndarray]  # shingle hashes of items, by shingle size
    holders: dict[int, dict[int, list[int]]]  # items by shingle hash, by shingle size
    lengths: list[tuple[int, int]]  # words of a shingle, shingles of an item
    prints: np.ndarray
    blocks: dict[tuple[int, int], BlockLookup]  # by length

    @classmethod
    def build(cls, items: list[tuple], size: int = 5, threshold: float = 0.8, radius: int = 20, whole: tuple[int, dict[int, int]] | None = None) -> BenchmarkIndex:
        """whole: what shared_shingles() says of the benchmark that items are a part of; by default they are all of it."""
        ids, marks, lengths = [], [], []
        for item, text in items:
            found, k = item_shingles(text if isinstance(text, (bytes, bytearray)) else (text or "").encode("utf-8", "surrogatepass"), size)
            if k:
                ids.append(item)
                marks.append(found)
                lengths.append((k, len(found)))
        counts = [Counter(m.tolist()) for m in marks]
        number, spread = whole or (len(ids), Counter(h for c in counts for h in c))
        other = float(np.log(1 + number))  # also that of shingles which one item has
        weight = {h: float(np.log(1 + number / n)) for h, n in spread.items() if n > 1}  # shingles that many items share say less
        totals = [sum(weight.get(h, other) * n for h, n in c.items()) for c in counts]
        holders: dict[int, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        for i, c in enumerate(counts):
            for h in c:
                holders[lengths[i][0]][h].append(i)
        keys = {k: np.sort(np.array(list(h), dtype=np.uint64)) for k, h in holders.items()}
        prints = np.array([window_fingerprints(m, np.array([weight.get(h, other) for h in m.tolist()]), len(m))[0] for m in marks], dtype=np.uint64)
        blocks = {}
        for length in set(lengths):
            own = np.array([i for i, x in enumerate(lengths) if x == length])
            blocks[length] = BlockLookup.build(own, prints[own], radius)
        return cls(ids, counts, weight, other, totals, radius, threshold, keys, {k: dict(h) for k, h in holders.items()}, lengths, prints, blocks)

    def candidates(self, prints: np.ndarray, length: tuple[int, int], among: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs within the radius among items of a length; among (sorted) names those that can be similar."""
        index = self.blocks[length]
        if among is not None:
            own = np.intersect1d(index.items, among, assume_unique=True)
            if 4 * len(own) < len(index.items):
                index = BlockLookup.build(own, self.prints[own], self.radius)
        return index.near(prints)

    def similarity(self, window: list[int], item: int) -> float:
        """Weighted Jaccard of two shingle multisets."""
        own, both, total = self.counts[item], 0.0, 0.0
        for h, n in Counter(window).items():
            w = self.weight.get(h, self.other)
            total += w * n
            both += w * min(n, own.get(h, 0))
        return both / (total + self.totals[item] - both)

    def leaks(self, texts: list[bytes | None]) -> list[list[dict]]:
        """For each text the items it holds: item_id, similarity of the best window, its first word."""
        out: list[list[dict]] = [[] for _ in texts]
        at = 0
        while at < len(texts):
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or b"") < _SPAN):
                size += len(texts[upto] or b"") + 1
                upto += 1
            self._scan(texts, at, upto, out)
            at = upto
        return out

    def _scan(self, texts: list[bytes | None], at: int, upto: int, out: list) -> None:
        pieces = [t or b"" for t in texts[at:upto]]
        words, start = hashed_words(np.frombuffer(b" ".join(pieces), np.uint8))
        bounds = np.searchsorted(start, np.cumsum([0, *(len(p) + 1 for p in pieces)]))
        for size, keys in self.keys.items():
            marks = shingles(words, size)
            if not len(marks):
                continue
            shift = np.uint64(64 - _FILTER_BITS)
            sieve = np.zeros(1 << _FILTER_BITS, dtype=bool)
            sieve[keys >> shift] = True
            maybe = np.flatnonzero(sieve[marks >> shift])
            slot = np.minimum(np.searchsorted(keys, marks[maybe]), len(keys) - 1)
            hits = maybe[keys[slot] == marks[maybe]]
            doc = np.searchsorted(bounds, hits, side="right") - 1
            fits = hits + size <= bounds[doc + 1]  # no shingle over the edge of a text
            hits, doc = hits[fits], doc[fits]
            for run in np.split(np.arange(len(hits)), np.flatnonzero(np.diff(doc)) + 1):
                if len(run):
                    d = int(doc[run[0]])
                    low, high = int(bounds[d]), int(bounds[d + 1]) - size + 1
                    found = self._windows(marks[low:high], hits[run] - low, size)
                    out[at + d] += [{"item_id": self.ids[i], "similarity": s, "start": w} for i, (s, w) in sorted(found.items())]

    def _windows(self, marks: np.ndarray, hits: np.ndarray, size: int) -> dict[int, tuple[float, int]]:
        """Best window of each item in one text; hits are its shingles that some item has.

        A window without a hit shares nothing with any item, so windows are fingerprinted
        where one can hold a hit, and nowhere else; an item of which a stretch of windows
        holds no shingle is not looked up there.
        """
        best, held = self._short(marks, hits, size), self.holders[size]
        lengths = {self.lengths[i] for h in np.unique(marks[hits]).tolist() for i in held[h]}
        for length in sorted(lengths):
            n = length[1]
            if len(marks) < n:
                continue  # compared whole by _short()
            first, last = np.maximum(hits - n + 1, 0), np.minimum(hits, len(marks) - n)  # starts of windows with that hit
            part = np.append(0, np.flatnonzero(first[1:] > last[:-1] + 1) + 1)
            for a, b in zip(first[part], np.append(last[part[1:] - 1], last[-1])):
                region = marks[a : b + n]
                weight = np.array([self.weight.get(h, self.other) for h in region.tolist()])
                inside = hits[np.searchsorted(hits, a) : np.searchsorted(hits, b + n)]
                among = np.unique(np.concatenate([held[h] for h in np.unique(marks[inside]).tolist()]))
                window, item = self.candidates(window_fingerprints(region, weight, n), length, among)
                own = region.tolist()
                for w, i in zip(window.tolist(), item.tolist()):
                    s = self.similarity(own[w : w + n], i)
                    if s >= self.threshold and (i not in best or s > best[i][0]):
                        best[i] = (s, int(a) + w)
        return best

    def _short(self, marks: np.ndarray, hits: np.ndarray, size: int) -> dict[int, tuple[float, int]]:
        """Items with more shingles than the text, which is then their one window as a whole.

        The comparison is exact: an item in reach shares more weight than the shingles
        left out hold, so it holds one of the others; those of fewest items are asked.
        """
        n = len(marks)
        if max(k for s, k in self.blocks if s == size) <= n:
            return {}
        own, held = marks.tolist(), self.holders[size]
        count = Counter(own)
        load = {h: self.weight.get(h, self.other) * k for h, k in count.items()}
        total = sum(load.values())
        seen = sorted(set(marks[hits].tolist()), key=lambda h: (len(held[h]), h))
        rest, asked = sum(load[h] for h in seen), set()
        for h in seen:
            if rest < self.threshold * total - 1e-9:
                break
            rest -= load[h]
            asked.update(i for i in held[h] if self.lengths[i][1] > n and self.totals[i] * self.threshold <= total + 1e-9)
        found = {i: self.similarity(own, i) for i in asked}
        return {i: (s, 0) for i, s in found.items() if s >= self.threshold - 1e-9}  # sums in another order may fall short of a tie


def leak_column(text: Column, index: BenchmarkIndex, kind: str = "bigint") -> Column:
    """Items that a text holds, as an array of (item_id, similarity, start)."""
    arrow = pa.list_(pa.struct([("item_id", pa.string() if kind == "string" else pa.int64()), ("similarity", pa.float64()), ("start", pa.int64())]))

    @F.arrow_udf(f"array<struct<item_id:{kind},similarity:double,start:bigint>>")
    def leaks(values: pa.Array) -> pa.Array:
        return pa.array(index.leaks(values.to_pylist()), arrow)

    return leaks(text.cast("binary"))


def shingle_column(text: Column, size: int) -> Column:
    """Distinct shingle hashes of an item."""

    @F.arrow_udf("array<bigint>")
    def marks(values: pa.Array) -> pa.Array:
        return pa.array([np.unique(item_shingles(v, size)[0]).view(np.int64) for v in values.to_pylist()], pa.list_(pa.int64()))

    return marks(text.cast("binary"))


def shared_shingles(items: DataFrame) -> tuple[int, dict[int, int]]:
    """Number of items(marks) with words, and how many hold each shingle that more than one holds."""
    held = items.where(F.size("marks") > 0)
    shared = held.select(F.explode("marks").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 1").toPandas()
    return held.count(), dict(zip(shared["h"].to_numpy(dtype=np.int64).view(np.uint64).tolist(), shared["n"].tolist()))


def item_blocks(items: DataFrame, id_col: str = "item_id", text_col: str = "text", block: int = 20_000, size: int = 5, **policy):
    """Indexes over the benchmark in blocks of at most block items, so what is sent to the executors is bounded.

    Every block weighs shingles by their items in the whole benchmark, so a finding doesn't
    depend on the items that share its block; only shingles of several items are sent along
    (any other weighs as one that no item has). Rows are numbered once: those of a null or
    a repeated id count like any other.
    """
    bound_batches(items.sparkSession)
    text = F.col(text_col).cast("binary")
    named = items.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("i"), text.alias("t"), shingle_column(text, size).alias("marks"))
    numbered = materialize(named.withColumn("row", F.monotonically_increasing_id()))
    whole, last = shared_shingles(numbered), -1
    while True:
        part = numbered.where(F.col("row") > last).orderBy("row").select("row", "i", "t").limit(block).collect()
        if part:
            yield BenchmarkIndex.build([(r["i"], r["t"]) for r in part], size=size, whole=whole, **policy)
            last = part[-1]["row"]
        if len(part) < block:
            discard(numbered)
            return


def find_leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **policy) -> DataFrame:
    """One row per document and benchmark item found in it: doc_id, item_id, similarity, start (word).

    An item is found where a window of its own number of words has a weighted Jaccard
    similarity of five-word shingles of threshold (0.8) or more; an item of fewer words is one
    shingle, and a text of fewer words than the item is one window. Words are lower-cased (A-Z), parted by ASCII white space and marks. Null and
    empty texts or items match nothing; rows that repeat an id keep their own findings, and
    an item with a null id is found under it.
    """
    bound_batches(docs.sparkSession)
    kind = "string" if dict(items.dtypes)["item_id"] == "string" else "bigint"
    out = None
    for index in item_blocks(items, **policy):
        found = docs.select(F.col(id_col).alias("doc_id"), F.explode(leak_column(F.col(text_col), index, kind)).alias("l")).select("doc_id", "l.*")
        out = found if out is None else out.union(found)
    if out is None:
        return docs.select(F.col(id_col).alias("doc_id"), F.lit(None).cast(kind).alias("item_id"), F.lit(None).cast("double").alias("similarity"), F.lit(None).cast("bigint").alias("start")).where("false")
    return out


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", **policy) -> DataFrame:
    """docs without those that hold a benchmark item; columns unchanged."""
    bound_batches(docs.sparkSession)
    kind = "string" if dict(items.dtypes)["item_id"] == "string" else "bigint"
    for index in item_blocks(items, **policy):
        docs = docs.where(F.size(leak_column(F.col(text_col), index, kind)) == 0)
    return docs
