"""SimHash fingerprints and near-duplicate groups through a Gray-order hierarchical index."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bound_batches, byte_words, checked_broadcast, join_weighed, local_components, materialize
from .components import connected_components

_DIGEST = xxhash.xxh64_digest
_ROWS = 1 << 14


def shingle_bytes(words: list[bytes], n: int) -> list[bytes]:
    """Space-joined runs of n words, repeats included; the whole sequence when shorter."""
    if not words:
        return []
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    if len(words) <= n:
        return [joined]
    starts = np.concatenate(([0], ends[:-1] + 1))[: len(words) - n + 1].tolist()
    return [joined[s:e] for s, e in zip(starts, ends[n - 1 :].tolist())]


def bit_counts(digests: bytes) -> np.ndarray:
    """How often each of 64 bits (highest first) is set in a run of 8-byte digests."""
    rows = np.frombuffer(digests, dtype=np.uint8).reshape(-1, 8)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, len(rows), _ROWS):
        bits = np.unpackbits(rows[at : at + _ROWS], axis=1)
        whole = len(bits) // 255 * 255
        if whole:  # sums of 255 bits fit a byte
            total += bits[:whole].reshape(-1, 255, 64).sum(axis=1, dtype=np.uint8).sum(axis=0, dtype=np.int64)
        total += bits[whole:].sum(axis=0, dtype=np.int64)
    return total


def fingerprint(text: bytes | None, n: int = 4) -> int:
    """64-bit SimHash of a text: bit set where over half of the shingle hashes have it; 0 without words."""
    shingles = shingle_bytes(byte_words(text.lower() if text else text), n)
    if not shingles:
        return 0
    counts = bit_counts(b"".join([_DIGEST(s, 42) for s in shingles]))
    return int.from_bytes(np.packbits(counts * 2 > len(shingles)).tobytes(), "big")


def fingerprint_column(text: Column, n: int = 4) -> Column:
    """Fingerprint of a text column as a signed long."""

    @F.arrow_udf("long")
    def simhash(values: pa.Array) -> pa.Array:
        out = np.fromiter((fingerprint(v, n) for v in values.to_pylist()), dtype=np.uint64, count=len(values))
        return pa.array(out.view(np.int64))

    return simhash(text.cast("binary"))


def gray_rank(codes: np.ndarray) -> np.ndarray:
    """Position of each code in the reflected Gray sequence."""
    rank = codes.copy()
    for shift in (1, 2, 4, 8, 16, 32):
        rank ^= rank >> np.uint64(shift)
    return rank


class GrayIndex:
    """Codes in Gray order under a hierarchy of nodes.

    A node covers consecutive codes and holds the bits they share (mask, pattern). A
    child only keeps the bits its parent doesn't hold, so differences accumulate on the
    way down: a group whose sum exceeds the radius is pruned whole, one whose sum plus
    its free bits stays within the radius is accepted whole.
    """

    def __init__(self, codes: np.ndarray, fanout: int = 8):
        self.order = np.argsort(gray_rank(codes), kind="stable")
        self.codes = codes[self.order]
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []  # own mask, pattern, free bits
        self.fanout = fanout
        full = np.full(len(codes), np.uint64(0xFFFFFFFFFFFFFFFF))
        mask, pattern, chain = full, self.codes, []
        chain.append((mask, pattern))
        while len(pattern) > 1:
            heads = np.arange(0, len(pattern), fanout)
            differing = np.bitwise_or.reduceat(pattern ^ np.repeat(pattern[heads], np.diff(np.append(heads, len(pattern)))), heads)
            mask = np.bitwise_and.reduceat(mask, heads) & ~differing
            pattern = pattern[heads] & mask
            chain.append((mask, pattern))
        for depth, (mask, pattern) in enumerate(chain):
            above = np.repeat(chain[depth + 1][0], fanout)[: len(mask)] if depth + 1 < len(chain) else np.zeros(1, np.uint64)
            self.levels.append((mask & ~above, pattern, 64 - np.bitwise_count(mask).astype(np.int64)))
        self.levels.reverse()  # root first

    def links(self, radius: int, fixed: np.uint64 = np.uint64(0), step: int = 2048) -> tuple[np.ndarray, np.ndarray]:
        """Links (positions in codes as given) that connect whatever all pairs within radius connect.

        Bits of fixed must agree; an accepted group is linked through its first code, since
        its members are then within the radius of each other or linked inside it.
        """
        n, left, right = len(self.codes), [], []
        span = [self.fanout ** (len(self.levels) - 1 - d) for d in range(len(self.levels))]
        for d, (_, _, free) in enumerate(self.levels):  # groups so dense that all members are within the radius
            if span[d] > 1:
                dense = np.flatnonzero(free <= radius)
                if len(dense):
                    size = np.minimum((dense + 1) * span[d], n) - dense * span[d]
                    head = np.repeat(dense * span[d], size)
                    member = head + np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    keep = ((self.codes[head] ^ self.codes[member]) & fixed) == 0
                    left.append(head[keep])
                    right.append(member[keep])
        for low in range(0, n, step):
            query = np.arange(low, min(low + step, n))
            node, acc = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for d, (own, pattern, free) in enumerate(self.levels):
                diff = (self.codes[query] ^ pattern[node]) & own[node]
                acc = acc + np.bitwise_count(diff)
                keep = (acc <= radius) & ((diff & fixed) == 0) & ((node + 1) * span[d] > query)
                query, node, acc = query[keep], node[keep], acc[keep]
                if d == len(self.levels) - 1:
                    break
                take = (free[node] <= radius - acc) & (node * span[d] > query)
                if take.any():  # the fixed bits may be free in the group, so test its first code by itself
                    head = node[take] * span[d]
                    same = ((self.codes[query[take]] ^ self.codes[head]) & fixed) == 0
                    uniform = (own_all(self.levels, d, node[take], self.fanout) & fixed) == fixed
                    whole = np.flatnonzero(take)[same & uniform]
                    left.append(query[whole])
                    right.append(node[whole] * span[d])
                    take[:] = False
                    take[whole] = True
                query, node, acc = query[~take], node[~take], acc[~take]
                child = node[:, None] * self.fanout + np.arange(self.fanout)
                inside = child < len(self.levels[d + 1][1])
                count = inside.sum(axis=1)
                query, acc, node = np.repeat(query, count), np.repeat(acc, count), child[inside]
            other = query < node
            left.append(query[other])
            right.append(node[other])
        if not left:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return self.order[np.concatenate(left)], self.order[np.concatenate(right)]


    def pairs(self, radius: int, fixed: np.uint64, step: int = 2048) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs (positions in codes as given) within radius whose bits of fixed agree, step codes at a time."""
        n = len(self.codes)
        span = [self.fanout ** (len(self.levels) - 1 - d) for d in range(len(self.levels))]
        for low in range(0, n, step):
            query = np.arange(low, min(low + step, n))
            node, acc = np.zeros(len(query), np.int64), np.zeros(len(query), np.int64)
            for d, (own, pattern, _) in enumerate(self.levels):
                diff = (self.codes[query] ^ pattern[node]) & own[node]
                acc = acc + np.bitwise_count(diff)
                keep = (acc <= radius) & ((diff & fixed) == 0) & ((node + 1) * span[d] > query)
                query, node, acc = query[keep], node[keep], acc[keep]
                if d < len(self.levels) - 1:
                    child = node[:, None] * self.fanout + np.arange(self.fanout)
                    inside = child < len(self.levels[d + 1][1])
                    count = inside.sum(axis=1)
                    query, acc, node = np.repeat(query, count), np.repeat(acc, count), child[inside]
            other = query < node
            yield self.order[query[other]], self.order[node[other]]


def own_all(levels: list, depth: int, node: np.ndarray, fanout: int) -> np.ndarray:
    """All bits that the members of a node share: its own and those held above it."""
    held, at = levels[depth][0][node], node
    for d in range(depth - 1, -1, -1):
        at = at // fanout
        held = held | levels[d][0][at]
    return held


def block_masks(radius: int, extra: int) -> list[int]:
    """Masks of which two codes within radius agree on at least one.

    64 bits are cut into radius + extra blocks; a pair differs in at most radius of them,
    so it agrees on some choice of extra blocks.
    """
    count = radius + extra
    edges = [64 * i // count for i in range(count + 1)]
    blocks = [((1 << (edges[i + 1] - edges[i])) - 1) << edges[i] for i in range(count)]
    return [sum(c) for c in combinations(blocks, extra)]


def masked_first(codes: np.ndarray, mask: int) -> tuple[np.ndarray, np.uint64]:
    """Codes with the bits of mask moved to the top, in order, and the mask moved alike.

    Distances stay as they are, while codes that agree on the mask become neighbours in
    Gray order and share upper nodes.
    """
    out, filled = np.zeros_like(codes), 64
    for part in (mask, ~mask & ((1 << 64) - 1)):
        at = 63
        while at >= 0:
            if part >> at & 1:
                low = at
                while low and part >> (low - 1) & 1:
                    low -= 1
                width = at - low + 1
                filled -= width
                out |= ((codes >> np.uint64(low)) & np.uint64((1 << width) - 1)) << np.uint64(filled)
                at = low
            at -= 1
    top = mask.bit_count()
    return out, np.uint64(((1 << top) - 1) << (64 - top))


def sent_codes(codes: DataFrame, radius: int, extra: int, crowded: int, scratch: Scratch) -> DataFrame:
    """codes(fp) once for each block mask: fp, extra, mask_no, part (the bits of the mask).

    Codes of a (mask, part) group of over crowded members go again with one agreeing block
    more, where the groups are smaller, and so on while masks leave bits to differ in: a
    pair of the group agrees there too.
    """
    out, live = None, codes
    while True:
        signed = [m - (1 << 64) if m >> 63 else m for m in block_masks(radius, extra)]
        each = F.posexplode(F.array(*[F.col("fp").bitwiseAND(F.lit(m).cast("long")) for m in signed])).alias("mask_no", "part")
        sent = live.select("fp", F.lit(extra).alias("extra"), each)
        big = scratch(sent.groupBy("mask_no", "part").agg(F.count("*").alias("n")).where(F.col("n") > crowded).select("mask_no", "part"))
        n = big.count() if extra < 8 else 0
        if n:
            side = checked_broadcast(big, n, 500_000)
            live = scratch(sent.join(side, ["mask_no", "part"], "left_semi").select("fp").distinct())
            sent = sent.join(side, ["mask_no", "part"], "left_anti")
        sent = sent.select("fp", "extra", "mask_no", "part")
        out = sent if out is None else out.union(sent)
        if not n:
            return out
        extra += 1


def link_fingerprints(codes: DataFrame, radius: int = 4, extra: int | None = None, buffer: int = 1 << 18, crowded: int = 1 << 17, scratch: Scratch | None = None) -> DataFrame:
    """Links (a, b) over distinct codes(fp long) that connect all pairs within radius.

    Every code is sent once for each block mask and a Gray-order index is built over the
    groups that arrive; only codes equal on the mask meet, which loses no pair. extra
    sets how many blocks must agree (1: 5 copies of 13 bits, 2: 15 copies of 21 bits,
    3: 35 copies of 27 bits at radius 4); by default it follows the number of codes, so
    that groups stay small, and crowded groups are split by more blocks. Each group yields
    at most one link per member.
    """
    if extra is None:
        n = codes.count()
        extra = 1 if n < 1 << 25 else 2 if n < 1 << 33 else 3
    sent = sent_codes(codes, radius, extra, crowded, scratch or Scratch())
    masks = {e: block_masks(radius, e) for e in range(extra, 9)}
    sent = sent.select("fp", (F.col("extra") * 1000 + F.col("mask_no")).alias("mask_no"), "part")
    sent = sent.repartition("mask_no", "part").sortWithinPartitions("mask_no", "part")

    def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        rows = 0

        def flush(fp: np.ndarray, no: np.ndarray) -> Iterator[pd.DataFrame]:
            for k in np.unique(no):
                own = fp[no == k].astype(np.int64).view(np.uint64)
                moved, fixed = masked_first(own, masks[k // 1000][k % 1000])
                a, b = GrayIndex(moved).links(radius, fixed)
                root = local_components(len(own), a, b)
                member = np.flatnonzero(root != np.arange(len(own)))
                if len(member):
                    yield pd.DataFrame({"a": own[member].view(np.int64), "b": own[root[member]].view(np.int64)})

        for frame in frames:
            if not len(frame):
                continue
            held.append((frame["fp"].to_numpy(), frame["mask_no"].to_numpy(), frame["part"].to_numpy()))
            rows += len(frame)
            if rows >= buffer:
                fp, no, part = (np.concatenate(x) for x in zip(*held))
                last = np.flatnonzero((no != no[-1]) | (part != part[-1]))
                cut = last[-1] + 1 if len(last) else 0  # the last group may go on
                if cut:
                    yield from flush(fp[:cut], no[:cut])
                held, rows = [(fp[cut:], no[cut:], part[cut:])], len(fp) - cut
        if rows:
            fp, no, _ = (np.concatenate(x) for x in zip(*held))
            yield from flush(fp, no)

    return sent.mapInPandas(search, "a long, b long")


def group_fingerprints(found: DataFrame, key: str, radius: int = 4) -> DataFrame:
    """Labels (fp, n, lead) of found(key, fp): lead is the smallest key of all codes linked to fp, n the rows of fp.

    Equal codes meet in one map-side combined aggregate, so copies cost a row each;
    links are searched over distinct codes only. A null key is never smallest unless a
    group has no other.
    """
    scratch = Scratch()
    own = scratch(found.groupBy("fp").agg(F.min(key).alias("own"), F.count("*").alias("n")))
    links = scratch(link_fingerprints(own.select("fp"), radius, scratch=scratch))
    parts = scratch(connected_components(links)).withColumnRenamed("node", "fp")
    lead = parts.join(own, "fp").groupBy("component").agg(F.min("own").alias("lead"))
    linked = parts.join(lead, "component").select("fp", "lead")
    labels = scratch(own.join(linked.withColumn("linked", F.lit(True)), "fp", "left").select("fp", "n", F.when(F.col("linked"), F.col("lead")).otherwise(F.col("own")).alias("lead")))
    scratch.keep(labels)
    return labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 4, radius: int = 4) -> DataFrame:
    """One row per document: id, fp (long), fingerprint (hex), component_id (smallest id reachable).

    Null and empty texts have fingerprint 0 and link like any other. Rows that repeat an
    id keep a row each. A group whose ids are all null has a null component. An empty
    table gives an empty result. Other columns of docs are ignored. Labels of fingerprints
    that a large share of the rows have are broadcast, the others joined by fingerprint.
    """
    bound_batches(docs.sparkSession)
    found = materialize(docs.select(F.col(id_col).alias("doc_id"), fingerprint_column(F.col(text_col), n).alias("fp")))
    labels = group_fingerprints(found, "doc_id", radius)
    met = join_weighed(found, labels, ["fp"], found.count())
    return met.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("lead").alias("component_id"), "fp")
