"""Near copies by exact similarity of word shingles, found through wide SimHash codes in Gray order."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Positional, Scratch, bound_batches, checked_broadcast, discard, local_components, materialize, row_hash
from .components import connected_components
from .simhash import GrayIndex, masked_first

#: Bytes as words see them: A-Z lowered; 0 is ASCII white space.
_SEEN = np.arange(1, 257, dtype=np.uint64)
_SEEN[65:91] += np.uint64(32)
_SEEN[[9, 10, 11, 12, 13, 32]] = 0
_RANDOM = np.random.default_rng(640)
_PLACE = _RANDOM.integers(0, 1 << 63, 512, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TURN = _RANDOM.integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Features of a code are pairs of words: an edit touches two of them but five shingles, so codes of near copies differ in fewer bits.
FEATURE_WORDS = 2
#: Words of a code and bits of a block, the same for any number of texts: every block of a code is a table, and two texts meet where a whole block agrees.
WORDS, WIDTH = 8, 16
#: Differing bits allowed in the two words of a code that travel with a block (first word, both).
FIRST, BOTH = 14, 24


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(text: bytes | None) -> np.ndarray:
    """64-bit hashes of the lower-cased words of a text."""
    seen = _SEEN[np.frombuffer(text or b"", np.uint8)]
    edge = np.diff((seen > 0).astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.uint64)
    length = end - start
    first = np.cumsum(length) - length
    place = np.arange(int(length.sum())) - np.repeat(first, length)
    factor = _PLACE[place & 511] * (2 * (place >> 9) + 1).astype(np.uint64)
    return _mix(np.add.reduceat(seen[seen > 0] * factor, first) + length.astype(np.uint64))


def runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of each run of size words; of all words where there are fewer."""
    size = min(size, len(words))
    if not size:
        return words
    n = len(words) - size + 1
    h = np.zeros(n, np.uint64)
    for k in range(size):
        h = h + words[k : k + n] * _TURN[k]
    return _mix(h + np.uint64(size))


def wide_code(words: np.ndarray, count: int) -> np.ndarray:
    """SimHash of count x 64 bits over word pairs: a bit is set where over half of the hashes have it."""
    marks = runs(words, FEATURE_WORDS)
    total = np.zeros(count * 64, dtype=np.int64)
    for at in range(0, len(marks), 255):  # sums of 255 bits fit a byte
        part = _mix(marks[at : at + 255, None] + _TURN[None, 8 : 8 + count])
        total += np.unpackbits(part.view(np.uint8).reshape(len(part), -1), axis=1).sum(axis=0, dtype=np.uint8)
    return np.packbits(total * 2 > len(marks)).view(np.uint64)


def similar(one: np.ndarray, two: np.ndarray, percent: int) -> bool:
    """Whether two sorted sets of shingles share percent or more of their union."""
    both = len(np.intersect1d(one, two, assume_unique=True))
    union = len(one) + len(two) - both
    return union > 0 and 100 * both >= percent * union


def sketch(marks: np.ndarray) -> bytes:
    """One byte of the least of a sorted set of hashes in each of 256 ranges of hashes, 0 for an empty one: two texts agree in about as many of their ranges as their sets share of their union."""
    ranges, first = np.unique((marks >> np.uint64(56)).astype(np.int64), return_index=True)
    out = np.zeros(256, np.uint8)
    out[ranges] = np.maximum(1, (marks[first] & np.uint64(0xFF)).astype(np.uint8))
    return out.tobytes()


def _true(marks: np.ndarray) -> np.ndarray:
    """How many of the 256 marks of each row are set."""
    return np.bitwise_count(np.packbits(marks, axis=-1).view(np.uint64)).sum(-1, dtype=np.int64)


def likely(one: np.ndarray, two: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs of sketches may share percent of their shingles: agreeing in no fewer ranges than five standard deviations below."""
    filled, same = _true((one | two) > 0), _true((one == two) & (one > 0))
    share = percent / 100
    slack = 5 * np.sqrt(share * (1 - share) / np.maximum(filled, 1))
    return same >= (share - slack) * filled


def code_column(text: Column, count: int, n: int | None = 5) -> Column:
    """Digest of the word sequence (two longs), the wide code and the sketch of the n-word shingles of a text (null without n)."""
    kind = pa.struct([("hi", pa.int64()), ("lo", pa.int64()), ("code", pa.list_(pa.int64())), ("sketch", pa.binary())])

    @F.arrow_udf("struct<hi:bigint,lo:bigint,code:array<bigint>,sketch:binary>")
    def coded(values: pa.Array) -> pa.Array:
        out = []
        for text in values.to_pylist():
            words = word_hashes(text)
            digest = np.frombuffer(xxhash.xxh3_128_digest(words.tobytes()), dtype=np.int64)
            out.append({"hi": int(digest[0]), "lo": int(digest[1]), "code": wide_code(words, count).view(np.int64).tolist(), "sketch": None if n is None else sketch(np.unique(runs(words, n)))})
        return pa.array(out, kind)

    return coded(text.cast("binary"))


def shingle_column(text: Column, n: int) -> Column:
    """The sorted set of n-word shingle hashes of a text."""

    @F.arrow_udf("array<bigint>")
    def marked(values: pa.Array) -> pa.Array:
        return pa.array([np.unique(runs(word_hashes(t), n)).view(np.int64) for t in values.to_pylist()], pa.list_(pa.int64()))

    return marked(text.cast("binary"))


def search_pairs(frames: Iterator[pd.DataFrame], masks: list[int], nearest: int, buffer: int = 1 << 16) -> Iterator[pd.DataFrame]:
    """Links (a, b) that connect whatever the near codes of a bucket connect.

    frames hold whole buckets (table, part, cell) one after another. The codes of a run
    of buckets go into one Gray-order index, block bits first. Each code is linked to its
    nearest partners of those after it; of its further pairs only those are kept that connect
    what isn't connected yet, so a bucket gives a few links a code however many pairs it has.
    """
    held: list[pd.DataFrame] = []
    rows = 0

    def flush(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for k, own in frame.groupby("block"):
            first, second = own["first"].to_numpy().view(np.uint64), own["second"].to_numpy().view(np.uint64)
            c, cell = own["c"].to_numpy(), own["cell"].to_numpy()
            moved, fixed = masked_first(first, masks[int(k)])
            widest = int(own.groupby(["tab", "part", "cell"]).size().max())
            table = own["tab"].to_numpy()
            root = np.arange(len(own))
            for a, b in GrayIndex(moved).pairs(FIRST, fixed, max(8, min(4096, (1 << 22) // widest))):
                bits = np.bitwise_count(first[a] ^ first[b]).astype(np.int64) + np.bitwise_count(second[a] ^ second[b])
                keep = (bits <= BOTH) & (table[a] == table[b]) & (cell[a] == cell[b]) & (c[a] != c[b])
                a, b, bits = a[keep], b[keep], bits[keep]
                if not len(a):
                    continue
                order = np.lexsort((c[b], bits, a))
                a, b = a[order], b[order]
                close = np.arange(len(a)) - np.searchsorted(a, a, side="left") < nearest
                root = local_components(len(root), np.append(a[close], np.arange(len(root))), np.append(b[close], root))
                p, q = root[a[~close]], root[b[~close]]
                apart = np.unique(np.stack([p, q], 1)[p != q], axis=0)
                if len(apart):
                    at, inverse = np.unique(apart, return_inverse=True)
                    lowest = at[local_components(len(at), *inverse.reshape(-1, 2).T)]
                    apart = np.stack([at, lowest], 1)[at != lowest]
                    root[at] = lowest
                    root = root[root]
                a, b = np.append(a[close], apart[:, 0]), np.append(b[close], apart[:, 1])
                yield pd.DataFrame({"a": np.minimum(c[a], c[b]), "b": np.maximum(c[a], c[b])})

    for frame in frames:
        if not len(frame):
            continue
        held.append(frame)
        rows += len(frame)
        if rows >= buffer:
            whole = pd.concat(held, ignore_index=True)
            last = whole.iloc[-1]
            open_rows = ((whole["tab"] == last["tab"]) & (whole["part"] == last["part"]) & (whole["cell"] == last["cell"])).to_numpy()
            cut = len(whole) - int(open_rows[::-1].argmin()) if not open_rows.all() else 0  # the last bucket may go on
            if cut:
                yield from flush(whole.iloc[:cut])
            held, rows = [whole.iloc[cut:]], len(whole) - cut
    if rows:
        yield from flush(pd.concat(held, ignore_index=True))


def _blocks(codes: DataFrame, words: int, width: int) -> DataFrame:
    """codes(c, code) once for each block: tab, block, part (the bits of the block), first and second word."""
    per = 64 // width
    masks = [((1 << width) - 1) << (width * k) for k in range(per)]
    signed = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m).cast("long") for m in masks])
    split = codes.select("c", "code", F.posexplode("code").alias("word_no", "first"))
    split = split.select("c", "word_no", "first", F.expr(f"code[(word_no + 1) % {words}]").alias("second"), F.posexplode(signed).alias("block", "mask"))
    return split.select((F.col("word_no") * per + F.col("block")).alias("tab"), "block", F.expr("first & mask").alias("part"), "first", "second", "c")


def verified(pairs: DataFrame, marks: DataFrame, percent: int, heavy: int = 2000, most_bytes: int = 32 << 20) -> DataFrame:
    """pairs(a, b) with their verdict; marks(c, marks) are the shingle sets.

    Sets of up to most_bytes in all (counted) are broadcast. Beyond, they meet their pairs by
    shuffle, and a text in over heavy pairs meets them in salted copies, so no task holds all
    pairs of one.
    """

    @F.arrow_udf("boolean")
    def same(one: pa.Array, two: pa.Array) -> pa.Array:
        def sets(x: pa.Array) -> list[np.ndarray]:
            flat, at = x.values.to_numpy(zero_copy_only=False), x.offsets.to_numpy()
            return [flat[i:j] for i, j in zip(at[:-1], at[1:])]

        return pa.array([similar(p, q, percent) for p, q in zip(sets(one), sets(two))], pa.bool_())

    verdict = same("a_marks", "b_marks").alias("near")
    if (marks.agg(F.sum(8 * F.size("marks") + 32)).first()[0] or 0) <= most_bytes:
        out = pairs.repartition(pairs.sparkSession.sparkContext.defaultParallelism, "a", "b")
        for end in "ab":
            out = out.join(F.broadcast(marks.select(F.col("c").alias(end), F.col("marks").alias(f"{end}_marks"))), end)
        return out.select("a", "b", verdict)
    ends = pairs.select(F.col("a").alias("c")).union(pairs.select(F.col("b").alias("c")))
    crowd = ends.groupBy("c").agg(F.count("*").alias("n")).where(F.col("n") > heavy).select("c", F.ceil(F.col("n") / heavy).cast("int").alias("copies"))
    few = checked_broadcast(crowd, crowd.count(), 200_000)
    dealt = marks.join(few, "c", "left").select("c", "marks", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1)).alias("salt"))
    out = pairs
    for end, other in (("a", "b"), ("b", "a")):
        salt = F.pmod(F.xxhash64(other), F.coalesce("copies", F.lit(1))).cast("int")
        out = out.join(few.withColumnRenamed("c", end), end, "left").withColumn("salt", salt).drop("copies")
        out = out.join(dealt.select(F.col("c").alias(end), "salt", F.col("marks").alias(f"{end}_marks")), [end, "salt"]).drop("salt")
    return out.select("a", "b", verdict)


def family_links(members: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links (a, b) that connect whatever the similar texts among members(fam, low, high, chunk, c, marks) connect.

    Members of one fam are compared with each other, and where low and high differ those of
    chunk low with those of chunk high. Sketches rule most pairs out (one of 0.8 with a chance
    below one in a million); the others are compared exactly, likeliest first, until the two
    are connected. So pairs are never written down, only links, fewer than members.
    """
    left, right = [], []
    for (_, low, high), own in members.groupby(["fam", "low", "high"], sort=False):
        c, chunk = own["c"].to_numpy(), own["chunk"].to_numpy()
        sets = [np.asarray(m).view(np.uint64) for m in own["marks"]]
        seen = np.frombuffer(b"".join(sketch(m) for m in sets), np.uint8).reshape(-1, 256)
        size = np.array([len(m) for m in sets])
        root, later = np.arange(len(c)), np.arange(len(c))
        for i in np.flatnonzero(chunk == low).tolist() if low != high else later.tolist():
            other = later[chunk == high] if low != high else later[i + 1 :]
            other = other[root[other] != root[i]]
            fits = 100 * np.minimum(size[other], size[i]) >= percent * np.maximum(size[other], size[i])  # a share has this bound
            other = other[fits]
            other = other[likely(seen[other], seen[i][None], percent)]
            other = other[np.argsort(-_true(seen[other] == seen[i]), kind="stable")]
            while len(other):
                j, other = other[0], other[1:]
                if similar(sets[i], sets[j], percent):
                    left.append(c[i])
                    right.append(c[j])
                    root[root == root[j]] = root[i]
                    other = other[root[other] != root[i]]
    return pd.DataFrame({"a": left, "b": right}, dtype=np.int64)


def link_texts(docs: DataFrame, classes: DataFrame, text_col: str, n: int = 5, percent: int = 80, nearest: int = 1, crowded: int = 1 << 13, most_texts: int = 2000, most_bytes: int = 4 << 20) -> DataFrame:
    """Groups (c, grp) of classes(c, r1, r2, code) that the found pairs of similar texts connect; only of classes with a link.

    docs carry the row keys __r1, __r2 of the classes' first rows. First, buckets of codes
    that agree in a block give links between near codes, and what these connect is a family.
    Then the shingle set of each text of a family travels once, to the cell of its family,
    where the texts are compared. A family of over most_texts texts or most_bytes of sets is cut
    into chunks of that size, with a cell for each two of them; a bucket of over crowded codes
    likewise. So all pairs of a family or bucket are covered, no task holds more than
    two chunks, and only links leave a cell.
    """
    scratch, most = Scratch(), 500_000
    masks = [((1 << WIDTH) - 1) << (WIDTH * k) for k in range(64 // WIDTH)]
    sent = _blocks(classes, WORDS, WIDTH)
    crowd = scratch(sent.groupBy("tab", "part").agg(F.count("*").alias("size")).where(F.col("size") > crowded))
    if crowds := crowd.count():
        sent = sent.join(checked_broadcast(crowd, crowds, most), ["tab", "part"], "left").withColumn("chunks", F.ceil(F.coalesce("size", F.lit(1)) / crowded).cast("int"))
        sent = _paired(sent, F.col("chunks"), "tab").withColumn("cell", F.col("low") * F.col("chunks") + F.col("high"))
    else:
        sent = sent.withColumn("cell", F.lit(0))
    sent = sent.select("tab", "block", "part", "first", "second", "c", "cell").repartition("tab", "part", "cell").sortWithinPartitions("block", "tab", "part", "cell")
    kin = scratch(sent.mapInPandas(partial(search_pairs, masks=masks, nearest=nearest), "a long, b long").distinct())
    families = connected_components(kin)
    scratch.tables.append(families)
    families = scratch(classes.select("c", "r1", "r2").join(checked_broadcast(families, families.count(), most), F.col("c") == F.col("node")).select("c", "r1", "r2", F.col("component").alias("fam")))
    members = families.count()
    texts = docs.join(checked_broadcast(families, members, most), (F.col("__r1") == F.col("r1")) & (F.col("__r2") == F.col("r2")))
    sets = scratch(texts.select("c", "fam", shingle_column(F.col(text_col), n).alias("marks")))
    if sets.count() > members:  # rows that are repeated whole
        twice = sets.groupBy("c").agg(F.count("*").alias("n")).where("n > 1").select("c")
        sets = sets.join(twice, "c", "left_anti").unionByName(sets.join(twice, "c", "left_semi").dropDuplicates(["c"]))
    width = 8 * F.size("marks") + 32
    sizes = scratch(sets.groupBy("fam").agg(F.count("*").alias("texts"), F.sum(width).alias("bytes")))
    chunks = F.greatest(F.ceil(F.col("texts") / most_texts), F.ceil(F.col("bytes") / most_bytes)).cast("int")
    large = scratch(sizes.select("fam", chunks.alias("chunks")).where("chunks > 1"))
    bins = max(64, (sizes.agg(F.sum("bytes")).first()[0] or 0) // (most_bytes // 2))
    dealt = sets.join(checked_broadcast(large, large.count(), most), "fam", "left")
    dealt = _paired(dealt, F.coalesce("chunks", F.lit(1)), "fam")
    cell = F.when(F.col("chunks").isNull(), F.pmod(F.xxhash64("fam"), F.lit(bins))).otherwise(F.xxhash64("fam", "low", "high"))
    dealt = dealt.select(cell.alias("cell"), "fam", "low", "high", "chunk", "c", "marks")
    links = scratch(dealt.groupBy("cell").applyInPandas(lambda own: family_links(own, percent), "a long, b long"))
    groups = connected_components(links)
    out = materialize(groups.select(F.col("node").alias("c"), F.col("component").alias("grp")))
    discard(groups)
    scratch.clear()
    return out


def _paired(rows: DataFrame, chunks: Column, salt: str) -> DataFrame:
    """rows(c, ...) dealt to chunks, each row once for every pair (low, high) of chunks that has its own."""
    own = rows.withColumn("chunk", F.pmod(F.xxhash64("c", salt), chunks).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), chunks - 1)))
    return own.withColumns({"low": F.least("chunk", "other"), "high": F.greatest("chunk", "other")}).drop("other")


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = 5, percent: int = 80) -> DataFrame:
    """Documents with one row left of each group of near copies, all columns kept.

    Texts are linked where their sets of n-word shingles share percent or more of their
    union (a shorter text is one shingle; words are lower-cased, A-Z). Pairs are found by
    wide SimHash codes and compared exactly; equal word sequences are one class and never
    compared. Wordless and null texts are one class, linked to nothing else. The row of the
    smallest id stays, null last; of rows of one id the one with the smaller hash; of rows
    equal in all columns one. An empty table gives an empty result; columns may have any names.
    """
    bound_batches(docs.sparkSession)
    scratch, own = Scratch(), Positional(docs)
    keys = [row_hash(own.frame, k).alias(f"__r{k}") for k in (1, 2)]
    keyed = own.frame.select(F.col(own(id_col)).alias("__id"), F.col(own(text_col)).alias("__text"), *keys)
    row = F.struct(F.col("__id").isNull().alias("none"), F.col("__id").alias("id"), F.col("__r1").alias("r1"), F.col("__r2").alias("r2"))
    found = scratch(keyed.select(row.alias("row"), code_column(F.col("__text"), WORDS, None).alias("p")).select("row", "p.hi", "p.lo", "p.code"))
    classes = scratch(
        found.groupBy("hi", "lo").agg(F.min("row").alias("lead"), F.any_value("code").alias("code"))
        .select(F.monotonically_increasing_id().alias("c"), "lead", "lead.r1", "lead.r2", "hi", "lo", "code")
    )
    groups = link_texts(keyed.select("__text", "__r1", "__r2"), classes, "__text", n, percent)
    # a class goes when its group has a smaller first row
    led = groups.join(classes.select("c", "lead"), "c")
    first = led.groupBy("grp").agg(F.min("lead").alias("lead"))
    gone = led.select("c", "lead").join(first.select("lead"), "lead", "left_anti")
    stay = scratch(classes.join(gone, "c", "left_anti").select(F.col("r1").alias("__r1"), F.col("r2").alias("__r2")))
    rows = found.groupBy(F.col("row.r1").alias("__r1"), F.col("row.r2").alias("__r2")).agg(F.count("*").alias("times"))
    out = materialize(rows.join(stay, ["__r1", "__r2"], "left_anti").select("__r1", "__r2"))
    twice = materialize(rows.where("times > 1").join(stay, ["__r1", "__r2"], "left_semi").select("__r1", "__r2"))
    kept = own.frame.select("*", *keys).join(checked_broadcast(out, out.count(), 1_000_000), ["__r1", "__r2"], "left_anti")
    if times := twice.count():
        side = checked_broadcast(twice, times, 1_000_000)
        kept = kept.join(side, ["__r1", "__r2"], "left_anti").union(kept.join(side, ["__r1", "__r2"], "left_semi").dropDuplicates(["__r1", "__r2"]))
    scratch.clear()
    discard(groups)
    return own.back(kept)
