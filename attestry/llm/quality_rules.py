"""Quality rules: document statistics judged by monotone gradient-boosted trees."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sample_rows

_SPACE = "\x20\x09\x0a\x0b\x0c\x0d"
_SYMBOLS = "#*$%&|<>"
#: Statistics beside the base ones that the trees see, and the direction (of the chance to
#: be kept) that splits on them must follow: -1 falling, 0 free.
FEATURES = (
    ("words", 0), ("mean_word", 0), ("symbols_per_word", -1), ("dup_line_share", -1), ("repeat_share", -1),
    ("upper_share", -1), ("distinct_share", 0), ("digit_share", 0), ("mark_share", -1), ("words_per_line", 0),
    ("sentence_ends", 0), ("longest_word", 0), ("bars_per_word", -1),
)
_EMPTY = (0, 0, 0, 0, 0)


def repeated_words(words: list, size: int = 5) -> int:
    """Words that lie in some run of size words found twice or more, first ones included."""
    n = len(words) - size + 1
    if n < 2:
        return 0
    slots: dict = {}
    ids = np.fromiter((slots.setdefault(w, len(slots)) for w in words), dtype=np.int64, count=len(words))
    if len(slots) == len(words):
        return 0
    run, width = ids, 1  # numbers of runs of width words, equal for equal runs
    count = len(slots)
    while width < size:
        step = min(width, size - width)  # runs of the next width overlap or touch
        pairs = run[: len(run) - step] * count + run[step:]
        found, run, seen = np.unique(pairs, return_inverse=True, return_counts=True)
        width, count = width + step, len(found)
        if count == len(run):  # no run of this width comes twice, so no longer one does
            return 0
    mark = np.zeros(len(words) + 1, dtype=np.int64)
    at = np.flatnonzero(seen[run] >= 2)
    np.add.at(mark, at, 1)
    np.add.at(mark, at + size, -1)
    return int((np.cumsum(mark[:-1]) > 0).sum())


def document_statistics(text: str | None) -> tuple[tuple[int, ...], tuple[float, ...]]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) and the values of FEATURES of a whole text."""
    if not text:
        return _EMPTY, (0.0,) * len(FEATURES)
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n = len(words)
    chars = len(text) - sum(map(text.count, _SPACE))
    symbols = sum(map(text.count, _SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(_SPACE)]
    dup = len(lines) - len(set(lines))
    repeat = repeated_words(words)
    base = (n, chars, symbols, dup, repeat)
    if not n:
        return base, (0.0,) * len(FEATURES)
    byte = np.frombuffer(raw, dtype=np.uint8)
    kinds = np.bincount(byte, minlength=256)
    upper, lower = kinds[65:91].sum(), kinds[97:123].sum()
    marks = kinds[33] + kinds[63]
    ends = kinds[46] + marks
    return base, (
        float(min(n, 1000)), chars / n, symbols / n, dup / len(lines), repeat / n,
        float(upper / max(1, upper + lower)), len(set(words)) / n, float(kinds[48:58].sum() / chars), float(marks / n), min(n / len(lines), 200.0),
        float(ends / n), float(min(max(map(len, words)), 100)), float(kinds[124] / n),
    )


@dataclass
class FlatTrees:
    """Trees of equal depth bound as node arrays; children of a leaf are the leaf itself."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Chance to be of good quality for each row of x."""
        if not len(x):
            return np.zeros(0)
        node = np.broadcast_to(self.roots, (len(x), len(self.roots)))
        row = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            node = np.where(x[row, self.feature[node]] <= self.threshold[node], self.left[node], self.right[node])
        return 1 / (1 + np.exp(-(self.bias + self.value[node].sum(axis=1))))


def fit_trees(x: np.ndarray, y: np.ndarray, monotone: tuple[int, ...], trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 5.0, shrink: float = 2.0) -> FlatTrees:
    """Second-order gradient boosting on binned features.

    A split on a constrained feature is taken only in its direction, and the midpoint of
    the two sides bounds all values below, so the whole sum is monotone in it.
    """
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots = []
    rate0 = np.clip(y.mean() if len(y) else 1.0, 1e-3, 1 - 1e-3)
    bias = float(np.log(rate0 / (1 - rate0)))
    if len(y) and 0 < y.sum() < len(y):
        cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(x.shape[1])]
        code = np.stack([np.searchsorted(c, x[:, j], side="left") for j, c in enumerate(cuts)], axis=1)
        margin = np.full(len(y), bias)

        def grow(rows: np.ndarray, level: int, low: float, high: float, g: np.ndarray, h: np.ndarray) -> int:
            at = len(nodes)
            total_g, total_h = g[rows].sum(), h[rows].sum()
            best_value = float(np.clip(total_g / (total_h + shrink), low, high))
            nodes.append([0, np.inf, at, at, best_value * rate])
            if level == depth or len(rows) < 2 * least:
                return at
            best = (1e-6, None)
            for j, way in enumerate(monotone):
                if not len(cuts[j]):
                    continue
                gs = np.cumsum(np.bincount(code[rows, j], g[rows], len(cuts[j]) + 1))[:-1]
                hs = np.cumsum(np.bincount(code[rows, j], h[rows], len(cuts[j]) + 1))[:-1]
                ns = np.cumsum(np.bincount(code[rows, j], minlength=len(cuts[j]) + 1))[:-1]
                vl = np.clip(gs / (hs + shrink), low, high)
                vr = np.clip((total_g - gs) / (total_h - hs + shrink), low, high)
                gain = vl * gs - 0.5 * (hs + shrink) * vl**2 + vr * (total_g - gs) - 0.5 * (total_h - hs + shrink) * vr**2
                gain -= best_value * total_g - 0.5 * (total_h + shrink) * best_value**2
                ok = (ns >= least) & (len(rows) - ns >= least) & ((way == 0) | (way * (vr - vl) >= 0))
                gain = np.where(ok, gain, -np.inf)
                k = int(np.argmax(gain))
                if gain[k] > best[0]:
                    best = (float(gain[k]), (j, k, vl[k], vr[k]))
            if best[1] is None:
                return at
            j, k, vl, vr = best[1]
            middle, way = (vl + vr) / 2, monotone[j]
            lows, highs = ((low, low), (high, high)) if way == 0 else ((middle, low), (high, middle)) if way < 0 else ((low, middle), (middle, high))
            inside = code[rows, j] <= k
            nodes[at][0], nodes[at][1] = j, cuts[j][k]
            nodes[at][2] = grow(rows[inside], level + 1, lows[0], highs[0], g, h)
            nodes[at][3] = grow(rows[~inside], level + 1, lows[1], highs[1], g, h)
            return at

        for _ in range(trees):
            p = 1 / (1 + np.exp(-margin))
            root = grow(np.arange(len(y)), 0, -np.inf, np.inf, y - p, p * (1 - p))
            roots.append(root)
            node = np.full(len(y), root)
            for _ in range(depth):
                f, t = np.array([nodes[i][0] for i in node]), np.array([nodes[i][1] for i in node])
                node = np.where(x[np.arange(len(y)), f] <= t, [nodes[i][2] for i in node], [nodes[i][3] for i in node])
            margin += np.array([nodes[i][4] for i in node])
    if not nodes:
        nodes, roots = [[0, np.inf, 0, 0, 0.0]], [0]
    columns = list(zip(*nodes))
    return FlatTrees(*(np.array(c) for c in columns), np.array(roots), depth, bias)


_STATS = "struct<n_words:bigint,word_chars:bigint,n_symbols:bigint,n_dup_lines:bigint,n_repeat_words:bigint,quality:double>"
_STATS_ARROW = [pa.int64()] * 5 + [pa.float64()]
_STATS_NAMES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "quality"]


def statistics_column(text: Column, model: FlatTrees) -> Column:
    """Base statistics of a text and the trees' verdict on it."""

    @F.arrow_udf(_STATS)
    def statistics(values: pa.Array) -> pa.Array:
        found = [document_statistics(t) for t in values.to_pylist()]
        base = np.array([b for b, _ in found], dtype=np.int64).reshape(-1, 5)
        score = model.score(np.array([f for _, f in found]).reshape(-1, len(FEATURES)))
        return pa.StructArray.from_arrays([pa.array(c) for c in base.T] + [pa.array(score)], names=_STATS_NAMES)

    return statistics(text)


def fit(docs: DataFrame, labels: DataFrame, each: int = 3000, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", **options) -> FlatTrees:
    """Fit on at most each labelled documents of either class and 96 MB of text (documented bounds),
    chosen by the md5 of their ids. An id with both labels counts as bad, one with several texts by
    one of them. Without labels or documents all that passes the base rules is kept."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.groupBy("__id").agg(F.min("__y").alias("__y"))  # an id labelled both ways is bad
    order = [F.md5(F.col("__id").cast("string").cast("binary")), F.col("__id")]
    parts = [known.where(F.col("__y") == y).orderBy(*order).limit(each) for y in (0, 1)]
    rows = sample_rows(docs, parts[0].union(parts[1]), id_col, text_col)
    x = np.array([document_statistics(t)[1] for t in rows["__text"]], dtype=float).reshape(-1, len(FEATURES))
    return fit_trees(x, rows["__y"].to_numpy(dtype=float), tuple(w for _, w in FEATURES), **options)


def judge(docs: DataFrame, model: FlatTrees, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: base statistics, base_failed, quality and kept.

    Statistics cover whole texts. A null or empty text has no words: all statistics are 0
    and it fails the base rules. Rows that repeat an id keep a row each. An empty table
    gives an empty result; other columns of docs are ignored.
    """
    bound_batches(docs.sparkSession)
    out = docs.select(F.col(id_col).alias("doc_id"), statistics_column(F.col(text_col), model).alias("s")).select("doc_id", "s.*")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("quality") >= least))
