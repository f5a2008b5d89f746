"""Quality from weak labels: EM over overlapping heuristics, then a hashed linear scorer."""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, discard, materialize, sample_rows
from .quality_rules import FEATURES, document_statistics
from .toxicity import minimize

_AT = {name: k for k, (name, _) in enumerate(FEATURES)}
#: Heuristic labellers: statistic, bad if above, bad if below, good if within (low, high); else no vote.
LABELLERS = (
    ("symbols_per_word", 0.10, None, None),
    ("dup_line_share", 0.30, None, None),
    ("repeat_share", 0.25, None, None),
    ("upper_share", 0.50, None, None),
    ("words", None, 8, (30, 1e9)),
    ("mean_word", 12.0, 2.5, None),
    ("distinct_share", None, 0.15, None),
    ("bars_per_word", 0.10, None, None),
    ("mark_share", 0.20, None, None),
)
_BUCKETS = 8
_BITS = 16
_CACHE = 400_000


def votes(values: tuple[float, ...]) -> list[int]:
    """2 for good, 1 for bad, 0 for no vote, of each labeller."""
    out = []
    for name, above, below, good in LABELLERS:
        v = values[_AT[name]]
        bad = (above is not None and v > above) or (below is not None and v < below)
        out.append(1 if bad else 2 if good and good[0] <= v <= good[1] else 0)
    return out


@dataclass
class LabelModel:
    """Latent kinds of documents: good ones (kind 0) and one kind of junk a labeller.

    Labellers overlap unevenly: those of symbols and bars mark the same documents, others
    mark sorts of junk that no other knows. With a single bad class the former would define
    it and the latter count as errors (tried: EM with two classes kept 55 % of the bad
    documents of sf0.1), so each labeller starts with a kind of its own.
    """

    shares: np.ndarray  # kind
    chances: np.ndarray  # labeller, kind, vote

    @property
    def good(self) -> float:
        return float(self.shares[0])

    def kinds(self, cast: np.ndarray) -> np.ndarray:
        """Chance of each kind for rows of votes."""
        j = np.arange(cast.shape[1])
        odds = np.log(self.shares) + np.log(self.chances[j, :, cast]).sum(axis=1)
        odds -= odds.max(axis=1, keepdims=True)
        p = np.exp(odds)
        return p / p.sum(axis=1, keepdims=True)

    def posterior(self, cast: np.ndarray) -> np.ndarray:
        """Chance of good quality for rows of votes."""
        return self.kinds(cast)[:, 0]

    def accuracies(self) -> np.ndarray:
        """Chance that a labeller is right where it votes."""
        at = self.shares[None, :, None] * self.chances
        right = at[:, 0, 2] + at[:, 1:, 1].sum(axis=1)
        return right / np.maximum(at[:, :, 1:].sum(axis=(1, 2)), 1e-12)


def expectation_maximisation(patterns: np.ndarray, counts: np.ndarray, rounds: int = 200, most_wrong: float = 0.01) -> LabelModel:
    """Fit the label model to how often each row of votes occurs.

    Rows without a bad mark start as good, others among the kinds of the labellers that
    mark them. most_wrong is a prior: no labeller marks more than this share of the good
    documents, which is what ties kind 0 to quality. Below it the rate is estimated.
    """
    n, j = patterns.shape
    one = np.eye(3)[patterns]  # pattern, labeller, vote
    marks = (patterns == 1).astype(float)
    part = np.concatenate([(marks.sum(axis=1, keepdims=True) == 0).astype(float), marks / np.maximum(marks.sum(axis=1, keepdims=True), 1)], axis=1)
    model = LabelModel(np.full(j + 1, 1 / (j + 1)), np.full((j, j + 1, 3), 1 / 3))
    for _ in range(rounds if n else 0):
        w = part * counts[:, None]  # pattern, kind
        seen = np.einsum("pk,pjv->jkv", w, one) + 0.05
        chances = seen / seen.sum(axis=2, keepdims=True)
        wrong = np.minimum(chances[:, 0, 1], most_wrong)
        chances[:, 0, 0] += chances[:, 0, 1] - wrong
        chances[:, 0, 1] = wrong
        total = w.sum(axis=0) + 1e-3
        model = LabelModel(total / total.sum(), chances)
        new = model.kinds(patterns)
        still = np.abs(new - part).max(initial=0) < 1e-9
        part = new
        if still:
            break
    return model


def _slot(kind: bytes, value: bytes) -> int:
    return zlib.crc32(kind + value) & ((1 << _BITS) - 1)


def word_slots(word: bytes) -> tuple[int, int]:
    """Hash slots of a word and of its last three bytes."""
    return _slot(b"w", word), _slot(b"e", word[-3:])


def bucket_slots(values: tuple[float, ...], edges: list[np.ndarray]) -> list[int]:
    return [_slot(b"b", f"{k}:{int(np.searchsorted(e, v))}".encode()) for k, (v, e) in enumerate(zip(values, edges))]


@dataclass
class QualityScorer:
    """sigmoid(bias + bucket weights + mean word weight) over hashed slots."""

    weights: np.ndarray
    bias: float
    edges: list[np.ndarray]
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "edges": self.edges, "_known": {}}

    def _word(self, word: bytes) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            a, b = word_slots(word)
            found = self._known[word] = float(self.weights[a] + self.weights[b])
        return found

    def score(self, text: str | None, values: tuple[float, ...]) -> float:
        words = text.encode("utf-8", "surrogatepass").split() if text else []
        z = self.bias + self.weights[bucket_slots(values, self.edges)].sum()
        if words:
            z += sum(map(self._word, words)) / len(words)
        return float(1 / (1 + np.exp(-np.clip(z, -30, 30))))


def train(texts: list[str | None], good: np.ndarray, decay: float = 1e-3, rounds: int = 60) -> QualityScorer:
    """Logistic regression on posterior labels, each document weighing the same."""
    values = [document_statistics(t)[1] for t in texts]
    table = np.array(values).reshape(-1, len(FEATURES))
    edges = [np.unique(np.quantile(table[:, k], np.linspace(0, 1, _BUCKETS + 1)[1:-1])) if len(table) else np.zeros(0) for k in range(len(FEATURES))]
    row, slot, amount = [], [], []
    for i, (t, v) in enumerate(zip(texts, values)):
        b = bucket_slots(v, edges)
        row += [i] * len(b)
        slot += b
        amount += [1.0] * len(b)
        words = t.encode("utf-8", "surrogatepass").split() if t else []
        pairs = [s for w in words for s in word_slots(w)]
        ids, n = np.unique(pairs, return_counts=True) if pairs else (np.zeros(0, int), np.zeros(0))
        row += [i] * len(ids)
        slot += ids.tolist()
        amount += (n / max(1, len(words))).tolist()
    if not len(texts) or good.sum() < 1e-6 or (1 - good).sum() < 1e-6:
        rate = float(np.clip(good.mean() if len(texts) else 0.5, 0.01, 0.99))
        return QualityScorer(np.zeros(1 << _BITS), float(np.log(rate / (1 - rate))), edges)
    row, slot, amount = np.array(row), np.array(slot), np.array(amount)
    up, down = good / len(texts), (1 - good) / len(texts)

    def loss(x: np.ndarray) -> tuple[float, np.ndarray]:
        z = np.clip(x[-1] + np.bincount(row, amount * x[slot], len(texts)), -30, 30)
        p = 1 / (1 + np.exp(-z))
        value = (up * np.logaddexp(0, -z) + down * np.logaddexp(0, z)).sum() + decay / 2 * (x[:-1] ** 2).sum()
        g = (up + down) * p - up
        return value, np.append(decay * x[:-1] + np.bincount(slot, amount * g[row], 1 << _BITS), g.sum())

    x = minimize(loss, np.zeros((1 << _BITS) + 1), rounds)
    return QualityScorer(x[:-1], float(x[-1]), edges)


def vote_column(text: Column) -> Column:
    """The votes on a text as digits."""

    @F.arrow_udf("string")
    def cast(values: pa.Array) -> pa.Array:
        return pa.array(["".join(map(str, votes(document_statistics(t)[1]))) for t in values.to_pylist()], pa.string())

    return cast(text)


def fit(docs: DataFrame, most: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> tuple[LabelModel, QualityScorer]:
    """The label model of the whole corpus and the scorer trained on its posteriors.

    Votes are counted over all documents; only the counts of vote patterns, at most
    3 ** labellers rows, come to the driver. The scorer learns from most documents (a
    documented bound, as are 96 MB of text), those with the smallest md5 of their ids; an id with
    several texts counts by one of them.
    """
    bound_batches(docs.sparkSession)
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    cast = materialize(own.select("id", vote_column(F.col("text")).alias("votes")))
    found = sorted((r["votes"], r["n"]) for r in cast.groupBy("votes").agg(F.count("*").alias("n")).collect())
    patterns = np.array([[int(c) for c in v] for v, _ in found], dtype=int).reshape(-1, len(LABELLERS))
    model = expectation_maximisation(patterns, np.array([n for _, n in found], dtype=float))
    picked = cast.where("id is not null").select(F.col("id").alias("__id")).distinct().orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(most)
    rows = sample_rows(docs, picked, id_col, text_col)
    discard(cast)
    texts = rows["__text"].tolist()
    posterior = model.posterior(np.array([votes(document_statistics(t)[1]) for t in texts], dtype=int).reshape(-1, len(LABELLERS)))
    return model, train(texts, posterior)


def score_documents(docs: DataFrame, scorer: QualityScorer, id_col: str = "doc_id", text_col: str = "text", least: float = 0.5) -> DataFrame:
    """One row per document: doc_id, score in [0, 1] and kept.

    Whole texts are scored. Null and empty texts score by their statistics, all 0; rows
    that repeat an id keep a row each; an empty corpus gives an empty result; other columns
    of docs are ignored.
    """
    bound_batches(docs.sparkSession)

    @F.arrow_udf("double")
    def quality(values: pa.Array) -> pa.Array:
        return pa.array([scorer.score(t, document_statistics(t)[1]) for t in values.to_pylist()], pa.float64())

    out = docs.select(F.col(id_col).alias("doc_id"), quality(F.col(text_col)).alias("score"))
    return out.withColumn("kept", F.col("score") >= least)
