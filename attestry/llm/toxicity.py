"""Toxicity by multiple-instance learning: sentences are instances, documents the bags."""

from __future__ import annotations

import re
import zlib
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, sample_rows

#: Sentences end at one of these or at a line break.
_SENTENCE = re.compile(r"[.!?\n]+")
_TOKEN = re.compile(r"\w+")
#: Words that a worker keeps scored at once.
_CACHE = 400_000


def sentences(text: str | None) -> list[str]:
    """Non-blank pieces of a text between sentence ends; no piece is dropped or cut."""
    return [s for s in _SENTENCE.split(text) if s.strip()] if text else []


def word_features(word: str, bits: int) -> list[int]:
    """Hash slots of a word: the word itself and its beginnings of 3 to 6 characters."""
    word = word.lower()
    out = [zlib.crc32(b"w" + word.encode("utf-8", "surrogatepass"))]
    out += [zlib.crc32(b"p" + word[:k].encode("utf-8", "surrogatepass")) for k in range(3, 7) if len(word) >= k]
    return [h & ((1 << bits) - 1) for h in out]


def quiet(score, least: float = 1.0):
    """Word scores without their first unit: many faint words in a long sentence don't add up to an offence."""
    return np.sign(score) * np.maximum(np.abs(score) - least, 0.0)


@dataclass
class ToxicityModel:
    """Hashed weights; a sentence scores sigmoid(bias + its words' weights), a document noisy-or of its sentences."""

    weights: np.ndarray
    bias: float
    bits: int
    scale: float = 1.0
    shift: float = 0.0
    _known: dict = field(default_factory=dict, repr=False, compare=False)

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "bias": self.bias, "bits": self.bits, "scale": self.scale, "shift": self.shift, "_known": {}}

    def word(self, word: str) -> float:
        found = self._known.get(word)
        if found is None:
            if len(self._known) >= _CACHE:
                self._known.clear()
            found = self._known[word] = float(quiet(self.weights[word_features(word, self.bits)].sum()))
        return found

    def sentence_logits(self, text: str | None) -> list[float]:
        word, bias = self.word, self.bias
        return [bias + sum(map(word, _TOKEN.findall(s))) for s in sentences(text)]

    def score(self, text: str | None) -> float:
        """Calibrated noisy-or over all sentences; an empty text scores as a bag without instances."""
        logits = self.sentence_logits(text)
        none = -np.logaddexp(0, np.asarray(logits)).sum() if logits else 0.0  # log of the chance that no sentence is toxic
        some = np.log(-np.expm1(min(none, -1e-12)))
        z = np.clip(self.scale * (some - none) + self.shift, -30, 30)
        return float(1 / (1 + np.exp(-z)))

    def worst(self, text: str | None, least: float = 0.5) -> list[tuple[str, float]]:
        """Sentences whose own probability reaches least, in text order."""
        found = zip(sentences(text), self.sentence_logits(text))
        return [(s.strip(), p) for s, z in found if (p := float(1 / (1 + np.exp(-np.clip(z, -30, 30))))) >= least]


def train(texts: list[str | None], labels: list[int], bits: int = 18, rounds: int = 60, decay: float = 3e-5, fewest: int = 5) -> ToxicityModel:
    """Fit on document labels alone: the gradient of the noisy-or likelihood shares a
    document's label among its sentences by how much each explains it. Same input, same model."""
    slots: dict[str, int] = {}
    # packed arrays: lists of Python numbers would take many times the memory
    word_of, ends, bags, flat, size = array("i"), array("q"), array("i"), array("i"), array("i")
    for text in texts:
        own = sentences(text)
        for s in own:
            for w in _TOKEN.findall(s):
                w = w.lower()
                at = slots.setdefault(w, len(slots))
                if at == len(size):
                    found = word_features(w, bits)
                    flat.extend(found)
                    size.append(len(found))
                word_of.append(at)
            ends.append(len(word_of))
        bags.append(len(own))
    n_words = len(slots)
    del slots
    y, bags = np.asarray(labels, dtype=float), np.asarray(bags)
    if not len(ends) or y.min(initial=1) == y.max(initial=0):  # one class only: its share is all there is to say
        rate = float(y.mean()) if len(y) else 0.0
        logit = np.log((rate + 1e-3) / (1 - rate + 1e-3))
        return ToxicityModel(np.zeros(1 << bits), -20.0, bits, scale=0.0, shift=logit)
    token, ends = np.asarray(word_of, dtype=np.intp), np.asarray(ends)
    instance = np.repeat(np.arange(len(ends)), np.diff(np.append(0, ends)))
    bag = np.repeat(np.arange(len(bags)), bags)
    del word_of
    flat, owner = np.asarray(flat, dtype=np.intp), np.repeat(np.arange(n_words), np.asarray(size))
    # slots that few documents have say nothing general, and keep weight 0
    pairs = np.unique(bag[instance].astype(np.int64) * n_words + token)
    holders = np.bincount(pairs % n_words, minlength=n_words)
    del pairs
    seen = np.zeros(1 << bits)
    np.add.at(seen, flat, holders[owner])
    common = seen[flat] >= fewest
    used, flat = np.unique(flat[common], return_inverse=True)
    owner = owner[common]
    weight = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))  # classes count alike

    def loss(x: np.ndarray, least: float = 1.0) -> tuple[float, np.ndarray]:
        raw = np.bincount(owner, x[flat], n_words)
        score = quiet(raw, least)
        z = np.clip(x[-1] + np.bincount(instance, score[token], len(ends)), -30, 30)
        none = np.minimum(np.bincount(bag, -np.logaddexp(0, z), len(bags)), -1e-9)
        some = -np.expm1(none)
        value = -(weight * np.where(y > 0, np.log(some), none)).sum() + decay / 2 * (x[:-1] ** 2).sum()
        pull = weight * np.where(y > 0, np.exp(none) / some, -1.0)
        g = pull[bag] / (1 + np.exp(-z))
        by_word = np.bincount(token, g[instance], n_words) * (np.abs(raw) >= least)
        grad = np.append(decay * x[:-1] - np.bincount(flat, by_word[owner], len(used)), -g.sum())
        return value, grad

    # a start from plain scores, as quiet ones have no slope at 0; then the likelihood of what is scored
    x = minimize(lambda x: loss(x, 0.0), np.append(np.zeros(len(used)), -4.0), rounds)
    x = minimize(loss, x, rounds // 2)
    weights, bias = x[:-1], x[-1]
    z = np.clip(bias + np.bincount(instance, quiet(np.bincount(owner, weights[flat], n_words))[token], len(ends)), -30, 30)
    full = np.zeros(1 << bits)
    full[used] = weights
    model = ToxicityModel(full, float(bias), bits)
    # calibration of the noisy-or's log odds to the labels as they occur
    none = np.bincount(bag, -np.logaddexp(0, z), len(bags))
    odds = np.log(-np.expm1(np.minimum(none, -1e-12))) - none
    model.scale, model.shift = _calibrate(np.clip(odds, -40, 40), y)
    return model


def minimize(loss, x: np.ndarray, rounds: int, memory: int = 8) -> np.ndarray:
    """Limited-memory BFGS with backtracking."""
    value, grad = loss(x)
    past: list[tuple[np.ndarray, np.ndarray, float]] = []
    for _ in range(rounds):
        q, alphas = grad.copy(), []
        for s, d, rho in reversed(past):
            alphas.append(rho * (s @ q))
            q -= alphas[-1] * d
        if past:
            s, d, _ = past[-1]
            q *= (s @ d) / (d @ d)
        for (s, d, rho), alpha in zip(past, reversed(alphas)):
            q += (alpha - rho * (d @ q)) * s
        slope = grad @ q
        if slope <= 1e-12:
            break
        step = 1.0 if past else 1.0 / max(np.abs(grad).max(), 1e-9) * 0.1
        for _ in range(25):
            new = x - step * q
            after, turned = loss(new)
            if after <= value - 1e-4 * step * slope:
                break
            step /= 2
        else:
            break
        s, d = new - x, turned - grad
        if s @ d > 1e-12:
            past = [*past, (s, d, 1.0 / (s @ d))][-memory:]
        done = value - after < 1e-7 * max(1.0, abs(value))
        x, value, grad = new, after, turned
        if done:
            break
    return x


def _calibrate(odds: np.ndarray, y: np.ndarray, rounds: int = 200) -> tuple[float, float]:
    scale, shift = 1.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(scale * odds + shift, -30, 30)))
        x = np.stack([odds, np.ones_like(odds)])
        h = (x * np.maximum(p * (1 - p), 1e-6)) @ x.T / len(y) + 1e-3 * np.eye(2)
        step = np.linalg.solve(h, x @ (y - p) / len(y) - np.array([1e-3 * (scale - 1), 0]))
        scale, shift = max(0.05, scale + step[0]), shift + step[1]
        if np.abs(step).max() < 1e-7:
            break
    return float(scale), float(shift)


def fit(docs: DataFrame, labels: DataFrame, each: int = 2500, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", held_out: tuple[int, int] | None = (3, 1), bits: int = 18) -> ToxicityModel:
    """Fit on at most each documents of either label and 96 MB of text (documented bounds),
    chosen by the md5 of their ids; with held_out=(n, k), none of whose crc32(id) mod n is k.
    An id with both labels counts as toxic, one with several texts by one of them. The label
    table is cut down to the sample before it meets the texts. Without labels or documents
    the model knows no word."""
    known = labels.select(F.col(id_col).alias("__id"), F.col(label_col).cast("int").alias("__y")).where("__id is not null and __y in (0, 1)")
    known = known.groupBy("__id").agg(F.max("__y").alias("__y"))  # an id labelled both ways is toxic
    if held_out:
        known = known.where(crc_mod(F.col("__id"), held_out[0]) != held_out[1])
    order = [F.md5(F.col("__id").cast("string").cast("binary")), F.col("__id")]
    sample = [known.where(F.col("__y") == y).orderBy(*order).limit(each) for y in (0, 1)]
    rows = sample_rows(docs, sample[0].union(sample[1]), id_col, text_col)
    return train(rows["__text"].tolist(), rows["__y"].tolist(), bits=bits)


def score_column(text: Column, model: ToxicityModel) -> Column:
    @F.arrow_udf("double")
    def toxicity(values: pa.Array) -> pa.Array:
        return pa.array([model.score(t) for t in values.to_pylist()], pa.float64())

    return toxicity(text)


def sentence_column(text: Column, model: ToxicityModel, least: float = 0.5) -> Column:
    """The offending sentences of a text with their probabilities."""
    kind = pa.list_(pa.struct([("sentence", pa.string()), ("score", pa.float64())]))

    @F.arrow_udf("array<struct<sentence:string,score:double>>")
    def offending(values: pa.Array) -> pa.Array:
        return pa.array([[{"sentence": s, "score": p} for s, p in model.worst(t, least)] for t in values.to_pylist()], kind)

    return offending(text)


def score_documents(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """One row per document: doc_id, held_out, score in [0, 1], predicted.

    Texts are scored whole. Null and empty texts have no sentences and score as such; a
    null id is not held out; rows that repeat an id keep a row each. An empty table gives an
    empty result; other columns of docs are ignored.
    """
    bound_batches(docs.sparkSession)
    return docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), 3) == 1, F.lit(False)).alias("held_out"), score_column(F.col(text_col), model).alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def reject_toxic(docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs without those that score threshold or more; columns unchanged, whatever their names. Null and empty texts stay."""
    bound_batches(docs.sparkSession)
    return docs.where(score_column(F.col(text_col), model) < threshold)
