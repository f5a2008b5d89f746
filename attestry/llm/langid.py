"""Language identification: scripts narrow the candidates, Viterbi labels spans of mixed text."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, crc_mod, sample_rows

#: Code-point ranges of scripts (fixed values).
SCRIPTS = (
    ("latin", 0x41, 0x24F), ("latin", 0x1E00, 0x1EFF), ("greek", 0x370, 0x3FF), ("cyrillic", 0x400, 0x52F),
    ("armenian", 0x530, 0x58F), ("hebrew", 0x590, 0x5FF), ("arabic", 0x600, 0x6FF), ("devanagari", 0x900, 0x97F),
    ("bengali", 0x980, 0x9FF), ("tamil", 0xB80, 0xBFF), ("thai", 0xE00, 0xE7F), ("georgian", 0x10A0, 0x10FF),
    ("hangul", 0x1100, 0x11FF), ("kana", 0x3040, 0x30FF), ("han", 0x3400, 0x9FFF), ("hangul", 0xAC00, 0xD7AF), ("han", 0x20000, 0x3FFFF),
)
_NAMES = sorted({name for name, _, _ in SCRIPTS})
_BITS = 16
_SPAN = 1 << 20  # characters handled at once with up to 8 languages, fewer with more
_CELLS = 1 << 23  # scores of letters held at once
_tables: dict[str, np.ndarray] = {}


def _lookup() -> tuple[np.ndarray, np.ndarray]:
    """Lower-cased letter of each code point (0: no letter), and its script (0: none known)."""
    if not _tables:
        low, script = np.zeros(0x110000, dtype=np.uint32), np.zeros(0x110000, dtype=np.int8)
        for c in (*range(0x40000), *range(0xE0000, 0xE1000)):  # planes between and beyond hold no letters
            if unicodedata.category(chr(c))[0] == "L":
                low[c] = ord(chr(c).lower()[0])
        for name, first, last in SCRIPTS:
            script[first : last + 1] = 1 + _NAMES.index(name)
        _tables["low"], _tables["script"] = low, script
    return _tables["low"], _tables["script"]


def _letters(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, each led and followed by a blank, and the start of each text."""
    lengths = np.array([len(t) + 1 if t else 1 for t in texts], dtype=np.int64)
    joined = " " + " ".join(t or "" for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return points, np.concatenate(([0], np.cumsum(lengths)))


def _words(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters (0 elsewhere), first positions and lengths of runs of letters."""
    low, _ = _lookup()
    chars = low[points]
    letter = chars > 0
    edge = np.diff(letter.astype(np.int8), prepend=0, append=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    return chars, start, end - start


def _trigrams(chars: np.ndarray) -> np.ndarray:
    """Hash slot of the three characters around each position."""
    padded = np.concatenate(([0], chars, [0])).astype(np.uint64)
    mixed = padded[:-2] * np.uint64(0x9E3779B97F4A7C15) ^ padded[1:-1] * np.uint64(0xC2B2AE3D27D4EB4F) ^ padded[2:] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0xBF58476D1CE4E5B9)
    return (mixed >> np.uint64(64 - _BITS)).astype(np.int64)


@dataclass
class LanguageModel:
    languages: list[str]
    table: np.ndarray  # log chance of each trigram slot, one column a language
    scripts: np.ndarray  # whether a language is written in a script; row 0 is 'none known'
    penalty: float = 12.0

    def word_scores(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and per-language score of every word; languages of other scripts fall far behind."""
        chars, start, length = _words(points)
        if not len(start):
            return start, length, np.zeros((0, len(self.languages)), dtype=np.float32)
        slot = _trigrams(chars)
        inside = np.flatnonzero(chars)  # letters only, so that each word's positions follow each other
        upto = np.cumsum(length)
        score = np.empty((len(start), len(self.languages)), dtype=np.float32)
        most, a = max(1, _CELLS // max(1, len(self.languages))), 0
        while a < len(start):  # whole words at a time
            at = upto[a] - length[a]
            b = max(a + 1, int(np.searchsorted(upto, at + most, side="right")))
            score[a:b] = np.add.reduceat(self.table[slot[inside[at : upto[b - 1]]]], upto[a:b] - length[a:b] - at, axis=0)
            a = b
        _, script = _lookup()
        kind = script[points[start]]
        allowed = self.scripts[kind]
        narrowed = allowed.any(axis=1, keepdims=True) & ~allowed
        return start, length, np.where(narrowed, score - 50.0, score).astype(np.float32)

    def labels(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(word starts, word lengths, language numbers) of each text, by Viterbi over its words."""
        out: list = []
        at, span = 0, _SPAN * 8 // max(8, len(self.languages))
        while at < len(texts):  # in spans, so that memory follows the longest text and not the batch
            upto, size = at, 0
            while upto < len(texts) and (upto == at or size + len(texts[upto] or "") < span):
                size += len(texts[upto] or "")
                upto += 1
            out += self._label(texts[at:upto])
            at = upto
        return out

    def _label(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        points, bounds = _letters(texts)
        start, length, score = self.word_scores(points)
        cut = np.searchsorted(start, bounds)
        count = np.diff(cut)
        best = viterbi_blocks if len(self.languages) <= 8 else viterbi
        path = best(score, cut[:-1], count, self.penalty)
        return [(start[a:b] - bounds[i] - 1, length[a:b], path[a:b]) for i, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]

    def predict(self, texts: list[str | None]) -> tuple[list[str], list[float]]:
        """The language that labels most letters, and its share of them; und without letters. Ties go to the first name."""
        names, shares = [], []
        for _, length, path in self.labels(texts):
            if not len(path) or not self.languages:
                names.append("und")
                shares.append(0.0)
                continue
            held = np.bincount(path, length, len(self.languages))
            best = int(np.argmax(held))
            names.append(self.languages[best])
            shares.append(float(held[best] / held.sum()))
        return names, shares

    def spans(self, text: str | None) -> list[dict]:
        """Runs of words of one language: language, first character, end character, words."""
        (start, length, path), = self.labels([text])
        out = []
        for run in np.split(np.arange(len(path)), np.flatnonzero(np.diff(path)) + 1):
            if len(run):
                out.append({"lang": self.languages[path[run[0]]], "start": int(start[run[0]]), "end": int(start[run[-1]] + length[run[-1]]), "words": len(run)})
        return out


def viterbi(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float) -> np.ndarray:
    """Best label of every word where a change of label costs penalty.

    All sequences advance together, one word a step; the longest come first, so those
    still running are a leading block.
    """
    n, kinds = score.shape
    path = np.zeros(n, dtype=np.int64)
    order = np.argsort(-count, kind="stable")
    order = order[count[order] > 0]
    if not len(order) or kinds < 2:
        return path
    first, count = first[order], count[order]
    active = len(count) - np.searchsorted(count[::-1], np.arange(1, count[0] + 1))  # with t words or more, t from 1
    came = np.zeros((n, kinds), dtype=np.min_scalar_type(-kinds))  # a type that holds every label
    value = score[first].astype(np.float64)
    own = np.arange(kinds)
    for t in range(1, int(count[0])):
        k = active[t]
        before = value[:k]
        best = before.argmax(axis=1)
        switch = before[np.arange(k), best] - penalty
        stay = before >= switch[:, None]
        rows = first[:k] + t
        came[rows] = np.where(stay, own, best[:, None])
        value[:k] = np.where(stay, before, switch[:, None]) + score[rows]
    label = value.argmax(axis=1)
    for t in range(int(count[0]) - 1, -1, -1):
        k = active[t]
        rows = first[:k] + t
        path[rows] = label[:k]
        if t:
            label[:k] = came[rows, label[:k]]
    return path


def viterbi_blocks(score: np.ndarray, first: np.ndarray, count: np.ndarray, penalty: float, size: int = 16) -> np.ndarray:
    """viterbi() in two levels, for few labels: blocks of words become matrices of best
    scores from entering to leaving label, all at once, and only blocks go in sequence."""
    n, kinds = score.shape
    path = np.zeros(n, dtype=np.int64)
    held = np.flatnonzero(count > 0)
    if not len(held) or kinds < 2:
        return path
    held = held[np.argsort(-count[held], kind="stable")]
    first, count = first[held], count[held]
    blocks = -(-count // size)
    at = np.cumsum(blocks) - blocks
    total = int(blocks.sum())
    word = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    cell = np.repeat(at * size, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    cells = np.zeros((total * size, kinds))  # words past the end score 0 for all, so no change pays there
    cells[cell] = score[word]
    cells = cells.reshape(total, size, kinds)
    own = np.arange(kinds)
    matrix = cells[:, 0, None, :] + np.where(np.eye(kinds, dtype=bool), 0.0, -penalty)
    came = np.zeros((total, size, kinds, kinds), dtype=np.int8)
    for t in range(1, size):
        best = matrix.argmax(axis=2)[:, :, None]
        switch = np.take_along_axis(matrix, best, 2) - penalty
        stay = matrix >= switch
        came[:, t] = np.where(stay, own, best)
        matrix = np.where(stay, matrix, switch) + cells[:, t, None, :]
    active = len(blocks) - np.searchsorted(blocks[::-1], np.arange(1, blocks[0] + 1))
    value = matrix[at].max(axis=1)
    entered = np.zeros((total, kinds), dtype=np.int64)  # the label a block is entered with, by the one it is left with
    entered[at] = matrix[at].argmax(axis=1)
    for t in range(1, int(blocks[0])):
        k = active[t]
        step = value[:k, :, None] + matrix[at[:k] + t]
        entered[at[:k] + t] = step.argmax(axis=1)
        value[:k] = step.max(axis=1)
    label = value.argmax(axis=1)
    leave = np.zeros(total, dtype=np.int64)
    for t in range(int(blocks[0]) - 1, -1, -1):
        k = active[t]
        rows = at[:k] + t
        leave[rows] = label[:k]
        label[:k] = entered[rows, label[:k]]
    every = np.arange(total)
    enter, label = entered[every, leave], leave
    out = np.zeros((total, size), dtype=np.int64)
    for t in range(size - 1, 0, -1):
        out[:, t] = label
        label = came[every, t, enter, label]
    out[:, 0] = label
    path[word] = out.reshape(-1)[cell]
    return path


def train(texts: list[str | None], langs: list[str], penalty: float = 12.0) -> LanguageModel:
    """Smoothed trigram tables and written scripts of each language."""
    names = sorted(set(langs))
    table = np.zeros((1 << _BITS, len(names)), dtype=np.float32)
    used = np.zeros((len(_NAMES) + 1, len(names)))
    own: dict[str, list[str]] = {name: [] for name in names}
    for text, lang in zip(texts, langs):
        if text:
            own[lang].append(text)
    _, script = _lookup()
    for k, name in enumerate(names):
        share = np.full(1 << _BITS, 0.5)
        for text in own[name]:
            points, _ = _letters([text])
            chars, start, length = _words(points)
            share += np.bincount(_trigrams(chars)[chars > 0], minlength=1 << _BITS)
            used[:, k] += np.bincount(script[points[start]], minlength=len(_NAMES) + 1)
        table[:, k] = np.log(share / share.sum())
    written = used / np.maximum(used.sum(axis=0), 1) >= 0.02
    written[0] = False
    return LanguageModel(names, table, written, penalty)


def fit(docs: DataFrame, each: int = 800, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", held_out: tuple[int, int] | None = (5, 0), most_bytes: int = 96 << 20, **options) -> LanguageModel:
    """Fit on about each documents of a language (a documented bound), chosen by the md5
    of their ids among rows whose crc32(id) mod n isn't k, and on most_bytes of text. An id of
    several languages counts as the first, one of several texts by one of them. Languages are
    counted first; any number of them is taken, at 256 KB of the model each."""
    known = docs.where(F.col(lang_col).isNotNull() & F.col(id_col).isNotNull())
    if held_out:
        known = known.where(crc_mod(F.col(id_col), held_out[0]) != held_out[1])
    part = F.conv(F.substring(F.md5(F.concat(F.lit("lang"), F.col(id_col).cast("string")).cast("binary")), 1, 8), 16, 10).cast("double") / F.lit(float(1 << 32))
    ids = known.select(F.col(id_col).alias("__id"), F.col(lang_col).alias("__lang"), part.alias("__part"))
    rates = ids.groupBy("__lang").agg(F.least(F.lit(1.0), F.lit(float(each)) / F.count("*")).alias("__rate"))
    picked = ids.join(F.broadcast(rates), "__lang").where("__part < __rate").groupBy("__id").agg(F.min("__lang").alias("__lang"))
    rows = sample_rows(docs, picked, id_col, text_col, most_bytes)
    return train(rows["__text"].tolist(), rows["__lang"].tolist(), **options)


def predict_column(text: Column, model: LanguageModel) -> Column:
    @F.arrow_udf("struct<lang:string,score:double>")
    def language(values: pa.Array) -> pa.Array:
        names, shares = model.predict(values.to_pylist())
        return pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(shares, pa.float64())], names=["lang", "score"])

    return language(text)


def span_rows(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per language span: doc_id, lang, start, end (characters), words."""
    bound_batches(docs.sparkSession)

    def spans(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [{"doc_id": i} | s for i, t in zip(frame["doc_id"], frame["text"]) for s in model.spans(t)]
            yield pd.DataFrame(found, columns=["doc_id", "lang", "start", "end", "words"])

    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return plain.mapInPandas(spans, "doc_id long, lang string, start long, end long, words long")


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score.

    Whole texts are labelled. A null text or one without letters, or a model without
    languages, gives und and 0; ties go to the first language by name. A null id isn't held
    out; rows that repeat an id keep a row each. An empty table gives an empty result; other
    columns of docs are ignored.
    """
    bound_batches(docs.sparkSession)
    found = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(crc_mod(F.col(id_col), 5) == 0, F.lit(False)).alias("held_out"), predict_column(F.col(text_col), model).alias("p"))
    return found.select("doc_id", "held_out", F.col("p.lang").alias("lang_pred"), F.col("p.score").alias("score"))
