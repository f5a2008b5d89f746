"""Vector functions on ARRAY<FLOAT> columns, and encoders."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def usable(a: Column, dimensions: int) -> Column:
    """Right length, finite and not zero."""
    finite = F.forall(a, lambda x: ~F.isnan(x) & (F.abs(x) < float("inf")))
    return a.isNotNull() & (F.size(a) == dimensions) & finite & (norm(a) > 0)


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def literal(vector) -> Column:
    """A query vector; refuses what no row could be compared with."""
    values = [float(x) for x in vector]
    if not values or not np.isfinite(values).all() or not any(values):
        raise ValueError("query vector must be finite and not zero")
    return F.array(*[F.lit(x).cast("float") for x in values])


#: Bytes of drawn vectors and their words that a worker keeps from text to text.
KEPT = 1 << 26


class _Drawn:
    """A vector a word, drawn once and kept: up to KEPT bytes, or those of one text."""

    def __init__(self, dimensions: int) -> None:
        self.dimensions, self.place, self.held = dimensions, {}, 0
        self.rows = np.empty((1024, dimensions), np.float32)

    def of(self, words: list[str]) -> np.ndarray:
        """One row a word, in the order of words."""
        place = self.place
        new = [w for w in dict.fromkeys(words) if w not in place]
        more = sum(4 * self.dimensions + len(w) for w in new)
        if new and place and self.held + more > KEPT:
            place.clear()
            self.held, new = 0, list(dict.fromkeys(words))
            more = sum(4 * self.dimensions + len(w) for w in new)
        self.held += more
        if len(place) + len(new) > len(self.rows):
            rows = np.empty((max(2 * len(self.rows), len(place) + len(new)), self.dimensions), np.float32)
            rows[: len(place)] = self.rows[: len(place)]
            self.rows = rows
        for w in new:
            seed = int(hashlib.sha256(w.encode()).hexdigest(), 16) & 0xFFFFFFFF
            self.rows[len(place)] = np.random.default_rng(seed).standard_normal(self.dimensions, dtype=np.float32)
            place[w] = len(place)
        return self.rows[[place[w] for w in words]]


_drawn: dict[int, _Drawn] = {}


def encode_text(text: str, dimensions: int = 384) -> np.ndarray:
    """Unit mean of one seeded normal vector a token; the seed is the token's SHA-256."""
    words = re.findall("[a-z0-9]+", text.lower())
    if not words:
        raise ValueError("no token to encode")
    known = _drawn.get(dimensions) or _drawn.setdefault(dimensions, _Drawn(dimensions))
    mean = np.mean(known.of(words), axis=0).astype(np.float64)
    return (mean / np.linalg.norm(mean)).astype(np.float32)


def encode(text: Column, dimensions: int = 384) -> Column:
    """encode_text() of a column; null where there is nothing to encode. Any other encoder with the same result type can stand in."""

    @F.arrow_udf("array<float>")
    def vector(values: pa.Array) -> pa.Array:
        out = []
        for t in values.to_pylist():
            try:
                out.append(encode_text(t, dimensions) if t else None)
            except ValueError:
                out.append(None)
        return pa.array(out, pa.list_(pa.float32()))

    return vector(text)
