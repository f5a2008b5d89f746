"""Vectors of entries that have none."""

import hashlib
import re

import numpy as np

from attestry.functions import vectors as vx
from attestry.sources import profiles

ENTRY = "id long, source_profile string, origin_memory_id string, embedding array<float>"
MEMORY = "source_profile string, origin_memory_id string, content string"


def test_only_a_missing_memory_fails(spark):
    entries = spark.createDataFrame([(1, "p", "a", None), (2, "p", "b", None), (3, "p", "c", None), (None, None, None, None), (5, "p", "gone", None), (6, "p", "a", [1.0])], ENTRY)
    memories = spark.createDataFrame([("p", "a", "Alpha beta"), ("p", "b", "É è."), ("p", "c", None), (None, None, "gamma")], MEMORY)
    out = {r["id"]: (r["embedding"] is None, r["failed"]) for r in profiles.backfill_embeddings(entries, memories, 8).collect()}
    assert out == {1: (False, False), 2: (True, False), 3: (True, False), None: (False, False), 5: (True, True)}


def test_one_row_an_entry_row(spark):
    entries = spark.createDataFrame([(1, "p", "a", None), (1, "p", "a", None)], ENTRY)
    memories = spark.createDataFrame([("p", "a", "Alpha"), ("p", "a", None), ("p", "a", "Beta")], MEMORY)
    rows = profiles.backfill_embeddings(entries, memories, 8).collect()
    assert len(rows) == 2 and rows[0] == rows[1] and rows[0]["embedding"] is not None


def plain(text, dimensions):
    words = [t for t in re.split(r"[^A-Za-z0-9]+", text.lower()) if t]
    drawn = [np.random.default_rng(int(hashlib.sha256(w.encode()).hexdigest(), 16) & 0xFFFFFFFF).standard_normal(dimensions, dtype=np.float32) for w in words]
    mean = np.mean(drawn, axis=0).astype(np.float64)
    return (mean / np.linalg.norm(mean)).astype(np.float32)


def test_a_word_is_drawn_once_and_vectors_stay(monkeypatch):
    texts = ["Alpha beta, alpha!", "\u0130alpha K9 b\u00e9ta", " ".join(f"w{i % 1500}" for i in range(4000))] * 2
    expected = [plain(t, 8) for t in texts]
    made, real = [], np.random.default_rng
    monkeypatch.setattr(np.random, "default_rng", lambda seed: made.append(seed) or real(seed))
    monkeypatch.setattr(vx, "_drawn", {})
    assert all((vx.encode_text(t, 8) == e).all() for t, e in zip(texts, expected))
    assert len(made) == len(set(made))
    monkeypatch.setattr(vx, "KEPT", 200)  # what is kept is bounded, and the vectors are the same
    monkeypatch.setattr(vx, "_drawn", {})
    assert all((vx.encode_text(t, 8) == e).all() for t, e in zip(texts, expected))
