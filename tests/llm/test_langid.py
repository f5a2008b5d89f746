"""Language identification with more languages than a byte numbers."""

import numpy as np
import pytest

from attestry.llm import langid


def own_words(k):
    return " ".join("".join(chr(97 + (k * 7 + j * 5 + i * (k % 25 + 1)) % 26) for i in range(6)) for j in range(12))


@pytest.mark.parametrize("kinds", [127, 128, 129, 200, 400])
def test_viterbi_keeps_labels_beyond_a_byte(kinds):
    score = np.zeros((6, kinds), dtype=np.float32)
    score[:3, kinds - 1] = score[3:, kinds - 2] = 9.0
    path = langid.viterbi(score, np.array([0]), np.array([6]), 2.0)
    assert path.tolist() == [kinds - 1] * 3 + [kinds - 2] * 3


def test_scores_in_parts_are_those_of_the_whole(monkeypatch):
    texts = [own_words(k) for k in range(20)]
    model = langid.train(texts, [f"l{k:03}" for k in range(20)])
    points, _ = langid._letters(texts + ["", "x" * 90])
    want = model.word_scores(points)
    monkeypatch.setattr(langid, "_CELLS", 500)
    for a, b in zip(want, model.word_scores(points)):
        assert np.array_equal(a, b)


def test_no_number_of_languages_is_refused(spark):
    rows = [(k, own_words(k), f"l{k:03}") for k in range(310)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(2)
    model = langid.fit(docs, held_out=None)
    assert model.languages == [r[2] for r in rows]
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify(docs, model).collect()}
    same = {}
    for _, text, lang in rows:
        same.setdefault(text, []).append(lang)
    assert sum(got[i] in same[text] for i, text, _ in rows) > 0.97 * len(rows)


def test_letters_of_supplementary_planes_are_letters():
    model = langid.train(["plain words of one language here", "漢字 文字 漢文"], ["en", "zh"])
    names, scores = model.predict([chr(0x20000) * 4, chr(0x31350) + " ", "\U0001F600 12", None])
    assert names == ["zh", "zh", "und", "und"] and scores[0] == scores[1] == 1.0 and scores[2] == 0.0
