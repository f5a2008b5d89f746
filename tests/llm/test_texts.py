"""Extraction, quality rules, decontamination, language and toxicity on small corpora."""

import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from attestry.llm import decontaminate, extraction, langid, quality_rules, toxicity, weak_quality

DOCS = "doc_id long, text string, lang string"
EN = "the and of that with from this which there into over under between many small large house river stone water light garden".split()
DE = "der die und das mit von nicht eine werden schule straße häuser bäume wasser licht garten fluss stein groß klein".split()


def prose(rng, words, n):
    out = [rng.choice(words) for _ in range(n)]
    return " ".join(w.capitalize() if i % 9 == 0 else w + "." if i % 9 == 8 else w for i, w in enumerate(out))


# ---- extraction -----------------------------------------------------------------------

PAGE = """<!doctype html><html><head><title>No</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body class="no-sidebar">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">Home</a></li><li><a href='b>c'>About</a></li></ul></nav><div class="cookie-notice"><p>We use cookies.</p></div>
<main><article><h1>A &amp; B</h1><p>First <b>bold&nbsp;text</b>,
 then <a href="x">a link</a>.<br><p>Second&copy; &#233; &lt;tag&gt;</p><blockquote>Quoted.</blockquote><form><p>Mail</p><input></form><table><tr><td>one</td><td>two</td></tr></table></article>
<div class="comments"><p>I think so too.</p></div></main><aside><p>Side</p></aside><!-- <p>hidden</p> --><footer>&copy; us</footer><div class="advert">Buy</div></body></html>"""
WANT = "A & B\nFirst bold text, then a link.\nSecond© é <tag>\nQuoted.\none\ntwo"


def test_main_text_of_a_page():
    model = extraction.train([PAGE] * 3)
    assert model.extract([PAGE]) == [WANT]


@pytest.mark.parametrize("cut", range(0, len(PAGE), 61))
def test_cut_pages_don_t_crash_and_only_lose_their_end(cut):
    model = extraction.train([PAGE])
    text = model.extract([PAGE[:cut]])[0]
    assert "hidden" not in text and "cookies" not in text


def test_minimum_cut_is_minimal():
    rng = np.random.default_rng(2)
    for _ in range(60):
        n = int(rng.integers(1, 8))
        cost = rng.normal(size=n) * 2
        edges = [(i, j, float(rng.random() * 2)) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5]

        def energy(side):
            return sum(max(c, 0) if not s else max(-c, 0) for c, s in zip(cost, side)) + sum(w for a, b, w in edges if side[a] != side[b])

        best = min(energy(s) for s in itertools.product([0, 1], repeat=n))
        assert energy(extraction.minimum_cut(cost, edges)) == pytest.approx(best)


def test_extract_rows(spark):
    rows = [(1, "u", PAGE, "x"), (1, "u", PAGE, "x"), (2, None, None, "x"), (3, "v", "", "x"), (None, "w", "<p>" + "Long words here, " * 20_000 + "</p>", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = extraction.extract(df, extraction.fit(df)).collect()
    assert sorted((r["page_id"] or 0, r["n_chars"] > 0) for r in got) == [(0, True), (1, True), (1, True), (2, False), (3, False)]
    assert all(r["n_chars"] == len(r["text"]) for r in got)
    empty = df.where("false")
    assert extraction.extract(empty, extraction.fit(empty)).count() == 0


# ---- quality --------------------------------------------------------------------------


def test_repeated_words_match_definition():
    rng = random.Random(1)
    for _ in range(200):
        words = [rng.choice("abcd") for _ in range(rng.randint(0, 40))]
        runs = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        n = Counter(runs)
        covered = {j for i, r in enumerate(runs) if n[r] > 1 for j in range(i, i + 5)}
        assert quality_rules.repeated_words(words) == len(covered)


def test_statistics_of_a_text():
    base, _ = quality_rules.document_statistics("Ünd a|b #x\n\nline two\n \x0b\nline two\nline two ")
    assert base == (9, 29, 2, 1, 0)  # the last line differs by its blank
    assert quality_rules.document_statistics(None)[0] == quality_rules.document_statistics("")[0] == (0,) * 5


def test_trees_follow_their_constraints():
    rng = np.random.default_rng(0)
    x = rng.random((600, 2))
    y = ((x[:, 0] + 0.4 * rng.random(600) < 0.7) ^ (x[:, 1] > 0.9)).astype(float)
    model = quality_rules.fit_trees(x, y, (-1, 0))
    grid = np.linspace(0, 1, 50)
    for other in (0.1, 0.5, 0.95):
        p = model.score(np.stack([grid, np.full(50, other)], axis=1))
        assert (np.diff(p) <= 1e-12).all()
    assert ((model.score(x) > 0.5) == (y > 0)).mean() > 0.85


def quality_corpus(n=400):
    rng = random.Random(3)
    rows, labels = [], []
    for i in range(n):
        text = prose(rng, EN, 60)
        if i % 3 == 0:
            text = " ".join(w + "***" for w in text.split()) if i % 2 else "\n".join([prose(rng, EN, 12)] * 9)
        rows.append((i, text, "en"))
        labels.append((i, int(i % 3 != 0), 0))
    return rows, labels


def test_quality_rules_on_a_corpus(spark):
    rows, labels = quality_corpus()
    extra = [(9000, None, None), (9001, "", None), (None, "short", None), (9002, "a b " * 30_000, "en"), (5, rows[5][1], "en")]
    docs, marks = spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = quality_rules.judge(docs, quality_rules.fit(docs, marks)).collect()
    assert len(got) == len(rows) + len(extra)
    kept = {r["doc_id"]: r["kept"] for r in got}
    assert sum(kept[i] == bool(q) for i, q, _ in labels) > 0.97 * len(labels)
    assert not any(kept[d] for d in (9000, 9001, None, 9002))
    none = docs.where("false")
    assert quality_rules.judge(none, quality_rules.fit(none, marks)).count() == 0


def test_weak_labels_separate_without_labels(spark):
    rows, labels = quality_corpus()
    docs = spark.createDataFrame(rows + [(9000, None, None), (None, "", None)], DOCS)
    model, scorer = weak_quality.fit(docs)
    assert (model.accuracies() >= 0).all() and 0.4 < model.good < 0.95
    kept = {r["doc_id"]: r["kept"] for r in weak_quality.score_documents(docs, scorer).collect()}
    assert sum(kept[i] == bool(q) for i, q, _ in labels) > 0.95 * len(labels)
    assert weak_quality.score_documents(docs.where("false"), weak_quality.fit(docs.where("false"))[1]).count() == 0


def test_em_finds_accuracies_of_overlapping_labellers():
    rng = np.random.default_rng(4)
    truth = rng.random(20_000) < 0.7
    catch = np.array([0.9, 0.6, 0.7])
    marked = (~truth[:, None] & (rng.random((20_000, 3)) < catch)) | (truth[:, None] & (rng.random((20_000, 3)) < 0.005))
    patterns, counts = np.unique(np.where(marked, 1, 0), axis=0, return_counts=True)
    model = weak_quality.expectation_maximisation(patterns, counts.astype(float))
    assert model.good == pytest.approx(0.7, abs=0.05)
    right = [(~truth[marked[:, k]]).mean() for k in range(3)]
    assert model.accuracies() == pytest.approx(right, abs=0.05)


def test_em_keeps_kinds_of_junk_that_one_labeller_knows():
    patterns = np.array([[0, 0, 0, 0], [1, 1, 1, 0], [0, 0, 0, 1]])
    assert (weak_quality.expectation_maximisation(patterns, np.array([700.0, 200.0, 100.0])).posterior(patterns) > 0.5).tolist() == [True, False, False]


# ---- decontamination ------------------------------------------------------------------


def slow_leaks(text, items, threshold=0.8):
    import re

    split = lambda t: [w for w in re.split(r"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w]
    sets = {}
    for i, t in items:
        w = split(t)
        if w:
            k = min(5, len(w))
            sets[i] = (k, len(w), Counter(tuple(w[j : j + k]) for j in range(len(w) - k + 1)))
    spread = Counter(s for _, _, c in sets.values() for s in c)
    weight = lambda s: np.log(1 + len(sets) / spread[s]) if s in spread else np.log(1 + len(sets))
    words, found = split(text), {}
    for i, (k, m, own) in sets.items():
        for at in range(len(words) - m + 1):
            part = words[at : at + m]
            c = Counter(tuple(part[j : j + k]) for j in range(m - k + 1))
            both = sum(weight(s) * min(n, own[s]) for s, n in c.items())
            total = sum(weight(s) * n for s, n in c.items()) + sum(weight(s) * n for s, n in own.items()) - both
            if both / total >= threshold:
                found[i] = max(found.get(i, 0), both / total)
    return found


def test_leaks_match_brute_force():
    rng = random.Random(8)
    vocabulary = ["v%d" % i for i in range(500)]
    draw = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(draw(rng.randint(12, 60)))) for i in range(30)] + [(30, "one two three"), (31, None), (32, ""), (33, "Häuser, Bäume und Gärten am großen Fluss.")]
    items.append((34, items[0][1]))
    index = decontaminate.BenchmarkIndex.build(items)
    texts = []
    for n in range(120):
        words = draw(rng.randint(0, 150))
        if n % 2:
            words[len(words) // 2 : len(words) // 2] = []
            part = (rng.choice(items[:30])[1]).split()
            for _ in range(n % 5):
                part[rng.randrange(len(part))] = rng.choice(vocabulary)
            words = words[: len(words) // 2] + ([w.upper() + "," for w in part] if n % 3 == 0 else part) + words[len(words) // 2 :]
        texts.append(" ".join(words))
    texts += ["x one, TWO\nthree", None, "", "Die häuser bäume und gärten am großen fluss!"]
    got = index.leaks([t.encode() if t else None for t in texts])
    for text, found in zip(texts, got):
        want = slow_leaks(text, items)
        assert {f["item_id"] for f in found} == set(want)
        for f in found:
            assert f["similarity"] == pytest.approx(want[f["item_id"]])


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    items = [(i, " ".join(f"w{rng.integers(0, 999)}" for _ in range(20))) for i in range(50)]
    index = decontaminate.BenchmarkIndex.build(items)
    for r in (0, 5, 12, 20):
        target = index.prints.copy()
        for row in range(len(target)):
            for bit in rng.choice(64, r, replace=False):
                target[row] ^= np.uint64(1) << np.uint64(bit)
        window, item = index.candidates(target, (5, 16))
        assert {(i, i) for i in range(50)} <= set(zip(window.tolist(), item.tolist()))


def test_leaks_in_blocks_and_dropping(spark):
    items = [(i, " ".join(f"q{i}w{j}" for j in range(25))) for i in range(9)]
    rows = [(1, "start " + items[3][1] + " end", "en"), (2, "nothing here", None), (3, None, None), (4, items[8][1], "en"), (4, items[8][1], "en"), (None, items[0][1], "x")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    for block in (4, 100):
        got = decontaminate.find_leaks(docs, bench, **{}) if block == 100 else None
        if got is not None:
            assert sorted((r["doc_id"] or 0, r["item_id"], r["start"]) for r in got.collect()) == [(0, 0, 0), (1, 3, 1), (4, 8, 0), (4, 8, 0)]
        assert sum(len(i.ids) for i in decontaminate.item_blocks(bench, block=block)) == 9
    kept = decontaminate.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and sorted(r["doc_id"] for r in kept.collect()) == [2, 3]
    assert decontaminate.find_leaks(docs, bench.where("false")).count() == 0
    assert decontaminate.drop_leaks(docs.where("false"), bench).count() == 0


# ---- language -------------------------------------------------------------------------


@pytest.mark.parametrize("best", [langid.viterbi, langid.viterbi_blocks])
def test_viterbi_is_optimal(best):
    rng = np.random.default_rng(0)
    for _ in range(40):
        count = rng.integers(0, 7, 5)
        first = np.cumsum(count) - count
        score = rng.normal(size=(count.sum(), 3)) * 3
        path = best(score, first, count, 2.0)
        for f, c in zip(first, count):
            value = lambda p: sum(score[f + i, p[i]] for i in range(c)) - 2.0 * sum(p[i] != p[i + 1] for i in range(c - 1))  # noqa: E731, B023
            if c:
                assert value(path[f : f + c]) == pytest.approx(max(value(p) for p in itertools.product(range(3), repeat=int(c))))


def test_blocks_agree_with_the_plain_form_on_long_texts():
    rng = np.random.default_rng(1)
    count = np.array([1, 16, 17, 400, 0, 33])
    first = np.cumsum(count) - count
    score = rng.normal(size=(count.sum(), 4))
    assert (langid.viterbi(score, first, count, 1.5) == langid.viterbi_blocks(score, first, count, 1.5)).all()


def test_languages_and_spans(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, EN if i % 2 else DE, 40), "en" if i % 2 else "de") for i in range(300)] + [(1000 + i, "Это простой русский текст о домах и реке", "ru") for i in range(8)]
    extra = [(2000, None, "en"), (2001, "12 34 !!", "en"), (2002, "", None), (None, "the and of", None), (2003, prose(rng, EN, 30_000), None), (2004, "русский текст", None)]
    docs = spark.createDataFrame(rows + extra, DOCS)
    model = langid.fit(docs)
    got = {r["doc_id"]: r for r in langid.identify(docs, model).collect()}
    assert all(got[d]["lang_pred"] == "und" and got[d]["score"] == 0 for d in (2000, 2001, 2002))
    assert got[None]["lang_pred"] == "en" and not got[None]["held_out"] and got[2003]["lang_pred"] == "en" and got[2004]["lang_pred"] == "ru"
    held = [(d, lang) for d, _, lang in rows if zlib.crc32(str(d).encode()) % 5 == 0]
    assert all(got[d]["held_out"] for d, _ in held) and np.mean([got[d]["lang_pred"] == lang for d, lang in held]) > 0.97
    mixed = prose(rng, EN, 30) + " " + prose(rng, DE, 30)
    assert [s["lang"] for s in model.spans(mixed)] == ["en", "de"]
    assert langid.span_rows(docs.where("doc_id = 1"), model).count() >= 1
    nothing = docs.where("false")
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert langid.fit(nothing).predict(["the"]) == (["und"], [0.0])


# ---- toxicity -------------------------------------------------------------------------


def toxic_corpus(n=600):
    rng = random.Random(6)
    bad = ["vermin", "brute", "filthy", "vermins", "verminous"]
    rows, labels = [], []
    for i in range(n):
        parts = [prose(rng, EN, rng.randint(5, 12)).rstrip(".") for _ in range(rng.randint(2, 8))]
        if i % 4 == 0:
            k = rng.randrange(len(parts))
            parts[k] += " " + rng.choice(bad) + " " + rng.choice(bad)
        rows.append((i, ". ".join(parts) + ".", "en"))
        labels.append((i, 1, int(i % 4 == 0)))
    return rows, labels


def test_toxic_documents_and_sentences(spark):
    rows, labels = toxic_corpus()
    extra = [(9000, None, None), (9001, "", None), (None, "such vermin and brute", None), (9002, prose(random.Random(1), EN, 40_000), None), (0, rows[0][1], "en")]
    docs, marks = spark.createDataFrame(rows + extra, DOCS), spark.createDataFrame(labels + labels[:5], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = toxicity.score_documents(docs, model).collect()
    assert len(got) == len(rows) + len(extra) and all(0 <= r["score"] <= 1 for r in got)
    by = {r["doc_id"]: r for r in got}
    held = [(d, t) for d, _, t in labels if zlib.crc32(str(d).encode()) % 3 == 1]
    assert np.mean([by[d]["predicted"] == t for d, t in held]) > 0.97
    assert not by[9000]["predicted"] and not by[9001]["predicted"] and not by[9002]["predicted"] and by[None]["predicted"]
    worst = model.worst("The house. You filthy vermin. The river.")
    assert [s for s, _ in worst] == ["You filthy vermin"]
    kept = toxicity.reject_toxic(docs, model)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} == {d for d, r in by.items() if not r["predicted"]}
    again = toxicity.fit(docs.repartition(5), marks)
    assert np.array_equal(model.weights, again.weights)


def test_toxicity_without_labels_or_documents(spark):
    docs, marks = spark.createDataFrame([(1, "a b c", "en")], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    assert toxicity.score_documents(docs, model).first()["predicted"] == 0
    assert toxicity.score_documents(docs.where("false"), model).count() == 0
