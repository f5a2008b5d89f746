"""Main text of pages without article or main: what decides is the minimum cut."""

import itertools
import random

import numpy as np
import pytest

from attestry.llm import extraction
from tests.llm.test_texts import PAGE


def slow_label(model, page):
    """The cut over all edges of a page, no block settled before."""
    cost = model.costs(np.array(extraction.features(page)), page)
    edges = []
    for i in range(len(page) - 1):
        w = model.adjacent / (1 + abs(page[i].depth - page[i + 1].depth))
        edges.append((i, i + 1, w + (model.sibling if page[i].parent == page[i + 1].parent else 0)))
    last = {}
    for i, b in enumerate(page):
        if last.get(b.parent, i) + 1 < i:
            edges.append((last[b.parent], i, model.sibling / 2))
        last[b.parent] = i
    return extraction.minimum_cut(cost, edges)


def test_labels_are_those_of_the_whole_cut():
    rng = np.random.default_rng(3)
    pages = []
    for _ in range(400):
        n = int(rng.integers(1, 12))
        pages.append([
            extraction.Block("x" * int(rng.integers(1, 120)), 0, int(rng.integers(1, 4)), int(rng.integers(1, 6)), str(rng.choice(["p", "div"])), bool(rng.random() < 0.05), bool(rng.random() < 0.05))
            for _ in range(n)
        ])
    for weight in (-0.4, -0.2, 0.1):
        model = extraction.BlockModel(np.array([weight, 0, 0, 0, 0, 0, 0]) * 5)
        for page, got in zip(pages, model.label(pages)):
            assert (got == slow_label(model, page)).all()


def test_proximity_keeps_a_short_paragraph_between_quotes():
    quote = "<blockquote><div>" + "Long quoted prose that is plainly part of the text of this page. " * 3 + "</div></blockquote>"
    page = f"<body><div>{'A first paragraph of the text itself, long enough to be prose. ' * 2}{quote}Short{quote}{'A last paragraph of the text itself, long enough to be prose. ' * 2}</div></body>"
    found = extraction.blocks(page)
    model = extraction.BlockModel(np.zeros(extraction.FEATURES))
    model.costs = lambda x, found: np.array([-1.0 if b.text == "Short" else 3.0 for b in found])  # 1.0 < 0.2 + 0.2 + 0.4 + 0.4
    assert "Short" in [b.text for b in found]
    assert model.label([found])[0].all()


def test_cue_words_in_part_of_a_name_are_outweighed_by_prose():
    body = "<h2>A heading</h2><p>A long paragraph of prose, that tells of one thing and then of another, as texts do.</p><p>Short one.</p><p>Another long paragraph of prose, with marks and words, which ends as the text does, at last.</p>"
    menu = '<div class="sidebar"><ul><li><a href="/">Home</a></li><li><a href="/b">Other</a></li></ul></div><div class="comment-list"><p>' + "A comment of many words, as long as any other prose. " * 6 + "</p></div>"
    model = extraction.train([f"<body><nav><a href='/'>Home</a></nav><main>{body}</main></body>"] * 3)
    for name in ("has-sidebar", "no-sidebar", "with-comments", "content-sidebar-wrap", "post has-comments"):
        text = model.extract([f'<body><div class="{name}">{body}{menu}</div></body>'])[0]
        assert all(x in text for x in ("A long paragraph", "Short one.", "Another long")), name
        assert "comment of" not in text and "Home" not in text
    for name in ("sidebar", "comments", "site-footer", "cookie-notice", "content-sidebar-wrap", "promo-inline"):
        assert model.extract([f'<body><div class="{name}"><p>Buy one now.</p></div></body>']) == [""], name
    for attribute in ('class="comments"', "hidden", 'style="display:none"'):
        assert model.extract([f"<body><div {attribute}>{body}</div></body>"]) == [""]
    assert extraction.cue("nav_menu") == 2 and extraction.cue("x-nav") == 1 and extraction.cue("has-nav wide") == 0
    assert pytest.approx(1 - 84 / 200, abs=0.1) == extraction.blocks('<div class="promo-inline"><p>A paragraph of prose, that tells of one thing and then of another, as texts do.</p>')[0].doubt


LONG = "The river runs past the old mill, and in spring its water reaches the garden wall. "


def whole(body):
    return f"<html><body><header><h1>Site</h1></header><nav><a href='/'>Home</a></nav>{body}<footer><p>Imprint, and so on.</p></footer></body></html>"


@pytest.mark.parametrize(("body", "want"), [
    (f"<main><article><p>{LONG}</p></article><section class='comments'><article><p>I think so too, and I say it at length.</p></article></section></main>", LONG.strip()),
    (f"<article><p>{LONG}</p></article><aside><article><p>Read next: a teaser of some other page, long as a paragraph.</p></article></aside>", LONG.strip()),
    (f"<article><p>{LONG}</p><p class='legal'>The court held, in its first reading, that the mill belongs to the town.</p></article>", LONG.strip() + "\nThe court held, in its first reading, that the mill belongs to the town."),
    (f"<article><p>{LONG}</p><div class='article-share-price'><p>The share price rose by a tenth, to 41 marks, on that day.</p></div></article>", LONG.strip() + "\nThe share price rose by a tenth, to 41 marks, on that day."),
    (f"<article><p>{LONG}</p><p>Here <math><mi>x</mi><mo>=</mo><mn>2</mn></math> holds, as was shown.</p></article>", LONG.strip() + "\nHere x=2 holds, as was shown."),
    (f"<article><p>{LONG}</p><p class='advert'>Buy the new mill today.</p><div class='share'><a href='x'>Share</a></div></article>", LONG.strip()),
    (f"<form id='page'><main><p>{LONG}</p><form><p>Your mail, please, for our letter.</p></form></main></form>", LONG.strip()),
])
def test_pages_with_comments_teasers_and_cue_words(body, want):
    page = whole(body)
    assert extraction.train([PAGE, page] * 3).extract([page]) == [want]


def test_neighbours_decide_where_place_and_text_disagree():
    """The cut keeps a block whose own cost is against it, and drops one whose cost is for it; without edges neither flips."""
    model = extraction.BlockModel(np.zeros(extraction.FEATURES))
    page = "<body>" + f"<p>{LONG}</p>" * 2 + "<p class='post-promo'>Short.</p>" + f"<p>{LONG}</p>" * 2 + "</body>"
    found = extraction.blocks(page)
    cost = model.costs(np.array(extraction.features(found)), found)
    assert cost[2] < 0 < cost[1]
    edges = [(i, i + 1, 1.4) for i in range(4)]
    assert extraction.minimum_cut(np.array([3.0, 3.0, -2.0, 3.0, 3.0]), edges).tolist() == [True] * 5
    weak = np.array([-3.0, -3.0, 1.0, -3.0, -3.0])
    assert not extraction.minimum_cut(weak, edges).any() and extraction.minimum_cut(weak, []).tolist() == [False, False, True, False, False]


def test_labels_of_small_pages_are_the_cheapest_of_all_labellings():
    """The query's labels against every labelling, by the definition of the cut."""
    rng = random.Random(3)
    flipped = 0
    for _ in range(150):
        parts = []
        for _ in range(rng.randint(1, 4)):
            tag = rng.choice(["div", "section", "article", "ul"])
            inner = "".join(rng.choice([f"<p>{LONG[: rng.randint(5, 80)]}</p>", "<p class='x-promo'>Now.</p>", "<li><a href='x'>Go on</a></li>", "<h2>Head</h2>", "<td>cell</td>"]) for _ in range(rng.randint(1, 3)))
            parts.append(f"<{tag}>{inner}</{tag}>")
        found = extraction.blocks("".join(parts))
        if not 0 < len(found) <= 11:
            continue
        weights = np.array([rng.uniform(-1.5, 1.5) for _ in range(extraction.FEATURES)])
        model = extraction.BlockModel(weights)
        cost = model.costs(np.array(extraction.features(found)), found)
        edges = [(i, j, (model.adjacent / (1 + abs(found[i].depth - found[j].depth)) if j == i + 1 else 0.0) + (0.0 if found[i].parent != found[j].parent else model.sibling if j == i + 1 else model.sibling / 2 if not any(found[k].parent == found[i].parent for k in range(i + 1, j)) else 0.0))
                 for i in range(len(found)) for j in range(i + 1, len(found))]
        energy = lambda x: sum(-c for c, v in zip(cost, x) if v) + sum(w for i, j, w in edges if x[i] != x[j])  # noqa: E731, B023
        best = min(energy(x) for x in itertools.product((False, True), repeat=len(found)))
        got = model.label([found])[0]
        assert energy(got.tolist()) == pytest.approx(best)
        flipped += int((got != (cost > 0)).sum())
    assert flipped > 20


TALK = "They met at noon, and the talk went on until the lamps were lit in every street of the town. "
SHAPES = {
    "list": ("<h1>What to pack</h1><ul><li>Bring a warm coat</li><li>Two pairs of boots</li><li>A map</li></ul>", ["What to pack", "Bring a warm coat", "Two pairs of boots", "A map"]),
    "steps": (f"<p>{LONG}</p><ol><li>Peel the apples</li><li>Boil them</li></ol><p>{TALK}</p>", [LONG, "Peel the apples", "Boil them", TALK]),
    "links": (f"<p>{LONG}</p><ul><li><a href='a'>The first source of this text</a></li><li><a href='b'>The second</a></li></ul><p>{TALK}</p>", [LONG, "The first source of this text", "The second", TALK]),
    "table": (f"<p>{LONG}</p><table><tr><td>Mill</td><td>1802</td></tr></table><p>{TALK}</p>", [LONG, "Mill", "1802", TALK]),
    "divs": (f"<h2>The mill</h2><div>{LONG}</div><div>It rained.</div><div>{TALK}</div>", ["The mill", LONG, "It rained.", TALK]),
}


@pytest.fixture(scope="module")
def learned():
    """Trained on pages of one layout, whose only lists are menus."""
    menu = "<nav><ul>" + "".join(f"<li><a href='/{w}'>{w}</a></li>" for w in ("Home", "News", "About")) + "</ul></nav>"
    pages = [f"<body>{menu}<div class='ad'>Buy it now, and save.</div><article><h1>A title of page {i}</h1><p>{LONG * (1 + i % 3)}</p><p>So it is.</p></article><footer>&copy; Site {i}</footer></body>" for i in range(40)]
    return extraction.train(pages)


@pytest.mark.parametrize("shape", sorted(SHAPES))
@pytest.mark.parametrize("holder", ["article", "main", None])
def test_text_of_any_form_stays(learned, shape, holder):
    body, want = SHAPES[shape]
    if holder is None and shape == "links":
        want = [w for w in want if len(w) > 40]  # links without a marked article are taken for a menu
    page = whole(f"<{holder}>{body}</{holder}>" if holder else f"<div>{body}</div>")
    got = learned.extract([page])[0].split("\n")
    assert [w.strip() for w in want] == [g for g in got if holder or shape != "links" or len(g) > 40]


@pytest.mark.parametrize("name", ["comments-wrapper", "comment-thread", "disqus_thread", "user-comments", "reader-comments", "comments-container", "ad-container", "ad-unit-1", "sidebar-left", "sidebar-inner", "related-articles", "cookie-wrapper", "promo-unit"])
@pytest.mark.parametrize("within", [True, False])
def test_long_comments_and_adverts_go(learned, name, within):
    noise = f'<div class="{name}">' + "".join(f"<p>{x} and so would anyone who has been there, I am sure of it, my friends.</p>" for x in ("I think so too,", "I do not,", "Buy one,")) + "</div>"
    body = f"<p>{LONG}</p><p>{TALK}</p>"
    page = whole(f"<article>{body}{noise}</article>" if within else f"<article>{body}</article>{noise}")
    assert learned.extract([page]) == [LONG.strip() + "\n" + TALK.strip()]
    assert "anyone" not in learned.extract([whole(f"<div>{body}</div>{noise}")])[0]
