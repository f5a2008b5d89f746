"""Main text of HTML pages by minimum-cut labelling of their blocks."""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, sample_rows

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(script|style|template|textarea|title|svg|iframe|select)\b(?:[^>\"']|\"[^\"]*\"|'[^']*')*+(?:>.*?(?:</\1\s*[^>]*>|\Z)|\Z)"
    r"|<(/?)([a-z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(/?)([a-z][^\s/>]*)([^>]*)(?:>|\Z)"
    r"|<[!?/][^>]*(?:>|\Z)",
    re.S | re.I,
)
#: Elements that part blocks.
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_OFF = frozenset("nav footer aside button menu dialog head label fieldset".split())
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|style|aria-hidden)\b\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
_CUE = re.compile(
    r"(?<![a-z])(?:ads?|adverts?|advertisements?|advertising|adslot|adbox|banner|promo|promotions?|sponsor(?:ed)?|cookies?|consent|gdpr|notices?|alerts?|popup|modal|overlay|"
    r"newsletter|subscribe|subscription|nav|navbar|navigation|menus?|breadcrumbs?|sidebar|side|aside|widgets?|related|recommended|share|sharing|social|comments?|replies|reply|respond|disqus|"
    r"footer|foot|header|masthead|topbar|copyright|legal|login|signin|signup|search|form|pagination|pager|toolbar|contentinfo|complementary|dialog)(?![a-z])",
    re.I,
)
#: Words beside a cue that leave its sense, and first words that tell of the page and not of the element.
_FORM = frozenset(
    "list lists area item items link links box bar block section site page post posts text container containers wrapper holder unit slot zone thread threads "
    "left right inner outer top bottom reader readers user users visitor visitors article articles".split()
)
_STATE = frozenset("has have no not with without show hide enable enabled disable disabled supports".split())
#: Characters of prose that outweigh a cue word in part of a class name.
_OUTWEIGHED = 200
#: Cue words that prose elements carry for what they say and not for what they are.
_MILD = frozenset("legal copyright side share sharing related search alert alerts foot header form".split())
_PROSE = frozenset("p li dd dt td blockquote pre figcaption h2 h3 h4 h5 h6".split())
_LETTERS = re.compile(r"[a-z]+", re.I)
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_MARKS = re.compile(r"[.,;:!?]")
_KEEP = frozenset(("html", "body", "article", "main"))

FEATURES = 7


@dataclass
class Block:
    text: str
    links: int  # characters inside links
    parent: int  # number of the element that holds it
    depth: int
    tag: str
    inside: bool  # an article or main element holds it
    off: int  # what holds it: 0 none of these, 1 a form, 2 an element whose class is a cue, 3 a menu, header, footer, hidden element, ...
    doubt: float = 0.0  # how far a class name that is a cue in part tells against it: 0 not at all, 1 most
    plain: float = 0.0  # where no article is marked: how far the text beside it is prose and no links, from -1 to 1

    @property
    def prose(self) -> bool:
        return len(self.text) >= 40 and 3 * self.links < len(self.text)


def cue(names: str) -> int:
    """What the names of a class, id or role say of an element: 2 one is a cue as a whole, 1 in part, 0 none is."""
    found = 0
    for name in names.split():
        if _CUE.search(name):
            words = _LETTERS.findall(name.lower())
            if words[0] in _STATE:
                continue
            if all(w in _FORM or _CUE.fullmatch(w) for w in words):
                return 2
            found = 1
    return found


def blocks(html: str | None) -> list[Block]:
    """Blocks of a page in order, white space collapsed, character references decoded; blank ones left out."""
    out: list[Block] = []
    if not html:
        return out
    stack: list[tuple[str, int, bool, int, bool, tuple]] = [("", 0, False, 0, False, ())]  # tag, number, inside, off, link, holders that a cue in part names
    held: list[tuple] = []
    number, pieces, linked, at = 0, [], 0, 0

    def close() -> None:
        nonlocal linked
        text = "".join(pieces)
        if "&" in text:
            text = unescape(text)
        text = " ".join(text.split())
        if text:
            holder = next((s for s in reversed(stack) if s[0] in _BLOCK or not s[0]), stack[0])
            up = next((s for s in reversed(stack[: stack.index(holder)]) if s[0] in _BLOCK or not s[0]), stack[0])
            out.append(Block(text, min(linked, len(text)), up[1], len(stack), holder[0], holder[2], holder[3]))
            held.append(holder[5])
        pieces.clear()
        linked = 0

    for m in _TOKEN.finditer(html):
        if m.start() > at:
            piece = html[at : m.start()]
            pieces.append(piece)
            if stack[-1][4]:
                linked += len(piece)
        at = m.end()
        tag = m[3] or m[6]
        if not tag:
            if m[1] and m[1].lower() in _BLOCK:
                close()
            continue
        tag = tag.lower()
        if m[2] or m[5]:
            if tag in _BLOCK:
                close()
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag not in _BLOCK and stack[k][0] in _BLOCK:
                    break  # an inline end doesn't close a block
            continue
        if tag == "br":
            pieces.append(" ")
            continue
        if tag in _BLOCK:
            close()
            ends = ("p", tag) if tag in ("li", "dt", "dd", "tr", "td", "th", "option") else ("p",)
            for k in range(len(stack) - 1, 0, -1):  # an open paragraph or item ends here
                if stack[k][0] in ends:
                    del stack[k:]
                    break
                if stack[k][0] in _BLOCK:
                    break
        if tag in _VOID:
            continue
        attributes = (m[4] if m[3] else m[7]) or ""
        _, _, inside, off, link, doubted = stack[-1]
        if tag in ("article", "main"):
            if not inside:  # a form or a class may be that of a wrapper around the page; an article in a sidebar is a teaser
                off = 0 if off <= (2 if tag == "main" else 1) else off
                doubted = ()
            inside = True
        elif tag in _OFF or (tag == "header" and not inside):
            off = 3
        elif tag == "form":
            off = max(off, 2 if inside else 1)
        if attributes and off < 3:
            for a in _ATTRIBUTE.finditer(attributes):
                name, value = a[1].lower(), (a[2] or "").strip("\"'")
                if name == "hidden" or (name == "aria-hidden" and value.lower() == "true") or (name == "style" and _HIDDEN.search(value)):
                    off = 3
                elif name in ("class", "id", "role") and tag not in _KEEP and (said := cue(value)):
                    mild = inside and tag in _PROSE and all(w in _MILD or not _CUE.fullmatch(w) for w in _LETTERS.findall(value.lower()))
                    if said == 2 and not mild:
                        off = max(off, 2)
                    doubted = (*doubted, number + 1)
        if attributes.endswith("/") and tag not in _BLOCK:
            continue
        number += 1
        stack.append((tag, number, inside, off, link or tag == "a", doubted))
    if at < len(html):
        pieces.append(html[at:])
        if stack[-1][4]:
            linked += len(html) - at
    close()
    prose: dict[int, int] = {}
    for b, holders in zip(out, held):
        for h in set(holders) if b.prose and not b.off else ():
            prose[h] = prose.get(h, 0) + len(b.text)
    for b, holders in zip(out, held):
        b.doubt = max(0.0, *(1 - prose.get(h, 0) / _OUTWEIGHED for h in holders)) if holders else 0.0
    if not any(b.inside for b in out):
        total: dict[int, list[int]] = {}
        for b in out:
            if not b.off:
                said = total.setdefault(b.parent, [0, 0])
                said[0] += len(b.text)
                said[1] += b.links
        for b in out:
            if not b.off:
                b.plain = 1 - 2 * total[b.parent][1] / total[b.parent][0]
    return out


def features(found: list[Block]) -> list[list[float]]:
    """Text statistics of each block, without its place in the tree."""
    rows = []
    for b in found:
        n = len(b.text)
        words = b.text.count(" ") + 1
        marks = len(_MARKS.findall(b.text))
        rows.append([
            1.0, np.log1p(n), b.links / n, marks / words, min(n / words, 20.0) / 10, float(b.text[-1] in ".!?"), float("©" in b.text or "|" in b.text),
        ])
    return rows


@dataclass
class BlockModel:
    """A trained classifier of block text, the evidence of a block's place, and the strength of edges.

    An article that is marked weighs more than text, so nothing in it is lost for its form:
    lists, tables and links stay. Where none is marked, text, what stands beside a block and
    its edges weigh about alike, so that its neighbours decide; only elements that are never
    part of an article weigh more.
    """

    weights: np.ndarray
    trust: float = 2.0
    inside: float = 2.5
    prose: float = 1.0
    plain: float = 1.5
    form: float = -2.5
    cue: float = -6.0
    never: float = -9.0
    doubt: float = -3.0
    adjacent: float = 0.6
    sibling: float = 0.8

    def costs(self, x: np.ndarray, found: list[Block]) -> np.ndarray:
        """Log odds of content: the classifier's, within trust, and the evidence of the tree."""
        text = np.clip(x @ self.weights, -self.trust, self.trust)
        off = np.array([b.off for b in found], dtype=int)
        place = np.array([self.inside * b.inside + self.prose * b.prose + self.plain * b.plain * (1 - b.doubt) for b in found])
        return text + np.where(off, np.array([0.0, self.form, self.cue, self.never])[off], place + self.doubt * np.array([b.doubt for b in found]))

    def label(self, pages: list[list[Block]]) -> list[np.ndarray]:
        """Which blocks of each page are content: the minimum cut between the two labels."""
        flat = [b for page in pages for b in page]
        if not flat:
            return [np.zeros(0, dtype=bool) for _ in pages]
        x = np.array([r for page in pages for r in features(page)])
        cost = self.costs(x, flat)
        size = np.array([len(p) for p in pages])
        first = np.cumsum(size) - size
        page = np.repeat(np.arange(len(pages)), size)
        parent = np.array([b.parent for b in flat])
        depth = np.array([b.depth for b in flat])
        link = np.zeros(len(flat))  # smoothness between a block and the next one
        same = page[1:] == page[:-1]
        near = (parent[1:] == parent[:-1]) & same
        link[:-1] = np.where(same, self.adjacent / (1 + np.abs(depth[1:] - depth[:-1])), 0) + np.where(near, self.sibling, 0)
        back = np.concatenate(([0.0], link[:-1]))
        order = np.lexsort((parent, page))  # proximity in the tree: blocks of one parent that others part
        one, two = order[:-1], order[1:]
        apart = (page[one] == page[two]) & (parent[one] == parent[two]) & (two > one + 1)
        one, two = one[apart], two[apart]
        edge = np.searchsorted(page[one], np.arange(len(pages) + 1))
        proximity = np.bincount(np.append(one, two), minlength=len(flat)) * (self.sibling / 2)
        content = cost > 0
        sure = np.abs(cost) > link + back + proximity  # outweighs all its edges: the cut can't have it otherwise
        for p in np.unique(page[~sure]):
            a, b = first[p], first[p] + size[p]
            edges = [(i, i + 1, float(link[a + i])) for i in range(size[p] - 1) if link[a + i] > 0]
            own = slice(edge[p], edge[p + 1])
            edges += [(i, k, self.sibling / 2) for i, k in zip((one[own] - a).tolist(), (two[own] - a).tolist())]
            content[a:b] = minimum_cut(cost[a:b], edges)
        return [content[a : a + n] for a, n in zip(first, size)]

    def extract(self, pages: list[str | None]) -> list[str]:
        found = [blocks(h) for h in pages]
        return ["\n".join(b.text for b, keep in zip(page, kept) if keep) for page, kept in zip(found, self.label(found))]


def minimum_cut(cost: np.ndarray, edges: list[tuple[int, int, float]]) -> np.ndarray:
    """Nodes on the source's side of a minimum cut.

    Terminal capacities are the positive and negative costs. Nodes whose cost outweighs
    their edges are settled first and pass their edges on as capacities; flow is pushed
    along shortest paths (Edmonds-Karp) through the rest.
    """
    n = len(cost)
    cost = cost.astype(float).copy()
    around: list[list[tuple[int, float]]] = [[] for _ in range(n)]
    for a, b, w in edges:
        around[a].append((b, w))
        around[b].append((a, w))
    side = np.zeros(n, dtype=np.int8)  # 1 content, -1 not, 0 open
    todo = deque(range(n))
    while todo:
        i = todo.popleft()
        if side[i]:
            continue
        room = sum(w for j, w in around[i] if not side[j])
        if abs(cost[i]) > room:
            side[i] = 1 if cost[i] > 0 else -1
            for j, w in around[i]:
                if not side[j]:
                    cost[j] += w * side[i]
                    todo.append(j)
    open_nodes = [i for i in range(n) if not side[i]]
    if open_nodes:
        s, t = n, n + 1
        room: list[dict[int, float]] = [{} for _ in range(n + 2)]
        for i in open_nodes:
            if cost[i] > 0:
                room[s][i], room[i][s] = cost[i], 0.0
            elif cost[i] < 0:
                room[i][t], room[t][i] = -cost[i], 0.0
            for j, w in around[i]:
                if not side[j]:
                    room[i][j] = room[i].get(j, 0.0) + w
        while True:
            came = {s: s}
            queue = deque([s])
            while queue and t not in came:
                u = queue.popleft()
                for v, c in room[u].items():
                    if c > 1e-12 and v not in came:
                        came[v] = u
                        queue.append(v)
            if t not in came:
                break
            push, v = np.inf, t
            while v != s:
                push, v = min(push, room[came[v]][v]), came[v]
            v = t
            while v != s:
                u = came[v]
                room[u][v] -= push
                room[v][u] = room[v].get(u, 0.0) + push
                v = u
        for i in open_nodes:
            side[i] = 1 if i in came else -1
    return side > 0


def train(pages: list[str | None], rounds: int = 30) -> BlockModel:
    """Logistic regression of block statistics on what the tree says plainly: blocks in an
    article or main element against blocks of menus, footers and the like."""
    found = [b for h in pages for b in blocks(h)]
    sure = [b for b in found if b.off or (b.inside and not b.doubt)]
    y = np.array([0.0 if b.off else 1.0 for b in sure])
    weights = np.zeros(FEATURES)
    if 0 < y.sum() < len(y):
        x = np.array(features(sure))
        share = np.where(y > 0, 0.5 / y.sum(), 0.5 / (1 - y).sum())
        for _ in range(rounds):
            p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
            h = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + 1e-3 * np.eye(FEATURES)
            step = np.linalg.solve(h, x.T @ (share * (y - p)) - 1e-3 * weights)
            weights = weights + step
            if np.abs(step).max() < 1e-6:
                break
    return BlockModel(weights)


def fit(pages: DataFrame, most: int = 300, id_col: str = "page_id", html_col: str = "html") -> BlockModel:
    """Fit on most pages and 96 MB (documented bounds), those with the smallest md5 of their ids; an id with several pages counts by one of them."""
    ids = pages.select(F.col(id_col).alias("__id")).where("__id is not null").distinct()
    picked = ids.orderBy(F.md5(F.col("__id").cast("string").cast("binary")), "__id").limit(most)
    return train(sample_rows(pages, picked, id_col, html_col)["__text"].tolist())


def text_column(html: Column, model: BlockModel) -> Column:
    @F.arrow_udf("string")
    def main_text(values: pa.Array) -> pa.Array:
        return pa.array(model.extract(values.to_pylist()), pa.string())

    return main_text(html)


def extract(pages: DataFrame, model: BlockModel, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars (code points).

    A null or empty page, or one without content blocks, has an empty text. Rows that
    repeat an id keep a row each. An empty table gives an empty result; other columns are ignored.
    """
    bound_batches(pages.sparkSession)
    out = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), text_column(F.col(html_col), model).alias("text"))
    return out.withColumn("n_chars", F.char_length("text").cast("long"))
