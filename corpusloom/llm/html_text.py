"""Main text of web pages by minimum-cut labelling.

A page is read into blocks (runs of text between block-level tags). A logistic classifier gives each block the probability that
it is content, from its place in the page, the names of the elements around it, its share of link text, its length and its
punctuation. The negative logarithms of that probability and of its complement are the costs of the two labels, and become capacities to the two
terminals of a network; blocks next to each other, and blocks close in the DOM, are tied by smoothness edges. The minimum cut is the
labelling with the least total cost; what stays on the source's side is content.

The classifier is trained here, in numpy, on pages that practice.py makes up: layouts with known labels. Nothing is read from `pages`.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass, field
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm.common import tune

# Element names of HTML.
BLOCKS = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre search section select summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea iframe svg math object canvas audio video xmp noembed noframes".split())
P_ENDS = frozenset("address article aside blockquote details dialog div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())

#: Elements made for what is no article text.
NEVER = frozenset("head title nav footer aside form menu button select option fieldset legend dialog".split())
#: Elements made for it.
MAIN = frozenset("article main".split())
#: Words in class, id and role that tell what an element holds; a name is cut at - and _ and where a capital follows a small letter.
COMMENT = frozenset("comment comments disqus respond replies reply feedback".split())
BAD = COMMENT | frozenset("ad ads advert advertisement advertising aside bio banner breadcrumb breadcrumbs captcha complementary consent contentinfo cookie cookies copyright disclaimer footer form gdpr login masthead menu meta modal nav navbar navigation newsletter notice notices notification outbrain pager pagination popup promo promotion recommendations recommended related share sharing sidebar signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget search".split())
GOOD = frozenset("article body content entry main post story text".split())
#: Parts of a name that make it tell of a page's state and not of what an element holds.
STATE = frozenset("has with no without open closed enabled disabled left right on off is js".split())
#: Elements that hold all of a page, whatever their class says.
WHOLE = frozenset("html body main".split())
#: Words that boilerplate uses more than articles do.
CUES = re.compile(r"(?i)\b(?:cookies?|copyright|all rights reserved|subscribe|newsletter|sign (?:in|up)|log ?in|privacy policy|terms of (?:use|service)|advertisement|sponsored|read more|share this|follow us|leave a (?:reply|comment))\b|©")

_NAME = re.compile(r"<(?:!--(?:.*?(?:-->|\Z))|!\[CDATA\[(.*?)\]\]>|[!?][^>]*>|(/?)([a-zA-Z][^\s/>]*))", re.S)
_ATTR = re.compile(r"[\s/]*([^\s/>][^\s/>=]*)(\s*=\s*)?")
_BARE = re.compile(r"[^\s>]*")
_WHITE = re.compile(r"\s+")
_HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])|[-_]+")
_UNSEEN = re.compile(r"(?i)(?:^|;)\s*(?:display\s*:\s*none|visibility\s*:\s*hidden)\b")


@dataclass
class Node:
    """An open element. main: how many articles it is in; bad, comment: what names say since the last article began; own_good: a name
    around it that promises text; never, header: elements around it, since the last article began."""

    name: str
    up: Node | None
    depth: int
    main: int = 0
    never: bool = False
    header: bool = False
    bad: bool = False
    comment: bool = False
    good: bool = False


@dataclass
class Block:
    node: Node
    parts: list[str] = field(default_factory=list)
    linked: int = 0
    text: str = ""


def says(name: str, marks: list[str]) -> tuple[bool, bool, bool]:
    """Whether names (classes, id, role) of an element tell of a place without article text, of readers' comments, of article text."""
    bad = comment = good = False
    for mark in marks:
        parts = [p.lower() for p in _HUMP.split(mark) if p]
        if any(p in STATE for p in parts):
            continue
        bad |= any(p in BAD for p in parts)
        comment |= any(p in COMMENT for p in parts)
        good |= any(p in GOOD for p in parts)
    return bad and name not in WHOLE, comment and name not in WHOLE, good


def attributes(html: str, at: int, quotes: dict[str, int]) -> tuple[dict[str, str], int]:
    """The attributes of the tag whose name ends at `at`, and where the tag ends. A quote without an end is a letter like others."""
    found: dict[str, str] = {}
    end = len(html)
    while at < end:
        m = _ATTR.match(html, at)
        if m is None:
            stop = html.find(">", at)
            return found, end if stop < 0 else stop + 1
        at, value = m.end(), ""
        if m[2]:
            q = html[at : at + 1]
            if q in quotes and q and at < quotes[q]:
                stop = html.index(q, at + 1)
                value, at = html[at + 1 : stop], stop + 1
            else:
                b = _BARE.match(html, at)
                value, at = b[0], b.end()
        found.setdefault(m[1].lower(), value)
    return found, end


def _hidden(found: dict[str, str]) -> bool:
    return "hidden" in found or found.get("aria-hidden", "").lower() == "true" or bool("style" in found and _UNSEEN.search(found["style"]))


def blocks(html: str) -> list[Block]:
    """The blocks of a page, in page order, without scripts, styles, comments of the markup and hidden elements."""
    root = Node("#", None, 0)
    node, out, now = root, [], Block(root)
    links, at, end = 0, 0, len(html)
    quotes = {q: html.rfind(q) for q in "\"'"}
    unseen: list[str] | None = None  # elements open in a hidden one, itself first

    def add(raw: str):
        if raw and unseen is None:
            text = unescape(raw) if "&" in raw else raw
            now.parts.append(text)
            if links:
                now.linked += len(text.strip())

    def close():
        nonlocal now
        text = _WHITE.sub(" ", "".join(now.parts)).strip()
        if text:
            now.text = text
            out.append(now)
        now = Block(node)

    while at < end:
        m = _NAME.search(html, at)
        if m is None:
            add(html[at:])
            break
        add(html[at : m.start()])
        at = m.end()
        if m[1]:
            add(m[1])
        if m[3] is None:
            continue
        name = m[3].lower()
        found: dict[str, str] = {}
        if html[at : at + 1] == ">":
            at += 1
        else:
            found, at = attributes(html, at, quotes)
        if unseen is not None:
            if m[2]:
                if name in unseen:
                    while unseen.pop() != name:
                        pass
                    if not unseen:
                        unseen = None
                    continue
                up = node
                while up is not None and up.name != name:
                    up = up.up
                if up is None or name not in BLOCKS:
                    continue
                unseen = None  # an element around the hidden one ends
            elif name in P_ENDS and unseen == ["p"]:
                unseen = None
            else:
                if name in ("script", "style"):
                    stop = re.compile(rf"</{name}\b[^>]*>", re.I).search(html, at)
                    at = stop.end() if stop else end
                elif name not in VOID:
                    unseen.append(name)
                continue
        if m[2]:  # a closing tag
            up = node
            while up is not None and up.name != name:
                up = up.up
            if name in BLOCKS:
                if up is not None and up.up is not None:
                    node = up.up
                close()
                links = 0
            elif name == "a":
                links = max(0, links - 1)
            continue
        if name == "br":
            add(" ")
            continue
        if name in RAW:
            if html[at - 2 : at] == "/>" and name in ("svg", "math"):
                continue
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(html, at)
            at = stop.end() if stop else (end if name in ("script", "style") else at)
            continue
        if name not in VOID and _hidden(found):
            unseen = [name]
            if name in BLOCKS:
                close()
            continue
        if name == "a":
            links += 1
            continue
        if name not in BLOCKS:
            continue
        if name in P_ENDS and node.name == "p":  # an open paragraph ends
            node = node.up
        if name in ("li", "dd", "dt", "td", "th", "tr", "option"):
            same = ("dd", "dt") if name in ("dd", "dt") else ("td", "th") if name in ("td", "th") else (name,)
            if node.name in same or node.name == "p" and node.up.name in same:
                node = (node if node.name in same else node.up).up
        if name not in VOID:
            marks = [x for k in ("class", "id", "role") if k in found for x in found[k].split()]
            bad, comment, good = says(name, marks) if marks else (False, False, False)
            up, main = node, name in MAIN or "article" in marks and name == "div"
            fresh = main and not node.main and not node.comment  # the layout around an article says nothing of it
            node = Node(
                name, up, up.depth + 1, up.main + main, (up.never and not fresh) or name in NEVER, (up.header and not fresh) or name == "header" and not up.main,
                (up.bad and not fresh) or bad, up.comment or comment, up.good or good and not bad,
            )
        close()
    close()
    return out


FEATURES = (
    "one", "length", "long", "short", "linked", "mostly links", "ends a sentence", "commas", "cues in an article", "cues", "heading", "paragraph", "list", "table", "in an article", "outside the page's article",
    "nowhere an article", "bad name", "bad name in an article", "comment", "good name", "never", "never in an article", "header", "first fifth", "last fifth", "before", "after",
)


def features(found: list[Block]) -> np.ndarray:
    """A row of FEATURES for each block of a page."""
    n = len(found)
    size = np.array([len(b.text) for b in found], dtype=float)
    log = np.log1p(size) / 6
    any_main = any(b.node.main for b in found)
    out = np.zeros((n, len(FEATURES)))
    for i, b in enumerate(found):
        t, k = b.text, b.node
        name = k.name
        share = min(1.0, b.linked / size[i])
        out[i] = (
            1, log[i], size[i] > 120, size[i] < 25, share, share > 0.5, t[-1] in ".!?…。:;\"'»”", min(1.0, 40 * t.count(",") / size[i]), (cue := bool(CUES.search(t))) and k.main > 0, cue and not k.main,
            name in ("h1", "h2", "h3", "h4", "h5", "h6"), name in ("p", "pre", "blockquote"), name in ("li", "dt", "dd"), name in ("td", "th", "caption"), k.main > 0, any_main and not k.main,
            not any_main, k.bad and not k.main, k.bad and k.main > 0, k.comment, k.good, k.never and not k.main, k.never and k.main > 0, k.header, i < n / 5, i >= n - n / 5,
            log[i - 1] if i else 0.0, log[i + 1] if i + 1 < n else 0.0,
        )
    return out


@lru_cache(maxsize=1)
def classifier() -> np.ndarray:
    """A weight for each of FEATURES: logistic regression by Newton's method on practice.PAGES made-up pages."""
    from corpusloom.llm import practice

    x, y = [], []
    for html, labels in practice.pages():
        found = blocks(html)
        x.append(features(found))
        y += [labels(b.text) for b in found]
    return logistic(np.vstack(x), np.array(y, dtype=float))


def logistic(x: np.ndarray, y: np.ndarray, shrink: float = 0.5, steps: int = 25) -> np.ndarray:
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + shrink * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + shrink * np.eye(len(w))
        step = np.linalg.solve(curve, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def costs(found: list[Block], weights: np.ndarray) -> tuple[list[float], list[float]]:
    """For each block the costs of calling it content, and of calling it boilerplate."""
    z = np.clip(features(found) @ weights, -30, 30)
    return np.log1p(np.exp(-z)).tolist(), np.log1p(np.exp(z)).tolist()


def distance(a: Node, b: Node) -> int:
    """Steps between two elements of the DOM."""
    n = 0
    while a is not b:
        if a.depth >= b.depth:
            a = a.up
        else:
            b = b.up
        n += 1
    return n


def smoothness(found: list[Block], reach: int = 3) -> list[tuple[int, int, float]]:
    """Edges between blocks up to `reach` apart in page order, the weaker the farther apart they are in page and DOM."""
    out = []
    for i in range(len(found)):
        for j in range(i + 1, min(i + reach, len(found) - 1) + 1):
            d = distance(found[i].node, found[j].node)
            if j == i + 1 or d <= 2:
                out.append((i, j, 1.2 / ((1 + d) * (j - i))))
    return out


def minimum_cut(content: list[float], boiler: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """For each node whether it is on the source's side of a minimum cut (Dinic). Cost: content[i] there, boiler[i] elsewhere,
    and an edge's weight where it is cut."""
    n = len(content)
    source, sink = n, n + 1
    to: list[int] = []
    room: list[float] = []
    out: list[list[int]] = [[] for _ in range(n + 2)]

    def add(a: int, b: int, forth: float, back: float):
        out[a].append(len(to))
        to.append(b)
        room.append(forth)
        out[b].append(len(to))
        to.append(a)
        room.append(back)

    for i in range(n):
        both = min(content[i], boiler[i])  # flows straight through
        if boiler[i] > both:
            add(source, i, boiler[i] - both, 0.0)
        if content[i] > both:
            add(i, sink, content[i] - both, 0.0)
    for a, b, w in edges:
        add(a, b, w, w)
    while True:
        level = [-1] * (n + 2)
        level[source] = 0
        queue = deque([source])
        while queue:
            a = queue.popleft()
            for e in out[a]:
                if room[e] > 1e-9 and level[to[e]] < 0:
                    level[to[e]] = level[a] + 1
                    queue.append(to[e])
        if level[sink] < 0:
            return [level[i] >= 0 for i in range(n)]
        tried = [0] * (n + 2)
        path: list[int] = []
        at = source
        while True:
            if at == sink:
                flow = min(room[e] for e in path)
                for e in path:
                    room[e] -= flow
                    room[e ^ 1] += flow
                k = next(k for k, e in enumerate(path) if room[e] <= 1e-9)
                at = to[path[k] ^ 1]
                del path[k:]
                continue
            while tried[at] < len(out[at]):
                e = out[at][tried[at]]
                if room[e] > 1e-9 and level[to[e]] == level[at] + 1:
                    break
                tried[at] += 1
            if tried[at] < len(out[at]):
                path.append(e)
                at = to[e]
            elif path:
                level[at] = -1
                at = to[path.pop() ^ 1]
                tried[at] += 1
            else:
                break


def main_text(html: str | None, weights: np.ndarray | None = None) -> str:
    """The text of the blocks that the cut labels as content, joined by spaces. Null or empty: empty."""
    found = blocks(html) if html else []
    if not found:
        return ""
    content, boiler = costs(found, classifier() if weights is None else weights)
    keep = minimum_cut(content, boiler, smoothness(found))
    return " ".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, carry: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns of `carry`, text and n_chars (its code points), one row for each row of pages.

    The whole html is read; a null or empty one, or one without content, gives an empty text. Repeated rows are read one by one;
    other columns are not. The classifier is trained on the driver, some 27 numbers, and goes with the tasks. No shuffle.
    """
    tune(pages.sparkSession)
    rows = pages.select(*dict.fromkeys((*carry, "html")))
    kinds = dict(rows.dtypes)
    weights = classifier()

    def go(batches):
        for b in batches:
            texts = [main_text(h, weights) for h in b.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in carry), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*carry, "text", "n_chars"])

    return rows.mapInArrow(go, ", ".join([*(f"`{c}` {kinds[c]}" for c in carry), "text string, n_chars long"]))
