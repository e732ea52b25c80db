"""Main text of web pages by minimum-cut labelling.

A page is cut into blocks of text at its block-level tags. A linear classifier over the shape of
a block (length, end, links, tag, depth, the share of the page its parent holds, the length of its
neighbours) gives log-odds of content; what tags, roles and class names around it say is added.
The cost of each label becomes the capacity of the block's edge to a terminal. Neighbours, the
blocks of one parent and, less, of one grandparent are joined by smoothness edges, wherever they
lie in the page. The minimum cut (maximum flow) between the terminals labels each block as content
or boilerplate with the least sum of costs. Pages are independent, so this runs where they are
scanned.

The classifier and the smoothness weights are fitted on a bounded sample (``FIT_PAGES`` pages, at
most ``FIT_BLOCKS`` blocks of each): blocks that tags and names speak for clearly are its labelled
rows, and the fit sees only their shape. With fewer than ``FIT_LEAST`` rows of a class the default
model, fitted in the same way, is taken.
"""

from __future__ import annotations

import html
import math
import re
from collections import deque
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

_BLOCK = frozenset("address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 head header hgroup hr html "
                   "legend li main menu nav ol optgroup option p pre search section select summary table tbody td textarea tfoot th thead title tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no markup; they are skipped up to their end tag.
_RAW = frozenset("script style noscript template iframe noframes noembed xmp svg math object canvas audio video textarea title".split())
#: An element that ends when one of these begins (within the nearest enclosing list or table).
_ENDED_BY = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option", "optgroup"}}
_SCOPE = frozenset("ul ol dl menu table select body html".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_TAG_END = re.compile(r"""(?:[^>"']|"[^"]*"|'[^']*')*+>""")
_ATTR = re.compile(r"""([^\s=/>"']+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]*))?""")
_WORD = re.compile(r"[a-z]+|\d+")

#: Score of an element's tag for the text inside it; positive is content.
TAG_SCORE = {"article": 3.0, "main": 2.5, "nav": -8.0, "footer": -8.0, "aside": -8.0, "form": -8.0, "header": -6.0, "menu": -8.0, "button": -8.0, "select": -8.0, "dialog": -8.0, "fieldset": -4.0, "label": -2.0, "search": -8.0,
             "h1": 1.0, "p": 0.5, "pre": 0.5, "blockquote": 0.5}
ROLE_SCORE = {"main": 2.5, "article": 3.0, "navigation": -8.0, "banner": -6.0, "contentinfo": -8.0, "complementary": -8.0, "search": -8.0, "dialog": -8.0, "alertdialog": -8.0, "alert": -8.0, "menu": -8.0, "menubar": -8.0, "form": -8.0}
#: Scores of the words of class and id values.
NAME_SCORE = dict.fromkeys("article content entry post story main body text maintext prose".split(), 1.0) | dict.fromkeys(
    "ad ads adv advert advertisement adverts banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies copyright disclaimer disqus footer gdpr login masthead menu modal nav navbar navigation navi "
    "newsletter notice notices overlay pager pagination popup promo promoted recommended related replies reply respond rss share sharing sidebar sidenav signup skyscraper social sponsor sponsored subscribe subscription tags teaser "
    "toolbar topbar widget widgets".split(), -8.0)
HIDDEN_SCORE = -8.0
#: Bounds of the fit: pages (expected), blocks of a page, least labelled blocks of a class.
FIT_PAGES, FIT_BLOCKS, FIT_LEAST = 500, 200, 50
#: Largest log-odds of the shape, share taken of what tags and names say, largest smoothness.
SHAPE_LIMIT, NAMED_FOR, NAMED_AGAINST, SMOOTH_LIMIT = 3.0, 2.5, 0.6, 1.5


@dataclass(frozen=True)
class Model:
    """Weights of ``FEATURES`` and of the kinds of smoothness edges (see ``edges_of``)."""
    shape: tuple[float, ...]
    smooth: tuple[float, float, float, float]


FEATURES = ("one", "length", "sentence", "links", "heading", "item", "paragraph", "depth", "share", "around")


class Node:
    __slots__ = ("tag", "score", "parent", "box", "depth")

    def __init__(self, tag: str, score: float, parent: Node | None):
        self.tag, self.score, self.parent = tag, score, parent
        #: The block-level element (or the root) around it.
        self.box = parent if not parent or not parent.parent or parent.tag in _BLOCK else parent.box
        self.depth = parent.depth + 1 if parent else 0


class Block:
    __slots__ = ("pieces", "links", "node")

    def __init__(self, node: Node):
        self.pieces: list[str] = []
        self.links, self.node = 0, node


def own_score(tag: str, attrs: str) -> float:
    """What an element's tag, role, class, id and visibility say about its text."""
    score = TAG_SCORE.get(tag, 0.0)
    if attrs and ("=" in attrs or "hidden" in attrs):
        named = 0.0
        for name, value in _ATTR.findall(attrs):
            name, value = name.lower(), value.strip("\"'").lower()
            if name in ("class", "id"):
                found = [NAME_SCORE.get(w, 0.0) for w in _WORD.findall(value)]
                named = min([named, *found]) if min([0.0, *found]) < 0 else max([named, *found])
            elif name == "role":
                score += ROLE_SCORE.get(value, 0.0)
            elif name == "hidden" or name == "aria-hidden" and value == "true" or name == "style" and "display:none" in value.replace(" ", ""):
                score += HIDDEN_SCORE
        # body and html often carry the site's whole list of class names
        score += named if tag not in ("body", "html") else 0.0
    return score


def blocks_of(page: str) -> list[Block]:
    """The text blocks of a page in order, each with its element and its characters in links."""
    root = node = Node("", 0.0, None)
    block, out, links, i, n = Block(root), [], 0, 0, len(page)

    def text(s: str) -> None:
        if s:
            block.pieces.append(s)
            if links:
                block.links += len(s.strip())

    def cut() -> None:
        nonlocal block
        if block.pieces:
            out.append(block)
        block = Block(node)

    while i < n:
        j = page.find("<", i)
        if j < 0:
            text(page[i:])
            break
        text(page[i:j])
        if page.startswith("<!--", j):
            short = next((e for e in (">", "->") if page.startswith(e, j + 4)), None)  # closed as soon as it is opened
            ends = [(k, k + len(e)) for e in ("-->", "--!>") if (k := page.find(e, j + 4)) >= 0]
            i = j + 4 + len(short) if short else min(ends, default=(n, n))[1]
            continue
        nxt = page[j + 1:j + 2]
        if nxt in ("!", "?"):
            k = page.find(">", j)
            i = n if k < 0 else k + 1
            continue
        closing = nxt == "/"
        m = _NAME.match(page, j + 1 + closing)
        if not m:
            if closing:
                k = page.find(">", j)
                i = n if k < 0 else k + 1
            else:
                text("<")
                i = j + 1
            continue
        tag = m[0].lower()
        end = _TAG_END.match(page, m.end())
        k = end.end() if end else page.find(">", m.end()) + 1
        if not k:
            break
        i = k
        if closing:
            if tag == "br":
                text(" ")
                continue
            up = node
            while up.parent and up.tag != tag:
                up = up.parent
            if not up.parent:
                if tag in _BLOCK:
                    cut()
                continue
            if tag not in _BLOCK and any_block(node, up):
                # an inline element closed outside the block it was opened in ends nothing
                links -= tag == "a" and links > 0
                continue
            at = node
            while at is not up.parent:
                links -= at.tag == "a" and links > 0
                at = at.parent
            node = up.parent
            if tag in _BLOCK:
                cut()
            continue
        attrs = page[m.end():k - 1]
        if tag in _RAW:
            e = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, k)
            if not e:
                if not attrs.endswith("/"):
                    break
            else:
                close = page.find(">", e.end())
                i = n if close < 0 else close + 1
            text(" ")
            continue
        if tag in _VOID:
            if tag in _BLOCK:
                cut()
            elif tag in ("br", "img", "input", "wbr"):
                text("" if tag == "wbr" else " ")
            continue
        if tag in _BLOCK:
            # a paragraph ends where a block begins, an item where the next one does
            at = node
            while at.parent and at.tag not in _BLOCK:
                at = at.parent
            if at.tag == "p":
                node = at.parent
            at = node
            while at.parent and at.tag not in _SCOPE:
                if tag in _ENDED_BY.get(at.tag, ()):
                    node = at.parent
                    break
                at = at.parent
            links = 0
            node = Node(tag, own_score(tag, attrs), node)
            cut()
        else:
            links += tag == "a"
            node = Node(tag, own_score(tag, attrs), node)
    if block.pieces:
        out.append(block)
    return out


def any_block(node: Node, up: Node) -> bool:
    while node is not up:
        if node.tag in _BLOCK:
            return True
        node = node.parent
    return False


def named_score(node: Node) -> tuple[float, float]:
    """What the element and those around it say for content, if nothing there speaks against it,
    and what they say against it."""
    good, bad, at = 0.0, 0.0, node
    while at:
        if at.score < 0:
            bad = min(bad, at.score)
        else:
            good += at.score
        at = at.parent
    return 0.0 if bad else min(good, NAMED_FOR), bad * NAMED_AGAINST


def page_blocks(page: str) -> list[tuple[str, Node, int]]:
    """(text, element, characters in links) of the blocks that hold text."""
    kept = []
    for b in blocks_of(page):
        s = "".join(b.pieces)
        s = " ".join((html.unescape(s) if "&" in s else s).split())
        if s:
            kept.append((s, b.node, b.links))
    return kept


def features_of(blocks: list[tuple[str, Node, int]]) -> list[tuple[float, ...]]:
    """The shape of each block, in the order of ``FEATURES``, from 0 to 1 each."""
    words = [s.count(" ") + 1 for s, _, _ in blocks]
    held: dict[int, int] = {}
    for (_, node, _), w in zip(blocks, words):
        held[id(node.box)] = held.get(id(node.box), 0) + w
    total = sum(words)
    length = [min(7.0, math.log2(w)) / 7 for w in words]
    out = []
    for i, (s, node, links) in enumerate(blocks):
        tag = node.tag
        near = length[max(0, i - 1):i] + length[i + 1:i + 2]
        out.append((1.0, length[i], float(s[-1] in ".!?…。»”\"'"), min(1.0, links / len(s)), float(tag in _HEADINGS), float(tag in _ITEMS), float(tag in _PARAGRAPHS),
                    min(node.depth, 20) / 20, held[id(node.box)] / total, sum(near) / len(near) if near else 0.0))
    return out


_HEADINGS, _ITEMS, _PARAGRAPHS = frozenset("h1 h2 h3 h4 h5 h6".split()), frozenset("li dt dd td th option".split()), frozenset("p pre blockquote".split())


def edges_of(nodes: list[Node]) -> list[tuple[int, int, int]]:
    """(earlier block, block, kind) of the blocks that are near in the page or its tree.

    Each block is joined to the one before it, to the last one of the same parent and to the last
    one of the same grandparent. Kinds: 0 unrelated neighbours; 1 same parent and alike (tag and
    what the element says); 2 same parent, not alike; 3 same grandparent, or one around the other.
    An element whose own tag or name speaks against it is of kind 0 to one where none does.
    """
    def kind(a: Node, b: Node) -> int:
        if (a.score < 0) != (b.score < 0):
            return 0
        if a is b or a.box is b.box:
            return 1 if a.tag == b.tag and a.score == b.score else 2
        up = b.box.box if b.box else None
        return 3 if b.box is a or a.box is b or up and a.box and a.box.box is up else 0
    out, child, grandchild = [], {}, {}
    for i, node in enumerate(nodes):
        up = node.box
        above = up.box if up else None
        joined = {i - 1, child.get(id(up), -1) if up else -1, grandchild.get(id(above), -1) if above else -1}
        out += [(j, i, kind(nodes[j], node)) for j in joined if j >= 0]
        child[id(up)] = i
        grandchild[id(above)] = i
    return out


def min_cut(gain: list[float], edges: list[tuple[int, int, float]]) -> list[bool]:
    """Labels (True: source side) that minimise the sum of |gain| of the blocks labelled
    against the sign of their gain plus the weights of the edges between unequal labels.

    Maximum preflow: blocks with positive gain start with that much flow, the others can let
    as much out. Blocks hand flow on towards the nearest outlet by their distance to it; all
    distances are found anew after about as many steps as there are edges, so that flow shut
    in behind full edges rests. What cannot reach an outlet in the end is the source side.
    """
    n, scale = len(gain), 1000
    flow = [max(0, round(g * scale)) for g in gain]
    outlet = [max(0, round(-g * scale)) for g in gain]
    near: list[list[int]] = [[] for _ in range(n)]
    head: list[int] = []
    room: list[int] = []
    for a, b, w in edges:
        if a != b and (c := round(w * scale)) > 0:
            near[a].append(len(head))
            near[b].append(len(head) + 1)
            head += (b, a)
            room += (c, c)
    for i in range(n):  # what a block itself lets out needs no way
        c = min(flow[i], outlet[i])
        flow[i] -= c
        outlet[i] -= c
    never = n + 1
    while True:
        far = [never] * n
        reached = [i for i in range(n) if outlet[i]]
        for i in reached:
            far[i] = 1
        for i in reached:  # grows while it is walked
            step = far[i] + 1
            for e in near[i]:
                j = head[e]
                if far[j] == never and room[e ^ 1]:
                    far[j] = step
                    reached.append(j)
        waiting = deque(i for i in range(n) if flow[i] and far[i] < never)
        if not waiting:
            return [d == never for d in far]
        steps = 4 * len(reached) + 100
        while waiting and steps > 0:
            i = waiting.popleft()
            have = flow[i]
            while have:
                if outlet[i]:
                    c = min(have, outlet[i])
                    outlet[i] -= c
                    have -= c
                    continue
                low = never
                for e in near[i]:
                    if room[e]:
                        j = head[e]
                        if far[j] == far[i] - 1:
                            c = have if have < room[e] else room[e]
                            room[e] -= c
                            room[e ^ 1] += c
                            if not flow[j]:
                                waiting.append(j)
                            flow[j] += c
                            have -= c
                            if not have:
                                break
                        if room[e] and far[j] < low:
                            low = far[j]
                steps -= len(near[i])
                if have:
                    far[i] = low + 1
                    if low + 1 >= never:
                        far[i] = never
                        break
            flow[i] = have


def judge(page: str, model: Model) -> list[tuple[str, float, bool]]:
    """(text, log-odds of content without its surroundings, label by the minimum cut) by block."""
    blocks = page_blocks(page)
    gain = []
    for (_, node, _), x in zip(blocks, features_of(blocks)):
        shape = sum(w * v for w, v in zip(model.shape, x))
        gain.append(max(-SHAPE_LIMIT, min(SHAPE_LIMIT, shape)) + sum(named_score(node)))
    label = min_cut(gain, [(a, b, model.smooth[k]) for a, b, k in edges_of([node for _, node, _ in blocks])])
    return [(s, g, good) for (s, _, _), g, good in zip(blocks, gain, label)]


def main_text(page: str | None, model: Model | None = None) -> str:
    """The page's article: its content blocks, one a line; empty if there is none."""
    return "\n".join(s for s, _, good in judge(page, model or DEFAULT) if good) if page else ""


def labelled_rows(page: str) -> tuple[list[list[float]], list[int]]:
    """Rows of the fit: features and label of the blocks that tags and names speak for clearly, at
    most ``FIT_BLOCKS``, evenly spaced; and 8 counts of joined pairs: equal and unequal by kind."""
    blocks = page_blocks(page)
    label = []
    for _, node, _ in blocks:
        good, bad = named_score(node)
        label.append(0 if bad < -2 else 1 if good >= 2 and not bad else -1)
    pairs = [0] * 8
    for a, b, k in edges_of([node for _, node, _ in blocks]):
        if label[a] >= 0 and label[b] >= 0:
            pairs[2 * k + (label[a] != label[b])] += 1
    rows = [[*x, float(y)] for x, y in zip(features_of(blocks), label) if y >= 0]
    return rows[::max(1, -(-len(rows) // FIT_BLOCKS))], pairs


def fit_model(rows: np.ndarray, pairs: np.ndarray) -> Model | None:
    """Ridge logistic regression by Newton steps, both classes of equal weight; smoothness from how
    often joined blocks agree (a tenth more pairs of each sort are assumed, so none is certain, and
    four more of which three agree)."""
    if not len(rows):
        return None
    x, y = rows[:, :-1], rows[:, -1]
    count = np.array([(y == 0).sum(), (y == 1).sum()])
    if count.min() < FIT_LEAST:
        return None
    weight = (1 / count)[y.astype(int)] / 2
    w, ridge = np.zeros(x.shape[1]), 1e-3 * np.eye(x.shape[1])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + ridge, x.T @ (weight * (y - p)) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-9:
            break
    pairs = pairs.reshape(4, 2) + pairs.reshape(4, 2).sum(axis=1, keepdims=True) / 10 + (3, 1)
    smooth = np.clip(np.log(pairs[:, 0] / pairs[:, 1]) / 2, 0.0, SMOOTH_LIMIT)
    return Model(tuple(np.round(w, 4).tolist()), tuple(np.round(smooth, 4).tolist()))


def fit(pages: DataFrame) -> Model:
    """The model of a bounded sample of ``pages`` (page_id, url, html): pages whose hash of page_id
    and url is small; those that repeat count once. The driver sees only bounded rows of numbers."""
    n = pages.count()
    if not n:
        return DEFAULT
    h = F.xxhash64("page_id", "url")
    span = 1 << 40
    small = pages.where(F.pmod(h, F.lit(span)) < min(span, FIT_PAGES * span // n)).groupBy(h.alias("h")).agg(F.min("html").alias("html"))

    def run(batches):
        for batch in batches:
            for page in batch.column(0).to_pylist():
                if page:
                    rows, pairs = labelled_rows(page)
                    yield pa.RecordBatch.from_arrays([pa.array([[v for r in rows for v in r]], pa.list_(pa.float64())), pa.array([pairs], pa.list_(pa.int64()))], names=["rows", "pairs"])
    got = small.select("html").mapInArrow(run, "rows array<double>, pairs array<long>").orderBy("rows").collect()
    rows = np.array([v for r in got for v in r.rows], dtype=float).reshape(-1, len(FEATURES) + 1)
    pairs = np.array([r.pairs for r in got], dtype=float).reshape(-1, 8).sum(axis=0)
    return fit_model(rows, pairs) or DEFAULT


#: Fitted like any other on pages of prose with menus, adverts and footers.
DEFAULT = Model((-2.2525, 0.1781, -1.3459, -1.5977, 2.128, -1.5977, 3.9742, -0.1925, 4.3051, 0.4597), (0.0, 1.1984, 1.1953, 0.5493))


def extract(pages: DataFrame, model: Model | None = None) -> DataFrame:
    """page_id, url, text, n_chars (code points) of every row of ``pages``; the model is fitted on
    a bounded sample of them if none is given.

    Null, empty and text-free html gives an empty text. Every row is judged alone, so repeated
    rows repeat their result; null page_id and url stay null; extra columns are ignored.
    """
    pages = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    model = model or fit(pages)
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches):
        for batch in batches:
            texts = [main_text(x, model) for x in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], schema=schema)
    return pages.mapInArrow(run, "page_id long, url string, text string, n_chars long")
