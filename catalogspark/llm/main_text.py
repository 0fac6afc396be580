"""Main text of web pages by a tree-structured graphical model over the DOM.

Every element that holds text, and every run of text in one element and block, is a variable: content or not. Each has features of its
own (tag, words of its class and id, amount of text, share of links). Potentials connect parent and child, one table for each tag of
the child. One pass of messages from the leaves to the root and one back give the exact marginal of every variable; text whose
marginal is a half or more is main text. All pages of a batch are one forest, so a pass takes a few array operations a level.

The weights are those of greatest likelihood on labelled pages: (html, main text). See `page_layouts` for where those come from.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalogspark.llm import hashing

# Elements without content, elements whose text is never shown as text, and elements inside a line.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset(
    "head title script style template noscript svg math iframe object select textarea button canvas audio video datalist".split()
)
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr output q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
RAW = frozenset("script style textarea title iframe noscript".split())
# Which open elements a start tag ends, and the elements that bound the search for them.
_ENDS_P = (
    "address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr "
    "main menu nav ol p pre search section table ul"
).split()
IMPLIED = {tag: (frozenset({"p"}), frozenset({"td", "th", "caption", "button", "table"})) for tag in _ENDS_P}
IMPLIED |= {
    "li": (frozenset({"li"}), frozenset({"ul", "ol", "menu"})),
    "dt": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "dd": (frozenset({"dt", "dd"}), frozenset({"dl"})),
    "tr": (frozenset({"tr"}), frozenset({"table"})),
    "td": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "th": (frozenset({"td", "th"}), frozenset({"tr", "table"})),
    "thead": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tbody": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
    "tfoot": (frozenset({"thead", "tbody", "tfoot"}), frozenset({"table"})),
}
#: Elements nested deeper than this hang from the last one above.
MAX_DEPTH = 200

_TOKEN = re.compile(
    r"""<!--.*?(?:--!?>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>|<[!?/][^>]*+>?""", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_HINT = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Tree:
    """A page: its elements, parents before children, the runs of text, and all pieces of text in order."""

    tags: list[str] = field(default_factory=lambda: ["#page"])
    hints: list[list[str]] = field(default_factory=lambda: [[]])
    parents: list[int] = field(default_factory=lambda: [-1])
    depths: list[int] = field(default_factory=lambda: [0])
    runs: list[list] = field(default_factory=list)
    pieces: list[tuple[int, int, str]] = field(default_factory=list)

    def add(self, tag: str, parent: int, hints: list[str]) -> int:
        self.tags.append(tag)
        self.hints.append(hints)
        self.parents.append(parent)
        self.depths.append(self.depths[parent] + 1)
        return len(self.tags) - 1


def _hints(attributes: str) -> list[str]:
    """Words of class and id, the role, and whether the element is hidden."""
    out = []
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            out += [w.lower() for w in _HINT.findall(entities.unescape(value))]
        elif name == "role":
            out.append(f"role {value.lower()}")
        elif name == "hidden" or (name == "aria-hidden" and value == "true") or (name == "style" and _INVISIBLE.search(value)):
            out.append("is hidden")
    return out


def parse(html: str) -> Tree:
    """The tree of a page, however malformed; a run of text has [element, block, characters, characters in links, words, text]."""
    tree, stack = Tree(), [("#page", 0)]
    block, links, silent, at = 0, 0, 0, 0

    def text(raw: str) -> None:
        if silent or not raw:
            return
        raw = entities.unescape(raw) if "&" in raw else raw
        shown = raw.strip()
        node = stack[-1][1]
        if not shown:
            tree.pieces.append((block, -1, raw))
            if tree.runs and tree.runs[-1][0] == node and tree.runs[-1][1] == block:
                tree.runs[-1][5].append(raw)
            return
        if not (tree.runs and tree.runs[-1][0] == node and tree.runs[-1][1] == block):
            tree.runs.append([node, block, 0, 0, 0, []])
        run = tree.runs[-1]
        run[2] += len(shown)
        run[3] += len(shown) if links else 0
        run[4] += len(shown.split())
        run[5].append(raw)
        tree.pieces.append((block, len(tree.runs) - 1, raw))

    def close(k: int) -> None:
        nonlocal block, links, silent
        for tag, _ in stack[k:]:
            links -= tag == "a"
            silent -= tag in SILENT
            block += tag not in INLINE and tag not in SILENT
        del stack[k:]

    match = _TOKEN.search(html)
    while match:
        text(html[at : match.start()])
        at = match.end()
        closing, tag, attributes = (match[1], match[2], match[3]) if match[2] else (match[4], match[5], match[6])
        if tag:
            tag = tag.lower()
            if closing:
                if tag not in ("html", "body"):
                    inline = tag in INLINE
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] == tag:
                            close(k)
                            break
                        if inline and stack[k][0] not in INLINE:
                            break
            elif tag == "br":
                text(" ")
            else:
                if tag in IMPLIED:
                    ended, bound = IMPLIED[tag]
                    for k in range(len(stack) - 1, 0, -1):
                        if stack[k][0] in ended:
                            close(k)
                            break
                        if stack[k][0] in bound:
                            break
                block += tag not in INLINE and tag not in SILENT
                if tag not in VOID:
                    node, hints = stack[-1][1], _hints(attributes) if "=" in attributes or "hidden" in attributes else []
                    if (tag not in INLINE or hints) and tree.depths[node] < MAX_DEPTH:
                        node = tree.add(tag, node, hints)
                    stack.append((tag, node))
                    links += tag == "a"
                    silent += tag in SILENT
                    if tag in RAW:
                        end = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(html, at)
                        at = end.start() if end else len(html)
        match = _TOKEN.search(html, at)
    text(html[at:])
    return tree


def _step(value: float, steps: tuple) -> int:
    return sum(value >= s for s in steps)


def _features(tree: Tree) -> tuple[list[list[str]], list[int], list[int], list[int]]:
    """(names of features, parent, depth, run or -1) of each variable: the elements that hold text, and the runs."""
    n = len(tree.tags)
    size, linked, longest, count = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, chars, in_links, words, _ in tree.runs:
        size[node] += chars
        linked[node] += in_links
        count[node] += 1
        longest[node] = max(longest[node], words)
    for i in range(n - 1, 0, -1):
        p = tree.parents[i]
        size[p] += size[i]
        linked[p] += linked[i]
        count[p] += count[i]
        longest[p] = max(longest[p], longest[i])
    place, names, parents, depths, runs = {}, [], [], [], []
    for i in range(n):
        if not count[i] and i:
            continue
        place[i] = len(names)
        share = size[i] / max(1, size[0])
        own = [f"tag {tree.tags[i]}", f"links {_step(linked[i] / max(1, size[i]), (0.01, 0.1, 0.3, 0.6, 0.9))}"]
        own += [f"share {_step(share, (0.02, 0.1, 0.3, 0.6, 0.9))}", f"longest {_step(longest[i], (4, 10, 25, 60))}", f"runs {_step(count[i], (2, 4, 10))}"]
        names.append(own + [f"hint {h}" for h in tree.hints[i]])
        parents.append(place.get(tree.parents[i], -1))
        depths.append(tree.depths[i])
        runs.append(-1)
    for k, (node, _, chars, in_links, words, raw) in enumerate(tree.runs):
        end = "".join(raw).rstrip()[-1:]
        own = ["text", f"words {_step(words, (2, 4, 8, 16, 32, 64))}", f"linked {_step(in_links / chars, (0.01, 0.3, 0.7, 0.99))}"]
        own += [f"in {tree.tags[node]}", f"place {_step((k + 0.5) / len(tree.runs), (0.1, 0.9))}"]
        own += ["sentence"] * (end in '.!?…。"”»') + ["copyright"] * ("©" in raw[0])
        names.append(own)
        parents.append(place[node])
        depths.append(tree.depths[node] + 1)
        runs.append(k)
    return names, parents, depths, runs


@dataclass
class Forest:
    """The variables of many pages, and the (variable, feature) pairs that are known to a model."""

    parent: np.ndarray
    depth: np.ndarray
    kind: np.ndarray
    row: np.ndarray
    feature: np.ndarray
    run: np.ndarray
    page: np.ndarray


class Model:
    """Weights of features, and one table of potentials for each tag of a child; `tables[kind, parent's state, child's state]`."""

    def __init__(self, features: dict[str, int], kinds: dict[str, int]):
        self.features, self.kinds = features, kinds
        self.weights, self.tables = np.zeros(len(features)), np.zeros((len(kinds) + 1, 2, 2))
        self._hints = sorted((f[5:] for f in features if f.startswith("hint ") and len(f) >= 9), key=len, reverse=True)
        self._nearest: dict[str, int | None] = {}

    def index(self, name: str) -> int | None:
        """The feature of a name; an unknown word of a class counts as the longest known one that it begins or ends with."""
        found = self.features.get(name)
        if found is None and name.startswith("hint "):
            if name not in self._nearest and len(self._nearest) < 100_000:
                word = next((h for h in self._hints if name[5:].startswith(h) or name.endswith(h)), None)
                self._nearest[name] = None if word is None else self.features[f"hint {word}"]
            found = self._nearest.get(name)
        return found

    def forest(self, trees: Iterable[Tree]) -> Forest:
        parent, depth, kind, row, feature, run, page = [], [], [], [], [], [], []
        for number, tree in enumerate(trees):
            first = len(parent)
            names, parents, depths, runs = _features(tree)
            for i, own in enumerate(names):
                found = {k for k in map(self.index, own) if k is not None}
                feature += found
                row += [first + i] * len(found)
                kind.append(self.kinds.get(own[0], len(self.kinds)))
            parent += [p + first if p >= 0 else -1 for p in parents]
            depth += depths
            run += runs
            page += [number] * len(names)
        return Forest(*[np.array(x, np.int64) for x in (parent, depth, kind, row, feature, run, page)])

    def pass_messages(self, forest: Forest) -> tuple[np.ndarray, np.ndarray]:
        """(marginal of being content, joint marginals of parent and child) of each variable, by sums and products along the trees."""
        n = len(forest.parent)
        own = np.zeros((n, 2))
        own[:, 1] = np.bincount(forest.row, weights=self.weights[forest.feature], minlength=n)
        table, up, sent = self.tables[forest.kind], np.zeros((n, 2)), np.zeros((n, 2))
        order = np.argsort(forest.depth, kind="stable")
        edges = np.searchsorted(forest.depth[order], np.arange(int(forest.depth.max(initial=0)) + 2))
        levels = [order[a:b] for a, b in zip(edges[1:], edges[2:])]
        for level in reversed(levels):
            belief = own[level] + up[level]
            sent[level] = np.logaddexp(table[level, :, 0] + belief[:, :1], table[level, :, 1] + belief[:, 1:])
            np.add.at(up, forest.parent[level], sent[level])
        down, joint = np.zeros((n, 2)), np.zeros((n, 2, 2))
        for level in levels:
            above = forest.parent[level]
            rest = own[above] + up[above] + down[above] - sent[level]
            both = rest[:, :, None] + table[level]
            down[level] = np.logaddexp(both[:, 0], both[:, 1])
            joint[level] = both + (own[level] + up[level])[:, None, :]
        belief = own + up + down
        joint = np.exp(joint - joint.max(axis=(1, 2), keepdims=True))
        return 1 / (1 + np.exp(np.clip(belief[:, 0] - belief[:, 1], -700, 700))), joint / joint.sum(axis=(1, 2), keepdims=True)


def lines(tree: Tree, kept: Iterable[int]) -> list[str]:
    """The blocks of the text runs with these numbers, in page order, each with single spaces."""
    kept, out, block, parts = set(kept), [], -1, []
    for number, run, raw in [*tree.pieces, (-2, -1, "")]:
        if number != block:
            if whole := " ".join("".join(parts).split()):
                out.append(whole)
            block, parts = number, []
        if run < 0 or run in kept:
            parts.append(raw)
    return out


def labels(tree: Tree, main_text: str) -> list[bool]:
    """Which text runs are part of the main text: those that it has as a line, or within one."""
    wanted = Counter(main_text.split("\n"))
    inside = " \n ".join(wanted)
    own = [" ".join("".join(run[5]).split()) for run in tree.runs]
    return [t in wanted or (len(t) > 20 and t in inside) for t in own]


@dataclass(frozen=True)
class Training:
    """Parameters: pages that are fitted on at most, steps, and the strength that draws weights to zero."""

    pages: int = 300
    page_bytes: int = 1 << 16
    steps: int = 120
    rate: float = 0.1
    shrink: float = 1.0


def fit(pages: list[tuple[str, str]], training: Training = Training()) -> Model:
    """The model of greatest likelihood on (html, main text), its gradient being seen minus expected features and state pairs."""
    trees = [parse(h) for h, _ in pages]
    seen = Counter(name for t in trees for name in {n for own in _features(t)[0] for n in own})
    features = {name: i for i, name in enumerate(sorted(n for n, c in seen.items() if c >= 3))}
    model = Model(features, {n: i for i, n in enumerate(f for f in features if f.startswith("tag ") or f == "text")})
    if not trees:
        return model
    forest = model.forest(trees)
    truth = np.concatenate([labels(t, text) for t, (_, text) in zip(trees, pages)] or [[]]).astype(float)
    state, chars, content = np.zeros(len(forest.parent)), np.zeros(len(forest.parent)), np.zeros(len(forest.parent))
    at = np.flatnonzero(forest.run >= 0)
    chars[at] = [run[2] for t in trees for run in t.runs]
    content[at] = chars[at] * truth
    for i in np.argsort(-forest.depth, kind="stable"):
        if forest.parent[i] >= 0:
            chars[forest.parent[i]] += chars[i]
            content[forest.parent[i]] += content[i]
    # an element is content if most of its text is
    state = (content > 0.6 * chars).astype(float)
    child = np.flatnonzero(forest.parent >= 0)
    pair = np.zeros((len(forest.parent), 2, 2))
    pair[child, state[forest.parent[child]].astype(int), state[child].astype(int)] = 1
    values = [model.weights, model.tables]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for step in range(1, training.steps + 1):
        marginal, joint = model.pass_messages(forest)
        slope = np.zeros_like(model.tables)
        np.add.at(slope, forest.kind[child], (pair - joint)[child])
        gradients = [np.bincount(forest.feature, weights=(state - marginal)[forest.row], minlength=len(features)), slope]
        for value, gradient, a, b in zip(values, gradients, first, second):
            gradient = gradient - training.shrink * value
            a += 0.1 * (gradient - a)
            b += 0.01 * (gradient**2 - b)
            value += training.rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-8)
    return model


def main_texts(model: Model, htmls: list[str]) -> list[str]:
    """The main text of each page."""
    trees = [parse(h) for h in htmls]
    forest = model.forest(trees)
    marginal, _ = model.pass_messages(forest)
    kept: list[list[int]] = [[] for _ in trees]
    for i in np.flatnonzero((forest.run >= 0) & (marginal >= 0.5)):
        kept[forest.page[i]].append(int(forest.run[i]))
    return ["\n".join(lines(t, k)) for t, k in zip(trees, kept)]


def extract(pages: DataFrame, labelled: list[tuple[str, str]], training: Training = Training()) -> DataFrame:
    """(page_id, url, text, n_chars), a row per row of `pages`: the main text of its whole html, and its code points.

    Character references are decoded, white space in a block is one space, blocks stand in page order with a line feed between. A line
    break inside a block counts as white space. Nothing is cut off, however long the page or text.

    A NULL or empty html, or one without text, has the empty text. Malformed markup is read as far as it goes: missing end tags
    are implied, unknown ones ignored. Pages are judged one by one, so repeated rows, equal ids and NULL ids are kept as
    they are. Further columns are ignored. An empty table gives an empty one. Memory is bounded by some 2 MB of html or the longest page.
    """
    model = fit(labelled, training)
    shared = pages.sparkSession.sparkContext.broadcast((model.features, model.kinds, model.weights, model.tables))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        features, kinds, weights, tables = shared.value
        own = Model(features, kinds)
        own.weights, own.tables = weights, tables
        for whole in batches:
            for batch in hashing.pieces_of(whole, 2):
                found = main_texts(own, [h or "" for h in batch.column(2).to_pylist()])
                sizes = pa.array([len(t) for t in found], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.string()), sizes], names=["page_id", "url", "text", "n_chars"])

    schema = pages.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema
    return pages.select("page_id", "url", "html").mapInArrow(read, schema)
