"""Main text of web pages by a linear-chain conditional random field over DOM leaf blocks.

A page is cut into leaf blocks: stretches of text without a block-level border inside, each with the block-level
tags above it and the words of their class, id and role attributes. Features are these, the shape of the text and
its share of links. A chain with two states (main text or not) is trained by gradient ascent of the conditional
log-likelihood on labelled pages (:mod:`strandweave.llm.html_pages`), and pages are decoded by Viterbi.

Scripts, styles, templates, text areas of forms and comments of the markup are never text. A quote opens a value only
after an equals sign and where another one ends it; elsewhere it is a character like others. Character references are decoded, white
space inside a block becomes one space, blocks are trimmed, empty ones dropped, and the blocks of the main text
are joined in page order by an empty line.

Defined results: a null or empty page, and one without main text, gives an empty text; markup that ends in the
middle of a tag loses that tag only; repeated rows repeat their result; null ids are kept; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

import html as references
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.session import ship_code

# Fixed values of HTML: elements that begin a block of their own, elements without end tag, elements whose content
# is not text, and elements that end others of the listed kinds.
BLOCKS = frozenset("""address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset
    figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html label legend li main menu nav ol optgroup option p
    pre section select summary table tbody td tfoot th thead title tr ul""".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = ("script", "style", "template", "textarea")
CLOSES = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"),
          "option": ("option",), "body": ("head",)}
SCOPES = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table", "tr"), "th": ("table", "tr"), "option": ("select",)}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:=\s*(?:\"[^\"]*\"|'[^']*'|[^\s>\"'][^\s>]*)|[^>])*+)(?:>|\Z)|<[!?/][^>]*(?:>|\Z)|[^<]+|<", re.S)
_ATTRIBUTE = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.I)
_END = {name: re.compile(rf"</{name}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for name in HIDDEN}
_NAME = re.compile(r"[a-z]+")


@dataclass
class Leaf:
    """A leaf block: text, characters inside links, the tags above it, all attribute words above it, and the nearest ones."""

    text: str
    linked: int
    tags: tuple[str, ...]
    words: frozenset[str]
    near: frozenset[str]


@dataclass
class _Open:
    name: str
    words: frozenset[str] = field(default_factory=frozenset)


def leaves(page: str) -> list[Leaf]:
    """Leaf blocks with text, in page order."""
    out: list[Leaf] = []
    stack: list[_Open] = []
    parts: list[str] = []
    link_parts: list[str] = []
    in_link = 0

    def close_block() -> None:
        text = " ".join(references.unescape("".join(parts)).split())
        if text:
            words = frozenset().union(*(o.words for o in stack))
            linked = len(" ".join(references.unescape("".join(link_parts)).split()))
            near = next((o.words for o in reversed(stack) if o.words), frozenset())
            out.append(Leaf(text, min(linked, len(text)), tuple(o.name for o in stack), words, near))
        parts.clear()
        link_parts.clear()

    def pop_to(names: tuple[str, ...], scope: tuple[str, ...] = ()) -> None:
        for k in range(len(stack) - 1, -1, -1):
            if stack[k].name in names:
                del stack[k:]
                return
            if stack[k].name in scope:
                return

    at, size = 0, len(page)
    while at < size:
        m = _TOKEN.match(page, at)
        at = m.end()
        name = m.group(2)
        if name is None:
            if page[m.start()] != "<" or m.group() == "<":
                parts.append(m.group())
                if in_link:
                    link_parts.append(m.group())
            continue
        name = name.lower()
        if name == "a":
            in_link = 0 if m.group(1) else 1
        if m.group(1):
            if name in BLOCKS:
                close_block()
                in_link = 0
                pop_to((name,))
            continue
        if name in HIDDEN:
            if not m.group(3).rstrip().endswith("/"):
                end = _END[name].search(page, at)
                at = end.end() if end else size
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name not in BLOCKS:
            continue
        close_block()
        in_link = 0
        if name not in ("option", "label", "button"):
            pop_to(("p",), ("div", "td", "li", "article", "section", "button", "table"))
        if name in CLOSES:
            pop_to(CLOSES[name], SCOPES.get(name, ()))
        if name not in VOID:
            words = {w for a in _ATTRIBUTE.finditer(m.group(3)) for w in _NAME.findall((a.group(2) or a.group(3) or a.group(4) or "").lower())} if m.group(3) else ()
            stack.append(_Open(name, frozenset(words)))
    close_block()
    return out


_SIZES = (3, 8, 16, 40)


def _shape(block: Leaf) -> tuple[int, int]:
    """Size class of a block's text and how much of it is links."""
    share = block.linked / len(block.text)
    return sum(len(block.text.split()) >= s for s in _SIZES), 0 if share == 0 else 1 if share < 0.3 else 2 if share < 0.8 else 3


def features(blocks: list[Leaf]) -> list[list[str]]:
    """Names of the features of each block."""
    out = []
    shapes = [_shape(b) for b in blocks]
    for k, b in enumerate(blocks):
        size, links = shapes[k]
        own = b.tags[-1] if b.tags else ""
        f = ["any", f"own={own}", f"size={size}", f"links={links}", f"own={own},size={size}"]
        for side, other in (("before", k - 1), ("after", k + 1)):  # what stands beside it, and whether in the same place
            if 0 <= other < len(blocks):
                n = blocks[other]
                same = n.tags[:-1] == b.tags[:-1]
                f += [f"{side},size={shapes[other][0]}", f"{side},links={shapes[other][1]}", f"{side},own={n.tags[-1] if n.tags else ''}", f"{side},same={same},size={shapes[other][0]}"]
        near = shapes[max(k - 3, 0):k + 4]
        f.append(f"prose={sum(s >= 2 and not l for s, l in near)}")
        f.append(f"depth={min(len(b.tags), 6)}")
        f += [f"in={t}" for t in set(b.tags)]
        f += [f"word={w}" for w in b.words] + [f"near={w}" for w in b.near]
        f.append(f"up={b.tags[-2] if len(b.tags) > 1 else ''}")
        if b.text[-1] in ".!?:;\"'»”)":
            f.append("ends")
        if "©" in b.text or "·" in b.text or " | " in b.text:
            f.append("signs")
        if "article" in b.tags or "main" in b.tags:
            f.append(f"main,own={b.tags[-1]}")
        if sum(c.isdigit() for c in b.text) * 4 > len(b.text):
            f.append("digits")
        f.append("first" if k == 0 else "last" if k == len(blocks) - 1 else "inner")
        out.append(f)
    return out


@dataclass
class Chain:
    """Weights of a two-state chain: per feature the score of main text, of state changes, and of the first state."""

    weights: dict[str, float]
    change: np.ndarray
    start: np.ndarray

    def decode(self, blocks: list[Leaf]) -> list[bool]:
        """Best states by Viterbi; ties go to "not main text"."""
        if not blocks:
            return []
        (c00, c01), (c10, c11) = self.change.tolist()
        no, yes = self.start.tolist()
        back = []
        for k, f in enumerate(features(blocks)):
            if k:
                a, b = no >= yes + c10 - c00, no + c01 > yes + c11
                back.append((not a, not b))
                no, yes = (no + c00 if a else yes + c10), (no + c01 if b else yes + c11)
            yes += sum(self.weights.get(x, 0.0) for x in f)
        state = yes > no
        states = [state]
        for step in reversed(back):
            state = step[state]
            states.append(state)
        return states[::-1]

    def text(self, page: str) -> str:
        blocks = leaves(page)
        return "\n\n".join(b.text for b, main in zip(blocks, self.decode(blocks)) if main)


class _Pages:
    """Labelled pages as arrays; a page is (feature ids, offsets of blocks, states)."""

    def __init__(self, pages: list[tuple[np.ndarray, np.ndarray, np.ndarray]]):
        self.sizes = np.array([len(s) for _, _, s in pages])
        self.ids = np.concatenate([ids for ids, _, _ in pages])
        counts = np.concatenate([np.diff(at) for _, at, _ in pages])
        self.block = np.repeat(np.arange(len(counts)), counts)
        self.page = np.repeat(np.arange(len(pages)), self.sizes)
        self.step = np.arange(len(counts)) - np.repeat(np.cumsum(self.sizes) - self.sizes, self.sizes)
        self.state = np.concatenate([s for _, _, s in pages]).astype(int)
        self.follows = np.flatnonzero(self.step > 0)


def log_likelihood(weights: np.ndarray, change: np.ndarray, start: np.ndarray, pages: _Pages):
    """Log-likelihood of labelled pages and its gradient, all pages step by step together."""
    p, n = len(pages.sizes), int(pages.sizes.max())
    yes = np.bincount(pages.block, weights[pages.ids], len(pages.state))
    unary = np.zeros((n, p, 2))
    unary[pages.step, pages.page, 1] = yes
    forward, backward = np.zeros((n, p, 2)), np.zeros((n, p, 2))
    forward[0] = start + unary[0]
    for k in range(1, n):
        new = np.logaddexp(forward[k - 1, :, :1] + change[0], forward[k - 1, :, 1:] + change[1]) + unary[k]
        forward[k] = np.where((k < pages.sizes)[:, None], new, forward[k - 1])
    z = np.logaddexp(forward[-1, :, 0], forward[-1, :, 1])
    for k in range(n - 2, -1, -1):
        after = backward[k + 1] + unary[k + 1]
        new = np.logaddexp(change[:, 0] + after[:, :1], change[:, 1] + after[:, 1:])
        backward[k] = np.where((k + 1 < pages.sizes)[:, None], new, 0.0)
    at = pages.step, pages.page
    marginal = np.exp((forward + backward)[at] - z[pages.page, None])
    total = (yes * pages.state).sum() - z.sum()
    g_w = np.bincount(pages.ids, (pages.state - marginal[:, 1])[pages.block], len(weights))
    heads = np.flatnonzero(pages.step == 0)
    total += start[pages.state[heads]].sum()
    g_s = np.bincount(pages.state[heads], minlength=2) - marginal[heads].sum(0)
    f = pages.follows
    total += change[pages.state[f - 1], pages.state[f]].sum()
    pair = np.exp(forward[at][f - 1][:, :, None] + change + (unary + backward)[at][f][:, None, :] - z[pages.page[f], None, None])
    g_c = np.bincount(2 * pages.state[f - 1] + pages.state[f], minlength=4).reshape(2, 2) - pair.sum(0)
    return total, g_w, g_c, g_s


def train(pages: list[tuple[str, list[bool]]], rounds: int = 300, penalty: float = 2e-5) -> Chain:
    """Chain from pages with a state per leaf block, by gradient ascent with a step per weight."""
    rows = [(features(leaves(page)), np.array(states, bool)) for page, states in pages]
    names = sorted({f for blocks, _ in rows for b in blocks for f in b})
    number = {n: i for i, n in enumerate(names)}
    data = []
    for blocks, states in rows:
        if len(blocks) != len(states):
            raise ValueError("a labelled page needs a state per leaf block")
        if blocks:
            ids = np.array([number[f] for b in blocks for f in b])
            data.append((ids, np.cumsum([0, *map(len, blocks)]), states))
    together = _Pages(data)
    total = len(together.state)
    values = [np.zeros(len(names)), np.zeros((2, 2)), np.zeros(2)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    for k in range(1, rounds + 1):
        _, *gradients = log_likelihood(*values, together)
        for i, g in enumerate(gradients):
            g = g / total - penalty * values[i]
            first[i] = 0.9 * first[i] + 0.1 * g
            second[i] = 0.99 * second[i] + 0.01 * g * g
            values[i] = values[i] + 0.1 * (first[i] / (1 - 0.9**k)) / (np.sqrt(second[i] / (1 - 0.99**k)) + 1e-8)
    return Chain(dict(zip(names, values[0].tolist())), values[1], values[2])


@lru_cache(maxsize=1)
def default_chain() -> Chain:
    """Chain trained on the labelled pages of :mod:`strandweave.llm.html_pages`."""
    from strandweave.llm.html_pages import labelled_pages

    return train(labelled_pages())


def main_text(pages: DataFrame, chain: Chain | None = None, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Per page: ``<id_col>, <url_col>, text, n_chars``."""
    spark = pages.sparkSession
    ship_code(spark)
    shared = spark.sparkContext.broadcast(chain or default_chain())  # a weight per feature name of the training pages
    rows = pages.select(id_col, url_col, F.coalesce(html_col, F.lit("")).alias("_html"))
    schema = T.StructType([*rows.schema.fields[:2], T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = [model.text(page.as_py()) for page in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=schema.names)

    return rows.mapInArrow(work, schema)
