"""Token counts that follow edits without encoding a document again.

A document's pre-tokens are the leaves of a segment tree: buckets of about ``BUCKET`` pre-tokens with their lengths
and token counts, under an array tree with sums of characters and tokens. An edit replaces a range of characters.
The cut into pre-tokens looks one character past a pre-token (and one past white space), so re-cutting starts at
the last old border two characters (or the longest special token, which is a pre-token by itself) before the edit and
ends at the first border as far behind it that the old cut has too. Only pre-tokens in between are encoded; sums change on the path to the root.

Defined results: a null or empty text has 0 tokens; edits are applied from the last to the first, so positions are
those of the old text; a stop before its start, or positions outside the text, are moved to the nearest valid
place; of edits that overlap, the earlier one ends where the later one starts; null edits are no edits; null ids
and repeated rows are kept; empty tables give empty results; other columns stay where they are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from strandweave.llm import flat, pieces
from strandweave.session import ship_code

BUCKET = 64
WINDOW = 64
Edit = tuple[int, int, str]


class CountTree:
    """Pre-token segment tree of one text."""

    def __init__(self, lengths: np.ndarray, counts: np.ndarray):
        edges = range(0, max(len(lengths), 1), BUCKET)
        self.buckets = [(lengths[i:i + BUCKET], counts[i:i + BUCKET]) for i in edges]
        self.size = 1 << (len(self.buckets) - 1).bit_length()
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        for i, (a, b) in enumerate(self.buckets):
            self.sums[self.size + i] = a.sum(), b.sum()
        level = self.size
        while level > 1:
            half = level // 2
            self.sums[half:level] = self.sums[level:2 * level:2] + self.sums[level + 1:2 * level:2]
            level = half

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def _set(self, i: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        self.buckets[i] = lengths, counts
        change = np.array([lengths.sum(), counts.sum()]) - self.sums[self.size + i]
        at = self.size + i
        while at:
            self.sums[at] += change
            at //= 2

    def bucket_at(self, position: int) -> tuple[int, int]:
        """Bucket that holds a character, and the characters before the bucket."""
        at, before = 1, 0
        while at < self.size:
            at *= 2
            if position >= before + self.sums[at, 0] and self.sums[at + 1, 0]:
                before += int(self.sums[at, 0])
                at += 1
        return min(at - self.size, len(self.buckets) - 1), before

    def splice(self, left: int, right: int, lengths: np.ndarray, counts: np.ndarray) -> None:
        """Puts new pre-tokens in place of those of the characters ``left .. right``, both old borders."""
        i, before = self.bucket_at(left)
        head = np.searchsorted(np.cumsum(self.buckets[i][0]), left - before, "right") if left > before else 0
        j, until = i, before
        while j + 1 < len(self.buckets) and until + int(self.sums[self.size + j, 0]) < right:
            until += int(self.sums[self.size + j, 0])
            j += 1
        tail = int(np.searchsorted(np.cumsum(self.buckets[j][0]), right - until)) + 1 if right > until else 0
        joined = [np.concatenate([self.buckets[i][k][:head], (lengths, counts)[k], self.buckets[j][k][tail:]]) for k in (0, 1)]
        none = np.zeros(0, np.int64)
        for k in range(i + 1, j + 1):
            self._set(k, none, none)
        self._set(i, *joined)
        if len(joined[0]) > 16 * BUCKET:  # grown far beyond its size: cut into buckets again
            self.__init__(*(np.concatenate([b[k] for b in self.buckets]) for k in (0, 1)))

    def borders(self, low: int, high: int) -> np.ndarray:
        """Old borders in ``low .. high``."""
        i, at = self.bucket_at(max(low, 0))
        out = []
        while i < len(self.buckets) and at <= high:
            ends = at + np.cumsum(self.buckets[i][0])
            out += [[at], ends]
            at += int(self.sums[self.size + i, 0])
            i += 1
        all_of = np.unique(np.concatenate(out)) if out else np.zeros(0, np.int64)
        return all_of[(all_of >= low) & (all_of <= high)]

    def dump(self) -> bytes:
        lengths, counts = (np.concatenate([b[k] for b in self.buckets]) for k in (0, 1))
        return np.concatenate([lengths, counts]).astype("<u4").tobytes()

    @classmethod
    def load(cls, data: bytes) -> CountTree:
        both = np.frombuffer(data, "<u4").astype(np.int64)
        return cls(both[:len(both) // 2], both[len(both) // 2:])


def build(texts: list[str], tok: pieces.ByteTokenizer) -> list[CountTree]:
    slots, at, lengths = tok.slots(texts)
    counts = tok.cache.lengths[slots]
    return [CountTree(lengths[a:b], counts[a:b]) for a, b in zip(at[:-1], at[1:])]


def apply_edit(tree: CountTree, text: str, edit: Edit, tok: pieces.ByteTokenizer) -> tuple[str, int]:
    """The new text, and how many pre-tokens were encoded; ``tree`` is changed to that of the new text."""
    start, stop, put = edit
    new = text[:start] + put + text[stop:]
    shift = len(new) - len(text)
    margin = max(2, tok.longest_special)
    reach = WINDOW
    while True:  # a border before the edit: the beginning of the text at the latest
        before = tree.borders(max(start - reach, 0), start - margin)
        if len(before) or reach > start:
            left = int(before[-1]) if len(before) else 0
            break
        reach *= 2
    reach = WINDOW
    while True:
        end = min(stop + shift + reach, len(new))
        part = new[left:end]
        codes, at = flat.code_points([part])
        cut = np.append(tok.starts([part], codes, at), len(part)) + left
        if end == len(new):
            right = len(new)
        else:
            sure = cut[(cut >= stop + shift) & (cut + margin <= end)]
            common = np.intersect1d(sure - shift, tree.borders(stop, end - shift))
            right = int(common[0]) + shift if len(common) else -1
        if right >= 0:
            break
        reach *= 2
    cut = cut[cut <= right] - left
    slots = tok.cache.find(codes, cut[:-1], cut[1:], part)
    tree.splice(left, right - shift, np.diff(cut), tok.cache.lengths[slots])
    return new, len(cut) - 1


def valid_edits(edits: list[Edit], size: int) -> list[Edit]:
    """Edits from the last to the first, inside the text and without overlaps."""
    out, limit = [], size
    for start, stop, put in sorted(((e[0], e[1], e[2] or "") for e in edits), reverse=True):
        start = min(max(start, 0), limit)
        stop = min(max(stop, start), limit)
        out.append((start, stop, put))
        limit = start
    return out


def recounted(docs: DataFrame, tokenizer_path: str, edits_of: Callable[[str], list[Edit]], text_col: str = "text", tree_col: str | None = None, prefix: str = "") -> DataFrame:
    """``docs`` with token counts before and after edits.

    Adds ``n_tokens, n_pieces, n_edits, n_tokens_edited, n_encoded`` (each with ``prefix``): the last is the number of
    pre-tokens the edits made the operator encode. ``edits_of`` gives a text's edits as (start, stop, new text) in
    code points. With ``tree_col`` stored trees are used instead of building them, and the new ones take their place.
    """
    ship_code(docs.sparkSession)
    names = [prefix + n for n in ("n_tokens", "n_pieces", "n_edits", "n_tokens_edited", "n_encoded")]
    docs = docs.drop(*names)
    place = docs.columns.index(text_col)
    tree_at = docs.columns.index(tree_col) if tree_col else -1
    schema = T.StructType(docs.schema.fields + [T.StructField(n, T.LongType()) for n in names])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pieces.tokenizer(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in flat.chunks([len(t) for t in texts]):
                if tree_col:
                    stored = batch.column(tree_at).slice(a, b - a).to_pylist()
                    trees = [CountTree.load(d) if d is not None else build([t], tok)[0] for d, t in zip(stored, texts[a:b])]
                else:
                    trees = build(texts[a:b], tok)
                rows = []
                for text, tree in zip(texts[a:b], trees):
                    edits = valid_edits(edits_of(text), len(text))
                    first, pieces_in, encoded = tree.tokens, sum(len(x[0]) for x in tree.buckets), 0
                    for e in edits:
                        text, n = apply_edit(tree, text, e, tok)
                        encoded += n
                    rows.append((first, pieces_in, len(edits), tree.tokens, encoded))
                columns = [c.slice(a, b - a) for c in batch.columns]
                if tree_col:
                    columns[tree_at] = pa.array([t.dump() for t in trees], pa.binary())
                counts = np.array(rows, np.int64).reshape(-1, 5)
                yield pa.RecordBatch.from_arrays([*columns, *[pa.array(counts[:, k]) for k in range(5)]], names=schema.names)

    return docs.mapInArrow(flat.trimmed(work), schema)


def with_trees(docs: DataFrame, tokenizer_path: str, text_col: str = "text", tree_col: str = "tree") -> DataFrame:
    """``docs`` with the tree of each text, to be stored and passed to :func:`recounted` later."""
    ship_code(docs.sparkSession)
    docs = docs.drop(tree_col)
    place = docs.columns.index(text_col)
    schema = T.StructType(docs.schema.fields + [T.StructField(tree_col, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = pieces.tokenizer(tokenizer_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in flat.chunks([len(t) for t in texts]):
                trees = pa.array([t.dump() for t in build(texts[a:b], tok)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), trees], names=schema.names)

    return docs.mapInArrow(flat.trimmed(work), schema)
