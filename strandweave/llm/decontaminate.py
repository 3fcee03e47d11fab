"""Benchmark passages inside documents, by CGK embedding and bit sampling, verified by edit distance over words.

Words are runs without ASCII white space, A-Z lower-cased. An item of W words is found where some stretch of a
document is within ``tolerance * W`` word edits of it.

1. Anchors: within that distance an item and its stretch share at least one run of q words (q = 3 unless the item
   is too short for the counting argument). Every document position with a run of an item proposes the window of
   the item's size that lines the two up.
2. Embedding: the CGK random walk reads window and item by the same coin flips, advancing one word or none per
   step, and turns few edits into few differing steps. ``REPEATS`` independent walks are taken.
3. Bit sampling: per walk, ``TABLES`` keys of ``SAMPLED`` random steps each. A window goes on if any key equals the
   item's; its misses at exactly the full tolerance are measured in the tests, per length and kind of edit
   (recall at least 0.99 each).
4. Verification: overlapping windows of an item are joined and searched once by a bit-parallel edit distance
   with free ends.

The benchmark is taken to the tasks in groups of at most ``GROUP_BYTES``; each group is one pass.

Defined results: null or empty texts and items without words match nothing; a document that holds an item several
times gives one row with the smallest distance; equal items give a row each; repeated rows repeat their result;
null ids are kept; empty tables give an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import flat
from strandweave.session import ship_code

REPEATS, TABLES, SAMPLED = 8, 32, 4
GROUP_BYTES = 32 << 20
_SEED = 20240229


def allowed(words: int, tolerance: float) -> int:
    return int(words * tolerance + 1e-9)


def anchor_width(words: int, tolerance: float) -> int:
    """Largest run of at most three words that an item shares with every stretch within the tolerance."""
    edits = allowed(words, tolerance)
    return max(q for q in (1, 2, 3) if q == 1 or words - q + 1 - q * edits >= 1)


@lru_cache(maxsize=4096)
def _sample(length: int) -> np.ndarray:
    """Sampled steps of walks over ``length`` words: (repeats, tables, sampled)."""
    return np.random.default_rng(_SEED + length).integers(0, 3 * length, (REPEATS, TABLES, SAMPLED))


def embed(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Keys (windows, repeats, tables) of ``words[start:end]`` under walks of ``3 * length`` steps."""
    n, steps = len(starts), 3 * int(lengths.max(initial=0))
    padded = np.append(words, np.uint64(0))
    end = ends[:, None]
    at = np.repeat(starts[:, None], REPEATS, 1)
    trace = np.empty((steps, n, REPEATS), np.uint64)
    coins = flat.mix(np.arange(steps * REPEATS, dtype=np.uint64) + np.uint64(_SEED)).reshape(steps, 1, REPEATS)
    for step in range(steps):
        inside = at < end
        here = trace[step] = padded[np.where(inside, at, len(words))]
        at += inside & (flat.mix(here ^ coins[step]) & np.uint64(1)).astype(bool)
    keys = np.zeros((n, REPEATS, TABLES), np.uint64)
    chosen = np.stack([_sample(m) for m in lengths.tolist()]) if n else np.zeros((0, REPEATS, TABLES, SAMPLED), np.int64)
    row, repeat = np.arange(n)[:, None, None], np.arange(REPEATS)[None, :, None]
    for k in range(SAMPLED):
        keys = flat.mix(keys ^ trace[chosen[..., k], row, repeat])
    return keys


def edit_distance_within(item: np.ndarray, text: np.ndarray) -> int:
    """Smallest number of word edits between ``item`` and any stretch of ``text``."""
    m = len(item)
    places: dict[int, int] = {}
    for i, w in enumerate(item.tolist()):
        places[w] = places.get(w, 0) | 1 << i
    full, top = (1 << m) - 1, 1 << (m - 1)
    plus, minus, score = full, 0, m
    best = m
    for w in text.tolist():
        eq = places.get(w, 0)
        x = eq | minus
        d0 = ((((eq & plus) + plus) ^ plus) | x) & full
        up, down = (minus | ~(d0 | plus)) & full, plus & d0
        score += bool(up & top) - bool(down & top)
        best = min(best, score)
        up, down = (up << 1) & full, (down << 1) & full
        plus, minus = (down | ~(d0 | up)) & full, up & d0
    return best


class Items:
    """Items of a benchmark: words, anchors and keys."""

    def __init__(self, texts: list[bytes], tolerance: float):
        self.words, _, _, self.at = flat.words(texts)
        self.sizes = np.diff(self.at)
        self.edits = np.array([allowed(int(n), tolerance) for n in self.sizes])
        widths = np.array([anchor_width(int(n), tolerance) if n else 0 for n in self.sizes])
        self.anchors = {}
        for q in (1, 2, 3):
            own = np.flatnonzero(widths == q)
            if not len(own):
                continue
            runs = self.sizes[own] - q + 1
            first = flat.ragged(self.at[:-1][own], runs)
            item, place = np.repeat(own, runs), first - np.repeat(self.at[:-1][own], runs)
            keys = _runs(self.words, q)[first]
            order = np.argsort(keys, kind="stable")
            self.anchors[q] = keys[order], item[order], place[order]
        self.keys = np.zeros((len(self.sizes), REPEATS, TABLES), np.uint64)
        for own in _by_length(np.arange(len(self.sizes)), self.sizes):
            self.keys[own] = embed(self.words, self.at[:-1][own], self.at[1:][own], self.sizes[own])

    def windows(self, words: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Distinct (text, item, first word) of the windows the anchors propose; a window can begin before its text."""
        text = np.repeat(np.arange(len(at) - 1), np.diff(at))
        found = [np.zeros((0, 3), np.int64)]
        for q, (keys, item, place) in self.anchors.items():
            runs = _runs(words, q)
            low = np.searchsorted(keys, runs)
            hit = np.flatnonzero(keys[np.minimum(low, len(keys) - 1)] == runs) if len(runs) else low
            hit = hit[text[hit] == text[hit + q - 1]]
            low = low[hit]
            many = np.searchsorted(keys, runs[hit], "right") - low
            which, pos = flat.ragged(low, many), np.repeat(hit, many)
            found.append(np.column_stack([text[pos], item[which], pos - place[which]]))
        return np.unique(np.concatenate(found), axis=0)

    def sieved(self, words: np.ndarray, at: np.ndarray, windows: np.ndarray) -> np.ndarray:
        """Windows that share a sampled key with their item."""
        good = np.zeros(len(windows), bool)
        lengths = self.sizes[windows[:, 1]]
        for part in _by_length(np.arange(len(windows)), lengths):
            text, item, first = windows[part].T
            keys = embed(words, np.maximum(first, at[text]), np.minimum(first + lengths[part], at[text + 1]), lengths[part])
            good[part] = (keys == self.keys[item]).any((1, 2))
        return windows[good]

    def matches(self, texts: list[bytes]) -> list[tuple[int, int, int]]:
        """(text, item, distance) of all items within their tolerance, sorted."""
        words, _, _, at = flat.words(texts)
        out: dict[tuple[int, int], int] = {}
        region: list[int] | None = None

        def search(r) -> None:
            text, item, low, high = r
            edits = int(self.edits[item])
            stretch = words[max(low - edits, at[text]):min(high + edits, at[text + 1])]
            distance = edit_distance_within(self.words[self.at[item]:self.at[item + 1]], stretch)
            if distance <= edits:
                out[text, item] = min(distance, out.get((text, item), distance))

        for text, item, first in self.sieved(words, at, self.windows(words, at)).tolist():
            last = first + int(self.sizes[item])
            if region and region[:2] == [text, item] and first <= region[3] + 2 * int(self.edits[item]):
                region[3] = last
                continue
            if region:
                search(region)
            region = [text, item, first, last]
        if region:
            search(region)
        return sorted((t, i, d) for (t, i), d in out.items())


def _by_length(rows: np.ndarray, lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Rows of similar length, in parts whose walks take a bounded amount of memory."""
    size = np.frexp(lengths)[1]  # of powers of two
    for k in np.unique(size[lengths > 0]).tolist():
        own = rows[size == k]
        yield from np.array_split(own, 1 + (len(own) << k) * 3 * REPEATS // (1 << 22))


def _runs(words: np.ndarray, q: int) -> np.ndarray:
    """Hash of the q words from each position on; the last q - 1 positions have none."""
    n = len(words) - q + 1
    out = np.zeros(max(n, 0), np.uint64)
    for k in range(q):
        if n > 0:
            out = flat.mix(out * np.uint64(31) ^ words[k:n + k])
    return out


def matched(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, id_col: str = "item_id", text_col: str = "text", into: str = "matches") -> DataFrame:
    """``docs`` with an array of (item, distance, words) of the benchmark items found in each text."""
    spark = docs.sparkSession
    ship_code(spark)
    items = benchmark.select(F.col(id_col).alias("item"), F.coalesce(text_col, F.lit("")).cast("binary").alias("text"))
    total = items.agg(F.sum(F.length("text"))).first()[0] or 0
    groups = 1 + total // GROUP_BYTES
    kind = items.schema["item"].dataType
    match = T.ArrayType(T.StructType([T.StructField("item", kind), T.StructField("distance", T.IntegerType()), T.StructField("words", T.IntegerType())]))
    docs = docs.drop(into)
    place = docs.columns.index(text_col)
    for g in range(groups):
        rows = items.where(F.pmod(F.xxhash64("text"), F.lit(groups)) == g).orderBy("item").collect()  # bounded by GROUP_BYTES
        names, texts = [r.item for r in rows], [bytes(r.text) for r in rows]
        shared = spark.sparkContext.broadcast((names, texts))
        docs = _one_pass(docs, shared, tolerance, place, match, f"_found_{g}")
    found = [f"_found_{g}" for g in range(groups)]
    return docs.withColumn(into, F.concat(*found)).drop(*found)


def _one_pass(docs: DataFrame, shared, tolerance: float, place: int, match: T.ArrayType, into: str) -> DataFrame:
    schema = T.StructType(docs.schema.fields + [T.StructField(into, match)])
    from pyspark.sql.pandas.types import to_arrow_type

    arrow = to_arrow_type(match)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, texts = shared.value
        items = _prepared(texts, tolerance)
        for batch in batches:
            rows = [(t or "").encode() for t in batch.column(place).to_pylist()]
            for a, b in flat.chunks([len(t) for t in rows]):
                found: list[list] = [[] for _ in range(b - a)]
                for text, item, distance in items.matches(rows[a:b]):
                    found[text].append({"item": names[item], "distance": distance, "words": int(items.sizes[item])})
                yield pa.RecordBatch.from_arrays([*(c.slice(a, b - a) for c in batch.columns), pa.array(found, arrow)], names=schema.names)

    return docs.mapInArrow(flat.trimmed(work), schema)


_kept: dict[tuple, Items] = {}


def _prepared(texts: list[bytes], tolerance: float) -> Items:
    """Items of this process; one group is kept between tasks."""
    key = (hash(tuple(texts)), tolerance)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Items(texts, tolerance)
    return _kept[key]


def contaminated(docs: DataFrame, benchmark: DataFrame, tolerance: float = 0.2, id_col: str = "doc_id") -> DataFrame:
    """Rows ``<id_col>, item_id, distance, n_words`` of documents that hold an item."""
    rows = docs.select(F.col(id_col).alias("_doc"), "text")
    rows = matched(rows, benchmark, tolerance).select("_doc", F.explode("matches").alias("m"))
    return rows.select(F.col("_doc").alias(id_col), F.col("m.item").alias("item_id"), F.col("m.distance").alias("distance"), F.col("m.words").alias("n_words"))
