"""SentencePiece BPE encoding by vectorised merge rounds.

The normalised text is cut in front of every run of word marks; where no piece of the vocabulary holds a mark
after another character, no merge crosses such a cut. Distinct words of a batch that the worker has not met yet
are merged together: all symbols lie in one flat array, every round finds the best pair rank of each word by a
segmented minimum, merges it at the leftmost place, or at all places that do not overlap if no better or equally
good pair can arise from the merged piece, and closes the gaps, until no pair is left. Words of more than
``LONG`` symbols, where rounds would cost a pass each, take their merges in the same order from a heap.

Defined results: a null or empty text is begin and end id alone; a null id is kept; repeated rows repeat their
result; an empty table gives an empty result; other columns are ignored by :func:`encoded_digests`.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.llm import flat
from strandweave.llm.pieces import PieceCache
from strandweave.session import ship_code

MARK = "▁"
LONG = 256
_SHIFT = 21  # symbols are below 2**21: pieces, then single characters
_NONE = np.iinfo(np.int64).max


class PieceEncoder:
    """Encoder and decoder of one BPE model file with byte fallback, without normalisation rules."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        size = sp.get_piece_size()
        self.begin, self.end = sp.bos_id(), sp.eos_id()
        special = [sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) for i in range(size)]
        self.symbols = {sp.id_to_piece(i): i for i in range(size) if not special[i]}
        if any(sp.is_unused(i) for i in range(size)) or any(MARK in p.lstrip(MARK) for p in self.symbols):
            raise ValueError("the model has unused pieces, or pieces over word borders")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(sp.is_byte(i) for i in self.bytes):
            raise ValueError("the model has no byte fallback")
        self.ids: list[list[int]] = [[i] for i in range(size)]
        scores = {i: sp.get_score(i) for i in self.symbols.values()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}
        pieces = [(p, i) for p, i in self.symbols.items() if len(p) > 1]
        for p, _ in pieces:  # characters that are in pieces but are none themselves
            for char in p:
                self._symbol(char)
        pairs = [(self.symbols[p[:k]] << _SHIFT | self.symbols[p[k:]], i)
                 for p, i in pieces for k in range(1, len(p)) if p[:k] in self.symbols and p[k:] in self.symbols]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([i for _, i in pairs], np.int64)
        self.rank = np.array([order[scores[i]] for _, i in pairs], np.int64)
        # a piece may be merged everywhere at once if its rank is its own and no pair that holds it is as good
        left, right = self.keys >> _SHIFT, self.keys & ((1 << _SHIFT) - 1)
        best_with = np.full(size, _NONE)
        for part in (left, right):
            np.minimum.at(best_with, part[part < size], self.rank[part < size])
        used = np.bincount(np.array([order[scores[i]] for _, i in pieces]), minlength=len(order))
        own = np.array([order.get(scores.get(i), 0) for i in range(size)])
        self.at_once = (used[own] == 1) & (best_with > own)
        self.cache = PieceCache(self._encode_words)

    def _symbol(self, char: str) -> int:
        """Symbol of a character; one without a piece is written as its bytes."""
        at = self.symbols.get(char)
        if at is None:
            at = self.symbols[char] = len(self.ids)
            self.ids.append([self.bytes[b] for b in char.encode("utf-8", "surrogatepass")])
        return at

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of each pair in the pair table, or -1."""
        key = left << _SHIFT | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, at, -1)

    def _encode_words(self, words: list[str]) -> list[list[int]]:
        symbols = [[self.symbols.get(c, -1) if c in self.symbols else self._symbol(c) for c in w] for w in words]
        out: list = [None] * len(words)
        for i, s in enumerate(symbols):
            if len(s) > LONG:
                out[i] = self._by_heap(s)
        short = [i for i in range(len(words)) if out[i] is None]
        for i, s in zip(short, self._by_rounds([symbols[i] for i in short])):
            out[i] = s
        return [[i for s in word for i in self.ids[s]] for word in out]

    def _by_rounds(self, words: list[list[int]]) -> list[list[int]]:
        out = list(words)
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])
        symbol = np.fromiter((s for w in words for s in w), np.int64, len(word))
        while len(symbol) > 1:
            same = word[1:] == word[:-1]
            pair = self._pairs(symbol[:-1], symbol[1:])
            rank = np.where(same & (pair >= 0), self.rank[pair], _NONE)
            starts = np.flatnonzero(np.concatenate([[True], ~same]))
            best = np.minimum.reduceat(np.append(rank, _NONE), starts)
            sizes = np.diff(np.append(starts, len(word)))
            go = (rank != _NONE) & (rank == np.repeat(best, sizes)[:-1])
            at = np.flatnonzero(go)
            done = best == _NONE
            if done.any():
                for k in np.flatnonzero(done):
                    out[word[starts[k]]] = symbol[starts[k]:starts[k] + sizes[k]].tolist()
            if not len(at):
                break
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            # of touching pairs every second one, counted from the first of the run
            begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1] + 1]) | first)
            place = np.arange(len(at)) - np.repeat(begins, np.diff(np.append(begins, len(at))))
            made = self.merged[pair[at]]
            at, made = (x[first | (self.at_once[made] & (place % 2 == 0))] for x in (at, made))
            symbol[at] = made
            keep = np.repeat(~done, sizes)
            keep[at + 1] = False
            symbol, word = symbol[keep], word[keep]
        else:
            if len(symbol):
                out[word[0]] = symbol.tolist()
        return out

    def _by_heap(self, word: list[int]) -> list[int]:
        n = len(word)
        following, before = list(range(1, n + 1)), list(range(-1, n - 1))
        version = [0] * n
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(at: np.ndarray, left: np.ndarray, right: np.ndarray) -> None:
            for i, p in zip(at, self._pairs(left, right)):
                if p >= 0:
                    i = int(i)
                    heapq.heappush(heap, (int(self.rank[p]), i, version[i], version[following[i]], int(self.merged[p])))

        flat_word = np.array(word, np.int64)
        offer(np.arange(n - 1), flat_word[:-1], flat_word[1:])
        while heap:
            _, i, vi, vj, made = heapq.heappop(heap)
            j = following[i]
            if version[i] != vi or j >= n or version[j] != vj:
                continue
            word[i], version[i], version[j] = made, version[i] + 1, -1
            following[i] = following[j]
            if following[i] < n:
                before[following[i]] = i
            near = [k for k in (before[i], i) if k >= 0 and following[k] < n]
            offer(np.array(near, np.int64), np.array([word[k] for k in near], np.int64), np.array([word[following[k]] for k in near], np.int64))
        return [s for s, v in zip(word, version) if v >= 0]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts with begin and end ids, and the offsets of the texts."""
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        codes, at = flat.code_points(marked)
        mark = codes == ord(MARK)
        begin = mark.copy()
        begin[1:] &= ~mark[:-1]
        begin[at[:-1][np.diff(at) > 0]] = True
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], len(codes))[:len(starts)]
        joined = "".join(marked)
        slots = self.cache.find(codes, starts, ends, joined)
        ids = self.cache.ids(slots)
        offsets = flat.offsets_of(self.cache.lengths[slots])[np.searchsorted(starts, at)]
        ids = np.insert(ids, np.column_stack([offsets[:-1], offsets[1:]]).ravel(), np.tile([self.begin, self.end], len(texts)))
        return ids, offsets + 2 * np.arange(len(offsets))

    def decode(self, ids: np.ndarray) -> str:
        return self.library.decode(ids.tolist())


_loaded: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this process, with its cache kept between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = PieceEncoder(path)
    return _loaded[path]


def encoded(docs: DataFrame, model_path: str, text_col: str = "text", ids_col: str | None = None, decoded_col: str | None = None) -> DataFrame:
    """``docs`` with the ids of each text in ``ids_col`` and the decoded text in ``decoded_col`` (each if named)."""
    ship_code(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name not in (ids_col, decoded_col)]
    place = docs.columns.index(text_col)
    new = [T.StructField(ids_col, T.ArrayType(T.IntegerType()))] if ids_col else []
    new += [T.StructField(decoded_col, T.StringType())] if decoded_col else []
    schema = T.StructType(kept + new)
    columns = [docs.columns.index(f.name) for f in kept]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts = [t or "" for t in batch.column(place).to_pylist()]
            for a, b in flat.chunks([len(t) for t in texts]):
                ids, at = enc.encode(texts[a:b])
                out = [batch.column(k).slice(a, b - a) for k in columns]
                if ids_col:
                    out.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
                if decoded_col:
                    out.append(pa.array([enc.decode(ids[x:y]) for x, y in zip(at[:-1], at[1:])], pa.string()))
                yield pa.RecordBatch.from_arrays(out, names=schema.names)

    return docs.mapInArrow(flat.trimmed(work), schema)


def encoded_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``<id_col>, n_tokens, ids_sha256, decoded_sha256``, from ids and decoded texts that stay in the task."""
    ship_code(docs.sparkSession)
    rows = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).alias("_text"))
    schema = T.StructType([rows.schema[id_col], T.StructField("n_tokens", T.LongType()),
                           T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(model_path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            for a, b in flat.chunks([len(t) for t in texts]):
                ids, at = enc.encode(texts[a:b])
                parts = [ids[x:y] for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).slice(a, b - a), pa.array(np.diff(at)),
                    pa.array([hashlib.sha256(p.astype("<u4").tobytes()).hexdigest() for p in parts], pa.string()),
                    pa.array([hashlib.sha256(enc.decode(p).encode()).hexdigest() for p in parts], pa.string())], names=schema.names)

    return rows.mapInArrow(flat.trimmed(work), schema)
