"""Pre-tokens of byte-level BPE on flat arrays, and a cache of their ids.

A text is cut where the pattern

    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+

cuts it, by comparing character classes of neighbours instead of running the pattern. Special tokens are cut out
before. Each distinct piece is encoded by the tokenizer library; later ones are found by a 64-bit hash, and every one
of them is compared with the characters of the piece that the hash leads to.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import regex

from strandweave.llm import flat

SPACE, LETTER, NUMBER, OTHER, BLANK = 0, 1, 2, 3, 4
#: Characters and ids kept per worker process, a piece counting as 16 more; beyond, the cache starts anew.
CACHED = 12_000_000
#: The same for pre-tokens of byte-level BPE, which are short and many.
CACHED_BYTES = 36_000_000
_kinds: np.ndarray | None = None


def kinds() -> np.ndarray:
    """Class of every code point; BLANK is U+0020, which may lead a piece."""
    global _kinds
    if _kinds is None:
        table = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, range(0x110000)))
        for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", SPACE)):
            for m in regex.finditer(pattern, every):
                table[m.start():m.end()] = kind
        table[0x20] = BLANK
        _kinds = table
    return _kinds


def _is(codes: np.ndarray, at: np.ndarray, word: str) -> np.ndarray:
    """Whether ``word`` stands at each of ``at``; positions past the end count as no."""
    out = at + len(word) <= len(codes)
    for k, char in enumerate(word):
        out &= codes[np.minimum(at + k, len(codes) - 1)] == ord(char)
    return out


def starts_of(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """First positions of all pieces of the texts ``codes[at[i]:at[i + 1]]``."""
    n = len(codes)
    if not n:
        return np.zeros(0, np.int64)
    kind = kinds()[codes]
    plain = np.where(kind == BLANK, SPACE, kind)
    head = np.zeros(n + 1, bool)
    head[at] = True  # also n
    run = head[:-1].copy()
    run[1:] |= plain[1:] != plain[:-1]
    white = plain == SPACE
    blank_before = np.zeros(n, bool)
    blank_before[1:] = (kind[:-1] == BLANK) & ~head[1:-1]
    begin = run & (white | ~blank_before)
    # the last white space before other characters of the text is not part of the white space before it
    last = np.zeros(n, bool)
    last[:-1] = white[:-1] & ~white[1:] & ~head[1:-1]
    begin |= last
    # contractions: an apostrophe that is a piece by itself takes the letters
    mark = np.flatnonzero((codes == 39) & run & begin)
    mark = mark[mark + 1 < n]
    mark = mark[(plain[mark + 1] == LETTER) & ~head[mark + 1]]
    taken = np.zeros(len(mark), np.int64)
    text_end = at[np.searchsorted(at, mark, "right")]
    for word in ("s", "t", "re", "ve", "m", "ll", "d"):
        fits = (taken == 0) & _is(codes, mark + 1, word) & (mark + 1 + len(word) <= text_end)
        taken[fits] = len(word)
    mark, taken = mark[taken > 0], taken[taken > 0]
    begin[mark + 1] = False
    after = mark + 1 + taken
    begin[after[after < n]] = True
    return np.flatnonzero(begin)


#: Code points of a piece that two 64-bit words hold exactly, 21 bits each.
SHORT = 6


def _packed(codes: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The first ``SHORT`` code points of each piece, one more than the code each, 0 behind its end."""
    padded = np.zeros(len(codes) + SHORT, np.uint64)
    np.add(codes, 1, out=padded[:len(codes)], dtype=np.uint64)
    words = []
    for first in (0, SHORT // 2):
        word = np.where(sizes > first, padded[starts + first], np.uint64(0))
        for k in range(1, SHORT // 2):
            word |= np.where(sizes > first + k, padded[starts + first + k], np.uint64(0)) << np.uint64(21 * k)
        words.append(word)
    return words[0], words[1]


class _Grown:
    """An array that grows at its end by doubling, so that many small additions cost no copies of all."""

    def __init__(self, dtype):
        self.data, self.size = np.zeros(1024, dtype), 0

    def extend(self, values: np.ndarray) -> None:
        end = self.size + len(values)
        if end > len(self.data):
            self.data = np.concatenate([self.data, np.zeros(max(end, 2 * len(self.data)) - len(self.data), self.data.dtype)])
        self.data[self.size:end] = values
        self.size = end


class PieceCache:
    """Ids of pieces. ``encode`` turns a list of pieces into lists of ids."""

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], limit: int = CACHED):
        self.encode, self.limit = encode, limit
        self._clear()

    def _clear(self) -> None:
        self.keys, self.slots = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # sorted hashes and their slots
        kinds = {"starts": np.int64, "lengths": np.int64, "flat": np.int32, "code_starts": np.int64, "code_lengths": np.int64,
                 "codes": np.uint32, "low": np.uint64, "high": np.uint64}
        self.grown = {name: _Grown(kind) for name, kind in kinds.items()}

    def __getattr__(self, name: str) -> np.ndarray:
        """Values by slot (ids and code points: by start); those behind the last one have no meaning."""
        if name == "grown" or name not in self.grown:
            raise AttributeError(name)
        return self.grown[name].data

    @property
    def held(self) -> int:
        return self.grown["flat"].size + self.grown["codes"].size + 16 * len(self.keys)

    def _add(self, keys, codes, starts, sizes, low, high, ids: list[list[int]]) -> None:
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        at = np.searchsorted(self.keys, keys)
        g = self.grown
        self.keys, self.slots = np.insert(self.keys, at, keys), np.insert(self.slots, at, g["starts"].size + np.arange(len(keys)))
        g["starts"].extend(g["flat"].size + flat.offsets_of(lengths)[:-1])
        g["lengths"].extend(lengths)
        g["flat"].extend(np.fromiter((i for x in ids for i in x), np.int32, int(lengths.sum())))
        g["code_starts"].extend(g["codes"].size + flat.offsets_of(sizes)[:-1])
        g["code_lengths"].extend(sizes)
        g["codes"].extend(codes[flat.ragged(starts, sizes)].astype(np.uint32))
        g["low"].extend(low)
        g["high"].extend(high)

    def find(self, codes: np.ndarray, starts: np.ndarray, ends: np.ndarray, text: str) -> np.ndarray:
        """Slots of the pieces ``text[start:end]``, whose code points are ``codes[start:end]``; good until the next call."""
        if self.held > self.limit:
            self._clear()
        sizes = ends - starts
        low, high = _packed(codes, starts, sizes)
        hashes = flat.mix(flat.mix(low) + high * np.uint64(0xD6E8FEB86659FD93))
        long = np.flatnonzero(sizes > SHORT)
        hashes[long] = flat.mixed_hashes(codes, starts[long], ends[long])
        while True:
            keys, first, back = np.unique(hashes, return_index=True, return_inverse=True)
            at = np.minimum(np.searchsorted(self.keys, keys), max(len(self.keys) - 1, 0))
            known = self.keys[at] == keys if len(self.keys) else np.zeros(len(keys), bool)
            moved = self._strangers(codes, starts, sizes, low, high, first, back, at, known)
            if not len(moved):
                break
            hashes[moved] = flat.mix(hashes[moved] + np.uint64(1))  # another piece has this hash: the next place
        new = first[~known]
        if len(new):
            self._add(keys[~known], codes, starts[new], sizes[new], low[new], high[new], self.encode([text[starts[i]:ends[i]] for i in new]))
        return self.slots[np.searchsorted(self.keys, keys)][back]

    def _strangers(self, codes, starts, sizes, low, high, first, back, at, known) -> np.ndarray:
        """Pieces that differ from the kept piece of their hash, or else from the first of the batch."""
        model = first[back]
        other = (sizes != sizes[model]) | (low != low[model]) | (high != high[model])
        rest = np.flatnonzero(~other & (sizes > SHORT) & (model != np.arange(len(model))))
        other[rest[flat.differing(codes, starts[rest], codes, starts[model[rest]], sizes[rest])]] = True
        if known.any():
            here, slots = first[known], self.slots[at[known]]
            wrong = (sizes[here] != self.code_lengths[slots]) | (low[here] != self.low[slots]) | (high[here] != self.high[slots])
            rest = np.flatnonzero(~wrong & (sizes[here] > SHORT))
            wrong[rest[flat.differing(codes, starts[here[rest]], self.codes, self.code_starts[slots[rest]], sizes[here[rest]])]] = True
            if wrong.any():
                keys = np.zeros(len(known), bool)
                keys[np.flatnonzero(known)[wrong]] = True
                other |= keys[back]
        return np.flatnonzero(other)

    def ids(self, slots: np.ndarray) -> np.ndarray:
        return self.flat[flat.ragged(self.starts[slots], self.lengths[slots])]


class ByteTokenizer:
    """Encodes with a tokenizer file of the tokenizers library, a piece at a time."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        added = self.library.get_added_tokens_decoder().values()
        if any(t.lstrip or t.rstrip or t.single_word for t in added):
            raise ValueError("added tokens that take in their surroundings are not supported")
        self.special = sorted((t.content for t in added), key=len, reverse=True)
        self.longest_special = max(map(len, self.special), default=0)
        self._special = regex.compile("|".join(map(regex.escape, self.special))) if self.special else None
        self.cache = PieceCache(lambda pieces: [e.ids for e in self.library.encode_batch_fast(pieces, add_special_tokens=False)], CACHED_BYTES)

    def starts(self, texts: list[str], codes: np.ndarray, at: np.ndarray) -> np.ndarray:
        """First positions of all pieces; a special token is a piece, and the texts around it are texts of their own."""
        spans = []
        if self._special:
            for i, t in enumerate(texts):
                if any(s in t for s in self.special):
                    spans += [(at[i] + m.start(), at[i] + m.end()) for m in self._special.finditer(t)]
        if not spans:
            return starts_of(codes, at)
        low, high = np.array(spans, np.int64).T
        starts = starts_of(codes, np.unique(np.concatenate([at, low, high])))
        inside = np.searchsorted(low, starts, "right") - 1
        inner = (inside >= 0) & (starts > low[inside]) & (starts < high[inside])
        return starts[~inner]

    def slots(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cache slots of all pieces, offsets of the texts in pieces, and lengths of the pieces."""
        codes, at = flat.code_points(texts)
        starts = self.starts(texts, codes, at)
        ends = np.append(starts[1:], len(codes))[:len(starts)]
        return self.cache.find(codes, starts, ends, "".join(texts)), np.searchsorted(starts, at), ends - starts

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts and the offsets of the texts."""
        slots, at, _ = self.slots(texts)
        return self.cache.ids(slots), flat.offsets_of(self.cache.lengths[slots])[at]


_loaded: dict[str, ByteTokenizer] = {}


def tokenizer(path: str) -> ByteTokenizer:
    """The tokenizer of this process; loaded once, with its cache kept between batches and tasks."""
    if path not in _loaded:
        _loaded[path] = ByteTokenizer(path)
    return _loaded[path]
