import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st

from strandweave.llm import flat, piece_bpe, pieces, token_blocks, token_counts
from strandweave.session import ensure_checkpoint_dir
from tests.llm.cases import LONG, awkward_documents, empty_documents

BYTES, PIECES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
ALPHABET = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "\r\n", "a", "B", "é", "1", "٣", "!", "?", "\xa0", "\u3000", "\x1c", "\x85",
            "日本", "🙂", "\u0301", "don't", "x²", "▁", "<s>", "<0x41>", "<|endoftext|>", "\x00", "the ", "aaa", "=="]
TEXTS = st.lists(st.sampled_from(ALPHABET), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_byte_tokenizer_equals_library(texts):
    tok = pieces.tokenizer(BYTES)
    ids, at = tok.encode(texts)
    want = [e.ids for e in tok.library.encode_batch(texts, add_special_tokens=False)]
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == want


def test_piece_cache_starts_anew(monkeypatch):
    tok = pieces.tokenizer(BYTES)
    tok.cache._clear()
    monkeypatch.setattr(tok.cache, "limit", 5)
    for text in ("one two three four", "five six seven eight nine ten eleven", "one two"):
        assert tok.encode([text])[0].tolist() == tok.library.encode(text).ids


def thue_morse(bits: int) -> tuple[str, str]:
    """Two texts whose polynomial hashes modulo 2**64 are equal for every base."""
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(1 << bits))
    return x, x.translate(str.maketrans("ab", "ba"))


def test_thue_morse_texts_have_their_own_ids():
    x, y = thue_morse(10)
    for enc, want in ((pieces.tokenizer(BYTES), lambda t: pieces.tokenizer(BYTES).library.encode(t).ids),
                      (piece_bpe.encoder(PIECES), lambda t: piece_bpe.encoder(PIECES).library.encode(t, add_bos=True, add_eos=True))):
        ids, at = enc.encode([x, y])
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [want(x), want(y)]
    assert [t.tokens for t in token_counts.build([x, y], pieces.tokenizer(BYTES))] == [len(pieces.tokenizer(BYTES).library.encode(t).ids) for t in (x, y)]


def test_pieces_of_one_hash_are_told_apart(monkeypatch):
    real, mix, tok = flat.mixed_hashes, flat.mix, pieces.tokenizer(BYTES)
    monkeypatch.setattr(flat, "mixed_hashes", lambda values, starts, ends: real(values, starts, ends) & np.uint64(3))
    monkeypatch.setattr(flat, "mix", lambda h: mix(h) & np.uint64(4095))
    tok.cache._clear()
    r = random.Random(8)
    for _ in range(20):
        texts = [" ".join(r.choices(["one", "two", "three", "anna", "hanna", "x" * 40, "y" * 40, "é", "abcdefg", "abcdefh"], k=9)) for _ in range(3)]
        ids, at = tok.encode(texts)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tok.library.encode(t).ids for t in texts]
    tok.cache._clear()


def test_cache_is_bounded_by_what_it_holds():
    enc, r = piece_bpe.encoder(PIECES), random.Random(9)
    for _ in range(30):
        texts = ["".join(chr(r.randrange(0x4E00, 0x9FFF)) for _ in range(2000)) for _ in range(40)]
        ids, at = enc.encode(texts)
        assert enc.cache.held <= pieces.CACHED + 500_000
    assert ids[at[-2]:].tolist() == enc.library.encode(texts[-1], add_bos=True, add_eos=True)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=300))
def test_blocks_round_trip(values):
    ids = np.array(values, np.uint32)
    assert token_blocks.unpack(*token_blocks.pack(ids)).tolist() == values


def test_large_blocks_round_trip():
    ids = np.random.default_rng(1).zipf(1.3, 3 * token_blocks.BLOCK + 5).clip(max=50_000).astype(np.uint32)
    payload, starts = token_blocks.pack(ids)
    assert len(starts) == 4 and (token_blocks.unpack(payload, starts) == ids).all() and len(payload) < 2 * len(ids)


def test_token_files(spark, tmp_path):
    docs = awkward_documents(spark).repartition(3)
    path = f"{ensure_checkpoint_dir(spark)}/{tmp_path.name}"
    token_blocks.write_tokens(docs, path, BYTES, end_id=2)
    rows = sorted(token_blocks.read_documents(spark, path).collect(), key=lambda r: r.start)
    library = pieces.tokenizer(BYTES).library
    want = sorted(((r.doc_id, r.text or "") for r in docs.collect()), key=lambda x: (x[0] is not None, x[0] or 0))
    assert [r.doc_id for r in rows] == [d for d, _ in want]
    start, stream = 0, []
    texts = {}
    for d, t in want:
        texts.setdefault(d, []).append([*library.encode(t, add_special_tokens=False).ids, 2])
    for r in rows:
        ids = next(x for x in texts[r.doc_id] if zlib.crc32(np.array(x, "<u4").tobytes()) == r.ids_crc32)
        assert (r.start, r.n_tokens) == (start, len(ids))
        start += len(ids)
        stream += ids
    assert token_blocks.read_ids(spark, path, 5, len(stream) - 7) == stream[5:-7]
    empty = f"{path}-empty"
    token_blocks.write_tokens(empty_documents(spark), empty, BYTES, end_id=2)
    assert token_blocks.read_documents(spark, empty).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(TEXTS, max_size=5))
def test_piece_encoder_equals_library(texts):
    enc = piece_bpe.encoder(PIECES)
    ids, at = enc.encode(texts)
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == enc.library.encode(texts, add_bos=True, add_eos=True)


def test_rounds_equal_heap_on_long_words(monkeypatch):
    enc = piece_bpe.encoder(PIECES)
    r = random.Random(3)
    words = ["".join(r.choices("abcdet=▁", k=r.randint(2, 200))) for _ in range(200)] + ["a" * 250, "▁" * 251, "=-" * 120]
    symbols = [[enc._symbol(c) for c in w] for w in words]
    assert enc._by_rounds(symbols) == [enc._by_heap(list(s)) for s in symbols]


def test_encoded_awkward(spark):
    docs = awkward_documents(spark)
    sp = piece_bpe.encoder(PIECES).library
    rows = piece_bpe.encoded(docs.withColumnRenamed("kept", "ids"), PIECES, ids_col="ids", decoded_col="decoded").collect()
    assert len(rows) == 13
    for r in rows:
        assert r.ids == sp.encode(r.text or "", add_bos=True, add_eos=True) and r.decoded == sp.decode(r.ids)
    digests = piece_bpe.encoded_digests(docs, PIECES).collect()
    empty = [r for r in digests if r.doc_id == 4][0]
    assert (empty.n_tokens, empty.decoded_sha256) == (2, hashlib.sha256(b"").hexdigest())
    assert piece_bpe.encoded_digests(empty_documents(spark), PIECES).count() == 0


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(ALPHABET), max_size=300).map("".join), st.lists(st.tuples(st.integers(-2, 400), st.integers(-2, 400), TEXTS), max_size=4))
def test_edits_equal_counting_anew(text, edits):
    tok = pieces.tokenizer(BYTES)
    tree = token_counts.build([text], tok)[0]
    for edit in token_counts.valid_edits(edits, len(text)):
        text, _ = token_counts.apply_edit(tree, text, edit, tok)
        fresh = token_counts.build([text], tok)[0]
        assert tree.dump() == fresh.dump() and tree.tokens == fresh.tokens == len(tok.library.encode(text, add_special_tokens=False).ids)
    assert token_counts.CountTree.load(tree.dump()).tokens == tree.tokens


def test_special_tokens_made_and_broken_by_edits():
    tok, text = pieces.tokenizer(BYTES), "hello <|endoftext|> world <|endof and text|> the end " * 3
    assert token_counts.build(["hello <|endoftext|> world"], tok)[0].tokens == 4
    r = random.Random(10)
    for _ in range(300):
        tree, now = token_counts.build([text], tok)[0], text
        for _ in range(6):
            start = r.randrange(len(now) + 1)
            edit = (start, min(len(now), start + r.choice([0, 1, 5, 9])), r.choice(["", "<|endof", "text|>", "<|endoftext|>", "x", " and "]))
            if "<|endof and text|>" in now and r.random() < 0.3:
                start = now.index(" and text|>")
                edit = (start, start + 5, "")
            now, _ = token_counts.apply_edit(tree, now, edit, tok)
            assert tree.tokens == len(tok.library.encode(now, add_special_tokens=False).ids)


def test_an_edit_encodes_its_surroundings_only():
    tok = pieces.tokenizer(BYTES)
    tree = token_counts.build([LONG], tok)[0]
    text, encoded = token_counts.apply_edit(tree, LONG, (100_000, 100_010, "something else"), tok)
    assert encoded < 20 and tree.tokens == len(tok.encode([text])[0])


def test_recounted_awkward(spark):
    docs = awkward_documents(spark).withColumnRenamed("kept", "n_edits")

    def first_word(text):
        return [(0, len(text.split(" ")[0]), "first")] if text else []

    rows = token_counts.recounted(docs, BYTES, first_word).collect()
    tok = pieces.tokenizer(BYTES)
    for r in rows:
        text = r.text or ""
        new = "first" + text[len(text.split(" ")[0]):] if text else ""
        assert (r.n_tokens, r.n_tokens_edited, r.n_edits) == (len(tok.encode([text])[0]), len(tok.encode([new])[0]), int(bool(text)))
    stored = token_counts.with_trees(docs, BYTES)
    again = token_counts.recounted(stored, BYTES, first_word, tree_col="tree").drop("tree").collect()
    assert sorted(map(str, again)) == sorted(map(str, rows))
    assert token_counts.recounted(empty_documents(spark), BYTES, first_word).count() == 0
