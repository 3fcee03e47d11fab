import random
import re

from strandweave.llm import minhash
from tests.llm.cases import awkward_documents, empty_documents, random_documents


def brute_force(docs, width, percent):
    sets = {}
    for i, t in docs:
        w = re.findall("[^\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        sets[i] = {tuple(w[k:k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    up = {i: i for i in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    ids = sorted(sets)
    for x in ids:
        for y in ids:
            if x < y and sets[x] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((find(x), find(y)))
                up[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in ids}


def check(spark, docs, width, percent=80):
    rows = minhash.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), width, percent).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in rows} == brute_force(docs, width, percent)


def test_random_copies(spark):
    check(spark, random_documents(3, 250, 30, 60), 2)


def test_family_of_near_copies_in_blocks(spark, monkeypatch):
    """A family around the threshold, with groups and blocks so small that every split happens."""
    monkeypatch.setattr(minhash, "BLOCK", 7)
    monkeypatch.setattr(minhash, "GROUP", 5)
    r = random.Random(5)
    base = [f"b{k}" for k in range(80)]
    docs = []
    for i in range(90):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 4, 6])):
            words[r.randrange(80)] = f"x{r.randrange(10_000)}"
        docs.append((i, " ".join(words)))
    check(spark, docs, 3)


def test_texts_of_equal_polynomials_are_not_linked(spark):
    x = "".join("ab"[bin(k).count("1") % 2] for k in range(1024))
    y = x.translate(str.maketrans("ab", "ba"))
    check(spark, [(1, x), (2, y), (3, f"one two three four {x}"), (4, f"one two three four {y}"), (5, y.upper())], 5)


def test_awkward(spark):
    docs = awkward_documents(spark)
    rows = minhash.near_duplicates(docs, 5).collect()
    assert len(rows) == docs.count()
    got = {(r.doc_id, r.n_shingles): (r.component_id, r.kept) for r in rows}
    assert got[1, 56] == (1, True) and got[2, 56] == (1, False) and got[3, 56] == (1, False)
    assert got[4, 0] == (4, True) and got[5, 0] == (5, True) and got[6, 0] == (6, True)
    assert got[8, 1] == (8, True) and got[None, 56] == (1, False) and got[None, 1] == (None, True)
    assert minhash.near_duplicates(empty_documents(spark)).count() == 0
