import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.llm import decontaminate, flat, html_pages, html_text, quality
from tests.llm.cases import awkward_documents, empty_documents

SF = "/root/testdata/sf0.01"


def _distance(item, text):
    last = [0] * (len(text) + 1)
    for i, a in enumerate(item, 1):
        row = [i]
        for j, b in enumerate(text, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (a != b)))
        last = row
    return min(last)


def _words(text):
    return ("".join(c.lower() if c.isascii() else c for c in text or "")).split()


def test_edit_distance_with_free_ends():
    r = np.random.default_rng(0)
    for _ in range(300):
        item, text = r.integers(0, 5, r.integers(1, 12)).astype(np.uint64), r.integers(0, 5, r.integers(0, 30)).astype(np.uint64)
        assert decontaminate.edit_distance_within(item, text) == _distance(item.tolist(), text.tolist())


def _planted(spark, count):
    r = random.Random(11)
    items = [x.text for x in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect()]
    texts = [x.text for x in spark.read.parquet(f"{SF}/documents.parquet").where("n_chars between 300 and 1500").orderBy("doc_id").limit(60).collect()]
    out = []
    for k in range(count):
        words = items[k % len(items)].split()
        for _ in range(decontaminate.allowed(len(words), 0.2)):
            at = r.randrange(len(words))
            words[at:at + r.choice([0, 1])] = [f"zz{r.randrange(999)}"] if r.random() < 0.7 else []
        around = texts[k % len(texts)].split()
        cut = r.randrange(len(around))
        out.append(" ".join(around[:cut] + words + around[cut:]).encode())
    return items, out


def test_recall_at_the_full_tolerance(spark):
    items, texts = _planted(spark, 1000)
    found = decontaminate.Items([i.encode() for i in items], 0.2)
    hits = set()
    for a, b in flat.chunks([len(t) for t in texts]):
        hits |= {(a + t, i) for t, i, _ in found.matches(texts[a:b])}
    assert sum((k, k % len(items)) in hits for k in range(len(texts))) >= 0.99 * len(texts)


def test_recall_of_passages_at_the_limit():
    """Passages whose distance is exactly the tolerance, per length and kind of edit."""
    r = random.Random(5)
    for size in (5, 6, 10, 15, 18, 20, 30):
        items = [[f"w{r.randrange(10**7)}" for _ in range(size)] for _ in range(20)]
        found, edits = decontaminate.Items([" ".join(i).encode() for i in items], 0.2), decontaminate.allowed(size, 0.2)
        for kind in ("change", "insert", "delete", "any"):
            texts = []
            while len(texts) < 200:
                item = items[len(texts) % 20]
                words = list(item)
                for at in sorted(r.sample(range(size), edits), reverse=True):
                    k = r.choice(("change", "insert", "delete")) if kind == "any" else kind
                    words[at:at + (k != "insert")] = [] if k == "delete" else [f"z{r.randrange(10**7)}"]
                if _distance(item, words) == edits:
                    around = [f"y{r.randrange(10**7)}" for _ in range(40)]
                    texts.append(" ".join(around + words + around).encode())
            hits = {(a + t, i) for a, b in flat.chunks([len(t) for t in texts]) for t, i, _ in found.matches(texts[a:b])}
            assert sum((k, k % 20) in hits for k in range(200)) >= 198, (size, kind)


def test_contamination_against_brute_force(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("n_chars < 1200").orderBy("doc_id").limit(120)
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    items = [(x.item_id, _words(x.text)) for x in bench.collect()]
    want = set()
    for d in docs.collect():
        text = _words(d.text)
        for i, item in items:
            if set(item) & set(text) and (n := _distance(item, text)) <= decontaminate.allowed(len(item), 0.2):
                want.add((d.doc_id, i, n))
    got = {(r.doc_id, r.item_id, r.distance) for r in decontaminate.contaminated(docs, bench).collect()}
    assert want and got == want


def test_contamination_awkward(spark, monkeypatch):
    docs = awkward_documents(spark)
    bench = spark.createDataFrame([(1, "tok3 TOK4 tok5  tok6 tok7 tok8"), (2, "text"), (3, None), (4, ""), (None, "line last"), (2, "text")], "item_id long, text string")
    got = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    want = [(str(d), "1", 0) for d in (1, 2, 3, None)] + [(str(d), "2", 0) for d in (8, 8, 8, None) for _ in range(2)] + [("9", "None", 0)]
    assert got == sorted(want)
    monkeypatch.setattr(decontaminate, "GROUP_BYTES", 16)  # several passes
    again = sorted((str(r.doc_id), str(r.item_id), r.distance) for r in decontaminate.contaminated(docs, bench).collect())
    assert again == got
    assert decontaminate.contaminated(docs, bench.where("1 = 0")).count() == 0
    assert decontaminate.contaminated(empty_documents(spark), bench).count() == 0


def test_expectation_maximisation_recovers_labellers():
    r = np.random.default_rng(2)
    truth = r.random(20_000) < 0.2
    right = np.array([0.95, 0.8, 0.9])
    votes = np.where(r.random((20_000, 3)) < right, truth[:, None], ~truth[:, None]).astype(int) + quality.GOOD
    votes[r.random((20_000, 3)) < 0.3] = quality.NO
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    _, accuracy, share, _ = quality.expectation_maximisation(patterns, counts.astype(float), np.ones(3, bool))
    assert np.abs(accuracy - right).max() < 0.03 and abs(share - 0.2) < 0.02


def test_quality_on_held_out_labels(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))  # 2,000 labels each side
    held = F.col("doc_id") % 2 == 0
    scorer, found = quality.fit(docs, labels.where(~held))
    assert all(a > 0.8 for w in found.values() for a in w.accuracy.values())
    rows = quality.scored(docs.where(held), scorer).join(labels, "doc_id").collect()
    clean = [r for r in rows if r.quality == 1 and r.toxic == 0]
    low, toxic = [r for r in rows if r.quality == 0], [r for r in rows if r.toxic == 1]
    assert sum(r.keep for r in clean) >= 0.97 * len(clean)
    assert sum(not r.keep for r in low) >= 0.9 * len(low)
    assert sum(not r.keep for r in toxic) >= 0.7 * len(toxic)


def test_quality_awkward(spark):
    docs = awkward_documents(spark).withColumnRenamed("kept", "keep")
    labels = spark.createDataFrame([(1, 1, 0), (1, 0, None), (None, 0, 1), (8, 0, 1), (99, None, 1)], "doc_id long, quality int, toxic int")
    votes = {r._doc: r for r in quality.votes_of(docs, labels).collect() if r._doc is not None}
    assert votes[1].bad_label == quality.BAD and votes[1].toxic_label == quality.GOOD and votes[2].bad_label == quality.NO
    for known in (labels, None):
        scorer, _ = quality.fit(docs, known)
        rows = quality.scored(docs, scorer).collect()
        assert len(rows) == 13 and all(r.keep is not None and 0 <= r.bad_score <= 1 for r in rows)
        assert len({r.bad_score for r in rows if r.doc_id in (4, 5)}) == 1
    scorer, _ = quality.fit(empty_documents(spark), None)
    assert quality.scored(empty_documents(spark), scorer).count() == 0


def test_labelled_pages_fit_their_labels():
    for page, states in html_pages.labelled_pages(200, 5_000):
        assert len(html_text.leaves(page)) == len(states)


def test_chain_on_held_out_pages():
    chain = html_text.default_chain()
    right = total = 0
    for page, states in html_pages.labelled_pages(200, 5_000):
        right += sum(a == b for a, b in zip(chain.decode(html_text.leaves(page)), states))
        total += len(states)
    assert right >= 0.975 * total


def test_gradient_and_viterbi_by_enumeration():
    from itertools import product

    r = np.random.default_rng(3)
    ids, at, states = np.array([0, 1, 2, 0, 1]), np.array([0, 2, 3, 5]), np.array([True, False, True])
    w, c, s = r.normal(size=3), r.normal(size=(2, 2)), r.normal(size=2)

    def value(w, c, s):
        unary = np.add.reduceat(w[ids], at[:-1])
        score = {p: s[p[0]] + sum(u for u, q in zip(unary, p) if q) + sum(c[a, b] for a, b in zip(p, p[1:])) for p in product((0, 1), repeat=3)}
        return score[tuple(states.astype(int))] - np.log(sum(np.exp(list(score.values())))), max(score, key=score.get)

    total, g_w, g_c, g_s = html_text.log_likelihood(w, c, s, html_text._Pages([(ids, at, states)]))
    assert abs(total - value(w, c, s)[0]) < 1e-9
    for params, g in ((w, g_w), (c, g_c), (s, g_s)):
        for k in np.ndindex(params.shape):
            params[k] += 1e-6
            up = value(w, c, s)[0]
            params[k] -= 2e-6
            down = value(w, c, s)[0]
            params[k] += 1e-6
            assert abs((up - down) / 2e-6 - g[k]) < 1e-4


def test_decoding_by_enumeration():
    """The states of short pages score as high as the best of all combinations, and count every feature."""
    from itertools import product

    chain = html_text.default_chain()
    pages = [p for p, s in html_pages.labelled_pages(300, 9_000) if 0 < len(s) <= 12]
    assert len(pages) >= 10
    for page in pages:
        blocks = html_text.leaves(page)
        unary = [sum(chain.weights.get(f, 0.0) for f in fs) for fs in html_text.features(blocks)]

        def score(states):
            return (chain.start[states[0]] + sum(u for u, q in zip(unary, states) if q)
                    + sum(chain.change[a, b] for a, b in zip(states, states[1:])))

        best = max(score(x) for x in product((0, 1), repeat=len(blocks)))
        assert abs(score([int(x) for x in chain.decode(blocks)]) - best) < 1e-9


@pytest.mark.parametrize("style,least", [("plain", 0.99), ("hashed", 0.94), ("missing", 0.94), ("misleading", 0.92)])
def test_chain_on_sites_that_name_nothing(style, least):
    chain, hit, found, truth = html_text.default_chain(), 0, 0, 0
    for page, states in html_pages.labelled_pages(150, 50_000, style):
        got = chain.decode(html_text.leaves(page))
        hit, found, truth = hit + sum(a and b for a, b in zip(got, states)), found + sum(got), truth + sum(states)
    assert 2 * hit / (found + truth) >= least


UNNAMED = """<html><body><div class="x1"><ul><li><a href="/a">home</a></li><li><a href="/b">news</a></li></ul></div><div class="css-1q2w3e"><h1>Title of the article here</h1>
<p>First paragraph of a longer text that goes on for some words, and ends here.</p><ul><li>one item of it</li></ul><table><tr><td>cell a</td><td>12</td></tr></table><pre>code here</pre>
<blockquote>A quoted sentence.</blockquote><h2>Second part</h2><p>More prose follows in this second paragraph, also with a number of words.</p></div></body></html>"""


def test_an_article_without_a_speaking_name_is_kept():
    want = ["Title of the article here", "First paragraph of a longer text that goes on for some words, and ends here.", "one item of it", "cell a", "12", "code here",
            "A quoted sentence.", "Second part", "More prose follows in this second paragraph, also with a number of words."]
    assert html_text.default_chain().text(UNNAMED) == "\n\n".join(want)


PAGE = """<!DOCTYPE html><html><head><title>t</title><style>p{a:">"}</style><script>var t="</p><p>no";</script></head><body>
<header><a href=/>Site</a></header><nav><ul><li><a href="/a>b">One</a><li><a href=/b>Two</a></ul></nav><div class="ad">Buy now.</div>
<article><h1>The  title &amp;&nbsp;more</h1><p>First <b>bold<br>text<p>Second &lt;tag&gt; paragraph, with some more words in it.<!-- <p>no --></p>
<div class="advert">Offer of the day!</div><p>Third paragraph here, and that is all.</p></article>
<section class="comments"><p>I like it.</p><p>Me too.</p></section><form><label>Mail</label><button>Go</button></form><footer>&copy; 2020 x &middot; y</footer></body></html>"""


def test_main_text_of_a_page():
    want = "The title & more\n\nFirst bold text\n\nSecond <tag> paragraph, with some more words in it.\n\nThird paragraph here, and that is all."
    assert html_text.default_chain().text(PAGE) == want


def test_main_text_awkward(spark):
    cases = [None, "", "<", "<p", "<article><p>a &am", "plain words only", "<a title='", "</p></p></div>", "<script>x", "<p>" * 3000 + "deep", PAGE, PAGE]
    pages = spark.createDataFrame([(i, None, c, "x") for i, c in enumerate(cases)] + [(None, "u", PAGE, "x")], "page_id long, url string, html string, text string")
    rows = html_text.main_text(pages).collect()
    assert len(rows) == len(cases) + 1 and all(r.n_chars == len(r.text) for r in rows)
    assert {r.text for r in rows if r.page_id in (0, 1, 2, 3, 8)} == {""}
    assert len({r.text for r in rows if r.page_id in (10, 11, None)}) == 1
    assert html_text.main_text(pages.where("1 = 0")).count() == 0


def test_leaves_keep_formulas_fallbacks_and_text_after_stray_quotes():
    def texts(page):
        return [x.text for x in html_text.leaves(page)]

    for name in ("math", "object", "noscript", "svg", "iframe"):
        assert texts(f"<p>before <{name} a=b>inner text</{name}> after</p>") == ["before inner text after"]
    for name in ("script", "style", "template", "textarea"):
        assert texts(f"<p>before <{name} a=b>inner text</{name}> after</p>") == ["before after"]
    assert texts("<p title=Don't>one</p><p>two</p><p title=Can't>three</p>") == ["one", "two", "three"]
    assert texts("<p title=Don't>one</p><p>two</p>") == ["one", "two"]
    assert texts("<p title='never ends>one</p>") == ["one"]
    assert texts("<p title=\"a > b\" class = 'c>d'>one</p><a href=/x?a=\"b\">two</a>") == ["one", "two"]
