import hashlib
import random
import re
from collections import defaultdict

from strandweave.llm import exact_dedup, line_dedup, spread, url_filter
from tests.llm.cases import awkward_documents, empty_documents, random_documents

SPACE = "[\x20\x09-\x0d]+"


def test_exact_duplicates_awkward(spark):
    rows = exact_dedup.exact_duplicates(awkward_documents(spark)).collect()
    assert len(rows) == 13
    by_id = defaultdict(list)
    for r in rows:
        by_id[r.doc_id].append(r)
    assert by_id[1][0].group_size == 2 and by_id[1][0].kept  # with the row without an id
    assert {r.keep_id for r in by_id[None]} == {1, None} and {r.kept for r in by_id[None]} == {True, False}
    assert by_id[4][0].keep_id == by_id[5][0].keep_id == 4 and not by_id[5][0].kept
    assert by_id[6][0].text_sha256 == hashlib.sha256(b" ").hexdigest()
    assert sorted(r.group_size for r in by_id[8]) == [1, 2, 2]
    assert exact_dedup.exact_duplicates(empty_documents(spark)).count() == 0


def test_exact_duplicates_hot_and_random(spark):
    docs = random_documents(1, 300, 3, 3) + [(1000 + k, "the same\ttext") for k in range(200)]
    groups = defaultdict(list)
    for i, t in docs:
        groups[re.sub(SPACE, " ", t)].append(i)
    rows = exact_dedup.exact_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in rows} == {
        (i, min(g), len(g), i == min(g), hashlib.sha256(t.encode()).hexdigest()) for t, g in groups.items() for i in g}


def test_lookup_join_hot_and_cold(spark, monkeypatch):
    monkeypatch.setattr(spread, "HOT_KEYS", 3)
    rows = spark.range(1000).selectExpr("id", "cast(cast(if(id < 900, 0, id) as string) as binary) as k")
    lookup = rows.groupBy("k").count().withColumnRenamed("count", "n").where("k <> cast('950' as binary)")
    out = {r.id: r.n for r in spread.lookup_join(rows, lookup, ["k"], "n", rows["id"]).collect()}
    assert len(out) == 1000 and out[5] == 900 and out[901] == 1 and out[950] is None


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("a.net", "/es", "allow"), ("a.net", "/es", "block"), ("org", "", "block"), ("", "/x", "block"), (None, "/", "block")]


def _judge(url, rules):
    m = re.search("://([^/?#]*)([^?#]*)", url or "", re.S)
    host, path = (m.group(1), m.group(2)) if m else ("", "")
    host = "".join(c.lower() if c.isascii() else c for c in host)
    fits = [(len(h) + len(p), len(h), a == "block", h + p) for h, p, a in rules if h is not None and (host == h or host.endswith("." + h)) and path.startswith(p)]
    return host, path, max(fits)[3] if fits else None, "block" if fits and max(fits)[2] else "allow"


def _urls():
    r = random.Random(4)
    hosts = ["www.example.com", "EXAMPLE.com", "x.www.example.com", "b.a.net", "a.net", "net", "com", "q.org", "", "..com", "notexample.com", "é.net"]
    paths = ["", "/", "/en", "/en/", "/en/a/b", "/es/", "/esx", "/es/?q=1", "#f", "/x//y/", "/" + "a/" * 3000]
    urls = [f"http://{r.choice(hosts)}{r.choice(paths)}" for _ in range(300)]
    return urls + [None, "", "no scheme", "://", "a://b://c.net/es/", "http://u@net:80/es/", "http://x.net\n/es/"]


def test_urls_against_every_rule(spark, monkeypatch):
    rows = list(enumerate(_urls())) + [(None, "http://a.net/es/"), (7, "http://a.net/es/"), (7, "http://a.net/es/")]
    want = sorted((str(i), *map(str, _judge(u, RULES))) for i, u in rows)
    pages = spark.createDataFrame([(i, u, "h", "v") for i, u in rows], "page_id long, url string, host string, verdict string")
    rules = spark.createDataFrame(RULES, "host string, path string, action string")
    for most in (url_filter.BROADCAST_RULES, 1):  # broadcast, then shuffled and salted rules
        monkeypatch.setattr(url_filter, "BROADCAST_RULES", most)
        got = url_filter.judge_urls(pages, rules).collect()
        assert sorted((str(r.page_id), r.host, r.path, str(r.rule), r.verdict) for r in got) == want
    none = url_filter.judge_urls(pages, rules.where("1 = 0")).collect()
    assert len(none) == len(rows) and {r.verdict for r in none} == {"allow"}
    assert url_filter.judge_urls(pages.where("1 = 0"), rules).count() == 0


def _key(line):
    line = line.strip("\x20\x09\x0a\x0b\x0c\x0d")
    return "".join(c.lower() if c.isascii() else c for c in line)


def _drop(texts, min_docs, keep_first):
    seen = defaultdict(list)
    for d, t in enumerate(texts):
        for p, line in enumerate((t or "").split("\n")):
            if _key(line):
                seen[_key(line)].append((d, p))
    gone = set()
    for places in seen.values():
        if len({d for d, _ in places}) >= min_docs:
            gone |= set(sorted(places)[1:] if keep_first else places)
    return ["\n".join(x for p, x in enumerate((t or "").split("\n")) if (d, p) not in gone) for d, t in enumerate(texts)], gone


def _line_texts():
    r = random.Random(9)
    pool = ["Menu", " menu ", "MENU\r", "É", "é", "", "  ", "rights reserved", "a", "B"]
    texts = ["\n".join(r.choice(pool + [f"own line {r.randrange(60)}"] * 4) for _ in range(r.randint(1, 8))) for _ in range(80)]
    return texts + ["\n".join(f"l{k}" for k in range(300)) for _ in range(3)] + ["", "\n", "Menu"]


def test_lines_against_brute_force(spark, monkeypatch):
    texts = _line_texts()
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, words string")
    for slot_rows in (line_dedup.SLOT_ROWS, 3):  # hot lines in one slot, then in many
        monkeypatch.setattr(line_dedup, "SLOT_ROWS", slot_rows)
        for keep_first in (False, True):
            want, gone = _drop(texts, 3, keep_first)
            bitmaps = line_dedup.keep_bitmaps(docs, 3, keep_first)
            got = {r.doc_id: r for r in line_dedup.apply_bitmaps(docs, bitmaps).collect()}
            assert [got[i].text for i in range(len(texts))] == want
            assert [got[i]._n_dropped for i in range(len(texts))] == [sum(d == i for d, _ in gone) for i in range(len(texts))]
            assert got[0]._n_lines == texts[0].count("\n") + 1 and got[0].words == "x"


def test_lines_awkward(spark):
    docs = awkward_documents(spark)
    rows = line_dedup.apply_bitmaps(docs, line_dedup.keep_bitmaps(docs, 2)).collect()
    assert len(rows) == 13
    same = [r for r in rows if r.doc_id == 8 and r.text != "other text of eight"]
    assert [(r.text, r._n_lines, r._n_dropped) for r in same] == [("", 1, 1)] * 2  # repeated rows count one by one
    assert [(r.text, r._n_dropped) for r in rows if r.doc_id == 1] == [("", 1)]
    assert [(r.text, r._n_lines) for r in rows if r.doc_id == 4] == [(None, 1)]
    empty = empty_documents(spark)
    assert line_dedup.apply_bitmaps(empty, line_dedup.keep_bitmaps(empty)).count() == 0
