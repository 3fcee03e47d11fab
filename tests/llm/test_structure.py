"""Operators 11 to 13 against brute force, and their SQL on awkward tables."""

import hashlib
import heapq
import random
import re
import zlib

import duckdb
import pytest

from strandweave.llm import manifest, queries, repair, shards
from tests.llm.cases import awkward_documents, empty_documents

KINDS = "conv_id long, turn long, role string, text string"


def _rows(frame, columns):
    return sorted((tuple(r) for r in frame.select(*columns).collect()), key=str)


def _by_sql(spark, tmp_path, name, table, frame):
    """Rows of the query and of its SQL over one table."""
    frame.coalesce(1).write.mode("overwrite").parquet(f"{tmp_path}/{table}.parquet")
    db = duckdb.connect()
    db.sql(f"CREATE VIEW {table} AS SELECT * FROM '{tmp_path}/{table}.parquet/*.parquet'")
    want = db.sql(queries.SQL[name])
    got = queries.QUERIES[name](spark, str(tmp_path))
    assert sorted(got.columns) == sorted(want.columns)
    return _rows(got, want.columns), sorted(want.fetchall(), key=str)


# ---------------------------------------------------------------- conversations

def _cheapest(rows):
    """Cheapest and ASCII-least edits by best-first search over whole outputs."""
    heap, best = [(0, "", 0, "")], None
    while heap:
        cost, audit, at, out = heapq.heappop(heap)
        if best and cost > best[0]:
            return best
        if at == len(rows) and re.fullmatch("(s?(ua)+)?", out):
            best = min(best or (cost, audit), (cost, audit))
        if not re.fullmatch("s?(ua)*u?", out):
            continue
        for x in "ua":
            heapq.heappush(heap, (cost + 2, audit + "I", at, out + x))
        if at < len(rows):
            initial, fault = rows[at]
            heapq.heappush(heap, (cost + 3, audit + "D", at + 1, out))
            if fault in "t-":
                extra = fault == "t"
                if initial in ("s", "u", "a"):
                    heapq.heappush(heap, (cost + extra, audit + "K", at + 1, out + initial))
                for x in "ua":
                    heapq.heappush(heap, (cost + 2 + extra, audit + "R", at + 1, out + x))


def test_cheapest_edits_by_enumeration():
    r = random.Random(1)
    for _ in range(400):
        rows = [(r.choice("suaua "), r.choice("---tbd")) for _ in range(r.randint(0, 5))]
        assert repair.repaired("".join(a + b for a, b in rows)) == _cheapest(rows)


def test_fixed_parts_change_nothing(monkeypatch):
    r = random.Random(2)
    for length in (1, 7, 40, 300):
        rows = [(r.choice(["system", "user", "assistant", "tool"]), f"text {k}", r.choice("----tbd")) for k in range(length)]
        out = []
        for pending in (10_000, 5, 1):
            monkeypatch.setattr(repair, "PENDING", pending)
            one = repair._Conversation(1)
            for k, (role, text, fault) in enumerate(rows):
                one.add(k, role, text, fault)
            out.append(one.result())
        assert out[0] == out[1] == out[2]


def _repaired(rows):
    """The contract read row by row: damage, faults, edits."""
    found, seen = {}, {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        mine = found.setdefault(conv, [])
        if code == 0:
            continue
        text = "" if code == 1 else re.sub("[.!?]", "", text) if code == 2 else text
        mine += [(turn is not None, turn or 0, "user" if code == 4 else role, text)] * (2 if code == 3 else 1)
    out = []
    for conv, mine in found.items():
        mine.sort(key=lambda x: (*x[:2], x[2].encode(), x[3].encode()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            full = text.strip(" \t\n\v\f\r")
            faults.append("b" if not full else "d" if (role, text) in seen else "-" if full[-1] in ".!?" else "t")
            seen.add((role, text))
        cost, audit = _cheapest([(x[2][:1] or " ", f) for x, f in zip(mine, faults)])
        lines, at = [], 0
        for letter in audit:
            role, text = ("", "") if letter == "I" else mine[at][2:]
            at += letter != "I"
            if letter in "RI":
                role = "assistant" if lines and lines[-1][0] == "u" else "user"
            if letter != "D":
                lines.append(f"{role}:{text}")
        turns = [x[1] for x in mine if x[0]]
        initials = [x[2][:1] for x in mine]
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("b"), faults.count("d"), faults.count("t"),
                    sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


AWKWARD = [(None, 0, "user", "No name."), (None, None, "assistant", "x"), (1, None, None, None), (1, 3, "user", "late."), (1, 3, "user", "late."), (2, 0, "", "no role."),
           (2, 1, "tool", "é?\n"), (3, 0, "system", "a"), (3, 1, "user", ""), (3, 5, "assistant", "word " * 40_000), (3, 9, "user", "Bye!"), (4, 2, "user", "same."), (4, 2, "assistant", "same."),
           (4, 2, "user", "same."), (-5, 7, "usher", "\t\n")]


def test_repair_awkward(spark, tmp_path):
    r = random.Random(3)
    rows = AWKWARD + [(c, t, r.choice(["system", "user", "assistant", "tool"]), r.choice(["Hi.", "Go on", "Yes!", " ", "Why?"]))
                      for c in range(10, 60) for t in range(r.randint(1, 5)) if r.random() < 0.9]
    frame = spark.createDataFrame([(*x, "mine") for x in rows], f"{KINDS}, fault string")
    got, want = _by_sql(spark, tmp_path, "op11_repair", "conversations", frame)
    assert got == want == _repaired(rows)
    assert queries.QUERIES["op11_repair"](spark, str(tmp_path)).count() == len({x[0] for x in rows})
    assert repair.repair(repair.damaged(frame.where("1 = 0"))).count() == 0


def test_repair_of_one_hot_conversation(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"Turn {k % 700}.") for k in range(3000)] + [(2, 0, "user", "Hi.")]
    got = repair.repair(repair.damaged(spark.createDataFrame(rows, KINDS))).where("conv_id = 1").first()
    assert got.audit.count("K") + got.audit.count("D") + got.audit.count("R") > 2900
    assert got.duplicate > 1800 and got.cost >= 3 * got.duplicate


# ---------------------------------------------------------------- manifest

def _hash(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def _leaf(row):
    return _hash(*["-" if row[c] is None else f"{len(str(row[c]).encode())}:{row[c]}" for c in manifest.COLUMNS])


def _tree(hashes):
    """Root, and per leaf its siblings level by level."""
    paths, level, members = [[] for _ in hashes], list(hashes), [[k] for k in range(len(hashes))]
    while len(level) > 1:
        for a in range(0, len(level), 3):
            run = level[a:a + 3]
            for k in range(len(run)):
                for m in members[a + k]:
                    paths[m].append(("".join(run[:k]), "".join(run[k + 1:])))
        members = [sum(members[a:a + 3], []) for a in range(0, len(level), 3)]
        level = [_hash(*level[a:a + 3]) for a in range(0, len(level), 3)]
    return level[0], paths


def _manifest(rows):
    groups = {}
    for row in rows:
        groups.setdefault(row["source"], []).append(row)
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in names:
        ordered = sorted(groups[s], key=lambda row: (row["doc_id"] is not None, row["doc_id"] or 0, _leaf(row)))
        trees[s] = (ordered, *_tree([_leaf(row) for row in ordered]))
    root, tops = _tree([trees[s][1] for s in names])
    out = []
    for s, top in zip(names, tops):
        ordered, subroot, paths = trees[s]
        for row, path in zip(ordered, paths):
            copy = dict(row)
            if row["doc_id"] is not None and row["text"] is not None and zlib.crc32(str(row["doc_id"]).encode()) % 2 == 0:
                copy["text"] = row["text"].replace("\n", "")
            folded = _leaf(copy)
            for before, after in path + top:
                folded = _hash(before, folded, after)
            out.append((row["doc_id"], _leaf(row), subroot, root, _hash(*[b + a for b, a in path + top]), folded, folded == root))
    return sorted(out, key=str)


def test_manifest_awkward(spark, tmp_path):
    frame = awkward_documents(spark)
    got, want = _by_sql(spark, tmp_path, "op12_manifest", "documents", frame)
    assert len(got) == 13
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    rows = [r.asDict() for r in frame.collect()]
    assert _rows(manifest.manifest(frame, manifest.without_newlines()), columns) == _manifest(rows)
    assert [x for x in got if x not in want] == [] and len(want) == 13
    assert manifest.manifest(empty_documents(spark), manifest.without_newlines()).count() == 0


@pytest.mark.parametrize("height", [1, 2])
def test_manifest_of_many_blocks(spark, monkeypatch, height):
    monkeypatch.setattr(manifest, "HEIGHT", height)
    rows = [{"doc_id": k, "source": f"s{k % 11}" if k > 60 else "hot", "lang": None, "n_chars": k, "text": f"line\n{k}"} for k in range(100)]
    frame = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    columns = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert _rows(manifest.manifest(frame, manifest.without_newlines()), columns) == _manifest(rows)


# ---------------------------------------------------------------- shards

def test_tree_of_gaps():
    r, tree, kept = random.Random(4), shards.Gaps(), []
    for k in range(2000):
        if r.random() < 0.55:
            gap = r.randrange(300)
            tree.add(gap, k)
            kept.append((gap, k))
        else:
            size = r.randrange(320)
            best = min((x for x in kept if x[0] >= size), default=None)
            assert tree.tightest(size) == best
            if best:
                kept.remove(best)
    assert tree.root[3] <= 1.45 * len(kept).bit_length() + 2


def _best_fit(sizes, capacity, n):
    """One group after the other."""
    gaps, out = [], []
    for size in sizes:
        fits = [(g, k) for k, g in enumerate(gaps) if g >= size]
        if not fits and len(gaps) == n or size > capacity:
            return None
        if not fits:
            gaps.append(capacity)
        k = min(fits)[1] if fits else len(gaps) - 1
        gaps[k] -= size
        out.append(k)
    return out


def test_runs_equal_single_steps():
    r = random.Random(5)
    for _ in range(200):
        sizes = sorted((r.choice([1, 2, 3, 5, 8, 13, 40]) for _ in range(r.randint(1, 60))), reverse=True)
        classes = sorted(set(sizes), reverse=True)
        n, capacity = r.randint(1, 9), r.randint(5, 80)
        runs = shards.best_fit(classes, [sizes.count(s) for s in classes], capacity, n)
        want = _best_fit(sizes, capacity, n)
        assert (runs is None) == (want is None)
        if runs:
            flat = [[k for f, k in x if f <= rank][-1] for s, x in zip(classes, runs) for rank in range(sizes.count(s))]
            assert flat == want


def test_shards_awkward_and_hot(spark, tmp_path):
    frame = awkward_documents(spark)
    got, want = _by_sql(spark, tmp_path, "op13_shards", "documents", frame)
    assert got == want and len(got) == 13
    assert shards.sharded(empty_documents(spark), 40).count() == 0
    r = random.Random(6)
    rows = [(k, "copy" * 20) for k in range(500)] + [(1000 + k, "x" * r.randrange(400) + str(k)) for k in range(1000)]
    out = shards.sharded(spark.createDataFrame(rows, "doc_id long, text string"), 7).collect()
    loads = {}
    for x in out:
        loads.setdefault(x.shard, []).append(x)
    assert len({x.shard for x in out if x.doc_id < 1000}) == 1 and sorted(loads) == list(range(7))
    assert all(sorted(x.slot for x in s) == list(range(len(s))) for s in loads.values())
    sizes = sorted(sum(x.size for x in s) for s in loads.values())
    assert sum(sizes) == sum(len(t) + 16 for _, t in rows) and sizes[-2] - sizes[0] <= 500  # the copies are one shard above the average
    assert all(x.text_crc32 == zlib.crc32(dict(rows)[x.doc_id].encode()) for x in out)
