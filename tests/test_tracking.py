import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.operators import pointers, tracking
from tests import models


def _table(spark, groups):
    """groups: list of (class, tomo, edges)."""
    rows, no = [], 0
    for c, t, edges in sorted(groups, key=lambda g: g[1]):
        for a, b in edges:
            rows.append((no, c, t, f"t{t}", a, b))
            no += 3
    return spark.createDataFrame(
        rows, "row_no long, pairClass int, pairTomoID int, pairTomoName string, pairIDX1 long, pairIDX2 long")


def _expected(groups, depth=1):
    out, offset, no = {}, {}, 0
    for c, t, edges in sorted(groups, key=lambda g: g[1]):
        found = models.chains(edges, depth, offset.get(c, 0))
        second = models.positions(edges, found)
        for r in range(len(edges)):
            out[no] = (*found[r], second[r])
            no += 3
        offset[c] = max(v[0] for v in found.values())
    return out


def _run(df, depth=1):
    rows = tracking.track(df, depth).collect()
    return {r.row_no: (r.chain, r.step, r.flag, r.closing or r.step + 1) for r in rows}


def test_paths_and_rings(spark):
    groups = [
        (1, 0, [(5, 6), (1, 2), (3, 4), (2, 3)]),
        (1, 1, [(10, 11), (11, 12), (12, 10), (20, 21)]),
        (2, 1, [(10, 12)]),
        (1, 2, [(30, 31), (31, 32)]),
    ]
    assert _run(_table(spark, groups)) == _expected(groups)


def _random_groups(rng, loops):
    groups = []
    for t in range(40):
        n = rng.randint(2, 9)
        edges = []
        for _ in range(rng.randint(1, 12)):
            a, b = rng.sample(range(n), 2)
            if not loops and a > b:
                a, b = b, a
            if (a, b) not in edges:
                edges.append((a, b))
        groups.append((rng.choice([1, 2]), t, [(a + 100 * t, b + 100 * t) for a, b in edges]))
    return groups


@pytest.mark.parametrize("seed,loops", [(1, False), (2, False), (3, True), (4, True)])
def test_forks_merges_and_loops(spark, seed, loops):
    groups = _random_groups(random.Random(seed), loops)
    assert _run(_table(spark, groups)) == _expected(groups)


@pytest.mark.parametrize("seed,loops,depth", [(11, False, 2), (12, True, 2), (13, True, 3)])
def test_further_branches(spark, seed, loops, depth):
    groups = _random_groups(random.Random(seed), loops)
    groups += [(1, 50, [(5001, 5002), (5003, 5004), (5002, 5003)]), (2, 51, [(5101, 5103), (5103, 5104), (5102, 5103), (5110, 5111)])]
    assert _run(_table(spark, groups), depth) == _expected_by_depth(groups, depth)


def _expected_by_depth(groups, depth):
    out, offset, no = {}, {}, 0
    for c, t, edges in sorted(groups, key=lambda g: g[1]):
        branched = len({a for a, _ in edges}) < len(edges) or len({b for _, b in edges}) < len(edges)
        found = models.chains(edges, depth if branched else 1, offset.get(c, 0))
        second = models.positions(edges, found)
        for r in range(len(edges)):
            out[no] = (*found[r], second[r])
            no += 3
        offset[c] = max(v[0] for v in found.values())
    return out


def test_parts_walked_in_one_piece():
    """The walker of forked parts against the model, on parts of all shapes."""
    rng = random.Random(14)
    for _ in range(1500):
        n = rng.randint(2, 8)
        edges = list({tuple(rng.sample(range(n), 2)) for _ in range(rng.randint(1, 12))})
        rng.shuffle(edges)
        depth = rng.randint(1, 3)
        part = tracking._Part(*(np.array(x) for x in zip(*edges)))
        for k in range(depth):
            part.walk_round(k)
        order = sorted(set(part.path), key=lambda p: part.place[p])
        got = {r: (order.index(part.path[r]) + 1, part.step[r], part.flag[r]) for r in range(len(edges))}
        assert got == models.chains(edges, depth)


def test_long_chain_in_scrambled_row_order(spark):
    n = 300
    edges = [(i, i + 1) for i in range(n)]
    random.Random(7).shuffle(edges)
    got = _run(_table(spark, [(1, 0, edges)]))
    for k, (a, _) in enumerate(edges):
        assert got[3 * k][:3] == (1, a + 1, 1)


def test_chain_ends(spark):
    groups = [(1, 0, [(1, 2), (2, 3), (2, 4), (8, 9)]), (1, 1, [(20, 21), (21, 20)]), (1, 2, [(30, 31)]),
              (2, 0, [(1, 9)])]
    rows = tracking.chain_ends(_table(spark, groups)).collect()
    got = {(r.pairClass, r.pairIDX): (r.ifWoOut, r.ifWoIn, r.pairLabel, r.polylen_riboNr) for r in rows}
    assert got == {
        (1, 1): (0, 1, 1, 4), (1, 3): (1, 0, 1, 4), (1, 4): (1, 0, 1, 4), (1, 8): (0, 1, 2, 2), (1, 9): (1, 0, 2, 2),
        (1, 30): (0, 1, 4, 2), (1, 31): (1, 0, 4, 2), (2, 1): (0, 1, 1, 2), (2, 9): (1, 0, 1, 2)}


def test_pruning_judges_both_directions_on_the_same_input(spark):
    df = _table(spark, [(1, 0, [(1, 2), (1, 3), (4, 3), (4, 5)])])
    score = F.element_at(F.create_map(*[F.lit(v) for kv in {0: 2.0, 3: 1.0, 6: 0.5, 9: 0.7}.items() for v in kv]), F.col("row_no").cast("int"))
    kept = {r.row_no for r in tracking.best_edges(df.withColumn("cn_distance", score)).collect()}
    # (1,3) wins at 1 but loses at 3; (1,2) loses at 1; (4,5) loses at 4
    assert kept == {6}


def test_best_edges_are_found_without_sorting_all_edges(spark):
    rng = np.random.default_rng(4)
    rows = [(k, int(c), int(a), int(b), float(d)) for k, (c, a, b, d) in enumerate(zip(*(rng.integers(0, n, 300) for n in (2, 12, 12, 4))))]
    df = spark.createDataFrame(rows, "row_no long, pairClass int, pairIDX1 long, pairIDX2 long, cn_distance double")
    best = tracking.best_edges(df)
    top = [{min((r[4], r[0]) for r in rows if (r[1], r[e]) == key)[1] for key in {(r[1], r[e]) for r in rows}} for e in (2, 3)]
    assert {r.row_no for r in best.collect()} == top[0] & top[1]
    assert "SortAggregate" not in best._jdf.queryExecution().executedPlan().toString()


def test_chain_ends_aggregate_by_hash(spark, monkeypatch):
    """The components behind chain ends never sort the edges for a minimum."""
    plans, keep = [], pointers.cut_lineage

    def noted(df):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df)

    monkeypatch.setattr(pointers, "cut_lineage", noted)
    rows = [(0, 1, 0, "t0", 1, 2), (3, 1, 0, "t0", 2, 3), (6, 2, 0, "t0", 1, 3), (9, 1, 1, "t1", 12, 11)]
    df = spark.createDataFrame(rows, "row_no long, pairClass int, pairTomoID int, pairTomoName string, pairIDX1 long, pairIDX2 long")
    ends = {(r.pairClass, r.pairIDX, r.ifWoOut, r.pairLabel, r.polylen_riboNr, r.pairTomoName) for r in tracking.chain_ends(df).collect()}
    assert ends == {(1, 1, 0, 1, 3, "t0"), (1, 3, 1, 1, 3, "t0"), (2, 1, 0, 1, 2, "t0"), (2, 3, 1, 1, 2, "t0"), (1, 12, 0, 2, 2, "t1"), (1, 11, 1, 2, 2, "t1")}
    assert any("HashAggregate" in p for p in plans) and not any("SortAggregate" in p for p in plans)


def test_only_followed_edges_of_a_dense_part_are_walked(spark, monkeypatch):
    """Dense parts against the model; the task that walks a part gets a few edges a particle, not all."""
    rng = random.Random(21)
    groups = []
    for t in range(6):
        n = 14
        edges = [(a, b) for a in range(n) for b in range(n) if (a < b or (t > 3 and a != b)) and rng.random() < 0.7]
        rng.shuffle(edges)
        groups.append((1 + t % 2, t, [(a + 100 * t, b + 100 * t) for a, b in edges]))
    df, sizes, keep = _table(spark, groups), [], tracking.cut_lineage

    def noted(table):
        stored = keep(table)
        if "_part" in stored.columns and "row_no" in stored.columns:
            sizes.append(stored.count())
        return stored

    monkeypatch.setattr(tracking, "cut_lineage", noted)
    assert _run(df, 2) == _expected(groups, 2)
    assert sizes and max(sizes) <= 4 * 14 * 6 < sum(len(edges) for _, _, edges in groups)


@pytest.mark.parametrize("seed,loops,depth", [(31, False, 1), (32, True, 1), (33, True, 2)])
def test_few_edges_of_dense_groups_decide(spark, monkeypatch, seed, loops, depth):
    """Crowds of edges that lead to the same particle: the chains are those of all walks, few edges are linked."""
    rng = random.Random(seed)
    groups = []
    for t in range(12):
        n = rng.randint(5, 14)
        edges = [(a, b) for a in range(n) for b in range(n) if a != b and (loops or a < b) and rng.random() < 0.7]
        edges += [(n + k, rng.randrange(n)) for k in range(25)]  # only starts
        rng.shuffle(edges)
        groups.append((1 + t % 2, t, [(a + 100 * t, b + 100 * t) for a, b in edges]))
    linked, merging = [], tracking._merging_chains
    monkeypatch.setattr(tracking, "_merging_chains", lambda links, *more: linked.append(links.count()) or merging(links, *more))
    if depth > 1:  # parts without forks beside the walked ones
        groups.append((1, 90, [(9001 + k, 9100) for k in range(9)] + [(9100, 9101)] + [(9050 + k, 9101) for k in range(9)]))
    wanted = _expected(groups) if depth == 1 else _expected_by_depth(groups, depth)
    assert _run(_table(spark, groups), depth) == wanted
    assert linked and all(n < 0.9 * sum(len(g[2]) for g in groups) for n in linked)
