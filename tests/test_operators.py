import itertools
import os
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from strandweave.functions import rotation as R
from strandweave.functions import special
from strandweave.operators import align, assign, compare, distance, fill, fit, geometry, linkage, pairs as P, pointers, preprocess, ranges, ranking, summary
from strandweave.schema import VECT
from tests import models, simulate


def _random_particles(spark, n=60, seed=5, size=300.0, volumes=2):
    rng = np.random.default_rng(seed)
    parts = {f"v{k}": [(rng.uniform(0, size, 3), models.euler(models.zxz(*rng.uniform(-180, 180, 3)))) for _ in range(n)] for k in range(volumes)}
    return simulate.table(spark, parts)[0]


def test_pair_transforms_follow_the_matrices(spark):
    particles = _random_particles(spark)
    rows = {r.particle_id: r for r in particles.collect()}
    got = P.neighbour_transforms(particles, 90.0).collect()
    near = {(i, j) for i, j in itertools.combinations(sorted(rows), 2) if rows[i].tomo_id == rows[j].tomo_id
            and np.linalg.norm([rows[i][c] - rows[j][c] for c in "xyz"]) <= 90.0}
    assert {(r.pairIDX1, r.pairIDX2) for r in got} == near and len(got) == len(near)
    for r in got:
        a, b = rows[r.pairIDX1], rows[r.pairIDX2]
        ra, rb = (models.zxz(p.phi, p.psi, p.theta) for p in (a, b))
        step = np.array([b[c] - a[c] for c in "xyz"])
        assert np.allclose([r.pairTransVectX, r.pairTransVectY, r.pairTransVectZ], ra.T @ step, atol=1e-6)
        assert np.allclose([r.pairInvTransVectX, r.pairInvTransVectY, r.pairInvTransVectZ], -rb.T @ step, atol=1e-6)
        assert np.allclose([r.pairTransAngleZXZPhi, r.pairTransAngleZXZPsi, r.pairTransAngleZXZTheta], models.euler(ra.T @ rb), atol=2e-4)
        assert np.isclose(r.pairAngDist, models.angle(ra.T @ rb), atol=1e-2)


def test_row_order_of_pairs_needs_no_sort_of_them(spark):
    particles = _random_particles(spark, 30).withColumn("particle_id", F.lit(1 << 40) - F.col("particle_id") * 7)
    pairs = P.ordered_transforms(particles, 120.0)
    rows = pairs.select("row_no", "pairTomoID", "pairIDX1", "pairIDX2").collect()
    want = P.neighbour_transforms(particles, 120.0).select("pairTomoID", "pairIDX1", "pairIDX2").collect()
    assert [tuple(r)[1:] for r in sorted(rows)] == sorted(map(tuple, want)) and len({r.row_no for r in rows}) == len(rows) > 50
    plan = pairs.where("pairTomoID = 1").groupBy("pairIDX1").count()._jdf.queryExecution().executedPlan().toString()
    assert "rangepartitioning" not in plan and "ATAN2" not in plan  # nor are columns computed that are not read
    assert pairs.columns == P.with_row_order(P.neighbour_transforms(particles, 120.0)).columns


def test_duplicates_copy_a_particle_to_eight_cells_at_most(spark, monkeypatch):
    copies = []

    def counted(*args):
        copies.append(ranges.with_touched_cells(*args))
        return copies[-1]

    monkeypatch.setattr(preprocess, "with_touched_cells", counted)
    particles = _random_particles(spark, 100)
    lost = {r.particle_id for r in preprocess.duplicate_losers(particles, 40.0).collect()}
    rows = particles.collect()
    want = {min(a.particle_id, b.particle_id) for a, b in itertools.combinations(rows, 2) if a.tomo_id == b.tomo_id
            and np.linalg.norm([a[c] - b[c] for c in "xyz"]) <= 40.0}
    assert lost == want and sum(c.count() for c in copies) <= 8 * len(rows)


def test_result_does_not_depend_on_partitioning(spark):
    particles = _random_particles(spark, 40)
    pick = lambda df: sorted(P.neighbour_transforms(df, 80.0).select("pairIDX1", "pairIDX2", "pairTransVectX").collect())
    assert pick(particles.repartition(1)) == pick(particles.repartition(13, "x"))


@pytest.mark.parametrize("block", [1, 3, 40])
def test_crowded_cells_are_joined_in_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(ranges, "BLOCK", block)
    rng = np.random.default_rng(9)
    rows = [(k, 0, *map(float, rng.uniform(0, 5 if k % 3 else 400, 3))) for k in range(150)] + [(200 + k, 1, 1.0, 1.0, 1.0) for k in range(9)]
    df = spark.createDataFrame(rows, "particle_id long, tomo_id int, x double, y double, z double")
    got = P.range_pairs(df, 30.0).select("particle_id1", "particle_id2", "tomo_id").collect()
    want = {(a[0], b[0], a[1]) for a, b in itertools.combinations(rows, 2) if a[1] == b[1] and np.linalg.norm(np.subtract(a[2:], b[2:])) <= 30}
    assert len(got) == len(want) and {tuple(r) for r in got} == want


def test_copies_for_the_touched_cells_are_not_broadcast(spark):
    df = spark.range(20).selectExpr("id AS particle_id", "0 AS tomo_id", "double(id) AS x", "0d AS y", "0d AS z")  # of known size
    copies = ranges.with_touched_cells(df, P.XYZ, 2.0, 4.0)
    home = ranges.with_cell(df.select("tomo_id", *[F.col(c).alias("o" + c) for c in P.XYZ]), ["ox", "oy", "oz"], 4.0)
    for joined in (copies.join(home, ["tomo_id", *ranges.CELL]), home.join(copies.where("x > 0"), ["tomo_id", *ranges.CELL])):
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_crowded_keys_beyond_the_broadcast(spark, monkeypatch):
    monkeypatch.setattr(ranges, "BLOCK", 2)
    monkeypatch.setattr(ranges, "HOT_KEYS", 4)
    left = spark.range(300).selectExpr("id AS l", "id % if(id < 60, 1, 25) AS k")
    right = spark.range(200).selectExpr("id AS r", "id % 30 AS k")
    got = ranges.block_join(left, right, ["k"], "l", "r").select("l", "r").collect()
    want = left.join(right, "k").select("l", "r").collect()
    assert len(got) == len(want) and set(got) == set(want)


def test_identical_directions_have_no_distance(spark):
    rows = [(k, 10.0, 20.0, 30.0, 0.0, 0.0, 30.0, -10.0, -20.0, -30.0, 0.0, 0.0, -30.0) for k in range(2)]
    names = [*P.VECT, *P.ANGLE, *P.INV_VECT, *P.INV_ANGLE]
    df = spark.createDataFrame(rows, "row_no long, " + ", ".join(f"{n} double" for n in names))
    d = distance.pairwise_distances(distance.transform_poses(df, "row_no"), "row_no", 100.0).first()
    assert abs(d.shift_distance) < 1e-6 and abs(d.angle_distance) < 1e-4


def test_euler_pole_and_zyz(spark):
    df = spark.createDataFrame([(10.0, 20.0, 0.0), (10.0, 20.0, 33.0), (-170.0, 95.0, 179.0)], "phi double, psi double, theta double")
    q = R.quat_from_zxz(F.col("phi"), F.col("psi"), F.col("theta"))
    rows = df.select("*", F.array(*R.zxz_from_quat(q)).alias("e"), F.array(*R.zyz_from_quat(q)).alias("z")).collect()
    assert rows[0].e == [30.0, 0.0, 0.0] and rows[0].z == [0.0, 0.0, -30.0]
    for r in rows[1:]:
        m = models.zxz(r.phi, r.psi, r.theta)
        assert np.allclose(r.e, models.euler(m), atol=2e-4)
        back = models.rz(-r.z[2]) @ models.ry(-r.z[1]) @ models.rz(-r.z[0])
        assert np.allclose(back, m, atol=1e-5)


@pytest.mark.parametrize("score", [None, "score"])
def test_duplicates_in_crowds(spark, score):
    rng = np.random.default_rng(2)
    pts = np.vstack([rng.normal(0, 1.0, (40, 3)), rng.uniform(-60, 60, (60, 3)), np.zeros((5, 3))])
    sc = rng.integers(0, 4, len(pts)).astype(float)
    df = spark.createDataFrame([(i, 0, *map(float, p), float(s)) for i, (p, s) in enumerate(zip(pts, sc))],
                               "particle_id long, tomo_id int, x double, y double, z double, score double")
    lost = set()
    for i, j in itertools.combinations(range(len(pts)), 2):
        if np.linalg.norm(pts[i] - pts[j]) <= 12.0:
            lost.add(i if score is None or sc[i] <= sc[j] else j)
    assert {r[0] for r in preprocess.duplicate_losers(df, 12.0, score).collect()} == lost
    d = {r.particle_id: r.nn_distance for r in preprocess.nearest_neighbour(df, crowd=8).collect()}
    full = np.linalg.norm(pts[:, None] - pts[None], axis=2) + np.diag([1e9] * len(pts))
    assert np.allclose([d[i] for i in range(len(pts))], full.min(axis=1))


def _upgma(d):
    n = len(d)
    groups, merges = {i: [i] for i in range(n)}, []
    while len(groups) > 1:
        best = min((np.mean([d[a, b] for a in groups[i] for b in groups[j]]), i, j) for i, j in itertools.combinations(sorted(groups), 2))
        h, i, j = best
        groups[i] = groups[i] + groups.pop(j)
        merges.append((h, frozenset(groups[i])))
    return merges


def test_average_linkage_equals_the_sequential_algorithm(spark):
    rng = np.random.default_rng(11)
    pts = rng.normal(size=(24, 2))
    d = np.linalg.norm(pts[:, None] - pts[None], axis=2)
    df = spark.createDataFrame([(i, j, float(d[i, j])) for i, j in itertools.combinations(range(24), 2)], "i long, j long, distance double")
    want = _upgma(d)
    merges = linkage.average_linkage(df)
    got = sorted(r.height for r in merges.collect())
    assert np.allclose(got, sorted(h for h, _ in want))
    for threshold in (0.4, 0.9, 1.7):
        clusters = {}
        for r in linkage.cut_tree(merges, threshold).collect():
            clusters.setdefault(r.cluster, set()).add(r.member)
        low = [(h, m) for h, m in want if h < threshold]
        tops = [(h, m) for h, m in low if not any(m < o for _, o in low)]
        expect = {k + 1: set(m) for k, (_, m) in enumerate(sorted(tops, key=lambda t: -t[0]))} if len(low) > 1 else {}
        assert clusters == expect


def test_ranks_and_quantiles_with_a_hot_group(spark):
    rng = np.random.default_rng(0)
    rows = [(1 if k % 3 else 2, float(rng.integers(0, 50)), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g int, v double, id long").repartition(9)
    q = {r.g: r.q for r in ranking.group_quantiles(df, ["g"], "v", "id", [0.0, 0.25, 0.9, 1.0], "q").collect()}
    for g in (1, 2):
        assert np.allclose(q[g], np.percentile([v for h, v, _ in rows if h == g], [0, 25, 90, 100]))
    got = {r.id: r.rank for r in ranking.ranked(df, ["g"], ["v", "id"]).collect()}
    for g in (1, 2):
        order = sorted((v, i) for h, v, i in rows if h == g)
        assert [got[i] for _, i in order] == list(range(1, len(order) + 1))


def test_components_by_group(spark):
    """Every group is a graph of its own, with plain numbers as nodes and edges that come twice."""
    rows = [("x", 1, 2), ("x", 3, 2), ("x", 2, 1), ("x", 7, 8), ("x", 9, 9), ("y", 2, 7), ("y", 8, 1), ("y", 8, 1)]
    df = spark.createDataFrame(rows, "g string, a long, b long")
    got = {(r.g, r.node): r.component for r in pointers.components(df, ("g",)).collect()}
    assert got == {("x", 1): 1, ("x", 2): 1, ("x", 3): 1, ("x", 7): 7, ("x", 8): 7, ("x", 9): 9,
                   ("y", 2): 2, ("y", 7): 2, ("y", 8): 1, ("y", 1): 1}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 7), (7, 3), (20, 21), (30, 31), (31, 30)] + [(100, k) for k in range(101, 140)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.component for r in pointers.components(df).collect()}
    assert {n for n, c in got.items() if c == 1} == {1, 2, 3, 7, 8, 9}
    assert got[21] == 20 and got[31] == 30 and got[139] == 100


def test_fits_recover_the_parameters(spark):
    rng = np.random.default_rng(4)
    x = np.exp(0.5 * rng.normal(size=3000)) * 2.0 + 1.0
    df = spark.createDataFrame([(1, float(v), k) for k, v in enumerate(x)], "g int, v double, id long")
    s, loc, scale = fit.fit_parameters(df, ["g"], "v", "lognorm").first().params
    assert abs(s - 0.5) < 0.08 and abs(loc - 1.0) < 0.25 and abs(scale - 2.0) < 0.3

    def ll(at):
        y = np.log(x - at)
        return -np.log(y.std()) - y.mean()

    assert ll(loc) >= max(ll(loc - 0.02), ll(loc + 0.02)) - 1e-9
    table = fit.fit_distributions(df, ["g"], "v", "id", ["norm", "lognorm", "genFit"]).collect()
    assert table[-1].distribution == "norm" and {r.distribution for r in table} == {"norm", "lognorm", "genFit"}
    border = fit.kde_borders(df, ["g"], "v").first()
    h = x.std(ddof=1) * len(x) ** -0.2
    mass = lambda b: np.mean(special.normal_cdf((b - x) / h) - special.normal_cdf((x.min() - x) / h))
    assert abs(mass(border.border) - 0.05) < 1e-4


def test_probability_functions():
    assert np.isclose(special.gamma_p(2.5, 3.0), 0.6937810816, atol=1e-8)
    assert np.isclose(special.chi2_tail(np.array([3.841458821]), np.array([1]))[0], 0.05, atol=1e-8)
    assert np.isclose(special.digamma(np.array([1.0]))[0], -0.5772156649, atol=1e-9)
    assert np.isclose(special.cdf("norm", np.array([1.96]), (0.0, 1.0))[0], 0.9750021049, atol=1e-9)
    assert np.isclose(special.kolmogorov_tail(np.array([0.1358]), np.array([100]))[0], 0.045, atol=0.01)


def test_assignment_uses_both_directions(spark):
    pairs = P.with_row_order(P.neighbour_transforms(_random_particles(spark, 50), 100.0))
    rows = pairs.collect()
    centres = spark.createDataFrame(
        [(1, 50.0, 20.0, 10.0, 10.0, 20.0, 60.0, 55.0), (2, -40.0, 10.0, 30.0, 90.0, 0.0, 100.0, 50.0)],
        "pairClass int, cx double, cy double, cz double, cphi double, cpsi double, ctheta double, reach double")
    got = {r.row_no: r.pairClass for r in assign.assign_to_centres(pairs, centres, 100.0).collect()}
    for r in rows:
        best = (np.inf, 0)
        for c in centres.collect():
            for v, e in ((P.VECT, P.ANGLE), (P.INV_VECT, P.INV_ANGLE)):
                gap = np.linalg.norm([r[n] - c[k] for n, k in zip(v, ("cx", "cy", "cz"))]) / 200 * 180
                turn = models.angle(models.zxz(*(r[n] for n in e)).T @ models.zxz(c.cphi, c.cpsi, c.ctheta))
                d = (gap + turn) / 2
                if d < c.reach and d < best[0] - 1e-9:
                    best = (d, c.pairClass)
        assert got[r.row_no] == best[1]


def test_shift_image_bounds(spark):
    img = spark.createDataFrame([(i, j, float(10 * i + j)) for i in range(3) for j in range(4)], "i0 int, i1 int, value double")
    got = {(r.i0, r.i1): r.value for r in geometry.shift_image(img, (1, -1), (3, 4)).collect()}
    assert len(got) == 12 and got[(1, 0)] == 1.0 and got[(0, 0)] == 0.0 and got[(2, 3)] == 0.0
    with pytest.raises(RuntimeError):
        geometry.shift_image(img, (3, 0), (3, 4))


def test_tails_grow_past_taken_spots(spark):
    line = simulate.chain(7, (20.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0), (0.0, 0.0, 0.0))
    parts, _ = simulate.table(spark, {"v": [line[0], line[2]]})
    tails = parts.where("particle_id = 0").select(
        F.lit(1).alias("pairClass"), F.col("particle_id").alias("pairIDX"), "tomo_id", *P.XYZ, *P.EULER,
        *[F.lit(v).alias(c) for c, v in zip(fill.CENTRE, (20.0, 0.0, 0.0, 0.0, 0.0, 0.0))])
    out = fill.extend_tails(tails, parts, 100.0, add_num=2).orderBy("step").collect()
    assert [(r.step, r.x, r.last) for r in out] == [(1, 20.0, False), (2, 40.0, False), (3, 60.0, True)]
    assert fill.extend_tails(tails, parts, 300.0, add_num=1).isEmpty()
    backwards = fill.advance(tails, backwards=True).first()
    assert np.isclose(backwards.x, -20.0)


def test_nearest_neighbour_passes_over_missing_coordinates(spark):
    rows = [(1, k, float(k), 0.0, 0.0) for k in range(20)] + [(1, 50, None, 0.0, 0.0), (1, 51, float("nan"), 0.0, 0.0), (1, 52, float("inf"), 0.0, 0.0)]
    rows += [(2, 60 + k, 1000.0 * k * k, 0.0, 0.0) for k in range(4)] + [(3, 90, 0.0, 0.0, 0.0), (None, 91, 0.0, 0.0, 0.0)]
    df = spark.createDataFrame(rows, "tomo_id int, particle_id long, x double, y double, z double")
    got = {r.particle_id: r.nn_distance for r in preprocess.nearest_neighbour(df, crowd=4).collect()}
    assert got == {**{k: 1.0 for k in range(20)}, 60: 1000.0, 61: 1000.0, 62: 3000.0, 63: 5000.0}


def test_near_distances_equal_all_distances_in_reach(spark):
    rng = np.random.default_rng(7)
    rows = [(k, *map(float, rng.normal(0, 40, 3)), *map(float, rng.normal(size=4)), *map(float, rng.normal(0, 40, 3)), *map(float, rng.normal(size=4))) for k in range(60)]
    names = "row_no long, " + ", ".join(f"{p}{a} double" for p in "fb" for a in ("x", "y", "z", "qw", "qx", "qy", "qz"))
    poses = spark.createDataFrame(rows, names)
    near = {(r.i, r.j): r.distance for r in distance.near_distances(poses, "row_no", 35.0, 100.0).collect()}
    every = {(r.i, r.j): r.distance for r in distance.pairwise_distances(poses, "row_no", 100.0).collect()}
    want = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and np.linalg.norm(np.subtract(a[1:4], b[1:4])) <= 35.0}
    assert set(near) == want and all(abs(near[k] - every[k]) < 1e-9 for k in want)


def test_near_undirected_distances_equal_least_of_four(spark):
    rng = np.random.default_rng(8)
    rows = [(k, *map(float, rng.normal(0, 40, 3)), *map(float, rng.normal(size=4)), *map(float, rng.normal(0, 40, 3)), *map(float, rng.normal(size=4))) for k in range(60)]
    rows.append((60, *rows[0][8:15], *rows[0][1:8]))  # the first transform, recorded the other way
    names = "row_no long, " + ", ".join(f"{p}{a} double" for p in "fb" for a in ("x", "y", "z", "qw", "qx", "qy", "qz"))
    poses = spark.createDataFrame(rows, names)
    near = distance.near_undirected_distances(poses, "row_no", 35.0, 100.0).collect()
    every = {(r.i, r.j): r.distance for r in distance.pairwise_distances(poses, "row_no", 100.0).collect()}
    least = {(a[0], b[0]): min(np.linalg.norm(np.subtract(a[s:s + 3], b[t:t + 3])) for s in (1, 8) for t in (1, 8)) for a in rows for b in rows if a[0] < b[0]}
    want = {k: d for k, d in least.items() if d <= 35.0}
    assert len(near) == len(want) and {(r.i, r.j) for r in near} == set(want) and (0, 60) in want
    assert all(abs(r.shift_distance - want[r.i, r.j]) < 1e-9 and abs(r.distance - every[r.i, r.j]) < 1e-9 for r in near)


def test_centres_in_several_passes(spark, monkeypatch):
    pairs = P.with_row_order(P.neighbour_transforms(_random_particles(spark, 40), 120.0)).withColumn("pairClass", (F.col("pairIDX1") % 5 + 1).cast("int"))
    centres = assign.class_radii(pairs, 120.0, "scale2Ang", 60.0)
    for radius_first in (True, False):
        results = []
        for most in (100_000, 2):
            monkeypatch.setattr(assign, "MAX_CENTRES", most)
            out = assign.assign_to_centres(pairs, centres, 120.0, radius_first=radius_first)
            results.append(sorted((r.row_no, r.pairClass, round(r.assign_distance or -1.0, 9)) for r in out.select("row_no", "pairClass", "assign_distance").collect()))
        assert results[0] == results[1] and len({c for _, c, _ in results[0]}) > 2


def test_error_bins_in_pages_and_chunks(spark, monkeypatch):
    """Moments and grids of all pairs against all means, as a table of the product would give them."""
    monkeypatch.setattr(compare, "PAGE", 2)
    monkeypatch.setattr(compare, "CHUNK", 7)
    pairs = P.neighbour_transforms(_random_particles(spark), 120.0).withColumn("pairClass", (F.col("pairIDX1") % 4).cast("int")).repartition(3)
    centres = summary.class_centres(pairs.where("pairClass > 0"))
    inside, lost = pairs.where("pairClass > 0"), pairs.where("pairClass = 0")
    means = centres.collect()
    rows = pairs.select("pairClass", *P.VECT, *P.ANGLE).collect()
    want = {}
    for c in means:
        for r in rows:
            v = np.linalg.norm([r[k] - c[m] for k, m in zip(P.VECT, ("cx", "cy", "cz"))]) / 240 * 180
            a = models.angle(models.zxz(*(r[k] for k in P.ANGLE)).T @ models.zxz(c.cphi, c.cpsi, c.ctheta))
            for m, d in (("vect", v), ("angle", a), ("combined", (v + a) / 2)):
                want.setdefault((c.pairClass, r.pairClass == c.pairClass, m), []).append(d)
    got = {(r.classNr, r.same, r.measure): r for r in compare.error_moments(inside, centres, 120.0, lost=lost).collect()}
    assert set(got) == set(want)
    for k, d in want.items():
        assert got[k].n == len(d) and np.allclose([got[k].lo, got[k].hi, got[k]["mean"], got[k].sd], [min(d), max(d), np.mean(d), np.std(d, ddof=1)], atol=1e-5)
    bins = compare.error_bins(inside, centres, 120.0, lost=lost).cache()
    for k, d in want.items():
        mine = [r for r in bins.collect() if (r.classNr, r.same, r.measure) == k]
        assert np.isclose(sum(r.weight for r in mine), len(d))
        spots = sum(r.weight * (r.lo + r.bin * (r.hi - r.lo) / (r.bins - 1)) for r in mine)
        assert np.isclose(spots / len(d), np.mean(d), atol=1e-5)
    assert compare.error_bins(inside, centres.where("1 = 0"), 120.0).count() == 0


@pytest.mark.parametrize("model,params", [("norm", [1.0, 2.0]), ("expon", [1.0, 2.0]), ("gamma", [2.5, -1.0, 2.0]), ("gamma", [0.3, 0.0, 1.0]), ("gamma", [400.0, 0.0, 1.0]), ("lognorm", [0.6, -1.0, 2.0])])
def test_quantiles_and_densities_belong_to_the_distribution(model, params):
    p = np.linspace(0.001, 0.999, 501)
    q = special.quantile(model, p, params)
    assert np.abs(special.cdf(model, q, params) - p).max() < 1e-12
    if params[0] != 0.3:  # too steep at 0 for a difference quotient
        slope = (special.cdf(model, q + 1e-5, params) - special.cdf(model, q - 1e-5, params)) / 2e-5
        assert np.allclose(slope, special.pdf(model, q, params), rtol=1e-5, atol=1e-7)


@pytest.mark.parametrize("model", ["gamma", "lognorm", "genFit"])
def test_fit_quantiles_and_curves(spark, model):
    rng = np.random.default_rng(6)
    x = rng.gamma(3.0, 2.0, 400)
    df = spark.createDataFrame([(1, k, float(v)) for k, v in enumerate(x)], "g int, k long, v double")
    rows = sorted(fit.fit_quantiles(df, ["g"], "v", "k", [model]).collect(), key=lambda r: r.nth)
    z = np.sort((x - x.mean()) / x.std())
    assert np.allclose([r.observed for r in rows], z, atol=1e-9) and [r.p_observed for r in rows] == [(k + 1) / 400 for k in range(400)]
    inner = slice(20, 380)
    assert np.abs(np.array([r.theoretical for r in rows]) - z)[inner].max() < 0.35
    assert np.abs(np.array([r.p_theoretical for r in rows]) - np.array([r.p_observed for r in rows])).max() < 0.08
    curve = sorted(fit.fit_curves(df, ["g"], "v", "k", [model], points=101).collect(), key=lambda r: r.point)
    xs, ys = np.array([r.x for r in curve]), np.array([r.height for r in curve])
    top = np.percentile(z, 99)
    counts, edges = np.histogram(z, np.linspace(z[0], top, 20))
    area = ((counts[1:] + counts[:-1]) / 2 * np.diff(edges[:-1])).sum()
    assert np.isclose(xs[-1], top) and np.isclose(((ys[1:] + ys[:-1]) / 2 * np.diff(xs)).sum(), area)


def test_distances_are_tallied_in_blocks(spark, monkeypatch):
    """The tallies of both kinds are those of the pairs, in blocks of every size and with blocks in which nothing meets."""
    poses = spark.range(60).select(
        F.col("id").alias("row_no"), *[((F.xxhash64("id", F.lit(c)) % 1000) / s).alias(c) for c, s in (
            ("fx", 20), ("fy", 20), ("fz", 20), ("fqw", 2000), ("fqx", 2000), ("fqy", 2000), ("fqz", 2000),
            ("bx", 20), ("by", 20), ("bz", 20), ("bqw", 2000), ("bqx", 2000), ("bqy", 2000), ("bqz", 2000))])
    poses = poses.withColumn("fx", F.when(F.col("row_no") == 0, 9000.0).otherwise(F.col("fx"))).cache()
    monkeypatch.setattr(distance, "BLOCK", 7)
    for undirected, near in ((False, distance.near_distances), (True, distance.near_undirected_distances)):
        pairs = near(poses, "row_no", 25.0, 300.0)
        wanted = {r[0]: r[1:] for r in pairs.groupBy(F.floor(F.col("distance") / 5)).agg(F.count("*"), F.sum("shift_distance"), F.sum("angle_distance")).collect()}
        got = {r[0]: r[1:] for r in distance.near_bands(poses, "row_no", 25.0, 300.0, undirected).collect()}
        assert got.keys() == wanted.keys() and all(got[k] == pytest.approx(tuple(wanted[k])) for k in wanted)
        spread = near(poses, "row_no", 25.0, 300.0, "mean+1std")
        bands = spread.groupBy(F.least(F.lit(9), F.floor(F.col("distance") * 10))).count()
        assert sorted(map(tuple, bands.collect())) == sorted(map(tuple, distance.near_normalised_bands(poses, "row_no", 25.0, undirected).collect()))


def test_blocks_in_reach_are_stored_once_and_passed_over_twice(spark, monkeypatch):
    """Many blocks of one crowded cell: no transform is written or shuffled once per block it meets."""
    poses = spark.range(900).select(F.col("id").alias("row_no"), *[(F.xxhash64("id", F.lit(c)) % 1000 / s).alias(c) for c, s in zip(
        distance._POSE, [100.0] * 3 + [2000.0] * 4 + [100.0] * 3 + [2000.0] * 4)]).cache()
    monkeypatch.setattr(distance, "BLOCK", 30)
    stored, passes = [], []
    near, tally = distance._near_blocks, distance._tally_near
    monkeypatch.setattr(distance, "_near_blocks", lambda *a: stored.append(near(*a)) or stored[-1])
    monkeypatch.setattr(distance, "_tally_near", lambda *a: passes.append(a) or tally(*a))
    distance.near_normalised_bands(poses, "row_no", 30.0).collect()
    assert len(stored) == 1 and len(passes) == 2
    files = {p.removeprefix("file:") for r in stored[0].select("l_path", "_path").collect() for p in r}
    folder = {os.path.dirname(p) for p in files}
    assert len(folder) == 1 and set(os.listdir(folder.pop())) == {os.path.basename(p) for p in files}
    assert sum(len(np.load(p)) for p in files) == 900


def test_two_means_look_at_all_points_a_few_times(spark, monkeypatch):
    """Rounds go on over the points that may change sides; centres are those of rounds over all points."""
    rng = np.random.default_rng(3)
    shifts = {1: rng.normal(size=(3000, 3)) * 40, 2: rng.uniform(-9, 9, (700, 3)), 3: np.ones((4, 3))}
    rows = [(c, k * 10 + c, *map(float, x)) for c, xs in shifts.items() for k, x in enumerate(xs)]
    pts = spark.createDataFrame(rows, ["pairClass", "row_no", *VECT]).withColumn("pairClass", F.col("pairClass").cast("int")).cache()
    looks = []
    near = align._nearest_of_two
    monkeypatch.setattr(align, "_nearest_of_two", lambda *a: looks.append(1) or near(*a))
    for slab, most in ((align.SLAB, 2), (400, 60)):
        monkeypatch.setattr(align, "SLAB", slab)
        looks.clear()
        got = {r.pairClass: [[r[p + x] for x in "xyz"] for p in "ab"] for r in align._two_means(pts).collect()}
        assert len(looks) <= most
        rounds = 0
        for c, xs in shifts.items():
            a = xs[np.linalg.norm(xs - xs.mean(axis=0), axis=1).argmax()]
            two = np.stack([a, xs[np.linalg.norm(xs - a, axis=1).argmax()]])
            while True:
                second = np.linalg.norm(xs - two[1], axis=1) < np.linalg.norm(xs - two[0], axis=1)
                new = np.stack([xs[m].mean(axis=0) if m.any() else old for m, old in zip((~second, second), two)])
                rounds, moved, two = rounds + 1, np.abs(new - two).max(), new
                if moved < 1e-9:
                    break
            assert np.allclose(got[c], two, atol=1e-7)
        assert slab != 400 or len(looks) < rounds


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_directions_do_not_shuffle_the_pairs(spark):
    pairs = P.ordered_transforms(_random_particles(spark), 90.0).withColumn("pairClass", F.col("pairIDX1") % 2).localCheckpoint()
    means = pairs.groupBy("pairClass").agg(*[F.avg(v).alias("m" + a) for v, a in zip(VECT, "xyz")])
    out = align.swap_towards(pairs, means)
    assert "Exchange hashpartitioning" not in _plan(out)
    assert out.count() == pairs.count()


def test_ranks_and_fits_do_not_shuffle_rows_for_small_tables(spark, monkeypatch):
    rows = spark.range(400).select((F.col("id") % 3).alias("g"), (F.xxhash64("id") % 1000 / 7.0).alias("v"), F.col("id").alias("row")).localCheckpoint()
    assert "SortMergeJoin" not in _plan(ranking.ranked(rows, ["g"], ["v", "row"]))
    stored, cut = [], fit.cut_lineage
    monkeypatch.setattr(fit, "cut_lineage", lambda df: stored.append(cut(df)) or stored[-1])
    out = fit.fit_distributions(rows, ["g"], "v", "row", ["expon"])
    assert out.count() == 3
    fit.fit_quantiles(rows, ["g"], "v", "row", ["norm"]).count()
    assert max(df.count() for df in stored) < 400  # the scores are stored once, by the ranking


def test_missing_pairs_shuffle_ids_only(spark):
    before = spark.createDataFrame([(1, 2, 5), (3, 2, 6), (4, 5, 7), (2, 1, 8)], "pairIDX1 long, pairIDX2 long, pairClass int")
    after = spark.createDataFrame([(2, 1, 0), (2, 3, 0), (2, 3, 0)], "pairIDX1 long, pairIDX2 long, pairClass int")
    lost = compare.missing_pairs(before.hint("merge"), after)
    assert [tuple(r) for r in lost.collect()] == [(4, 5, 7)]
    assert "HashAggregate" not in _plan(lost)


def test_class_agreement_shuffles_a_pair_once(spark):
    left = spark.createDataFrame([(1, 2, 1), (2, 1, 1), (3, 4, 2), (5, 6, 1)], "pairIDX1 long, pairIDX2 long, pairClass int")
    right = spark.createDataFrame([(2, 1, 7), (4, 3, 7), (6, 5, 0), (8, 9, 9)], "pairIDX1 long, pairIDX2 long, pairClass int")
    out = compare.class_agreement(left, right)
    got = {r.pairClass: (r.recall, r.precision) for r in out.collect()}
    assert got == {7: (100.0, 50.0), 9: (0.0, 0.0)}
    assert not re.search(r"hashpartitioning\(_lo#\d+L, _hi#\d+L, (std|cmp)", _plan(out))


def test_rounding_in_plain_arithmetic(spark):
    """Halves go to even or away from zero, nothing comes out as a negative zero, and no decimal number is made."""
    rows = spark.createDataFrame([(0.03125,), (-0.03125,), (0.09375,), (1.00004,), (-1e-9,), (float("nan"),), (None,)], "v double")
    out = rows.select(R.round_half_even(F.col("v")), R.round_half_up(F.col("v"), 4))
    got = [tuple(r) for r in out.collect()]
    assert got[:5] == [(0.0312, 0.0313), (-0.0312, -0.0313), (0.0938, 0.0938), (1.0, 1.0), (0.0, 0.0)]
    assert str(got[4][0]) == "0.0" and all(v != v for v in got[5]) and got[6] == (None, None)
    assert "bround" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_transforms_are_compiled(spark):
    """A session without a limit of its own gets one at which the JVM compiles the generated methods."""
    spark.conf.unset("spark.sql.codegen.hugeMethodLimit")
    columns = {"particle_id": "long", "tomo_id": "int", "tomo_name": "string", **dict.fromkeys(P.XYZ + P.EULER, "double"), "cls": "int", "psf": "string"}
    P.neighbour_transforms(spark.createDataFrame([], ", ".join(f"{n} {t}" for n, t in columns.items())), 300.0)
    assert int(spark.conf.get("spark.sql.codegen.hugeMethodLimit")) <= 8000


def test_interpolated_ends_needs_no_distances(spark, tmp_path, monkeypatch):
    """The query reads class centres only; the distances of all pairs to them are not computed."""
    from strandweave.plans import catalog

    rng = np.random.default_rng(3)
    rows = [(k, k % 2, [float(v) for v in rng.normal(0, 0.15, 7)]) for k in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))

    def unwanted(*args, **kwargs):
        raise AssertionError("a pass over all pairs that nothing reads")

    monkeypatch.setattr(summary, "class_statistics", unwanted)
    out = catalog.interpolated_ends(spark, str(tmp_path)).collect()
    assert {r.direction for r in out} <= {"tail", "head"}
