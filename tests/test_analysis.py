from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from strandweave.config import Filling, Settings
from strandweave.plans.analysis import Analysis
from strandweave.sources import lists, star
from tests import simulate

SETTINGS = dict(tree_only=True, pixel_size=3.42, search_radius=342.0, min_distance=0.0, cluster_threshold=25.0, min_class_ratio=-1)


def _staged(spark, particles, **more):
    run = Analysis(spark, Settings(**{**SETTINGS, **more})).use(particles)
    run.find_pairs()
    run.classify()
    run.select()
    run.align()
    return run


def test_simulated_chains_are_found(spark):
    rng = np.random.default_rng(3)
    a = simulate.chain(10, (20, 40, 50), (30, 10, 70), (20, 30, 0), (40, 10, 30), rng, 1.0)
    b = simulate.chain(14, (60, 40, 10), (10, 20, 30), (1500, 0, 0), (-20, -10, -30), rng, 1.0)
    c = simulate.chain(12, (60, 40, 10), (10, 20, 30), (0, 0, 0), (50, 10, -30), rng, 1.0)
    noise = [(rng.uniform(-4000, 4000, 3) + [0, 9000, 0], rng.uniform(0, 180, 3)) for _ in range(30)]
    particles, order = simulate.table(spark, {"100.mrc": a + b + noise, "101.mrc": c}, rng)
    run = _staged(spark, particles)
    run.track()
    chains = [set(map(int, r.posInListVect.split("-"))) for r in run.chains().collect() if r.num >= 5]
    back = {o: k for k, o in enumerate(order)}
    truth = [set(range(0, 10)), set(range(10, 24)), set(range(54, 66))]
    truth = [{back[i] for i in t} for t in truth]
    for t in truth:
        assert any(t == c for c in chains), (t, chains)


def test_missing_particles_are_filled(spark):
    a = simulate.chain(12, (20, 40, 50), (30, 10, 70), (20, 30, 0), (40, 10, 30))
    b = simulate.chain(16, (60, 40, 10), (10, 20, 30), (3000, 0, 0), (50, 10, -30))
    gone = [b[7][0], b[8][0]]
    particles, _ = simulate.table(spark, {"100.mrc": a + b[:7] + b[9:]})
    run = _staged(spark, particles, cluster_threshold=5.0, filling=Filling(2, "max", 0.05))
    run.summarise()
    run.link()
    new = run.particles.where("cls = -100").collect()
    assert len(new) == 2
    for p in gone:
        assert min(np.linalg.norm(np.array([r.x, r.y, r.z]) - p) for r in new) < 1e-2
    longest = max(r.num for r in run.chains().collect())
    assert longest == 16 or longest == 15


def test_side_branches_are_removed(spark):
    a = simulate.chain(10, (20, 40, 50), (30, 10, 70), (20, 30, 0), (40, 10, 30))
    rng = np.random.default_rng(8)
    # a second continuation behind row 5, slightly off the common transform
    pos, rot = a[5]
    off = simulate.chain(2, (24, 44, 54), (33, 12, 73), pos, rot)[1:]
    particles, _ = simulate.table(spark, {"100.mrc": a + off})
    run = _staged(spark, particles, cluster_threshold=8.0)
    run.track()
    gone = {tuple(sorted((r.pairIDX1, r.pairIDX2))) for r in run.removed.collect()}
    assert (5, 10) in gone
    assert run.pairs.groupBy("pairClass", "pairIDX1").count().where("count > 1").isEmpty()
    assert run.pairs.groupBy("pairClass", "pairIDX2").count().where("count > 1").isEmpty()


def test_whole_run_from_file_to_files(spark, tmp_path):
    from strandweave.sources import star

    rng = np.random.default_rng(6)
    b = simulate.chain(9, (60, 40, 10), (10, 20, 30), (0, 0, 0), (50, 10, -30))
    c = simulate.chain(8, (20, 40, 50), (30, 10, 70), (2000, 0, 0), (40, 10, 30))
    particles, _ = simulate.table(spark, {"100.mrc": b[:4] + b[5:] + c, "101.mrc": simulate.chain(7, (60, 40, 10), (10, 20, 30), (5, 5, 5), (0, 0, 10), rng, 1.0)}, rng)
    source = str(tmp_path / "in.star")
    star.write_star(star.from_particles(particles, pixel_size=3.42), source)
    run = Analysis(spark, Settings(**{**SETTINGS, "cluster_threshold": 8.0, "min_distance": 10.0, "filling": Filling(1, "lognorm", 1e-6)}),
                   folder=str(tmp_path / "stages")).read(source).run()
    new = run.particles.where("cls = -100").collect()
    assert min(np.linalg.norm(np.array([r.x, r.y, r.z]) - b[4][0]) for r in new) < 5.0
    assert run.statistics.count() >= 2 and run.statistics.agg({"numPolyMax": "max"}).first()[0] >= 7
    run.write(str(tmp_path / "out"))
    back = star.read_pairs(spark, str(tmp_path / "out" / "allTransforms.star"))
    assert back.count() == run.pairs.count() and back.where("fillUpProb = 1.1").count() == len(new)
    again = Analysis(spark, run.settings, folder=str(tmp_path / "stages")).read(source)
    assert again.find_pairs().count() > 0 and again.classify().where("pairClass > 0").count() > 0


def test_stored_stages_know_their_settings_and_input(spark, tmp_path):
    rng = np.random.default_rng(4)
    parts = {"a": [(rng.uniform(0, 300, 3), rng.uniform(0, 180, 3)) for _ in range(40)]}
    particles, _ = simulate.table(spark, parts)
    folder = str(tmp_path / "run")

    def pairs(frame, **more):
        run = Analysis(spark, Settings(**{**SETTINGS, **more}), folder=folder).use(frame)
        return run.find_pairs()

    first = pairs(particles)
    stamp = lambda: max(p.stat().st_mtime_ns for p in (tmp_path / "run" / "pairs").iterdir())
    made = stamp()
    assert pairs(particles.repartition(3)).count() == first.count() and stamp() == made
    fewer = pairs(particles, search_radius=100.0)
    assert stamp() != made and 0 < fewer.count() < pairs(particles).count()
    assert pairs(particles.where("particle_id < 20")).count() < pairs(particles).count()


def test_everything_a_run_writes(spark, tmp_path):
    rng = np.random.default_rng(3)
    a = simulate.chain(10, (20, 40, 50), (30, 10, 70), (20, 30, 0), (40, 10, 30), rng, 1.0)
    b = simulate.chain(9, (60, 40, 10), (10, 20, 30), (1500, 0, 0), (-20, -10, -30), rng, 1.0)
    particles, _ = simulate.table(spark, {"100.mrc": a + b}, rng)
    table = star.from_particles(particles, pixel_size=3.42)
    noted = replace(table, particles=table.particles.withColumn("note", F.concat(F.lit("of row "), "particle_id")))
    star.write_star(noted, str(tmp_path / "in"))
    run = Analysis(spark, Settings(**{**SETTINGS, "filling": Filling(0, "max")})).read(str(tmp_path / "in"))
    for stage in (run.drop_duplicates, run.find_pairs, run.classify, run.select, run.align, run.summarise, run.track):
        stage()
    run.write(str(tmp_path / "out"))
    back = star.read_star(spark, str(tmp_path / "out/particles.star")).particles
    assert {r.note for r in back.collect()} == {f"of row {k}" for k in range(19)}
    stat = {n: star.read_star(spark, str(tmp_path / f"out/stat/{n}.star")).particles.orderBy("particle_id") for n in ("statPerClass", "statPerPoly", "statDropRibos", "errorEstimate", "dropped")}
    nums = [r.num for r in stat["statPerPoly"].collect()]
    assert nums == sorted(nums, reverse=True) and stat["statPerClass"].count() == run.statistics.count() and stat["dropped"].count() == 0
    assert stat["errorEstimate"].count() == 3 * run.statistics.count()
    for r in run.pairs.where("pairClass > 0").groupBy("pairClass").count().collect():
        assert lists.read_class_table(spark, str(tmp_path / "out/clusters/transforms"), r.pairClass).count() == r["count"]
        inside = run.pairs.where(F.col("pairClass") == r.pairClass).select(F.explode(F.array("pairIDX1", "pairIDX2"))).distinct().count()
        assert star.read_star(spark, str(tmp_path / f"out/clusters/particleCenter/c={r.pairClass}")).particles.count() == inside
