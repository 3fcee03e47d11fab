"""Recentring, near-duplicate removal and nearest-neighbour distances."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.operators.ranges import CELL, squared_gap, with_cell, with_touched_cells
from strandweave.session import cut_lineage

XYZ = ["x", "y", "z"]


def recentre(particles: DataFrame, origin: list[str], pixel_size: float | None = None) -> DataFrame:
    """Subtracts the refined origin, given in pixels or, with ``pixel_size``, in Angstrom."""
    if origin[0] not in particles.columns:
        return particles
    scale = F.lit(1.0) if pixel_size is None else F.lit(float(pixel_size))
    return particles.withColumns({a: F.col(a) - F.col(o) / scale for a, o in zip(XYZ, origin)})


def duplicate_losers(particles: DataFrame, min_distance: float, score: str | None = None) -> DataFrame:
    """Ids of the particles that lose against a neighbour within ``min_distance`` of their volume.

    Of two close particles the one with the smaller score loses, the smaller id on equal or missing
    scores: a particle is lost exactly when some neighbour ranks above it, whether or not that
    neighbour survives itself. Two particles in a cube with diagonal ``min_distance`` are always close, so
    a first aggregation leaves one candidate per cube; only those are compared with the points
    around them, which bounds the work per point however dense the copies are.
    """
    rank = F.struct((F.col(score) if score else F.lit(0.0)).alias("s"), F.col("particle_id").alias("i"))
    if min_distance <= 0:  # only particles in one and the same place can be that close
        spots = particles.where(F.lit(min_distance == 0)).select("tomo_id", "particle_id", *XYZ, rank.alias("_rank"))
        tops = spots.groupBy("tomo_id", *XYZ).agg(F.max("_rank").alias("_top"), F.count("*").alias("_n")).where("_n > 1")
        return spots.join(tops, ["tomo_id", *XYZ]).where(F.col("_rank") < F.col("_top")).select("particle_id")
    fine = min_distance / math.sqrt(3.0) * (1.0 - 1e-9)
    pts = with_cell(particles.select("tomo_id", "particle_id", *XYZ, rank.alias("_rank")), XYZ, fine)
    best = F.struct(F.col("_rank").alias("r"), *[F.col(a).alias(a) for a in XYZ])
    tops = cut_lineage(pts.groupBy("tomo_id", *CELL).agg(F.max(best).alias("_t")).select("tomo_id", "_t.*"))
    # tops meet the points around them in cells of twice the distance: at most eight copies of a top, at most 7**3 tops a point
    side = 2.0 * min_distance
    reach = with_touched_cells(tops.select(F.col("tomo_id").alias("_tomo"), F.col("r").alias("_top"), *[F.col(a).alias("t" + a) for a in XYZ]),
                               ["t" + a for a in XYZ], min_distance, side)
    reach = reach.select(F.xxhash64("_tomo", *CELL).alias("_at"), "_tomo", "_top", *["t" + a for a in XYZ])
    around = with_cell(particles.select("tomo_id", *XYZ, rank.alias("_rank")), XYZ, side)
    around = around.select(F.xxhash64("tomo_id", *CELL).alias("_at"), "tomo_id", *XYZ, "_rank")  # one number instead of four keys
    near = squared_gap(XYZ, ["t" + a for a in XYZ])
    beaten = around.join(reach, "_at").where(
        (F.col("tomo_id") == F.col("_tomo")) & (F.col("_rank") > F.col("_top")) & (F.sqrt(near) <= F.lit(float(min_distance))))
    beaten = beaten.select(F.col("_top.i").alias("particle_id")).distinct()
    unbeaten = tops.select(F.col("r.i").alias("particle_id")).join(beaten, "particle_id", "left_anti")
    placed = particles.where(F.col("tomo_id").isNotNull() & F.col("x").isNotNull() & F.col("y").isNotNull() & F.col("z").isNotNull())
    return placed.select("particle_id").join(unbeaten, "particle_id", "left_anti").distinct()


def drop_duplicates_within(
    particles: DataFrame, min_distance: float, score: str | None = None,
) -> tuple[DataFrame, DataFrame]:
    """``(kept, dropped)`` particles."""
    lost = duplicate_losers(particles, min_distance, score)
    return (particles.join(lost, "particle_id", "left_anti"), particles.join(lost, "particle_id", "left_semi"))


def nearest_neighbour(particles: DataFrame, crowd: int = 64) -> DataFrame:
    """Distance of every particle to the closest other one of its volume, exact for any spacing.

    Equal positions are settled by an aggregation. The others are searched in shells with a radius per volume: it begins
    at the spacing of an even spread and is halved until no cell of the volume holds more than ``crowd`` positions or the cells no longer split, then
    particles without a hit are searched again with twice the radius, so only isolated points pay for wide
    searches. Particles with a missing or non-finite coordinate, and those alone in their volume, have no row.
    """
    finite = F.lit(True)
    for a in XYZ:
        finite = finite & F.col(a).isNotNull() & ~F.isnan(F.col(a).cast("double")) & (F.abs(a) < F.lit(float("inf")))
    pts = cut_lineage(particles.select("tomo_id", "particle_id", *XYZ).where(finite & F.col("tomo_id").isNotNull()))
    places = cut_lineage(pts.groupBy("tomo_id", *XYZ).agg(F.count("*").alias("_n")))
    # of one volume the extent is finite and positive, as it has two different places
    extent = F.greatest(*[F.max(a) - F.min(a) for a in XYZ])
    evenly = F.greatest(F.lit(1.0), F.cbrt(F.count("*") / F.lit(float(crowd))))  # where evenly spread cells begin to hold a crowd
    radii = places.groupBy("tomo_id").agg(F.count("*").alias("_places"), (extent / evenly).alias("_r")).where("_places > 1")
    radii = cut_lineage(radii.select("tomo_id", "_r", F.lit(None).cast("long").alias("_busy")))
    while True:
        busy = with_cell(places.join(radii.where("_busy is null or _busy > 0"), "tomo_id"), XYZ, F.col("_r")).groupBy("tomo_id", *CELL).count()
        busy = busy.groupBy("tomo_id").agg(F.max("count").alias("_most"))
        # _busy: places in the fullest cell while the radius is still halved, then 0
        step = radii.join(busy, "tomo_id", "left")
        crowded = F.col("_most") > crowd
        radii = cut_lineage(step.select("tomo_id", F.when(crowded, F.col("_r") / 2).otherwise(F.col("_r")).alias("_r"),
                                        F.when(crowded, F.col("_most")).otherwise(0).alias("_busy")))
        if radii.where("_busy > 0").isEmpty():
            break
    done = [places.where("_n > 1").select("tomo_id", *XYZ, F.lit(0.0).alias("nn_distance"))]
    open_places = cut_lineage(places.where("_n = 1").drop("_n").join(radii.select("tomo_id", "_r"), "tomo_id"))
    other = ["o" + a for a in XYZ]
    while not open_places.isEmpty():
        # every open place of a volume has the same radius
        now = open_places.groupBy("tomo_id").agg(F.first("_r").alias("_r"))
        right = places.join(now, "tomo_id").select("tomo_id", "_r", *[F.col(a).alias("o" + a) for a in XYZ])
        right = with_cell(right, other, F.col("_r")).drop("_r")
        left = with_touched_cells(open_places, XYZ, F.col("_r"), F.col("_r"))
        hit = left.join(right, ["tomo_id", *CELL]).withColumn("_d", F.sqrt(squared_gap(XYZ, other)))
        hit = hit.where((F.col("_d") > 0) & (F.col("_d") <= F.col("_r")))
        found = cut_lineage(hit.groupBy("tomo_id", *XYZ).agg(F.min("_d").alias("nn_distance")))
        done.append(found)
        open_places = cut_lineage(open_places.join(found, ["tomo_id", *XYZ], "left_anti").withColumn("_r", F.col("_r") * 2))
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return pts.join(out, ["tomo_id", *XYZ]).select("particle_id", "tomo_id", "nn_distance")
