"""Class statistics, chain statistics and overlap tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strandweave.functions import rotation as R
from strandweave.operators.distance import CENTRE_EULER, CENTRE_SHIFT, distance_to_centre
from strandweave.operators.ranking import ranked
from strandweave.schema import ANGLE, CHAIN_STAT_COLUMNS, CLASS_STAT_COLUMNS, VECT
from strandweave.session import cut_lineage, ship_code

_AXES = [(a, b) for i, a in enumerate("wxyz") for b in "wxyz"[i:]]


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def _leading_axis(sums: pd.Series) -> pd.Series:
    """Leading eigenvector of the symmetric 4x4 matrices given by their ten upper elements."""
    upper = np.stack(sums.to_numpy())
    full = np.zeros((len(upper), 4, 4))
    rows, cols = np.triu_indices(4)
    full[:, rows, cols] = upper
    full[:, cols, rows] = upper
    return pd.Series(list(np.linalg.eigh(full)[1][:, :, -1]))


def mean_rotation(df: DataFrame, group: list[str], euler: list[str], names: list[str], *more) -> DataFrame:
    """Mean rotation per group: the leading eigenvector of the summed quaternion products.

    The ten sums combine map-side, so a group of any size costs one row per task; only the groups' own
    4x4 matrices are decomposed.
    """
    ship_code(df.sparkSession)
    q = R.quat_from_zxz(*(F.col(c) for c in euler))
    staged = df.select("*", *q.columns("_q"))
    sums = [F.sum(F.col("_q" + a) * F.col("_q" + b)) for a, b in _AXES]
    agg = staged.groupBy(*group).agg(F.array(*sums).alias("_m"), *more)
    agg = agg.withColumn("_e", _leading_axis("_m"))
    e = R.Quat(*(F.col("_e")[i] for i in range(4)))
    return agg.withColumns(dict(zip(names, R.zxz_from_quat(e)))).drop("_m", "_e")


def class_centres(pairs: DataFrame, group: list[str] = ["pairClass"]) -> DataFrame:
    """Mean shift ``cx cy cz`` and mean rotation ``cphi cpsi ctheta`` per class."""
    means = [F.avg(v).alias(c) for v, c in zip(VECT, CENTRE_SHIFT)]
    return mean_rotation(pairs, group, ANGLE, CENTRE_EULER, *means)


def class_distances(pairs: DataFrame, radius: float, metric: str, centres: DataFrame | None = None) -> DataFrame:
    """Pairs with the three distances to the mean transform of their class.

    The centres are stored first: with their true size known the optimizer broadcasts them, and the pair table is
    not shuffled by a class that may hold a third of it.
    """
    centres = cut_lineage(class_centres(pairs)) if centres is None else centres
    narrow = pairs.join(centres, "pairClass")
    return distance_to_centre(narrow, radius, metric)


def class_statistics(pairs: DataFrame, radius: float, metric: str = "scale2Ang") -> DataFrame:
    """One row per class other than 0, ordered by the number of long chains and the class size."""
    pairs = pairs.where("pairClass <> 0")
    centres = cut_lineage(class_centres(pairs))
    d = class_distances(pairs.select("pairClass", *VECT, *ANGLE), radius, metric, centres)

    def spread(column: str):
        return F.sqrt(F.try_divide(F.sum(F.col(column) * F.col(column)), F.count("*") - 1))

    stats = d.groupBy("pairClass").agg(
        F.count("*").alias("num"),
        spread("vect_distance").alias("stdTransVect"), spread("angle_distance").alias("stdTransAng"),
        F.avg("vect_distance").alias("meanVectDist"), F.avg("angle_distance").alias("meanAngDist"),
        F.avg("cn_distance").alias("meanCNDist"), F.stddev_pop("cn_distance").alias("stdCNDist"),
        F.min("cn_distance").alias("minCNDist"), F.max("cn_distance").alias("maxCNDist"),
        *[F.first(c).alias(n) for c, n in zip(CENTRE_SHIFT + CENTRE_EULER, CLASS_STAT_COLUMNS[16:])],
    )
    joined = stats.join(class_chain_statistics(pairs), "pairClass").withColumnRenamed("pairClass", "classNr")
    weight = (F.col("numPolybg3") + F.col("numPolybg5")) * 10000 + F.col("num")
    return joined.select(*CLASS_STAT_COLUMNS).orderBy(weight.desc(), F.col("classNr").desc())


def chain_sizes(pairs: DataFrame) -> DataFrame:
    """Edges per chain: the integer part of the label names the chain, a fraction marks a side branch."""
    chain = F.col("pairLabel").cast("long")
    main = F.col("pairLabel") == chain
    return pairs.groupBy("pairClass", chain.alias("chain")).agg(
        F.count("*").alias("edges"),
        F.max(F.when(F.col("pairLabel") - chain > 0.05, 1).otherwise(0)).alias("branched"),
        F.min(F.when(main, F.col("pairTomoID"))).alias("_main_tomo"), F.min("pairTomoID").alias("_any_tomo"),
    ).withColumn("tomo", F.coalesce("_main_tomo", "_any_tomo")).drop("_main_tomo", "_any_tomo")


def class_chain_statistics(pairs: DataFrame) -> DataFrame:
    """Numbers of long chains per class; -1 in every column while the class is untracked."""
    sizes = chain_sizes(pairs)
    longest = F.max(F.struct(F.col("edges"), (-F.col("chain")).alias("c"), F.col("tomo"))).alias("_top")
    agg = sizes.groupBy("pairClass").agg(
        F.count(F.when(F.col("edges") > 5, 1)).alias("numPolybg5"),
        F.count(F.when(F.col("edges") > 3, 1)).alias("numPolybg3"),
        F.sum("branched").alias("numBranch"), longest, F.min("chain").alias("_first"))
    columns = {
        "numPolybg5": F.col("numPolybg5"), "numPolybg3": F.col("numPolybg3"), "numBranch": F.col("numBranch"),
        "numPolyMax": F.col("_top.edges"), "tomoNrPolyMax": F.col("_top.tomo"), "polyIDMax": -F.col("_top.c"),
    }
    tracked = F.col("_first") != -1
    return agg.select("pairClass", *[F.when(tracked, c).otherwise(F.lit(-1)).cast("long").alias(n)
                                     for n, c in columns.items()])


def _places(pairs: DataFrame) -> DataFrame:
    """Particles of every chain by main line or side branch and position: the first end of a pair, in row order, that
    stands there; ``_ends`` counts all of them."""
    chain = F.col("pairLabel").cast("long")
    tracked = pairs.where("pairClass not in (0)").select("*", chain.alias("_chain")).where("_chain <> -1")
    side = F.when(F.col("pairLabel") - F.col("_chain") > 0.05, 1).otherwise(0).alias("_side")
    ends = F.array(
        F.struct(F.col("pairPosInPoly1").alias("pos"), F.col("row_no").alias("row"), F.lit(1).alias("end"),
                 F.col("pairIDX1").alias("id"), F.col("pairClass1").alias("cls")),
        F.struct(F.col("pairPosInPoly2").alias("pos"), F.col("row_no").alias("row"), F.lit(2).alias("end"),
                 F.col("pairIDX2").alias("id"), F.col("pairClass2").alias("cls")),
    )
    lines = tracked.select("pairClass", "_chain", side, "pairTomoID", "row_no", F.explode(ends).alias("_end"))
    return lines.groupBy("pairClass", "_chain", "_side", F.col("_end.pos").alias("pos")).agg(
        F.min("_end").alias("_end"), F.count("*").alias("_ends"),
        F.min(F.struct("row_no", "pairTomoID")).alias("_head"))


def chain_members(pairs: DataFrame) -> DataFrame:
    """``(classNr, polyID, pos, particle_id, cls)``: the members of every chain along the longer of its main line and side
    branch, as a long table, so a chain may have any length."""
    places = cut_lineage(_places(pairs))
    lines = places.groupBy("pairClass", "_chain", "_side").agg(F.sum("_ends").alias("_n"))
    best = lines.groupBy("pairClass", "_chain").agg(F.max(F.struct("_n", (-F.col("_side")).alias("s"))).alias("_b"))
    chosen = best.select("pairClass", "_chain", (-F.col("_b.s")).alias("_side"))
    return places.join(chosen, ["pairClass", "_chain", "_side"]).select(
        F.col("pairClass").alias("classNr"), F.col("_chain").alias("polyID"), "pos", F.col("_end.id").alias("particle_id"), F.col("_end.cls").alias("cls"))


def chain_statistics(pairs: DataFrame) -> DataFrame:
    """One row per chain with its members in chain order; the longer of main line and side branch is kept.

    The members stand in one text each, as reports want them; :func:`chain_members` has them as rows.
    """
    per_line = _places(pairs).groupBy("pairClass", "_chain", "_side").agg(
        (F.sum("_ends") / 2).cast("long").alias("edges"), F.count("*").alias("positions"),
        F.array_sort(F.collect_list("_end")).alias("_members"), F.min("_head").alias("_head"))
    best = F.max(F.struct("edges", (-F.col("_side")).alias("s"), "positions", "_members", "_head")).alias("_b")
    chains = per_line.groupBy("pairClass", "_chain").agg(best, F.max("_side").cast("int").alias("hasBranch"))

    def joined(field: str):
        return F.array_join(F.transform(F.col("_b._members"), lambda m: m[field].cast("string")), "-")

    return chains.select(
        F.least("_b.edges", "_b.positions").alias("num"), F.col("_b._head.pairTomoID").alias("tomoNr"),
        F.col("pairClass").alias("classNr"), F.col("_chain").alias("polyID"), "hasBranch",
        joined("cls").alias("confClassVect"), joined("id").alias("posInListVect"),
    ).select(*CHAIN_STAT_COLUMNS)


def chain_lengths(pairs: DataFrame) -> DataFrame:
    """Histogram of chain lengths in particles (edges + 1) per class."""
    sizes = chain_sizes(pairs.where("pairClass > 0")).where("chain <> -1")
    return sizes.groupBy("pairClass", (F.col("edges") + 1).alias("particles")).agg(F.count("*").alias("chains"))


def longest_chains(pairs: DataFrame) -> DataFrame:
    """Edges of the longest chain of every class (smallest id on equal length)."""
    sizes = chain_sizes(pairs.where("pairClass > 0")).where("chain <> -1")
    top = sizes.groupBy("pairClass").agg(F.max(F.struct(F.col("edges"), (-F.col("chain")).alias("c"))).alias("_t"))
    top = top.select("pairClass", (-F.col("_t.c")).alias("chain"))
    return pairs.withColumn("chain", F.col("pairLabel").cast("long")).join(top, ["pairClass", "chain"], "left_semi")


def members(pairs: DataFrame, *keys: str) -> DataFrame:
    """Distinct particles that occur at either end of a pair."""
    return pairs.select(*keys, F.explode(F.array("pairIDX1", "pairIDX2")).alias("particle_id")).distinct()


def class_overlap(pairs: DataFrame) -> DataFrame:
    """Shared particles of every two classes; also the combinations that share none."""
    inside = cut_lineage(members(pairs, "pairClass"))
    sizes = inside.groupBy("pairClass").agg(F.count("*").alias("n"))
    # the classes of one particle are few, so combining them inside an array emits only real overlaps
    per_particle = inside.groupBy("particle_id").agg(F.array_sort(F.collect_list("pairClass")).alias("_c"))
    per_particle = per_particle.where(F.size("_c") > 1)
    first = per_particle.select("_c", F.posexplode("_c").alias("_at", "c1"))
    shared = first.select("c1", F.explode(F.slice("_c", F.col("_at") + 2, F.size("_c"))).alias("c2"))
    shared = shared.groupBy("c1", "c2").agg(F.count("*").alias("overlapRiboNr"))
    # every class, numbered in order, meets the classes behind it by their numbers: an equi-join on narrow rows
    numbered = cut_lineage(ranked(sizes.withColumn("_all", F.lit(0)), ["_all"], ["pairClass"], "_k").drop("_all"))
    total = numbered.count()
    ahead = numbered.where(F.col("_k") < total).select(F.col("pairClass").alias("c1"), F.col("n").alias("riboNr_C1"), F.explode(F.sequence(F.col("_k") + 1, F.lit(total))).alias("_k"))
    combos = ahead.join(numbered.select("_k", F.col("pairClass").alias("c2"), F.col("n").alias("riboNr_C2")), "_k").drop("_k")
    out = combos.join(shared, ["c1", "c2"], "left").fillna(0, ["overlapRiboNr"])
    return out.select(
        F.format_string("c%d_c%d", "c1", "c2").alias("pairClass"), "riboNr_C1", "riboNr_C2", "overlapRiboNr",
        F.bround(F.col("overlapRiboNr") / F.col("riboNr_C1"), 3).alias("overlapRatioOfC1"),
        F.bround(F.col("overlapRiboNr") / F.col("riboNr_C2"), 3).alias("overlapRatioOfC2"),
    )


def dropped_particles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Particles that occur in a pair before the selection and in none after it."""
    return members(before).join(members(after), "particle_id", "left_anti")


def lonely_particles(particles: DataFrame, pairs: DataFrame) -> DataFrame:
    """Particles without any neighbour."""
    return particles.join(members(pairs), "particle_id", "left_anti")


def drop_summary(particles: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """One row of counts: pairs and particles lost by the selection, particles without neighbours."""
    def one(df: DataFrame, name: str) -> DataFrame:
        return df.agg(F.count("*").alias(name))

    kept, was = cut_lineage(members(after)), cut_lineage(members(before))
    counts = [
        one(before, "_pairs_before"), one(after, "keepTransNr"), one(particles, "totalRiboNr"),
        one(kept, "keepRiboNr"), one(was, "_was"), one(was.join(kept, "particle_id", "left_anti"), "dropRelinkRiboNr"),
    ]
    row = counts[0].withColumn("_k", F.lit(0))
    for c in counts[1:]:  # one row each
        row = row.join(c.withColumn("_k", F.lit(0)), "_k")
    return row.select(
        (F.col("_pairs_before") - F.col("keepTransNr")).alias("dropRelinkTransNr"), "keepTransNr",
        "dropRelinkRiboNr", (F.col("totalRiboNr") - F.col("_was")).alias("aloneRiboNr"), "totalRiboNr", "keepRiboNr")


def class_contingency(pairs: DataFrame) -> DataFrame:
    """Ordered particle-class combinations per transform class with the occurrences of either class."""
    counts = cut_lineage(pairs.groupBy("pairClass", "pairClass1", "pairClass2").agg(F.count("*").alias("n")))
    ends = counts.select("pairClass", F.explode(F.array("pairClass1", "pairClass2")).alias("cls"), "n")
    marginal = ends.groupBy("pairClass", "cls").agg(F.sum("n").alias("m"))
    m1 = marginal.select("pairClass", F.col("cls").alias("pairClass1"), F.col("m").alias("n1"))
    m2 = marginal.select("pairClass", F.col("cls").alias("pairClass2"), F.col("m").alias("n2"))
    out = counts.join(m1, ["pairClass", "pairClass1"]).join(m2, ["pairClass", "pairClass2"])
    return out.select("pairClass", "pairClass1", "pairClass2", "n", "n1", "n2",
                      (F.col("n") / (F.col("n1") + F.col("n2"))).alias("share"))
