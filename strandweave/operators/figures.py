"""Tables behind the figures; drawing them is left to the plotting tool of choice."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandweave.functions import rotation as R
from strandweave.schema import ANGLE, COORD1, COORD2, EULER1, INSERTED_COLOUR, VECT
from strandweave.session import cut_lineage


def vector_field(pairs: DataFrame, direction=(0.0, 1.0, 0.0), length: float = 20.0) -> DataFrame:
    """Edges with colour, label point and the vector that represents the first particle."""
    colour = F.split("pairClassColour", "-")
    p1, p2 = R.vec_cols(COORD1), R.vec_cols(COORD2)
    q = R.quat_from_zxz(*(F.col(c) for c in EULER1))
    v = R.rotate(q, R.Vec(*(F.lit(float(d) * length) for d in direction)))
    mid = p1.plus(p2.minus(p1).scale(F.lit(0.35)))
    return pairs.select(
        "pairTomoID", "pairTomoName", "pairClass", "pairLabel", "pairIDX1", "pairIDX2", *COORD1, *COORD2,
        *[c.alias("mid" + a) for a, c in zip("XYZ", mid)], *[c.alias("arrow" + a) for a, c in zip("XYZ", v)],
        *[colour[k].cast("double").alias(n) for k, n in enumerate(("red", "green", "blue"))],
        (F.col("pairClassColour") == INSERTED_COLOUR).alias("inserted"))


def first_volumes(pairs: DataFrame, count: int = 5) -> DataFrame:
    """Pairs of the first volumes by id: the preview limit of the vector field."""
    chosen = pairs.select("pairTomoID").distinct().orderBy("pairTomoID").limit(count)
    return pairs.join(chosen, "pairTomoID", "left_semi")


def transform_scatter(pairs: DataFrame, nm_per_pixel: float = 0.342) -> DataFrame:
    """Shifts in nanometres next to the Euler triple."""
    return pairs.select("pairClass", *[(F.col(c) * F.lit(nm_per_pixel)).alias(n) for c, n in zip(VECT, ("x_nm", "y_nm", "z_nm"))],
                        *ANGLE, "pairClassColour")


def histogram(df: DataFrame, group: list[str], value: str, bins: int) -> DataFrame:
    """Equal-width histogram per group; the last bin includes its upper edge."""
    lim = df.groupBy(*group).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi"))
    lim = cut_lineage(lim)
    spot = F.coalesce(F.try_divide(F.col(value) - F.col("_lo"), F.col("_hi") - F.col("_lo")), F.lit(0.0)) * bins
    rows = df.join(lim, group).withColumn("bin", F.least(F.floor(spot), F.lit(bins - 1)))
    return rows.groupBy(*group, "bin").agg(F.count("*").alias("n"))


def link_levels(tree: DataFrame, threshold: float) -> DataFrame:
    """Merge heights of the tree in order and whether they lie below the threshold."""
    return tree.select("merge_no", "height", "size", (F.col("height") < F.lit(float(threshold))).alias("below"))
