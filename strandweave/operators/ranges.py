"""Three-dimensional range joins as equi-joins on grid cells.

Spark has no spatial join. One side keeps the cell its point falls in; the other side is copied to every
cell its search ball touches. Any two points within the radius then meet in exactly one cell, so the
equi-join needs neither a de-duplication nor a cross product, and a crowded group (a volume that holds a
third of all rows) is cut into as many join keys as it has cells. With a cell side of twice the radius a
point is copied at most eight times. A crowded cell is cut further, into blocks of both sides that meet one by
one (:func:`block_join`), so no key holds more than a block of each.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandweave.session import cut_lineage

#: Rows of one side that may share a join key.
BLOCK = 4096
#: Crowded keys looked up by broadcast; a key beyond them has less than a 10,000th of the rows of crowded keys.
HOT_KEYS = 10_000

CELL = ["_cx", "_cy", "_cz"]
_SLACK = 1.0 + 1e-9  # keeps a point exactly on the radius inside the touched cells


def _floor(c: Column, side: float | Column) -> Column:
    return F.floor(c / (side if isinstance(side, Column) else F.lit(float(side))))


def with_cell(df: DataFrame, xyz: list[str], side: float | Column) -> DataFrame:
    """Adds the cell of the point."""
    return df.withColumns({name: _floor(F.col(axis), side) for name, axis in zip(CELL, xyz)})


def with_touched_cells(df: DataFrame, xyz: list[str], radius: float | Column, side: float | Column) -> DataFrame:
    """One copy of the row per cell the ball of ``radius`` around the point touches.

    The optimizer takes the copies for as small as the rows they come from and would send them to the driver for a
    broadcast, so a join with them is asked to be a sort-merge join.
    """
    reach = (F.lit(float(radius)) if not isinstance(radius, Column) else radius) * F.lit(_SLACK) + F.lit(1e-9)
    for name, axis in zip(CELL, xyz):
        span = F.sequence(_floor(F.col(axis) - reach, side), _floor(F.col(axis) + reach, side))
        df = df.withColumn(name, F.explode(span))
    return df.hint("merge")


def squared_gap(a: list[str], b: list[str]) -> Column:
    terms = [(F.col(p) - F.col(q)) * (F.col(p) - F.col(q)) for p, q in zip(a, b)]
    return terms[0] + terms[1] + terms[2]


def gap(a: list[str], b: list[str]) -> Column:
    return F.sqrt(squared_gap(a, b))


def block_join(left: DataFrame, right: DataFrame, keys: list[str], left_id: str, right_id: str) -> DataFrame:
    """Inner equi-join in which a key with many rows on either side is dealt out in blocks.

    A counting pass finds the keys whose sides are larger than ``BLOCK``. Such a key's rows fall into blocks by the hash
    of their id, every left block meets every right block under a key of its own, and each pair of rows meets once.
    """
    sides = left.groupBy(*keys).agg(F.count("*").alias("_nl")).join(right.groupBy(*keys).agg(F.count("*").alias("_nr")), keys)
    crowded = sides.where(F.greatest("_nl", "_nr") > BLOCK)
    crowded = cut_lineage(crowded.select(*keys, *[F.ceil(F.col(n) / BLOCK).cast("int").alias(k) for n, k in (("_nl", "_kl"), ("_nr", "_kr"))], (F.col("_nl") + F.col("_nr")).alias("_n")))
    known = crowded.agg(F.count("*"), F.sum("_n")).first()
    if not known[0]:
        return left.join(right, keys)
    rows = []
    for side, own, other, count, id_col in ((left, "_bl", "_br", ("_kl", "_kr"), left_id), (right, "_br", "_bl", ("_kr", "_kl"), right_id)):
        spread = _with_crowded(side, crowded, keys, known).withColumn(own, F.when(F.col("_n").isNull(), 0).otherwise(F.pmod(F.xxhash64(id_col), F.col(count[0]))))
        spread = spread.withColumn(other, F.explode(F.when(F.col("_n").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col(count[1]) - 1))))
        rows.append(spread.withColumns({b: F.col(b).cast("int") for b in ("_bl", "_br")}).drop("_kl", "_kr", "_n"))
    return rows[0].join(rows[1], [*keys, "_bl", "_br"]).drop("_bl", "_br")


def _with_crowded(rows: DataFrame, crowded: DataFrame, keys: list[str], known) -> DataFrame:
    """``rows`` with the block counts of their key, null for most. The largest keys are broadcast (at most ``HOT_KEYS``)."""
    if known[0] <= HOT_KEYS:
        return rows.join(F.broadcast(crowded), keys, "left")
    hot = F.col("_n") * HOT_KEYS >= F.lit(known[1])
    most = F.broadcast(crowded.where(hot))
    return rows.join(most, keys).unionByName(rows.join(most.select(*keys), keys, "left_anti").join(crowded.where(~hot), keys, "left").select(*rows.columns, "_kl", "_kr", "_n"), allowMissingColumns=True)
