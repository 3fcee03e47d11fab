"""Ranks, order statistics and file positions without a single-task sort.

A window over a group puts the whole group into one task. Here rows are range-partitioned by group and
order key, so a group that holds a third of the table is spread over many tasks; the rank is the position
inside the partition plus the number of rows of the group in earlier partitions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandweave.session import cut_lineage

_SHIFT = 33  # bits monotonically_increasing_id leaves for the position inside a partition


def ranked(df: DataFrame, group: list[str], order: list[str], name: str = "rank") -> DataFrame:
    """Adds the 1-based position of the row inside its group; ``order`` should end in a unique column,
    which also keeps equal values from piling up in one partition."""
    keys = [*group, *order]
    placed = df.repartitionByRange(*keys).sortWithinPartitions(*keys)
    stored = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()))
    stored = stored.withColumn("_part", F.shiftright("_at", _SHIFT))
    sizes = stored.groupBy(*group, "_part").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    before = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    joined = _null_safe_join(stored, cut_lineage(sizes), [*group, "_part"])  # stored, so that the rows are not shuffled for them
    return joined.withColumn(name, F.col("_base") + F.col("_at") - F.col("_lo") + 1).drop(
        "_at", "_part", "_lo", "_base")


def group_quantiles(
    df: DataFrame, group: list[str], value: str, tie: str, probabilities: list[float] | Column, name: str = "quantiles",
) -> DataFrame:
    """Exact quantiles with linear interpolation, one array per group.

    Only the order statistics next to each requested position leave the ranked table. ``probabilities``
    may be an array expression over the group size ``_total``.
    """
    return quantiles_of_ranked(ranked(df.select(*group, value, tie), group, [value, tie], "_rank"),
                               group, value, "_rank", probabilities, name)


def quantiles_of_ranked(
    rows: DataFrame, group: list[str], value: str, rank: str, probabilities: list[float] | Column, name: str,
) -> DataFrame:
    rows = rows.withColumn("_rank", F.col(rank))
    totals = rows.groupBy(*group).agg(F.max("_rank").alias("_total"))
    wanted = probabilities if isinstance(probabilities, Column) else F.array(*[F.lit(float(p)) for p in probabilities])
    picks = totals.select(*group, F.posexplode(wanted).alias("_slot", "_p"), "_total")
    picks = picks.select(*group, "_slot", (F.col("_p") * (F.col("_total") - 1)).alias("_pos"))
    picks = picks.withColumn("_side", F.explode(F.array(F.floor("_pos"), F.ceil("_pos"))))
    picks = cut_lineage(picks.withColumn("_rank", F.col("_side") + 1).drop("_side"))  # the rows are not shuffled for a few ranks
    found = rows.join(picks, [*group, "_rank"]).groupBy(*group, "_slot").agg(
        F.min(value).alias("_low"), F.max(value).alias("_high"), F.first("_pos").alias("_pos"))
    interpolated = F.col("_low") + (F.col("_high") - F.col("_low")) * (F.col("_pos") - F.floor("_pos"))
    found = found.select(*group, F.struct("_slot", interpolated.alias("q")).alias("_s"))
    ordered = F.transform(F.array_sort(F.collect_list("_s")), lambda s: s["q"])
    return found.groupBy(*group).agg(ordered.alias(name))


def dense_code(df: DataFrame, name_col: str, code_col: str) -> DataFrame:
    """Rank of the distinct names in sorted order, from 0; only the distinct names are sorted."""
    names = df.select(name_col).distinct().withColumn("_all", F.lit(0))
    codes = ranked(names, ["_all"], [name_col], "_r").select(name_col, (F.col("_r") - 1).cast("int").alias(code_col))
    return _null_safe_join(df.drop(code_col), codes, [name_col])


def _null_safe_join(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """Inner join in which a missing key equals a missing key."""
    renamed = right.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in right.columns if c not in keys])
    same = F.lit(True)
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    return left.join(renamed, same).drop(*[f"_r_{k}" for k in keys])


def with_file_position(lines: DataFrame, name: str) -> DataFrame:
    """Adds the 0-based line position over a text scan ordered by file and offset.

    ``lines`` must carry ``_file`` and ``_start`` (split offset) of the scan; lines of a split are
    consecutive, so a prefix sum over the splits is all that has to be gathered.
    """
    number = F.regexp_extract("_file", r"part-(\d+)[^/]*$", 1).try_cast("long")  # Spark's own files, past 99,999 too
    stored = lines.withColumn("_at", F.monotonically_increasing_id())
    splits = stored.groupBy("_file", "_start").agg(F.min("_at").alias("_lo"), F.count("*").alias("_n"))
    splits = splits.withColumn("_no", F.coalesce(number, F.lit(-1)))
    before = Window.orderBy("_no", "_file", "_start").rowsBetween(Window.unboundedPreceding, -1)
    splits = splits.withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n", "_no")
    joined = stored.join(F.broadcast(splits), ["_file", "_start"])  # a row per split of the files; the lines stay where they are
    return joined.withColumn(name, F.col("_base") + F.col("_at") - F.col("_lo")).drop("_at", "_lo", "_base")


def struct_min(value: Column, *payload: Column) -> Column:
    return F.min(F.struct(value, *payload))
