"""Average-linkage clustering of a bounded sample, and the cut of its tree.

Average linkage between two clusters is the sum of the pairwise distances over the product of the sizes,
and sums add up when clusters merge. Every round merges all pairs of clusters that are each other's nearest
neighbour: average linkage is reducible, so these merges are exactly those of the sequential
algorithm, only many at once. A round is two aggregations and two joins on the table of cluster pairs, which
shrinks from round to round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandweave.operators.pointers import follow
from strandweave.session import cut_lineage


def average_linkage(distances: DataFrame, stop_at: float | None = None) -> DataFrame:
    """Merges of the condensed distances ``(i, j, distance)``: ``(left, right, height, size)``.

    A cluster is named by its smallest member, ``right`` is absorbed by ``left``. With ``stop_at`` only
    merges below that height are made. Equal heights are resolved by the member ids.
    """
    spark = distances.sparkSession
    table = cut_lineage(distances.select(
        F.least("i", "j").alias("a"), F.greatest("i", "j").alias("b"), F.col("distance").alias("total"),
        F.lit(1).cast("long").alias("na"), F.lit(1).cast("long").alias("nb")))
    merges = []
    while True:
        scored = table.withColumn("d", F.col("total") / (F.col("na") * F.col("nb")))
        nearest = scored.select("d", F.explode(F.array("a", "b")).alias("c")).groupBy("c").agg(F.min("d").alias("m"))
        nearest = cut_lineage(nearest)  # one row per cluster of the sample: a lookup of bounded size
        ends = scored.join(F.broadcast(nearest.toDF("a", "ma")), "a").join(F.broadcast(nearest.toDF("b", "mb")), "b")
        close = ends.where("d = ma and d = mb").select("d", "a", "b", "na", "nb")
        if stop_at is not None:
            close = close.where(F.col("d") < F.lit(float(stop_at)))
        # equal heights may offer a cluster several partners: the smallest edge of both ends decides
        close = cut_lineage(close)
        first = close.select(F.explode(F.array("a", "b")).alias("c"), F.struct(*close.columns).alias("e")).groupBy("c").agg(F.min("e").alias("e"))
        mutual = cut_lineage(first.groupBy("e").count().where("count = 2").select("e.*"))
        if mutual.isEmpty():
            break
        merges.append(mutual.select(F.col("a").alias("left"), F.col("b").alias("right"), F.col("d").alias("height"),
                                    (F.col("na") + F.col("nb")).alias("size")))
        grown = mutual.select("a", "b", (F.col("na") + F.col("nb")).alias("n"))
        moves = grown.select(F.col("a").alias("old"), F.col("a").alias("new"), "n").unionByName(
            grown.select(F.col("b").alias("old"), F.col("a").alias("new"), "n"))
        # at most one row per sample member, so the lookup side stays small by construction
        ma = F.broadcast(moves.select(F.col("old").alias("a"), F.col("new").alias("_a"), F.col("n").alias("_na")))
        mb = F.broadcast(moves.select(F.col("old").alias("b"), F.col("new").alias("_b"), F.col("n").alias("_nb")))
        moved = table.join(ma, "a", "left").join(mb, "b", "left").select(
            F.coalesce("_a", "a").alias("p"), F.coalesce("_b", "b").alias("q"), "total",
            F.coalesce("_na", "na").alias("np"), F.coalesce("_nb", "nb").alias("nq")).where("p <> q")
        turn = F.col("p") > F.col("q")
        table = cut_lineage(
            moved.select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "total",
                         F.when(turn, F.col("nq")).otherwise(F.col("np")).alias("na"),
                         F.when(turn, F.col("np")).otherwise(F.col("nq")).alias("nb"))
            .groupBy("a", "b").agg(F.sum("total").alias("total"), F.first("na").alias("na"), F.first("nb").alias("nb")))
    if not merges:
        return spark.createDataFrame([], "left long, right long, height double, size long")
    out = merges[0]
    for m in merges[1:]:
        out = out.union(m)
    return out


def linkage_tree(merges: DataFrame) -> DataFrame:
    """Merges in ascending height as ``(merge_no, left, right, height, size)``.

    The tree has one row per sample member, so numbering it in one window is bounded by the sample size.
    """
    order = Window.orderBy("height", "left", "right")
    return merges.withColumn("merge_no", F.row_number().over(order) - 1).select(
        "merge_no", "left", "right", "height", "size")


def default_threshold(merges: DataFrame) -> float:
    return merges.agg(F.max("height")).first()[0] * 0.7


def cut_tree(merges: DataFrame, threshold: float) -> DataFrame:
    """Clusters ``(member, cluster)`` of the merges strictly below ``threshold``.

    Members that only join above it have no row (they are noise). At least two such merges must
    exist, otherwise there are no clusters. Clusters are numbered from 1 by falling height of their last merge.
    """
    if threshold == -1:
        threshold = default_threshold(merges)
    low = merges.where(F.col("height") < F.lit(float(threshold)))
    low = cut_lineage(low)
    if low.count() < 2:
        return low.limit(0).select(F.col("left").alias("member"), F.lit(0).alias("cluster"))
    absorbed = low.select(F.col("right").alias("node"), F.col("left").alias("parent"))
    tops = low.select(F.col("left").alias("node")).distinct().join(absorbed, "node", "left_anti")
    links = absorbed.unionByName(tops.withColumn("parent", F.lit(None).cast("long")))
    member, _ = follow(links)
    heights = low.select(F.col("left").alias("node"), "height", "right").join(member, "node")
    order = Window.orderBy(F.col("h.height").desc(), F.col("h.node").desc(), F.col("h.right").desc())
    numbered = heights.groupBy("root").agg(F.max(F.struct("height", "node", "right")).alias("h"))
    numbered = numbered.withColumn("cluster", F.row_number().over(order))  # one row per cluster of the sample
    return member.join(numbered.select("root", "cluster"), "root").select(F.col("node").alias("member"), "cluster")


def palette(cluster, count) -> "F.Column":
    """Evenly spaced hues as ``r-g-b`` text with two decimals (lightness 0.6, saturation 0.65)."""
    hue = (cluster - 1) / count + 0.01
    high = F.lit(0.6 + 0.65 - 0.6 * 0.65)
    low = F.lit(2 * 0.6) - high

    def channel(offset: float):
        h = hue + offset
        h = h - F.floor(h)
        rise = low + (high - low) * 6 * h
        fall = low + (high - low) * 6 * (F.lit(2.0 / 3.0) - h)
        return F.when(h < 1 / 6, rise).when(h < 0.5, high).when(h < 2 / 3, fall).otherwise(low)

    return F.format_string("%.2f-%.2f-%.2f", channel(1 / 3), channel(0.0), channel(-1 / 3))
