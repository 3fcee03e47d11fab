"""The staged analysis: particles to pairs, classes, chains, filled gaps and statistics.

Every stage takes and leaves DataFrames. The pair table is materialised where it is reused; with ``folder`` set
the pairs and the classes are kept there with a manifest, and a later run continues from them if settings, input
and code are the same.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import replace
from functools import lru_cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strandweave.config import Settings
from strandweave.operators import align, assign, compare, fill, fit, pairs as P, preprocess, summary, tracking
from strandweave.operators.distance import distance_to_centre
from strandweave.session import cut_lineage
from strandweave.sources import lists, star


class Analysis:
    """State of one run. ``particles`` is the canonical particle table, ``pairs`` the pair table."""

    def __init__(self, spark: SparkSession, settings: Settings | None = None, folder: str | None = None, source: str = "none"):
        self.spark = spark
        self.settings = settings or Settings()
        self.folder = folder
        self.source = source
        self.particles: DataFrame | None = None
        self.pairs: DataFrame | None = None
        self.before_selection: DataFrame | None = None
        self.aligned: DataFrame | None = None
        self.statistics: DataFrame | None = None
        self.removed: DataFrame | None = None
        self.table: star.StarTable | None = None  # as read, for its dialect and its other columns
        self.dropped: DataFrame | None = None
        self._keys: dict[str, str] = {}

    # --- inputs --------------------------------------------------------------------------------------

    def read(self, path: str) -> "Analysis":
        """Reads a particle STAR table of any dialect, recentred."""
        s = self.settings
        table = star.read_star(self.spark, path, s.pixel_size)
        self.table = replace(table, particles=cut_lineage(table.particles))
        table = self.table
        if table.kind == "stopgap":
            table = star.motive_list_to_relion(table, s.subtomo_path, s.ctf_file)
        raw, out = table.particles, star.to_particles(table)
        for origin, scale in ((["rlnOriginX", "rlnOriginY", "rlnOriginZ"], None),
                              (["rlnOriginXAngst", "rlnOriginYAngst", "rlnOriginZAngst"], s.pixel_size)):
            if (table.kind == "relion3") == (scale is not None) and origin[0] in raw.columns:
                out = preprocess.recentre(out.join(raw.select("particle_id", *origin), "particle_id"), origin, scale).drop(*origin)
        self.source = path
        return self.use(out.withColumn("origin_id", F.col("particle_id")))

    def use(self, particles: DataFrame) -> "Analysis":
        """Starts from a canonical particle table."""
        self.particles = cut_lineage(particles)
        return self

    # --- stages --------------------------------------------------------------------------------------

    def drop_duplicates(self) -> DataFrame:
        """Removes near-duplicates and renumbers the survivors; returns the dropped particles."""
        from strandweave.operators.ranking import dense_code, ranked

        score = "score" if "score" in self.particles.columns else None
        kept, dropped = preprocess.drop_duplicates_within(
            self.particles, self.settings.min_distance / self.settings.pixel_size, score)
        kept = ranked(kept.withColumn("_all", F.lit(0)), ["_all"], ["particle_id"], "_n").withColumn(
            "particle_id", F.col("_n") - 1).drop("_all", "_n")
        self.particles = cut_lineage(dense_code(kept, "tomo_name", "tomo_id"))
        self.dropped = dropped
        return dropped

    def neighbour_distances(self) -> DataFrame:
        return preprocess.nearest_neighbour(self.particles)

    def find_pairs(self) -> DataFrame:
        s = self.settings
        key = self._key("pairs", [s.radius, s.pixel_size, self.source], self._content) if self.folder else ""
        stored = self._load("pairs", key)
        if stored is None:
            stored = self._keep("pairs", P.with_row_order(P.neighbour_transforms(self.particles, s.radius, s.pixel_size, self.source or "none")), key)
            if stored.isEmpty():
                raise RuntimeError("no two particles of a volume lie within the search radius")
        self.pairs = stored
        return stored

    def classify(self) -> DataFrame:
        s = self.settings
        how = [s.cluster_threshold, s.radius, s.metric, s.sample_size, s.min_class_ratio, s.assign_percentile, s.assign_iterations]
        key = self._key("classes", [*how, s.tree_only], lambda: self._keys["pairs"]) if self.folder else ""
        stored = self._load("classes", key)
        if stored is None:
            stored = self._keep("classes", assign.cluster_all(self.pairs, *how, tree_only=s.tree_only), key)
        self.pairs = stored
        return stored

    def select(self) -> DataFrame:
        """Drops unclustered pairs and small classes and renumbers the rest."""
        self.before_selection = self.pairs
        ratio = self.settings.min_class_ratio
        if ratio != 0:
            self.pairs = cut_lineage(assign.select_classes(self.pairs, assign.minimum_size(ratio, self.pairs.count())))
            if self.pairs.isEmpty():
                raise ValueError("no class is large enough; lower the minimum class size")
        return self.pairs

    def align(self) -> DataFrame:
        self.pairs = cut_lineage(align.align_directions(self.pairs))
        self.aligned = self.pairs
        return self.pairs

    def summarise(self) -> DataFrame:
        self.statistics = cut_lineage(summary.class_statistics(self.pairs, self.settings.radius, self.settings.metric))
        return self.statistics

    def track(self, remove_branches: bool | None = None) -> DataFrame:
        """Tracks chains; with branch removal every particle keeps its best edge in and out first, else ``link_depth`` branches are followed."""
        clean = self.settings.remove_branches if remove_branches is None else remove_branches
        if clean:
            if self.statistics is not None:
                centres = fill.fill_statistics(self.statistics).select("pairClass", *fill.CENTRE)
            else:
                centres = cut_lineage(summary.class_centres(self.pairs.where("pairClass <> 0")))
            kept, removed = tracking.prune_branches(self.pairs, centres, self.settings.radius, self.settings.metric)
            self.removed = cut_lineage(removed.select("pairIDX1", "pairIDX2", "pairClass"))
            self.pairs = cut_lineage(kept)
        self.pairs = cut_lineage(tracking.track_chains(self.pairs, 1 if clean else self.settings.link_depth))
        return self.pairs

    def link(self) -> DataFrame:
        """Fills gaps (unless switched off), resets the labels and tracks again."""
        s, how = self.settings, self.settings.filling
        if "fillUpProb" not in self.pairs.columns:
            self.pairs = self.pairs.withColumn("fillUpProb", F.lit(-1.0))
        if how.add_num > 0:
            if self.statistics is None:
                self.summarise()
            stats = fill.with_model(cut_lineage(fill.fill_statistics(self.statistics)), self.pairs, s.radius, how.model, s.metric)
            ends = cut_lineage(tracking.chain_ends(self.pairs))
            self.pairs, self.particles = fill.fill_gaps(
                self.pairs, self.particles, ends, stats, s.radius, s.pixel_size, self.source, how.add_num, how.model,
                how.threshold, s.metric)
        self.pairs = self.pairs.withColumns({
            "pairLabel": F.lit(-1.0), "pairPosInPoly1": F.lit(-1), "pairPosInPoly2": F.lit(-1)})
        return self.track()

    def error_estimate(self) -> DataFrame:
        """Per class the density border of the in-class distances and their overlap with all other pairs.

        Uses the aligned pairs before filling and the current class statistics.
        """
        s = self.settings
        pairs = self.aligned if self.aligned is not None else self.pairs
        lost = None if self.before_selection is None else compare.missing_pairs(self.before_selection, pairs)
        centres = fill.fill_statistics(self.statistics if self.statistics is not None else self.summarise())
        bins = cut_lineage(compare.error_bins(pairs, centres, s.radius, s.metric, lost))
        keys = ["classNr", "measure"]
        overlap = fit.overlap_of_bins(bins, keys, "same")
        return overlap.join(fit.borders_of_bins(bins.where("same"), keys), keys).withColumnRenamed("measure", "distance")

    def chains(self) -> DataFrame:
        return summary.chain_statistics(self.pairs)

    def run(self) -> "Analysis":
        """All stages in order, from particles to tracked chains with filled gaps and fresh statistics."""
        self.drop_duplicates()
        self.find_pairs()
        self.classify()
        self.select()
        self.align()
        self.summarise()
        self.link()
        self.summarise()
        return self

    def write(self, folder: str, one_file: bool = False) -> None:
        """The whole result of a run: particles in their own dialect with all their columns, pairs, a pair table per class,
        statistics in reporting order, overlaps and losses, the error estimate, distribution fits and lists."""
        s = self.settings

        def particle_table(particles: DataFrame) -> star.StarTable:
            if self.table is None:
                return star.from_particles(particles, pixel_size=s.pixel_size)
            return star.with_particles(self.table, particles)

        star.write_pairs(self.pairs, f"{folder}/allTransforms.star", one_file)
        star.write_star(particle_table(self.particles), f"{folder}/particles.star", one_file=one_file)
        if self.dropped is not None:
            star.write_star(particle_table(self.dropped), f"{folder}/stat/dropped.star", one_file=one_file)
        tables = {"statPerPoly": (self.chains(), [-F.col("num"), F.col("classNr"), F.col("polyID")])}
        if self.statistics is not None:
            long = (F.col("numPolybg3") + F.col("numPolybg5")) * 10000 + F.col("num")
            tables["statPerClass"] = (self.statistics, [-long, -F.col("classNr")])
        if self.before_selection is not None:
            tables["statOverlapRibos"] = (summary.class_overlap(self.pairs), [F.col("pairClass")])
            tables["statDropRibos"] = (summary.drop_summary(self.particles, self.before_selection, self.pairs), [F.col("keepTransNr")])
        if self.statistics is not None:
            tables["errorEstimate"] = (self.error_estimate(), [F.col("classNr"), F.col("distance")])
            centres = fill.fill_statistics(self.statistics)
            inside = self.pairs.where("pairClass > 0").join(centres.select("pairClass", *fill.CENTRE), "pairClass")
            d = cut_lineage(distance_to_centre(inside, s.radius, s.metric).select("pairClass", "row_no", "cn_distance"))
            fits = fit.fit_distributions(d, ["pairClass"], "cn_distance", "row_no", ["lognorm", fit.GENERIC]).drop("params")
            tables["fits"] = (fits, [F.col("pairClass"), F.col("chi_square")])
        for name, (df, order) in tables.items():
            lists.write_report(df, order, f"{folder}/stat/{name}.star", one_file)
        lists.write_pair_centres(self.pairs, f"{folder}/clusters")
        lists.write_class_tables(self.pairs, f"{folder}/clusters/transforms")
        lists.write_class_particles(self.pairs, particle_table(self.particles), f"{folder}/clusters/particleCenter")

    # --- stored stages -------------------------------------------------------------------------------

    def _exists(self, path: str) -> bool:
        jvm_path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
        return jvm_path.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(jvm_path)

    def _content(self) -> str:
        """Digest of the particles, whatever their order and partitioning."""
        hashes = [F.sum(F.xxhash64(*sorted(self.particles.columns), F.lit(k)).cast("decimal(38,0)")) for k in range(2)]
        return str([str(v) for v in self.particles.agg(F.count("*"), *hashes).first()])

    def _key(self, name: str, settings: list, inputs) -> str:
        """What a stage depends on: its settings, its inputs and the code."""
        key = hashlib.sha256(json.dumps([code_digest(), settings, inputs()]).encode()).hexdigest()
        self._keys[name] = key
        return key

    def _load(self, name: str, key: str) -> DataFrame | None:
        """The stored stage, if it is complete and was made with the same settings from the same input by the same code."""
        path = f"{self.folder}/{name}"
        if self.folder is None or not self._exists(path) or not self._exists(f"{path}-manifest"):
            return None
        if self.spark.read.text(f"{path}-manifest").first()[0] != key:
            return None
        return self.spark.read.parquet(path)

    def _keep(self, name: str, df: DataFrame, key: str) -> DataFrame:
        if self.folder is None:
            return cut_lineage(df)
        path = f"{self.folder}/{name}"
        df.write.mode("overwrite").parquet(path)
        self.spark.createDataFrame([(key,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}-manifest")
        return self.spark.read.parquet(path)


@lru_cache(maxsize=1)
def code_digest() -> str:
    """Digest of this package's source files."""
    root = Path(__file__).resolve().parent.parent
    digest = hashlib.sha256()
    for path in sorted(root.rglob("*.py")):
        if "llm" not in path.relative_to(root).parts:
            digest.update(path.read_bytes())
    return digest.hexdigest()
