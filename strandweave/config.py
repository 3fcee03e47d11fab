"""Settings of the staged analysis."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class Filling:
    """Gap filling: particles added per tail (0 = off), acceptance model and threshold."""

    add_num: int = 1
    model: str = "lognorm"  # max, lognorm or genFit
    threshold: float = 0.05


@dataclass(frozen=True)
class Settings:
    """Lengths are in Angstrom unless a name says pixels."""

    pixel_size: float = 3.42
    search_radius: float = 340.0
    min_distance: float = 136.0
    cluster_threshold: float = 25.0
    metric: str = "scale2Ang"
    min_class_ratio: float = -1
    sample_size: int = 10_000
    tree_only: bool = False  # classes of one tree over all pairs, for small tables only
    assign_iterations: int = 1
    assign_percentile: float = 90.0
    remove_branches: bool = True
    link_depth: int = 2  # branches followed at a fork when branches are kept
    filling: Filling = field(default_factory=Filling)
    subtomo_path: str = "subtomograms"
    ctf_file: str = "miss30Wedge.mrc"

    @property
    def radius(self) -> float:
        """Search radius in pixels."""
        return self.search_radius / self.pixel_size
