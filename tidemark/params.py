"""Parameters of a run; one immutable object, and an argument given to a function wins over it."""

from __future__ import annotations

from dataclasses import dataclass, replace


@dataclass(frozen=True)
class Params:
    # Reference systems: longitude/latitude in, projected metres within.
    original_crs: str = "EPSG:4326"
    utm_epsg: int = 32606
    # Clusters of ground tracks.
    cluster_distance_m: float = 18.0
    min_beams: int = 2
    angle_search_radius: float = 10.0
    # Vertical bias against a reference pass.  (vertical_tolerance and min_profiles_per_cluster are carried and not used.)
    vertical_tolerance: float = 5.0
    bias_tolerance: float = 0.5
    bias_x0: float = 550.0
    min_profiles_per_cluster: int = 2
    # Quality gate.
    min_points_pct: float = 0.8
    elev_trash: float = 20.0
    too_far_beam: float = 46.0
    n_cycles: int = 24
    # Oriented box, half lengths in metres.
    half_along_m: float = 300.0
    half_across_m: float = 300.0
    gtx: tuple[str, ...] = ("gt1", "gt2", "gt3")
    # Edge crossing and change statistics.
    crossing_atol: float = 1e-3
    gap_threshold_m: float = 40.0
    confidence: float = 0.95
    min_span_days: int = 365

    @property
    def ideal_case(self) -> int:
        return 2 * self.n_cycles

    def with_values(self, **changed) -> Params:
        return replace(self, **changed)


#: The sweep of the reference workflow.
CLUSTER_SIZES = (6.0, 12.0, 18.0, 24.0, 30.0, 36.0, 42.0)
BIAS_TOLERANCES = (0.25, 0.5, 0.75, 1.0)


def pick(given, params: Params | None, name: str):
    """An explicit argument, else the value of the parameter object, else its default."""
    return given if given is not None else getattr(params or Params(), name)
