"""Parameters of the stages; all lengths in metres unless named otherwise."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class CorridorParams:
    """From block faces to a graph."""

    half_width_m: float = 8.0
    resolution_m: float = 2.0
    close_iterations: int = 1
    min_spur_m: float = 20.0
    max_gap_m: float = 100.0
    detour_gap_m: float = 100.0
    max_detour: float = 10.0
    simplify_m: float = 2.0
    min_component_km: float = 20.0
    tile_m: float = 8000.0
    tile_margin_m: float = 400.0
    neighbours: int = 32

    @property
    def hole_pixels(self) -> int:
        return int((3 * self.half_width_m / self.resolution_m) ** 2)


@dataclass(frozen=True)
class MatchParams:
    """From one-way ways to directions of edges."""

    step_m: float = 10.0
    tolerance_m: float = 12.0
    max_angle_deg: float = 30.0
    min_coverage: float = 0.6
    min_agreement: float = 0.8
    #: Also drop segments that are short beside their coordinates (relative 1e-5, absolute 1e-8), as older data were built.
    legacy_degenerate: bool = False


@dataclass(frozen=True)
class LinkParams:
    """Joining disconnected parts by mapped roads."""

    cover_m: float = 15.0
    cover_share: float = 0.8
    snap_m: float = 25.0
    connect_m: float = 60.0
    step_m: float = 5.0


#: Road classes that may join parts, and those that are read but never do.
MAJOR_ROADS = ("motorway", "motorway_link", "trunk", "trunk_link", "primary", "primary_link", "secondary", "secondary_link", "tertiary", "tertiary_link", "unclassified")
MINOR_ROADS = ("residential", "living_street")
