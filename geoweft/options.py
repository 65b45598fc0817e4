"""Option and value types of the operators."""

from __future__ import annotations

from dataclasses import dataclass, field
from datetime import datetime


@dataclass(frozen=True)
class Extent:
    """An axis-aligned box in WGS84 degrees."""

    xmin: float
    ymin: float
    xmax: float
    ymax: float

    def __post_init__(self) -> None:
        if not (self.xmin <= self.xmax and self.ymin <= self.ymax):
            raise ValueError(f"empty extent: {self}")

    def buffered(self, degrees: float) -> "Extent":
        return Extent(self.xmin - degrees, self.ymin - degrees, self.xmax + degrees, self.ymax + degrees)


@dataclass(frozen=True)
class LinkOptions:
    """Thresholds of the entity link. Defaults are fixed values of the operator's contract."""

    target: str = "places"  # or "addresses"
    max_distance_m: float = 75.0
    name_threshold: float = 0.86
    address_threshold: float = 0.72
    score_threshold: float = 72.0
    review_candidates: int = 5
    allow_nearby_only: bool = True
    buffer_extent: bool = False
    clip_to_extent: bool = True

    def __post_init__(self) -> None:
        if self.target not in ("places", "addresses"):
            raise ValueError("target is 'places' or 'addresses'")
        if not self.max_distance_m > 0:
            raise ValueError("max_distance_m must be positive")

    @property
    def k(self) -> int:
        return min(25, max(1, self.review_candidates))

    @property
    def nearby_only_m(self) -> float:
        """Reach of the nearby-only lane: a fifth of the radius, between 5 and 20 m, never beyond the radius."""
        return min(self.max_distance_m, max(5.0, min(20.0, 0.2 * self.max_distance_m)))


@dataclass(frozen=True)
class TraceOptions:
    theme: str = "places"
    type_: str = "place"
    max_rows: int | None = 250_000  # None: all rows

    @property
    def limit(self) -> int | None:
        return None if self.max_rows is None else min(1_000_000, max(1, self.max_rows))


@dataclass(frozen=True)
class BridgeOptions:
    """Constants stamped on bridge rows. The two policies are fixed values."""

    dataset: str = "Local layer"
    theme: str = "places"
    type_: str = "place"
    linkage_policy: str = "link_dont_replace"
    source_geometry_policy: str = "authoritative_local"
    release: str = ""
    source_layer: str = ""
    tool: str = "geoweft"
    update_time: str | None = None


@dataclass(frozen=True)
class LinkSummary:
    input_count: int
    linked: int
    unmatched: int
    weak: int

    @property
    def percent(self) -> float:
        return 100.0 * self.linked / self.input_count if self.input_count else 0.0

    def text(self) -> str:
        return f"{self.linked} of {self.input_count} linked ({self.percent:.1f} %), {self.weak} weak, {self.unmatched} unmatched"


@dataclass
class LayerInfo:
    name: str
    geometry_type: str
    path: str
    rows: int
    error: str | None = None


@dataclass
class Clock:
    """Source of time for names and stamps, replaceable in tests."""

    fixed: datetime | None = None
    now_: list = field(default_factory=list)

    def now(self) -> datetime:
        return self.fixed or datetime.now()

    def session_id(self) -> str:
        t = self.now()
        return t.strftime("%Y%m%d%H%M%S") + f"{t.microsecond // 1000:03d}"

    def run_id(self) -> str:
        return self.now().strftime("%Y%m%d_%H%M%S")
