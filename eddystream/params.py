"""Parameters of a clustering run."""

from __future__ import annotations

from dataclasses import dataclass, replace

#: Labels of points.
CORE, BORDER, NOISE = 0, 1, 2


@dataclass(frozen=True)
class DbscanParams:
    """``window`` rows, moved on by ``stride`` rows; a core has ``min_pts`` rows, itself included, nearer than ``radius``."""

    window: int
    stride: int
    min_pts: int
    radius: float
    dims: int = 3
    precision: str = "double"

    def __post_init__(self) -> None:
        if not (self.window > 0 and 0 < self.stride <= self.window and self.window % self.stride == 0):
            raise ValueError("window must be a positive multiple of stride")
        if self.min_pts < 1 or not self.radius > 0 or self.dims not in (1, 2, 3):
            raise ValueError("min_pts >= 1, radius > 0 and one to three dimensions are needed")
        if self.precision not in ("double", "float"):
            raise ValueError("precision is double or float")

    @property
    def axes(self) -> tuple[str, ...]:
        return ("x", "y", "z")[: self.dims]

    def with_(self, **more) -> DbscanParams:
        return replace(self, **more)


#: Settings that published runs on well-known data sets use.
PRESETS = {
    "stk": DbscanParams(100_000, 5_000, 2, 0.07, 1),
    "stk-dense": DbscanParams(100_000, 5_000, 50, 0.45, 1),
    "rbf": DbscanParams(10_000, 500, 4, 0.035, 2),
    "eds": DbscanParams(10_000, 500, 4, 68.516460, 2),
    "tao": DbscanParams(10_000, 500, 6, 1.3, 3),
    "tao-dense": DbscanParams(10_000, 500, 50, 1.9, 3),
    "geolife": DbscanParams(200_000, 10_000, 6, 0.01, 3),
    "geolife-dense": DbscanParams(100_000, 5_000, 765, 0.002, 3),
}
