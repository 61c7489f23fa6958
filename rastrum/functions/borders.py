"""What lies outside an image: border rules and their index maps."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

STYLES = ("replicate", "circular", "symmetric", "reflect")
Extent = tuple[tuple[int, int], ...]


def _pairs(low: tuple[int, ...] | None, high: tuple[int, ...] | None) -> Extent | None:
    if low is None:
        return None
    high = low if high is None else high
    if len(low) != len(high):
        raise ValueError(f"{len(low)} sizes before and {len(high)} after")
    return tuple(zip(low, high))


class Sized:
    """Borders that take their sizes from a kernel."""

    def sized(self, kernel, ndim: int | None = None):
        """The border with the sizes that a kernel, or a sequence of them applied in turn, reaches to."""
        from rastrum.plans.strategy import extents, factors_of

        first = kernel[0] if isinstance(kernel, (tuple, list)) else kernel
        n = ndim or (len(first.flags) if hasattr(first, "flags") else first.ndim)
        need = extents(factors_of(kernel, n, separable=False), n)
        return replace(self, low=tuple(a for a, _ in need), high=tuple(b for _, b in need))


@dataclass(frozen=True)
class Pad(Sized):
    """Values from inside the image. ``symmetric`` repeats the edge pixel, ``reflect`` doesn't.

    Without sizes the kernel or window decides them.
    """

    style: str = "replicate"
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None

    def __post_init__(self) -> None:
        if self.style not in STYLES:
            raise ValueError(f"unknown border style {self.style!r}")

    @property
    def sizes(self) -> Extent | None:
        return _pairs(self.low, self.high)


@dataclass(frozen=True)
class Fill(Sized):
    """One value everywhere outside."""

    value: float | int | str | bool = 0
    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None

    @property
    def sizes(self) -> Extent | None:
        return _pairs(self.low, self.high)


@dataclass(frozen=True)
class Inner(Sized):
    """Only results that need nothing from outside; indices keep their values. Sizes crop explicitly."""

    low: tuple[int, ...] | None = None
    high: tuple[int, ...] | None = None

    @property
    def sizes(self) -> Extent | None:
        return _pairs(self.low, self.high)


def not_available(v: Column) -> Column:
    return v.isNull() | F.isnan(v.cast("double"))


@dataclass(frozen=True)
class NA:
    """Weights of missing pixels (and of all outside) are left out and the rest scaled up."""

    missing: Callable[[Column], Column] = not_available


Border = Pad | Fill | Inner | NA


def border(spec: str | Border) -> Border:
    """A border from its name, or as it is. ``inner`` has no name: it changes the result's axes."""
    return Pad(spec) if isinstance(spec, str) else spec


def source_index(style: str, at: Column, first: Column, last: Column) -> Column:
    """The index inside first..last that a padded index ``at`` takes its value from."""
    n, p = last - first + 1, at - first
    if style == "replicate":
        inside = F.greatest(F.lit(0), F.least(n - 1, p))
    elif style == "circular":
        inside = F.pmod(p, n)
    elif style == "symmetric":
        m = F.pmod(p, 2 * n)
        inside = F.when(m < n, m).otherwise(2 * n - 1 - m)
    else:
        m = F.pmod(p, 2 * n - 2)
        inside = F.when(m < n, m).otherwise(2 * n - 2 - m)
    return first + inside
