"""The two physical forms of a stencil over a (padded) pixel table."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rastrum.raster import Axis, Raster

Tap = tuple[tuple[int, ...], dict[str, float | int]]


def scatter(raster: Raster, taps: Sequence[Tap], axes: Sequence[Axis]) -> tuple[DataFrame, list[str]]:
    """Every pixel sent to the results that use it: rows (group.., axes.., value, tap columns).

    Aggregating these rows by the returned group columns is the whole stencil: one shuffle with
    map-side sums, or none where images already sit together by key.
    """
    names = raster.names
    extra = list(taps[0][1]) if taps else []
    made = [F.struct(*[F.lit(int(d)).alias(f"__d{k}") for k, d in enumerate(at)], *[F.lit(more[x]).alias(x) for x in extra]) for at, more in taps]
    df = raster.df.withColumn("__tap", F.explode(F.array(*made)))
    keep = F.lit(True)
    for k, a in enumerate(axes):
        keep = keep & a.contains(F.col(a.name) - F.col(f"__tap.__d{k}"))
    rest = [c for c in raster.df.columns if c not in names]
    moved = [(F.col(n) - F.col(f"__tap.__d{k}")).cast("int").alias(n) for k, n in enumerate(names)]
    df = df.where(keep).select(*rest, *moved, *[F.col(f"__tap.{x}").alias(x) for x in extra])
    return df, [*raster.group, *names]


def along(raster: Raster, dim: int) -> Window:
    """Rows of one line in order; frames count pixels because the line has no gaps."""
    others = [n for k, n in enumerate(raster.names) if k != dim]
    return Window.partitionBy(*raster.group, *others).orderBy(raster.names[dim])


MISSING = "the raster doesn't have one row for each of its pixels"


def complete(raster: Raster, dim: int, window: Window) -> Column:
    """True, or an error where a line has a gap, a pixel twice, or not all of its pixels. Both sides of a gap tell of it, as one may be cropped."""
    at, a = F.col(raster.names[dim]), raster.axes[dim]
    before, after = F.lag(at).over(window), F.lead(at).over(window)
    good = F.when(before.isNull(), at == a.first).otherwise(at == before + 1) & F.when(after.isNull(), at == a.last_column()).otherwise(after == at + 1)
    return F.when(good, True).otherwise(F.raise_error(F.lit(MISSING)).cast("boolean"))


def whole_stencil(taps: int) -> Column:
    """True, or an error where not all pixels of a stencil have met; an aggregate."""
    return F.when(F.count("*") == taps, True).otherwise(F.raise_error(F.lit(MISSING)).cast("boolean"))


def _runs(raster: Raster, values: Sequence[str], dim: int, low: int, high: int, join: Callable[[Column, Column], Column], overlap: bool) -> Raster:
    """Windows low..high of each line, put together from windows of 1, 4, 16.. pixels: a few window stages in one order, whatever the width."""
    width, window = high - low + 1, along(raster, dim)
    df, steps = raster.df, [1]
    spare = {v: [v] for v in values}
    while steps[-1] * 4 <= width:
        made = {}
        for v in values:
            source = F.col(spare[v][-1])
            parts = [shifted(source, k * steps[-1], window) for k in range(4)]
            spare[v].append(f"__{v}_{steps[-1] * 4}")
            made[spare[v][-1]] = reduce(join, parts)
        df = df.withColumns(made)
        steps.append(steps[-1] * 4)
    made = {}
    for v in values:
        parts, at, left = [], low, width
        for step, name in zip(steps[::-1], spare[v][::-1]):
            while left >= step:
                parts.append(shifted(F.col(name), at, window))
                at, left = at + step, left - step
            if overlap and left:  # the last part may begin earlier
                parts.append(shifted(F.col(name), high - step + 1, window))
                left = 0
        made[v] = F.when(complete(raster, dim, window), reduce(join, parts))
    extra = [n for names in spare.values() for n in names[1:]]
    return raster.with_df(df.withColumns(made).drop(*extra))


def added(raster: Raster, values: Sequence[str], dim: int, low: int, high: int) -> Raster:
    """Sums of the pixels low..high around each place of a line; places without all of them get null."""
    return _runs(raster, values, dim, low, high, lambda a, b: a + b, False)


def least(raster: Raster, values: Sequence[str], dim: int, low: int, high: int) -> Raster:
    return _runs(raster, values, dim, low, high, F.least, True)


def greatest(raster: Raster, values: Sequence[str], dim: int, low: int, high: int) -> Raster:
    return _runs(raster, values, dim, low, high, F.greatest, True)


def cropped(raster: Raster, axes: Sequence[Axis]) -> Raster:
    df = raster.df
    for a, old in zip(axes, raster.axes):
        if a != old:
            df = df.where(a.contains(F.col(a.name)))
    return raster.with_df(df, axes)


def shifted(value: Column, by: int, window: Window) -> Column:
    return value if by == 0 else F.lead(value, by).over(window) if by > 0 else F.lag(value, -by).over(window)
