"""Padding: an image extended by a border rule, without a join or a shuffle."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rastrum.functions.borders import Border, Extent, Fill, Inner, Pad, border, source_index
from rastrum.raster import Axis, Raster


def outside(a: Axis, low: int, high: int) -> Column:
    """Array of the indices that padding adds to an axis."""
    last = a.last_column()
    none = F.array().cast("array<int>")
    before = F.sequence(F.lit(a.first - low), F.lit(a.first - 1)) if low else none
    after = F.sequence((last + 1).cast("int"), (last + high).cast("int")) if high else none
    return F.concat(before, after)


def places_outside(style: str, here: Column, a: Axis, low: int, high: int) -> Column:
    """Array of the padded places that take their value from index ``here``, where the border is no wider than the image: two at most,
    or a whole side for each end of a replicated one."""
    first, last, none = F.lit(a.first), a.last_column(), F.array().cast("array<int>")
    n, p = last - first + 1, here - first
    if style == "replicate":
        before = F.when(p == 0, F.sequence(F.lit(a.first - low), F.lit(a.first - 1))).otherwise(none) if low else none
        after = F.when(p == n - 1, F.sequence((last + 1).cast("int"), (last + high).cast("int"))).otherwise(none) if high else none
        return F.concat(before, after)
    before, after = {"circular": (p - n, p + n), "symmetric": (-1 - p, 2 * n - 1 - p), "reflect": (-p, 2 * (n - 1) - p)}[style]
    places = [F.when((before < 0) & (before >= -low), first + before), F.when((after >= n) & (after < n + high), first + after)]
    return F.array_compact(F.array(*[x.cast("int") for x in places]))


def pad_raster(raster: Raster, by: str | Border, sizes: Extent | None = None) -> Raster:
    """The raster with axes grown by ``sizes`` (or by the border's own).

    Each pixel is copied to the padded places that take their value from it, so a pixel far from
    the edges stays one row. For Fill, the first pixel of each image brings the constant cells.
    ``Inner`` gives an unchanged copy here.
    """
    by = border(by)
    if isinstance(by, Inner):
        return raster
    if not isinstance(by, (Pad, Fill)):
        raise ValueError(f"can't pad with {by!r}")
    sizes = by.sizes or sizes
    if sizes is None or len(sizes) != len(raster.axes):
        raise ValueError(f"padding needs a size for each of {len(raster.axes)} dimensions")
    if any(s < 0 for pair in sizes for s in pair):
        raise ValueError("padding sizes can't be negative")
    axes = [a.grown(*s) for a, s in zip(raster.axes, sizes)]
    if isinstance(by, Fill):
        return raster.with_df(_filled(raster, by, sizes), axes)
    df = raster.df
    for a, (low, high) in zip(raster.axes, sizes):
        if not low and not high:
            continue
        if by.style == "reflect" and not a.ragged and len(a) == 1:
            raise ValueError("reflect needs at least two pixels along a dimension")
        here, first, last = F.col(a.name), F.lit(a.first), a.last_column()
        added = F.filter(outside(a, low, high), lambda p: source_index(by.style, p, first, last) == here)
        n = last - first + 1
        near = F.lit(True) if by.style == "replicate" else F.lit(max(low, high)) <= (n - 1 if by.style == "reflect" else n)
        if a.ragged:
            added = F.when(near, places_outside(by.style, here, a, low, high)).otherwise(added)
        elif by.style == "replicate" or max(low, high) <= len(a) - (by.style == "reflect"):
            added = places_outside(by.style, here, a, low, high)
        df = df.withColumn(a.name, F.explode(F.concat(F.array(here.cast("int")), added)))
    return raster.with_df(df, axes)


def _filled(raster: Raster, by: Fill, sizes: Extent):
    corner = F.lit(True)
    for a in raster.axes:
        corner = corner & (F.col(a.name) == a.first)
    kind = raster.df.schema[raster.value].dataType
    cells = F.array(F.struct(*[F.col(a.name).cast("int").alias(a.name) for a in raster.axes], F.lit(False).alias("__new")))
    # Only the rim is built: for each dimension, what lies outside along it and inside along all before.
    rims = []
    for d, (low, high) in enumerate(sizes):
        if low or high:
            lines = [_line(a) for a in raster.axes[:d]] + [outside(raster.axes[d], low, high)] + [_line(a.grown(*s)) for a, s in zip(raster.axes[d + 1 :], sizes[d + 1 :])]
            grid = F.array(F.struct(F.lit(0).alias("__none")))
            for k, line in enumerate(lines):
                grid = F.flatten(F.transform(grid, _product_step(raster.names[:k], raster.names[k], line)))
            rims.append(F.transform(grid, lambda c: F.struct(*[c[n].alias(n) for n in raster.names], F.lit(True).alias("__new"))))
    new = F.concat(*rims) if rims else F.slice(cells, 1, 0)
    rest = [c for c in raster.df.columns if c not in (*raster.names, raster.value)]
    spread = raster.df.select(*rest, raster.value, F.explode(F.when(corner, F.concat(cells, new)).otherwise(cells)).alias("__cell"))
    value = F.when(F.col("__cell.__new"), F.lit(by.value).cast(kind)).otherwise(F.col(raster.value))
    return spread.select(*rest, *[F.col(f"__cell.{n}").alias(n) for n in raster.names], value.alias(raster.value))


def _line(a: Axis) -> Column:
    return F.sequence(F.lit(a.first), a.last_column().cast("int"))


def _product_step(names: tuple[str, ...], name: str, line: Column):
    """Extends a cell, a struct of the ``names`` so far, by every index of one more axis."""
    return lambda cell: F.transform(line, lambda at: F.struct(*[cell[n].alias(n) for n in names], at.alias(name)))
