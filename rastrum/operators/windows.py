"""Sliding windows: any function of the pixels around each pixel."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from itertools import product

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from rastrum.functions.borders import Border, Fill, Inner, Pad, border, source_index
from rastrum.operators.padding import pad_raster
from rastrum.operators.filtering import widened
from rastrum.operators.stencil import MISSING, added, cropped, greatest, least, scatter, whole_stencil
from rastrum.operators.tiles import Spot, box_sums, map_tiles, running, select_ranks
from rastrum.plans.strategy import by_image, by_tiles
from rastrum.raster import Axis, Raster

#: What can be taken along one dimension after the other.
SEPARABLE: dict[str, Callable] = {"min": least, "max": greatest, "sum": added}
#: Beyond these pixels of a window, values are selected by rank instead of sorting each window.
SORTED_WINDOW = 128
WIDE_LINE = 16
Span = tuple[int, int]
#: The same over the last axis of an array of windows, for images that are taken whole (a missing pixel is NaN there).
BY_IMAGE: dict[str, Callable[[np.ndarray, float | None], np.ndarray]] = {
    "median": lambda w, q: np.median(w, -1),
    "lower_median": lambda w, q: np.sort(w, -1)[..., (w.shape[-1] - 1) // 2],
    "nan_median": lambda w, q: np.where(np.isnan(w).all(-1), np.nan, np.nanmedian(np.where(np.isnan(w).all(-1)[..., None], 0, w), -1)),
    "quantile": lambda w, q: np.quantile(w, q, -1),
    "first": lambda w, q: w[..., 0],
    "std": lambda w, q: np.std(w, -1, ddof=1),
}
MODES = {"replicate": "edge", "circular": "wrap", "symmetric": "symmetric", "reflect": "reflect"}


def spans(window: int | Span | Sequence, ndim: int, even: bool = False) -> list[Span]:
    """Least and largest displacement for each dimension.

    An integer is a size for one dimension; a sequence holds sizes and (low, high) pairs. Sizes must be odd
    unless ``even``, where the extra pixel lies before the centre.
    """
    if isinstance(window, int) or (isinstance(window, range)) or (ndim == 1 and isinstance(window, tuple) and len(window) == 2 and window[0] <= 0 <= window[1]):
        window = [window]
    out = []
    for w in window:
        if isinstance(w, (int, np.integer)):
            if w < 1 or (w % 2 == 0 and not even):
                raise ValueError(f"window sizes must be odd, got {w}")
            out.append((-(w // 2), w - 1 - w // 2))
        else:
            out.append((w[0], w[-1]))
    if len(out) != ndim or not out:
        raise ValueError(f"a window of {len(out)} dimensions on a raster of {ndim}")
    return out


def _median(v: Column) -> Column:
    bad = F.max(F.isnan(v.cast("double")).cast("int")) == 1
    return F.when(bad, float("nan")).otherwise(F.percentile(v, 0.5))


def aggregates(name: str, q: float | None) -> Callable[[Column, Column], Column]:
    """Aggregates over (value, place in the window) that need all of a window at once."""
    known = {
        "median": lambda v, o: _median(v),
        "lower_median": lambda v, o: F.element_at(F.array_sort(F.collect_list(v)), F.floor((F.count("*") + 1) / 2).cast("int")),
        "nan_median": lambda v, o: F.percentile(F.when(~F.isnan(v), v), 0.5),
        "quantile": lambda v, o: F.percentile(v, F.lit(q)),
        "first": lambda v, o: F.min_by(v, o),
        "count": lambda v, o: F.count(v),
        "min": lambda v, o: F.min(v),
        "max": lambda v, o: F.max(v),
        "sum": lambda v, o: F.sum(v),
        "mean": lambda v, o: F.avg(v),
        "extrema": lambda v, o: F.struct(F.min(v).alias("min"), F.max(v).alias("max")),
        "std": lambda v, o: F.stddev_samp(v),
    }
    if name not in known:
        raise ValueError(f"unknown window function {name!r}")
    return known[name]


def map_window(
    raster: Raster,
    function: str | Callable,
    window,
    by: str | Border = "replicate",
    *,
    indices: dict[str, range] | None = None,
    q: float | None = None,
    returns: str = "double",
    python: bool = False,
    even: bool = False,
    local_border: bool = False,
    shaped: bool = False,
) -> Raster:
    """``function`` of the window around every pixel.

    Names: min, max, sum, mean, extrema (column of min and max), median, lower_median, nan_median, quantile
    (``q``), first, count, std. A callable of (value, place) columns is an aggregate of
    your own; with ``python`` it gets the window as a flat numpy array, first dimension
    fastest, or ``shaped`` in its dimensions, in Arrow batches; ``returns="auto"`` takes the type of its answer to one window of zeros. Images with a key that fit a row are taken whole for these, others in tiles with rims; beyond
    SORTED_WINDOW pixels medians and quantiles take the same time whatever the window. Separable names take a few window stages
    per dimension, whatever the width. A null pixel is NaN among floating-point ones, a pixel without a row an error. ``indices``: only these, numbered
    from 0 in the result where the step isn't 1. With ``local_border`` a Pad style continues the part of the
    window that lies inside the image, not the image; the window must hold its centre then, and reflect
    fails where only one pixel is inside.
    """
    by = border(by)
    if not isinstance(by, (Pad, Fill, Inner)):
        raise ValueError(f"no window border {by!r}")
    if by.sizes and not isinstance(by, Inner):
        raise ValueError("the window decides the size of its border")
    span = spans(window, len(raster.axes), even or function == "extrema")
    if raster.df.schema[raster.value].dataType.typeName() in ("double", "float", "decimal") or function in ("sum", "mean"):
        raster = widened(raster, by)
    if python and shaped:
        function = _in_shape(function, [high - low + 1 for low, high in span])
    if python and returns == "auto":
        returns = answer_type(function(np.zeros(int(np.prod([high - low + 1 for low, high in span])))))
    if local_border:
        if not isinstance(by, Pad) or any(low > 0 or high < 0 for low, high in span):
            raise ValueError("a local border takes a Pad style and a window around its centre")
        out = _whole(raster, function, span, list(raster.axes), q, returns, python, by.style)
        return strided(out, indices) if indices else out
    need = tuple((max(0, -low), max(0, high)) for low, high in span)
    target = [a.grown(-low, -high) for a, (low, high) in zip(raster.axes, need)] if isinstance(by, Inner) else list(raster.axes)
    # Minima, maxima and sums over many pixels of a line: by running operations on arrays, where pixels are floating-point numbers
    wide = function in ("min", "max", "sum", "mean") and any(high - low >= WIDE_LINE for low, high in span)
    if (python or function in BY_IMAGE or wide) and returns == "double" and by_image(raster):
        out = _by_image(raster, function, span, by, need, target, q)
        return strided(out, indices) if indices else out
    line = len(raster.axes) == 1 and not raster.keys and function in ("min", "max", "sum", "mean")
    wide = wide and raster.df.schema[raster.value].dataType.typeName() in ("double", "float")
    if (python or function in BY_IMAGE or line or wide) and returns == "double" and by_tiles(raster):
        out = _by_tiles(raster, function, span, by, need, target, q)
        return strided(out, indices) if indices else out
    padded = raster if isinstance(by, Inner) else pad_raster(raster, by, need) if any(s for p in need for s in p) else raster
    names = [function] if isinstance(function, str) else []
    if names and names[0] in SEPARABLE:
        out = _by_dimension(padded, {SEPARABLE[function]: [raster.value]}, span, target)
    elif names == ["mean"]:
        size = int(np.prod([high - low + 1 for low, high in span]))
        out = _by_dimension(padded, {added: [raster.value]}, span, target)
        out = out.with_df(out.df.withColumn(out.value, F.col(out.value) / F.lit(float(size))))
    elif names == ["extrema"]:
        both = padded.with_df(padded.df.withColumn("__high", F.col(raster.value)))
        out = _by_dimension(both, {least: [raster.value], greatest: ["__high"]}, span, target)
        made = F.struct(F.col(raster.value).alias("min"), F.col("__high").alias("max"))
        out = out.with_df(out.df.withColumn(out.value, made).drop("__high"))
    else:
        out = _whole(padded, function, span, target, q, returns, python)
    return strided(out, indices) if indices else out


def _in_shape(function: Callable, sizes: list[int]) -> Callable:
    return lambda w: function(np.asarray(w).reshape(sizes, order="F"))


def answer_type(answer) -> str:
    """The Spark type of a Python value."""
    kinds = {"b": "boolean", "i": "bigint", "u": "bigint", "f": "double", "U": "string"}
    x = np.asarray(answer)
    if x.dtype.kind not in kinds or x.ndim > 1:
        raise ValueError(f"no column type for the answer {answer!r}")
    return f"array<{kinds[x.dtype.kind]}>" if x.ndim else kinds[x.dtype.kind]


def window_results(x: np.ndarray, function: str | Callable, sizes: list[int], q: float | None) -> np.ndarray:
    """``function`` of every window of an array. Windows are views, some rows of them at a time; values of a rank in large windows are selected."""
    n, size = x.ndim, int(np.prod(sizes))
    if function in ("min", "max"):
        return running(x, sizes, np.fmin if function == "min" else np.maximum)
    if function in ("sum", "mean") and np.isfinite(x).all():
        return box_sums(x, sizes) / (size if function == "mean" else 1)
    if size > SORTED_WINDOW and function in ("median", "lower_median", "quantile", "nan_median"):
        bad = box_sums(np.isnan(x).astype(np.int64), sizes)
        count = size - bad if function == "nan_median" else size
        at = (count - 1) * q if function == "quantile" else (count - 1) // 2 if function == "lower_median" else (count - 1) / 2
        low = np.maximum(np.floor(at), 0).astype(np.int64)
        lower, upper = select_ranks(x, sizes, [low, np.minimum(low + 1, np.maximum(count - 1, 0))]) if function != "lower_median" else (y := select_ranks(x, sizes, [low])) + y
        share = at - np.floor(at)
        out = np.where(share == 0, lower, lower + share * (upper - lower))
        return np.where(bad == size if function == "nan_median" else (bad > 0) & (function != "lower_median"), np.nan, out)
    views = np.lib.stride_tricks.sliding_window_view(x, sizes)
    views = views.transpose(*range(n), *reversed(range(n, 2 * n)))  # first dimension fastest
    call = {"sum": lambda w, q: w.sum(-1), "mean": lambda w, q: w.mean(-1)} | BY_IMAGE
    step = max(1, 2_000_000 // int(size * np.prod(views.shape[1:n])))
    out = np.empty(views.shape[:n])
    for low in range(0, len(views), step):
        part = views[low : low + step]
        flat = part.reshape(*part.shape[:n], -1)
        out[low : low + step] = call[function](flat, q) if isinstance(function, str) else np.apply_along_axis(function, -1, flat)
    return out


def _aligned(x: np.ndarray, span: list[Span], need, counts: Sequence[int]) -> np.ndarray:
    """The part of a padded array that windows of ``counts`` results read: a window may begin after its centre, or end before it."""
    starts = [low + before for (low, _), (before, _) in zip(span, need)]
    return x[tuple(slice(s, s + c + high - low) for s, c, (low, high) in zip(starts, counts, span))]


def _by_image(raster: Raster, function, span: list[Span], by: Border, need, target: list[Axis], q) -> Raster:
    sizes = [high - low + 1 for low, high in span]

    def run(x: np.ndarray) -> np.ndarray:
        if isinstance(by, Fill):
            x = np.pad(x, need, constant_values=float(by.value))
        elif isinstance(by, Pad) and any(s for pair in need for s in pair):
            x = np.pad(x, need, mode=MODES[by.style])
        return window_results(_aligned(x, span, need, [len(a) for a in target]), function, sizes, q)

    made = raster.map_images(run, tuple(target))
    return made.with_df(made.df.withColumnRenamed("v", raster.value), value=raster.value)


def _by_tiles(raster: Raster, function, span: list[Span], by: Border, need, target: list[Axis], q) -> Raster:
    sizes = [high - low + 1 for low, high in span]
    padded = raster if isinstance(by, Inner) or not any(s for p in need for s in p) else pad_raster(raster, by, need)

    def run(blocks: list[np.ndarray], spot: Spot) -> list[np.ndarray]:
        counts = [c.stop - c.start for c in spot.core]
        return [window_results(_aligned(blocks[0], span, need, counts), function, sizes, q)]

    return map_tiles(padded, run, need, target)


def _by_dimension(raster: Raster, values: dict[Callable, list[str]], span: list[Span], target: list[Axis]) -> Raster:
    for dim, (low, high) in enumerate(span):
        for taken, columns in values.items():
            raster = taken(raster, columns, dim, low, high)
        axes = list(raster.axes)
        axes[dim] = target[dim]
        raster = cropped(raster, axes)
    return raster


def _continued(raster: Raster, style: str, span: list[Span]):
    """Like ``scatter``, with every window continued by ``style`` from its own part inside the image.

    What a place takes its value from lies in the same window, so each pixel knows its users without a join.
    """
    df, step = raster.df.withColumn("__o", F.lit(0)), 1
    for a, (low, high) in zip(raster.axes, span):
        here, first, last = F.col(a.name), F.lit(a.first), a.last_column()
        every = range(low, high + 1)
        uses = F.array(*[F.struct((here - e).cast("int").alias("to"), F.lit(d).alias("d")) for e in every for d in every])

        def reads(use: Column) -> Column:
            to = use["to"]
            source = source_index(style, to + use["d"], F.greatest(first, to + low), F.least(last, to + high))
            return F.when(a.contains(to), source == here).otherwise(False)

        df = df.withColumn("__use", F.explode(F.filter(uses, reads)))
        df = df.withColumns({a.name: F.col("__use.to"), "__o": F.col("__o") + (F.col("__use.d") - low) * step}).drop("__use")
        step *= high - low + 1
    return df, [*raster.group, *raster.names]


def _whole(raster: Raster, function, span: list[Span], target: list[Axis], q, returns: str, python: bool, local: str | None = None) -> Raster:
    sizes = [high - low + 1 for low, high in span]
    steps = np.concatenate([[1], np.cumprod(sizes)[:-1]]).astype(int)
    taps = []
    for at in product(*[range(low, high + 1) for low, high in span]):
        taps.append((at, {"__o": int(sum((a - low) * s for a, (low, _), s in zip(at, span, steps)))}))
    df, group = _continued(raster, local, span) if local else scatter(raster, taps, target)
    v, o = F.col(raster.value), F.col("__o")
    if python:
        @F.pandas_udf(returns)
        def call(windows: pd.Series) -> pd.Series:
            answers = [function(np.asarray(w)) for w in windows]
            return pd.Series([a.tolist() if isinstance(a, (np.ndarray, np.generic)) else a for a in answers])

        listed = df.groupBy(*group).agg(F.array_sort(F.collect_list(F.struct(o.alias("o"), v.alias("v")))).alias("__w"))
        full = F.when(F.size("__w") == len(taps), F.col("__w.v")).otherwise(F.raise_error(F.lit(MISSING)))
        made = listed.select(*group, call(full).alias(raster.value))
    else:
        f = aggregates(function, q) if isinstance(function, str) else function
        made = df.groupBy(*group).agg(F.when(whole_stencil(len(taps)), f(v, o)).alias(raster.value))
    return raster.with_df(made, target)


def sparse_window(raster: Raster, function: str, low: int, high: int) -> Raster:
    """min, max, sum, mean or count of the pixels low..high around each pixel of lines with gaps: what has no row doesn't count, and results
    stand where pixels do. Frames go by index, not by row, so no gap is filled."""
    known = {"min": F.min, "max": F.max, "sum": F.sum, "mean": F.avg, "count": F.count}
    if len(raster.axes) != 1 or function not in known:
        raise ValueError(f"sparse windows are {', '.join(known)} along one dimension")
    window = Window.partitionBy(*raster.group).orderBy(raster.names[0]).rangeBetween(low, high)
    return raster.with_df(raster.df.withColumn(raster.value, known[function](raster.value).over(window)))


def strided(raster: Raster, indices: dict[str, range]) -> Raster:
    df, axes = raster.df, []
    for a in raster.axes:
        r = indices.get(a.name)
        if r is not None:
            if r.start < a.first or (not a.ragged and r[-1] > a.last):
                raise ValueError(f"{a.name}: {r} is outside {a.first}..{a.last}")
            df = df.where(F.col(a.name).between(r.start, r[-1]) & (F.pmod(F.col(a.name) - r.start, F.lit(r.step)) == 0))
            if r.step != 1:
                df = df.withColumn(a.name, F.floor((F.col(a.name) - r.start) / r.step).cast("int"))
                a = Axis(a.name, 0, len(r) - 1)
            else:
                a = Axis(a.name, r.start, r[-1])
        axes.append(a)
    return raster.with_df(df, axes)
