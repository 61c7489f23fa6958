"""Gradients, local extrema and blobs."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from functools import reduce

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rastrum.functions.borders import Border, Pad, border
from rastrum.functions.kernels import gradient_kernel, log_kernel, log_terms
from rastrum.operators.filtering import correlate, filter_each, filter_raster
from rastrum.operators.stencil import along, complete, shifted
from rastrum.plans.strategy import by_image
from rastrum.raster import Axis, Raster

#: The name of an axis of colours: neighbours along it are no neighbours in space.
CHANNEL = "c"


def gradients(raster: Raster, kernel: str | Callable = "ando3", by: str | Border = "replicate") -> Raster:
    """Columns g1..gN: the derivative along each dimension. ``kernel``: a name, or a function of
    (which dimensions are longer than one, dimension) that gives the factors."""
    long = [a.ragged or len(a) > 1 for a in raster.axes]
    make = kernel if callable(kernel) else lambda e, d: gradient_kernel(kernel, e, d)
    chained = filter_each(raster, {f"g{d + 1}": make(long, d) for d in range(len(long))}, border(by))
    if chained:
        return chained
    on = [*raster.group, *raster.names]
    parts = []
    for d in range(len(raster.axes)):
        g = filter_raster(raster, tuple(make(long, d)), by)
        parts.append(g.df.select(*on, F.col(g.value).alias(f"g{d + 1}")))
    joined = reduce(lambda a, b: a.join(b, on), parts)  # all sides lie by key already
    return raster.with_df(joined, value="g1")


def _extrema(raster: Raster, window: Sequence[int] | None, edges: bool | Sequence[bool], sign: int) -> DataFrame:
    n = len(raster.axes)
    window = [1 if a.name == CHANNEL else 3 for a in raster.axes] if window is None else list(window)
    edges = [edges] * n if isinstance(edges, bool) else list(edges)
    if len(window) != n or len(edges) != n:
        raise ValueError("window and edges need one entry for each dimension")
    # The largest value of each window and how many pixels have it, along one dimension after the other
    there = F.coalesce(F.col(raster.value).cast("double"), F.lit(float("nan"))) * sign
    current = raster.with_df(raster.df.withColumns({"__v": F.when(F.isnan(there), float("nan")).otherwise(there)}).withColumns({"__m": F.col("__v"), "__n": F.lit(1)}))
    for d, w in enumerate(window):
        if w == 1:
            continue
        frame = along(current, d)
        tops = [shifted(F.col("__m"), k, frame) for k in range(-(w // 2), w // 2 + 1)]
        counts = [shifted(F.col("__n"), k, frame) for k in range(-(w // 2), w // 2 + 1)]
        top = F.greatest(*tops)
        many = reduce(lambda a, b: a + b, [F.when(t == F.col("__top"), n).otherwise(0) for t, n in zip([F.col(f"__t{k}") for k in range(len(tops))], [F.col(f"__c{k}") for k in range(len(tops))])])
        df = current.df.withColumns({"__top": F.when(complete(current, d, frame), top), **{f"__t{k}": t for k, t in enumerate(tops)}, **{f"__c{k}": c for k, c in enumerate(counts)}})
        df = df.withColumns({"__n": many, "__m": F.col("__top")}).drop("__top", *[f"__{x}{k}" for k in range(len(tops)) for x in "tc"])
        current = current.with_df(df)
    keep = (F.col("__v") == F.col("__m")) & (F.col("__n") == 1) & ~F.isnan("__v")
    for a, e in zip(raster.axes, edges):
        if not e:
            keep = keep & (F.col(a.name) > a.first) & (F.col(a.name) < a.last_column())
    return current.df.where(keep).select(*raster.keys, *raster.names, raster.value)


def find_local_maxima(raster: Raster, window: Sequence[int] | None = None, edges: bool | Sequence[bool] = True) -> DataFrame:
    """Pixels strictly above all others of their window (3 along each dimension of space by default); plateaus give
    none, NaN blocks its neighbours."""
    return _extrema(raster, window, edges, 1)


def find_local_minima(raster: Raster, window: Sequence[int] | None = None, edges: bool | Sequence[bool] = True) -> DataFrame:
    return _extrema(raster, window, edges, -1)


def blob_log(
    raster: Raster,
    scales: Sequence[float],
    edges: bool | Sequence[bool] | None = None,
    shape: Sequence[float] | None = None,
    threshold: float = 1 / 1000,
) -> DataFrame:
    """Blobs: local maxima over place and scale of the negated, scaled Laplacian of Gaussian.

    Returns keys, place, sigma and radius (arrays; sigma times the square root of two), amplitude. ``edges``: for the scale
    axis and each dimension, whether extrema at the ends count (default: scales yes, places no).
    ``threshold`` is relative to the largest magnitude of the image; 0 keeps all. Images with a key are taken
    whole, all scales at a time; for others all scales go through one chain of windows, as sums of separable terms.
    """
    n = len(raster.axes)
    shape = [1.0] * n if shape is None else list(shape)
    scales = sorted(scales)
    flags = [True] + [False] * n if edges is None else [edges] * (n + 1) if isinstance(edges, bool) else list(edges)
    kernels = [log_kernel([s * f for f in shape]) for s in scales]
    places = (Axis("__s", 0, len(scales) - 1), *raster.axes)
    whole = raster.with_df(raster.df.withColumn(raster.value, F.col(raster.value).cast("double")))
    if by_image(whole):
        def stacked(x: np.ndarray) -> np.ndarray:
            return np.stack([-s * correlate(np.pad(x, k.reach_sizes(), mode="reflect"), k) for s, k in zip(scales, kernels)])

        cube = whole.map_images(stacked, places)
        cube = cube.with_df(cube.df.withColumnRenamed("v", "amplitude"), value="amplitude")
    else:
        terms = {f"__{s}_{d}": t for s, sigma in enumerate(scales) for d, t in enumerate(log_terms([sigma * f for f in shape]))}
        chain = filter_each(whole, terms, Pad("reflect"))
        levels = [F.struct(F.lit(s).alias("__s"), (reduce(lambda a, b: a + b, [F.col(f"__{s}_{d}") for d in range(n)]) * -sigma).alias("amplitude")) for s, sigma in enumerate(scales)]
        stack = chain.df.select(*raster.group, *raster.names, F.explode(F.array(*levels)).alias("__e")).select(*raster.group, *raster.names, "__e.*")
        cube = Raster(stack, raster.keys, places, "amplitude", raster.carried)
    found = _extrema(cube, [3] * (n + 1), flags, 1)
    sigma = F.element_at(F.array(*[F.array(*[F.lit(float(s * f)) for f in shape]) for s in scales]), F.col("__s") + 1)
    if threshold:
        top = raster.df.groupBy(*raster.keys).agg(F.max(F.abs(raster.value)).alias("__top"))
        floor = F.element_at(F.array(*[F.lit(threshold / (s**n * math.prod(shape))) for s in scales]), F.col("__s") + 1)
        found = found.join(top, list(raster.keys)) if raster.keys else found.crossJoin(F.broadcast(top))
        found = found.where(F.col("amplitude") > floor * F.col("__top"))
    found = found.select(*raster.keys, *raster.names, sigma.alias("sigma"), "amplitude")
    return found.select(*raster.keys, *raster.names, "sigma", F.transform("sigma", lambda s: s * math.sqrt(2)).alias("radius"), "amplitude")
