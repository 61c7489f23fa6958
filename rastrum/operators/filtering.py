"""Linear filtering of rasters: FIR (windows or scattered sums), Fourier, recursive, and cascades."""

from __future__ import annotations

from dataclasses import replace
from functools import reduce

import numpy as np
from pyspark.sql import functions as F

from rastrum.functions.borders import NA, Border, Extent, Fill, Inner, Pad, border
from rastrum.functions.kernels import Kernel, Laplacian, OneD, Recursive, convolve_kernels
from rastrum.operators.padding import pad_raster
from rastrum.operators.recursive import filter_recursive
from rastrum.operators.stencil import added, along, complete, cropped, scatter, shifted, whole_stencil
from rastrum.operators.tiles import Spot, map_tiles
from rastrum.plans.strategy import FOURIER_TAPS, Factor, by_fourier, by_image, by_tiles, extents, factors_of, in_tiles
from rastrum.raster import Raster


def filter_raster(
    raster: Raster,
    kernel,
    by: str | Border = "replicate",
    *,
    dtype: str | None = None,
    algorithm: str | None = None,
    roi: dict[str, tuple[int, int]] | None = None,
    separable: bool = True,
) -> Raster:
    """out[I] = sum over J of in[I + J] * kernel[J], with ``by`` for what lies outside.

    ``kernel``: a Kernel, OneD, Laplacian, array (centred) or Recursive, or a sequence applied in turn; the
    image is padded once by all extents together and shrinks with each factor. ``algorithm``:
    "fir", or "fft": by itself the latter for factors of more than 30 weights, if pixels or weights are floating-point
    numbers (what isn't finite is summed directly). Images with a key that fit a row are taken whole there, others in tiles with
    rims (overlap-save), and so is a signal without a key, which has no other lines to deal. A complex kernel gives a
    column of re and im. ``dtype``: Spark type of the result; an overflow is an error under ANSI mode. ``roi``: closed index
    ranges; pixels that can't matter are dropped before anything is shuffled. Types: booleans and integers widen to long, and
    stay exact with integer kernels; decimals and whatever meets a floating-point kernel become double. A null pixel
    is NaN among floating-point ones; a pixel without a row is an error.
    """
    by = border(by)
    raster = widened(raster, by)
    many = list(kernel) if isinstance(kernel, tuple) else [kernel]
    if any(isinstance(k, Recursive) or k is None for k in many):
        out = _mixed(raster, many, by)
        out = out.region(**roi) if roi else out
    else:
        factors = factors_of(kernel, len(raster.axes), separable)
        need = extents(factors, len(raster.axes))
        if algorithm not in (None, "fir", "fft"):
            raise ValueError(f"unknown algorithm {algorithm!r}")
        if any(np.iscomplexobj(f.weights) for f in factors):
            out = _complex(raster, factors, by, need, roi, algorithm)
            return out if dtype is None else out.with_df(out.df.withColumn(out.value, F.struct(*[F.col(f"{out.value}.{p}").cast(dtype).alias(p) for p in ("re", "im")])))
        free = algorithm is None and not isinstance(by, NA) and by.sizes is None
        if factors and (algorithm == "fft" or free and by_image(raster) and by_fourier(raster, factors)) and not by_tiles(raster):
            out = _fourier(raster, factors, by, need)
            out = out.region(**roi) if roi else out
        elif factors and by_tiles(raster) and (algorithm == "fft" or algorithm is None and in_tiles(raster, factors, isinstance(by, NA))):
            out = _tiled(raster, factors, by, need, roi)
        elif isinstance(kernel, Laplacian) and not isinstance(by, NA):
            out = _laplacian(raster, kernel, by, need, roi)
        elif isinstance(by, NA):
            out = _available(raster, factors, by)
            out = out.region(**roi) if roi else out
        else:
            out = _direct(raster, factors, by, need, roi)
    return out if dtype is None else out.with_df(out.df.withColumn(out.value, F.col(out.value).cast(dtype)))


def _sizes(by: Border, need: Extent) -> Extent:
    sizes = by.sizes or need
    if len(sizes) != len(need):
        raise ValueError(f"the border has sizes for {len(sizes)} dimensions, the raster has {len(need)}")
    if any(a < b or c < d for (a, c), (b, d) in zip(sizes, need)):
        raise ValueError(f"the border {sizes} is smaller than the kernel's reach {need}")
    return sizes


def _padded(raster: Raster, by: Border, need: Extent, roi: dict | None = None) -> tuple[Raster, list]:
    """The padded raster without what no result needs, and the axes of the result."""
    target = list(raster.axes)
    if isinstance(by, Inner):
        target = [a.grown(-low, -high) for a, (low, high) in zip(target, _sizes(by, need))]
        padded = raster
    else:
        padded = pad_raster(raster, by, _sizes(by, need)) if any(s for pair in need for s in pair) else raster
    for k, a in enumerate(target):
        if roi and a.name in roi:
            low, high = roi[a.name]
            if low < a.first or (not a.ragged and high > a.last):
                raise ValueError(f"{a.name}: {low}..{high} is outside {a.first}..{a.last}")
            target[k] = type(a)(a.name, low, high)
    wanted = [a.grown(low, high) for a, (low, high) in zip(target, need)]
    return cropped(padded, wanted), target


def _direct(raster: Raster, factors: list[Factor], by: Border, need: Extent, roi: dict | None) -> Raster:
    current, target = _padded(raster, by, need, roi)
    for f in factors:
        reach = f.reach()
        axes = [a.grown(-max(0, -low), -max(0, high)) for a, (low, high) in zip(current.axes, reach)]
        current = _line(current, f, axes) if isinstance(f, OneD) else _dense(current, f, axes)
    return cropped(current, target)


def widened(raster: Raster, by: Border) -> Raster:
    """Pixels in the type that sums are taken in; nulls of floating-point pixels as NaN, unless the border has a rule for them."""
    kind, v = raster.df.schema[raster.value].dataType.typeName(), F.col(raster.value)
    if kind in ("boolean", "byte", "short", "integer"):
        return raster.with_df(raster.df.withColumn(raster.value, v.cast("int").cast("long") if kind == "boolean" else v.cast("long")))
    if kind == "decimal":
        return raster.with_df(raster.df.withColumn(raster.value, v.cast("double")))
    if kind in ("double", "float") and not isinstance(by, NA):
        return replace(raster, df=raster.df.withColumn(raster.value, F.coalesce(v, F.lit(float("nan")).cast(kind))))  # array rows stay: nulls are NaN there anyway
    return raster


def _laplacian(raster: Raster, kernel: Laplacian, by: Border, need: Extent, roi: dict | None) -> Raster:
    """Both neighbours minus twice the centre along each flagged dimension: one window for each, nothing is scattered."""
    current, target = _padded(raster, by, need, roi)
    v, total = F.col("__here"), F.col(raster.value)
    zero = F.lit(0).cast(current.df.schema[raster.value].dataType)
    current = current.with_df(current.df.withColumn("__here", total).withColumn(raster.value, zero))
    for d, flagged in enumerate(kernel.flags):
        if flagged:
            window = along(current, d)
            sides = shifted(v, 1, window) + shifted(v, -1, window) - v * 2
            there = complete(current, d, window)
            # The rim along this dimension has no sides, and isn't needed along the others either
            axes = [target[k] if k == d else a for k, a in enumerate(current.axes)]
            current = cropped(current.with_df(current.df.withColumn(raster.value, F.when(there, total + sides))), axes)
    return cropped(current.with_df(current.df.drop("__here")), target)


def _complex(raster: Raster, factors: list[Factor], by: Border, need: Extent, roi: dict | None, algorithm: str | None) -> Raster:
    """Real and imaginary sums from one scattering, or one Fourier filter for each part."""
    if isinstance(by, NA):
        raise ValueError("a complex kernel has no normalisation for missing pixels")
    whole = convolve_kernels(*[f.dense() if isinstance(f, OneD) else f for f in factors])
    parts = {"re": Kernel(whole.weights.real, whole.origin), "im": Kernel(whole.weights.imag, whole.origin)}
    if by_tiles(raster) and (algorithm == "fft" or algorithm is None and in_tiles(raster, [whole], False)):
        out = _tiled(raster, list(parts.values()), by, need, roi, list(parts))
        return out.with_df(out.df.withColumn(raster.value, F.struct("re", "im")).drop("re", "im"), value=raster.value)
    if algorithm == "fft":
        sides = [_fourier(raster, [k], by, need) for k in parts.values()]
        on = [*raster.group, *raster.names]
        re, im = (s.df.select(*on, F.col(s.value).alias(p)) for s, p in zip(sides, parts))
        out = sides[0].with_df(re.join(im, on).select(*on, F.struct("re", "im").alias(raster.value)), value=raster.value)
        return out.region(**roi) if roi else out
    current, target = _padded(raster, by, need, roi)
    df, group = scatter(current, [(at, {"__w": float(w.real), "__x": float(w.imag)}) for at, w in whole.taps()], target)
    v = F.col(raster.value)
    made = F.struct(F.sum(v * F.col("__w")).alias("re"), F.sum(v * F.col("__x")).alias("im"))
    return raster.with_df(df.groupBy(*group).agg(made.alias(raster.value)), target)


def _tiled(raster: Raster, factors: list[Factor], by: Border, need: Extent, roi: dict | None, parts: list[str] | None = None) -> Raster:
    """Tiles with their rims, each by one transform whose wrapped part is never read (overlap-save); integers with integer weights
    are summed as they are. ``parts``: one result for each factor instead of one for all of them in turn."""
    kernels = [f.dense() if isinstance(f, OneD) else f for f in factors]
    kernels = [_covering(k) for k in (kernels if parts else [convolve_kernels(*kernels)])]
    exact = all(k.integer for k in kernels) and raster.df.schema[raster.value].dataType.typeName() == "long"
    if isinstance(by, NA):
        (kernel,) = kernels
        sizes = kernel.reach_sizes()
        there = ~by.missing(F.col(raster.value))
        marked = raster.with_df(raster.df.withColumn("__there", there.cast("double")).withColumn(raster.value, F.when(there, F.col(raster.value).cast("double")).otherwise(0.0)))

        def ratio(blocks: list[np.ndarray], spot: Spot) -> list[np.ndarray]:
            above, below = (correlate(np.pad(b, missing_rim(b, spot, sizes)), kernel) for b in blocks)
            none = np.abs(below) <= 1e-12 * np.abs(kernel.weights).sum()  # as near to zero as a transform comes
            return [np.where(none, np.nan, above) / np.where(none, 1, below)]

        out = map_tiles(marked, ratio, sizes, raster.axes, values=[raster.value, "__there"], made=[raster.value], clipped=True)
        return out.region(**roi) if roi else out
    # The border may have sizes of its own, the tiles need no more than the kernel's reach
    current, target = _padded(raster, by, need, roi)
    reach = tuple((max(k.reach_sizes()[d][0] for k in kernels), max(k.reach_sizes()[d][1] for k in kernels)) for d in range(len(target)))
    current = cropped(current, [a.grown(*r) for a, r in zip(target, reach)])

    def filtered(blocks: list[np.ndarray], spot: Spot) -> list[np.ndarray]:
        out = []
        for k in kernels:
            inside = tuple(slice(low - a, s - (high - b)) for s, (low, high), (a, b) in zip(blocks[0].shape, reach, k.reach_sizes()))
            out.append(direct(blocks[0][inside], k) if exact else correlate(blocks[0][inside], k))
        return out

    return map_tiles(current, filtered, reach, target, made=parts or [raster.value], whole=exact)


def missing_rim(block: np.ndarray, spot: Spot, sizes: Extent) -> list[tuple[int, int]]:
    """How many of the pixels around the core the block doesn't have, as it ends where the raster does."""
    return [(low - core.start, high - (n - core.stop)) for n, core, (low, high) in zip(block.shape, spot.core, sizes)]


def _covering(k: Kernel) -> Kernel:
    """The kernel with zeros up to displacement zero, where that lies outside."""
    reach = tuple((min(0, a), max(0, b)) for a, b in k.reach())
    weights = np.zeros(tuple(b - a + 1 for a, b in reach), k.weights.dtype)
    weights[tuple(slice(low - a, low - a + s) for (a, _), (low, _), s in zip(reach, k.reach(), k.weights.shape))] = k.weights
    return Kernel(weights, tuple(-a for a, _ in reach))


def filter_each(raster: Raster, kernels: dict[str, tuple], by: Border) -> Raster | None:
    """One column for each named kernel, from one chain of windows. None where a kernel isn't one factor a dimension at most."""
    n = len(raster.axes)
    lists = {name: factors_of(tuple(k), n) for name, k in kernels.items()}
    single = all(isinstance(f, OneD) for fs in lists.values() for f in fs) and all(len({f.dim for f in fs}) == len(fs) for fs in lists.values())
    if not single or isinstance(by, NA):
        return None
    reaches = [extents(fs, n) for fs in lists.values()]
    need = tuple((max(r[d][0] for r in reaches), max(r[d][1] for r in reaches)) for d in range(n))
    current, target = _padded(raster, by, need)
    current = current.with_df(current.df.withColumns({name: F.col(raster.value).cast("double") for name in lists}))
    for dim in range(n):
        window = along(current, dim)
        made = {}
        for name, factors in lists.items():
            for f in factors:
                if f.dim == dim:
                    terms = [shifted(F.col(name), k - f.origin, window) * F.lit(_weight(w)) for k, w in enumerate(f.weights.tolist()) if w != 0]
                    made[name] = F.when(complete(current, dim, window), reduce(lambda a, b: a + b, terms) if terms else F.col(name) * 0)
        axes = [target[d] if d <= dim else a for d, a in enumerate(current.axes)]
        current = cropped(current.with_df(current.df.withColumns(made) if made else current.df), axes)
    return current.with_df(current.df.drop(raster.value), value=next(iter(lists)))


def _weight(w) -> int | float:
    return int(w) if isinstance(w, (int, np.integer)) else float(w)


def _line(raster: Raster, f: OneD, axes: list) -> Raster:
    weights = f.weights.tolist()
    if len(weights) > 8 and len(set(weights)) == 1 and weights[0] != 0:  # a box: sums of any width in a few windows
        summed = added(raster, [raster.value], f.dim, -f.origin, len(weights) - 1 - f.origin)
        return cropped(summed.with_df(summed.df.withColumn(raster.value, F.col(raster.value) * F.lit(_weight(weights[0])))), axes)
    window, v = along(raster, f.dim), F.col(raster.value)
    terms = [shifted(v, k - f.origin, window) * F.lit(_weight(w)) for k, w in enumerate(weights) if w != 0]
    total = reduce(lambda a, b: a + b, terms) if terms else v * 0
    return cropped(raster.with_df(raster.df.withColumn(raster.value, F.when(complete(raster, f.dim, window), total))), axes)


def _dense(raster: Raster, f: Kernel, axes: list) -> Raster:
    taps = [(at, {"__w": _weight(w)}) for at, w in f.taps()]
    if not taps:
        taps = [((0,) * f.ndim, {"__w": 0})]
    df, group = scatter(raster, taps, axes)
    summed = df.groupBy(*group).agg(F.when(whole_stencil(len(taps)), F.sum(F.col(raster.value) * F.col("__w"))).alias(raster.value))
    return raster.with_df(summed, axes)


def _available(raster: Raster, factors: list[Factor], by: NA) -> Raster:
    """Weighted sum over available pixels divided by the sum of their weights; NaN where there are none."""
    if not factors:
        return raster
    whole = convolve_kernels(*[f.dense() if isinstance(f, OneD) else f for f in factors])
    df, group = scatter(raster, [(at, {"__w": float(w)}) for at, w in whole.taps()], raster.axes)
    v, w = F.col(raster.value).cast("double"), F.col("__w")
    there = ~by.missing(F.col(raster.value))
    sums = df.groupBy(*group).agg(F.sum(F.when(there, v * w).otherwise(0.0)).alias("__s"), F.sum(F.when(there, w).otherwise(0.0)).alias("__m"))
    ratio = F.when(F.col("__m") == 0, F.when(F.col("__s") == 0, float("nan")).otherwise(F.col("__s") * float("inf"))).otherwise(F.col("__s") / F.col("__m"))
    return raster.with_df(sums.select(*group, ratio.alias(raster.value)))


def smooth_size(n: int) -> int:
    """The least 2^a 3^b that is n or more: what a transform takes least time for."""
    best = 1 << max(0, n - 1).bit_length()
    power = 1
    while power < best:
        best = min(best, power << max(0, -(-n // power) - 1).bit_length())
        power *= 3
    return best


def direct(image: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Valid part of a correlation, weight by weight."""
    shape = tuple(s - k + 1 for s, k in zip(image.shape, kernel.weights.shape))
    out = np.zeros(shape, np.result_type(image, kernel.weights))
    for at in np.ndindex(kernel.weights.shape):
        if kernel.weights[at]:
            out += image[tuple(slice(a, a + s) for a, s in zip(at, shape))] * kernel.weights[at]
    return out


def correlate(image: np.ndarray, kernel: Kernel) -> np.ndarray:
    """Valid part of a correlation by Fourier transform; direct where there are few weights or a pixel isn't finite."""
    if np.count_nonzero(kernel.weights) <= FOURIER_TAPS or not np.isfinite(image).all():
        return direct(np.asarray(image, float), kernel)
    shape = tuple(smooth_size(s) for s in image.shape)
    spectrum = np.fft.rfftn(image, shape) * np.conj(np.fft.rfftn(kernel.weights, shape))
    return np.fft.irfftn(spectrum, shape)[tuple(slice(0, s - k + 1) for s, k in zip(image.shape, kernel.weights.shape))]


def _fourier(raster: Raster, factors: list[Factor], by: Border, need: Extent) -> Raster:
    if not factors:
        return raster
    whole = convolve_kernels(*[f.dense() if isinstance(f, OneD) else f for f in factors])
    kernel = _covering(whole)
    sizes = kernel.reach_sizes()
    if isinstance(by, Inner):
        return raster.map_images(lambda x: correlate(x, kernel), tuple(a.grown(-low, -high) for a, (low, high) in zip(raster.axes, sizes)))
    if isinstance(by, NA):
        def ratio(x: np.ndarray) -> np.ndarray:
            there = ~np.isnan(x)
            above = correlate(np.pad(np.where(there, x, 0), sizes), kernel)
            return above / correlate(np.pad(there.astype(float), sizes), kernel)

        return raster.map_images(ratio)
    modes = {"replicate": "edge", "circular": "wrap", "symmetric": "symmetric", "reflect": "reflect"}
    if isinstance(by, Fill):
        value = float(by.value)
        return raster.map_images(lambda x: correlate(np.pad(x, sizes, constant_values=value), kernel))
    assert isinstance(by, Pad)
    mode = modes[by.style]
    return raster.map_images(lambda x: correlate(np.pad(x, sizes, mode=mode), kernel))


def _mixed(raster: Raster, stages: list, by: Border) -> Raster:
    """Recursive factors take the dimensions in turn; the others are ordinary stages between them.

    The raster is padded once, by twice the reach of the ordinary stages, and cropped at the end: what a recursion
    takes for the constant beyond its line is constant then, so the order of the stages doesn't matter (for a Pad style
    other than replicate: but for what the recursion sees of the padding).
    """
    if isinstance(by, Inner):
        raise ValueError("a recursive filter has no inner part")
    if sum(isinstance(s, Recursive) or s is None for s in stages) > len(raster.axes):
        raise ValueError("more recursive factors than dimensions")
    if isinstance(by, NA):
        there = ~by.missing(F.col(raster.value))
        zero = raster.with_df(raster.df.withColumn(raster.value, F.when(there, F.col(raster.value).cast("double")).otherwise(0.0)))
        mask = raster.with_df(raster.df.withColumn(raster.value, there.cast("double")))
        above, below = _mixed(zero, stages, Fill(0.0)), _mixed(mask, stages, Fill(0.0))
        join = [*raster.group, *raster.names]
        both = above.df.join(below.df.withColumnRenamed(below.value, "__m"), join)
        ratio = F.when(F.col("__m") == 0, float("nan")).otherwise(F.col(above.value) / F.col("__m"))
        return above.with_df(both.select(*join, ratio.alias(above.value)))
    plain = [f for s in stages if s is not None and not isinstance(s, Recursive) for f in factors_of(s, len(raster.axes))]
    need = tuple((2 * low, 2 * high) for low, high in extents(plain, len(raster.axes)))
    out, dim = pad_raster(raster, by, need) if plain else raster, 0
    for s in stages:
        if s is None:
            dim += 1
        elif isinstance(s, Recursive):
            out, dim = filter_recursive(out, s, dim, by), dim + 1
        else:
            out = filter_raster(out, s, Inner(), algorithm="fir")
    return cropped(out, raster.axes)
