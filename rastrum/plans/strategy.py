"""Choices made before a DataFrame plan exists: factors, copies, extents, and the physical form."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

from rastrum.functions.borders import Extent
from rastrum.functions.kernels import Kernel, Laplacian, OneD, Recursive, centered, separate
from rastrum.raster import Raster

#: Beyond these taps of one factor whole images go through a Fourier transform, if they fit a row of this many pixels.
FOURIER_TAPS = 30
IMAGE_PIXELS = 1 << 22
Factor = Kernel | OneD


def factors_of(kernel, ndim: int, separable: bool = True) -> list[Factor]:
    """A kernel, a sequence of them, or a plain array as the list of factors that have an effect.

    Real two-dimensional kernels of rank one are split; a one-element tuple or ``separable=False``
    opts out. Stencils with weights along one dimension only become ``OneD``.
    """
    single = not isinstance(kernel, (tuple, list)) or (len(kernel) > 0 and np.isscalar(kernel[0]))
    if isinstance(kernel, list) and kernel and not isinstance(kernel[0], (Kernel, OneD, Laplacian, Recursive)):
        kernel, single = np.asarray(kernel), True
    out: list[Factor] = []
    for k in [kernel] if single else list(kernel):
        if isinstance(k, Laplacian):
            k = k.dense()
        elif not isinstance(k, (Kernel, OneD)):
            k = centered(np.asarray(k))
        if k.ndim != ndim:
            raise ValueError(f"a kernel of {k.ndim} dimensions on a raster of {ndim}")
        if k.is_copy():
            continue
        if isinstance(k, Kernel):
            wide = [d for d, s in enumerate(k.weights.shape) if s > 1 or k.origin[d]]
            if len(wide) <= 1 and ndim:
                d = wide[0] if wide else 0
                k = OneD(k.weights.reshape(-1), k.origin[d], d, ndim)
            elif single and separable and (parts := separate(k)):
                out += parts
                continue
        out.append(k)
    return out


def extents(factors: Sequence[Factor], ndim: int) -> Extent:
    """Summed reach of all factors: what padding once has to provide."""
    low, high = [0] * ndim, [0] * ndim
    for f in factors:
        for d, (a, b) in enumerate(f.reach()):
            low[d] += max(0, -a)
            high[d] += max(0, b)
    return tuple(zip(low, high))


def by_image(raster: Raster) -> bool:
    """Whether the raster's images can be taken whole: keyed, of one size that fits a row, of floating-point pixels."""
    kind = raster.df.schema[raster.value].dataType.typeName()
    return bool(raster.keys) and not any(a.ragged for a in raster.axes) and int(np.prod(raster.shape)) <= IMAGE_PIXELS and kind in ("double", "float")


def by_tiles(raster: Raster) -> bool:
    """Whether the raster's images may be dealt in tiles: numbers, of one size, and without a key or too large for a row."""
    kind = raster.df.schema[raster.value].dataType.typeName()
    plain = kind in ("double", "float", "long", "integer", "short", "byte") and not any(a.ragged for a in raster.axes)
    return plain and (not raster.keys or int(np.prod(raster.shape)) > IMAGE_PIXELS)


def in_tiles(raster: Raster, factors: Sequence[Factor], missing: bool) -> bool:
    """Whether tiles take less than windows along lines or scattered sums: many weights, or one line only."""
    if len(raster.axes) == 1 and not raster.keys:
        return True
    if missing:
        factors = [f.dense() if isinstance(f, OneD) else f for f in factors]
        return int(np.prod([sum(len(f.weights.reshape(-1)) if f.weights.shape[d] > 1 else 0 for f in factors) + 1 for d in range(len(raster.axes))])) > FOURIER_TAPS
    many = any(isinstance(f, Kernel) and np.count_nonzero(f.weights) > FOURIER_TAPS for f in factors)
    exact = raster.df.schema[raster.value].dataType.typeName() not in ("double", "float") and all(np.issubdtype(f.weights.dtype, np.integer) for f in factors)
    return many and not exact


def by_fourier(raster: Raster, factors: Sequence[Factor]) -> bool:
    return by_image(raster) and any(np.count_nonzero(f.weights) > FOURIER_TAPS for f in factors)
