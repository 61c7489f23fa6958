"""Kernel catalogue. Kernels are tiny numpy arrays with an origin; they live on the driver.

``filter_raster`` correlates: out[I] = sum over J of in[I + J] * kernel[J].
"""

from __future__ import annotations

import math
import warnings
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np


class Weighted:
    """Equality and hash by value for classes with arrays among their fields."""

    def __eq__(self, other: object) -> bool:
        if type(other) is not type(self):
            return NotImplemented
        return all(np.array_equal(a, b) if isinstance(a, np.ndarray) else a == b for a, b in zip(vars(self).values(), vars(other).values()))

    def __hash__(self) -> int:
        return hash((type(self).__name__, *(v.shape if isinstance(v, np.ndarray) else v for v in vars(self).values())))


@dataclass(frozen=True, eq=False)
class Kernel(Weighted):
    """Dense weights; ``origin`` is the position of displacement zero."""

    weights: np.ndarray
    origin: tuple[int, ...]

    @property
    def ndim(self) -> int:
        return self.weights.ndim

    @property
    def integer(self) -> bool:
        return np.issubdtype(self.weights.dtype, np.integer)

    def reach(self) -> tuple[tuple[int, int], ...]:
        """Least and largest displacement for each dimension."""
        return tuple((-o, s - 1 - o) for o, s in zip(self.origin, self.weights.shape))

    def reach_sizes(self) -> tuple[tuple[int, int], ...]:
        """How many pixels it needs before and after each place."""
        return tuple((max(0, -low), max(0, high)) for low, high in self.reach())

    def taps(self) -> Iterator[tuple[tuple[int, ...], float]]:
        for at in np.ndindex(self.weights.shape):
            if self.weights[at] != 0:
                yield tuple(int(a - o) for a, o in zip(at, self.origin)), self.weights[at].item()

    def is_copy(self) -> bool:
        """Whether it changes nothing: the single weight one (or no dimension at all)."""
        return self.weights.size == 1 and self.weights.item() == 1


@dataclass(frozen=True, eq=False)
class OneD(Weighted):
    """A one-dimensional stencil along dimension ``dim`` of ``ndim``."""

    weights: np.ndarray
    origin: int
    dim: int
    ndim: int

    def dense(self) -> Kernel:
        shape = [1] * self.ndim
        shape[self.dim] = len(self.weights)
        return Kernel(self.weights.reshape(shape), tuple(self.origin if d == self.dim else 0 for d in range(self.ndim)))

    def reach(self) -> tuple[tuple[int, int], ...]:
        return self.dense().reach()

    def is_copy(self) -> bool:
        return len(self.weights) == 1 and self.weights[0] == 1

    def __add__(self, other: OneD | float) -> Kernel:
        return _elementwise(self, other, np.add)

    def __sub__(self, other: OneD | float) -> Kernel:
        return _elementwise(self, other, np.subtract)

    def __mul__(self, other: float) -> OneD:
        return OneD(self.weights * other, self.origin, self.dim, self.ndim)

    def __truediv__(self, other: float) -> OneD:
        return OneD(self.weights / other, self.origin, self.dim, self.ndim)


@dataclass(frozen=True, eq=False)
class Recursive(Weighted):
    """A third-order recursive filter: forward and backward coefficients, scale, right-edge matrix."""

    forward: tuple[float, float, float]
    backward: tuple[float, float, float]
    scale: float
    edge: np.ndarray = field(repr=False)


@dataclass(frozen=True)
class Laplacian:
    """Sum of the two neighbours minus twice the centre, along each flagged dimension."""

    flags: tuple[bool, ...] = (True, True)

    @staticmethod
    def along(dims: Sequence[int], ndim: int) -> Laplacian:
        return Laplacian(tuple(d in dims for d in range(ndim)))

    def dense(self) -> Kernel:
        shape = tuple(3 if f else 1 for f in self.flags)
        w = np.zeros(shape, np.int64)
        origin = tuple(1 if f else 0 for f in self.flags)
        for d, f in enumerate(self.flags):
            for side in (-1, 1) if f else ():
                at = list(origin)
                at[d] += side
                w[tuple(at)] = 1
        w[origin] -= 2 * sum(self.flags)
        return Kernel(w, origin)


def _elementwise(a: OneD, b: OneD | float, f: Callable) -> Kernel:
    x = a.dense()
    if not isinstance(b, OneD):
        return Kernel(f(x.weights, b), x.origin)
    y = b.dense()
    if x.reach() != y.reach():
        raise ValueError("the stencils cover different displacements")
    return Kernel(f(x.weights, y.weights), x.origin)


def centered(weights: np.ndarray | Sequence) -> Kernel:
    """The origin at the centre; of an even number of weights the one before the middle."""
    w = np.asarray(weights)
    return Kernel(w, tuple((s - 1) // 2 for s in w.shape))


def kernel_at(weights: np.ndarray | Sequence, first: Sequence[int]) -> Kernel:
    """Weights whose first displacement along each dimension is given."""
    w = np.asarray(weights)
    return Kernel(w, tuple(-f for f in first))


def factored(*vectors: np.ndarray | Sequence | tuple[Sequence, int]) -> tuple[OneD, ...]:
    """The d-th vector, centred (or with its origin), along dimension d."""
    out = []
    for d, v in enumerate(vectors):
        w, origin = (np.asarray(v[0]), v[1]) if isinstance(v, tuple) and len(v) == 2 and np.ndim(v[0]) == 1 and np.ndim(v[1]) == 0 else (np.asarray(v), None)
        out.append(OneD(w, (len(w) - 1) // 2 if origin is None else origin, d, len(vectors)))
    return tuple(out)


def outer(factors: Sequence[OneD]) -> Kernel:
    """The dense kernel of factors along different dimensions."""
    return convolve_kernels(*[f.dense() for f in factors])


def convolve_kernels(*kernels: Kernel) -> Kernel:
    """Full convolution: one kernel that does what the given ones do in turn."""
    total = kernels[0]
    for k in kernels[1:]:
        shape = tuple(a + b - 1 for a, b in zip(total.weights.shape, k.weights.shape))
        w = np.zeros(shape, np.result_type(total.weights, k.weights))
        for at in np.ndindex(k.weights.shape):
            w[tuple(slice(a, a + s) for a, s in zip(at, total.weights.shape))] += total.weights * k.weights[at]
        total = Kernel(w, tuple(a + b for a, b in zip(total.origin, k.origin)))
    return total


def reflect(kernel: Kernel) -> Kernel:
    """Displacements negated: correlation becomes convolution."""
    return Kernel(np.flip(kernel.weights), tuple(s - 1 - o for s, o in zip(kernel.weights.shape, kernel.origin)))


def separate(kernel: Kernel) -> tuple[OneD, OneD] | None:
    """Two factors of a real two-dimensional kernel of rank one, else None. Integer kernels stay whole."""
    if kernel.ndim != 2 or kernel.integer or min(kernel.weights.shape) == 1 or not np.isfinite(kernel.weights).all():
        return None
    u, s, vt = np.linalg.svd(kernel.weights)
    if (s[1:] >= math.sqrt(np.finfo(float).eps)).any():
        return None
    r = math.sqrt(s[0])
    return OneD(r * u[:, 0], kernel.origin[0], 0, 2), OneD(r * vt[0], kernel.origin[1], 1, 2)


def _odd(sizes: Sequence[int]) -> None:
    if any(s < 1 or s % 2 == 0 for s in sizes):
        raise ValueError(f"sizes must be odd, got {tuple(sizes)}")


def box(*sizes: int) -> tuple[OneD, ...]:
    _odd(sizes)
    return factored(*[np.full(s, 1 / s) for s in sizes])


def gaussian_1d(sigma: float, length: int | None = None) -> np.ndarray:
    length = 4 * math.ceil(sigma) + 1 if length is None else length
    _odd([length])
    if sigma == 0:
        return np.ones(1)
    x = np.arange(length) - length // 2
    w = np.exp(-(x**2) / (2 * sigma**2))
    return w / w.sum()


def gaussian(sigmas: Sequence[float] | float, lengths: Sequence[int] | None = None) -> tuple[OneD, ...]:
    """One factor for each dimension; one number means two dimensions."""
    sigmas = (sigmas, sigmas) if np.isscalar(sigmas) else tuple(sigmas)
    return factored(*[gaussian_1d(s, None if lengths is None else lengths[d]) for d, s in enumerate(sigmas)])


# Smoothing weights across the gradient direction.
SMOOTHERS = {
    "sobel": np.array([1, 2, 1]) / 4,
    "prewitt": np.array([1, 1, 1]) / 3,
    "scharr": np.array([3, 10, 3]) / 16,
    "bickley": np.array([1, 4, 1]) / 6,
    "ando3": 2 * np.array([0.112737, 0.274526, 0.112737]),
}
# Optimal consistent gradients of 4 and 5 taps; separable approximations (smoother, difference), dense rows.
ANDO4 = (np.array([0.0919833, 0.408017, 0.408017, 0.0919833]), 1.46205884 * np.array([-0.0919833, -0.408017, 0.408017, 0.0919833]))
ANDO5 = (np.array([0.0357338, 0.248861, 0.43081, 0.248861, 0.0357338]), 0.784406 * np.array([-0.137424, -0.362576, 0, 0.362576, 0.137424]))
ANDO4_DENSE = np.array([[-0.022116, -0.025526, 0.025526, 0.022116], [-0.098381, -0.112984, 0.112984, 0.098381], [-0.098381, -0.112984, 0.112984, 0.098381], [-0.022116, -0.025526, 0.025526, 0.022116]])
ANDO5_DENSE = np.array([
    [-0.003776, -0.010199, 0, 0.010199, 0.003776], [-0.026786, -0.070844, 0, 0.070844, 0.026786], [-0.046548, -0.122572, 0, 0.122572, 0.046548],
    [-0.026786, -0.070844, 0, 0.070844, 0.026786], [-0.003776, -0.010199, 0, 0.010199, 0.003776],
])
GRADIENTS = (*SMOOTHERS, "ando4", "ando5")


def gradient_kernel(name: str, extended: Sequence[bool], dim: int) -> tuple[OneD, ...]:
    """Factors of the gradient along ``dim``; dimensions of length one take a single weight."""
    n = len(extended)
    if name in SMOOTHERS:
        along, across = np.array([-1, 0, 1]) / 2, SMOOTHERS[name]
    elif name in ("ando4", "ando5"):
        if n != 2 or not all(extended):
            raise ValueError(f"{name} is for two dimensions")
        across, along = ANDO4 if name == "ando4" else ANDO5
    else:
        raise ValueError(f"unknown gradient kernel {name!r}")
    return factored(*[np.ones(1) if not e else along if d == dim else across for d, e in enumerate(extended)])


def gradient_dense(name: str, dim: int, ndim: int = 2) -> Kernel:
    """The dense kernel; exact for ando4 and ando5, else the product of the factors."""
    if name in ("ando4", "ando5"):
        w = ANDO4_DENSE if name == "ando4" else ANDO5_DENSE
        return centered(w.T if dim == 0 else w)
    return outer(gradient_kernel(name, [True] * ndim, dim))


def dog(sigma_plus: Sequence[float] | float, sigma_minus: Sequence[float] | None = None, lengths: Sequence[int] | None = None) -> Kernel:
    """Difference of Gaussians; by default the second is wider by the square root of two."""
    plus = (sigma_plus, sigma_plus) if np.isscalar(sigma_plus) else tuple(sigma_plus)
    minus = tuple(math.sqrt(2) * s for s in plus) if sigma_minus is None else tuple(sigma_minus)
    lengths = [4 * math.ceil(s) + 1 for s in minus] if lengths is None else lengths
    a, b = outer(gaussian(plus, lengths)), outer(gaussian(minus, lengths))
    return Kernel(a.weights - b.weights, a.origin)


def _grid(half: Sequence[int]) -> list[np.ndarray]:
    return np.meshgrid(*[np.arange(-h, h + 1) for h in half], indexing="ij")


def log_kernel(sigmas: Sequence[float] | float) -> Kernel:
    """Laplacian of Gaussian."""
    sigmas = (sigmas, sigmas) if np.isscalar(sigmas) else tuple(sigmas)
    half = [math.ceil(8.5 * s) // 2 for s in sigmas]
    x = _grid(half)
    scale = 1 / (math.prod(sigmas) * (2 * math.pi) ** (len(sigmas) / 2))
    bend = sum(g**2 / s**4 for g, s in zip(x, sigmas)) - sum(1 / s**2 for s in sigmas)
    return Kernel(scale * bend * np.exp(-sum(g**2 / s**2 for g, s in zip(x, sigmas)) / 2), tuple(half))


def log_terms(sigmas: Sequence[float] | float) -> list[tuple[OneD, ...]]:
    """The Laplacian of Gaussian as a sum: for each dimension, factors that are bent along it and plain along the others."""
    sigmas = (sigmas, sigmas) if np.isscalar(sigmas) else tuple(sigmas)
    x = [np.arange(-(math.ceil(8.5 * s) // 2), math.ceil(8.5 * s) // 2 + 1) for s in sigmas]
    plain = [np.exp(-(g**2) / (2 * s**2)) / (s * math.sqrt(2 * math.pi)) for g, s in zip(x, sigmas)]
    bent = [(g**2 / s**4 - 1 / s**2) * p for g, s, p in zip(x, sigmas, plain)]
    return [factored(*[bent[e] if e == d else plain[e] for e in range(len(sigmas))]) for d in range(len(sigmas))]


def laplacian2d(alpha: float = 0) -> Kernel:
    corner, edge = alpha / (1 + alpha), (1 - alpha) / (1 + alpha)
    return centered([[corner, edge, corner], [edge, -4 / (1 + alpha), edge], [corner, edge, corner]])


def gabor(size_x: int, size_y: int, sigma: float, theta: float, lam: float, gamma: float, psi: float) -> tuple[np.ndarray, np.ndarray]:
    """Real and imaginary weights (give them to ``centered``)."""
    if sigma <= 0 or lam <= 0 or gamma <= 0:
        raise ValueError("sigma, lambda and gamma must be positive")
    sx, sy, s, c = sigma, sigma / gamma, math.sin(theta), math.cos(theta)

    def half(size: int, along: float, other: float) -> int:
        if size > 0:
            return size // 2
        warnings.warn("the kernel size is chosen from sigma, gamma and theta", stacklevel=3)
        return round(max(abs(3 * sx * along), abs(3 * sy * other), 1))

    hx, hy = half(size_x, c, s), half(size_y, s, c)
    y, x = np.meshgrid(np.arange(-hx, hx + 1), np.arange(-hy, hy + 1), indexing="ij")
    xr, yr = x * c + y * s, -x * s + y * c
    bell = np.exp(-((xr / sx) ** 2 + (yr / sy) ** 2) / 2)
    wave = 2 * math.pi / lam * xr + psi
    return bell * np.cos(wave), bell * np.sin(wave)


def moffat(alpha: float, beta: float, size: int | None = None) -> Kernel:
    width = 2 * alpha * math.sqrt(2 ** (1 / beta) - 1)
    half = (math.ceil(4 * width) if size is None else size) // 2
    y, x = _grid([half, half])
    amplitude = (beta - 1) / (math.pi * alpha**2)
    return Kernel(amplitude * (1 + (x**2 + y**2) / alpha**2) ** -beta, (half, half))


def recursive(forward: Sequence[float], scale: float, backward: Sequence[float] | None = None, edge: np.ndarray | None = None) -> Recursive:
    """Coefficients of length three, the same both ways by default; the right-edge matrix follows from them."""
    backward = tuple(forward) if backward is None else tuple(backward)
    if edge is None:
        # Beyond the end the forward values follow their own recursion, one step of which is ``step``; what the backward one makes
        # of them all is its power series at that matrix, so (1 - b1 z - b2 z^2 - b3 z^3)^-1 with z = step
        step = np.array([forward, (1, 0, 0), (0, 1, 0)], float)
        gathered = np.linalg.inv(np.eye(3) - sum(b * np.linalg.matrix_power(step, k + 1) for k, b in enumerate(backward)))
        edge = np.stack([(gathered @ np.linalg.matrix_power(step, k))[0] for k in range(3)])
    return Recursive(tuple(forward), backward, scale, edge)


def iir_gaussian(sigma: float, warn: bool = True) -> Recursive | None:
    """Recursive Gaussian; None (no filter) for sigma 0. Below 1 it is inaccurate."""
    if sigma == 0:
        return None
    if sigma < 0:
        raise ValueError("sigma must not be negative")
    if warn and sigma < 1:
        warnings.warn(f"sigma {sigma} is too small for an accurate recursive Gaussian", stacklevel=2)
    m0, m1, m2 = 1.16680, 1.10783, 1.40586  # fixed values: pole positions
    q = 1.31564 * (math.sqrt(1 + 0.490811 * sigma**2) - 1)
    size = (m0 + q) * (m1**2 + m2**2 + 2 * m1 * q + q**2)
    a1 = q * (2 * m0 * m1 + m1**2 + m2**2 + (2 * m0 + 4 * m1) * q + 3 * q**2) / size
    a2 = -(q**2) * (m0 + 2 * m1 + 3 * q) / size
    return recursive((a1, a2, q**3 / size), (m0 * (m1**2 + m2**2) / size) ** 2)


def kernel_spectrum(kernel: Kernel, shape: Sequence[int], real: bool = False) -> np.ndarray:
    """The transform of a kernel laid periodically into an array of the given shape."""
    for (low, high), s in zip(kernel.reach(), shape):
        if high - low + 1 > s or -low > s // 2 or high > s - 1 - s // 2 + (s % 2 == 0):
            raise ValueError("the kernel is too large, or too far off its centre, for this shape")
    laid = np.zeros(tuple(shape), kernel.weights.dtype if np.iscomplexobj(kernel.weights) else float)
    for at, w in kernel.taps():
        laid[tuple(a % s for a, s in zip(at, shape))] = w
    return np.fft.rfftn(laid) if real else np.fft.fftn(laid)


def spectrum_kernel(spectrum: np.ndarray, reach: Sequence[tuple[int, int]] | None = None, real_last: int | None = None) -> Kernel:
    """The kernel back from its transform, cropped to displacements ``reach`` (all by default)."""
    if real_last is None:
        laid = np.fft.ifftn(spectrum)
        laid = laid.real if np.allclose(laid.imag, 0, atol=1e-9) else laid
    else:
        shape = (*spectrum.shape[:-1], real_last)
        laid = np.fft.irfftn(spectrum, shape, axes=range(spectrum.ndim))
    reach = [(s // 2 - s + 1, s // 2) for s in laid.shape] if reach is None else reach
    picks = np.ix_(*[[a % s for a in range(low, high + 1)] for (low, high), s in zip(reach, laid.shape)])
    return Kernel(laid[picks], tuple(-low for low, _ in reach))
