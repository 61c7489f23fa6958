"""Total-variation denoising by a primal-dual iteration: images whole in a row, or in tiles.

A round reads one pixel to each side, so a tile with a rim of as many pixels as rounds gives its results without asking
anybody. More rounds than PASS_ROUNDS go in several passes, between which slopes travel as pixels and are written to the shared folder:
an executor that is lost costs one pass of its tiles.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from rastrum.functions.borders import Pad
from rastrum.operators.padding import pad_raster
from rastrum.operators.tiles import Spot, map_tiles
from rastrum.plans.strategy import by_tiles
from rastrum.raster import Raster
from rastrum.sources.tables import kept

PASS_ROUNDS = 32


def tv_rounds(g: np.ndarray, lam: float, rounds: int, periodic: bool = True, channel: int | None = None, slopes: list[np.ndarray] | None = None) -> tuple[np.ndarray, list[np.ndarray]]:
    """min |u - g|^2 + lam TV(u): forward differences and their exact adjoint. Differences are taken along all
    dimensions but ``channel``; the slopes of all channels of a pixel make one norm. Returns u and the slopes, from which
    another call can go on."""
    places, tau = [d for d in range(g.ndim) if d != channel], 0.25
    lam = float(np.float32(lam))

    def forward(x: np.ndarray, d: int) -> np.ndarray:
        y = np.roll(x, -1, d) - x
        if not periodic:
            y[tuple(slice(None) if k != d else -1 for k in range(g.ndim))] = 0
        return y

    def divergence(p: list[np.ndarray]) -> np.ndarray:
        total = np.zeros_like(g)
        for d, x in zip(places, p):
            back = np.roll(x, 1, d)
            if not periodic:
                back[tuple(slice(None) if k != d else 0 for k in range(g.ndim))] = 0
            total += x - back
        return total

    u, p = g, [forward(g, d) for d in places] if slopes is None else slopes
    for _ in range(rounds):
        u = g - lam * divergence(p)
        slope = [forward(u, d) * (tau / lam) for d in places]
        squares = sum(s * s for s in slope)
        size = 1 + np.sqrt(squares if channel is None else squares.sum(channel, keepdims=True))
        p = [(x - s) / size for x, s in zip(p, slope)]
    return u, p


def tv_step_images(g: np.ndarray, lam: float, rounds: int, periodic: bool = True, channel: int | None = None) -> np.ndarray:
    """One image after the given rounds."""
    return tv_rounds(g, lam, rounds, periodic, channel)[0]


def denoise_tv(raster: Raster, lam: float, rounds: int = 10, periodic: bool = True, channel: str | None = None) -> Raster:
    """Every image denoised with a fixed number of rounds; ``periodic`` chooses the rule at the far edges, ``channel``
    names the axis of colours, if there is one. An image without a key, or too large for a row, goes in tiles. A null pixel is NaN."""
    at = None if channel is None else raster.names.index(channel)
    if by_tiles(raster) and rounds > 0:
        return _in_tiles(raster, lam, rounds, periodic, at)
    return raster.map_images(lambda x: tv_step_images(x, lam, rounds, periodic, at))


def _in_tiles(raster: Raster, lam: float, rounds: int, periodic: bool, channel: int | None) -> Raster:
    places = [d for d in range(len(raster.axes)) if d != channel]
    slopes, left = [f"__p{d}" for d in places], rounds
    state, values, colours = raster, [raster.value], 0 if channel is None else len(raster.axes[channel])
    while left:
        now = min(left, PASS_ROUNDS)
        need = tuple((now + 1, now + 1) if d in places else (0, 0) for d in range(len(raster.axes)))

        def run(blocks: list[np.ndarray], spot: Spot, now: int = now) -> list[np.ndarray]:
            if channel is not None and spot.core[channel].stop - spot.core[channel].start < colours:
                raise ValueError("the axis of colours is too long for a tile")
            # What is wrong at the ends of a block that aren't the image's comes nearer by a pixel a round
            u, p = tv_rounds(blocks[0], lam, now, False, channel, blocks[1:] or None)
            return [x[spot.core] for x in (u, blocks[0], *p)]

        padded = pad_raster(state, Pad("circular"), need) if periodic else state
        out = map_tiles(padded, run, need, raster.axes, values=values, made=["__u", raster.value, *slopes], clipped=not periodic)
        left -= now
        values = [raster.value, *slopes]
        state = out.with_df(kept(out.df.drop("__u")) if left else out.df, value=raster.value)
    return raster.with_df(state.df.select(*raster.keys, *raster.names, F.col("__u").alias(raster.value)))
