"""Images larger than a task: every tile with its rim is one group of one exchange, and results are pixels again.

A pixel goes to the tile that it lies in, and a pixel near an edge of it also to the neighbours that need it. Nothing else moves, so
an image of any size is dealt in tiles of a bounded number of pixels, whatever the border rule (padding comes before). A
place without a row, or with two, is a named error.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastrum.functions.borders import Extent
from rastrum.raster import Axis, Raster

#: Results of a tile; with its rim it has some more pixels.
TILE_PIXELS = 1 << 16


@dataclass(frozen=True)
class Spot:
    """Where a tile's results lie inside the block that its function gets, and which sides of the block are ends of the raster."""

    core: tuple[slice, ...]
    ends: tuple[tuple[bool, bool], ...]


def tile_sides(target: Sequence[Axis], need: Extent, pixels: int) -> list[int]:
    """Sides of equal length but for short dimensions, and at least as long as the rim is wide."""
    sides, left = [0] * len(target), list(range(len(target)))
    while left:
        room = max(1, pixels // int(np.prod([s for s in sides if s])))
        even = max(1, round(room ** (1 / len(left))))
        short = [d for d in left if len(target[d]) <= even]
        for d in short or left:
            sides[d] = max(1, min(len(target[d]), max(even, sum(need[d]))))
        left = [d for d in left if d not in short] if short else []
    return sides


def map_tiles(
    raster: Raster,
    function: Callable[[list[np.ndarray], Spot], Sequence[np.ndarray]],
    need: Extent,
    target: Sequence[Axis],
    *,
    values: Sequence[str] | None = None,
    made: Sequence[str] | None = None,
    whole: bool = False,
    clipped: bool = False,
    pixels: int | None = None,
) -> Raster:
    """``function`` on every tile of the axes ``target``: it gets one array for each of ``values`` (the tile and ``need`` pixels
    around it) and gives the tile's results, one array for each of ``made``. ``raster`` has all pixels that are needed, or,
    ``clipped``, only those inside it, and then blocks end where it does. ``whole``: integers instead of floating-point numbers."""
    values, keys, names = list(values or [raster.value]), list(raster.keys), list(raster.names)
    made = list(made or [raster.value])
    axes = list(target)
    sides = tile_sides(axes, need, pixels or TILE_PIXELS)
    many = [max(1, -(-len(a) // s)) for a, s in zip(axes, sides)]
    widths = [s + low + high for s, (low, high) in zip(sides, need)]
    kind = "long" if whole else "double"
    df = raster.df.select(*keys, *names, *[F.col(v).cast(kind).alias(v) for v in values])
    tile, place = F.lit(0).cast("long"), F.lit(0).cast("long")
    for d, (a, s, n, w, (low, high)) in enumerate(zip(axes, sides, many, widths, need)):
        p, t = F.col(a.name) - a.first, f"__t{d}"
        if n == 1:
            df = df.withColumn(t, F.lit(0).cast("long"))
        else:
            first, last = F.greatest(F.floor((p - high) / s), F.lit(0)), F.least(F.floor((p + low) / s), F.lit(n - 1))
            df = df.withColumn(t, F.explode(F.sequence(first, last)))
        tile, place = tile * n + F.col(t), place * w + (p - F.col(t) * s + low)
    dealt = df.select(*keys, tile.alias("__tile"), place.alias("__place"), *values)
    lengths, firsts = [len(a) for a in axes], [a.first for a in axes]

    def run(table: pa.Table) -> pa.Table:
        at = np.unravel_index(table.column("__tile")[0].as_py(), many)
        cores = [min(s, n - t * s) for s, n, t in zip(sides, lengths, at)]
        starts = [max(0, low - int(t) * s) if clipped else 0 for s, t, (low, _) in zip(sides, at, need)]
        stops = [min(low + c + high, n - int(t) * s + low) if clipped else low + c + high for s, t, n, c, (low, high) in zip(sides, at, lengths, cores, need)]
        window = tuple(slice(a, b) for a, b in zip(starts, stops))
        spots = table.column("__place").to_numpy()
        seen = np.zeros(int(np.prod(widths)), bool)
        seen[spots] = True
        if len(spots) != int(np.prod([b - a for a, b in zip(starts, stops)])) or int(seen.sum()) != len(spots):
            raise ValueError(f"the raster doesn't have one row for each pixel around {[f + int(t) * s for f, t, s in zip(firsts, at, sides)]}")
        blocks = []
        for v in values:
            block = np.zeros(len(seen), np.int64 if whole else float)
            block[spots] = table.column(v).to_numpy()
            blocks.append(block.reshape(widths)[window])
        core = tuple(slice(low - a, low - a + c) for a, c, (low, _) in zip(starts, cores, need))
        ends = tuple((t == 0, t == n - 1) for t, n in zip(at, many))
        results = function(blocks, Spot(core, ends))
        n = int(np.prod(cores))
        grid = np.indices(cores).reshape(len(cores), -1)
        columns = [pa.repeat(table.column(k)[0], n) for k in keys]
        columns += [pa.array((g + f + int(t) * s).astype(np.int32)) for g, f, t, s in zip(grid, firsts, at, sides)]
        columns += [pa.array(np.asarray(r).reshape(-1).astype(np.int64 if whole else float)) for r in results]
        return pa.table(columns, names=[*keys, *names, *made])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in raster.df.select(*keys).schema] + [f"`{n}` int" for n in names] + [f"`{m}` {kind}" for m in made]
    out = dealt.groupBy(*keys, "__tile").applyInArrow(run, ", ".join(types))
    return Raster(out, raster.keys, tuple(axes), made[0])


def box_sums(values: np.ndarray, sizes: Sequence[int]) -> np.ndarray:
    """Sums of all windows of the given sizes: differences of running sums, whatever the sizes. Integers are exact."""
    for d, s in enumerate(sizes):
        if s > 1:
            total, last = np.cumsum(values, d), values.shape[d] - s + 1
            cut = lambda x, low, high, d=d: x[tuple(slice(low, high) if k == d else slice(None) for k in range(x.ndim))]
            values = cut(total, s - 1, None).copy()
            cut(values, 1, None)[...] -= cut(total, 0, last - 1)
    return values


def select_ranks(block: np.ndarray, sizes: Sequence[int], wanted: Sequence[np.ndarray | int]) -> list[np.ndarray]:
    """For every window of the given sizes: its values of the ranks ``wanted`` (0: the least), in time that doesn't grow with the window.

    Values are numbered by rank over the block and dealt in bins of equal size. Box sums tell the bin that a wanted value lies in,
    some bins at a time: their counts share the bits of one integer. Then only that bin's pixels are compared with the windows that
    ask for it. NaN is larger than all numbers.
    """
    shape = tuple(n - s + 1 for n, s in zip(block.shape, sizes))
    order = np.argsort(block, axis=None, kind="stable")
    n = block.size
    bins = max(1, int(np.sqrt(n)))
    bits = int(np.prod(sizes)).bit_length()
    lot = max(1, 62 // bits)
    edges = np.linspace(0, n, bins + 1).astype(int)
    which = np.empty(n, np.int32)
    which[order] = np.repeat(np.arange(bins), np.diff(edges))
    which = which.reshape(block.shape)
    ranks = [np.broadcast_to(np.asarray(w), shape) for w in wanted]
    found = [np.full(shape, -1, np.int32) for _ in ranks]
    below = [np.zeros(shape, np.int32) for _ in ranks]
    total = np.zeros(shape, np.int32)
    for first in range(0, bins, lot):
        share = which - first
        packed = np.where((share >= 0) & (share < lot), np.int64(1) << (np.clip(share, 0, lot - 1) * bits).astype(np.int64), 0)
        counts = box_sums(packed, sizes)
        for b in range(first, min(bins, first + lot)):
            more = total + (counts >> (b - first) * bits & (1 << bits) - 1).astype(np.int32)
            for r, f, x in zip(ranks, found, below):
                here = (f < 0) & (more > r)
                f[here] = b
                x[here] = total[here]
            total = more
    flat, out = block.reshape(-1), []
    for r, f, x in zip(ranks, found, below):
        result = np.empty(shape)
        asking = np.argsort(f, axis=None, kind="stable")
        parts = np.searchsorted(f.reshape(-1)[asking], np.arange(bins + 1))
        for b in range(bins):
            askers = asking[parts[b] : parts[b + 1]]
            if not len(askers):
                continue
            members = order[edges[b] : edges[b + 1]]  # in order of value
            spots = np.unravel_index(members, block.shape)
            for low in range(0, len(askers), 4096):
                some = askers[low : low + 4096]
                inside = np.ones((len(some), len(members)), bool)
                for c, p, s in zip(np.unravel_index(some, shape), spots, sizes):
                    away = p[None, :] - c[:, None]
                    inside &= (away >= 0) & (away < s)
                nth = (r.reshape(-1)[some] - x.reshape(-1)[some] + 1)[:, None]
                result.reshape(-1)[some] = flat[members[np.argmax(np.cumsum(inside, 1, dtype=np.int32) >= nth, 1)]]
        out.append(result)
    return out


def running(block: np.ndarray, sizes: Sequence[int], f: np.ufunc) -> np.ndarray:
    """Minimum or maximum of every window, by doubling along one dimension after the other. NaN goes through."""
    for d, s in enumerate(sizes):
        have = 1
        cut = lambda x, a, n, d=d: x[tuple(slice(a, a + n) if k == d else slice(None) for k in range(x.ndim))]
        while have < s:
            step = min(have, s - have)
            n = block.shape[d] - step
            block = f(cut(block, 0, n), cut(block, step, n))
            have += step
    return block
