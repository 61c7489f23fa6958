"""Recursive filters: an ordered fold over each line, lines in parallel, and long lines in blocks.

A block's answer is its answer at rest plus a linear one to the three values that enter it. So every block is
filtered at rest first, both ways; a scan over one row for each block tells what enters each; then the blocks are filtered
again with that. The scan's work is a fraction 1/LINE_BLOCK of the line's, all else is dealt over tasks.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from rastrum.functions.borders import Border, Fill, Pad
from rastrum.functions.kernels import Recursive
from rastrum.raster import Raster


def fold_lines(x: np.ndarray, k: Recursive, outside: float | None) -> np.ndarray:
    """Lines in the columns of ``x``. ``outside``: the constant beyond both ends, None for the end pixels."""
    n = len(x)
    if n <= 3:
        raise ValueError(f"a recursive filter needs lines longer than 3, got {n}")
    a, b = k.forward, k.backward
    before = x[0] if outside is None else np.full(x.shape[1:], outside)
    after = x[-1] if outside is None else np.full(x.shape[1:], outside)
    start = before / (1 - sum(a))
    u = np.empty((n + 3, *x.shape[1:]))
    u[:3] = start
    for i in range(n):
        u[i + 3] = x[i] + a[0] * u[i + 2] + a[1] * u[i + 1] + a[2] * u[i]
    u = u[3:]
    u_end = after / (1 - sum(a))
    v_end = u_end / (1 - sum(b))
    tail = np.tensordot(k.edge, np.stack([u[-1] - u_end, u[-2] - u_end, u[-3] - u_end]), 1) + v_end
    v = np.empty((n + 2, *x.shape[1:]))
    v[n - 1 :] = tail
    for i in range(n - 2, -1, -1):
        v[i] = u[i] + b[0] * v[i + 1] + b[1] * v[i + 2] + b[2] * v[i + 3]
    return v[:n] * k.scale


#: Lines of more samples than this are filtered in blocks of it.
LINE_BLOCK = 1 << 16
Three = tuple[float, float, float]


def respond(x: np.ndarray, c: Three, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y[i] = x[i] + c1 y[i-1] + c2 y[i-2] + c3 y[i-3] after the last three values ``state`` (nearest first), and the state at the end.

    Stretches of about the root of the length run side by side at rest; what enters each is added afterwards.
    """
    n = len(x)
    step = max(3, int(n**0.5))
    many = n // step
    y = np.empty(n)
    state = np.asarray(state, float)
    if many > 1:
        rest = x[: many * step].reshape(many, step)
        wide = np.zeros((many + 3, step + 3))  # three more rows: answers to each unit state
        wide[many:, :3] = np.eye(3)[:, ::-1]
        wide[:many, 3:] = rest
        for j in range(3, step + 3):
            wide[:, j] += c[0] * wide[:, j - 1] + c[1] * wide[:, j - 2] + c[2] * wide[:, j - 3]
        part, units = wide[:many, 3:], wide[many:, 3:]
        for k in range(many):
            part[k] += state @ units
            state = part[k, :-4:-1].copy()
        y[: many * step] = part.reshape(-1)
    else:
        many = 0
    for i in range(many * step, n):
        y[i] = x[i] + c[0] * state[0] + c[1] * state[1] + c[2] * state[2]
        state = np.array([y[i], state[0], state[1]])
    return y, state


@lru_cache(maxsize=32)
def passages(n: int, back: int, forward: Three, backward: Three) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For a block of n samples, of which ``back`` are folded backward: what a state becomes on its way forward, what one becomes backward,
    and what the backward end owes to the state that entered forward."""
    power = lambda c, m: np.linalg.matrix_power(np.array([c, (1, 0, 0), (0, 1, 0)], float), m)
    owed = np.empty((3, 3))
    for k in range(3):
        u, _ = respond(np.zeros(n), forward, np.eye(3)[k])
        owed[:, k] = respond(u[:back][::-1], backward, np.zeros(3))[1]
    return power(forward, n), power(backward, back), owed


def _in_blocks(raster: Raster, k: Recursive, dim: int, outside: float | None) -> Raster:
    name, axis = raster.names[dim], raster.axes[dim]
    line = [*raster.group, *[n for n in raster.names if n != name]]
    dealt = raster.df.select(*line, F.floor((F.col(name) - axis.first) / LINE_BLOCK).alias("__b"), F.col(name).alias("__at"), F.col(raster.value).cast("double").alias("__v"), axis.last_column().alias("__end"))
    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.select(*line).schema]
    keys, block, low, value = [*line, "__b"], LINE_BLOCK, axis.first, raster.value

    def samples(table: pa.Table) -> tuple[pa.Table, np.ndarray, bool]:
        """The rows in order, their values, and whether the block ends its line."""
        table = table.sort_by("__at")
        at, end = table.column("__at").to_numpy(), table.column("__end")[0].as_py()
        first = low + table.column("__b")[0].as_py() * block
        last = min(end, first + block - 1)
        if len(at) != last - first + 1 or at[0] != first or at[-1] != last:
            raise ValueError("the raster doesn't have one row for each of its pixels")
        return table, table.column("__v").to_numpy(zero_copy_only=False), last == end

    def at_rest(table: pa.Table) -> pa.Table:
        table, x, ends = samples(table)
        u, forward = respond(x, k.forward, np.zeros(3))
        _, backward = respond(u[: len(u) - ends][::-1], k.backward, np.zeros(3))
        row = {"__n": len(x), "__ends": ends, "__head": x[0], "__tail": x[-1], "__f": [forward.tolist()], "__w": [backward.tolist()]}
        made = {c: table.column(c).slice(0, 1) for c in keys} | {c: pa.array(v if isinstance(v, list) else [v]) for c, v in row.items()}
        return pa.table(made)

    blocks = dealt.groupBy(*keys).applyInArrow(at_rest, ", ".join([*types, "__b long, __n long, __ends boolean, __head double, __tail double, __f array<double>, __w array<double>"]))

    def scan(table: pa.Table) -> pa.Table:
        table = table.sort_by("__b")
        n, ends = table.column("__n").to_pylist(), table.column("__ends").to_pylist()
        at_rest_f, at_rest_w = (np.array(table.column(c).to_pylist()) for c in ("__f", "__w"))
        before = table.column("__head")[0].as_py() if outside is None else outside
        after = table.column("__tail")[len(n) - 1].as_py() if outside is None else outside
        state, entering = np.full(3, before / (1 - sum(k.forward))), []
        moves = [passages(m, m - e, k.forward, k.backward) for m, e in zip(n, ends)]
        for f, (ahead, _, _) in zip(at_rest_f, moves):
            entering.append(state)
            state = f + ahead @ state
        u_end = after / (1 - sum(k.forward))
        back, leaving = k.edge @ (state - u_end) + u_end / (1 - sum(k.backward)), []
        for w, s, (_, behind, owed) in reversed(list(zip(at_rest_w, entering, moves))):
            leaving.append(back)
            back = w + behind @ back + owed @ s
        made = {c: table.column(c) for c in keys} | {"__s": pa.array([s.tolist() for s in entering]), "__t": pa.array([t.tolist() for t in reversed(leaving)])}
        return pa.table(made)

    carries = blocks.withColumn("__line", F.lit(0)).groupBy("__line", *line).applyInArrow(scan, ", ".join([*types, "__b long, __s array<double>, __t array<double>"]))

    def with_carries(table: pa.Table, carry: pa.Table) -> pa.Table:
        table, x, ends = samples(table)
        state, back = (np.array(carry.column(c)[0].as_py()) for c in ("__s", "__t"))
        u, _ = respond(x, k.forward, state)
        v, _ = respond(u[: len(u) - ends][::-1], k.backward, back)
        v = np.concatenate([v[::-1], back[:1]]) if ends else v[::-1]
        return pa.table({c: table.column(c) for c in line} | {name: table.column("__at"), value: pa.array(v * k.scale)})

    at_type = raster.df.schema[name].dataType.simpleString()
    out = dealt.groupBy(*keys).cogroup(carries.groupBy(*keys)).applyInArrow(with_carries, ", ".join([*types, f"`{name}` {at_type}, `{raster.value}` double"]))
    return raster.with_df(out)


def filter_recursive(raster: Raster, kernel: Recursive, dim: int, by: Border) -> Raster:
    """One recursive stage along ``dim``. Any Pad style acts as replicate, as the recursion has no other. Lines of more than
    LINE_BLOCK samples, or of unknown lengths, go in blocks."""
    if not isinstance(by, (Pad, Fill)):
        raise ValueError(f"no recursive filter with {by!r}")
    outside = float(by.value) if isinstance(by, Fill) else None
    if raster.axes[dim].ragged or len(raster.axes[dim]) > LINE_BLOCK:
        return _in_blocks(raster, kernel, dim, outside)
    name = raster.names[dim]
    others = [n for n in raster.names if n != name]
    lines = raster.df.groupBy(*raster.group, *others).agg(F.array_sort(F.collect_list(F.struct(F.col(name).alias("i"), F.col(raster.value).cast("double").alias("v")))).alias("line"))
    lines = lines.select(*raster.group, *others, F.col("line.i").alias("__at"), F.col("line.v").alias("__v"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(batch.num_columns - 1)
            sizes = column.value_lengths().to_numpy(zero_copy_only=False)
            flat = column.flatten().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(len(flat))
            for n in np.unique(sizes):  # lines of one length are folded together
                places = starts[:-1][sizes == n][:, None] + np.arange(n)
                out[places] = fold_lines(flat[places].T, kernel, outside).T
            data = pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(out))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], data.cast(batch.schema.field(batch.num_columns - 1).type)], schema=batch.schema)

    made = lines.mapInArrow(run, lines.schema)
    made = made.select(*raster.group, *others, F.explode(F.arrays_zip("__at", "__v")).alias("__p"))
    return raster.with_df(made.select(*raster.group, *others, F.col("__p.__at").alias(name), F.col("__p.__v").alias(raster.value)))
