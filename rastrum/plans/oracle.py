"""SQL for the queries: each stencil as a gathering join, unlike the engine's scattered sums and windows.

Kernel weights of the catalogue are SQL formulas or literals here, and recursive filters are recursions.
"""

from __future__ import annotations

import numpy as np

from rastrum.functions.kernels import Kernel

IMG8 = "select vec_id, cast((k-1)//8 as int) as i, cast((k-1)%8 as int) as j, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k)"
IMG8Q = f"select vec_id, i, j, cast(round(v * 1000) as bigint) as v from ({IMG8})"
VOL4 = "select vec_id, cast((k-1)//16 as int) as i, cast(((k-1)//4)%4 as int) as j, cast((k-1)%4 as int) as k2, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k)"
SIGNALS = "select user_id, cast(row_number() over (partition by user_id order by ts, event_id) - 1 as int) as i, value as v, cast(count(*) over (partition by user_id) as int) as n from events"
HOURS = (
    "select g.event_type, cast(g.i as int) as i, cast(g.j as int) as j, coalesce(c.v, 0) as v from "
    "(select event_type, i, j from (select distinct event_type from events), range(1, 32) a(i), range(0, 24) b(j)) g left join "
    "(select event_type, day(ts) as i, hour(ts) as j, count(*) as v from events group by all) c on g.event_type = c.event_type and g.i = c.i and g.j = c.j"
)
_LINES = "(select (year(l_shipdate) - 1995) * 12 + month(l_shipdate) - 1 as i, cast(l_quantity as int) as j, count(*) as v from lineitem where l_shipdate is not null and l_quantity is not null group by all)"
SHIPMENTS = (
    f"select cast(a.i as int) as i, cast(b.j as int) as j, coalesce(c.v, 0) as v, e.fi, e.fj, e.ni, e.nj from "
    f"(select min(i) as fi, max(i) - min(i) + 1 as ni, min(j) as fj, max(j) - min(j) + 1 as nj from {_LINES}) e, unnest(range(e.fi, e.fi + e.ni)) a(i), unnest(range(e.fj, e.fj + e.nj)) b(j) "
    f"left join {_LINES} c on a.i = c.i and b.j = c.j"
)


def index(style: str, at: str, n: int | str, first: int | str = 0) -> str:
    p = f"({at} - {first})"
    mod = lambda m: f"((({p} % ({m})) + ({m})) % ({m}))"
    if style == "replicate":
        inside = f"greatest(0, least(({n}) - 1, {p}))"
    elif style == "circular":
        inside = mod(n)
    elif style == "symmetric":
        m = mod(f"2*({n})")
        inside = f"case when {m} < ({n}) then {m} else 2*({n}) - 1 - {m} end"
    elif style == "reflect":
        m = mod(f"2*({n}) - 2")
        inside = f"case when {m} < ({n}) then {m} else 2*({n}) - 2 - {m} end"
    else:  # no map: only pixels inside match
        return at
    return f"({inside} + {first})"


def normal(sigma: float, half: int) -> str:
    """One-dimensional Gaussian weights (d, w) that sum to one."""
    bell = f"exp(-d * d / (2.0 * {sigma!r} * {sigma!r}))"
    return f"(select d, {bell} / sum({bell}) over () as w from range({-half}, {half + 1}) t(d))"


def product_kernel(*lines: str) -> str:
    """The weights of one line (d, w) for each dimension, multiplied."""
    columns = ", ".join(f"cast(k{d}.d as int) as d{d}" for d in range(len(lines)))
    weights = " * ".join(f"k{d}.w" for d in range(len(lines)))
    return f"(select {columns}, {weights} as w from {', '.join(f'{line} k{d}' for d, line in enumerate(lines))})"


def line_weights(first: int, weights: str) -> str:
    """Literal weights, the first one at displacement ``first``."""
    return f"(values {', '.join(f'({first + k}, cast({w} as double))' for k, w in enumerate(weights.split()))}) t(d, w)"


def line_kernel(first: int, weights: str) -> str:
    return f"(select d, w from {line_weights(first, weights)})"


def grid_kernel(half: int, formula: str) -> str:
    """Weights from a formula of the displacements y and x."""
    return f"(select cast(y as int) as d0, cast(x as int) as d1, {formula} as w from range({-half}, {half + 1}) a(y), range({-half}, {half + 1}) b(x))"


def box_line(size: int) -> str:
    return f"(select d, 1.0 / {size} as w from range({-(size // 2)}, {size // 2 + 1}) t(d))"


def literal_kernel(rows: str, first: tuple[int, int] = (-1, -1)) -> str:
    """Weights row by row, rows parted by ";"."""
    cells = [(first[0] + r, first[1] + c, w) for r, row in enumerate(rows.split(";")) for c, w in enumerate(row.split())]
    return f"(select d0, d1, w from (values {', '.join(f'({y}, {x}, cast({w} as double))' for y, x, w in cells)}) t(d0, d1, w))"


def recursion(px: str, keys: tuple[str, ...], axis: str, sigma: float, tag: str, outside: str | None = None, tail: int = 160) -> str:
    """CTEs that end in ``{tag}``: the rows of ``px`` after a third-order recursive Gaussian along ``axis``.

    The line goes on with ``outside`` (null: its end pixels) for ``tail`` places, from whose end the backward recursion starts at rest.
    """
    s = f"cast({sigma!r} as double)"
    on = " and ".join(f"b.{k} = a.{k}" for k in keys)
    cols = ", ".join(keys)
    a_cols = ", ".join(f"a.{k}" for k in keys)
    first = outside or f"arg_min(v, {axis})"
    last = outside or f"arg_max(v, {axis})"
    return (
        f"{tag}q as (select 1.31564 * (sqrt(1 + 0.490811 * {s} * {s}) - 1) as q), "
        f"{tag}p as (select q, (1.1668 + q) * (1.10783 * 1.10783 + 1.40586 * 1.40586 + 2 * 1.10783 * q + q * q) as z from {tag}q), "
        f"{tag}c as (select q * (2 * 1.1668 * 1.10783 + 1.10783 * 1.10783 + 1.40586 * 1.40586 + (2 * 1.1668 + 4 * 1.10783) * q + 3 * q * q) / z as c1, "
        f"-(q * q) * (1.1668 + 2 * 1.10783 + 3 * q) / z as c2, q * q * q / z as c3, power(1.1668 * (1.10783 * 1.10783 + 1.40586 * 1.40586) / z, 2) as scale from {tag}p), "
        f"{tag}e as (select {cols}, min({axis}) as lo, max({axis}) as hi, cast({first} as double) as vlo, cast({last} as double) as vhi from {px} group by all), "
        f"{tag}f as (select a.*, c.*, a.lo - 1 as pos, a.vlo / (1 - c1 - c2 - c3) as u1, a.vlo / (1 - c1 - c2 - c3) as u2, a.vlo / (1 - c1 - c2 - c3) as u3 from {tag}e a, {tag}c c "
        f"union all select {a_cols}, a.lo, a.hi, a.vlo, a.vhi, c1, c2, c3, scale, a.pos + 1, coalesce(b.v, a.vhi) + c1 * a.u1 + c2 * a.u2 + c3 * a.u3, a.u1, a.u2 "
        f"from {tag}f a left join {px} b on {on} and b.{axis} = a.pos + 1 where a.pos < a.hi + {tail}), "
        f"{tag}b as (select {cols}, lo, hi, c1, c2, c3, scale, pos, u1 / (1 - c1 - c2 - c3) as w1, u1 / (1 - c1 - c2 - c3) as w2, u1 / (1 - c1 - c2 - c3) as w3 from {tag}f where pos = hi + {tail} "
        f"union all select {a_cols}, a.lo, a.hi, a.c1, a.c2, a.c3, a.scale, a.pos - 1, b.u1 + a.c1 * a.w1 + a.c2 * a.w2 + a.c3 * a.w3, a.w1, a.w2 "
        f"from {tag}b a join {tag}f b on {on} and b.pos = a.pos - 1 where a.pos > a.lo), "
        f"{tag} as (select {cols}, cast(pos as int) as {axis}, w1 * scale as v from {tag}b where pos between lo and hi)"
    )


def values(kernel: Kernel | str) -> str:
    if isinstance(kernel, str):
        return kernel
    rows = ", ".join("(" + ", ".join(map(str, at)) + f", cast({w!r} as {'bigint' if isinstance(w, int) else 'double'}))" for at, w in kernel.taps())
    return f"(values {rows})"


def dims(shape: tuple[int, ...], firsts: tuple[int, ...] | None = None, names: tuple[str, ...] | None = None) -> list[tuple[str, int, int]]:
    names = names or ("i", "j", "k2")[: len(shape)]
    return list(zip(names, shape, firsts or (0,) * len(shape)))


def join_on(style: str, axes: list[tuple[str, int, int]], keys: tuple[str, ...]) -> str:
    parts = [f"b.{k} = a.{k}" for k in keys]
    parts += [f"b.{name} = {index(style, f'(a.{name} + kr.d{d})', n, first)}" for d, (name, n, first) in enumerate(axes)]
    return " and ".join(parts)


def with_px(px: str, kernel: Kernel | str, ndim: int = 2) -> str:
    columns = ", ".join([*[f"d{d}" for d in range(ndim if isinstance(kernel, str) else kernel.ndim)], "w"])
    return f"with px as ({px}), kr({columns}) as {values(kernel)}"


def selected(axes: list, keys: tuple[str, ...]) -> str:
    return ", ".join([*[f"a.{k}" for k in keys], *[f"a.{n}" for n, _, _ in axes]])


def fir(px: str, kernel: Kernel | str, style: str, axes: list, keys: tuple[str, ...], where: str = "", out: str = "round(sum(b.v * kr.w), 6) + 0.0") -> str:
    return f"{with_px(px, kernel, len(axes))} select {selected(axes, keys)}, {out} as o from px a cross join kr join px b on {join_on(style, axes, keys)} {where} group by all"


def fir_fill(px: str, kernel: Kernel | str, value: float, axes: list, keys: tuple[str, ...]) -> str:
    return f"{with_px(px, kernel, len(axes))} select {selected(axes, keys)}, round(sum(coalesce(b.v, {value}) * kr.w), 6) + 0.0 as o from px a cross join kr left join px b on {join_on('', axes, keys)} group by all"


def window_kernel(spans: list[tuple[int, int]]) -> Kernel:
    sizes = [b - a + 1 for a, b in spans]
    return Kernel(np.ones(sizes, np.int64), tuple(-a for a, _ in spans))
