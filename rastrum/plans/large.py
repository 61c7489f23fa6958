"""Queries over images and signals without a key, which go in tiles and blocks, and over windows of any width."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.functions import kernels as K
from rastrum.functions.borders import NA, Fill, Inner, Pad
from rastrum.operators.denoise import denoise_tv
from rastrum.operators.features import blob_log, find_local_maxima, gradients
from rastrum.operators.filtering import filter_raster
from rastrum.operators.padding import pad_raster
from rastrum.operators.windows import map_window, sparse_window
from rastrum.plans import oracle as O
from rastrum.plans.catalogue import BINOMIAL, D8, DENSE, DH, DS, GAUSS1, HALVES, KEY, ORACLES, QUERIES, add, add_fir, gabor_pair, gabor_sql, rounded
from rastrum.raster import Axis, Raster
from rastrum.sources import tables as S

__all__ = ["ORACLES", "QUERIES"]


def days(spark: SparkSession, d: str) -> Raster:
    """Whole prices of the line items by ship day (0: 1 January 1992) and quantity, in thousands and 0 where there are none: one
    image without a key of floating-point numbers, each a quotient of integers, so that the order of a sum decides nothing."""
    day = F.datediff("l_shipdate", F.lit("1992-01-01"))
    lines = S.table(spark, d, "lineitem").select(day.cast("int").alias("i"), F.col("l_quantity").cast("int").alias("j"), F.col("l_extendedprice").cast("double").alias("p"))
    return Raster.from_counts(lines.where(F.col("i").between(0, 2699) & F.col("j").between(1, 50)), (), (Axis("i", 0, 2699), Axis("j", 1, 50)), F.sum(F.floor("p")) / 1000)


_DAY = "date_diff('day', date '1992-01-01', l_shipdate)"
DAYS = (
    "select cast(a.i as int) as i, cast(b.j as int) as j, coalesce(c.v, 0.0::double) as v from range(0, 2700) a(i) cross join range(1, 51) b(j) left join "
    f"(select {_DAY} as i, cast(l_quantity as int) as j, cast(sum(floor(cast(l_extendedprice as double))) as double) / 1000 as v from lineitem where {_DAY} between 0 and 2699 group by all) c on a.i = c.i and b.j = c.j"
)
DD = [("i", 2700, 0), ("j", 50, 1)]


WIDE = K.centered((np.arange(49) * 5 % 17 - 8).reshape(7, 7) / 10)  # 46 weights and of full rank
WIDE_SQL = O.grid_kernel(3, "(((y + 3) * 7 + x + 3) * 5 % 17 - 8) / 10.0")

# Tiles with rims
add_fir("tile_dense", days, WIDE, "reflect", DAYS, WIDE_SQL, "reflect", DD, ())
add_fir("tile_fourier", days, K.gaussian((2, 1)), "circular", DAYS, O.product_kernel(O.normal(2.0, 4), O.normal(1.0, 2)), "circular", DD, (), algorithm="fft")
add_fir("tile_roi", days, WIDE, "symmetric", DAYS, WIDE_SQL, "symmetric", DD, (), "where a.i between 200 and 900 and a.j between 10 and 20", roi={"i": (200, 900), "j": (10, 20)})
add_fir("tile_inner", days, WIDE, Inner(), DAYS, WIDE_SQL, "", DD, (), "where a.i between 3 and 2696 and a.j between 4 and 47")
add("tile_fill", lambda spark, d: rounded(filter_raster(days(spark, d), WIDE, Fill(1.5))), O.fir_fill(DAYS, WIDE_SQL, 1.5, DD, ()))
BELL = O.product_kernel(O.normal(1.5, 4), O.normal(1.5, 4))
add("tile_na", lambda spark, d: rounded(filter_raster(sold(spark, d), K.gaussian((1.5, 1.5)), NA())),
    f"{O.with_px(f'select i, j, case when v > 0 then v end as v from ({DAYS})', BELL)} select a.i, a.j, round(coalesce(sum(b.v * kr.w) / nullif(sum(case when b.v is not null then kr.w end), 0), cast('nan' as double)), 6) + 0.0 as o "
    f"from px a cross join kr join px b on {O.join_on('', DD, ())} group by all")  # fmt: skip
SPAN55, SPAN1311 = O.window_kernel([(-2, 2), (-2, 2)]), O.window_kernel([(-6, 6), (-5, 5)])
add("tile_median", lambda spark, d: rounded(map_window(days(spark, d), "median", (5, 5), "symmetric")), O.fir(DAYS, SPAN55, "symmetric", DD, (), out="round(median(b.v), 6) + 0.0"))
for name, sql in (("median", "median(b.v)"), ("quantile", "quantile_cont(b.v, 0.7)"), ("lower_median", "list_sort(list(b.v))[72]")):
    add(f"tile_{name}_wide", lambda spark, d, name=name: rounded(map_window(days(spark, d), name, (13, 11), "replicate", q=0.7, indices={"i": range(3, 2700, 30)})),
        f"select cast((i - 3) // 30 as int) as i, j, o from ({O.fir(DAYS, SPAN1311, 'replicate', DD, (), 'where a.i % 30 = 3', f'round({sql}, 6) + 0.0')})")
add("tile_python", lambda spark, d: rounded(map_window(days(spark, d), lambda w: float(np.ptp(w)), (3, 3), "circular", python=True, indices={"i": range(0, 2700, 10)})),
    f"select cast(i // 10 as int) as i, j, o from ({O.fir(DAYS, O.window_kernel([(-1, 1), (-1, 1)]), 'circular', DD, (), 'where a.i % 10 = 0', 'round(max(b.v) - min(b.v), 6) + 0.0')})")


def sold(spark: SparkSession, d: str) -> Raster:
    r = days(spark, d)
    return r.with_df(r.df.withColumn("v", F.when(F.col("v") > 0, F.col("v"))))


# Windows of any width in a few stages
for name, sql, low, high in (("max", "max(b.v)", -30, 30), ("min", "min(b.v)", -40, 23), ("sum", "sum(b.v)", -20, 20), ("mean", "avg(b.v)", -9, 40)):
    add(f"wide_{name}", lambda spark, d, name=name, span=(low, high): rounded(map_window(days(spark, d), name, [span, (0, 0)], "reflect"), 5),
        O.fir(DAYS, O.window_kernel([(low, high), (0, 0)]), "reflect", DD, (), out=f"round({sql}, 5) + 0.0"))
add_fir("wide_box", S.shipments, K.box(1, 21), "replicate", O.SHIPMENTS, O.product_kernel(O.box_line(1), O.box_line(21)), "replicate", DS, ())
ONES = K.OneD(np.ones(19, np.int64), 9, 0, 2)
add("wide_box_int", lambda spark, d: rounded(filter_raster(S.shipments(spark, d), (ONES,), "circular"), None), O.fir(O.SHIPMENTS, O.window_kernel([(-9, 9), (0, 0)]), "circular", DS, (), out="cast(sum(b.v) as bigint)"))


# Long lines of recursive filters: what the recursion does to a line that goes on for ever, as a convolution
def ticks(spark: SparkSession, d: str) -> Raster:
    """Events by half minute of the month: one signal without a key, of more samples than a block has."""
    at = ((F.dayofmonth("ts") - 1) * 1440 + F.hour("ts") * 60 + F.minute("ts")) * 2 + F.floor(F.second("ts") / 30)
    return Raster.from_counts(S.table(spark, d, "events").select(at.cast("int").alias("i")), (), (Axis("i", 0, 89279),), F.count("*").cast("double"))


TICKS = (
    "select cast(t.i as int) as i, coalesce(c.v, 0.0) as v from range(0, 89280) t(i) left join "
    "(select ((day(ts) - 1) * 1440 + hour(ts) * 60 + minute(ts)) * 2 + second(ts) // 30 as i, cast(count(*) as double) as v from events group by all) c on c.i = t.i"
)


def recursion_sql(px: str, sigma: float, taps: int, index: str, select: str, on: str = "true") -> str:
    s = f"cast({sigma!r} as double)"
    return (
        f"with recursive px as ({px}), kq as (select 1.31564 * (sqrt(1 + 0.490811 * {s} * {s}) - 1) as q), "
        "kz as (select q, (1.1668 + q) * (1.10783 * 1.10783 + 1.40586 * 1.40586 + 2 * 1.10783 * q + q * q) as z from kq), "
        "kc as (select q * (2 * 1.1668 * 1.10783 + 1.10783 * 1.10783 + 1.40586 * 1.40586 + (2 * 1.1668 + 4 * 1.10783) * q + 3 * q * q) / z as c1, "
        "-(q * q) * (1.1668 + 2 * 1.10783 + 3 * q) / z as c2, q * q * q / z as c3, power(1.1668 * (1.10783 * 1.10783 + 1.40586 * 1.40586) / z, 2) as scale from kz), "
        f"resp as (select 0 as n, cast(1 as double) as f, cast(0 as double) as g, cast(0 as double) as h from kc union all select n + 1, c1 * f + c2 * g + c3 * h, f, g from resp, kc where n < {2 * taps}), "
        f"kr as (select k.k, sum(a.f * b.f) * any_value(kc.scale) as w from range(-{taps}, {taps + 1}) k(k), resp a join resp b on b.n = a.n + abs(k.k), kc group by k.k) "
        f"select {select}, round(sum(b.v * kr.w), 6) + 0.0 as o from px a cross join kr join px b on {on} and b.i = {index} group by all"
    )


add("iir_long_line", lambda spark, d: rounded(filter_raster(ticks(spark, d), (K.iir_gaussian(4.0),), "replicate")), recursion_sql(TICKS, 4.0, 120, "greatest(0, least(89279, a.i + kr.k))", "a.i"))
add("iir_signals", lambda spark, d: rounded(filter_raster(long_signals(S.signals(spark, d)), (K.iir_gaussian(2.0),), "replicate")),
    recursion_sql(f"select * from ({O.SIGNALS}) where n > 3", 2.0, 70, "greatest(0, least(a.n - 1, a.i + kr.k))", "a.user_id, a.i", "b.user_id = a.user_id"))
add("fir_long_line", lambda spark, d: rounded(filter_raster(ticks(spark, d), K.factored([0.25, 0.5, 0.25]), "circular")),
    f"with px as ({TICKS}), kr(d, w) as (values (-1, 0.25), (0, 0.5), (1, 0.25)) select a.i, round(sum(b.v * kr.w), 6) + 0.0 as o from px a cross join kr join px b on b.i = (a.i + kr.d + 89280) % 89280 group by all")
add("mapwin_long_line", lambda spark, d: rounded(map_window(ticks(spark, d), "max", (-3, 4), "replicate")),
    f"with px as ({TICKS}) select i, round(max(v) over (order by i rows between 3 preceding and 4 following), 6) + 0.0 as o from px")


# What isn't finite reaches as far as the kernel does, and no farther
add("fft_nonfinite", lambda spark, d: rounded(filter_raster(spoilt(ticks(spark, d)), K.centered(np.full(31, 1 / 31)), Inner(), algorithm="fft")),
    f"with px as ({TICKS}), w as (select i, sum(v) over l as s, max(case when i % 5000 = 77 then 1 else 0 end) over l as inf, max(case when i % 5000 = 90 then 1 else 0 end) over l as nan from px window l as (order by i rows between 15 preceding and 15 following)) "
    "select i, case when nan = 1 then cast('nan' as double) when inf = 1 then cast('inf' as double) else round(s / 31, 6) + 0.0 end as o from w where i between 15 and 89264")  # fmt: skip


def spoilt(r: Raster) -> Raster:
    bad = F.when(F.col("i") % 5000 == 77, float("inf")).when(F.col("i") % 5000 == 90, float("nan"))
    return r.with_df(r.df.withColumn("v", F.coalesce(bad, F.col("v"))))


def long_signals(r: Raster) -> Raster:
    return r.with_df(r.df.where("__last >= 3"))


# Total variation in tiles, and more rounds of it
def tv_sql(px: str, keys: tuple[str, ...], sizes: tuple[str, str], firsts: tuple[str, str], lam: float, rounds: int) -> str:
    lam = float(np.float32(lam))
    t = 0.25 / lam
    cols = "".join(f"a.{k}, " for k in keys)
    on = lambda x: "".join(f"{x}.{k} = a.{k} and " for k in keys)
    e = "(select * from ends)"
    ends = f"select {sizes[0]} as ni, {sizes[1]} as nj, {firsts[0]} as fi, {firsts[1]} as fj from px limit 1"
    next_ = lambda c: f"(a.{c} - e.f{c} + 1) % e.n{c} + e.f{c}"
    last = lambda c: f"(a.{c} - e.f{c} + e.n{c} - 1) % e.n{c} + e.f{c}"

    def slopes(source: str) -> str:
        return f"select {cols}a.i, a.j, x.v - a.v as s1, y.v - a.v as s2 from {source} a cross join {e} e join {source} x on {on('x')}x.i = {next_('i')} and x.j = a.j join {source} y on {on('y')}y.i = a.i and y.j = {next_('j')}"

    sql = [f"px as materialized ({px})", f"ends as materialized ({ends})", f"g as materialized (select {''.join(f'{k}, ' for k in keys)}i, j, cast(v as double) as v from px)", f"p0 as materialized ({slopes('g')})"]
    for r in range(rounds):
        sql.append(
            f"u{r} as materialized (select {cols}a.i, a.j, g.v - {lam!r}::double * (a.s1 - x.s1 + a.s2 - y.s2) as v from p{r} a cross join {e} e join g on {on('g')}g.i = a.i and g.j = a.j "
            f"join p{r} x on {on('x')}x.i = {last('i')} and x.j = a.j join p{r} y on {on('y')}y.i = a.i and y.j = {last('j')})"
        )
        sql.append(f"d{r} as materialized ({slopes(f'u{r}')})")
        size = f"(1 + {t!r}::double * sqrt(d.s1 * d.s1 + d.s2 * d.s2))"
        sql.append(f"p{r + 1} as materialized (select {cols}a.i, a.j, (a.s1 - {t!r}::double * d.s1) / {size} as s1, (a.s2 - {t!r}::double * d.s2) / {size} as s2 from p{r} a join d{r} d on {on('d')}d.i = a.i and d.j = a.j)")
    return f"with {', '.join(sql)} select {''.join(f'{k}, ' for k in keys)}i, j, round(v, 6) + 0.0 as o from u{rounds - 1}"


add("rof_tv_10", lambda spark, d: rounded(denoise_tv(S.img8(spark, d), 0.1, 10)), tv_sql(O.IMG8, KEY, ("8", "8"), ("0", "0"), 0.1, 10))
add("rof_tv_tiles", lambda spark, d: rounded(denoise_tv(S.shipments(spark, d), 2.0, 10)), tv_sql(O.SHIPMENTS, (), ("ni", "nj"), ("fi", "fj"), 2.0, 10))

# Features of an image without a key
CROSS = O.literal_kernel("0 1 0; 1 -4 1; 0 1 0")
add("laplacian_shipments", lambda spark, d: rounded(filter_raster(S.shipments(spark, d), K.Laplacian(), "symmetric"), None), O.fir(O.SHIPMENTS, CROSS, "symmetric", DS, (), out="cast(sum(b.v * kr.w) as bigint)"))
add("localmax_days", lambda spark, d: find_local_maxima(days(spark, d), (7, 3)).select("i", "j", F.col("v").alias("o")),
    f"with px as ({DAYS}), l as (select *, max(v) over (partition by j order by i rows between 3 preceding and 3 following exclude current row) as x, max(v) over (partition by j order by i rows between 3 preceding and 3 following) as m from px), "
    "k as (select *, max(m) over (partition by i order by j rows between 1 preceding and 1 following exclude current row) as y from l) select i, j, v as o from k where v > x and v > y")  # fmt: skip


def blobs(spark: SparkSession, d: str) -> DataFrame:
    found = blob_log(S.shipments(spark, d), (1.0, 2.0), threshold=0.02)
    return found.select("i", "j", (F.round(F.element_at("sigma", 1), 6) + F.lit(0.0)).alias("sigma"), (F.round("amplitude", 6) + F.lit(0.0)).alias("amplitude"))


def blobs_sql() -> str:
    slices = []
    for s, sigma, half in ((0, 1.0, 4), (1, 2.0, 8)):
        t = f"cast({sigma * sigma!r} as double)"
        k = O.grid_kernel(half, f"((y * y + x * x) / ({t} * {t}) - 2 / ({t})) * exp(-(y * y + x * x) / (2 * {t})) / (2 * pi() * {t})")
        slices.append(f"select i, j, {s} as s, cast({sigma!r} as double) as sigma, -{sigma!r}::double * o as v from ({O.fir(O.SHIPMENTS, k, 'reflect', DS, (), out='sum(b.v * kr.w)')})")
    return (
        f"with st as materialized ({' union all '.join(slices)}), top as (select max(v) as t, min(fi) as fi, max(fi + ni - 1) as li, min(fj) as fj, max(fj + nj - 1) as lj from ({O.SHIPMENTS})) "
        "select a.i, a.j, round(a.sigma, 6) + 0.0 as sigma, round(a.v, 6) + 0.0 as amplitude from st a, top where a.i > top.fi and a.i < top.li and a.j > top.fj and a.j < top.lj and a.v > 0.02 / (a.sigma * a.sigma) * top.t "
        "and not exists (select 1 from st b where abs(b.s - a.s) <= 1 and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and (b.s <> a.s or b.i <> a.i or b.j <> a.j) and b.v >= a.v)"
    )


add("blob_shipments", blobs, blobs_sql())

# Smaller rules that had no query: copies left out, one factor in a tuple, complex and coloured transforms, arithmetic of stencils, types
COPY = K.factored([1.0], [1.0])
add_fir("fir_copies", S.img8, (*COPY, *BINOMIAL, *COPY), "replicate", O.IMG8, HALVES, "replicate", D8, KEY)
add_fir("fir_one_factor", S.img8, (K.outer(K.gaussian((1, 1))),), "symmetric", O.IMG8, GAUSS1, "symmetric", D8, KEY)
add_fir("fir_no_pad", S.img8, (*K.factored([0.0, 1.0, 0.0], [1.0]), *BINOMIAL), Pad("reflect", (4, 4), (4, 4)), O.IMG8, HALVES, "reflect", D8, KEY)
add_fir("fft_channels", S.hours, K.gaussian((1, 1)), "symmetric", O.HOURS, GAUSS1, "symmetric", DH, ("event_type",), algorithm="fft")
add("gabor_complex_fft", lambda spark, d: gabor_pair(spark, d, "fft"),
    f"select x.vec_id, x.i, x.j, x.o as re, y.o as im from ({O.fir(O.IMG8, gabor_sql('cos'), 'circular', D8, KEY)}) x join ({O.fir(O.IMG8, gabor_sql('sin'), 'circular', D8, KEY)}) y on x.vec_id = y.vec_id and x.i = y.i and x.j = y.j")
LEFT, RIGHT = K.OneD(np.array([0.5, 0.25, 0.125]), 1, 0, 2), K.OneD(np.array([0.125, -0.5, 1.0]), 1, 0, 2)
SUM = O.literal_kernel("0 0.625 0; 0 -0.25 0; 0 1.125 0")
add_fir("fir_stencil_sum", S.img8, LEFT + RIGHT, "replicate", O.IMG8, SUM, "replicate", D8, KEY)
add_fir("fir_stencil_scaled", S.img8, (LEFT * 4 / 2,), "replicate", O.IMG8, O.literal_kernel("0 1 0; 0 0.5 0; 0 0.25 0"), "replicate", D8, KEY)
add("type_bytes", lambda spark, d: rounded(filter_raster(narrow(S.img8(spark, d), "byte"), K.factored(np.array([100, 100, 100]), np.array([1])), "replicate"), None),
    O.fir(f"select vec_id, i, j, cast(round(v * 100) as bigint) as v from ({O.IMG8})", O.window_kernel([(-1, 1), (0, 0)]), "replicate", D8, KEY, out="cast(sum(b.v) * 100 as bigint)"))
add("type_booleans", lambda spark, d: rounded(map_window(signs(S.img8(spark, d)), "sum", (3, 3), "symmetric"), None),
    O.fir(f"select vec_id, i, j, case when v > 0 then 1 else 0 end as v from ({O.IMG8})", O.window_kernel([(-1, 1), (-1, 1)]), "symmetric", D8, KEY, out="cast(sum(b.v) as bigint)"))
add("type_fixed_point", lambda spark, d: rounded(filter_raster(narrow(S.img8(spark, d), "decimal(9,2)"), K.box(3, 3), "reflect")),
    O.fir(f"select vec_id, i, j, round(v * 100) as v from ({O.IMG8})", O.product_kernel(O.box_line(3), O.box_line(3)), "reflect", D8, KEY))
add("localmax_colours", lambda spark, d: find_local_maxima(S.colours(spark, d)).select("vec_id", "i", "j", "c", (F.round("v", 6) + F.lit(0.0)).alias("o")),
    "with px as (select vec_id, cast((k-1)//8 as int) as i, cast(((k-1)//2)%4 as int) as j, cast((k-1)%2 as int) as c, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k)) select a.vec_id, a.i, a.j, a.c, round(a.v, 6) + 0.0 as o from px a "
    "where not exists (select 1 from px b where b.vec_id = a.vec_id and b.c = a.c and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and (b.i <> a.i or b.j <> a.j) and not (a.v > b.v))")  # fmt: skip


def flat_gradients(spark: SparkSession, d: str) -> DataFrame:
    """A third dimension of one pixel: kernels have one weight along it, so g3 only smooths along the others."""
    r = Raster.from_array_column(S.table(spark, d, "embeddings"), "vec_id", "embedding", (8, 8, 1), names=("i", "j", "k2"))
    return gradients(r, "sobel").df.select("vec_id", "i", "j", "k2", *[(F.round(f"g{k}", 6) + F.lit(0.0)).alias(f"g{k}") for k in (1, 2, 3)])


SLOPED = K.kernel_at(np.arange(1.0, 13.0).reshape(4, 3), (-2, 0))
CORNERS = "(values (-1, 2, 1.0), (1, -2, -2.0))"
SMOOTH, SLOPE = O.line_kernel(-1, "0.25 0.5 0.25"), O.line_kernel(-1, "-0.5 0 0.5")
add("grad_flat", flat_gradients,
    f"select x.vec_id, x.i, x.j, cast(0 as int) as k2, x.o as g1, y.o as g2, z.o as g3 from ({O.fir(O.IMG8, O.product_kernel(SLOPE, SMOOTH), 'replicate', D8, KEY)}) x "
    f"join ({O.fir(O.IMG8, O.product_kernel(SMOOTH, SLOPE), 'replicate', D8, KEY)}) y on x.vec_id = y.vec_id and x.i = y.i and x.j = y.j "
    f"join ({O.fir(O.IMG8, O.product_kernel(SMOOTH, SMOOTH), 'replicate', D8, KEY)}) z on x.vec_id = z.vec_id and x.i = z.i and x.j = z.j")  # fmt: skip
add_fir("fir_unseparated", S.img8, DENSE, "circular", O.IMG8, DENSE, "circular", D8, KEY, separable=False)


# Borders sized by a kernel, windows in their shape, answers of their own type, lines with gaps
add("pad_for_kernel", lambda spark, d: rounded(pad_raster(S.img8(spark, d), Pad("reflect").sized(SLOPED))),
    f"with px as ({O.IMG8}) select px.vec_id, cast(p.i as int) as i, cast(q.j as int) as j, round(px.v, 6) + 0.0 as o from range(-2, 9) p(i), range(0, 10) q(j), px "
    f"where px.i = {O.index('reflect', 'p.i', 8)} and px.j = {O.index('reflect', 'q.j', 8)}")  # fmt: skip
add("mapwin_shaped", lambda spark, d: rounded(map_window(S.img8(spark, d), lambda w: float(w[0, -1] - 2 * w[-1, 0]), (3, 5), "symmetric", python=True, shaped=True)),
    O.fir(O.IMG8, CORNERS, "symmetric", D8, KEY))
add("mapwin_own_type", lambda spark, d: rounded(map_window(S.hours(spark, d), lambda w: int(np.argmax(w)), (3, 1), "replicate", python=True, returns="auto"), None),
    "with px as (" + O.HOURS + "), w as (select *, coalesce(lag(v) over l, v) as a, coalesce(lead(v) over l, v) as b from px window l as (partition by event_type, j order by i)) "
    "select event_type, i, j, cast(case when a >= v and a >= b then 0 when v >= b then 1 else 2 end as bigint) as o from w")  # fmt: skip
for name, sql in (("sum", "sum"), ("max", "max"), ("count", "count")):
    add(f"sparse_{name}", lambda spark, d, name=name: rounded(sparse_window(order_days(spark, d), name, -30, 10), 4),
        f"with px as (select o_custkey, date_diff('day', date '1992-01-01', o_orderdate) as i, sum(floor(o_totalprice)) as v from orders group by all) "
        f"select o_custkey, cast(i as int) as i, round({sql}(v) over (partition by o_custkey order by i range between 30 preceding and 10 following), 4) + 0.0 as o from px")  # fmt: skip


def order_days(spark: SparkSession, d: str) -> Raster:
    """What each customer ordered, by day: lines with gaps."""
    day = F.datediff("o_orderdate", F.lit("1992-01-01")).cast("int").alias("i")
    cells = S.table(spark, d, "orders").groupBy("o_custkey", day).agg(F.sum(F.floor("o_totalprice")).cast("double").alias("v"))
    return Raster(cells, ("o_custkey",), (Axis("i", 0, 3000),))


def narrow(r: Raster, kind: str) -> Raster:
    return r.with_df(r.df.withColumn("v", F.round(F.col("v") * 100).cast(kind)))


def signs(r: Raster) -> Raster:
    return r.with_df(r.df.withColumn("v", F.col("v") > 0))
