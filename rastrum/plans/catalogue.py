"""Every operator as a query over the test tables, with the SQL it is compared with."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rastrum.functions import kernels as K
from rastrum.functions.borders import NA, Fill, Inner, Pad
from rastrum.operators.denoise import denoise_tv
from rastrum.operators.features import blob_log, find_local_maxima, find_local_minima, gradients
from rastrum.operators.filtering import filter_raster
from rastrum.operators.padding import pad_raster
from rastrum.operators.windows import map_window
from rastrum.plans import oracle as O
from rastrum.raster import Raster
from rastrum.sources import tables as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}
STYLES = ("replicate", "circular", "symmetric", "reflect")
KEY = ("vec_id",)
D8, D4 = O.dims((8, 8)), O.dims((4, 4, 4))
DH = [("i", 31, 1), ("j", 24, 0)]
DS = [("i", "a.ni", "a.fi"), ("j", "a.nj", "a.fj")]
#: Weights as SQL, written apart from the kernels that the engine uses.
GAUSS1, BOX3 = O.product_kernel(O.normal(1.0, 2), O.normal(1.0, 2)), O.product_kernel(O.box_line(3), O.box_line(3))
HALVES = O.product_kernel(O.line_kernel(-1, "0.25 0.5 0.25"), O.line_kernel(-1, "0.25 0.5 0.25"))


def rounded(r: Raster, digits: int | None = 6) -> DataFrame:
    v = F.col(r.value) if digits is None else F.round(F.col(r.value), digits) + F.lit(0.0)
    return r.df.select(*r.keys, *r.names, v.alias("o"))


def add(name: str, query: Callable[[SparkSession, str], DataFrame], sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql:
        ORACLES[name] = sql


def add_fir(name: str, source: Callable, kernel, by, px: str, dense: K.Kernel, style: str, axes: list, keys: tuple[str, ...], where: str = "", **options) -> None:
    add(name, lambda spark, d: rounded(filter_raster(source(spark, d), kernel, by, **options)), O.fir(px, dense, style, axes, keys, where))


# Padding
for style in STYLES:
    add(
        f"pad_{style}",
        lambda spark, d, style=style: rounded(pad_raster(S.img8(spark, d), Pad(style, (3, 2), (4, 2)))),
        f"with px as ({O.IMG8}) select g.vec_id, cast(p.i as int) as i, cast(q.j as int) as j, round(px.v, 6) + 0.0 as o from (select distinct vec_id from px) g, range(-3, 12) p(i), range(-2, 10) q(j), px "
        f"where px.vec_id = g.vec_id and px.i = {O.index(style, 'p.i', 8)} and px.j = {O.index(style, 'q.j', 8)}",
    )
add(
    "pad_fill",
    lambda spark, d: rounded(pad_raster(S.img8(spark, d), Fill(7.5, (3, 2), (4, 2)))),
    f"with px as ({O.IMG8}) select g.vec_id, cast(g.i as int) as i, cast(g.j as int) as j, round(coalesce(px.v, 7.5), 6) + 0.0 as o from "
    "(select vec_id, i, j from (select distinct vec_id from px), range(-3, 12) p(i), range(-2, 10) q(j)) g left join px on px.vec_id = g.vec_id and px.i = g.i and px.j = g.j",
)

# FIR over borders
BINOMIAL = K.factored([0.25, 0.5, 0.25], [0.25, 0.5, 0.25])
add_fir("fir_binomial_replicate", S.img8, BINOMIAL, "replicate", O.IMG8, HALVES, "replicate", D8, KEY)
for style in STYLES:
    add_fir(f"fir_box3_{style}", S.img8, K.box(3, 3), style, O.IMG8, BOX3, style, D8, KEY)
    add_fir(f"fir_gauss_{style}", S.img8, K.gaussian((1, 1)), style, O.IMG8, GAUSS1, style, D8, KEY)
for name, k, weights in (("box3", K.box(3, 3), BOX3), ("gauss", K.gaussian((1, 1)), GAUSS1)):
    add(f"fir_{name}_fill", lambda spark, d, k=k: rounded(filter_raster(S.img8(spark, d), k, Fill(0.5))), O.fir_fill(O.IMG8, weights, 0.5, D8, KEY))
OFF = K.kernel_at([[0.1, 0.2], [0.4, 0.5]], (-1, 1))
DENSE = K.centered([[0.5, -1.0, 0.25], [0.0, 2.0, 0.125], [-0.75, 0.3, 1.5]])
INTS = K.centered(np.array([[1, 2, 1], [0, -3, 2], [4, 1, 1]]))
INNER = "where a.i between 1 and 6 and a.j between 1 and 6"
add_fir("fir_offcentre", S.img8, OFF, "reflect", O.IMG8, OFF, "reflect", D8, KEY)
add_fir("fir_dense_inseparable", S.img8, DENSE, "replicate", O.IMG8, DENSE, "replicate", D8, KEY)
add_fir("fir_convolution", S.img8, K.reflect(DENSE), "replicate", O.IMG8, K.reflect(DENSE), "replicate", D8, KEY)
add_fir("fir_svd_separated", S.img8, K.outer(K.gaussian((1, 1))), "symmetric", O.IMG8, GAUSS1, "symmetric", D8, KEY)
add_fir("fir_inner", S.img8, DENSE, Inner(), O.IMG8, DENSE, "", D8, KEY, INNER)
add_fir("fir_roi", S.img8, DENSE, "circular", O.IMG8, DENSE, "circular", D8, KEY, "where a.i between 2 and 4 and a.j between 0 and 3", roi={"i": (2, 4), "j": (0, 3)})
add_fir("fir_shipments", S.shipments, K.gaussian((2, 2)), "reflect", O.SHIPMENTS, O.product_kernel(O.normal(2.0, 4), O.normal(2.0, 4)), "reflect", DS, ())
add_fir("fir_channels", S.hours, BINOMIAL, "circular", O.HOURS, HALVES, "circular", DH, ("event_type",))
add_fir("fir3d_box", S.vol4, K.box(3, 3, 3), "symmetric", O.VOL4, O.product_kernel(O.box_line(3), O.box_line(3), O.box_line(3)), "symmetric", D4, KEY)
add(
    "fir_int",
    lambda spark, d: rounded(filter_raster(S.img8q(spark, d), INTS, "replicate"), None),
    O.fir(O.IMG8Q, INTS, "replicate", D8, KEY, out="cast(sum(b.v * kr.w) as bigint)"),
)
add(
    "fir_na",
    lambda spark, d: rounded(filter_raster(missing(S.img8(spark, d)), K.box(3, 3), NA())),
    f"{O.with_px(f'select vec_id, i, j, case when v < -0.1 then null else v end as v from ({O.IMG8})', K.outer(K.box(3, 3)))} select {O.selected(D8, KEY)}, "
    f"round(coalesce(sum(b.v * kr.w) / nullif(sum(case when b.v is not null then kr.w end), 0), cast('nan' as double)), 6) + 0.0 as o from px a cross join kr join px b on {O.join_on('', D8, KEY)} group by all",
)


def missing(r: Raster) -> Raster:
    return r.with_df(r.df.withColumn("v", F.when(F.col("v") >= -0.1, F.col("v"))))


# A cascade is padded once: the signal's composite kernel on one padded signal is the same
STEP1, STEP2 = K.OneD(np.array([0.3, 0.4, 0.3]), 1, 0, 1), K.OneD(np.array([0.6, 0.4]), -1, 0, 1)
WHOLE = "(values (-1, 0.054), (0, 0.18), (1, 0.3), (2, 0.28), (3, 0.15), (4, 0.036))"  # by hand
SIG_ON = "b.user_id = a.user_id and b.i = "
add(
    "fir_cascade",
    lambda spark, d: rounded(filter_raster(S.signals(spark, d), (STEP1, STEP2, STEP1), "replicate")),
    f"with px as ({O.SIGNALS}), kr(d0, w) as {O.values(WHOLE)} select a.user_id, a.i, round(sum(b.v * kr.w), 6) + 0.0 as o from px a cross join kr join px b on {SIG_ON}{O.index('replicate', '(a.i + kr.d0)', 'a.n')} group by all",
)

# Kernel catalogue
GABOR = K.centered(K.gabor(5, 5, 2.0, 0.3, 3.0, 0.8, 0.1)[0])
LOG1 = O.grid_kernel(4, "(y * y + x * x - 2.0) * exp(-(y * y + x * x) / 2.0) / (2 * pi())")
DOG1 = "(select a.d0, a.d1, a.w - b.w as w from " + O.product_kernel(O.normal(1.0, 4), O.normal(1.0, 4)) + " a join " + O.product_kernel(O.normal(math.sqrt(2), 4), O.normal(math.sqrt(2), 4)) + " b on a.d0 = b.d0 and a.d1 = b.d1)"
ROTATED = "(select y, x, x * cos(0.3) + y * sin(0.3) as r, y * cos(0.3) - x * sin(0.3) as q from range(-2, 3) a(y), range(-2, 3) b(x))"


def gabor_sql(wave: str) -> str:
    return f"(select cast(y as int) as d0, cast(x as int) as d1, exp(-(power(r / 2.0, 2) + power(q / (2.0 / 0.8), 2)) / 2) * {wave}(2 * pi() / 3.0 * r + 0.1) as w from {ROTATED})"


CROSS = O.literal_kernel("0 1 0; 1 -4 1; 0 1 0")
CATALOGUE = {
    "laplacian": (K.Laplacian(), CROSS), "laplacian2d": (K.laplacian2d(0.5), O.literal_kernel("1 1 1; 1 -8 1; 1 1 1").replace(", w from", ", w / 3.0 from")), "dog": (K.dog(1), DOG1),
    "log": (K.log_kernel(1), LOG1), "moffat": (K.moffat(1.0, 2.5, 5), O.grid_kernel(2, "1.5 / pi() * power(1.0 + y * y + x * x, -2.5)")), "gabor": (GABOR, gabor_sql("cos")),
}
for name, (k, weights) in CATALOGUE.items():
    add_fir(name, S.img8, k, "symmetric", O.IMG8, weights, "symmetric", D8, KEY)
add_fir("fft_gauss", S.img8, K.outer(K.gaussian((1, 1))), "circular", O.IMG8, GAUSS1, "circular", D8, KEY, algorithm="fft")
SMALL_DOG = "(select a.d0, a.d1, a.w - b.w as w from " + O.product_kernel(O.normal(0.8, 2), O.normal(0.8, 2)) + " a join " + O.product_kernel(O.normal(0.8 * math.sqrt(2), 2), O.normal(0.8 * math.sqrt(2), 2)) + " b on a.d0 = b.d0 and a.d1 = b.d1)"
add_fir("fft_dog_inner", S.img8, K.dog(0.8, lengths=(5, 5)), Inner(), O.IMG8, SMALL_DOG, "", D8, KEY, "where a.i between 2 and 5 and a.j between 2 and 5", algorithm="fft")
WIDE = K.centered((np.arange(49) * 5 % 17 - 8).reshape(7, 7) / 16)  # 46 weights and of full rank: by Fourier transform, unasked
WIDE_SQL = O.grid_kernel(3, "(((y + 3) * 7 + x + 3) * 5 % 17 - 8) / 16.0")
add_fir("fft_by_itself", S.img8, WIDE, "reflect", O.IMG8, WIDE_SQL, "reflect", D8, KEY)
add_fir("fft_spectrum_kernel", S.img8, K.spectrum_kernel(K.kernel_spectrum(K.outer(K.gaussian((1, 1))), (16, 16)), [(-2, 2), (-2, 2)]), "replicate", O.IMG8, GAUSS1, "replicate", D8, KEY)
add("gabor_complex", lambda spark, d: gabor_pair(spark, d),
    f"select x.vec_id, x.i, x.j, x.o as re, y.o as im from ({O.fir(O.IMG8, gabor_sql('cos'), 'circular', D8, KEY)}) x join ({O.fir(O.IMG8, gabor_sql('sin'), 'circular', D8, KEY)}) y on x.vec_id = y.vec_id and x.i = y.i and x.j = y.j")


def gabor_pair(spark: SparkSession, d: str, algorithm: str | None = None) -> DataFrame:
    real, imaginary = K.gabor(5, 5, 2.0, 0.3, 3.0, 0.8, 0.1)
    r = filter_raster(S.img8(spark, d), K.centered(real + 1j * imaginary), "circular", algorithm=algorithm)
    return r.df.select("vec_id", "i", "j", *[(F.round(f"v.{p}", 6) + F.lit(0.0)).alias(p) for p in ("re", "im")])


# Borders with sizes of their own, pixels that are no numbers, and a rule of one's own for missing ones
add_fir("fir_sized_border", S.img8, BINOMIAL, Pad("replicate", (3, 2), (1, 2)), O.IMG8, HALVES, "replicate", D8, KEY)
add_fir("fir_sized_inner", S.img8, DENSE, Inner((2, 1), (1, 3)), O.IMG8, DENSE, "", D8, KEY, "where a.i between 2 and 6 and a.j between 1 and 4")
add("pad_strings", lambda spark, d: pad_raster(letters(S.img8(spark, d)), Pad("reflect", (1, 2), (2, 0))).df.select("vec_id", "i", "j", F.col("v").alias("o")),
    f"with px as ({O.IMG8}) select px.vec_id, cast(p.i as int) as i, cast(q.j as int) as j, case when px.v < 0 then 'low' else 'high' end as o from range(-1, 10) p(i), range(-2, 8) q(j), px "
    f"where px.i = {O.index('reflect', 'p.i', 8)} and px.j = {O.index('reflect', 'q.j', 8)}")  # fmt: skip
PRESENT = "case when abs(v) <= 0.2 then v end"
for tail, options in (("", {}), ("_fft", {"algorithm": "fft"})):
    source = (lambda spark, d: S.img8(spark, d)) if not tail else (lambda spark, d: with_nan(S.img8(spark, d)))
    rule = NA(lambda v: F.abs(v) > 0.2) if not tail else NA()
    kept = PRESENT if not tail else "case when v >= -0.15 then v end"
    add(f"fir_na_rule{tail}", lambda spark, d, source=source, rule=rule, options=options: rounded(filter_raster(source(spark, d), K.box(3, 3), rule, **options)),
        f"{O.with_px(f'select vec_id, i, j, {kept} as v from ({O.IMG8})', BOX3)} select {O.selected(D8, KEY)}, "
        f"round(coalesce(sum(b.v * kr.w) / nullif(sum(case when b.v is not null then kr.w end), 0), cast('nan' as double)), 6) + 0.0 as o from px a cross join kr join px b on {O.join_on('', D8, KEY)} group by all")  # fmt: skip


def letters(r: Raster) -> Raster:
    return r.with_df(r.df.withColumn("v", F.when(F.col("v") < 0, "low").otherwise("high")))


def with_nan(r: Raster) -> Raster:
    return r.with_df(r.df.withColumn("v", F.when(F.col("v") >= -0.15, F.col("v")).otherwise(float("nan"))))


# Sources and sinks
def through_files(spark: SparkSession, d: str) -> DataFrame:
    """Array rows and pixels written as Parquet and read again."""
    folder = S.scratch(spark)
    S.write_rows(S.img8(spark, d), f"{folder}/rows")
    r = Raster.from_array_column(spark.read.parquet(f"{folder}/rows"), "vec_id", "data", (8, 8))
    S.write_pixels(filter_raster(r, BINOMIAL, "reflect"), f"{folder}/pixels")
    return spark.read.parquet(f"{folder}/pixels").select("vec_id", "i", "j", (F.round("v", 6) + F.lit(0.0)).alias("o"))


def image_files(spark: SparkSession, d: str) -> DataFrame:
    """Embeddings written as small bitmap files and read as images (blue, green, red along c)."""
    folder = S.scratch(spark)
    S.write_bitmaps(S.table(spark, d, "embeddings"), "vec_id", "embedding", (8, 8), folder)
    r = S.read_images(spark, folder, 8, 8, 3)
    name = F.regexp_extract("origin", r"vec_id=(\d+)/", 1).cast("long")
    return filter_raster(r, K.box(3, 3, 1), "replicate").df.select(name.alias("vec_id"), "i", "j", "c", (F.round("v", 6) + F.lit(0.0)).alias("o"))


add("sink_source_parquet", through_files, O.fir(O.IMG8, HALVES, "reflect", D8, KEY))
add("source_image_files", image_files,
    f"select x.vec_id, x.i, x.j, cast(c as int) as c, x.o from ({O.fir(f'select vec_id, i, j, greatest(0, least(255, floor(v * 100 + 128))) as v from ({O.IMG8})', BOX3, 'replicate', D8, KEY)}) x, range(0, 3) t(c)")


# Recursive filters
def recursive_sql(px: str, ctes: list[str], last: str, columns: str) -> str:
    return f"with recursive px as ({px}), {', '.join(ctes)} select {columns}, round(v, 6) + 0.0 as o from {last}"


LINES = ("event_type", "j")
add("iir_gauss_1d", lambda spark, d: rounded(filter_raster(S.hours(spark, d), (K.iir_gaussian(2.0), None), "replicate")).select("event_type", "i", "j", "o"),
    recursive_sql(O.HOURS, [O.recursion("px", LINES, "i", 2.0, "a")], "a", "event_type, i, j"))
add("iir_fill", lambda spark, d: rounded(filter_raster(S.hours(spark, d), (K.iir_gaussian(2.0), None), Fill(3.0))).select("event_type", "i", "j", "o"),
    recursive_sql(O.HOURS, [O.recursion("px", LINES, "i", 2.0, "a", "3.0")], "a", "event_type, i, j"))
add("iir_gauss_2d", lambda spark, d: rounded(filter_raster(S.img8(spark, d), (K.iir_gaussian(1.5), K.iir_gaussian(2.0)))),
    recursive_sql(O.IMG8, [O.recursion("px", ("vec_id", "j"), "i", 1.5, "a"), O.recursion("a", ("vec_id", "i"), "j", 2.0, "b")], "b", "vec_id, i, j"))
KNOWN = "case when v >= -0.1 then v else 0.0 end"
add("iir_na", lambda spark, d: rounded(filter_raster(missing(S.img8(spark, d)), (K.iir_gaussian(1.5), None), NA())),
    f"with recursive px as (select vec_id, i, j, {KNOWN} as v from ({O.IMG8})), py as (select vec_id, i, j, case when v >= -0.1 then 1.0 else 0.0 end as v from ({O.IMG8})), "
    f"{O.recursion('px', ('vec_id', 'j'), 'i', 1.5, 'a', '0.0')}, {O.recursion('py', ('vec_id', 'j'), 'i', 1.5, 'b', '0.0')} select a.vec_id, a.i, a.j, round(a.v / b.v, 6) + 0.0 as o from a join b on a.vec_id = b.vec_id and a.i = b.i and a.j = b.j")  # fmt: skip
# A box and a recursion commute, as the raster is padded once: the SQL extends the recursion's line by hand
BOX_LINE = K.OneD(np.ones(3) / 3, 1, 0, 2)
for tail, stages in (("", lambda: (K.iir_gaussian(2.0), BOX_LINE)), ("_swapped", lambda: (BOX_LINE, K.iir_gaussian(2.0)))):
    add(f"iir_mixed{tail}", lambda spark, d, stages=stages: rounded(filter_raster(S.img8(spark, d), stages(), Fill(0.0))),
        f"with recursive px as (select p.vec_id, cast(t.i as int) as i, p.j, case when t.i between 0 and 7 then p.v else 0.0 end as v from range(-4, 12) t(i) join ({O.IMG8}) p on p.i = greatest(0, least(7, t.i))), "
        f"{O.recursion('px', ('vec_id', 'j'), 'i', 2.0, 'a', '0.0')} select a.vec_id, a.i, a.j, round(avg(b.v), 6) + 0.0 as o from a join a b on a.vec_id = b.vec_id and a.j = b.j and abs(a.i - b.i) <= 1 where a.i between 0 and 7 group by all")  # fmt: skip

# Sliding windows
SPAN33, SPAN35 = O.window_kernel([(-1, 1), (-1, 1)]), O.window_kernel([(-1, 1), (-2, 2)])
for name, sql in {
    "min": "min(b.v)", "max": "max(b.v)", "sum": "sum(b.v)", "mean": "avg(b.v)", "median": "median(b.v)", "std": "stddev_samp(b.v)",
    "quantile": "quantile_cont(b.v, 0.7)", "first": "arg_min(b.v, kr.d0 + 10 * kr.d1)", "lower_median": "list_sort(list(b.v))[8]",
}.items():
    add(
        f"mapwin_{name}",
        lambda spark, d, name=name: rounded(map_window(S.img8(spark, d), name, (3, 5), "reflect", q=0.7)),
        O.fir(O.IMG8, SPAN35, "reflect", D8, KEY, out=f"round({sql}, 6) + 0.0"),
    )
add("mapwin_median_signal", lambda spark, d: rounded(map_window(S.signals(spark, d), "median", 5, "replicate")),
    f"with px as ({O.SIGNALS}), kr(d0) as (values (-2), (-1), (0), (1), (2)) select a.user_id, a.i, round(median(b.v), 6) + 0.0 as o from px a cross join kr join px b on {SIG_ON}{O.index('replicate', '(a.i + kr.d0)', 'a.n')} group by all")
add("mapwin_asym", lambda spark, d: rounded(map_window(S.signals(spark, d), "max", (-3, 1), "replicate")),
    f"with px as ({O.SIGNALS}), kr(d0) as (values (-3), (-2), (-1), (0), (1)) select a.user_id, a.i, round(max(b.v), 6) + 0.0 as o from px a cross join kr join px b on {SIG_ON}{O.index('replicate', '(a.i + kr.d0)', 'a.n')} group by all")
add("mapwin_fill", lambda spark, d: rounded(map_window(S.img8(spark, d), "mean", (3, 3), Fill(1.0))), O.fir_fill(O.IMG8, K.Kernel(np.full((3, 3), 1 / 9), (1, 1)), 1.0, D8, KEY))
add("mapwin_inner", lambda spark, d: rounded(map_window(S.img8(spark, d), "max", (3, 3), Inner())), O.fir(O.IMG8, SPAN33, "", D8, KEY, INNER, "round(max(b.v), 6) + 0.0"))
add("mapwin_strided", lambda spark, d: rounded(map_window(S.img8(spark, d), "median", (3, 3), "symmetric", indices={"i": range(1, 8, 3)})),
    f"select vec_id, cast((i - 1) // 3 as int) as i, j, o from ({O.fir(O.IMG8, SPAN33, 'symmetric', D8, KEY, 'where a.i % 3 = 1', 'round(median(b.v), 6) + 0.0')})")
add("mapwin_extrema", lambda spark, d: extrema(spark, d),
    f"with px as ({O.SIGNALS}) select user_id, i, round(min(v) over w, 6) + 0.0 as low, round(max(v) over w, 6) + 0.0 as high from px window w as (partition by user_id order by i rows between 2 preceding and 1 following)")
add("mapwin_python", lambda spark, d: rounded(map_window(S.img8(spark, d), lambda w: float(np.ptp(w)), (3, 3), "circular", python=True)),
    O.fir(O.IMG8, SPAN33, "circular", D8, KEY, out="round(max(b.v) - min(b.v), 6) + 0.0"))
add("mapwin_3d_sum", lambda spark, d: rounded(map_window(S.vol4(spark, d), "sum", (1, 3, 3), "replicate")), O.fir(O.VOL4, O.window_kernel([(0, 0), (-1, 1), (-1, 1)]), "replicate", D4, KEY, out="round(sum(b.v), 6) + 0.0"))
LOW, HIGH = "greatest(0, a.i - 2)", "least(a.n - 1, a.i + 2)"
for style in ("circular", "symmetric"):
    add(f"mapwin_local_{style}", lambda spark, d, style=style: rounded(map_window(S.signals(spark, d), "sum", 5, style, local_border=True)),
        f"with px as ({O.SIGNALS}), kr(d0) as (values (-2), (-1), (0), (1), (2)) select a.user_id, a.i, round(sum(b.v), 6) + 0.0 as o from px a cross join kr join px b "
        f"on {SIG_ON}{O.index(style, '(a.i + kr.d0)', f'{HIGH} - {LOW} + 1', LOW)} group by all")  # fmt: skip


def extrema(spark: SparkSession, d: str) -> DataFrame:
    r = map_window(S.signals(spark, d), "extrema", 4)
    return r.df.select("user_id", "i", (F.round("v.min", 6) + F.lit(0.0)).alias("low"), (F.round("v.max", 6) + F.lit(0.0)).alias("high"))


# Composites of windows
def minmax_edge(spark: SparkSession, d: str) -> DataFrame:
    r = map_window(S.img8(spark, d), "extrema", (3, 3))
    return r.df.select("vec_id", "i", "j", (F.round(F.col("v.max") - F.col("v.min"), 6) + F.lit(0.0)).alias("o"))


add("minmax_edge", minmax_edge, O.fir(O.IMG8, SPAN33, "replicate", D8, KEY, out="round(max(b.v) - min(b.v), 6) + 0.0"))
TEMPLATE = K.centered([[0.1, 0.0, -0.1], [0.2, 0.3, 0.0], [-0.2, 0.1, 0.1]])
WEIGHTS = {a * 1 + b * 3: float(TEMPLATE.weights[a, b]) for a in range(3) for b in range(3)}


def template_ssd(spark: SparkSession, d: str) -> DataFrame:
    wanted = F.array(*[F.lit(WEIGHTS[k]) for k in range(9)])
    return rounded(map_window(S.img8(spark, d), lambda v, o: F.sum(F.pow(v - F.element_at(wanted, o + 1), F.lit(2.0))), (3, 3), Fill(1.0)))


SHIFTED = K.Kernel(np.where(TEMPLATE.weights == 0, 1e-300, TEMPLATE.weights), TEMPLATE.origin)  # no tap may vanish from the list
add("template_ssd", template_ssd, O.fir_fill(O.IMG8, SHIFTED, 1.0, D8, KEY).replace("sum(coalesce(b.v, 1.0) * kr.w)", "sum(power(coalesce(b.v, 1.0) - kr.w, 2))"))
add("nan_median", lambda spark, d: rounded(map_window(with_nan(S.img8(spark, d)), "nan_median", (3, 3), "replicate")),
    O.fir(f"select vec_id, i, j, case when v < -0.15 then null else v end as v from ({O.IMG8})", SPAN33, "replicate", D8, KEY, out="round(median(b.v), 6) + 0.0"))


VOL5 = "select vec_id, cast((k-1)//32 as int) as i, cast(((k-1)//16)%2 as int) as j, cast(((k-1)//8)%2 as int) as k2, cast(((k-1)//4)%2 as int) as l, cast((k-1)%4 as int) as m, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k)"
D5 = O.dims((2, 2, 2, 2, 4), names=("i", "j", "k2", "l", "m"))
add("mapwin_5d_sum", lambda spark, d: rounded(map_window(S.vol5(spark, d), "sum", (1, 1, 1, 1, 3), "replicate")),
    O.fir(VOL5, O.window_kernel([(0, 0), (0, 0), (0, 0), (0, 0), (-1, 1)]), "replicate", D5, KEY, out="round(sum(b.v), 6) + 0.0"))


# Gradients
# Smoothing and difference weights of each gradient, in order of displacement.
LINE_WEIGHTS = {
    "sobel": ("0.25 0.5 0.25", "-0.5 0 0.5"), "prewitt": ("1/3.0 1/3.0 1/3.0", "-0.5 0 0.5"), "scharr": ("0.1875 0.625 0.1875", "-0.5 0 0.5"), "bickley": ("1/6.0 4/6.0 1/6.0", "-0.5 0 0.5"),
    "ando3": ("0.225474 0.549052 0.225474", "-0.5 0 0.5"),
    "ando4": ("0.0919833 0.408017 0.408017 0.0919833", "1.46205884*-0.0919833 1.46205884*-0.408017 1.46205884*0.408017 1.46205884*0.0919833"),
    "ando5": ("0.0357338 0.248861 0.43081 0.248861 0.0357338", "0.784406*-0.137424 0.784406*-0.362576 0 0.784406*0.362576 0.784406*0.137424"),
}
DENSE_WEIGHTS = {
    "ando4": "-0.022116 -0.025526 0.025526 0.022116; -0.098381 -0.112984 0.112984 0.098381; -0.098381 -0.112984 0.112984 0.098381; -0.022116 -0.025526 0.025526 0.022116",
    "ando5": "-0.003776 -0.010199 0 0.010199 0.003776; -0.026786 -0.070844 0 0.070844 0.026786; -0.046548 -0.122572 0 0.122572 0.046548; -0.026786 -0.070844 0 0.070844 0.026786; -0.003776 -0.010199 0 0.010199 0.003776",
}
for name, rows in DENSE_WEIGHTS.items():
    first = -1 if name == "ando4" else -2
    across = O.literal_kernel(rows, (first, first))
    turned = across.replace("select d0, d1, w", "select d1 as d0, d0 as d1, w")
    for dim, weights in ((0, turned), (1, across)):
        add_fir(f"grad_{name}_dense_{dim + 1}", S.img8, K.gradient_dense(name, dim), "replicate", O.IMG8, weights, "replicate", D8, KEY)
CENTRAL = lambda long, d: K.factored(*[[-1.0, 0.0, 1.0] if k == d else [1.0] for k in range(len(long))])
for name in (*K.GRADIENTS, "own"):
    parts = []
    for dim in (0, 1):
        across, along = LINE_WEIGHTS.get(name, ("0 1 0", "-1 0 1"))
        first = -1 if name not in ("ando5",) else -2
        lines = [O.line_kernel(first, across), O.line_kernel(first, along)]
        k = O.product_kernel(*(lines if dim else lines[::-1]))
        parts.append(f"(select * from ({O.fir(O.IMG8, k, 'replicate', D8, KEY)}))")
    add(
        f"grad_{name}",
        lambda spark, d, name=name: (g := gradients(S.img8(spark, d), CENTRAL if name == "own" else name)).df.select("vec_id", "i", "j", *[(F.round(f"g{k}", 6) + F.lit(0.0)).alias(f"g{k}") for k in (1, 2)]),
        f"select x.vec_id, x.i, x.j, x.o as g1, y.o as g2 from {parts[0]} x join {parts[1]} y on x.vec_id = y.vec_id and x.i = y.i and x.j = y.j",
    )

# Local extrema and blobs
for name, find, sign in (("localmax", find_local_maxima, ">"), ("localmin", find_local_minima, "<")):
    for tail, edges in (("", True), ("_inside", False)):
        inside = "" if edges else " and a.i between 1 and 6 and a.j between 1 and 6"
        add(
            name + tail,
            lambda spark, d, find=find, edges=edges: find(S.img8(spark, d), edges=edges).select("vec_id", "i", "j", (F.round("v", 6) + F.lit(0.0)).alias("o")),
            f"with px as ({O.IMG8}) select a.vec_id, a.i, a.j, round(a.v, 6) + 0.0 as o from px a where not exists (select 1 from px b where b.vec_id = a.vec_id "
            f"and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and (b.i <> a.i or b.j <> a.j) and not (a.v {sign} b.v)){inside}",
        )
add("localmax_shipments", lambda spark, d: find_local_maxima(S.shipments(spark, d), (5, 3)).select("i", "j", F.col("v").alias("o")),
    f"with px as ({O.SHIPMENTS}) select a.i, a.j, a.v as o from px a where not exists (select 1 from px b where abs(b.i - a.i) <= 2 and abs(b.j - a.j) <= 1 and (b.i <> a.i or b.j <> a.j) and not (a.v > b.v))")
SCALES = (1.0, math.sqrt(2), 2.0)


def blobs(spark: SparkSession, d: str) -> DataFrame:
    found = blob_log(S.hours(spark, d), SCALES, threshold=0.05)
    return found.select("event_type", "i", "j", (F.round(F.element_at("sigma", 1), 6) + F.lit(0.0)).alias("sigma"), (F.round(F.element_at("radius", 2), 6) + F.lit(0.0)).alias("radius"), (F.round("amplitude", 6) + F.lit(0.0)).alias("amplitude"))


def blobs_sql() -> str:
    slices = []
    for s, sigma in enumerate(SCALES):
        half = math.ceil(8.5 * sigma) // 2
        t = f"cast({sigma * sigma!r} as double)"
        k = O.grid_kernel(half, f"((y * y + x * x) / ({t} * {t}) - 2 / ({t})) * exp(-(y * y + x * x) / (2 * {t})) / (2 * pi() * {t})")
        slices.append(f"select event_type, i, j, {s} as s, cast({sigma!r} as double) as sigma, -{sigma!r}::double * o as v from ({O.fir(O.HOURS, k, 'reflect', DH, ('event_type',), out='sum(b.v * kr.w)')})")
    return (
        f"with st as materialized ({' union all '.join(slices)}), top as (select event_type, max(v) as t from ({O.HOURS}) group by 1) "
        "select a.event_type, a.i, a.j, round(a.sigma, 6) + 0.0 as sigma, round(a.sigma * sqrt(2), 6) + 0.0 as radius, round(a.v, 6) + 0.0 as amplitude from st a join top on top.event_type = a.event_type "
        "where a.i between 2 and 30 and a.j between 1 and 22 and a.v > 0.05 / (a.sigma * a.sigma) * top.t and not exists (select 1 from st b where b.event_type = a.event_type "
        "and abs(b.s - a.s) <= 1 and abs(b.i - a.i) <= 1 and abs(b.j - a.j) <= 1 and (b.s <> a.s or b.i <> a.i or b.j <> a.j) and b.v >= a.v)"
    )


add("blob_log", blobs, blobs_sql())


# Denoising: two rounds written out
def tv_sql(lam: float, rounds: int) -> str:
    lam = float(np.float32(lam))
    t = 0.25 / lam
    sql = [f"g as ({O.IMG8})"]

    def slopes(name: str, source: str) -> str:
        return (
            f"{name} as (select a.vec_id, a.i, a.j, x.v - a.v as s1, y.v - a.v as s2 from {source} a join {source} x on x.vec_id = a.vec_id and x.i = (a.i + 1) % 8 and x.j = a.j "
            f"join {source} y on y.vec_id = a.vec_id and y.i = a.i and y.j = (a.j + 1) % 8)"
        )

    sql.append(slopes("p0", "g"))
    for k in range(rounds):
        sql.append(
            f"u{k} as (select a.vec_id, a.i, a.j, g.v - {lam!r}::double * (a.s1 - x.s1 + a.s2 - y.s2) as v from p{k} a join g on g.vec_id = a.vec_id and g.i = a.i and g.j = a.j "
            f"join p{k} x on x.vec_id = a.vec_id and x.i = (a.i + 7) % 8 and x.j = a.j join p{k} y on y.vec_id = a.vec_id and y.i = a.i and y.j = (a.j + 7) % 8)"
        )
        sql.append(slopes(f"d{k}", f"u{k}"))
        size = f"(1 + {t!r}::double * sqrt(d.s1 * d.s1 + d.s2 * d.s2))"
        sql.append(f"p{k + 1} as (select a.vec_id, a.i, a.j, (a.s1 - {t!r}::double * d.s1) / {size} as s1, (a.s2 - {t!r}::double * d.s2) / {size} as s2 from p{k} a join d{k} d on d.vec_id = a.vec_id and d.i = a.i and d.j = a.j)")
    return f"with {', '.join(sql)} select vec_id, i, j, round(v, 6) + 0.0 as o from u{rounds - 1}"


add("rof_tv", lambda spark, d: rounded(denoise_tv(S.img8(spark, d), 0.1, 2)), tv_sql(0.1, 2))


# Colours: two channels of 8 x 4, whose slopes make one norm
def tv_colour_sql(lam: float) -> str:
    lam = float(np.float32(lam))
    t = 0.25 / lam
    px = "select vec_id, cast((k-1)//8 as int) as i, cast(((k-1)//2)%4 as int) as j, cast((k-1)%2 as int) as c, cast(embedding[k] as double) as v from embeddings, range(1, 65) t(k)"

    def slopes(source: str) -> str:
        on = lambda x, i, j: f"join {source} {x} on {x}.vec_id = a.vec_id and {x}.c = a.c and {x}.i = {i} and {x}.j = {j}"
        return f"select a.vec_id, a.i, a.j, a.c, x.v - a.v as s1, y.v - a.v as s2 from {source} a {on('x', '(a.i + 1) % 8', 'a.j')} {on('y', 'a.i', '(a.j + 1) % 4')}"

    def moved(p: str) -> str:
        on = lambda x, i, j: f"join {p} {x} on {x}.vec_id = a.vec_id and {x}.c = a.c and {x}.i = {i} and {x}.j = {j}"
        return (
            f"select a.vec_id, a.i, a.j, a.c, g.v - {lam!r}::double * (a.s1 - x.s1 + a.s2 - y.s2) as v from {p} a join g on g.vec_id = a.vec_id and g.i = a.i and g.j = a.j and g.c = a.c "
            f"{on('x', '(a.i + 7) % 8', 'a.j')} {on('y', 'a.i', '(a.j + 3) % 4')}"
        )

    size = f"(1 + {t!r}::double * sqrt(n.q))"
    return (
        f"with g as ({px}), p0 as ({slopes('g')}), u0 as ({moved('p0')}), d0 as ({slopes('u0')}), n as (select vec_id, i, j, sum(s1 * s1 + s2 * s2) as q from d0 group by all), "
        f"p1 as (select a.vec_id, a.i, a.j, a.c, (a.s1 - {t!r}::double * d.s1) / {size} as s1, (a.s2 - {t!r}::double * d.s2) / {size} as s2 from p0 a "
        f"join d0 d on d.vec_id = a.vec_id and d.i = a.i and d.j = a.j and d.c = a.c join n on n.vec_id = a.vec_id and n.i = a.i and n.j = a.j), "
        f"u1 as ({moved('p1')}) select vec_id, i, j, c, round(v, 6) + 0.0 as o from u1"
    )


add("rof_tv_colour", lambda spark, d: rounded(denoise_tv(S.colours(spark, d), 0.1, 2, channel="c")), tv_colour_sql(0.1))
