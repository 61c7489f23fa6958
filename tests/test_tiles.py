"""Images in tiles and lines in blocks against the same images taken whole."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from tests.rasters import array, raster

from rastrum import Axis, Fill, Inner, NA, Pad, Raster, blob_log, denoise_tv, filter_raster, find_local_maxima, map_window
from rastrum.functions import kernels as K
from rastrum.operators import recursive, tiles
from rastrum.operators.filtering import smooth_size
from rastrum.operators.recursive import fold_lines
from rastrum.operators.tiles import box_sums, running, select_ranks, tile_sides
from rastrum.operators.windows import sparse_window, window_results

RNG = np.random.default_rng(4)
MODES = {"replicate": "edge", "circular": "wrap", "symmetric": "symmetric", "reflect": "reflect"}


def keyless(spark, x, first=None, kind="double"):
    r = raster(spark, x, first, kind)
    return Raster(r.df.drop("image"), (), r.axes)


@pytest.fixture(autouse=True)
def small_tiles(monkeypatch):
    monkeypatch.setattr(tiles, "TILE_PIXELS", 300)
    monkeypatch.setattr(recursive, "LINE_BLOCK", 16)


def by_hand(x, weights, origin, mode):
    need = [(o, s - 1 - o) for o, s in zip(origin, weights.shape)]
    p = np.pad(x, need, mode=mode) if isinstance(mode, str) else np.pad(x, need, constant_values=mode)
    out = np.zeros(x.shape)
    for at in np.ndindex(weights.shape):
        out += p[tuple(slice(a, a + n) for a, n in zip(at, x.shape))] * weights[at]
    return out


@pytest.mark.parametrize("style", [*MODES, "fill", "inner"])
def test_dense_kernels(spark, style):
    x, w = RNG.normal(size=(61, 47)), RNG.normal(size=(9, 7))
    k = K.Kernel(w, (3, 4))
    by = Fill(0.5) if style == "fill" else Inner() if style == "inner" else style
    r = keyless(spark, x, (-5, 3))
    out = filter_raster(r, k, by)
    plan = out.df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "FlatMapGroupsInArrow" in plan
    want = by_hand(x, w, (3, 4), 0.5 if style == "fill" else MODES.get(style, "edge"))
    want = want[3:-5, 4:-2] if style == "inner" else want
    assert np.abs(array(out) - want).max() < 1e-9 and [a.first for a in out.axes] == ([-2, 7] if style == "inner" else [-5, 3])
    part = filter_raster(r, k, by, roi={r.names[0]: (2, 20)})
    low = 2 - out.axes[0].first
    assert np.abs(array(part) - want[low : low + 19]).max() < 1e-9


def test_fourier_is_asked_for(spark):
    x, k = RNG.normal(size=(40, 45)), K.gaussian((2, 1))
    r = keyless(spark, x)
    assert np.abs(array(filter_raster(r, k, "reflect", algorithm="fft")) - array(filter_raster(r, k, "reflect", algorithm="fir"))).max() < 1e-9
    c = K.Kernel(RNG.normal(size=(5, 5)) + 1j * RNG.normal(size=(5, 5)), (2, 2))
    for source in (r, raster(spark, x)):
        a, b = (filter_raster(source, c, "circular", algorithm=m) for m in ("fft", "fir"))
        for part in ("v.re", "v.im"):
            assert np.abs(array(a, part) - array(b, part)).max() < 1e-9
    assert [smooth_size(n) for n in (1, 5, 7, 17, 65, 97, 130)] == [1, 6, 8, 18, 72, 108, 144]
    with pytest.raises(ValueError):
        filter_raster(r, k, algorithm="magic")


def test_missing_numbers(spark):
    x = RNG.normal(size=(30, 41))
    x[RNG.random(x.shape) < 0.3] = np.nan
    x[:12, :12] = np.nan
    k = K.Kernel(RNG.random((7, 7)), (3, 3))
    assert np.allclose(array(filter_raster(keyless(spark, x), k, NA())), array(filter_raster(raster(spark, x), k, NA(), algorithm="fir")), atol=1e-9, equal_nan=True)


def test_integers_stay_exact(spark):
    x = RNG.integers(-(2**45), 2**45, 900)
    w = RNG.integers(-99, 99, 41)
    out = filter_raster(keyless(spark, x, kind="long"), K.OneD(w, 20, 0, 1), Fill(0))
    assert dict(out.df.dtypes)["v"] == "bigint"
    p = np.pad(x, 20)
    assert [int(v) for v in array(out)] == [int((p[i : i + 41] * w).sum()) for i in range(900)] or out.df.where("v is null").count() == 0
    got = {r[0]: r[1] for r in out.df.collect()}
    assert got == {i: int((p[i : i + 41] * w).sum()) for i in range(900)}


@pytest.mark.parametrize("name", ["median", "lower_median", "quantile", "min", "max", "first", "nan_median"])
def test_windows(spark, name):
    x = np.round(RNG.normal(size=(35, 38)), 1)
    if name == "nan_median":
        x[RNG.random(x.shape) < 0.2] = np.nan
    for window in ((3, 5), (13, 11)):
        a = array(map_window(keyless(spark, x), name, window, "symmetric", q=0.3))
        b = array(map_window(raster(spark, x), name, window, "symmetric", q=0.3))
        assert np.allclose(a, b, equal_nan=True)
        v = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(w // 2, w // 2) for w in window], mode="symmetric"), window).reshape(*x.shape, -1)
        plain = {"median": np.median(v, -1), "lower_median": np.sort(v, -1)[..., (v.shape[-1] - 1) // 2], "quantile": np.quantile(v, 0.3, -1), "min": v.min(-1), "max": v.max(-1), "nan_median": np.nanmedian(v, -1)}
        assert name == "first" or np.allclose(a, plain[name], equal_nan=True)


def test_signals_without_a_key(spark):
    x = RNG.normal(size=1500)
    r = keyless(spark, x)
    for name, f in (("max", np.max), ("sum", np.sum), ("mean", np.mean), ("min", np.min)):
        out = map_window(r, name, (-3, 1), "circular")
        assert "SinglePartition" not in out.df._jdf.queryExecution().executedPlan().toString()
        v = np.lib.stride_tricks.sliding_window_view(np.pad(x, (3, 1), mode="wrap"), 5)
        assert np.abs(array(out) - f(v, -1)).max() < 1e-9
    assert np.abs(array(filter_raster(r, K.OneD(np.array([0.3, 0.4, 0.3]), 1, 0, 1))) - by_hand(x, np.array([0.3, 0.4, 0.3]), (1,), "edge")).max() < 1e-12
    ends = map_window(r, "max", range(2, 5), Inner())  # a window that begins after its centre
    assert array(ends).tolist() == [x[i + 2 : i + 5].max() for i in range(1496)]


@pytest.mark.parametrize("width", [1, 2, 7, 8, 9, 64, 70])
def test_widths(spark, width):
    x = RNG.normal(size=(3, 150))
    v = np.lib.stride_tricks.sliding_window_view(np.pad(x, [(0, 0), (width // 2, width - 1 - width // 2)], mode="edge"), (1, width)).reshape(3, 150, -1)
    r = raster(spark, x)
    assert np.array_equal(array(map_window(r, "max", (1, width), even=True)), v.max(-1)) and np.array_equal(array(map_window(r, "min", (1, width), even=True)), v.min(-1))
    assert np.abs(array(map_window(r, "mean", (1, width), even=True)) - v.mean(-1)).max() < 1e-12
    both = map_window(raster(spark, (x * 9).astype(int), kind="long"), "extrema", (1, width))
    w = np.trunc(v * 9)
    assert np.array_equal(array(both, "v.min"), w.min(-1)) and np.array_equal(array(both, "v.max"), w.max(-1))


def test_selection():
    for shape, sizes in (((50, 40), (9, 12)), ((900,), (77,)), ((12, 13, 14), (5, 4, 3))):
        x = np.round(RNG.normal(size=shape), 1)
        x.flat[::37] = np.nan
        v = np.sort(np.lib.stride_tricks.sliding_window_view(x, sizes).reshape(*(n - s + 1 for n, s in zip(shape, sizes)), -1), -1)
        for got, k in zip(select_ranks(x, sizes, [0, 20, v.shape[-1] - 1]), (0, 20, v.shape[-1] - 1)):
            assert np.array_equal(got, v[..., k], equal_nan=True)
        y = RNG.integers(-9, 9, shape)
        views = np.lib.stride_tricks.sliding_window_view(y, sizes)
        dims = tuple(range(y.ndim, 2 * y.ndim))
        assert np.array_equal(box_sums(y, sizes), views.sum(dims)) and np.array_equal(running(y, sizes, np.maximum), views.max(dims))
    assert np.isnan(window_results(np.full((20, 20), np.nan), "nan_median", [12, 12], None)).all()
    assert tile_sides((Axis("i", 0, 999), Axis("c", 0, 2)), ((1, 1), (0, 0)), 300) == [100, 3] and tile_sides((Axis("i", 0, 99), Axis("j", 0, 99)), ((40, 40), (0, 0)), 100) == [80, 10]


@pytest.mark.parametrize("by", ["replicate", Fill(2.0)])
def test_long_lines(spark, by):
    kernels = (K.iir_gaussian(3.0), K.recursive((0.4, 0.1, 0.05), 0.2, (0.2, 0.3, -0.1)))
    outside = 2.0 if isinstance(by, Fill) else None
    x = RNG.normal(size=(65, 2))
    for k in kernels:
        got = array(filter_raster(raster(spark, x, (7, 0)), (k, None), by))
        assert np.abs(got - fold_lines(x, k, outside)).max() < 1e-9
        for n in (17, 32, 33, 50):  # a last block of one sample, a full one, one more
            line = keyless(spark, x[:n, 0])
            assert np.abs(array(filter_raster(line, (k,), by)) - fold_lines(x[:n, :1], k, outside)[:, 0]).max() < 1e-9


def test_lines_of_many_lengths(spark):
    rows = [(u, int(t), float(v)) for u, n in (("a", 4), ("b", 40), ("c", 16)) for t, v in enumerate(RNG.normal(size=n))]
    r = Raster.from_sequences(spark.createDataFrame(rows, "u string, t int, v double"), "u", ["t"], "v")
    got = {(g.u, g.i): g.v for g in filter_raster(r, (K.iir_gaussian(2.0),), "replicate").df.collect()}
    for u in "abc":
        x = np.array([v for w, _, v in rows if w == u])
        assert max(abs(got[u, i] - y) for i, y in enumerate(fold_lines(x[:, None], K.iir_gaussian(2.0), None)[:, 0])) < 1e-9


def test_edges_of_unlike_recursions(spark):
    """The edge matrix stands for a line that goes on for ever."""
    k = K.recursive((0.5, -0.2, 0.1), 1.0, (0.3, 0.2, 0.05))
    x = RNG.normal(size=(12, 1))
    long = np.concatenate([x, np.full((400, 1), x[-1, 0])])
    assert np.abs(fold_lines(x, k, None) - fold_lines(long, k, None)[:12]).max() < 1e-9


@pytest.mark.parametrize("periodic", [True, False])
def test_denoising(spark, periodic, monkeypatch):
    from rastrum.operators import denoise

    x = RNG.normal(size=(33, 29))
    whole = array(denoise_tv(raster(spark, x), 0.2, 10, periodic), "v")
    one = array(denoise_tv(keyless(spark, x), 0.2, 10, periodic))
    monkeypatch.setattr(denoise, "PASS_ROUNDS", 4)
    some = array(denoise_tv(keyless(spark, x), 0.2, 10, periodic))
    assert np.abs(one - whole).max() < 1e-9 and np.abs(some - whole).max() < 1e-9
    colour = RNG.normal(size=(20, 17, 3))
    r = keyless(spark, colour)
    r = Raster(r.df.withColumnRenamed("i2", "c"), (), (*r.axes[:2], Axis("c", 0, 2)))
    keyed = raster(spark, colour)
    assert np.abs(array(denoise_tv(r, 0.1, 3, periodic, "c")) - array(denoise_tv(keyed, 0.1, 3, periodic, "i2"), )).max() < 1e-9


def test_extrema_and_blobs_without_a_key(spark):
    x = np.round(RNG.normal(size=(25, 31)), 1)
    x[4, 5] = np.nan
    found = find_local_maxima(keyless(spark, x), (3, 5))
    assert "Generate" not in found._jdf.queryExecution().executedPlan().toString()
    want = set()
    for i, j in np.ndindex(x.shape):
        around = [x[a, b] for a in range(max(0, i - 1), min(25, i + 2)) for b in range(max(0, j - 2), min(31, j + 3)) if (a, b) != (i, j)]
        if not np.isnan(x[i, j]) and all(x[i, j] > y for y in around):
            want.add((i, j))
    assert {(r.i0, r.i1) for r in found.collect()} == want
    y = np.zeros((40, 44))
    y[20, 22] = 1.0
    y = array(filter_raster(raster(spark, y), K.gaussian((2, 2)), Fill(0.0)))
    for scales in ([1.0, 2.0, 3.0],):
        a, b = ({tuple(round(z, 9) if isinstance(z, float) else z for z in (r.i0, r.i1, r.sigma[0], r.amplitude)) for r in blob_log(s, scales).collect()} for s in (keyless(spark, y), raster(spark, y)))
        assert a == b and any(t[:2] == (20, 22) for t in a)


def test_gaps_are_errors(spark):
    """A pixel without a row, or with two, is named by every operator; ``filled`` mends the former."""
    x = RNG.normal(size=(12, 13))
    for keyed in (True, False):
        full = raster(spark, x) if keyed else keyless(spark, x)
        hole = full.with_df(full.df.where("not (i0 = 5 and i1 = 6)"))
        line = full.with_df(full.df.where("i0 <> 11"))
        twice = full.with_df(full.df.unionAll(full.df.where("i0 = 5 and i1 = 6")))
        for bad in (hole, line, twice):
            for f in (
                lambda r: filter_raster(r, K.box(3, 3), "reflect").df, lambda r: filter_raster(r, K.Kernel(RNG.normal(size=(2, 3)), (0, 1))).df, lambda r: filter_raster(r, K.Laplacian()).df, lambda r: map_window(r, "median", (3, 3)).df,
                lambda r: map_window(r, "max", (3, 3), "circular").df, lambda r: map_window(r, "std", (3, 3), Inner()).df, lambda r: find_local_maxima(r), lambda r: denoise_tv(r, 0.1, 2).df, lambda r: filter_raster(r, K.Kernel(RNG.normal(size=(9, 9)), (4, 4))).df,
            ):
                with pytest.raises(Exception, match="one row for each"):
                    f(bad).collect()
        mended = array(filter_raster(hole.filled(0.0), K.box(3, 3), "reflect"))
        y = x.copy()
        y[5, 6] = 0
        assert np.abs(mended - by_hand(y, np.full((3, 3), 1 / 9), (1, 1), "reflect")).max() < 1e-12


def test_arrays_that_are_no_images(spark):
    rows = [(1, [float(k) for k in range(9)]), (2, None), (3, [1.0, None, *[float(k) for k in range(7)]])]
    r = Raster.from_array_column(spark.createDataFrame(rows, "k long, a array<double>"), "k", "a", (3, 3))
    by = {}
    for row in map_window(r, "median", (3, 3)).df.collect():
        by.setdefault(row.k, []).append(row.v)
    lines = {}
    for row in filter_raster(r, K.box(3, 1)).df.collect():
        lines.setdefault(row.k, []).append(row.v)
    assert set(by) == set(lines) == {1, 3} and len(by[3]) == 9 and any(np.isnan(v) for v in by[3]) and any(np.isnan(v) for v in lines[3]) and not any(np.isnan(v) for v in by[1])
    short = Raster.from_array_column(spark.createDataFrame([(1, [1.0] * 8)], "k long, a array<double>"), "k", "a", (3, 3))
    for f in (lambda: map_window(short, "median", (3, 3)).df, lambda: filter_raster(short, K.box(3, 3)).df):
        with pytest.raises(Exception, match="one row for each"):
            f().collect()


def test_types(spark):
    x = RNG.integers(-100, 100, (6, 7))
    kinds = {}
    for kind in ("boolean", "byte", "short", "int", "long", "float", "double", "decimal(6,2)"):
        r = raster(spark, x)
        r = r.with_df(r.df.withColumn("v", F.col("v").cast(kind)))
        for label, k in (("int", K.factored(np.array([1, 100, 1]), np.array([1]))), ("float", K.box(3, 1))):
            out = filter_raster(r, k, "replicate")
            kinds[kind, label] = dict(out.df.dtypes)["v"]
            y = (x != 0).astype(float) if kind == "boolean" else x
            w = np.array([[1], [100], [1]]) if label == "int" else np.full((3, 1), 1 / 3)
            assert np.abs(array(out) - by_hand(y, w, (1, 0), "edge")).max() < 1e-9  # a byte alone would overflow
    assert {kinds[k, "int"] for k in ("boolean", "byte", "short", "int", "long")} == {"bigint"} and {v for k, v in kinds.items() if k[1] == "float" or k[0][0] == "d"} == {"double"}
    assert dict(filter_raster(raster(spark, x, kind="short"), K.Laplacian(), Pad("circular")).df.dtypes)["v"] == "bigint"


def test_borders_sized_by_kernels():
    k = K.kernel_at(np.ones((4, 3)), (-2, 0))
    assert Pad("reflect").sized(k) == Pad("reflect", (2, 0), (1, 2)) and Fill(1).sized((k, k)) == Fill(1, (4, 0), (2, 4)) and Inner().sized(K.Laplacian()) == Inner((1, 1), (1, 1))


def test_windows_in_their_shape(spark):
    x = RNG.integers(-9, 9, (6, 7))
    for r in (raster(spark, x.astype(float)), keyless(spark, x.astype(float)), raster(spark, x, kind="long")):
        out = map_window(r, lambda w: float(w[0, -1] - w[-1, 0]), (3, 5), "symmetric", python=True, shaped=True)
        p = np.pad(x, ((1, 1), (2, 2)), mode="symmetric")
        assert np.array_equal(array(out), np.array([[p[i, j + 4] - p[i + 2, j] for j in range(7)] for i in range(6)]))
    kinds = {"bigint": lambda w: int(w.argmax()), "boolean": lambda w: bool(w[0] > 0), "string": lambda w: "a" if w[0] > 0 else "b", "array<double>": lambda w: np.sort(w) / 2}
    for kind, f in kinds.items():
        out = map_window(raster(spark, x.astype(float)), f, (3, 3), python=True, returns="auto")
        assert dict(out.df.dtypes)["v"] == kind and out.df.where("v is null").count() == 0
    with pytest.raises(ValueError):
        map_window(raster(spark, x), lambda w: {"a": 1}, (3, 3), python=True, returns="auto")


def test_lines_with_gaps(spark):
    rows = [(u, int(t), float(v)) for u in (1, 2) for t, v in zip(np.sort(RNG.choice(200, 40, replace=False)), RNG.normal(size=40))]
    r = Raster(spark.createDataFrame(rows, "u int, i int, v double"), ("u",), (Axis("i", 0, 199),))
    for name, f in (("sum", np.sum), ("max", np.max), ("count", len), ("min", np.min), ("mean", np.mean)):
        for row in sparse_window(r, name, -7, 3).df.collect():
            assert abs(row.v - f([v for u, t, v in rows if u == row.u and row.i - 7 <= t <= row.i + 3])) < 1e-9
    whole = r.filled(0.0)
    assert whole.df.count() == 400 and np.isclose(whole.df.agg(F.sum("v")).first()[0], sum(v for _, _, v in rows))
    with pytest.raises(ValueError):
        sparse_window(r, "median", -1, 1)


def test_images_of_another_size(spark, tmp_path):
    from rastrum.sources.tables import read_images, write_bitmaps

    df = spark.createDataFrame([(k, [k / 100] * 6) for k in range(5)], "k long, a array<double>")
    write_bitmaps(df, "k", "a", (2, 3), str(tmp_path / "a"))
    r = read_images(spark, str(tmp_path / "a"), 2, 3, 3)
    assert r.df.count() == 5 * 18 and {int(x.v) for x in r.df.select("v").distinct().collect()} == {128, 129, 130, 131, 132}
    with pytest.raises(Exception, match="is 2 x 3 x 3, not 2 x 2 x 3"):
        read_images(spark, str(tmp_path / "a"), 2, 2, 3).df.collect()
    assert read_images(spark, str(tmp_path / "a"), 2, 2, 3, others="skip").df.count() == 0


def test_bitmaps_are_written_by_many_tasks(spark, tmp_path):
    """A table in one partition, as small Parquet files are, doesn't leave all files to one task."""
    from rastrum.sources.tables import read_images, write_bitmaps

    df = spark.range(40).selectExpr("id as k", "array(0.1, 0.2, 0.3, 0.4) as a").coalesce(1)
    write_bitmaps(df, "k", "a", (2, 2), str(tmp_path / "a"))
    files = [p.name for p in (tmp_path / "a").glob("k=*/part-*.txt")]
    assert len(files) == 40 and len({f.split("-")[1] for f in files}) > 1
    assert read_images(spark, str(tmp_path / "a"), 2, 2, 3).df.count() == 40 * 12


def test_image_folders_are_listed_by_few_tasks(spark, tmp_path):
    from rastrum.sources.tables import read_images, write_bitmaps

    sc = spark.sparkContext
    most = 4 * sc.defaultParallelism
    n, name = most + 40, "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    df = spark.createDataFrame([(k, [0.1 * k] * 4) for k in range(n)], "k long, a array<double>")
    write_bitmaps(df, "k", "a", (2, 2), str(tmp_path / "a"))
    before = spark.conf.get(name, None)
    sc.setJobGroup("listing", "listing")
    r = read_images(spark, str(tmp_path / "a"), 2, 2, 3)
    sc.setLocalProperty("spark.jobGroup.id", None)
    status = sc.statusTracker()
    stages = [status.getStageInfo(s) for j in status.getJobIdsForGroup("listing") for s in status.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages if s) <= most
    assert spark.conf.get(name, None) == before and r.df.count() == n * 12
