"""Cascades with recursions, automatic choices, colours, complex kernels, grids, plans."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from rastrum import Axis, Fill, Inner, Kernel, OneD, Raster, blob_log, denoise_tv, filter_raster, find_local_maxima, gradients, iir_gaussian, map_window, pad_raster
from rastrum.functions import kernels as K
from rastrum.operators.denoise import tv_step_images
from rastrum.operators.recursive import fold_lines
from rastrum.plans.strategy import by_fourier, factors_of
from rastrum.sources.tables import img8, shipments
from tests.rasters import array, raster

SMALL = "/root/testdata/sf0.001"


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("by", ["replicate", Fill(0.0), Fill(2.5)])
def test_recursions_and_boxes_commute(spark, by):
    r = raster(spark, np.arange(1.0, 9))
    box = OneD(np.ones(3) / 3, 1, 0, 1)
    first, last = (array(filter_raster(r, stages, by)) for stages in ((iir_gaussian(2.0), box), (box, iir_gaussian(2.0))))
    assert np.allclose(first, last, atol=1e-6)
    outside = 1.0 if by == "replicate" else by.value
    wide = np.concatenate([np.full(200, outside), np.arange(1.0, 9), np.full(200, 8.0 if by == "replicate" else by.value)])
    smooth = fold_lines(wide, iir_gaussian(2.0), None)
    assert np.allclose(first, np.convolve(smooth, np.ones(3) / 3, "same")[200:208], atol=1e-5)


@pytest.mark.parametrize("sigma", [3.1, 5, 10.0, 20, 50.0, 100.0])
def test_impulses_at_many_places(sigma):
    k = iir_gaussian(sigma)
    for at in (0, 1, 2, 3, 5, 10, 100, 500, 900, 989, 994, 998, 999):
        x = np.zeros(1000)
        x[at] = 1
        true = np.exp(-((np.arange(1000) - at) ** 2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi))
        assert np.linalg.norm(fold_lines(x, k, 0.0) - true) / np.linalg.norm(true) < 0.1


def test_wide_kernels_of_finite_images_go_by_fourier(spark):
    rng = np.random.default_rng(1)
    image, k = rng.normal(size=(9, 11)), K.centered(rng.normal(size=(7, 7)))
    r = raster(spark, image)
    assert by_fourier(r, factors_of(k, 2)) and not by_fourier(r, factors_of(K.gaussian(1), 2)) and not by_fourier(raster(spark, image.round(), kind="long"), factors_of(k, 2))
    assert "MapInArrow" in plan_of(filter_raster(r, k).df)
    for by in ("replicate", "reflect", Fill(1.0), Inner()):
        assert np.allclose(array(filter_raster(r, k, by)), array(filter_raster(r, k, by, algorithm="fir")))
    line = np.arange(100.0)
    line[50] = np.nan
    out = array(filter_raster(raster(spark, line), np.ones(31) / 31))
    assert np.isnan(out).sum() == 31 and np.isfinite(out[[0, 99]]).all()


def test_complex_kernels(spark):
    rng = np.random.default_rng(2)
    image, w = rng.normal(size=(5, 6)), rng.normal(size=(3, 3)) + 1j * rng.normal(size=(3, 3))
    out = filter_raster(raster(spark, image), K.centered(w), "circular")
    for part, weights in (("re", w.real), ("im", w.imag)):
        assert np.allclose(array(out, f"v.{part}"), array(filter_raster(raster(spark, image), K.centered(weights), "circular")))


def test_kernels_are_equal_by_value():
    a, b = K.gaussian((1, 2)), K.gaussian((1, 2))
    assert a == b and len({*a, *b}) == 2 and K.dog(1) == K.dog(1) and K.dog(1) != K.dog(2) and iir_gaussian(2.0) == iir_gaussian(2.0)
    assert K.Laplacian() != K.Laplacian((True, False)) and Kernel(np.ones(3), (1,)) != Kernel(np.ones(3), (0,)) and a[0] != a[0].dense()


def psnr(x, clean):
    return 10 * np.log10(1 / ((x - clean) ** 2).mean())


def scene(shape):
    grid = np.meshgrid(*[np.linspace(0, 1, s) for s in shape], indexing="ij")
    inside = sum((g - 0.5) ** 2 for g in grid) < 0.08
    return 0.2 + 0.6 * inside + 0.1 * (grid[0] > 0.7)


@pytest.mark.parametrize(("shape", "channels", "lam", "least"), [((96, 96), 0, 0.05, 31.67), ((96, 96), 3, 0.03, 32.15), ((24, 24, 24), 0, 0.02, 31.78), ((24, 24, 24), 3, 0.02, 31.17)])
def test_denoising_reaches_the_published_ratios(shape, channels, lam, least):
    clean = scene(shape)
    clean = np.stack([clean, 1 - clean, clean / 2], -1) if channels else clean
    noisy = clean + np.random.default_rng(7).normal(0, 0.05, clean.shape)
    out = tv_step_images(noisy, lam, 20, channel=clean.ndim - 1 if channels else None)
    assert psnr(out, clean) > max(least, psnr(noisy, clean) + 3)


def test_colours_share_one_norm(spark):
    x = np.random.default_rng(3).normal(size=(6, 5, 3))
    r = raster(spark, x)
    assert np.allclose(array(denoise_tv(r, 0.1, 4, channel="i2")), tv_step_images(x, 0.1, 4, channel=2))
    grey = x[..., :1]
    assert np.allclose(tv_step_images(grey, 0.1, 4, channel=2)[..., 0], tv_step_images(grey[..., 0], 0.1, 4))
    turned = tv_step_images(np.moveaxis(x, 2, 0), 0.1, 4, channel=0)
    assert np.allclose(np.moveaxis(turned, 0, 2), tv_step_images(x, 0.1, 4, channel=2))


def test_extrema_leave_the_channel_axis_alone_and_blobs_have_radii(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0, 5.0, 1.0, 0.0, 0.0])], "image long, data array<double>")
    r = Raster.from_array_column(df, "image", "data", (3, 2), names=("i", "c"))
    assert sorted((x.i, x.c) for x in find_local_maxima(r).collect()) == [(1, 0), (1, 1)]
    spot = np.zeros((9, 9))
    spot[4, 4] = 1
    blob = blob_log(raster(spark, spot), [1, 2]).first()
    assert np.allclose(blob.radius, np.sqrt(2) * np.array(blob.sigma))
    whole = raster(spark, spot)
    single = Raster(whole.df.drop("image"), (), whole.axes)
    assert np.isclose(blob_log(single, [1, 2]).first().amplitude, blob.amplitude)


def test_windows_by_image_agree_with_aggregates(spark):
    image = np.random.default_rng(4).normal(size=(7, 6))
    r = raster(spark, image, first=(2, -1))
    single = Raster(r.df.drop("image"), (), r.axes)
    for name, by in (("median", "reflect"), ("quantile", "circular"), ("first", "symmetric"), ("std", "replicate"), ("lower_median", Fill(0.5)), ("median", Inner()), ("first", "replicate")):
        for window in ((3, 5), ((-1, 1), (1, 2))):
            a, b = (map_window(x, name, window, by, q=0.3) for x in (r, single))
            assert a.axes == b.axes and np.allclose(array(a), array(b))


def test_grids_come_from_the_data_and_refuse_rows_outside(spark):
    rows = spark.createDataFrame([(1, 2), (3, 2), (None, 1)], "i int, j int")
    r = Raster.from_counts(rows, (), (Axis("i", 1, 3), Axis("j", 2, 2)), F.count("*"))
    assert array(r).ravel().tolist() == [1, 0, 1]
    with pytest.raises(Exception, match="outside axis i"):
        Raster.from_counts(rows, (), (Axis("i", 1, 2), Axis("j", 2, 2)), F.count("*")).df.collect()
    assert shipments(spark, SMALL).df.agg(F.sum("v")).first()[0] == spark.read.parquet(f"{SMALL}/lineitem.parquet").count()


def test_fill_builds_the_rim_only(spark):
    image = np.arange(24.0).reshape(2, 3, 4)
    out = pad_raster(raster(spark, image), Fill(-1.0, (1, 0, 2), (0, 2, 1)))
    assert (array(out) == np.pad(image, ((1, 0), (0, 2), (2, 1)), constant_values=-1)).all()


def test_one_exchange_for_gradients_and_none_for_whole_images(spark):
    plan = plan_of(gradients(img8(spark, SMALL), "sobel").df)
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan
    assert "Exchange" not in plan_of(map_window(img8(spark, SMALL), "median", (3, 5)).df)
