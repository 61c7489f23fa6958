import numpy as np
import pytest

from rastrum import NA, Fill, Inner, Kernel, OneD, Pad, blob_log, convolve_kernels, denoise_tv, factored, filter_raster, find_local_maxima, gradients, iir_gaussian, map_window, pad_raster
from rastrum.functions import kernels as K
from rastrum.operators.denoise import tv_step_images
from rastrum.operators.recursive import fold_lines
from tests.rasters import array, raster

MODES = {"replicate": "edge", "circular": "wrap", "symmetric": "symmetric", "reflect": "reflect"}


@pytest.mark.parametrize("style", MODES)
def test_padding_styles_also_beyond_the_image(spark, style):
    image = np.arange(1, 26).reshape(5, 5).T
    assert (array(pad_raster(raster(spark, image), Pad(style, (2, 2)))) == np.pad(image, 2, mode=MODES[style])).all()
    small = np.array([[1, 2], [3, 4]])
    assert (array(pad_raster(raster(spark, small), Pad(style, (3, 3), (1, 4)))) == np.pad(small, ((3, 1), (3, 4)), mode=MODES[style])).all()


def test_padding_keeps_indices_types_and_rejects_bad_sizes(spark):
    image = np.arange(4).reshape(2, 2)
    r = pad_raster(raster(spark, image, first=(-1, 5)), Fill(9, (1, 0), (0, 2)))
    assert [(a.first, a.last) for a in r.axes] == [(-2, 0), (5, 8)]
    assert (array(r) == np.pad(image, ((1, 0), (0, 2)), constant_values=9)).all()
    assert array(pad_raster(raster(spark, [["a", "b"], ["c", "d"]], kind="string"), Pad("symmetric", (1, 0))))[0, 0] == "a"
    with pytest.raises(ValueError):
        pad_raster(raster(spark, image), Pad("replicate", (1,)))
    with pytest.raises(ValueError):
        pad_raster(raster(spark, [[1.0, 2.0]]), Pad("reflect", (1, 0)))
    with pytest.raises(ValueError):
        Pad("inner")
    assert (array(pad_raster(raster(spark, image), Inner())) == image).all()


def test_cascade_is_padded_once(spark):
    k1, k2 = OneD(np.array([0.25, 0.5, 0.25]), 1, 0, 1), OneD(np.array([0.5, 0.5]), -1, 0, 1)
    r = raster(spark, np.arange(1, 9))
    assert np.allclose(array(filter_raster(r, k1)), [1.25, 2, 3, 4, 5, 6, 7, 7.75])
    whole = convolve_kernels(k1.dense(), k2.dense(), k1.dense())
    assert np.allclose(array(filter_raster(r, (k1, k2, k1))), array(filter_raster(r, (whole,))))
    fill = Fill(10.0)
    ones = raster(spark, np.ones(15))
    assert np.allclose(array(filter_raster(ones, ([1.0, 1, 1], [1.0, 1, 1]), fill)), array(filter_raster(ones, [1.0, 2, 3, 2, 1], fill)))


def test_missing_values(spark):
    third = np.ones(3) / 3
    assert np.allclose(array(filter_raster(raster(spark, np.arange(1, 11)), third, NA())), [1.5, *range(2, 10), 9.5])
    x = np.array([1, np.nan, np.inf, 0, -np.inf, np.inf, np.nan, np.nan, 1])
    k = Kernel(np.ones(2), (0,))
    assert np.array_equal(array(filter_raster(raster(spark, x), k, NA())), [1, np.inf, np.inf, -np.inf, np.nan, np.inf, np.nan, 1, 1], equal_nan=True)


def test_exact_integers_overflow_copies_and_errors(spark):
    r = raster(spark, [200, 100, 3], kind="long")
    assert array(filter_raster(r, np.array([1, 2, 1]))).tolist() == [700, 403, 109]
    with pytest.raises(Exception, match="OVERFLOW"):
        filter_raster(r, np.array([1000, 2, 1]), dtype="short").df.collect()
    assert array(filter_raster(r, ())).tolist() == [200, 100, 3] and array(filter_raster(r, np.array([1]))).tolist() == [200, 100, 3]
    with pytest.raises(ValueError):
        filter_raster(r, np.ones((3, 3)))
    with pytest.raises(ValueError):
        filter_raster(raster(spark, np.ones((4, 4))), K.gaussian(1), Fill(0, (1, 1)))
    with pytest.raises(ValueError):
        filter_raster(r, np.ones(3), roi={"i0": (0, 7)})


def test_inner_roi_and_fourier_agree_with_direct(spark):
    rng = np.random.default_rng(1)
    image = rng.normal(size=(7, 9))
    r = raster(spark, image, first=(1, -4))
    k = Kernel(rng.normal(size=(3, 2)), (0, 1))
    for by in (*MODES, Fill(2.0), Inner(), NA()):
        a, b = filter_raster(r, k, by), filter_raster(r, k, by, algorithm="fft")
        assert a.axes == b.axes
        assert np.allclose(array(a), array(b))
    part = filter_raster(r, k, "circular", roi={"i0": (2, 4)})
    assert np.allclose(array(part), array(filter_raster(r, k, "circular"))[1:4])
    bad = image.copy()
    bad[3, 4] = np.nan
    assert np.isnan(array(filter_raster(raster(spark, bad), K.box(3, 3), algorithm="fft"))).sum() == 9


def test_three_dimensions(spark):
    out = array(filter_raster(raster(spark, np.ones((4, 4, 4))), K.box(3, 3, 3), Fill(0.0)))
    assert np.isclose(out[0, 0, 0], (2 / 3) ** 3) and np.isclose(out[1, 1, 1], 1)


def test_kernels():
    for k in (K.gaussian((1, 2)), K.box(3, 5)):
        assert np.isclose(K.outer(k).weights.sum(), 1)
    assert abs(K.dog(1).weights.sum()) < 1e-12
    assert np.allclose(K.laplacian2d(0.5).weights, np.array([[1, 1, 1], [1, -8, 1], [1, 1, 1]]) / 3)
    assert K.Laplacian((True, False)).dense().weights.ravel().tolist() == [1, -2, 1]
    assert K.moffat(1.0, 2.5).weights.shape == (7, 7) or K.moffat(1.0, 2.5).weights.shape[0] % 2
    with pytest.raises(ValueError):
        K.box(2)
    with pytest.raises(ValueError):
        K.gabor(3, 3, -1, 0, 1, 1, 0)
    ramp = np.arange(9.0)[:, None] + np.zeros((9, 9))
    for name in K.GRADIENTS:
        for k in (K.gradient_dense(name, 0), K.outer(K.gradient_kernel(name, (True, True), 0))):
            taps = [(at, w) for at, w in k.taps()]
            assert abs(sum(ramp[4 + at[0], 4 + at[1]] * w for at, w in taps) - 1) < 1e-4
    k = K.gaussian_1d(1.0, 5)
    back = K.spectrum_kernel(K.kernel_spectrum(K.centered(k), (16,)), [(-2, 2)])
    assert np.allclose(back.weights, k) and np.allclose(K.spectrum_kernel(K.kernel_spectrum(K.centered(k), (16,), True), [(-2, 2)], 16).weights, k)
    assert np.allclose(K.reflect(K.kernel_at([1, 2, 3], (1,))).weights, [3, 2, 1]) and K.reflect(K.kernel_at([1, 2, 3], (1,))).reach() == ((-3, -1),)
    a, b = factored([1.0, 2], [3.0, 4, 5])
    assert a.dense().weights.shape == (2, 1) and b.reach() == ((0, 0), (-1, 1))


def test_recursive_gaussian():
    for sigma in (3.1, 10.0, 50.0):
        k = iir_gaussian(sigma)
        a, b, m = k.forward, k.backward, k.edge
        shift = lambda c: np.array([list(c), [1, 0, 0], [0, 1, 0]])
        e = np.zeros((3, 3))
        e[0, 0] = 1
        assert np.allclose(m, e + shift(b) @ m @ shift(a), atol=1e-8)
        x = np.zeros(1000)
        x[400] = 1
        true = np.exp(-((np.arange(1000) - 400) ** 2) / (2 * sigma**2)) / (sigma * np.sqrt(2 * np.pi))
        assert np.linalg.norm(fold_lines(x, k, 0.0) - true) / np.linalg.norm(true) < 0.1
        assert np.allclose(fold_lines(np.full(20, 3.0), k, None), 3)
    with pytest.raises(ValueError):
        fold_lines(np.ones(3), iir_gaussian(2.0), None)
    with pytest.warns(UserWarning):
        iir_gaussian(0.5)
    assert iir_gaussian(0) is None


def test_windows(spark):
    x = [0.1, 0.3, 0.2, 0.3, 0.4]
    r = raster(spark, x)
    low, high = (array(map_window(r, name, 2, even=True)).tolist() for name in ("min", "max"))
    assert low == [0.1, 0.1, 0.2, 0.2, 0.3] and high == [0.1, 0.3, 0.3, 0.3, 0.4]
    assert array(map_window(raster(spark, [1, 100, 1, 2, -1000, 2]), "median", 3)).tolist() == [1, 1, 2, 1, 2, 2]
    with pytest.raises(ValueError):
        map_window(r, "median", 2)
    with pytest.raises(ValueError):
        map_window(r, "median", (3, 3))
    image = np.random.default_rng(3).normal(size=(6, 7))
    mean = array(map_window(raster(spark, image), "mean", (3, 3), "reflect"))
    own = array(map_window(raster(spark, image), np.mean, (3, 3), "reflect", python=True))
    assert np.allclose(mean, own)
    inner = map_window(raster(spark, 10 * np.arange(1, 11), first=(1,)), "max", 3, Inner())
    assert (inner.axes[0].first, inner.axes[0].last) == (2, 9) and array(inner).tolist() == [10.0 * k for k in range(3, 11)]
    picked = map_window(raster(spark, np.arange(10.0)), "sum", 3, indices={"i0": range(1, 10, 4)})
    assert array(picked).tolist() == [3, 15, 26]
    first = array(map_window(raster(spark, np.arange(6).reshape(2, 3)), "first", (1, 3)))
    assert first.tolist() == [[0, 0, 1], [3, 3, 4]]


def test_gradients_on_ramps_and_thin_images(spark):
    image = np.arange(5.0)[:, None] * 2 + np.arange(7.0)
    g = gradients(raster(spark, image), "sobel")
    assert np.allclose(array(g, "g1")[1:-1, 1:-1], 2) and np.allclose(array(g, "g2")[1:-1, 1:-1], 1)
    thin = gradients(raster(spark, np.arange(5.0)[:, None]), "prewitt")
    assert np.allclose(array(thin, "g1")[1:-1, 0], 1) and np.allclose(array(thin, "g2")[1:-1, 0], [1, 2, 3])


def test_local_maxima_and_blobs(spark):
    image = np.zeros((9, 9))
    image[[0, 1, 4], 4] = [1, 1, 1]
    found = find_local_maxima(raster(spark, image)).toPandas()
    assert found[["i0", "i1"]].values.tolist() == [[4, 4]]
    flat = raster(spark, np.array([1.0, np.nan, 3, 2, 5]))
    assert sorted(find_local_maxima(flat).toPandas()["i0"]) == [4]
    assert find_local_maxima(flat, edges=False).count() == 0
    spot = np.zeros((9, 9))
    spot[4, 4] = 1
    blob = blob_log(raster(spark, spot), [2**0.5, 1, 2]).toPandas()
    assert len(blob) == 1 and list(blob["sigma"][0]) == [1, 1] and np.isclose(blob["amplitude"][0], 1 / np.pi)


def test_denoising(spark):
    rng = np.random.default_rng(2)
    clean = np.zeros((16, 16))
    clean[4:12, 4:12] = 1
    noisy = clean + rng.normal(0, 0.1, clean.shape)
    for periodic in (True, False):
        out = tv_step_images(noisy, 0.1, 20, periodic)
        assert ((out - clean) ** 2).mean() < ((noisy - clean) ** 2).mean() / 3 and np.isclose(out.mean(), noisy.mean())
        assert np.allclose(tv_step_images(np.full((5, 5), 2.0), 0.1, 5, periodic), 2)
    assert np.allclose(array(denoise_tv(raster(spark, noisy), 0.1, 5)), tv_step_images(noisy, 0.1, 5))


def test_one_exchange_for_a_separable_filter_of_many_images(spark):
    from rastrum.sources.tables import img8

    df = filter_raster(img8(spark, "/root/testdata/sf0.001"), K.gaussian((1, 1))).df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "Join" not in plan


@pytest.mark.parametrize("style", ["circular", "symmetric"])
def test_windows_with_local_borders(spark, style):
    image = np.random.default_rng(5).normal(size=(5, 6))
    span = ((-1, 1), (-3, 1))

    def sources(n, at, low, high):
        first, last = max(0, at + low), min(n - 1, at + high)
        line = np.pad(np.arange(first, last + 1), (first - at - low, at + high - last), mode=MODES[style])
        return line

    wanted = [[image[np.ix_(sources(5, i, *span[0]), sources(6, j, *span[1]))] for j in range(6)] for i in range(5)]
    r = raster(spark, image)
    for name, f in {"sum": np.sum, "max": np.max, "first": lambda w: w[0, 0], "median": np.median}.items():
        got = array(map_window(r, name, span, style, local_border=True))
        assert np.allclose(got, [[f(w) for w in row] for row in wanted])
    with pytest.raises(ValueError):
        map_window(r, "sum", 3, Fill(0.0), local_border=True)
