import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lumenframe.functions import kernels
from lumenframe.functions.draws import Draws

RNG = np.random.default_rng(0)


@given(st.integers(1, 9), st.integers(-40, 40))
def test_fold_agrees_with_padding(n, i):
    a = np.arange(n)
    for mode, name in (("reflect", "symmetric"), ("nearest", "edge"), ("wrap", "wrap")):
        assert kernels.fold(np.array([i]), n, mode)[0] == np.pad(a, 40, mode=name)[40 + i]
    if n > 1:
        assert kernels.fold(np.array([i]), n, "mirror")[0] == np.pad(a, 40, mode="reflect")[40 + i]


@pytest.mark.parametrize("sigma,shape", [(0.7, (9,)), (1.3, (12, 7)), (3.0, (6, 5, 4)), (1.0, (150, 3))])
def test_gaussian_is_a_padded_convolution(sigma, shape):
    a, radius = RNG.random(shape), int(4 * sigma + 0.5)
    x = np.arange(-radius, radius + 1)
    g = np.exp(-0.5 * (x / sigma) ** 2) / np.exp(-0.5 * (x / sigma) ** 2).sum()
    want = a
    for axis in range(a.ndim):
        wide = np.pad(want, [(radius, radius) if k == axis else (0, 0) for k in range(a.ndim)], mode="symmetric")
        want = np.apply_along_axis(lambda v: np.convolve(v, g, "valid"), axis, wide)
    got = kernels.gaussian(a, sigma)
    assert np.allclose(got, want) and np.isclose(got.sum(), a.sum())


def test_gaussian_derivative_of_a_line_is_its_slope():
    a = np.tile(np.arange(60.0) * 2, (3, 1))
    assert np.allclose(kernels.filtered(a, kernels.gaussian_weights(1.0, 1), 1)[:, 10:50], 2, atol=1e-3)


@pytest.mark.parametrize("order", range(6))
@pytest.mark.parametrize("mode", kernels.MODES)
def test_splines_pass_through_the_voxels(order, mode):
    a = RNG.random((7, 9))
    assert np.allclose(kernels.sample(a, kernels.grid(a.shape), order, mode), a)


@pytest.mark.parametrize("order", [2, 3, 4, 5])
def test_splines_reproduce_a_cosine(order):
    n = 40
    a = np.cos(np.arange(n) / 5)
    at = np.linspace(8, 30, 50)
    assert np.abs(kernels.sample(a, [at], order, "mirror") - np.cos(at / 5)).max() < 1e-3


def test_constant_mode_has_its_value_outside_and_order_0_keeps_the_type():
    a = np.arange(4, dtype=np.int32)
    got = kernels.sample(a, [np.array([-0.1, 0.4, 2.5, 3.01])], 0, "constant", 0)
    assert got.tolist() == [0, 0, 3, 0] and got.dtype == np.int32
    assert kernels.sample(a, [np.array([-0.1, 1.5])], 1, "constant", 9.0).tolist() == [9.0, 1.5]


def test_zoom_keeps_corners_and_sizes():
    a = RNG.random((5, 6, 7))
    got = kernels.zoom(a, (9, 6, 3), 1, "reflect")
    assert got.shape == (9, 6, 3) and np.allclose(got[::2, :, ::2], a[:, :, [0, 6]][:, :, [0, 1]]) and np.allclose(got[::2, :, 1], a[:, :, 3])


def test_median_is_that_of_the_neighbours():
    a = RNG.random((5, 6))
    wide = np.pad(a, 1, mode="symmetric")
    want = [[np.median(wide[i : i + 3, j : j + 3]) for j in range(6)] for i in range(5)]
    assert np.allclose(kernels.median(a, 3), want)


@settings(max_examples=20)
@given(st.integers(0, 10**6), st.text(min_size=1, max_size=5))
def test_draws_depend_on_their_key_alone(seed, name):
    d = Draws(seed, "0", 7)
    assert d.unit(name) == Draws(seed, "0", 7).unit(name) and 0 < d.unit(name) < 1
    assert (d.field(name, (3, 4)) == Draws(seed, "0", 7).field(name, (12,)).reshape(3, 4)).all()
    assert sorted(d.choose(name, 6, 6)) == list(range(6)) and 2 <= d.integer(name, (2, 4)) <= 4


def test_fields_look_uniform_and_normal():
    d = Draws(1, "0", 1)
    u, z = d.field("u", (100_000,)), d.normal("z", (100_000,))
    assert abs(u.mean() - 0.5) < 0.005 and abs(np.histogram(u, 20, (0, 1))[0] / 5000 - 1).max() < 0.08
    assert abs(z.mean()) < 0.015 and abs(z.std() - 1) < 0.01 and abs(np.corrcoef(z[1:], z[:-1])[0, 1]) < 0.015
