import numpy as np
import pytest

from lumenframe import operators as o
from lumenframe.functions.draws import Draws
from lumenframe.plans.node import REGISTRY, from_dict, from_json, from_yaml, to_json, to_yaml
from lumenframe.plans.sample import Sample

RNG = np.random.default_rng(1)
INTENSITY = ("GaussianNoise RicianNoise GammaCorrection BiasField WindowLevel BrightnessContrast GaussianBlur SimulateLowResolution MedianBlur Sharpen CLAHEContrast HistogramMatch GhostingArtifact KSpaceDropout MRIMotion BeamHardening MetalStreak ScatterSimulation GridArtifact LimitedAngleBlur ReconStreak").split()
ONLY_3D = "SlabShift LimitedAngleBlur SliceDropout AnisotropicElastic CompressionVariation ReconStreak".split()
LEAVES = [n for n in REGISTRY if n not in ("Compose", "OneOf", "SomeOf", "Guard")]


def volume(shape=(6, 12, 10), dtype=np.float32, **fields):
    image = RNG.random(shape).astype(dtype)
    return Sample(image, (image > 0.6).astype(np.int32), (1.0,) * len(shape), {}, **fields)


def made(name, ndim=3, **more):
    own = {"size": (4,) * ndim} if name in ("AnatomicCrop", "CenterCrop", "Pad", "Resize") else {"reference": [[0.0, 1.0, 4.0]]} if name == "HistogramMatch" else {}
    return getattr(o, name)(**own, **more)


def test_registry_has_all_operators():
    assert len(REGISTRY) == 37 and len(LEAVES) == 33


@pytest.mark.parametrize("name", LEAVES)
@pytest.mark.parametrize("shape", [(12, 10), (6, 12, 10)])
def test_each_operator(name, shape):
    v, t = volume(shape), made(name, len(shape))
    if len(shape) == 2 and name in ONLY_3D:
        with pytest.raises(ValueError):
            t(v)
        return
    before = v.image.copy()
    out, again = t(v, Draws(5, "0", 1)), made(name, len(shape))(v, Draws(5, "0", 1))
    assert out.image.dtype == np.float32 and np.isfinite(out.image).all() and (out.image == again.image).all() and (v.image == before).all()
    assert out.mask.shape == out.image.shape and out.mask.dtype == np.int32
    if name in INTENSITY:
        assert (out.mask == v.mask).all() and out.shape == v.shape
    assert made(name, len(shape), p=0.0)(v) is v


@pytest.mark.parametrize("name", LEAVES)
def test_each_operator_comes_back_from_its_dict(name):
    t = made(name, p=0.25)
    for back in (from_dict(t.to_dict()), from_json(to_json(t)), from_yaml(to_yaml(t))):
        assert back.to_dict() == t.to_dict() and back.p == 0.25


@pytest.mark.parametrize("make", [
    lambda: o.RandomFlip(p=1.5), lambda: o.RandomFlip(p_per_axis=2), lambda: o.RandomFlip(axes=("z",))(volume((4, 4))), lambda: o.RandomAffine(rotation=(5, 1)), lambda: o.RandomAffine(order=6), lambda: o.AnatomicCrop(size=(2, 2), foreground_prob=2),
    lambda: o.CenterCrop(size=(0, 2)), lambda: o.CenterCrop(size=(2, 2))(volume()), lambda: o.Resize(size=(2, 2), order=4), lambda: o.ElasticDeform(order=4), lambda: o.ElasticDeform(alpha=(1, 2))(volume()), lambda: o.CoarseDropout(hole_size=(0, 0.5)),
    lambda: o.CoarseDropout(num_holes=(3, 1)), lambda: o.GaussianNoise(std=-1), lambda: o.RicianNoise(std=(2, 1)), lambda: o.GammaCorrection(gamma=(0, 1)), lambda: o.BiasField(alpha=-1), lambda: o.BiasField(coarse_shape=(2, 2))(volume()),
    lambda: o.WindowLevel(width_scale=(0, 1)), lambda: o.BrightnessContrast(contrast=(0, 1)), lambda: o.GaussianBlur(sigma=-1), lambda: o.GaussianBlur(order=4), lambda: o.SimulateLowResolution(zoom_range=(0.5, 2)), lambda: o.MedianBlur(ksize=4),
    lambda: o.Sharpen(sigma=0), lambda: o.CLAHEContrast(grid=(0, 1)), lambda: o.CLAHEContrast(n_bins=1), lambda: o.HistogramMatch(blend=2), lambda: o.GhostingArtifact(phase_encode_axis="z"), lambda: o.GhostingArtifact(num_ghosts=0),
    lambda: o.KSpaceDropout(dropout_fraction=2), lambda: o.MRIMotion(degrees=-1), lambda: o.MRIMotion(num_movements=0), lambda: o.BeamHardening(power=0), lambda: o.MetalStreak(falloff=0), lambda: o.ScatterSimulation(sigma=0), lambda: o.GridArtifact(frequency=0),
    lambda: o.SlabShift(max_shift=(2, 1)), lambda: o.LimitedAngleBlur(arc_degrees=0), lambda: o.SliceDropout(num_slices=-1), lambda: o.AnisotropicElastic(alpha=(1, 2)), lambda: o.CompressionVariation(scale=0), lambda: o.ReconStreak(decay=0),
])
def test_bad_parameters(make):
    with pytest.raises(ValueError):
        make()


def test_unknown_parameters():
    with pytest.raises(TypeError):
        o.RandomFlip(colour=1)
    with pytest.raises(TypeError):
        o.CenterCrop()


@pytest.mark.parametrize("t", [o.RandomFlip(axes=("x", "y"), p_per_axis=1.0), o.CenterCrop(size=(20, 18)), o.Pad(size=(40, 30)), o.Resize(size=(48, 64)), o.RandomAffine(rotation=20, translation=0.1), o.ElasticDeform(alpha=8.0, sigma=3.0), o.AnatomicCrop(size=(20, 20), foreground_prob=1.0)])
@pytest.mark.parametrize("seed", range(5))
def test_a_bright_spot_goes_with_its_point(t, seed):
    y, x = np.mgrid[:32, :32]
    image = np.exp(-((y - 15) ** 2 + (x - 17) ** 2) / 4.0)
    v = Sample(image, (image > 0.3).astype(np.int32), (1.0, 1.0), {}, np.array([[15.0, 17.0]]), ("a",), np.array([[14.0, 16.0]]), np.array([[16.0, 18.0]]), ("b",))
    out = t(v, Draws(seed, "0", 1))
    if out.image.max() < 0.7:
        return
    at = np.unravel_index(out.image.argmax(), out.shape)
    assert np.abs(np.array(at) - out.points[0]).max() <= 2 and out.mask[at] == 1
    assert (out.lows[0] <= out.points[0] + 1e-9).all() and (out.highs[0] >= out.points[0] - 1e-9).all()


def test_identities():
    v = volume()
    flip = o.RandomFlip(axes=("x", "y", "z"), p_per_axis=1.0)
    assert (flip(flip(v)).image == v.image).all()
    assert np.allclose(o.CenterCrop(size=v.shape)(o.Pad(size=(9, 15, 20))(v)).image, v.image)
    assert np.allclose(o.GammaCorrection(gamma=1.0)(v).image, v.image, atol=1e-6)
    assert o.GaussianBlur(sigma=0.0)(v) is v and o.MedianBlur(ksize=1)(v) is v and o.HistogramMatch()(v) is v and o.Resize(size=v.shape)(v) is v
    flat = Sample(np.full((5, 5), 0.3), None, (1.0, 1.0))
    assert o.GammaCorrection()(flat) is flat and o.CLAHEContrast()(flat) is flat and o.MetalStreak()(flat) is flat


def test_spectrum_lines_by_the_full_transform():
    v = volume((9, 8))
    d = Draws(3, "0", 1)
    lines = d.choose("lines0", 9, max(1, round(d.uniform("fraction", (0.2, 0.5)) * 9)))
    spectrum = np.fft.fft2(v.image)
    spectrum[lines] = 0
    assert np.allclose(o.KSpaceDropout(dropout_fraction=(0.2, 0.5))(v, d).image, np.abs(np.fft.ifft2(spectrum)), atol=1e-6)


def test_histogram_match_is_monotone_and_in_range():
    v = volume((20, 20))
    reference = RNG.uniform(10, 15, (30, 30))
    out = o.HistogramMatch(reference=reference)(v).image
    order = np.argsort(v.image, axis=None)
    assert (np.diff(out.ravel()[order]) >= -1e-6).all() and out.min() >= 10 and out.max() <= 15 and abs(np.median(out) - np.median(reference)) < 0.3


def test_slab_shift_moves_whole_slices():
    v = volume()
    out = o.SlabShift(max_shift=(2, 2), cval=-1.0)(v)
    assert (out.image[2:] == v.image[:-2]).all() and (out.image[:2] == -1).all() and (out.mask[:2] == 0).all()


@pytest.mark.parametrize("seed", range(100))
def test_image_and_mask_stay_together(seed):
    image = np.zeros((32, 32), np.float32)
    image[10:22, 10:22] = 1
    v = Sample(image, (image > 0).astype(np.int32), (1.0, 1.0))
    out = o.RandomAffine(rotation=15, translation=0.05)(o.RandomFlip()(v, Draws(seed, "0.0", 1)), Draws(seed, "0.1", 1))
    assert (out.image[out.mask == 1] >= 0.2).all() and out.mask.sum() > 60
