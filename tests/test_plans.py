import numpy as np
import pytest

from lumenframe import operators as o
from lumenframe.functions.draws import Draws
from lumenframe.plans.node import REGISTRY, Compose, Guard, OneOf, SomeOf, Transform, from_dict, from_json, iter_pipeline, pipeline_summary, register_transform, to_json
from lumenframe.plans.presets import PRESETS
from lumenframe.plans.sample import Sample
from lumenframe.plans.validate import ValidationError, VolumeValidator

V = Sample(np.random.default_rng(2).random((10, 12)).astype(np.float32), (np.random.default_rng(2).random((10, 12)) > 0.5).astype(np.int32), (1.0, 1.0))


def test_summary_text():
    plan = Compose([o.RandomFlip(axes=("x",), p=0.5), OneOf([o.GaussianNoise(std=0.01), o.RicianNoise(std=0.02)], p=0.3)], seed=42)
    assert pipeline_summary(plan).splitlines() == [
        "Compose(p=1.0, seed=42)",
        "  0 RandomFlip(axes=['x'], p_per_axis=0.5, p=0.5)",
        "  1 OneOf(weights=[0.5, 0.5], p=0.3, seed=None)",
        "    1.0 GaussianNoise(std=0.01, relative=False, clip=None, p=1.0)",
        "    1.1 RicianNoise(std=0.02, clip=None, p=1.0)",
    ]
    assert [s.path for s in iter_pipeline(plan)] == [(), (0,), (1,), (1, 0), (1, 1)]
    with pytest.raises(ValueError):
        pipeline_summary(plan, max_value_length=7)
    with pytest.raises(TypeError):
        pipeline_summary("plan")


def test_compose_gates_and_seeds():
    plan = Compose([o.GaussianNoise(std=0.1, p=0.5), o.RandomFlip(p_per_axis=1.0)], seed=np.int64(3))
    assert plan.to_dict()["params"]["seed"] == 3 and len(plan) == 2 and list(plan)[1].p == 1.0
    outs = [plan(V, Draws(3, "0", i)).image for i in range(200)]
    plain = sum((x == V.image[:, ::-1]).all() for x in outs)
    assert 70 < plain < 130
    assert Compose([])(V) is V


def test_one_of_ignores_the_childs_p_and_follows_weights():
    plan = OneOf([o.BrightnessContrast(brightness=(5, 5), p=0.0), o.BrightnessContrast(brightness=(9, 9))], weights=(3, 1))
    means = np.array([plan(V, Draws(1, "0", i)).image.mean() for i in range(400)])
    assert 260 < (means < 7).sum() < 340
    for bad in ({"weights": (1,)}, {"weights": (0, 0)}, {"weights": (-1, 2)}):
        with pytest.raises(ValueError):
            OneOf(plan.transforms, **bad)
    with pytest.raises(ValueError):
        OneOf([])
    assert OneOf(plan.transforms, weights=(1, 0)).pick(0.9999999) == 0


def test_some_of_takes_n_children_in_order():
    add = [o.BrightnessContrast(brightness=(10.0**k, 10.0**k), contrast=1.0, p=0.0) for k in range(3)]
    sums = {round(float(SomeOf(add, n=2)(V, Draws(1, "0", i)).image.mean() - V.image.mean())) for i in range(60)}
    assert sums == {11, 101, 110}
    with pytest.raises(ValueError):
        SomeOf(add, n=(2, 5))


class Poison(Transform):
    def apply(self, sample, draws):
        image = sample.image.copy()
        image[0, 0] = np.nan if draws.unit("bad") < 0.7 else 0.0
        return sample.having(image=image)


def test_guard_modes():
    bad, good = next(i for i in range(99) if Draws(0, "0.0", i).unit("bad") < 0.7), next(i for i in range(99) if Draws(0, "0.0", i).unit("bad") >= 0.7)
    with pytest.raises(ValidationError) as e:
        Guard(Poison())(V, Draws(0, "0", bad))
    assert e.value.report.issues[0].check == "finite"
    assert not np.isnan(Guard(Poison())(V, Draws(0, "0", good)).image).any()
    assert Guard(Poison(), on_fail="revert")(V, Draws(0, "0", bad)) is V
    with pytest.warns(UserWarning):
        assert np.isnan(Guard(Poison(), on_fail="warn")(V, Draws(0, "0", bad)).image).any()
    tries = [Guard(Poison(), on_fail="retry", retries=20)(V, Draws(0, "0", i)) for i in range(20)]
    assert not any(np.isnan(t.image).any() for t in tries) and all(t is not V for t in tries)
    plan = Guard(o.RandomFlip(), VolumeValidator(intensity_bounds=(0, 1)), on_fail="retry", retries=2)
    assert from_json(to_json(plan)).to_dict() == from_dict(plan.to_dict()).to_dict()
    for make in (lambda: Guard(1), lambda: Guard(Poison(), 3)):
        with pytest.raises(TypeError):
            make()
    for make in (lambda: Guard(Poison(), on_fail="no"), lambda: Guard(Poison(), retries=0)):
        with pytest.raises(ValueError):
            make()


def test_registry_rules():
    with pytest.raises(KeyError, match="serialisation registry"):
        from_dict({"name": "Nothing", "params": {}})
    with pytest.raises(TypeError):
        register_transform(int)
    with pytest.raises(KeyError):
        register_transform(type("RandomFlip", (Transform,), {}))
    assert register_transform(name="Poisoned")(Poison) is Poison and register_transform(name="Poisoned")(Poison) is Poison
    del REGISTRY["Poisoned"]


@pytest.mark.parametrize("name", PRESETS)
def test_presets(name):
    plan = PRESETS[name](7)
    v = Sample(np.random.default_rng(0).random((6, 16, 16)).astype(np.float32), None, (1.0,) * 3)
    a, b = (from_json(to_json(plan))(v, Draws(7, "0", 3)).image for _ in range(2))
    assert (a == b).all() and np.isfinite(a).all()


def issues(image, mask=None, reference=None, **settings):
    return {(i.check, i.severity) for i in VolumeValidator(**settings).validate(Sample(np.array(image, float), mask, (1.0, 1.0)), reference).issues}


def test_validator_checks():
    a, m = np.linspace(-2, 5, 64).reshape(8, 8), np.arange(64).reshape(8, 8) // 32
    assert issues(a) == set() and issues(np.full((8, 8), 0.3)) == {("constant", "error")}
    assert issues(np.where(a > 4, np.inf, a)) == {("finite", "error")}
    assert issues(a, intensity_bounds=(0, 1)) == {("intensity_bounds", "warning")} and issues(a, intensity_bounds=(0, 1), strict_bounds=True) == {("intensity_bounds", "error")}
    assert issues(a, m[:4]) == {("mask_shape", "error")} and issues(a, m * 0, min_foreground_fraction=0.1) == {("min_foreground", "error")}
    before = Sample(a, m, (1.0, 1.0))
    assert issues(a, m * 0, before, max_foreground_loss=0.5) == {("mask_labels", "error"), ("foreground_loss", "error")}
    assert issues(a + 9, m, before, max_intensity_shift=1.0) == {("intensity_shift", "warning")}
    for bad in ({"intensity_bounds": (1, 0)}, {"min_foreground_fraction": 2}, {"max_intensity_shift": -1}):
        with pytest.raises(ValueError):
            VolumeValidator(**bad)


def test_pruning_targets():
    v = Sample(np.zeros((10, 10)), None, (1.0, 1.0), {}, np.array([[1.0, 1], [-1, 5], [5, 10]]), ("a", "b", "c"), np.array([[-5.0, 0], [20, 20]]), np.array([[5.0, 4], [30, 30]]), ("d", "e"))
    out = v.visible(0.4)
    assert out.point_labels == ("a",) and out.box_labels == ("d",) and out.lows.tolist() == [[0, 0]]
    assert v.visible(0.6).box_labels == ()
    with pytest.raises(ValueError):
        v.visible(2)
