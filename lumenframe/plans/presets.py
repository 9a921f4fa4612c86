"""Plans for common modalities."""

from __future__ import annotations

from lumenframe.plans.node import REGISTRY, Compose, OneOf

# Each preset's steps in order, with their probability and the parameters that are not the operators' own.
PRESET_STEPS: dict[str, tuple] = {
    "mri": (
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, {"rotation": 10.0, "scale": (0.9, 1.1), "translation": 0.05}), ("ElasticDeform", 0.5, {"alpha": 30.0, "sigma": 4.0}), ("BiasField", 0.7, {"alpha": 0.3}), ("RicianNoise", 0.5, {"std": (0.005, 0.02)}), ("GammaCorrection", 0.5, {"gamma": (0.85, 1.15)}),
        ("OneOf", 0.3, (("GhostingArtifact", 1.0, {"ghost_intensity": (0.05, 0.12)}), ("KSpaceDropout", 1.0, {"dropout_fraction": (0.01, 0.04)}), ("MRIMotion", 1.0, {"degrees": (1.0, 4.0), "translation": (1.0, 3.0)}))),
    ),
    "ct": (
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, {"rotation": 8.0, "scale": (0.9, 1.1), "translation": 0.03}), ("ElasticDeform", 0.4, {"alpha": 20.0, "sigma": 4.0}), ("WindowLevel", 0.6, {"center_shift_frac": 0.05, "width_scale": (0.85, 1.15)}), ("GaussianNoise", 0.4, {"std": (5.0, 20.0)}),
        ("GammaCorrection", 0.4, {"gamma": (0.9, 1.1)}), ("BeamHardening", 0.3, {"alpha": (0.02, 0.07)}), ("MetalStreak", 0.15, {"intensity": (0.1, 0.25)}),
    ),
    "dxr": (
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.6, {"rotation": 5.0, "scale": (0.95, 1.05), "axes_enabled": ("x", "y")}), ("GaussianBlur", 0.4, {"sigma": (0.3, 1.2)}), ("BrightnessContrast", 0.5, {"brightness": 0.05, "contrast": (0.9, 1.1)}), ("GammaCorrection", 0.5, {"gamma": (0.8, 1.2)}), ("CLAHEContrast", 0.3, {"clip_limit": (1.0, 2.5)}),
        ("SimulateLowResolution", 0.3, {"zoom_range": (0.6, 0.95)}), ("OneOf", 0.25, (("ScatterSimulation", 1.0, {"fraction": (0.1, 0.3)}), ("GridArtifact", 1.0, {"amplitude": (0.03, 0.08)}))),
    ),
    "dbt": (
        ("RandomFlip", 0.5, {}), ("RandomAffine", 0.7, {"rotation": 5.0, "scale": (0.95, 1.05), "axes_enabled": ("x", "y")}), ("AnisotropicElastic", 0.5, {"alpha": (80.0, 80.0, 6.0), "sigma": (8.0, 8.0, 2.0)}), ("CompressionVariation", 0.4, {"scale": (0.9, 1.1), "axis": "y"}), ("SlabShift", 0.5, {"max_shift": 2}), ("LimitedAngleBlur", 0.6, {"arc_degrees": (15.0, 25.0)}),
        ("ReconStreak", 0.3, {"amplitude": (0.05, 0.15)}), ("SliceDropout", 0.3, {"num_slices": (1, 2)}), ("BiasField", 0.5, {"alpha": 0.2, "coarse_shape": 3}), ("GammaCorrection", 0.5, {"gamma": (0.85, 1.15)}),
    ),
}


def _plan(steps: tuple) -> list:
    return [OneOf(_plan(own), p=p) if name == "OneOf" else REGISTRY[name](**own, p=p) for name, p, own in steps]


def preset(name: str, seed: int | None = None) -> Compose:
    import lumenframe.operators  # noqa: F401  registers the operators

    return Compose(_plan(PRESET_STEPS[name]), seed=seed)


def mri_pipeline(seed: int | None = None) -> Compose:
    return preset("mri", seed)


def ct_pipeline(seed: int | None = None) -> Compose:
    """The noise is in Hounsfield units although the window before it has rescaled to 0..1: for inputs in such units, reorder."""
    return preset("ct", seed)


def dxr_pipeline(seed: int | None = None) -> Compose:
    return preset("dxr", seed)


def dbt_pipeline(seed: int | None = None) -> Compose:
    return preset("dbt", seed)


PRESETS = {"mri": mri_pipeline, "ct": ct_pipeline, "dxr": dxr_pipeline, "dbt": dbt_pipeline}
