"""Checks of volumes, alone and against the volume they came from."""

from __future__ import annotations

from dataclasses import asdict, dataclass, field

import numpy as np

from lumenframe.plans.node import ValidationError
from lumenframe.plans.sample import Sample

__all__ = ["ValidationError", "ValidationIssue", "ValidationReport", "VolumeValidator"]


@dataclass(frozen=True)
class ValidationIssue:
    check: str
    severity: str
    message: str


@dataclass(frozen=True)
class ValidationReport:
    issues: tuple[ValidationIssue, ...] = field(default_factory=tuple)

    @property
    def errors(self):
        return [i for i in self.issues if i.severity == "error"]

    @property
    def warnings(self):
        return [i for i in self.issues if i.severity == "warning"]

    @property
    def ok(self) -> bool:
        return not self.errors

    def __bool__(self):
        return self.ok

    def __str__(self):
        return "no issues" if not self.issues else "; ".join(f"{i.severity} {i.check}: {i.message}" for i in self.issues)


@dataclass(frozen=True)
class VolumeValidator:
    """Which checks to make; None leaves a check out."""

    require_finite: bool = True
    forbid_constant: bool = True
    check_mask_shape: bool = True
    intensity_bounds: tuple[float, float] | None = None
    strict_bounds: bool = False
    min_foreground_fraction: float | None = None
    preserve_mask_labels: bool = True
    max_foreground_loss: float | None = None
    max_intensity_shift: float | None = None

    def __post_init__(self):
        if self.intensity_bounds is not None:
            bounds = tuple(map(float, self.intensity_bounds))
            if len(bounds) != 2 or bounds[0] > bounds[1]:
                raise ValueError("intensity_bounds must be an ascending pair")
            object.__setattr__(self, "intensity_bounds", bounds)
        for name in ("min_foreground_fraction", "max_foreground_loss"):
            if (v := getattr(self, name)) is not None and not 0 <= v <= 1:
                raise ValueError(f"{name} must be from 0 to 1")
        if self.max_intensity_shift is not None and self.max_intensity_shift < 0:
            raise ValueError("max_intensity_shift must not be negative")

    def to_dict(self) -> dict:
        return {k: list(v) if isinstance(v, tuple) else v for k, v in asdict(self).items()}

    @classmethod
    def from_dict(cls, data: dict) -> VolumeValidator:
        return cls(**data)

    def validate(self, sample: Sample, reference: Sample | None = None) -> ValidationReport:
        issues: list[ValidationIssue] = []
        add = lambda check, severity, message: issues.append(ValidationIssue(check, severity, message))
        image, mask = sample.values, sample.mask
        bad = int((~np.isfinite(image)).sum())
        if self.require_finite and bad:
            add("finite", "error", f"{bad} values are not finite")
        if self.forbid_constant and image.size and not bad and image.max() == image.min():
            add("constant", "error", "all values are equal")
        if self.check_mask_shape and mask is not None and mask.shape != image.shape:
            add("mask_shape", "error", f"the mask has shape {mask.shape}, the image {image.shape}")
        known = image[~np.isnan(image)]
        if self.intensity_bounds is not None and known.size and (known.min() < self.intensity_bounds[0] or known.max() > self.intensity_bounds[1]):
            add("intensity_bounds", "error" if self.strict_bounds else "warning", f"values from {known.min():g} to {known.max():g} are outside {self.intensity_bounds}")
        share = float((mask != 0).mean()) if mask is not None and mask.size else None
        if self.min_foreground_fraction is not None and share is not None and share < self.min_foreground_fraction:
            add("min_foreground", "error", f"the foreground has the share {share:g}")
        if reference is None:
            return ValidationReport(tuple(issues))
        if mask is not None and reference.mask is not None:
            if self.preserve_mask_labels:
                lost = sorted(set(np.unique(reference.mask[reference.mask != 0]).tolist()) - set(np.unique(mask).tolist()))
                if lost:
                    add("mask_labels", "error", f"labels {lost} are lost")
            before = float((reference.mask != 0).mean()) if reference.mask.size else 0.0
            if self.max_foreground_loss is not None and before > 0 and 1 - share / before > self.max_foreground_loss:
                add("foreground_loss", "error", f"the foreground lost the share {1 - share / before:g}")
        if self.max_intensity_shift is not None and not bad:
            other = reference.values
            if other.size and np.isfinite(other).all() and other.std() > 0:
                shift = abs(image.mean() - other.mean()) / other.std()
                if shift > self.max_intensity_shift:
                    add("intensity_shift", "warning", f"the mean moved by {shift:g} standard deviations")
        return ValidationReport(tuple(issues))
