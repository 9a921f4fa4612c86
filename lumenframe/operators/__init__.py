"""All operators by name."""

from lumenframe.operators.intensity import (  # noqa: F401
    BiasField, BrightnessContrast, CLAHEContrast, GammaCorrection, GaussianBlur, GaussianNoise, HistogramMatch, MedianBlur, RicianNoise, Sharpen, SimulateLowResolution, WindowLevel,
)
from lumenframe.operators.modality import (  # noqa: F401
    AnisotropicElastic, BeamHardening, CompressionVariation, GhostingArtifact, GridArtifact, KSpaceDropout, LimitedAngleBlur, MetalStreak, MRIMotion, ReconStreak, ScatterSimulation, SlabShift, SliceDropout,
)
from lumenframe.operators.spatial import AnatomicCrop, CenterCrop, CoarseDropout, ElasticDeform, Pad, RandomAffine, RandomFlip, Resize  # noqa: F401
from lumenframe.plans.node import Compose, Guard, OneOf, SomeOf  # noqa: F401
