"""framecloud: depth-camera frames to point clouds as Spark DataFrame jobs.

Every public function takes and returns DataFrames, so the same code serves a
batch read, a micro-batch of a stream and a plain SQL table.
"""

from framecloud.config import (
    BuildConfig,
    CameraRow,
    CropConfig,
    Extrinsics,
    Intrinsics,
    PointCloudConfig,
    SamplingConfig,
    StereoConfig,
)
from framecloud.plans.build import build
from framecloud.session import tune

__all__ = [
    "BuildConfig",
    "CameraRow",
    "CropConfig",
    "Extrinsics",
    "Intrinsics",
    "PointCloudConfig",
    "SamplingConfig",
    "StereoConfig",
    "build",
    "tune",
]
