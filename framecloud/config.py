"""Settings of one build, checked when they are created.

Field names follow the YAML keys users already have, so ``from_mapping`` takes
an existing configuration file's content unchanged.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field, fields
from typing import Any

INF = float("inf")

# Names a configuration may use.
SAMPLING_MODES = ("fps", "stride", "random", "voxel", "voxel_random", "voxel_fps")
PAD_MODES = ("repeat", "zero")
RGB_MAPPINGS = ("aligned", "project_depth_to_color")
OUTPUT_FORMATS = ("xyz", "xyzrgb")
DEPTH_MODES = ("frame", "stereo")
STEREO_SECTIONS = {"stereo": "stereo"}
RECTIFICATION_MODES = ("auto", "require_rectified", "opencv")
PRECISIONS = ("fp16", "fp32")


def _require(ok: bool, message: str) -> None:
    if not ok:
        raise ValueError(message)


def _pick(cls, raw: Mapping[str, Any] | None, **fixed):
    """Build a dataclass from the keys it knows."""
    known = {f.name for f in fields(cls)}
    given = {k: v for k, v in (raw or {}).items() if k in known}
    return cls(**{**given, **fixed})


@dataclass(frozen=True)
class Intrinsics:
    width: int
    height: int
    fx: float
    fy: float
    cx: float
    cy: float

    def __post_init__(self):
        _require(self.width > 0 and self.height > 0, "image size must be positive")


@dataclass(frozen=True)
class Extrinsics:
    rotation: tuple
    translation: tuple

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> Extrinsics:
        rotation = raw.get("rotation_matrix_row_major", raw.get("rotation"))
        translation = raw.get("translation", raw.get("translation_m"))
        _require(rotation is not None and translation is not None, "incomplete extrinsics")
        _require(len(translation) == 3, "translation must have three values")
        return cls(tuple(rotation), tuple(float(c) for c in translation))

    def flat_rotation(self) -> list[float]:
        rows = self.rotation
        cells = list(rows) if len(rows) == 9 else [c for row in rows for c in row]
        _require(len(cells) == 9, "rotation must be 3x3")
        return [float(c) for c in cells]


@dataclass(frozen=True)
class CameraRow:
    """One row of the ``cameras`` table."""

    name: str
    depth_scale: float
    aligned_depth_to_color: bool
    color_intrinsics: Intrinsics
    depth_intrinsics: Intrinsics
    depth_to_color_extrinsics: Extrinsics | None = None
    baseline_m: float | None = None

    @classmethod
    def from_mapping(cls, raw: Mapping[str, Any]) -> CameraRow:
        extrinsics = raw.get("depth_to_color_extrinsics")
        return cls(
            name=str(raw["name"]),
            depth_scale=float(raw["depth_scale"]),
            aligned_depth_to_color=bool(raw["aligned_depth_to_color"]),
            color_intrinsics=_pick(Intrinsics, raw["color_intrinsics"]),
            depth_intrinsics=_pick(Intrinsics, raw["depth_intrinsics"]),
            depth_to_color_extrinsics=Extrinsics.from_mapping(extrinsics) if extrinsics else None,
            baseline_m=raw.get("baseline_m"),
        )


@dataclass(frozen=True)
class PointCloudConfig:
    use_rgb: bool = False
    output_format: str = "xyz"
    rgb_mapping: str | None = None
    rgb_sampling: str = "nearest"
    xyz_frame: str = "depth"

    def __post_init__(self):
        _require(self.output_format in OUTPUT_FORMATS, f"output_format: {self.output_format}")
        _require(
            self.rgb_mapping is None or self.rgb_mapping in RGB_MAPPINGS,
            f"rgb_mapping: {self.rgb_mapping}",
        )
        _require(self.rgb_sampling == "nearest", "only nearest colour sampling is supported")
        _require(self.xyz_frame == "depth", "only the depth frame is supported")


@dataclass(frozen=True)
class CropConfig:
    enabled: bool = False
    x: tuple[float, float] = (-INF, INF)
    y: tuple[float, float] = (-INF, INF)
    z: tuple[float, float] = (0.0, INF)
    frame: str = "camera"

    def __post_init__(self):
        for axis in "xyz":
            bounds = tuple(getattr(self, axis))
            _require(len(bounds) == 2, f"crop.{axis} must have two bounds")
            _require(bounds[0] <= bounds[1], f"crop.{axis}: lower bound above upper bound")


@dataclass(frozen=True)
class SamplingConfig:
    mode: str = "voxel_random"
    num_points: int = 1024
    enabled: bool = True
    stride: int = 1
    voxel_size: float = 0.01
    seed: int | None = None
    deterministic: bool = False
    pad_mode: str = "repeat"

    def __post_init__(self):
        object.__setattr__(self, "mode", str(self.mode).lower())
        object.__setattr__(self, "pad_mode", str(self.pad_mode).lower())
        _require(self.mode in SAMPLING_MODES, f"sampling.mode: {self.mode}")
        _require(self.pad_mode in PAD_MODES, f"sampling.pad_mode: {self.pad_mode}")
        _require(self.num_points > 0, "sampling.num_points must be positive")
        _require(self.voxel_size > 0.0, "sampling.voxel_size must be positive")
        object.__setattr__(self, "stride", max(1, int(self.stride)))

    @property
    def uses_voxels(self) -> bool:
        return self.mode.startswith("voxel")


@dataclass(frozen=True)
class StereoConfig:
    """Disparity source and the rules that turn disparity into depth."""

    backend: str = ""
    max_disp: int = 416
    valid_iters: int = 8
    precision: str = "fp16"
    cv_group: int = 8
    baseline_m: float = 0.0
    rectification_mode: str = "auto"
    remove_invisible: bool = True
    min_disparity_px: float = 1e-3
    min_depth_m: float = 0.0
    max_depth_m: float | None = None

    def __post_init__(self):
        _require(self.max_disp > 0 and self.max_disp % 4 == 0, "max_disp: positive multiple of 4")
        _require(self.valid_iters > 0, "valid_iters must be positive")
        _require(self.cv_group > 0, "cv_group must be positive")
        _require(self.precision in PRECISIONS, f"precision: {self.precision}")
        _require(
            self.rectification_mode in RECTIFICATION_MODES,
            f"rectification_mode: {self.rectification_mode}",
        )
        _require(self.min_disparity_px > 0.0, "min_disparity_px must be positive")
        _require(self.min_depth_m >= 0.0, "min_depth_m must be non-negative")
        _require(
            self.max_depth_m is None or self.max_depth_m > 0.0, "max_depth_m must be positive"
        )


@dataclass(frozen=True)
class BuildConfig:
    """What to build; camera values live in the ``cameras`` table."""

    pointcloud: PointCloudConfig = field(default_factory=PointCloudConfig)
    crop: CropConfig = field(default_factory=CropConfig)
    sampling: SamplingConfig = field(default_factory=SamplingConfig)
    depth_mode: str = "frame"
    stereo: StereoConfig | None = None

    def __post_init__(self):
        _require(self.depth_mode in DEPTH_MODES, f"depth_source.mode: {self.depth_mode}")
        _require(
            self.depth_mode == "frame" or self.stereo is not None,
            "a stereo depth source needs its settings",
        )

    @classmethod
    def from_mapping(
        cls, raw: Mapping[str, Any], stereo_sections: Mapping[str, str] = STEREO_SECTIONS
    ) -> BuildConfig:
        """Read the sections of a parsed YAML or JSON configuration.

        ``stereo_sections`` maps each accepted stereo mode of ``depth_source`` to the
        name of the section with its settings; any other mode is an error.
        """
        crop_raw = dict(raw.get("crop") or {})
        for axis in "xyz":
            if axis in crop_raw:
                crop_raw[axis] = tuple(float(b) for b in crop_raw[axis])
        if raw.get("crop") is not None:
            crop_raw.setdefault("enabled", True)
        source = raw.get("depth_source") or {}
        stereo = None
        mode = str(source.get("mode", "frame")).lower()
        if mode != "frame":
            _require(mode in stereo_sections, f"depth_source.mode: {mode}")
            stereo = source.get(stereo_sections[mode])
            _require(isinstance(stereo, Mapping), "a stereo depth source needs its settings")
        return cls(
            pointcloud=_pick(PointCloudConfig, raw.get("pointcloud")),
            crop=_pick(CropConfig, crop_raw),
            sampling=_pick(SamplingConfig, raw.get("sampling")),
            depth_mode="frame" if stereo is None else "stereo",
            stereo=None if stereo is None else _pick(StereoConfig, stereo),
        )
