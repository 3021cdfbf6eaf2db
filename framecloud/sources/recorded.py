"""Recorded frames: NPZ / NPY files and Parquet sidecars."""

from __future__ import annotations

import io
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Array names a frame file may hold.
FRAME_KEYS = (
    "depth",
    "left_ir",
    "right_ir",
    "rgb",
    "color",
    "timestamp",
    "global_frame_index",
)
SIDECAR_GLOB = "data/chunk-*/file-*.parquet"

FILE_FRAMES = (
    "path string, frame_id bigint, ts double, height int, width int, depth array<float>, "
    "rgb array<float>, rgb_channels int, ir_channels int, "
    "left_ir array<float>, right_ir array<float>"
)


def _open(path: str, content: bytes) -> dict[str, np.ndarray]:
    suffix = path.rsplit(".", 1)[-1].lower()
    if suffix not in ("npz", "npy"):
        raise ValueError(f"unsupported frame file: {path}")
    data = np.load(io.BytesIO(content), allow_pickle=False)
    if suffix == "npy":
        return {"depth": data}
    found = {k: data[k] for k in FRAME_KEYS if k in data.files}
    if "color" in found:
        color = found.pop("color")
        found.setdefault("rgb", color)
    if not found:
        raise ValueError(f"no known frame arrays in {path}")
    return found


def _row(path: str, content: bytes) -> dict:
    arrays = _open(path, content)
    images = [arrays[k] for k in ("depth", "left_ir", "right_ir", "rgb") if k in arrays]
    height, width = (images[0].shape[:2]) if images else (None, None)

    def flat(name):
        return arrays[name].astype(np.float32).ravel() if name in arrays else None

    def channels(name):
        if name not in arrays:
            return None
        return arrays[name].shape[2] if arrays[name].ndim == 3 else 1

    scalar = lambda n: arrays[n].item() if n in arrays else None
    index = scalar("global_frame_index")
    return {
        "path": path,
        "frame_id": None if index is None else int(index),
        "ts": scalar("timestamp"),
        "height": height,
        "width": width,
        "depth": flat("depth"),
        "rgb": flat("rgb"),
        "rgb_channels": channels("rgb"),
        "ir_channels": channels("left_ir"),
        "left_ir": flat("left_ir"),
        "right_ir": flat("right_ir"),
    }


def read_frame_files(spark: SparkSession, path: str, camera: str | None = None) -> DataFrame:
    """One row per NPZ or NPY file. Pickled arrays are refused.

    The frame key comes from the file's index, else from the digits that end its
    name; it is null where there are neither, which a build refuses. The camera is
    ``camera``, else the name of the file's folder.
    """

    def decode(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for files in parts:
            rows = [_row(p, c) for p, c in zip(files["path"], files["content"], strict=True)]
            frame = pd.DataFrame(rows)
            for c in ("frame_id", "height", "width", "rgb_channels", "ir_channels"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    frames = files.mapInPandas(decode, FILE_FRAMES)
    digits = F.regexp_extract("path", r"([0-9]{1,18})\.[A-Za-z]+$", 1)
    numbered = F.when(digits != "", digits).cast("bigint")
    folder = F.element_at(F.split("path", "/"), -2)
    return frames.withColumns(
        {
            "frame_id": F.coalesce("frame_id", numbered),
            "camera": folder if camera is None else F.lit(camera),
        }
    )


def read_sidecar(spark: SparkSession, root: str) -> DataFrame:
    """All chunk files of a recording; filters on the index reach the scan."""
    return spark.read.parquet(f"{root.rstrip('/')}/{SIDECAR_GLOB}")


def frame_at(sidecar: DataFrame, index: int, column: str = "global_frame_index") -> DataFrame:
    return sidecar.where(F.col(column) == F.lit(index))
