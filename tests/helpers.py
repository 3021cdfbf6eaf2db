"""Small tables for literal cases."""

from framecloud.config import CameraRow, Extrinsics, Intrinsics
from framecloud.schema import FRAMES, camera_table


def lens(width, height, f=1.0, c=1.0):
    return Intrinsics(width, height, f, f, c, c)


def camera(spark, width=3, height=3, aligned=True, scale=1.0, color_c=1.0, depth_c=1.0, t=None, f=1.0):
    ext = Extrinsics(((1, 0, 0), (0, 1, 0), (0, 0, 1)), t) if t else None
    row = CameraRow(
        "cam", scale, aligned, lens(width, height, f, color_c), lens(width, height, f, depth_c), ext, 0.05
    )
    return camera_table(spark, [row])


def frame(spark, *frames):
    """Frame rows given as dicts; missing columns are null."""
    names = FRAMES.fieldNames()
    rows = []
    for j, f in enumerate(frames):
        f = {"camera": "cam", "frame_id": j, "ts": float(j), **f}
        rows.append(tuple(f.get(n) for n in names))
    return spark.createDataFrame(rows, FRAMES)


def points(spark, rows, schema="camera string, frame_id bigint, idx bigint, x float, y float, z float"):
    return spark.createDataFrame(rows, schema)


def cloud(spark, coordinates, frame_id=0):
    rows = [("cam", frame_id, i, *map(float, p)) for i, p in enumerate(coordinates)]
    return points(spark, rows)


def key_table(spark, *ids):
    return spark.createDataFrame([("cam", i) for i in ids], "camera string, frame_id bigint")


def xyz(df, order="idx"):
    return [(r.x, r.y, r.z) for r in df.orderBy(order).collect()]
