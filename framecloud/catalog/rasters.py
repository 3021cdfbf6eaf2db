"""8-bit rasters, padding, resizing."""

from __future__ import annotations

from pyspark.sql import functions as F

from framecloud.catalog import views
from framecloud.catalog.registry import query
from framecloud.operators import raster as ra
from framecloud.operators.geometry import explode_pixels
from framecloud.schema import KEYS

_E = "select cast(label as varchar) as camera, vec_id as frame_id, embedding as e"


@query(
    "contrast_stretch",
    f"""with s as ({_E}, list_sort(embedding) as o from embeddings),
    p as (select *, o[1] as a0 from s),
    q as (select camera, frame_id, e,
        o[floor(63 * 0.01)::int + 1]::double + (o[ceil(63 * 0.01)::int + 1]::double
          - o[floor(63 * 0.01)::int + 1]::double) * (63::double * 0.01::double - floor(63 * 0.01)) as lo,
        o[floor(63 * 0.99)::int + 1]::double + (o[ceil(63 * 0.99)::int + 1]::double
          - o[floor(63 * 0.99)::int + 1]::double) * (63::double * 0.99::double - floor(63 * 0.99)) as hi0
      from p),
    r as (select *, case when hi0 <= lo then lo + 1 else hi0 end as hi from q),
    x as (select camera, frame_id, lo, hi, unnest(range(64))::int as i, unnest(e)::double as c from r)
    select camera, frame_id, i,
      floor(least(greatest((c - lo) / (hi - lo), 0.0), 1.0) * 255.0::double)::int as byte from x""",
)
def contrast_stretch(spark, sf_dir):
    return ra.contrast_stretch(views.frames(spark, sf_dir), KEYS, "depth")


_RGB = """px as (select camera, frame_id, e, m, unnest(range(64))::int as i from img),
val as (select camera, frame_id, m, i, unnest([abs(e[i + 1]), abs(e[64 - i]), abs(e[xor(i, 1) + 1])]) * 3.0::float as c,
  unnest(range(3))::int as channel from px)"""


@query(
    "to_uint8",
    f"""with img as ({_E}, case when list_max(list_transform(embedding, lambda c: abs(c) * 3.0::float)) <= 1.0
      then 255.0::float else 1.0::float end as m from embeddings), {_RGB}
    select camera, frame_id, i, channel,
      floor(least(greatest(c * m, 0.0::float), 255.0::float))::int as byte from val""",
)
def to_uint8(spark, sf_dir):
    return ra.color_to_bytes(views.frames(spark, sf_dir), KEYS, "rgb", F.col("rgb_channels"))


@query(
    "mask_bytes",
    f"""with p as ({_E}, unnest(range(64))::int as i from embeddings)
    select camera, frame_id, i, (case when e[i + 1] > 0 then 255 else 0 end)::int as byte from p""",
)
def mask_bytes(spark, sf_dir):
    px = explode_pixels(views.frames(spark, sf_dir), KEYS, "depth", "depth", F.col("width"))
    return px.select(*KEYS, "i", ra.mask_to_bytes(F.col("depth")).alias("byte"))


SRC, WIDE, SCALED, TARGET = (8, 8), (10, 12), (12, 12), (12, 16)
# Channel c of the reversed image at source position p.
_CHANNEL = (
    "(case {c} when 2 then abs(e[{p} + 1]) when 1 then abs(e[64 - ({p})]) "
    "else abs(e[xor({p}, 1) + 1]) end * 3.0::float)"
)


def _at(p: str) -> str:
    return _CHANNEL.format(c="channel", p=p)


@query(
    "planar_pad",
    f"""with p as ({_E}, unnest(range(120))::int as i from embeddings),
    q as (select *, i % 12 as u, i // 12 as v, unnest(range(3))::int as channel from p)
    select camera, frame_id, channel, i,
      case when u < 8 and v < 8 then {_at('(v * 8 + u)')} else 0.0::float end as value from q""",
)
def planar_pad(spark, sf_dir):
    return ra.planar_pad(views.frames(spark, sf_dir), KEYS, "rgb", SRC, WIDE)


_W = "(1.0::float - {a})"


@query(
    "resize_pad",
    f"""with p as ({_E}, unnest(range(192))::int as i from embeddings),
    q as (select *, least(i % 16, 11) as cu, least(i // 16, 11) as cv from p),
    f as (select *, (cu::float + 0.5::float) * (8.0::float / 12.0::float) - 0.5::float as fx,
      (cv::float + 0.5::float) * (8.0::float / 12.0::float) - 0.5::float as fy from q),
    n as (select *, greatest(0, least(floor(fx)::int, 7)) as x0, greatest(0, least(floor(fy)::int, 7)) as y0,
      fx - floor(fx)::float as wx, fy - floor(fy)::float as wy from f),
    m as (select *, least(x0 + 1, 7) as x1, least(y0 + 1, 7) as y1, unnest(range(3))::int as channel from n)
    select camera, frame_id, channel, i, round((
      {_W.format(a='wy')} * ({_W.format(a='wx')} * {_at('(y0 * 8 + x0)')} + wx * {_at('(y0 * 8 + x1)')})
      + wy * ({_W.format(a='wx')} * {_at('(y1 * 8 + x0)')} + wx * {_at('(y1 * 8 + x1)')}))::double, 5) as value
    from m""",
)
def resize_pad(spark, sf_dir):
    out = ra.resize_pad(views.frames(spark, sf_dir), KEYS, "rgb", SRC, SCALED, TARGET)
    return out.withColumn("value", F.round(F.col("value").cast("double"), 5))


@query(
    "crop_raster",
    f"""with p as ({_E}, unnest(range(30))::int as i from embeddings)
    select camera, frame_id, i, e[(i // 5) * 8 + i % 5 + 1] as value from p""",
)
def crop_raster(spark, sf_dir):
    return ra.crop_raster(views.frames(spark, sf_dir), KEYS, "depth", 8, (6, 5))


@query(
    "upsample",
    f"""with p as ({_E}, unnest(range(240))::int as i from embeddings),
    f as (select *, (((i % 20)::float + 0.5::float) * (8.0::float / 20.0::float)) - 0.5::float as fx,
      (((i // 20)::float + 0.5::float) * (8.0::float / 12.0::float)) - 0.5::float as fy from p)
    select camera, frame_id, i, e[greatest(0, least(round_even(fy, 0)::int, 7)) * 8
      + greatest(0, least(round_even(fx, 0)::int, 7)) + 1] * 2.5::float as value from f""",
)
def upsample(spark, sf_dir):
    return ra.upsample(views.frames(spark, sf_dir), KEYS, "depth", SRC, (12, 20), 2.5)
