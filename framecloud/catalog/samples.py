"""Fixed-size sampling over point tables and frames."""

from __future__ import annotations

from framecloud.catalog import sql as S
from framecloud.catalog import views
from framecloud.catalog.clouds import PART_COLORS, TIGHT, TIGHT_SQL, WINDOW, WINDOW_SQL, color_part, raw
from framecloud.catalog.registry import query
from framecloud.config import BuildConfig, SamplingConfig
from framecloud.operators.assembly import pack_clouds
from framecloud.operators.crop import crop
from framecloud.operators.sampling import (
    sample_parts,
    sample_points,
    sampling_counts,
    voxel_keys,
    voxel_representatives,
)
from framecloud.plans.build import build
from framecloud.schema import KEYS

LINE = ["frame_id"]
PIXELS = views.SIDE * views.SIDE
VOXEL = 0.1
K = 256

LINE_MODES = {
    "sample_stride": SamplingConfig("stride", K, stride=2),
    "sample_random": SamplingConfig("random", K, seed=7, deterministic=True),
    "sample_voxel": SamplingConfig("voxel", K, voxel_size=VOXEL),
    "sample_voxel_random": SamplingConfig("voxel_random", K, voxel_size=VOXEL, seed=7, deterministic=True),
}


def _line_sample(name: str, cfg: SamplingConfig) -> None:
    ctes = S.sampled("frame_id", cfg.mode, cfg.num_points, cfg.voxel_size, 7, cfg.stride)

    @query(name, S.with_(S.LINES, ctes, select="select * from outp"))
    def run(spark, sf_dir):
        points = views.line_points(spark, sf_dir)
        return sample_points(points, views.line_frames(spark, sf_dir), LINE, cfg)


for _name, _cfg in LINE_MODES.items():
    _line_sample(_name, _cfg)


@query(
    "voxel_keys",
    S.with_(
        S.LINES,
        select=f"""select frame_id, idx, floor(x / {VOXEL}::float)::bigint as kx,
          floor(y / {VOXEL}::float)::bigint as ky, floor(z / {VOXEL}::float)::bigint as kz from src""",
    ),
)
def voxel_keys_query(spark, sf_dir):
    return voxel_keys(views.line_points(spark, sf_dir), VOXEL).select(
        "frame_id", "idx", "kx", "ky", "kz"
    )


@query(
    "voxel_representatives",
    S.with_(
        S.LINES,
        f"rep as (select frame_id, min(idx) as idx from src group by frame_id, {S.voxels(VOXEL)})",
        select="select frame_id, idx, x, y, z from src join rep using (frame_id, idx)",
    ),
)
def voxel_representatives_query(spark, sf_dir):
    return voxel_representatives(views.line_points(spark, sf_dir), LINE, VOXEL)


def _frame_sample(name: str, cfg: SamplingConfig, window, where: str) -> None:
    ctes = S.sampled(
        S.KEYS, cfg.mode, cfg.num_points, cfg.voxel_size, cfg.seed or 0, cfg.stride, cfg.pad_mode
    )
    src = f"src as (select camera, frame_id, idx, x, y, z from raw where {where})"
    text = S.with_(
        S.RAW, S.FRAMES, src, ctes, select="select * from outp", recursive=cfg.mode.endswith("fps")
    )

    @query(name, text)
    def run(spark, sf_dir):
        frames, cameras = views.frames(spark, sf_dir), views.cameras(spark, sf_dir)
        return build(frames, cameras, BuildConfig(crop=window, sampling=cfg)).sampled


_frame_sample("sample_fps", SamplingConfig("fps", 8), WINDOW, WINDOW_SQL)
_frame_sample("sample_voxel_fps", SamplingConfig("voxel_fps", 8, voxel_size=0.05), WINDOW, WINDOW_SQL)
_frame_sample("pad_zero", SamplingConfig("voxel", 24, voxel_size=0.02, pad_mode="zero"), WINDOW, WINDOW_SQL)
_frame_sample("empty_frames", SamplingConfig("random", 6, seed=3, deterministic=True), TIGHT, TIGHT_SQL)


@query(
    "sampling_off",
    S.with_(S.RAW, select=f"select camera, frame_id, idx, x, y, z from raw where {WINDOW_SQL}"),
)
def sampling_off(spark, sf_dir):
    points = crop(raw(spark, sf_dir), WINDOW)
    cfg = SamplingConfig(enabled=False)
    return sample_points(points, views.frames(spark, sf_dir), KEYS, cfg)


PARTS = SamplingConfig("voxel_random", 16, voxel_size=0.05, seed=42, deterministic=True)


@query(
    "sample_parts",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"src as (select camera, frame_id, idx, x, y, z, {PART_COLORS} from raw)",
        S.sampled(S.KEYS, "voxel_random", 16, 0.05, extra="red, green, blue"),
        select="select * from outp",
    ),
)
def sample_parts_query(spark, sf_dir):
    xyz, colors = raw(spark, sf_dir), color_part(spark, sf_dir)
    return sample_parts(xyz, colors, views.frames(spark, sf_dir), KEYS, PARTS, PIXELS)


META = SamplingConfig("voxel", 24, voxel_size=0.02)


@query(
    "sampling_meta",
    S.with_(
        S.RAW,
        S.FRAMES,
        f"cr as (select *, row({S.voxels(0.02)}) as vox from raw where {TIGHT_SQL})",
        select="""select f.camera, f.frame_id, count(cr.idx) as input_count,
          count(distinct vox) as candidate_count, 24::bigint as sampled_count,
          count(cr.idx) = 0 as input_empty, count(distinct vox) < 24 as padded,
          true as sampling_enabled, 'voxel' as sampling_mode, 24 as target_num_points,
          'repeat' as pad_mode, 0.02::double as voxel_size
        from frames f left join cr on f.camera = cr.camera and f.frame_id = cr.frame_id
        group by f.camera, f.frame_id""",
    ),
)
def sampling_meta(spark, sf_dir):
    points = crop(raw(spark, sf_dir), TIGHT)
    return sampling_counts(points, views.frames(spark, sf_dir), KEYS, META)


STRIDE = SamplingConfig("stride", 600, stride=2)


@query(
    "sampling_meta_stride",
    """select l_suppkey as frame_id, count(*) as input_count, count(*) as candidate_count,
      600::bigint as sampled_count, false as input_empty, count(*) < 600 as padded,
      true as sampling_enabled, 'stride' as sampling_mode, 600 as target_num_points,
      'repeat' as pad_mode, 0.01::double as voxel_size from lineitem group by l_suppkey""",
)
def sampling_meta_stride(spark, sf_dir):
    """Padding is judged on candidates: a frame of 600 points with stride 2 is not padded."""
    points = views.table(spark, sf_dir, "lineitem").selectExpr("l_suppkey as frame_id")
    return sampling_counts(points, views.line_frames(spark, sf_dir), LINE, STRIDE)


@query(
    "training_export",
    S.with_(
        S.LINES,
        S.sampled("frame_id", "voxel_random", 64, VOXEL, 7),
        select="""select frame_id, count(*)::int as num_points, list(x order by slot) as x,
          list(y order by slot) as y, list(z order by slot) as z from outp group by frame_id""",
    ),
)
def training_export(spark, sf_dir):
    cfg = SamplingConfig("voxel_random", 64, voxel_size=VOXEL, seed=7, deterministic=True)
    points = views.line_points(spark, sf_dir)
    sampled = sample_points(points, views.line_frames(spark, sf_dir), LINE, cfg)
    return pack_clouds(sampled, LINE)
