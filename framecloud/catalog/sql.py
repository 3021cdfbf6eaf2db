"""SQL building blocks for the DuckDB counterparts."""

from __future__ import annotations

KEYS = "camera, frame_id"

CAM = """cam as (
  select cast(n_nationkey as varchar) as camera, n_nationkey % 2 = 0 as aligned,
    (case when n_nationkey < 5 then 10 else 8 end)::float as scale,
    (56 + n_nationkey)::float as dfx, (58 + n_nationkey)::float as dfy,
    (3.5 - n_nationkey / 8.0)::float as dcx, (3.0 + n_nationkey / 16.0)::float as dcy,
    case when n_nationkey % 2 = 1 then 0.8::float else 1.0::float end as rc,
    case when n_nationkey % 2 = 1 then 0.6::float else 0.0::float end as rs,
    (n_nationkey / 64.0)::float as tx, (-n_nationkey / 128.0)::float as ty
  from nation)"""

PX = """px as (
  select cast(label as varchar) as camera, vec_id as frame_id,
    unnest(range(len(embedding)))::int as i, unnest(embedding) as depth from embeddings)"""

# Active intrinsics: colour when aligned, else depth.
PT = f"""{CAM}, {PX}, lens as (
  select px.*, depth * scale as z,
    case when aligned then 60.0::float else dfx end as fx,
    case when aligned then 60.0::float else dfy end as fy,
    case when aligned then 3.5::float else dcx end as cx,
    case when aligned then 3.5::float else dcy end as cy,
    aligned, rc, rs, tx, ty
  from px join cam using (camera)),
pt as (
  select camera, frame_id, i as idx, aligned, rc, rs, tx, ty, z,
    (((i % 8)::float - cx) * z) / fx as x, (((i // 8)::float - cy) * z) / fy as y
  from lens)"""

RAW = f"""{PT}, raw as (
  select * from pt where isfinite(x) and isfinite(y) and isfinite(z) and z > 0)"""

FRAMES = "frames as (select cast(label as varchar) as camera, vec_id as frame_id from embeddings)"

LINES = """src as (
  select l_suppkey as frame_id,
    row_number() over (partition by l_suppkey order by l_orderkey, l_partkey, l_suppkey,
      l_linenumber, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag,
      l_linestatus, l_shipdate) - 1 as idx,
    ((l_quantity - 25.5) / 50.0)::float as x,
    (l_discount * 10.0 - 0.5)::float as y,
    (l_extendedprice / 50000.0)::float as z
  from lineitem),
frames as (select distinct l_suppkey as frame_id from lineitem)"""


def crop_where(x=None, y=None, z=None) -> str:
    parts = []
    for axis, bounds in zip("xyz", (x, y, z), strict=True):
        if bounds is not None:
            parts.append(f"{axis} between {bounds[0]}::float and {bounds[1]}::float")
    return " and ".join(parts) or "true"


def voxels(voxel: float) -> str:
    return ", ".join(f"floor({a} / {voxel}::float)" for a in "xyz")


def sampled(
    keys: str,
    mode: str,
    k: int,
    voxel: float = 0.01,
    seed: int = 42,
    stride: int = 1,
    pad: str = "repeat",
    src: str = "src",
    frames: str = "frames",
    extra: str = "",
) -> str:
    """CTEs ending in ``outp``: the padded sample of ``src`` for all ``frames``."""
    cols = "x, y, z" + (f", {extra}" if extra else "")
    zeros = ", ".join(f"0.0::float as {c.strip()}" for c in cols.split(","))
    if mode.startswith("voxel"):
        cand = (
            f"rep as (select {keys}, min(idx) as idx from {src} group by {keys}, {voxels(voxel)}), "
            f"cand as (select {src}.* from {src} join rep using ({keys}, idx))"
        )
    else:
        cand = f"cand as (select * from {src})"
    if mode.endswith("random"):
        order = f"md5(concat_ws(':', '{seed}', {keys}, idx)), idx"
    else:
        order = "idx"
    ranked = (
        f"ranked as (select *, row_number() over (partition by {keys} order by {order}) as rn "
        "from cand)"
    )
    if mode == "stride":
        sel = (
            f"sel as (select *, (rn - 1) // {stride} as rnk from ranked "
            f"where (rn - 1) % {stride} = 0 and rn <= {stride * k})"
        )
    elif mode.endswith("fps"):
        sel = f"""pk as (select {keys}, list(idx order by idx) as ii, list(x order by idx) as xs,
            list(y order by idx) as ys, list(z order by idx) as zs, count(*)::int as n
          from cand group by {keys}),
        st as (
          select {keys}, ii, xs, ys, zs, n, 0 as rnk, 1 as cur,
            list_transform(xs, lambda q: 'inf'::float) as dist from pk
          union all
          select {keys}, ii, xs, ys, zs, n, rnk + 1, list_position(nd, list_max(nd))::int, nd
          from (select *, list_transform(range(1, n + 1), lambda j: least(dist[j],
              ((xs[j] - xs[cur]) * (xs[j] - xs[cur]) + (ys[j] - ys[cur]) * (ys[j] - ys[cur]))
              + (zs[j] - zs[cur]) * (zs[j] - zs[cur]))) as nd
            from st where rnk + 1 < least({k}, n))),
        picks as (select {keys}, rnk, ii[cur] as idx from st),
        sel as (select cand.*, picks.rnk from picks join cand using ({keys}, idx))"""
    else:
        # The filter reads the 1-based rank: DuckDB 2.0 drops one row per group when a
        # row number is shifted before it is limited.
        sel = f"sel as (select *, rn - 1 as rnk from ranked where rn <= {k})"
    sized = f"sized as (select *, count(*) over (partition by {keys}) as n from sel)"
    if pad == "repeat":
        filled = f"select {keys}, unnest(range(rnk, {k}, n))::int as slot, rnk, {cols} from sized"
        body = f"select {keys}, slot, {cols}, slot <> rnk as is_pad from ({filled})"
    else:
        body = (
            f"select {keys}, rnk::int as slot, {cols}, false as is_pad from sized union all "
            f"select {keys}, unnest(range(n, {k}))::int, {zeros}, true from sized where rnk = 0"
        )
    missing = (
        f"select {keys}, unnest(range({k}))::int as slot, {zeros}, true as is_pad "
        f"from (select {keys} from {frames} except select {keys} from sel)"
    )
    return f"{cand}, {ranked}, {sel}, {sized}, outp as ({body} union all {missing})"


def with_(*ctes: str, select: str, recursive: bool = False) -> str:
    word = "with recursive" if recursive else "with"
    return f"{word} " + ", ".join(ctes) + " " + select
