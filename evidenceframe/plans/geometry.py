"""Queries on boxes, localisation and masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes
from ..operators import candidates, masks, metrics
from ..sources.fixtures import read
from .evidence import _short

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]
KEYS = ", ".join(KEY)


def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_box")
    return rows.select(*KEY, boxes.box("px1", "py1", "px2", "py2").alias("p"), boxes.box("gx1", "gy1", "gx2", "gy2").alias("g"))


O = """o as (select *, greatest(0, px2 - px1) * greatest(0, py2 - py1) as pa, greatest(0, gx2 - gx1) * greatest(0, gy2 - gy1) as ga,
    greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) as i from fx_box),
m as (select *, case when pa + ga - i = 0 then 0.0::double else i / (pa + ga - i) end as iou, case when least(pa, ga) = 0 then 0.0::double else i / least(pa, ga) end as iom,
    case when ga = 0 then 0.0::double else i / ga end as cov, case when pa = 0 then 0.0::double else i / pa end as prec,
    (px1 + px2) / 2 between gx1 and gx2 and (py1 + py2) / 2 between gy1 and gy2 as hit from o),
h as (select *, iou >= 0.5 as strict, iou >= 0.3 or iom >= 0.5 or cov >= 0.7 or (hit and cov >= 0.5) as relaxed from m)"""  # noqa: E741


@query(f"with {O} select {KEYS}, pa as pred_area, i as overlap, iou, iom, cov as coverage, prec as precision from m")
def box_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("p"), F.col("g")
    rows = _boxes(spark, sf_dir)
    return rows.select(*KEY, boxes.area(p).alias("pred_area"), boxes.intersection(p, g).alias("overlap"), boxes.iou(p, g).alias("iou"), boxes.iom(p, g).alias("iom"), boxes.coverage(p, g).alias("coverage"), boxes.precision(p, g).alias("precision"))


@query(f"with {O} select {KEYS}, hit as center_hit, strict as strict_hit, relaxed as relaxed_hit from h")
def localization_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g = F.col("p"), F.col("g")
    return _boxes(spark, sf_dir).select(*KEY, boxes.center_hit(p, g).alias("center_hit"), boxes.strict_hit(p, g).alias("strict_hit"), boxes.relaxed_hit(p, g).alias("relaxed_hit"))


@query(f"""select {KEYS}, round(iou3d, 9) as iou3d from (select *, case when u = 0 then 0.0::double else i / u end as iou3d from (select *, pa * pd + ga * gd - i as u from (
  select {KEYS}, greatest(0, px2 - px1) * greatest(0, py2 - py1) as pa, greatest(0, gx2 - gx1) * greatest(0, gy2 - gy1) as ga, 3 as pd, 4 as gd,
    greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) * greatest(0, least(l_linenumber + 3, l_linenumber % 3 + 4) - greatest(l_linenumber, l_linenumber % 3)) as i from fx_box)))""")
def box_overlap_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    z, w = F.col("l_linenumber"), F.col("l_linenumber") % 3
    deep = lambda b, low, d: F.struct(*(b[n].alias(n) for n in ("x1", "y1", "x2", "y2")), low.alias("z1"), (low + d).alias("z2"))
    return _short(_boxes(spark, sf_dir).select(*KEY, boxes.iou3d(deep(F.col("p"), z, 3), deep(F.col("g"), w, 4)).alias("iou3d")))


C = """c as (select *, greatest(0, least(gx1, 199)) as ax, greatest(0, least(gx2, 199)) as bx, greatest(0, least(gy1, 99)) as ay, greatest(0, least(gy2, 99)) as by_ from {0}),
d as (select *, least(ax, bx) as x1, greatest(ax, bx) as x2, least(ay, by_) as y1, greatest(ay, by_) as y2 from c)"""


@query(f"""with {C.format('fx_box')} select {KEYS}, case when x2 <= x1 and x1 >= 199 then greatest(0, x1 - 1) else x1 end as x1, case when y2 <= y1 and y1 >= 99 then greatest(0, y1 - 1) else y1 end as y1,
  case when x2 <= x1 and x1 < 199 then x1 + 1 else x2 end as x2, case when y2 <= y1 and y1 < 99 then y1 + 1 else y2 end as y2 from d""")
def box_clamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*KEY, boxes.non_empty(F.col("g"), 200, 100).alias("b")).select(*KEY, "b.*")


@query(f"""with e as (select *, round_even((px2 - px1) * 0.15::double, 0)::int as dx, round_even((py2 - py1) * 0.15::double, 0)::int as dy, greatest(0, px2 - px1) * greatest(0, py2 - py1) <= 0 as none from fx_box)
select {KEYS}, case when none then px1 else greatest(0, px1 - dx) end as x1, case when none then py1 else greatest(0, py1 - dy) end as y1, case when none then px2 else least(280, px2 + dx) end as x2,
  case when none then py2 else least(280, py2 + dy) end as y2 from e""")
def box_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).select(*KEY, boxes.expand(F.col("p"), 280, 280, 0.15).alias("b")).select(*KEY, "b.*")


@query("""select l_orderkey, coalesce(min(gx1) filter (gx2 > gx1 and gy2 > gy1), 0) as x1, coalesce(min(gy1) filter (gx2 > gx1 and gy2 > gy1), 0) as y1,
  coalesce(max(gx2) filter (gx2 > gx1 and gy2 > gy1), 0) as x2, coalesce(max(gy2) filter (gx2 > gx1 and gy2 > gy1), 0) as y2 from fx_box group by l_orderkey""")
def box_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _boxes(spark, sf_dir).groupBy("l_orderkey").agg(boxes.union_agg(F.col("g")).alias("b")).select("l_orderkey", "b.*")


_MODE_SQL = {
    "identity": ("px1", "py1", "px2", "py2"), "flip_x": ("200 - px2", "py1", "200 - px1", "py2"), "flip_y": ("px1", "300 - py2", "px2", "300 - py1"), "flip_xy": ("200 - px2", "300 - py2", "200 - px1", "300 - py1"),
    "swap_xy": ("py1", "px1", "py2", "px2"), "swap_xy_flip_x": ("300 - py2", "px1", "300 - py1", "px2"), "swap_xy_flip_y": ("py1", "200 - px2", "py2", "200 - px1"), "swap_xy_flip_xy": ("300 - py2", "200 - px2", "300 - py1", "200 - px1"),
}


@query(" union all ".join(
    f"select {KEYS}, '{m}' as mode, " + ", ".join(f"round_even(({e}) * ({to}::double / {(300 if m.startswith('swap') else 200) if n[0] == 'x' else (200 if m.startswith('swap') else 300)}), 0)::int as {n}" for e, n, to in zip(s, ("x1", "y1", "x2", "y2"), (280, 140, 280, 140))) + " from fx_box"
    for m, s in _MODE_SQL.items()
))
def box_remap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return boxes.rescaled(_boxes(spark, sf_dir), F.col("p"), 200, 300, 280, 140).select(*KEY, "mode", "x1", "y1", "x2", "y2")


@query(f"""with r as (select *, greatest(1, px2 - px1) as bw, greatest(1, py2 - py1) as bh from fx_box), n as (select *, (px1 + bw / 2) / 280 as cx, (py1 + bh / 2) / 280 as cy, bw / 280 as w, bh / 280 as h from r),
b as (select *, round_even(cx * 280 - (w * 280) / 2, 0)::int as gx1_, round_even(cy * 280 - (h * 280) / 2, 0)::int as gy1_, round_even(cx * 280 + (w * 280) / 2, 0)::int as gx2_, round_even(cy * 280 + (h * 280) / 2, 0)::int as gy2_ from n)
select {KEYS}, round(cx, 9) as cx, round(cy, 9) as cy, round(w, 9) as w, round(h, 9) as h, greatest(0, least(gx1_, 279)) as x1, greatest(0, least(gy1_, 279)) as y1, greatest(0, least(gx2_, 279)) as x2, greatest(0, least(gy2_, 279)) as y2 from b""")
def box_yolo_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).select(*KEY, boxes.to_relative(F.col("p"), 280, 280).alias("r"))
    return _short(rows.select(*KEY, "r.*", boxes.from_relative(F.col("r"), 280, 280).alias("b")).select(*KEY, "cx", "cy", "w", "h", "b.*"))


@query(f"with {O}, t as (select unnest([0.3, 0.5, 0.7])::double as threshold) select threshold, count(*) filter (iou >= threshold) as hits, count(*) as total, round(count(*) filter (iou >= threshold) / count(*), 9) as recall from m, t group by threshold")
def recall_at_iou(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _boxes(spark, sf_dir).withColumn("iou", boxes.iou(F.col("p"), F.col("g")))
    return _short(metrics.recall_at(rows, [0.3, 0.5, 0.7], "iou"))


@query(f"""with {O}, b as (select *, l_partkey % 3 = 0 as right_label from h) select count(*) as total, round(avg(iou), 9) as mean_iou, count(*) filter (strict) as strict_hits, count(*) filter (relaxed) as relaxed_hits,
  count(*) filter (strict and right_label) as strict_joint, count(*) filter (relaxed and right_label) as relaxed_joint from b""")
def joint_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g, right = F.col("p"), F.col("g"), F.col("l_partkey") % 3 == 0
    rows = _boxes(spark, sf_dir).select(boxes.iou(p, g).alias("iou"), boxes.strict_hit(p, g).alias("s"), boxes.relaxed_hit(p, g).alias("r"), right.alias("c"))
    return _short(rows.agg(F.count(F.lit(1)).alias("total"), F.avg("iou").alias("mean_iou"), F.count_if("s").alias("strict_hits"), F.count_if("r").alias("relaxed_hits"), F.count_if(F.col("s") & F.col("c")).alias("strict_joint"), F.count_if(F.col("r") & F.col("c")).alias("relaxed_joint")))


def _ranked_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..operators.ranking import ranked

    rows = _boxes(spark, sf_dir).withColumn("iou", F.round(boxes.iou(F.col("p"), F.col("g")), 9))
    return ranked(rows, ["l_orderkey"], [F.col("l_linenumber"), F.col("l_partkey"), F.col("l_suppkey"), F.col("iou")], "rank")


_RANKED = f"with {O}, k as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, round(iou, 9)) as rank from h)"


@query(f"""{_RANKED}, b as (select l_orderkey, max(iou) filter (rank <= 1) as b1, max(iou) filter (rank <= 3) as b3 from k group by l_orderkey),
g as (select unnest([1, 3]) as top_k), t as (select unnest([0.3, 0.5])::double as threshold)
select top_k, threshold, count(*) filter (case when top_k = 1 then b1 else b3 end >= threshold) as hits, count(*) as total, round(count(*) filter (case when top_k = 1 then b1 else b3 end >= threshold) / count(*), 9) as recall from b, g, t group by all""")
def topk_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.topk_recall(_ranked_boxes(spark, sf_dir), "l_orderkey", "rank", "iou", [1, 3], [0.3, 0.5]))


@query(f"{_RANKED} select l_orderkey, max((iou >= 0.5)::int) as any_strict, max(relaxed::int) as any_relaxed, max((relaxed and l_partkey % 3 = 0)::int) as any_joint from k where rank <= 3 group by l_orderkey")
def any_hit_oracle(spark: SparkSession, sf_dir: str) -> DataFrame:
    relaxed = boxes.relaxed_hit(F.col("p"), F.col("g"))
    return metrics.any_hit(_ranked_boxes(spark, sf_dir).where("rank <= 3"), "l_orderkey", {"any_strict": F.col("iou") >= 0.5, "any_relaxed": relaxed, "any_joint": relaxed & (F.col("l_partkey") % 3 == 0)})


def _mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "fx_mask")


@query("select case_id, z, count(*) filter (pred > 0) as area from fx_mask group by all")
def mask_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.areas(_mask(spark, sf_dir))


@query("select case_id, z, coalesce(min(x) filter (pred > 0), 0) as x1, coalesce(min(y) filter (pred > 0), 0) as y1, coalesce(max(x + 1) filter (pred > 0), 0) as x2, coalesce(max(y + 1) filter (pred > 0), 0) as y2 from fx_mask group by all")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.boxes(_mask(spark, sf_dir))


@query("""select case_id, coalesce(min(x) filter (gt > 0), 0) as x1, coalesce(min(y) filter (gt > 0), 0) as y1, coalesce(min(z) filter (gt > 0), 0) as z1, coalesce(max(x + 1) filter (gt > 0), 0) as x2,
  coalesce(max(y + 1) filter (gt > 0), 0) as y2, coalesce(max(z + 1) filter (gt > 0), 0) as z2 from fx_mask group by case_id""")
def mask_bbox_3d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.boxes3d(_mask(spark, sf_dir), "gt")


@query("select case_id, z, round(case when sum(pred) + sum(gt) = 0 then 1.0::double else 2.0::double * sum(pred * gt) / (sum(pred) + sum(gt)) end, 9) as dice from fx_mask group by all")
def mask_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(masks.dice(_mask(spark, sf_dir), keys=["case_id", "z"]))


@query("with a as (select case_id, z, count(*) filter (pred > 0) as area from fx_mask group by all) select case_id, z, area from a qualify row_number() over (partition by case_id order by area desc, z) = 1")
def slice_argmax(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.largest_slice(_mask(spark, sf_dir))


_COMPONENTS = """with recursive p as (select case_id, z, y, x, y * 8 + x as id from fx_mask where pred > 0),
r(case_id, z, id, root) as (select case_id, z, id, id from p union select n.case_id, n.z, n.id, r.root from r join p q on q.case_id = r.case_id and q.z = r.z and q.id = r.id
  join p n on n.case_id = r.case_id and n.z = r.z and abs(n.y - q.y) + abs(n.x - q.x) = 1),
c as (select case_id, z, id, min(root) as root from r group by all),
d as (select case_id, z, id, dense_rank() over (partition by case_id, z order by root) as component from c)"""


@query(_COMPONENTS + " select case_id, z, cast(id // 8 as bigint) as y, cast(id % 8 as bigint) as x, component from d")
def mask_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.components(_mask(spark, sf_dir))


_STATS = _COMPONENTS + """, s as (select case_id, z, component, count(*) as area, min(id % 8) as x1, min(id // 8) as y1, max(id % 8) + 1 as x2, max(id // 8) + 1 as y2,
    bool_or(id % 8 in (0, 7) or id // 8 in (0, 7)) as touches_border from d group by all),
t as (select *, area / max(area) over (partition by case_id, z) as ratio, (x2 - x1) as w, (y2 - y1) as h, ((x1 + x2) / 2 - 4) / 4 as dx, ((y1 + y2) / 2 - 4) / 4 as dy from s),
u as (select *, round(1.35::double * ratio + 0.45::double * area / (w * h) + 0.35::double * greatest(0.0, 1 - least(sqrt(dx * dx + dy * dy), 1.0)) - 0.35::double * least(greatest(greatest(w / h, h / w) - 3, 0) / 5, 1)
    - case when touches_border then 0.15::double else 0.0::double end, 9) as score from t)"""


@query(_STATS + " select case_id, z, component, area, touches_border, round(ratio, 9) as area_ratio, round(score, 9) as score, row_number() over (partition by case_id, z order by score desc, area desc, component) as rank from u where area >= 2 and ratio >= 0.15 qualify rank <= 3")
def component_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = masks.component_stats(masks.components(_mask(spark, sf_dir)), 8, 8)
    out = candidates.component_candidates(stats, 3, 2, 0.15)
    return _short(out.select("case_id", "z", "component", "area", "touches_border", "area_ratio", "score", "rank"))


_AREAS = "a as (select case_id, z, count(*) filter (pred > 0) as area from fx_mask group by all)"


@query(f"""with {_AREAS}, n as (select a.case_id, a.z, a.area, b.z as nz, abs(b.z - a.z) as d, b.area as na from a left join a b on a.case_id = b.case_id and b.area > 0 and b.z <> a.z and abs(b.z - a.z) <= 3)
select case_id, z, area, nz as neighbour, d as distance, na as neighbour_area from n qualify row_number() over (partition by case_id, z order by d, na desc, nz) = 1""")
def adjacent_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.adjacent_slices(masks.areas(_mask(spark, sf_dir)), 3)


@query(f"""with {_AREAS}, n as (select a.case_id, a.z, a.area, b.z as nz, abs(b.z - a.z) as d, b.area as na from a left join a b on a.case_id = b.case_id and b.area > 0 and b.z <> a.z and abs(b.z - a.z) <= 3)
select case_id, z, area, nz as neighbour, d as distance, na as neighbour_area from n qualify row_number() over (partition by case_id, z order by na desc nulls last, d, nz) = 1""")
def adjacent_slice_by_area(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.adjacent_slices(masks.areas(_mask(spark, sf_dir)), 3, "max_area_within_radius")


@query(f"""with {_AREAS}, n as (select a.case_id, a.z, a.area, b.z as nz from a left join a b on a.case_id = b.case_id and b.area > 0 and b.z <> a.z and abs(b.z - a.z) <= 3
  qualify row_number() over (partition by a.case_id, a.z order by abs(b.z - a.z), b.area desc, b.z) = 1),
k as (select case_id, z, count(*) as kept from (select case_id, z from fx_mask where pred > 0 group by all having count(*) >= 3) group by all)
select n.case_id, n.z, case when n.area > 0 and k.kept > 0 then 'filtered_components' when n.area > 0 then 'largest_component_fallback' when nz is not null and m.kept > 0 then 'adjacent_slice_fallback'
  when nz is not null then 'adjacent_slice_largest_component_fallback' else 'pred_mask_empty' end as final_candidate_source, n.area = 0 as pred_mask_empty, case when n.area = 0 then nz else n.z end as candidate_slice
from n left join k on n.case_id = k.case_id and n.z = k.z left join k m on n.case_id = m.case_id and n.nz = m.z""")
def candidate_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = candidates.adjacent_slices(masks.areas(_mask(spark, sf_dir)), 3)
    kept = masks.areas(_mask(spark, sf_dir)).where("area >= 3").select("case_id", "z", F.lit(1).alias("n_kept"))
    own = near.join(kept, ["case_id", "z"], "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    theirs = kept.select("case_id", F.col("z").alias("neighbour"), F.col("n_kept").alias("neighbour_kept"))
    rows = own.join(theirs, ["case_id", "neighbour"], "left").withColumn("neighbour_kept", F.coalesce("neighbour_kept", F.lit(0)))
    return candidates.candidate_state(rows).select("case_id", "z", "final_candidate_source", "pred_mask_empty", "candidate_slice")


@query("select case_id, z, 7 - x as y, y as x, pred from fx_mask")
def mask_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.transform(_mask(spark, sf_dir), 8, 8, "swap_xy_flip_y").select("case_id", "z", "y", "x", "pred")


@query("with t as (select unnest(range(5)) as n), u as (select n, cast(floor((n + 0.5) * 8 / 5) as int) as s from t) select m.case_id, m.z, a.n as y, b.n as x, m.pred from fx_mask m join u a on a.s = m.y join u b on b.s = m.x")
def mask_resize(spark: SparkSession, sf_dir: str) -> DataFrame:
    return masks.resize(_mask(spark, sf_dir), 8, 8, 5, 5).select("case_id", "z", "y", "x", "pred")


@query("""with v as (select vec_id as case_id, 0 as z, unnest(range(64)) as pos, cast(unnest(embedding) as double) as v from embeddings)
select case_id, z, pos, cast(trunc((v - min(v) over (partition by case_id)) / (max(v) over (partition by case_id) - min(v) over (partition by case_id)) * 255) as int) as byte from v""")
def slice_to_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("case_id"), F.lit(0).alias("z"), F.posexplode("embedding").alias("pos", "v"))
    return masks.to_bytes(rows).select("case_id", "z", F.col("pos").cast("long").alias("pos"), "byte")


@query(f"""with {_AREAS}, f as (select case_id, z from a where area > 0 qualify row_number() over (partition by case_id order by area desc, z) = 1) select distinct a.case_id, coalesce(f.z, 0) as z from a left join f using (case_id)""")
def slice_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.choose_slice(_mask(spark, sf_dir))


@query("select case_id, z, min(x) as x1, min(y) as y1, max(x + 1) as x2, max(y + 1) as y2 from fx_mask where pred > 0 group by all")
def slice_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.slice_box(_mask(spark, sf_dir))


@query(_STATS + ", k as (select * from u qualify row_number() over (partition by case_id, z order by area desc, component) <= 2) select case_id, z, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2 from k group by all")
def slice_boxes_of_two(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.slice_box(_mask(spark, sf_dir), "topk_components_union", 2)


@query("""with b as (select case_id, min(x) filter (pred > 0) as px1, min(y) filter (pred > 0) as py1, min(z) filter (pred > 0) as pz1, max(x + 1) filter (pred > 0) as px2, max(y + 1) filter (pred > 0) as py2, max(z + 1) filter (pred > 0) as pz2,
  min(x) filter (gt > 0) as gx1, min(y) filter (gt > 0) as gy1, min(z) filter (gt > 0) as gz1, max(x + 1) filter (gt > 0) as gx2, max(y + 1) filter (gt > 0) as gy2, max(z + 1) filter (gt > 0) as gz2,
  2.0::double * sum(pred * gt) / (sum(pred) + sum(gt)) as dice from fx_mask group by case_id),
o as (select *, greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) * greatest(0, least(pz2, gz2) - greatest(pz1, gz1)) as i from b)
select count(*) as cases, round(avg(dice), 9) as mean_dice, round(count(*) filter (i / ((px2 - px1) * (py2 - py1) * (pz2 - pz1) + (gx2 - gx1) * (gy2 - gy1) * (gz2 - gz1) - i) >= 0.5) / count(*), 9) as recall_3d from o""")
def segmentation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(masks.segmentation_metrics(_mask(spark, sf_dir)))
