"""Registered queries of the file formats: volumes, data sets, slice exports, listings, ordered files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, coerce, text
from ..operators import checks, matching, metrics
from ..sources import exports, readers, sinks, staging, volumes
from ..sources.fixtures import read
from ..sources.scratch import scratch_dir

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """fx_mask as volumes: a case by label, masks from gt, intensities by place and prediction; cases from 5 on are for testing."""
    p = read(spark, sf_dir, "fx_mask").select(F.concat(F.lit("case_"), "case_id").alias("case_id"), F.col("case_id").alias("label"), "z", "y", "x", (F.col("pred") * 100 + F.col("y") * 8 + F.col("x")).alias("v"), F.col("gt").alias("mask"))
    rows = volumes.slices_of_pixels(p, 8, 8)
    return rows.withColumn("split", F.when(F.substring("case_id", 6, 9).cast("int") < 5, "train").otherwise("val"))


def _halved(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, with masks of 4 by 4 in even cases."""
    even = F.substring("case_id", 6, 9).cast("int") % 2 == 0
    small = F.filter("mask", lambda m, i: (i % 8 < 4) & (i < 32))
    side = F.when(even, 4).otherwise(8)
    return _slices(spark, sf_dir).withColumns({"mask_height": side, "mask_width": side, "mask": F.when(even, small).otherwise(F.col("mask"))})


def _total(c: str) -> Column:
    return F.aggregate(c, F.lit(0.0), lambda s, v: s + v).cast("double")


@query("""with d as (select case_id, count(distinct z)::int as depth from fx_mask group by case_id) select 'case_' || m.case_id as case_id, z::int as z, depth, 8 as height, 8 as width, sum(pred * 100 + y * 8 + x)::double as intensity,
  (case when m.case_id % 2 = 0 then 4 * sum(gt) filter (x < 4 and y < 4) else sum(gt) end)::double as area, (case when m.case_id % 2 = 0 then 4 * sum(gt * x) filter (x < 4 and y < 4) * 2 + 2 * sum(gt) filter (x < 4 and y < 4) else sum(gt * x) end)::double as x_sum
  from fx_mask m join d using (case_id) group by m.case_id, m.z, d.depth""")
def npz_volume_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volumes written and read slice by slice; small masks come back at the image's size."""
    path = scratch_dir(spark)
    volumes.write_volumes(_halved(spark, sf_dir), path, "npz")
    rows = volumes.accepted(volumes.read_volumes(spark, path, "npz"))
    x_sum = F.aggregate(F.transform("mask", lambda m, i: m * (i % 8)), F.lit(0.0), lambda s, v: s + v).alias("x_sum")
    return rows.select("case_id", "z", "depth", "height", "width", _total("image").alias("intensity"), _total("mask").alias("area"), x_sum)


@query("""select 'case_' || case_id as case_id, case when case_id < 5 then 'train' else 'test' end as split, z::int as z, y::int as y, x::int as x, (pred * 100 + y * 8 + x)::double as v, gt as mask from fx_mask""")
def volume_dataset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A NIfTI data set, written by tasks and read back: every voxel of image and mask."""
    path = scratch_dir(spark)
    volumes.write_volumes(_slices(spark, sf_dir), path, "nifti")
    rows = volumes.accepted(volumes.read_volumes(spark, path, "nifti"))
    splits = rows.select("case_id", "split").distinct()
    pixels = volumes.pixels_of_slices(rows).join(splits, "case_id")
    return pixels.select("case_id", "split", "z", "y", "x", F.col("v").cast("double").alias("v"), "mask")


@query("select 'Dataset007_spine' as dataset_name, '.nii.gz' as file_ending, count(distinct case_id) filter (case_id < 5) as training, count(distinct case_id) filter (case_id >= 5) as test, 2 * count(distinct case_id) as files from fx_mask")
def volume_dataset_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a data set's document says, and the volumes that lie beside it."""
    path = scratch_dir(spark)
    volumes.write_volumes(_slices(spark, sf_dir), path, "nifti", datasetName="spine", datasetId=7)
    document = readers.read_json(spark, f"{path}/dataset.json", "dataset_name string, file_ending string, numTraining long, numTest long")
    files = readers.listing(spark, path, "*.nii.gz").agg(F.count(F.lit(1)).alias("files"))
    return document.select("dataset_name", "file_ending", F.col("numTraining").alias("training"), F.col("numTest").alias("test")).join(F.broadcast(files))


@query("select 'case_' || case_id as case_id, z::bigint as z, y::bigint as y, x::bigint as x from fx_mask where gt = 1")
def nifti_mask_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive voxels of NIfTI files that Spark reads."""
    path = scratch_dir(spark)
    volumes.write_volumes(_slices(spark, sf_dir), path, "nifti")
    found = readers.files(spark, path, "*.nii.gz").where(F.col("path").contains("/labelsT"))
    return readers.nifti_masks(found.withColumn("case_id", text.stem(text.stem("path"))))


@query("select 'broken_' || label as case_id, count(*)::bigint as vectors, label % 2 = 0 as is_archive from embeddings group by label")
def rejected_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that are no volumes: archives without arrays (an empty one is 22 bytes), and plain text."""
    path = scratch_dir(spark)
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy("label").agg(F.count(F.lit(1)).alias("vectors"))
    empty = F.unhex(F.lit("504b0506" + "00" * 18))
    content = F.when(F.col("label") % 2 == 0, empty).otherwise(F.concat(F.lit("vectors "), "vectors").cast("binary"))
    staging.write_named(labels.select(F.concat(F.lit("broken_"), "label", F.lit(".npz")).alias("name"), content.alias("content")), path)
    found = volumes.rejected(volumes.read_volumes(spark, path, "npz"))
    names = labels.select(F.concat(F.lit("broken_"), "label").alias("case_id"), "vectors")
    return found.join(names, "case_id").select("case_id", "vectors", F.col("error").startswith("no array").alias("is_archive"))


#: Largest component of each slice of fx_mask (4-connected): labels spread by iteration over a grid of 8 by 8.
_LARGEST = """with recursive g as (select case_id, z, x, y, y * 8 + x as id from fx_mask where gt = 1),
grow as (select case_id, z, x, y, id as root from g union select n.case_id, n.z, n.x, n.y, r.root from grow r join g n on n.case_id = r.case_id and n.z = r.z and abs(n.x - r.x) + abs(n.y - r.y) = 1 where r.root < n.id),
own as (select case_id, z, x, y, min(root) as root from grow group by all),
part as (select case_id, z, root, count(*) as n, min(x)::int as x1, min(y)::int as y1, max(x)::int as x2, max(y)::int as y2 from own group by all),
best as (select * from part qualify row_number() over (partition by case_id, z order by n desc, root) = 1),
m as (select a.case_id, a.z, a.area, coalesce(x1, 0) as x1, coalesce(y1, 0) as y1, coalesce(x2, 0) as x2, coalesce(y2, 0) as y2,
  case when a.case_id < 5 then 'train' else 'val' end as split, case when a.case_id % 3 = 0 then 'infection' else 'tumor' end as label, a.area >= 20 as lesion
  from (select case_id, z, sum(gt)::bigint as area from fx_mask group by case_id, z) a left join best b on a.case_id = b.case_id and a.z = b.z)"""


def _exported(spark: SparkSession, sf_dir: str) -> tuple[str, dict[str, int]]:
    path = scratch_dir(spark)
    rows = _slices(spark, sf_dir)
    volumes.write_volumes(rows, f"{path}/volumes", "npz")
    k = F.substring("case_id", 6, 9).cast("int")
    cases = rows.select("case_id").distinct().select(
        "case_id", F.concat(F.lit("p"), k % 7).alias("patient_id"), (k % 3 + 1).cast("string").alias("seq_id"), F.when(k % 3 == 0, "infection").otherwise("tumor").alias("label"),
        F.when(k < 5, " Train").otherwise("val").alias("split"), F.concat("case_id", F.lit(".npz")).alias("npz_name"), (-k).alias("pos"),
    )
    slices = volumes.read_volumes(spark, f"{path}/volumes", "npz", pixels="false")
    return path, exports.export_slices(slices, cases, f"{path}/export", "data/", "v1")


@query(f"""{_LARGEST} select 'p' || case_id % 7 as patient_id, 'case_' || case_id as case_id, split, z::int as slice_idx, 'data/' || split || '/image/p' || case_id % 7 || '_' || case_id % 3 + 1 || '_cls_' || (case when label = 'infection' then 0 else 1 end) || '_layer_' || z || '.jpg' as image_path,
  area as mask_area, lesion::int as has_lesion, x1 as bbox_x1, y1 as bbox_y1, x2 as bbox_x2, y2 as bbox_y2, '8x8' as image_shape, row_number() over (order by case_id desc, z) as place from m""")
def export_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of a slice export, and its rows' places in the order of its files."""
    path, _ = _exported(spark, sf_dir)
    kinds = {"slice_idx": "int", "mask_area": "long", "has_lesion": "int", "bbox_x1": "int", "bbox_y1": "int", "bbox_x2": "int", "bbox_y2": "int"}
    rows = readers.numbered(readers.read_csv(spark, f"{path}/export/slice_manifest"), "place")
    names = ["patient_id", "case_id", "split", "slice_idx", "image_path", "mask_area", "has_lesion", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "image_shape"]
    return rows.select(*(F.col(c).cast(kinds.get(c, "string")).alias(c) for c in names), (F.col("place") + 1).cast("long").alias("place"))


@query(f"""{_LARGEST}, r as (select *, row_number() over (partition by split order by case_id desc, z) as n, case case_id % 3 + 1 when 1 then 'T1' when 2 then 'T2' else 'seq3' end as seq from m where lesion),
t as (select unnest([false, true]) as hidden) select case when hidden then split || '_hidden' else split end as part, printf('v1_%s_%06d', split, n) as id,
  '现在你是一个骨科专家，这是一幅脊椎的磁共振图像,序列为' || seq || '。该图像中可能包含了数个病灶，然后我会将最大病灶的坐标位置按照[x1,y1,x2,y2]的格式给出：该张图片中的最大病灶在' ||
  (case when hidden then '[x1,y1,x2,y2]' else '[' || x1 || ',' || y1 || ',' || x2 || ',' || y2 || ']' end) || '这个位置。请你帮我判断这个病灶属于感染还是肿瘤。 <|vision_start|>data/' || split || '/image/p' || case_id % 7 || '_' || case_id % 3 + 1 || '_cls_' ||
  (case when label = 'infection' then 0 else 1 end) || '_layer_' || z || '.jpg<|vision_end|>' as question, '这个病灶的类型为' || (case label when 'infection' then '感染' else '肿瘤' end) || '。' as answer, area as mask_area from r, t""")
def export_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four record files of a slice export."""
    path, _ = _exported(spark, sf_dir)

    def part(name: str) -> DataFrame:
        rows = readers.read_json(spark, f"{path}/export/{name}", readers.RECORD_SCHEMA)
        value = lambda i: F.element_at("conversations", i)["value"]
        return rows.select(F.lit(name).alias("part"), "id", value(1).alias("question"), value(2).alias("answer"), F.col("slice_manifest.mask_area").alias("mask_area"))

    first, *others = map(part, ("train", "val", "train_hidden", "val_hidden"))
    for other in others:
        first = first.unionByName(other)
    return first


@query(f"""{_LARGEST}, c as (select split as name, lesion from m union all select label || '_' || split, lesion from m), n as (select name || '_all_slices' as counter, count(*) as n from c group by name union all select name || '_lesion_slices', count(*) from c where lesion group by name)
select * from n union all select 'slices', count(*) from m""")
def export_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The counters a slice export observes while it runs, from its summary."""
    path, _ = _exported(spark, sf_dir)
    summary = readers.read_json(spark, f"{path}/export/export_summary.json", "counts map<string,long>")
    return summary.select(F.explode("counts").alias("counter", "n"))


def _checkpoints(spark: SparkSession, sf_dir: str) -> str:
    """Folders of a training run, by nation: a whole one, one without a file or without weights for others, and one that is no checkpoint."""
    path = scratch_dir(spark)
    nations = spark.read.parquet(f"{sf_dir}/nation.parquet")
    k = F.col("n_nationkey")
    needed = F.array(*map(F.lit, readers.CHECKPOINT_FILES))
    weights = F.when(k % 5 == 3, F.array().cast("array<string>")).when(k % 2 == 0, F.array(F.lit("adapter_model.bin"))).otherwise(F.array(F.lit("adapter_model.safetensors"), F.lit("notes.txt")))
    names = F.concat(F.when(k % 4 == 1, F.slice(needed, 2, 3)).otherwise(needed), weights)
    folder = F.when(k == 24, "checkpoint-last").otherwise(F.concat(F.lit("checkpoint-"), k * 50))
    files = nations.select(F.explode(names).alias("file"), folder.alias("folder"), "n_name")
    staging.write_named(files.select(F.concat_ws("/", "folder", "file").alias("name"), F.col("n_name").alias("content")), path)
    return path


@query("""select 'checkpoint-' || n_nationkey * 50 as folder, (n_nationkey * 50)::bigint as step, n_nationkey % 4 <> 1 and n_nationkey % 5 <> 3 as whole,
  concat_ws(',', case when n_nationkey % 5 = 3 then 'adapter_model.safetensors' end, case when n_nationkey % 4 = 1 then 'trainer_state.json' end) as missing from nation where n_nationkey < 24""")
def checkpoint_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Checkpoints of a folder, and what those that aren't whole lack."""
    found = readers.checkpoints(readers.listing(spark, _checkpoints(spark, sf_dir)))
    return found.select(F.regexp_extract("folder", "[^/]*$", 0).alias("folder"), "step", "whole", F.array_join("missing", ",").alias("missing"))


@query("select max(n_nationkey * 50)::bigint as step, 'checkpoint-' || max(n_nationkey * 50) as folder from nation where n_nationkey < 24 and n_nationkey % 4 <> 1 and n_nationkey % 5 <> 3")
def latest_checkpoint(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = readers.latest_checkpoint(readers.listing(spark, _checkpoints(spark, sf_dir)))
    return found.select("step", F.regexp_extract("folder", "[^/]*$", 0).alias("folder"))


@query("select o_orderkey, o_orderstatus, o_custkey, rank() over (order by o_orderstatus, o_custkey) as lowest from orders")
def ordered_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows sorted into files, read by file name: the place of each row's keys is where the first row with these keys stands."""
    path = scratch_dir(spark)
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus", "o_custkey")
    sinks.write_ordered(rows, path, ["o_orderstatus", "o_custkey"])
    found = readers.numbered(readers.read_csv(spark, path, "o_orderkey long, o_orderstatus string, o_custkey long"), "place")
    first = found.groupBy("o_orderstatus", "o_custkey").agg((F.min("place") + 1).cast("long").alias("lowest"), F.count(F.lit(1)).alias("n"), F.max("place").alias("last"))
    together = first.where(F.col("last") - F.col("lowest") + 2 == F.col("n"))
    return found.join(together, ["o_orderstatus", "o_custkey"]).select("o_orderkey", "o_orderstatus", "o_custkey", "lowest")


@query("select o_orderstatus as status, count(*) as rows, min(o_orderkey) as least, max(o_orderkey) as greatest from orders group by 1")
def ordered_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bounds of sorted files, from their manifests; no two files of a folder overlap."""
    rows, out = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_orderstatus"), []
    for status in ("F", "O", "P"):
        m = sinks.write_ordered(rows.where(F.col("o_orderstatus") == status), scratch_dir(spark), ["o_orderkey"], "parquet")
        out.append(m.select(F.lit(status).alias("status"), "rows", F.col("least.o_orderkey").alias("least"), F.col("greatest.o_orderkey").alias("greatest")))
    all_ = out[0].unionByName(out[1]).unionByName(out[2])
    return all_.groupBy("status").agg(F.sum("rows").alias("rows"), F.min("least").alias("least"), F.max("greatest").alias("greatest"))


@query("select 'labels/' || case when l_orderkey % 5 = 0 then 'val' else 'train' end || '/o' || l_orderkey || '.txt' as name, count(*) as lines, round(sum(((px1 + px2) / 2) / 1000.0::double), 4) as cx from fx_box where px2 > px1 and py2 > py1 and l_orderkey % 40 < 8 group by l_orderkey union all select 'lesion.yaml', 5, null")
def detector_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A detector's data set: a label file for each image and the document, read back by line."""
    path = scratch_dir(spark)
    rows = read(spark, sf_dir, "fx_box").where("px2 > px1 and py2 > py1 and l_orderkey % 40 < 8").select(
        F.when(F.col("l_orderkey") % 5 == 0, "val").otherwise("train").alias("split"), F.concat(F.lit("o"), "l_orderkey").alias("stem"), boxes.box("px1", "py1", "px2", "py2").alias("box"), F.lit(1000).alias("width"), F.lit(1000).alias("height"),
    )
    lines = readers.lines_of(sinks.write_detector_set(rows, path), path)
    return lines.groupBy("name").agg(F.count(F.lit(1)).alias("lines"), F.round(F.sum(F.when(F.col("name").startswith("labels"), F.split("value", " ")[1].cast("double"))), 4).alias("cx"))


# Readers, functions and checks that other queries don't meet.


@query("select n_nationkey % 3 as part, n_nationkey as key, n_name as name from nation")
def json_array_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files that each hold an array of records."""
    path = scratch_dir(spark)
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").withColumn("part", F.col("n_nationkey") % 3)
    for part in range(3):
        own = rows.where(F.col("part") == part)
        sinks.write_ordered_arrays(own.select(F.to_json(F.struct("part", F.col("n_nationkey").alias("key"), F.col("n_name").alias("name"))).alias("r"), (F.floor(F.col("n_nationkey") / 3) + 1).alias("i")), f"{path}/{part}", "r", "i", chunk=4)
    return readers.read_json(spark, f"{path}/*/*.json", "part long, key long, name string")


@query("select fold, case when fold = 0 then 'outer_test' when fold = 1 then 'inner_val' else 'inner_train' end as role, patient_id, row_number() over (order by fold, case when fold = 0 then 'outer_test' when fold = 1 then 'inner_val' else 'inner_train' end, patient_id) as place from fx_patient")
def assignment_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A protocol's assignments, in order across the files."""
    path, fold = scratch_dir(spark), F.col("fold")
    role = F.when(fold == 0, "outer_test").when(fold == 1, "inner_val").otherwise("inner_train")
    sinks.write_assignments(read(spark, sf_dir, "fx_patient").select("patient_id", role.alias("role"), "fold"), path)
    found = readers.numbered(readers.read_csv(spark, path, "fold long, role string, patient_id long"), "place")
    return found.select("fold", "role", "patient_id", (F.col("place") + 1).cast("long").alias("place"))


@query("select o_orderkey, coalesce(case when o_orderkey % 2 = 0 then o_orderstatus end, case when o_orderkey % 3 = 0 then o_orderpriority end, regexp_extract(o_orderkey || '_x', '^(\\d+)', 1)) as found from orders")
def attribute_fallbacks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first cell that holds text: a column, a field of a struct, what a text begins with."""
    k = F.col("o_orderkey")
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", F.when(k % 2 == 0, F.col("o_orderstatus")).otherwise(" ").alias("a"), F.struct(F.when(k % 3 == 0, F.col("o_orderpriority")).alias("b")).alias("s"), F.concat(k, F.lit("_x")).alias("t"))
    return rows.select("o_orderkey", coerce.first_present("a", F.col("s.b"), F.regexp_extract("t", r"^(\d+)", 1)).alias("found"))


@query("select o_orderkey, ['gt_label'] as reads_truth from orders where o_orderstatus = 'F'")
def columns_that_read_truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which of a decision's columns derive from the truth."""
    rows = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderstatus = 'F'").withColumns({"gt_label": F.lit("tumor"), "pred_label": F.lit("tumor"), "area": F.lit(1)})
    return rows.select("o_orderkey", F.array(*map(F.lit, checks.reads_truth(rows.columns))).alias("reads_truth"))


@query(f"{_LARGEST} select case_id, z, x1, y1, x2, y2 from m where area > 0")
def largest_inclusive_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Inclusive box of each slice's largest component."""
    rows = _slices(spark, sf_dir).withColumn("path", F.col("case_id"))
    found = exports.measured(rows).where("mask_area > 0")
    return found.select(F.substring("case_id", 6, 9).cast("int").alias("case_id"), F.col("z").cast("long").alias("z"), *(F.col(f"bbox_{c}").alias(c) for c in ("x1", "y1", "x2", "y2")))


@query("""with b as (select *, least(px1, 179) as cx1, least(px2, 179) as cx2, l_partkey % 9 as e from fx_box)
select l_orderkey, l_linenumber, l_partkey, case when l_suppkey % 8 = 0 then 'missing image path or bbox' when e = 0 then 'unsupported image extension' when cx2 <= cx1 then 'empty bbox' end as reason from b where e = 0 or l_suppkey % 8 = 0 or cx2 <= cx1""")
def detector_rejects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records a detector can't use, with the first reason."""
    name = F.concat(F.lit("img."), F.when(F.col("l_partkey") % 9 == 0, "gif").otherwise("JPG"))
    rows = read(spark, sf_dir, "fx_box").select("l_orderkey", "l_linenumber", "l_partkey", name.alias("image_path"), F.when(F.col("l_suppkey") % 8 != 0, boxes.box("px1", "py1", "px2", "py2")).alias("box"), F.lit(180).alias("width"), F.lit(400).alias("height"))
    _, bad = matching.detector_records(rows)
    return bad.select("l_orderkey", "l_linenumber", "l_partkey", "reason")


@query("""with d as (select l_orderkey as image, l_linenumber as rank, l_quantity::double as conf from lineitem) select o_orderkey as sample_id, rank::bigint as det_rank, conf from d join orders on o_orderkey = image where o_orderkey % 3 = 0""")
def detections_of_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Detector candidates of known records only."""
    rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet").select(F.concat(F.lit("img_"), "l_orderkey").alias("image_path"), F.col("l_linenumber").cast("string").alias("rank"), F.col("l_quantity").cast("string").alias("conf"), *(F.lit(str(v)).alias(c) for c, v in (("x1", 1), ("y1", 2), ("x2", 9), ("y2", 8))))
    records = spark.read.parquet(f"{sf_dir}/orders.parquet").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").alias("sample_id"), F.concat(F.lit("img_"), "o_orderkey").alias("image_path"))
    found = matching.detections_of_records(readers.detections(rows, 1 << 20), records)
    return found.select("sample_id", F.col("det_rank").cast("long").alias("det_rank"), "conf")


@query("""select seq, count(*) as slices, round(avg((pred_label = gt_label)::int), 9) as correct, round(avg((not pred_mask_empty)::int), 9) as found, round(avg((pred_label = gt_label)::int) filter (not pred_mask_empty), 9) as correct_where_found from fx_slice group by seq""")
def slice_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of slices by sequence."""
    right, found = F.col("pred_label") == F.col("gt_label"), ~F.col("pred_mask_empty")
    return metrics.means_of(read(spark, sf_dir, "fx_slice"), ["seq"], {"correct": right, "found": found, "correct_where_found": F.when(found, right)}, "slices")
