"""Export of volumes as slice records: one pass over the slices, from which manifest, records and counters come.

The pass reads masks, measures each slice where it lies and writes a row without pixels; its counters are observed while it
runs. Records are numbered by case and slice within their split from a table with a row per case. The summary is written last, if what
was written agrees with what was observed.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators.aggregate import CLASSES
from ..operators.masks import numbered_components
from .sinks import write_csv, write_ordered_arrays
from .staging import write_named

MANIFEST = [
    "patient_id", "seq_id", "label", "case_id", "split", "npz_name", "npz_path", "slice_idx", "image_path", "mask_area", "has_lesion",
    "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", "image_shape",
]
MEASURED = "path string, case_id string, z int, height int, width int, mask_area long, bbox_x1 int, bbox_y1 int, bbox_x2 int, bbox_y2 int"
SPLITS = ("train", "val", "test")


def measured(slices: DataFrame) -> DataFrame:
    """Per slice: mask area and the inclusive box of its largest component, the first of equal ones; all zero without a mask."""

    def measure(batches):
        for batch in batches:
            masks = batch.column("mask")
            size, begin = masks.value_lengths().to_numpy(zero_copy_only=False), masks.offsets.to_numpy()[:-1] - masks.offsets[0].as_py()
            at = np.flatnonzero(masks.flatten().to_numpy(zero_copy_only=False) > 0)
            own = np.searchsorted(begin, at, side="right") - 1
            width = batch.column("width").to_numpy()
            y, x = np.divmod(at - begin[own], width[own])
            found = np.zeros((len(size), 5), np.int64)
            if len(at):
                table = pa.table({"case_id": own, "z": own, "y": y, "x": x})
                number = numbered_components(table).column("component").to_numpy()
                keys, which, counts = np.unique(np.stack([own, number]), axis=1, return_inverse=True, return_counts=True)
                edges = np.full((4, len(counts)), 1 << 62)
                for k, v in enumerate((x, y, -x, -y)):
                    np.minimum.at(edges[k], which.ravel(), v)
                order = np.lexsort((keys[1], -counts, keys[0]))
                first = order[np.concatenate([[True], np.diff(keys[0][order]) > 0])]
                found[keys[0][first], 1:] = np.stack([edges[0], edges[1], -edges[2], -edges[3]])[:, first].T
                found[:, 0] = np.bincount(own, minlength=len(size))
            named = [batch.column(c) for c in ("path", "case_id", "z", "height", "width")]
            cells = [pa.array(found[:, 0]), *(pa.array(found[:, k].astype(np.int32)) for k in range(1, 5))]
            yield pa.RecordBatch.from_arrays([*named, *cells], ["path", "case_id", "z", "height", "width", "mask_area", "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"])

    return slices.select("path", "case_id", "z", "height", "width", "mask").mapInArrow(measure, MEASURED)


def counters() -> list[Column]:
    """Slices of each split, and of each label and split: all, and those with a lesion."""
    split, label, lesion = F.col("split"), F.col("label"), F.col("has_lesion") == 1
    own = [(s, split == s) for s in SPLITS] + [(f"{c}_{s}", (split == s) & (label == c)) for s in SPLITS for c in CLASSES]
    return [F.count_if(where & more).alias(f"{name}_{what}_slices") for name, where in own for what, more in (("all", F.lit(True)), ("lesion", lesion))]


def records(manifest: DataFrame, prefix: str) -> DataFrame:
    """set (train, or val for every other split), number from 1 and JSON record, whole and with its box hidden, of the slices with a lesion.

    manifest has the order of its cases as ``pos``.
    """
    lesion = manifest.where("has_lesion = 1").withColumn("set", F.when(F.col("split") == "train", "train").otherwise("val"))
    cases = lesion.groupBy("set", "pos").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.partitionBy("set").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1))
    starts = cases.select("set", "pos", F.coalesce(before, F.lit(0)).alias("start"))
    place = F.row_number().over(Window.partitionBy("set", "pos").orderBy("slice_idx"))
    placed = lesion.withColumn("place", place).join(starts, ["set", "pos"]).withColumn("number", F.col("start") + F.col("place"))
    code = F.when(F.col("seq_id") == "1", "T1").when(F.col("seq_id") == "2", "T2").otherwise(F.concat(F.lit("seq"), F.col("seq_id")))
    prompt = F.concat(text.build_prompt(code, boxes.box("bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2"), "legacy"), F.lit(" "))
    ident = F.concat(F.lit(f"{prefix}_"), F.col("set"), F.format_string("_%06d", F.col("number")))
    manifest_part = F.struct("patient_id", "seq_id", "slice_idx", "mask_area", "case_id").alias("slice_manifest")

    def record(question: Column) -> Column:
        c = text.conversation(ident, question, F.col("image_path"), text.build_answer("label", "legacy"))
        return F.to_json(F.struct(c["id"].alias("id"), c["conversations"].alias("conversations"), manifest_part))

    return placed.select("set", "number", record(prompt).alias("record"), record(text.hide_box(prompt)).alias("hidden"))


def export_slices(slices: DataFrame, cases: DataFrame, path: str, image_prefix: str, name: str = "split_v1", min_area: int = 20) -> dict[str, int]:
    """Write slices, slice_manifest (CSV), train, val, train_hidden and val_hidden (JSON arrays) and export_summary.json below path; returns the counters.

    slices are rows of volumes; cases(case_id, patient_id, seq_id, label, split, npz_name, pos) says what is exported, in the order of pos, once each. Cases without
    slices, and slices with an error, go. Records name the image of a slice, which isn't written.
    """
    wide = measured(slices.where("error is null")).join(cases.withColumns({c: F.trim(c) for c in ("patient_id", "seq_id", "label", "case_id", "npz_name")}), "case_id")
    split = F.lower(F.trim("split"))
    file = F.concat_ws("_", "patient_id", "seq_id", F.lit("cls"), F.when(F.col("label") == "infection", "0").otherwise("1"), F.lit("layer"), F.concat("z", F.lit(".jpg")))
    rows = wide.select(
        "pos", "patient_id", "seq_id", "label", "case_id", split.alias("split"), "npz_name", F.col("path").alias("npz_path"), F.col("z").alias("slice_idx"), text.record_image_path(image_prefix, split, file).alias("image_path"),
        "mask_area", (F.col("mask_area") >= min_area).cast("int").alias("has_lesion"), "bbox_x1", "bbox_y1", "bbox_x2", "bbox_y2", F.concat_ws("x", "height", "width").alias("image_shape"),
    )
    seen = Observation("export")
    rows.observe(seen, F.count(F.lit(1)).alias("slices"), *counters()).write.parquet(f"{path}/slices")
    spark, counts = slices.sparkSession, {k: n for k, n in seen.get.items() if n}
    manifest = spark.read.schema(rows.schema).parquet(f"{path}/slices")
    write_csv(manifest.orderBy("pos", "slice_idx"), f"{path}/slice_manifest", MANIFEST)
    numbered = records(manifest, name)
    for part in ("train", "val"):
        for column, end in (("record", ""), ("hidden", "_hidden")):
            write_ordered_arrays(numbered.where(F.col("set") == part), f"{path}/{part}{end}", column, "number")
    written = spark.read.option("header", True).csv(f"{path}/slice_manifest").agg(*counters()).first().asDict()
    if {k: n for k, n in written.items() if n} != {k: n for k, n in counts.items() if k != "slices"}:
        raise ValueError(f"observed {counts}, written {written}")
    summary = json.dumps({"image_prefix": image_prefix, "min_mask_area": min_area, "counts": counts}, ensure_ascii=False)
    write_named(spark.createDataFrame([("export_summary.json", summary)], "name string, content string"), path)
    return counts
