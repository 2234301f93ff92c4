"""Readers of the record formats: CSV, JSON arrays, metric documents, telemetry, volumes."""

from __future__ import annotations

import gzip
import io
import re
import zipfile

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..functions.coerce import blank_to_null, first_present, safe_float, safe_int
from . import volumes
from .staging import store

RECORD_SCHEMA = (
    "id string, conversations array<struct<`from`:string, value:string>>, bbox array<int>, label string, patient_id string, case_id string, seq string, slice_idx string, source_dataset string, "
    "slice_manifest struct<patient_id:string, seq_id:string, slice_idx:string, mask_area:long, case_id:string, seq:string, label:string>"
)
CASE_SCHEMA = "case_id string, patient_id string, seq string, seq_id string, label string, split string, npz_path string, shape_dhw array<int>, mask_voxels long"


def read_csv(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """CSV with a header; every cell is text unless a schema is given. Quoted cells may hold line breaks and doubled quotes."""
    reader = spark.read.option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("encoding", "UTF-8")
    return (reader.schema(schema) if schema else reader.option("inferSchema", False)).csv(path)


def read_json(spark: SparkSession, path: str | list[str], schema: str | None = None) -> DataFrame:
    """JSON files that each hold an array of records (or one document)."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path)


def numbered(rows: DataFrame, name: str = "pos") -> DataFrame:
    """rows as read from files, with their place: files by path, then as they stand in them.

    A file is read by one task and numbered there; what precedes it comes from a table with a row per file.
    """
    placed = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.monotonically_increasing_id().alias("_at"))
    files = placed.groupBy("_file").agg(F.count(F.lit(1)).alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_file").rowsBetween(Window.unboundedPreceding, -1))
    files = files.select("_file", F.coalesce(before, F.lit(0)).alias("_start"))
    inside = F.row_number().over(Window.partitionBy("_file").orderBy("_at")) - 1
    return placed.withColumn("_in", inside).join(files, "_file").withColumn(name, F.col("_start") + F.col("_in")).drop("_file", "_at", "_start", "_in")


def read_records(spark: SparkSession, path: str | list[str], sizes: DataFrame | None = None, remap: tuple[str, str] | None = None) -> DataFrame:
    """Vision-language records as flat rows. Records without two turns, an image path or a label go.

    sizes(image_path, width, height), where given, moves boxes into their images.
    """
    raw = numbered(read_json(spark, path, RECORD_SCHEMA))
    turns = F.col("conversations")
    raw = raw.where(F.size(turns) >= 2)
    user, answer = F.element_at(turns, 1)["value"], F.element_at(turns, 2)["value"]
    given = F.when(F.size("bbox") == 4, boxes.box(*(F.col("bbox")[i] for i in range(4))))
    path_ = text.image_path(user)
    if remap:
        path_ = text.remap_path(path_, *remap)
    m = F.col("slice_manifest")
    out = raw.select(
        text.record_id("id", F.col("pos")).alias("sample_id"), path_.alias("image_path"), text.prompt_text(user).alias("prompt"), user.alias("user_text"), answer.alias("answer"),
        F.coalesce(given, text.box_in_text(user)).alias("box"), F.coalesce(text.label(F.coalesce("label", m["label"])), text.label(answer)).alias("label"),
        first_present("patient_id", m["patient_id"], text.patient_id(path_), F.regexp_extract(text.stem(path_), r"^([^_]*)_", 1)).alias("patient_id"), first_present("case_id", m["case_id"]).alias("case_id"),
        text.sequence_code(first_present("seq", m["seq"], m["seq_id"], text.sequence_token(user), text.sequence_of_path(path_))).alias("seq"),
        F.coalesce(safe_int(first_present("slice_idx", m["slice_idx"]), -1), F.lit(-1)).alias("_z"), F.col("source_dataset"), m["mask_area"].alias("mask_area"),
    )
    out = out.withColumn("slice_idx", F.when(F.col("_z") >= 0, F.col("_z")).otherwise(text.slice_index("image_path"))).drop("_z")
    out = out.where("image_path is not null and label is not null")
    if sizes is None:
        return out.where("box is not null")
    met = out.join(sizes, "image_path")
    return met.withColumn("box", boxes.non_empty(F.coalesce("box", boxes.box(0, 0, 1, 1)), "width", "height"))


def prompt_records(spark: SparkSession, path: str | list[str], truth: DataFrame | None = None) -> DataFrame:
    """Prompts only; geometry and label come from truth(sample_id, box, label) where given, else a placeholder box."""
    raw = numbered(read_json(spark, path, RECORD_SCHEMA)).where(F.size("conversations") >= 1)
    user = F.element_at("conversations", 1)["value"]
    out = raw.select(text.record_id("id", F.col("pos")).alias("sample_id"), text.image_path(user).alias("image_path"), text.prompt_text(user).alias("prompt"))
    return out.withColumn("box", boxes.box(0, 0, 1, 1)) if truth is None else out.join(truth.select("sample_id", "box", "label"), "sample_id")


def read_cases(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Case manifest; of repeated ids the last one counts."""
    from ..operators.ranking import first_per_key

    rows = numbered(read_json(spark, path, CASE_SCHEMA))
    return first_per_key(rows, ["case_id"], [F.desc("pos")])


def case_metadata(rows: DataFrame, pos: str = "pos") -> DataFrame:
    """One row per case, the first."""
    from ..operators.ranking import first_per_key

    return first_per_key(rows.where(blank_to_null("case_id").isNotNull()), ["case_id"], [F.col(pos)])


def detections(rows: DataFrame, k: int, phantom: bool = False) -> DataFrame:
    """Detector candidates: rank, confidence and box by image, the first k. An image without any is one blank row.

    Blank rows go; with ``phantom`` they become a candidate of confidence 0 in the corner.
    """
    from ..operators.ranking import top_k

    cells = ("x1", "y1", "x2", "y2")
    blank = blank_to_null("rank").isNull() | blank_to_null("x1").isNull()
    kept = rows if phantom else rows.where(~blank)
    near = lambda c: F.rint(safe_float(c)).cast("int")
    found = boxes.box(*(near(c) for c in cells))
    out = kept.select("image_path", safe_int("rank", 1).alias("det_rank"), safe_float("conf").alias("conf"), F.when(blank, boxes.box(0, 0, 1, 1)).otherwise(found).alias("box"))
    return top_k(out, ["image_path"], [F.col("det_rank"), F.desc("conf"), F.col("box.x1"), F.col("box.y1")], k)


def telemetry(spark: SparkSession, path: str) -> DataFrame:
    """Headerless timestamp, memory, load and power; a row in which any of the three isn't a number goes, so all means are over the same rows."""
    rows = spark.read.schema("ts string, mem string, util string, power string").option("ignoreLeadingWhiteSpace", True).csv(path)
    out = rows.select("ts", text.first_number("mem").alias("mem_mib"), text.first_number("util").alias("util_pct"), text.first_number("power").alias("power_w"))
    return out.dropna(subset=["mem_mib", "util_pct", "power_w"])


def run_report(spark: SparkSession, path: str) -> DataFrame:
    """key and value of a ``Name: value`` report, one row per line. The last colon with a space separates, as names may hold colons
    (``h:mm:ss``); lines without one go."""
    t = F.btrim("value", F.lit(" \t\r"))
    return spark.read.text(path).where(t.contains(": ")).select(F.regexp_extract(t, r"^(.*): (.*)$", 1).alias("key"), F.regexp_extract(t, r"^(.*): (.*)$", 2).alias("value"))


def metric_document(spark: SparkSession, path: str | list[str], level: str = "patient_level") -> DataFrame:
    """(strategy, metrics) for every strategy under a level of metric documents, metrics as a map of numbers."""
    schema = f"struct<{level}:map<string,map<string,string>>>"
    doc = spark.read.text(path, wholetext=True).select(F.from_json("value", schema).alias("d"))
    rows = doc.select(F.explode(f"d.{level}").alias("strategy", "m"))
    return rows.select("strategy", F.transform_values("m", lambda k, v: v.try_cast("double")).alias("metrics"))


def files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """Files of a folder by name pattern: path, id (name without suffix) and content, read lazily."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    return rows.select("path", text.file_id("path").alias("case_id"), "length", "content")


def lines_of(names: DataFrame, folder: str) -> DataFrame:
    """(name, value): the lines of the text files of a folder with these names, which tasks open; the driver lists nothing. A file that isn't there is an error."""

    def read(batches):
        fs, root = store(folder)
        for batch in batches:
            found, values = [], []
            for name in batch.column("name").to_pylist():
                with fs.open_input_stream(f"{root}/{name}", compression=None) as f:
                    lines = re.split("\r\n|\r|\n", f.read().decode())
                if not lines[-1]:
                    lines.pop()
                found += [name] * len(lines)
                values += lines
                if len(values) >= 1 << 16:
                    yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(values, pa.string())], ["name", "value"])
                    found, values = [], []
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.string()), pa.array(values, pa.string())], ["name", "value"])

    # few bytes but much work: by number, so that the names aren't gathered into few tasks
    dealt = names.select("name").repartition(4 * names.sparkSession.sparkContext.defaultParallelism, "name")
    return dealt.mapInArrow(read, "name string, value string")


def listing(spark: SparkSession, folder: str, pattern: str = "*") -> DataFrame:
    """path, name, folder, length and time of a folder's files, in the order of their paths; no content is read."""
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(folder)
    at = F.regexp_extract("path", r"^(.*)/([^/]*)$", 1)
    return found.select("path", F.regexp_extract("path", r"([^/]*)$", 1).alias("name"), at.alias("folder"), "length", F.col("modificationTime").alias("time")).orderBy("path")


#: Files that make a checkpoint whole: all of the first, and one of the second. Fixed values.
CHECKPOINT_FILES = ("trainer_state.json", "optimizer.pt", "scheduler.pt", "adapter_config.json")
CHECKPOINT_WEIGHTS = ("adapter_model.safetensors", "adapter_model.bin")


def checkpoints(listed: DataFrame) -> DataFrame:
    """folder, step, whole and missing of each folder checkpoint-<step> in a listing."""
    step = F.regexp_extract("folder", r"(?:^|/)checkpoint-(\d+)$", 1)
    there = F.array_distinct(F.collect_list(F.when(F.col("name").isin(*CHECKPOINT_FILES, *CHECKPOINT_WEIGHTS), F.col("name"))))
    found = listed.where(step != "").groupBy("folder", step.cast("long").alias("step")).agg(there.alias("there"))
    missing = F.array_except(F.array(*map(F.lit, CHECKPOINT_FILES)), "there")
    weights = F.arrays_overlap("there", F.array(*map(F.lit, CHECKPOINT_WEIGHTS)))
    missing = F.when(weights, missing).otherwise(F.array_append(missing, CHECKPOINT_WEIGHTS[0]))
    return found.select("folder", "step", (F.size(missing) == 0).alias("whole"), F.array_sort(missing).alias("missing"))


def latest_checkpoint(listed: DataFrame) -> DataFrame:
    """folder and step of the whole checkpoint with the greatest step; no row if there is none."""
    return checkpoints(listed).where("whole").agg(F.max(F.struct("step", "folder")).alias("c")).where("c is not null").select("c.folder", "c.step")


VOLUME = "case_id string, depth int, height int, width int, image array<float>, mask array<byte>, error string"


def npz_volumes(found: DataFrame, image_key: str = "image", mask_key: str = "mask") -> DataFrame:
    """Image and mask [D, H, W] of .npz files that Spark has read, as flat rows; a file that can't be used has an error.

    ``volumes.read_volumes`` reads slice by slice; this is for stores that only Spark opens.
    """

    def decode(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                try:
                    z = np.load(io.BytesIO(r["content"]), allow_pickle=False)
                    image, mask = z[image_key], z[mask_key]
                    depth, height, width = volumes.checked(volumes.Stream(image.shape), volumes.Stream(mask.shape))
                    if mask.shape != image.shape:
                        mask = np.stack([volumes.nearest(m, height, width) for m in mask])
                    rows.append((r["case_id"], depth, height, width, image.astype(np.float32).ravel(), (mask > 0).astype(np.int8).ravel(), None))
                except (KeyError, ValueError, OSError, EOFError, zipfile.BadZipFile) as e:
                    rows.append((r["case_id"], None, None, None, None, None, str(e)[:200]))
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.float32()), pa.list_(pa.int8()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], ["case_id", "depth", "height", "width", "image", "mask", "error"])

    return found.select("case_id", "content").mapInArrow(decode, VOLUME)


def nifti_array(content: bytes) -> np.ndarray:
    """The array [X, Y, Z] of a NIfTI-1 file, scaled as its header says."""
    raw = gzip.decompress(content) if content[:2] == b"\x1f\x8b" else content
    shape, kind, offset, slope, shift = volumes.nifti_header(raw)
    flat = np.frombuffer(raw, kind, int(np.prod(shape)), offset).astype(np.float64)
    return (flat * slope + shift).reshape(shape, order="F")


def nifti_masks(found: DataFrame) -> DataFrame:
    """(case_id, z, y, x) of the positive voxels of NIfTI files."""

    def decode(batches):
        for batch in batches:
            for r in batch.to_pylist():
                x, y, z = np.nonzero(np.atleast_3d(nifti_array(r["content"])) > 0)
                yield pa.RecordBatch.from_arrays([pa.array([r["case_id"]] * len(x), pa.string()), *(pa.array(v.astype(np.int64)) for v in (z, y, x))], ["case_id", "z", "y", "x"])

    return found.select("case_id", "content").mapInArrow(decode, "case_id string, z long, y long, x long")


def pixels(volumes: DataFrame) -> DataFrame:
    """Flat volumes as a pixel table (case_id, z, y, x, v, mask)."""
    p = volumes.where("error is null").select("case_id", "height", "width", F.posexplode(F.arrays_zip("image", "mask")).alias("pos", "c"))
    w, h = F.col("width"), F.col("height")
    return p.select("case_id", F.floor(F.col("pos") / (w * h)).cast("int").alias("z"), (F.floor(F.col("pos") / w) % h).cast("int").alias("y"), (F.col("pos") % w).cast("int").alias("x"), F.col("c.image").alias("v"), F.col("c.mask").cast("int").alias("mask"))


def seconds_of(c: Column) -> Column:
    """Seconds of h:mm:ss or m:ss."""
    parts = F.transform(F.reverse(F.split(c, ":")), lambda x, i: x.try_cast("double") * F.pow(F.lit(60.0), i))
    return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)


def split_table(rows: DataFrame) -> DataFrame:
    """patient_id, seq_id, label, case_id and split of a split table; a split other than train, val or test raises."""
    from ..operators.checks import known_values, raise_if_any, require_columns

    require_columns(rows, ["patient_id", "seq_id", "label", "case_id", "split"])
    raise_if_any(known_values(rows, "split", ["train", "val", "test"]).select("case_id", "split"), "unknown split")
    return rows


def clinical_labels(rows: DataFrame) -> DataFrame:
    """patient_id and lesion_pattern (single, multiple or ""); a patient with two raises, one without id goes."""
    from ..operators.checks import one_group_per_key, raise_if_any

    given = first_present(*(c for c in ("lesion_pattern", "clinical_lesion_pattern") if c in rows.columns))
    out = rows.select("patient_id", text.lesion_pattern(given).alias("lesion_pattern")).where(blank_to_null("patient_id").isNotNull()).distinct()
    raise_if_any(one_group_per_key(out, "patient_id", "lesion_pattern"), "conflicting patterns")
    return out


def strategy_tables(tables: dict[str, DataFrame], key: str = "patient_id") -> DataFrame:
    """One table of several strategies' predictions; each must hold the same keys, once."""
    from ..operators.checks import raise_if_any, same_keys, unique_key
    from ..operators.reshape import union_rows

    first = next(iter(tables.values()))
    for name, rows in tables.items():
        raise_if_any(unique_key(rows, [key]), f"{name}: keys repeat")
        raise_if_any(same_keys(first, rows, key), f"{name}: keys differ")
    return union_rows(*(rows.withColumn("strategy", F.lit(name)) for name, rows in tables.items()))
