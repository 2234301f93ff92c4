"""Writers of tables and metric documents; Spark writes folders, in parallel."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import to_relative
from ..operators.reshape import union_rows
from .staging import write_named

MODE = "errorifexists"  # results are written once


def write_csv(rows: DataFrame, path: str, columns: list[str] | None = None, mode: str = MODE, bom: bool = False) -> None:
    """CSV with a header; ``columns`` orders and limits them, those missing are blank. Booleans read True and False. With ``bom``
    every file begins with a byte-order mark."""
    have = {f.name: f.dataType.simpleString() for f in rows.schema}
    cells = []
    for c in columns or rows.columns:
        if c not in have:
            cells.append(F.lit(None).cast("string").alias(c))
        elif have[c] == "boolean":
            cells.append(F.initcap(F.col(c).cast("string")).alias(c))
        elif have[c].startswith(("map", "array", "struct")):
            cells.append(F.to_json(c).alias(c))
        else:
            cells.append(F.col(c))
    out = rows.select(*cells)
    if bom:
        out = out.withColumnRenamed(out.columns[0], "\ufeff" + out.columns[0])
    out.write.mode(mode).option("header", True).option("escape", '"').option("encoding", "UTF-8").csv(path)


def write_union_csv(tables: list[DataFrame], path: str, first: list[str] | None = None, mode: str = MODE) -> None:
    """Tables of different columns in one CSV: the preferred columns, then the others by name."""
    rows = union_rows(*tables)
    lead = [c for c in first or [] if c in rows.columns]
    write_csv(rows, path, lead + sorted(set(rows.columns) - set(lead)), mode)


def write_json(rows: DataFrame, path: str, mode: str = MODE) -> None:
    """One JSON record per line; NULLs are kept."""
    rows.write.mode(mode).option("ignoreNullFields", False).json(path)


def write_document(rows: DataFrame, path: str, mode: str = MODE) -> None:
    """One JSON document, an array of the rows as records: for summaries, whose rows are few."""
    record = F.to_json(F.struct(*rows.columns), {"ignoreNullFields": "false"})
    one = rows.agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ",\n"), F.lit("]")).alias("value"))
    one.write.mode(mode).text(path)


def write_assignments(rows: DataFrame, path: str, order: tuple[str, ...] = ("fold", "role", "patient_id"), mode: str = MODE) -> None:
    """A protocol's table of who has which role in which fold, in order across the files."""
    lead = [c for c in order if c in rows.columns]
    write_csv(rows.orderBy(*lead), path, lead + sorted(set(rows.columns) - set(lead)), mode)


def write_ordered(rows: DataFrame, path: str, keys: list[str], form: str = "csv", mode: str = MODE) -> DataFrame:
    """Files in the order of the keys, each sorted: read by name they give the order. Returns the manifest: file, rows, least and greatest keys.

    Rows are dealt by ranges of the keys, and rows with equal keys by a hash of themselves, so that one frequent key fills several files.
    """
    cells = F.xxhash64(*(F.col(f"`{c}`") for c in rows.columns))
    ordered = rows.orderBy(*(F.col(k) for k in keys), cells)
    if form == "csv":
        write_csv(ordered, path, mode=mode)
        found = rows.sparkSession.read.schema(rows.schema).option("header", True).option("escape", '"').csv(path)
    else:
        ordered.write.mode(mode).format(form).save(path)
        found = rows.sparkSession.read.schema(rows.schema).format(form).load(path)
    key = F.struct(*keys)
    return found.groupBy(F.col("_metadata.file_name").alias("file")).agg(F.count(F.lit(1)).alias("rows"), F.min(key).alias("least"), F.max(key).alias("greatest"))


def write_ordered_arrays(rows: DataFrame, path: str, record: str, number: str, chunk: int = 10_000) -> None:
    """JSON files that each hold an array of up to ``chunk`` records, JSON texts, in the order of their numbers from 1; file names follow it."""
    part = F.floor((F.col(number) - 1) / chunk)
    texts = F.transform(F.array_sort(F.collect_list(F.struct(number, record))), lambda x: x[record])
    files = rows.groupBy(part.alias("part")).agg(F.concat(F.lit("[\n"), F.array_join(texts, ",\n"), F.lit("\n]\n")).alias("content"))
    write_named(files.select(F.format_string("records-%08d.json", "part").alias("name"), "content"), path)


def write_parquet(rows: DataFrame, path: str, partition_by: list[str] | None = None, mode: str = MODE) -> None:
    rows.write.mode(mode).partitionBy(*(partition_by or [])).parquet(path)


def detector_labels(records: DataFrame, class_id: int = 0) -> DataFrame:
    """image_path and a line ``class cx cy w h`` with six digits."""
    r = to_relative(F.col("box"), "width", "height")
    return records.select("image_path", F.format_string("%d %.6f %.6f %.6f %.6f", F.lit(class_id), r["cx"], r["cy"], r["w"], r["h"]).alias("line"))


def write_detector_set(records: DataFrame, path: str, name: str = "lesion", class_id: int = 0) -> DataFrame:
    """A detector's data set: labels/<split>/<stem>.txt with a line per box, and the document that names the folders. Returns the files' names.

    records(split, stem, box, width, height); the images themselves are not copied.
    """
    lines = detector_labels(records.withColumn("image_path", F.concat_ws("/", F.lit("labels"), "split", F.concat("stem", F.lit(".txt")))), class_id)
    files = lines.groupBy(F.col("image_path").alias("name")).agg(F.concat(F.array_join(F.array_sort(F.collect_list("line")), "\n"), F.lit("\n")).alias("content"))
    document = f"path: {path}\ntrain: images/train\nval: images/val\nnames:\n  {class_id}: {name}\n"
    one = records.sparkSession.createDataFrame([(f"{name}.yaml", document)], "name string, content string")
    write_named(files.unionByName(one), path)
    return lines.select(F.col("image_path").alias("name")).distinct().unionByName(one.select("name"))


def review_template(patients: DataFrame, blanks: list[str]) -> DataFrame:
    """A table to be filled in by hand."""
    return patients.withColumns({b: F.lit("") for b in blanks})


def routed(records: DataFrame, available: DataFrame, key: str = "image_path") -> tuple[DataFrame, DataFrame]:
    """Records whose file is there, and those whose isn't."""
    there = available.select(key).distinct()
    return records.join(there, key, "left_semi"), records.join(there, key, "left_anti")
