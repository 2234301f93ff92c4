"""What the corpus operators share: scratch tables, batches of texts, whitespace words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.scratch import hadoop_path, scratch_dir

#: Words are maximal runs of anything but the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"


def materialise(df: DataFrame) -> DataFrame:
    """Write df to a scratch table and read it back: later readers neither recompute it nor depend on its lineage."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(table: DataFrame) -> None:
    """Delete a scratch table that nothing reads any more."""
    for file in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path, fs = hadoop_path(table.sparkSession, file)
        fs.delete(path, True)


def join_counted(rows: DataFrame, table: DataFrame, key: list[str], count: str, total: int, how: str = "inner", parts: int = 10_000) -> DataFrame:
    """rows joined (inner, left or left_semi) to a table of one row per key that says how many rows each key has.

    Keys with more than a ``parts``-th of all rows, which are fewer than ``parts``, are broadcast, so that no task gets
    the rows of a frequent key; the others meet in a shuffle. Keys have no nulls.
    """
    frequent = F.col(count) > max(1, total // parts)
    heavy, light = table.where(frequent), table.where(~frequent)
    rest = rows.join(F.broadcast(heavy.select(*key)), key, "left_anti").join(light, key, how)
    return rows.join(F.broadcast(heavy), key, "inner" if how == "left" else how).unionByName(rest)


def text_or_empty(name: str) -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def total_bytes(docs: DataFrame, text_col: str) -> int:
    """Bytes of all texts; one number comes to the driver."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col))), F.lit(0))).first()[0]


def slices(texts, size: int = 8 << 20):
    """Cut an Arrow array of strings into runs of about size bytes, each of one text at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False))
    begin = 0
    while begin < len(texts):
        done = ends[begin - 1] if begin else 0
        end = max(begin + 1, int(np.searchsorted(ends, done + size, side="right")))
        yield begin, end
        begin = end


def column(batch: pa.RecordBatch, name: str, kind: pa.DataType | None = None) -> pa.Array:
    a = batch.column(batch.schema.get_field_index(name))
    return a if kind is None or a.type == kind else a.cast(kind)
