"""Substring deduplication by content-defined chunking.

A gear rolling hash runs over a text's bytes; a chunk ends where the hash's top bits are zero, ``least`` bytes
after the last end at the earliest and ``most`` at the latest. As the hash depends on the last 32 bytes only, an insertion
changes the chunks around it and no others. A chunk is deduplicated by the 128-bit digest of its bytes and those of the
chunks that follow it, up to ``span`` bytes or more in all, so whatever repeats is a passage of that length. The first
occurrence (smallest id, then place) stays.

Neighbouring repeats join into one span only while they are neighbours in one other occurrence too: every
span stands whole at the place that its row names (``other_id``, ``other_start``). Spans of different places may overlap.

Only digests and places are shuffled. Counting pre-aggregates by digest, and digests with a large share of all rows
come back to their rows by broadcast (``join_counted``), so a passage that a third of all documents hold is no hot task.

Defined results: a null text is an empty one and has no chunks, as has one shorter than ``span``; a repeat within one
text counts; rows that repeat are repeats of each other, the first in the table being the first occurrence; null ids come
last; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, join_counted, materialise, text_or_empty


def _gear(seed: int = 0x2545F491) -> np.ndarray:
    """A pseudo-random number for each byte (xorshift)."""
    out, x = [], seed
    for _ in range(256):
        for _ in range(3):
            x ^= (x << 13) & 0xFFFFFFFF
            x ^= x >> 17
            x ^= (x << 5) & 0xFFFFFFFF
        out.append(x)
    return np.array(out, np.uint32)


GEAR = _gear()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """h[i] = 2 * h[i - 1] + gear[data[i]] modulo 2**32, for all i, by doubling the window five times."""
    h = GEAR[data]
    for k in (1, 2, 4, 8, 16):
        if len(h) > k:
            more = h[:-k] << np.uint32(k)
            h[k:] += more
    return h


def cut_points(text: bytes, bits: int, least: int, most: int) -> list[int]:
    """Where the chunks of a text end."""
    n = len(text)
    found = np.flatnonzero(gear_hashes(np.frombuffer(text, np.uint8)) >> np.uint32(32 - bits) == 0) + 1
    ends, last = [], 0
    for at in found.tolist():
        while at - last > most:
            last += most
            ends.append(last)
        if at - last >= least:
            ends.append(at)
            last = at
    while n - last > most:
        last += most
        ends.append(last)
    if last < n:
        ends.append(n)
    return ends


def chunk(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 16, most: int = 256, span: int = 100) -> DataFrame:
    """One row per chunk that ``span`` bytes or more follow from its start on: id, row (a number), start, length (bytes, of the
    chunk with those after it), high and low (their digest)."""

    def cut(batches):
        for batch in batches:
            ids, rows = column(batch, "id").to_pylist(), column(batch, "row").to_pylist()
            texts = column(batch, "text", pa.binary())
            held: tuple[list, list, list, list, list] = ([], [], [], [], [])
            for i, text in enumerate(texts):
                data = text.as_py()
                ends = np.array(cut_points(data, bits, least, most), np.int64)
                starts = np.concatenate([[0], ends[:-1]])[: len(ends)]
                reach = np.searchsorted(ends, starts + span)
                n = int((reach < len(ends)).sum())
                starts, stops = starts[:n].tolist(), ends[reach[:n]].tolist()
                held[0].extend([ids[i]] * n)
                held[1].extend([rows[i]] * n)
                held[2].extend(starts)
                held[3].extend(stops)
                held[4].extend([xxhash.xxh3_128_digest(data[a:b]) for a, b in zip(starts, stops)])
                if len(held[0]) > 200_000:
                    yield _rows(held)
                    held = ([], [], [], [], [])
            yield _rows(held)

    def _rows(held):
        digest = np.frombuffer(b"".join(held[4]), ">i8").astype(np.int64).reshape(-1, 2)
        start, stop = (np.array(c, np.int64) for c in held[2:4])
        return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in held[:2]), pa.array(start), pa.array(stop - start), pa.array(digest[:, 0]), pa.array(digest[:, 1])], ["id", "row", "start", "length", "high", "low"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.monotonically_increasing_id().alias("row"), text_or_empty(text_col).alias("text"))
    return named.mapInArrow(cut, "id long, row long, start long, length long, high long, low long")


def repeated_spans(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bits: int = 5, least: int = 16, most: int = 256, span: int = 100,
) -> DataFrame:
    """Passages of at least ``span`` bytes that stand elsewhere too, as long as one other place holds them.

    One row per passage: id, start, length (bytes), chunks, removed_bytes (all, or none in the first occurrence), first_id (where its
    first chunk occurs first), copies (the most occurrences of a chunk in it), other_id and other_start (where the whole of it
    stands too: the first occurrence, and for that one the last).
    """
    chunks = materialise(chunk(docs, id_col, text_col, bits, least, most, span))
    key, total = ["high", "low"], chunks.count()
    repeated = materialise(chunks.groupBy(*key).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1"))
    # Only chunks that repeat go on.
    met = materialise(join_counted(chunks, repeated, key, "copies", total))
    place = F.struct(F.col("id").isNull().alias("none"), "id", "row", "start")
    ends = materialise(met.groupBy(*key).agg(F.min(place).alias("first"), F.max(place).alias("last"), F.count(F.lit(1)).alias("times")))
    met = join_counted(met, ends, key, "times", total)
    itself = (F.col("first.row") == F.col("row")) & (F.col("first.start") == F.col("start"))
    met = met.select("id", "row", "start", "length", "copies", F.col("first.id").alias("first_id"), itself.alias("itself"), F.when(itself, F.col("last")).otherwise(F.col("first")).alias("other"))
    met = met.withColumn("shift", F.col("other.start") - F.col("start")).withColumn("end", F.col("start") + F.col("length"))
    w = Window.partitionBy("row").orderBy("start")
    before = lambda c: F.lag(c).over(w)
    goes_on = (before("itself") == F.col("itself")) & (before("other.row") == F.col("other.row")) & (before("shift") == F.col("shift")) & (before("end") >= F.col("start"))
    met = met.withColumn("begins", (~F.coalesce(goes_on, F.lit(False))).cast("int"))
    met = met.withColumn("run", F.sum("begins").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    spans = met.groupBy("id", "row", "run").agg(
        F.min("start").alias("start"), (F.max("end") - F.min("start")).alias("length"), F.count(F.lit(1)).alias("chunks"), F.first("itself").alias("itself"),
        F.min_by("first_id", "start").alias("first_id"), F.max("copies").alias("copies"), F.first("other.id").alias("other_id"), F.min("other.start").alias("other_start"),
    )
    return spans.select("id", "start", "length", "chunks", F.when(F.col("itself"), 0).otherwise(F.col("length")).alias("removed_bytes"), "first_id", "copies", "other_id", "other_start")
