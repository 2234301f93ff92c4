"""Exact deduplication by progressive refinement.

Texts are compared after each run of ASCII white space becomes one space. Rows are grouped by length, then by a
hash of the first characters; only the full hashes of rows that still share a group are grouped.

A text is read once, where it lies, into a table of its length and hashes (its length can't be read without it), and no
text is shuffled for the grouping; a full hash only is for survivors. Groups are pre-aggregated and come back to their rows by broadcast where they are large (``join_counted``), so copies that a third
of the rows share are no hot task.

Defined results: a null text equals an empty one; of equal texts the smallest id stays, a null id only if no
other is there; of several rows with that id and text one stays; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, join_counted, materialise, text_or_empty


def normalised(text_col: str):
    return F.regexp_replace(text_or_empty(text_col), SPACE, " ")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 64) -> DataFrame:
    """One row per row of docs: id, keep_id, group_size, kept, digest (SHA-256 of the normalised text)."""
    texts = docs.select(F.col(id_col).cast("long").alias("id"), normalised(text_col).alias("norm"))
    rows = materialise(texts.select(
        "id", F.monotonically_increasing_id().alias("row"), F.octet_length("norm").alias("size"), F.xxhash64(F.substring("norm", 1, prefix_chars)).alias("prefix"),
        F.sha2(F.col("norm").cast("binary"), 256).alias("digest"),
    ))
    total = rows.count()
    # Steps one and two: a row with its length, then its prefix hash, to itself can have no equal.
    lengths = rows.groupBy("size").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    groups = rows.groupBy("size", "prefix").agg(F.count(F.lit(1)).alias("times")).where("times > 1")
    groups = materialise(groups.join(lengths.select("size"), "size", "left_semi"))
    # Step three: the full hash, of the survivors.
    alive = join_counted(rows, groups, ["size", "prefix"], "times", total, "left_semi")
    classes = alive.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("first")).where("group_size > 1")
    met = join_counted(rows, materialise(classes), ["digest"], "group_size", total, "left")
    alone = F.col("group_size").isNull()
    return met.select(
        "id", F.when(alone, F.col("id")).otherwise(F.col("first.id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        (alone | (F.col("row") == F.col("first.row"))).alias("kept"), "digest",
    )


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs that stay, one of each group of equal texts, with their columns."""
    groups = exact_groups(docs, id_col, text_col).where("group_size > 1")
    fate = groups.groupBy("id", "digest").agg(F.max("kept").alias("_one"), F.count(F.lit(1)).alias("_rows")).select(F.col("id").alias("_id"), F.col("digest").alias("_digest"), "_one", "_rows")
    fate = materialise(fate.where("not _one or _rows > 1"))
    # The columns of docs travel as one, so that none of their names can clash.
    whole = F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("_doc")
    content = docs.select(whole, F.col(id_col).cast("long").alias("_own"), F.sha2(normalised(text_col).cast("binary"), 256).alias("_sha"))
    met = content.join(fate.hint("shuffle_hash"), F.col("_own").eqNullSafe(F.col("_id")) & (F.col("_sha") == F.col("_digest")), "left")
    alone = met.where("_one is null").select("_doc.*")
    if fate.where("_one").isEmpty():
        return alone
    # Rows that repeat whole: of each id and text the one that stays, chosen where they lie before they meet.
    again = met.where("_one").groupBy("_id", "_digest").agg(F.min_by("_doc", F.col(f"_doc.`{text_col}`")).alias("_doc")).select("_doc.*")
    return alone.unionByName(again)
