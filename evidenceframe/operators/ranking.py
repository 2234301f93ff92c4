"""Windows in disguise: ranks, top-k, cumulative counts, arg-best, set comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank") -> DataFrame:
    return rows.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ranked_by_hash(rows: DataFrame, keys: list[str], seed: int, key: str, name: str = "rank", size: str | None = None) -> DataFrame:
    """rows with rank in their group by ``seeded_order`` (then by key), and the group's size.

    Groups may be few and large: rows are ranked within ranges of the hash, and what precedes a range comes from a table with a
    row per group and range.
    """
    base = rows.withColumn("_o", seeded_order(seed, key)).withColumn("_block", F.substring("_o", 1, 3))
    counts = base.groupBy(*keys, "_block").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*keys)
    before = F.sum("_n").over(w.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select(*(F.col(k).alias(f"_k_{k}") for k in keys), F.col("_block").alias("_b"), F.coalesce(before, F.lit(0)).alias("_start"), F.sum("_n").over(w).alias("_size"))
    inside = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy("_o", key))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_block") == F.col("_b")]
    out = base.withColumn("_r", inside).join(starts, same).withColumn(name, F.col("_start") + F.col("_r"))
    return out.select(*rows.columns, name, *([F.col("_size").alias(size)] if size else []))


def top_k(rows: DataFrame, keys: list[str], order: list[Column], k: int) -> DataFrame:
    """The first k (one at least) rows of each group; groups are cut before they are shuffled."""
    return ranked(rows, keys, order, "rank").where(F.col("rank") <= max(k, 1))


def first_per_key(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in an order; last-wins with a descending one."""
    return top_k(rows, keys, order, 1).drop("rank")


def prefixes(ranked_rows: DataFrame, ks: list[int], rank: str = "rank") -> DataFrame:
    """Every k with the rows of rank up to k."""
    return ranked_rows.withColumn("top_k", F.explode(F.filter(F.array(*(F.lit(k) for k in ks)), lambda k: k >= F.col(rank))))


def round_robin(rows: DataFrame, keys: list[str], order: list[Column], n: int, name: str = "fold") -> DataFrame:
    return ranked(rows, keys, order, "_r").withColumn(name, F.pmod(F.col("_r") - 1, F.lit(n)).cast("int")).drop("_r")


def numbered(rows: DataFrame, keys: list[str], order: list[Column], pattern: str = "%06d", name: str = "number") -> DataFrame:
    return ranked(rows, keys, order, "_r").withColumn(name, F.format_string(pattern, F.col("_r"))).drop("_r")


def arg_best(rows: DataFrame, keys: list[str], value: str, criteria: list[Column]) -> DataFrame:
    """Per group the value of the row with the lexicographically largest criteria."""
    return rows.groupBy(*keys).agg(F.max_by(value, F.struct(*(c.alias(f"c{i}") for i, c in enumerate(criteria)))).alias(value))


def difference(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti")


def common(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")


def seeded_order(seed: int, *cols: str) -> Column:
    """A sort key that permutes rows by seed, the same however they are partitioned."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *(F.col(c).cast("string") for c in cols)))


def permuted(rows: DataFrame, seed: int, *cols: str, limit: int | None = None) -> DataFrame:
    out = rows.orderBy(seeded_order(seed, *cols), *cols)
    return out.limit(limit) if limit is not None else out
