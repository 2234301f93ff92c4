"""Integrity checks: each gives the violations as rows; none means it holds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import has_numeric_box


class CheckFailed(ValueError):
    """A check found violations."""


def raise_if_any(violations: DataFrame, what: str, show: int = 5) -> None:
    rows = violations.limit(show).collect()
    if rows:
        raise CheckFailed(f"{what}: " + "; ".join(str(r.asDict()) for r in rows))


def require_rows(rows: DataFrame, what: str = "no rows") -> DataFrame:
    if rows.isEmpty():
        raise CheckFailed(what)
    return rows


def unique_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def one_group_per_key(rows: DataFrame, key: str, group: str) -> DataFrame:
    """Keys seen in several groups: folds that overlap, patients with several labels."""
    return rows.groupBy(key).agg(F.count_distinct(group).alias("n_groups")).where("n_groups > 1")


def labels_agree(a: DataFrame, b: DataFrame, key: str, label: str = "gt_label") -> DataFrame:
    x, y = a.select(key, F.col(label).alias("label_a")), b.select(key, F.col(label).alias("label_b"))
    return x.join(y, key).where(~F.col("label_a").eqNullSafe(F.col("label_b")))


def same_keys(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Keys that only one side holds, and which."""
    mark = lambda t, n: t.select(key).distinct().withColumn(n, F.lit(True))
    both = mark(a, "_a").join(mark(b, "_b"), key, "full_outer")
    return both.where("_a is null or _b is null").select(key, F.when(F.col("_a").isNull(), "right").otherwise("left").alias("only_in"))


def covers(parts: DataFrame, universe: DataFrame, key: str) -> DataFrame:
    return universe.select(key).distinct().join(parts.select(key).distinct(), key, "left_anti")


def expected_count(rows: DataFrame, key: str, n: int) -> DataFrame:
    return rows.agg(F.count_distinct(key).alias("found")).where(F.col("found") != n)


def inside(small: DataFrame, large: DataFrame, key: str) -> DataFrame:
    return small.select(key).distinct().join(large.select(key).distinct(), key, "left_anti")


def both_classes(rows: DataFrame, groups: list[str], label: str = "gt_label", n: int = 2) -> DataFrame:
    return rows.groupBy(*groups).agg(F.count_distinct(label).alias("n_labels")).where(F.col("n_labels") < n)


def require_columns(rows: DataFrame, columns: list[str]) -> DataFrame:
    lost = [c for c in columns if c not in rows.columns]
    if lost:
        raise CheckFailed(f"columns missing: {lost}")
    return rows


def known_values(rows: DataFrame, column: str, values: list[str]) -> DataFrame:
    return rows.where(F.col(column).isNull() | ~F.col(column).isin(values))


def present_ids(rows: DataFrame, key: str) -> DataFrame:
    return rows.where(F.col(key).isNull() | (F.trim(F.col(key).cast("string")) == ""))


def no_box_in_prompt(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(has_numeric_box(text))


def same_shape(rows: DataFrame, a: str, b: str) -> DataFrame:
    return rows.where(~F.col(a).eqNullSafe(F.col(b)))


#: Beginnings of the names of columns that hold or derive from the truth, which no decision may read.
TRUTH_PREFIXES = ("gt_", "det_iou", "det_iom", "pred_precision_to_gt", "center_hit", "strict_localization", "relaxed_localization", "strict_hit", "relaxed_hit")


def reads_truth(columns: list[str]) -> list[str]:
    return sorted(c for c in columns if c.startswith(TRUTH_PREFIXES))
