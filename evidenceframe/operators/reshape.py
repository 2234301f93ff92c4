"""Between long and wide forms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def components_wide(rows: DataFrame, keys: list[str], fields: list[str], top: int = 3, rank: str = "component_rank") -> DataFrame:
    """component_1_label, ... from one row per component, in one aggregation."""
    cells = [F.max(F.when(F.col(rank) == i, F.col(f))).alias(f"component_{i}_{f}") for i in range(1, top + 1) for f in fields]
    return rows.where(F.col(rank) <= top).groupBy(*keys).agg(*cells)


def components_long(rows: DataFrame, keys: list[str], fields: list[str], top: int = 3, present: str | None = None) -> DataFrame:
    """One row per component from the wide form; those whose ``present`` field is NULL go."""
    items = [F.struct(F.lit(i).alias("component_rank"), *(F.col(f"component_{i}_{f}").alias(f) for f in fields)) for i in range(1, top + 1)]
    out = rows.select(*keys, F.inline(F.array(*items)))
    return out.where(F.col(present).isNotNull()) if present else out


def metrics_long(rows: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, metric, value)."""
    return rows.select(*keys, *(F.col(m).cast("double").alias(m) for m in metrics)).unpivot(keys, metrics, "metric", "value")


def with_literals(rows: DataFrame, **values) -> DataFrame:
    return rows.withColumns({k: F.lit(v) for k, v in values.items()})


def slices_of(volumes: DataFrame, keys: list[str], slices: str = "slices") -> DataFrame:
    """One row per slice of an array of slices, with its number z."""
    return volumes.select(*keys, F.posexplode(slices).alias("z", "slice"))


def union_rows(*tables: DataFrame) -> DataFrame:
    """All rows of all tables; columns that one lacks are NULL there."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out
