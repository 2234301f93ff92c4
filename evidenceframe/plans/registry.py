"""Name -> query and name -> DuckDB SQL, from the modules of this package."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources.fixtures import with_views
from . import evidence, files, geometry, records, reports, statistics

Query = Callable[[SparkSession, str], DataFrame]
MODULES = (evidence, geometry, records, reports, statistics, files)


def all_queries() -> dict[str, Query]:
    return {name: q for m in MODULES for name, q in m.QUERIES.items()}


def all_oracles() -> dict[str, str]:
    return {name: with_views(sql) for m in MODULES for name, sql in m.ORACLES.items()}
