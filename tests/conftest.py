import os
import sys
import tempfile
from pathlib import Path

import pytest

ROOT = str(Path(__file__).resolve().parent.parent)
sys.path.insert(0, ROOT)
os.environ["PYTHONPATH"] = os.pathsep.join([ROOT, os.environ.get("PYTHONPATH", "")])

from pyspark.sql import SparkSession  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    session = (
        SparkSession.builder.master("local[4]").appName("tests").config("spark.driver.memory", "4g").config("spark.sql.shuffle.partitions", "4").config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.local.dir", folder).config("spark.sql.warehouse.dir", f"{folder}/warehouse").getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    return session


@pytest.fixture(scope="session")
def duck():
    import duckdb

    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for p in sorted(Path(SF).iterdir()):
        con.execute(f"create view {p.stem} as select * from '{p}{'/*.parquet' if p.is_dir() else ''}'")
    return con


def cell(v):
    """A value in a form in which both engines agree."""
    import datetime
    import decimal

    if v is None:
        return "null"
    if isinstance(v, bool) or type(v).__name__ == "bool_":
        return str(bool(v))
    if isinstance(v, (int, float, decimal.Decimal)):
        return "nan" if v != v else repr(round(float(v), 8) + 0.0)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


def same_rows(df, con, sql):
    result = con.execute(sql)
    names = [d[0] for d in result.description]
    want = [dict(zip(names, r)) for r in result.fetchall()]
    got = [r.asDict() for r in df.collect()]
    assert sorted(names) == sorted(df.columns)
    key = lambda rows: sorted(tuple(cell(r[n]) for n in sorted(names)) for r in rows)
    a, b = key(want), key(got)
    assert len(a) == len(b), (len(a), len(b))
    for x, y in zip(a, b):
        assert x == y
