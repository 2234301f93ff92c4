"""Steps whose work must not grow faster than their input."""

import os
import pickle
import random

import pyarrow as pa
from pyspark.sql import functions as F

from evidenceframe.functions import boxes
from evidenceframe.operators import matching, resample, score_bootstrap
from evidenceframe.plans.registry import all_queries
from evidenceframe.sources import readers, staging

from .conftest import SF


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_alternative_keys_meet_one_row_each(spark):
    left, right = spark.range(40).withColumnRenamed("id", "a"), spark.range(60).withColumnRenamed("id", "b")
    df = matching.first_key_match(left, F.array(F.col("a") % 3, F.lit(9)), "a", right, F.array(F.lit(9), F.col("b") % 5 + 1), "b")
    plan = optimized(df)
    assert plan.count("Aggregate") == 2 and plan.index("Join") < plan.rindex("Aggregate")
    got = {r.a: (r.b, r.key) for r in df.collect()}
    assert got == {a: ((a % 3 - 1), a % 3) if a % 3 else (0, 9) for a in range(40)}


def largest_method(df):
    """Bytes of the largest method generated for a query; beyond 8,000 the JVM interprets it."""
    debug = getattr(getattr(df.sparkSession._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$")
    found = debug.codegenStringSeq(df._jdf.queryExecution().executedPlan())
    return max(found.apply(i)._3().maxMethodCodeSize() for i in range(found.length()))


def test_code_of_boxes_is_compiled(spark):
    for name in ("box_remap", "detector_rejects"):
        assert largest_method(all_queries()[name](spark, SF)) <= 8000, name


def test_rescaled_boxes_by_mode(spark):
    rows = spark.createDataFrame([(1, 5, 9, 30, 4), (2, -3, 0, 7, 7), (3, None, 1, 2, 3)], "k long, a long, b long, c long, d long").select("k", boxes.box("a", "b", "c", "d").alias("p"))
    got = {(r.k, r.mode): (r.x1, r.y1, r.x2, r.y2) for r in boxes.rescaled(rows, F.col("p"), 40, 60, 17, 23).collect()}
    for mode in boxes.MODES:
        for r in rows.select("k", boxes.rescale(F.col("p"), 40, 60, 17, 23, mode).alias("b")).select("k", "b.*").collect():
            assert got.pop((r.k, mode)) == (r.x1, r.y1, r.x2, r.y2)
    assert not got


def test_best_overlap_of_small_and_large_keys(spark):
    draw = random.Random(5)
    at = lambda n: [(draw.randrange(3), i, draw.randrange(4), draw.randrange(90), draw.randrange(90), draw.randrange(1, 60), draw.randrange(1, 60)) for i in range(n)]
    table = lambda n, *names: spark.createDataFrame(at(n), "g int, i int, s int, x int, y int, w int, h int").select("g", F.col("i").alias(names[0]), F.col("s").alias(names[1]), boxes.box(F.col("x"), F.col("y"), F.col("x") + F.col("w"), F.col("y") + F.col("h")).alias(names[2]))
    cases, records = table(60, "id", "z", "box"), table(14, "rec", "slice_idx", "record_box")
    found = [sorted(map(tuple, matching.best_overlap(cases, records, ["g"], "id", "rec", few=few).collect())) for few in (0, 4, 256)]
    assert found[0] == found[1] == found[2] and len(found[0]) == 60


def test_every_row_of_every_iteration_is_drawn(spark, monkeypatch):
    monkeypatch.setattr(resample, "BLOCK", 12)  # several blocks, and a last one that isn't full
    cells = {("a", None): 5, ("a", "x"): 21, ("a", "y"): 13, ("b", "x"): 1, ("b", "z"): 9}
    rows = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "s string, c string")
    got = {(r.iter, r.s, r.c): r.n for r in resample.drawn_counts(rows, ["s"], ["c"], 4, 42).collect()}

    def mixed(x):
        x = ((x ^ (x >> 15)) * resample.FIRST) & resample.BITS
        x = ((x ^ (x >> 14)) * resample.SECOND) & resample.BITS
        return x ^ (x >> 15)

    want = {}
    for s in "ab":
        held = [k for k, n in cells.items() if k[0] == s for _ in range(n)]
        code = spark.createDataFrame([(s,)], "s string").select(resample.stratum_number(["s"])).first()[0]
        for i in range(4):
            h = mixed((mixed((code + 42 * 7919) & resample.BITS) + i) & resample.BITS)
            for slot in range(len(held)):
                a = mixed((h + slot) & resample.BITS)
                k = (i, *held[((a << 31) + mixed((a + 0x5BD1E995) & resample.BITS)) % len(held)])
                want[k] = want.get(k, 0) + 1
    assert got == want


def test_what_tasks_tell_the_driver_about_files_does_not_grow(spark, tmp_path):
    batch = pa.RecordBatch.from_pydict({"name": [f"labels/train/{i}.txt" for i in range(3000)], "content": [b"1\r\n2\n"] * 3000})
    writer = staging.NamedFilesWriter(str(tmp_path / "out"))
    message = writer.write([batch])
    assert len(pickle.dumps(message)) < 500
    writer.commit([message, None])
    assert len(os.listdir(tmp_path / "out/labels/train")) == 3000 and os.listdir(tmp_path / "out") == ["labels"]
    names = spark.range(3000).select(F.format_string("labels/train/%d.txt", "id").alias("name"))
    got = readers.lines_of(names, str(tmp_path / "out")).groupBy("value").count().collect()
    assert {(r.value, r["count"]) for r in got} == {("1", 3000), ("2", 3000)}


def test_all_picks_come_from_one_ranking(spark):
    plan = all_queries()["selection_cube"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2 and plan.count("Window [") == 1 and "Join" not in plan


def test_single_draws_are_not_sent_through_the_driver(spark, monkeypatch):
    plans, scratch = [], score_bootstrap._scratch
    monkeypatch.setattr(score_bootstrap, "_scratch", lambda rows: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or scratch(rows))
    rows = spark.range(60).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("y"), (F.col("id") / 60).alias("p"))
    assert score_bootstrap.draw_metrics(rows, {"one": "p"}, 2).count() == 2
    met = [p for p in plans if "slot" in p and "Join [y" in p and "_j" in p]
    assert met and all("SortMergeJoin [y" in p for p in met)
