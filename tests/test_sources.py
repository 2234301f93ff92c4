import gzip
import io
import json
import struct
import tempfile
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceframe.operators.checks import CheckFailed
from evidenceframe.sources import readers, sinks
from evidenceframe.streaming import telemetry

from .conftest import SF


@pytest.fixture
def folder():
    return tempfile.mkdtemp(prefix="sources-", dir="/tmp")


def record(i, text, answer="infection", **more):
    return {"id": i, "conversations": [{"from": "user", "value": text}, {"from": "assistant", "value": answer}], **more}


def test_csv_keeps_text(spark, folder):
    Path(folder, "a.csv").write_text('﻿id,note\n007,"two\nlines ""quoted"""\n8,\n', encoding="utf-8")
    rows = readers.read_csv(spark, f"{folder}/a.csv").orderBy("id").collect()
    assert [tuple(r) for r in rows] == [("007", 'two\nlines "quoted"'), ("8", None)]


def test_records(spark, folder):
    path = f"{folder}/r.json"
    good = record("a", "T1 in [1,2,3,4] <|vision_start|>d/123456_1_z7.jpg<|vision_end|>")
    manifest = record("", "no box <|vision_start|>x_2.jpg<|vision_end|>", "肿瘤", bbox=[5, 6, 7, 8], slice_manifest={"patient_id": "p9", "slice_idx": "4"})
    bad = [{"id": "c", "conversations": []}, record("d", "no image [1,2,3,4]"), record("e", "<|vision_start|>i.jpg<|vision_end|>", "unclear")]
    Path(path).write_text(json.dumps([good, manifest, *bad]))
    rows = {r.image_path: r for r in readers.read_records(spark, path).collect()}
    assert set(rows) == {"d/123456_1_z7.jpg", "x_2.jpg"}
    a, b = rows["d/123456_1_z7.jpg"], rows["x_2.jpg"]
    assert (a.sample_id, a.label, a.patient_id, a.seq, a.slice_idx, tuple(a.box)) == ("a", "infection", "123456", "T1", 7, (1, 2, 3, 4))
    assert (b.label, b.patient_id, b.slice_idx, tuple(b.box)) == ("tumor", "p9", 4, (5, 6, 7, 8)) and b.sample_id.startswith("sample_")


def test_cases_last_wins(spark, folder):
    Path(folder, "c.json").write_text(json.dumps([{"case_id": "a", "label": "x"}, {"case_id": "a", "label": "y"}]))
    assert readers.read_cases(spark, f"{folder}/c.json").first().label == "y"


def test_blank_detections(spark):
    rows = spark.createDataFrame([("a", "1", "0.9", "1", "2", "3.5", "4"), ("a", "2", "0.5", "0", "0", "1", "1"), ("b", "", "", "", "", "", "")], "image_path string, rank string, conf string, x1 string, y1 string, x2 string, y2 string")
    assert [r.image_path for r in readers.detections(rows, 1).collect()] == ["a"]
    old = {r.image_path: r for r in readers.detections(rows, 1, phantom=True).collect()}
    assert old["b"].conf == 0.0 and tuple(old["b"].box) == (0, 0, 1, 1)


def test_volumes(spark, folder):
    image = np.arange(24, dtype=np.float32).reshape(2, 3, 4)
    for name, mask in (("ok", (image > 20).astype(np.uint8)), ("odd", np.zeros((2, 3)))):
        buffer = io.BytesIO()
        np.savez(buffer, image=image, mask=mask)
        Path(folder, f"{name}.npz").write_bytes(buffer.getvalue())
    rows = readers.npz_volumes(readers.files(spark, folder, "*.npz"))
    assert {r.case_id: r.error is None for r in rows.collect()} == {"ok": True, "odd": False}
    px = readers.pixels(rows)
    assert px.count() == 24 and {(r.z, r.y, r.x) for r in px.where("mask = 1").collect()} == {(1, 2, 1), (1, 2, 2), (1, 2, 3)}


def test_nifti(spark, folder):
    a = np.zeros((3, 2, 2), np.int16)
    a[2, 1, 0] = 5
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, 3, 2, 2, 1, 1, 1, 1)
    struct.pack_into("<h", head, 70, 4)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    Path(folder, "m.nii.gz").write_bytes(gzip.compress(bytes(head) + a.tobytes(order="F")))
    got = readers.nifti_masks(readers.files(spark, folder, "*.nii.gz")).collect()
    assert [tuple(r) for r in got] == [("m", 0, 1, 2)]


def test_run_reports(spark, folder):
    Path(folder, "t.txt").write_text("\tMaximum resident set size (kbytes): 2048\n\tElapsed (wall clock) time (h:mm:ss or m:ss): 1:02.5\nnothing\n")
    rows = {r.key: r.value for r in readers.run_report(spark, f"{folder}/t.txt").collect()}
    assert rows == {"Maximum resident set size (kbytes)": "2048", "Elapsed (wall clock) time (h:mm:ss or m:ss)": "1:02.5"}


def test_seconds(spark):
    assert tuple(spark.range(1).select(readers.seconds_of(F.lit("1:02.5")), readers.seconds_of(F.lit("2:00:01"))).first()) == (62.5, 7201.0)


def test_telemetry_drops_rows_with_any_bad_number(spark, folder):
    Path(folder, "g.csv").write_text("2024/01/01, 100 MiB, 50 %, 80.5 W\nbroken\n2024/01/01, 300 MiB, 70 %, 90 W\n2024/01/01, 500 MiB, [N/A], 90 W\n2024/01/01, 7 MiB, 70 %, -\n")
    assert [(r.mem_mib, r.util_pct, r.power_w) for r in readers.telemetry(spark, f"{folder}/g.csv").collect()] == [(100.0, 50.0, 80.5), (300.0, 70.0, 90.0)]


def test_metric_documents(spark, folder):
    Path(folder, "m.json").write_text(json.dumps({"patient_level": {"quality": {"acc": 0.5, "n": 3}}}))
    assert readers.metric_document(spark, f"{folder}/m.json").first().metrics == {"acc": 0.5, "n": 3.0}


def test_places_go_on_across_files(spark, folder):
    for name, ids in (("a", ["", "x"]), ("b", ["", "", "x"]), ("c", [""])):
        Path(folder, f"{name}.json").write_text(json.dumps([record(i, f"[1,2,3,4] <|vision_start|>{name}{k}.jpg<|vision_end|>") for k, i in enumerate(ids)]))
    rows = {r.image_path: r.sample_id for r in readers.read_records(spark, f"{folder}/*.json").collect()}
    assert rows == {"a0.jpg": "sample_0", "a1.jpg": "x", "b0.jpg": "sample_2", "b1.jpg": "sample_3", "b2.jpg": "x", "c0.jpg": "sample_5"}
    for name, label in (("d", "x"), ("e", "y")):
        Path(folder, f"{name}.cases").write_text(json.dumps([{"case_id": "k", "label": label}]))
    assert [r.label for r in readers.read_cases(spark, f"{folder}/*.cases").collect()] == ["y"]


def test_sinks(spark, folder):
    a = spark.createDataFrame([(1, True)], "id long, ok boolean")
    b = spark.createDataFrame([(2, "x")], "id long, note string")
    sinks.write_union_csv([a, b], f"{folder}/out", ["note"])
    rows = sorted(tuple(r) for r in readers.read_csv(spark, f"{folder}/out").select("id", "ok", "note").collect())
    assert rows == [("1", "True", None), ("2", None, "x")]
    with pytest.raises(Exception, match="(?i)exists"):
        sinks.write_csv(a, f"{folder}/out")
    sinks.write_json(b, f"{folder}/json")
    assert spark.read.json(f"{folder}/json").first().note == "x"


def test_marked_csv_documents_and_assignments(spark, folder):
    rows = spark.createDataFrame([(2, "b", "adapt"), (1, "a", None), (1, "0", "outer_test")], "fold int, patient_id string, role string")
    sinks.write_csv(rows, f"{folder}/bom", bom=True)
    assert all(f.read_bytes().startswith(b"\xef\xbb\xbffold") for f in Path(folder, "bom").glob("*.csv"))
    assert sorted(readers.read_csv(spark, f"{folder}/bom").columns) == ["fold", "patient_id", "role"]
    sinks.write_document(rows, f"{folder}/doc")
    text = "".join(f.read_text() for f in sorted(Path(folder, "doc").glob("*.txt")))
    assert json.loads(text)[0] == {"fold": 1, "patient_id": "0", "role": "outer_test"} and len(json.loads(text)) == 3
    sinks.write_assignments(rows, f"{folder}/roles")
    got = [tuple(r) for r in readers.read_csv(spark, f"{folder}/roles").select("fold", "role", "patient_id").collect()]
    assert sorted(got, key=str) == sorted([("1", None, "a"), ("1", "outer_test", "0"), ("2", "adapt", "b")], key=str)


def test_label_tables(spark):
    t = spark.createDataFrame([("1", "0"), ("1", "Multi lesion"), (" ", "1")], "patient_id string, lesion_pattern string")
    with pytest.raises(CheckFailed):
        readers.clinical_labels(t)
    s = spark.createDataFrame([("1", "1", "a", "c", "dev")], "patient_id string, seq_id string, label string, case_id string, split string")
    with pytest.raises(CheckFailed):
        readers.split_table(s)


def test_stream_matches_batch_for_closed_windows(spark, folder):
    source = f"{folder}/in"
    spark.read.parquet(f"{SF}/events.parquet").orderBy("ts").coalesce(1).write.parquet(source)
    stream = telemetry.windowed_summary(telemetry.sample_stream(spark, source))
    telemetry.run_to_table(stream, "telemetry_windows_test", f"{folder}/checkpoint").awaitTermination()
    rows = spark.read.parquet(source).select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mem_mib"), (F.col("user_id") % 101).cast("double").alias("util_pct"))
    whole = {r.window_start: r.samples for r in telemetry.windowed_summary(rows, late=None).collect()}
    got = {r.window_start: r.samples for r in spark.table("telemetry_windows_test").collect()}
    assert got and all(whole[k] == n for k, n in got.items()) and len(whole) - len(got) <= 4
