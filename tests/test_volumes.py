import gzip
import io
import json
import os
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceframe.operators import checks, matching
from evidenceframe.sources import readers, sinks, staging, volumes


def npz(path, **arrays):
    np.savez_compressed(path, **arrays)


def plain(rows):
    return {(r.case_id, r.z): (np.array(r.image), np.array(r.mask)) for r in rows if r.error is None}


def test_archives_by_slice(spark, tmp_path):
    draw = np.random.default_rng(1)
    a = draw.normal(size=(3, 4, 5))
    m = draw.integers(0, 3, (3, 4, 5))
    npz(tmp_path / "b.npz", image=a, mask=m)
    npz(tmp_path / "a.npz", image=np.asfortranarray(a.astype("f4")), mask=np.asfortranarray(m.astype("u1")))
    npz(tmp_path / "c.npz", image=a.astype(">i2"), mask=draw.integers(0, 2, (3, 2, 7)))
    rows = volumes.read_volumes(spark, str(tmp_path)).collect()
    got = plain(rows)
    assert len(rows) == len(got) == 9 and {(r.depth, r.height, r.width) for r in rows} == {(3, 4, 5)}
    for z in range(3):
        for case in "ab":
            assert np.array_equal(got[case, z][0], a[z].astype("f4").ravel()) and np.array_equal(got[case, z][1], (m[z] > 0).ravel())
        assert np.array_equal(got["c", z][0], a[z].astype(">i2").ravel())


def test_nearest_takes_the_pixel_below_the_centre():
    for h, w, th, tw in ((2, 7, 4, 5), (8, 8, 3, 12), (1, 1, 2, 2), (5, 4, 5, 4)):
        v = np.arange(h * w).reshape(h, w)
        want = [[v[int((y + 0.5) * h / th), int((x + 0.5) * w / tw)] for x in range(tw)] for y in range(th)]
        assert volumes.nearest(v, th, tw).tolist() == want


def test_what_is_rejected_and_what_is_not(spark, tmp_path):
    ok = np.ones((2, 3, 3))
    npz(tmp_path / "good.npz", image=ok, mask=ok)
    npz(tmp_path / "key.npz", image=ok, label=ok)
    npz(tmp_path / "flat.npz", image=ok[0], mask=ok[0])
    npz(tmp_path / "depth.npz", image=ok, mask=ok[:1])
    npz(tmp_path / "objects.npz", image=ok, mask=np.array([[[None]]] * 2))
    (tmp_path / "text.npz").write_text("no archive")
    big = io.BytesIO()
    np.savez(big, image=np.random.default_rng(0).normal(size=(4, 64, 64)), mask=np.ones((4, 64, 64)))
    (tmp_path / "cut.npz").write_bytes(big.getvalue()[:100_000])
    rows = volumes.read_volumes(spark, str(tmp_path))
    wrong = {r.case_id: r.error for r in volumes.rejected(rows).collect()}
    assert set(wrong) == {"key", "flat", "depth", "objects", "text", "cut"}
    assert wrong["key"] == "no array mask among image, label" and wrong["flat"] == "image has 2 dimensions" and wrong["depth"] == "depths 2 and 1"
    assert {(r.case_id, r.z) for r in volumes.accepted(rows).collect()} == {("good", 0), ("good", 1)}
    named = volumes.read_volumes(spark, str(tmp_path / "key.npz").replace("key.npz", ""), maskKey="label")
    assert "key" in {r.case_id for r in volumes.accepted(named).collect()}


def test_reading_nothing(spark, tmp_path):
    assert volumes.read_volumes(spark, str(tmp_path / "none")).count() == 0
    rows = volumes.read_volumes(spark, str(tmp_path), "nifti")
    assert rows.count() == 0 and volumes.accepted(rows).count() == 0


def test_files_are_dealt_by_bytes(tmp_path):
    for k in range(6):
        (tmp_path / f"v{k}.npz").write_bytes(b"x" * 100)
    reader = volumes.VolumeReader({"path": str(tmp_path), "taskBytes": "250"})
    parts = [[v.case_id for v in p.volumes] for p in reader.partitions()]
    assert parts == [["v0", "v1"], ["v2", "v3"], ["v4", "v5"]]


def slices(spark, cases, depth=3, height=2, width=3):
    rows = [(c, s, z, height, width, [float(z * 10 + k) for k in range(height * width)], [(z + k) % 2 for k in range(height * width)]) for c, s in cases for z in range(depth)]
    return spark.createDataFrame(rows, "case_id string, split string, z int, height int, width int, image array<float>, mask array<byte>")


def test_a_data_set_is_written_whole_and_read_back(spark, tmp_path):
    path = str(tmp_path / "set")
    df = slices(spark, [("a", "train"), ("b", "val"), ("c", None)])
    volumes.write_volumes(df, path, datasetName="x", datasetId=12)
    assert sorted(os.listdir(path)) == ["dataset.json", "imagesTr", "imagesTs", "labelsTr", "labelsTs"]
    document = json.load(open(f"{path}/dataset.json"))
    assert (document["numTraining"], document["numTest"], document["dataset_name"]) == (2, 1, "Dataset012_x")
    rows = volumes.read_volumes(spark, path, "nifti").collect()
    assert {(r.case_id, r.split) for r in rows} == {("a", "train"), ("b", "test"), ("c", "train")}
    for (c, z), (image, mask) in plain(rows).items():
        assert image.tolist() == [z * 10 + k for k in range(6)] and mask.tolist() == [(z + k) % 2 for k in range(6)]
    voxels = readers.nifti_array(open(f"{path}/imagesTr/a_0000.nii.gz", "rb").read())
    assert voxels.shape == (3, 2, 3) and voxels[2, 1, 0] == 5
    with pytest.raises(Exception, match="holds a data set"):
        volumes.write_volumes(df, path)
    volumes.write_volumes(slices(spark, [("d", "train")]), path, overwrite=True)
    assert sorted(os.listdir(f"{path}/imagesTr")) == ["d_0000.nii.gz"] and not os.path.exists(f"{path}/imagesTs")
    os.remove(f"{path}/labelsTr/d.nii.gz")
    assert [r.error for r in volumes.rejected(volumes.read_volumes(spark, path, "nifti")).collect()] == ["no mask of this name"]


@pytest.mark.parametrize("how", ["gap", "size", "name"])
def test_a_failed_task_leaves_no_file(spark, tmp_path, how):
    path = str(tmp_path / "set")
    df = slices(spark, [("good", "train"), ("bad", "train")])
    if how == "gap":
        df = df.where("case_id <> 'bad' or z <> 1")
    elif how == "size":
        df = df.withColumn("image", F.when((F.col("case_id") == "bad") & (F.col("z") == 2), F.array(F.lit(1.0).cast("float"))).otherwise(F.col("image")))
    else:
        df = df.withColumn("case_id", F.when(F.col("case_id") == "bad", "x/y").otherwise(F.col("case_id")))
    with pytest.raises(Exception, match="in place of|can't be named"):
        volumes.write_volumes(df, path)
    assert not [f for _, _, files in os.walk(path) for f in files]


def test_masks_of_another_size_and_single_masks(spark, tmp_path):
    df = slices(spark, [("a", "train")]).withColumns({"mask": F.array(F.lit(1).cast("byte"), F.lit(0).cast("byte"), F.lit(0).cast("byte")), "mask_height": F.lit(1), "mask_width": F.lit(3)})
    for form in ("npz", "nifti"):
        volumes.write_volumes(df, str(tmp_path / form), form)
        rows = volumes.read_volumes(spark, str(tmp_path / form), form, pixels="false").collect()
        assert len(rows) == 3 and all(r.image is None and r.mask == [1, 0, 0, 1, 0, 0] for r in rows)
    rows = volumes.read_volumes(spark, str(tmp_path / "nifti" / "labelsTr"), "mask").collect()
    assert [(r.case_id, r.z, r.height, r.width, r.mask) for r in rows] == [("a", z, 1, 3, [1, 0, 0]) for z in range(3)]


def head(**fields):
    raw = bytearray(volumes.nifti_head((2, 1, 1), "f4"))
    for at, (kind, *v) in fields.values():
        struct.pack_into(kind, raw, at, *v)
    return bytes(raw) + struct.pack("<2f", 3, 0)


@pytest.mark.parametrize(("slope", "shift", "want"), [(float("nan"), float("nan"), 3), (0, 5, 3), (2, 1, 7), (1, 0, 3)])
def test_slopes(slope, shift, want):
    raw = head(slope=(112, ("<2f", slope, shift)))
    assert readers.nifti_array(raw)[0, 0, 0] == want and volumes.nifti_stream(io.BytesIO(gzip.compress(raw))).read()[0, 0] == want


def test_unknown_voxels_are_an_error():
    with pytest.raises(ValueError, match="type 1792"):
        volumes.nifti_stream(io.BytesIO(head(kind=(70, ("<h", 1792)))))


def test_archives_that_spark_has_read(spark, tmp_path):
    npz(tmp_path / "a.npz", image=np.ones((1, 4, 4)), mask=np.array([[[1, 0], [0, 0]]]))
    npz(tmp_path / "b.npz", image=np.ones((1, 4, 4)), mask=np.ones((2, 4, 4)))
    rows = {r.case_id: r for r in readers.npz_volumes(readers.files(spark, str(tmp_path), "*.npz")).collect()}
    assert sum(rows["a"].mask) == 4 and rows["a"].error is None and rows["b"].error == "depths 1 and 2"


def test_named_files_are_all_there_or_none(spark, tmp_path):
    path = str(tmp_path / "out")
    files = spark.createDataFrame([("x/1.txt", "one"), ("x/2.txt", None), ("3.txt", "é")], "name string, content string").repartition(3)
    staging.write_named(files, path)
    assert open(f"{path}/x/1.txt").read() == "one" and open(f"{path}/x/2.txt").read() == "" and open(f"{path}/3.txt", encoding="utf-8").read() == "é"
    more = spark.createDataFrame([("4.txt", "four"), ("3.txt", "again")], "name string, content string")
    with pytest.raises(Exception, match="3.txt"):
        staging.write_named(more, path)
    with pytest.raises(Exception, match="name of another"):
        staging.write_named(spark.createDataFrame([("5.txt", "a"), ("5.txt", "b")], "name string, content string"), path)
    assert sorted(os.listdir(path)) == ["3.txt", "x"] and open(f"{path}/3.txt", encoding="utf-8").read() == "é"


def test_ordered_files_and_their_bounds(spark, tmp_path):
    rows = spark.range(5000).select((F.col("id") * 7919 % 5000).alias("k"), (F.col("id") % 2).alias("same"))
    m = sinks.write_ordered(rows, str(tmp_path / "a"), ["k"]).orderBy("file").collect()
    assert sum(r["rows"] for r in m) == 5000 and all(a.greatest.k < b.least.k for a, b in zip(m, m[1:]))
    found = readers.numbered(readers.read_csv(spark, str(tmp_path / "a"), "k long, same long"))
    assert found.where("k <> pos").count() == 0
    # rows of one key fill several files
    one = spark.range(4000).withColumn("k", F.lit(1))
    assert sinks.write_ordered(one.repartition(4), str(tmp_path / "b"), ["k"], "parquet").agg(F.sum("rows")).first()[0] == 4000


def test_checkpoints(spark, tmp_path):
    for folder, names in {"checkpoint-5": [*readers.CHECKPOINT_FILES, "adapter_model.bin"], "checkpoint-40": [*readers.CHECKPOINT_FILES], "checkpoint-x": ["optimizer.pt"], "checkpoint-9": ["notes"]}.items():
        (tmp_path / folder).mkdir()
        for n in names:
            (tmp_path / folder / n).write_text("x")
    listed = readers.listing(spark, str(tmp_path))
    assert [(r.step, r.whole) for r in readers.checkpoints(listed).orderBy("step").collect()] == [(5, True), (9, False), (40, False)]
    assert readers.latest_checkpoint(listed).first().step == 5
    assert readers.latest_checkpoint(listed.where("name = 'notes'")).count() == 0
    assert [r.path for r in listed.collect()] == sorted(r.path for r in listed.collect())


def test_a_strategy_without_rows(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2)], "strategy string, v int")
    assert sorted(r.v for r in matching.only_strategy(rows, "a", required=True).collect()) == [1, 2]
    assert matching.only_strategy(rows, "b").count() == 0
    with pytest.raises(Exception, match="no rows of strategy b"):
        matching.only_strategy(rows, "b", required=True).collect()
    assert issubclass(checks.CheckFailed, ValueError)


def test_detector_records(spark):
    rows = spark.createDataFrame([("a.jpg", (0, 0, 5, 5)), ("b.gif", (0, 0, 5, 5)), ("c.PNG", (12, 0, 15, 5)), (None, (0, 0, 5, 5)), ("d.jpg", None), ("e.jpg", (5, 5, -3, 50))], "image_path string, box struct<x1:int,y1:int,x2:int,y2:int>")
    rows = rows.withColumns({"width": F.lit(10), "height": F.lit(10)})
    good, bad = matching.detector_records(rows, spark.createDataFrame([(x,) for x in ("a.jpg", "b.gif", "c.PNG")], "image_path string"))
    assert [r.image_path for r in good.collect()] == ["a.jpg"]
    assert {r.image_path: r.reason for r in bad.collect()} == {"b.gif": "unsupported image extension", "c.PNG": "empty bbox", None: "missing image path or bbox", "d.jpg": "missing image path or bbox", "e.jpg": "image not found"}
    good, _ = matching.detector_records(rows.where("image_path = 'e.jpg'"))
    assert tuple(good.first().box) == (0, 5, 5, 9)


def test_best_overlap_equals_all_pairs(spark):
    draw = np.random.default_rng(4)

    def boxes(n, groups):
        out = []
        for k in range(n):
            x, y, w, h = (int(v) for v in (*draw.integers(-40, 300, 2), *draw.integers(-3, 90, 2)))
            box = None if k % 17 == 0 else (x, y, x + w, y + h)
            out.append((int(draw.integers(0, groups)), k, int(draw.integers(0, 6)) if k % 11 else None, box))
        return out

    a, b = boxes(120, 5), boxes(200, 6)
    kind = "struct<x1:int,y1:int,x2:int,y2:int>"
    cases = spark.createDataFrame(a, f"g int, id int, z int, box {kind}")
    records = spark.createDataFrame(b, f"g int, rec int, slice_idx int, record_box {kind}")
    got = {r.id: (r.rec, r.match_method) for r in matching.best_overlap(cases, records, ["g"], "id", "rec").collect()}

    def iou(p, q):
        if p is None or q is None:
            return 0
        side = lambda u, v: max(0, v - u)
        inter = side(max(p[0], q[0]), min(p[2], q[2])) * side(max(p[1], q[1]), min(p[3], q[3]))
        total = sum(side(t[0], t[2]) * side(t[1], t[3]) for t in (p, q)) - inter
        return round(inter / total, 9) if total else 0

    want = {}
    for g, i, z, p in a:
        own = [r for r in b if r[0] == g]
        at = [r for r in own if z is not None and r[2] == z]
        if len(at) == 1:
            want[i] = (at[0][1], "patient_seq_slice")
        elif own:
            want[i] = (min(own, key=lambda r: (-iou(p, r[3]), r[1]))[1], "patient_seq_single" if len(own) == 1 else "patient_seq_best_bbox")
    assert got == want
