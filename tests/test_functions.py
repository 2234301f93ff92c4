import math

import pytest
from pyspark.sql import functions as F

from evidenceframe.functions import boxes, coerce, text


def one(spark, **columns):
    row = spark.range(1).select(*(c.alias(n) for n, c in columns.items())).first()
    return row.asDict(recursive=True)


def test_casts(spark):
    cells = ["1.5", "", None, "x", " 3 ", "inf", "-2.9"]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(coerce.safe_float("c", -1.0).alias("f"), coerce.safe_int("c", 7).alias("i")).collect()
    assert [r.f for r in rows[:5]] == [1.5, -1.0, -1.0, -1.0, 3.0]
    assert [r.i for r in rows] == [1, 7, 7, 7, 3, 7, -2]


def test_divide_and_flag(spark):
    r = one(spark, a=coerce.safe_div(F.lit(1), F.lit(0)), b=coerce.safe_div(F.lit(1), F.lit(4)), t=coerce.flag(F.lit("TRUE")), n=coerce.flag(F.lit(None).cast("string")))
    assert r == {"a": 0.0, "b": 0.25, "t": True, "n": False}


def xyxy(r):
    return tuple(r[n] for n in ("x1", "y1", "x2", "y2"))


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [((0, 0, 10, 10), (5, 5, 15, 15), 25 / 175), ((0, 0, 0, 0), (0, 0, 0, 0), 0.0), ((0, 0, 4, 4), (4, 0, 8, 4), 0.0), ((0, 0, 4, 4), (0, 0, 4, 4), 1.0), ((3, 3, 1, 1), (0, 0, 4, 4), 0.0)],
)
def test_iou(spark, a, b, want):
    r = one(spark, v=boxes.iou(boxes.box(*a), boxes.box(*b)), w=boxes.iou(boxes.box(*b), boxes.box(*a)), m=boxes.iom(boxes.box(*a), boxes.box(*b)))
    assert math.isclose(r["v"], want) and r["v"] == r["w"] and 0 <= r["v"] <= r["m"] <= 1


def test_boxes_in_frames(spark):
    r = one(
        spark,
        edge=boxes.non_empty(boxes.box(300, 300, 300, 300), 200, 100), swapped=boxes.clamp(boxes.box(9, 9, 2, 3), 10, 10), inside=boxes.non_empty(boxes.box(5, 5, 5, 5), 10, 10),
        even=boxes.expand(boxes.box(10, 10, 15, 25), 280, 280, 0.5), none=boxes.expand(boxes.box(4, 4, 4, 9), 280, 280, 0.5), forced=boxes.expand(boxes.box(4, 4, 4, 9), 280, 280, 0.0, "inclusive"),
        around=boxes.union_of(F.array(boxes.box(0, 0, 0, 9), boxes.box(2, 3, 4, 5), boxes.box(1, 4, 3, 9))), nothing=boxes.union_of(F.array(boxes.box(0, 0, 0, 9))),
        inclusive=boxes.area(boxes.box(1, 1, 2, 2), "inclusive"),
    )
    assert xyxy(r["edge"]) == (198, 98, 199, 99) and xyxy(r["swapped"]) == (2, 3, 9, 9) and xyxy(r["inside"]) == (5, 5, 6, 6)
    assert xyxy(r["even"]) == (8, 2, 17, 33)  # 2.5 and 7.5 round to even
    assert xyxy(r["none"]) == (4, 4, 4, 9) and xyxy(r["forced"]) == (4, 4, 5, 9)
    assert xyxy(r["around"]) == (1, 3, 4, 9) and xyxy(r["nothing"]) == (0, 0, 0, 0) and r["inclusive"] == 4


@pytest.mark.parametrize("mode", boxes.MODES)
def test_transform_moves_corners(spark, mode):
    x1, y1, x2, y2, w, h = 2, 3, 7, 11, 20, 30
    points = []
    for x, y in ((x1, y1), (x2, y2)):
        W, H = w, h
        if "swap" in mode:
            x, y, W, H = y, x, h, w
        tail = mode.split("flip_")[1] if "flip_" in mode else ""
        points.append((W - x if "x" in tail else x, H - y if "y" in tail else y))
    (a, b), (c, d) = points
    assert xyxy(one(spark, v=boxes.transform(boxes.box(x1, y1, x2, y2), w, h, mode))["v"]) == (min(a, c), min(b, d), max(a, c), max(b, d))


def test_null_boxes_stay_null(spark):
    b = F.lit(None).cast("struct<x1:int,y1:int,x2:int,y2:int>")
    assert one(spark, v=boxes.area(b))["v"] is None


def test_labels(spark):
    words = ["tumor or infection", "Tumour", "感染", "肿瘤", "neither", None]
    rows = spark.createDataFrame([(w,) for w in words], "w string").select(text.label("w")).collect()
    assert [r[0] for r in rows] == ["infection", "tumor", "infection", "tumor", None, None]


def test_box_tokens(spark):
    t = "a [1,2,3,4] b [x1,y1,x2,y2] c [MASK] d"
    new = F.lit("[9]")
    r = one(spark, two=text.replace_first_boxes(F.lit(t), new), second=text.replace_nth_box(F.lit(t), new), none=text.replace_nth_box(F.lit("a [MASK]"), new), fall=text.replace_nth_box(F.lit("a [MASK]"), new, else_first=True), hidden=text.hide_box(F.lit("p\n[ 1, 2,3,4] [5,6,7,8]")), plain=text.hide_box(F.lit("nothing")))
    assert r == {"two": "a [9] b [9] c [MASK] d", "second": "a [1,2,3,4] b [9] c [MASK] d", "none": "a [MASK]", "fall": "a [9]", "hidden": "p\n[x1,y1,x2,y2] [5,6,7,8]", "plain": "nothing"}


def test_boxes_in_text(spark):
    cells = ['x [9,9,9,9] bbox: [1, 2,3,4]', '"bbox" : [5,6,7,8]', "[1,2\n,3,4]", "no box", None]
    rows = spark.createDataFrame([(c,) for c in cells], "c string").select(text.box_in_text("c").alias("b")).collect()
    assert [None if r.b is None else tuple(r.b) for r in rows] == [(1, 2, 3, 4), (5, 6, 7, 8), (1, 2, 3, 4), None, None]


def test_names(spark):
    r = one(
        spark,
        last=text.patient_id(F.lit("a/123456/img_9876543_1.jpg")), none=text.patient_id(F.lit("12345")), z=text.slice_index(F.lit("p/x_slice-12_z3.png")), layer=text.slice_index(F.lit("1_1_layer_7.jpg")),
        t2=text.sequence_of_path(F.lit("x/12_2_a.jpg")), t1=text.sequence_of_path(F.lit("T1/zz.jpg")), blank=text.sequence_of_path(F.lit("q.jpg")), wi=text.sequence_token(F.lit("a T2WI b")), code=text.sequence_code(F.lit("seq_2")), empty=text.sequence_code(F.lit(None).cast("string")),
        nii=text.file_id(F.lit("/a/b.c.nii.gz")), npz=text.file_id(F.lit("/a/b.npz")), slug=text.slug(F.lit(" Ab--C d! ")), mapped=text.remap_path(F.lit("/srv/data/x.jpg"), "/srv/data", "/mnt"), kept=text.remap_path(F.lit("/other/x.jpg"), "/srv/data", "/mnt"),
        sample=text.sample_of_indexed_path(F.lit("000012_case_7.jpg")), many=text.lesion_pattern(F.lit("Multi-Lesion")), one=text.lesion_pattern(F.lit(" Single-Lesion ")), numbers=text.number_list(F.lit("3, 1,3,0,x")), number=text.first_number(F.lit("about -2.5 of 7")), path=text.image_path(F.lit("p <|vision_start|> a b.jpg <|vision_end|> q")),
    )
    assert r == {"last": "9876543", "none": None, "z": 3, "layer": 7, "t2": "T2", "t1": "T1", "blank": "", "wi": "T2WI", "code": "T2", "empty": "", "nii": "b.c", "npz": "b", "slug": "ab_c_d", "mapped": "/mnt/x.jpg", "kept": "/other/x.jpg", "sample": "case_7", "many": "multiple", "one": "single", "numbers": [1, 3], "number": -2.5, "path": "a b.jpg"}


def test_lesion_words(spark):
    words = {"0": "single", "1": "multiple", "unifocal": "single", "Solitary": "single", "multifocal": "multiple", "multiple lesions": "multiple", "2": "", "multi": "", "": "", None: ""}
    rows = spark.createDataFrame([(w,) for w in words], "w string").select("w", text.lesion_pattern("w").alias("p")).collect()
    assert {r.w: r.p for r in rows} == words


def test_misread_labels(spark):
    words = [text.INFECTION_ZH.encode().decode("gbk", "ignore"), text.TUMOR_ZH.encode().decode("gbk", "ignore")]
    assert words == [text.INFECTION_MISREAD, text.TUMOR_MISREAD]
    assert [r[0] for r in spark.createDataFrame([(w,) for w in words], "w string").select(text.label("w")).collect()] == ["infection", "tumor"]


def test_prompts(spark):
    b = boxes.box(1, 2, 3, 4)
    r = one(spark, legacy=text.build_prompt(F.lit("T1"), b, "legacy"), own=text.region_prompt(F.lit(""), b, F.lit(2), F.lit(3)), given=text.region_prompt(F.lit("a [5,6,7,8] b [MASK]"), b, F.lit(1), F.lit(1)), path=text.record_image_path("/d/", F.lit("val"), F.lit("x.jpg")))
    assert r["legacy"].startswith("现在你是一个骨科专家") and "序列为T1。" in r["legacy"] and "在[1,2,3,4]这个位置" in r["legacy"]
    assert "候选病灶区域2/3" in r["own"] and r["given"].startswith("a [5,6,7,8] b [1,2,3,4]\n补充说明") and r["path"] == "/d/val/image/x.jpg"


def test_score_texts(spark):
    values = [0.0, 1.0, 0.1, 1 / 3, 2 / 3 * 100, 1.5e-7, 123456789.125, 0.1 + 0.2, 5e20, -2.5, 1e-4, 100.0]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", text.score_text("v").alias("t")).collect()
    assert [r.t.replace("e-07", "e-07") for r in rows] == [f"{v:.12g}" for v in values]


def test_lists_and_keys(spark):
    r = one(spark, floats=text.float_list(F.lit("0.3, x,0.5,")), keys=text.record_keys(F.lit("S 1"), F.lit("a\\B.C.JPG"), F.lit(7)), none=text.record_keys(F.lit(None).cast("string"), F.lit("q"), F.lit(1)))
    assert r == {"floats": [0.3, 0.5], "keys": ["b.c.jpg", "b.c", "000007_s_1", "000007_s_1.jpg"], "none": ["q", "000001_q"]}
