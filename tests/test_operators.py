import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceframe.operators import aggregate, candidates, checks, cohort, fuse, masks, matching, metrics, ranking, resample, reshape, scoring

SLICE = "sample_id long, patient_id long, seq string, gt_label string, pred_label string, vote_score_infection double, vote_score_tumor double, candidate_slice_area double, candidate_slice_distance double, valid_component_votes double, final_candidate_source string, pred_mask_empty boolean"


def slices(spark, *rows):
    return spark.createDataFrame([(i, 1, s, "tumor", *r) for i, (s, *r) in enumerate(rows)], SLICE)


FULL = (100.0, 0.0, 3.0, "filtered_components", False)


def test_majority_counts_missing_in_confidence(spark):
    df = slices(spark, ("T1", "tumor", 0.0, 1.0, *FULL), ("T1", "no_candidate", 0.0, 0.0, 0.0, 0.0, 0.0, "", True))
    r = aggregate.aggregate_slices(df, ["patient_id"], "majority_vote").first()
    assert (r.pred_label, r.confidence, r.is_correct, r.slice_pred_counts) == ("tumor", 0.5, 1, '{"no_candidate":1,"tumor":1}')


@pytest.mark.parametrize(("tie", "want"), [("uncertain", "uncertain"), ("tumor", "tumor"), ("infection", "infection")])
def test_tie_policy(spark, tie, want):
    df = slices(spark, ("T1", "tumor", 0.0, 1.0, *FULL), ("T1", "infection", 1.0, 0.0, *FULL))
    for s in aggregate.STRATEGIES[:3]:
        assert aggregate.aggregate_slices(df, ["patient_id"], s, tie).first().pred_label == want


def test_no_evidence(spark):
    gone = slices(spark, ("T1", "no_candidate", 0.0, 0.0, 0.0, 0.0, 0.0, "", True))
    assert aggregate.aggregate_slices(gone, ["patient_id"], "quality_weighted_vote").first().pred_label == "no_candidate"
    odd = slices(spark, ("T1", "invalid", 0.0, 0.0, 0.0, 0.0, 0.0, "", True))
    assert aggregate.aggregate_slices(odd, ["patient_id"], "quality_weighted_vote").first().pred_label == "uncertain"
    assert aggregate.aggregate_slices(odd, ["patient_id"], "best_slice_vote").first().pred_label == "uncertain"


def test_quality_factors(spark):
    """Area by the group's largest, distance, votes (missing counts one), source, and half again for a borrowed slice."""
    df = slices(spark, ("T1", "tumor", 0.0, 2.0, 99.0, 1.0, None, "adjacent_slice_fallback", True), ("T2", "infection", 0.0, 0.0, 9.0, 0.0, 9.0, "other", False))
    r = aggregate.aggregate_slices(df, ["patient_id"], "quality_weighted_vote").first()
    assert math.isclose(r.score_tumor, 2.0 * 0.5 * (1 / 3) * 0.8 * 0.5, abs_tol=1e-8)
    assert math.isclose(r.score_infection, math.log1p(9) / math.log1p(99) * 0.7, abs_tol=1e-8)  # a label without scores counts one
    flat = slices(spark, ("T1", "tumor", 0.0, 1.0, 0.0, 0.0, 3.0, "filtered_components", False))
    assert aggregate.aggregate_slices(flat, ["patient_id"], "quality_weighted_vote").first().score_tumor == 1.0


def test_modal_label_prefers_the_first(spark):
    df = spark.createDataFrame([(0, 1, "b"), (1, 1, "a"), (2, 1, "b"), (3, 1, "a"), (4, 2, "")], "sample_id long, patient_id long, gt_label string")
    assert {r.patient_id: r.gt_label for r in aggregate.modal_labels(df, ["patient_id"]).collect()} == {1: "b", 2: ""}


COMP = "sample_id long, component_rank long, pred_label string, weight double, area long, conf double, score double"


def test_fusion_and_picks(spark):
    rows = [(1, 1, "tumor", 0.5, 9, 0.5, 0.5), (1, 2, "infection", 0.5, 10, 0.5, 0.5), (2, 1, "", 1.0, 9, 0.9, 0.9), (3, 1, "", 1.0, 1, 0.9, 0.9), (3, 2, "tumor", 0.2, 1, 0.2, 0.2)]
    df = spark.createDataFrame(rows, COMP)
    assert {r.sample_id: r.pred_label for r in fuse.fuse_components(df, ["sample_id"]).collect()} == {1: "infection", 2: "", 3: "tumor"}
    pick = lambda s: {r.sample_id: (r.selected_rank, r.pred_label) for r in fuse.pick_candidate(df, ["sample_id"], s).collect()}
    assert pick("top1_conf")[3] == (1, "") and pick("first_valid")[3] == (2, "tumor")
    assert pick("majority_vote")[1] == (1, "tumor") and pick("conf_weighted_vote")[1] == (1, "tumor") and pick("majority_vote")[2] == (1, "")


def test_balanced_accuracy_definitions(spark):
    df = spark.createDataFrame([("tumor", "tumor"), ("tumor", "infection")], "gt_label string, pred_label string")
    got = {e: metrics.outcome_metrics(df, empty=e).first().balanced_acc for e in metrics.EMPTY_CLASS}
    assert got["zero"] == 0.0 and math.isnan(got["nan"]) and got["half"] == 0.25 and got["null"] is None


def test_report_counts_undecided_as_missed(spark):
    df = spark.createDataFrame([("infection", "uncertain"), ("infection", "infection"), ("tumor", "tumor")], "gt_label string, pred_label string")
    r = metrics.classification_report(df).first()
    assert r.sensitivity == 0.5 and r.npv_infection == 0.5 and r.no_candidate_or_uncertain == 1


def test_components_are_4_connected(spark):
    px = [("a", 0, y, x, int((y, x) in {(0, 0), (1, 1), (1, 2), (3, 3)})) for y in range(4) for x in range(4)]
    found = masks.components(spark.createDataFrame(px, "case_id string, z long, y long, x long, pred long"))
    assert {(r.y, r.x): r.component for r in found.collect()} == {(0, 0): 1, (1, 1): 2, (1, 2): 2, (3, 3): 3}
    stats = {r.component: r for r in masks.component_stats(found, 4, 4).collect()}
    assert stats[1].touches_border and not stats[2].touches_border and stats[2].area_ratio == 1.0


def test_slice_choice_hides_the_truth(spark):
    px = spark.createDataFrame([("a", z, 0, 0, 0, int(z == 2)) for z in range(3)], "case_id string, z long, y long, x long, pred long, gt long")
    assert candidates.choose_slice(px).first().z == 0
    assert candidates.choose_slice(px, oracle=True).first().z == 2
    with pytest.raises(ValueError, match="unknown"):
        candidates.choose_slice(px, "gt_max_area")


def test_adjacent_prefers_near_then_large(spark):
    a = spark.createDataFrame([("a", 0, 5), ("a", 1, 0), ("a", 2, 9), ("a", 5, 0), ("a", 9, 0)], "case_id string, z long, area long")
    got = {r.z: (r.neighbour, r.distance) for r in candidates.adjacent_slices(a, 3).collect()}
    assert got[1] == (2, 1) and got[5] == (2, 3) and got[9] == (None, None)


def brute_auc(y, p):
    order = np.argsort(-p, kind="stable")
    t = np.r_[0, np.cumsum(y[order]) / y.sum(), 1]
    f = np.r_[0, np.cumsum(1 - y[order]) / (1 - y).sum(), 1]
    return float(((f[1:] - f[:-1]) * (t[1:] + t[:-1]) / 2).sum())


def test_scores_against_numpy(spark):
    rng = np.random.default_rng(3)
    y, p = rng.integers(0, 2, 200), np.round(rng.random(200), 1)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "doc_id long, y long, p double")
    assert math.isclose(scoring.roc_auc(df).first()[0], brute_auc(y, p))
    bins = scoring.calibration_bins(df, bins=7).orderBy("bin").collect()
    groups = np.array_split(np.lexsort((np.arange(200), p)), 7)
    assert [r.n for r in bins] == [len(g) for g in groups]
    assert all(math.isclose(r.mean_predicted, p[g].mean()) and math.isclose(r.observed, y[g].mean()) for r, g in zip(bins, groups))


def test_calibration_fit(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=4000)
    y = (rng.random(4000) < 1 / (1 + np.exp(-(0.3 + 0.7 * x)))).astype(int)
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, 1 / (1 + np.exp(-x)))], "y long, p double")
    r = scoring.calibration_fit(df).first()
    assert abs(r.intercept - 0.3) < 0.1 and abs(r.slope - 0.7) < 0.1
    apart = spark.createDataFrame([(0, 0.4), (1, 0.6)] * 5, "y long, p double")
    assert scoring.calibration_fit(apart).first().intercept is None


@pytest.mark.parametrize(("b", "c"), [(0, 0), (3, 3), (1, 8), (0, 5), (40, 60), (300, 400)])
def test_mcnemar(spark, b, c):
    n, k = b + c, min(b, c)
    want = 1.0 if n == 0 else min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n)
    got = spark.range(1).select(scoring.mcnemar_p(F.lit(b), F.lit(c)), scoring.mcnemar_p(F.lit(c), F.lit(b))).first()
    assert math.isclose(got[0], want, rel_tol=1e-9) and got[0] == got[1]


def test_draws_ignore_partitioning(spark):
    rows = spark.createDataFrame([(i, "infection" if i % 3 else "tumor", "tumor" if i % 2 else "infection", "tumor") for i in range(60)], "patient_id long, gt_label string, pred_selected string, pred_baseline string")
    a = resample.bootstrap_paired(rows.repartition(1), 40).orderBy("metric").collect()
    b = resample.bootstrap_paired(rows.repartition(7), 40).orderBy("metric").collect()
    assert a == b and all(r.low <= r["mean"] <= r.high for r in a)


def test_folds_partition_and_nest(spark):
    s = spark.createDataFrame([(i, "infection" if i % 3 == 0 else "tumor") for i in range(50)], "patient_id long, gt_label string")
    p = cohort.nested_protocol(s, 5, 8, 15)
    assert checks.one_group_per_key(p.where("role = 'outer_test'"), "patient_id", "fold").count() == 0
    assert checks.covers(p.where("role = 'outer_test'"), s, "patient_id").count() == 0
    assert p.where("in_small and not in_large").count() == 0 and p.where("in_large and role <> 'adapt'").count() == 0
    assert {r["count"] for r in p.where("in_small").groupBy("fold").count().collect()} == {8} and {r["count"] for r in p.where("in_large").groupBy("fold").count().collect()} == {15}


def test_quota_remainders(spark):
    n = spark.createDataFrame([("infection", 5), ("tumor", 5)], "gt_label string, n long")
    q = {r.gt_label: r.quota for r in cohort.quotas(n, 7).collect()}
    assert sum(q.values()) == 7 and max(q.values()) == 4


def test_oversample_balances(spark):
    r = spark.createDataFrame([(i, "a" if i < 3 else "b") for i in range(13)], "id long, label string")
    out = cohort.oversample(r, "id", "label")
    assert {x.label: x["count"] for x in out.groupBy("label").count().collect()} == {"a": 10, "b": 10}


def test_checks_raise(spark):
    r = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a")], "k long, g string")
    with pytest.raises(checks.CheckFailed, match="repeat"):
        matching.pair_records(r, r, "k")
    with pytest.raises(checks.CheckFailed):
        checks.require_rows(r.where("k = 9"))
    with pytest.raises(checks.CheckFailed):
        checks.require_columns(r, ["k", "z"])
    assert checks.same_keys(r, r.where("k = 1"), "k").collect()[0].only_in == "left"
    assert checks.reads_truth(["gt_label", "pred_label", "det_iou"]) == ["det_iou", "gt_label"]


def test_quality_reads_no_truth():
    import inspect

    source = inspect.getsource(aggregate.quality_rest) + inspect.getsource(aggregate.vote_scores)
    assert not any(c in source for c in checks.TRUTH_PREFIXES)


def test_wide_and_long(spark):
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b"), (1, 4, "z"), (2, 1, "c")], "sample_id long, component_rank int, label string")
    wide = reshape.components_wide(rows, ["sample_id"], ["label"])
    back = reshape.components_long(wide, ["sample_id"], ["label"], present="label")
    assert sorted(tuple(r) for r in back.collect()) == [(1, 1, "a"), (1, 2, "b"), (2, 1, "c")]


def test_last_wins(spark):
    r = spark.createDataFrame([("a", 0, 1), ("a", 5, 2), ("b", 1, 3)], "k string, pos long, v long")
    assert {x.k: x.v for x in ranking.first_per_key(r, ["k"], [F.desc("pos")]).collect()} == {"a": 2, "b": 3}


def test_components_equal_a_flood_fill():
    import pyarrow as pa

    rng = np.random.default_rng(3)
    rows = [(f"c{s // 3}", s % 3, y, x) for s in range(9) for y in range(24) for x in range(31) if rng.random() < (0.3, 0.55, 0.65)[s % 3]]
    table = pa.table({k: [r[i] for r in rows] for i, k in enumerate(("case_id", "z", "y", "x"))})
    got = {tuple(r.values())[:4]: r["component"] for r in pa.Table.from_batches([masks.numbered_components(table)]).to_pylist()}
    want, number = {}, {}
    for c, z, y, x in rows:
        if (c, z, y, x) in want:
            continue
        number[c, z] = number.get((c, z), 0) + 1
        todo = [(y, x)]
        while todo:
            p = todo.pop()
            if (c, z, *p) in got and (c, z, *p) not in want:
                want[c, z, *p] = number[c, z]
                todo += [(p[0] + 1, p[1]), (p[0] - 1, p[1]), (p[0], p[1] + 1), (p[0], p[1] - 1)]
    assert got == want and len(got) == len(rows)
