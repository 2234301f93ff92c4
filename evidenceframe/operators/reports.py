"""Summaries of record sets and the composed reports of a pipeline's outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import safe_div
from .aggregate import CLASSES


def patient_metadata(records: DataFrame, patient: str = "patient_id", label: str = "gt_label", seq: str = "seq") -> DataFrame:
    """Per patient: its label, how many it has (one, if the records agree), records, and the records of each named sequence.

    Records are counted by patient, label and sequence first, so a patient with many is no hot task.
    """
    cells = records.groupBy(patient, label, seq).agg(F.count(F.lit(1)).alias("n"))
    by_seq = F.map_from_entries(F.array_sort(F.collect_list(F.when(F.coalesce(F.col(seq), F.lit("")) != "", F.struct(F.col(seq), F.col("n"))))))
    per = cells.groupBy(patient, seq).agg(F.sum("n").alias("n"), F.min(label).alias("_low"), F.max(label).alias("_high"), F.collect_set(label).alias("_labels"))
    labels = F.size(F.array_distinct(F.flatten(F.collect_list("_labels"))))
    return per.groupBy(patient).agg(F.min("_low").alias(label), labels.alias("num_labels"), F.sum("n").alias("num_records"), by_seq.alias("seq_counts"))


def set_summary(patients: DataFrame, groups: list[str], label: str = "gt_label", records: str = "num_records") -> DataFrame:
    """Per set of patients: how many, how many of each class, and their records."""
    return patients.groupBy(*groups).agg(
        F.count(F.lit(1)).alias("patients"), *(F.count_if(F.col(label) == c).alias(f"patients_{c}") for c in CLASSES), F.coalesce(F.sum(records), F.lit(0)).alias("records"),
    )


def record_summary(records: DataFrame, label: str = "gt_label", seq: str = "seq", source: str = "source_dataset") -> DataFrame:
    """(level, key, n): records in all, by label, by sequence, by both and by source, from one pass."""
    r = records.select(F.col(label).alias("a"), F.col(seq).alias("b"), F.coalesce(F.col(source).cast("string"), F.lit("unknown")).alias("c"))
    g = r.groupingSets([[], ["a"], ["b"], ["a", "b"], ["c"]], "a", "b", "c").agg(F.count(F.lit(1)).alias("n"), F.grouping_id("a", "b", "c").alias("_g"))
    level = F.when(F.col("_g") == 7, "records").when(F.col("_g") == 3, "label").when(F.col("_g") == 5, "seq").when(F.col("_g") == 1, "label|seq").otherwise("source")
    key = F.when(F.col("_g") == 7, "").when(F.col("_g") == 3, F.col("a")).when(F.col("_g") == 5, F.col("b")).when(F.col("_g") == 1, F.concat_ws("|", "a", "b")).otherwise(F.col("c"))
    return g.select(level.alias("level"), key.alias("key"), "n")


def split_counts(cases: DataFrame, patient: str = "patient_id", label: str = "gt_label", split: str = "split", order: tuple[str, ...] = ("gt_label", "patient_id", "case_id")) -> DataFrame:
    """(measure, key, n): cases and patients of each split, and cases of each label and split. A patient counts where it comes first."""
    first = cases.groupBy(patient).agg(F.min_by(split, F.struct(*order)).alias(split))
    cell = lambda rows, measure, key: rows.groupBy(key.alias("key")).agg(F.count(F.lit(1)).alias("n")).select(F.lit(measure).alias("measure"), "key", "n")
    return cell(cases, "case_counts", F.col(split)).unionByName(cell(first, "patient_counts", F.col(split))).unionByName(cell(cases, "label_split_counts", F.concat_ws("_", label, split)))


def export_counters(slices: DataFrame, split: str = "split", label: str = "gt_label", lesion: str = "has_lesion") -> DataFrame:
    """(counter, n): slices of each split and of each label and split, all of them and those with a lesion."""
    g = slices.groupBy(split, label).agg(F.count(F.lit(1)).alias("all_slices"), F.count_if(F.col(lesion)).alias("lesion_slices"))
    names = F.array(F.col(split), F.concat_ws("_", label, split))
    long = g.select(F.explode(names).alias("name"), "all_slices", "lesion_slices").groupBy("name").agg(F.sum("all_slices").alias("all_slices"), F.sum("lesion_slices").alias("lesion_slices"))
    return long.unpivot(["name"], ["all_slices", "lesion_slices"], "what", "n").select(F.concat_ws("_", "name", "what").alias("counter"), "n")


def conversion_counters(cases: DataFrame, label: str = "label", seq: str = "seq", error: str = "error") -> DataFrame:
    """(counter, n): cases converted, by label and by sequence where these are given, and failures."""
    ok = F.col(error).isNull()
    named = lambda c, p: F.when(ok & (F.coalesce(F.col(c), F.lit("")) != ""), F.concat(F.lit(p), F.col(c)))
    marks = F.array_compact(F.array(F.when(ok, "cases").otherwise("failed"), named(label, "label_"), named(seq, "seq_")))
    return cases.select(F.explode(marks).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))


def _rate(c: Column, over: Column) -> Column:
    return safe_div(F.count_if(c), F.greatest(over, F.lit(1)))


def record_metrics(rows: DataFrame, total: Column | None = None, keys: list[str] | None = None, thresholds: tuple[float, ...] = (0.3, 0.5)) -> DataFrame:
    """The measures of a localise-then-classify run over its records, one row per group.

    rows(matched, gt_label, pred_label, iou, iom, coverage, precision, center_hit, strict_hit, relaxed_hit, pred_mask_empty,
    filtered_empty, used_fallback_component, final_candidate_source): ``_over_matched`` divides by matched records, ``_over_total`` by all
    (``total``, where records are missing from rows). A label that is neither class is invalid in the counts of decisions.
    """
    m, ok = F.col("matched"), F.col("matched") & F.coalesce(F.col("pred_label") == F.col("gt_label"), F.lit(False))
    n, all_ = F.count_if(m), total if total is not None else F.count(F.lit(1))
    mean = lambda c: F.coalesce(F.avg(F.when(m, F.col(c).cast("double"))), F.lit(0.0))
    strict, relaxed = m & F.col("strict_hit"), m & F.col("relaxed_hit")
    near = {f"{t}".replace(".", ""): m & (F.col("iou") >= t) for t in thresholds}
    source = F.col("final_candidate_source")
    adjacent = m & source.isin("adjacent_slice_fallback", "adjacent_slice_largest_component_fallback")
    kinds = {"used_fallback_component": m & F.col("used_fallback_component"), "pred_mask_empty": m & F.col("pred_mask_empty"), "filtered_empty": m & F.col("filtered_empty"), "adjacent_slice_fallback": adjacent}
    return rows.groupBy(*(keys or [])).agg(
        all_.alias("total_records"), n.alias("matched_records"), safe_div(n, F.greatest(all_, F.lit(1))).alias("match_rate"),
        *(_rate(c, w).alias(f"det_recall_iou{t}_{s}") for t, c in near.items() for s, w in (("over_matched", n), ("over_total", all_))),
        *(mean(c).alias(f"mean_{c}_over_matched") for c in ("iou", "iom", "coverage", "precision")), _rate(m & F.col("center_hit"), n).alias("center_hit_rate_over_matched"),
        *(_rate(c, w).alias(f"{k}_localization_recall_{s}") for k, c in (("strict", strict), ("relaxed", relaxed)) for s, w in (("over_matched", n), ("over_total", all_))),
        _rate(ok, n).alias("cls_acc"),
        *(_rate(c & ok, w).alias(f"joint_acc_iou{t}_{s}") for t, c in near.items() for s, w in (("over_matched", n), ("over_total", all_))),
        *(_rate(c & ok, w).alias(f"joint_acc_{k}_{s}") for k, c in (("strict", strict), ("relaxed", relaxed)) for s, w in (("over_matched", n), ("over_total", all_))),
        F.count_if(m & ~F.coalesce(F.col("pred_label").isin(*CLASSES), F.lit(False))).alias("confusion_invalid"),
        *(F.count_if(m & (F.col("gt_label") == a) & (F.col("pred_label") == b)).alias(f"confusion_{a}_{b}") for a in CLASSES for b in CLASSES),
        _rate(m & (F.col("pred_label") == "no_candidate"), all_).alias("rate_no_candidate"),
        *(F.count_if(c).alias(f"num_{k}") for k, c in kinds.items()), *(_rate(c, all_).alias(f"rate_{k}") for k, c in kinds.items()),
        *(F.count_if(m & (source == c)).alias(f"source_{c}") for c in SOURCES),
    )


#: Where a slice's candidates can come from. Fixed values.
SOURCES = (
    "filtered_components", "largest_component_fallback", "fallback_empty", "adjacent_slice_fallback", "adjacent_slice_largest_component_fallback",
    "adjacent_slice_fallback_empty", "pred_mask_empty",
)


def case_metrics(rows: DataFrame, thresholds: tuple[float, ...] = (0.3, 0.5), keys: list[str] | None = None) -> DataFrame:
    """The same over cases: match rate, recall and joint accuracy among those matched."""
    m, ok = F.col("matched"), F.col("matched") & F.coalesce(F.col("pred_label") == F.col("gt_label"), F.lit(False))
    n, all_ = F.count_if(m), F.count(F.lit(1))
    return rows.groupBy(*(keys or [])).agg(
        all_.alias("total_cases"), n.alias("matched_records"), _rate(m, all_).alias("match_rate"), _rate(ok, n).alias("cls_acc"),
        *(_rate(m & (F.col("iou") >= t), n).alias(f"det_recall_iou{t}".replace(".", "")) for t in thresholds), *(_rate(ok & (F.col("iou") >= t), n).alias(f"joint_acc_iou{t}".replace(".", "")) for t in thresholds),
    )


def candidate_pool(candidates: DataFrame, samples: Column, ks: list[int], thresholds: list[float], sample: str = "sample_id", rank: str = "rank") -> DataFrame:
    """Per k: how many samples have a candidate, the best overlaps, and the share of all samples that any of the first k candidates hits, or
    hits with the right label. One pass at the largest k: a sample's best by k, then counts.
    """
    right = F.coalesce(F.col("pred_label") == F.col("gt_label"), F.lit(False))
    top = lambda c, k, ok=F.lit(True): F.max(F.when((F.col(rank) <= k) & ok, c))
    hit = F.col("relaxed_hit").cast("int")
    per = candidates.where(F.col(rank) <= max(ks)).groupBy(sample).agg(*(x for k in ks for x in (
        F.count_if(F.col(rank) <= k).alias(f"n{k}"), top(F.col("iou"), k).alias(f"iou{k}"), top(F.col("iom"), k).alias(f"iom{k}"), top(F.col("iou"), k, right).alias(f"joint{k}"), top(hit, k).alias(f"loc{k}"), top(hit, k, right).alias(f"locjoint{k}"),
    )))
    n = F.greatest(samples, F.lit(1))
    cells = F.array(*(F.struct(
        F.lit(k).alias("top_k"), F.count_if(F.col(f"n{k}") > 0).alias("images_with_candidate"), safe_div(F.count_if(F.col(f"n{k}") > 0), n).alias("candidate_coverage"), F.sum(f"n{k}").alias("num_candidate_predictions"),
        F.avg(f"iou{k}").alias("mean_best_iou"), F.avg(f"iom{k}").alias("mean_best_iom"),
        *(safe_div(F.count_if(F.col(f"iou{k}") >= t), n).alias(f"det_recall_iou{t}".replace(".", "")) for t in thresholds), *(safe_div(F.count_if(F.col(f"joint{k}") >= t), n).alias(f"joint_oracle_iou{t}".replace(".", "")) for t in thresholds),
        safe_div(F.count_if(F.col(f"loc{k}") > 0), n).alias("relaxed_localization_recall"), safe_div(F.count_if(F.col(f"locjoint{k}") > 0), n).alias("relaxed_joint_oracle"),
    ) for k in ks))
    return per.agg(cells.alias("cells")).select(F.inline("cells"))


def selection_metrics(picked: DataFrame, samples: Column, thresholds: list[float], keys: list[str]) -> DataFrame:
    """Per group of picks (k, strategy): accuracy among picks, mean overlaps, and rates of hits and joint hits over all samples."""
    right = F.coalesce(F.col("pred_label") == F.col("gt_label"), F.lit(False))
    n = F.greatest(samples, F.lit(1))
    share = lambda c: safe_div(F.count_if(c), n)
    return picked.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("selected_count"), safe_div(F.count_if(right), F.count(F.lit(1))).alias("cls_acc_on_selected"), *(F.avg(c).alias(f"mean_{c}") for c in ("iou", "iom", "coverage", "precision")),
        F.avg(F.col("center_hit").cast("double")).alias("center_hit_rate"), share(F.col("iou") >= 0.5).alias("strict_localization_recall"), share(F.col("relaxed_hit")).alias("relaxed_localization_recall"),
        share((F.col("iou") >= 0.5) & right).alias("joint_acc_strict"), share(F.col("relaxed_hit") & right).alias("joint_acc_relaxed"),
        *(share(F.col("iou") >= t).alias(f"selected_det_recall_iou{t}".replace(".", "")) for t in thresholds), *(share((F.col("iou") >= t) & right).alias(f"selected_joint_acc_iou{t}".replace(".", "")) for t in thresholds),
        F.avg("selected_rank").alias("mean_selected_rank"),
    )


def confusion_of(rows: DataFrame, keys: list[str], truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """Counts as JSON; a decision that is neither class nor a missing candidate counts as ``invalid``."""
    cell = F.when(F.col(pred).isin(*CLASSES, "no_candidate"), F.concat_ws("->", truth, pred)).otherwise("invalid")
    n = rows.groupBy(*keys, cell.alias("k")).agg(F.count(F.lit(1)).alias("v"))
    return n.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("k", "v"))))).alias("confusion"))


def fold_report(selected: DataFrame, baseline: DataFrame, selection: DataFrame, expected: DataFrame, fold: str = "fold", patient: str = "patient_id") -> dict[str, DataFrame]:
    """Out-of-fold predictions put together: ``oof`` (both models' rows), ``folds`` (a row per fold) and ``violations``.

    Violations are rows (problem, fold, patient): patients that a fold's predictions lack or hold beyond those expected, and
    patients that several folds test.
    """
    from .metrics import outcome_metrics

    oof = selected.withColumn("model", F.lit("nested_selected")).unionByName(baseline.withColumn("model", F.lit("internal_only")))
    models = F.explode(F.array(F.lit("nested_selected"), F.lit("internal_only")))
    want = expected.select(fold, patient).distinct().select(models.alias("model"), fold, patient, F.lit(True).alias("_want"))
    held = oof.select("model", fold, patient).distinct()
    met = want.join(held.withColumn("_have", F.lit(True)), ["model", fold, patient], "full_outer")
    lost = met.where("_want is null or _have is null").select(F.concat_ws(" ", "model", F.when(F.col("_have").isNull(), "lacks").otherwise("adds")).alias("problem"), fold, patient)
    twice = held.groupBy("model", patient).agg(F.count(F.lit(1)).alias("_n"), F.max(fold).alias(fold)).where("_n > 1").select(F.concat(F.col("model"), F.lit(" repeats")).alias("problem"), fold, patient)
    per = outcome_metrics(oof, ["model", fold]).select("model", fold, "total", "acc", "balanced_acc")
    side = lambda m, p: per.where(F.col("model") == m).select(fold, F.col("total").alias("outer_patients"), F.col("acc").alias(f"{p}_outer_accuracy"), F.col("balanced_acc").alias(f"{p}_outer_balanced_accuracy"))
    classes = selected.groupBy(fold).agg(*(F.count_if(F.col("gt_label") == c).alias(f"outer_{c}") for c in CLASSES))
    folds = selection.join(side("nested_selected", "selected"), fold).join(side("internal_only", "baseline").drop("outer_patients"), fold).join(classes, fold)
    return {"oof": oof, "folds": folds, "violations": lost.unionByName(twice)}


def subgroup_report(predictions: DataFrame, definitions: DataFrame, reference: str, comparators: list[str], patient: str = "patient_id") -> dict[str, DataFrame]:
    """Every definition's two subgroups by every strategy, from one pass over the predictions.

    predictions(patient, gt_label, strategy, pred_label); definitions(definition, patient, positive, where null is left out). Gives
    ``metrics`` (definition, positive, strategy, ...), ``deltas`` (definition, comparison, accuracy of the positive and negative subgroup and
    their difference), ``discordance`` (with the exact p) and ``status`` (completed, or skipped if a subgroup is empty).
    """
    from .metrics import outcome_metrics
    from .scoring import mcnemar_p

    inside = definitions.where("positive is not null")
    n = definitions.groupBy("definition").agg(F.count("positive").alias("num_included"), F.count_if("positive").alias("num_positive"), F.count_if(~F.col("positive")).alias("num_negative"))
    status = n.withColumn("status", F.when((F.col("num_positive") > 0) & (F.col("num_negative") > 0), "completed").otherwise("skipped"))
    whole = inside.join(status.where("status = 'completed'").select("definition"), "definition", "left_semi")
    rows = whole.join(predictions, patient)
    metrics = outcome_metrics(rows, ["definition", "positive", "strategy"])
    acc = metrics.select("definition", "positive", "strategy", "acc", "balanced_acc")
    ref = acc.where(F.col("strategy") == reference).select("definition", "positive", F.col("acc").alias("_a"), F.col("balanced_acc").alias("_b"))
    gap = acc.where(F.col("strategy").isin(*comparators)).join(ref, ["definition", "positive"]).select("definition", "positive", F.concat(F.lit(f"{reference}_minus_"), F.col("strategy")).alias("comparison"), (F.col("_a") - F.col("acc")).alias("accuracy"), (F.col("_b") - F.col("balanced_acc")).alias("balanced_accuracy"))
    of = lambda c, p: F.max(F.when(F.col("positive") == p, F.col(c)))
    deltas = gap.groupBy("definition", "comparison").agg(*(x for c in ("accuracy", "balanced_accuracy") for x in (of(c, True).alias(f"{c}_positive"), of(c, False).alias(f"{c}_negative"), (of(c, True) - of(c, False)).alias(f"{c}_interaction"))))
    pairs = [(reference, c) for c in comparators] + [(a, b) for i, a in enumerate(comparators) for b in comparators[i + 1 :]]
    names = [reference, *comparators]
    wide = rows.groupBy("definition", "positive", patient).agg(F.max("gt_label").alias("gt_label"), *(F.max(F.when(F.col("strategy") == s, F.col("pred_label"))).alias(f"_{s}") for s in names))
    both = F.array(*(F.struct(F.lit(a).alias("reference"), F.lit(b).alias("comparator"), F.col(f"_{a}").alias("a"), F.col(f"_{b}").alias("b")) for a, b in pairs))
    long = wide.select("definition", "positive", "gt_label", F.inline(both))
    x, y = F.coalesce(F.col("a") == F.col("gt_label"), F.lit(False)), F.coalesce(F.col("b") == F.col("gt_label"), F.lit(False))
    d = long.groupBy("definition", "positive", "reference", "comparator").agg(
        F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("different_prediction"), F.count_if(x & y).alias("both_correct"), F.count_if(~x & ~y).alias("both_wrong"),
        F.count_if(x & ~y).alias("reference_only_correct"), F.count_if(~x & y).alias("comparator_only_correct"),
    )
    d = d.withColumn("exact_mcnemar_p", mcnemar_p(F.col("reference_only_correct"), F.col("comparator_only_correct")))
    return {"metrics": metrics, "deltas": deltas, "discordance": d, "status": status}
