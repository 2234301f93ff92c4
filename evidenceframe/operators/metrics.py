"""Counts, accuracies and localisation rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import safe_div
from .aggregate import CLASSES, DIGITS

EMPTY_CLASS = ("zero", "nan", "half", "null")


def confusion(rows: DataFrame, keys: list[str] | None = None, truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    return rows.groupBy(*(keys or []), truth, pred).agg(F.count(F.lit(1)).alias("n"))


def confusion_json(rows: DataFrame, keys: list[str], truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """keys and the counts as JSON, ``truth->pred`` in order."""
    n = confusion(rows, keys, truth, pred).select(*keys, F.struct(F.concat_ws("->", truth, pred).alias("k"), F.col("n").alias("v")).alias("e"))
    return n.groupBy(*keys).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list("e")))).alias("confusion"))


def histogram(rows: DataFrame, *keys: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def _hit(truth: str, pred: str) -> Column:
    return F.coalesce(F.col(truth) == F.col(pred), F.lit(False))


def balanced_accuracy(a: Column, n_a: Column, b: Column, n_b: Column, empty: str = "zero") -> Column:
    """Mean of two classes' accuracies; ``empty`` says what a class without rows gives: 0 for the whole (zero), NaN, half of the other, or NULL."""
    both = (n_a > 0) & (n_b > 0)
    mean = (safe_div(a, n_a) + safe_div(b, n_b)) / 2.0
    return {"zero": F.when(both, mean).otherwise(0.0), "nan": F.when(both, mean).otherwise(float("nan")), "half": mean, "null": F.when(both, mean)}[empty]


def outcome_metrics(rows: DataFrame, keys: list[str] | None = None, truth: str = "gt_label", pred: str = "pred_label", empty: str = "zero") -> DataFrame:
    """Accuracy, balanced accuracy, accuracy among candidates, and rates of missing decisions."""
    hit, cand = _hit(truth, pred), F.col(pred).isin(*CLASSES)
    g = rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(hit).alias("correct"), F.count_if(cand).alias("num_candidate_predictions"), F.count_if(cand & hit).alias("_ch"),
        F.count_if(F.col(pred) == "no_candidate").alias("num_no_candidate"), F.count_if(F.col(pred) == "uncertain").alias("num_uncertain"),
        *(F.count_if(F.col(truth) == c).alias(f"_n_{c}") for c in CLASSES), *(F.count_if((F.col(truth) == c) & hit).alias(f"_c_{c}") for c in CLASSES),
    )
    return g.select(
        *(keys or []), "total", "correct", safe_div("correct", "total").alias("acc"), balanced_accuracy(F.col("_c_infection"), F.col("_n_infection"), F.col("_c_tumor"), F.col("_n_tumor"), empty).alias("balanced_acc"),
        safe_div("_ch", "num_candidate_predictions").alias("candidate_acc"), "num_candidate_predictions", "num_no_candidate", "num_uncertain",
        safe_div("num_no_candidate", "total").alias("no_candidate_rate"), safe_div("num_uncertain", "total").alias("uncertain_rate"),
    )


def metrics_by_level(rows: DataFrame, first: str = "gt_label", second: str = "seq", truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """Counts and accuracy by label, by sequence and by both, in one pass; NULL marks a level not grouped by."""
    rows = rows.select(F.col(first).alias("_a"), F.col(second).alias("_b"), _hit(truth, pred).cast("int").alias("_hit"))
    g = rows.groupingSets([["_a"], ["_b"], ["_a", "_b"], []], "_a", "_b").agg(F.count(F.lit(1)).alias("total"), F.sum("_hit").alias("correct"))
    return g.select(F.col("_a").alias("label"), F.col("_b").alias("seq"), "total", F.coalesce("correct", F.lit(0)).alias("correct"), safe_div("correct", "total").alias("acc"))


def classification_report(rows: DataFrame, keys: list[str] | None = None, truth: str = "gt_label", pred: str = "pred_label") -> DataFrame:
    """Sensitivity, specificity, predictive values and F1; undecided infections count as missed. A class without rows gives NaN."""
    t, p = F.col(truth), F.col(pred)
    g = rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("total"), F.count_if(_hit(truth, pred)).alias("correct"), F.count_if(t == "infection").alias("_ni"), F.count_if(t == "tumor").alias("_nt"),
        F.count_if((t == "infection") & (p == "infection")).alias("_tp"), F.count_if((t == "tumor") & (p == "infection")).alias("_fp"), F.count_if((t == "tumor") & (p == "tumor")).alias("_tn"),
        F.count_if(~p.isin(*CLASSES)).alias("no_candidate_or_uncertain"),
    )
    nan = float("nan")
    share = lambda a, n: F.when(F.col(n) > 0, F.col(a) / F.col(n)).otherwise(nan)
    g = g.withColumn("_fn", F.col("_ni") - F.col("_tp")).withColumn("sensitivity", share("_tp", "_ni")).withColumn("specificity", share("_tn", "_nt"))
    g = g.withColumn("ppv_infection", safe_div("_tp", F.col("_tp") + F.col("_fp"))).withColumn("npv_infection", safe_div("_tn", F.col("_tn") + F.col("_fn")))
    sens = safe_div("_tp", F.col("_tp") + F.col("_fn"))
    f1 = lambda a, b: F.when(a + b == 0, 0.0).otherwise(2 * a * b / (a + b))
    g = g.withColumn("f1_infection", f1(F.col("ppv_infection"), sens)).withColumn("_f1t", f1(F.col("npv_infection"), F.col("specificity")))
    return g.select(
        *(keys or []), "total", "correct", safe_div("correct", "total").alias("accuracy"), ((F.col("sensitivity") + F.col("specificity")) / 2).alias("balanced_accuracy"), "sensitivity", "specificity",
        "ppv_infection", "npv_infection", "f1_infection", ((F.col("f1_infection") + F.col("_f1t")) / 2).alias("macro_f1"), "no_candidate_or_uncertain",
    )


def recall_at(rows: DataFrame, thresholds: list[float], score: str, keys: list[str] | None = None, hit: Column | None = None) -> DataFrame:
    """One row per group and threshold: rows at or above it (and satisfying ``hit``), by all rows."""
    ok = hit if hit is not None else F.lit(True)
    cells = [F.struct(F.lit(float(t)).alias("threshold"), F.count_if((F.col(score) >= t) & ok).alias("hits"), F.count(F.lit(1)).alias("total")) for t in thresholds]
    g = rows.groupBy(*(keys or [])).agg(F.array(*cells).alias("cells")).select(*(keys or []), F.inline("cells"))
    return g.withColumn("recall", safe_div("hits", "total"))


def topk_recall(candidates: DataFrame, sample: str, rank: str, score: str, ks: list[int], thresholds: list[float]) -> DataFrame:
    """Recall of the best of the first k candidates, for every k and threshold: one pass at the largest k."""
    best = [F.max(F.when(F.col(rank) <= k, F.col(score))).alias(f"_b{k}") for k in ks]
    per = candidates.where(F.col(rank) <= max(ks)).groupBy(sample).agg(*best)
    cells = [F.struct(F.lit(k).alias("top_k"), F.lit(float(t)).alias("threshold"), F.count_if(F.col(f"_b{k}") >= t).alias("hits"), F.count(F.lit(1)).alias("total")) for k in ks for t in thresholds]
    return per.agg(F.array(*cells).alias("cells")).select(F.inline("cells")).withColumn("recall", safe_div("hits", "total"))


def any_hit(candidates: DataFrame, sample: str, hits: dict[str, Column]) -> DataFrame:
    """Per sample: whether any candidate satisfies each condition."""
    return candidates.groupBy(sample).agg(*(F.coalesce(F.max(c.cast("int")), F.lit(0)).alias(n) for n, c in hits.items()))


def candidate_burden(slices: DataFrame) -> DataFrame:
    """Per patient: slices with and without candidates, areas, votes and sequences."""
    cand = F.col("pred_label").isin(*CLASSES)
    area = F.col("candidate_slice_area").cast("double")
    return slices.groupBy("patient_id").agg(
        F.max("gt_label").alias("gt_label"), F.count_distinct("gt_label").alias("num_labels"), F.count(F.lit(1)).alias("num_slices"), F.count_if(cand).alias("num_candidate_slices"),
        F.count_if(F.col("pred_label") == "no_candidate").alias("num_no_candidate_slices"), F.count_if(F.col("valid_component_votes") >= 2).alias("num_multi_component_slices"),
        F.max("valid_component_votes").alias("max_component_votes"), F.coalesce(F.max(F.when(cand, area)), F.lit(0.0)).alias("max_candidate_area"), F.coalesce(F.sum(F.when(cand, area)), F.lit(0.0)).alias("sum_candidate_area"),
        F.count_if(F.col("final_candidate_source") == "adjacent_slice_fallback").alias("num_adjacent"), F.array_join(F.array_sort(F.collect_set("seq")), ",").alias("seqs"),
    )


def telemetry_summary(samples: DataFrame, baseline: float = 0.0) -> DataFrame:
    """Peak and mean of memory, load and power, and the peak above a baseline; NULL without samples."""
    return samples.agg(
        F.count(F.lit(1)).alias("samples"), F.max("mem_mib").alias("peak_mem"), (F.max("mem_mib") - F.lit(float(baseline))).alias("peak_above_baseline"), F.round(F.avg("mem_mib"), DIGITS).alias("mean_mem"),
        F.max("util_pct").alias("peak_util"), F.round(F.avg("util_pct"), DIGITS).alias("mean_util"), F.max("power_w").alias("peak_power"), F.round(F.avg("power_w"), DIGITS).alias("mean_power"),
    )


def throughput(slices: DataFrame, seconds: float, patient: str = "patient_id") -> DataFrame:
    g = slices.agg(F.count(F.lit(1)).alias("slices"), F.count_distinct(patient).alias("patients"))
    s = F.lit(float(seconds))
    return g.select("slices", "patients", F.try_divide(F.col("slices").cast("double"), s).alias("slices_per_second"), F.try_divide(s, F.col("slices").cast("double")).alias("seconds_per_slice"), F.try_divide(s, F.col("patients").cast("double")).alias("seconds_per_patient"))


def means_of(rows: DataFrame, groups: list[str], conditions: dict[str, Column], count: str = "n") -> DataFrame:
    """Per group: rows, and for each condition the share of rows that meet it; rows for which it is null don't count."""
    share = {name: F.round(F.avg(c.cast("int")), 9).alias(name) for name, c in conditions.items()}
    return rows.groupBy(*groups).agg(F.count(F.lit(1)).alias(count), *share.values())
