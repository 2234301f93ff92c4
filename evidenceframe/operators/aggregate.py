"""Evidence from slices to sequences and patients: votes, quality weights, decisions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.coerce import col, flag, safe_div, safe_float
from ..functions.text import label_of_case

CLASSES = ("infection", "tumor")
OUTCOMES = (*CLASSES, "no_candidate", "uncertain")
STRATEGIES = ("majority_vote", "score_weighted_vote", "quality_weighted_vote", "best_slice_vote")
#: Trust in where a slice's candidate came from; other sources 0.7, none 0.5.
SOURCE_FACTORS = {"filtered_components": 1.0, "adjacent_slice_fallback": 0.8}
DIGITS = 9  # sums are rounded before they are compared, as their order varies


def vote_scores(label: Column | str = "pred_label", infection: Column | str = "vote_score_infection", tumor: Column | str = "vote_score_tumor") -> Column:
    """struct(infection, tumor); where neither is positive a class label counts one."""
    a, b, name = safe_float(infection), safe_float(tumor), col(label)
    none = (a <= 0) & (b <= 0)
    one = lambda score, own: F.when(none & (name == own), 1.0).otherwise(score)
    return F.struct(one(a, "infection").alias("infection"), one(b, "tumor").alias("tumor"))


def quality_rest(distance="candidate_slice_distance", votes="valid_component_votes", source="final_candidate_source", empty="pred_mask_empty") -> Column:
    """Slice quality but for its area: distance, votes, source, and half if the predicted mask was empty."""
    factor = F.when(F.coalesce(col(source), F.lit("")) == "", 0.5)
    for name, value in SOURCE_FACTORS.items():
        factor = factor.when(col(source) == name, value)
    factor = factor.otherwise(0.7) * F.when(flag(empty), 0.5).otherwise(1.0)
    by_votes = F.least(F.greatest(safe_float(votes, 1.0), F.lit(1.0)), F.lit(3.0)) / 3.0
    return factor * by_votes / (1.0 + F.abs(safe_float(distance)))


def decide(infection: Column, tumor: Column, no_candidate: Column | None = None, tie: str = "uncertain") -> Column:
    """The class with the higher score; without any score no_candidate (if voted for) or uncertain; ties by policy."""
    none = F.when(no_candidate > 0, "no_candidate").otherwise("uncertain") if no_candidate is not None else F.lit("no_candidate")
    return F.when((infection == 0) & (tumor == 0), none).when(infection > tumor, "infection").when(tumor > infection, "tumor").otherwise(tie if tie in CLASSES else "uncertain")


def decide_close(infection: Column, tumor: Column, tie: str = "uncertain") -> Column:
    """As decide, taking scores within 1e-12 as equal."""
    close = F.abs(infection - tumor) <= 1e-12
    none = (infection <= 0) & (tumor <= 0)
    return F.when(none, "no_candidate").when(close, tie if tie in CLASSES else "uncertain").when(infection > tumor, "infection").otherwise("tumor")


def truth_label(label: Column | str = "gt_label", order: Column | str = "sample_id") -> Column:
    """Aggregate: the only or, with several, the smallest-positioned label. See modal_labels for the mode."""
    return F.min_by(col(label), col(order))


def modal_labels(rows: DataFrame, keys: list[str], label: str = "gt_label", order: str = "sample_id", case_id: str | None = None) -> DataFrame:
    """keys and the most frequent label of a group, of equally frequent ones the one that came first; '' if none has one."""
    name = F.coalesce(F.when(F.col(label) != "", F.col(label)), *([F.when(label_of_case(case_id) != "", label_of_case(case_id))] if case_id else []))
    counts = rows.groupBy(*keys, name.alias("_label")).agg(F.count(F.lit(1)).alias("_n"), F.min(order).alias("_first"))
    best = F.max_by("_label", F.when(F.col("_label").isNotNull(), F.struct("_n", (-F.col("_first")).alias("f"))))
    return counts.groupBy(*keys).agg(F.coalesce(best, F.lit("")).alias(label))


def counts_json(label: Column | str = "pred_label") -> Column:
    """Aggregate: counts of the known labels as JSON, keys in order, those that occur."""
    names = sorted(OUTCOMES)
    entries = F.array(*(F.struct(F.lit(n).alias("k"), F.count_if(col(label) == n).alias("v")) for n in names))
    return F.to_json(F.map_from_entries(F.filter(entries, lambda e: e["v"] > 0)))


def aggregate_slices(slices: DataFrame, keys: list[str], strategy: str, tie: str = "uncertain", order: str = "sample_id") -> DataFrame:
    """One row per group: truth, decision, confidence, scores and slice counts, by one of STRATEGIES.

    The group's largest area only scales the quality, so it is divided out of the sums: one aggregation, no window.
    """
    if strategy not in STRATEGIES:
        raise ValueError(f"unknown strategy {strategy}")
    rows = slices.withColumn("_v", vote_scores()).withColumn("_area", safe_float("candidate_slice_area")).withColumn("_rest", quality_rest())
    pred = F.col("pred_label")
    none = F.count_if(pred == "no_candidate")
    tail = [
        truth_label(order=order).alias("gt_label"), F.count(F.lit(1)).alias("num_slices"), F.count_if(pred.isin(*CLASSES)).alias("num_candidate_slices"), none.alias("num_no_candidate_slices"), counts_json().alias("slice_pred_counts"),
    ]
    if strategy == "best_slice_vote":
        strength = F.greatest(F.col("_v.infection"), F.col("_v.tumor"), F.lit(1.0)) * F.col("_rest")
        # Areas compare within the group alike before and after scaling by its largest, unless that is 0.
        log_best = F.max_by(F.struct("pred_label", "_v", (strength * F.log1p("_area")).alias("s")), F.struct(F.round(strength * F.log1p("_area"), DIGITS), (-F.col(order)).alias("o")))
        flat_best = F.max_by(F.struct("pred_label", "_v", strength.alias("s")), F.struct(F.round(strength, DIGITS), (-F.col(order)).alias("o")))
        g = rows.groupBy(*keys).agg(*tail, F.max("_area").alias("_most"), log_best.alias("_log"), flat_best.alias("_flat"))
        best = lambda f: F.when(F.col("_most") > 0, F.col(f"_log.{f}")).otherwise(F.col(f"_flat.{f}"))
        name = best("pred_label")
        g = g.withColumn("pred_label", F.when(name.isin(*OUTCOMES), name).otherwise("uncertain"))
        g = g.withColumn("confidence", F.when(F.col("_most") > 0, F.col("_log.s") / F.log1p("_most")).otherwise(F.col("_flat.s")))
        g = g.withColumn("score_infection", best("_v.infection")).withColumn("score_tumor", best("_v.tumor"))
    else:
        if strategy == "majority_vote":
            sums = [F.count_if(pred == c).cast("double").alias(f"score_{c}") for c in CLASSES]
        elif strategy == "score_weighted_vote":
            sums = [F.sum(f"_v.{c}").alias(f"score_{c}") for c in CLASSES]
        else:
            log = lambda c: F.sum(F.col(f"_v.{c}") * F.col("_rest") * F.log1p("_area")) / F.log1p(F.max("_area"))
            sums = [F.when(F.max("_area") > 0, log(c)).otherwise(F.sum(F.col(f"_v.{c}") * F.col("_rest"))).alias(f"score_{c}") for c in CLASSES]
        g = rows.groupBy(*keys).agg(*tail, *sums)
        g = g.withColumns({f"score_{c}": F.round(f"score_{c}", DIGITS) for c in CLASSES})
        a, b = F.col("score_infection"), F.col("score_tumor")
        g = g.withColumn("pred_label", decide(a, b, F.col("num_no_candidate_slices"), tie))
        whole = a + b + (F.col("num_no_candidate_slices") if strategy == "majority_vote" else F.lit(0.0))
        g = g.withColumn("confidence", safe_div(F.greatest(a, b), whole))
    return g.select(
        *keys, "gt_label", "pred_label", (F.col("gt_label") == F.col("pred_label")).cast("int").alias("is_correct"), F.round("confidence", DIGITS).alias("confidence"), "num_slices", "num_candidate_slices", "num_no_candidate_slices",
        F.round("score_infection", DIGITS).alias("score_infection"), F.round("score_tumor", DIGITS).alias("score_tumor"), "slice_pred_counts",
    )


def aggregate_levels(slices: DataFrame, strategy: str, tie: str = "uncertain") -> DataFrame:
    """Patient and (patient, sequence) decisions in one table with a ``level`` column."""
    patient = aggregate_slices(slices, ["patient_id"], strategy, tie).withColumn("seq", F.lit(None).cast("string")).withColumn("level", F.lit("patient"))
    return patient.unionByName(aggregate_slices(slices, ["patient_id", "seq"], strategy, tie).withColumn("level", F.lit("sequence")))


def sequence_evidence(slices: DataFrame) -> DataFrame:
    """Per patient and sequence: raw scores weighted by quality (by the patient's largest area) and their shares."""
    rows = slices.withColumn("_v", vote_scores()).withColumn("_area", safe_float("candidate_slice_area")).withColumn("_rest", quality_rest())
    part = lambda c: [F.sum(F.col(f"_v.{c}") * F.col("_rest") * F.log1p("_area")).alias(f"_log_{c}"), F.sum(F.col(f"_v.{c}") * F.col("_rest")).alias(f"_flat_{c}")]
    g = rows.groupBy("patient_id", "seq").agg(
        truth_label().alias("gt_label"), F.max("_area").alias("_most_seq"), F.count(F.lit(1)).alias("num_slices"),
        F.count_if(F.col("pred_label").isin(*CLASSES)).alias("num_candidate_slices"), F.count_if(F.col("pred_label") == "no_candidate").alias("num_no_candidate_slices"), *part("infection"), *part("tumor"),
    )
    from pyspark.sql import Window

    most = F.max("_most_seq").over(Window.partitionBy("patient_id"))
    g = g.withColumn("_most", most)
    raw = lambda c: F.round(F.when(F.col("_most") > 0, F.col(f"_log_{c}") / F.log1p("_most")).otherwise(F.col(f"_flat_{c}")), DIGITS)
    g = g.withColumn("score_infection_raw", raw("infection")).withColumn("score_tumor_raw", raw("tumor"))
    total = F.col("score_infection_raw") + F.col("score_tumor_raw")
    return g.select(
        "patient_id", "seq", "gt_label", "num_slices", "num_candidate_slices", "num_no_candidate_slices", "score_infection_raw", "score_tumor_raw",
        safe_div("score_infection_raw", total).alias("prob_infection"), safe_div("score_tumor_raw", total).alias("prob_tumor"), (total > 0).cast("int").alias("has_class_evidence"),
    )


def sequence_balanced(slices: DataFrame, tie: str = "uncertain") -> DataFrame:
    """Per patient: the mean of its sequences' shares, over those with evidence."""
    e = sequence_evidence(slices)
    valid = F.col("has_class_evidence") == 1
    mean = lambda c: F.coalesce(F.round(F.avg(F.when(valid, F.col(f"prob_{c}"))), DIGITS), F.lit(0.0))
    g = e.groupBy("patient_id").agg(
        F.min("gt_label").alias("gt_label"), F.array_join(F.array_sort(F.collect_set("seq")), ",").alias("seqs"), F.count(F.lit(1)).alias("num_sequences"), F.count_if(valid).alias("num_valid_sequences"),
        F.sum("num_slices").alias("num_slices"), mean("infection").alias("score_infection"), mean("tumor").alias("score_tumor"),
    )
    return g.withColumn("pred_label", decide_close(F.col("score_infection"), F.col("score_tumor"), tie)).withColumn("confidence", F.greatest("score_infection", "score_tumor"))


def sequence_majority(slices: DataFrame, tie: str = "uncertain") -> DataFrame:
    """Per patient: the class that most sequences decide for."""
    e = sequence_evidence(slices).withColumn("seq_label", decide_close(F.col("score_infection_raw"), F.col("score_tumor_raw"), tie))
    g = e.groupBy("patient_id").agg(F.min("gt_label").alias("gt_label"), *(F.count_if(F.col("seq_label") == c).cast("double").alias(f"score_{c}") for c in CLASSES))
    a, b = F.col("score_infection"), F.col("score_tumor")
    return g.withColumn("pred_label", decide_close(a, b, tie)).withColumn("confidence", safe_div(F.greatest(a, b), a + b))


def adapt_detections(rows: DataFrame) -> DataFrame:
    """Detector selections in the shape of slice predictions: inclusive box area, no distance, one vote, own source."""
    side = lambda a, b: F.greatest(safe_float(b) - safe_float(a) + 1, F.lit(0.0))
    found = F.col("pred_label").isin(*CLASSES)
    return rows.withColumns(
        {
            "candidate_slice_area": F.when(found, side("pred_x1", "pred_x2") * side("pred_y1", "pred_y2")).otherwise(0.0),
            "candidate_slice_distance": F.lit(0), "valid_component_votes": found.cast("int"),
            "final_candidate_source": F.when(found, "filtered_components").otherwise("pred_mask_empty"), "pred_mask_empty": ~found,
        }
    )
