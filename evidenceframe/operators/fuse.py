"""Candidate regions to a slice's decision: weighted fusion, single picks, ablations.

Candidates come as rows (one per region) or as a slice's array of structs (rank, pred_label, score, weight, area).
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .aggregate import CLASSES, DIGITS


def component_weight(score: Column, area_ratio: Column) -> Column:
    """Weight of a region: its score (0 at least) by its share of the largest area (0.05 at least)."""
    return F.greatest(score, F.lit(0.0)) * F.greatest(area_ratio, F.lit(0.05))


def fuse_components(rows: DataFrame, keys: list[str], label: str = "pred_label", weight: str = "weight", area: str = "area", rank: str = "component_rank") -> DataFrame:
    """Per slice: sums of weights by class and the heavier class; on a tie the label of the heaviest (largest, first) region; '' without a valid one."""
    valid = F.col(label).isin(*CLASSES)
    total = lambda c: F.coalesce(F.round(F.sum(F.when(F.col(label) == c, F.col(weight))), DIGITS), F.lit(0.0)).alias(f"vote_score_{c}")
    best = F.max_by(label, F.when(valid, F.struct(F.round(weight, DIGITS).alias("w"), F.col(area).alias("a"), (-F.col(rank)).alias("r"))))
    g = rows.groupBy(*keys).agg(total("infection"), total("tumor"), F.count_if(valid).alias("valid_component_votes"), best.alias("_best"))
    a, b = F.col("vote_score_infection"), F.col("vote_score_tumor")
    name = F.when(F.col("valid_component_votes") == 0, "").when(a == b, F.col("_best")).when(a > b, "infection").otherwise("tumor")
    return g.select(*keys, name.alias("pred_label"), "vote_score_infection", "vote_score_tumor", "valid_component_votes")


def pick_candidate(rows: DataFrame, keys: list[str], strategy: str, label: str = "pred_label", conf: str = "conf", rank: str = "component_rank") -> DataFrame:
    """One candidate per group: top1_conf, first_valid, majority_vote or conf_weighted_vote, with the class scores.

    Majority ties go to the class of the earliest valid candidate; within a class the most confident, then first.
    """
    g, chosen = _candidates_of(rows, keys, label, conf, rank, [])
    pick, scores = chosen(strategy)
    g = g.withColumn("_pick", pick)
    return g.select(*keys, F.col("_pick.rank").alias("selected_rank"), F.col("_pick.label").alias("pred_label"), F.col("_pick.conf").alias("selected_conf"), scores[0].alias("vote_score_infection"), scores[1].alias("vote_score_tumor"))


def pick_candidates(rows: DataFrame, keys: list[str], strategies: tuple[str, ...], kept: list[str], label: str = "pred_label", conf: str = "conf", rank: str = "component_rank") -> DataFrame:
    """What each strategy picks (``pick_candidate``), from one aggregation: keys, strategy, selected_rank, pred_label, selected_conf and the picked rows' ``kept`` columns."""
    g, chosen = _candidates_of(rows, keys, label, conf, rank, kept)
    g = g.select(*keys, *(chosen(s)[0].alias(f"_{s}") for s in strategies))
    picks = F.array(*(F.struct(F.lit(s).alias("strategy"), F.col(f"_{s}").alias("_pick")) for s in strategies))
    return g.select(*keys, F.inline(picks)).select(*keys, "strategy", F.col("_pick.rank").alias("selected_rank"), F.col("_pick.label").alias("pred_label"), F.col("_pick.conf").alias("selected_conf"), *(F.col(f"_pick.{c}") for c in kept))


def _candidates_of(rows: DataFrame, keys: list[str], label: str, conf: str, rank: str, kept: list[str]) -> tuple[DataFrame, Callable[[str], tuple[Column, tuple[Column, Column]]]]:
    """What the strategies choose among, per group, and a strategy's choice and class scores there."""
    valid = F.col(label).isin(*CLASSES)
    item = F.struct(F.col(rank).alias("rank"), F.col(label).alias("label"), F.col(conf).alias("conf"), *kept)
    first = F.min_by(item, F.col(rank)).alias("_first")
    first_valid = F.min_by(item, F.when(valid, F.col(rank))).alias("_first_valid")
    strongest = lambda when: F.max_by(item, F.when(when, F.struct(F.col(conf).alias("c"), (-F.col(rank)).alias("r"))))
    stats = [first, first_valid, strongest(valid).alias("_any")]
    for c in CLASSES:
        own = F.col(label) == c
        stats += [F.count_if(own).cast("double").alias(f"_n_{c}"), F.coalesce(F.round(F.sum(F.when(own, F.col(conf))), DIGITS), F.lit(0.0)).alias(f"_s_{c}"), strongest(own).alias(f"_best_{c}"), F.min(F.when(own, F.col(rank))).alias(f"_rank_{c}")]
    g = rows.groupBy(*keys).agg(*stats)
    none = F.lit(0.0)
    n_i, n_t, s_i, s_t = (F.col(x) for x in ("_n_infection", "_n_tumor", "_s_infection", "_s_tumor"))

    def chosen(strategy: str) -> tuple[Column, tuple[Column, Column]]:
        if strategy == "top1_conf":
            pick, scores = F.col("_first"), (none, none)
        elif strategy == "first_valid":
            pick, scores = F.coalesce("_first_valid", "_first"), (none, none)
        elif strategy == "majority_vote":
            lead = (n_i > n_t) | ((n_i == n_t) & (F.col("_rank_infection") < F.col("_rank_tumor")))
            pick, scores = F.when(n_i + n_t == 0, F.col("_first")).when(lead, F.col("_best_infection")).otherwise(F.col("_best_tumor")), (n_i, n_t)
        elif strategy == "conf_weighted_vote":
            pick = F.when(n_i + n_t == 0, F.col("_first")).when((n_i > 0) & (n_t > 0) & (s_i == s_t), F.col("_any")).when((n_t == 0) | ((n_i > 0) & (s_i > s_t)), F.col("_best_infection")).otherwise(F.col("_best_tumor"))
            scores = (s_i, s_t)
        else:
            raise ValueError(f"unknown strategy {strategy}")
        return pick, scores

    return g, chosen


PICKS = ("top1_conf", "first_valid", "majority_vote", "conf_weighted_vote")


def nest_components(rows: DataFrame, keys: list[str], top: int = 3) -> DataFrame:
    """The first ``top`` candidates of each slice as an array by rank; no group grows beyond ``top``."""
    item = F.struct(F.col("component_rank").alias("rank"), "pred_label", "score", "weight", "area")
    return rows.where(F.col("component_rank") <= top).groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("components"))


def _valid(components: Column) -> Column:
    return F.filter(components, lambda c: c["pred_label"].isin(*CLASSES))


def _total(items: Column, label: str, field: str | None) -> Column:
    own = F.filter(items, lambda c: c["pred_label"] == label)
    return F.size(own).cast("double") if field is None else F.round(F.aggregate(own, F.lit(0.0), lambda s, c: s + c[field].cast("double")), DIGITS)


def _outcome(rows: DataFrame, label: Column, votes: Column, infection: Column, tumor: Column, decided: Column) -> DataFrame:
    """Slices that had no candidate stay as they are; those left without a label become no_candidate."""
    kept = F.col("pred_label") == "no_candidate"
    lost = ~kept & ~decided
    put = lambda new, old: F.when(kept, F.col(old)).when(lost, F.lit(0.0)).otherwise(new)
    return rows.withColumns(
        {
            "valid_component_votes": F.when(kept, F.col("valid_component_votes")).when(lost, F.lit(0)).otherwise(votes.cast("long")),
            "vote_score_infection": put(infection, "vote_score_infection"), "vote_score_tumor": put(tumor, "vote_score_tumor"),
            "pred_label": F.when(kept | lost, "no_candidate").otherwise(label),
        }
    )


def _higher(infection: Column, tumor: Column) -> Column:
    return F.when(infection > tumor, "infection").when(tumor > infection, "tumor").otherwise("no_candidate")


def without_adjacent(rows: DataFrame) -> DataFrame:
    gone = F.coalesce(F.col("final_candidate_source") == "adjacent_slice_fallback", F.lit(False))
    zero = lambda c, v: F.when(gone, F.lit(v)).otherwise(F.col(c))
    return rows.withColumns({"pred_label": zero("pred_label", "no_candidate"), "vote_score_infection": zero("vote_score_infection", 0.0), "vote_score_tumor": zero("vote_score_tumor", 0.0), "valid_component_votes": zero("valid_component_votes", 0)})


def _single(rows: DataFrame, chosen: Column) -> DataFrame:
    ok = chosen["pred_label"].isin(*CLASSES)
    score = lambda c: F.when(chosen["pred_label"] == c, chosen["score"]).otherwise(0.0)
    return _outcome(rows, chosen["pred_label"], F.lit(1), score("infection"), score("tumor"), F.coalesce(ok, F.lit(False)))


def first_component(rows: DataFrame) -> DataFrame:
    return _single(rows, F.try_element_at("components", F.lit(1)))


def first_valid_component(rows: DataFrame) -> DataFrame:
    return _single(rows, F.try_element_at(_valid(F.col("components")), F.lit(1)))


def component_majority(rows: DataFrame) -> DataFrame:
    items = _valid(F.col("components"))
    n_i, n_t = _total(items, "infection", None), _total(items, "tumor", None)
    s_i, s_t = _total(items, "infection", "score"), _total(items, "tumor", "score")
    label = F.when(n_i > n_t, "infection").when(n_t > n_i, "tumor").otherwise(_higher(s_i, s_t))
    return _outcome(rows, label, F.size(items), s_i, s_t, F.coalesce(F.size(items) > 0, F.lit(False)))


def _scored(field: str) -> Callable[[DataFrame], DataFrame]:
    def run(rows: DataFrame) -> DataFrame:
        items = _valid(F.col("components"))
        a, b = _total(items, "infection", field), _total(items, "tumor", field)
        return _outcome(rows, _higher(a, b), F.size(items), a, b, F.coalesce(F.size(items) > 0, F.lit(False)))

    return run


#: Name -> how slices with ``components`` would have been decided.
ABLATIONS: dict[str, Callable[[DataFrame], DataFrame]] = {
    "current": lambda rows: rows,
    "no_adjacent": without_adjacent,
    "top1": first_component,
    "first_valid": first_valid_component,
    "majority": component_majority,
    "unweighted": _scored("score"),
    "weighted": _scored("weight"),
}
