"""Candidate regions, slice choice, and borrowing from neighbouring slices."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.boxes import box, expand, iou, union_agg
from . import masks
from .ranking import top_k

SLICE = masks.SLICE
STRATEGIES = ("pred_max_area", "pred_largest_component")
ORACLES = ("gt_max_area", "best_iou")


def component_candidates(stats: DataFrame, k: int = 3, min_area: int = 1, min_ratio: float = 0.0) -> DataFrame:
    """The best regions of each slice: large enough, by score, then area, then place; rank from 1."""
    kept = stats.where((F.col("area") >= min_area) & (F.col("area_ratio") >= min_ratio))
    return top_k(kept, SLICE, [F.desc("score"), F.desc("area"), F.col("component")], k)


def choose_slice(pixels: DataFrame, strategy: str = "pred_max_area", oracle: bool = False) -> DataFrame:
    """case_id and the slice chosen: by predicted area, or by the largest predicted component; 0 if nothing is predicted.

    Only with ``oracle`` may the truth be used, as a strategy or where nothing is predicted.
    """
    if strategy not in STRATEGIES + (ORACLES if oracle else ()):
        raise ValueError(f"unknown strategy {strategy}")
    area = pixels.groupBy(*SLICE).agg(F.count_if(F.col("pred") > 0).alias("p"), F.count_if(F.col("gt") > 0).alias("g"))
    if strategy == "pred_largest_component":
        largest = masks.components(pixels).groupBy(*SLICE, "component").count().groupBy(*SLICE).agg(F.max("count").alias("score"))
        area = area.join(largest, SLICE, "left").withColumn("score", F.coalesce("score", F.lit(0)))
    elif strategy == "best_iou":
        p, g = masks.boxes(pixels, "pred"), masks.boxes(pixels, "gt")
        both = p.select(*SLICE, box("x1", "y1", "x2", "y2").alias("pb")).join(g.select(*SLICE, box("x1", "y1", "x2", "y2").alias("gb")), SLICE)
        area = area.join(both.select(*SLICE, (iou(F.col("pb"), F.col("gb")) + 1).alias("score")), SLICE)
    else:
        area = area.withColumn("score", F.col("g" if strategy == "gt_max_area" else "p"))
    first = lambda c: F.max_by("z", F.when(F.col(c) > 0, F.struct(F.col(c), (-F.col("z")).alias("o"))))
    ways = [first("score"), *([first("g")] if oracle else []), F.lit(0)]
    return area.groupBy("case_id").agg(F.coalesce(*ways).alias("z"))


def slice_box(pixels: DataFrame, strategy: str = "mask_bbox", k: int = 3, min_area: int = 1, width: int | None = None, height: int | None = None, ratio: float = 0.0) -> DataFrame:
    """One box per slice: around the mask, its largest component, or its k largest; expanded by a ratio."""
    if strategy == "mask_bbox":
        b = masks.boxes(pixels.where("pred > 0"))
    else:
        stats = masks.component_stats(masks.components(pixels), 1 << 30, 1 << 30, 0.0).where(F.col("area") >= min_area)
        kept = top_k(stats, SLICE, [F.desc("area"), F.col("component")], 1 if strategy == "largest_component" else k)
        b = kept.groupBy(*SLICE).agg(union_agg(box("x1", "y1", "x2", "y2")).alias("b")).select(*SLICE, "b.*")
    if ratio > 0:
        b = b.select(*SLICE, expand(box("x1", "y1", "x2", "y2"), width, height, ratio).alias("b")).select(*SLICE, "b.*")
    return b


def adjacent_slices(slice_areas: DataFrame, radius: int = 3, strategy: str = "nearest_then_area", keys: tuple[str, ...] = ("case_id",)) -> DataFrame:
    """For each slice the non-empty one to borrow within a radius: z, its neighbour (NULL if none), distance and area.

    A window over the slice numbers looks at no more than 2 * radius neighbours.
    """
    if strategy not in ("nearest_then_area", "max_area_within_radius"):
        raise ValueError(f"unknown strategy {strategy}")
    w = Window.partitionBy(*keys).orderBy("z")
    near = F.collect_list(F.when(F.col("area") > 0, F.struct("z", "area"))).over(w.rangeBetween(-radius, radius))
    distance = lambda n: F.abs(n["z"] - F.col("z"))
    if strategy == "nearest_then_area":
        order = lambda n: F.struct(distance(n).alias("d"), (-n["area"]).alias("a"), n["z"].alias("n"))
    else:
        order = lambda n: F.struct((-n["area"]).alias("a"), distance(n).alias("d"), n["z"].alias("n"))
    best = F.array_min(F.transform(F.filter(F.col("_near"), lambda n: n["z"] != F.col("z")), order))
    out = slice_areas.withColumn("_near", near).withColumn("_b", best)
    return out.select(*keys, "z", "area", F.col("_b.n").alias("neighbour"), F.col("_b.d").alias("distance"), (-F.col("_b.a")).alias("neighbour_area"))


def slice_and_box(pixels: DataFrame, width: int, height: int, slice_strategy: str = "pred_max_area", box_strategy: str = "mask_bbox", ratio: float = 0.0, k: int = 3, min_area: int = 1, oracle: bool = False) -> DataFrame:
    """Per case: z, the predicted box of the chosen slice (expanded by a ratio), the true one, and their overlap. A slice
    without predicted or true pixels has an empty box."""
    chosen = choose_slice(pixels, slice_strategy, oracle)
    here = pixels.join(chosen, ["case_id", "z"], "left_semi")
    named = lambda rows, n: rows.select("case_id", box("x1", "y1", "x2", "y2").alias(n))
    found = named(slice_box(here, box_strategy, k, min_area, width, height, ratio), "pred_box")
    none = box(0, 0, 0, 0)
    out = chosen.join(found, "case_id", "left").join(named(masks.boxes(here, "gt"), "gt_box"), "case_id", "left")
    out = out.select("case_id", F.col("z").cast("bigint").alias("z"), F.coalesce("pred_box", none).alias("pred_box"), F.coalesce("gt_box", none).alias("gt_box"))
    return out.withColumn("iou", iou(F.col("pred_box"), F.col("gt_box")))


def candidate_state(slices: DataFrame) -> DataFrame:
    """Where each slice's candidates come from, and what happened on the way.

    slices(case_id, z, area, n_kept, neighbour, neighbour_kept; n_box and neighbour_box, if there, say whether a region is left
    for the fallback): own filtered components; else, the mask being empty, a neighbour's; else the largest component of the slice or
    the neighbour; else why there is none. filtered_empty: the slice used has regions but none passes the filter;
    used_fallback_component: its largest is taken all the same.
    """
    empty = F.col("area") == 0
    has = F.col("neighbour").isNotNull()
    box_of = lambda c: F.coalesce(F.col(c) > 0, F.lit(False)) if c in slices.columns else F.lit(True)
    kept = F.coalesce(F.when(empty, F.col("neighbour_kept") > 0).otherwise(F.col("n_kept") > 0), F.lit(False))
    boxed = F.when(empty, box_of("neighbour_box")).otherwise(box_of("n_box"))
    source = (
        F.when(~empty & kept, "filtered_components").when(~empty & boxed, "largest_component_fallback").when(~empty, "fallback_empty").when(~has, "pred_mask_empty")
        .when(kept, "adjacent_slice_fallback").when(boxed, "adjacent_slice_largest_component_fallback").otherwise("adjacent_slice_fallback_empty")
    )
    filtered = (~empty | has) & ~kept
    return slices.select(
        "*", source.alias("final_candidate_source"), empty.alias("pred_mask_empty"), filtered.alias("filtered_empty"), (filtered & boxed).alias("used_fallback_component"),
        F.when(empty, F.col("neighbour")).otherwise(F.col("z")).alias("candidate_slice"), F.when(empty & has, F.abs(F.col("neighbour") - F.col("z"))).otherwise(0).alias("candidate_slice_distance"),
    )


def detector_ranks(detections: DataFrame, key: str = "image_path", conf: str = "conf", k: int = 5, tie: str = "box_pos") -> DataFrame:
    return top_k(detections, [key], [F.desc(conf), F.col(tie)], k)
