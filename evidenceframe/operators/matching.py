"""Filters and joins of records: pairs, tiers of preference, best overlap, alternative keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.boxes import area, clamp, empty_inside, intersection
from ..functions.coerce import safe_div
from .checks import raise_if_any, same_keys, unique_key
from .ranking import first_per_key


def only_strategy(rows: DataFrame, strategy: str, column: str = "strategy", required: bool = False) -> DataFrame:
    """Rows of a strategy; with ``required`` none is an error once the rows are computed, and no job runs before."""
    found = rows.where(F.col(column) == strategy)
    if not required:
        return found
    there = found.agg(F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit(f"no rows of strategy {strategy}"))).otherwise(F.lit(True)).alias("_there"))
    return there.join(found, F.col("_there"), "left").drop("_there")


def members(rows: DataFrame, ids: DataFrame, key: str) -> DataFrame:
    return rows.join(ids.select(key).distinct(), key, "left_semi")


def missing(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    return rows.join(others.select(key).distinct(), key, "left_anti")


def split_valid(rows: DataFrame, reasons: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that no reason speaks against, and the others with the first reason that does."""
    why = F.coalesce(*(F.when(F.coalesce(c, F.lit(True)), n) for n, c in reasons.items()))
    named = rows.withColumn("reason", why)
    return named.where("reason is null").drop("reason"), named.where("reason is not null")


#: Files a detector reads, by suffix. Fixed values.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".tif", ".tiff")


def detector_records(records: DataFrame, available: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """records(image_path, box, width, height) a detector can use, their boxes clamped, and the others with a reason.

    available(image_path), where given, says which images are there.
    """
    rows, b = records, F.col("box")
    if available is not None:
        rows = left_with_missing(rows, available.select("image_path").distinct(), "image_path", "_there")
    suffix = F.lower(F.regexp_extract("image_path", r"(\.[^./]+)$", 1))
    reasons = {"unsupported image extension": ~suffix.isin(*IMAGE_SUFFIXES), "empty bbox": empty_inside(b, "width", "height")}
    lost = {} if available is None else {"image not found": ~F.col("_there")}
    good, bad = split_valid(rows, {"missing image path or bbox": F.col("image_path").isNull() | b.isNull(), **lost, **reasons})
    return good.withColumn("box", clamp(b, "width", "height")).drop("_there"), bad.drop("_there")


def detections_of_records(found: DataFrame, records: DataFrame, key: str = "image_path") -> DataFrame:
    """Detector candidates with the columns of their records; those of no record go."""
    return found.join(records, key)


def split_membership(rows: DataFrame, train: DataFrame, val: DataFrame, keys: list[str], missing_policy: str = "skip") -> DataFrame:
    """rows with split: val if listed there (even if in train too), else train, else the policy (skip, train or val)."""
    mark = lambda t, n: t.select(*keys).distinct().withColumn(n, F.lit(True))
    out = rows.join(mark(train, "_t"), keys, "left").join(mark(val, "_v"), keys, "left")
    out = out.withColumn("split", F.when(F.col("_v"), "val").when(F.col("_t"), "train").otherwise(None if missing_policy == "skip" else missing_policy)).drop("_t", "_v")
    return out.where("split is not null") if missing_policy == "skip" else out


def pair_records(a: DataFrame, b: DataFrame, key: str, check: bool = True) -> DataFrame:
    """One-to-one join; with ``check`` both sides must hold the same keys, each once."""
    if check:
        raise_if_any(unique_key(a, [key]), "keys repeat on the left")
        raise_if_any(unique_key(b, [key]), "keys repeat on the right")
        raise_if_any(same_keys(a, b, key), "keys differ")
    return a.join(b, key)


def match_case(records: DataFrame, cases: DataFrame, key: str = "sample_id") -> DataFrame:
    """records(key, patient_id, seq, case_id?, image_name?) to cases(patient_id, seq, case_id, pos): the named case if it exists, else the
    only one, else the one whose id is in the image's name, else the first; method says which, missing_patient_seq without any.
    """
    c = cases.groupBy("patient_id", "seq").agg(F.array_sort(F.collect_list(F.struct("pos", F.col("case_id").alias("id")))).alias("_cases"))
    r = records.join(c, ["patient_id", "seq"], "left")
    ids = F.transform("_cases", lambda x: x["id"])
    named = F.filter(ids, lambda x: F.col("image_name").contains(x))
    explicit = F.array_contains(ids, F.col("case_id"))
    method = F.when(F.col("_cases").isNull(), "missing_patient_seq").when(explicit, "explicit_case_id").when(F.size("_cases") == 1, "patient_seq_single").when(F.size(named) > 0, "name_match").otherwise("patient_seq_first")
    chosen = F.when(F.col("_cases").isNull(), None).when(explicit, F.col("case_id")).when(F.size("_cases") == 1, F.element_at(ids, 1)).when(F.size(named) > 0, F.element_at(named, 1)).otherwise(F.element_at(ids, 1))
    return r.select(key, "patient_id", "seq", chosen.alias("matched_case"), method.alias("match_method"))


def _cells(box: Column, side: int) -> Column:
    """Squares of a grid that a box covers; none for one that is empty or null."""
    span = lambda a, b: F.when(box[b] >= box[a], F.sequence(F.floor(box[a] / side), F.floor(box[b] / side)))
    rows = F.transform(span("y1", "y2"), lambda y: F.transform(span("x1", "x2"), lambda x: F.struct(x.alias("cx"), y.alias("cy"))))
    return F.flatten(rows)


def best_overlap(
    cases: DataFrame, records: DataFrame, keys: list[str], case_key: str, record_key: str, z: str = "z", record_z: str = "slice_idx", box: str = "box", record_box: str = "record_box", side: int = 32, few: int = 256,
) -> DataFrame:
    """For each case one record of the same keys: the only one at its slice, else the only one, else the one with most overlap (the first of equals).

    A key with up to ``few`` records meets its cases as it is, so a case is compared ``few`` times at most. Boxes of the other keys meet in the squares of
    a grid, so comparisons follow overlaps, and a key with many cases and records is spread over its squares; a pair counts in the
    square that holds the corner of its intersection. What needs no overlap (how many records, the first, the one at a slice) is aggregated
    before it meets their cases; where nothing overlaps, all are equal and the first counts.
    """
    r = records.select(*keys, F.col(record_key).alias("_k"), F.col(record_z).alias("_rz"), F.col(record_box).alias("_rb"))
    c = cases.select(*keys, F.col(case_key).alias("_case"), F.col(z).alias("_z"), F.col(box).alias("_b"))
    whole = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    large = whole.where(F.col("_n") > few).select(*keys)  # no more than a record in ``few``
    small, much = r.join(large, keys, "left_anti"), r.join(large, keys, "left_semi")
    over = lambda met: _overlaps(met).groupBy(*keys, "_case")
    best = F.max_by("_k", F.when(F.col("_o") > 0, F.struct("_o", (-F.col("_k")).alias("o")))).alias("_best")
    there = F.col("_rz") == F.col("_z")
    near = over(c.join(small, keys)).agg(F.count(F.lit(1)).alias("_n"), F.count_if(there).alias("_at"), F.min(F.when(there, F.col("_k"))).alias("_same"), F.min("_k").alias("_first"), best)
    # the others, through the grid
    sliced = much.groupBy(*keys, F.col("_rz").alias("_z")).agg(F.count(F.lit(1)).alias("_at"), F.min("_k").alias("_same"))
    held = c.join(large, keys, "left_semi")
    per = held.drop("_b").join(whole.where(F.col("_n") > few), keys).join(sliced, [*keys, "_z"], "left")
    per = per.groupBy(*keys, "_case").agg(F.sum("_n").alias("_n"), F.sum("_at").alias("_at"), F.min("_same").alias("_same"), F.min("_first").alias("_first"))
    dealt = lambda rows, b: rows.withColumn("_s", F.explode(_cells(F.col(b), side))).select("*", "_s.cx", "_s.cy").drop("_s")
    met = dealt(held.drop("_z"), "_b").join(dealt(much.drop("_rz"), "_rb"), [*keys, "cx", "cy"])
    corner = lambda e: F.greatest(F.col("_b")[e], F.col("_rb")[e])
    met = met.where((F.floor(corner("x1") / side) == F.col("cx")) & (F.floor(corner("y1") / side) == F.col("cy")))
    far = per.join(over(met).agg(best), [*keys, "_case"], "left")
    method = F.when(F.col("_at") == 1, "patient_seq_slice").when(F.col("_n") == 1, "patient_seq_single").otherwise("patient_seq_best_bbox")
    found = F.when(F.col("_at") == 1, F.col("_same")).otherwise(F.coalesce("_best", "_first"))
    return near.unionByName(far).select(*keys, F.col("_case").alias(case_key), found.alias(record_key), method.alias("match_method"))


def _overlaps(met: DataFrame) -> DataFrame:
    """Pairs with their overlap ``_o``; in steps, so that no step is computed twice."""
    b, rb = F.col("_b"), F.col("_rb")
    rows = met.withColumn("_i", intersection(b, rb)).withColumn("_u", area(b) + area(rb) - F.col("_i"))
    return rows.withColumn("_o", F.round(safe_div("_i", "_u"), 9))


def first_key_match(left: DataFrame, left_keys: Column, left_id: str, right: DataFrame, right_keys: Column, right_id: str) -> DataFrame:
    """For each left row the right row met by the earliest of its keys (then by the right's earliest, then the smallest id)."""
    a = left.select(left_id, F.posexplode(left_keys).alias("_i", "_k"))
    b = right.select(right_id, F.posexplode(right_keys).alias("_j", "_k"))
    # the best right row of a key is the same for every left row, so a key has one before it meets them
    b = b.groupBy("_k").agg(F.min(F.struct("_j", right_id)).alias("_b"))
    met = F.struct(F.col(f"_b.{right_id}").alias(right_id), F.col("_k").alias("key"))
    return a.join(b, "_k").groupBy(left_id).agg(F.min_by(met, F.struct("_i", "_b")).alias("m")).select(left_id, "m.*")


def left_with_missing(rows: DataFrame, others: DataFrame, key: str, mark: str = "resolved") -> DataFrame:
    """Left join that says whether the key was found."""
    return rows.join(others.withColumn(mark, F.lit(True)), key, "left").withColumn(mark, F.coalesce(mark, F.lit(False)))


def common_to_all(tables: list[DataFrame], key: str) -> DataFrame:
    """Keys that every table holds."""
    out = tables[0].select(key).distinct()
    for t in tables[1:]:
        out = out.join(t.select(key).distinct(), key, "left_semi")
    return out


def select_by_fold(predictions: DataFrame, selection: DataFrame, keys: tuple[str, ...] = ("fold", "config")) -> DataFrame:
    """Predictions of the configuration chosen for each fold."""
    return predictions.join(selection.select(*keys).distinct(), list(keys), "left_semi")


def strategy_pairs(rows: DataFrame, pairs: list[tuple[str, str]], key: str = "patient_id", strategy: str = "strategy", value: str = "pred_label", truth: str = "gt_label") -> DataFrame:
    """Each key's decisions by both strategies of each pair, from one aggregation."""
    names = sorted({x for p in pairs for x in p})
    by = rows.where(F.col(strategy).isin(names)).groupBy(key).agg(F.max(truth).alias(truth), F.map_from_entries(F.collect_list(F.struct(strategy, value))).alias("_d"))
    items = F.array(*(F.struct(F.lit(a).alias("strategy_a"), F.lit(b).alias("strategy_b"), F.try_element_at("_d", F.lit(a)).alias("pred_a"), F.try_element_at("_d", F.lit(b)).alias("pred_b")) for a, b in pairs))
    return by.select(key, truth, F.inline(items)).where("pred_a is not null and pred_b is not null")


def keep_first(rows: DataFrame, keys: list[str], position: str) -> DataFrame:
    return first_per_key(rows, keys, [F.col(position)])
