"""Splits, folds, quotas and mixtures of subjects; orders come from hashes, so they don't depend on partitioning."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked_by_hash


def stratified_split(subjects: DataFrame, ratio: float, seed: int = 42, key: str = "patient_id", label: str = "gt_label") -> DataFrame:
    """subjects with split: in each label round(n * ratio), one at least, go to ``val``."""
    r = ranked_by_hash(subjects, [label], seed, key, "_r", "_n")
    quota = F.greatest(F.lit(1), F.rint(F.col("_n") * F.lit(float(ratio))))
    return r.withColumn("split", F.when(F.col("_r") <= quota, "val").otherwise("train")).drop("_r", "_n")


def outer_folds(subjects: DataFrame, folds: int, seed: int = 42, key: str = "patient_id", label: str = "gt_label") -> DataFrame:
    """subjects with fold, dealt in turn within each label."""
    return ranked_by_hash(subjects, [label], seed, key, "_r").withColumn("fold", F.pmod(F.col("_r") - 1, F.lit(folds)).cast("int")).drop("_r")


def quotas(available: DataFrame, total: int, groups: list[str] | None = None, label: str = "gt_label", n: str = "n") -> DataFrame:
    """available(groups, label, n) with quota: shares of total by largest remainder, none above what is there.

    Whole parts first; the seats left go round by remainder (then by number available, then by name), skipping the full.
    """
    g = Window.partitionBy(*(groups or []))
    q = available.withColumn("_all", F.sum(n).over(g)).withColumn("_raw", F.lit(float(total)) * F.col(n) / F.col("_all"))
    q = q.withColumn("_whole", F.least(F.floor("_raw"), F.col(n))).withColumn("_left", F.lit(total) - F.sum("_whole").over(g))
    # a label's share never exceeds what it has, so one round gives every seat left
    order = F.row_number().over(g.orderBy(F.desc(F.col("_raw") - F.floor("_raw")), F.desc(n), F.desc(label)))
    q = q.withColumn("_order", F.when(F.col("_whole") < F.col(n), order))
    place = F.count("_order").over(g.orderBy(F.col("_order").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, 0))
    return q.withColumn("quota", (F.col("_whole") + F.when(F.col("_order").isNotNull() & (place <= F.col("_left")), 1).otherwise(0)).cast("bigint")).drop("_all", "_raw", "_whole", "_left", "_order")


def stratified_sample(subjects: DataFrame, total: int, seed: int = 42, groups: list[str] | None = None, key: str = "patient_id", label: str = "gt_label") -> DataFrame:
    """``total`` subjects (of each group), by quotas; a smaller sample of the same seed and shares lies inside a larger one."""
    groups = groups or []
    q = quotas(subjects.groupBy(*groups, label).agg(F.count(F.lit(1)).alias("n")), total, groups, label).select(*groups, label, "quota")
    r = ranked_by_hash(subjects, [*groups, label], seed, key, "_r")
    return r.join(q, [*groups, label]).where(F.col("_r") <= F.col("quota")).drop("_r", "quota")


def nested_protocol(subjects: DataFrame, folds: int, small: int, large: int, seed: int = 42, key: str = "patient_id", label: str = "gt_label") -> DataFrame:
    """One row per fold and subject: role (outer_test, adapt or inner_val), and whether it is in the small and large sample.

    The samples come from what isn't tested in the fold; the small one lies inside the large one.
    """
    dealt = outer_folds(subjects, folds, seed, key, label).withColumnRenamed("fold", "_own")
    pairs = dealt.withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))))
    develop = pairs.where("fold <> _own")
    inside = stratified_sample(develop, large, seed + 1, ["fold"], key, label).select("fold", key, F.lit(True).alias("in_large"))
    core = stratified_sample(develop.join(inside.select("fold", key), ["fold", key], "left_semi"), small, seed + 2, ["fold"], key, label).select("fold", key, F.lit(True).alias("in_small"))
    out = pairs.join(inside, ["fold", key], "left").join(core, ["fold", key], "left")
    lone = lambda c: F.coalesce(F.col(c), F.lit(False))
    role = F.when(F.col("fold") == F.col("_own"), "outer_test").when(lone("in_large"), "adapt").otherwise("inner_val")
    return out.select("fold", key, label, role.alias("role"), lone("in_small").alias("in_small"), lone("in_large").alias("in_large"))


def oversample(records: DataFrame, key: str, label: str, seed: int = 42) -> DataFrame:
    """All records, and of every smaller label drawn ones (with replacement) up to the size of the largest; copy counts from 0."""
    from .resample import draw, slots

    s = slots(records, [label], key)
    sizes = records.groupBy(label).agg(F.count(F.lit(1)).alias("_n")).withColumn("_most", F.max("_n").over(Window.partitionBy()))
    extra = sizes.where("_most > _n").withColumn("_draw", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_most") - F.col("_n"))))
    extra = extra.withColumn("slot", draw(F.col("_n"), seed, F.col(label), F.col("_draw"))).groupBy(label, "slot").agg(F.count(F.lit(1)).alias("_times"))
    out = s.join(extra, [label, "slot"], "left")
    return out.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("bigint"), F.coalesce("_times", F.lit(0).cast("bigint"))))).drop("slot", "size", "_times")


def mix_repeated(internal: DataFrame, external: DataFrame, repeat: int) -> DataFrame:
    """Internal rows once and external rows ``repeat`` times, with their source."""
    more = external.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(repeat - 1)))) if repeat > 0 else external.withColumn("copy", F.lit(0)).limit(0)
    return internal.withColumn("copy", F.lit(0)).withColumn("source_dataset", F.lit("internal")).unionByName(more.withColumn("source_dataset", F.lit("external")))
