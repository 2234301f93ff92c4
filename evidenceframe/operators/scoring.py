"""Discrimination and calibration of scores, percentiles and exact tests.

Global orderings run in two steps, so that no task receives the whole table: rows are ranked within blocks of about equally
many rows, and what precedes a block comes from a table of one row per block. Blocks lie between quantiles of the score; a score
that many rows share has blocks of its own, by quantiles of the tie.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.coerce import safe_div, safe_float

EPS = 1e-6


def positive_share(positive: str = "score_infection", negative: str = "score_tumor") -> Column:
    """positive / (positive + negative); 0.5 where there is nothing."""
    a, b = safe_float(positive), safe_float(negative)
    return F.when(a + b > 0, a / (a + b)).otherwise(0.5)


def _bucket(rows: DataFrame, name: str, value: str, cuts: list[float]) -> DataFrame:
    """rows with the number of cuts at or below a value, by binary search."""
    splits = [-math.inf, *(cuts or [0.0]), math.inf]
    numbered = Bucketizer(splits=splits, inputCol="_value", outputCol=name, handleInvalid="keep").transform(rows.withColumn("_value", F.col(value).cast("double")))
    return numbered.drop("_value")


def _with_blocks(rows: DataFrame, p: str, tie: str, blocks: int) -> DataFrame:
    """rows with _block, ascending along descending score, then tie."""
    at, error = [i / blocks for i in range(1, blocks)], 0.25 / blocks
    found = rows.select(F.col(p).cast("double").alias("p")).approxQuantile("p", at, error)
    shared = sorted(x for x, n in Counter(found).items() if n > 1)
    cuts = sorted({*found, *(math.nextafter(x, math.inf) for x in shared)})
    out = _bucket(rows, "_p", p, cuts).withColumn("_t", F.lit(0.0))
    if shared and rows.schema[tie].dataType.simpleString() in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        ties = sorted(set(rows.select(F.col(tie).cast("double").alias("t")).approxQuantile("t", at, error)))
        out = _bucket(out, "_place", tie, ties).withColumn("_t", F.when(F.col(p).isin(shared), F.col("_place")).otherwise(0.0)).drop("_place")
    return out.withColumn("_block", ((len(cuts) + 2 - F.col("_p")) * (blocks + 2) + F.col("_t")).cast("int")).drop("_p", "_t")


def cumulative(rows: DataFrame, y: str, p: str, tie: str, blocks: int = 256) -> DataFrame:
    """rows with pos, tp, fp, n_pos, n_neg: place and counts up to it, by descending score, ties by ``tie``."""
    base = _with_blocks(rows, p, tie, blocks)
    sums = base.groupBy("_block").agg(F.count(F.lit(1)).alias("_bn"), F.sum(y).alias("_by"))
    before = Window.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    all_ = Window.partitionBy()
    sums = sums.select("_block", F.coalesce(F.sum("_bn").over(before), F.lit(0)).alias("_n0"), F.coalesce(F.sum("_by").over(before), F.lit(0)).alias("_y0"), F.sum("_bn").over(all_).alias("_all"), F.sum("_by").over(all_).alias("n_pos"))
    order = Window.partitionBy("_block").orderBy(F.col(p).desc(), tie)
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    out = base.withColumn("_r", F.row_number().over(order)).withColumn("_cy", F.sum(y).over(upto)).join(F.broadcast(sums), "_block")
    out = out.withColumn("pos", F.col("_n0") + F.col("_r")).withColumn("tp", F.col("_y0") + F.col("_cy")).withColumn("fp", F.col("pos") - F.col("tp")).withColumn("n_neg", F.col("_all") - F.col("n_pos"))
    return out.drop("_block", "_r", "_cy", "_n0", "_y0", "_all")


def roc_points(rows: DataFrame, y: str = "y", p: str = "p", tie: str = "doc_id") -> DataFrame:
    """(curve, pos, x, fraction): the ROC curve row by row; ties are not merged."""
    c = cumulative(rows, y, p, tie)
    return c.select(F.lit("roc").alias("curve"), "pos", (F.col("fp") / F.greatest("n_neg", F.lit(1))).alias("x"), (F.col("tp") / F.greatest("n_pos", F.lit(1))).alias("value"))


def pr_points(rows: DataFrame, y: str = "y", p: str = "p", tie: str = "doc_id") -> DataFrame:
    c = cumulative(rows, y, p, tie)
    return c.select(F.lit("pr").alias("curve"), "pos", (F.col("tp") / F.greatest("n_pos", F.lit(1))).alias("x"), (F.col("tp") / F.col("pos")).alias("value"))


def roc_auc(rows: DataFrame, y: str = "y", p: str = "p", tie: str = "doc_id") -> DataFrame:
    """Area under the stepwise curve: a negative adds a column as high as the positives before it."""
    c = cumulative(rows, y, p, tie)
    auc = F.sum(F.when(F.col(y) == 0, F.col("tp"))) / (F.greatest(F.max("n_pos"), F.lit(1)) * F.greatest(F.max("n_neg"), F.lit(1)))
    # the curve ends in (1, 1), which adds a triangle's area only where a class is missing
    end = F.when(F.max("n_neg") == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return c.agg((F.coalesce(auc, F.lit(0.0)) + end).alias("roc_auc"))


def average_precision(rows: DataFrame, y: str = "y", p: str = "p", tie: str = "doc_id") -> DataFrame:
    c = cumulative(rows, y, p, tie)
    return c.agg(F.coalesce(F.sum(F.when(F.col(y) == 1, F.col("tp") / F.col("pos"))) / F.greatest(F.max("n_pos"), F.lit(1)), F.lit(0.0)).alias("average_precision"))


def brier_log_loss(rows: DataFrame, y: str = "y", p: str = "p") -> DataFrame:
    clipped = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    loss = F.col(y) * F.ln(clipped) + (1 - F.col(y)) * F.ln(1 - clipped)
    return rows.agg(F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier_score"), (-F.avg(loss)).alias("log_loss"))


def threshold_metrics(rows: DataFrame, y: str = "y", p: str = "p", at: float = 0.5) -> DataFrame:
    pred = F.col(p) >= at
    pos = F.col(y) == 1
    g = rows.agg(F.count_if(pos & pred).alias("tp"), F.count_if(pos & ~pred).alias("fn"), F.count_if(~pos & ~pred).alias("tn"), F.count_if(~pos & pred).alias("fp"))
    g = g.withColumn("sensitivity", F.col("tp") / F.greatest(F.col("tp") + F.col("fn"), F.lit(1))).withColumn("specificity", F.col("tn") / F.greatest(F.col("tn") + F.col("fp"), F.lit(1)))
    n = F.col("tp") + F.col("fn") + F.col("tn") + F.col("fp")
    return g.withColumn("accuracy", safe_div(F.col("tp") + F.col("tn"), n)).withColumn("balanced_accuracy", (F.col("sensitivity") + F.col("specificity")) / 2)


def calibration_bins(rows: DataFrame, y: str = "y", p: str = "p", tie: str = "doc_id", bins: int = 10) -> DataFrame:
    """Bins of equally many rows by ascending score; the first ones hold the rows left over."""
    low = rows.withColumn("_q", 1 - F.col(p))
    c = cumulative(low, y, "_q", tie)
    n = F.col("n_pos") + F.col("n_neg")
    k = F.least(F.lit(bins), n)
    size, rest = F.floor(n / k), n % k
    place = F.col("pos") - 1
    head = rest * (size + 1)
    bin_ = F.when(place < head, F.floor(place / (size + 1))).otherwise(rest + F.floor((place - head) / F.greatest(size, F.lit(1)))) + 1
    g = c.groupBy(bin_.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mean_predicted"), F.avg(F.col(y).cast("double")).alias("observed"))
    return g.withColumn("error", F.abs(F.col("observed") - F.col("mean_predicted")))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg((F.sum(F.col("n") * F.col("error")) / F.sum("n")).alias("ece"))


#: Bins of the logit, by outcome, on which the recalibration begins.
LOGIT_BINS = 4096


def _newton(s: list[float]) -> tuple[float, float] | None:
    """The change of intercept and slope from a step's five sums; none if they have none."""
    if s[0] is None or not all(map(math.isfinite, s)) or (det := s[2] * s[4] - s[3] * s[3]) == 0:
        return None
    return (s[4] * s[0] - s[3] * s[1]) / det, (s[2] * s[1] - s[3] * s[0]) / det


def _first_fit(bins: list, steps: int) -> tuple[float, float]:
    """Newton's steps over bins (mean logit, outcome, rows), on the driver: near the solution, in no job."""
    a, b = 0.0, 1.0
    for _ in range(steps):
        s = [0.0] * 5
        for x, y, n in bins:
            h = 1 / (1 + math.exp(-min(max(a + b * x, -30.0), 30.0)))
            w, g = max(h * (1 - h), EPS) * n, (y - h) * n
            s = [t + v for t, v in zip(s, (g, g * x, w, w * x, w * x * x))]
        change = _newton(s)
        if change is None or not math.isfinite(sum(change)):
            return 0.0, 1.0
        a, b = a + change[0], b + change[1]
        if max(map(abs, change)) < 1e-8:
            return a, b
    return 0.0, 1.0


def calibration_fit(rows: DataFrame, y: str = "y", p: str = "p", steps: int = 100) -> DataFrame:
    """Intercept and slope of a logistic recalibration, by Newton steps; NULLs if it fails or runs off.

    The steps begin where those over a histogram of the logits end, so two or three are left, each an aggregation of five sums over the
    distinct (score, outcome) pairs with their counts. The histogram and the sums come to the driver.
    """
    clipped = F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    cells = rows.groupBy(F.ln(clipped / (1 - clipped)).alias("x"), F.col(y).cast("double").alias("y")).agg(F.count(F.lit(1)).alias("n")).persist()
    x, n = F.col("x"), F.col("n")
    ok = True
    try:
        edge = math.log(1 / EPS)
        place = F.floor((x + edge) / (2 * edge) * LOGIT_BINS)
        bins = cells.dropna().groupBy(place.alias("bin"), "y").agg((F.sum(n * x) / F.sum(n)).alias("x"), F.sum(n).alias("n")).select("x", "y", "n").collect()  # two a bin at most, for two outcomes
        a, b = _first_fit([tuple(r) for r in bins], steps)
        for _ in range(steps):
            linear = F.least(F.greatest(F.lit(a) + F.lit(b) * x, F.lit(-30.0)), F.lit(30.0))
            fitted = 1 / (1 + F.exp(-linear))
            w, g = F.greatest(fitted * (1 - fitted), F.lit(EPS)) * n, (F.col("y") - fitted) * n
            change = _newton(list(cells.agg(F.sum(g), F.sum(g * x), F.sum(w), F.sum(w * x), F.sum(w * x * x)).first()))
            if change is None:
                ok = False
                break
            a, b = a + change[0], b + change[1]
            if max(map(abs, change)) < 1e-8:
                break
    finally:
        cells.unpersist()
    ok = ok and math.isfinite(a) and math.isfinite(b) and max(abs(a), abs(b)) <= 20
    return rows.sparkSession.createDataFrame([(round(a, 6) if ok else None, round(b, 6) if ok else None)], "intercept double, slope double")


def percentiles(rows: DataFrame, value: str, at: dict[str, float], keys: list[str] | None = None) -> DataFrame:
    """Exact percentiles with linear interpolation."""
    return rows.groupBy(*(keys or [])).agg(*(F.percentile(value, F.lit(q)).alias(n) for n, q in at.items()))


def discordance(rows: DataFrame, a: str = "pred_selected", b: str = "pred_baseline", truth: str = "gt_label", keys: list[str] | None = None) -> DataFrame:
    """How two raters agree with the truth: both, either alone, neither, and where they differ."""
    hit = lambda c: F.coalesce(F.col(c) == F.col(truth), F.lit(False))
    x, y = hit(a), hit(b)
    return rows.groupBy(*(keys or [])).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(x & y).alias("both_correct"), F.count_if(x & ~y).alias("a_only_correct"), F.count_if(~x & y).alias("b_only_correct"), F.count_if(~x & ~y).alias("both_wrong"),
        F.count_if(~F.col(a).eqNullSafe(F.col(b))).alias("label_changes"),
    )


def mcnemar_p(b: Column, c: Column) -> Column:
    """Exact two-sided p of b against c discordant pairs: twice the binomial tail, 1 at most, summed from its largest term down in logarithms."""
    n, k = (b + c).cast("double"), F.least(b, c)
    logs = F.aggregate(F.sequence(F.lit(1), F.greatest(k, F.lit(1)).cast("int")), F.lit(0.0), lambda s, i: s + F.when(i <= k, F.ln((n - i + 1) / i)).otherwise(0.0))
    # terms from C(n, k) downward: each is the one before times j / (n - j + 1)
    seq = F.sequence(F.lit(0), k.cast("int"))
    start = F.struct(F.lit(1.0).alias("term"), F.lit(0.0).alias("sum"))
    tail = F.aggregate(seq, start, lambda s, i: F.struct((s["term"] * (k - i) / (n - k + i + 1)).alias("term"), (s["sum"] + s["term"]).alias("sum")))["sum"]
    return F.when(n == 0, 1.0).otherwise(F.least(F.lit(1.0), 2 * F.exp(logs + F.ln(tail) - n * F.ln(F.lit(2.0)))))
