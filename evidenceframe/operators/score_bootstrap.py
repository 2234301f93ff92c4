"""Bootstrap of score metrics for two models over the same draws, stratified by class.

A multinomial sample of N rows is made in two parts: each row is drawn Poisson times, from a hash of row and iteration, with a mean so little below one
that the total stays below N, and what is missing to N is drawn one by one. The first part is made where a row lies, as
often as needed; only the second, some 7 sqrt(N) draws an iteration, is shuffled. So no row per iteration and row ever is.

Rows lie in blocks by falling score, for each model. A first pass counts each block's positives and negatives in every iteration, sums
over the blocks before say where a block begins, and a second pass adds up what every metric needs. Rows of one score may lie in several blocks.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import scratch_dir
from .ranking import ranked_by_hash
from .resample import BITS, FIRST, SECOND, hashed, interval, stratum_number

SCORE_METRICS = ("roc_auc", "average_precision", "brier_score", "log_loss", "ece", "accuracy", "balanced_accuracy", "sensitivity", "specificity")
#: Least and most rows of a block (fewer blocks than tasks would leave some idle), and numbers of a task's matrix (rows by iterations).
LEAST, MOST, MATRIX = 1 << 9, 1 << 15, 1 << 18
#: Standard deviations by which the Poisson totals stay below the sample's size (beyond: once in 10^12), counts that a row can be drawn, and what keeps the single draws' hashes apart.
BELOW, TIMES, APART = 7.0, 20, 0x3C6EF372
BINS, EPS = 10, 1e-6
SUMS = ["auc", "ap", "brier", "loss", "pos", "neg", "tp", "tn", *(f"gap{k}" for k in range(BINS))]


def mixed(x: np.ndarray) -> np.ndarray:
    """A hash of numbers below 2 ** 31."""
    x = ((x ^ (x >> 15)) * FIRST) & BITS
    x = ((x ^ (x >> 14)) * SECOND) & BITS
    return x ^ (x >> 15)


def thresholds(size: int) -> np.ndarray:
    """Hashes from which on a row is drawn once more, for Poisson draws of a stratum of that size."""
    mean = max(0.0, 1 - BELOW / math.sqrt(size))
    terms = [math.exp(-mean) * mean**k / math.factorial(k) for k in range(TIMES)]
    return np.ceil(np.cumsum(terms) * (1 << 31)).astype(np.int64)


class Strata:
    """Size and hash of each class."""

    def __init__(self, rows: list, seed: int):
        self.size = {r["y"]: r["size"] for r in rows}
        self.start = {r["y"]: int(mixed(np.int64((r["_s"] + seed * 7919) & BITS))) for r in rows}
        self.limits = {y: thresholds(n) for y, n in self.size.items()}

    def counts(self, y: np.ndarray, slot: np.ndarray, first: int, last: int) -> np.ndarray:
        """How often rows are drawn in iterations first to last - 1, without single draws."""
        out = np.zeros((len(y), last - first), np.int32)
        for c in np.unique(y):
            own = y == c
            of_iter = mixed((self.start[int(c)] + np.arange(first, last)) & BITS)
            h = mixed((of_iter[None, :] + slot[own][:, None]) & BITS)
            n = np.zeros(h.shape, np.int32)
            for t in self.limits[int(c)]:
                more = h >= t
                if not more.any():
                    break
                n += more
            out[own] = n
        return out


def _singles(missing: DataFrame, strata: Strata) -> DataFrame:
    """missing(iter, y, n, size) with slot: a row per single draw."""
    start = F.create_map(*(F.lit(v).cast("bigint") for y, h in strata.start.items() for v in (y, h)))
    rows = hashed(missing.where("n > 0"), "_i", (start[F.col("y")] + F.col("iter")).bitwiseAND(BITS))
    rows = rows.withColumn("_j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    rows = hashed(rows, "_a", (F.col("_i") + APART + F.col("_j")).bitwiseAND(BITS))
    rows = hashed(rows, "_b", (F.col("_a") + 0x5BD1E995).bitwiseAND(BITS))
    return rows.select("iter", "y", F.coalesce((F.shiftleft("_a", 31) + F.col("_b")) % F.col("size"), F.lit(0)).alias("slot"))


def _chunks(rows: int, iterations: int):
    step = max(1, MATRIX // max(1, rows))
    return ((k, min(k + step, iterations)) for k in range(0, iterations, step))


def _sorted(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """y, slot and score of a block: falling scores, positives first among equal ones."""
    y, slot, v = (table[c].to_numpy() for c in ("y", "slot", "v"))
    order = np.lexsort((slot, y != 1, -v))
    return y[order], slot[order], v[order]


def _edges(total: np.ndarray, k: int) -> np.ndarray:
    """Where calibration bin k begins among so many rows by rising score."""
    return k * (total // BINS) + np.minimum(k, total % BINS)


def _measure(x: np.ndarray, y: np.ndarray, v: np.ndarray, tb: np.ndarray, fb: np.ndarray, total: np.ndarray, cut: tuple[bool, bool]) -> tuple[dict, list]:
    """Sums of a block in some iterations (columns), and (score, positives, negatives, both before) of the scores that other blocks have too."""
    positive = (y == 1)[:, None]
    a, b = np.where(positive, x, 0), np.where(positive, 0, x)
    ta, fa = tb + np.cumsum(a, axis=0), fb + np.cumsum(b, axis=0)
    q = np.clip(v, EPS, 1 - EPS)
    rank, ap = 1, np.zeros(x.shape[1])
    while (more := a >= rank).any():
        place = (ta - a + rank).astype(np.float64)
        ap += np.where(more, place / (place + fa), 0.0).sum(axis=0)
        rank += 1
    out = {
        "auc": (b * ta.astype(np.float64)).sum(axis=0), "ap": ap, "brier": ((v - 1) ** 2) @ a + (v**2) @ b, "loss": np.log(q) @ a + np.log(1 - q) @ b,
        "pos": a.sum(axis=0), "neg": b.sum(axis=0), "tp": a[v >= 0.5].sum(axis=0), "tn": b[v < 0.5].sum(axis=0),
    }
    # Calibration: rows of one score together; by rising score its positives come first
    first = np.flatnonzero(np.concatenate([[True], v[1:] != v[:-1]]))
    last = np.concatenate([first[1:], [len(v)]]) - 1
    ga, gb, gv = np.add.reduceat(a, first, axis=0), np.add.reduceat(b, first, axis=0), v[first][:, None]
    begin = total - ta[last] - fa[last]
    whole = np.ones(len(first), bool)
    whole[0] &= not cut[0]
    whole[-1] &= not cut[1]
    gap = np.where(whole[:, None], ga - (ga + gb) * gv, 0.0)
    below = np.concatenate([np.cumsum(gap[::-1], axis=0)[::-1], np.zeros((2, x.shape[1]))])
    columns, under = np.arange(x.shape[1]), []
    for k in range(BINS + 1):
        # the first score, from above, that begins below the bin's edge lies across it; those after it are below
        edge = _edges(total, k) if k < BINS else total
        g = (begin >= edge).sum(axis=0)
        held = np.minimum(g, len(first) - 1)
        inside = edge - begin[held, columns]
        across = np.minimum(inside, ga[held, columns]) - np.minimum(inside, (ga + gb)[held, columns]) * gv[held, 0]
        under.append(below[g + 1 - (g == len(first)), columns] * (g < len(first)) + np.where((g < len(first)) & whole[held], across, 0.0))
    for k in range(BINS):
        out[f"gap{k}"] = under[k + 1] - under[k]
    shared = []
    for g in sorted({i for i, c in ((0, cut[0]), (len(first) - 1, cut[1])) if c}):
        starts_here = g > 0 or not cut[0]
        before = (ta[last[g]] - ga[g], fa[last[g]] - gb[g]) if starts_here else None
        shared.append((float(v[first[g]]), ga[g], gb[g], before))
    return out, shared


def _scratch(rows: DataFrame) -> DataFrame:
    path = scratch_dir(rows.sparkSession)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def draw_metrics(rows: DataFrame, scores: dict[str, str], iterations: int, seed: int = 42, y: str = "y", order: str = "doc_id", block: int | None = None) -> DataFrame:
    """(model, iter, every score metric) of stratified samples of as many rows as each class has; scores names each model's column.

    A class with no rows leaves metrics that need it null; rows without score or class go.
    """
    named = rows.select(F.col(order).alias("_o"), F.col(y).cast("bigint").alias("y"), *(F.col(c).cast("double").alias(f"_{i}") for i, c in enumerate(scores.values()))).dropna()
    placed = _scratch(ranked_by_hash(named, ["y"], 0, "_o", "slot", "size").withColumn("slot", (F.col("slot") - 1).cast("bigint")))
    strata = Strata(placed.groupBy("y").agg(F.max("size").alias("size")).withColumn("_s", stratum_number(["y"])).collect(), seed)  # a row per class
    models = F.array(*(F.struct(F.lit(m).alias("model"), F.col(f"_{i}").alias("v")) for i, m in enumerate(scores)))
    long = placed.select("y", "slot", F.inline(models))
    long_rows, tasks = len(scores) * sum(strata.size.values()), 2 * rows.sparkSession.sparkContext.defaultParallelism
    parts = max(1, math.ceil(long_rows / (block or min(MOST, max(LEAST, long_rows // tasks)))))
    ranged = long.repartitionByRange(parts, "model", F.desc("v"), F.desc(F.col("y") == 1), "slot").withColumn("part", F.spark_partition_id())
    blocks = _scratch(ranged)
    key = ["model", "part"]

    def count(group, table):
        found = _sorted(table)
        sums = []
        for lo, hi in _chunks(table.num_rows, iterations):
            x = strata.counts(found[0], found[1], lo, hi)
            sums.append(np.stack([x[found[0] == 1].sum(axis=0), x[found[0] != 1].sum(axis=0)]))
        a, b = np.concatenate(sums, axis=1)
        n = len(a)
        yield pa.RecordBatch.from_arrays([pa.array([group[0].as_py()] * n), pa.array([group[1].as_py()] * n, pa.int32()), pa.array(np.arange(n, dtype=np.int32)), pa.array(a), pa.array(b)], ["model", "part", "iter", "a", "b"])

    # few bytes but much work: by number, so that blocks aren't gathered into few tasks
    grouped = blocks.repartition(parts, *key).groupBy(*key)
    drawn = _scratch(grouped.applyInArrow(_tables(count), "model string, part int, iter int, a long, b long"))
    totals = drawn.where(F.col("model") == next(iter(scores))).groupBy("iter").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    sizes = F.array(*(F.struct(F.lit(c).cast("bigint").alias("y"), F.lit(n).cast("bigint").alias("size"), (F.lit(n) - F.col("a" if c == 1 else "b")).cast("bigint").alias("n")) for c, n in strata.size.items()))
    missing = totals.select("iter", F.inline(sizes)) if strata.size else totals.select("iter", F.lit(0).alias("y"), F.lit(0).alias("n"), F.lit(0).alias("size")).where("false")
    singles = _singles(missing.repartition(tasks, "iter"), strata) if strata.size else missing.select("iter", "y", F.lit(0).cast("bigint").alias("slot"))
    # both sides are dealt: files of numbers are small, but as a table sent through the driver they are a multiple of that
    singles = _scratch(singles.hint("merge").join(blocks.select("y", "slot", *key), ["y", "slot"]).select(*key, "iter", "y", "slot"))
    more = singles.groupBy(*key, "iter").agg(F.count_if(F.col("y") == 1).alias("a"), F.count_if(F.col("y") != 1).alias("b"))
    counts = drawn.unionByName(more).groupBy(*key, "iter").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy("model", "iter").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("model", "iter")
    before = lambda c: F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"{c}0")
    starts = counts.select(*key, "iter", before("a"), before("b"), F.sum(F.col("a") + F.col("b")).over(whole).alias("total"))
    # a score that the block before or after has too; a row per block
    ends = blocks.groupBy(*key).agg(F.max("v").alias("high"), F.min("v").alias("low"))
    beside = Window.partitionBy("model").orderBy("part")
    cuts = ends.select(*key, F.coalesce(F.lag("low").over(beside) == F.col("high"), F.lit(False)).alias("cut0"), F.coalesce(F.lead("high").over(beside) == F.col("low"), F.lit(False)).alias("cut1"))
    # a row per block and iteration, with what is drawn singly there as a list: a row per draw is a multiple of that in a task
    extra = singles.groupBy(*key, "iter").agg(F.collect_list(F.col("slot") * 2 + (F.col("y") == 1).cast("bigint")).alias("drawn"))
    given = starts.join(cuts, key).join(extra, [*key, "iter"], "left").select(*key, "iter", "a0", "b0", "total", "cut0", "cut1", "drawn")

    def measure(group, table, others):
        name = group[0].as_py()
        y_, slot_, v_ = _sorted(table)
        begin = others.sort_by("iter")
        a0, b0, total = (begin[c].to_numpy() for c in ("a0", "b0", "total"))
        cut = (begin["cut0"][0].as_py(), begin["cut1"][0].as_py())
        code = slot_ * 2 + (y_ == 1)
        order = np.argsort(code)
        lists = begin["drawn"].combine_chunks()
        lists = pa.concat_arrays(lists.chunks) if isinstance(lists, pa.ChunkedArray) else lists
        drawn = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        when = np.repeat(begin["iter"].to_numpy(), pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False))
        where = order[np.searchsorted(code[order], drawn)] if len(drawn) else np.zeros(0, np.int64)
        for lo, hi in _chunks(len(y_), iterations):
            x = strata.counts(y_, slot_, lo, hi)
            i, j = np.searchsorted(when, [lo, hi])
            np.add.at(x, (where[i:j], when[i:j] - lo), 1)
            sums, shared = _measure(x, y_, v_, a0[lo:hi], b0[lo:hi], total[lo:hi], cut)
            n, none = hi - lo, pa.nulls(hi - lo, pa.int64())
            its, names = pa.array(np.arange(lo, hi, dtype=np.int32)), pa.array([name] * n)
            yield pa.RecordBatch.from_arrays([names, its, *(pa.array(np.asarray(sums[c], np.float64)) for c in SUMS), pa.nulls(n, pa.float64()), none, none, none, none], OUT)
            for value, a, b, first in shared:
                sides = (none, none) if first is None else tuple(pa.array(f.astype(np.int64)) for f in first)
                yield pa.RecordBatch.from_arrays([names, its, *(pa.nulls(n, pa.float64()) for _ in SUMS), pa.array(np.full(n, value)), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), *sides], OUT)

    schema = "model string, iter int, " + ", ".join(f"{c} double" for c in SUMS) + ", v double, a long, b long, a0 long, b0 long"
    found = _scratch(grouped.cogroup(given.repartition(parts, *key).groupBy(*key)).applyInArrow(_cogrouped(measure), schema))
    all_ = sum(strata.size.values())
    shared = found.where("v is not null").groupBy("model", "iter", "v").agg(*(F.sum(c).alias(c) for c in ("a", "b")), *(F.max(c).alias(c) for c in ("a0", "b0")))
    begin = F.lit(all_) - F.col("a0") - F.col("b0") - F.col("a") - F.col("b")
    edge = lambda k: k * (all_ // BINS) + min(k, all_ % BINS)
    inside = lambda k, low, n: F.greatest(F.lit(0), F.least(low + n, F.lit(edge(k + 1))) - F.greatest(low, F.lit(edge(k))))
    gaps = {f"gap{k}": inside(k, begin, F.col("a")) - (inside(k, begin, F.col("a")) + inside(k, begin + F.col("a"), F.col("b"))) * F.col("v") for k in range(BINS)}
    both = found.where("v is null").select("model", "iter", *SUMS).unionByName(shared.select("model", "iter", *(c.alias(k) for k, c in gaps.items())), allowMissingColumns=True)
    g = both.groupBy("model", "iter").agg(*(F.sum(c).alias(c) for c in SUMS))
    n, c = F.col("pos") + F.col("neg"), F.col
    ratio = lambda x, d: F.when(d > 0, x / d)
    sens, spec = c("tp") / F.greatest("pos", F.lit(1.0)), c("tn") / F.greatest("neg", F.lit(1.0))
    metrics = (
        ratio(c("auc"), c("pos") * c("neg")), ratio(c("ap"), c("pos")), c("brier") / n, -c("loss") / n, sum((F.abs(f"gap{k}") for k in range(1, BINS)), F.abs("gap0")) / n,
        (c("tp") + c("tn")) / n, (sens + spec) / 2, sens, spec,
    )
    return g.select("model", "iter", *(m.alias(name) for name, m in zip(SCORE_METRICS, metrics)))


OUT = ["model", "iter", *SUMS, "v", "a", "b", "a0", "b0"]


def _tables(f):
    """A function of key and table that yields batches, in the form that grouped Arrow functions have."""

    def run(key: tuple, table: pa.Table) -> pa.Table:
        return pa.Table.from_batches(f(key, table))

    return run


def _cogrouped(f):
    def run(key: tuple, table: pa.Table, others: pa.Table) -> pa.Table:
        return pa.Table.from_batches(f(key, table, others))

    return run


def bootstrap_scores(rows: DataFrame, first: tuple[str, str], second: tuple[str, str], iterations: int = 10_000, seed: int = 42, y: str = "y", order: str = "doc_id") -> DataFrame:
    """Intervals of every score metric of two models (name and score column), and of the first less the second (``delta``), over the same
    draws within each class."""
    per = draw_metrics(rows, dict((first, second)), iterations, seed, y, order)
    side = lambda m, k: F.max(F.when(F.col("model") == m, F.col(k)))
    long = per.groupBy("iter").agg(*(F.array(side(first[0], m), side(second[0], m), side(first[0], m) - side(second[0], m)).alias(m) for m in SCORE_METRICS))
    names = F.array(F.lit(first[0]), F.lit(second[0]), F.lit("delta"))
    both = long.select(F.explode(F.arrays_zip(names.alias("model"), *SCORE_METRICS)).alias("r")).select("r.*")
    return interval(both, list(SCORE_METRICS), ["model"])
