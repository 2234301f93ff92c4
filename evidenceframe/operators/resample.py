"""Bootstrap by counter-based draws: a draw is a function of seed, stratum, iteration and slot, so results don't depend on partitioning.

Metrics of class decisions need only how often each (truth, decision) cell is drawn. ``drawn_counts`` draws every row of every iteration: a stratum's
slots sorted by cell fall into few intervals, so draws are made and counted where the small table of intervals is, by integer arithmetic
inside one generated loop. ``cell_counts`` makes the counts themselves, which are multinomial: each is a binomial number among the draws that
are left, made in constant time.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranking import ranked_by_hash

#: The hash behind a draw works on 31 bits, so that no product leaves 64.
BITS = (1 << 31) - 1
FIRST, SECOND = 0x2C1B3C6D, 0x297A2D39
#: Draws that a row of work makes, and those that stand beside each other in a row of its loop.
BLOCK, BESIDE = 1 << 16, 4


def draw(n: Column, *parts: Column | str | int) -> Column:
    """A number from 0 to n - 1 from the MD5 of the parts."""
    cells = [p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    return F.pmod(F.conv(F.substring(F.md5(F.concat_ws("|", *cells)), 1, 8), 16, 10).cast("bigint"), n)


def stratum_number(strata: list[str]) -> Column:
    name = F.concat_ws("|", *(F.coalesce(F.col(s).cast("string"), F.lit("")) for s in strata))
    return F.conv(F.substring(F.md5(name), 1, 7), 16, 10).cast("bigint")


def hashed(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """rows with a hash of a number below 2 ** 31; in steps, so that no step is computed twice."""
    shifted = lambda c, k: c.bitwiseXOR(F.shiftright(c, k))
    rows = rows.withColumn(name, value)
    rows = rows.withColumn(name, (shifted(F.col(name), 15) * FIRST).bitwiseAND(BITS))
    rows = rows.withColumn(name, (shifted(F.col(name), 14) * SECOND).bitwiseAND(BITS))
    return rows.withColumn(name, shifted(F.col(name), 15))


def slots(rows: DataFrame, strata: list[str], order: str) -> DataFrame:
    """rows with slot (from 0, by a hash of ``order``) and size of their stratum; without strata all rows are one."""
    ranks = ranked_by_hash(rows, strata, 0, order, "slot", "size")
    return ranks.withColumn("slot", (F.col("slot") - 1).cast("bigint"))


#: What Stirling's formula lacks of the logarithm of k!, for the smallest k.
STIRLING = [math.lgamma(k + 1) - ((k + 0.5) * math.log(k + 1) - (k + 1) + 0.5 * math.log(2 * math.pi)) for k in range(10)]
#: Least mean for the rejection method, terms that inversion sums below it, and proposals after which the mode is taken (fewer than one in 10^13 are left).
MEAN, TERMS, TRIES = 10, 60, 16


def let(name: str, value: str, body: str) -> str:
    """SQL of a body in which a name stands for a value that is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


def uniform(digest: str, start: int) -> str:
    """SQL of a number between 0 and 1 from 52 bits of an MD5."""
    return f"((bigint(conv(substring({digest}, {start}, 13), 16, 10)) + 0.5D) / {1 << 52}D)"


def _stirling(k: str) -> str:
    near = ", ".join(f"{v!r}D" for v in STIRLING)
    far = f"(1D / 12 - (1D / 360 - 1D / 1260 / (({k} + 1D) * ({k} + 1D))) / (({k} + 1D) * ({k} + 1D))) / ({k} + 1D)"
    return f"if({k} < {len(STIRLING)}, element_at(array({near}), int({k}) + 1), {far})"


def _inverted(n: str, p: str, key: str) -> str:
    """The first count at which the distribution function reaches a uniform number: for means below ``MEAN``."""
    step = f"(s, k) -> named_struct('term', s.term * ({n} - k) / (k + 1) * {p} / (1 - {p}), 'sum', s.sum + s.term, 'x', s.x + if(s.sum + s.term < u0, 1L, 0L))"
    found = f"aggregate(sequence(0L, least({n}, {TERMS}L) - 1), named_struct('term', exp({n} * ln(1 - {p})), 'sum', 0D, 'x', 0L), {step}, s -> s.x)"
    return let("h0", f"md5(concat({key}, '|0'))", let("u0", uniform("h0", 1), found))


def _rejected(n: str, p: str, key: str) -> str:
    """Transformed rejection with a squeeze (Hoermann 1993): the first of some proposals that is accepted; for p up to a half and means from ``MEAN``."""
    bound = f"c.top + ({n} + 1) * ln(({n} - c.m + 1) / ({n} - k + 1)) + (k + 0.5D) * ln(c.r * ({n} - k + 1) / (k + 1)) - {_stirling('k')} - {_stirling(f'({n} - k)')}"
    judge = f"case when w.us >= 0.07D and w.v <= c.vr then k when k < 0 or k > {n} then null when ln(w.v * c.alpha / (c.a / (w.us * w.us) + c.b)) <= {bound} then k end"
    pair = let("h", f"md5(concat({key}, '|', t))", f"named_struct('u', {uniform('h', 1)} - 0.5D, 'v', {uniform('h', 14)}, 'us', 0.5D - abs({uniform('h', 1)} - 0.5D))")
    attempt = let("w", pair, let("k", f"floor((2 * c.a / w.us + c.b) * w.u + {n} * {p} + 0.5D)", judge))
    first = f"coalesce(aggregate(sequence(0, {TRIES - 1}), bigint(null), (found, t) -> coalesce(found, {attempt})), c.m)"
    more = f"named_struct('b', d.b, 'a', d.a, 'm', d.m, 'r', d.r, 'vr', 0.92D - 4.2D / d.b, 'alpha', (2.83D + 5.1D / d.b) * d.s, 'top', (d.m + 0.5D) * ln((d.m + 1) / (d.r * ({n} - d.m + 1))) + {_stirling('d.m')} + {_stirling(f'({n} - d.m)')})"
    shape = f"named_struct('s', s, 'b', 1.15D + 2.53D * s, 'a', -0.0873D + 0.0248D * (1.15D + 2.53D * s) + 0.01D * {p}, 'm', floor(({n} + 1) * {p}), 'r', {p} / (1 - {p}))"
    return let("s", f"sqrt({n} * {p} * (1 - {p}))", let("d", shape, let("c", more, first)))


def binomial(n: str, p: str, key: str) -> str:
    """SQL of how many of n trials succeed with probability p, a function of the key, a text: exact, in work that doesn't grow with n."""
    x = f"case when bn <= 0 or q <= 0 then 0L when bn * q < {MEAN} then {_inverted('bn', 'q', 'bk')} else {_rejected('bn', 'q', 'bk')} end"
    return let("bn", f"bigint({n})", let("bp", p, let("bk", key, let("q", "least(bp, 1 - bp)", let("bx", x, "if(bp > 0.5D, bn - bx, bx)")))))


def cell_counts(rows: DataFrame, strata: list[str], cell: list[str], iterations: int, seed: int) -> DataFrame:
    """(iter, strata, cell, n): how often each cell is drawn in each iteration, drawing as many rows as a stratum has.

    The counts of a stratum's cells are multinomial: one after the other is binomial among the draws that are left, so work follows
    cells and iterations, not rows. A stratum's cells (classes by decisions) stand in an array.
    """
    counts = rows.groupBy(*strata, *cell).agg(F.count(F.lit(1)).alias("_n"))
    held = F.array_sort(F.collect_list(F.struct(*(F.struct(F.col(c).isNotNull().alias("given"), F.col(c).alias("value")).alias(c) for c in cell), F.col("_n").alias("n"))))
    sizes = counts.groupBy(*strata).agg(held.alias("_cells"), F.sum("_n").alias("_size"))
    work = sizes.withColumn("_key", stratum_number(strata)).withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    # few bytes but much work: by number, so that the rows aren't gathered into few tasks
    work = work.repartition(2 * rows.sparkSession.sparkContext.defaultParallelism, "iter", *strata)
    key = f"concat_ws('|', '{int(seed)}', _key, iter, size(a.out))"
    step = let("x", binomial("a.left", "e.n / a.mass", key), "named_struct('left', a.left - x, 'mass', a.mass - e.n, 'out', array_append(a.out, x))")
    drawn = work.withColumn("_ns", F.expr(f"aggregate(_cells, named_struct('left', _size, 'mass', _size, 'out', cast(array() as array<bigint>)), (a, e) -> {step}, a -> a.out)"))
    found = drawn.select("iter", *strata, F.explode(F.arrays_zip("_cells", "_ns")).alias("_r"))
    return found.where("_r._ns > 0").select("iter", *strata, *(F.col(f"_r._cells.{c}.value").alias(c) for c in cell), F.col("_r._ns").alias("n"))


def intervals_of(rows: DataFrame, strata: list[str], cell: list[str]) -> DataFrame:
    """(strata, cell, low, high, size): a stratum's slots sorted by cell fall into few intervals; slots low to high - 1 hold rows of that cell."""
    counts = rows.groupBy(*strata, *cell).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*strata)
    upto = w.orderBy(*(F.col(c).asc_nulls_first() for c in cell)).rowsBetween(Window.unboundedPreceding, 0)
    out = counts.withColumn("high", F.sum("n").over(upto)).withColumn("size", F.sum("n").over(w))
    return out.withColumn("low", F.col("high") - F.col("n")).drop("n")


def drawn_counts(rows: DataFrame, strata: list[str], cell: list[str], iterations: int, seed: int) -> DataFrame:
    """(iter, strata, cell, n): how often each cell is drawn in each iteration, with a draw for every row of a stratum.

    A draw is a slot from 0 to size - 1 by a hash of seed, stratum, iteration and number. Numbers come in blocks, which are dealt over
    the tasks, and a row of the loop holds a few draws, so that the search for its group is shared.
    """
    runs = intervals_of(rows, strata, cell)
    sizes = runs.groupBy(*strata).agg(F.max("size").alias("size"), F.array_sort(F.collect_list(F.struct("low", "high", *cell))).alias("runs"))
    most = sizes.agg(F.max(F.size("runs"))).first()[0] or 0
    never = 1 << 62
    ends = [F.coalesce(F.try_element_at("runs", F.lit(k + 1))["high"], F.lit(never)).alias(f"_e{k}") for k in range(most - 1)]
    blocks = F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("size") - 1) / BLOCK))
    work = sizes.select(*strata, "size", stratum_number(strata).alias("_s"), *ends)
    work = work.withColumn("iter", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1)))).withColumn("_block", F.explode(blocks))
    # few bytes but much work: by number, so that the rows aren't gathered into few tasks
    work = work.repartition(8 * rows.sparkSession.sparkContext.defaultParallelism, "iter", "_block", *strata)
    work = hashed(work, "_h", (F.col("_s") + F.lit(seed * 7919)).bitwiseAND(BITS))
    work = hashed(work, "_h", (F.col("_h") + F.col("iter")).bitwiseAND(BITS))
    first = F.col("_block") * BLOCK
    work = work.withColumn("_end", F.least(first + BLOCK, F.col("size")))
    drawn = work.withColumn("_slot", F.explode(F.sequence(first, F.col("_end") - 1, F.lit(BESIDE).cast("bigint"))))
    for j in range(BESIDE):
        drawn = hashed(drawn, f"_a{j}", (F.col("_h") + F.col("_slot") + j).bitwiseAND(BITS))
        drawn = hashed(drawn, f"_b{j}", (F.col(f"_a{j}") + 0x5BD1E995).bitwiseAND(BITS))
        # never null, so that no filter on it is moved below the steps, where it would be written out in full; none beyond the end
        pick = F.coalesce((F.shiftleft(f"_a{j}", 31) + F.col(f"_b{j}")) % F.col("size"), F.lit(0))
        drawn = drawn.withColumn(f"_d{j}", F.when(F.col("_slot") + j < F.col("_end"), pick).otherwise(never))
    below = lambda e: sum((F.col(f"_d{j}") < e).cast("int") for j in range(BESIDE))
    # draws below each interval's end; an interval has those below its end but not below the one before
    counts = drawn.groupBy("iter", *strata).agg(*(F.sum(below(F.col(f"_e{k}"))).alias(f"_n{k}") for k in range(most - 1)), F.sum(below(F.lit(never))).alias("_c"))
    upto = [F.lit(0), *(F.col(f"_n{k}") for k in range(most - 1)), F.col("_c")]
    counts = counts.select("iter", *(F.col(s).alias(f"_{s}") for s in strata), F.array(*(b - a for a, b in zip(upto, upto[1:]))).cast("array<bigint>").alias("_ns"))
    met = counts.join(sizes.select(*strata, "runs"), [F.col(s).eqNullSafe(F.col(f"_{s}")) for s in strata])
    cells = met.select("iter", *strata, "_ns", F.posexplode("runs").alias("_k", "_r")).withColumn("n", F.element_at("_ns", F.col("_k") + 1)).where("n > 0")
    return cells.select("iter", *strata, *(F.col(f"_r.{c}").alias(c) for c in cell), "n")


def _accuracy(truth: str, pred: str) -> list[Column]:
    n = F.col("n")
    own = lambda c: F.sum(F.when(F.col(truth) == c, n))
    hit = lambda c: F.coalesce(F.sum(F.when((F.col(truth) == c) & (F.col(pred) == c), n)), F.lit(0))
    balanced = (hit("infection") / own("infection") + hit("tumor") / own("tumor")) / 2
    return [(F.coalesce(F.sum(F.when(F.col(truth) == F.col(pred), n)), F.lit(0)) / F.sum("n")), balanced]


def interval(rows: DataFrame, metrics: list[str], keys: list[str] | None = None, level: float = 0.95) -> DataFrame:
    """metric, mean, low and high over iterations."""
    a = (1 - level) / 2
    long = rows.unpivot([*(keys or [])] or [], metrics, "metric", "value")
    return long.groupBy(*(keys or []), "metric").agg(F.round(F.avg("value"), 9).alias("mean"), F.round(F.percentile("value", F.lit(a)), 9).alias("low"), F.round(F.percentile("value", F.lit(1 - a)), 9).alias("high"))


def bootstrap_single(rows: DataFrame, iterations: int = 200, seed: int = 42, truth: str = "gt_label", pred: str = "pred_selected", stratified: bool = True) -> DataFrame:
    """Intervals of accuracy and balanced accuracy; draws keep each class's size if stratified."""
    base = rows if stratified else rows.withColumn("_all", F.lit("all"))
    strata, cell = ([truth], [pred]) if stratified else (["_all"], [truth, pred])
    n = cell_counts(base, strata, cell, iterations, seed)
    acc, bal = _accuracy(truth, pred)
    return interval(n.groupBy("iter").agg(acc.alias("accuracy"), bal.alias("balanced_accuracy")), ["accuracy", "balanced_accuracy"])


def bootstrap_paired(rows: DataFrame, iterations: int = 200, seed: int = 42, truth: str = "gt_label", a: str = "pred_selected", b: str = "pred_baseline", stratified: bool = True) -> DataFrame:
    """Intervals of the differences a - b over the same draws for both."""
    base = rows if stratified else rows.withColumn("_all", F.lit("all"))
    strata, cell = ([truth], [a, b]) if stratified else (["_all"], [truth, a, b])
    n = drawn_counts(base, strata, cell, iterations, seed)
    (acc_a, bal_a), (acc_b, bal_b) = _accuracy(truth, a), _accuracy(truth, b)
    return interval(n.groupBy("iter").agg((acc_a - acc_b).alias("delta_accuracy"), (bal_a - bal_b).alias("delta_balanced_accuracy")), ["delta_accuracy", "delta_balanced_accuracy"])


def bootstrap_subgroups(rows: DataFrame, group: str, iterations: int = 200, seed: int = 42, truth: str = "gt_label", pred: str = "pred_selected") -> DataFrame:
    """Intervals per subgroup, drawn within subgroup and class."""
    n = drawn_counts(rows, [group, truth], [pred], iterations, seed)
    acc, bal = _accuracy(truth, pred)
    return interval(n.groupBy("iter", group).agg(acc.alias("accuracy"), bal.alias("balanced_accuracy")), ["accuracy", "balanced_accuracy"], [group])


def bootstrap_interaction(rows: DataFrame, group: str, first, second, iterations: int = 200, seed: int = 42, truth: str = "gt_label", a: str = "pred_selected", b: str = "pred_baseline") -> DataFrame:
    """Interval of the difference between two subgroups of the difference in accuracy between two raters."""
    n = cell_counts(rows.where(F.col(group).isin(first, second)), [group, truth], [a, b], iterations, seed)
    d = F.sum(F.when(F.col(truth) == F.col(a), F.col("n")).otherwise(0) - F.when(F.col(truth) == F.col(b), F.col("n")).otherwise(0)) / F.sum("n")
    per = n.groupBy("iter", group).agg(d.alias("d"))
    both = per.groupBy("iter").agg(F.max(F.when(F.col(group) == first, F.col("d"))).alias("x"), F.max(F.when(F.col(group) == second, F.col("d"))).alias("y"))
    return interval(both.select("iter", (F.col("x") - F.col("y")).alias("interaction")), ["interaction"])
