import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from evidenceframe.operators import resample, score_bootstrap


@pytest.mark.parametrize(("n", "p"), [(1, 0.3), (30, 0.5), (400, 0.02), (400, 0.98), (1000, 0.35), (90, 0.9)])
def test_binomial_numbers_have_their_distribution(spark, n, p):
    draws = 12_000
    rows = spark.range(draws).select(F.lit(n).cast("bigint").alias("n"), F.lit(p).alias("p"), "id")
    x = np.array([r.x for r in rows.select(F.expr(resample.binomial("n", "p", "concat('5|', id)")).alias("x")).collect()])
    k = np.arange(n + 1)
    pmf = np.exp([math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log(1 - p) for i in k])
    often = pmf * draws > 8
    seen = np.bincount(x, minlength=n + 1)
    chi = ((seen[often] - pmf[often] * draws) ** 2 / (pmf[often] * draws)).sum()
    free = max(1, often.sum() - 1)
    assert x.min() >= 0 and x.max() <= n and chi < free + 5 * math.sqrt(2 * free)


def test_binomial_of_nothing_and_of_certainty(spark):
    rows = spark.createDataFrame([(0, 0.5), (7, 0.0), (7, 1.0), (10**12, 0.5)], "n long, p double")
    x = [r.x for r in rows.select(F.expr(resample.binomial("n", "p", "'k'")).alias("x")).collect()]
    assert x[:3] == [0, 0, 7] and abs(x[3] - 5e11) < 6 * 5e5


def test_counts_of_cells_are_multinomial(spark):
    cells = {("a", "x"): 60, ("a", "y"): 40, ("a", None): 25, ("b", "x"): 3, ("c", "y"): 1}
    rows = spark.createDataFrame([k for k, n in cells.items() for _ in range(n)], "s string, c string")
    got = resample.cell_counts(rows, ["s"], ["c"], 3000, 1).collect()
    total = {}
    for r in got:
        total.setdefault((r.iter, r.s), 0)
        total[r.iter, r.s] += r.n
    assert set(total.values()) == {125, 3, 1} and len(total) == 9000
    by = {(r.s, r.c, r.iter): r.n for r in got}
    of = lambda c: np.array([by.get((*c, i), 0) for i in range(3000)])
    x, y, z = of(("a", "x")), of(("a", "y")), of(("a", None))
    for v, n in ((x, 60), (y, 40), (z, 25)):
        assert abs(v.mean() - n) < 0.5 and abs(v.std() / math.sqrt(n * (1 - n / 125)) - 1) < 0.08
    assert abs(np.corrcoef(x, y)[0, 1] + math.sqrt(60 * 40 / (65 * 85))) < 0.08


def brute(y, v, times):
    """Every metric of a sample, row by row: positives come first among equal scores."""
    order = sorted(range(len(y)), key=lambda i: (-v[i], y[i] != 1))
    sample = [(y[i], v[i]) for i in order for _ in range(times[i])]
    pos, neg = sum(a for a, _ in sample), sum(1 - a for a, _ in sample)
    auc = ap = tp = fp = 0.0
    for a, _ in sample:
        tp, fp = tp + a, fp + (1 - a)
        auc += (1 - a) * tp
        ap += a * tp / (tp + fp)
    q = [min(max(p, 1e-6), 1 - 1e-6) for _, p in sample]
    rising = sorted(sample, key=lambda s: (s[1], s[0] != 1))
    ece = sum(abs(sum(a - p for a, p in g)) for g in (np.array_split(np.array(rising), 10))) / len(sample)
    right = [(a == 1) == (p >= 0.5) for a, p in sample]
    sens, spec = (sum(r for r, (a, _) in zip(right, sample) if a == c) / max(n, 1) for c, n in ((1, pos), (0, neg)))
    n = len(sample)
    loss = -sum(a * math.log(c) + (1 - a) * math.log(1 - c) for (a, _), c in zip(sample, q)) / n
    return [auc / (pos * neg), ap / pos, sum((p - a) ** 2 for a, p in sample) / n, loss, ece, sum(right) / n, (sens + spec) / 2, sens, spec]


def scored(seed, n, ties):
    draw = np.random.default_rng(seed)
    y = (draw.random(n) < 0.4).astype(int)
    p = np.round(draw.random(n), 1) if ties else draw.random(n)
    return [(i, int(y[i]), float(p[i]), float(np.round(1 - draw.random() * y[i], 2))) for i in range(n)]


@pytest.mark.parametrize(("n", "ties", "block"), [(90, True, 8), (90, False, 20), (300, True, 64), (12, True, None)])
def test_score_metrics_of_drawn_samples(spark, n, ties, block):
    rows, iterations, seed = scored(n, n, ties), 6, 3
    df = spark.createDataFrame(rows, "doc_id long, y long, p double, b double").repartition(3)
    got = {(r.model, r.iter): list(r)[2:] for r in score_bootstrap.draw_metrics(df, {"one": "p", "two": "b"}, iterations, seed, block=block).collect()}
    assert len(got) == 2 * iterations
    # the draws, found again from the definition
    place = {r.doc_id: r.slot - 1 for r in score_bootstrap.ranked_by_hash(df, ["y"], 0, "doc_id", "slot", "size").collect()}
    sizes = [{"y": c, "size": sum(r[1] == c for r in rows), "_s": spark.createDataFrame([(c,)], "y long").select(resample.stratum_number(["y"])).first()[0]} for c in (0, 1)]
    strata = score_bootstrap.Strata(sizes, seed)
    y, slot = np.array([r[1] for r in rows]), np.array([place[r[0]] for r in rows])
    x = strata.counts(y, slot, 0, iterations)
    for c in (0, 1):
        size = strata.size[c]
        for k in range(iterations):
            missing = size - x[y == c][:, k].sum()
            assert missing >= 0
            hi = int(score_bootstrap.mixed(np.int64((strata.start[c] + k) & resample.BITS)))
            for j in range(missing):
                a = int(score_bootstrap.mixed(np.int64((hi + score_bootstrap.APART + j) & resample.BITS)))
                b = int(score_bootstrap.mixed(np.int64((a + 0x5BD1E995) & resample.BITS)))
                x[(y == c) & (slot == ((a << 31) + b) % size), k] += 1
    assert (x.sum(axis=0) == len(rows)).all()
    for model, column in (("one", 2), ("two", 3)):
        for k in range(iterations):
            assert np.allclose(got[model, k], brute(y.tolist(), [r[column] for r in rows], x[:, k].tolist()), atol=1e-12), (model, k)


def test_score_draws_are_uniform(spark):
    strata = score_bootstrap.Strata([{"y": 1, "size": 400, "_s": 77}], 42)
    x = strata.counts(np.ones(400, int), np.arange(400), 0, 4000)
    mean = 1 - score_bootstrap.BELOW / 20
    assert abs(x.mean() - mean) < 0.005 and abs(x.var() - mean) < 0.01 and abs(x.mean(axis=1).std() - math.sqrt(mean / 4000)) < 0.003
    assert x.sum(axis=0).max() <= 400


def test_score_metrics_of_one_class_and_of_nothing(spark):
    df = spark.createDataFrame([(i, 1, 0.5, 0.25) for i in range(5)] + [(9, None, 0.5, 0.5), (10, 0, None, 0.5)], "doc_id long, y long, p double, b double")
    rows = score_bootstrap.draw_metrics(df, {"one": "p", "two": "b"}, 3).collect()
    assert len(rows) == 6 and all(r.roc_auc is None and r.average_precision == 1 and abs(r.brier_score - (0.25 if r.model == "one" else 0.5625)) < 1e-12 for r in rows)
    assert score_bootstrap.draw_metrics(df.where("false"), {"one": "p", "two": "b"}, 3).count() == 0
