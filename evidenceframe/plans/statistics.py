"""Queries on scores, tests, resampling and cohorts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import cohort, resample, score_bootstrap, scoring
from ..sources.fixtures import read
from .evidence import _short

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
#: As many as the analyses take by default.
ITERATIONS, SUBGROUP_ITERATIONS = 10_000, 2_000


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "fx_score")


CUM = "c as (select *, row_number() over w as pos, sum(y) over w as tp, count(*) over () as n, sum(y) over () as np from fx_score window w as (order by p desc, doc_id rows unbounded preceding))"


@query(f"with {CUM} select 'roc' as curve, pos, round((pos - tp) / greatest(n - np, 1), 9) as x, round(tp / greatest(np, 1), 9) as value from c")
def roc_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.roc_points(_scores(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long")))


@query(f"with {CUM} select 'pr' as curve, pos, round(tp / greatest(np, 1), 9) as x, round(tp / pos, 9) as value from c")
def pr_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.pr_points(_scores(spark, sf_dir)).withColumn("pos", F.col("pos").cast("long")))


@query(f"""with {CUM}, d as (select tp / np as tpr, (pos - tp) / (n - np) as fpr, lag(tp / np, 1, 0) over (order by pos) as tpr0, lag((pos - tp) / (n - np), 1, 0) over (order by pos) as fpr0 from c)
select round(sum((fpr - fpr0) * (tpr + tpr0) / 2), 9) as roc_auc from d""")
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.roc_auc(_scores(spark, sf_dir)))


@query(f"with {CUM} select round(sum(case when y = 1 then tp / pos end) / max(np), 9) as average_precision from c")
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.average_precision(_scores(spark, sf_dir)))


@query("""with c as (select *, least(greatest(p, 1e-6::double), 1 - 1e-6::double) as q from fx_score) select round(avg((p - y) * (p - y)), 9) as brier_score, round(-avg(y * ln(q) + (1 - y) * ln(1 - q)), 9) as log_loss from c""")
def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.brier_log_loss(_scores(spark, sf_dir)))


_BINS = """b as (select *, ntile(10) over (order by p, doc_id) as bin from fx_score),
g as (select bin, count(*) as n, avg(p) as mean_predicted, avg(y) as observed from b group by bin)"""


@query(f"with {_BINS.replace('order by p, doc_id', 'order by p, doc_id')} select bin::int as bin, n, round(mean_predicted, 9) as mean_predicted, round(observed, 9) as observed, round(abs(observed - mean_predicted), 9) as error from g")
def ece_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.calibration_bins(_scores(spark, sf_dir)))


@query(f"with {_BINS} select round(sum(n * abs(observed - mean_predicted)) / sum(n), 9) as ece from g")
def expected_calibration_error(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.expected_calibration_error(scoring.calibration_bins(_scores(spark, sf_dir))))


@query("""with g as (select count(*) filter (y = 1 and p >= 0.5) as tp, count(*) filter (y = 1 and p < 0.5) as fn, count(*) filter (y = 0 and p < 0.5) as tn, count(*) filter (y = 0 and p >= 0.5) as fp from fx_score)
select tp, fn, tn, fp, round(tp / greatest(tp + fn, 1), 9) as sensitivity, round(tn / greatest(tn + fp, 1), 9) as specificity, round((tp + tn) / (tp + fn + tn + fp), 9) as accuracy,
  round((tp / greatest(tp + fn, 1) + tn / greatest(tn + fp, 1)) / 2, 9) as balanced_accuracy from g""")
def threshold_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.threshold_metrics(_scores(spark, sf_dir)))


@query("""with recursive c as (select ln(q / (1 - q)) as x, y::double as y, count(*)::double as n from (select (doc_id * 7919 % 97 < 20 + 60 * p)::int as y, least(greatest(p, 1e-6::double), 1 - 1e-6::double) as q from fx_score) group by all),
f(step, a, b, moved) as (select 0, 0.0::double, 1.0::double, 1.0::double union all
  select step + 1, a + da, b + db, greatest(abs(da), abs(db)) from (select step, a, b, (s4 * s0 - s3 * s1) / (s2 * s4 - s3 * s3) as da, (s2 * s1 - s3 * s0) / (s2 * s4 - s3 * s3) as db from (
    select step, a, b, sum(g) as s0, sum(g * x) as s1, sum(w) as s2, sum(w * x) as s3, sum(w * x * x) as s4 from (
      select step, a, b, x, (y - h) * n as g, greatest(h * (1 - h), 1e-6::double) * n as w from (select step, a, b, x, y, n, 1 / (1 + exp(-least(greatest(a + b * x, -30), 30))) as h from f, c where step < 100 and moved >= 1e-8)) group by step, a, b)))
select case when greatest(abs(a), abs(b)) <= 20 then round(a, 6) end as intercept, case when greatest(abs(a), abs(b)) <= 20 then round(b, 6) end as slope from f order by step desc limit 1""")
def calibration_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    y = (F.col("doc_id") * 7919 % 97 < 20 + 60 * F.col("p")).cast("long")
    return scoring.calibration_fit(_scores(spark, sf_dir).withColumn("y", y))


@query("select y, round(quantile_cont(p, 0.025), 9) as low, round(quantile_cont(p, 0.5), 9) as mid, round(quantile_cont(p, 0.975), 9) as high from fx_score group by y")
def percentile_ci(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(scoring.percentiles(_scores(spark, sf_dir), "p", {"low": 0.025, "mid": 0.5, "high": 0.975}, ["y"]))


@query("""select seq, round(avg(case when a + b > 0 then a / (a + b) else 0.5::double end), 9) as mean_share from (select seq, vote_score_infection as a, vote_score_tumor as b from fx_slice) group by seq""")
def positive_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_slice").select("seq", scoring.positive_share("vote_score_infection", "vote_score_tumor").alias("s"))
    return _short(rows.groupBy("seq").agg(F.avg("s").alias("mean_share")))


_DISC = """select fold, count(*) as n, count(*) filter (gt_label = pred_selected and gt_label = pred_baseline) as both_correct, count(*) filter (gt_label = pred_selected and gt_label <> pred_baseline) as a_only_correct,
  count(*) filter (gt_label <> pred_selected and gt_label = pred_baseline) as b_only_correct, count(*) filter (gt_label <> pred_selected and gt_label <> pred_baseline) as both_wrong, count(*) filter (pred_selected <> pred_baseline) as label_changes
  from fx_patient group by fold"""


@query(_DISC)
def discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scoring.discordance(read(spark, sf_dir, "fx_patient"), keys=["fold"])


@query(f"""with d as ({_DISC}), s as (select fold, a_only_correct as b, b_only_correct as c, unnest(range(least(a_only_correct, b_only_correct) + 1)) as i from d),
t as (select fold, b, c, sum(exp(lgamma(b + c + 1) - lgamma(i + 1) - lgamma(b + c - i + 1) - (b + c) * ln(2))) as tail from s group by all) select fold, b, c, round(least(1.0::double, 2 * tail), 9) as p from t""")
def mcnemar_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = scoring.discordance(read(spark, sf_dir, "fx_patient"), keys=["fold"]).select("fold", F.col("a_only_correct").alias("b"), F.col("b_only_correct").alias("c"))
    return _short(d.withColumn("p", scoring.mcnemar_p(F.col("b"), F.col("c"))))


def _hash_sql(rows: str, name: str, value: str) -> str:
    """rows with a hash of a number below 2 ** 31, in the operator's steps."""
    for step in (value, f"(xor({name}, {name} >> 15) * {resample.FIRST}) & {resample.BITS}", f"(xor({name}, {name} >> 14) * {resample.SECOND}) & {resample.BITS}", f"xor({name}, {name} >> 15)"):
        kept = "*" if step == value else f"* exclude ({name})"
        rows = f"(select {kept}, {step} as {name} from {rows})"
    return rows


def _sampled_sql(rows: str, name: str, iterations: int, seed: int = 42) -> str:
    """m(iter, times, columns of rows): rows(y, slot, size, ...) drawn Poisson times, by a hash of row and iteration, and single draws up to the size of each class."""
    bits = resample.BITS
    base = _hash_sql(f"(select distinct y, size from {rows})", "hs", f"(('0x' || substr(md5({name}), 1, 7))::bigint + {seed * 7919}) & {bits}")
    of_iter = _hash_sql(f"(select b.*, i.i as iter from {base} b, (select unnest(range({iterations}))::bigint as i) i)", "hi", f"(hs + iter) & {bits}")
    drawn = _hash_sql("(select hi.*, o.slot from hi join o on hi.y = o.y)", "ha", f"(hi + slot) & {bits}")
    single = _hash_sql(_hash_sql("e", "hb", f"(hi + {score_bootstrap.APART} + j) & {bits}"), "hc", f"(hb + {0x5BD1E995}) & {bits}")
    return f"""hi as materialized (select * from {of_iter}),
mean as (select y, greatest(0.0::double, 1 - {score_bootstrap.BELOW}::double / sqrt(size)) as mean from (select distinct y, size from {rows})),
th as (select y, list(ceil(cdf * {1 << 31})::bigint order by k) as ts from (select y, k, sum(case when mean > 0 then exp(-mean + k * ln(greatest(mean, 1e-300::double)) - lgamma(k + 1.0::double)) when k = 0 then 1.0::double else 0 end) over (partition by y order by k rows unbounded preceding) as cdf
  from mean, (select unnest(range({score_bootstrap.TIMES})) as k)) group by y),
x as materialized (select d.iter, d.y, d.slot, list_sum(list_transform(ts, lambda t: (ha >= t)::int))::bigint as times from {drawn} d join th on d.y = th.y),
e as (select hi.*, unnest(range(size - total)) as j from hi join (select iter, y, sum(times)::bigint as total from x group by all) s on hi.iter = s.iter and hi.y = s.y),
t as (select iter, y, slot, sum(times)::bigint as times from (select iter, y, slot, times from x where times > 0 union all select iter, y, (hb * {1 << 31} + hc) % size, 1 from {single}) group by all),
m as (select t.iter, t.times, o.* from t join o on t.y = o.y and t.slot = o.slot)"""


def _stirling_sql(k: str) -> str:
    near = ", ".join(repr(v) for v in resample.STIRLING)
    return f"case when {k} < 10 then list_extract([{near}], ({k})::int + 1) else (1.0::double / 12 - (1.0::double / 360 - 1.0::double / 1260 / (({k} + 1) ** 2)) / (({k} + 1) ** 2)) / ({k} + 1) end"


def _binomial_sql(rows: str, key: str) -> str:
    """rows(id, n, p) with x, a binomial number: inversion below a mean of ten, else transformed rejection; key is the text that a proposal's number t is put after."""
    number = lambda k: f"((('0x' || substr(h, {k}, 13))::bigint + 0.5::double) / {1 << 52})"
    return f"""(select id, any_value(n) as n, case when any_value(p) > 0.5 then any_value(n) - any_value(y) else any_value(y) end as x from (
  select id, any_value(n) as n, any_value(p) as p, case when any_value(n) <= 0 or any_value(q) <= 0 then 0 when any_value(small) then count(*) filter (t < least(n_, {resample.TERMS}) and cdf < u0)
    else coalesce(arg_min(k, t) filter (ok), any_value(m)) end::bigint as y from (
    select *, coalesce((us >= 0.07 and v <= vr) or (k >= 0 and k <= n and ln(v * alpha / (a / (us * us) + b)) <= top + (n + 1) * ln((n - m + 1)::double / (n - k + 1)) + (k + 0.5) * ln(r * (n - k + 1) / (k + 1)) - ({_stirling_sql('k')}) - ({_stirling_sql('(n - k)')})), false) and not small as ok,
      sum(case when small and t <= n then exp(lgamma(n + 1.0::double) - lgamma(t + 1.0::double) - lgamma(greatest(n - t, 0) + 1.0::double) + t * ln(greatest(q, 1e-300::double)) + (n - t) * ln(1 - q)) end) over (partition by id order by t rows unbounded preceding) as cdf, first(u) over (partition by id order by t) as u0, n as n_ from (
      select *, floor((2 * a / us + b) * (u - 0.5) + n * q + 0.5)::bigint as k from (
        select *, 0.5 - abs(u - 0.5) as us from (select *, {number(1)} as u, {number(14)} as v from (
          select *, md5({key} || '|' || t) as h, 0.92 - 4.2 / b as vr, (2.83 + 5.1 / b) * s as alpha, (m + 0.5) * ln((m + 1) / (r * (n - m + 1))) + ({_stirling_sql('m')}) + ({_stirling_sql('(n - m)')}) as top from (
            select *, -0.0873 + 0.0248 * b + 0.01 * q as a, unnest(range(case when small then {resample.TERMS} else {resample.TRIES} end)) as t from (
              select *, 1.15 + 2.53 * s as b from (select *, sqrt(n * q * (1 - q)) as s, floor((n + 1) * q)::bigint as m, q / (1 - q) as r, n * q < {resample.MEAN} as small from (select *, least(p, 1 - p) as q from {rows})))))))))
  group by id, n_) group by id)"""


def _draw_sql(strata: str, cell: str, name: str, iterations: int, most: int = 12, seed: int = 42) -> str:
    """Counts m(iter, strata, cell, times) of each cell and iteration: one cell after the other is binomial among what is left."""
    keys, cells = strata.split(", "), cell.split(", ")
    on = lambda t: " and ".join(f"{t}.{c} = g.{c}" for c in keys)
    parts = [f"""r as (select *, 'all' as every from fx_patient), c as (select {strata}, {cell}, count(*) as size, row_number() over (partition by {strata} order by {cell}) - 1 as place from r group by {strata}, {cell}),
g as (select {strata}, sum(size)::bigint as size, ('0x' || substr(md5({name}), 1, 7))::bigint as code from c group by {strata}),
s0 as (select i.i as iter, {', '.join(f'g.{c}' for c in keys)}, g.code, g.size as rest, g.size as mass from g, (select unnest(range({iterations}))::bigint as i) i)"""]
    for k in range(most):
        rows = f"(select struct_pack({', '.join(f'{c} := g.{c}' for c in keys)}, iter := g.iter, code := g.code, mass := g.mass, cut := c.size) as id, g.rest as n, c.size / g.mass::double as p from s{k} g join c on {on('c')} and c.place = {k})"
        key = f"'{seed}|' || id.code || '|' || id.iter || '|{k}'"
        parts.append(f"x{k} as (select id, n, x from {_binomial_sql(rows, key)})")
        parts.append(f"s{k + 1} as (select id.iter as iter, {', '.join(f'id.{c} as {c}' for c in keys)}, id.code as code, n - x as rest, id.mass - id.cut as mass from x{k})")
    taken = " union all ".join(f"select id.iter as iter, {', '.join(f'id.{c} as {c}' for c in keys)}, {k} as place, x as times from x{k}" for k in range(most))
    named = ", ".join([*(f"g.{c}" for c in keys), *(f"c.{c}" for c in cells)])
    parts.append(f"t as ({taken}), m as (select g.iter, g.times, {named} from t g join c on {on('c')} and c.place = g.place where g.times > 0)")
    return ",\n".join(parts)


def _pick_sql(name: str, rows: str, iterations: int, seed: int = 42) -> str:
    """rows(slot, size, ...) with iter and pick: one draw for each slot and iteration."""
    bits = resample.BITS
    out = _hash_sql(f"(select * from {rows})", "hs", f"(('0x' || substr(md5({name}), 1, 7))::bigint + {seed * 7919}) & {bits}")
    out = _hash_sql(f"(select o.*, i.i as iter from {out} o, (select unnest(range({iterations}))::bigint as i) i)", "hi", f"(hs + iter) & {bits}")
    out = _hash_sql(_hash_sql(out, "ha", f"(hi + slot) & {bits}"), "hb", f"(ha + {0x5BD1E995}) & {bits}")
    return f"(select *, (ha * {1 << 31} + hb) % size as pick from {out})"


def _rows_sql(strata: str, cell: str, name: str, iterations: int) -> str:
    """Draws as the operator makes them: a stratum's rows sorted by cell, a slot for each."""
    keys = strata.split(", ")
    return f"""r as (select *, 'all' as every from fx_patient), o as (select *, row_number() over (partition by {strata} order by {cell}) - 1 as slot, count(*) over (partition by {strata}) as size from r),
d as (select iter, {strata}, pick, count(*) as times from {_pick_sql(name, 'o', iterations)} group by all),
m as (select d.iter, d.times, x.* from d join o x on {' and '.join(f'd.{c} = x.{c}' for c in keys)} and x.slot = d.pick)"""


_SPREAD = "round(avg(value), 9) as mean, round(quantile_cont(value, 0.025), 9) as low, round(quantile_cont(value, 0.975), 9) as high"


def _share(truth: str, pred: str) -> str:
    return f"sum(case when gt_label = '{truth}' and {pred} = '{truth}' then times else 0 end) / sum(case when gt_label = '{truth}' then times end)"


def _hits(pred: str) -> str:
    return f"sum(case when gt_label = {pred} then times else 0 end) / sum(times)"


def _balance(pred: str) -> str:
    return f"({_share('infection', pred)} + {_share('tumor', pred)}) / 2"


def _metric(c: str, per: str = "iter") -> str:
    return f"a as (select {per}, {_hits(c)} as acc, {_balance(c)} as bal from m group by {per})"


@query(f"""with {_draw_sql('gt_label', 'pred_selected', 'gt_label', ITERATIONS)}, {_metric('pred_selected')}, l as (select 'accuracy' as metric, acc as value from a union all select 'balanced_accuracy', bal from a)
select metric, {_SPREAD} from l group by metric""")
def bootstrap_single(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_single(read(spark, sf_dir, "fx_patient"), ITERATIONS)


_DELTA = f"""a as (select iter, {_hits('pred_selected')} - {_hits('pred_baseline')} as acc, {_balance('pred_selected')} - {_balance('pred_baseline')} as bal from m group by iter),
l as (select 'delta_accuracy' as metric, acc as value from a union all select 'delta_balanced_accuracy', bal from a)"""


@query(f"with {_rows_sql('gt_label', 'pred_selected, pred_baseline', 'gt_label', ITERATIONS)}, {_DELTA} select metric, {_SPREAD} from l group by metric")
def bootstrap_paired(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_paired(read(spark, sf_dir, "fx_patient"), ITERATIONS)


@query(f"with {_rows_sql('every', 'gt_label, pred_selected, pred_baseline', 'every', ITERATIONS)}, {_DELTA} select metric, {_SPREAD} from l group by metric")
def bootstrap_unstratified(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_paired(read(spark, sf_dir, "fx_patient"), ITERATIONS, stratified=False)


@query(f"""with {_rows_sql('fold, gt_label', 'pred_selected', "fold || '|' || gt_label", SUBGROUP_ITERATIONS)}, {_metric('pred_selected', 'iter, fold')}, l as (select fold, 'accuracy' as metric, acc as value from a union all select fold, 'balanced_accuracy', bal from a)
select fold, metric, {_SPREAD} from l group by fold, metric""")
def bootstrap_subgroups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_subgroups(read(spark, sf_dir, "fx_patient"), "fold", SUBGROUP_ITERATIONS)


@query(f"""with {_draw_sql('fold, gt_label', 'pred_selected, pred_baseline', "fold || '|' || gt_label", SUBGROUP_ITERATIONS)}, a as (select iter, fold, {_hits('pred_selected')} - {_hits('pred_baseline')} as d from m where fold in (0, 1) group by all),
l as (select 'interaction' as metric, max(d) filter (fold = 0) - max(d) filter (fold = 1) as value from a group by iter) select metric, {_SPREAD} from l group by metric""")
def bootstrap_interaction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample.bootstrap_interaction(read(spark, sf_dir, "fx_patient"), "fold", 0, 1, SUBGROUP_ITERATIONS)


_ORDER = "order by md5('42|' || patient_id), patient_id"


@query(f"""with r as (select patient_id, gt_label, row_number() over (partition by gt_label {_ORDER}) as r, count(*) over (partition by gt_label) as n from fx_patient)
select patient_id, gt_label, case when r <= greatest(1, round_even(n * 0.2::double, 0)) then 'val' else 'train' end as split from r""")
def stratified_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.stratified_split(read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label"), 0.2)


@query(f"select patient_id, gt_label, ((row_number() over (partition by gt_label {_ORDER}) - 1) % 5)::int as fold from fx_patient")
def outer_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.outer_folds(read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label"), 5)


@query("""with a as (select fold, gt_label, count(*) as n from fx_patient group by all), q as (select *, 20 * n / sum(n) over (partition by fold) as raw from a),
w as (select *, floor(raw)::bigint as whole, 20 - sum(floor(raw)) over (partition by fold) as rest, row_number() over (partition by fold order by raw - floor(raw) desc, n desc, gt_label desc) as place from q)
select fold, gt_label, n, (whole + case when place <= rest then 1 else 0 end)::bigint as quota from w""")
def quota_allocation(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = read(spark, sf_dir, "fx_patient").groupBy("fold", "gt_label").agg(F.count(F.lit(1)).alias("n"))
    return cohort.quotas(n, 20, ["fold"])


@query(f"""with f as (select patient_id, gt_label, (row_number() over (partition by gt_label {_ORDER}) - 1) % 5 as own from fx_patient), p as (select f.*, k.fold from f, (select unnest(range(5)) as fold) k),
d as (select *, row_number() over (partition by fold, gt_label order by md5('43|' || patient_id), patient_id) as r, count(*) over (partition by fold, gt_label) as n, count(*) over (partition by fold) as t from p where fold <> own),
c as (select distinct fold, gt_label, n, t from d), q as (select *, floor(60 * n / t) as whole, 60 * n / t - floor(60 * n / t) as part from c),
a as (select *, whole + case when row_number() over (partition by fold order by part desc, n desc, gt_label desc) <= 60 - sum(whole) over (partition by fold) then 1 else 0 end as quota from q),
l as (select d.fold, d.patient_id, d.gt_label from d join a using (fold, gt_label) where d.r <= a.quota),
e as (select *, row_number() over (partition by fold, gt_label order by md5('44|' || patient_id), patient_id) as r, count(*) over (partition by fold, gt_label) as n, count(*) over (partition by fold) as t from l),
c2 as (select distinct fold, gt_label, n, t from e), q2 as (select *, floor(30 * n / t) as whole, 30 * n / t - floor(30 * n / t) as part from c2),
a2 as (select *, whole + case when row_number() over (partition by fold order by part desc, n desc, gt_label desc) <= 30 - sum(whole) over (partition by fold) then 1 else 0 end as quota from q2),
s as (select e.fold, e.patient_id from e join a2 using (fold, gt_label) where e.r <= a2.quota)
select p.fold::int as fold, p.patient_id, p.gt_label, case when p.fold = p.own then 'outer_test' when l.patient_id is not null then 'adapt' else 'inner_val' end as role, s.patient_id is not null as in_small, l.patient_id is not null as in_large
from p left join l on p.fold = l.fold and p.patient_id = l.patient_id left join s on p.fold = s.fold and p.patient_id = s.patient_id""")
def nested_protocol(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.nested_protocol(read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label"), 5, 30, 60)


@query("""with o as (select patient_id, gt_label, row_number() over (partition by gt_label order by md5('0|' || patient_id), patient_id) - 1 as slot, count(*) over (partition by gt_label) as n from fx_patient), z as (select gt_label, max(n) as n, max(max(n)) over () as most from o group by gt_label),
x as (select gt_label, n, unnest(range(1, most - n + 1)) as i from z where most > n), e as (select gt_label, ('0x' || substr(md5('42|' || gt_label || '|' || i), 1, 8))::bigint % n as slot, count(*) as times from x group by all),
m as (select o.patient_id, o.gt_label, coalesce(times, 0) as times from o left join e using (gt_label, slot)) select patient_id, gt_label, unnest(range(times + 1)) as copy from m""")
def oversample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cohort.oversample(read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label"), "patient_id", "gt_label")


@query("""select patient_id, 0 as copy, 'internal' as source_dataset from fx_patient where fold <> 0 union all
select patient_id, c.copy, 'external' from (select patient_id from fx_patient where fold = 0), (select unnest(range(3))::int as copy) c""")
def mix_repeat(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient").select("patient_id", "fold")
    return cohort.mix_repeated(p.where("fold <> 0").select("patient_id"), p.where("fold = 0").select("patient_id"), 3)


_SCORED = "s as (select doc_id, y, p, p_baseline from fx_score)"
_METRICS = ("roc_auc", "average_precision", "brier_score", "log_loss", "ece", "accuracy", "balanced_accuracy", "sensitivity", "specificity")


def _score_sql(p: str) -> str:
    """Every metric of each iteration, from the draws m(iter, y, p, times)."""
    return f"""(select iter, auc / (np * nn) as roc_auc, ap / np as average_precision, brier / (np + nn) as brier_score, -loss / (np + nn) as log_loss, ece, (tp + tn) / (np + nn) as accuracy, (tp / greatest(np, 1) + tn / greatest(nn, 1)) / 2 as balanced_accuracy, tp / greatest(np, 1) as sensitivity, tn / greatest(nn, 1) as specificity
  from (select iter, sum(case when y = 0 then n * (tb) else 0 end) as auc, sum(case when y = 1 then list_sum(list_transform(range(1, n + 1), lambda i: (tb + i) / (tb + i + fb))) else 0 end) as ap, sum(n * (v - y) * (v - y)) as brier,
      sum(n * (y * ln(q) + (1 - y) * ln(1 - q))) as loss, sum(case when y = 1 then n else 0 end) as np, sum(case when y = 0 then n else 0 end) as nn, sum(case when y = 1 and v >= 0.5 then n else 0 end) as tp, sum(case when y = 0 and v < 0.5 then n else 0 end) as tn
    from (select *, least(greatest(v, 1e-6::double), 1 - 1e-6::double) as q, coalesce(sum(case when y = 1 then n else 0 end) over w, 0) as tb, coalesce(sum(case when y = 0 then n else 0 end) over w, 0) as fb
      from (select iter, y, {p} as v, sum(times)::bigint as n from m group by all) window w as (partition by iter order by v desc, y desc rows between unbounded preceding and 1 preceding)) group by iter) a
  join (select iter, sum(abs(sy - sp)) / max(total) as ece from (select iter, bin, max(total) as total, sum(k * v) as sp, sum(k * y) as sy from (
      select *, case when b < rest then greatest(0, least(stop, (b + 1) * (size + 1)) - greatest(start, b * (size + 1))) else greatest(0, least(stop, rest * (size + 1) + (b - rest + 1) * size) - greatest(start, rest * (size + 1) + (b - rest) * size)) end as k, b as bin
      from (select *, unnest(range(10)) as b, total // 10 as size, total % 10 as rest from (select iter, y, v, n, sum(n) over (partition by iter order by v, y desc rows unbounded preceding) as stop, sum(n) over (partition by iter order by v, y desc rows unbounded preceding) - n as start, sum(n) over (partition by iter) as total
        from (select iter, y, {p} as v, sum(times)::bigint as n from m group by all)))) where k > 0 group by iter, bin) group by iter) e using (iter))"""


@query(f"""with {_SCORED}, o as (select *, row_number() over (partition by y order by md5('0|' || doc_id), doc_id) - 1 as slot, count(*) over (partition by y) as size from s),
{_sampled_sql('o', "y || ''", ITERATIONS)},
sx as {_score_sql('p')}, sz as {_score_sql('p_baseline')}, l as (select * from ({' union all '.join(f"select 'selected' as model, '{n}' as metric, {n} as value from sx union all select 'baseline', '{n}', {n} from sz union all select 'delta', '{n}', sx.{n} - sz.{n} from sx join sz using (iter)" for n in _METRICS)}))
select model, metric, {_SPREAD} from l group by model, metric""")
def bootstrap_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of every score metric of two models and of their differences, over the same draws."""
    return _short(score_bootstrap.bootstrap_scores(_scores(spark, sf_dir), ("selected", "p"), ("baseline", "p_baseline"), ITERATIONS))
