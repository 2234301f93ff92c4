"""Queries on voting, fusion and outcome metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.coerce import flag, safe_div, safe_float, safe_int
from ..operators import aggregate, fuse, metrics, ranking, reshape
from ..sources.fixtures import read

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


V = """v as (
  select *, case when vote_score_infection <= 0 and vote_score_tumor <= 0 and pred_label = 'infection' then 1.0::double else vote_score_infection end as vi,
    case when vote_score_infection <= 0 and vote_score_tumor <= 0 and pred_label = 'tumor' then 1.0::double else vote_score_tumor end as vt,
    (case final_candidate_source when 'filtered_components' then 1.0 when 'adjacent_slice_fallback' then 0.8 when '' then 0.5 else 0.7 end)::double
      * (case when pred_mask_empty then 0.5 else 1.0 end)::double * least(greatest(valid_component_votes::double, 1.0), 3.0)::double / 3.0::double / (1.0::double + candidate_slice_distance) as rest
  from fx_slice)"""
TAIL = """min_by(gt_label, sample_id) as gt_label, count(*) as num_slices, count(*) filter (pred_label in ('infection', 'tumor')) as num_candidate_slices,
    count(*) filter (pred_label = 'no_candidate') as num_no_candidate_slices,
    '{' || array_to_string(list_filter([
      case when count(*) filter (pred_label = 'infection') > 0 then '"infection":' || count(*) filter (pred_label = 'infection') end,
      case when count(*) filter (pred_label = 'no_candidate') > 0 then '"no_candidate":' || count(*) filter (pred_label = 'no_candidate') end,
      case when count(*) filter (pred_label = 'tumor') > 0 then '"tumor":' || count(*) filter (pred_label = 'tumor') end,
      case when count(*) filter (pred_label = 'uncertain') > 0 then '"uncertain":' || count(*) filter (pred_label = 'uncertain') end], lambda x: x is not null), ',') || '}' as slice_pred_counts"""


def _vote_sql(keys: str, a: str, b: str, whole: str) -> str:
    return f"""
with {V}, q as (select *, case when max(candidate_slice_area) over (partition by {keys}) > 0
    then ln(1 + candidate_slice_area::double) / ln(1 + max(candidate_slice_area) over (partition by {keys})::double) else 1.0::double end * rest as quality from v),
g as (select {keys}, {TAIL}, round(({a})::double, 9) as a, round(({b})::double, 9) as b from q group by {keys})
select {keys}, gt_label, pred_label, cast(gt_label = pred_label as int) as is_correct,
  round(case when {whole} = 0 then 0.0::double else greatest(a, b) / {whole} end, 9) as confidence,
  num_slices, num_candidate_slices, num_no_candidate_slices, round(a, 9) as score_infection, round(b, 9) as score_tumor, slice_pred_counts
from (select *, case when a = 0 and b = 0 then case when num_no_candidate_slices > 0 then 'no_candidate' else 'uncertain' end
  when a > b then 'infection' when b > a then 'tumor' else 'uncertain' end as pred_label from g)
"""


def _short(rows: DataFrame) -> DataFrame:
    """Doubles to nine places."""
    return rows.withColumns({n: F.round(n, 9) + F.lit(0.0) for n, t in rows.dtypes if t == "double"})


def _votes(keys: list[str], strategy: str):
    return lambda spark, sf_dir: _short(aggregate.aggregate_slices(read(spark, sf_dir, "fx_slice"), keys, strategy))


SUMS = {
    "majority_vote": ("count(*) filter (pred_label = 'infection')", "count(*) filter (pred_label = 'tumor')", "(a + b + num_no_candidate_slices)"),
    "score_weighted": ("sum(vi)", "sum(vt)", "(a + b)"),
    "quality_weighted": ("sum(vi * quality)", "sum(vt * quality)", "(a + b)"),
}
for _name, _sums in SUMS.items():
    for _level, _keys in (("patient", ["patient_id"]), ("sequence", ["patient_id", "seq"])):
        QUERIES[f"{_name}_{_level}"] = _votes(_keys, _name if _name == "majority_vote" else _name + "_vote")
        ORACLES[f"{_name}_{_level}"] = _vote_sql(", ".join(_keys), *_sums)


@query(f"""
with {V}, q as (select *, max(candidate_slice_area) over (partition by patient_id) as most from v),
s as (select *, case when most > 0 then ln(1 + candidate_slice_area::double) / ln(1 + most::double) else 1.0::double end * rest * greatest(vi, vt, 1.0::double) as strength from q),
r as (select *, row_number() over (partition by patient_id order by round(strength * case when most > 0 then ln(1 + most::double) else 1 end, 9) desc, sample_id) as place from s),
g as (select patient_id, {TAIL} from fx_slice group by patient_id)
select patient_id, g.gt_label, r.pred_label, cast(g.gt_label = r.pred_label as int) as is_correct, round(strength, 9) as confidence, num_slices, num_candidate_slices, num_no_candidate_slices,
  round(vi, 9) as score_infection, round(vt, 9) as score_tumor, slice_pred_counts
from r join g using (patient_id) where place = 1
""")
def best_slice_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(aggregate.aggregate_slices(read(spark, sf_dir, "fx_slice"), ["patient_id"], "best_slice_vote"))


EVIDENCE = f"""{V}, m as (select *, max(candidate_slice_area) over (partition by patient_id) as most from v),
e as (select patient_id, seq, min(gt_label) as gt_label, count(*) as num_slices, count(*) filter (pred_label in ('infection', 'tumor')) as num_candidate_slices,
    count(*) filter (pred_label = 'no_candidate') as num_no_candidate_slices,
    round(sum(vi * rest * case when most > 0 then ln(1 + candidate_slice_area::double) / ln(1 + most::double) else 1.0::double end), 9) as a,
    round(sum(vt * rest * case when most > 0 then ln(1 + candidate_slice_area::double) / ln(1 + most::double) else 1.0::double end), 9) as b from m group by patient_id, seq),
p as (select *, case when a + b = 0 then 0.0::double else a / (a + b) end as pa, case when a + b = 0 then 0.0::double else b / (a + b) end as pb from e)"""


@query(f"""with {EVIDENCE} select patient_id, seq, gt_label, num_slices, num_candidate_slices, num_no_candidate_slices, round(a, 9) as score_infection_raw, round(b, 9) as score_tumor_raw,
  round(pa, 9) as prob_infection, round(pb, 9) as prob_tumor, cast(a + b > 0 as int) as has_class_evidence from p""")
def sequence_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(aggregate.sequence_evidence(read(spark, sf_dir, "fx_slice")))


@query(f"""with {EVIDENCE}, g as (select patient_id, min(gt_label) as gt_label, string_agg(seq, ',' order by seq) as seqs, count(*) as num_sequences, count(*) filter (a + b > 0) as num_valid_sequences,
    cast(sum(num_slices) as bigint) as num_slices, coalesce(round(avg(pa) filter (a + b > 0), 9), 0) as x, coalesce(round(avg(pb) filter (a + b > 0), 9), 0) as y from p group by patient_id)
select patient_id, gt_label, seqs, num_sequences, num_valid_sequences, num_slices, round(x, 9) as score_infection, round(y, 9) as score_tumor,
  case when x <= 0 and y <= 0 then 'no_candidate' when abs(x - y) <= 1e-12 then 'uncertain' when x > y then 'infection' else 'tumor' end as pred_label, round(greatest(x, y), 9) as confidence from g""")
def sequence_balanced_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(aggregate.sequence_balanced(read(spark, sf_dir, "fx_slice")))


@query(f"""with {EVIDENCE}, l as (select *, case when a <= 0 and b <= 0 then 'no_candidate' when abs(a - b) <= 1e-12 then 'uncertain' when a > b then 'infection' else 'tumor' end as label from p),
g as (select patient_id, min(gt_label) as gt_label, count(*) filter (label = 'infection')::double as x, count(*) filter (label = 'tumor')::double as y from l group by patient_id)
select patient_id, gt_label, x as score_infection, y as score_tumor, case when x <= 0 and y <= 0 then 'no_candidate' when x = y then 'uncertain' when x > y then 'infection' else 'tumor' end as pred_label,
  round(case when x + y = 0 then 0.0::double else greatest(x, y) / (x + y) end, 9) as confidence from g""")
def sequence_majority_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(aggregate.sequence_majority(read(spark, sf_dir, "fx_slice")))


@query("""with c as (select patient_id, gt_label, count(*) as n, min(sample_id) as f from fx_slice group by all)
select patient_id, gt_label from c qualify row_number() over (partition by patient_id order by n desc, f) = 1""")
def modal_label_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aggregate.modal_labels(read(spark, sf_dir, "fx_slice"), ["patient_id"])


@query("select gt_label, pred_label, count(*) as n from fx_slice group by all")
def confusion_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(read(spark, sf_dir, "fx_slice"))


@query("""with c as (select seq, gt_label || '->' || pred_label as k, count(*) as n from fx_slice group by all)
select seq, '{' || string_agg('"' || k || '":' || n, ',' order by k) || '}' as confusion from c group by seq""")
def confusion_json_by_sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion_json(read(spark, sf_dir, "fx_slice"), ["seq"])


@query("""with g as (select seq, count(*) as total, count(*) filter (gt_label = pred_label) as correct, count(*) filter (pred_label in ('infection', 'tumor')) as nc,
  count(*) filter (pred_label in ('infection', 'tumor') and gt_label = pred_label) as ch, count(*) filter (pred_label = 'no_candidate') as nn, count(*) filter (pred_label = 'uncertain') as nu,
  count(*) filter (gt_label = 'infection') as ni, count(*) filter (gt_label = 'tumor') as nt, count(*) filter (gt_label = 'infection' and pred_label = 'infection') as ci,
  count(*) filter (gt_label = 'tumor' and pred_label = 'tumor') as ct from fx_slice group by seq)
select seq, total, correct, round(correct / total, 9) as acc, round(case when ni > 0 and nt > 0 then (ci / ni + ct / nt) / 2 else 0.0::double end, 9) as balanced_acc,
  round(case when nc = 0 then 0.0::double else ch / nc end, 9) as candidate_acc, nc as num_candidate_predictions, nn as num_no_candidate, nu as num_uncertain,
  round(nn / total, 9) as no_candidate_rate, round(nu / total, 9) as uncertain_rate from g""")
def aggregation_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.outcome_metrics(read(spark, sf_dir, "fx_slice"), ["seq"]))


@query("""select gt_label as label, seq, count(*) as total, count(*) filter (gt_label = pred_label) as correct, round(count(*) filter (gt_label = pred_label) / count(*), 9) as acc
from fx_slice group by grouping sets ((gt_label), (seq), (gt_label, seq), ())""")
def metrics_by_label_seq(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.metrics_by_level(read(spark, sf_dir, "fx_slice")))


@query("""with g as (select fold, count(*) as total, count(*) filter (gt_label = pred_selected) as correct, count(*) filter (gt_label = 'infection') as ni, count(*) filter (gt_label = 'tumor') as nt,
  count(*) filter (gt_label = 'infection' and pred_selected = 'infection') as tp, count(*) filter (gt_label = 'tumor' and pred_selected = 'infection') as fp,
  count(*) filter (gt_label = 'tumor' and pred_selected = 'tumor') as tn, count(*) filter (pred_selected not in ('infection', 'tumor')) as nu from fx_patient group by fold),
m as (select *, tp / ni as se, tn / nt as sp, coalesce(tp / nullif(tp + fp, 0), 0) as ppv, coalesce(tn / nullif(tn + ni - tp, 0), 0) as npv from g),
f as (select *, coalesce(2 * ppv * se / nullif(ppv + se, 0), 0) as f1, coalesce(2 * npv * sp / nullif(npv + sp, 0), 0) as f1t from m)
select fold, total, correct, round(correct / total, 9) as accuracy, round((se + sp) / 2, 9) as balanced_accuracy, round(se, 9) as sensitivity, round(sp, 9) as specificity, round(ppv, 9) as ppv_infection,
  round(npv, 9) as npv_infection, round(f1, 9) as f1_infection, round((f1 + f1t) / 2, 9) as macro_f1, nu as no_candidate_or_uncertain from f""")
def classification_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.classification_report(read(spark, sf_dir, "fx_patient"), ["fold"], pred="pred_selected"))


def _weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_component")
    return rows.withColumn("weight", fuse.component_weight(F.col("score"), F.col("area_ratio"))).withColumn("conf", F.col("score"))


W = "w as (select *, greatest(score, 0.0::double) * greatest(area_ratio, 0.05::double) as weight, score as conf from fx_component)"


@query(f"""with {W}, g as (select sample_id, coalesce(round(sum(weight) filter (pred_label = 'infection'), 9), 0) as a, coalesce(round(sum(weight) filter (pred_label = 'tumor'), 9), 0) as b,
  count(*) filter (pred_label in ('infection', 'tumor')) as n from w group by sample_id),
h as (select sample_id, pred_label from w where pred_label <> '' qualify row_number() over (partition by sample_id order by round(weight, 9) desc, area desc, component_rank) = 1)
select sample_id, case when n = 0 then '' when a = b then h.pred_label when a > b then 'infection' else 'tumor' end as pred_label, round(a, 9) as vote_score_infection, round(b, 9) as vote_score_tumor, n as valid_component_votes
from g left join h using (sample_id)""")
def component_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(fuse.fuse_components(_weighted(spark, sf_dir), ["sample_id"]))


def _pick(strategy: str):
    return lambda spark, sf_dir: _short(fuse.pick_candidate(_weighted(spark, sf_dir), ["sample_id"], strategy))


_PICK_SQL = f"""with {W}, g as (select sample_id, count(*) filter (pred_label = 'infection') as ni, count(*) filter (pred_label = 'tumor') as nt,
  coalesce(round(sum(conf) filter (pred_label = 'infection'), 9), 0) as si, coalesce(round(sum(conf) filter (pred_label = 'tumor'), 9), 0) as st,
  min(component_rank) filter (pred_label = 'infection') as ri, min(component_rank) filter (pred_label = 'tumor') as rt from w group by sample_id),
c as (select w.*, g.* exclude (sample_id), pred_label in ('infection', 'tumor') as valid,
  case when ni > nt or (ni = nt and ri < rt) then 'infection' else 'tumor' end as majority, case when ni > 0 and nt > 0 and si = st then pred_label when nt = 0 or (ni > 0 and si > st) then 'infection' else 'tumor' end as heavier from w join g using (sample_id))
select sample_id, component_rank as selected_rank, pred_label, round(conf, 9) + 0 as selected_conf, {{a}} as vote_score_infection, {{b}} as vote_score_tumor
from c qualify row_number() over (partition by sample_id order by {{order}}) = 1"""
_ZERO = "0.0::double"
for _name, (_order, _a, _b) in {
    "top1_conf": ("component_rank", _ZERO, _ZERO),
    "first_valid": ("not valid, component_rank", _ZERO, _ZERO),
    "majority_vote": ("case when ni + nt = 0 then 0 when pred_label = majority then 0 else 1 end, case when ni + nt = 0 then 0 else -conf end, component_rank", "ni::double", "nt::double"),
    "conf_weighted_vote": ("case when ni + nt = 0 then 0 when valid and pred_label = heavier then 0 else 1 end, case when ni + nt = 0 then 0 else -conf end, component_rank", "round(si, 9) + 0", "round(st, 9) + 0"),
}.items():
    QUERIES[f"pick_{_name}"] = _pick(_name)
    ORACLES[f"pick_{_name}"] = _PICK_SQL.format(order=_order, a=_a, b=_b)


def _ablation(name: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        nested = fuse.nest_components(_weighted(spark, sf_dir), ["sample_id"])
        rows = read(spark, sf_dir, "fx_slice").join(nested, "sample_id", "left")
        rows = rows.withColumn("components", F.coalesce("components", F.array().cast(rows.schema["components"].dataType)))
        out = fuse.ABLATIONS[name](rows)
        return _short(out.select("sample_id", "pred_label", F.col("vote_score_infection").cast("double"), F.col("vote_score_tumor").cast("double"), F.col("valid_component_votes").cast("long")))

    return run


_ABL = f"""with {W}, t as (select * from w where component_rank <= 3), n as (select sample_id, count(*) filter (pred_label = 'infection') as ni, count(*) filter (pred_label = 'tumor') as nt,
  coalesce(round(sum(score) filter (pred_label = 'infection'), 9), 0) as si, coalesce(round(sum(score) filter (pred_label = 'tumor'), 9), 0) as st,
  coalesce(round(sum(weight) filter (pred_label = 'infection'), 9), 0) as wi, coalesce(round(sum(weight) filter (pred_label = 'tumor'), 9), 0) as wt,
  min_by(pred_label, component_rank) as l1, min_by(score, component_rank) as s1, min_by(pred_label, component_rank) filter (pred_label <> '') as lv, min_by(score, component_rank) filter (pred_label <> '') as sv from t group by sample_id),
x as (select s.sample_id, s.pred_label as old, s.vote_score_infection as oi, s.vote_score_tumor as ot, s.valid_component_votes as ov, s.final_candidate_source as src, coalesce(ni, 0) as ni, coalesce(nt, 0) as nt, si, st, wi, wt, l1, s1, lv, sv from fx_slice s left join n using (sample_id)),
y as (select *, {{label}} as label, {{ok}} as ok, {{a}} as a, {{b}} as b, {{votes}} as votes from x)
select sample_id, case when old = 'no_candidate' then old when ok then label else 'no_candidate' end as pred_label, round(case when old = 'no_candidate' then oi when ok then a else 0 end, 9)::double + 0 as vote_score_infection,
  round(case when old = 'no_candidate' then ot when ok then b else 0 end, 9)::double + 0 as vote_score_tumor, (case when old = 'no_candidate' then ov when ok then votes else 0 end)::bigint as valid_component_votes from y"""
_HIGH = "case when {0} > {1} then 'infection' when {1} > {0} then 'tumor' else 'no_candidate' end"
_ONE = lambda l, s: {"label": l, "ok": f"coalesce({l} in ('infection', 'tumor'), false)", "a": f"case when {l} = 'infection' then {s} else 0 end", "b": f"case when {l} = 'tumor' then {s} else 0 end", "votes": "1"}
for _name, _parts in {
    "current": {"label": "old", "ok": "true", "a": "oi", "b": "ot", "votes": "ov"},
    "no_adjacent": {"label": "old", "ok": "src <> 'adjacent_slice_fallback'", "a": "oi", "b": "ot", "votes": "ov"},
    "top1": _ONE("l1", "s1"),
    "first_valid": _ONE("lv", "sv"),
    "majority": {"label": f"case when ni > nt then 'infection' when nt > ni then 'tumor' else {_HIGH.format('si', 'st')} end", "ok": "ni + nt > 0", "a": "si", "b": "st", "votes": "ni + nt"},
    "unweighted": {"label": _HIGH.format("si", "st"), "ok": "ni + nt > 0", "a": "si", "b": "st", "votes": "ni + nt"},
    "weighted": {"label": _HIGH.format("wi", "wt"), "ok": "ni + nt > 0", "a": "wi", "b": "wt", "votes": "ni + nt"},
}.items():
    QUERIES[f"ablation_{_name}"] = _ablation(_name)
    _sql = _ABL.format(**_parts)
    ORACLES[f"ablation_{_name}"] = _sql.replace("(case when old = 'no_candidate' then ov when ok", "(case when old = 'no_candidate' and src <> 'adjacent_slice_fallback' then ov when ok") if _name == "no_adjacent" else _sql


@query(f"""with {W}, k as (select unnest([1, 3, 5]) as top_k), s as (select sample_id, gt_label from fx_slice), t as (select top_k, w.* from w join k on component_rank <= top_k),
f as (select top_k, sample_id, coalesce(min_by(pred_label, component_rank) filter (pred_label <> ''), '') as fv, min_by(pred_label, component_rank) as t1 from t group by all),
l as (select top_k, sample_id, 'first_valid' as strategy, fv as pred_label from f union all select top_k, sample_id, 'top1_conf', t1 from f)
select top_k, strategy, count(*) as total, count(*) filter (pred_label = gt_label) as correct, round(count(*) filter (pred_label = gt_label) / count(*), 9) as acc from l join s using (sample_id) group by all""")
def topk_strategy_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Accuracy for every k and pick, from one ranking at the largest k."""
    rows = ranking.prefixes(_weighted(spark, sf_dir).where("component_rank <= 5"), [1, 3, 5], "component_rank")
    valid = F.col("pred_label").isin(*aggregate.CLASSES)
    g = rows.groupBy("top_k", "sample_id").agg(F.coalesce(F.min_by("pred_label", F.when(valid, F.col("component_rank"))), F.lit("")).alias("first_valid"), F.min_by("pred_label", "component_rank").alias("top1_conf"))
    long = g.unpivot(["top_k", "sample_id"], ["first_valid", "top1_conf"], "strategy", "pred_label").join(read(spark, sf_dir, "fx_slice").select("sample_id", "gt_label"), "sample_id")
    hit = F.count_if(F.col("pred_label") == F.col("gt_label"))
    return _short(long.groupBy("top_k", "strategy").agg(F.count(F.lit(1)).alias("total"), hit.alias("correct"), safe_div(hit, F.count(F.lit(1))).alias("acc")))


@query(f"""with {W} select sample_id, {', '.join(f"max({f}) filter (component_rank = {i}) as component_{i}_{f}" for i in (1, 2, 3) for f in ('pred_label', 'area'))} from w where component_rank <= 3 group by sample_id""")
def component_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.components_wide(read(spark, sf_dir, "fx_component"), ["sample_id"], ["pred_label", "area"])


@query("select sample_id, component_rank::int as component_rank, pred_label, area from fx_component where component_rank <= 3")
def component_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.components_long(component_pivot(spark, sf_dir), ["sample_id"], ["pred_label", "area"], present="area")


@query("""with g as (select seq, count(*)::double as total, count(*) filter (gt_label = pred_label)::double as correct from fx_slice group by seq)
select seq, 'total' as metric, total as value from g union all select seq, 'correct', correct from g""")
def metrics_unpivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reshape.metrics_long(metrics.outcome_metrics(read(spark, sf_dir, "fx_slice"), ["seq"]), ["seq"], ["total", "correct"])


@query("""select patient_id, max(gt_label) as gt_label, count(distinct gt_label) as num_labels, count(*) as num_slices, count(*) filter (pred_label in ('infection', 'tumor')) as num_candidate_slices,
  count(*) filter (pred_label = 'no_candidate') as num_no_candidate_slices, count(*) filter (valid_component_votes >= 2) as num_multi_component_slices, max(valid_component_votes) as max_component_votes,
  coalesce(max(candidate_slice_area::double) filter (pred_label in ('infection', 'tumor')), 0) as max_candidate_area, coalesce(sum(candidate_slice_area::double) filter (pred_label in ('infection', 'tumor')), 0) as sum_candidate_area,
  count(*) filter (final_candidate_source = 'adjacent_slice_fallback') as num_adjacent, string_agg(distinct seq, ',' order by seq) as seqs from fx_slice group by patient_id""")
def candidate_burden(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.candidate_burden(read(spark, sf_dir, "fx_slice"))


@query("""with b as (select patient_id, count(*) filter (valid_component_votes >= 2) >= 3 as multi from fx_slice group by patient_id)
select multi, count(*) as total, count(*) filter (gt_label = pred_selected) as correct, round(count(*) filter (gt_label = pred_selected) / count(*), 9) as acc from fx_patient join b using (patient_id) group by multi""")
def subgroup_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    burden = metrics.candidate_burden(read(spark, sf_dir, "fx_slice")).select("patient_id", (F.col("num_multi_component_slices") >= 3).alias("multi"))
    return _short(metrics.outcome_metrics(read(spark, sf_dir, "fx_patient").join(burden, "patient_id"), ["multi"], pred="pred_selected").select("multi", "total", "correct", "acc"))


@query("""select count(*) as samples, max(mem_mib) as peak_mem, max(mem_mib) - 5.0::double as peak_above_baseline, round(avg(mem_mib), 9) as mean_mem, max(util_pct) as peak_util, round(avg(util_pct), 9) as mean_util,
  max(power_w) as peak_power, round(avg(power_w), 9) as mean_power from fx_telemetry""")
def telemetry_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.telemetry_summary(read(spark, sf_dir, "fx_telemetry"), 5.0).select("samples", "peak_mem", "peak_above_baseline", "mean_mem", "peak_util", "mean_util", "peak_power", "mean_power"))


@query("""select date_trunc('day', ts) as window_start, count(*) as samples, max(value) as peak_mem, round(avg(value), 9) as mean_mem, max((user_id % 101)::double) as peak_util from events group by 1""")
def telemetry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.telemetry import windowed_summary

    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), F.col("value").alias("mem_mib"), (F.col("user_id") % 101).cast("double").alias("util_pct"))
    out = windowed_summary(rows, late=None)
    return _short(out.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")))


@query("select count(*) as slices, count(distinct patient_id) as patients, round(count(*) / 60.0::double, 9) as slices_per_second, round(60.0::double / count(*), 9) as seconds_per_slice, round(60.0::double / count(distinct patient_id), 9) as seconds_per_patient from fx_slice")
def throughput_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(metrics.throughput(read(spark, sf_dir, "fx_slice"), 60.0))


@query("""select event_id, coalesce(try_cast(nullif(trim(event_type || ''), '') as double), 0) as as_float, coalesce(cast(trunc(try_cast(value::varchar as double)) as bigint), 0) as as_int,
  lower((value > 50)::varchar) = 'true' as as_flag, round(case when user_id % 7 = 0 then 0.0::double else value / (user_id % 7) end, 9) as ratio from events""")
def lenient_casts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    return rows.select("event_id", safe_float("event_type").alias("as_float"), safe_int(F.col("value").cast("string")).alias("as_int"), flag(F.col("value") > 50).alias("as_flag"), F.round(safe_div("value", F.col("user_id") % 7), 9).alias("ratio"))
