"""Queries on record summaries, pipeline measures and composed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import candidates, checks, fuse, masks, matching, metrics, ranking, reports, reshape
from ..operators.aggregate import CLASSES, adapt_detections, aggregate_levels
from ..sources import readers, sinks
from ..sources.fixtures import read
from ..sources.scratch import scratch_dir
from .evidence import ORACLES as VOTES
from .evidence import _short
from .geometry import O

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


WORDS = ("single", " Single-Lesion", "unifocal", "solitary", "0", "multiple", "multiple lesions", "MULTIFOCAL", "multi_lesion", "1", "2", "multi", "")


@query(f"""with w as (select c_custkey as patient_id, ([{', '.join(repr(w) for w in WORDS)}])[c_custkey % {len(WORDS)} + 1] as word from customer), n as (select *, replace(replace(lower(trim(word)), '-', '_'), ' ', '_') as k from w)
select patient_id, case when k in ('single', 'single_lesion', 'unifocal', 'solitary', '0') then 'single' when k in ('multiple', 'multiple_lesions', 'multifocal', 'multi_lesion', '1') then 'multiple' else '' end as lesion_pattern from n""")
def lesion_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*(F.lit(w) for w in WORDS)), (F.col("c_custkey") % len(WORDS) + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), text.lesion_pattern(word).alias("lesion_pattern"))


SPELLINGS = ("Infection", "感染", "鎰熸煋", "tumour", "肿瘤", "鑲跨槫", "TUMOR or infection", "neither")


@query(f"""with w as (select c_custkey, ([{', '.join(repr(w) for w in SPELLINGS)}])[c_custkey % {len(SPELLINGS)} + 1] as word from customer)
select c_custkey, case when lower(word) like '%infection%' or word in ('感染', '鎰熸煋') then 'infection' when lower(word) like '%tumo%' or word in ('肿瘤', '鑲跨槫') then 'tumor' end as label from w""")
def label_spellings(spark: SparkSession, sf_dir: str) -> DataFrame:
    word = F.element_at(F.array(*(F.lit(w) for w in SPELLINGS)), (F.col("c_custkey") % len(SPELLINGS) + 1).cast("int"))
    return _table(spark, sf_dir, "customer").select("c_custkey", text.label(word).alias("label"))


@query("""with r as (select sample_id, '[1,2,' || sample_id || ',4]' as b from fx_record)
select sample_id, '现在你是一个骨科专家，这是一幅脊椎的磁共振图像,序列为T2。该图像中可能包含了数个病灶，然后我会将最大病灶的坐标位置按照[x1,y1,x2,y2]的格式给出：该张图片中的最大病灶在' || b || '这个位置。请你帮我判断这个病灶属于感染还是肿瘤。' as legacy,
  'a [5,6,7,8] b ' || b || chr(10) || '补充说明：当前仅分析候选病灶区域1/3，坐标为' || b || '。请忽略其他区域，仅根据这个框内最主要的病灶表现判断属于感染还是肿瘤；如果该框不像有效病灶，请输出''无明确病灶''。' as noted,
  '现在你是一个骨科专家，这是一幅脊椎的磁共振图像。当前仅分析候选病灶区域2/3，其坐标为' || b || '。请只关注这个框内区域，并判断该区域最可能属于感染还是肿瘤。' as own,
  '/data/val/image/' || sample_id || '.jpg' as path from r""")
def region_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.box(1, 2, F.col("sample_id"), 4)
    return read(spark, sf_dir, "fx_record").select(
        "sample_id", text.build_prompt(F.lit("T2"), b, "legacy").alias("legacy"), text.region_prompt(F.lit("a [5,6,7,8] b [MASK]"), b, F.lit(1), F.lit(3)).alias("noted"),
        text.region_prompt(F.lit(""), b, F.lit(2), F.lit(3)).alias("own"), text.record_image_path("/data/", F.lit("val"), F.concat(F.col("sample_id"), F.lit(".jpg"))).alias("path"),
    )


@query("select sample_id, vote_score_infection / 7 as score, printf('%.12g', vote_score_infection / 7) as score_text from fx_slice")
def score_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("vote_score_infection") / 7
    return read(spark, sf_dir, "fx_slice").select("sample_id", s.alias("score"), text.score_text(s).alias("score_text"))


@query("""with t as (select o_orderkey, o_orderkey % 9 || ', ' || o_custkey % 5 || ',x,' || o_orderkey % 9 as ints, '0.' || o_orderkey % 9 || ', ,y,' || o_custkey % 5 as floats from orders)
select o_orderkey, array_to_string(list_sort(list_distinct(list_filter(list_transform(string_split(ints, ','), lambda x: try_cast(trim(x) as int)), lambda x: x > 0))), ',') as ints,
  round(list_sum(list_transform(string_split(floats, ','), lambda x: try_cast(trim(x) as double))), 9) as floats from t""")
def number_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = (F.col("o_orderkey") % 9).cast("string"), (F.col("o_custkey") % 5).cast("string")
    ints, floats = F.concat_ws("", a, F.lit(", "), b, F.lit(",x,"), a), F.concat_ws("", F.lit("0."), a, F.lit(", ,y,"), b)
    total = F.aggregate(text.float_list(floats), F.lit(0.0), lambda s, x: s + x)
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.array_join(text.number_list(ints), ",").alias("ints"), F.round(total, 9).alias("floats"))


@query("""select page_id, printf('%06d', page_id) || '_s_' || page_id || '.jpg' as own, 's_' || page_id as sample, 'img' || page_id % 7 || '.nii' as file, 'img' || page_id % 7 || '.nii.gz' as name,
  case when page_id % 2 = 0 then 'p' || page_id else 'sample_' || page_id end as record from pages""")
def file_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("page_id")
    path = F.concat(F.lit("/d/img"), n % 7, F.lit(".nii.gz"))
    keys = text.record_keys(F.concat(F.lit("S "), n), F.concat(F.lit("C:\\x\\"), n, F.lit(".JPG")), n)
    found = text.file_keys(F.concat(F.lit("/d/"), F.element_at(keys, -1)))
    return _table(spark, sf_dir, "pages").select(
        "page_id", F.element_at(keys, -1).alias("own"), text.sample_of_indexed_path(F.element_at(keys, -1)).alias("sample"), F.concat(text.file_id(path), F.lit(".nii")).alias("file"),
        F.element_at(text.file_keys(path), 2).alias("name"), text.record_id(F.when(n % 2 == 0, F.concat(F.lit("p"), n)), n).alias("record"),
    ).where(F.array_contains(found, F.concat(F.lit("s_"), n)))


@query("""select patient_id, min(gt_label) as gt_label, count(distinct gt_label) as num_labels, count(*) as num_records,
  coalesce(count(*) filter (seq = 'T1'), 0) as t1, coalesce(count(*) filter (seq = 'T2'), 0) as t2 from fx_slice group by patient_id""")
def patient_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.patient_metadata(read(spark, sf_dir, "fx_slice"))
    n = lambda s: F.coalesce(F.try_element_at("seq_counts", F.lit(s)), F.lit(0)).alias(s.lower())
    return m.select("patient_id", "gt_label", "num_labels", "num_records", n("T1"), n("T2"))


@query("""with n as (select patient_id, count(*) as n from fx_slice group by patient_id) select fold, count(*) as patients, count(*) filter (gt_label = 'infection') as patients_infection,
  count(*) filter (gt_label = 'tumor') as patients_tumor, coalesce(sum(n), 0)::bigint as records from fx_patient left join n using (patient_id) group by fold""")
def set_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = reports.patient_metadata(read(spark, sf_dir, "fx_slice")).select("patient_id", "num_records")
    return reports.set_summary(matching.left_with_missing(read(spark, sf_dir, "fx_patient"), m, "patient_id"), ["fold"])


_SOURCED = "(select *, case when sample_id % 3 = 0 then null when sample_id % 3 = 1 then 'internal' else 'external' end as source_dataset from fx_slice)"


@query(f"""select 'records' as level, '' as key, count(*) as n from fx_slice union all select 'label', gt_label, count(*) from fx_slice group by gt_label union all select 'seq', seq, count(*) from fx_slice group by seq
union all select 'label|seq', gt_label || '|' || seq, count(*) from fx_slice group by gt_label, seq union all select 'source', coalesce(source_dataset, 'unknown'), count(*) from {_SOURCED} s group by 2""")
def record_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sample_id") % 3
    return reports.record_summary(read(spark, sf_dir, "fx_slice").withColumn("source_dataset", F.when(n == 1, "internal").when(n == 2, "external")))


@query("""with c as (select sample_id as case_id, patient_id, gt_label, case when sample_id % 5 = 0 then 'val' else 'train' end as split from fx_slice), f as (select patient_id, min_by(split, case_id) as split from c group by patient_id)
select 'case_counts' as measure, split as key, count(*) as n from c group by split union all select 'patient_counts', split, count(*) from f group by split union all select 'label_split_counts', gt_label || '_' || split, count(*) from c group by gt_label, split""")
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_slice").select(F.col("sample_id").alias("case_id"), "patient_id", "gt_label", F.when(F.col("sample_id") % 5 == 0, "val").otherwise("train").alias("split"))
    return reports.split_counts(rows)


@query("""with c as (select gt_label, case when sample_id % 5 = 0 then 'val' else 'train' end as split, candidate_slice_area > 2500 as l from fx_slice),
n as (select split as name, l from c union all select gt_label || '_' || split, l from c) select name || '_all_slices' as counter, count(*) as n from n group by name union all select name || '_lesion_slices', count(*) filter (l) from n group by name""")
def export_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_slice").select("gt_label", F.when(F.col("sample_id") % 5 == 0, "val").otherwise("train").alias("split"), (F.col("candidate_slice_area") > 2500).alias("has_lesion"))
    return reports.export_counters(rows)


@query("""with c as (select gt_label as label, case when sample_id % 4 <> 0 then seq end as seq, sample_id % 10 = 0 as bad from fx_slice)
select case when bad then 'failed' else 'cases' end as counter, count(*) as n from c group by 1 union all select 'label_' || label, count(*) from c where not bad group by label union all select 'seq_' || seq, count(*) from c where not bad and seq is not null group by seq""")
def conversion_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("sample_id")
    return reports.conversion_counters(read(spark, sf_dir, "fx_slice").select(F.col("gt_label").alias("label"), F.when(n % 4 != 0, F.col("seq")).alias("seq"), F.when(n % 10 == 0, "shape").alias("error")))


_RUN = f"""{O}, r as (select *, l_suppkey % 7 <> 0 as matched, case when l_orderkey % 2 = 0 then 'infection' else 'tumor' end as gt_label,
  case l_partkey % 5 when 0 then 'infection' when 1 then 'tumor' when 2 then 'tumor' when 3 then 'no_candidate' else '' end as pred_label, l_partkey % 11 = 0 as pred_mask_empty, l_partkey % 4 = 0 as filtered_empty,
  l_suppkey % 9 = 0 as used_fallback, l_suppkey % 7 as s, l_linenumber as part from h)"""
_RATES = [("det_recall_iou03", "iou >= 0.3", "mt"), ("det_recall_iou05", "iou >= 0.5", "mt"), ("strict_localization_recall", "strict", "mt"), ("relaxed_localization_recall", "relaxed", "mt"),
          ("joint_acc_iou03", "iou >= 0.3 and ok", "mt"), ("joint_acc_iou05", "iou >= 0.5 and ok", "mt"), ("joint_acc_strict", "strict and ok", "mt"), ("joint_acc_relaxed", "relaxed and ok", "mt")]
_OVER = ", ".join(f"round(count(*) filter (matched and ({c})) / greatest({w}, 1), 9) as {n}_{s}" for n, c, _ in _RATES for s, w in (("over_matched", "count(*) filter (matched)"), ("over_total", "count(*)")))
_KINDS = {"used_fallback_component": "used_fallback", "pred_mask_empty": "pred_mask_empty", "filtered_empty": "filtered_empty", "adjacent_slice_fallback": "s in (3, 4)"}


def _run(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g, n, k = boxes.box("px1", "py1", "px2", "py2"), boxes.box("gx1", "gy1", "gx2", "gy2"), F.col("l_partkey"), F.col("l_suppkey")
    label = F.when(n % 5 == 0, "infection").when((n % 5).isin(1, 2), "tumor").when(n % 5 == 3, "no_candidate").otherwise("")
    return read(spark, sf_dir, "fx_box").select(
        F.col("l_linenumber").alias("part"), (k % 7 != 0).alias("matched"), F.when(F.col("l_orderkey") % 2 == 0, "infection").otherwise("tumor").alias("gt_label"), label.alias("pred_label"), boxes.iou(p, g).alias("iou"), boxes.iom(p, g).alias("iom"),
        boxes.coverage(p, g).alias("coverage"), boxes.precision(p, g).alias("precision"), boxes.center_hit(p, g).alias("center_hit"), boxes.strict_hit(p, g).alias("strict_hit"), boxes.relaxed_hit(p, g).alias("relaxed_hit"),
        (n % 11 == 0).alias("pred_mask_empty"), (n % 4 == 0).alias("filtered_empty"), (k % 9 == 0).alias("used_fallback_component"), F.element_at(F.array(*(F.lit(s) for s in reports.SOURCES)), (k % 7 + 1).cast("int")).alias("final_candidate_source"),
    )


@query(f"""with {_RUN}, q as (select *, matched and pred_label = gt_label as ok from r) select part, count(*) as total_records, count(*) filter (matched) as matched_records, round(count(*) filter (matched) / count(*), 9) as match_rate, {_OVER},
  {', '.join(f"round(coalesce(avg({c}) filter (matched), 0), 9) as mean_{n}_over_matched" for n, c in (('iou', 'iou'), ('iom', 'iom'), ('coverage', 'cov'), ('precision', 'prec')))},
  round(count(*) filter (matched and hit) / greatest(count(*) filter (matched), 1), 9) as center_hit_rate_over_matched, round(count(*) filter (ok) / greatest(count(*) filter (matched), 1), 9) as cls_acc,
  count(*) filter (matched and pred_label not in ('infection', 'tumor')) as confusion_invalid, {', '.join(f"count(*) filter (matched and gt_label = '{a}' and pred_label = '{b}') as confusion_{a}_{b}" for a in CLASSES for b in CLASSES)},
  round(count(*) filter (matched and pred_label = 'no_candidate') / count(*), 9) as rate_no_candidate, {', '.join(f"count(*) filter (matched and {c}) as num_{n}, round(count(*) filter (matched and {c}) / count(*), 9) as rate_{n}" for n, c in _KINDS.items())},
  {', '.join(f"count(*) filter (matched and s = {i}) as source_{n}" for i, n in enumerate(reports.SOURCES))} from q group by part""")
def record_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure of a localise-then-classify run."""
    return _short(reports.record_metrics(_run(spark, sf_dir), keys=["part"]))


@query(f"""with {_RUN}, q as (select *, matched and pred_label = gt_label as ok from r), n as (select part, count(*) as t, count(*) filter (matched) as m, count(*) filter (ok) as c, {', '.join(f"count(*) filter (matched and iou >= {t}) as d{i}, count(*) filter (ok and iou >= {t}) as j{i}" for i, t in enumerate((0.3, 0.5)))} from q group by part)
select part, t as total_cases, m as matched_records, round(m / t, 9) as match_rate, round(c / greatest(m, 1), 9) as cls_acc, round(d0 / greatest(m, 1), 9) as det_recall_iou03, round(d1 / greatest(m, 1), 9) as det_recall_iou05,
  round(j0 / greatest(m, 1), 9) as joint_acc_iou03, round(j1 / greatest(m, 1), 9) as joint_acc_iou05 from n""")
def case_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(reports.case_metrics(_run(spark, sf_dir), keys=["part"]))


@query(f"""with {_RUN}, c as (select part, case when pred_label in ('infection', 'tumor', 'no_candidate') then gt_label || '->' || pred_label else 'invalid' end as k, count(*) as n from r group by all)
select part, '{{' || string_agg('"' || k || '":' || n, ',' order by k) || '}}' as confusion from c group by part""")
def confusion_with_invalid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.confusion_of(_run(spark, sf_dir), ["part"])


_CAND = f"""{O}, c as (select l_orderkey as sample_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate_, round(iou, 9)) as rank, iou, iom, cov, prec, hit, strict, relaxed, conf, pred_label,
  case when l_orderkey % 2 = 0 then 'infection' else 'tumor' end as gt_label from (select *, 0 as l_shipdate_, round((l_partkey % 89) / 89.0::double, 6) as conf,
  case l_partkey % 5 when 0 then 'infection' when 1 then 'infection' when 4 then '' else 'tumor' end as pred_label from h))"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, g, n = boxes.box("px1", "py1", "px2", "py2"), boxes.box("gx1", "gy1", "gx2", "gy2"), F.col("l_partkey")
    label = F.when((n % 5).isin(0, 1), "infection").when(n % 5 == 4, "").otherwise("tumor")
    rows = read(spark, sf_dir, "fx_box").withColumn("iou", boxes.iou(p, g))
    rows = ranking.ranked(rows, ["l_orderkey"], [F.col("l_linenumber"), n, F.col("l_suppkey"), F.round("iou", 9)], "rank")
    return rows.select(
        F.col("l_orderkey").alias("sample_id"), "rank", "iou", boxes.iom(p, g).alias("iom"), boxes.coverage(p, g).alias("coverage"), boxes.precision(p, g).alias("precision"), boxes.center_hit(p, g).alias("center_hit"),
        boxes.relaxed_hit(p, g).alias("relaxed_hit"), F.round((n % 89) / F.lit(89.0), 6).alias("conf"), label.alias("pred_label"), F.when(F.col("l_orderkey") % 2 == 0, "infection").otherwise("tumor").alias("gt_label"),
    )


@query(f"""with {_CAND}, k as (select unnest([1, 3, 5])::int as top_k), s as (select count(*) as n from orders), b as (select top_k, sample_id, count(*) as n, max(iou) as i, max(iom) as m, max(iou) filter (pred_label = gt_label) as j, max(relaxed::int) as l, max(relaxed::int) filter (pred_label = gt_label) as lj
  from c join k on rank <= top_k group by all) select top_k, count(*) as images_with_candidate, round(count(*) / max(s.n), 9) as candidate_coverage, sum(b.n)::bigint as num_candidate_predictions, round(avg(i), 9) as mean_best_iou, round(avg(m), 9) as mean_best_iom,
  round(count(*) filter (i >= 0.3) / max(s.n), 9) as det_recall_iou03, round(count(*) filter (i >= 0.5) / max(s.n), 9) as det_recall_iou05, round(count(*) filter (j >= 0.3) / max(s.n), 9) as joint_oracle_iou03, round(count(*) filter (j >= 0.5) / max(s.n), 9) as joint_oracle_iou05,
  round(count(*) filter (l > 0) / max(s.n), 9) as relaxed_localization_recall, round(count(*) filter (lj > 0) / max(s.n), 9) as relaxed_joint_oracle from b, s group by top_k""")
def candidate_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = _table(spark, sf_dir, "orders").count()
    return _short(reports.candidate_pool(_candidates(spark, sf_dir), F.lit(n), [1, 3, 5], [0.3, 0.5]))


def _picked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every pick for every k, from one ranking at the largest k and one aggregation, which needs no exchange of its own."""
    prefix = ranking.prefixes(_candidates(spark, sf_dir).where("rank <= 5"), [1, 3, 5], "rank").withColumnRenamed("rank", "component_rank")
    kept = ["iou", "iom", "coverage", "precision", "center_hit", "relaxed_hit", "gt_label"]
    return fuse.pick_candidates(prefix, ["top_k", "sample_id"], fuse.PICKS, kept)


_PICKS = f"""{_CAND}, k as (select unnest([1, 3, 5]) as top_k), t as (select top_k, c.* from c join k on rank <= top_k),
g as (select top_k, sample_id, count(*) filter (pred_label = 'infection') as ni, count(*) filter (pred_label = 'tumor') as nt, coalesce(round(sum(conf) filter (pred_label = 'infection'), 9), 0) as si, coalesce(round(sum(conf) filter (pred_label = 'tumor'), 9), 0) as st,
  min(rank) filter (pred_label = 'infection') as ri, min(rank) filter (pred_label = 'tumor') as rt from t group by all),
x as (select t.*, ni, nt, pred_label <> '' as valid, case when ni > nt or (ni = nt and ri < rt) then 'infection' else 'tumor' end as majority, case when ni > 0 and nt > 0 and si = st then pred_label when nt = 0 or (ni > 0 and si > st) then 'infection' else 'tumor' end as heavier from t join g using (top_k, sample_id)),
y as (select 'top1_conf' as strategy, * from x qualify row_number() over (partition by top_k, sample_id order by rank) = 1 union all select 'first_valid', * from x qualify row_number() over (partition by top_k, sample_id order by not valid, rank) = 1
  union all select 'majority_vote', * from x qualify row_number() over (partition by top_k, sample_id order by case when ni + nt = 0 then 0 when pred_label = majority then 0 else 1 end, case when ni + nt = 0 then 0 else -conf end, rank) = 1
  union all select 'conf_weighted_vote', * from x qualify row_number() over (partition by top_k, sample_id order by case when ni + nt = 0 then 0 when valid and pred_label = heavier then 0 else 1 end, case when ni + nt = 0 then 0 else -conf end, rank) = 1)"""


@query(f"""with {_PICKS}, s as (select count(*) as n from orders) select top_k::int as top_k, strategy, count(*) as selected_count, round(count(*) filter (pred_label = gt_label) / count(*), 9) as cls_acc_on_selected, round(avg(iou), 9) as mean_iou, round(avg(iom), 9) as mean_iom,
  round(avg(cov), 9) as mean_coverage, round(avg(prec), 9) as mean_precision, round(avg(hit::int), 9) as center_hit_rate, round(count(*) filter (iou >= 0.5) / max(n), 9) as strict_localization_recall, round(count(*) filter (relaxed) / max(n), 9) as relaxed_localization_recall,
  round(count(*) filter (iou >= 0.5 and pred_label = gt_label) / max(n), 9) as joint_acc_strict, round(count(*) filter (relaxed and pred_label = gt_label) / max(n), 9) as joint_acc_relaxed,
  {', '.join(f"round(count(*) filter (iou >= {t}) / max(n), 9) as selected_det_recall_iou{str(t).replace('.', '')}, round(count(*) filter (iou >= {t} and pred_label = gt_label) / max(n), 9) as selected_joint_acc_iou{str(t).replace('.', '')}" for t in (0.3, 0.5))},
  round(avg(rank), 9) as mean_selected_rank from y, s group by all""")
def selection_cube(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every measure for every k and pick."""
    n = _table(spark, sf_dir, "orders").count()
    return _short(reports.selection_metrics(_picked(spark, sf_dir), F.lit(n), [0.3, 0.5], ["top_k", "strategy"]))


_TWO_D = """b as (select case_id, z, coalesce(min(x) filter (pred > 0), 0) as px1, coalesce(min(y) filter (pred > 0), 0) as py1, coalesce(max(x + 1) filter (pred > 0), 0) as px2, coalesce(max(y + 1) filter (pred > 0), 0) as py2,
  coalesce(min(x) filter (gt > 0), 0) as gx1, coalesce(min(y) filter (gt > 0), 0) as gy1, coalesce(max(x + 1) filter (gt > 0), 0) as gx2, coalesce(max(y + 1) filter (gt > 0), 0) as gy2, count(*) filter (pred > 0) as p, count(*) filter (gt > 0) as g from fx_mask group by case_id, z)"""
_IOU = "case when (px2 - px1) * (py2 - py1) + (gx2 - gx1) * (gy2 - gy1) - i = 0 then 0.0::double else i / ((px2 - px1) * (py2 - py1) + (gx2 - gx1) * (gy2 - gy1) - i) end"
_OVERLAP = "greatest(0, least(px2, gx2) - greatest(px1, gx1)) * greatest(0, least(py2, gy2) - greatest(py1, gy1)) as i"


@query(f"""with {_TWO_D}, s as (select * from b qualify row_number() over (partition by case_id order by p desc, z) = 1), e as (select case_id, z, gx1, gy1, gx2, gy2,
  case when p > 0 then greatest(0, px1 - round_even((px2 - px1) * 0.2::double, 0)::int) else 0 end as px1, case when p > 0 then greatest(0, py1 - round_even((py2 - py1) * 0.2::double, 0)::int) else 0 end as py1,
  case when p > 0 then least(8, px2 + round_even((px2 - px1) * 0.2::double, 0)::int) else 0 end as px2, case when p > 0 then least(8, py2 + round_even((py2 - py1) * 0.2::double, 0)::int) else 0 end as py2 from s),
  o as (select *, {_OVERLAP} from e) select case_id, z::bigint as z, px1 as x1, py1 as y1, px2 as x2, py2 as y2, round({_IOU}, 9) as iou from o""")
def slice_and_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chosen slice, its expanded box and how that overlaps the true one."""
    found = candidates.slice_and_box(read(spark, sf_dir, "fx_mask"), 8, 8, ratio=0.2)
    return _short(found.select("case_id", "z", "pred_box.*", "iou"))


@query(f"""with {_TWO_D}, o as (select *, {_OVERLAP} from b), s as (select case_id, round({_IOU}, 9) as iou from o qualify row_number() over (partition by case_id order by p desc, z) = 1)
select count(*) as cases, round(count(*) filter (iou >= 0.3) / count(*), 9) as recall_2d_iou03, round(count(*) filter (iou >= 0.5) / count(*), 9) as recall_2d_iou05 from s""")
def slice_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recall of the chosen slices' boxes."""
    found = candidates.slice_and_box(read(spark, sf_dir, "fx_mask"), 8, 8)
    n = F.count(F.lit(1))
    return _short(found.agg(n.alias("cases"), *((F.count_if(F.round("iou", 9) >= t) / n).alias(f"recall_2d_iou{t}".replace(".", "")) for t in (0.3, 0.5))))


@query("""with a as (select case_id, z, count(*) filter (pred > 0) as area from fx_mask group by all), n as (select a.case_id, a.z, a.area, b.z as nz from a left join a b on a.case_id = b.case_id and b.area > 0 and b.z <> a.z and abs(b.z - a.z) <= 3
  qualify row_number() over (partition by a.case_id, a.z order by abs(b.z - a.z), b.area desc, b.z) = 1),
c as (select *, case when area > 0 then z else nz end as cz from n), s as (select c.*, coalesce(m.area, 0) as carea from c left join a m on c.case_id = m.case_id and c.cz = m.z),
q as (select *, carea >= 3 as kept, carea >= 2 as boxed from s)
select case_id, z, case when area > 0 then case when kept then 'filtered_components' when boxed then 'largest_component_fallback' else 'fallback_empty' end when nz is null then 'pred_mask_empty'
  when kept then 'adjacent_slice_fallback' when boxed then 'adjacent_slice_largest_component_fallback' else 'adjacent_slice_fallback_empty' end as final_candidate_source,
  area = 0 as pred_mask_empty, cz is not null and not kept as filtered_empty, cz is not null and not kept and boxed as used_fallback_component from q""")
def candidate_behaviour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources of a slice's candidates, with what happened on the way."""
    area = masks.areas(read(spark, sf_dir, "fx_mask"))
    near = candidates.adjacent_slices(area, 3)
    count = lambda z, p: area.select("case_id", F.col("z").alias(z), (F.col("area") >= 3).cast("int").alias(f"{p}kept"), (F.col("area") >= 2).cast("int").alias(f"{p}box"))
    rows = near.join(count("z", "n_"), ["case_id", "z"]).join(count("neighbour", "neighbour_"), ["case_id", "neighbour"], "left")
    return candidates.candidate_state(rows).select("case_id", "z", "final_candidate_source", "pred_mask_empty", "filtered_empty", "used_fallback_component")


_DEFINITIONS = """d as (select patient_id, 'multi' as definition, case when n >= 2 then true when n = 0 then false end as positive from (select patient_id, count(*) filter (valid_component_votes >= 2) as n from fx_slice group by patient_id)
  union all select patient_id, 'fold', fold = 0 from fx_patient union all select patient_id, 'none', false from fx_patient)"""
_STRATEGIES = """p as (select patient_id, gt_label, 'weighted_top3' as strategy, pred_selected as pred_label from fx_patient union all select patient_id, gt_label, 'top1', pred_baseline from fx_patient union all select patient_id, gt_label, 'majority', 'tumor' from fx_patient),
k as (select definition from d group by definition having count(*) filter (positive) > 0 and count(*) filter (not positive) > 0), r as (select d.definition, d.positive, p.* from d join k using (definition) join p using (patient_id) where positive is not null)"""


def _subgroups(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p, s = read(spark, sf_dir, "fx_patient"), read(spark, sf_dir, "fx_slice")
    n = F.count_if(F.col("valid_component_votes") >= 2)
    definitions = s.groupBy("patient_id").agg(F.when(n >= 2, True).when(n == 0, False).alias("positive")).select("patient_id", F.lit("multi").alias("definition"), "positive")
    definitions = definitions.unionByName(p.select("patient_id", F.lit("fold").alias("definition"), (F.col("fold") == 0).alias("positive"))).unionByName(p.select("patient_id", F.lit("none").alias("definition"), F.lit(False).alias("positive")))
    of = lambda name, c: F.struct(F.lit(name).alias("strategy"), c.alias("pred_label"))
    predictions = p.select("patient_id", "gt_label", F.inline(F.array(of("weighted_top3", F.col("pred_selected")), of("top1", F.col("pred_baseline")), of("majority", F.lit("tumor")))))
    return reports.subgroup_report(predictions, definitions, "weighted_top3", ["top1", "majority"])


_ACC = """a as (select definition, positive, strategy, count(*) as total, count(*) filter (gt_label = pred_label) / count(*) as acc, case when count(*) filter (gt_label = 'infection') > 0 and count(*) filter (gt_label = 'tumor') > 0 then
  (count(*) filter (gt_label = 'infection' and pred_label = gt_label) / count(*) filter (gt_label = 'infection') + count(*) filter (gt_label = 'tumor' and pred_label = gt_label) / count(*) filter (gt_label = 'tumor')) / 2 else 0.0::double end as bal from r group by all)"""


@query(f"with {_DEFINITIONS}, {_STRATEGIES}, {_ACC} select definition, positive, strategy, total, round(acc, 9) as acc, round(bal, 9) as balanced_acc from a")
def subgroup_report_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_subgroups(spark, sf_dir)["metrics"].select("definition", "positive", "strategy", "total", "acc", "balanced_acc"))


@query(f"""with {_DEFINITIONS}, {_STRATEGIES}, {_ACC}, g as (select definition, positive, 'weighted_top3_minus_' || c.strategy as comparison, w.acc - c.acc as x, w.bal - c.bal as y from a w join a c using (definition, positive) where w.strategy = 'weighted_top3' and c.strategy <> 'weighted_top3')
select definition, comparison, {', '.join(f"round(max({c}) filter (positive), 9) as {n}_positive, round(max({c}) filter (not positive), 9) as {n}_negative, round(max({c}) filter (positive) - max({c}) filter (not positive), 9) as {n}_interaction" for c, n in (('x', 'accuracy'), ('y', 'balanced_accuracy')))} from g group by all""")
def subgroup_report_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_subgroups(spark, sf_dir)["deltas"])


@query(f"""with {_DEFINITIONS}, {_STRATEGIES}, w as (select definition, positive, patient_id, max(gt_label) as g, max(pred_label) filter (strategy = 'weighted_top3') as s0, max(pred_label) filter (strategy = 'top1') as s1, max(pred_label) filter (strategy = 'majority') as s2 from r group by all),
l as (select definition, positive, g, 'weighted_top3' as reference, 'top1' as comparator, s0 as a, s1 as b from w union all select definition, positive, g, 'weighted_top3', 'majority', s0, s2 from w union all select definition, positive, g, 'top1', 'majority', s1, s2 from w),
c as (select definition, positive, reference, comparator, count(*) as n, count(*) filter (a <> b) as different_prediction, count(*) filter (a = g and b = g) as both_correct, count(*) filter (a <> g and b <> g) as both_wrong, count(*) filter (a = g and b <> g) as x, count(*) filter (a <> g and b = g) as y from l group by all),
t as (select c.*, (select sum(exp(lgamma(x + y + 1) - lgamma(i + 1) - lgamma(x + y - i + 1) - (x + y) * ln(2))) from (select unnest(range(least(x, y) + 1)) as i)) as tail from c)
select definition, positive, reference, comparator, n, different_prediction, both_correct, both_wrong, x as reference_only_correct, y as comparator_only_correct, round(case when x + y = 0 then 1.0::double else least(1.0::double, 2 * tail) end, 9) as exact_mcnemar_p from t""")
def subgroup_report_discordance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _short(_subgroups(spark, sf_dir)["discordance"])


@query(f"""with {_DEFINITIONS} select definition, count(positive) as num_included, count(*) filter (positive) as num_positive, count(*) filter (not positive) as num_negative,
  case when count(*) filter (positive) > 0 and count(*) filter (not positive) > 0 then 'completed' else 'skipped' end as status from d group by definition""")
def subgroup_report_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _subgroups(spark, sf_dir)["status"]


def _folds(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    p = read(spark, sf_dir, "fx_patient")
    rows = lambda c: p.select("patient_id", "gt_label", "fold", F.col(c).alias("pred_label"))
    selection = p.select("fold").distinct().select("fold", F.when(F.col("fold") % 2 == 0, "adapt10").otherwise("adapt20").alias("selected_config"))
    baseline = rows("pred_baseline").where("patient_id % 50 <> 7").unionByName(rows("pred_baseline").where("patient_id % 50 = 8").withColumn("fold", (F.col("fold") + 1) % 5))
    return reports.fold_report(rows("pred_selected"), baseline, selection, p)


_BASELINE = "(select patient_id, gt_label, fold, pred_baseline as pred_label from fx_patient where patient_id % 50 <> 7 union all select patient_id, gt_label, (fold + 1) % 5, pred_baseline from fx_patient where patient_id % 50 = 8)"
_FOLD = """select fold, count(*) as n, count(*) filter (gt_label = 'infection') as ni, count(*) filter (gt_label = 'tumor') as nt, count(*) filter (gt_label = pred_label) / count(*) as acc,
  (count(*) filter (gt_label = 'infection' and pred_label = gt_label) / count(*) filter (gt_label = 'infection') + count(*) filter (gt_label = 'tumor' and pred_label = gt_label) / count(*) filter (gt_label = 'tumor')) / 2 as bal from {} group by fold"""


@query(f"""with s as ({_FOLD.format('(select *, pred_selected as pred_label from fx_patient)')}), b as ({_FOLD.format(_BASELINE)}) select fold, case when fold % 2 = 0 then 'adapt10' else 'adapt20' end as selected_config, s.n as outer_patients, round(s.acc, 9) as selected_outer_accuracy,
  round(s.bal, 9) as selected_outer_balanced_accuracy, round(b.acc, 9) as baseline_outer_accuracy, round(b.bal, 9) as baseline_outer_balanced_accuracy, s.ni as outer_infection, s.nt as outer_tumor from s join b using (fold)""")
def fold_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per outer fold: what was chosen and how it and the baseline did."""
    return _short(_folds(spark, sf_dir)["folds"])


@query(f"""with h as (select distinct fold, patient_id from {_BASELINE}) select 'internal_only lacks' as problem, fold, patient_id from fx_patient where patient_id % 50 = 7
union all select 'internal_only adds', (fold + 1) % 5, patient_id from fx_patient where patient_id % 50 = 8 union all select 'internal_only repeats', max(fold), patient_id from h group by patient_id having count(*) > 1""")
def fold_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _folds(spark, sf_dir)["violations"]


@query(f"""with o as (select 'nested_selected' as model, gt_label, pred_selected as pred_label from fx_patient union all select 'internal_only', gt_label, pred_label from {_BASELINE})
select model, gt_label, pred_label, count(*) as n from o group by all""")
def oof_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.confusion(_folds(spark, sf_dir)["oof"], ["model"])


# Files written from the given tables into the shared folder, and read back by the readers.


@query("select cast(o_orderkey as varchar) as o_orderkey, case when o_orderkey % 2 = 0 then 'True' else 'False' end as even, case when o_orderkey % 3 > 0 then 'two' || chr(10) || 'lines, \"' || o_orderkey || '\"' end as note from orders")
def csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, n = scratch_dir(spark), F.col("o_orderkey")
    note = F.when(n % 3 > 0, F.concat(F.lit('two\nlines, "'), n, F.lit('"')))
    sinks.write_csv(_table(spark, sf_dir, "orders").select("o_orderkey", (n % 2 == 0).alias("even"), note.alias("note")), path)
    return readers.read_csv(spark, path)


@query("select c_custkey, c_acctbal, null::bigint as s_suppkey from customer union all select null, s_acctbal, s_suppkey from supplier")
def union_csv_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    c, s = _table(spark, sf_dir, "customer"), _table(spark, sf_dir, "supplier")
    sinks.write_union_csv([c.select("c_custkey", F.col("c_acctbal").cast("double").alias("balance")), s.select("s_suppkey", F.col("s_acctbal").cast("double").alias("balance"))], path, ["c_custkey"])
    return readers.read_csv(spark, path, "c_custkey long, balance double, s_suppkey long").select("c_custkey", F.col("balance").alias("c_acctbal"), "s_suppkey")


@query("select o_orderkey, case when o_orderkey % 2 = 0 then o_orderstatus end as state from orders")
def json_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    sinks.write_json(_table(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.col("o_orderstatus")).alias("state")), path)
    return spark.read.schema("o_orderkey long, state string").json(path)


@query("select o_orderkey, o_totalprice::double as o_totalprice from orders where o_orderkey % 2 = 0")
def parquet_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    o = _table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").cast("double").alias("o_totalprice"), (F.col("o_orderkey") % 2 == 0).alias("even"))
    sinks.write_parquet(o, path, ["even"])
    return spark.read.parquet(path).where("even = 'true'").select("o_orderkey", "o_totalprice")


def _arrays(rows: DataFrame, path: str, by: str) -> None:
    """JSON files that each hold an array of records; a file for each value of a column, named by it."""
    record = F.to_json(F.struct(*(c for c in rows.columns if c != by)))
    files = rows.groupBy(by).agg(F.concat(F.lit("["), F.array_join(F.array_sort(F.collect_list(record)), ","), F.lit("]")).alias("value"))
    files.repartition(by).write.partitionBy(by).text(path)


@query("""select cast(sample_id as varchar) as sample_id, trim(regexp_extract(user_text, '<\\|vision_start\\|>(.*?)<\\|vision_end\\|>', 1)) as image_path, cast(regexp_extract(user_text, '\\[(\\d+),(\\d+),(\\d+),(\\d+)\\]', 1) as int) as x1,
  case when lower(assistant_text) like '%infection%' then 'infection' else 'tumor' end as label, cast(patient_id as varchar) as patient_id, upper(regexp_extract(user_text, '\\b(T[12])\\b', 1)) as seq, slice_idx::bigint as slice_idx
  from fx_record where regexp_matches(lower(assistant_text), 'infection|tumou?r')""")
def record_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    turn = lambda who, c: F.struct(F.lit(who).alias("from"), F.col(c).alias("value"))
    rows = read(spark, sf_dir, "fx_record").select(F.col("sample_id").cast("string").alias("id"), F.array(turn("user", "user_text"), turn("assistant", "assistant_text")).alias("conversations"), F.col("patient_id").cast("string").alias("patient_id"), (F.col("sample_id") % 8).alias("part"))
    _arrays(rows, path, "part")
    found = readers.read_records(spark, f"{path}/*/*.txt")
    return found.select("sample_id", "image_path", F.col("box.x1").alias("x1"), "label", "patient_id", "seq", F.col("slice_idx").cast("long").alias("slice_idx"))


@query("select cast(sample_id as varchar) as sample_id, sample_id % 7 as x1, '/mnt' || substr(trim(regexp_extract(user_text, '<\\|vision_start\\|>(.*?)<\\|vision_end\\|>', 1)), 4) as image_path from fx_record where sample_id % 2 = 0")
def prompt_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompts with the truth's boxes, by id."""
    path = scratch_dir(spark)
    rows = read(spark, sf_dir, "fx_record").select(F.col("sample_id").cast("string").alias("id"), F.array(F.struct(F.lit("user").alias("from"), F.col("user_text").alias("value"))).alias("conversations"), (F.col("sample_id") % 3).alias("part"))
    _arrays(rows, path, "part")
    truth = read(spark, sf_dir, "fx_record").where("sample_id % 2 = 0").select(F.col("sample_id").cast("string").alias("sample_id"), boxes.box(F.col("sample_id") % 7, 1, 2, 3).alias("box"), F.lit("tumor").alias("label"))
    found = readers.prompt_records(spark, f"{path}/*/*.txt", truth)
    return found.select("sample_id", F.col("box.x1").cast("long").alias("x1"), text.remap_path("image_path", "img", "/mnt").alias("image_path"))


@query("with c as (select 'case_' || c_custkey % 50 as case_id, c_custkey from customer) select case_id, 'p' || max(c_custkey) as patient_id from c group by case_id")
def case_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of a case's rows over several files the last."""
    path = scratch_dir(spark)
    k = F.col("c_custkey")
    records = _table(spark, sf_dir, "customer").select(F.format_string("%012d", k).alias("_order"), F.to_json(F.struct(F.concat(F.lit("case_"), k % 50).alias("case_id"), F.concat(F.lit("p"), k).alias("patient_id"))).alias("r"))
    files = records.groupBy(F.substring("_order", 1, 9).alias("part")).agg(F.transform(F.array_sort(F.collect_list(F.struct("_order", "r"))), lambda x: x["r"]).alias("rs"))
    files.select("part", F.concat(F.lit("["), F.array_join("rs", ","), F.lit("]")).alias("value")).write.partitionBy("part").text(path)
    return readers.read_cases(spark, f"{path}/*/*.txt").select("case_id", "patient_id")


@query("select count(*) as samples, max(mem_mib) as peak_mem, round(avg(util_pct), 9) as mean_util, round(avg(power_w), 9) as mean_power from fx_telemetry where event_id % 5 <> 0")
def telemetry_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    t = read(spark, sf_dir, "fx_telemetry")
    t.select(F.concat_ws(", ", F.lit("2024/01/01"), F.concat("mem_mib", F.lit(" MiB")), F.when(F.col("event_id") % 5 == 0, "[N/A]").otherwise(F.concat("util_pct", F.lit(" %"))), F.concat("power_w", F.lit(" W"))).alias("value")).write.text(path)
    return _short(metrics.telemetry_summary(readers.telemetry(spark, path)).select("samples", "peak_mem", "mean_util", "mean_power"))


@query("select 'strategy_' || fold as strategy, round(count(*) filter (gt_label = pred_selected) / count(*), 9) as acc, count(*)::double as n from fx_patient group by fold")
def metric_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    m = metrics.outcome_metrics(read(spark, sf_dir, "fx_patient"), ["fold"], pred="pred_selected")
    entry = F.struct(F.concat(F.lit("strategy_"), F.col("fold")).alias("k"), F.create_map(F.lit("acc"), F.col("acc"), F.lit("n"), F.col("total").cast("double")).alias("v"))
    m.groupBy("fold").agg(F.to_json(F.struct(F.map_from_entries(F.collect_list(entry)).alias("patient_level"))).alias("value")).write.partitionBy("fold").text(path)
    found = readers.metric_document(spark, f"{path}/*/*.txt")
    return _short(found.select("strategy", F.col("metrics")["acc"].alias("acc"), F.col("metrics")["n"].alias("n")))


@query("select 'Elapsed (h:mm:ss or m:ss)' as key, count(*) as n, round(sum(user_id % 60 + 60 * (user_id % 7)), 9)::double as seconds from events union all select 'Maximum resident set size (kbytes)', count(*), null from events")
def report_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, u = scratch_dir(spark), F.col("user_id")
    lines = F.array(F.format_string("\tElapsed (h:mm:ss or m:ss): %d:%02d", u % 7, u % 60), F.format_string("\tMaximum resident set size (kbytes): %d", u), F.lit("no value"))
    _table(spark, sf_dir, "events").select(F.explode(lines).alias("value")).write.text(path)
    r = readers.run_report(spark, path)
    timed = F.when(F.col("key").startswith("Elapsed"), readers.seconds_of(F.col("value")))
    return r.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum(timed).alias("seconds"))


# Functions of files' rows, joins and checks.


@query("""with d as (select 'img_' || l_orderkey % 1000 as image_path, l_orderkey % 7 as rank, l_discount::double as conf, l_partkey % 50 as x1, l_suppkey % 50 as y1 from lineitem where l_orderkey % 7 <> 0)
select image_path, rank as det_rank, conf, x1::int as x1, y1::int as y1, row_number() over (partition by image_path order by rank, conf desc, x1, y1)::int as rank from d qualify row_number() over (partition by image_path order by rank, conf desc, x1, y1) <= 3""")
def detection_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, x, y = F.col("l_orderkey") % 7, F.col("l_partkey") % 50, F.col("l_suppkey") % 50
    cell = lambda c: c.cast("string")
    rows = _table(spark, sf_dir, "lineitem").select(F.concat(F.lit("img_"), F.col("l_orderkey") % 1000).alias("image_path"), F.when(n != 0, cell(n)).otherwise("").alias("rank"), cell(F.col("l_discount").cast("double")).alias("conf"), cell(x).alias("x1"), cell(y).alias("y1"), cell(x + 5).alias("x2"), cell(y + 5).alias("y2"))
    return readers.detections(rows, 3).select("image_path", "det_rank", "conf", F.col("box.x1").alias("x1"), F.col("box.y1").alias("y1"), "rank")


@query("select l_orderkey as image, l_linenumber as box_pos, l_quantity::double as conf, row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey)::int as rank from lineitem qualify row_number() over (partition by l_orderkey order by l_quantity desc, l_linenumber, l_partkey) <= 2")
def detector_ranks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.col("l_linenumber").alias("box_pos"), F.col("l_quantity").cast("double").alias("conf"), F.struct("l_linenumber", "l_partkey").alias("place"))
    return candidates.detector_ranks(rows, "image", "conf", 2, "place").select("image", "box_pos", "conf", "rank")


@query("""select l_orderkey, l_linenumber, l_partkey, case when l_partkey % 4 < 2 then greatest(px2 - px1 + 1, 0) * greatest(py2 - py1 + 1, 0) else 0 end::double as candidate_slice_area, (l_partkey % 4 < 2)::int as valid_component_votes,
  case when l_partkey % 4 < 2 then 'filtered_components' else 'pred_mask_empty' end as final_candidate_source from fx_box""")
def adapted_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("l_partkey") % 4
    rows = read(spark, sf_dir, "fx_box").withColumn("pred_label", F.when(n == 0, "infection").when(n == 1, "tumor").otherwise("no_candidate")).withColumnsRenamed({"px1": "pred_x1", "py1": "pred_y1", "px2": "pred_x2", "py2": "pred_y2"})
    return adapt_detections(rows).select("l_orderkey", "l_linenumber", "l_partkey", "candidate_slice_area", "valid_component_votes", "final_candidate_source")


@query("select patient_id, gt_label, patient_id % 3 = 0 as resolved, case when patient_id % 3 = 0 then 'note ' || patient_id end as note from fx_patient")
def left_with_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label")
    notes = p.where("patient_id % 3 = 0").select("patient_id", F.concat(F.lit("note "), F.col("patient_id")).alias("note"))
    return matching.left_with_missing(p, notes, "patient_id")


@query("select patient_id from fx_patient where patient_id % 2 = 0 and patient_id % 3 = 0 and fold < 4")
def common_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    return matching.common_to_all([p.where("patient_id % 2 = 0"), p.where("patient_id % 3 = 0"), p.where("fold < 4")], "patient_id")


@query("select 'prepared' as route, count(*) as n from fx_slice where patient_id in (select patient_id from fx_patient where fold > 1) union all select 'missing', count(*) from fx_slice where patient_id not in (select patient_id from fx_patient where fold > 1)")
def routed_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    there, lost = sinks.routed(read(spark, sf_dir, "fx_slice"), read(spark, sf_dir, "fx_patient").where("fold > 1"), "patient_id")
    n = lambda rows, name: rows.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("route"), "n")
    return n(there, "prepared").unionByName(n(lost, "missing"))


@query("select patient_id, gt_label, '' as lesion_pattern, '' as comment from fx_patient")
def review_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sinks.review_template(read(spark, sf_dir, "fx_patient").select("patient_id", "gt_label"), ["lesion_pattern", "comment"])


@query("select l_orderkey, l_linenumber, l_partkey, printf('%d %.6f %.6f %.6f %.6f', 0, ((px1 + px2) / 2) / 1000.0::double, ((py1 + py2) / 2) / 1000.0::double, (px2 - px1) / 1000.0::double, (py2 - py1) / 1000.0::double) as line from fx_box where px2 > px1 and py2 > py1")
def detector_label_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_box").where("px2 > px1 and py2 > py1").select("l_orderkey", "l_linenumber", "l_partkey", F.struct("l_orderkey", "l_linenumber", "l_partkey").alias("image_path"), boxes.box("px1", "py1", "px2", "py2").alias("box"), F.lit(1000).alias("width"), F.lit(1000).alias("height"))
    return sinks.detector_labels(rows).select("image_path.*", "line")


@query("""select sample_id, 'q<|vision_start|>img/' || sample_id || '.jpg<|vision_end|>' as user_text, case when sample_id % 2 = 0 then '感染' else '肿瘤' end as answer from fx_record""")
def conversations_built(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("sample_id") % 2 == 0, "infection").otherwise("tumor")
    c = text.conversation(F.col("sample_id"), F.lit("q"), F.concat(F.lit("img/"), F.col("sample_id"), F.lit(".jpg")), text.build_answer(label))
    return read(spark, sf_dir, "fx_record").select("sample_id", c.alias("c")).select("sample_id", F.col("c.conversations")[0]["value"].alias("user_text"), F.col("c.conversations")[1]["value"].alias("answer"))


@query("select patient_id, seq_id, split from (select c_custkey as patient_id, c_nationkey as seq_id, case c_custkey % 3 when 0 then 'train' when 1 then 'val' else 'test' end as split from customer)")
def split_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = _table(spark, sf_dir, "customer").select(k.alias("patient_id"), F.col("c_nationkey").alias("seq_id"), F.lit("tumor").alias("label"), F.concat(F.lit("c"), k).alias("case_id"), F.when(k % 3 == 0, "train").when(k % 3 == 1, "val").otherwise("test").alias("split"))
    return readers.split_table(rows).select("patient_id", "seq_id", "split")


@query("select c_custkey as patient_id, case when c_custkey % 2 = 0 then 'single' else 'multiple' end as lesion_pattern from customer")
def clinical_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    return readers.clinical_labels(_table(spark, sf_dir, "customer").select(k.alias("patient_id"), F.when(k % 2 == 0, "0").otherwise("Multi-Lesion").alias("clinical_lesion_pattern")))


@query("select strategy, pred_label, count(*) as n from (select 'a' as strategy, pred_selected as pred_label from fx_patient union all select 'b', pred_baseline from fx_patient) group by all")
def strategy_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    both = readers.strategy_tables({"a": p.select("patient_id", F.col("pred_selected").alias("pred_label")), "b": p.select("patient_id", F.col("pred_baseline").alias("pred_label"))})
    return both.groupBy("strategy", "pred_label").agg(F.count(F.lit(1)).alias("n"))


@query("select 'case_' || c_nationkey as case_id, min(c_custkey) as pos from customer where c_nationkey > 0 group by c_nationkey")
def case_metadata_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_nationkey")
    rows = _table(spark, sf_dir, "customer").select(F.when(k > 0, F.concat(F.lit("case_"), k)).otherwise(" ").alias("case_id"), F.col("c_custkey").alias("pos"))
    return readers.case_metadata(rows).select("case_id", "pos")


@query("select vec_id, (unnest(range(len(embedding))))::int as z, cast(unnest(embedding) as double) as slice from embeddings")
def volume_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "embeddings").withColumn("slices", F.transform("embedding", lambda x: x.cast("double")))
    return reshape.slices_of(rows, ["vec_id"])


@query("select vec_id, case when vec_id % 5 = 0 then null when vec_id % 3 = 0 then '  ' else label::varchar end as own from embeddings where vec_id % 5 = 0 or vec_id % 3 = 0")
def check_present_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("vec_id")
    return checks.present_ids(_table(spark, sf_dir, "embeddings").select(n, F.when(n % 5 == 0, None).when(n % 3 == 0, "  ").otherwise(F.col("label").cast("string")).alias("own")), "own")


@query("select vec_id from embeddings where vec_id % 4 = 0")
def check_same_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    shape = F.struct(F.size("embedding").alias("n"))
    other = F.struct((F.size("embedding") - F.when(F.col("vec_id") % 4 == 0, 1).otherwise(0)).alias("n"))
    return checks.same_shape(_table(spark, sf_dir, "embeddings").select("vec_id", shape.alias("a"), other.alias("b")), "a", "b").select("vec_id")


@query("select count(distinct patient_id) as found from fx_slice having count(distinct patient_id) <> -1")
def check_expected_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.expected_count(read(spark, sf_dir, "fx_slice"), "patient_id", -1)


@query("select patient_id from fx_patient where fold = 3")
def check_coverage_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    return checks.covers(p.where("fold <> 3"), p, "patient_id")


@query("select patient_id, gt_label from fx_patient where fold = 2")
def anti_missing_of_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    return matching.missing(p.select("patient_id", "gt_label"), p.where("fold <> 2"), "patient_id")


@query("select strategy, count(*) as n from (select unnest(['a', 'b', 'c']) as strategy from fx_patient) where strategy = 'b' group by strategy")
def one_strategy(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "fx_patient").select(F.explode(F.array(F.lit("a"), F.lit("b"), F.lit("c"))).alias("strategy"))
    return checks.require_rows(matching.only_strategy(rows, "b")).groupBy("strategy").agg(F.count(F.lit(1)).alias("n"))


@query("select case_id, y::bigint as a, x::bigint as b, z::bigint as c, pred from fx_mask")
def mask_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(z, y, x) as (x, y, z)."""
    t = masks.transpose(read(spark, sf_dir, "fx_mask"))
    return t.select("case_id", F.col("y").cast("long").alias("a"), F.col("z").cast("long").alias("b"), F.col("x").cast("long").alias("c"), "pred")


_EMPTY = "with g as (select patient_id, count(*) filter (gt_label = 'infection') as ni, count(*) filter (gt_label = 'tumor') as nt, count(*) filter (gt_label = 'infection' and pred_label = gt_label) as ci, count(*) filter (gt_label = 'tumor' and pred_label = gt_label) as ct from fx_slice group by patient_id)"


@query(f"{_EMPTY} select patient_id, case when ni > 0 and nt > 0 then (ci / ni + ct / nt) / 2 end as bal_null, round((coalesce(ci / nullif(ni, 0), 0) + coalesce(ct / nullif(nt, 0), 0)) / 2, 9) as bal_half, ni = 0 or nt = 0 as bal_nan from g")
def absent_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balanced accuracy of groups that lack a class, by each of its definitions."""
    s = read(spark, sf_dir, "fx_slice")
    of = lambda empty, name: metrics.outcome_metrics(s, ["patient_id"], empty=empty).select("patient_id", F.col("balanced_acc").alias(name))
    nan = of("nan", "x").select("patient_id", F.isnan("x").alias("bal_nan"))
    return _short(of("null", "bal_null").join(of("half", "bal_half"), "patient_id").join(nan, "patient_id"))


@query(f"""select *, null::varchar as seq, 'patient' as level from ({VOTES['majority_vote_patient']}) union all by name select *, 'sequence' as level from ({VOTES['majority_vote_sequence']})""")
def majority_vote_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patient and sequence decisions in one table."""
    return _short(aggregate_levels(read(spark, sf_dir, "fx_slice"), "majority_vote"))


@query("select sample_id, ((row_number() over (partition by patient_id order by sample_id) - 1) % 3)::int as reader from fx_slice")
def slices_in_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.round_robin(read(spark, sf_dir, "fx_slice"), ["patient_id"], [F.col("sample_id")], 3, "reader").select("sample_id", "reader")
