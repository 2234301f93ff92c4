"""Queries on record text, matching, set comparisons and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import boxes, text
from ..operators import checks, matching, ranking, reshape
from ..sources.fixtures import read
from .evidence import _short

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def _records(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "fx_record")


PATH = r"trim(regexp_extract(user_text, '<\|vision_start\|>(.*?)<\|vision_end\|>', 1))"
STEM = rf"regexp_replace(regexp_extract({PATH}, '([^/]*)$', 1), '\.[^.]*$', '')"
NUM = r"\[\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*,\s*(\d+)\s*\]"
LABEL = "case when lower(assistant_text) like '%infection%' then 'infection' when lower(assistant_text) like '%tumor%' or lower(assistant_text) like '%tumour%' then 'tumor' end"


@query(f"""select sample_id, patient_id, {PATH} as image_path, trim(split_part(user_text, '<|vision_start|>', 1)) as prompt, {LABEL} as label, upper(regexp_extract(user_text, '\\b([Tt][12](?:WI)?)\\b', 1)) as seq_token,
  cast(regexp_extract({STEM}, '(?:^|[_-])layer[_-]?(\\d+)(?:[_-]|$)', 1) as int) as slice_index, 'T1' as seq_of_path from fx_record""")
def parse_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = text.image_path("user_text")
    return _records(spark, sf_dir).select("sample_id", "patient_id", path.alias("image_path"), text.prompt_text("user_text").alias("prompt"), text.label("assistant_text").alias("label"), text.sequence_token("user_text").alias("seq_token"), text.slice_index(path).alias("slice_index"), text.sequence_of_path(path).alias("seq_of_path"))


@query(f"select sample_id, {', '.join(f'''cast(regexp_extract(user_text, '{NUM}', {i}) as int) as {n}''' for i, n in enumerate(('x1', 'y1', 'x2', 'y2'), 1))} from fx_record")
def extract_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("sample_id", text.box_in_text("user_text").alias("b")).select("sample_id", "b.*")


@query(f"select {LABEL} as label, count(*) as n from fx_record group by 1")
def normalize_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).groupBy(text.label("assistant_text").alias("label")).agg(F.count(F.lit(1)).alias("n"))


@query(rf"select sample_id, regexp_replace(user_text, '\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]', '[x1,y1,x2,y2]') as hidden from fx_record")
def redact_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _records(spark, sf_dir).select("sample_id", text.hide_box("user_text").alias("hidden"))


@query(rf"""with t as (select sample_id, 'in [x1,y1,x2,y2] at ' || user_text || ' then [MASK]' as t from fx_record)
select sample_id, replace(t, regexp_extract(t, '(\[\d+,\d+,\d+,\d+\])', 1), '[1,2,3,4]') as second, replace(replace(t, regexp_extract(t, '(\[\d+,\d+,\d+,\d+\])', 1), '[1,2,3,4]'), '[x1,y1,x2,y2]', '[1,2,3,4]') as first_two from t""")
def replace_nth_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.concat(F.lit("in [x1,y1,x2,y2] at "), F.col("user_text"), F.lit(" then [MASK]"))
    rows = _records(spark, sf_dir).select("sample_id", t.alias("t"))
    return rows.select("sample_id", text.replace_nth_box("t", F.lit("[1,2,3,4]"), 2).alias("second"), text.replace_first_boxes("t", F.lit("[1,2,3,4]"), 2).alias("first_two"))


@query(rf"select sample_id from fx_record where regexp_matches(user_text, '\[\s*\d+\s*,\s*\d+\s*,\s*\d+\s*,\s*\d+\s*\]')")
def prompt_leak_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.no_box_in_prompt(_records(spark, sf_dir), "user_text").select("sample_id")


@query(rf"""select page_id, lower(trim(regexp_replace(trim(url), '[^a-zA-Z0-9]+', '_', 'g'), '_')) as slug, coalesce(case when regexp_matches(url, '\d{{6,}}') then list_extract(regexp_extract_all(url, '\d{{6,}}'), -1) end, '') as long_id,
  coalesce(case when starts_with(url, 'https://') then '/data/' || substr(url, 9) end, url) as local_path, printf('p_%06d', page_id) as tag, try_cast(regexp_extract(url, '[-+]?\d+(?:\.\d+)?') as double) as first_number from pages""")
def path_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/pages.parquet")
    return rows.select("page_id", text.slug("url").alias("slug"), F.coalesce(text.patient_id("url"), F.lit("")).alias("long_id"), text.remap_path("url", "https://", "/data").alias("local_path"), text.retagged("p", F.col("page_id")).alias("tag"), text.first_number("url").alias("first_number"))


@query("""select o_orderkey, case when o_orderpriority like '1%' then 'T1' when o_orderpriority like '2%' then 'T2' else upper(o_orderpriority) end as seq, case when o_orderkey % 3 = 0 then 'infection' when o_orderkey % 3 = 1 then 'tumor' else '' end as case_label,
  'infection_' || o_custkey as patient_part, (o_orderkey % 2)::varchar as seq_part, '[' || o_orderkey || ',1,2,3]' as box_text from orders""")
def case_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    digit = F.substring("o_orderpriority", 1, 1)
    seq = F.when(digit == "1", "seq_1").when(digit == "2", "T2WI").otherwise(F.col("o_orderpriority"))
    case_id = F.when(F.col("o_orderkey") % 3 == 0, "infection_7").when(F.col("o_orderkey") % 3 == 1, "tumor_7").otherwise("other")
    parts = text.case_parts(F.concat(F.lit("/x/infection_"), F.col("o_custkey"), F.lit("_"), F.col("o_orderkey") % 2, F.lit(".npz")))
    b = boxes.box(F.col("o_orderkey"), 1, 2, 3)
    return o.select("o_orderkey", text.sequence_code(seq).alias("seq"), text.label_of_case(case_id).alias("case_label"), parts["patient_id"].alias("patient_part"), parts["seq_id"].alias("seq_part"), text.box_text(b).alias("box_text"))


@query(f"""select sample_id, '这是一幅脊椎的磁共振图像，序列为T1。其中病灶的位置按照[x1,y1,x2,y2]的格式在[1,2,' || sample_id || ',4]。请判断这个病灶属于感染还是肿瘤。只输出感染或肿瘤。' as prompt,
  case {LABEL} when 'infection' then '感染' when 'tumor' then '肿瘤' end as answer from fx_record""")
def build_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = boxes.box(1, 2, F.col("sample_id"), 4)
    return _records(spark, sf_dir).select("sample_id", text.build_prompt(F.lit("T1"), b).alias("prompt"), text.build_answer(text.label("assistant_text")).alias("answer"))


@query("select p.patient_id, p.gt_label, s.sample_id from fx_patient p join (select min(sample_id) as sample_id, patient_id from fx_slice group by patient_id) s using (patient_id)")
def pair_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = read(spark, sf_dir, "fx_slice").groupBy("patient_id").agg(F.min("sample_id").alias("sample_id"))
    patients = matching.members(read(spark, sf_dir, "fx_patient"), first, "patient_id").select("patient_id", "gt_label")
    return matching.pair_records(patients, first, "patient_id")


@query("""with c as (select c_custkey // 3 as patient_id, case when c_custkey % 2 = 0 then 'T1' else 'T2' end as seq, 'case_' || c_custkey as case_id, c_custkey as pos from customer),
g as (select patient_id, seq, list(case_id order by pos) as ids from c group by all),
r as (select o_orderkey as sample_id, o_custkey // 3 + case when o_orderkey % 13 = 0 then 1000000 else 0 end as patient_id, case when o_orderkey % 2 = 0 then 'T1' else 'T2' end as seq, case when o_orderkey % 3 = 0 then 'case_' || o_custkey end as case_id,
  case when o_orderkey % 3 = 1 then 'img case_' || o_custkey || '.png' else '' end as image_name from orders),
m as (select r.*, ids, list_filter(ids, lambda x: contains(image_name, x)) as named, coalesce(list_contains(ids, r.case_id), false) as explicit from r left join g using (patient_id, seq))
select sample_id, patient_id, seq, case when ids is null then null when explicit then case_id when len(ids) = 1 then ids[1] when len(named) > 0 then named[1] else ids[1] end as matched_case,
  case when ids is null then 'missing_patient_seq' when explicit then 'explicit_case_id' when len(ids) = 1 then 'patient_seq_single' when len(named) > 0 then 'name_match' else 'patient_seq_first' end as match_method from m""")
def case_match_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet")
    k = F.col("c_custkey")
    cases = c.select(F.floor(k / 3).alias("patient_id"), F.when(k % 2 == 0, "T1").otherwise("T2").alias("seq"), F.concat(F.lit("case_"), k).alias("case_id"), k.alias("pos"))
    o, n = spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderkey")
    name = F.concat(F.lit("case_"), F.col("o_custkey"))
    patient = F.floor(F.col("o_custkey") / 3) + F.when(n % 13 == 0, 1_000_000).otherwise(0)
    records = o.select(n.alias("sample_id"), patient.alias("patient_id"), F.when(n % 2 == 0, "T1").otherwise("T2").alias("seq"), F.when(n % 3 == 0, name).alias("case_id"), F.when(n % 3 == 1, F.concat(F.lit("img "), name, F.lit(".png"))).otherwise("").alias("image_name"))
    return matching.match_case(records, cases)


@query("""with c as (select o_orderkey as sample_id, o_orderkey % 4 as z, o_orderkey % 200 as x1, o_custkey % 100 as y1 from orders),
r as (select l_orderkey as sample_id, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as rec, l_linenumber as slice_idx, l_partkey % 200 as rx1, l_suppkey % 100 as ry1 from lineitem),
m as (select *, greatest(0, least(x1 + 40, rx1 + 30) - greatest(x1, rx1)) * greatest(0, least(y1 + 40, ry1 + 50) - greatest(y1, ry1)) as i from c join r using (sample_id)),
g as (select sample_id, count(*) as n, count(*) filter (slice_idx = z) as nat, min(rec) filter (slice_idx = z) as same from m group by sample_id),
b as (select sample_id, rec from m qualify row_number() over (partition by sample_id order by round(i / (1600 + 1500 - i), 9) desc, rec) = 1)
select sample_id, z, case when nat = 1 then same else rec end as rec, case when nat = 1 then 'patient_seq_slice' when n = 1 then 'patient_seq_single' else 'patient_seq_best_bbox' end as match_method
from c join g using (sample_id) join b using (sample_id)""")
def best_iou_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    x, y = F.col("o_orderkey") % 200, F.col("o_custkey") % 100
    cases = o.select(F.col("o_orderkey").alias("sample_id"), (F.col("o_orderkey") % 4).alias("z"), boxes.box(x, y, x + 40, y + 40).alias("box"))
    li = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    rx, ry = F.col("l_partkey") % 200, F.col("l_suppkey") % 100
    ranked = ranking.ranked(li, ["l_orderkey"], [F.col(c) for c in ("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice")], "rec")
    records = ranked.select(F.col("l_orderkey").alias("sample_id"), F.col("rec").cast("long").alias("rec"), F.col("l_linenumber").alias("slice_idx"), boxes.box(rx, ry, rx + 30, ry + 50).alias("record_box"))
    return matching.best_overlap(cases, records, ["sample_id"], "z", "rec")


@query("""with a as (select c_custkey as cid, [c_custkey % 97, c_custkey % 89 + 100] as ks from customer), b as (select s_suppkey as sid, [s_suppkey % 101, s_suppkey % 83 + 100] as ks from supplier),
x as (select cid, unnest(ks) as k, unnest(range(2)) as i from a), y as (select sid, unnest(ks) as k, unnest(range(2)) as j from b)
select cid, sid, k as key from x join y using (k) qualify row_number() over (partition by cid order by i, j, sid) = 1""")
def alt_key_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = spark.read.parquet(f"{sf_dir}/customer.parquet").select(F.col("c_custkey").alias("cid"))
    s = spark.read.parquet(f"{sf_dir}/supplier.parquet").select(F.col("s_suppkey").alias("sid"))
    left = F.array(F.col("cid") % 97, F.col("cid") % 89 + 100)
    return matching.first_key_match(c, left, "cid", s, F.array(F.col("sid") % 101, F.col("sid") % 83 + 100), "sid")


@query("select patient_id, gt_label from fx_patient where patient_id in (select patient_id from fx_slice where pred_label = 'infection')")
def semi_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.members(read(spark, sf_dir, "fx_patient"), read(spark, sf_dir, "fx_slice").where("pred_label = 'infection'"), "patient_id").select("patient_id", "gt_label")


@query("select patient_id, gt_label from fx_patient where patient_id not in (select patient_id from fx_slice where patient_id % 7 <> 0)")
def anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.missing(read(spark, sf_dir, "fx_patient"), read(spark, sf_dir, "fx_slice").where("patient_id % 7 <> 0"), "patient_id").select("patient_id", "gt_label")


@query("""select sample_id, patient_id, case when patient_id % 10 = 0 then 'val' when patient_id % 3 = 0 then 'train' end as split from fx_slice where patient_id % 10 = 0 or patient_id % 3 = 0""")
def split_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient").select("patient_id")
    return matching.split_membership(read(spark, sf_dir, "fx_slice").select("sample_id", "patient_id"), p.where("patient_id % 3 = 0"), p.where("patient_id % 10 = 0"), ["patient_id"])


@query("select sample_id, candidate_slice_area, case when pred_mask_empty then 'empty mask' when candidate_slice_area < 20 then 'small' end as reason from fx_slice where pred_mask_empty or candidate_slice_area < 20")
def rejected_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, bad = matching.split_valid(read(spark, sf_dir, "fx_slice"), {"empty mask": F.col("pred_mask_empty"), "small": F.col("candidate_slice_area") < 20})
    return bad.select("sample_id", "candidate_slice_area", "reason")


@query("with r as (select *, row_number() over (partition by patient_id order by sample_id) as place from fx_slice) select patient_id, sample_id, gt_label from r where place = 1")
def keep_first_per_patient(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matching.keep_first(read(spark, sf_dir, "fx_slice"), ["patient_id"], "sample_id").select("patient_id", "sample_id", "gt_label")


@query("""with l as (select patient_id, gt_label, pred_selected as a, pred_baseline as b, 'tumor' as c from fx_patient)
select patient_id, gt_label, 'selected' as strategy_a, 'baseline' as strategy_b, a as pred_a, b as pred_b from l union all select patient_id, gt_label, 'selected', 'constant', a, c from l""")
def strategy_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    long = p.select("patient_id", "gt_label", F.inline(F.array(*(F.struct(F.lit(n).alias("strategy"), c.alias("pred_label")) for n, c in (("selected", F.col("pred_selected")), ("baseline", F.col("pred_baseline")), ("constant", F.lit("tumor")))))))
    return matching.strategy_pairs(long, [("selected", "baseline"), ("selected", "constant")])


@query("""with s as (select fold, case when fold % 2 = 0 then 'a' else 'b' end as config from (select distinct fold from fx_patient)),
p as (select patient_id, fold, 'a' as config, pred_selected as pred_label from fx_patient union all select patient_id, fold, 'b', pred_baseline from fx_patient) select p.* from p join s using (fold, config)""")
def fold_selected_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    both = p.select("patient_id", "fold", F.lit("a").alias("config"), F.col("pred_selected").alias("pred_label")).unionByName(p.select("patient_id", "fold", F.lit("b").alias("config"), F.col("pred_baseline").alias("pred_label")))
    chosen = p.select("fold").distinct().withColumn("config", F.when(F.col("fold") % 2 == 0, "a").otherwise("b"))
    return matching.select_by_fold(both, chosen)


@query("""with m as (select fold, 'a' as config, count(*) filter (gt_label = pred_selected) / count(*) as acc, count(*) filter (gt_label = pred_selected) as n from fx_patient group by fold
  union all select fold, 'b', count(*) filter (gt_label = pred_baseline) / count(*), count(*) filter (gt_label = pred_baseline) from fx_patient group by fold)
select fold, config from m qualify row_number() over (partition by fold order by round(acc, 9) desc, n desc, config) = 1""")
def select_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    hit = lambda c: F.count_if(F.col(c) == F.col("gt_label"))
    m = p.groupBy("fold").agg(F.count(F.lit(1)).alias("t"), hit("pred_selected").alias("a"), hit("pred_baseline").alias("b")).unpivot(["fold", "t"], ["a", "b"], "config", "n")
    return ranking.arg_best(m, ["fold"], "config", [F.round(F.col("n") / F.col("t"), 9), F.col("n"), (F.col("config") == "a").cast("int")])


@query("select patient_id, sample_id, cast(row_number() over (partition by patient_id order by sample_id) as int) as rank from fx_slice qualify rank <= 2")
def first_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.top_k(read(spark, sf_dir, "fx_slice"), ["patient_id"], [F.col("sample_id")], 2).select("patient_id", "sample_id", "rank")


@query("select sample_id, printf('%06d', row_number() over (partition by patient_id order by sample_id)) as number from fx_slice where candidate_slice_area >= 20")
def numbered_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.numbered(read(spark, sf_dir, "fx_slice").where("candidate_slice_area >= 20"), ["patient_id"], [F.col("sample_id")]).select("sample_id", "number")


@query("select patient_id from fx_patient order by md5('42|' || patient_id), patient_id limit 100")
def seeded_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranking.permuted(read(spark, sf_dir, "fx_patient"), 42, "patient_id", limit=100).select("patient_id")


@query("""select 'common' as part, count(*) as n from (select patient_id from fx_patient intersect select patient_id from fx_slice)
union all select 'without_slices', count(*) from (select patient_id from fx_patient except select patient_id from fx_slice)""")
def set_comparison(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, s = read(spark, sf_dir, "fx_patient"), read(spark, sf_dir, "fx_slice")
    n = lambda t, name: t.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
    return n(ranking.common(p, s, "patient_id"), "common").union(n(ranking.difference(p, s, "patient_id"), "without_slices"))


@query("select patient_id, count(*) as n from fx_slice group by patient_id having count(*) > 1")
def check_unique_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.unique_key(read(spark, sf_dir, "fx_slice"), ["patient_id"])


@query("select patient_id, count(distinct seq) as n_groups from fx_slice group by patient_id having count(distinct seq) > 1")
def check_one_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.one_group_per_key(read(spark, sf_dir, "fx_slice"), "patient_id", "seq")


@query("""select coalesce(a.patient_id, b.patient_id) as patient_id, case when a.patient_id is null then 'right' else 'left' end as only_in from (select distinct patient_id from fx_patient) a
full join (select distinct patient_id from fx_slice where seq = 'T1') b on a.patient_id = b.patient_id where a.patient_id is null or b.patient_id is null""")
def check_same_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.same_keys(read(spark, sf_dir, "fx_patient"), read(spark, sf_dir, "fx_slice").where("seq = 'T1'"), "patient_id")


@query("select p.patient_id, p.gt_label as label_a, p.pred_baseline as label_b from fx_patient p where p.gt_label <> p.pred_baseline")
def check_labels_agree(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "fx_patient")
    return checks.labels_agree(p, p.select("patient_id", F.col("pred_baseline").alias("gt_label")), "patient_id")


@query("select distinct patient_id from fx_patient where patient_id not in (select patient_id from fx_slice where pred_label = 'infection')")
def check_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.covers(read(spark, sf_dir, "fx_slice").where("pred_label = 'infection'"), read(spark, sf_dir, "fx_patient"), "patient_id")


@query("select distinct patient_id from fx_slice where pred_label = 'tumor' and patient_id not in (select patient_id from fx_slice where pred_label = 'infection')")
def check_nesting(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = read(spark, sf_dir, "fx_slice")
    return checks.inside(s.where("pred_label = 'tumor'"), s.where("pred_label = 'infection'"), "patient_id")


@query("select patient_id, count(distinct pred_label) as n_labels from fx_slice group by patient_id having count(distinct pred_label) < 2")
def check_both_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.both_classes(read(spark, sf_dir, "fx_slice"), ["patient_id"], "pred_label")


@query("select sample_id, final_candidate_source from fx_slice where final_candidate_source not in ('filtered_components', 'adjacent_slice_fallback')")
def check_known_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return checks.known_values(read(spark, sf_dir, "fx_slice"), "final_candidate_source", ["filtered_components", "adjacent_slice_fallback"]).select("sample_id", "final_candidate_source")


@query("select patient_id, seq, null::varchar as note from fx_slice where seq = 'T1' union all select patient_id, null, 'patient' from fx_patient")
def union_of_schemas(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "fx_slice").where("seq = 'T1'").select("patient_id", "seq")
    return reshape.union_rows(a, reshape.with_literals(read(spark, sf_dir, "fx_patient").select("patient_id"), note="patient"))
