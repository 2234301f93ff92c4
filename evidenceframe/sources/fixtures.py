"""Views over the given tables in the shape of evaluation records; one SQL text serves Spark and DuckDB but for masks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")

#: One prediction per slice: an order is a slice, a customer a patient.
SLICE = """
select o_orderkey as sample_id, o_custkey as patient_id,
  case when o_orderkey % 2 = 0 then 'T1' else 'T2' end as seq,
  case when o_custkey % 3 = 0 then 'infection' else 'tumor' end as gt_label,
  case o_orderstatus when 'F' then 'infection' when 'O' then 'tumor' else 'no_candidate' end as pred_label,
  cast(case when o_orderstatus = 'P' then 0.0 else (o_orderkey % 7) * 0.25 end as double) as vote_score_infection,
  cast(case when o_orderstatus = 'P' then 0.0 else (o_orderkey % 5) * 0.25 end as double) as vote_score_tumor,
  case when o_orderstatus = 'P' then 0 else cast(floor(o_totalprice) as bigint) % 5000 end as candidate_slice_area,
  o_orderkey % 4 as candidate_slice_distance, o_orderkey % 4 as valid_component_votes,
  case substr(o_orderpriority, 1, 1) when '1' then 'filtered_components' when '2' then 'adjacent_slice_fallback'
    when '3' then 'largest_component_fallback' else '' end as final_candidate_source,
  o_orderstatus = 'P' as pred_mask_empty
from orders
"""

#: Candidate regions of a slice, ranked; a line item is a region.
COMPONENT = """
select l_orderkey as sample_id,
  cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_shipdate, l_extendedprice) as bigint) as component_rank,
  case l_returnflag when 'A' then 'infection' when 'R' then 'tumor' else '' end as pred_label,
  cast(l_quantity as bigint) as area,
  cast(l_quantity as bigint) / cast(max(l_quantity) over (partition by l_orderkey) as double) as area_ratio,
  cast(l_discount * 10 - 0.2 as double) as score
from lineitem
"""

#: Predicted and true boxes in a frame of 280 by 280.
BOX = """
select l_orderkey, l_linenumber, l_partkey, l_suppkey,
  l_partkey % 200 as px1, l_suppkey % 100 as py1,
  l_partkey % 200 + cast(l_quantity as bigint) as px2, l_suppkey % 100 + 10 + 5 * l_linenumber as py2,
  l_partkey % 200 + l_orderkey % 21 - 10 as gx1, l_suppkey % 100 + l_partkey % 15 - 7 as gy1,
  l_partkey % 200 + l_orderkey % 21 - 10 + 25 as gx2, l_suppkey % 100 + l_partkey % 15 - 7 + 20 as gy2
from lineitem
"""

#: A binary outcome with two scores that tie often.
SCORE = """
select l.doc_id, cast(l.quality as bigint) as y, (d.n_chars % 101) / cast(100 as double) as p, (d.n_chars % 7) / cast(6 as double) as p_baseline
from labels l join documents d on l.doc_id = d.doc_id
"""

#: Records with a prompt (box and image path in it) and an answer.
RECORD = """
select u.conv_id * 100 + u.turn as sample_id, u.conv_id as patient_id, u.turn as slice_idx,
  concat('T', cast(u.turn % 2 + 1 as varchar(10)), ' lesion in [', cast(u.conv_id % 50 as varchar(10)), ',',
    cast(u.turn * 3 as varchar(10)), ',', cast(u.conv_id % 50 + 30 as varchar(10)), ',', cast(u.turn * 3 + 20 as varchar(10)),
    '] <|vision_start|>img/', cast(u.conv_id as varchar(10)), '_1_layer_', cast(u.turn as varchar(10)), '.jpg<|vision_end|>') as user_text,
  case when length(a.text) % 3 = 0 then 'infection' when length(a.text) % 3 = 1 then 'Tumour' else a.text end as assistant_text
from conversations u join conversations a on u.conv_id = a.conv_id and a.turn = u.turn + 1
where u.role = 'user' and a.role = 'assistant'
"""

#: Two models' decisions for the same patients, with folds.
PATIENT = """
select c_custkey as patient_id, case when c_custkey % 3 = 0 then 'infection' else 'tumor' end as gt_label,
  case c_mktsegment when 'BUILDING' then 'uncertain' when 'MACHINERY' then 'infection' when 'HOUSEHOLD' then 'infection' else 'tumor' end as pred_selected,
  case when c_nationkey % 2 = 0 then 'infection' else 'tumor' end as pred_baseline, c_nationkey % 5 as fold
from customer
"""

TELEMETRY = "select event_id, ts, value as mem_mib, cast(user_id % 101 as double) as util_pct, cast(user_id as double) as power_w from events"

_MASK = """
select label as case_id, z, cast(floor(pos / 8) as int) as y, cast(pos % 8 as int) as x,
  case when v > 0.1 and vec_id % 4 <> 0 then 1 else 0 end as pred, case when v > 0.05 then 1 else 0 end as gt
from ({}) q
"""
_SLICES = "select vec_id, label, embedding, row_number() over (partition by label order by vec_id) - 1 as z from embeddings"
#: Masks of 8 by 8 pixels, predicted and true, as a pixel table.
MASK_SPARK = _MASK.format(f"select e.vec_id, e.label, e.z, p.pos, cast(p.v as double) v from ({_SLICES}) e lateral view posexplode(embedding) p as pos, v")
MASK_DUCKDB = _MASK.format(f"select vec_id, label, z, unnest(range(64)) as pos, cast(unnest(embedding) as double) as v from ({_SLICES}) e")

VIEWS = {"fx_slice": SLICE, "fx_component": COMPONENT, "fx_box": BOX, "fx_score": SCORE, "fx_record": RECORD, "fx_patient": PATIENT, "fx_telemetry": TELEMETRY, "fx_mask": MASK_SPARK}
DUCKDB_VIEWS = {**VIEWS, "fx_mask": MASK_DUCKDB}


def read(spark: SparkSession, sf_dir: str, view: str) -> DataFrame:
    """A view, over the Parquet tables of a folder; only the tables it names are read."""
    sql = VIEWS[view]
    for table in TABLES:
        if f" {table}" in sql:
            sql = _named(sql, table, spark, sf_dir)
    return spark.sql(sql)


def _named(sql: str, table: str, spark: SparkSession, sf_dir: str) -> str:
    import re

    name = f"{table}_{abs(hash((sf_dir, table))) % (1 << 32)}"
    if re.search(rf"\b(from|join) {table}\b", sql):
        spark.read.parquet(f"{sf_dir}/{table}.parquet").createOrReplaceTempView(name)
    return re.sub(rf"\b(from|join) {table}\b", rf"\1 {name}", sql)


def with_views(sql: str) -> str:
    """DuckDB SQL with the fixture views it names put before it."""
    import re

    used = [v for v in DUCKDB_VIEWS if re.search(rf"\b{v}\b", sql)]
    if not used:
        return sql
    head = ", ".join(f"{v} as ({DUCKDB_VIEWS[v]})" for v in used)
    body = sql.strip()
    if body[:14].lower() == "with recursive":
        return f"with recursive {head}, {body[14:]}"
    return f"with {head}, {body[4:]}" if body[:4].lower() == "with" else f"with {head} {body}"
