"""The corpus operators as registered queries over the given tables, and DuckDB SQL where it can express them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chunks, exact_dedup, language, licenses, mixing, novelty, packing, repetition, simhash, token_files, variants, warc, whitening
from .common import scratch_dir


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_cost_balanced_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return packed.select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def captures(pages: DataFrame) -> DataFrame:
    """Capture records from pages: a response for each, and a revisit for two in three.

    Revisits come later, but for some that come earlier; their tags agree, but for some; some carry no tag and
    rely on the time or the digest, some on nothing.
    """
    n, digest = F.col("page_id"), F.md5("html")
    tag = F.when(n % 5 != 0, F.concat(F.lit('"'), F.substring(digest, 1, 16), F.lit('"')))
    modified = F.when(n % 2 == 0, F.concat(F.lit("day "), F.floor(n / 7).cast("string")))
    second = n * 20

    def record(kind: str, number, at, tag, modified, digest, headers):
        return F.struct(
            number.alias("record_id"), F.col("url").alias("url"), F.timestamp_seconds(F.lit(1_700_000_000) + at).alias("time"), F.lit(kind).alias("kind"),
            tag.alias("etag"), modified.alias("last_modified"), digest.alias("digest"), headers.alias("headers"),
        )

    full = record("response", 2 * n, second, tag, modified, digest, F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("ETag"), F.coalesce(tag, F.lit("-")), F.lit("Date"), second.cast("string")))
    at = second + F.when(n % 11 == 3, -7).otherwise(n % 13)
    own = F.when(n % 8 == 1, F.lit('"other"')).otherwise(F.when(n % 7 == 2, F.lit(None)).otherwise(F.concat(F.lit("W/"), tag)))
    revisit = record("revisit", 2 * n + 1, at, own, F.when(n % 4 == 0, modified), F.when(n % 6 != 2, digest), F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.coalesce(own, F.lit("-")), F.lit("Date"), at.cast("string")))
    both = pages.select(F.explode(F.when(n % 3 == 0, F.array(full)).otherwise(F.array(full, revisit))).alias("r"))
    return both.select("r.*")


def op2_revisit_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = warc.resolve_revisits(captures(_table(spark, sf_dir, "pages")))
    headers = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), "; ")
    return out.select(
        F.floor((F.col("record_id") - 1) / 2).alias("page_id"), "url_key", "status", F.floor(F.col("target_id") / 2).alias("target_page_id"), headers.alias("headers"),
    )


OP2_SQL = r"""
with p as (
  select page_id as n, trim(url) as url, md5(html) as digest, page_id * 20 as sec,
    case when page_id % 5 <> 0 then '"' || substr(md5(html), 1, 16) || '"' end as tag,
    case when page_id % 2 = 0 then 'day ' || cast(cast(floor(page_id / 7.0) as bigint) as varchar) end as modified
  from pages
), k as (
  select *, regexp_replace(regexp_replace(url, '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') as bare from p
), u as (
  select *, regexp_replace(lower(regexp_extract(bare, '^([^/?]*)', 1)), '^(www\.|m\.)|:(80|443)$', '', 'g') ||
    regexp_replace(regexp_extract(bare, '^[^/?]*([^?]*)', 1), '/+$', '') as stem,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1), '&'),
      lambda x: x <> '' and not regexp_matches(x, '^(utm_[a-z]+|ref|gclid|fbclid)(=|$)'))), '&') as tail
  from k
), r as (select *, stem || case when tail <> '' then '?' || tail else '' end as url_key from u),
v as (
  select n, url_key, sec + case when n % 11 = 3 then -7 else n % 13 end as seen_at,
    case when n % 8 = 1 then '"other"' when n % 7 = 2 then null else 'W/' || tag end as etag,
    case when n % 4 = 0 then modified end as lm, case when n % 6 <> 2 then digest end as dg
  from r where n % 3 <> 0
), j as (
  select v.*, r.n as tn, r.tag as ttag, r.modified as tlm, r.digest as tdg, r.sec as tsec,
    row_number() over (partition by v.n order by r.sec desc nulls last, r.n desc) as rank
  from v left join r on v.url_key = r.url_key and r.sec < v.seen_at
), s as (
  select *, case when url_key is null then 'no_url' when tn is null then 'no_response' else
    case coalesce(regexp_replace(etag, '^W/', '') = ttag, lm = tlm, dg = tdg) when true then 'resolved' when false then 'changed' else 'unverified' end end as status
  from j where rank = 1
)
select n as page_id, url_key, status, case when status = 'resolved' then tn end as target_page_id,
  case when status = 'resolved' then 'Content-Type=text/html; Date=' || cast(seen_at as varchar) || '; ETag=' || coalesce(etag, '-') end as headers
from s
"""


def op3_repair_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_dir(spark)
    token_files.write_token_files(_table(spark, sf_dir, "documents"), path, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_digests(spark, path).withColumnRenamed("id", "doc_id")


def op4_repetition_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_sainte_lague_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select(F.col("id").alias("doc_id"), "size", "source_size", "target", "taken")


OP5_SQL = r"""
with d as (select doc_id, source, case when doc_id is null then coalesce(md5(text), '') else '' end as h, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size from documents),
n as (select source, greatest(1, ceil(count(*) / 16384), least(ceil(count(*) / 1024), ceil(sum(size) / 16384)))::bigint as shards from d group by source),
k as (select d.*, ('0x' || substr(md5('42|' || coalesce(doc_id::varchar, '') || '|' || size || '|' || h), 1, 8))::bigint as key, shards from d join n on d.source is not distinct from n.source),
r as (select *, key % shards as shard from k),
s as (select source, sum(size)::bigint as source_size from r group by source),
w as (select *, row_number() over (order by source is null, source) - 1 as place, 2.0::double * source_size as bound from s),
v as (select *, (case place % 3 when 0 then 5.0 when 1 then 2.0 else 1.0 end)::double as weight from w),
f as (select *, coalesce(sum(bound) over (order by bound / weight, place rows between unbounded preceding and 1 preceding), 0) as given,
  sum(weight) over (order by bound / weight, place rows between current row and unbounded following) as open, least(1.5::double * sum(source_size) over (), sum(bound) over ()) as goal from v),
l as (select *, greatest(0, goal - given) / open as level from f),
t as (select place, source, source_size, least(bound, coalesce((select level from l where level * weight <= bound order by bound / weight, place limit 1), 0) * weight) as target from l),
b as (select cast(round(sum(target) / 16) as bigint) as blocks from t),
q as (select place, target, unnest(range(1, cast(ceil(target / 16) as bigint) + 50)) as i from t where target > 0),
u as (select place, row_number() over (order by target / (2 * i - 1) desc, place, i) as rank from q),
a as (select place, count(*) as seats from u, b where rank <= blocks group by place),
c as (select source, shard, sum(size)::bigint as words from r group by all),
m as (select c.*, t.place, t.source_size, t.target, coalesce(a.seats, 0) as seats from c join t on c.source is not distinct from t.source left join a on t.place = a.place),
x as (select place, shard, seats, words, unnest(range(1, cast(ceil(2 * words / 16) as bigint) + 1)) as i from m where words > 0 and seats > 0),
y as (select place, shard, seats, row_number() over (partition by place order by words / (2 * i - 1) desc, shard, i) as rank from x),
z as (select place, shard, count(*) as quota from y where rank <= seats group by all),
g as (select m.*, least(coalesce(quota, 0) * 16, 2 * words) as take, cast(ceil(words / 16) as bigint) as blocks from m left join z using (place, shard)),
h as (select *, case when words > 0 then take // words else 0 end as laps, ('0x' || substr(md5('42|start|' || place || '|' || shard), 1, 8))::bigint % greatest(blocks, 1) * 16 as first from g),
j as (select *, take - laps * words as rest from h),
e as (select *, sum(size) over (partition by source, shard order by key, doc_id nulls last, size rows unbounded preceding) as stop from r),
o as (select e.doc_id, e.size, j.source_size, j.target, j.laps,
  greatest(0, least(stop, first + rest) - greatest(stop - size, first)) + greatest(0, least(stop, first + rest - words) - (stop - size)) as run
  from e join j on e.source is not distinct from j.source and e.shard = j.shard)
select doc_id, size, source_size, target, cast(case when size > 0 then laps * size + run else 0 end as bigint) as taken from o
"""


def op6_gear_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chunks.repeated_spans(_table(spark, sf_dir, "documents")).withColumnsRenamed({"id": "doc_id", "other_id": "other_doc_id"})


def op7_ppm_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs)).select(F.col("id").alias("doc_id"), "held_out", "lang_pred", "score")


def op8_progressive_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = exact_dedup.exact_groups(_table(spark, sf_dir, "documents"))
    return rows.select(F.col("id").alias("doc_id"), "keep_id", "group_size", "kept", F.col("digest").alias("text_sha256"))


OP8_SQL = r"""
with t as (
  select doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) as text_sha256 from documents
), g as (
  select *, min(doc_id) over (partition by text_sha256) as keep_id, count(*) over (partition by text_sha256) as group_size,
    row_number() over (partition by text_sha256 order by doc_id nulls last) as place
  from t
)
select doc_id, keep_id, group_size, place = 1 as kept, text_sha256 from g
"""


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=3, budget=2, seed=42)
    return rows.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fingerprint")), 16, "0").alias("fingerprint"), "component_id")


def op10_license_sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.license_matches(_table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), "match", "license", "start", "end", F.array_join("sentence_ids", " ").alias("sentence_ids"))


def op11_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return novelty.digests(novelty.secrets(_table(spark, sf_dir, "documents"))).withColumnRenamed("id", "doc_id")


def op12_pivotal_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = variants.document_words(_table(spark, sf_dir, "documents")).where("n >= 5")
    return variants.spelling_variants(words).select("word", "form", "root", "n", "n_near", "form_n")


OP12_SQL = r"""
with recursive tab as (
  select list(v order by b) as t from (select b, list_reduce(list_prepend(b, range(8)), lambda c, x: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(b))
), runs as (
  select doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as run, count(*) as times
  from (select doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) as run from documents) where length(run) >= 6 group by all
), bytes as (
  select doc_id, run, times, list_concat([4294967295], list_transform(string_split(coalesce(doc_id::varchar, '') || ':', ''), lambda x: unicode(x)::bigint),
    flatten(list_transform(string_split(run, ''), lambda x: case when unicode(x) < 128 then [unicode(x)::bigint] else [195::bigint, unicode(x) - 64] end))) as b from runs
), hashes as (
  select run, times, xor(4294967295, list_reduce(b, lambda c, x: xor(c // 256, t[1 + xor(c % 256, x)]))) as h from bytes, tab
), counted as (
  select case when h % 199 = 0 then substr(run, 1, (h % length(run))::int) || substr(run, (h % length(run))::int + 2) else run end as word, sum(times)::bigint as n from hashes group by 1
), words as (select word, n from counted where length(word) >= 6 and n >= 5),
less as (select word, n, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda i: substr(word, 1, i::int - 1) || substr(word, i::int + 1)), word))) as part from words),
near as (
  select distinct a.word, a.n, b.word as other, b.n as other_n from less a join less b using (part)
  where a.word <> b.word and (length(a.word) <> length(b.word) or len(list_filter(range(1, length(a.word) + 1), lambda i: substr(a.word, i::int, 1) <> substr(b.word, i::int, 1))) = 1)
), best as (select word, n, count(*) as n_near, first(other order by other_n desc, other) as other, max(other_n) as other_n from near group by all),
formed as (
  select w.word, w.n, coalesce(n_near, 0) as n_near, case when other_n >= 5 * w.n then other end as form, case when other_n >= 5 * w.n then other_n end as form_n
  from words w left join best b on w.word = b.word
), chain as (
  select word, form as goal, 1 as step from formed where form is not null
  union all select c.word, f.form, step + 1 from chain c join formed f on c.goal = f.word where f.form is not null
), ends as (select word, last(goal order by step) as root from chain group by word)
select f.word, form, coalesce(root, f.word) as root, n, n_near, form_n from formed f left join ends e on f.word = e.word
"""


def op13_polynomial_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumnRenamed("id", "vec_id")


QUERIES = {
    f.__name__: f
    for f in (
        op1_cost_balanced_packing, op2_revisit_resolution, op3_repair_token_files, op4_repetition_coverage, op5_sainte_lague_mixing,
        op6_gear_chunk_dedup, op7_ppm_language, op8_progressive_exact_dedup, op9_simhash_trie, op10_license_sentences,
        op11_zstd_novelty_secrets, op12_pivotal_variants, op13_polynomial_whitening,
    )
}
ORACLES = {"op2_revisit_resolution": OP2_SQL, "op5_sainte_lague_mixing": OP5_SQL, "op8_progressive_exact_dedup": OP8_SQL, "op12_pivotal_variants": OP12_SQL}
