"""Not-modified revisit resolution over capture records.

A revisit record says that a URL had not changed. It is resolved to the latest earlier full response of the same
canonical URL, if a validator agrees: the entity tag where the revisit has one (weak comparison), else the last
modification time, else the payload digest. The record then gets the response's headers, with those that a
not-modified reply may update taken from the revisit.

The as-of join runs in blocks of time: within a URL and block the last response is carried forward, and a
block without one takes the last of the blocks before, from a table of one row per URL and block. So a URL that
holds a third of all records is spread over the blocks. Payloads are never shuffled.

Defined results: a record without URL resolves to nothing (``no_url``); of responses at one time the largest id is
the latest; a response at the revisit's own time is not earlier; a null time comes first; a validator that
either side lacks is passed over; no validator in common gives ``unverified`` and no target; a record of null kind is
neither and gives no row; repeated rows are resolved each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Headers that a 304 reply may update (RFC 9110, section 15.4.5), lower case. Fixed values.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")


def canonical_url(url: Column) -> Column:
    """Scheme, ``www.`` or ``m.``, port 80 or 443, fragment, tracking parameters and a closing slash go; host in lower case; parameters sorted."""
    bare = F.regexp_replace(F.trim(url), "#.*$", "")
    bare = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, r"^([^/?]*)", 1)), r"^(www\.|m\.)|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, r"^[^/?]*([^?]*)", 1), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    kept = F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"))
    tail = F.array_join(F.array_sort(kept), "&")
    return F.concat(host, path, F.when(tail != "", F.concat(F.lit("?"), tail)).otherwise(""))


def _tag(c: Column) -> Column:
    return F.regexp_replace(c, "^W/", "")


def resolve_revisits(records: DataFrame, blocks: int | None = None, block_rows: int = 100_000) -> DataFrame:
    """records(record_id long, url, time timestamp, kind 'response' | 'revisit', etag, last_modified, digest,
    headers map) -> one row per revisit: record_id, url_key, status, target_id, headers.

    status: resolved, changed (a validator differs), unverified, no_response or no_url.
    """
    rows = records.select(
        "record_id", canonical_url(F.col("url")).alias("url_key"), F.unix_micros("time").alias("at"), (F.col("kind") == "response").alias("full"), "etag", "last_modified", "digest", "headers",
    ).where("full is not null")
    if blocks is None:
        blocks = 1 + rows.count() // block_rows
    bounds = rows.approxQuantile("at", [i / blocks for i in range(1, blocks)], min(0.001, 0.25 / blocks)) if blocks > 1 else []
    splits = [-math.inf, *sorted(set(bounds) or {0.0}), math.inf]
    timed = Bucketizer(splits=splits, inputCol="_at", outputCol="_block", handleInvalid="keep").transform(rows.withColumn("_at", F.col("at").cast("double")))
    rows = timed.withColumn("block", F.when(F.col("at").isNull(), 0).otherwise(F.col("_block")).cast("int")).drop("_at", "_block")
    response = F.when(F.col("full"), F.struct("record_id", "etag", "last_modified", "digest", "headers"))
    # Last response of each URL and block; then that of the blocks before.
    last = rows.where("full and url_key is not null").groupBy("url_key", "block").agg(F.max_by(F.struct("record_id", "etag", "last_modified", "digest", "headers"), F.struct("at", "record_id")).alias("own"))
    # Blocks without a response still need what was carried: revisits ask for (url, block) pairs of their own.
    asked = rows.where("not full and url_key is not null").select("url_key", "block").distinct()
    marks = last.join(asked, ["url_key", "block"], "full_outer")
    carried = F.last("own", ignorenulls=True).over(Window.partitionBy("url_key").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    carry = marks.withColumn("carried", carried).select("url_key", "block", "carried")
    # Records at one time see only what is earlier: range, not rows.
    before = Window.partitionBy("url_key", "block").orderBy(F.coalesce("at", F.lit(-(1 << 62)))).rangeBetween(Window.unboundedPreceding, -1)
    keyed = rows.withColumn("inside", F.max(F.when(F.col("full"), F.struct("at", "record_id"))).over(before)).where("not full")
    inside = rows.where("full").select(F.col("record_id").alias("in_id"), F.col("url_key").alias("in_key"), F.col("at").alias("in_at"), response.alias("in_response")).dropDuplicates(["in_id", "in_key", "in_at"])
    met = keyed.join(carry, ["url_key", "block"], "left")
    met = met.join(inside, (F.col("inside.record_id") == F.col("in_id")) & (F.col("url_key") == F.col("in_key")) & F.col("inside.at").eqNullSafe(F.col("in_at")), "left")
    found = F.coalesce("in_response", "carried")
    met = met.withColumn("found", found)
    same = lambda a, b: F.when(a.isNotNull() & b.isNotNull(), a == b)
    agrees = F.coalesce(
        same(_tag(F.col("etag")), _tag(F.col("found.etag"))), same(F.col("last_modified"), F.col("found.last_modified")), same(F.col("digest"), F.col("found.digest"))
    )
    status = (
        F.when(F.col("url_key").isNull(), "no_url").when(F.col("found").isNull(), "no_response").when(agrees.isNull(), "unverified").when(agrees, "resolved").otherwise("changed")
    )
    empty = F.create_map().cast("map<string,string>")
    own = F.map_filter(F.coalesce("headers", empty), lambda k, v: F.lower(k).isin(*PERMITTED))
    base = F.map_filter(F.coalesce("found.headers", empty), lambda k, v: ~F.array_contains(F.transform(F.map_keys(own), F.lower), F.lower(k)))
    merged = F.when(F.col("status") == "resolved", F.map_concat(base, own))
    return met.withColumn("status", status).select("record_id", "url_key", "status", F.when(F.col("status") == "resolved", F.col("found.record_id")).alias("target_id"), merged.alias("headers"))
