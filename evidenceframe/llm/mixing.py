"""Mixing sources to target weights by Sainte-Lague apportionment.

Sources in code-point order, null last, have the given weights in turn and share ``share`` of all words; a target
stops at ``most`` times its source's size and the excess goes to the others by weight until none is above.

The mix is cut into equal blocks of words. Blocks go to sources by highest quotients target / (2k - 1), then a
source's blocks to its shards by highest quotients size / (2k - 1), of which a shard has as many as hold ``most`` times its words: integer
quotas. A shard's documents stand in seeded order, its words form blocks in that order, and the quota is taken from a seeded block onward, around the
shard's end as often as the quota asks. All steps are DataFrame operations. The divisor that gives the quotas is found by a few
aggregations; only quotients next to it are ranked.

A source is cut into shards by its own rows and words, so what other sources hold doesn't change it: a shard has some 1,024 rows or more,
up to 16,384 where these have few words. A source's taken words differ from its target by a block, and by a block's part for each shard that is taken to the full.

Defined results: a null text has no words; null is a source of its own; rows that repeat are rows of their own;
ids may be null; without words all targets are 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, join_counted, materialise


def _number(*cols: Column) -> Column:
    """A number from 0 to 2**32 - 1, from the MD5 of the values."""
    parts = [F.coalesce(c.cast("string"), F.lit("")) for c in cols]
    return F.conv(F.substring(F.md5(F.concat_ws("|", *parts)), 1, 8), 16, 10).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """sizes(source, source_size, ...) with place (from 0) and target added; one row per source."""
    order = Window.orderBy(F.col("source").isNull(), "source")
    w = sizes.withColumn("place", F.row_number().over(order) - 1)
    weight = F.element_at(F.array(*(F.lit(float(x)) for x in weights)), (F.col("place") % len(weights) + 1).cast("int"))
    w = w.withColumn("weight", weight).withColumn("bound", F.col("source_size") * F.lit(float(most)))
    # Filling up: sources stop in order of bound / weight; the level is set by those that haven't stopped.
    stop = Window.orderBy(F.col("bound") / F.col("weight"), "place")
    upto, after = stop.rowsBetween(Window.unboundedPreceding, -1), stop.rowsBetween(0, Window.unboundedFollowing)
    w = w.withColumn("given", F.coalesce(F.sum("bound").over(upto), F.lit(0.0))).withColumn("open", F.sum("weight").over(after))
    w = w.withColumn("goal", F.least(F.sum("source_size").over(Window.partitionBy()) * F.lit(float(share)), F.sum("bound").over(Window.partitionBy())))
    w = w.withColumn("level", F.greatest(F.lit(0.0), F.col("goal") - F.col("given")) / F.col("open"))
    # The level at the first source that doesn't stop is the level of all that follow.
    free = F.min(F.when(F.col("level") * F.col("weight") <= F.col("bound"), F.struct((F.col("bound") / F.col("weight")).alias("r"), "place", "level"))).over(Window.partitionBy())
    level = F.coalesce(free["level"], F.lit(0.0))
    return w.select(*sizes.columns, "place", F.least("bound", level * F.col("weight")).alias("target"))


def _upto(vote: Column, divisor: Column, bound: Column) -> Column:
    """Quotients vote / (2k - 1) that reach half a divisor."""
    return F.least(bound, F.floor((F.lit(2.0) * vote / divisor + 1) / 2 * (1 + F.lit(2.0) ** -50)).cast("long"))


def apportion(votes: DataFrame, group: str, seats: str, by: str, vote: str, bound: str | None = None, steps: int = 64, few: int = 100_000) -> DataFrame:
    """Sainte-Lague: votes with ``quota`` added, ``seats`` (the same in a group) dealt by highest vote / (2k - 1), ``bound`` of them at most to a row.

    A divisor's quotas sum to less the larger it is. While about ``few`` quotients or more are in question, a round tries ``steps`` divisors of every
    group, from the last two that have the seats between them, in one aggregation; then those left are ranked. Ties go by ``by``.
    """
    v = votes.withColumn("_bound", F.col(bound) if bound else F.lit(1 << 40).cast("long")).withColumn("_vote", F.col(vote).cast("double"))
    total = v.where("_vote > 0").groupBy(group).agg(
        F.sum("_vote").alias("_all"), F.max(seats).alias("_seats"), F.sum("_bound").alias("_room"), F.max("_vote").alias("_most"), F.count(F.lit(1)).alias("_rows"),
        F.min(F.col("_vote") / (F.col("_bound") + 1)).alias("_least"),
    )
    # from twice the largest vote on a divisor leaves nothing; all seats are given below the other end, if bounds allow
    low = F.col("_all") / (F.col("_seats") + F.col("_rows")) / 4
    low = F.least(low, "_least") if bound else low
    cuts = materialise(total.where("_seats > 0").select(group, "_seats", low.alias("_low"), (F.col("_most") * 2.000001).alias("_high"), (F.col("_room") <= F.col("_seats")).alias("_full")))
    small = cuts.count() <= 1 << 16
    while (cuts.agg(F.max(F.col("_seats") * F.ln(F.col("_high") / F.col("_low")))).first()[0] or 0) > few:
        tried = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.col("_low") * F.pow(F.col("_high") / F.col("_low"), i / steps))
        given = v.where("_vote > 0").join(F.broadcast(cuts) if small else cuts, group)
        sums = F.array(*(F.sum(_upto(F.col("_vote"), F.col("_tried")[i], F.col("_bound"))) for i in range(steps + 1)))
        found = given.withColumn("_tried", tried).groupBy(group).agg(F.max("_seats").alias("_seats"), F.max("_full").alias("_full"), F.max("_tried").alias("_tried"), sums.alias("_sums"))
        at = F.size(F.filter("_sums", lambda n: n >= F.col("_seats")))  # the last divisor that gives enough
        low, high = F.try_element_at("_tried", F.greatest(at, F.lit(1))), F.try_element_at("_tried", F.least(at + 1, F.lit(steps + 1)))
        cuts = materialise(found.select(group, "_seats", F.when(F.col("_full"), high).otherwise(low).alias("_low"), high.alias("_high"), "_full"))
    held = v.join(F.broadcast(cuts) if small else cuts, group, "left")  # groups without seats have no divisor, and nothing to rank
    base = F.when(F.col("_full"), F.col("_bound")).otherwise(_upto(F.col("_vote"), F.col("_high"), F.col("_bound")))
    held = materialise(held.withColumn("_base", F.when((F.col("_vote") > 0) & F.col("_seats").isNotNull(), base).otherwise(0).cast("long")).withColumn("_top", F.when(F.col("_full") | F.col("_seats").isNull(), F.col("_base")).otherwise(_upto(F.col("_vote"), F.col("_low"), F.col("_bound")))))
    left = held.groupBy(group).agg((F.max("_seats") - F.sum("_base")).alias("_left"))
    tries = held.where("_vote > 0 and _top > _base").select(group, by, F.explode(F.sequence(F.col("_base") + 1, "_top")).alias("_k"), "_vote").withColumn("_q", F.col("_vote") / (2 * F.col("_k") - 1))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.col("_q").desc(), by, "_k"))
    won = tries.withColumn("_rank", rank).join(left, group).where("_rank <= _left").groupBy(group, by).agg(F.count(F.lit(1)).alias("_won"))
    return held.join(won, [group, by], "left").select(*(F.col(c) for c in votes.columns), (F.col("_base") + F.coalesce("_won", F.lit(0))).alias("quota"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1),
    share: float = 1.5, most: float = 2.0, block: int = 16, seed: int = 42, shard_docs: int = 1024, shard_words: int = 1 << 14, row_col: str | None = None,
) -> DataFrame:
    """One row per row of docs: id, source, row (``row_col``, else a hash of id and text), size, source_size, target, begin, run, laps, taken.

    ``laps`` whole copies are taken and, if ``run`` > 0, words ``begin`` to ``begin + run`` once more (for a run that
    wraps around the shard's end, ``begin`` counts on from the document's start again).
    A source's shards hold some ``shard_docs`` rows, or up to 16 times as many where that has fewer than ``shard_words`` words; null ids are spread by their text.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(source_col).cast("string").alias("source"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"), (F.col(row_col) if row_col else F.xxhash64(F.col(id_col), F.col(text_col))).alias("row"), F.when(F.col(id_col).isNull(), F.md5(F.col(text_col).cast("binary"))).alias("text_hash"))
    # a key that isn't null, by which frequent sources come back to their rows by broadcast
    rows = materialise(rows.withColumn("key", _number(F.lit(seed), F.col("id"), F.col("size"), F.col("text_hash"))).withColumn("name", F.coalesce(F.concat(F.lit("s"), "source"), F.lit("n"))).drop("text_hash"))
    own = rows.groupBy("name").agg(F.first("source").alias("source"), F.count(F.lit(1)).alias("rows"), F.sum("size").alias("source_size"))
    shards = F.greatest(F.ceil(F.col("rows") / (16 * shard_docs)), F.least(F.ceil(F.col("rows") / shard_docs), F.ceil(F.col("source_size") / shard_words)))
    own = materialise(own.withColumn("shards", F.greatest(shards, F.lit(1)).cast("long")))
    rows = join_counted(rows, own.select("name", "rows", "shards"), ["name"], "rows", own.agg(F.sum("rows")).first()[0] or 0).withColumn("shard", F.col("key") % F.col("shards"))
    cells = materialise(rows.groupBy("name", "shard").agg(F.sum("size").alias("words")))
    sized = targets(own.select("name", "source", "source_size"), weights, share, most)
    sized = sized.withColumn("blocks", F.round(F.sum("target").over(Window.partitionBy()) / block).cast("long"))
    by_source = apportion(sized.withColumn("all", F.lit(0)), "all", "blocks", "place", "target")
    by_source = materialise(by_source.select("name", "place", "source_size", "target", F.col("quota").alias("source_blocks")))
    named = cells.join(by_source, "name").withColumn("bound", F.ceil(F.col("words") * F.lit(float(most)) / block).cast("long"))
    quotas = apportion(named, "place", "source_blocks", "shard", "words", "bound").drop("source_blocks", "bound")
    # The last block of a shard that is taken to the full may be a part.
    take = F.least(F.col("quota") * block, F.floor(F.col("words") * F.lit(float(most))).cast("long"))
    n_blocks = F.ceil(F.col("words") / block).cast("long")
    quotas = quotas.withColumn("take", take).withColumn("laps", F.when(F.col("words") > 0, F.floor(F.col("take") / F.col("words"))).otherwise(0).cast("long"))
    quotas = quotas.withColumn("rest", F.col("take") - F.col("laps") * F.col("words"))
    quotas = quotas.withColumn("from", F.when(n_blocks > 0, (_number(F.lit(seed), F.lit("start"), F.col("place"), F.col("shard")) % F.greatest(n_blocks, F.lit(1))) * block).otherwise(0))
    order = Window.partitionBy("name", "shard").orderBy("key", F.col("id").asc_nulls_last(), "size", "row")
    placed = rows.withColumn("end", F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0))).withColumn("start", F.col("end") - F.col("size"))
    r, q = placed.alias("r"), quotas.alias("q")
    met = r.join(q, (F.col("r.name") == F.col("q.name")) & (F.col("r.shard") == F.col("q.shard")))
    # The run covers [from, from + rest) on the shard's words laid twice in a row.
    stop = F.col("from") + F.col("rest")
    first = F.greatest(F.lit(0), F.least(F.col("end"), stop) - F.greatest(F.col("start"), F.col("from")))
    second = F.greatest(F.lit(0), F.least(F.col("end"), stop - F.col("words")) - F.col("start"))
    begin = F.when(first > 0, F.greatest(F.col("from") - F.col("start"), F.lit(0))).otherwise(0)
    out = met.select(F.col("r.id").alias("id"), F.col("r.source").alias("source"), "row", "size", "source_size", "target", begin.cast("long").alias("begin"), (first + second).cast("long").alias("run"), "laps")
    return out.withColumn("taken", F.when(F.col("size") > 0, F.col("laps") * F.col("size") + F.col("run")).otherwise(0).cast("long"))
