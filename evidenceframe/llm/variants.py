"""Spelling variants: words at one edit, found by pivotal grams.

The bigrams of all words have one order, rare ones first: the frequent ones (a 10,000th of all bigrams or more, so 10,000 of them at most) are counted and known
to the tasks, the others count as equally rare and follow their bytes; equal ones follow their places. A word's pivots are two disjoint ones of its first three bigrams
with the least total frequency, by dynamic programming. One edit leaves a pivot as it is and brings two new bigrams, so it is among the first five of a
near word; and of two near words, one's third bigram isn't before the other's, so none beyond it is needed there. So pivots are joined to these prefixes.

The position limit is exact: an edit stands right of the first pivot, which keeps all up to it, or left of the second, which keeps all from it. The key of a
pivot or prefix bigram is therefore the hash of the word up to it or from it. What meets is verified by edit distance. Keys that many words share
are dealt out in blocks: each block of pivots meets each block of prefixes in a group of its own.

Defined results: words are code points, compared without change of case; null words and counts below one go, words of fewer than four code points have no near word; of rows that repeat
a word counts are summed; ties go to the smallest word in code-point order; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from zlib import crc32

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, discard, materialise

RUN = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Frequent bigrams make up one part in so many of all bigrams; a frequent key has one part in so many of all keys.
PARTS = 10_000
#: Words of a key that one group of the join takes, where a 10,000th of all isn't more.
BLOCK = 1024


def _counts(name: str):
    """A task's running Counter, and a function that yields it as a batch (name, n) and clears it once it has that many entries."""
    counts: Counter[str] = Counter()

    def flush(least: int = 200_000):
        if len(counts) >= least:
            yield pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], [name, "n"])
            counts.clear()

    return counts, flush


def document_words(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int = 199, least: int = 6) -> DataFrame:
    """(word, n): runs of letters of all texts, A-Z lower-cased, with a code point missing from one (document, run) in ``every``.

    h, the CRC-32 of "<id>:<run>", says which (those it divides) and what (place h modulo the length). A null id is written as nothing.
    """

    def count(batches):
        counts, flush = _counts("word")
        for batch in batches:
            for i, text in zip(column(batch, "id").to_pylist(), column(batch, "text")):
                start = crc32(f"{'' if i is None else i}:".encode())
                for run, n in Counter(RUN.findall((text.as_py() or "").translate(LOWER))).items():
                    if len(run) >= least:
                        h = crc32(run.encode(), start)
                        if not h % every:
                            at = h % len(run)
                            run = run[:at] + run[at + 1 :]
                        counts[run] += n
                yield from flush()
        yield from flush(1)

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.length("word") >= least)


def frequent_bigrams(words: DataFrame, parts: int = PARTS) -> dict[str, int]:
    """Bigrams with a ``parts``-th of all or more, so no more than that many, and how often they are met."""

    def count(batches):
        counts, flush = _counts("gram")
        for batch in batches:
            for word in column(batch, "word").to_pylist():
                counts.update(map("".join, zip(word, word[1:])))
                yield from flush()
        yield from flush(1)

    grams = materialise(words.select("word").mapInArrow(count, "gram string, n long").groupBy("gram").agg(F.sum("n").alias("n")))
    total = grams.agg(F.sum("n")).first()[0] or 0
    found = {r["gram"]: r["n"] for r in grams.where(F.col("n") * parts >= total).collect()}
    discard(grams)
    return found


def prefix(word: str, often: dict[str, int]) -> list[int]:
    """Places of the first bigrams in the order (frequency, bytes, place): three, and up to two more equal to the third."""
    grams = sorted((often.get(g := word[i : i + 2], 0), g, i) for i in range(len(word) - 1))[:5]
    return [i for n, g, i in grams if (n, g) <= grams[2][:2]]


def pivots(word: str, places: list[int], often: dict[str, int]) -> tuple[int, int]:
    """The two disjoint ones of some bigrams with the least total frequency, by place; of equal pairs the leftmost.

    From left to right, the cheapest pair that ends at a place is that bigram and the cheapest of those that end before it.
    """
    best, done, cheapest = None, 0, None
    ordered = sorted(places)
    for j in ordered:
        while ordered[done] + 2 <= j:
            i = ordered[done]
            cheapest = min(cheapest or (1 << 63, 0), (often.get(word[i : i + 2], 0), i))
            done += 1
        if cheapest:
            pair = (cheapest[0] + often.get(word[j : j + 2], 0), cheapest[1], j)
            best = min(best or pair, pair)
    return best[1:]


def keys(word: str, often: dict[str, int]) -> list[tuple[int, bool]]:
    """(key, whether of a pivot) of a word: hashes of what stands up to a bigram (even) and from it (odd)."""
    up_to = lambda i: xxhash.xxh64_intdigest(word[: i + 2].encode()) >> 1 & ~1
    onward = lambda i: xxhash.xxh64_intdigest(word[i:].encode()) >> 1 | 1
    places = prefix(word, often)
    first, second = pivots(word, places[:3], often)
    return [(up_to(first), True), (onward(second), True), *((k(i), False) for i in places for k in (up_to, onward))]


def near_words(words: DataFrame, parts: int = PARTS, block: int = BLOCK) -> DataFrame:
    """(word, n, other, other_n) for every two words of words(word, n) with one code point inserted, deleted or replaced, in both directions."""
    long = words.where(F.length("word") >= 4)
    often = frequent_bigrams(long, parts)

    def sign(batches):
        for batch in batches:
            at, found, pivot = [], [], []
            for k, word in enumerate(column(batch, "word").to_pylist()):
                for key, own in keys(word, often):
                    at.append(k), found.append(key), pivot.append(own)
            rows = batch.take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([column(rows, "word"), column(rows, "n"), pa.array(found, pa.int64()), pa.array(pivot)], ["word", "n", "key", "pivot"])

    signed = materialise(long.select("word", "n").mapInArrow(sign, "word string, n long, key long, pivot boolean"))
    sizes = signed.groupBy("key").agg(F.count_if("pivot").alias("pivots"), F.count_if(~F.col("pivot")).alias("others")).where("pivots > 0 and others > 1")
    room = max(block, signed.count() // parts)
    crowded = sizes.where(F.greatest("pivots", "others") > room)  # no more than 2 * parts keys
    dealt = crowded.select("key", F.ceil(F.col("pivots") / room).alias("down"), F.ceil(F.col("others") / room).alias("across"))
    met = signed.join(F.broadcast(dealt), "key", "left").na.fill(1, ["down", "across"])
    own = lambda n: F.pmod(F.xxhash64("word"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    a = met.where("pivot").select("key", own("down").alias("i"), every("across").alias("j"), F.col("word").alias("a"), F.col("n").alias("an"))
    b = met.where("not pivot").select("key", every("down").alias("i"), own("across").alias("j"), F.col("word").alias("b"), F.col("n").alias("bn"))
    pairs = a.join(b, ["key", "i", "j"]).where((F.col("a") != F.col("b")) & (F.abs(F.length("a") - F.length("b")) <= 1) & (F.levenshtein("a", "b", 1) == 1))
    swap = F.col("a") > F.col("b")
    ends = [F.when(swap, F.col(y)).otherwise(F.col(x)).alias(x) for x, y in (("a", "b"), ("b", "a"), ("an", "bn"), ("bn", "an"))]
    links = pairs.select(*ends).dropDuplicates(["a", "b"])
    sides = F.array(*(F.struct(F.col(x).alias("word"), F.col(f"{x}n").alias("n"), F.col(y).alias("other"), F.col(f"{y}n").alias("other_n")) for x, y in (("a", "b"), ("b", "a"))))
    return links.select(F.inline(sides))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root): the last word from forms(word, form) on, where each form is more frequent than its word; each round doubles the steps taken."""
    ways = materialise(forms.select("word", F.col("form").alias("root")))
    while True:
        on = ways.select(F.col("word").alias("root"), F.col("root").alias("next"))
        longer = materialise(ways.join(on, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")))
        discard(ways)
        ways = longer
        if ways.where("moved").isEmpty():
            return ways.select("word", "root")


def spelling_variants(words: DataFrame, word_col: str = "word", count_col: str = "n", ratio: int = 5) -> DataFrame:
    """One row per word: word, n, n_near, form, form_n, root.

    A word's form is its near word of largest count if that is ``ratio`` (2 or more) times its own or more; its root is what forms lead to.
    """
    named = words.select(F.col(word_col).cast("string").alias("word"), F.col(count_col).cast("long").alias("n")).where("word is not null and n > 0")
    words = materialise(named.groupBy("word").agg(F.sum("n").alias("n")))
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("less"), "other")).alias("best"))
    best = materialise(best.select("word", "n_near", F.col("best.other").alias("other"), (-F.col("best.less")).alias("other_n")))
    joined = words.join(best, "word", "left")
    has = F.col("other_n") >= ratio * F.col("n")
    formed = materialise(joined.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(has, F.col("other")).alias("form"), F.when(has, F.col("other_n")).alias("form_n")))
    return formed.join(roots(formed.where("form is not null")), "word", "left").withColumn("root", F.coalesce("root", "word"))
