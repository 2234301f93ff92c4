"""SimHash near-duplicates: fingerprints, a trie self-join for near fingerprints, components.

A fingerprint has bit b set if more than half of a text's shingle hashes have it. Distinct fingerprints within
``budget`` bits are found by walking tries from the root in node pairs, adding up the bits in which the pair's
prefixes differ and dropping a pair beyond the budget. There is a trie for each way to put two of the four
16-bit blocks first: as two bits at most differ, some way has both leading blocks equal, so its pairs start at
depth 32 with equal nodes, and a link is taken from the first such way only. A step goes eight levels down. A node
has 256 children at most and few nodes lie within the budget of it, so no join has a hot key, however many
documents share a fingerprint or nearly do.

Defined results: a null text is an empty one; a text without words has fingerprint zero, linked like any other;
ids may repeat or be null (a component of null ids only has a null id); an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column, join_counted, materialise, text_or_empty
from .components import components

WAYS = list(combinations(range(4), 2))
#: Members that are compared with as many others at a time, and those that a task compares with as many others.
BLOCK, TASK = 256, 1024
#: Least and most counts of a text's shingles.
COUNTS = 256, 8192


def shingle_hashes(text: bytes, width: int, seed: int) -> np.ndarray:
    """Hashes of all runs of ``width`` words, lower case (A-Z), in order; of the whole if it is shorter."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    begins = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    h = xxhash.xxh64_intdigest
    return np.array([h(line[a:b], seed) for a, b in zip(begins[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())], np.uint64)


def majority(hashes: np.ndarray) -> int:
    """The 64 bits that over half of the hashes have set, as a signed integer."""
    if not len(hashes):
        return 0
    counts = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        block = hashes[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(block, axis=1).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes)).view(">i8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """(id, fingerprint long) for every row."""

    def scan(batches):
        for batch in batches:
            texts = column(batch, "text", pa.binary())
            prints = [majority(shingle_hashes(t.as_py(), width, seed)) for t in texts]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(prints, pa.int64())], ["id", "fingerprint"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    return named.mapInArrow(scan, "id long, fingerprint long")


def _block(fp: Column, k: int) -> Column:
    return F.shiftrightunsigned(fp, 48 - 16 * k).bitwiseAND(0xFFFF)


def _reordered(fp: Column, order: tuple[int, ...]) -> Column:
    out = _block(fp, order[3])
    for place, k in enumerate(order[:3]):
        out = out.bitwiseOR(F.shiftleft(_block(fp, k), 48 - 16 * place))
    return out


def _walk(leaves: DataFrame, exact: int, steps: list[int], budget: int) -> DataFrame:
    """(way, left, right, errors) for leaves(way, leaf) of one trie per way that differ in 1 to ``budget`` bits, all
    below depth ``exact``. steps: levels taken at a time from there to the leaves; a node has 2 ** step children at
    most, which bounds what a row holds.
    """
    below = sum(steps)
    node = F.shiftrightunsigned("leaf", below)
    roots = leaves.groupBy("way", node.alias("node")).count().where("count > 1").select("way", "node")
    alive = materialise(leaves.withColumn("node", node).join(roots, ["way", "node"], "left_semi").select("way", "leaf"))
    pairs = None
    for step in steps:
        above, below = below, below - step
        down = F.shiftrightunsigned("leaf", below) if below else F.col("leaf")
        kids = alive.groupBy("way", F.shiftrightunsigned("leaf", above).alias("node")).agg(F.collect_set(down).alias("kids"), F.count(F.lit(1)).alias("leaves"))
        if pairs is None:  # roots meet themselves only
            met = kids.where("leaves > 1").select("way", F.lit(True).alias("same"), F.lit(0).alias("errors"), F.explode("kids").alias("x"), F.col("kids").alias("ys"))
        else:
            x = kids.select("way", F.col("node").alias("left"), F.col("kids").alias("xs"), "leaves")
            y = kids.select("way", F.col("node").alias("right"), F.col("kids").alias("ys"))
            met = pairs.join(x, ["way", "left"]).where("left <> right or leaves > 1").join(y, ["way", "right"])
            met = met.select("way", (F.col("left") == F.col("right")).alias("same"), "errors", F.explode("xs").alias("x"), "ys")
        bits = lambda y: F.bit_count(F.col("x").bitwiseXOR(y).bitwiseAND((1 << step) - 1))  # noqa: E731, B023
        # the last level has no use for nodes that meet themselves
        order = (lambda y: F.col("x") < y) if not below else (lambda y: F.col("x") <= y)
        near = F.filter("ys", lambda y: (F.col("errors") + bits(y) <= budget) & (~F.col("same") | order(y)))  # noqa: B023
        met = met.select("way", "x", "errors", F.explode(near).alias("y"))
        pairs = met.select("way", F.col("x").alias("left"), F.col("y").alias("right"), (F.col("errors") + bits(F.col("y"))).alias("errors"))
    return pairs.where("left <> right")


def near_fingerprints(prints: DataFrame, budget: int = 2) -> DataFrame:
    """(a, b), once each, for distinct fingerprints that differ in 1 to ``budget`` (2 at most) bits."""
    if not 0 <= budget <= 2:
        raise ValueError("the trie's ways hold for a budget of two bits at most")
    orders = [(*w, *(k for k in range(4) if k not in w)) for w in WAYS]
    fp = F.col("fingerprint")
    ways = F.array(*(F.struct(F.lit(i).alias("way"), _reordered(fp, o).alias("leaf")) for i, o in enumerate(orders)))
    found = _walk(prints.select("fingerprint").distinct().select(F.inline(ways)), 32, [8, 8, 8, 8], budget)
    # Back to fingerprints; a pair is taken from the first way whose two leading blocks agree.
    home = lambda c: F.element_at(F.array(*(_reordered(F.col(c), tuple(sorted(range(4), key=o.__getitem__))) for o in orders)), F.col("way") + 1)
    found = found.select("way", home("left").alias("a"), home("right").alias("b"))
    apart = [_block(F.col("a").bitwiseXOR(F.col("b")), k) != 0 for k in range(4)]
    first = F.lit(len(WAYS))
    for i, (j, k) in reversed(list(enumerate(WAYS))):
        first = F.when(~apart[j] & ~apart[k], i).otherwise(first)
    return found.where(F.col("way") == first).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def bit_error(similarity: float) -> float:
    """Chance that a fingerprint bit differs between texts whose shingle sets have this Jaccard similarity."""
    return math.acos(2 * similarity / (1 + similarity)) / math.pi


def plan_segments(n: int, similarity: float, recall: float) -> tuple[int, int]:
    """Bits of a segment and number of segments for n texts: few chance meetings, and ``recall`` of pairs that
    are just similar enough meet in a segment with one error at most.
    """
    bits, p = 2 * math.ceil((math.log2(max(n, 2)) + 6) / 2), bit_error(similarity)
    meet = (1 - p) ** bits + bits * p * (1 - p) ** (bits - 1)
    return bits, math.ceil(math.log(1 - recall) / math.log(1 - meet))


def wide_fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text", width: int = 5, seed: int = 42) -> DataFrame:
    """(id, row, key, prints): a hash of id and text, a digest of the shingle set, and fingerprints of ``words`` times 64 bits,
    from as many mixes of the hash of each distinct shingle."""

    def scan(batches):
        salts = [np.uint64((0x9E3779B97F4A7C15 * (2 * k + 1)) & 0xFFFFFFFFFFFFFFFF) for k in range(words)]

        def mixed(h, salt):
            h = (h ^ salt) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
            h *= np.uint64(0x94D049BB133111EB)
            return h ^ (h >> np.uint64(32))

        for batch in batches:
            keys, prints = [], []
            for t in column(batch, "text", pa.binary()):
                h = np.unique(shingle_hashes(t.as_py(), width, seed))
                keys.append(set_key(h))
                prints.append([majority(mixed(h, s)) for s in salts])
            yield pa.RecordBatch.from_arrays([column(batch, "id"), column(batch, "row"), pa.array(keys, pa.int64()), pa.array(prints, pa.list_(pa.int64()))], ["id", "row", "key", "prints"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), row_hash(id_col, text_col).alias("row"), text_or_empty(text_col).alias("text"))
    return named.mapInArrow(scan, "id long, row long, key long, prints array<long>")


def row_hash(id_col: str, text_col: str) -> Column:
    """What tells rows of the same or no id apart: a hash of id and text."""
    return F.xxhash64(F.col(id_col).cast("long"), text_or_empty(text_col))


def set_key(hashes: np.ndarray) -> int:
    """A digest of a shingle set, as a signed number."""
    return int(np.array([xxhash.xxh3_64_intdigest(hashes.tobytes())], np.uint64).view(np.int64)[0])


def shingle_sets(texts: DataFrame, width: int, seed: int) -> DataFrame:
    """(key, shingles) of texts(key, text): the distinct shingle hashes of each text that has this key."""

    def scan(batches):
        for batch in batches:
            sets = [np.unique(shingle_hashes(t.as_py(), width, seed)) for t in column(batch, "text", pa.binary())]
            own = [(k, h.view(np.int64)) for k, h in zip(column(batch, "key").to_pylist(), sets) if set_key(h) == k]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in own], pa.int64()), pa.array([x[1] for x in own], pa.list_(pa.int64()))], ["key", "shingles"])

    return texts.mapInArrow(scan, "key long, shingles array<long>")


def _segment(prints: Column, k: int, bits: int) -> Column:
    """Bits k * bits onward of an array of 64-bit words, as a number."""
    word, shift = divmod(k * bits, 64)
    out = F.shiftrightunsigned(prints[word], shift)
    if shift + bits > 64:
        out = out.bitwiseOR(F.shiftleft(prints[word + 1], 64 - shift))
    return out.bitwiseAND((1 << bits) - 1)


def _by_task(batches, read):
    """read(batch) of all rows of a task (a list of its parts), for rows that come in the order of ``task``."""
    held, open_ = [], None
    for batch in batches:
        tasks = column(batch, "task").to_numpy()
        bounds = [0, *(np.flatnonzero(tasks[1:] != tasks[:-1]) + 1).tolist(), len(tasks)]
        for begin, end in zip(bounds, bounds[1:]):
            if begin == end:
                continue
            if held and tasks[begin] != open_:
                yield open_, held
                held = []
            open_ = tasks[begin]
            held.append(read(batch.slice(begin, end - begin)))
    if held:
        yield open_, held


def shingle_counts(sets: DataFrame) -> DataFrame:
    """(key, size, counts) of sets(key, shingles): how many hashes end in the same bits, a byte each, at 255 most. There are about as many counts
    as hashes, ``COUNTS`` at most."""

    def scan(batches):
        for batch in batches:
            sizes, counts = [], []
            for h in column(batch, "shingles"):
                h = h.values.to_numpy()
                wide = min(max(1 << len(h).bit_length(), COUNTS[0]), COUNTS[1])
                sizes.append(len(h))
                counts.append(np.minimum(np.bincount(h & (wide - 1), minlength=wide), 255).astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([column(batch, "key"), pa.array(sizes, pa.int64()), pa.array(counts, pa.binary())], ["key", "size", "counts"])

    return sets.mapInArrow(scan, "key long, size long, counts binary")


def _can_be_similar(x: np.ndarray, y: np.ndarray, sizes: np.ndarray, counts: list[np.ndarray], similarity: float) -> np.ndarray:
    """Which of the pairs of places x, y may have a Jaccard similarity of ``similarity``: sets whose counts differ by d in all differ in d
    hashes at least, so none is lost."""
    out = np.minimum(sizes[x], sizes[y]) >= similarity * np.maximum(sizes[x], sizes[y])
    most = (1 - similarity) / (1 + similarity) * (sizes[x] + sizes[y]) + 1e-6
    wide = np.fromiter(map(len, counts), np.int64, len(counts))
    level = np.minimum(wide[x], wide[y])
    for m in np.unique(level[out]).tolist():
        own = np.flatnonzero(out & (level == m))
        used = np.unique(np.concatenate([x[own], y[own]]))
        table = np.stack([counts[k].reshape(-1, m).sum(axis=0, dtype=np.int16) for k in used.tolist()])
        for at in range(0, len(own), step := max(1, (1 << 21) // m)):
            part = own[at : at + step]
            apart = np.abs(table[np.searchsorted(used, x[part])] - table[np.searchsorted(used, y[part])]).sum(axis=1, dtype=np.int64)
            out[part] = apart <= most[part]
    return out


def _close_in_tasks(rows: DataFrame, limit: int, similarity: float) -> DataFrame:
    """(task, a, b): keys of different roots, in cells one bit apart at most, whose fingerprints differ in ``limit`` bits at most and whose counts
    don't rule the similarity out, for rows(task, side, way, rest, key, root, prints, size, counts). Side 0 meets side 1; rows of side 2 meet each other."""

    def scan(batches):
        def read(batch):
            prints, counts = column(batch, "prints"), [np.frombuffer(c.as_buffer(), np.uint8) for c in column(batch, "counts")]
            return [*(column(batch, c).to_numpy() for c in ("side", "way", "rest", "key", "root", "size")), prints.flatten().to_numpy().reshape(len(prints), -1).view(np.uint64)], counts

        for task, parts in _by_task(batches, read):
            side, way, rest, key, root, size, prints = (np.concatenate(c) for c in zip(*(p[0] for p in parts)))
            counts = [c for p in parts for c in p[1]]
            xs, ys = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
            for at in range(0, len(xs), BLOCK):
                x = xs[at : at + BLOCK]
                for beside in range(0, len(ys), BLOCK):
                    y = ys[beside : beside + BLOCK]
                    bits = np.bitwise_count(rest[x][:, None] ^ rest[y][None, :])
                    # members of one cell meet where the first half is shared
                    i, j = np.nonzero((bits <= 1) & (bits >= way[0]) & (root[x][:, None] != root[y][None, :]))
                    one, two = x[i], y[j]
                    once = (side[one] != 2) | (one < two)
                    one, two = one[once], two[once]
                    apart = np.zeros(len(one), np.int64)
                    for w in range(prints.shape[1]):
                        apart += np.bitwise_count(prints[one, w] ^ prints[two, w])
                    one, two = one[apart <= limit], two[apart <= limit]
                    alike = _can_be_similar(one, two, size, counts, similarity)
                    if alike.any():
                        a, b = key[one[alike]], key[two[alike]]
                        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), task)), pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["task", "a", "b"])

    return rows.repartition("task").sortWithinPartitions("task").mapInArrow(scan, "task long, a long, b long")


def _alike_in_tasks(close: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """(a, b) of close(task, a, b) whose sets are similar. A task's sets come to it once."""
    sides = close.select("task", F.explode(F.array("a", "b")).alias("a")).distinct().join(sets.withColumnRenamed("key", "a"), "a")
    rows = sides.select("task", "a", F.lit(None).cast("long").alias("b"), "shingles").union(close.select("task", "a", "b", F.lit(None).cast("array<long>")))

    def scan(batches):
        def read(batch):
            a, b, shingles = column(batch, "a").to_numpy(), column(batch, "b"), column(batch, "shingles")
            if b.null_count == 0:
                return {}, np.stack([a, b.to_numpy()], axis=1)
            own = b.is_null().to_numpy(zero_copy_only=False)
            return {int(a[i]): shingles[i].values.to_numpy() for i in np.flatnonzero(own).tolist()}, np.stack([a, b.fill_null(0).to_numpy()], axis=1)[~own]

        for _, parts in _by_task(batches, read):
            known = {k: v for p in parts for k, v in p[0].items()}
            pairs = [(int(a), int(b)) for p in parts for a, b in p[1]]
            found = []
            for a, b in pairs:
                x, y = known[a], known[b]
                if min(len(x), len(y)) >= similarity * max(len(x), len(y)):
                    common = len(np.intersect1d(x, y, assume_unique=True))
                    if common >= similarity * (len(x) + len(y) - common):
                        found.append((a, b))
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    return rows.repartition("task").sortWithinPartitions("task", F.col("b").asc_nulls_first()).mapInArrow(scan, "a long, b long")


def _rest_of_cells(held: DataFrame, groups: DataFrame, met: DataFrame, roots: DataFrame, half: int, stand: int | None) -> DataFrame:
    """(segment, way, shared, rest, key, root): members of cells that meet, or of one cell, and that the links of the heads leave in different components.

    held: (key, segment, value); met: (segment, left, right). Cells that meet have the first or the second half of their bits in common (way 0
    or 1), so those that share a half come together, and a member stands there once a way, however many cells its own meets. With ``stand``, of
    a component with more members in a cell about so many stand for it there, others in every cell.
    """
    sizes = groups.select("segment", "value", "size")
    alone = sizes.where("size > 2").select("segment", F.col("value").alias("left"), F.col("value").alias("right"))
    size_of = lambda c: sizes.select("segment", F.col("value").alias(c), F.col("size").alias(f"{c}_size"))
    crowd = met.join(size_of("left"), ["segment", "left"]).join(size_of("right"), ["segment", "right"]).where("left_size + right_size > 2").select("segment", "left", "right")
    pairs = materialise(alone.union(crowd))
    wanted = pairs.select("segment", F.explode(F.array("left", "right")).alias("value")).distinct()
    cell = ["segment", "value"]
    members = held.join(wanted, cell, "left_semi").join(roots, "key", "left").select(*cell, "key", F.coalesce("root", "key").alias("root"))
    members = materialise(members)
    if stand:
        large = members.groupBy(*cell, "root").agg(F.count(F.lit(1)).alias("own")).where(F.col("own") > stand)
        chosen = F.pmod(F.xxhash64("segment", "key"), F.ceil(F.col("own") / stand)) == 0
        members = materialise(members.join(large, [*cell, "root"], "left").where(F.col("own").isNull() | chosen).drop("own"))
    spread = materialise(members.groupBy(*cell).agg(F.min("root").alias("least"), F.max("root").alias("most")))
    side = lambda c: spread.select("segment", F.col("value").alias(c), F.col("least").alias(f"{c}_least"), F.col("most").alias(f"{c}_most"))
    pairs = pairs.join(side("left"), ["segment", "left"]).join(side("right"), ["segment", "right"]).where("least(left_least, right_least) <> greatest(left_most, right_most)")
    first, second = (lambda c: F.shiftright(c, half)), (lambda c: F.col(c).bitwiseAND((1 << half) - 1))
    way = F.when(first("left") == first("right"), 0).otherwise(1)
    wanted = pairs.select("segment", way.alias("way"), F.explode(F.array("left", "right")).alias("value")).distinct()
    shared, rest = (F.when(F.col("way") == k, first("value")).otherwise(second("value")) for k in (0, 1))
    return materialise(members.join(wanted, cell).select("segment", "way", shared.alias("shared"), rest.alias("rest"), "key", "root"))


def _tasks_of(members: DataFrame) -> DataFrame:
    """(task, side, way, rest, key, root) of members(segment, way, shared, rest, key, root): what shares a half of a segment meets in a task.

    More than ``TASK`` members are cut in blocks, and a task compares two of them. A component with more members there has blocks of its own, as
    those needn't meet, and the blocks of the others are counted without it.
    """
    group = ["segment", "way", "shared"]
    own = materialise(members.groupBy(*group, "root").agg(F.count(F.lit(1)).alias("own")))
    others = own.groupBy(*group).agg(F.sum(F.when(F.col("own") <= TASK, F.col("own")).otherwise(0)).alias("others"))
    parts = lambda c: F.greatest(F.ceil(F.col(c) / TASK), F.lit(1))
    block = F.when(F.col("own") > TASK, F.xxhash64("root", F.pmod("key", parts("own")))).otherwise(F.pmod(F.xxhash64("root"), parts("others")))
    members = materialise(members.join(own.join(others, group), [*group, "root"]).select(*group, "rest", "key", "root", block.alias("block")))
    blocks = materialise(members.groupBy(*group, "block").agg(F.min("root").alias("least"), F.max("root").alias("most")))
    side = lambda c: blocks.select(*group, F.col("block").alias(c), F.col("least").alias(f"{c}_least"), F.col("most").alias(f"{c}_most"))
    pairs = side("left").join(side("right"), group).where("left <= right and least(left_least, right_least) <> greatest(left_most, right_most)")
    itself = F.col("left") == F.col("right")
    sides = pairs.withColumn("task", F.xxhash64(*group, "left", "right")).select(*group, "task", F.inline(F.when(itself, F.array(F.struct(F.col("left").alias("block"), F.lit(2).alias("side")))).otherwise(
        F.array(F.struct(F.col("left").alias("block"), F.lit(0).alias("side")), F.struct(F.col("right").alias("block"), F.lit(1).alias("side")))
    )))
    return sides.join(members, [*group, "block"]).select("task", "side", "way", "rest", "key", "root")


def similar_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, similarity: float = 0.8, recall: float = 0.95, seed: int = 42, stand: int | None = None) -> DataFrame:
    """One row per row of docs: id, row (``row_hash``), component, component_id and kept, linking texts whose shingle sets have
    a Jaccard similarity of ``similarity``. Of a component the smallest id is kept; of equal ones, or where all are null, one text. Rows that repeat whole
    share their fate.

    Fingerprints have several segments. For each segment a trie is walked in node pairs with a budget of one bit,
    from either half of the segment equal; what meets there and differs in no more bits over the whole fingerprints
    than a similarity lower by 0.1 would allow is compared exactly, by shingle sets. First the texts of a cell (equal
    segments) are compared with its head, and the heads of cells one bit apart with each other, so a large group of
    copies is linked by a comparison a segment each. Then all members of these cells that are still in different
    components are compared: as many comparisons as a cell has pairs, if few of its texts are similar, but all of it in tasks that get a member twice a
    segment (in blocks where more than ``TASK`` share a half of it) and give back only pairs that counts of the shingles don't rule out. With ``stand`` a component with more
    texts in a cell is met there through so many of them, picked anew in each cell: less work, and links may be lost. Texts
    of equal shingle sets are one. Texts are told apart by ``row``, so ids may repeat or be null. Texts without words are linked with each
    other only.
    """
    n = docs.count()
    bits, segments = plan_segments(n, similarity, recall)
    words = -(-segments * bits // 64)
    limit = int(bit_error(similarity - 0.1) * 64 * words)
    rows = materialise(wide_fingerprints(docs, words, id_col, text_col, width, seed))
    classes = materialise(rows.groupBy("key").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("least"), F.count(F.lit(1)).alias("times"), F.first("prints").alias("prints")))
    half = bits // 2
    cells = F.array(*(F.struct(F.lit(k).alias("segment"), _segment(F.col("prints"), k, bits).alias("value")) for k in range(segments)))
    held = materialise(classes.select("key", F.inline(cells)))
    groups = materialise(held.groupBy("segment", "value").agg(F.min("key").alias("head"), F.count(F.lit(1)).alias("size")))
    turned = F.shiftright("value", half).bitwiseOR(F.shiftleft(F.col("value").bitwiseAND((1 << half) - 1), half))
    leaves = groups.select(F.inline(F.array(F.struct((F.col("segment") * 2).alias("way"), F.col("value").alias("leaf")), F.struct((F.col("segment") * 2 + 1).alias("way"), turned.alias("leaf")))))
    # Roots hold n / 2 ** half texts; up to a thousand are compared in one step, more are split first.
    steps = [half] if n >> half <= 1024 else [-(-half // 2), half // 2]
    met = _walk(leaves, half, steps, 1)
    back = lambda c: F.when(F.col("way") % 2 == 0, F.col(c)).otherwise(F.shiftright(c, half).bitwiseOR(F.shiftleft(F.col(c).bitwiseAND((1 << half) - 1), half)))
    met = materialise(met.select(F.floor(F.col("way") / 2).cast("int").alias("segment"), back("left").alias("left"), back("right").alias("right")))
    heads = groups.select("segment", "value", "head")
    first = met.join(heads.select("segment", F.col("value").alias("left"), F.col("head").alias("a")), ["segment", "left"]).join(heads.select("segment", F.col("value").alias("right"), F.col("head").alias("b")), ["segment", "right"])
    stars = held.join(groups.where("size > 1"), ["segment", "value"]).select(F.col("key").alias("a"), F.col("head").alias("b"))
    edges = first.select("a", "b").union(stars).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    p = classes.select("key", "prints")
    apart = F.aggregate(F.zip_with("x", "y", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, v: s + v)
    close = edges.join(p.select(F.col("key").alias("a"), F.col("prints").alias("x")), "a").join(p.select(F.col("key").alias("b"), F.col("prints").alias("y")), "b").where(apart <= limit).select("a", "b")
    close = materialise(close)
    # The exact check, for what is close: shingle sets, of one text each.
    texts = docs.select(row_hash(id_col, text_col).alias("row"), text_or_empty(text_col).alias("text"))

    def sets_of(keys: DataFrame) -> DataFrame:
        named = keys.distinct().join(classes.select("key", F.col("least.row").alias("row")), "key")
        return shingle_sets(texts.join(named, "row").select("key", "text"), width, seed).dropDuplicates(["key"])

    sets = sets_of(close.select(F.explode(F.array("a", "b")).alias("key")))
    both = close.join(sets.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(sets.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    common = F.size(F.array_intersect("x", "y"))
    links = materialise(both.where(common >= similarity * (F.size("x") + F.size("y") - common)).select("a", "b"))
    roots = materialise(components(links).select(F.col("vertex").alias("key"), "root"))
    # What the heads left apart.
    apart = _rest_of_cells(held, groups, met, roots, half, stand)
    sets = materialise(sets_of(apart.select("key")))
    known = materialise(p.join(shingle_counts(sets), "key"))
    close = _close_in_tasks(_tasks_of(apart).join(known, "key"), limit, similarity)
    close = materialise(close.groupBy("a", "b").agg(F.min("task").alias("task")).select("task", "a", "b"))
    more = materialise(_alike_in_tasks(close, sets, similarity))
    if not more.isEmpty():
        roots = components(links.union(more)).select(F.col("vertex").alias("key"), "root")
    named = materialise(classes.join(roots, "key", "left").select("key", "times", "least", F.coalesce("root", "key").alias("root")))
    heads = named.groupBy("root").agg(F.min("least").alias("head"), F.count(F.lit(1)).alias("keys"))
    member = materialise(join_counted(named, heads, ["root"], "keys", n).select("key", "times", "root", "head"))
    out = join_counted(rows.select("id", "row", "key"), member, ["key"], "times", n)
    return out.select("id", "row", F.col("root").alias("component"), F.col("head.id").alias("component_id"), (F.col("row") == F.col("head.row")).alias("kept"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, budget: int = 2, seed: int = 42) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links."""
    prints = materialise(fingerprints(docs, id_col, text_col, width, seed))
    classes = materialise(prints.groupBy("fingerprint").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("times")))
    member = components(near_fingerprints(classes, budget)).withColumnRenamed("vertex", "fingerprint")
    classes = classes.join(member, "fingerprint", "left").select("fingerprint", "least", "times", F.coalesce("root", "fingerprint").alias("root"))
    classes = materialise(classes)
    heads = classes.groupBy("root").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    n = prints.count()
    named = materialise(join_counted(classes, heads, ["root"], "prints", n).select("fingerprint", "times", "component_id"))
    return join_counted(prints, named, ["fingerprint"], "times", n).select("id", "fingerprint", "component_id")
