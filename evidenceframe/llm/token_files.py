"""Token-id files compressed by Re-Pair grammars.

Documents are dealt into ranges of ascending id; each task writes its ids as shards of a bounded number of
tokens. In a shard, frequent adjacent id pairs are replaced by nonterminals, round after round, until no pair is left that
pays for a rule; the rules and every nonterminal's expansion length are stored, so a run of ids is decoded
without expanding what precedes it. No rule holds the end id, so no nonterminal crosses a document's end.

Pairs are counted exactly. A round replaces all pairs that occur ``least`` times or more, the more frequent first where they
overlap. A count can grow only by a new symbol, so later rounds look at the places beside new symbols and at those of
frequent pairs that lost to others, not at the whole shard. A pair with a rule is replaced wherever it is left.

A shard is one row of a Parquet table in the shared folder: its place (part, shard), its counts and its bytes.

File format (little-endian): magic ``RPR2``; then, unsigned 32-bit, first nonterminal, number of rules, of symbols, of documents,
bits of a symbol (16 or more) and bytes of an expansion length (2 or 4); rules as pairs; expansion lengths of the
nonterminals; tokens of each document (32-bit); the symbols. Symbols, in rules too, stand as their low 16 bits, then a plane of
packed bits for each higher bit.

Defined results: a null text is an empty one (its end id alone); null ids come first; repeated rows stay, next to
each other; an empty table gives no shards; other columns are ignored.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import column, scratch_dir, slices, text_or_empty, total_bytes
from .tokens import encoder

SHARDS = "part long, shard long, n_docs long, n_tokens long, doc_ids array<long>, data binary"
MAGIC, HEAD = b"RPR2", "<4s6I"
#: Bits of the table of counts that tells rare pairs apart before pairs are sorted.
BINS = 20


def _slot(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    h = left * np.uint32(0x9E3779B1) + right * np.uint32(0x85EBCA77)
    h ^= h >> np.uint32(15)
    h *= np.uint32(0x2C1B3C6D)
    return h >> np.uint32(32 - BINS)


def _stay(pick: np.ndarray, here: np.ndarray, before: np.ndarray, after: np.ndarray, rank: np.ndarray, twice: np.ndarray) -> np.ndarray:
    """Which of the pairs that begin ``here`` can be replaced side by side: none beside it is more frequent; of a run of one
    symbol every second."""
    rank[here] = pick + 1
    left, right = rank.take(before[here]), rank.take(after[here])  # by 32-bit places, take is the faster way
    stay = (pick + 1 > left) & (pick + 1 > right)
    t = np.flatnonzero(twice.take(pick))
    if len(t):
        at, own = here[t], pick[t]
        begins = np.flatnonzero(np.concatenate([[True], (after[at[:-1]] != at[1:]) | (own[1:] != own[:-1])]))
        place = np.arange(len(t)) - np.repeat(begins, np.diff(np.append(begins, len(t))))
        stay[t] = (place % 2 == 0) & (left[t] <= own + 1) & (right[t] <= own + 1)
    rank[here] = 0
    return stay


def repair(ids: np.ndarray, end_id: int, first: int, least: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Symbols and rules (left, right) of a Re-Pair grammar; rule k makes nonterminal ``first + k``.

    A rule takes about the room of three symbols, so a pair pays for it from four occurrences on.
    """
    n = len(ids)
    seq = np.append(ids, end_id).astype(np.uint32)  # an end id stands behind the last place
    after, before = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32)
    whole, rank = np.ones(n + 1, bool), np.zeros(n + 1, np.int32)
    whole[n], dead = False, 0
    rules, slots = np.zeros(0, np.int64), np.zeros(1 << BINS, bool)
    alive = np.flatnonzero((seq[:-1] != end_id) & (seq[1:] != end_id))
    while len(alive):
        left, right = seq[alive], seq.take(after[alive])
        if len(alive) >= 1 << BINS - 4:
            slot = _slot(left, right)
            enough = ((np.bincount(slot, minlength=1 << BINS) >= least) | slots).take(slot)
            alive, left, right = alive[enough], left[enough], right[enough]
        # Pairs and their places in one number each, which sorts faster than places by pairs.
        wide, deep = (first + len(rules)).bit_length(), len(alive).bit_length()
        if 2 * wide + deep < 64:
            key = np.sort((((left.astype(np.int64) << wide) | right) << deep) | np.arange(len(alive)))
            order = key & ((1 << deep) - 1)
            key >>= deep
        else:
            wide, key = 32, (left.astype(np.int64) << 32) | right
            order = np.argsort(key)
            key = key[order]
        begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else order
        pairs, counts = key[begins], np.diff(np.append(begins, len(key)))
        pairs = ((pairs >> wide) << 32) | (pairs & ((1 << wide) - 1))
        # Pairs that have a rule already pay at once.
        sorter = np.argsort(rules)
        found = np.searchsorted(rules, pairs, sorter=sorter)
        old = np.append(sorter, -1)[found]
        old = np.where((old >= 0) & (np.append(rules, -1)[old] == pairs), old, -1)
        by = np.argsort(counts, kind="stable")
        by = by[(counts[by] >= least) | (old[by] >= 0)]
        if not len(by):
            break
        place = np.full(len(pairs), -1, np.int32)
        place[by] = np.arange(len(by))
        pick = np.empty(len(alive), np.int32)
        pick[order] = np.repeat(place, counts)
        here, pick = alive[pick >= 0], pick[pick >= 0]
        pairs, old = pairs[by], old[by]
        twice = (pairs >> 32) == (pairs & 0xFFFFFFFF)
        while True:
            stay = _stay(pick, here, before, after, rank, twice)
            hits = np.bincount(pick[stay], minlength=len(pairs))
            good = (hits >= least) | ((old >= 0) & (hits > 0))
            apart = ~twice.take(pick)
            if good.any() or apart.all():
                break
            here, pick = here[apart], pick[apart]  # runs of one symbol kept the others from being replaced
        if not good.any():
            break
        fresh = good & (old < 0)
        number = np.where(old >= 0, old, len(rules) + np.cumsum(fresh) - 1) + first
        use = stay & good.take(pick)
        at = here[use]
        seq[at] = number.take(pick[use])
        gone = after[at]
        whole[gone] = False
        after[at] = after[gone]
        before[after[at]] = at
        rules = np.append(rules, pairs[fresh])
        slots[_slot((pairs[fresh] >> 32).astype(np.uint32), pairs[fresh].astype(np.uint32))] = True
        look = np.zeros(n + 1, bool)
        if (again := number[good & (old >= 0)]).size:  # a symbol that is made anew joins those made before
            is_again = np.zeros(first + len(rules), bool)
            is_again[again] = True
            at = np.concatenate([at, np.flatnonzero(is_again.take(seq) & whole)])
        look[at] = look[before[at]] = look[here[~use]] = True
        look &= whole
        dead += len(gone)
        if 4 * dead > n:  # symbols move together, so that rounds touch no more room than what is left
            seq, look = np.append(seq[whole], np.uint32(end_id)), np.append(look[whole], False)
            n, dead = n - dead, 0
            after, before, whole, rank = after[: n + 1], before[: n + 1], whole[: n + 1], rank[: n + 1]
            after[:], before[:], whole[:] = np.arange(1, n + 2, dtype=np.int32), np.arange(-1, n, dtype=np.int32), True
            whole[n] = False
        alive = np.flatnonzero(look)
        alive = alive[(seq[alive] != end_id) & (seq.take(after[alive]) != end_id)]
    return seq[whole], np.stack([rules >> 32, rules & 0xFFFFFFFF], axis=1).astype(np.uint32)


def expansion_lengths(rules: np.ndarray, first: int) -> np.ndarray:
    """Ids that each nonterminal stands for."""
    out = np.ones(first + len(rules), np.int64)
    for k, (a, b) in enumerate(rules.tolist()):
        out[first + k] = out[a] + out[b]
    return out[first:]


def pack_symbols(symbols: np.ndarray, bits: int) -> bytes:
    """The low 16 bits of each, then a plane of packed bits for each bit above."""
    return b"".join([symbols.astype("<u2").tobytes(), *(np.packbits((symbols >> np.uint32(k)) & np.uint32(1)).tobytes() for k in range(16, bits))])


def unpack_symbols(data: bytes, at: int, count: int, bits: int) -> tuple[np.ndarray, int]:
    """The symbols that stand at a place, and where they end."""
    out, at, plane = np.frombuffer(data, "<u2", count, at).astype(np.uint32), at + 2 * count, -(-count // 8)
    for k in range(16, bits):
        out |= np.unpackbits(np.frombuffer(data, np.uint8, plane, at), count=count).astype(np.uint32) << np.uint32(k)
        at += plane
    return out, at


def pack_shard(ids: np.ndarray, doc_tokens: np.ndarray, end_id: int, vocabulary: int) -> bytes:
    seq, rules = repair(ids, end_id, vocabulary)
    bits = max(16, (vocabulary + len(rules) - 1).bit_length())
    lengths = expansion_lengths(rules, vocabulary)
    wide = 2 if not len(rules) or lengths.max() < 1 << 16 else 4
    head = struct.pack(HEAD, MAGIC, vocabulary, len(rules), len(seq), len(doc_tokens), bits, wide)
    return head + pack_symbols(rules.ravel(), bits) + lengths.astype(f"<u{wide}").tobytes() + doc_tokens.astype("<u4").tobytes() + pack_symbols(seq, bits)


class Shard:
    """A shard's bytes, opened for reading."""

    def __init__(self, data: bytes):
        magic, self.first, n_rules, n_seq, n_docs, bits, wide = struct.unpack_from(HEAD, data)
        if magic != MAGIC:
            raise ValueError("not a token shard")
        rules, at = unpack_symbols(data, struct.calcsize(HEAD), 2 * n_rules, bits)
        self.rules = rules.reshape(-1, 2)
        self.lengths = np.frombuffer(data, f"<u{wide}", n_rules, at)
        at += wide * n_rules
        self.doc_tokens = np.frombuffer(data, "<u4", n_docs, at).astype(np.int64)
        self.seq, _ = unpack_symbols(data, at + 4 * n_docs, n_seq, bits)
        self._ends = None

    def _expand(self, seq: np.ndarray) -> np.ndarray:
        while len(seq) and (nt := seq >= self.first).any():
            out = np.repeat(seq, 1 + nt)
            where = np.flatnonzero(nt)
            at = where + np.arange(len(where))
            pair = self.rules[seq[where] - self.first]
            out[at], out[at + 1] = pair[:, 0], pair[:, 1]
            seq = out
        return seq

    def all(self) -> np.ndarray:
        """All ids. Each nonterminal is expanded once, and what the symbols stand for is taken from there."""
        total, made = int(self.doc_tokens.sum()), int(self.lengths.sum(dtype=np.int64))
        if made > 2 * total:
            return self._expand(self.seq)
        pool = np.concatenate([np.arange(self.first, dtype=np.uint32), self._expand(np.arange(self.first, self.first + len(self.rules), dtype=np.uint32))])
        sizes = np.concatenate([np.ones(self.first, np.int64), self.lengths])
        begins = np.cumsum(sizes) - sizes
        size = sizes.take(self.seq)
        where = np.repeat(begins.take(self.seq) - (np.cumsum(size) - size), size)
        where += np.arange(len(where))
        return pool[where]

    def read(self, start: int, count: int) -> np.ndarray:
        """ids[start:start + count]; only the symbols that cover them are expanded."""
        if self._ends is None:
            size = np.ones(len(self.seq), np.int64)
            nt = self.seq >= self.first
            size[nt] = self.lengths[self.seq[nt] - self.first]
            self._ends = np.cumsum(size)
        a = int(np.searchsorted(self._ends, start, side="right"))
        b = int(np.searchsorted(self._ends, start + count, side="left")) + 1
        before = int(self._ends[a - 1]) if a else 0
        return self._expand(self.seq[a:b])[start - before : start - before + count]

    def document(self, k: int) -> np.ndarray:
        return self.read(int(self.doc_tokens[:k].sum()), int(self.doc_tokens[k]))


def write_token_files(
    docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 0,
    shard_tokens: int = 1_000_000, part_bytes: int = 32 << 20,
) -> None:
    """Write the ids of all documents, in ascending order of id, as shards under ``path``.

    A shard ends with the document that reaches ``shard_tokens``; ``part_bytes`` is about a task's share of text.
    """
    parts = max(1, -(-total_bytes(docs, text_col) // part_bytes))

    def encode(batches):
        enc = encoder(tokenizer)
        part, shard = TaskContext.get().partitionId(), 0
        ids, sizes, doc_ids = np.zeros(0, np.uint32), np.zeros(0, np.int64), []

        def close(flat, counts, names):
            data = pack_shard(flat, counts, end_id, enc.size)
            return pa.RecordBatch.from_arrays(
                [pa.array([x], t) for x, t in ((part, pa.int64()), (shard, pa.int64()), (len(counts), pa.int64()), (len(flat), pa.int64()), (names, pa.list_(pa.int64())), (data, pa.binary()))],
                ["part", "shard", "n_docs", "n_tokens", "doc_ids", "data"],
            )

        for batch in batches:
            keys, texts = column(batch, "id"), column(batch, "text", pa.string())
            for a, b in slices(texts, 16 << 20):
                flat, counts = enc.encode(texts.slice(a, b - a))
                ids = np.concatenate([ids, np.insert(flat, np.cumsum(counts), end_id)])
                sizes = np.concatenate([sizes, counts + 1])
                doc_ids = doc_ids + keys.slice(a, b - a).to_pylist()
                del flat
                ends, begin, done = np.cumsum(sizes), 0, 0
                while ends[-1] - done >= shard_tokens:
                    end = int(np.searchsorted(ends, done + shard_tokens)) + 1
                    yield close(ids[done : ends[end - 1]], sizes[begin:end], doc_ids[begin:end])
                    shard, begin, done = shard + 1, end, int(ends[end - 1])
                ids, sizes, doc_ids = ids[done:].copy(), sizes[begin:], doc_ids[begin:]
        if len(sizes):
            yield close(ids, sizes, doc_ids)

    named = docs.select(F.col(id_col).cast("long").alias("id"), text_or_empty(text_col).alias("text"))
    ranged = named.repartitionByRange(parts, "id").sortWithinPartitions("id", "text")
    ranged.mapInArrow(encode, SHARDS).write.parquet(path)


def read_token_files(spark, path: str) -> DataFrame:
    """One row per document, decoded from the files: id, start (ids before it), n_tokens, ids (unsigned 32-bit)."""
    return _offsets(spark, path, "ids binary", lambda ids: ids.astype("<u4").tobytes(), pa.binary())


def read_token_digests(spark, path: str) -> DataFrame:
    """As read_token_files, with ids_crc32 in place of the ids."""
    return _offsets(spark, path, "ids_crc32 long", lambda ids: zlib.crc32(ids.astype("<u4").tobytes()), pa.int64())


def _offsets(spark, path: str, field: str, value, kind: pa.DataType) -> DataFrame:
    files = spark.read.parquet(path)
    name = field.split()[0]

    def decode(batches):
        for batch in batches:
            for row in batch.to_pylist():
                shard = Shard(row["data"])
                flat, ends = shard.all(), np.cumsum(shard.doc_tokens)
                begins = ends - shard.doc_tokens
                n = len(ends)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["part"]] * n, pa.int64()), pa.array([row["shard"]] * n, pa.int64()), pa.array(row["doc_ids"], pa.int64()), pa.array(begins), pa.array(shard.doc_tokens), pa.array([value(flat[x:y]) for x, y in zip(begins.tolist(), ends.tolist())], kind)],
                    ["part", "shard", "id", "begin", "n_tokens", name],
                )

    # Ids before a shard: those of earlier parts and those of earlier shards in its part; parts are few.
    sizes = files.select("part", "shard", "n_tokens")
    parts = sizes.groupBy("part").agg(F.sum("n_tokens").alias("tokens"))
    before = F.sum("tokens").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("part_start"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    places = sizes.select("part", "shard", F.coalesce(within, F.lit(0)).alias("shard_start")).join(parts, "part")
    rows = files.mapInArrow(decode, f"part long, shard long, id long, begin long, n_tokens long, {field}")
    return rows.join(places, ["part", "shard"]).select("id", (F.col("part_start") + F.col("shard_start") + F.col("begin")).alias("start"), "n_tokens", name)


def token_table_path(spark) -> str:
    return scratch_dir(spark)
