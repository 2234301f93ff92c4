"""Cost-balanced packing of documents into training sequences.

Documents are tokenized and cut into pieces of a sequence's length at most. Pieces are dealt by hash into shards
of a bounded number of bytes; rows that repeat are numbered, so they are dealt apart, and a task that runs again deals
its rows as before. In a shard, pieces go in descending order to the sequence of lowest cost that has
room for the whole piece, where a piece of n tokens costs ``linear * n + quadratic * n * n`` (attention). If none
has room for the whole, the piece is cut at the room of the cheapest sequence and the rest goes on.

A shard's sequences hold its tokens exactly: full ones, and for the remainder one for each power of two in it, so
none needs padding.

Defined results: a null text is an empty one and yields its end id alone; repeated rows are packed once each; a
null id stays null; an empty table yields no rows; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, slices, text_or_empty, total_bytes
from .tokens import encoder

PIECE = "id long, row long, start long, doc_tokens long, ids binary, shard long"
PACKED = "id long, start long, length long, doc_tokens long, ids binary, sequence_id long, offset long"


def capacities(tokens: int, length: int) -> list[int]:
    """Full sequences, and a power of two for each bit of the rest."""
    full, rest = divmod(tokens, length)
    return [length] * full + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def assign(lengths: np.ndarray, length: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """(piece, begin, end, sequence, offset) for pieces in the order given; every token of each piece once."""
    room = np.array(capacities(int(lengths.sum()), length), np.int64)
    cost = np.zeros(len(room))
    used = np.zeros(len(room), np.int64)
    out = []
    for piece in np.argsort(-lengths, kind="stable"):
        begin, end = 0, int(lengths[piece])
        while begin < end:
            left = end - begin
            open_cost = np.where(room >= left, cost, np.inf)
            at = int(open_cost.argmin())
            if open_cost[at] == np.inf:
                at = int(np.where(room > 0, cost, np.inf).argmin())
                left = int(room[at])
            out.append((int(piece), begin, begin + left, at, int(used[at])))
            room[at] -= left
            used[at] += left
            cost[at] += linear * left + quadratic * left * left
            begin += left
    return out


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 2, length: int = 4096,
    linear: float = 1.0, quadratic: float = 1.0 / 4096, shard_bytes: int = 4 << 20,
) -> DataFrame:
    """One row per piece: id, start, length, doc_tokens, ids (little-endian unsigned 32-bit), sequence_id, offset.

    ``length`` is a power of two. ``shard_bytes`` bounds the text of a shard and so the memory of a task.
    """
    shards = max(1, -(-total_bytes(docs, text_col) // shard_bytes))

    def cut(batches):
        enc = encoder(tokenizer)
        place, seen = TaskContext.get().partitionId(), {}

        def numbered(row: int) -> int:
            """A hash of the row, the task and how often the task has met the row."""
            seen[row] = times = seen.get(row, -1) + 1
            return hash((row, place, times))

        small = np.uint16 if max(enc.size, end_id + 1) <= 1 << 16 else np.uint32
        for batch in batches:
            ids, rows, texts = column(batch, "id"), column(batch, "row"), column(batch, "text", pa.string())
            for a, b in slices(texts):
                flat, counts = enc.encode(texts.slice(a, b - a))
                where = np.cumsum(counts)
                flat = np.insert(flat, where, end_id).astype(small)
                total = counts + 1
                n = -(-total // length)
                doc = np.repeat(np.arange(b - a), n)
                start = (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)) * length
                size = np.minimum(total[doc] - start, length)
                begin = np.cumsum(size) - size
                raw = flat.tobytes()
                k = small().itemsize
                blobs = [raw[x * k : (x + y) * k] for x, y in zip(begin.tolist(), size.tolist())]
                row = np.fromiter(map(numbered, rows.slice(a, b - a).to_pylist()), np.int64, b - a)[doc]
                # SplitMix-like mixing, so that the pieces of one long document spread over the shards
                key = (row.astype(np.uint64) ^ (start.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))) * np.uint64(0xBF58476D1CE4E5B9)
                key ^= key >> np.uint64(29)
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a).take(pa.array(doc)), pa.array(row), pa.array(start), pa.array(total[doc]), pa.array(blobs, pa.binary()), pa.array((key % np.uint64(shards)).astype(np.int64))],
                    ["id", "row", "start", "doc_tokens", "ids", "shard"],
                )
        enc.clear()

    def fill(table: pa.Table) -> pa.Table:
        table = table.sort_by([("row", "ascending"), ("start", "ascending")]).combine_chunks()
        blobs, starts = table["ids"].to_pylist(), table["start"].to_numpy()
        docs_, first = table["doc_tokens"], table["doc_tokens"].to_numpy() - starts
        k = 2 if len(blobs) and len(blobs[0]) == 2 * min(length, int(first[0])) else 4
        lengths = np.array([len(x) // k for x in blobs], np.int64)
        plan = assign(lengths, length, linear, quadratic)
        at = pa.array([p[0] for p in plan], pa.int64())
        kind = np.uint16 if k == 2 else np.uint32
        shard = table["shard"][0].as_py()
        return pa.table(
            {
                "id": table["id"].take(at),
                "start": pa.array([int(starts[p]) + x for p, x, *_ in plan], pa.int64()),
                "length": pa.array([y - x for _, x, y, *_ in plan], pa.int64()),
                "doc_tokens": docs_.take(at),
                "ids": pa.array([np.frombuffer(blobs[p], kind)[x:y].astype("<u4").tobytes() for p, x, y, *_ in plan], pa.binary()),
                "sequence_id": pa.array([(shard << 24) + s for *_, s, _ in plan], pa.int64()),
                "offset": pa.array([o for *_, o in plan], pa.int64()),
            }
        )

    text = text_or_empty(text_col)
    named = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(F.col(id_col), text).alias("row"), text.alias("text"))
    return named.mapInArrow(cut, PIECE).groupBy("shard").applyInArrow(fill, PACKED)
