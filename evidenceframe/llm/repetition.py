"""Quality rules on repetition: characters inside duplicated word n-grams and lines.

Words and lines are interned per text, so equal numbers mean equal words; a rolling hash over the numbers gives
each n-gram's hash for every n in one numpy pass, and grams found again are marked. For long n-grams (``SPANS``)
the characters inside a gram that the text held before are measured (what deduplication would remove), for short ones (``TOPS``) those of the
most frequent gram, for lines those of lines seen before.

Defined results: a null or empty text has no words and fails the base rule; repeated rows and null ids get a row
each; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column

SYMBOLS = b"#*$%&|<>"
#: Largest share of a text's word characters that may stand in the most frequent n-gram, by n.
TOPS = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest share that may stand in n-grams found before, by n.
SPANS = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share of lines that repeat an earlier one, with two such lines at least, and of characters in them.
LINES, LINE_CHARS = 0.30, 0.20
BASE = np.uint64(0x9E3779B97F4A7C15)


def _chars(data: bytes) -> int:
    """Code points of UTF-8 bytes."""
    return len(data.decode("utf-8", "replace")) if not data.isascii() else len(data)


def rolling(ids: np.ndarray, n: int, last: np.ndarray | None = None) -> np.ndarray:
    """Hash of each run of n numbers; last: that of each run of n - 1, which this rolls on from."""
    if last is None:
        last = ids.astype(np.uint64) + np.uint64(1)
        for k in range(2, n):
            last = rolling(ids, k, last)
        if n == 1:
            return last
    out = last[:-1] * BASE
    out ^= out >> np.uint64(32)
    out += ids[n - 1 :].astype(np.uint64) + np.uint64(1)
    return out * np.uint64(0xD6E8FEB86659FD93)


def measure(text: bytes) -> dict:
    words = text.split()
    n = len(words)
    index: dict[bytes, int] = {}
    ids = np.fromiter((index.setdefault(w, len(index)) for w in words), np.int64, n)
    if text.isascii():
        sizes = np.fromiter(map(len, words), np.int64, n)
    else:
        sizes = np.fromiter(map(len, text.decode("utf-8", "replace").translate(BREAKS).split(" ")), np.int64)
        sizes = sizes[sizes > 0]
    chars = int(sizes.sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    seen: set[bytes] = set()
    dup_lines = dup_line_chars = 0
    for line in lines:
        if line in seen:
            dup_lines += 1
            dup_line_chars += _chars(b"".join(line.split()))
        seen.add(line)
    out = {"n_words": n, "word_chars": chars, "n_symbols": len(text) - len(text.translate(None, SYMBOLS)), "n_lines": len(lines), "n_dup_lines": dup_lines, "n_repeat_words": 0, "dup_line_chars": dup_line_chars}
    tops, spans = dict.fromkeys(TOPS, 0), dict.fromkeys(SPANS, 0)
    ends = np.concatenate([[0], np.cumsum(sizes)])
    hashes, again = None, True
    for k in range(2, max(SPANS) + 1):
        if n < k or not again:
            break
        hashes = rolling(ids, k, hashes)
        order = np.argsort(hashes, kind="stable")
        by = hashes[order]
        fresh = np.flatnonzero(np.concatenate([[True], by[1:] != by[:-1]]))
        counts = np.diff(np.concatenate([fresh, [len(by)]]))
        again = bool((counts > 1).any())  # no gram repeats: no longer one does
        if not again:
            break
        if k in TOPS:
            # the most frequent gram; of several the one with most characters; overlaps count once
            first = order[fresh]
            weight = ends[first + k] - ends[first]
            best = np.lexsort((first, -weight, -counts))[0]
            where = np.sort(order[fresh[best] : fresh[best] + counts[best]])
            tops[k] = _covered(where, k, ends) if counts[best] > 1 else 0
        if k in SPANS or k == 3:
            if k in SPANS:
                later = np.ones(len(order), bool)
                later[fresh] = False
                spans[k] = _covered(np.sort(order[later]), k, ends)
            if k == 3:
                where = np.sort(order[np.repeat(counts > 1, counts)])
                out["n_repeat_words"] = _covered(where, k, np.arange(n + 1))
    share = lambda x: x / chars if chars else 0.0
    out["top_chars"] = [tops[k] for k in TOPS]
    out["span_chars"] = [spans[k] for k in SPANS]
    out["line_share"] = dup_lines / len(lines) if lines else 0.0
    out["base_failed"] = n < 50 or 100 * out["n_repeat_words"] > 50 * n
    out["kept"] = not (
        out["base_failed"] or (dup_lines > 1 and out["line_share"] > LINES) or share(dup_line_chars) > LINE_CHARS
        or any(share(tops[k]) > t for k, t in TOPS.items()) or any(share(spans[k]) > t for k, t in SPANS.items())
    )
    return out


BREAKS = {c: " " for c in range(9, 14)}


def _covered(where: np.ndarray, k: int, ends: np.ndarray) -> int:
    """Total of the words inside runs of k words at these places (ascending), each word once."""
    if not len(where):
        return 0
    stop = where + k
    begin = np.maximum(where, np.concatenate([[0], stop[:-1]]))
    return int((ends[stop] - ends[begin]).sum())


FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_lines": "long", "n_dup_lines": "long", "n_repeat_words": "long", "dup_line_chars": "long",
    "top_chars": "array<long>", "span_chars": "array<long>", "line_share": "double", "base_failed": "boolean", "kept": "boolean",
}
ARROW = {"long": pa.int64(), "array<long>": pa.list_(pa.int64()), "double": pa.float64(), "boolean": pa.bool_()}


def repetition(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id and the measures; ``kept`` is the verdict."""

    def scan(batches):
        for batch in batches:
            found = [measure(t.as_py() or b"") for t in column(batch, "text", pa.binary())]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), *(pa.array([x[k] for x in found], ARROW[kind]) for k, kind in FIELDS.items())], ["id", *FIELDS])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(scan, "id long, " + ", ".join(f"{k} {kind}" for k, kind in FIELDS.items()))
