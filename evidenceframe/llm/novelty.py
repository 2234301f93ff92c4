"""Secrets: fixed patterns, and strings in a sensitive context that zstandard can't shorten.

The base kinds are patterns. The method adds ``novel`` spans: a run of key characters, with letters and digits or letters of both cases, that stands soon after a
sensitive word on its line is a candidate, and its novelty is the number of bytes by which it lengthens the compressed surroundings,
per byte of its own. The compressor is primed with a dictionary: the corpus' most frequent word parts, counted over
all texts, and a fixed list of code words and placeholders. Identifiers are put together from these and cost little; random strings cost all of their bytes.

The dictionary is bounded by its size in bytes (``size``), so it travels with the tasks; counts are summed in the tasks before they are shuffled.

Defined results: a null or empty text has no spans; repeated rows and null ids get a row each; an empty table gives no rows; places are code points, an end is
the place after; a candidate that overlaps a base span is left to it, and of sensitive words that reach one candidate it takes one; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import column

#: Fixed patterns, and the least length: of group 2 for an assignment, else of the match.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
BASE = (("assign", ASSIGN, 2, 12), ("access", ACCESS, 0, 18), ("hex", HEX, 0, 16))
KINDS = [kind for kind, *_ in BASE] + ["novel"]

#: Words that make what follows sensitive.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase|code)|pwd|secret|token|(?:api|access|private|encryption|signing|account)[ _-]?key|auth|bearer|credential|signature|session[ _-]?id", re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{16,}={0,2}")
#: Code points from a sensitive word to its candidate, and of the surroundings on both sides.
REACH, AROUND = 64, 128
#: Least novelty, in compressed bytes a byte.
NOVELTY = 0.8
PART = re.compile(r"[^\W\d_]{3,24}")
#: Words of code and placeholders that stand in every dictionary.
CODE = (
    "import from class def return function const public private static void string int self this null true false None async await export default require module "
    "password secret token api_key access_key client_id client_secret authorization bearer credentials username session signature certificate config settings environment database connection url host port "
    "https://www.example.com/api/v1/oauth2/token org net test sample placeholder changeme your_token_here your_api_key_here insert_your_secret_here "
    "xxxxxxxxxxxxxxxxxxxxxxxxxxxxxxxx 00000000000000000000000000000000 0123456789abcdef0123456789ABCDEF abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 1234567890 process.env os.environ getenv"
)


def word_parts(docs: DataFrame, text_col: str = "text", held: int = 200_000) -> DataFrame:
    """(part, n): runs of letters, lower-cased, of all texts; a task sums up to ``held`` of them at a time."""

    def count(batches):
        counts: Counter[str] = Counter()

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(counts.keys(), pa.string()), pa.array(counts.values(), pa.int64())], ["part", "n"])
            counts.clear()
            return out

        for batch in batches:
            for text in column(batch, "text"):
                counts.update(PART.findall((text.as_py() or "").lower()))
                if len(counts) > held:
                    yield flush()
        yield flush()

    parts = docs.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "part string, n long")
    return parts.groupBy("part").agg(F.sum("n").alias("n"))


def dictionary(docs: DataFrame, text_col: str = "text", size: int = 32 << 10) -> bytes:
    """The most frequent parts that fill ``size`` bytes, the most frequent last, then the code words."""
    room = size - len(CODE) - 1
    first = word_parts(docs, text_col).orderBy(F.desc("n"), "part").limit(max(1, room // 4))  # a part has three letters and a blank at least
    parts, used = [], 0
    for part in (r["part"] for r in first.collect()):
        used += len(part.encode()) + 1
        if used > room:
            break
        parts.append(part)
    return " ".join([*reversed(parts), CODE]).encode()


class Meter:
    """Marginal compressed bytes under a dictionary."""

    def __init__(self, primed: bytes, level: int = 19):
        held = zstandard.ZstdCompressionDict(primed, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(level=level)
        self.compressor = zstandard.ZstdCompressor(level=level, dict_data=held, write_content_size=False, write_checksum=False, write_dict_id=False)

    def size(self, text: str) -> int:
        return len(self.compressor.compress(text.encode("utf-8", "replace")))

    def novelty(self, before: str, candidate: str, after: str) -> float:
        """Bytes a byte that the candidate adds to its surroundings: as it stands, or lower-cased with its parts apart if that is less.

        A copy of the candidate nearby doesn't make it known.
        """
        before, after = before.replace(candidate, ""), after.replace(candidate, "")
        apart = re.sub(r"[_/+-]+", " ", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", candidate)).lower()
        alone = self.size(before + after)
        return min(self.size(before + form + after) - alone for form in (candidate, apart)) / len(candidate)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Matches of the fixed patterns, leftmost and without overlap per kind, that are long enough."""
    found = [(kind, m.start(), m.end()) for kind, pattern, group, least in BASE for m in pattern.finditer(text) if m.end(group) - m.start(group) >= least]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """Runs of mixed characters that begin within reach of a sensitive word, on its line."""
    found, last = [], -1
    for word in SENSITIVE.finditer(text):
        begin, stop = word.end(), min(word.end() + REACH, len(text))
        line = text.find("\n", begin, stop)
        stop = stop if line < 0 else line
        while m := CANDIDATE.search(text, begin):
            if m.start() >= stop:
                break
            begin = m.end()
            if m.start() >= last and sum(any(map(kind, m[0])) for kind in (str.islower, str.isupper, str.isdigit)) > 1:
                found.append(m.span())
                last = m.end()
    return found


def scan(text: str, meter: Meter) -> list[tuple[str, int, int, float | None]]:
    """Spans of a text by start, then kind; base spans have no novelty."""
    base = base_spans(text)
    out: list[tuple[str, int, int, float | None]] = [(*s, None) for s in base]
    for a, b in candidates(text):
        if any(s < b and a < e for _, s, e in base):
            continue
        novelty = meter.novelty(text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])
        if novelty >= NOVELTY:
            out.append(("novel", a, b, novelty))
    return sorted(out, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("novelty", pa.float64())])


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", primed: bytes | None = None) -> DataFrame:
    """One row per row of docs: id, spans (kind, start, end, novelty) in order. primed: a dictionary; else that of docs is made."""
    primed = dictionary(docs, text_col) if primed is None else primed

    def run(batches):
        meter = Meter(primed)
        for batch in batches:
            found = [[dict(zip(("kind", "start", "end", "novelty"), s)) for s in scan(t.as_py() or "", meter)] for t in column(batch, "text")]
            yield pa.RecordBatch.from_arrays([column(batch, "id"), pa.array(found, pa.list_(SPAN))], ["id", "spans"])

    named = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return named.mapInArrow(run, "id long, spans array<struct<kind string, start long, end long, novelty double>>")


def joined(spans: Column) -> Column:
    """kind:start:end of spans, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def digests(found: DataFrame) -> DataFrame:
    """id, the number of spans of each kind, the SHA-256 of the base spans and all spans as text."""
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("spans", lambda s: s["kind"] != "novel")
    return found.select("id", *map(count, KINDS), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
