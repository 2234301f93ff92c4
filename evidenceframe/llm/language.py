"""Language identification by prediction by partial matching (PPM).

A language's model is a variable-order byte context tree with the counts of what follows each context. The code
length of a text is exact PPM with escape method C and exclusion, under frozen counts: in the longest context of
the tree, a byte seen there costs -log2(count / (total + kinds)), else an escape is paid and the next shorter
context codes it, without the bytes already ruled out; below the empty context all bytes left are alike. The
language of the shortest code wins.

Contexts are counted by Spark over a bounded sample of labelled rows; those that make up a given share of a language's
bytes are kept, all of them with a share of 0 (the exact tree). Their costs
make one table of (state, byte) for a group of languages, in which a state is the longest known context, so a text is
scored by walking the table; texts are walked side by side in numpy. Every language is learnt. The sample is bounded by a
parameter, and so is a group of languages: tasks receive the tables compressed and open one at a time.

Defined results: A-Z count as a-z; text null or without a letter gives ``und`` and score 0; ties go to the first
language in code-point order; training ignores null languages, texts and ids; without any training rows every
text gets ``und``; repeated rows are scored each; other columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import column, materialise

ALPHABET = 256
END = ALPHABET  # stands between texts
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Rows of ids that are broadcast at most.
BROADCAST_ROWS = 1 << 18


def held_out(id_col: str, folds: int = 3, fold: int = 1):
    """Whether a row is kept from training: CRC-32 of its id as text, modulo folds. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def sample_rows(labelled: DataFrame, per_language: int) -> DataFrame:
    """About ``per_language`` rows (id, text, lang) of each language at most: a hash deals rows to so many cells, and each
    cell's first is taken. Only ids are grouped; those chosen come back to their texts by broadcast if they are few. Rows that
    repeat an id in a language count once, with the least text.
    """
    key = F.xxhash64("id", "lang")
    first = labelled.groupBy("lang", F.pmod(key, F.lit(per_language)).alias("cell")).agg(F.min(F.struct(key.alias("key"), "id")).alias("first"))
    picked = materialise(first.select("lang", F.col("first.id").alias("id")).distinct())
    chosen = labelled.join(F.broadcast(picked) if picked.count() <= BROADCAST_ROWS else picked, ["id", "lang"])
    return chosen.groupBy("id", "lang").agg(F.min("text").alias("text"))


def _grams(data: np.ndarray, order: int) -> np.ndarray:
    """Each byte with the ``order`` bytes before it, as one number; data has END (as 255) between texts."""
    n = len(data) - order
    out = np.zeros(max(n, 0), np.int64)
    for k in range(order + 1):
        out = (out << 8) | data[k : k + n]
    return out


def count_contexts(rows: DataFrame, order: int) -> DataFrame:
    """(lang, depth, gram, n): how often a byte follows a context of depth bytes; gram holds both."""

    def count(batches):
        for batch in batches:
            langs = np.array(column(batch, "lang").to_pylist(), object)
            texts = column(batch, "text", pa.binary()).to_pylist()
            for lang in sorted(set(langs)):
                own = [t for t, name in zip(texts, langs) if name == lang]
                flat = LOWER[np.frombuffer(b"\xff".join([b"", *own, b""]), np.uint8)]
                for depth in range(order + 1):
                    grams = _grams(flat, depth)
                    clean = np.ones(len(grams), bool)
                    for k in range(depth + 1):
                        clean &= flat[k : k + len(grams)] != 255
                    values, n = np.unique(grams[clean], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array(np.full(len(values), depth)), pa.array(values), pa.array(n)], ["lang", "depth", "gram", "n"])

    return rows.select("lang", "text").mapInArrow(count, "lang string, depth long, gram long, n long").groupBy("lang", "depth", "gram").agg(F.sum("n").alias("n"))


def _code_lengths(chain: list[np.ndarray]) -> np.ndarray:
    """Bits of each byte in a context, given its counts and those of the shorter ones, longest first."""
    bits = np.full(ALPHABET, np.nan)
    barred = np.zeros(ALPHABET, bool)
    paid = 0.0
    for counts in chain:
        seen = (counts > 0) & ~barred
        kinds = int(seen.sum())
        if not kinds:
            continue
        total = float(counts[seen].sum())
        bits[seen] = paid - np.log2(counts[seen] / (total + kinds))
        paid -= np.log2(kinds / (total + kinds))
        barred |= seen
    left = ALPHABET - int(barred.sum())
    if left:
        bits[~barred] = paid + np.log2(left)
    return bits


@dataclass
class Model:
    """languages; step[state, byte] is the next state and bits[state, byte, language] what the byte costs.

    Bytes are grouped in classes of equal behaviour (``kinds``); the last class is END."""

    languages: list[str]
    depth: int
    kinds: np.ndarray
    step: np.ndarray
    bits: np.ndarray

    def lengths(self, texts: list[bytes], columns: int = 4096) -> np.ndarray:
        """Code length in bits of each text (row) in each language (column)."""
        out = np.zeros((len(texts), len(self.languages)))
        if not texts or not self.languages:
            return out
        flat = self.kinds[LOWER[np.frombuffer(b"\xff".join([*texts, b""]), np.uint8)]]
        sizes = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
        # Lay the bytes out in columns walked side by side; each starts some bytes early, to know its context.
        rows = max(64, -(-len(flat) // columns))
        width = -(-len(flat) // rows)
        padded = np.full(self.depth + rows * width, self.kinds[255], flat.dtype)
        padded[self.depth : self.depth + len(flat)] = flat
        at = np.lib.stride_tricks.as_strided(padded, (rows + self.depth, width), (padded.itemsize, rows * padded.itemsize))
        n_kinds = self.step.shape[1]
        step = self.step.ravel() * n_kinds
        state = np.zeros(width, np.int64)
        met = np.empty((rows, width), np.int64)
        for k in range(rows + self.depth):
            cell = state + at[k]
            if k >= self.depth:
                met[k - self.depth] = cell
            state = step[cell]
        cells = met.T.ravel()[: len(flat)]
        begins = np.cumsum(sizes) - sizes
        bits = self.bits.reshape(-1, len(self.languages))
        for i in range(len(self.languages)):
            out[:, i] = np.add.reduceat(np.take(bits[:, i], cells), begins, dtype=np.float64)
        return out


def build_model(counts: list[tuple[str, int, int, int]], order: int) -> Model:
    """Model of the kept contexts; counts: (language, depth, gram, n)."""
    languages = sorted({c[0] for c in counts}, key=lambda x: x.encode())
    trees: list[dict[bytes, np.ndarray]] = [{} for _ in languages]
    for lang, depth, gram, n in counts:
        raw = int(gram).to_bytes(depth + 1, "big")
        trees[languages.index(lang)].setdefault(raw[:-1], np.zeros(ALPHABET, np.int64))[raw[-1]] += n
    contexts = sorted({c for t in trees for c in t} | {b""}, key=lambda c: (len(c), c))
    # every shorter context of a known one is known, so a walk can always fall back
    known = {c[i:] for c in contexts for i in range(len(c) + 1)}
    contexts = sorted(known, key=lambda c: (len(c), c))
    place = {c: i for i, c in enumerate(contexts)}
    seen = np.zeros(ALPHABET, bool)
    for c in contexts:
        seen[list(c)] = True
    for t in trees:
        for v in t.values():
            seen |= v > 0
    # class 0: bytes that never occurred; then one for each byte that did; then END (never a byte of UTF-8)
    seen[255] = False
    kinds = np.zeros(256, np.int64)
    kinds[seen] = 1 + np.arange(seen.sum())
    end = 1 + int(seen.sum())
    kinds[255] = end
    step = np.zeros((len(contexts), end + 1), np.int64)
    bits = np.zeros((len(contexts), end + 1, len(languages)), np.float32)
    shown = np.flatnonzero(seen)
    for c, i in place.items():
        for b in shown:
            tail = (c + bytes([b]))[-order:] if order else b""
            while tail not in place:
                tail = tail[1:]
            step[i, kinds[b]] = place[tail]
        for k, tree in enumerate(trees):
            own = [tree[c[j:]] for j in range(len(c) + 1) if c[j:] in tree]
            cost = _code_lengths(own)
            bits[i, 1:end, k] = cost[shown]
            absent = np.flatnonzero(~seen)
            bits[i, 0, k] = cost[absent[0]]
    return Model(languages, order, kinds, step, bits)


@dataclass
class Models:
    """Models of groups of languages, in order, each packed; leads: bytes that begin characters of some language."""

    languages: list[str] = field(default_factory=list)
    packed: list[bytes] = field(default_factory=list)
    leads: np.ndarray = field(default_factory=lambda: np.zeros(256, bool))

    def add(self, model: Model, counts: list[tuple[str, int, int, int]]) -> None:
        self.languages += model.languages
        self.packed.append(zlib.compress(pickle.dumps(model, pickle.HIGHEST_PROTOCOL), 1))
        for lang in model.languages:
            own = [(gram, n) for name, depth, gram, n in counts if name == lang and depth == 0]
            least = sum(n for _, n in own) / 1000
            self.leads[[gram for gram, n in own if n >= least]] = True

    def opened(self):
        """A function that gives the code lengths of texts in all languages; a single model stays open."""
        load = lambda data: pickle.loads(zlib.decompress(data))
        only = load(self.packed[0]) if len(self.packed) == 1 else None

        def lengths(texts: list[bytes], step: int = 1 << 20) -> np.ndarray:
            runs, begin = [], 0
            while begin < len(texts):
                end, held = begin, 0
                while end < len(texts) and (end == begin or held < step):
                    held += len(texts[end])
                    end += 1
                runs.append((begin, end))
                begin = end
            out = [np.zeros((len(texts), 0))]
            for data in self.packed:
                model = only or load(data)
                out.append(np.concatenate([np.zeros((0, len(model.languages))), *(model.lengths(texts[a:b]) for a, b in runs)]))
            return np.concatenate(out, axis=1)

        return lengths

    def covers(self, text: bytes) -> bool:
        """Whether half of the text's letters (other characters beyond ASCII count as such) or more begin like some language's."""
        n = np.bincount(LOWER[np.frombuffer(text, np.uint8)], minlength=256)
        n[:97] = n[123:192] = 0
        return bool(self.languages) and 2 * int(n[self.leads].sum()) >= int(n.sum())


def train(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", order: int = 4,
    per_language: int = 1024, share: float = 1 / 4096, group: int = 8,
) -> Models:
    """Fit on a sample of the rows that aren't held out.

    Bounds: ``per_language`` rows of each language are counted. A context is kept if it makes up ``share`` of the bytes counted
    for its language, so there are no more than 1 / share of each depth; with a share of 0 the tree is exact. The counts
    come to the driver for ``group`` languages at a time.
    """
    labelled = docs.where(~held_out(id_col)).select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang")).dropna()
    counts = materialise(count_contexts(sample_rows(labelled, per_language), order))
    context = F.shiftright("gram", 8)
    totals = counts.groupBy("lang", "depth", context.alias("context")).agg(F.sum("n").alias("total"))
    whole = totals.where("depth = 0").select("lang", F.col("total").alias("bytes"))
    kept = totals.join(whole, "lang").where(F.col("total") >= F.col("bytes") * F.lit(float(share))).select("lang", "depth", "context")
    rows = materialise(counts.withColumn("context", context).join(kept, ["lang", "depth", "context"]).select("lang", "depth", "gram", "n"))
    names = sorted((r.lang for r in rows.select("lang").distinct().collect()), key=lambda x: x.encode())
    models = Models()
    for k in range(0, len(names), group):
        own = [tuple(r) for r in rows.where(F.col("lang").isin(names[k : k + group])).collect()]
        models.add(build_model(own, order), own)
    return models


def identify(docs: DataFrame, model: Models, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), evidence: int = 8) -> DataFrame:
    """id, held_out, text, the columns to carry, lang_pred, score (0 to 1), bits_per_byte (of the predicted language), margin (bits a
    byte by which the next language is longer) and covered for every row; carried columns are named carry_0 onward. covered
    is null for a text without a letter, and false where no language learnt has the text's script.

    score is the predicted language's share when each language has weight 2 ** -(code length of ``evidence`` bytes at its
    rate over the text), so it tells languages that are near each other apart from others, however long the text is.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = shared.value
        lengths = m.opened()
        for batch in batches:
            texts = [t or b"" for t in column(batch, "text", pa.binary()).to_pylist()]
            letters = column(batch, "letters").to_pylist()
            names, scores, rates, margins, covered = [], [], [], [], []
            for text, ok, row in zip(texts, letters, lengths(texts)):
                covered.append(m.covers(text) if ok else None)
                if not ok or not len(row):
                    names.append("und"), scores.append(0.0), rates.append(None), margins.append(None)
                    continue
                best, above = int(row.argmin()), np.sort(row - row.min()) / len(text)
                names.append(m.languages[best])
                scores.append(float(1 / np.exp2(-min(evidence, len(text)) * above).sum()))
                rates.append(float(row[best] / len(text)))
                margins.append(float(above[1]) if len(above) > 1 else None)
            found = [pa.array(names, pa.string()), *(pa.array(c, pa.float64()) for c in (scores, rates, margins)), pa.array(covered, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in kept), *found], fields)

    named = docs.select(F.col(id_col).alias("id"), held_out(id_col).alias("held_out"), F.col(text_col).cast("string").alias("text"), *(F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)), F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("letters"))
    names = named.columns[:-1]
    kept, fields = range(len(names)), [*names, "lang_pred", "score", "bits_per_byte", "margin", "covered"]
    kinds = ", ".join(f"{n} {named.schema[n].dataType.simpleString()}" for n in names)
    return named.mapInArrow(score, f"{kinds}, lang_pred string, score double, bits_per_byte double, margin double, covered boolean")
