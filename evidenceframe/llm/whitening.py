"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries become integers, so counts, sums and the scatter matrix n * sum(x x') - S S' are exact: tasks add products in float
matrices whose sums stay below 2^53, Spark adds what the tasks have. The polynomial det(tI - scatter) is found modulo many
primes, each by reduction to Hessenberg form in a task, and put together by Chinese remaindering; a last prime checks it.
All its roots are real, so the sign variations of a shifted polynomial count the roots above any point exactly: bisection isolates
the largest, and they are refined to some 256 bits. A component spans the null space of scatter - root: inverse iteration in integers of
as many bits, in a task of its own, rounded to doubles at the end.

What the driver holds is a matrix and a polynomial of the dimension, whatever the number of rows.

Defined results: vectors that are null, empty or hold a null or non-finite entry go, and so do those of another length than most
(of equally frequent lengths the shortest stays). An entry beyond what a long holds counts as the last long. Repeated rows and null ids get rows
each. Only components with a positive eigenvalue exist, so vectors that are all equal, one vector and an empty table give no rows. Of an
eigenvalue met several times (closer than 2^-256 of the largest), orthonormal components are given. Other columns are ignored.
"""

from __future__ import annotations

import math
import random
from dataclasses import dataclass, field
from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import column, materialise

#: x = floor(SCALE * entry) + OFFSET; covariances don't depend on the offset, so sums are taken without it.
SCALE, OFFSET = 1024, 100_000
#: Bits to which roots and components are found, against the largest root.
BITS = 256
LONG = (1 << 63) - 1
#: A sum travels as high * 2^LIMB + low.
LIMB = 60


@dataclass
class Fit:
    """What whitening needs: count, sums (without the offset), trace of the scatter, components with their roots."""

    n: int
    sums: list[int]
    trace: int = 0
    roots: list[tuple[int, int]] = field(default_factory=list)  # numerator, bits of the denominator
    components: list[list[float]] = field(default_factory=list)


def integers(entries: np.ndarray) -> np.ndarray:
    """floor(SCALE * entry), int64 where products of these are small, else Python's integers."""
    with np.errstate(over="ignore"):
        y = np.floor(entries * SCALE)
    if not y.size or np.abs(y).max() < 1 << 40:
        return y.astype(np.int64)
    held = [max(-LONG - 1, min(LONG - OFFSET, int(v) if math.isfinite(v) else int(math.copysign(1 << 70, v)))) for v in y.ravel()]
    return np.array(held, object).reshape(y.shape)


def products(y: np.ndarray) -> np.ndarray:
    """The exact y'y in Python's integers."""
    if y.dtype == object:
        return y.T.dot(y)
    most = max(1, int(np.abs(y).max(initial=0)))
    step = (1 << 53) // (most * most)
    if not step:
        high = y >> 20
        low = (y - (high << 20)).astype(object)
        high = high.astype(object)
        return (high.T.dot(high) << 40) + ((high.T.dot(low) + low.T.dot(high)) << 20) + low.T.dot(low)
    out = np.zeros((y.shape[1], y.shape[1]), object)
    for k in range(0, len(y), step):
        part = y[k : k + step].astype(np.float64)
        out += (part.T @ part).astype(np.int64).astype(object)
    return out


def entries(batch: pa.RecordBatch, dim: int) -> np.ndarray:
    values = pc.list_flatten(batch.column(batch.schema.get_field_index("vec")))
    return values.to_numpy(zero_copy_only=False).reshape(-1, dim)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """(id, vec) of the vectors that stay, and their length."""
    vec = F.col(vec_col).cast("array<double>")
    finite = F.forall("vec", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), vec.alias("vec")).where(F.col("vec").isNotNull() & (F.size("vec") > 0) & finite)
    lengths = rows.groupBy(F.size("vec").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    dim = lengths[0]["dim"] if lengths else 0
    return rows.where(F.size("vec") == dim), dim


def moments(rows: DataFrame, dim: int) -> tuple[int, list[int], np.ndarray]:
    """Count, sums and sum of y y' over all rows."""

    def add(batches):
        n, total = 0, np.zeros((dim + 1, dim), object)  # the last row: sums
        for batch in batches:
            y = integers(entries(batch, dim))
            n += len(y)
            total[:dim] += products(y)
            total[dim] += y.astype(object).sum(axis=0) if y.dtype == object else y.sum(axis=0).astype(object)
        if n:
            i, j = np.nonzero(np.arange(dim + 1)[:, None] >= np.arange(dim))
            v = total[i, j]
            kind = pa.decimal128(38, 0)
            high = pa.array([Decimal(int(x) >> LIMB) for x in v], kind)
            low = pa.array([Decimal(int(x) & ((1 << LIMB) - 1)) for x in v], kind)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), high, low, pa.array([n] * len(v), pa.int64())], ["i", "j", "high", "low", "n"])

    parts = rows.select("vec").mapInArrow(add, "i int, j int, high decimal(38,0), low decimal(38,0), n long")
    sums = parts.groupBy("i", "j").agg(F.sum("high").alias("high"), F.sum("low").alias("low"), F.sum("n").alias("n")).collect()  # dim * (dim + 3) / 2 rows
    both, n = np.zeros((dim + 1, dim), object), 0
    for r in sums:
        both[r["i"], r["j"]], n = (int(r["high"]) << LIMB) + int(r["low"]), r["n"]
    low = np.tril(both[:dim])
    return n, list(both[dim]), low + np.tril(low, -1).T


def primes(count: int, below: int = 1 << 31) -> list[int]:
    """The largest primes below 2^31 (bases that decide it up to there)."""

    def prime(m: int) -> bool:
        odd = (m - 1) >> (shift := ((m - 1) & -(m - 1)).bit_length() - 1)
        for base in (2, 3, 5, 7):
            x = pow(base, odd, m)
            if x not in (1, m - 1) and not any((x := x * x % m) == m - 1 for _ in range(shift - 1)):
                return False
        return True

    found, m = [], below - 1
    while len(found) < count:
        if prime(m):
            found.append(m)
        m -= 2
    return found


def polynomial_modulo(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(tI - matrix) modulo a prime, constant first: Hessenberg form, then its recurrence."""
    a = (matrix % p).astype(np.int64)
    d = len(a)
    for k in range(d - 2):
        below = np.flatnonzero(a[k + 1 :, k])
        if not len(below):
            continue
        if r := int(below[0]):
            a[[k + 1, k + 1 + r]] = a[[k + 1 + r, k + 1]]
            a[:, [k + 1, k + 1 + r]] = a[:, [k + 1 + r, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :, k:] = (a[k + 2 :, k:] - u[:, None] * a[k + 1, k:] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(d):
        weights, run = np.zeros(m + 1, np.int64), 1
        for i in range(m, -1, -1):
            weights[i] = int(a[i, m]) * run % p
            run = run * int(a[i, i - 1]) % p if i else run
        polys[m + 1, 1:] = polys[m, :-1]
        polys[m + 1] = (polys[m + 1] - (weights[:, None] * polys[: m + 1] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d]]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """det(tI - matrix), constant first, of a symmetric positive matrix of integers: a task takes some primes.

    A coefficient is a sum of products of eigenvalues, so none exceeds (1 + trace / dim) ^ dim.
    """
    d = len(matrix)
    bits = d * (1 + int(np.trace(matrix)) // d + 1).bit_length() + 2
    moduli = primes(bits // 30 + 2)

    def reduce(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            found = [polynomial_modulo(matrix, moduli[i]) for i in ids]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.list_(pa.int64()))], ["id", "c"])

    tasks = min(len(moduli), max(1, 4 * spark.sparkContext.defaultParallelism))
    rows = dict(map(tuple, spark.range(0, len(moduli), 1, tasks).mapInArrow(reduce, "id long, c array<long>").collect()))
    residues, m = [0] * (d + 1), 1
    for i, p in enumerate(moduli[:-1]):
        inverse = pow(m, -1, p)
        residues = [c + m * ((r - c) * inverse % p) for c, r in zip(residues, rows[i])]
        m *= p
    out = [c - m if c > m // 2 else c for c in residues]
    if [c % moduli[-1] for c in out] != rows[len(moduli) - 1]:
        raise ArithmeticError("the characteristic polynomial doesn't meet its check prime")
    return out


def scaled(poly: list[int], bits: int) -> list[int]:
    """The polynomial whose roots are 2^bits times as large."""
    return [c << bits * (len(poly) - 1 - i) for i, c in enumerate(poly)]


def roots_above(poly: list[int], a: int) -> int:
    """Roots greater than a, with their multiplicity, of a polynomial that has real roots only: sign variations after a shift by a."""
    c = list(poly)
    for i in range(len(c) - 1):
        for j in range(len(c) - 2, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(poly: list[int], count: int) -> list[tuple[int, int, int]]:
    """(numerator, bits, multiplicity), falling, of the positive roots that hold the first count places.

    A root is within 2^-BITS of the largest, and a simple one within 2^-120 of itself, below or at numerator / 2^bits.
    """
    top = 1
    while roots_above(poly, 1 << top):
        top += 1
    found, open_ = [], [(0, 1 << top, roots_above(poly, 0), 0, 0)]  # low, high, roots in (low, high], roots above high, bits
    while open_:
        low, high, inside, above, bits = open_.pop()
        if above >= count or not inside:
            continue
        if inside == 1 or (high - low) << BITS <= 1 << top + bits:
            found.append((low, high, inside, above, bits))
            continue
        if high - low == 1:
            low, high, bits = low << 32, high << 32, bits + 32
        middle = (low + high) // 2
        upper = roots_above(scaled(poly, bits), middle) - above
        open_ += [(low, middle, inside - upper, above + upper, bits), (middle, high, upper, above, bits)]
    return [refined(poly, top, *x) for x in sorted(found, key=lambda x: x[3])]


def refined(poly: list[int], top: int, low: int, high: int, inside: int, above: int, bits: int) -> tuple[int, int, int]:
    """The one root in (low, high] by the sign at the middle: from it to the next root it is that of an even or odd number of roots above."""
    sign = -1 if above % 2 else 1
    while inside == 1 and ((high - low) << BITS > 1 << top + bits or (high - low) << 120 > low):
        if high - low == 1:
            low, high, bits = low << 32, high << 32, bits + 32
        middle, value = (low + high) // 2, 0
        for i, c in enumerate(reversed(poly)):
            value = value * middle + (c << bits * i)
        if not value:
            return middle, bits, 1
        low, high = (low, middle) if value * sign > 0 else (middle, high)
    return high, bits, inside


def solved(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """x of a x = b in integers with so many bits after the point; a pivot of nothing counts as the least there is."""
    d = len(a)
    m = np.concatenate([a, b], axis=1)
    for k in range(d):
        r = k + max(range(d - k), key=lambda i: abs(m[k + i, k]))
        m[[k, r]] = m[[r, k]]
        m[k, k] = m[k, k] or 1
        if k + 1 < d:
            u = (m[k + 1 :, k] << bits) // m[k, k]
            m[k + 1 :, k + 1 :] -= (u[:, None] * m[k, k + 1 :]) >> bits
    x = np.zeros(b.shape, object)
    for k in range(d - 1, -1, -1):
        x[k] = ((m[k, d:] << bits) - m[k, k + 1 : d].dot(x[k + 1 :])) // m[k, k]
    return x


def null_space(matrix: np.ndarray, root: tuple[int, int, int]) -> list[list[float]]:
    """Orthonormal vectors v with matrix v = root v, as many as the root is met; of either sign the one whose first largest entry is positive."""
    numerator, bits, times = root
    d, width = len(matrix), 2 * BITS
    shifted = (matrix << bits) - np.identity(d, dtype=object) * numerator
    shifted = (shifted << width) >> bits
    draw = random.Random(d)
    x = np.array([[draw.randrange(-(1 << 32), 1 << 32) << width for _ in range(times)] for _ in range(d)], object)
    for _ in range(3):
        x = solved(shifted, x, width)
        for j in range(times):
            x[:, j] = fitted(x[:, j], width)
            for q in range(j):
                x[:, j] -= x[:, q] * int(x[:, q].dot(x[:, j])) // int(x[:, q].dot(x[:, q]))
            x[:, j] = fitted(x[:, j], width)
    out = []
    for j in range(times):
        v = x[:, j]
        norm = math.isqrt(int(v.dot(v))) * (1 if v[int(np.argmax(np.abs(v)))] > 0 else -1)
        out.append([int(c) / norm for c in v])
    return out


def fitted(v: np.ndarray, bits: int) -> np.ndarray:
    """v with its largest entry brought to so many bits."""
    over = max(int(c).bit_length() for c in v) - bits
    return v >> over if over > 0 else v << -over


def fit(rows: DataFrame, dim: int, count: int = 8) -> Fit:
    """Exact moments, polynomial, roots and components of all rows (id, vec)."""
    spark = rows.sparkSession
    n, sums, second = moments(rows, dim) if dim else (0, [], np.zeros((0, 0), object))
    scatter = n * second - np.outer(np.array(sums, object), np.array(sums, object)) if n else second
    out = Fit(n, sums, int(np.trace(scatter)) if n else 0)
    if not out.trace:
        return out
    found = largest_roots(characteristic_polynomial(spark, scatter), count)

    def span(batches):
        for batch in batches:
            for i in batch.column(0).to_pylist():
                vectors = null_space(scatter, found[i])
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(vectors), pa.int64()), pa.array(range(len(vectors)), pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], ["id", "place", "v"])

    spans = spark.range(0, len(found), 1, len(found)).mapInArrow(span, "id long, place long, v array<double>").collect()
    for r in sorted(spans, key=lambda r: (r["id"], r["place"]))[:count]:
        out.roots.append(found[r["id"]][:2])
        out.components.append(list(r["v"]))
    return out


def project(rows: DataFrame, model: Fit) -> DataFrame:
    """id, deviation (null beyond a long), deviation_text (its digits), whitened (an entry for each component) of every row."""
    n, dim = model.n, len(model.sums)
    # (x - S/n) v / sqrt(e), with e = root / n^2, is (n x - S) v / sqrt(root)
    basis = np.array([[c / math.sqrt(r / (1 << bits)) for c in v] for v, (r, bits) in zip(model.components, model.roots)]).reshape(-1, dim).T
    most = max(map(abs, model.sums), default=0)

    def scan(batches):
        sums = np.array(model.sums, object)
        for batch in batches:
            y = integers(entries(batch, dim))
            small = y.dtype != object and n * int(np.abs(y).max(initial=0)) + most < 1 << 62
            centred = n * y - sums.astype(np.int64) if small else n * y.astype(object) - sums
            if small and dim * int(np.abs(centred).max(initial=0)) ** 2 < 1 << 63:
                square = (centred * centred).sum(axis=1).tolist()
            else:
                wide = centred.astype(object)
                square = (wide * wide).sum(axis=1).tolist()
            white = centred.astype(np.float64) @ basis
            yield pa.RecordBatch.from_arrays(
                [
                    column(batch, "id"), pa.array([s if s <= LONG else None for s in square], pa.int64()), pa.array([str(s) for s in square]),
                    pa.ListArray.from_arrays(np.arange(len(white) + 1, dtype=np.int32) * white.shape[1], white.ravel()),
                ],
                ["id", "deviation", "deviation_text", "whitened"],
            )

    return rows.mapInArrow(scan, "id long, deviation long, deviation_text string, whitened array<double>")


def identity_error(projected: DataFrame, count: int) -> float:
    """Largest absolute entry of whitened's covariance (divisor n, centred, co-moments merged) minus the identity."""
    pairs = [(i, j) for i in range(count) for j in range(i + 1)]
    row = projected.agg(*(F.covar_pop(F.col("whitened")[i], F.col("whitened")[j]) for i, j in pairs)).first()
    return max(abs(row[k] - (i == j)) for k, (i, j) in enumerate(pairs))


def whiten(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", count: int = 8) -> DataFrame:
    """One row per vector that stays and component: id, component (from 1), n, deviation, deviation_text, whitened, explained, identity_error."""
    rows, dim = usable(vectors, id_col, vec_col)
    model = fit(rows, dim, count)
    spark = vectors.sparkSession
    if not model.components:
        return spark.createDataFrame([], "id long, component int, n long, deviation long, deviation_text string, whitened double, explained double, identity_error double")
    projected = materialise(project(rows, model))
    error = identity_error(projected, len(model.components))
    explained = F.array(*(F.lit(r / (model.trace << bits)) for r, bits in model.roots))
    each = projected.select("id", "deviation", "deviation_text", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "id", (F.col("at") + 1).cast("int").alias("component"), F.lit(model.n).cast("long").alias("n"), "deviation", "deviation_text", "whitened",
        explained[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )
