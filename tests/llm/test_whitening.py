import random
from fractions import Fraction

import numpy as np
import pytest

from evidenceframe.llm import whitening
from evidenceframe.llm.queries import QUERIES

from ..conftest import SF

KIND = "vec_id long, embedding array<float>, id string, vec int, deviation string, whitened int"


def frame(spark, vectors, kind=KIND):
    return spark.createDataFrame([(i, v, "x", 1, "y", 2) for i, v in enumerate(vectors)], kind)


def brute_polynomial(matrix):
    """Faddeev-LeVerrier over fractions."""
    d = len(matrix)
    m, out = [[Fraction(0)] * d for _ in range(d)], [Fraction(1)]
    for k in range(1, d + 1):
        m = [[sum(matrix[i][t] * m[t][j] for t in range(d)) + (out[-1] if i == j else 0) for j in range(d)] for i in range(d)]
        out.append(-sum(matrix[i][t] * m[t][i] for i in range(d) for t in range(d)) / k)
    return [int(c) for c in reversed(out)]


def brute_white(x, count=8):
    """Scatter in Python's integers, eigenvectors by numpy."""
    n, centred = len(x), [[Fraction(c * len(x) - s, len(x)) for c, s in zip(v, map(sum, zip(*x)))] for v in x]
    wide = np.array(centred, float)
    e, v = np.linalg.eigh(wide.T @ wide / n)
    e, v = e[::-1], v[:, ::-1]
    kept = [k for k in range(min(count, len(e))) if e[k] > 1e-9 * e[0]]
    return e, [wide @ v[:, k] / np.sqrt(e[k]) for k in kept]


@pytest.mark.parametrize("seed", range(4))
def test_polynomial_against_fractions(spark, seed):
    draw = random.Random(seed)
    rows = [[draw.randrange(-(10**draw.choice([1, 6, 12])), 10**6) for _ in range(6)] for _ in range(4 if seed == 1 else 9)]
    matrix = np.array(rows, object).T.dot(np.array(rows, object))
    assert whitening.characteristic_polynomial(spark, matrix) == brute_polynomial(matrix.tolist())


def test_hessenberg_meets_zeros():
    matrix = np.array([[2, 0, 1, 0], [0, 3, 0, 0], [1, 0, 4, 5], [0, 0, 5, 9]], object)
    assert whitening.polynomial_modulo(matrix, 101) == [c % 101 for c in brute_polynomial(matrix.tolist())]


def test_primes():
    found = whitening.primes(5)
    assert found == [2147483647, 2147483629, 2147483587, 2147483579, 2147483563]


def test_roots_are_counted_and_refined():
    # (t - 1)(t - 5)^2 (t - 5000000)
    poly = [int(c) for c in np.polynomial.polynomial.polyfromroots([1, 5, 5, 5_000_000])]
    assert [whitening.roots_above(poly, a) for a in (0, 1, 4, 5, 5_000_000)] == [4, 3, 3, 1, 0]
    found = whitening.largest_roots(poly, 8)
    assert [(round(r / (1 << b), 12), m) for r, b, m in found] == [(5_000_000, 1), (5, 2), (1, 1)]
    assert len(whitening.largest_roots(poly, 1)) == 1


def test_products_are_exact():
    draw = random.Random(7)
    for most in (10, 1 << 20, 1 << 30, 1 << 39):
        y = np.array([[draw.randrange(-most, most) for _ in range(3)] for _ in range(50)], np.int64)
        assert whitening.products(y).tolist() == y.astype(object).T.dot(y.astype(object)).tolist()


def test_query_against_brute_force(spark):
    rows = QUERIES["op13_polynomial_whitening"](spark, SF).toPandas()
    table = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in v] for v in table.embedding]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    want = dict(zip(table.vec_id, (sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x)))
    assert len(rows) == 8 * n and set(rows.n) == {n} and all(want[i] == d for i, d in zip(rows.vec_id, rows.deviation))
    e, white = brute_white(x)
    for k, w in enumerate(white, 1):
        own = rows[rows.component == k].set_index("vec_id").loc[table.vec_id]
        assert min(np.abs(own.whitened.to_numpy() - w).max(), np.abs(own.whitened.to_numpy() + w).max()) < 1e-9
        assert abs(own.explained.iloc[0] * e.sum() / e[k - 1] - 1) < 1e-9
    assert rows.identity_error.nunique() == 1 and rows.identity_error.iloc[0] < 1e-9


def test_what_goes_and_what_stays(spark):
    nan, inf = float("nan"), float("inf")
    vectors = [[1.0, 2.0], None, [], [3.0, None], [nan, 1.0], [inf, 1.0], [2.0, 1.0], [2.0, 1.0], [1.0], [5.0, 5.0, 5.0], [0.25, -3.0]]
    rows = whitening.whiten(frame(spark, vectors)).toPandas()
    assert sorted(set(rows.id)) == [0, 6, 7, 10] and len(rows) == 8 and set(rows.n) == {4}
    assert abs(rows.groupby("component").explained.first().sum() - 1) < 1e-12 and rows.identity_error.max() < 1e-12
    both = rows[rows.id.isin([6, 7])].groupby("component").whitened
    assert (both.min() == both.max()).all()


@pytest.mark.parametrize("vectors", [[], [None], [[1.0, 2.0]], [[1.0, 2.0]] * 3])
def test_nothing_to_whiten(spark, vectors):
    got = whitening.whiten(frame(spark, vectors))
    assert got.count() == 0 and got.columns == ["id", "component", "n", "deviation", "deviation_text", "whitened", "explained", "identity_error"]


def test_equal_eigenvalues_have_orthonormal_components(spark):
    # the corners of a cross: every direction has the same variance
    corners = [[s if k == i else 0.0 for k in range(3)] for i in range(3) for s in (1.0, -1.0)]
    rows = whitening.whiten(frame(spark, corners)).toPandas()
    assert len(rows) == 18 and rows.identity_error.max() < 1e-12 and np.allclose(rows.explained, 1 / 3)


def test_fewer_dimensions_than_components_and_a_flat_one(spark):
    rows = whitening.whiten(frame(spark, [[float(i), 7.0, float(i * i)] for i in range(9)])).toPandas()
    assert set(rows.component) == {1, 2} and rows.identity_error.max() < 1e-10


def test_huge_entries_are_exact(spark):
    vectors = [[1e18, 3.0], [-1e30, 1.0], [1e300, 2.0], [0.5, 4.0]]
    rows = whitening.whiten(frame(spark, vectors, KIND.replace("float", "double"))).toPandas()
    least, most = -(1 << 63), (1 << 63) - 1
    x = [[min(most, max(least, int(np.floor(1024 * a))) + 100_000), int(1024 * b) + 100_000] for a, b in vectors[:2]] + [[most, 102_048 + 0], [100_512, 104_096]]
    x[1][0] = least + 100_000
    sums = [sum(c) for c in zip(*x)]
    want = {i: sum((4 * c - s) ** 2 for c, s in zip(v, sums)) for i, v in enumerate(x)}
    assert {i: int(t) for i, t in zip(rows.id, rows.deviation_text)} == want and rows.deviation.isna().all()
    assert rows[rows.component == 1].identity_error.max() < 1e-9
