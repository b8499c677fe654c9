"""Matrices, dual numbers, least squares and low-discrepancy points.

Small matrices are lists of columns, row by row, and stay inside code generation; decompositions run in numpy on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

Matrix = list[Column]
_ROW = T.ArrayType(T.DoubleType())


def matmul(a: Matrix, b: Matrix, n: int) -> Matrix:
    return [sum((a[n * i + k] * b[n * k + j] for k in range(1, n)), a[n * i] * b[j]) for i in range(n) for j in range(n)]


def transpose(a: Matrix, n: int) -> Matrix:
    return [a[n * j + i] for i in range(n) for j in range(n)]


def identity(n: int) -> Matrix:
    return [F.lit(float(i == j)) for i in range(n) for j in range(n)]


def _minor(a: Matrix, n: int, i: int, j: int) -> Matrix:
    return [a[n * r + c] for r in range(n) for c in range(n) if r != i and c != j]


def det(a: Matrix, n: int) -> Column:
    """Expanded by the first row."""
    if n == 1:
        return a[0]
    out = None
    for j in range(n):
        term = a[j] * det(_minor(a, n, 0, j), n - 1)
        out = term if out is None else out - term if j % 2 else out + term
    return out


def inverse(a: Matrix, n: int) -> Matrix:
    """The adjugate over the determinant; null where that is 0."""
    d = det(a, n)
    return [F.when(d != 0, (-1 if (i + j) % 2 else 1) * det(_minor(a, n, j, i), n - 1) / d) for i in range(n) for j in range(n)]


def euler(x: Column, y: Column, z: Column) -> Matrix:
    """3 x 3 rotation about x, then y, then z."""
    o, one = F.lit(0.0), F.lit(1.0)
    rx = [one, o, o, o, F.cos(x), -F.sin(x), o, F.sin(x), F.cos(x)]
    ry = [F.cos(y), o, F.sin(y), o, one, o, -F.sin(y), o, F.cos(y)]
    rz = [F.cos(z), -F.sin(z), o, F.sin(z), F.cos(z), o, o, o, one]
    return matmul(rz, matmul(ry, rx, 3), 3)


def euler_angles(m: Matrix) -> tuple[Column, Column, Column]:
    """The angles of such a rotation, y between -pi/2 and pi/2."""
    return F.atan2(m[7], m[8]), F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), -m[6]))), F.atan2(m[3], m[0])


def _square(rows: pd.Series) -> np.ndarray:
    flat = np.array([np.asarray(r, float) for r in rows]).reshape(len(rows), -1)
    n = int(round(flat.shape[1] ** 0.5)) if len(rows) else 0
    return flat.reshape(len(rows), n, n)


@F.pandas_udf(T.StructType([T.StructField("values", _ROW), T.StructField("vectors", _ROW)]))
def symmetric_eigen(rows: pd.Series) -> pd.DataFrame:
    """Ascending eigenvalues of symmetric matrices (row by row) and their unit vectors as columns."""
    if not len(rows):
        return pd.DataFrame({"values": [], "vectors": []})
    w, v = np.linalg.eigh(_square(rows))
    return pd.DataFrame({"values": list(w), "vectors": list(v.reshape(len(rows), -1))})


@F.pandas_udf(_ROW)
def singular_values(rows: pd.Series) -> pd.Series:
    """Descending."""
    return pd.Series(list(np.linalg.svd(_square(rows), compute_uv=False))) if len(rows) else pd.Series([], dtype=object)


@F.pandas_udf(_ROW)
def cholesky(rows: pd.Series) -> pd.Series:
    """The lower factor of positive definite matrices."""
    return pd.Series(list(np.linalg.cholesky(_square(rows)).reshape(len(rows), -1))) if len(rows) else pd.Series([], dtype=object)


@F.pandas_udf(_ROW)
def solve(rows: pd.Series, right: pd.Series) -> pd.Series:
    """Least-squares solutions by singular values: null spaces get nothing."""
    if not len(rows):
        return pd.Series([], dtype=object)
    b = np.array([np.asarray(r, float) for r in right])
    return pd.Series(list((np.linalg.pinv(_square(rows)) @ b[:, :, None])[:, :, 0]))


def exponents(variables: int, degree: int) -> list[tuple[int, ...]]:
    """The monomials of a polynomial, by degree."""
    out = [()]
    for _ in range(variables):
        out = [(*e, k) for e in out for k in range(degree + 1) if sum(e) + k <= degree]
    return sorted(out, key=lambda e: (sum(e), tuple(-x for x in e)))


def monomials(columns: list[Column], degree: int) -> list[Column]:
    out = []
    for e in exponents(len(columns), degree):
        c = F.lit(1.0)
        for x, k in zip(columns, e, strict=True):
            for _ in range(k):
                c = c * x
        out.append(c)
    return out


def polynomial_fit(df: DataFrame, by: list[str], columns: list[str], value: str, degree: int) -> DataFrame:
    """by, n and coefficients (in the order of `exponents`) of the polynomial of least squares in each group.

    Normal equations are sums, added up before anything is shuffled; only one small system a group is solved in numpy.
    """
    basis = monomials([F.col(c) for c in columns], degree)
    k = len(basis)
    sums = [F.sum(basis[i] * basis[j]).alias(f"m{i}_{j}") for i in range(k) for j in range(i, k)] + [F.sum(basis[i] * F.col(value)).alias(f"r{i}") for i in range(k)]
    out = df.groupBy(*by).agg(F.count("*").alias("n"), *sums)
    rows = F.array(*[F.col(f"m{min(i, j)}_{max(i, j)}") for i in range(k) for j in range(k)])
    return out.select(*by, "n", solve(rows, F.array(*[F.col(f"r{i}") for i in range(k)])).alias("coefficients"))


# ---------------------------------------------------------------- dual numbers: a value and its derivative

Dual = tuple[Column, Column]


def variable(c: Column) -> Dual:
    return c, F.lit(1.0)


def constant(c) -> Dual:
    return (c if isinstance(c, Column) else F.lit(float(c))), F.lit(0.0)


def d_add(a: Dual, b: Dual) -> Dual:
    return a[0] + b[0], a[1] + b[1]


def d_sub(a: Dual, b: Dual) -> Dual:
    return a[0] - b[0], a[1] - b[1]


def d_mul(a: Dual, b: Dual) -> Dual:
    return a[0] * b[0], a[1] * b[0] + a[0] * b[1]


def d_div(a: Dual, b: Dual) -> Dual:
    return a[0] / b[0], (a[1] * b[0] - a[0] * b[1]) / (b[0] * b[0])


def d_sqrt(a: Dual) -> Dual:
    return F.sqrt(a[0]), a[1] / (2 * F.sqrt(a[0]))


def d_sin(a: Dual) -> Dual:
    return F.sin(a[0]), a[1] * F.cos(a[0])


def d_cos(a: Dual) -> Dual:
    return F.cos(a[0]), -a[1] * F.sin(a[0])


def d_tan(a: Dual) -> Dual:
    return F.tan(a[0]), a[1] * (1 + F.tan(a[0]) * F.tan(a[0]))


def d_exp(a: Dual) -> Dual:
    return F.exp(a[0]), a[1] * F.exp(a[0])


def d_pow(a: Dual, k: float) -> Dual:
    return F.pow(a[0], F.lit(float(k))), a[1] * k * F.pow(a[0], F.lit(float(k - 1)))


def d_less(a: Dual, b: Dual) -> Column:
    """Comparisons look at values alone."""
    return a[0] < b[0]


# ---------------------------------------------------------------- Sobol points

#: Degree, inner coefficients and first direction numbers of the primitive polynomials of dimensions 2 to 6.
SOBOL = [(1, 0, (1,)), (2, 1, (1, 3)), (3, 1, (1, 3, 1)), (3, 2, (1, 1, 1)), (4, 1, (1, 1, 3, 3))]
SOBOL_BITS = 30


def directions(dimension: int, bits: int = SOBOL_BITS) -> list[int]:
    """Direction numbers of a dimension (from 1) as whole numbers of `bits` bits."""
    if dimension == 1:
        return [1 << (bits - 1 - k) for k in range(bits)]
    s, a, first = SOBOL[dimension - 2]
    m = list(first)
    for k in range(s, bits):
        x = m[k - s] ^ (m[k - s] << s)
        for i in range(1, s):
            if a >> (s - 1 - i) & 1:
                x ^= m[k - i] << i
        m.append(x)
    return [x << (bits - 1 - k) for k, x in enumerate(m[:bits])]


def sobol(i: Column, dimension: int, bits: int = SOBOL_BITS) -> Column:
    """Coordinate of the i-th point (from 0) in (0, 1): the direction numbers of the bits of i's Gray code, joined by XOR."""
    gray = i.cast("long").bitwiseXOR(F.shiftright(i.cast("long"), 1))
    out = F.lit(0).cast("long")
    for k, v in enumerate(directions(dimension, bits)):
        out = out.bitwiseXOR(F.shiftright(gray, k).bitwiseAND(F.lit(1)) * F.lit(v))
    return out / float(1 << bits)
