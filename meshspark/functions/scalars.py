"""Scalar helpers: clamps, polynomials, bit lengths, decay kernels, numeric intervals, names of files."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(c: Column, low, high) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), c))


def safe_acos(c: Column) -> Column:
    return F.acos(clamp(c, -1.0, 1.0))


def poly(c: Column, *coefficients: float) -> Column:
    """Value of a polynomial, constant first."""
    out = F.lit(float(coefficients[-1]))
    for k in reversed(coefficients[:-1]):
        out = out * c + k
    return out


def quadratic_roots(a: Column, b: Column, c: Column) -> Column:
    """Real roots of a x**2 + b x + c, ascending; an empty array without any."""
    d = b * b - 4 * a * c
    two = F.array_sort(F.array((-b - F.sqrt(d)) / (2 * a), (-b + F.sqrt(d)) / (2 * a)))
    return F.when(d < 0, F.array().cast("array<double>")).when(d == 0, F.array(-b / (2 * a))).otherwise(two)


def bit_length(c: Column) -> Column:
    """Bits of a non-negative integer; 0 for 0."""
    return F.when(c <= 0, 0).otherwise(F.length(F.bin(c.cast("long"))))


def round_up_to_power(c: Column) -> Column:
    """2 to the bit length: 8 gives 16."""
    return F.pow(F.lit(2.0), bit_length(c)).cast("long")


def bilinear(f00, f10, f01, f11, u: Column, v: Column) -> Column:
    return f00 * (1 - u) * (1 - v) + f10 * u * (1 - v) + f01 * (1 - u) * v + f11 * u * v


def falling(n: Column, k: int) -> Column:
    """n (n - 1) .. (n - k + 1)"""
    out = F.lit(1).cast("long")
    for i in range(k):
        out = out * (n - i)
    return out


def choose(n: Column, k: int) -> Column:
    f = 1
    for i in range(2, k + 1):
        f *= i
    return F.floor(falling(n, k) / f)


def interval(low: Column, high: Column) -> Column:
    return F.struct(low.alias("min"), high.alias("max"))


def i_add(a: Column, b: Column) -> Column:
    return interval(a["min"] + b["min"], a["max"] + b["max"])


def i_sub(a: Column, b: Column) -> Column:
    return interval(a["min"] - b["max"], a["max"] - b["min"])


def i_mul(a: Column, b: Column) -> Column:
    p = [x * y for x in (a["min"], a["max"]) for y in (b["min"], b["max"])]
    return interval(F.least(*p), F.greatest(*p))


def i_square(a: Column) -> Column:
    """Zero is the least square of an interval that holds it."""
    p, q = a["min"] * a["min"], a["max"] * a["max"]
    return interval(F.when((a["min"] <= 0) & (a["max"] >= 0), 0.0).otherwise(F.least(p, q)), F.greatest(p, q))


def i_abs(a: Column) -> Column:
    p, q = F.abs(a["min"]), F.abs(a["max"])
    return interval(F.when((a["min"] <= 0) & (a["max"] >= 0), 0.0).otherwise(F.least(p, q)), F.greatest(p, q))


def i_union(a: Column, b: Column) -> Column:
    return interval(F.least(a["min"], b["min"]), F.greatest(a["max"], b["max"]))


def i_meet(a: Column, b: Column) -> Column:
    """Null where they don't meet."""
    low, high = F.greatest(a["min"], b["min"]), F.least(a["max"], b["max"])
    return F.when(low <= high, interval(low, high))


def i_excludes(a: Column, value: float) -> Column:
    return (a["max"] < value) | (a["min"] > value)


def base_name(c: Column) -> Column:
    """The last part of a path, without its suffix."""
    return F.regexp_replace(F.regexp_extract(c, r"([^/]*)$", 1), r"\.[^.]*$", "")


def extension(c: Column) -> Column:
    return F.regexp_extract(c, r"\.([^./]*)$", 1)


def cubic_extrema(b: Column, c: Column, d: Column) -> Column:
    """Where a + b x + c x**2 + d x**3 has its extrema, ascending."""
    return quadratic_roots(3 * d, 2 * c, b)


def i_div(a: Column, b: Column) -> Column:
    """Null where the divisor holds zero."""
    q = [x / y for x in (a["min"], a["max"]) for y in (b["min"], b["max"])]
    return F.when((b["min"] > 0) | (b["max"] < 0), interval(F.least(*q), F.greatest(*q)))


def i_cube(a: Column) -> Column:
    return interval(a["min"] * a["min"] * a["min"], a["max"] * a["max"] * a["max"])


def i_sqrt(a: Column) -> Column:
    """Of the part that isn't negative; null without any."""
    return F.when(a["max"] >= 0, interval(F.sqrt(F.greatest(a["min"], F.lit(0.0))), F.sqrt(a["max"])))


def i_power(a: Column, k: int) -> Column:
    """A whole power of at least 1."""
    p, q = F.pow(a["min"], F.lit(float(k))), F.pow(a["max"], F.lit(float(k)))
    if k % 2:
        return interval(p, q)
    return interval(F.when((a["min"] <= 0) & (a["max"] >= 0), 0.0).otherwise(F.least(p, q)), F.greatest(p, q))


def i_sign(a: Column) -> Column:
    """1, -1, or 0 where the interval holds zero."""
    return F.when(a["min"] > 0, 1).when(a["max"] < 0, -1).otherwise(0)


def i_poly(x: Column, *coefficients: float) -> Column:
    """Bounds of a polynomial of at most third degree, exact: at the ends and at the extrema within."""
    a, b, c, d = (float(k) for k in (*coefficients, 0, 0, 0, 0)[:4])
    at = F.array(x["min"], x["max"])
    inner = cubic_extrema(F.lit(b), F.lit(c), F.lit(d)) if d else F.array(F.lit(-b / (2 * c))) if c else F.array().cast("array<double>")
    at = F.concat(at, F.filter(inner, lambda t: (t > x["min"]) & (t < x["max"])))
    values = F.transform(at, lambda t: poly(t, a, b, c, d))
    return interval(F.array_min(values), F.array_max(values))
