"""Vectors, triangles and tetrahedra as column expressions.

A point or vector is a tuple of three columns; everything stays inside whole-stage code generation.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Vec = tuple[Column, Column, Column]


def vec(prefix: str = "", source: str = "") -> Vec:
    """The columns <prefix>x, <prefix>y, <prefix>z, of a source if named."""
    dot = f"{source}." if source else ""
    return tuple(F.col(f"{dot}{prefix}{c}") for c in "xyz")  # type: ignore[return-value]


class Corner:
    """A point of columns that are made when asked for, so that it can be named before there is a session."""

    def __init__(self, prefix: str):
        self.prefix = prefix

    def __iter__(self):
        return iter(vec(self.prefix))

    def __getitem__(self, i: int) -> Column:
        return vec(self.prefix)[i]

    def __len__(self) -> int:
        return 3


def add(a: Vec, b: Vec) -> Vec:
    return tuple(x + y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def sub(a: Vec, b: Vec) -> Vec:
    return tuple(x - y for x, y in zip(a, b, strict=True))  # type: ignore[return-value]


def scale(a: Vec, k) -> Vec:
    return tuple(x * k for x in a)  # type: ignore[return-value]


def dot(a: Vec, b: Vec) -> Column:
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def cross(a: Vec, b: Vec) -> Vec:
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def norm(a: Vec) -> Column:
    return F.sqrt(dot(a, a))


def dist2(a: Vec, b: Vec) -> Column:
    return dot(sub(a, b), sub(a, b))


def dist(a: Vec, b: Vec) -> Column:
    return F.sqrt(dist2(a, b))


def rounded(c: Column, digits: int = 6) -> Column:
    """Rounded, with minus zero made zero."""
    return F.round(c, digits) + F.lit(0.0)


def area(a: Vec, b: Vec, c: Vec) -> Column:
    return norm(cross(sub(b, a), sub(c, a))) / 2


def circumradius(a: Vec, b: Vec, c: Vec) -> Column:
    """1 for a degenerate triangle."""
    s = area(a, b, c)
    return F.when(s > 0, dist(a, b) * dist(b, c) * dist(c, a) / (4 * s)).otherwise(1.0)


def inradius(a: Vec, b: Vec, c: Vec) -> Column:
    """0 for a degenerate triangle."""
    s = area(a, b, c)
    return F.when(s > 0, 2 * s / (dist(a, b) + dist(b, c) + dist(c, a))).otherwise(0.0)


def unsigned_barycentric(p: Vec, a: Vec, b: Vec, c: Vec) -> Vec:
    """Ratios of the areas opposite each corner to the whole, without sign."""
    s = area(a, b, c)
    return area(p, b, c) / s, area(a, p, c) / s, area(a, b, p) / s


def signed_volume(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    return dot(sub(b, a), cross(sub(c, a), sub(d, a))) / 6


def tet_radius_ratio(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Inradius over circumradius, at most 1/3; 0 for a flat one."""
    v = F.abs(signed_volume(a, b, c, d))
    faces = area(a, b, c) + area(a, b, d) + area(a, c, d) + area(b, c, d)
    p = dist(a, b) * dist(c, d)
    q = dist(a, c) * dist(b, d)
    r = dist(a, d) * dist(b, c)
    w = F.sqrt(F.greatest(F.lit(0.0), (p + q + r) * (p + q - r) * (p - q + r) * (q + r - p)))
    return F.when((v > 0) & (w > 0), (3 * v / faces) / (w / (24 * v))).otherwise(0.0)


def tet_barycentric(p: Vec, a: Vec, b: Vec, c: Vec, d: Vec) -> tuple[Column, Column, Column, Column]:
    """Signed ratios of volumes; a quarter each for a flat tetrahedron."""
    v = signed_volume(a, b, c, d)
    parts = signed_volume(p, b, c, d), signed_volume(a, p, c, d), signed_volume(a, b, p, d), signed_volume(a, b, c, p)
    return tuple(F.when(v != 0, x / v).otherwise(0.25) for x in parts)  # type: ignore[return-value]


def in_tet(p: Vec, a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Inside or on the border, for either orientation."""
    s = F.signum(signed_volume(a, b, c, d))
    parts = signed_volume(p, b, c, d), signed_volume(a, p, c, d), signed_volume(a, b, p, d), signed_volume(a, b, c, p)
    out = F.lit(True)
    for x in parts:
        out = out & (x * s >= 0)
    return out


def closest_on_segment(p: Vec, a: Vec, b: Vec) -> Vec:
    d = sub(b, a)
    t = F.when(dot(d, d) > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(sub(p, a), d) / dot(d, d)))).otherwise(0.0)
    return add(a, scale(d, t))


def segment_distance(p: Vec, a: Vec, b: Vec) -> Column:
    return dist(p, closest_on_segment(p, a, b))


def triangle_distance2(p: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Squared distance of a point to a triangle: to its plane above the face, else to the nearest edge."""
    ab, ac, ap = sub(b, a), sub(c, a), sub(p, a)
    n = cross(ab, ac)
    n2 = dot(n, n)
    v = dot(cross(ap, ac), n) / n2
    w = dot(cross(ab, ap), n) / n2
    inside = (n2 > 0) & (v >= 0) & (w >= 0) & (v + w <= 1)
    edges = [dist2(p, closest_on_segment(p, x, y)) for x, y in ((a, b), (b, c), (c, a))]
    return F.when(inside, dot(ap, n) * dot(ap, n) / n2).otherwise(F.least(*edges))


def ray_triangle(o: Vec, d: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Hit time of a ray on a triangle of either winding; null without a hit."""
    e1, e2 = sub(b, a), sub(c, a)
    q = cross(d, e2)
    det = dot(e1, q)
    s = sub(o, a)
    u = dot(s, q) / det
    r = cross(s, e1)
    v = dot(d, r) / det
    t = dot(e2, r) / det
    return F.when((det != 0) & (u >= 0) & (v >= 0) & (u + v <= 1) & (t >= 0), t)


def left_turn(ax, ay, bx, by, cx, cy) -> Column:
    """Twice the signed area of a plane triangle."""
    return (bx - ax) * (cy - ay) - (by - ay) * (cx - ax)


def morton(x: Column, y: Column, z: Column, bits: int = 10) -> Column:
    """Interleaved bits, x lowest."""
    out = F.lit(0).cast("long")
    for k in range(bits):
        for axis, c in enumerate((x, y, z)):
            bit = F.shiftright(c.cast("long"), k).bitwiseAND(F.lit(1))
            out = out.bitwiseOR(F.shiftleft(bit, 3 * k + axis))
    return out


def unmorton(m: Column, axis: int, bits: int = 10) -> Column:
    out = F.lit(0).cast("long")
    for k in range(bits):
        out = out.bitwiseOR(F.shiftleft(F.shiftright(m, 3 * k + axis).bitwiseAND(F.lit(1)), k))
    return out


def quantize(c: Column, low, span, bits: int) -> Column:
    """Whole steps of (2**bits - 2) over the greatest span, rounded half up and clamped."""
    top = (1 << bits) - 1
    return F.greatest(F.lit(0), F.least(F.lit(top), F.floor((c - low) * (top - 1) / span + 0.5))).cast("int")


def dequantize(q: Column, low, span, bits: int) -> Column:
    return low + q * span / ((1 << bits) - 2)


def apex(p: Vec, n: Vec, one: Column, q: Vec, m: Vec, two: Column) -> tuple[Vec, Vec]:
    """The point at distance one from p and two from q on the left of p to q, seen against the mean of the normals n and m,
    and that mean as a unit vector; nulls where the three lengths make no triangle."""
    side = sub(q, p)
    length = norm(side)
    up = add(n, m)
    up = scale(up, 1 / norm(up))
    along = scale(side, 1 / length)
    across = cross(up, along)
    across = scale(across, 1 / norm(across))
    foot = F.greatest(F.lit(0.0), F.least(length, (length * length + one * one - two * two) / (2 * length)))
    rest = one * one - foot * foot
    fits = (length <= one + two) & (one <= length + two) & (two <= length + one) & (rest >= 0)
    at = add(add(p, scale(along, foot)), scale(across, F.sqrt(F.greatest(F.lit(0.0), rest))))
    only = lambda v: tuple(F.when(fits, c) for c in v)
    return only(at), only(up)


def ideal_length(curvature: Column, rho: float) -> Column:
    """Edge length whose arc turns by rho on a circle of that curvature."""
    return 2 * F.sin(F.lit(rho / 2)) / F.abs(curvature)


def step_length(d: Column, ideal: Column, reduction: float) -> Column:
    return (1 - reduction) * d + reduction * ideal


def inverse_mean_ratio(a: Vec, b: Vec, c: Vec) -> Column:
    """Sum of squared edges over 4 sqrt(3) areas: 1 for an equilateral triangle; 0 for a degenerate one."""
    s = area(a, b, c)
    e = dist2(a, b) + dist2(b, c) + dist2(c, a)
    return F.when(s > 0, e / (F.lit(4.0) * F.sqrt(F.lit(3.0)) * s)).otherwise(0.0)


Plane = tuple[Vec, Column]


def plane(normal: tuple, offset) -> Plane:
    """The points p with unit normal . p = offset over the normal's length."""
    n = tuple(x if isinstance(x, Column) else F.lit(float(x)) for x in normal)
    length = norm(n)
    return scale(n, 1 / length), (offset if isinstance(offset, Column) else F.lit(float(offset))) / length


def plane_distance(p: Vec, at: Plane) -> Column:
    """Signed: positive on the side the normal points to."""
    return dot(p, at[0]) - at[1]


def plane_project(p: Vec, at: Plane) -> Vec:
    return sub(p, scale(at[0], plane_distance(p, at)))


def plane_flip(at: Plane) -> Plane:
    return scale(at[0], -1), -at[1]


def plane_hit(o: Vec, d: Vec, at: Plane) -> Column:
    """Time at which a line meets a plane; null where it runs along it."""
    run = dot(d, at[0])
    return F.when(run != 0, (at[1] - dot(o, at[0])) / run)


def line_distance(p: Vec, a: Vec, b: Vec) -> Column:
    """Of a point to the line through a and b."""
    d = sub(b, a)
    return norm(cross(sub(p, a), d)) / norm(d)


def line_line_distance(a: Vec, b: Vec, c: Vec, d: Vec) -> Column:
    """Of the lines through a, b and c, d; of parallel ones, of c to the first."""
    n = cross(sub(b, a), sub(d, c))
    return F.when(norm(n) > 0, F.abs(dot(sub(c, a), n)) / norm(n)).otherwise(line_distance(c, a, b))


def ray_box(o: Vec, d: Vec, low: Vec, high: Vec) -> Column:
    """Time at which a ray enters a box (0 from inside); null if it doesn't."""
    enter, leave = F.lit(0.0), F.lit(float("inf"))
    for x, v, lo, hi in zip(o, d, low, high, strict=True):
        one, two = (lo - x) / v, (hi - x) / v
        inside = (x >= lo) & (x <= hi)
        enter = F.greatest(enter, F.when(v != 0, F.least(one, two)).when(inside, F.lit(0.0)).otherwise(F.lit(float("inf"))))
        leave = F.least(leave, F.when(v != 0, F.greatest(one, two)).otherwise(F.lit(float("inf"))))
    return F.when((enter <= leave) & (enter < float("inf")), enter)


def segment_triangle(p: Vec, q: Vec, a: Vec, b: Vec, c: Vec) -> Column:
    """Where between 0 and 1, both left out, a segment meets a triangle of either winding; null where it doesn't."""
    t = ray_triangle(p, sub(q, p), a, b, c)
    return F.when((t > 0) & (t < 1), t)


def box_class(inner_low: Vec, inner_high: Vec, low: Vec, high: Vec) -> Column:
    """Of one box against another: inside, outside (no point in common) or intersect."""
    into, out = F.lit(True), F.lit(False)
    for a, b, lo, hi in zip(inner_low, inner_high, low, high, strict=True):
        into, out = into & (a >= lo) & (b <= hi), out | (b < lo) | (a > hi)
    return F.when(out, "outside").when(into, "inside").otherwise("intersect")


def box_union(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> tuple[Vec, Vec]:
    return tuple(F.least(x, y) for x, y in zip(a[0], b[0], strict=True)), tuple(F.greatest(x, y) for x, y in zip(a[1], b[1], strict=True))  # type: ignore[return-value]


def box_meet(a: tuple[Vec, Vec], b: tuple[Vec, Vec]) -> tuple[Vec, Vec]:
    """Lower ends above upper ones where they don't meet."""
    return tuple(F.greatest(x, y) for x, y in zip(a[0], b[0], strict=True)), tuple(F.least(x, y) for x, y in zip(a[1], b[1], strict=True))  # type: ignore[return-value]


def box_enlarge(a: tuple[Vec, Vec], by) -> tuple[Vec, Vec]:
    return tuple(x - by for x in a[0]), tuple(x + by for x in a[1])  # type: ignore[return-value]


def box_axis(low: Vec, high: Vec, longest: bool = True) -> Column:
    """0, 1 or 2: the longest or the shortest axis, of equal ones the first."""
    sides = sub(high, low)
    best = F.greatest(*sides) if longest else F.least(*sides)
    return F.when(sides[0] == best, 0).when(sides[1] == best, 1).otherwise(2)


def in_triangle(px, py, ax, ay, bx, by, cx, cy) -> Column:
    """Of a plane point: inside or on the border, for either winding."""
    turns = [left_turn(ax, ay, bx, by, px, py), left_turn(bx, by, cx, cy, px, py), left_turn(cx, cy, ax, ay, px, py)]
    up, down = F.lit(True), F.lit(True)
    for t in turns:
        up, down = up & (t >= 0), down & (t <= 0)
    return up | down


def circumcentre(ax, ay, bx, by, cx, cy) -> tuple[Column, Column]:
    """Of a plane triangle; null where it is degenerate."""
    d = 2 * left_turn(ax, ay, bx, by, cx, cy)
    b2, c2 = (bx - ax) * (bx - ax) + (by - ay) * (by - ay), (cx - ax) * (cx - ax) + (cy - ay) * (cy - ay)
    return F.when(d != 0, ax + ((cy - ay) * b2 - (by - ay) * c2) / d), F.when(d != 0, ay + ((bx - ax) * c2 - (cx - ax) * b2) / d)


def triangles_meet(one: tuple[Vec, Vec, Vec], two: tuple[Vec, Vec, Vec]) -> Column:
    """Whether two triangles have points in common: none of the axes that can part them does. Touching counts.

    The axes are both normals, the nine products of edges and, for triangles in one plane, the six normals of edges in it.
    """
    e1 = [sub(one[(k + 1) % 3], one[k]) for k in range(3)]
    e2 = [sub(two[(k + 1) % 3], two[k]) for k in range(3)]
    n1, n2 = cross(e1[0], e1[1]), cross(e2[0], e2[1])
    axes = [n1, n2, *[cross(x, y) for x in e1 for y in e2], *[cross(n1, x) for x in e1], *[cross(n2, y) for y in e2]]
    met = F.lit(True)
    for axis in axes:
        a, b = [dot(axis, p) for p in one], [dot(axis, p) for p in two]
        met = met & (F.greatest(*a) >= F.least(*b)) & (F.greatest(*b) >= F.least(*a))
    return met


def quaternion_rotate(p: Vec, q: tuple) -> Vec:
    """A point turned by the unit quaternion (w, x, y, z)."""
    w, v = q[0], q[1:]
    t = scale(cross(v, p), 2)
    return add(add(p, scale(t, w)), cross(v, t))


def axis_quaternion(axis: Vec, angle) -> tuple:
    """The unit quaternion of a turn about an axis."""
    n, half = norm(axis), angle / 2
    return (F.cos(half), *scale(axis, F.sin(half) / n))


def from_spherical(r: Column, theta: Column, phi: Column) -> Vec:
    """From radius, angle to z and angle in the plane."""
    return r * F.sin(theta) * F.cos(phi), r * F.sin(theta) * F.sin(phi), r * F.cos(theta)
