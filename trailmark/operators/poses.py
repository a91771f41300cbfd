"""Rigid motions as arrays of sixteen values, row by row, and as position with quaternion ``x, y, z, qw, qx, qy, qz``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _at(m: Column, r: int, c: int) -> Column:
    return F.get(m, F.lit(4 * r + c))


def from_angles(x: Column, y: Column, z: Column, roll: Column, pitch: Column, yaw: Column) -> Column:
    """Turn by roll, then pitch, then yaw, and shift."""
    (cr, sr), (cp, sp), (cy, sy) = ((F.cos(a), F.sin(a)) for a in (roll, pitch, yaw))
    zero, one = F.lit(0.0), F.lit(1.0)
    return F.array(
        cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, x, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, y, -sp, cp * sr, cp * cr, z, zero, zero, zero, one
    )


def compose(a: Column, b: Column) -> Column:
    """F-07: ``a`` after ``b``: the matrix product."""
    return _let(a, lambda p: _let(b, lambda q: F.array(*[sum((_at(p, r, k) * _at(q, k, c) for k in range(1, 4)), _at(p, r, 0) * _at(q, 0, c)) for r in range(4) for c in range(4)])))


def inverse(m: Column) -> Column:
    """F-07: the transposed turn, and the shift turned back."""

    def of(t: Column) -> Column:
        out = []
        for r in range(3):
            back = sum((_at(t, k, r) * _at(t, k, 3) for k in (1, 2)), _at(t, 0, r) * _at(t, 0, 3))
            out += [_at(t, 0, r), _at(t, 1, r), _at(t, 2, r), -back]
        return F.array(*out, F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0))

    return _let(m, of)


def relative(a: Column, b: Column) -> Column:
    """F-07: ``b`` as seen from ``a``."""
    return compose(inverse(a), b)


def distance(a: Column, b: Column) -> Column:
    """F-07: Euclidean distance of the positions."""
    return F.sqrt(sum(((_at(a, r, 3) - _at(b, r, 3)) ** 2 for r in (1, 2)), (_at(a, 0, 3) - _at(b, 0, 3)) ** 2))


def rotation_angle(a: Column, b: Column) -> Column:
    """F-05, F-07: angle between the two turns, in radians."""
    trace = sum((_at(a, r, c) * _at(b, r, c) for r in range(3) for c in range(3)), F.lit(0.0))
    return F.acos(F.least(F.greatest((trace - 1.0) / 2.0, F.lit(-1.0)), F.lit(1.0)))


def is_valid(m: Column, tolerance: float = 1e-6) -> Column:
    """F-07: sixteen values, a last row of 0, 0, 0, 1, and a turn without reflection or scale."""

    def of(t: Column) -> Column:
        off = [F.abs(sum((_at(t, r, k) * _at(t, s, k) for k in range(3)), F.lit(0.0)) - (1.0 if r == s else 0.0)) for r in range(3) for s in range(r, 3)]
        det = sum((_at(t, 0, i) * (_at(t, 1, j) * _at(t, 2, k) - _at(t, 1, k) * _at(t, 2, j)) for i, j, k in ((0, 1, 2), (1, 2, 0), (2, 0, 1))), F.lit(0.0))
        last = [F.abs(_at(t, 3, c) - (1.0 if c == 3 else 0.0)) for c in range(4)]
        return (F.size(t) == 16) & (F.greatest(*off, *last) <= tolerance) & (F.abs(det - 1.0) <= 10 * tolerance)

    return F.coalesce(_let(m, of), F.lit(False))


def quaternion(m: Column) -> Column:
    """F-08: ``qw, qx, qy, qz`` of a turn, ``qw`` not negative: each from the root that is largest."""

    def of(t: Column) -> Column:
        r = [[_at(t, i, j) for j in range(3)] for i in range(3)]
        squares = [1.0 + r[0][0] + r[1][1] + r[2][2], 1.0 + r[0][0] - r[1][1] - r[2][2], 1.0 - r[0][0] + r[1][1] - r[2][2], 1.0 - r[0][0] - r[1][1] + r[2][2]]
        # four times the products of two parts
        wx, wy, wz, xy, xz, yz = r[2][1] - r[1][2], r[0][2] - r[2][0], r[1][0] - r[0][1], r[0][1] + r[1][0], r[0][2] + r[2][0], r[1][2] + r[2][1]
        products = [[squares[0], wx, wy, wz], [wx, squares[1], xy, xz], [wy, xy, squares[2], yz], [wz, xz, yz, squares[3]]]
        most = F.greatest(*squares)
        picked = None
        for row, square in zip(products, squares, strict=True):
            one = F.array(*[p / (2.0 * F.sqrt(most)) for p in row])
            picked = F.when(square == most, one) if picked is None else picked.when(square == most, one)
        return _let(picked, lambda q: F.when(F.get(q, F.lit(0)) < 0, F.transform(q, lambda x: -x)).otherwise(q))

    return _let(m, of)


def to_seven(m: Column) -> Column:
    """F-08: position and quaternion."""
    return F.concat(F.array(*[_at(m, r, 3) for r in range(3)]), quaternion(m))


def from_seven(s: Column) -> Column:
    """F-08: the motion of a position and a quaternion, which need not be of unit length."""

    def of(p: Column) -> Column:
        size = F.sqrt(sum((F.get(p, F.lit(i)) ** 2 for i in range(4, 7)), F.get(p, F.lit(3)) ** 2))
        w, x, y, z = (F.get(p, F.lit(i)) / size for i in range(3, 7))
        at = [F.get(p, F.lit(i)) for i in range(3)]
        return F.array(
            1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y), at[0],
            2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x), at[1],
            2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y), at[2],
            F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0),
        )

    return _let(s, of)


def interpolate(a: Column, b: Column, share: Column) -> Column:
    """F-07: position on the line and turn on the arc between two motions."""

    def of(p: Column) -> Column:
        q = [[F.get(p["a"], F.lit(i)) for i in range(3, 7)], [F.get(p["b"], F.lit(i)) for i in range(3, 7)]]
        dot = sum((x * y for x, y in zip(*q, strict=True)), F.lit(0.0))
        sign = F.when(dot < 0, -1.0).otherwise(1.0)
        angle = F.acos(F.least(F.abs(dot), F.lit(1.0)))
        flat = angle < 1e-6
        near = F.when(flat, 1 - share).otherwise(F.sin((1 - share) * angle) / F.sin(angle))
        far = F.when(flat, share).otherwise(F.sin(share * angle) / F.sin(angle))
        turn = [near * x + far * sign * y for x, y in zip(*q, strict=True)]
        at = [F.get(p["a"], F.lit(i)) * (1 - share) + F.get(p["b"], F.lit(i)) * share for i in range(3)]
        return from_seven(F.array(*at, *turn))

    return _let(F.struct(to_seven(a).alias("a"), to_seven(b).alias("b")), of)


def moved(points: DataFrame, m: Column) -> DataFrame:
    """PF-06: ``x, y, z`` of the points moved; other columns, such as the intensity, stay."""
    p = points.withColumn("_m", m)
    new = {c: sum((_at(F.col("_m"), r, k) * F.col(d) for k, d in enumerate("xyz")), F.lit(0.0)) + _at(F.col("_m"), r, 3) for r, c in enumerate("xyz")}
    return p.select(*[new[c].alias(c) if c in new else F.col(c) for c in points.columns])


def spherical(x: Column, y: Column, z: Column) -> Column:
    """F-07: ``struct<r, azimuth, elevation>``; ``cartesian`` is its inverse."""
    r = F.sqrt(x * x + y * y + z * z)
    return F.struct(r.alias("r"), F.atan2(y, x).alias("azimuth"), F.asin(F.when(r > 0, z / r).otherwise(0.0)).alias("elevation"))


def cartesian(s: Column) -> Column:
    """F-07: ``struct<x, y, z>``."""
    flat = s["r"] * F.cos(s["elevation"])
    return F.struct((flat * F.cos(s["azimuth"])).alias("x"), (flat * F.sin(s["azimuth"])).alias("y"), (s["r"] * F.sin(s["elevation"])).alias("z"))
