"""Codecs of descriptors, poses and pose-graph edges, as expressions."""

from __future__ import annotations

import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOP = 65535


def _bound(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def quantize(histogram: Column, eps: float = 1e-8) -> Column:
    """F-10: a histogram over its sum in steps of 1/65535, rounded half to even; the largest bin takes the rounding error.

    A histogram without mass stays zero.
    """

    def scaled(total: Column) -> Column:
        return F.transform(histogram, lambda x: F.bround(F.when(total > eps, x / (total + eps)).otherwise(x) * TOP).cast("long"))

    def settle(q: Column) -> Column:
        error = TOP - F.aggregate(q, F.lit(0).cast("long"), lambda a, x: a + x)
        at = F.array_position(q, F.array_max(q)) - 1
        return F.transform(q, lambda x, i: F.when((i == at) & (error != TOP), F.least(F.greatest(x + error, F.lit(0)), F.lit(TOP))).otherwise(x))

    return _bound(_bound(F.aggregate(histogram, F.lit(0.0), lambda a, x: a + x), scaled), settle)


def dequantize(quantized: Column, eps: float = 1e-8) -> Column:
    """F-10: shares that sum to 1; without mass all bins are alike."""
    total = F.aggregate(quantized, F.lit(0.0), lambda a, x: a + x.cast("double"))
    return _bound(total, lambda t: F.transform(quantized, lambda x: F.when(t > eps, x / (t + eps)).otherwise(1 / F.size(quantized))))


def quaternion(yaw: Column) -> Column:
    """F-08: ``w, x, y, z`` of a turn about the vertical axis, with ``w`` not negative."""
    half = F.atan2(F.sin(yaw), F.cos(yaw)) / 2
    return F.array(F.cos(half), F.lit(0.0), F.lit(0.0), F.sin(half))


def seven(x: Column, y: Column, z: Column, yaw: Column) -> Column:
    """F-08: position and quaternion."""
    return F.concat(F.array(x, y, z), quaternion(yaw))


def g2o_line(src: Column, dst: Column, pose: Column, information: list[float]) -> Column:
    """IO-14: a pose-graph edge as text: quaternion with its real part last, and the upper triangle of a diagonal matrix."""
    order = [0, 1, 2, 4, 5, 6, 3]
    parts = [F.format_string("%.6f", F.round(F.get(pose, F.lit(i)), 6) + F.lit(0.0)) for i in order]
    upper = [f"{information[i] if i == j else 0.0:.1f}" for i in range(6) for j in range(i, 6)]
    return F.concat_ws(" ", F.lit("EDGE_SE3:QUAT"), src.cast("string"), dst.cast("string"), *parts, F.lit(" ".join(upper)))


#: The 152-byte record: 16 bins, 7 pose values, time, number, 20 bytes of digest, 60 bytes of padding.
RECORD = "<16H7fdI20s60x"


def pack(bins: Column, pose: Column, ts: Column, number: Column, digest: Column) -> Column:
    """IO-13: the record of a keyframe."""

    @F.pandas_udf("binary")
    def of(h: pd.Series, p: pd.Series, t: pd.Series, n: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([struct.pack(RECORD, *map(int, a), *map(float, b), c, e, f) for a, b, c, e, f in zip(h, p, t, n, d, strict=True)], dtype=object)

    return of(bins, pose, ts, number, digest)


def unpack(record: Column) -> Column:
    """IO-13: ``bins, pose, ts, number, digest`` of a record."""

    @F.pandas_udf("bins array<long>, pose array<double>, ts double, number long, digest binary")
    def of(records: pd.Series) -> pd.DataFrame:
        rows = [struct.unpack(RECORD, r) for r in records]
        return pd.DataFrame({"bins": [list(r[:16]) for r in rows], "pose": [np.asarray(r[16:23], np.float64) for r in rows], "ts": [r[23] for r in rows], "number": [r[24] for r in rows], "digest": [r[25] for r in rows]})

    return of(record)
