"""Spectral operators on array columns.

Images are row-major arrays of ``rows * sectors`` values.  A sketch is a pair of arrays
``re, im`` of ``rows * freqs`` coefficients.  The Fourier transform is a vectorised function
(Spark has none); everything after it is expressions over arrays.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def rfft(image: Column, rows: int, first: int, last: int, ortho: bool = False) -> Column:
    """SP-01, SP-06: coefficients ``first..last`` of every row, as ``struct<re, im>`` of arrays."""

    @F.pandas_udf("re array<double>, im array<double>")
    def of(images: pd.Series) -> pd.DataFrame:
        if not len(images):
            return pd.DataFrame({"re": [], "im": []})
        x = np.stack(images.to_numpy()).reshape(len(images), rows, -1)
        z = np.fft.rfft(x, axis=2, norm="ortho" if ortho else None)[:, :, first : last + 1].reshape(len(images), -1)
        return pd.DataFrame({"re": list(z.real), "im": list(z.imag)})

    return of(image)


def magnitudes(z: Column) -> Column:
    return F.zip_with(z["re"], z["im"], lambda a, b: F.sqrt(a * a + b * b))


def octave_edges(n: int) -> list[float]:
    """F-13: 0, then powers of two below ``n``, then ``n``."""
    return [0.0] + [float(1 << p) for p in range(max(0, (n - 1).bit_length()))] + [float(n)]


def exponential_edges(n: int, bins: int, alpha: float, eps: float = 1e-8) -> list[float]:
    """F-13: ``(e^(alpha t) - 1) / (e^alpha - 1) n`` at equal steps of ``t``."""
    return [(math.exp(alpha * i / bins) - 1) / (math.exp(alpha) - 1 + eps) * n for i in range(bins + 1)]


def bins_of(edges: list[float], n: int) -> list[tuple[int, int]]:
    """The frequencies ``a <= k < b`` of each bin; the last bin takes what lies beyond the edges."""
    at = np.clip(np.searchsorted(np.array(edges), np.arange(n), side="right") - 1, 0, len(edges) - 2)
    return [(int(np.searchsorted(at, b)), int(np.searchsorted(at, b, side="right"))) for b in range(len(edges) - 1)]


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def bin_statistics(mags: Column, rows: int, n: int, edges: list[float], eps: float = 1e-8) -> Column:
    """A-08: per row and bin ``struct<row, bin, total, mean, std, most, least>``; an empty bin is 0 with deviation ``sqrt(eps)``."""
    spans = F.array(*[F.struct(F.lit(b).alias("bin"), F.lit(i).alias("at"), F.lit(j - i).alias("n")) for b, (i, j) in enumerate(bins_of(edges, n))])

    def facts(r: Column, x: Column, part: Column) -> Column:
        count = F.greatest(x["n"], F.lit(1)).cast("double")
        mean = _sum(part) / count
        square = F.aggregate(part, F.lit(0.0), lambda a, v: a + v * v) / count
        return F.struct(
            r.alias("row"),
            x["bin"].alias("bin"),
            _sum(part).alias("total"),
            mean.alias("mean"),
            F.sqrt(F.greatest(square - mean * mean, F.lit(0.0)) + eps).alias("std"),
            F.coalesce(F.array_max(part), F.lit(0.0)).alias("most"),
            F.coalesce(F.array_min(part), F.lit(0.0)).alias("least"),
        )

    def row(held: Column, r: Column) -> Column:
        return F.transform(spans, lambda x: F.element_at(F.transform(F.array(F.slice(held, r * n + x["at"] + 1, x["n"])), lambda part: facts(r, x, part)), 1))

    every = F.sequence(F.lit(0), F.lit(rows - 1))
    return F.element_at(F.transform(F.array(mags), lambda held: F.flatten(F.transform(every, lambda r: row(held, r)))), 1)


def inter_bin(stats: Column, name: str, bins: int, ratio: bool, eps: float = 1e-8) -> Column:
    """W-10: difference, or difference of logs, of neighbouring bins in a row."""
    pairs = F.arrays_zip(F.slice(stats, 1, F.size(stats) - 1).alias("p"), F.slice(stats, 2, F.size(stats) - 1).alias("q"))
    kept = F.filter(pairs, lambda x: x["p"]["row"] == x["q"]["row"])

    def value(x: Column) -> Column:
        p, q = x["p"][name], x["q"][name]
        d = F.ln(q + eps) - F.ln(p + eps) if ratio else q - p
        return F.struct(x["p"]["row"].alias("row"), x["p"]["bin"].alias("bin"), d.alias("d"))

    return F.transform(kept, value)


def unit(v: Column, floor: float = 1e-8) -> Column:
    """PF-08: unit length, with a floor on the norm."""
    return F.element_at(F.transform(F.array(F.greatest(F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x * x)), F.lit(floor))), lambda n: F.transform(v, lambda x: x / n)), 1)


def entropy(mags: Column, rows: int, n: int, eps: float = 1e-8) -> Column:
    """A-11: mean over rows of the entropy of the power shares."""

    def row(r: Column) -> Column:
        power = F.transform(F.slice(mags, r * n + 1, n), lambda m: m * m)
        return F.element_at(F.transform(F.array(power), lambda p: F.element_at(F.transform(F.array(_sum(p) + eps), lambda t: -_sum(F.transform(p, lambda x: x / t * F.ln(x / t + eps)))), 1)), 1)

    return _sum(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), row)) / rows


def cross_spectrum(z: Column, rows: int, freqs: int, eps: float = 1e-8) -> Column:
    """SP-05: ``z_r conj(z_(r+1))`` over its magnitude, per neighbouring rows and frequency, as ``struct<re, im>`` items."""

    def at(i: Column) -> Column:
        j = i + freqs
        a, b, c, d = F.get(z["re"], i), F.get(z["im"], i), F.get(z["re"], j), F.get(z["im"], j)
        size = F.sqrt(a * a + b * b) * F.sqrt(c * c + d * d) + eps
        return F.struct(((a * c + b * d) / size).alias("re"), ((b * c - a * d) / size).alias("im"))

    return F.transform(F.sequence(F.lit(0), F.lit((rows - 1) * freqs - 1)), at)


def power(z: Column) -> Column:
    """SP-11: ``log1p(abs(z)^2)``."""
    return F.zip_with(z["re"], z["im"], lambda a, b: F.log1p(a * a + b * b))


def bispectrum(z: Column, rows: int, freqs: int) -> Column:
    """SP-11: ``z_k1 z_k2 conj(z_(k1+k2))`` per row, for ``k1 <= k2`` with ``k1 + k2 <= freqs``; the sketch has no DC."""
    out = []
    for r in range(rows):
        for k1 in range(1, freqs + 1):
            for k2 in range(k1, freqs - k1 + 1):
                (a, b), (c, d), (e, f) = ((F.get(z["re"], F.lit(r * freqs + k - 1)), F.get(z["im"], F.lit(r * freqs + k - 1))) for k in (k1, k2, k1 + k2))
                re, im = a * c - b * d, a * d + b * c
                out.append(F.struct(F.lit(r).alias("row"), F.lit(k1).alias("k1"), F.lit(k2).alias("k2"), (re * e + im * f).alias("re"), (im * e - re * f).alias("im")))
    return F.array(*out)


def shift_curve(q: Column, c: Column, rows: int, freqs: int, sectors: int) -> Column:
    """SP-08: cosine of two sketches at each cyclic shift, from the row-summed cross spectrum."""

    def cross(k: Column) -> Column:
        def at(r: Column) -> tuple[Column, ...]:
            i = r * freqs + k
            return F.get(q["re"], i), F.get(q["im"], i), F.get(c["re"], i), F.get(c["im"], i)

        def add(acc: Column, r: Column) -> Column:
            a, b, e, f = at(r)
            return F.struct((acc["re"] + a * e + b * f).alias("re"), (acc["im"] + a * f - b * e).alias("im"))

        return F.aggregate(F.sequence(F.lit(0), F.lit(rows - 1)), F.struct(F.lit(0.0).alias("re"), F.lit(0.0).alias("im")), add)

    def norm(z: Column) -> Column:
        return F.sqrt(_sum(F.zip_with(z["re"], z["im"], lambda a, b: a * a + b * b)))

    summed = F.transform(F.sequence(F.lit(0), F.lit(freqs - 1)), cross)
    size = F.greatest(norm(q) * norm(c), F.lit(1e-8))

    def curve(held: Column) -> Column:
        def at(s: Column) -> Column:
            def term(x: Column, k: Column) -> Column:
                angle = 2 * F.pi() * (k + 1) * s / sectors
                return x["re"] * F.cos(angle) + x["im"] * F.sin(angle)

            return _sum(F.transform(held["x"], term)) / held["n"]

        return F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), at)

    return F.element_at(F.transform(F.array(F.struct(summed.alias("x"), size.alias("n"))), curve), 1)


def alignment_features(curve: Column, sectors: int, temperature: float = 0.05) -> Column:
    """SP-10: best score, sine and cosine of the best shift, margin to the runner-up, normalised entropy of the shifts."""

    def of(c: Column) -> Column:
        top = F.sort_array(c, asc=False)
        best = F.get(top, F.lit(0))
        angle = 2 * F.pi() * (F.array_position(c, best) - 1) / sectors
        mass = _sum(F.transform(c, lambda s: F.exp((s - best) / temperature)))
        ent = -_sum(F.transform(c, lambda s: F.exp((s - best) / temperature) / mass * F.ln(F.greatest(F.exp((s - best) / temperature) / mass, F.lit(1e-8)))))
        return F.struct(best.alias("score"), F.sin(angle).alias("shift_sin"), F.cos(angle).alias("shift_cos"), (best - F.get(top, F.lit(1))).alias("margin"), (ent / math.log(max(sectors, 2))).alias("entropy"))

    return F.element_at(F.transform(F.array(curve), of), 1)


def phase_only_peak(a: Column, b: Column, rows: int, freqs: int, pad: int = 4, eps: float = 1e-6) -> Column:
    """SP-09: mean over rows of the peak of the padded phase-only correlation, in 0 to 1."""
    length = freqs * max(pad, 1)

    def row(r: Column) -> Column:
        def g(k: Column) -> Column:
            i = r * freqs + k
            p, q, s, t = F.get(a["re"], i), F.get(a["im"], i), F.get(b["re"], i), F.get(b["im"], i)
            re, im = p * s + q * t, q * s - p * t
            size = F.sqrt(re * re + im * im) + eps
            return F.struct((re / size).alias("re"), (im / size).alias("im"))

        def peak(c: Column) -> Column:
            def at(n: Column) -> Column:
                def angle(k: Column) -> Column:
                    return 2 * F.pi() * k * n / length

                re = _sum(F.transform(c, lambda x, k: x["re"] * F.cos(angle(k)) - x["im"] * F.sin(angle(k))))
                im = _sum(F.transform(c, lambda x, k: x["re"] * F.sin(angle(k)) + x["im"] * F.cos(angle(k))))
                return F.sqrt(re * re + im * im)

            most = F.array_max(F.transform(F.sequence(F.lit(0), F.lit(length - 1)), at)) / freqs
            return F.least(F.greatest(most, F.lit(0.0)), F.lit(1.0))

        return F.element_at(F.transform(F.array(F.transform(F.sequence(F.lit(0), F.lit(freqs - 1)), g)), peak), 1)

    return _sum(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), row)) / rows


def column_shift_distance(q: Column, c: Column, rows: int, sectors: int, eps: float = 1e-8) -> Column:
    """SP-12: least mean cosine distance of columns over cyclic shifts to the right; empty columns don't count, and a query without
    any filled column is at distance 1."""

    def norm(image: Column, col: Column) -> Column:
        return F.sqrt(_sum(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.get(image, r * sectors + col) * F.get(image, r * sectors + col))))

    def norms(image: Column) -> Column:
        return F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), lambda col: norm(image, col))

    def per(held: Column) -> Column:
        def at(s: Column) -> Column:
            def column(acc: Column, col: Column) -> Column:
                other = F.pmod(col - s, F.lit(sectors))
                dot = _sum(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.get(q, r * sectors + col) * F.get(c, r * sectors + other)))
                n, m = F.get(held["q"], col), F.get(held["c"], other)
                good = (n > eps) & (m > eps)
                return F.struct((acc["d"] + F.when(good, 1.0 - dot / (n * m + eps)).otherwise(0.0)).alias("d"), (acc["n"] + F.when(good, 1.0).otherwise(0.0)).alias("n"))

            zero = F.struct(F.lit(0.0).alias("d"), F.lit(0.0).alias("n"))
            return F.aggregate(F.sequence(F.lit(0), F.lit(sectors - 1)), zero, column, lambda x: x["d"] / F.greatest(x["n"], F.lit(1.0)))

        least = F.array_min(F.transform(F.sequence(F.lit(0), F.lit(sectors - 1)), at))
        return F.when(F.exists(held["q"], lambda n: n > eps), least).otherwise(F.lit(1.0))

    return F.element_at(F.transform(F.array(F.struct(norms(q).alias("q"), norms(c).alias("c"))), per), 1)


def soft_bins(n: int, edges: list[float], floor: float = 1.0) -> list[list[float]]:
    """N-09: Gaussian weights of each bin over the frequencies, centred in the bin, as wide as half of it, summing to 1."""
    out = []
    for a, b in zip(edges, edges[1:], strict=False):
        w = [math.exp(-0.5 * ((k - (a + b) / 2) / max((b - a) / 2, floor)) ** 2) for k in range(n)]
        out.append([x / (sum(w) + 1e-8) for x in w])
    return out


def soft_binned(mags: Column, rows: int, n: int, weights: list[list[float]]) -> Column:
    """N-09: fixed matrix product of each row's magnitudes with the bin weights."""
    w = F.array(*[F.array(*[F.lit(x) for x in one]) for one in weights])
    per = F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.transform(w, lambda one: _sum(F.zip_with(F.slice(mags, r * n + 1, n), one, lambda m, x: m * x))))
    return F.flatten(per)
