"""From points to descriptors: projection, gap filling, row pooling, spectrum, bin statistics, normalisation.

Cells are aggregated in the JVM before a scan becomes a row, so a scan's row is no larger than its image; the Fourier
transform is the only step in Arrow batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import baselines, grids, knn, spectral


@dataclass(frozen=True)
class Spec:
    """How scans are encoded: ``rows x cols`` image between the elevations, pooled to ``out_rows``; ``edges`` of the frequency bins;
    ``statistics`` of bins, ``inter`` (``diff``, ``ratio``) of neighbouring bins, ``cross`` frequencies of the cross spectrum;
    ``normalize``: each channel to unit length (``channels``), all to sum 1 (``sum``), or not (``none``)."""

    rows: int = 64
    cols: int = 360
    out_rows: int = 16
    r_min: float = 1.0
    r_max: float = 80.0
    e_min: float = -24.8
    e_max: float = 2.0
    edges: tuple[float, ...] = ()
    statistics: tuple[str, ...] = ("mean", "std")
    inter: tuple[str, ...] = ("diff",)
    cross: int = 0
    zero_center: bool = False
    log_magnitude: bool = False
    normalize: str = "channels"
    layout_cols: int = 60

    @property
    def freqs(self) -> int:
        return self.cols // 2 + 1

    @property
    def bins(self) -> list[float]:
        return list(self.edges) or spectral.octave_edges(self.freqs)


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), lambda x: body(x)), 1)


def _mean(xs: Column, n: float) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x) / n


def _windows(n: int, m: int) -> Column:
    return F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b - a).alias("n")) for a, b in grids.adaptive_windows(n, m)])


def full_rows(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """W-09: ``scan_id, grid``: all rows of an image from its cells ``row, col, val``: gaps are filled round the circle, and a row
    without values is a copy of the nearest above that has some, or else of the first below."""
    filled = grids.fill_gaps(cells, cols)
    lines = filled.groupBy("scan_id", "row").agg(F.transform(F.array_sort(F.collect_list(F.struct("col", "val"))), lambda x: x["val"]).alias("vals"))
    held = lines.groupBy("scan_id").agg(F.map_from_entries(F.collect_list(F.struct("row", "vals"))).alias("m"))

    def source(i: Column) -> Column:
        have = F.map_keys("m")
        return F.try_element_at("m", F.coalesce(F.array_max(F.filter(have, lambda k: k <= i)), F.array_min(have)))

    return held.select("scan_id", F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), source).alias("grid"))


def pooled_rows(grid: Column, rows: int, out: int, cols: int) -> Column:
    """A-09: adaptive average over rows; a flat image."""

    def window(held: Column, w: Column) -> Column:
        def mean(part: Column) -> Column:
            return F.transform(F.sequence(F.lit(0), F.lit(cols - 1)), lambda c: F.aggregate(part, F.lit(0.0), lambda s, r: s + F.get(r, c)) / w["n"])

        return _let(F.slice(held, w["a"] + 1, w["n"]), mean)

    return _let(grid, lambda held: F.flatten(F.transform(_windows(rows, out), lambda w: window(held, w))))


def pooled_columns(image: Column, rows: int, cols: int, out: int) -> Column:
    """A-09: adaptive average over the sectors of a flat image."""

    def line(held: Column, r: Column) -> Column:
        return F.transform(_windows(cols, out), lambda w: F.aggregate(F.slice(held, r * cols + w["a"] + 1, w["n"]), F.lit(0.0), lambda s, x: s + x) / w["n"])

    return _let(image, lambda held: F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: line(held, r))))


def images(points: DataFrame, spec: Spec) -> DataFrame:
    """``scan_id, image``: filled range images with ``out_rows`` rows."""
    cells = grids.range_image(points, spec.rows, spec.cols, spec.r_min, spec.r_max, spec.e_min, spec.e_max)
    grid = full_rows(cells.select("scan_id", "row", "col", F.col("range").alias("val")), spec.rows, spec.cols)
    return grid.select("scan_id", pooled_rows(F.col("grid"), spec.rows, spec.out_rows, spec.cols).alias("image"))


def _unit(v: Column) -> Column:
    return spectral.unit(v, 1e-12)


def _spectra(made: DataFrame, rows: int) -> DataFrame:
    """``scan_id, image, z, magnitudes``: the Fourier coefficients of each row of ``signal``, many images at once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                z = np.fft.rfft(np.stack(batch["signal"]).reshape(len(batch), rows, -1), axis=2).reshape(len(batch), -1)
                yield pd.DataFrame({"scan_id": batch["scan_id"], "image": batch["image"], "re": list(z.real), "im": list(z.imag), "magnitudes": list(np.abs(z))})

    kind = made.schema["scan_id"].dataType.simpleString()
    found = made.select("scan_id", "image", "signal").mapInPandas(run, f"scan_id {kind}, image array<double>, re array<double>, im array<double>, magnitudes array<double>")
    return found.select("scan_id", "image", F.struct("re", "im").alias("z"), "magnitudes")


def encode_images(made: DataFrame, spec: Spec, keep: bool = False) -> DataFrame:
    """SP-04 from images: ``scan_id, descriptor, entropy, layout``; ``keep`` adds ``image, magnitudes, channels`` (SP-15)."""
    rows, n, edges = spec.out_rows, spec.freqs, spec.bins
    centred = F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: _let(F.slice("image", r * spec.cols + 1, spec.cols), lambda line: _let(_mean(line, float(spec.cols)), lambda m: F.transform(line, lambda x: x - m)))))
    z = _spectra(made.withColumn("signal", centred if spec.zero_center else F.col("image")), rows)
    facts = z.withColumn("entropy", spectral.entropy(F.col("magnitudes"), rows, n))
    if spec.log_magnitude:  # SP-02
        facts = facts.withColumn("magnitudes", F.transform("magnitudes", lambda m: F.ln(m + 1e-8)))
    names = {"sum": "total", "mean": "mean", "std": "std", "max": "most", "min": "least"}

    def assembled(stats: Column) -> Column:
        own = [stats[names[s]] for s in spec.statistics]
        between = [F.transform(spectral.inter_bin(stats, names[s], len(edges) - 1, kind == "ratio"), lambda x: x["d"]) for kind in spec.inter for s in spec.statistics]
        channels = own + between
        if spec.cross:
            channels.append(_let(_low(rows, n, spec.cross), lambda low: F.flatten(F.transform(spectral.cross_spectrum(low, rows, spec.cross), lambda c: F.array(c["re"], c["im"])))))
        return F.array(*[_let(c, _unit) for c in channels] if spec.normalize == "channels" else channels)

    def summed(d: Column) -> Column:
        total = F.aggregate(d, F.lit(0.0), lambda a, x: a + x)
        return _let(total, lambda t: F.transform(d, lambda x: F.when(t > 1e-8, x / (t + 1e-8)).otherwise(1.0 / F.size(d))))

    facts = facts.withColumn("channels", _let(spectral.bin_statistics(F.col("magnitudes"), rows, n, edges), assembled))
    flat = F.flatten("channels")
    facts = facts.withColumn("descriptor", _let(flat, summed) if spec.normalize == "sum" else flat)
    layout = pooled_columns(F.col("image"), rows, spec.cols, spec.layout_cols)
    return facts.select("scan_id", "descriptor", "entropy", layout.alias("layout"), *(("image", "magnitudes", "channels") if keep else ()))


def _low(rows: int, n: int, freqs: int) -> Column:
    """The first frequencies but the constant one, of every row."""

    def part(name: str) -> Column:
        return F.flatten(F.transform(F.sequence(F.lit(0), F.lit(rows - 1)), lambda r: F.slice(F.col(f"z.{name}"), r * n + 2, freqs))).alias(name)

    return F.struct(part("re"), part("im"))


def encode_points(points: DataFrame, spec: Spec, keep: bool = False) -> DataFrame:
    """SP-04, SP-13: descriptor, entropy and layout of each scan of ``scan_id, x, y, z, intensity``."""
    return encode_images(images(points, spec), spec, keep)


def rotation_probe(points: DataFrame, spec: Spec, angles: list[float]) -> DataFrame:
    """SP-16: ``scan_id, spread``: the largest difference of any descriptor component between turns by the angles (radians)."""
    turned = None
    for k, angle in enumerate(angles):
        part = grids.yaw_rotate(points, angle).withColumn("scan_id", F.struct("scan_id", F.lit(k).alias("k")))
        turned = part if turned is None else turned.unionByName(part)
    each = encode_points(turned, spec).select("scan_id.scan_id", F.posexplode("descriptor").alias("at", "x"))
    spans = each.groupBy("scan_id", "at").agg((F.max("x") - F.min("x")).alias("d"))
    return spans.groupBy("scan_id").agg(F.max("d").alias("spread"))


def operating_table(points: DataFrame, keyframes: DataFrame, spec: Spec, sketch_freqs: int = 16) -> DataFrame:
    """IO-10: what a run needs of each selected scan: ``seq_id, idx``, pose, descriptor, entropy, layout, phase sketch and Scan Context.

    ``keyframes`` has ``seq_id, idx, scan_id`` and the pose; only its scans are encoded.  ``write_keyframes`` stores the table under its
    content's key.
    """
    seen = points.join(keyframes.select("scan_id").distinct(), "scan_id", "left_semi")
    made = encode_points(seen, spec).withColumn("sketch", spectral.rfft(F.col("layout"), spec.out_rows, 1, min(sketch_freqs, spec.layout_cols // 2)))
    cells = grids.max_height(grids.polar_cells(seen, 20, 60, spec.r_max, 0.1, open_low=True))
    context = cells.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("row", "col", "val"))).alias("context"))
    return keyframes.join(made, "scan_id").join(context, "scan_id", "left")


def shift_distances(a: np.ndarray, b: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    """SP-12: per pair of images (pairs by rows by sectors) the least mean cosine distance of columns over cyclic shifts.

    Fourier products give the sums for all shifts of all pairs at once; the shifts that can be the best are then taken exactly, with
    ``eps`` added to each product of norms.
    """
    n, m = np.linalg.norm(a, axis=1), np.linalg.norm(b, axis=1)
    good_a, good_b = n > eps, m > eps
    unit_a, unit_b = (np.where(g[:, None, :], x / np.where(g, k, 1)[:, None, :], 0) for x, k, g in ((a, n, good_a), (b, m, good_b)))
    cols = a.shape[2]

    def swept(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        return np.fft.irfft(np.fft.rfft(x) * np.conj(np.fft.rfft(y)), cols)

    cosines = swept(unit_a, unit_b).sum(axis=1)
    counts = np.rint(swept(good_a.astype(float), good_b.astype(float)))
    rough = np.where(counts > 0, 1 - cosines / np.maximum(counts, 1), 0.0)
    least = [np.where(g, k, np.inf).min(axis=1) for k, g in ((n, good_a), (m, good_b))]
    doubt = 1e-9 + 2 * eps / np.maximum(np.where(np.isfinite(least[0] * least[1]), least[0] * least[1], 1.0), eps)
    pair, shift = np.nonzero(rough <= (rough.min(axis=1) + doubt)[:, None])
    other = (np.arange(cols)[None, :] - shift[:, None]) % cols
    met = np.take_along_axis(b[pair], other[:, None, :], axis=2)
    norms, fine = np.take_along_axis(m[pair], other, axis=1), np.take_along_axis(good_b[pair], other, axis=1) & good_a[pair]
    d = np.where(fine, 1 - (a[pair] * met).sum(axis=1) / (n[pair] * norms + eps), 0.0).sum(axis=1) / np.maximum(fine.sum(axis=1), 1)
    out = np.full(len(a), np.inf)
    np.minimum.at(out, pair, d)
    return np.where(good_a.any(axis=1), out, 1.0)


def dense_images(cells: DataFrame, rows: int, cols: int) -> DataFrame:
    """``scan_id, image``: flat images of cells ``row, col, val``; empty cells are 0."""
    held = baselines.images(cells, "val", cols)
    return baselines.over_images(held, lambda x: x, "array<double>", "image", rows * cols)


def two_stage(images: DataFrame, coarse: int, kept: int, rows: int, cols: int, gap: int | None = None, past_only: bool = False) -> DataFrame:
    """BL-02: ``seq_id, q, c, dist, rank``: of the ``coarse`` nearest by key ``v``, the ``kept`` with the least shift distance.

    ``images`` has ``seq_id, idx, v, image``; a query meets its ``coarse`` candidates in one row set, which bounds a task's group.
    """
    top = knn.nearest(images, images, coarse, gap=gap, past_only=past_only).select("seq_id", "q", "c")
    own = images.select("seq_id", F.col("idx").alias("q"), F.col("image").alias("a"))
    other = images.select("seq_id", F.col("idx").alias("c"), F.col("image").alias("b"))
    met = top.join(own, ["seq_id", "q"]).join(other, ["seq_id", "c"])

    @F.pandas_udf("double")
    def distance(a: pd.Series, b: pd.Series) -> pd.Series:
        if not len(a):
            return pd.Series([], dtype="float64")
        parts = range(0, len(a), 1024)
        x, y = (np.stack(s).reshape(-1, rows, cols).astype(float) for s in (a, b))
        return pd.Series(np.concatenate([shift_distances(x[i : i + 1024], y[i : i + 1024]) for i in parts]))

    scored = met.select("seq_id", "q", "c", F.round(distance("a", "b"), 9).alias("dist"))
    rank = F.row_number().over(Window.partitionBy("seq_id", "q").orderBy("dist", "c"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= kept)
