"""Named descriptors, re-rankers and spectral policies, for runs that are told by name what to do."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trailmark.operators import baselines, encoder, grids, policies, spectral


@dataclass(frozen=True)
class Method:
    """X-01, BL-01: ``encode`` makes ``scan_id, v`` (and what re-ranking needs) of points; ``dim`` is the length of ``v``."""

    name: str
    dim: int
    encode: Callable[[DataFrame], DataFrame]


METHODS: dict[str, Method] = {}
#: X-03: spectral policies by name; each is made with its weights and works on batches of magnitudes.
POLICIES: dict[str, Callable[..., Callable[[np.ndarray], np.ndarray]]] = {
    "linear": policies.Filterbank, "conv1d": policies.ConvolutionPool, "attention": policies.QueryPool, "soft_binning": policies.soft_binning, "gated": policies.GatedPool
}
RERANKERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(method: Method) -> Method:
    """X-01: make a method known; a name that is taken is an error."""
    if method.name in METHODS:
        raise ValueError(f"{method.name} is registered already")
    METHODS[method.name] = method
    return method


def rerank(name: str, candidates: DataFrame) -> DataFrame:
    """X-02: order candidates by the named callback, which takes and returns ``q, c, ...``."""
    return RERANKERS[name](candidates)


def lookup(rows: DataFrame, key: str, value) -> DataFrame:
    """Y-01: the first row with a key, or none."""
    return rows.where(F.col(key) == value).orderBy(*[c for c in ("seq_id", "idx") if c in rows.columns] or [key]).limit(1)


def _scan_context(points: DataFrame) -> DataFrame:
    image = encoder.dense_images(grids.max_height(grids.polar_cells(points, 20, 60, 80.0, 0.1, open_low=True)), 20, 60)
    key = F.transform(F.sequence(F.lit(0), F.lit(19)), lambda r: F.aggregate(F.slice("image", r * 60 + 1, 60), F.lit(0.0), lambda s, x: s + x) / 60)
    return image.select("scan_id", spectral.unit(key).alias("v"), "image")


def _log_polar(points: DataFrame) -> DataFrame:
    cells = grids.max_height(grids.polar_cells(points, 20, 60, 80.0, 0.1, open_low=True))
    return baselines.spectral_signature(baselines.images(cells, "val", 60)).withColumnRenamed("descriptor", "v")


SPEC = encoder.Spec()
register(Method("spectral", (len(SPEC.bins) - 1) * SPEC.out_rows * 2 + (len(SPEC.bins) - 2) * SPEC.out_rows * 2, lambda points: encoder.encode_points(points, SPEC).withColumnRenamed("descriptor", "v")))
register(Method("scan_context", 20, _scan_context))
register(Method("log_polar", 20 * 31, _log_polar))
register(Method("planes", 192, lambda points: baselines.plane_projection(points).withColumnRenamed("descriptor", "v")))
