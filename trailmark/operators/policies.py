"""Spectral policies with given weights: batches of magnitudes, ``rows * freqs`` a scan, to descriptors.

Each is a function of a matrix of flat images, for ``network.applied``; its weights travel with it.
"""

from __future__ import annotations

from dataclasses import dataclass
from typing import Any

import numpy as np

from trailmark.operators import spectral
from trailmark.operators.network import Linear, Norm, relu


def _images(x: np.ndarray, rows: int) -> np.ndarray:
    return x.reshape(len(x), rows, -1)


def _closed(x: np.ndarray, project: Linear | None, norm: Norm | None) -> np.ndarray:
    out = x.reshape(len(x), -1)
    out = project(out) if project else out
    return norm(out) if norm else out


@dataclass(frozen=True)
class Filterbank:
    """N-09: each row's magnitudes through filters, the same for all rows or a layer a row."""

    rows: int
    filters: Linear | tuple[Linear, ...]
    norm: Norm | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = _images(x, self.rows)
        if isinstance(self.filters, Linear):
            return _closed(self.filters(m), None, self.norm)
        return _closed(np.stack([own(m[:, r]) for r, own in enumerate(self.filters)], axis=1), None, self.norm)


def soft_binning(rows: int, n: int, edges: list[float]) -> Filterbank:
    """N-09: Gaussian bins as a filter bank without a norm."""
    return Filterbank(rows, Linear(spectral.soft_bins(n, edges)))


@dataclass(frozen=True)
class ConvolutionPool:
    """N-09: per row ``kernels[row]`` (channels by width) slide over the frequencies, which are padded by zeros; what is positive is
    averaged over ``pieces`` adaptive windows."""

    rows: int
    kernels: Any
    bias: Any
    pieces: int
    project: Linear | None = None
    norm: Norm | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m, k = _images(x, self.rows), np.asarray(self.kernels, float)
        half, n = k.shape[2] // 2, m.shape[2]
        padded = np.pad(m, ((0, 0), (0, 0), (half, half)))
        views = np.lib.stride_tricks.sliding_window_view(padded, k.shape[2], axis=2)
        out = relu(np.einsum("brfw,rcw->brcf", views, k) + np.asarray(self.bias, float)[None, :, :, None])
        spans = [(i * n // self.pieces, -(-(i + 1) * n // self.pieces)) for i in range(self.pieces)]
        return _closed(np.stack([out[..., a:b].mean(axis=3) for a, b in spans], axis=3), self.project, self.norm)


@dataclass(frozen=True)
class QueryPool:
    """N-09: ``queries`` attend to the frequencies of each row; keys and values are layers over the magnitude beside a sinusoidal code of
    the frequency of ``code`` values; ``project`` works on each row, or on all rows at once if ``whole``."""

    rows: int
    queries: Any
    key: Linear
    value: Linear
    project: Linear
    heads: int
    code: int
    whole: bool = False
    norm: Norm | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = _images(x, self.rows)
        n = m.shape[2]
        angle = np.arange(n)[:, None] * 10_000.0 ** (-np.arange(0, self.code, 2) / self.code)[None, :]
        places = np.stack((np.sin(angle), np.cos(angle)), axis=2).reshape(n, -1)
        seen = np.concatenate((m[..., None], np.broadcast_to(places, (*m.shape, places.shape[1]))), axis=3)
        q = np.asarray(self.queries, float)
        width = q.shape[1] // self.heads
        q, k, v = q.reshape(len(q), self.heads, width), self.key(seen).reshape(*m.shape, self.heads, width), self.value(seen).reshape(*m.shape, self.heads, width)
        s = np.einsum("qhd,brfhd->brhqf", q, k) / np.sqrt(width)
        e = np.exp(s - s.max(axis=4, keepdims=True))
        out = np.einsum("brhqf,brfhd->brqhd", e / e.sum(axis=4, keepdims=True), v).reshape(len(x), self.rows, -1)
        return _closed(out.reshape(len(x), -1) if self.whole else self.project(out), self.project if self.whole else None, self.norm)


@dataclass(frozen=True)
class GatedPool:
    """N-09: mean, deviation (n - 1) and maximum of each row give a sigmoid gate per frequency; the same three of the gated rows, kind by
    kind, are the descriptor."""

    rows: int
    first: Linear
    last: Linear
    project: Linear | None = None
    norm: Norm | None = None

    def __call__(self, x: np.ndarray) -> np.ndarray:
        m = _images(x, self.rows)
        gate = 1 / (1 + np.exp(-self.last(relu(self.first(np.stack(self._facts(m), axis=2))))))
        return _closed(np.concatenate(self._facts(m * gate), axis=1), self.project, self.norm)

    @staticmethod
    def _facts(m: np.ndarray) -> list[np.ndarray]:
        return [m.mean(axis=2), m.std(axis=2, ddof=1), m.max(axis=2)]
