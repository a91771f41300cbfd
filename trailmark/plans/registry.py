"""All registered queries of the reference operators, with their SQL."""

from __future__ import annotations

import importlib

from trailmark.plans.base import QUERIES, SQL

MODULES = ("grid_queries", "spectral_queries", "trajectory_queries", "retrieval_queries", "graph_queries", "stats_queries", "mining_queries", "codec_queries", "learned_queries", "encoder_queries", "pose_queries", "diagnostic_queries", "network_queries", "verification_queries", "policy_queries", "evaluation_queries")


def _load() -> None:
    for name in MODULES:
        importlib.import_module(f"trailmark.plans.{name}")


def queries() -> dict:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(SQL)
