"""Keyframe selection on a stream of poses, with the last selected pose as each sequence's state."""

from __future__ import annotations

import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

FIELDS = ("ts", "x", "y", "z", "yaw")


def stream_keyframes(poses: DataFrame, distance: float, degrees: float, seconds: float) -> DataFrame:
    """S-01, S-02: ``seq_id, idx, ts, selected`` of a stream ``seq_id, idx, ts, x, y, z, yaw``.

    Equals the batch operator where rows come in order.  Rows are sorted within a micro-batch; a row at or before the
    last one seen of its sequence is late and dropped.
    """

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(parts)).sort_values("idx")
        last, seen = (list(state.get[:5]), state.get[5]) if state.exists else (None, -1)
        out = []
        for r in rows.itertuples(index=False):
            if r.idx <= seen:
                continue
            now = [getattr(r, c) for c in FIELDS]
            chosen = last is None
            if not chosen:
                turn = math.degrees(math.acos(min(1.0, max(-1.0, math.cos(now[4] - last[4])))))
                chosen = math.dist(now[1:4], last[1:4]) > distance or turn > degrees or abs(now[0] - last[0]) > seconds
            last, seen = (now if chosen else last), r.idx
            out.append((r.seq_id, r.idx, r.ts, chosen))
        if last is not None:
            state.update((*map(float, last), int(seen)))
        yield pd.DataFrame(out, columns=["seq_id", "idx", "ts", "selected"])

    return poses.groupBy("seq_id").applyInPandasWithState(
        run, "seq_id long, idx long, ts double, selected boolean", "ts double, x double, y double, z double, yaw double, seen long", "append", GroupStateTimeout.NoTimeout
    )
