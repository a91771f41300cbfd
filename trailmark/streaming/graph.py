"""The keyframe graph on a stream: a window of the latest nodes is each sequence's state, older ones are frozen."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

EVENT = "seq_id long, kind string, src long, dst long"


def stream_graph(keyframes: DataFrame, half: int, most_active: int) -> DataFrame:
    """G-07, S-03: rows ``seq_id, kind, src, dst`` of a stream ``seq_id, idx``.

    ``kind`` is ``edge`` for the temporal edges, both ways, from a new node to the ``half`` nodes before it,
    or ``frozen`` (``src`` only) when a node leaves the window of ``most_active``.  The
    state holds that window alone.  Rows are sorted within a micro-batch; one at or before the last seen is dropped.
    """
    if most_active < half:
        raise ValueError("the window must hold the neighbours of a new node")

    def run(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        active, out = (list(state.get[0]) if state.exists else []), []
        for idx in sorted(set(pd.concat(list(parts))["idx"].tolist())):
            if active and idx <= active[-1]:
                continue
            for old in active[max(0, len(active) - half) :]:
                out += [(key[0], "edge", old, idx), (key[0], "edge", idx, old)]
            active.append(idx)
            if len(active) > most_active:
                out.append((key[0], "frozen", active.pop(0), None))
        if active:
            state.update((active,))
        frame = pd.DataFrame(out, columns=["seq_id", "kind", "src", "dst"])
        yield frame.astype({"dst": "Int64"})

    return keyframes.groupBy("seq_id").applyInPandasWithState(run, EVENT, "active array<long>", "append", GroupStateTimeout.NoTimeout)
