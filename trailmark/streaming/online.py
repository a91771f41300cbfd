"""The online loop of a sequence: select keyframes, encode them, link them to the active graph, freeze what is old, and ask for loops.

``link`` keeps each sequence's state in the state store (``transformWithState``): the last selected pose, the vectors of the active
window, and the similarity links among them.  ``replay`` runs the same steps over a finished table.  ``loop`` joins a linked stream with a
``DescriptorStore``: every micro-batch is written, appended and asked under its number, so each step happens once whatever fails.

The state store must be RocksDB's (``spark.sql.streaming.stateStore.providerClass``).
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Any

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import StructType

from trailmark.streaming.store import DescriptorStore

INPUT = "seq_id long, at long, kind string, idx long, ts double, x double, y double, z double, yaw double, v array<double>"
OUTPUT = "seq_id long, at long, kind string, src long, dst long, score double, v array<double>"
POSE = ("ts", "x", "y", "z", "yaw")


@dataclass(frozen=True)
class Rules:
    """When a pose becomes a keyframe (``distance``, ``degrees``, ``seconds``; 0 takes every row), how it is encoded, and how it is linked: ``half``
    temporal neighbours on each side, and of the other active nodes the ``most_links`` best with a cosine of ``threshold`` or more."""

    distance: float
    degrees: float
    seconds: float
    half: int = 2
    most_active: int = 1000
    threshold: float = 0.9
    most_links: int = 5
    encode: Callable[[np.ndarray], np.ndarray] | None = None

    def selects(self, now: list[float], last: list[float] | None) -> bool:
        if last is None:
            return True
        turn = math.degrees(math.acos(min(1.0, max(-1.0, math.cos(now[4] - last[4])))))
        return math.dist(now[1:4], last[1:4]) > self.distance or turn > self.degrees or abs(now[0] - last[0]) > self.seconds


@dataclass
class Sequence:
    """What is known of one sequence: nodes in order with unit vectors' sources, links among active nodes, and what changed."""

    last: list[float] | None = None
    seen: int = -1
    window: dict[int, list[float]] = field(default_factory=dict)
    links: dict[tuple[int, int], float] = field(default_factory=dict)
    touched: set[int] = field(default_factory=set)
    dropped: set[int] = field(default_factory=set)
    linked: set[tuple[int, int]] = field(default_factory=set)
    cut: set[tuple[int, int]] = field(default_factory=set)

    def _link(self, idx: int, rules: Rules) -> Iterator[tuple]:
        """The best of the active nodes that aren't temporal neighbours, by falling cosine, then by number."""
        order = list(self.window)
        place = order.index(idx)
        others = [o for p, o in enumerate(order) if abs(p - place) > rules.half]
        if not others:
            return
        rows = np.array([self.window[o] for o in others], float)
        own = np.array(self.window[idx], float)
        norms = np.maximum(np.sqrt((rows * rows).sum(axis=1)), 1e-8) * max(math.sqrt(float(own @ own)), 1e-8)
        scores = np.round(rows @ own / norms, 9)
        best = sorted((-s, o) for s, o in zip(scores.tolist(), others, strict=True) if s >= rules.threshold)[: rules.most_links]
        for minus, other in best:
            pair = (min(idx, other), max(idx, other))
            self.links[pair] = -minus
            self.linked.add(pair)
            self.cut.discard(pair)
            yield "similar", idx, other, -minus, None
            yield "similar", other, idx, -minus, None

    def _unlink(self, idx: int) -> Iterator[tuple[int, int]]:
        for pair in [p for p in self.links if idx in p]:
            del self.links[pair]
            self.cut.add(pair)
            self.linked.discard(pair)
            yield pair

    def _freeze(self, idx: int) -> Iterator[tuple]:
        v = self.window.pop(idx)
        self.dropped.add(idx)
        self.touched.discard(idx)
        for _ in self._unlink(idx):
            pass
        yield "frozen", idx, None, None, v

    def clear(self) -> None:
        for idx in list(self.window):
            list(self._freeze(idx))
        self.last = None

    def close(self) -> Iterator[tuple]:
        """Freeze all active nodes in order."""
        for idx in list(self.window):
            yield from self._freeze(idx)
        self.last = None
        yield "closed", None, None, None, None

    def step(self, row: Any, rules: Rules) -> Iterator[tuple]:
        """Events ``kind, src, dst, score, v`` of one input row; one at or before the last seen is dropped."""
        if row.at <= self.seen:
            return
        self.seen = int(row.at)
        if row.kind == "reset":
            self.clear()
            yield "reset", None, None, None, None
        elif row.kind == "update":
            idx = int(row.idx)
            if idx not in self.window:
                return
            self.window[idx] = [float(c) for c in row.v]
            self.touched.add(idx)
            for a, b in self._unlink(idx):
                yield "unlinked", a, b, None, None
                yield "unlinked", b, a, None, None
            yield "updated", idx, None, None, self.window[idx]
            yield from self._link(idx, rules)
        else:
            now = [float(getattr(row, c)) for c in POSE]
            idx = int(row.idx)
            if not rules.selects(now, self.last) or idx in self.window:
                return
            self.last = now
            v = np.asarray(row.v, float)
            v = [float(c) for c in (v if rules.encode is None else rules.encode(v))]
            before = list(self.window)[-rules.half :] if rules.half else []
            self.window[idx] = v
            self.touched.add(idx)
            self.dropped.discard(idx)
            yield "keyframe", idx, None, None, v
            for old in before:
                yield "temporal", old, idx, None, None
                yield "temporal", idx, old, None, None
            yield from self._link(idx, rules)
            if len(self.window) > rules.most_active:
                yield from self._freeze(next(iter(self.window)))


def _frame(key: int, events: list[tuple]) -> pd.DataFrame:
    made = pd.DataFrame([(key, *e) for e in events], columns=["seq_id", "at", "kind", "src", "dst", "score", "v"], dtype=object)
    return made.astype({"seq_id": "int64", "at": "int64", "src": "Int64", "dst": "Int64", "score": "float64"})


class Linker(StatefulProcessor):
    """One sequence's state in the store; only what changed is written back.  A sequence that is ``idle_ms`` without rows is closed."""

    def __init__(self, rules: Rules, idle_ms: int | None):
        self.rules, self.idle_ms = rules, idle_ms

    def init(self, handle) -> None:
        self.handle = handle
        self.head = handle.getValueState("head", "last array<double>, seen long")
        self.window = handle.getMapState("window", "idx long", "v array<double>")
        self.links = handle.getMapState("links", "a long, b long", "score double")

    def _load(self) -> Sequence:
        last, seen = self.head.get() if self.head.exists() else (None, -1)
        window = {int(k[0]): [float(c) for c in v[0]] for k, v in self.window.iterator()} if self.window.exists() else {}
        links = {(int(k[0]), int(k[1])): float(v[0]) for k, v in self.links.iterator()} if self.links.exists() else {}
        return Sequence(None if last is None else [float(c) for c in last], int(seen), dict(sorted(window.items())), links)

    def _store(self, s: Sequence) -> None:
        self.head.update((s.last, s.seen))
        for idx in s.dropped - s.window.keys():
            if self.window.containsKey((idx,)):
                self.window.removeKey((idx,))
        for idx in s.touched:
            self.window.updateValue((idx,), (s.window[idx],))
        for pair in s.cut:
            if self.links.containsKey(pair):
                self.links.removeKey(pair)
        for pair in s.linked:
            self.links.updateValue(pair, (s.links[pair],))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        s, out = self._load(), []
        for row in pd.concat(list(rows)).sort_values("at", kind="stable").itertuples(index=False):
            out += [(int(row.at), *e) for e in s.step(row, self.rules)]
        self._store(s)
        if self.idle_ms is not None:
            for old in list(self.handle.listTimers()):
                self.handle.deleteTimer(old[0] if isinstance(old, tuple) else old)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.idle_ms)
        yield _frame(int(key[0]), out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        s = self._load()
        out = [(s.seen, *e) for e in s.close()]
        self._store(s)
        yield _frame(int(key[0]), out)

    def close(self) -> None:
        pass


def link(events: DataFrame, rules: Rules, idle_ms: int | None = None) -> DataFrame:
    """G-07, S-01 to S-03, Y-06: rows ``seq_id, at, kind, src, dst, score, v`` of a stream of ``INPUT``.

    Input kinds: ``scan`` (a pose and its points or vector ``v``, node ``idx``), ``update`` (a new vector for an active node, whose similarity
    links are made anew) and ``reset``.  ``at`` numbers a sequence's rows; node numbers ascend with it.  Rows are sorted within a micro-batch; one at or before the last seen is dropped, and
    so is a scan whose node is active already.  Output kinds: ``keyframe``, ``temporal``, ``similar``, ``unlinked``, ``updated``,
    ``frozen`` (left the window of ``most_active``; with its vector), ``reset``, ``closed``.
    """
    return events.groupBy("seq_id").transformWithStateInPandas(Linker(rules, idle_ms), StructType.fromDDL(OUTPUT), "append", "none" if idle_ms is None else "processingTime")


def replay(events: DataFrame, rules: Rules) -> DataFrame:
    """What ``link`` gives for a finished table: sequences are read in order, one state at a time."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        s, own = Sequence(), None
        for batch in batches:
            for key, part in batch.groupby("seq_id", sort=False):
                if key != own:
                    s, own = Sequence(), key
                out = [(int(row.at), *e) for row in part.itertuples(index=False) for e in s.step(row, rules)]
                for changed in (s.touched, s.dropped, s.linked, s.cut):
                    changed.clear()
                yield _frame(int(key), out)

    return events.repartition("seq_id").sortWithinPartitions("seq_id", "at").mapInPandas(run, OUTPUT)


def loop(linked: DataFrame, store: DescriptorStore, out: str, every: int, k: int, gap: int) -> DataStreamWriter:
    """S-01: a linked stream to ``out/events`` and its keyframes to ``store``; each ``every``-th node (never 0) asks the store as it then is, to ``out/answers``.

    All three are named by the micro-batch's number: what a failed attempt left is written anew, with the same rows.
    """
    top = out.rstrip("/")

    def step(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{top}/events/part={number}")
        made = batch.sparkSession.read.schema(OUTPUT).parquet(f"{top}/events/part={number}")
        store.answer(made.where("kind = 'keyframe'").select("seq_id", F.col("src").alias("idx"), "v"), number, f"{top}/answers", every, k, gap)

    return linked.writeStream.foreachBatch(step)
