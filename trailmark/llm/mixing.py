"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed per cell (source, language, topic); the cell weights are raked
to the target marginals in turn, until no marginal is further than ``tolerance`` from its target or ``sweeps`` times; then
each cell gets a sampling probability, scaled so that the expected number of kept tokens is the budget, with
cells that would need more than all of their tokens kept whole.

The cell table is an aggregate.  Up to ``ONE_TASK_CELLS`` cells (counted first) are raked as one array by a fold, without
any shuffle; larger tables stay distributed and are written once a sweep.  The sampling factor is found by a
few sums over the cells.

``residual`` is the largest distance of a marginal from its target after the last sweep: targets that
contradict each other, or that the cells can't meet, show there and nowhere else.

Defined cases: null labels count as the category ``""``; a category without a target
shares the target ``other`` (0 if there is none) in proportion to its tokens, and so does a category of that name; targets of categories
that don't occur are spread over the rest; documents without tokens have the probability of their cell, and 0 if the cell has no token at
all; repeated rows share one draw; a null id has a draw like any other; an empty table gives no rows; the input's columns
stay, and the added ones (``_source, _lang, _topic, n_tokens, w, p, residual, kept``) replace any of the same name.
"""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import let, written

ONE_TASK_CELLS = 100_000
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Marginal:
    """Target shares of one label; ``power`` instead targets shares in proportion to tokens to that power."""

    shares: dict[str, float] = field(default_factory=dict)
    power: float | None = None


def n_tokens(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def topic_of(text: Column, rules: tuple[tuple[str, str], ...], default: str) -> Column:
    """The first topic whose pattern occurs in the text."""
    out = F.lit(default)
    for name, pattern in reversed(rules):
        out = F.when(text.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def uniform(key: Column, salt: str) -> Column:
    """A draw in [0, 1) that depends on the key and the salt alone."""
    digits = F.substring(F.md5(F.concat_ws(":", key.cast("string"), F.lit(salt))), 1, 12)
    return F.conv(digits, 16, 10).cast("double") / float(16**12)


def cells_of(features: DataFrame, labels: list[str]) -> DataFrame:
    return features.groupBy(*labels).agg(F.sum("n_tokens").cast("double").alias("n"))


def targets_of(cells: DataFrame, label: str, m: Marginal) -> DataFrame:
    """``label, t``: the target share of each category that occurs."""
    sums = cells.groupBy(label).agg(F.sum("n").alias("m"))
    if m.power is not None:
        raw = F.pow("m", F.lit(m.power))
    else:
        own = {k: v for k, v in m.shares.items() if k != "other"}
        given = F.create_map(*[F.lit(x) for kv in own.items() for x in kv]) if own else F.expr("cast(map() as map<string,double>)")
        named = F.col(label).isin(*own) if own else F.lit(False)
        rest = sums.where(~named).agg(F.sum("m")).scalar()
        raw = F.when(named, F.try_element_at(given, F.col(label))).otherwise(F.lit(float(m.shares.get("other", 0.0))) * F.col("m") / rest)
    sums = sums.withColumn("raw", F.coalesce(raw, F.lit(0.0)))
    return sums.select(label, (F.col("raw") / sums.agg(F.sum("raw")).scalar()).alias("t"))


def _fold(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """Raking of few cells: one row holds all of them, and per label the places of each category's cells with its target."""
    labels = list(targets)
    held = cells.agg(F.array_sort(F.collect_list(F.struct(*[c for c in cells.columns if c != "n"], "n"))).alias("c")).select(F.posexplode("c").alias("at", "c")).select("at", "c.*")
    held = written(held, "numbered")
    row = held.agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "n"))), lambda x: x["n"]).alias("w"))
    for label, t in targets.items():
        own = held.groupBy(label).agg(F.array_sort(F.collect_list("at")).alias("cells")).join(t, label)
        row = row.withColumn(f"g_{label}", own.agg(F.collect_list(F.struct("cells", "t"))).scalar())

    def summed(w: Column, places: Column) -> Column:
        return F.aggregate(places, F.lit(0.0), lambda a, i: a + F.get(w, i))

    def adjusted(groups: Column, w: Column) -> Column:
        """Each category's cells times its target over its weight, in the cells' order."""

        def parts(g: Column) -> Column:
            total = summed(w, g["cells"])
            return let(F.when(total > 0, g["t"] / total).otherwise(0.0), lambda f: F.transform(g["cells"], lambda i: F.struct(i.alias("i"), (F.get(w, i) * f).alias("w"))))

        return F.transform(F.array_sort(F.flatten(F.transform(groups, parts))), lambda x: x["w"])

    def gap(w: Column) -> Column:
        each = [F.array_max(F.transform(F.col(f"g_{label}"), lambda g: F.abs(summed(w, g["cells"]) - g["t"]))) for label in labels]
        return F.greatest(*each) if len(each) > 1 else each[0]

    def sweep(acc: Column, _: Column) -> Column:
        w = acc["w"]
        for label in labels:
            w = let(w, partial(adjusted, F.col(f"g_{label}")))
        made = let(w, lambda x: F.struct(x.alias("w"), gap(x).alias("residual")))
        return F.when(acc["residual"] <= tolerance, acc).otherwise(made)

    start = F.struct(F.col("w"), F.lit(float("inf")).alias("residual"))
    raked = row.select(F.aggregate(F.sequence(F.lit(1), F.lit(sweeps)), start, sweep).alias("r"))
    weights = raked.select(F.posexplode("r.w").alias("at", "w"), F.col("r.residual").alias("residual"))
    return held.join(weights, "at").drop("at")


def _loop(cells: DataFrame, targets: dict[str, DataFrame], sweeps: int, tolerance: float) -> DataFrame:
    """Raking of many cells: a sum and a join per label, and a table per sweep."""
    w, residual = cells.withColumn("w", F.col("n")), float("inf")
    for _ in range(sweeps):
        for label, t in targets.items():
            sums = w.groupBy(label).agg(F.sum("w").alias("s")).join(t, label)
            w = w.join(sums, label).withColumn("w", F.when(F.col("s") > 0, F.col("w") * F.col("t") / F.col("s")).otherwise(0.0)).drop("s", "t")
        w = written(w, "raked")
        residual = max(w.groupBy(label).agg(F.sum("w").alias("s")).join(t, label).agg(F.max(F.abs(F.col("s") - F.col("t")))).first()[0] or 0.0 for label, t in targets.items())
        if residual <= tolerance:
            break
    return w.withColumn("residual", F.lit(residual))


def rake(cells: DataFrame, marginals: dict[str, Marginal], sweeps: int = 25, tolerance: float = 1e-13, one_task: int = ONE_TASK_CELLS) -> DataFrame:
    """``cells`` (labels, ``n``) with the raked share ``w``, whose sum is 1, and ``residual``."""
    cells = cells.where("n > 0")
    targets = {label: written(targets_of(cells, label, m), "targets") for label, m in marginals.items()}
    return (_fold if _few(cells, one_task) else _loop)(cells, targets, sweeps, tolerance)


def _few(df: DataFrame, most: int = ONE_TASK_CELLS) -> bool:
    return df.count() <= most


def calibrate(raked: DataFrame, keep: float, rounds: int = 200) -> DataFrame:
    """Add ``p``: a common factor times ``w / n``, at most 1, that keeps ``keep`` of all tokens in expectation.

    ``raked`` is a written table.  The factor grows from that without any cell kept whole: each round keeps whole the
    cells that it pushes to 1 and deals what is left of the budget to the others, until no more cells join them.
    """
    total = raked.agg(F.sum("n")).first()[0] or 0.0
    factor, whole = None, -1
    for _ in range(rounds):
        full = F.lit(False) if factor is None else F.lit(factor) * F.col("w") >= F.col("n")
        facts = raked.agg(F.count(F.when(full, 1)).alias("k"), F.sum(F.when(full, F.col("n"))).alias("n"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if facts["k"] == whole:
            break
        whole = facts["k"]
        left, shares = keep * total - (facts["n"] or 0.0), facts["w"] or 0.0
        if shares <= 1e-15:
            factor = float("inf")  # all cells with a weight are kept whole
            break
        factor = max(0.0, left / shares)
    p = F.when(F.col("w") > 0, 1.0).otherwise(0.0) if factor is None or factor == float("inf") else F.least(F.lit(1.0), F.lit(factor) * F.col("w") / F.col("n"))
    return raked.withColumn("p", p)


def labelled(docs: DataFrame, text_col: str, rules: tuple[tuple[str, str], ...], default: str) -> DataFrame:
    """``docs`` with its category columns: ``_source, _lang, _topic``."""
    return docs.withColumns(
        {
            "_source": F.coalesce(F.col("source"), F.lit("")),
            "_lang": F.coalesce(F.col("lang"), F.lit("")),
            "_topic": topic_of(F.coalesce(F.col(text_col), F.lit("")), rules, default),
        }
    )


LABELS = ["_source", "_lang", "_topic"]


def chances(features: DataFrame, marginals: dict[str, Marginal], keep: float, sweeps: int = 25, one_task: int = ONE_TASK_CELLS) -> DataFrame:
    """A written row a cell: ``LABELS, n, w, residual, p``, from rows with the labels and ``n_tokens``."""
    cells = written(cells_of(features, LABELS), "cells")
    return written(calibrate(written(rake(cells, marginals, sweeps, one_task=one_task), "weights"), keep), "chances")


def draw(named: DataFrame, found: DataFrame, id_col: str, salt: str) -> DataFrame:
    """Labelled rows with ``w, p, residual`` of their cell and ``kept``."""
    cells = found.select(*LABELS, "w", "p", "residual")
    joined = named.drop("w", "p", "residual", "kept").join(F.broadcast(cells) if _few(cells) else cells, LABELS, "left").na.fill(0.0, ["w", "p"])
    return joined.withColumn("kept", uniform(F.coalesce(F.col(id_col).cast("string"), F.lit("")), salt) < F.col("p"))


def mix(docs: DataFrame, id_col: str, text_col: str, marginals: dict[str, Marginal], keep: float, rules: tuple[tuple[str, str], ...], default: str = "prose", sweeps: int = 25, salt: str = "mix", one_task: int = ONE_TASK_CELLS) -> DataFrame:
    """``docs`` with ``_source, _lang, _topic, n_tokens, w, p, residual, kept``; texts are read once for the cells and once for the rows."""
    named = labelled(docs, text_col, rules, default).withColumn("n_tokens", n_tokens(F.col(text_col)))
    return draw(named, chances(named, marginals, keep, sweeps, one_task), id_col, salt)
