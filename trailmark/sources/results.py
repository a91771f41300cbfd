"""Evaluation logs, result files and caches."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: How logs print a block's average and a sequence's Recall@1, and how result files name the latter.
AVERAGE = r"AVERAGE\s+\|\s+R@1:\s+([0-9.]+)"
SEQUENCE = r"(\w[\w-]*)\s+\|\s+R@1:\s+([0-9.]+)\s+\(raw:"
RECALL_NAMES = ("R@1", "recall@1", "recall_at_1")


def read_best_block(spark: SparkSession, path: str) -> DataFrame:
    """IO-17: ``log, average, sequence, recall`` of the validation block with the best average of each log.

    A block is what stands between two averages; the first of equal averages wins, and the last line
    of a sequence within its block.  Files are rows, read whole.
    """
    logs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("log"), "value")
    ends = F.regexp_extract_all("value", F.lit(AVERAGE), F.lit(1))
    blocks = F.slice(F.split("value", AVERAGE), F.lit(1), F.size(ends))
    numbered = logs.select("log", F.posexplode(F.arrays_zip(blocks.alias("text"), ends.alias("average"))).alias("at", "b"))
    scored = numbered.select("log", "at", F.col("b.text").alias("text"), F.col("b.average").try_cast("double").alias("average")).where("average is not null")
    best = scored.groupBy("log").agg(F.max(F.struct("average", (-F.col("at")).alias("first"), "text")).alias("b"))
    lines = F.arrays_zip(F.regexp_extract_all("b.text", F.lit(SEQUENCE), F.lit(1)).alias("sequence"), F.regexp_extract_all("b.text", F.lit(SEQUENCE), F.lit(2)).alias("recall"))
    each = best.select("log", F.col("b.average").alias("average"), F.posexplode(lines).alias("at", "l"))
    last = each.groupBy("log", "average", F.col("l.sequence").alias("sequence")).agg(F.max(F.struct("at", "l.recall"))["recall"].alias("recall"))
    return last.withColumn("recall", F.col("recall").try_cast("double"))


def objects_in(tree: Any) -> Iterator[dict]:
    """The objects of a tree in file order, each before what it holds."""
    waiting = [tree]
    while waiting:
        node = waiting.pop()
        if isinstance(node, dict):
            yield node
        waiting += reversed(list(node.values()) if isinstance(node, dict) else node if isinstance(node, list) else [])


def first_number(tree: Any, names: tuple[str, ...] = RECALL_NAMES) -> float | None:
    """The number of the first object that has one of the names, by the order of names."""
    pairs = ((o, n) for o in objects_in(tree) for n in names)
    return next((float(o[n]) for o, n in pairs if isinstance(o.get(n), (int, float))), None)


def best_entry(tree: Any, blocks: tuple[str, ...]) -> tuple[str, float] | None:
    """``block.entry`` with the largest Recall@1 among the entries of the named blocks; the first of equal ones."""
    found = [
        (f"{b}.{k}", r)
        for b in blocks
        if isinstance(tree, dict) and isinstance(tree.get(b), dict)
        for k, v in tree[b].items()
        if not k.startswith("_") and isinstance(v, dict) and (r := first_number(v)) is not None
    ]
    return max(found, key=lambda x: x[1], default=None)


def read_results(spark: SparkSession, path: str, blocks: tuple[str, ...] = ()) -> DataFrame:
    """IO-18: ``file, sequence, entry, recall`` of result files: a JSON object by sequence each.

    With ``blocks``, the best entry of those; else the first Recall@1 found.  Names that start with ``_`` and
    files that aren't JSON objects are skipped.
    """

    @F.udf("array<struct<sequence:string,entry:string,recall:double>>")
    def crawl(text: str) -> list:
        try:
            tree = json.loads(text)
        except ValueError:
            return []
        out = []
        for name, part in (tree.items() if isinstance(tree, dict) else ()):
            got = best_entry(part, blocks) if blocks else ("", first_number(part))
            if not name.startswith("_") and got and got[1] is not None:
                out.append((name, got[0], got[1]))
        return out

    files = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("file"), crawl("value").alias("r"))
    return files.select("file", F.inline("r"))


def cache_key(parameters: dict[str, Any]) -> str:
    """IO-09: eight hex digits that depend on the parameters' names and values and not on their order."""
    return hashlib.sha256(json.dumps(parameters, sort_keys=True).encode()).hexdigest()[:8]


def write_keyframes(rows: DataFrame, folder: str, parameters: dict[str, Any]) -> str:
    """IO-08, IO-10, IO-11: a cache by content: Parquet by sequence; an error if it's there already.  Returns its path."""
    path = f"{folder.rstrip('/')}/{cache_key(parameters)}"
    rows.write.partitionBy("seq_id").mode("errorifexists").parquet(path)
    return path


def attach(rows: DataFrame, column: DataFrame, key: list[str]) -> DataFrame:
    """Y-02: rows with the columns of another table of the same keys; a missing or a doubled key is an error."""
    once = column.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"), *[F.first(c).alias(c) for c in column.columns if c not in key])
    checked = F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit("a key of the rows has no partner, or several")))
    return rows.join(once, key, "left").where(checked).drop("_n")


def _fixed(c: Column, places: int) -> Column:
    return F.format_string(f"%.{places}f", c.cast("double"))


def write_table(results: DataFrame, path: str) -> None:
    """IO-15: CSV with a header; recalls with four decimals, times with two."""
    shown = [_fixed(F.col(c), 4).alias(c) if c.startswith("recall_at_") else _fixed(F.col(c), 2).alias(c) if c.endswith("_ms") else F.col(c) for c in results.columns]
    results.select(*shown).write.mode("errorifexists").option("header", True).csv(path)


def write_records(records: DataFrame, path: str, by: str = "dataset") -> None:
    """IO-16: one JSON object a query, in a folder a dataset."""
    records.write.mode("errorifexists").partitionBy(by).json(path)


def matrix(results: DataFrame, value: str = "recall_at_1", method: str = "method", dataset: str = "dataset") -> DataFrame:
    """BL-08: methods by datasets, and each method's mean rank: 1 for the best of a dataset, ties share."""
    place = F.rank().over(Window.partitionBy(dataset).orderBy(F.desc(value)))
    ranks = results.withColumn("place", place).groupBy(method).agg(F.avg("place").alias("mean_rank"))
    return results.groupBy(method).pivot(dataset).agg(F.first(value)).join(ranks, method)
