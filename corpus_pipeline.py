"""From raw documents to a sharded training mix: five stages over whole tables.

Each stage takes ``(spark, docs, sf_dir)`` and returns a DataFrame, which is written as
Parquet and read again as the next stage's ``docs``.  All but the last return the columns
of ``documents``; the last adds the shard.

Defined cases, for every stage: an empty table stays empty; columns other than those of ``documents`` are dropped
whatever their names; null text counts as empty (the first stage rejects it, having no letter); rows with a null ``doc_id`` are
told apart by their text; null ``source`` and ``lang`` are categories of their own; of rows that repeat in id and text the second
stage keeps one, the other stages judge each; ties are settled by the lesser id.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import language, mixing, queries, sharding, simhash, winnow
from trailmark.llm.common import forget, new_path, stored, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]

#: SQL can't express the string kernel, the fingerprint groups or the slot hash.
ORACLE_SQL = None


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a learned language; those without letters or like no language go, and those without a label get the predicted one."""
    model = language.fit(docs, "doc_id", "text", "lang", language.fold_of("doc_id", 5) != 0)
    said = language.predict(docs.select(*COLUMNS), "text", model)
    least = model.floor if model else 0.0
    known = said.where((F.col("lang_pred") != language.UND) & (F.col("likeness") >= least))
    return known.withColumn("lang", F.coalesce("lang", "lang_pred")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash group: the smallest doc_id, and one row of it if rows repeat."""
    key = F.struct(F.col("doc_id").isNull().alias("unnamed"), F.coalesce("doc_id", F.lit(0)).alias("number"), F.xxhash64("text").alias("digest"))
    keyed = docs.select(*COLUMNS, key.alias("_key"))
    groups = written(simhash.near_duplicate_groups(keyed, "_key", "text").select(F.col("id").alias("_key"), "component_id"), "groups")
    # keys that go, and keys of rows that repeat, are few bytes beside the texts, which thus stay where they are
    dropped = winnow.sized(written(groups.where("_key <> component_id").select("_key").distinct(), "dropped"))
    often = winnow.sized(written(groups.where("_key = component_id").groupBy("_key").count().where("count > 1").select("_key"), "repeated"))
    kept = keyed.join(dropped, "_key", "left_anti")
    once = kept.join(often, "_key", "left_anti")
    return once.unionByName(kept.join(often, "_key", "left_semi").dropDuplicates(["_key"])).select(*COLUMNS)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark doesn't contaminate."""
    keyed = docs.select(*COLUMNS, F.sha2("text", 256).alias("_digest"))
    judged = winnow.decontaminate(keyed, table(spark, sf_dir, "benchmark"), id_col="_digest")
    bad = written(judged.where("contaminated").select(F.col("id").alias("_digest")).distinct(), "contaminated")
    return keyed.join(winnow.sized(bad), "_digest", "left_anti").select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A sample of the documents by their calibrated probabilities."""
    mixed = mixing.mix(docs.select(*COLUMNS), "doc_id", "text", queries.MARGINALS, queries.KEEP, queries.TOPICS, sweeps=queries.SWEEPS, salt=queries.SALT)
    return mixed.where("kept").select(*COLUMNS)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document with its shard, its place in it, and its virtual slot."""
    records = sharding.sized(docs.select(*COLUMNS), "doc_id", "text")
    counts = written(sharding.key_counts(records.select(*queries.KEY, "vslot"), queries.KEY), "slot-keys")
    slot_map = sharding.store_map(sharding.deal(sharding.slot_pieces(counts, queries.SHARDS), queries.SHARDS))
    placed = sharding.place(records, slot_map, queries.KEY)
    return placed.select(*COLUMNS, "size", "text_crc32", "shard", F.col("slot").cast("long").alias("slot"), "vslot")


STAGES = [
    ("language_id", identify_language),
    ("simhash_near_dedup", drop_near_duplicates),
    ("decontamination", decontaminate),
    ("source_mixing", mix_sources),
    ("sharding", shard),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        docs = stored(stage(spark, docs, sf_dir), path)
        if last:
            forget(spark, last)
        last = path
    return docs
