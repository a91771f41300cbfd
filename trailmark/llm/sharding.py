"""Sharding by fixed virtual slots.

Records hash into ``slots`` virtual slots (thousands).  Bytes are summed per
slot, the slots are dealt to shards largest first, each to the least loaded
shard, and the assignment is kept as a versioned table ``version, vslot, piece, shard,
bytes, rows``.  Rebalancing edits that table and never the hash, so only the records
of the moved slots move.

A slot with more than ``1 / PARTS`` of a shard's fair share of bytes, as where one record repeats often, is cut into pieces of
equal rows by the records' order within the slot, and pieces are dealt in place of the slot.  Records that are alike in
their key stand side by side there; they are counted and not numbered one by one, so one record with a third of all rows is a row of counts.

The slot table has ``slots`` rows and a few hundred for cut slots whatever the input, so it may be gathered into
one row for dealing and broadcast for the lookup.

Copies of a text hash by their own ids, so a text with a third of all rows spreads over all slots and the bytes of shards
stay even; slots hold records and not groups of equal texts.

Defined cases: a null text has size 1 and a null CRC; a null id hashes by its text
alone; repeated rows are placed one by one, in any order among themselves; an empty table gives an empty
assignment of every slot; the input's columns stay, and the added ones
(``vslot, size, text_crc32, shard, slot``) replace any of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from trailmark.llm.common import free_name, new_path

SLOTS = 4096
PARTS = 64  # of a shard's fair share that a slot may hold uncut
_AT_ONCE = 1 << 16  # rows that one count becomes in a task


def slot_of(id_col: str, text_col: str, slots: int = SLOTS) -> Column:
    """The virtual slot of a record, by a hash that other engines have too; the text's CRC splits repeated and null ids."""
    digest = F.md5(F.concat_ws(":", F.col(id_col).cast("string"), F.crc32(F.col(text_col)).cast("string")))
    return (F.conv(F.substring(digest, 1, 8), 16, 10).cast("long") % slots).cast("int")


def sized(docs: DataFrame, id_col: str, text_col: str, slots: int = SLOTS) -> DataFrame:
    """``docs`` with its virtual slot, size in bytes plus one, and the text's CRC-32."""
    return docs.withColumns(
        {
            "vslot": slot_of(id_col, text_col, slots),
            "size": (F.coalesce(F.octet_length(text_col), F.lit(0)) + 1).cast("long"),
            "text_crc32": F.crc32(F.col(text_col)),
        }
    )


def _div(a: Column, b: Column) -> Column:
    """Whole quotient of longs."""
    return F.call_function("div", a, b)


def key_counts(records: DataFrame, key: list[str]) -> DataFrame:
    """``vslot``, the ``key`` columns, ``size``, ``copies`` and ``start``: each distinct record, how often it is there, and the
    place of the first in its slot by order of the key.  ``key`` must tell records of unlike size apart."""
    columns = [c for c in key if c != "size"]
    counted = records.groupBy("vslot", *columns, "size").agg(F.count(F.lit(1)).alias("copies"))
    before = F.sum("copies").over(Window.partitionBy("vslot").orderBy(*key).rowsBetween(Window.unboundedPreceding, -1))
    return counted.withColumn("start", F.coalesce(before, F.lit(0)))


def slot_pieces(counts: DataFrame, shards: int, slots: int = SLOTS) -> DataFrame:
    """``vslot, piece, pieces, slot_rows, bytes, rows``: every slot whole, or in pieces where it holds too many bytes.

    A record's piece is its place in the slot times ``pieces`` over ``slot_rows``.
    """
    held = counts.groupBy("vslot").agg(F.sum(F.col("size") * F.col("copies")).alias("slot_bytes"), F.sum("copies").alias("slot_rows"))
    total = counts.agg(F.sum(F.col("size") * F.col("copies")).alias("n")).scalar()
    share = F.col("slot_bytes") * (shards * PARTS)
    wanted = F.ceil(F.ceil(share / F.col("total")) / shards) * shards
    cut = F.when(share <= F.col("total"), F.lit(1)).otherwise(F.least("slot_rows", wanted)).cast("long")
    sized = held.withColumn("total", total).withColumn("pieces", cut).select("vslot", "slot_rows", "pieces")

    first, last = (_div(place * F.col("pieces"), F.col("slot_rows")) for place in (F.col("start"), F.col("start") + F.col("copies") - 1))
    spread = counts.join(F.broadcast(sized), "vslot").withColumn("piece", F.explode(F.sequence(first, last)))

    def begin(piece: Column) -> Column:
        return _div(piece * F.col("slot_rows") + F.col("pieces") - 1, F.col("pieces"))

    inside = F.least(begin(F.col("piece") + 1), F.col("start") + F.col("copies")) - F.greatest(begin(F.col("piece")), F.col("start"))
    summed = spread.withColumn("n", inside).groupBy("vslot", "piece", "pieces", "slot_rows").agg(F.sum(F.col("n") * F.col("size")).alias("bytes"), F.sum("n").alias("rows"))
    every = counts.sparkSession.range(slots).select(F.col("id").cast("int").alias("vslot"))
    filled = every.join(summed, "vslot", "left").na.fill(0, ["piece", "bytes", "rows"]).na.fill(1, ["pieces", "slot_rows"])
    return filled.select("vslot", F.col("piece").cast("int").alias("piece"), "pieces", "slot_rows", "bytes", "rows")


MAP = ("vslot", "piece", "pieces", "slot_rows", "bytes", "rows")


def deal(pieces: DataFrame, shards: int, version: int = 1) -> DataFrame:
    """Assign every slot or piece: largest first, each to the least loaded shard (the lower number on a tie)."""
    item = F.struct((-F.col("bytes")).alias("minus"), *[F.col(c) for c in MAP if c != "bytes"])
    start = F.struct(
        F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"),
        F.expr("cast(array() as array<struct<vslot:int,piece:int,pieces:bigint,slot_rows:bigint,bytes:bigint,rows:bigint,shard:int>>)").alias("given"),
    )

    def place(acc: Column, x: Column) -> Column:
        at = (F.array_position(acc.loads, F.array_min(acc.loads)) - 1).cast("int")
        loads = F.transform(acc.loads, lambda v, i: F.when(i == at, v - x.minus).otherwise(v))
        one = F.struct(*[(-x.minus if c == "bytes" else x[c]).alias(c) for c in MAP], at.alias("shard"))
        return F.struct(loads.alias("loads"), F.concat(acc.given, F.array(one)).alias("given"))

    ordered = pieces.agg(F.array_sort(F.collect_list(item)).alias("items"))
    given = ordered.select(F.explode(F.aggregate("items", start, place, lambda acc: acc.given)).alias("g")).select("g.*")
    return given.select(F.lit(version).alias("version"), *MAP, "shard")


def grow(slot_map: DataFrame, shards: int) -> DataFrame:
    """The next version with one more shard, which alone receives slots.

    Of each old shard the slots after its first ``shards / (shards + 1)`` of bytes
    (in slot order) move to shard number ``shards``.
    """
    w = Window.partitionBy("shard")
    run = F.sum("bytes").over(w.orderBy("vslot", "piece"))
    stays = run * (shards + 1) <= F.sum("bytes").over(w) * shards
    moved = F.when(stays, F.col("shard")).otherwise(F.lit(shards)).cast("int")
    return slot_map.select((F.col("version") + 1).alias("version"), *MAP, moved.alias("shard"))


def store_map(slot_map: DataFrame, path: str | None = None) -> DataFrame:
    """Append a version to the stored map (a Parquet table partitioned by version) and read it back."""
    spark: SparkSession = slot_map.sparkSession
    path = path or new_path(spark, "slot-map")
    slot_map.repartition(1).write.mode("append").partitionBy("version").parquet(path)
    return spark.read.schema(slot_map.schema).parquet(path)


def _starts(slot_map: DataFrame, start: str) -> DataFrame:
    """The map with the place in its shard at which each slot or piece begins, and in its slot at which a piece does."""
    before = F.sum("rows").over(Window.partitionBy("shard").orderBy("vslot", "piece").rowsBetween(Window.unboundedPreceding, -1))
    first = _div(F.col("piece") * F.col("slot_rows") + F.col("pieces") - 1, F.col("pieces"))
    return F.broadcast(slot_map.select("vslot", "piece", "shard", (F.coalesce(before, F.lit(0)) - first).alias(start)))


def _sizes(slot_map: DataFrame) -> DataFrame:
    return F.broadcast(slot_map.select("vslot", "pieces", "slot_rows").distinct())


def place(records: DataFrame, slot_map: DataFrame, key: list[str]) -> DataFrame:
    """Add ``shard`` and ``slot``, the record's gapless position in its shard, to records with any columns.

    A position is the count of the shard's earlier virtual slots plus the
    position within the virtual slot, so no window ever spans a shard.  Records are numbered within their slot; where
    one record may repeat without bound and only its key matters, ``place_counts`` does it without numbering.
    """
    kept = records.select(*[c for c in records.columns if c not in ("shard", "slot")])
    names = {c: free_name(kept, f"_{c}") for c in ("start", "inside", "piece", "pieces", "slot_rows")}
    start, inside, piece, pieces, slot_rows = names.values()
    numbered = kept.withColumn(inside, (F.row_number().over(Window.partitionBy("vslot").orderBy(*key)) - 1).cast("long"))
    sized = numbered.join(_sizes(slot_map).withColumnsRenamed({"pieces": pieces, "slot_rows": slot_rows}), "vslot")
    cut = sized.withColumn(piece, _div(F.col(inside) * F.col(pieces), F.col(slot_rows)).cast("int"))
    starts = _starts(slot_map, start).withColumnRenamed("piece", piece)
    return cut.join(F.broadcast(starts), ["vslot", piece]).withColumn("slot", F.col(start) + F.col(inside)).drop(*names.values())


def place_counts(counts: DataFrame, slot_map: DataFrame) -> DataFrame:
    """``counts`` (of ``key_counts``) as a row a record, with ``piece``, ``shard`` and ``slot``."""
    parts = F.sequence(F.lit(0).cast("long"), _div(F.col("copies") - 1, F.lit(_AT_ONCE)))
    many = counts.where(F.col("copies") > _AT_ONCE).withColumn("_part", F.explode(parts))
    many = many.withColumns({"_from": F.col("_part") * _AT_ONCE, "_to": F.least("copies", (F.col("_part") + 1) * _AT_ONCE)}).repartition("vslot", "_part")
    few = counts.where(F.col("copies") <= _AT_ONCE).withColumns({"_part": F.lit(0).cast("long"), "_from": F.lit(0).cast("long"), "_to": F.col("copies")})
    each = few.unionByName(many).withColumn("_inside", F.explode(F.sequence(F.col("start") + F.col("_from"), F.col("start") + F.col("_to") - 1)))
    cut = each.join(_sizes(slot_map), "vslot").withColumn("piece", _div(F.col("_inside") * F.col("pieces"), F.col("slot_rows")).cast("int"))
    placed = cut.join(_starts(slot_map, "_start"), ["vslot", "piece"]).withColumn("slot", F.col("_start") + F.col("_inside"))
    return placed.drop("_part", "_from", "_to", "_inside", "_start", "pieces", "slot_rows", "start", "copies")
