"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trailmark.llm import bpe, chat, embeddings, language, licenses, mixing, negatives, ngrams, sharding, simhash, sql, warc, whitening, winnow
from trailmark.llm.common import new_path, table, written

# --- op1 -------------------------------------------------------------------

CRAWL_START = 1_700_000_000
RECRAWL_AFTER = 30 * 86_400


def _header(name: str, value) -> Column:
    return F.struct(F.lit(name).alias("name"), (F.lit(value) if isinstance(value, str) else value).alias("value"))


def crawl_records(pages: DataFrame) -> DataFrame:
    """Two captures a page: a full response, and a not-modified revisit 30 days later.

    The revisit's validators vary with the page id: most repeat the ETag (weakly), some
    send a stale one, only a date, or none; a few revisits precede the response.
    """
    n, t0 = F.col("page_id"), F.lit(CRAWL_START) + F.col("page_id") * 60
    tag = F.concat(F.lit('"'), F.substring(F.md5("html"), 1, 16), F.lit('"'))
    at = F.when(n % 13 == 0, t0 - 1).otherwise(t0 + RECRAWL_AFTER)
    fresh_tag = F.when(n % 7 == 0, '"stale"').when((n % 5 == 0) | (n % 11 == 0), F.lit(None)).otherwise(F.concat(F.lit("W/"), tag))
    date = t0.cast("string")
    full = F.struct(
        (n * 2).alias("record_id"),
        t0.alias("ts"),
        F.lit("response").alias("kind"),
        tag.alias("etag"),
        date.alias("last_modified"),
        F.array(
            _header("Set-Cookie", F.concat(F.lit("sid="), n.cast("string"))),
            _header("Date", date),
            _header("Content-Type", "text/html; charset=utf-8"),
            _header("Content-Length", F.octet_length("html").cast("string")),
            _header("ETag", tag),
            _header("Set-Cookie", "a=1"),
            _header("Cache-Control", "max-age=600"),
            _header("Last-Modified", date),
        ).alias("headers"),
        F.sha2("html", 256).alias("payload_digest"),
    )
    revisit = F.struct(
        (n * 2 + 1).alias("record_id"),
        at.alias("ts"),
        F.lit("revisit").alias("kind"),
        fresh_tag.alias("etag"),
        F.when(n % 11 == 0, F.lit(None)).otherwise(date).alias("last_modified"),
        F.concat(
            F.array(
                _header("Vary", "Accept"),
                _header("cache-control", "max-age=60"),
                _header("Connection", "close"),
                _header("Date", at.cast("string")),
                _header("Set-Cookie", "sid=new"),
            ),
            F.when(fresh_tag.isNotNull(), F.array(_header("ETag", fresh_tag))).otherwise(F.array().cast("array<struct<name:string,value:string>>")),
        ).alias("headers"),
        F.lit(None).cast("string").alias("payload_digest"),
    )
    return pages.select("url", F.explode(F.array(full, revisit)).alias("r")).select("url", "r.*")


def op1_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every revisit of the crawl with its outcome, source response and merged headers."""
    found = warc.resolve_revisits(crawl_records(table(spark, sf_dir, "pages")))
    lines = F.array_join(F.transform("headers", lambda h: F.concat_ws(": ", h["name"], h["value"])), "\n")
    return found.withColumn("headers", lines)


# --- op2 -------------------------------------------------------------------


def op2_string_kernel_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the language that the string-kernel classifier predicts for its whole text."""
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold_of("doc_id", 5) == 0
    model = language.fit(docs, "doc_id", "text", "lang", ~held_out)
    said = language.predict(docs.select("doc_id", "text"), "text", model)
    return said.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")


# --- op3 -------------------------------------------------------------------


def op3_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its words inside benchmark windows, and the verdict."""
    judged = winnow.decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return judged.select(
        F.col("id").alias("doc_id"), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated"
    )


# --- op4 -------------------------------------------------------------------


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every formatted conversation, and of one that quotes control strings."""
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    says = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(says).alias("text")
    )
    return chat.digests(chat.format_chats(turns.unionByName(own)))


# --- op5 -------------------------------------------------------------------

SHARDS = 8


KEY = ["doc_id", "text_crc32", "size"]


def op5_virtual_slots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its shard under the law of near-equal bytes, and its shard after the stored map's second version, which has
    one shard more."""
    records = sharding.sized(table(spark, sf_dir, "documents"), "doc_id", "text").select(*KEY, "vslot")
    counts = written(sharding.key_counts(records, KEY), "slot-keys")
    path = new_path(spark, "slot-map")
    first = sharding.store_map(sharding.deal(sharding.slot_pieces(counts, SHARDS), SHARDS), path).where("version = 1")
    second = sharding.store_map(sharding.grow(first, SHARDS), path).where("version = 2")
    placed = sharding.place_counts(counts, first).join(F.broadcast(second.select("vslot", "piece", F.col("shard").alias("next_shard"))), ["vslot", "piece"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"), "vslot", "piece", "next_shard")


# --- op6 -------------------------------------------------------------------

MARGINALS = {
    "_source": mixing.Marginal(power=0.5),
    "_lang": mixing.Marginal({"en": 0.45, "de": 0.2, "fr": 0.2, "es": 0.1, "other": 0.05}),
    "_topic": mixing.Marginal({"legal": 0.05, "tabular": 0.1, "symbols": 0.05, "prose": 0.8}),
}
TOPICS = (("legal", r"(?i)licensed under|released under|copyright"), ("tabular", r"\|"), ("symbols", r"[#$%&*]{3}"))
KEEP = 0.5
SWEEPS = 25
SALT = "mix-1"


def op6_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its cell's raked weight, its sampling probability and the draw."""
    docs = mixing.labelled(table(spark, sf_dir, "documents"), "text", TOPICS, "prose")
    # texts are read once; what is left of them is small
    features = written(docs.select("doc_id", *mixing.LABELS, mixing.n_tokens(F.col("text")).alias("n_tokens")), "features")
    mixed = mixing.draw(features, mixing.chances(features, MARGINALS, KEEP, SWEEPS), "doc_id", SALT)
    return mixed.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), "n_tokens", F.round("w", 6).alias("weight"), F.round("p", 6).alias("probability"), "kept", F.round("residual", 6).alias("residual")
    )


# --- op7 -------------------------------------------------------------------


def op7_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its direct links, its component and whether it stays."""
    return embeddings.near_duplicates(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


# --- op8 -------------------------------------------------------------------


def op8_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its licences and the licence sentences behind them."""
    return licenses.scan(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


# --- op9 -------------------------------------------------------------------


def op9_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its fingerprint and the smallest doc_id of its group."""
    groups = simhash.near_duplicate_groups(table(spark, sf_dir, "documents"), "doc_id", "text")
    return groups.select(F.col("id").alias("doc_id"), simhash.hex_of(F.col("fp")).alias("fingerprint"), "component_id")


# --- op10 ------------------------------------------------------------------


def op10_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its log10 probability under the model of the other nine folds."""
    docs = table(spark, sf_dir, "documents")
    held_out = language.fold_of("doc_id", 10) == 0
    model = ngrams.fit(docs.where(~held_out), "text")
    scored = ngrams.score(docs, "doc_id", "text", model)
    return scored.select(
        F.col("id").alias("doc_id"),
        F.coalesce(language.fold_of("id", 10) == 0, F.lit(False)).alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        "base_score",
        "score",
        ngrams.perplexity(F.col("score"), F.col("n_tokens")).alias("perplexity"),
    )


# --- op11 ------------------------------------------------------------------


def op11_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with digests of its token ids and of the bytes that they decode to."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    tokens = bpe.encode(table(spark, sf_dir, "documents"), "doc_id", "text", path, public_tokenizers.PATTERN)
    return bpe.decode(tokens, path).select(
        F.col("id").alias("doc_id"), F.size("ids").cast("long").alias("n_tokens"), F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


# --- op12 ------------------------------------------------------------------


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hard negatives of each positive of each hundredth vector; labels of each seventh are shifted by one."""
    n = F.col("vec_id")
    shifted = table(spark, sf_dir, "embeddings").withColumn("label", F.when(n % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return negatives.hard_negatives(shifted, "vec_id", "embedding", "label", n % 100 == 0)


# --- op13 ------------------------------------------------------------------


def op13_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's first eight whitened components."""
    return whitening.whitened_components(table(spark, sf_dir, "embeddings"), "vec_id", "embedding").withColumnRenamed("id", "vec_id")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_revisits": op1_warc_revisits,
        "op2_string_kernel_language": op2_string_kernel_language,
        "op3_winnowing_decontamination": op3_winnowing_decontamination,
        "op4_chat_formatting": op4_chat_formatting,
        "op5_virtual_slots": op5_virtual_slots,
        "op6_source_mixing": op6_source_mixing,
        "op7_embedding_near_dedup": op7_embedding_near_dedup,
        "op8_licence_scan": op8_licence_scan,
        "op9_simhash_near_dedup": op9_simhash_near_dedup,
        "op10_kneser_ney_scores": op10_kneser_ney_scores,
        "op11_byte_bpe": op11_byte_bpe,
        "op12_hard_negatives": op12_hard_negatives,
        "op13_whitening": op13_whitening,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc_revisits": sql.op1(CRAWL_START, RECRAWL_AFTER),
        "op3_winnowing_decontamination": sql.op3(),
        "op4_chat_formatting": sql.op4(),
        "op5_virtual_slots": sql.op5(SHARDS, sharding.SLOTS, sharding.PARTS),
        "op6_source_mixing": sql.op6(MARGINALS, KEEP, TOPICS, "prose", SWEEPS, SALT),
        "op8_licence_scan": sql.op8(),
        "op12_hard_negatives": sql.op12(),
    }
