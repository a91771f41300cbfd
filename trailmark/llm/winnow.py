"""Benchmark decontamination by winnowing.

Every window of ``window`` words (an item of fewer words is one window) is
represented by the least hash of the k-grams in it, so document and benchmark
windows of equal words always select the same fingerprint: no shared span of
``window`` words is missed.  Fingerprints of documents are joined with the
benchmark's; only documents with a hit are looked at again, where each hit is
extended to its whole window and compared word by word, and the windows that
hold are merged into hit words.

Everything is keyed by the text's digest.  The digests of texts with a hit are few in a clean corpus, so they go to the
texts by broadcast and no text moves; where they are more than ``BROADCAST_BYTES``, a bitmap of
fixed size sorts out most other texts, and only what passes it is shuffled.

Windows with the same set of items are one class (told by count and two exclusive-or sums of item hashes), and
items are stored once a class, so a passage that all items share is neither listed nor carried per window.

Defined cases: null or empty texts have no words, no hits and are clean; benchmark
rows without words are ignored; repeated item ids count once and repeated documents are
judged one by one; null item ids never count as an item; empty tables give no rows (documents)
or no hits (benchmark).  The output has the named columns only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trailmark.llm.common import let, lower_ascii, written

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: What lies between words, in lower-cased texts and in others.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BETWEEN_ANY_CASE = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
WINDOW = 13
#: A table that holds no more than this is broadcast; a larger one is shuffled.  Results are the same.
BROADCAST_BYTES = 32 << 20
#: Bitmaps of ``_BITS`` bits each that tell texts with a hit from most others: 1 MB in all.
_BITS, _BITMAPS = 32_768, 256


def gram_size(window: int) -> int:
    """Words of a k-gram for a window: about half, so that half as many hashes compete in it."""
    return (window + 1) // 2


def _window_hash(hashes: Column, start: Column, window: int) -> Column:
    """Least k-gram hash of the window at ``start`` (from 0), from an array of k-gram hashes."""
    return F.array_min(F.slice(hashes, start + 1, window - gram_size(window) + 1))


def fingerprints(words: Column, window: int) -> Column:
    """For each window start, the least hash of its k-grams; empty if there are fewer words."""
    k = gram_size(window)

    def of(coded: Column) -> Column:
        grams = F.transform(
            F.when(F.size(coded) >= k, F.sequence(F.lit(0), F.size(coded) - k)).otherwise(F.expr("cast(array() as array<int>)")),
            lambda i: F.xxhash64(*[coded[i + j] for j in range(k)]),
        )
        return let(
            grams,
            lambda g: F.transform(
                F.when(F.size(coded) >= window, F.sequence(F.lit(0), F.size(coded) - window)).otherwise(F.expr("cast(array() as array<int>)")),
                lambda i: _window_hash(g, i, window),
            ),
        )

    return let(F.transform(words, lambda w: F.xxhash64(w)), of)


def words_in(text: Column) -> Column:
    """The words of the lower-cased text; cutting at what lies between them is several times faster than matching them."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), BETWEEN), "")


def count_words(text: Column) -> Column:
    return F.size(F.array_remove(F.split(F.coalesce(text, F.lit("")), BETWEEN_ANY_CASE), "")).cast("long")


def _text_at(words: Column, start: Column, window: int) -> Column:
    return F.array_join(F.slice(words, start + 1, window), " ")


def sized(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df``, a written table or a projection of one, as a broadcast if its rows hold ``most`` bytes at most."""
    bytes_of = {"string": F.octet_length, "array<struct<len:int,fp:bigint>>": lambda c: F.size(c) * 16, "array<string>": lambda c: F.octet_length(F.array_join(c, ",")) + 16 * F.size(c)}
    row = sum((F.coalesce(bytes_of[t](c), F.lit(0)) if t in bytes_of else F.lit(8) for c, t in df.dtypes), F.lit(32))
    return F.broadcast(df) if (df.agg(F.sum(row.cast("long"))).first()[0] or 0) <= most else df


def benchmark_windows(benchmark: DataFrame, id_col: str, text_col: str, window: int) -> tuple[DataFrame, DataFrame]:
    """Distinct windows ``len, fp, window, class``, and ``class, item``; ``len`` is the window's number of words."""
    words = benchmark.select(F.col(id_col).cast("string").alias("item"), words_in(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    parts = []
    for n in range(1, window + 1):
        of = words.where(F.size("words") == n if n < window else F.size("words") >= window)
        spots = F.explode(F.transform(fingerprints(F.col("words"), n), lambda h, i: F.struct(h.alias("fp"), _text_at(F.col("words"), i, n).alias("window"))))
        parts.append(of.select("item", spots.alias("s")).select(F.lit(n).alias("len"), "s.fp", "s.window", "item"))
    every = parts[0]
    for part in parts[1:]:
        every = every.unionAll(part)
    pairs = written(every.distinct(), "item-windows")
    # a null item is of no class's set
    held = pairs.groupBy("len", "fp", "window").agg(F.count("item").alias("n"), *[F.bit_xor(F.when(F.col("item").isNotNull(), F.xxhash64("item", F.lit(salt)))).alias(f"x{salt}") for salt in (1, 2)])
    windows = written(held.select("len", "fp", "window", F.concat_ws(":", "n", F.coalesce("x1", F.lit(0)), F.coalesce("x2", F.lit(0))).alias("class")), "windows")
    first = windows.groupBy("class").agg(F.min(F.struct("len", "fp", "window")).alias("w")).select("class", "w.*")
    items = pairs.where("item is not null").join(first, ["len", "fp", "window"]).select("class", "item")
    return windows, written(items, "class-items")


def _bitmap_key() -> Column:
    return F.pmod(F.xxhash64("digest"), F.lit(_BITS * _BITMAPS))


def possibly(texts: DataFrame, digests: DataFrame) -> DataFrame:
    """The texts whose digest is one of ``digests``, and a few others, by bitmaps of fixed size."""
    key = _bitmap_key()
    maps = digests.select(F.floor(key / _BITS).cast("int").alias("map"), (key % _BITS).alias("at")).groupBy("map").agg(F.bitmap_construct_agg("at").alias("bits"))
    at = key % _BITS
    octet = F.conv(F.hex(F.substring("bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("long")
    marked = texts.withColumn("map", F.floor(key / _BITS).cast("int")).join(F.broadcast(maps), "map")
    return marked.where(F.getbit(octet, (at % 8).cast("int")) == 1).drop("map", "bits")


def hit_windows(texts: DataFrame, windows: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Distinct rows ``digest, start, len, class`` of every benchmark window in the texts.

    ``texts`` has ``digest, text`` and may repeat; ``windows`` is ``benchmark_windows``'s written output.
    """
    lengths = sorted(r["len"] for r in windows.select("len").distinct().collect())  # 13 at most
    none = "array<struct<len:int,fp:bigint>>"
    words = words_in(F.col("text"))

    def marks(tokens: Column) -> Column:
        def of(n: int) -> Column:
            return F.transform(F.array_distinct(fingerprints(tokens, n)), lambda h: F.struct(F.lit(n).alias("len"), h.alias("fp")))

        each = [of(n) for n in lengths]
        return F.concat(*each) if each else F.expr(f"cast(array() as {none})")

    prints = texts.select("digest", F.explode(let(words, marks)).alias("m")).select("digest", "m.len", "m.fp")
    known = sized(windows.select("len", "fp").distinct(), most)
    struck = prints.join(known, ["len", "fp"], "left_semi").distinct().groupBy("digest").agg(F.collect_set(F.struct("len", "fp")).alias("struck"))
    struck = written(struck, "struck")
    # the few texts with a hit meet their words again, copies one by one; their equal rows are combined before the next shuffle
    few = sized(struck, most)
    again = texts.join(few, "digest") if few is not struck else possibly(texts, struck).join(struck, "digest")

    def spots(tokens: Column) -> Column:
        def of(n: int) -> Column:
            def spot(h: Column, i: Column) -> Column:
                struck_by = F.array_contains(F.col("struck"), F.struct(F.lit(n).alias("len"), h.alias("fp")))
                return F.when(struck_by, F.struct(F.lit(n).alias("len"), h.alias("fp"), i.alias("start"), _text_at(tokens, i, n).alias("window")))

            return F.filter(F.transform(fingerprints(tokens, n), spot), lambda s: s.isNotNull())

        each = [of(n) for n in lengths]
        return F.concat(*each) if each else F.expr("cast(array() as array<struct<len:int,fp:bigint,start:int,window:string>>)")

    found = again.select("digest", F.explode(let(words, spots)).alias("s")).select("digest", "s.*")
    return found.join(sized(windows, most), ["len", "fp", "window"]).select("digest", "start", "len", "class").distinct()


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, most: int = BROADCAST_BYTES) -> DataFrame:
    """One row a document: ``id, n_words, n_hit, items`` (sorted list) ``, contaminated``.

    Contaminated: some word is hit and the hit words are a twentieth of all words at least.
    """
    windows, class_items = benchmark_windows(benchmark, item_col, item_text_col, window)
    texts = docs.select(F.sha2(text_col, 256).alias("digest"), F.col(text_col).alias("text"))
    hits = written(hit_windows(texts.where("text is not null"), windows, most), "hits")
    spans = F.array_sort(F.collect_list(F.struct(F.col("start").alias("start"), (F.col("start") + F.col("len")).alias("end"))))

    def cover(acc: Column, x: Column) -> Column:
        return F.struct(
            (acc.n + F.greatest(F.lit(0), x.end - F.greatest(x.start, acc.to))).alias("n"), F.greatest(acc.to, x.end).alias("to")
        )

    n_hit = F.aggregate("spans", F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), cover, lambda acc: acc.n)
    covered = hits.groupBy("digest").agg(spans.alias("spans")).select("digest", n_hit.cast("long").alias("n_hit"))
    named = hits.select("digest", "class").distinct().join(class_items, "class").select("digest", "item").distinct()
    listed = named.groupBy("digest").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none = F.expr("cast(array() as array<string>)")
    summed = written(covered.join(listed, "digest", "left").select("digest", "n_hit", F.coalesce("items", none).alias("items")), "summed")
    counted = docs.select(
        F.col(id_col).alias("id"),
        F.sha2(text_col, 256).alias("digest"),
        count_words(F.col(text_col)).alias("n_words"),
    )
    joined = counted.join(sized(summed, most), "digest", "left")
    hit = F.coalesce("n_hit", F.lit(0).cast("long"))
    return joined.select(
        "id",
        "n_words",
        hit.alias("n_hit"),
        F.coalesce("items", none).alias("items"),
        ((hit > 0) & (hit * 20 >= F.col("n_words"))).alias("contaminated"),
    )
