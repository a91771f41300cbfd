"""The ten operators and the pipeline: SQL, brute force, round trips, held-out accuracy and edge cases."""

import math
import textwrap
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

import corpus_pipeline
from trailmark.llm import chat, embeddings, language, licenses, mixing, ngrams, queries, sharding, simhash, warc, winnow
from trailmark.llm.common import table
from trailmark.llm.components import connected_components

SMALL = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label int, id long"
#: Nulls in every column, empty and repeated rows, ties, and columns that clash with the operators' own.
ODD = [(1, "One two.", "en", "a", 8, 1, 9), (1, "One two.", "en", "a", 8, 1, 9), (2, None, None, None, None, None, None), (None, "", "de", "b", 0, 2, 1), (3, "   ", "en", "a", 3, None, 2), (4, "Ä ö ü!", None, "a", 6, 3, 3), (5, "word " * 30_000, "en", "b", 150_000, 3, 3)]


def odd(spark):
    return spark.createDataFrame(ODD, DOCS)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_same_as_sql(name, same_as_sql):
    same_as_sql(queries.queries()[name], queries.oracle_sql()[name])


def groups(n, links):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, j in links:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def test_simhash_same_as_brute_force(spark):
    rows = table(spark, SMALL, "documents").orderBy("doc_id").collect()

    def print_of(text):
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
        words = [w for w in words if w]
        shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
        hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
        return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))

    prints = [print_of(r["text"]) for r in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4]
    want = {rows[i]["doc_id"]: (f"{prints[i]:016x}", rows[g]["doc_id"]) for i, g in enumerate(groups(len(rows), links))}
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op9_simhash_near_dedup(spark, SMALL).collect()}
    assert got == want


def links_of(rows, threshold=0.95):
    """Per row ``id, n_links, component_id, kept`` by comparing all pairs."""
    unit = [None if v is None or not len(v) or any(x is None or not np.isfinite(x) for x in v) or not any(v) else np.array(v, float) / np.linalg.norm(v) for _, v in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if unit[i] is not None and unit[j] is not None and len(unit[i]) == len(unit[j]) and unit[i] @ unit[j] >= threshold]
    n, root = Counter(k for pair in links for k in pair), groups(len(rows), links)
    # an id is a name and no link: components are of rows
    name = {g: min((rows[i][0] for i in range(len(rows)) if root[i] == g and rows[i][0] is not None), default=None) for g in set(root)}
    return sorted(((rows[i][0], n[i], name[root[i]], rows[i][0] == name[root[i]]) for i in range(len(rows))), key=str)


def embedding_rows():
    """Near copies, repeated and null ids, equal and scaled vectors, unlike lengths, and vectors that can't link."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16)).astype(np.float32).astype(float)
    near = (base + rng.normal(size=base.shape) * 0.12).astype(np.float32).astype(float)
    short = rng.normal(size=(6, 2)).astype(np.float32).astype(float)
    x = [*base, *near, *base[:5], *(base[:5] * 4), *short, *(short * 2)]
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(3, base[7].tolist()), (3, base[8].tolist()), (3, base[3].tolist()), (None, near[9].tolist()), (None, base[11].tolist()), (None, rng.normal(size=16).astype(np.float32).astype(float).tolist())]
    return rows + [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [None] * 16), (904, []), (900, None), (None, None)]


def test_fingerprint_links_same_for_every_number_of_blocks(spark):
    """Planted near fingerprints; all pairs against 5 to 9 blocks."""
    dice = np.random.default_rng(9)
    base = dice.integers(0, 2**63, 60, dtype=np.int64)
    near = [int(x) ^ sum(1 << int(k) for k in dice.choice(62, n, replace=False)) for x, n in zip(base, dice.integers(0, 7, 60), strict=True)]
    prints = sorted({*map(int, base), *near, 0, -1})
    want = groups(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if ((prints[i] ^ prints[j]) & (2**64 - 1)).bit_count() <= 4])
    for blocks in (5, 7, 9):
        links = simhash.fingerprint_links(spark.createDataFrame([(x,) for x in prints], "fp long"), 4, blocks).collect()
        place = {x: i for i, x in enumerate(prints)}
        assert groups(len(prints), [(place[r["u"]], place[r["v"]]) for r in links]) == want


def test_components_same_as_brute_force(spark):
    """Paths, stars, loops, repeated and null edges, and none at all."""
    edges = [(i, i + 1) for i in range(1, 30)] + [(100, i) for i in range(101, 130)] + [(50, 50), (7, 8), (None, 3), (200, 201), (201, 202), (202, 200), (128, 60)]
    got = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    nodes = sorted({x for e in edges for x in e if x and e[0] and e[0] != e[1]})
    place = {x: i for i, x in enumerate(nodes)}
    want = groups(len(nodes), [(place[u], place[v]) for u, v in edges if u and u != v])
    assert got == {x: nodes[want[place[x]]] for x in nodes}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


@pytest.mark.parametrize(("kind", "rows_per_cell", "block_rows"), [("float", 8_192, 16_384), ("double", 12, 5), ("float", 4, 3), ("double", 9, 64)])
def test_embeddings_same_as_brute_force(spark, kind, rows_per_cell, block_rows):
    rows = embedding_rows()
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>").withColumn("v", F.lit(1)).withColumn("class", F.lit("x"))
    got = embeddings.near_duplicates(df, "vec_id", "embedding", rows_per_cell=rows_per_cell, block_rows=block_rows).collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == links_of(rows)


def test_embedding_query_same_as_brute_force(spark, tmp_path):
    """The query itself, on a table with planted links."""
    rows = embedding_rows()
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("label", F.lit(0)).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = queries.op7_embedding_near_dedup(spark, str(tmp_path)).collect()
    assert sorted(((r["vec_id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == links_of(rows)


@pytest.mark.parametrize("rows", [[(5, "v"), (5, "z"), (6, "w")], [(5, "v"), (5, "w")], [(None, "v"), (6, "w")]])
def test_links_are_of_rows_and_not_of_ids(spark, rows):
    of = {"v": [1.0, 0.0, 0.0], "w": [1.0, 0.1, 0.0], "z": [0.0, 0.0, 1.0]}
    rows = [(i, of[n]) for i, n in rows]
    got = embeddings.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding").collect()
    assert sorted(((r["id"], r["n_links"], r["component_id"], r["kept"]) for r in got), key=str) == links_of(rows)


def brute_scores(train, texts):
    """Interpolated modified Kneser-Ney from its definition, by dictionaries."""
    words = lambda t: (t or "").encode().lower().split() + ["</s>"]  # only ASCII is lowered and split at
    pair, one = Counter(), Counter()
    for t in train:
        w = words(t)
        one.update(w)
        pair.update(zip(["<s>", *w[:-1]], w, strict=True))
    left, after = Counter(w for _, w in pair), defaultdict(list)
    for (v, _), c in pair.items():
        after[v].append(c)
    counts = lambda xs: ngrams.discounts(*[sum(x == k for x in xs) for k in (1, 2, 3, 4)])
    d2, d1 = counts(pair.values()), counts([left[w] for w in one])
    cut = lambda c, d: max(c - d[min(c, 3) - 1], 0) if c else 0
    gap1 = sum(d1[min(c, 3) - 1] for c in left.values()) / len(pair)
    out = []
    for t in texts:
        w, total = words(t), 0
        for v, x in zip(["<s>", *w[:-1]], w, strict=True):
            p1 = cut(left[x], d1) / len(pair) + gap1 / (len(one) + 1)
            n = sum(after[v])
            total += math.log10(cut(pair[v, x], d2) / n + sum(d2[min(c, 3) - 1] for c in after[v]) / n * p1 if n else p1)
        out.append(total)
    return out


def test_ngrams_same_as_brute_force(spark):
    train = ["a b a c", "a b b c a", None, "b c a b", "c"] * 2 + ["x y z a b", "a b"]
    texts = [*train, "a unknown b", "", "c c c"]
    df = spark.createDataFrame(list(enumerate(train)), "doc_id long, text string")
    model = ngrams.fit(df, "text")
    got = ngrams.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", model).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(brute_scores(train, texts), abs=1e-9)
    assert model.tokens == sum(len((t or "").split()) + 1 for t in train)


def test_scores_of_the_query_same_as_brute_force(spark):
    """Every column of op10 on the whole small table, among them a document of over 65,000 tokens that one type of counts can't hold."""
    docs = table(spark, SMALL, "documents")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    held = lambda i: zlib.crc32(str(i).encode()) % 10 == 0
    words = lambda t: "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").replace("\x0c", " ").replace("\r", " ").split(" ")
    tokens = {i: [w for w in words(t) if w] + [None] for i, t in rows}
    count = Counter(w for i, t in tokens.items() if not held(i) for w in t)
    total, kinds = sum(count.values()), len(count)
    got = {r["doc_id"]: r for r in queries.op10_kneser_ney_scores(spark, SMALL).collect()}
    assert len(got) == len(rows)
    for i, t in tokens.items():
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held(i), len(t), sum(count[w] > 0 for w in t), total)
        assert r["base_score"] == pytest.approx(sum(math.log10((count[w] + 0.1) / (total + 0.1 * (kinds + 1))) for w in t), rel=1e-9)
    want = brute_scores([t for i, t in rows if not held(i)], [t for _, t in rows])
    assert [got[i]["score"] for i, _ in rows] == pytest.approx(want, rel=1e-9)


def test_counts_beyond_their_type_and_long_texts(spark):
    """Pairs seen over 255 times go to a side array; a text of several chunks is one text."""
    train = ["a b " * 400, "b a a"]
    texts = [*train, "a b c " * 500_000]
    model = ngrams.fit(spark.createDataFrame([(i, t) for i, t in enumerate(train)], "doc_id long, text string"), "text")
    got = ngrams.score(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text", model).orderBy("id").collect()
    assert [r["score"] for r in got] == pytest.approx(brute_scores(train, texts), rel=1e-9)
    assert got[2]["n_tokens"] == 1_500_001 and got[2]["n_known"] == 1_000_001


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    got = queries.op2_string_kernel_language(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang", "text"), "doc_id")
    held = got.where("held_out and lang is not null and length(text) > 40").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double"))).first()[0]
    assert held > 0.9


def test_language_same_as_brute_force(spark):
    """Kernel, Nyström features, ridge and labels of the query, from dictionaries of the same sample."""
    docs = table(spark, SMALL, "documents")
    fold = language.fold_of("doc_id", 5) != 0
    per_class, landmarks = 300, 32
    sample = [(r["label"], r["text"], r["place"]) for r in language.training_sample(docs, "doc_id", "text", "lang", fold, per_class).collect()]
    usable = {(r["lang"], r["doc_id"], r["text"]) for r in docs.where(fold).collect() if r["lang"] is not None and any(c.isalpha() for c in r["text"] or "")}
    assert len(sample) == sum(min(per_class, n) for n in Counter(lang for lang, _, _ in usable).values())

    def grams(text):
        t = text.lower()
        return {t[i : i + n] for n in (1, 2, 3) for i in range(len(t) - n + 1)}

    marks = [grams(t) for _, t, place in sample if place <= landmarks]

    def kernel(own):
        return [len(own & m) / math.sqrt(len(own) * len(m)) for m in marks]

    classes = sorted({label for label, _, _ in sample})
    values, vectors = np.linalg.eigh(np.array([kernel(m) for m in marks]))
    keep = values > 1e-8 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    x = np.array([kernel(grams(t)) for _, t, _ in sample]) @ root
    y = np.array([[label == c for c in classes] for label, _, _ in sample], float)
    beta = np.linalg.solve((x - x.mean(0)).T @ (x - x.mean(0)) + 1e-3 * len(x) * np.eye(x.shape[1]), (x - x.mean(0)).T @ (y - y.mean(0)))
    got = {r["doc_id"]: r for r in queries.op2_string_kernel_language(spark, SMALL).collect()}
    for r in docs.collect():
        if not any(c.isalpha() for c in r["text"] or ""):
            assert (got[r["doc_id"]]["lang_pred"], got[r["doc_id"]]["score"]) == ("und", 0.0)
            continue
        s = (np.array(kernel(grams(r["text"]))) @ root - x.mean(0)) @ beta + y.mean(0)
        assert got[r["doc_id"]]["score"] == pytest.approx(min(1.0, max(0.0, s.max())), abs=1e-4)
        assert got[r["doc_id"]]["lang_pred"] == classes[int(s.argmax())] or np.sort(s)[-1] - np.sort(s)[-2] < 1e-4
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)


def test_language_sample_is_bounded_where_ids_repeat(spark):
    """One id forty times, null labels and ids, rows that repeat."""
    rows = [(7, f"same id {i}", "en") for i in range(40)] + [(8, "twice", "en")] * 2 + [(9, "drei", "de"), (9, "drei", None), (None, "four", "en"), (10, "123", "en")]
    docs = spark.createDataFrame(rows, "id long, text string, lang string")
    got = language.training_sample(docs, "id", "text", "lang", F.lit(True), 5).collect()
    assert Counter(r["label"] for r in got) == {"en": 5, "de": 1} and sorted(r["place"] for r in got) == [1, 1, 2, 3, 4, 5]
    whole = language.training_sample(docs, "id", "text", "lang", F.lit(True), 300).collect()
    assert sorted(r["text"] for r in whole) == sorted({t for i, t, lang in rows if i and lang and t != "123"})
    clash = docs.withColumn("said", F.lit("kept")).withColumn("score", F.lit("lost"))
    said = language.predict(clash, "text", language.fit(docs, "id", "text", "lang", F.lit(True)))
    assert {r["said"] for r in said.collect()} == {"kept"} and said.count() == len(rows) and dict(said.dtypes)["score"] == "double"


def test_language_is_fitted_on_every_labelled_text(spark):
    """Far more texts than landmarks: sums and floor are those over all of them, in dictionaries."""
    dice = np.random.default_rng(8)
    rows = [(i, "".join(dice.choice(list("abcdefgh " if i % 2 else "defghijk "), 12)) + ("q" * (i % 5)), "ab"[i % 2]) for i in range(900)]
    docs = spark.createDataFrame(rows, "id long, text string, lang string").repartition(5)
    got = language.fit(docs, "id", "text", "lang", F.lit(True), landmarks=4)

    def grams(text):
        return {text[i : i + n] for n in (1, 2, 3) for i in range(len(text) - n + 1)}

    marks = [grams(r["text"]) for r in language.training_sample(docs, "id", "text", "lang", F.lit(True), 4).collect()]
    own = [grams(t) for _, t, _ in rows]
    k = np.array([[len(o & m) / math.sqrt(len(o) * len(m)) for m in marks] for o in own])
    values, vectors = np.linalg.eigh(np.array([[len(o & m) / math.sqrt(len(o) * len(m)) for m in marks] for o in marks]))
    x, y = k @ (vectors / np.sqrt(values)), np.array([[lang == c for c in "ab"] for _, _, lang in rows], float)
    middle = x - x.mean(0)
    beta = np.linalg.solve(middle.T @ middle + 1e-3 * len(x) * np.eye(x.shape[1]), middle.T @ (y - y.mean(0)))
    assert got.scores([t for _, t, _ in rows])[0] == pytest.approx(middle @ beta + y.mean(0), abs=1e-4)
    known = Counter(g for m in marks for g in m)
    likes = [(sum(known[g] > (o in marks) for g in o) + 4) / (len(o) + 4) for o in own]
    assert got.floor == pytest.approx(language.SLACK * np.quantile(likes, 0.01), abs=1e-12)


def test_slots_are_gapless_and_shards_even(spark):
    got = queries.op5_virtual_slots(spark, SMALL).toPandas()
    for _, one in got.groupby("shard"):
        assert sorted(one["slot"]) == list(range(len(one)))
    sums = got.groupby("shard")["size"].sum()
    assert len(sums) == 8 and sums.max() - sums.min() <= got["size"].max()
    text = {r["doc_id"]: r["text"] for r in table(spark, SMALL, "documents").collect()}
    assert all(text[r.doc_id] is None or zlib.crc32(text[r.doc_id].encode()) == r.text_crc32 for r in got.itertuples())


def dealt(records, key, shards):
    return sharding.deal(sharding.slot_pieces(sharding.key_counts(records, key), shards), shards)


@pytest.mark.parametrize("case", ["one row often", "nothing but nulls", "one long text"])
@pytest.mark.parametrize("at_once", [7, 1 << 16])
def test_bytes_stay_even_where_rows_repeat(spark, monkeypatch, case, at_once):
    """No two shards differ by more than the largest text; both ways of placing agree with plain counting."""
    monkeypatch.setattr(sharding, "_AT_ONCE", at_once)
    docs = {"one row often": [(1, "abcdefgh")] * 20_000 + [(i, "x" * (i % 30)) for i in range(2, 2_002)], "nothing but nulls": [(None, None)] * 20_000, "one long text": [(1, "y" * 5_000)] * 40 + [(2, None)] * 9}[case]
    key = ["doc_id", "text_crc32", "size"]
    records = sharding.sized(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text").select(*key, "vslot")
    counts = sharding.key_counts(records, key)
    slot_map = sharding.store_map(sharding.deal(sharding.slot_pieces(counts, 8), 8))
    for placed in (sharding.place_counts(counts, slot_map), sharding.place(records, slot_map, key)):
        rows = placed.select(*key, "shard", "slot").collect()
        assert Counter((r["doc_id"], r["size"]) for r in rows) == Counter((i, len(t or "") + 1) for i, t in docs)
        loads, places = Counter({s: 0 for s in range(8)}), defaultdict(list)
        for r in rows:
            loads[r["shard"]] += r["size"]
            places[r["shard"]].append(r["slot"])
        assert max(loads.values()) - min(loads.values()) <= max(r["size"] for r in rows)
        assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_growing_moves_slots_into_the_new_shard_only(spark, tmp_path):
    """Version 2 is stored beside version 1 and read back; records of slots that stay don't move."""
    records = sharding.sized(table(spark, SMALL, "documents"), "doc_id", "text")
    path = f"{tmp_path}/map"
    key = ["doc_id", "text_crc32", "size"]
    first = sharding.store_map(dealt(records, key, 4), path)
    both = sharding.store_map(sharding.grow(first, 4), path)
    assert {(r["version"], r["n"]) for r in both.groupBy("version").agg(F.countDistinct("vslot").alias("n")).collect()} == {(1, 4096), (2, 4096)}
    old, new = (sharding.place(records, both.where(f"version = {v}"), key).toPandas() for v in (1, 2))
    met = old.merge(new, on=["doc_id", "text_crc32"], suffixes=("", "_new"))
    assert (met["shard_new"][met["shard"] != met["shard_new"]] == 4).all() and (met["shard"] != met["shard_new"]).any()
    for _, one in new.groupby("shard"):
        assert sorted(one["slot"]) == list(range(len(one)))
    loads = new.groupby("shard")["size"].sum()
    assert len(loads) == 5 and loads[4] >= 0.1 * loads.sum()


def test_sharding_of_empty_and_odd_tables(spark):
    """Clashing columns stay; null ids and texts, repeated rows and an empty table."""
    clash = odd(spark).withColumns({"start": F.lit("s"), "inside": F.lit("i"), "shard": F.lit(99)})
    for docs, n in ((clash, len(ODD)), (clash.limit(0), 0)):
        records = sharding.sized(docs, "doc_id", "text")
        placed = sharding.place(records, dealt(records, ["doc_id", "size"], 3), ["doc_id", "size"])
        rows = placed.collect()
        assert len(rows) == n and all((r["start"], r["inside"]) == ("s", "i") and r["shard"] < 3 for r in rows)
        assert Counter((r["shard"], r["slot"]) for r in rows) == Counter((s, k) for s in range(3) for k in range(sum(r["shard"] == s for r in rows)))


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", "<|end|>\n<|turn|>\\[<"), (2, 0, "assistant", None), (None, None, None, None)]
    roles = ["user\nx", "[n", "\n", "\\n[", "<|end|>\n<|turn|>user", "[n\n[\\n"]
    rows += [(3, i, role, f"hi\n{role}") for i, role in enumerate(roles)]
    made = chat.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: [(t["role"], t["text"]) for t in r["b"]] for r in made.select("conv_id", chat.read_back(F.col("formatted")).alias("b")).collect()}
    assert back == {1: [("user", rows[0][3]), ("assistant", rows[1][3])], 2: [("assistant", "")], None: [("", "")], 3: [(role, f"hi\n{role}") for role in roles]}
    assert {r["conv_id"]: r["valid"] for r in made.collect()} == {1: True, 2: False, None: False, 3: False}
    clash = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "state": F.lit("s"), "segments": F.lit(2)})
    assert chat.digests(chat.format_chats(clash)).count() == 4


@pytest.mark.parametrize("most", [winnow.BROADCAST_BYTES, 0])
def test_decontamination_cases(spark, most):
    """With hit texts met by broadcast, and by bitmap and shuffle."""
    passage = " ".join(f"w{i}" for i in range(20))
    docs = [(1, f"pre {passage.upper()} post"), (2, None), (3, ""), (4, "short Item"), (5, "an other short item"), (6, passage[:20]), (6, passage), (6, passage)]
    items = [(1, passage), (1, passage), (2, "Short, item"), (3, None), (None, passage)]
    judged = winnow.decontaminate(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"), most=most)
    got = sorted((r["id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in judged.collect())
    assert got == sorted([(1, 22, 20, ["1"], True), (2, 0, 0, [], False), (3, 0, 0, [], False), (4, 2, 2, ["2"], True), (5, 4, 2, ["2"], True), (6, len(passage[:20].split()), 0, [], False), (6, 20, 20, ["1"], True), (6, 20, 20, ["1"], True)])


def test_decontamination_lists_every_item_of_a_shared_passage(spark):
    """A passage that all items share, with and without ANSI errors."""
    shared = " ".join(f"s{i}" for i in range(30))
    items = [(i, f"{shared} own{i} " + " ".join(f"x{i}y{k}" for k in range(14))) for i in range(50)]
    docs = spark.createDataFrame([(1, shared), (2, items[7][1]), (3, None), (4, " ".join(f"x9y{k}" for k in range(13)))], "doc_id long, text string")
    for ansi in ("true", "false"):
        spark.conf.set("spark.sql.ansi.enabled", ansi)
        try:
            got = {r["id"]: (r["n_words"], r["n_hit"], r["items"]) for r in winnow.decontaminate(docs, spark.createDataFrame(items, "item_id long, text string")).collect()}
        finally:
            spark.conf.unset("spark.sql.ansi.enabled")
        every = sorted(str(i) for i in range(50))
        assert got == {1: (30, 30, every), 2: (45, 45, every), 3: (0, 0, []), 4: (13, 13, ["9"])}


def test_revisit_takes_the_latest_earlier_response(spark):
    kind = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, payload_digest string"
    rows = [(1, "http://a.org/x/", 10, "response", '"t"', None, [("ETag", '"t"'), ("Server", "s")], "d1"), (2, "https://www.A.org/x#f", 200_000, "revisit", 'W/"t"', None, [("Server", "new"), ("Date", "now")], None), (3, "http://a.org/x", 10, "revisit", '"t"', None, None, None), (4, None, None, "revisit", None, None, None, None)]
    got = {r["record_id"]: r for r in warc.resolve_revisits(spark.createDataFrame(rows, kind)).collect()}
    assert [got[i]["outcome"] for i in (2, 3, 4)] == ["resolved", "no_earlier_response", "no_earlier_response"]
    assert [(h["name"], h["value"]) for h in got[2]["headers"]] == [("ETag", '"t"'), ("Server", "s"), ("Date", "now")]


def test_merged_headers_keep_the_stored_order(spark):
    """Fields of one name, names in other cases, null headers and null names."""
    kind = "i int, stored array<struct<name:string,value:string>>, fresh array<struct<name:string,value:string>>"
    cases = [
        ([("Set-Cookie", "z=1"), ("Date", "d1"), ("Set-Cookie", "a=1")], [("date", "d2")], [("Set-Cookie", "z=1"), ("date", "d2"), ("Set-Cookie", "a=1")]),
        ([("Vary", "a"), ("X", "1"), ("vary", "b"), ("X", "0")], [("Vary", "c"), ("X", "9"), ("Vary", "d"), ("ETag", "t")], [("Vary", "c"), ("Vary", "d"), ("X", "1"), ("X", "0"), ("ETag", "t")]),
        (None, [("Date", "d"), ("Server", "s")], [("Date", "d")]),
        ([(None, "x"), ("B", None)], None, [(None, "x"), ("B", None)]),
        (None, None, []),
    ]
    df = spark.createDataFrame([(i, a, b) for i, (a, b, _) in enumerate(cases)], kind)
    got = df.select("i", warc.merged_headers(F.col("stored"), F.col("fresh")).alias("h")).orderBy("i").collect()
    assert [[(x["name"], x["value"]) for x in r["h"]] for r in got] == [c for _, _, c in cases]


def test_revisits_of_ties_repeats_and_odd_records(spark):
    """Brute force over all pairs, with ties in time, repeated rows, null keys, clashing columns and buckets of any size."""
    dice = np.random.default_rng(4)
    kind = "record_id long, url string, ts long, kind string, etag string, last_modified string, headers array<struct<name:string,value:string>>, payload_digest string, bucket string, ref int"
    rows = []
    for i in range(120):
        response = dice.random() < 0.5
        tag, date = (None if dice.random() < 0.3 else f'"{dice.integers(2)}"'), (None if dice.random() < 0.3 else f"d{dice.integers(2)}")
        rows.append((i, [None, "http://a.org", "https://www.A.org/?utm_x=1", "b.org/y"][dice.integers(4)], None if dice.random() < 0.05 else int(dice.integers(40)) * 1_000, "response" if response else "revisit", tag, date, None, f"p{i}" if response else None, "x", 1))
    rows += rows[:10]
    canon = {None: None, "http://a.org": "a", "https://www.A.org/?utm_x=1": "a", "b.org/y": "b"}

    def outcome(r):
        before = [x for x in rows if x[3] == "response" and r[2] is not None and canon[r[1]] and canon[x[1]] == canon[r[1]] and x[2] is not None and x[2] < r[2]]
        if not before:
            return "no_earlier_response", None
        ref = max(before, key=lambda x: (x[2], x[0]))
        if r[4] is None and r[5] is None:
            return "unverified", ref[0]
        same = r[4] == ref[4] if r[4] is not None else r[5] == ref[5]
        return ("resolved" if same else "validator_mismatch"), ref[0]

    want = Counter((r[0], *outcome(r)) for r in rows if r[3] == "revisit")
    for seconds in (1, 7_000, 10**9):
        got = warc.resolve_revisits(spark.createDataFrame(rows, kind), seconds).collect()
        assert Counter((r["record_id"], r["outcome"], r["ref_id"]) for r in got) == want


def test_licence_rules(spark):
    texts = ["Licensed under the MIT License. Other.", "nothing here", None, "All rights reserved.", "Some unknown license text"]
    got = [r["licences"] for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), "doc_id", "text").orderBy("id").collect()]
    assert got == ["MIT", "NONE", "NONE", "Proprietary", "UNKNOWN"]


def test_odd_rows_keep_their_number(spark):
    docs = odd(spark)
    n = len(ODD)
    fold = language.fold_of("doc_id", 5) != 99
    model = language.fit(docs, "doc_id", "text", "lang", fold)
    assert language.predict(docs, "text", model).where("text is null or trim(text) = ''").select("lang_pred").distinct().collect()[0][0] == "und"
    assert language.predict(docs, "text", model).count() == n
    assert simhash.near_duplicate_groups(docs, "doc_id", "text").count() == n
    assert licenses.scan(docs, "doc_id", "text").count() == n
    assert winnow.decontaminate(docs, spark.createDataFrame([(1, "one two")], "item_id long, text string")).where("contaminated").count() == 2
    mixed = mixing.mix(docs, "doc_id", "text", queries.MARGINALS, 0.5, queries.TOPICS)
    assert mixed.count() == n and mixed.where("p is null").count() == 0
    records = sharding.sized(docs, "doc_id", "text")
    placed = sharding.place(records, dealt(records, ["doc_id", "size"], 3), ["doc_id", "size"])
    assert placed.count() == n
    assert ngrams.score(docs, "doc_id", "text", ngrams.fit(docs, "text")).count() == n


def test_empty_tables(spark):
    none = odd(spark).limit(0)
    model = language.fit(none, "doc_id", "text", "lang", F.lit(True))
    assert model is None and language.predict(none, "text", model).count() == 0
    assert simhash.near_duplicate_groups(none, "doc_id", "text").count() == 0
    assert licenses.scan(none, "doc_id", "text").count() == 0
    assert winnow.decontaminate(none, none.select(F.col("id").alias("item_id"), "text")).count() == 0
    assert mixing.mix(none, "doc_id", "text", queries.MARGINALS, 0.5, queries.TOPICS).count() == 0
    assert ngrams.score(none, "doc_id", "text", ngrams.fit(none, "text")).count() == 0
    assert embeddings.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<double>"), "vec_id", "embedding").count() == 0
    assert chat.format_chats(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert warc.resolve_revisits(queries.crawl_records(table(spark, SMALL, "pages").limit(0))).count() == 0


def test_pipeline_stages_take_effect(spark):
    """Each stage on its own input, against the operator's decisions or brute force."""
    docs = table(spark, SMALL, "documents").withColumn("lang", F.when(F.col("doc_id") % 7 != 0, F.col("lang"))).cache()
    stages = dict(corpus_pipeline.STAGES)
    known = stages["language_id"](spark, docs, SMALL).cache()
    # clean documents stay; labels that lack are the predicted ones; junk goes (see the test below)
    assert known.columns == docs.columns and known.count() == docs.where(F.col("text").rlike(r"\p{L}")).count()
    assert docs.where("lang is null").count() > 0 and known.where("lang is null").count() == 0
    said = {r["doc_id"]: r["lang_pred"] for r in language.predict(docs, "text", language.fit(docs, "doc_id", "text", "lang", language.fold_of("doc_id", 5) != 0)).collect()}
    label = {r["doc_id"]: r["lang"] for r in docs.collect()}
    assert all(r["lang"] == (label[r["doc_id"]] or said[r["doc_id"]]) for r in known.collect())
    kept = stages["simhash_near_dedup"](spark, known, SMALL).cache()
    found = simhash.near_duplicate_groups(known, "doc_id", "text")
    assert {r["doc_id"] for r in kept.collect()} == {r["component_id"] for r in found.collect()}
    clean = stages["decontamination"](spark, kept, SMALL).cache()
    bad = {r["id"] for r in winnow.decontaminate(kept, table(spark, SMALL, "benchmark")).where("contaminated").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in kept.collect()} - bad
    mixed = stages["source_mixing"](spark, clean, SMALL).cache()
    assert 0 < mixed.count() < clean.count()
    out = stages["sharding"](spark, mixed, SMALL).toPandas()
    assert sorted(out["doc_id"]) == sorted(r["doc_id"] for r in mixed.collect())
    assert all(sorted(x["slot"]) == list(range(len(x))) for _, x in out.groupby("shard"))


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_pipeline_stages_on_odd_and_empty_tables(spark, name):
    """Nulls in every column, repeated rows, ties, an empty table, and columns that clash with the stages' own."""
    stage = dict(corpus_pipeline.STAGES)[name]
    clash = odd(spark).drop("label", "id").withColumns({c: F.lit("x") for c in ("_key", "_digest", "lang_pred", "likeness", "vslot", "p", "kept", "id")})
    got = stage(spark, clash, SMALL)
    rows = got.collect()
    ids = Counter(r["doc_id"] for r in rows)
    assert got.columns[:5] == corpus_pipeline.COLUMNS and not set(ids) - {1, 2, 3, 4, 5, None}
    if name == "language_id":
        assert not {2, 3} & set(ids) and all(r["text"] for r in rows)
    if name == "simhash_near_dedup":  # null, empty and blank texts have one fingerprint
        assert ids == Counter([1, 2, 4, 5])
    if name == "decontamination":
        assert ids == Counter(r[0] for r in ODD)
    if name == "sharding":
        assert ids == Counter(r[0] for r in ODD)
    none = stage(spark, clash.limit(0), SMALL)
    assert none.count() == 0 and none.columns == got.columns


MIT = ["MIT License", "Copyright (c) 2020 A. Person", 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:', "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.", 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.']
APACHE = ["Copyright 2020 A. Person", 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at', "http://www.apache.org/licenses/LICENSE-2.0", 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.']
BSD2 = ["Copyright (c) 2020, A. Person", "All rights reserved.", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES HOWEVER CAUSED.']
BSD3 = [*BSD2[:5], "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD2[5]]
BSD4 = [*BSD2[:5], "3. All advertising materials mentioning features or use of this software must display the following acknowledgement: This product includes software developed by A. Person.", "4. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", BSD2[5]]
HOPE = ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.", "You should have received a copy of the GNU General Public License along with this program. If not, see <https://www.gnu.org/licenses/>."]
GPL3PLUS = ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", *HOPE]
GPL2PLUS = [GPL3PLUS[0].replace("software:", "software;").replace("Foundation, either version 3", "Foundation; either version 2"), *HOPE]
GPL2ONLY = ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.", *HOPE]
LESSER = [x.replace("GNU General", "GNU Lesser General") for x in GPL3PLUS]
MPL = ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."]
GAPPED = [*MIT[:3], MIT[3] + " Some further permission that nobody knows.", MIT[4]]
FULL = {"MIT": [MIT, GAPPED], "Apache-2.0": [APACHE], "BSD-2-Clause": [BSD2], "BSD-3-Clause": [BSD3], "BSD-4-Clause": [BSD4], "GPL-3.0-or-later": [GPL3PLUS], "GPL-2.0-or-later": [GPL2PLUS], "GPL-2.0": [GPL2ONLY], "LGPL-3.0-or-later": [LESSER], "MPL-2.0": [MPL]}


def laid_out(paragraphs):
    """A text in the ways it stands in files: one line, a line a paragraph, and wrapped with several comment marks."""
    yield " ".join(x if x.endswith((".", ":")) else f"{x}\n" for x in paragraphs)
    yield "\n".join(paragraphs)
    for width in (50, 66, 78):
        lines = "\n\n".join(textwrap.fill(p, width) for p in paragraphs).split("\n")
        for head, mark, foot in (("", "", ""), ("/*\n", " * ", "\n */"), ("", "# ", ""), ("", "// ", ""), ("<!--\n", "", "\n-->"), ("", ";; ", ""), ("#!/bin/sh\n", "#  ", "\nset -e"), ("tool.c does a thing\r\n", "-- ", "\r\nint main")):
            yield head + "\n".join((mark + x).rstrip() for x in lines) + foot
        yield "\r\n".join(lines)


def test_standard_licence_texts(spark):
    rows = [(name, text) for name, texts in FULL.items() for t in texts for text in laid_out(t)]
    got = licenses.scan(spark.createDataFrame(list(enumerate(t for _, t in rows)), "doc_id long, text string"), "doc_id", "text").orderBy("id").collect()
    wrong = [(name, r["licences"], r["sentence_ids"], text) for (name, text), r in zip(rows, got, strict=True) if r["licences"] != name]
    assert not wrong, (len(wrong), len(rows), wrong[:3])


def test_pipeline_drops_unlearned_languages_and_letter_junk(spark):
    docs = table(spark, SMALL, "documents")
    dice = np.random.default_rng(5)
    strange = [
        "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью.",
        "Привет, мир",
        "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
        "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
        "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem.",
        *["".join(dice.choice(list("abcdefghijklmnopqrstuvwxyz   "), n)) for n in (60, 600, 6000)],
        "qxzkj vwqzx jkxqz zzqxj kqjxv " * 20,
    ]
    rows = spark.createDataFrame([(10_000_000 + i, t, None, "a", len(t)) for i, t in enumerate(strange)], docs.schema)
    kept = corpus_pipeline.identify_language(spark, docs.unionByName(rows), SMALL).select("doc_id")
    clean = docs.where(F.col("text").rlike(r"\p{L}")).select("doc_id")
    assert sorted(r[0] for r in kept.collect()) == sorted(r[0] for r in clean.collect())
    # with a single label the one output is always 1
    kept = corpus_pipeline.identify_language(spark, docs.where("lang = 'en'").unionByName(rows), SMALL)
    assert kept.where("doc_id >= 10000000").count() == 0 and kept.count() > 0


def test_a_label_named_other_shares_the_target_of_the_rest(spark):
    rows = [(i, "one two three", lang, "a", 13) for i, lang in enumerate(["en"] * 6 + ["other"] * 3 + ["xx"])]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    mixed = mixing.mix(docs, "doc_id", "text", {"_lang": mixing.Marginal({"en": 0.6, "other": 0.4})}, 0.5, queries.TOPICS)
    got = {r["lang"]: (round(r["w"], 9), round(r["p"], 9)) for r in mixed.collect()}
    assert got == {"en": (0.6, 0.5), "other": (0.3, 0.5), "xx": (0.1, 0.5)}


def raked(spark, rows, marginals, **kw):
    cells = spark.createDataFrame(rows, "p string, q string, n double")
    return {(r["p"], r["q"]): (r["w"], r["residual"]) for r in mixing.rake(cells, marginals, **kw).collect()}


@pytest.mark.parametrize("one_task", [mixing.ONE_TASK_CELLS, 0])
def test_raking_meets_its_marginals(spark, one_task):
    """As one array and as a loop over tables; against plain loops."""
    dice = np.random.default_rng(2)
    n = {(p, q): float(dice.integers(1, 100)) for p in "abc" for q in "xyzu"} | {("d", "x"): 0.0}
    shares = {"p": {"a": 0.5, "b": 0.2, "c": 0.3}, "q": {"x": 0.4, "y": 0.1, "z": 0.2, "other": 0.3}}
    got = raked(spark, [(*k, v) for k, v in n.items()], {k: mixing.Marginal(v) for k, v in shares.items()}, one_task=one_task)
    w = {k: v for k, v in n.items() if v}
    for _ in range(40):
        for at, label in enumerate("pq"):
            for c in {k[at] for k in w}:
                own = [k for k in w if k[at] == c]
                total = sum(w[k] for k in own)
                for k in own:
                    w[k] *= shares[label].get(c, 0.3) / total
    assert {k: v for k, (v, _) in got.items()} == pytest.approx(w, abs=1e-7)
    assert max(r for _, r in got.values()) <= 1e-9
    for at, label in enumerate("pq"):
        for c in {k[at] for k in w}:
            assert sum(v for k, (v, _) in got.items() if k[at] == c) == pytest.approx(shares[label].get(c, 0.3), abs=1e-8)


@pytest.mark.parametrize("one_task", [mixing.ONE_TASK_CELLS, 0])
def test_targets_that_no_weights_meet_show_in_the_residual(spark, one_task):
    contrary = {"p": mixing.Marginal({"a": 0.9, "b": 0.1}), "q": mixing.Marginal({"x": 0.2, "y": 0.8})}
    got = raked(spark, [("a", "x", 5.0), ("b", "y", 5.0)], contrary, one_task=one_task, sweeps=4)
    assert got == {("a", "x"): (pytest.approx(0.2), pytest.approx(0.7)), ("b", "y"): (pytest.approx(0.8), pytest.approx(0.7))}


def test_calibration_keeps_the_budget(spark):
    """Against bisection, with cells that must be kept whole."""
    rows = [(i, float(n), w) for i, (n, w) in enumerate([(100, 0.5), (1000, 0.2), (10, 0.2), (5000, 0.1), (50, 0.0)])]
    cells = spark.createDataFrame(rows, "c long, n double, w double")
    for keep in (0.01, 0.3, 0.9, 1.0):
        got = {r["c"]: r["p"] for r in mixing.calibrate(cells, keep).collect()}
        low, high = 0.0, 1e9
        for _ in range(200):
            f = (low + high) / 2
            low, high = (f, high) if sum(n * min(1.0, f * w / n) for _, n, w in rows) < keep * 6160 else (low, f)
        assert got == pytest.approx({c: min(1.0, high * w / n) for c, n, w in rows}, abs=1e-6)


def test_mixing_odd_rows(spark):
    """Null labels and ids, texts without tokens, clashing columns and an empty table."""
    docs = odd(spark).withColumns({"p": F.lit("x"), "residual": F.lit("y"), "n_tokens": F.lit("z")})
    rows = mixing.mix(docs, "doc_id", "text", queries.MARGINALS, 1.0, queries.TOPICS).collect()
    assert len(rows) == len(ODD) and all(0 <= r["p"] <= 1 and isinstance(r["kept"], bool) and isinstance(r["n_tokens"], int) for r in rows)
    assert mixing.mix(docs.limit(0), "doc_id", "text", queries.MARGINALS, 1.0, queries.TOPICS).count() == 0
