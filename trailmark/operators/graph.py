"""Graphs over poses and descriptors: nodes ``seq_id, idx, ...`` and edges ``seq_id, src, dst, ...`` within a sequence.

Edge types: 0 temporal or verified loop closure, 1 similarity.  Edges carry ``cos, l2, post``: cosine, Euclidean
distance of the descriptors, and the posterior of a same place.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trailmark.operators import knn, stats
from trailmark.operators.stored import Block, Stored, met, mount
from trailmark.operators.tables import discard, written
from trailmark.operators.trajectory import dense, near_pairs, nearest_places


EDGE_ROWS = 1 << 16  # edges with the vectors of both ends that a task is to sort
FILE_EDGES = 1 << 17  # edges from which the vectors are read from files


def edge_parts(edges: DataFrame, share: int = 1) -> int | None:
    """Partitions for edges that meet columns of their ends, where the session's number of them would hold more than ``EDGE_ROWS`` each
    (``share`` times as many where the columns are few numbers); else None."""
    parts = -(-edges.count() // (share * EDGE_ROWS))
    return parts if parts > int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")) else None


def yaw_matrix(yaw: Column) -> Column:
    """Rotation about the vertical axis, row by row."""
    c, s, o, i = F.cos(yaw), F.sin(yaw), F.lit(0.0), F.lit(1.0)
    return F.array(c, -s, o, s, c, o, o, o, i)


def rotation_angle(a: Column, b: Column) -> Column:
    """F-05: angle between two rotations of nine values: ``acos((trace(B A^T) - 1) / 2)``, clipped."""
    half = (knn.dot(a, b) - 1.0) / 2.0
    return F.acos(F.least(F.greatest(half, F.lit(-1.0)), F.lit(1.0)))


def ends(edges: DataFrame, nodes: DataFrame, *cols: str, parts: int | None = None) -> DataFrame:
    """J-10: node columns at both ends of each edge, as ``src_*`` and ``dst_*``; ``parts``: the joins' partitions, if not the session's number."""
    for end in ("src", "dst"):
        own = nodes.select("seq_id", F.col("idx").alias(end), *[F.col(c).alias(f"{end}_{c}") for c in cols])
        if parts:
            edges, own = edges.repartition(parts, "seq_id", end), own.repartition(parts, "seq_id", end)
        edges = edges.join(own, ["seq_id", end])
    return edges


def temporal(edges: DataFrame) -> DataFrame:
    """Edges of type 0, without descriptor features."""
    return edges.select("seq_id", "src", "dst", F.lit(0).alias("etype"), F.lit(0.0).alias("cos"), F.lit(0.0).alias("l2"), F.lit(1.0).alias("post"))


def loop_closures(pairs: DataFrame) -> DataFrame:
    """G-04: verified pairs ``seq_id, q, c`` as edges both ways, of type 0."""
    both = F.array(F.struct(F.col("q").alias("src"), F.col("c").alias("dst")), F.struct(F.col("c").alias("src"), F.col("q").alias("dst")))
    return temporal(pairs.select("seq_id", F.explode(both).alias("e")).select("seq_id", "e.src", "e.dst"))


def edge_features(edges: DataFrame, nodes: DataFrame, same_place: float = 5.0, signed: bool = False) -> DataFrame:
    """G-01, G-09: the five attributes of an edge and its pose label.

    Type 0 has ``log1p(distance) / 5`` (``signed``: by direction in time) and the turn over pi; type 1 has cosine, ``log1p(l2) / 5``
    and posterior.  The label is 1 for type 0, and elsewhere whether the ends lie within ``same_place``.  The edges are written, and their
    number says in how many partitions they meet the poses of their ends.
    """
    edges = written(edges, "links")
    met = ends(edges, nodes, "x", "y", "z", "yaw", parts=edge_parts(edges, 4))
    d = F.sqrt(sum(((F.col(f"src_{c}") - F.col(f"dst_{c}")) ** 2 for c in "xyz"), F.lit(0.0)))
    way = F.signum((F.col("dst") - F.col("src")).cast("double")) if signed else F.lit(1.0)
    turn = rotation_angle(yaw_matrix(F.col("src_yaw")), yaw_matrix(F.col("dst_yaw"))) / F.pi()
    old = F.col("etype") == 0
    return met.select(
        "seq_id",
        "src",
        "dst",
        "etype",
        F.when(old, F.log1p(d) / 5 * way).otherwise(0.0).alias("dist"),
        F.when(old, turn).otherwise(0.0).alias("rot"),
        "cos",
        (F.log1p("l2") / 5).alias("l2"),
        "post",
        F.when(old | (d < same_place), 1.0).otherwise(0.0).alias("label"),
    )


def accept(candidates: DataFrame, strict: Column, relaxed: Column, max_k: Column | int, min_k: Column | int = 0) -> DataFrame:
    """T-03: per query the first ``max_k`` strict candidates by ``rank``; if they are fewer than ``min_k``, relaxed ones fill up.

    ``max_k`` and ``min_k`` may be columns of the candidates (F-17).  Strict candidates must precede relaxed ones.
    """
    most, least = (F.lit(k) if isinstance(k, int) else k for k in (max_k, min_k))
    marked = candidates.withColumn("_class", F.when(strict, 0).when(relaxed, 1)).where("_class is not null")
    place = F.row_number().over(Window.partitionBy("seq_id", "q", "_class").orderBy("rank"))
    n_strict = F.sum(F.when(F.col("_class") == 0, 1).otherwise(0)).over(Window.partitionBy("seq_id", "q"))
    numbered = marked.withColumns({"_place": place, "_strict": n_strict})
    fill = F.least(least, most) - F.least(F.col("_strict"), most)
    kept = numbered.where(((F.col("_class") == 0) & (F.col("_place") <= most)) | ((F.col("_class") == 1) & (F.col("_place") <= fill)))
    return kept.drop("_class", "_place", "_strict")


def pair_facts(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``edges`` (``seq_id, src, dst, post``) with cosine and distance of their ends' vectors ``cos, l2``; nodes are read from files, so that no edge moves with a vector."""
    vectors, pairs = Stored(nodes.select("seq_id", "idx", "v")), Stored(edges.withColumn("idx", F.col("src")), ("dst", "post"), vectors=False, block_rows=EDGE_ROWS // 2)

    def work(q: Block, others: Callable[[], Iterator[Block]]) -> Iterator[pd.DataFrame]:
        ends_, held = (q.i, q.columns["dst"]), [None, None]
        seen = np.zeros((2, len(q)), bool)
        for b in others():
            for side, number in enumerate(ends_):
                at = np.minimum(np.searchsorted(b.i, number), len(b) - 1)
                own = b.i[at] == number
                if held[side] is None:
                    held[side] = np.zeros((len(q), b.v.shape[1]))
                held[side][own] = b.v[at[own]]
                seen[side] |= own
        x, y = held
        size = [np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-8) for v in (x, y)]
        made = pd.DataFrame({"src": q.i, "dst": q.columns["dst"], "cos": (x * y).sum(axis=1) / (size[0] * size[1]), "l2": np.sqrt(((x - y) ** 2).sum(axis=1)), "post": q.columns["post"]})
        yield made[seen.all(axis=0)]

    found = written(met(pairs, vectors, work, "src long, dst long, cos double, l2 double, post double"), "similar")
    for x in (vectors, pairs):
        x.discard()
    return found


def _similar(kept: DataFrame, nodes: DataFrame, post: Column) -> DataFrame:
    """Accepted candidates as edges of type 1 with cosine and distance of the descriptors.

    They are written, and their number says in how many partitions they meet the vectors of their ends, or that these are read from files.
    """
    kept = written(kept.select("seq_id", F.col("q").alias("src"), F.col("c").alias("dst"), post.alias("post")), "kept")
    if mount(kept.sparkSession) and kept.count() >= FILE_EDGES:
        made = pair_facts(kept, nodes)
        discard(kept)
        return made.select("seq_id", "src", "dst", F.lit(1).alias("etype"), "cos", "l2", "post")
    met = ends(kept, nodes, "v", parts=edge_parts(kept))
    gap = F.zip_with("src_v", "dst_v", lambda x, y: x - y)
    return met.select("seq_id", "src", "dst", F.lit(1).alias("etype"), knn.cosine(F.col("src_v"), F.col("dst_v")).alias("cos"), knn.norm(gap).alias("l2"), "post")


def cosine_edges(nodes: DataFrame, threshold: float, max_k: int, min_k: int, half: int) -> DataFrame:
    """G-02, fixed threshold: neighbours are fetched first (with room for the temporal ones), filtered afterwards."""
    found = knn.nearest(nodes, nodes, max(max_k, 4 * min_k) + 2 * half, sieve=lambda q, c, score: (q - c > half) | (c - q > half), first=max(max_k, min_k))
    good = F.col("score") >= threshold
    return _similar(accept(found, good, ~good, max_k, min_k), nodes, F.lit(1.0))


def bayes_edges(
    nodes: DataFrame, model: DataFrame, floor: float, confidence: float, max_k: int, min_k: int, half: int, density_k: int = 50, beta: float = 10.0, base_prior: float = 0.01, splits: list[tuple[int, int]] | None = None, least_consistency: float = 0.0
) -> DataFrame:
    """G-02, posterior mode: candidates need a posterior of ``confidence`` under their query's density prior, and strict ones a
    cosine of ``floor``; with ``splits``, also consistent cosines across the channels."""
    found = knn.nearest(nodes, nodes, max(max(max_k, 4 * min_k) + 2 * half, density_k))
    density = found.where(F.col("rank") <= density_k).groupBy("seq_id", "q").agg(F.avg("score").alias("density"))
    priors = stats.density_prior(density, "density", base_prior, beta).select("seq_id", "q", "prior")
    near = found.where(F.abs(F.col("q") - F.col("c")) > half).join(priors, ["seq_id", "q"])
    judged = near.withColumn("post", stats.posterior(F.col("score"), F.col("prior"), model))
    if splits and least_consistency > 0:
        met = ends(judged.withColumnsRenamed({"q": "src", "c": "dst"}), nodes, "v").withColumnsRenamed({"src": "q", "dst": "c"})
        judged = met.where(consistency(F.col("src_v"), F.col("dst_v"), splits) >= least_consistency).drop("src_v", "dst_v")
    sure, high = F.col("post") >= confidence, F.col("score") >= floor
    return _similar(accept(judged, sure & high, sure & ~high, max_k, min_k), nodes, F.col("post"))


def consistency(a: Column, b: Column, splits: list[tuple[int, int]]) -> Column:
    """G-03: one less the deviation of the channels' cosines; an empty channel has cosine 0, a single channel is consistent."""
    if len(splits) <= 1:
        return F.lit(1.0)
    each = []
    for i, j in splits:
        x, y = F.slice(a, i + 1, j - i), F.slice(b, i + 1, j - i)
        none = (knn.norm(x) < 1e-8) | (knn.norm(y) < 1e-8)
        each.append(F.when(none, 0.0).otherwise(knn.dot(x, y) / (knn.norm(x) * knn.norm(y))))
    mean = sum(each, F.lit(0.0)) / len(each)
    return 1.0 - F.sqrt(sum(((x - mean) ** 2 for x in each), F.lit(0.0)) / len(each))


def pose_edges(nodes: DataFrame, radius: float, gap: int, max_k: int, half: int) -> DataFrame:
    """J-08: the ``max_k`` nearest poses within ``radius`` (closed), ``gap`` rows apart and no temporal neighbours."""
    if (held := dense(nodes, radius)) is not None:
        kept = written(nearest_places(held, radius, max(gap, half + 1), max_k), "near")
        held.discard()
        return _similar(kept, nodes, F.lit(1.0))
    apart = F.abs(F.col("i") - F.col("j"))
    near = near_pairs(nodes, nodes, radius, closed=True).where((apart >= gap) & (apart > half))
    place = F.row_number().over(Window.partitionBy("seq_id", "i").orderBy(F.round("d", 9), "j"))
    kept = near.withColumn("rank", place).where(F.col("rank") <= max_k)
    return _similar(kept.select("seq_id", F.col("i").alias("q"), F.col("j").alias("c")), nodes, F.lit(1.0))


def phase_edges(nodes: DataFrame, existing: DataFrame, max_k: int, least: float, exclude: int) -> DataFrame:
    """J-09: neighbours by standardised phase features ``phase``, over ``exclude`` rows apart, that ``existing`` doesn't link."""
    signed = nodes.withColumn("p", F.transform("phase", lambda x: F.signum(x) * F.log1p(F.abs(x))))
    scaled = stats.standardize(signed, "p", stats.column_stats(signed, "p", 1e-6))
    own = scaled.select("seq_id", "idx", F.col("p").alias("v"))
    fetch = max(max_k * 8 + exclude, max_k)
    links = existing.select("seq_id", F.col("src").alias("q"), F.col("dst").alias("c")).where(F.abs(F.col("q") - F.col("c")) > exclude).distinct()
    taken = links.groupBy("seq_id", "q").count().agg(F.coalesce(F.max("count"), F.lit(0))).first()[0]  # that links can take from a query at most
    found = knn.nearest(own, own, fetch, sieve=lambda q, c, score: ((q - c > exclude) | (c - q > exclude)) & (score >= least), first=max_k + taken)
    fresh = found.join(links, ["seq_id", "q", "c"], "left_anti")
    place = F.row_number().over(Window.partitionBy("seq_id", "q").orderBy("rank"))
    kept = fresh.withColumn("place", place).where(F.col("place") <= max_k)
    unit = nodes.withColumn("v", F.transform("v", lambda x: x / F.greatest(knn.norm(F.col("v")), F.lit(1e-8))))
    return _similar(kept, unit, F.least(F.greatest((F.col("score") + 1) / 2, F.lit(0.0)), F.lit(1.0)))


def replace_similarity(edges: DataFrame, fresh: DataFrame) -> DataFrame:
    """U-04: type 0 stays, type 1 is replaced."""
    return edges.where("etype = 0").unionByName(fresh)


def k_hop(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """G-05: nodes ``seq_id, idx, hop`` that out-edges reach in ``hops`` steps, with the least number of steps.

    Links and each step's new nodes are written, so that no step computes the ones before again.
    """
    if hops < 1:
        return start.select("seq_id", "idx", F.lit(0).alias("hop"))
    links = written(edges.select("seq_id", F.col("src").alias("idx"), "dst").distinct(), "links")
    seen = rim = written(start.select("seq_id", "idx", F.lit(0).alias("hop")), "rim")
    for h in range(1, hops + 1):
        step = rim.join(links, ["seq_id", "idx"]).select("seq_id", F.col("dst").alias("idx")).distinct()
        rim = written(step.join(seen.select("seq_id", "idx"), ["seq_id", "idx"], "left_anti").withColumn("hop", F.lit(h)), "rim")
        seen = seen.unionByName(rim)
    return seen


def subgraph(edges: DataFrame, members: DataFrame) -> DataFrame:
    """G-06, U-06: edges with both ends in ``members``, with new numbers by node order within the sequence."""
    place = F.row_number().over(Window.partitionBy("seq_id").orderBy("idx")).cast("long") - 1
    numbered = members.select("seq_id", "idx").distinct().withColumn("new", place)
    return ends(edges, numbered, "new")


def graph_statistics(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """A-25: nodes, edges by type, and edges a node, per sequence."""
    n = nodes.groupBy("seq_id").agg(F.count(F.lit(1)).alias("nodes"))
    kinds = [F.count(F.when(F.col("etype") == t, 1)).alias(name) for t, name in ((0, "temporal"), (1, "similarity"))]
    e = edges.groupBy("seq_id").agg(*kinds)
    both = n.join(e, "seq_id", "left").na.fill(0, ["temporal", "similarity"])
    return both.withColumn("degree", (F.col("temporal") + F.col("similarity")) / F.col("nodes"))


def difference_attention(edges: DataFrame, nodes: DataFrame, logit: Column | None = None) -> DataFrame:
    """A-14, N-06: attention over differences with identity weights and one head.

    Adds to each edge its share ``attn`` of the target: softmax over ``<h_i, h_j - h_i> / sqrt(d)`` plus ``logit``.  The edges are written,
    and their number says in how many partitions they meet the vectors of their ends.
    """
    if logit is None:
        edges = edges.select(*[c for c in ("seq_id", "src", "dst", "etype") if c in edges.columns])
    edges = written(edges, "edges")
    met = ends(edges, nodes, "v", parts=edge_parts(edges)).withColumn("diff", F.zip_with("src_v", "dst_v", lambda a, b: a - b))
    score = knn.dot(F.col("dst_v"), F.col("diff")) / F.sqrt(F.size("dst_v"))
    scored = met.withColumn("score", score if logit is None else score + logit)
    w = Window.partitionBy("seq_id", "dst")
    lifted = scored.withColumn("e", F.exp(F.col("score") - F.max("score").over(w)))
    return lifted.withColumn("attn", F.col("e") / F.sum("e").over(w)).select(*[c for c in ("seq_id", "src", "dst", "etype", "attn", "diff") if c in (*edges.columns, "attn", "diff")])


def attended(attention: DataFrame) -> DataFrame:
    """A-14: ``sum(attn * diff)`` of each target, one row a dimension: ``seq_id, dst, dim, val``."""
    flat = attention.select("seq_id", "dst", "attn", F.posexplode("diff").alias("dim", "x"))
    return flat.groupBy("seq_id", "dst", "dim").agg(F.sum(F.col("attn") * F.col("x")).alias("val"))


def attention_entropy(attention: DataFrame) -> DataFrame:
    """A-15: entropy of the shares of each target."""
    return attention.groupBy("seq_id", "dst").agg(F.sum(-F.col("attn") * F.ln(F.col("attn") + 1e-10)).alias("entropy"))


def twin(past: DataFrame, future: DataFrame, nodes: DataFrame) -> DataFrame:
    """G-08: ``seq_id, dst, dim, val``: the mean of what two directed graphs over the same nodes say; a node that one of them leaves
    alone has 0 there."""
    both = attended(difference_attention(past, nodes)).unionByName(attended(difference_attention(future, nodes)))
    return both.groupBy("seq_id", "dst", "dim").agg((F.sum("val") / 2).alias("val"))
