"""Set-similarity join by weighted containment, and star clustering of its links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from millrace.session import cut


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)


def containment_join(sets: DataFrame, threshold: float, id_: str = "id", tokens: str = "tokens") -> DataFrame:
    """(a, b, similarity) of every pair of sets whose weighted containment is at least threshold.

    ``tokens`` is an array of struct<token, weight>, the weight being the token's rarity. The
    containment of two sets is the weight of their common tokens over the smaller set's
    weight; a is the smaller set (of equal ones the one with the smaller id).

    A set is probed with its prefix: its rarest tokens, up to where the rest weighs less than
    threshold of the whole, so that a partner must hold one of them. Length filter: the
    partner weighs no less. Positional filter: the weight from the common token on, in either
    set, can still reach the threshold. What passes is verified exactly. Null or empty sets
    and sets without weight have no pairs; equal ids count once.
    """
    ordered = (
        sets.where(F.size(tokens) > 0)
        .select(F.col(id_).alias("id"), F.array_sort(F.array_distinct(tokens), lambda x, y: F.when(x["weight"] > y["weight"], -1).when(x["weight"] < y["weight"], 1).when(x["token"] < y["token"], -1).when(x["token"] > y["token"], 1).otherwise(0)).alias("t"))
        .dropDuplicates(["id"])
        .withColumn("whole", _sum(F.transform("t", lambda x: x["weight"])))
        .where("whole > 0")
    )
    ordered = cut(ordered)
    # rest: the weight from this token on, itself included. Only these numbers meet on a token, not the sets.
    placed = ordered.select("id", "t", "whole", F.posexplode("t").alias("pos", "x")).select(
        "id", "whole", F.col("x.token").alias("token"), _sum(F.transform(F.slice("t", F.col("pos") + 1, F.size("t")), lambda y: y["weight"])).alias("rest")
    )
    probe = placed.where(F.col("rest") >= F.col("whole") * threshold - 1e-9)
    a, b = probe.alias("a"), placed.alias("b")
    met = a.join(
        b,
        (F.col("a.token") == F.col("b.token"))
        & ((F.col("b.whole") > F.col("a.whole")) | ((F.col("b.whole") == F.col("a.whole")) & (F.col("b.id") > F.col("a.id"))))
        & (F.col("a.id") != F.col("b.id"))
        & (F.least(F.col("a.rest"), F.col("b.rest")) >= F.col("a.whole") * threshold - 1e-9),
    )
    pairs = met.select(F.col("a.id").alias("a"), F.col("b.id").alias("b")).distinct()
    left, right = ordered.select(F.col("id").alias("a"), F.col("t").alias("_a"), "whole"), ordered.select(F.col("id").alias("b"), F.col("t").alias("_b"))
    common = _sum(F.transform(F.array_intersect("_a", "_b"), lambda x: x["weight"]))
    verified = pairs.join(left, "a").join(right, "b").select("a", "b", (common / F.col("whole")).alias("similarity"))
    return verified.where(F.col("similarity") >= threshold - 1e-9)


def star_clusters(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, center): every node with the center of its star.

    ``nodes`` has id and rank (any ordered type; the higher comes first, ids break ties),
    ``links`` has a, b and similarity. In each round the nodes that outrank all their open
    neighbours become centers and take in their open neighbours, each going to its most
    similar center. A star has radius one, so sets that only a chain joins stay apart. A
    node without links is its own center.

    Each round is written to the checkpoint folder. Every round closes every local maximum
    and its neighbours, so rounds are few unless ranks fall steadily along a long chain, and
    they end when no link is left, as each closes the highest node at least.
    """
    ranked = nodes.select("id", F.struct("rank", F.col("id").alias("by")).alias("rank"))
    both = links.select("a", "b", "similarity").union(links.select("b", "a", "similarity")).where("a <> b").groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    linked = both.select("a").distinct()
    done = ranked.join(linked, F.col("id") == F.col("a"), "left_anti").select("id", F.col("id").alias("center"))
    edges = cut(both.join(ranked.select(F.col("id").alias("a"), F.col("rank").alias("rank_a")), "a").join(ranked.select(F.col("id").alias("b"), F.col("rank").alias("rank_b")), "b"))
    rounds = 0
    while not edges.isEmpty():
        tops = edges.groupBy(F.col("a").alias("id")).agg(F.max("rank_b").alias("best"), F.first("rank_a").alias("rank")).where(F.col("rank") > F.col("best")).select("id")
        taken = (
            edges.join(tops, F.col("b") == F.col("id"), "left_semi")
            .groupBy(F.col("a").alias("id"))
            .agg(F.max_by("b", F.struct("similarity", "rank_b")).alias("center"))
        )
        closed = cut(tops.select("id", F.col("id").alias("center")).union(taken.join(tops, "id", "left_anti")))
        if closed.isEmpty():
            raise ValueError("no node outranks its neighbours: an id has several ranks")
        done = done.union(closed)
        gone = closed.select("id")
        edges = cut(edges.join(gone, F.col("a") == F.col("id"), "left_anti").join(gone, F.col("b") == F.col("id"), "left_anti"))
        rounds += 1
        if rounds % 20 == 0:  # keeps the plan of a long chain short
            done = cut(done)
    left = linked.select(F.col("a").alias("id")).join(ranked, "id").join(done, "id", "left_anti")
    return done.union(left.select("id", F.col("id").alias("center")))
