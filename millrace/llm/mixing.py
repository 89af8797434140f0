"""Sources mixed so that each makes up its target share of the total size.

The total is divided into blocks of equal size, small enough for the smallest share to get
many. Blocks go to sources by Sainte-Lague apportionment (highest quotients of the target
shares), and a source's blocks to shards of its documents the same way, weighted by the
shards' sizes; all quotas are whole numbers. The documents of a shard, in a seeded order, are
divided into such blocks. All blocks are taken as often as the quota allows, then as many as
are left of it once more, in a second seeded order, counted by their documents' tokens; what
a document too long for the rest leaves open is filled with those behind it that fit.
"""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from millrace.llm.tokens import with_tokens
from millrace.session import cut


def sainte_lague(weights: dict, seats: int, caps: dict | None = None) -> dict:
    """Whole seats for each key by highest quotients weight / (2 k + 1), at most caps[key] each.

    Found by bisection over the divisor, so the cost doesn't grow with the seats. Ties go to
    the smaller key. Keys without weight get none; fewer seats come out if the caps bind.
    """
    live = {k: w for k, w in weights.items() if w > 0}
    cap = {k: (caps or {}).get(k, seats) for k in live}
    seats = min(seats, sum(cap.values()))
    if not live or seats <= 0:
        return {k: 0 for k in weights}

    def given(scale: float) -> dict:
        return {k: min(cap[k], math.floor(w * scale + 0.5)) for k, w in live.items()}

    low, high = 0.0, seats / sum(live.values())
    while sum(given(high).values()) < seats:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (low, mid) if sum(given(mid).values()) >= seats else (mid, high)
    out = given(high)
    for k in sorted(out, key=lambda k: (live[k] / max(1, 2 * out[k] - 1), _order(k)))[:]:  # tied quotients beyond the seats
        if sum(out.values()) <= seats:
            break
        if out[k]:
            out[k] -= 1
    return {k: out.get(k, 0) for k in weights}


def _order(key) -> tuple:
    return tuple(-ord(c) for c in str(key))


def feasible_total(shares: dict[str, float], available: dict[str, int], repeats: dict[str, int]) -> int:
    """The largest total at which every source that has documents can give its share within its repeats."""
    limits = [available[s] * repeats[s] / share for s, share in shares.items() if share > 0 and available.get(s, 0) > 0]
    return int(min(limits)) if limits else 0


BLOCKS_OF_LEAST = 100  # blocks of the smallest share
MOST_BLOCK = 1 << 16  # tokens of a block at most
FILLS = 2
MOST_SHARDS = 10_000  # shards of a source at most: what one task apportions


def block_size(total: float, shares: dict[str, float]) -> float:
    """Tokens of a block: the smallest share has BLOCKS_OF_LEAST of them or more."""
    return max(1.0, min(total * min(shares.values()) / BLOCKS_OF_LEAST, MOST_BLOCK)) if shares else 1.0


def _apportion(quotas: dict[str, int], repeats: dict[str, int], block: float):
    """Of one source's shards (source, shard, n): how often each is taken whole, and the tokens of the blocks taken once more."""

    def run(shards: pd.DataFrame) -> pd.DataFrame:
        source = shards["source"].iloc[0]
        own, most = dict(zip(shards["shard"].tolist(), shards["n"].tolist())), repeats[source]
        rows = []
        for shard, quota in sainte_lague(own, quotas.get(source, 0), {h: math.ceil(n * most / block) for h, n in own.items()}).items():
            tokens = min(quota * block, own[shard] * most)
            full = min(most, int(tokens // own[shard]))
            rows.append((source, shard, full, float(tokens - full * own[shard]), most))
        return pd.DataFrame(rows, columns=["source", "shard", "full", "rest", "most"])

    return run


def mixed(documents: DataFrame, targets: DataFrame, path: str, total_tokens: int | None = None, shard_tokens: int = 50_000_000, seed: int = 20_251) -> tuple[DataFrame, DataFrame]:
    """(chosen documents with their repeats, shares by source).

    Chosen: (doc_id, source, tokens, repeats). Shares: (source, target_share, max_repeats,
    documents, tokens, actual_share), a row for each target, also for sources without a
    document. total_tokens is at most the largest total that all sources can bear, and that
    by default. Documents with a null source, one without a target, or no tokens aren't chosen.
    ``path`` is the vocabulary that sizes the texts.

    Plan: the targets and the sources' sizes, a row for each target, go to the driver. A source
    of n tokens has n / shard_tokens shards, at most MOST_SHARDS; one task apportions the shards
    of a source, and each shard's documents are ordered in one task.
    """
    # A small table of parameters; of repeated sources the first by share counts.
    rows = {r["source"]: (r["target_share"], r["max_repeats"]) for r in targets.where("source is not null and target_share > 0 and max_repeats > 0").orderBy(F.desc("source"), F.desc("target_share")).collect()}
    shares, repeats = {s: a for s, (a, _) in rows.items()}, {s: int(b) for s, (_, b) in rows.items()}
    sized = with_tokens(documents.where(F.col("doc_id").isNotNull() & F.col("source").isin(list(rows))), ["doc_id", "source"], path)
    sized = cut(sized.where("tokens > 0").dropDuplicates(["doc_id"]))
    available = {r["source"]: r["n"] for r in sized.groupBy("source").agg(F.sum("tokens").alias("n")).collect()}
    total = min(feasible_total(shares, available, repeats), total_tokens or 2**62)
    live = {s: a for s, a in shares.items() if available.get(s)}
    block = block_size(total * sum(live.values()), live)
    quotas = sainte_lague(live, round(total * sum(live.values()) / block))

    # One source may hold most of the tokens, so each has its own number of shards.
    n_shards = {s: min(MOST_SHARDS, max(1, -(-n // shard_tokens))) for s, n in available.items()}
    count = F.element_at(F.create_map(*[x for s, n in n_shards.items() for x in (F.lit(s), F.lit(n))]), F.col("source")) if n_shards else F.lit(1)
    sharded = sized.withColumn("shard", F.pmod(F.xxhash64(F.lit(seed), "doc_id"), count.cast("bigint")))
    sizes = sharded.groupBy("source", "shard").agg(F.sum("tokens").alias("n"))
    planned = sizes.groupBy("source").applyInPandas(_apportion(quotas, repeats, block), "source string, shard bigint, full int, rest double, most int")
    shard = W.partitionBy("source", "shard")
    begun = F.sum("tokens").over(shard.orderBy(F.xxhash64(F.lit(seed + 1), "doc_id"), "doc_id")) - F.col("tokens")
    in_blocks = sharded.withColumn("_from", begun).withColumn("_block", F.floor((F.col("_from") + F.col("tokens") / 2) / block))
    by_block = shard.orderBy(F.xxhash64(F.lit(seed + 2), "source", "shard", "_block"), "_block", "_from")
    # Once more: documents of the chosen blocks in order while they fit, then, as often as FILLS, those
    # behind that fit what is left, and last the one that comes closest to the rest.
    placed = in_blocks.join(planned, ["source", "shard"]).withColumn("_gap", F.when(F.col("full") < F.col("most"), F.col("rest")).otherwise(0.0)).withColumn("_more", F.lit(0))
    for _ in range(1 + FILLS):
        open_ = (F.col("_more") == 0) & (F.col("tokens") <= F.col("_gap"))
        placed = placed.withColumn("_upto", F.sum(F.when(open_, F.col("tokens")).otherwise(0)).over(by_block))
        taken = open_ & (F.col("_upto") <= F.col("_gap"))
        placed = placed.withColumn("_left", F.col("_gap") - F.coalesce(F.max(F.when(taken, F.col("_upto"))).over(shard), F.lit(0)))
        placed = placed.withColumn("_more", F.when(taken, 1).otherwise(F.col("_more"))).withColumn("_gap", F.col("_left"))
    off = F.when((F.col("_more") == 0) & (F.col("tokens") < 2 * F.col("_gap")), F.abs(F.col("tokens") - F.col("_gap")))
    closest = F.min(F.struct(F.coalesce(off, F.lit(float("inf"))).alias("off"), F.col("doc_id").alias("doc"))).over(shard)
    once_more = (F.col("_more") == 1) | (off.isNotNull() & (closest["doc"] == F.col("doc_id")))
    chosen = placed.withColumn("repeats", (F.col("full") + F.when(once_more, 1).otherwise(0)).cast("bigint")).where("repeats > 0").select("doc_id", "source", "tokens", "repeats")
    used = chosen.groupBy("source").agg(F.count("*").alias("documents"), F.sum(F.col("tokens") * F.col("repeats")).alias("tokens"))
    listed = sized.sparkSession.createDataFrame([(s, float(a), repeats[s]) for s, a in shares.items()], "source string, target_share double, max_repeats int")
    reported = listed.join(used, "source", "left").fillna(0, ["documents", "tokens"])
    reported = reported.withColumn("actual_share", F.coalesce(F.try_divide(F.col("tokens").cast("double"), F.sum("tokens").over(W.partitionBy(F.lit(1)))), F.lit(0.0)))
    return chosen, reported
