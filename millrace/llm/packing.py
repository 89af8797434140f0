"""Texts combined into containers of fixed capacity, none split unless it alone exceeds the capacity.

Packing is planned on counts: how many pieces there are of each length. There are at most as
many lengths as the capacity has tokens, so the plan is small however many texts there are.
Pieces are routed to tiers by context size (the capacity, a quarter of it and so on). Each
tier is packed into windows of its own size, the longest tier first; what a window has left is
filled from the same tier, then from the shorter ones, longest fitting piece first. Windows of
the first tier are containers. Full windows of the other tiers go into containers whole, with
pieces of windows that could not be filled beside them, so no tier keeps half-filled windows.
A plan consists of patterns, each a list of pieces with the number of containers filled that
way. Pieces then take their places by their rank among those of equal length. Containers of
all tiers are dealt to step groups in turns, costliest first, so that the groups of one
training step cost about the same: two groups differ by less than one container's cost.
"""

from __future__ import annotations

from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F, Window as W

from millrace.llm.tokens import with_tokens
from millrace.session import cut

Pattern = tuple[tuple[int, int], ...]  # (tokens, size of the window) of each piece of a container, in order


def tiers(capacity: int, least: int = 32, factor: int = 4) -> list[int]:
    """Window sizes of the tiers, the longest first: the capacity and its quarters down to about least."""
    out = [capacity]
    while out[-1] // factor >= least:
        out.append(out[-1] // factor)
    return out


def _filled(left: dict, size: int, above: int) -> list[tuple[tuple, int]]:
    """(keys in one window, number of such windows): every item longer than ``above`` placed, shorter ones where they fit.

    ``left`` has the number of items by key (length, kind) and loses what is placed. The longest
    item left opens a window and the longest fitting ones fill it. The pattern is used as often
    as the counts allow, so each step uses up at least one key.
    """
    keys = sorted(k for k, c in left.items() if c > 0 and k[0] <= size)
    patterns = []
    while keys and keys[-1][0] > above:
        used: Counter = Counter({keys[-1]: 1})
        gap = size - keys[-1][0]
        j = len(keys) - 1
        while gap:
            j = min(j, bisect_right(keys, (gap, 2)) - 1)
            while j >= 0 and used[keys[j]] >= left[keys[j]]:
                j -= 1
            if j < 0:
                break
            key = keys[j]
            times = min(gap // key[0], left[key] - used[key])
            used[key] += times
            gap -= times * key[0]
        times = min(left[k] // c for k, c in used.items())
        patterns.append((tuple(sorted(used.elements(), reverse=True)), times))
        for k, c in used.items():
            left[k] -= c * times
            if not left[k]:
                del left[k]
                keys.remove(k)
    return patterns


def plan(counts: dict[int, int], capacity: int, windows: list[int] | None = None) -> list[tuple[Pattern, int]]:
    """(pieces of one container, number of such containers), all pieces of ``counts`` placed once.

    ``windows`` has the tiers' window sizes, the capacity first; by default those of tiers().
    """
    sizes = windows or tiers(capacity)
    left = {(n, 0): c for n, c in counts.items() if c > 0}
    out: list[tuple[Pattern, int]] = []
    full: dict[int, list[tuple[tuple[int, ...], int]]] = {}  # window size to its full windows
    loose: Counter = Counter()
    for size, below in zip(sizes, [*sizes[1:], 0]):
        for keys, times in _filled(left, size, below):
            lengths = tuple(n for n, _ in keys)
            if size == capacity:
                out.append((tuple((n, size) for n in lengths), times))
            elif sum(lengths) == size:
                full.setdefault(size, []).append((lengths, times))
            else:
                for n in lengths:
                    loose[n, 0] += times
    for size, rows in full.items():
        loose[size, 1] = sum(times for _, times in rows)
    stock = {size: [[lengths, times] for lengths, times in rows] for size, rows in full.items()}
    for keys, times in _filled(dict(loose), capacity, 0):
        wanted = Counter(n for n, kind in keys if kind)
        single = tuple((n, capacity) for n, kind in keys if not kind)
        while times:
            # as many containers alike as the windows at hand allow
            run = min([times, *(stock[n][-1][1] // c for n, c in wanted.items())])
            pieces: list[tuple[int, int]] = []
            for n, c in sorted(wanted.items(), reverse=True):
                for _ in range(c):
                    pieces += [(m, n) for m in stock[n][-1][0]]
                    stock[n][-1][1] -= max(run, 1)
                    if not stock[n][-1][1]:
                        stock[n].pop()
            out.append((tuple(pieces) + single, max(run, 1)))
            times -= max(run, 1)
    return out


class Places:
    """Container, place, first token and window of the piece with a given rank among those of its length."""

    def __init__(self, patterns: list[tuple[Pattern, int]], group_size: int):
        ordered = sorted(patterns, key=lambda p: (-container_cost(p[0]), p[0]))  # costliest first
        self.containers = sum(times for _, times in ordered)
        self.groups = max(1, -(-self.containers // group_size))
        runs: dict[int, list[tuple[int, int, int, list[tuple[int, int, int]]]]] = {}
        taken: Counter[int] = Counter()
        at = 0
        for pattern, times in ordered:
            where: dict[int, list[tuple[int, int, int]]] = {}
            begin = 0
            for place, (n, window) in enumerate(pattern):
                where.setdefault(n, []).append((place, begin, window))
                begin += n
            for n, slots in where.items():
                runs.setdefault(n, []).append((taken[n], at, len(slots), slots))
                taken[n] += len(slots) * times
            at += times
        self.runs = {n: (np.array([r[0] for r in rs]), rs) for n, rs in runs.items()}

    def group(self, container: int) -> int:
        """The step group: containers go round the groups forth and back."""
        turn, seat = divmod(container, self.groups)
        return seat if turn % 2 == 0 else self.groups - 1 - seat

    def find(self, length: int, rank: int) -> tuple[int, int, int, int, int]:
        """(container, step group, place, first token, window size) of a piece."""
        starts, runs = self.runs[length]
        first, at, per, slots = runs[int(np.searchsorted(starts, rank, side="right")) - 1]
        container = at + (rank - first) // per
        place, begin, window = slots[(rank - first) % per]
        return container, self.group(container), place, begin, window


def container_cost(pattern: Pattern) -> int:
    """What attention within each piece costs: the sum of the squared lengths."""
    return sum(n * n for n, _ in pattern)


def ranked(pieces: DataFrame, length: str, order: list[str], per_part: int = 200_000) -> DataFrame:
    """pieces + rank (from 0) among those of equal length.

    A length may hold a large part of all rows, so rows are numbered within salted parts of it
    and the parts' sizes are added up; no part grows with the data.
    """
    parts = max(1, -(-pieces.count() // per_part))
    salted = pieces.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)))
    within = salted.withColumn("_n", F.row_number().over(W.partitionBy(length, "_part").orderBy(*order)))
    sizes = salted.groupBy(length, "_part").agg(F.count("*").alias("_size"))
    before = sizes.withColumn("_before", F.sum("_size").over(W.partitionBy(length).orderBy("_part")) - F.col("_size")).drop("_size")
    return within.join(before, [length, "_part"]).withColumn("rank", F.col("_n") - 1 + F.col("_before")).drop("_part", "_n", "_before")


def packed(sizes: DataFrame, capacity: int, key: str = "doc_id", tokens: str = "tokens", group_size: int = 8) -> DataFrame:
    """(key, piece, pieces, tokens, text_start, container, step_group, place, container_start, window_tokens) of every piece.

    ``sizes`` has one row for each text. A text longer than the capacity is cut into pieces of
    the capacity and a rest; text_start is the piece's first token in its text,
    container_start in its container; window_tokens is the size of the window it stands in,
    the capacity if it has none of a shorter tier. Texts without tokens have no piece.
    """
    cut_up = (
        sizes.where(F.col(tokens) > 0)
        .withColumn("pieces", F.ceil(F.col(tokens) / capacity).cast("bigint"))
        .withColumn("piece", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("pieces"))))
        .withColumn("text_start", (F.col("piece") - 1) * capacity)
        .select(key, "piece", "pieces", "text_start", F.least(F.lit(capacity).cast("bigint"), F.col(tokens) - F.col("text_start")).alias("tokens"))
    )
    cut_up = cut(cut_up)
    counts = {r["tokens"]: r["n"] for r in cut_up.groupBy("tokens").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    places = Places(plan(counts, capacity), group_size)

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for lengths, ranks in batches:
            yield pd.DataFrame([places.find(int(n), int(r)) for n, r in zip(lengths, ranks)], columns=["container", "step_group", "place", "container_start", "window_tokens"], dtype="int64")

    find = F.pandas_udf(run, "struct<container:bigint,step_group:bigint,place:bigint,container_start:bigint,window_tokens:bigint>")
    return ranked(cut_up, "tokens", [key, "piece"]).select(key, "piece", "pieces", "tokens", "text_start", find("tokens", "rank").alias("_p")).select(key, "piece", "pieces", "tokens", "text_start", "_p.*")


def document_containers(documents: DataFrame, pack_sizes: DataFrame, path: str) -> DataFrame:
    """(pack_id, ...) of packed() for every capacity of pack_sizes, a small table of parameters."""
    sizes = cut(with_tokens(documents.where(F.col("doc_id").isNotNull()), ["doc_id"], path).dropDuplicates(["doc_id"]))
    out = None
    for row in sorted(set((r["pack_id"], r["capacity_tokens"]) for r in pack_sizes.where("capacity_tokens > 0").collect())):
        one = packed(sizes, row[1]).select(F.lit(row[0]).alias("pack_id"), "*")
        out = one if out is None else out.unionByName(one)
    if out is None:
        return packed(sizes.limit(0), 1).select(F.lit(None).cast("int").alias("pack_id"), "*")
    return out
