"""Filling containers of a fixed capacity with items, with little unused space.

The configuration linear program is solved over the histogram of lengths: its size depends on the capacity and the grain,
never on the number of items. Multiplicative weights price the length classes, a knapsack dynamic program finds the most
valuable filling at those prices, and the mix of fillings is rounded down; what is left over is filled by exhaustion. The
resulting ranges (class, first rank, last rank, filling) are a small table in which each item is found by its class and rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Length classes per capacity, rounds of the weights, and hashed buckets in which a class is ranked.
CLASSES, ROUNDS, BUCKETS = 512, 500, 64
#: How fast prices fall with coverage; also the number of steps that cover a class.
SHARPNESS = 20.0


def best_filling(sizes: np.ndarray, values: np.ndarray, capacity: int) -> np.ndarray:
    """Unbounded knapsack: how often each size is in the most valuable filling of `capacity`."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    order = np.argsort(sizes, kind="stable")
    small, worth = sizes[order], values[order]
    fit = np.searchsorted(small, np.arange(capacity + 1), side="right")
    for c in range(1, capacity + 1):
        k = fit[c]
        best[c] = best[c - 1]
        if k:
            got = best[c - small[:k]] + worth[:k]
            i = int(got.argmax())
            if got[i] > best[c] + 1e-12:
                best[c], last[c] = got[i], order[i]
    counts, c = np.zeros(len(sizes), np.int64), capacity
    while c > 0:
        if last[c] < 0:
            c -= 1
        else:
            counts[last[c]] += 1
            c -= sizes[last[c]]
    return counts


def configuration_lp(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, float]]:
    """(filling, amount) pairs whose sum covers the demand: the covering program by multiplicative weights.

    Each round adds as much of the best filling at the present prices as covers 1 / SHARPNESS of its scarcest class; prices
    fall exponentially with what is covered. The amounts are scaled at the end by what the middle class has too much.
    """
    cover, log_weight = np.zeros(len(sizes)), np.zeros(len(sizes))
    mix: dict[bytes, list] = {}
    for _ in range(rounds):
        weight = np.exp(log_weight - log_weight.max())
        filling = best_filling(sizes, weight / demand, capacity)
        used = filling > 0
        step = 1 / SHARPNESS * float((demand[used] / filling[used]).min())
        mix.setdefault(filling.tobytes(), [filling, 0.0])[1] += step
        gain = step * filling / demand
        cover += gain
        log_weight -= SHARPNESS * gain
        if cover.min() >= 1:
            break
    scale = max(1.0, float(np.median(cover)))
    return [(f, x / scale) for f, x in mix.values()]


def plan(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = ROUNDS) -> list[tuple[np.ndarray, int]]:
    """(filling, copies): whole containers that hold every item exactly once. sizes must be distinct and at most capacity."""
    left, out = demand.astype(np.int64).copy(), []
    if not len(sizes):
        return out

    def take(filling: np.ndarray, most: int) -> None:
        used = filling > 0
        copies = min(most, int((left[used] // filling[used]).min()))
        if copies > 0:
            out.append((filling, copies))
            left[used] -= copies * filling[used]

    for filling, amount in sorted(configuration_lp(sizes, demand.astype(float), capacity, rounds), key=lambda x: -x[1]):
        take(filling, int(amount))
    descending = np.argsort(-sizes, kind="stable")
    while left.any():  # each turn uses up at least one class, or all but a few of its items
        first = next(i for i in descending if left[i])
        filling, room = np.zeros(len(sizes), np.int64), capacity - int(sizes[first])
        filling[first] = 1
        exact = best_filling(sizes[left > 0], sizes[left > 0].astype(float), room) if room > 0 else np.zeros(int((left > 0).sum()), np.int64)
        wanted = filling.copy()
        wanted[left > 0] += exact
        if (wanted <= left).all():
            take(wanted, 1 << 62)
            continue
        for i in descending:  # too few items for that filling: largest first
            n = min(int(left[i] - filling[i]), room // int(sizes[i]))
            if n > 0:
                filling[i] += n
                room -= n * int(sizes[i])
        take(filling, 1 << 62)
    return out


def in_ranges(ranked: DataFrame, ranges: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """(k, piece, first, n, container) of items (.., c, rank) by the ranges (class, low, high, items a container, first container).

    The ranges of a class follow each other from rank 0, so a binary search in all of them, sorted, finds an item's; there are at most
    fillings * classes of them, whatever the number of items. Row-local.
    """
    table = np.array(sorted(ranges), np.int64).reshape(-1, 5)
    bits = 48  # ranks of a class stay below 2^48, classes below 2^15
    starts, lows, each, base = (table[:, 0] << bits) + table[:, 1], table[:, 1], table[:, 3], table[:, 4]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                c, rank = (batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in (4, 5))
                i = np.searchsorted(starts, (c << bits) + rank, side="right") - 1
                yield pa.RecordBatch.from_arrays([*batch.columns[:4], pa.array(base[i] + (rank - lows[i]) // each[i])], ["k", "piece", "first", "n", "container"])

    return ranked.mapInArrow(run, ", ".join([*(f"{c} {ranked.schema[c].dataType.simpleString()}" for c in ("k", "piece", "first", "n")), "container long"]))


def pack(items: DataFrame, key: str, size: str, capacity: int, classes: int = CLASSES, rounds: int = ROUNDS) -> DataFrame:
    """(key, piece, first, n, container): every item in a container of at most `capacity`.

    An item over the capacity is divided into full pieces and a rest; no other is. first is the piece's offset in its item.
    Items of size 0 or null take no room and go to container 0. Keys must be unique (equal rows may swap places otherwise).
    Only the histogram, at most `classes` rows, comes to the driver.
    """
    if capacity < 1:
        raise ValueError("capacity must be positive")
    grain = max(1, capacity // classes)
    units = capacity // grain
    own = items.select(F.col(key).alias("k"), F.coalesce(F.col(size).cast("long"), F.lit(0)).alias("s"))
    pieces = own.select("k", "s", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0), F.floor((F.col("s") - 1) / capacity)).cast("long"))).alias("piece"))
    pieces = pieces.select("k", "piece", (F.col("piece") * capacity).alias("first"), F.least(F.col("s") - F.col("piece") * capacity, F.lit(capacity)).alias("n"))
    # a length between units * grain and the capacity fills a container alone
    pieces = pieces.withColumn("c", F.least(F.ceil(F.col("n") / grain), F.lit(units)).cast("int")).withColumn("b", F.pmod(F.xxhash64("k", "piece"), F.lit(BUCKETS)).cast("int"))
    counts = pieces.where("c > 0").groupBy("c", "b").count()
    found = counts.groupBy("c").agg(F.sum("count").alias("n")).orderBy("c").collect()
    sizes, demand = np.array([r.c for r in found], np.int64), np.array([r.n for r in found], np.int64)
    rows, base, rank = [], 0, np.zeros(len(sizes), np.int64)
    for filling, copies in plan(sizes, demand, units, rounds):
        for i in np.flatnonzero(filling):
            rows.append((int(sizes[i]), int(rank[i]), int(rank[i] + copies * filling[i]), int(filling[i]), base))
            rank[i] += copies * filling[i]
        base += copies
    # the rank in a class: the rank in its hashed bucket after the buckets before, so a class of very many items is no single task
    before = F.coalesce(F.sum("count").over(Window.partitionBy("c").orderBy("b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    offsets = F.broadcast(counts.select("c", "b", before.alias("before")))  # at most classes * BUCKETS rows
    inside = F.row_number().over(Window.partitionBy("c", "b").orderBy("k", "piece")) - 1
    ranked = pieces.where("c > 0").withColumn("inside", inside).join(offsets, ["c", "b"]).withColumn("rank", F.col("before") + F.col("inside"))
    placed = in_ranges(ranked.select("k", "piece", "first", "n", "c", "rank"), rows)
    empty = pieces.where("c = 0").select("k", "piece", "first", "n", F.lit(0).cast("long").alias("container"))
    return placed.unionByName(empty).withColumnRenamed("k", key)
