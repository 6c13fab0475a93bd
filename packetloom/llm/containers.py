"""Filling fixed-capacity containers with items by bulk-synchronous best fit.

Sizes are whole numbers up to the capacity, so all items of a size are alike and so are all gaps of a size: the
sorted items and gaps are held as counts and as intervals of container numbers, whose number depends on the
capacity and not on the data. Each round takes the items of one size, largest first, sweeps the gaps for the
successor (the least gap that fits), fills as many containers at once as items or gaps allow, in rank order, and
files the changed gaps for the later rounds. The items are range-sorted and get their global rank within their size
by prefix counts over partitions, so a size that a third of all rows share is spread over many tasks, and find their
container in the finished plan by rank.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.runtime import cut, ranked

CAPACITY = 2048


def plan_best_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Best-fit-decreasing plan for items given as counts by size.

    Returns rows (size, first rank, items, first container, offset in the container), where items of consecutive
    ranks go to consecutive containers, and the number of containers.
    """
    plan: list[tuple[int, int, int, int, int]] = []
    gaps: dict[int, list[tuple[int, int]]] = {}  # gap -> intervals (first container, containers)
    order: list[int] = []  # gaps that have containers, ascending
    used = 0

    def put(gap: int, first: int, n: int) -> None:
        if gap <= 0:
            return
        if gap not in gaps:
            gaps[gap] = []
            bisect.insort(order, gap)
        gaps[gap].append((first, n))

    for size in sorted((s for s in counts if s > 0), reverse=True):
        left, rank = counts[size], 0
        while left:
            at = bisect.bisect_left(order, size)
            if at == len(order):
                opened = -(-left // (capacity // size))
                put(capacity, used, opened)
                used += opened
                continue
            gap = order[at]
            intervals = gaps[gap]
            while left and intervals:
                first, n = intervals.pop()
                take = min(n, left)
                if take < n:
                    intervals.append((first + take, n - take))
                plan.append((size, rank, take, first, capacity - gap))
                put(gap - size, first, take)
                rank += take
                left -= take
            if not intervals:
                del gaps[gap]
                order.remove(gap)
    return plan, used


def divide(sizes: DataFrame, key: str, capacity: int) -> DataFrame:
    """(key, piece_no, start, size): items above the capacity as full pieces and a rest, others whole."""
    n = F.greatest(F.ceil(F.col("n_tokens") / capacity), F.lit(1)).cast("int")
    piece = F.explode(F.sequence(F.lit(0), n - 1)).alias("piece_no")
    return sizes.select(key, "n_tokens", piece).select(
        key, "piece_no", (F.col("piece_no") * capacity).cast("long").alias("start"),
        F.least(F.lit(capacity).cast("long"), F.col("n_tokens") - F.col("piece_no") * capacity).alias("size"),
    )


def _place(plan: list[tuple[int, int, int, int, int]], key: str):
    by_size: dict[int, np.ndarray] = {}
    for row in sorted(plan):
        by_size.setdefault(row[0], []).append(row[1:])
    tables = {s: np.array(r, dtype=np.int64) for s, r in by_size.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size = b.column("size").to_numpy(zero_copy_only=False)
            rank = b.column("rank").to_numpy(zero_copy_only=False)
            container = np.zeros(len(size), dtype=np.int64)
            offset = np.zeros(len(size), dtype=np.int64)
            for s in np.unique(size):
                if s <= 0:
                    continue
                t, rows = tables[int(s)], np.flatnonzero(size == s)
                at = np.searchsorted(t[:, 0], rank[rows], side="right") - 1
                container[rows] = t[at, 2] + rank[rows] - t[at, 0]
                offset[rows] = t[at, 3]
            yield pa.RecordBatch.from_arrays([b.column(key), b.column("piece_no"), b.column("start"), b.column("size"), pa.array(container), pa.array(offset)], names=[key, "piece_no", "start", "size", "container_id", "container_offset"])

    return run


def fill_containers(sizes: DataFrame, key: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """Assign items to containers of ``capacity``; only items above it are divided.

    ``sizes``: key and n_tokens BIGINT (null counts as 0); other columns are ignored, equal rows are items of
    their own. Result: key, piece_no, start (in the item), size, container_id, container_offset. Items of size 0
    take no place and are filed under container 0. An empty table gives an empty result.
    """
    kind = sizes.schema[key].dataType.simpleString()
    items = divide(sizes.select(key, F.coalesce(F.col("n_tokens"), F.lit(0)).cast("long").alias("n_tokens")), key, capacity)
    items = cut(items)
    counts = {r["size"]: r["n"] for r in items.groupBy("size").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    plan, _ = plan_best_fit(counts, capacity)
    placed = ranked(items, ["size"], [key, "piece_no"], "rank").select(key, "piece_no", "start", "size", "rank")
    return placed.mapInArrow(_place(plan, key), f"`{key}` {kind}, piece_no int, start long, size long, container_id long, container_offset long")
