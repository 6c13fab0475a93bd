"""Packing under a hard budget: ordered folds that stream over sorted rows, with one group's state at a time."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.runtime import prefix_sums, spread


def fold_sorted(df: DataFrame, keys: list[str], order: list, value: str, start: Callable[[], object], step: Callable[[object, int], tuple[object, int]], out: str) -> DataFrame:
    """Fold ``value`` over each group's rows in order; adds the step's integer as column ``out``.

    Rows are sorted by Spark, which spills, and streamed; a worker holds one state and one batch, however large a
    group is. A null value counts as 0.
    """
    fields = df.schema
    ordered = spread(df, *keys).sortWithinPartitions(*keys, *order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, state = None, None
        for b in batches:
            groups = list(zip(*[b.column(k).to_pylist() for k in keys]))
            got = []
            for g, v in zip(groups, b.column(value).to_pylist()):
                if g != last:
                    last, state = g, start()
                state, x = step(state, v or 0)
                got.append(x)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.int64())], names=[*b.schema.names, out])

    return ordered.mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in fields) + f", `{out}` long")


def first_fit(items: DataFrame, keys: list[str], order: list, cost: str, budget: int) -> DataFrame:
    """Items kept by greedy first fit: what does not fit is skipped and the fill goes on. Adds ``used`` (after it)."""
    def step(used: int, v: int) -> tuple[int, int]:
        return (used + v, used + v) if used + v <= budget else (used, -1)

    fits = items.filter(F.coalesce(cost, F.lit(0)) <= budget)  # what is above the budget fits nowhere and changes nothing
    return fold_sorted(fits, keys, order, cost, lambda: 0, step, "used").filter("used >= 0")


def segments(items: DataFrame, keys: list[str], order: list, cost: str, window: int) -> DataFrame:
    """Compaction loop: rows are appended to a segment until its tokens pass the window, then a new one begins."""
    def step(state: tuple[int, int], v: int) -> tuple[tuple[int, int], int]:
        no, used = state
        if used > window:
            no, used = no + 1, 0
        return (no, used + v), no

    return fold_sorted(items, keys, order, cost, lambda: (0, 0), step, "segment")


def tail(items: DataFrame, keys: list[str], order: list[str], cost: str, budget: int) -> DataFrame:
    """Newest contiguous items within the budget; stops at the first that does not fit. Adds ``used`` (from the newest on).

    Sums come from a range sort with stitched partitions, so a group may hold most of the rows. Keys must not be null.
    """
    d = prefix_sums(items.withColumn("_cost", F.coalesce(cost, F.lit(0)).cast("long")), keys, order, "_cost", "_ahead")
    total = d.groupBy(*keys).agg(F.sum("_cost").alias("_total"))
    return d.join(total, keys).withColumn("used", F.col("_total") - F.col("_ahead")).filter(F.col("used") <= budget).drop("_cost", "_ahead", "_total")


def tail_cut(items: DataFrame, keys: list[str], order: list[str], text: str, budget: int) -> DataFrame:
    """Newest texts within ``budget`` bytes a quarter token each; the one that crosses the bound is kept cut to what is left.
    Adds ``tokens`` and ``kept_chars`` (letters of the beginning that are kept)."""
    d = items.withColumn("_own", F.ceil(F.octet_length(F.coalesce(text, F.lit(""))) / 4).cast("long"))
    d = prefix_sums(d, keys, order, "_own", "_ahead")
    total = d.groupBy(*keys).agg(F.sum("_own").alias("_total"))
    room = F.lit(budget) - (F.col("_total") - F.col("_ahead") - F.col("_own"))
    d = d.join(total, keys).withColumn("_room", room).filter((F.col("_room") > 0) & (F.col("_own") > 0))
    return d.withColumn("tokens", F.least("_own", "_room")).withColumn("kept_chars", F.least(F.length(text), (F.col("_room") * 4).cast("int"))).drop("_own", "_ahead", "_total", "_room")


def render(packed: DataFrame, keys: list[str], order: str, text: str = "text", sep: str = "\n\n") -> DataFrame:
    """One packet a key: texts in order, tokens and a digest of the served ids."""
    g = packed.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), "session_id", "event_id", F.col(text).alias("t")))).alias("x"), F.sum("cost").cast("long").alias("total_tokens"), F.count("*").alias("n_entries"))
    ids = F.array_join(F.transform("x", lambda e: F.concat_ws(":", e["session_id"], e["event_id"])), ",")
    return g.select(*keys, "n_entries", "total_tokens", F.sha2(ids, 256).alias("digest"), F.array_join(F.transform("x", lambda e: e["t"]), sep).alias("context"))
