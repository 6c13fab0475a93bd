"""Folds along the parent chains of forests, and sums over their subtrees, by contraction and recursion.

Nodes are cut into blocks of consecutive places, so that chains (a child mostly follows its parent) stay within one
block even when one scope holds most of the rows. A worker streams over sorted blocks and peels each like Kahn's
algorithm: from its local roots downwards it folds chains, from its leaves upwards it sums subtrees; what neither
peel reaches lies on loops. The local roots whose parent is in another block are *exits*. Their parents' fragments make
the quotient forest, which the same function solves, blocks being cut anew by dense ranks, and its solution is joined
back. A quotient that a level does not shrink by half is solved by pointer doubling.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.runtime import cut, ranked, spread

BLOCK = 4096  #: consecutive places in one block; it changes no result

ROOT, DANGLING, OPEN, CYCLE, BELOW = "root", "dangling", "open", "cycle", "below_cycle"


class Fold(NamedTuple):
    """An associative operation on segments: its type in SQL and Arrow, on lists, and on columns (above, below)."""

    kind: str
    arrow: pa.DataType
    step: Callable[[list, list], list]
    join: Callable[[Column, Column], Column]


PATH = Fold("array<string>", pa.list_(pa.string()), lambda above, own: above + own, F.concat)
NOTHING = Fold("string", pa.string(), lambda above, own: None, lambda above, own: F.lit(None).cast("string"))

_IN = ("scope", "block", "id", "parent", "pos", "weight", "own", "seg")
_LOCAL = ("scope", "block", "id", "parent", "pos", "top", "want", "weight", "state", "own", "total", "seg")


def _blocks(finish: Callable[[list[tuple]], list[tuple]], columns: tuple[str, ...], schema: pa.Schema):
    """Rows arrive sorted by scope and block; ``finish`` gets one block's rows at a time."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        last = None
        for b in batches:
            done: list[tuple] = []
            for r in zip(*[b.column(c).to_pylist() for c in columns]):
                if r[:2] != last:
                    if held:
                        done += finish(held)
                    held, last = [], r[:2]
                held.append(r)
            if done:
                yield _batch(done, schema)
        if held:
            yield _batch(finish(held), schema)

    return run


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), type=f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _peel_up(up: list[int], own: list[int]) -> tuple[list[int], list[bool]]:
    """Subtree sums from the leaves upwards, and which nodes lie on loops (they are never free of children)."""
    total, children = list(own), [0] * len(up)
    for j in up:
        if j >= 0:
            children[j] += 1
    ring = [True] * len(up)
    free = [i for i, n in enumerate(children) if not n]
    for i in free:
        ring[i] = False
        j = up[i]
        if j >= 0:
            total[j] += total[i]
            children[j] -= 1
            if not children[j]:
                free.append(j)
    return total, ring


def _contract(fold: Fold):
    def finish(held: list[tuple]) -> list[tuple]:
        at = {r[2]: i for i, r in enumerate(held)}
        up = [-1 if r[3] is None else at.get(r[3], -1) for r in held]
        below: list[list[int]] = [[] for _ in held]
        for i, j in enumerate(up):
            if j >= 0:
                below[j].append(i)
        n = len(held)
        top, weight, seg = [-1] * n, [0] * n, [None] * n
        free = [i for i in range(n) if up[i] < 0]
        for i in free:
            j, r = up[i], held[i]
            if j < 0:
                top[i], weight[i], seg[i] = i, r[5], r[7]
            else:
                top[i], weight[i], seg[i] = top[j], weight[j] + r[5], fold.step(seg[j], r[7])
            free += below[i]
        total, ring = _peel_up(up, [r[6] for r in held])
        out = []
        for i, r in enumerate(held):
            if top[i] < 0:
                out.append((*r[:5], r[2], None, 0, CYCLE if ring[i] else BELOW, r[6], None if ring[i] else total[i], None))
            else:
                head = held[top[i]]
                out.append((*r[:5], head[2], head[3], weight[i], ROOT if head[3] is None else OPEN, r[6], total[i], seg[i]))
        return out

    kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), fold.arrow]
    return _blocks(finish, _IN, pa.schema(list(zip(_LOCAL, kinds))))


def _refine(held: list[tuple]) -> list[tuple]:
    """Totals with what hangs on the nodes from other blocks, and the nodes on loops through several blocks."""
    at = {r[2]: i for i, r in enumerate(held)}
    up = [-1 if r[3] is None else at.get(r[3], -1) for r in held]
    total, local_ring = _peel_up(up, [r[4] + r[5] for r in held])
    ring = [r[6] for r in held]
    for i in [i for i, on in enumerate(ring) if on]:
        while up[i] >= 0 and not ring[up[i]]:  # from an entry up to the exit
            i = up[i]
            ring[i] = True
    return [(r[0], r[2], None if a or b else t, a) for r, t, a, b in zip(held, total, ring, local_ring)]


_REFINED = pa.schema([("scope", pa.string()), ("id", pa.string()), ("total", pa.int64()), ("ring", pa.bool_())])


def solve(nodes: DataFrame, fold: Fold = NOTHING, sums: bool = False, block: int | None = None, level: int = 0) -> DataFrame:
    """(scope, id, parent, pos, state, root, weight, seg, total) of every node.

    ``nodes``: scope, id, parent STRING, pos BIGINT (unique ids in a scope), weight and own BIGINT, seg of the fold's
    kind. state is ``root``, ``dangling`` (the chain ends at a node whose parent is not in the scope), ``cycle`` or
    ``below_cycle``; weight sums and seg folds the chain from its top to the node, both null on and below loops; total
    sums ``own`` over the node's subtree, null on loops (and on all levels unless ``sums``).
    """
    width = block or BLOCK
    place = F.when(F.col("pos").isNull(), -1 - F.pmod(F.xxhash64("id"), F.lit(4096))).otherwise(F.floor(F.col("pos") / F.lit(width))).cast("long")
    schema = f"scope string, block long, id string, parent string, pos long, top string, want string, weight long, state string, own long, total long, seg {fold.kind}"
    ordered = spread(nodes.withColumn("block", place), "scope", "block").sortWithinPartitions("scope", "block", "pos", "id").select(*_IN)
    local = cut(ordered.mapInArrow(_contract(fold), schema))
    fine = F.col("state").isin(ROOT, DANGLING)
    exits = local.filter((F.col("state") == OPEN) & (F.col("id") == F.col("top"))).select("scope", "id", "pos", "want", F.col("total").alias("own"))
    if exits.isEmpty():
        return local.select("scope", "id", "parent", "pos", "state", F.when(fine, F.col("top")).alias("root"), F.when(fine, F.col("weight")).alias("weight"), F.when(fine, F.col("seg")).alias("seg"), "total")
    above = local.select("scope", F.col("id").alias("want"), F.col("top").alias("up"), F.col("state").alias("up_state"), F.col("weight").alias("up_weight"), F.col("seg").alias("up_seg"))
    linked = cut(exits.join(above, ["scope", "want"], "left"))
    empty = F.lit(None).cast("string") if fold is NOTHING else F.array().cast(fold.kind)
    quotient = linked.select(
        "scope", "id", F.when(F.col("up_state") == OPEN, F.col("up")).alias("parent"), "pos", F.coalesce("up_weight", F.lit(0)).cast("long").alias("weight"), "own", F.coalesce("up_seg", empty).alias("seg"),
    )
    if level and linked.count() * 2 > nodes.count():
        solved = _double(quotient, fold, sums)
    else:
        dense = ranked(quotient, ["scope"], ["pos", "id"], "rank").withColumn("pos", F.col("rank")).drop("rank")
        solved = solve(dense, fold, sums, block, level + 1)
    ends = linked.select("scope", F.col("id").alias("root"), F.when(F.col("up").isNull(), DANGLING).when(F.col("up_state") == ROOT, ROOT).when(F.col("up_state") == OPEN, OPEN).otherwise(BELOW).alias("end"), F.when(F.col("up").isNull(), F.col("id")).otherwise(F.col("up")).alias("real_root"))
    solved = cut(solved.select("scope", "id", "state", "root", "weight", "seg", "total").join(ends, ["scope", "root"], "left").select(
        "scope", F.col("id").alias("top"), F.when(F.col("state") == ROOT, F.col("end")).otherwise(F.col("state")).alias("s"), F.col("real_root").alias("r"), F.col("weight").alias("w"), F.col("seg").alias("g"), F.col("total").alias("t"),
    ))
    out = local.join(solved, ["scope", "top"], "left")
    open_ = F.col("state") == OPEN
    good = F.col("s").isin(ROOT, DANGLING)
    out = out.select(
        "scope", "id", "parent", "pos", "block", "top", "own",
        F.when(open_, F.col("s")).otherwise(F.col("state")).alias("state"),
        F.when(open_, F.when(good, F.col("r"))).when(fine, F.col("top")).alias("root"),
        F.when(open_, F.when(good, F.col("w") + F.col("weight"))).when(fine, F.col("weight")).alias("weight"),
        F.when(open_, F.when(good, fold.join(F.col("g"), F.col("seg")))).when(fine, F.col("seg")).alias("seg"), "total",
    )
    rings = solved.filter(F.col("s") == CYCLE).select("scope", F.col("top").alias("id"), F.lit(True).alias("on_ring"))
    looped = not rings.isEmpty()
    if not (sums or looped):
        return out.select("scope", "id", "parent", "pos", "state", "root", "weight", "seg", "total")
    hang = linked.join(solved.select("scope", F.col("top").alias("id"), "t"), ["scope", "id"]).join(rings, ["scope", "id"], "left").filter("up is not null")
    hang = hang.groupBy("scope", F.col("want").alias("id")).agg(F.coalesce(F.sum("t"), F.lit(0)).alias("hang"), F.max(F.coalesce("on_ring", F.lit(False))).alias("entry"))
    rows = local.join(hang, ["scope", "id"], "left").select("scope", "block", "id", "parent", "own", F.coalesce("hang", F.lit(0)).alias("hang"), F.coalesce("entry", F.lit(False)).alias("entry"))
    marks = spread(rows, "scope", "block").sortWithinPartitions("scope", "block").mapInArrow(_blocks(_refine, ("scope", "block", "id", "parent", "own", "hang", "entry"), _REFINED), "scope string, id string, total long, ring boolean")
    return _marked(out, marks, local)


def _marked(out: DataFrame, marks: DataFrame, local: DataFrame) -> DataFrame:
    """Nodes of fragments on a quotient's loop are on it where marked, else below it."""
    own_ring = local.filter(F.col("state") == CYCLE).select("scope", "id", F.lit(True).alias("own_ring"))
    d = out.drop("total").join(marks, ["scope", "id"]).join(own_ring, ["scope", "id"], "left")
    on = F.col("ring") | F.coalesce("own_ring", F.lit(False))
    return d.select("scope", "id", "parent", "pos", F.when(on, CYCLE).when(F.col("state") == CYCLE, BELOW).otherwise(F.col("state")).alias("state"), "root", "weight", "seg", F.when(~on, F.col("total")).alias("total"))


def _rounds(cur: DataFrame, fold: Fold, sums: bool, n: int) -> DataFrame:
    """Pointer doubling: after k rounds a node has folded the 2^k nodes above and summed those less than 2^k below."""
    for _ in range(max(n, 2).bit_length() + 1):
        if cur.filter("parent is not null").isEmpty():
            break
        up = cur.select("scope", F.col("id").alias("parent"), F.col("parent").alias("p2"), F.col("root").alias("r2"), F.col("weight").alias("w2"), F.col("seg").alias("s2"))
        nxt = cur.join(up, ["scope", "parent"], "left").select(
            "scope", "id", F.col("p2").alias("parent"), F.coalesce("root", "r2").alias("root"), (F.col("weight") + F.coalesce("w2", F.lit(0))).alias("weight"),
            F.when(F.col("parent").isNull(), F.col("seg")).otherwise(fold.join(F.col("s2"), F.col("seg"))).alias("seg"), "total",
        )
        if sums:
            add = cur.filter("parent is not null").groupBy("scope", F.col("parent").alias("id")).agg(F.sum("total").alias("add"))
            nxt = nxt.join(add, ["scope", "id"], "left").withColumn("total", F.col("total") + F.coalesce("add", F.lit(0))).drop("add")
        cur = cut(nxt)
    return cur


def _double(nodes: DataFrame, fold: Fold, sums: bool) -> DataFrame:
    """``solve`` by pointer doubling; loops are found first, so that nothing is folded round and round."""
    n = nodes.count()
    base = nodes.select("scope", "id", "parent", F.when(F.col("parent").isNull(), F.col("id")).alias("root"), "weight", "seg", F.col("own").alias("total"))
    states = _rounds(cut(base.withColumn("seg", F.lit(None).cast("string"))), NOTHING, False, n)
    loose = states.filter("parent is not null")
    ring = loose.select("scope", F.col("parent").alias("id")).distinct().withColumn("ring", F.lit(True))
    marked = cut(loose.select("scope", "id").join(ring, ["scope", "id"], "left"))
    done = _rounds(cut(base.join(marked, ["scope", "id"], "left_anti")), fold, sums, n).withColumn("state", F.lit(ROOT))
    if marked.isEmpty():
        return done
    # below loops: the forest that is left when the loops' nodes lose their parents
    trees = base.join(marked, ["scope", "id"]).withColumn("parent", F.when(F.col("ring").isNull(), F.col("parent"))).withColumn("root", F.when(F.col("parent").isNull(), F.col("id"))).withColumn("seg", F.lit(None).cast("string"))
    below = _rounds(cut(trees.drop("ring")), NOTHING, sums, n).join(marked, ["scope", "id"])
    return done.unionByName(below.select("scope", "id", F.lit(None).cast("string").alias("parent"), F.lit(None).cast("string").alias("root"), F.lit(None).cast("long").alias("weight"), F.lit(None).cast(fold.kind).alias("seg"), F.when(F.col("ring").isNull(), F.col("total")).alias("total"), F.when(F.col("ring"), CYCLE).otherwise(BELOW).alias("state")))
