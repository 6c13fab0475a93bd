"""Parent-child links to full hierarchies by fragment contraction.

The parent chains of blocks of rows are contracted to fragment exits, the smaller quotient forest is solved recursively
and the fragments' paths are expanded (``contraction.solve``). Loops inside a block and through several blocks are found
on the way. Subtrees are counted by sums upwards over fragments, and descendants are given as preorder intervals,
so no pair of an ancestor and a descendant needs to be listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.operators.contraction import BELOW, CYCLE, DANGLING, NOTHING, PATH, ROOT, solve
from packetloom.runtime import cut, prefix_sums

ORPHAN, UNDER_ORPHAN = "orphan", "under_orphan"


def first_links(nodes: DataFrame) -> DataFrame:
    """(scope, id, parent, pos) with unique ids: of several rows of an id the one with the least (pos, parent)."""
    src = nodes.select(F.col("scope").cast("string").alias("scope"), F.col("id").cast("string").alias("id"), F.col("parent").cast("string").alias("parent"), F.col("pos").cast("long").alias("pos")).filter("scope is not null and id is not null")
    return src.groupBy("scope", "id").agg(F.min(F.struct(F.coalesce("pos", F.lit(0)).alias("at"), "parent", "pos")).alias("v")).select("scope", "id", "v.parent", "v.pos")


def resolve_hierarchy(nodes: DataFrame, paths: bool = True, block: int | None = None, sums: bool = False) -> DataFrame:
    """Every node with the state of its chain, its depth, root and path.

    ``nodes``: scope STRING, id STRING, parent STRING, pos BIGINT; extra columns are ignored. Ids are unique
    within a scope after repeats; of several rows of an id the one with the least (pos, parent) counts. Rows with
    a null scope or id are left out; nodes with a null pos count as first and are spread by their ids.

    Result: scope, id, parent, state, depth, root, path, total. state is ``root`` (the chain ends at a node without
    parent), ``orphan`` (the node's own parent is not in the scope), ``under_orphan`` (an ancestor is such a
    node), ``cycle`` (the node is its own ancestor) or ``below_cycle``. depth counts from the chain's top; depth,
    root and path are null on and below loops; root of an orphan's tree is the orphan. total, with ``sums``, counts the
    node and all below it, null on loops. An empty table gives none.
    """
    links = first_links(nodes).withColumns({"weight": F.lit(1).cast("long"), "own": F.lit(1).cast("long"), "seg": F.array("id") if paths else F.lit(None).cast("string")})
    got = solve(links, PATH if paths else NOTHING, sums, block)
    dangling = F.when(F.col("weight") == 1, ORPHAN).otherwise(UNDER_ORPHAN)
    return got.select(
        "scope", "id", "parent", F.when(F.col("state") == DANGLING, dangling).otherwise(F.col("state")).alias("state"), (F.col("weight") - 1).alias("depth"), "root",
        (F.col("seg") if paths else F.lit(None).cast("array<string>")).alias("path"), F.col("total") if sums else F.lit(None).cast("long").alias("total"), "pos",
    )


def preorder(tree: DataFrame, block: int | None = None) -> DataFrame:
    """(scope, id, first, last): places in the preorder of the node's tree; its descendants are those of the same root
    with a place above ``first`` up to ``last``. ``tree``: a result with sums; nodes on and below loops are left out.
    """
    fine = tree.filter(~F.col("state").isin(CYCLE, BELOW))
    up = F.when(F.col("depth") > 0, F.col("parent"))
    ahead = prefix_sums(fine.select("scope", "id", F.coalesce(up, F.lit("")).alias("over"), up.alias("parent"), F.coalesce("pos", F.lit(0)).alias("pos"), "total", (F.col("depth") == 0).alias("top")), ["scope", "over"], ["pos", "id"], "total", "ahead")
    links = ahead.select("scope", "id", "parent", "pos", F.when(F.col("top"), F.lit(0)).otherwise(F.col("ahead") + 1).cast("long").alias("weight"), F.lit(1).cast("long").alias("own"), F.lit(None).cast("string").alias("seg"))
    at = solve(links, NOTHING, False, block).select("scope", "id", F.col("weight").alias("first"))
    return at.join(fine.select("scope", "id", "total"), ["scope", "id"]).select("scope", "id", "first", (F.col("first") + F.col("total") - 1).alias("last"))


def descendants(tree: DataFrame) -> DataFrame:
    """All (ancestor, descendant, distance) pairs of a result with paths, for nodes neither on nor below loops
    (``loop_descendants`` has the others)."""
    return tree.filter("path is not null").select("scope", F.col("id").alias("descendant"), "depth", F.posexplode("path").alias("at", "ancestor")).filter(F.col("at") < F.col("depth")).select("scope", "ancestor", "descendant", (F.col("depth") - F.col("at")).alias("distance"))


def ring_ids(tree: DataFrame) -> DataFrame:
    """(scope, id, ring) of the nodes on loops: the least id of the loop, by doubling along parents."""
    cur = cut(tree.filter(F.col("state") == CYCLE).select("scope", "id", F.col("parent").alias("to"), F.col("id").alias("ring")))
    while not cur.isEmpty():
        ahead = cur.select("scope", F.col("id").alias("to"), F.col("to").alias("to2"), F.col("ring").alias("ring2"))
        nxt = cut(cur.join(ahead, ["scope", "to"]).select("scope", "id", F.col("to2").alias("to"), F.least("ring", "ring2").alias("ring"), (F.col("ring2") < F.col("ring")).alias("moved")))
        if nxt.filter("moved").isEmpty():  # nothing ahead is less anywhere, so the stretches seen cover their loops
            break
        cur = nxt.drop("moved")
    return cur.select("scope", "id", "ring")


def loop_trees(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """The nodes on and below loops as forests rooted in the loops' nodes; columns as of ``resolve_hierarchy``.

    ``tree`` is the result for ``nodes``.
    """
    loose = tree.filter(F.col("state").isin(CYCLE, BELOW)).select("scope", "id", F.col("state").alias("loop_state"))
    own = first_links(nodes).join(loose, ["scope", "id"])
    return resolve_hierarchy(own.withColumn("parent", F.when(F.col("loop_state") == BELOW, F.col("parent"))))


def loop_descendants(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """The pairs that ``descendants`` leaves out: below loops, and from a loop's node to all others that it reaches.

    A loop's node is not counted as its own descendant.
    """
    forest = cut(loop_trees(nodes, tree))
    ring = ring_ids(tree)
    heads = ring.filter("id = ring").select("scope", "id", F.lit(True).alias("head"))
    # each loop is cut at its least node; the depth below it gives the way from one of its nodes to another
    loops = first_links(nodes).join(ring, ["scope", "id"]).join(heads, ["scope", "id"], "left")
    at = resolve_hierarchy(loops.withColumn("parent", F.when(F.col("head").isNull(), F.col("parent"))), paths=False).select("scope", "id", "depth")
    at = cut(at.join(ring, ["scope", "id"]))
    n = at.groupBy("scope", "ring").agg(F.count("*").alias("n"))
    low = at.select("scope", "ring", F.col("id").alias("root"), F.col("depth").alias("low"))
    ways = at.join(low, ["scope", "ring"]).join(n, ["scope", "ring"]).filter("id <> root").select("scope", "root", F.col("id").alias("ancestor"), F.pmod(F.col("low") - F.col("depth"), F.col("n")).alias("way"))
    around = forest.select("scope", "root", F.col("id").alias("descendant"), "depth").join(ways, ["scope", "root"])
    return descendants(forest).unionByName(around.select("scope", "ancestor", "descendant", (F.col("way") + F.col("depth")).alias("distance")))


def loop_counts(nodes: DataFrame, tree: DataFrame) -> DataFrame:
    """(scope, id, n): number of other nodes that a node on or below a loop reaches, without listing pairs."""
    loose = tree.filter(F.col("state").isin(CYCLE, BELOW)).select("scope", "id", F.col("state").alias("loop_state"))
    own = first_links(nodes).join(loose, ["scope", "id"])
    forest = cut(resolve_hierarchy(own.withColumn("parent", F.when(F.col("loop_state") == BELOW, F.col("parent"))), paths=False, sums=True).select("scope", "id", "total"))
    ring = ring_ids(tree)
    below = forest.join(ring, ["scope", "id"], "left_anti").select("scope", "id", (F.col("total") - 1).alias("n")).filter("n > 0")
    sizes = forest.join(ring, ["scope", "id"]).groupBy("scope", "ring").agg((F.sum("total") - 1).alias("n"))
    return below.unionByName(ring.join(sizes, ["scope", "ring"]).select("scope", "id", "n"))
