"""Contexts woven from steps: what a step rests on in full, the other observations replaced by a placeholder."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.runtime import cut

PARENTS, ANCESTORS, DF_MOST = 3, 5, 8
PLACEHOLDER = "[observation omitted]"
NODE = ["session_id", "idx"]


def scored_pairs(steps: DataFrame, df_most: int = DF_MOST) -> DataFrame:
    """(session_id, idx, parent, score): earlier steps that share rare terms with a step, and how many, at most ten.

    A stand-in for a model's score. Terms of more than ``df_most`` steps of a session prove nothing, so pairs come from an
    equi-join on the others and not from all pairs of steps. ``steps``: session_id, idx, text.
    """
    t = steps.select(*NODE, F.explode(F.array_distinct(T.terms(F.coalesce("text", F.lit(""))))).alias("term"))
    rare = t.groupBy("session_id", "term").agg(F.count("*").alias("df")).filter(F.col("df").between(2, df_most))
    t = cut(t.join(rare.drop("df"), ["session_id", "term"]))
    earlier = t.select("session_id", "term", F.col("idx").alias("parent"))
    return t.join(earlier, ["session_id", "term"]).filter("parent < idx").groupBy(*NODE, "parent").agg(F.least(F.count("*"), F.lit(10)).alias("score"))


def parents(scores: DataFrame, steps: DataFrame, m: int = PARENTS) -> DataFrame:
    """(session_id, idx, parent, rank): the m best-scored earlier steps that neither failed nor were superseded, ties by the
    later one. ``scores``: session_id, idx, parent, score (any scorer's); ``steps``: session_id, idx, validation."""
    able = steps.filter(~F.coalesce("validation", F.lit("unknown")).isin("failed", "superseded")).select("session_id", F.col("idx").alias("parent"))
    w = Window.partitionBy(*NODE).orderBy(F.desc("score"), F.desc("parent"))
    best = scores.filter("score > 0 and parent < idx").join(able, ["session_id", "parent"], "left_semi").withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= m)
    return best.select(*NODE, "parent", F.col("rank").cast("int").alias("rank"))


def ancestry(links: DataFrame, anchors: DataFrame, most: int = ANCESTORS) -> DataFrame:
    """(session_id, anchor, idx, place): up to ``most`` steps, the anchor first, then breadth first along parents.

    ``links``: session_id, idx, parent, rank; ``anchors``: session_id, anchor. As no more than ``most`` steps are kept, at most
    that many rounds are needed.
    """
    known = cut(anchors.select("session_id", "anchor", F.col("anchor").alias("idx"), F.lit(0).alias("place")))
    fresh = known
    for _ in range(most - 1):
        nxt = fresh.join(links, NODE).select("session_id", "anchor", F.col("parent").alias("idx"), "place", "rank").join(known.select("session_id", "anchor", "idx"), ["session_id", "anchor", "idx"], "left_anti")
        nxt = nxt.groupBy("session_id", "anchor", "idx").agg(F.min(F.struct("place", "rank")).alias("o"))
        have = known.groupBy("session_id", "anchor").agg(F.count("*").alias("n"))
        nxt = nxt.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "anchor").orderBy("o"))).join(have, ["session_id", "anchor"]).filter(F.col("n") + F.col("r") <= most)
        fresh = cut(nxt.select("session_id", "anchor", "idx", (F.col("n") + F.col("r") - 1).cast("int").alias("place")))
        if fresh.isEmpty():
            break
        known = cut(known.unionByName(fresh))
    return known


def woven(steps: DataFrame, kept: DataFrame, warm: int = ANCESTORS) -> DataFrame:
    """(session_id, context, n_full): every step with its action; observations in full for the steps of ``kept``
    (session_id, idx) and for sessions of up to ``warm`` steps, else a placeholder. ``steps``: session_id, idx, validation,
    action, observation."""
    n = steps.groupBy("session_id").agg(F.count("*").alias("n"))
    d = steps.join(kept.select(*NODE, F.lit(True).alias("full")).distinct(), NODE, "left").join(n, "session_id")
    full = F.coalesce("full", F.lit(False)) | (F.col("n") <= warm)
    head = F.concat(F.lit("step "), F.col("idx").cast("string"), F.lit(" | "), F.coalesce("validation", F.lit("unknown")), F.lit("\naction: "), F.coalesce("action", F.lit("")))
    part = F.concat(head, F.lit("\nobservation: "), F.when(full, F.coalesce("observation", F.lit(""))).otherwise(PLACEHOLDER))
    g = d.groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("idx", part.alias("p")))).alias("x"), F.count_if(full).alias("n_full"))
    return g.select("session_id", F.array_join(F.transform("x", lambda v: v["p"]), "\n\n").alias("context"), "n_full")


def engaged(steps: DataFrame, events: DataFrame, least: int = 20) -> DataFrame:
    """Steps, unless a session of ``least`` or more calls and events gave none at all: then the reading is broken and raises."""
    n = events.groupBy("session_id").agg(F.count("*").alias("n"), F.count_if(F.col("kind") == "tool_call").alias("calls")).filter((F.col("n") >= least) & (F.col("calls") >= least))
    lost = n.join(steps.select("session_id").distinct(), "session_id", "left_anti").limit(1).collect()
    if lost:
        raise ValueError(f"no steps were read from session {lost[0]['session_id']} of {lost[0]['n']} events")
    return steps
