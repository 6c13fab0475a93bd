"""Typed closure of seeds over evidence edges, for many queries at once.

Each hop joins only the new frontier with the edges, classifies them by one expression, and drops visited nodes with an
anti join; the frontier is written to the shared folder, so plans stay short. Required evidence is expanded to a fixed
point first, then what is optional; nothing below an optional node becomes required.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.contraction import PATH, ROOT, solve
from packetloom.operators.graph import STRONG
from packetloom.runtime import cut

REQUIRED = ("RESULT_OF", "GROUNDED_IN", "DEPENDS_ON", "MATERIALIZES")
WEAK = ("CONTROL", "TEMPORAL")
MODES = ("off", "all", "oracle", "full_ancestor", "native")

# --- fixed values: names of the rules in a closure's steps ---------------------------------------------------------
NATIVE_REQUIRED = "native_required_edge"
TOOL_RESULT = "tool_result_needs_call"
WHY_SOURCES = "why_needs_sources"
STATE_LATEST = "state_prefers_latest"
EXACT_PAYLOAD = "exact_payload_no_carrier_stop"
VERIFIED = "verified_carrier_or_witness"
UNVERIFIED = "unverified_carrier_needs_source"
FULL_ANCESTOR = "full_ancestor_all_strong"
ORACLE = "oracle_gold_dependency"
TRUNCATED = "max_hops_truncated"
CYCLE_GUARD = "cycle_guard"
CAPPED = "carrier_fanout_capped"
RULES = (NATIVE_REQUIRED, TOOL_RESULT, WHY_SOURCES, STATE_LATEST, EXACT_PAYLOAD, VERIFIED, UNVERIFIED, FULL_ANCESTOR, ORACLE, TRUNCATED, CYCLE_GUARD, CAPPED)
# ---------------------------------------------------------------------------------------------------------------------

NODE = ["query_id", "event_id"]
STEP = ["query_id", "child_id", "parent_id", "edge_type", "rule"]


def reach(edges: DataFrame, seeds: DataFrame, max_hops: int = 6) -> DataFrame:
    """(session_id, seed_set, event_id, hop): everything within ``max_hops`` along the edges; first visit wins.

    ``seeds``: session_id, seed_set, event_id. ``edges``: session_id, src_id, dst_id (a source rests on its
    destination).
    """
    frontier = cut(seeds.select("session_id", "seed_set", "event_id").distinct().withColumn("hop", F.lit(0)))
    visited = frontier
    steps = cut(edges.select("session_id", F.col("src_id").alias("event_id"), "dst_id").distinct())
    key = ["session_id", "seed_set", "event_id"]
    for hop in range(1, max_hops + 1):
        nxt = frontier.join(steps, ["session_id", "event_id"]).select("session_id", "seed_set", F.col("dst_id").alias("event_id")).distinct().join(visited, key, "left_anti").withColumn("hop", F.lit(hop))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
    return visited


def native(edges: DataFrame, seeds: DataFrame, max_hops: int = 6) -> DataFrame:
    """``reach`` over the edges that a native closure may require."""
    return reach(edges.filter(F.col("edge_type").isin(*REQUIRED)), seeds, max_hops)


def coverage(reached: DataFrame, wanted: DataFrame) -> DataFrame:
    """(session_id, seed_set, n_wanted, n_reached): how many events of ``wanted`` (session_id, seed_set, event_id) were reached."""
    hit = wanted.select("session_id", "seed_set", "event_id").distinct().join(reached.select("session_id", "seed_set", "event_id", F.lit(1).alias("hit")), ["session_id", "seed_set", "event_id"], "left")
    return hit.groupBy("session_id", "seed_set").agg(F.count("*").alias("n_wanted"), F.count("hit").alias("n_reached"))


def _verified(edges: DataFrame, verifications: DataFrame | None) -> DataFrame:
    """Edges with whether a verification matches carrier, predicate, model, construction and readout of the query."""
    if verifications is None:
        return edges.withColumn("models", F.array().cast("array<struct<model_id:string,readout:string>>"))
    v = verifications.groupBy("session_id", F.col("carrier_id").alias("src_id"), "predicate", F.col("construction").alias("provenance")).agg(F.collect_set(F.struct("model_id", "readout")).alias("models"))
    return edges.join(v, ["session_id", "src_id", "predicate", "provenance"], "left").withColumn("models", F.coalesce("models", F.array().cast("array<struct<model_id:string,readout:string>>")))


def _action(full: bool) -> tuple[Column, Column]:
    """(action, rule) of an edge below a node of a query: required, optional, relaxed, or null to skip it."""
    kind, edge, mode = F.col("child_kind"), F.col("edge_type"), F.col("query_mode")
    if full:
        strong = edge.isin(*STRONG)
        return F.when(strong, "required"), F.when(strong, FULL_ANCESTOR)
    sources = edge.isin("GROUNDED_IN", "DEPENDS_ON")
    decided = sources & (kind == "decision")
    carrier = edge == "MATERIALIZES"
    exact = carrier & (mode == "lookup") & F.col("exact")
    verified = carrier & F.exists("models", lambda m: (m["model_id"] == F.col("model_id")) & (m["readout"] == F.col("readout")))
    action = F.when(edge == "RESULT_OF", "required").when(decided, F.when(mode == "lookup", "optional").otherwise("required")).when(sources | exact, "required").when(verified, "relaxed").when(carrier, "required")
    rule = F.when(edge == "RESULT_OF", F.when(kind == "tool_result", TOOL_RESULT).otherwise(NATIVE_REQUIRED)).when(decided, WHY_SOURCES).when(sources, NATIVE_REQUIRED).when(exact, EXACT_PAYLOAD).when(verified, VERIFIED).when(carrier, UNVERIFIED)
    return action, rule


def newest_of(edges: DataFrame, ev: DataFrame) -> DataFrame:
    """(session_id, event_id, latest_id, losers, cycle) of events with a successor over SUPERSEDES.

    A fork goes on along its newest branch; ``losers`` are all older states and lost branches on the way. A chain
    that runs into itself has no latest state and ``cycle`` is true.
    """
    s = edges.filter("edge_type = 'SUPERSEDES'").select("session_id", F.col("src_id").alias("new"), F.col("dst_id").alias("event_id")).distinct()
    s = s.join(ev.select("session_id", F.col("event_id").alias("new"), F.col("pos").alias("new_pos")), ["session_id", "new"])
    nxt = s.groupBy("session_id", "event_id").agg(F.max(F.struct("new_pos", "new")).alias("n"), F.collect_set("new").alias("all"))
    nxt = cut(nxt.select("session_id", "event_id", F.col("n.new").alias("parent"), F.array_except("all", F.array("n.new")).alias("lost")))
    ids = nxt.select("session_id", "event_id").union(nxt.select("session_id", "parent")).distinct()
    nodes = ids.join(nxt.drop("lost"), ["session_id", "event_id"], "left").join(ev.select("session_id", "event_id", "pos"), ["session_id", "event_id"], "left")
    chains = solve(nodes.select(F.col("session_id").alias("scope"), F.col("event_id").alias("id"), "parent", (-F.col("pos")).alias("pos"), F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("own"), F.array("event_id").alias("seg")), PATH)
    chains = chains.select(F.col("scope").alias("session_id"), F.col("id").alias("event_id"), "root", "seg", (F.col("state") != ROOT).alias("cycle")).join(nxt.select("session_id", "event_id"), ["session_id", "event_id"])
    way = chains.filter("not cycle").select("session_id", "event_id", F.explode("seg").alias("at")).join(nxt.select("session_id", F.col("event_id").alias("at"), "lost"), ["session_id", "at"])
    losers = way.groupBy("session_id", "event_id").agg(F.array_distinct(F.concat(F.collect_set("at"), F.flatten(F.collect_list("lost")))).alias("losers"))
    return chains.join(losers, ["session_id", "event_id"], "left").select("session_id", "event_id", F.when(~F.col("cycle"), F.col("root")).alias("latest_id"), F.coalesce("losers", F.array().cast("array<string>")).alias("losers"), "cycle")


def close(
    queries: DataFrame, seeds: DataFrame, ev: DataFrame, edges: DataFrame, mode: str = "native", max_hops: int = 6, follow_optional: bool = True, carrier_cap: int = 0,
    verifications: DataFrame | None = None, oracle: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(nodes, steps) of all queries.

    ``queries``: query_id, session_id, query, query_mode (lookup, why, state, audit) and, to use verifications,
    model_id and readout. ``seeds``: query_id, event_id. ``ev``: session_id, event_id, pos, kind, text. ``edges`` also
    have provenance. ``verifications``: session_id, carrier_id, predicate, model_id, construction, readout.
    ``oracle``: query_id, event_id that mode ``oracle`` requires.

    nodes: query_id, session_id, event_id, tier (required, optional), hop. steps: query_id, child_id, parent_id,
    edge_type, rule, predicate, wave, hop. Edges beyond ``max_hops`` are recorded as truncated and not followed. Of a carrier with
    more than ``carrier_cap`` sources those nearest to the query's terms are followed; the others become optional.
    A carrier without a match of all five fields of a verification does not free from its source.
    """
    if mode not in MODES:
        raise ValueError(f"unknown closure mode {mode!r}")
    q = queries.select("query_id", "session_id", "query", "query_mode", *[(F.col(c) if c in queries.columns else F.lit(None).cast("string")).alias(c) for c in ("model_id", "readout")])
    q = cut(q.withColumn("exact", T.exact_request(F.coalesce("query", F.lit(""))).isNotNull()))
    start = seeds.select(*NODE).distinct().join(q.select("query_id", "session_id"), "query_id").join(ev.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi").select("query_id", "session_id", "event_id")
    first = start.join(ev.select("session_id", "event_id", "pos"), ["session_id", "event_id"]).groupBy("query_id").agg(F.min_by("event_id", "pos").alias("child_id"))
    none = q.select("query_id", F.lit("").alias("child_id"), F.lit("").alias("parent_id"), F.lit("").alias("edge_type"), F.lit("").alias("rule"), F.lit("").alias("predicate"), F.lit(0).alias("wave"), F.lit(0).alias("hop")).limit(0)
    if mode in ("off", "all", "oracle"):
        more = None if mode == "off" else q.select("query_id", "session_id").join(ev.select("session_id", "event_id"), "session_id").select("query_id", "session_id", "event_id")
        steps = none
        if mode == "oracle":
            more = more.join(oracle.select(*NODE).distinct(), NODE, "left_semi")
            steps = more.join(first, "query_id", "left").select("query_id", F.coalesce("child_id", F.lit("")).alias("child_id"), F.col("event_id").alias("parent_id"), F.lit("ORACLE").alias("edge_type"), F.lit(ORACLE).alias("rule"), F.lit("").alias("predicate"), F.lit(1).alias("wave"), F.lit(0).alias("hop"))
        nodes = start if more is None else start.unionByName(more).distinct()
        return nodes.select("query_id", "session_id", "event_id", F.lit("required").alias("tier"), F.lit(0).alias("hop")), steps

    full = mode == "full_ancestor"
    kinds = ev.select("session_id", F.col("event_id").alias("src_id"), F.col("kind").alias("child_kind"))
    eds = edges.select("session_id", "src_id", "dst_id", "edge_type", F.coalesce("predicate", F.lit("")).alias("predicate"), (F.col("provenance") if "provenance" in edges.columns else F.lit("native")).alias("provenance"))
    eds = cut(_verified(eds.filter(F.col("edge_type").isin(*(STRONG if full else REQUIRED))).distinct(), verifications).join(kinds, ["session_id", "src_id"]))
    action, rule = _action(full)
    steps = none
    demoted = None
    required = start
    if not full:
        state = q.filter("query_mode = 'state'").select("query_id")
        newest = newest_of(edges, ev)
        moved = cut(start.join(state, "query_id", "left_semi").join(newest, ["session_id", "event_id"]))
        if not moved.isEmpty():
            fine = moved.filter("not cycle")
            steps = steps.unionByName(moved.select("query_id", F.col("event_id").alias("child_id"), F.coalesce("latest_id", "event_id").alias("parent_id"), F.lit("SUPERSEDES").alias("edge_type"), F.when(F.col("cycle"), CYCLE_GUARD).otherwise(STATE_LATEST).alias("rule"), F.lit("").alias("predicate"), F.lit(0).alias("wave"), F.lit(0).alias("hop")))
            demoted = cut(fine.select("query_id", "session_id", F.explode("losers").alias("event_id")).distinct())
            promoted = fine.select("query_id", "session_id", F.col("latest_id").alias("event_id"))
            required = start.join(demoted, NODE, "left_anti").unionByName(promoted).distinct()

    def expand(frontier: DataFrame, wave: int) -> DataFrame:
        d = frontier.join(q.drop("session_id"), "query_id").withColumnRenamed("event_id", "src_id").join(eds, ["session_id", "src_id"])
        d = d.withColumn("action", action).withColumn("rule", rule).filter("action is not null")
        if carrier_cap and not full:
            texts = ev.select("session_id", F.col("event_id").alias("dst_id"), F.col("pos").alias("dst_pos"), T.query_terms(F.coalesce("text", F.lit(""))).alias("terms"))
            near = F.size(F.array_intersect(T.query_terms(F.coalesce("query", F.lit(""))), F.coalesce("terms", F.array().cast("array<string>"))))
            w = Window.partitionBy("query_id", "src_id", "edge_type").orderBy(F.desc("near"), "dst_pos", "dst_id")
            d = d.join(texts, ["session_id", "dst_id"], "left").withColumn("near", near).withColumn("place", F.row_number().over(w))
            over = (F.col("edge_type") == "MATERIALIZES") & (F.col("place") > carrier_cap)
            d = d.withColumn("rule", F.when(over, CAPPED).otherwise(F.col("rule"))).withColumn("action", F.when(over, "capped").otherwise(F.col("action")))
        deep = (F.col("hop") >= max_hops) & (F.col("action") != "capped")
        d = d.withColumn("rule", F.when(deep, TRUNCATED).otherwise(F.col("rule"))).withColumn("action", F.when(deep, "truncated").otherwise(F.col("action")))
        return cut(d.select("query_id", "session_id", F.col("src_id").alias("child_id"), F.col("dst_id").alias("parent_id"), "edge_type", "rule", "predicate", F.lit(wave).alias("wave"), "hop", "action"))

    frontier = cut(required.withColumn("hop", F.lit(0)))
    visited, offered = frontier, None
    if demoted is not None:
        offered = demoted.withColumn("hop", F.lit(0))
    relaxed = None
    for hop in range(max_hops + 1):
        got = expand(frontier, 1)
        steps = steps.unionByName(got.select(*none.columns))
        side = got.filter("action in ('optional', 'relaxed', 'capped')").select("query_id", "session_id", F.col("parent_id").alias("event_id"), (F.col("hop") + 1).alias("hop"))
        offered = side if offered is None else offered.unionByName(side)
        stop = got.filter("action = 'relaxed'").select("query_id", "child_id", "predicate", "parent_id")
        relaxed = stop if relaxed is None else relaxed.unionByName(stop)
        nxt = got.filter("action = 'required'").select("query_id", "session_id", F.col("parent_id").alias("event_id")).distinct().join(visited, NODE, "left_anti").withColumn("hop", F.lit(hop + 1))
        frontier = cut(nxt)
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)

    optional = None
    for generation in range(max_hops + 2):
        wave = offered.groupBy("query_id", "session_id", "event_id").agg(F.min("hop").alias("hop")).join(visited, NODE, "left_anti")
        wave = cut(wave if optional is None else wave.join(optional, NODE, "left_anti"))
        if wave.isEmpty():
            break
        optional = wave if optional is None else optional.unionByName(wave)
        if not follow_optional:
            break
        got = expand(wave, 2 + generation)
        steps = steps.unionByName(got.select(*none.columns))
        offered = got.filter("action <> 'truncated'").select("query_id", "session_id", F.col("parent_id").alias("event_id"), (F.col("hop") + 1).alias("hop"))
    need = visited.withColumn("tier", F.lit("required"))
    extra = None if optional is None else optional.withColumn("tier", F.lit("optional"))
    if demoted is not None:
        need = need.join(demoted, NODE, "left_anti")
        old = demoted.withColumn("hop", F.lit(0)).withColumn("tier", F.lit("optional"))
        extra = old if extra is None else extra.join(demoted, NODE, "left_anti").unionByName(old)
    nodes = need if extra is None else need.unionByName(extra.join(need, NODE, "left_anti"))
    return nodes.select("query_id", "session_id", "event_id", "tier", "hop"), steps


def relaxations(nodes: DataFrame, steps: DataFrame) -> DataFrame:
    """(query_id, carrier_id, predicate): carriers that freed from a source which is not required by another way."""
    stops = steps.filter(F.col("rule") == VERIFIED)
    need = nodes.filter("tier = 'required'").select("query_id", F.col("event_id").alias("parent_id"))
    return stops.join(need, ["query_id", "parent_id"], "left_anti").select("query_id", F.col("child_id").alias("carrier_id"), "predicate").distinct()
