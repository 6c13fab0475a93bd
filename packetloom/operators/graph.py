"""Lookups, checks and views of event graphs. Events: session_id, event_id, pos, kind, ...; edges: ``events.EDGE``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.events import EDGE, result_of
from packetloom.operators.hierarchy import resolve_hierarchy
from packetloom.runtime import cut, filled

EDGE_TYPES = ("RESULT_OF", "GROUNDED_IN", "DEPENDS_ON", "MATERIALIZES", "SUPERSEDES", "CONTROL", "TEMPORAL")
STRONG = ("RESULT_OF", "GROUNDED_IN", "DEPENDS_ON", "MATERIALIZES", "SUPERSEDES")
KEY = ["session_id", "event_id"]


def distinct_edges(edges: DataFrame) -> DataFrame:
    """Every edge once by (source, target, type, predicate); any null predicate is its own value."""
    return edges.select(*EDGE).distinct()


def parents(edges: DataFrame, *types: str) -> DataFrame:
    """(session_id, event_id, parents): what each event rests on, by type, target and predicate; ``types`` narrows it."""
    e = edges.filter(F.col("edge_type").isin(*types)) if types else edges
    return e.groupBy("session_id", F.col("src_id").alias("event_id")).agg(F.sort_array(F.collect_set(F.struct("edge_type", "dst_id", "predicate"))).alias("parents"))


def children(edges: DataFrame, *types: str) -> DataFrame:
    """(session_id, event_id, children): what rests on each event."""
    e = edges.filter(F.col("edge_type").isin(*types)) if types else edges
    return e.groupBy("session_id", F.col("dst_id").alias("event_id")).agg(F.sort_array(F.collect_set(F.struct("edge_type", "src_id", "predicate"))).alias("children"))


def grouped(ev: DataFrame, column: str) -> DataFrame:
    """(session_id, key, n, first_id, last_id) of the events that share a step, a call or an atomic group."""
    at = F.struct("pos", "event_id")
    g = ev.filter(F.col(column).isNotNull()).groupBy("session_id", F.col(column).alias("key")).agg(F.count("*").alias("n"), F.min(at).alias("a"), F.max(at).alias("b"))
    return g.select("session_id", "key", "n", F.col("a.event_id").alias("first_id"), F.col("b.event_id").alias("last_id"))


def superseded(edges: DataFrame) -> DataFrame:
    return edges.filter("edge_type = 'SUPERSEDES'").select("session_id", F.col("dst_id").alias("event_id")).distinct()


def latest_state(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, event_id, latest_id, on_cycle) of every event with a successor: the newest end of its chains.

    ``latest_id`` is the newest event that nothing supersedes among those reached backwards over SUPERSEDES; it is null,
    and ``on_cycle`` true, where the chain runs into itself. A later event supersedes one earlier event.
    """
    s = edges.filter("edge_type = 'SUPERSEDES'").select("session_id", "src_id", "dst_id").distinct()
    ids = s.select("session_id", F.col("src_id").alias("event_id")).union(s.select("session_id", "dst_id")).distinct()
    older = s.groupBy("session_id", F.col("src_id").alias("event_id")).agg(F.min("dst_id").alias("parent"))
    nodes = ids.join(older, KEY, "left").join(ev.select(*KEY, "pos"), KEY, "left")
    tree = resolve_hierarchy(nodes.select(F.col("session_id").alias("scope"), F.col("event_id").alias("id"), "parent", "pos"))
    old = s.select("session_id", F.col("dst_id").alias("event_id")).distinct()
    ends = tree.filter("path is not null").select(F.col("scope").alias("session_id"), F.col("id").alias("event_id"), "path", "pos").join(old, KEY, "left_anti")
    newest = ends.select("session_id", F.col("event_id").alias("latest"), "pos", F.explode("path").alias("event_id")).groupBy(*KEY).agg(F.max_by("latest", F.struct("pos", "latest")).alias("latest_id"))
    loops = tree.filter("path is null").select(F.col("scope").alias("session_id"), F.col("id").alias("event_id"), F.lit(True).alias("on_cycle"))
    return old.join(newest, KEY, "left").join(loops, KEY, "left").select(*KEY, "latest_id", F.coalesce("on_cycle", F.lit(False)).alias("on_cycle"))


def chronological(ev: DataFrame, ids: DataFrame) -> DataFrame:
    """``ids`` (session_id, event_id) once each with their place; ids that are no events are left out."""
    return ids.select(*KEY).distinct().join(ev.select(*KEY, "pos"), KEY)


def strong(edges: DataFrame) -> DataFrame:
    return edges.filter(F.col("edge_type").isin(*STRONG))


def restrict(ev: DataFrame, edges: DataFrame, drop: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The graph without the events of ``drop`` (session_id, event_id) and the edges that touch them."""
    gone = drop.select(*KEY).distinct()
    e = edges.join(gone.withColumnRenamed("event_id", "src_id"), ["session_id", "src_id"], "left_anti").join(gone.withColumnRenamed("event_id", "dst_id"), ["session_id", "dst_id"], "left_anti")
    return ev.join(gone, KEY, "left_anti"), e


def problems(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, event_id, problem): ``duplicate`` ids, ``no source`` and ``no target`` of edges, ``self`` edges."""
    ids = ev.groupBy(*KEY).agg(F.count("*").alias("n"))
    end = lambda c: edges.select("session_id", F.col(c).alias("event_id")).distinct().join(ids, KEY, "left_anti")
    parts = [(ids.filter("n > 1"), "duplicate"), (end("src_id"), "no source"), (end("dst_id"), "no target"), (edges.filter("src_id = dst_id").select("session_id", F.col("src_id").alias("event_id")).distinct(), "self")]
    out = None
    for d, name in parts:
        d = d.select(*KEY, F.lit(name).alias("problem"))
        out = d if out is None else out.unionByName(d)
    return out


def check(ev: DataFrame, edges: DataFrame) -> None:
    """Raises where the graph has problems, naming one."""
    bad = problems(ev, edges).limit(1).collect()
    if bad:
        raise ValueError(f"{bad[0]['problem']}: {bad[0]['session_id']} {bad[0]['event_id']}")


def type_counts(edges: DataFrame) -> DataFrame:
    """Edges of a session by type; all seven types have a column."""
    return edges.groupBy("session_id").agg(*[F.count_if(F.col("edge_type") == t).alias(f"n_{t.lower()}") for t in EDGE_TYPES])


def distances(ev: DataFrame, of: Column, to: Column) -> DataFrame:
    """(session_id, event_id, distance) of the events ``of``: places to the nearest event ``to`` on either side."""
    at = ev.select(*KEY, "pos", of.alias("of"), F.when(to, F.col("pos")).alias("mark"))
    both = filled(filled(at, "mark", "before"), "mark", "behind", back=True).filter("of")
    return both.select(*KEY, F.least(F.col("pos") - F.col("before"), F.col("behind") - F.col("pos")).alias("distance")).filter("distance is not null")


def carriers(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """Events that stand for others: sources of MATERIALIZES, summaries and decisions."""
    return edges.filter("edge_type = 'MATERIALIZES'").select("session_id", F.col("src_id").alias("event_id")).union(ev.filter("kind in ('summary', 'decision')").select(*KEY)).distinct()


def capped_fan_out(edges: DataFrame, cap: int = 32) -> DataFrame:
    """The edges without MATERIALIZES of sources that have more than ``cap`` of them."""
    wide = edges.filter("edge_type = 'MATERIALIZES'").groupBy("session_id", "src_id").count().filter(F.col("count") > cap).select("session_id", "src_id", F.lit(True).alias("wide"))
    return edges.join(wide, ["session_id", "src_id"], "left").filter("edge_type <> 'MATERIALIZES' or wide is null").drop("wide")


def shuffled_edges(ev: DataFrame, edges: DataFrame, salt: str = "random") -> DataFrame:
    """As many edges with the same sources and distances, dealt anew within a session by hashes; ends before the first
    event are left out. For comparing a policy with chance."""
    pos = ev.select("session_id", "event_id", "pos")
    e = edges.select("session_id", "src_id", "dst_id").distinct().join(pos.withColumnRenamed("event_id", "src_id").withColumnRenamed("pos", "src_pos"), ["session_id", "src_id"]).join(pos.withColumnRenamed("event_id", "dst_id").withColumnRenamed("pos", "dst_pos"), ["session_id", "dst_id"])
    order = lambda *c: F.row_number().over(Window.partitionBy("session_id").orderBy(F.md5(F.concat_ws("|", F.lit(salt), *c)), "src_id", "dst_id"))
    a = e.select("session_id", "src_id", "src_pos", order("src_id", "dst_id").alias("k"))
    b = e.select("session_id", (F.col("src_pos") - F.col("dst_pos")).alias("d"), order("dst_id", "src_id").alias("k"))
    return a.join(b, ["session_id", "k"]).select("session_id", "src_id", (F.col("src_pos") - F.col("d")).alias("pos")).join(pos.withColumnRenamed("event_id", "dst_id"), ["session_id", "pos"]).select("session_id", "src_id", "dst_id").distinct()


def windows(ev: DataFrame, width: int = 128, stride: int = 64) -> DataFrame:
    """Events with the overlapping windows of ``width`` places, every ``stride`` places, that hold them."""
    first = F.greatest(F.lit(0), F.ceil((F.col("pos") - width + 1) / F.lit(stride))).cast("long")
    return ev.withColumn("window_no", F.explode(F.sequence(first, F.floor(F.col("pos") / stride).cast("long"))))


def parsed_edges(replies: DataFrame, ev: DataFrame) -> DataFrame:
    """Edges of a model's reply lines ``CHILD <- PARENT | why``: both must be events of the session, the parent earlier."""
    line = F.explode(F.split("reply", "\n")).alias("line")
    m = lambda k: F.regexp_extract("line", r"^\s*(\S+)\s*<-\s*(\S+)\s*(?:\|\s*(.*?)\s*)?$", k)
    e = replies.select("session_id", line).select("session_id", m(1).alias("src_id"), m(2).alias("dst_id"), F.nullif(m(3), F.lit("")).alias("predicate")).filter("src_id <> ''")
    pos = ev.select("session_id", "event_id", "pos")
    e = e.join(pos.toDF("session_id", "src_id", "a"), ["session_id", "src_id"]).join(pos.toDF("session_id", "dst_id", "b"), ["session_id", "dst_id"]).filter("b < a")
    return e.groupBy("session_id", "src_id", "dst_id").agg(F.min("predicate").alias("predicate"))


def chain_depth(seeds: DataFrame, edges: DataFrame, most: int = 8) -> DataFrame:
    """(session_id, depth): most value edges on a shortest way down from a session's seeds; the step from an output to its
    call costs nothing. Depths end at ``most``."""
    links = edges.filter("edge_type in ('DEPENDS_ON', 'RESULT_OF')").select("session_id", F.col("src_id").alias("event_id"), "dst_id", F.when(F.col("edge_type") == "DEPENDS_ON", 1).otherwise(0).alias("cost")).distinct()
    known = cut(seeds.select(*KEY).distinct().withColumn("depth", F.lit(0)))
    fresh = known
    for _ in range(2 * most + 1):
        step = fresh.join(links, KEY).select("session_id", F.col("dst_id").alias("event_id"), (F.col("depth") + F.col("cost")).alias("got")).filter(F.col("got") <= most).groupBy(*KEY).agg(F.min("got").alias("got"))
        fresh = cut(step.join(known, KEY, "left").filter("depth is null or got < depth").select(*KEY, F.col("got").alias("depth")))
        if fresh.isEmpty():
            break
        known = cut(known.join(fresh.select(*KEY), KEY, "left_anti").unionByName(fresh))
    return known.groupBy("session_id").agg(F.max("depth").alias("depth"))


# --- what is in a session's context ----------------------------------------------------------------------------


def noise(ev: DataFrame) -> Column:
    return T.is_noise(F.col("kind"), F.col("text"), F.try_element_at("meta", F.lit("is_meta")))


def in_context(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """Events from the last summary of their session on, and those of its window that it lists as not replaced (if it
    replaces any); all where there is no summary."""
    cuts = ev.filter("kind = 'summary'").groupBy("session_id").agg(F.max(F.struct("pos", "event_id")).alias("s"), F.sort_array(F.collect_set("pos"), asc=False).alias("p"))
    cuts = cuts.select("session_id", F.col("s.pos").alias("last"), F.col("s.event_id").alias("src_id"), F.coalesce(F.get("p", F.lit(1)), F.lit(-1)).alias("previous"))
    replaced = edges.filter("edge_type = 'MATERIALIZES'").join(cuts.select("session_id", "src_id"), ["session_id", "src_id"]).select("session_id", F.col("dst_id").alias("event_id"), F.lit(True).alias("replaced")).distinct()
    some = replaced.select("session_id", F.lit(True).alias("lists")).distinct()
    d = ev.join(cuts.drop("src_id"), "session_id", "left").join(replaced, KEY, "left").join(some, "session_id", "left")
    kept = F.col("last").isNull() | (F.col("pos") >= F.col("last")) | (F.coalesce("lists", F.lit(False)) & (F.col("pos") > F.col("previous")) & F.col("replaced").isNull())
    return d.filter(kept).drop("last", "previous", "replaced", "lists")


def searchable(ev: DataFrame, edges: DataFrame, include_recent: bool = False) -> DataFrame:
    """Events that may be recalled: no noise, not in context, and not with a text (20 or more characters) that is."""
    work = ev.filter(~noise(ev))
    if include_recent:
        return work
    live = in_context(ev, edges)
    norm = F.btrim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    seen = live.select("session_id", norm.alias("norm")).filter(F.length("norm") >= 20).distinct()
    return work.join(live.select(*KEY), KEY, "left_anti").withColumn("norm", norm).join(seen, ["session_id", "norm"], "left_anti").drop("norm")


def in_context_with_query(ev: DataFrame, queries: DataFrame) -> DataFrame:
    """Events from the last summary on, and users' messages that equal the session's query but for white space.

    ``queries``: session_id, query.
    """
    last = ev.filter("kind = 'summary'").groupBy("session_id").agg(F.max("pos").alias("last"))
    same = T.normalised(F.coalesce("text", F.lit(""))) == T.normalised(F.coalesce("query", F.lit("")))
    d = ev.join(last, "session_id", "left").join(queries.select("session_id", "query"), "session_id", "left")
    return d.filter(F.col("last").isNull() | (F.col("pos") >= F.col("last")) | F.coalesce((F.col("kind") == "user") & same, F.lit(False))).drop("last", "query")


def trailing_reply(ev: DataFrame) -> DataFrame:
    """The assistant's events at the end of a session behind its last other event, noise aside."""
    work = ev.filter(~noise(ev))
    stop = work.filter("kind <> 'assistant'").groupBy("session_id").agg(F.max("pos").alias("stop"))
    return work.filter("kind = 'assistant'").join(stop, "session_id", "left").filter("stop is null or pos > stop").drop("stop")


def tool_records(ev: DataFrame) -> DataFrame:
    return ev.filter("kind in ('tool_call', 'tool_result')")


def changed_later(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """Events with whether a later one supersedes them."""
    return ev.join(superseded(edges).withColumn("changed", F.lit(True)), KEY, "left").withColumn("changed", F.coalesce("changed", F.lit(False)))


def status(ev: DataFrame, edges: DataFrame) -> DataFrame:
    """(session_id, n_events, compactions, recallable, tool_records) of every session."""
    base = ev.groupBy("session_id").agg(F.count("*").alias("n_events"), F.count_if(F.col("kind") == "summary").alias("compactions"), F.count_if(F.col("kind").isin("tool_call", "tool_result")).alias("tool_records"))
    n = searchable(ev, edges).groupBy("session_id").agg(F.count("*").alias("n"))
    return base.join(n, "session_id", "left").select("session_id", "n_events", "compactions", F.when(F.col("compactions") > 0, F.coalesce("n", F.lit(0))).otherwise(0).alias("recallable"), "tool_records")


def with_tools(ev: DataFrame) -> DataFrame:
    """Events with ``tool``: that of their meta, or of the call that a result answers."""
    own = F.nullif(F.try_element_at("meta", F.lit("tool")), F.lit(""))
    calls = ev.select("session_id", F.col("event_id").alias("dst_id"), own.alias("call_tool")).filter("call_tool is not null")
    inherited = result_of(ev).join(calls, ["session_id", "dst_id"]).groupBy("session_id", F.col("src_id").alias("event_id")).agg(F.min("call_tool").alias("call_tool"))
    return ev.join(inherited, KEY, "left").withColumn("tool", F.coalesce(own, F.when(F.col("kind") == "tool_result", F.col("call_tool")))).drop("call_tool")


def paired_seeds(seeds: DataFrame, results: DataFrame) -> DataFrame:
    """Seeds with the output of every seed call and the call of every seed output added; a seed stands once, its best rank."""
    e = results.select("session_id", "src_id", "dst_id")
    more = seeds.join(e.withColumnRenamed("dst_id", "event_id"), KEY).select("session_id", F.col("src_id").alias("event_id"), "rank").unionByName(seeds.join(e.withColumnRenamed("src_id", "event_id"), KEY).select("session_id", F.col("dst_id").alias("event_id"), "rank"))
    return seeds.select(*KEY, "rank").unionByName(more).groupBy(*KEY).agg(F.min("rank").alias("rank"))
