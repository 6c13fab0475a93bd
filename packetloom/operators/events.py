"""Recorded events as a typed graph: canonical order, edges, lookups and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.contraction import ROOT, solve
from packetloom.runtime import filled, first_rows

HOUR = 3_600_000
EDGE = ["session_id", "src_id", "dst_id", "edge_type", "predicate"]


def placed(one: DataFrame, order: list[str], width: int = HOUR) -> DataFrame:
    """Events with their place ``pos`` in the session by (ts, ...); the first column of ``order`` is a number.

    Places come from prefix counts over spans of ``width``, so no session is numbered in one task.
    """
    slot = F.floor(F.col(order[0]) / width)
    sizes = one.groupBy("session_id", slot.alias("slot")).agg(F.count("*").alias("n"))
    base = sizes.select("session_id", "slot", (F.sum("n").over(Window.partitionBy("session_id").orderBy("slot")) - F.col("n")).alias("base"))
    local = one.withColumn("slot", slot).withColumn("local", F.row_number().over(Window.partitionBy("session_id", "slot").orderBy(*order)) - 1)
    return local.join(base, ["session_id", "slot"]).withColumn("pos", F.col("base") + F.col("local")).drop("slot", "base", "local")


def canonical(events: DataFrame) -> DataFrame:
    """Events merged by key with their place in the canonical order (ts, event_id) of the session; a null ts counts as 0."""
    return placed(first_rows(events, ["session_id", "event_id"]).withColumn("ts", F.coalesce("ts", F.lit(0))), ["ts", "event_id"])


def _edge(df: DataFrame, src: str, dst: str, kind: str, predicate=None) -> DataFrame:
    return df.select("session_id", F.col(src).alias("src_id"), F.col(dst).alias("dst_id"), F.lit(kind).alias("edge_type"), (predicate if predicate is not None else F.lit(None).cast("string")).alias("predicate"))


def result_of(ev: DataFrame) -> DataFrame:
    """Tool result -> first earlier call with its id; results without one give no edge."""
    calls = ev.filter("kind = 'tool_call' and tool_call_id is not null").groupBy("session_id", "tool_call_id").agg(F.min(F.struct("pos", "event_id")).alias("c"))
    res = ev.filter("kind = 'tool_result' and tool_call_id is not null")
    return _edge(res.join(calls, ["session_id", "tool_call_id"]).filter(F.col("c.pos") < F.col("pos")).withColumn("dst", F.col("c.event_id")), "event_id", "dst", "RESULT_OF")


def temporal(ev: DataFrame) -> DataFrame:
    """Event -> the one before it."""
    prev = ev.select("session_id", (F.col("pos") + 1).alias("pos"), F.col("event_id").alias("prev"))
    return _edge(ev.join(prev, ["session_id", "pos"]), "event_id", "prev", "TEMPORAL")


def written_path(c):
    """Path that a writing call names, else null."""
    return F.when(F.regexp_like(c, F.lit(r"^(?:Edit|MultiEdit|Write|NotebookEdit) ")), F.nullif(F.regexp_extract(c, r"\"file_path\": \"([^\"]+)\"", 1), F.lit("")))


def superseding(writes: DataFrame, path: str) -> DataFrame:
    """Write -> the write before it to the same path (session_id, event_id, pos and the path's column)."""
    prev = F.lag("event_id").over(Window.partitionBy("session_id", path).orderBy("pos"))
    return _edge(writes.filter(F.col(path).isNotNull()).withColumn("prev", prev).filter("prev is not null"), "event_id", "prev", "SUPERSEDES", F.col(path))


def supersedes(ev: DataFrame) -> DataFrame:
    """Writing call -> the previous writing call to the same path."""
    return superseding(ev.filter("kind = 'tool_call'").withColumn("path", written_path(F.col("text"))), "path")


def nearest_earlier(ev: DataFrame, key: str, consumer, source) -> DataFrame:
    """Consumer -> the nearest earlier source with the same key (an as-of match by the last source so far)."""
    w = Window.partitionBy("session_id", key).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    d = ev.filter(F.col(key).isNotNull()).withColumn("src", F.last(F.when(source, F.col("event_id")), ignorenulls=True).over(w))
    return _edge(d.filter(consumer & F.col("src").isNotNull()), "event_id", "src", "DEPENDS_ON", F.col(key))


def materializes(ev: DataFrame) -> DataFrame:
    """Summary -> every event since the previous summary: each event has the next summary behind it."""
    mark = ev.select("session_id", "event_id", "pos", "kind", F.when(F.col("kind") == "summary", F.col("event_id")).alias("mark"))
    return _edge(filled(mark, "mark", "summary", back=True).filter("kind <> 'summary' and summary is not null"), "summary", "event_id", "MATERIALIZES", F.lit("summary"))


def native_materializes(rows: DataFrame, ev: DataFrame, max_gap: int = 3) -> DataFrame:
    """Summary of a transcript -> the events that its compaction replaced.

    ``rows``: session_id, line_no, type, subtype, preserved (ids kept); ``ev``: events with line_no, native_ref and pos.
    A summary without a compaction boundary at most ``max_gap`` lines before it replaces nothing that is known; events
    behind the boundary, before the previous summary, or with a preserved id are left out.
    """
    bounds = rows.filter("type = 'system' and subtype = 'compact_boundary'").select("session_id", F.col("line_no").alias("mark"), F.coalesce("preserved", F.array().cast("array<string>")).alias("kept"))
    lines = ev.select("session_id", "event_id", "line_no", "native_ref", "kind").withColumn("mark", F.lit(None).cast("long"))
    s = lines.filter("kind = 'summary'").select("session_id", "event_id", "line_no", "mark").unionByName(bounds.select("session_id", F.lit(None).cast("string").alias("event_id"), F.col("mark").alias("line_no"), "mark"))
    s = filled(s, "mark", "bound", pos="line_no").filter("event_id is not null")
    before = F.lag("line_no").over(Window.partitionBy("session_id").orderBy("line_no"))  # summaries of a session: few
    s = s.withColumn("after", F.coalesce(before, F.lit(-1))).filter((F.col("line_no") - F.col("bound") <= max_gap) & (F.col("bound") > F.col("after")))
    s = s.join(bounds.withColumnRenamed("mark", "bound"), ["session_id", "bound"]).select("session_id", F.col("event_id").alias("summary"), F.col("line_no").alias("summary_line"), "bound", "kept")
    marks = ev.filter("kind = 'summary'").select("session_id", F.col("line_no").alias("summary_line"))
    e = lines.drop("mark").unionByName(marks.select("session_id", F.lit(None).cast("string").alias("event_id"), F.col("summary_line").alias("line_no"), F.lit(None).cast("string").alias("native_ref"), F.lit("mark").alias("kind")))
    e = e.withColumn("mark", F.when(F.col("kind") == "mark", F.col("line_no")))
    e = filled(e, "mark", "summary_line", back=True, pos="line_no").filter("kind not in ('mark', 'summary')").join(s, ["session_id", "summary_line"])
    e = e.filter((F.col("line_no") < F.col("bound")) & ~F.coalesce(F.array_contains("kept", F.col("native_ref")), F.lit(False)))
    return _edge(e, "summary", "event_id", "MATERIALIZES", F.lit("compaction"))


def event_values(ev: DataFrame) -> DataFrame:
    """(session_id, event_id, pos, kind, value, type_no): values of events, each for the first type that has it."""
    v = ev.select("session_id", "event_id", "pos", "kind", F.explode(T.values_in(F.col("text"))).alias("v"))
    return v.groupBy("session_id", "event_id", "pos", "kind", F.col("v.value").alias("value")).agg(F.min("v.type_no").alias("type_no"))


def depends_value(ev: DataFrame, max_sources: int = 3, max_edges: int = 4, result_first: bool = True) -> DataFrame:
    """Consumer (assistant, call) -> the nearest earlier tool result with a value that it repeats.

    A value counts if at most ``max_sources`` results of the session hold it and, with ``result_first``, no consumer
    had it before the first of them. A consumer has at most ``max_edges`` edges, rarest values and nearest results
    first, one to each result.
    """
    vals = event_values(ev.filter("kind in ('assistant', 'tool_call', 'tool_result')"))
    is_result = F.col("kind") == "tool_result"
    rare = vals.groupBy("session_id", "value").agg(F.count_if(is_result).alias("n_src"), F.min(F.when(is_result, F.col("pos"))).alias("first_src"), F.min(F.when(~is_result, F.col("pos"))).alias("first_use"))
    rare = rare.filter(F.col("n_src").between(1, max_sources) & F.col("first_use").isNotNull())
    if result_first:
        rare = rare.filter("first_use >= first_src")
    src = vals.filter(is_result).join(rare, ["session_id", "value"]).select("session_id", "value", "n_src", F.col("event_id").alias("src_event"), F.col("pos").alias("src_pos"))
    near = vals.filter(~is_result).join(src, ["session_id", "value"]).filter("src_pos < pos")  # at most max_sources rows a use
    near = near.groupBy("session_id", "event_id", "value", "type_no", "n_src").agg(F.max(F.struct("src_pos", "src_event")).alias("s"))
    kind = F.element_at(F.array(*map(F.lit, T.VALUE_TYPES)), F.col("type_no") + 1)
    one = near.groupBy("session_id", "event_id", "s").agg(F.min(F.struct("n_src", kind.alias("type"), "value")).alias("v"))
    w = Window.partitionBy("session_id", "event_id").orderBy("v.n_src", F.desc("s.src_pos"), "v.type", "v.value")
    return _edge(one.withColumn("r", F.row_number().over(w)).filter(F.col("r") <= max_edges).withColumn("dst", F.col("s.src_event")), "event_id", "dst", "DEPENDS_ON", F.concat(F.lit("value:"), "v.type"))


def control(rows: DataFrame, most: int = 64) -> DataFrame:
    """(session_id, src_id, dst_id, predicate): retained row -> its nearest retained ancestor, at most ``most`` links up.

    ``rows``: session_id, uuid, parent, kept, line_no. Retained rows are cut from their parents and so are the roots of the
    forests of dropped rows, which one contraction resolves however long the chains are.
    """
    nodes = rows.select(F.col("session_id").alias("scope"), F.col("uuid").alias("id"), F.when(~F.col("kept"), F.col("parent")).alias("parent"), F.col("line_no").alias("pos"), F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("own"), F.lit(None).cast("string").alias("seg"))
    tops = solve(nodes).filter(F.col("state") == ROOT).select(F.col("scope").alias("session_id"), F.col("id").alias("parent"), "root", "weight")
    kept = rows.filter("kept").select("session_id", F.col("uuid").alias("root"))
    up = rows.filter("kept and parent is not null").join(tops.filter(F.col("weight") <= most), ["session_id", "parent"]).join(kept, ["session_id", "root"])
    return up.select("session_id", F.col("uuid").alias("src_id"), F.col("root").alias("dst_id"), F.when(F.col("weight") > 1, "parent:transitive").otherwise("parent").alias("predicate"))


def all_edges(ev: DataFrame) -> DataFrame:
    return result_of(ev).unionByName(temporal(ev)).unionByName(supersedes(ev)).unionByName(materializes(ev)).unionByName(depends_value(ev))


def fifo_pairs(rows: DataFrame, keys: list[str], order: list[str], call, result) -> DataFrame:
    """Each result with the oldest open call of its group; a result without an open call is left out.

    The k-th result that is served takes the k-th call. A result is served iff the queue, a running sum that is
    reflected at zero, is not empty before it.
    """
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    step = F.when(call, 1).when(result, -1).otherwise(0)
    d = rows.withColumn("step", step).filter("step <> 0").withColumn("run", F.sum("step").over(w)).withColumn("low", F.least(F.min("run").over(w), F.lit(0)))
    before = F.lag("low").over(Window.partitionBy(*keys).orderBy(*order))
    d = d.withColumn("served", (F.col("step") == -1) & (F.col("low") == F.coalesce(before, F.lit(0))))
    d = d.withColumn("k", F.when(F.col("step") == 1, F.sum(F.expr("int(step = 1)")).over(w)).when(F.col("served"), F.sum(F.expr("int(served)")).over(w)))
    calls = d.filter("step = 1").select(*keys, "k", F.struct(*order).alias("c"))
    return d.filter("served").select(*keys, "k", F.struct(*order).alias("r")).join(calls, [*keys, "k"])


def stats(ev: DataFrame) -> DataFrame:
    """Counts by kind, time span, groups and tokens of each session."""
    kinds = ("user", "assistant", "tool_call", "tool_result", "decision", "summary", "state")
    return ev.groupBy("session_id").agg(
        *[F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in kinds], F.count("*").alias("n_events"), (F.max("ts") - F.min("ts")).alias("timespan"),
        F.countDistinct("tool_call_id").alias("n_calls"), F.countDistinct("step_id").alias("n_steps"), F.countDistinct("atomic_group").alias("n_groups"), F.sum(F.coalesce(T.tokens_floor(F.col("text")), F.lit(0)).cast("long")).alias("tokens"),
    )
