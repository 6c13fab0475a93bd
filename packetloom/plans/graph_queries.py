"""Registered queries of graph lookups, checks, views and closure, each with the SQL that checks it.

``_trace`` is the graph of trace_events; ``_activity`` is that of the table events, where a user is a session: clicks
are calls, views results, purchases writes to the path ``k``, errors messages and sign-ups summaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import events, graph
from packetloom.plans.function_queries import quoted
from packetloom.plans.reference_queries import DEPENDS, EV, MATERIAL, RESULT_OF, SUPER
from packetloom.runtime import cut, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _ev(spark, sf) -> DataFrame:
    return events.canonical(read_table(spark, sf, "trace_events").select("session_id", "event_id", "kind", "text", "ts", "step_id", "tool_call_id", "native_ref", "atomic_group", "meta", "received_at"))


def _trace(spark, sf) -> tuple[DataFrame, DataFrame]:
    ev = cut(_ev(spark, sf))
    return ev, cut(events.result_of(ev).unionByName(events.depends_value(ev)).unionByName(events.materializes(ev)))


KINDS = {"click": "tool_call", "view": "tool_result", "purchase": "state", "error": "user", "signup": "summary"}


def _activity(spark, sf) -> tuple[DataFrame, DataFrame]:
    e = read_table(spark, sf, "events")
    kind = F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv])[F.col("event_type")]
    ev = e.select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.concat(F.lit("e"), "event_id").alias("event_id"), F.col("event_id").alias("n"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), kind.alias("kind"), F.get_json_object("props", "$.k").alias("path"))
    ev = cut(events.placed(ev, ["ts", "n"], events.HOUR * 1000))
    return ev, cut(events.superseding(ev.filter("kind = 'state'"), "path").unionByName(events.materializes(ev)).unionByName(events.nearest_earlier(ev, "path", F.col("kind") == "user", F.col("kind") == "tool_result")).unionByName(events.temporal(ev)))


_CASE = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in KINDS.items())
AV = f"""av AS (SELECT 'u' || user_id AS session_id, 'e' || event_id AS event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, CASE event_type {_CASE} END AS kind, json_extract_string(props, '$.k') AS path FROM events),
 asp AS (SELECT * FROM (SELECT session_id, event_id AS src_id, lag(event_id) OVER (PARTITION BY session_id, path ORDER BY pos) AS dst_id, 'SUPERSEDES' AS edge_type, path AS predicate FROM av WHERE kind = 'state') WHERE dst_id IS NOT NULL),
 amt AS (SELECT session_id, nxt AS src_id, event_id AS dst_id, 'MATERIALIZES' AS edge_type, 'summary' AS predicate FROM (SELECT *, last_value(CASE WHEN kind = 'summary' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS nxt FROM av) WHERE kind <> 'summary' AND nxt IS NOT NULL),
 adv AS (SELECT session_id, event_id AS src_id, r AS dst_id, 'DEPENDS_ON' AS edge_type, path AS predicate FROM (SELECT *, last_value(CASE WHEN kind = 'tool_result' THEN event_id END IGNORE NULLS) OVER (PARTITION BY session_id, path ORDER BY pos ROWS UNBOUNDED PRECEDING) AS r FROM av) WHERE kind = 'user' AND r IS NOT NULL),
 atm AS (SELECT * FROM (SELECT session_id, event_id AS src_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) AS dst_id, 'TEMPORAL' AS edge_type, CAST(NULL AS VARCHAR) AS predicate FROM av) WHERE dst_id IS NOT NULL),
 ae AS (SELECT * FROM asp UNION ALL SELECT * FROM amt UNION ALL SELECT * FROM adv UNION ALL SELECT * FROM atm)"""
TE = f"{EV}, {RESULT_OF}, {DEPENDS}, {MATERIAL}, te AS (SELECT session_id, src_id, dst_id, edge_type, predicate FROM ro UNION ALL SELECT session_id, src_id, dst_id, edge_type, predicate FROM dv UNION ALL SELECT session_id, src_id, dst_id, edge_type, predicate FROM mt)"
EVM = EV.replace("tool_call_id, atomic_group FROM", "tool_call_id, atomic_group, native_ref, meta FROM")


@query(f"WITH {AV} SELECT * FROM ae")
def activity_edges(spark, sf):
    return _activity(spark, sf)[1].select(*events.EDGE)


@query(f"WITH {EV}, {SUPER}, {AV} SELECT session_id, src_id, dst_id, edge_type, predicate FROM sp UNION ALL SELECT * FROM asp")
def edges_supersedes(spark, sf):
    """Writes to the same path, of the recorded sessions and of the activity."""
    return events.supersedes(_ev(spark, sf)).unionByName(_activity(spark, sf)[1].filter("edge_type = 'SUPERSEDES'"))


@query(f"WITH {AV} SELECT session_id, src_id AS event_id, count(*) AS n, string_agg(edge_type || ':' || dst_id, ',' ORDER BY edge_type, dst_id) AS listed FROM ae WHERE edge_type IN ('SUPERSEDES', 'DEPENDS_ON') GROUP BY ALL")
def graph_parents(spark, sf):
    p = graph.parents(_activity(spark, sf)[1], "SUPERSEDES", "DEPENDS_ON")
    return p.select("session_id", "event_id", F.size("parents").cast("long").alias("n"), F.array_join(F.transform("parents", lambda x: F.concat_ws(":", x["edge_type"], x["dst_id"])), ",").alias("listed"))


@query(f"WITH {AV} SELECT session_id, dst_id AS event_id, count(*) AS n, string_agg(edge_type || ':' || src_id, ',' ORDER BY edge_type, src_id) AS listed FROM ae GROUP BY ALL")
def graph_children(spark, sf):
    p = graph.children(_activity(spark, sf)[1])
    return p.select("session_id", "event_id", F.size("children").cast("long").alias("n"), F.array_join(F.transform("children", lambda x: F.concat_ws(":", x["edge_type"], x["src_id"])), ",").alias("listed"))


def _grouped_sql(c: str) -> str:
    return f"SELECT '{c}' AS by, session_id, {c} AS key, count(*) AS n, arg_min(event_id, pos) AS first_id, arg_max(event_id, pos) AS last_id FROM ev WHERE {c} IS NOT NULL GROUP BY ALL"


@query(f"WITH {EV} {' UNION ALL '.join(_grouped_sql(c) for c in ('step_id', 'tool_call_id', 'atomic_group'))}")
def graph_groups(spark, sf):
    ev, out = cut(_ev(spark, sf)), None
    for c in ("step_id", "tool_call_id", "atomic_group"):
        d = graph.grouped(ev, c).withColumn("by", F.lit(c))
        out = d if out is None else out.unionByName(d)
    return out


@query(f"WITH {AV} SELECT DISTINCT session_id, dst_id AS event_id FROM asp")
def superseded_ids(spark, sf):
    return graph.superseded(_activity(spark, sf)[1])


@query(f"""WITH RECURSIVE {AV}, w AS (SELECT session_id, dst_id AS event_id, src_id AS at FROM asp UNION SELECT w.session_id, w.event_id, s.src_id FROM w JOIN asp s ON s.session_id = w.session_id AND s.dst_id = w.at)
 SELECT w.session_id, w.event_id, arg_max(w.at, a.pos) AS latest_id, false AS on_cycle FROM w JOIN av a ON a.session_id = w.session_id AND a.event_id = w.at WHERE NOT EXISTS (SELECT 1 FROM asp s WHERE s.session_id = w.session_id AND s.dst_id = w.at) GROUP BY ALL""")
def latest_states(spark, sf):
    return graph.latest_state(*_activity(spark, sf))


@query(f"WITH {AV}, i AS (SELECT session_id, dst_id AS event_id FROM ae) SELECT a.session_id, string_agg(event_id, ',' ORDER BY pos) AS ids FROM (SELECT DISTINCT * FROM i) i JOIN av a USING (session_id, event_id) GROUP BY ALL")
def chronological_ids(spark, sf):
    ev, e = _activity(spark, sf)
    d = graph.chronological(ev, e.select("session_id", F.col("dst_id").alias("event_id")))
    return d.groupBy("session_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "event_id"))), lambda x: x["event_id"]), ",").alias("ids"))


@query(f"WITH {AV} SELECT session_id, edge_type, count(*) AS n FROM ae WHERE edge_type NOT IN ('CONTROL', 'TEMPORAL') GROUP BY ALL")
def strong_subgraph(spark, sf):
    return graph.strong(_activity(spark, sf)[1]).groupBy("session_id", "edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {AV}, d AS (SELECT session_id, event_id FROM av WHERE kind = 'user'), e AS (SELECT ae.* FROM ae ANTI JOIN d a ON a.session_id = ae.session_id AND a.event_id = src_id ANTI JOIN d b ON b.session_id = ae.session_id AND b.event_id = dst_id)
 SELECT session_id, (SELECT count(*) FROM av v WHERE v.session_id = s.session_id AND kind <> 'user') AS n_events, (SELECT count(*) FROM e WHERE e.session_id = s.session_id) AS n_edges FROM (SELECT DISTINCT session_id FROM av) s""")
def restricted_graph(spark, sf):
    """The activity graph without messages and the edges that touch them."""
    ev, e = _activity(spark, sf)
    ev2, e2 = graph.restrict(ev, e, ev.filter("kind = 'user'"))
    n = ev.select("session_id").distinct().join(ev2.groupBy("session_id").agg(F.count("*").alias("n_events")), "session_id", "left").join(e2.groupBy("session_id").agg(F.count("*").alias("n_edges")), "session_id", "left")
    return n.na.fill(0, ["n_events", "n_edges"])


@query("""WITH c AS (SELECT DISTINCT session_id, line_no, uuid, parentUuid FROM claude_rows WHERE uuid IS NOT NULL), i AS (SELECT session_id, uuid, count(*) AS n FROM c GROUP BY ALL), e AS (SELECT DISTINCT session_id, uuid AS s, parentUuid AS d FROM c WHERE parentUuid IS NOT NULL)
 SELECT session_id, uuid AS event_id, 'duplicate' AS problem FROM i WHERE n > 1 UNION ALL SELECT DISTINCT session_id, d, 'no target' FROM e ANTI JOIN i ON i.session_id = e.session_id AND i.uuid = e.d UNION ALL SELECT DISTINCT session_id, s, 'self' FROM e WHERE s = d""")
def graph_problems(spark, sf):
    """Duplicate ids, ends that are no events and self links of the native parent links."""
    c = read_table(spark, sf, "claude_rows").select("session_id", "line_no", F.col("uuid").alias("event_id"), "parentUuid").filter("event_id is not null").distinct()
    return graph.problems(c, c.filter("parentUuid is not null").select("session_id", F.col("event_id").alias("src_id"), F.col("parentUuid").alias("dst_id")))


@query(f"WITH {AV} SELECT session_id, {', '.join(f'''count(*) FILTER (WHERE edge_type = '{t}') AS n_{t.lower()}''' for t in graph.EDGE_TYPES)} FROM ae GROUP BY session_id")
def edge_type_counts(spark, sf):
    return graph.type_counts(_activity(spark, sf)[1])


@query(f"WITH {AV}, x AS (SELECT * FROM ae UNION ALL SELECT * FROM asp) SELECT edge_type, count(*) AS n FROM (SELECT DISTINCT * FROM x) GROUP BY ALL")
def distinct_edge_counts(spark, sf):
    e = _activity(spark, sf)[1]
    return graph.distinct_edges(e.unionByName(e.filter("edge_type = 'SUPERSEDES'"))).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"WITH {AV} SELECT a.session_id, a.event_id, min(abs(a.pos - b.pos)) AS distance FROM av a JOIN av b ON a.session_id = b.session_id AND b.kind = 'tool_result' WHERE a.kind = 'state' GROUP BY ALL")
def record_distances(spark, sf):
    """Places between a write and the nearest result."""
    return graph.distances(_activity(spark, sf)[0], F.col("kind") == "state", F.col("kind") == "tool_result")


@query(f"WITH {TE} SELECT DISTINCT session_id, src_id AS event_id FROM mt UNION SELECT session_id, event_id FROM ev WHERE kind IN ('summary', 'decision')")
def carrier_ids(spark, sf):
    return graph.carriers(*_trace(spark, sf))


@query(f"WITH {TE}, w AS (SELECT session_id, src_id FROM mt GROUP BY ALL HAVING count(*) > 32) SELECT edge_type, count(*) AS n FROM te ANTI JOIN (SELECT *, 'MATERIALIZES' AS t FROM w) w ON w.session_id = te.session_id AND w.src_id = te.src_id AND w.t = te.edge_type GROUP BY ALL")
def fan_out_capped(spark, sf):
    return graph.capped_fan_out(_trace(spark, sf)[1], 32).groupBy("edge_type").agg(F.count("*").alias("n"))


@query(f"""WITH {AV}, e AS (SELECT DISTINCT m.session_id, src_id, dst_id, a.pos AS sp, b.pos AS dp FROM amt m JOIN av a ON a.session_id = m.session_id AND a.event_id = src_id JOIN av b ON b.session_id = m.session_id AND b.event_id = dst_id),
 k AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY md5('random|' || src_id || '|' || dst_id), src_id, dst_id) AS k1, row_number() OVER (PARTITION BY session_id ORDER BY md5('random|' || dst_id || '|' || src_id), src_id, dst_id) AS k2 FROM e)
 SELECT DISTINCT x.session_id, x.src_id, v.event_id AS dst_id FROM k x JOIN k y ON x.session_id = y.session_id AND x.k1 = y.k2 JOIN av v ON v.session_id = x.session_id AND v.pos = x.sp - (y.sp - y.dp)""")
def edges_shuffled(spark, sf):
    """Summary edges dealt anew with the same distances."""
    ev, e = _activity(spark, sf)
    return graph.shuffled_edges(ev, e.filter("edge_type = 'MATERIALIZES'"))


@query(f"WITH {EV} SELECT session_id, window_no, count(*) AS n, min(pos) AS first_pos, max(pos) AS last_pos FROM (SELECT *, unnest(range(greatest(0, CAST(ceil((pos - 127) / 64.0) AS BIGINT)), pos // 64 + 1)) AS window_no FROM ev) GROUP BY ALL")
def edge_windows(spark, sf):
    """Overlapping windows of 128 events, every 64, in which a model is asked for edges."""
    return graph.windows(_ev(spark, sf).select("session_id", "pos")).groupBy("session_id", "window_no").agg(F.count("*").alias("n"), F.min("pos").alias("first_pos"), F.max("pos").alias("last_pos"))


_REPLY = "event_id || ' <- ' || CASE WHEN pos % 5 = 0 THEN 'nobody' WHEN pos % 7 = 0 THEN event_id ELSE coalesce(before, 'x') END || CASE WHEN pos % 3 = 0 THEN ' | because it says so ' ELSE '' END || chr(10) || 'no edge here'"


@query(f"WITH {AV}, b AS (SELECT *, lag(event_id, 2) OVER (PARTITION BY session_id ORDER BY pos) AS before FROM av) SELECT session_id, event_id AS src_id, before AS dst_id, CASE WHEN pos % 3 = 0 THEN 'because it says so' END AS predicate FROM b WHERE pos % 5 <> 0 AND pos % 7 <> 0 AND before IS NOT NULL")
def edges_parsed(spark, sf):
    """Edges read from reply lines; unknown, later and same events are no parents."""
    ev = _activity(spark, sf)[0]
    b = ev.join(ev.select("session_id", (F.col("pos") + 2).alias("pos"), F.col("event_id").alias("before")), ["session_id", "pos"], "left")
    return graph.parsed_edges(b.select("session_id", F.expr(_REPLY).alias("reply")), ev)


# --- context and search ------------------------------------------------------------------------------------------
NOISE = "(kind = 'summary' OR coalesce(meta['is_meta'] = '1', false) OR (kind = 'user' AND (" + " OR ".join(f"starts_with(ltrim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(13)), {quoted(b)})" for b in T.NOISE_BEGIN) + ")))"
CONTEXT = f"""cs AS (SELECT session_id, max(pos) AS last, coalesce(list_sort(list(pos), 'DESC')[2], -1) AS previous, arg_max(event_id, pos) AS src_id FROM ev WHERE kind = 'summary' GROUP BY 1),
 rp AS (SELECT DISTINCT m.session_id, m.dst_id AS event_id FROM mt m JOIN cs ON cs.session_id = m.session_id AND cs.src_id = m.src_id),
 ic AS (SELECT e.* FROM ev e LEFT JOIN cs ON cs.session_id = e.session_id LEFT JOIN rp ON rp.session_id = e.session_id AND rp.event_id = e.event_id WHERE last IS NULL OR pos >= last OR (pos > previous AND rp.event_id IS NULL AND e.session_id IN (SELECT session_id FROM rp)))"""
NORM = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"
SEARCH = f"""{CONTEXT}, seen AS (SELECT DISTINCT session_id, norm FROM (SELECT session_id, {NORM} AS norm FROM ic) WHERE length(norm) >= 20),
 se AS (SELECT e.* EXCLUDE norm FROM (SELECT *, {NORM} AS norm FROM ev WHERE NOT {NOISE}) e ANTI JOIN ic ON ic.session_id = e.session_id AND ic.event_id = e.event_id ANTI JOIN seen s ON s.session_id = e.session_id AND s.norm = e.norm)"""


def _context(spark, sf):
    ev = cut(_ev(spark, sf))
    return ev, events.materializes(ev)


@query(f"WITH {EVM}, {MATERIAL}, {CONTEXT} SELECT session_id, event_id, pos FROM ic")
def in_context(spark, sf):
    return graph.in_context(*_context(spark, sf)).select("session_id", "event_id", "pos")


@query(f"WITH {EVM}, {MATERIAL}, {SEARCH} SELECT session_id, event_id, pos FROM se")
def searchable(spark, sf):
    return graph.searchable(*_context(spark, sf)).select("session_id", "event_id", "pos")


@query(f"""WITH {EVM}, l AS (SELECT session_id, max(pos) AS last FROM ev WHERE kind = 'summary' GROUP BY 1), q AS (SELECT session_id, arg_max(text, pos) AS query FROM ev WHERE kind = 'user' AND text IS NOT NULL GROUP BY 1)
 SELECT e.session_id, e.event_id, e.pos FROM ev e LEFT JOIN l ON l.session_id = e.session_id LEFT JOIN q ON q.session_id = e.session_id WHERE last IS NULL OR pos >= last OR (kind = 'user' AND trim(regexp_replace(coalesce(text, ''), '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')) = trim(regexp_replace(coalesce(query, ''), '[ \\t\\r\\n\\f\\x0b]+', ' ', 'g')))""")
def in_context_with_query(spark, sf):
    """With the newest instruction of a session as its query."""
    ev = cut(_ev(spark, sf))
    return graph.in_context_with_query(ev, graph_newest(ev)).select("session_id", "event_id", "pos")


def graph_newest(ev: DataFrame) -> DataFrame:
    """(session_id, query): the newest instruction of a user."""
    return ev.filter("kind = 'user' and text is not null").groupBy("session_id").agg(F.max_by("text", "pos").alias("query"))


@query(f"WITH {EV} SELECT session_id, md5(arg_max(text, pos)) AS digest FROM ev WHERE kind = 'user' AND text IS NOT NULL GROUP BY 1")
def newest_instruction(spark, sf):
    return graph_newest(_ev(spark, sf)).select("session_id", F.md5("query").alias("digest"))


@query(f"WITH {EVM}, w AS (SELECT * FROM ev WHERE NOT {NOISE}) SELECT e.session_id, e.event_id, e.pos FROM w e LEFT JOIN (SELECT session_id, max(pos) AS stop FROM w WHERE kind <> 'assistant' GROUP BY 1) s ON e.session_id = s.session_id WHERE kind = 'assistant' AND (stop IS NULL OR pos > stop)")
def trailing_reply(spark, sf):
    return graph.trailing_reply(_ev(spark, sf)).select("session_id", "event_id", "pos")


@query(f"WITH {EV} SELECT session_id, event_id, kind FROM ev WHERE kind IN ('tool_call', 'tool_result')")
def tool_records(spark, sf):
    return graph.tool_records(_ev(spark, sf)).select("session_id", "event_id", "kind")


@query(f"WITH {AV} SELECT session_id, event_id, (session_id, event_id) IN (SELECT (session_id, dst_id) FROM asp) AS changed FROM av")
def changed_later(spark, sf):
    return graph.changed_later(*_activity(spark, sf)).select("session_id", "event_id", "changed")


@query(f"WITH {EVM}, {MATERIAL}, {SEARCH} SELECT session_id, count(*) AS n_events, count(*) FILTER (WHERE kind = 'summary') AS compactions, CASE WHEN count(*) FILTER (WHERE kind = 'summary') > 0 THEN (SELECT count(*) FROM se WHERE se.session_id = ev.session_id) ELSE 0 END AS recallable, count(*) FILTER (WHERE kind IN ('tool_call', 'tool_result')) AS tool_records FROM ev GROUP BY session_id")
def session_status(spark, sf):
    return graph.status(*_context(spark, sf))


@query(f"WITH {EVM}, {RESULT_OF} SELECT e.session_id, e.event_id, coalesce(nullif(e.meta['tool'], ''), nullif(c.meta['tool'], '')) AS tool FROM ev e LEFT JOIN ro ON ro.session_id = e.session_id AND ro.src_id = e.event_id LEFT JOIN ev c ON c.session_id = ro.session_id AND c.event_id = ro.dst_id WHERE e.kind IN ('tool_call', 'tool_result')")
def tool_names(spark, sf):
    """Tools of calls, and those that results inherit from their calls."""
    return graph.with_tools(_ev(spark, sf)).filter("kind in ('tool_call', 'tool_result')").select("session_id", "event_id", "tool")


@query(f"""WITH {EV}, {RESULT_OF}, s AS (SELECT session_id, event_id, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) AS rank FROM ev QUALIFY rank <= 10),
 p AS (SELECT * FROM s UNION ALL SELECT s.session_id, src_id, rank FROM s JOIN ro ON ro.session_id = s.session_id AND ro.dst_id = s.event_id UNION ALL SELECT s.session_id, dst_id, rank FROM s JOIN ro ON ro.session_id = s.session_id AND ro.src_id = s.event_id)
 SELECT session_id, event_id, min(rank) AS rank FROM p GROUP BY ALL""")
def paired_seeds(spark, sf):
    """The newest ten events of a session as seeds, calls with outputs and outputs with calls."""
    ev = cut(_ev(spark, sf))
    top = ev.groupBy("session_id").agg(F.max("pos").alias("top"))
    seeds = ev.join(top, "session_id").select("session_id", "event_id", (F.col("top") - F.col("pos") + 1).alias("rank")).filter("rank <= 10")
    return graph.paired_seeds(seeds, events.result_of(ev))


def native_materializes(spark, sf):
    """Compaction edges of the transcripts by their boundaries and preserved ids."""
    from packetloom.sources.normalize import events_of

    rows = read_table(spark, sf, "claude_rows")
    ev = events_of(rows, "claude_code").withColumn("line_no", F.col("step_id").cast("long"))
    src = rows.select("session_id", "line_no", "type", "subtype", F.col("compactMetadata.preservedMessages.uuids").alias("preserved")).distinct()
    return events.native_materializes(src, cut(ev))


QUERIES["native_materializes"] = native_materializes
