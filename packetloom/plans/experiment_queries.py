"""Registered queries of loaders, samples, quotes, kept views and grids, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import events, flatten, metrics, packing, weave
from packetloom.operators import experiments as X
from packetloom.plans.graph_queries import _ev
from packetloom.plans.reference_queries import DEPENDS, EV
from packetloom.runtime import cut, first_rows, ranked, read_table
from packetloom.sources import loaders
from packetloom.sources.normalize import events_of

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


@query()
def edges_quote(spark, sf):
    """Edits whose text stands in an earlier result."""
    return X.depends_quote(cut(_ev(spark, sf)))


_ARG = "CASE WHEN json_valid(substr(text, strpos(text, ' ') + 1)) THEN json_extract_string(substr(text, strpos(text, ' ') + 1), '$.{}') END"
_BASE = "string_split(path, '/')[-1]"


@query(rf"""WITH {EV}, c AS (SELECT *, CASE WHEN regexp_matches(text, '^(Read|Write|Edit|MultiEdit|WebFetch) ') THEN {_ARG.format('file_path')} END AS raw_path, text LIKE 'Read %' OR text LIKE 'WebFetch %' AS viewed, regexp_matches(text, '^(Write|Edit|MultiEdit) ') AS edited, CASE WHEN text LIKE 'Bash %' THEN {_ARG.format('command')} END AS command FROM ev WHERE kind = 'tool_call'),
 p AS (SELECT *, regexp_replace(regexp_replace(raw_path, '^/testbed(/|$)', ''), '^\./', '') AS path FROM c), r AS (SELECT session_id, tool_call_id, arg_min(text, pos) AS shown FROM ev WHERE kind = 'tool_result' AND tool_call_id IS NOT NULL AND text IS NOT NULL GROUP BY ALL),
 s AS (SELECT session_id, max(pos) AS last, arg_max(text, pos) AS summary FROM ev WHERE kind = 'summary' GROUP BY 1), v AS (SELECT session_id, path, max(pos) AS pos, arg_max(event_id, pos) AS event_id, arg_max(tool_call_id, pos) AS call FROM p WHERE viewed AND path IS NOT NULL AND contains({_BASE}, '.') GROUP BY ALL),
 e AS (SELECT session_id, path, max(pos) AS edit_pos FROM p WHERE edited AND path IS NOT NULL GROUP BY ALL)
 SELECT v.session_id, v.path, v.event_id, CASE WHEN s.last IS NULL OR v.pos >= s.last THEN 'latest_in_context' WHEN e.edit_pos > v.pos OR EXISTS (SELECT 1 FROM p b WHERE b.session_id = v.session_id AND b.pos > v.pos AND regexp_matches(b.command, '{T.TERMINAL_WRITE}') AND contains(b.command, string_split(v.path, '/')[-1])) THEN 'edited_since'
  WHEN shown IS NULL THEN 'no_observation' WHEN length(shown) > 16000 THEN 'over_read_cap' WHEN NOT contains(coalesce(summary, ''), string_split(v.path, '/')[-1]) THEN 'not_in_summary' ELSE 'candidate' END AS verdict
 FROM v LEFT JOIN s ON s.session_id = v.session_id LEFT JOIN e ON e.session_id = v.session_id AND e.path = v.path LEFT JOIN r ON r.session_id = v.session_id AND r.tool_call_id = v.call""")
def kept_file_views(spark, sf):
    """The newest view of every file and why it is or is not put back; what only the caps turn away counts as a candidate."""
    ev = cut(_ev(spark, sf))
    calls = ev.filter("kind = 'tool_call'")
    tool = F.substring_index("text", " ", 1)
    shown = ev.filter("kind = 'tool_result' and tool_call_id is not null and text is not null").groupBy("session_id", "tool_call_id").agg(F.min_by("text", "pos").alias("shown"))
    views = calls.join(shown, ["session_id", "tool_call_id"], "left").select(
        "session_id", "event_id", "pos", F.when(tool.isin("Read", "Write", "Edit", "MultiEdit", "WebFetch"), T.argument(tool, F.col("text"), "file_path")).alias("path"), tool.isin("Read", "WebFetch").alias("viewed"), tool.isin("Write", "Edit", "MultiEdit").alias("edited"),
        F.when(tool == "Bash", T.argument(tool, F.col("text"), "command")).alias("command"), "shown",
    )
    last = ev.filter("kind = 'summary'").groupBy("session_id").agg(F.max("pos").alias("last"), F.max_by("text", "pos").alias("summary"))
    gone = ev.join(last, "session_id").filter("pos < last").select("session_id", "event_id")
    k = X.kept_views(views, gone, last)
    return k.select("session_id", "path", "event_id", F.when(F.col("verdict").isin("kept", "over_cap"), "candidate").otherwise(F.col("verdict")).alias("verdict"))


_TARGETS = {"assistant": 40, "tool_call": 40, "tool_result": 30, "state": 5}


@query(f"""WITH {EV}, i AS (SELECT kind AS slice, session_id, session_id || ':' || event_id AS item_id, CASE kind {' '.join(f"WHEN '{k}' THEN {n}" for k, n in _TARGETS.items())} END AS goal FROM ev WHERE kind IN ({', '.join(map(repr, _TARGETS))})),
 t AS (SELECT *, row_number() OVER (PARTITION BY slice, session_id ORDER BY md5('sample|' || item_id), item_id) AS turn FROM i), d AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY slice ORDER BY turn, session_id) AS place FROM t WHERE turn <= goal) WHERE place <= goal),
 n AS (SELECT slice, session_id, count(*) AS own FROM d GROUP BY ALL), m AS (SELECT *, sum(own) OVER (PARTITION BY slice) AS total FROM n)
 SELECT d.slice, d.session_id, d.item_id FROM d JOIN m USING (slice, session_id) WHERE total <= 2 OR turn <= greatest(1, floor((total - own) * 0.4 / 0.6 + 1e-9))""")
def stratified_items(spark, sf):
    """Items of four kinds, one a session in turn, no session above two fifths of a kind."""
    ev = _ev(spark, sf).filter(F.col("kind").isin(*_TARGETS))
    return X.round_robin(ev.select(F.col("kind").alias("slice"), "session_id", F.concat_ws(":", "session_id", "event_id").alias("item_id")), _TARGETS)


_SLICES = f"""{EV}, {DEPENDS.split('rare AS (')[0].replace("WHERE kind IN ('assistant', 'tool_call', 'tool_result')", "WHERE kind IN ('assistant', 'decision', 'tool_call', 'tool_result')").rstrip().rstrip(',')}"""


@query(f"""WITH {_SLICES}, g AS (SELECT session_id, value, count(*) FILTER (WHERE kind = 'tool_result') AS n_res, count(*) AS n, min(pos) FILTER (WHERE kind = 'tool_result') AS a, max(pos) FILTER (WHERE kind = 'tool_call') AS c, max(pos) FILTER (WHERE kind IN ('assistant', 'decision')) AS s FROM vals GROUP BY ALL HAVING n_res = 1)
 SELECT 'direct_fact' AS slice, session_id, value FROM g WHERE n = 1 UNION ALL SELECT 'tool_chain', session_id, value FROM g WHERE c > a UNION ALL SELECT 'decision_source', session_id, value FROM g WHERE s > a""")
def dependency_slices(spark, sf):
    """Values by how a session depends on the one result that shows them."""
    ev = _ev(spark, sf).filter("kind in ('assistant', 'decision', 'tool_call', 'tool_result')")
    return X.dependency_slices(events.event_values(ev))


@query(f"WITH {_SLICES} SELECT value, count(DISTINCT session_id) AS n FROM vals GROUP BY value HAVING count(DISTINCT session_id) >= 3")
def generic_values(spark, sf):
    """Values of three or more sessions, which prove nothing."""
    ev = _ev(spark, sf).filter("kind in ('assistant', 'decision', 'tool_call', 'tool_result')")
    return X.generic_values(events.event_values(ev))


def _declared(spark, sf):
    """Ids and result links of the transcripts by another way than the events: their flattened blocks."""
    rows = first_rows(read_table(spark, sf, "claude_rows"), ["session_id", "line_no"]).filter(F.col("type").isin("user", "assistant") & ~F.coalesce("isSidechain", F.lit(False)) & F.col("uuid").isNotNull())
    block = flatten.relation(flatten.flatten_records(rows.withColumn("received_at", F.lit(None).cast("timestamp"))), "block").select("session_id", "line_no", "item_no", "type", "id", "tool_use_id")
    b = block.join(rows.select("session_id", "line_no", "uuid"), ["session_id", "line_no"])
    calls = b.filter("type = 'tool_use' and id is not null").groupBy("session_id", F.col("id").alias("tool_use_id")).agg(F.min(F.struct("line_no", "uuid")).alias("c"))
    edges = b.filter("type = 'tool_result'").join(calls, ["session_id", "tool_use_id"]).filter(F.col("c.line_no") < F.col("line_no"))
    return b.filter("type in ('tool_use', 'tool_result')").select("session_id", F.col("uuid").alias("ref")).distinct(), edges.select("session_id", F.col("uuid").alias("src_ref"), F.col("c.uuid").alias("dst_ref")).distinct()


@query()
def roundtrip_audit(spark, sf):
    """What the events of the transcripts lost against an independent reading: ids, links, references and whole groups."""
    ev = cut(events_of(read_table(spark, sf, "claude_rows"), "claude_code").withColumn("pos", F.col("step_id").cast("long") * 1000 + F.substring("event_id", -3, 3).cast("long")))
    ids, links = _declared(spark, sf)
    ro = events.result_of(ev).select("session_id", "src_id", "dst_id")
    end = lambda c, p: ev.select("session_id", F.col("event_id").alias(c), F.col("native_ref").alias(f"{p}_ref"), F.col("atomic_group").alias(f"{p}_group"))
    e = cut(ro.join(end("src_id", "src"), ["session_id", "src_id"]).join(end("dst_id", "dst"), ["session_id", "dst_id"]))
    checks = {
        "missing ids": ids.join(ev.select("session_id", F.col("native_ref").alias("ref")), ["session_id", "ref"], "left_anti"), "missing links": links.join(e.select("session_id", "src_ref", "dst_ref"), ["session_id", "src_ref", "dst_ref"], "left_anti"),
        "links without reference": e.filter("src_ref is null or dst_ref is null"), "split groups": e.filter("not (src_group <=> dst_group)"), "declared ids": ids, "declared links": links,
    }
    out = None
    for name, d in checks.items():
        n = d.agg(F.count("*").alias("n")).select(F.lit(name).alias("check"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query("SELECT router, count(*) AS n, min(budget) AS least, max(budget) AS most FROM (SELECT unnest(['last_n', 'lexical', 'dense', 'hybrid', 'hybrid_pin', 'oracle']) AS router), (SELECT unnest(range(12)) AS i), (SELECT unnest([1024, 2048, 4096]) AS budget) GROUP BY router")
def arm_grid(spark, sf):
    """The grid of routers, closures, witnesses and budgets."""
    return X.grid(spark).groupBy("router").agg(F.count("*").alias("n"), F.min("budget").alias("least"), F.max("budget").alias("most"))


@query("SELECT doc_id, sha1(coalesce(text, '')) AS sha1 FROM documents")
def frozen_corpus(spark, sf):
    return X.frozen(read_table(spark, sf, "documents"), "doc_id")


@query("""SELECT doc_id, 'Session evidence:' || chr(10) || CASE WHEN coalesce(lang, '') <> '' THEN lang ELSE '(no evidence provided)' END || chr(10) || chr(10) || 'Which project?' || chr(10) || 'Option A: ' || CASE WHEN s THEN coalesce(source, 'x') ELSE coalesce(kind, 'y') END || chr(10) || 'Option B: ' || CASE WHEN s THEN coalesce(kind, 'y') ELSE coalesce(source, 'x') END
 || chr(10) || 'Answer with the letter only.' AS prompt FROM (SELECT *, list_contains(['1', '3', '5', '7', '9', 'b', 'd', 'f'], sha1(CAST(doc_id AS VARCHAR))[-1]) AS s FROM documents)""")
def choice_prompts(spark, sf):
    c = lambda n, d: F.coalesce(n, F.lit(d))
    return read_table(spark, sf, "documents").select("doc_id", X.tool_choice_prompt(c("lang", ""), F.lit("Which project?"), c("source", "x"), c("kind", "y"), F.col("doc_id").cast("string")).alias("prompt"))


@query("SELECT project_key, file_no, line_no, row_number() OVER (PARTITION BY project_key ORDER BY file_no, line_no) AS global_no FROM (SELECT DISTINCT project_key, file_no, line_no FROM transcript_lines)")
def concatenated_history(spark, sf):
    """A project's files as one history with running line numbers."""
    d = read_table(spark, sf, "transcript_lines").select("project_key", "file_no", "line_no").distinct()
    return loaders.concatenated(d, "project_key", ["file_no", "line_no"]).select("project_key", "file_no", "line_no", "global_no")


@query("""SELECT 'u' || user_id AS session_id, 'm' || lpad(CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS VARCHAR), 6, '0') AS id, CASE event_type WHEN 'signup' THEN 'user' WHEN 'click' THEN 'assistant' ELSE 'tool' END AS role, coalesce(props, '') AS content FROM events WHERE event_type IN ('signup', 'click', 'view')""")
def live_message_rows(spark, sf):
    """Rows of a running agent's events: messages, actions and observations."""
    e = read_table(spark, sf, "events")
    kind = F.when(F.col("event_type") == "signup", "MessageEvent").when(F.col("event_type") == "click", "ActionEvent").when(F.col("event_type") == "view", "ObservationEvent").otherwise("Other")
    none = F.lit(None).cast("string")
    d = e.select(F.concat(F.lit("u"), "user_id").alias("session_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("n"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"), none.alias("role"), F.col("props").alias("text"), none.alias("tool_name"), none.alias("tool_call_id"), none.alias("arguments"))
    return loaders.live_rows(d).select("session_id", "id", "role", "content")


@query("SELECT session_id AS item_id, row_no - 1 AS message_no, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS role, CASE WHEN row_no = 1 THEN '[Chat session on 2026/01/01]' || chr(10) ELSE '' END || content AS content FROM (SELECT DISTINCT session_id, row_no, role, coalesce(content, '') AS content FROM pi_rows) WHERE row_no <= 3 QUALIFY count(*) OVER (PARTITION BY session_id) = 3")
def dated_messages(spark, sf):
    """Sessions of question items as dated messages; sessions with their first three rows serve as items here."""
    p = first_rows(read_table(spark, sf, "pi_rows"), ["session_id", "row_no"]).filter("row_no <= 3").groupBy(F.col("session_id").alias("item_id")).agg(F.array_sort(F.collect_list(F.struct("row_no", "role", "content"))).alias("s")).filter("size(s) = 3")
    items = p.select("item_id", F.array(F.lit("2026/01/01")).alias("dates"), F.array(F.transform("s", lambda m: F.struct(m["role"].alias("role"), m["content"].alias("content")))).alias("sessions"))
    return loaders.dated_messages(items).select("item_id", F.col("message_no").cast("long").alias("message_no"), "role", "content")


@query()
def demo_events(spark, sf):
    """The session of fourteen events that comes with the package."""
    return loaders.demo_session(spark).drop("received_at", "meta")


# --- woven contexts ---------------------------------------------------------------------------------------------------
_STEPS = rf"""r AS (SELECT DISTINCT trajectory_id, row_no, id, lower(trim(role)) AS role, content, len(tool_calls) AS n_calls, tool_calls[1].function.name AS fn, tool_calls[1].function.arguments AS args FROM oh_rows),
 q AS (SELECT *, lead(role) OVER w AS next_role, lead(content) OVER w AS next_content FROM r WINDOW w AS (PARTITION BY trajectory_id ORDER BY row_no)),
 st AS (SELECT trajectory_id AS session_id, row_number() OVER (PARTITION BY trajectory_id ORDER BY row_no) - 1 AS idx, coalesce(fn, '') || ' ' || coalesce(args, '') AS action, coalesce(next_content, '') AS observation, CASE WHEN coalesce(next_content, '') = '' THEN 'unknown' WHEN regexp_matches(next_content, '{T.FAILURE_LINE}') THEN 'failed' ELSE 'passed' END AS validation
  FROM q WHERE role IN ('assistant', 'ai', 'model') AND n_calls > 0 AND next_role IN ('tool', 'function')),
 tm AS (SELECT DISTINCT session_id, idx, unnest(regexp_extract_all(lower(action || ' ' || observation), '[a-z0-9]+')) AS term FROM st), ra AS (SELECT session_id, term FROM tm GROUP BY ALL HAVING count(*) BETWEEN 2 AND 8),
 sc AS (SELECT a.session_id, a.idx, b.idx AS parent, least(count(*), 10) AS score FROM tm a JOIN ra USING (session_id, term) JOIN tm b ON b.session_id = a.session_id AND b.term = a.term AND b.idx < a.idx GROUP BY ALL),
 pa AS (SELECT sc.session_id, sc.idx, sc.parent, CAST(row_number() OVER (PARTITION BY sc.session_id, sc.idx ORDER BY score DESC, sc.parent DESC) AS INT) AS rank FROM sc JOIN st ON st.session_id = sc.session_id AND st.idx = sc.parent AND st.validation <> 'failed' QUALIFY rank <= 3)"""


def _steps(spark, sf):
    """Steps of the trajectories: a call, what it showed, and whether that was a failure."""
    r = first_rows(read_table(spark, sf, "oh_rows"), ["trajectory_id", "row_no"]).select("trajectory_id", "row_no", "role", "content", "tool_calls").withColumn("role", F.lower(F.trim("role")))
    r = ranked(r, ["trajectory_id"], ["row_no"], "at")
    nxt = r.select("trajectory_id", (F.col("at") - 1).alias("at"), F.col("content").alias("shown"), F.col("role").alias("next_role"))
    m = r.join(nxt, ["trajectory_id", "at"]).filter(F.col("role").isin("assistant", "ai", "model") & (F.size("tool_calls") > 0) & F.col("next_role").isin("tool", "function"))
    f = F.get("tool_calls", F.lit(0))["function"]
    m = ranked(m, ["trajectory_id"], ["at"], "idx")
    return cut(m.select(F.col("trajectory_id").alias("session_id"), "idx", F.concat_ws(" ", F.coalesce(f["name"], F.lit("")), F.coalesce(f["arguments"], F.lit(""))).alias("action"), F.coalesce("shown", F.lit("")).alias("observation"), T.validation(F.col("shown")).alias("validation")))


def _links(steps):
    return weave.parents(weave.scored_pairs(steps.select("session_id", "idx", F.concat_ws(" ", "action", "observation").alias("text"))), steps)


@query(f"WITH {_STEPS} SELECT session_id, idx, parent, rank FROM pa")
def step_parents(spark, sf):
    """The three earlier steps that a step shares most rare terms with."""
    return _links(_steps(spark, sf))


@query()
def step_ancestry(spark, sf):
    """Five steps at most that the last step of a trajectory rests on."""
    s = _steps(spark, sf)
    return weave.ancestry(_links(s), s.groupBy("session_id").agg(F.max("idx").alias("anchor")))


@query(f"""WITH {_STEPS}, la AS (SELECT session_id, max(idx) AS anchor, count(*) AS n FROM st GROUP BY 1), ke AS (SELECT session_id, anchor AS idx FROM la UNION SELECT pa.session_id, parent FROM pa JOIN la ON la.session_id = pa.session_id AND la.anchor = pa.idx),
 pt AS (SELECT st.*, la.n, 'step ' || st.idx || ' | ' || validation || chr(10) || 'action: ' || action || chr(10) || 'observation: ' || CASE WHEN ke.idx IS NOT NULL OR n <= 5 THEN observation ELSE '[observation omitted]' END AS p, ke.idx IS NOT NULL OR n <= 5 AS whole FROM st JOIN la USING (session_id) LEFT JOIN ke ON ke.session_id = st.session_id AND ke.idx = st.idx)
 SELECT session_id, md5(string_agg(p, chr(10) || chr(10) ORDER BY idx)) AS digest, count(*) FILTER (WHERE whole) AS n_full FROM pt GROUP BY 1""")
def woven_contexts(spark, sf):
    """Trajectories with the last step and its parents in full, the other observations left out."""
    s = _steps(spark, sf)
    last = s.groupBy("session_id").agg(F.max("idx").alias("idx"))
    kept = last.unionByName(_links(s).join(last, ["session_id", "idx"]).select("session_id", F.col("parent").alias("idx")))
    return weave.woven(weave.engaged(s, s.select("session_id", F.lit("tool_call").alias("kind"))), kept).select("session_id", F.md5("context").alias("digest"), "n_full")


@query(f"WITH {_STEPS}, rk AS (SELECT session_id, idx, parent, row_number() OVER (PARTITION BY session_id, idx ORDER BY score DESC, parent DESC) AS r FROM sc), tr AS (SELECT session_id, idx, idx - 1 AS parent FROM st WHERE idx > 0) SELECT count(*) AS n, round(avg(CASE WHEN r <= 3 THEN 1.0 ELSE 0.0 END), 6) AS hit, round(avg(r), 6) AS rank FROM tr LEFT JOIN rk USING (session_id, idx, parent)")
def positive_control(spark, sf):
    """How often the step before is among a step's three best."""
    s = _steps(spark, sf)
    pairs = weave.scored_pairs(s.select("session_id", "idx", F.concat_ws(" ", "action", "observation").alias("text")))
    key = F.concat_ws(":", "session_id", "idx").alias("id")
    return metrics.positive_control(pairs.select(key, "parent", "score"), s.filter("idx > 0").select(key, (F.col("idx") - 1).alias("parent")))


@query("WITH r AS (SELECT doc_id AS item_id, ['A1', 'A2', 'A3', 'A4'][doc_id % 4 + 1] AS arm, length(coalesce(text, '')) % 2 AS c FROM documents UNION ALL SELECT doc_id, ['A2', 'A3', 'A4', 'A1'][doc_id % 4 + 1], length(coalesce(text, '')) % 3 // 2 FROM documents), p AS (SELECT item_id, max(c) FILTER (WHERE arm = 'A1') AS a1, max(c) FILTER (WHERE arm = 'A2') AS a2, max(c) FILTER (WHERE arm = 'A3') AS a3, max(c) FILTER (WHERE arm = 'A4') AS a4 FROM r GROUP BY 1) SELECT count(*) AS n_items, round(avg(a1), 6) AS a1, round(avg(a2), 6) AS a2, round(avg(a3), 6) AS a3, round(avg(a2 - a1), 6) AS gain_closure, round(avg(a3 - a2), 6) AS loss_router, round(avg(a4 - a3), 6) AS loss_closure FROM p")
def arm_summary(spark, sf):
    """Accuracy by arm and gains on the items that two arms ran."""
    d = read_table(spark, sf, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n"))
    arm = lambda *names: F.element_at(F.array(*map(F.lit, names)), (F.col("doc_id") % 4 + 1).cast("int"))
    a = d.select(F.col("doc_id").alias("item_id"), arm("A1", "A2", "A3", "A4").alias("arm"), (F.col("n") % 2 == 1).alias("correct"))
    b = d.select(F.col("doc_id").alias("item_id"), arm("A2", "A3", "A4", "A1").alias("arm"), (F.col("n") % 3 == 2).alias("correct"))
    return metrics.arm_summary(a.unionByName(b))


@query()
def cluster_bootstrap(spark, sf):
    """Resampled languages for the difference of documents."""
    d = read_table(spark, sf, "documents").filter("text is not null and n_chars is not null")
    return metrics.bootstrap(d.select(F.coalesce(F.lower("lang"), F.lit("none")).alias("cluster"), (F.col("n_chars") % 3 - F.length("text") % 2).alias("diff")))


@query(f"WITH {EV}, u AS (SELECT session_id, event_id, pos, text, (strlen(coalesce(text, '')) + 3) // 4 AS own FROM ev WHERE kind = 'user'), s AS (SELECT *, 100 - (sum(own) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) - own) AS room FROM u) SELECT session_id, event_id, CAST(least(own, room) AS BIGINT) AS tokens, CAST(least(length(text), room * 4) AS INT) AS kept_chars FROM s WHERE room > 0 AND own > 0")
def newest_messages_cut(spark, sf):
    """The newest messages of users in 100 tokens of bytes, the last one cut."""
    u = _ev(spark, sf).filter("kind = 'user'").select("session_id", "event_id", "pos", "text")
    return packing.tail_cut(u, ["session_id"], ["pos"], "text", 100).select("session_id", "event_id", "tokens", "kept_chars")


@query(f"WITH {EV} SELECT session_id, CAST(sum(cost) AS BIGINT) AS cost, sum(cost) <= 2048 AS fits FROM ev WHERE kind IN ('decision', 'state') GROUP BY 1")
def gold_fits(spark, sf):
    """Whether what an item must rest on fits the budget at all."""
    ev = _ev(spark, sf).filter("kind in ('decision', 'state')").withColumn("cost", F.coalesce(T.tokens_floor(F.col("text")), F.lit(0)))
    return ev.groupBy("session_id").agg(F.sum("cost").cast("long").alias("cost")).withColumn("fits", F.col("cost") <= 2048)
