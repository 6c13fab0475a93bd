"""Registered queries of recall, restore, paging and packets, with SQL where it can say them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import assembler, closure, graph, packing, retrieval
from packetloom.operators import recall as R
from packetloom.plans.closure_queries import ASKED, _asked, _newest
from packetloom.plans.graph_queries import EVM, SEARCH, _context, _ev, _trace, graph_newest
from packetloom.plans.reference_queries import EV, MATERIAL
from packetloom.runtime import cut, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(fn):
        QUERIES[name or fn.__name__] = fn
        if sql:
            ORACLE[name or fn.__name__] = sql
        return fn

    return add


def _bm25_sessions(source: str) -> str:
    return f"""bd AS (SELECT session_id, event_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM {source}), bn AS (SELECT session_id, CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS avgdl FROM bd GROUP BY 1),
 bp AS (SELECT session_id, event_id, dl, term, count(*) AS tf FROM (SELECT session_id, event_id, len(terms) AS dl, unnest(terms) AS term FROM bd) GROUP BY ALL), bf AS (SELECT session_id, term, count(*) AS df FROM bp GROUP BY ALL),
 bq AS (SELECT term, count(*) AS qtf FROM (SELECT unnest(regexp_extract_all(lower('{ASKED}'), '[a-z0-9]+')) AS term) GROUP BY 1),
 bs AS (SELECT session_id, event_id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf) AS score FROM bp JOIN bf USING (session_id, term) JOIN bq USING (term) JOIN bn USING (session_id) GROUP BY ALL)"""


@query(f"WITH {EVM}, {MATERIAL}, {SEARCH}, {_bm25_sessions('se')} SELECT d.session_id, d.event_id, round(coalesce(score, 0), 6) AS score, CAST(row_number() OVER (PARTITION BY d.session_id ORDER BY round(coalesce(score, 0), 6) DESC, d.event_id) - 1 AS INT) AS rank FROM bd d LEFT JOIN bs ON bs.session_id = d.session_id AND bs.event_id = d.event_id QUALIFY rank < 300")
def session_ranking(spark, sf):
    """The searchable events of every session, ranked for one question; those without its words follow by id."""
    docs = cut(graph.searchable(*_context(spark, sf)).select("session_id", "event_id", "text"))
    q = docs.select(F.col("session_id").alias("query_id"), "session_id", F.lit(ASKED).alias("query")).distinct()
    return R.ranked_events(docs, q).select("session_id", "event_id", "score", "rank")


def _questions(ev: DataFrame) -> DataFrame:
    """Every session is asked for its newest instruction; sessions without one for a fixed question."""
    q = ev.select("session_id").distinct().join(graph_newest(ev), "session_id", "left")
    return q.select(F.col("session_id").alias("query_id"), "session_id", F.coalesce("query", F.lit(ASKED)).alias("query"), F.lit(R.BUDGET).alias("budget"))


@query()
def recall(spark, sf):
    """The product's answer for every session: one row a question, also where nothing is found."""
    ev, e = _context(spark, sf)
    return R.recall(ev, e, _questions(ev)).drop("event_ids")


@query()
def post_compact(spark, sf):
    """What is put back into every session after a compaction."""
    return R.restore(*_context(spark, sf))


@query(f"""WITH {EV}, t AS (SELECT session_id, arg_max(event_id, pos) AS event_id FROM ev WHERE kind = 'tool_result' AND text IS NOT NULL GROUP BY 1), l AS (SELECT t.session_id, t.event_id, string_split(e.text, chr(10)) AS lines FROM t JOIN ev e USING (session_id, event_id)),
 x AS (SELECT session_id, event_id, len(lines) AS n_lines, i, lines[i] AS line FROM l, unnest(range(2, len(lines) + 1)) AS u(i)), r AS (SELECT *, sum((length(line) + 3) // 4 + 1) OVER (PARTITION BY session_id ORDER BY i) AS used FROM x)
 SELECT session_id, event_id, CAST(max(i) AS INT) AS end_line, CAST(any_value(n_lines) AS INT) AS n_lines, CASE WHEN max(i) < any_value(n_lines) THEN CAST(max(i) + 1 AS INT) END AS next_line FROM r WHERE used <= 60 OR i = 2 GROUP BY session_id, event_id""")
def expand_pages(spark, sf):
    """The newest output of every session from its second line on, as far as 60 tokens reach."""
    ev = cut(_ev(spark, sf))
    t = ev.filter("kind = 'tool_result' and text is not null").groupBy("session_id").agg(F.max_by("event_id", "pos").alias("ref"))
    r = t.select(F.col("session_id").alias("request_id"), "session_id", "ref", F.lit(2).alias("start_line"), F.lit(60).alias("max_tokens"))
    return R.expand(ev, r).select(F.col("request_id").alias("session_id"), "event_id", "end_line", "n_lines", "next_line")


# --- packets --------------------------------------------------------------------------------------------------------
BUDGETS = (0, 1, 46, 199, 200, 2_048)


def _recent(ev: DataFrame, n: int) -> DataFrame:
    top = ev.groupBy("session_id").agg(F.max("pos").alias("top"))
    return ev.join(top, "session_id").withColumn("rank", (F.col("top") - F.col("pos")).cast("int")).filter(F.col("rank") < n).select("session_id", "event_id", "rank")


def _budgeted(spark, sf, mode: str, p: assembler.Packing, closure_mode: str):
    """(queries, seeds, nodes, steps, events) of the newest twelve events of every session at all budgets."""
    ev, e = _trace(spark, sf)
    ev = ev.withColumn("cost", T.tokens_floor(F.coalesce("text", F.lit(""))))
    at = _recent(ev, 12).withColumn("budget", F.explode(F.array(*map(F.lit, BUDGETS)))).withColumn("query_id", F.concat_ws("@", "session_id", "budget"))
    at = cut(at)
    q = at.select("query_id", "session_id", F.lit(ASKED).alias("query"), F.lit(mode).alias("query_mode"), "budget").distinct()
    s = at.select("query_id", "event_id", "rank", F.lit("recent").alias("source"), F.lit(False).alias("pinned"))
    nodes, steps = closure.close(q, s, ev, e, mode=closure_mode)
    return assembler.assemble(q, s, nodes, steps, ev, p)


@query(f"""WITH RECURSIVE {EV}, sd AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) - 1 AS rank FROM ev QUALIFY rank < 12), un AS (SELECT session_id, coalesce('g:' || atomic_group, 'e:' || event_id) AS unit, min(rank) AS r, sum(cost) AS c, min({{'t': ts, 'i': event_id}}) AS f, list(event_id) AS ids FROM sd GROUP BY ALL),
 o AS (SELECT u.*, b.b AS budget, row_number() OVER (PARTITION BY session_id, b.b ORDER BY r, f.t, f.i, unit) AS rn FROM un u, (SELECT unnest({list(BUDGETS)}) AS b) b),
 fl AS (SELECT session_id, budget, rn, CASE WHEN c <= budget THEN c ELSE 0 END AS used, c <= budget AS kept FROM o WHERE rn = 1 UNION ALL
  SELECT o.session_id, o.budget, o.rn, fl.used + CASE WHEN fl.used + o.c <= o.budget THEN o.c ELSE 0 END, fl.used + o.c <= o.budget FROM o JOIN fl ON fl.session_id = o.session_id AND fl.budget = o.budget AND o.rn = fl.rn + 1),
 i AS (SELECT session_id, budget, unnest(ids) AS event_id, kept FROM o JOIN fl USING (session_id, budget, rn)), j AS (SELECT i.*, e.ts, e.cost, coalesce(e.text, '') AS text FROM i JOIN ev e USING (session_id, event_id)),
 g AS (SELECT session_id, budget, coalesce(sum(cost) FILTER (WHERE kept), 0) AS total_tokens, count(*) FILTER (WHERE kept) AS n_entries, count(*) FILTER (WHERE NOT kept) > 0 AS incomplete, coalesce(string_agg(event_id, ',' ORDER BY event_id) FILTER (WHERE NOT kept), '') AS missing,
  coalesce(string_agg(text, chr(10) || chr(10) ORDER BY ts, event_id) FILTER (WHERE kept), '') AS context, coalesce(string_agg(event_id || '|raw_text|' || cost || '|seed:recent', chr(10) ORDER BY ts, event_id) FILTER (WHERE kept), '') AS man FROM j GROUP BY ALL)
 SELECT session_id || '@' || budget AS query_id, CAST(total_tokens AS BIGINT) AS total_tokens, CAST(n_entries AS INT) AS n_entries, incomplete, missing, md5(context) AS context_md5, sha256('{ASKED}' || chr(10) || 'lookup' || chr(10) || budget || chr(10) || man || chr(10) || missing) AS digest FROM g""")
def packet_digests(spark, sf):
    """Packets of the newest events at six budgets: atomic groups whole, what is missing named, one digest each."""
    p = _budgeted(spark, sf, "lookup", assembler.Packing(excerpt=False), "off")[1]
    return p.select("query_id", "total_tokens", "n_entries", "incomplete", F.array_join("missing_required", ",").alias("missing"), F.md5("context").alias("context_md5"), "digest")


@query()
def packet_entries(spark, sf):
    """Entries of evidence-first packets over the native closure, with excerpts, shares and held units."""
    return _budgeted(spark, sf, "why", assembler.PRESETS["evidence_first_x"], "native")[0].drop("text")


@query()
def packet_missing(spark, sf):
    """Tiered packets at six budgets and what they leave out."""
    return _budgeted(spark, sf, "why", assembler.Packing(pack="tiered", evidence_share=0.5), "native")[1].select("query_id", "total_tokens", "n_entries", "incomplete", F.size("missing_required").alias("n_missing"), F.size("omitted_optional").alias("n_omitted"), "digest")


@query()
def gated_recall(spark, sf):
    """Packets by evidence where a question's seeds hang on a chain of two or more value edges, else by rank alone."""
    ev, e = _trace(spark, sf)
    ev = ev.withColumn("cost", T.tokens_floor(F.coalesce("text", F.lit(""))))
    q = ev.select(F.col("session_id").alias("query_id"), "session_id", F.lit(ASKED).alias("query"), F.lit("why").alias("query_mode"), F.lit(R.BUDGET).alias("budget")).distinct()
    s = cut(graph.paired_seeds(R.ranked_events(ev.select("session_id", "event_id", "text"), q, 8).select("session_id", "event_id", "rank"), e.filter("edge_type = 'RESULT_OF'")).withColumn("query_id", F.col("session_id")))
    deep = graph.chain_depth(s.select("session_id", "event_id"), e).filter("depth >= 2").select(F.col("session_id").alias("query_id"))
    s = s.select("query_id", "event_id", F.col("rank").cast("int").alias("rank"), F.lit("lexical").alias("source"), F.lit(False).alias("pinned"))
    out = None
    for gate, how, preset, mode in ((True, "left_semi", assembler.PRESETS["evidence_first_x"], "native"), (False, "left_anti", assembler.PRESETS["chrono"], "off")):
        part = cut(q.join(deep, "query_id", how))
        seeds = s.join(part.select("query_id"), "query_id", "left_semi")
        nodes, steps = closure.close(part, seeds, ev, e, mode=mode, max_hops=12)
        d = assembler.assemble(part, seeds, nodes, steps, ev, preset)[1].withColumn("gate", F.lit(gate))
        out = d if out is None else out.unionByName(d)
    return out.select("query_id", "gate", "total_tokens", "n_entries", "incomplete", "digest")


@query(f"WITH {EV} SELECT * FROM (SELECT session_id, event_id, cost, CAST(sum(cost) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ev WHERE kind = 'user') WHERE used <= 512")
def newest_user_words(spark, sf):
    """The newest messages of users that fit, noise aside from the packet's other records."""
    items = _ev(spark, sf).filter("kind = 'user'").withColumn("cost", F.coalesce(T.tokens_floor(F.col("text")), F.lit(0))).select("session_id", "event_id", "pos", "cost")
    return packing.tail(items, ["session_id"], ["pos"], "cost", 512).select("session_id", "event_id", "cost", "used")


# --- seeds ------------------------------------------------------------------------------------------------------------
def _session_questions(ev: DataFrame) -> DataFrame:
    """A question a session that names its newest step, a call and a path beside plain words."""
    g = ev.groupBy("session_id").agg(F.max_by("step_id", F.when(F.col("step_id").isNotNull(), F.col("pos"))).alias("s"), F.max_by("tool_call_id", F.when(F.col("tool_call_id").isNotNull(), F.col("pos"))).alias("c"), F.max("event_id").alias("e"))
    return g.select(F.col("session_id").alias("query_id"), "session_id", F.concat(F.lit("what did step "), F.coalesce("s", F.lit("none")), F.lit(" and tool call "), F.coalesce("c", F.lit("none")), F.lit(" say about event "), "e", F.lit("?")).alias("query"))


_QUESTIONS = "qs AS (SELECT session_id, 'what did step ' || coalesce(arg_max(step_id, pos) FILTER (WHERE step_id IS NOT NULL), 'none') || ' and tool call ' || coalesce(arg_max(tool_call_id, pos) FILTER (WHERE tool_call_id IS NOT NULL), 'none') || ' say about event ' || max(event_id) || '?' AS query FROM ev GROUP BY 1)"
_REF_SQL = " UNION ALL ".join(
    f"SELECT session_id, '{kind}' AS ref_kind, {'trim(raw)' if kind == 'quoted' else 'raw'} AS raw FROM (SELECT session_id, unnest(regexp_extract_all(query, {retrieval_rx}, 1)) AS raw FROM qs)" + (" WHERE length(raw) >= 2 AND (regexp_matches(raw, '[0-9_\\-./:]') OR length(raw) >= 8)" if kind == "bare" else "")
    for kind, retrieval_rx in ((k, "'" + rx.replace("'", "''") + "'") for k, rx in retrieval.REFERENCES)
)


@query(f"WITH {EV}, {_QUESTIONS}, rf AS ({_REF_SQL}) SELECT session_id, ref_kind, lower(raw) AS low, count(*) OVER (PARTITION BY session_id) AS of_session FROM (SELECT DISTINCT session_id, ref_kind, lower(raw) AS raw FROM rf)")
def explicit_references(spark, sf):
    """What questions name: steps, calls, events, quoted and bare ids."""
    r = retrieval.references(_session_questions(_ev(spark, sf))).select("session_id", "ref_kind", F.lower("raw").alias("low"))
    return r.join(r.groupBy("session_id").agg(F.count("*").alias("of_session")), "session_id")


_N = lambda c: f"regexp_replace(lower({c}), '[^a-z0-9]', '', 'g')"


def _resolve_sql() -> str:
    parts = []
    for column, kind in (("step_id", "step"), ("tool_call_id", "tool_call"), ("event_id", "event")):
        for prefix in retrieval.PREFIXES[kind]:
            parts.append(f"SELECT r.session_id, r.ref_kind, r.raw, e.event_id, e.ts FROM rf r JOIN ev e ON e.session_id = r.session_id AND {_N('e.' + column)} = '{prefix}' || {_N('r.raw')} WHERE r.ref_kind IN ('{kind}', 'bare', 'quoted') AND ({_N('r.raw')} <> '' OR r.ref_kind = 'quoted')")
    return " UNION ".join(parts)


@query(f"WITH {EV}, {_QUESTIONS}, rf AS (SELECT session_id, ref_kind, min(raw) AS raw FROM ({_REF_SQL}) GROUP BY session_id, ref_kind, lower(raw)), hits AS ({_resolve_sql()}) SELECT DISTINCT session_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY session_id, ref_kind, raw ORDER BY ts, event_id) AS r FROM hits) WHERE r <= 8")
def pinned_references(spark, sf):
    """The events that steps, calls and event ids in questions name, at most eight for a reference."""
    ev = cut(_ev(spark, sf))
    return retrieval.pins(_session_questions(ev), ev, paths=False).select("session_id", "event_id")


@query()
def hybrid_pin(spark, sf):
    """Pins, paths included, before the words' list, to eight seeds or as many as are pinned."""
    ev = cut(_ev(spark, sf))
    q = cut(_session_questions(ev))
    fill = R.ranked_events(ev.select("session_id", "event_id", "text"), q, 64)
    pin = retrieval.pins(q, ev).select("query_id", "session_id", "event_id", "rank")
    return retrieval.pinned(pin, fill.select("query_id", "session_id", "event_id", "rank"), ["session_id", "event_id"], 8)


@query(f"WITH {EV} SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY pos DESC) - 1 AS INT) AS rank FROM ev WHERE kind = 'tool_result' QUALIFY rank < 3")
def recent_seeds(spark, sf):
    return retrieval.recent_seeds(_ev(spark, sf), 3)


@query(f"WITH {EV} SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY event_id DESC) - 1 AS INT) AS rank FROM ev WHERE kind = 'decision'")
def given_seeds(spark, sf):
    """Listed ids as seeds, in the order of the list."""
    ev = cut(_ev(spark, sf))
    gold = ev.filter("kind = 'decision'").groupBy("session_id").agg(F.sort_array(F.collect_list("event_id"), asc=False).alias("ids")).withColumn("query_id", F.col("session_id"))
    return retrieval.given_seeds(gold, ev).select("session_id", "event_id", F.col("rank").cast("int").alias("rank"))


@query("SELECT doc_id, CAST(greatest(8, least(64, n_chars // 100)) AS INT) AS k FROM documents WHERE n_chars IS NOT NULL")
def auto_k(spark, sf):
    """Records to rank, with the length of a document as the budget."""
    return read_table(spark, sf, "documents").filter("n_chars is not null").select("doc_id", R.auto_k(F.col("n_chars")).alias("k"))


@query()
def identifier_chase(spark, sf):
    """Four rounds of identifiers from the best eight records of every session's question."""
    ev = cut(_ev(spark, sf))
    q = cut(_questions(ev).select("query_id", "session_id", "query"))
    seeds = R.ranked_events(ev.select("session_id", "event_id", "text"), q, 8)
    return retrieval.identifier_chase(seeds, q, ev)


@query()
def hashed_embeddings(spark, sf):
    """Signed hashing of words of documents."""
    return retrieval.embedded(read_table(spark, sf, "documents"), ["doc_id"]).select("doc_id", F.transform("embedding", lambda x: F.round(x, 6)).alias("embedding"))
