"""Registered queries of the evidence engine, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import closure, events, metrics, packing, retrieval
from packetloom.runtime import cut, filled, first_rows, ranked, read_table, round6

BUDGET = 2_048
RECALL_BUDGET, CANDIDATES = 2_000, 300
WINDOW = 32_768

QUERIES, ORACLE = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _ev(spark: SparkSession, sf: str) -> DataFrame:
    return events.canonical(read_table(spark, sf, "trace_events").select("session_id", "event_id", "kind", "text", "ts", "step_id", "tool_call_id", "atomic_group", "received_at"))


def _costed(spark: SparkSession, sf: str) -> DataFrame:
    return _ev(spark, sf).withColumn("cost", F.coalesce(T.tokens_floor(F.col("text")), F.lit(0)))


EV = """ev AS (SELECT *, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id) - 1 AS BIGINT) AS pos, coalesce(length(text) // 4, 0) AS cost FROM
 (SELECT DISTINCT session_id, event_id, kind, text, coalesce(ts, 0) AS ts, step_id, tool_call_id, atomic_group FROM trace_events))"""
_B = r"[^\p{L}\p{N}_.\-]"
_W = r"[\p{L}\p{N}_.\-]"


def _values_sql(pattern: str, inner: str) -> str:
    """Whole values of one type; letters between values are doubled so that neighbours do not share their border."""
    return f"list_filter(list_distinct(regexp_extract_all(regexp_replace(text, '([^\\p{{L}}\\p{{N}}_.\\-{inner}])', '\\1\\1', 'g'), '(?:^|{_B})({pattern})(?:$|{_B})', 1)), lambda v: length(v) BETWEEN 6 AND 120)"


_EXTENSIONS = "py|md|sh|json|txt|csv|yaml|yml|tsv|png"
VALUES = (
    ("path", f"list_filter({_values_sql(f'(?:{_W}+/)+{_W}+[.](?:{_EXTENSIONS})', '/')}, lambda v: NOT regexp_matches(v, '[.](?:{_EXTENSIONS}|jsonl)/'))"),
    ("fileline", _values_sql(r"[\p{L}\p{N}_./\-]+[.](?:py|sh|md|json|txt):[0-9]{1,6}", "/:")),
    ("hash", _values_sql("[0-9a-f]{8,40}", "")), ("number", _values_sql(r"[0-9]{3,10}(?:[.][0-9]+)?", "")), ("version", _values_sql(r"[0-9]+[.][0-9]+[.][0-9]+", "")),
)
RESULT_OF = """ro AS (SELECT r.session_id, r.event_id AS src_id, c.event_id AS dst_id, 'RESULT_OF' AS edge_type, CAST(NULL AS VARCHAR) AS predicate FROM ev r JOIN
 (SELECT session_id, tool_call_id, arg_min(event_id, pos) AS event_id, min(pos) AS pos FROM ev WHERE kind = 'tool_call' AND tool_call_id IS NOT NULL GROUP BY ALL) c
 ON r.session_id = c.session_id AND r.tool_call_id = c.tool_call_id AND c.pos < r.pos WHERE r.kind = 'tool_result')"""
DEPENDS = f"""vals AS (SELECT session_id, event_id, pos, kind, value, min(type_no) AS type_no FROM ({' UNION ALL '.join(f"SELECT session_id, event_id, pos, kind, unnest({sql}) AS value, {n} AS type_no FROM ev WHERE kind IN ('assistant', 'tool_call', 'tool_result')" for n, (_, sql) in enumerate(VALUES))}) GROUP BY ALL),
 rare AS (SELECT session_id, value, count(*) FILTER (WHERE kind = 'tool_result') AS n_src, min(pos) FILTER (WHERE kind = 'tool_result') AS first_src, min(pos) FILTER (WHERE kind <> 'tool_result') AS first_use FROM vals GROUP BY ALL HAVING n_src BETWEEN 1 AND 3 AND first_use >= first_src),
 near AS (SELECT c.session_id, c.event_id, c.value, c.type_no, n_src, max(s.pos) AS src_pos, arg_max(s.event_id, s.pos) AS src_event FROM vals c JOIN rare USING (session_id, value)
  JOIN vals s ON s.session_id = c.session_id AND s.value = c.value AND s.kind = 'tool_result' AND s.pos < c.pos WHERE c.kind <> 'tool_result' GROUP BY ALL),
 one AS (SELECT session_id, event_id, src_pos, src_event, min({{'n': n_src, 't': [{', '.join(repr(t) for t in T.VALUE_TYPES)}][type_no + 1], 'v': value}}) AS v FROM near GROUP BY ALL),
 dv AS (SELECT session_id, event_id AS src_id, src_event AS dst_id, 'DEPENDS_ON' AS edge_type, 'value:' || v.t AS predicate FROM one QUALIFY row_number() OVER (PARTITION BY session_id, event_id ORDER BY v.n, src_pos DESC, v.t, v.v) <= 4)"""
MATERIAL = """mt AS (SELECT e.session_id, s.event_id AS src_id, e.event_id AS dst_id, 'MATERIALIZES' AS edge_type, 'summary' AS predicate FROM ev e JOIN
 (SELECT session_id, event_id, pos, coalesce(lag(pos) OVER (PARTITION BY session_id ORDER BY pos), -1) AS after FROM ev WHERE kind = 'summary') s
 ON e.session_id = s.session_id AND e.pos > s.after AND e.pos < s.pos WHERE e.kind <> 'summary')"""
SUPER = r"""sp AS (SELECT * FROM (SELECT session_id, event_id AS src_id, lag(event_id) OVER (PARTITION BY session_id, path ORDER BY pos) AS dst_id, 'SUPERSEDES' AS edge_type, path AS predicate FROM
 (SELECT *, nullif(regexp_extract(text, '"file_path": "([^"]+)"', 1), '') AS path FROM ev WHERE kind = 'tool_call' AND regexp_matches(text, '^(?:Edit|MultiEdit|Write|NotebookEdit) ')) WHERE path IS NOT NULL) WHERE dst_id IS NOT NULL)"""
EDGE_COLUMNS = "session_id, src_id, dst_id, edge_type, predicate"


@query(f"WITH {EV} SELECT session_id, event_id, pos, kind, ts, cost FROM ev")
def events_canonical(spark, sf):
    return _costed(spark, sf).select("session_id", "event_id", "pos", "kind", "ts", "cost")


@query(f"""WITH {EV} SELECT session_id, {', '.join(f"count(*) FILTER (WHERE kind = '{k}') AS n_{k}" for k in ('user', 'assistant', 'tool_call', 'tool_result', 'decision', 'summary', 'state'))}, count(*) AS n_events,
 max(ts) - min(ts) AS timespan, count(DISTINCT tool_call_id) AS n_calls, count(DISTINCT step_id) AS n_steps, count(DISTINCT atomic_group) AS n_groups, CAST(sum(cost) AS BIGINT) AS tokens FROM ev GROUP BY session_id""")
def graph_stats(spark, sf):
    return events.stats(_ev(spark, sf))


@query(f"WITH {EV}, {RESULT_OF} SELECT {EDGE_COLUMNS} FROM ro")
def edges_result_of(spark, sf):
    return events.result_of(_ev(spark, sf))


@query(f"WITH {EV} SELECT * FROM (SELECT session_id, event_id AS src_id, lag(event_id) OVER (PARTITION BY session_id ORDER BY pos) AS dst_id, 'TEMPORAL' AS edge_type, CAST(NULL AS VARCHAR) AS predicate FROM ev) WHERE dst_id IS NOT NULL")
def edges_temporal(spark, sf):
    return events.temporal(_ev(spark, sf))


@query(f"WITH {EV}, {MATERIAL} SELECT {EDGE_COLUMNS} FROM mt")
def edges_materializes(spark, sf):
    return events.materializes(_ev(spark, sf))


@query(f"WITH {EV}, {DEPENDS} SELECT {EDGE_COLUMNS} FROM dv")
def edges_depends_value(spark, sf):
    return events.depends_value(_ev(spark, sf))


@query(f"""WITH {EV}, {RESULT_OF}, {DEPENDS}, {MATERIAL}, {SUPER}, e AS (SELECT {EDGE_COLUMNS} FROM ro UNION ALL SELECT {EDGE_COLUMNS} FROM dv UNION ALL SELECT {EDGE_COLUMNS} FROM mt UNION ALL SELECT {EDGE_COLUMNS} FROM sp)
 SELECT session_id, edge_type, count(*) AS n_edges, count(DISTINCT src_id) AS n_sources, count(DISTINCT dst_id) AS n_targets FROM e GROUP BY ALL""")
def graph_edges(spark, sf):
    e = events.all_edges(cut(_ev(spark, sf))).filter("edge_type <> 'TEMPORAL'")
    return e.groupBy("session_id", "edge_type").agg(F.count("*").alias("n_edges"), F.countDistinct("src_id").alias("n_sources"), F.countDistinct("dst_id").alias("n_targets"))


@query("""WITH s AS (SELECT user_id, ts, event_id, CASE event_type WHEN 'click' THEN 1 ELSE -1 END AS step FROM events WHERE event_type IN ('click', 'view')),
 r AS (SELECT *, sum(step) OVER w AS run FROM s WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)),
 l AS (SELECT *, least(min(run) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING), 0) AS low FROM r),
 v AS (SELECT *, step = -1 AND low = coalesce(lag(low) OVER (PARTITION BY user_id ORDER BY ts, event_id), 0) AS served FROM l),
 k AS (SELECT *, sum(CASE WHEN step = 1 THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kc, sum(CASE WHEN served THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS kr FROM v)
 SELECT a.user_id, CAST(a.kr AS BIGINT) AS k, a.event_id AS result_id, b.event_id AS call_id FROM k a JOIN k b ON a.user_id = b.user_id AND a.kr = b.kc AND b.step = 1 WHERE a.served""")
def fifo_pairs(spark, sf):
    e = read_table(spark, sf, "events").select("user_id", "ts", "event_id", "event_type")
    d = events.fifo_pairs(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "click", F.col("event_type") == "view")
    return d.select("user_id", "k", F.col("r.event_id").alias("result_id"), F.col("c.event_id").alias("call_id"))


@query("""WITH RECURSIVE n AS (SELECT session_id, uuid, min({'l': line_no, 'p': coalesce(parentUuid, ''), 'k': coalesce(type IN ('user', 'assistant') AND NOT coalesce(isSidechain, false), false)}) AS v FROM claude_rows WHERE uuid IS NOT NULL GROUP BY ALL),
 m AS (SELECT session_id, uuid, nullif(v.p, '') AS parent, v.k AS kept FROM n),
 w AS (SELECT session_id, uuid, parent AS at, 1 AS hop FROM m WHERE kept AND parent IS NOT NULL
  UNION ALL SELECT w.session_id, w.uuid, m.parent, hop + 1 FROM w JOIN m ON w.session_id = m.session_id AND w.at = m.uuid WHERE NOT m.kept AND hop < 64 AND m.parent IS NOT NULL)
 SELECT w.session_id, w.uuid AS src_id, w.at AS dst_id, CASE WHEN hop > 1 THEN 'parent:transitive' ELSE 'parent' END AS predicate FROM w JOIN m ON w.session_id = m.session_id AND w.at = m.uuid WHERE m.kept""")
def edges_control(spark, sf):
    """Row -> nearest retained ancestor over dropped rows only, at most 64 hops: retained rows are the roots of a forest."""
    rows = read_table(spark, sf, "claude_rows").filter("uuid is not null")
    keep = F.coalesce(F.col("type").isin("user", "assistant") & ~F.coalesce("isSidechain", F.lit(False)), F.lit(False))
    m = rows.groupBy("session_id", "uuid").agg(F.min(F.struct("line_no", F.coalesce("parentUuid", F.lit("")).alias("p"), keep.alias("kept"))).alias("v")).select("session_id", "uuid", F.nullif("v.p", F.lit("")).alias("parent"), "v.kept", "v.line_no")
    return events.control(cut(m))


def _queries(spark, sf):
    return read_table(spark, sf, "field_catalog").select(F.col("field_name").alias("query_id"), F.col("meaning").alias("query"))


def _bm25_sql(table: str, keys: str, prefix: str = "") -> str:
    return f"""{prefix}d AS (SELECT {keys}, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS terms FROM {table}), n AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(terms)) AS avgdl FROM d),
 p AS (SELECT {keys}, dl, term, count(*) AS tf FROM (SELECT {keys}, len(terms) AS dl, unnest(terms) AS term FROM d) GROUP BY ALL),
 f AS (SELECT term, count(*) AS df FROM p GROUP BY term), q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT field_name AS query_id, unnest(regexp_extract_all(lower(meaning), '[a-z0-9]+')) AS term FROM field_catalog) GROUP BY ALL),
 s AS (SELECT query_id, {keys}, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)) * qtf), 6) AS score FROM p JOIN f USING (term) JOIN q USING (term), n GROUP BY ALL)"""


@query(f"WITH {_bm25_sql('documents', 'doc_id')} SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INT) AS rank FROM s QUALIFY rank < 8")
def bm25_topk(spark, sf):
    return retrieval.search(read_table(spark, sf, "documents").select("doc_id", "text"), _queries(spark, sf), "doc_id", 8).filter("score > 0")


_MD5_EMBED = """SELECT {k}, i, sum((1 + ln(n)) * CASE WHEN h % 2 = 1 THEN 1.0 ELSE -1.0 END) AS x FROM (SELECT {k}, n, CAST('0x' || left(md5(term), 8) AS BIGINT) AS h, (CAST('0x' || left(md5(term), 8) AS BIGINT) // 2) % 256 AS i FROM
 (SELECT {k}, term, CAST(count(*) AS DOUBLE) AS n FROM (SELECT {k}, unnest(regexp_extract_all(lower(coalesce({t}, '')), '[a-z0-9]+')) AS term FROM {f}) GROUP BY ALL)) GROUP BY ALL"""


@query(f"""WITH {_bm25_sql('documents', 'doc_id')}, dv AS ({_MD5_EMBED.format(k='doc_id', t='text', f='documents')}), qv AS ({_MD5_EMBED.format(k='field_name', t='meaning', f='field_catalog')}),
 dn AS (SELECT doc_id, sqrt(sum(x * x)) AS len FROM dv GROUP BY 1), qn AS (SELECT field_name, sqrt(sum(x * x)) AS len FROM qv GROUP BY 1), dots AS (SELECT q.field_name, d.doc_id, sum(q.x * d.x) AS dot FROM qv q JOIN dv d USING (i) GROUP BY ALL),
 pairs AS (SELECT f.field_name AS query_id, d.doc_id FROM field_catalog f, documents d),
 arms AS (SELECT p.query_id, p.doc_id, coalesce(s.score, 0) AS lex, round(coalesce(dot / nullif(dn.len, 0) / nullif(qn.len, 0), 0), 6) + 0.0 AS den FROM pairs p LEFT JOIN s ON s.query_id = p.query_id AND s.doc_id = p.doc_id LEFT JOIN dots ON dots.field_name = p.query_id AND dots.doc_id = p.doc_id LEFT JOIN dn ON dn.doc_id = p.doc_id LEFT JOIN qn ON qn.field_name = p.query_id),
 r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY lex DESC, doc_id) AS a, row_number() OVER (PARTITION BY query_id ORDER BY den DESC, doc_id) AS b FROM arms), u AS (SELECT query_id, doc_id, round(1.0 / (60 + a) + 1.0 / (60 + b), 6) AS score FROM r)
 SELECT query_id, doc_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) - 1 AS INT) AS rank FROM u QUALIFY rank < 8""")
def hybrid_rrf(spark, sf):
    """Words and vectors fused over their full lists."""
    return _hybrid(read_table(spark, sf, "documents").select("doc_id", "text"), _queries(spark, sf))


def _hybrid(docs: DataFrame, q: DataFrame) -> DataFrame:
    vectors = retrieval.md5_vectors(docs, "doc_id", "text")
    asked = retrieval.md5_vectors(q, "query_id", "query")
    return _fused(docs, q, vectors.withColumnRenamed("doc_id", "vec_id"), asked.withColumnRenamed("query_id", "vec_id"))


def _fused(docs: DataFrame, q: DataFrame, vectors: DataFrame, asked: DataFrame) -> DataFrame:
    """Both arms rank all documents for every query, as the fusion needs full lists."""
    n = docs.count()
    lex = retrieval.search(docs, q, "doc_id", n)
    den = retrieval.dense(vectors, asked, n).withColumnRenamed("vec_id", "doc_id")
    return retrieval.fuse([(lex, 1.0), (den, 1.0)], ["doc_id"], 8)


def _document_queries(docs: DataFrame) -> DataFrame:
    """The texts of every twentieth document, by its id, as queries against all documents; a text without words asks for nothing."""
    return docs.filter("doc_id % 20 = 0").filter(F.size(T.terms(F.coalesce("text", F.lit("")))) > 0).select(F.col("doc_id").alias("query_id"), F.col("text").alias("query"))


@query()
def bm25_documents(spark, sf):
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.search(docs, _document_queries(docs), "doc_id", 8).filter("score > 0")


@query()
def hybrid_documents(spark, sf):
    """Every twentieth document as a query; words and hashed words fused over full lists."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    return retrieval.hybrid(docs, _document_queries(docs), "doc_id", 8)


@query("""SELECT query_id, vec_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) - 1 AS INT) AS rank FROM
 (SELECT q.vec_id AS query_id, d.vec_id, round(list_dot_product(q.embedding::DOUBLE[], d.embedding::DOUBLE[]) / sqrt(list_dot_product(q.embedding::DOUBLE[], q.embedding::DOUBLE[])) / sqrt(list_dot_product(d.embedding::DOUBLE[], d.embedding::DOUBLE[])), 6) + 0.0 AS score
  FROM embeddings q, embeddings d WHERE q.vec_id % 20 = 0) QUALIFY rank < 8""")
def dense_topk(spark, sf):
    e = read_table(spark, sf, "embeddings")
    return retrieval.dense(e, e.filter("vec_id % 20 = 0"), 8)


@query(f"WITH {EV} SELECT session_id, event_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id) - 1 AS INT) AS rank, round(1.0 / row_number() OVER (PARTITION BY session_id ORDER BY ts DESC, event_id), 6) AS score FROM ev QUALIFY rank < 8")
def last_n(spark, sf):
    return retrieval.last_n(_ev(spark, sf), 8).select("session_id", "event_id", "rank", "score")


@query(f"""WITH RECURSIVE {EV}, {RESULT_OF}, {DEPENDS}, e AS (SELECT session_id, src_id, dst_id FROM ro UNION SELECT session_id, src_id, dst_id FROM dv),
 seeds AS (SELECT session_id, arg_max(event_id, pos) AS event_id FROM ev WHERE kind = 'tool_call' GROUP BY session_id),
 c AS (SELECT session_id, event_id, 0 AS hop FROM seeds UNION SELECT c.session_id, e.dst_id, hop + 1 FROM c JOIN e ON e.session_id = c.session_id AND e.src_id = c.event_id WHERE hop < 6)
 SELECT session_id, event_id, min(hop) AS hop FROM c GROUP BY ALL""")
def closure_native(spark, sf):
    ev = cut(_ev(spark, sf))
    edges = events.result_of(ev).unionByName(events.depends_value(ev))
    seeds = ev.filter("kind = 'tool_call'").groupBy("session_id").agg(F.max_by("event_id", "pos").alias("event_id")).withColumn("seed_set", F.lit("last call"))
    return closure.native(edges, seeds, 6).select("session_id", "event_id", "hop")


def _fit_sql(source: str, key: str, budget: int) -> str:
    return f"""o AS (SELECT *, row_number() OVER (PARTITION BY {key} ORDER BY {source}) AS rn FROM items),
 r AS (SELECT {key}, rn, CASE WHEN cost <= {budget} THEN cost ELSE 0 END AS used, cost <= {budget} AS kept FROM o WHERE rn = 1
  UNION ALL SELECT o.{key}, o.rn, CASE WHEN r.used + o.cost <= {budget} THEN r.used + o.cost ELSE r.used END, r.used + o.cost <= {budget} FROM o JOIN r ON o.{key} = r.{key} AND o.rn = r.rn + 1)"""


@query(f"WITH RECURSIVE {EV}, items AS (SELECT * FROM ev), {_fit_sql('pos DESC', 'session_id', BUDGET)} SELECT o.session_id, o.event_id, o.cost, CAST(r.used AS BIGINT) AS used FROM o JOIN r USING (session_id, rn) WHERE kept")
def pack_first_fit(spark, sf):
    items = _costed(spark, sf).select("session_id", "event_id", "pos", "cost")
    return packing.first_fit(items, ["session_id"], [F.desc("pos")], "cost", BUDGET).select("session_id", "event_id", "cost", "used")


@query(f"WITH {EV} SELECT * FROM (SELECT session_id, event_id, cost, CAST(sum(cost) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS BIGINT) AS used FROM ev) WHERE used <= {BUDGET}")
def tail_trace(spark, sf):
    items = _costed(spark, sf).select("session_id", "event_id", "pos", "cost")
    return packing.tail(items, ["session_id"], ["pos"], "cost", BUDGET).select("session_id", "event_id", "cost", "used")


@query(f"""WITH RECURSIVE {EV}, r AS (SELECT session_id, pos, CAST(0 AS BIGINT) AS segment, CAST(cost AS BIGINT) AS used FROM ev WHERE pos = 0
  UNION ALL SELECT e.session_id, e.pos, r.segment + CASE WHEN r.used > {WINDOW} THEN 1 ELSE 0 END, CASE WHEN r.used > {WINDOW} THEN 0 ELSE r.used END + e.cost FROM ev e JOIN r ON e.session_id = r.session_id AND e.pos = r.pos + 1)
 SELECT r.session_id, r.segment, count(*) AS n_events, CAST(sum(e.cost) AS BIGINT) AS tokens FROM r JOIN ev e USING (session_id, pos) GROUP BY ALL""")
def compaction_segments(spark, sf):
    s = packing.segments(_costed(spark, sf).select("session_id", "pos", "cost"), ["session_id"], ["pos"], "cost", WINDOW)
    return s.groupBy("session_id", "segment").agg(F.count("*").alias("n_events"), F.sum("cost").cast("long").alias("tokens"))


@query(f"""WITH RECURSIVE {EV}, {_bm25_sql('ev', 'session_id, event_id')}, k AS (SELECT query_id, session_id, event_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, session_id, event_id) - 1 AS rank FROM s QUALIFY rank < {CANDIDATES}),
 items AS (SELECT k.*, e.cost, e.text FROM k JOIN ev e USING (session_id, event_id)), {_fit_sql('rank', 'query_id', RECALL_BUDGET)}
 SELECT query_id, count(*) AS n_entries, CAST(sum(cost) AS BIGINT) AS total_tokens, sha256(string_agg(session_id || ':' || event_id, ',' ORDER BY rank)) AS digest, string_agg(text, chr(10) || chr(10) ORDER BY rank) AS context
 FROM o JOIN r USING (query_id, rn) WHERE kept GROUP BY query_id""")
def recall_packets(spark, sf):
    """BM25 over all events for every query, greedy whole-record packing under the budget, rendered packets."""
    key = ["session_id", "event_id"]
    ev = first_rows(read_table(spark, sf, "trace_events").select(*key, "text", "received_at"), key).withColumn("cost", F.coalesce(T.tokens_floor(F.col("text")), F.lit(0)))
    ranked = retrieval.top(retrieval.bm25(ev, _queries(spark, sf), key), key, CANDIDATES)
    items = ranked.join(ev.select(*key, "text", "cost"), key)
    return packing.render(packing.first_fit(items, ["query_id"], ["rank"], "cost", RECALL_BUDGET), ["query_id"], "rank")


def _redact_sql(c: str) -> str:
    q = lambda s: "'" + s.replace("'", "''") + "'"
    for rx in T.REDACTIONS:
        c = f"regexp_replace({c}, {q(rx)}, '[redacted]', 'g')"
    c = f"regexp_replace({c}, {q(T.REDACT_BEARER)}, {q(chr(92) + '1 [redacted]')}, 'g')"
    return f"regexp_replace({c}, {q(T.REDACT_ASSIGNED)}, {q(chr(92) + '1' + chr(92) + '2[redacted]')}, 'g')"


@query(f"WITH {EV}, t AS (SELECT session_id, event_id, text, {_redact_sql('text')} AS masked FROM ev) SELECT session_id, event_id, md5(masked) AS digest FROM t WHERE masked <> text")
def redacted_events(spark, sf):
    t = _ev(spark, sf).withColumn("masked", T.redacted(F.col("text")))
    return t.filter("masked <> text").select("session_id", "event_id", F.md5("masked").alias("digest"))


@query(r"""SELECT doc_id, length(text) // 4 AS t_floor, (length(text) + 3) // 4 AS t_ceil, greatest(1, len(regexp_extract_all(text, '[^ \t\r\n]+')), (length(text) + 2) // 3) AS t_packet, (strlen(text) + 3) // 4 AS t_bytes FROM documents WHERE text IS NOT NULL""")
def token_estimates(spark, sf):
    c = F.col("text")
    return read_table(spark, sf, "documents").filter("text is not null").select("doc_id", T.tokens_floor(c).alias("t_floor"), T.tokens_ceil(c).alias("t_ceil"), T.tokens_packet(c).alias("t_packet"), T.tokens_bytes(c).alias("t_bytes"))


@query("""SELECT term, count(DISTINCT doc_id) AS df, count(*) AS tf FROM (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS term FROM documents WHERE text IS NOT NULL) GROUP BY term""")
def term_frequency(spark, sf):
    t = read_table(spark, sf, "documents").filter("text is not null").select("doc_id", F.explode(T.terms(F.col("text"))).alias("term"))
    per = t.groupBy("term", "doc_id").agg(F.count("*").alias("n"))
    return per.groupBy("term").agg(F.count("*").alias("df"), F.sum("n").alias("tf"))


ARMS = f"""{EV}, gold AS (SELECT session_id, event_id FROM ev WHERE kind = 'decision'), ta AS (SELECT session_id, event_id FROM (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) AS u FROM ev) WHERE u <= {BUDGET}),
 tb AS (SELECT session_id, event_id FROM (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY cost, pos ROWS UNBOUNDED PRECEDING) AS u FROM ev) WHERE u <= {BUDGET}),
 j AS (SELECT g.session_id, g.event_id, ta.event_id IS NOT NULL AS a, tb.event_id IS NOT NULL AS b FROM gold g LEFT JOIN ta ON g.session_id = ta.session_id AND g.event_id = ta.event_id LEFT JOIN tb ON g.session_id = tb.session_id AND g.event_id = tb.event_id)"""


def _arms(spark, sf):
    ev = cut(_costed(spark, sf).select("session_id", "event_id", "kind", "pos", "cost"))
    key = ["session_id", "event_id"]
    a = packing.tail(ev, ["session_id"], ["pos"], "cost", BUDGET).select(*key, F.lit(True).alias("a"))
    w = Window.partitionBy("session_id").orderBy("cost", "pos").rowsBetween(Window.unboundedPreceding, 0)
    b = ev.withColumn("u", F.sum("cost").over(w)).filter(F.col("u") <= BUDGET).select(*key, F.lit(True).alias("b"))
    return ev.filter("kind = 'decision'").select(*key).join(a, key, "left").join(b, key, "left").na.fill(False, ["a", "b"])


@query(f"WITH {ARMS} SELECT session_id, count(*) AS n_gold, round(avg(CASE WHEN a THEN 1.0 ELSE 0.0 END), 6) AS recall_tail, round(avg(CASE WHEN b THEN 1.0 ELSE 0.0 END), 6) AS recall_cheap FROM j GROUP BY ROLLUP(session_id)")
def evidence_recall(spark, sf):
    return _arms(spark, sf).rollup("session_id").agg(F.count("*").alias("n_gold"), round6(F.avg(F.col("a").cast("int"))).alias("recall_tail"), round6(F.avg(F.col("b").cast("int"))).alias("recall_cheap"))


@query(f"WITH {ARMS}, n AS (SELECT count(*) FILTER (WHERE a AND NOT b) AS b, count(*) FILTER (WHERE NOT a AND b) AS c FROM j), t AS (SELECT b, c, least(b, c) AS m, b + c AS n FROM n) SELECT b, c, round(CASE WHEN n = 0 THEN 1.0 ELSE least(1.0, 2 * (SELECT sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) - n * ln(2))) FROM range(0, m + 1) AS x(i))) END, 6) AS p FROM t")
def mcnemar_arms(spark, sf):
    return metrics.mcnemar(_arms(spark, sf))


@query(f"WITH {EV}, t AS (SELECT kind, session_id, sum(cost) AS tokens FROM ev GROUP BY ALL) SELECT kind, round(avg(tokens), 6) AS mean, CAST(quantile_disc(tokens, 0.5) AS BIGINT) AS p50, CAST(quantile_disc(tokens, 0.95) AS BIGINT) AS p95, CAST(max(tokens) AS BIGINT) AS top FROM t GROUP BY kind")
def token_percentiles(spark, sf):
    t = _costed(spark, sf).groupBy("kind", "session_id").agg(F.sum("cost").alias("tokens"))
    return t.groupBy("kind").agg(round6(F.avg("tokens")).alias("mean"), F.expr("percentile_disc(0.5) within group (order by tokens)").cast("long").alias("p50"), F.expr("percentile_disc(0.95) within group (order by tokens)").cast("long").alias("p95"), F.max("tokens").cast("long").alias("top"))


PI = "pr AS (SELECT DISTINCT session_id, row_no, type, id, role, content, toolName, isError, command, output FROM pi_rows)"


@query(f"""WITH {PI}, g AS (SELECT CASE WHEN isError THEN 'failed' ELSE 'passed' END AS truth, CASE WHEN regexp_matches(content, '{T.FAILURE_LINE}') THEN 'failed' ELSE 'passed' END AS guess FROM pr WHERE role = 'toolResult' AND content IS NOT NULL AND isError IS NOT NULL),
 l AS (SELECT truth AS label FROM g UNION SELECT guess FROM g), c AS (SELECT label, (SELECT count(*) FROM g WHERE truth = label AND guess = label) AS tp, (SELECT count(*) FROM g WHERE guess = label) AS ng, (SELECT count(*) FROM g WHERE truth = label) AS nt FROM l)
 SELECT label, tp, ng - tp AS fp, nt - tp AS fn, round(tp / nullif(ng, 0), 6) AS precision, round(tp / nullif(nt, 0), 6) AS recall, round(2 * (tp / nullif(ng, 0)) * (tp / nullif(nt, 0)) / nullif(tp / nullif(ng, 0) + tp / nullif(nt, 0), 0), 6) AS f1 FROM c""")
def validation_confusion(spark, sf):
    r = first_rows(read_table(spark, sf, "pi_rows"), ["session_id", "row_no"]).filter("role = 'toolResult' and content is not null and isError is not null")
    g = r.select(F.when(F.col("isError"), "failed").otherwise("passed").alias("truth"), F.when(T.failed(F.col("content")), "failed").otherwise("passed").alias("guess"))
    return metrics.confusion(g, "truth", "guess")


@query("""WITH r AS (SELECT DISTINCT trajectory_id, row_no, id, lower(trim(role)) AS role, content, len(tool_calls) AS n_calls FROM oh_rows), m AS (SELECT *, lead(id) OVER w AS next_id, lead(role) OVER w AS next_role, last_value(CASE WHEN role IN ('user', 'human') THEN id END IGNORE NULLS) OVER (PARTITION BY trajectory_id ORDER BY row_no ROWS UNBOUNDED PRECEDING) AS goal FROM r WINDOW w AS (PARTITION BY trajectory_id ORDER BY row_no))
 SELECT trajectory_id, CAST(row_number() OVER (PARTITION BY trajectory_id ORDER BY row_no) - 1 AS INT) AS idx, id AS action_id, next_id AS observation_id, goal FROM m WHERE role IN ('assistant', 'ai', 'model') AND n_calls > 0 AND next_role IN ('tool', 'function')""")
def action_nodes(spark, sf):
    r = first_rows(read_table(spark, sf, "oh_rows"), ["trajectory_id", "row_no"]).withColumn("role", F.lower(F.trim("role")))
    r = ranked(r.select("trajectory_id", "row_no", "id", "role", F.size("tool_calls").alias("n_calls")), ["trajectory_id"], ["row_no"], "at").withColumn("said", F.when(F.col("role").isin("user", "human"), F.col("id")))
    r = filled(r, "said", "goal", group="trajectory_id", pos="at")
    nxt = r.select("trajectory_id", (F.col("at") - 1).alias("at"), F.col("id").alias("observation_id"), F.col("role").alias("next_role"))
    m = r.join(nxt, ["trajectory_id", "at"]).filter(F.col("role").isin("assistant", "ai", "model") & (F.col("n_calls") > 0) & F.col("next_role").isin("tool", "function"))
    return ranked(m, ["trajectory_id"], ["at"], "idx").select("trajectory_id", F.col("idx").cast("int").alias("idx"), F.col("id").alias("action_id"), "observation_id", "goal")


@query(f"WITH {EV} SELECT kind, session_id, event_id FROM ev QUALIFY row_number() OVER (PARTITION BY kind, session_id ORDER BY md5(session_id || ':' || event_id), event_id) <= 2")
def stratified_sample(spark, sf):
    w = Window.partitionBy("kind", "session_id").orderBy(F.md5(F.concat_ws(":", "session_id", "event_id")), "event_id")
    return _ev(spark, sf).withColumn("r", F.row_number().over(w)).filter("r <= 2").select("kind", "session_id", "event_id")


@query("SELECT event_type, time_bucket(INTERVAL 1 HOUR, ts) AS hour, count(*) AS n, round(sum(value), 6) AS total FROM events GROUP BY ALL")
def tumbling_counts(spark, sf):
    e = read_table(spark, sf, "events")
    return e.groupBy("event_type", F.window("ts", "1 hour").alias("w")).agg(F.count("*").alias("n"), round6(F.sum("value")).alias("total")).select("event_type", F.col("w.start").alias("hour"), "n", "total")


@query(r"""WITH t AS (SELECT DISTINCT session_id, event_id, ts, text FROM trace_events WHERE kind = 'tool_call' AND text IS NOT NULL), v AS (SELECT *, nullif(regexp_extract(text, '"file_path": "([^"]+)"', 1), '') AS path, regexp_matches(text, '^Read ') AS viewed, regexp_matches(text, '^(?:Edit|MultiEdit|Write|NotebookEdit) ') AS edited FROM t),
 l AS (SELECT session_id, path, max({'ts': ts, 'id': event_id}) FILTER (WHERE viewed) AS view, max({'ts': ts, 'id': event_id}) FILTER (WHERE edited) AS edit FROM v WHERE path IS NOT NULL GROUP BY ALL)
 SELECT session_id, path, view.id AS event_id FROM l WHERE view IS NOT NULL AND (edit IS NULL OR edit < view)""")
def kept_views(spark, sf):
    t = read_table(spark, sf, "trace_events").filter("kind = 'tool_call' and text is not null")
    path = F.nullif(F.regexp_extract("text", r"\"file_path\": \"([^\"]+)\"", 1), F.lit(""))
    at = F.struct("ts", F.col("event_id").alias("id"))
    viewed, edited = F.col("text").startswith("Read "), F.regexp_like("text", F.lit(r"^(?:Edit|MultiEdit|Write|NotebookEdit) "))
    g = t.withColumn("path", path).filter("path is not null").groupBy("session_id", "path").agg(F.max(F.when(viewed, at)).alias("view"), F.max(F.when(edited, at)).alias("edit"))
    return g.filter("view is not null and (edit is null or edit < view)").select("session_id", "path", F.col("view.id").alias("event_id"))


@query(f"""WITH {_bm25_sql('documents', 'doc_id')}, l AS (SELECT doc_id, i AS line_no, lines[i] AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS lines, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS i FROM documents WHERE text IS NOT NULL)),
 w AS (SELECT query_id, term, coalesce(df, 0) AS df FROM q LEFT JOIN f USING (term) WHERE length(term) >= 4 AND df > 0), r AS (SELECT query_id, term FROM w QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY df, term) <= 2)
 SELECT query_id, doc_id, CAST(line_no AS INT) AS line_no, count(*) AS n_words FROM l JOIN r ON contains(lower(line), term) GROUP BY ALL""")
def grep_lines(spark, sf):
    """Lines that hold one of a query's two rarest words (by documents)."""
    docs = read_table(spark, sf, "documents").select("doc_id", "text")
    q = _queries(spark, sf).select("query_id", F.explode(F.array_distinct(T.terms(F.col("query")))).alias("term")).filter(F.length("term") >= 4)
    df = docs.select("doc_id", F.explode(F.array_distinct(T.terms(F.coalesce("text", F.lit(""))))).alias("term")).join(F.broadcast(q.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"))  # words of the fixed queries
    w = Window.partitionBy("query_id").orderBy("df", "term")
    rare = q.join(df, "term").withColumn("r", F.row_number().over(w)).filter("r <= 2").agg(F.collect_list(F.struct("query_id", "term")).alias("words"))
    lines = docs.filter("text is not null").select("doc_id", F.posexplode(F.split("text", "\n")).alias("at", "line")).withColumn("low", F.lower("line"))
    hits = lines.crossJoin(F.broadcast(rare)).select("doc_id", (F.col("at") + 1).alias("line_no"), F.explode(F.filter("words", lambda x: F.contains(F.col("low"), x["term"]))).alias("h"))  # one row of at most two words a query
    return hits.groupBy(F.col("h.query_id").alias("query_id"), "doc_id", "line_no").agg(F.count("*").alias("n_words"))


@query()
def native_events(spark, sf):
    """Typed events of the three native dialects."""
    from packetloom.sources.normalize import events_of

    parts = [events_of(read_table(spark, sf, t), d).withColumn("dialect", F.lit(d)) for t, d in (("claude_rows", "claude_code"), ("pi_rows", "pi"), ("oh_rows", "openhands"))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(f"WITH {EV} SELECT a.session_id, a.event_id, b.event_id AS neighbour_id, CAST(b.pos - a.pos AS BIGINT) AS distance FROM ev a JOIN ev b ON a.session_id = b.session_id AND b.pos BETWEEN a.pos - 2 AND a.pos + 2 AND a.pos <> b.pos WHERE a.kind = 'decision'")
def neighbours(spark, sf):
    """Events within two places of each decision: an equi join on exploded places instead of a range join."""
    ev = cut(_ev(spark, sf).select("session_id", "event_id", "kind", "pos"))
    near = ev.filter("kind = 'decision'").select("session_id", "event_id", F.col("pos").alias("at"), F.explode(F.expr("sequence(pos - 2, pos + 2)")).alias("pos")).filter("at <> pos")
    return near.join(ev.select("session_id", "pos", F.col("event_id").alias("neighbour_id")), ["session_id", "pos"]).select("session_id", "event_id", "neighbour_id", (F.col("pos") - F.col("at")).alias("distance"))


@query(f"""WITH {EV}, {RESULT_OF} SELECT s.session_id, s.event_id, coalesce(a.dst_id, b.src_id) AS paired_id FROM (SELECT * FROM ev WHERE kind IN ('tool_call', 'tool_result')) s
 LEFT JOIN ro a ON a.session_id = s.session_id AND a.src_id = s.event_id LEFT JOIN ro b ON b.session_id = s.session_id AND b.dst_id = s.event_id WHERE coalesce(a.dst_id, b.src_id) IS NOT NULL""")
def seed_pairs(spark, sf):
    """Calls with their results and results with their calls."""
    r = events.result_of(_ev(spark, sf)).select("session_id", "src_id", "dst_id")
    return r.select("session_id", F.col("src_id").alias("event_id"), F.col("dst_id").alias("paired_id")).union(r.select("session_id", F.col("dst_id"), F.col("src_id")))


@query(r"""WITH t AS (SELECT DISTINCT session_id, event_id, text FROM trace_events WHERE text IS NOT NULL), i AS (SELECT session_id, event_id, unnest(list_distinct(list_filter(regexp_extract_all(text, '[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+'), lambda v: length(v) >= 5))) AS ident FROM t)
 SELECT session_id, ident, count(*) AS df FROM i GROUP BY ALL""")
def identifier_frequency(spark, sf):
    """In how many events of a session each identifier stands."""
    t = first_rows(read_table(spark, sf, "trace_events"), ["session_id", "event_id"]).filter("text is not null")
    ids = F.array_distinct(F.filter(F.regexp_extract_all("text", F.lit("[A-Za-z0-9]+(?:_[A-Za-z0-9]+)+"), F.lit(0)), lambda v: F.length(v) >= 5))
    return t.select("session_id", "event_id", F.explode(ids).alias("ident")).groupBy("session_id", "ident").agg(F.count("*").alias("df"))


@query("""WITH d AS (SELECT coalesce(lower(lang), 'none') AS lang, CAST(length(text) AS DOUBLE) AS x FROM documents WHERE text IS NOT NULL)
 SELECT coalesce(lang, 'all') AS lang, count(*) AS n, round(avg(x), 6) AS mean, CAST(quantile_disc(x, 0.5) AS BIGINT) AS p50 FROM d GROUP BY GROUPING SETS ((lang), ())""")
def length_sets(spark, sf):
    """Lengths by language and over all."""
    d = read_table(spark, sf, "documents").filter("text is not null").select(F.coalesce(F.lower("lang"), F.lit("none")).alias("lang"), F.length("text").cast("double").alias("x"))
    g = d.rollup("lang").agg(F.count("*").alias("n"), round6(F.avg("x")).alias("mean"), F.expr("cast(percentile_disc(0.5) within group (order by x) as bigint)").alias("p50"))
    return g.withColumn("lang", F.coalesce("lang", F.lit("all")))


@query(f"WITH {EV}, {RESULT_OF}, d AS (SELECT session_id, src_id, dst_id FROM ro) SELECT e.session_id, e.kind, count(*) FILTER (WHERE o.src_id IS NULL) AS n_unpaired, count(*) AS n FROM ev e LEFT JOIN d o ON o.session_id = e.session_id AND o.src_id = e.event_id WHERE e.kind = 'tool_result' GROUP BY ALL")
def unpaired_results(spark, sf):
    """Round-trip audit: results that found no call."""
    ev = cut(_ev(spark, sf))
    e = ev.filter("kind = 'tool_result'").join(events.result_of(ev).select("session_id", F.col("src_id").alias("event_id"), F.lit(1).alias("hit")), ["session_id", "event_id"], "left")
    return e.groupBy("session_id", "kind").agg(F.count_if(F.col("hit").isNull()).alias("n_unpaired"), F.count("*").alias("n"))
