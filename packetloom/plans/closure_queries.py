"""Registered queries of the closure, each with the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import closure
from packetloom.plans.function_queries import listed
from packetloom.plans.graph_queries import AV, TE, _activity, _trace

QUERIES: dict = {}
ORACLE: dict[str, str] = {}
ASKED = "which loader reads the ledger and why does the digest change after every merge of the packet"


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


def _newest(ev: DataFrame, kind: str) -> DataFrame:
    """One query a session, seeded at its newest event of a kind: (query_id, session_id, event_id)."""
    n = ev.filter(F.col("kind") == kind).groupBy("session_id").agg(F.max_by("event_id", "pos").alias("event_id"))
    return n.select(F.col("session_id").alias("query_id"), "session_id", "event_id")


def _asked(seeds: DataFrame, mode: str, text: str = ASKED) -> DataFrame:
    return seeds.select("query_id", "session_id", F.lit(text).alias("query"), F.lit(mode).alias("query_mode"), F.lit("reader").alias("model_id"), F.lit("chat").alias("readout")).distinct()


def _seed_sql(source: str, kind: str) -> str:
    return f"sd AS (SELECT session_id, arg_max(event_id, pos) AS event_id FROM {source} WHERE kind = '{kind}' GROUP BY 1)"


def _reach_sql(edges: str, hops: int) -> str:
    return f"""w AS (SELECT session_id, event_id, 0 AS hop FROM sd UNION SELECT w.session_id, e.dst_id, hop + 1 FROM w JOIN {edges} e ON e.session_id = w.session_id AND e.src_id = w.event_id WHERE hop < {hops}),
 n AS (SELECT session_id, event_id, min(hop) AS hop FROM w GROUP BY ALL)"""


def _out(nodes: DataFrame) -> DataFrame:
    return nodes.select("session_id", "event_id", "tier", F.col("hop").cast("int").alias("hop"))


@query(f"WITH RECURSIVE {TE}, {_seed_sql('ev', 'assistant')}, {_reach_sql('te', 6)} SELECT session_id, event_id, 'required' AS tier, CAST(hop AS INT) AS hop FROM n")
def closure_why(spark, sf):
    """What the newest message of each session rests on."""
    ev, e = _trace(spark, sf)
    s = _newest(ev, "assistant")
    return _out(closure.close(_asked(s, "why"), s, ev, e)[0])


@query(f"WITH RECURSIVE {TE}, {_seed_sql('ev', 'summary')}, {_reach_sql('te', 1)} SELECT session_id, src_id AS child_id, dst_id AS parent_id, te.edge_type, count(*) AS n FROM n JOIN te USING (session_id) WHERE te.src_id = n.event_id AND hop = 1 GROUP BY ALL")
def closure_truncated(spark, sf):
    """Edges at the bound of one hop, which are recorded and not followed."""
    ev, e = _trace(spark, sf)
    s = _newest(ev, "summary")
    steps = closure.close(_asked(s, "why"), s, ev, e, max_hops=1)[1]
    return steps.filter(F.col("rule") == closure.TRUNCATED).groupBy(F.col("query_id").alias("session_id"), "child_id", "parent_id", "edge_type").agg(F.count("*").alias("n"))


@query(f"WITH RECURSIVE {AV}, {_seed_sql('av', 'summary')}, {_reach_sql('(SELECT * FROM ae WHERE edge_type <> ' + chr(39) + 'TEMPORAL' + chr(39) + ')', 3)} SELECT session_id, event_id, 'required' AS tier, CAST(hop AS INT) AS hop FROM n")
def closure_full(spark, sf):
    """Every strong ancestor within three hops, no rule applied."""
    ev, e = _activity(spark, sf)
    s = _newest(ev, "summary")
    return _out(closure.close(_asked(s, "lookup"), s, ev, e, mode="full_ancestor", max_hops=3)[0])


@query(f"""WITH {AV}, {_seed_sql('av', 'user')} SELECT session_id, event_id, 'required' AS tier, CAST(0 AS INT) AS hop FROM sd UNION ALL SELECT DISTINCT d.session_id, d.dst_id, 'optional', 1 FROM adv d JOIN sd ON sd.session_id = d.session_id AND sd.event_id = d.src_id""")
def closure_lookup(spark, sf):
    """A lookup does not pay for the sources of decisions: they are optional."""
    ev, e = _activity(spark, sf)
    ev = ev.withColumn("kind", F.when(F.col("kind") == "user", "decision").otherwise(F.col("kind")))
    s = _newest(ev, "decision")
    return _out(closure.close(_asked(s, "lookup", "what happened"), s, ev, e)[0])


@query(f"""WITH RECURSIVE {AV}, s0 AS (SELECT session_id, path, arg_min(event_id, pos) AS event_id FROM av WHERE kind = 'state' GROUP BY ALL), c AS (SELECT session_id, event_id AS seed, event_id AS cur FROM s0 UNION ALL SELECT c.session_id, c.seed, s.src_id FROM c JOIN asp s ON s.session_id = c.session_id AND s.dst_id = c.cur),
 t AS (SELECT c.*, NOT EXISTS (SELECT 1 FROM asp s WHERE s.session_id = c.session_id AND s.dst_id = c.cur) AS newest FROM c) SELECT DISTINCT session_id, cur AS event_id, CASE WHEN newest THEN 'required' ELSE 'optional' END AS tier FROM t""")
def closure_state(spark, sf):
    """The first write to every path as a seed of a question about the state: the newest is required, older ones optional."""
    ev, e = _activity(spark, sf)
    s = ev.filter("kind = 'state'").groupBy("session_id", "path").agg(F.min_by("event_id", "pos").alias("event_id")).select(F.col("session_id").alias("query_id"), "session_id", "event_id")
    return closure.close(_asked(s, "state"), s, ev, e)[0].select("session_id", "event_id", "tier")


_TERMS = f"list_distinct(list_filter(list_transform(regexp_extract_all(coalesce(text, ''), '[A-Za-z0-9_][A-Za-z0-9_./\\-:@#+]*'), lambda t: trim(lower(t), '.:,;/')), lambda t: length(t) >= 3 AND NOT list_contains({listed(T.QUERY_STOP)}, t)))"
_ASKED_TERMS = listed([w for w in ASKED.split() if len(w) >= 3 and w not in T.QUERY_STOP])


@query(f"""WITH {TE}, {_seed_sql('ev', 'summary')}, r AS (SELECT m.session_id, m.src_id AS child_id, m.dst_id AS parent_id, row_number() OVER (PARTITION BY m.session_id, m.src_id ORDER BY len(list_filter({_ASKED_TERMS}, lambda w: list_contains({_TERMS}, w))) DESC, e.pos, m.dst_id) AS place
  FROM mt m JOIN sd ON sd.session_id = m.session_id AND sd.event_id = m.src_id JOIN ev e ON e.session_id = m.session_id AND e.event_id = m.dst_id) SELECT session_id, child_id, parent_id FROM r WHERE place > 4""")
def closure_capped(spark, sf):
    """Sources of summaries beyond the four nearest to the question: recorded, offered as optional."""
    ev, e = _trace(spark, sf)
    s = _newest(ev, "summary")
    steps = closure.close(_asked(s, "why"), s, ev, e, carrier_cap=4)[1]
    seeds = s.select("query_id", F.col("event_id").alias("child_id"))
    return steps.filter(F.col("rule") == closure.CAPPED).join(seeds, ["query_id", "child_id"]).select(F.col("query_id").alias("session_id"), "child_id", "parent_id").distinct()


@query(f"WITH {TE}, {_seed_sql('ev', 'summary')} SELECT DISTINCT m.session_id, m.src_id AS carrier_id, m.predicate FROM mt m JOIN sd ON sd.session_id = m.session_id AND sd.event_id = m.src_id")
def closure_relaxed(spark, sf):
    """Summaries with a verification for this reader free from their sources; records of other readers do not count."""
    ev, e = _trace(spark, sf)
    s = _newest(ev, "summary")
    v = s.select("session_id", F.col("event_id").alias("carrier_id"), F.lit("summary").alias("predicate"), F.explode(F.array(F.lit("reader"), F.lit("other"))).alias("model_id"), F.lit("native").alias("construction"), F.lit("chat").alias("readout"))
    nodes, steps = closure.close(_asked(s, "why"), s, ev, e, verifications=v)
    return closure.relaxations(nodes, steps).select(F.col("query_id").alias("session_id"), "carrier_id", "predicate")


@query(f"""WITH {AV}, {_seed_sql('av', 'summary')}, g AS (SELECT session_id, event_id FROM av WHERE kind = 'state')
 SELECT 'off' AS mode, count(*) AS n FROM sd UNION ALL SELECT 'all', count(*) FROM av WHERE session_id IN (SELECT session_id FROM sd) UNION ALL SELECT 'oracle', (SELECT count(*) FROM g WHERE session_id IN (SELECT session_id FROM sd)) + (SELECT count(*) FROM sd)""")
def closure_modes(spark, sf):
    """Events required by the modes without edges: seeds alone, everything, and a given list."""
    ev, e = _activity(spark, sf)
    s = _newest(ev, "summary")
    gold = ev.filter("kind = 'state'").select(F.col("session_id").alias("query_id"), "event_id")
    out = None
    for mode in ("off", "all", "oracle"):
        d = closure.close(_asked(s, "why"), s, ev, e, mode=mode, oracle=gold)[0].agg(F.count("*").alias("n")).select(F.lit(mode).alias("mode"), "n")
        out = d if out is None else out.unionByName(d)
    return out


@query(f"""WITH RECURSIVE {TE}, {_seed_sql('ev', 'assistant')}, {_reach_sql('te', 6)}, g AS (SELECT session_id, dst_id AS event_id FROM dv UNION SELECT session_id, dst_id FROM ro)
 SELECT g.session_id, count(*) AS n_wanted, count(n.event_id) AS n_reached FROM g LEFT JOIN n ON n.session_id = g.session_id AND n.event_id = g.event_id GROUP BY 1""")
def closure_coverage(spark, sf):
    """Which targets of native edges are reached from the newest message within six hops."""
    ev, e = _trace(spark, sf)
    s = _newest(ev, "assistant").select("session_id", F.lit("newest").alias("seed_set"), "event_id")
    wanted = e.filter("edge_type in ('DEPENDS_ON', 'RESULT_OF')").select("session_id", F.lit("newest").alias("seed_set"), F.col("dst_id").alias("event_id"))
    return closure.coverage(closure.native(e, s, 6), wanted).select("session_id", "n_wanted", "n_reached")
