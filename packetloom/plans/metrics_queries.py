"""Registered queries of metrics, statistics and reports, each with the SQL that checks it.

An item is a session: its gold are its decisions, what it must rest on also its states; arm a serves the newest events
within a budget, arm b the cheapest; the closure is taken to require calls and decisions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import metrics as M
from packetloom.operators import packing
from packetloom.plans.graph_queries import _ev
from packetloom.plans.reference_queries import BUDGET, EV
from packetloom.runtime import cut, prefix_sums, read_table, round6

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE[fn.__name__] = sql
        return fn

    return add


ITEMS = f"""{EV}, ta AS (SELECT *, sum(cost) OVER (PARTITION BY session_id ORDER BY pos DESC ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS a, sum(cost) OVER (PARTITION BY session_id ORDER BY cost, pos ROWS UNBOUNDED PRECEDING) <= {BUDGET} AS b FROM ev),
 it AS (SELECT session_id AS item_id, count(*) FILTER (WHERE kind = 'decision') AS n_gold, count(*) FILTER (WHERE kind = 'decision' AND a) AS gold_a, count(*) FILTER (WHERE kind = 'decision' AND b) AS gold_b, count(*) FILTER (WHERE kind IN ('decision', 'state')) AS n_src,
  count(*) FILTER (WHERE kind IN ('decision', 'state') AND a) AS src_a, count(*) FILTER (WHERE kind = 'state') AS n_dep, count(*) FILTER (WHERE kind = 'state' AND cost < 60) AS dep_hit, count(*) FILTER (WHERE kind IN ('tool_call', 'decision')) AS n_req, count(*) FILTER (WHERE kind = 'state' AND a) AS stale_a,
  coalesce(sum(cost) FILTER (WHERE a), 0) AS tok_a, coalesce(sum(cost) FILTER (WHERE b), 0) AS tok_b, count(*) % 4 AS slice FROM ta GROUP BY 1)"""


def _items(spark, sf) -> DataFrame:
    """item_id, gold, sources, served_a, served_b, required, reached, stale, tokens of both arms, slice, mode."""
    ev = cut(_ev(spark, sf).withColumn("cost", F.coalesce(T.tokens_floor(F.col("text")), F.lit(0))).select("session_id", "event_id", "kind", "pos", "cost"))
    a = packing.tail(ev, ["session_id"], ["pos"], "cost", BUDGET).select("session_id", "event_id", F.lit(True).alias("a"))
    cheap = prefix_sums(ev, ["session_id"], ["cost", "pos"], "cost", "before")
    d = cheap.withColumn("b", F.col("before") + F.col("cost") <= BUDGET).join(a, ["session_id", "event_id"], "left").na.fill(False, ["a"])
    ids = lambda c: F.collect_list(F.when(c, F.col("event_id")))
    k = F.col("kind")
    return cut(d.groupBy(F.col("session_id").alias("item_id")).agg(
        ids(k == "decision").alias("gold"), ids(k.isin("decision", "state")).alias("sources"), ids(F.col("a")).alias("served_a"), ids(F.col("b")).alias("served_b"), ids(k.isin("tool_call", "decision")).alias("required"),
        ids((k == "state") & (F.col("cost") < 60)).alias("reached"), ids(k == "state").alias("stale"), F.sum(F.when(F.col("a"), F.col("cost")).otherwise(0)).alias("tok_a"), F.sum(F.when(F.col("b"), F.col("cost")).otherwise(0)).alias("tok_b"), (F.count("*") % 4).alias("slice"),
    ))


@query(f"WITH {ITEMS} SELECT item_id, round(gold_a / nullif(n_gold, 0), 6) AS seed_recall, round(src_a / nullif(n_src, 0), 6) AS source_recall, round(dep_hit / nullif(n_dep, 0), 6) AS closure_recall, CASE WHEN n_src > 0 THEN round(n_gold / nullif(n_req, 0), 6) END AS closure_precision FROM it")
def item_metrics(spark, sf):
    i = _items(spark, sf)
    return i.select("item_id", M.recall(F.col("gold"), F.col("served_a")).alias("seed_recall"), M.recall(F.col("sources"), F.col("served_a")).alias("source_recall"), M.closure_recall(F.col("sources"), F.col("gold"), F.col("reached")).alias("closure_recall"), M.closure_precision(F.col("required"), F.col("sources")).alias("closure_precision"))


@query(f"WITH {ITEMS}, m AS (SELECT round(gold_a / nullif(n_gold, 0), 6) AS seed_recall, round(dep_hit / nullif(n_dep, 0), 6) AS closure_recall FROM it) SELECT round(avg(seed_recall), 6) AS seed_recall, count(seed_recall) AS n_seed_recall, round(avg(closure_recall), 6) AS closure_recall, count(closure_recall) AS n_closure_recall, (SELECT round(sum(gold_a) / nullif(sum(n_gold), 0), 6) FROM it) AS ratio FROM m")
def macro_and_micro(spark, sf):
    i = _items(spark, sf)
    m = i.select(M.recall(F.col("gold"), F.col("served_a")).alias("seed_recall"), M.closure_recall(F.col("sources"), F.col("gold"), F.col("reached")).alias("closure_recall"))
    n = i.select(F.size(F.array_intersect("gold", "served_a")).alias("hit"), F.size("gold").alias("of"))
    return M.macro(m, "seed_recall", "closure_recall").crossJoin(M.micro(n, "hit", "of"))  # one row each


@query(f"WITH {ITEMS} SELECT round(avg(CASE WHEN stale_a > 0 THEN 1.0 ELSE 0.0 END), 6) AS rate, count(*) AS n FROM it WHERE n_dep > 0 AND slice <> 3")
def stale_leakage(spark, sf):
    return M.stale_leakage(_items(spark, sf).select(F.when(F.col("slice") == 3, "audit").otherwise("lookup").alias("query_mode"), "stale", F.col("served_a").alias("served")))


@query(f"WITH {ITEMS} SELECT round(sum(tok_a) / sum(tok_b), 6) AS ratio, count(*) AS n FROM it WHERE slice <> 1")
def token_inflation(spark, sf):
    i = _items(spark, sf)
    return M.inflation(i.select("item_id", F.col("tok_a").alias("tokens")), i.filter("slice <> 1").select("item_id", F.col("tok_b").alias("tokens")))


@query(f"WITH {ITEMS} SELECT round(avg(CASE WHEN tok_a > {BUDGET} THEN 1.0 ELSE 0.0 END), 6) AS over_budget, round(avg(CASE WHEN src_a < n_src THEN 1.0 ELSE 0.0 END), 6) AS incomplete, count(*) AS n FROM it")
def packet_rates(spark, sf):
    i = _items(spark, sf)
    return M.packet_rates(i.select(F.col("tok_a").alias("total_tokens"), F.lit(BUDGET).alias("budget"), (F.size(F.array_except("sources", "served_a")) > 0).alias("incomplete")))


@query(f"WITH {ITEMS} SELECT coalesce(CAST(slice AS VARCHAR), 'all') AS slice, count(*) AS n, round(avg(CASE WHEN gold_a = n_gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy_a, round(avg(CASE WHEN gold_b = n_gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy_b FROM it GROUP BY GROUPING SETS ((slice), ())")
def accuracy_by_slice(spark, sf):
    right = lambda s: F.size(F.array_except("gold", s)) == 0
    i = _items(spark, sf).select("slice", right("served_a").alias("a"), right("served_b").alias("b"))
    g = i.rollup("slice").agg(F.count("*").alias("n"), round6(F.avg(F.col("a").cast("int"))).alias("accuracy_a"), round6(F.avg(F.col("b").cast("int"))).alias("accuracy_b"))
    return g.select(F.coalesce(F.col("slice").cast("string"), F.lit("all")).alias("slice"), "n", "accuracy_a", "accuracy_b")


def _pairs(spark, sf) -> DataFrame:
    i = _items(spark, sf)
    arm = lambda s: i.select("item_id", (F.size(F.array_except("gold", s)) == 0).alias("correct"))
    return M.paired(arm("served_a"), arm("served_b"))


@query(f"WITH {ITEMS}, p AS (SELECT gold_a = n_gold AS a, gold_b = n_gold AS b FROM it) SELECT round(avg(CASE WHEN a <> b THEN 1.0 ELSE 0.0 END), 6) AS flipped, round(avg(CASE WHEN a AND NOT b THEN 1.0 ELSE 0.0 END), 6) AS lost, round(avg(CASE WHEN NOT a AND b THEN 1.0 ELSE 0.0 END), 6) AS won, round(avg(CASE WHEN a THEN CASE WHEN b THEN 1.0 ELSE 0.0 END END), 6) AS kept, count(*) AS n FROM p")
def flip_rates(spark, sf):
    return M.flip_rates(_pairs(spark, sf))


@query(f"WITH {ITEMS} SELECT round(avg(CASE WHEN gold_a = n_gold THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM it WHERE src_a = 0 AND n_req > 0")
def leak_guard(spark, sf):
    i = _items(spark, sf)
    return M.leak_guard(i.select((F.size(F.array_except("gold", "served_a")) == 0).alias("correct"), F.size(F.array_intersect("sources", "served_a")).alias("n_sources"), F.size("required").alias("n_carriers")))


_DIFFS = "SELECT lang AS cluster, n_chars % 3 - length(text) % 2 AS diff FROM documents WHERE lang IN ('en', 'fr', 'de', 'es', 'zh', 'ja') AND text IS NOT NULL AND n_chars IS NOT NULL"


@query(f"""WITH d AS ({_DIFFS}), c AS (SELECT cluster, CAST(sum(diff) AS DOUBLE) AS s, CAST(count(*) AS DOUBLE) AS n, row_number() OVER (ORDER BY cluster) - 1 AS k FROM d GROUP BY 1), t AS (SELECT sum(n) AS total, sum(s) / sum(n) AS delta, count(*) AS g, count(*) FILTER (WHERE s <> 0) AS inf FROM c),
 se AS (SELECT sqrt(g / (g - 1.0) * (SELECT sum((s - n * delta) * (s - n * delta)) FROM c)) / total AS se FROM t), sg AS (SELECT i, k, s, n, CASE WHEN (i >> CAST(k AS INT)) % 2 = 1 THEN 1.0 ELSE -1.0 END AS w FROM range(0, 64) r(i), c),
 m AS (SELECT i, sum(w * s) / (SELECT total FROM t) AS m FROM sg GROUP BY i), b AS (SELECT m.i, any_value(m.m) AS m, sqrt((SELECT g / (g - 1.0) FROM t) * sum((w * s - n * m.m) * (w * s - n * m.m))) / (SELECT total FROM t) AS e FROM sg JOIN m USING (i) GROUP BY m.i)
 SELECT CAST(total AS BIGINT) AS n, g AS clusters, round(delta, 6) AS delta, round(se, 6) AS se, (SELECT round(avg(CASE WHEN abs(m) / e >= abs(delta) / se - 1e-12 THEN 1.0 ELSE 0.0 END), 6) FROM b WHERE e > 0) AS p, inf AS informative, power(2.0, 1 - inf) AS p_floor, power(2.0, 1 - inf) <= 0.05 AS decidable FROM t, se""")
def cluster_contrast(spark, sf):
    """Mean of paired differences of documents, languages as clusters: all 64 sign vectors."""
    d = read_table(spark, sf, "documents").filter("lang in ('en', 'fr', 'de', 'es', 'zh', 'ja') and text is not null and n_chars is not null")
    return M.contrast(d.select(F.col("lang").alias("cluster"), (F.col("n_chars") % 3 - F.length("text") % 2).alias("diff"))).select("n", "clusters", "delta", "se", "p", "informative", "p_floor", "decidable")


@query()
def cluster_intervals(spark, sf):
    """Intervals of the same contrast: by inverting the test, and by resampled clusters."""
    d = read_table(spark, sf, "documents").filter("lang is not null and text is not null and n_chars is not null")
    return M.contrast(d.select(F.lower("lang").alias("cluster"), (F.col("n_chars") % 3 - F.length("text") % 2).alias("diff"))).select("delta", "low", "high", "pct_low", "pct_high")


_ANSWER = "'  \"' || upper(coalesce(source, 'x')) || '\".  ' || coalesce(lang, '')"


@query(rf"""WITH a AS (SELECT doc_id, {_ANSWER} AS answer, source FROM documents), n AS (SELECT doc_id, regexp_replace(lower(regexp_replace(regexp_replace(answer, '\s+', ' ', 'g'), '^[\s"''`.,;:!?()\[\]{{}}<>*_-]+', '')), '[\s"''`.,;:!?()\[\]{{}}<>*_-]+$', '') AS value, lower(coalesce(source, '')) AS gold FROM a)
 SELECT doc_id, value, gold <> '' AND contains(value, gold) AS correct FROM n""")
def graded_answers(spark, sf):
    """Answers in normal form, and whether the gold stands in them."""
    d = read_table(spark, sf, "documents").select("doc_id", F.expr(_ANSWER).alias("answer"), "source")
    return d.select("doc_id", M.normal_answer(F.col("answer")).alias("value"), M.answer_matches(F.col("answer"), F.col("source")).alias("correct"))


_ARM_ROWS = """SELECT doc_id, 'A1' AS arm, doc_id % 2 = 0 AS correct, false AS incomplete, 0 AS n_missing, false AS stale_hit FROM documents UNION ALL SELECT doc_id, 'A2', doc_id % 3 > 0, doc_id % 11 = 0, doc_id % 2, doc_id % 13 = 0 FROM documents
 UNION ALL SELECT doc_id, 'A3', doc_id % 5 > 0, false, 0, false FROM documents UNION ALL SELECT doc_id, 'A4', doc_id % 7 > 0, false, 0, false FROM documents UNION ALL SELECT doc_id, 'A0_null', doc_id % 17 = 0, false, 0, false FROM documents"""


@query(f"""WITH r AS ({_ARM_ROWS}), p AS (SELECT doc_id, bool_or(correct) FILTER (WHERE arm = 'A1') AS a1, bool_or(correct) FILTER (WHERE arm = 'A2') AS a2, bool_or(correct) FILTER (WHERE arm = 'A3') AS a3, bool_or(correct) FILTER (WHERE arm = 'A4') AS a4, bool_or(correct) FILTER (WHERE arm = 'A0_null') AS leak,
  bool_or(incomplete) FILTER (WHERE arm = 'A2') AS inc, max(n_missing) FILTER (WHERE arm = 'A2') AS miss, bool_or(stale_hit) AS stale FROM r GROUP BY 1),
 l AS (SELECT *, CASE WHEN inc AND NOT a2 THEN 'budget_overflow' WHEN NOT a4 THEN 'task_or_reader_failure' WHEN a3 AND NOT a2 THEN 'routing_miss' WHEN a2 AND NOT a1 THEN 'closure_miss' WHEN a4 AND NOT a3 THEN 'edge_coverage_miss' WHEN stale THEN 'stale_conflict' WHEN a2 THEN 'ok' ELSE 'ambiguous' END AS label FROM p)
 SELECT label, (label <> 'ambiguous') AND NOT leak AND (label <> 'budget_overflow' OR miss > 0) AS confident, count(*) AS n FROM l GROUP BY ALL""")
def attributions(spark, sf):
    """Which stage lost each item, by the first rule that its arms meet."""
    read_table(spark, sf, "documents").createOrReplaceTempView("attribution_documents")
    arms = spark.sql(_ARM_ROWS.replace("FROM documents", "FROM attribution_documents")).withColumnRenamed("doc_id", "item_id")
    return M.attribution(arms).groupBy("label", "confident").agg(F.count("*").alias("n"))


_GRID = "SELECT doc_id, coalesce(source, 'none') AS router, doc_id % 4 AS closure, doc_id % 3 AS budget, length(coalesce(text, '')) % 2 = 0 AS correct, length(coalesce(text, '')) % 200 AS n_required FROM documents"


@query(f"WITH g AS ({_GRID}) SELECT router, {', '.join(f'round(avg(CASE WHEN correct THEN 1.0 ELSE 0.0 END) FILTER (WHERE closure = {c}), 6) AS c{c}' for c in range(4))}, count(*) FILTER (WHERE n_required > 100) AS saturated, count(DISTINCT budget) = 3 AS complete FROM g GROUP BY router")
def grid_table(spark, sf):
    """Routers by closures with saturated cells (more than 100 required) and whether all budgets were run."""
    d = read_table(spark, sf, "documents")
    n = F.length(F.coalesce("text", F.lit("")))
    g = d.select(F.coalesce("source", F.lit("none")).alias("router"), (F.col("doc_id") % 4).alias("closure"), (F.col("doc_id") % 3).alias("budget"), (n % 2 == 0).cast("int").alias("correct"), (n % 200).alias("n_required"))
    table = g.groupBy("router").pivot("closure", list(range(4))).agg(round6(F.avg("correct"))).toDF("router", *[f"c{i}" for i in range(4)])
    return table.join(g.groupBy("router").agg(F.count_if(F.col("n_required") > 100).alias("saturated"), (F.countDistinct("budget") == 3).alias("complete")), "router")


@query("SELECT coalesce(lang, 'none') AS method, CASE WHEN grouping(kind) = 0 THEN coalesce(kind, 'none') ELSE 'all' END AS category, CASE WHEN grouping(half) = 0 THEN half ELSE 'all' END AS half, count(*) AS n, round(avg(CASE WHEN hit THEN 1.0 ELSE 0.0 END), 6) AS evidence FROM (SELECT lang, kind, CASE WHEN doc_id % 2 = 0 THEN 'even' ELSE 'odd' END AS half, contains(coalesce(text, ''), 'loader') AS hit FROM documents) GROUP BY GROUPING SETS ((lang, kind), (lang, half), (lang))")
def evidence_report(spark, sf):
    """Evidence by method, then category or half, in one pass over grouping sets."""
    d = read_table(spark, sf, "documents").select("lang", "kind", F.when(F.col("doc_id") % 2 == 0, "even").otherwise("odd").alias("half"), F.contains(F.coalesce("text", F.lit("")), F.lit("loader")).cast("int").alias("hit"))
    sets = [[F.col("lang"), F.col("kind")], [F.col("lang"), F.col("half")], [F.col("lang")]]
    g = d.groupingSets(sets, "lang", "kind", "half").agg(F.count("*").alias("n"), round6(F.avg("hit")).alias("evidence"), F.grouping("kind").alias("gk"), F.grouping("half").alias("gh"))
    return g.select(F.coalesce("lang", F.lit("none")).alias("method"), F.when(F.col("gk") == 0, F.coalesce("kind", F.lit("none"))).otherwise("all").alias("category"), F.when(F.col("gh") == 0, F.col("half")).otherwise("all").alias("half"), "n", "evidence")


@query("SELECT contains(lower(coalesce(text, '')), 'yes') AS judged, contains(coalesce(text, ''), 'loader') AS literal, count(*) AS n FROM documents GROUP BY ALL")
def judge_audit(spark, sf):
    """A judge's verdicts against the literal test, two by two."""
    c = F.coalesce("text", F.lit(""))
    return read_table(spark, sf, "documents").select(F.contains(F.lower(c), F.lit("yes")).alias("judged"), F.contains(c, F.lit("loader")).alias("literal")).groupBy("judged", "literal").agg(F.count("*").alias("n"))


@query("""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, n_chars, lang, session_id FROM documents) SELECT 'length differs' AS rule, count(*) AS n FROM d WHERE n_chars IS NOT NULL AND n_chars <> length(text) UNION ALL SELECT 'no language', count(*) FROM d WHERE lang IS NULL OR lang = 'und' UNION ALL SELECT 'empty text', count(*) FROM d WHERE trim(text) = ''
 UNION ALL SELECT 'unknown session', count(*) FROM d WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM trace_events) UNION ALL SELECT 'same text', coalesce(sum(n), 0) FROM (SELECT count(*) - 1 AS n FROM d WHERE text <> '' GROUP BY text HAVING count(*) > 1)""")
def dataset_audit(spark, sf):
    """One count of violations for each rule of the data set."""
    d = read_table(spark, sf, "documents").withColumn("text", F.coalesce("text", F.lit("")))
    known = read_table(spark, sf, "trace_events").select("session_id").distinct()
    same = d.filter("text <> ''").groupBy(F.xxhash64("text"), F.md5("text")).agg((F.count("*") - 1).alias("n")).agg(F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("n"))
    parts = {"length differs": d.filter("n_chars <> length(text)"), "no language": d.filter("lang is null or lang = 'und'"), "empty text": d.filter("trim(text) = ''"), "unknown session": d.filter("session_id is not null").join(known, "session_id", "left_anti")}
    out = same.select(F.lit("same text").alias("rule"), "n")
    for rule, rows in parts.items():
        out = out.unionByName(rows.agg(F.count("*").alias("n")).select(F.lit(rule).alias("rule"), "n"))
    return out


_FEATURES = {"length": "length({})", "digits": "len(regexp_extract_all({}, '[0-9]'))", "dashes": "len(regexp_extract_all({}, '[-_]'))", "first": "ascii({})"}


@query("WITH p AS (SELECT doc_id, coalesce(source, '') AS a, coalesce(kind, '') AS b FROM documents) " + " UNION ALL ".join(f"SELECT '{n}' AS feature, '{op}' AS polarity, round(avg(CASE WHEN {f.format('a')} {op} {f.format('b')} THEN 1.0 WHEN {f.format('a')} = {f.format('b')} THEN 0.5 ELSE 0.0 END), 6) AS hit FROM p" for n, f in _FEATURES.items() for op in (">", "<")))
def attack_surface(spark, sf):
    """How often features of the spelling alone tell a value from its distractor, in both polarities."""
    d = read_table(spark, sf, "documents").select(F.coalesce("source", F.lit("")).alias("a"), F.coalesce("kind", F.lit("")).alias("b"))
    col = {"length": F.length, "digits": lambda c: F.regexp_count(c, F.lit("[0-9]")), "dashes": lambda c: F.regexp_count(c, F.lit("[-_]")), "first": F.ascii}
    score = lambda x, y: F.when(x, 1.0).when(y, 0.5).otherwise(0.0)
    cols = [F.struct(F.lit(n).alias("feature"), F.lit(op).alias("polarity"), score(f("a") > f("b") if op == ">" else f("a") < f("b"), f("a") == f("b")).alias("hit")) for n, f in col.items() for op in (">", "<")]
    return d.select(F.explode(F.array(*cols)).alias("x")).select("x.*").groupBy("feature", "polarity").agg(round6(F.avg("hit")).alias("hit"))


_PI = "(SELECT DISTINCT session_id, row_no, role, content, isError FROM pi_rows)"


@query(f"WITH g AS (SELECT CASE WHEN isError THEN 'failed' ELSE 'passed' END AS t, CASE WHEN regexp_matches(content, '{T.FAILURE_LINE}') THEN 'failed' ELSE 'passed' END AS g FROM {_PI} WHERE role = 'toolResult' AND content <> '' AND isError IS NOT NULL), l AS (SELECT t AS x FROM g UNION SELECT g FROM g), f AS (SELECT x, 2.0 * count(*) FILTER (WHERE t = x AND g = x) / nullif(count(*) FILTER (WHERE t = x) + count(*) FILTER (WHERE g = x), 0) AS f1 FROM l, g GROUP BY x) SELECT round(avg(coalesce(f1, 0)), 6) AS macro_f1, count(*) AS n_labels, (SELECT round(avg(CASE WHEN t = g THEN 1.0 ELSE 0.0 END), 6) FROM g) AS accuracy FROM f")
def macro_f1(spark, sf):
    r = read_table(spark, sf, "pi_rows").select("session_id", "row_no", "role", "content", "isError").distinct().filter("role = 'toolResult' and content <> '' and isError is not null")
    return M.macro_f1(r.select(F.when(F.col("isError"), "failed").otherwise("passed").alias("t"), F.when(T.failed(F.col("content")), "failed").otherwise("passed").alias("g")), "t", "g")


@query(r"SELECT doc_id, coalesce(source <> '' AND regexp_matches(text, '(^|[^\p{L}\p{N}_.\-])' || regexp_escape(source) || '($|[^\p{L}\p{N}_.\-])'), false) AS correct FROM documents")
def perfect_reader(spark, sf):
    return read_table(spark, sf, "documents").select("doc_id", M.perfect_reader(F.col("text"), F.coalesce("source", F.lit(""))).alias("correct"))
