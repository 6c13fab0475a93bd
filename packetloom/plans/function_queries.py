"""Registered queries of the scalar text functions, each with the SQL that checks it over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.runtime import first_rows, read_table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}

EVENTS = "(SELECT DISTINCT session_id, event_id, kind, text, ts, step_id, meta FROM trace_events WHERE text IS NOT NULL)"


def quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def listed(words) -> str:
    return "[" + ", ".join(map(quoted, words)) + "]"


def document(name: str, value: Callable[[], Column], sql: str) -> None:
    """A function of a document's text (and its other columns)."""
    def run(spark, sf):
        return read_table(spark, sf, "documents").filter("text is not null").select("doc_id", value().alias("value"))

    QUERIES[name], ORACLE[name] = run, f"SELECT doc_id, {sql} AS value FROM documents WHERE text IS NOT NULL"


def event(name: str, value: Callable[[], Column], sql: str, where: str = "true") -> None:
    """A function of an event's text (and its other columns)."""
    def run(spark, sf):
        return first_rows(read_table(spark, sf, "trace_events"), ["session_id", "event_id"]).filter("text is not null").filter(where).select("session_id", "event_id", value().alias("value"))

    QUERIES[name], ORACLE[name] = run, f"SELECT session_id, event_id, {sql} AS value FROM {EVENTS} WHERE {where}"



def c() -> Column:
    return F.col("text")


def _joined(a: Column) -> Column:
    return F.md5(F.array_join(F.array_sort(a), " "))


_QT = f"list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_./\\-:@#+]*'), lambda t: trim(lower(t), '.:,;/')), lambda t: length(t) >= 3 AND NOT list_contains({listed(T.QUERY_STOP)}, t))"
document(
    "fn_query_terms", lambda: _joined(T.query_terms(c())),
    f"md5(array_to_string(list_sort(list_distinct(list_concat({_QT}, list_filter(list_transform(list_filter({_QT}, lambda t: contains(t, '/')), lambda t: string_split(t, '/')[-1]), lambda t: length(t) >= 3 AND NOT list_contains({listed(T.QUERY_STOP)}, t))))), ' '))",
)
document(
    "fn_session_terms", lambda: F.md5(F.array_join(T.session_terms(c()), " ")),
    f"md5(array_to_string(list_filter(list_transform(regexp_extract_all(text, '[A-Za-z0-9_][A-Za-z0-9_./:\\-]{{2,}}'), lambda t: trim(lower(t), '.:-/')), lambda t: t <> '' AND NOT list_contains({listed(T.SESSION_STOP)}, t)), ' '))",
)
document("fn_contains_value", lambda: T.contains_value(c(), F.coalesce("source", F.lit(""))), r"coalesce(source <> '' AND regexp_matches(text, '(^|[^\p{L}\p{N}_.\-])' || regexp_escape(source) || '($|[^\p{L}\p{N}_.\-])'), false)")


def _redactions_sql() -> str:
    text, n = "text", []
    for rx, to in [*((rx, "[redacted]") for rx in T.REDACTIONS), (T.REDACT_BEARER, "\\1 [redacted]"), (T.REDACT_ASSIGNED, "")]:
        n.append(f"len(regexp_extract_all({text}, {quoted(rx)}))")
        text = f"regexp_replace({text}, {quoted(rx)}, {quoted(to)}, 'g')"
    return f"CAST({' + '.join(n)} AS INT)"


document("fn_redactions", lambda: T.redactions(c()).cast("int"), _redactions_sql())
document(
    "fn_answer_values", lambda: _joined(T.answer_values(c())),
    f"md5(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all(text, {quoted(T.ANSWER_VALUE)}), lambda v: trim(v, '.:-/')), lambda v: length(v) >= 3 AND NOT regexp_matches(v, '^[A-Za-z]+$')))), ' '))",
)
document("fn_shape", lambda: F.md5(T.shape(c())), "md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '[a-z]', chr(1), 'g'), '[A-Z]', 'u', 'g'), '[0-9]', 'd', 'g'), chr(1), 'l', 'g'))")
document(
    "fn_profile_distance", lambda: T.profile_distance(F.coalesce("source", F.lit("")), F.coalesce("kind", F.lit(""))),
    "CAST(" + " + ".join(f"abs({f.format('coalesce(source, ' + quoted('') + ')')} - {f.format('coalesce(kind, ' + quoted('') + ')')})" for f in ("length({})", "len(regexp_extract_all({}, '_'))", "len(regexp_extract_all({}, '-'))", "len(regexp_extract_all({}, '[0-9]'))", r"len(regexp_extract_all({}, '\p{{L}}'))")) + " AS INT)",
)
document("fn_filler", lambda: F.md5(T.filler(c())), "md5(CASE WHEN length(text) < 10 THEN repeat('x', length(text)) ELSE rpad('[REDACTED]', CAST(length(text) AS INT), 'x') END)")
document("fn_side", lambda: T.side(F.col("doc_id").cast("string")), "list_contains(['1', '3', '5', '7', '9', 'b', 'd', 'f'], sha1(CAST(doc_id AS VARCHAR))[-1])")
document(
    "fn_leaks", lambda: T.leaks(c(), F.coalesce("source", F.lit("none")), F.lit("number")),
    "contains(lower(text), lower(coalesce(source, 'none'))) OR len(list_filter(range(1, greatest(length(coalesce(source, 'none')) - 5, 1) + 1), lambda i: length(substr(lower(trim(coalesce(source, 'none'))), i, 6)) = 6 AND contains(lower(text), substr(lower(trim(coalesce(source, 'none'))), i, 6)))) > 0",
)
document("fn_yes_no", lambda: T.yes_no(c()), r"nullif(regexp_extract(lower(text), '\b(yes|no)\b', 1), '')")
_REPLY = "CASE doc_id % 4 WHEN 0 THEN ' correct. ' WHEN 1 THEN '**Wrong** ' WHEN 2 THEN 'not wrong ' ELSE '' END || text"
document("fn_right_wrong", lambda: T.right_wrong(F.expr(_REPLY)), f"CASE WHEN trim(regexp_extract(upper({_REPLY}), '^\\s*(\\S+)', 1), '.,:;*`\"''') IN ('CORRECT', 'WRONG') THEN trim(regexp_extract(upper({_REPLY}), '^\\s*(\\S+)', 1), '.,:;*`\"''') END")
document(
    "fn_recorded_date", lambda: T.recorded_date(F.concat(F.lit("on "), F.date_format("created_at", "yyyy/MM/dd"), F.when(F.col("doc_id") % 2 == 0, " (Tue) ").otherwise(" "), F.date_format("created_at", "H:mm"))),
    "CAST(date_trunc('minute', created_at) AS TIMESTAMP)",
)
document("fn_exact_request", lambda: T.exact_request(c()), (
    f"coalesce('keyword:' || nullif(lower(regexp_extract(text, {quoted('(?i)' + chr(92) + 'b(?:' + '|'.join(T.EXACT_WORDS) + ')' + chr(92) + 'b')})), ''), 'keyword:' || list_filter({listed(T.EXACT_SIGNS)}, lambda w: contains(text, w))[1], "
    + ", ".join(f"CASE WHEN regexp_matches(text, {quoted(rx)}) THEN '{n}' END" for n, rx in (("url", T.EXACT_URL), ("path", T.EXACT_PATH), ("hash", T.EXACT_HASH), ("quoted", T.EXACT_QUOTED), ("digit", r"\d"))) + ")"
))
document("fn_validation", lambda: T.validation(c()), f"CASE WHEN text = '' THEN 'unknown' WHEN regexp_matches(text, {quoted(T.FAILURE_LINE)}) THEN 'failed' ELSE 'passed' END")
document("fn_validation_words", lambda: T.validation(c(), legacy=True), f"CASE WHEN text = '' THEN 'unknown' WHEN regexp_matches(text, {quoted(T.FAILURE_WORD)}) THEN 'failed' ELSE 'passed' END")
document("fn_writes_files", lambda: T.writes_files(c()), f"regexp_matches(text, {quoted(T.TERMINAL_WRITE)})")
document(
    "fn_relative_path", lambda: T.relative_path(F.concat(F.expr("CASE doc_id % 3 WHEN 0 THEN ' \"/testbed/' WHEN 1 THEN './' ELSE '/testbedding/' END"), F.coalesce("source", F.lit("")))),
    "CASE doc_id % 3 WHEN 0 THEN coalesce(source, '') WHEN 1 THEN coalesce(source, '') ELSE '/testbedding/' || coalesce(source, '') END",
)
event("fn_when_short", lambda: T.when_short(F.col("ts")), "CASE WHEN coalesce(ts, 0) = 0 THEN '' ELSE strftime(make_timestamp(ts * 1000), '%m-%d %H:%M') END")
event(
    "fn_noise", lambda: T.is_noise(F.col("kind"), c(), F.try_element_at("meta", F.lit("is_meta"))),
    "kind = 'summary' OR coalesce(meta['is_meta'] = '1', false) OR (kind = 'user' AND (" + " OR ".join(f"starts_with(ltrim(text, ' ' || chr(9) || chr(10) || chr(13)), {quoted(b)})" for b in T.NOISE_BEGIN) + "))",
)
_TOOL = "split_part(text, ' ', 1)"
_ARGS = "substr(text, length(split_part(text, ' ', 1)) + 2)"


def _arg(name: str) -> str:
    return f"CASE WHEN json_valid({_ARGS}) AND starts_with({_ARGS}, '{{') AND json_type({_ARGS}, '$.{name}') = 'VARCHAR' THEN json_extract_string({_ARGS}, '$.{name}') END"


event("fn_pretty_call", lambda: T.pretty_call(F.substring_index("text", " ", 1), c()), f"coalesce(CASE {_TOOL} WHEN 'Bash' THEN '$ ' || {_arg('command')} WHEN 'Read' THEN 'Read ' || {_arg('file_path')} END, text)", "kind = 'tool_call'")
event(
    "fn_call_hint", lambda: T.call_hint(F.substring_index("text", " ", 1), c()),
    f"coalesce(CASE WHEN {_TOOL} = 'Bash' THEN '`' || left({_arg('command')}, 80) || CASE WHEN length({_arg('command')}) > 80 THEN '…' ELSE '' END || '`' END, "
    + ", ".join(f"'`' || right({_arg(k)}, 80) || '`'" for k in ("file_path", "path", "pattern", "url", "query", "notebook_path")) + ", '')", "kind = 'tool_call'",
)
event(
    "fn_label", lambda: T.label(F.col("kind"), F.when(F.col("kind") == "tool_call", F.substring_index("text", " ", 1)), F.col("ts"), F.col("step_id"), F.length("text") % 2 == 0),
    f"concat_ws(' · ', CASE kind WHEN 'tool_call' THEN ltrim({_TOOL} || ' call') WHEN 'tool_result' THEN 'output' WHEN 'user' THEN 'user said' WHEN 'assistant' THEN 'assistant said' ELSE kind END, CASE WHEN coalesce(ts, 0) <> 0 THEN strftime(make_timestamp(ts * 1000), '%m-%d %H:%M') END, 'L' || step_id, CASE WHEN length(text) % 2 = 0 THEN 'changed later' END)",
)


def fn_values(spark, sf):
    """Values of an event by type; a value counts for the first type that has it."""
    d = first_rows(read_table(spark, sf, "trace_events"), ["session_id", "event_id"]).filter("text is not null")
    v = d.select("session_id", "event_id", F.explode(T.values_in(F.col("text"))).alias("v")).groupBy("session_id", "event_id", F.col("v.value").alias("value")).agg(F.min("v.type_no").alias("n"))
    return v.select("session_id", "event_id", "value", F.element_at(F.array(*map(F.lit, T.VALUE_TYPES)), F.col("n") + 1).alias("value_type"))


def fn_identifiers(spark, sf):
    """Identifiers of a text; their word boundaries are those of all scripts, which DuckDB's expressions do not know."""
    return read_table(spark, sf, "documents").filter("text is not null").select("doc_id", F.explode(T.identifiers(F.col("text"))).alias("identifier"))


def fn_summary_query(spark, sf):
    d = first_rows(read_table(spark, sf, "trace_events"), ["session_id", "event_id"]).filter("kind = 'summary' and text is not null")
    return d.select("session_id", "event_id", T.summary_query(F.col("text")).alias("value"))


def fact_density(spark, sf):
    """Sentences of users with their facts for the length."""
    d = first_rows(read_table(spark, sf, "trace_events"), ["session_id", "event_id"]).filter("kind = 'user' and text is not null")
    s = d.select("session_id", "event_id", F.posexplode(T.units(F.col("text"))).alias("unit_no", "unit"))
    return s.select("session_id", "event_id", "unit_no", F.round(T.fact_score(F.col("unit")), 6).alias("score"), F.round(T.fact_density(F.col("unit")), 6).alias("density"))


QUERIES |= {f.__name__: f for f in (fn_values, fn_identifiers, fn_summary_query, fact_density)}
