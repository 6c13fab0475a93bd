"""Queries of the operators for training data of language models."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from packetloom.llm import chunking, containers, conversations, pii, secrets, tokenizer
from packetloom.runtime import cut, read_table


def _documents(spark: SparkSession, sf: str) -> DataFrame:
    return read_table(spark, sf, "documents").select("doc_id", "text")


def _messages(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    return read_table(spark, sf, "oh_rows"), read_table(spark, sf, "pi_rows")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    _, broken = conversations.rebuild(*_messages(spark, sf))
    return broken.select("tbl", "conv_id")


def p1_reasons(spark: SparkSession, sf: str) -> DataFrame:
    """Every conversation with a reason to drop it or with a loop or roles out of order."""
    return conversations.reasons_of(*_messages(spark, sf))[1]


def p1_conversations(spark: SparkSession, sf: str) -> DataFrame:
    messages, _ = conversations.rebuild(*_messages(spark, sf))
    return conversations.with_results(messages, *_messages(spark, sf))


_EVENT = ["session_id", "event_id"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return p2_pieces(spark, sf).filter("piece_no = 0").select(*_EVENT)


def p2_pieces(spark: SparkSession, sf: str) -> DataFrame:
    return chunking.split_oversized(read_table(spark, sf, "trace_events"), _EVENT)


def _texts(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.recorded_texts(read_table(spark, sf, "trace_events"), read_table(spark, sf, "oh_rows"))


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    spans = secrets.secret_spans(_texts(spark, sf)).filter("first_in_line")
    return spans.select("tbl", "conv_id", "rec_id", "line_no").distinct()


def p4_masked(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.redact(_texts(spark, sf).dropDuplicates(["tbl", "conv_id", "rec_id"]))


def p7_ids(spark: SparkSession, sf: str) -> DataFrame:
    return tokenizer.encode_texts(_documents(spark, sf))


def p8_containers(spark: SparkSession, sf: str) -> DataFrame:
    return containers.fill_containers(cut(tokenizer.count_tokens(_documents(spark, sf))))


def p8_found(spark: SparkSession, sf: str) -> DataFrame:
    return p8_containers(spark, sf).filter("piece_no = 1").select("doc_id")


def p9_found(spark: SparkSession, sf: str) -> DataFrame:
    field = pii.field_for(read_table(spark, sf, "contributors"))
    return pii.find_items(_documents(spark, sf), field).select("doc_id", "line_no", "pii_kind").distinct()


def p9_masked(spark: SparkSession, sf: str) -> DataFrame:
    return pii.replace_items(_documents(spark, sf), pii.field_for(read_table(spark, sf, "contributors")))


QUERIES = {f.__name__: f for f in (p1_found, p1_reasons, p1_conversations, p2_found, p2_pieces, p4_found, p4_masked, p7_ids, p8_containers, p8_found, p9_found, p9_masked)}
_BLANK = r"[\s\p{Z}\x{1c}-\x{1f}\x{85}]"
_BLOCKS = ", ".join(f"'{t}'" for t in sorted(conversations.BLOCK_TYPES))
_ROLE = "CASE " + " ".join(f"WHEN r = '{k}' THEN '{v}'" for k, v in conversations.ROLES.items()) + " WHEN r IS NOT NULL THEN 'other' END"
_P1 = rf"""x AS (SELECT DISTINCT 'oh_rows' AS tbl, trajectory_id AS conv_id, row_no, true AS is_message, role, content, list_transform(tool_calls, lambda c: c.id) AS listed, tool_call_id AS rid FROM oh_rows
  UNION ALL SELECT DISTINCT 'pi_rows', session_id, row_no, coalesce(type = 'message', false), role, content, NULL, toolCallId FROM pi_rows),
 e AS (SELECT *, CASE WHEN regexp_matches(content, '^{_BLANK}*[\[{{]') AND json_valid(content) THEN CASE WHEN json_type(content) = 'OBJECT' THEN [CAST(content AS JSON)] ELSE json_extract(content, '$[*]') END END AS els, lower(replace(regexp_replace(role, '{_BLANK}', '', 'g'), '_', '')) AS r FROM x WHERE conv_id IS NOT NULL AND row_no IS NOT NULL),
 b AS (SELECT *, {_ROLE} AS kind, CASE WHEN els IS NOT NULL AND len(list_filter(els, lambda v: NOT coalesce(json_type(v) = 'OBJECT' AND json_extract_string(v, '$.type') IN ({_BLOCKS}), false))) = 0 THEN els END AS blocks FROM e),
 m AS (SELECT tbl, conv_id, row_no, is_message, kind, CASE WHEN kind = 'tool' THEN rid END AS rid, CASE WHEN blocks IS NULL THEN coalesce(NOT regexp_matches(content, '^{_BLANK}*$'), false) ELSE len(list_filter(blocks, lambda v: json_extract_string(v, '$.type') IN ('text', 'input_text', 'output_text') AND json_type(v, '$.text') = 'VARCHAR' AND NOT regexp_matches(json_extract_string(v, '$.text'), '^{_BLANK}*$'))) > 0 END AS has,
  CASE WHEN kind <> 'assistant' OR kind IS NULL THEN [] WHEN len(listed) > 0 THEN listed ELSE list_transform(list_filter(coalesce(blocks, []), lambda v: json_extract_string(v, '$.type') IN ('toolCall', 'tool_use')), lambda v: CASE WHEN json_type(v, '$.id') = 'VARCHAR' THEN json_extract_string(v, '$.id') END) END AS calls FROM b),
 places AS (SELECT tbl, conv_id, min(row_no) <> 1 OR count(*) < max(row_no) AS gap FROM m GROUP BY ALL),
 ends AS (SELECT tbl, conv_id, bool_or(kind = 'user' AND has) AS asked, arg_max(kind = 'assistant' AND has, row_no) FILTER (WHERE kind IN ('user', 'assistant', 'tool')) AS closed FROM m WHERE is_message GROUP BY ALL),
 mv AS (SELECT tbl, conv_id, row_no, unnest(calls) AS id, 1 AS step FROM m WHERE is_message UNION ALL SELECT tbl, conv_id, row_no, rid, -1 FROM m WHERE is_message AND kind = 'tool'),
 ids AS (SELECT tbl, conv_id, id, min(row_no) FILTER (WHERE step = 1) AS c0, max(row_no) FILTER (WHERE step = 1) AS c1, min(row_no) FILTER (WHERE step = -1) AS r0, max(row_no) FILTER (WHERE step = -1) AS r1 FROM mv GROUP BY ALL),
 named AS (SELECT tbl, conv_id, count(id) > 0 AS named, bool_or(r0 IS NOT NULL AND (c0 IS NULL OR r0 <= c0 OR id IS NULL)) OR bool_or(c1 IS NOT NULL AND (r1 IS NULL OR r1 <= c1 OR id IS NULL)) AS bad FROM ids GROUP BY ALL),
 run AS (SELECT tbl, conv_id, sum(step) OVER (PARTITION BY tbl, conv_id ORDER BY row_no, step ROWS UNBOUNDED PRECEDING) AS run, step FROM mv WHERE id IS NULL), fifo AS (SELECT tbl, conv_id, min(run) < 0 OR sum(step) > 0 AS bad FROM run GROUP BY ALL)"""
ORACLE: dict[str, str] = {
    "p1_found": f"""WITH {_P1} SELECT p.tbl, p.conv_id FROM places p LEFT JOIN ends e ON e.tbl = p.tbl AND e.conv_id = p.conv_id LEFT JOIN named n ON n.tbl = p.tbl AND n.conv_id = p.conv_id LEFT JOIN fifo f ON f.tbl = p.tbl AND f.conv_id = p.conv_id
 WHERE gap OR NOT coalesce(asked, false) OR NOT coalesce(closed, false) OR CASE WHEN coalesce(named, false) THEN n.bad ELSE coalesce(f.bad, false) END""",
    "p2_found": "SELECT DISTINCT session_id, event_id FROM trace_events WHERE length(text) // 4 > 1024",
}
