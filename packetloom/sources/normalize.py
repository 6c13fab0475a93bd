"""Native rows of the three dialects as typed events (text flattened, calls as name and sorted arguments)."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.flatten import as_list, as_value, field
from packetloom.runtime import first_rows

EVENT = "session_id string, line_no long, block_no int, kind string, text string, tool_call_id string, native_ref string, meta map<string,string>"


def flat_text(content) -> str:
    """Text of a string or of the text parts of a list."""
    if content is None:
        return ""
    parts = as_value(content) if isinstance(content, str) else content
    if isinstance(content, str) and not isinstance(parts, (list, dict)):
        return content
    parts = parts if isinstance(parts, list) else [parts]
    return "\n".join(p.get("text") or "" if isinstance(p, dict) else p for p in parts if isinstance(p, (dict, str)) and (isinstance(p, str) or p.get("type", "text") == "text"))


def call_text(name, arguments) -> str:
    """Name and arguments with sorted keys; arguments that are no JSON are kept as they are under ``_raw``."""
    args = as_value(arguments) if isinstance(arguments, str) else arguments
    if not isinstance(args, dict):
        args = {} if arguments in (None, "") else {"_raw": arguments}
    return f"{name or 'tool'} {json.dumps(args, sort_keys=True, ensure_ascii=False)}"


def claude_blocks(kind, role, content, summary) -> Iterator[tuple[str, str, str | None, dict]]:
    if kind not in ("user", "assistant"):
        return
    if summary:
        yield "summary", flat_text(content), None, {}
        return
    blocks = as_list(content)
    if not blocks or not all(isinstance(b, dict) and "type" in b for b in blocks):
        yield kind, content or "", None, {}
        return
    for b in blocks:
        t = b.get("type")
        if t == "text":
            yield kind, b.get("text") or "", None, {}
        elif t == "thinking":
            yield kind, b.get("thinking") or "", None, {"thinking": "1"}
        elif t == "tool_use":
            yield "tool_call", call_text(b.get("name"), b.get("input")), b.get("id"), {"tool": b.get("name") or ""}
        elif t == "tool_result":
            yield "tool_result", flat_text(field(b, "content")), b.get("tool_use_id"), {"is_error": "1"} if b.get("is_error") else {}


def pi_blocks(kind, role, content, call_id, command, output, summary) -> Iterator[tuple[str, str, str | None, dict]]:
    if kind in ("compaction", "branch_summary"):
        yield "summary", summary or "", None, {}
    elif kind == "custom_message":
        yield "user", flat_text(content), None, {"custom": "1"}
    elif kind == "message" and role == "bashExecution":
        yield "tool_call", f"bash {json.dumps({'command': command or ''}, ensure_ascii=False)}", None, {"tool": "bash"}
        yield "tool_result", output or "", None, {"tool": "bash"}
    elif kind == "message" and role == "toolResult":
        yield "tool_result", flat_text(content), call_id, {}
    elif kind == "message":
        blocks = as_list(content)
        if not blocks or not all(isinstance(b, dict) and "type" in b for b in blocks):
            yield role, content or "", None, {}
            return
        for b in blocks:
            if b["type"] == "toolCall":
                yield "tool_call", call_text(b.get("name"), b.get("arguments")), b.get("id"), {"tool": b.get("name") or ""}
            elif b["type"] in ("text", "thinking"):
                yield role, b.get(b["type"]) or "", None, {"thinking": "1"} if b["type"] == "thinking" else {}


def oh_blocks(role, content, call_id, calls) -> Iterator[tuple[str, str, str | None, dict]]:
    role = {"human": "user", "ai": "assistant", "model": "assistant", "function": "tool"}.get((role or "").strip().lower(), (role or "").strip().lower())
    if role == "user":
        yield "user", flat_text(content), None, {}
    elif role == "tool":
        yield "tool_result", flat_text(content), call_id, {}
    elif role == "assistant":
        yield "assistant", flat_text(content), None, {}
        for c in calls if calls is not None else []:
            f = c["function"] or {}
            name = f["name"] if f else None
            yield "tool_call", call_text(name, f["arguments"] if f else None), c["id"], {"tool": name or "", **({"noop": "1"} if name == "think" else {}), **({"agent_authored": "1"} if name == "finish" else {})}


def _explode(visit, columns: list[str]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for rec in zip(b["session_id"], b["line_no"], b["ref"], *(b[c] for c in columns)):
                for i, (kind, text, call, meta) in enumerate(visit(*rec[3:])):
                    if text and text.strip():
                        rows.append((rec[0], rec[1], i, kind, text, call, rec[2], meta))
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in EVENT.split(", ")])

    return run


def events_of(rows: DataFrame, dialect: str) -> DataFrame:
    """Typed events of native rows: ids ``<dialect>:<line>:<block>``, monotone times, costs and atomic groups.

    Side chains and bookkeeping rows are dropped, blank texts give no event, repeats are merged by their key. A
    null time takes the last one; a time before an earlier one is lifted to it and kept in meta.
    """
    if dialect == "claude_code":
        r = first_rows(rows, ["session_id", "line_no"]).filter(~F.coalesce("isSidechain", F.lit(False))).withColumn("ref", F.col("uuid"))
        cols, visit = ["type", "role", "content", "isCompactSummary"], claude_blocks
    elif dialect == "pi":
        r = first_rows(rows, ["session_id", "row_no"]).withColumn("line_no", F.col("row_no")).withColumn("ref", F.col("id"))
        cols, visit = ["type", "role", "content", "toolCallId", "command", "output", "summary"], pi_blocks
    else:
        r = first_rows(rows, ["trajectory_id", "row_no"]).withColumn("session_id", F.col("trajectory_id")).withColumn("line_no", F.col("row_no")).withColumn("ref", F.col("id")).withColumn("ts", F.lit(None).cast("timestamp"))
        cols, visit = ["role", "content", "tool_call_id", "tool_calls"], oh_blocks
    ev = r.select("session_id", "line_no", "ref", *cols).mapInPandas(_explode(visit, cols), EVENT)
    native = F.unix_millis(F.col("ts").cast("timestamp"))
    w = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    clock = r.select("session_id", "line_no", native.alias("native_ts"), F.coalesce(F.max(native).over(w), F.lit(0)).alias("ts"))
    ident = F.format_string("%s:%08d:%03d", F.lit(dialect), F.col("line_no"), F.col("block_no"))
    return ev.join(clock, ["session_id", "line_no"]).select(
        "session_id", ident.alias("event_id"), "kind", "text", "ts", F.col("line_no").cast("string").alias("step_id"), "tool_call_id", "native_ref", T.tokens_floor(F.col("text")).alias("token_cost"),
        F.when(F.col("tool_call_id").isNotNull(), F.concat(F.lit(f"{dialect}:tool:"), "tool_call_id")).alias("atomic_group"),
        F.when(F.col("native_ts") < F.col("ts"), F.map_concat("meta", F.create_map(F.lit("timestamp_native"), F.col("native_ts").cast("string")))).otherwise(F.col("meta")).alias("meta"),
    )
