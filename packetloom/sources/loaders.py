"""Loaders and sinks around the scans: reader options, discovery, live events, collections of sessions, edge files, units."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.runtime import cut, ranked

#: options that a dialect knows; others are dropped
OPTIONS = {
    "claude_code": ("include_sidechain", "include_thinking", "link_edits", "link_values", "link_writes"), "pi": ("include_excluded", "link_values"), "openhands": ("link_values",),
}


def known_options(dialect: str, options: dict) -> dict:
    """The options that the dialect has; an unknown dialect raises."""
    if dialect not in OPTIONS:
        raise ValueError(f"unknown dialect {dialect!r}")
    return {k: v for k, v in options.items() if k in OPTIONS[dialect]}


def project_key(path: str) -> str:
    """A project's folder name: every character of its path that is no ASCII letter or digit becomes a dash."""
    return "".join(c if c.isascii() and c.isalnum() else "-" for c in path)


def discovered(spark: SparkSession, folder: str, pattern: str = "*.jsonl") -> DataFrame:
    """(path, project, session, bytes, modified, newest) of transcripts below a folder; 0 is a project's newest file.

    Files are listed by Spark and not opened.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(folder).select("path", "modificationTime", "length")
    parts = F.split("path", "/")
    d = files.select("path", F.element_at(parts, -2).alias("project"), F.regexp_replace(F.element_at(parts, -1), r"\.jsonl(\.gz)?$", "").alias("session"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))
    return d.withColumn("newest", F.row_number().over(Window.partitionBy("project").orderBy(F.desc("modified"), "path")) - 1)


def resolved(files: DataFrame, session: str = "latest", project: str | None = None) -> DataFrame:
    """The transcript of a session id, or a project's newest for ``latest``, ``current`` or an empty name."""
    own = files if project is None else files.filter(F.col("project") == project)
    if session in ("", "latest", "current"):
        return own.orderBy(F.desc("modified"), "path").limit(1)
    named = own.filter(F.col("session") == session)
    return named.orderBy(F.desc("modified"), "path").limit(1)


def live_rows(events: DataFrame, start: int = 0, keep: DataFrame | None = None) -> DataFrame:
    """Message rows of a running agent's events: (session_id, id, role, content, tool_calls).

    ``events``: session_id, n (its place), event_id, kind, role, text, tool_name, tool_call_id, arguments. Messages, actions and
    observations become rows with ids from ``start`` on; other kinds are skipped, as are ids that ``keep`` does not list.
    """
    e = events.filter(F.col("kind").isin("MessageEvent", "ActionEvent", "ObservationEvent"))
    if keep is not None:
        e = e.join(keep.select("session_id", "event_id"), ["session_id", "event_id"], "left_semi")
    e = ranked(e, ["session_id"], ["n", "event_id"], "at").withColumn("id", F.format_string("m%06d", F.col("at") + start))
    call = F.array(F.struct(F.coalesce("tool_call_id", "id").alias("id"), F.lit("function").alias("type"), F.struct(F.coalesce("tool_name", F.lit("tool")).alias("name"), F.coalesce("arguments", F.lit("{}")).alias("arguments")).alias("function")))
    role = F.when(F.col("kind") == "MessageEvent", F.coalesce("role", F.lit("user"))).when(F.col("kind") == "ActionEvent", "assistant").otherwise("tool")
    return e.select("session_id", "id", role.alias("role"), F.coalesce("text", F.lit("")).alias("content"), F.when(F.col("kind") == "ActionEvent", call).alias("tool_calls"))


def event_files(spark: SparkSession, folder: str) -> DataFrame:
    """(file_name, event) of a folder of ``event-*`` JSON files; their names give the order. Damaged files are left out."""
    d = spark.read.text(folder, wholetext=True, pathGlobFilter="event-*").select(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1).alias("file_name"), F.try_parse_json("value").alias("event"))
    return d.filter("event is not null")


def concatenated(lines: DataFrame, group: str, order: list[str], out: str = "global_no") -> DataFrame:
    """Lines of several files of a group as one history, numbered from 1 in the order of files and lines."""
    return ranked(lines, [group], order, "_rank").withColumn(out, F.col("_rank") + 1).drop("_rank")


# fixed values: how a session's date and the question stand in the prompts
SESSION_DATE, SESSION_TEXT = "[Chat session on ", "]\n"
QUESTION_DATE, QUESTION_TEXT = "[Current date: ", "]\nBased on our past conversations, please answer: "


def dated_messages(items: DataFrame) -> DataFrame:
    """Messages of question items: (item_id, session_no, message_no, role, content, date).

    ``items``: item_id, dates ARRAY<STRING>, sessions ARRAY<ARRAY<STRUCT<role, content>>>. A session's first message carries
    its date; roles other than user are the assistant's.
    """
    s = items.select("item_id", "dates", F.posexplode("sessions").alias("session_no", "s")).select("item_id", "session_no", F.get("dates", F.col("session_no")).alias("date"), F.posexplode("s").alias("message_no", "m"))
    text = F.coalesce("m.content", F.lit(""))
    return s.select("item_id", "session_no", "message_no", F.when(F.col("m.role") == "user", "user").otherwise("assistant").alias("role"), F.when(F.col("message_no") == 0, F.concat(F.lit(SESSION_DATE), "date", F.lit(SESSION_TEXT), text)).otherwise(text).alias("content"), "date")


def question_text(items: DataFrame) -> DataFrame:
    """(item_id, content) of items with question and question_date."""
    return items.select("item_id", F.concat(F.lit(QUESTION_DATE), "question_date", F.lit(QUESTION_TEXT), "question").alias("content"))


def edge_table(rows: DataFrame) -> DataFrame:
    """(session_id, src_id, dst_id, predicate) of a file of edges; a row without a session refuses the whole file, as ids
    are unique only within a session."""
    sid = F.when(F.coalesce("session", F.lit("")) != "", F.col("session")).otherwise(F.raise_error(F.lit("an edge without a session")))
    return rows.select(sid.alias("session_id"), "src_id", "dst_id", F.coalesce("predicate", F.lit("")).alias("predicate"))


def answered(prompts: DataFrame, ask, batch_column: str = "prompt") -> DataFrame:
    """Prompts with ``reply`` from any function of a list of prompts to a list of replies (a model's batch endpoint).

    Rows are streamed in batches; a batch that fails is tried three times, then its replies are null.
    """
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in prompts.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(batch_column).to_pylist()
            got = None
            for _ in range(3):
                try:
                    got = list(ask(texts))
                    break
                except Exception:  # noqa: BLE001  the endpoint's own errors
                    continue
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got if got is not None else [None] * len(texts), pa.string())], names=[*b.schema.names, "reply"])

    return prompts.mapInArrow(run, kinds + ", reply string")


def replayed(prompts: DataFrame, recorded: DataFrame) -> DataFrame:
    """Prompts with the replies recorded for the same item and context: both have item_id and context_hash."""
    return prompts.join(recorded.select("item_id", "context_hash", "reply").dropDuplicates(["item_id", "context_hash"]), ["item_id", "context_hash"], "left")


def write_units(units: DataFrame, path: str, keys: list[str]) -> int:
    """Write units whose keys are not yet at ``path`` (Parquet); returns how many. A run that was cut off is taken up."""
    spark = units.sparkSession
    fs = spark._jvm.org.apache.hadoop.fs.Path(path)
    if fs.getFileSystem(spark._jsc.hadoopConfiguration()).exists(fs):
        units = units.join(spark.read.parquet(path).select(*keys).distinct(), keys, "left_anti")
    new = cut(units)
    new.write.mode("append").parquet(path)
    return new.count()


def write_archive(rows: DataFrame, path: str, compress: bool = True) -> None:
    """Rows as JSON lines, compressed with gzip unless told otherwise."""
    rows.write.mode("overwrite").option("compression", "gzip" if compress else "none").json(path)


DEMO = (
    ("user", "Why is the nightly export empty since Monday?"), ("assistant", "I will look at the export job."), ("tool_call", 'Bash {"command": "cat jobs/export.toml"}'), ("tool_result", "table = ledger_v1\nhour = 3"),
    ("assistant", "The job still reads ledger_v1."), ("tool_call", 'Bash {"command": "grep -rn ledger_v2 src"}'), ("tool_result", "src/schema.py:41: rename ledger_v1 to ledger_v2"), ("decision", "Read ledger_v2 in the export, as src/schema.py:41 renames it."),
    ("tool_call", 'Edit {"file_path": "jobs/export.toml", "new_string": "table = ledger_v2", "old_string": "table = ledger_v1"}'), ("tool_result", "ok"), ("summary", "Current Work:\nthe export reads ledger_v2 now\n"),
    ("user", "Which hour does it run?"), ("assistant", "I do not have the file in view."), ("user", "Look it up."),
)


def demo_session(spark: SparkSession, session_id: str = "demo") -> DataFrame:
    """A session of fourteen events with one compaction, in the shape of trace_events."""
    rows, call = [], 0
    for n, (kind, text) in enumerate(DEMO, 1):
        call += kind == "tool_call"
        rows.append((session_id, f"cc:{n:08d}:000", kind, text, 1_700_000_000_000 + n * 1000, str(n), f"call{call}" if kind.startswith("tool") else None, None, len(text) // 4, f"cc:tool:call{call}" if kind.startswith("tool") else None, {"tool": text.split(" ")[0]} if kind == "tool_call" else {}, None))
    return spark.createDataFrame(rows, "session_id string, event_id string, kind string, text string, ts long, step_id string, tool_call_id string, native_ref string, token_cost int, atomic_group string, meta map<string,string>, received_at timestamp")
