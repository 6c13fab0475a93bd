"""Samples, literal quotes, kept file views and grids of named arms."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators.events import EDGE
from packetloom.runtime import cut

# --- literal quotes ------------------------------------------------------------------------------------------------
QUOTE_KEYS = ("old_string", "new_string", "content", "new_source")
QUOTE_CHARS, LOOKBACK, SCAN_CHARS, QUOTE_CAP, QUOTE_EDGES, OCCURRENCES = 40, 120, 120_000, 20_000, 2, 8


def shared_run(quote: str, text: str, least: int = QUOTE_CHARS, enough: int = 4 * QUOTE_CHARS) -> int:
    """Length of the longest run of letters that both have; white space alone is none; ends at ``enough``.

    Every run of ``least`` letters holds a whole window of half that width of the quote, so windows are sought and grown
    both ways; a window is followed at its first eight places.
    """
    step, best = least // 2, 0
    if len(quote) < least or len(text) < least:
        return 0
    for i in range(0, len(quote) - step + 1, step):
        at = -1
        for _ in range(OCCURRENCES):
            at = text.find(quote[i:i + step], at + 1)
            if at < 0:
                break
            a, b = 0, step
            while a < min(i, at) and quote[i - a - 1] == text[at - a - 1]:
                a += 1
            while i + b < len(quote) and at + b < len(text) and quote[i + b] == text[at + b]:
                b += 1
            if a + b > best and quote[i - a:i + b].strip():
                best = a + b
            if best >= enough:
                return best
    return best


def quotes_of(text: str | None) -> list[str]:
    """What a recorded call (``Tool {json}``) writes or replaces, of 40 letters or more, cut at 20,000."""
    try:
        todo = [(json.loads((text or "").split(" ", 1)[1]), 0)]
    except (ValueError, IndexError):
        return []
    out = []
    while todo:
        v, depth = todo.pop(0)
        if isinstance(v, dict):
            for k, x in v.items():
                if k in QUOTE_KEYS and isinstance(x, str):
                    out.append(x[:QUOTE_CAP])
                elif depth < 6:
                    todo.append((x, depth + 1))
        elif isinstance(v, list) and depth < 6:
            todo += [(x, depth + 1) for x in v]
    return [q for q in out if len(q) >= QUOTE_CHARS]


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        runs = []
        for call, text in zip(b.column("call_text").to_pylist(), b.column("text").to_pylist()):
            best = 0
            for q in quotes_of(call):
                best = max(best, shared_run(q, text or ""))
                if best >= 4 * QUOTE_CHARS:
                    break
            runs.append(best)
        cols = [b.column(c) for c in ("session_id", "src_id", "dst_id", "pos")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array(runs, pa.int32())], names=["session_id", "src_id", "dst_id", "pos", "run"])


def depends_quote(ev: DataFrame) -> DataFrame:
    """Editing call -> the two earlier results with the longest literal quote of what it writes, of 40 letters or more.

    Results within 120 places before the call are scanned newest first, up to 120,000 letters a call in all.
    """
    calls = ev.filter("kind = 'tool_call'").filter(T.regexp_any(F.col("text"), QUOTE_KEYS))
    near = calls.select("session_id", F.col("event_id").alias("src_id"), F.col("text").alias("call_text"), F.explode(F.sequence(F.greatest(F.col("pos") - LOOKBACK, F.lit(0)), F.col("pos") - 1)).alias("pos")).filter("pos >= 0")
    res = ev.filter("kind = 'tool_result' and text is not null").select("session_id", "pos", F.col("event_id").alias("dst_id"), F.substring("text", 1, SCAN_CHARS).alias("text"))
    pairs = near.join(res, ["session_id", "pos"])
    seen = F.coalesce(F.sum(F.length("text")).over(Window.partitionBy("session_id", "src_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("room", (SCAN_CHARS - seen).cast("int")).filter("room > 0").withColumn("text", F.substr("text", F.lit(1), F.col("room")))
    runs = pairs.select("session_id", "src_id", "dst_id", "pos", "call_text", "text").mapInArrow(_runs, "session_id string, src_id string, dst_id string, pos long, run int").filter(f"run >= {QUOTE_CHARS}")
    best = runs.withColumn("r", F.row_number().over(Window.partitionBy("session_id", "src_id").orderBy(F.desc("run"), F.desc("pos")))).filter(F.col("r") <= QUOTE_EDGES)
    bucket = F.when(F.col("run") >= 4 * QUOTE_CHARS, 4 * QUOTE_CHARS).when(F.col("run") >= 2 * QUOTE_CHARS, 2 * QUOTE_CHARS).otherwise(QUOTE_CHARS)
    return best.select("session_id", "src_id", "dst_id", F.lit("DEPENDS_ON").alias("edge_type"), F.concat(F.lit("literal_quote>="), bucket.cast("string")).alias("predicate")).select(*EDGE)


# --- kept file views --------------------------------------------------------------------------------------------------
KEEP_FILES, KEEP_VIEW_CHARS, KEEP_ALL_CHARS = 4, 16_000, 32_000


def kept_views(ev: DataFrame, forgotten: DataFrame, summaries: DataFrame) -> DataFrame:
    """(session_id, path, event_id, verdict, chars): the newest view of every file and whether it is put back after a compaction.

    ``ev``: session_id, event_id, pos, path, viewed, edited (booleans), command (of a shell call), shown (what the view showed).
    ``forgotten``: session_id, event_id; ``summaries``: session_id, summary. A view is turned away if it is still in context, the
    file was edited since (also by a shell command that writes and names it), nothing or a folder was shown, it is above
    16,000 letters, or the summary does not name the file. Of the others the newest are kept, up to four files and 32,000
    letters in all; one too long is passed over.
    """
    p = T.relative_path(F.col("path"))
    d = ev.withColumn("path", p)
    base = F.substring_index("path", "/", -1)
    last = d.filter("viewed").filter(F.contains(base, F.lit("."))).groupBy("session_id", "path").agg(F.max_by(F.struct("event_id", "shown", "pos"), "pos").alias("v")).select("session_id", "path", "v.*")
    edits = d.filter("edited").groupBy("session_id", "path").agg(F.max("pos").alias("edit_pos"))
    shell = d.filter(F.coalesce(T.writes_files(F.col("command")), F.lit(False))).select("session_id", F.col("pos").alias("shell_pos"), "command")
    touched = last.select("session_id", "path", "pos", base.alias("base")).join(shell, "session_id").filter((F.col("shell_pos") > F.col("pos")) & F.contains("command", F.col("base"))).select("session_id", "path").distinct().withColumn("touched", F.lit(True))
    d = last.join(edits, ["session_id", "path"], "left").join(touched, ["session_id", "path"], "left").join(forgotten.select("session_id", "event_id", F.lit(True).alias("gone")), ["session_id", "event_id"], "left").join(summaries.select("session_id", "summary"), "session_id", "left")
    n = F.length("shown")
    verdict = (
        F.when(F.col("gone").isNull(), "latest_in_context").when((F.col("edit_pos") > F.col("pos")) | F.col("touched").isNotNull(), "edited_since").when(F.col("shown").isNull(), "no_observation")
        .when(F.contains(F.substring("shown", 1, 400), F.lit(T.FOLDER_LISTING)), "dir_view").when(n > KEEP_VIEW_CHARS, "over_read_cap").when(~F.contains(F.coalesce("summary", F.lit("")), base), "not_in_summary").otherwise("candidate")
    )
    d = cut(d.select("session_id", "path", "event_id", "pos", n.alias("chars"), verdict.alias("verdict")))
    # four newest at most can be kept, but one too long lets the next one in, so the fold goes over all candidates in order
    c = d.filter("verdict = 'candidate'").groupBy("session_id").agg(F.sort_array(F.collect_list(F.struct("pos", "event_id", "chars")), asc=False).alias("x"))
    start = F.struct(F.lit(0).alias("n"), F.lit(0).alias("used"), F.array().cast("array<string>").alias("ids"))

    def step(s: Column, x: Column) -> Column:
        fits = (s["n"] < KEEP_FILES) & (s["used"] + x["chars"] <= KEEP_ALL_CHARS)
        return F.struct(F.when(fits, s["n"] + 1).otherwise(s["n"]).alias("n"), F.when(fits, s["used"] + x["chars"]).otherwise(s["used"]).alias("used"), F.when(fits, F.concat(s["ids"], F.array(x["event_id"]))).otherwise(s["ids"]).alias("ids"))

    kept = c.select("session_id", F.explode(F.aggregate("x", start, step)["ids"]).alias("event_id"), F.lit(True).alias("kept"))
    return d.join(kept, ["session_id", "event_id"], "left").select("session_id", "path", "event_id", F.when(F.col("kept"), "kept").when(F.col("verdict") == "candidate", "over_cap").otherwise(F.col("verdict")).alias("verdict"), "chars")


# --- samples and grids ------------------------------------------------------------------------------------------------


def round_robin(items: DataFrame, targets: dict[str, int], share: float = 0.4, salt: str = "sample") -> DataFrame:
    """Items (slice, session_id, item_id) for each slice: one a session in turn until the slice's target, then the largest
    session cut down to ``share`` of the slice (slices of more than two). The order within a session is that of a hash."""
    goal = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for kv in targets.items() for x in kv]), F.col("slice")), F.lit(0))
    h = F.md5(F.concat_ws("|", F.lit(salt), "item_id"))
    turn = F.row_number().over(Window.partitionBy("slice", "session_id").orderBy(h, "item_id"))
    d = items.withColumn("turn", turn).withColumn("goal", goal).filter(F.col("turn") <= F.col("goal"))
    d = d.withColumn("place", F.row_number().over(Window.partitionBy("slice").orderBy("turn", "session_id"))).filter(F.col("place") <= F.col("goal"))
    n = d.groupBy("slice", "session_id").agg(F.count("*").alias("own"))
    all_ = n.groupBy("slice").agg(F.sum("own").alias("total"))
    n = n.join(all_, "slice").withColumn("most", F.when(F.col("total") > 2, F.greatest(F.lit(1), F.floor((F.col("total") - F.col("own")) * share / (1 - share) + 1e-9))).otherwise(F.col("own")))
    return d.join(n, ["slice", "session_id"]).filter(F.col("turn") <= F.col("most")).select("slice", "session_id", "item_id")


def dependency_slices(values: DataFrame) -> DataFrame:
    """(slice, session_id, value) of values that one result of a session alone shows: ``direct_fact`` if nothing repeats it,
    ``tool_chain`` if a later call does, ``decision_source`` if a later message or decision does.

    ``values``: session_id, event_id, pos, kind, value.
    """
    is_result, later = F.col("kind") == "tool_result", lambda *k: F.max(F.when(F.col("kind").isin(*k), F.col("pos")))
    v = values.groupBy("session_id", "value").agg(F.count_if(is_result).alias("n_res"), F.count("*").alias("n"), F.min(F.when(is_result, F.col("pos"))).alias("at"), later("tool_call").alias("call"), later("assistant", "decision").alias("said")).filter("n_res = 1")
    kinds = F.array_compact(F.array(F.when(F.col("n") == 1, "direct_fact"), F.when(F.col("call") > F.col("at"), "tool_chain"), F.when(F.col("said") > F.col("at"), "decision_source")))
    return v.select(F.explode(kinds).alias("slice"), "session_id", "value")


def generic_values(values: DataFrame, sessions: int = 3) -> DataFrame:
    """Values that stand in ``sessions`` or more sessions and so prove nothing: (value, n)."""
    return values.select("session_id", "value").distinct().groupBy("value").agg(F.count("*").alias("n")).filter(F.col("n") >= sessions)


ROUTERS = ("last_n", "lexical", "dense", "hybrid", "hybrid_pin", "oracle")
CLOSURES = ("off", "native", "full_ancestor", "oracle")
WITNESSES = ("source_only", "carrier_only", "source_plus_carrier")
BUDGETS = (1_024, 2_048, 4_096)
SELECTIONS = ("bm25", "bm25pair", "bm25_nb1", "bm25id1", "bm25id2", "bm25id4", "closure", "closure_h")


def grid(spark: SparkSession) -> DataFrame:
    """All combinations of routers, closures, witnesses and budgets: (arm, router, closure, witness, budget)."""
    rows = [(f"{r}/{c}/{w}/{b}", r, c, w, b) for r in ROUTERS for c in CLOSURES for w in WITNESSES for b in BUDGETS]
    return spark.createDataFrame(rows, "arm string, router string, closure string, witness string, budget int")


def frozen(texts: DataFrame, key: str, text: str = "text") -> DataFrame:
    """(key, sha1) of a corpus, by which a later run can tell that it is the same."""
    return texts.select(key, F.sha1(F.coalesce(F.col(text), F.lit(""))).alias("sha1"))


# fixed values: the frame of a prompt with two options
PROMPT_HEAD, PROMPT_NONE, PROMPT_A, PROMPT_B, PROMPT_END = "Session evidence:\n", "(no evidence provided)", "\nOption A: ", "\nOption B: ", "\nAnswer with the letter only."


def tool_choice_prompt(context: Column, question: Column, right: Column, wrong: Column, item: Column) -> Column:
    """A question with two options, the right one on the side that the item's hash says."""
    first = T.side(item)
    a, b = F.when(first, right).otherwise(wrong), F.when(first, wrong).otherwise(right)
    head = F.concat(F.lit(PROMPT_HEAD), F.when(context != "", context).otherwise(PROMPT_NONE))
    return F.concat(head, F.lit("\n\n"), question, F.lit(PROMPT_A), a, F.lit(PROMPT_B), b, F.lit(PROMPT_END))
