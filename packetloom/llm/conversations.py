"""Rebuilding conversations from message rows.

Message rows of two recorders are brought to one spelling of roles, calls and results. The reply graph (a row to the
row that it answers) is sorted topologically with Kahn's algorithm, ties by time, then place. In a forest the heap's
order has a closed form: a row is known by the ranks on its way from the root that exceed all ranks below them, and the
order compares these lists. They are folded along reply chains by ``contraction.solve``, which peels blocks of rows as
Kahn's algorithm does, stitches blocks over their exits, and leaves over what lies on or below loops; so a conversation
may hold most of the rows, and block borders change nothing. Completeness and the order of roles are then checked
over the sorted rows with aggregates that combine on the map side. Texts are not carried along: they are joined to
the turns of whole conversations at the end.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.contraction import BELOW, CYCLE, Fold, solve
from packetloom.runtime import cut, ranked

BLOCK = 4096  #: rows of a conversation sorted in one piece; it changes no result

#: one spelling for each role (fixed)
ROLES = {
    "user": "user", "human": "user", "assistant": "assistant", "ai": "assistant", "model": "assistant",
    "tool": "tool", "function": "tool", "toolresult": "tool", "system": "system", "developer": "system", "bashexecution": "command",
}

BLOCK_TYPES = {"text", "thinking", "toolCall", "tool_use", "tool_result", "image", "image_url", "input_text", "output_text", "redacted_thinking"}

#: reasons to drop a conversation; the others are reported with it
INCOMPLETE = ("gap", "no user content", "no closing answer", "stray result", "unanswered call")
IRREGULAR = ("loop", "role order")

def content_parts(content) -> tuple[str | None, list[str | None]]:
    """(visible text, ids of calls) of plain text or of JSON text of blocks; thinking and calls are not text."""
    if content is None:
        return None, []
    t = content.strip()
    blocks = None
    if t[:1] in ("[", "{"):
        try:
            v = json.loads(t)
        except (ValueError, RecursionError):
            v = None
        v = [v] if isinstance(v, dict) else v
        if isinstance(v, list) and all(isinstance(b, dict) and b.get("type") in BLOCK_TYPES for b in v):
            blocks = v
    if blocks is None:
        return content, []
    text = [b["text"] for b in blocks if b.get("type") in ("text", "input_text", "output_text") and isinstance(b.get("text"), str)]
    calls = [b.get("id") if isinstance(b.get("id"), str) else None for b in blocks if b.get("type") in ("toolCall", "tool_use")]
    return "\n".join(text), calls


def kahn(parents: list[int], rank: list) -> tuple[list[int], set[int]]:
    """Topological order of a graph with one parent index each (-1 for none), least rank first; leftover nodes."""
    n = len(parents)
    children: list[list[int]] = [[] for _ in range(n)]
    waiting = [0] * n
    for i, p in enumerate(parents):
        if p >= 0:
            children[p].append(i)
            waiting[i] = 1
    heap = [(rank[i], i) for i in range(n) if not waiting[i]]
    heapq.heapify(heap)
    order = []
    while heap:
        _, i = heapq.heappop(heap)
        order.append(i)
        for c in children[i]:
            waiting[c] = 0
            heapq.heappush(heap, (rank[c], c))
    return order, {i for i in range(n) if waiting[i]}


def one_role(role) -> str | None:
    """The common spelling of a role; ``other`` for unknown ones."""
    return ROLES.get("".join(role.split()).lower().replace("_", ""), "other") if isinstance(role, str) else None


_ROW = pa.schema([
    ("tbl", pa.string()), ("conv_id", pa.string()), ("row_no", pa.int64()), ("rec_id", pa.string()), ("parent", pa.string()), ("ts", pa.int64()), ("is_message", pa.bool_()),
    ("role", pa.string()), ("has_content", pa.bool_()), ("call_ids", pa.list_(pa.string())), ("result_id", pa.string()),
])
_ROW_SQL = "tbl string, conv_id string, row_no long, rec_id string, parent string, ts long, is_message boolean, role string, has_content boolean, call_ids array<string>, result_id string"


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What the graph and the checks need of a row; its content goes no further."""
    for b in batches:
        roles = [one_role(r) for r in b.column("role").to_pylist()]
        has, calls = [], []
        for role, content, listed in zip(roles, b.column("content").to_pylist(), b.column("call_ids").to_pylist()):
            text, own = content_parts(content)
            has.append(bool(text and text.strip()))
            calls.append([] if role != "assistant" else listed if listed else own)
        results = [r if role == "tool" else None for role, r in zip(roles, b.column("result_id").to_pylist())]
        new = {"role": roles, "has_content": has, "call_ids": calls, "result_id": results}
        yield pa.RecordBatch.from_arrays([pa.array(new[f.name], type=f.type) if f.name in new else b.column(f.name).cast(f.type) for f in _ROW], schema=_ROW)


def _recorded(oh: DataFrame, pi: DataFrame) -> DataFrame:
    """Both recorders' rows in one shape, repeats not yet merged."""
    o = oh.select(
        F.lit("oh_rows").alias("tbl"), F.col("trajectory_id").alias("conv_id"), "row_no", F.col("id").alias("rec_id"), F.lit(None).cast("string").alias("parent"), "role", "content",
        F.transform("tool_calls", lambda c: c["id"]).alias("call_ids"), F.col("tool_call_id").alias("result_id"), F.lit(None).cast("long").alias("ts"), F.lit(True).alias("is_message"),
    )
    p = pi.select(
        F.lit("pi_rows").alias("tbl"), F.col("session_id").alias("conv_id"), "row_no", F.col("id").alias("rec_id"), F.col("parentId").alias("parent"), "role", "content",
        F.lit(None).cast("array<string>").alias("call_ids"), F.col("toolCallId").alias("result_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("ts"), F.coalesce(F.col("type") == "message", F.lit(False)).alias("is_message"),
    )
    return o.unionByName(p).filter("conv_id is not null and row_no is not null")


CONV = ["tbl", "conv_id"]


def message_rows(oh: DataFrame, pi: DataFrame) -> DataFrame:
    """Narrow rows of both recorders, repeats merged by (conversation, row_no), with ``block``."""
    rows = _recorded(oh, pi).mapInArrow(_parse, _ROW_SQL).withColumn("block", F.floor((F.col("row_no") - 1) / BLOCK).cast("long"))
    last = F.lag("row_no").over(Window.partitionBy(*CONV, "block").orderBy("row_no"))  # one sort of blocks, where an aggregate takes two
    return rows.withColumn("last", last).filter("last is null or last <> row_no").drop("last")


def _above(own: list, above: list) -> list:
    top = own[0]["t"], own[0]["r"]
    return [x for x in above if (x["t"], x["r"]) > top] + own


def _above_columns(above: Column, own: Column) -> Column:
    return F.concat(F.filter(above, lambda x: x > F.get(own, F.lit(0))), own)


#: ranks (time, row) on the way from the root that exceed all below them; a row's own rank is the last
PLACE = Fold("array<struct<t:bigint,r:bigint>>", pa.list_(pa.struct([("t", pa.int64()), ("r", pa.int64())])), lambda above, own: _above(own, above), _above_columns)


def reply_graph(rows: DataFrame) -> DataFrame:
    """Nodes for ``solve``: a row answers the row of its parent id, or, where it names none, the row before it.

    A parent that is not in the conversation makes the row a root. The time of a row without one is that of the last
    row before it that has one.
    """
    plain = rows.filter("tbl = 'oh_rows'")  # a recorder without times and parent ids: every row answers the one before
    plain = _nodes(plain, F.lit(0), F.when(F.col("row_no") > 1, F.col("row_no") - 1))
    rows = rows.filter("tbl <> 'oh_rows'")
    inside = Window.partitionBy(*CONV, "block").orderBy("row_no").rowsBetween(Window.unboundedPreceding, 0)
    before = Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = rows.groupBy(*CONV, "block").agg(F.max_by("ts", F.when(F.col("ts").isNotNull(), F.col("row_no"))).alias("c")).select(*CONV, "block", F.last("c", ignorenulls=True).over(before).alias("carried"))
    timed = rows.withColumn("t", F.last("ts", ignorenulls=True).over(inside)).join(carried, [*CONV, "block"])
    named = rows.filter("rec_id is not null").groupBy(*CONV, F.col("rec_id").alias("parent")).agg(F.min("row_no").alias("up"))
    linked = timed.join(named, [*CONV, "parent"], "left")
    parent = F.when(F.col("parent").isNull(), F.when(F.col("row_no") > 1, F.col("row_no") - 1)).otherwise(F.coalesce("up", F.lit(-1)))
    return plain.unionByName(_nodes(linked, F.coalesce("t", "carried", F.lit(0)), parent))


def _nodes(rows: DataFrame, time: Column, parent: Column) -> DataFrame:
    rank = F.struct(time.cast("long").alias("t"), F.col("row_no").alias("r"))
    return rows.select(
        F.concat_ws("\t", *CONV).alias("scope"), F.col("row_no").cast("string").alias("id"), parent.cast("string").alias("parent"), F.col("row_no").alias("pos"),
        F.lit(1).cast("long").alias("weight"), F.lit(1).cast("long").alias("own"), F.array(rank).alias("seg"),
    )


def ordered_messages(rows: DataFrame) -> DataFrame:
    """Messages with their place ``ord`` in the topological order of their conversation; ``on_loop`` marks rows that
    are never free (on or below a loop), which stand last, by time and place."""
    placed = solve(reply_graph(rows), PLACE, block=BLOCK).select("scope", F.col("pos").alias("row_no"), "state", F.col("seg").alias("key"))
    split = F.split("scope", "\t", 2)
    placed = placed.select(split[0].alias("tbl"), split[1].alias("conv_id"), "row_no", F.col("state").isin(CYCLE, BELOW).alias("on_loop"), "key")
    kept = rows.filter("is_message").drop("is_message", "parent").join(placed, [*CONV, "row_no"])
    late = F.array(F.struct(F.coalesce("ts", F.lit(0)).alias("t"), F.col("row_no").alias("r")))
    return ranked(kept.withColumn("key", F.coalesce("key", late)), CONV, ["on_loop", "key", "row_no"], "ord").drop("key")


def conversation_reasons(rows: DataFrame, messages: DataFrame) -> DataFrame:
    """(tbl, conv_id, reasons) of conversations with any: ``gap`` in the row numbers, ``no user content``, ``no closing
    answer``, ``stray result`` (it answers no earlier call), ``unanswered call``; ``loop`` in the reply graph, and
    ``role order``: in topological order a user's turn follows a user's or a tool's, an assistant's an assistant's, or a
    tool's a user's."""
    turn = F.col("role").isin("user", "assistant", "tool")
    last = F.max(F.when(turn, F.struct("row_no", (F.col("role") == "assistant").alias("a"), "has_content")))
    places = rows.groupBy(*CONV).agg(F.max("row_no").alias("top"), F.min("row_no").alias("low"), F.count("*").alias("n"))
    part = F.floor(F.col("ord") / BLOCK).cast("long")
    edge = messages.filter((F.col("ord") + 1) % BLOCK == 0).select(*CONV, (part + 1).alias("part"), F.col("role").alias("edge"))
    inside = F.lag("role").over(Window.partitionBy(*CONV, "part").orderBy("ord"))
    follow = messages.withColumn("part", part).withColumn("inside", inside).join(edge, [*CONV, "part"], "left")
    pair = F.concat_ws(">", F.coalesce("inside", F.when(F.col("ord") % BLOCK == 0, F.col("edge"))), "role")
    ends = follow.groupBy(*CONV).agg(
        F.max((F.col("role") == "user") & F.col("has_content")).alias("asked"), last.alias("last"), F.max("on_loop").alias("loop"),
        F.max(pair.isin("user>user", "tool>user", "assistant>assistant", "user>tool")).alias("disorder"),
    )
    calls = messages.select(*CONV, "block", "row_no", F.explode("call_ids").alias("call_id"), F.lit(1).alias("step"))
    results = messages.filter("role = 'tool'").select(*CONV, "block", "row_no", F.col("result_id").alias("call_id"), F.lit(-1).alias("step"))
    moves = calls.unionByName(results)
    # calls and results by id: the first call before the first result, the last result after the last call
    is_call, is_result = F.col("step") == 1, F.col("step") == -1
    by_id = moves.groupBy(*CONV, "call_id").agg(
        F.min(F.when(is_call, F.col("row_no"))).alias("c0"), F.max(F.when(is_call, F.col("row_no"))).alias("c1"),
        F.min(F.when(is_result, F.col("row_no"))).alias("r0"), F.max(F.when(is_result, F.col("row_no"))).alias("r1"),
    )
    stray = F.col("r0").isNotNull() & (F.col("c0").isNull() | (F.col("r0") <= F.col("c0")) | F.col("call_id").isNull())
    unanswered = F.col("c1").isNotNull() & (F.col("r1").isNull() | (F.col("r1") <= F.col("c1")) | F.col("call_id").isNull())
    with_ids = by_id.groupBy(*CONV).agg((F.count("call_id") > 0).alias("with_ids"), F.max(stray).alias("stray"), F.max(unanswered).alias("unanswered"))
    # no ids at all: a result takes the oldest open call; running sums per block, stitched over blocks
    nameless = moves.filter("call_id is null")
    run = F.sum("step").over(Window.partitionBy(*CONV, "block").orderBy("row_no", "step").rowsBetween(Window.unboundedPreceding, 0))
    blocks = nameless.withColumn("run", run).groupBy(*CONV, "block").agg(F.min("run").alias("low"), F.sum("step").alias("net"))
    base = F.coalesce(F.sum("net").over(Window.partitionBy(*CONV).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    queue = blocks.withColumn("low", F.col("low") + base).groupBy(*CONV).agg(F.min("low").alias("q_low"), F.sum("net").alias("q_net"))
    d = places.join(ends, CONV, "left").join(with_ids, CONV, "left").join(queue, CONV, "left")
    no = lambda c: ~F.coalesce(c, F.lit(False))
    named = F.coalesce("with_ids", F.lit(False))
    found = {
        "gap": (F.col("low") != 1) | (F.col("n") < F.col("top")), "loop": F.col("loop"), "no closing answer": no(F.col("last.a") & F.col("last.has_content")), "no user content": no(F.col("asked")), "role order": F.col("disorder"),
        "stray result": F.when(named, F.col("stray")).otherwise(F.col("q_low") < 0), "unanswered call": F.when(named, F.col("unanswered")).otherwise((F.col("q_low") >= 0) & (F.col("q_net") > 0)),
    }
    reasons = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in found.items()]), lambda x: x.isNotNull())
    return d.select(*CONV, reasons.alias("reasons")).filter(F.size("reasons") > 0)


def reasons_of(oh: DataFrame, pi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(sorted messages of all conversations, conversations with reasons)."""
    rows = cut(message_rows(oh, pi))
    messages = cut(ordered_messages(rows))
    return messages, cut(conversation_reasons(rows, messages))


def rebuild(oh: DataFrame, pi: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(messages of whole conversations in order with the ``flags`` of theirs, broken conversations with reasons).

    A conversation is broken by a reason of ``INCOMPLETE``; one of ``IRREGULAR`` alone is a flag. Rows with a null
    conversation or row number are left out; null roles and contents make a message without role or content. Empty
    tables give empty results.
    """
    messages, reasons = reasons_of(oh, pi)
    fatal = F.arrays_overlap("reasons", F.array(*map(F.lit, INCOMPLETE)))
    broken = reasons.filter(fatal)
    flags = reasons.filter(~fatal).select(*CONV, F.col("reasons").alias("flags"))
    whole = messages.join(broken, CONV, "left_anti").join(flags, CONV, "left")
    return whole.withColumn("flags", F.coalesce("flags", F.array().cast("array<string>"))), broken


def answered_calls(messages: DataFrame) -> DataFrame:
    """(tbl, conv_id, row_no, at, call_id, result_row, further_rows) of every call.

    A result answers the oldest open call of its id (of the conversation, where no call or result has an id), else
    the last call before it; a call that is left takes the next result of its id. Calls and results are numbered by
    running counts per block, stitched over blocks, so that one id or one conversation may hold most of the rows.
    """
    conv, key = ["tbl", "conv_id"], ["tbl", "conv_id", "call_id"]
    messages = cut(messages.filter("role = 'tool' or size(call_ids) > 0").select(*conv, "block", "row_no", "role", "call_ids", "result_id"))
    calls = messages.select(*conv, "block", "row_no", F.posexplode("call_ids").alias("at", "call_id"), F.lit(1).alias("step"))
    results = messages.filter("role = 'tool'").select(*conv, "block", "row_no", F.lit(-1).alias("at"), F.col("result_id").alias("call_id"), F.lit(-1).alias("step"))
    moves = calls.unionByName(results)
    with_ids = moves.groupBy(*conv).agg((F.count("call_id") > 0).alias("with_ids"))
    # an id may be null only where all are: conversations with some are broken
    moves = moves.join(with_ids, conv).filter("call_id is not null or not with_ids").drop("with_ids").withColumn("call_id", F.coalesce("call_id", F.lit("")))
    run = Window.partitionBy(*key, "block").orderBy("row_no", "step", "at").rowsBetween(Window.unboundedPreceding, 0)
    moves = moves.withColumn("run", F.sum("step").over(run)).withColumn("n_calls", F.sum(F.when(F.col("step") == 1, 1).otherwise(0)).over(run)).withColumn("n_results", F.col("n_calls") - F.col("run"))
    moves = cut(moves.withColumn("low", F.min("run").over(run)))
    sums = moves.groupBy(*key, "block").agg(F.sum("step").alias("net"), F.min("run").alias("least"), F.max("n_calls").alias("c"), F.max("n_results").alias("r"))
    before = Window.partitionBy(*key).orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("base", F.coalesce(F.sum("net").over(before), F.lit(0))).withColumn("c0", F.coalesce(F.sum("c").over(before), F.lit(0))).withColumn("r0", F.coalesce(F.sum("r").over(before), F.lit(0)))
    sums = sums.withColumn("low0", F.least(F.lit(0), F.coalesce(F.min(F.col("base") + F.col("least")).over(before), F.lit(0)))).select(*key, "block", "base", "c0", "r0", "low0")
    low = F.least("low0", F.col("base") + F.col("low"))
    seen = cut(moves.join(sums, [*key, "block"]).select(*key, "row_no", "at", "step", (F.col("base") + F.col("run")).alias("run"), (F.col("c0") + F.col("n_calls")).alias("calls"), (F.col("r0") + F.col("n_results")).alias("results"), low.alias("low")))
    # a result that finds no open call lowers the least sum by one and gets the number of the last call before it
    taken = seen.filter("step = -1").select(*key, "results", "row_no", (F.col("results") + F.col("low")).alias("k"))
    own = taken.groupBy(*key, "k").agg(F.array_sort(F.collect_list("row_no")).alias("rows"))
    later = taken.select(*key, F.col("results").alias("next"), F.col("row_no").alias("next_row"))
    asked = seen.filter("step = 1").select(*key, "row_no", "at", F.col("calls").alias("k"), (F.col("results") + 1).alias("next"))
    pairs = asked.join(own, [*key, "k"], "left").join(later, [*key, "next"], "left")
    return pairs.select(*conv, "row_no", "at", F.nullif("call_id", F.lit("")).alias("call_id"), F.coalesce(F.get("rows", F.lit(0)), "next_row").alias("result_row"), F.expr("slice(rows, 2, greatest(size(rows) - 1, 0))").alias("further_rows"))


def _visible(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        cols = [b.column(c) for c in (*CONV, "row_no")]
        yield pa.RecordBatch.from_arrays([*cols, pa.array([content_parts(c)[0] for c in b.column("content").to_pylist()], pa.string())], names=[*CONV, "row_no", "text"])


def with_results(messages: DataFrame, oh: DataFrame, pi: DataFrame) -> DataFrame:
    """Ordered turns; every call carries its result: (tbl, conv_id, ord, row_no, rec_id, role, text, on_loop, flags, calls).

    ``further`` of a call holds the results that its id got besides the first. Visible text only: thinking and calls
    are no text.
    """
    contents = _recorded(oh, pi).filter("is_message and content is not null").select(*CONV, "row_no", "content").dropDuplicates([*CONV, "row_no"])
    texts = contents.mapInArrow(_visible, "tbl string, conv_id string, row_no long, text string")
    pairs = answered_calls(messages).select(*CONV, "row_no", "at", "call_id", F.posexplode_outer(F.concat(F.array("result_row"), F.coalesce("further_rows", F.array().cast("array<bigint>")))).alias("nth", "result_row"))
    results = messages.filter("role = 'tool'").select(*CONV, "row_no").join(texts, [*CONV, "row_no"]).select(*CONV, F.col("row_no").alias("result_row"), F.col("text").alias("result"))
    pairs = pairs.join(results, [*CONV, "result_row"], "left")
    first = F.col("nth") == 0
    calls = pairs.groupBy(*CONV, "row_no", "at").agg(
        F.max("call_id").alias("call_id"), F.max(F.when(first, F.col("result_row"))).alias("result_row"), F.max(F.when(first, F.col("result"))).alias("result"),
        F.array_sort(F.collect_list(F.when(~first, F.struct("result_row", "result")))).alias("further"),
    )
    calls = calls.groupBy(*CONV, "row_no").agg(F.sort_array(F.collect_list(F.struct("at", "call_id", "result_row", "result", "further"))).alias("calls"))
    turns = messages.select(*CONV, "ord", "row_no", "rec_id", "role", "on_loop", "flags").join(texts, [*CONV, "row_no"], "left")
    return turns.join(calls, [*CONV, "row_no"], "left").select(*CONV, "ord", "row_no", "rec_id", "role", "text", "on_loop", "flags", "calls")
