"""Deeply nested records to related flat tables: one depth-first pass emits tagged rows.

The visitor walks ``content``, ``compactMetadata`` and ``toolUseResult`` of a native row once and emits
(rel, item_no, sub_no, key, parent key, payload). The tagged rows are written partitioned by ``rel`` and read
back with the schema of the table, so no source row is visited twice. A payload holds the columns of its table and,
under ``rest``, JSON of all fields that neither have a column nor stand in a child row.
"""

from __future__ import annotations

import json
import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from packetloom.runtime import checkpoint_dir, first_rows

#: tag: (parent tag, schema of the payload)
RELATIONS = {
    "row": ("", "type string, subtype string, uuid string, parentUuid string, ts string, isSidechain boolean, isMeta boolean, isCompactSummary boolean, role string, content string, trigger string, preTokens bigint, stdout string, stderr string, interrupted boolean, userModified boolean, filePath string, mode string, numFiles bigint, file string, toolUseResult string, rest string"),
    "block": ("row", "type string, text string, thinking string, signature string, id string, name string, input string, tool_use_id string, is_error boolean, content string, source string, rest string"),
    "part": ("block", "type string, text string, source string, rest string"),
    "hunk": ("row", "oldStart bigint, oldLines bigint, newStart bigint, newLines bigint, rest string"),
    "patch_line": ("hunk", "line string"),
    "result": ("row", "path string, rest string"),
    "match": ("result", "line bigint, text string, rest string"),
    "preserved": ("row", "uuid string"),
}

#: columns of the table ``row`` that are columns of the source, and those that are fields of toolUseResult
ROW_COLUMNS = ("type", "subtype", "uuid", "parentUuid", "ts", "isSidechain", "isMeta", "isCompactSummary", "role")
RESULT_FIELDS = ("stdout", "stderr", "interrupted", "userModified", "filePath", "mode", "numFiles", "file")

COLUMNS = {rel: dict(c.split() for c in schema.split(", ")) for rel, (_, schema) in RELATIONS.items()}

#: tag, tag of its children, and the fields of toolUseResult that hold them
NESTED = (("hunk", "patch_line", "structuredPatch", "lines"), ("result", "match", "results", "matches"))

TAGGED = "session_id string, line_no long, rel string, item_no long, sub_no long, row_key string, parent_key string, payload string"


def as_value(x):
    """JSON text inside a string counts as its value, at any depth; other text as None."""
    while isinstance(x, str):
        t = x.strip()
        if t[:1] not in ("{", "[", '"'):
            return None
        try:
            x = json.loads(t)
        except ValueError:
            return None
    return x


def as_list(x) -> list:
    """Elements of an array; an object stands for an array of one; anything else has none."""
    x = as_value(x)
    return x if isinstance(x, list) else [x] if isinstance(x, dict) else []


def camel(name: str) -> str:
    head, *rest = name.split("_")
    return head + "".join(w[:1].upper() + w[1:] for w in rest)


def key_of(obj: dict, name: str) -> str | None:
    """The key of a field under its name or its snake-case spelling; a present value wins over a null."""
    if obj.get(name) is not None:
        return name
    for k, v in obj.items():
        if v is not None and camel(k) == camel(name):
            return k
    return name if name in obj else None


def field(obj: dict, name: str):
    """A field's value by ``key_of``."""
    return obj.get(key_of(obj, name))


def _typed(v, kind: str):
    """A value as its column holds it; None where it does not fit."""
    if kind == "string":
        return v if isinstance(v, (str, bool, int, float)) else json.dumps(v, ensure_ascii=False)
    t = v.strip() if isinstance(v, str) else None
    if kind == "boolean":
        return v if isinstance(v, bool) else {"true": True, "false": False}.get(t)
    n = int(t) if t is not None and re.fullmatch(r"-?[0-9]{1,19}", t) else v
    return n if isinstance(n, int) and not isinstance(n, bool) and -(2**63) <= n < 2**63 else None


def _rest(left: dict) -> dict:
    return {"rest": json.dumps(left, ensure_ascii=False)} if left else {}


def _flat(obj, tag: str, children: tuple[str, ...] = ()) -> dict:
    """The columns of a table from an object; what has no column, or does not fit it, goes into ``rest``.

    ``children`` are fields whose whole value stands in child rows.
    """
    if not isinstance(obj, dict):
        return _rest({} if obj is None else {"value": obj})
    out, used = {}, {key_of(obj, n) for n in children}
    for n, kind in COLUMNS[tag].items():
        k = key_of(obj, n)
        if n == "rest" or k is None or k in used or obj[k] is None:
            continue
        v = _typed(obj[k], kind)
        if v is not None:
            out[n] = v
            used.add(k)
    return out | _rest({k: v for k, v in obj.items() if k not in used and v is not None})


def _opened(x):
    """An array's element; JSON text counts as its value."""
    v = as_value(x) if isinstance(x, str) else None
    return x if v is None else v


def _others(items: list) -> dict:
    """Elements that make no child row, by their places."""
    return {str(i): x for i, x in enumerate(items) if x is not None and not isinstance(_opened(x), dict)}


def visit(content, result, uuids, head: dict | None = None) -> Iterator[tuple[str, int, int, dict]]:
    """Depth-first over one row: (tag, item, sub, payload); with ``head``, the scalars of the row, also the row itself."""
    if head is not None:
        yield "row", -1, -1, _row(content, result, head)
    for i, block in enumerate(as_list(content)):
        block = _opened(block)
        if not isinstance(block, dict):
            continue
        parts = as_list(field(block, "content")) if block.get("type") == "tool_result" else []
        yield "block", i, -1, _flat(block, "block", ("content",) if parts else ())
        for j, part in enumerate(parts):
            part = _opened(part)
            if part is not None:
                yield "part", i, j, _flat(part, "part") if isinstance(part, dict) else {"text": part if isinstance(part, str) else json.dumps(part, ensure_ascii=False)}
    outer = as_value(result)
    if isinstance(outer, dict):
        for tag, sub_tag, name, sub_name in NESTED:
            for i, item in enumerate(as_list(field(outer, name))):
                item = _opened(item)
                if not isinstance(item, dict):
                    continue
                subs = as_list(field(item, sub_name))
                yield tag, i, -1, _flat(item, tag, (sub_name,) if subs else ())
                for j, sub in enumerate(subs):
                    if sub is None:
                        continue
                    if tag == "hunk":
                        yield sub_tag, i, j, {"line": sub if isinstance(sub, str) else json.dumps(sub, ensure_ascii=False)}
                    else:
                        yield sub_tag, i, j, _flat(_opened(sub), sub_tag)
    if uuids is not None:
        for i, u in enumerate(uuids):
            if u is not None:
                yield "preserved", i, -1, {"uuid": u}


def _row(content, result, head: dict) -> dict:
    """The row's own table: its scalars, texts that are not JSON, and what makes no child row."""
    out, left = dict(head), {}
    items = as_list(content)
    if content is not None and not items:
        out["content"] = content
    if lost := _others(items):
        left["content"] = lost
    outer = as_value(result)
    if not isinstance(outer, dict):
        return out | ({} if result is None else {"toolUseResult": result}) | _rest(left)
    whole, own = [], {}
    for _, _, name, _ in NESTED:
        items = as_list(field(outer, name))
        if items:
            whole.append(name)
            if lost := _others(items):
                own[name] = lost
    used = {key_of(outer, n) for n in whole}
    for n in RESULT_FIELDS:
        k = key_of(outer, n)
        v = None if k is None or outer[k] is None else _typed(outer[k], COLUMNS["row"][n])
        if v is not None:
            out[n] = v
            used.add(k)
    own |= {k: v for k, v in outer.items() if k not in used and v is not None and v != []}
    return out | _rest(left | ({"toolUseResult": own} if own else {}))


def _emit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for sid, no, content, result, uuids, head in zip(b["session_id"], b["line_no"], b["content"], b["toolUseResult"], b["uuids"], b["head"]):
            base = f"{sid}:{no}"
            for tag, i, j, payload in visit(content, result, uuids, None if head is None else json.loads(head)):
                up = RELATIONS[tag][0]
                key = base if tag == "row" else f"{base}:{tag}:{i}" + (f":{j}" if j >= 0 else "")
                parent = None if tag == "row" else base if up == "row" else f"{base}:{up}:{i}"
                rows.append((sid, no, tag, i, j, key, parent, json.dumps(payload, ensure_ascii=False)))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in TAGGED.split(", ")])


def flatten_records(rows: DataFrame, parents: bool = False) -> DataFrame:
    """All child rows of native rows as tagged rows (see ``TAGGED``), with ``parents`` also the rows themselves.

    Rows are merged by (session_id, line_no). Null, empty or damaged fields have no children; null array elements
    keep their place but give no row.
    """
    head = F.lit(None).cast("string")
    if parents:
        head = F.to_json(F.struct(*[F.col(c).cast("string") if c == "ts" else F.col(c) for c in ROW_COLUMNS], "compactMetadata.trigger", "compactMetadata.preTokens"))
    src = first_rows(rows, ["session_id", "line_no"]).select("session_id", "line_no", "content", "toolUseResult", F.col("compactMetadata.preservedMessages.uuids").alias("uuids"), head.alias("head"))
    return src.filter("content is not null or toolUseResult is not null or uuids is not null or head is not null").mapInPandas(_emit, TAGGED)


def relation(tagged: DataFrame, rel: str) -> DataFrame:
    """One flat table of the tagged rows with its own columns."""
    schema = RELATIONS[rel][1]
    return tagged.filter(F.col("rel") == rel).select("session_id", "line_no", "item_no", "sub_no", "row_key", "parent_key", F.from_json("payload", schema).alias("p")).select("session_id", "line_no", "item_no", "sub_no", "row_key", "parent_key", "p.*")


def write_relations(tagged: DataFrame, path: str) -> None:
    """One pass over the source: the tagged rows, partitioned by tag."""
    tagged.write.mode("overwrite").partitionBy("rel").parquet(path)


def tables(rows: DataFrame) -> DataFrame:
    """All tables, written by tag and read back with their schemas; ``payload`` is JSON of a table's own columns."""
    spark = rows.sparkSession
    path = f"{checkpoint_dir(spark)}/relations-{uuid.uuid4().hex}"
    write_relations(flatten_records(rows, parents=True), path)
    names = [c.split()[0] for c in TAGGED.split(", ")]
    back = spark.read.schema(TAGGED).parquet(path)
    out = None
    for rel, columns in COLUMNS.items():
        one = relation(back, rel).withColumn("rel", F.lit(rel)).withColumn("payload", F.to_json(F.struct(*columns))).select(*names)
        out = one if out is None else out.unionByName(one)
    return out
