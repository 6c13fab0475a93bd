"""Schemas that drift between files: nested schema trees, minimum-cost edit scripts, compiled projections.

Each file's lines are folded to a schema tree (path, types, hashes of values). For neighbouring files of a
project an edit script of least cost is found by constrained unordered tree edit distance: a field that both files
have under a parent is continued, the other children of two nodes are matched by minimum-cost assignment, where a rename
needs equal types and a shared value; what is left at different places of the trees is matched the same way into moves.
Schemas cover every level and the elements of arrays. They are found first; values are compared only for fields that
come or go. Scripts are chained into maps of paths, which become one projection applied to every line.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from difflib import SequenceMatcher
from hashlib import blake2b

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from packetloom.operators.flatten import camel
from packetloom.runtime import cut

SEP = "\x1f"
ELEMENT = "[]"  #: the step from an array to its elements

RENAME_COST, MOVE_COST, RETYPE_COST, DROP_COST = 0.5, 0.9, 0.4, 1.0


def json_type(v) -> str:
    return "boolean" if isinstance(v, bool) else "string" if isinstance(v, str) else "array" if isinstance(v, list) else "object" if isinstance(v, dict) else "number"


def parse_line(raw) -> dict | None:
    """The JSON object of a line after any byte-order mark and outer white space, else None."""
    if raw is None:
        return None
    t = raw.strip().lstrip("﻿").strip()
    if not t.startswith("{"):
        return None
    try:
        v = json.loads(t)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def value_hash(v) -> int:
    text = v if isinstance(v, str) else json.dumps(v, sort_keys=True, ensure_ascii=False)
    return int.from_bytes(blake2b(f"{json_type(v)}:{text}".encode("utf-8", "surrogatepass"), digest_size=8).digest(), "big", signed=True)


def walk(obj: dict) -> Iterator[tuple[str, object]]:
    """(path, value) of all fields at all levels, elements of arrays included; nulls have no type and are left out."""
    todo: list[tuple[str, object]] = [(k, v) for k, v in obj.items()]
    while todo:
        path, v = todo.pop()
        if v is None:
            continue
        yield path, v
        if isinstance(v, dict):
            todo += [(path + SEP + k, x) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(path + SEP + ELEMENT, x) for x in v]


def _types(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen = set()
        for p, f, raw in zip(b["project_key"], b["file_no"], b["raw"]):
            obj = parse_line(raw)
            if obj is not None:
                seen.update((p, f, path, json_type(v)) for path, v in walk(obj))
        yield pd.DataFrame(list(seen), columns=["project_key", "file_no", "path", "jtype"])


def file_schemas(lines: DataFrame) -> DataFrame:
    """(project_key, file_no, path, types) of every file; ``types`` in order, joined by ``|``."""
    types = lines.select("project_key", "file_no", "raw").filter("raw is not null").mapInPandas(_types, "project_key string, file_no int, path string, jtype string")
    return types.groupBy("project_key", "file_no", "path").agg(F.array_join(F.sort_array(F.collect_set("jtype")), "|").alias("types"))


def _hashes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        seen = set()
        for p, f, raw, paths in zip(b["project_key"], b["file_no"], b["raw"], b["paths"]):
            wanted = set(paths)
            if obj := parse_line(raw):
                seen.update((p, f, path, value_hash(v)) for path, v in walk(obj) if path in wanted)
        yield pd.DataFrame(list(seen), columns=["project_key", "file_no", "path", "vhash"])


def file_values(lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """Distinct (project_key, file_no, path, vhash) of the fields ``wanted`` (project_key, file_no, paths)."""
    src = lines.select("project_key", "file_no", "raw").filter("raw is not null").join(wanted, ["project_key", "file_no"])
    return src.mapInPandas(_hashes, "project_key string, file_no int, path string, vhash long").distinct()


def assign(cost: np.ndarray) -> list[tuple[int, int]]:
    """Minimum-cost perfect matching of a square matrix (shortest augmenting paths)."""
    n = len(cost)
    u, v, match = np.zeros(n + 1), np.zeros(n + 1), np.zeros(n + 1, dtype=int)
    for i in range(1, n + 1):
        match[0], j0 = i, 0
        least, used, way = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=bool), np.zeros(n + 1, dtype=int)
        while True:
            used[j0] = True
            i0 = match[j0]
            red = cost[i0 - 1] - u[i0] - v[1:]
            better = ~used[1:] & (red < least[1:])
            least[1:][better], way[1:][better] = red[better], j0
            free = np.where(used[1:], np.inf, least[1:])
            j1 = int(np.argmin(free)) + 1
            delta = free[j1 - 1]
            u[match[used]] += delta
            v[used] -= delta
            least[~used] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    return [(match[j] - 1, j - 1) for j in range(1, n + 1)]


def tree(paths: dict[str, str]) -> dict:
    """{name: (types, path, children)} from path -> types."""
    root: dict = {}
    for path in sorted(paths, key=lambda p: p.count(SEP)):
        *above, name = path.split(SEP)
        at = root
        for a in above:
            at = at[a][2]
        at[name] = (paths[path], path, {})
    return root


def size(node) -> int:
    return 1 + sum(size(c) for c in node[2].values())


def _matched(gone: list, come: list, shared: dict, each: float) -> tuple[list[tuple[int, int]], dict, float]:
    """Assignment of least cost of (name, node) lists: pairs of places, scripts inside of pairs, cost.

    A pair needs equal types and a shared value; of several, more shared values and nearer names win. A place beyond
    the other list's end stands for a drop or an add.
    """
    n, sub = len(gone) + len(come), {}
    cost = np.full((n, n), 0.0)
    for i, (g, a) in enumerate(gone):
        for j, (c, b) in enumerate(come):
            common = shared.get((a[1], b[1]), 0)
            if a[0] == b[0] and common:
                sub[i, j] = edit_script(a[2], b[2], shared)
                near = 0.1 * (1 - SequenceMatcher(None, camel(g).lower(), camel(c).lower()).ratio())
                cost[i, j] = each + sub[i, j][0] + near + 0.2 / (1 + common)
            else:
                cost[i, j] = 1e6
        cost[i, len(come):] = DROP_COST * size(a)
    for j, (_, b) in enumerate(come):
        cost[len(gone):, j] = DROP_COST * size(b)
    if not sub:
        pairs = [(i, len(come) + i) for i in range(len(gone))] + [(len(gone) + j, j) for j in range(len(come))]
    else:
        pairs = assign(cost)
    return pairs, sub, float(sum(cost[i, j] for i, j in pairs))


def edit_script(old: dict, new: dict, shared: dict[tuple[str, str], int]) -> tuple[float, list[tuple[str, str, str]]]:
    """Least cost and script [(kind, path, new path)] between two forests, without moves.

    Kinds: added, removed, renamed, retyped. ``shared``: values in common of (old path, new path).
    """
    script: list = []
    total = 0.0
    for name in sorted(old.keys() & new.keys()):
        a, b = old[name], new[name]
        if a[0] != b[0]:
            total += RETYPE_COST
            script.append(("retyped", a[1], b[1]))
        c, s = edit_script(a[2], b[2], shared)
        total += c
        script += s
    gone = [(k, old[k]) for k in sorted(old.keys() - new.keys())]
    come = [(k, new[k]) for k in sorted(new.keys() - old.keys())]
    pairs, sub, cost = _matched(gone, come, shared, RENAME_COST)
    for i, j in pairs:
        if i < len(gone) and j < len(come):
            script.append(("renamed", gone[i][1][1], come[j][1][1]))
            script += sub[i, j][1]
        elif i < len(gone):
            script.append(("removed", gone[i][1][1], ""))
        elif j < len(come):
            script.append(("added", come[j][1][1], ""))
    return total + cost, script


def nodes_of(forest: dict) -> dict[str, tuple]:
    out, todo = {}, list(forest.values())
    while todo:
        node = todo.pop()
        out[node[1]] = node
        todo += node[2].values()
    return out


def with_moves(old: dict, new: dict, shared: dict[tuple[str, str], int]) -> list[tuple[str, str, str]]:
    """The script of ``edit_script`` in which removed and added fields at different places are matched to moves."""
    _, script = edit_script(old, new, shared)
    a, b = nodes_of(old), nodes_of(new)
    name = lambda path: path.rsplit(SEP, 1)[-1]
    # a field may also have moved out of, or into, a subtree that went or came as a whole
    gone = [(name(x), n) for k, p, _ in script if k == "removed" for x, n in sorted(nodes_of({"": a[p]}).items())]
    come = [(name(x), n) for k, p, _ in script if k == "added" for x, n in sorted(nodes_of({"": b[p]}).items())]
    able = [(g, c) for g in gone for c in come if g[1][0] == c[1][0] and shared.get((g[1][1], c[1][1]))]
    if not able:
        return script
    gone = [g for g in gone if any(g is x for x, _ in able)]
    come = [c for c in come if any(c is x for _, x in able)]
    pairs, sub, _ = _matched(gone, come, shared, MOVE_COST)
    moved = {gone[i][1][1]: (come[j][1][1], sub[i, j][1]) for i, j in pairs if i < len(gone) and j < len(come)}
    # the outermost field of a moved subtree says it all
    moved = {x: y for x, y in moved.items() if not any(x.startswith(z + SEP) for z in moved)}
    to = {y: x for x, (y, _) in moved.items()}
    out = [(k, p, q) for k, p, q in script if not (k == "removed" and p in moved or k == "added" and p in to)]
    return out + [step for x, (y, inner) in sorted(moved.items()) for step in [("moved", x, y), *inner]]


def shown(path: str) -> str:
    """A path as it is reported: names joined by dots, elements of arrays as ``[]``."""
    return path.replace(SEP + ELEMENT, ELEMENT).replace(SEP, ".")


CHANGES = "project_key string, file_no int, change_kind string, field string, new_field string, level int, new_level int, old_path string, new_path string"


def _scripts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        out = []
        for p, f, old, new, shared in zip(b["project_key"], b["file_no"], b["old_schema"], b["new_schema"], b["shared"]):
            common = {(r["a"], r["b"]): r["n"] for r in (shared if shared is not None else [])}
            script = with_moves(tree(dict((r["path"], r["types"]) for r in old)), tree(dict((r["path"], r["types"]) for r in new)), common)
            for kind, x, y in script:
                to = y if kind in ("renamed", "moved") else ""
                out.append((p, f, kind, shown(x), shown(to), x.count(SEP), (y or x).count(SEP), x, y))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CHANGES.split(", ")])


def schema_changes(lines: DataFrame) -> DataFrame:
    """Edit scripts between each file of a project and its next one, reported at the later file.

    ``lines``: project_key, file_no, raw; files are ordered by file_no whatever the gaps or arrival. Result:
    project_key, file_no, change_kind (added, removed, renamed, moved, retyped), field, new_field ('' unless renamed or moved;
    nested fields with dots, elements of arrays as ``[]``), level and new_level (0 for top-level fields), and both as paths.
    Null raws and lines that are no object count for nothing; a file without any object has an empty schema.
    """
    files = lines.select("project_key", "file_no").filter("project_key is not null and file_no is not null").distinct()
    after = files.withColumn("prev_no", F.lag("file_no").over(Window.partitionBy("project_key").orderBy("file_no"))).filter("prev_no is not null")
    schemas = cut(file_schemas(lines))
    packed = schemas.groupBy("project_key", "file_no").agg(F.sort_array(F.collect_list(F.struct("path", "types"))).alias("s"))
    empty = F.array().cast("array<struct<path:string,types:string>>")
    pairs = cut(
        after.join(packed.select("project_key", "file_no", F.col("s").alias("new_s")), ["project_key", "file_no"], "left")
        .join(packed.select("project_key", F.col("file_no").alias("prev_no"), F.col("s").alias("old_s")), ["project_key", "prev_no"], "left")
        .select("project_key", "file_no", "prev_no", F.coalesce("old_s", empty).alias("old_schema"), F.coalesce("new_s", empty).alias("new_schema"))
    )
    path = lambda x: x["path"]
    side = lambda a, b: F.filter(a, lambda x: ~F.array_contains(F.transform(b, path), x["path"]))
    moving = pairs.select("project_key", "file_no", "prev_no", side("old_schema", F.col("new_schema")).alias("gone"), side("new_schema", F.col("old_schema")).alias("come"))
    kinds = lambda c: F.transform(c, lambda x: x["types"])
    # a field whose types nothing else has on the other side can't be the same field under another name
    gone = moving.select("project_key", "file_no", "prev_no", F.explode(F.filter("gone", lambda x: F.array_contains(kinds(F.col("come")), x["types"]))).alias("x")).select("project_key", "file_no", "prev_no", "x.*")
    come = moving.select("project_key", "file_no", F.explode(F.filter("come", lambda x: F.array_contains(kinds(F.col("gone")), x["types"]))).alias("x")).select("project_key", "file_no", "x.*")
    wanted = gone.select("project_key", F.col("prev_no").alias("file_no"), "path").union(come.select("project_key", "file_no", "path"))
    values = cut(file_values(lines, cut(wanted.groupBy("project_key", "file_no").agg(F.collect_set("path").alias("paths")))))
    old_v = gone.join(values.withColumnRenamed("file_no", "prev_no"), ["project_key", "prev_no", "path"]).select("project_key", "file_no", "vhash", "types", F.col("path").alias("a"))
    new_v = come.join(values, ["project_key", "file_no", "path"]).select("project_key", "file_no", "vhash", "types", F.col("path").alias("b"))
    shared = old_v.join(new_v, ["project_key", "file_no", "vhash", "types"]).groupBy("project_key", "file_no", "a", "b").agg(F.count("*").alias("n")).groupBy("project_key", "file_no").agg(F.collect_list(F.struct("a", "b", "n")).alias("shared"))
    work = pairs.join(shared, ["project_key", "file_no"], "left").select("project_key", "file_no", "old_schema", "new_schema", "shared")
    return work.mapInPandas(_scripts, CHANGES)


def top_level(changes: DataFrame) -> DataFrame:
    """Changes of top-level fields alone: a move from or to another level is a removal or an addition there."""
    flat = F.when(F.col("change_kind") != "moved", F.array(F.struct("change_kind", "field", "new_field", "level")))
    removed = F.struct(F.lit("removed").alias("change_kind"), "field", F.lit("").alias("new_field"), "level")
    added = F.struct(F.lit("added").alias("change_kind"), F.col("new_field").alias("field"), F.lit("").alias("new_field"), F.col("new_level").alias("level"))
    return changes.select("project_key", "file_no", F.explode(F.coalesce(flat, F.array(removed, added))).alias("c")).select("project_key", "file_no", "c.*").filter("level = 0").drop("level")


def _resolve_names(catalog: list[str]):
    by_norm = {c.replace("_", "").lower(): c for c in catalog}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for project, fields, links in zip(b["project_key"], b["fields"], b["links"]):
                near: dict[str, set[str]] = {}
                for r in links if links is not None else []:
                    near.setdefault(r["a"], set()).add(r["b"])
                    near.setdefault(r["b"], set()).add(r["a"])
                target = {c: c for c in catalog}
                wave = [c for c in catalog if c in near]
                while wave:  # breadth first from the catalogue's names along renames, ties by name
                    nxt = []
                    for a in sorted(wave):
                        for z in sorted(near[a]):
                            if z not in target:
                                target[z] = target[a]
                                nxt.append(z)
                    wave = nxt
                for f in fields:
                    c = target.get(f) or (by_norm.get(f.replace("_", "").lower()) if SEP not in f else None)
                    if c:
                        out.append((project, f, c))
            yield pd.DataFrame(out, columns=["project_key", "field", "catalog_field"])

    return run


def name_maps(schemas: DataFrame, changes: DataFrame, catalog: list[str]) -> DataFrame:
    """(project_key, field, catalog_field): the projection of a project's files, compiled from the scripts.

    ``field`` is a path. A field is itself if the catalogue has its name, else the catalogue field that the renames and
    moves of its project lead to (backwards or forwards), else a top-level one of the same name in another case style.
    """
    fields = schemas.filter(~F.col("path").contains(ELEMENT)).groupBy("project_key").agg(F.collect_set("path").alias("fields"))
    links = changes.filter("change_kind in ('renamed', 'moved')").groupBy("project_key").agg(F.collect_set(F.struct(F.col("old_path").alias("a"), F.col("new_path").alias("b"))).alias("links"))
    return fields.join(links, "project_key", "left").mapInPandas(_resolve_names(catalog), "project_key string, field string, catalog_field string")


def as_boolean(v) -> bool | None:
    """A boolean in any of its spellings, also as the only value of an object or array; None for other values."""
    while isinstance(v, (dict, list)) and len(v) == 1:
        v = next(iter(v.values())) if isinstance(v, dict) else v[0]
    return v if isinstance(v, bool) else {"true": True, "false": False, "yes": True, "no": False, "1": True, "0": False}.get(str(v).strip().lower())


def at_path(obj, path: str):
    for k in path.split(SEP):
        if not isinstance(obj, dict):
            return None
        obj = obj.get(k)
    return obj


def _project(columns: list[tuple[str, str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for p, f, no, raw, names in zip(b["project_key"], b["file_no"], b["line_no"], b["raw"], b["names"]):
                obj = parse_line(raw)
                if obj is None:
                    continue
                to = {r["field"]: r["catalog_field"] for r in (names if names is not None else [])}
                got, keys, rest, whole = {}, {}, {}, {}
                for k, v in obj.items():
                    if v is None:
                        continue
                    c = to.get(k)
                    if c and c not in got:
                        got[c] = v
                        keys[c] = k
                    else:
                        rest[k] = v
                for path, c in to.items():
                    if SEP in path and c not in got and (v := at_path(obj, path)) is not None:
                        got[c] = v  # a field that moved; it stays in the field around it as well
                row = [p, f, no]
                for name, kind in columns:
                    v = got.get(name)
                    if v is None:
                        row.append(None)
                    elif kind == "boolean":
                        row.append(as_boolean(v))
                        if row[-1] is None and name in keys:
                            rest[keys[name]] = v
                        elif isinstance(v, (dict, list)):
                            whole[name] = v
                    elif kind == "string" and isinstance(v, dict) and len(v) == 1 and isinstance(next(iter(v.values())), str):
                        row.append(next(iter(v.values())))  # a string wrapped into an object, whose key is kept
                        whole[name] = v
                    else:
                        row.append(v if isinstance(v, str) else json.dumps(v, ensure_ascii=False))
                rows.append([*row, *(json.dumps(x, ensure_ascii=False) if x else None for x in (rest, whole))])
            yield pd.DataFrame(rows, columns=["project_key", "file_no", "line_no", *(c for c, _ in columns), "other_fields", "wrapped_values"])

    return run


def unify(lines: DataFrame, catalog: DataFrame) -> DataFrame:
    """All lines as one table: the catalogue's fields with its types (objects as JSON text) and the rest as JSON.

    A value that does not fit a boolean field is null there and stands in other_fields under its own name; wrapped_values
    keeps, by field, the objects and arrays out of which a value was read. Lines are merged by (project_key, file_no, line_no).
    """
    one = lines.drop("received_at").dropDuplicates(["project_key", "file_no", "line_no"])
    columns = [(r["field_name"], r["json_type"]) for r in catalog.select("field_name", "json_type").distinct().orderBy("field_name").collect()]  # fixed, small
    maps = name_maps(file_schemas(lines), schema_changes(lines), [c for c, _ in columns]).groupBy("project_key").agg(F.collect_list(F.struct("field", "catalog_field")).alias("names"))
    schema = "project_key string, file_no int, line_no long, " + ", ".join(f"`{c}` {'boolean' if k == 'boolean' else 'string'}" for c, k in columns) + ", other_fields string, wrapped_values string"
    return one.select("project_key", "file_no", "line_no", "raw").join(cut(maps), "project_key", "left").mapInPandas(_project(columns), schema)
