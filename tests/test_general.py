import json
import random

from packetloom.operators import contraction, drift, flatten, hierarchy


def nodes(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], "scope string, id string, parent string, pos long, state string")


def brute(rows):
    first = {}
    for s, i, p, pos in sorted((r for r in rows if r[0] is not None and r[1] is not None), key=lambda r: (r[3] or 0, r[2] or "")):
        first.setdefault((s, i), p)
    out = {}
    for s, i in first:
        path, at = [i], i
        while True:
            p = first[s, at]
            if p is None:
                out[s, i] = ("root", path[::-1])
                break
            if (s, p) not in first:
                out[s, i] = ("orphan" if at == i else "under_orphan", path[::-1])
                break
            if p in path:
                out[s, i] = ("cycle" if p == i else "below_cycle", None)
                break
            path.append(p)
            at = p
    return out


def check(spark, rows, **kw):
    got = {(r["scope"], r["id"]): (r["state"], r["path"]) for r in hierarchy.resolve_hierarchy(nodes(spark, rows), **kw).collect()}
    want = brute(rows)
    assert got == want


def test_hierarchy_random_forests_match_brute_force(spark):
    r = random.Random(5)
    rows = []
    for s in ("a", "b"):
        for i in range(120):
            kind = r.random()
            parent = None if kind < 0.05 else f"n{r.randrange(max(1, i - 6), i + 1)}" if kind < 0.9 and i else f"n{r.randrange(120)}" if kind < 0.95 else "missing"
            rows.append((s, f"n{i}", parent, i))
    rows += rows[:7] + [("a", None, None, 3), (None, "z", None, 1)]
    for block in (4, 16, 4096):
        check(spark, rows, block=block)


def test_hierarchy_loop_through_blocks_and_tails(spark):
    ring = [("s", f"r{i}", f"r{(i + 1) % 30}", i) for i in range(30)]
    check(spark, ring + [("s", "t0", "r7", 31), ("s", "t1", "t0", 32), ("s", "self", "self", 33)], block=4)


def test_hierarchy_doubling_gives_the_same(spark, monkeypatch):
    doubled = []
    plain = contraction._double
    monkeypatch.setattr(contraction, "_double", lambda *a: doubled.append(1) or plain(*a))
    r = random.Random(8)
    check(spark, [("s", f"n{i}", f"n{r.randrange(60)}" if i > 5 else None, i) for i in range(60)], block=2)  # nothing to contract
    assert doubled
    rows = [("s", f"n{i}", f"n{i - 1}" if i else None, i) for i in range(40)] + [("s", f"c{i}", f"c{(i + 1) % 12}", 50 + i) for i in range(12)] + [("s", "d", "c3", 70), ("s", "e", "gone", 71), ("s", "f", "e", 99)]
    check(spark, rows, block=4)


def test_hierarchy_empty_and_descendants(spark):
    assert hierarchy.resolve_hierarchy(nodes(spark, [])).count() == 0
    tree = hierarchy.resolve_hierarchy(nodes(spark, [("s", "a", None, 0), ("s", "b", "a", 1), ("s", "c", "b", 2)]))
    assert {(r["ancestor"], r["descendant"], r["distance"]) for r in hierarchy.descendants(tree).collect()} == {("a", "b", 1), ("a", "c", 2), ("b", "c", 1)}


def test_totals_and_preorder_intervals_match_brute_force(spark):
    r = random.Random(11)
    rows = [("s", f"n{i}", None if i < 2 else f"n{r.randrange(max(0, i - 9), i)}" if r.random() < 0.9 else f"n{r.randrange(50)}", i) for i in range(50)] + [("s", "o", "gone", 60), ("s", "u", "o", 61), ("s", "x", None, None)]
    paths = {k[1]: p for k, (_, p) in brute(rows).items()}
    for block in (3, 4096):
        tree = hierarchy.resolve_hierarchy(nodes(spark, rows), block=block, sums=True)
        got = {x["id"]: x["total"] for x in tree.collect()}
        span = {x["id"]: (x["first"], x["last"]) for x in hierarchy.preorder(tree, block).collect()}
        root = {k: p[0] for k, p in paths.items() if p}
        assert span.keys() == root.keys()
        for k in root:
            below = {z for z, p in paths.items() if p and k in p and z != k}
            assert got[k] == len(below) + 1
            assert below == {z for z in root if root[z] == root[k] and span[k][0] < span[z][0] <= span[k][1]}
            assert len({span[z] for z in root if root[z] == root[k]}) == sum(v == root[k] for v in root.values())


def test_descendants_on_and_below_loops(spark):
    ring = [("s", f"r{i}", f"r{(i + 1) % 7}", i) for i in range(7)]
    rows = ring + [("s", "t0", "r3", 8), ("s", "t1", "t0", 30), ("s", "t2", "t1", 9), ("s", "self", "self", 40), ("s", "under", "self", 10), ("s", "a", None, 11), ("s", "b", "a", 12), ("q", "t0", "u", 1), ("q", "u", "t0", 2)]
    rows += [("s", "t1", "r0", 99)] + rows[:2]
    first = {}
    for s, i, p, _ in sorted(rows, key=lambda r: r[3]):
        first.setdefault((s, i), p)
    want = set()
    for s, i in first:
        at, n, seen = first[s, i], 1, {i}
        while at is not None and at not in seen:
            want.add((s, at, i, n))
            seen.add(at)
            at, n = first[s, at], n + 1
    links = nodes(spark, rows)
    tree = hierarchy.resolve_hierarchy(links, block=4)
    pairs = hierarchy.descendants(tree).unionByName(hierarchy.loop_descendants(links, tree)).collect()
    got = [(r["scope"], r["ancestor"], r["descendant"], r["distance"]) for r in pairs]
    assert len(got) == len(set(got)) and set(got) == want
    loose = {k for k, (state, _) in brute(rows).items() if "cycle" in state}
    count = {k: sum((s, a) == k for s, a, _, _ in want) for k in loose}
    assert {(r["scope"], r["id"]): r["n"] for r in hierarchy.loop_counts(links, tree).collect()} == {k: n for k, n in count.items() if n or k in {("s", "self")}}


def test_flatten_spellings_and_places():
    patch = json.dumps(json.dumps({"structured_patch": {"oldStart": 1, "lines": ["-a", None, "+b"]}}))
    got = [(t, i, j) for t, i, j, _ in flatten.visit(json.dumps([{"type": "text", "text": "x"}, None, {"type": "tool_result", "content": {"type": "text", "text": "y"}}]), patch, ["u", None, "v"])]
    assert got == [("block", 0, -1), ("block", 2, -1), ("part", 2, 0), ("hunk", 0, -1), ("patch_line", 0, 0), ("patch_line", 0, 2), ("preserved", 0, -1), ("preserved", 2, -1)]
    assert list(flatten.visit("[1] plain text", "{damaged", None)) == []
    assert list(flatten.visit("", None, [])) == []


def test_flatten_rows(spark):
    schema = "session_id string, line_no long, content string, toolUseResult string, compactMetadata struct<trigger:string,preTokens:bigint,preservedMessages:struct<uuids:array<string>>>, received_at timestamp, payload string"
    rows = [("s", 1, '{"type":"text","text":"a"}', None, None, None, "clash")] * 2 + [("s", 2, None, '{"results":[{"path":"p","matches":[{"line":3,"text":"t"}]}]}', ("auto", 1, (["u"],)), None, None), ("s", 3, None, None, None, None, None)]
    tagged = flatten.flatten_records(spark.createDataFrame(rows, schema))
    assert sorted((r["line_no"], r["rel"], r["item_no"], r["sub_no"]) for r in tagged.collect()) == [(1, "block", 0, -1), (2, "match", 0, 0), (2, "preserved", 0, -1), (2, "result", 0, -1)]
    m = flatten.relation(tagged, "match").first()
    assert (m["line"], m["text"], m["parent_key"]) == (3, "t", "s:2:result:0")
    assert flatten.flatten_records(spark.createDataFrame([], schema)).count() == 0


def test_flatten_tables_lose_nothing(spark):
    schema = "session_id string, line_no long, type string, subtype string, uuid string, parentUuid string, ts timestamp, isSidechain boolean, isMeta boolean, isCompactSummary boolean, role string, content string, toolUseResult string, compactMetadata struct<trigger:string,preTokens:bigint,preservedMessages:struct<uuids:array<string>>>, received_at timestamp"
    blocks = [{"type": "thinking", "thinking": "h", "signature": "sig"}, {"type": "tool_result", "tool_use_id": "t", "content": "plain out"}, {"type": "tool_result", "content": [{"type": "image", "source": {"ref": "r1"}}]}, {"type": "text", "text": "x", "is_error": "maybe", "extra": 7}, "loose"]
    done = {"stdout": "o1", "stderr": "e1", "numFiles": "3", "novel": 8, "structuredPatch": [{"oldStart": "5", "lines": ["+a"], "note": "n1"}], "results": ["stray", {"path": "p", "matches": ["m1"]}]}
    base = ("user", None, "u", "v", None, False, True, None, "user")
    rows = [("s", 1, *base, json.dumps(blocks), json.dumps(done), ("auto", 12, (["k"],)), None), ("s", 2, *base, "[1] just text", "plain result", None, None), ("s", 3, *base, None, None, None, None)]
    d = flatten.tables(spark.createDataFrame(rows, schema)).collect()
    by = {(r["row_key"]): json.loads(r["payload"]) for r in d}
    assert {r["parent_key"] for r in d} - {None} <= set(by) and len(by) == len(d)
    row = by["s:1"]
    assert (row["trigger"], row["preTokens"], row["stdout"], row["stderr"], row["numFiles"], row["isMeta"], row["parentUuid"]) == ("auto", 12, "o1", "e1", 3, True, "v")
    assert json.loads(row["rest"]) == {"content": {"4": "loose"}, "toolUseResult": {"results": {"0": "stray"}, "novel": 8}}
    assert (by["s:2"]["content"], by["s:2"]["toolUseResult"], by["s:3"]["uuid"]) == ("[1] just text", "plain result", "u")
    assert by["s:1:block:0"]["signature"] == "sig" and by["s:1:block:1"]["content"] == "plain out" and json.loads(by["s:1:part:2:0"]["source"]) == {"ref": "r1"}
    assert json.loads(by["s:1:block:3"]["rest"]) == {"is_error": "maybe", "extra": 7} and by["s:1:hunk:0"]["oldStart"] == 5 and json.loads(by["s:1:hunk:0"]["rest"]) == {"note": "n1"}
    assert json.loads(by["s:1:match:1:0"]["rest"]) == {"value": "m1"}


def lines(spark, files):
    rows = [(p, f, n + 1, None, raw) for (p, f), raws in files.items() for n, raw in enumerate(raws)]
    return spark.createDataFrame(rows, "project_key string, file_no int, line_no long, received_at timestamp, raw string")


def test_drift_changes(spark):
    files = {
        ("p", 1): ['{"type":"user","cwd":"/w","n":1,"gone":"x"}', '"torn', "", None],
        ("p", 4): ['﻿ {"kind":"user","cwd":"/w","n":"1","new":"y"} \r', "{}"],
        ("p", 9): ['{"kind":null,"cwd":"/w"}'],
        ("q", 2): ['{"a":1}'],
    }
    got = {(r["file_no"], r["change_kind"], r["field"], r["new_field"]) for r in drift.schema_changes(lines(spark, files)).filter("level = 0").collect()}
    assert got == {(4, "renamed", "type", "kind"), (4, "retyped", "n", ""), (4, "removed", "gone", ""), (4, "added", "new", ""), (9, "removed", "kind", ""), (9, "removed", "n", ""), (9, "removed", "new", "")}


def test_drift_unify(spark):
    files = {("p", 1): ['{"type":"user","isMeta":true}'], ("p", 2): ['{"rowType":"user","is_meta":"false","more":[1]}'], ("p", 3): ['{"type":{"name":"user"}}', "x"]}
    catalog = spark.createDataFrame([("type", "string"), ("isMeta", "boolean")], "field_name string, json_type string")
    got = sorted((r["file_no"], r["type"], r["isMeta"], r["other_fields"]) for r in drift.unify(lines(spark, files), catalog).collect())
    assert got == [(1, "user", True, None), (2, "user", False, '{"more": [1]}'), (3, "user", None, None)]


def test_drift_unify_keeps_values_of_boolean_fields(spark):
    raws = ['{"isMeta":"yes"}', '{"isMeta":"No "}', '{"isMeta":{"value":true}}', '{"isMeta":[0]}', '{"isMeta":"perhaps","x":1}', '{"is_meta":{"a":true,"b":false}}', '{"isMeta":2}']
    catalog = spark.createDataFrame([("isMeta", "boolean")], "field_name string, json_type string")
    got = {r["line_no"]: (r["isMeta"], json.loads(r["other_fields"] or "{}")) for r in drift.unify(lines(spark, {("p", 1): raws}), catalog).collect()}
    assert [got[n] for n in range(1, 8)] == [(True, {}), (False, {}), (True, {}), (False, {}), (None, {"x": 1, "isMeta": "perhaps"}), (None, {"is_meta": {"a": True, "b": False}}), (None, {"isMeta": 2})]


def test_assignment_is_optimal():
    import itertools

    import numpy as np

    r = np.random.default_rng(1)
    for n in (1, 2, 4, 5):
        c = r.random((n, n))
        best = min(sum(c[i, p[i]] for i in range(n)) for p in itertools.permutations(range(n)))
        assert abs(sum(c[i, j] for i, j in drift.assign(c)) - best) < 1e-9


def test_moves_arrays_and_deep_levels_are_in_the_script(spark):
    deep = lambda v, leaf: {"a": {"b": {"c": {"d": {"e": {leaf: v}}}}}}
    files = {
        ("p", 1): [json.dumps({"a": {"x": "val-1", "keep": 1}, "b": {"keep": 2}, "c": [{"t": "same"}], **{"z": deep("q-9", "old")}})],
        ("p", 2): [json.dumps({"a": {"keep": 1}, "b": {"x": "val-1", "keep": 2}, "c": [{"u": "same"}], **{"z": deep("q-9", "new")}})],
        ("p", 3): [json.dumps({"a": {"keep": 1}, "b": {"keep": 2}, "x": "val-1", "c": [{"u": 5}], **{"z": deep("q-9", "new")}})],
    }
    rows = drift.schema_changes(lines(spark, files))
    got = {(r["file_no"], r["change_kind"], r["field"], r["new_field"]) for r in rows.collect()}
    assert got == {
        (2, "moved", "a.x", "b.x"), (2, "renamed", "c[].t", "c[].u"), (2, "renamed", "z.a.b.c.d.e.old", "z.a.b.c.d.e.new"), (3, "moved", "b.x", "x"), (3, "retyped", "c[].u", ""),
    }
    assert [(r["file_no"], r["change_kind"], r["field"]) for r in drift.top_level(rows).collect()] == [(3, "added", "x")]


def test_moved_and_wrapped_values_are_read_and_kept(spark):
    catalog = spark.createDataFrame([("kind", "string"), ("x", "string")], "field_name string, json_type string")
    files = {("p", 1): [json.dumps({"a": {"x": "v1"}, "kind": {"k": "user"}})], ("p", 2): [json.dumps({"a": {}, "x": "v1", "kind": "user"})]}
    got = {r["file_no"]: (r["kind"], r["x"], json.loads(r["other_fields"] or "{}"), json.loads(r["wrapped_values"] or "{}")) for r in drift.unify(lines(spark, files), catalog).collect()}
    assert got == {1: ("user", "v1", {"a": {"x": "v1"}}, {"kind": {"k": "user"}}), 2: ("user", "v1", {"a": {}}, {})}
