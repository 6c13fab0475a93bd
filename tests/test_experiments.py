"""Loaders, sinks, quotes, kept views and samples."""

import json

import pytest
from pyspark.sql import functions as F

from packetloom.operators import events, experiments, metrics, retrieval, weave
from packetloom.sources import loaders


def test_options_keys_and_discovery(spark, tmp_path):
    assert loaders.known_options("pi", {"link_values": True, "unknown": 1, "include_sidechain": True}) == {"link_values": True}
    with pytest.raises(ValueError):
        loaders.known_options("other", {})
    assert loaders.project_key("/home/a b/x.y") == "-home-a-b-x-y"
    for project, name in (("p1", "s1"), ("p1", "s2"), ("p2", "s3")):
        (tmp_path / project).mkdir(exist_ok=True)
        (tmp_path / project / f"{name}.jsonl").write_text("{}\n")
    (tmp_path / "p1" / "note.txt").write_text("x")
    files = loaders.discovered(spark, str(tmp_path))
    assert {(r["project"], r["session"]) for r in files.collect()} == {("p1", "s1"), ("p1", "s2"), ("p2", "s3")}
    assert loaders.resolved(files, "s3").collect()[0]["project"] == "p2" and loaders.resolved(files, "latest", "p1").count() == 1 and loaders.resolved(files, "none").count() == 0


def test_event_files_units_and_archives(spark, tmp_path):
    (tmp_path / "e").mkdir()
    for n, text in (("event-0002.json", '{"a": 2}'), ("event-0001.json", '{"a": 1}'), ("event-0003.json", "{torn"), ("other.json", '{"a": 9}')):
        (tmp_path / "e" / n).write_text(text)
    d = loaders.event_files(spark, str(tmp_path / "e"))
    assert [r[0] for r in d.orderBy("file_name").select(F.variant_get("event", "$.a", "int")).collect()] == [1, 2]
    units = spark.createDataFrame([(1, "x"), (2, "y")], "k int, v string")
    path = str(tmp_path / "units")
    assert loaders.write_units(units, path, ["k"]) == 2 and loaders.write_units(units.union(spark.createDataFrame([(3, "z")], "k int, v string")), path, ["k"]) == 1
    assert spark.read.parquet(path).count() == 3
    loaders.write_archive(units, str(tmp_path / "arch"))
    assert any(p.name.endswith(".json.gz") for p in (tmp_path / "arch").iterdir()) and spark.read.json(str(tmp_path / "arch")).count() == 2


def test_edges_need_a_session_and_prompts_get_replies(spark):
    e = spark.createDataFrame([("s", "a", "b", None), ("", "a", "b", "p")], "session string, src_id string, dst_id string, predicate string")
    assert loaders.edge_table(spark.createDataFrame([("s", "a", "b", None)], e.schema)).collect()[0]["predicate"] == ""
    with pytest.raises(Exception, match="without a session"):
        loaders.edge_table(e).collect()
    p = spark.createDataFrame([("a",), ("b",)], "prompt string")
    assert {r["prompt"]: r["reply"] for r in loaders.answered(p, lambda xs: [x.upper() for x in xs]).collect()} == {"a": "A", "b": "B"}

    def broken(xs):
        raise RuntimeError

    assert [r["reply"] for r in loaders.answered(p, broken).collect()] == [None, None]


def test_demo_session_has_one_compaction(spark):
    ev = events.canonical(loaders.demo_session(spark))
    assert ev.count() == 14 and ev.filter("kind = 'summary'").count() == 1 and events.result_of(ev).count() == 3


def test_longest_literal_runs(spark):
    body = "def clamp_window(bucket, cursor):\n    return bucket if pinned else cursor + 1\n"
    assert experiments.shared_run(body, "noise " + body + " more", enough=10**6) == len(body)
    assert experiments.shared_run(" " * 80, " " * 90) == 0 and experiments.shared_run("short", "short") == 0
    assert 40 <= experiments.shared_run(body[5:60], "x" * 30 + body[5:60] + "y", enough=10**6) == 55
    call = "Edit " + json.dumps({"file_path": "a.py", "new_string": body})
    rows = [("r1", "tool_result", 1, "other text " * 20), ("r2", "tool_result", 2, body[:50]), ("r3", "tool_result", 3, "x\n" + body), ("c", "tool_call", 4, call), ("r4", "tool_result", 5, body)]
    ev = spark.createDataFrame([("s", i, n, k, x) for n, (i, k, _, x) in enumerate(rows)], "session_id string, event_id string, pos long, kind string, text string")
    assert {(r["dst_id"], r["predicate"]) for r in experiments.depends_quote(ev).collect()} == {("r3", "literal_quote>=40"), ("r2", "literal_quote>=40")}


def test_kept_views_follow_the_rule(spark):
    ev = [("v1", 1, "/testbed/src/a.py", True, False, None, "A" * 10), ("v2", 2, "src/b.py", True, False, None, "B" * 10), ("e2", 3, "src/b.py", False, True, None, None), ("v3", 4, "src/c.py", True, False, None, "C" * 20_000), ("v4", 5, "src/d.py", True, False, None, "Here's the files and directories up to"),
          ("v5", 6, "src/e.py", True, False, None, "E"), ("s5", 7, None, False, False, "sed -i s/x/y/ src/e.py", None), ("v6", 8, "src/f.py", True, False, None, None), ("v7", 9, "src/g.py", True, False, None, "G"), ("v8", 10, "src/late.py", True, False, None, "L"), ("v9", 11, "src", True, False, None, "folder")]
    d = spark.createDataFrame([("s", *r) for r in ev], "session_id string, event_id string, pos long, path string, viewed boolean, edited boolean, command string, shown string")
    gone = spark.createDataFrame([("s", r[0]) for r in ev if r[0] != "v8"], "session_id string, event_id string")
    summary = spark.createDataFrame([("s", "a.py b.py c.py d.py e.py f.py late.py")], "session_id string, summary string")
    got = {r["path"]: r["verdict"] for r in experiments.kept_views(d, gone, summary).collect()}
    assert got == {"src/a.py": "kept", "src/b.py": "edited_since", "src/c.py": "over_read_cap", "src/d.py": "dir_view", "src/e.py": "edited_since", "src/f.py": "no_observation", "src/g.py": "not_in_summary", "src/late.py": "latest_in_context"}
    many = spark.createDataFrame([("s", f"v{i}", i, f"f{i}.py", True, False, None, "x" * n) for i, n in enumerate((5, 15_000, 15_000, 12_000, 3, 4, 5))], d.schema)
    gone = many.select("session_id", "event_id")
    names = spark.createDataFrame([("s", " ".join(f"f{i}.py" for i in range(7)))], "session_id string, summary string")
    assert {r["event_id"] for r in experiments.kept_views(many, gone, names).filter("verdict = 'kept'").collect()} == {"v6", "v5", "v4", "v3"}


def test_samples_keep_no_session_above_its_share(spark):
    items = spark.createDataFrame([("x", "big", f"b{i}") for i in range(50)] + [("x", f"s{i}", f"t{i}") for i in range(6)] + [("y", "one", "u")], "slice string, session_id string, item_id string")
    got = experiments.round_robin(items, {"x": 20, "y": 5, "z": 3}).collect()
    n = sum(r["slice"] == "x" for r in got)
    assert sum(r["session_id"] == "big" for r in got) <= 0.4 * n and n == 10 and sum(r["slice"] == "y" for r in got) == 1


def test_statistics_for_any_number_of_clusters():
    small = metrics.Clusters([3, -1, 2, 4], [5, 5, 5, 5])
    low, high = small.interval()
    assert low <= small.delta <= high and (small.p() > 0.05) == (low <= 0 <= high)
    wide = metrics.Clusters([1.0] * 40, [2] * 40)
    assert wide.p() < 0.01 or wide.se == 0
    assert metrics.Clusters([0, 0], [1, 1]).p() == 1.0
    assert abs(metrics.mcnemar_p(3, 10) - 0.092285) < 1e-6 and 0 < metrics.mcnemar_p(500_000, 501_000) < 1


def test_ancestry_is_breadth_first_and_capped(spark):
    links = spark.createDataFrame([("s", 9, 7, 1), ("s", 9, 3, 2), ("s", 7, 1, 1), ("s", 7, 2, 2), ("s", 3, 2, 1), ("s", 3, 0, 2)], "session_id string, idx long, parent long, rank int")
    anchors = spark.createDataFrame([("s", 9)], "session_id string, anchor long")
    got = {r["idx"]: r["place"] for r in weave.ancestry(links, anchors).collect()}
    assert got == {9: 0, 7: 1, 3: 2, 1: 3, 2: 4}
    assert {r["idx"] for r in weave.ancestry(links, anchors, 2).collect()} == {9, 7}
    steps = spark.createDataFrame([("s", i, "passed", f"a{i}", f"o{i}") for i in range(6)] + [("t", 0, None, None, None)], "session_id string, idx long, validation string, action string, observation string")
    out = {r["session_id"]: (r["context"], r["n_full"]) for r in weave.woven(steps, steps.filter("idx = 5 and session_id = 's'")).collect()}
    assert out["s"][1] == 1 and out["s"][0].count(weave.PLACEHOLDER) == 5 and out["s"][0].endswith("observation: o5") and out["t"][1] == 1
    with pytest.raises(ValueError):
        weave.engaged(steps.filter("session_id = 's'"), spark.createDataFrame([("u", "tool_call")] * 20, "session_id string, kind string"))


def test_failed_steps_are_no_parents(spark):
    steps = spark.createDataFrame([("s", 0, "failed"), ("s", 1, "passed"), ("s", 2, "unknown"), ("s", 3, "passed")], "session_id string, idx long, validation string")
    scores = spark.createDataFrame([("s", 3, 0, 9), ("s", 3, 1, 5), ("s", 3, 2, 5), ("s", 2, 1, 0)], "session_id string, idx long, parent long, score long")
    assert [(r["parent"], r["rank"]) for r in weave.parents(scores, steps).orderBy("rank").collect()] == [(2, 1), (1, 2)]


def test_routers_by_name(spark):
    for wrong in ({"k": 0}, {"nothing": 1}, {"lexical_weight": -1.0}, {"k": True}):
        with pytest.raises(ValueError):
            retrieval.router_config(**wrong)
    with pytest.raises(ValueError):
        retrieval.make_router("other")
    docs = spark.createDataFrame([(1, "red cat"), (2, "blue dog"), (3, None)], "doc_id long, text string")
    q = spark.createDataFrame([(7, "a red cat")], "query_id long, query string")
    for name in ("lexical", "dense", "hybrid"):
        got = [r["doc_id"] for r in retrieval.make_router(name, k=2)(docs, q).orderBy("rank").collect()]
        assert got[0] == 1 and len(got) == 2
    a, b = retrieval.hashing_embed(["red cat red", ""])
    assert abs(sum(x * x for x in a) - 1) < 1e-9 and not any(b) and a == retrieval.hashing_embed(["RED red cat"])[0] != retrieval.hashing_embed(["red red cat"], seed=1)[0]
    with pytest.raises(Exception, match="vectors"):
        retrieval.embedded(docs, ["doc_id"], lambda xs: [[1.0]] * (len(xs) + 1)).collect()


def test_identifier_chase_walks_one_hop_a_round(spark):
    texts = ["apply plan key A9F3B2C1 now", "plan A9F3B2C1 made from record id 77ZX41Q9", "record 77ZX41Q9 holds the port", "nothing here", "A9F3B2C1 again"]
    ev = spark.createDataFrame([("s", f"e{i}", i, t) for i, t in enumerate(texts)], "session_id string, event_id string, pos long, text string")
    seeds = spark.createDataFrame([("q", "s", "e0")], "query_id string, session_id string, event_id string")
    q = spark.createDataFrame([("q", "which port does the plan use")], "query_id string, query string")
    got = {r["event_id"]: r["round"] for r in retrieval.identifier_chase(seeds, q, ev).collect()}
    assert got == {"e0": 0, "e1": 1, "e4": 1, "e2": 2}
