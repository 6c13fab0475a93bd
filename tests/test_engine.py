import random

from pyspark.sql import functions as F

from packetloom.functions import text as T
from packetloom.operators import closure, events, graph, metrics, packing, retrieval


def trace(spark, rows):
    """rows: (event_id, kind, ts, text, call id)"""
    return spark.createDataFrame([("s", *r, None, "clash") for r in rows], "session_id string, event_id string, kind string, ts long, text string, tool_call_id string, received_at timestamp, pos2 string")


CROSSED = [("e1", "tool_call", 1, "A", "a"), ("e2", "tool_call", 2, "B", "b"), ("e3", "tool_call", 3, "C", "c"), ("e4", "tool_result", 4, "rc", "c"), ("e5", "tool_result", 5, "ra", "a"), ("e6", "tool_result", 6, "rb", "b"), ("e7", "tool_result", 7, "stray", "zz")]


def test_results_pair_by_id_not_by_order(spark):
    ev = events.canonical(trace(spark, CROSSED + CROSSED[:2]))
    assert {(r["src_id"], r["dst_id"]) for r in events.result_of(ev).collect()} == {("e4", "e3"), ("e5", "e1"), ("e6", "e2")}
    assert sorted(r["pos"] for r in ev.collect()) == list(range(7))


def test_canonical_order_with_null_and_equal_times(spark):
    ev = events.canonical(trace(spark, [("b", "user", 5, None, None), ("a", "user", 5, "", None), ("c", "user", None, "x", None)]))
    assert [r["event_id"] for r in ev.orderBy("pos").collect()] == ["c", "a", "b"]
    assert events.canonical(trace(spark, [])).count() == 0


def test_supersedes_and_latest_state(spark):
    w = lambda i, t, p: (i, "tool_call", t, f'Write {{"file_path": "{p}"}}', None)
    e = events.supersedes(events.canonical(trace(spark, [w("w1", 1, "a.py"), w("w2", 2, "b.py"), w("w3", 3, "a.py"), w("w4", 4, "a.py")])))
    assert {(r["src_id"], r["dst_id"]) for r in e.collect()} == {("w3", "w1"), ("w4", "w3")}
    ev = events.canonical(trace(spark, [w("w1", 1, "a.py"), w("w2", 2, "b.py"), w("w3", 3, "a.py"), w("w4", 4, "a.py")]))
    assert {(r["event_id"], r["latest_id"], r["on_cycle"]) for r in graph.latest_state(ev, e).collect()} == {("w1", "w4", False), ("w3", "w4", False)}
    fork = spark.createDataFrame([("s", "w2", "w1", "SUPERSEDES", None), ("s", "w3", "w1", "SUPERSEDES", None), ("s", "x", "y", "SUPERSEDES", None), ("s", "y", "x", "SUPERSEDES", None)], e.schema)
    assert {(r["event_id"], r["latest_id"], r["on_cycle"]) for r in graph.latest_state(ev, fork).collect()} == {("w1", "w3", False), ("x", None, True), ("y", None, True)}


def test_summary_materializes_events_since_the_previous_one(spark):
    rows = [("a", "user", 1, "", None), ("s1", "summary", 2, "", None), ("b", "user", 3, "", None), ("c", "assistant", 4, "", None), ("s2", "summary", 5, "", None), ("d", "user", 6, "", None)]
    ev = events.canonical(trace(spark, rows))
    assert {(r["src_id"], r["dst_id"]) for r in events.materializes(ev).collect()} == {("s1", "a"), ("s2", "b"), ("s2", "c")}
    ev = ev.withColumn("meta", F.lit(None).cast("map<string,string>"))
    assert {r["event_id"] for r in graph.in_context(ev, events.materializes(ev)).collect()} == {"s2", "d"}
    listed = events.materializes(ev).filter("dst_id <> 'c'")  # what the last summary does not list stays in context
    assert {r["event_id"] for r in graph.in_context(ev, listed).collect()} == {"c", "s2", "d"}


def test_compaction_boundaries_gaps_and_preserved_ids(spark):
    rows = spark.createDataFrame([("s", 3, "system", "compact_boundary", ["u2"]), ("s", 10, "system", "compact_boundary", None), ("s", 20, "system", "compact_boundary", None)], "session_id string, line_no long, type string, subtype string, preserved array<string>")
    ev = spark.createDataFrame([("s", f"e{n}", n, f"u{n}", "summary" if n in (5, 14, 21) else "user") for n in (1, 2, 4, 5, 6, 14, 15, 19, 21, 30)], "session_id string, event_id string, line_no long, native_ref string, kind string")
    got = {(r["src_id"], r["dst_id"]) for r in events.native_materializes(rows, ev).collect()}
    assert got == {("e5", "e1"), ("e21", "e15"), ("e21", "e19")}  # line 14 is too far from its boundary


def test_problems_carriers_and_restriction(spark):
    ev = spark.createDataFrame([("s", "a", 0, "user"), ("s", "b", 1, "decision"), ("s", "b", 1, "decision")], "session_id string, event_id string, pos long, kind string")
    e = spark.createDataFrame([("s", "a", "b", "DEPENDS_ON", None), ("s", "b", "gone", "DEPENDS_ON", None), ("s", "a", "a", "CONTROL", None)], "session_id string, src_id string, dst_id string, edge_type string, predicate string")
    assert {(r["event_id"], r["problem"]) for r in graph.problems(ev, e).collect()} == {("b", "duplicate"), ("gone", "no target"), ("a", "self")}
    try:
        graph.check(ev, e)
    except ValueError:
        pass
    else:
        raise AssertionError
    left, edges = graph.restrict(ev, e, ev.filter("kind = 'decision'"))
    assert [r["event_id"] for r in left.collect()] == ["a"] and edges.count() == 1
    assert {r["event_id"] for r in graph.carriers(ev, e).collect()} == {"b"}


def test_fifo_with_underflow(spark):
    rows = [(0, "r"), (1, "c"), (2, "c"), (3, "r"), (4, "r"), (5, "r"), (6, "c"), (7, "r")]
    d = spark.createDataFrame([("u", i, k) for i, k in rows], "u string, i int, k string")
    got = {(r["r"]["i"], r["c"]["i"]) for r in events.fifo_pairs(d, ["u"], ["i"], F.col("k") == "c", F.col("k") == "r").collect()}
    assert got == {(3, 1), (4, 2), (7, 6)}


def test_closure_stops_at_max_hops_and_loops(spark):
    e = spark.createDataFrame([("s", f"n{i}", f"n{i + 1}", "DEPENDS_ON", None) for i in range(10)] + [("s", "n3", "n0", "DEPENDS_ON", None), ("s", "n0", "x", "TEMPORAL", None)], "session_id string, src_id string, dst_id string, edge_type string, predicate string")
    seeds = spark.createDataFrame([("s", "q", "n0")], "session_id string, seed_set string, event_id string")
    got = {r["event_id"]: r["hop"] for r in closure.native(e, seeds, 6).collect()}
    assert got == {f"n{i}": i for i in range(7)}


def test_first_fit_never_exceeds_budget_and_skips(spark):
    r = random.Random(3)
    items = [("g%d" % (i % 3), i, r.choice([1, 5, 40, 90, None])) for i in range(90)]
    d = spark.createDataFrame(items, "g string, i int, cost int")
    for budget in (0, 1, 46, 200):
        got = packing.first_fit(d, ["g"], ["i"], "cost", budget).collect()
        for g in ("g0", "g1", "g2"):
            used, keep = 0, []
            for _, i, c in sorted(x for x in items if x[0] == g):
                if used + (c or 0) <= budget:
                    used += c or 0
                    keep.append(i)
            assert sorted(x["i"] for x in got if x["g"] == g) == keep


def test_segments_and_tail(spark):
    d = spark.createDataFrame([("g", i, 10) for i in range(7)], "g string, i int, cost int")
    assert [r["segment"] for r in packing.segments(d, ["g"], ["i"], "cost", 25).orderBy("i").collect()] == [0, 0, 0, 1, 1, 1, 2]
    assert sorted(r["i"] for r in packing.tail(d, ["g"], ["i"], "cost", 30).collect()) == [4, 5, 6]


def test_bm25_and_dense_edge_cases(spark):
    docs = spark.createDataFrame([(1, "red fox"), (2, ""), (3, None), (4, "red red"), (4, "red red")], "doc_id long, text string")
    q = spark.createDataFrame([("q", "red"), ("none", "zzz"), ("nil", None)], "query_id string, query string")
    s = retrieval.bm25(docs, q, ["doc_id"]).collect()
    assert {r["doc_id"] for r in s} == {1, 4} and {r["query_id"] for r in s} == {"q"}
    v = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 2.0]), (3, None), (4, [3.0, 3.0])], "vec_id long, embedding array<float>")
    got = [(r["vec_id"], r["score"]) for r in retrieval.dense(v, v.filter("vec_id = 1"), 2).orderBy("rank").collect()]
    assert got == [(1, 1.0), (4, 0.707107)]
    assert retrieval.dense(v, v.filter("vec_id = 9"), 2).count() == 0


def test_text_functions(spark):
    d = spark.createDataFrame([("see a/b.py and 1.2", "a/b.py"), ("xa/b.py", "a/b.py"), (None, "v")], "t string, v string")
    assert [r[0] for r in d.select(T.contains_value(F.col("t"), F.col("v"))).collect()] == [True, False, None]
    one = spark.createDataFrame([("api_key = abcdefgh12 é😀",)], "t string")
    assert one.select(T.redacted(F.col("t"))).first()[0] == "api_key = [redacted] é😀"
    assert one.select(T.tokens_floor(F.col("t")), T.tokens_bytes(F.col("t"))).first()[:] == (5, 7)


def test_metrics(spark):
    assert metrics.mcnemar_p(0, 0) == 1.0 and round(metrics.mcnemar_p(1, 9), 6) == 0.021484
    d = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "b"), ("b", None)], "t string, g string")
    got = {r["label"]: (r["tp"], r["fp"], r["fn"]) for r in metrics.confusion(d, "t", "g").collect()}
    assert got == {"a": (1, 0, 1), "b": (1, 1, 1)}
    w = metrics.wild_cluster([(5.0, 10), (6.0, 10), (7.0, 12), (4.0, 9), (5.5, 10), (6.5, 11)])
    assert w["delta"] > 0 and w["p"] == 2 / 64


def test_every_twentieth_document_is_a_query(spark, tmp_path):
    import math
    import re

    from packetloom.plans import reference_queries

    words = "red green blue cat dog tree house river stone cloud".split()
    texts = {i: " ".join(words[(i * k + k) % 10] for k in range(1, 3 + i % 5)) for i in range(60)} | {40: None, 7: ""}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    terms = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t in texts.items()}
    n, avg = len(terms), sum(map(len, terms.values())) / len(terms)

    def score(q, d):
        s = 0
        for t in terms[q]:
            df, tf = sum(t in x for x in terms.values()), terms[d].count(t)
            s += math.log(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(terms[d]) / avg))
        return round(s, 6)

    got = {(r["query_id"], r["rank"]): (r["doc_id"], r["score"]) for r in reference_queries.bm25_documents(spark, str(tmp_path)).collect()}
    want = {}
    for q in (0, 20, 40):
        best = sorted((-score(q, d), d) for d in terms if set(terms[q]) & set(terms[d]))[:8]
        want |= {(q, k): (d, -s) for k, (s, d) in enumerate(best)}
    assert {k: v[0] for k, v in got.items()} == {k: v[0] for k, v in want.items()}
    assert all(abs(got[k][1] - want[k][1]) < 2e-6 for k in want)
    assert {r["query_id"] for r in reference_queries.hybrid_documents(spark, str(tmp_path)).collect()} == {0, 20}


def test_fused_documents_without_full_lists(spark, tmp_path, monkeypatch):
    """The same rows as from both full lists, for several block counts, also where a rank in one list is far behind."""
    import random

    from packetloom.plans import reference_queries

    rng = random.Random(5)
    words = [f"w{i}" for i in range(300)]
    texts = {i: " ".join(rng.choice(words[: rng.choice([4, 300])]) for _ in range(rng.randint(1, 40))) for i in range(400)}
    texts |= {i: " ".join(["w0 w1 w2 w3"] * 3 + rng.choices(words[4:], k=60)) for i in range(101, 220)}  # many words of document 0, among others
    texts |= {i: " ".join(rng.sample(words[:4], 3)) for i in range(220, 340)}  # nearly document 0
    texts |= {0: "W0 w1 w2-w3", 20: None, 40: "", 60: "é!", 80: "w1 w1 w2", 81: "w1 w1 w2", 33: "Nothing Shared"}
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    q = docs.filter("doc_id % 20 = 0").select(docs.doc_id.alias("query_id"), docs.text.alias("query"))
    v = retrieval.embedded(docs, ["doc_id"]).withColumnRenamed("doc_id", "vec_id")
    lex, den = retrieval.search(docs, q, "doc_id", 400), retrieval.dense(v, v.filter("vec_id % 20 = 0"), 400).withColumnRenamed("vec_id", "doc_id")
    want = retrieval.fuse([(lex, 1.0), (den, 1.0)], ["doc_id"], 8).collect()
    ranks = {(r["query_id"], r["doc_id"]): r["rank"] for r in lex.collect()} | {(r["query_id"], r["doc_id"], "den"): r["rank"] for r in den.collect()}
    assert len(want) == 20 * 8 and any(max(ranks[r["query_id"], r["doc_id"]], ranks[r["query_id"], r["doc_id"], "den"]) > 100 for r in want)
    for blocks in (1, 3, 7):
        assert sorted(retrieval.hybrid(docs, q, "doc_id", 8, blocks=blocks).collect()) == sorted(want), blocks
    monkeypatch.delattr(retrieval, "_blocked")  # it holds a block's list for every query at once
    got = reference_queries.hybrid_documents(spark, str(tmp_path)).collect()
    assert sorted(got) == sorted(r for r in want if r["query_id"] not in (20, 40, 60))
