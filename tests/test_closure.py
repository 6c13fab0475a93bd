"""Closure on small graphs whose results are known."""

from packetloom.operators import closure

EDGE = "session_id string, src_id string, dst_id string, edge_type string, predicate string, provenance string"


def run(spark, events, edges, seeds, mode="why", query="why did we do that", closure_mode="native", verify=None, gold=None, **kw):
    """events: (id, kind, text); edges: (src, dst, type[, predicate]). Returns required, optional, steps, relaxations."""
    ev = spark.createDataFrame([("s", i, n, k, t) for n, (i, k, t) in enumerate(events)], "session_id string, event_id string, pos long, kind string, text string")
    e = spark.createDataFrame([("s", a, b, t, (p or [None])[0], "native") for a, b, t, *p in edges], EDGE)
    q = spark.createDataFrame([("q", "s", query, mode, "m1", "chat")], "query_id string, session_id string, query string, query_mode string, model_id string, readout string")
    s = spark.createDataFrame([("q", i) for i in seeds], "query_id string, event_id string")
    if verify is not None:
        kw["verifications"] = spark.createDataFrame([("s", *verify)], "session_id string, carrier_id string, predicate string, model_id string, construction string, readout string")
    if gold is not None:
        kw["oracle"] = spark.createDataFrame([("q", g) for g in gold], "query_id string, event_id string")
    nodes, steps = closure.close(q, s, ev, e, closure_mode, **kw)
    rows = nodes.collect()
    tier = lambda t: {r["event_id"] for r in rows if r["tier"] == t}
    assert len(rows) == len({r["event_id"] for r in rows})
    return tier("required"), tier("optional"), {(r["child_id"], r["parent_id"], r["rule"]) for r in steps.collect()}, {(r["carrier_id"], r["predicate"]) for r in closure.relaxations(nodes, steps).collect()}


CHAIN = [("u1", "user", ""), ("tc1", "tool_call", ""), ("tr1", "tool_result", ""), ("d1", "decision", ""), ("noise1", "assistant", "")]
CHAIN_EDGES = [("tr1", "tc1", "RESULT_OF"), ("d1", "tr1", "DEPENDS_ON"), ("d1", "u1", "GROUNDED_IN"), ("tc1", "u1", "CONTROL"), ("noise1", "d1", "TEMPORAL")]


def test_tool_chain(spark):
    need, extra, steps, _ = run(spark, CHAIN, CHAIN_EDGES, ["d1"])
    assert need == {"u1", "tc1", "tr1", "d1"} and not extra
    assert steps == {("d1", "tr1", closure.WHY_SOURCES), ("d1", "u1", closure.WHY_SOURCES), ("tr1", "tc1", closure.TOOL_RESULT)}
    need, extra, _, _ = run(spark, CHAIN, CHAIN_EDGES, ["d1"], mode="lookup")
    assert need == {"d1"} and extra == {"u1", "tr1", "tc1"}
    need, extra, _, _ = run(spark, CHAIN, CHAIN_EDGES, ["d1"], mode="lookup", follow_optional=False)
    assert need == {"d1"} and extra == {"u1", "tr1"}


def test_other_modes(spark):
    assert run(spark, CHAIN, CHAIN_EDGES, ["d1", "unknown"], closure_mode="off")[:2] == ({"d1"}, set())
    assert run(spark, CHAIN, CHAIN_EDGES, ["d1"], closure_mode="all")[0] == {x[0] for x in CHAIN}
    need, _, steps, _ = run(spark, CHAIN, CHAIN_EDGES, ["d1", "tr1"], closure_mode="oracle", gold=["u1"])
    assert need == {"d1", "tr1", "u1"} and steps == {("tr1", "u1", closure.ORACLE)}
    assert run(spark, CHAIN, CHAIN_EDGES, ["d1"], closure_mode="full_ancestor", mode="lookup")[0] == {"u1", "tc1", "tr1", "d1"}


STATES = [("s_a", "state", ""), ("s_b", "state", ""), ("s_c", "state", ""), ("bystander", "assistant", "")]


def test_state_prefers_latest(spark):
    edges = [("s_b", "s_a", "SUPERSEDES"), ("s_c", "s_b", "SUPERSEDES"), ("bystander", "s_c", "TEMPORAL")]
    need, extra, steps, _ = run(spark, STATES, edges, ["s_a"], mode="state")
    assert need == {"s_c"} and extra == {"s_a", "s_b"} and steps == {("s_a", "s_c", closure.STATE_LATEST)}
    assert run(spark, STATES, edges, ["s_a"])[0] == {"s_a"}  # only a question about the state moves it
    fork = [("s_b", "s_a", "SUPERSEDES"), ("s_c", "s_a", "SUPERSEDES")]
    need, extra, _, _ = run(spark, STATES, fork, ["s_a", "s_b"], mode="state")
    assert need == {"s_c"} and extra == {"s_a", "s_b"}
    loop = [("s_b", "s_a", "SUPERSEDES"), ("s_c", "s_b", "SUPERSEDES"), ("s_a", "s_c", "SUPERSEDES")]
    need, extra, steps, _ = run(spark, STATES, loop, ["s_a"], mode="state")
    assert need == {"s_a"} and steps == {("s_a", "s_a", closure.CYCLE_GUARD)}


CARRIER = [("src1", "tool_result", ""), ("car1", "summary", ""), ("dec2", "decision", "")]
CARRIER_EDGES = [("car1", "src1", "MATERIALIZES", "vendor_price"), ("dec2", "car1", "DEPENDS_ON")]


def test_carriers_need_a_match_of_all_fields(spark):
    good = ("car1", "vendor_price", "m1", "native", "chat")
    assert run(spark, CARRIER, CARRIER_EDGES, ["dec2"])[0] == {"src1", "car1", "dec2"}
    need, extra, steps, freed = run(spark, CARRIER, CARRIER_EDGES, ["dec2"], verify=good)
    assert need == {"car1", "dec2"} and extra == {"src1"} and freed == {("car1", "vendor_price")} and ("car1", "src1", closure.VERIFIED) in steps
    for i in range(5):
        wrong = tuple(x + "x" if i == k else x for k, x in enumerate(good))
        need, _, _, freed = run(spark, CARRIER, CARRIER_EDGES, ["dec2"], verify=wrong)
        assert "src1" in need and not freed
    need, _, steps, _ = run(spark, CARRIER, CARRIER_EDGES, ["car1"], mode="lookup", query="exact price", verify=good)
    assert "src1" in need and ("car1", "src1", closure.EXACT_PAYLOAD) in steps


def test_depth_loops_and_caps(spark):
    deep = [(f"ch{i:02d}", "decision" if not i else "tool_result", "") for i in range(10)]
    need, _, steps, _ = run(spark, deep, [(f"ch{i:02d}", f"ch{i + 1:02d}", "DEPENDS_ON") for i in range(9)], ["ch00"])
    assert need == {f"ch{i:02d}" for i in range(7)} and ("ch06", "ch07", closure.TRUNCATED) in steps
    ring = [("a", "decision", ""), ("b", "decision", ""), ("c", "decision", "")]
    assert run(spark, ring, [("a", "b", "DEPENDS_ON"), ("b", "c", "DEPENDS_ON"), ("c", "a", "DEPENDS_ON")], ["a"])[0] == {"a", "b", "c"}
    wide = [(f"x{i}", "tool_result", f"text {'alpha' if i == 3 else ''} {'alpha beta' if i == 4 else ''}") for i in range(5)] + [("sum", "summary", "")]
    need, extra, steps, _ = run(spark, wide, [("sum", f"x{i}", "MATERIALIZES", "p") for i in range(5)], ["sum"], query="alpha and beta", carrier_cap=2)
    assert need == {"sum", "x3", "x4"} and extra == {"x0", "x1", "x2"} and {p for _, p, r in steps if r == closure.CAPPED} == {"x0", "x1", "x2"}
