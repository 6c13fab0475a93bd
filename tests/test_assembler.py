"""Packets on small graphs whose results are known."""

import random

import pytest

from packetloom.operators import assembler, closure
from packetloom.operators.assembler import Packing

EDGE = "session_id string, src_id string, dst_id string, edge_type string, predicate string, provenance string"


def run(spark, events, edges, seeds, budgets, p=Packing(), mode="why", query="q"):
    """events: (id, kind, ts, cost, group, text); one query a budget."""
    ev = spark.createDataFrame([("s", i, n, k, t, c, g, x) for n, (i, k, t, c, g, x) in enumerate(events)], "session_id string, event_id string, pos long, kind string, ts long, cost long, atomic_group string, text string")
    e = spark.createDataFrame([("s", a, b, t, None, "native") for a, b, t in edges], EDGE)
    q = spark.createDataFrame([(f"q{b}", "s", query, mode, b) for b in budgets], "query_id string, session_id string, query string, query_mode string, budget long")
    s = spark.createDataFrame([(f"q{b}", i, r, "lexical", pin) for b in budgets for i, r, pin in seeds], "query_id string, event_id string, rank int, source string, pinned boolean")
    nodes, steps = closure.close(q, s, ev, e)
    entries, packets = assembler.assemble(q, s, nodes, steps, ev, p)
    got = {b: {} for b in budgets}
    for r in packets.collect():
        got[int(r["query_id"][1:])] = r.asDict()
        assert r["total_tokens"] <= int(r["query_id"][1:])
    for r in entries.collect():
        got[int(r["query_id"][1:])].setdefault("served" if r["form"] else "left", {})[r["event_id"]] = (r["form"], r["reason"])
    return got


PAIR = [("call", "tool_call", 1, 12, "pair", "c"), ("res", "tool_result", 2, 24, "pair", "r"), ("dec", "decision", 3, 10, None, "d")]
PAIR_EDGES = [("res", "call", "RESULT_OF"), ("dec", "res", "DEPENDS_ON")]


def test_units_are_served_whole_or_not_at_all(spark):
    got = run(spark, PAIR, PAIR_EDGES, [("dec", 0, False)], [0, 9, 10, 45, 46])
    assert [sorted(got[b].get("served", {})) for b in (0, 9, 10, 45, 46)] == [[], [], ["dec"], ["dec"], ["call", "dec", "res"]]
    assert [got[b]["incomplete"] for b in (0, 9, 10, 45, 46)] == [True, True, True, True, False]
    assert got[45]["missing_required"] == ["call", "res"] and got[46]["context"] == "c\n\nr\n\nd" and got[46]["total_tokens"] == 46
    assert got[46]["served"]["dec"][1] == "seed:lexical" and got[46]["served"]["res"][1] == "closure:DEPENDS_ON" and got[46]["served"]["call"][1] == "closure:RESULT_OF"


def test_exact_fit_frontier_and_oversized(spark):
    ev = [("e_call", "tool_call", 1, 100, "e1", ""), ("e_mid", "tool_result", 2, 60, "e1", ""), ("e_root", "decision", 3, 40, None, "")]
    got = run(spark, ev, [("e_mid", "e_call", "RESULT_OF"), ("e_root", "e_mid", "DEPENDS_ON")], [("e_root", 0, False)], [199, 200])
    assert got[199]["incomplete"] and not got[200]["incomplete"]
    big = [("huge", "tool_result", 1, 100000, None, "x"), ("tiny", "decision", 2, 4, None, "y")]
    got = run(spark, big, [("tiny", "huge", "DEPENDS_ON")], [("tiny", 0, False)], [2048])
    assert got[2048]["missing_required"] == ["huge"] and list(got[2048]["served"]) == ["tiny"]
    deep = [(f"ch{i:02d}", "decision" if not i else "tool_result", 10 - i, 3, None, "z") for i in range(10)]
    got = run(spark, deep, [(f"ch{i:02d}", f"ch{i + 1:02d}", "DEPENDS_ON") for i in range(9)], [("ch00", 0, False)], [2048])
    assert got[2048]["missing_required"] == ["ch07"] and got[2048]["incomplete"]


def test_header_notes_and_orders(spark):
    got = run(spark, PAIR, PAIR_EDGES, [("dec", 0, False)], [2, 60], Packing(header="about these records"))
    assert got[2]["incomplete"] and got[2]["context"] == "" and got[60]["context"].startswith("about these records\n\nc") and got[60]["total_tokens"] == 46 + 7
    got = run(spark, PAIR, PAIR_EDGES, [("dec", 0, False)], [46], Packing(order="seed_first"))
    assert got[46]["context"] == "d\n\nc\n\nr"
    got = run(spark, PAIR, PAIR_EDGES, [("dec", 0, False)], [45], Packing(declare_omissions=True))
    assert got[45]["context"].endswith("2 record(s), call, res") and got[45]["total_tokens"] > 10


def test_evidence_comes_first_within_its_share(spark):
    ev = [("src", "tool_result", 1, 500, None, "s"), ("d0", "assistant", 9, 300, None, "0"), ("d1", "assistant", 10, 300, None, "1"), ("sum", "summary", 8, 100, None, "m"), ("old", "user", 2, 10, None, "o")]
    edges = [("d1", "src", "DEPENDS_ON"), ("sum", "old", "MATERIALIZES")]
    seeds = [("d0", 0, False), ("d1", 1, False), ("sum", 2, False)]
    plain = run(spark, ev, edges, seeds, [900], Packing(pack="chrono"))[900]
    first = run(spark, ev, edges, seeds, [900], Packing(pack="evidence_first", cost_order=False, excerpt=False))[900]
    share = run(spark, ev, edges, seeds, [900], Packing(pack="evidence_first", cost_order=False, excerpt=False, evidence_share=0.5))[900]
    assert "src" not in plain["served"] and "src" in first["served"] and "d0" in first["served"] and "d1" not in first["served"]
    assert "src" not in share["served"] and {"d0", "d1"} <= set(share["served"])


@pytest.mark.parametrize("pack", ["chrono", "bundle", "tiered", "evidence_first"])
def test_random_graphs_keep_the_contract(spark, pack):
    r = random.Random(pack)
    kinds = ["user", "assistant", "tool_call", "tool_result", "decision", "summary"]
    ev = [(f"e{i:02d}", r.choice(kinds), r.randint(1, 9), r.randint(1, 60), r.choice([None, None, f"g{i // 3}"]), "\n".join(f"line {k} of {i} word{r.randint(0, 9)}" for k in range(r.randint(1, 12)))) for i in range(24)]
    edges = [(f"e{a:02d}", f"e{b:02d}", r.choice(["DEPENDS_ON", "RESULT_OF", "MATERIALIZES", "GROUNDED_IN", "TEMPORAL"])) for a in range(1, 24) for b in [r.randrange(a)]]
    seeds = [(f"e{i:02d}", n, n == 2) for n, i in enumerate(r.sample(range(24), 4))]
    p = Packing(pack=pack, evidence_share=0.5)
    got = run(spark, ev, edges, seeds, [0, 1, 46, 199, 2048], p, query="word3 and word5")
    for b, packet in got.items():
        served, left = packet.get("served", {}), packet.get("left", {})
        assert not set(served) & set(left) and packet["n_entries"] == len(served)
        group = {i: g or i for i, _, _, _, g, _ in ev}
        assert not {group[i] for i in served} & {group[i] for i in left}
    assert got[2048]["n_entries"] >= got[199]["n_entries"]


def test_excerpts_are_labelled_and_hold_what_the_query_asks():
    lines = [f"noise number {i} here" for i in range(37)]
    lines[3], lines[5], lines[20] = "the port value is 8813", "secret 99", "a line that a later step quotes word by word"
    got = assembler.excerpts("\n".join(lines), {"port"}, [])
    assert got[0][0] == "excerpt[1-6/37]" and got[1][0] == "excerpt[1,4/37]" and "secret" not in got[1][1] and "...\nthe port" in got[1][1]
    quoted = assembler.excerpts("\n".join(lines), {"zzz"}, ["before a line that a later step quotes word by word after secret 99"])
    assert quoted[1][0] == "excerpt[1,21/37]" and assembler.excerpts("a\nb", {"a"}, []) == []
