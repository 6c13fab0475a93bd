import gzip
import json

from packetloom.sources import jsonl, normalize
from packetloom.streaming import compaction


def test_jsonl_scan_sniff_tail(spark, tmp_path):
    a = ['{"type":"session","version":1}', '{"type":"message","id":"m"}', '{"torn']
    (tmp_path / "a.jsonl").write_text("\n".join(a))
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write('\n{"type":"user","uuid":"u"}\n')
    lines = jsonl.read_lines(spark, str(tmp_path))
    assert lines.filter("file_path like '%a.jsonl'").count() == 3
    assert jsonl.parse(lines).count() == 3
    assert {r["file_path"].rsplit("/", 1)[1]: r["dialect"] for r in jsonl.sniff(lines).collect()} == {"a.jsonl": "pi", "b.jsonl.gz": "claude_code"}
    assert [r["line_no"] for r in jsonl.tail(lines.filter("file_path like '%a.jsonl'"), 40).orderBy("line_no").collect()] == [2, 3]


def test_byte_ranges_give_every_line_once(spark, tmp_path):
    text = [f"{i} " + "é" * (i % 37) for i in range(500)]
    p = tmp_path / "big.txt"
    p.write_text("\n".join(text))
    got = sorted((r["line_no"], r["raw"]) for r in jsonl.read_ranges(spark, [str(p)], chunk=777).collect())
    assert got == [(i + 1, t) for i, t in enumerate(text)]


def test_events_of_each_dialect(spark):
    c = spark.createDataFrame([("s", 1, "user", None, False, "user", "hi", None, "x"), ("s", 2, "assistant", None, False, "assistant", '[{"type":"tool_use","id":"t","name":"Read","input":{"b":1,"a":"é"}}]', None, "x"), ("s", 3, "user", None, True, "user", "side", None, "x")], "session_id string, line_no long, type string, isCompactSummary boolean, isSidechain boolean, role string, content string, received_at timestamp, uuid string").withColumn("ts", __import__("pyspark").sql.functions.lit(None).cast("timestamp"))
    e = {r["event_id"]: r for r in normalize.events_of(c, "claude_code").collect()}
    assert e["claude_code:00000002:000"]["text"] == 'Read {"a": "é", "b": 1}' and e["claude_code:00000002:000"]["atomic_group"] == "claude_code:tool:t"
    assert set(e) == {"claude_code:00000001:000", "claude_code:00000002:000"}
    assert list(normalize.oh_blocks("model", " ", None, [{"id": "c", "function": {"name": "think", "arguments": "{bad"}}]))[1] == ("tool_call", 'think {"_raw": "{bad"}', "c", {"tool": "think", "noop": "1"})
    assert [k for k, *_ in normalize.pi_blocks("message", "bashExecution", None, None, "ls", "out", None)] == ["tool_call", "tool_result"]


def test_streaming_compaction_and_resumable_sink(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("s", f"e{i}", i, 10) for i in range(7)], "session_id string, event_id string, ts long, cost int").coalesce(1).write.parquet(str(src))
    stream = spark.readStream.schema("session_id string, event_id string, ts long, cost int").parquet(str(src))
    q = compaction.compactions(stream, 25).writeStream.format("memory").queryName("segs").option("checkpointLocation", str(tmp_path / "cp")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [tuple(r) for r in spark.sql("select segment, n_events, tokens from segs order by segment").collect()] == [(0, 3, 30), (1, 3, 30)]
    d = spark.createDataFrame([("a", 1), ("b", 2)], "item string, x int")
    out = str(tmp_path / "out")
    assert compaction.append_new(d, out, ["item"]) == 2 and compaction.append_new(d, out, ["item"]) == 0
    assert {(r["item"], r["x"]) for r in compaction.last_records(spark.createDataFrame([("a", 1, 0), ("a", 2, 5)], "item string, x int, seq int"), "item", "seq").select("item", "x").collect()} == {("a", 2)}
    assert json.loads(next(p for p in (tmp_path / "out").glob("*.json") if p.stat().st_size).read_text().splitlines()[0])
