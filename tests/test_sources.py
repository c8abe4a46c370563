"""From files to tables: parsing, both dialects, deduplication, results, skills, merges, commits, exports, manifests."""

import datetime as dt
import json
import os

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.functions.exprs import Range
from sparklog.operators import shred
from sparklog.schemas import TABLES
from sparklog.sources import export, ingest, logs, merge, ranges, store


def cli(kind, n, session="s1", **more):
    return {"type": kind, "sessionId": session, "timestamp": f"2024-01-02T10:00:{n:02d}.000Z", **more}


def answer(n, request, blocks, session="s1", model="claude-opus-4-7", stop="end_turn", usage=None, **more):
    usage = usage or {"input_tokens": 10, "output_tokens": 20, "cache_creation_input_tokens": 100, "cache_read_input_tokens": 1000}
    return cli("assistant", n, session, requestId=request, uuid=f"a{n}", cwd="/w/p", gitBranch="main", version="1.0", message={"role": "assistant", "model": model, "stop_reason": stop, "usage": usage, "content": blocks}, **more)


def prompt(n, content, session="s1", **more):
    return cli("user", n, session, uuid=f"u{n}", message={"role": "user", "content": content}, **more)


LISTING = "- pdf: Reads files\n  and more\n- ns:tool: Does: things\n- bare:\norphan of bare\n"
LINES = [
    prompt(1, "Hello there"),
    answer(2, "r1", [{"type": "text", "text": "partial"}]),
    answer(3, "r1", [{"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "done"}, {"type": "text", "text": "twice"}, {"type": "tool_use", "id": "t1", "name": "Bash", "input": {"cmd": "ls"}}, {"type": "tool_use", "id": "t2", "name": "mcp__shop__buy", "input": {}}, {"type": "tool_use", "id": "t3", "name": "Skill", "input": {"skill": "pdf"}, "caller": {"type": "user"}}], parentUuid="u1"),
    prompt(4, [{"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": [{"type": "text", "text": "bad"}, {"type": "text", "text": "thing"}]}, {"type": "tool_result", "tool_use_id": "t2", "content": "ok"}, {"type": "tool_result", "tool_use_id": "lost", "is_error": True, "content": ""}]),
    answer(5, None, [{"type": "text", "text": "x" * 12000}], stop="max_tokens", model="unknown-model"),
    cli("attachment", 6, uuid="at", attachment={"type": "skill_listing", "content": LISTING, "skillCount": 3, "isInitial": True}),
    cli("queue-operation", 7), cli("progress", 8),
]


@pytest.fixture
def root(tmp_path):
    folder = tmp_path / "logs" / "-w-p"
    folder.mkdir(parents=True)
    body = [json.dumps(x) for x in LINES] + ["", "not json", '{"no": "type"}', '{"type": "user", "sess']
    (folder / "s1.jsonl").write_text("\n".join(body))
    (folder / "agent-9.jsonl").write_text(json.dumps(prompt(1, "other", "s2")))
    (folder / "empty.jsonl").write_text("")
    return str(tmp_path / "logs")


def test_scan_and_parse(spark, root):
    lines = logs.scan_cli_logs(spark, root)
    flags = {r["file_session"]: r["is_sub_agent"] for r in lines.collect()}
    assert flags == {"s1": False, "agent-9": True}
    numbers = [r["line_no"] for r in lines.filter("file_session = 's1'").orderBy("line_no").collect()]
    assert numbers == list(range(1, len(LINES) + 5))
    records, status = logs.parse_records(lines)
    metrics = {r["file_path"].rsplit("/", 1)[1]: r for r in logs.ingest_metrics(status).collect()}
    m = metrics["s1.jsonl"]
    assert (m["lines"], m["entries"], m["errors"], m["skipped"], m["blank"], m["duplicates"]) == (len(LINES) + 4, 7, 3, 1, 1, 1)
    assert logs.scan_cli_logs(spark, root, limit=1).select("file_path").distinct().count() == 1
    assert records.filter("type = 'user'").count() == 3


def test_tables_of_a_session(spark, root):
    tables = logs.shred_messages(logs.load_sources(spark, root))
    assert {n: df.schema.fieldNames() for n, df in tables.items()} == {n: s.fieldNames() for n, s in TABLES.items()}
    turns = {r["turn_id"]: r for r in tables["turns"].collect()}
    assert set(turns) == {"u1", "a3", "u4", "a5"}  # the last record of r1
    a3 = turns["a3"]
    assert a3["content_text"] == "done\ntwice" and a3["has_tool_use"] and a3["has_thinking"] and a3["cache_read_tokens"] == 1000
    assert abs(a3["cost_usd"] - (10 * 5 + 20 * 25 + 100 * 6.25 + 1000 * 0.5) / 1e6) < 1e-12
    assert turns["u1"]["content_text"] == "Hello there" and turns["u4"]["content_text"] is None and len(turns["a5"]["content_text"]) == 10000
    calls = {r["tool_call_id"]: r for r in tables["calls"].collect()}
    assert (calls["t1"]["success"], calls["t1"]["error_message"]) == (False, "bad\nthing")
    assert (calls["t2"]["success"], calls["t2"]["tool_type"], calls["t2"]["mcp_server"]) == (True, "mcp", "shop")
    assert (calls["t3"]["success"], calls["t3"]["skill_name"], calls["t3"]["skill_caller_type"]) == (None, "pdf", "user")
    errors = {r["error_id"]: r for r in tables["errors"].collect()}
    assert set(errors) == {"t1-toolerr", "lost-toolerr", "a5-stop"} and errors["lost-toolerr"]["message"] == "Tool call returned an error."
    assert errors["t1-toolerr"]["timestamp"] == dt.datetime(2024, 1, 2, 10, 0, 3) and errors["a5-stop"]["error_type"] == "max_tokens_truncation"
    skills = {r["skill_name"]: r["skill_description"] for r in tables["skills"].collect()}
    assert skills == {"pdf": "Reads files and more", "ns:tool": "Does: things", "bare": "orphan of bare"}
    sessions = {r["session_id"]: r for r in tables["sessions"].collect()}
    s1, s2 = sessions["s1"], sessions["s2"]
    assert (s1["num_turns"], s1["num_tool_calls"], s1["duration_seconds"], s1["model"], s1["project_path"], s1["project_name"]) == (4, 3, 4, "claude-opus-4-7", "/w/p", "p")
    assert (s2["num_turns"], s2["end_time"], s2["duration_seconds"], s2["model"]) == (1, None, None, None)


def test_audit_dialect(spark, tmp_path):
    folder = tmp_path / "a" / "sess1"
    (folder / "deep").mkdir(parents=True)
    row = {"type": "assistant", "session_id": "S", "_audit_timestamp": "2024-01-02T10:00:00Z", "uuid": "x1", "message": {"id": "m1", "model": "claude-sonnet-4-5", "usage": {"input_tokens": 5}, "content": "hi"}}
    (folder / "audit.jsonl").write_text("\n".join(map(json.dumps, [row, {**row, "uuid": "x2"}, {"type": "system:init"}, {"type": "tool_use_summary"}])))
    (folder / "deep" / "audit.jsonl").write_text(json.dumps({**row, "uuid": "x3"}))
    (tmp_path / "a" / "sess1.json").write_text(json.dumps({"title": "My work", "cwd": "/c/d", "userSelectedFolders": ["/f/g"]}))
    tables = logs.shred_messages(logs.load_sources(spark, audit_roots=[str(tmp_path / "a")]))
    turns = tables["turns"].collect()
    assert {t["turn_id"] for t in turns} == {"x1", "x2"} and {t["request_id"] for t in turns} == {"m1"}  # not deduplicated
    s = tables["sessions"].first()
    assert (s["session_id"], s["project_path"], s["project_name"], s["source_type"], s["cwd"]) == ("S", "My work", "My work (Desktop)", "desktop", "/c/d")


def test_greedy_listing_and_mismatch(spark):
    rows = spark.createDataFrame([("s", "u", dt.datetime(2024, 1, 1), "- a: b: c\n- d:", 3, True, "cli")], "session_id string, uuid string, timestamp timestamp_ntz, listing string, skill_count int, is_initial boolean, source string")
    assert [r["skill_name"] for r in shred.skill_listing(rows).collect()] == ["a", "d"]
    assert [(r["skill_name"], r["skill_description"]) for r in shred.skill_listing(rows, greedy=True).collect()] == [("a: b", "c"), ("d", None)]
    assert [(r["skill_count"], r["parsed"]) for r in shred.listing_mismatches(rows).collect()] == [(3, 2)]


def test_manifest(spark, root):
    lines = logs.scan_cli_logs(spark, root)
    manifest = spark.createDataFrame(logs.manifest_of(logs.parse_records(lines)[1]).select(*merge.MANIFEST.fieldNames()).collect(), merge.MANIFEST)
    path = f"{root}/-w-p/s1.jsonl"
    known = {os.path.basename(r["file_path"]): (r["last_line_number"], r["last_byte_offset"]) for r in manifest.collect()}
    broken = len('{"type": "user", "sess')  # without a line feed at the end: may still be written on
    assert known == {"s1.jsonl": (len(LINES) + 3, os.path.getsize(path) - broken), "agent-9.jsonl": (1, os.path.getsize(f"{root}/-w-p/agent-9.jsonl"))}
    assert logs.scan_cli_logs(spark, root, manifest=manifest).count() == 1  # the broken end, again
    with open(path, "a") as f:
        f.write('ion": 1}\n' + json.dumps(prompt(9, "later")))
    fresh = logs.scan_cli_logs(spark, root, manifest=manifest)
    got = [(r["line_no"], "later" in r["line"]) for r in fresh.orderBy("line_no").collect()]
    assert got == [(len(LINES) + 4, False), (len(LINES) + 5, True)]
    after = logs.manifest_of(logs.parse_records(fresh)[1], manifest)
    assert {os.path.basename(r["file_path"]): r["last_line_number"] for r in after.collect()} == {"s1.jsonl": len(LINES) + 5, "agent-9.jsonl": 1}
    assert logs.scan_cli_logs(spark, root, manifest=after).count() == 0


def test_a_grown_file_is_read_from_its_offset(spark, tmp_path):
    (tmp_path / "p").mkdir()
    big, other = tmp_path / "p" / "a b.jsonl", tmp_path / "p" / "other.jsonl"
    big.write_text("".join(f"line {k}\n" for k in range(50_000)))
    other.write_text("x\n" * 1000)
    files = lambda: ranges.log_files(spark, str(tmp_path), "*.jsonl")
    read = lambda manifest=None, block=ranges.BLOCK, count=None: ranges.read_lines(ranges.pending(files(), manifest), block, count)
    whole = read().withColumn("status", F.lit("entry"))
    manifest = spark.createDataFrame(logs.manifest_of(whole).select(*merge.MANIFEST.fieldNames()).collect(), merge.MANIFEST)
    added = "".join(f"more {k}\n" for k in range(1000))
    with open(big, "a") as f:
        f.write(added)
    bytes_read = spark.sparkContext.accumulator(0)
    fresh = sorted(read(manifest, count=bytes_read).collect(), key=lambda r: r["line_no"])
    assert [(r["line_no"], r["line"]) for r in fresh] == [(50_001 + k, f"more {k}") for k in range(1000)]
    assert bytes_read.value == len(added)
    in_blocks = spark.sparkContext.accumulator(0)
    again = sorted(read(manifest, 1000, in_blocks).collect(), key=lambda r: r["line_no"])
    assert [tuple(r) for r in again] == [tuple(r) for r in fresh]
    assert in_blocks.value < 3 * len(added) + 64 * 1024 * (len(added) // 1000 + 1)  # counted once, read once, and a little beyond each block


def test_numbers_of_split_files_without_moving_lines(spark, tmp_path):
    (tmp_path / "p").mkdir()
    text = "".join("y" * (k * 37 % 211) + ("\r\n" if k % 5 else "\n") for k in range(3000)) + "the end"
    (tmp_path / "p" / "f.jsonl").write_bytes(text.encode())
    (tmp_path / "p" / "g.jsonl").write_bytes(b"one\n\xff\xfe two\n")
    files = ranges.log_files(spark, str(tmp_path), "*.jsonl")
    for block in (97, 5000, ranges.BLOCK):
        lines = ranges.read_lines(ranges.pending(files), block)
        got = {(r["file_path"].rsplit("/", 1)[1], r["line_no"]): r["line"] for r in lines.collect()}
        want = {("f.jsonl", k + 1): line for k, line in enumerate(text.replace("\r\n", "\n").split("\n"))}
        assert got == want | {("g.jsonl", 1): "one", ("g.jsonl", 2): "\ufffd\ufffd two"}
        moved = [x.split("[")[-1] for x in lines._jdf.queryExecution().executedPlan().toString().splitlines() if "Exchange" in x]
        assert moved and not any("line#" in x for x in moved)
        assert lines.filter("NOT ended").count() == 1


def test_merges(spark):
    target = spark.createDataFrame([("a", "r1", 1), ("b", None, 2)], "turn_id string, request_id string, v int")
    batch = spark.createDataFrame([("c", "r1", 3), ("d", "r2", 4), ("e", "r2", 5), ("f", None, 6), ("g", None, 7), ("a", "r9", 8)], target.schema)
    assert {r["turn_id"] for r in merge.merge_absent(target, batch, ["turn_id", "request_id"]).collect()} == {"a", "b", "d", "f", "g"}
    latest = merge.merge_latest(target, spark.createDataFrame([("b", "x", 9)], target.schema), "turn_id")
    assert {r["turn_id"]: r["v"] for r in latest.collect()} == {"a": 1, "b": 9}
    known = shred.dedup_last(batch, "request_id", ["v"])
    assert {r["turn_id"] for r in known.collect()} == {"a", "c", "e", "f", "g"}


def day_store(spark, path):
    return store.Store(spark, path, {"t": T.StructType.fromDDL("id long, at timestamp_ntz")}, {"t": "at"})


def dated(spark, *rows):
    return spark.createDataFrame([(k, dt.datetime(2024, 1, day) if day else None) for k, day in rows], "id long, at timestamp_ntz")


def test_versions_replace_days_and_stay_readable(spark, tmp_path):
    kept = day_store(spark, str(tmp_path / "store"))
    assert kept.snapshot().version == -1 and kept.table("t", kept.snapshot()).count() == 0
    first = kept.transact(lambda at: {"t": store.Change(dated(spark, (1, 1), (2, 2), (3, None)))}, "app", 0)
    assert kept.transact(lambda at: {"t": store.Change(dated(spark, (9, 9)))}, "app", 0) == first  # the same batch again
    second = kept.transact(lambda at: {"t": store.Change(dated(spark, (4, 2)), ["2024-01-02"])}, "app", 1)
    ids = lambda at, **more: sorted(r["id"] for r in kept.table("t", at, **more).collect())
    assert ids(second) == [1, 3, 4] and ids(first) == [1, 2, 3] and ids(kept.snapshot(0)) == [1, 2, 3]
    assert ids(second, days=["2024-01-02"]) == [4] and ids(second, days=[store.NO_DAY]) == [3]
    untouched = {f for f in first.folders["t"] if "2024-01-02" not in f}
    assert untouched < second.folders["t"]
    third = kept.transact(lambda at: {"t": store.Change(dated(spark, (5, 1)))})
    packed = kept.compact("t")
    assert ids(packed) == ids(third) == [1, 3, 4, 5] and len(packed.folders["t"]) == 3 < len(third.folders["t"])
    assert kept.vacuum(packed.version) >= 1 and ids(kept.snapshot()) == [1, 3, 4, 5]
    with pytest.raises(ValueError):
        kept.snapshot(77)


def test_of_two_writers_one_retries(spark, tmp_path):
    one, other = day_store(spark, str(tmp_path / "store")), day_store(spark, str(tmp_path / "store"))
    seen = []

    def slow(at):
        seen.append(at.version)
        if len(seen) == 1:  # the other writer commits meanwhile
            other.transact(lambda at: {"t": store.Change(dated(spark, (7, 7)))})
        return {"t": store.Change(dated(spark, (100 + one.table("t", at).count(), 1)))}

    done = one.transact(slow)
    assert seen == [-1, 0] and done.version == 1
    assert sorted(r["id"] for r in one.table("t", one.snapshot()).collect()) == [7, 101]
    data = os.listdir(tmp_path / "store" / "data" / "t")
    assert len([d for d in data if not d.startswith(".")]) == 2  # nothing of the lost attempt
    with pytest.raises(store.VersionTaken):
        one.commit(store.Snapshot(), {})


def test_checkpoints_of_the_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "CHECKPOINT_EVERY", 3)
    kept = day_store(spark, str(tmp_path / "store"))
    for k in range(5):
        kept.transact(lambda at: {"t": store.Change(dated(spark, (k, 1 + k % 2)))})
    assert sorted(r["id"] for r in kept.table("t", kept.snapshot()).collect()) == [0, 1, 2, 3, 4]
    assert any(n.startswith("checkpoint-") for n in os.listdir(tmp_path / "store" / "log"))
    assert [len(kept.snapshot(v).folders["t"]) for v in range(5)] == [1, 2, 3, 4, 5]


def rows_of(kept, name):
    return sorted(map(repr, kept.table(name, kept.snapshot()).collect()))


def test_batches_of_a_log_add_up(spark, root, tmp_path):
    """A log read in two parts leaves the tables that one read leaves; results find calls of earlier parts."""
    path = f"{root}/-w-p/s1.jsonl"
    whole = ingest.log_store(spark, str(tmp_path / "whole"))
    records, status = logs.parse_records(logs.scan_cli_logs(spark, root))
    ingest.ingest_messages(whole, logs.deduplicated(logs.normalise_cli(records)), status)
    text = open(path).read()
    cut = text.index(json.dumps(LINES[3]))  # after the calls, before their results
    parts = ingest.log_store(spark, str(tmp_path / "parts"))
    for k, upto in enumerate((cut, len(text))):
        with open(path, "w") as f:
            f.write(text[:upto])
        records, status = logs.parse_records(logs.scan_cli_logs(spark, root, manifest=parts.table("manifest", parts.snapshot())))
        at = ingest.ingest_messages(parts, logs.deduplicated(logs.normalise_cli(records)), status, "test", k)
    for name in ("turns", "calls", "errors", "skills", "sessions"):
        assert rows_of(parts, name) == rows_of(whole, name), name
    manifest = lambda s: sorted((r["file_path"], r["last_byte_offset"], r["last_line_number"]) for r in s.table("manifest", s.snapshot()).collect())
    assert manifest(parts) == manifest(whole)
    assert at.version == 1 and parts.snapshot().batches == {"test": 1}


def test_exports(spark, tmp_path):
    turns = spark.createDataFrame([("t1", "s", dt.datetime(2024, 1, 1)), ("t2", "s", dt.datetime(2024, 2, 1))], "turn_id string, session_id string, timestamp timestamp_ntz")
    calls = spark.createDataFrame([("c1", "t1", "s", '{"a": "b,\\"c"}'), ("c2", "t2", "s", "{}")], "tool_call_id string, turn_id string, session_id string, parameters string")
    january = Range(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    assert [r["tool_call_id"] for r in export.in_period("calls", calls, january, turns).collect()] == ["c1"]
    assert export.in_period("turns", turns, january).count() == 1 and export.in_period("turns", turns, None).count() == 2
    for kind in ("parquet", "csv", "json"):
        export.export_table(calls, str(tmp_path / kind), kind)
    assert spark.read.option("header", True).option("escape", '"').csv(str(tmp_path / "csv")).orderBy("tool_call_id").first()["parameters"] == '{"a": "b,\\"c"}'
    assert spark.read.json(str(tmp_path / "json")).count() == spark.read.parquet(str(tmp_path / "parquet")).count() == 2
    with pytest.raises(ValueError):
        export.export_table(calls, str(tmp_path / "x"), "xml")


def test_rebuild_skills(spark):
    calls = spark.createDataFrame([("c1", None, None), ("c2", "kept", "user")], "tool_call_id string, skill_name string, skill_caller_type string")
    again = spark.createDataFrame([("c1", "pdf", "agent"), ("c2", "other", "agent")], calls.schema)
    skills = spark.createDataFrame([("k1",)], "session_skill_id string")
    filled, added = shred.rebuild_skills(calls, skills, again, spark.createDataFrame([("k1",), ("k2",)], skills.schema))
    assert {r["tool_call_id"]: r["skill_name"] for r in filled.collect()} == {"c1": "pdf", "c2": "kept"} and added.count() == 2
