"""Logs that grow while they are ingested: byte offsets, restarts, scans beside streams."""

import json
import random

import pyarrow as pa
import pytest

from sparklog.sources import ingest, logs
from sparklog.streaming import growing, live


@pytest.fixture
def small_steps(monkeypatch):
    monkeypatch.setattr(growing, "STEP", 7)
    monkeypatch.setattr(growing, "BEYOND", 3)


def test_each_line_is_in_the_range_of_its_line_feed(small_steps):
    rng = random.Random(4)
    for _ in range(400):
        data = b"".join(rng.choice([b"a" * rng.randint(0, 20), b"\n", b"bc\n", b"\n\n"]) for _ in range(rng.randint(0, 14)))
        cuts = sorted({0, len(data), *(rng.randint(0, len(data)) for _ in range(rng.randint(0, 5)))})
        got = []
        for start, stop in zip(cuts, cuts[1:]):
            for lines, at in growing.lines_ending(pa.BufferReader(data), start, stop):
                for line in lines:
                    got.append((at, line))
                    at += len(line) + 1
        want, at = [], 0
        for line in data.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


def row(n, session="s", **more):
    return json.dumps({"type": "user", "sessionId": session, "timestamp": f"2024-01-{1 + n // 60:02d}T10:{n % 60:02d}:00Z", "uuid": f"{session}{n}", "message": {"role": "user", "content": f"hi {n}"}} | more) + "\n"


def test_appended_lines_are_taken_once(spark, tmp_path):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    out, marks, root = str(tmp_path / "out"), str(tmp_path / "marks"), str(tmp_path / "logs")
    run = lambda: live.stream_ingest(spark, root, out, marks, block_bytes=300).awaitTermination()
    kept = ingest.log_store(spark, out)
    turns = lambda: sorted(r["turn_id"] for r in kept.table("turns", kept.snapshot()).collect())

    half = row(3)
    (folder / "a b.jsonl").write_text(row(1) + row(2) + half[:20])
    run()
    assert turns() == ["s1", "s2"]
    with open(folder / "a b.jsonl", "a") as f:  # the rest of the line, and more; each run is a restart
        f.write(half[20:] + row(4) + row(61))
    (folder / "other.jsonl").write_text(row(5, "t") + "broken {\n")
    run()
    run()  # nothing new
    assert turns() == ["s1", "s2", "s3", "s4", "s61", "t5"]
    sessions = {r["session_id"]: (r["num_turns"], r["duration_seconds"]) for r in kept.table("sessions", kept.snapshot()).collect()}
    assert sessions == {"s": (5, 86400), "t": (1, None)}
    manifest = {r["file_path"].rsplit("/", 1)[1]: (r["last_line_number"], r["last_byte_offset"]) for r in kept.table("manifest", kept.snapshot()).collect()}
    size = lambda name: (folder / name).stat().st_size
    assert manifest == {"a%20b.jsonl": (5, size("a b.jsonl")), "other.jsonl": (2, size("other.jsonl"))}
    assert logs.scan_cli_logs(spark, root, manifest=kept.table("manifest", kept.snapshot())).count() == 0  # a scan goes on where the stream is

    (folder / "third.jsonl").write_text(row(7, "u"))
    scanned, status = logs.parse_records(logs.scan_cli_logs(spark, root, manifest=kept.table("manifest", kept.snapshot())))
    ingest.ingest_messages(kept, logs.deduplicated(logs.normalise_cli(scanned)), status)
    run()  # and the stream leaves out what the scan took
    assert turns()[-1] == "u7" and len(turns()) == 7
    days = kept.snapshot().days("turns")
    assert days == {"2024-01-01", "2024-01-02"}


def test_a_batch_rewrites_the_days_it_touches(spark, tmp_path):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    kept = ingest.log_store(spark, str(tmp_path / "out"))

    def take(text):
        with open(folder / "a.jsonl", "a") as f:
            f.write(text)
        records, status = logs.parse_records(logs.scan_cli_logs(spark, str(tmp_path / "logs"), manifest=kept.table("manifest", kept.snapshot())))
        return ingest.ingest_messages(kept, logs.deduplicated(logs.normalise_cli(records)), status)

    first = take("".join(row(60 * day, f"day{day}") for day in range(6)))
    second = take(row(60 * 5 + 1, "day5"))
    for name in ("turns", "sessions"):
        gone = {f.rpartition("day=")[2] for f in first.folders[name] - second.folders[name]}
        added = {f.rpartition("day=")[2] for f in second.folders[name] - first.folders[name]}
        assert gone == (set() if name == "turns" else {"2024-01-06"}) and added == {"2024-01-06"}, name
    counts = {r["session_id"]: r["num_turns"] for r in kept.table("sessions", second).collect()}
    assert counts == {**{f"day{d}": 1 for d in range(5)}, "day5": 2}


def test_lines_are_not_moved_to_be_numbered_and_parsed_once(spark):
    batch = spark.createDataFrame([("/p/f.jsonl", k // 2, k % 2 + 1, 10 * k, 10 * k + 10, f"line {k}") for k in range(6)], growing.SCHEMA)
    known = spark.createDataFrame([("/p/f.jsonl", 10, 7)], "file_path string, last_byte_offset long, last_line_number long")
    rows = growing.numbered(batch, known)
    assert [(r.line_no, r.line) for r in rows.orderBy("line_no").collect()] == [(7 + k, f"line {k}") for k in range(1, 6)]
    plan = growing.numbered(batch, known)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and plan.count("Exchange hashpartitioning(file_path") == 2  # counts of blocks, and their sums
    assert not any("line#" in step for step in plan.split("\n") if "Exchange hashpartitioning" in step)

    kept = []
    records, status = logs.parse_records(logs.cli_places(rows.withColumn("file_size", rows.line_end)), lambda parsed: kept.append(parsed) or spark.createDataFrame(parsed.collect(), parsed.schema))
    assert len(kept) == 1 and "line" not in kept[0].columns and records.count() == 0
    assert {r["status"] for r in status.collect()} == {"error"}


def test_small_blocks_share_tasks():
    reader = growing._Reader({"path": "/", "blockBytes": "10"})
    tasks = reader.partitions({"b": 3}, {"a": 10_000, "b": 25, "c": 0})
    assert len(tasks) <= growing.TASKS + 1 and max(len(t.blocks) for t in tasks) <= 17
    blocks = [block for task in tasks for block in task.blocks]
    assert blocks == [("a", k, 10 * k, 10 * k + 10) for k in range(1000)] + [("b", 0, 3, 13), ("b", 1, 13, 23), ("b", 2, 23, 25)]
    assert [len(t.blocks) for t in growing._Reader({"path": "/"}).partitions({}, {"a": 5 << 30})] == [2] * 40  # large ones hold TASK bytes each
    assert reader.partitions({}, {}) == []


def test_a_stream_holds_no_lines_and_leaves_no_tables_between(spark, tmp_path):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    (folder / "a.jsonl").write_text("".join(row(n) for n in range(20)))
    seen = []
    own = ingest._committed

    def committed(store, messages, *rest):
        seen.append((len(spark.sparkContext._jsc.getPersistentRDDs()), [len(list(d.iterdir())) for d in (tmp_path / "out" / "staging").iterdir()]))
        return own(store, messages, *rest)

    before = len(spark.sparkContext._jsc.getPersistentRDDs())
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(ingest, "_committed", committed)
        live.stream_ingest(spark, str(tmp_path / "logs"), str(tmp_path / "out"), str(tmp_path / "marks")).awaitTermination()
    assert seen == [(before, [2])]  # messages, and how far files are read: the parsed lines are gone by then
    assert list((tmp_path / "out" / "staging").iterdir()) == []
    kept = ingest.log_store(spark, str(tmp_path / "out"))
    assert kept.table("turns", kept.snapshot()).count() == 20
