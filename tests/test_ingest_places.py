"""Batches into the store: turns of a file are gathered in one task only where records have no id."""

import json

import pytest

import __spark_entry__  # noqa: F401  (registers the queries in their order)
from sparklog.operators import shred
from sparklog.sources import ingest, logs, merge


@pytest.mark.parametrize("ids", [True, False])
def test_windows_over_files_only_for_records_without_ids(spark, tmp_path, monkeypatch, ids):
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    rows = [{"type": kind, "sessionId": "s", "timestamp": f"2024-01-01T00:00:0{n}Z", "message": {"content": "x"}} | ({"uuid": f"u{n}"} if ids or n == 0 else {}) for n, kind in enumerate(["user", "user", "assistant", "user"])]
    (folder / "a.jsonl").write_text("".join(json.dumps(r) + "\n" for r in rows))
    seen, own = [], logs.shred_messages
    monkeypatch.setattr(logs, "shred_messages", lambda messages: seen.append("Window" in shred.user_turns(messages)._jdf.queryExecution().optimizedPlan().toString()) or own(messages))
    records, status = logs.parse_records(logs.scan_cli_logs(spark, f"file://{tmp_path}/logs"))
    store = ingest.log_store(spark, f"file://{tmp_path}/store")
    at = ingest.ingest_messages(store, logs.deduplicated(logs.normalise_cli(records)), status, "t", 0)
    assert seen == [not ids]
    turns = sorted(r.turn_id for r in store.table("turns", at).collect())
    assert turns == (["u0", "u1", "u2", "u3"] if ids else ["s-assistant-0", "s-user-1", "s-user-2", "u0"])


def test_only_chosen_files_are_read(spark, tmp_path):
    for name in "ab":
        (tmp_path / name).mkdir()
        (tmp_path / name / "x.jsonl").write_text("{}\n")
    files = lambda chosen: [r.project_dir for r in logs.scan_cli_logs(spark, f"file://{tmp_path}", chosen=chosen).collect()]
    from pyspark.sql import functions as F

    assert files(F.col("file_path").contains("/b/")) == ["b"]
    assert sorted(files(None)) == ["a", "b"]
    assert files(F.lit(False)) == []


def test_ids_are_broadcast_only_if_they_are_few(spark, tmp_path, monkeypatch):
    rows = spark.createDataFrame([(f"k{n}", f"r{n}") for n in range(5)], "turn_id string, request_id string")
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" not in plan(merge.absent_rows(rows.limit(2), rows, ["turn_id", "request_id"]))  # the target may hold any number
    store = ingest.log_store(spark, f"file://{tmp_path}/store")
    staged = store.staged(rows, "x")
    assert "BroadcastHashJoin" in plan(rows.join(ingest._side(staged), "turn_id", "left_semi"))
    monkeypatch.setattr(ingest, "_FEW", 3)
    assert "BroadcastHashJoin" not in plan(rows.join(ingest._side(staged), "turn_id", "left_semi"))


def test_batches_of_many_rows_change_what_was_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ingest, "_FEW", 0)
    folder = tmp_path / "logs" / "p"
    folder.mkdir(parents=True)
    store = ingest.log_store(spark, f"file://{tmp_path}/store")
    head = lambda n, kind: {"type": kind, "sessionId": "s", "timestamp": f"2024-01-01T00:00:0{n}Z", "uuid": f"u{n}"}
    call = head(1, "assistant") | {"requestId": "r", "message": {"content": [{"type": "tool_use", "id": "c", "name": "Bash"}]}}
    result = head(2, "user") | {"message": {"content": [{"type": "tool_result", "tool_use_id": "c", "is_error": True, "content": "bad"}]}}
    for number, record in enumerate((call, result)):
        (folder / f"{number}.jsonl").write_text(json.dumps(record) + "\n")
        at = ingest.ingest_lines(store, logs.scan_cli_logs(spark, f"file://{tmp_path}/logs", manifest=store.table("manifest", store.snapshot())), "t", number)
    assert [(r.success, r.error_message) for r in store.table("calls", at).collect()] == [(False, "bad")]
    assert [(r.num_turns, r.num_tool_calls, r.duration_seconds) for r in store.table("sessions", at).collect()] == [(2, 1, 1)]
    assert {r.file_path[-7:]: r.last_line_number for r in store.table("manifest", at).collect()} == {"0.jsonl": 1, "1.jsonl": 1}
    assert [r.error_id for r in store.table("errors", at).collect()] == ["c-toolerr"]
