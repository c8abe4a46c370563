"""Plans of reading logs: a line is made and parsed once, and a side that a filter leaves empty isn't read."""

import os

import pytest

import __spark_entry__  # noqa: F401  (registers the queries in their order)
from sparklog import log_queries, project
from sparklog.operators import shred
from sparklog.sources import logs

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="the test tables are not here")


def optimized(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


@pytest.mark.parametrize("kind, turns", [("user", shred.user_turns), ("assistant", shred.assistant_turns)])
def test_turns_of_one_kind_parse_each_line_once(spark, kind, turns):
    plan = optimized(turns(log_queries._messages(project.log_lines(spark, SF))))
    assert plan.count("Relation") == 1
    assert plan.count("from_json(StructField(type,StringType,true), StructField(sessionId") == 1  # one parse of the record


def test_broken_blank_and_foreign_lines_keep_their_status(spark):
    texts = ['{"type":"user","cwd":"/a","sessionId":"s"}', '{"type":"user", "sess', "  ", "", "null", "[]", '{"type":"progress"}', '{"cwd":"/a"}', '[{"type":"user"}]', None]
    lines = spark.createDataFrame([("f", 1, n, t, "kept") for n, t in enumerate(texts)], "file_path string, file_size long, line_no long, line string, title string")
    records, status = logs.parse_records(lines)
    assert [(r.line_no, r.type, r.cwd, r.title) for r in records.orderBy("line_no").collect()] == [(0, "user", "/a", "kept")]
    assert [r.status for r in status.orderBy("line_no").collect()] == ["entry", "error", "blank", "blank", "error", "error", "skipped", "error", "error", "error"]


def test_lines_are_made_in_many_tasks_however_few_row_groups_there_are(spark, monkeypatch):
    monkeypatch.setattr(project, "_EVENTS", 50)
    events = spark.read.parquet(f"{SF}/events.parquet")
    few, many = project.log_lines(spark, SF).select("line"), -(-events.count() // 50)
    assert events.rdd.getNumPartitions() < 10 < many
    assert few.rdd.getNumPartitions() == many  # without line numbers, whose window alone spread the rows before
    assert project.log_lines(spark, SF)._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1


def test_listings_are_counted_in_their_rows(spark):
    kinds = "session_id string, uuid string, timestamp timestamp, listing string, skill_count int, is_initial boolean, source string"
    rows = [("s", "u", None, "- a: x\n- b: y", 2, True, "cli")] * 2 + [("s", "v", None, None, 1, True, "cli"), ("s", "w", None, "nothing", 1, True, "cli"), ("s", "x", None, None, None, True, "cli")]
    found = shred.listing_mismatches(spark.createDataFrame(rows, kinds))
    assert sorted((r.uuid, r.skill_count, r.parsed) for r in found.collect()) == [("v", 1, 0), ("w", 1, 0)]  # a record that is there twice isn't added up
    assert found._jdf.queryExecution().executedPlan().toString().count("Exchange") == 0


def test_a_staged_batch_of_skills_reads_the_lines_once(spark):
    plan = optimized(log_queries.QUERIES["sink_session_skills"](spark, SF))
    assert "from_json" not in plan and "events.parquet" not in plan
