"""The star schema projected from the generic `events` table, for checks and benchmarks without session logs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparklog.operators.shred import session_rollup, stop_errors


@dataclass(frozen=True)
class Tables:
    sessions: DataFrame
    turns: DataFrame
    calls: DataFrame
    errors: DataFrame
    skills: DataFrame


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    week = F.date_trunc("week", "ts").cast("date").cast("string")
    return spark.read.parquet(f"{sf_dir}/events.parquet").select(
        "*", k.alias("k"), F.concat_ws("-", F.col("user_id").cast("string"), week).alias("session_id"), F.col("event_id").cast("string").alias("turn_id")
    )


def turns(events: DataFrame) -> DataFrame:
    """One turn per event: views are user turns, the others assistant turns. user_id is kept as the account."""
    user = F.col("event_type") == "view"
    k = F.col("k")
    tokens = lambda c: F.when(user, 0).otherwise(c).cast("long")
    names = F.element_at(F.array(*map(F.lit, ("claude-opus-4-7", "claude-sonnet-4-5", "claude-haiku-4-5", "other-model-1", "claude-opus-4-7"))), k % 5 + 1)
    return events.select(
        "turn_id",
        "session_id",
        F.when(user, "user").otherwise("assistant").alias("role"),
        F.col("ts").alias("timestamp"),
        tokens(F.floor(F.col("value") * 10)).alias("input_tokens"),
        tokens(k * 7).alias("output_tokens"),
        tokens(F.col("event_id") % 13 * 1000).alias("cache_creation_tokens"),
        tokens(F.col("event_id") % 17 * 15000).alias("cache_read_tokens"),
        F.when(user, 0.0).otherwise(F.col("value") / 100).alias("cost_usd"),
        F.when(~user & (k % 20 == 1), "<synthetic>").when(~user & (k % 20 != 0), names).alias("model"),
        F.when(~user, F.when(k % 25 == 3, "max_tokens").otherwise("end_turn")).alias("stop_reason"),
        F.when(~user, F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("string"))).alias("request_id"),
        F.lit(None).cast("string").alias("parent_uuid"),
        F.col("event_type").isin("click", "purchase", "error").alias("has_tool_use"),
        (~user & (k % 4 == 0)).alias("has_thinking"),
        F.when(user & (k % 10 != 0), F.concat(F.lit("prompt "), F.col("turn_id"))).alias("content_text"),
        "user_id",
    )


def calls(events: DataFrame) -> DataFrame:
    """Tool calls of click, purchase and error events; two parallel ones where k is a multiple of 3."""
    k = F.col("k")
    rows = events.filter(F.col("event_type").isin("click", "purchase", "error"))
    rows = rows.withColumn("i", F.explode(F.when(k % 3 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))))
    skill = k % 11 == 0
    mcp = ~skill & (F.col("event_type") == "purchase")
    name = F.when(skill, "Skill").when(mcp, "mcp__shop__buy").when(F.col("event_type") == "error", "Bash").when(F.col("event_id") % 2 == 0, "Read").otherwise("Edit")
    called = F.concat(F.lit("skill-"), (k % 10).cast("string"))
    success = F.when(k % 7 != 0, F.col("event_type") != "error")
    return rows.select(
        F.md5(F.concat_ws("-", "turn_id", F.col("i").cast("string"))).alias("tool_call_id"),
        "session_id",
        "turn_id",
        name.alias("tool_name"),
        F.when(mcp, "mcp").otherwise("builtin").alias("tool_type"),
        F.when(mcp, "shop").alias("mcp_server"),
        F.when(k % 3 != 1, k * 10 + F.col("i")).cast("int").alias("duration_ms"),
        success.alias("success"),
        F.when(~success, F.concat(F.lit("error "), (k % 6).cast("string"))).alias("error_message"),
        F.when(skill, F.concat(F.lit('{"skill":"'), called, F.lit('"}'))).otherwise("{}").alias("parameters"),
        F.when(skill & (k % 2 != 0), called).alias("skill_name"),
        F.when(skill, "user").alias("skill_caller_type"),
    )


def loaded_skills(events: DataFrame) -> DataFrame:
    k = F.col("k")
    kind = F.when(k % 8 == 0, "idle-").otherwise("skill-")
    return events.filter((F.col("event_type") == "view") & (k % 4 == 0)).select(
        F.col("turn_id").alias("session_skill_id"),
        "session_id",
        F.col("turn_id").alias("record_uuid"),
        F.concat(kind, (k % 10).cast("string")).alias("skill_name"),
        F.when(k > 0, F.repeat(F.lit("x"), k)).alias("skill_description"),
        F.lit(1).alias("skill_count"),
        F.lit(True).alias("is_initial"),
        F.col("ts").alias("captured_at"),
        F.lit("events").alias("source"),
    )


def tables(spark: SparkSession, sf_dir: str) -> Tables:
    events = _events(spark, sf_dir)
    t, c = turns(events), calls(events)
    rolled = session_rollup(t, c)
    user = F.split("session_id", "-")[0].cast("long")
    sessions = rolled.withColumns(
        {
            "cwd": F.lit(None).cast("string"), "source_file": F.lit(None).cast("string"), "git_branch": F.lit("main"), "claude_version": F.lit("1"),
            "project_path": F.when(user % 11 != 0, F.concat(F.lit("/projects/p"), (user % 7).cast("string"))),
            "project_name": F.when(user % 11 != 0, F.concat(F.lit("p"), (user % 7).cast("string"))),
            "source_type": F.when(user % 2 == 0, "cli").otherwise("desktop"),
        }
    )
    failed = c.filter(~F.col("success")).join(t.select("turn_id", "timestamp"), "turn_id")
    tool_errors = failed.select(
        F.concat("tool_call_id", F.lit("-toolerr")).alias("error_id"), "session_id", "timestamp", F.lit("tool_error").alias("error_type"),
        F.col("error_message").alias("message"), F.lit(True).alias("is_retryable"), F.lit(0).alias("retry_count"),
    )
    return Tables(sessions, t, c, tool_errors.unionByName(stop_errors(t)), loaded_skills(events))


_EVENTS = 25_000  # events of a task that makes their lines: some seconds of work


def log_lines(spark: SparkSession, sf_dir: str, ranged: bool = False) -> DataFrame:
    """The events as lines of command-line logs, as sparklog.sources.logs scans them: one file per session.

    A view is a prompt, any other event an answer with its tool calls; results, skill listings, lines of other
    types, broken and blank lines follow some of them. Lines are numbered on their keys before they are written out.
    Sessions are dealt to tasks before their lines are made: the table's row groups may be few, and the work on a line
    is much more than that of reading its event. The numbers need no other shuffle. `ranged` deals them by ranges of
    project and session, so that lines leave the tasks in the order of files that hold a project each: what is moved
    for that order are events, not lines.
    """
    events = _events(spark, sf_dir)
    tasks = max(-(-events.count() // _EVENTS), spark.sparkContext.defaultParallelism)  # from the footers
    k, user = F.col("k"), F.col("event_type") == "view"
    has_calls = F.col("event_type").isin("click", "purchase", "error")
    parts = F.array_compact(F.array(F.lit(0), F.when(has_calls & (k % 7 != 0), 1), F.when(user & (k % 4 == 0), 2), F.when(k % 9 == 0, 3), F.when(k % 23 == 5, 4), F.when(k % 29 == 7, 5)))
    folder = F.concat(F.lit("-projects-p"), (F.split("session_id", "-")[0].cast("long") % 7).cast("string"))
    keys = ["project_dir", "session_id"] if ranged else ["session_id"]
    rows = events.withColumn("project_dir", folder)
    rows = rows.repartitionByRange(tasks, *keys) if ranged else rows.repartition(tasks, *keys)
    rows = rows.withColumn("part", F.explode(parts))
    order = Window.partitionBy(*keys).orderBy("ts", "event_id", "part")
    rows = rows.withColumn("line_no", F.row_number().over(order))

    head = [F.col("session_id").alias("sessionId"), F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), F.lit("Z")).alias("timestamp")]
    record = lambda kind, *more: F.to_json(F.struct(F.lit(kind).alias("type"), *head, *more))
    suffixed = lambda s: F.concat("turn_id", F.lit(s)).alias("uuid")
    prompt = record("user", suffixed(""), F.struct(F.lit("user").alias("role"), F.when(k % 10 != 0, F.concat(F.lit("prompt "), "turn_id")).alias("content")).alias("message"))

    skill = k % 11 == 0
    name = F.when(skill, "Skill").when(F.col("event_type") == "purchase", "mcp__shop__buy").when(F.col("event_type") == "error", "Bash").when(F.col("event_id") % 2 == 0, "Read").otherwise("Edit")
    block = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[more.get(c, F.lit(None).cast("string")).alias(c) for c in ("text", "thinking", "id", "name")], more.get("input", F.lit(None).cast("struct<skill:string>")).alias("input"), more.get("caller", F.lit(None).cast("struct<type:string>")).alias("caller"))
    call = lambda i: block("tool_use", id=F.md5(F.concat_ws("-", "turn_id", F.lit(str(i)))), name=name, input=F.struct(F.when(skill, F.concat(F.lit("skill-"), (k % 10).cast("string"))).alias("skill")), caller=F.when(skill, F.struct(F.lit("user").alias("type"))))
    blocks = F.array_compact(
        F.array(
            F.when(k % 4 == 0, block("thinking", thinking=F.lit("hm"))), F.when(k % 6 != 0, block("text", text=F.concat(F.lit("answer "), "turn_id"))), F.when(k % 12 == 1, block("text", text=F.lit("and more"))),
            F.when(has_calls, call(0)), F.when(has_calls & (k % 3 == 0), call(1)),
        )
    )
    usage = F.struct(
        F.floor(F.col("value") * 10).cast("long").alias("input_tokens"), (k * 7).cast("long").alias("output_tokens"), (F.col("event_id") % 13 * 1000).alias("cache_creation_input_tokens"), (F.col("event_id") % 17 * 15000).alias("cache_read_input_tokens")
    )
    message = F.struct(F.lit("assistant").alias("role"), F.lit("claude-opus-4-7").alias("model"), F.when(k % 25 == 3, "max_tokens").otherwise("end_turn").alias("stop_reason"), usage.alias("usage"), blocks.alias("content"))
    answer = record("assistant", F.concat(F.lit("r"), F.floor(F.col("event_id") / 2).cast("string")).alias("requestId"), suffixed(""), message.alias("message"))
    result = lambda i: F.struct(F.lit("tool_result").alias("type"), F.md5(F.concat_ws("-", "turn_id", F.lit(str(i)))).alias("tool_use_id"), (F.col("event_type") == "error").alias("is_error"), F.concat(F.lit("error "), (k % 6).cast("string")).alias("content"))
    results = F.array_compact(F.array(result(0), F.when(k % 3 == 0, result(1))))
    listed = F.concat(F.lit("- skill-"), (k % 10).cast("string"), F.lit(": "), F.repeat(F.lit("x"), k + 1), F.lit("\n  and more"))
    attachment = F.struct(F.lit("skill_listing").alias("type"), listed.alias("content"), F.when(k % 8 == 0, 2).otherwise(1).alias("skillCount"), F.lit(True).alias("isInitial"))
    line = (
        F.when(F.col("part") == 0, F.when(user, prompt).otherwise(answer))
        .when(F.col("part") == 1, record("user", suffixed("-r"), F.struct(F.lit("user").alias("role"), results.alias("content")).alias("message")))
        .when(F.col("part") == 2, record("attachment", suffixed("-l"), attachment.alias("attachment")))
        .when(F.col("part") == 3, record("progress"))
        .when(F.col("part") == 4, F.lit('{"type": "user", "sess'))
        .otherwise(F.lit("  "))
    )
    return rows.select(
        line.alias("line"), F.concat(F.lit("/logs/"), "project_dir", F.lit("/"), "session_id", F.lit(".jsonl")).alias("file_path"), F.lit(1000).cast("long").alias("file_size"), F.lit(None).cast("timestamp").alias("file_time"),
        "line_no", F.col("session_id").alias("file_session"), F.lit(False).alias("is_sub_agent"), "project_dir", F.lit("cli").alias("source_type"),
    )
