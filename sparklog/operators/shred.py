"""Parsed log records -> the star schema: turns, tool calls, sessions, errors, loaded skills."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.exprs import CATEGORIES, RATES, Rate, classify_tool, has_rate, with_cost
from sparklog.schemas import SYNTHETIC_MODEL

_MESSAGE_LIMIT, _TEXT_LIMIT = 2000, 10_000
_BLOCKS = "array<struct<type:string,text:string,id:string,name:string,input:string,tool_use_id:string,content:string,is_error:boolean,caller:struct<type:string>>>"
#: The line that starts a skill: its name and text.
_SKILL, _GREEDY = r"^- (\S.*?)(?:: |:$)(.*)$", r"^- (\S.*):(?: (.*))?$"
#: Stop reasons that are errors, the error's type, and whether it can be retried.
STOP_ERRORS = {"max_tokens": ("max_tokens_truncation", True), "refusal": ("refusal", False), "model_context_window_exceeded": ("context_window_exceeded", False)}


def dedup_last(rows: DataFrame, key: str, order: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """The last row of each key (within a file, say); rows with a null or empty key all stay."""
    keyed = F.col(key).isNotNull() & (F.col(key) != "")
    # rows without a key are spread by their order, not gathered in one window partition
    window = Window.partitionBy(*within, F.when(keyed, F.col(key)), *[F.when(~F.coalesce(keyed, F.lit(False)), F.col(o)) for o in order])
    ranked = rows.withColumn("_rank", F.row_number().over(window.orderBy(*[F.desc(o) for o in order])))
    return ranked.filter((F.col("_rank") == 1) | ~F.coalesce(keyed, F.lit(False))).drop("_rank")


def blocks(content: Column) -> Column:
    """The blocks of a message's content (raw JSON): a string is one text block."""
    text = F.struct(
        F.lit("text").alias("type"), content.alias("text"), *[F.lit(None).cast("string").alias(c) for c in ("id", "name", "input", "tool_use_id", "content")],
        F.lit(None).cast("boolean").alias("is_error"), F.lit(None).cast("struct<type:string>").alias("caller"),
    )
    return F.when(content.startswith("["), F.from_json(content, _BLOCKS)).when(content.isNotNull(), F.array(text))


def content_text(parts: Column) -> Column:
    """The text blocks joined by line ends, cut to 10 000 characters; null without text."""
    texts = F.transform(F.filter(parts, lambda b: (b["type"] == "text") & b["text"].isNotNull()), lambda b: b["text"])
    return F.nullif(F.left(F.array_join(texts, "\n"), F.lit(_TEXT_LIMIT)), F.lit(""))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their place among those of their file, unless they come with one (`place`, null where it isn't needed)."""
    if "place" in rows.columns:
        return rows.withColumnRenamed("place", "_place")
    return rows.withColumn("_place", F.row_number().over(Window.partitionBy("file_path").orderBy("line_no")) - 1)


def user_turns(messages: DataFrame) -> DataFrame:
    """A turn without tokens per user record; an id from session and place in the file where there is none."""
    rows = _placed(messages.filter(F.col("type") == "user"))
    return rows.select(
        F.coalesce("uuid", F.concat_ws("-", "session_id", F.lit("user"), F.col("_place").cast("string"))).alias("turn_id"),
        "session_id", F.lit("user").alias("role"), "timestamp",
        *[F.lit(0).cast("long").alias(f"{c}_tokens") for c in CATEGORIES], F.lit(0.0).alias("cost_usd"),
        F.lit(None).cast("string").alias("model"), F.lit(None).cast("string").alias("stop_reason"), F.lit(None).cast("string").alias("request_id"),
        "parent_uuid", F.lit(False).alias("has_tool_use"), F.lit(False).alias("has_thinking"), content_text(F.col("blocks")).alias("content_text"),
    )


def assistant_turns(messages: DataFrame, rates: Sequence[Rate] = RATES) -> DataFrame:
    """A turn per assistant record, priced from its tokens."""
    rows = _placed(messages.filter(F.col("type") == "assistant"))
    priced = with_cost(rows, rates)
    has = lambda kind: F.coalesce(F.exists("blocks", lambda b: b["type"] == kind), F.lit(False))
    return priced.select(
        F.coalesce("uuid", "request_id", F.concat_ws("-", "session_id", F.lit("assistant"), F.col("_place").cast("string"))).alias("turn_id"),
        "session_id", F.lit("assistant").alias("role"), "timestamp", *[f"{c}_tokens" for c in CATEGORIES], "cost_usd", "model", "stop_reason",
        "request_id", "parent_uuid", has("tool_use").alias("has_tool_use"), has("thinking").alias("has_thinking"), content_text(F.col("blocks")).alias("content_text"),
    )


def explode_tool_calls(messages: DataFrame) -> DataFrame:
    """A row per tool_use block of an assistant record, before its result is known."""
    rows = messages.filter(F.col("type") == "assistant")
    rows = rows.withColumn("b", F.explode(F.filter("blocks", lambda b: b["type"] == "tool_use")))
    kind, server = classify_tool(F.col("b.name"))
    skill = F.col("b.name") == "Skill"
    return rows.select(
        F.col("b.id").alias("tool_call_id"), "session_id", F.coalesce("uuid", "request_id").alias("turn_id"), "timestamp", F.col("b.name").alias("tool_name"),
        kind.alias("tool_type"), server.alias("mcp_server"), F.lit(None).cast("int").alias("duration_ms"), F.col("b.input").alias("parameters"),
        F.when(skill, F.get_json_object("b.input", "$.skill")).alias("skill_name"), F.when(skill, F.col("b.caller.type")).alias("skill_caller_type"),
    )


def tool_results(messages: DataFrame) -> DataFrame:
    """The last result of each tool_use id: error flag and text."""
    rows = messages.filter(F.col("type") == "user").withColumn("b", F.explode(F.filter("blocks", lambda b: b["type"] == "tool_result")))
    many = F.from_json("b.content", "array<struct<text:string>>")
    text = F.when(F.col("b.content").startswith("["), F.array_join(F.transform(many, lambda x: F.coalesce(x["text"], F.lit(""))), "\n")).otherwise(F.col("b.content"))
    place = F.struct("timestamp", "line_no", "file_path")
    rows = rows.select(
        F.col("b.tool_use_id").alias("tool_call_id"), F.coalesce(F.col("b.is_error"), F.lit(False)).alias("is_error"), text.alias("result"),
        "session_id", "timestamp", place.alias("place"),
    )
    last = F.max_by(F.struct("is_error", "result", "session_id", "timestamp"), "place").alias("r")
    return rows.groupBy("tool_call_id").agg(last).select("tool_call_id", "r.*")


def join_tool_results(calls: DataFrame, results: DataFrame) -> DataFrame:
    """success is null where no result is known; the error's text only where it failed."""
    found = results.select("tool_call_id", "is_error", "result")
    joined = calls.join(found, "tool_call_id", "left")
    return joined.withColumns({"success": ~F.col("is_error"), "error_message": F.when(F.col("is_error"), F.col("result"))}).drop("is_error", "result")


def tool_errors(calls: DataFrame, results: DataFrame) -> DataFrame:
    """An error per failed result, in the session and at the time of the call where it is known."""
    origin = calls.select("tool_call_id", F.col("session_id").alias("_s"), F.col("timestamp").alias("_t")).dropDuplicates(["tool_call_id"])
    failed = results.filter("is_error").join(origin, "tool_call_id", "left")
    message = F.coalesce(F.nullif(F.left("result", F.lit(_MESSAGE_LIMIT)), F.lit("")), F.lit("Tool call returned an error."))
    return failed.select(
        F.concat("tool_call_id", F.lit("-toolerr")).alias("error_id"), F.coalesce("_s", "session_id").alias("session_id"), F.coalesce("_t", "timestamp").alias("timestamp"),
        F.lit("tool_error").alias("error_type"), message.alias("message"), F.lit(True).alias("is_retryable"), F.lit(0).alias("retry_count"),
    )


def stop_errors(turns: DataFrame) -> DataFrame:
    """An error per assistant turn that stopped for a problem."""
    kind = F.create_map(*[F.lit(x) for reason, (name, _) in STOP_ERRORS.items() for x in (reason, name)])
    retry = F.create_map(*[F.lit(x) for reason, (_, again) in STOP_ERRORS.items() for x in (reason, again)])
    stopped = turns.filter((F.col("role") == "assistant") & F.col("stop_reason").isin(*STOP_ERRORS))
    return stopped.select(
        F.concat("turn_id", F.lit("-stop")).alias("error_id"), "session_id", "timestamp", kind[F.col("stop_reason")].alias("error_type"),
        F.concat(F.lit("stop_reason: "), "stop_reason").alias("message"), retry[F.col("stop_reason")].alias("is_retryable"), F.lit(0).alias("retry_count"),
    )


def session_rollup(turns: DataFrame, calls: DataFrame) -> DataFrame:
    """A row per session, from its turns and tool calls; sessions of user turns alone stay."""
    seconds = (F.unix_micros(F.col("end_time").cast("timestamp")) - F.unix_micros(F.col("start_time").cast("timestamp"))) / 1_000_000
    first_model = F.min_by(F.when(F.col("role") == "assistant", F.col("model")), F.when((F.col("role") == "assistant") & F.col("model").isNotNull(), F.struct("timestamp", "turn_id")))
    rolled = turns.groupBy("session_id").agg(
        F.min("timestamp").alias("start_time"),
        F.when(F.count("*") > 1, F.max("timestamp")).alias("end_time"),
        first_model.alias("model"),
        *[F.sum(f"{c}_tokens").alias(f"{c}_tokens") for c in CATEGORIES],
        F.sum("cost_usd").alias("total_cost_usd"),
        F.count("*").cast("int").alias("num_turns"),
    )
    called = calls.groupBy("session_id").agg(F.count("*").cast("int").alias("num_tool_calls"))
    rolled = rolled.join(called, "session_id", "left").withColumn("duration_seconds", F.round(seconds).cast("int"))
    return rolled.withColumn("num_tool_calls", F.coalesce("num_tool_calls", F.lit(0)))


def session_context(messages: DataFrame) -> DataFrame:
    """The first cwd, branch, version and file of each session."""
    place = F.struct("timestamp", "line_no")
    first = lambda c: F.min_by(F.col(c), F.when(F.col(c).isNotNull(), place)).alias(c)
    return messages.groupBy("session_id").agg(*[first(c) for c in ("cwd", "git_branch", "version", "file_path", "project_dir", "title", "folder", "source_type")])


def project_cols(sessions: DataFrame) -> DataFrame:
    """project_path and project_name: of the log's folder, or for desktop sessions of title, folder, cwd."""
    decoded = F.regexp_replace("project_dir", "-", "/")
    path = F.when(F.col("source_type") == "desktop", F.coalesce("title", "folder", "cwd", "project_dir")).otherwise(decoded)
    last = F.element_at(F.filter(F.split(path, "/"), lambda p: p != ""), -1)
    suffix = F.when((F.col("source_type") == "desktop") & ~last.endswith(" (Desktop)"), F.concat(last, F.lit(" (Desktop)"))).otherwise(last)
    return sessions.withColumns({"project_path": path, "project_name": suffix})


def _skill_lines(listing: Column, pattern: str) -> Column:
    """The lines of each skill of a listing: a line that starts one, then those that continue it."""
    start = lambda line: F.rlike(line, F.lit(pattern))
    lines = F.filter(F.split(listing, "\n"), lambda x: F.trim(x) != "")
    none = F.array().cast("array<array<string>>")

    def step(found: Column, line: Column) -> Column:
        added = F.concat(F.element_at(found, -1), F.array(F.trim(line)))
        longer = F.concat(F.slice(found, F.lit(1), F.greatest(F.size(found) - 1, F.lit(0))), F.array(added))
        return F.when(start(line), F.concat(found, F.array(F.array(line)))).when(F.size(found) > 0, longer).otherwise(found)

    return F.aggregate(lines, none, step)


def skill_listing(listings: DataFrame, text_col: str = "listing", greedy: bool = False) -> DataFrame:
    """listings with one row per skill: skill_name, skill_description, position.

    `- name: text` starts a skill (split at the first colon before a space or the line's end; at the last one
    if greedy); other lines that aren't blank continue it; such lines before any skill are dropped.
    """
    pattern = _GREEDY if greedy else _SKILL
    rows = listings.withColumn("_skills", _skill_lines(F.col(text_col), pattern)).select("*", F.posexplode("_skills").alias("position", "_lines")).drop("_skills")
    head = F.col("_lines")[0]
    described = F.trim(F.concat_ws(" ", F.nullif(F.trim(F.regexp_extract(head, pattern, 2)), F.lit("")), F.slice("_lines", 2, F.greatest(F.size("_lines") - 1, F.lit(0)))))
    return rows.withColumns({"skill_name": F.trim(F.regexp_extract(head, pattern, 1)), "skill_description": F.nullif(described, F.lit(""))}).drop("_lines")


def session_skills(listings: DataFrame) -> DataFrame:
    """listings (session_id, uuid, timestamp, listing, skill_count, is_initial, source) as rows of loaded skills."""
    rows = skill_listing(listings)
    key = F.concat_ws(":", "session_id", F.coalesce("uuid", F.col("timestamp").cast("string")), "skill_name")
    return rows.select(
        key.alias("session_skill_id"), "session_id", F.col("uuid").alias("record_uuid"), "skill_name", "skill_description", "skill_count", "is_initial",
        F.col("timestamp").alias("captured_at"), "source",
    ).dropDuplicates(["session_skill_id"])


def listing_mismatches(listings: DataFrame) -> DataFrame:
    """Listings whose number of skills isn't the declared one."""
    parsed = F.coalesce(F.size(_skill_lines(F.col("listing"), _SKILL)), F.lit(0)).cast("long")  # counted in the row: nothing is read again or shuffled
    rows = listings.select("session_id", "uuid", "timestamp", "skill_count", F.when(F.col("listing").isNotNull(), parsed).otherwise(0).alias("parsed"))
    return rows.filter("skill_count is not null and parsed <> skill_count")


def unpriced_models(turns: DataFrame, rates: Sequence[Rate] = RATES) -> DataFrame:
    """Models that no rate is known for."""
    return turns.select("model").filter((F.col("model") != "") & (F.col("model") != SYNTHETIC_MODEL)).distinct().filter(~has_rate("model", rates))


def reprice(turns: DataFrame, sessions: DataFrame, rates: Sequence[Rate] = RATES) -> tuple[DataFrame, DataFrame]:
    """Assistant turns priced anew, and the sessions with the new totals."""
    priced = with_cost(turns, rates, "_new").withColumn("cost_usd", F.when(F.col("role") == "assistant", F.col("_new")).otherwise(F.col("cost_usd"))).drop("_new")
    sums = priced.groupBy("session_id").agg(F.sum("cost_usd").alias("_total"))
    totals = sessions.join(sums, "session_id", "left").withColumn("total_cost_usd", F.coalesce("_total", F.lit(0.0))).drop("_total")
    return priced, totals


def reconcile(sessions: DataFrame, turns: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Sessions whose stored total isn't the sum of their turns."""
    sums = turns.groupBy("session_id").agg(F.sum("cost_usd").alias("child_cost"))
    joined = sessions.select("session_id", "total_cost_usd").join(sums, "session_id", "left").withColumn("child_cost", F.coalesce("child_cost", F.lit(0.0)))
    return joined.withColumn("difference", F.abs(F.col("total_cost_usd") - F.col("child_cost"))).filter(F.col("difference") > tolerance)


def rebuild_skills(calls: DataFrame, skills: DataFrame, new_calls: DataFrame, new_skills: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Fills missing skill columns of stored calls from a full re-read, and adds missing loaded skills."""
    from sparklog.sources.merge import merge_absent

    known = new_calls.select("tool_call_id", F.col("skill_name").alias("_name"), F.col("skill_caller_type").alias("_caller")).dropDuplicates(["tool_call_id"])
    filled = calls.join(known, "tool_call_id", "left").withColumns({"skill_name": F.coalesce("skill_name", "_name"), "skill_caller_type": F.coalesce("skill_caller_type", "_caller")})
    return filled.drop("_name", "_caller"), merge_absent(skills, new_skills, ["session_skill_id"])
