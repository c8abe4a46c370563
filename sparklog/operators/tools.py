"""Tool calls: use, success, failure streaks and chains."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.exprs import NO_FILTERS, Filters, Range, bucket, known_rate, tool_class, turn_filters
from sparklog.plans.blocks import BLOCK, running_sums, with_following


def called_in(calls: DataFrame, turns: DataFrame, sessions: DataFrame | None, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Calls with the time of their turn, in the range and passing the filters."""
    chosen = turns.filter(r.holds("timestamp"))
    if f != NO_FILTERS:
        chosen = turn_filters(chosen, sessions, f)
    return calls.join(chosen.select("turn_id", "session_id", "timestamp"), ["turn_id", "session_id"])


def _outcomes() -> list:
    good, known = F.count_if(F.col("success")), F.count("success")
    return [F.count("*").alias("calls"), good.alias("successes"), (known - good).alias("failures"), known_rate(good, known).alias("success_rate"), F.avg("duration_ms").alias("avg_duration_ms")]


def tool_usage(calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Per tool, type and server: calls, outcomes, sessions, calls per session."""
    out = called_in(calls, turns, sessions, r, f).groupBy("tool_name", "tool_type", "mcp_server").agg(*_outcomes(), F.countDistinct("session_id").alias("sessions"))
    return out.withColumn("avg_per_session", F.try_divide("calls", "sessions"))


def tool_success(calls: DataFrame, turns: DataFrame, r: Range, sessions: DataFrame | None = None, f: Filters = NO_FILTERS, top: int = 5) -> DataFrame:
    """Per tool: outcomes and up to five of its most common error texts (by count, then text)."""
    rows = called_in(calls, turns, sessions, r, f)
    out = rows.groupBy("tool_name").agg(*_outcomes())
    texts = rows.filter((~F.col("success")) & F.col("error_message").isNotNull()).groupBy("tool_name", "error_message").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("tool_name").orderBy(F.desc("n"), "error_message"))
    first = texts.withColumn("rank", rank).filter(F.col("rank") <= top).groupBy("tool_name").agg(F.array_sort(F.collect_list(F.struct("rank", "error_message"))).alias("ranked"))
    joined = out.join(first, "tool_name", "left")
    return joined.withColumn("common_errors", F.coalesce(F.col("ranked.error_message"), F.array().cast("array<string>"))).drop("ranked")


def mcp_servers(calls: DataFrame, turns: DataFrame, r: Range, sessions: DataFrame | None = None, f: Filters = NO_FILTERS) -> DataFrame:
    rows = called_in(calls.filter("mcp_server is not null"), turns, sessions, r, f)
    return rows.groupBy("mcp_server").agg(F.count("*").alias("calls"), F.avg("duration_ms").alias("avg_duration_ms"), F.array_sort(F.collect_set("tool_name")).alias("tools"))


def tool_failure_trend(calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, unit: str = "day", f: Filters = NO_FILTERS, tz: str = "UTC") -> DataFrame:
    """Per bucket, a row with calls, known results, failures and failure rate of each class and of all."""
    rows = called_in(calls, turns, sessions, r, f).withColumn("class", tool_class())
    columns = []
    for name, own in (("builtin", F.col("class") == "builtin"), ("mcp", F.col("class") == "mcp"), ("overall", F.lit(True))):
        known, failed = F.count_if(own & F.col("success").isNotNull()), F.count_if(own & ~F.col("success"))
        columns += [F.count_if(own).alias(f"{name}_calls"), known.alias(f"{name}_evaluated"), failed.alias(f"{name}_failures"), known_rate(failed, known).alias(f"{name}_failure_rate")]
    return rows.groupBy(bucket("timestamp", unit, tz).alias("bucket")).agg(*columns)


def ordered_calls(calls: DataFrame, turns: DataFrame, sessions: DataFrame | None, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """The narrow rows that order calls in a session: by the turn's time, then call id."""
    return called_in(calls, turns, sessions, r, f).select("session_id", "timestamp", "tool_call_id", "tool_name", "success", "duration_ms")


def failure_streaks(calls: DataFrame, turns: DataFrame, sessions: DataFrame | None, r: Range, f: Filters = NO_FILTERS, min_total: int = 2, block: str = BLOCK) -> DataFrame:
    """Per session with known results: its longest run of failures, runs of 2 and 3 and more, failed calls in runs.

    A run of failures is told by the number of successes before it, which no failure changes. It is counted in blocks
    of time, so a session's calls are numbered in as many tasks as it has blocks; a run over several blocks keeps its number.
    """
    rows = ordered_calls(calls, turns, sessions, r, f).filter("success is not null")
    numbered = running_sums(rows, ["session_id"], ["timestamp", "tool_call_id"], {"run": F.col("success").cast("int")}, length=block)
    runs = numbered.groupBy("session_id", "run").agg(F.count_if(~F.col("success")).alias("n"))
    failed = F.when(F.col("n") > 0, F.col("n"))
    return runs.groupBy("session_id").agg(
        F.coalesce(F.max(failed), F.lit(0)).alias("max_failure_streak"), F.count_if(failed >= 2).alias("streaks_2plus"), F.count_if(failed >= 3).alias("streaks_3plus"),
        F.coalesce(F.sum(F.when(failed >= min_total, failed)), F.lit(0)).alias("failed_in_streaks"),
    )


def failure_streak_summary(streaks: DataFrame) -> DataFrame:
    two, three = F.count_if(F.col("streaks_2plus") > 0), F.count_if(F.col("streaks_3plus") > 0)
    return streaks.agg(
        F.count("*").alias("sessions"), two.alias("sessions_2plus"), three.alias("sessions_3plus"), F.coalesce(F.try_divide(three, F.count("*")), F.lit(0.0)).alias("rate_3plus"),
        F.coalesce(F.max("max_failure_streak"), F.lit(0)).alias("worst_streak"),
    )


def failure_offenders(streaks: DataFrame, top: int = 20) -> DataFrame:
    """The sessions with the longest streaks, from 2 on."""
    return streaks.filter("max_failure_streak >= 2").orderBy(F.desc("max_failure_streak"), F.desc("failed_in_streaks"), "session_id").limit(top)


def tool_chains(calls: DataFrame, turns: DataFrame, r: Range, n: int = 3, min_count: int = 3, top: int = 20, sessions: DataFrame | None = None, f: Filters = NO_FILTERS, block: str = BLOCK) -> DataFrame:
    """The most common sequences of n neighbouring calls; mean duration over the legs that have one.

    A session's calls are put in order in blocks of time; a sequence may run over several blocks.
    """
    if n < 1:
        raise ValueError("n must be 1 or more")
    rows = ordered_calls(calls, turns, sessions, r, f)
    legs = with_following(rows, ["session_id"], ["timestamp", "tool_call_id"], ["tool_name", "duration_ms"], n, length=block).filter(F.col(f"tool_name{n - 1}").isNotNull())
    names, times = [F.col(f"tool_name{i}") for i in range(n)], [F.col(f"duration_ms{i}") for i in range(n)]
    known = sum((t.isNotNull().cast("int") for t in times[1:]), times[0].isNotNull().cast("int"))
    whole = F.when(known > 0, sum((F.coalesce(t, F.lit(0)) for t in times[1:]), F.coalesce(times[0], F.lit(0))))
    chains = legs.groupBy(F.concat_ws(" -> ", *names).alias("chain")).agg(F.count("*").alias("n"), F.avg(whole).alias("avg_duration_ms"))
    return chains.filter(F.col("n") >= min_count).orderBy(F.desc("n"), "chain").limit(top)


def tool_transitions(chains: DataFrame) -> DataFrame:
    """Edges between neighbouring tools of the chains with their weights, without loops."""
    parts = F.split("chain", " -> ")
    pairs = F.transform(F.sequence(F.lit(0), F.size(parts) - 2), lambda i: F.struct(F.get(parts, i).alias("source"), F.get(parts, i + 1).alias("target")))
    edges = chains.select("n", F.inline(pairs))
    return edges.filter("source <> target").groupBy("source", "target").agg(F.sum("n").alias("weight"))


def tool_overall(usage: DataFrame) -> DataFrame:
    """Calls, tools, and pooled rates over known results."""
    known = F.sum("successes") + F.sum("failures")
    return usage.agg(F.coalesce(F.sum("calls"), F.lit(0)).alias("calls"), F.countDistinct("tool_name").alias("tools"), known_rate(F.sum("failures"), known).alias("failure_rate"), known_rate(F.sum("successes"), known).alias("success_rate"))


def tool_success_joined(success: DataFrame, usage: DataFrame) -> DataFrame:
    per = usage.groupBy("tool_name").agg(F.max("avg_per_session").alias("avg_per_session"))
    return success.join(per, "tool_name", "left").na.fill(0.0, ["avg_per_session"])
