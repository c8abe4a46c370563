"""Sessions: summaries, lists, statistics and context pressure."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.exprs import CATEGORIES, NO_FILTERS, Filters, Range, only, session_filters, token_sums, turn_filters, with_context
from sparklog.plans.blocks import BLOCK, running_sums

_DURATION_CAP = 43_200
SORTS = ("start_time", "duration_seconds", "total_cost", "total_tokens", "context_volume", "turn_count", "tool_call_count")


def session_summary(sessions: DataFrame, turns: DataFrame, calls: DataFrame) -> DataFrame:
    """Sessions with cost, tokens, hit rate, turns and calls of their own rows, not the stored sums."""
    by_turn = turns.groupBy("session_id").agg(F.sum("cost_usd").alias("total_cost"), *token_sums(), F.count("*").alias("turn_count"))
    by_call = calls.groupBy("session_id").agg(F.count("*").alias("tool_call_count"))
    base = sessions.select("session_id", "start_time", "end_time", "duration_seconds", "model", "project_path", "project_name", "source_type")
    out = base.join(by_turn, "session_id", "left").join(by_call, "session_id", "left")
    out = out.na.fill(0, ["total_cost", "total_tokens", "context_volume", "turn_count", "tool_call_count", *[f"{c}_tokens" for c in CATEGORIES]])
    whole = F.col("cache_read_tokens") + F.col("cache_creation_tokens") + F.col("input_tokens")
    return out.withColumn("cache_hit_rate", F.coalesce(F.round(F.try_divide(F.col("cache_read_tokens"), whole), 4), F.lit(0.0)))


def list_sessions(summary: DataFrame, r: Range, f: Filters = NO_FILTERS, sort: str = "start_time", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of sessions in the order of a whitelisted column, then of session_id."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    return session_filters(summary.filter(r.holds("start_time")), f).orderBy(order, "session_id").offset(offset).limit(limit)


def count_sessions(summary: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    return session_filters(summary.filter(r.holds("start_time")), f).agg(F.count("*").alias("total"))


def session_detail(summary: DataFrame, turns: DataFrame, calls: DataFrame, errors: DataFrame, session_id: str | DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """One session's summary, turns by time, calls and errors; session_id is its id, or a table whose one row has it."""
    own = lambda df: only(df, "session_id", session_id)
    return own(summary), own(turns).orderBy("timestamp", "turn_id"), own(calls).orderBy("turn_id", "tool_call_id"), own(errors).orderBy("timestamp", "error_id")


def session_stats(summary: DataFrame, r: Range, f: Filters = NO_FILTERS, null_as_cap: bool = False) -> DataFrame:
    """One row: sessions, turns, mean, capped mean and exact median duration, cost, models.

    The capped mean leaves out sessions without a duration; null_as_cap counts them at the cap.
    """
    rows = session_filters(summary.filter(r.holds("start_time")), f)
    duration = F.col("duration_seconds")
    capped = F.least(duration, F.lit(_DURATION_CAP))
    capped = F.coalesce(capped, F.lit(_DURATION_CAP)) if null_as_cap else F.when(duration.isNotNull(), capped)
    return rows.agg(
        F.count("*").alias("sessions"), F.coalesce(F.sum("turn_count"), F.lit(0)).alias("turns"), F.avg(duration).alias("avg_duration"), F.avg(capped).alias("avg_capped_duration"),
        F.median(duration).alias("median_duration"), F.coalesce(F.sum("total_cost"), F.lit(0.0)).alias("total_cost"), F.avg("total_cost").alias("avg_cost"),
        F.countDistinct("model").alias("models"),
    )


def context_pressure(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS, limit: int | None = None) -> DataFrame:
    """Per session: peak and mean utilisation of the context window, turns above 0.6 and 0.8, truncated turns."""
    use = F.col("utilisation")
    rows = with_context(turn_filters(turns.filter(r.holds("timestamp")), sessions, f))
    out = rows.groupBy("session_id").agg(
        F.count("*").alias("assistant_turns"), F.max(use).alias("peak_utilisation"), F.max("context_tokens").alias("peak_context_tokens"), F.avg(use).alias("avg_utilisation"),
        F.count_if(use > 0.6).alias("turns_over_60"), F.count_if(use > 0.8).alias("turns_over_80"), F.count_if(F.col("stop_reason") == "max_tokens").alias("max_tokens_turns"),
    )
    out = out.withColumn("pressure_share", F.try_divide("turns_over_60", "assistant_turns"))
    return out.orderBy(F.desc("peak_utilisation"), "session_id").limit(limit) if limit else out


def context_pressure_stats(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """One row: sessions whose peak is above 0.6 and 0.8, their shares, the worst peak, truncated turns."""
    rows = context_pressure(turns, sessions, r, f)
    over = lambda x: F.count_if(F.col("peak_utilisation") > x)
    return rows.agg(
        F.count("*").alias("sessions"), over(0.6).alias("sessions_over_60"), over(0.8).alias("sessions_over_80"), F.coalesce(F.try_divide(over(0.6), F.count("*")), F.lit(0.0)).alias("rate_over_60"),
        F.coalesce(F.try_divide(over(0.8), F.count("*")), F.lit(0.0)).alias("rate_over_80"), F.coalesce(F.max("peak_utilisation"), F.lit(0.0)).alias("worst_peak"),
        F.coalesce(F.sum("max_tokens_turns"), F.lit(0)).alias("truncations"),
    )


def context_histogram(pressure: DataFrame) -> DataFrame:
    """Sessions by peak utilisation in six buckets, zeros included."""
    names = ("0-20%", "20-40%", "40-60%", "60-80%", "80-100%", ">100%")
    peak = F.col("peak_utilisation")
    at = F.when(peak > 1, 5).otherwise(F.least(F.floor(peak * 5), F.lit(4))).cast("long")
    by = pressure.groupBy(at.alias("position")).agg(F.count("*").alias("sessions"))
    spine = pressure.sparkSession.range(len(names)).select(F.col("id").alias("position"), F.element_at(F.array(*map(F.lit, names)), F.col("id").cast("int") + 1).alias("bucket"))
    return spine.join(by, "position", "left").na.fill(0)


def cumulative_cost(turns: DataFrame, session_id: str | None = None, block: str = BLOCK) -> DataFrame:
    """Running cost inside each session, in the order of time and turn; a long session is summed in blocks of time."""
    rows = turns if session_id is None else turns.filter(F.col("session_id") == session_id)
    rows = rows.select("session_id", "turn_id", "timestamp", "cost_usd", *[f"{c}_tokens" for c in CATEGORIES])
    return running_sums(rows, ["session_id"], ["timestamp", "turn_id"], {"cumulative_cost": F.col("cost_usd")}, length=block)


def calls_per_turn(calls: DataFrame) -> DataFrame:
    """The calls of each turn, in the order of their ids."""
    call = F.struct("tool_call_id", "tool_name", "success", "duration_ms")
    return calls.groupBy("session_id", "turn_id").agg(F.count("*").alias("calls"), F.array_sort(F.collect_list(call)).alias("tool_calls"))


def list_models(sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    return session_filters(sessions.filter(r.holds("start_time")), f).filter("model is not null").select("model").distinct().orderBy("model")


def list_projects(sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    rows = session_filters(sessions.filter(r.holds("start_time")), f).filter("project_path is not null")
    return rows.groupBy("project_path").agg(F.max("project_name").alias("project_name"), F.count("*").alias("sessions"), F.max("start_time").alias("last_active"))


def list_sources(sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    return session_filters(sessions.filter(r.holds("start_time")), f).groupBy("source_type").agg(F.count("*").alias("sessions"))
