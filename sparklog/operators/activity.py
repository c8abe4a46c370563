"""Activity over hours, days and weeks."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.exprs import NO_FILTERS, Filters, Range, bucket, cost_rows, local_date, local_ts, turn_filters


def _rows(turns: DataFrame, sessions: DataFrame | None, r: Range, f: Filters) -> DataFrame:
    rows = cost_rows(turns).filter(r.holds("timestamp"))
    return rows if f == NO_FILTERS else turn_filters(rows, sessions, f)


def hourly_activity(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS, tz: str = "UTC", view: bool = False) -> DataFrame:
    """24 rows: turns, sessions, cost and tokens by local hour. view: all assistant turns, rounded."""
    rows = turns.filter(F.col("role") == "assistant").filter(r.holds("timestamp")) if view else _rows(turns, None, r, NO_FILTERS)
    rows = turn_filters(rows, sessions, f)
    both = F.col("input_tokens") + F.col("output_tokens")
    cost, tokens = F.avg("cost_usd"), F.avg(both)
    by = rows.groupBy(F.hour(local_ts("timestamp", tz)).cast("long").alias("hour_of_day")).agg(
        F.count("*").alias("message_count"), F.countDistinct("session_id").alias("session_count"), (F.round(cost, 6) if view else cost).alias("avg_cost"),
        F.sum(both).alias("total_tokens"), F.sum("cost_usd").alias("total_cost"), (F.round(tokens, 0) if view else tokens).alias("avg_tokens_per_turn"),
    )
    hours = turns.sparkSession.range(24).withColumnRenamed("id", "hour_of_day")
    return hours.join(by, "hour_of_day", "left").na.fill(0)


def daily_activity(turns: DataFrame, r: Range, tz: str = "UTC", sessions: DataFrame | None = None, f: Filters = NO_FILTERS) -> DataFrame:
    return _rows(turns, sessions, r, f).groupBy(local_date("timestamp", tz).alias("date")).agg(F.count("*").alias("turns"))


def activity_heatmap(turns: DataFrame, r: Range, tz: str = "UTC", sessions: DataFrame | None = None, f: Filters = NO_FILTERS) -> DataFrame:
    """Turns by day of week (0 is Sunday) and hour."""
    at = local_ts("timestamp", tz)
    return _rows(turns, sessions, r, f).groupBy((F.dayofweek(at) - 1).alias("dow"), F.hour(at).alias("hour")).agg(F.count("*").alias("turns"))


def weekly_activity(turns: DataFrame, r: Range, tz: str = "UTC", sessions: DataFrame | None = None, f: Filters = NO_FILTERS) -> DataFrame:
    return _rows(turns, sessions, r, f).groupBy(bucket("timestamp", "week", tz).cast("date").alias("week")).agg(F.count("*").alias("turns"))


def calendar_fill(daily: DataFrame, end: dt.date, days: int = 364, value: str = "turns") -> DataFrame:
    """A row for every day from the Sunday at or before end - days, 0 where daily has none."""
    first = end - dt.timedelta(days=days)
    first -= dt.timedelta(days=(first.weekday() + 1) % 7)
    spine = daily.sparkSession.range((end - first).days + 1).select(F.date_add(F.lit(first), F.col("id").cast("int")).alias("date"))
    summed = daily.groupBy("date").agg(F.sum(value).alias(value))
    return spine.join(summed, "date", "left").na.fill(0)


def peak_hour(hourly: DataFrame) -> DataFrame:
    """The hour with most turns, the first on ties; null without turns."""
    best = F.max_by("hour_of_day", F.struct("message_count", -F.col("hour_of_day")))
    return hourly.agg(F.when(F.max("message_count") > 0, best).alias("peak_hour"), F.max("message_count").alias("messages"))


def turns_today(daily: DataFrame, now: dt.datetime, tz: str = "UTC") -> DataFrame:
    """The turns of now's local date."""
    today = F.to_date(local_ts(F.lit(now).cast("timestamp_ntz"), tz))
    return daily.filter(F.col("date") == today).agg(F.coalesce(F.sum("turns"), F.lit(0)).alias("turns"))
