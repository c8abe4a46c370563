"""Cost and token aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.functions.exprs import CATEGORIES, NO_FILTERS, Filters, Range, bucket, category_cost, cost_rows, local_date, session_filters, token_sums, total, turn_filters

_TOKENS = [f"{c}_tokens" for c in CATEGORIES]


def _rows(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters) -> DataFrame:
    return turn_filters(cost_rows(turns).filter(r.holds("timestamp")), sessions, f)


def _category_costs() -> list[Column]:
    return [total(category_cost(c), f"{c}_cost") for c in CATEGORIES]


def daily_cost(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS, tz: str = "UTC") -> DataFrame:
    """Local day and model: cost, tokens, turns, sessions."""
    rows = _rows(turns, sessions, r, f)
    return rows.groupBy(local_date("timestamp", tz).alias("date"), "model").agg(
        F.sum("cost_usd").alias("total_cost"), *[F.sum(c).alias(c) for c in _TOKENS], F.count("*").alias("turn_count"), F.countDistinct("session_id").alias("session_count")
    )


def cost_by_model(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Per model: stored cost, costs by category at list prices, tokens, sessions."""
    return _rows(turns, sessions, r, f).groupBy("model").agg(
        F.sum("cost_usd").alias("total_cost"), *_category_costs(), *token_sums(), F.countDistinct("session_id").alias("session_count")
    )


def cost_by_project(sessions: DataFrame, turns: DataFrame, r: Range, f: Filters = NO_FILTERS, count: str = "cost_sessions") -> DataFrame:
    """Per project of sessions that started in the range; count: cost_sessions, or all sessions of the range."""
    chosen = session_filters(sessions, f).filter(r.holds("start_time")).select("session_id", F.coalesce("project_path", F.lit("unknown")).alias("project_path"))
    joined = cost_rows(turns).join(chosen, "session_id")
    out = joined.groupBy("project_path").agg(F.sum("cost_usd").alias("total_cost"), *_category_costs(), *token_sums(), F.countDistinct("session_id").alias("session_count"))
    if count == "all":
        sessions_n = chosen.groupBy("project_path").agg(F.count("*").alias("session_count"))
        out = out.drop("session_count").join(sessions_n, "project_path", "left")
    return out


def cost_trend(turns: DataFrame, sessions: DataFrame, r: Range, unit: str = "day", f: Filters = NO_FILTERS, tz: str = "UTC") -> DataFrame:
    """Cost and tokens per hour, day, week or month."""
    return _rows(turns, sessions, r, f).groupBy(bucket("timestamp", unit, tz).alias("bucket")).agg(
        F.sum("cost_usd").alias("total_cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count("*").alias("turn_count")
    )


def total_cost(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """One row: cost, costs by category, tokens; zeros when there is nothing."""
    return _rows(turns, sessions, r, f).agg(total("cost_usd", "total_cost"), *_category_costs(), *token_sums(), F.countDistinct("session_id").alias("session_count"))


def token_totals(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Two rows, period (filtered) and all_time (not filtered), from one scan: the six token sums."""
    rows = cost_rows(turns)
    if f != NO_FILTERS:
        inside = turn_filters(rows.filter(r.holds("timestamp")), sessions, f).select("turn_id", F.lit(True).alias("_in"))
        rows = rows.join(inside, "turn_id", "left").withColumn("_in", F.coalesce("_in", F.lit(False)))
    else:
        rows = rows.withColumn("_in", r.holds("timestamp"))
    blocks = rows.withColumn("block", F.explode(F.when(F.col("_in"), F.array(F.lit("all_time"), F.lit("period"))).otherwise(F.array(F.lit("all_time")))))
    summed = blocks.groupBy("block").agg(*token_sums())
    names = rows.sparkSession.createDataFrame([("all_time",), ("period",)], "block string")
    return names.join(summed, "block", "left").na.fill(0)


def cost_pivot(daily: DataFrame, models: list[str]) -> DataFrame:
    """Daily cost with a column for each model."""
    return daily.groupBy("date").pivot("model", models).agg(F.sum("total_cost")).na.fill(0.0)


def avg_daily_cost(daily: DataFrame) -> DataFrame:
    return daily.agg(F.try_divide(F.sum("total_cost"), F.countDistinct("date")).alias("avg_daily_cost"), F.countDistinct("date").alias("days"))


def model_share(by_model: DataFrame) -> DataFrame:
    """Each model's share of cost in percent, and whether it is the top one."""
    whole = by_model.agg(F.sum("total_cost").alias("_all"), F.max_by("model", F.struct("total_cost", "model")).alias("_top"))
    joined = by_model.select("model", "total_cost").crossJoin(F.broadcast(whole))  # one row
    return joined.select("model", "total_cost", F.coalesce(F.try_divide(F.col("total_cost") * 100, F.col("_all")), F.lit(0.0)).alias("share_pct"), (F.col("model") == F.col("_top")).alias("is_top"))


def token_flow(totals: DataFrame) -> DataFrame:
    """Edges of the token flow of a one-row total; the counters are disjoint, so uncached is input."""
    edges = [("input", "cache_write", F.col("cache_creation_tokens")), ("input", "uncached_input", F.col("input_tokens")), ("cache_read", "output", F.col("cache_read_tokens")),
             ("uncached_input", "output", F.least("input_tokens", "output_tokens"))]
    rows = F.array(*[F.struct(F.lit(a).alias("source"), F.lit(b).alias("target"), v.cast("long").alias("value")) for a, b, v in edges])
    return totals.select(F.inline(rows)).filter("value > 0")


def half_trend(series: DataFrame, order: str, value: str) -> DataFrame:
    """Percent change of the second half's mean against the first half's; null below four points.

    series is small, one row per bucket.
    """
    ordered = F.array_sort(F.collect_list(F.struct(order, value)))
    rows = series.agg(ordered.alias("s")).withColumn("n", F.size("s")).withColumn("h", F.floor(F.col("n") / 2).cast("int"))
    mean = lambda part: F.aggregate(part, F.lit(0.0), lambda a, x: a + x[value]) / F.size(part)
    first, second = mean(F.slice("s", F.lit(1), F.col("h"))), mean(F.slice("s", F.col("h") + 1, F.col("n") - F.col("h")))
    return rows.select(F.when((F.col("n") >= 4) & (first > 0), (second - first) / first * 100).alias("change_pct"), F.col("n").cast("long").alias("points"))


def subscription_value(cost: DataFrame, monthly_fee: float, days: int, cost_col: str = "total_cost") -> DataFrame:
    """Prorated fee (30.4375 days a month), savings, multiple of the fee, and whether the fee isn't reached."""
    fee = monthly_fee * days / 30.4375
    spent = F.col(cost_col)
    return cost.withColumns({"prorated_fee": F.lit(fee), "savings": spent - fee, "roi_multiple": F.try_divide(spent, F.lit(fee)), "underwater": (F.lit(fee) > 0) & (spent < fee)})
