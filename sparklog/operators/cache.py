"""Prompt-cache efficiency, over all assistant turns."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.functions.exprs import NO_FILTERS, Filters, Range, local_date, savings_rate, total, turn_filters


def _rows(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters) -> DataFrame:
    return turn_filters(turns.filter(F.col("role") == "assistant").filter(r.holds("timestamp")), sessions, f)


def _sums() -> list:
    return [total("input_tokens", "input_tokens"), total("cache_creation_tokens", "cache_creation_tokens"), total("cache_read_tokens", "cache_read_tokens")]


def _hit_rate():
    return F.coalesce(F.try_divide(F.col("cache_read_tokens"), F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens")), F.lit(0.0))


def cache_metrics(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """One row: hit rate, savings in USD, and a label (above 0.8 effective, from 0.5 moderate, else ineffective)."""
    saved = total(F.col("cache_read_tokens") * savings_rate() / 1_000_000, "savings_usd")
    out = _rows(turns, sessions, r, f).agg(*_sums(), saved).withColumn("hit_rate", _hit_rate())
    return out.withColumn("label", F.when(F.col("hit_rate") > 0.8, "effective").when(F.col("hit_rate") >= 0.5, "moderate").otherwise("ineffective"))


def cache_trend(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS, tz: str = "UTC") -> DataFrame:
    """Per local day: hit rate, reads, writes, uncached and all input."""
    out = _rows(turns, sessions, r, f).groupBy(local_date("timestamp", tz).alias("date")).agg(*_sums()).withColumn("hit_rate", _hit_rate())
    return out.withColumn("total_input", F.col("input_tokens") + F.col("cache_creation_tokens") + F.col("cache_read_tokens"))


def cache_by_session(sessions: DataFrame, turns: DataFrame, r: Range) -> DataFrame:
    """Per session that started in the range: tokens of all its turns, hit rate, savings; sessions without turns stay."""
    saved = total(F.col("cache_read_tokens") * savings_rate() / 1_000_000, "savings_usd")
    sums = turns.groupBy("session_id").agg(*_sums(), saved)
    out = sessions.filter(r.holds("start_time")).select("session_id").join(sums, "session_id", "left").na.fill(0)
    return out.withColumn("hit_rate", F.round(_hit_rate(), 4))
