"""Predicates, buckets, prices and classes as Column builders and small table filters."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.schemas import DEFAULT_RATE, RATES, SYNTHETIC_MODEL, Rate

CATEGORIES = ("input", "output", "cache_creation", "cache_read")
_DAYS = {"7d": 7, "30d": 30, "90d": 90}


@dataclass(frozen=True)
class Range:
    """Half-open: start <= t < end, both UTC wall-clock times."""

    start: dt.datetime
    end: dt.datetime

    def holds(self, column: Column | str) -> Column:
        column = F.col(column) if isinstance(column, str) else column
        low, high = (F.lit(t).cast("timestamp_ntz") for t in (self.start.isoformat(" "), self.end.isoformat(" ")))
        return (column >= low) & (column < high)


@dataclass(frozen=True)
class Filters:
    """Optional filters; model is a LIKE substring."""

    model: str | None = None
    project: str | None = None
    source: str | None = None


NO_FILTERS = Filters()


def only(rows: DataFrame, key: str, value: str | DataFrame) -> DataFrame:
    """The rows whose key is the value, or that of a table's first row."""
    if isinstance(value, DataFrame):
        return rows.join(F.broadcast(value.select(key).limit(1)), key, "left_semi")  # one row
    return rows.filter(F.col(key) == value)


def period(name: str, now: dt.datetime, tz: str = "UTC") -> Range:
    """today (from midnight in tz), 7d, 30d, 90d, all; any other name is 7d. now is UTC wall clock."""
    if name == "today":
        local = now.replace(tzinfo=dt.UTC).astimezone(ZoneInfo(tz))
        midnight = local.replace(hour=0, minute=0, second=0, microsecond=0)
        return Range(midnight.astimezone(dt.UTC).replace(tzinfo=None), now)
    if name == "all":
        return Range(dt.datetime(2020, 1, 1), now)
    return Range(now - dt.timedelta(days=_DAYS.get(name, 7)), now)


def is_cost_row() -> Column:
    return (F.col("role") == "assistant") & (F.col("model") != SYNTHETIC_MODEL)


def cost_rows(turns: DataFrame) -> DataFrame:
    """Assistant turns with a real model: the rows that cost something."""
    return turns.filter(is_cost_row())


def session_filters(sessions: DataFrame, f: Filters) -> DataFrame:
    if f.model:
        sessions = sessions.filter(F.col("model").like(f"%{f.model}%"))
    if f.project:
        sessions = sessions.filter(F.col("project_path") == f.project)
    if f.source:
        sessions = sessions.filter(F.col("source_type") == f.source)
    return sessions


def turn_filters(turns: DataFrame, sessions: DataFrame, f: Filters, keep_user: bool = False) -> DataFrame:
    """The model filter on turns; project and source through the sessions. keep_user lets user rows pass the model filter."""
    if f.model:
        like = F.col("model").like(f"%{f.model}%")
        turns = turns.filter((F.col("role") == "user") | like if keep_user else like)
    if f.project or f.source:
        chosen = session_filters(sessions, Filters(project=f.project, source=f.source)).select("session_id")
        turns = turns.join(chosen, "session_id", "left_semi")
    return turns


def local_ts(column: Column | str, tz: str) -> Column:
    """A UTC wall clock as the zone's wall clock."""
    column = F.col(column) if isinstance(column, str) else column
    return F.convert_timezone(F.lit("UTC"), F.lit(tz), column)


def bucket(column: Column | str, unit: str, tz: str = "UTC") -> Column:
    """Local time cut to hour, day, week (from Monday) or month."""
    if unit not in ("hour", "day", "week", "month"):
        raise ValueError(f"unknown time bucket: {unit}")
    return F.date_trunc(unit, local_ts(column, tz)).cast("timestamp_ntz")


def local_date(column: Column | str, tz: str = "UTC") -> Column:
    return F.to_date(local_ts(column, tz))


def _by_prefix(model: Column | str, value, rates: Sequence[Rate]) -> Column:
    model = F.lower(F.col(model) if isinstance(model, str) else model)
    out = F
    for r in rates:
        out = out.when(model.startswith(r.prefix), F.lit(float(value(r))))
    return out.otherwise(F.lit(float(value(DEFAULT_RATE))))


def rate(category: str, model: Column | str = "model", rates: Sequence[Rate] = RATES) -> Column:
    """USD per million tokens of a category, by the first prefix that the model id has."""
    return _by_prefix(model, lambda r: getattr(r, category), rates)


def savings_rate(model: Column | str = "model", rates: Sequence[Rate] = RATES) -> Column:
    """What a million tokens read from cache save against input price."""
    return _by_prefix(model, lambda r: r.input - r.cache_read, rates)


def has_rate(model: Column | str = "model", rates: Sequence[Rate] = RATES) -> Column:
    model = F.lower(F.col(model) if isinstance(model, str) else model)
    found = F.lit(False)
    for r in rates:
        found = found | model.startswith(r.prefix)
    return F.coalesce(found, F.lit(False))


def category_cost(category: str, rates: Sequence[Rate] = RATES) -> Column:
    """A row's cost of one token category."""
    return F.col(f"{category}_tokens") * rate(category, rates=rates) / 1_000_000


def with_cost(turns: DataFrame, rates: Sequence[Rate] = RATES, out: str = "cost_usd") -> DataFrame:
    """turns with the cost at list prices."""
    total = category_cost(CATEGORIES[0], rates)
    for c in CATEGORIES[1:]:
        total = total + category_cost(c, rates)
    return turns.withColumn(out, total)


def with_rate_table(turns: DataFrame, rates: DataFrame, out: str = "cost_usd") -> DataFrame:
    """As with_cost, for a small table (priority, prefix, input, output, cache_creation, cache_read) of a user."""
    default = F.struct(*[F.lit(float(getattr(DEFAULT_RATE, c))).alias(c) for c in CATEGORIES])
    models = turns.select("model").distinct()
    match = F.lower(models["model"]).startswith(rates["prefix"])
    found = models.join(F.broadcast(rates), match, "left").groupBy("model").agg(F.min_by(F.struct(*[F.col(c).cast("double").alias(c) for c in CATEGORIES]), "priority").alias("_rate"))
    joined = turns.join(F.broadcast(found), turns["model"].eqNullSafe(found["model"]), "left").drop(found["model"])
    chosen = F.coalesce(F.when(F.col("_rate.input").isNotNull(), F.col("_rate")), default)
    total = sum((F.col(f"{c}_tokens") * chosen[c] / 1_000_000 for c in CATEGORIES[1:]), F.col("input_tokens") * chosen["input"] / 1_000_000)
    return joined.withColumn(out, total).drop("_rate")


def total(column: Column | str, name: str | None = None) -> Column:
    """SUM that is 0 over no rows."""
    out = F.coalesce(F.sum(column), F.lit(0))
    return out.alias(name) if name else out


def token_sums() -> list[Column]:
    """The four token counters, input + output, and all four."""
    four = [total(f"{c}_tokens", f"{c}_tokens") for c in CATEGORIES]
    two = total(F.col("input_tokens") + F.col("output_tokens"), "total_tokens")
    return [*four, two, total(sum((F.col(f"{c}_tokens") for c in CATEGORIES[1:]), F.col("input_tokens")), "context_volume")]


def context_tokens() -> Column:
    return F.col("input_tokens") + F.col("cache_read_tokens") + F.col("cache_creation_tokens")


def with_context(turns: DataFrame) -> DataFrame:
    """Assistant turns with context tokens, the model's window and its utilisation."""
    model = F.lower(F.coalesce("model", F.lit("")))
    large = model.contains("-1m") | model.contains("1m-context") | (context_tokens() > 200_000)
    rows = turns.filter(F.col("role") == "assistant").withColumn("context_tokens", context_tokens())
    rows = rows.withColumn("window_size", F.when(large, 1_000_000).otherwise(200_000))
    return rows.withColumn("utilisation", F.col("context_tokens") / F.col("window_size"))


def model_class(model: Column | str = "model") -> Column:
    """fable, opus, sonnet or other, by the first name that the id contains."""
    model = F.lower(F.coalesce(F.col(model) if isinstance(model, str) else model, F.lit("")))
    out = F
    for name in ("fable", "opus", "sonnet"):
        out = out.when(model.contains(name), name)
    return out.otherwise("other")


def tool_class(kind: Column | str = "tool_type") -> Column:
    kind = F.col(kind) if isinstance(kind, str) else kind
    return F.when(kind == "mcp", "mcp").otherwise("builtin")


def classify_tool(name: Column | str = "tool_name") -> tuple[Column, Column]:
    """Type and server of a tool: mcp__server__tool has at least three parts, anything else is built in."""
    name = F.col(name) if isinstance(name, str) else name
    parts = F.split(name, "__")
    mcp = name.startswith("mcp__") & (F.size(parts) >= 3)
    return F.when(mcp, "mcp").otherwise("builtin"), F.when(mcp, parts[1])


def skill_of_call() -> Column:
    return F.coalesce("skill_name", F.get_json_object("parameters", "$.skill"))


def skill_calls(calls: DataFrame) -> DataFrame:
    """Calls of the Skill tool with the skill they name."""
    return calls.filter(F.col("tool_name") == "Skill").withColumn("skill", skill_of_call())


def estimated_tokens(description: Column | str = "skill_description") -> Column:
    """A quarter of the description's length, rounded up; 45 without a description."""
    description = F.col(description) if isinstance(description, str) else description
    return F.when(F.length(description) > 0, F.ceil(F.length(description) / 4)).otherwise(45).cast("long")


def known_rate(successes: Column, known: Column) -> Column:
    """A share of known results; null, not 0, without any."""
    return F.try_divide(successes, known)
