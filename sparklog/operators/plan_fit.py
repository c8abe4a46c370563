"""Usage windows against subscription tiers, for many accounts at once: `by` names the account columns."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.exprs import model_class
from sparklog.plans.windows import FIVE_HOURS, WEEK, anchored_windows
from sparklog.schemas import TIERS

# The thresholds of the decision.
NEAR, UPGRADE_SHARE, UPGRADE_WINDOWS = 0.9, 0.15, 2
WEEKLY_WINDOWS, WEEKLY_SHARE = 2, 0.5
FIT_TYPICAL, FIT_PEAK, FIT_QUANTILE = 0.7, 1.0, 0.9
PAYG_RATIO, SUBSCRIBE_SHARE = 0.6, 0.8
RISING, FALLING, TREND_WINDOWS, TREND_HALF = 1.35, 0.74, 6, 2
MARGIN_HIGH, MARGIN_MEDIUM = 0.15, 0.05
_CONFIDENCE = ("low", "medium", "high")


def with_fill(windows: DataFrame, ceiling: float | Column) -> DataFrame:
    """cost / ceiling; 0 for a ceiling of 0."""
    ceiling = F.lit(float(ceiling)) if not isinstance(ceiling, Column) else ceiling
    return windows.withColumn("fill", F.when(ceiling > 0, F.col("cost") / ceiling).otherwise(0.0))


def nearest_rank(column: str, q: float) -> Column:
    return F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY {column})")


def window_stats(windows: DataFrame, by: Sequence[str], ceiling: float | Column) -> DataFrame:
    """Per account: windows, peak, 95th percentile and median fill, windows near the limit, peak cost."""
    rows = with_fill(windows, ceiling)
    return rows.groupBy(*by).agg(
        F.count("*").alias("windows"), F.max("fill").alias("peak_fill"), nearest_rank("fill", 0.95).alias("p95_fill"), F.median("fill").alias("median_fill"),
        F.count_if(F.col("fill") >= NEAR).alias("near_limit"), F.max("cost").alias("peak_cost"),
    )


def weekly_by_class(turns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Weekly windows of all turns and of each model class."""
    rows = turns.select(*by, "timestamp", "cost_usd", F.explode(F.array(F.lit("all"), model_class())).alias("class"))
    return anchored_windows(rows, [*by, "class"], WEEK)


def activity_span(turns: DataFrame, by: Sequence[str], now: dt.datetime) -> DataFrame:
    """Per account: active UTC days, whole days since the last turn, days from first to last (at least 1), cost."""
    seconds = lambda a, b: F.timestamp_diff("SECOND", a, b)
    moment = F.lit(now.isoformat(" ")).cast("timestamp_ntz")
    rows = turns.groupBy(*by).agg(F.countDistinct(F.to_date("timestamp")).alias("active_days"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"), F.sum("cost_usd").alias("total_cost"))
    recency = F.greatest(F.floor(seconds(F.col("last"), moment) / 86400), F.lit(0))
    span = F.greatest(F.timestamp_diff("MICROSECOND", F.col("first"), F.col("last")) / 86_400_000_000, F.lit(1.0))
    return rows.select(*by, "active_days", recency.alias("recency_days"), span.alias("span_days"), "total_cost")


def tier_table(spark, overrides: DataFrame | None = None) -> DataFrame:
    """The tiers with their fee and ceilings; overrides (tier, five_hour, weekly) count where finite and not negative."""
    base = spark.createDataFrame([tuple(map(lambda x: float(x) if not isinstance(x, str) else x, t)) for t in TIERS], "tier string, fee double, five_hour double, weekly double")
    if overrides is None:
        return base
    joined = base.join(overrides.select("tier", F.col("five_hour").alias("_5"), F.col("weekly").alias("_7")), "tier", "left")
    valid = lambda c: F.when((F.col(c) >= 0) & ~F.isnan(c) & (F.col(c) != float("inf")), F.col(c))
    return joined.select("tier", "fee", F.coalesce(valid("_5"), "five_hour").alias("five_hour"), F.coalesce(valid("_7"), "weekly").alias("weekly"))


def calibrate(tiers: DataFrame, peak_five_hour: float | Column, peak_weekly: float | Column) -> DataFrame:
    """Ceilings raised to observed peaks, for display, with flags where they were."""
    return tiers.select(
        "tier", F.greatest("five_hour", F.lit(peak_five_hour)).alias("five_hour"), (F.lit(peak_five_hour) > F.col("five_hour")).alias("five_hour_calibrated"),
        F.greatest("weekly", F.lit(peak_weekly)).alias("weekly"), (F.lit(peak_weekly) > F.col("weekly")).alias("weekly_calibrated"),
    )


#: The two kinds of usage windows by the name of their ceiling, and the ending of their columns.
SPANS, _TAGS = {"five_hour": FIVE_HOURS, "weekly": WEEK}, {"five_hour": "5", "weekly": "7"}


def usage_windows(turns: DataFrame, by: Sequence[str]) -> DataFrame:
    """Both kinds of windows of each account from one pass over its sorted turns: by..., span, anchor, turns, cost."""
    return anchored_windows(turns, by, SPANS)


def _both(w5: DataFrame, w7: DataFrame) -> DataFrame:
    return w5.withColumn("span", F.lit("five_hour")).unionByName(w7.withColumn("span", F.lit("weekly")))


def usage_summary(windows: DataFrame, tiers: DataFrame, by: Sequence[str], own: DataFrame | str | None = None) -> DataFrame:
    """One row per account from its windows of both kinds, in one aggregation: pressure under each tier, trend, recent pressure.

    t0, t1, .. (a struct per tier, smallest first), windows5, trend, early_mean, late_mean, recent_pressure. own:
    by..., five_hour and weekly, the ceilings of each account's plan, or the tier that all have, for the last. A tier's ceiling divides all costs
    of an account alike, so ranks are taken of the costs and divided then: windows are not repeated for each tier.
    """
    by = list(by)
    named = lambda k, c: F.max(F.when(F.col("tier") == TIERS[k].name, F.col(c)))
    limits = tiers.agg(*[named(k, c).alias(f"_{c}{k}") for k in range(len(TIERS)) for c in SPANS])
    rows = windows.crossJoin(F.broadcast(limits))  # one row
    if isinstance(own, DataFrame):
        rows = rows.join(own.select(*by, *[F.col(c).alias(f"_own_{c}") for c in SPANS]), by, "left")
    else:
        k = next((str(k) for k, t in enumerate(TIERS) if t.name == own), None)
        rows = rows.withColumns({f"_own_{c}": F.col(f"_{c}{k}") if k else F.lit(None).cast("double") for c in SPANS})
    account, five = Window.partitionBy(*by), F.col("span") == "five_hour"
    begin = F.when(five, F.col("anchor"))
    rows = rows.withColumns({"_first": F.min(begin).over(account), "_last": F.max(begin).over(account)})
    rows = rows.withColumn("_late", 2 * F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("anchor")) >= F.timestamp_diff("MICROSECOND", F.col("_first"), F.col("_last")))
    fill = lambda ceiling: F.when(ceiling > 0, F.col("cost") / ceiling).otherwise(0.0)
    near = lambda ceiling: F.coalesce(fill(ceiling) >= NEAR, F.lit(False))
    late, early = F.avg(F.when(five & F.col("_late"), F.col("cost"))), F.avg(F.when(five & ~F.col("_late"), F.col("cost")))
    columns = [F.count_if(five & F.col("_late")).alias("_ln"), late.alias("late_mean"), early.alias("early_mean")]
    pressed = F.lit(False)
    for c, tag in _TAGS.items():
        mine = F.col("span") == c
        columns += [F.count_if(mine).alias(f"_n{tag}"), F.max(F.when(mine, F.col("cost"))).alias(f"_peak{tag}")]
        columns.append(F.expr(f"percentile_disc({FIT_QUANTILE}) WITHIN GROUP (ORDER BY CASE WHEN span = '{c}' THEN cost END)").alias(f"_rank{tag}"))
        for k in range(len(TIERS)):
            columns += [F.count_if(mine & near(F.col(f"_{c}{k}"))).alias(f"_near{tag}{k}"), F.max(f"_{c}{k}").alias(f"_{c}{k}")]
        pressed |= mine & near(F.col(f"_own_{c}"))
    columns.append(F.coalesce(F.bool_or(F.coalesce(F.col("_late") & pressed, F.lit(False))), F.lit(False)).alias("recent_pressure"))
    out = rows.groupBy(*by).agg(*columns)

    def tier(k: int) -> Column:
        x: dict[str, Column] = {}
        for c, tag in _TAGS.items():
            of = lambda v, c=c: F.coalesce(F.when(F.col(f"_{c}{k}") > 0, F.col(v) / F.col(f"_{c}{k}")), F.lit(0.0))
            n = F.col(f"_n{tag}")
            x |= {f"n{tag}": n, f"near{tag}": F.col(f"_near{tag}{k}"), f"share{tag}": F.coalesce(F.try_divide(F.col(f"_near{tag}{k}"), n), F.lit(0.0)), f"p90_{tag}": of(f"_rank{tag}"), f"peak{tag}": of(f"_peak{tag}")}
        x["strained5"] = (x["near5"] >= UPGRADE_WINDOWS) & (x["share5"] >= UPGRADE_SHARE)
        x["strained7"] = (x["n7"] > 0) & (x["share7"] >= _weekly_limit(x["n7"]))
        x["fits"] = (x["p90_5"] <= FIT_TYPICAL) & (x["p90_7"] <= FIT_TYPICAL) & (x["peak5"] <= FIT_PEAK) & (x["peak7"] <= FIT_PEAK)
        x["strained"] = x["strained5"] | x["strained7"]
        return F.struct(*[v.alias(name) for name, v in x.items()])

    return out.select(*by, *[tier(k).alias(f"t{k}") for k in range(len(TIERS))], F.col("_n5").alias("windows5"), _trend(F.col("_n5"), F.col("_ln")).alias("trend"), "early_mean", "late_mean", "recent_pressure")


def _trend(n: Column, late_n: Column) -> Column:
    """rising, falling or flat by the mean cost of windows after and before the middle; unknown with too few."""
    few = (n < TREND_WINDOWS) | (late_n < TREND_HALF) | (n - late_n < TREND_HALF)
    ratio = F.try_divide("late_mean", "early_mean")
    return F.when(few, "unknown").when(F.col("early_mean") <= 0, F.when(F.col("late_mean") > 0, "rising").otherwise("flat")).when(ratio >= RISING, "rising").when(ratio <= FALLING, "falling").otherwise("flat")


def _weekly_limit(n: Column) -> Column:
    return F.least(F.lit(WEEKLY_SHARE), WEEKLY_WINDOWS / F.greatest(n, F.lit(1)))


def tier_assessment(w5: DataFrame, w7: DataFrame, tiers: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per account and tier: pressure of both window kinds, and whether the tier is strained or fits."""
    return by_tier(usage_summary(_both(w5, w7), tiers, by), by)


def by_tier(summary: DataFrame, by: Sequence[str]) -> DataFrame:
    """The tiers of a usage_summary as rows."""
    each = F.array(*[F.struct(F.lit(t.name).alias("tier"), F.col(f"t{k}").alias("x")) for k, t in enumerate(TIERS)])
    return summary.select(*by, F.explode(each).alias("t")).select(*by, "t.tier", "t.x.*")


def usage_trend(w5: DataFrame, by: Sequence[str]) -> DataFrame:
    """rising, falling or flat by the mean cost of windows after and before the middle; unknown with too few."""
    return usage_summary(w5.withColumn("span", F.lit("five_hour")), tier_table(w5.sparkSession), by).select(*by, "trend", "early_mean", "late_mean")


def recent_pressure(w5: DataFrame, w7: DataFrame, ceilings: DataFrame, by: Sequence[str]) -> DataFrame:
    """Per account: is a window of the later half near its limit. ceilings: by..., five_hour, weekly."""
    return usage_summary(_both(w5, w7), tier_table(w5.sparkSession), by, ceilings).select(*by, "recent_pressure")


def _half_up(x: Column) -> Column:
    return F.floor(x + 0.5).cast("double")


def plan_fit(summary: DataFrame, activity: DataFrame, current: DataFrame | str, by: Sequence[str]) -> DataFrame:
    """Per account: verdict, suggested tier, monthly difference and confidence, from its usage_summary and activity_span.

    current: by..., tier (none, or a paid tier), or the tier that all have. Precedence: strained and recent -> pay as you go -> smaller
    tier that fits -> stay; without a plan: the smallest tier that isn't strained and is clearly cheaper.
    """
    by = list(by)
    rows = activity.join(current, by) if isinstance(current, DataFrame) else activity.withColumn("tier", F.lit(current))
    rows = rows.join(summary, by, "left")
    rows = rows.withColumns({"trend": F.coalesce("trend", F.lit("unknown")), "recent_pressure": F.coalesce("recent_pressure", F.lit(False)), "windows5": F.coalesce("windows5", F.lit(0))})
    rate = F.when(F.col("span_days") > 0, F.col("total_cost") / F.col("span_days") * 30).otherwise(0.0)
    volume = F.when((F.col("active_days") >= 14) & (F.col("windows5") >= 20) & (F.col("recency_days") <= 3), 2).when((F.col("active_days") >= 5) & (F.col("windows5") >= 6), 1).otherwise(0)
    rows = rows.withColumns({"run_rate": rate, "volume": volume})
    a = [F.col(f"t{k}") for k in range(len(TIERS))]
    fees = [float(t.fee) for t in TIERS]
    run, vol = F.col("run_rate"), F.col("volume")
    fit_margin = lambda x: F.least(FIT_TYPICAL - x["p90_5"], FIT_TYPICAL - x["p90_7"], FIT_PEAK - x["peak5"], FIT_PEAK - x["peak7"])
    choices: list[tuple[Column, Column]] = []

    def choice(verdict: str, target: str | None, delta: Column, margin: Column, neutral: bool = False) -> Column:
        return F.struct(F.lit(verdict).alias("verdict"), F.lit(target).cast("string").alias("suggested_tier"), delta.cast("double").alias("monthly_delta"), margin.cast("double").alias("margin"), F.lit(neutral).alias("neutral"))

    none = F.col("tier") == "none"
    for k, t in enumerate(TIERS):
        affordable = (vol > 0) & (run > 0) & ~a[k]["strained"] & (fees[k] <= SUBSCRIBE_SHARE * run)
        choices.append((none & affordable, choice("upgrade", t.name, _half_up(fees[k] - run), SUBSCRIBE_SHARE - F.try_divide(F.lit(fees[k]), run))))
    choices.append((none, choice("neutral", None, F.lit(0), F.lit(0), True)))
    for k, t in enumerate(TIERS):
        own, cur = F.col("tier") == t.name, a[k]
        strained = own & cur["strained"]
        choices.append((strained & ~F.col("recent_pressure"), choice("stay", None, F.lit(0), F.lit(MARGIN_MEDIUM))))
        low = F.lit(float("-inf"))
        margin = F.greatest(F.when(cur["strained5"], cur["share5"] - UPGRADE_SHARE).otherwise(low), F.when(cur["strained7"], cur["share7"] - _weekly_limit(cur["n7"])).otherwise(low))
        for j in range(k + 1, len(TIERS)):
            last = F.lit(j == len(TIERS) - 1)
            choices.append((strained & (~a[j]["strained"] | last), choice("upgrade", TIERS[j].name, F.lit(fees[j] - fees[k]), margin)))
        choices.append((strained, choice("stay", None, F.lit(0), F.lit(MARGIN_MEDIUM))))
        payg = own & (vol > 0) & (run >= 0) & (F.col("total_cost") > 0) & (run <= PAYG_RATIO * fees[0])
        choices.append((payg, choice("downgrade", "none", -_half_up(fees[k] - run), PAYG_RATIO - run / fees[0])))
        for j in range(k):
            choices.append((own & a[j]["fits"], choice("downgrade", TIERS[j].name, F.lit(fees[j] - fees[k]), fit_margin(a[j]))))
        margins = [F.abs(cur["share5"] - UPGRADE_SHARE), F.abs(cur["share7"] - _weekly_limit(cur["n7"]))] + ([F.abs(fit_margin(a[k - 1]))] if k else [])
        choices.append((own, choice("stay", None, F.lit(0), F.least(*margins))))
    decision = F
    for condition, value in choices:
        decision = decision.when(F.coalesce(condition, F.lit(False)), value)
    rows = rows.withColumn("d", decision)
    by_margin = F.when(F.col("d.margin") >= MARGIN_HIGH, 2).when(F.col("d.margin") >= MARGIN_MEDIUM, 1).otherwise(0)
    level = F.least(vol, by_margin)
    against = ((F.col("d.verdict") == "upgrade") & (F.col("trend") == "falling")) | ((F.col("d.verdict") == "downgrade") & (F.col("trend") == "rising"))
    level = F.when(F.col("d.neutral"), 0).when(against, F.least(level, F.lit(1))).otherwise(level)
    return rows.select(*by, "tier", "d.verdict", "d.suggested_tier", "d.monthly_delta", F.element_at(F.array(*map(F.lit, _CONFIDENCE)), level + 1).alias("confidence"), "trend", "recent_pressure", "run_rate")


def assess_accounts(turns: DataFrame, current: DataFrame, by: Sequence[str], now: dt.datetime, overrides: DataFrame | None = None) -> DataFrame:
    """plan_fit from turns alone, in two passes over them: one for all windows, one for the span of activity."""
    tiers = tier_table(turns.sparkSession, overrides)
    own = current.join(F.broadcast(tiers), "tier", "left").select(*by, F.coalesce("five_hour", F.lit(0.0)).alias("five_hour"), F.coalesce("weekly", F.lit(0.0)).alias("weekly"))
    return plan_fit(usage_summary(usage_windows(turns, by), tiers, by, own), activity_span(turns, by, now), current, by)
