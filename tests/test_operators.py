"""Rules that the test tables don't show: periods, zones, boundaries, empty inputs, plan verdicts, streaming."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from sparklog.functions import exprs
from sparklog.functions.exprs import Filters, Range
from sparklog.operators import activity, cost, plan_fit, sessions
from sparklog.plans.ranks import with_percent_rank
from sparklog.plans.windows import FIVE_HOURS, anchored_windows
from sparklog.schemas import SESSIONS, TIERS, TURNS
from sparklog.streaming import live

NOW = dt.datetime(2024, 3, 10, 12)


def turns_of(spark, rows):
    full = [{**dict.fromkeys(TURNS.fieldNames()), "role": "assistant", "model": "claude-sonnet-4-5", "session_id": "s", "input_tokens": 1, "output_tokens": 1, "cache_creation_tokens": 0, "cache_read_tokens": 0, "cost_usd": 1.0, "turn_id": str(k), **r} for k, r in enumerate(rows)]
    return spark.createDataFrame(full, TURNS)


def test_periods():
    assert exprs.period("7d", NOW) == Range(NOW - dt.timedelta(7), NOW) == exprs.period("what", NOW)
    assert exprs.period("all", NOW).start == dt.datetime(2020, 1, 1)
    assert exprs.period("today", NOW, "Asia/Jerusalem").start == dt.datetime(2024, 3, 9, 22)
    with pytest.raises(ValueError):
        exprs.bucket("t", "minute")


def test_rates(spark):
    models = ["claude-opus-4-7-x", "CLAUDE-OPUS-4-1", "claude-haiku-4-5", "mystery", None]
    rows = spark.createDataFrame([(m, 1_000_000, 0, 0, 0) for m in models], "model string, input_tokens long, output_tokens long, cache_creation_tokens long, cache_read_tokens long")
    assert [r["cost_usd"] for r in exprs.with_cost(rows).collect()] == [5.0, 15.0, 1.0, 3.0, 3.0]
    own = spark.createDataFrame([(1, "claude-opus-4-7", 2.0, 0.0, 0.0, 0.0), (2, "claude-opus", 9.0, 0.0, 0.0, 0.0)], "priority int, prefix string, input double, output double, cache_creation double, cache_read double")
    got = {r["model"]: r["cost_usd"] for r in exprs.with_rate_table(rows, own).collect()}
    assert got == {"claude-opus-4-7-x": 2.0, "CLAUDE-OPUS-4-1": 9.0, "claude-haiku-4-5": 3.0, "mystery": 3.0, None: 3.0}


def test_empty_tables_give_zeros(spark):
    turns, empty = spark.createDataFrame([], TURNS), spark.createDataFrame([], SESSIONS)
    r = Range(dt.datetime(2024, 1, 1), dt.datetime(2024, 2, 1))
    assert cost.total_cost(turns, empty, r).first()["total_cost"] == 0
    assert activity.hourly_activity(turns, empty, r).count() == 24
    assert activity.peak_hour(activity.hourly_activity(turns, empty, r)).first()["peak_hour"] is None
    assert [x["total_tokens"] for x in cost.token_totals(turns, empty, r).collect()] == [0, 0]
    assert sessions.context_pressure_stats(turns, empty, r).first()["sessions"] == 0


def test_half_open_range_and_zone(spark):
    turns = turns_of(spark, [{"timestamp": dt.datetime(2024, 1, 3, 22, 30)}, {"timestamp": dt.datetime(2024, 1, 4)}])
    r = Range(dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 4))
    got = cost.daily_cost(turns, spark.createDataFrame([], SESSIONS), r, tz="Asia/Jerusalem").collect()
    assert [(x["date"], x["turn_count"]) for x in got] == [(dt.date(2024, 1, 4), 1)]
    daily = activity.daily_activity(turns, Range(r.start, NOW))
    assert activity.turns_today(daily, dt.datetime(2024, 1, 4, 1)).first()["turns"] == 1
    filled = activity.calendar_fill(daily, dt.date(2024, 1, 6), 7).orderBy("date").collect()
    assert filled[0]["date"] == dt.date(2023, 12, 24) and len(filled) == 14 and sum(x["turns"] for x in filled) == 2


def test_like_wildcards_and_filters(spark):
    turns = turns_of(spark, [{"timestamp": NOW, "model": "ab"}, {"timestamp": NOW, "model": None, "role": "user"}])
    none = spark.createDataFrame([], SESSIONS)
    assert exprs.turn_filters(turns, none, Filters(model="a_")).count() == 1
    assert exprs.turn_filters(turns, none, Filters(model="zz"), keep_user=True).count() == 1
    assert exprs.turn_filters(turns, none, Filters(project="/x")).count() == 0


def test_zombie_session_in_stats(spark):
    rows = [(f"s{k}", dt.datetime(2024, 1, 1), d, "m", 1.0, 1) for k, d in enumerate([1800] * 5 + [37 * 86400, None])]
    summary = spark.createDataFrame(rows, "session_id string, start_time timestamp_ntz, duration_seconds int, model string, total_cost double, turn_count long")
    got = sessions.session_stats(summary, Range(dt.datetime(2024, 1, 1), NOW)).first()
    assert got["median_duration"] == 1800 and got["avg_capped_duration"] == (5 * 1800 + 43200) / 6
    capped = sessions.session_stats(summary, Range(dt.datetime(2024, 1, 1), NOW), null_as_cap=True).first()
    assert capped["avg_capped_duration"] == (5 * 1800 + 2 * 43200) / 7


def test_percent_rank_equals_the_window_function(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, rng.choice((0, 5, rng.randint(0, 10**6)))) for k in range(500)], "id int, v long")
    rows.createOrReplaceTempView("ranked_rows")
    want = {r["id"]: r["p"] for r in spark.sql("SELECT id, percent_rank() OVER (ORDER BY v) AS p FROM ranked_rows").collect()}
    assert {r["id"]: r["v_rank"] for r in with_percent_rank(rows, "id", ["v"]).collect()} == want
    assert with_percent_rank(rows.limit(1), "id", ["v"]).first()["v_rank"] == 0


def greedy(times, span):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1][0] + span:
            out.append([t, 0])
        out[-1][1] += 1
    return [tuple(x) for x in out]


def test_anchored_windows(spark):
    rng = random.Random(6)
    start = dt.datetime(2024, 1, 1)
    span = dt.timedelta(seconds=FIVE_HOURS)
    times = {a: [start + dt.timedelta(minutes=rng.choice((rng.randint(0, 20000), rng.randint(0, 900)))) for _ in range(150)] for a in "ab"}
    times["edge"] = [start, start + span - dt.timedelta(microseconds=1000), start + span, start + span]
    rows = spark.createDataFrame([(a, t, 1.0) for a, own in times.items() for t in own], "account string, timestamp timestamp_ntz, cost_usd double")
    got = {}
    for r in anchored_windows(rows, ["account"], FIVE_HOURS).orderBy("account", "anchor").collect():
        got.setdefault(r["account"], []).append((r["anchor"], r["turns"]))
    assert got == {a: greedy(own, span) for a, own in times.items()}
    assert anchored_windows(rows.limit(0), ["account"], FIVE_HOURS).count() == 0


def _accounts(spark, usage, tier):
    """usage: account -> daily cost over 40 days."""
    rows = [(a, dt.datetime(2024, 1, 1, 9) + dt.timedelta(days=d), float(c)) for a, costs in usage.items() for d, c in enumerate(costs)]
    turns = spark.createDataFrame(rows, "account string, timestamp timestamp_ntz, cost_usd double")
    current = spark.createDataFrame([(a, tier) for a in usage], "account string, tier string")
    return {r["account"]: r for r in plan_fit.assess_accounts(turns, current, ["account"], dt.datetime(2024, 2, 10)).collect()}


def test_plan_verdicts(spark):
    got = _accounts(spark, {"heavy": [6] * 40, "stale": [6] * 15 + [2] * 25, "light": [0.1] * 40, "fine": [4] * 40, "sparse": [6, 6]}, "pro")
    assert (got["heavy"]["verdict"], got["heavy"]["suggested_tier"], got["heavy"]["monthly_delta"]) == ("upgrade", "max-5x", 80)
    assert (got["stale"]["verdict"], got["stale"]["trend"]) == ("stay", "falling")
    assert (got["light"]["verdict"], got["light"]["suggested_tier"], got["light"]["confidence"]) == ("downgrade", "none", "high")
    assert got["fine"]["verdict"] == "stay" and got["sparse"]["confidence"] == "low"
    top = _accounts(spark, {"over": [150] * 40, "mid": [3] * 40}, "max-20x")
    assert (top["over"]["verdict"], top["over"]["suggested_tier"]) == ("stay", None)
    assert (top["mid"]["verdict"], top["mid"]["suggested_tier"], top["mid"]["monthly_delta"]) == ("downgrade", "pro", -180)
    free = _accounts(spark, {"pays": [3] * 40, "rare": [0.01] * 40}, "none")
    assert (free["pays"]["verdict"], free["pays"]["suggested_tier"]) == ("upgrade", "pro") and free["rare"]["verdict"] == "neutral"


def test_ceilings(spark):
    own = spark.createDataFrame([("pro", 7.0, -1.0), ("max-5x", float("nan"), float("inf"))], "tier string, five_hour double, weekly double")
    got = {r["tier"]: (r["five_hour"], r["weekly"]) for r in plan_fit.tier_table(spark, own).collect()}
    assert got == {"pro": (7.0, 125.0), "max-5x": (25.0, 625.0), "max-20x": (100.0, 2500.0)}
    raised = {r["tier"]: r for r in plan_fit.calibrate(plan_fit.tier_table(spark), 25.0, 130.0).collect()}
    assert raised["pro"]["five_hour"] == 25 and raised["pro"]["weekly_calibrated"] and not raised["max-5x"]["five_hour_calibrated"]
    assert len(TIERS) == 3 and plan_fit.with_fill(spark.range(1).withColumn("cost", F.lit(3.0)), 0.0).first()["fill"] == 0


# --- streaming -------------------------------------------------------------------------------------------


def _run(df, tmp_path, name, mode="append"):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    query.awaitTermination()
    return df.sparkSession.table(name).collect()


def _stream(spark, tmp_path, batches, schema):
    folder = tmp_path / "in"
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(folder))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(folder))


def at(minutes):
    return dt.datetime(2024, 1, 1) + dt.timedelta(minutes=minutes)


def test_stream_cost_and_dedup(spark, tmp_path):
    schema = "request_id string, timestamp timestamp, cost_usd double, input_tokens long, output_tokens long"
    batches = [[("a", at(1), 1.0, 1, 1), ("a", at(2), 1.0, 1, 1), ("b", at(30), 2.0, 1, 1)], [("c", at(200), 4.0, 1, 1)], [("d", at(400), 8.0, 1, 1)]]
    source = _stream(spark, tmp_path, batches, schema)
    got = {r["start"]: r["total_cost"] for r in _run(live.stream_cost(source), tmp_path, "live_cost")}
    assert got[at(0)] == 4.0 and got[at(180)] == 4.0
    assert sorted(r["request_id"] for r in _run(live.stream_dedup(source), tmp_path, "live_dedup")) == ["a", "b", "c", "d"]


def test_stream_windows(spark, tmp_path):
    schema = "account string, timestamp timestamp, cost_usd double"
    batches = [[("x", at(0), 1.0), ("x", at(100), 1.0)], [("x", at(299), 1.0), ("x", at(300), 1.0)], [("y", at(2000), 1.0)], [("y", at(5000), 1.0)]]
    source = _stream(spark, tmp_path, batches, schema)
    got = {(r["account"], r["anchor"]): r["turns"] for r in _run(live.stream_windows(source, ["account"], FIVE_HOURS), tmp_path, "live_windows")}
    assert got[("x", at(0))] == 3 and got[("x", at(300))] == 1 and got[("y", at(2000))] == 1


def test_stream_windows_in_any_order_inside_the_delay(spark, tmp_path):
    """Shuffled arrival gives the windows of the batch operator; a row beyond the delay is counted apart."""
    rng = random.Random(3)
    rows = sorted((rng.randint(0, 40 * 60), rng.choice("xyz")) for _ in range(300))
    arrival = sorted(rows, key=lambda r: r[0] + rng.uniform(0, 100))  # each within 100 minutes of those before
    batches = [[(a, at(t), 1.0) for t, a in arrival[k : k + 60]] for k in range(0, 300, 60)]
    batches += [[("x", at(5), 1.0)], [("w", at(10**5), 1.0)], [("w", at(10**5 + 1), 1.0)]]  # x is far too late
    source = _stream(spark, tmp_path, batches, "account string, timestamp timestamp, cost_usd double")
    out = _run(live.stream_windows(source, ["account"], FIVE_HOURS, "101 minutes"), tmp_path, "shuffled_windows")
    got = sorted((r["account"], r["anchor"], r["turns"], r["cost"]) for r in out if r["account"] != "w")
    table = spark.createDataFrame([(a, at(t), 1.0) for t, a in rows], "account string, timestamp timestamp_ntz, cost_usd double")
    want = sorted(tuple(r) for r in anchored_windows(table, ["account"], FIVE_HOURS).collect())
    assert got == want
    assert sum(r["late_rows"] for r in out) <= 1


def test_stream_tool_results(spark, tmp_path):
    calls = _stream(spark, tmp_path / "c", [[("t1", at(0)), ("t2", at(1))], [("t3", at(300))]], "tool_call_id string, called_at timestamp")
    results = _stream(spark, tmp_path / "r", [[("t1", at(5), False)], [("t9", at(300), True)]], "tool_call_id string, done_at timestamp, is_error boolean")
    got = {r["tool_call_id"]: r["success"] for r in _run(live.stream_tool_results(calls, results), tmp_path, "live_results")}
    assert got.get("t1") is True and got.get("t2", None) is None


def test_prompt_scores_do_not_repeat_their_plan(spark):
    import __spark_entry__

    found = __spark_entry__.queries()
    for name, most in (("complexity_score", 6), ("prompt_stats", 9), ("prompt_pairs", 3)):
        plan = found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, name


def test_headline_queries_exist():
    import __spark_entry__
    import bench

    assert set(bench.HEADLINE) <= set(__spark_entry__.queries())


def test_windows_of_one_dense_account(spark):
    """A million rows without a gap: streamed in batches, window by window."""
    n, step = 1_000_000, 7
    at = F.timestamp_add("SECOND", F.col("id") * step, F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(n).select(F.lit("a").alias("account"), F.lit(None).cast("string").alias("team"), at.alias("timestamp"), F.lit(0.5).alias("cost_usd"))
    out = sorted((r["anchor"], r["turns"], r["cost"]) for r in anchored_windows(rows, ["account", "team"], FIVE_HOURS).collect())
    each = -(-FIVE_HOURS // step)
    assert [t for _, t, _ in out] == [each] * (n // each) + [n % each] * (n % each > 0)
    assert all(c == t / 2 for _, t, c in out) and out[1][0] - out[0][0] == dt.timedelta(seconds=each * step)


def test_plan_fit_reads_turns_twice(spark):
    """Once for all windows, once for the span of activity; windows are not repeated by tier."""
    import __spark_entry__

    found = __spark_entry__.queries()
    for name, most in (("tier_assessment", 1), ("plan_fit", 2), ("recent_pressure", 1)):
        plan = found[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("FileScan") <= most, name
        assert "CartesianProduct" not in plan, name


def test_stream_windows_of_accounts_that_share_a_bucket(spark, tmp_path):
    """Each account has its own windows, whatever its key holds."""
    since = dt.datetime(2024, 1, 1, 0, 0, 0, 123456)
    accounts = [(k, t, since) for k in ((1 << 60) + 1, (1 << 60) + 2, None, 7) for t in ('a "b"', None)]
    rows = [(*a, at(m), 1.0) for a in accounts for m in (300, 0, 299, 1000)]
    batches = [rows[:11], rows[11:], [(0, "z", None, at(10**5), 1.0)], [(0, "z", None, at(10**5 + 1), 1.0)]]
    source = _stream(spark, tmp_path, batches, "id long, team string, since timestamp_ntz, timestamp timestamp, cost_usd double")
    out = _run(live.stream_windows(source, ["id", "team", "since"], FIVE_HOURS, "2000 minutes", buckets=2), tmp_path, "bucket_windows")
    want = [(*a, at(m), n, float(n), 0) for a in accounts for m, n in ((0, 2), (300, 1), (1000, 1))]
    assert sorted((tuple(r) for r in out if r["id"] != 0), key=str) == sorted(want, key=str)


def test_stream_windows_calls_python_by_bucket(spark, tmp_path):
    """Many accounts make no more rows of state, and calls, than there are buckets."""
    rows = [(k, at(m), 1.0) for k in range(1500) for m in (0, 400)]
    source = _stream(spark, tmp_path, [rows], "account long, timestamp timestamp, cost_usd double")
    windows = live.stream_windows(source, ["account"], FIVE_HOURS)
    running = windows.writeStream.format("memory").queryName("many_accounts").option("checkpointLocation", str(tmp_path / "many")).trigger(availableNow=True).start()
    running.awaitTermination()
    assert max(p.stateOperators[0].numRowsTotal for p in running.recentProgress if p.stateOperators) <= 1024
    assert spark.table("many_accounts").count() == 1500
