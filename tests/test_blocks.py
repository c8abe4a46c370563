"""Running values in blocks of time against one window over the key."""

import datetime as dt
import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sparklog.operators import sessions, tools
from sparklog.plans import windows
from sparklog.plans.blocks import running_sums, with_following
from sparklog.plans.windows import FIVE_HOURS, anchored_windows, anchored_windows_in_blocks


@pytest.mark.parametrize("length", ["10 minutes", "1 hour", "30 days"])
def test_sums_equal_those_of_one_window(spark, length):
    start = dt.datetime(1969, 12, 30)
    rows = [(k % 3 and f"s{k % 3}" or "s0", k, start + dt.timedelta(seconds=k * k % 400_000), k % 7 if k % 5 else None) for k in range(900)] + [("s1", 1000 + k, None, 1) for k in range(3)]
    df = spark.createDataFrame(rows, "key string, id int, timestamp timestamp_ntz, v int")
    got = running_sums(df, ["key"], ["timestamp", "id"], {"total": F.col("v"), "n": F.lit(1)}, length=length)
    order = Window.partitionBy("key").orderBy("timestamp", "id").rowsBetween(Window.unboundedPreceding, 0)
    want = df.withColumns({"total": F.coalesce(F.sum("v").over(order), F.lit(0)), "n": F.count("*").over(order)})
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))


def test_one_giant_session_is_many_tasks(spark):
    """Two million turns of one session: no task takes all of them, and rows are shuffled once."""
    at = F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    tokens = [F.lit(1).cast("long").alias(f"{c}_tokens") for c in ("input", "output", "cache_creation", "cache_read")]
    turns = spark.range(2_000_000).select(F.lit("s").alias("session_id"), F.col("id").alias("turn_id"), at.alias("timestamp"), F.lit(0.5).alias("cost_usd"), *tokens)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # two million narrow rows are little: AQE would put them together
    try:
        out = sessions.cumulative_cost(turns).withColumn("task", F.spark_partition_id())
        wrong, most = out.groupBy("task").agg(F.count("*").alias("n"), F.count_if(F.abs(F.col("cumulative_cost") - (F.col("turn_id") + 1) * 0.5) > 1e-6).alias("wrong")).agg(F.sum("wrong"), F.max("n")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert wrong == 0 and most < 1_000_000


def test_runs_of_failures_over_several_blocks(spark):
    at = lambda k: dt.datetime(2024, 1, 1) + dt.timedelta(minutes=20 * k)
    outcome = [True] + [False] * 9 + [True, False, None, False, True, False]
    turns = spark.createDataFrame([("s", f"t{k}", at(k)) for k in range(len(outcome))], "session_id string, turn_id string, timestamp timestamp_ntz")
    calls = spark.createDataFrame([("s", f"t{k}", f"c{k:02d}", "Bash", ok, 1) for k, ok in enumerate(outcome)], "session_id string, turn_id string, tool_call_id string, tool_name string, success boolean, duration_ms int")
    from sparklog.functions.exprs import Range

    everything = Range(dt.datetime(2000, 1, 1), dt.datetime(2099, 1, 1))
    for block in ("1 hour", "1 minute", "1 day"):
        r = tools.failure_streaks(calls, turns, None, everything, block=block).first()
        assert (r["max_failure_streak"], r["streaks_2plus"], r["streaks_3plus"], r["failed_in_streaks"]) == (9, 2, 1, 11)


@pytest.mark.parametrize("block", [3600, 6 * 3600, 7 * 86400])
def test_windows_in_blocks_equal_the_stream(spark, block):
    """Gaps, ties, dense stretches, null keys; blocks shorter and longer than a window."""
    rng = random.Random(block)
    start, rows = dt.datetime(1969, 12, 25), []
    for account, team in (("a", None), ("b", "x"), (None, "x")):
        t = 0
        for _ in range(700):
            t += rng.choice([0, 30, 600, 600, 3 * 3600, 6 * 3600 if rng.random() < 0.3 else 1])
            rows.append((account, team, start + dt.timedelta(seconds=t), rng.choice([1.0, 2.0, None])))
    rows += [("a", None, None, 1.0)]
    df = spark.createDataFrame(rows, "account string, team string, timestamp timestamp_ntz, cost_usd double")
    want = sorted(map(repr, anchored_windows(df, ["account", "team"], FIVE_HOURS).collect()))
    assert sorted(map(repr, anchored_windows_in_blocks(df, ["account", "team"], FIVE_HOURS, block).collect())) == want


@pytest.mark.parametrize("length", ["1 minute", "1 hour", "30 days"])
@pytest.mark.parametrize("n", [1, 2, 4])
def test_following_rows_equal_those_of_one_window(spark, length, n):
    """Null keys, times and values, ties and repeated rows; chains over several blocks of one row."""
    rng, start = random.Random(n), dt.datetime(1969, 12, 31, 22)
    rows = [(rng.choice(["a", "b", None]), start + dt.timedelta(seconds=rng.choice([0, 1, 50, 3700, 90_000]) * rng.randint(0, 9)) if k % 20 else None, rng.choice("xyz"), rng.choice([1, 2, None])) for k in range(300)]
    df = spark.createDataFrame(rows, "key string, timestamp timestamp_ntz, id string, v int")
    got = with_following(df, ["key"], ["timestamp", "id"], ["id", "v"], n, length=length)
    order = Window.partitionBy("key").orderBy("timestamp", "id", "v")
    want = df.select("key", *[F.lead(c, k).over(order).alias(f"{c}{k}") for k in range(n) for c in ("id", "v")])
    assert got.columns == want.columns
    assert sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert with_following(df.limit(0), ["key"], ["timestamp", "id"], ["id", "v"], n).count() == 0


def test_chains_of_one_giant_session_are_many_tasks(spark):
    at = F.timestamp_add("SECOND", F.col("id"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(1_000_000).select(F.lit("s").alias("session_id"), at.alias("timestamp"), F.col("id").alias("tool_call_id"), (F.col("id") % 7).alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = with_following(rows, ["session_id"], ["timestamp", "tool_call_id"], ["v"], 3).withColumn("task", F.spark_partition_id())
        wrong = F.count_if((F.col("v1") != (F.col("v0") + 1) % 7) | (F.col("v2") != (F.col("v0") + 2) % 7))
        found = out.groupBy("task").agg(F.count("*").alias("n"), wrong.alias("wrong"), F.count_if(F.col("v2").isNull()).alias("open")).agg(F.sum("n"), F.max("n"), F.sum("wrong"), F.sum("open")).first()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert found[0] == 1_000_000 and found[1] < 600_000 and found[2] == 0 and found[3] == 2


def test_maps_of_many_small_blocks_leave_a_task_together(spark, monkeypatch):
    monkeypatch.setattr(windows, "_MAPS", 7)  # 300 blocks of each account: several batches of maps, the last not full
    at = F.timestamp_add("MINUTE", (F.col("id") * 97).cast("long"), F.lit("1969-12-25 00:00:00").cast("timestamp_ntz"))
    rows = spark.range(1500).select(F.when(F.col("id") % 4 > 0, F.concat(F.lit("a"), F.col("id") % 4)).alias("account"), at.alias("timestamp"), F.lit(0.5).alias("cost_usd"))
    got, want = anchored_windows_in_blocks(rows, ["account"], FIVE_HOURS, 86400), anchored_windows(rows, ["account"], FIVE_HOURS)
    assert sorted(map(repr, got.select(*want.columns).collect())) == sorted(map(repr, want.collect()))
