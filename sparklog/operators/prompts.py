"""Prompts: each user turn with text and the assistant turns up to the next one."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.exprs import CATEGORIES, NO_FILTERS, Filters, Range, only, turn_filters
from sparklog.plans.blocks import BLOCK, running_sums
from sparklog.plans.ranks import with_percent_rank

ALL_TIME = Range(dt.datetime(2000, 1, 1), dt.datetime(2099, 12, 31))
SORTS = ("timestamp", "response_cost", "total_tokens", "depth", "tool_calls", "complexity")
# Upper bounds of the cost histogram's buckets; the first is exactly 0.
COST_BOUNDS = (0.0, 0.001, 0.01, 0.05, 0.1, 0.5)
METRICS = ("tool_calls", "total_tokens", "depth", "distinct_tools")


def segments(turns: DataFrame, *carry: str, block: str = BLOCK) -> DataFrame:
    """Turns with the number of their prompt in the session; 0 before the first. Texts are not carried along.

    Prompts are counted in blocks of time, so a session's turns are numbered in as many tasks as it has blocks.
    """
    is_prompt = (F.col("role") == "user") & F.col("content_text").isNotNull()
    rows = turns.select(
        "session_id", "turn_id", "timestamp", "role", "model", "has_thinking", "cost_usd", "stop_reason", *[f"{c}_tokens" for c in CATEGORIES], is_prompt.alias("is_prompt"), *carry
    )
    return running_sums(rows, ["session_id"], ["timestamp", "turn_id"], {"segment": F.col("is_prompt").cast("int")}, length=block)


def prompt_pairs(turns: DataFrame, calls: DataFrame, sessions: DataFrame, r: Range = ALL_TIME, f: Filters = NO_FILTERS, tokens: str = "2way", model: str = "min") -> DataFrame:
    """A row per prompt: response cost and tokens, depth (0 without a response), tools.

    tokens: 2way (input + output) or 4way. model: min, or first (of the first assistant turn). A turn gets the
    number and names of its calls before prompts are numbered, so turns and calls are read once.
    """
    used = calls.groupBy("session_id", "turn_id").agg(F.count("*").alias("_calls"), F.collect_set("tool_name").alias("_tools"))
    own = turn_filters(turns.filter(r.holds("timestamp")), sessions, f, keep_user=True)
    rows = segments(own.join(used, ["session_id", "turn_id"], "left"), "_calls", "_tools").filter("segment > 0")
    answer = F.col("role") == "assistant"
    counted = F.col("input_tokens") + F.col("output_tokens")
    if tokens == "4way":
        counted = counted + F.col("cache_creation_tokens") + F.col("cache_read_tokens")
    added = lambda c: F.coalesce(F.sum(F.when(answer, c)), F.lit(0))
    chosen = F.min(F.when(answer, F.col("model"))) if model == "min" else F.min_by("model", F.when(answer, F.struct("timestamp", "turn_id")))
    pairs = rows.groupBy("session_id", "segment").agg(
        F.max(F.when(F.col("is_prompt"), F.col("turn_id"))).alias("turn_id"), F.max(F.when(F.col("is_prompt"), F.col("timestamp"))).alias("timestamp"),
        added(F.col("cost_usd")).alias("response_cost"), added(counted).alias("total_tokens"), *[added(F.col(f"{c}_tokens")).alias(f"{c}_tokens") for c in CATEGORIES],
        F.count_if(answer).alias("depth"), F.coalesce(F.bool_or(F.when(answer, F.col("has_thinking"))), F.lit(False)).alias("has_thinking"), chosen.alias("model"),
        added(F.col("_calls")).alias("tool_calls"), F.collect_set(F.when(answer, F.col("_tools"))).alias("_tools"),
    )
    return pairs.withColumn("distinct_tools", F.size(F.array_distinct(F.flatten("_tools"))).cast("long")).drop("_tools")


def complexity(pairs: DataFrame) -> DataFrame:
    """(turn_id, complexity): 100 times the mean of four percent ranks, to one decimal, over all given prompts."""
    ranked = with_percent_rank(pairs.select("turn_id", *METRICS), "turn_id", list(METRICS))
    mean = sum((F.col(f"{m}_rank") for m in METRICS[1:]), F.col(f"{METRICS[0]}_rank")) / len(METRICS)
    return ranked.select("turn_id", F.round(mean * 100, 1).alias("complexity"))


def scored(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    return pairs.join(scores, "turn_id", "left")


def prompt_ranking(pairs: DataFrame, scores: DataFrame, turns: DataFrame, sort: str = "complexity", descending: bool = True, page: int = 1, limit: int = 20) -> DataFrame:
    """A page of answered prompts in the order of a whitelisted column, with the first 200 characters."""
    if sort not in SORTS:
        raise ValueError(f"sort must be one of {SORTS}")
    rows = scored(pairs.filter("depth > 0"), scores)
    order = F.col(sort).desc_nulls_last() if descending else F.col(sort).asc_nulls_last()
    chosen = rows.orderBy(order, "turn_id").offset((page - 1) * limit).limit(limit)
    texts = turns.select("turn_id", F.left("content_text", F.lit(200)).alias("preview"))
    return texts.join(F.broadcast(chosen), "turn_id").orderBy(order, "turn_id")


def prompt_count(pairs: DataFrame) -> DataFrame:
    return pairs.filter("depth > 0").agg(F.count("*").alias("total"))


def prompt_stats(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    answered = F.col("depth") > 0
    return scored(pairs, scores).agg(
        F.count_if(answered).alias("answered"), F.count_if(~answered).alias("unanswered"), F.coalesce(F.avg(F.when(answered, F.col("response_cost"))), F.lit(0.0)).alias("avg_cost"),
        F.coalesce(F.max(F.when(answered, F.col("response_cost"))), F.lit(0.0)).alias("max_cost"), F.coalesce(F.avg(F.when(answered, F.col("complexity"))), F.lit(0.0)).alias("avg_complexity"),
    )


def prompt_cost_histogram(pairs: DataFrame) -> DataFrame:
    """Answered prompts in seven cost buckets; bucket is its number, lower and upper its bounds."""
    cost = F.col("response_cost")
    at = F.when(cost == 0, 0)
    for k, bound in enumerate(COST_BOUNDS[1:], 1):
        at = at.when(cost < bound, k)
    rows = pairs.filter("depth > 0").groupBy(at.otherwise(len(COST_BOUNDS)).alias("bucket")).agg(F.count("*").alias("prompts"))
    low, high = F.array(*map(F.lit, (0.0, *COST_BOUNDS))), F.array(*map(F.lit, (*COST_BOUNDS, 999.0)))
    return rows.select("bucket", low[F.col("bucket")].alias("lower"), high[F.col("bucket")].alias("upper"), "prompts")


def prompt_complexity_histogram(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """Answered prompts in five buckets of 20 points."""
    rows = scored(pairs.filter("depth > 0"), scores)
    return rows.groupBy((F.least(F.floor(F.col("complexity") / 20), F.lit(4)) * 20).cast("int").alias("lower")).agg(F.count("*").alias("prompts"))


def prompt_throughput(pairs: DataFrame) -> DataFrame:
    answered = pairs.filter("depth > 0")
    out = answered.agg(F.count("*").alias("prompts"), F.countDistinct("session_id").alias("sessions"), F.coalesce(F.avg("depth"), F.lit(0.0)).alias("turns_per_prompt"), F.coalesce(F.avg("tool_calls"), F.lit(0.0)).alias("calls_per_prompt"))
    return out.withColumn("prompts_per_session", F.coalesce(F.try_divide("prompts", "sessions"), F.lit(0.0)))


def prompt_detail(turns: DataFrame, calls: DataFrame, sessions: DataFrame, scores: DataFrame, turn_id: str | DataFrame, separator: str = "\n\n---\n\n") -> DataFrame:
    """One prompt with its text, the response's texts in order, sums, calls and score.

    turn_id is the prompt's id, or a table whose one row has it: then no job runs before the result is asked for.
    """
    chosen = lambda df: only(df, "turn_id", turn_id)
    own = turns.join(chosen(turns).select("session_id"), "session_id", "left_semi")
    rows = segments(own)
    wanted = chosen(rows).select("session_id", "segment")
    answers = rows.filter(F.col("role") == "assistant").join(wanted, ["session_id", "segment"], "left_semi").select("turn_id", "session_id", "timestamp", "segment")
    texts = own.select("turn_id", "content_text")
    joined = answers.join(texts, "turn_id").groupBy("session_id", "segment").agg(F.array_sort(F.collect_list(F.struct("timestamp", "turn_id", "content_text"))).alias("a"))
    response = joined.select("session_id", F.array_join(F.col("a.content_text"), separator).alias("response_text"))
    pair = chosen(prompt_pairs(own, calls, sessions))
    return pair.join(texts.withColumnRenamed("content_text", "prompt_text"), "turn_id").join(response, "session_id", "left").join(scores, "turn_id", "left")


def conversation_pairs(conversations: DataFrame) -> DataFrame:
    """prompt_pairs' segments on plain conversations (conv_id, turn, role, text): prompts, answers and their lengths."""
    is_prompt = (F.col("role") == "user") & F.col("text").isNotNull()
    rows = conversations.select("conv_id", "turn", "role", F.char_length("text").alias("n"), is_prompt.alias("p"))
    rows = rows.withColumn("segment", F.sum(F.col("p").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)))
    answer = F.col("role") == "assistant"
    return rows.filter("segment > 0").groupBy("conv_id", "segment").agg(
        F.min(F.when(F.col("p"), F.col("turn"))).alias("prompt_turn"), F.count_if(answer).alias("depth"), F.max(F.when(F.col("p"), F.col("n"))).cast("long").alias("prompt_chars"), F.coalesce(F.sum(F.when(answer, F.col("n"))), F.lit(0)).alias("response_chars")
    )
