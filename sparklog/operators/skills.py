"""Skills: loaded against invoked, their weight in the context, repeated invocations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.functions.exprs import NO_FILTERS, Filters, Range, bucket, context_tokens, estimated_tokens, known_rate, skill_calls, turn_filters
from sparklog.operators.tools import called_in

# Skills made to be invoked many times, and the thresholds of "too many skills".
REENTRANT = ("babysitter:babysit", "babysitter:call", "babysitter:babysit-prs", "loop", "schedule", "handoff")
DEAD_WEIGHT_LIMIT, CONTEXT_SHARE_LIMIT = 0.5, 0.05


def _period_sessions(turns: DataFrame, sessions: DataFrame, r: Range, f: Filters) -> DataFrame:
    return turn_filters(turns.filter(r.holds("timestamp")), sessions, f).select("session_id").distinct()


def skill_usage_pairs(skills: DataFrame, calls: DataFrame) -> DataFrame:
    """(session, skill): loaded, invoked how often; either side may be missing."""
    loaded = skills.select("session_id", F.col("skill_name").alias("skill")).distinct().withColumn("loaded", F.lit(True))
    invoked = skill_calls(calls).filter("skill is not null").groupBy("session_id", "skill").agg(F.count("*").alias("invocations"))
    return loaded.join(invoked, ["session_id", "skill"], "full").na.fill(False, ["loaded"]).na.fill(0, ["invocations"])


def skill_invocations(calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Per skill: invocations, sessions, outcomes, invocations per session."""
    rows = called_in(skill_calls(calls).filter("skill is not null"), turns, sessions, r, f)
    good, known = F.count_if(F.col("success")), F.count("success")
    out = rows.groupBy("skill").agg(F.count("*").alias("invocations"), F.countDistinct("session_id").alias("sessions"), good.alias("successes"), (known - good).alias("failures"), known_rate(good, known).alias("success_rate"))
    return out.withColumn("avg_per_session", F.try_divide("invocations", "sessions"))


def skill_loaded(skills: DataFrame, calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """Per skill loaded in the period's sessions: sessions, estimated tokens per load, invocations, dead weight."""
    chosen = _period_sessions(turns, sessions, r, f)
    loaded = skills.join(chosen, "session_id", "left_semi").groupBy(F.col("skill_name").alias("skill")).agg(
        F.countDistinct("session_id").alias("sessions_loaded"), F.max("skill_description").alias("description")
    )
    invoked = skill_calls(calls).filter("skill is not null").join(chosen, "session_id", "left_semi").groupBy("skill").agg(F.count("*").alias("invocations"))
    out = loaded.join(invoked, "skill", "left").na.fill(0, ["invocations"])
    return out.select("skill", "sessions_loaded", estimated_tokens("description").alias("estimated_tokens"), "invocations", (F.col("invocations") == 0).alias("dead_weight"))


def skill_summary(skills: DataFrame, calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS) -> DataFrame:
    """One row: skills loaded and invoked, success, dead weight, share of the context, and whether they are too many.

    Turns of the period, skill calls and loaded skills are one table of narrow rows, each read once: a call is in the
    period if a turn row has its turn. Rows are summed by session and skill, then by session, then by skill; only the
    last sum, over skills, is one task's.
    """
    none = lambda kind: F.lit(None).cast(kind)
    own = turn_filters(turns.filter(r.holds("timestamp")), sessions, f)
    facts = own.select("session_id", "turn_id", F.lit("turn").alias("kind"), none("string").alias("skill"), none("boolean").alias("success"), F.when(F.col("role") == "assistant", context_tokens()).alias("context"), none("string").alias("d"))
    facts = facts.unionByName(skill_calls(calls).select("session_id", "turn_id", F.lit("call").alias("kind"), "skill", "success", none("long").alias("context"), none("string").alias("d")))
    facts = facts.unionByName(skills.select("session_id", F.lit(None).cast("string").alias("turn_id"), F.lit("load").alias("kind"), F.col("skill_name").alias("skill"), none("boolean").alias("success"), none("long").alias("context"), F.col("skill_description").alias("d")))
    is_ = lambda kind: F.col("kind") == kind
    # loaded skills have no turn: they are spread by their name
    turn = Window.partitionBy("session_id", "turn_id", F.when(F.col("turn_id").isNull(), F.coalesce("skill", F.lit(""))))
    facts = facts.withColumn("inside", is_("call") & F.max(is_("turn")).over(turn))
    good = F.col("inside") & F.col("success")
    pairs = facts.groupBy("session_id", "skill").agg(
        F.max(is_("turn")).alias("chosen"), F.max(is_("load")).alias("loaded"), F.max("d").alias("d"), F.count_if(is_("call")).alias("used"), F.count_if("inside").alias("invoked"),
        F.count_if(good).alias("good"), F.count_if(F.col("inside") & F.col("success").isNotNull()).alias("known"), F.sum("context").alias("context"), F.count("context").alias("answers"),
    )
    tokens = F.when(F.col("loaded"), estimated_tokens("d"))
    part = F.struct("skill", "loaded", "used", "invoked", "good", "known")
    by_session = pairs.groupBy("session_id").agg(
        F.max("chosen").alias("chosen"), F.count_if("loaded").alias("n"), F.sum(tokens).alias("tokens"), F.sum("context").alias("context"), F.sum("answers").alias("answers"), F.collect_list(part).alias("parts")
    ).filter("chosen")
    # a session's own numbers go with the first of its skills
    each = by_session.select(F.posexplode("parts").alias("at", "p"), "n", "tokens", "context", "answers")
    once = lambda c: F.when(F.col("at") == 0, F.col(c))
    by_skill = each.groupBy("p.skill").agg(
        F.max("p.loaded").alias("loaded"), F.sum("p.used").alias("used"), *[F.sum(f"p.{c}").alias(c) for c in ("invoked", "good", "known")], F.sum(once("n")).alias("n"), F.max(once("n")).alias("most"),
        F.count_if((F.col("at") == 0) & (F.col("n") > 0)).alias("sessions"), *[F.sum(once(c)).alias(c) for c in ("tokens", "context", "answers")],
    )
    known_skill = F.col("skill").isNotNull()
    ratio = lambda x, y: F.coalesce(F.try_divide(F.sum(x), F.sum(y)), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    out = by_skill.agg(
        ratio("n", "sessions").alias("avg_loaded"), zero(F.max("most")).alias("max_loaded"), ratio("tokens", "sessions").alias("avg_loaded_tokens"),
        F.count_if(known_skill & (F.col("invoked") > 0)).alias("distinct_invoked"), zero(F.sum("invoked")).alias("invocations"), known_rate(F.sum("good"), F.sum("known")).alias("success_rate"),
        F.count_if(known_skill & F.col("loaded")).alias("distinct_loaded"), F.count_if(known_skill & F.col("loaded") & (F.col("used") == 0)).alias("dead_weight"), ratio("context", "answers").alias("avg_context_tokens"),
    )
    out = out.withColumns({"invocation_rate": F.try_divide("distinct_invoked", "distinct_loaded"), "dead_weight_ratio": F.try_divide("dead_weight", "distinct_loaded"), "context_share": F.try_divide("avg_loaded_tokens", "avg_context_tokens")})
    many = (F.coalesce("dead_weight_ratio", F.lit(0.0)) > DEAD_WEIGHT_LIMIT) | (F.coalesce("context_share", F.lit(0.0)) > CONTEXT_SHARE_LIMIT)
    return out.withColumn("too_many", many)


def skill_thrash(calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, f: Filters = NO_FILTERS, min_count: int = 2, limit: int | None = 100) -> DataFrame:
    """(session, skill) invoked min_count times or more, and whether the skill is made for it."""
    rows = called_in(skill_calls(calls).filter("skill is not null"), turns, sessions, r, f)
    out = rows.groupBy("session_id", "skill").agg(F.count("*").alias("invocations")).filter(F.col("invocations") >= min_count)
    out = out.withColumn("reentrant", F.lower("skill").isin(*REENTRANT))
    return out.orderBy(F.desc("invocations"), "session_id", "skill").limit(limit) if limit else out


def skill_thrash_summary(thrash: DataFrame) -> DataFrame:
    """Pairs, sessions and skills that thrash, and how many pairs aren't re-entrant by design."""
    return thrash.agg(F.count("*").alias("pairs"), F.countDistinct("session_id").alias("sessions"), F.countDistinct("skill").alias("skills"), F.coalesce(F.max("invocations"), F.lit(0)).alias("worst"), F.count_if(~F.col("reentrant")).alias("unexpected_pairs"))


def skill_trend(skills: DataFrame, calls: DataFrame, turns: DataFrame, sessions: DataFrame, r: Range, unit: str = "day", f: Filters = NO_FILTERS, tz: str = "UTC") -> DataFrame:
    """Per bucket of a session's first turn in the range: mean skills loaded and invoked over sessions that have any."""
    first = turn_filters(turns.filter(r.holds("timestamp")), sessions, f).groupBy("session_id").agg(F.min("timestamp").alias("t"))
    loaded = skills.groupBy("session_id").agg(F.countDistinct("skill_name").alias("loaded"))
    invoked = skill_calls(calls).filter("skill is not null").groupBy("session_id").agg(F.countDistinct("skill").alias("invoked"))
    rows = first.join(loaded, "session_id", "left").join(invoked, "session_id", "left")
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    return rows.groupBy(bucket("t", unit, tz).alias("bucket")).agg(mean("loaded").alias("avg_loaded"), mean("invoked").alias("avg_invoked"))


def skill_merge(loaded: DataFrame, invoked: DataFrame, sort: str = "weight") -> DataFrame:
    """Loaded and invoked skills in one table with a status; sort: weight, loaded or invocations."""
    left = loaded.select("skill", "sessions_loaded", "estimated_tokens", F.col("invocations").alias("_in_sessions"))
    right = invoked.select("skill", "invocations", "success_rate")
    out = left.join(right, "skill", "full").na.fill(0, ["sessions_loaded", "estimated_tokens", "invocations"])
    status = F.when(F.col("sessions_loaded") == 0, "invoked (not loaded)").when(F.col("invocations") == 0, "dead weight").otherwise("used")
    out = out.withColumn("weight", F.col("sessions_loaded") * F.col("estimated_tokens")).withColumn("status", status).drop("_in_sessions")
    column = {"weight": "weight", "loaded": "sessions_loaded", "invocations": "invocations"}[sort]
    return out.orderBy(F.desc(column), "skill")
