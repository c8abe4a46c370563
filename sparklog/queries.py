"""The registered queries of the session-log operators, each beside the SQL that must give the same rows.

Both sides start from `events`: the operators from sparklog.project, the SQL from STAR, written separately.
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparklog import project
from sparklog.functions import exprs
from sparklog.functions.exprs import Filters, Range
from sparklog.operators import activity, cache, cost, plan_fit, prompts, sessions, shred, skills, tools
from sparklog.plans.windows import FIVE_HOURS, WEEK, anchored_windows, anchored_windows_in_blocks
from sparklog.schemas import DEFAULT_RATE, RATES
from sparklog.sources import merge
from sparklog.streaming import live

R = Range(dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 26))
TZ = "Asia/Jerusalem"
NOW = dt.datetime(2024, 1, 31)

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def _case(model: str, value) -> str:
    arms = " ".join(f"WHEN lower({model}) LIKE '{r.prefix}%' THEN {float(value(r))}" for r in RATES)
    return f"CAST(CASE {arms} ELSE {float(value(DEFAULT_RATE))} END AS DOUBLE)"


_CATEGORY = {"input": "input_tokens", "output": "output_tokens", "cache_creation": "cache_creation_tokens", "cache_read": "cache_read_tokens"}
_COST = {c: f"{col} * {_case('model', lambda r, c=c: getattr(r, c))} / 1000000" for c, col in _CATEGORY.items()}
_SAVED = f"cache_read_tokens * {_case('model', lambda r: r.input - r.cache_read)} / 1000000"
_SUMS = """CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(output_tokens),0) AS BIGINT) AS output_tokens,
 CAST(coalesce(sum(cache_creation_tokens),0) AS BIGINT) AS cache_creation_tokens, CAST(coalesce(sum(cache_read_tokens),0) AS BIGINT) AS cache_read_tokens,
 CAST(coalesce(sum(input_tokens+output_tokens),0) AS BIGINT) AS total_tokens,
 CAST(coalesce(sum(input_tokens+output_tokens+cache_creation_tokens+cache_read_tokens),0) AS BIGINT) AS context_volume"""
_COSTS = ", ".join(f"round(coalesce(sum({e}),0),6) AS {c}_cost" for c, e in _COST.items())
_COST_ROW = "role='assistant' AND model IS NOT NULL AND model<>'<synthetic>'"
_IN = "timestamp >= TIMESTAMP '2024-01-05 00:00:00' AND timestamp < TIMESTAMP '2024-01-26 00:00:00'"
_STARTED = _IN.replace("timestamp ", "start_time ")
_LOCAL = "timestamp AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jerusalem'"

STAR = """WITH RECURSIVE ev AS (
 SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(event_id AS VARCHAR) AS turn_id,
  CAST(user_id AS VARCHAR) || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS session_id FROM events),
t AS (
 SELECT turn_id, session_id, user_id, event_id, k, CASE WHEN event_type='view' THEN 'user' ELSE 'assistant' END AS role, ts AS timestamp,
  CASE WHEN event_type='view' THEN 0 ELSE CAST(floor(value*10) AS BIGINT) END AS input_tokens,
  CASE WHEN event_type='view' THEN 0 ELSE CAST(k*7 AS BIGINT) END AS output_tokens,
  CASE WHEN event_type='view' THEN 0 ELSE CAST(event_id%13*1000 AS BIGINT) END AS cache_creation_tokens,
  CASE WHEN event_type='view' THEN 0 ELSE CAST(event_id%17*15000 AS BIGINT) END AS cache_read_tokens,
  CASE WHEN event_type='view' THEN 0.0 ELSE value/100 END AS cost_usd,
  CASE WHEN event_type='view' OR k%20=0 THEN NULL WHEN k%20=1 THEN '<synthetic>' WHEN k%5 IN (0,4) THEN 'claude-opus-4-7'
   WHEN k%5=1 THEN 'claude-sonnet-4-5' WHEN k%5=2 THEN 'claude-haiku-4-5' ELSE 'other-model-1' END AS model,
  CASE WHEN event_type='view' THEN NULL WHEN k%25=3 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason,
  CASE WHEN event_type='view' THEN NULL ELSE 'r' || CAST(event_id//2 AS VARCHAR) END AS request_id,
  event_type<>'view' AND k%4=0 AS has_thinking,
  CASE WHEN event_type='view' AND k%10<>0 THEN 'prompt ' || turn_id END AS content_text FROM ev),
c AS (
 SELECT md5(turn_id || '-' || CAST(i AS VARCHAR)) AS tool_call_id, session_id, turn_id,
  CASE WHEN k%11=0 THEN 'Skill' WHEN event_type='purchase' THEN 'mcp__shop__buy' WHEN event_type='error' THEN 'Bash' WHEN event_id%2=0 THEN 'Read' ELSE 'Edit' END AS tool_name,
  CASE WHEN k%11<>0 AND event_type='purchase' THEN 'mcp' ELSE 'builtin' END AS tool_type,
  CASE WHEN k%11<>0 AND event_type='purchase' THEN 'shop' END AS mcp_server,
  CASE WHEN k%3<>1 THEN k*10+i END AS duration_ms, CASE WHEN k%7<>0 THEN event_type<>'error' END AS success,
  CASE WHEN k%7<>0 AND event_type='error' THEN 'error ' || CAST(k%6 AS VARCHAR) END AS error_message,
  CASE WHEN k%11=0 THEN 'skill-' || CAST(k%10 AS VARCHAR) END AS skill
 FROM ev CROSS JOIN (SELECT 0 AS i UNION ALL SELECT 1) AS two WHERE event_type IN ('click','purchase','error') AND (i=0 OR k%3=0)),
sk AS (
 SELECT session_id, turn_id, (CASE WHEN k%8=0 THEN 'idle-' ELSE 'skill-' END) || CAST(k%10 AS VARCHAR) AS skill_name,
  CASE WHEN k>0 THEN repeat('x', k) END AS skill_description FROM ev WHERE event_type='view' AND k%4=0),
firsts AS (
 SELECT session_id, model FROM (SELECT session_id, model, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, turn_id) AS rn FROM t WHERE model IS NOT NULL) AS x WHERE rn=1),
s AS (
 SELECT g.session_id, start_time, CASE WHEN n>1 THEN last_time END AS end_time,
  CASE WHEN n>1 THEN CAST(floor(date_diff('microsecond', start_time, last_time)/1000000.0+0.5) AS INTEGER) END AS duration_seconds, f.model,
  CASE WHEN u%11<>0 THEN '/projects/p' || CAST(u%7 AS VARCHAR) END AS project_path, CASE WHEN u%11<>0 THEN 'p' || CAST(u%7 AS VARCHAR) END AS project_name,
  CASE WHEN u%2=0 THEN 'cli' ELSE 'desktop' END AS source_type, total_cost_usd, num_turns
 FROM (SELECT session_id, min(user_id) AS u, min(timestamp) AS start_time, max(timestamp) AS last_time, count(*) AS n, sum(cost_usd) AS total_cost_usd, count(*) AS num_turns FROM t GROUP BY session_id) AS g
 LEFT JOIN firsts f ON f.session_id=g.session_id),
used AS (SELECT c.*, t.timestamp, t.model FROM c JOIN t ON t.turn_id=c.turn_id AND t.session_id=c.session_id WHERE """ + _IN + """)"""


def query(sql: str | None, extra: str = "") -> Callable[[Callable[[project.Tables], DataFrame]], Callable]:
    """Registers a query on the star schema under its function's name, with SQL after STAR."""

    def keep(f: Callable[[project.Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(project.tables(spark, sf_dir))
        if sql is not None:
            SQL[f.__name__] = f"{STAR}{extra}\n{sql}"
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded for comparison, dates and times as text."""
    out = {}
    for name, kind in df.dtypes:
        if kind == "double":
            out[name] = F.round(name, digits)
        elif kind in ("date", "timestamp_ntz"):
            out[name] = F.col(name).cast("string")
        elif kind == "int":
            out[name] = F.col(name).cast("long")
    return df.withColumns(out)


# --- cost and tokens -------------------------------------------------------------------------------------


@query(f"""SELECT CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS date, model, round(sum(cost_usd),6) AS total_cost, CAST(sum(input_tokens) AS BIGINT) AS input_tokens,
 CAST(sum(output_tokens) AS BIGINT) AS output_tokens, CAST(sum(cache_creation_tokens) AS BIGINT) AS cache_creation_tokens, CAST(sum(cache_read_tokens) AS BIGINT) AS cache_read_tokens,
 count(*) AS turn_count, count(DISTINCT session_id) AS session_count FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1, 2""")  # fmt: skip
def daily_cost(x):
    return rounded(cost.daily_cost(x.turns, x.sessions, R, tz=TZ))


@query(f"SELECT model, round(sum(cost_usd),6) AS total_cost, {_COSTS}, {_SUMS}, count(DISTINCT session_id) AS session_count FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1")
def cost_by_model(x):
    return rounded(cost.cost_by_model(x.turns, x.sessions, R))


_PROJECT = f"""SELECT coalesce(s.project_path,'unknown') AS project_path, round(sum(cost_usd),6) AS total_cost, {_COSTS}, {_SUMS}, count(DISTINCT t.session_id) AS session_count
 FROM (SELECT session_id, project_path FROM s WHERE {_STARTED}) AS s JOIN t ON s.session_id=t.session_id WHERE {_COST_ROW} GROUP BY 1"""


@query(_PROJECT)
def cost_by_project(x):
    return rounded(cost.cost_by_project(x.sessions, x.turns, R))


def _trend(unit: str):
    sql = f"""SELECT CAST(CAST(date_trunc('{unit}', {_LOCAL}) AS TIMESTAMP) AS VARCHAR) AS bucket, round(sum(cost_usd),6) AS total_cost,
 CAST(sum(input_tokens+output_tokens) AS BIGINT) AS total_tokens, count(*) AS turn_count FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1"""

    def trend(x):
        return rounded(cost.cost_trend(x.turns, x.sessions, R, unit, tz=TZ))

    trend.__name__ = "cost_trend" if unit == "day" else f"cost_trend_{unit}"
    query(sql)(trend)


for _unit in ("hour", "day", "week", "month"):
    _trend(_unit)


@query(f"SELECT round(coalesce(sum(cost_usd),0),6) AS total_cost, {_COSTS}, {_SUMS}, count(DISTINCT session_id) AS session_count FROM t WHERE {_COST_ROW} AND {_IN}")
def total_cost(x):
    return rounded(cost.total_cost(x.turns, x.sessions, R))


@query(f"SELECT round(coalesce(sum(cost_usd),0),6) AS total_cost, {_SUMS} FROM t WHERE {_COST_ROW} AND {_IN} AND model LIKE '%opus%' AND session_id IN (SELECT session_id FROM s WHERE project_path='/projects/p3' AND source_type='cli')")
def turn_filters(x):
    return rounded(cost.total_cost(x.turns, x.sessions, R, Filters("opus", "/projects/p3", "cli"))).select("total_cost", *[f"{c}_tokens" for c in _CATEGORY], "total_tokens", "context_volume")


@query(f"SELECT 'all_time' AS block, {_SUMS} FROM t WHERE {_COST_ROW} UNION ALL SELECT 'period' AS block, {_SUMS} FROM t WHERE {_COST_ROW} AND {_IN} AND model LIKE '%sonnet%'")
def token_totals(x):
    return rounded(cost.token_totals(x.turns, x.sessions, R, Filters(model="sonnet")))


_COST_ROWS_SQL = f"SELECT turn_id, model, round(cost_usd,6) AS cost_usd FROM t WHERE {_COST_ROW}"


@query(_COST_ROWS_SQL)
def cost_rows(x):
    return rounded(exprs.cost_rows(x.turns).select("turn_id", "model", "cost_usd"))


@query(f"SELECT turn_id, round({' + '.join(_COST.values())}, 9) AS cost_usd FROM t WHERE role='assistant'")
def with_cost(x):
    return rounded(exprs.with_cost(x.turns.filter("role = 'assistant'")).select("turn_id", "cost_usd"), 9)


@query(f"SELECT turn_id, {', '.join(f'{_case("model", lambda r, c=c: getattr(r, c))} AS {c}' for c in _CATEGORY)} FROM t WHERE role='assistant'")
def rate_of_model(x):
    return x.turns.filter("role = 'assistant'").select("turn_id", *[exprs.rate(c).alias(c) for c in _CATEGORY])


@query(f"SELECT turn_id, round({_case('model', lambda r: r.input - r.cache_read)},6) AS savings_rate FROM t WHERE role='assistant'")
def savings_rate(x):
    return rounded(x.turns.filter("role = 'assistant'").select("turn_id", exprs.savings_rate().alias("savings_rate")))


@query(f"SELECT session_id, {_SUMS} FROM t GROUP BY 1")
def token_sums(x):
    return x.turns.groupBy("session_id").agg(*exprs.token_sums())


@query("SELECT turn_id, CASE WHEN lower(coalesce(model,'')) LIKE '%fable%' THEN 'fable' WHEN lower(coalesce(model,'')) LIKE '%opus%' THEN 'opus' WHEN lower(coalesce(model,'')) LIKE '%sonnet%' THEN 'sonnet' ELSE 'other' END AS class FROM t")
def model_class(x):
    return x.turns.select("turn_id", exprs.model_class().alias("class"))


@query(f"SELECT turn_id, CAST({_LOCAL} AS VARCHAR) AS local_time FROM t")
def local_time(x):
    return rounded(x.turns.select("turn_id", exprs.local_ts("timestamp", TZ).alias("local_time")))


@query(f"SELECT turn_id, CAST(CAST(date_trunc('hour', {_LOCAL}) AS TIMESTAMP) AS VARCHAR) AS hour, CAST(CAST(date_trunc('week', {_LOCAL}) AS TIMESTAMP) AS VARCHAR) AS week, CAST(CAST(date_trunc('month', {_LOCAL}) AS TIMESTAMP) AS VARCHAR) AS month FROM t")
def time_bucket(x):
    return rounded(x.turns.select("turn_id", *[exprs.bucket("timestamp", u, TZ).alias(u) for u in ("hour", "week", "month")]))


@query("SELECT DISTINCT model FROM t WHERE model IS NOT NULL AND model<>'<synthetic>' AND model LIKE 'other%'")
def unpriced_models(x):
    return shred.unpriced_models(x.turns)


_NEW_COST = f"CASE WHEN role='assistant' THEN {' + '.join(_COST.values())} ELSE cost_usd END"


@query(f"SELECT session_id, round(sum({_NEW_COST}),6) AS total_cost_usd FROM t GROUP BY 1")
def reprice(x):
    return rounded(shred.reprice(x.turns, x.sessions)[1].select("session_id", "total_cost_usd"))


@query(f"""SELECT s.session_id, round(s.total_cost_usd,6) AS total_cost_usd, round(n.total,6) AS child_cost, round(abs(s.total_cost_usd-n.total),6) AS difference
 FROM s JOIN (SELECT session_id, sum({_NEW_COST}) AS total FROM t GROUP BY 1) AS n ON n.session_id=s.session_id WHERE abs(s.total_cost_usd-n.total)>0.5""")
def cost_reconcile(x):
    return rounded(shred.reconcile(x.sessions, shred.reprice(x.turns, x.sessions)[0], 0.5))


_DAILY = f"SELECT CAST({_LOCAL} AS DATE) AS date, model, sum(cost_usd) AS total_cost FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1, 2"
_MODELS = ["claude-haiku-4-5", "claude-opus-4-7", "claude-sonnet-4-5", "other-model-1"]


@query("SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(f"round(coalesce(sum(CASE WHEN model='{m}' THEN total_cost END),0),6) AS \"{m}\"" for m in _MODELS) + " FROM d GROUP BY 1", f", d AS ({_DAILY})")
def cost_pivot(x):
    return rounded(cost.cost_pivot(cost.daily_cost(x.turns, x.sessions, R, tz=TZ), _MODELS))


@query("SELECT round(sum(total_cost)/count(DISTINCT date),6) AS avg_daily_cost, count(DISTINCT date) AS days FROM d", f", d AS ({_DAILY})")
def avg_daily_cost(x):
    return rounded(cost.avg_daily_cost(cost.daily_cost(x.turns, x.sessions, R, tz=TZ)))


@query("SELECT model, round(total_cost,6) AS total_cost, round(100*total_cost/(SELECT sum(total_cost) FROM m),4) AS share_pct, total_cost=(SELECT max(total_cost) FROM m) AS is_top FROM m", f", m AS (SELECT model, sum(cost_usd) AS total_cost FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1)")
def model_share(x):
    out = cost.model_share(cost.cost_by_model(x.turns, x.sessions, R))
    return out.withColumns({"total_cost": F.round("total_cost", 6), "share_pct": F.round("share_pct", 4)})


@query("SELECT source, target, value FROM (SELECT 'input' AS source, 'cache_write' AS target, w AS value FROM f UNION ALL SELECT 'input','uncached_input',i FROM f UNION ALL SELECT 'cache_read','output',r FROM f UNION ALL SELECT 'uncached_input','output',least(i,o) FROM f) AS e WHERE value>0", f", f AS (SELECT CAST(sum(input_tokens) AS BIGINT) AS i, CAST(sum(output_tokens) AS BIGINT) AS o, CAST(sum(cache_creation_tokens) AS BIGINT) AS w, CAST(sum(cache_read_tokens) AS BIGINT) AS r FROM t WHERE {_COST_ROW} AND {_IN})")
def token_flow_edges(x):
    return cost.token_flow(cost.total_cost(x.turns, x.sessions, R))


@query("SELECT round((avg(CASE WHEN n>=4 AND rn>n//2 THEN v END)-avg(CASE WHEN n>=4 AND rn<=n//2 THEN v END))/avg(CASE WHEN n>=4 AND rn<=n//2 THEN v END)*100,4) AS change_pct, max(n) AS points FROM h", f", d AS ({_DAILY}), h AS (SELECT sum(total_cost) AS v, row_number() OVER (ORDER BY date) AS rn, count(*) OVER () AS n FROM d GROUP BY date)")
def half_trend_pct(x):
    daily = cost.daily_cost(x.turns, x.sessions, R, tz=TZ).groupBy("date").agg(F.sum("total_cost").alias("v"))
    return rounded(cost.half_trend(daily, "date", "v"), 4)


@query(f"SELECT round(v,6) AS total_cost, round(100*30/30.4375,6) AS prorated_fee, round(v-100*30/30.4375,6) AS savings, round(v/(100*30/30.4375),6) AS roi_multiple, v<100*30/30.4375 AS underwater FROM (SELECT sum(cost_usd) AS v FROM t WHERE {_COST_ROW} AND {_IN}) AS q")
def subscription_value(x):
    return rounded(cost.subscription_value(cost.total_cost(x.turns, x.sessions, R).select("total_cost"), 100.0, 30))


# --- cache and activity ----------------------------------------------------------------------------------

_CACHE_SUMS = "CAST(coalesce(sum(input_tokens),0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(cache_creation_tokens),0) AS BIGINT) AS cache_creation_tokens, CAST(coalesce(sum(cache_read_tokens),0) AS BIGINT) AS cache_read_tokens"
_HIT = "coalesce(sum(cache_read_tokens)/nullif(CAST(sum(input_tokens+cache_creation_tokens+cache_read_tokens) AS DOUBLE),0),0)"


@query(f"SELECT *, CASE WHEN hit_rate>0.8 THEN 'effective' WHEN hit_rate>=0.5 THEN 'moderate' ELSE 'ineffective' END AS label FROM (SELECT {_CACHE_SUMS}, round(sum({_SAVED}),6) AS savings_usd, round({_HIT},6) AS hit_rate FROM t WHERE role='assistant' AND {_IN}) AS q")
def cache_metrics(x):
    return rounded(cache.cache_metrics(x.turns, x.sessions, R))


@query(f"SELECT CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS date, {_CACHE_SUMS}, round({_HIT},6) AS hit_rate, CAST(sum(input_tokens+cache_creation_tokens+cache_read_tokens) AS BIGINT) AS total_input FROM t WHERE role='assistant' AND {_IN} GROUP BY 1")
def cache_trend(x):
    return rounded(cache.cache_trend(x.turns, x.sessions, R, tz=TZ))


@query(f"SELECT s.session_id, {_CACHE_SUMS}, round(coalesce(sum({_SAVED.replace('model', 't.model')}),0),6) AS savings_usd, round({_HIT},4) AS hit_rate FROM s LEFT JOIN t ON t.session_id=s.session_id WHERE {_STARTED} GROUP BY 1")
def cache_by_session(x):
    return rounded(cache.cache_by_session(x.sessions, x.turns, R))


_HOURLY = f"SELECT CAST(extract(hour FROM {_LOCAL}) AS BIGINT) AS h, count(*) AS n, count(DISTINCT session_id) AS ns, avg(cost_usd) AS ac, CAST(sum(input_tokens+output_tokens) AS BIGINT) AS tt, sum(cost_usd) AS tc, avg(input_tokens+output_tokens) AS tpt FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1"


@query("SELECT g.h AS hour_of_day, coalesce(n,0) AS message_count, coalesce(ns,0) AS session_count, round(coalesce(ac,0),10) AS avg_cost, coalesce(tt,0) AS total_tokens, round(coalesce(tc,0),6) AS total_cost, round(coalesce(tpt,0),4) AS avg_tokens_per_turn FROM (SELECT CAST(range AS BIGINT) AS h FROM range(24)) AS g LEFT JOIN p ON p.h=g.h", f", p AS ({_HOURLY})")
def hourly_activity(x):
    out = activity.hourly_activity(x.turns, x.sessions, R, tz=TZ)
    return out.withColumns({"avg_cost": F.round("avg_cost", 10), "total_cost": F.round("total_cost", 6), "avg_tokens_per_turn": F.round("avg_tokens_per_turn", 4)})


@query(f"SELECT CAST(CAST({_LOCAL} AS DATE) AS VARCHAR) AS date, count(*) AS turns FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1")
def daily_activity(x):
    return rounded(activity.daily_activity(x.turns, R, TZ))


@query(f"SELECT CAST(extract(dow FROM {_LOCAL}) AS BIGINT) AS dow, CAST(extract(hour FROM {_LOCAL}) AS BIGINT) AS hour, count(*) AS turns FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1, 2")
def activity_heatmap(x):
    return rounded(activity.activity_heatmap(x.turns, R, TZ))


@query(f"SELECT CAST(CAST(date_trunc('week', {_LOCAL}) AS DATE) AS VARCHAR) AS week, count(*) AS turns FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1")
def weekly_activity(x):
    return rounded(activity.weekly_activity(x.turns, R, TZ))


@query("SELECT CAST(g.d AS VARCHAR) AS date, coalesce(turns,0) AS turns FROM (SELECT CAST(DATE '2023-12-31' + CAST(range AS INTEGER) AS DATE) AS d FROM range(32)) AS g LEFT JOIN q ON q.date=g.d", f", q AS (SELECT CAST({_LOCAL} AS DATE) AS date, count(*) AS turns FROM t WHERE {_COST_ROW} AND {_IN} GROUP BY 1)")
def calendar_fill(x):
    return rounded(activity.calendar_fill(activity.daily_activity(x.turns, R, TZ), dt.date(2024, 1, 31), 28))


@query("SELECT h AS peak_hour, n AS messages FROM p ORDER BY n DESC, h LIMIT 1", f", p AS ({_HOURLY})")
def peak_hour(x):
    return activity.peak_hour(activity.hourly_activity(x.turns, x.sessions, R, tz=TZ))


# --- sessions --------------------------------------------------------------------------------------------

_SUMMARY = f""", summary AS (SELECT s.session_id, start_time, end_time, duration_seconds, s.model, project_path, project_name, source_type, round(coalesce(a.total_cost,0),6) AS total_cost,
 input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, total_tokens, context_volume, coalesce(turn_count,0) AS turn_count, coalesce(tool_call_count,0) AS tool_call_count,
 coalesce(round(cache_read_tokens/nullif(CAST(cache_read_tokens+cache_creation_tokens+input_tokens AS DOUBLE),0),4),0) AS cache_hit_rate
 FROM s LEFT JOIN (SELECT session_id, sum(cost_usd) AS total_cost, {_SUMS}, count(*) AS turn_count FROM t GROUP BY 1) AS a ON a.session_id=s.session_id
 LEFT JOIN (SELECT session_id, count(*) AS tool_call_count FROM c GROUP BY 1) AS b ON b.session_id=s.session_id)"""
_TEXT_TIMES = "SELECT * REPLACE (CAST(start_time AS VARCHAR) AS start_time, CAST(end_time AS VARCHAR) AS end_time, CAST(duration_seconds AS BIGINT) AS duration_seconds)"


def _summary(x):
    return sessions.session_summary(x.sessions, x.turns, x.calls)


@query(f"{_TEXT_TIMES} FROM summary", _SUMMARY)
def session_summary(x):
    return rounded(_summary(x))


@query(f"{_TEXT_TIMES} FROM (SELECT * FROM summary WHERE {_STARTED} AND source_type='cli' ORDER BY total_tokens DESC, session_id LIMIT 50 OFFSET 10) AS q", _SUMMARY)
def list_sessions(x):
    return rounded(sessions.list_sessions(_summary(x), R, Filters(source="cli"), "total_tokens", True, 50, 10))


@query(f"SELECT count(*) AS total FROM s WHERE {_STARTED} AND source_type='cli'")
def session_count(x):
    return sessions.count_sessions(x.sessions, R, Filters(source="cli"))


@query(f"SELECT session_id, source_type, model FROM s WHERE {_STARTED} AND model LIKE '%opus%' AND project_path='/projects/p2' AND source_type='desktop'")
def session_filters(x):
    return exprs.session_filters(x.sessions.filter(R.holds("start_time")), Filters("opus", "/projects/p2", "desktop")).select("session_id", "source_type", "model")


@query(f"""SELECT count(*) AS sessions, CAST(coalesce(sum(turn_count),0) AS BIGINT) AS turns, round(avg(duration_seconds),4) AS avg_duration,
 round(avg(CASE WHEN duration_seconds IS NOT NULL THEN least(duration_seconds,43200) END),4) AS avg_capped_duration, round(median(duration_seconds),4) AS median_duration,
 round(coalesce(sum(total_cost),0),4) AS total_cost, round(avg(total_cost),4) AS avg_cost, count(DISTINCT model) AS models FROM summary WHERE {_STARTED}""", _SUMMARY)  # fmt: skip
def session_stats(x):
    return rounded(sessions.session_stats(_summary(x), R), 4)


_PRESSURE = f""", util AS (SELECT session_id, stop_reason, input_tokens+cache_read_tokens+cache_creation_tokens AS ct,
 (input_tokens+cache_read_tokens+cache_creation_tokens)/CAST(CASE WHEN lower(coalesce(model,'')) LIKE '%-1m%' OR lower(coalesce(model,'')) LIKE '%1m-context%'
 OR input_tokens+cache_read_tokens+cache_creation_tokens>200000 THEN 1000000 ELSE 200000 END AS DOUBLE) AS u FROM t WHERE role='assistant' AND {_IN}),
pressure AS (SELECT session_id, count(*) AS assistant_turns, max(u) AS peak, max(ct) AS peak_context_tokens, avg(u) AS av, count(*) FILTER (WHERE u>0.6) AS turns_over_60,
 count(*) FILTER (WHERE u>0.8) AS turns_over_80, count(*) FILTER (WHERE stop_reason='max_tokens') AS max_tokens_turns FROM util GROUP BY 1)"""


@query("SELECT session_id, assistant_turns, round(peak,6) AS peak_utilisation, peak_context_tokens, round(av,10) AS avg_utilisation, turns_over_60, turns_over_80, max_tokens_turns, round(turns_over_60/CAST(assistant_turns AS DOUBLE),6) AS pressure_share FROM pressure", _PRESSURE)
def context_pressure(x):
    return rounded(rounded(sessions.context_pressure(x.turns, x.sessions, R), 10).withColumns({c: F.round(c, 6) for c in ("peak_utilisation", "pressure_share")}), 10)


@query("SELECT turn_id, input_tokens+cache_read_tokens+cache_creation_tokens AS context_tokens, CAST(CASE WHEN input_tokens+cache_read_tokens+cache_creation_tokens>200000 THEN 1000000 ELSE 200000 END AS BIGINT) AS window_size FROM t WHERE role='assistant'")
def context_window(x):
    return rounded(exprs.with_context(x.turns).select("turn_id", "context_tokens", "window_size"))


@query("SELECT count(*) AS sessions, count(*) FILTER (WHERE peak>0.6) AS sessions_over_60, count(*) FILTER (WHERE peak>0.8) AS sessions_over_80, round(count(*) FILTER (WHERE peak>0.6)/CAST(count(*) AS DOUBLE),6) AS rate_over_60, round(count(*) FILTER (WHERE peak>0.8)/CAST(count(*) AS DOUBLE),6) AS rate_over_80, round(max(peak),6) AS worst_peak, CAST(sum(max_tokens_turns) AS BIGINT) AS truncations FROM pressure", _PRESSURE)
def context_pressure_stats(x):
    return rounded(sessions.context_pressure_stats(x.turns, x.sessions, R))


@query("SELECT CAST(g.range AS BIGINT) AS position, CASE g.range WHEN 0 THEN '0-20%' WHEN 1 THEN '20-40%' WHEN 2 THEN '40-60%' WHEN 3 THEN '60-80%' WHEN 4 THEN '80-100%' ELSE '>100%' END AS bucket, coalesce(n,0) AS sessions FROM range(6) AS g LEFT JOIN (SELECT CASE WHEN peak>1 THEN 5 ELSE least(CAST(floor(peak*5) AS INTEGER),4) END AS b, count(*) AS n FROM pressure GROUP BY 1) AS q ON q.b=g.range", _PRESSURE)
def context_histogram(x):
    return sessions.context_histogram(sessions.context_pressure(x.turns, x.sessions, R))


@query("SELECT session_id, turn_id, CAST(timestamp AS VARCHAR) AS timestamp, round(cost_usd,6) AS cost_usd, input_tokens, output_tokens, cache_creation_tokens, cache_read_tokens, round(sum(cost_usd) OVER (PARTITION BY session_id ORDER BY timestamp, turn_id ROWS UNBOUNDED PRECEDING),6) AS cumulative_cost FROM t")
def cumulative_cost(x):
    return rounded(sessions.cumulative_cost(x.turns))


@query("SELECT session_id, turn_id, count(*) AS calls, min(tool_call_id) AS first_call FROM c GROUP BY 1, 2")
def calls_per_turn(x):
    return sessions.calls_per_turn(x.calls).select("session_id", "turn_id", "calls", F.col("tool_calls")[0]["tool_call_id"].alias("first_call"))


_ONE = "(SELECT session_id FROM t GROUP BY session_id ORDER BY count(*) DESC, session_id LIMIT 1)"


@query(f"""SELECT 'session' AS part, session_id AS id, CAST(num_turns AS VARCHAR) AS what, round(total_cost_usd,6) AS cost_usd FROM s WHERE session_id={_ONE} UNION ALL SELECT 'turn', turn_id, role, round(cost_usd,6) FROM t WHERE session_id={_ONE}
 UNION ALL SELECT 'call', tool_call_id, tool_name, NULL FROM c WHERE session_id={_ONE} UNION ALL SELECT 'error', turn_id || '-stop', 'max_tokens_truncation', NULL FROM t WHERE session_id={_ONE} AND stop_reason='max_tokens'""")  # fmt: skip
def session_detail(x):
    largest = x.turns.groupBy("session_id").count().orderBy(F.desc("count"), "session_id").limit(1)
    summary, turns, calls, errors = sessions.session_detail(x.sessions, x.turns, x.calls, shred.stop_errors(x.turns), largest)
    none = F.lit(None).cast("double").alias("cost_usd")
    parts = (
        summary.select(F.lit("session").alias("part"), F.col("session_id").alias("id"), F.col("num_turns").cast("string").alias("what"), F.col("total_cost_usd").alias("cost_usd")),
        turns.select(F.lit("turn"), "turn_id", "role", "cost_usd"), calls.select(F.lit("call"), "tool_call_id", "tool_name", none), errors.select(F.lit("error"), "error_id", "error_type", none),
    )
    return rounded(parts[0].union(parts[1]).union(parts[2]).union(parts[3]))


@query(f"SELECT DISTINCT model FROM s WHERE model IS NOT NULL AND {_STARTED}")
def list_models(x):
    return sessions.list_models(x.sessions, R)


@query(f"SELECT project_path, max(project_name) AS project_name, count(*) AS sessions, CAST(max(start_time) AS VARCHAR) AS last_active FROM s WHERE project_path IS NOT NULL AND {_STARTED} GROUP BY 1")
def list_projects(x):
    return rounded(sessions.list_projects(x.sessions, R))


@query(f"SELECT source_type, count(*) AS sessions FROM s WHERE {_STARTED} GROUP BY 1")
def list_sources(x):
    return sessions.list_sources(x.sessions, R)


@query("SELECT session_id, CAST(start_time AS VARCHAR) AS start_time, CAST(duration_seconds AS BIGINT) AS duration_seconds, model, num_turns, round(total_cost_usd,6) AS total_cost_usd, coalesce(n,0) AS num_tool_calls FROM s LEFT JOIN (SELECT session_id AS i, count(*) AS n FROM c GROUP BY 1) AS q ON q.i=s.session_id")
def session_rollup(x):
    return rounded(shred.session_rollup(x.turns, x.calls).select("session_id", "start_time", "duration_seconds", "model", "num_turns", "total_cost_usd", "num_tool_calls"))


@query("SELECT turn_id || '-stop' AS error_id, session_id, 'max_tokens_truncation' AS error_type, true AS is_retryable FROM t WHERE stop_reason='max_tokens'")
def errors_from_stop_reason(x):
    return shred.stop_errors(x.turns).select("error_id", "session_id", "error_type", "is_retryable")


@query("SELECT tool_call_id || '-toolerr' AS error_id, c.session_id, CAST(t.timestamp AS VARCHAR) AS timestamp, error_message AS message FROM c JOIN t ON t.turn_id=c.turn_id WHERE NOT success")
def errors_from_results(x):
    calls = x.calls.join(x.turns.select("turn_id", "timestamp"), "turn_id")
    results = x.calls.filter("success is not null").select("tool_call_id", (~F.col("success")).alias("is_error"), F.col("error_message").alias("result"), "session_id", F.lit(NOW).cast("timestamp_ntz").alias("timestamp"))
    return rounded(shred.tool_errors(calls, results).select("error_id", "session_id", "timestamp", "message"))


@query("SELECT tool_call_id, tool_name, tool_type, mcp_server FROM c")
def classify_tool(x):
    kind, server = exprs.classify_tool()
    return x.calls.select("tool_call_id", "tool_name", kind.alias("tool_type"), server.alias("mcp_server"))


@query("SELECT tool_call_id, CASE WHEN tool_type='mcp' THEN 'mcp' ELSE 'builtin' END AS class FROM c")
def tool_class(x):
    return x.calls.select("tool_call_id", exprs.tool_class().alias("class"))


@query("SELECT tool_call_id, success, error_message FROM c")
def tool_result_join(x):
    results = x.calls.filter("success is not null").select("tool_call_id", (~F.col("success")).alias("is_error"), F.coalesce("error_message", F.lit("ok")).alias("result"))
    return shred.join_tool_results(x.calls.drop("success", "error_message"), results).select("tool_call_id", "success", "error_message")


@query("SELECT tool_call_id, skill FROM c WHERE tool_name='Skill'")
def skill_of_call(x):
    return exprs.skill_calls(x.calls).select("tool_call_id", "skill")


@query("SELECT turn_id, request_id FROM t WHERE request_id IS NULL UNION ALL SELECT turn_id, request_id FROM (SELECT turn_id, request_id, row_number() OVER (PARTITION BY session_id, request_id ORDER BY timestamp DESC, turn_id DESC) AS rn FROM t WHERE request_id IS NOT NULL) AS q WHERE rn=1")
def dedup_last_request(x):
    return shred.dedup_last(x.turns, "request_id", ["timestamp", "turn_id"], ["session_id"]).select("turn_id", "request_id")


# --- tools -----------------------------------------------------------------------------------------------

_OUT = "count(*) AS calls, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, round(count(*) FILTER (WHERE success)/nullif(CAST(count(success) AS DOUBLE),0),6) AS success_rate, round(avg(duration_ms),6) AS avg_duration_ms"
_USAGE = f"SELECT tool_name, tool_type, mcp_server, {_OUT}, count(DISTINCT session_id) AS sessions, round(count(*)/CAST(count(DISTINCT session_id) AS DOUBLE),6) AS avg_per_session FROM used GROUP BY 1, 2, 3"


def _usage(x):
    return tools.tool_usage(x.calls, x.turns, x.sessions, R)


@query(_USAGE)
def tool_usage(x):
    return rounded(_usage(x))


@query(f"SELECT a.*, coalesce(e.texts,'') AS common_errors FROM (SELECT tool_name, {_OUT} FROM used GROUP BY 1) AS a LEFT JOIN (SELECT tool_name, string_agg(error_message, ';' ORDER BY n DESC, error_message) AS texts FROM (SELECT tool_name, error_message, count(*) AS n, row_number() OVER (PARTITION BY tool_name ORDER BY count(*) DESC, error_message) AS rn FROM used WHERE NOT success AND error_message IS NOT NULL GROUP BY 1, 2) AS q WHERE rn<=5 GROUP BY 1) AS e ON e.tool_name=a.tool_name")
def tool_success(x):
    return rounded(tools.tool_success(x.calls, x.turns, R).withColumn("common_errors", F.array_join("common_errors", ";")))


@query("SELECT mcp_server, count(*) AS calls, round(avg(duration_ms),6) AS avg_duration_ms, min(tool_name) AS tools FROM used WHERE mcp_server IS NOT NULL GROUP BY 1")
def mcp_servers(x):
    return rounded(tools.mcp_servers(x.calls, x.turns, R).withColumn("tools", F.array_join("tools", ";")))


_CLASSES = ", ".join(
    f"count(*) FILTER (WHERE {w}) AS {n}_calls, count(*) FILTER (WHERE {w} AND success IS NOT NULL) AS {n}_evaluated, count(*) FILTER (WHERE {w} AND NOT success) AS {n}_failures, round(count(*) FILTER (WHERE {w} AND NOT success)/nullif(CAST(count(*) FILTER (WHERE {w} AND success IS NOT NULL) AS DOUBLE),0),6) AS {n}_failure_rate"
    for n, w in (("builtin", "tool_type<>'mcp'"), ("mcp", "tool_type='mcp'"), ("overall", "true"))
)


@query(f"SELECT CAST(CAST(date_trunc('day', {_LOCAL}) AS TIMESTAMP) AS VARCHAR) AS bucket, {_CLASSES} FROM used GROUP BY 1")
def tool_failure_trend(x):
    return rounded(tools.tool_failure_trend(x.calls, x.turns, x.sessions, R, tz=TZ))


_STREAKS = """, numbered AS (SELECT session_id, success, row_number() OVER (PARTITION BY session_id ORDER BY timestamp, tool_call_id)
 - row_number() OVER (PARTITION BY session_id, success ORDER BY timestamp, tool_call_id) AS g FROM used WHERE success IS NOT NULL),
runs AS (SELECT session_id, count(*) AS n FROM numbered WHERE NOT success GROUP BY session_id, g),
streaks AS (SELECT d.session_id, coalesce(max(n),0) AS max_failure_streak, count(*) FILTER (WHERE n>=2) AS streaks_2plus, count(*) FILTER (WHERE n>=3) AS streaks_3plus,
 CAST(coalesce(sum(n) FILTER (WHERE n>=2),0) AS BIGINT) AS failed_in_streaks FROM (SELECT DISTINCT session_id FROM numbered) AS d LEFT JOIN runs r ON r.session_id=d.session_id GROUP BY 1)"""


def _streaks(x):
    return tools.failure_streaks(x.calls, x.turns, x.sessions, R)


@query("SELECT * FROM streaks", _STREAKS)
def failure_streaks(x):
    return _streaks(x)


@query("SELECT count(*) AS sessions, count(*) FILTER (WHERE streaks_2plus>0) AS sessions_2plus, count(*) FILTER (WHERE streaks_3plus>0) AS sessions_3plus, round(count(*) FILTER (WHERE streaks_3plus>0)/CAST(count(*) AS DOUBLE),6) AS rate_3plus, max(max_failure_streak) AS worst_streak FROM streaks", _STREAKS)
def failure_streak_summary(x):
    return rounded(tools.failure_streak_summary(_streaks(x)))


@query("SELECT * FROM streaks WHERE max_failure_streak>=2 ORDER BY max_failure_streak DESC, failed_in_streaks DESC, session_id LIMIT 20", _STREAKS)
def failure_offenders(x):
    return tools.failure_offenders(_streaks(x))


_CHAINS = """, legs AS (SELECT tool_name AS a, lead(tool_name,1) OVER w AS b, lead(tool_name,2) OVER w AS d, duration_ms AS x, lead(duration_ms,1) OVER w AS y, lead(duration_ms,2) OVER w AS z
 FROM used WINDOW w AS (PARTITION BY session_id ORDER BY timestamp, tool_call_id)),
chains AS (SELECT a || ' -> ' || b || ' -> ' || d AS chain, count(*) AS n, avg(CASE WHEN x IS NOT NULL OR y IS NOT NULL OR z IS NOT NULL THEN coalesce(x,0)+coalesce(y,0)+coalesce(z,0) END) AS av
 FROM legs WHERE d IS NOT NULL GROUP BY 1 HAVING count(*)>=3 ORDER BY n DESC, chain LIMIT 20)"""


@query("SELECT chain, n, round(av,6) AS avg_duration_ms FROM chains", _CHAINS)
def tool_chains(x):
    return rounded(tools.tool_chains(x.calls, x.turns, R))


@query("SELECT source, target, CAST(sum(n) AS BIGINT) AS weight FROM (SELECT split_part(chain,' -> ',1) AS source, split_part(chain,' -> ',2) AS target, n FROM chains UNION ALL SELECT split_part(chain,' -> ',2), split_part(chain,' -> ',3), n FROM chains) AS e WHERE source<>target GROUP BY 1, 2", _CHAINS)
def tool_transitions(x):
    return tools.tool_transitions(tools.tool_chains(x.calls, x.turns, R))


@query("SELECT count(*) AS calls, count(DISTINCT tool_name) AS tools, round(count(*) FILTER (WHERE NOT success)/CAST(count(success) AS DOUBLE),6) AS failure_rate, round(count(*) FILTER (WHERE success)/CAST(count(success) AS DOUBLE),6) AS success_rate FROM used")
def tool_overall(x):
    return rounded(tools.tool_overall(_usage(x)))


@query("SELECT a.tool_name, a.calls, round(coalesce(u.avg_per_session,0),6) AS avg_per_session FROM (SELECT tool_name, count(*) AS calls FROM used GROUP BY 1) AS a LEFT JOIN (SELECT tool_name, max(avg_per_session) AS avg_per_session FROM u GROUP BY 1) AS u ON u.tool_name=a.tool_name", f", u AS ({_USAGE})")
def tool_success_with_avg(x):
    return rounded(tools.tool_success_joined(tools.tool_success(x.calls, x.turns, R), _usage(x)).select("tool_name", "calls", "avg_per_session"))


# --- skills ----------------------------------------------------------------------------------------------

_PERIOD = f", ps AS (SELECT DISTINCT session_id FROM t WHERE {_IN})"
_EST = "CAST(CASE WHEN length(d)>0 THEN ceil(length(d)/4.0) ELSE 45 END AS BIGINT)"
_LOADED = f"""{_PERIOD}, loaded AS (SELECT skill_name AS skill, count(DISTINCT session_id) AS sessions_loaded, max(skill_description) AS d FROM sk WHERE session_id IN (SELECT session_id FROM ps) GROUP BY 1),
inv AS (SELECT skill, count(*) AS n FROM c WHERE skill IS NOT NULL AND session_id IN (SELECT session_id FROM ps) GROUP BY 1),
lo AS (SELECT l.skill, sessions_loaded, {_EST} AS estimated_tokens, coalesce(n,0) AS invocations, n IS NULL AS dead_weight FROM loaded l LEFT JOIN inv ON inv.skill=l.skill)"""
_INVOKED = "SELECT skill, count(*) AS invocations, count(DISTINCT session_id) AS sessions, count(*) FILTER (WHERE success) AS successes, count(*) FILTER (WHERE NOT success) AS failures, round(count(*) FILTER (WHERE success)/nullif(CAST(count(success) AS DOUBLE),0),6) AS success_rate, round(count(*)/CAST(count(DISTINCT session_id) AS DOUBLE),6) AS avg_per_session FROM used WHERE skill IS NOT NULL GROUP BY 1"


@query("SELECT coalesce(l.session_id,i.session_id) AS session_id, coalesce(l.skill,i.skill) AS skill, l.skill IS NOT NULL AS loaded, coalesce(n,0) AS invocations FROM (SELECT DISTINCT session_id, skill_name AS skill FROM sk) AS l FULL JOIN (SELECT session_id, skill, count(*) AS n FROM c WHERE skill IS NOT NULL GROUP BY 1, 2) AS i ON i.session_id=l.session_id AND i.skill=l.skill")
def skill_usage_pairs(x):
    return skills.skill_usage_pairs(x.skills, x.calls)


@query(_INVOKED)
def skill_invocations(x):
    return rounded(skills.skill_invocations(x.calls, x.turns, x.sessions, R))


@query("SELECT * FROM lo", _LOADED)
def skill_loaded(x):
    return skills.skill_loaded(x.skills, x.calls, x.turns, x.sessions, R)


@query("SELECT turn_id, " + _EST.replace("(d)", "(skill_description)") + " AS tokens FROM sk")
def estimate_tokens(x):
    return x.skills.select(F.col("session_skill_id").alias("turn_id"), exprs.estimated_tokens().alias("tokens"))


@query(f"""SELECT round(avg_loaded,6) AS avg_loaded, max_loaded, round(avg_loaded_tokens,6) AS avg_loaded_tokens, distinct_invoked, invocations, round(success_rate,6) AS success_rate, distinct_loaded, dead_weight,
 round(avg_context_tokens,4) AS avg_context_tokens, round(distinct_invoked/CAST(distinct_loaded AS DOUBLE),6) AS invocation_rate, round(dead_weight/CAST(distinct_loaded AS DOUBLE),6) AS dead_weight_ratio,
 round(avg_loaded_tokens/avg_context_tokens,6) AS context_share, dead_weight/CAST(distinct_loaded AS DOUBLE)>0.5 OR avg_loaded_tokens/avg_context_tokens>0.05 AS too_many
 FROM (SELECT avg(n) AS avg_loaded, max(n) AS max_loaded, avg(tk) AS avg_loaded_tokens FROM per) AS a,
 (SELECT count(DISTINCT skill) AS distinct_invoked, count(*) AS invocations, count(*) FILTER (WHERE success)/nullif(CAST(count(success) AS DOUBLE),0) AS success_rate FROM used WHERE tool_name='Skill') AS b,
 (SELECT count(*) AS distinct_loaded, count(*) FILTER (WHERE dead_weight) AS dead_weight FROM lo) AS d, (SELECT avg(input_tokens+cache_read_tokens+cache_creation_tokens) AS avg_context_tokens FROM t WHERE role='assistant' AND {_IN}) AS e""",
 f"{_LOADED}, per AS (SELECT session_id, count(*) AS n, CAST(sum({_EST}) AS BIGINT) AS tk FROM (SELECT session_id, skill_name, max(skill_description) AS d FROM sk WHERE session_id IN (SELECT session_id FROM ps) GROUP BY 1, 2) AS q GROUP BY 1)")
def skill_summary(x):
    out = rounded(skills.skill_summary(x.skills, x.calls, x.turns, x.sessions, R))
    return out.withColumn("avg_context_tokens", F.round("avg_context_tokens", 4))


@query("SELECT session_id, skill, count(*) AS invocations, false AS reentrant FROM used WHERE skill IS NOT NULL GROUP BY 1, 2 HAVING count(*)>=2")
def skill_thrash(x):
    return skills.skill_thrash(x.calls, x.turns, x.sessions, R, limit=None)


@query("SELECT count(*) AS pairs, count(DISTINCT session_id) AS sessions, count(DISTINCT skill) AS skills, coalesce(max(n),0) AS worst, count(*) AS unexpected_pairs FROM (SELECT session_id, skill, count(*) AS n FROM used WHERE skill IS NOT NULL GROUP BY 1, 2 HAVING count(*)>=2) AS q")
def skill_thrash_summary(x):
    return skills.skill_thrash_summary(skills.skill_thrash(x.calls, x.turns, x.sessions, R, limit=None))


@query(f"SELECT CAST(CAST(date_trunc('week', ts AT TIME ZONE 'UTC' AT TIME ZONE 'Asia/Jerusalem') AS TIMESTAMP) AS VARCHAR) AS bucket, round(coalesce(avg(l),0),6) AS avg_loaded, round(coalesce(avg(i),0),6) AS avg_invoked FROM (SELECT session_id, min(timestamp) AS ts FROM t WHERE {_IN} GROUP BY 1) AS f LEFT JOIN (SELECT session_id AS s1, count(DISTINCT skill_name) AS l FROM sk GROUP BY 1) AS a ON s1=f.session_id LEFT JOIN (SELECT session_id AS s2, count(DISTINCT skill) AS i FROM c WHERE skill IS NOT NULL GROUP BY 1) AS b ON s2=f.session_id GROUP BY 1")
def skill_trend(x):
    return rounded(skills.skill_trend(x.skills, x.calls, x.turns, x.sessions, R, "week", tz=TZ))


@query("SELECT *, CASE WHEN sessions_loaded=0 THEN 'invoked (not loaded)' WHEN invocations=0 THEN 'dead weight' ELSE 'used' END AS status FROM (SELECT coalesce(lo.skill,i.skill) AS skill, coalesce(sessions_loaded,0) AS sessions_loaded, coalesce(estimated_tokens,0) AS estimated_tokens, coalesce(i.invocations,0) AS invocations, i.success_rate, coalesce(sessions_loaded*estimated_tokens,0) AS weight FROM lo FULL JOIN i ON i.skill=lo.skill) AS q", f"{_LOADED}, i AS ({_INVOKED})")
def skill_merge(x):
    loaded = skills.skill_loaded(x.skills, x.calls, x.turns, x.sessions, R)
    return rounded(skills.skill_merge(loaded, skills.skill_invocations(x.calls, x.turns, x.sessions, R)))


# --- prompts ---------------------------------------------------------------------------------------------


def _pairs_sql(where: str, name: str) -> str:
    return f""", {name}_n AS (SELECT *, sum(CASE WHEN content_text IS NOT NULL AND role='user' THEN 1 ELSE 0 END) OVER (PARTITION BY session_id ORDER BY timestamp, turn_id ROWS UNBOUNDED PRECEDING) AS seg FROM t WHERE {where}),
{name} AS (SELECT n.session_id, max(CASE WHEN content_text IS NOT NULL THEN n.turn_id END) AS turn_id, coalesce(sum(CASE WHEN role='assistant' THEN cost_usd END),0) AS response_cost,
 CAST(coalesce(sum(CASE WHEN role='assistant' THEN input_tokens+output_tokens END),0) AS BIGINT) AS total_tokens,
 CAST(coalesce(sum(CASE WHEN role='assistant' THEN input_tokens+output_tokens+cache_creation_tokens+cache_read_tokens END),0) AS BIGINT) AS tokens4,
 count(*) FILTER (WHERE role='assistant') AS depth, coalesce(bool_or(has_thinking) FILTER (WHERE role='assistant'), false) AS has_thinking, min(model) AS model,
 min(arr.first_model) AS first_model, max(coalesce(u.tool_calls,0)) AS tool_calls, max(coalesce(u.distinct_tools,0)) AS distinct_tools FROM {name}_n n
 LEFT JOIN (SELECT m.session_id, m.seg, count(*) AS tool_calls, count(DISTINCT tool_name) AS distinct_tools FROM {name}_n m JOIN c ON c.turn_id=m.turn_id AND m.role='assistant' GROUP BY 1, 2) AS u ON u.session_id=n.session_id AND u.seg=n.seg
 LEFT JOIN (SELECT session_id, seg, model AS first_model FROM (SELECT session_id, seg, model, row_number() OVER (PARTITION BY session_id, seg ORDER BY timestamp, turn_id) AS rn FROM {name}_n WHERE role='assistant') AS z WHERE rn=1) AS arr ON arr.session_id=n.session_id AND arr.seg=n.seg
 WHERE n.seg>0 GROUP BY n.session_id, n.seg)"""


_PAIRS = _pairs_sql(_IN, "pairs")
_SCORES = _pairs_sql("true", "every") + """, scores AS (SELECT turn_id, round((percent_rank() OVER (ORDER BY tool_calls)+percent_rank() OVER (ORDER BY total_tokens)+percent_rank() OVER (ORDER BY depth)+percent_rank() OVER (ORDER BY distinct_tools))/4*100,1) AS complexity FROM every)"""
_BOTH = _PAIRS + _SCORES
_JOINED = f"{_BOTH}, q AS (SELECT p.*, complexity FROM pairs p LEFT JOIN scores s2 ON s2.turn_id=p.turn_id)"


def _pairs(x):
    return prompts.prompt_pairs(x.turns, x.calls, x.sessions, R)


def _scores(x):
    return prompts.complexity(prompts.prompt_pairs(x.turns, x.calls, x.sessions))


_PAIR_COLUMNS = ("session_id", "turn_id", "response_cost", "total_tokens", "depth", "has_thinking", "model", "tool_calls", "distinct_tools")


@query("SELECT session_id, turn_id, round(response_cost,6) AS response_cost, total_tokens, depth, has_thinking, model, tool_calls, distinct_tools FROM pairs", _PAIRS)
def prompt_pairs(x):
    return rounded(_pairs(x).select(*_PAIR_COLUMNS))


@query("SELECT turn_id, tokens4 AS total_tokens, first_model AS model FROM pairs", _PAIRS)
def prompt_view(x):
    return prompts.prompt_pairs(x.turns, x.calls, x.sessions, R, tokens="4way", model="first").select("turn_id", "total_tokens", "model")


@query("SELECT turn_id, depth, model FROM pairs", _pairs_sql(f"{_IN} AND (role='user' OR model LIKE '%opus%')", "pairs"))
def prompt_turn_filters(x):
    return prompts.prompt_pairs(x.turns, x.calls, x.sessions, R, Filters(model="opus")).select("turn_id", "depth", "model")


@query("SELECT * FROM scores", _SCORES)
def complexity_score(x):
    return _scores(x)


@query("SELECT turn_id, preview, response_cost, complexity FROM (SELECT q.turn_id, content_text AS preview, round(response_cost,6) AS response_cost, complexity FROM q JOIN t ON t.turn_id=q.turn_id WHERE depth>0 ORDER BY complexity DESC, q.turn_id LIMIT 20) AS z", _JOINED)
def prompt_ranking(x):
    return rounded(prompts.prompt_ranking(_pairs(x), _scores(x), x.turns).select("turn_id", "preview", "response_cost", "complexity"))


@query("SELECT count(*) AS total FROM pairs WHERE depth>0", _PAIRS)
def prompt_count(x):
    return prompts.prompt_count(_pairs(x))


@query("SELECT count(*) FILTER (WHERE depth>0) AS answered, count(*) FILTER (WHERE depth=0) AS unanswered, round(avg(response_cost) FILTER (WHERE depth>0),6) AS avg_cost, round(max(response_cost) FILTER (WHERE depth>0),6) AS max_cost, round(avg(complexity) FILTER (WHERE depth>0),4) AS avg_complexity FROM q", _JOINED)
def prompt_stats(x):
    out = prompts.prompt_stats(_pairs(x), _scores(x))
    return rounded(out).withColumn("avg_complexity", F.round("avg_complexity", 4))


@query("SELECT CAST(CASE WHEN response_cost=0 THEN 0 WHEN response_cost<0.001 THEN 1 WHEN response_cost<0.01 THEN 2 WHEN response_cost<0.05 THEN 3 WHEN response_cost<0.1 THEN 4 WHEN response_cost<0.5 THEN 5 ELSE 6 END AS BIGINT) AS bucket, count(*) AS prompts FROM (SELECT round(response_cost,9) AS response_cost FROM pairs WHERE depth>0) AS z GROUP BY 1", _PAIRS)
def prompt_cost_histogram(x):
    pairs = _pairs(x).withColumn("response_cost", F.round("response_cost", 9))
    return rounded(prompts.prompt_cost_histogram(pairs).select("bucket", "prompts"))


@query("SELECT CAST(least(floor(complexity/20),4)*20 AS BIGINT) AS lower, count(*) AS prompts FROM q WHERE depth>0 GROUP BY 1", _JOINED)
def prompt_complexity_histogram(x):
    return rounded(prompts.prompt_complexity_histogram(_pairs(x), _scores(x)))


@query("SELECT count(*) AS prompts, count(DISTINCT session_id) AS sessions, round(avg(depth),6) AS turns_per_prompt, round(avg(tool_calls),6) AS calls_per_prompt, round(count(*)/CAST(count(DISTINCT session_id) AS DOUBLE),6) AS prompts_per_session FROM pairs WHERE depth>0", _PAIRS)
def prompt_throughput(x):
    return rounded(prompts.prompt_throughput(_pairs(x)))


# --- usage windows and plans -----------------------------------------------------------------------------


def _windows_sql(name: str, seconds: int, source: str = "t", key: str = "user_id") -> str:
    """Greedy windows by recursion: the next anchor is the first row at or after the end of the last window."""
    return f""", {name}_a AS (SELECT {key} AS acc, min(timestamp) AS anchor FROM {source} GROUP BY 1 UNION ALL
 SELECT a.acc, (SELECT min(timestamp) FROM {source} x WHERE x.{key}=a.acc AND x.timestamp>=a.anchor+INTERVAL {seconds} SECOND) FROM {name}_a a WHERE a.anchor IS NOT NULL),
{name} AS (SELECT a.acc, a.anchor, count(*) AS turns, sum(x.cost_usd) AS cost FROM {name}_a a JOIN {source} x ON x.{key}=a.acc AND x.timestamp>=a.anchor AND x.timestamp<a.anchor+INTERVAL {seconds} SECOND WHERE a.anchor IS NOT NULL GROUP BY 1, 2)"""


_W5, _W7 = _windows_sql("w5", FIVE_HOURS), _windows_sql("w7", WEEK)


def _weekly(x):
    return anchored_windows(x.turns, ["user_id"], WEEK)


@query("SELECT acc AS user_id, CAST(anchor AS VARCHAR) AS anchor, turns, round(cost,6) AS cost FROM w5", _W5)
def anchored_windows_5h(x):
    return rounded(anchored_windows(x.turns, ["user_id"], FIVE_HOURS))


@query("SELECT acc AS user_id, CAST(anchor AS VARCHAR) AS anchor, turns, round(cost,6) AS cost FROM w7", _W7)
def anchored_windows_7d(x):
    return rounded(_weekly(x))


@query("SELECT acc AS user_id, CAST(anchor AS VARCHAR) AS anchor, round(cost/5,6) AS fill FROM w5", _W5)
def window_fill(x):
    return rounded(plan_fit.with_fill(anchored_windows(x.turns, ["user_id"], FIVE_HOURS), 5.0).select("user_id", "anchor", "fill"))


@query("SELECT acc AS user_id, count(*) AS windows, round(max(cost/2),6) AS peak_fill, round(quantile_disc(cost/2,0.95),6) AS p95_fill, round(median(cost/2),6) AS median_fill, count(*) FILTER (WHERE round(cost/2,9)>=0.9) AS near_limit, round(max(cost),6) AS peak_cost FROM w7 GROUP BY 1", _W7)
def window_stats(x):
    return rounded(plan_fit.window_stats(_weekly(x).withColumn("cost", F.round("cost", 9)), ["user_id"], 2.0))


_CLASS_SOURCE = """, tc AS (SELECT timestamp, cost_usd, CAST(user_id AS VARCHAR) || '/all' AS acc0 FROM t UNION ALL SELECT timestamp, cost_usd, CAST(user_id AS VARCHAR) || '/' ||
 CASE WHEN lower(coalesce(model,'')) LIKE '%opus%' THEN 'opus' WHEN lower(coalesce(model,'')) LIKE '%sonnet%' THEN 'sonnet' ELSE 'other' END FROM t)"""


@query("SELECT acc AS account_class, CAST(anchor AS VARCHAR) AS anchor, turns, round(cost,6) AS cost FROM wc", _CLASS_SOURCE + _windows_sql("wc", WEEK, "tc", "acc0"))
def weekly_by_class(x):
    out = plan_fit.weekly_by_class(x.turns, ["user_id"])
    return rounded(out.select(F.concat_ws("/", F.col("user_id").cast("string"), "class").alias("account_class"), "anchor", "turns", "cost"))


@query("SELECT user_id, count(DISTINCT CAST(timestamp AS DATE)) AS active_days, CAST(greatest(floor(date_diff('second', max(timestamp), TIMESTAMP '2024-01-31 00:00:00')/86400.0),0) AS BIGINT) AS recency_days, round(greatest(date_diff('microsecond', min(timestamp), max(timestamp))/86400000000.0,1),4) AS span_days, round(sum(cost_usd),6) AS total_cost FROM t GROUP BY 1")
def active_days(x):
    out = rounded(plan_fit.activity_span(x.turns, ["user_id"], NOW))
    return out.withColumns({"span_days": F.round("span_days", 4), "recency_days": F.col("recency_days").cast("long")})


_TIERS_SQL = ", tiers AS (SELECT 'pro' AS tier, CAST(0.4103 AS DOUBLE) AS c5, CAST(2.0307 AS DOUBLE) AS c7 UNION ALL SELECT 'max-5x', CAST(0.8301 AS DOUBLE), CAST(4.0709 AS DOUBLE) UNION ALL SELECT 'max-20x', CAST(2.0711 AS DOUBLE), CAST(10.0313 AS DOUBLE))"
_ASSESS = f"""{_W5}{_W7}{_TIERS_SQL},
v5 AS (SELECT acc, tier, count(*) AS n5, count(*) FILTER (WHERE round(cost/c5,9)>=0.9) AS near5, count(*) FILTER (WHERE round(cost/c5,9)>=0.9)/CAST(count(*) AS DOUBLE) AS share5, quantile_disc(round(cost/c5,9),0.9) AS p5, max(round(cost/c5,9)) AS k5 FROM w5, tiers GROUP BY 1, 2),
v7 AS (SELECT acc, tier, count(*) AS n7, count(*) FILTER (WHERE round(cost/c7,9)>=0.9) AS near7, count(*) FILTER (WHERE round(cost/c7,9)>=0.9)/CAST(count(*) AS DOUBLE) AS share7, quantile_disc(round(cost/c7,9),0.9) AS p7, max(round(cost/c7,9)) AS k7 FROM w7, tiers GROUP BY 1, 2),
assess AS (SELECT v5.*, n7, near7, share7, p7, k7, (near5>=2 AND share5>=0.15) OR share7>=least(0.5,2.0/n7) AS strained, p5<=0.7 AND p7<=0.7 AND k5<=1 AND k7<=1 AS fits FROM v5 JOIN v7 ON v7.acc=v5.acc AND v7.tier=v5.tier)"""


def _own_tiers(spark: SparkSession) -> DataFrame:
    """Ceilings near the test accounts' usage, so that every outcome occurs."""
    return plan_fit.tier_table(spark, spark.createDataFrame([("pro", 0.4103, 2.0307), ("max-5x", 0.8301, 4.0709), ("max-20x", 2.0711, 10.0313)], "tier string, five_hour double, weekly double"))


def _usage_windows(x) -> DataFrame:
    """Both kinds of windows, their cost rounded as in the SQL."""
    return plan_fit.usage_windows(x.turns, ["user_id"]).withColumn("cost", F.round("cost", 9))


@query("SELECT acc AS user_id, tier, near5, round(share5,6) AS share5, round(p5,6) AS p90_5, round(k5,6) AS peak5, near7, round(p7,6) AS p90_7, strained, fits FROM assess", _ASSESS)
def tier_assessment(x):
    out = plan_fit.by_tier(plan_fit.usage_summary(_usage_windows(x), _own_tiers(x.turns.sparkSession), ["user_id"]), ["user_id"])
    return rounded(out.select("user_id", "tier", "near5", "share5", "p90_5", "peak5", "near7", "p90_7", "strained", "fits"))


_TREND = """, mid AS (SELECT acc, min(anchor) AS a0, date_diff('microsecond', min(anchor), max(anchor))/2.0 AS half FROM w5 GROUP BY 1),
tr AS (SELECT w5.acc, count(*) AS n, count(*) FILTER (WHERE date_diff('microsecond', a0, anchor)>=half) AS ln, avg(cost) FILTER (WHERE date_diff('microsecond', a0, anchor)>=half) AS lm,
 avg(cost) FILTER (WHERE date_diff('microsecond', a0, anchor)<half) AS em FROM w5 JOIN mid ON mid.acc=w5.acc GROUP BY 1),
trend AS (SELECT acc, em, lm, CASE WHEN n<6 OR ln<2 OR n-ln<2 THEN 'unknown' WHEN em<=0 THEN CASE WHEN lm>0 THEN 'rising' ELSE 'flat' END WHEN lm/em>=1.35 THEN 'rising' WHEN lm/em<=0.74 THEN 'falling' ELSE 'flat' END AS trend FROM tr)"""


@query("SELECT acc AS user_id, trend, round(em,10) AS early_mean, round(lm,10) AS late_mean FROM trend", _W5 + _TREND)
def usage_trend(x):
    w5 = anchored_windows(x.turns, ["user_id"], FIVE_HOURS).withColumn("cost", F.round("cost", 9))
    return rounded(plan_fit.usage_trend(w5, ["user_id"]), 10)


_PRESSED = """, pressed AS (SELECT acc, bool_or(hot) AS recent_pressure FROM (SELECT w5.acc, date_diff('microsecond', a0, anchor)>=half AND cost/0.4103>=0.9 AS hot FROM w5 JOIN mid ON mid.acc=w5.acc
 UNION ALL SELECT w7.acc, date_diff('microsecond', a0, anchor)>=half AND cost/2.0307>=0.9 FROM w7 JOIN mid ON mid.acc=w7.acc) AS z GROUP BY 1)"""


@query("SELECT acc AS user_id, recent_pressure FROM pressed", _W5 + _W7 + _TREND + _PRESSED)
def recent_pressure(x):
    return plan_fit.usage_summary(_usage_windows(x), _own_tiers(x.turns.sparkSession), ["user_id"], "pro").select("user_id", "recent_pressure")


_RUN = ", act AS (SELECT user_id AS acc, count(DISTINCT CAST(timestamp AS DATE)) AS days, greatest(floor(date_diff('second', max(timestamp), TIMESTAMP '2024-01-31 00:00:00')/86400.0),0) AS recency, greatest(date_diff('microsecond', min(timestamp), max(timestamp))/86400000000.0,1) AS span, sum(cost_usd) AS cost FROM t GROUP BY 1)"


@query("SELECT acc AS user_id, round(cost/span*30,4) AS run_rate FROM act", _RUN)
def monthly_run_rate(x):
    out = plan_fit.activity_span(x.turns, ["user_id"], NOW)
    return out.select("user_id", F.round(F.col("total_cost") / F.col("span_days") * 30, 4).alias("run_rate"))


@query("""SELECT a.acc AS user_id, CASE WHEN pro.strained AND NOT recent_pressure THEN 'stay' WHEN pro.strained THEN 'upgrade' WHEN NOT low AND cost>0 AND run<=12 THEN 'downgrade' ELSE 'stay' END AS verdict,
 CASE WHEN pro.strained AND NOT recent_pressure THEN NULL WHEN pro.strained THEN CASE WHEN NOT mid5.strained THEN 'max-5x' ELSE 'max-20x' END WHEN NOT low AND cost>0 AND run<=12 THEN 'none' END AS suggested_tier,
 CAST(CASE WHEN pro.strained AND NOT recent_pressure THEN 0 WHEN pro.strained THEN CASE WHEN NOT mid5.strained THEN 80 ELSE 180 END WHEN NOT low AND cost>0 AND run<=12 THEN -floor(20-run+0.5) ELSE 0 END AS DOUBLE) AS monthly_delta, trend
 FROM (SELECT act.acc, act.cost, act.cost/span*30 AS run, NOT (days>=5 AND nw>=6) AS low FROM act JOIN (SELECT acc, count(*) AS nw FROM w5 GROUP BY 1) AS w ON w.acc=act.acc) AS a
 JOIN (SELECT * FROM assess WHERE tier='pro') AS pro ON pro.acc=a.acc JOIN (SELECT * FROM assess WHERE tier='max-5x') AS mid5 ON mid5.acc=a.acc
 JOIN pressed ON pressed.acc=a.acc JOIN trend ON trend.acc=a.acc""", _ASSESS + _TREND + _PRESSED + _RUN)  # fmt: skip
def plan_fit_verdict(x):
    by = ["user_id"]
    summary = plan_fit.usage_summary(_usage_windows(x), _own_tiers(x.turns.sparkSession), by, "pro")
    out = plan_fit.plan_fit(summary, plan_fit.activity_span(x.turns, by, NOW), "pro", by)
    return out.select("user_id", "verdict", "suggested_tier", "monthly_delta", "trend")


@query("SELECT acc AS user_id, CAST(anchor AS VARCHAR) AS anchor, turns, round(cost,6) AS cost FROM w5", _W5)
def anchored_windows_blocks(x):
    # five-hour windows over blocks of a day: many tasks for one account
    return rounded(anchored_windows_in_blocks(x.turns, ["user_id"], FIVE_HOURS, 86400).select("user_id", "anchor", "turns", "cost"))


# the survey's names for two of them
for _name, _own in (("plan_fit", "plan_fit_verdict"), ("anchored_windows", "anchored_windows_5h")):
    QUERIES[_name], SQL[_name] = QUERIES.pop(_own), SQL.pop(_own)


@query("SELECT b.turn_id, t.content_text AS prompt_text, round(response_cost,6) AS response_cost, total_tokens, depth, tool_calls, complexity FROM (SELECT * FROM every ORDER BY depth DESC, turn_id LIMIT 1) AS b JOIN t ON t.turn_id=b.turn_id JOIN scores s2 ON s2.turn_id=b.turn_id", _SCORES)
def prompt_detail(x):
    pairs = prompts.prompt_pairs(x.turns, x.calls, x.sessions)
    chosen = pairs.orderBy(F.desc("depth"), "turn_id").limit(1)  # the prompt that a user would pick
    out = prompts.prompt_detail(x.turns, x.calls, x.sessions, prompts.complexity(pairs), chosen)
    return rounded(out.select("turn_id", "prompt_text", "response_cost", "total_tokens", "depth", "tool_calls", "complexity"))


# --- streams over the events, run to the end of what is there --------------------------------------------


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share; of this machine only for a local master."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(base or 'file:///tmp/sparklog-shared').rstrip('/')}/{name}-{uuid.uuid4().hex}"


def _streamed(name: str, make: Callable[[DataFrame, int], DataFrame], sql: str, kept: str = "true") -> None:
    """Registers a stream's whole output, or the rows of it to be kept; make gets the events and their number. Its state and result lie in the shared folder of the session."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = shared_folder(spark, name)
        path = f"{sf_dir}/events.parquet"  # as a pattern below: the stream source takes files only by patterns
        stored = spark.read.parquet(path)
        events = spark.readStream.schema(stored.schema).parquet(f"{sf_dir}/events.parque[t]").withColumn("timestamp", F.col("ts").cast("timestamp"))
        tokens = {c: F.col("event_id") * 0 + n for c, n in (("input_tokens", 1), ("output_tokens", 2))}
        out = make(events.withColumn("cost_usd", F.col("value") / 100).withColumns(tokens), stored.count())
        out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start(f"{folder}/out").awaitTermination()
        return spark.read.schema(out.schema).parquet(f"{folder}/out").filter(kept).drop("_end")

    QUERIES[name], SQL[name] = run, sql


_text = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
_streamed(
    "stream_cost",
    lambda e, _: live.stream_cost(e).select(_text("start").alias("start"), F.round("total_cost", 6).alias("total_cost"), "total_tokens", "turn_count"),
    "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, round(sum(value/100),6) AS total_cost, CAST(3*count(*) AS BIGINT) AS total_tokens, count(*) AS turn_count FROM events "
    "WHERE date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) FROM events) - INTERVAL 10 MINUTE GROUP BY 1",
)
_streamed("stream_dedup", lambda e, _: live.stream_dedup(e, "event_id").select("event_id"), "SELECT DISTINCT event_id FROM events")
_streamed(
    "stream_windows",
    # the rows as the files have them, in no order of time: a delay as long as the events
    lambda e, rows: live.stream_windows(_ended(e, "40 days"), ["user_id"], FIVE_HOURS, "30 days", buckets=max(1024, rows // 10_000)).filter("user_id >= 0").select("user_id", _text("anchor").alias("anchor"), "turns", "late_rows"),
    "WITH RECURSIVE t AS (SELECT user_id, ts AS timestamp, value/100 AS cost_usd FROM events)" + _W5 + " SELECT acc AS user_id, strftime(anchor, '%Y-%m-%d %H:%M:%S') AS anchor, turns, CAST(0 AS BIGINT) AS late_rows FROM w5",
)


def _ended(events: DataFrame, after: str) -> DataFrame:
    """The events, and one of no user long after the first: it brings the watermark past all others."""
    twice = F.explode(F.when(F.col("event_id") == 0, F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False))))
    rows = events.withColumn("_end", twice).withColumn("user_id", F.when(F.col("_end"), F.lit(-1)).otherwise(F.col("user_id")))
    return rows.withColumn("timestamp", F.when(F.col("_end"), F.col("timestamp") + F.expr("INTERVAL 1 YEAR") + F.expr(f"INTERVAL {after}")).otherwise(F.col("timestamp"))).drop("_end")


def _paired(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    rows = _ended(events.withColumn("k", k).withColumn("event_type", F.when(F.col("event_id") == 0, "click").otherwise(F.col("event_type"))), "1 day").withColumn("_end", F.col("user_id") < 0)
    calls = rows.filter("event_type IN ('click', 'purchase', 'error')").select(F.concat_ws("-", "event_id", "user_id").alias("tool_call_id"), F.col("timestamp").alias("called_at"), "_end")
    done = rows.filter("k % 7 <> 0 OR user_id < 0").select(F.concat_ws("-", "event_id", "user_id").alias("tool_call_id"), (F.col("timestamp") + F.make_dt_interval(mins=F.col("k"))).alias("done_at"), (F.col("event_type") == "error").alias("is_error"))
    return live.stream_tool_results(calls, done).select("tool_call_id", "success", "_end")


_streamed(
    "stream_tool_results",
    lambda e, _: _paired(e),
    """WITH e AS (SELECT event_id, user_id, ts, CASE WHEN event_id=0 THEN 'click' ELSE event_type END AS event_type, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k FROM events)
SELECT CAST(event_id AS VARCHAR) || '-' || CAST(user_id AS VARCHAR) AS tool_call_id, CASE WHEN k%7<>0 AND k<=30 THEN event_type<>'error' END AS success FROM e WHERE event_type IN ('click','purchase','error')""",
    "NOT _end",  # below the join it would take the row that ends the stream away
)


# --- sinks and tables ------------------------------------------------------------------------------------


@query("SELECT 'calls' AS table_name, count(*) AS n FROM c UNION ALL SELECT 'errors', (SELECT count(*) FROM c WHERE NOT success)+(SELECT count(*) FROM t WHERE stop_reason='max_tokens') UNION ALL SELECT 'sessions', count(*) FROM s UNION ALL SELECT 'skills', count(*) FROM sk UNION ALL SELECT 'turns', count(*) FROM t")
def table_stats(x):
    return merge.table_stats({"sessions": x.sessions, "turns": x.turns, "calls": x.calls, "errors": x.errors, "skills": x.skills}).select("table_name", "n")


@query("SELECT session_id, num_turns + CASE WHEN source_type='cli' THEN 1000 ELSE 0 END AS num_turns FROM s")
def sink_sessions(x):
    new = x.sessions.filter("source_type = 'cli'").withColumn("num_turns", F.col("num_turns") + 1000)
    return rounded(merge.merge_latest(x.sessions, new, "session_id").select("session_id", "num_turns"))


@query("SELECT turn_id, CASE WHEN rn=1 OR request_id IS NULL THEN request_id END AS request_id FROM (SELECT turn_id, request_id, row_number() OVER (PARTITION BY request_id ORDER BY turn_id) AS rn FROM t WHERE event_id%4<2) AS a WHERE rn=1 OR request_id IS NULL UNION ALL SELECT turn_id, request_id FROM (SELECT turn_id, request_id, row_number() OVER (PARTITION BY request_id ORDER BY turn_id) AS rn FROM t WHERE event_id%4>=2 AND (request_id IS NULL OR request_id NOT IN (SELECT request_id FROM t WHERE event_id%4<2 AND request_id IS NOT NULL))) AS b WHERE rn=1 OR request_id IS NULL")
def sink_turns(x):
    keys = ["turn_id", "request_id"]
    stored = merge.merge_absent(x.turns.limit(0), _half(x, 0), keys)
    return merge.merge_absent(stored, _half(x, 1), keys).select("turn_id", "request_id")


def _half(x, odd: int) -> DataFrame:
    """The turns with an even or odd number."""
    return x.turns.filter(F.col("turn_id").cast("long") % 4 >= 2 if odd else F.col("turn_id").cast("long") % 4 < 2)


@query("SELECT tool_call_id, success, CASE WHEN tool_name='Skill' THEN skill END AS skill_name, CAST(duration_ms AS BIGINT) AS duration_ms FROM c")
def sink_tool_calls(x):
    old = x.calls.withColumns({"success": F.lit(None).cast("boolean"), "skill_name": F.when(F.col("tool_name") == "Skill", exprs.skill_of_call())})
    new = x.calls.withColumn("skill_name", F.lit(None).cast("string"))
    return rounded(merge.merge_tool_calls(old, new).select("tool_call_id", "success", "skill_name", "duration_ms"))


# --- conversations ---------------------------------------------------------------------------------------


def conversation_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prompts.conversation_pairs(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


QUERIES["conversation_prompts"] = conversation_prompts
SQL["conversation_prompts"] = """WITH n AS (SELECT *, CAST(sum(CASE WHEN role='user' AND text IS NOT NULL THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS segment FROM conversations)
SELECT conv_id, segment, min(CASE WHEN role='user' AND text IS NOT NULL THEN turn END) AS prompt_turn, count(*) FILTER (WHERE role='assistant') AS depth,
 max(CASE WHEN role='user' THEN length(text) END) AS prompt_chars, CAST(coalesce(sum(CASE WHEN role='assistant' THEN length(text) END),0) AS BIGINT) AS response_chars FROM n WHERE segment>0 GROUP BY 1, 2"""


from sparklog import file_queries, log_queries  # noqa: E402, F401  (register their queries)
