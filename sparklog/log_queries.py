"""Registered queries of reading and shredding logs, each beside the SQL that must give the same rows.

The logs are the lines that sparklog.project.log_lines makes of the events; the SQL works on the events themselves.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog import project
from sparklog.functions.exprs import period
from sparklog.operators import activity, plan_fit, shred
from sparklog.queries import NOW, QUERIES, SQL, query, rounded, shared_folder
from sparklog.sources import logs, merge

_LOGS = """WITH ev AS (SELECT event_id, ts, user_id, event_type, value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INTEGER) AS k, CAST(event_id AS VARCHAR) AS turn_id,
  CAST(user_id AS VARCHAR) || '-' || CAST(CAST(date_trunc('week', ts) AS DATE) AS VARCHAR) AS session_id, event_type='view' AS prompts, event_type IN ('click','purchase','error') AS calls FROM events),
l AS (SELECT *, '/logs/-projects-p' || CAST(user_id%7 AS VARCHAR) || '/' || session_id || '.jsonl' AS file_path, row_number() OVER (PARTITION BY session_id ORDER BY ts, event_id, part) AS line_no,
  CASE WHEN part<3 THEN 'entry' WHEN part=3 THEN 'skipped' WHEN part=4 THEN 'error' ELSE 'blank' END AS status, CASE WHEN part=0 AND NOT prompts THEN 'r' || CAST(event_id//2 AS VARCHAR) END AS request_id,
  turn_id || CASE part WHEN 1 THEN '-r' WHEN 2 THEN '-l' ELSE '' END AS uuid, CASE WHEN part=2 THEN 'attachment' WHEN part=0 AND NOT prompts THEN 'assistant' ELSE 'user' END AS type
 FROM ev, (SELECT unnest(range(6)) AS part) AS p WHERE part=0 OR part=1 AND calls AND k%7<>0 OR part=2 AND prompts AND k%4=0 OR part=3 AND k%9=0 OR part=4 AND k%23=5 OR part=5 AND k%29=7),
a AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY file_path, request_id ORDER BY line_no DESC) AS rn FROM l WHERE type='assistant' AND part=0) AS q WHERE rn=1),
b AS (SELECT a.*, md5(turn_id || '-' || CAST(i AS VARCHAR)) AS tool_call_id,
  CASE WHEN k%11=0 THEN 'Skill' WHEN event_type='purchase' THEN 'mcp__shop__buy' WHEN event_type='error' THEN 'Bash' WHEN event_id%2=0 THEN 'Read' ELSE 'Edit' END AS tool_name
 FROM a, (SELECT unnest(range(2)) AS i) AS two WHERE calls AND (i=0 OR k%3=0))
"""


def on_logs(sql: str) -> Callable[[Callable[[DataFrame], DataFrame]], Callable]:
    """Registers a query on log lines under its function's name."""

    def keep(f: Callable[[DataFrame], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(project.log_lines(spark, sf_dir)))
        SQL[f.__name__] = _LOGS + sql
        return f

    return keep


def _messages(lines: DataFrame, policy: str = "last") -> DataFrame:
    return logs.deduplicated(logs.normalise_cli(logs.parse_records(lines)[0]), policy)


@on_logs("SELECT file_path, line_no, status, request_id FROM l")
def parse_records(lines):
    return logs.parse_records(lines)[1].select("file_path", "line_no", "status", "request_id")


@on_logs("""SELECT file_path, count(*) AS lines, count(*) FILTER (WHERE status='entry') AS entries, count(*) FILTER (WHERE status='error') AS errors, count(*) FILTER (WHERE status='skipped') AS skipped,
 count(*) FILTER (WHERE status='blank') AS blank, count(request_id)-count(DISTINCT request_id) AS duplicates FROM l GROUP BY 1""")
def ingest_metrics(lines):
    return logs.ingest_metrics(logs.parse_records(lines)[1]).drop("bytes")


@on_logs("SELECT file_path, line_no, session_id, type, uuid, request_id, CAST(ts AS VARCHAR) AS timestamp, CASE WHEN type='assistant' THEN CAST(floor(value*10) AS BIGINT) ELSE 0 END AS input_tokens FROM l WHERE status='entry'")
def normalise_cli(lines):
    return logs.normalise_cli(logs.parse_records(lines)[0]).select("file_path", "line_no", "session_id", "type", "uuid", "request_id", "timestamp", "input_tokens")


@on_logs("SELECT line_no, session_id, type, request_id FROM l WHERE status='entry'")
def normalise_audit(lines):
    # the same records under the names of the desktop dialect
    renamed = lines.withColumn("line", F.regexp_replace(F.regexp_replace("line", '"sessionId":', '"session_id":'), '"timestamp":', '"_audit_timestamp":'))
    return logs.normalise_audit(logs.parse_records(renamed)[0]).select("line_no", "session_id", "type", "request_id")


@on_logs("SELECT uuid FROM l WHERE status='entry'")
def dedup_none(lines):
    return _messages(lines, "none").select("uuid")


@on_logs("""SELECT uuid AS turn_id, CASE WHEN type='user' AND part=0 AND k%10<>0 THEN 'prompt ' || turn_id WHEN type='assistant' THEN nullif(concat_ws(chr(10), CASE WHEN k%6<>0 THEN 'answer ' || turn_id END, CASE WHEN k%12=1 THEN 'and more' END), '') END AS text
 FROM l WHERE part IN (0, 1)""")
def content_text(lines):
    rows = _messages(lines, "none").filter("type <> 'attachment'")
    return rows.select(F.col("uuid").alias("turn_id"), shred.content_text(F.col("blocks")).alias("text"))


@on_logs("SELECT uuid AS turn_id, session_id, CAST(ts AS VARCHAR) AS timestamp, CASE WHEN part=0 AND k%10<>0 THEN 'prompt ' || turn_id END AS content_text FROM l WHERE status='entry' AND type='user'")
def user_turns(lines):
    return shred.user_turns(_messages(lines)).select("turn_id", "session_id", "timestamp", "content_text")


@on_logs("SELECT turn_id, session_id, request_id, calls AS has_tool_use, k%4=0 AS has_thinking, CASE WHEN k%25=3 THEN 'max_tokens' ELSE 'end_turn' END AS stop_reason, round((floor(value*10)*5+k*7*25+event_id%13*1000*6.25+event_id%17*15000*0.5)/1000000,6) AS cost_usd FROM a")
def assistant_turns(lines):
    return shred.assistant_turns(_messages(lines)).select("turn_id", "session_id", "request_id", "has_tool_use", "has_thinking", "stop_reason", "cost_usd")


@on_logs("SELECT tool_call_id, session_id, turn_id, tool_name, CASE WHEN tool_name LIKE 'mcp%' THEN 'mcp' ELSE 'builtin' END AS tool_type, CASE WHEN tool_name LIKE 'mcp%' THEN 'shop' END AS mcp_server FROM b")
def explode_tool_calls(lines):
    return shred.explode_tool_calls(_messages(lines)).select("tool_call_id", "session_id", "turn_id", "tool_name", "tool_type", "mcp_server")


@on_logs("SELECT tool_call_id, CASE WHEN k%11=0 THEN 'skill-' || CAST(k%10 AS VARCHAR) END AS skill_name, CASE WHEN k%11=0 THEN 'user' END AS skill_caller_type FROM b")
def skill_invocation_cols(lines):
    return shred.explode_tool_calls(_messages(lines)).select("tool_call_id", "skill_name", "skill_caller_type")


@on_logs("SELECT md5(turn_id || '-' || CAST(i AS VARCHAR)) || '-toolerr' AS error_id, session_id, 'tool_error' AS error_type, 'error ' || CAST(k%6 AS VARCHAR) AS message FROM l, (SELECT unnest(range(2)) AS i) AS two WHERE part=1 AND event_type='error' AND (i=0 OR k%3=0) UNION ALL SELECT turn_id || '-stop', session_id, 'max_tokens_truncation', 'stop_reason: max_tokens' FROM a WHERE k%25=3")
def sink_errors(lines):
    return logs.shred_messages(_messages(lines))["errors"].select("error_id", "session_id", "error_type", "message")


@on_logs("SELECT session_id, '/projects/p' || CAST(min(user_id)%7 AS VARCHAR) AS project_path, 'p' || CAST(min(user_id)%7 AS VARCHAR) AS project_name FROM l WHERE status='entry' GROUP BY 1")
def project_identity(lines):
    return shred.project_cols(shred.session_context(_messages(lines))).select("session_id", "project_path", "project_name")


@on_logs("SELECT uuid, 'skill-' || CAST(k%10 AS VARCHAR) AS skill_name, repeat('x', k+1) || ' and more' AS skill_description, CAST(0 AS BIGINT) AS position FROM l WHERE part=2")
def skill_listing_rows(lines):
    return shred.skill_listing(logs.listings(_messages(lines))).select("uuid", "skill_name", "skill_description", "position")


@on_logs("SELECT session_id || ':' || uuid || ':skill-' || CAST(k%10 AS VARCHAR) AS session_skill_id, session_id, CAST(CASE WHEN k%8=0 THEN 2 ELSE 1 END AS BIGINT) AS skill_count, CAST(ts AS VARCHAR) AS captured_at FROM l WHERE part=2")
def session_skill_rows(lines):
    return shred.session_skills(logs.listings(_messages(lines))).select("session_skill_id", "session_id", "skill_count", "captured_at")


@on_logs("SELECT session_id || ':' || uuid || ':skill-' || CAST(k%10 AS VARCHAR) AS session_skill_id, uuid AS record_uuid, 'skill-' || CAST(k%10 AS VARCHAR) AS skill_name, repeat('x', k+1) || ' and more' AS skill_description, true AS is_initial, 'cli' AS source FROM l WHERE part=2")
def sink_session_skills(lines):
    # every third row first, then all of them: known rows stay as they are
    spark = lines.sparkSession
    path = shared_folder(spark, "sink_session_skills")
    logs.shred_messages(_messages(lines))["skills"].write.parquet(path)  # the batch is staged: the merges read it several times
    rows = spark.read.parquet(path)
    third = F.pmod(F.xxhash64("session_skill_id"), F.lit(3)) == 0
    kept = merge.merge_absent(rows.limit(0), rows.filter(third), ["session_skill_id"])
    out = merge.merge_absent(kept, rows.withColumn("source", F.when(third, "again").otherwise(F.col("source"))), ["session_skill_id"])
    return out.select("session_skill_id", "record_uuid", "skill_name", "skill_description", "is_initial", "source")


@on_logs("SELECT session_id, uuid, CAST(2 AS BIGINT) AS skill_count, CAST(1 AS BIGINT) AS parsed FROM l WHERE part=2 AND k%8=0")
def listing_count_check(lines):
    return shred.listing_mismatches(logs.listings(_messages(lines))).select("session_id", "uuid", "skill_count", "parsed")


@on_logs("SELECT tool_call_id, CASE WHEN k%11=0 THEN 'skill-' || CAST(k%10 AS VARCHAR) END AS skill_name FROM b")
def rebuild_skills(lines):
    tables = logs.shred_messages(_messages(lines))
    bare = tables["calls"].withColumn("skill_name", F.lit(None).cast("string"))
    return shred.rebuild_skills(bare, tables["skills"].limit(0), tables["calls"], tables["skills"])[0].select("tool_call_id", "skill_name")


@on_logs("SELECT source, count(*) AS n FROM (SELECT 'cli' AS source FROM a UNION ALL SELECT 'cli' FROM l WHERE status='entry' AND type<>'assistant' UNION ALL SELECT 'desktop' FROM l WHERE status='entry') AS q GROUP BY 1")
def multi_source_union(lines):
    both = _messages(lines).unionByName(_messages(lines.withColumn("source_type", F.lit("desktop")), "none"))
    return both.groupBy(F.col("source_type").alias("source")).agg(F.count("*").alias("n"))


# --- periods and ceilings --------------------------------------------------------------------------------


@query("SELECT turn_id FROM t WHERE timestamp >= TIMESTAMP '2024-01-24 00:00:00' AND timestamp < TIMESTAMP '2024-01-31 00:00:00'")
def period_filter(x):
    return x.turns.filter(period("7d", NOW).holds("timestamp")).select("turn_id")


@query("SELECT CAST(coalesce(sum(n), 0) AS BIGINT) AS turns FROM (SELECT CAST(timestamp AS DATE) AS date, count(*) AS n FROM t GROUP BY 1) AS d WHERE date=DATE '2024-01-20'")
def turns_today(x):
    daily = x.turns.groupBy(F.to_date("timestamp").alias("date")).agg(F.count("*").alias("turns"))
    return activity.turns_today(daily, NOW.replace(day=20, hour=12))


_LIMITS = "SELECT * FROM (VALUES ('pro', 5.0, 125.0), ('max-5x', 25.0, 625.0), ('max-20x', 100.0, 2500.0)) AS v(tier, f, w)"
_COSTS = "SELECT round(max(cost_usd), 6) AS top, round(sum(cost_usd), 6) AS total FROM t"


def _overrides(x) -> DataFrame:
    """A five-hour ceiling for `pro` from the dearest turn; no valid weekly one for `max-5x`."""
    top = x.turns.agg(F.round(F.max("cost_usd"), 6).alias("five_hour"))
    pro = top.select(F.lit("pro").alias("tier"), "five_hour", F.lit(None).cast("double").alias("weekly"))
    return pro.unionByName(top.select(F.lit("max-5x").alias("tier"), F.lit(float("nan")).alias("five_hour"), F.lit(-1.0).alias("weekly")))


@query(f"SELECT tier, CAST(CASE WHEN tier='pro' THEN top ELSE f END AS DOUBLE) AS five_hour, CAST(w AS DOUBLE) AS weekly FROM ({_LIMITS}) AS v, ({_COSTS}) AS m")
def resolve_ceilings(x):
    return plan_fit.tier_table(x.turns.sparkSession, _overrides(x)).select("tier", "five_hour", "weekly")


@query(f"SELECT tier, CAST(greatest(f, 10*top) AS DOUBLE) AS five_hour, 10*top>f AS five_hour_calibrated, CAST(greatest(w, total) AS DOUBLE) AS weekly, total>w AS weekly_calibrated FROM ({_LIMITS}) AS v, ({_COSTS}) AS m")
def calibrate_ceilings(x):
    peaks = x.turns.agg((10 * F.round(F.max("cost_usd"), 6)).alias("p5"), F.round(F.sum("cost_usd"), 6).alias("p7"))
    tiers = plan_fit.tier_table(x.turns.sparkSession).crossJoin(F.broadcast(peaks))  # one row
    return plan_fit.calibrate(tiers, F.col("p5"), F.col("p7"))
