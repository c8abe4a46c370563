"""Reading session logs: scans of both dialects after a manifest, parsing, normalising, shredding."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparklog.operators import shred
from sparklog.schemas import TABLES
from sparklog.sources import ranges

# The record types that are kept.
RECORD_TYPES = ("user", "assistant", "attachment", "file-history-snapshot", "queue-operation")
_USAGE = "struct<input_tokens:long,output_tokens:long,cache_creation_input_tokens:long,cache_read_input_tokens:long>"
_RECORD = (
    "type string, sessionId string, session_id string, timestamp string, _audit_timestamp string, uuid string, parentUuid string, requestId string, version string, "
    f"gitBranch string, cwd string, model string, costUSD double, usage {_USAGE}, "
    f"message struct<id:string,role:string,model:string,stop_reason:string,usage:{_USAGE},content:string>, "
    "attachment struct<type:string,content:string,skillCount:int,isInitial:boolean>, _corrupt string"
)


def scan_cli_logs(
    spark: SparkSession, root: str, since: str | None = None, limit: int | None = None, manifest: DataFrame | None = None, block_bytes: int = ranges.BLOCK, glob: str = "*.jsonl",
    chosen: Column | None = None,
) -> DataFrame:
    """Lines of <root>/<project>/*.jsonl with file, session id and sub-agent flag: of the newest `limit` files (of those `chosen` by file_path, say), after what the manifest knows.

    Files are chosen from their names, sizes and times; of those only the ranges that aren't known are read.
    """
    files = ranges.log_files(spark, root, glob, since).filter(F.element_at(F.split("file_path", "/"), -1) != "audit.jsonl")
    if chosen is not None:
        files = files.filter(chosen)
    if limit is not None:
        files = files.orderBy(F.desc("file_time"), "file_path").limit(limit)
    return cli_places(ranges.read_lines(ranges.pending(files, manifest), block_bytes))


def cli_places(rows: DataFrame) -> DataFrame:
    """Lines with what their file's path says: session, sub-agent or not, project folder, dialect."""
    name = F.regexp_replace(F.element_at(F.split("file_path", "/"), -1), r"\.[^.]*$", "")
    folder = F.element_at(F.split("file_path", "/"), -2)
    return rows.withColumns({"file_session": name, "is_sub_agent": name.startswith("agent-"), "project_dir": folder, "source_type": F.lit("cli")})


def scan_audit_logs(spark: SparkSession, roots: Sequence[str], since: str | None = None, manifest: DataFrame | None = None, block_bytes: int = ranges.BLOCK) -> DataFrame:
    """Lines of **/audit.jsonl after what the manifest knows; files below the folder of another audit file are left out."""
    files = ranges.log_files(spark, roots, "audit.jsonl", since)
    folder = F.regexp_replace("file_path", r"/audit\.jsonl$", "")
    dirs = files.select(folder.alias("_dir"))
    above = dirs.withColumn("_up", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(F.split("_dir", "/")) - 1, F.lit(1))), lambda n: F.array_join(F.slice(F.split("_dir", "/"), F.lit(1), n), "/"))))
    nested = above.join(dirs.withColumnRenamed("_dir", "_up"), "_up", "left_semi").select("_dir").distinct()
    files = files.withColumn("_dir", folder).join(nested, "_dir", "left_anti").drop("_dir")
    name = F.element_at(F.split("file_path", "/"), -2)
    return ranges.read_lines(ranges.pending(files, manifest), block_bytes).withColumns({"file_session": name, "is_sub_agent": F.lit(False), "project_dir": name, "source_type": F.lit("desktop")})


def parse_records(lines: DataFrame, keep: Callable[[DataFrame], DataFrame] = lambda rows: rows) -> tuple[DataFrame, DataFrame]:
    """(records of the kept types, status of every line): blank and unknown are skipped, bad JSON or no type is an error.

    Both start from keep(parsed lines), without their text: who needs both may store that, so that lines are read and
    parsed once.
    """
    record = F.from_json("line", _RECORD, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt"})
    # a generator's columns: filters on them stay above it, where pushed into it each would make and parse the line again
    fields = {f.name: f"_r_{f.name}" for f in T.StructType.fromDDL(_RECORD)}
    parsed = lines.select("*", F.inline(F.array(record)).alias(*fields.values()))
    kind, request = F.col(fields["type"]), F.col(fields["requestId"])
    status = F.when(F.trim("line") == "", "blank").when(F.col(fields["_corrupt"]).isNotNull() | kind.isNull(), "error").when(kind.isin(*RECORD_TYPES), "entry").otherwise("skipped")
    parsed = keep(parsed.withColumns({"status": status, "bytes": F.octet_length("line")}).drop("line", fields["_corrupt"]))
    kept = parsed.filter("status = 'entry'").select(*[c for c in lines.columns if c != "line"], *[F.col(own).alias(name) for name, own in fields.items() if name != "_corrupt"])
    places = [c for c in ("line_end", "ended") if c in lines.columns]
    return kept, parsed.select("file_path", "file_size", "line_no", "status", "bytes", request.alias("request_id"), *places)


def ingest_metrics(line_status: DataFrame) -> DataFrame:
    """Per file: lines, entries, errors, skipped and blank lines, duplicate requests, bytes."""
    count = lambda s: F.count_if(F.col("status") == s)
    repeated = F.count_if((F.col("status") == "entry") & (F.col("request_id") != "")) - F.countDistinct(F.when(F.col("status") == "entry", F.nullif("request_id", F.lit(""))))
    return line_status.groupBy("file_path").agg(
        F.count("*").alias("lines"), count("entry").alias("entries"), count("error").alias("errors"), count("skipped").alias("skipped"), count("blank").alias("blank"), repeated.alias("duplicates"), F.sum("bytes").alias("bytes")
    )


def manifest_of(line_status: DataFrame, manifest: DataFrame | None = None) -> DataFrame:
    """The manifest after these lines: how many bytes and lines of each file are read.

    A broken line without a line feed, at a file's end, isn't counted: it may not be written to its end yet.
    """
    read = F.coalesce((F.col("status") != "error") | F.col("ended"), F.lit(False))
    new = line_status.filter(read).groupBy("file_path").agg(F.max("line_end").alias("last_byte_offset"), F.max("line_no").alias("last_line_number"))
    new = new.withColumn("last_ingested_at", F.current_timestamp())
    if manifest is None:
        return new
    return manifest.join(new.select("file_path"), "file_path", "left_anti").unionByName(new)


def furthest(line_status: DataFrame) -> DataFrame:
    """What a manifest needs of these lines: the last of each status in each file."""
    return line_status.groupBy("file_path", "status", "ended").agg(F.max("line_end").alias("line_end"), F.max("line_no").alias("line_no"))


def with_session_metadata(lines: DataFrame, spark: SparkSession, roots: Sequence[str]) -> DataFrame:
    """Adds title, first selected folder and cwd of side-car <session>.json files: beside the folder, else inside it."""
    schema = "title string, cwd string, model string, userSelectedFolders array<string>"
    meta = spark.read.schema(schema).option("multiLine", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").json(list(roots))
    meta = meta.select("*", F.col("_metadata.file_path").alias("_path")).select(
        F.regexp_replace("_path", r"/[^/]+$", "").alias("_folder"), F.regexp_extract("_path", r"([^/]+)\.json$", 1).alias("_name"), "title", F.get("userSelectedFolders", F.lit(0)).alias("folder"), F.col("cwd").alias("meta_cwd")
    )
    values = ("title", "folder", "meta_cwd")
    pack = F.struct(*values)
    parent = meta.groupBy("_folder", "_name").agg(F.first(pack).alias("_parent"))
    own = meta.groupBy("_folder").agg(F.min_by(pack, "_name").alias("_own"))
    rows = lines.withColumns({"_dir": F.regexp_replace("file_path", r"/[^/]+$", "")}).withColumn("_up", F.regexp_replace("_dir", r"/[^/]+$", ""))
    rows = rows.join(parent, (rows["_up"] == parent["_folder"]) & (rows["file_session"] == parent["_name"]), "left").drop("_folder", "_name")
    rows = rows.join(own.withColumnRenamed("_folder", "_own_folder"), F.col("_dir") == F.col("_own_folder"), "left")
    return rows.withColumns({c: F.coalesce(F.col("_parent")[c], F.col("_own")[c]) for c in values}).drop("_parent", "_own", "_own_folder", "_dir", "_up")


def _normalised(records: DataFrame, session, timestamp, request, cwd) -> DataFrame:
    usage = F.coalesce("message.usage", "usage")
    tokens = {"input": "input_tokens", "output": "output_tokens", "cache_creation": "cache_creation_input_tokens", "cache_read": "cache_read_input_tokens"}
    for c in ("title", "folder"):
        if c not in records.columns:
            records = records.withColumn(c, F.lit(None).cast("string"))
    return records.select(
        "file_path", "line_no", "project_dir", "source_type", "title", "folder", "type", session.alias("session_id"),
        F.to_timestamp_ntz(F.regexp_replace(timestamp, "Z$", "")).alias("timestamp"), F.col("uuid"), F.col("parentUuid").alias("parent_uuid"), request.alias("request_id"),
        F.coalesce("model", "message.model").alias("model"), F.col("message.stop_reason").alias("stop_reason"), F.col("costUSD").alias("logged_cost_usd"),
        *[F.coalesce(usage[n], F.lit(0)).alias(f"{c}_tokens") for c, n in tokens.items()], shred.blocks(F.col("message.content")).alias("blocks"),
        cwd.alias("cwd"), F.col("gitBranch").alias("git_branch"), "version", "attachment",
    )


def normalise_cli(records: DataFrame) -> DataFrame:
    """Parsed lines of the command-line dialect in the common shape."""
    return _normalised(records, F.coalesce("sessionId", "file_session"), F.col("timestamp"), F.col("requestId"), F.col("cwd"))


def normalise_audit(records: DataFrame) -> DataFrame:
    """Parsed lines of the desktop dialect: own names of session, time and request; cwd from the side-car."""
    cwd = F.coalesce("cwd", "meta_cwd") if "meta_cwd" in records.columns else F.col("cwd")
    return _normalised(records, F.coalesce("session_id", "file_session"), F.coalesce("_audit_timestamp", "timestamp"), F.coalesce("message.id", "requestId"), cwd)


def deduplicated(messages: DataFrame, policy: str = "last") -> DataFrame:
    """Assistant records with one request once per file (last), or all of them (none, the desktop dialect)."""
    if policy == "none":
        return messages
    # the type, one here, is a key too: so a filter on it passes the window, and a side that it leaves empty isn't read
    answers = shred.dedup_last(messages.filter("type = 'assistant'"), "request_id", ["line_no"], ["file_path", "type"])
    return answers.unionByName(messages.filter("type <> 'assistant'"))


def listings(messages: DataFrame) -> DataFrame:
    """Skill listings among the attachments."""
    rows = messages.filter((F.col("type") == "attachment") & (F.col("attachment.type") == "skill_listing"))
    return rows.select("session_id", "uuid", "timestamp", F.col("attachment.content").alias("listing"), F.col("attachment.skillCount").alias("skill_count"), F.col("attachment.isInitial").alias("is_initial"), F.col("source_type").alias("source"))


def shred_messages(messages: DataFrame) -> dict[str, DataFrame]:
    """The five tables of normalised, deduplicated messages."""
    turns = shred.user_turns(messages).unionByName(shred.assistant_turns(messages))
    return tables_of(messages, turns, shred.explode_tool_calls(messages), shred.tool_results(messages))


def tables_of(messages: DataFrame, turns: DataFrame, timed: DataFrame, results: DataFrame) -> dict[str, DataFrame]:
    """The five tables of messages, given their turns, their calls with times, and results: each table reads some of these."""
    calls = shred.join_tool_results(timed, results)
    context = shred.project_cols(shred.session_context(messages)).withColumnsRenamed({"version": "claude_version", "file_path": "source_file"})
    sessions = shred.session_rollup(turns, calls).join(context, "session_id", "left")
    errors = shred.tool_errors(timed, results).unionByName(shred.stop_errors(turns)).dropDuplicates(["error_id"])
    out = {"sessions": sessions, "turns": turns, "calls": calls, "errors": errors, "skills": shred.session_skills(listings(messages))}
    return {name: df.select(*[F.col(f.name).cast(f.dataType) for f in TABLES[name]]) for name, df in out.items()}


def load_sources(spark: SparkSession, cli_root: str | None = None, audit_roots: Sequence[str] = (), manifest: DataFrame | None = None) -> DataFrame:
    """Normalised messages of the chosen dialects, each deduplicated by its own policy; with a manifest, of new lines."""
    parts = []
    if cli_root:
        parts.append(deduplicated(normalise_cli(parse_records(scan_cli_logs(spark, cli_root, manifest=manifest))[0])))
    if audit_roots:
        lines = with_session_metadata(scan_audit_logs(spark, audit_roots, manifest=manifest), spark, audit_roots)
        parts.append(deduplicated(normalise_audit(parse_records(lines)[0]), "none"))
    if not parts:
        raise ValueError("no source was given")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p, allowMissingColumns=True)
    return out
