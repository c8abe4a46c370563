"""Structured Streaming forms: ingest, deduplication, live cost, late tool results, anchored windows."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from sparklog.sources import ingest, logs
from sparklog.sources.ranges import BLOCK
from sparklog.streaming import growing

_FAR = 1 << 62
#: An account of stream_windows in its state (no open window: anchor -_FAR), and a row that waits there.
_ACCOUNT = np.dtype([("anchor", "<i8"), ("turns", "<i8"), ("cost", "<f8"), ("passed", "<i8"), ("late", "<i8")])
_WAITING = np.dtype([("account", "<i8"), ("at", "<i8"), ("value", "<f8")])
_NEW = np.array((-_FAR, 0, 0.0, -_FAR, 0), _ACCOUNT)
#: Accounts travel as JSON that gives their columns back as they were.
_EXACT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS", "mode": "FAILFAST"}


def stream_ingest(spark: SparkSession, root: str, out: str, checkpoint: str, glob: str = "*.jsonl", available_now: bool = True, block_bytes: int = BLOCK):
    """Starts ingesting what is appended to the logs under root into the tables of the store under out; returns the query.

    Each line is taken once, also after a restart: the source's offsets are bytes of each file, a batch is committed
    under its number, and lines that the store's manifest knows (from a scan, say) are left out.
    """

    def commit(batch: DataFrame, number: int) -> None:
        store = ingest.log_store(batch.sparkSession, out)
        # not persisted: the first batch is all that the logs hold; their bytes are read to count lines, then to parse them
        lines = growing.numbered(batch, store.table("manifest", store.snapshot())).withColumn("file_size", F.col("line_end"))
        ingest.ingest_lines(store, logs.cli_places(lines), f"stream:{checkpoint}", number)

    writer = growing.growing_lines(spark, root, glob, block_bytes).writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")).start()


def stream_dedup(turns: DataFrame, key: str = "request_id", delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """The first row of each key inside the delay; state older than the watermark goes."""
    return turns.withWatermark(ts, delay).dropDuplicatesWithinWatermark([key])


def stream_cost(turns: DataFrame, unit: str = "1 hour", delay: str = "10 minutes", ts: str = "timestamp") -> DataFrame:
    """Cost, tokens and turns of closed time windows; rows later than the delay are left out."""
    rows = turns.withWatermark(ts, delay).groupBy(F.window(ts, unit)).agg(F.sum("cost_usd").alias("total_cost"), F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.count("*").alias("turn_count"))
    return rows.select(F.col("window.start").alias("start"), F.col("window.end").alias("end"), "total_cost", "total_tokens", "turn_count")


def stream_tool_results(calls: DataFrame, results: DataFrame, delay: str = "30 minutes") -> DataFrame:
    """Calls (tool_call_id, called_at, ...) with results (tool_call_id, done_at, is_error) up to a delay later.

    A call whose result doesn't come in time has a null success.
    """
    left = calls.withWatermark("called_at", delay).alias("c")
    right = results.withWatermark("done_at", delay).alias("r")
    near = F.expr(f"c.tool_call_id = r.tool_call_id AND r.done_at >= c.called_at AND r.done_at <= c.called_at + INTERVAL {delay}")
    return left.join(right, near, "left_outer").select("c.*", (~F.col("r.is_error")).alias("success"))


def stream_windows(turns: DataFrame, by: Sequence[str], span_seconds: int, delay: str = "10 minutes", ts: str = "timestamp", buckets: int = 1024) -> DataFrame:
    """Closed anchored windows of each account in event time: by..., anchor, turns, cost, late_rows.

    ts must be a TimestampType column. Rows may come in any order inside the delay: an account's rows wait until none
    can come before them, that is, until the watermark, or the account's own latest row less the delay, has passed
    them; then they go through the windows in the order of their time, as in the batch operator. A window closes when
    the first row after it, or a timer at its end, is passed. Rows that come too late are in no window: late_rows
    counts those that came since the account's last closed window. The state is each account's open window and the
    rows that wait: those of one delay, and of one trigger while it runs.

    Accounts are dealt by hash to so many buckets, which share a row of state and a timer: a call for each account
    would cost more than its rows. A trigger rewrites the state of the buckets that it has rows for, so buckets should
    be as many as keep that small (some 10 000 rows that wait); they can't change in a running stream's checkpoint.
    """
    by = list(by)
    fields = ", ".join(f"k{k} {turns.schema[c].dataType.simpleString()}" for k, c in enumerate(by))
    span, wait = span_seconds * 1_000_000, int(pd.Timedelta(delay) / pd.Timedelta(microseconds=1))

    def advance(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        names, kept, waiting = state.get if state.exists else ([], b"", b"")
        names, accounts, rows = list(names), np.frombuffer(kept, _ACCOUNT).copy(), np.frombuffer(waiting, _WAITING)
        came = np.empty(0, np.int64)  # accounts with new rows
        if not state.hasTimedOut:
            new = pd.concat(list(frames))
            number, found = pd.factorize(new["_k"])
            place = {name: k for k, name in enumerate(names)}
            came = np.array([place.setdefault(name, len(place)) for name in found], np.int64)
            names = list(place)
            accounts = np.concatenate([accounts, np.full(len(names) - len(accounts), _NEW)])
            each = np.empty(len(new), _WAITING)
            each["account"], each["at"], each["value"] = came[number], new["_t"].to_numpy(np.int64), new["_v"].to_numpy(np.float64)
            in_time = each["at"] > accounts["passed"][each["account"]]
            accounts["late"] += np.bincount(each["account"][~in_time], minlength=len(names))
            rows = np.concatenate([rows, each[in_time]])
        rows = rows[np.lexsort((rows["at"], rows["account"]))]
        ends = np.searchsorted(rows["account"], np.arange(len(names)), side="right")
        begins = np.concatenate([[0], ends[:-1]])
        some, mark = ends > begins, state.getCurrentWatermarkMs() * 1000
        first, last = np.full(len(names), _FAR), np.full(len(names), -_FAR)
        first[some], last[some] = rows["at"][begins[some]], rows["at"][ends[some] - 1]
        now = np.minimum(first, np.where(accounts["anchor"] > -_FAR, accounts["anchor"] + span, _FAR)) <= mark
        now[came] = True
        accounts["passed"] = np.where(now, np.maximum(np.maximum(accounts["passed"], mark), last - wait), accounts["passed"])
        ripe = rows["at"] <= accounts["passed"][rows["account"]]
        stops = begins + np.bincount(rows["account"][ripe], minlength=len(names))
        closed: list[tuple] = []
        at, value = rows["at"].tolist(), rows["value"].tolist()
        for k in np.flatnonzero(now).tolist():
            place, end = int(begins[k]), int(stops[k])
            anchor, turns_n, cost, passed, late = accounts[k].item()
            while place < end:
                if at[place] >= anchor + span:
                    if anchor > -_FAR:
                        closed.append((names[k], anchor, turns_n, cost, late))
                        late = 0
                    anchor, turns_n, cost = at[place], 0, 0.0
                stop = bisect_left(at, anchor + span, place, end)
                turns_n, cost, place = turns_n + stop - place, cost + sum(value[place:stop]), stop
            if anchor > -_FAR and passed + 1 >= anchor + span:
                closed.append((names[k], anchor, turns_n, cost, late))
                anchor, turns_n, cost, late = -_FAR, 0, 0.0, 0
            accounts[k] = (anchor, turns_n, cost, passed, late)
        rows = rows[~ripe]
        alive = accounts["anchor"] > -_FAR
        alive[rows["account"]] = True
        if not alive.any():
            state.remove()
        else:
            due = min([*rows["at"].min(keepdims=True, initial=_FAR).tolist(), *(accounts["anchor"][accounts["anchor"] > -_FAR] + span).tolist()])
            rows["account"] = (np.cumsum(alive) - 1)[rows["account"]]
            state.update(([name for name, lives in zip(names, alive.tolist()) if lives], accounts[alive].tobytes(), rows.tobytes()))
            state.setTimeoutTimestamp(max(due // 1000 + 1, state.getCurrentWatermarkMs() + 1))
        if closed:
            yield pd.DataFrame(closed, columns=["_k", "anchor", "turns", "cost", "late_rows"])

    account = F.to_json(F.struct(*[F.col(c).alias(f"k{k}") for k, c in enumerate(by)]), _EXACT)
    rows = turns.withWatermark(ts, delay).filter(F.col(ts).isNotNull())
    rows = rows.select(account.alias("_k"), F.pmod(F.xxhash64(*by), F.lit(buckets)).alias("_bucket"), ts, F.unix_micros(ts).alias("_t"), F.coalesce(F.col("cost_usd").cast("double"), F.lit(0.0)).alias("_v"))
    kept = "names array<string>, accounts binary, waiting binary"
    windows = rows.groupBy("_bucket").applyInPandasWithState(advance, "_k string, anchor long, turns long, cost double, late_rows long", kept, "append", GroupStateTimeout.EventTimeTimeout)
    windows = windows.withColumn("_k", F.from_json("_k", fields, _EXACT))
    return windows.select(*[F.col(f"_k.k{k}").alias(c) for k, c in enumerate(by)], F.timestamp_micros("anchor").alias("anchor"), "turns", "cost", "late_rows")
