"""Anchored usage windows: the first row opens [t, t + span), the first row at or after its end opens the next."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

FIVE_HOURS, WEEK = 5 * 3600, 7 * 86400
_MAPS = 1000  # blocks whose maps leave a task together


def micros(column: str) -> Column:
    """Microseconds of a timestamp_ntz since 1970, whatever the session's zone."""
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"), F.col(column))


def at_micros(column: Column) -> Column:
    return F.timestamp_add("MICROSECOND", column, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def anchored_windows(rows: DataFrame, by: Sequence[str], span_seconds: int | dict[str, int], ts: str = "timestamp", value: str = "cost_usd") -> DataFrame:
    """by..., anchor, turns, cost: one row per window of each account. Several named spans: their name in column span.

    Where a window opens depends on the one before it, so each account's rows are sorted by time in one partition
    and streamed, once for all spans; besides the sort, which spills, a task holds a batch and the open windows,
    however dense or long an account is. Rows without a time are left out; a null value counts as 0; rows of one
    time are in one window.
    """
    named = isinstance(span_seconds, dict)
    spans = [(name, seconds * 1_000_000) for name, seconds in (span_seconds.items() if named else [("", span_seconds)])]
    by = list(by)
    base = rows.select(*by, micros(ts).alias("_t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")).filter("_t IS NOT NULL")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_: list[tuple | None] = [None] * len(spans)  # of each span: the account's key, anchor, turns, cost
        for batch in batches:
            closed: list[tuple] = []
            keys = [batch.column(c) for c in by]
            at, costs = batch.column("_t").to_numpy(), batch.column("_v").to_numpy()
            for begin, end in _runs(keys, batch.num_rows):
                own = tuple(column[begin].as_py() for column in keys)
                for k, (name, span) in enumerate(spans):
                    place, now = begin, open_[k]
                    while place < end:
                        if now is None or now[0] != own or at[place] >= now[1] + span:
                            if now is not None:
                                closed.append((*now[0], name, *now[1:]))
                            now = (own, int(at[place]), 0, 0.0)
                        stop = begin + int(np.searchsorted(at[begin:end], now[1] + span))
                        now, place = (own, now[1], now[2] + stop - place, now[3] + float(costs[place:stop].sum())), stop
                    open_[k] = now
            yield _table(closed)
        yield _table([(*now[0], name, *now[1:]) for now, (name, _) in zip(open_, spans) if now is not None])

    schema = T.StructType(
        [*[T.StructField(c, base.schema[c].dataType) for c in by], T.StructField("span", T.StringType()), T.StructField("anchor", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("cost", T.DoubleType())]
    )
    kinds = to_arrow_schema(schema)

    def _table(windows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*windows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    out = base.repartition(*by).sortWithinPartitions(*by, "_t").mapInArrow(stream, schema)
    out = out.withColumn("anchor", at_micros(F.col("anchor")))
    return out if named else out.drop("span")


def exits_of(times: np.ndarray, begin: int, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Of a block's sorted times: (entries, exits). A chain of windows that first opens at an entry, the first row not
    before the end of the window that is open as the block begins, leaves the block with its last window ending at the exit.

    Only rows within one span of the block's begin can be entries, and the row after those. Neighbouring entries with
    one exit are one.
    """
    exits = times + span
    following = np.searchsorted(times, exits)
    for i in np.flatnonzero(following < len(times))[::-1].tolist():
        exits[i] = exits[following[i]]
    first = min(len(times), int(np.searchsorted(times, begin + span)) + 1)
    entries, exits = times[:first], exits[:first]
    last = np.append(exits[1:] != exits[:-1], True) if first else np.empty(0, bool)  # the last of those with one exit stands for them
    return entries[last], exits[last]


def anchored_windows_in_blocks(
    rows: DataFrame, by: Sequence[str], span_seconds: int, block_seconds: int = WEEK, ts: str = "timestamp", value: str = "cost_usd"
) -> DataFrame:
    """anchored_windows with an account's rows in many tasks, one for each block of time, where accounts are giant.

    Each block tells, for every row that may open its first window, when the chain of windows from there leaves it
    (`exits_of`: jump pointers, followed from the block's end). Those narrow maps are composed in the order of an
    account's blocks, which gives the end of the window that is open as each block begins; with it blocks are
    streamed by themselves, and the parts of windows that lie in several blocks are added up. Rows are shuffled
    twice; a task holds the times of one block. Costs are added block by block, so their last digits may differ.
    """
    span, length, by = span_seconds * 1_000_000, block_seconds * 1_000_000, list(by)
    base = rows.select(*by, micros(ts).alias("_t"), F.coalesce(F.col(value).cast("double"), F.lit(0.0)).alias("_v")).filter("_t IS NOT NULL")
    base = base.withColumn("_block", F.floor(F.col("_t") / length).cast("long"))
    keys = T.StructType([T.StructField(c, base.schema[c].dataType) for c in by])
    longs, block = T.ArrayType(T.LongType()), T.StructField("_block", T.LongType())
    map_schema = T.StructType([*keys, block, T.StructField("entries", longs), T.StructField("exits", longs)])
    map_kinds = to_arrow_schema(map_schema)

    def whole(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, int, list[np.ndarray]]]:
        """(a batch, a row of it, the times' parts) of each block."""
        last, parts = None, []
        for batch in batches:
            columns, at = [batch.column(c) for c in keys], batch.column("_t").to_numpy()
            for k, (begin, end) in enumerate(_runs(columns, batch.num_rows)):
                # only the first run of a batch may go on with the block before
                if last is not None and (k or tuple(c[begin].as_py() for c in columns) != tuple(last[0].column(c)[last[1]].as_py() for c in keys)):
                    yield *last, parts
                    parts = []
                last = batch, begin
                parts.append(at[begin:end].copy())
        if last is not None:
            yield *last, parts

    def ways(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[tuple] = []
        rows = 0  # entries and exits in found
        for batch, row, parts in whole(batches, [*by, "_block"]):
            own = tuple(batch.column(c)[row].as_py() for c in (*by, "_block"))
            entries, exits = exits_of(parts[0] if len(parts) == 1 else np.concatenate(parts), own[-1] * length, span)
            found.append((*own, entries, exits))
            rows += len(entries)
            if len(found) >= _MAPS or rows >= 100 * _MAPS:  # a batch for many blocks, as most are small
                yield _maps(found)
                found, rows = [], 0
        yield _maps(found)

    def _maps(found: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*found)) or [()] * len(map_kinds)
        return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, map_kinds)], schema=map_kinds)

    def composed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, end = None, None
        for batch in batches:
            columns, found = [batch.column(c) for c in by], []
            for k in range(batch.num_rows):
                key = tuple(c[k].as_py() for c in columns)
                if key != own:
                    own, end = key, None
                found.append(end)
                entries, exits = (batch.column(c)[k].values.to_numpy() for c in ("entries", "exits"))
                at = 0 if end is None else int(np.searchsorted(entries, end))
                if at < len(entries):  # else all of the block lies in the window that is open
                    end = int(exits[at])
            yield pa.RecordBatch.from_arrays([*columns, batch.column("_block"), pa.array(found, pa.int64())], [*by, "_block", "_end"])

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, anchor, turns, cost = None, None, 0, 0.0
        for batch in batches:
            closed = []
            names = [*by, "_block"]
            columns = [batch.column(c) for c in names]
            at, costs, ends = batch.column("_t").to_numpy(), batch.column("_v").to_numpy(), batch.column("_end")
            for begin, end in _runs(columns, batch.num_rows):
                key, place = tuple(c[begin].as_py() for c in columns), begin
                if key != own:
                    if turns:
                        closed.append((*own[:-1], anchor, turns, cost))
                    own, anchor, turns, cost = key, None, 0, 0.0
                    entry = ends[begin].as_py()  # the marker comes first
                    anchor, place = (None if entry is None else entry - span), begin + 1
                while place < end:
                    if anchor is None or at[place] >= anchor + span:
                        if turns:
                            closed.append((*own[:-1], anchor, turns, cost))
                        anchor, turns, cost = int(at[place]), 0, 0.0
                    stop = begin + int(np.searchsorted(at[begin:end], anchor + span))
                    turns, cost, place = turns + stop - place, cost + float(costs[place:stop].sum()), stop
            yield _table(closed)
        yield _table([(*own[:-1], anchor, turns, cost)] if turns else [])

    schema = T.StructType([*keys, T.StructField("anchor", T.LongType()), T.StructField("turns", T.LongType()), T.StructField("cost", T.DoubleType())])
    kinds = to_arrow_schema(schema)

    def _table(windows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*windows)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, kinds)], schema=kinds)

    maps = base.select(*by, "_block", "_t").repartition(*by, "_block").sortWithinPartitions(*by, "_block", "_t")
    maps = maps.mapInArrow(ways, map_schema)
    entry = maps.repartition(*by).sortWithinPartitions(*by, "_block").mapInArrow(composed, T.StructType([*keys, block, T.StructField("_end", T.LongType())]))
    # a marker row before each block's rows says when the window that is open there ends
    marked = base.withColumn("_end", F.lit(None).cast("long")).unionByName(entry.withColumns({"_t": F.lit(-(1 << 62)).cast("long"), "_v": F.lit(0.0)}))
    parts = marked.repartition(*by, "_block").sortWithinPartitions(*by, "_block", "_t").mapInArrow(stream, schema)
    return parts.groupBy(*by, "anchor").agg(F.sum("turns").alias("turns"), F.sum("cost").alias("cost")).withColumn("anchor", at_micros(F.col("anchor")))


def _runs(keys: list[pa.Array], n: int) -> list[tuple[int, int]]:
    """Begin and end of each run of rows with the same keys."""
    new = np.zeros(n, bool)
    new[:1] = True
    for column in keys:
        codes = column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)
        new[1:] |= codes[1:] != codes[:-1]
    begins = np.flatnonzero(new).tolist()
    return list(zip(begins, [*begins[1:], n]))
