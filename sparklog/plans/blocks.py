"""Running values inside a key, in many tasks: blocks of time, a scan over the blocks, offsets added.

A window over a key is one task, however many rows the key has. Here the rows of a key are cut into blocks of time;
each block is ordered and summed by itself, an exclusive scan over the blocks' narrow totals says what comes before
each block, and a row's running value is that of its block plus what comes before. Rows are shuffled once, by key and
block. The totals are summed before they are shuffled, in a scan of their own over the few columns they need; a key's
scan over its blocks holds a row for each.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The length of a block: rows of one key in so much time are ordered in one task.
BLOCK = "1 hour"
_BLOCK = "_block"


def in_blocks(rows: DataFrame, by: Sequence[str], ts: str = "timestamp", length: str = BLOCK) -> DataFrame:
    """rows with their block. Rows without a time are in a block of their own, before all others."""
    start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
    micros = F.timestamp_diff("MICROSECOND", start, F.col(ts).cast("timestamp_ntz"))
    each = F.timestamp_diff("MICROSECOND", start, start + F.expr(f"INTERVAL {length}"))
    block = F.coalesce(F.floor(micros / each), F.lit(-(1 << 62))).cast("long")
    return rows.withColumn(_BLOCK, block)


def before_blocks(blocked: DataFrame, by: Sequence[str], **totals: Column) -> DataFrame:
    """by..., block, and each total over the key's blocks before (0 before the first)."""
    sums = blocked.groupBy(*by, _BLOCK).agg(*[t.alias(name) for name, t in totals.items()])
    earlier = Window.partitionBy(*by).orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return sums.select(*by, _BLOCK, *[F.coalesce(F.sum(name).over(earlier), F.lit(0)).alias(name) for name in totals])


def running_sums(rows: DataFrame, by: Sequence[str], order: Sequence[str], sums: dict[str, Column], ts: str = "timestamp", length: str = BLOCK) -> DataFrame:
    """rows with the running sum of each column in sums, in the order of `order` (which begins with ts) inside `by`.

    A sum of doubles is added up block by block, so its last digits may differ from those of one long sum. Null
    values count as 0. A null key is no key: its running values begin anew in each block.
    """
    blocked = in_blocks(rows, by, ts, length)
    before = before_blocks(blocked, by, **{f"_{name}": F.sum(value) for name, value in sums.items()})
    own = Window.partitionBy(*by, _BLOCK).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    inside = blocked.withColumns({name: F.coalesce(F.sum(value).over(own), F.lit(0)) for name, value in sums.items()}).alias("r")
    same = [F.col(f"r.{c}") == F.col(f"b.{c}") for c in (*by, _BLOCK)]  # not null-safe, which would shuffle the rows again
    joined = inside.join(before.alias("b"), same, "left")
    kept = [F.col(f"r.{c}") for c in rows.columns]
    return joined.select(*kept, *[(F.col(f"r.{name}") + F.coalesce(F.col(f"b._{name}"), F.lit(0))).alias(name) for name in sums])


def with_following(rows: DataFrame, by: Sequence[str], order: Sequence[str], columns: Sequence[str], n: int, ts: str = "timestamp", length: str = BLOCK) -> DataFrame:
    """by..., and each of columns in the row itself and in the n - 1 rows after it inside `by`, as name0 to name{n-1}.

    The value is null where a key has no such row. Each block is ordered by itself; it borrows the n - 1 rows that
    follow it from the heads of later blocks, so a key with many rows is many tasks, and rows are shuffled once. Rows
    that are equal in `order` (which begins with ts) are taken in the order of columns. A null key is a key.
    """
    ranked = [c for c in dict.fromkeys((*order, *columns)) if c not in by]
    blocked = in_blocks(rows.select(*by, *ranked), by, ts, length)
    inside = Window.partitionBy(*by, _BLOCK)
    heads = blocked.withColumn("_rank", F.row_number().over(inside.orderBy(*ranked))).filter(F.col("_rank") < n)
    each = heads.groupBy(*by, _BLOCK).agg(F.array_sort(F.collect_list(F.struct("_rank", *ranked))).alias("_heads"))
    later = Window.partitionBy(*by).orderBy(_BLOCK)
    ahead = F.flatten(F.array_compact(F.array(*[F.lead("_heads", k).over(later) for k in range(1, max(n, 2))])))
    borrowed = each.select(*by, _BLOCK, F.slice(ahead, 1, n - 1).alias("_ahead")).select(*by, _BLOCK, F.posexplode("_ahead").alias("_next", "_row"))
    borrowed = borrowed.select(*by, *[F.col("_row")[c].alias(c) for c in ranked], _BLOCK, "_next")
    whole = blocked.withColumn("_next", F.lit(-1)).unionByName(borrowed)
    at = inside.orderBy("_next", *ranked)  # borrowed rows come after all of the block's own
    leads = [F.lead(c, k).over(at).alias(f"{c}{k}") for k in range(n) for c in columns]
    return whole.select(*by, "_next", *leads).filter("_next < 0").drop("_next")
