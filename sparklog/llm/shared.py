"""What several corpus operators need: shared storage, column guards, word hashing, components."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import uuid
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of the word-based contracts: space and the ASCII controls from tab to carriage return.
WORD_SPACE = re.compile("[\x20\x09-\x0d]+")
#: What str.split() would also split at.
_OTHER_SPACE = re.compile("[\x1c-\x1f\x85\xa0  -     　]")


def words_of(text: str) -> list[str]:
    """Maximal runs of `[^\\x20\\x09-\\x0D]`."""
    if _OTHER_SPACE.search(text):
        return [w for w in WORD_SPACE.split(text) if w]
    return text.split()


class HashCache(dict):
    """word -> 64-bit hash; emptied when full, so that its memory is bounded."""

    LIMIT = 400_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        value = self[word] = self.hash(word.encode("utf-8", "surrogatepass"))
        return value

    @staticmethod
    def hash(word: bytes) -> int:
        return xxhash.xxh3_64_intdigest(word)

    def of(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


WORD_HASHES = HashCache()

#: What empties the memos that a worker process keeps from task to task.
MEMOS: list[Callable[[], None]] = [WORD_HASHES.clear]
_stage: int | None = None


def begin_task() -> None:
    """Called by tasks before they use a memo; memos last for a stage.

    Worker processes outlive their stages: in the first task of another one, the memos of the last are emptied and
    what they took is given back, so that an executor holds what one stage needs, however many ran before.
    """
    global _stage
    context = TaskContext.get()
    now = context.stageId() if context else None
    if now == _stage:
        return
    _stage = now
    for clear in MEMOS:
        clear()
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # where the C library has it
        ctypes.CDLL(None).malloc_trim(0)

_ODD = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """odd**0..odd**n and its inverse powers, modulo 2**64."""
    if len(_POWERS[0]) <= n:
        for k, base in enumerate((_ODD, _INVERSE)):
            steps = np.full(max(n + 1, 1 << 16), base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit (the splitmix64 finalizer)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class RangeHash:
    """Hashes of any word ranges of one array of word hashes, each from two prefix sums."""

    def __init__(self, words: np.ndarray):
        self.up, self.down = _powers(len(words))
        self.sums = np.zeros(len(words) + 1, np.uint64)
        np.cumsum(words * self.up[: len(words)], out=self.sums[1:], dtype=np.uint64)

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.down[start])


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path in the folder that driver and executors share; spark.checkpoint.dir names it.

    Where that is unset, a folder of this machine does, but only for a local master.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file:///tmp/sparklog-shared"
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def stored(df: DataFrame, what: str) -> DataFrame:
    """df written once as Parquet in the shared folder and read again: later reads survive lost executors."""
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(spark: SparkSession, df: DataFrame) -> None:
    """Removes a table that stored() wrote and no later plan reads."""
    jvm = spark._jvm
    for file in df.inputFiles()[:1]:
        folder = jvm.org.apache.hadoop.fs.Path(file).getParent()
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def set_aside(df: DataFrame, out: str, *used: str) -> tuple[DataFrame, list[str]]:
    """df with a column of the name out (Spark's names ignore case) renamed to out_input, and what `used` are called then."""
    taken, names = {c.lower() for c in df.columns}, {}
    for c in df.columns:
        if c.lower() == out.lower():
            names[c] = f"{c}_input"
            while names[c].lower() in taken:
                names[c] += "_input"
    now = {c.lower(): name for c, name in names.items()}
    return df.withColumnsRenamed(names), [now.get(u.lower(), u) for u in used]


def free_name(df: DataFrame, name: str) -> str:
    """name, or name with underscores after it, so that no column of df has it (Spark's names ignore case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def keyed_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Just id and text, under the names doc_id and text, whatever else the table holds."""
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def groups_for(docs: DataFrame, bytes_each: int) -> tuple[int, int]:
    """Rows, and the number of groups that hold about bytes_each of text each: it follows the input."""
    n, size = docs.agg(F.count(F.lit(1)), F.sum(F.octet_length("text"))).first()
    return n, max(1, -(-(size or 0) // bytes_each))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Connected components of undirected edges (a, b): a table (node, component), component the least node.

    Large-star / small-star rounds: every round is a shuffle of the edges, each node's neighbours are only
    aggregated (min) and never gathered, and the edge table is written between rounds. The rounds grow with
    the logarithm of the longest path; where max_rounds don't do, an error is raised. Nodes without edges
    are not in the result; an empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    current = stored(
        edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).filter("a < b").distinct(), "edges"
    )
    for _ in range(max_rounds):
        both = current.union(current.select("b", "a"))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        # large star: neighbours above a node move to the node's least neighbour
        large = both.join(least, "a").filter("b > a").select(F.col("m").alias("a"), "b")
        large = large.filter("a <> b").distinct()
        # small star: a node and its lower neighbours move to the least of them
        lower = large.groupBy("b").agg(F.min("a").alias("m"))
        small = large.join(lower, "b").select(F.col("m"), F.col("b"), F.col("a"))
        small = small.select(F.explode(F.array(F.struct("m", "b"), F.struct("m", F.col("a").alias("b")))).alias("e"))
        new = stored(small.select(F.col("e.m").alias("a"), F.col("e.b").alias("b")).filter("a <> b").distinct(), "edges")
        changed = new.join(current, ["a", "b"], "left_anti").limit(1).count() or new.count() != current.count()
        dropped(spark, current)
        current = new
        if not changed:
            break
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = current.select(F.col("a").alias("node"), F.col("a").alias("component"))
    return current.select(F.col("b").alias("node"), F.col("a").alias("component")).union(roots).distinct()
