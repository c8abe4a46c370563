"""A streaming source of lines of growing files: its offsets are bytes of each file.

    spark.dataSource.register(GrowingLines)
    spark.readStream.format("growing_lines").option("path", root).option("glob", "*.jsonl").load()

Each trigger lists the files below the path and reads what was appended: the ranges between two offsets, cut into
blocks for tasks. A line comes in the batch in which its line feed does, once, with its begin and end in the
file: from a range a task reads the lines that end in it, looking back for the begin of the first. So a line that is
still being written waits, and a batch that is run again after a failure gives the same rows. Files that shrink are
left alone until they have outgrown the offset.

The driver holds a size for each file below the path, and so does the checkpoint of each batch: roll files into
folders that a stream no longer has to watch before they are millions.
"""

from __future__ import annotations

import fnmatch
from collections.abc import Iterator
from urllib.parse import quote, unquote, urlsplit

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition
from pyspark.sql.types import StructType

from sparklog.sources.ranges import BEYOND, BLOCK, STEP, TASK, _texts, opened

#: A batch has about so many tasks, or one for each TASK bytes.
TASKS = 64

SCHEMA = "file_path string, block int, place long, line_begin long, line_end long, line string"


def sizes_below(root: str, glob: str) -> dict[str, int]:
    """The size of each file below the root whose name fits, by the path that Spark lists it under."""
    if root.startswith("file:") or "://" not in root:
        system, folder = pa.fs.LocalFileSystem(), unquote(urlsplit(root).path) if root.startswith("file:") else root
        name = lambda path: "file:" + quote(path)
    else:
        system, folder = pa.fs.FileSystem.from_uri(root)
        parts = urlsplit(root)
        name = lambda path: f"{parts.scheme}://{parts.netloc}/{quote(path.removeprefix(parts.netloc).lstrip('/'))}"
    found = system.get_file_info(pa.fs.FileSelector(folder, recursive=True, allow_not_found=True))
    return {name(f.path): f.size for f in found if f.type == pa.fs.FileType.File and fnmatch.fnmatch(f.base_name, glob)}


def line_start(file: pa.NativeFile, at: int) -> int:
    """Where the line begins that the byte before `at` belongs to, or that begins at `at`."""
    end = at
    while end > 0:
        begin = max(0, end - BEYOND)
        file.seek(begin)
        found = file.read(end - begin).rfind(b"\n")
        if found >= 0:
            return begin + found + 1
        end = begin
    return 0


def lines_ending(file: pa.NativeFile, start: int, stop: int) -> Iterator[tuple[list[bytes], int]]:
    """Lists of lines whose line feed is among the bytes start..stop - 1, each with the offset of its first line."""
    at, rest = start, b""
    file.seek(start)
    begin = None
    while at < stop:
        data = file.read(min(STEP, stop - at))
        if not data:
            return
        at += len(data)
        cut = data.rfind(b"\n")
        if cut < 0:
            rest += data
            continue
        lines, tail = (rest + data[:cut]).split(b"\n"), data[cut + 1 :]
        if begin is None:  # the first line may have begun before start
            begin = line_start(file, start)
            if begin < start:
                file.seek(begin)
                lines[0] = file.read(start - begin) + lines[0]
            file.seek(at)
        yield lines, begin
        begin, rest = at - len(tail), tail


class _Blocks(InputPartition):
    """Blocks (path, number, start, stop) that a task reads one after the other."""

    def __init__(self, blocks: list[tuple[str, int, int, int]]):
        self.blocks = blocks


class _Reader(DataSourceStreamReader):
    def __init__(self, options: dict[str, str]):
        self.root, self.glob, self.block = options["path"], options.get("glob", "*"), int(options.get("blockbytes", options.get("blockBytes", BLOCK)))

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return sizes_below(self.root, self.glob)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        blocks = []
        for path, size in end.items():
            first = start.get(path, 0)
            blocks += [(path, k, at, min(at + self.block, size)) for k, at in enumerate(range(first, size, self.block))]
        # a task each, unless they are many and small: a batch of gigabytes would have more tasks than work
        least = min(TASK, -(-sum(stop - at for _, _, at, stop in blocks) // TASKS))
        tasks, held = [], least
        for block in blocks:
            if held >= least:
                tasks.append([])
                held = 0
            tasks[-1].append(block)
            held += block[3] - block[2]
        return [_Blocks(task) for task in tasks]

    def read(self, partition: _Blocks) -> Iterator[pa.RecordBatch]:
        for block in partition.blocks:
            yield from self._lines(*block)

    def _lines(self, path: str, block: int, start: int, stop: int) -> Iterator[pa.RecordBatch]:
        place = 0
        with opened(path) as file:
            for lines, at in lines_ending(file, start, stop):
                n, ends = len(lines), []
                for line in lines:
                    ends.append((ends[-1] if ends else at) + len(line) + 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([path] * n), pa.array([block] * n, pa.int32()), pa.array(range(place + 1, place + n + 1), pa.int64()),
                        pa.array([at, *ends[:-1]], pa.int64()), pa.array(ends, pa.int64()), _texts(lines),
                    ],
                    ["file_path", "block", "place", "line_begin", "line_end", "line"],
                )
                place += n


class GrowingLines(DataSource):
    """Options: path, glob (of file names), blockBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _Reader(dict(self.options))


def growing_lines(spark: SparkSession, root: str, glob: str = "*.jsonl", block_bytes: int = BLOCK) -> DataFrame:
    """The stream of lines appended to the files below a root."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", root).option("glob", glob).option("blockBytes", str(block_bytes)).load()


def numbered(batch: DataFrame, manifest: DataFrame) -> DataFrame:
    """A batch's lines after what the manifest knows, numbered on from its lines: by counts of blocks, not of rows.

    The manifest's offsets and the counts of blocks go to each task, so no line is moved to those of its file; the
    driver holds as much of each file already, as the source's offsets.
    """
    known = manifest.select("file_path", F.col("last_byte_offset").alias("_read"), F.col("last_line_number").alias("_lines"))
    fresh = batch.join(F.broadcast(known), "file_path", "left").filter(F.col("line_end") > F.coalesce("_read", F.lit(0)))
    by_block = fresh.groupBy("file_path", "block").agg(F.count("*").alias("n"), F.min("place").alias("_first"))
    before = by_block.withColumn("_before", F.coalesce(F.sum("n").over(Window.partitionBy("file_path").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    rows = fresh.join(F.broadcast(before.drop("n")), ["file_path", "block"])
    return rows.withColumn("line_no", F.coalesce("_lines", F.lit(0)) + F.col("_before") + F.col("place") - F.col("_first") + 1).withColumn("ended", F.lit(True)).drop("_read", "_lines", "_before", "_first", "block", "place")
