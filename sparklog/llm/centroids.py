"""K-means on integer vectors with exact arithmetic, from a persisted table of dot products.

Components become integers, so sums, dot products and squared distances are exact and don't depend on the order of
rows, partitions or retries. Each vector's dot product with each centroid is kept in a table. When a centroid moves,
only its components that changed matter: the table's column is updated by those, and |x|^2 - 2 x.c + |c|^2 gives
the new distances, of which the least is the vector's cluster (ties: the smaller number). The sums of clusters are
updated the same way, by the vectors that changed cluster. What reaches the driver is k centroids and k sums.

Each round writes the table once to the shared folder and drops the one before; tasks take rows in any partition, so
no key is hot. Defined results: vectors that are null, of another length, or hold a null or non-finite component are
left out, and so are those whose squared length is over 2^60 (a squared distance would not fit a long); with fewer
than k vectors each is a centroid; a null id is no seed before all others are; rows that repeat an id are vectors of
their own (as seeds in the order of their components); an empty cluster keeps its centroid; other columns are not
read, whatever their names; an empty table gives an empty table. A sum of distances that no long holds is null.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import dropped, stored

_STATE = "vec_id long, x array<int>, norm long, dots array<long>, was int, cluster int, distance long"


def integer_vectors(vectors: DataFrame, size: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id and x, the integers floor(scale * component), of the vectors that can be clustered."""
    bad = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"))
    rows = rows.filter((F.size("v") == size) & ~F.exists("v", bad))
    scaled = F.transform("v", lambda v: F.floor(F.greatest(F.least(v * scale, F.lit(2.0**31 - 1)), F.lit(-(2.0**31)))).cast("int"))
    length = F.aggregate("v", F.lit(0.0), lambda s, v: s + F.floor(F.greatest(F.least(v * scale, F.lit(2.0**31)), F.lit(-(2.0**31)))).cast("double") ** 2)
    return rows.filter(length <= 2.0**60).select("vec_id", scaled.alias("x"))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, width)


def _lists(values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    offsets = np.arange(0, values.size + 1, values.shape[1], dtype=np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.ravel(), kind))


def updated_dots(x: np.ndarray, dots: np.ndarray, change: list[list[int]]) -> np.ndarray:
    """dots after each centroid's change; components that didn't change cost nothing."""
    for c, delta in enumerate(change):
        moved = [j for j, d in enumerate(delta) if d]
        if moved:
            dots[:, c] += x[:, moved] @ np.array([delta[j] for j in moved], np.int64)
    return dots


def _advanced(state: DataFrame, centroids: list[list[int]], change: list[list[int]], size: int) -> DataFrame:
    """Dot products after the centroids' change, and the nearest centroid by them. A first state lacks the dot products."""
    k = len(centroids)
    lengths = np.array([sum(v * v for v in c) for c in centroids], np.int64)
    first = "dots" not in state.columns

    def advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, x = batch.num_rows, _matrix(batch.column("x"), size)
            norm = (x * x).sum(axis=1) if first else batch.column("norm").to_numpy()
            was = np.full(n, -1, np.int32) if first else batch.column("cluster").to_numpy()
            dots = updated_dots(x, np.zeros((n, k), np.int64) if first else _matrix(batch.column("dots"), k).copy(), change)
            apart = norm[:, None] - 2 * dots + lengths
            nearest = apart.argmin(axis=1) if n else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("x"), pa.array(norm, pa.int64()), _lists(dots, pa.int64()), pa.array(was, pa.int32()),
                    pa.array(nearest, pa.int32()), pa.array(apart[np.arange(n), nearest], pa.int64()),
                ],
                ["vec_id", "x", "norm", "dots", "was", "cluster", "distance"],
            )

    return state.mapInArrow(advance, _STATE)


def _changed_sums(state: DataFrame, k: int, size: int) -> list[tuple[int, int, int]]:
    """(cluster, component, change of its sum) by the vectors that changed cluster; component `size` is the count."""

    def added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((k, size + 1), np.int64)
        for batch in batches:
            x = np.column_stack([_matrix(batch.column("x"), size), np.ones(batch.num_rows, np.int64)])
            was, now = batch.column("was").to_numpy(), batch.column("cluster").to_numpy()
            np.add.at(sums, now, x)
            np.subtract.at(sums, was[was >= 0], x[was >= 0])
        cluster, part = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(cluster, pa.int32()), pa.array(part, pa.int32()), pa.array(sums[cluster, part])], ["cluster", "part", "total"])

    moved = state.filter("cluster <> was").select("x", "was", "cluster").mapInArrow(added, "cluster int, part int, total long")
    rows = moved.groupBy("cluster", "part").agg(F.sum(F.col("total").cast("decimal(20,0)")).alias("total"))
    return [(r["cluster"], r["part"], int(r["total"])) for r in rows.collect()]  # k * (size + 1) numbers at most


def centroid_clusters(
    vectors: DataFrame, k: int = 40, rounds: int = 5, size: int = 64, scale: int = 256, seed: str = "2:", id_col: str = "vec_id", vec_col: str = "embedding"
) -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and the final centroid of each vector's cluster.

    The k vectors whose SHA-256 of seed and id is least are the first centroids, in that order.
    """
    spark = vectors.sparkSession
    points = integer_vectors(vectors, size, scale, id_col, vec_col)
    order = F.sha2(F.concat(F.lit(seed), F.col("vec_id").cast("string")), 256).asc_nulls_last()
    centroids = [list(r["x"]) for r in points.orderBy(order, "x").limit(k).collect()]
    if not centroids:
        return points.select(
            "vec_id", F.lit(0).alias("cluster"), *[F.lit(0).cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], F.col("x").alias("centroid")
        )
    sums = [[0] * (size + 1) for _ in centroids]
    change, state = centroids, points
    for turn in range(rounds + 1):
        new = stored(_advanced(state, centroids, change, size), "dots")
        if turn:
            dropped(spark, state)
        state = new
        if turn < rounds:
            for cluster, part, total in _changed_sums(state, len(centroids), size):
                sums[cluster][part] += total
            after = [[v // s[size] for v in s[:size]] if s[size] else c for c, s in zip(centroids, sums)]
            change = [[b - a for a, b in zip(*pair)] for pair in zip(centroids, after)]
            centroids = after
    inertia = {r["cluster"]: int(r["total"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total")).collect()}
    as_long = lambda v: v if v < 1 << 63 else None
    whole = as_long(sum(inertia.values()))
    by_cluster = spark.createDataFrame(
        [(c, as_long(total), whole, centroids[c]) for c, total in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid array<int>"
    )
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(by_cluster), "cluster")  # k rows at most
