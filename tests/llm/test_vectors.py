"""Near-duplicate vectors by cover trees and integer k-means, against brute force."""

import hashlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparklog.llm import centroids, cover_tree

SCHEMA = "vec_id long, embedding array<double>, label int, component_id string, node string, v int"


def clustered(seed=1, n=260, size=16):
    """Vectors of three labels: scattered ones, tight and loose clusters, copies, multiples."""
    random = np.random.default_rng(seed)
    middle = random.normal(size=(6, size))
    rows = []
    for k in range(n):
        label = int(random.choice([0, 0, 0, 1, 2]))
        kind = k % 5
        if kind == 0:
            v = random.normal(size=size)
        elif kind == 4 and rows:
            v = np.array(rows[int(random.integers(len(rows)))][1]) * (1.0 if k % 2 else 3.0)
        else:
            v = middle[k % 6] + random.normal(size=size) * (0.02 if kind == 1 else 0.2)
        rows.append((k, [float(x) for x in v], label))
    return rows


def brute(rows, cosine):
    """n_links and component of each row by all pairs."""
    def usable(r):
        return r[1] is not None and r[2] is not None and len(r[1]) > 0 and all(x is not None and np.isfinite(x) for x in r[1]) and any(r[1])

    n = len(rows)
    links, root = [0] * n, list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    units = [np.array(r[1]) / np.abs(r[1]).max() if usable(r) else None for r in rows]
    for a in range(n):
        for b in range(a + 1, n):
            if units[a] is None or units[b] is None or rows[a][2] != rows[b][2] or len(units[a]) != len(units[b]):
                continue
            if units[a] @ units[b] / np.linalg.norm(units[a]) / np.linalg.norm(units[b]) >= cosine:
                links[a] += 1
                links[b] += 1
                root[find(a)] = find(b)
    ids = [-(1 << 63) if r[0] is None else r[0] for r in rows]
    least = {}
    for k in range(n):
        least[find(k)] = min(least.get(find(k), 1 << 62), ids[k])
    return sorted((ids[k], links[k], least[find(k)], ids[k] == least[find(k)]) for k in range(n))


def got(df):
    low = lambda x: -(1 << 63) if x is None else x
    return sorted((low(r["vec_id"]), r["n_links"], low(r["component_id"]), r["kept"]) for r in df.collect())


@pytest.mark.parametrize("cell_rows", [24, 2048])
@pytest.mark.parametrize("cosine", [0.93, 0.5])
def test_links_equal_brute_force(spark, cell_rows, cosine):
    rows = clustered()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(cover_tree.similar_vectors(df, cosine, cell_rows=cell_rows)) == brute(rows, cosine)


def test_links_of_odd_vectors(spark):
    rows = [
        (1, None, 0), (2, [], 0), (3, [0.0, 0.0], 0), (4, [1.0, None], 0), (5, [1.0, float("nan")], 0), (6, [float("inf"), 1.0], 0), (7, [1.0, 1.0], None),
        (8, [1.0, 1.0], 0), (9, [2.0, 2.0], 0), (9, [2.0, 2.0], 0), (None, [1.0, 1.01], 0), (10, [1.0, 1.0, 0.0], 0), (11, [1e300, 1e300], 0), (12, [1.0, 1.0], 1), (13, [-1.0, -1.0], 0),
    ]
    df = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], SCHEMA)
    assert got(cover_tree.similar_vectors(df)) == brute(rows, 0.93)
    empty = cover_tree.similar_vectors(df.limit(0))
    assert empty.collect() == [] and empty.columns == ["vec_id", "n_links", "component_id", "kept"]


def test_one_tight_cluster_is_linked_by_whole_cells(spark):
    """A cluster whose cells lie inside the linking distance: its cells are linked as wholes."""
    random = np.random.default_rng(3)
    rows = [(k, [float(x) for x in (1 + random.normal(size=8) * 0.01)], 0) for k in range(120)] + [(200 + k, [float(x) for x in random.normal(size=8)], 0) for k in range(40)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert got(cover_tree.similar_vectors(df, cell_rows=10)) == brute(rows, 0.93)


def test_trees_cover_and_nest():
    units = cover_tree.unit_rows(np.array([r[1] for r in clustered(5)]))
    order, low, high, radius, child = cover_tree.Tree.grown(units)
    assert sorted(order) == list(range(len(units)))
    at = units[order]
    for level in range(len(low)):
        for k in range(len(low[level])):
            members = at[low[level][k] : high[level][k]]
            assert np.sqrt(np.maximum(0, 2 - 2 * members @ members[0])).max() <= radius[level][k] + 1e-7
            if level + 1 < len(low):
                own = range(child[level][k], child[level][k + 1])
                assert low[level + 1][own[0]] == low[level][k] and high[level + 1][own[-1]] == high[level][k]


def lloyd(rows, k, rounds, size):
    kept = [(i, [int(np.floor(256 * float(x))) for x in v]) for i, v, *_ in rows if v is not None and len(v) == size and all(x is not None and np.isfinite(x) for x in v)]
    order = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"2:{r[0]}".encode()).hexdigest(), r[1]))
    middle = [x for _, x in order[:k]]
    near = lambda x: min((sum((a - b) ** 2 for a, b in zip(x, c)), n) for n, c in enumerate(middle))
    for _ in range(rounds):
        groups = {}
        for _, x in kept:
            groups.setdefault(near(x)[1], []).append(x)
        middle = [[sum(c) // len(groups[n]) for c in zip(*groups[n])] if n in groups else m for n, m in enumerate(middle)]
    found = [(i, near(x)) for i, x in kept]
    inertia = {}
    for _, (d, n) in found:
        inertia[n] = inertia.get(n, 0) + d
    return sorted((-1 if i is None else i, n, d, inertia[n], sum(inertia.values()), middle[n]) for i, (d, n) in found)


def clusters(df):
    return sorted((-1 if r["vec_id"] is None else r["vec_id"], *r[1:]) for r in df.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid").collect())


def test_clusters_equal_brute_force(spark):
    rows = [r[:2] for r in clustered(9, 150, 8)] + [(500, [0.5] * 8), (500, [0.25] * 8), (None, [0.1] * 8), (501, [1.0] * 7), (502, None), (503, [1.0] * 7 + [None]), (504, [float("nan")] * 8), (505, [float("-inf")] * 8)]
    df = spark.createDataFrame([(*r, "a", "b") for r in rows], "vec_id long, embedding array<double>, cluster string, x string")
    assert clusters(centroids.centroid_clusters(df, k=7, rounds=5, size=8)) == lloyd(rows, 7, 5, 8)


def test_clusters_of_few_equal_and_no_vectors(spark):
    rows = [(k, [1.0, -2.0]) for k in range(5)] + [(9, [4.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert clusters(centroids.centroid_clusters(df, k=40, rounds=5, size=2)) == lloyd(rows, 40, 5, 2)
    none = centroids.centroid_clusters(df.limit(0), size=2)
    assert none.collect() == [] and set(none.columns) == {"vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid"}
    giant = spark.createDataFrame([(1, [1e30, 0.0]), (2, [1.0, 0.0])], "vec_id long, embedding array<double>")
    assert [r["vec_id"] for r in centroids.centroid_clusters(giant, size=2).collect()] == [2]


def test_dot_products_follow_changed_components():
    random = np.random.default_rng(2)
    x, c = random.integers(-99, 99, (20, 6)), random.integers(-99, 99, (3, 6))
    after = c.copy()
    after[1, 2] += 5
    after[2, :] = 0
    dots = centroids.updated_dots(x, np.zeros((20, 3), np.int64), c.tolist())
    assert (dots == x @ c.T).all()
    assert (centroids.updated_dots(x, dots, (after - c).tolist()) == x @ after.T).all()


def test_plans_have_no_cross_join(spark):
    df = spark.createDataFrame(clustered(), "vec_id long, embedding array<double>, label int").withColumn("more", F.lit(1))
    plan = cover_tree.similar_vectors(df)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
