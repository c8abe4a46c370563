"""Exact near-duplicate links of vectors by cover trees and their dual traversal.

Vectors of one label link when their cosine reaches the threshold, that is, when their unit vectors lie within a
distance of sqrt(2 - 2 * threshold). Equal vectors are one node with a weight. Nodes stand in a tree of nested
levels: a tree node has a centre (one of its own members) and a covering radius (the distance of its farthest member).

* The upper levels are made by Spark in rounds. A cell of more than `cell_rows` nodes takes centres from a sample of
  its members that grows with its size, greedily, apart by half its radius (halved further until there are two); all
  its members go to the nearest centre in salted groups of bounded size, however hot the cell is.
* The lower levels are made in a task for each cell: radii 1, 1/2, 1/4, ..., each level's centres apart by its
  radius inside their parent and covering their children within it, down to single nodes.

Pairs of tree nodes are walked from the roots down, in Spark joins above and in arrays inside a pair of cells. With
d the distance of two centres and r, s their radii, a pair ends where d - r - s is over the linking distance (no link
between them) or d + r + s under it (all linked: weights are added to whole nodes and no pair of members is made).
Only pairs of single nodes that the bounds leave open are decided, by their cosine. So links are exact: the sample
and the bounds only decide how much work is done. Vectors that have no clusters at all, as random ones of many
dimensions, leave most pairs of cells open: then the arrays' matrix products do n * n / 2 cosines by label, and a
cell is sent to as many tasks as it has open partners.

Links give each vector a count, and a forest of edges for the components, never the pairs themselves.

Defined results: vectors that are null or empty, all zeros, hold null or non-finite components, or whose label is
null link with nothing and stand for themselves, as do vectors of a length that no other has; a null id sorts below
all others; rows that repeat an id are vectors of their own (equal ones link); ties don't arise, as a component has
one least id; other columns are not read, whatever their names; an empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import components, stored

_NO_ID = -(1 << 63)
#: Distances are told apart by this much at least before a bound decides; rounding is far below it.
_SLACK = 1e-6
_LEVELS = (1.0, 0.5, 0.25, 0.125, 0.0625, 0.03125)
#: Pairs of tree nodes whose distances are computed at once.
_AT_ONCE = 1 << 20
_MOST_CENTRES = 64
_TREE = "cell string, ids binary, weights binary, vectors binary, width int, low binary, high binary, radius binary, child binary, sizes array<int>"


def unit_rows(rows: np.ndarray) -> np.ndarray:
    """Rows as unit vectors in double precision, whatever their scale."""
    rows = rows / np.abs(rows).max(axis=1, keepdims=True)
    return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _apart(cosines: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum(2.0 - 2.0 * cosines, 0.0))


def _doubles(column: pa.ChunkedArray | pa.Array, n: int) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return column.flatten().to_numpy(zero_copy_only=False).reshape(n, -1)


class Tree:
    """A cover tree in arrays. Members are in depth-first order, a centre first among its own, so a tree node is a
    range low..high-1 of members whose centre is member low. Level by level: low, high, radius, and the range of
    child nodes in the next level (child[i]..child[i + 1]). The last level holds the members themselves."""

    def __init__(self, units: np.ndarray, weights: np.ndarray, low, high, radius, child):
        self.units, self.weights = units, weights
        self.low, self.high, self.radius, self.child = low, high, radius, child
        self.before = np.concatenate([[0], np.cumsum(weights)])

    @staticmethod
    def grown(units: np.ndarray) -> tuple[np.ndarray, list, list, list, list]:
        """The order of members, and the levels' arrays."""
        apart = _apart(units @ units.T)
        level = [np.arange(len(units))]
        levels, children = [level], []
        for reach in _LEVELS:
            below, counts = [], []
            for members in level:
                left, n = members, 0
                while len(left):
                    near = apart[left[0], left] <= reach
                    near[0] = True
                    below.append(left[near])
                    left = left[~near]
                    n += 1
                counts.append(n)
            if len(below) > len(level):  # a level that splits nothing is left out
                children.append(np.concatenate([[0], np.cumsum(counts)]))
                level = below
                levels.append(level)
        if any(len(m) > 1 for m in level):
            children.append(np.concatenate([[0], np.cumsum([len(m) for m in level])]))
            levels.append([m[k : k + 1] for m in level for k in range(len(m))])
        order = np.concatenate(levels[-1])
        low, high, radius = [], [], []
        for level in levels:
            ends = np.cumsum([len(m) for m in level])
            low.append(ends - [len(m) for m in level])
            high.append(ends)
            radius.append(np.array([apart[m[0], m].max() if len(m) > 1 else 0.0 for m in level]))
        children.append(np.arange(len(levels[-1]) + 1))
        return order, low, high, radius, children


class _Links:
    """Weights linked to each member of two trees (or of one), and which members hang together."""

    def __init__(self, first: Tree, second: Tree):
        self.a, self.b, self.one = first, second, first is second
        self.shift = 0 if self.one else len(first.weights)
        n = self.shift + len(second.weights)
        self.change, self.single, self.label = np.zeros(n + 1, np.int64), np.zeros(n, np.int64), np.arange(n)

    def add(self, level: tuple[int, int], i: np.ndarray, j: np.ndarray) -> None:
        """All members of nodes i of the first tree's level link with all members of nodes j of the second's."""
        if not len(i):
            return
        al, ah, bl, bh = self.a.low[level[0]][i], self.a.high[level[0]][i], self.b.low[level[1]][j], self.b.high[level[1]][j]
        for low, high, other, l2, h2, shift in ((al, ah, self.b, bl, bh, 0), (bl, bh, self.a, al, ah, self.shift)):
            weight = other.before[h2] - other.before[l2]
            np.add.at(self.change, low + shift, weight)
            np.subtract.at(self.change, high + shift, weight)
        x, y = [al], [bl + self.shift]
        for low, high, other, shift in ((al, ah, bl + self.shift, 0), (bl, bh, al, self.shift)):
            size = high - low
            wide = np.flatnonzero(size > 1)  # each member links with the other node's centre
            if len(wide):
                size, low, other = size[wide], low[wide], other[wide]
                begin = np.cumsum(size) - size
                x.append(np.repeat(low + shift, size) + np.arange(size.sum()) - np.repeat(begin, size))
                y.append(np.repeat(other, size))
        self.join(np.concatenate(x), np.concatenate(y))

    def within(self, level: int, i: np.ndarray) -> None:
        """All members of each node link with each other."""
        for low, high in zip(self.a.low[level][i].tolist(), self.a.high[level][i].tolist()):
            self.single[low:high] += self.a.before[high] - self.a.before[low] - self.a.weights[low:high]
            self.join(np.arange(low + 1, high), np.full(high - low - 1, low))

    def join(self, x: np.ndarray, y: np.ndarray) -> None:
        label = self.label
        while len(x):
            p, q = label[x], label[y]
            open_ = p != q
            if not open_.any():
                break
            x, y, p, q = x[open_], y[open_], p[open_], q[open_]
            np.minimum.at(label, np.maximum(p, q), np.minimum(p, q))
            while ((up := label[label]) != label).any():
                label = up
        self.label = label

    def counts(self) -> np.ndarray:
        return self.single + np.cumsum(self.change)[:-1]


def dual_traversal(first: Tree, second: Tree, cosine: float) -> _Links:
    """The links between members of two trees, or of one tree with itself (each pair once)."""
    links, one, reach = _Links(first, second), first is second, float(np.sqrt(2.0 - 2.0 * cosine))
    i = j = np.zeros(1, np.int64)
    deepest = max(len(first.low), len(second.low)) - 1
    for step in range(deepest + 1):
        u, v = min(step, len(first.low) - 1), min(step, len(second.low) - 1)
        last = step == deepest
        if step:  # the pairs of children
            above = min(step - 1, len(first.low) - 1), min(step - 1, len(second.low) - 1)
            pa_, pb = (first.child[above[0]] if u != above[0] else None), (second.child[above[1]] if v != above[1] else None)
            span = lambda child, k: (k, k + 1) if child is None else (child[k], child[k + 1])
            (a0, a1), (b0, b1) = span(pa_, i), span(pb, j)
        else:
            a0, a1, b0, b1 = i, i + 1, j, j + 1
        same = (i == j) if one else np.zeros(len(i), bool)
        many = (a1 - a0) * (b1 - b0)
        found_i, found_j = [], []
        cut = np.flatnonzero(np.diff(np.cumsum(many) // _AT_ONCE, prepend=0)) if len(many) else []
        for part in np.split(np.arange(len(many)), cut):
            if not len(part):
                continue
            if len(part) == 1:  # one block of pairs: a matrix product, by rows that fit
                k = part[0]
                width = int(b1[k] - b0[k])
                rows = max(1, _AT_ONCE // max(1, width))
                blocks = [(np.arange(r, min(r + rows, a1[k])), np.arange(b0[k], b1[k]), bool(same[k])) for r in range(a0[k], a1[k], rows)]
                for x, y, own in blocks:
                    cosines = first.units[first.low[u][x]] @ second.units[second.low[v][y]].T
                    p, q = _decided(links, (u, v), x[:, None], y[None, :], cosines, own, cosine, reach, last)
                    found_i.append(p)
                    found_j.append(q)
            else:
                n, w = many[part], (b1 - b0)[part]
                at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                w = np.repeat(w, n)
                x, y = np.repeat(a0[part], n) + at // w, np.repeat(b0[part], n) + at % w
                own = np.repeat(same[part], n)
                keep = ~own | (x <= y)
                x, y = x[keep], y[keep]
                for some in np.array_split(np.arange(len(x)), max(1, len(x) // 65_536)):
                    cosines = np.einsum("ij,ij->i", first.units[first.low[u][x[some]]], second.units[second.low[v][y[some]]])
                    p, q = _decided(links, (u, v), x[some], y[some], cosines, False, cosine, reach, last)
                    found_i.append(p)
                    found_j.append(q)
        i, j = (np.concatenate(f) if f else np.empty(0, np.int64) for f in (found_i, found_j))
        if not len(i):
            break
    return links


def _decided(links: _Links, level: tuple[int, int], x, y, cosines, own: bool, cosine: float, reach: float, last: bool):
    """Adds the pairs that the bounds accept; returns those that stay open."""
    u, v = level
    radii = links.a.radius[u][x] + links.b.radius[v][y]
    apart = _apart(cosines)
    sure = np.where(radii == 0, cosines >= cosine, apart + radii < reach - _SLACK)
    open_ = (radii > 0) & ~sure & (apart - radii <= reach + _SLACK)
    if own:
        sure, open_ = sure & (x <= y), open_ & (x <= y)
    if links.one:
        alone = np.broadcast_to(x == y, sure.shape)
        if alone.any():
            me = np.unique(np.broadcast_to(x, sure.shape)[alone])
            several = links.a.high[u][me] - links.a.low[u][me] > 1
            dense = several & (2 * links.a.radius[u][me] < reach - _SLACK)
            links.within(u, me[dense])
            settled = np.zeros(len(links.a.low[u]), bool)
            settled[me[dense | ~several]] = True
            sure = sure & ~alone
            open_ = np.where(alone, ~settled[np.broadcast_to(x, sure.shape)], open_)
    for some in np.array_split(np.flatnonzero(sure.ravel()), max(1, int(sure.sum()) // 250_000)):
        at = np.unravel_index(some, sure.shape)
        links.add(level, np.broadcast_to(x, sure.shape)[at], np.broadcast_to(y, sure.shape)[at])
    at = np.nonzero(open_)
    return np.broadcast_to(x, open_.shape)[at].astype(np.int64), np.broadcast_to(y, open_.shape)[at].astype(np.int64)


def _cell_tree(table: pa.Table) -> pa.Table:
    """The cover tree of one cell, in a row."""
    n = table.num_rows
    rows = _doubles(table.column("v"), n)
    order, low, high, radius, child = Tree.grown(unit_rows(rows))
    rows = rows[order]
    short = rows.astype(np.float32)
    kept = short if (short == rows).all() else rows  # singles where they lose nothing
    pack = lambda parts, kind: np.concatenate(parts).astype(kind).tobytes()
    row = {
        "cell": table.column("cell")[0].as_py(), "ids": table.column("node").to_numpy()[order].tobytes(), "weights": table.column("n").to_numpy()[order].tobytes(),
        "vectors": kept.tobytes(), "width": kept.itemsize, "low": pack(low, np.int32), "high": pack(high, np.int32), "radius": pack(radius, np.float64),
        "child": pack(child, np.int32), "sizes": [len(x) for x in low],
    }
    kinds = [pa.string(), *[pa.binary()] * 3, pa.int32(), *[pa.binary()] * 4, pa.list_(pa.int32())]
    return pa.table([pa.array([v], t) for v, t in zip(row.values(), kinds)], list(row))


def _tree_of(row: dict) -> tuple[np.ndarray, Tree]:
    ids, weights = np.frombuffer(row["ids"], np.int64), np.frombuffer(row["weights"], np.int64)
    rows = np.frombuffer(row["vectors"], np.float32 if row["width"] == 4 else np.float64).reshape(len(ids), -1).astype(np.float64)
    sizes = np.array(row["sizes"])
    split = lambda name, kind, more=0: np.split(np.frombuffer(row[name], kind), np.cumsum(sizes + more)[:-1])
    as_long = lambda parts: [p.astype(np.int64) for p in parts]
    return ids, Tree(unit_rows(rows), weights, as_long(split("low", np.int32)), as_long(split("high", np.int32)), split("radius", np.float64), as_long(split("child", np.int32, 1)))


def _walked(cosine: float):
    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = (batch.column(c)[k].as_py() for c in ("left", "right"))
                ids, first = _tree_of(a)
                others, second = (ids, first) if b["cell"] == a["cell"] else _tree_of(b)
                links = dual_traversal(first, second, cosine)
                every, counts = (ids if second is first else np.concatenate([ids, others])), links.counts()
                hit = np.flatnonzero(counts)
                yield pa.RecordBatch.from_arrays([pa.array(every[hit]), pa.array(counts[hit]), pa.array(every[links.label[hit]])], ["node", "links", "root"])

    return walk


def _centres(cell_rows: int):
    """Of a cell's sampled members: centres apart by half the cell's radius, or by less until there are two."""

    def choose(table: pa.Table) -> pa.Table:
        rows = _doubles(table.column("v"), table.num_rows)
        units = unit_rows(rows)
        apart = _apart(units @ units.T)
        most = int(min(_MOST_CENTRES, max(2, -(-2 * table.column("many")[0].as_py() // cell_rows))))
        reach = table.column("radius")[0].as_py() / 2
        while True:
            left, chosen = np.arange(len(rows)), []
            while len(left) and len(chosen) < most:
                chosen.append(left[0])
                left = left[apart[left[0], left] > reach]
            if len(chosen) > 1 or reach < 1e-9:
                break
            reach /= 2
        if len(chosen) < 2:  # members in one direction: any will do
            chosen = list(range(min(most, len(rows))))
        value = rows[chosen].astype(np.float64)
        return pa.table({"cell": table.column("cell").slice(0, 1), "width": pa.array([rows.shape[1]], pa.int32()), "centres": pa.array([value.tobytes()], pa.binary())})

    return choose


def _assigned(key: tuple, members: pa.Table, centres: pa.Table) -> pa.Table:
    """Members of a salted part of a cell go to the nearest centre; far: their distance."""
    n = members.num_rows
    if not n:
        empty = [pa.array([], t) for t in (pa.int64(), pa.string(), pa.string(), pa.list_(pa.float64()), pa.int64(), pa.float64())]
        return pa.table(empty, ["node", "cell", "parent", "v", "n", "far"])
    at = unit_rows(np.frombuffer(centres.column("centres")[0].as_py(), np.float64).reshape(-1, centres.column("width")[0].as_py()))
    cosines = unit_rows(_doubles(members.column("v"), n)) @ at.T
    nearest = cosines.argmax(axis=1)
    cell = members.column("cell")[0].as_py()
    names = pa.array([f"{cell}/{k}" for k in range(len(at))])
    return pa.table(
        [members.column("node"), names.take(pa.array(nearest)), members.column("cell"), members.column("v"), members.column("n"), pa.array(_apart(cosines[np.arange(n), nearest]))],
        ["node", "cell", "parent", "v", "n", "far"],
    )


def _split_rounds(points: DataFrame, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """(members by final cell, tree nodes above and at the cells) by rounds that split the cells that are too large."""
    summed = lambda df, *more: df.groupBy("cell", *more).agg(F.count("*").alias("many"), F.max("far").alias("radius"), F.min_by("v", "far").alias("centre"))
    level = stored(summed(points.withColumn("far", F.lit(2.0))).withColumn("parent", F.lit(None).cast("string")), "nodes")
    open_, done, nodes = points.select("node", "cell", "v", "n"), [], [level]
    while True:
        large = level.filter(F.col("many") > cell_rows)
        if not large.limit(1).count():
            return reduce(DataFrame.unionByName, [*done, open_]), reduce(DataFrame.unionByName, nodes)
        marked = open_.join(large.select("cell", "many", "radius"), "cell", "left")
        done.append(marked.filter("many IS NULL").select("node", "cell", "v", "n"))
        rest = marked.filter("many IS NOT NULL")
        share = F.least(F.lit(1.0), 4.0 * F.least(F.lit(_MOST_CENTRES), F.greatest(F.lit(8), F.ceil(2 * F.col("many") / cell_rows))) / F.col("many"))
        drawn = rest.filter((F.pmod(F.xxhash64("node", F.lit(len(nodes))), F.lit(1 << 20)) < share * (1 << 20)) | (F.col("many") <= 64))
        centres = drawn.groupBy("cell").applyInArrow(_centres(cell_rows), "cell string, width int, centres binary")
        parts = F.ceil(F.col("many") / (4 * cell_rows)).cast("int")
        salted = rest.withColumn("salt", F.pmod(F.hash("node"), parts))
        spread = centres.join(large.select("cell", "many"), "cell").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1)))
        moved = salted.groupBy("cell", "salt").cogroup(spread.groupBy("cell", "salt")).applyInArrow(_assigned, "node long, cell string, parent string, v array<double>, n long, far double")
        moved = stored(moved, "cells")
        level = stored(summed(moved, "parent"), "nodes")
        nodes.append(level)
        open_ = moved.select("node", "cell", "v", "n")


def _bounded(cosine: float):
    """Of pairs of tree nodes: 0 no link between them, 1 open, 2 all linked."""
    reach = float(np.sqrt(2.0 - 2.0 * cosine))

    @F.arrow_udf("int")
    def verdict(left: pa.Array, right: pa.Array, radii: pa.Array) -> pa.Array:
        r, apart = radii.to_numpy(zero_copy_only=False), np.empty(len(left))
        sizes = pc.list_value_length(left).to_numpy(zero_copy_only=False)
        for size in np.unique(sizes):  # both sides of a pair have the same length
            own = pa.array(sizes == size)
            n = int((sizes == size).sum())
            apart[sizes == size] = _apart(np.einsum("ij,ij->i", *[unit_rows(_doubles(side.filter(own), n)) for side in (left, right)]))
        return pa.array(np.where(apart - r > reach + _SLACK, 0, np.where(apart + r < reach - _SLACK, 2, 1)).astype(np.int32))

    return verdict


def _open_pairs(nodes: DataFrame, cosine: float) -> tuple[DataFrame, DataFrame]:
    """Walks pairs of tree nodes from the roots down: (pairs of cells that stay open, pairs of nodes all linked)."""
    names = nodes.select("cell", "radius", "centre", F.col("parent").alias("above"))
    inner = nodes.filter("parent IS NOT NULL").select(F.col("parent").alias("cell")).distinct()
    leaves = names.join(inner, "cell", "left_anti")
    # a cell stands for itself below, so that both sides of a pair go down together
    steps = stored(names.filter("above IS NOT NULL").withColumn("leaf", F.lit(False)).join(leaves.select("cell", F.lit(True).alias("is_leaf")), "cell", "left")
                   .select("above", "cell", "radius", "centre", F.coalesce("is_leaf", "leaf").alias("leaf"))
                   .unionByName(leaves.select(F.col("cell").alias("above"), "cell", "radius", "centre", F.lit(True).alias("leaf"))), "steps")
    roots = names.filter("above IS NULL").select(F.col("cell").alias("a"), F.col("cell").alias("b"))
    side = lambda s: steps.select(F.col("above").alias(s), *[F.col(c).alias(f"{c}_{s}") for c in ("cell", "radius", "centre", "leaf")])
    verdict, front = _bounded(cosine), roots
    finished, linked = [], []
    while True:
        pairs = front.join(side("a"), "a").join(side("b"), "b").filter((F.col("a") != F.col("b")) | (F.col("cell_a") <= F.col("cell_b")))
        judged = pairs.withColumn("verdict", F.when(F.col("cell_a") == F.col("cell_b"), F.lit(1)).otherwise(verdict("centre_a", "centre_b", F.col("radius_a") + F.col("radius_b"))))
        judged = stored(judged.filter("verdict > 0").select(F.col("cell_a").alias("a"), F.col("cell_b").alias("b"), (F.col("leaf_a") & F.col("leaf_b")).alias("leaf"), "verdict"), "front")
        linked.append(judged.filter("verdict = 2").select("a", "b"))
        finished.append(judged.filter("verdict = 1 AND leaf").select("a", "b"))
        front = judged.filter("verdict = 1 AND NOT leaf").select("a", "b")
        if not front.limit(1).count():
            return reduce(DataFrame.union, finished), reduce(DataFrame.union, linked)


def similar_vectors(
    vectors: DataFrame, cosine: float = 0.93, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label", cell_rows: int = 2048
) -> DataFrame:
    """vec_id, n_links, component_id (the least vec_id reachable by links) and kept (is it this one) of each vector."""
    if not 0 < cosine < 1:
        raise ValueError("the threshold must lie between 0 and 1")
    rows = vectors.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v"), F.col(label_col).cast("string").alias("label"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) | ~F.exists("v", lambda x: x != 0)
    usable = F.col("v").isNotNull() & F.col("label").isNotNull() & (F.size("v") > 0) & ~bad
    rows = rows.withColumn("usable", F.coalesce(usable, F.lit(False)))
    classes = rows.filter("usable").groupBy("label", "v").agg(F.count("*").alias("n"), F.min("vec_id").alias("least"))
    classes = stored(classes.select(F.monotonically_increasing_id().alias("node"), F.concat_ws(":", F.size("v").cast("string"), "label").alias("cell"), "*"), "classes")
    members, nodes = _split_rounds(classes.select("node", "cell", "v", "n"), cell_rows)
    trees = stored(members.groupBy("cell").applyInArrow(_cell_tree, _TREE), "trees")
    open_pairs, linked = _open_pairs(nodes, cosine)
    packed = trees.select("cell", F.struct("*").alias("tree"))
    side = lambda key, name: packed.select(F.col("cell").alias(key), F.col("tree").alias(name))
    work = open_pairs.repartition("a", "b").join(side("a", "left"), "a").join(side("b", "right"), "b").select("left", "right")
    found = stored(work.mapInArrow(_walked(cosine), "node long, links long, root long"), "found")
    # nodes of whole cells: weights are added by cell, and members hang on their node's first member
    cells = members.select("node", "cell", "n").withColumn("over", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("cell", "/"))), lambda k: F.array_join(F.slice(F.split("cell", "/"), F.lit(1), k), "/"))))
    both = stored(linked.union(linked.select("b", "a")).toDF("over", "other"), "linked")
    heavy = cells.join(both.select("over").union(both.select("other")).distinct(), "over", "left_semi")
    weight = heavy.groupBy("over").agg(F.sum("n").alias("weight"), F.min("node").alias("head"))
    added = both.join(weight.toDF("other", "weight", "other_head"), "other").groupBy("over").agg(F.sum("weight").alias("links"), F.min("other_head").alias("root"))
    whole = heavy.join(added, "over").select("node", "links", "root")
    heads = both.join(weight.toDF("over", "w1", "node"), "over").join(weight.toDF("other", "w2", "root"), "other").select("node", F.lit(0).cast("long").alias("links"), "root")
    every = found.unionByName(whole).unionByName(heads)
    counts = every.groupBy("node").agg(F.sum("links").alias("links"))
    labels = components(every.select(F.col("node").alias("a"), F.col("root").alias("b")))
    of_class = classes.join(counts, "node", "left").join(labels, "node", "left")
    of_class = of_class.select("node", "label", "v", "least", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component", "node").alias("component"))
    first = of_class.groupBy("component").agg(F.min("least").alias("component_id"))
    of_class = stored(of_class.join(first, "component").select("label", "v", "n_links", "component_id"), "classes")
    out = rows.filter("usable").join(of_class, ["label", "v"]).select("vec_id", "n_links", "component_id")
    out = out.unionByName(rows.filter("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id")))
    restored = lambda c: F.nullif(c, F.lit(_NO_ID))
    return out.select(restored(F.col("vec_id")).alias("vec_id"), "n_links", restored(F.col("component_id")).alias("component_id"), (F.col("vec_id") == F.col("component_id")).alias("kept"))
