"""Exact Jaccard join of documents on word n-gram sets, by token-combination prefixes.

A document is the set of its distinct shingles (`n` neighbouring words; fewer words: the whole text as one).
Shingles are ordered by the number of documents that have them, rare ones first. Two sets whose similarity
reaches the threshold miss few of each other's shingles, so they meet in a short prefix of this order:

* rare shingles of a prefix are indexed alone;
* frequent ones (in more than `frequent` documents) are indexed as pairs within classes of their hash. One missed
  shingle breaks at most one of the (count - 1) links of a class, so the prefix is extended by one shingle for
  each class it enters, and similar sets then share a rare shingle or a pair. A set has a class for every 4 to 8
  of its shingles, up to `parts`, so that its prefix is always long enough; a set that may match sets with
  another number of classes is indexed by either number.

Shingles in one document only never match: most documents have more of them than a prefix is long and drop
out. Documents with the same set are one node. Links are asked for connectivity: in each index group, members
are compared with a few centres first (those with the fewest shingles of their own, such as the original among
its copies), linked nodes are joined to components, and later rounds compare only nodes that are still in
different components, until no pair of a group is left untested. Keys with the same members are one: a pair of near
copies shares hundreds of keys, and would be found by each. Size and parity bitmaps of the sets, as
wide as the lesser of two sets needs, bound the overlap and settle most pairs; the rest is verified on whole sets. No link between different texts is lost.

An index key with more than `most` members is split. Its members are dealt to blocks, each of which is compared
with the key's centres in a task of its own. What is then left is two parts: the members of its commonest component,
and all others. Blocks of others are compared with each other and with blocks of that component, a task for two
blocks; so a task holds 2 * `most` members at a time, however frequent a key is.

Shingle counts go through groups of hash ranges (32 bits of hash in a group: a clash can only worsen the
order, which all documents share). Sets are compared by 64-bit hashes of shingles.

Defined results: null and empty texts, and texts of white space, have an empty set and link with nothing; a
null id sorts below all others; rows that repeat an id give a row each; a text of any length is compared by its
whole set; ties don't arise, as a component has one least id; other columns, whatever their names, are not read; an
empty table gives an empty table.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.shared import MEMOS, WORD_HASHES, RangeHash, begin_task, components, groups_for, mix, stored

_NO_ID = -(1 << 63)
_BITS = 512
_SEEN = "bucket int, group int, low binary, docs binary"
_CODES = "group int, bucket int, codes binary"
_PARTS = "kind int, doc_id long, n long, node long, sig long, own int, tokens binary, bitmap binary, wide binary"
_PAIRS = "a long, b long, more boolean"


def shingle_set(text: str | None, n: int) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles: words lower-cased in A-Z."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else ()  # bytes: ASCII only
    if not words:
        return np.empty(0, np.uint64)
    hashes = np.fromiter(map(_WORDS.__getitem__, words), np.uint64, count=len(words))
    at = np.arange(max(1, len(hashes) - n + 1))
    return np.unique(RangeHash(hashes).of(at, np.minimum(at + n, len(hashes))))


class _ByteWords(dict):
    """word in bytes -> hash; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= WORD_HASHES.LIMIT:
            self.clear()
        value = self[word] = WORD_HASHES.hash(word)
        return value


_WORDS = _ByteWords()
MEMOS.append(_WORDS.clear)


def _group_sets(texts: list[str | None], n: int, buckets: int):
    """The sets of a group's documents; its distinct shingles, their counts, and their order by bucket."""
    sets = [shingle_set(t, n) for t in texts]
    every = np.concatenate(sets) if sets else np.empty(0, np.uint64)
    tokens, inverse, counts = np.unique(every, return_inverse=True, return_counts=True)
    bucket = ((tokens >> np.uint64(40)) % np.uint64(buckets)).astype(np.int32)
    return sets, tokens, inverse, counts, bucket, np.argsort(bucket, kind="stable")


def classes_of(size: int, percent: int, parts: int) -> list[int]:
    """The numbers of classes of sets with this size or with one that may match it; 0: no pairs."""
    of = lambda n: min(parts, 1 << (n // 4).bit_length() - 1) if n >= 4 else 0
    least, most = of(-(-percent * size // 100)), of(100 * size // percent)
    found = [least]
    while found[-1] < most:
        found.append(max(1, 2 * found[-1]))
    return found


def signatures(tokens: np.ndarray, df: np.ndarray, misses: int, frequent: int, classes: list[int]) -> np.ndarray:
    """The index keys of one set: of its prefixes, shingles that more than one document has, alone or in pairs."""
    order = np.lexsort((tokens, df))[: misses + 1 + max(classes)]
    found = []
    for parts in classes:
        head = order[: misses + 1 + parts]
        common = df[head] > (frequent if parts else 255)
        part = (mix(tokens[head]) % np.uint64(max(1, parts))).astype(np.int64)
        gain = np.ones(len(head), np.int64)
        often = np.flatnonzero(common)
        gain[often[np.unique(part[often], return_index=True)[1]]] = 0  # the first of a class links nothing yet
        length = int(np.searchsorted(np.cumsum(gain), misses + 1)) + 1
        head, common, part = head[:length], common[:length], part[:length]
        rare = head[~common]
        found.append(mix(tokens[rare[df[rare] > 1]]))
        for own in np.unique(part[common]).tolist():
            same = np.sort(tokens[head[common & (part == own)]])
            i, j = np.triu_indices(len(same), 1)
            found.append(mix(same[i] * np.uint64(0x9E3779B97F4A7C15) ^ mix(same[j])))
    return np.unique(np.concatenate(found))


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64), pa.int64())


def _bitmaps(column: pa.ChunkedArray, width: int = _BITS // 64) -> np.ndarray:
    """A row of numbers for each bitmap, without an object for each."""
    parts = [c.cast(pa.binary(8 * width)) for c in column.chunks if len(c)]
    rows = [np.frombuffer(c.buffers()[1], np.uint64).reshape(-1, width)[c.offset : c.offset + len(c)] for c in parts]
    return np.concatenate(rows) if rows else np.empty((0, width), np.uint64)


def parities(tokens: np.ndarray, bits: int) -> bytes:
    """A bit for each residue of hashes modulo bits: is the number of the set's hashes there odd?"""
    return np.packbits((np.bincount((tokens % np.uint64(bits)).astype(np.int64), minlength=bits) & 1).astype(np.uint8)).tobytes()


def wide_bits(size: int) -> int:
    """The bits of a bitmap that a set of this size doesn't fill: a power of two, at least _BITS."""
    return max(_BITS, 1 << (size - 1).bit_length())


def _by_wide(pairs: np.ndarray, size: np.ndarray, wide: pa.ChunkedArray, percent: int) -> np.ndarray:
    """The pairs (node, node, row, row; once each) that bitmaps of the width of the lesser of two sets don't rule out.

    A bitmap of half the width is one half XOR the other, so bitmaps of any two widths can be compared.
    """
    if not len(pairs):
        return np.empty((0, 2), np.int64)
    pairs = pairs[np.unique(pairs[:, :2], axis=0, return_index=True)[1]]
    a, b = pairs[:, 2], pairs[:, 3]
    width = pc.fill_null(pc.binary_length(wide), 0).to_numpy() // 8  # 0: _BITS are wide enough, or no wider ones are there
    level, keep = np.minimum(width[a], width[b]), np.ones(len(pairs), bool)
    for words in np.unique(level[level > _BITS // 64]).tolist():
        of = np.flatnonzero(level == words)
        for some in np.array_split(of, -(-len(of) * words // 4_000_000)):  # 32 MB of bitmaps at a time
            rows, at = np.unique(pairs[some, 2:], return_inverse=True)
            maps = np.empty((len(rows), words), np.uint64)
            for k, row in enumerate(rows.tolist()):
                own = np.frombuffer(wide[row].as_py(), np.uint64)
                while len(own) > words:
                    own = own[: len(own) // 2] ^ own[len(own) // 2 :]
                maps[k] = own
            at = at.reshape(-1, 2)
            apart = np.bitwise_count(maps[at[:, 0]] ^ maps[at[:, 1]]).sum(axis=1, dtype=np.int64)
            keep[some] = apart * (100 + percent) <= (100 - percent) * (size[a[some]] + size[b[some]])
    return pairs[keep, :2]


def _rows_of(node: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.stack([np.minimum(node[a], node[b]), np.maximum(node[a], node[b]), a, b], 1)


def _candidates(low: int, high: int, all_up_to: int, percent: int):
    """Pairs of each index group with a centre of rank low..high-1, in different components, not ruled out."""

    def of(table: pa.Table) -> pa.Table:
        begin_task()
        sig, node, component, size, own = (table.column(c).to_numpy() for c in ("sig", "node", "component", "n", "own"))
        bitmap = _bitmaps(table.column("bitmap"))
        order = np.lexsort((node, own, sig))
        sig, node, component, size, bitmap = sig[order], node[order], component[order], size[order], bitmap[order]
        wide = table.column("wide").take(pa.array(order))
        first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
        end = np.append(first[1:], len(sig))
        mixed = np.minimum.reduceat(component, first) != np.maximum.reduceat(component, first)
        first, end = first[mixed], end[mixed]
        found, more = [], False
        rank = low
        while len(first):
            alive = first + rank + 1 < end
            if rank >= high:
                alive &= (end - first <= all_up_to) if not low else False
                more |= bool((first + rank + 1 < end)[~alive].any())
            first, end = first[alive], end[alive]
            if not len(first):
                break
            for some in np.array_split(np.arange(len(first)), max(1, int((end - first).sum()) // 200_000)):
                left = (end - first - rank - 1)[some]
                a = np.repeat(first[some] + rank, left)
                b = a + 1 + np.arange(len(a)) - np.repeat(np.cumsum(left) - left, left)
                keep = component[a] != component[b]
                keep &= 100 * np.minimum(size[a], size[b]) >= percent * np.maximum(size[a], size[b])
                a, b = a[keep], b[keep]
                apart = np.bitwise_count(bitmap[a] ^ bitmap[b]).sum(axis=1, dtype=np.int64)
                keep = apart * (100 + percent) <= (100 - percent) * (size[a] + size[b])
                rows = _rows_of(node, a[keep], b[keep])
                found.append(rows[np.unique(rows[:, :2], axis=0, return_index=True)[1]])
            rank += 1
        pairs = _by_wide(np.concatenate(found), size, wide, percent) if found else np.empty((0, 2), np.int64)
        out = pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "more": pa.array(np.zeros(len(pairs), bool))})
        if more:
            out = pa.concat_tables([out, pa.table({"a": pa.array([0], pa.int64()), "b": pa.array([0], pa.int64()), "more": [True]})])
        return out

    return of


def _across(percent: int):
    """Pairs of one unit of a split key, in different components, not ruled out: of side 0 with side 1, or inside side 2."""

    def of(table: pa.Table) -> pa.Table:
        begin_task()
        side, node, component, size = (table.column(c).to_numpy() for c in ("side", "node", "component", "n"))
        bitmap = _bitmaps(table.column("bitmap"))
        found = []
        for lefts, rights in ((np.flatnonzero(side == 0), np.flatnonzero(side == 1)), (np.flatnonzero(side == 2),) * 2):
            for k, a in enumerate(lefts.tolist()):
                b = rights if rights is not lefts else lefts[k + 1 :]
                b = b[(component[b] != component[a]) & (100 * np.minimum(size[b], size[a]) >= percent * np.maximum(size[b], size[a]))]
                apart = np.bitwise_count(bitmap[b] ^ bitmap[a]).sum(axis=1, dtype=np.int64)
                b = b[apart * (100 + percent) <= (100 - percent) * (size[b] + size[a])]
                found.append(_rows_of(node, np.full(len(b), a), b))
        pairs = _by_wide(np.concatenate(found), size, table.column("wide"), percent) if found else np.empty((0, 2), np.int64)
        return pa.table({"a": pa.array(pairs[:, 0]), "b": pa.array(pairs[:, 1]), "more": pa.array(np.zeros(len(pairs), bool))})

    return of


def _with_centres(members: DataFrame, low: int, high: int, percent: int) -> DataFrame:
    """Candidates of split keys: each block of members with the key's centres of rank low to high - 1."""
    rank = F.row_number().over(Window.partitionBy("sig").orderBy("own", "node"))
    centres = members.withColumn("rank", rank).filter(F.col("rank") <= high).filter(F.col("rank") > low)  # taken from a few of each task
    columns = ["sig", "block", "side", "node", "component", "n", "bitmap", "wide"]
    blocks = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block")
    units = members.withColumn("side", F.lit(1)).select(columns).union(centres.select("sig", blocks, F.lit(0).alias("side"), *columns[3:]))
    return units.groupBy("sig", "block").applyInArrow(_across(percent), _PAIRS)


def _between_blocks(members: DataFrame, most: int, percent: int) -> DataFrame:
    """Candidates of split keys: all pairs of members in different components, by pairs of blocks."""
    parts = members.groupBy("sig", "component").agg(F.count("*").alias("n"))
    parts = parts.groupBy("sig").agg(F.max_by("component", F.struct("n", "component")).alias("main"), F.max("n").alias("n_main"), (F.sum("n") - F.max("n")).alias("n_rest")).filter("n_rest > 0")
    count = lambda c: F.ceil(F.col(c) / most).cast("int")
    rows = members.join(parts.select("sig", "main", count("n_main").alias("mains"), count("n_rest").alias("rests")), "sig")
    rows = rows.withColumn("is_main", F.col("component") == F.col("main")).withColumn("block", F.pmod(F.xxhash64("node"), F.when(F.col("is_main"), F.col("mains")).otherwise(F.col("rests"))).cast("int"))
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    unit = lambda kind, i, j, side: F.struct(F.lit(kind).alias("kind"), i.alias("i"), j.alias("j"), side.cast("int").alias("side"))
    own = F.col("block")
    with_main = F.transform(each("mains"), lambda k: unit(1, own, k, F.lit(0)))
    with_rest = F.transform(each("rests"), lambda k: unit(0, F.least(own, k), F.greatest(own, k), F.when(own == k, 2).when(own < k, 0).otherwise(1)))
    of_main = F.transform(each("rests"), lambda k: unit(1, k, own, F.lit(1)))
    units = rows.select("sig", "node", "component", "n", "bitmap", "wide", F.explode(F.when(F.col("is_main"), of_main).otherwise(F.concat(with_main, with_rest))).alias("u"))
    units = units.select("sig", "u.*", "node", "component", "n", "bitmap", "wide")
    return units.groupBy("sig", "kind", "i", "j").applyInArrow(_across(percent), _PAIRS)


def _verified(percent: int):
    @F.arrow_udf("boolean")
    def similar(left: pa.Array, right: pa.Array) -> pa.Array:
        begin_task()
        out = []
        for a, b in zip(left.to_pylist(), right.to_pylist()):
            x, y = np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64)
            both = len(np.intersect1d(x, y, assume_unique=True))
            out.append(100 * both >= percent * (len(x) + len(y) - both))
        return pa.array(out, pa.bool_())

    return similar


def similarity_components(
    docs: DataFrame,
    n: int = 4,
    percent: int = 85,
    id_col: str = "doc_id",
    text_col: str = "text",
    frequent: int = 100,
    parts: int = 64,
    most: int = 4096,
    group_bytes: int = 8_000_000,
) -> DataFrame:
    """doc_id, n_shingles and component_id, the least doc_id reachable over links of similarity >= percent / 100."""
    if not 0 < frequent <= 254:
        raise ValueError("frequent must be 1 to 254: shingles are counted up to 255")
    if most < 16 or parts < 1 or parts & (parts - 1):
        raise ValueError("most must be 16 or more, parts a power of two")
    for k in range(parts.bit_length()):  # the least set with 2**k classes must fill its prefix
        if 100 * 2**k >= percent * -(-percent * 4 * 2**k // 100):
            raise ValueError("percent is too low for prefixes of token combinations")
    work = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    _, groups = groups_for(work, group_bytes)
    buckets = max(16, groups // 2)
    work = work.withColumn("group", F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int"))

    def count(table: pa.Table) -> pa.Table:
        begin_task()
        group = table.column("group")[0].as_py()
        _, tokens, _, counts, bucket, order = _group_sets(table.column("text").to_pylist(), n, buckets)
        low, docs_n, bucket = tokens[order].astype(np.uint32), np.minimum(counts[order], 255).astype(np.uint8), bucket[order]
        cuts = np.append(np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])), len(bucket)) if len(bucket) else np.zeros(1, np.int64)
        spans = list(zip(cuts[:-1].tolist(), cuts[1:].tolist()))
        return pa.table(
            {
                "bucket": pa.array([int(bucket[a]) for a, _ in spans], pa.int32()),
                "group": pa.array([group] * len(spans), pa.int32()),
                "low": pa.array([low[a:b].tobytes() for a, b in spans], pa.binary()),
                "docs": pa.array([docs_n[a:b].tobytes() for a, b in spans], pa.binary()),
            }
        )

    def code(table: pa.Table) -> pa.Table:
        """How many documents have each shingle of a bucket, up to 255, given back in the order sent."""
        begin_task()
        blobs = table.column("low").to_pylist()
        low = np.frombuffer(b"".join(blobs), np.uint32)
        docs_n = np.frombuffer(b"".join(table.column("docs").to_pylist()), np.uint8)
        order = np.argsort(low, kind="stable")
        ranked = low[order]
        first = np.flatnonzero(np.concatenate([[True], ranked[1:] != ranked[:-1]]))
        total = np.minimum(np.add.reduceat(docs_n[order].astype(np.int64), first), 255).astype(np.uint8)
        codes = np.empty(len(low), np.uint8)
        codes[order] = np.repeat(total, np.diff(np.append(first, len(low))))
        ends = np.cumsum([len(b) // 4 for b in blobs])
        return pa.table({"group": table.column("group"), "bucket": table.column("bucket"), "codes": pa.array([c.tobytes() for c in np.split(codes, ends[:-1])], pa.binary())})

    def index(mine: pa.Table, coded: pa.Table) -> pa.Table:
        """The nodes of a group's documents; of those with index keys, keys and sets."""
        begin_task()
        rows: dict[str, list] = {c: [] for c in ("kind", "doc_id", "n", "node", "sig", "own", "tokens", "bitmap", "wide")}

        def add(kind, many=1, **values):
            rows["kind"].append(np.full(many, kind))
            for c in ("doc_id", "n", "node", "sig", "own"):
                rows[c].append(np.broadcast_to(values.get(c, 0), many))
            for c in ("tokens", "bitmap", "wide"):
                rows[c] += [values.get(c)] * many

        if mine.num_rows:
            sets, tokens, inverse, _, _, order = _group_sets(mine.column("text").to_pylist(), n, buckets)
            coded = coded.sort_by("bucket")
            codes = np.empty(len(tokens), np.uint8)
            codes[order] = np.frombuffer(b"".join(coded.column("codes").to_pylist()), np.uint8)
            df = codes[inverse]
            done, at = set(), 0
            for doc_id, own in zip(mine.column("doc_id").to_pylist(), sets):
                size = len(own)
                mine_df = df[at : at + size]
                at += size
                if not size:
                    add(0, doc_id=doc_id)
                    continue
                node = int(mix(np.bitwise_xor.reduce(mix(own))[None] + np.add.reduce(mix(own ^ np.uint64(0xA5A5A5A5)), dtype=np.uint64) + np.uint64(size)).view(np.int64)[0])
                add(0, doc_id=doc_id, n=size, node=node)
                alone = int((mine_df == 1).sum())
                misses = size - (percent * size + 99) // 100
                if alone > misses or node in done:
                    continue
                done.add(node)
                keys = signatures(own, mine_df, misses, frequent, classes_of(size, percent, parts))
                if len(keys):
                    bits = wide_bits(size)
                    add(1, len(keys), node=node, sig=keys.view(np.int64))
                    add(2, node=node, n=size, own=alone, tokens=own.tobytes(), bitmap=parities(own, _BITS), wide=parities(own, bits) if bits > _BITS else None)
        kinds = {"kind": pa.int32(), "own": pa.int32(), "tokens": pa.binary(), "bitmap": pa.binary(), "wide": pa.binary()}
        return pa.table(
            {c: pa.array(v if c in ("tokens", "bitmap", "wide") else (np.concatenate(v) if v else np.empty(0, np.int64)), kinds.get(c, pa.int64())) for c, v in rows.items()}
        )

    codes = work.groupBy("group").applyInArrow(count, _SEEN).groupBy("bucket").applyInArrow(code, _CODES)
    parts_table = stored(work.groupBy("group").cogroup(codes.groupBy("group")).applyInArrow(index, _PARTS), "index")
    nodes = parts_table.filter("kind = 2").select("node", "n", "own", "tokens", "bitmap", "wide").dropDuplicates(["node"])
    nodes = stored(nodes, "nodes")
    keys = parts_table.filter("kind = 1").select("sig", "node").distinct()
    labels = _linked(keys, nodes, percent, max(1, groups), most)
    members = parts_table.filter("kind = 0").select("doc_id", "n", "node")
    members = members.join(labels, "node", "left").select(
        "doc_id", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("root")
    )
    # only groups of several documents; a table of its own, so that Spark can split a hot group's side of the join
    least = members.filter("n > 0").groupBy("root").agg(F.min("doc_id").alias("least"), F.count("*").alias("many")).filter("many > 1")
    out = members.join(stored(least.drop("many"), "groups"), "root", "left")
    restored = lambda c: F.nullif(c, F.lit(_NO_ID))
    return out.select(restored(F.col("doc_id")).alias("doc_id"), F.col("n").alias("n_shingles"), restored(F.coalesce("least", "doc_id")).alias("component_id"))


def _distinct_groups(keys: DataFrame) -> DataFrame:
    """sig and many, its number of members: one index key for each set of members, as keys of the same members give the same pairs.

    Copies share most of their keys, so without this a pair would be found once for each. Sets are compared by their
    size and 128 bits of hash; a key with one member has no pair.
    """
    members = (F.bit_xor(F.xxhash64(F.lit(k), "node")).alias(f"members{k}") for k in range(2))
    each = keys.groupBy("sig").agg(F.count("*").alias("many"), *members).filter("many > 1")
    return each.groupBy("many", "members0", "members1").agg(F.min("sig").alias("sig")).select("sig", "many")


def _linked(keys: DataFrame, nodes: DataFrame, percent: int, buckets: int, most: int) -> DataFrame:
    """(node, component) of the nodes that link with another."""
    similar = _verified(percent)
    sets = nodes.select("node", "tokens")
    ranked = nodes.select("node", "n", "own", "bitmap", F.col("wide") if "wide" in nodes.columns else F.lit(None).cast("binary").alias("wide"))
    chosen = stored(_distinct_groups(keys), "chosen-keys")
    keys = stored(keys.join(chosen.select("sig"), "sig", "left_semi"), "keys")
    hot = stored(chosen.filter(F.col("many") > most), "hot-keys")
    split = bool(hot.limit(1).count())
    members = None
    if split:
        blocks = F.ceil(F.col("many") / most).cast("int")
        members = keys.join(hot, "sig").join(ranked, "node").withColumn("blocks", blocks)
        members = stored(members.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")).drop("many"), "hot-members")
        keys = keys.join(hot, "sig", "left_anti")
    labels = None
    low, high, more = 0, 1, True
    while more or split:
        named = lambda rows: rows.join(labels, "node", "left").withColumn("component", F.coalesce("component", "node")) if labels is not None else rows.withColumn("component", F.col("node"))  # noqa: E731, B023
        found = []
        if more:
            view = named(keys.join(ranked, "node")).withColumn("bucket", F.pmod("sig", F.lit(buckets)))
            found.append(view.groupBy("bucket").applyInArrow(_candidates(low, high, 6, percent), _PAIRS))
        if split:
            found.append(_with_centres(named(members), low, high, percent) if high <= 16 else _between_blocks(named(members), most, percent))
            split = high <= 16
        found = stored(found[0].union(found[-1]) if len(found) > 1 else found[0], "pairs")
        more = found.filter("more").limit(1).count() > 0
        pairs = found.filter("not more").select("a", "b").distinct()
        checked = pairs.join(sets.toDF("a", "left_set"), "a").join(sets.toDF("b", "right_set"), "b")
        edges = stored(checked.filter(similar("left_set", "right_set")).select("a", "b"), "links")
        labels = components(edges) if labels is None else _joined(labels, edges)
        low, high = high, high * 16
    return labels


def _joined(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """labels after the components that edges link become one."""
    root = labels.select("node", F.col("component").alias("root"))
    named = lambda df, c: df.join(root, df[c] == root["node"], "left").select(*[x for x in df.columns if x != c], F.coalesce("root", c).alias(c))
    joined = components(named(named(edges, "a"), "b")).toDF("root", "joined")
    both = edges.select(F.explode(F.array("a", "b")).alias("node")).union(labels.select("node")).distinct()
    both = both.join(labels, "node", "left").select("node", F.coalesce("component", "node").alias("root"))
    return stored(both.join(joined, "root", "left").select("node", F.coalesce("joined", "root").alias("component")), "labels")
