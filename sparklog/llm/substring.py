"""Removal of repeated word passages by prefix-partitioned suffix trees.

Every word position of a document starts a suffix; a window of `window` words that occurs before is a node of
depth >= window in the suffix tree over all documents. The tree is never built whole: suffixes are split by
prefixes of growing length into groups that fit in memory, and a group whose prefix shows that it holds no
further branching is closed.

* Level 1. The short prefix is a phrase of `prefix` words. Of the phrases in a window the one of least hash
  (leftmost of equals) stands for it, so equal windows are found under equal phrases, and one suffix in about
  seven is kept: a run of neighbouring windows under one phrase. Runs are grouped by a range of the phrase's
  hash. A phrase with one suffix is a leaf and goes. Where all suffixes of a phrase have the same whole run,
  all but the first are repeats. Where runs differ, the tree branches inside: one suffix of each distinct run
  goes on to level 2.
* Level 2. Those suffixes are extended to the full window and grouped by a range of the window's hash: in each
  group, equal windows are a deep internal node's leaves; all but the first are repeats.

Groups are ranges of hashes, as many as the input has parts of `group_bytes` text, dealt to as many tasks. A
batch sends one place for each distinct run or window it saw; the places that repeat one of the same batch are
settled, and travel with the group that a hash of the batch names, whatever they repeat. So a passage in a
third of all documents adds no more places to a group than there are batches, and its copies are spread over
all groups. Windows are compared by 128 bits: two 64-bit hashes of the same 64-bit hashes of words, so two
different words of one hash (a chance of 3 in 10^8 among 10^6 words, 3 in 10^4 among 10^8) make windows equal.

This is a prefix tree cut at two depths, not one with nodes of every length: contracts here ask for repeats of a
fixed window, so the tree's deeper nodes are told apart by whole runs, and maximal repeats come out as unions of
windows.

Defined results: null and empty texts have no words; fewer words than the window: nothing removed; a null id
sorts before all others; rows that repeat an id are held for one document, whose positions count once; of equal
windows the one of the least id and place stays, so there are no ties; a text of any length is cut whole; other
columns are read only where `keep` names them; an empty table gives an empty table.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import WORD_HASHES, RangeHash, begin_task, groups_for, mix, stored, words_of

_WORD = re.compile("[^\x20\x09-\x0d]+")

#: Characters of text that a task holds as numbers at a time.
_SLICE_CHARS = 4_000_000

#: Settled places in one row of a batch's.
_SETTLED = 20_000

#: Stands for a null id: before all others.
_NO_ID = -(1 << 63)

_BLOBS = "bucket int, local boolean, key binary, run binary, doc binary, start binary, n binary"
_FOUND = "doc_id long, ask boolean, start int, n int"


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[pa.RecordBatch, list[str | None]]]:
    """Parts of a batch of about _SLICE_CHARS characters each, with their texts."""
    size = batch.column("text").cast(pa.large_string()) if batch.num_rows else None
    if size is None:
        return
    ends = np.cumsum(np.nan_to_num(pc.binary_length(size).to_numpy(zero_copy_only=False).astype(np.float64)))
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(ends, base + _SLICE_CHARS, "right")))
        part = batch.slice(at, end - at)
        yield part, part.column("text").to_pylist()
        at = end


def _hashed(texts: Sequence[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The word hashes of the texts in a row, and how many words each has."""
    parts = [WORD_HASHES.of(words_of(t)) if t else np.empty(0, np.uint64) for t in texts]
    return (np.concatenate(parts) if parts else np.empty(0, np.uint64)), np.fromiter(map(len, parts), np.int64, count=len(parts))


def window_runs(words: np.ndarray, lengths: np.ndarray, window: int, prefix: int) -> tuple[np.ndarray, ...]:
    """The runs of windows of each document: document index, first window, windows, phrase hash, run hash."""
    total = len(words)
    none = np.empty(0, np.int64)
    if total < window:
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    ranges = RangeHash(words)
    at = np.arange(total - prefix + 1)
    phrase = ranges.of(at, at + prefix)
    low = np.uint64(0xFFFFFFFF)
    least = (phrase & ~low) | at.astype(np.uint64)
    span, width = window - prefix + 1, 1
    while width * 2 <= span:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if width < span:
        least = np.minimum(least[: len(least) - (span - width)], least[span - width :])
    doc = np.repeat(np.arange(len(lengths)), lengths)
    first = np.flatnonzero(doc[: total - window + 1] == doc[window - 1 :])
    if not len(first):
        return none, none, none, none.astype(np.uint64), none.astype(np.uint64)
    anchor = (least[first] & low).astype(np.int64)
    begins = np.flatnonzero(np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (first[1:] != first[:-1] + 1)]))
    count = np.diff(np.append(begins, len(first)))
    start, anchor = first[begins], anchor[begins]
    run = ranges.of(start, start + count - 1 + window) ^ mix((anchor - start).astype(np.uint64) + np.uint64(1))
    opens = np.concatenate([[0], np.cumsum(lengths)])
    return doc[start], start - opens[doc[start]], count, phrase[anchor], run


def _packed(groups: int, key: np.ndarray, run: np.ndarray, doc: np.ndarray, start: np.ndarray, n: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows for the groups: for each distinct (key, run) its first place; the other places as settled repeats."""
    if not len(key):
        return
    order = np.lexsort((start, doc, run, key))
    key, run, doc, start, n = key[order], run[order], doc[order], start[order], n[order]
    again = np.zeros(len(key), bool)
    again[1:] = (key[1:] == key[:-1]) & (run[1:] == run[:-1])
    new = np.ones(len(key), bool)  # a place comes twice where rows repeat an id
    new[1:] = ~again[1:] | (doc[1:] != doc[:-1]) | (start[1:] != start[:-1])
    key, run, doc, start, n, again = key[new], run[new], doc[new], start[new], n[new], again[new]
    bucket = ((key >> np.uint64(20)) % np.uint64(groups)).astype(np.int32)
    rows: dict[str, list] = {c: [] for c in ("bucket", "local", "key", "run", "doc", "start", "n")}
    own = np.flatnonzero(~again)
    own = own[np.argsort(bucket[own], kind="stable")]
    parts = [(False, part) for part in np.split(own, np.flatnonzero(np.diff(bucket[own])) + 1)]
    settled = np.flatnonzero(again)
    parts += [(True, part) for part in np.array_split(settled, -(-len(settled) // _SETTLED))] if len(settled) else []
    for local, part in parts:
        of_batch = mix(doc[part[:1]].astype(np.uint64) ^ run[part[:1]] ^ np.uint64(len(own))) % np.uint64(groups)
        rows["bucket"].append(int(of_batch[0]) if local else int(bucket[part[0]]))
        rows["local"].append(local)
        rows["key"].append(b"" if local else key[part].tobytes())
        rows["run"].append(b"" if local else run[part].tobytes())
        rows["doc"].append(doc[part].astype(np.int64).tobytes())
        rows["start"].append(start[part].astype(np.int32).tobytes())
        rows["n"].append(n[part].astype(np.uint8).tobytes())
    kinds = (pa.int32(), pa.bool_(), *[pa.binary()] * 5)
    yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))


def _joined(table: pa.Table, column: str, kind: type, rows: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(column).take(pa.array(rows)).to_pylist()), kind)


def _found(doc: np.ndarray, ask: np.ndarray, start: np.ndarray, n: np.ndarray) -> pa.Table:
    return pa.table(
        {"doc_id": pa.array(doc, pa.int64()), "ask": pa.array(ask, pa.bool_()), "start": pa.array(start, pa.int32()), "n": pa.array(n.astype(np.int32))}
    )


def _repeats(table: pa.Table) -> pa.Table:
    """One group: the places after the first of each run, and one place of each run where runs differ."""
    begin_task()
    local = table.column("local").to_numpy()
    sent, settled = np.flatnonzero(~local), np.flatnonzero(local)
    key, run = _joined(table, "key", np.uint64, sent), _joined(table, "run", np.uint64, sent)
    doc, start, n = (_joined(table, c, k, sent) for c, k in (("doc", np.int64), ("start", np.int32), ("n", np.uint8)))
    order = np.lexsort((start, doc, run, key))
    key, run, doc, start, n = key[order], run[order], doc[order], start[order], n[order]
    same_key = np.concatenate([[False], key[1:] == key[:-1]])[: len(key)]
    same_run = np.zeros(len(key), bool)
    same_run[1:] = same_key[1:] & (run[1:] == run[:-1])
    # the same place may come twice, from rows that repeat an id: it isn't earlier than itself
    place = np.zeros(len(key), bool)
    place[1:] = same_run[1:] & (doc[1:] == doc[:-1]) & (start[1:] == start[:-1])
    head = ~same_run
    group = np.cumsum(~same_key) - 1
    branches = np.bincount(group[head], minlength=group[-1] + 1 if len(group) else 0)
    leader = np.maximum.accumulate(np.where(head, np.arange(len(key)), 0)) if len(key) else np.empty(0, np.int64)
    first = (doc == doc[leader]) & (start == start[leader]) if len(key) else same_run
    repeat = same_run & ~first & ~place
    ask = head & (branches[group] > 1)
    own = np.flatnonzero(repeat | ask)
    gone = [_joined(table, c, k, settled) for c, k in (("doc", np.int64), ("start", np.int32), ("n", np.uint8))]
    return pa.concat_tables([_found(doc[own], ask[own], start[own], n[own]), _found(gone[0], np.zeros(len(gone[0]), bool), gone[1], gone[2])])


def repeated_windows(docs: DataFrame, window: int = 20, prefix: int = 8, group_bytes: int = 24_000_000, carry: Sequence[str] = ()) -> DataFrame:
    """(doc_id, start, n): the windows start..start+n-1 of the document also start earlier.

    docs: doc_id long without nulls, text, and the columns of carry. Like drop_repeated, this joins docs with
    what it found by doc_id; with the same columns in both joins, Spark shuffles the texts once for both.
    """
    if not 0 < prefix <= window <= 255:
        raise ValueError("0 < prefix <= window <= 255")
    _, groups = groups_for(docs, group_bytes)

    def ids_of(part: pa.RecordBatch) -> np.ndarray:
        return part.column("doc_id").to_numpy(zero_copy_only=False).astype(np.int64)

    def level1(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for part, texts in _slices(batch):
                doc, start, n, phrase, run = window_runs(*_hashed(texts), window, prefix)
                yield from _packed(groups, phrase, run, ids_of(part)[doc], start, n)

    def level2(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for part, texts in _slices(batch):
                words, lengths = _hashed(texts)
                asked = part.column("asked")
                sizes = asked.value_lengths().to_numpy(zero_copy_only=False)
                flat = asked.flatten()
                opens = np.concatenate([[0], np.cumsum(lengths)])[:-1]
                row = np.repeat(np.arange(len(sizes)), sizes)
                n = flat.field("n").to_numpy(zero_copy_only=False).astype(np.int64)
                start = np.repeat(flat.field("start").to_numpy(zero_copy_only=False).astype(np.int64), n)
                start += np.arange(len(start)) - np.repeat(np.cumsum(n) - n, n)
                row = np.repeat(row, n)
                inside = start + window <= lengths[row]  # else of another row with the same id
                start, row = start[inside], row[inside]
                at = opens[row] + start
                key = RangeHash(words).of(at, at + window)
                run = RangeHash(mix(words ^ np.uint64(0x5851F42D4C957F2D))).of(at, at + window)
                yield from _packed(groups, key, run, ids_of(part)[row], start, np.ones(len(start), np.int64))

    grouped = lambda blobs: blobs.repartition(groups, "bucket").groupBy("bucket").applyInArrow(_repeats, _FOUND)
    runs = grouped(docs.select("doc_id", "text").mapInArrow(level1, _BLOBS))
    runs = stored(runs, "runs")
    asks = runs.filter("ask").groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("asked"))
    windows = docs.join(asks, "doc_id").select("doc_id", "text", *carry, "asked").mapInArrow(level2, _BLOBS)
    return runs.union(grouped(windows)).filter("not ask").select("doc_id", "start", "n")


def _cut(text: str, gone: np.ndarray) -> str:
    """text without the words that are gone and the space after each run of them."""
    starts = [m.start() for m in _WORD.finditer(text)] + [len(text)]
    flips = np.flatnonzero(np.diff(np.concatenate([[True], gone, [True]]).astype(np.int8)))
    return text[: starts[0]] * bool(len(gone) and not gone[0]) + "".join(text[starts[a] : starts[b]] for a, b in zip(flips[::2], flips[1::2]))


def drop_repeated(
    docs: DataFrame, window: int = 20, prefix: int = 8, group_bytes: int = 24_000_000, id_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = (), layout: bool = False
) -> DataFrame:
    """doc_id, the columns of keep, n_words, n_removed and kept_text.

    kept_text is the words left, joined by one space; with layout, the text itself without the removed words
    and the space after each run of them (null stays null).
    """
    carry = [f"_keep{i}" for i in range(len(keep))]
    work = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.col(text_col).cast("string").alias("text"), *[F.col(k).alias(c) for k, c in zip(keep, carry)])
    gone = repeated_windows(work, window, prefix, group_bytes, carry).groupBy("doc_id").agg(F.collect_list(F.struct("start", "n")).alias("gone"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        for batch in batches:
            for part, texts in _slices(batch):
                kept, words_n, removed_n = [], [], []
                for text, ranges in zip(texts, part.column("gone").to_pylist()):
                    words = words_of(text) if text else []
                    left = words
                    if ranges:
                        edge = np.zeros(len(words) + 1, np.int64)
                        start = np.asarray([r["start"] for r in ranges])
                        end = start + np.asarray([r["n"] for r in ranges]) + window - 1
                        inside = end <= len(words)  # else of another row with the same id
                        np.add.at(edge, start[inside], 1)
                        np.add.at(edge, end[inside], -1)
                        left = [w for w, covers in zip(words, np.cumsum(edge)[:-1].tolist()) if not covers]
                    kept.append(" ".join(left) if not layout else text if len(left) == len(words) else _cut(text, np.cumsum(edge)[:-1] > 0))
                    words_n.append(len(words))
                    removed_n.append(len(words) - len(left))
                own = [part.column(c) for c in ("doc_id", *carry)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(words_n, pa.int64()), pa.array(removed_n, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", *carry, "n_words", "n_removed", "kept_text"])

    kinds = "".join(f"{c} {work.schema[c].dataType.simpleString()}, " for c in carry)
    joined = work.join(gone, "doc_id", "left").select("doc_id", "text", *carry, "gone")
    out = joined.mapInArrow(cut, f"doc_id long, {kinds}n_words long, n_removed long, kept_text string")
    return out.withColumn("doc_id", F.nullif("doc_id", F.lit(_NO_ID))).withColumnsRenamed(dict(zip(carry, keep)))
