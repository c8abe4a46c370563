"""Token counts of fields and sections from one encoding of the whole document.

A document is encoded once; each token has a character span, from the byte lengths of its ids. The spans are
interval-joined to the sections by binary search. A token that crosses a section's boundary is allocated by
a rule: `first` (to the section that holds its first character), `last`, `largest` (the section that holds
most of its characters, the earlier on a tie). A byte token of a character's second or later byte counts as
standing on that character. So the counts of a document's sections always add up to its tokens.

Defined results: null and empty texts have one empty section with no tokens; sections must be in order,
without gaps or overlaps; a tie of `largest` goes to the earlier section; equal texts, so repeated rows, have equal
counts; a text of any length is encoded whole; other columns, whatever their names, are not read; an empty table
gives an empty table.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.bpe import BytePairEncoder, encoder_of
from sparklog.llm.shared import keyed_text

RULES = ("first", "last", "largest")


def line_starts(text: str) -> list[int]:
    """The starts of a text's lines; a line end belongs to the line that it ends."""
    starts, at = [0], text.find("\n") + 1
    while 0 < at < len(text):
        starts.append(at)
        at = text.find("\n", at) + 1
    return starts


def token_spans(encoder: BytePairEncoder, ids: np.ndarray, text: str) -> tuple[np.ndarray, np.ndarray]:
    """The first character of each token, and the last (inclusive)."""
    ends = np.cumsum(encoder.lengths[ids])
    if text.isascii():
        return ends - encoder.lengths[ids], ends - 1
    data = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    char = np.cumsum((data & 0xC0) != 0x80) - 1  # of each byte
    return char[ends - encoder.lengths[ids]], char[ends - 1]


def allocate(first: np.ndarray, last: np.ndarray, starts: np.ndarray, total: int, rule: str) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each section, and how many of the tokens that touch it cross one of its boundaries."""
    begin = np.searchsorted(starts, first, "right") - 1
    end = np.searchsorted(starts, last, "right") - 1
    owner = begin if rule == "first" else end
    crosses = np.flatnonzero(begin != end)
    if rule == "largest" and len(crosses):
        owner = begin.copy()
        stops = np.append(starts[1:], total)
        for k in crosses.tolist():  # few: a token has few characters
            own = np.arange(begin[k], end[k] + 1)
            share = np.minimum(stops[own], last[k] + 1) - np.maximum(starts[own], first[k])
            owner[k] = own[share.argmax()]
    crossing = np.zeros(len(starts) + 1, np.int64)
    np.add.at(crossing, begin[crosses], 1)
    np.add.at(crossing, end[crosses] + 1, -1)
    return np.bincount(owner, minlength=len(starts)), np.cumsum(crossing)[:-1]


_COUNTS = "section int, start int, end int, n_tokens long, n_crossing long"


def section_counts(docs: DataFrame, ranks: str, rule: str = "first", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per line of each document: doc_id, section, start, end (code points), n_tokens, n_crossing."""
    source = keyed_text(docs, id_col, text_col)
    return _counted(source, ranks, rule, lambda text: line_starts(text))


def field_counts(table: DataFrame, id_col: str, fields: Sequence[str], ranks: str, rule: str = "first", separator: str = "\n") -> DataFrame:
    """As section_counts, for the fields of a row joined by a separator (which belongs to the field before it)."""
    texts = [F.coalesce(F.col(f).cast("string"), F.lit("")) for f in fields]
    source = table.select(F.col(id_col).alias("doc_id"), F.concat_ws(separator, *texts).alias("text"), F.array(*map(F.char_length, texts)).alias("sizes"))
    return _counted(source, ranks, rule, None, len(separator))


def _counted(source: DataFrame, ranks: str, rule: str, cut, separator: int = 0) -> DataFrame:
    if rule not in RULES:
        raise ValueError(f"rule must be one of {RULES}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(ranks)
        for batch in batches:
            for low in range(0, batch.num_rows, 500):
                part = batch.slice(low, 500)
                columns: list[list[np.ndarray]] = [[] for _ in range(5)]
                many = []
                texts = [text or "" for text in part.column("text").to_pylist()]
                for k, (text, coded) in enumerate(zip(texts, encoder.encode_texts(texts))):
                    if cut:
                        starts = np.asarray(cut(text), np.int64)
                    else:
                        sizes = np.asarray(part.column("sizes")[k].as_py(), np.int64) + separator
                        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
                    ids = np.frombuffer(coded, np.int32)
                    counts, crossing = allocate(*token_spans(encoder, ids, text), starts, len(text), rule) if len(ids) else (np.zeros(len(starts), np.int64),) * 2
                    ends = np.append(starts[1:], len(text))
                    for column, values in zip(columns, (np.arange(len(starts)), starts, ends, counts, crossing)):
                        column.append(values)
                    many.append(len(starts))
                doc = part.column("doc_id").take(pa.array(np.repeat(np.arange(part.num_rows), many)))
                kinds = (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.int64())
                arrays = [pa.array(np.concatenate(c), k) for c, k in zip(columns, kinds)]
                yield pa.RecordBatch.from_arrays([doc, *arrays], names=["doc_id", "section", "start", "end", "n_tokens", "n_crossing"])

    return source.mapInArrow(run, f"doc_id {source.schema['doc_id'].dataType.simpleString()}, {_COUNTS}")
