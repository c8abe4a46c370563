"""Packing by power-of-two decomposition.

A document's ids, closed by an end id, are cut by the binary digits of their number: as many pieces of
max_len as fit, then one piece for each set bit of the rest, longest first. Every piece is a sequence of its
own whose length is a power of two, so no sequence crosses documents and none needs padding; pieces of equal
length share a bucket, from which batches of one shape are drawn.

Defined results: null and empty texts have just the end id; repeated rows are packed once each, in sequences of
their own; a text of any length is cut whole, with no id left out; there is one way to cut, so no ties; other
columns of the input, whatever their names, are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparklog.llm.shared import MEMOS, begin_task, keyed_text

#: Letters of Latin-1 and the marks behind them (but '), each a pre-token.
_PLAIN = r"\A(?P<letters>[A-Za-z\x{c0}-\x{d6}\x{d8}-\x{f6}\x{f8}-\x{ff}]+)(?P<marks>[!-&(-/:-@\[-`{-~]*)\z"
#: Latin-1 characters as byte-level vocabularies write the bytes that they stand for. Printable bytes are
#: themselves, the others count up from 256.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_BYTE_LEVEL = dict(zip([b for b in range(256) if b not in _VISIBLE], map(chr, range(256, 512))))
#: Where str.split() cuts and the vocabulary's normalizer sees no white space.
_EXTRA_SPACE = r"[\x1c-\x1f]"
#: Longer words are not memoised.
_LONG = 64


class ChunkTokenizer:
    """A tokenizer of white-space separated chunks, with a memo of their parts, whose ids are bytes of 32-bit numbers.

    A tokenizer that drops white space before it merges never merges across it, so a text's ids are its chunks'
    ids in a row. Where it also lower-cases, cuts marks from letters and merges bytes, a chunk of Latin-1
    letters with marks behind them needs no normalizer: the model merges its lower-case letters, and its marks
    are a chunk of their own. Texts with the string of an added token, and all texts of other tokenizers, are
    encoded whole. The memo is bounded: when full it becomes the older half, whose entries return as they are
    used.
    """

    CACHED = 400_000

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = "|".join([_EXTRA_SPACE, *added])
        self.by_chunks = drops_white_space(json.loads(self.tokenizer.to_str()))

    def encode(self, text: str) -> bytes:
        return array("i", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _coded(self, words: list[str], letters: int) -> list[bytes]:
        """The ids of each of different words, the first so many of which are lower-case letters."""
        memo, older = self.memo, self.older
        out = list(map(memo.get, words))
        merge = self.tokenizer.model.tokenize
        new = [k for k, ids in enumerate(out) if ids is None]
        for k in new:
            ids = older.get(words[k])
            out[k] = ids if ids is not None else _merged(merge, words[k]) if k < letters else self.encode(words[k])
        if len(memo) + len(new) > self.CACHED:
            self.older, self.memo = memo, {}
        self.memo.update(islice(((words[k], out[k]) for k in new if len(words[k]) <= _LONG), self.CACHED))
        return out

    def encode_texts(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text; null: none.

        Arrow cuts the texts and tells chunks and their parts apart, so Python sees each part once, however often it
        occurs in the array.
        """
        odd = pc.match_substring_regex(texts, self.odd, ignore_case=True) if self.by_chunks else pc.greater(pc.binary_length(texts), 0)
        odd = pc.fill_null(odd, False)
        cut = pc.utf8_split_whitespace(texts.filter(pc.invert(odd)))  # by filter, as if_else fails on slices
        chunks = pc.dictionary_encode(cut.flatten())
        found = pc.extract_regex(chunks.dictionary, _PLAIN)
        plain = found.is_valid()
        letters, marks = found.filter(plain).flatten()
        words = pc.dictionary_encode(pa.concat_arrays([pc.utf8_lower(letters), marks, chunks.dictionary.filter(pc.invert(plain))]))
        number = words.indices.to_numpy()
        coded = self._coded(_strings(words.dictionary), int(number[: len(letters)].max(initial=-1)) + 1)
        size = np.fromiter(map(len, coded), np.int64, count=len(coded)) // 4
        plain = plain.to_numpy(zero_copy_only=False)
        parts = np.zeros((len(plain), 2), np.int64)  # of each chunk; other chunks are a part followed by nothing
        parts[plain, 0], parts[plain, 1], parts[~plain, 0] = np.split(number, [len(letters), 2 * len(letters)])
        parts[~plain, 1] = len(size)
        first, size = np.append(np.cumsum(size) - size, 0), np.append(size, 0)
        parts = parts[chunks.indices.to_numpy()].ravel()
        ends = np.concatenate([[0], np.cumsum(size[parts])])
        at = np.arange(ends[-1], dtype=np.int32) + np.repeat((first[parts] - ends[:-1]).astype(np.int32), size[parts])
        ids = np.frombuffer(b"".join(coded), np.int32)[at].tobytes()
        last = 2 * np.cumsum(pc.fill_null(cut.value_lengths(), 0).to_numpy())
        cuts = [0, *(4 * ends[last]).tolist()]
        each = map(ids.__getitem__, map(slice, cuts, cuts[1:]))
        return [self.encode(texts[k].as_py()) if whole else next(each) for k, whole in enumerate(odd.to_pylist())]


def _strings(words: pa.Array) -> list[str]:
    """The words, which hold no white space, as Python strings, made of one, which takes less time than one by one."""
    if not len(words):
        return []
    return pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(words)], pa.int32()), words.cast(pa.string())), "\n")[0].as_py().split("\n")


def _merged(merge, letters: str) -> bytes:
    """The ids of lower-case letters by the model alone."""
    if not letters.isascii():
        letters = letters.encode().decode("latin-1").translate(_BYTE_LEVEL)
    return array("i", [token.id for token in merge(letters)]).tobytes()


def drops_white_space(tokenizer: dict) -> bool:
    """Whether a tokenizer's file says that it lower-cases, drops white space, cuts marks from letters, and merges bytes."""
    normalizer, cutter = tokenizer.get("normalizer") or {}, tokenizer.get("pre_tokenizer") or {}
    steps = {n["type"] for n in normalizer.get("normalizers", [normalizer] if normalizer else [])}
    cuts = cutter.get("pretokenizers", [cutter] if cutter else [])
    first = cuts[0] if cuts else {}
    pattern = first.get("pattern", {}).get("Regex", "")
    return (
        "Lowercase" in steps
        and steps <= {"NFC", "Replace", "Lowercase"}
        and first.get("type") == "Split"
        and (first.get("behavior"), first.get("invert")) == ("Removed", True)
        and r"[\p{L}]+" in pattern
        and r"[^\s\p{L}\p{N}]+" in pattern
        and [(c["type"], c.get("add_prefix_space"), c.get("use_regex")) for c in cuts[1:]] == [("ByteLevel", False, False)]
        and tokenizer["model"]["type"] == "BPE"
    )


@lru_cache(maxsize=4)
def tokenizer_of(path: str) -> ChunkTokenizer:
    """Read once in each worker process of a stage; path must be readable on every node."""
    return ChunkTokenizer(path)


MEMOS.append(tokenizer_of.cache_clear)


def piece_lengths(n: int, max_len: int) -> list[int]:
    """n as max_len + ... + max_len + falling powers of two."""
    rest = n % max_len
    return [max_len] * (n // max_len) + [1 << b for b in range(rest.bit_length() - 1, -1, -1) if rest >> b & 1]


def _slices(batch: pa.RecordBatch, size: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The rows in parts of about so many bytes of text, one row at least."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(1)), 0).to_numpy().astype(np.int64))
    at = 0
    while at < len(ends):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + size, "right")))
        yield batch.slice(at, to - at)
        at = to


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int, max_len: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per piece: doc_id, start, length, ids, doc_tokens, bucket (log2 of length), sequence_id, offset.

    max_len must be a power of two. sequence_id is unique over the table; offset is 0, as a piece is alone in
    its sequence. The work is one pass over the input without a shuffle.
    """
    if max_len & (max_len - 1) or max_len < 1:
        raise ValueError("max_len must be a power of two")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        begin_task()
        encoder = tokenizer_of(tokenizer)
        end = array("i", [end_id]).tobytes()
        for batch in chain.from_iterable(map(_slices, batches)):
            parts, sizes = [], []
            for ids in encoder.encode_texts(batch.column(1)):
                parts += [ids, end]
                sizes.append(len(ids) // 4 + 1)
            lengths = [piece_lengths(n, max_len) for n in sizes]
            each = np.fromiter(map(len, lengths), np.int64, count=len(lengths))
            length = np.fromiter(chain.from_iterable(lengths), np.int64)
            doc = np.repeat(np.arange(len(sizes)), each)
            whole = np.asarray(sizes, np.int64)
            ends = np.concatenate([[0], np.cumsum(length)])  # of pieces, in the ids of all documents in a row
            first = np.concatenate([[0], np.cumsum(whole)])[:-1] if sizes else whole
            values = np.frombuffer(b"".join(parts), np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(pa.array(doc)),
                    pa.array(ends[:-1] - first[doc]),
                    pa.array(length),
                    pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values)),
                    pa.array(whole[doc]),
                ],
                names=["doc_id", "start", "length", "ids", "doc_tokens"],
            )

    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()
    pieces = source.mapInArrow(cut, f"doc_id {kind}, start long, length long, ids array<int>, doc_tokens long")
    return pieces.withColumns(
        {
            "bucket": F.log2("length").cast("int"),
            "sequence_id": F.monotonically_increasing_id(),
            "offset": F.lit(0).cast("long"),
        }
    )


def write_buckets(pieces: DataFrame, path: str) -> None:
    """The packed pieces as Parquet, one folder per length, so that a reader draws batches of one shape."""
    pieces.write.partitionBy("bucket").parquet(path)
