"""Byte-level BPE: encoding by backtracking over longest matches, and decoding.

The bytes of a pre-token are read as Latin-1 characters, so that an Aho-Corasick automaton over the
vocabulary finds every token at every position in one pass. Encoding starts with the longest token at the
first position; a token may follow another only if merging in rank order would leave just that pair at
their border (a property of the two tokens, memoised). Where no token fits, the last one is taken back and
its next shorter prefix is tried; a position found dead is never entered again, so the time is linear. The
result is the exact sequence that rank-ordered merging gives.

Defined results: null and empty texts give an empty id list; repeated rows are encoded alike; a text of any
length is encoded whole, in time linear in it; two ways to split a text never tie, as merges have an order;
other columns pass through, one that has the name of the result as <name>_input; an empty table gives an empty
table.
"""

from __future__ import annotations

import base64
import re
from array import array
from collections.abc import Sequence
from functools import lru_cache
from itertools import chain, islice

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import set_aside

#: How the rank files' texts are split before merging. Fixed value: part of the vocabularies' definition.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: Letters are one pre-token with what leads them, marks behind them (but ') another.
_PLAIN = re.compile("(\n?[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]+)([!-&(-/:-@\\[-`{-~]*)")
#: White space other than space and line end; a text that has it is split by the pattern throughout.
_RARE_ASCII = "\t\x0b\x0c\r\x1c\x1d\x1e\x1f"
_RARE = re.compile(r"[^\S \n]")
#: Outside Latin-1, so in no token: the automaton starts anew behind it.
_APART = "\u0100"
#: Longer pre-tokens are encoded one at a time and not memoised.
_LONG = 64


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _key(piece: str) -> str:
    """A pre-token as a key of the memo: a leading space is dropped, no leading space shown by a line end."""
    return piece[1:] if piece[0] == " " and len(piece) > 1 and not piece[1].isspace() else "\n" + piece


class BytePairEncoder:
    """One vocabulary's tables; encodes pre-tokens, texts and whole Arrow arrays."""

    CACHED = 400_000

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        self.ranks = ranks
        self.split = regex.compile(pattern).findall
        size = max(ranks.values()) + 1
        self.token = [b""] * size
        for token, rank in ranks.items():
            self.token[rank] = token
        self.length = [len(t) for t in self.token]
        self.lengths = np.asarray(self.length)
        self.shorter = [next((ranks[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in ranks), -1) for t in self.token]
        self.shorter_of = np.asarray(self.shorter)
        self.halves: list[tuple[int, int]] = [(i, i) for i in range(size)]
        self.merged: dict[tuple[int, int], int] = {}
        self.compatible: dict[tuple[int, int], bool] = {}
        for whole in sorted(ranks.values()):
            self._find_merge(whole)
        self.compatible.clear()  # judged before all merges were known
        self.matches = ahocorasick.Automaton()
        for token, rank in ranks.items():
            if len(token) > 1:
                self.matches.add_word(token.decode("latin-1"), rank)
        self.single = np.array([ranks[bytes([b])] for b in range(256)])
        self.line_end = np.int32(ranks[b"\n"]).tobytes()
        self.matches.make_automaton()
        self.bytes_table = pa.array(self.token, pa.large_binary())
        self.memo: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pair_key = np.full(1 << 21, -1, np.int64)
        self.pair_fits = np.zeros(1 << 21, bool)

    def _find_merge(self, whole: int) -> None:
        """The pair whose merge makes this token, if rank-ordered merging can make it."""
        token, left = self.token[whole], self.shorter[whole]
        while left >= 0:
            right = self.ranks.get(token[self.length[left] :], -1)
            if 0 <= right < whole and left < whole and self._judge(left, right):
                self.merged[left, right] = whole
                self.halves[whole] = (left, right)
                return
            left = self.shorter[left]

    def _judge(self, left: int, right: int) -> bool:
        """Would merging leave the border between these two tokens as it is?

        Takes the two apart again, latest merge first; a merge across the border that ranks before the
        latest merge taken apart would have come first.
        """
        bound = len(self.token)
        while True:
            across = self.merged.get((left, right))
            if across is not None and across < bound:
                return False
            if left > right:
                inner = self.halves[left][1]
                if inner != left:
                    bound, left = left, inner
                    continue
                inner = self.halves[right][0]
                if inner == right:
                    return True
                bound, right = right + 1, inner
            else:
                inner = self.halves[right][0]
                if inner != right:
                    bound, right = right + 1, inner
                    continue
                inner = self.halves[left][1]
                if inner == left:
                    return True
                bound, left = left, inner

    def encode_piece(self, piece: bytes) -> tuple[int, ...]:
        """The ids of one pre-token."""
        whole = self.ranks.get(piece)
        if whole is not None:
            return (whole,)
        length, shorter, compatible, size = self.length, self.shorter, self.compatible, len(piece)
        longest = self.single[np.frombuffer(piece, np.uint8)].tolist()
        for end, rank in self.matches.iter(piece.decode("latin-1")):
            # of the tokens that end here the longest comes first, and a later end means a longer token
            longest[end + 1 - length[rank]] = rank
        alive = bytearray(b"\1") * (size + 1)
        ids: list[int] = []
        at, last, rank = 0, -1, longest[0]
        while True:
            end = at + length[rank]
            if alive[end]:
                if last < 0:
                    fits = True
                else:
                    fits = compatible.get((last, rank))
                    if fits is None:
                        if len(compatible) > 1_000_000:
                            compatible.clear()
                        fits = compatible[last, rank] = self._judge(last, rank)
                if fits:
                    ids.append(rank)
                    if end == size:
                        return tuple(ids)
                    at, last, rank = end, rank, longest[end]
                    continue
            rank = shorter[rank]
            if rank < 0:  # nothing fits here: take the last token back and try its next shorter prefix
                if last < 0:
                    raise ValueError("the vocabulary lacks single bytes")
                alive[at] = 0
                rank = shorter[ids.pop()]
                at -= length[last]
                while rank < 0:
                    alive[at] = 0
                    last = ids.pop()
                    at -= length[last]
                    rank = shorter[last]
                last = ids[-1] if ids else -1

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """_judge of many pairs; the table of pairs judged before has one place for each of 2**21 hashes."""
        key = left * len(self.token) + right
        slot = (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(43)).astype(np.int64)
        fits, new = self.pair_fits[slot], np.flatnonzero(self.pair_key[slot] != key)
        if len(new):
            pairs, back = np.unique(key[new], return_inverse=True)
            judged = np.fromiter((self._judge(*divmod(k, len(self.token))) for k in pairs.tolist()), bool, len(pairs))
            fits[new] = judged[back]
            self.pair_key[slot[new]], self.pair_fits[slot[new]] = -1, False
            order = np.argsort(back, kind="stable")  # where two pairs have one place, key and value of one of them
            self.pair_key[slot[new[order]]], self.pair_fits[slot[new[order]]] = key[new[order]], fits[new[order]]
        return fits

    def encode_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each pre-token, as bytes of 32-bit numbers; all take their steps side by side."""
        sizes = np.fromiter(map(len, pieces), np.int64, count=len(pieces))
        begin = np.cumsum(sizes + 1) - sizes - 1
        joined = _APART.join([p.decode("latin-1") for p in pieces])
        longest = np.append(self.single[np.frombuffer(b"\0".join(pieces), np.uint8)], 0)
        found = np.fromiter(chain.from_iterable(self.matches.iter(joined)), np.int64)
        ends, ranks = found[::2], found[1::2]
        longest[ends + 1 - self.lengths[ranks]] = ranks  # later ends, so longer tokens, come later
        alive = np.ones(len(longest), bool)
        stack = np.zeros((len(pieces), int(sizes.max(initial=0)) + 1), np.int32)  # an own -1 before the first token
        stack[:, 0] = -1
        deep = np.zeros(len(pieces), np.int64)
        who, at, stop = np.arange(len(pieces)), begin.copy(), begin + sizes
        last, rank = np.full(len(pieces), -1), longest[begin]
        while len(who):
            end = at + self.lengths[rank]
            fits = (rank >= 0) & alive[np.minimum(end, stop)]
            ask = np.flatnonzero(fits & (last >= 0))
            fits[ask] = self._fits(last[ask], rank[ask])
            back = np.flatnonzero(rank < 0)
            if len(back):  # nothing fits here: take the last token back and try its next shorter prefix
                alive[at[back]] = False
                w = who[back]
                taken = stack[w, deep[w]]
                if (taken < 0).any():
                    raise ValueError("the vocabulary lacks single bytes")
                deep[w] -= 1
                at[back] -= self.lengths[taken]
            next_rank = self.shorter_of[rank]
            if len(back):
                next_rank[back], last[back] = self.shorter_of[taken], stack[w, deep[w]]
            w = who[fits]
            deep[w] += 1
            stack[w, deep[w]] = rank[fits]
            at[fits], last[fits] = end[fits], rank[fits]
            next_rank[fits] = longest[end[fits]]
            rank = next_rank
            going = np.flatnonzero(at < stop)
            if len(going) < len(who):
                who, at, stop, last, rank = who[going], at[going], stop[going], last[going], rank[going]
        data = stack[:, 1:][np.arange(1, stack.shape[1]) <= deep[:, None]].tobytes()
        cuts = (4 * np.cumsum(np.append(0, deep))).tolist()
        return [data[a:b] for a, b in zip(cuts, cuts[1:])]

    def _keys(self, text: str) -> list[str]:
        """The text in parts whose ids, in a row, are its ids.

        A part is a key of the memo: what stands between two single spaces or line ends (a chunk), with a
        line end before it where no space leads it; a carriage return stands for a line end. Spaces and line
        ends beside other white space don't cut so; then every pre-token is a part.
        """
        rare = any(c in text for c in _RARE_ASCII) if text.isascii() else _RARE.search(text)
        if rare or "  " in text or "\n\n" in text or " \n" in text or "\n " in text or text[0] == " " or text[-1] == " ":
            return list(map(_key, self.split(text)))
        return ("\n" + text.replace("\n", " \r \n")).split(" ")

    def _coded(self, keys: list[str]) -> list[bytes]:
        """The ids of each key; those that the memo lacks are encoded together."""
        out = list(map(self.memo.get, keys))
        places = [k for k, ids in enumerate(out) if ids is None]
        if not places:
            return out
        number: dict[str, int] = {}  # of each key to find
        own = [number.setdefault(keys[k], len(number)) for k in places]
        found: list[bytes | None] = [self.older.get(key) for key in number]
        mixed: list[tuple[int, list[str]]] = []  # several pre-tokens
        single: list[int] = []
        texts: list[str] = []
        for k, key in enumerate(list(number)):
            if found[k] is not None:
                continue
            if key.isascii() and key.isalpha():
                single.append(k)
                texts.append(" " + key)
                continue
            if plain := _PLAIN.fullmatch(key):
                letters, marks = plain.groups()
                if not marks:
                    single.append(k)
                    texts.append(key[1:] if key[0] == "\n" else " " + key)
                    continue
                parts = [letters, "\n" + marks]
            elif len(key) < 2 and key in "\n\r":
                found[k] = self.line_end if key == "\r" else b""
                continue
            else:
                parts = list(map(_key, self.split(key[1:] if key[0] == "\n" else " " + key)))
                if len(parts) == 1:
                    single.append(k)
                    texts.append(key[1:] if key[0] == "\n" else " " + key)
                    continue
            mixed.append((k, parts))
            for p in parts:
                if p not in self.memo and p not in number:
                    number[p] = len(number)
                    found.append(self.older.get(p))
                    if found[-1] is None:
                        single.append(len(found) - 1)
                        texts.append(p[1:] if p[0] == "\n" else " " + p)
        short: list[int] = []
        pieces: list[bytes] = []
        for k, text in zip(single, texts):
            piece = text.encode("utf-8", "replace")
            if len(piece) > _LONG:
                found[k] = array("i", self.encode_piece(piece)).tobytes()
            else:
                short.append(k)
                pieces.append(piece)
        for low in range(0, len(short), 50_000):
            for k, ids in zip(short[low : low + 50_000], self.encode_pieces(pieces[low : low + 50_000])):
                found[k] = ids
        for k, parts in mixed:
            found[k] = b"".join([found[number[p]] if p in number else self.memo[p] for p in parts])
        for k, n in zip(places, own):
            out[k] = found[n]
        if len(self.memo) + len(found) > self.CACHED:  # the memo becomes the older half, whose entries return as they are used
            self.older, self.memo = self.memo, {}
        self.memo.update(islice(((key, ids) for key, ids in zip(number, found) if len(key) <= _LONG), self.CACHED))
        return out

    def encode_texts(self, texts: Sequence[str | None]) -> list[bytes]:
        """The ids of each text, as bytes of 32-bit numbers."""
        keys: list[str] = []
        ends = [0]
        for text in texts:
            if text:
                keys += self._keys(text)
            ends.append(len(keys))
        coded = self._coded(keys)
        return [b"".join(coded[a:b]) for a, b in zip(ends, ends[1:])]

    def ids(self, text: str | None) -> np.ndarray:
        return np.frombuffer(self.encode_texts([text])[0], np.int32)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def encode_array(self, texts: pa.Array) -> pa.ListArray:
        parts: list[bytes] = []
        held: list[str | None] = []
        size = 0
        for text in texts.to_pylist():
            held.append(text)
            size += len(text) if text else 0
            if size >= 2_000_000:  # characters whose parts are in memory at a time, or one text
                parts += self.encode_texts(held)
                held, size = [], 0
        parts += self.encode_texts(held)
        ends = np.cumsum([0, *map(len, parts)]) // 4
        values = np.frombuffer(b"".join(parts), np.int32)
        return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int32()))

    def decode_array(self, ids: pa.ListArray) -> pa.Array:
        """The bytes of each id list: one gather over the vocabulary, whose buffer then holds all documents."""
        flat = ids.flatten()
        taken = self.bytes_table.take(flat)
        ends = np.frombuffer(taken.buffers()[1], np.int64, count=len(flat) + 1 + taken.offset)[taken.offset :]
        cuts = np.concatenate([[0], np.cumsum(ids.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
        data = taken.buffers()[2] or pa.py_buffer(b"")
        offsets = pa.py_buffer(np.ascontiguousarray(ends[cuts.astype(np.int64)]))
        whole = pa.Array.from_buffers(pa.large_binary(), len(ids), [None, offsets, data])
        return whole.cast(pa.binary())


@lru_cache(maxsize=4)
def encoder_of(path: str) -> BytePairEncoder:
    """Read and built once in each worker process; path must be readable on every node."""
    return BytePairEncoder(read_ranks(path))


def encode(text: Column | str, ranks: str) -> Column:
    """Text -> array<int> of ids by the rank file; no special tokens. Null: empty."""

    @F.arrow_udf("array<int>")
    def bpe_encode(texts: pa.Array) -> pa.Array:
        return encoder_of(ranks).encode_array(texts)

    return bpe_encode(text)


def decode(ids: Column | str, ranks: str) -> Column:
    """array<int> -> the bytes that the ids stand for. Null: empty."""

    @F.arrow_udf("binary")
    def bpe_decode(lists: pa.Array) -> pa.Array:
        return encoder_of(ranks).decode_array(lists)

    return bpe_decode(ids)


def encode_documents(docs: DataFrame, ranks: str, text_col: str = "text", out: str = "ids") -> DataFrame:
    """docs with the ids of text_col in column out; a column of that name becomes out_input."""
    docs, (text,) = set_aside(docs, out, text_col)
    return docs.withColumn(out, encode(F.col(text).cast("string"), ranks))


def decode_documents(docs: DataFrame, ranks: str, ids_col: str = "ids", out: str = "decoded") -> DataFrame:
    """docs with the bytes of ids_col in column out; a column of that name becomes out_input."""
    docs, (ids,) = set_aside(docs, out, ids_col)
    return docs.withColumn(out, decode(F.col(ids), ranks))
