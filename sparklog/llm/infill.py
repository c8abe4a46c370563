"""Fill-in-the-middle transformation of documents, as one pipeline of Arrow compute calls per batch.

A text's units are its code points. A batch's texts are split into a list array of units and flattened with the
parent index of each unit; a unit's ordinal in its text gives its role (prefix, middle, suffix); the units of a role
are filtered, put back into one list for each text, joined, and joined with the marks in the order of the form.
Texts are cut into pieces of STEP bytes for that, so that a batch, or one very long text, takes memory for its bytes
and for the units of one step; the pieces of a role are joined again by text.

Where the cuts lie and which form a document takes is decided by its id alone (see `plan`), in DataFrame functions.

Defined results: a null or empty text is empty and plain; a text that holds one of the marks is plain, so that a
transformed text can always be read back (`restored`); a null id hashes as an empty one; rows that repeat an id are
transformed alike, each by its own text; ties don't arise; other columns pass through whatever their names, a column
that has the name of a result is kept as <name>_input; an empty table gives an empty table.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import set_aside

#: Bytes of text whose units are held at once.
STEP = 1 << 20


@dataclass(frozen=True)
class Marks:
    """Before the prefix, the suffix and the middle. No mark may begin inside another, nor a text with half of one."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"

    def all(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle


def units_of(texts: pa.StringArray) -> pa.ListArray:
    """The code points of each text: a list array over the bytes of all of them."""
    whole = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(texts)], pa.int32()), texts), "")
    size = len(whole[0].as_buffer())
    data = whole.buffers()[2]
    octets = pa.UInt8Array.from_buffers(pa.uint8(), size, [None, data])
    begins = pc.indices_nonzero(pc.not_equal(pc.bit_wise_and(octets, pa.scalar(0xC0, pa.uint8())), pa.scalar(0x80, pa.uint8())))
    offsets = pa.concat_arrays([begins.cast(pa.int32()), pa.array([size], pa.int32())])
    units = pa.StringArray.from_buffers(len(begins), offsets.buffers()[1], data)
    ends = pc.cumulative_sum(pc.utf8_length(texts))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())]), units)


def _pieces(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """Texts cut between code points into pieces of at most STEP bytes, and the text of each piece."""
    sizes = pc.binary_length(texts).to_numpy(zero_copy_only=False)
    if not len(sizes) or sizes.max() <= STEP:
        return texts, np.arange(len(texts))
    parts, owner = [], []
    for k, size in enumerate(sizes.tolist()):
        if size <= STEP:
            parts.append(texts.slice(k, 1))
            owner.append(k)
            continue
        octets, at, cut = texts[k].as_buffer().to_pybytes(), 0, []
        while at < size:
            end = min(at + STEP, size)
            while end < size and octets[end] & 0xC0 == 0x80:
                end -= 1
            cut.append(octets[at:end])
            at = end
        parts.append(pa.array(cut, pa.binary()).cast(pa.string()))
        owner += [k] * len(cut)
    return pa.concat_arrays(parts), np.array(owner)


def _joined(values: pa.Array, parents: np.ndarray, n: int) -> pa.Array:
    """The values of each of n parents (ascending), joined."""
    offsets = np.searchsorted(parents, np.arange(n + 1)).astype(np.int32)
    return pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets), values), "")


def split_roles(texts: pa.StringArray, first: pa.Array, second: pa.Array) -> list[pa.Array]:
    """Prefix (units before `first`), middle (before `second`) and suffix of each text."""
    pieces, owner = _pieces(texts)
    lengths = pc.utf8_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.cumsum(lengths) - lengths
    base = pa.array(before - before[np.searchsorted(owner, owner)])  # units of the same text in earlier pieces
    first, second = pc.take(first, pa.array(owner)), pc.take(second, pa.array(owner))
    size = np.cumsum(pc.binary_length(pieces).to_numpy(zero_copy_only=False).astype(np.int64))
    roles: list[list[pa.Array]] = [[], [], []]
    begin = 0
    while begin < len(pieces):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + STEP, side="right")))
        n = end - begin
        units = units_of(pieces.slice(begin, n))
        parent = pc.list_parent_indices(units)
        flat = pc.list_flatten(units)
        start = pc.subtract(units.offsets.slice(0, n).cast(pa.int64()), base.slice(begin, n))
        ordinal = pc.subtract(pa.array(np.arange(len(flat))), pc.take(start, parent))
        at_least = lambda cut: pc.greater_equal(ordinal, pc.take(cut.slice(begin, n), parent)).cast(pa.int8())
        role = pc.add(at_least(first), at_least(second))
        for k in range(3):
            chosen = pc.equal(role, pa.scalar(k, pa.int8()))
            roles[k].append(_joined(flat.filter(chosen), parent.filter(chosen).to_numpy(), n))
        begin = end
    if not len(pieces):
        return [texts] * 3
    whole = [pa.concat_arrays(parts) for parts in roles]
    return whole if pieces is texts else [_joined(parts, owner, len(texts)) for parts in whole]


def transformed(text: Column, first: Column, second: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text in its form: plain; psm: prefix, suffix, middle; spm: suffix, prefix, middle; each after its mark."""

    @F.arrow_udf("string")
    def infilled(text: pa.Array, first: pa.Array, second: pa.Array, form: pa.Array) -> pa.Array:
        text = pc.fill_null(text.cast(pa.string()), "")
        moved = pc.not_equal(form, "plain")
        prefix, middle, suffix = split_roles(text.filter(moved), first.filter(moved), second.filter(moved))
        p, s, m = marks.all()
        psm = pc.binary_join_element_wise(p, prefix, s, suffix, m, middle, "")
        spm = pc.binary_join_element_wise(s, suffix, p, prefix, m, middle, "")
        return pc.replace_with_mask(text, moved, pc.if_else(pc.equal(form.filter(moved), "psm"), psm, spm))

    return infilled(text, first, second, form)


def plan(text: Column, doc_id: Column, marks: Marks = Marks(), plain_percent: int = 10, spm_percent: int = 20) -> Column:
    """n, first and second cut (in code points) and form: by four 32-bit numbers from the SHA-256 of `1:<id>`."""
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    n = F.char_length(text).cast("long")
    cut = [F.pmod(h[k], n + 1) for k in (0, 1)]
    plain = (n == 0) | (F.pmod(h[2], F.lit(100)) >= 100 - plain_percent)
    for mark in marks.all():
        plain |= F.contains(text, F.lit(mark))
    form = F.when(plain, "plain").when(F.pmod(h[3], F.lit(100)) < spm_percent, "spm").otherwise("psm")
    return F.struct(n.alias("n"), F.least(*cut).alias("first"), F.greatest(*cut).alias("second"), form.alias("form"))


def restored(output: Column, form: Column, marks: Marks = Marks()) -> Column:
    """The text again, from output and form alone."""
    p, s, m = (F.lit(x) for x in marks.all())
    at = lambda mark: F.instr(output, mark)
    between = lambda begin, mark, end: F.substr(output, begin + F.char_length(mark), end - begin - F.char_length(mark))
    after = F.substr(output, at(m) + F.char_length(m))
    psm = F.concat(between(at(p), p, at(s)), after, between(at(s), s, at(m)))
    spm = F.concat(between(at(p), p, at(m)), after, between(at(s), s, at(p)))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def infill_documents(docs: DataFrame, marks: Marks = Marks(), id_col: str = "doc_id", text_col: str = "text", out: str = "infill") -> DataFrame:
    """docs with a struct column `out`: n, form, prefix_chars and middle_chars (null: plain), output."""
    docs, (id_col, text_col) = set_aside(docs, out, id_col, text_col)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = docs.withColumn(out, plan(text, F.col(id_col), marks))
    p = F.col(out)
    moved = p["form"] != "plain"
    return rows.withColumn(
        out,
        F.struct(
            p["n"].alias("n"), p["form"].alias("form"), F.when(moved, p["first"]).alias("prefix_chars"), F.when(moved, p["second"] - p["first"]).alias("middle_chars"),
            transformed(text, p["first"], p["second"], p["form"], marks).alias("output"),
        ),
    )
