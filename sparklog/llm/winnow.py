"""Document fingerprints by winnowing, in DataFrame expressions only.

A text's characters are its code points, each run of white space being one space. The `k` characters from each
place on are hashed; of every `w` neighbouring hashes the least is chosen, the rightmost of equals, and kept
with its position (the number of its first character in the text as it is). Two texts that share k + w - 1
characters in a row share a chosen hash, whatever stands before them; a match shorter than k characters is
never reported.

Defined results: null is the empty text; a text of white space has the empty fingerprint; fewer than k
characters are hashed as one, without space at the ends; fewer than w hashes are one window. Two empty
fingerprints have likeness 1, an empty and another 0. Equal texts, so repeated rows, have equal fingerprints. Texts
of any length are taken whole, as UTF-32 of four bytes a character; an empty table gives an empty table; a column
that has the name of the result is kept as <name>_input.

`winnowed` and `fingerprint` do the same with blocks of up to six non-space characters, cut from each word's
start, in place of characters, and block numbers as positions. A change inside a long run without space moves
all later blocks of the run; no query uses them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sparklog.llm.shared import groups_for, set_aside

_NO_ID = -(1 << 63)
#: Ranges of ids at most, each of which has a row in a broadcast table of 16 bytes a row.
MOST_RANGES = 1 << 20
_LAST = (1 << 31) - 1
#: Unicode's white space but the space itself.
_WHITE = r"[\t-\r\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


def _let(value: Column, body) -> Column:
    """body(value), the value computed once: lambdas see it as a variable."""
    return F.transform(F.array(value), body)[0]


def winnowed(text: Column, k: int = 4, w: int = 8) -> Column:
    """array<long> of the chosen (hash, position), in the order of positions.

    An element holds 32 bits of hash above 31 bits that fall as the position rises, so that the least element
    is the least hash at its rightmost place.
    """

    def of(units: Column) -> Column:
        grams = F.greatest(F.size(units) - k, F.lit(0))
        packed = lambda h, i: F.shiftleft(F.shiftrightunsigned(h, 32), 31).bitwiseOR(F.lit(_LAST) - i.cast("long"))
        each = F.transform(F.sequence(F.lit(0), grams), lambda i: packed(F.xxhash64(*[F.get(units, i + j) for j in range(k)]), i))
        return F.when(F.size(units) == 0, F.array().cast("array<bigint>")).otherwise(_let(each, least))

    def least(each: Column) -> Column:
        windows = F.sequence(F.lit(1), F.greatest(F.size(each) - w + 1, F.lit(1)))
        return F.array_distinct(F.transform(windows, lambda i: F.array_min(F.slice(each, i, w))))

    return _let(F.regexp_extract_all(text, F.lit(r"(\S{1,6})"), F.lit(1)), of)


#: The bits of a packed value that hold the hash; the others fall as the position rises.
_HASH_BITS = -1 << 31
#: Neighbours looked at first for those inside a window; there are about four.
_NEAR = 7


def _packed(h: Column, at: Column) -> Column:
    return h.bitwiseAND(F.lit(_HASH_BITS)).bitwiseOR(F.lit(_LAST) - at)


def winnowed_characters(text: Column, k: int = 24, w: int = 43) -> Column:
    """array<long> of the chosen (hash, position), packed as in winnowed, in the order of positions.

    A text is taken as UTF-32, so that a gram is a slice of bytes; only grams of texts with two spaces in a row
    are cut by a pattern. Built-in functions carry no state from one element to the next, so every gram is
    hashed by itself.
    """
    none = F.array().cast("array<bigint>")
    gram_hash = lambda g: F.xxhash64(F.encode(g, "UTF-32"))
    squeezed = lambda c: F.regexp_replace(c, "  +", " ")
    at = lambda v: F.shiftright(F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST)), 2)  # noqa: E731  (bytes to number)

    def chosen(each: Column, t: Column) -> Column:
        """Of packed hashes with four times the number (plus 1) of each as place, those that windows choose."""
        rest = F.trim(squeezed(t))
        short = F.when(rest == "", none).otherwise(F.array(_packed(gram_hash(rest), F.lit(1))))
        return _let(each, lambda e: F.when(F.size(e) == 0, short).otherwise(_let(_block_least(e, w), lambda m: _let(_candidates(e, m, w), lambda c: _window_least(e, c, w)))))

    def single(data: Column) -> Column:
        places = F.sequence(F.lit(1), F.octet_length(data) - 4 * k + 1, F.lit(4))
        each = F.transform(places, lambda at: _packed(F.xxhash64(F.substring(data, at, F.lit(4 * k))), at))
        return F.when(F.octet_length(data) < 4 * k, none).otherwise(each)

    def wide(t: Column) -> Column:
        """Of a text with runs of spaces, which count as one; '' at a space after a space, where no gram begins."""
        own = lambda g, i: F.struct(gram_hash(F.when(F.contains(g, F.lit("  ")), squeezed(g)).otherwise(g)).alias("h"), i.alias("place"), (g == "").alias("none"))
        grams = F.transform(F.regexp_extract_all(t, F.lit(f"(?s)(?<= ) |(?=((?: ++|[^ ]){{{k}}}+))."), F.lit(1)), own)
        numbered = lambda kept: chosen(F.transform(kept, lambda x, j: _packed(x["h"], 4 * j + 1)), t)
        place = lambda kept, v: F.coalesce(F.get(kept, at(v).cast("int"))["place"], F.lit(0))
        return _let(F.filter(grams, lambda x: ~x["none"]), lambda kept: F.transform(numbered(kept), lambda v: _packed(v, place(kept, v))))

    def of(t: Column) -> Column:
        """t has spaces for all white space, so its places are those of the text."""
        plain = F.transform(chosen(_let(F.encode(t, "UTF-32"), single), t), lambda v: _packed(v, at(v)))
        return F.when(F.contains(t, F.lit("  ")), wide(t)).otherwise(plain)

    return _let(F.regexp_replace(text, _WHITE, " "), of)


def _block_least(each: Column, w: int) -> Column:
    """The least of each block of (w + 1) / 2 neighbours: every window of w holds a whole block."""
    block = (w + 1) // 2
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(each) - 1) / block).cast("int")), lambda b: F.array_min(F.slice(each, b * block + 1, block)))


def _candidates(each: Column, least: Column, w: int) -> Column:
    """Those that may be a window's least: not above the least of their own or a neighbouring block."""
    block = (w + 1) // 2
    of = lambda m, b: _let(F.greatest(F.get(least, b - 1), m, F.get(least, b + 1)), lambda top: F.filter(F.slice(each, b * block + 1, block), lambda v: v <= top))
    return F.flatten(F.transform(least, of))


def _window_least(each: Column, some: Column, w: int) -> Column:
    """Of the candidates, those that are the least of a window of w, in order.

    One is if the window that begins behind the nearest lesser one before it (or, without one so near, that
    ends at it; near the start, the first window) reaches no lesser one behind it. A lesser one that is no
    candidate changes nothing: then two block leasts lie nearer together than a window is wide.
    """
    low = lambda v: v.bitwiseAND(F.lit(_LAST))  # noqa: E731  (falls by 4 from one place to the next)
    first = _LAST - (4 * (w - 1) + 1)  # the end of the first window
    last = F.least(low(F.element_at(each, -1)), F.lit(first))

    def is_least(v: Column, i: Column) -> Column:
        far = F.get(some, i - _NEAR - 1)
        begin = F.greatest(i - F.when(far.isNull() | (low(far) >= low(v) + 4 * w), _NEAR).otherwise(w), F.lit(0))
        lesser = F.filter(F.slice(some, begin + 1, i - begin), lambda y: (y < v) & (low(y) < low(v) + 4 * w))
        end = _let(lesser, lambda found: F.coalesce(low(F.get(found, F.size(found) - 1)) - 4 * w, F.least(low(v), F.lit(first))))
        return _let(end, lambda e: (e >= last) & ~reached(v, i, e))

    def reached(v: Column, i: Column, end: Column) -> Column:
        far = F.get(some, i + _NEAR + 1)
        number = F.when(far.isNull() | (low(far) < end), _NEAR).otherwise(w)
        return F.exists(F.slice(some, i + 2, number), lambda y: (y < v) & (low(y) >= end))

    return F.filter(some, is_least)


def hashes(fingerprint: Column) -> Column:
    """The distinct hashes of a fingerprint."""
    return F.array_distinct(F.transform(fingerprint, lambda v: F.shiftrightunsigned(v, 31)))


def as_text(fingerprint: Column) -> Column:
    """`hash:position` in hexadecimal and decimal, joined by spaces."""
    one = lambda v: F.concat(F.hex(F.shiftrightunsigned(v, 31)), F.lit(":"), (F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST))).cast("string"))
    return F.array_join(F.transform(fingerprint, one), " ")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two sets of hashes, 0 to 1."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), 1.0).otherwise(both / F.greatest(F.size(a) + F.size(b) - both, F.lit(1)))


def fingerprint(docs: DataFrame, k: int = 4, w: int = 8, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the winnowed fingerprint of text_col (array<long>) in column out; a column of that name becomes out_input."""
    docs, (text_col,) = set_aside(docs, out, text_col)
    return docs.withColumn(out, winnowed(F.coalesce(F.col(text_col).cast("string"), F.lit("")), k, w))


def fingerprint_characters(docs: DataFrame, k: int = 24, w: int = 43, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """docs with the fingerprint of text_col by characters (array<long>) in column out; a column of that name becomes out_input."""
    docs, (text_col,) = set_aside(docs, out, text_col)
    return docs.withColumn(out, winnowed_characters(F.coalesce(F.col(text_col).cast("string"), F.lit("")), k, w))


def _buckets(ids: DataFrame, number: int) -> Column:
    """A bucket number for doc_id: rising ranges of about equal counts.

    Up to 1024 ranges end at quantiles of the ids; more are equal widths inside those.
    """
    coarse = min(number, 1024)
    cuts = sorted(set(ids.approxQuantile("doc_id", [i / coarse for i in range(coarse + 1)], 0.2 / coarse))) if number > 1 else []
    if len(cuts) < 3:
        return F.lit(0).cast("long")
    low, splits, high = cuts[0], cuts[1:-1], cuts[-1]
    at = F.size(F.filter(F.array(*map(F.lit, splits)), lambda s: s <= F.col("doc_id").cast("double")))
    fine = -(-number // coarse)
    if fine == 1:
        return at.cast("long")
    begin = F.get(F.array(*map(F.lit, [low, *splits])), at)
    end = F.get(F.array(*map(F.lit, [*splits, high])), at)
    inside = F.floor((F.col("doc_id").cast("double") - begin) / F.greatest(end - begin, F.lit(1.0)) * fine)
    return at * F.lit(fine).cast("long") + F.least(F.greatest(inside, F.lit(0)), F.lit(fine - 1))


def with_next(docs: DataFrame, prepared, bucket_bytes: int = 4_000_000) -> DataFrame:
    """Each document beside its successor in falling doc_id; the last one's successor is the first.

    docs: doc_id and text, without nulls. prepared adds columns to the rows once they are in their bucket; the
    result has every column c and next_c. Documents are shuffled once, into ranges of ids; of each range, the
    highest document is copied to the range above (one document in bucket_bytes of text, or in more where that
    would make over MOST_RANGES ranges). Ranges are dealt to half as many tasks, so tasks grow in number, not in
    size. Rows that repeat an id follow each other in the order of their texts.
    """
    ids = docs.select("doc_id")
    number = min(groups_for(docs, bucket_bytes)[1], MOST_RANGES)
    bucket = _buckets(ids, number)
    tops = ids.withColumn("bucket", bucket).groupBy("bucket").agg(F.max("doc_id").alias("doc_id"))  # a row for each range
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    tops = tops.select("doc_id", F.coalesce(above, F.min("bucket").over(Window.partitionBy())).alias("above"))
    spread = docs.withColumn("bucket", bucket).join(F.broadcast(tops), "doc_id", "left")
    places = F.array(F.struct("bucket", F.lit(False).alias("copy")))
    copied = F.array(F.struct("bucket", F.lit(False).alias("copy")), F.struct(F.col("above").alias("bucket"), F.lit(True).alias("copy")))
    spread = spread.select("doc_id", "text", F.explode(F.when(F.col("above").isNull(), places).otherwise(copied)).alias("place"))
    rows = prepared(spread.select("doc_id", "text", "place.bucket", "place.copy").repartition(-(-number // 2), "bucket"))
    order = Window.partitionBy("bucket").orderBy("copy", F.desc("doc_id"), "text")
    names = [c for c in rows.columns if c not in ("bucket", "copy", "doc_id")]
    beside = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in names])
    return beside.filter(~F.col("copy")).drop("bucket", "copy")


def _edited_fingerprint(k: int, w: int) -> Column:
    """The fingerprint of `edited`, put together where that is exact from those of the texts that it is made of.

    A chosen hash depends on the w - 1 hashes on either side of it. So those of the kept part and of the
    successor's part stand as they are, but for the zones where the parts meet and where the successor is cut off;
    only these are hashed again, or all of an edited text whose kept part is short (_whole) or that has runs of
    white space, or all behind the border where the successor's part is short (_short).
    """
    edited, kept, length, whole, short = (F.col(c) for c in ("edited", "_kept", "_length", "_whole", "_short"))
    place = lambda v: F.lit(_LAST) - v.bitwiseAND(F.lit(_LAST))
    moved = lambda found, by, holds: F.transform(F.filter(found, holds), lambda v: v - by)  # noqa: E731  (a place by places on)
    last_kept = kept - k - w + 1  # the last place whose windows lie in the kept part
    begin = last_kept - w + 2  # of the zone around the border: w - 1 places before those that are taken from it
    last_next = length - k - w + 1  # the same in the successor's part
    end_begin = last_next - w + 2
    border = F.when(whole, edited).when(short, F.substring(edited, begin + 1, length)).otherwise(F.substring(edited, begin + 1, kept + w - 2 + w - 1 + k - begin))
    ending = F.when(whole | short, F.lit("")).otherwise(F.substring(edited, end_begin + 1, length))

    def joined(zones: Column) -> Column:
        head = F.filter(F.col("fingerprint"), lambda v: place(v) <= last_kept)
        meeting = moved(zones["border"], begin.cast("long"), lambda v: (place(v) + begin > last_kept) & (place(v) + begin <= length - k) & (short | (place(v) + begin < kept + w - 1)))
        tail = moved(F.col("next_fingerprint"), kept.cast("long"), lambda v: (place(v) >= w - 1) & (place(v) + kept <= last_next))
        ended = moved(zones["ending"], end_begin.cast("long"), lambda v: (place(v) + end_begin > last_next) & (place(v) + end_begin <= length - k))
        return F.when(whole, zones["border"]).when(short, F.concat(head, meeting)).otherwise(F.concat(head, meeting, tail, ended))

    return _let(F.struct(winnowed_characters(border, k, w).alias("border"), winnowed_characters(ending, k, w).alias("ending")), joined)


def edited_against_next(docs: DataFrame, k: int = 24, w: int = 43, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text, edited (its second half replaced by the successor's start), both fingerprints, next_fingerprint.

    A null id sorts below all others; other columns, whatever their names, are not read.
    """
    work = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(_NO_ID)).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    rows = with_next(work, lambda df: fingerprint_characters(df, k, w))
    half = F.floor(F.char_length("text") / 2).cast("int")
    kept = F.char_length("text") - half
    edited = F.concat(F.left("text", kept), F.left("next_text", half))
    rows = rows.select(F.nullif("doc_id", F.lit(_NO_ID)).alias("doc_id"), "text", edited.alias("edited"), "fingerprint", "next_fingerprint", kept.alias("_kept"))
    zone = 2 * k + 4 * w
    runs = F.rlike("edited", F.lit(f"(?: |{_WHITE}){{2}}"))
    rows = rows.withColumns({"_length": F.char_length("edited"), "_whole": (F.col("_kept") < zone) | runs})
    rows = rows.withColumn("_short", (F.col("_length") - F.col("_kept") < zone) & ~F.col("_whole"))
    return rows.withColumn("edited_fingerprint", _edited_fingerprint(k, w)).drop("_kept", "_length", "_whole", "_short")
