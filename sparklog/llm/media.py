"""Media columns: AVI files of motion-JPEG frames.

Texts are written losslessly, as 8-bit grey frames in lossless JPEG (SOF3, left-neighbour prediction), one frame
to a `00dc` chunk, behind a RIFF header and an `idx1` index. The Huffman table gives every difference class of b
extra bits a code of 16 - b bits, so each sample takes 16 bits (twice the payload, and headers) and frames are
coded and decoded as arrays. Reading parses the RIFF chunks, takes the frames from the index (by walking `movi`
where there is none) and decodes each intra frame alone: own frames as arrays, lossless frames with other Huffman
tables bit by bit, and baseline frames (SOF0, as cameras write them, with or without tables of their own) as their
luminance.

Shots end where the difference of neighbouring frames' grey histograms exceeds the mean of its surroundings
by some standard deviations; they become timed clip rows.

Defined results: null is empty; an empty payload has no frames and no clips; of equal differences each is judged
by its own surroundings; texts of any length are stored whole; repeated rows and equal payloads give equal media
and clips; other columns, whatever their names, are not read; an empty table gives an empty table. For media that
can't be read, read_avi raises ValueError; clips_of gives the row no clip but the reason.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparklog.llm.shared import keyed_text

WIDTH = HEIGHT = 24
FRAME = WIDTH * HEIGHT
FPS = 25

#: struct of one clip: frames start..end-1 and their times in seconds.
CLIP = pa.struct([("start", pa.int32()), ("end", pa.int32()), ("start_s", pa.float64()), ("end_s", pa.float64()), ("mean", pa.float64())])
_CLIPS_SQL = "array<struct<start:int,end:int,start_s:double,end_s:double,mean:double>>"


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 16-bit word of each difference -255..255, and back."""
    word = np.zeros(511, np.uint16)
    code = 0
    for bits in range(8, -1, -1):  # classes by rising code length, as a canonical table has them
        for d in range(-255, 256):
            if abs(d).bit_length() == bits:
                word[d + 255] = code << bits | (d if d > 0 else d + (1 << bits) - 1)
        code = code + 1 << 1
    back = np.full(1 << 16, 999, np.int16)
    back[word] = np.arange(-255, 256)
    return word, back


_WORD, _BACK = _tables()
_LENGTHS = bytes([0] * 7 + [1] * 9)
_SYMBOLS = bytes(range(8, -1, -1))


def _jpeg_head() -> bytes:
    table = b"\x00" + _LENGTHS + _SYMBOLS
    return (
        b"\xff\xd8"
        + b"\xff\xc4" + struct.pack(">H", 2 + len(table)) + table
        + b"\xff\xc3" + struct.pack(">HBHHB3B", 11, 8, HEIGHT, WIDTH, 1, 1, 0x11, 0)
        + b"\xff\xda" + struct.pack(">HB2B3B", 8, 1, 1, 0, 1, 0, 0)
    )


_HEAD = _jpeg_head()


def _differences(frames: np.ndarray) -> np.ndarray:
    x = frames.astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    return d


def _samples(d: np.ndarray) -> np.ndarray:
    d = d.astype(np.int32)
    d[:, 0, 0] += 128
    d[:, :, 0] = np.cumsum(d[:, :, 0], axis=1)
    return (np.cumsum(d, axis=2) & 0xFF).astype(np.uint8)


def _chunk(name: bytes, data: bytes) -> bytes:
    return name + struct.pack("<I", len(data)) + data + b"\0" * (len(data) & 1)


def write_avi(payload: bytes) -> bytes:
    """The payload as an AVI; its length must be a multiple of FRAME."""
    if len(payload) % FRAME:
        raise ValueError(f"the payload must be a multiple of {FRAME} bytes")
    frames = np.frombuffer(payload, np.uint8).reshape(-1, HEIGHT, WIDTH)
    n = len(frames)
    coded = _WORD[_differences(frames) + 255].astype(">u2").view(np.uint8).reshape(n, 2 * FRAME)
    if not (coded == 255).any():  # no byte stuffing: all frames have one size
        size = len(_HEAD) + coded.shape[1] + 2
        movi = np.zeros((n, 8 + size + (size & 1)), np.uint8)
        movi[:, :8] = np.frombuffer(b"00dc" + struct.pack("<I", size), np.uint8)
        movi[:, 8 : 8 + len(_HEAD)] = np.frombuffer(_HEAD, np.uint8)
        movi[:, 8 + len(_HEAD) : 6 + size] = coded
        movi[:, 6 + size : 8 + size] = (0xFF, 0xD9)
        sizes = np.full(n, size)
        body, places = movi.tobytes(), 4 + np.arange(n) * movi.shape[1]
    else:
        jpegs = [_HEAD + row.tobytes().replace(b"\xff", b"\xff\0") + b"\xff\xd9" for row in coded]
        sizes = np.fromiter(map(len, jpegs), np.int64, count=n)
        body = b"".join(_chunk(b"00dc", j) for j in jpegs)
        places = 4 + np.concatenate([[0], np.cumsum(8 + sizes + (sizes & 1))])[:-1]
    largest = int(sizes.max()) if n else 0
    head = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, n, 0, 1, largest, WIDTH, HEIGHT, 0, 0, 0, 0)
    stream = b"vidsMJPG" + struct.pack("<10I4H", 0, 0, 0, 1, FPS, 0, n, largest, 0xFFFFFFFF, 0, 0, 0, WIDTH, HEIGHT)
    form = struct.pack("<I2i2H4s5I", 40, WIDTH, HEIGHT, 1, 24, b"MJPG", FRAME * 3, 0, 0, 0, 0)
    index = np.zeros((n, 4), "<u4")
    index[:, 0] = int.from_bytes(b"00dc", "little")
    index[:, 1], index[:, 2], index[:, 3] = 0x10, places, sizes
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", head) + _chunk(b"LIST", b"strl" + _chunk(b"strh", stream) + _chunk(b"strf", form)))
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + body) + _chunk(b"idx1", index.tobytes()))


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, begin, end) of the chunks between at and end."""
    while at + 8 <= end:
        size = struct.unpack_from("<I", data, at + 4)[0]
        if at + 8 + size > end:
            raise ValueError("a chunk reaches beyond its parent")
        yield data[at : at + 4], at + 8, at + 8 + size
        at += 8 + size + (size & 1)


def _frame_places(media: bytes) -> tuple[list[tuple[int, int]], float]:
    """Begin and end of each frame's JPEG, and frames a second."""
    if media[:4] != b"RIFF" or media[8:12] != b"AVI ":
        raise ValueError("not an AVI")
    index, movi, rate = None, None, 0.0
    for name, begin, end in _chunks(media, 12, 8 + struct.unpack_from("<I", media, 4)[0]):
        kind = media[begin : begin + 4]
        if name == b"LIST" and kind == b"hdrl":
            for inner, at, _ in _chunks(media, begin + 4, end):
                if inner == b"avih":
                    rate = 1e6 / max(1, struct.unpack_from("<I", media, at)[0])
        elif name == b"LIST" and kind == b"movi":
            movi = (begin, end)
        elif name == b"idx1":
            index = np.frombuffer(media, "<u4", (end - begin) // 16 * 4, begin).reshape(-1, 4)
    if movi is None:
        raise ValueError("no movi list")
    if index is None:
        return [(a, b) for name, a, b in _chunks(media, movi[0] + 4, movi[1]) if name[2:] in (b"dc", b"db")], rate
    begins = movi[0] + index[:, 2].astype(np.int64) + 8
    return list(zip(begins.tolist(), (begins + index[:, 3]).tolist())), rate


def _jpeg_layout(jpeg: bytes) -> tuple[int, int, int, tuple[bytes, bytes]]:
    """Where the coded data begin, height, width and the Huffman table of a lossless grey JPEG."""
    at, shape, table = 2, None, None
    while True:
        marker, size = jpeg[at : at + 2], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if marker == b"\xff\xc4":
            table = (body[1:17], body[17 : 17 + sum(body[1:17])])
        elif marker == b"\xff\xc3":
            shape = struct.unpack(">BHHB", body[:6])
        elif marker == b"\xff\xda":
            if shape is None or table is None or shape[0] != 8 or shape[3] != 1 or body[3] != 1:
                raise ValueError("not a lossless 8-bit grey JPEG with left-neighbour prediction")
            return at + 2 + size, shape[1], shape[2], table
        at += 2 + size


def _decode_bits(data: bytes, table: tuple[bytes, bytes], count: int) -> np.ndarray:
    """Differences coded with any Huffman table, one by one."""
    lookup, code, k = {}, 0, 0
    for length, many in enumerate(table[0], 1):
        for _ in range(many):
            lookup[length, code] = table[1][k]
            code, k = code + 1, k + 1
        code <<= 1
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    out, at = np.empty(count, np.int16), 0
    for n in range(count):
        code = length = 0
        while (length, code) not in lookup:
            code, length, at = code << 1 | bits[at], length + 1, at + 1
        size = lookup[length, code]
        value = int("".join(map(str, bits[at : at + size])) or "0", 2)
        at += size
        out[n] = value if not size or value >> size - 1 else value - (1 << size) + 1
    return out


# The standard Huffman tables, for frames without tables of their own: numbers of codes of 1, 2, .. 16
# bits, and the values; those of the longest codes are all others, rising.
_DC = (((0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0), range(12)), ((0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0), range(12)))
_AC = (
    ((0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125), "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82"),
    ((0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119), "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1"),
)


def _lookup(counts: bytes | tuple, values: bytes | range) -> tuple[list[int], list[int]]:
    """For each 16 bits that begin with a code: its length (0: none) and its value."""
    length, value, at, k = np.zeros(1 << 16, np.int64), np.zeros(1 << 16, np.int64), 0, 0
    for bits, many in enumerate(counts, 1):
        for _ in range(many):
            end = at + (1 << 16 - bits)
            length[at:end], value[at:end] = bits, values[k]
            at, k = end, k + 1
    return length.tolist(), value.tolist()


@lru_cache(maxsize=1)
def _standard_tables() -> dict[int, tuple[list[int], list[int]]]:
    tables = {k: _lookup(*_DC[k]) for k in (0, 1)}
    every = {run << 4 | size for run in range(16) for size in range(1, 11)} | {0x00, 0xF0}
    for k, (counts, first) in enumerate(_AC):
        values = bytes.fromhex(first)
        tables[0x10 | k] = _lookup(counts, values + bytes(sorted(every - set(values))))
    return tables


def _zigzag() -> np.ndarray:
    """Where the k-th coefficient of a block stands in it: along rising diagonals, in turn from either end."""
    cells = [(y, x) for y in range(8) for x in range(8)]
    return np.array([8 * y + x for y, x in sorted(cells, key=lambda c: (sum(c), c[0] if sum(c) % 2 else c[1]))])


_ZIGZAG = _zigzag()
_COSINES = np.array([[np.cos((2 * x + 1) * u * np.pi / 16) * (np.sqrt(1 / 8) if u == 0 else 0.5) for x in range(8)] for u in range(8)])


class _Bits:
    """The 16 bits from each bit on, of entropy-coded data without stuffing."""

    def __init__(self, data: bytes):
        x = np.frombuffer(data + b"\xff\xff\xff", np.uint8).astype(np.int64)
        wide = x[:-2] << 16 | x[1:-1] << 8 | x[2:]
        self.ahead = ((wide[:, None] >> np.arange(8, 0, -1)) & 0xFFFF).ravel().tolist()
        self.at = 0

    def value(self, table: tuple[list[int], list[int]]) -> int:
        ahead = self.ahead[self.at]
        if not table[0][ahead]:
            raise ValueError("no such code")
        self.at += table[0][ahead]
        return table[1][ahead]

    def number(self, size: int) -> int:
        if not size:
            return 0
        value = self.ahead[self.at] >> 16 - size
        self.at += size
        return value if value >> size - 1 else value - (1 << size) + 1


def _baseline(jpeg: bytes) -> np.ndarray:
    """The luminance of a baseline frame: Huffman decoding of all components, inverse DCT of the first."""
    tables = dict(_standard_tables())
    steps: dict[int, np.ndarray] = {}
    parts: list[list[int]] = []  # of each component: id, sampling across and down, its step table, its DC and AC tables
    at = 2
    height = width = restart = 0
    while True:
        marker, size = jpeg[at + 1], struct.unpack_from(">H", jpeg, at + 2)[0]
        body = jpeg[at + 4 : at + 2 + size]
        if jpeg[at] != 0xFF or size < 2:
            raise ValueError("not a JPEG segment")
        if marker == 0xDB:
            k = 0
            while k < len(body):
                wide = body[k] >> 4
                steps[body[k] & 15] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, k + 1).astype(np.float64)
                k += 1 + 64 * (1 + wide)
        elif marker == 0xC4:
            k = 0
            while k < len(body):
                many = sum(body[k + 1 : k + 17])
                tables[body[k]] = _lookup(body[k + 1 : k + 17], body[k + 17 : k + 17 + many])
                k += 17 + many
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack(">BHHB", body[:6])
            if bits != 8 or not height or not width:
                raise ValueError("not an 8-bit frame of known size")
            parts = [[body[k], body[k + 1] >> 4, body[k + 1] & 15, body[k + 2]] for k in range(6, 6 + 3 * n, 3)]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            if not parts or body[0] != len(parts):
                raise ValueError("not one baseline scan of all components")
            for part, k in zip(parts, range(1, 1 + 2 * body[0], 2)):
                part += [body[k + 1] >> 4, 0x10 | body[k + 1] & 15]
            at += 2 + size
            break
        elif 0xC2 <= marker <= 0xCF and marker not in (0xC8, 0xCC):
            raise ValueError("neither a baseline nor a lossless frame")
        at += 2 + size
    across, down = max(p[1] for p in parts), max(p[2] for p in parts)
    if len(parts) == 1:
        parts[0][1:3] = across, down = 1, 1
    columns, rows = -(-width // (8 * across)), -(-height // (8 * down))
    pieces = [p.replace(b"\xff\0", b"\xff") for p in re.split(b"\xff[\xd0-\xd7]", jpeg[at : jpeg.rfind(b"\xff\xd9")])]
    h, v = parts[0][1:3]
    blocks = np.zeros((rows * v, columns * h, 64))
    unit = 0
    for piece in pieces:
        bits, last = _Bits(piece), [0] * len(parts)
        for _ in range(min(restart or rows * columns, rows * columns - unit)):
            for n, (_, own_h, own_v, _, dc, ac) in enumerate(parts):
                for k in range(own_h * own_v):
                    last[n] += bits.number(bits.value(tables[dc]))
                    found = [(0, last[n])]
                    c = 1
                    while c < 64:
                        run, size = divmod(bits.value(tables[ac]), 16)
                        if not size and run < 15:
                            break
                        c += run
                        if size:
                            found.append((c, bits.number(size)))
                        c += 1
                    if n == 0:
                        block = blocks[unit // columns * v + k // h, unit % columns * h + k % h]
                        for c, x in found:
                            block[c] = x
            unit += 1
    if unit < rows * columns:
        raise ValueError("the frame is cut off")
    natural = np.zeros_like(blocks)
    natural[:, :, _ZIGZAG] = blocks * steps[parts[0][3]]
    samples = np.einsum("ux,rcuv,vy->rxcy", _COSINES, natural.reshape(*natural.shape[:2], 8, 8), _COSINES)
    grey = np.clip(np.rint(samples + 128), 0, 255).astype(np.uint8).reshape(rows * v * 8, columns * h * 8)
    return grey.repeat(down // v, axis=0).repeat(across // h, axis=1)[:height, :width]


def read_avi(media: bytes) -> tuple[np.ndarray, float]:
    """The frames (number, height, width) and frames a second."""
    try:
        return _read_avi(media)
    except (struct.error, IndexError, KeyError) as broken:
        raise ValueError(f"the media are cut off or damaged: {broken!r}") from broken


def _read_avi(media: bytes) -> tuple[np.ndarray, float]:
    places, rate = _frame_places(media)
    if not places:
        return np.empty((0, HEIGHT, WIDTH), np.uint8), rate
    if places[-1][1] > len(media):
        raise ValueError("the media are cut off")
    jpegs = [media[a:b] for a, b in places if b > a]  # a chunk without data repeats the frame before it
    if all(b"\xff\xc3" not in j[:600] for j in jpegs):
        frames = [_baseline(j) for j in jpegs]
        if len({f.shape for f in frames}) > 1:
            raise ValueError("frames of several sizes")
        return np.stack(frames), rate
    begin, height, width, table = _jpeg_layout(jpegs[0])
    head = jpegs[0][:begin]
    coded = []
    for jpeg in jpegs:
        if not jpeg.startswith(head):
            raise ValueError("frames of several kinds")
        coded.append(jpeg[begin:-2].replace(b"\xff\0", b"\xff"))
    if table == (_LENGTHS, _SYMBOLS):
        d = _BACK[np.frombuffer(b"".join(coded), ">u2")]
    else:
        d = np.concatenate([_decode_bits(c, table, height * width) for c in coded])
    return _samples(d.reshape(-1, height, width)), rate


def shots(frames: np.ndarray, bins: int = 32, reach: int = 8, deviations: float = 3.0, least: float = 0.2) -> np.ndarray:
    """The first frame of each shot.

    A cut is where the L1 difference of neighbouring frames' histograms (0 to 1) is at least `least` and
    exceeds the mean of the up to 2 * reach differences around it by `deviations` standard deviations.
    """
    n = len(frames)
    if n < 2:
        return np.arange(n)
    cell = (frames.reshape(n, -1) // (256 // bins)).astype(np.int64) + np.arange(n)[:, None] * bins
    hist = np.bincount(cell.ravel(), minlength=n * bins).reshape(n, bins) / frames[0].size
    change = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    one, two = np.cumsum(np.append(0, change)), np.cumsum(np.append(0, change**2))
    at = np.arange(n - 1)
    low, high = np.maximum(at - reach, 0), np.minimum(at + reach + 1, n - 1)
    others = np.maximum(high - low - 1, 1)
    mean = (one[high] - one[low] - change) / others
    spread = np.sqrt(np.maximum((two[high] - two[low] - change**2) / others - mean**2, 0))
    return np.append(0, np.flatnonzero((change >= least) & (change > mean + deviations * spread)) + 1)


def clip_rows(frames: np.ndarray, rate: float) -> list[dict]:
    starts = shots(frames)
    ends = np.append(starts[1:], len(frames)) if len(starts) else starts
    return [
        {"start": a, "end": b, "start_s": round(a / rate, 3), "end_s": round(b / rate, 3), "mean": round(float(frames[a:b].mean()), 3)}
        for a, b in zip(starts.tolist(), ends.tolist())
    ]


def padded(data: bytes) -> bytes:
    """data with bytes 255 up to a positive multiple of FRAME."""
    return data + b"\xff" * (-len(data) % FRAME or (FRAME if not data else 0))


def store_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes of the text in UTF-8, media (the AVI of its padded bytes), payload and clips read back from it."""
    source = keyed_text(docs, id_col, text_col)
    kind = source.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for low in range(0, batch.num_rows, 200):
                part = batch.slice(low, 200)
                sizes, stored, back, clips = [], [], [], []
                for text in part.column("text").to_pylist():
                    data = text.encode() if text else b""
                    media = write_avi(padded(data))
                    frames, rate = read_avi(media)
                    sizes.append(len(data))
                    stored.append(media)
                    back.append(frames.tobytes())
                    clips.append(clip_rows(frames, rate))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(stored, pa.binary()), pa.array(back, pa.binary()), pa.array(clips, pa.list_(CLIP))],
                    names=["doc_id", "n_bytes", "media", "payload", "clips"],
                )

    return source.mapInArrow(run, f"doc_id {kind}, n_bytes long, media binary, payload binary, clips {_CLIPS_SQL}")


def clips_of(table: DataFrame, id_col: str, media_col: str) -> DataFrame:
    """One row per clip of a media column: id, clip number, start, end, start_s, end_s, mean, reason.

    Media that can't be read give one row with the reason and nulls; null and empty media, and those without
    frames, give no row. An id column that has the name of a result comes back as <name>_input.
    """

    @F.arrow_udf(f"struct<clips:{_CLIPS_SQL},reason:string>")
    def clips(media: pa.Array) -> pa.Array:
        found, reasons = [], []
        for m in media:
            try:
                found.append(clip_rows(*read_avi(m.as_py())) if m.is_valid and len(m.as_py()) else [])
                reasons.append(None)
            except ValueError as bad:
                found.append([None])
                reasons.append(str(bad))
        return pa.StructArray.from_arrays([pa.array(found, pa.list_(CLIP)), pa.array(reasons, pa.string())], ["clips", "reason"])

    rows = table.select(F.col(id_col).alias("_id"), clips(F.col(media_col)).alias("_found"))
    rows = rows.select("_id", F.col("_found.reason").alias("_reason"), F.posexplode("_found.clips").alias("_at", "_clip"))
    fields = [f.name for f in rows.schema["_clip"].dataType.fields]
    key = f"{id_col}_input" if id_col.lower() in ("clip", "reason", *fields) else id_col
    return rows.select(F.col("_id").alias(key), F.when(F.col("_clip").isNotNull(), F.col("_at")).alias("clip"), *[F.col("_clip")[c].alias(c) for c in fields], F.col("_reason").alias("reason"))
