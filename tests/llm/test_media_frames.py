"""Baseline motion-JPEG frames, written here by a plain encoder, and media that can't be read."""

import math
import random
import struct

import numpy as np
import pytest

from sparklog.llm import media

STEPS = [1 + (i * 7) % 5 for i in range(64)]


def _codes(counts, values):
    out, code, k = {}, 0, 0
    for bits, many in enumerate(counts, 1):
        for _ in range(many):
            out[values[k]] = format(code, f"0{bits}b")
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _walk():
    """The zigzag path, step by step."""
    y = x = 0
    up = True
    for _ in range(64):
        yield y, x
        if up and x == 7:
            y, up = y + 1, False
        elif up and y == 0:
            x, up = x + 1, False
        elif up:
            y, x = y - 1, x + 1
        elif y == 7:
            x, up = x + 1, True
        elif x == 0:
            y, up = y + 1, True
        else:
            y, x = y + 1, x - 1


def _dct(block):
    c = lambda u: math.sqrt(0.5) if u == 0 else 1.0
    return [[0.25 * c(u) * c(v) * sum(block[y][x] * math.cos((2 * y + 1) * u * math.pi / 16) * math.cos((2 * x + 1) * v * math.pi / 16) for y in range(8) for x in range(8)) for v in range(8)] for u in range(8)]


def _number(x):
    size = abs(x).bit_length()
    return size, format(x if x > 0 else x + (1 << size) - 1, f"0{size}b") if size else ""


def _block_bits(samples, last, dc, ac):
    f = _dct([[float(s) - 128 for s in row] for row in samples])
    q = [round(f[y][x] / STEPS[k]) for k, (y, x) in enumerate(_walk())]
    size, bits = _number(q[0] - last)
    out, run = dc[size] + bits, 0
    for x in q[1 : max([k for k in range(64) if q[k]], default=0) + 1]:
        if not x:
            run += 1
            continue
        while run > 15:
            out, run = out + ac[0xF0], run - 16
        size, bits = _number(x)
        out, run = out + ac[run << 4 | size] + bits, 0
    return (out + ac[0] if not q[63] else out), q[0]


def jpeg_of(grey, colour=False, tables=True, restart=0):
    """A baseline frame: grey, or with two flat half-size colour components."""
    height, width = grey.shape
    every = sorted({r << 4 | s for r in range(16) for s in range(1, 11)} | {0, 0xF0})
    counts = {"dc": media._DC[0][0], "ac": media._AC[0][0]}
    first = bytes.fromhex(media._AC[0][1])
    values = {"dc": bytes(range(12)), "ac": first + bytes(v for v in every if v not in first)}
    if tables:  # own tables: all values with codes of 8 and 9 bits
        counts["ac"], values["ac"] = (0,) * 7 + (100, 62) + (0,) * 7, bytes(reversed(every))
    dc, ac = _codes(counts["dc"], values["dc"]), _codes(counts["ac"], values["ac"])
    if not tables:  # colour components then have the other standard tables; their blocks are flat
        dc2, ac2 = _codes(*media._DC[1]), {0: "00"}
    else:
        dc2, ac2 = dc, ac
    step = 16 if colour else 8
    padded = np.pad(grey, ((0, -height % step), (0, -width % step)), mode="edge")
    segments, bits, last, last2, unit = [], "", 0, [0, 0], 0
    units = [(y, x) for y in range(0, padded.shape[0], step) for x in range(0, padded.shape[1], step)]
    for y, x in units:
        if restart and unit and unit % restart == 0:
            segments.append(bits)
            bits, last, last2 = "", 0, [0, 0]
        for dy, dx in ((0, 0), (0, 8), (8, 0), (8, 8)) if colour else ((0, 0),):
            more, last = _block_bits(padded[y + dy : y + dy + 8, x + dx : x + dx + 8], last, dc, ac)
            bits += more
        if colour:
            for n in range(2):
                level = 10 * (n + 1)
                size, extra = _number(level - last2[n])
                bits, last2[n] = bits + dc2[size] + extra + ac2[0], level
        unit += 1
    segments.append(bits)
    pack = lambda b: int((b + "1" * (-len(b) % 8)) or "1" * 8, 2).to_bytes(max(1, -(-len(b) // 8)), "big").replace(b"\xff", b"\xff\0")
    data = b"".join((b"\xff" + bytes([0xD0 + (k - 1) % 8]) if k else b"") + pack(s) for k, s in enumerate(segments))
    seg = lambda m, body: b"\xff" + bytes([m]) + struct.pack(">H", len(body) + 2) + body
    parts = [(1, 0x22 if colour else 0x11, 0)] + ([(2, 0x11, 0), (3, 0x11, 0)] if colour else [])
    second = 0 if tables else 0x11
    out = b"\xff\xd8" + seg(0xE0, b"AVI1\0\0") + seg(0xDB, b"\0" + bytes(STEPS))
    if tables:
        out += seg(0xC4, b"\0" + bytes(counts["dc"]) + values["dc"] + b"\x10" + bytes(counts["ac"]) + values["ac"])
    out += seg(0xC0, struct.pack(">BHHB", 8, height, width, len(parts)) + b"".join(bytes(p) for p in parts))
    if restart:
        out += seg(0xDD, struct.pack(">H", restart))
    return out + seg(0xDA, bytes([len(parts)]) + b"".join(bytes([p[0], second if k else 0]) for k, p in enumerate(parts)) + b"\0\x3f\0") + data + b"\xff\xd9"


def avi_of(jpegs, fps=10):
    chunk = media._chunk
    head = chunk(b"avih", struct.pack("<14I", 1_000_000 // fps, *[0] * 13))
    movi = b"movi" + b"".join(chunk(b"00dc", j) for j in jpegs)
    return chunk(b"RIFF", b"AVI " + chunk(b"LIST", b"hdrl" + head) + chunk(b"LIST", movi))


def picture(seed, height, width):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    return np.clip(rng.integers(30, 200) + 40 * np.sin(x / 5 + seed) + 30 * np.cos(y / 7) + rng.normal(0, 6, (height, width)), 0, 255).astype(np.uint8)


@pytest.mark.parametrize("colour", [False, True])
@pytest.mark.parametrize("tables", [False, True])
@pytest.mark.parametrize("restart", [0, 2])
def test_baseline_frames(colour, tables, restart):
    frames = [picture(k, 21, 35) for k in range(2)]
    got, rate = media.read_avi(avi_of([jpeg_of(f, colour, tables, restart) for f in frames]))
    assert got.shape == (2, 21, 35) and rate == 10
    assert np.abs(got.astype(int) - np.stack(frames)).max() <= 8  # quantized by up to 5


def test_standard_tables_are_complete():
    tables = media._standard_tables()
    for k in (0x10, 0x11):
        assert sum(media._AC[k & 1][0]) == 162 and len(set(tables[k][1])) == 162
        assert sum(1 for n in tables[k][0] if not n) <= 2  # all ones is no code
    assert media._ZIGZAG.tolist() == [8 * y + x for y, x in _walk()]


def test_clips_of_good_and_bad_media(spark):
    rng = random.Random(1)
    shots = [jpeg_of(np.full((8, 8), v, np.uint8)) for v in [40] * 10 + [220] * 10]
    good = avi_of(shots)
    own = media.write_avi(bytes(rng.randrange(256) for _ in range(576 * 3)))
    rows = [(1, good), (2, good[: len(good) // 2]), (3, b"no media"), (4, None), (5, b""), (6, own), (7, own[:-700]), (8, avi_of([b"\xff\xd8\xff\xc2\0\x08123456"])), (9, good)]
    out = media.clips_of(spark.createDataFrame(rows, "id long, media binary"), "id", "media").collect()
    found = {}
    for r in out:
        found.setdefault(r["id"], []).append(r)
    assert sorted(found) == [1, 2, 3, 6, 7, 8, 9]
    assert [(r["clip"], r["start"], r["end"], r["start_s"], r["end_s"], r["reason"]) for r in sorted(found[1], key=lambda r: r["clip"])] == [(0, 0, 10, 0.0, 1.0, None), (1, 10, 20, 1.0, 2.0, None)]
    assert [r[1:] for r in found[9]] == [r[1:] for r in found[1]]
    for k in (2, 3, 7, 8):
        assert len(found[k]) == 1 and found[k][0]["clip"] is None and found[k][0]["start"] is None and found[k][0]["reason"]
    assert all(r["reason"] is None and r["clip"] is not None for r in found[6])


def test_shots_against_brute_force():
    rng = random.Random(4)
    for _ in range(20):
        frames = np.array([[[rng.choice((level, level + 60)) for _ in range(4)] for _ in range(4)] for level in (rng.choice((0, 0, 0, 90)) for _ in range(rng.randint(0, 40)))], np.uint8).reshape(-1, 4, 4)
        n = len(frames)
        hist = [[sum(v // 8 == b for v in f.ravel().tolist()) / 16 for b in range(32)] for f in frames]
        change = [sum(abs(a - b) for a, b in zip(hist[k], hist[k + 1])) / 2 for k in range(n - 1)]
        want = [0] if n else []
        for k in range(n - 1):
            near = [change[j] for j in range(max(0, k - 8), min(n - 1, k + 9)) if j != k]
            mean = sum(near) / max(1, len(near))
            spread = math.sqrt(max(0.0, sum(x * x for x in near) / max(1, len(near)) - mean**2))
            if change[k] >= 0.2 - 1e-12 and change[k] > mean + 3 * spread + 1e-9:
                want.append(k + 1)
        got = media.shots(frames).tolist()
        assert got == want
