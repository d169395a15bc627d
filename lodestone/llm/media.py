"""AVI motion-JPEG columns: RIFF index parsing, intra-frame decoding, shots.

Bytes are stored losslessly as 8-bit samples of grey baseline JPEG frames: one
sample is one 8 x 8 block of that grey value, whose only coefficient is the DC
term (quantised by 8, so that it is the value itself).  The DC code table gives
category s a code of 9 - s bits, so that code and extra bits make 9 bits for
any difference; together with the one-bit end of block a sample takes 10 bits
at a known place.  Any baseline decoder can read such frames; the decoder here
does so with array operations where the tables have that property.  All other
baseline motion-JPEG is decoded by the general Huffman and inverse cosine way:
grey or colour with any sampling, restart intervals, and the default code
tables where a frame brings none.

Frames are indexed in ``idx1``, by offsets from the frame list or from the
file's beginning; reading goes by that index or, where there is none, by
walking the list and its ``rec `` parts.  A frame of no bytes repeats the one
before.  Shots are found from differences between neighbouring frames'
histograms of brightness against a threshold that adapts to the differences
around; padding is not counted.

Defined results: a null text is an empty one (one frame of padding); repeated
rows are stored each by itself; equal payloads give equal files; ids may be of
any type; an empty table gives an empty result; a null, damaged or unsupported
file is a row with null results and an ``error``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import slices

SIDE = 24
SAMPLES = SIDE * SIDE
PAD = 255
FPS = 25

#: Fixed value: the zig-zag order of T.81, figure A.6, as a rule below.
ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, (i // 8 if (i // 8 + i % 8) % 2 else i % 8))), np.int64)


def segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def dht(table: int, lengths: dict[int, int]) -> bytes:
    """A Huffman table segment from symbol: code length."""
    by = [sorted(s for s, n in lengths.items() if n == k) for k in range(1, 17)]
    return segment(0xC4, bytes([table, *map(len, by)]) + bytes(s for group in by for s in group))


def jpeg_head(width: int, height: int, quant: list[int], dc: dict[int, int], ac: dict[int, int]) -> bytes:
    """Everything before the coded data of a grey baseline frame."""
    return b"".join(
        (
            b"\xff\xd8",
            segment(0xDB, bytes([0, *quant])),
            segment(0xC0, struct.pack(">BHHBBBB", 8, height, width, 1, 1, 0x11, 0)),
            dht(0x00, dc),
            dht(0x10, ac),
            segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0])),
        )
    )


#: Code lengths by category: 9 - s bits of code and s extra bits for a difference of s bits.
DC_LENGTHS = {s: 9 - s for s in range(9)}
AC_LENGTHS = {0x00: 1}
HEAD = jpeg_head(8 * SIDE, 8 * SIDE, [8] * 64, DC_LENGTHS, AC_LENGTHS)


def canonical(counts: list[int], symbols: list[int]) -> dict[int, tuple[int, int]]:
    """symbol: (code, bits), as T.81 annex C assigns them."""
    out, code, at = {}, 0, 0
    for bits, n in enumerate(counts, 1):
        for s in symbols[at : at + n]:
            out[s] = (code, bits)
            code += 1
        at += n
        code <<= 1
    return out


@lru_cache(maxsize=1)
def _difference_words() -> np.ndarray:
    """The 10-bit word (code, extra bits, end of block) of each difference from -255 to 255."""
    codes = canonical([sum(n == k for n in DC_LENGTHS.values()) for k in range(1, 17)], sorted(DC_LENGTHS, key=lambda s: (DC_LENGTHS[s], s)))
    out = np.zeros(511, np.uint16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        extra = d if d >= 0 else d + (1 << s) - 1
        out[d + 255] = (codes[s][0] << s | extra) << 1
    return out


@lru_cache(maxsize=1)
def _word_differences() -> np.ndarray:
    out = np.full(1024, 1 << 14, np.int16)
    out[_difference_words()] = np.arange(-255, 256)
    return out


def frames_coded(samples: np.ndarray) -> list[bytes]:
    """A JPEG file per row of SAMPLES bytes."""
    x = samples.astype(np.int16) - 128
    x[:, 1:] -= x[:, :-1].copy()
    # the DC prediction starts at 0 in each frame
    words = _difference_words()[x + 255].reshape(len(x), -1, 4)
    packed = np.empty((len(x), SAMPLES // 4, 5), np.uint8)
    a, b, c, d = (words[:, :, k] for k in range(4))
    packed[:, :, 0] = a >> 2
    packed[:, :, 1] = (a & 3) << 6 | b >> 4
    packed[:, :, 2] = (b & 15) << 4 | c >> 6
    packed[:, :, 3] = (c & 63) << 2 | d >> 8
    packed[:, :, 4] = d & 255
    rows = packed.reshape(len(x), -1)
    return [HEAD + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in rows]


#: The default code tables of T.81, annex K.3: codes by length, symbols in order.
DEFAULT_TABLES = {
    0x00: (bytes([0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x01: (bytes([0, 3, 1, 1, 1, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0]), bytes(range(12))),
    0x10: (
        bytes([0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]),
        bytes.fromhex(
            "01 02 03 00 04 11 05 12 21 31 41 06 13 51 61 07 22 71 14 32 81 91 a1 08 23 42 b1 c1 15 52 d1 f0 24 33 62 72 82 09 0a 16 17 18 19 1a 25 26 27 28 29 2a 34 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e1 e2 e3 e4 e5 e6 e7 e8 e9 ea f1 f2 f3 f4 f5 f6 f7 f8 f9 fa"
        ),
    ),
    0x11: (
        bytes([0, 2, 1, 2, 4, 4, 3, 4, 7, 5, 4, 4, 0, 1, 2, 119]),
        bytes.fromhex(
            "00 01 02 03 11 04 05 21 31 06 12 41 51 07 61 71 13 22 32 81 08 14 42 91 a1 b1 c1 09 23 33 52 f0 15 62 72 d1 0a 16 24 34 e1 25 f1 17 18 19 1a 26 27 28 29 2a 35 36 37 38 39 3a 43 44 45 46 47 48 49 4a 53 54 55 56 57 58 59 5a 63 64 65 66 67 68 69 6a 73 74 75 76 77 78 79 7a 82 83 84 85 86 87 88 89 8a 92 93 94 95 96 97 98 99 9a a2 a3 a4 a5 a6 a7 a8 a9 aa b2 b3 b4 b5 b6 b7 b8 b9 ba c2 c3 c4 c5 c6 c7 c8 c9 ca d2 d3 d4 d5 d6 d7 d8 d9 da e2 e3 e4 e5 e6 e7 e8 e9 ea f2 f3 f4 f5 f6 f7 f8 f9 fa"
        ),
    ),
}

#: A code table as (symbol, code, bits) rows.
Table = tuple[tuple[int, int, int], ...]


def _table(counts: bytes, symbols: bytes) -> Table:
    return tuple((s, c, b) for s, (c, b) in canonical(list(counts), list(symbols)).items())


@dataclass(frozen=True)
class Component:
    """One colour plane: samples per unit across and down, and its tables."""

    across: int
    down: int
    quant: tuple[int, ...]
    dc: Table
    ac: Table


@dataclass(frozen=True)
class Head:
    width: int
    height: int
    parts: tuple[Component, ...]
    restart: int
    size: int

    @property
    def flat(self) -> bool:
        """Whether every sample takes 10 bits at a known place."""
        own = parse_head(HEAD)
        return len(self.parts) == 1 and (self.parts[0].dc, self.parts[0].ac) == (own.parts[0].dc, own.parts[0].ac) and self.parts[0].quant[0] == 8 and not self.restart

    @property
    def units(self) -> tuple[int, int]:
        """Coded units across and down."""
        a, d = max(p.across for p in self.parts), max(p.down for p in self.parts)
        return -(-self.width // (8 * a)), -(-self.height // (8 * d))


@lru_cache(maxsize=64)
def parse_head(data: bytes) -> Head:
    """Tables and sizes of a baseline frame, up to its coded data."""
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG file")
    at, quant, size, restart = 2, {}, None, 0
    tables = {k: _table(*t) for k, t in DEFAULT_TABLES.items()}
    while True:
        if at + 4 > len(data) or data[at] != 0xFF:
            raise ValueError("marker expected")
        if data[at + 1] == 0xFF:  # filling
            at += 1
            continue
        marker, n = data[at + 1], int.from_bytes(data[at + 2 : at + 4], "big")
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                step = 2 if wide else 1
                quant[body[0] & 15] = tuple(int.from_bytes(body[1 + k * step : 1 + (k + 1) * step], "big") for k in range(64))
                body = body[1 + 64 * step :]
        elif marker == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _table(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif marker == 0xDD:
            restart = int.from_bytes(body[:2], "big")
        elif marker in (0xC0, 0xC1):
            depth, height, width, n_parts = struct.unpack(">BHHB", body[:6])
            if depth != 8 or n_parts not in (1, 3) or not width or not height:
                raise ValueError("only frames of 8 bits in one or three colours")
            size = width, height, {body[6 + 3 * k]: (body[7 + 3 * k] >> 4, body[7 + 3 * k] & 15, body[8 + 3 * k]) for k in range(n_parts)}
        elif 0xC2 <= marker <= 0xCF and marker != 0xC8 and marker != 0xCC:
            raise ValueError("only baseline frames")
        elif marker == 0xDA:
            if size is None or body[0] != len(size[2]):
                raise ValueError("no frame header, or colours in scans of their own")
            parts = []
            for k in range(body[0]):
                across, down, q = size[2][body[1 + 2 * k]]
                if len(size[2]) == 1:
                    across = down = 1
                use = body[2 + 2 * k]
                if not 1 <= across <= 4 or not 1 <= down <= 4:
                    raise ValueError("sampling out of range")
                parts.append(Component(across, down, quant[q], tables[use >> 4], tables[0x10 | use & 15]))
            return Head(size[0], size[1], tuple(parts), restart, at)


@lru_cache(maxsize=1)
def _cosines() -> np.ndarray:
    k, x = np.arange(8)[:, None], np.arange(8)[None, :]
    return np.where(k == 0, np.sqrt(1 / 8), 0.5) * np.cos((2 * x + 1) * k * np.pi / 16)


@lru_cache(maxsize=64)
def _lookup(table: Table) -> list[tuple[int, int]]:
    """(bits, symbol) by the next 16 bits; 0 bits where they are no code."""
    out = [(0, 0)] * (1 << 16)
    for symbol, code, bits in table:
        first = code << (16 - bits)
        out[first : first + (1 << (16 - bits))] = [(bits, symbol)] * (1 << (16 - bits))
    return out


def _windows(coded: bytes) -> list[int]:
    """The 16 bits from each bit place on, filled with ones."""
    b = np.frombuffer(coded.replace(b"\xff\x00", b"\xff") + b"\xff\xff\xff", np.uint8).astype(np.int64)
    three = b[:-2] << 16 | b[1:-1] << 8 | b[2:]
    return (three[:, None] >> np.arange(8, 0, -1) & 0xFFFF).ravel().tolist()


_RESTART = re.compile(rb"\xff[\xd0-\xd7]")


def planes_coded(head: Head, coded: bytes) -> list[np.ndarray]:
    """Quantised coefficients of each colour, (block, 64) in natural order, blocks by rows of the whole units."""
    across, down = head.units
    out = [np.zeros((down * p.down, across * p.across, 64), np.int64) for p in head.parts]
    looks = [(_lookup(p.dc), _lookup(p.ac)) for p in head.parts]
    zigzag = ZIGZAG.tolist()
    total = across * down
    per = head.restart or total
    pieces = _RESTART.split(coded) if head.restart else [coded]
    if len(pieces) < -(-total // per):
        raise ValueError("a frame's data are cut off")
    for piece, first in zip(pieces, range(0, total, per)):
        w = _windows(piece)
        w += [0xFFFF] * 64
        end, at = len(w) - 64, 0
        dc = [0] * len(head.parts)
        for unit in range(first, min(first + per, total)):
            row, column = divmod(unit, across)
            for c, part in enumerate(head.parts):
                by_dc, by_ac = looks[c]
                for j in range(part.down):
                    for i in range(part.across):
                        block = out[c][row * part.down + j, column * part.across + i]
                        bits, n = by_dc[w[at]]
                        if not bits:
                            raise ValueError("no such code")
                        at += bits
                        if n:
                            v = w[at] >> (16 - n)
                            dc[c] += v if v >> (n - 1) else v - (1 << n) + 1
                            at += n
                        block[0] = dc[c]
                        k = 1
                        while k < 64:
                            bits, s = by_ac[w[at]]
                            if not bits:
                                raise ValueError("no such code")
                            at += bits
                            n = s & 15
                            k += s >> 4
                            if n == 0:
                                if s >> 4 < 15:
                                    break
                                k += 1
                                continue
                            if k > 63:
                                raise ValueError("too many coefficients")
                            v = w[at] >> (16 - n)
                            block[zigzag[k]] = v if v >> (n - 1) else v - (1 << n) + 1
                            at += n
                            k += 1
                        if at > end:
                            raise ValueError("a frame's data are cut off")
    return [x.reshape(-1, 64) for x in out]


def coefficients(head: Head, coded: bytes) -> np.ndarray:
    """Quantised coefficients of the first colour."""
    return planes_coded(head, coded)[0]


def pixels(head: Head, quantised: np.ndarray, part: int = 0) -> np.ndarray:
    """The samples (height, width) of one colour's coefficients, at that colour's own size."""
    own = head.parts[part]
    most_a, most_d = max(p.across for p in head.parts), max(p.down for p in head.parts)
    natural = np.empty(64, np.int64)
    natural[ZIGZAG] = own.quant
    c = _cosines()
    blocks = c.T @ (quantised * natural).reshape(-1, 8, 8) @ c
    across, down = head.units[0] * own.across, head.units[1] * own.down
    picture = blocks.reshape(down, across, 8, 8).transpose(0, 2, 1, 3).reshape(8 * down, 8 * across)
    height, width = -(-head.height * own.down // most_d), -(-head.width * own.across // most_a)
    return np.clip(np.rint(picture + 128), 0, 255).astype(np.uint8)[:height, :width]


def frame_planes(data: bytes) -> tuple[Head, list[np.ndarray]]:
    """A frame's colours (brightness first), each at its own size."""
    head = parse_head(data)
    end = data.rfind(b"\xff\xd9")
    if end < head.size:
        raise ValueError("no end of image")
    return head, [pixels(head, q, k) for k, q in enumerate(planes_coded(head, data[head.size : end]))]


def rgb(data: bytes) -> np.ndarray:
    """A frame as (height, width, 3) of red, green and blue."""
    head, parts = frame_planes(data)
    y = parts[0].astype(float)
    if len(parts) == 1:
        return np.repeat(parts[0][:, :, None], 3, axis=2)
    rows, columns = np.arange(head.height), np.arange(head.width)
    most_a, most_d = max(p.across for p in head.parts), max(p.down for p in head.parts)
    full = [x[(rows * p.down // most_d)[:, None], columns * p.across // most_a].astype(float) for x, p in zip(parts, head.parts)]
    y, cb, cr = full[0], full[1] - 128, full[2] - 128
    out = np.stack([y + 1.402 * cr, y - 0.344136 * cb - 0.714136 * cr, y + 1.772 * cb], axis=2)
    return np.clip(np.rint(out), 0, 255).astype(np.uint8)


def own_frame(data: bytes) -> bool:
    return data.startswith(HEAD)


def frames_decoded(files: list[bytes]) -> np.ndarray:
    """One row of samples (the value of each block's first pixel) per frame file of the size of ours."""
    out = np.empty((len(files), SAMPLES), np.uint8)
    flat, rows = [], []
    for k, data in enumerate(files):
        head = parse_head(HEAD if own_frame(data) else data)
        if data[-2:] != b"\xff\xd9":
            raise ValueError("no end of image")
        if head.flat and (head.width, head.height) == (8 * SIDE, 8 * SIDE):
            plain = data[head.size : -2].replace(b"\xff\x00", b"\xff")
            if len(plain) != SAMPLES * 10 // 8:
                raise ValueError("a frame's data are cut off")
            flat.append(plain)
            rows.append(k)
        else:
            head, parts = frame_planes(data)
            if len(parts) != 1 or parts[0].shape != (8 * SIDE, 8 * SIDE):
                raise ValueError("another frame size")
            out[k] = parts[0][::8, ::8].ravel()
    if flat:
        p = np.frombuffer(b"".join(flat), np.uint8).reshape(len(flat), -1, 5).astype(np.uint16)
        words = np.empty((len(flat), SAMPLES // 4, 4), np.uint16)
        words[:, :, 0] = p[:, :, 0] << 2 | p[:, :, 1] >> 6
        words[:, :, 1] = (p[:, :, 1] & 63) << 4 | p[:, :, 2] >> 4
        words[:, :, 2] = (p[:, :, 2] & 15) << 6 | p[:, :, 3] >> 2
        words[:, :, 3] = (p[:, :, 3] & 3) << 8 | p[:, :, 4]
        differences = _word_differences()[words.reshape(len(flat), -1)]
        if (differences == 1 << 14).any():
            raise ValueError("no such code")
        out[rows] = (np.cumsum(differences, axis=1, dtype=np.int32) + 128).astype(np.uint8)
    return out


def chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def avi(frames: list[bytes], width: int = 8 * SIDE, height: int = 8 * SIDE, fps: int = FPS) -> bytes:
    """An AVI file of JPEG frames with its index."""
    n, most = len(frames), max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, n, 0, 1, most, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIiI4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, n, most, -1, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    header = b"LIST" + struct.pack("<I", 4 + 8 + len(avih) + 8 + 4 + 8 + len(strh) + 8 + len(strf)) + b"hdrl" + chunk(b"avih", avih)
    header += b"LIST" + struct.pack("<I", 4 + 8 + len(strh) + 8 + len(strf)) + b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)
    parts, index, at = [], [], 4
    for f in frames:
        parts.append(chunk(b"00dc", f))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    movi = b"LIST" + struct.pack("<I", at) + b"movi" + b"".join(parts)
    body = b"AVI " + header + movi + chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


@dataclass(frozen=True)
class Movie:
    fps: float
    frames: list[bytes]


def _chunks(data: bytes, at: int, end: int) -> Iterator[tuple[bytes, int, int]]:
    """(name, place of the body, its size) of the chunks from ``at`` on."""
    while at + 8 <= end:
        name, n = data[at : at + 4], int.from_bytes(data[at + 4 : at + 8], "little")
        if at + 8 + n > end:
            raise ValueError("a part of the file is cut off")
        yield name, at + 8, n
        at += 8 + n + n % 2


def _walked(data: bytes, at: int, end: int) -> Iterator[bytes]:
    """Frames in the order they lie in, also those in lists."""
    for name, place, n in _chunks(data, at, end):
        if name == b"LIST":
            yield from _walked(data, place + 4, place + n)
        elif name[2:] in (b"dc", b"db"):
            yield data[place : place + n]


def read_avi(data: bytes) -> Movie:
    """The frames of an AVI file by its index."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    end, movi, index, rate = 8 + int.from_bytes(data[4:8], "little"), None, None, None
    if end > len(data):
        raise ValueError("the file is cut off")
    for name, at, n in _chunks(data, 12, end):
        if name == b"LIST" and data[at : at + 4] == b"movi":
            movi = at, at + n
        elif name == b"LIST" and data[at : at + 4] == b"hdrl":
            for part, place, _ in _chunks(data, at + 4, at + n):
                if part == b"avih":
                    micros = int.from_bytes(data[place : place + 4], "little")
                    rate = 1e6 / micros if micros else rate
                elif part == b"LIST" and data[place : place + 4] == b"strl" and rate is None and data[place + 12 : place + 16] == b"vids":
                    scale, per = struct.unpack("<II", data[place + 32 : place + 40])
                    rate = per / scale if scale and per else None
        elif name == b"idx1":
            index = data[at : at + n]
    if movi is None or rate is None:
        raise ValueError("no frames or no header")
    if index is None:
        found = list(_walked(data, movi[0] + 4, movi[1]))
    else:
        found, base = [], None
        if len(index) % 16:
            raise ValueError("the index is cut off")
        for name, _, place, size in struct.iter_unpack("<4sIII", index):
            if name[2:] not in (b"dc", b"db"):
                continue
            if base is None:  # offsets count from the list's name or from the file's beginning
                base = next((b for b in (movi[0], 0) if data[b + place : b + place + 4] == name), movi[0])
            start = base + place
            if data[start : start + 4] != name or int.from_bytes(data[start + 4 : start + 8], "little") != size or start + 8 + size > end:
                raise ValueError("the index doesn't fit the frames")
            found.append(data[start + 8 : start + 8 + size])
    out: list[bytes] = []
    for f in found:
        if f or out:
            out.append(f or out[-1])
    return Movie(rate, out)


def payload_of(text: str | None) -> tuple[bytes, int]:
    """The text's bytes, padded to a positive multiple of SAMPLES, and their number before."""
    raw = b"" if text is None else text.encode("utf-8", "surrogatepass")
    return raw + bytes([PAD]) * (-len(raw) % SAMPLES if raw else SAMPLES), len(raw)


def histograms(samples: np.ndarray, bins: int = 16, valid: int | None = None) -> np.ndarray:
    """How many samples of each frame lie in each range, of the first ``valid`` ones of all frames."""
    n = len(samples)
    cell = ((samples // (256 // bins)).astype(np.int64) + np.arange(n)[:, None] * bins).ravel()
    return np.bincount(cell[:valid], minlength=n * bins).reshape(n, bins)


def shot_starts(hist: np.ndarray, window: int = 8, factor: float = 3.0, least: float = 0.2, filled: float = 0.5) -> np.ndarray:
    """First frames of the shots.

    A frame starts a shot if its share of samples by range differs from the
    one before by more than the mean of the differences within ``window``
    frames on either side, plus ``factor`` of their standard deviations
    (itself not counted), and by at least ``least`` of a frame.  A frame with
    fewer samples than ``filled`` of the largest says too little: it belongs
    to the shot before.
    """
    sums = hist.sum(axis=1)
    full = sums >= max(filled * sums.max(initial=0), 1)
    share = hist / np.maximum(sums, 1)[:, None]
    d = np.where(full[1:], np.abs(np.diff(share, axis=0)).sum(axis=1) / 2.0, 0.0)
    if not len(d):
        return np.zeros(1, np.int64)
    one, two = np.concatenate(([0.0], np.cumsum(d))), np.concatenate(([0.0], np.cumsum(d * d)))
    i = np.arange(len(d))
    lo, hi = np.maximum(i - window, 0), np.minimum(i + window + 1, len(d))
    n = np.maximum(hi - lo - 1, 1)
    mean = np.maximum(one[hi] - one[lo] - d, 0) / n
    spread = np.sqrt(np.maximum((two[hi] - two[lo] - d * d) / n - mean * mean, 0))
    return np.concatenate(([0], 1 + np.flatnonzero((d >= least) & (d > mean + factor * spread + 1e-12))))


def clips_of(hist: np.ndarray, fps: float = FPS) -> list[tuple[int, int, float, float]]:
    """(first frame, frames, start second, end second) of each shot, from the frames' histograms."""
    if not len(hist):
        return []
    starts = shot_starts(hist).tolist()
    ends = [*starts[1:], len(hist)]
    return [(a, b - a, a / fps, b / fps) for a, b in zip(starts, ends)]


def clips(samples: np.ndarray, fps: float = FPS, valid: int | None = None) -> list[tuple[int, int, float, float]]:
    """The shots of frames of samples, of which the first ``valid`` count."""
    return clips_of(histograms(samples, valid=valid), fps)


def _groups(sizes: list[int], most: int = 1 << 22) -> Iterator[range]:
    """Consecutive rows of together about ``most`` bytes; a longer row is a group of its own."""
    start, total = 0, 0
    for k, n in enumerate(sizes):
        if k > start and total + n > most:
            yield range(start, k)
            start, total = k, 0
        total += n
    if start < len(sizes):
        yield range(start, len(sizes))


def _store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches):
        payloads = [payload_of(x) for x in batch.column(1).to_pylist()]
        for group in _groups([len(p) for p, _ in payloads]):
            samples = np.frombuffer(b"".join(payloads[k][0] for k in group), np.uint8).reshape(-1, SAMPLES)
            files = frames_coded(samples)
            media, at = [], 0
            for k in group:
                n = len(payloads[k][0]) // SAMPLES
                media.append(avi(files[at : at + n]))
                at += n
            ids = batch.column(0).slice(group.start, len(group))
            yield pa.RecordBatch.from_arrays([ids, pa.array([payloads[k][1] for k in group], pa.int64()), pa.array(media, pa.binary())], names=["id", "n_bytes", "media"])


STORED = T.StructType([T.StructField("id", T.LongType()), T.StructField("n_bytes", T.LongType()), T.StructField("media", T.BinaryType())])


def _of(schema: T.StructType, kind: T.DataType) -> T.StructType:
    """The schema with an id of that type."""
    return T.StructType([T.StructField("id", kind), *schema.fields[1:]])


_CLIP = T.StructType([T.StructField("first", T.LongType()), T.StructField("frames", T.LongType()), T.StructField("start_s", T.DoubleType()), T.StructField("end_s", T.DoubleType())])
READ = T.StructType(
    [T.StructField(n, T.LongType()) for n in ("id", "n_bytes", "payload_bytes")]
    + [T.StructField("payload_sha256", T.StringType()), T.StructField("tail_crc32", T.LongType()), T.StructField("media_bytes", T.LongType()), T.StructField("media_sha256", T.StringType()), T.StructField("clips", T.ArrayType(_CLIP)), T.StructField("error", T.StringType())]
)


def store(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, media): each text as an AVI file, and its bytes before padding."""
    return df.select(F.col(f"`{key}`"), F.col(f"`{text}`").cast("string")).mapInArrow(_store, _of(STORED, df.schema[key].dataType))


#: What a damaged file can make the parsers raise.
DAMAGED = (ValueError, IndexError, KeyError, struct.error, OverflowError)


def _result(media: bytes, payload: bytes | None, found: list, error: str | None = None) -> tuple:
    named = [dict(zip(("first", "frames", "start_s", "end_s"), c)) for c in found]
    own = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:])) if payload is not None else (None,) * 3
    return (*own, len(media), hashlib.sha256(media).hexdigest(), named, error)


def read_one(media: bytes | None, n_bytes: int | None = None) -> tuple:
    """Payload size and digests, file size and digest, clips, error of one file.

    Frames like ours carry a payload; any other motion-JPEG has clips alone.
    """
    if media is None:
        return (*[None] * 6, "no file")
    try:
        movie = read_avi(media)
        if all(map(own_frame, movie.frames)):
            samples = frames_decoded(movie.frames)
            return _result(media, samples.tobytes(), clips(samples, movie.fps, n_bytes))
        bright = [frame_planes(f)[1][0] for f in movie.frames]
        hist = np.stack([np.bincount(x.ravel() // 16, minlength=16) for x in bright])
        alike = all(x.shape == (8 * SIDE, 8 * SIDE) for x in bright) and all(len(parse_head(f).parts) == 1 for f in movie.frames)
        payload = b"".join(x[::8, ::8].tobytes() for x in bright) if alike else None
        return _result(media, payload, clips_of(hist, movie.fps))
    except DAMAGED as e:
        return (None, None, None, len(media), hashlib.sha256(media).hexdigest(), None, f"{type(e).__name__}: {e}"[:200])


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    clip = pa.list_(pa.struct([("first", pa.int64()), ("frames", pa.int64()), ("start_s", pa.float64()), ("end_s", pa.float64())]))
    types = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), clip, pa.string()]
    for batch in slices(batches):
        media, sizes = batch.column(2).to_pylist(), batch.column(1).to_pylist()
        for group in _groups([len(x or b"") for x in media]):
            try:  # all frames of the group at once; where a file is of another kind, each file by itself
                movies = [read_avi(media[k]) for k in group if media[k] is not None]
                if len(movies) < len(group) or not all(own_frame(f) for m in movies for f in m.frames):
                    raise ValueError("files of other kinds")
                samples = frames_decoded([f for m in movies for f in m.frames])
                rows, at = [], 0
                for k, m in zip(group, movies):
                    own = samples[at : at + len(m.frames)]
                    at += len(m.frames)
                    rows.append(_result(media[k], own.tobytes(), clips(own, m.fps, sizes[k])))
            except DAMAGED:
                rows = [read_one(media[k], sizes[k]) for k in group]
            kept = [batch.column(k).slice(group.start, len(group)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays(kept + [pa.array(c, t) for c, t in zip(zip(*rows), types)], names=READ.names)


def read_back(stored: DataFrame) -> DataFrame:
    """What stored files (id, n_bytes, media) hold: payload digests and the clips found in them; n_bytes null: all bytes count."""
    return stored.select("id", F.col("n_bytes").cast("long"), "media").mapInArrow(_read, _of(READ, stored.schema["id"].dataType))


def clip_rows(stored: DataFrame) -> DataFrame:
    """A row per clip: (id, clip, first, frames, start_s, end_s)."""
    return read_back(stored).select("id", F.posexplode("clips").alias("clip", "c")).select("id", "clip", "c.*")
