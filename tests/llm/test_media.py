import hashlib
import struct
import zlib

import numpy as np
import pytest

from lodestone.llm import media as M
from lodestone.llm.queries import op8_media
from tests.conftest import SMALL


def test_frames_come_back():
    x = np.random.default_rng(0).integers(0, 256, (50, M.SAMPLES), dtype=np.uint8)
    x[0], x[1], x[2, ::2], x[2, 1::2] = 0, 255, 0, 255
    files = M.frames_coded(x)
    assert (M.frames_decoded(files) == x).all()
    for data, row in zip(files[:4], x):  # the general decoder agrees, on every pixel
        head = M.parse_head(data)
        picture = M.pixels(head, M.coefficients(head, data[head.size : -2]))
        assert (picture == np.kron(row.reshape(M.SIDE, M.SIDE), np.ones((8, 8), np.uint8))).all()


def test_general_frames():
    """A picture with all frequencies, coded with other tables, against the transform itself."""
    rng = np.random.default_rng(1)
    dc = {s: 4 for s in range(12)}
    ac = {r << 4 | s: 8 for r in range(16) for s in range(1, 11)} | {0: 8, 0xF0: 8}
    quant = list(range(1, 65))
    codes = [M.canonical([sum(n == k for n in t.values()) for k in range(1, 17)], sorted(t, key=lambda s: (t[s], s))) for t in (dc, ac)]
    blocks = np.where(rng.random((6, 64)) < 0.2, rng.integers(-20, 20, (6, 64)), 0)
    blocks[:, 0] = rng.integers(-50, 50, 6)
    blocks[0, 1:] = 0
    blocks[1, 1:] = 0
    blocks[1, 63] = 3
    bits = ""

    def put(code, value, size):
        nonlocal bits
        bits += f"{code[0]:0{code[1]}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    last = 0
    for b in blocks:
        size = int(abs(b[0] - last)).bit_length()
        put(codes[0][size], int(b[0] - last), size)
        last, run = b[0], 0
        for k in range(1, 64):
            v = int(b[M.ZIGZAG[k]])
            if not v:
                run += 1
                continue
            while run > 15:
                put(codes[1][0xF0], 0, 0)
                run -= 16
            put(codes[1][run << 4 | abs(v).bit_length()], v, abs(v).bit_length())
            run = 0
        if run:
            put(codes[1][0], 0, 0)
    bits += "1" * (-len(bits) % 8)
    coded = bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00")
    data = M.jpeg_head(24, 16, quant, dc, ac) + coded + b"\xff\xd9"
    head = M.parse_head(data)
    assert (head.width, head.height) == (24, 16) and (M.coefficients(head, data[head.size : -2]) == blocks).all()
    natural = np.empty(64)
    natural[M.ZIGZAG] = quant
    picture = M.pixels(head, blocks)
    k = np.arange(8)
    basis = np.where(k == 0, np.sqrt(0.125), 0.5)[:, None] * np.cos((2 * k[None, :] + 1) * k[:, None] * np.pi / 16)
    first = np.clip(np.rint(basis.T @ (blocks[4] * natural).reshape(8, 8) @ basis + 128), 0, 255)
    assert (picture[8:16, 8:16] == first).all()


def test_index_is_what_reading_goes_by():
    files = M.frames_coded(np.arange(3 * M.SAMPLES, dtype=np.int64).astype(np.uint8).reshape(3, -1))
    data = M.avi(files)
    assert M.read_avi(data).frames == files and M.read_avi(data).fps == M.FPS
    at = data.rfind(b"idx1") + 8
    swapped = data[:at] + data[at + 16 : at + 32] + data[at : at + 16] + data[at + 32 :]
    assert M.read_avi(swapped).frames == [files[1], files[0], files[2]]
    for bad in (b"", data[:100], data[: at + 8] + struct.pack("<I", 7) + data[at + 12 :], b"RIFF" + data[4:8] + b"WAVE" + data[12:]):
        with pytest.raises(ValueError):
            M.read_avi(bad)
    with pytest.raises(ValueError):
        M.frames_decoded([files[0][:-9] + b"\xff\xd9"])


def test_shots():
    x = np.zeros((60, M.SAMPLES), np.uint8)
    x[20:], x[40:] = 100, 200
    assert [c[:2] for c in M.clips(x)] == [(0, 20), (20, 20), (40, 20)]
    assert M.clips(x)[1][2:] == (0.8, 1.6)
    flicker = np.random.default_rng(2).integers(0, 256, (60, M.SAMPLES), dtype=np.uint8)
    assert len(M.clips(flicker)) == 1 and len(M.clips(x[:1])) == 1


def test_query_against_the_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = op8_media(spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(texts)
    for r in rows:
        raw = texts[r.doc_id].encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
        media = M.avi(M.frames_coded(np.frombuffer(payload, np.uint8).reshape(-1, 576)))
        assert (r.media_bytes, r.media_sha256) == (len(media), hashlib.sha256(media).hexdigest())


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, "m"), (None, "", None), (2, "é" * 3_000_000, "m"), (3, "x" * 576, "m"), (3, "x" * 576, "m")], "doc_id long, text string, media string")
    stored = M.store(df)
    got = sorted(((r.id or 0, r.n_bytes, r.payload_bytes) for r in M.read_back(stored).collect()))
    assert got == [(0, 0, 576), (1, 0, 576), (2, 6_000_000, 6_000_192), (3, 576, 576), (3, 576, 576)]
    clips = M.clip_rows(stored).filter("id = 3").collect()
    assert len(clips) == 2 and clips[0].frames == 1
    assert M.read_back(M.store(df.limit(0))).count() == 0


def coded_frame(width, height, sampling, blocks, restart=0, tables=None, dht=False):
    """A baseline frame of quantised blocks, one array (down, across, 64) per colour; default code tables unless given."""
    tables = tables or M.DEFAULT_TABLES
    codes = {k: M.canonical(list(c), list(s)) for k, (c, s) in tables.items()}
    parts = len(sampling)
    head = [b"\xff\xd8", M.segment(0xE0, b"JFIF\0" + bytes(9)), M.segment(0xFE, b"a remark"), M.segment(0xDB, bytes([0, *range(1, 65)]) + bytes([1, *[7] * 64]))]
    head.append(M.segment(0xC0, struct.pack(">BHHB", 8, height, width, parts) + b"".join(bytes([k + 1, a << 4 | d, min(k, 1)]) for k, (a, d) in enumerate(sampling))))
    if dht:
        head += [M.segment(0xC4, bytes([k]) + c + s) for k, (c, s) in tables.items()]
    if restart:
        head.append(M.segment(0xDD, struct.pack(">H", restart)))
    head.append(M.segment(0xDA, bytes([parts]) + b"".join(bytes([k + 1, 0x11 * min(k, 1)]) for k in range(parts)) + bytes([0, 63, 0])))
    most_a, most_d = max(a for a, _ in sampling), max(d for _, d in sampling)
    across, down = -(-width // (8 * most_a)), -(-height // (8 * most_d))
    out, bits, last = [], "", [0] * parts

    def put(code, value):
        nonlocal bits
        size = abs(value).bit_length()
        bits += f"{code[0]:0{code[1]}b}" + (f"{value if value > 0 else value + (1 << size) - 1:0{size}b}" if size else "")

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.append(bytes(int(bits[k : k + 8], 2) for k in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    for unit in range(across * down):
        if restart and unit and unit % restart == 0:
            flush()
            out.append(bytes([0xFF, 0xD0 + (unit // restart - 1) % 8]))
            last = [0] * parts
        r, c = divmod(unit, across)
        for k, (a, d) in enumerate(sampling):
            for j in range(d):
                for i in range(a):
                    block = blocks[k][r * d + j, c * a + i]
                    diff, last[k] = int(block[0]) - last[k], int(block[0])
                    put(codes[min(k, 1)][abs(diff).bit_length()], diff)
                    run = 0
                    for z in range(1, 64):
                        v = int(block[M.ZIGZAG[z]])
                        if not v:
                            run += 1
                            continue
                        while run > 15:
                            put(codes[0x10 | min(k, 1)][0xF0], 0)
                            run -= 16
                        put(codes[0x10 | min(k, 1)][run << 4 | abs(v).bit_length()], v)
                        run = 0
                    if run:
                        put(codes[0x10 | min(k, 1)][0], 0)
    flush()
    return b"".join(head) + b"".join(out) + b"\xff\xd9"


SAMPLINGS = {"420": [(2, 2), (1, 1), (1, 1)], "422": [(2, 1), (1, 1), (1, 1)], "444": [(1, 1)] * 3, "411": [(4, 1), (1, 1), (1, 1)], "grey": [(2, 2)]}


def random_blocks(rng, width, height, sampling):
    if len(sampling) == 1:
        sampling = [(1, 1)]
    a, d = max(x for x, _ in sampling), max(x for _, x in sampling)
    across, down = -(-width // (8 * a)), -(-height // (8 * d))
    out = []
    for x, y in sampling:
        blocks = np.where(rng.random((down * y, across * x, 64)) < 0.15, rng.integers(-30, 31, (down * y, across * x, 64)), 0)
        blocks[:, :, 0] = rng.integers(-60, 61, blocks.shape[:2])
        out.append(blocks)
    return out


@pytest.mark.parametrize("name", sorted(SAMPLINGS))
@pytest.mark.parametrize("restart", [0, 1, 3])
def test_colour_frames(name, restart):
    """Any sampling, default tables with and without naming them, restart intervals, against the blocks that were coded."""
    rng = np.random.default_rng(3)
    sampling = SAMPLINGS[name] if name != "grey" else [(1, 1)]
    blocks = random_blocks(rng, 50, 37, sampling)
    data = coded_frame(50, 37, sampling, blocks, restart, dht=restart == 3)
    head, parts = M.frame_planes(data)
    got = M.planes_coded(head, data[head.size : -2])
    assert all((g == b.reshape(-1, 64)).all() for g, b in zip(got, blocks))
    assert parts[0].shape == (37, 50) and M.rgb(data).shape == (37, 50, 3)
    with pytest.raises(ValueError):
        M.frame_planes(data[: len(data) // 2] + b"\xff\xd9")


def test_colours_are_right():
    """Even blocks of one colour, subsampled: each pixel has the colour that the conversion gives."""
    def even(shape, value, quant):
        x = np.zeros((*shape, 64), np.int64)
        x[:, :, 0] = round((value - 128) * 8 / quant)
        return x

    data = coded_frame(32, 16, SAMPLINGS["420"], [even((2, 4), 136, 1), even((1, 2), 128 + 49, 7), even((1, 2), 128 - 28, 7)])
    y, cb, cr = 136, 49, -28
    assert (M.rgb(data) == np.array([round(y + 1.402 * cr), round(y - 0.344136 * cb - 0.714136 * cr), round(y + 1.772 * cb)])).all()


def colour_movie(levels, absolute=False, rec=False, index=True, rate=True):
    frames = []
    for v in levels:
        blocks = [np.zeros((2, 2, 64), np.int64), np.zeros((1, 1, 64), np.int64), np.zeros((1, 1, 64), np.int64)]
        blocks[0][:, :, 0] = (v - 128) * 8
        frames.append(coded_frame(16, 16, SAMPLINGS["420"], blocks))
    data = M.avi(frames, 16, 16)
    movi = data.index(b"movi")
    head, idx = data[12 : movi - 8], data.rindex(b"idx1")
    body, entries = data[movi + 4 : idx], data[idx + 8 :]
    if not rate:
        head = head.replace(struct.pack("<I", 40000), bytes(4), 1)
    if rec:
        first = 8 + len(frames[0]) + len(frames[0]) % 2
        body = b"LIST" + struct.pack("<I", 4 + first) + b"rec " + body[:first] + body[first:]
        entries = b"rec " + struct.pack("<III", 1, 4, 0) + b"".join(struct.pack("<4sIII", n, f, at + 12, s) for n, f, at, s in struct.iter_unpack("<4sIII", entries))
    if absolute:
        base = 12 + len(head) + 8
        entries = b"".join(struct.pack("<4sIII", n, f, at + base, s) for n, f, at, s in struct.iter_unpack("<4sIII", entries))
    inner = b"AVI " + head + b"LIST" + struct.pack("<I", 4 + len(body)) + b"movi" + body + (M.chunk(b"idx1", entries) if index else b"")
    return frames, b"RIFF" + struct.pack("<I", len(inner)) + inner


@pytest.mark.parametrize("how", [{}, {"absolute": True}, {"rec": True}, {"rec": True, "absolute": True}, {"index": False}, {"index": False, "rec": True}, {"rate": False}])
def test_other_files(how):
    frames, data = colour_movie([20] * 12 + [200] * 8, **how)
    movie = M.read_avi(data)
    assert movie.frames == frames and movie.fps == M.FPS
    assert M.read_one(data)[5] == [{"first": 0, "frames": 12, "start_s": 0.0, "end_s": 0.48}, {"first": 12, "frames": 8, "start_s": 0.48, "end_s": 0.8}]
    assert M.read_one(data)[0] is None and M.read_one(data)[6] is None


def test_a_frame_of_no_bytes_repeats_the_one_before():
    f = M.frames_coded(np.zeros((2, M.SAMPLES), np.uint8))
    assert M.read_avi(M.avi([f[0], b"", f[1]])).frames == [f[0], f[0], f[1]]


def test_each_damaged_file_is_a_row_with_an_error(spark):
    texts = [("a", "x" * 2000), ("b", "é" * 700), ("c", "")]
    good = {r.id: r.media for r in M.store(spark.createDataFrame(texts, "doc_id string, text string")).collect()}
    wrong = bytearray(good["a"])
    wrong[300 + good["a"].index(b"movi")] ^= 0x5A
    files = [(k, None, bytes(v)) for k, v in good.items()] + [("none", None, None), ("cut", None, bytes(good["a"][:-700])), ("junk", None, b"RIFFxxxxAVI "), ("bits", None, bytes(wrong)), ("colour", None, colour_movie([10, 10, 240])[1])]
    rows = {r.id: r for r in M.read_back(spark.createDataFrame(files, "id string, n_bytes long, media binary").coalesce(1)).collect()}
    assert len(rows) == len(files)
    for k, text in texts:
        raw = text.encode()
        assert rows[k].error is None and rows[k].payload_sha256 == hashlib.sha256(raw + b"\xff" * (-len(raw) % 576 if raw else 576)).hexdigest()
    assert rows["none"].error and rows["none"].media_bytes is None
    for k in ("cut", "junk"):
        assert rows[k].error and rows[k].payload_sha256 is None and rows[k].clips is None and rows[k].media_bytes == len(dict((a, c) for a, _, c in files)[k])
    assert rows["bits"].error or rows["bits"].payload_sha256 != rows["a"].payload_sha256
    assert rows["colour"].error is None and rows["colour"].payload_sha256 is None and len(rows["colour"].clips) == 2


def test_padding_makes_no_shot():
    x = np.full((9, M.SAMPLES), 100, np.uint8)
    x[8, 300:] = 255
    assert len(M.clips(x)) == 2
    assert M.clips(x, valid=8 * M.SAMPLES + 300) == [(0, 9, 0.0, 0.36)]
    x[5:8] = 30
    x[8, :300] = 30
    assert [c[:2] for c in M.clips(x, valid=8 * M.SAMPLES + 300)] == [(0, 5), (5, 4)]
    assert M.clips(np.full((1, M.SAMPLES), 255, np.uint8), valid=0) == [(0, 1, 0.0, 0.04)]


def features_of(text):
    """The shots of a text from its definition, with plain loops."""
    raw = (text or "").encode()
    frames = [raw[k : k + 576] for k in range(0, len(raw), 576)] or [b""]
    most = max(map(len, frames))
    share = [[sum(b // 16 == r for b in f) / max(len(f), 1) for r in range(16)] for f in frames]
    d = [sum(abs(a - b) for a, b in zip(x, y)) / 2 if len(f) >= max(most / 2, 1) else 0.0 for x, y, f in zip(share, share[1:], frames[1:])]
    starts = [0]
    for i, own in enumerate(d):
        near = [d[k] for k in range(max(i - 8, 0), min(i + 9, len(d))) if k != i]
        mean = sum(near) / max(len(near), 1)
        spread = max(sum(x * x for x in near) / max(len(near), 1) - mean * mean, 0) ** 0.5
        if own >= 0.2 and own > mean + 3 * spread + 1e-12:
            starts.append(i + 1)
    ends = [*starts[1:], len(frames)]
    return ",".join(f"{a}+{b - a}@{a / 25:.2f}-{b / 25:.2f}" for a, b in zip(starts, ends))


def test_feature_by_value(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    assert {r.doc_id: r.feature for r in op8_media(spark, SMALL).collect()} == {k: features_of(v) for k, v in texts.items()}
    mixed = spark.createDataFrame([(0, "plain words of a text " * 150 + "0123456789" * 400 + "|" * 900), (1, None), (2, "a" * 5000 + "\t" * 5000)], "doc_id long, text string")
    for r in M.read_back(M.store(mixed)).join(mixed.withColumnRenamed("doc_id", "id"), "id").collect():
        got = ",".join(f"{c['first']}+{c.frames}@{c.start_s:.2f}-{c.end_s:.2f}" for c in r.clips)
        assert got == features_of(r.text) and (r.id == 1 or "," in got)
