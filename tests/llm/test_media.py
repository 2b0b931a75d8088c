"""Motion-JPEG in AVI: a second decoder that walks the bits, exact round trips, shots."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pytest

from acquimetra.llm import media
from acquimetra.llm.registry import QUERIES
from acquimetra.llm.shared import table


def slow_jpeg(data):
    """Samples of a grey baseline JPEG with flat blocks, by the standard's own rules."""
    at, tables, n = 2, {}, 0
    while True:
        marker, length = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        if marker == 0xC4:
            code, k, book = 0, 17, {}
            for size in range(1, 17):
                for _ in range(body[size]):
                    book[(size, code)] = body[k]
                    code, k = code + 1, k + 1
                code <<= 1
            tables[body[0]] = book
        elif marker == 0xDB:
            quant = body[1]
        elif marker == 0xC0:
            h, w = struct.unpack_from(">HH", body, 1)
            n = (h // 8) * (w // 8)
        at += 2 + length
        if marker == 0xDA:
            break
    bits = "".join(f"{b:08b}" for b in data[at:-2].replace(b"\xff\x00", b"\xff"))
    k, dc, out = 0, 0, []

    def symbol(book):
        nonlocal k
        code = size = 0
        while True:
            code, size, k = code << 1 | int(bits[k]), size + 1, k + 1
            if (size, code) in book:
                return book[(size, code)]

    for _ in range(n):
        s = symbol(tables[0])
        v = int(bits[k : k + s], 2) if s else 0
        k += s
        dc += v if not s or v >> (s - 1) else v - (1 << s) + 1
        assert symbol(tables[0x10]) == 0
        out.append(round(dc * quant / 8 + 128))
    return bytes(out)


PAYLOADS = [bytes(64), bytes(range(256)), b"\xff" * 640, b"\x00\xff" * 320, np.random.default_rng(1).integers(0, 256, 64 * 37, dtype=np.uint8).tobytes()]


@pytest.mark.parametrize("payload", PAYLOADS)
def test_another_decoder_reads_the_frames(payload):
    avi = media.write_avi(payload)
    _, places = media.read_index(avi)
    assert b"".join(slow_jpeg(avi[a : a + n]) for a, n in places) == payload


@pytest.mark.parametrize("size", [64, 1024, 1088, 64 * 5000])
def test_round_trip(size):
    payload = np.random.default_rng(size).integers(0, 256, size, dtype=np.uint8).tobytes()
    avi = media.write_avi(payload)
    assert struct.unpack_from("<I", avi, 4)[0] == len(avi) - 8
    rate, places = media.read_index(avi)
    assert rate == 1 / media.FPS
    assert b"".join(f.tobytes() for f in media.decode_frames(avi, places)) == payload


def test_shots_are_cut_where_the_picture_changes():
    dark, light = np.full(1024, 20, np.uint8), np.full(1024, 220, np.uint8)
    assert media.shots([dark] * 10 + [light] * 12 + [dark] * 9) == [(0, 10), (10, 22), (22, 31)]
    assert media.shots([dark]) == [(0, 1)] and media.shots([dark] * 5) == [(0, 5)]


def test_clips(spark):
    payload = b"\x14" * 1024 * 10 + b"\xdc" * 1024 * 12
    df = spark.createDataFrame([(1, bytearray(media.write_avi(payload)), "x")], "id long, media binary, clip string")
    got = [tuple(r) for r in media.clips(df).orderBy("clip").collect()]
    assert got == [(1, 0, 0.0, pytest.approx(0.4), 10, 20.0), (1, 1, pytest.approx(0.4), pytest.approx(0.88), 12, 220.0)]


def test_query(spark, sf_dir):
    docs = {r.doc_id: (r.text or "").encode() for r in table(spark, sf_dir, "documents").collect()}
    rows = QUERIES["op9_media"](spark, sf_dir).collect()
    assert len(rows) == len(docs)
    of_text = {}
    for r in rows:
        data = docs[r.doc_id]
        whole = data + bytes(-len(data) % 64 or (0 if data else 64))
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(whole), hashlib.sha256(whole).hexdigest(), zlib.crc32(whole[-64:]))
        avi = media.write_avi(whole)
        assert (r.media_bytes, r.media_sha256) == (len(avi), hashlib.sha256(avi).hexdigest())
        assert of_text.setdefault(data, r.feature) == r.feature


def test_nulls_and_empty_table(spark, tmp_path):
    spark.createDataFrame([(None, None, "m"), (1, "", "m"), (1, "", "m")], "doc_id long, text string, media string").write.parquet(f"{tmp_path}/a/documents.parquet")
    rows = QUERIES["op9_media"](spark, f"{tmp_path}/a").collect()
    assert len(rows) == 3 and {(r.n_bytes, r.payload_bytes) for r in rows} == {(0, 64)}
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/b/documents.parquet")
    assert QUERIES["op9_media"](spark, f"{tmp_path}/b").count() == 0


class Bits:
    """Entropy-coded bits by the standard's rules, for a plain encoder of any coefficients."""

    def __init__(self, tables):
        self.out, self.codes = "", {}
        for t in tables:
            code, k = 0, 17
            for size in range(1, 17):
                for _ in range(t[size]):
                    self.codes[t[0], t[k]] = f"{code:0{size}b}"
                    code, k = code + 1, k + 1
                code <<= 1

    def put(self, table, zeros, v):
        size = abs(v).bit_length()
        self.out += self.codes[table, zeros << 4 | size] + (f"{v if v > 0 else v + (1 << size) - 1:0{size}b}" if size else "")

    def block(self, coefs, before, table):
        self.put(table, 0, coefs[0] - before)
        zeros = 0
        last = max([i for i in range(1, 64) if coefs[i]], default=0)
        for i in range(1, last + 1):
            if coefs[i]:
                while zeros > 15:
                    self.out, zeros = self.out + self.codes[0x10 | table, 0xF0], zeros - 16
                self.put(0x10 | table, zeros, coefs[i])
                zeros = 0
            else:
                zeros += 1
        if last < 63:
            self.out += self.codes[0x10 | table, 0]

    def take(self):
        self.out += "1" * (-len(self.out) % 8)
        data, self.out = bytes(int(self.out[i : i + 8], 2) for i in range(0, len(self.out), 8)), ""
        return data.replace(b"\xff", b"\xff\x00")


def plain_idct(coefs, quant):
    """One block's 64 pixels by the defining sum over the zigzag walk."""
    f, x, y, up = np.zeros((8, 8)), 0, 0, True
    for c, q in zip(coefs, quant, strict=True):
        f[y, x] = c * q
        if up:
            x, y, up = (x + 1, y, False) if y == 0 and x < 7 else (x, y + 1, False) if x == 7 else (x + 1, y - 1, True)
        else:
            x, y, up = (x, y + 1, True) if x == 0 and y < 7 else (x + 1, y, True) if y == 7 else (x - 1, y + 1, False)
    scale = lambda u: 0.5**0.5 if u == 0 else 1.0
    out = [[sum(scale(u) * scale(v) * f[v, u] * np.cos((2 * i + 1) * u * np.pi / 16) * np.cos((2 * j + 1) * v * np.pi / 16) for u in range(8) for v in range(8)) / 4 for i in range(8)] for j in range(8)]
    return np.clip(np.rint(np.array(out) + 128), 0, 255)


def colour_jpeg(seed, restart, tables):
    """A 4:2:0 picture of 40 x 24 pixels with AC coefficients, and its brightness."""
    rng = np.random.default_rng(seed)
    quant = rng.integers(1, 12, (2, 64))
    bits = Bits(media._STANDARD)
    luma, scan, before, done = np.zeros((32, 48)), b"", [0, 0, 0], 0
    for k in range(6):  # 3 x 2 groups of four blocks of brightness and two of colour
        if restart and k and k % restart == 0:
            scan, before = scan + bits.take() + bytes([255, 0xD0 + (k // restart - 1) % 8]), [0, 0, 0]
        for c, table in ((0, 0), (0, 0), (0, 0), (0, 0), (1, 1), (2, 1)):
            coefs = [int(rng.integers(-60, 60)), *[int(rng.integers(-9, 10)) if rng.random() < 0.1 else 0 for _ in range(63)]]
            bits.block(coefs, before[c], table)
            before[c] = coefs[0]
            if c == 0:
                i = done % 4
                y, x = (k // 3 * 2 + i % 4 // 2) * 8, (k % 3 * 2 + i % 2) * 8
                luma[y : y + 8, x : x + 8] = plain_idct(coefs, quant[0])
                done += 1
    head = b"".join(media._segment(0xDB, bytes([i, *quant[i].tolist()])) for i in range(2)) + media._segment(0xC0, struct.pack(">BHHB", 8, 24, 40, 3) + bytes([1, 0x22, 0, 2, 0x11, 1, 3, 0x11, 1]))
    if tables:
        head += media._segment(0xC4, b"".join(media._STANDARD))
    if restart:
        head += media._segment(0xDD, struct.pack(">H", restart))
    return b"\xff\xd8" + head + media._segment(0xDA, bytes([3, 1, 0x00, 2, 0x11, 3, 0x11, 0, 63, 0])) + scan + bits.take() + b"\xff\xd9", luma[:24, :40]


def avi_of(monkeypatch, frames):
    with monkeypatch.context() as m:
        m.setattr(media, "_jpegs", lambda _: frames)
        return media.write_avi(bytes(64))


@pytest.mark.parametrize(("restart", "tables"), [(0, True), (2, True), (1, False), (0, False)])
def test_colour_frames_with_all_coefficients(monkeypatch, restart, tables):
    made = [colour_jpeg(s, restart, tables) for s in range(3)]
    avi = avi_of(monkeypatch, [f for f, _ in made])
    for got, (_, want) in zip(media.decode_frames(avi, media.read_index(avi)[1]), made, strict=True):
        assert np.abs(got.reshape(24, 40).astype(int) - want).max() <= 1


def test_standard_tables_hold_every_symbol():
    for t in media._STANDARD:
        want = set(range(12)) if t[0] < 16 else {0, 0xF0} | {r << 4 | s for r in range(16) for s in range(1, 11)}
        assert sum(t[1:17]) == len(t) - 17 and set(t[17:]) == want


def test_null_and_broken_media_have_a_row(spark, monkeypatch):
    good, (jpeg, luma) = media.write_avi(b"\x14" * 1024), colour_jpeg(1, 0, True)
    bad = [None, b"", b"RIFF", good[: len(good) // 2], avi_of(monkeypatch, [jpeg[:-60]]), avi_of(monkeypatch, [jpeg.replace(b"\xff\xc0", b"\xff\xc2", 1)])]
    rows = [(i, None if m is None else bytearray(m), 5) for i, m in enumerate([*bad, good, avi_of(monkeypatch, [jpeg])])]
    df = spark.createDataFrame(rows, "id long, media binary, n_bytes long")
    got = {r.id: r for r in media.clips(df).collect()}
    assert len(got) == len(rows) and all((got[i].clip, got[i].frames, got[i].mean_level) == (None, 0, None) for i in range(len(bad)))
    assert got[len(bad)].mean_level == 20.0 and abs(got[len(bad) + 1].mean_level - luma.mean()) < 1
    got = {r.doc_id: r for r in media.digests(df).collect()}
    assert [got[i].feature == "unreadable" for i in range(len(rows))] == [True] * len(bad) + [False] * 2
    assert got[0].media_bytes is None and got[2].media_bytes == 4


def test_short_and_fast_cut_clips():
    a, b, c = (np.full(1024, v, np.uint8) for v in (20, 120, 220))
    assert media.shots([a, b]) == [(0, 1), (1, 2)] and media.shots([a, a]) == [(0, 2)]
    assert media.shots([a, b, c]) == [(0, 1), (1, 2), (2, 3)]
    assert media.shots([a, a, a, b, b, b]) == [(0, 3), (3, 6)]
    for length in (2, 3, 4):
        frames = [x for k in range(9) for x in [(a, b, c)[k % 3]] * length]
        assert media.shots(frames) == [(k * length, (k + 1) * length) for k in range(9)]
    half = np.r_[a[:500], b[:524]]  # a cut that changes half of the picture
    assert media.shots([a, a, half, half, a, a, half, half]) == [(0, 2), (2, 4), (4, 6), (6, 8)]
    rng = np.random.default_rng(4)
    moving = [np.clip(rng.normal(100 + 12 * np.sin(i), 25, 1024), 0, 255).astype(np.uint8) for i in range(40)]
    assert media.shots(moving) == [(0, 40)]
