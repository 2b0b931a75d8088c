"""Payloads as motion-JPEG in AVI: written, read back through the RIFF index, decoded, and cut into shots.

A frame is a baseline JPEG in grey whose 8x8 blocks are flat: each block's DC coefficient is one sample, so any decoder
gets the samples back exactly. The Huffman table gives the longer codes to the smaller differences, so that a code and its
difference always fill ``BITS`` bits: the scan then decodes in numpy without a walk from bit to bit. Frames are ``COLUMNS`` blocks wide and up to
``ROWS`` high; the last may be lower. Reading takes frame places from ``idx1``. Frames in any other baseline coding (colour, AC coefficients, own or
left-out Huffman tables, restart markers, several scans) are decoded by the general way, and their samples are all pixels of the first component
(the brightness). A shot starts where the histogram difference to the frame
before exceeds ``FLOOR`` and the lower median of the differences around it, itself left out, by ``DEVIATIONS`` deviations (median, scaled to a normal
one), or exceeds ``HARD`` whatever stands around it.

Defined results: a null or empty text is 64 zero bytes; texts of any length give as many frames as they need; equal texts give equal values; a null id
and repeated rows are returned each; extra columns are ignored. A null media value, and a file or frame that can't be read (cut short, without an
index or frames, or not baseline), gives one row: ``clips`` has 0 frames and nulls, ``digests`` the file's size and hash, nulls, and the feature
``unreadable``.
"""

from __future__ import annotations

import hashlib
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import table

COLUMNS, ROWS, FPS, BITS = 64, 16, 25, 10
FRAME = COLUMNS * ROWS
AROUND, DEVIATIONS, FLOOR, HARD = 8, 2.0, 0.25, 0.75


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 255, marker, len(body) + 2) + body


#: Code lengths 1 to 9 for difference sizes 8 down to 0; the end of a block is the one-bit code 0.
_TABLES = (
    _segment(0xDB, bytes([0, 8] + [1] * 63)) + _segment(0xC4, bytes([0x00] + [1] * 9 + [0] * 7 + list(range(8, -1, -1)))) + _segment(0xC4, bytes([0x10, 1] + [0] * 15 + [0]))
)
_SCAN = _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _codes() -> tuple[np.ndarray, np.ndarray]:
    """The ten bits of each difference (at difference + 255), and the difference of each ten bits."""
    code, back = np.zeros(511, np.uint16), np.full(1 << BITS, 999, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        length = 9 - s
        prefix = (1 << length) - 2
        rest = d if d >= 0 else d + (1 << s) - 1
        code[d + 255] = ((prefix << s) | rest) << 1
        back[code[d + 255]] = d
    return code, back


_CODE, _BACK = _codes()


def _scan_bits(frames: np.ndarray) -> np.ndarray:
    """Entropy-coded bytes of frames (one a row), before stuffing."""
    level = frames.astype(np.int16) - 128
    diff = np.diff(level, axis=1, prepend=np.zeros((len(level), 1), np.int16))
    bits = np.unpackbits(_CODE[diff + 255].astype(">u2").view(np.uint8).reshape(len(frames), -1, 2), axis=2)[:, :, 16 - BITS :]
    return np.packbits(bits.reshape(len(frames), -1), axis=1)


def _jpegs(samples: np.ndarray) -> list[bytes]:
    full = len(samples) // FRAME * FRAME
    out = []
    for part in (samples[:full].reshape(-1, FRAME), samples[full:].reshape(1, -1)):
        if part.size:
            head = b"\xff\xd8" + _TABLES + _segment(0xC0, struct.pack(">BHHB", 8, part.shape[1] // COLUMNS * 8, COLUMNS * 8, 1) + bytes([1, 0x11, 0])) + _SCAN
            for i in range(0, len(part), 512):
                out += [head + row.tobytes().replace(b"\xff", b"\xff\x00") + b"\xff\xd9" for row in _scan_bits(part[i : i + 512])]
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)


def write_avi(payload: bytes) -> bytes:
    """An AVI file whose samples are the payload's bytes; their number must be a positive multiple of 64."""
    frames = _jpegs(np.frombuffer(payload, np.uint8))
    width, height, largest = COLUMNS * 8, ROWS * 8, max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // FPS, largest * FPS, 0, 0x10, len(frames), 0, 1, largest, width, height, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, width, height)
    strf = struct.pack("<IiiHH4sIiiII", 40, width, height, 1, 24, b"MJPG", width * height * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    chunks = [_chunk(b"00dc", f) for f in frames]
    starts = 4 + np.r_[0, np.cumsum([len(c) for c in chunks])[:-1]]
    index = b"".join([struct.pack("<4sIII", b"00dc", 0x10, s, len(f)) for s, f in zip(starts.tolist(), frames, strict=True)])
    return _chunk(b"RIFF", b"AVI " + hdrl + _chunk(b"LIST", b"movi" + b"".join(chunks)) + _chunk(b"idx1", index))


def read_index(avi: bytes) -> tuple[float, list[tuple[int, int]]]:
    """Seconds a frame, and (place, size) of every frame in the file, as ``idx1`` lists them."""
    if avi[:4] != b"RIFF" or avi[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, movi, entries, rate = 12, None, None, 1 / FPS
    while at + 8 <= len(avi):
        name, size = avi[at : at + 4], struct.unpack_from("<I", avi, at + 4)[0]
        kind = avi[at + 8 : at + 12]
        if name == b"LIST" and kind == b"hdrl":
            rate = struct.unpack_from("<I", avi, avi.index(b"avih", at) + 8)[0] / 1e6
        elif name == b"LIST" and kind == b"movi":
            movi = at + 8
        elif name == b"idx1":
            entries = list(struct.iter_unpack("<4sIII", avi[at + 8 : at + 8 + size]))
        at += 8 + size + (size & 1)
    if movi is None or entries is None:
        raise ValueError("no frames or no index")
    return rate, [(movi + start + 8, size) for name, _, start, size in entries if name[2:] in (b"dc", b"db")]


_ZIGZAG = np.array(sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8)))
_COS = np.array([[(0.5 if u else 8**-0.5) * np.cos((2 * x + 1) * u * np.pi / 16) for u in range(8)] for x in range(8)])
_BROKEN = (ValueError, IndexError, KeyError, struct.error, OverflowError)
#: The standard's tables (class and number, counts by length, symbols), which motion-JPEG files may leave out.
_STANDARD = [
    bytes.fromhex(x)
    for x in (
        "00" "00010501010101010100000000000000" "000102030405060708090a0b",
        "01" "00030101010101010101010000000000" "000102030405060708090a0b",
        "10" "0002010303020403050504040000017d" "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa",
        "11" "00020102040403040705040400010277" "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa",
    )
]


@lru_cache(64)
def _book(counts: bytes, symbols: bytes) -> list[int]:
    """For each 16 bits, the length of the code they begin with and its symbol as length << 8 | symbol; 0 where there is none."""
    out, code, k = [0] * 65536, 0, 0
    for size in range(1, 17):
        for _ in range(counts[size - 1]):
            if code >> size:
                raise ValueError("too many codes")
            at, width = code << (16 - size), 1 << (16 - size)
            out[at : at + width] = [size << 8 | symbols[k]] * width
            code, k = code + 1, k + 1
        code <<= 1
    return out


def _walk(data: bytes, units: list[tuple[int, list[int], list[int], list[int]]], coefs: list[list[list[int]]]) -> None:
    """Decodes blocks from one restart interval; units: (component, its DC book, its AC book, block numbers) in the order of the scan."""
    end, data, k = len(data) * 8, data + b"\0" * 8, 0
    last = [0] * len(coefs)

    def value(size: int) -> int:
        nonlocal k
        v = (int.from_bytes(data[k >> 3 : (k >> 3) + 4], "big") >> (32 - (k & 7) - size)) & ((1 << size) - 1)
        k += size
        return v if not size or v >> (size - 1) else v - (1 << size) + 1

    def symbol(book: list[int]) -> int:
        nonlocal k
        hit = book[(int.from_bytes(data[k >> 3 : (k >> 3) + 4], "big") >> (16 - (k & 7))) & 0xFFFF]
        if not hit or k >= end:
            raise ValueError("no code" if k < end else "a scan ends early")
        k += hit >> 8
        return hit & 255

    for c, dc, ac, block in units:
        size = symbol(dc)
        if size > 15:
            raise ValueError("a difference of more than 15 bits")
        last[c] += value(size)
        out = coefs[c][block]
        out[0], z = last[c], 1
        while z < 64:
            rs = symbol(ac)
            if not rs & 15:
                if rs != 0xF0:
                    break
                z += 16
                continue
            z += rs >> 4
            out[z] = value(rs & 15)
            z += 1
    if k > end:
        raise ValueError("a scan ends early")


def decode_jpeg(data: bytes) -> list[np.ndarray]:
    """The planes of a baseline JPEG, a (height, width) array for each component at its own resolution."""
    quant: dict[int, np.ndarray] = {}
    books = {t[0]: _book(t[1:17], t[17:]) for t in _STANDARD}
    restart, parts, coefs, at = 0, [], [], 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    seen: set[int] = set()
    while at + 4 <= len(data):
        if data[at] != 255:
            raise ValueError("no marker")
        marker = data[at + 1]
        if marker == 0xFF:  # fill
            at += 1
            continue
        if marker == 0xD9:
            break
        length = struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + length]
        at += 2 + length
        if marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quant[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.float64)
                body = body[65 + 64 * wide :]
        elif marker == 0xC4:
            while body:
                n = sum(body[1:17])
                books[body[0]] = _book(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDD:
            restart = struct.unpack(">H", body[:2])[0]
        elif marker in (0xC0, 0xC1):
            bits, height, width, n = struct.unpack_from(">BHHB", body)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
            if bits != 8 or not height or not width or not parts or not all(1 <= x <= 4 for p in parts for x in p[1:3]):
                raise ValueError("a frame header out of range")
            hmax, vmax = max(p[1] for p in parts), max(p[2] for p in parts)
            mx, my = -(-width // (8 * hmax)), -(-height // (8 * vmax))
            if mx * my * 4 > 64 * len(data):
                raise ValueError("more blocks than the data can hold")
            coefs = [[[0] * 64 for _ in range(mx * h * my * v)] for _, h, v, _ in parts]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("not baseline")
        elif marker == 0xDA:
            if not parts:
                raise ValueError("a scan before its frame")
            chosen = [([p[0] for p in parts].index(body[1 + 2 * i]), body[2 + 2 * i]) for i in range(body[0])]
            seen |= {c for c, _ in chosen}
            pick = [(c, books[t >> 4], books[0x10 | t & 15], parts[c][1], parts[c][2]) for c, t in chosen]
            if len(pick) == 1:  # not interleaved: only blocks that the picture reaches
                c, dc, ac, h, v = pick[0]
                across, down = -(-(-(-width * h // hmax)) // 8), -(-(-(-height * v // vmax)) // 8)
                groups = [[(c, dc, ac, y * mx * h + x)] for y in range(down) for x in range(across)]
            else:
                groups = [[(c, dc, ac, (Y * v + y) * mx * h + X * h + x) for c, dc, ac, h, v in pick for y in range(v) for x in range(h)] for Y in range(my) for X in range(mx)]
            stop = re.compile(rb"\xff[^\x00\xd0-\xd7\xff]", re.DOTALL).search(data, at)
            end = stop.start() if stop else len(data)
            step = restart or len(groups)
            runs = re.split(rb"\xff+[\xd0-\xd7]", data[at:end])
            if len(runs) < -(-len(groups) // step):
                raise ValueError("a restart interval is missing")
            for i, run in zip(range(0, len(groups), step), runs, strict=False):
                _walk(run.replace(b"\xff\x00", b"\xff"), [u for g in groups[i : i + step] for u in g], coefs)
            at = end
        # all other segments say nothing about the samples
    if not parts or len(seen) < len(parts):
        raise ValueError("no scan of some component")
    planes = []
    for (_, h, v, q), blocks in zip(parts, coefs, strict=True):
        flat = np.zeros((len(blocks), 64))
        flat[:, _ZIGZAG] = np.array(blocks, np.float64) * quant[q]
        pixels = np.clip(np.rint(_COS @ flat.reshape(-1, 8, 8) @ _COS.T + 128), 0, 255).astype(np.uint8)
        plane = pixels.reshape(my * v, mx * h, 8, 8).swapaxes(1, 2).reshape(my * v * 8, mx * h * 8)
        planes.append(plane[: -(-height * v // vmax), : -(-width * h // hmax)])
    return planes


def decode_frames(avi: bytes, places: list[tuple[int, int]]) -> list[np.ndarray]:
    """Samples of each frame: one a block in the coding of ``write_avi``, all pixels of the first component in any other."""
    out: list[np.ndarray] = [None] * len(places)  # type: ignore[list-item]
    scans, blocks, which = [], [], []
    head, sof = b"\xff\xd8" + _TABLES, _segment(0xC0, struct.pack(">BHHB", 8, 0, 0, 1) + bytes([1, 0x11, 0]))
    for i, (start, size) in enumerate(places):
        frame = avi[start : start + size]
        at = len(head) + len(sof) + len(_SCAN)
        own = len(frame) > at and frame.startswith(head + sof[:5]) and frame[len(head) + 9 : at] == sof[9:] + _SCAN and frame[-2:] == b"\xff\xd9"
        if own:
            h, w = struct.unpack_from(">HH", frame, len(head) + 5)
            scan, n = frame[at:-2].replace(b"\xff\x00", b"\xff"), (h // 8) * (w // 8)
            own = not (h % 8 or w % 8) and n > 0 and len(scan) * 8 == n * BITS
        if own:
            scans.append(scan)
            blocks.append(n)
            which.append(i)
        else:
            out[i] = decode_jpeg(frame)[0].ravel()
    for i in range(0, len(scans), 512):
        data, counts = b"".join(scans[i : i + 512]), np.array(blocks[i : i + 512])
        bits = np.unpackbits(np.frombuffer(data, np.uint8)).reshape(-1, BITS)
        value = np.packbits(np.pad(bits, ((0, 0), (16 - BITS, 0))), axis=1).view(">u2").ravel()
        diff = _BACK[value].astype(np.int64)
        if (diff == 999).any():
            raise ValueError("a scan with unknown codes")
        ends = np.cumsum(counts)
        total = np.cumsum(diff)
        level = total - np.repeat(np.r_[0, total[ends[:-1] - 1]], counts)
        for j, f in zip(which[i : i + 512], np.split((level + 128).astype(np.uint8), ends[:-1]), strict=True):
            out[j] = f
    return out


def _read(avi: bytes | None) -> tuple[float, list[np.ndarray]] | None:
    """Seconds a frame, and the frames' samples; None for a file that can't be read."""
    try:
        rate, places = read_index(avi or b"")
        return (rate, decode_frames(avi, places)) if places else None
    except _BROKEN:
        return None


def _usual(d: np.ndarray) -> np.ndarray:
    """What each difference has to exceed: lower median and deviation of those up to ``AROUND`` before and after it; 0 without any."""
    around = np.lib.stride_tricks.sliding_window_view(np.pad(d, AROUND, constant_values=np.nan), 2 * AROUND + 1)
    around = np.delete(around, AROUND, axis=1)
    middle = np.maximum(0, (~np.isnan(around)).sum(axis=1) - 1) // 2
    low = lambda x: np.nan_to_num(np.sort(x, axis=1)[np.arange(len(x)), middle])
    m = low(around)
    return m + DEVIATIONS * 1.4826 * low(np.abs(around - m[:, None]))


def shots(frames: list[np.ndarray]) -> list[tuple[int, int]]:
    """First and one past the last frame of each shot."""
    n = len(frames)
    if n < 2:
        return [(0, n)]
    hist = np.stack([np.bincount(f >> 4, minlength=16) / len(f) for f in frames])
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts = np.flatnonzero((d > FLOOR) & ((d > _usual(d)) | (d > HARD))) + 1
    edges = [0, *cuts.tolist(), n]
    return list(zip(edges[:-1], edges[1:], strict=True))


def padded(text: bytes | None) -> bytes:
    data = text or b""
    return data + b"\0" * (-len(data) % 64 or (0 if data else 64))


def stored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, media): each text as an AVI file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_avi(padded(x.as_py())) for x in part.column(1)], pa.binary())], names=["id", "media"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t")).mapInArrow(run, "id long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """(id, clip, start_s, end_s, frames, mean_level) for every shot of every file in columns id, media."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for k, m in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                read = _read(m.as_py())
                if read is None:
                    rows.append((k, None, None, None, 0, None))
                    continue
                rate, frames = read
                rows += [(k, c, s * rate, e * rate, e - s, float(np.mean(np.concatenate(frames[s:e])))) for c, (s, e) in enumerate(shots(frames))]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.int64(), pa.float64()), strict=True)], names=["id", "clip", "start_s", "end_s", "frames", "mean_level"])

    return media.select("id", "media").mapInArrow(run, "id long, clip int, start_s double, end_s double, frames long, mean_level double")


def digests(media: DataFrame) -> DataFrame:
    """What a file holds, read back from its bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for m in b.column(1):
                avi = m.as_py()
                read = _read(avi)
                if read is None:
                    rows.append((None, None, None, None if avi is None else len(avi), None if avi is None else hashlib.sha256(avi).hexdigest(), "unreadable"))
                    continue
                rate, frames = read
                payload = b"".join([f.tobytes() for f in frames])
                found = shots(frames)
                feature = f"frames={len(frames)};shots={len(found)};clips=" + "|".join([f"{s * rate:.2f}-{e * rate:.2f}" for s, e in found])
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]), len(avi), hashlib.sha256(avi).hexdigest(), feature))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2)] + [pa.array(list(c), t) for c, t in zip(zip(*rows, strict=True) if rows else [()] * 6, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()), strict=True)], names=["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    return media.select("id", "media", "n_bytes").mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def op9_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))

    def both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(0, b.num_rows, 256):
                part = b.slice(i, 256)
                texts = [x.as_py() for x in part.column(1)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([write_avi(padded(x)) for x in texts], pa.binary()), pa.array([len(x) for x in texts], pa.int64())], names=["id", "media", "n_bytes"])

    media = docs.select(F.col("doc_id").cast("long").alias("id"), F.col("text").cast("binary").alias("t")).mapInArrow(both, "id long, media binary, n_bytes long")
    return digests(media)


QUERIES = {"op9_media": op9_media}
ORACLES: dict[str, str] = {}
