"""Media columns: AVI files of motion JPEG, written and read back with numpy.

Bytes become frames of 24 x 24 samples. A frame is a baseline grayscale JPEG in which each sample is one flat
8 x 8 block: only its DC coefficient is coded, at quantizer 8, so that any decoder gives the sample back exactly.
The DC code of category c has 9 - c bits, so every difference takes 9 bits and every block, with its one-bit end,
takes 10. Reading parses the RIFF index, takes each frame's scan and undoes the DC prediction; frames with
other tables, as other writers' files have, go through the general decoder in jpeg.py.
Shots: the difference of successive frames' histograms is a cut where it exceeds the mean plus a multiple of
the deviation of those around it, and a multiple of that mean. Each shot is a timed clip row.

Defined cases: null and empty texts become one frame of bytes 255; equal texts give equal files; an empty table
gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quernel.llm import jpeg
from quernel.session import ship

SIDE, FPS = 24, 25
FRAME = SIDE * SIDE


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _headers(side: int) -> bytes:
    dc_counts = [0] * 16
    for category in range(9):
        dc_counts[8 - category] += 1
    dc = bytes([0x00, *dc_counts, *range(8, -1, -1)])  # shortest code: category 8
    ac = bytes([0x10, 1, *[0] * 15, 0x00])  # only the end of a block: one bit
    sof = struct.pack(">BHHB", 8, side * 8, side * 8, 1) + bytes([1, 0x11, 0])
    return b"\xff\xd8" + _segment(0xDB, bytes([0, *[8] * 64])) + _segment(0xC0, sof) + _segment(0xC4, dc) + _segment(0xC4, ac) + _segment(0xDA, bytes([1, 1, 0x00, 0, 63, 0]))


def _words() -> tuple[np.ndarray, np.ndarray]:
    """The 10-bit word of each DC difference -255..255, and the difference of each 10-bit word."""
    words = np.zeros(511, np.uint64)
    back = np.zeros(1024, np.int64)
    for d in range(-255, 256):
        c = abs(d).bit_length()
        code = (1 << (9 - c)) - 2 if c < 9 else 0  # 0, 10, 110, ... by falling category
        extra = d if d >= 0 else d + (1 << c) - 1
        words[d + 255] = (code << c | extra) << 1
        back[int(words[d + 255])] = d
    return words, back


HEAD, EOI = _headers(SIDE), b"\xff\xd9"
WORD, DIFFERENCE = _words()
SCAN = FRAME * 10 // 8


def encode_frames(samples: np.ndarray) -> list[bytes]:
    """samples: uint8, (frames, 576). One JPEG each."""
    n = len(samples)
    d = np.diff(samples.astype(np.int64), axis=1, prepend=128) + 255
    w = WORD[d].reshape(n, -1, 4)
    five = w[..., 0] << np.uint64(30) | w[..., 1] << np.uint64(20) | w[..., 2] << np.uint64(10) | w[..., 3]
    scans = five.astype(">u8").view(np.uint8).reshape(n, -1, 8)[..., 3:].reshape(n, SCAN)
    return [HEAD + s.tobytes().replace(b"\xff", b"\xff\x00") + EOI for s in scans]


def write_avi(frames: list[bytes], side: int = SIDE, fps: int = FPS) -> bytes:
    def chunk(name: bytes, body: bytes) -> bytes:
        return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) & 1)

    most = max(map(len, frames))
    avih = struct.pack("<14I", 1_000_000 // fps, most * fps, 0, 0x10, len(frames), 0, 1, most, side * 8, side * 8, 0, 0, 0, 0)
    strh = b"vidsMJPG" + struct.pack("<IHHIIIIIIiIHHHH", 0, 0, 0, 0, 1, fps, 0, len(frames), most, -1, 0, 0, 0, side * 8, side * 8)
    strf = struct.pack("<IiiHH4sIiiII", 40, side * 8, side * 8, 1, 8, b"MJPG", side * side * 64, 0, 0, 0, 0)
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf)))
    parts, index, at = [], [], 4
    for f in frames:
        c = chunk(b"00dc", f)
        index.append(b"00dc" + struct.pack("<III", 0x10, at, len(f)))
        parts.append(c)
        at += len(c)
    body = hdrl + chunk(b"LIST", b"movi" + b"".join(parts)) + chunk(b"idx1", b"".join(index))
    return chunk(b"RIFF", b"AVI " + body)


def read_avi(data: bytes) -> tuple[int, list[bytes]]:
    """(frames a second, the frames that the index lists)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, fps, movi, index = 12, 8 + struct.unpack_from("<I", data, 4)[0], FPS, None, b""
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            fps = round(1_000_000 / max(1, struct.unpack_from("<I", data, at + 20)[0]))
        elif name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    if movi is None:
        raise ValueError("the file has no movi list")
    out = []
    for name, _, offset, size in struct.iter_unpack("<4sIII", index):
        if name[2:] == b"dc":
            start = movi + offset + 8
            out.append(data[start : start + size])
    return fps, out


def own(frame: bytes) -> bool:
    return frame.startswith(HEAD) and frame.endswith(EOI)


def scan_of(frame: bytes) -> bytes:
    """The entropy-coded bytes of a frame with this codec's own tables."""
    if not own(frame):
        raise ValueError("a frame has other tables than the codec's")
    return frame[len(HEAD) : -2].replace(b"\xff\x00", b"\xff")


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """uint8, (frames, 576): the sample of each flat block."""
    n = len(frames)
    raw = np.frombuffer(b"".join(map(scan_of, frames)), np.uint8).reshape(n, SCAN // 5, 5).astype(np.int64)
    five = raw[..., 0] << 32 | raw[..., 1] << 24 | raw[..., 2] << 16 | raw[..., 3] << 8 | raw[..., 4]
    words = np.stack([five >> s & 1023 for s in (30, 20, 10, 0)], axis=-1).reshape(n, FRAME)
    return (np.cumsum(DIFFERENCE[words], axis=1) + 128).astype(np.uint8)


def luminance(frames: list[bytes]) -> np.ndarray | list[np.ndarray]:
    """The samples of each frame: this codec's all at once, others one by one by the general decoder."""
    return decode_frames(frames) if all(map(own, frames)) else [jpeg.decode(f).ravel() for f in frames]


def shots(samples: np.ndarray | list[np.ndarray], window: int = 8, factor: float = 3.0, times: float = 3.0, least: float = 0.1) -> list[tuple[int, int]]:
    """(first frame, end) of each shot: cuts where 16-bin histograms differ clearly more than those around them do."""
    n = len(samples)
    if n == 1:
        return [(0, 1)]
    if isinstance(samples, list):
        bins = np.stack([np.bincount(f >> 4, minlength=16) / f.size for f in samples])
    else:
        bins = np.bincount((np.arange(n)[:, None] * 16 + (samples >> 4)).ravel(), minlength=16 * n).reshape(n, 16) / samples.shape[1]
    d = np.abs(np.diff(bins, axis=0)).sum(axis=1) / 2
    s1, s2 = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    i = np.arange(len(d))
    lo, hi = np.maximum(0, i - window), np.minimum(len(d), i + window + 1)
    m = np.maximum(1, hi - lo - 1)
    mean = (s1[hi] - s1[lo] - d) / m
    dev = np.sqrt(np.maximum(0, (s2[hi] - s2[lo] - d * d) / m - mean * mean))
    cuts = [0, *(np.flatnonzero((d > mean + factor * dev) & (d >= times * mean) & (d >= least)) + 1).tolist(), n]
    return list(zip(cuts, cuts[1:], strict=False))


def payload_of(text: str | None) -> tuple[int, np.ndarray]:
    """(UTF-8 bytes, those with bytes 255 up to a positive multiple of a frame, as frames)."""
    raw = (text or "").encode()
    return len(raw), np.frombuffer(raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME), np.uint8).reshape(-1, FRAME)


def to_media(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_bytes and media (an AVI file, binary) for each row."""
    return _map(docs, key, text, "n_bytes long, media binary", lambda n, media: {"n_bytes": n, "media": media})


def clip_rows(media: DataFrame, key: str = "doc_id", column: str = "media") -> DataFrame:
    """One row per shot: doc_id, clip, start_s, end_s, frames, mean sample and the histogram's entropy in bits."""
    ship(media.sparkSession)
    src = media.select(F.col(key).alias("doc_id"), F.col(column).alias("media"))
    schema = T.StructType([src.schema["doc_id"], *T.StructType.fromDDL("clip int, start_s double, end_s double, frames int, mean double, entropy double").fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out = []
            for k, m in zip(b["doc_id"], b["media"], strict=True):
                fps, frames = read_avi(bytes(m))
                if frames:
                    samples = luminance(frames)
                    out += [(k, i, lo / fps, hi / fps, hi - lo, *stats(np.concatenate(samples[lo:hi]))) for i, (lo, hi) in enumerate(shots(samples))]
            yield pd.DataFrame(out, columns=schema.names)

    return src.mapInPandas(run, schema)


def stats(samples: np.ndarray) -> tuple[float, float]:
    p = np.bincount(samples.ravel(), minlength=256) / samples.size
    p = p[p > 0]
    return float(samples.mean()), float(-(p * np.log2(p)).sum())


def digests(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Store each text as media, read the stored bytes back, and describe what came back and its shots."""

    def row(n: int, media: bytes) -> dict:
        fps, frames = read_avi(media)
        samples = decode_frames(frames)
        back = samples.tobytes()
        found = shots(samples)
        mean, entropy = stats(samples)
        longest = max(hi - lo for lo, hi in found)
        feature = f"frames={len(samples)};shots={len(found)};seconds={len(samples) / fps:.2f};longest={longest / fps:.2f};mean={mean:.3f};entropy={entropy:.3f}"
        return {"n_bytes": n, "payload_bytes": len(back), "payload_sha256": hashlib.sha256(back).hexdigest(), "tail_crc32": zlib.crc32(back[-32:]), "media_bytes": len(media), "media_sha256": hashlib.sha256(media).hexdigest(), "feature": feature}

    return _map(docs, key, text, "n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string", row)


def _map(docs: DataFrame, key: str, text: str, columns: str, row) -> DataFrame:
    ship(docs.sparkSession)
    src = docs.select(F.col(key).alias("doc_id"), F.col(text).cast("string").alias("text"))
    schema = T.StructType([src.schema["doc_id"], *T.StructType.fromDDL(columns).fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for s in range(0, len(b), 500):
                some = b.iloc[s : s + 500]
                out = []
                for t in some["text"]:
                    n, samples = payload_of(t)
                    out.append(row(n, write_avi(encode_frames(samples))))
                got = pd.DataFrame(out, columns=schema.names[1:])
                got.insert(0, "doc_id", some["doc_id"].to_numpy())
                yield got

    return src.mapInPandas(run, schema)
