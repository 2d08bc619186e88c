import struct

import numpy as np
import pytest

from quernel.llm import jpeg, media


def written(image, q, restart=0):
    """A plain encoder: one component, all codes of 8 bits but the last."""
    h, w = image.shape
    symbols = {0: list(range(12)), 1: [r << 4 | s for r in range(16) for s in range(11) if s or r in (0, 15)]}
    code = {k: {s: i for i, s in enumerate(v)} for k, v in symbols.items()}
    bits, out, last, n = "", [], 0, 0

    def number(v):
        size = abs(int(v)).bit_length()
        return size, format(int(v) if v > 0 else int(v) + (1 << size) - 1, f"0{size}b") if size else ""

    def flush():
        nonlocal bits
        bits += "1" * (-len(bits) % 8)
        out.append(bytes(int(bits[i : i + 8], 2) for i in range(0, len(bits), 8)).replace(b"\xff", b"\xff\x00"))
        bits = ""

    for y in range(0, h, 8):
        for x in range(0, w, 8):
            if restart and n and n % restart == 0:
                flush()
                out.append(bytes([0xFF, 0xD0 + (n // restart - 1) % 8]))
                last = 0
            n += 1
            c = np.round(jpeg.COSINES @ (image[y : y + 8, x : x + 8].astype(float) - 128) @ jpeg.COSINES.T / q).astype(int).ravel()[jpeg.ZIGZAG]
            size, b = number(c[0] - last)
            last = c[0]
            bits += format(code[0][size], "08b") + b
            run = 0
            for v in c[1 : np.flatnonzero(c)[-1] + 1 if c.any() else 1]:
                if not v:
                    run += 1
                    continue
                while run > 15:
                    bits += format(code[1][0xF0], "08b")
                    run -= 16
                size, b = number(v)
                bits += format(code[1][run << 4 | size], "08b") + b
                run = 0
            if not c[63]:
                bits += format(code[1][0], "08b")
    flush()
    seg = media._segment
    tables = b"".join(seg(0xC4, bytes([k << 4, *[0] * 7, len(v), *[0] * 8, *v])) for k, v in symbols.items())
    head = b"\xff\xd8" + seg(0xDB, bytes([0, *[q] * 64])) + seg(0xC0, struct.pack(">BHHB", 8, h, w, 1) + bytes([1, 0x11, 0])) + tables
    return head + (seg(0xDD, struct.pack(">H", restart)) if restart else b"") + seg(0xDA, bytes([1, 1, 0, 0, 63, 0])) + b"".join(out) + b"\xff\xd9"


@pytest.mark.parametrize("restart", [0, 3])
def test_general_decoder(restart):
    r = np.random.default_rng(restart)
    for image in (r.integers(0, 256, (24, 40)), np.add.outer(np.arange(32), np.arange(16) * 3) % 256, np.full((8, 8), 7)):
        got = jpeg.decode(written(image.astype(np.uint8), 1, restart))
        assert got.shape == image.shape and np.abs(got.astype(int) - image).max() <= 2


def test_own_frames_decode_alike():
    samples = np.random.default_rng(1).integers(0, 256, (3, 576)).astype(np.uint8)
    for frame, s in zip(media.encode_frames(samples), samples, strict=True):
        assert (jpeg.decode(frame) == np.kron(s.reshape(24, 24), np.ones((8, 8), np.uint8))).all()


def test_clips_of_other_writers_files(spark):
    dark, light = (written(np.full((16, 16), v, np.uint8), 2) for v in (20, 220))
    avi = media.write_avi([dark] * 10 + [light] * 15)
    got = media.clip_rows(spark.createDataFrame([(1, bytearray(avi))], "doc_id long, media binary")).orderBy("clip").collect()
    assert [(c["frames"], c["mean"]) for c in got] == [(10, 20.0), (15, 220.0)]


def test_what_is_no_baseline_frame():
    for bad in (b"", b"\xff\xd8\xff\xd9", b"\xff\xd8" + media._segment(0xC2, bytes(15))):
        with pytest.raises(ValueError):
            jpeg.decode(bad)
