"""A baseline JPEG decoder for the luminance of a frame: any Huffman and quantization tables, sampling and restarts."""

from __future__ import annotations

import struct

import numpy as np


def _zigzag() -> np.ndarray:
    """The row-major place of each coefficient in scan order: along diagonals, up and down in turn."""
    cells = sorted(((r + c, r if (r + c) % 2 else c, r, c) for r in range(8) for c in range(8)))
    return np.array([8 * r + c for _, _, r, c in cells])


ZIGZAG = _zigzag()
_k = np.arange(8)
#: Row u holds the u-th cosine at the eight places.
COSINES = np.where(_k[:, None] == 0, 0.5**0.5, 1.0) / 2 * np.cos((2 * _k[None, :] + 1) * _k[:, None] * np.pi / 16)


def _codes(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) -> symbol: codes of one length follow each other, and each longer one goes on at twice the next."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(counts, 1):
        for _ in range(n):
            out[length, code] = symbols[at]
            code += 1
            at += 1
        code <<= 1
    return out


class _Bits:
    def __init__(self, data: bytes):
        self.data, self.at, self.held, self.n = data, 0, 0, 0

    def take(self, n: int) -> int:
        while self.n < n:
            byte = self.data[self.at] if self.at < len(self.data) else 0xFF  # past the end: ones, as fill bits are
            self.held = (self.held << 8 | byte) & 0xFFFFFFFF
            self.at += 1
            self.n += 8
        self.n -= n
        return self.held >> self.n & ((1 << n) - 1)

    def symbol(self, table: dict[tuple[int, int], int]) -> int:
        code = 0
        for length in range(1, 17):
            code = code << 1 | self.take(1)
            got = table.get((length, code))
            if got is not None:
                return got
        raise ValueError("a code that no table has")

    def value(self, size: int) -> int:
        v = self.take(size) if size else 0
        return v if not size or v >> (size - 1) else v - (1 << size) + 1


def _runs(data: bytes, at: int) -> tuple[list[bytes], int]:
    """The entropy-coded stretches between restart markers from `at` on, without stuffed zeros; where they end."""
    out, start = [], at
    while True:
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            at = len(data)
            break
        mark = data[at + 1]
        if mark == 0:
            at += 2
        elif 0xD0 <= mark <= 0xD7:
            out.append(data[start:at])
            at += 2
            start = at
        elif mark == 0xFF:
            at += 1
        else:
            break
    out.append(data[start:at])
    return [r.replace(b"\xff\x00", b"\xff") for r in out], at


def decode(data: bytes) -> np.ndarray:
    """uint8, (height, width): the first component at its own resolution."""
    quant, tables, parts, restart, size = {}, {}, [], 0, None
    at = 2
    if data[:2] != b"\xff\xd8":
        raise ValueError("not a JPEG")
    while at + 4 <= len(data):
        if data[at] != 0xFF:
            raise ValueError("a marker is missing")
        mark = data[at + 1]
        if mark == 0xFF:
            at += 1
            continue
        (n,) = struct.unpack_from(">H", data, at + 2)
        body = data[at + 4 : at + 2 + n]
        at += 2 + n
        if mark == 0xDB:
            while body:
                wide, name = body[0] >> 4, body[0] & 15
                quant[name] = np.frombuffer(body, ">u2" if wide else "u1", 64, 1).astype(np.int64)
                body = body[129 if wide else 65 :]
        elif mark == 0xC4:
            while body:
                total = sum(body[1:17])
                tables[body[0]] = _codes(body[1:17], body[17 : 17 + total])
                body = body[17 + total :]
        elif mark in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of other than 8 bits")
            size = struct.unpack_from(">HH", body, 1)
            parts = [{"id": body[6 + 3 * i], "h": body[7 + 3 * i] >> 4, "v": body[7 + 3 * i] & 15, "q": body[8 + 3 * i]} for i in range(body[5])]
        elif 0xC2 <= mark <= 0xCF and mark != 0xC8 and mark != 0xCC:
            raise ValueError("not a baseline frame")
        elif mark == 0xDD:
            (restart,) = struct.unpack(">H", body[:2])
        elif mark == 0xDA:
            if size is None:
                raise ValueError("a scan without a frame")
            for i in range(body[0]):
                p = next(p for p in parts if p["id"] == body[1 + 2 * i])
                p["dc"], p["ac"] = tables[body[2 + 2 * i] >> 4], tables[0x10 | body[2 + 2 * i] & 15]
            if body[0] != len(parts):
                raise ValueError("scans of single components")
            return _scan(_runs(data, at)[0], parts, quant, restart, *size)
    raise ValueError("no scan")


def _scan(runs: list[bytes], parts: list[dict], quant: dict, restart: int, height: int, width: int) -> np.ndarray:
    first = parts[0]
    if len(parts) == 1:
        first["h"] = first["v"] = 1
    hmax, vmax = max(p["h"] for p in parts), max(p["v"] for p in parts)
    across, down = -(-width // (8 * hmax)), -(-height // (8 * vmax))
    coefs = np.zeros((down * first["v"], across * first["h"], 64), np.int64)
    total, bits, run, last = across * down, _Bits(runs[0]), 0, [0] * len(parts)
    for m in range(total):
        if restart and m and m % restart == 0:
            run += 1
            if run >= len(runs):
                break  # cut off: the rest stays gray
            bits, last = _Bits(runs[run]), [0] * len(parts)
        y, x = divmod(m, across)
        for k, p in enumerate(parts):
            for v in range(p["v"]):
                for h in range(p["h"]):
                    last[k] += bits.value(bits.symbol(p["dc"]))
                    block, i = {0: last[k]}, 1
                    while i < 64:
                        s = bits.symbol(p["ac"])
                        if not s & 15:
                            if s != 0xF0:
                                break
                            i += 16
                            continue
                        i += s >> 4
                        block[i] = bits.value(s & 15)
                        i += 1
                    if not k:
                        cell = coefs[y * p["v"] + v, x * p["h"] + h]
                        for i, c in block.items():
                            cell[ZIGZAG[min(i, 63)]] = c
    q = np.zeros(64, np.int64)
    q[ZIGZAG] = quant[first["q"]]
    blocks = (coefs * q).reshape(*coefs.shape[:2], 8, 8)
    pixels = np.einsum("ur,yxuv,vc->yrxc", COSINES, blocks, COSINES).reshape(blocks.shape[0] * 8, -1) + 128
    return np.clip(np.round(pixels), 0, 255).astype(np.uint8)[: -(-height * first["v"] // vmax), : -(-width * first["h"] // hmax)]
