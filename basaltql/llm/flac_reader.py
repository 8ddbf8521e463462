"""Any FLAC stream to PCM: all subframes, predictor orders, Rice partitions and escapes, channel layouts, block sizes and sample sizes.

One stream at a time, bit by bit; `flac_media.decode_streams` reads what `flac_media` writes itself side by side.  Every
frame's CRC-8 and CRC-16 and, where the stream has one, the MD5 of all samples are verified.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

import numpy as np


class BadStream(ValueError):
    """A stream that breaks the format or fails a checksum."""


#: Fixed values of the format: block sizes and sample sizes by code, and the fixed predictors' weights by order.
BLOCK_SIZES = {1: 192, **{c: 576 << (c - 2) for c in range(2, 6)}, **{c: 256 << (c - 8) for c in range(8, 16)}}
SAMPLE_SIZES = {1: 8, 2: 12, 4: 16, 5: 20, 6: 24, 7: 32}
FIXED = [[], [1], [2, -1], [3, -3, 1], [4, -6, 4, -1]]


def _crc_table(poly: int, width: int) -> list[int]:
    out, top, full = [], 1 << (width - 1), (1 << width) - 1
    for crc in range(256):
        crc <<= width - 8
        for _ in range(8):
            crc = (crc << 1 ^ poly if crc & top else crc << 1) & full
        out.append(crc)
    return out


#: By polynomial and width.
TABLES = {key: _crc_table(*key) for key in ((0x07, 8), (0x8005, 16))}


def _crc(data: bytes, poly: int, width: int) -> int:
    crc, table, shift, full = 0, TABLES[poly, width], width - 8, (1 << width) - 1
    for byte in data:
        crc = (crc << 8 & full) ^ table[crc >> shift ^ byte]
    return crc


class Bits:
    """Bits of a buffer, most significant first."""

    def __init__(self, data: bytes, at: int):
        self.data, self.at = data, 8 * at

    def take(self, n: int) -> int:
        if self.at + n > 8 * len(self.data):
            raise BadStream("the stream ends early")
        lo, hi = self.at >> 3, (self.at + n + 7) >> 3
        word = int.from_bytes(self.data[lo:hi], "big") >> (8 * hi - self.at - n)
        self.at += n
        return word & ((1 << n) - 1)

    def signed(self, n: int) -> int:
        x = self.take(n) if n else 0
        return x - (1 << n) if n and x >> (n - 1) else x

    def unary(self) -> int:
        """Zeros before the next one."""
        n = 0
        while not self.take(1):
            n += 1
        return n

    def align(self) -> int:
        self.at = -(-self.at // 8) * 8
        return self.at // 8


def _residual(bits: Bits, size: int, order: int) -> list[int]:
    form = bits.take(2)
    if form > 1:
        raise BadStream("unknown residual coding")
    wide, parts = 4 + form, 1 << bits.take(4)
    if size % parts or size // parts < order:
        raise BadStream("partitions don't fit the block")
    out = []
    for k in range(parts):
        n, rice = size // parts - (order if not k else 0), bits.take(wide)
        if rice == (1 << wide) - 1:
            raw = bits.take(5)
            out += [bits.signed(raw) for _ in range(n)]
        else:
            for _ in range(n):
                u = bits.unary() << rice
                u |= bits.take(rice) if rice else 0
                out.append(u >> 1 ^ -(u & 1))
    return out


def _subframe(bits: Bits, size: int, depth: int) -> list[int]:
    if bits.take(1):
        raise BadStream("a subframe begins with a one")
    kind, wasted = bits.take(6), 0
    if bits.take(1):
        wasted = bits.unary() + 1
    depth -= wasted
    if kind == 0:
        x = [bits.signed(depth)] * size
    elif kind == 1:
        x = [bits.signed(depth) for _ in range(size)]
    elif 8 <= kind <= 12 or kind >= 32:
        order = kind - 8 if kind < 32 else kind - 31
        x = [bits.signed(depth) for _ in range(order)]
        weights, shift = FIXED[order] if kind < 32 else [], 0
        if kind >= 32:
            precision = bits.take(4) + 1
            if precision == 16:
                raise BadStream("unknown precision")
            shift = bits.signed(5)
            if shift < 0:
                raise BadStream("a negative shift")
            weights = [bits.signed(precision) for _ in range(order)]
        for r in _residual(bits, size, order):
            x.append(r + (sum(w * x[-1 - j] for j, w in enumerate(weights)) >> shift))
    else:
        raise BadStream("unknown subframe")
    return [v << wasted for v in x] if wasted else x


def _utf8(bits: Bits) -> int:
    """A frame's or a sample's number."""
    first = bits.take(8)
    if first < 0x80:
        return first
    more = next((n for n in range(1, 7) if not first >> (6 - n) & 1), 0)
    number = first & ((1 << (6 - more)) - 1) if more < 6 else 0
    for _ in range(more):
        number = number << 6 | bits.take(8) & 0x3F
    return number


@dataclass
class Pcm:
    """Samples (one row per channel), their size and rate, and each frame's first sample and place in the stream."""

    samples: np.ndarray
    bits: int
    rate: int
    frames: list[tuple[int, int]] = field(default_factory=list)


def read(stream: bytes) -> Pcm:
    """A whole stream, verified."""
    if stream[:4] != b"fLaC":
        raise BadStream("no FLAC stream")
    at, last, info = 4, False, None
    while not last:
        if at + 4 > len(stream):
            raise BadStream("the stream ends early")
        last, kind, size = stream[at] >> 7, stream[at] & 0x7F, int.from_bytes(stream[at + 1 : at + 4], "big")
        if kind == 0:
            info = stream[at + 4 : at + 4 + size]
        at += 4 + size
    if info is None or len(info) < 34:
        raise BadStream("no STREAMINFO")
    word = int.from_bytes(info[10:18], "big")
    rate, channels, depth, total = word >> 44, (word >> 41 & 7) + 1, (word >> 36 & 31) + 1, word & (1 << 36) - 1
    parts, frames, done = [], [], 0
    while at < len(stream) and (not total or done < total):
        bits = Bits(stream, at)
        if bits.take(15) != 0x7FFC:
            raise BadStream("a frame is missing")
        bits.take(1)
        by_size, by_rate, layout, by_depth = bits.take(4), bits.take(4), bits.take(4), bits.take(3)
        if bits.take(1) or by_size == 0 or by_rate == 15 or layout > 10 or by_depth == 3:
            raise BadStream("a reserved value in a frame's header")
        _utf8(bits)
        size = BLOCK_SIZES.get(by_size) or bits.take(8 if by_size == 6 else 16) + 1
        if by_rate > 11:
            bits.take(8 if by_rate == 12 else 16)
        end = bits.align()
        if _crc(stream[at:end], 0x07, 8) != bits.take(8):
            raise BadStream("a header's checksum is wrong")
        own = SAMPLE_SIZES.get(by_depth, depth)
        n = layout + 1 if layout < 8 else 2
        if n != channels:
            raise BadStream("the number of channels changes")
        side = {8: 1, 9: 0, 10: 1}.get(layout)
        x = [np.array(_subframe(bits, size, own + (c == side)), np.int64) for c in range(n)]
        if layout == 8:  # left, side
            x[1] = x[0] - x[1]
        elif layout == 9:  # side, right
            x[0] = x[0] + x[1]
        elif layout == 10:  # middle, side
            middle = x[0] << 1 | x[1] & 1
            x = [(middle + x[1]) >> 1, (middle - x[1]) >> 1]
        end = bits.align()
        if _crc(stream[at:end], 0x8005, 16) != bits.take(16):
            raise BadStream("a frame's checksum is wrong")
        frames.append((done, at))
        parts.append(np.stack(x))
        done, at = done + size, end + 2
    samples = np.concatenate(parts, axis=1) if parts else np.zeros((channels, 0), np.int64)
    if total and done != total:
        raise BadStream("samples are missing")
    if any(info[18:34]) and hashlib.md5(pcm_bytes(samples, depth)).digest() != info[18:34]:
        raise BadStream("the samples' MD5 is wrong")
    return Pcm(samples, depth, rate, frames)


def pcm_bytes(samples: np.ndarray, bits: int) -> bytes:
    """Interleaved little-endian samples in whole bytes."""
    wide = -(-bits // 8)
    return np.ascontiguousarray(samples.T.astype("<i8")).view(np.uint8).reshape(-1, 8)[:, :wide].tobytes()
