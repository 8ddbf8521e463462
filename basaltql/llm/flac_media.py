"""FLAC media columns: lossless storage of 8-bit blocks, and reading them back.

`encode` writes one FLAC stream per row: STREAMINFO with the MD5 of the samples, a SEEKTABLE with sample and byte
offsets, and mono 8-bit frames of BLOCK samples.  Each frame takes the shortest of a constant, a verbatim, a fixed
(orders 0 to 2) and a second-order linear predictor subframe with Rice-coded residuals.  `decode` finds the frames by
their headers, verifies CRC-8 and CRC-16 of each and the MD5 of all, decodes residuals and predictors and gives PCM
blocks with sample and byte offsets, so a reader can start anywhere; `decode_any` does the same for streams of other
encoders (`flac_reader`).  Frames are coded side by side as rows of numpy arrays, CHUNK of them at a time; besides these
a task holds the streams of one text, or of several short ones.

Null text is stored as the empty one; every payload has one block at least.  A null doc_id stays null.  Equal texts
give equal streams.  Extra columns are ignored.  A broken stream raises BrokenStream.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_buffers
from .flac_reader import pcm_bytes, read

BLOCK, RATE, SEEK_EVERY, CHUNK = 192, 8000, 256, 6144
#: Fixed values of the format: precision and shift chosen for the linear predictor; the most bits of a subframe.
PRECISION, SHIFT, WIDEST = 12, 9, 8 + BLOCK * 8
HEAD = bytes([0xFF, 0xF8, 0x10, 0x02])
BITS = WIDEST + 16


class BrokenStream(ValueError):
    """A stream that isn't as encode() writes it, or that fails a checksum."""


def _table(poly: int, width: int) -> np.ndarray:
    t = np.arange(256, dtype=np.uint32) << (width - 8)
    for _ in range(8):
        t = np.where(t >> (width - 1) & 1, (t << 1) ^ poly, t << 1) & ((1 << width) - 1)
    return t.astype(np.uint16)


CRC8, CRC16 = _table(0x07, 8), _table(0x8005, 16)


def _crc8(rows: np.ndarray) -> np.ndarray:
    crc = np.zeros(len(rows), np.uint16)
    for k in range(rows.shape[1]):
        crc = CRC8[crc ^ rows[:, k]]
    return crc.astype(np.uint8)


def _crc16(rows: np.ndarray) -> np.ndarray:
    """Of rows aligned to the right: leading zeros leave the checksum at zero."""
    crc, by = np.zeros(len(rows), np.uint16), np.ascontiguousarray(rows.T)
    for col in by:
        crc = (crc << np.uint16(8)) ^ CRC16[(crc >> np.uint16(8)) ^ col]
    return crc


def _numbers(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Frame numbers as the format writes them (UTF-8 alike), right-aligned in 6 bytes, and their lengths."""
    size = 1 + (n >= 1 << 7) + (n >= 1 << 11) + (n >= 1 << 16) + (n >= 1 << 21) + (n >= 1 << 26)
    out = np.zeros((len(n), 6), np.uint8)
    lead = np.array([0, 0x00, 0xC0, 0xE0, 0xF0, 0xF8, 0xFC])
    for k in range(6):  # from the last byte
        is_lead = size == k + 1
        out[:, 5 - k] = np.where(is_lead, lead[size] | (n >> (6 * k)), np.where(k < size, 0x80 | ((n >> (6 * k)) & 0x3F), 0))
    return out, size


def _zigzag(r):
    return ((r << 1) ^ (r >> 31)).astype(np.int32)


def _linear(x: np.ndarray) -> np.ndarray:
    """Second-order predictor coefficients of each row, in units of 2**-SHIFT."""
    f = x.astype(np.float64)
    r0, r1, r2 = (f * f).sum(1), (f[:, 1:] * f[:, :-1]).sum(1), (f[:, 2:] * f[:, :-2]).sum(1)
    det = r0 * r0 - r1 * r1
    det = np.where(det > 0, det, 1)
    a = np.stack([r1 * (r0 - r2) / det, (r0 * r2 - r1 * r1) / det], 1)
    return np.clip(np.rint(a * (1 << SHIFT)), -(1 << PRECISION - 1), (1 << PRECISION - 1) - 1).astype(np.int32)


def _subframes(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Packed subframes of rows of BLOCK signed samples, left-aligned, and their lengths in bytes."""
    n = len(x)
    coef = _linear(x)
    d1 = x[:, 1:] - x[:, :-1]
    forms = [(0, 0x10, x), (1, 0x12, d1), (2, 0x14, d1[:, 1:] - d1[:, :-1]), (2, 0x42, x[:, 2:] - ((coef[:, :1] * x[:, 1:-1] + coef[:, 1:] * x[:, :-2]) >> SHIFT))]
    best, cost, rice = np.full(n, -1), np.full(n, WIDEST), np.zeros(n, np.int32)
    codes = []
    for i, (order, kind, res) in enumerate(forms):
        u = _zigzag(res)
        codes.append(u)
        mean = u.sum(1) / u.shape[1]
        low = np.clip(np.floor(np.log2(np.maximum(mean * 0.69, 1))).astype(np.int32), 0, 13)
        for k in (low, low + 1):
            bits = 8 + 8 * order + 10 + (9 + 2 * PRECISION) * (kind == 0x42) + (u >> k[:, None]).sum(1) + u.shape[1] * (k + 1)
            better = bits < cost
            best[better], cost[better], rice[better] = i, bits[better], k[better]
    flat = (x == x[:, :1]).all(1)
    best[flat] = -2
    bits = np.zeros((n, BITS), np.uint8)
    length = np.full(n, WIDEST)
    # constant and verbatim
    own = np.flatnonzero(flat)
    bits[own, 8:16] = np.unpackbits((x[own, :1] & 0xFF).astype(np.uint8), axis=1)
    length[own] = 16
    own = np.flatnonzero(best == -1)
    bits[own, 6] = 1
    bits[own, 8:WIDEST] = np.unpackbits((x[own] & 0xFF).astype(np.uint8), axis=1)
    for i, (order, kind, _) in enumerate(forms):
        for k in np.unique(rice[best == i]).tolist():
            own = np.flatnonzero((best == i) & (rice == k))
            head = [np.full(len(own), kind), *(x[own, j] & 0xFF for j in range(order))]
            part = np.unpackbits(np.stack(head, 1).astype(np.uint8), axis=1)
            if kind == 0x42:
                fields = [(np.full(len(own), PRECISION - 1), 4), (np.full(len(own), SHIFT), 5), (coef[own, 0], PRECISION), (coef[own, 1], PRECISION)]
                part = np.concatenate([part, *(((v[:, None] >> np.arange(w - 1, -1, -1)) & 1).astype(np.uint8) for v, w in fields)], axis=1)
            rest = np.array([(k >> (3 - j)) & 1 if j >= 0 else 0 for j in range(-6, 4)], np.uint8)
            part = np.concatenate([part, np.broadcast_to(rest, (len(own), 10))], axis=1)
            bits[own, : part.shape[1]] = part
            u = codes[i][own]
            q = u >> k
            size = q + (k + 1)
            stop = np.cumsum(size, axis=1) + part.shape[1]
            one = (own * BITS)[:, None] + stop - k - 1
            line = bits.reshape(-1)
            line[one] = 1
            for b in range(k):
                line[one + (b + 1)] = (u >> (k - 1 - b)) & 1
            length[own] = stop[:, -1]
    return np.packbits(bits, axis=1), (length + 7) // 8


def _frames(x: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All frames' bytes in a row, and each frame's length."""
    sub, size = _subframes(x)
    num, nsize = _numbers(number)
    n = len(x)
    head = np.zeros((n, 10), np.uint8)
    head[np.arange(n)[:, None], 6 - nsize[:, None] + np.arange(4)] = np.frombuffer(HEAD, np.uint8)
    cols = np.arange(6)[None, :] >= 6 - nsize[:, None]
    head[:, 4:][cols] = num[cols]
    width = 11 + sub.shape[1]
    out = np.zeros((n, width + 2), np.uint8)
    at = width - size[:, None] - 11
    rows = np.arange(n)[:, None]
    out[rows, at + np.arange(10)] = head
    out[rows[:, 0], at[:, 0] + 10] = _crc8(head)
    body = np.arange(sub.shape[1])[None, :] < size[:, None]
    spot = np.broadcast_to(at + 11 + np.arange(sub.shape[1]), sub.shape)
    out.reshape(-1)[(rows * (width + 2) + spot)[body]] = sub[body]
    crc = _crc16(out[:, :width])
    out[:, width], out[:, width + 1] = crc >> 8, crc & 0xFF
    total = size + 11 - 6 + nsize + 2
    return out[np.arange(width + 2)[None, :] >= width + 2 - total[:, None]], total


def padded(text: bytes) -> bytes:
    return text + b" " * ((-len(text)) % BLOCK if text else BLOCK)


def _stream(payload_md5: bytes, blocks: int, sizes: np.ndarray) -> bytes:
    """Everything before the frames."""
    info = struct.pack(">HH", BLOCK, BLOCK) + int(sizes.min()).to_bytes(3, "big") + int(sizes.max()).to_bytes(3, "big")
    info += (RATE << 44 | 0 << 41 | 7 << 36 | blocks * BLOCK).to_bytes(8, "big") + payload_md5
    offsets = np.cumsum(sizes) - sizes
    points = b"".join(struct.pack(">QQH", i * BLOCK, int(offsets[i]), BLOCK) for i in range(0, blocks, SEEK_EVERY))
    return b"fLaC" + b"\0" + len(info).to_bytes(3, "big") + info + b"\x83" + len(points).to_bytes(3, "big") + points


def encode_payloads(payloads: list[bytes]) -> list[bytes]:
    """FLAC streams of payloads whose lengths are positive multiples of BLOCK."""
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    blocks = np.array([len(p) // BLOCK for p in payloads])
    first = np.cumsum(blocks) - blocks
    number = np.arange(blocks.sum()) - np.repeat(first, blocks)
    data, sizes = [], []
    for lo in range(0, len(number), CHUNK):
        x = raw[lo * BLOCK : (lo + CHUNK) * BLOCK].reshape(-1, BLOCK).astype(np.int32) - 128
        d, s = _frames(x, number[lo : lo + CHUNK])
        data.append(d.tobytes())
        sizes.append(s)
    sizes, data = np.concatenate(sizes), b"".join(data)
    ends = np.cumsum(sizes)
    out = []
    for p, f, n in zip(payloads, first.tolist(), blocks.tolist(), strict=True):
        own = sizes[f : f + n]
        md5 = hashlib.md5((np.frombuffer(p, np.uint8) ^ 0x80).tobytes()).digest()
        out.append(_stream(md5, n, own) + data[int(ends[f] - own[0]) : int(ends[f + n - 1])])
    return out


def _rows(raw: np.ndarray, start: np.ndarray, size: np.ndarray, width: int, right: bool) -> np.ndarray:
    col = np.arange(width)[None, :]
    shift = (width - size)[:, None] if right else 0
    spot = start[:, None] + col - shift
    ok = (col >= shift) if right else (col < size[:, None])
    return np.where(ok, raw[np.clip(spot, 0, len(raw) - 1)], 0).astype(np.uint8)


def _samples(sub: np.ndarray) -> np.ndarray:
    """Signed samples of subframes, given as left-aligned rows of bytes."""
    n = len(sub)
    sub = np.concatenate([sub, np.zeros((n, 4), np.uint8)], axis=1)
    kind, x = sub[:, 0], np.zeros((n, BLOCK), np.int32)
    if not np.isin(kind, (0x00, 0x02, 0x10, 0x12, 0x14, 0x42)).all():
        raise BrokenStream("unknown subframe")
    if sub.shape[1] < 2 + BLOCK and (kind == 2).any():
        raise BrokenStream("a frame is too short")
    x[kind == 0] = sub[kind == 0, 1:2].view(np.int8)
    if (kind == 2).any():
        x[kind == 2] = sub[kind == 2, 1 : 1 + BLOCK].view(np.int8)
    for form, order in ((0x10, 0), (0x12, 1), (0x14, 2), (0x42, 2)):
        own = np.flatnonzero(kind == form)
        if not len(own):
            continue
        b = sub[own]
        wide = b.shape[1] * 8
        bits = np.unpackbits(b, axis=1)
        at = 8 + 8 * order
        coef = None
        if form == 0x42:
            weights = 1 << np.arange(PRECISION - 1, -1, -1)
            if (bits[:, at : at + 9] != [*map(int, f"{PRECISION - 1:04b}{SHIFT:05b}")]).any():
                raise BrokenStream("unknown precision or shift")
            coef = np.stack([bits[:, at + 9 + j * PRECISION : at + 9 + (j + 1) * PRECISION] @ weights for j in range(2)], 1)
            coef = np.where(coef >> (PRECISION - 1), coef - (1 << PRECISION), coef)
            at += 9 + 2 * PRECISION
        if bits[:, at : at + 6].any():
            raise BrokenStream("unknown residual coding")
        k = bits[:, at + 6 : at + 10] @ np.array([8, 4, 2, 1])
        at += 10
        nxt = np.where(bits, np.arange(wide, dtype=np.int16), np.int16(wide - 1))
        nxt = np.minimum.accumulate(nxt[:, ::-1], axis=1)[:, ::-1].reshape(-1)
        base, pos, step = np.arange(len(own)) * wide, np.full(len(own), at), k + 1
        m = BLOCK - order
        begin, one = np.empty((m, len(own)), np.int32), np.empty((m, len(own)), np.int32)
        for j in range(m):
            begin[j] = pos
            one[j] = p = nxt[base + np.minimum(pos, wide - 1)]
            pos = p + step
        q, one = (one - begin).T, one.T
        words = (b[:, :-2].astype(np.int32) << 16) | (b[:, 1:-1].astype(np.int32) << 8) | b[:, 2:]
        spot = np.minimum(one + 1, wide - 25)
        got = words.reshape(-1)[(np.arange(len(own)) * words.shape[1])[:, None] + (spot >> 3)]
        low = (got >> (24 - (spot & 7) - k[:, None])) & ((1 << k[:, None]) - 1)
        u = (q << k[:, None]) | low
        r = (u >> 1) ^ -(u & 1)
        warm = b[:, 1 : 1 + order].view(np.int8).astype(np.int32)
        y = np.concatenate([warm, r], axis=1)
        if form == 0x12:
            y = np.cumsum(y, axis=1)
        elif form == 0x14:
            d = np.cumsum(np.concatenate([(warm[:, 1] - warm[:, 0])[:, None], r], axis=1), axis=1)
            y = np.cumsum(np.concatenate([warm[:, :1], d], axis=1), axis=1)
        elif form == 0x42:
            t = np.ascontiguousarray(y.T)
            for j in range(2, BLOCK):
                t[j] += (coef[:, 0] * t[j - 1] + coef[:, 1] * t[j - 2]) >> SHIFT
            y = t.T
        x[own] = y
    return x


def decode_streams(streams: list[bytes]) -> list[tuple[bytes, np.ndarray]]:
    """(payload, byte offset of each block's frame in the stream) of streams that encode_payloads() wrote."""
    begin, blocks, md5 = [], [], []
    for s in streams:
        if s[:4] != b"fLaC" or len(s) < 46:
            raise BrokenStream("no FLAC stream")
        at, last, info = 4, False, s[8:42]
        while not last:
            last, size = s[at] >> 7, int.from_bytes(s[at + 1 : at + 4], "big")
            at += 4 + size
        word = int.from_bytes(info[10:18], "big")
        if word >> 36 & 0x1F != 7 or word >> 41 & 7 or word & ((1 << 36) - 1) == 0 or (word & ((1 << 36) - 1)) % BLOCK:
            raise BrokenStream("not mono blocks of 8-bit samples")
        begin.append(at)
        blocks.append((word & ((1 << 36) - 1)) // BLOCK)
        md5.append(info[18:34])
    raw = np.frombuffer(b"".join(streams), np.uint8)
    lens = np.array([len(s) for s in streams])
    base = np.cumsum(lens) - lens
    # frames: a header with a right checksum and the next number
    at = np.flatnonzero((raw[:-3] == HEAD[0]) & (raw[1:-2] == HEAD[1]) & (raw[2:-1] == HEAD[2]) & (raw[3:] == HEAD[3])) if len(raw) > 3 else np.zeros(0, int)
    lead = raw[np.minimum(at + 4, len(raw) - 1)]
    nsize = np.select([lead < 0x80, lead < 0xE0, lead < 0xF0, lead < 0xF8, lead < 0xFC], [1, 2, 3, 4, 5], 6)
    heads = _rows(raw, at, nsize + 4, 10, True)
    right = _crc8(heads) == raw[np.minimum(at + 4 + nsize, len(raw) - 1)]
    masks = np.array([0, 0x7F, 0x1F, 0x0F, 0x07, 0x03, 0x01])
    num = np.zeros(len(at), np.int64)
    for j in range(6):
        byte = heads[:, 4 + j].astype(np.int64)
        num = np.where(j == 6 - nsize, byte & masks[nsize], np.where(j > 6 - nsize, num << 6 | byte & 0x3F, num))
    of = np.searchsorted(base, at, side="right") - 1
    right &= at >= base[of] + np.array(begin)[of]
    at, num, of, nsize = at[right], num[right], of[right], nsize[right]
    want = np.concatenate([np.arange(n) for n in blocks])
    owner = np.repeat(np.arange(len(streams)), blocks)
    if len(num) != len(want) or (num != want).any() or (of != owner).any():
        keep, k = [], 0
        for i in range(len(num)):
            if k < len(want) and num[i] == want[k] and of[i] == owner[k]:
                keep.append(i)
                k += 1
        if k < len(want):
            raise BrokenStream("a frame is missing")
        at, num, of, nsize = at[keep], num[keep], of[keep], nsize[keep]
    stop = np.append(at[1:], 0)
    ends = base + lens
    stop = np.where(np.append(of[1:] != of[:-1], True), ends[of], stop)
    size, out = stop - at, []
    if (size > 32 + BITS // 8).any() or (size < nsize + 9).any():
        raise BrokenStream("a frame is too long or too short")
    for lo in range(0, len(at), CHUNK):
        a, z, h = at[lo : lo + CHUNK], size[lo : lo + CHUNK], nsize[lo : lo + CHUNK] + 5
        if _crc16(_rows(raw, a, z, int(z.max()), True)).any():
            raise BrokenStream("a frame's checksum is wrong")
        body = z - h - 2
        out.append((_samples(_rows(raw, a + h, body, max(int(body.max()), 2), False)) + 128).astype(np.uint8).tobytes())
    pcm, first, got = b"".join(out), 0, []
    for i, n in enumerate(blocks):
        payload = pcm[first * BLOCK : (first + n) * BLOCK]
        if hashlib.md5((np.frombuffer(payload, np.uint8) ^ 0x80).tobytes()).digest() != md5[i]:
            raise BrokenStream("the samples' MD5 is wrong")
        got.append((payload, at[first : first + n] - base[i]))
        first += n
    return got


def _chunks(sizes: np.ndarray, most: int = CHUNK * BLOCK):
    """Ranges of rows of about `most` bytes."""
    lo = total = 0
    for i, s in enumerate(sizes.tolist()):
        total += s + BLOCK
        if total >= most:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(sizes):
        yield lo, len(sizes)


def encode(documents: DataFrame) -> DataFrame:
    """doc_id, n_bytes (of the text) and media (a FLAC stream of the padded text)."""

    def each(batches):
        for b in batches:
            offsets, _ = binary_buffers(b.column(1))
            for lo, hi in _chunks(np.diff(offsets)):
                part = [t.as_buffer().to_pybytes() for t in b.column(1)[lo:hi]]
                media = encode_payloads([padded(t) for t in part])
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], pa.array([len(t) for t in part], pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    return docs.mapInArrow(each, "doc_id long, n_bytes long, media binary")


def decode(media: DataFrame) -> DataFrame:
    """One row per PCM block: doc_id, block, sample_offset, byte_offset (of its frame in the stream) and pcm."""

    def each(batches):
        for b in batches:
            offsets, _ = binary_buffers(b.column(1))
            for lo, hi in _chunks(np.diff(offsets)):
                for i, (payload, at) in zip(b.column(0)[lo:hi].to_pylist(), decode_streams([t.as_buffer().to_pybytes() for t in b.column(1)[lo:hi]]), strict=True):
                    n = len(at)
                    yield pa.RecordBatch.from_arrays([pa.array([i] * n, pa.int64()), pa.array(np.arange(n)), pa.array(np.arange(n) * BLOCK), pa.array(at), pa.array([payload[k * BLOCK : (k + 1) * BLOCK] for k in range(n)], pa.binary())], ["doc_id", "block", "sample_offset", "byte_offset", "pcm"])

    return media.select("doc_id", "media").mapInArrow(each, "doc_id long, block long, sample_offset long, byte_offset long, pcm binary")


def decode_any(media: DataFrame) -> DataFrame:
    """Like `decode`, for any FLAC streams: pcm is interleaved little-endian samples in whole bytes, 8-bit ones signed."""

    def each(batches):
        for b in batches:
            for i, stream in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                got = read(stream.as_buffer().to_pybytes())
                ends = [s for s, _ in got.frames[1:]] + [got.samples.shape[1]]
                pcm = [pcm_bytes(got.samples[:, s:e], got.bits) for (s, _), e in zip(got.frames, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(pcm), pa.int64()), pa.array(np.arange(len(pcm))), pa.array([s for s, _ in got.frames], pa.int64()), pa.array([at for _, at in got.frames], pa.int64()), pa.array(pcm, pa.binary())], ["doc_id", "block", "sample_offset", "byte_offset", "pcm"])

    return media.where("media is not null").select("doc_id", "media").mapInArrow(each, "doc_id long, block long, sample_offset long, byte_offset long, pcm binary")


def features(media: DataFrame) -> DataFrame:
    """Reads each stream back: digests of payload and stream, and a feature string (sum, energy, zero crossings, peak)."""

    def each(batches):
        for b in batches:
            offsets, _ = binary_buffers(b.column(2))
            for lo, hi in _chunks(np.diff(offsets)):
                streams = [t.as_buffer().to_pybytes() for t in b.column(2)[lo:hi]]
                out = []
                for s, (p, _) in zip(streams, decode_streams(streams), strict=True):
                    x = np.frombuffer(p, np.uint8).astype(np.int32) - 128
                    feature = f"sum={int(x.sum(dtype=np.int64))};energy={int((x * x).sum(dtype=np.int64))};crossings={int(np.count_nonzero((x[1:] < 0) != (x[:-1] < 0)))};peak={int(np.abs(x).max())}"
                    out.append((len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:]), len(s), hashlib.sha256(s).hexdigest(), feature))
                cols = list(zip(*out, strict=True))
                types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([b.column(0)[lo:hi], b.column(1)[lo:hi], *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"])

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return media.select("doc_id", "n_bytes", "media").mapInArrow(each, schema)
