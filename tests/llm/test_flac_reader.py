"""The general FLAC reader on streams of a plain encoder that uses what the operator's own encoder doesn't."""

import hashlib
import random

import numpy as np
import pytest

from basaltql.llm import flac_media, flac_reader
from basaltql.llm.flac_reader import FIXED, BadStream, _crc, pcm_bytes


class Out:
    def __init__(self):
        self.bits = []

    def put(self, x, n):
        self.bits += [x >> (n - 1 - k) & 1 for k in range(n)]

    def data(self):
        pad = self.bits + [0] * (-len(self.bits) % 8)
        return bytes(int("".join(map(str, pad[k : k + 8])), 2) for k in range(0, len(pad), 8))


def residual(out, r, size, order, parts, form, escape):
    out.put(form, 2)
    out.put(parts, 4)
    lo = 0
    for k in range(1 << parts):
        n = size // (1 << parts) - (order if not k else 0)
        own, lo = r[lo : lo + n], lo + n
        if escape and k % 2:
            out.put((1 << (4 + form)) - 1, 4 + form)
            out.put(20, 5)
            for x in own:
                out.put(x & (1 << 20) - 1, 20)
            continue
        rice = 3 + 14 * form
        out.put(rice, 4 + form)
        for x in own:
            u = 2 * x if x >= 0 else -2 * x - 1
            out.put(1, (u >> rice) + 1)
            out.put(u & (1 << rice) - 1, rice)


def subframe(out, x, depth, kind, rnd):
    """kind: constant, verbatim, ("fixed", order) or ("lpc", order); samples with common low zeros waste them."""
    size, wasted = len(x), 0
    while kind != "constant" and any(x) and all(v % 2 == 0 for v in x):
        x, wasted = [v // 2 for v in x], wasted + 1
    depth -= wasted
    order = kind[1] if isinstance(kind, tuple) else 0
    code = {"constant": 0, "verbatim": 1}.get(kind) if isinstance(kind, str) else 8 + order if kind[0] == "fixed" else 31 + order
    out.put(code << 1 | bool(wasted), 8)
    if wasted:
        out.put(1, wasted)
    write = lambda v: out.put(v & (1 << depth) - 1, depth)
    if kind == "constant":
        return write(x[0])
    if kind == "verbatim":
        return [write(v) for v in x]
    for v in x[:order]:
        write(v)
    weights, shift = FIXED[order] if kind[0] == "fixed" else [rnd.randint(-300, 300) for _ in range(order)], 0
    if kind[0] == "lpc":
        shift = 9
        out.put(11, 4)
        out.put(shift, 5)
        for w in weights:
            out.put(w & (1 << 12) - 1, 12)
    r = [x[i] - (sum(w * x[i - 1 - j] for j, w in enumerate(weights)) >> shift) for i in range(order, size)]
    parts = rnd.choice([0, 1, 2]) if size % 4 == 0 and size // 4 >= order else 0
    residual(out, r, size, order, parts, rnd.choice([0, 1]), rnd.random() < 0.5 and max(map(abs, r), default=0) < 1 << 18)


def stream(samples, depth, sizes, rnd, layout=None):
    channels, total = samples.shape
    out, done = [], 0
    for number, size in enumerate(sizes):
        x = [c[done : done + size].tolist() for c in samples]
        own, wide = (channels - 1 if layout is None else layout), [depth] * channels
        if layout == 8:
            x, wide = [x[0], [a - b for a, b in zip(*x, strict=True)]], [depth, depth + 1]
        elif layout == 9:
            x, wide = [[a - b for a, b in zip(*x, strict=True)], x[1]], [depth + 1, depth]
        elif layout == 10:
            x, wide = [[(a + b) >> 1 for a, b in zip(*x, strict=True)], [a - b for a, b in zip(*x, strict=True)]], [depth, depth + 1]
        head = Out()
        head.put(0x3FFE << 2, 16)
        head.put(7, 4)
        head.put(0, 4)
        head.put(own, 4)
        head.put(0, 4)
        head.put(number, 8)
        head.put(size - 1, 16)
        raw = head.data()
        raw += bytes([_crc(raw, 7, 8)])
        body = Out()
        for c, d in zip(x, wide, strict=True):
            same = len(set(c)) == 1
            subframe(body, c, d, "constant" if same else rnd.choice(["verbatim", *(("fixed", k) for k in range(5)), ("lpc", 1), ("lpc", 8), ("lpc", 32)]), rnd)
        raw += body.data()
        out.append(raw + _crc(raw, 0x8005, 16).to_bytes(2, "big"))
        done += size
    word = 44100 << 44 | (channels - 1) << 41 | (depth - 1) << 36 | total
    info = (16).to_bytes(2, "big") + (4096).to_bytes(2, "big") + bytes(6) + word.to_bytes(8, "big") + hashlib.md5(pcm_bytes(samples, depth)).digest()
    return b"fLaC" + bytes([0x80, 0, 0, 34]) + info + b"".join(out)


@pytest.mark.parametrize("depth, channels, layout", [(8, 1, None), (16, 1, None), (16, 2, None), (16, 2, 8), (16, 2, 9), (16, 2, 10), (24, 2, 10), (12, 3, None), (20, 8, None)])
def test_round_trip(depth, channels, layout):
    rnd = random.Random(depth * 100 + channels * 10 + (layout or 0))
    sizes = [192, 100, 64, 37, 32]
    top = 1 << (min(depth, 18) - 4)
    wave = np.array([[int(top * np.sin((k + c) / (7 + c)) + rnd.randint(-9, 9)) for k in range(sum(sizes))] for c in range(channels)])
    wave[:, 192:292] *= 4  # wasted bits
    wave[:, 356:393] = 5  # constant
    raw = stream(wave, depth, sizes, rnd, layout)
    got = flac_reader.read(raw)
    assert (got.samples == wave).all() and (got.bits, got.rate) == (depth, 44100)
    assert [s for s, _ in got.frames] == [0, 192, 292, 356, 393] and all(raw[at : at + 2] == b"\xff\xf8" for _, at in got.frames)
    for _ in range(4):
        bad = bytearray(raw)
        bad[rnd.randrange(42, len(bad))] ^= 1 << rnd.randrange(8)
        with pytest.raises(BadStream):
            flac_reader.read(bytes(bad))


def test_reads_the_operators_own_streams(hard_texts=(b"", b"x" * 500, bytes(range(256)) * 9)):
    payloads = [flac_media.padded(t) for t in hard_texts]
    for raw, payload in zip(flac_media.encode_payloads(payloads), payloads, strict=True):
        got = flac_reader.read(raw)
        assert (got.samples[0] + 128).astype(np.uint8).tobytes() == payload and len(got.frames) == len(payload) // flac_media.BLOCK


def test_blocks_of_other_encoders(spark):
    rnd = random.Random(9)
    wave = np.array([[rnd.randint(-2000, 2000) for _ in range(300)] for _ in range(2)])
    raw = stream(wave, 16, [192, 108], rnd, 10)
    media = spark.createDataFrame([(1, raw), (2, None), (None, raw)], "doc_id long, media binary")
    got = flac_media.decode_any(media).collect()
    assert len(got) == 4 and [r.sample_offset for r in got if r.doc_id == 1] == [0, 192]
    assert b"".join(bytes(r.pcm) for r in got if r.doc_id == 1) == pcm_bytes(wave, 16)
    assert all(raw[r.byte_offset : r.byte_offset + 2] == b"\xff\xf8" for r in got)
    own = flac_media.encode(spark.createDataFrame([(5, "x" * 400)], "doc_id long, text string"))
    assert [(r.block, r.sample_offset, r.byte_offset) for r in flac_media.decode(own).collect()] == [(r.block, r.sample_offset, r.byte_offset) for r in flac_media.decode_any(own).collect()]
