"""Exact removal of long repeats with a logarithmic family of suffix arrays.

A byte goes if it lies in a 50-byte string that also starts in a document with a smaller doc_id.

1. *Anchors.*  Every 50-byte window has one anchor, the leftmost least-hashed 24-byte piece in it.  Equal windows
   have equal anchors at equal places, so windows can be dealt to shards by their anchor and no match is lost.
   Neighbouring windows with one anchor travel together as a run of bytes.  A task keeps, of runs that are equal byte
   for byte, those of the smallest document and marks the others at once: a passage in a third of all documents leaves
   each task once.  Shards first count the anchors' prints (a few bytes each) and answer; only runs whose anchor occurs
   elsewhere travel.  The runs of an anchor that stands in over HOT runs are cut to SPLIT windows and dealt by the
   bytes that these windows share, 47 of 50, so that a short line in all documents doesn't fill a shard.
2. *Index family.*  In a shard equal runs are told first.  The windows of distinct runs that share an anchor with
   another distinct run then go to a logarithmic family of suffix arrays, in doc_id order in batches.  Each batch gets
   a suffix array: its suffixes in the order of their first 50 bytes, with the number of bytes that neighbours have in
   common.  It is merge-scanned against the arrays of older documents, the suffixes that they don't hold form a new
   level, and levels of like size merge, so there are O(log n) of them.
3. *Marks* return to their documents as packed spans, in buckets of bounded size.

Null text: empty.  Null doc_id: after all others, and no cause of removal.  Rows of one doc_id never affect each
other, repeated rows included.  Texts under 50 bytes are kept whole.  Extra columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import binary_buffers, text_bytes

WINDOW, PIECE = 50, 24
#: Bytes of text hashed at once, of runs in a shard, of text in a bucket; windows in a batch; text whose anchors one shard counts.
BUFFER, SHARD_BYTES, BUCKET_BYTES, BATCH, ASKED_BYTES = 2 << 20, 32 << 20, 12 << 20, 1 << 20, 48 << 20
#: Runs of an anchor from which on they are cut; windows of a cut run.
HOT, SPLIT = 4000, 4
#: Where the eight-byte words begin that hold a window's bytes, in the order in which they decide.
WORDS = (0, 8, 16, 24, 32, 40, 42)
LAST = np.iinfo(np.int64).max
MULTIPLIER, MIXER = 0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F
MARKS = np.dtype([("doc", "<i8"), ("row", "<i8"), ("start", "<i8"), ("stop", "<i8")])


def _prints(raw: np.ndarray, length: int, mult: int) -> np.ndarray:
    """Polynomial fingerprint (mod 2**64) of the `length` bytes at each position, by doubling."""
    n = len(raw) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = (raw.astype(np.uint64) + np.uint64(1)) * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(29)
    out, done, width, power = None, 0, 1, mult
    while True:
        if length & width:
            out = h[:n].copy() if out is None else out * np.uint64(power) + h[done : done + n]
            done += width
        if width * 2 > length:
            return out
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power & (1 << 64) - 1, width * 2


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _least(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum over each `width` neighbours."""
    n, w = len(x) - width + 1, 1
    while w * 2 <= width:
        x = np.minimum(x[:-w], x[w:])
        w *= 2
    return np.minimum(x[:n], x[width - w : width - w + n])


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(a.tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype=dtype)


def _segments(offsets: np.ndarray):
    """(row, first byte, stop byte) pieces of at most BUFFER bytes, in lists of about BUFFER bytes; long texts are cut with an overlap."""
    part, size = [], 0
    for row in range(len(offsets) - 1):
        at, stop = int(offsets[row]), int(offsets[row + 1])
        while stop - at >= WINDOW:
            end = min(stop, at + BUFFER)
            part.append((row, at, end))
            size += end - at
            if size >= BUFFER:
                yield part
                part, size = [], 0
            if end == stop:
                break
            at = end - WINDOW + 1
    if part:
        yield part


def _big_endian(raw: np.ndarray) -> np.ndarray:
    """The eight-byte words at all places of a buffer, without a copy of each."""
    raw = np.ascontiguousarray(raw)
    return np.ndarray((max(0, len(raw) - 7),), ">u8", raw, strides=(1,)) if len(raw) > 7 else np.zeros(0, ">u8")


def _words(text: np.ndarray, at: np.ndarray):
    """The words of the windows at some places, in deciding order."""
    for k in WORDS:
        yield text[at + k].astype(np.uint64)


def _equal(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at a and b hold the same bytes."""
    out = np.ones(len(a), bool)
    for x, y in zip(_words(text, a), _words(text, b), strict=True):
        out &= x == y
    return out


def _runs(raw: np.ndarray, part: list, mult: int):
    """Runs of windows with one anchor: buffer, start in it, number of windows, anchor's place and fingerprint, a fingerprint of the run."""
    sizes = np.array([e - s for _, s, e in part])
    buf = np.concatenate([raw[s:e] for _, s, e in part])
    base = np.concatenate([[0], np.cumsum(sizes)])
    n = len(buf) - WINDOW + 1
    pieces = _prints(buf, PIECE, mult)
    anchor = _least((_mix(pieces) & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(pieces), dtype=np.uint64), WINDOW - PIECE + 1)
    anchor = (anchor & np.uint64(0xFFFFFFFF)).astype(np.int64)
    ok = np.ones(n + 1, bool)
    for b in base[1:]:
        ok[max(0, b - WINDOW + 1) : b] = False  # these would cross into the next text
    ok = ok[:n]
    edge = np.empty(n, bool)
    edge[0] = ok[0]
    edge[1:] = ok[1:] & (~ok[:-1] | (anchor[1:] != anchor[:-1]))
    start = np.flatnonzero(edge)
    last = np.append(start[1:], n)
    bad = np.flatnonzero(~ok)
    stop = np.minimum(last, np.append(bad, n)[np.searchsorted(bad, start)])
    seg = np.searchsorted(base, start, side="right") - 1
    whole = _prints(buf, WINDOW, mult)
    return buf, start, stop - start, anchor[start], pieces[anchor[start]], _mix(whole[start] ^ _mix(whole[stop - 1])), seg, base


def _classes(text: np.ndarray, at: np.ndarray, n: np.ndarray, prints: np.ndarray, order: np.ndarray) -> np.ndarray:
    """For each run the first, in `order`, of those with the same bytes (their first and last windows hold them all).

    Prints only bring candidates together: a run that differs from the first of its print stands for itself.
    """
    by = order[np.lexsort((n[order], prints[order]))]
    new = np.ones(len(by), bool)
    new[1:] = (prints[by[1:]] != prints[by[:-1]]) | (n[by[1:]] != n[by[:-1]])
    first = np.empty(len(by), np.int64)
    first[by] = by[np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))]
    other = np.flatnonzero(first != np.arange(len(first)))
    head = first[other]
    same = _equal(text, at[other], at[head]) & _equal(text, at[other] + n[other] - 1, at[head] + n[head] - 1)
    first[other[~same]] = other[~same]
    return first


def _parts(docs: pa.Table):
    """The runs of a bucket's texts, in parts of about BUFFER bytes and in an order that is the same each time."""
    docs = docs.sort_by([("doc_id", "ascending"), ("row", "ascending")]).combine_chunks()
    ids = docs.column("doc_id").fill_null(LAST).to_numpy()
    rows = docs.column("row").to_numpy()
    offsets, raw = binary_buffers(docs.column("text").chunk(0)) if docs.num_rows else (np.zeros(1, np.int64), np.zeros(0, np.uint8))
    for number, part in enumerate(_segments(offsets)):
        buf, start, n, anchor, piece, prints, seg, base = _runs(raw, part, MULTIPLIER)
        row = np.array([r for r, _, _ in part])[seg]
        first = np.array([s for _, s, _ in part])[seg] - base[seg] - offsets[row] + start
        doc = ids[row]
        # of equal runs, those of the smallest document stand for all
        heads = _classes(_big_endian(buf), start, n, prints, np.argsort(doc, kind="stable"))
        yield number, buf, start, n, anchor, _mix(piece * np.uint64(MIXER)), doc, rows[row], first, doc == doc[heads]


def _offered(mixed: np.ndarray, stand: np.ndarray, shards: int):
    """(shard, runs in the order of their 40-bit anchor prints, these prints) of the runs that stand."""
    own = np.flatnonzero(stand)
    shard = (mixed[own] >> np.uint64(40)).astype(np.int64) % shards
    low = mixed[own] & np.uint64((1 << 40) - 1)
    order = np.lexsort((own, low, shard))
    for g in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
        if len(g):
            yield int(shard[g[0]]), own[g], low[g]


def _offer(shards: int):
    """Sends the prints of a bucket's anchors to the shards that count them: sorted differences, byte by byte."""

    def offer(docs: pa.Table) -> pa.Table:
        out = []
        for number, _, _, _, _, mixed, _, _, _, stand in _parts(docs):
            for shard, _, low in _offered(mixed, stand, shards):
                step = np.diff(low, prepend=np.uint64(0))
                out.append((shard, docs.column("bucket")[0].as_py(), number, _pack(np.ascontiguousarray(step.view("u1").reshape(-1, 8).T[:5]))))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "bucket", "part", "prints"), cols, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)})

    return offer


def _twins(table: pa.Table) -> pa.Table:
    """How often the offered anchors occur, back to the bucket that asked: 0 once, 1 more often, 2 in over HOT runs."""
    lows = []
    for x in table.column("prints"):
        planes = _unpack(x.as_py(), "u1").reshape(5, -1)
        step = np.zeros((planes.shape[1], 8), np.uint8)
        step[:, :5] = planes.T
        lows.append(np.cumsum(step.reshape(-1).view("<u8")))
    low = np.concatenate(lows)
    order = np.argsort(low, kind="stable")
    head = np.flatnonzero(np.append(True, low[order][1:] != low[order][:-1]))
    size = np.diff(np.append(head, len(low)))
    often = np.empty(len(low), np.uint8)
    often[order] = np.repeat((size > 1).astype(np.uint8) + (size > HOT), size)
    codes = [_pack(c) for c in np.split(often, np.cumsum([len(x) for x in lows])[:-1])]
    return pa.table({"bucket": table.column("bucket"), "part": table.column("part"), "shard": table.column("shard"), "codes": pa.array(codes, pa.binary())})


def _cut(own: np.ndarray, start: np.ndarray, n: np.ndarray, anchor: np.ndarray):
    """(run, start, windows, place of the bytes that its windows share) of runs cut at every SPLIT-th place before their anchor."""
    run = np.repeat(own, n[own])
    inner = np.arange(len(run)) - np.repeat(np.cumsum(n[own]) - n[own], n[own])
    at = start[run] + inner
    group = (anchor[run] - at) // SPLIT
    edge = np.ones(len(run), bool)
    edge[1:] = (run[1:] != run[:-1]) | (group[1:] != group[:-1])
    head = np.flatnonzero(edge)
    return run[head], at[head], np.diff(np.append(head, len(run))), anchor[run[head]] - SPLIT * group[head]


def _send(asked: int, shards: int):
    """Sends the runs whose anchor occurs elsewhere to the shards that hold the index family; marks what is known already."""

    def send(docs: pa.Table, answers: pa.Table) -> pa.Table:
        answer = {(p, s): c for p, s, c in zip(*(answers.column(k).to_pylist() for k in ("part", "shard", "codes")), strict=True)}
        out = []
        for number, buf, start, n, anchor, mixed, doc, row, first, stand in _parts(docs):
            known = np.flatnonzero(~stand)
            if len(known):
                marks = np.empty(len(known), MARKS)
                marks["doc"], marks["row"], marks["start"] = doc[known], row[known], first[known]
                marks["stop"] = first[known] + n[known] + WINDOW - 1
                out.append((int(mixed[known[0]] % np.uint64(shards)), 1, b"", b"", b"", b"", _pack(marks)))
            often = np.zeros(len(start), np.uint8)
            for s, own, _ in _offered(mixed, stand, asked):
                often[own] = _unpack(answer[number, s], "u1")
            whole, hot = np.flatnonzero(often == 1), np.flatnonzero(often == 2)
            run, at, size, shared = _cut(hot, start, n, anchor)
            key = _mix(mixed)
            if len(run):
                key_of = _mix(_prints(buf, WINDOW - SPLIT + 1, MULTIPLIER)[shared])
                run, at, size, key = np.append(whole, run), np.append(start[whole], at), np.append(n[whole], size), np.append(key[whole], key_of)
            else:
                run, at, size, key = whole, start[whole], n[whole], key[whole]
            shard = (key % np.uint64(shards)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
                if len(own):
                    r, length = run[own], size[own] + WINDOW - 1
                    (used, of), begin = np.unique(np.stack([doc[r], row[r]]), axis=1, return_inverse=True), first[r] + at[own] - start[r]
                    spot = np.repeat(at[own] - (np.cumsum(length) - length), length) + np.arange(length.sum())
                    out.append((int(shard[own[0]]), 0, _pack(np.ascontiguousarray(used)), _pack(of.astype(np.uint32)), _pack(begin.astype(np.int64)), _pack(size[own].astype(np.uint8)), _pack(buf[spot])))
        cols = list(zip(*out, strict=True)) or [()] * 7
        return pa.table({n: pa.array(c, t) for n, c, t in zip(("shard", "kind", "docs", "at", "first", "n", "data"), cols, (pa.int64(), pa.int32(), *[pa.binary()] * 5), strict=True)})

    return send


SHARD_SCHEMA = "shard long, kind int, docs binary, at binary, first binary, n binary, data binary"


class SuffixArray:
    """Distinct suffixes of a buffer in the order of their first 50 bytes, with the smallest document that holds each."""

    def __init__(self, text: np.ndarray, pos: np.ndarray, doc: np.ndarray):
        self.text, self.pos, self.doc = text, pos, doc
        self.first = next(_words(text, pos))  # the first eight bytes, at hand for searches

    def __len__(self):
        return len(self.pos)

    def common(self) -> np.ndarray:
        """How many of the first 50 bytes each suffix has in common with the one before it."""
        out, live = np.zeros(len(self), np.int64), np.ones(max(0, len(self) - 1), bool)
        for k, word in zip(WORDS, _words(self.text, self.pos), strict=True):
            differ = word[1:] ^ word[:-1]
            here = live & (differ != 0)
            out[1:][here] = k + sum((differ[here] >> np.uint64(8 * b) == 0).astype(int) for b in range(8))
            live &= differ == 0
        out[1:][live] = WINDOW
        return out

    def place(self, other: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """Where the suffixes of another array belong in this one, and whether this one holds them: a merge scan.

        The first words' places bound a range each; words decide in turn within what is left of it.
        """
        lo = np.searchsorted(self.first, other.first, side="left")
        hi = np.searchsorted(self.first, other.first, side="right")
        for k in WORDS[1:]:
            live = np.flatnonzero(hi > lo)
            if not len(live):
                break
            asked = other.text[other.pos[live] + k].astype(np.uint64)
            ends = []
            for upper in (False, True):
                a, b = lo[live].copy(), hi[live].copy()
                while True:
                    todo = np.flatnonzero(a < b)
                    if not len(todo):
                        break
                    mid = (a[todo] + b[todo]) // 2
                    word = self.text[self.pos[mid] + k].astype(np.uint64)
                    right = word <= asked[todo] if upper else word < asked[todo]
                    a[todo[right]], b[todo[~right]] = mid[right] + 1, mid[~right]
                ends.append(a)
            lo[live], hi[live] = ends
        return lo, hi > lo


def suffix_array(text: np.ndarray, pos: np.ndarray, doc: np.ndarray) -> tuple[SuffixArray, np.ndarray]:
    """The suffix array of some places, and which of its suffixes each place has."""
    table = pa.table({**{f"w{k}": w for k, w in enumerate(_words(text, pos))}, "doc": doc})
    order = pc.sort_indices(table, sort_keys=[(c, "ascending") for c in table.column_names]).to_numpy().astype(np.int64)
    new = np.zeros(len(order), bool)
    new[:1] = True
    for name in table.column_names[:-1]:
        word = table.column(name).to_numpy()[order]
        new[1:] |= word[1:] != word[:-1]
    which = np.empty(len(order), np.int64)
    which[order] = np.cumsum(new) - 1
    head = order[new]
    return SuffixArray(text, pos[head], doc[head]), which


class SuffixFamily:
    """Levels of suffix arrays over one buffer, each at least twice the size of the next; a suffix is in one of them."""

    def __init__(self, raw: np.ndarray):
        self.text, self.levels = _big_endian(raw), []

    def add(self, pos: np.ndarray, doc: np.ndarray) -> np.ndarray:
        """Adds a batch whose documents are not before those added; true for each place whose 50 bytes an older document holds."""
        batch, which = suffix_array(self.text, pos, doc)
        least, fresh = batch.doc.copy(), np.ones(len(batch), bool)
        for level in self.levels:
            at, held = level.place(batch)
            least[held] = level.doc[at[held]]
            fresh &= ~held
        if fresh.any():
            self.levels.append(SuffixArray(self.text, batch.pos[fresh], batch.doc[fresh]))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            old, new = self.levels[-2:]
            at, _ = old.place(new)
            self.levels[-2:] = [SuffixArray(self.text, np.insert(old.pos, at, new.pos), np.insert(old.doc, at, new.doc))]
        return doc > least[which]


def _anchors(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Prints of the anchors of the windows at some places."""
    out = []
    for lo in range(0, len(at), 1 << 15):
        own = raw[at[lo : lo + (1 << 15), None] + np.arange(WINDOW)]
        pieces = _prints(own.reshape(-1), PIECE, MULTIPLIER)
        pieces = pieces[(np.arange(len(own)) * WINDOW)[:, None] + np.arange(WINDOW - PIECE + 1)]
        out.append(pieces[np.arange(len(own)), (_mix(pieces) >> np.uint64(32)).argmin(axis=1)])
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def _resolve(docs, rows, first, n, raw, at) -> np.ndarray:
    """Marks of one shard: runs in doc order, `at` their place in raw."""
    text = _big_endian(raw)
    prints = np.zeros(len(n), np.uint64)
    for word, last in zip(_words(text, at), _words(text, at + n - 1), strict=True):
        prints = _mix((prints ^ word) * np.uint64(MULTIPLIER) + _mix(last))
    heads = _classes(text, at, n, prints, np.arange(len(n)))
    late = np.flatnonzero(docs > docs[heads])  # the whole run stands in an older document
    whole = np.empty(len(late), MARKS)
    whole["doc"], whole["row"], whole["start"] = docs[late], rows[late], first[late]
    whole["stop"] = first[late] + n[late] + WINDOW - 1
    out = [whole]
    # distinct runs that share their anchor with another one
    own = np.flatnonzero(heads == np.arange(len(n)))
    _, back, often = np.unique(_anchors(raw, at[own]), return_inverse=True, return_counts=True)
    own = own[often[back] > 1]
    # runs that stand for a distinct one: it, and its copies in the same document
    stand = np.flatnonzero(docs == docs[heads])
    stand = stand[np.argsort(heads[stand], kind="stable")]
    family, lo, ends = SuffixFamily(raw), 0, np.cumsum(n[own])
    while lo < len(own):
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + BATCH, side="right")))
        k = n[own[lo:hi]]
        run = np.repeat(own[lo:hi], k)
        inner = np.arange(len(run)) - np.repeat(np.cumsum(k) - k, k)
        found = family.add(at[run] + inner, docs[run])
        edge = np.ones(len(run), bool)
        edge[1:] = (run[1:] != run[:-1]) | (found[1:] != found[:-1])
        head = np.flatnonzero(edge)
        tail = np.append(head[1:], len(run)) - 1
        head, tail = head[found[head]], tail[found[head]]
        a, b = (np.searchsorted(heads[stand], run[head], side=side) for side in ("left", "right"))
        who = stand[np.repeat(a - (np.cumsum(b - a) - (b - a)), b - a) + np.arange((b - a).sum())]
        marks = np.empty(len(who), MARKS)
        marks["doc"], marks["row"] = docs[who], rows[who]
        marks["start"], marks["stop"] = first[who] + np.repeat(inner[head], b - a), first[who] + np.repeat(inner[tail], b - a) + WINDOW
        out.append(marks)
        lo = hi
    return np.concatenate(out)


def _family_of_shard(buckets: int):
    def of_shard(table: pa.Table) -> pa.Table:
        kinds = table.column("kind").to_pylist()
        marks, parts = [], []
        for i, kind in enumerate(kinds):
            get = lambda c, t: _unpack(table.column(c)[i].as_py(), t)  # noqa: B023, E731
            if kind == 1:
                marks.append(get("data", MARKS))
            else:
                ids = get("docs", "<i8").reshape(2, -1)[:, get("at", "<u4")]
                parts.append((ids[0], ids[1], get("first", "<i8"), get("n", "u1").astype(np.int64), get("data", "u1")))
        if parts:
            docs, rows, first, n, raw = (np.concatenate(x) for x in zip(*parts, strict=True))
            del parts
            size = n + WINDOW - 1
            at = np.cumsum(size) - size
            use = np.argsort(docs, kind="stable")
            marks.append(_resolve(docs[use], rows[use], first[use], n[use], raw, at[use]))
        out = np.concatenate(marks) if marks else np.empty(0, MARKS)
        bucket = _bucket(out["row"], buckets)
        order = np.argsort(bucket, kind="stable")
        groups = [g for g in np.split(order, np.flatnonzero(np.diff(bucket[order])) + 1) if len(g)]
        return pa.table({"bucket": pa.array([int(bucket[g[0]]) for g in groups], pa.int64()), "marks": pa.array([_pack(out[g]) for g in groups], pa.binary())})

    return of_shard


def _bucket(row: np.ndarray, buckets: int) -> np.ndarray:
    return (row >> np.int64(1)) % np.int64(buckets)


def removed(length: int, start: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs (starts, stops) that some spans cover."""
    order = np.argsort(start, kind="stable")
    s, e = start[order], np.maximum.accumulate(stop[order])
    new = np.ones(len(s), bool)
    new[1:] = s[1:] > e[:-1]
    head = np.flatnonzero(new)
    return s[head], e[np.append(head[1:], len(s)) - 1]


OUT_SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, stops array<long>"


def _apply(docs: pa.Table, marks: pa.Table) -> pa.Table:
    spans = [_unpack(x.as_py(), MARKS) for x in marks.column("marks")]
    spans = np.concatenate(spans) if spans else np.empty(0, MARKS)
    spans = spans[np.lexsort((spans["row"], spans["doc"]))]
    key = np.stack([spans["doc"], spans["row"]], axis=1)
    new = np.ones(len(spans), bool)
    new[1:] = (key[1:] != key[:-1]).any(axis=1)
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(spans))[: len(head)]
    where = {(int(key[h, 0]), int(key[h, 1])): (h, t) for h, t in zip(head, tail, strict=True)}
    out = []
    for i, r, text in zip(docs.column("doc_id").to_pylist(), docs.column("row").to_pylist(), docs.column("text"), strict=True):
        raw = text.as_py()
        h, t = where.get((LAST if i is None else i, r), (0, 0))
        s, e = removed(len(raw), spans["start"][h:t], spans["stop"][h:t]) if t > h else (np.zeros(0, np.int64),) * 2
        kept = b"".join(raw[a:b] for a, b in zip([0, *e.tolist()], [*s.tolist(), len(raw)], strict=True)) if len(s) else raw
        out.append((i, len(raw), len(raw) - len(kept), len(s), kept, s.tolist(), e.tolist()))
    types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
    names = ("doc_id", "n_bytes", "n_removed", "n_spans", "kept", "starts", "stops")
    return pa.table({n: pa.array([x[k] for x in out], t) for k, (n, t) in enumerate(zip(names, types, strict=True))})


def suffix_dedup(documents: DataFrame) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept (the bytes that stay), and the removed runs' starts and stops."""
    docs = documents.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = text_bytes(documents)
    buckets, asked, shards = max(8, total // BUCKET_BYTES), max(1, total // ASKED_BYTES), max(1, total * 9 // 2 // SHARD_BYTES)
    docs = docs.withColumn("row", F.xxhash64("doc_id", "text"))
    # as many tasks as buckets and shards, so that what a task reads is the same at every size
    dealt = docs.withColumn("bucket", F.pmod(F.shiftright("row", 1), F.lit(buckets))).repartition(buckets, "bucket").groupBy("bucket")
    prints = dealt.applyInArrow(_offer(asked), "shard long, bucket long, part long, prints binary")
    answers = prints.repartition(asked, "shard").groupBy("shard").applyInArrow(_twins, "bucket long, part long, shard long, codes binary")
    runs = dealt.cogroup(answers.groupBy("bucket")).applyInArrow(_send(asked, shards), SHARD_SCHEMA)
    marks = runs.repartition(shards, "shard").groupBy("shard").applyInArrow(_family_of_shard(buckets), "bucket long, marks binary")
    return dealt.cogroup(marks.groupBy("bucket")).applyInArrow(_apply, OUT_SCHEMA)


def kept_digest(result: DataFrame) -> DataFrame:
    """The digest columns of suffix_dedup's result."""
    return result.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def brute_force(rows: list[tuple[int, bytes]]) -> dict[int, tuple[int, int, str]]:
    """For tests: n_removed, n_spans and digest by plain search."""
    least: dict[bytes, int] = {}
    for i, raw in rows:
        for p in range(len(raw) - WINDOW + 1):
            w = raw[p : p + WINDOW]
            least[w] = min(least.get(w, i), i)
    out = {}
    for i, raw in rows:
        gone = bytearray(len(raw))
        for p in range(len(raw) - WINDOW + 1):
            if least[raw[p : p + WINDOW]] < i:
                gone[p : p + WINDOW] = b"\1" * WINDOW
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[i] = (sum(gone), bytes(gone).replace(b"\0", b" ").split().__len__(), hashlib.sha256(kept).hexdigest())
    return out
