"""Benchmark decontamination by pigeonhole edit matching.

A test item of n bytes may be found with e = n // 10 edits (none for items under 50 bytes).  It is cut into e + 1
pieces; a match leaves one of them whole.  Pieces are found by a table of 8 bytes of each, those that are rarest among
the items, looked up at every byte of a text at once.  Hits are verified in two steps, both with Myers' bit-parallel distance: first a group of up
to four neighbouring pieces that must hold with fewer edits than it has pieces (one group always does), for all hits
side by side in 64-bit words, then the whole item.

Both sides are lower-cased and their white space is collapsed.  The test items are a query set against all documents,
read in blocks of BLOCK_BYTES, which is what the driver and a task hold; of several blocks each is a pass of its own
whose hits are written.  Hits of a piece that many items share are expanded EXPANDED at a time.  Null or empty texts
and items never match.  A null doc_id is kept, and every row is judged by its own text.  Repeated rows yield repeated
hits, repeated items a hit each.  Extra columns are ignored, or kept by `clean`.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written

ERROR_RATE, SHORT, KEY, GROUP, BLOCK_BYTES, CHUNK, EXPANDED = 0.1, 50, 8, 4, 4 << 20, 3 << 20, 200_000
HASH_BITS = 20
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
SCHEMA = "doc_id long, item_id long, edits int, stop long"


def normal(text: str | None) -> bytes:
    return " ".join((text or "").lower().split()).encode()


def budget(n: int, rate: float = ERROR_RATE) -> int:
    """Edits allowed in an item of n bytes; pieces keep KEY bytes at least."""
    return 0 if n < SHORT else min(int(n * rate), n // KEY - 1)


def distance(pattern: bytes, text: bytes, most: int) -> tuple[int, int] | None:
    """(edits, stop) of the best place of pattern in text with `most` edits or fewer (Myers, on long integers)."""
    m = len(pattern)
    full, top = (1 << m) - 1, 1 << (m - 1)
    eq: dict[int, int] = {}
    for i, c in enumerate(pattern):
        eq[c] = eq.get(c, 0) | 1 << i
    pv, mv, score, best = full, 0, m, None
    for at, c in enumerate(text):
        e = eq.get(c, 0)
        xv = e | mv
        xh = (((e & pv) + pv) ^ pv) | e
        ph, mh = (mv | ~(xh | pv)) & full, pv & xh
        score += bool(ph & top) - bool(mh & top)
        ph, mh = ph << 1 & full, mh << 1 & full
        pv, mv = (mh | ~(xv | ph)) & full, ph & xv
        if score <= most and (best is None or score < best[0]):
            best = (score, at + 1)
    return best


class Items:
    """The tables of a block of test items."""

    def __init__(self, items: list[tuple[int, bytes]], rate: float):
        self.items = items
        self.tiny = [k for k, (_, t) in enumerate(items) if len(t) < KEY]
        self.most = [budget(len(t), rate) for _, t in items]
        keys, groups, often = [], [], self._frequencies(items)
        for k, (_, t) in enumerate(items):
            if len(t) < KEY:
                continue
            e = self.most[k]
            cuts = [i * len(t) // (e + 1) for i in range(e + 2)]
            each = min(GROUP, max(1, 64 // max(b - a for a, b in zip(cuts, cuts[1:], strict=False))))
            for g in range(0, e + 1, each):
                last = min(g + each, e + 1)
                pattern = t[cuts[g] : cuts[last]][:64]
                for i in range(g, last):
                    at = cuts[i] + int(np.argmin(often[k][cuts[i] : cuts[i + 1] - KEY + 1]))
                    keys.append((int.from_bytes(t[at : at + KEY], "little"), len(groups), at - cuts[g]))
                groups.append((k, cuts[g], len(pattern), last - g - 1, pattern))
        keys.sort()
        self.key = np.array([x[0] for x in keys], np.uint64)
        self.group_of = np.array([x[1] for x in keys], np.int64)
        self.inner = np.array([x[2] for x in keys], np.int64)
        self.distinct, self.first = np.unique(self.key, return_index=True)
        self.count = np.diff(np.append(self.first, len(self.key)))
        self.item = np.array([g[0] for g in groups], np.int64)
        self.offset = np.array([g[1] for g in groups], np.int64)
        self.size = np.array([g[2] for g in groups], np.int64)
        self.spare = np.array([g[3] for g in groups], np.int64)
        self.eq = np.zeros((len(groups), 256), np.uint64)
        for n, g in enumerate(groups):
            for i, c in enumerate(g[4]):
                self.eq[n, c] |= np.uint64(1 << i)
        self.maybe = np.zeros(1 << HASH_BITS, bool)
        self.maybe[self._hash(self.distinct)] = True

    @staticmethod
    def _frequencies(items: list[tuple[int, bytes]]) -> list[np.ndarray]:
        """How often the KEY bytes at each place of each item occur among all items."""
        words = [np.ndarray((max(0, len(t) - KEY + 1),), "<u8", t, strides=(1,)) if len(t) >= KEY else np.zeros(0, "<u8") for _, t in items]
        _, back, n = np.unique(np.concatenate([*words, np.zeros(0, "<u8")]), return_inverse=True, return_counts=True)
        return np.split(n[back], np.cumsum([len(w) for w in words])[:-1])

    @staticmethod
    def _hash(words: np.ndarray) -> np.ndarray:
        return (words * MULTIPLIER) >> np.uint64(64 - HASH_BITS)

    def hits(self, flat: bytes) -> tuple[np.ndarray, np.ndarray]:
        """(group, place of the group's start) where a group may hold with its edits."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        if len(flat) < KEY or not len(self.key):
            return none
        words = np.ndarray((len(flat) - KEY + 1,), "<u8", flat, strides=(1,)).copy()
        at = np.flatnonzero(self.maybe[self._hash(words)])
        spot = np.minimum(np.searchsorted(self.distinct, words[at]), len(self.distinct) - 1)
        own = self.distinct[spot] == words[at]
        at, spot = at[own], spot[own]
        raw, out, lo = np.frombuffer(flat, np.uint8), [none], 0
        upto = np.cumsum(self.count[spot])
        while lo < len(spot):
            hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + EXPANDED, side="right")))
            n = self.count[spot[lo:hi]]
            for part in range(0, int(n.sum()), EXPANDED):  # one place of a piece that more items share
                own = np.arange(part, min(part + EXPANDED, int(n.sum())))
                place = np.searchsorted(np.cumsum(n), own, side="right")
                which = self.first[spot[lo:hi]][place] + own - (np.cumsum(n) - n)[place]
                both = np.stack([self.group_of[which], at[lo:hi][place] - self.inner[which]])
                both = np.unique(both, axis=1)
                keep = np.concatenate([self._near(raw, both[0, x : x + 20_000], both[1, x : x + 20_000]) for x in range(0, both.shape[1], 20_000)])
                out.append((both[0, keep], both[1, keep]))
            lo = hi
        found = np.unique(np.stack([np.concatenate(x) for x in zip(*out, strict=True)]), axis=1)
        return found[0], found[1]

    def _near(self, raw, group, start):
        size, spare = self.size[group], self.spare[group]
        pv, mv = np.full(len(group), ~np.uint64(0)), np.zeros(len(group), np.uint64)
        score, found, top = size.copy(), np.zeros(len(group), bool), (size - 1).astype(np.uint64)
        one, begin, row = np.uint64(1), start - spare, group * 256
        eq = self.eq.reshape(-1)
        for j in range(int((size + 2 * spare).max())):
            p = begin + j
            e = eq[row + np.where((p >= 0) & (p < len(raw)), raw[np.clip(p, 0, len(raw) - 1)], 0)]
            xv = e | mv
            xh = (((e & pv) + pv) ^ pv) | e
            ph, mh = mv | ~(xh | pv), pv & xh
            score += (ph >> top & one).astype(np.int64) - (mh >> top & one).astype(np.int64)
            ph, mh = ph << one, mh << one
            pv, mv = mh | ~(xv | ph), ph & xv
            found |= (score <= spare) & (j < size + 2 * spare)
        return found

    def search(self, texts: list[bytes]) -> list[tuple[int, int, int, int]]:
        """(text, item, edits, stop) of every item found in every text."""
        flat, base = b"\n".join(texts), np.cumsum([0, *(len(t) + 1 for t in texts)])
        group, start = self.hits(flat)
        doc = np.clip(np.searchsorted(base, np.maximum(start + self.size[group] // 2, 0), side="right") - 1, 0, len(texts) - 1)
        item = self.item[group]
        best: dict[tuple[int, int], tuple[int, int]] = {}
        tried = set()
        for d, k, s in zip(doc.tolist(), item.tolist(), (start - self.offset[group] - base[doc]).tolist(), strict=True):
            most, pattern, text = self.most[k], self.items[k][1], texts[d]
            lo = max(0, s - 2 * most - 1)
            if (d, k, lo) in tried:
                continue
            tried.add((d, k, lo))
            if (d, k) not in best or best[d, k][0]:
                exact = text[max(0, s) : max(0, s) + len(pattern)] == pattern
                got = (0, max(0, s) + len(pattern)) if exact else (found := distance(pattern, text[lo : s + len(pattern) + 2 * most + 1], most)) and (found[0], found[1] + lo)
                if got and ((d, k) not in best or got < best[d, k]):
                    best[d, k] = got
        for k in self.tiny:
            for d, t in enumerate(texts):
                if self.items[k][1] and b" " + self.items[k][1] + b" " in b" " + t + b" ":
                    best[d, k] = (0, (b" " + t + b" ").index(b" " + self.items[k][1] + b" ") + len(self.items[k][1]))
        return [(d, k, *x) for (d, k), x in sorted(best.items())]


def _blocks(benchmark: DataFrame):
    """The test items in lists of about BLOCK_BYTES, one list in the driver at a time."""
    part, size = [], 0
    for r in benchmark.select(F.col("item_id").cast("long"), "text").where("text is not null").toLocalIterator():
        t = normal(r.text)
        if t:
            part.append((r.item_id, t))
            size += len(t)
        if size >= BLOCK_BYTES:
            yield part
            part, size = [], 0
    yield part


def matches(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """One row per document and test item found in it: doc_id, item_id, edits, stop (byte in the normalised text)."""
    docs = documents.select(F.col("doc_id").cast("long"), "text")

    def against(items: list[tuple[int, bytes]]) -> DataFrame:
        def each(batches):
            block = Items(items, rate)
            for b in batches:
                for rows, got in _searched(block, b.column(1)):
                    if got:
                        cols = ([b.column(0)[rows[g[0]]].as_py() for g in got], [items[g[1]][0] for g in got], [g[2] for g in got], [g[3] for g in got])
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int64()), strict=True)], ["doc_id", "item_id", "edits", "stop"])

        return docs.mapInArrow(each, SCHEMA)

    blocks = _blocks(benchmark)
    found = against(next(blocks))
    for items in blocks:
        found = written(found, "leaks").union(written(against(items), "leaks"))
    return found


def _searched(block: Items, texts: pa.Array):
    """(rows, what `search` finds in them) in parts of about CHUNK bytes of normalised text."""
    part, rows, size = [], [], 0
    for i in range(len(texts)):
        part.append(normal(texts[i].as_py()))
        rows.append(i)
        size += len(part[-1])
        if size >= CHUNK or i + 1 == len(texts):
            yield rows, block.search(part)
            part, rows, size = [], [], 0


def clean(documents: DataFrame, benchmark: DataFrame, rate: float = ERROR_RATE) -> DataFrame:
    """The documents in which no test item is found, with all their columns; every row stays or goes by its own text.

    A filter of the scan: nothing is shuffled or joined.
    """
    at = documents.columns.index(next(c for c in documents.columns if c.lower() == "text"))

    def without(docs: DataFrame, items: list[tuple[int, bytes]]) -> DataFrame:
        def each(batches):
            block = Items(items, rate)
            for b in batches:
                hit = np.zeros(b.num_rows, bool)
                for rows, got in _searched(block, b.column(at)):
                    hit[[rows[g[0]] for g in got]] = True
                yield b.filter(pa.array(~hit))

        return docs.mapInArrow(each, documents.schema)

    blocks = _blocks(benchmark)
    kept = without(documents, next(blocks))
    for items in blocks:
        kept = without(written(kept, "clean"), items)
    return kept
