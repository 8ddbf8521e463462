"""Language-model scoring with Brown class-based bigrams.

P(w | w') = P(class(w) | class(w')) * P(w | class(w)).  Words are grouped by exchange on the class-bigram likelihood:
the most frequent words begin with a class each and the rest with one in common.  In a round every word's profile, the
counts of its left and right neighbours' classes, is counted under the classes of the round, and so are the class
bigrams and their log likelihood.  Then words move to the class whose neighbours make theirs likeliest: all in the first
round, afterwards one half of the words after the other (by hash), since words that move at once don't see each other's
move.  Of the states of all rounds the one with the greatest likelihood counts, so the likelihood never falls; rounds end
when it grows by less than ENOUGH or ROUNDS are done.  Transitions are interpolated (Witten-Bell), emissions smoothed by
0.1.  A word that training didn't see is one further type, as in the base score, with the Good-Turing mass of the words
seen once.

Nothing that grows with the vocabulary is broadcast or collected.  Texts are cut in blocks; a block sends its
distinct words (64-bit hashes) and their training counts to shards of the vocabulary and is answered with numbers,
counts and classes.  Only matrices over classes, of fixed size, reach the driver.  Blocks are kept in a table bucketed
by block, so that a round moves classes and counts but no text.

Null and empty texts hold the end token alone.  A null doc_id counts as the empty string for the fold and stays null.
Repeated rows are scored alike and count each time.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bucketed, dropped, released, written

#: SHARD_WORDS: words that blocks ask one shard for.  ENOUGH: growth of the log likelihood, as a share, at which rounds end.
CLASSES, ROUNDS, ENOUGH, BLOCK_BYTES, SHARD_WORDS = 64, 4, 1e-4, 6 << 20, 400_000
#: Classes that are given: the end of a text, unseen words, words without a class of their own at the beginning.
END, UNSEEN, REST, FIRST = 0, 1, 2, 3
END_HASH = xxhash.xxh64_intdigest(b" ", 7)  # a blank is no word
SMOOTH = 0.1
DOCS = np.dtype([("id", "<i8"), ("null", "u1"), ("train", "u1"), ("n", "<i8")])


def _pack(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unpack(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pack_ints(a: np.ndarray) -> bytes:
    """Numbers under 2**32, byte by byte."""
    return _pack(np.asarray(a, "<u4").view("u1").reshape(-1, 4).T)


def _unpack_ints(b: bytes) -> np.ndarray:
    return np.ascontiguousarray(_unpack(b, "u1").reshape(4, -1).T).view("<u4").reshape(-1).astype(np.int64)


class _Numbers(dict):
    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def _batch(names_types: str, rows: list[tuple]) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "binary": pa.binary(), "array": pa.list_(pa.int64())}
    fields = [f.split() for f in names_types.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, kinds[t.split("<")[0]]) for c, (_, t) in zip(cols, fields, strict=True)], [n for n, _ in fields])


BLOCKS = "block long, docs binary, tokens binary, words binary, counts binary, n_words long"


def _blocks(batches):
    """Token numbers of blocks of texts; a block's words are sorted by hash."""
    part, number = TaskContext.get().partitionId() << 32, 0
    docs, tokens, numbers, size = [], [], _Numbers(), 0
    end = numbers[None]

    def block():
        hashes = np.array([END_HASH, *(xxhash.xxh64_intdigest(w, 7) for w in list(numbers)[1:])], np.uint64)
        order = np.argsort(hashes)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.arange(len(order))
        d = np.array(docs, DOCS)
        t = rank[np.concatenate(tokens)]
        counts = np.bincount(t[np.repeat(d["train"], d["n"]).astype(bool)], minlength=len(order))
        return _batch(BLOCKS, [(part + number, _pack(d), _pack_ints(t), _pack(hashes[order]), _pack_ints(counts), len(order))])

    for b in batches:
        for i, train, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), strict=True):
            raw = text.as_buffer().to_pybytes()
            own = np.array([*map(numbers.__getitem__, raw.lower().split()), end], np.uint32)
            docs.append((i or 0, i is None, train, len(own)))
            tokens.append(own)
            size += len(raw) + 1
            if size >= BLOCK_BYTES:
                yield block()
                number += 1
                docs, tokens, numbers, size = [], [], _Numbers(), 0
                end = numbers[None]
    if docs:
        yield block()


def _shard_of(words: np.ndarray, shards: int) -> np.ndarray:
    """Ranges of the hash: a block's words of a shard stand together."""
    return ((words >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)


def _asks(shards: int):
    def each(batches):
        for b in batches:
            for block, w, c in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                words, counts = _unpack(w, "<u8"), _unpack_ints(c)
                cuts = np.searchsorted(_shard_of(words, shards), np.arange(shards + 1))
                yield _batch("shard long, block long, words binary, counts binary", [(s, block, _pack(words[lo:hi]), _pack_ints(counts[lo:hi])) for s, (lo, hi) in enumerate(zip(cuts, cuts[1:], strict=False)) if hi > lo])

    return each


VOCAB = "shard long, block long, ids binary, counts binary, totals array<long>, top array<long>"
STATE = "shard long, classes binary"


def _vocabulary(t: pa.Table) -> pa.Table:
    """Numbers and training counts of a shard's words for each block; totals (tokens, types, types seen once) and the shard's most frequent words."""
    shard = t.column("shard")[0].as_py()
    words = [_unpack(x, "<u8") for x in t.column("words").to_pylist()]
    all_words, ids = np.unique(np.concatenate(words), return_inverse=True)
    count = np.bincount(ids, np.concatenate([_unpack_ints(x) for x in t.column("counts").to_pylist()]), len(all_words)).astype(np.int64)
    rows = []
    for block, own in zip(t.column("block").to_pylist(), np.split(ids, np.cumsum([len(w) for w in words])[:-1]), strict=True):
        rows.append((shard, block, _pack_ints(np.diff(own, prepend=0)), _pack_ints(count[own]), None, None))
    top = np.argsort(-count, kind="stable")[: CLASSES - FIRST + 1]
    end = np.flatnonzero(all_words == np.uint64(END_HASH))
    pairs = [x for i in top if count[i] and i not in end for x in (int(i), int(count[i]))]
    rows.append((shard, -1, None, _pack_ints(count), [int(count.sum()), int((count > 0).sum()), int((count == 1).sum()), int(end[0]) if len(end) else -1], pairs))
    return pa.Table.from_batches([_batch(VOCAB, rows)])


def _by_place(rows: pa.Table) -> list[dict]:
    """A block's answers in the order of its words."""
    return sorted(rows.to_pylist(), key=lambda r: r["shard"])


def _begin(markers: dict[tuple[int, int], int]):
    """The classes before the first round, a shard's words at a time."""

    def each(batches):
        for b in batches:
            for shard, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                cls = np.where(_unpack_ints(counts) > 0, REST, UNSEEN)
                for (s, i), c in markers.items():
                    if s == shard:
                        cls[i] = c
                yield _batch(STATE, [(shard, _pack(cls.astype("u1")))])

    return each


ANSWERS = "block long, shard long, ids binary, classes binary"


def _answered(vocabulary: pa.Table, state: pa.Table) -> pa.Table:
    """The classes of a shard's words, for each block that asked."""
    cls = _unpack(state.column("classes")[0].as_py(), "u1") if state.num_rows else np.zeros(0, "u1")
    rows = [(block, shard, ids, _pack(cls[np.cumsum(_unpack_ints(ids))])) for block, shard, ids in zip(*(vocabulary.column(c).to_pylist() for c in ("block", "shard", "ids")), strict=True)]
    return pa.Table.from_batches([_batch(ANSWERS, rows)])


def _sequence(block: dict, cls: np.ndarray):
    """(docs, tokens, each token's document, class, and the class before it; before a text stands the end)."""
    d, t = _unpack(block["docs"], DOCS), _unpack_ints(block["tokens"])
    doc = np.repeat(np.arange(len(d)), d["n"])
    now = cls[t]
    before = np.append(END, now[:-1])
    before[np.cumsum(d["n"])[:-1]] = END
    return d, t, doc, now, before


CONTEXTS = "shard long, ids binary, classes binary, cells binary, values binary"


def _contexts(blocks: pa.Table, answers: pa.Table) -> pa.Table:
    """Profiles of a block's words: counts of (word, side and class of the neighbour) in training texts."""
    out = []
    for block in blocks.to_pylist():
        rows = _by_place(answers)
        own = [_unpack(r["classes"], "u1") for r in rows]
        d, t, doc, now, before = _sequence(block, np.concatenate(own).astype(np.int64))
        train = d["train"][doc].astype(bool)
        inner = train[1:] & (doc[1:] == doc[:-1])
        key = np.concatenate([(t * (2 * CLASSES) + before)[train], (t[:-1] * (2 * CLASSES) + CLASSES + now[1:])[inner]])
        key, n = np.unique(key, return_counts=True)
        cuts = np.cumsum([0, *map(len, own)])
        at = np.searchsorted(key, cuts * (2 * CLASSES))
        for k, r in enumerate(rows):
            cells = key[at[k] : at[k + 1]] - cuts[k] * 2 * CLASSES
            out.append((r["shard"], r["ids"], r["classes"], _pack_ints(np.diff(cells, prepend=0)), _pack_ints(n[at[k] : at[k + 1]])))
    return pa.Table.from_batches([_batch(CONTEXTS, out)])


PROFILES = "shard long, classes binary, cells binary, values binary"


def _profiles(t: pa.Table) -> pa.Table:
    """A shard's classes, and its profiles, summed over blocks, as sorted cells (word * 2 * CLASSES + feature) and values."""
    cls, cells, values = np.zeros(0, "u1"), [], []
    for i, k, c, v in zip(*(t.column(n).to_pylist() for n in ("ids", "classes", "cells", "values")), strict=True):
        ids, cell = np.cumsum(_unpack_ints(i)), np.cumsum(_unpack_ints(c))
        if len(cls) <= ids[-1]:
            cls = np.append(cls, np.full(ids[-1] + 1 - len(cls), UNSEEN, "u1"))
        cls[ids] = _unpack(k, "u1")
        cells.append(ids[cell // (2 * CLASSES)] * (2 * CLASSES) + cell % (2 * CLASSES))
        values.append(_unpack_ints(v))
    cell = np.concatenate(cells)
    order = np.argsort(cell, kind="stable")
    cell, value = cell[order], np.concatenate(values)[order]
    head = np.flatnonzero(np.diff(cell, prepend=-1))
    value = np.add.reduceat(value, head) if len(head) else value
    return pa.Table.from_batches([_batch(PROFILES, [(t.column("shard")[0].as_py(), _pack(cls), _pack(np.diff(cell[head], prepend=0).astype("<i8")), _pack_ints(value))])])


def _profile_rows(batches):
    """(shard, its words' classes, word, feature, value) of profile rows."""
    for b in batches:
        for shard, k, c, v in zip(*(b.column(n).to_pylist() for n in range(4)), strict=True):
            cell = np.cumsum(_unpack(c, "<i8"))
            yield shard, _unpack(k, "u1").astype(np.int64), cell // (2 * CLASSES), cell % (2 * CLASSES), _unpack_ints(v)


def _bigrams(batches):
    """How often each class stands beside each: (class, side and class of the neighbour)."""
    for _, cls, word, feature, value in _profile_rows(batches):
        sums = np.bincount(cls[word] * (2 * CLASSES) + feature, value, CLASSES * 2 * CLASSES)
        yield _batch("cells array", [([int(x) for x in sums],)])


def log_likelihood(counts: np.ndarray) -> float:
    """Of the training texts' class bigrams, up to the words' own part, which no exchange changes."""
    f = lambda x: float((x * np.log(np.maximum(x, 1))).sum())
    left = counts[:, :CLASSES]  # of each class, what stands before it
    return f(left) - f(left.sum(0)) - f(left.sum(1))


def _moves(likely: np.ndarray, turn: int):
    """Each word's class for the next round: the likeliest, if it is the word's turn; given classes and unseen words stay."""

    def each(batches):
        for shard, cls, word, feature, value in _profile_rows(batches):
            cls = cls.copy()
            head = np.flatnonzero(np.diff(word, prepend=-1))
            words = word[head]
            for lo in range(0, len(words), 8192):
                own = words[lo : lo + 8192]
                part = slice(head[lo], head[lo + 8192] if lo + 8192 < len(head) else len(word))
                dense = np.zeros((len(own), 2 * CLASSES))
                dense[np.searchsorted(own, word[part]), feature[part]] = value[part]
                best = (dense @ likely).argmax(1) + REST
                may = cls[own] >= REST
                if turn:
                    may &= (own * 0x9E37 >> 3) % 2 == turn % 2
                cls[own[may]] = best[may]
            yield _batch(STATE, [(shard, _pack(cls.astype("u1")))])

    return each


def _likely(counts: np.ndarray) -> np.ndarray:
    """log P(class beside | class), per side, of classes from REST on, with the overall distribution mixed in."""
    out = []
    for side in (counts[:, :CLASSES], counts[:, CLASSES:]):
        overall = side.sum(0) + 1.0
        p = side[REST:] + 20.0 * overall / overall.sum()
        out.append(np.log(p / p.sum(1, keepdims=True)))
    return np.concatenate(out, axis=1).T


def _summed(df: DataFrame, size: int) -> np.ndarray:
    """Sum of fixed-size arrays, added up in Spark."""
    out = np.zeros(size)
    for r in df.select(F.posexplode("cells")).groupBy("pos").agg(F.sum("col").alias("n")).collect():
        out[r.pos] = r.n
    return out


CLASSED = "block long, shard long, counts binary, classes binary, sizes array<long>"


def _classed(vocabulary: pa.Table, state: pa.Table) -> pa.Table:
    """A shard's final classes, for each block, and each class's tokens and types."""
    cls = _unpack(state.column("classes")[0].as_py(), "u1").astype(np.int64) if state.num_rows else np.zeros(0, np.int64)
    rows, total = [], np.zeros(len(cls), np.int64)
    for r in vocabulary.to_pylist():
        ids = np.cumsum(_unpack_ints(r["ids"]))
        total[ids] = _unpack_ints(r["counts"])
        rows.append((r["block"], r["shard"], r["counts"], _pack(cls[ids].astype("u1")), None))
    seen = total > 0
    both = np.concatenate([np.bincount(cls[seen], total[seen], CLASSES), np.bincount(cls[seen], minlength=CLASSES)])
    rows.append((-1, -1, None, None, [int(x) for x in both]))
    return pa.Table.from_batches([_batch(CLASSED, rows)])


SEQUENCES = "docs binary, known binary, base binary, emitted binary, classes binary, cells array<long>"


def _sequences(tokens: int, types: int, size: np.ndarray, kinds: np.ndarray):
    """Per block: each document's known tokens, base score and emission score, the class sequence, and training transitions."""

    def each(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        out = []
        for block in blocks.to_pylist():
            rows = _by_place(answers)
            count = np.concatenate([_unpack_ints(r["counts"]) for r in rows])
            cls = np.concatenate([_unpack(r["classes"], "u1") for r in rows]).astype(np.int64)
            base = np.log10((count + SMOOTH) / (tokens + SMOOTH * (types + 1)))
            emit = np.where(count > 0, np.log10((count + SMOOTH) / (size[cls] + SMOOTH * kinds[cls] + 1e-300)), 0.0)
            d, t, doc, now, before = _sequence(block, cls)
            add = lambda x: np.bincount(doc, x[t], len(d))  # noqa: B023, E731
            train = d["train"][doc].astype(bool)
            cells = np.bincount((before * CLASSES + now)[train], minlength=CLASSES * CLASSES)
            out.append((_pack(d), _pack(add((count > 0).astype(float)).astype("<i8")), _pack(add(base)), _pack(add(emit)), _pack(now.astype("u1")), [int(x) for x in cells]))
        return pa.Table.from_batches([_batch(SEQUENCES, out)])

    return each


def transitions(cells: np.ndarray, unseen: float) -> np.ndarray:
    """log10 P(class | class before); `unseen` is the mass of words that training didn't see."""
    n = cells.reshape(CLASSES, CLASSES).astype(float)
    n[:, UNSEEN] = 0
    prior = (n.sum(0) + SMOOTH) * (np.arange(CLASSES) != UNSEEN)
    prior /= prior.sum()
    total, kinds = n.sum(1, keepdims=True), (n > 0).sum(1, keepdims=True)
    share = np.where(total > 0, total / np.maximum(total + kinds, 1), 0)
    p = (1 - unseen) * (share * n / np.maximum(total, 1) + (1 - share) * prior)
    p[:, UNSEEN] = unseen
    return np.log10(np.maximum(p, 1e-300))


def _scored(log_p: np.ndarray, tokens: int):
    def each(batches):
        for b in batches:
            for row in b.to_pylist():
                d, now = _unpack(row["docs"], DOCS), _unpack(row["classes"], "u1").astype(np.int64)
                doc = np.repeat(np.arange(len(d)), d["n"])
                before = np.append(END, now[:-1])
                before[np.cumsum(d["n"])[:-1]] = END
                score = np.bincount(doc, log_p[before, now], len(d)) + _unpack(row["emitted"], "<f8")
                yield pa.RecordBatch.from_arrays(
                    [pa.array(d["id"], pa.int64(), mask=d["null"].astype(bool)), pa.array(d["train"] == 0), pa.array(d["n"], pa.int64()), pa.array(_unpack(row["known"], "<i8"), pa.int64()), pa.array(np.full(len(d), tokens, np.int64)), pa.array(_unpack(row["base"], "<f8")), pa.array(score)],
                    ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
                )

    return each


def exchange(blocks: DataFrame, vocabulary: DataFrame, markers: dict[tuple[int, int], int], rounds: int = ROUNDS) -> tuple[DataFrame, list[float]]:
    """(shard, classes) of the likeliest state, and the log likelihood of the states that were counted."""
    answers = vocabulary.where("block >= 0").select("shard", "block", "ids")
    own = blocks.select("block", "docs", "tokens").groupBy("block")
    state = written(vocabulary.where("block < 0").select("shard", "counts").mapInArrow(_begin(markers), STATE), "brown-state")
    best, found, before = state, [], None
    for k in range(rounds):
        asked = answers.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_answered, ANSWERS)
        contexts = own.cogroup(asked.groupBy("block")).applyInArrow(_contexts, CONTEXTS)
        profiles = written(contexts.groupBy("shard").applyInArrow(_profiles, PROFILES), "brown-profiles")
        counts = _summed(profiles.mapInArrow(_bigrams, "cells array<long>"), CLASSES * 2 * CLASSES).reshape(CLASSES, -1)
        now = log_likelihood(counts)
        rises = not found or now > max(found)
        enough = found and now - max(found) < ENOUGH * abs(max(found))
        found.append(now)
        if rises:
            best = state
        if rises:
            if before is not None:
                dropped(before[0])
            before = (profiles, counts)
        else:
            dropped(profiles)  # these moves are taken back, and the other half's turn is next
        if k + 1 == rounds or (enough and k > 2):
            break
        state = written(before[0].mapInArrow(_moves(_likely(before[1]), k), STATE), "brown-state")
        released(blocks.sparkSession)
    return best, found


def score(documents: DataFrame, training: Column) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score of every row; learns where `training` holds."""
    spark = documents.sparkSession
    docs = documents.select(F.col("doc_id").cast("long"), training.cast("int").alias("train"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    first = written(docs.mapInArrow(_blocks, BLOCKS), "brown-blocks")
    asked, n_blocks = first.agg(F.sum("n_words"), F.count("*")).first()
    shards = max(1, (asked or 0) // SHARD_WORDS)
    blocks, drop = bucketed(first.select("block", "docs", "tokens"), "block", int(min(100_000, max(1, n_blocks))))
    asks = first.select("block", "words", "counts").mapInArrow(_asks(shards), "shard long, block long, words binary, counts binary")
    vocabulary = written(asks.groupBy("shard").applyInArrow(_vocabulary, VOCAB), "brown-vocabulary")
    dropped(first)
    released(spark)
    t = vocabulary.where("block < 0").agg(*[F.sum(F.col("totals")[k]).alias(n) for k, n in enumerate(("tokens", "types", "once"))], F.max(F.when(F.col("totals")[3] >= 0, F.struct("shard", F.col("totals")[3].alias("id")))).alias("end")).first()
    tokens, types = int(t.tokens or 0), int(t.types or 0)
    ends = (t.end.shard, t.end.id) if t.end else (-1, 0)
    place = F.explode(F.sequence(F.lit(0), (F.size("top") / 2 - 1).cast("int"))).alias("k")
    top = vocabulary.where("block < 0 and size(top) > 0").select("shard", "top", place).select("shard", F.col("top")[F.col("k") * 2].alias("id"), F.col("top")[F.col("k") * 2 + 1].alias("n"))
    markers = {(r.shard, r.id): FIRST + k for k, r in enumerate(top.orderBy(F.desc("n"), "shard", "id").limit(CLASSES - FIRST).collect())} | {ends: END}
    state, _ = exchange(blocks, vocabulary, markers)
    answers = vocabulary.where("block >= 0").select("shard", "block", "ids", "counts")
    classed = written(answers.groupBy("shard").cogroup(state.groupBy("shard")).applyInArrow(_classed, CLASSED), "brown-classes")
    sizes = _summed(classed.where("block < 0").select(F.col("sizes").alias("cells")), 2 * CLASSES)
    own = blocks.select("block", "docs", "tokens").groupBy("block")
    made = own.cogroup(classed.where("block >= 0").select("block", "shard", "counts", "classes").groupBy("block")).applyInArrow(_sequences(tokens, types, sizes[:CLASSES], sizes[CLASSES:]), SEQUENCES)
    made = written(made, "brown-sequences")
    drop()
    unseen = min(0.5, ((t.once or 0) + 1) / max(tokens, 1))
    log_p = transitions(_summed(made.select("cells"), CLASSES * CLASSES), unseen)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return made.select("docs", "known", "base", "emitted", "classes").mapInArrow(_scored(log_p, tokens), schema)
