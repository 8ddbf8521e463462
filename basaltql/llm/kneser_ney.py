"""Quality by perplexity under an interpolated modified Kneser-Ney model of byte 6-grams, learned from trusted text.

Counts of all trusted documents are gathered in shards, as many as the trusted bytes ask for.  Continuation counts,
discounts, context weights and the probabilities of all n-grams seen, order by order, are joins and sums over the count
tables; nothing that grows with the corpus is broadcast or collected.  Scoring is a sharded count join: texts are cut in
blocks, a block asks the shards of the model for its distinct 6-grams, a shard looks each up, backs off where it wasn't
seen and answers with its log probability (in steps of 1 / STEPS, two bytes each), and the block adds the answers up
over its texts.  An n-gram, its suffixes
and all their contexts agree in the two bytes before the last, so one shard holds all that a 6-gram needs.  A document's
perplexity is held against a quantile of the trusted documents' perplexities in its language.

A fifth of the trusted documents (crc32(doc_id) mod FOLDS = 0) is kept from the counts and sets the quantiles, so that
they hold for text the model hasn't seen; a language with under FEW of them takes the larger of its own and the overall
quantile.

Null and empty texts have no perplexity (null) and aren't kept.  A null language is a class of its own; a language
without trusted documents takes the quantile over all of them; without any trusted text everything but empty texts is
kept.  A null doc_id is scored and never trusted.  Repeated rows are scored alike.  Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bucketed, crc_mod, dropped, released, text_bytes, written

ORDER, QUANTILE, FOLDS, FEW = 6, 0.99, 5, 20
#: Bytes of text in a block, of a piece of a long text; trusted bytes a count shard; model rows and asked n-grams a scoring shard; ids that may be broadcast.
BLOCK_BYTES, PIECE, COUNT_BYTES, SHARD_ROWS, BROADCAST_IDS = 6 << 20, 4 << 20, 8 << 20, 2_000_000, 2_000_000
PAD = b"\n" * (ORDER - 1)
#: Steps of a log10 probability in an answer; those beyond -65535 / STEPS count as that.
STEPS = 4096
#: An odd multiplier that spreads the 2**16 pairs of bytes over shards.
SPREAD = 40503


def _zip(a: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(a).tobytes())


def _unzip(b: bytes, dtype) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(b), dtype)


def _pack(ids: np.ndarray) -> bytes:
    """Sorted numbers as differences, byte by byte."""
    return _zip(np.diff(ids, prepend=np.uint64(0)).astype("<u8").view("u1").reshape(-1, 8).T)


def _unpack(b: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(_unzip(b, "u1").reshape(8, -1).T).view("<u8").reshape(-1), dtype=np.uint64)


def _pieces(text: bytes):
    """A text's pieces with the ORDER - 1 bytes before each."""
    for at in range(0, max(1, len(text)), PIECE):
        before = PAD if not at else text[at - len(PAD) : at]
        yield before + text[at : at + PIECE]


def _grams(flat: bytes, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(n-gram numbers, the piece each ends in) of joined pieces; `sizes` without the bytes before."""
    raw = np.frombuffer(flat, np.uint8)
    ids = np.zeros(max(0, len(raw) - ORDER + 1), np.uint64)
    for k in range(ORDER):
        ids = ids << np.uint64(8) | raw[k : k + len(ids)]
    whole = np.ones(len(raw), bool)  # n-grams that end in the piece they begin in
    ends = np.cumsum(sizes + ORDER - 1)
    for k in range(1, ORDER):
        whole[ends - k] = False
    return ids[whole[: len(ids)]], np.repeat(np.arange(len(sizes), dtype=np.int32), sizes)


def _shard_of(ids: np.ndarray, shards: int) -> np.ndarray:
    """By the two bytes before the last."""
    return ((ids >> np.uint64(8) & np.uint64(0xFFFF)) * np.uint64(SPREAD) & np.uint64(0xFFFF)) % np.uint64(shards)


def counts(texts: DataFrame, shards: int) -> DataFrame:
    """id and c of all n-grams of column `text` (binary)."""

    def each(batches):
        for b in batches:
            pieces, size = [], 0
            for i in range(b.num_rows):
                for piece in _pieces(b.column(0)[i].as_py()):
                    pieces.append(piece)
                    size += len(piece)
                    if size >= PIECE:
                        yield from table(pieces)
                        pieces, size = [], 0
            yield from table(pieces)

    def table(pieces):
        if pieces:
            ids, n = np.unique(_grams(b"".join(pieces), np.array([len(p) - ORDER + 1 for p in pieces]))[0], return_counts=True)
            shard = ((ids >> np.uint64(8)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(40)) % np.uint64(shards)  # by context
            for s in np.unique(shard):
                own = shard == s
                yield pa.RecordBatch.from_arrays([pa.array([int(s)], pa.int64()), pa.array([_pack(ids[own])], pa.binary()), pa.array([_zip(n[own].astype("<u4"))], pa.binary())], ["shard", "ids", "n"])

    def add(t: pa.Table) -> pa.Table:
        ids, back = np.unique(np.concatenate([_unpack(x) for x in t.column("ids").to_pylist()]), return_inverse=True)
        n = np.bincount(back, np.concatenate([_unzip(x, "<u4") for x in t.column("n").to_pylist()]))
        return pa.table({"id": ids.astype(np.int64), "c": n.astype(np.int64)})

    sent = texts.select("text").mapInArrow(each, "shard long, ids binary, n binary").repartition(shards, "shard")
    return sent.groupBy("shard").applyInArrow(add, "id long, c long")


def discounts(n: list[int]) -> list[float]:
    """D1, D2, D3+ from the numbers of n-grams seen 1, 2, 3 and 4 times."""
    n1, n2, n3, n4 = (max(x, 1) for x in n)
    y = n1 / (n1 + 2 * n2)
    return [min(max(d, 0.05), k - 0.05) for k, d in ((1, 1 - 2 * y * n2 / n1), (2, 2 - 3 * y * n3 / n2), (3, 3 - 4 * y * n4 / n3))]


def _level(t: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, context, share: the discounted part of its probability) and (context, weight of the lower order) of a count table."""
    n = t.agg(*[F.sum((F.col("c") == k).cast("long")) for k in (1, 2, 3, 4)]).first()
    d = discounts([x or 0 for x in n])
    off = F.when(F.col("c") == 1, d[0]).when(F.col("c") == 2, d[1]).otherwise(d[2])
    t = t.withColumn("context", F.shiftright("id", 8))
    heads = t.groupBy("context").agg(F.sum("c").alias("total"), F.sum(off).alias("off"))
    shares = t.join(heads, "context").select("id", "context", ((F.col("c") - off) / F.col("total")).alias("share"), (F.col("off") / F.col("total")).alias("weight"))
    return shares, heads.select("context", (F.col("off") / F.col("total")).alias("weight"))


def _pairs(t2: DataFrame) -> np.ndarray:
    """Probabilities of all 2**16 pairs of bytes, an array of fixed size."""
    p1 = np.full(256, 0.5)
    for r in t2.groupBy((F.col("id") % 256).alias("id")).agg(F.count("*").alias("c")).collect():
        p1[r.id] += r.c
    p1 /= p1.sum()
    shares, heads = _level(t2)
    weight = np.ones(256)
    for r in heads.collect():
        weight[r.context] = r.weight
    p2 = (weight[:, None] * p1[None, :]).reshape(-1)
    for r in shares.select("id", "share").collect():
        p2[r.id] += r.share
    return p2


MODEL = "rank int, id long, value double"


def fit(texts: DataFrame, shards: int = 1) -> tuple[DataFrame, np.ndarray]:
    """The model as a table (rank, id, value), and the probabilities of pairs.

    Rank n holds the probability of each n-gram seen, n from 3 to ORDER; rank -n the weight that each context of n-grams
    leaves to the lower order.
    """
    spark = texts.sparkSession
    tables = {ORDER: written(counts(texts, shards), "kn-counts")}
    for n in range(ORDER - 1, 1, -1):
        lower = tables[n + 1].groupBy((F.col("id") % (1 << 8 * n)).alias("id")).agg(F.count("*").alias("c"))
        tables[n] = written(lower, "kn-continuations")
    p2 = _pairs(tables[2])
    below = spark.createDataFrame(pa.table({"suffix": np.arange(1 << 16), "lower": p2}))
    out, held = [], []
    for n in range(3, ORDER + 1):
        shares, heads = _level(tables[n])
        # every n-gram's suffix was counted, so no row is lost
        own = shares.withColumn("suffix", F.col("id") % (1 << 8 * (n - 1))).join(below, "suffix").select("id", (F.col("share") + F.col("weight") * F.col("lower")).alias("value"))
        own = written(own, "kn-probabilities")
        held.append(own)
        out += [own.select(F.lit(n).alias("rank"), "id", "value"), heads.select(F.lit(-n).alias("rank"), F.col("context").alias("id"), F.col("weight").alias("value"))]
        below = own.select(F.col("id").alias("suffix"), F.col("value").alias("lower"))
    model = out[0]
    for part in out[1:]:
        model = model.union(part)
    model = written(model, "kn-model")
    for old in (*tables.values(), *held):
        dropped(old)
    released(spark)
    return model, p2


class Shard:
    """What a shard holds of the model, by rank, sorted by number."""

    def __init__(self, rank: np.ndarray, ids: np.ndarray, values: np.ndarray, p2: np.ndarray):
        self.p2, self.ranks = p2, {}
        for r in (n for n in range(-ORDER, ORDER + 1) if abs(n) > 2):
            own = np.flatnonzero(rank == r)
            own = own[np.argsort(ids[own], kind="stable")]
            self.ranks[r] = ids[own].astype(np.uint64), values[own]

    def _find(self, rank: int, asked: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(which were found, their values)"""
        ids, values = self.ranks[rank]
        if not len(ids):
            return np.zeros(len(asked), bool), np.zeros(len(asked))
        at = np.minimum(np.searchsorted(ids, asked), len(ids) - 1)
        return ids[at] == asked, values[at]

    def log10(self, asked: np.ndarray) -> np.ndarray:
        """log10 P(last byte | the bytes before it) of ORDER-grams: of the longest suffix seen, times the weights of longer contexts."""
        p, todo = np.ones(len(asked)), np.arange(len(asked))
        for n in range(ORDER, 2, -1):
            own = asked[todo] & np.uint64((1 << 8 * n) - 1)
            found, value = self._find(n, own)
            p[todo[found]] *= value[found]
            todo, own = todo[~found], own[~found]
            seen, weight = self._find(-n, own >> np.uint64(8))
            p[todo[seen]] *= weight[seen]
        p[todo] *= self.p2[(asked[todo] & np.uint64(0xFFFF)).astype(np.int64)]
        return np.log10(p)


BLOCKS = "block long, docs binary, text binary"
DOCS = pa.schema([("row", pa.int64()), ("doc_id", pa.int64()), ("lang", pa.string()), ("n", pa.int64())])


def _blocks(batches):
    """Texts in blocks: rows (a long text is in several pieces of one row number), and the joined pieces."""
    part, number, rows = TaskContext.get().partitionId() << 40, 0, 0
    docs, pieces, size = [], [], 0

    def block():
        table = pa.table([pa.array([d[k] for d in docs], f.type) for k, f in enumerate(DOCS)], schema=DOCS)
        sink = pa.BufferOutputStream()
        with pa.ipc.new_stream(sink, DOCS) as out:
            out.write_table(table)
        return pa.RecordBatch.from_arrays([pa.array([part + number], pa.int64()), pa.array([zstandard.compress(sink.getvalue().to_pybytes(), 3)], pa.binary()), pa.array([zstandard.compress(b"".join(pieces), 3)], pa.binary())], ["block", "docs", "text"])

    for b in batches:
        for i in range(b.num_rows):
            for piece in _pieces(b.column(2)[i].as_py()):
                docs.append((part + rows, b.column(0)[i].as_py(), b.column(1)[i].as_py(), len(piece) - len(PAD)))
                pieces.append(piece)
                size += len(piece)
                if size >= BLOCK_BYTES:
                    yield block()
                    number, docs, pieces, size = number + 1, [], [], 0
            rows += 1
    if docs:
        yield block()


def _opened(docs: bytes, text: bytes) -> tuple[pa.Table, np.ndarray, np.ndarray]:
    """A block's rows, its n-grams and the piece of each."""
    table = pa.ipc.open_stream(zstandard.decompress(docs)).read_all()
    return table, *_grams(zstandard.decompress(text), table.column("n").to_numpy())


def _distinct(ids: np.ndarray, shards: int) -> list[tuple[int, np.ndarray]]:
    """A block's distinct n-grams by shard, sorted."""
    ids = np.sort(ids)
    ids = ids[np.append(True, ids[1:] != ids[:-1])] if len(ids) else ids
    shard = _shard_of(ids, shards)
    order = np.argsort(shard, kind="stable")
    return [(int(shard[own[0]]), ids[own]) for own in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1) if len(own)]


def _asks(shards: int):
    def each(batches):
        for b in batches:
            for block, docs, text in zip(*(b.column(k).to_pylist() for k in range(3)), strict=True):
                asked = _distinct(_opened(docs, text)[1], shards)
                yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in asked], pa.int64()), pa.array([block] * len(asked), pa.int64()), pa.array([_pack(ids) for _, ids in asked], pa.binary())], ["shard", "block", "ids"])

    return each


ANSWERS = "block long, shard long, logs binary"


def _answers(p2: np.ndarray):
    def each(asks: pa.Table, model: pa.Table) -> pa.Table:
        shard = Shard(*(model.column(c).to_numpy() for c in ("rank", "id", "value")), p2)
        steps = lambda ids: np.minimum(np.rint(-STEPS * shard.log10(ids)), 65535).astype("<u2")
        logs = [_zip(steps(_unpack(ids.as_py())).view("u1").reshape(-1, 2).T) for ids in asks.column("ids")]
        return pa.table({"block": asks.column("block"), "shard": asks.column("shard"), "logs": pa.array(logs, pa.binary())})

    return each


SCORED = "row long, doc_id long, lang string, n_bytes long, log10p double"


def _added(shards: int):
    def each(blocks: pa.Table, answers: pa.Table) -> pa.Table:
        logs, out = dict(zip(answers.column("shard").to_pylist(), answers.column("logs").to_pylist(), strict=True)), []
        for docs, text in zip(*(blocks.column(c).to_pylist() for c in ("docs", "text")), strict=True):
            table, ids, piece = _opened(docs, text)
            total = np.zeros(table.num_rows)
            if len(ids):
                asked = _distinct(ids, shards)
                keys, steps = np.concatenate([g for _, g in asked]), np.concatenate([np.ascontiguousarray(_unzip(logs[s], "u1").reshape(2, -1).T).view("<u2").reshape(-1) for s, _ in asked])
                del asked
                order = np.argsort(keys)
                keys, steps = keys[order], steps[order]
                for lo in range(0, len(ids), 1 << 19):
                    own = slice(lo, lo + (1 << 19))
                    total -= np.bincount(piece[own], steps[np.searchsorted(keys, ids[own])], table.num_rows) / STEPS
            out.append(pa.table({"row": table.column("row"), "doc_id": table.column("doc_id"), "lang": table.column("lang"), "n_bytes": table.column("n"), "log10p": total}))
        return pa.concat_tables(out)

    return each


def log_probabilities(documents: DataFrame, model: DataFrame, p2: np.ndarray) -> DataFrame:
    """doc_id, lang, n_bytes and log10p of every row."""
    docs = documents.select(F.col("doc_id").cast("long"), F.col("lang").cast("string"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    total = text_bytes(documents)
    blocks, drop = bucketed(docs.mapInArrow(_blocks, BLOCKS), "block", int(min(100_000, max(1, total // BLOCK_BYTES))))
    shards = int(min(1 << 16, max(1, model.count() // SHARD_ROWS, total // (16 * SHARD_ROWS))))
    pair = F.when(F.col("rank") > 0, F.shiftright("id", 8)).otherwise(F.col("id")) % (1 << 16)
    held = model.withColumn("shard", (pair * SPREAD) % (1 << 16) % shards).repartition(shards, "shard")
    asks = blocks.mapInArrow(_asks(shards), "shard long, block long, ids binary").repartition(shards, "shard")
    answers = asks.groupBy("shard").cogroup(held.groupBy("shard")).applyInArrow(_answers(p2), ANSWERS)
    scored = blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(_added(shards), SCORED)
    # the pieces of a long text come together
    scored = scored.groupBy("row").agg(F.min("doc_id").alias("doc_id"), F.min("lang").alias("lang"), F.sum("n_bytes").alias("n_bytes"), F.sum("log10p").alias("log10p")).drop("row")
    scored = written(scored, "kn-log-probabilities")
    drop()
    released(documents.sparkSession)
    return scored


def quality(documents: DataFrame, trusted: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """doc_id, lang, n_bytes, perplexity, threshold and keep of every row; `trusted` names the doc_ids to learn from."""
    ids = written(trusted.select(F.col("doc_id").cast("long").alias("_id")).where("_id is not null").distinct(), "kn-trusted")
    near = F.broadcast if ids.count() <= BROADCAST_IDS else (lambda x: x.hint("merge"))  # beyond the bound both sides are sorted
    learned, held = ids.where(crc_mod(F.col("_id"), FOLDS) != 0), ids.where(crc_mod(F.col("_id"), FOLDS) == 0)
    known = documents.join(near(learned), F.col("doc_id").cast("long") == F.col("_id"), "left_semi").where("length(text) > 0").select(F.col("text").cast("binary").alias("text"))
    model, p2 = fit(known, max(1, text_bytes(known) // COUNT_BYTES))
    scored = log_probabilities(documents, model, p2)
    scored = scored.withColumn("perplexity", F.when(F.col("n_bytes") > 0, F.pow(F.lit(10.0), -F.col("log10p") / F.col("n_bytes")))).drop("log10p")
    scored = scored.withColumn("_lang", F.coalesce("lang", F.lit("<null>")))
    good = scored.join(near(held), F.col("doc_id") == F.col("_id"), "left_semi").where("perplexity is not null")
    limit = F.percentile_approx("perplexity", quantile, 10_000)
    overall = F.lit(good.agg(limit).first()[0]).cast("double")
    limits = good.groupBy("_lang").agg(limit.alias("threshold"), F.count("*").alias("_n"))
    limits = limits.withColumn("threshold", F.when(F.col("_n") < FEW, F.greatest("threshold", overall)).otherwise(F.col("threshold")))
    out = scored.join(limits, "_lang", "left").withColumn("threshold", F.coalesce("threshold", overall))
    keep = F.col("perplexity").isNotNull() & F.coalesce(F.col("perplexity") <= F.col("threshold"), F.lit(True))
    return out.select("doc_id", "lang", "n_bytes", "perplexity", "threshold", keep.alias("keep"))
