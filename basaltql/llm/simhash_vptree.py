"""SimHash near-duplicates with vantage-point trees.

A fingerprint bit is 1 if more than half of a text's shingle hashes (XXH64, seed 42) have it set.  Distinct
fingerprints are the points; copies never meet each other.  A vantage-point tree built from a bounded sample of
points (SAMPLE of them at most, a documented limit: it only places the cuts) deals the points to shards: at a node,
those within the radius of the vantage point go inward, the rest outward, and a point whose ball of `bits` crosses
the cut also visits the other side, as a query (triangle inequality), so every linked pair meets in a shard.  In a
shard a finer tree does the same down to small leaves, where distances are computed.  A shard returns a spanning
forest of its links, never all pairs; components come from alternating large-star and small-star rounds in Spark.

Null and empty texts have fingerprint zero and link like any other.  A null doc_id takes part and is ignored when
the smallest doc_id of a component is sought (null if it holds no other).  Repeated rows yield repeated rows.  Extra
columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, spare, written

SAMPLE, SHARD_POINTS, LEAF, STEP = 1 << 18, 30_000, 192, 1 << 15


def shingles(text: bytes, words_each: int) -> np.ndarray:
    """XXH64 (seed 42) of a text's word shingles, repeats included (of fewer words: of all of them; of none: nothing)."""
    words = text.lower().split()
    k = min(words_each, len(words))
    if not k:
        return np.zeros(0, np.uint64)
    flat = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.append(0, ends[:-1] + 1)[: len(words) - k + 1].tolist()
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(flat[a:b], 42) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)), np.uint64, len(starts))


def simhash(hashes: np.ndarray) -> int:
    """The fingerprint of some shingle hashes, as an unsigned 64-bit number."""
    ones = np.zeros(64, np.int64)
    for lo in range(0, len(hashes), STEP):
        h = hashes[lo : lo + STEP].astype(">u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes)).tobytes(), "big")


def fingerprint(text: bytes, words_each: int = 3) -> int:
    """SimHash of a text's word shingles."""
    return simhash(shingles(text, words_each))


def fingerprints(documents: DataFrame, words_each: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint's 64 bits as a signed long)."""

    def each(batches):
        for b in batches:
            out = [fingerprint(t.as_buffer().to_pybytes() if t.is_valid else b"", words_each) for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(out, np.uint64).view(np.int64))], ["doc_id", "fp"])

    return documents.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(each, "doc_id long, fp long")


def _distance(a, b):
    return np.bitwise_count(a ^ b)


def build_tree(points: np.ndarray, leaves: int) -> list:
    """Nodes (vantage point, radius, inner, outer); a child is a node's index, or -1 - the number of a shard."""
    nodes, shards = [], [0]

    def grow(own: np.ndarray, want: int) -> int:
        if want > 1 and len(own) >= 8:
            tries = own[np.linspace(0, len(own) - 1, 9).astype(int)]
            spread = [(_distance(own, t).std(), i) for i, t in enumerate(tries)]
            vantage = tries[max(spread)[1]]
            d = _distance(own, vantage)
            radius = int(np.median(d))
            if d.max() == radius:
                radius -= 1
            inner, outer = own[d <= radius], own[d > radius]
            if len(inner) and len(outer):
                at = len(nodes)
                nodes.append(None)
                nodes[at] = (int(vantage), radius, grow(inner, want // 2), grow(outer, want - want // 2))
                return at
        shards[0] += 1
        return -shards[0]

    root = grow(points, leaves)
    return [root, nodes]


def route(tree: list, points: np.ndarray, bits: int):
    """(shard, indexes of points, whether the shard is their home) of every shard that a point's ball meets."""
    root, nodes = tree
    todo = [(root, np.arange(len(points)), np.ones(len(points), bool))]
    while todo:
        at, own, home = todo.pop()
        if at < 0:
            yield -at - 1, own, home
            continue
        vantage, radius, inner, outer = nodes[at]
        d = _distance(points[own], np.uint64(vantage)).astype(np.int64)
        inward, outward = d - bits <= radius, d + bits > radius
        todo.append((inner, own[inward], home[inward] & (d[inward] <= radius)))
        todo.append((outer, own[outward], home[outward] & (d[outward] > radius)))


def _forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest index of each index's component."""
    label = np.arange(n)
    while True:
        before = label.copy()
        low = np.minimum(label[a], label[b])
        np.minimum.at(label, label[a], low)
        np.minimum.at(label, label[b], low)
        while not np.array_equal(label, label[label]):
            label = label[label]
        if np.array_equal(before, label):
            return label


def shard_links(points: np.ndarray, home: np.ndarray, bits: int) -> np.ndarray:
    """Labels that join the points of a shard that link; pairs are sought between home points and all points."""
    label = np.arange(len(points))
    pend: list[tuple[np.ndarray, np.ndarray]] = []
    size = 0

    def flush():
        nonlocal label, size
        if pend:
            a, b = (np.concatenate(x) for x in zip(*pend, strict=True))
            label = _forest(len(points), np.concatenate([a, np.arange(len(points))]), np.concatenate([b, label]))
            pend.clear()
            size = 0

    todo = [(np.flatnonzero(home), np.arange(len(points)), 0)]
    while todo:
        own, ask, depth = todo.pop()
        if not len(own) or not len(ask):
            continue
        d = None
        if len(own) > LEAF and depth < 64:
            vantage = points[own[(depth * 7919) % len(own)]]
            d = _distance(points[own], vantage).astype(np.int64)
            radius = int(np.median(d))
            if d.max() == radius:
                radius -= 1
            if d.min() > radius:
                d = None
        if d is None:
            for lo in range(0, len(ask), 4096):
                part = ask[lo : lo + 4096]
                for hi in range(0, len(own), 4096):
                    i, j = np.nonzero(_distance(points[own[hi : hi + 4096]][:, None], points[part][None, :]) <= bits)
                    a, b = own[hi + i], part[j]
                    keep = a != b
                    pend.append((a[keep], b[keep]))
                    size += int(keep.sum())
                    if size > 1 << 20:
                        flush()
            continue
        dq = _distance(points[ask], vantage).astype(np.int64)
        todo.append((own[d <= radius], ask[dq - bits <= radius], depth + 1))
        todo.append((own[d > radius], ask[dq + bits > radius], depth + 1))
    flush()
    return label


def links(points: DataFrame, bits: int) -> DataFrame:
    """Edges (u, v) that join the distinct fingerprints (column fp) linked at `bits` or fewer, as forests of shards."""
    count = points.count()
    leaves = max(1, -(-count // SHARD_POINTS))
    want = min(SAMPLE, 64 * leaves)
    picked = points.select("fp").orderBy(F.xxhash64("fp")).limit(want).collect() if leaves > 1 else []
    tree = build_tree(np.array([r.fp for r in picked], np.int64).view(np.uint64), leaves)

    def to_shards(batches):
        for b in batches:
            fp = b.column(0).to_numpy().view(np.uint64)
            for shard, own, home in route(tree, fp, bits):
                if len(own):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), shard, np.int64)), pa.array(fp[own].view(np.int64)), pa.array(home)], ["shard", "fp", "home"])

    def in_shard(t: pa.Table) -> pa.Table:
        fp = t.column("fp").to_numpy()
        label = shard_links(fp.view(np.uint64), t.column("home").to_numpy(zero_copy_only=False), bits)
        far = np.flatnonzero(label != np.arange(len(label)))
        return pa.table({"u": fp[far], "v": fp[label[far]]})

    dealt = points.select("fp").mapInArrow(to_shards, "shard long, fp long, home boolean")
    return dealt.groupBy("shard").applyInArrow(in_shard, "u long, v long")


def components(edges: DataFrame) -> DataFrame:
    """node and root (the smallest node of its component) by alternating large-star and small-star rounds."""
    now = cut(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    state = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").union(least.select("u", F.col("m").alias("v"))).distinct()
        now = cut(small)
        got = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if got == state:
            return now.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
        state = got


def near_duplicates(documents: DataFrame, words_each: int = 3, bits: int = 2) -> DataFrame:
    """doc_id, fp and component_id (the smallest doc_id reachable over links)."""
    prints = written(fingerprints(documents, words_each), "simhash")
    points = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-points")
    groups = components(links(points, bits))
    named = points.join(groups.withColumnRenamed("node", "fp"), "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    roots = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = named.join(roots, "root").select("fp", "component_id")
    return prints.join(named, "fp").select("doc_id", "fp", "component_id")


def digest(result: DataFrame) -> DataFrame:
    return result.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


# ---- near copies: five-word shingles, similarity 0.8 or more

VIEWS, EACH, WORDS, SIMILAR = 12, 3, 5, 0.8
#: Texts of a group that one task takes; of larger groups: heads in a round, pairs left per text at which rounds end,
#: texts of one shingle that meet unsalted.
GROUP, HEADS, PAIRS, SALT = 2000, 8, 64, 1000
LAST = (1 << 63) - 1
_SALT = (np.arange(1, VIEWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, None]


def shingle_hashes(text: bytes, words_each: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; of one without words the hash of nothing."""
    return distinct_hashes(shingles(text, words_each))


def distinct_hashes(hashes: np.ndarray) -> np.ndarray:
    return np.unique(hashes) if len(hashes) else np.array([xxhash.xxh64_intdigest(b"", 42)], np.uint64)


def view_prints(hashes: np.ndarray) -> np.ndarray:
    """VIEWS fingerprints of a set of shingles, each the SimHash of the EACH shingles that a hash of the view's own puts first."""
    low = None
    for lo in range(0, len(hashes), STEP):
        g = (hashes[None, lo : lo + STEP] ^ _SALT) * np.uint64(0xBF58476D1CE4E5B9)
        g ^= g >> np.uint64(31)
        g *= np.uint64(0x94D049BB133111EB)
        g ^= g >> np.uint64(29)
        low = g if low is None else np.concatenate([low, g], axis=1)
        if low.shape[1] > EACH:
            low = np.partition(low, EACH - 1, axis=1)[:, :EACH]
    if low.shape[1] == 1:
        return low[:, 0]
    if low.shape[1] == 2:
        return low[:, 0] & low[:, 1]
    a, b, c = low.T
    return (a & b) | (b & c) | (a & c)


def _text_key():
    """The first 16 bytes of a text's SHA-256 (null and empty alike): they stand for the text at any number of texts."""
    return F.unhex(F.substring(F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256), 1, 32))


def similar(documents: DataFrame) -> DataFrame:
    """_key and _root: texts of one root are linked by similarity SIMILAR or more of their five-word shingles, singles left out.

    Candidates come from two sides.  Whole texts' SimHash fingerprints are linked by vantage-point trees at 2 bits or
    fewer; and as texts at SIMILAR differ in some ten bits, where such trees can't prune, each text also has VIEWS
    fingerprints of EACH shingles, and texts that have one in common are a group.  Of every group all pairs that could
    be similar and aren't joined yet are compared, on whole shingle sets: first with the group's first text; then a
    group of up to GROUP texts in one task (`_group_links`); larger ones with texts already linked, round by round
    while that joins any, and at last by prefixes (`_prefix_pairs`).  No similar pair of a group is left out.
    """
    rank = F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST)).alias("_rank")
    texts = documents.select(_text_key().alias("_key"), F.coalesce("text", F.lit("")).cast("binary").alias("text"), rank)

    def sketch(batches):
        for b in batches:
            whole, views = [], []
            for t in b.column(1):
                hashes = shingles(t.as_buffer().to_pybytes(), WORDS)
                whole.append(simhash(hashes))
                views.append(view_prints(distinct_hashes(hashes)).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.array(whole, np.uint64).view(np.int64)), pa.array(views, pa.list_(pa.int64()))], ["_key", "fp", "views"])

    prints = written(texts.select("_key", "text").mapInArrow(sketch, "_key binary, fp long, views array<long>").dropDuplicates(["_key"]), "views")
    near = components(links(prints.select("fp").distinct(), 2)).withColumnRenamed("node", "fp")
    whole = prints.select("_key", "fp").join(near, "fp", "left").select("_key", F.coalesce("root", "fp").alias("root"))
    groups = whole.union(prints.select("_key", F.explode(F.array_distinct("views")).alias("root")))
    # a group of one text needs no look
    heads = groups.groupBy("root").agg(F.min("_key").alias("head"), F.max("_key").alias("_last")).where("head <> _last")
    members = groups.join(heads.select("root", "head"), "root")
    members = written(members.select("root", "head", "_key").distinct(), "view-members")

    def shingled(batches):
        for b in batches:
            sets = [shingle_hashes(t.as_buffer().to_pybytes()).tobytes() for t in b.column(1)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], ["_key", "shingles"])

    asked = members.select("_key").distinct()
    # of copies one row is joined to the keys, so that a group of copies doesn't meet in a task
    ones = texts.groupBy("_key").agg(F.min("_rank").alias("_rank")).join(asked, "_key", "left_semi")
    sets = texts.join(ones, ["_key", "_rank"], "left_semi").dropDuplicates(["_key"]).select("_key", "text").mapInArrow(shingled, "_key binary, shingles binary")
    sets = written(sets, "view-sets")

    heads = members.select("root", "head").distinct()
    edges = written(_verified(members.where("_key <> head").select("_key", "head").distinct(), sets), "view-links")
    before = None
    while True:
        parts = components(edges).select(F.col("node").alias("_key"), F.col("root").alias("part"))
        now = members.select("root", "_key").join(parts, "_key", "left").select("root", "_key", F.coalesce("part", "_key").alias("part"))
        mixed = now.groupBy("root").agg(F.min("part").alias("a"), F.max("part").alias("b")).where("a < b").select("root")
        now = written(now.join(mixed, "root"), "view-open")
        if now.isEmpty():
            return parts.withColumnRenamed("part", "_root")
        size = now.groupBy("root", "part").agg(F.count("*").cast("double").alias("n")).groupBy("root").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own")).where(F.col("n") > GROUP)
        texts_left, left = size.agg(F.coalesce(F.sum("n"), F.lit(0.0)), F.coalesce(F.sum((F.col("n") * F.col("n") - F.col("own")) / 2), F.lit(0.0))).first()
        if left <= PAIRS * texts_left or before is not None and left > 0.9 * before:
            break
        before = left
        # the next heads: texts that weren't heads of the group yet, those with a link first
        fresh = now.join(heads.withColumnRenamed("head", "_key"), ["root", "_key"], "left_anti")
        fresh = fresh.join(parts.select("_key", F.lit(1).alias("linked")), "_key", "left")
        order = Window.partitionBy("root").orderBy(F.col("linked").desc_nulls_last(), F.xxhash64("_key"), "_key")
        fresh = written(fresh.withColumn("at", F.row_number().over(order)).where(F.col("at") <= HEADS).select("root", F.col("_key").alias("head"), F.col("part").alias("other")), "view-heads")
        heads = heads.union(fresh.select("root", "head"))
        pairs = now.join(fresh, "root").where("part <> other").select("_key", "head").distinct()
        edges = edges.union(written(_verified(pairs, sets), "view-links"))
    large = now.groupBy("root").count().where(F.col("count") > GROUP).select("root")
    small = now.join(large, "root", "left_anti").join(sets, "_key").select("root", "_key", "part", "shingles")
    edges = edges.union(small.repartition("root").sortWithinPartitions("root").mapInArrow(_group_links, "u binary, v binary"))
    if left:
        edges = edges.union(_verified(written(_prefix_pairs(now.join(large, "root"), sets), "view-pairs"), sets))
    return components(edges).select(F.col("node").alias("_key"), F.col("root").alias("_root"))


def _joined(keys: list[bytes], part: np.ndarray, sets: list[np.ndarray]) -> list[tuple[bytes, bytes]]:
    """Links that join the parts of a group which similar texts connect; every pair not joined by then is compared."""
    size = np.array([len(x) for x in sets])
    starts = np.cumsum(size) - size
    distinct, flat = np.unique(np.concatenate(sets), return_inverse=True)
    mark = np.zeros(len(distinct), np.int64)
    fresh, out, todo = np.ones(len(sets), bool), [], list(range(len(sets)))
    while todo:
        h = todo.pop()
        if not fresh[h]:
            continue
        fresh[h] = False
        near = fresh & (part != part[h]) & (SIMILAR * np.maximum(size, size[h]) <= np.minimum(size, size[h]))
        if not near.any():
            continue
        own = flat[starts[h] : starts[h] + size[h]]
        mark[own] = 1
        common = np.add.reduceat(mark[flat], starts)
        mark[own] = 0
        for j in np.flatnonzero(near & (common >= SIMILAR * (size + size[h] - common))).tolist():
            todo.append(j)  # a linked text is the next to be compared
            if part[j] != part[h]:
                out.append((keys[h], keys[j]))
                part[part == part[j]] = part[h]
    return out


def _group_links(batches):
    """Links of whole groups; rows (root, _key, part, shingles) come sorted by root."""

    def links_of(t: pa.Table):
        root = t.column(0).to_numpy()
        cuts = [0, *(np.flatnonzero(root[1:] != root[:-1]) + 1).tolist(), len(root)]
        keys, sets = t.column(1).to_pylist(), t.column(3).to_pylist()
        part = np.unique(np.array(t.column(2).to_pylist(), "S16"), return_inverse=True)[1]
        out = [e for a, b in zip(cuts, cuts[1:], strict=False) for e in _joined(keys[a:b], part[a:b], [np.frombuffer(x, np.uint64) for x in sets[a:b]])]
        return _edges(out)

    held: list[pa.RecordBatch] = []
    for b in batches:
        root = b.column(0).to_numpy()
        if not len(root):
            continue
        last = int(np.searchsorted(root, root[-1]))  # the last group may go on
        if held and (last or held[-1].column(0)[0].as_py() != root[0]):
            first = int(np.searchsorted(root, held[-1].column(0)[0].as_py(), side="right"))
            yield links_of(pa.Table.from_batches([*held, b.slice(0, first)]))
            held = []
            if last > first:
                yield links_of(pa.Table.from_batches([b.slice(first, last - first)]))
            last = max(last, first)
        elif not held and last:
            yield links_of(pa.Table.from_batches([b.slice(0, last)]))
        held.append(b.slice(last))
    if held:
        yield links_of(pa.Table.from_batches(held))


def _edges(pairs: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in pairs], pa.binary()) for k in (0, 1)], ["u", "v"])


def _prefix_pairs(members: DataFrame, sets: DataFrame) -> DataFrame:
    """_key and head: all pairs of a group (root, _key, part) that could be similar, but those of one part.

    With a group's shingles ordered rarest first, two sets of similarity SIMILAR share one among the first
    s - SIMILAR * s + 1 of each, s being a set's size.  Texts of a shingle that many share are dealt out by salt.
    """

    def each(batches):
        for b in batches:
            for lo in range(0, b.num_rows, 64):
                part = b.slice(lo, 64)
                own = [np.frombuffer(v.as_buffer(), np.int64) for v in part.column(3)]
                n = np.array([len(x) for x in own])
                rows = [part.column(k).take(pa.array(np.repeat(np.arange(len(n)), n))) for k in range(3)]
                yield pa.RecordBatch.from_arrays([*rows, pa.array(np.repeat(n, n)), pa.array(np.concatenate(own))], ["root", "_key", "part", "size", "shingle"])

    entries = members.join(sets, "_key").select("root", "_key", "part", "shingles").mapInArrow(each, "root long, _key binary, part binary, size long, shingle long")
    entries = written(entries, "view-shingles")
    often = entries.groupBy("root", "shingle").agg(F.count("*").alias("n"))
    order = Window.partitionBy("root", "_key").orderBy("n", "shingle")
    first = entries.join(often, ["root", "shingle"]).withColumn("at", F.row_number().over(order))
    first = first.where(F.col("at") <= F.col("size") - F.ceil(SIMILAR * F.col("size") - 1e-6) + 1).where("n > 1")
    first = written(first.withColumn("salts", F.ceil(F.col("n") / SALT).cast("int")), "view-prefixes")
    a = first.withColumn("salt", F.pmod(F.xxhash64("_key"), F.col("salts")).cast("int"))
    b = first.select("root", "shingle", F.col("_key").alias("head"), F.col("part").alias("other"), F.col("size").alias("of_head"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
    near = F.least("size", "of_head") >= SIMILAR * F.greatest("size", "of_head") - 1e-6
    return a.join(b, ["root", "shingle", "salt"]).where("_key < head and part <> other").where(near).select("_key", "head").distinct()


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """u and v of the pairs (_key, head) whose shingle sets are similar."""
    both = pairs.join(sets, "_key").join(sets.select(F.col("_key").alias("head"), F.col("shingles").alias("of_head")), "head")

    def verified(batches):
        for b in batches:
            ok = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                common = 0
                if SIMILAR * max(len(x), len(y)) <= min(len(x), len(y)):
                    at = np.minimum(np.searchsorted(y, x), len(y) - 1)
                    common = int((y[at] == x).sum())
                ok.append(common >= SIMILAR * (len(x) + len(y) - common))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep)], ["u", "v"])

    return both.select("_key", "head", "shingles", "of_head").mapInArrow(verified, "u binary, v binary")


def one_of_each(documents: DataFrame) -> DataFrame:
    """The documents without copies and near copies: of each group the row with the smallest doc_id stays (null ids last), once."""
    key, least = spare(documents, "_key", "_least")
    docs = documents.withColumns({key: _text_key(), least: F.coalesce(F.col("doc_id").cast("long"), F.lit(LAST))})
    ids = docs.groupBy(F.col(key).alias("_key")).agg(F.min(least).alias("least"))
    ids = ids.join(similar(documents), "_key", "left").select("_key", F.coalesce("_root", "_key").alias("_root"), "least")
    first = ids.groupBy("_root").agg(F.min(F.struct("least", "_key")).alias("first")).select(F.col("first._key").alias(key), F.col("first.least").alias(least))
    kept = docs.join(written(first, "kept"), [key, least])
    if docs.groupBy(key, least).count().where("count > 1").limit(1).count():
        kept = kept.dropDuplicates([key, least])
    return kept.select(*documents.columns)
