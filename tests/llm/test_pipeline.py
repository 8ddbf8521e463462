import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from basaltql.llm import simhash_vptree

SF = "/root/testdata/sf0.001"


def test_stages_are_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "decontamination", "pii", "mixing"]


def test_run(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF)
    assert out.columns == [*docs.columns, "probability"]
    assert 0 < out.count() < docs.count()
    assert out.join(docs.select("doc_id"), "doc_id", "left_anti").count() == 0


def test_stages_keep_columns_and_hard_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("_key", F.lit(1)).withColumn("n_found", F.lit(2))
    docs = docs.union(spark.createDataFrame([(None, None, None, None, None, 1, 2), (10**9, "", None, None, None, 1, 2)], docs.schema)).union(docs.limit(3))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns, name
        assert out.count() > 0
    none = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, SF).count() == 0


def test_near_copies_against_brute_force(spark):
    """Similarity 0.8 of five-word shingles; a large group of near copies and a passage that many texts share."""
    rnd = random.Random(8)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    passage = [word() for _ in range(40)]
    texts = [[word() for _ in range(rnd.randint(1, 120))] for _ in range(40)]
    base = [word() for _ in range(100)]
    for _ in range(40):
        t = list(base)
        t[rnd.randrange(100)] = word()
        texts.append(t)
    texts += [[word() for _ in range(30)] + passage + [word() for _ in range(30)] for _ in range(40)]
    texts += [texts[3], texts[4][:], []]
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash_vptree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(simhash_vptree.shingle_hashes(t.encode()).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            common = len(sets[a] & sets[b])
            if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                x, y = group[a], group[b]
                group = [min(x, y) if g in (x, y) else g for g in group]
    assert kept == set(group)


@pytest.mark.parametrize("group, pairs", [(2000, 64), (10, 10**9), (10, 0)])
def test_star_families_against_brute_force(spark, monkeypatch, group, pairs):
    """Originals whose copies are similar to them and not to each other: in one task, by prefixes, by rounds of heads first."""
    monkeypatch.setattr(simhash_vptree, "GROUP", group)
    monkeypatch.setattr(simhash_vptree, "PAIRS", pairs)
    monkeypatch.setattr(simhash_vptree, "SALT", 50)
    rnd = random.Random(12)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(4))
    texts = []
    for copies in (300, 50, 10):
        base = [word() for _ in range(200)]
        texts.append(base)
        for _ in range(copies):
            t = list(base)
            for k in rnd.sample(range(200), 3):
                t[k] = word()
            texts.append(t)
    rnd.shuffle(texts)
    rows = [(i, " ".join(t)) for i, t in enumerate(texts)]
    kept = {r.doc_id for r in simhash_vptree.one_of_each(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = [set(simhash_vptree.shingle_hashes(t.encode()).tolist()) for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if group[a] != group[b]:
                common = len(sets[a] & sets[b])
                if common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                    x, y = group[a], group[b]
                    group = [min(x, y) if g in (x, y) else g for g in group]
    assert kept == set(group) and len(kept) < 20


def test_groups_that_cross_batches_are_whole():
    """Rows of a group may come in several batches; what is found must not depend on where they are cut."""
    import numpy as np
    import pyarrow as pa

    rnd = np.random.RandomState(5)
    base = np.arange(100, dtype=np.uint64)
    key = lambda k: k.to_bytes(16, "big")
    rows = [(g, key(100 * g + i), key(100 * g + i), np.sort(np.where(rnd.rand(100) < 0.04, base + np.uint64(1000 * (i + 1)), base)).tobytes()) for g, n in enumerate((1, 2, 9, 3, 1, 20, 2)) for i in range(n)]
    names = ["root", "_key", "part", "shingles"]
    cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int64(), pa.binary(), pa.binary(), pa.binary()), strict=True)]
    whole = pa.RecordBatch.from_arrays(cols, names)
    edges = lambda batches: sorted(e for out in simhash_vptree._group_links(batches) for e in zip(out.column(0).to_pylist(), out.column(1).to_pylist(), strict=True))
    want = edges([whole])
    assert len(want) > 20
    for step in (1, 2, 3, 5, 7, 13):
        assert edges([whole.slice(lo, step) for lo in range(0, len(rows), step)]) == want


def test_repeated_rows_leave_one(spark):
    df = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, "a b"), (None, "c"), (None, "c")], "doc_id long, text string")
    got = Counter((r.doc_id, r.text) for r in simhash_vptree.one_of_each(df).collect())
    assert got == {(1, "a b"): 1, (None, "c"): 1}


@pytest.mark.parametrize("name", ["pipeline"])
def test_registered(name):
    import __spark_entry__

    assert name in __spark_entry__.queries()
