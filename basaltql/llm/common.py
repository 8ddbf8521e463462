"""Shared pieces of the training-data operators: table access, cutting lineage, byte buffers."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs of anything but ASCII white space.
WORD_RE = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input folder, read by Spark only (the folder may be in any store)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, as the session names it; a local one only on a local master where none is set (tests)."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        where = os.path.join(tempfile.gettempdir(), "basaltql-checkpoints")
        spark.conf.set("spark.checkpoint.dir", where)
    return where


def cut(df: DataFrame) -> DataFrame:
    """df with its lineage cut by a reliable checkpoint in the shared folder."""
    spark = df.sparkSession
    shared_dir(spark)
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint(eager=True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder, for results that are read more than once."""
    where = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(where)
    return df.sparkSession.read.parquet(where)


def text_bytes(docs: DataFrame) -> int:
    """Bytes of all texts: sizes the shards of an operator, so that a shard stays bounded at any input."""
    return int(docs.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0)


def spare(df: DataFrame, *names: str) -> list[str]:
    """Names like the given ones that df has no column of."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def crc_mod(doc_id, n: int):
    """crc32(doc_id as text) mod n as a column; a null doc_id counts as the empty string."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % n


def binary_buffers(array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, bytes) of an Arrow binary array without nulls; offsets start at 0."""
    large = str(array.type).startswith("large")
    _, off, data = array.buffers()
    offsets = np.frombuffer(off, dtype=np.int64 if large else np.int32)[array.offset : array.offset + len(array) + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    return offsets - offsets[0], raw[offsets[0] : offsets[-1]]


def dropped(df: DataFrame) -> None:
    """Deletes the files of a table that `written` wrote and no plan reads any more."""
    jvm, conf = df.sparkSession._jvm, df.sparkSession._jsc.hadoopConfiguration()
    for where in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        path = jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(conf).delete(path, True)


def released(spark: SparkSession) -> None:
    """Lets Spark's cleaner delete the shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark._jvm.System.gc()


def bucketed(df: DataFrame, key: str, buckets: int):
    """df as a table in the shared folder, bucketed by a key, so that a cogroup by it doesn't move its rows; and a call that deletes it."""
    spark, name = df.sparkSession, f"bucketed_{uuid.uuid4().hex}"
    df.write.bucketBy(buckets, key).sortBy(key).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)

    def drop() -> None:
        dropped(table)
        spark.sql(f"DROP TABLE {name}")

    return table, drop
