"""Helpers shared by the training-data operators: table access, materialisation, bounded heads."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of every contract in this package: a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Used only on one machine, where the session names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "/tmp/checkpoints"
#: Leading binary digits of a count that are kept when a threshold on counts is chosen.
COUNT_DIGITS = 12
#: Spark's setting under which an execution's shuffle files go as soon as it has ended.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder; on one machine a local one where none is named."""
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if path:
        return path.rstrip("/")
    master = spark.sparkContext.master
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return LOCAL_CHECKPOINTS


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back, which cuts its lineage.

    The table survives lost executors. It goes by `discard`, at the latest when the driver's file system closes. Nothing reads
    the shuffle files of the write again, so they go at its end."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(_CLEAN)
        else:
            spark.conf.set(_CLEAN, before)
    hadoop, system = _hadoop(spark, path)
    system.deleteOnExit(hadoop)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def _hadoop(spark: SparkSession, path: str):
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return hadoop, hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def discard(*tables: DataFrame) -> None:
    """Delete tables that `materialize` gave and that nothing reads any more."""
    for df in tables:
        hadoop, system = _hadoop(df.sparkSession, df._scratch)
        system.delete(hadoop, True)
        system.cancelDeleteOnExit(hadoop)


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """A number that names a row's document: its id, or for a null id a hash of its text."""
    return F.coalesce(F.col(doc_id).cast("long"), F.xxhash64(F.col(text)))


def threshold_for(df: DataFrame, count: str, bound: int) -> int:
    """A t for which at most bound rows of df have count >= t: the least one up to 2^COUNT_DIGITS, about the least beyond.

    Counts are rounded down to COUNT_DIGITS binary digits, so only a histogram of bounded size reaches the driver."""
    spare = F.greatest(F.length(F.bin(F.col(count))) - COUNT_DIGITS, F.lit(0))
    low = F.expr(f"shiftleft(shiftright(`{count}`, _spare), _spare)")
    rows = df.withColumn("_spare", spare).groupBy(low.alias("c")).agg(F.count(F.lit(1)).alias("n")).collect()
    total, least = 0, max((r["c"] for r in rows), default=0) * 2 + 1
    for c, n in sorted(((r["c"], r["n"]) for r in rows), reverse=True):
        if total + n > bound:
            break
        total, least = total + n, c
    return int(least)


def crc_mod(doc_id: str, n: int) -> Column:
    """crc32 of the id written as text, modulo n; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % n


def slices(offsets, most_bytes: int = 4 << 20) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose texts hold about most_bytes together; a longer text stands alone."""
    n, start = len(offsets) - 1, 0
    while start < n:
        end = start + 1
        while end < n and offsets[end + 1] - offsets[start] <= most_bytes:
            end += 1
        yield start, end
        start = end


def pack(values: np.ndarray) -> bytes:
    """Numbers as planes of bytes, compressed."""
    planes = np.ascontiguousarray(values.view(np.uint8).reshape(len(values), values.itemsize).T)
    return pa.compress(planes.tobytes(), codec="zstd", asbytes=True)


def unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    width = np.dtype(kind).itemsize
    planes = np.frombuffer(pa.decompress(data, n * width, codec="zstd", asbytes=True), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(kind).ravel()
