"""What the operators share: word rule, shared folder, cut points, Arrow helpers, bounded broadcast."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word: a run of characters other than the six ASCII white-space characters.
WORD = r"[^\x20\x09-\x0D]+"
U64 = np.uint64


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir`` of the session.

    Only a local master may fall back on a temporary folder, as in tests; there driver and
    executors are one process.
    """
    at = spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tidemark-")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


_made: list[str] = []


def new_path(spark: SparkSession, name: str) -> str:
    _made.append(f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}")
    return _made[-1]


def clean(spark: SparkSession) -> int:
    """Deletes the tables and files that this process's operators left in the shared folder.  Results
    read from them must be written elsewhere first."""
    done = 0
    while _made:
        path = spark._jvm.org.apache.hadoop.fs.Path(_made.pop())
        done += path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
    return done


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: later plans start there, so a lost executor
    costs a reread and never the work before it."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def n_words(text) -> F.Column:
    """Words of a text column (null: 0), without an array of the words."""
    marks = F.regexp_replace(F.coalesce(text, F.lit("")), WORD, "x")
    return F.length(F.translate(marks, " \t\n\x0b\x0c\r", "")).cast("long")


def bounded_broadcast(df: DataFrame, rows: int, most: int) -> DataFrame:
    """df with a broadcast hint if its counted rows are at most ``most``, else without one: then
    Spark joins by a shuffle and splits skewed partitions."""
    return F.broadcast(df) if rows <= most else df


def text_slices(column: pa.Array, most_bytes: int):
    """(from, to) row ranges of a string array that hold about most_bytes each, a row at least."""
    n = len(column)
    if n == 0:
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    at = 0
    while at < n:
        to = int(np.searchsorted(offsets, offsets[at] + most_bytes, "right")) - 1
        to = min(max(to, at + 1), n)
        yield at, to
        at = to


def mixed(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: spreads integers over 64 bits."""
    x = x.astype(U64) + U64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string or binary array (nulls: empty) and the offsets of its rows in them."""
    column = column.fill_null(b"" if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type) else "")
    n = len(column)
    if n == 0 or column.buffers()[1] is None:
        return np.empty(0, np.uint8), np.zeros(n + 1, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    offsets = np.frombuffer(column.buffers()[1], np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    data = np.empty(0, np.uint8) if column.buffers()[2] is None else np.frombuffer(column.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    return data, offsets - offsets[0]


def open_fs(url: str):
    """(file system, path) of a URL, for files that executors write to the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(url)


def spread(manifest: DataFrame, most: int = 4096) -> DataFrame:
    """A manifest of files dealt out to as many tasks as it has files, at most ``most``."""
    return manifest.repartition(max(1, min(most, manifest.count())))
