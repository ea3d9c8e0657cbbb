"""Helpers that several operators share: tables in the shared folder, Arrow text buffers, columns by name."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word of the contracts: a run of characters other than space and the five ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, one process has to hold all executors (local mode): a new folder of this machine then, an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="loomvec-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it again.

    The plan that made it runs once, and a lost executor costs a reread, not a rerun.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/loomvec-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomvec_path = path
    return out


def drop_cut(df: DataFrame) -> None:
    """Deletes a table that cut() made; the caller knows that no later plan reads it."""
    path = getattr(df, "_loomvec_path", None)
    if path:
        jvm = df.sparkSession._jvm
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(at, True)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the input. A small one that would be read in fewer tasks than there are cores is dealt out to all of them."""
    t = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    cores = spark.sparkContext.defaultParallelism
    return t.repartition(cores) if name == "documents" and t._jdf.queryExecution().toRdd().getNumPartitions() < cores else t


def narrow(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named inputs, under private names: other columns of df can't clash."""
    return df.select(*[(F.col(c) if isinstance(c, str) else c).alias(k) for k, c in columns.items()])


def private(names: list[str], name: str) -> str:
    """A column name that no column of a table has: longer than all of its names together."""
    return "_".join([*names, name])


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def lower_ascii(text: Column) -> Column:
    """A-Z only; lower() would also change other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def byte_spans(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string or binary column, without a Python object a row; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, at, data = column.buffers()
    if not len(column) or at is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(at, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    raw = raw[offsets[0] : offsets[-1]]
    return raw, offsets - offsets[0]


def pieces(offsets: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Ranges of rows of at most `most` bytes each (one row at least), so that a batch of long texts is worked on in parts."""
    out, lo, n = [], 0, len(offsets) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, side="right")) - 1)
        out.append((lo, min(hi, n)))
        lo = min(hi, n)
    return out
