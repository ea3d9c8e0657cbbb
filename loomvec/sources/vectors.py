"""Sources of vectors and key/value tables, generators for tests, and sinks."""

from __future__ import annotations

import json

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr as E
from ..operators.sequences import numbered


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, vec array<double>) of the embeddings table; only these columns are read."""
    t = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return t.select("vec_id", "label", E.doubles(F.col("embedding")).alias("vec"))


def keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(b, h, s, k_id, vec): vectors as a key table, a head a label, positions in the order of ids, numbered by ranges of ids."""
    t = numbered(vectors(spark, sf_dir), "vec_id", ("label",), "s")
    return t.select(F.lit(0).alias("b"), F.col("label").alias("h"), F.col("s").cast("int").alias("s"), F.col("vec_id").alias("k_id"), "vec")


def from_arrays(spark: SparkSession, x: np.ndarray, names: tuple[str, ...] = ("b", "h", "s")) -> DataFrame:
    """A dense array, last axis the vector, as a table with one index column for each other axis."""
    rows = [(*map(int, i), x[i].tolist()) for i in np.ndindex(x.shape[:-1])]
    return spark.createDataFrame(rows, ", ".join(f"{n} int" for n in names[-(x.ndim - 1) :]) + ", vec array<double>")


def layered(*layers: DataFrame) -> DataFrame:
    """Key tables of several layers as one, with a layer column."""
    out = None
    for i, t in enumerate(layers):
        t = t.withColumn("layer", F.lit(i))
        out = t if out is None else out.unionByName(t)
    return out


def gaussian(spark: SparkSession, n: int, d: int, seed: int = 42, unit: bool = True) -> DataFrame:
    """(vec_id, vec) of normal entries, made where they are needed. A row depends on the seed, its number and the partition count only."""
    t = spark.range(n).select(F.col("id").alias("vec_id"), F.array(*[F.randn(seed + 7919 * i) for i in range(d)]).alias("vec"))
    return t.withColumn("vec", E.unit(F.col("vec"))) if unit else t


def with_outliers(df: DataFrame, factors: dict[int, float], column: str = "vec") -> DataFrame:
    """df with some channels of the vector multiplied."""
    scale = F.lit(1.0)
    i_scale = lambda i: _chosen(i, factors, scale)
    return df.withColumn(column, F.transform(column, lambda x, i: x * i_scale(i)))


def _chosen(i, factors: dict[int, float], default):
    out = default
    for ch, f in factors.items():
        out = F.when(i == ch, F.lit(float(f))).otherwise(out)
    return out


def needle(df: DataFrame, at: int, key: str = "vec_id", column: str = "vec") -> list[float]:
    """The vector of one row, to be looked for."""
    row = df.where(F.col(key) == at).select(column).first()
    if row is None:
        raise ValueError(f"no row with {key} = {at}")
    return list(row[0])


def append(df: DataFrame, path: str, chunk_id: int | None = None) -> None:
    """Adds a chunk to a table of compressed vectors."""
    (df if chunk_id is None else df.withColumn("chunk_id", F.lit(chunk_id))).write.mode("append").parquet(path)


def save_constants(spark: SparkSession, path: str, **constants) -> None:
    """Constants of a model (matrices, codebooks, means) as one JSON row for each name, written by Spark to any store."""
    rows = [(k, json.dumps(np.asarray(v).tolist() if isinstance(v, np.ndarray | tuple) else v)) for k, v in constants.items()]
    spark.createDataFrame(rows, "name string, value string").coalesce(1).write.mode("overwrite").json(path)


def load_constants(spark: SparkSession, path: str) -> dict:
    return {r["name"]: json.loads(r["value"]) for r in spark.read.schema("name string, value string").json(path).collect()}
