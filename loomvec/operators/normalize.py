"""Two-step normalisation around the channel mean, and post-quantization scaling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E


def channel_mean(df: DataFrame, column: str) -> list[float]:
    """Mean of each channel over the table: the one shuffle of this module, d rows."""
    rows = df.select(F.posexplode(column).alias("ch", "x")).groupBy("ch").agg(F.avg("x").alias("m")).orderBy("ch").collect()
    return [r["m"] for r in rows]


def nsn(df: DataFrame, column: str = "vec", already_unit: bool = False, mean: list[float] | None = None) -> tuple[DataFrame, list[float]]:
    """(df with norm1, norm2 and normalized, the channel mean): rows to unit norm, less the mean over all rows, to unit norm again."""
    first = F.lit(1.0) if already_unit else E.norm(F.col(column))
    t = df.withColumn("norm1", first)
    t = t.withColumn("_unit", F.col(column) if already_unit else E.divide(F.col(column), F.col("norm1") + F.lit(1e-8)))
    mean = channel_mean(t, "_unit") if mean is None else mean
    t = t.withColumn("_unit", E.minus(F.col("_unit"), E.literal(mean)))
    t = t.withColumn("norm2", E.norm(F.col("_unit")))
    return t.withColumn("normalized", E.divide(F.col("_unit"), F.col("norm2") + F.lit(1e-8))).drop("_unit"), mean


def nsn_restore(v: Column, mean: list[float], norm1: Column, norm2: Column) -> Column:
    """What nsn() took away, put back."""
    return E.scale(E.plus(E.scale(v, norm2), E.literal(mean)), norm1)


def adaptive_scale(v: Column, restored: Column, eps: float = 1e-8) -> Column:
    """restored times |v|^2 / (v . restored + eps)."""
    return E.scale(restored, E.dot(v, v) / (E.dot(v, restored) + F.lit(eps)))


SINK, RECENT = 4, 128


def quantizes(pos: Column, length: Column, sink: int = SINK, recent: int = RECENT) -> Column:
    """Whether a position is stored quantized: not among the first, nor, in a longer sequence, the most recent."""
    return (pos >= sink) & ~((length > recent) & (pos >= length - recent))
