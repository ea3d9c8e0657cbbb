"""Quantizers of vectors: scalar, lattice, codebook, per channel, per row and by groups.

State that some libraries fit on the first batch they see is an explicit model here: fit(df) makes
it, transform(df) uses it, so that results don't depend on how rows are dealt out.
"""

from __future__ import annotations

import math
import re
import warnings
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expr as E
from . import codebooks as C
from .rotations import apart


# Scalar


@dataclass(frozen=True)
class Scalar:
    """Lloyd-Max on every coordinate: the index is the number of boundaries below it."""

    d: int
    bits: int
    exact: bool = False

    @property
    def tables(self) -> tuple[tuple[float, ...], tuple[float, ...]]:
        return C.lloyd_max(self.d, self.bits, self.exact)

    def bits_per_dimension(self) -> float:
        return float(self.bits)

    def fit(self, df: DataFrame, column: str = "vec") -> Scalar:
        return self

    def quantize(self, v: Column) -> Column:
        return F.transform(v, lambda x: E.boundary_count(x, self.tables[1]).cast("tinyint"))

    def dequantize(self, idx: Column) -> Column:
        return E.look_up(idx, self.tables[0])

    def round_trip(self, v: Column) -> Column:
        return self.dequantize(self.quantize(v))


@dataclass(frozen=True)
class Affine:
    """Uniform codes by a given scale and zero point: the nearest whole multiple (of halves the even one) plus the zero point, in 0..2**bits - 1."""

    scale: float
    zero_point: int = 0
    bits: int = 8

    def bits_per_dimension(self) -> float:
        return float(self.bits)

    def fit(self, df: DataFrame, column: str = "vec") -> Affine:
        return self

    def quantize(self, v: Column) -> Column:
        most = F.lit(float(2**self.bits - 1))
        return F.transform(v, lambda x: F.greatest(F.lit(0.0), F.least(most, F.rint(x / F.lit(self.scale)) + F.lit(float(self.zero_point)))).cast("int"))

    def dequantize(self, idx: Column) -> Column:
        return F.transform(idx, lambda i: (i - self.zero_point) * F.lit(self.scale))

    def round_trip(self, v: Column) -> Column:
        return self.dequantize(self.quantize(v))


# Blocks of eight


def _rounder(step) -> Column:
    """An Arrow function that sends each block of eight through step (NumPy)."""

    @F.pandas_udf("array<double>")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return v
        x = np.stack(v.to_numpy())
        return pd.Series(list(step(x.reshape(-1, 8)).reshape(x.shape)))

    return apart(run)


def table_rms(df: DataFrame, column: str) -> float:
    """Root mean square over all elements of a vector column."""
    r = df.agg(F.sum(E.dot(F.col(column), F.col(column))).alias("s"), F.sum(F.size(column)).alias("n")).first()
    return math.sqrt(r["s"] / r["n"]) if r["n"] else 0.0


@dataclass(frozen=True)
class E8:
    """Nearest points of the E8 lattice, scaled. The nominal rate is that of the first shell; decoding uses the whole lattice."""

    scale: float | None = None
    method: str = "mse_optimal"
    mode: str = "nearest"

    def bits_per_dimension(self) -> float:
        return C.e8_bits_per_dimension(1)

    def fit(self, df: DataFrame, column: str = "vec") -> E8:
        r = table_rms(df, column)
        if r < 1e-10:
            return E8(1.0, self.method, self.mode)
        if self.method == "heuristic":
            return E8(2 * r, self.method, self.mode)
        if self.method == "grid_search":
            found = scale_errors(df, column, r, self.mode).orderBy("mse", "step").first()
            return E8(found["scale"], self.method, self.mode)
        return E8(4 * r, self.method, self.mode)

    def round_trip(self, v: Column) -> Column:
        if self.scale is None:
            raise ValueError("fit() sets the scale")
        s, mode = self.scale, self.mode
        return _rounder(lambda x: C.e8_nearest(x / (s + 1e-8), mode) * s)(v)


def scale_errors(df: DataFrame, column: str, rms: float, mode: str = "nearest") -> DataFrame:
    """(step, scale, mse) for the candidate scales, one pass over the table."""

    def run(frames):
        total, n = np.zeros(len(C.SCALE_STEPS)), 0
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy()).reshape(-1, 8)
                n += x.size
                for i, k in enumerate(C.SCALE_STEPS):
                    total[i] += ((C.e8_nearest(x / (rms * k), mode) * (rms * k) - x) ** 2).sum()
        yield pd.DataFrame({"step": range(len(total)), "e": total, "n": n})

    parts = df.select(F.col(column).alias("v")).mapInPandas(run, "step int, e double, n long")
    return parts.groupBy("step").agg((F.sum("e") / F.sum("n")).alias("mse")).withColumn("scale", E.literal([rms * k for k in C.SCALE_STEPS])[F.col("step")])


@dataclass(frozen=True)
class Codebook:
    """Nearest codeword of each scaled block of eight. kind: prefix (a level's name), kmeans (a number of codewords, trained on
    unit normal points) or data (a name; its codewords are `given`, see trained_codebook())."""

    kind: str
    size: str
    scale: float | None = None
    given: tuple[tuple[float, ...], ...] | None = None

    @property
    def codes(self) -> np.ndarray:
        if self.given is not None:
            return np.array(self.given)
        return C.prefix_codebook(self.size) if self.kind == "prefix" else C.kmeans_codebook(int(self.size))

    def bits_per_dimension(self) -> float:
        return math.log2(len(self.codes)) / 8

    def fit(self, df: DataFrame, column: str = "vec") -> Codebook:
        r = table_rms(df, column)
        if self.given is not None:
            return Codebook(self.kind, self.size, r / (C.rms(self.codes) + 1e-8), self.given)
        return Codebook(self.kind, self.size, r / (C.rms(self.codes) + 1e-8) if self.kind == "prefix" else r)

    def quantize(self, v: Column) -> Column:
        codes, scale = self.codes, self._scale()

        @F.pandas_udf("array<int>")
        def run(x: pd.Series) -> pd.Series:
            if not len(x):
                return x
            m = np.stack(x.to_numpy())
            return pd.Series(list(C.nearest_code(m.reshape(-1, 8) / (scale + 1e-8), codes).reshape(len(m), -1).astype(np.int32)))

        return apart(run)(v)

    def dequantize(self, idx: Column) -> Column:
        codes, scale = self.codes, self._scale()

        @F.pandas_udf("array<double>")
        def run(i: pd.Series) -> pd.Series:
            return pd.Series(list((codes[np.stack(i.to_numpy())] * scale).reshape(len(i), -1))) if len(i) else i

        return apart(run)(idx)

    def round_trip(self, v: Column) -> Column:
        codes, scale = self.codes, self._scale()
        return _rounder(lambda x: codes[C.nearest_code(x / (scale + 1e-8), codes)] * scale)(v)

    def _scale(self) -> float:
        if self.scale is None:
            raise ValueError("fit() sets the scale")
        return self.scale


def trained_codebook(df: DataFrame, k: int, column: str = "vec", seed: int = 42, name: str = "data") -> Codebook:
    """A codebook of k codewords trained on the blocks of eight of a table; its scale is 1, for the codewords are in the table's own units."""
    from .clustering import train

    return Codebook("data", name, 1.0, tuple(map(tuple, train(df, k, column, seed=seed)[0])))


def make(which, d: int, bits: int):
    """By name: scalar (None), e8, z8_<level>, kmeans_<codewords>; a quantizer is returned as it is."""
    if which is None or which == "scalar":
        return Scalar(d, bits)
    if not isinstance(which, str):
        return which
    if which == "e8":
        if bits > 1:
            warnings.warn(f"e8 has a rate of its own, about one bit; bits={bits} is ignored", stacklevel=2)
        return E8()
    if m := re.fullmatch(r"z8(?:_(\w+))?", which):
        level = m[1] or "256"
        if level not in C.LEVELS:
            raise ValueError(f"unknown level {level!r}; levels are {', '.join(C.LEVELS)}")
        return Codebook("prefix", level)
    if m := re.fullmatch(r"kmeans_(\d+)", which):
        return Codebook("kmeans", m[1])
    raise ValueError(f"unknown quantizer {which!r}; known are scalar, e8, z8_<level> and kmeans_<codewords>")


# Per channel and per row


def channel_ranges(df: DataFrame, column: str, bits: int) -> DataFrame:
    """(ch, lo, hi, scale): the range of each channel over all rows; partial minima and maxima before the shuffle."""
    flat = df.select(F.posexplode(column).alias("ch", "x")).groupBy("ch").agg(F.min("x").alias("lo"), F.max("x").alias("hi"))
    return flat.withColumn("scale", F.greatest((F.col("hi") - F.col("lo")) / F.lit(float(2**bits - 1)), F.lit(1e-8)))


def channels_as_arrays(ranges: DataFrame) -> DataFrame:
    """One row: arrays lo and scale by channel."""
    return ranges.agg(F.array_sort(F.collect_list(F.struct("ch", "lo", "scale"))).alias("c")).select(F.transform("c", lambda x: x["lo"]).alias("lo"), F.transform("c", lambda x: x["scale"]).alias("scale"))


def quantize_channels(df: DataFrame, column: str, bits: int) -> DataFrame:
    """df with idx and restored: every channel in 2**bits even steps of its range over the table (d rows of statistics)."""
    t = df.crossJoin(F.broadcast(channels_as_arrays(channel_ranges(df, column, bits))))
    most = F.lit(float(2**bits - 1))
    idx = F.zip_with(F.zip_with(F.col(column), F.col("lo"), lambda x, m: x - m), F.col("scale"), lambda x, s: F.least(F.greatest(F.rint(x / s), F.lit(0.0)), most).cast("smallint"))
    t = t.withColumn("idx", idx)
    return t.withColumn("restored", F.zip_with(F.zip_with(F.col("idx"), F.col("scale"), lambda i, s: i * s), F.col("lo"), lambda x, m: x + m)).drop("lo", "scale")


def row_scale(v: Column, bits: int) -> Column:
    return F.greatest((F.array_max(v) - F.array_min(v)) / F.lit(float(2**bits - 1)), F.lit(1e-8))


def quantize_row(v: Column, bits: int) -> Column:
    """struct<idx, scale, zero>: a vector in even steps of its own range."""
    most = F.lit(float(2**bits - 1))
    return E.let(
        F.struct(v.alias("v"), row_scale(v, bits).alias("scale"), F.array_min(v).alias("zero")),
        lambda s: F.struct(F.transform(s["v"], lambda x: F.least(F.greatest(F.rint((x - s["zero"]) / s["scale"]), F.lit(0.0)), most).cast("smallint")).alias("idx"), s["scale"].alias("scale"), s["zero"].alias("zero")),
    )


def restore_row(q: Column) -> Column:
    return F.transform(q["idx"], lambda i: i * q["scale"] + q["zero"])


# Groups


def group_params(v: Column, d: int, group: int = 128, bits: int = 4, threshold: float = 0.1) -> Column:
    """array<struct<scale, zero, symmetric>> of consecutive groups; the last may be shorter.

    A group whose middle is within threshold of its range around zero is symmetric, else it starts at
    its minimum."""
    steps = F.lit(float(2**bits - 1))
    out = []
    for lo in range(0, d, group):
        part = F.slice(v, lo + 1, min(group, d - lo))
        low, high = F.array_min(part), F.array_max(part)
        symmetric = F.abs((low + high) / 2) < F.lit(threshold) * F.greatest(high - low, F.lit(1e-8))
        scale = F.when(symmetric, F.greatest(2.0 * F.greatest(F.abs(low), F.abs(high)) / steps, F.lit(1e-8))).otherwise(F.greatest((high - low) / steps, F.lit(1e-8)))
        out.append(F.struct(scale.alias("scale"), F.when(symmetric, F.lit(0.0)).otherwise(low).alias("zero"), symmetric.alias("symmetric")))
    return F.array(*out)


def group_quantize(v: Column, params: Column, group: int, bits: int) -> Column:
    most = float(2**bits - 1)

    def one(x: Column, i: Column) -> Column:
        p = F.get(params, F.floor(i / group).cast("int"))
        y = F.when(p["symmetric"], x / p["scale"] + F.lit(most / 2)).otherwise((x - p["zero"]) / p["scale"])
        return F.least(F.greatest(F.rint(y), F.lit(0.0)), F.lit(most)).cast("smallint")

    return F.transform(v, one)


def group_dequantize(idx: Column, params: Column, group: int, bits: int) -> Column:
    half = float(2**bits - 1) / 2

    def one(x: Column, i: Column) -> Column:
        p = F.get(params, F.floor(i / group).cast("int"))
        return F.when(p["symmetric"], (x - F.lit(half)) * p["scale"]).otherwise(x * p["scale"] + p["zero"])

    return F.transform(idx, one)
