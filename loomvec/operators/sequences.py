"""Operators along a sequence without one window for all of it: positions by ranges and offsets, neighbours by halos, transforms in steps.

A head's rows are dealt out over many tasks: ranges of the order column are numbered on their own and
moved by the number of rows before them; blocks of dense positions get the few rows of their neighbours
that a window reaches into.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Values of the order column to a range, positions to a block.
RANGE, BLOCK = 65_536, 16_384


def _same(t: DataFrame, group: tuple[str, ...], suffix: str) -> Column:
    out = F.lit(True)
    for c in group:
        out = out & F.col(c).eqNullSafe(F.col(f"{c}{suffix}"))
    return out


def numbered(df: DataFrame, order: str, group: tuple[str, ...] = (), out: str = "s", chunk: int = RANGE) -> DataFrame:
    """df with the position (from 0) of each row of a group in the order of an integer column; null orders come first, equal ones as they lie.

    Rows of a range of `chunk` values are numbered in one task; the table of offsets has a row a range.
    """
    t = df.withColumn("_range", F.floor(F.col(order) / chunk))
    sizes = t.groupBy(*group, "_range").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.partitionBy(*group).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = sizes.select(*[F.col(c).alias(f"{c}_") for c in group], F.col("_range").alias("_range_"), before.alias("_before")) if group else sizes.select(F.col("_range").alias("_range_"), before.alias("_before"))
    own = F.row_number().over(W.partitionBy(*group, "_range").orderBy(order)) - 1
    t = t.withColumn("_own", own).join(offsets, _same(t, group, "_") & F.col("_range").eqNullSafe(F.col("_range_")))
    return t.withColumn(out, (F.col("_own") + F.col("_before")).cast("long")).drop("_own", "_before", "_range", "_range_", *[f"{c}_" for c in group])


def in_halos(df: DataFrame, position: str, before: int, after: int, block: int = BLOCK) -> DataFrame:
    """df with _block and _halo: each block of dense positions, and as halos the last `before` rows of the block in front and the first `after` of the next."""
    at, own = F.col(position) % block, F.floor(F.col(position) / block)
    copies = F.array(F.struct(own.alias("b"), F.lit(False).alias("h")))
    if after:
        copies = F.concat(copies, F.when((at < after) & (own > 0), F.array(F.struct((own - 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array().cast("array<struct<b:bigint,h:boolean>>")))
    if before:
        copies = F.concat(copies, F.when(at >= block - before, F.array(F.struct((own + 1).alias("b"), F.lit(True).alias("h")))).otherwise(F.array().cast("array<struct<b:bigint,h:boolean>>")))
    return df.withColumn("_c", F.explode(copies)).withColumns({"_block": F.col("_c.b"), "_halo": F.col("_c.h")}).drop("_c")


def following(df: DataFrame, columns: tuple[str, ...], position: str, group: tuple[str, ...], block: int = BLOCK) -> DataFrame:
    """df with <c>1 and <c>2, the values of the next two positions of the group, null where there are none."""
    t = in_halos(df, position, 0, 2, block)
    w = W.partitionBy(*group, "_block").orderBy(position)
    for c in columns:
        t = t.withColumn(f"{c}1", F.lead(c, 1).over(w)).withColumn(f"{c}2", F.lead(c, 2).over(w))
    return t.where(~F.col("_halo")).drop("_halo", "_block")


def trailing_sum(df: DataFrame, value: str, position: str, group: tuple[str, ...], rows: int, out: str, block: int = BLOCK) -> DataFrame:
    """df with the sum of a column over a position and the `rows` before it."""
    t = in_halos(df, position, rows, 0, block)
    t = t.withColumn(out, F.sum(value).over(W.partitionBy(*group, "_block").orderBy(position).rowsBetween(-rows, 0)))
    return t.where(~F.col("_halo")).drop("_halo", "_block")


# Transforms


def split(n: int) -> int:
    """The greatest divisor of n up to its root."""
    return next(k for k in range(math.isqrt(n), 0, -1) if n % k == 0)


_COMPLEX = "array<double>"


def _step(t: DataFrame, by: str, at: str, n: int, sign: int, twiddle: int, keep: str) -> DataFrame:
    """Transforms of length n along `at`, one for each value of `by`: rows (by, keep, re, im), keep the transformed place, turned by the twiddle of length `twiddle` (0: none)."""

    def run(f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values(at)
        x = np.stack(f["re"].to_numpy()) + 1j * np.stack(f["im"].to_numpy())
        y = np.fft.fft(x, axis=0) if sign < 0 else np.fft.ifft(x, axis=0) * len(x)
        b = int(f[by].iloc[0])
        if twiddle:
            y *= np.exp(sign * 2j * np.pi * ((b * np.arange(len(y))) % twiddle) / twiddle)[:, None]
        return pd.DataFrame({by: b, keep: np.arange(len(y)), "re": list(y.real), "im": list(y.imag)})

    return t.groupBy(by).applyInPandas(run, f"{by} long, {keep} long, re {_COMPLEX}, im {_COMPLEX}")


def transform(t: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """(t, re, im) at all positions 0..n-1 -> (f, re, im): the discrete Fourier transform of every channel.

    In four steps: short transforms over strided positions, twiddles, a transpose by shuffle, short
    transforms again. A task holds about sqrt(n) rows. Lengths whose divisors are too unlike (primes,
    say) go by way of a chirp convolution of a power of two. The inverse isn't divided by n.
    """
    sign = 1 if inverse else -1
    a = split(n)
    if a * a * 64 < n:
        return chirp(t, n, sign)
    b = n // a
    first = _step(t.select((F.col("t") % b).alias("low"), F.floor(F.col("t") / b).alias("high"), "re", "im"), "low", "high", a, sign, n, "k1")
    second = _step(first, "k1", "low", b, sign, 0, "k2")
    return second.select((F.col("k1") + a * F.col("k2")).alias("f"), "re", "im")


def _turned(t: DataFrame, place: str, c: Column, s: Column) -> DataFrame:
    """Every channel of a row times the complex number c + i s."""
    t = t.withColumns({"_c": c, "_s": s})
    n = F.size("re")
    both = F.arrays_zip("re", "im", F.array_repeat("_c", n).alias("c"), F.array_repeat("_s", n).alias("s"))
    return t.withColumns({"_re": F.transform(both, lambda x: x["re"] * x["c"] - x["im"] * x["s"]), "_im": F.transform(both, lambda x: x["re"] * x["s"] + x["im"] * x["c"])}).select(place, F.col("_re").alias("re"), F.col("_im").alias("im"))


def chirp(t: DataFrame, n: int, sign: int) -> DataFrame:
    """A transform of any length as a convolution with a chirp, by three transforms of a power of two."""
    m = 1 << (2 * n - 1).bit_length()
    spark, pi = t.sparkSession, math.pi
    # t * t modulo 2n keeps the angle exact.
    angle = lambda c: F.lit(pi / n) * (c * c % (2 * n)).cast("double")
    at = F.col("t")
    x = _turned(t, "t", F.cos(angle(at)), sign * F.sin(angle(at)))
    zero = t.select(F.size("re").alias("d")).limit(1)
    pad = spark.range(n, m).select(F.col("id").alias("t")).crossJoin(F.broadcast(zero)).select("t", F.array_repeat(F.lit(0.0), F.col("d")).alias("re"), F.array_repeat(F.lit(0.0), F.col("d")).alias("im"))
    x = transform(x.unionByName(pad), m)
    j = F.when(at < n, at).when(at > m - n, m - at)
    b = spark.range(m).select(F.col("id").alias("t")).withColumn("j", j)
    b = b.select("t", F.array(F.coalesce(F.cos(angle(F.col("j"))), F.lit(0.0))).alias("re"), F.array(F.coalesce(-sign * F.sin(angle(F.col("j"))), F.lit(0.0))).alias("im"))
    b = transform(b, m).select(F.col("f").alias("f2"), F.get("re", F.lit(0)).alias("cr"), F.get("im", F.lit(0)).alias("ci"))
    y = _turned(x.join(b, F.col("f") == F.col("f2")), "f", F.col("cr"), F.col("ci")).withColumnRenamed("f", "t")
    y = transform(y, m, inverse=True).where(F.col("f") < n)
    f = F.col("f")
    return _turned(y, "f", F.cos(angle(f)) / m, sign * F.sin(angle(f)) / m)


def spectrum(df: DataFrame, order: str, column: str = "vec", chunk: int = RANGE) -> DataFrame:
    """(freq, power): |DFT|^2 / n of each channel of a vector column along an integer order, for the frequencies of a real transform. Rows without a vector are left out."""
    t = df.where(F.col(column).isNotNull()).select(order, column)
    n = t.count()
    if not n:
        return df.sparkSession.createDataFrame([], "freq long, power array<double>")
    t = numbered(t, order, out="t", chunk=chunk).select("t", F.col(column).alias("re"), F.transform(column, lambda _: F.lit(0.0)).alias("im"))
    p = F.zip_with("re", "im", lambda a, b: (a * a + b * b) / n)
    return transform(t, n).where(F.col("f") <= n // 2).select(F.col("f").alias("freq"), p.alias("power"))
