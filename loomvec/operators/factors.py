"""Low rank as tables: Gram matrices, certified eigenpairs, factors, scores from factors, ranks and bits within a budget.

A group's Gram matrix is summed from one d x d partial a batch and meets, d x d numbers whatever its
rows, in one task that decomposes it. Each pair comes back with the norm of its residual |G v - lambda v|,
so whoever reads the table can tell how good it is. Singular values are roots of eigenvalues; what lies
under sqrt(eps) of the greatest is noise of the Gram matrix, which its residual shows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import expr as E
from . import rotations as R

GROUP = ("b", "h")


def named(df: DataFrame, group: tuple[str, ...]) -> list[str]:
    return [f"`{c}` {df.schema[c].dataType.simpleString()}" for c in group]


def grams(df: DataFrame, group: tuple[str, ...] = GROUP, column: str = "vec") -> DataFrame:
    """(group, n, g): rows and the flattened sum of outer products of each group; rows without a vector don't count."""
    names = list(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            keys = pa.table(b.columns[:-1], names=names).append_column("_at", pa.array(np.arange(b.num_rows))).group_by(names).aggregate([("_at", "list")])
            x = b.column(len(names)).flatten().to_numpy(zero_copy_only=False).reshape(b.num_rows, -1)
            parts = [np.array(at.as_py()) for at in keys.column("_at_list")]
            g = [(x[at].T @ x[at]).ravel() for at in parts]
            yield pa.RecordBatch.from_arrays([*[keys.column(c).combine_chunks() for c in names], pa.array([len(at) for at in parts], pa.int64()), pa.array(g, pa.list_(pa.float64()))], names=[*names, "n", "g"])

    t = df.where(F.col(column).isNotNull()).select(*group, F.col(column).alias("v")).mapInArrow(run, ", ".join([*named(df, group), "n long", "g array<double>"]))
    flat = t.select(*group, "n", F.posexplode("g").alias("i", "x")).groupBy(*group, "i").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda s: s["x"])
    return flat.groupBy(*group).agg(F.max("n").alias("n"), ordered.alias("g"))


def eigenpairs(gram: DataFrame, group: tuple[str, ...] = GROUP, rank: int | None = None) -> DataFrame:
    """(group, n, total, k, value, vector, residual): pairs of each Gram matrix, greatest first, k from 1; total is the trace.

    A vector's element of greatest size, the first of equals, is positive."""

    @F.pandas_udf("array<struct<k:int,value:double,vector:array<double>,residual:double>>")
    def run(g: pd.Series) -> pd.Series:
        out = []
        for x in g:
            d = int(round(len(x) ** 0.5))
            m = np.asarray(x, np.float64).reshape(d, d)
            m = (m + m.T) / 2
            values, vectors = np.linalg.eigh(m)
            order = np.argsort(-values, kind="stable")[: rank or d]
            values, vectors = values[order], vectors[:, order]
            top = np.abs(vectors).argmax(axis=0)
            vectors = vectors * np.where(vectors[top, np.arange(len(order))] < 0, -1.0, 1.0)
            left = np.sqrt(((m @ vectors - vectors * values) ** 2).sum(axis=0))
            out.append([(k + 1, float(values[k]), vectors[:, k].tolist(), float(left[k])) for k in range(len(order))])
        return pd.Series(out)

    trace = F.aggregate(F.transform("g", lambda x, i: F.when(i % (F.sqrt(F.size("g").cast("double")).cast("int") + 1) == 0, x).otherwise(0.0)), F.lit(0.0), lambda a, x: a + x)
    t = gram.select(*group, "n", trace.alias("total"), R.apart(run)(F.col("g")).alias("p"))
    return t.select(*group, "n", "total", F.explode("p").alias("p")).select(*group, "n", "total", "p.*")


def explained(pairs: DataFrame, group: tuple[str, ...] = GROUP, of_all: bool = True) -> DataFrame:
    """(group, k, share): running share of the variance, of all of it or, as published results have it, of the pairs in the table."""
    order = W.partitionBy(*group).orderBy("k")
    value = F.greatest("value", F.lit(0.0))
    whole = F.col("total") if of_all else F.sum(value).over(W.partitionBy(*group))
    return pairs.select(*group, "k", F.when(whole > 0, F.sum(value).over(order) / whole).otherwise(1.0).alias("share"))


def factorize(df: DataFrame, rank: int, group: tuple[str, ...] = GROUP, column: str = "vec") -> tuple[DataFrame, DataFrame]:
    """(rows, factors): df with u in place of the vector, and (group, k, sv): a row is about the sum of u[k] sv[k].

    The singular value is on the side of the factors; directions without variance have u = 0.
    """
    pairs = eigenpairs(grams(df, group, column), group, rank)
    s = F.sqrt(F.greatest("value", F.lit(0.0)))
    factors = pairs.select(*group, "k", E.scale(F.col("vector"), s).alias("sv"), F.when(F.col("value") > F.col("total") * 1e-14, E.divide(F.col("vector"), s)).otherwise(E.scale(F.col("vector"), F.lit(0.0))).alias("to_u"))
    m = factors.groupBy(*group).agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "to_u"))), lambda x: x["to_u"]).alias("m"))
    rows = df.where(F.col(column).isNotNull()).join(m, list(group))
    u = E.let(F.col(column), lambda v: F.transform("m", lambda r: E.dot(r, v)))
    return rows.withColumn("u", u).drop(column, "m"), factors.drop("to_u")


def factor_scores(queries: DataFrame, rows: DataFrame, factors: DataFrame, group: tuple[str, ...] = GROUP, key: str = "k_id") -> DataFrame:
    """(group, q_id, key, score) of queries (group, q_id, q): each query meets the factors once, then rows are read by their u: no row is rebuilt."""
    p = queries.join(factors, list(group)).select(*group, "q_id", "k", E.dot(F.col("sv"), F.col("q")).alias("x"))
    p = p.groupBy(*group, "q_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "x"))), lambda s: s["x"]).alias("p"))
    return rows.join(p, list(group)).select(*group, "q_id", key, E.dot(F.col("u"), F.col("p")).alias("score"))


def ratio(rows: DataFrame, factors: DataFrame, bits: int, group: tuple[str, ...] = GROUP, original_bits: int = 16) -> DataFrame:
    """(group, original, compressed, ratio) in bits, by the elements that the two tables hold."""
    a = rows.groupBy(*group).agg(F.count("*").alias("n"), F.sum(F.size("u")).alias("left"))
    b = factors.groupBy(*group).agg(F.sum(F.size("sv")).alias("right"), F.max(F.size("sv")).alias("d"))
    t = a.join(b, list(group)).select(*group, (F.col("n") * F.col("d") * original_bits).alias("original"), ((F.col("left") + F.col("right")) * bits).alias("compressed"))
    return t.withColumn("ratio", F.col("original") / F.col("compressed"))


def rank_and_bits(pairs: DataFrame, budget_bits: Column | float, ranks: tuple[int, ...], bits: tuple[int, ...] = (1, 2, 3, 4), metric: str = "mse", group: tuple[str, ...] = GROUP) -> DataFrame:
    """(group, rank, bits, error, ratio): for each group the cell of the grid with the least error of what a rank leaves out, within a budget.

    pairs: all eigenpairs of a group. budget_bits: a number or a column over (group, n, d). The error
    doesn't depend on bits, so the least bits win ties; where nothing fits it is the grid's first cell.
    """
    spectrum = pairs.groupBy(*group).agg(F.max("n").alias("n"), F.max("k").alias("d"), F.max("total").alias("total"))
    spectrum = spectrum.withColumn("budget", budget_bits if isinstance(budget_bits, Column) else F.lit(float(budget_bits)))
    kept = pairs.withColumn("kept", F.sum(F.greatest("value", F.lit(0.0))).over(W.partitionBy(*group).orderBy("k"))).where(F.col("k").isin(list(ranks))).select(*group, F.col("k").alias("rank"), "kept")
    grid = F.explode(F.array(*[F.lit(b) for b in bits]))
    t = spectrum.join(kept, list(group)).withColumn("bits", grid)
    left = F.greatest(F.col("total") - F.col("kept"), F.lit(0.0))
    error = left / (F.col("n") * F.col("d")) if metric == "mse" else 1 - F.sqrt(F.least(F.col("kept") / F.greatest("total", F.lit(1e-300)), F.lit(1.0)))
    size = (F.col("n") + F.col("d")) * F.col("rank") * F.col("bits")
    t = t.withColumn("error", error).withColumn("size", size).withColumn("fits", F.col("size") <= F.col("budget"))
    best = t.groupBy(*group).agg(F.min(F.struct(~F.col("fits"), F.when(F.col("fits"), F.round("error", 12)), "rank", "bits", "error", (F.col("n") * F.col("d") * 16 / F.col("size")).alias("ratio"))).alias("x"))
    return best.select(*group, "x.rank", "x.bits", "x.error", "x.ratio")
