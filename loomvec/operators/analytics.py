"""Distribution, fidelity, attention and storage analytics of tables of vectors."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import expr as E
from . import sequences as H
from . import rotations as R


def channels(df: DataFrame, column: str = "vec") -> DataFrame:
    """(ch, x, next): every element with its right neighbour, null for the last."""
    shifted = F.concat(F.slice(column, F.lit(2), F.size(column) - 1), F.array(F.lit(None).cast("double")))
    return df.select(F.posexplode(F.arrays_zip(F.col(column).alias("x"), shifted.alias("next"))).alias("ch", "p")).select("ch", "p.x", "p.next")


def channel_stats(df: DataFrame, column: str = "vec") -> DataFrame:
    """(ch, mean, min, max, energy)."""
    return df.select(F.posexplode(column).alias("ch", "x")).groupBy("ch").agg(F.avg("x").alias("mean"), F.min("x").alias("min"), F.max("x").alias("max"), F.avg(F.col("x") * F.col("x")).alias("energy"))


def distribution(df: DataFrame, column: str = "vec") -> DataFrame:
    """(ch, variance, skewness, kurtosis, entropy, neighbour_corr): sample variance, moments over the sample deviation.

    Power sums around the channel's own mean: one pass for means, one for the rest, d rows each."""
    x = channels(df, column)
    mean = x.groupBy("ch").agg(F.avg("x").alias("m"))
    c = x.join(mean, "ch").withColumn("c", F.col("x") - F.col("m"))
    n, c2 = F.count("*"), F.sum(F.col("c") * F.col("c"))
    s = c.groupBy("ch").agg(n.alias("n"), c2.alias("c2"), F.sum(F.pow("c", F.lit(3))).alias("c3"), F.sum(F.pow("c", F.lit(4))).alias("c4"), F.abs(F.corr("x", "next")).alias("neighbour_corr"))
    var = F.col("c2") / (F.col("n") - 1)
    sd = F.greatest(F.sqrt(var), F.lit(1e-10))
    return s.select("ch", var.alias("variance"), (F.col("c3") / F.col("n") / F.pow(sd, F.lit(3))).alias("skewness"), (F.col("c4") / F.col("n") / F.pow(sd, F.lit(4)) - 3).alias("kurtosis"), (0.5 * F.log(F.lit(2 * math.pi * math.e) * F.greatest(var, F.lit(1e-20)))).alias("entropy"), "neighbour_corr")


def quality_score(df: DataFrame, original: str = "vec", rotated: str = "rotated") -> DataFrame:
    """One row: variance_uniformity, mean_cross_correlation, mean_excess_kurtosis, isometry_error and their weighted sum; lower is better."""
    d = distribution(df.select(F.col(rotated).alias("vec")))
    a = d.agg(F.stddev_samp("variance").alias("variance_uniformity"), F.avg("neighbour_corr").alias("mean_cross_correlation"), F.avg(F.abs("kurtosis")).alias("mean_excess_kurtosis"))
    b = df.agg(F.avg(F.abs(E.norm(F.col(rotated)) / (E.norm(F.col(original)) + F.lit(1e-8)) - 1)).alias("isometry_error"))
    t = a.crossJoin(b)
    return t.withColumn("combined_score", F.col("variance_uniformity") * 100 + F.col("mean_cross_correlation") * 100 + F.col("mean_excess_kurtosis") * 10 + F.col("isometry_error") * 1000)


def coordinate_spectrum(df: DataFrame, order: str = "vec_id", column: str = "vec") -> DataFrame:
    """(ch, freq, power): |rfft|^2 / n of each channel in the order of an integer column. A task holds about the root of the number of rows."""
    t = H.spectrum(df, order, column)
    return t.select(F.posexplode("power").alias("ch", "power"), F.col("freq").cast("int").alias("freq")).select("ch", "freq", "power")


def mse(df: DataFrame, a: str, b: str, *group: str) -> DataFrame:
    """Mean squared error over all elements, by group."""
    diff = E.minus(F.col(a), F.col(b))
    return df.groupBy(*group).agg((F.sum(E.dot(diff, diff)) / F.sum(F.size(a))).alias("mse"))


# Attention


def softmax(scores: DataFrame, group: tuple[str, ...], score: str = "score") -> DataFrame:
    """scores with p, normalised within a group; maxima and sums are aggregated, not windowed, so a long row of scores isn't one task's."""
    top = scores.groupBy(*group).agg(F.max(score).alias("_top"))
    t = scores.join(top, list(group)).withColumn("_e", F.exp(F.col(score) - F.col("_top")))
    total = t.groupBy(*group).agg(F.sum("_e").alias("_sum"))
    return t.join(total, list(group)).withColumn("p", F.col("_e") / F.col("_sum")).drop("_top", "_e", "_sum")


def head_sensitivity(weights: DataFrame) -> DataFrame:
    """weights (layer, head, q, k, p) -> (layer, head, entropy, peak, sensitivity)."""
    p = F.greatest("p", F.lit(1e-10))
    by_q = weights.groupBy("layer", "head", "q").agg(F.sum(-p * F.log(p)).alias("h"), F.max("p").alias("peak"), F.count("*").alias("n"))
    t = by_q.groupBy("layer", "head").agg((F.avg("h") / F.log(F.max("n"))).alias("entropy"), F.avg("peak").alias("peak"))
    return t.withColumn("sensitivity", (1 - F.col("entropy")) * F.col("peak"))


def bits_histogram(df: DataFrame, column: str = "bits") -> DataFrame:
    return df.groupBy(column).agg(F.count("*").alias("n"))


def bits_summary(df: DataFrame, column: str = "bits") -> DataFrame:
    return df.agg(F.avg(column).alias("mean"), F.min(column).alias("min"), F.max(column).alias("max"), F.count("*").alias("n"))


# Fidelity


def consecutive(df: DataFrame, columns: tuple[str, ...], order: str = "s", group: tuple[str, ...] = ("b", "h"), block: int = H.BLOCK) -> DataFrame:
    """df with <c>1 and <c>2, the vectors of the next two rows of the group in the order of an integer column; rows without two followers go."""
    t = H.following(H.numbered(df, order, group, "_s"), columns, "_s", group, block)
    return t.where(F.col(f"{columns[0]}2").isNotNull()).drop("_s")


def in_blocks(df: DataFrame, size: int, columns: dict[str, str], keep: tuple[str, ...]) -> DataFrame:
    """(keep, block, one column for each of `columns` under its new name): every block of `size` elements of the vectors as a row."""
    pieces = F.arrays_zip(*[E.blocks(F.col(c), size).alias(name) for c, name in columns.items()])
    return df.select(*keep, F.posexplode(pieces).alias("block", "p")).select(*keep, "block", *[F.col(f"p.{n}").alias(n) for n in columns.values()])


def fidelity(df: DataFrame, d: int, original: str = "a", quantized: str = "q", order: str = "s", group: tuple[str, ...] = ("b", "h")) -> DataFrame:
    """(group, order, pre, post, ratio) of consecutive triplets: associator norms of unit vectors before and after quantization."""
    t = df.select(*group, order, E.unit_plus(F.col(original)).alias("a"), E.unit_plus(F.col(quantized)).alias("q"))
    t = consecutive(t, ("a", "q"), order, group)
    norms = [A.associator_norm_column(F.col(c), F.col(f"{c}1"), F.col(f"{c}2"), d) for c in "aq"]
    t = t.select(*group, order, norms[0].alias("pre"), norms[1].alias("post"))
    return t.withColumn("ratio", F.when(F.abs("pre") < 1e-15, F.lit(1.0)).otherwise(F.col("post") / F.col("pre")))


def fidelity_summary(df: DataFrame, d: int, **names) -> DataFrame:
    """One row: mean, min, max and sample deviation of the ratio, mean norms before and after, count; (1, 1, 1, 0, 0, 0, 0) without a triplet."""
    f = fidelity(df, d, **names)
    c = lambda x, v, name: F.coalesce(x, F.lit(v)).alias(name)
    return f.agg(c(F.avg("ratio"), 1.0, "mean"), c(F.min("ratio"), 1.0, "min"), c(F.max("ratio"), 1.0, "max"), c(F.stddev_samp("ratio"), 0.0, "std"), c(F.avg("pre"), 0.0, "mean_pre"), c(F.avg("post"), 0.0, "mean_post"), F.count("*").alias("n"))


def residual_associators(df: DataFrame, d: int, column: str = "vec", order: str = "s", group: tuple[str, ...] = ("b", "h")) -> DataFrame:
    """(group, order, value): mean associator norm over the triplets around a row, the divisors 1, 2, 3, ..., 3, 2, 1 as published (for three rows 1, 2, 1)."""
    t = H.following(H.numbered(df.select(*group, order, F.col(column).alias("a")), order, group, "_s"), ("a",), "_s", group)
    t = t.withColumn("x", F.when(F.col("a2").isNotNull(), A.associator_norm_column(F.col("a"), F.col("a1"), F.col("a2"), d))).select(*group, order, "_s", "x")
    t = H.trailing_sum(t, "x", "_s", group, 2, "total")
    sizes = t.groupBy(*[F.col(c).alias(f"{c}_") for c in group]).agg(F.count("*").alias("n"))
    t = t.join(sizes, [F.col(c) == F.col(f"{c}_") for c in group])
    i, total = F.col("_s") + 1, F.coalesce("total", F.lit(0.0))
    edge = F.least(i, F.col("n") - i + 1)
    return t.select(*group, order, F.when(F.col("n") < 3, F.lit(0.0)).otherwise(total / F.least(edge, F.lit(3))).alias("value"))


def decomposition(a: Column, b: Column) -> Column:
    """struct<total, magnitude, phase> of the difference of two vectors."""
    return E.let(
        F.struct(E.norm(a).alias("na"), E.norm(b).alias("nb"), E.dot(a, b).alias("ab")),
        lambda s: F.struct(
            (1 - s["ab"] / (s["na"] * s["nb"] + F.lit(1e-15))).alias("total"),
            F.pow((s["na"] - s["nb"]) / (s["na"] + F.lit(1e-15)), F.lit(2)).alias("magnitude"),
            (1 - F.greatest(F.lit(-1.0), F.least(F.lit(1.0), s["ab"] / ((s["na"] + F.lit(1e-15)) * (s["nb"] + F.lit(1e-15)))))).alias("phase"),
        ),
    )


# Zero divisors


def zero_divisor_affinity(df: DataFrame, column: str = "vec", out: str = "affinity", samples: int = 200, seed: int = 42) -> DataFrame:
    """df with the least |a b| over one bank of random unit elements b, a the first 16 elements at unit norm. One bank for all rows: results don't depend on partitions."""
    bank = np.stack([A.right_matrix(b) for b in A.random_unit(samples, 16, seed)])

    @F.pandas_udf("double")
    def run(v: pd.Series) -> pd.Series:
        if not len(v):
            return pd.Series([], dtype="float64")
        x = A.normalize(np.stack(v.to_numpy()))
        best = np.full(len(x), np.inf)
        for r in bank:
            y = x @ r.T
            best = np.minimum(best, np.sqrt((y * y).sum(1)))
        return pd.Series(best)

    return df.withColumn(out, run(E.head(F.col(column), 16)))


def quartile_means(df: DataFrame, by: str, value: str, tie: str) -> DataFrame:
    """(quartile, mean): rows in rising order of `by` in four parts, the last with the remainder; no quartile under four rows.

    Ranks come from counts of value ranges (bounds by approximate quantiles), so only the rows of one range are sorted together."""
    n = df.count()
    if n < 4:
        return df.sparkSession.createDataFrame([(i, float("nan")) for i in range(4)], "quartile int, mean double")
    cuts = df.approxQuantile(by, [i / 64 for i in range(1, 64)], 0.001)
    cell = F.lit(0)
    for c in cuts:
        cell = cell + (F.col(by) > c).cast("int")
    t = df.select(by, value, tie, cell.alias("cell"))
    base = t.groupBy("cell").agg(F.count("*").alias("m")).withColumn("before", F.coalesce(F.sum("m").over(W.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    rank = F.row_number().over(W.partitionBy("cell").orderBy(by, tie)) - 1 + F.col("before")
    return t.join(base, "cell").withColumn("quartile", F.least(F.floor(rank / (n // 4)), F.lit(3)).cast("int")).groupBy("quartile").agg(F.avg(value).alias("mean"))


# Low rank


def explained_variance(df: DataFrame, rank: int, column: str = "vec") -> list[float]:
    """Running share of the squared singular values among the first `rank`, so the last is 1."""
    _, _, g = R.gram(df, column)
    values = np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1][:rank]
    return (np.cumsum(values) / values.sum()).tolist() if values.sum() > 0 else [1.0] * len(values)


def rank_and_bits(df: DataFrame, rows: int, d: int, budget_bytes: float, ranks: tuple[int, ...] = (8, 16, 32, 64), bits: tuple[int, ...] = (2, 3, 4), column: str = "vec") -> tuple[int, int]:
    """The rank and bits of least truncation error within a budget; the error doesn't depend on bits, so the first bits that fit win. The first cell if none fits."""
    from .compressors import svd_bytes

    _, _, g = R.gram(df, column)
    values = np.sort(np.maximum(np.linalg.eigvalsh(g), 0))[::-1]
    best, choice = math.inf, (ranks[0], bits[0])
    for r in ranks:
        error = float(values[r:].sum())
        for b in bits:
            if svd_bytes(rows, d, r, b) <= budget_bytes and error < best:
                best, choice = error, (r, b)
    return choice


def per_head_rotation(df: DataFrame, names: tuple[str, ...] = ("wht", "haar", "cd8", "hybrid"), bits: int = 3, head: str = "h", column: str = "vec", seed: int = 42, order: str = "s") -> DataFrame:
    """(head, rotation, score): for each head the candidate with the best 0.3 fidelity + 0.7 cosine; wht under 16 dimensions or 3 rows.

    Fidelity is that of all blocks of eight; its triplets follow `order`, whole numbers, within a head and block.
    All candidates are tried in one pass over rows in order: blocks of positions with halos, a task at a
    time some of them, and what leaves a task is sums by head and candidate.
    """
    from .quantizers import Scalar

    d = E.require_dim(df, column)
    if d < 16:
        return df.select(head).distinct().select(head, F.lit("wht").alias("rotation"), F.lit(None).cast("double").alias("score"))
    sizes = df.groupBy(head).agg(F.count("*").alias("n"))
    t = H.numbered(df.where(F.col(column).isNotNull()).select(head, order, F.col(column).alias("x")), order, (head,), "_s")
    t = H.in_halos(t.select(head, "_s", "x"), "_s", 0, 2).repartition(head, "_block").sortWithinPartitions(head, "_block", "_s")
    kinds = f"{head} {df.schema[head].dataType.simpleString()}"
    sums = t.select(head, "_block", "_halo", "x").mapInArrow(_trials_of_rotations([R.make(n, d, seed) for n in names], names, Scalar(d, bits).tables, head), f"{kinds}, rotation string, cos double, rows long, ratio double, triplets long")
    sums = sums.groupBy(head, "rotation").agg(F.try_divide(F.sum("cos"), F.sum("rows")).alias("cos"), F.try_divide(F.sum("ratio"), F.sum("triplets")).alias("f"))
    score = F.lit(0.3) * (1 - F.least(F.abs(F.coalesce("f", F.lit(1.0)) - 1), F.lit(1.0))) + F.lit(0.7) * F.col("cos")
    sums = sums.withColumnRenamed(head, "_head")
    parts = sizes.join(sums, F.col(head).eqNullSafe(F.col("_head")), "left").select(head, "rotation", F.when(F.col("n") >= 3, score).alias("score"))
    best = parts.groupBy(head).agg(F.max(F.struct("score", "rotation")).alias("b"))
    return best.select(head, F.when(F.col("b.score").isNull(), "wht").otherwise(F.col("b.rotation")).alias("rotation"), F.col("b.score").alias("score"))


def _trials_of_rotations(rotations: list, names: tuple[str, ...], tables: tuple, head: str):
    """An Arrow function from rows (head, _block, _halo, x) in order to (head, rotation, cos, rows, ratio, triplets): sums of cosines and of fidelity ratios. A triplet reaches back into the batch before."""
    centroids, edges = (np.array(t) for t in tables)

    def unit_blocks(x: np.ndarray) -> np.ndarray:
        """rows x blocks x 8, elements of a block at unit norm; each of the eight places lies in one piece."""
        x = np.moveaxis(np.ascontiguousarray(np.moveaxis(x[:, : x.shape[1] // 8 * 8].reshape(len(x), -1, 8), -1, 0)), 0, -1)
        return x / (np.sqrt((x * x).sum(axis=-1)) + 1e-8)[..., None]

    def norms(x: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Associator norms of the blocks of rows at, at + 1 and at + 2."""
        u = unit_blocks(x)
        a, b, c = (np.moveaxis(np.ascontiguousarray(np.moveaxis(u[at + i], -1, 0)), 0, -1) for i in range(3))
        size = lambda v: np.sqrt((v * v).sum(axis=-1))
        return size(A.associator(a, b, c)) / (size(a) * size(b) * size(c) + 1e-8)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for b in batches:
            if not b.num_rows:
                continue
            new = pa.Table.from_batches([b])
            t = pa.concat_tables([held, new]).combine_chunks() if held is not None else new
            old, n, held = t.num_rows - b.num_rows, t.num_rows, t.slice(max(0, t.num_rows - 2))
            heads = t.column(head).combine_chunks().dictionary_encode("encode")
            h, block = heads.indices.to_numpy(zero_copy_only=False), t.column("_block").to_numpy()
            x = t.column("x").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
            x = x / np.maximum(np.sqrt((x * x).sum(axis=1)), 1e-12)[:, None]
            own = np.flatnonzero(~t.column("_halo").to_numpy(zero_copy_only=False).astype(bool) & (np.arange(n) >= old))
            at = np.arange(max(0, old - 2), max(0, n - 2))
            at = at[(h[at] == h[at + 2]) & (block[at] == block[at + 2])]
            pre, top = norms(x, at), len(heads.dictionary)
            by = lambda i, w=None: np.bincount(h[i], w, top)
            for name, rotation in zip(names, rotations, strict=True):
                y = rotation.unrotate(centroids[np.searchsorted(edges, rotation.rotate(x), side="left")])
                length = lambda v: np.maximum(np.sqrt((v * v).sum(axis=1)), 1e-8)
                cos = (x * y).sum(axis=1) / (length(x) * length(y))
                ratio = np.where(np.abs(pre) < 1e-15, 1.0, norms(y, at) / np.where(np.abs(pre) < 1e-15, 1.0, pre))
                cells = [by(own, cos[own]), by(own), by(at, ratio.sum(axis=1)), by(at) * ratio.shape[1]]
                yield pa.RecordBatch.from_arrays([heads.dictionary, pa.array([name] * top), *[pa.array(c.astype(k)) for c, k in zip(cells, ("f8", "i8", "f8", "i8"), strict=True)]], names=[head, "rotation", "cos", "rows", "ratio", "triplets"])

    return run


def rotation_counts(chosen: DataFrame, rotation: str = "rotation") -> DataFrame:
    """(rotation, heads): how many heads were given each rotation."""
    return chosen.groupBy(rotation).agg(F.count("*").alias("heads"))
