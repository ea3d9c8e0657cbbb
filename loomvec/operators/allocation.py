"""Bits for regions, levels, layers and heads from their statistics.

Statistics are aggregated over the table; the allocators work on one row a region, which the driver
or one task holds.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import expr as E
from . import rotations as R
from .codebooks import lloyd_max
from .compressors import tower

#: The high-rate constant of a scalar quantizer of a normal source, and the slope published results use.
DISTORTION = math.pi * math.sqrt(3) / 2
SLOPE = 1 / (2 * math.log(4))
#: The slope that the optimality conditions give.
OPTIMAL_SLOPE = 1 / math.log(4)


def distortion(bits: Column | float, variance: Column | float):
    if isinstance(bits, Column) or isinstance(variance, Column):
        return variance * F.lit(DISTORTION) * F.pow(F.lit(4.0), -bits if isinstance(bits, Column) else F.lit(-float(bits)))
    return variance * DISTORTION * 4.0**-bits


def force(bits: Column | float, variance: Column | float):
    """Nats a unit of distortion; 0 without bits or variance."""
    if isinstance(bits, Column) or isinstance(variance, Column):
        b, v = (x if isinstance(x, Column) else F.lit(float(x)) for x in (bits, variance))
        return F.when((b <= 0) | (v <= 0), F.lit(0.0)).otherwise(b * F.lit(math.log(2)) / distortion(b, v))
    return 0.0 if bits <= 0 or variance <= 0 else bits * math.log(2) / distortion(bits, variance)


@dataclass(frozen=True)
class Region:
    n: int
    variance: float
    structure: float = 1.0


def continuous(regions: list[Region], budget: float, slope: float = SLOPE) -> list[float]:
    """budget + slope * (ln variance - its mean weighted by size)."""
    total = sum(r.n for r in regions)
    logs = [math.log(max(r.structure * r.variance, 1e-30)) for r in regions]
    mean = sum(r.n * x for r, x in zip(regions, logs, strict=True)) / total
    return [budget + slope * (x - mean) for x in logs]


def allocate(regions: list[Region], budget: float, least: int = 2, most: int = 8, slope: float = SLOPE) -> list[int]:
    """Whole bits near the continuous optimum within [least, most]; up to three sweeps hand out what rounding left, to those it moved farthest first."""
    if not regions:
        return []
    total = sum(r.n for r in regions)
    if not total:
        return [least] * len(regions)
    goal = continuous(regions, budget, slope)
    bits = [max(least, min(most, round(g))) for g in goal]
    for _ in range(3):
        left = int(budget * total) - sum(r.n * b for r, b in zip(regions, bits, strict=True))
        if not left:
            break
        step = 1 if left > 0 else -1
        free = [i for i, b in enumerate(bits) if least <= b + step <= most]
        if not free:
            break
        for i in sorted(free, key=lambda i: -abs(goal[i] - bits[i]) * regions[i].n):
            if left and abs(left) >= regions[i].n and least <= bits[i] + step <= most:
                bits[i] += step
                left -= step * regions[i].n
    return bits


def unified(variances: list[float], budget: float, sizes: list[int] | None = None, structures: list[float] | None = None, least: int = 2, most: int = 8, metric: str = "mse") -> list[int]:
    """metric cosine turns variances over: quiet regions weigh more there."""
    n = len(variances)
    if metric == "cosine":
        top = max(variances, default=1.0)
        variances = [top / (v + 1e-30) for v in variances]
    return allocate([Region(s, v, f) for s, v, f in zip(sizes or [1] * n, variances, structures or [1.0] * n, strict=True)], budget, least, most)


def spectral(df: DataFrame, budget: float, column: str = "vec", least: int = 1, most: int = 8) -> list[int]:
    """Bits of each coordinate by its energy."""
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy("i").agg(F.avg(F.col("x") * F.col("x")).alias("e")).orderBy("i").collect()
    return unified([r["e"] for r in rows], budget, least=least, most=most)


def per_layer(df: DataFrame, budget: float = 3.0, layer: str = "layer", column: str = "vec", least: int = 2, most: int = 4) -> dict:
    """Bits of each layer by the variance over all its elements; one row a layer reaches the driver."""
    rows = df.select(layer, F.explode(column).alias("x")).groupBy(layer).agg(F.var_samp("x").alias("v")).orderBy(layer).collect()
    return dict(zip([r[0] for r in rows], unified([r["v"] for r in rows], budget, least=least, most=most, metric="cosine"), strict=True))


def tower_bits(d: int, budget: int, least: int = 2, most: int = 5, variances: list[float] | None = None) -> list[int]:
    """Bits of the levels of a tower for a budget over the whole vector."""
    levels = tower(d)
    v = variances or [1 / (hi - lo) for lo, hi in levels]
    return allocate([Region(hi - lo, max(x, 1e-30)) for (lo, hi), x in zip(levels, v, strict=True)], budget / d, least, most)


def level_variances(df: DataFrame, d: int, column: str = "vec") -> list[float]:
    """Sample variance over all elements of each level."""
    level = F.lit(0)
    for k, (lo, _) in enumerate(tower(d)):
        level = F.when(F.col("i") >= lo, k).otherwise(level)
    rows = df.select(F.posexplode(column).alias("i", "x")).groupBy(level.alias("k")).agg(F.var_samp("x").alias("v")).orderBy("k").collect()
    return [r["v"] for r in rows]


def structure_factors(df: DataFrame, block: int = 16, alpha: float = 1.0, column: str = "vec", deal: Column | None = None, cell: int = 4096) -> DataFrame:
    """One row (block, triplets, assoc, size, factor, error): 1 plus alpha times the mean associator over the mean norm of all blocks, 1 for blocks up to 8.

    Every block of every row is in one triplet: rows are dealt to cells of about `cell` rows by a hash
    (of their values, unless `deal` gives one) and taken three at a time in its order, at the same place
    of the vector; up to two of a cell are left over. error is the half width of the factor's 95 % range.
    """
    t = df.where(F.size(column) >= block).select((deal if deal is not None else F.xxhash64(column)).cast("long").alias("deal"), F.posexplode(E.blocks(F.col(column), block)).alias("place", "x"))
    size = t.agg(F.avg(E.norm(F.col("x"))).alias("size"))
    if block <= 8:
        return size.select(F.lit(block).alias("block"), F.lit(0).cast("long").alias("triplets"), F.lit(0.0).alias("assoc"), "size", F.lit(1.0).alias("factor"), F.lit(0.0).alias("error"))
    cells = F.lit(max(1, -(-df.count() // cell)))
    t = t.withColumn("cell", F.pmod("deal", cells))
    w = W.partitionBy("place", "cell").orderBy("deal", "x")
    t = t.select("place", "cell", F.row_number().over(w).alias("i"), F.col("x").alias("a"), F.lead("x", 1).over(w).alias("b"), F.lead("x", 2).over(w).alias("c")).where((F.col("i") % 3 == 1) & F.col("c").isNotNull())
    x = A.associator_norm_column(F.col("a"), F.col("b"), F.col("c"), block)
    found = t.select(x.alias("x")).agg(F.count("*").alias("triplets"), F.avg("x").alias("assoc"), F.stddev_samp("x").alias("sd"))
    base = F.greatest("size", F.lit(1e-8))
    return found.crossJoin(size).select(
        F.lit(block).alias("block"), "triplets", F.coalesce("assoc", F.lit(0.0)).alias("assoc"), "size",
        (1 + alpha * F.coalesce("assoc", F.lit(0.0)) / base).alias("factor"), F.coalesce(1.96 * alpha * F.col("sd") / F.sqrt("triplets") / base, F.lit(0.0)).alias("error"),
    )


def structure_factor(df: DataFrame, block: int = 16, alpha: float = 1.0, column: str = "vec") -> float:
    return structure_factors(df, block, alpha, column).first()["factor"]


# Water-filling


def fill(regions: DataFrame, budget: float, least: int = 1, most: int = 8, slope: float = OPTIMAL_SLOPE, key: str = "region") -> DataFrame:
    """regions (key, n, variance, ...) with goal and bits: the best real bits within [least, most] whose mean weighted by n is the budget, and whole bits within it.

    All regions between the bounds lie at one level, goal = level + slope * ln variance. The level is
    searched by aggregates that try many levels at once, then solved exactly between the bounds that
    regions stop at. Whole bits are the floors, and one more in the order of what the floor took away
    (ties to the lesser key) while it fits. No step holds all regions in one task.
    """
    g = F.lit(slope) * F.log(F.greatest("variance", F.lit(1e-30)))
    t = regions.withColumn("_g", g)
    whole = t.agg(F.sum("n").alias("n"), F.min("_g").alias("low"), F.max("_g").alias("high")).first()
    if not whole["n"]:
        return t.drop("_g").withColumns({"goal": F.lit(float(least)), "bits": F.lit(least)})
    total = min(max(budget, least), most) * whole["n"]
    clipped = lambda level: F.greatest(F.lit(float(least)), F.least(F.lit(float(most)), F.lit(float(level)) + F.col("_g")))
    low, high = least - whole["high"], most - whole["low"]
    for _ in range(4):
        levels = np.linspace(low, high, 34)[1:-1]
        used = t.agg(*[F.sum(F.col("n") * clipped(x)).alias(f"u{i}") for i, x in enumerate(levels)]).first()
        under = sum(u <= total for u in used)
        low, high = (levels[under - 1] if under else low), (levels[under] if under < len(levels) else high)
    level = (low + high) / 2
    for _ in range(20):  # what is between the bounds decides the level; the level decides what is
        x = F.lit(float(level)) + F.col("_g")
        mid = (x > least) & (x < most)
        r = t.agg(F.sum(F.when(x <= least, F.col("n"))).alias("lo"), F.sum(F.when(x >= most, F.col("n"))).alias("hi"), F.sum(F.when(mid, F.col("n"))).alias("n"), F.sum(F.when(mid, F.col("n") * F.col("_g"))).alias("g")).first()
        if not r["n"]:
            break
        new = (total - least * (r["lo"] or 0) - most * (r["hi"] or 0) - r["g"]) / r["n"]
        if abs(new - level) < 1e-12:
            break
        level = new
    t = t.withColumn("goal", clipped(level)).withColumn("_b", F.floor(F.col("goal") + 1e-9).cast("int"))
    t = t.withColumn("_f", F.round(F.greatest(F.col("goal") - F.col("_b"), F.lit(0.0)), 9)).withColumn("_cell", F.floor((1 - F.col("_f")) * 1024))
    # A row a cell of 1025, then only the cell where the budget ends is ordered.
    open_ = F.col("_f") > 0
    cells = t.groupBy("_cell").agg(F.sum(F.when(open_, F.col("n")).otherwise(0)).alias("_m"), F.sum(F.col("n") * F.col("_b")).alias("_used"))
    everything = W.partitionBy(F.lit(0))
    cells = cells.select(F.col("_cell").alias("_c"), (F.lit(math.floor(total + 1e-6)) - F.sum("_used").over(everything)).alias("_left"), (F.sum("_m").over(everything.orderBy("_cell")) - F.col("_m")).alias("_before"))
    t = t.join(cells, F.col("_cell") == F.col("_c"))
    ahead = F.sum(F.when(open_, F.col("n")).otherwise(0)).over(W.partitionBy("_cell").orderBy(F.col("_f").desc(), key)) + F.col("_before")
    t = t.withColumn("bits", (F.col("_b") + F.when(open_ & (ahead <= F.col("_left")), 1).otherwise(0)).cast("int"))
    return t.drop("_g", "_b", "_f", "_cell", "_c", "_left", "_before")


# Measured curves


def level_curve(df: DataFrame, bits: tuple[int, ...] = (2, 3, 4, 5), column: str = "vec", seed: int = 42, codebook_dim: str = "level") -> DataFrame:
    """(level, dim, bits, mse): the error an element of each tower level at each number of bits, measured on the rotated table in one pass."""
    d = E.require_dim(df, column, power_of_two=True)
    levels, rot = tower(d), R.make("wht", d, seed)
    books = {(k, b): lloyd_max(hi - lo if codebook_dim == "level" else d, b) for k, (lo, hi) in enumerate(levels) for b in bits}

    def run(batches):
        for batch in batches:
            x = batch.column(0).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1) @ rot.matrix.T
            rows = [(k, hi - lo, b, float(((x[:, lo:hi] - np.array(books[k, b][0])[np.searchsorted(books[k, b][1], x[:, lo:hi])]) ** 2).sum()), x[:, lo:hi].size) for k, (lo, hi) in enumerate(levels) for b in bits]
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.int64()), strict=True)], names=["level", "dim", "bits", "e", "n"])

    t = df.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "level int, dim int, bits int, e double, n long")
    return t.groupBy("level", "dim", "bits").agg((F.sum("e") / F.sum("n")).alias("mse"))


def by_curve(curve: DataFrame, budget: float) -> DataFrame:
    """(level, dim, bits, mse): bits of each level by what the measured curve gains a bit, within budget bits a vector.

    Each further bit of a level costs its dimension; steps are taken in the order of their gain a bit
    spent, a level's own in order (a step that gains more than one before it waits for it).
    """
    by_level = W.partitionBy("level").orderBy("bits")
    t = curve.withColumn("gain", F.lag("mse", 1).over(by_level) - F.col("mse"))
    t = t.withColumn("gain", F.min("gain").over(by_level.rowsBetween(W.unboundedPreceding, 0)))
    # A row a level and number of bits: some dozens, whatever the table.
    base = F.sum(F.when(F.col("gain").isNull(), F.col("dim") * F.col("bits"))).over(W.partitionBy(F.lit(0)))
    spent = F.sum(F.when(F.col("gain").isNotNull(), F.col("dim")).otherwise(0)).over(W.partitionBy(F.lit(0)).orderBy(F.col("gain").desc_nulls_first(), "level", "bits"))
    taken = t.withColumn("spent", base + spent).where(F.col("gain").isNull() | ((F.col("spent") <= budget) & (F.col("gain") > 0)))
    best = taken.groupBy("level", "dim").agg(F.max_by(F.struct("bits", "mse"), "bits").alias("x"))
    return best.select("level", "dim", "x.bits", "x.mse")


def compare_with_uniform(df: DataFrame, bits: int = 3, least: int = 2, most: int = 5, column: str = "vec", seed: int = 42) -> DataFrame:
    """(method, bits, mse, gain): bits an element, error an element and the share of the uniform error that each way to give bits to levels saves.

    Ways: uniform (one codebook for all), variance (levels by the allocator), curve (levels by measured
    errors). The rotation is orthogonal, so errors of levels add up to the vector's.
    """
    d = E.require_dim(df, column, power_of_two=True)
    steps = tuple(range(least, most + 1))
    curve = level_curve(df, steps, column, seed)
    given = tower_bits(d, d * bits, least, most, level_variances(df, d, column))
    chosen = F.element_at(F.array(*[F.lit(b) for b in given]), F.col("level") + 1)
    ways = {"variance": curve.where(F.col("bits") == chosen), "curve": by_curve(curve, d * bits)}
    uniform = level_curve(df, (bits,), column, seed, "full")
    total = lambda t, name: t.agg(F.lit(name).alias("method"), (F.sum(F.col("dim") * F.col("bits")) / d).alias("bits"), (F.sum(F.col("dim") * F.col("mse")) / d).alias("mse"))
    out = total(uniform, "uniform")
    for name, t in ways.items():
        out = out.unionByName(total(t, name))
    base = F.max(F.when(F.col("method") == "uniform", F.col("mse"))).over(W.partitionBy(F.lit(0)))
    return out.withColumn("gain", (base - F.col("mse")) / (base + 1e-15))


def greedy_bits(heads: DataFrame, budget: float = 3.0, least: int = 1, most: int = 4, score: str = "sensitivity") -> DataFrame:
    """heads (layer, head, score) with bits, rotation and quantizer: in falling order of score each is filled up until the budget is used.

    The closed form of that loop: what is left for a head is the extra less what those before could take. One row a head."""
    everything = W.partitionBy()
    order = W.orderBy(F.col(score).desc(), "layer", "head")
    extra = F.floor(F.count("*").over(everything) * F.lit(budget)) - F.count("*").over(everything) * least
    span = most - least
    t = heads.withColumn("bits", (F.lit(least) + F.least(F.greatest(extra - (F.row_number().over(order) - 1) * span, F.lit(0)), F.lit(span))).cast("int"))
    t = t.withColumn("rotation", F.when(F.col("bits") >= 4, "haar").otherwise("wht"))
    return t.withColumn("quantizer", F.when(F.col("bits") >= 4, "scalar").when(F.col("bits") == 3, "e8").when(F.col("bits") == 2, "z8_256").otherwise("z8_32"))
