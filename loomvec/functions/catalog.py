"""Dimension tables of algebras, lattices and methods."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession

#: Name, dimension, commutative, associative, alternative, composition, zero-divisor pairs, automorphisms, lattice, second moment.
DIVISION_ALGEBRAS = (
    ("Reals", 1, True, True, True, True, 0, "Z/2Z", "Z", 1 / 12),
    ("Complex", 2, True, True, True, True, 0, "Z/2Z", "Z^2 (hexagonal)", 0.08018),
    ("Quaternions", 4, False, True, True, True, 0, "SO(3)", "D4", 0.07655),
    ("Octonions", 8, False, False, True, True, 0, "G2", "E8", 0.07168),
)
#: Name, dimension, associative, alternative, composition, power-associative, zero-divisor pairs, reduced and standard multiplications.
TOWER = (
    ("Reals", 1, True, True, True, True, 0, None, 1),
    ("Complex", 2, True, True, True, True, 0, None, 4),
    ("Quaternions", 4, True, True, True, True, 0, 8, 16),
    ("Octonions", 8, False, True, True, True, 0, 30, 64),
    ("Sedenions", 16, False, False, False, True, 84, 84, 256),
    ("Pathions", 32, False, False, False, True, None, 498, 1024),
    ("Chingons", 64, False, False, False, True, None, 1494, 4096),
    ("Routons", 128, False, False, False, True, None, None, 16384),
)
#: Name, rank, dimension, roots.
EXCEPTIONAL_ALGEBRAS = (("G2", 2, 14, 12), ("F4", 4, 52, 48), ("E6", 6, 78, 72), ("E7", 7, 133, 126), ("E8", 8, 248, 240))
#: Dimension, lattice, algebra, second moment, shortest vectors.
BARNES_WALL = ((1, "Z", "R", 1 / 12, 2), (2, "A2 (hexagonal)", "C", 0.08018, 6), (4, "D4", "H", 0.07655, 24), (8, "E8", "O", 0.07168, 240), (16, "Lambda_16 (BW)", "S", 0.06833, 4320))
#: Reduced multiplication counts by dimension.
REDUCED_MULTIPLICATIONS = {4: 8, 8: 30, 16: 84, 32: 498, 64: 1494}


def division_algebras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(DIVISION_ALGEBRAS), "name string, dim int, commutative boolean, associative boolean, alternative boolean, composition boolean, zero_divisors int, automorphisms string, lattice string, second_moment double")


def doubling_tower(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TOWER), "name string, dim int, associative boolean, alternative boolean, composition boolean, power_associative boolean, zero_divisor_pairs int, reduced_mults int, standard_mults int")


def exceptional_algebras(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(EXCEPTIONAL_ALGEBRAS), "name string, rank int, dimension int, roots int")


def barnes_wall(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(BARNES_WALL), "dim int, lattice string, algebra string, second_moment double, roots int")


def multiplications(spark: SparkSession, dims: tuple[int, ...] = (2, 4, 8, 16, 32, 64)) -> DataFrame:
    """(dim, standard, reduced, speedup, reduction_pct); the last three null where no reduced count is known."""
    rows = []
    for d in dims:
        r = REDUCED_MULTIPLICATIONS.get(d)
        rows.append((d, d * d, r, d * d / r if r else None, (1 - r / (d * d)) * 100 if r else None))
    return spark.createDataFrame(rows, "dim int, standard int, reduced int, speedup double, reduction_pct double")


def methods(spark: SparkSession, d: int = 128) -> DataFrame:
    """(rotation, codebook, bits, params, mults, isometric) of the combinations that fit d."""
    log = int(math.log2(d))
    rows = [("haar", "lloyd_max", 3, d * d, d * d, True), ("wht", "lloyd_max", 3, 2 * d, d * log, True)]
    rows += [(f"cd{b}", "lloyd_max", 3, d, d // b * REDUCED_MULTIPLICATIONS[b], b <= 8) for b in (4, 8, 16) if d % b == 0]
    rows += [("e8block", "e8", 3, d // 2, d // 16 * REDUCED_MULTIPLICATIONS[8], True)] if d % 16 == 0 else []
    rows += [("clifford", "lloyd_max", 3, d // 3 * 4, d // 3 * 16, True), ("wht", "kmeans", 3, 2 * d, d * log, True)]
    return spark.createDataFrame(rows, "rotation string, codebook string, bits int, params int, mults int, isometric boolean")
