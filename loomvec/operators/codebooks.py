"""Scalar and eight-dimensional codebooks, built on the driver and small by construction."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sphere_density(x: float, d: int) -> float:
    """Density of a coordinate of a random unit vector in d dimensions."""
    if abs(x) >= 1:
        return 0.0
    return math.exp(math.lgamma(d / 2) - math.lgamma((d - 1) / 2)) / math.sqrt(math.pi) * (1 - x * x) ** ((d - 3) / 2)


def normal_density(x: float, d: int) -> float:
    """Its normal approximation, of variance 1/d."""
    return math.sqrt(d / (2 * math.pi)) * math.exp(-x * x * d / 2)


_NODES, _WEIGHTS = np.polynomial.legendre.leggauss(64)


def _moments(a: float, b: float, d: int, exact: bool) -> tuple[float, float, float]:
    """Integrals of 1, x and x**2 times the density over [a, b]."""
    if exact:
        a, b = max(a, -1.0), min(b, 1.0)
        x = (a + b) / 2 + (b - a) / 2 * _NODES
        w = _WEIGHTS * (b - a) / 2 * np.array([sphere_density(t, d) for t in x])
        return float(w.sum()), float((w * x).sum()), float((w * x * x).sum())
    r = math.sqrt(d)
    mass = 0.5 * (math.erf(b * r / math.sqrt(2)) - math.erf(a * r / math.sqrt(2)))
    fa, fb = normal_density(a, d), normal_density(b, d)
    return mass, (fa - fb) / d, mass / d + (a * fa - b * fb) / d


@lru_cache(64)
def lloyd_max(d: int, bits: int, exact: bool = False, most_rounds: int = 200, tolerance: float = 1e-10) -> tuple[tuple[float, ...], tuple[float, ...]]:
    """(centroids, boundaries) of the best scalar quantizer of a coordinate; stops after most_rounds as published results do."""
    n, s = 1 << bits, 1 / math.sqrt(d)
    c = [-3.5 * s + 7 * s * (i + 0.5) / n for i in range(n)]
    for _ in range(most_rounds):
        edges = [-10.5 * s, *((x + y) / 2 for x, y in itertools.pairwise(c)), 10.5 * s]
        new = []
        for i, (a, b) in enumerate(itertools.pairwise(edges)):
            mass, first, _ = _moments(a, b, d, exact)
            new.append(first / mass if mass > 1e-15 else c[i])
        shift = max(abs(x - y) for x, y in zip(c, new, strict=True))
        c = new
        if shift < tolerance:
            break
    return tuple(c), tuple((x + y) / 2 for x, y in itertools.pairwise(c))


def expected_distortion(d: int, bits: int, exact: bool = False) -> float:
    """Mean squared error of a coordinate under lloyd_max()."""
    c, b = lloyd_max(d, bits, exact)
    s = 1 / math.sqrt(d)
    edges = [-10.5 * s, *b, 10.5 * s]
    out = 0.0
    for x, (lo, hi) in zip(c, itertools.pairwise(edges), strict=True):
        m0, m1, m2 = _moments(lo, hi, d, exact)
        out += m2 - 2 * x * m1 + x * x * m0
    return out


# E8


@lru_cache(1)
def e8_roots() -> np.ndarray:
    """The 240 shortest vectors of E8: 112 with two entries +-1, 128 with entries +-1/2 and an even number of minus signs."""
    whole = [v for v in itertools.product((-1, 0, 1), repeat=8) if sum(map(abs, v)) == 2]
    half = [v for v in itertools.product((-0.5, 0.5), repeat=8) if sum(x < 0 for x in v) % 2 == 0]
    return np.array(whole + half, float)


#: Vectors in the first shells of E8, and its normalised second moment.
E8_SHELLS = (1, 240, 2160, 6720)
E8_SECOND_MOMENT = 0.07168


def e8_bits_per_dimension(shells: int = 1) -> float:
    """log2 of the points up to this shell, over eight."""
    return math.log2(sum(E8_SHELLS[: shells + 1])) / 8


def e8_nearest(x: np.ndarray, mode: str = "nearest") -> np.ndarray:
    """Nearest E8 point of each row of eight.

    mode "reference" moves the worst coordinate away from x where the sum is odd, as some published
    code does; about 44 % of the points of a unit normal source then aren't nearest.
    """
    def even(y: np.ndarray) -> np.ndarray:
        r = np.rint(y)
        left = y - r
        worst = np.abs(left).argmax(-1)
        at = np.take_along_axis(left, worst[..., None], -1)[..., 0]
        step = np.where(at >= 0, 1.0, -1.0) * (1 if mode == "nearest" else -1)
        odd = r.sum(-1) % 2 != 0
        out = r.copy()
        np.put_along_axis(out, worst[..., None], (np.take_along_axis(r, worst[..., None], -1)[..., 0] + step * odd)[..., None], -1)
        return out

    a, b = even(x), even(x - 0.5) + 0.5
    closer = ((x - b) ** 2).sum(-1) < ((x - a) ** 2).sum(-1)
    return np.where(closer[..., None], b, a)


#: Candidates of the scale search: rms / 2 to 8 rms, evenly on a log scale.
SCALE_STEPS = tuple(0.5 * 16.0 ** (i / 19) for i in range(20))


# Prefix-cut codebooks on {-1, 0, 1}^8

#: At each level, the prefixes that leave the set of the level above.
PREFIX_CUTS = {
    "2048": ((0, 1, 1), (0, 1, 0, 1, 1), (0, 1, 0, 1, 0, 1)),
    "1024": ((-1, 1, 1, 1), (-1, 1, 1, 0, 0), (-1, 1, 1, 0, 1)),
    "512": ((-1, 1), (-1, 0, 1), (-1, 0, 0, 0), (-1, 0, 0, 1), (-1, 0, 0, -1, 1), (-1, 0, 0, -1, 0, 1, 1)),
    "256": ((-1, 0), (-1, -1, 1, 1), (-1, -1, 1, 0), (-1, -1, 1, -1, 1), (-1, -1, 1, -1, 0), (-1, -1, 1, -1, -1, 1, 1, 1)),
    "32": (),
}
LEVELS = ("base", "2048", "1024", "512", "256", "32")
#: What a level asks of every point besides: 1024 and below begin with -1, 32 with four of them.
LEADS = {"1024": (-1,), "32": (-1, -1, -1, -1)}


def _has(p: tuple[int, ...], prefix: tuple[int, ...]) -> bool:
    return p[: len(prefix)] == prefix


def in_level(p: tuple[int, ...], level: str) -> bool:
    if level not in LEVELS:
        raise ValueError(f"unknown level {level!r}; levels are {', '.join(LEVELS)}")
    if p[0] == 1 or sum(p) % 2 or sum(x != 0 for x in p) % 2:
        return False
    for step in LEVELS[1 : LEVELS.index(level) + 1]:
        if step in LEADS and not _has(p, LEADS[step]) or any(_has(p, c) for c in PREFIX_CUTS[step]):
            return False
        if step == "32" and p[4] == 1 and p[5] != -1:
            return False
    return True


@lru_cache(8)
def prefix_codebook(level: str) -> np.ndarray:
    """Points of a level in the order of their digits."""
    return np.array([p for p in itertools.product((-1, 0, 1), repeat=8) if in_level(p, level)], float)


def prefix_codebook_table(spark: SparkSession, level: str) -> DataFrame:
    """(code, c array<double>): the same points enumerated by Spark, base-3 digits filtered by the level's rules."""
    t = spark.range(3**8).select(F.col("id"), F.array(*[(F.floor(F.col("id") / 3 ** (7 - i)) % 3 - 1).cast("int") for i in range(8)]).alias("p"))
    entry = lambda i: F.get("p", F.lit(i))
    starts = lambda prefix: _all([entry(i) == x for i, x in enumerate(prefix)])
    t = t.where((entry(0) != 1) & (F.pmod(F.aggregate("p", F.lit(0), lambda a, x: a + x), F.lit(2)) == 0) & (F.size(F.filter("p", lambda x: x != 0)) % 2 == 0))
    for step in LEVELS[1 : LEVELS.index(level) + 1]:
        if step in LEADS:
            t = t.where(starts(LEADS[step]))
        for c in PREFIX_CUTS[step]:
            t = t.where(~starts(c))
        if step == "32":
            t = t.where(~((entry(4) == 1) & (entry(5) != -1)))
    return t.select(F.col("id").alias("code"), F.transform("p", lambda x: x.cast("double")).alias("c"))


def _all(conditions: list):
    out = conditions[0]
    for c in conditions[1:]:
        out = out & c
    return out


def prefix_bits_per_dimension(level: str) -> float:
    return math.log2(len(prefix_codebook(level))) / 8


# k-means


@lru_cache(16)
def kmeans_codebook(n_codes: int, dim: int = 8, n_train: int = 10_000, rounds: int = 30, seed: int = 42) -> np.ndarray:
    """Codewords trained on unit normal points. Seeds are drawn in proportion to the distance; a codeword that loses all points moves to a random one."""
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n_train, dim))
    c = np.empty((n_codes, dim))
    c[0] = x[rng.integers(n_train)]
    near = np.sqrt(((x - c[0]) ** 2).sum(1))
    for i in range(1, n_codes):
        c[i] = x[rng.choice(n_train, p=near / near.sum())]
        near = np.minimum(near, np.sqrt(((x - c[i]) ** 2).sum(1)))
    for _ in range(rounds):
        at = nearest_code(x, c)
        n = np.bincount(at, minlength=n_codes)
        total = np.stack([np.bincount(at, weights=x[:, j], minlength=n_codes) for j in range(dim)], axis=1)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], x[rng.integers(0, n_train, n_codes)])
    return c


def nearest_code(x: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Number of the nearest codeword of each row, the lowest of equals."""
    return ((codes * codes).sum(1)[None, :] - 2 * x @ codes.T).argmin(1)


def rms(x: np.ndarray) -> float:
    return float(np.sqrt((x * x).mean()))
