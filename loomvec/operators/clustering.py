"""k-means on given tables: seeds by oversampling in rounds, Lloyd rounds by partial sums of codewords.

Points are the blocks of a vector column. Centres (k x dim numbers) are part of the functions; points
stay where they are. What is drawn is drawn by a hash of a point's values, so it doesn't depend on how
rows are dealt out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import codebooks as C

DIM = 8


def blocks_of(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, the lowest of equals, squared distance) of each row."""
    at = np.concatenate([C.nearest_code(x[lo : lo + 65_536], centres) for lo in range(0, len(x), 65_536)]) if len(x) else np.zeros(0, np.int64)
    return at, ((x - centres[at]) ** 2).sum(axis=1)


def lloyd_sums(df: DataFrame, centres: np.ndarray, column: str = "vec") -> DataFrame:
    """(code, n, s, e): of each centre the points nearest to it, their sum and squared distances; a batch sends at most a row a centre."""
    dim = centres.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = blocks_of(b.column(0), dim)
            at, e = nearest(x, centres)
            some = np.unique(at)
            n = np.bincount(at, minlength=len(centres))[some]
            total = np.stack([np.bincount(at, weights=x[:, j], minlength=len(centres))[some] for j in range(dim)], axis=1) if len(x) else np.zeros((0, dim))
            lost = np.bincount(at, weights=e, minlength=len(centres))[some]
            yield pa.RecordBatch.from_arrays([pa.array(some.astype(np.int32)), pa.array(n.astype(np.int64)), pa.array(lost, pa.float64()), *[pa.array(total[:, j]) for j in range(dim)]], names=["code", "n", "e", *[f"s{j}" for j in range(dim)]])

    kinds = ", ".join(["code int", "n long", "e double", *[f"s{j} double" for j in range(dim)]])
    t = df.where(F.col(column).isNotNull()).select(column).mapInArrow(run, kinds).groupBy("code").agg(F.sum("n").alias("n"), F.sum("e").alias("e"), *[F.sum(f"s{j}").alias(f"s{j}") for j in range(dim)])
    return t.select("code", "n", F.array(*[f"s{j}" for j in range(dim)]).alias("s"), "e")


def step(df: DataFrame, centres: np.ndarray, column: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """(new centres, points of each, mean squared distance to the old ones an element). A centre without points stays where it is."""
    rows = lloyd_sums(df, centres, column).collect()  # one row a centre
    new, n = centres.copy(), np.zeros(len(centres), np.int64)
    for r in rows:
        new[r["code"]], n[r["code"]] = np.array(r["s"]) / r["n"], r["n"]
    return new, n, sum(r["e"] for r in rows) / max(1, n.sum() * centres.shape[1])


def drawn(df: DataFrame, column: str, dim: int, centres: np.ndarray | None, expected: float, cost: float, seed: int) -> np.ndarray:
    """Points drawn independently with probability expected * distance / cost (without centres: expected / cost), by a hash of their values; equal points are drawn once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = blocks_of(b.column(0), dim)
            weight = nearest(x, centres)[1] if centres is not None else np.ones(len(x))
            h = np.full(len(x), seed * 0x9E3779B97F4A7C15 % 2**64, np.uint64)
            for j in range(dim):
                h = (h ^ np.ascontiguousarray(x[:, j]).view(np.uint64)) * np.uint64(0xBF58476D1CE4E5B9)
                h ^= h >> np.uint64(29)
            u = (h * np.uint64(0x94D049BB133111EB) >> np.uint64(11)).astype(np.float64) / 2**53
            some = x[u * cost < expected * weight]
            yield pa.RecordBatch.from_arrays([pa.array(list(some), pa.list_(pa.float64()))], names=["x"])

    # About `expected` rows, whatever the size of the table.
    rows = df.where(F.col(column).isNotNull()).select(column).mapInArrow(run, "x array<double>").distinct().collect()
    return np.array(sorted(r["x"] for r in rows), np.float64).reshape(-1, dim)


def seeds(df: DataFrame, k: int, column: str = "vec", dim: int = DIM, rounds: int = 4, factor: float = 2.0, seed: int = 42) -> np.ndarray:
    """k centres: in each round about factor * k points are drawn by their distance from those before, then weighted by their points and thinned out."""
    n = df.where(F.col(column).isNotNull()).agg(F.sum(F.size(column))).first()[0] or 0
    points = n // dim
    if not points:
        raise ValueError("no vectors")
    c = drawn(df, column, dim, None, max(1.0, factor * k / 4), points, seed)
    for r in range(rounds):
        if not len(c):
            c = drawn(df, column, dim, None, 4.0 ** (r + 1) * k, points, seed + r + 1)
            continue
        _, m, error = step(df, c, column)
        cost = error * m.sum() * dim
        if cost <= 0:
            break
        c = np.unique(np.concatenate([c, drawn(df, column, dim, c, factor * k, cost, seed + r + 1)]), axis=0)
    weight = step(df, c, column)[1].astype(np.float64)
    rng, chosen = np.random.default_rng(seed), [int(weight.argmax())]
    near = ((c - c[chosen[0]]) ** 2).sum(axis=1)
    while len(chosen) < min(k, len(c)):
        p = weight * near
        at = int(rng.choice(len(c), p=p / p.sum())) if p.sum() > 0 else next(i for i in range(len(c)) if i not in chosen)
        chosen.append(at)
        near = np.minimum(near, ((c - c[at]) ** 2).sum(axis=1))
    return c[chosen]


def train(df: DataFrame, k: int, column: str = "vec", dim: int = DIM, rounds: int = 30, tolerance: float = 1e-6, seed: int = 42) -> tuple[np.ndarray, list[float]]:
    """(centres, the error before each round) on the blocks of a column. Fewer centres than k if the table has fewer different points.

    A centre that loses all its points moves to a point drawn by distance. Stops when a round gains less than `tolerance` of the error.
    """
    c, errors = seeds(df, k, column, dim, seed=seed), []
    for r in range(rounds):
        new, n, error = step(df, c, column)
        errors.append(error)
        dead = np.flatnonzero(n == 0)
        if len(dead) and error > 0:
            far = drawn(df, column, dim, c, 4.0 * len(dead), error * n.sum() * dim, seed + 1000 + r)
            new[dead[: len(far)]] = far[: len(dead)]
        c = new
        if len(errors) > 1 and errors[-2] - error <= tolerance * errors[-2]:
            break
    return c, errors
