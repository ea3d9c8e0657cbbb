"""Rotations of tables of vectors.

Every rotation here is linear, and its inverse is its transpose (for left products of hypercomplex
elements too). So a family is a builder of one matrix on the driver, and one operator applies any of
them: a matrix product for each Arrow batch. The Hadamard family also has a form inside Catalyst.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import algebra as A
from ..functions import expr as E
from .codebooks import e8_roots


@dataclass(frozen=True)
class Rotation:
    """A named matrix; rotate is x -> M x, unrotate x -> M' x. `elements` is what its family needs to store."""

    name: str
    matrix: np.ndarray
    elements: int

    @property
    def d(self) -> int:
        return len(self.matrix)

    def rotate(self, x: np.ndarray) -> np.ndarray:
        return x @ self.matrix.T

    def unrotate(self, y: np.ndarray) -> np.ndarray:
        return y @ self.matrix

    def column(self, v: Column, back: bool = False) -> Column:
        return apply_matrix(self.matrix.T if back else self.matrix)(v)


def apply_matrix(m: np.ndarray) -> Callable[[Column], Column]:
    """An Arrow function of vectors: one matrix product a batch; null vectors stay null."""
    mt = np.ascontiguousarray(m.T)

    @F.pandas_udf("array<double>")
    def product(v: pd.Series) -> pd.Series:
        if not v.isna().any():
            return pd.Series(list(np.stack(v.to_numpy()) @ mt)) if len(v) else v
        return v.map(lambda x: None if x is None else x @ mt)

    return apart(product)


def apart(udf):
    """An Arrow function that the optimizer doesn't merge into expressions built on it, where it could end up inside a lambda."""
    return udf.asNondeterministic()


def rotate(df: DataFrame, rotation: Rotation, column: str = "vec", out: str = "rotated", back: bool = False) -> DataFrame:
    return df.withColumn(out, rotation.column(F.col(column), back))


def haar(d: int, seed: int = 42) -> Rotation:
    """Uniform over the orthogonal group: QR of a normal matrix with the signs of R's diagonal."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return Rotation("haar", q * np.where(np.diag(r) < 0, -1.0, 1.0), d * d)


def hadamard_matrix(d: int) -> np.ndarray:
    """Sylvester's, divided by sqrt(d)."""
    A.check_dim(d)
    h = np.ones((1, 1))
    while len(h) < d:
        h = np.block([[h, h], [h, -h]])
    return h / math.sqrt(d)


def wht_signs(d: int, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(seed)
    return rng.choice([-1.0, 1.0], d), rng.choice([-1.0, 1.0], d)


def wht(d: int, seed: int = 42) -> Rotation:
    """Hadamard between two random sign flips."""
    after, before = wht_signs(d, seed)
    return Rotation("wht", after[:, None] * hadamard_matrix(d) * before[None, :], 2 * d)


def wht_column(v: Column, d: int, seed: int = 42) -> Column:
    """The same inside Catalyst, by the fast transform."""
    after, before = wht_signs(d, seed)
    y = E.hadamard(F.zip_with(v, E.literal(before), lambda x, s: x * s), d)
    return F.zip_with(y, E.literal(after), lambda x, s: x * s)


def block_diagonal(blocks: list[np.ndarray], d: int) -> np.ndarray:
    """Blocks along the diagonal, ones where they end before d."""
    m, at = np.eye(d), 0
    for b in blocks:
        m[at : at + len(b), at : at + len(b)] = b
        at += len(b)
    return m


def hypercomplex(d: int, block: int = 8, seed: int = 42, sandwich: bool = False) -> Rotation:
    """Each block times a random unit element on its left; sandwich (blocks of 4): q x q*. Isometric up to blocks of 8."""
    if d % block:
        raise ValueError(f"{d} isn't a multiple of the block {block}")
    units = A.random_unit(d // block, block, seed)
    make = (lambda q: A.left_matrix(q) @ A.right_matrix(A.conjugate(q))) if sandwich and block == 4 else A.left_matrix
    return Rotation(f"cd{block}", block_diagonal([make(q) for q in units], d), d)


def hypercomplex_layers(d: int, blocks: tuple[int, ...] = (4, 8), seed: int = 42) -> Rotation:
    """One layer after the other, each with a seed of its own."""
    m = np.eye(d)
    for i, b in enumerate(blocks):
        m = hypercomplex(d, b, seed + 1000 * i).matrix @ m
    return Rotation("cd_layers", m, d * len(blocks))


def givens_rounds(d: int, n: int | None = None, seed: int = 42) -> list[list[tuple[int, int, float]]]:
    """Random plane rotations (i, j, angle), each put in the first round where neither coordinate is taken."""
    n = d * int(math.log2(d)) if n is None else n
    rng = np.random.default_rng(seed)
    pairs, angles = rng.integers(0, d, (n, 2)), rng.random(n) * 2 * math.pi
    rounds: list[list[tuple[int, int, float]]] = []
    busy: list[set[int]] = []
    for (i, j), a in zip(pairs.tolist(), angles.tolist(), strict=True):
        j = (i + 1) % d if i == j else j
        at = next((k for k, used in enumerate(busy) if i not in used and j not in used), None)
        if at is None:
            at = len(busy)
            busy.append(set())
            rounds.append([])
        busy[at] |= {i, j}
        rounds[at].append((i, j, a))
    return rounds


def kac(d: int, n: int | None = None, seed: int = 42) -> Rotation:
    """A walk of plane rotations, multiplied out round by round."""
    m, count = np.eye(d), 0
    for r in givens_rounds(d, n, seed):
        for i, j, a in r:
            c, s = math.cos(a), math.sin(a)
            m[[i, j]] = np.array([[c, -s], [s, c]]) @ m[[i, j]]
            count += 1
    return Rotation("kac", m, 3 * count)


def diverse_roots(n: int, seed: int = 42) -> np.ndarray:
    """E8 roots, each time the one whose least distance 1 - |dot| to those before is greatest, the first of equals.

    Dots of roots go up to 2, so a distance may be -1; -1 itself is never better than the start value."""
    roots = e8_roots()
    chosen = [seed % len(roots)]
    while len(chosen) < n:
        least = (1 - np.abs(roots @ roots[chosen].T)).min(1)
        least[chosen] = -np.inf
        chosen.append(int(least.argmax()) if least.max() > -1 else 0)
    return roots[chosen]


def e8_blocks(d: int, seed: int = 42) -> Rotation:
    """Blocks of 16 times an E8 root, normalised, as the first half of a sixteen-dimensional element."""
    if d % 16:
        raise ValueError(f"{d} isn't a multiple of 16")
    units = A.normalize(np.hstack([diverse_roots(d // 16, seed), np.zeros((d // 16, 8))]), 0.0)
    return Rotation("e8block", block_diagonal([A.left_matrix(u) for u in units], d), d // 2)


def clifford(d: int, seed: int = 42) -> Rotation:
    """Blocks of three under random rotors; what is left of d modulo 3 passes through."""
    rng = np.random.default_rng(seed)
    return Rotation("clifford", block_diagonal([A.rotor_matrix(A.rotor(rng)) for _ in range(d // 3)], d), 4 * (d // 3))


def hybrid(d: int, seed: int = 42) -> Rotation:
    """Hadamard, then blocks of 8."""
    return Rotation("hybrid", hypercomplex(d, 8, seed + 7777).matrix @ wht(d, seed).matrix, 3 * d)


def gram(df: DataFrame, column: str = "vec") -> tuple[int, np.ndarray, np.ndarray]:
    """(rows, sum of vectors, sum of outer products): one d x d partial from each partition."""

    def part(frames):
        n, s, g = 0, None, None
        for f in frames:
            if len(f):
                x = np.stack(f["v"].to_numpy())
                n, s, g = n + len(x), x.sum(0) + (0 if s is None else s), x.T @ x + (0 if g is None else g)
        if n:
            yield pd.DataFrame({"n": [n], "s": [s], "g": [g.ravel()]})

    # Partials are added up over the executors, so the driver sees one row a coordinate.
    parts = df.where(F.col(column).isNotNull()).select(F.col(column).alias("v")).mapInPandas(part, "n long, s array<double>, g array<double>")
    flat = parts.select("n", F.posexplode(F.concat("s", "g")).alias("i", "x")).groupBy("i").agg(F.sum("x").alias("x"), F.sum("n").alias("n"))
    rows = flat.orderBy("i").collect()
    if not rows:
        raise ValueError("no vectors")
    x = np.array([r["x"] for r in rows])
    d = int((math.sqrt(1 + 4 * len(x)) - 1) / 2)
    return rows[0]["n"], x[:d], x[d:].reshape(d, d)


def pca(df: DataFrame, column: str = "vec") -> Rotation:
    """Eigenvectors of the sample covariance, greatest first, fitted on a table. Vectors are rotated without centring."""
    n, s, g = gram(df, column)
    cov = (g - np.outer(s, s) / n) / max(1, n - 1)
    values, vectors = np.linalg.eigh(cov)
    return Rotation("pca", vectors[:, np.argsort(-values, kind="stable")].T, len(s) ** 2)


BUILDERS: dict[str, Callable[[int, int], Rotation]] = {"haar": haar, "wht": wht, "hybrid": hybrid, "e8block": e8_blocks, "clifford": clifford, "kac": kac}


def make(which: str | Rotation | None, d: int, seed: int = 42) -> Rotation:
    """By name: haar (None), wht, cd4, cd8 and so on, hybrid, e8block, clifford, kac; a Rotation is returned as it is."""
    if isinstance(which, Rotation):
        return which
    which = which or "haar"
    if which in BUILDERS:
        return BUILDERS[which](d, seed)
    m = re.fullmatch(r"cd(\d+)", which)
    if m:
        return hypercomplex(d, int(m[1]), seed)
    if which.startswith("cd"):
        raise ValueError(f"invalid block size in {which!r}: cd is followed by a number, such as cd8")
    raise ValueError(f"unknown rotation {which!r}; known are {', '.join(BUILDERS)} and cd<block>")


def quality(df: DataFrame, rotation: Rotation, column: str = "vec") -> DataFrame:
    """One row: invertibility_error, coord_variance, max_cross_corr, isometry_error of a rotation on a table."""
    t = df.select(F.col(column).alias("x")).withColumn("y", rotation.column(F.col("x"))).withColumn("back", rotation.column(F.col("y"), True))
    whole = t.agg(
        (F.sqrt(F.sum(E.dot(E.minus(F.col("x"), F.col("back")), E.minus(F.col("x"), F.col("back"))))) / F.sqrt(F.sum(E.dot(F.col("x"), F.col("x"))))).alias("invertibility_error"),
        F.avg(F.abs(E.norm(F.col("y")) / E.norm(F.col("x")) - 1)).alias("isometry_error"),
    )
    flat = t.select(F.posexplode("y").alias("i", "v"), F.expr("array_append(slice(y, 2, size(y) - 1), cast(null as double))").alias("nexts")).select("i", "v", F.get("nexts", F.col("i")).alias("w"))
    by = flat.groupBy("i").agg(F.var_samp("v").alias("var"), F.abs(F.corr("v", "w")).alias("corr"))
    return whole.crossJoin(by.agg(F.avg("var").alias("coord_variance"), F.max("corr").alias("max_cross_corr")))
