"""Hypercomplex (doubling) and Cl(3,0) algebra, from sign tables.

A product is bilinear and every product of two basis elements is a basis element with a sign, so one
table of signs and places gives the NumPy product, the Column expression and the SQL text alike. The
doubling rule is (a, b)(c, d) = (ac - d*b, da + bc*).
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import expr as E


def check_dim(d: int) -> int:
    if d < 1 or d & (d - 1):
        raise ValueError(f"the dimension must be a power of two, not {d}")
    return d


@lru_cache(16)
def doubling_signs(d: int) -> np.ndarray:
    """sign[i, j] of e_i e_j = sign e_(i xor j)."""
    if check_dim(d) == 1:
        return np.ones((1, 1), np.int8)
    h, s = d // 2, doubling_signs(d // 2)
    conj = np.where(np.arange(h) == 0, 1, -1)
    out = np.empty((d, d), np.int8)
    out[:h, :h] = s
    out[:h, h:] = s.T
    out[h:, :h] = s * conj[None, :]
    out[h:, h:] = -(s.T * conj[None, :])
    return out


#: Bits of the basis 1, e1, e2, e3, e12, e13, e23, e123.
_CL3 = (0, 1, 2, 4, 3, 5, 6, 7)


@lru_cache(1)
def clifford_table() -> list[list[tuple[int, int]]]:
    """(sign, place) of the product of basis elements of Cl(3,0): swaps that sort the factors, squares are 1."""
    def sign(a: int, b: int) -> int:
        swaps, a = 0, a >> 1
        while a:
            swaps += (a & b).bit_count()
            a >>= 1
        return -1 if swaps & 1 else 1

    return [[(sign(a, b), _CL3.index(a ^ b)) for b in _CL3] for a in _CL3]


@lru_cache(8)
def terms(kind: str, d: int) -> tuple[tuple[tuple[int, int, int], ...], ...]:
    """For each place of the product, its (sign, i, j), by i."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in range(d)]
    table = clifford_table() if kind == "clifford" else None
    signs = None if table else doubling_signs(d)
    for i in range(d):
        for j in range(d):
            s, k = table[i][j] if table else (int(signs[i, j]), i ^ j)
            out[k].append((s, i, j))
    return tuple(tuple(x) for x in out)


# NumPy, over the last axis


def multiply(a: np.ndarray, b: np.ndarray, kind: str = "doubling") -> np.ndarray:
    d = a.shape[-1]
    if kind == "clifford" and d != 8 or a.shape[-1] != b.shape[-1]:
        raise ValueError("dimensions of a product must agree")
    if kind != "clifford":
        check_dim(d)
    out = []
    for k in range(d):
        out.append(sum(s * a[..., i] * b[..., j] for s, i, j in terms(kind, d)[k]))
    return np.stack(out, axis=-1)


def conjugate(a: np.ndarray) -> np.ndarray:
    return a * np.where(np.arange(a.shape[-1]) == 0, 1.0, -1.0)


def inverse(a: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return conjugate(a) / ((a * a).sum(-1, keepdims=True) + eps)


def normalize(a: np.ndarray, eps: float = 1e-8) -> np.ndarray:
    return a / (np.sqrt((a * a).sum(-1, keepdims=True)) + eps)


def commutator(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return multiply(a, b) - multiply(b, a)


def associator(a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
    return multiply(multiply(a, b), c) - multiply(a, multiply(b, c))


def is_zero_divisor_pair(a: np.ndarray, b: np.ndarray, atol: float = 1e-6) -> np.ndarray:
    size = lambda x: np.sqrt((x * x).sum(-1))
    return (size(multiply(a, b)) < atol) & (size(a) > atol) & (size(b) > atol)


def left_matrix(a: np.ndarray) -> np.ndarray:
    """L with L x = a x."""
    d = len(a)
    return np.stack([multiply(a, e) for e in np.eye(d)], axis=1)


def right_matrix(a: np.ndarray) -> np.ndarray:
    """R with R x = x a."""
    d = len(a)
    return np.stack([multiply(e, a) for e in np.eye(d)], axis=1)


def random_unit(n: int, d: int, seed: int) -> np.ndarray:
    return normalize(np.random.default_rng(seed).standard_normal((n, check_dim(d))))


def reverse(a: np.ndarray) -> np.ndarray:
    """Of a multivector: elements of grade two and three change sign."""
    return a * np.array([1, 1, 1, 1, -1, -1, -1, -1.0])


def rotor(rng: np.random.Generator) -> np.ndarray:
    """A random unit rotor: a scalar and three bivector parts."""
    r = rng.standard_normal(4)
    r /= np.sqrt((r * r).sum())
    return np.array([r[0], 0, 0, 0, r[1], r[2], r[3], 0.0])


def rotor_matrix(r: np.ndarray) -> np.ndarray:
    """The 3x3 matrix of v -> r v reverse(r)."""
    cols = []
    for i in range(3):
        v = np.zeros(8)
        v[1 + i] = 1
        cols.append(multiply(multiply(r, v, "clifford"), reverse(r), "clifford")[1:4])
    return np.stack(cols, axis=1)


# Columns; a and b should be plain columns, for their elements are used many times


def product(a: Column, b: Column, d: int, kind: str = "doubling") -> Column:
    def place(k: int, x: Column, y: Column) -> Column:
        out = None
        for s, i, j in terms(kind, d)[k]:
            t = F.get(x, F.lit(i)) * F.get(y, F.lit(j))
            out = (t if s > 0 else -t) if out is None else (out + t if s > 0 else out - t)
        return out

    return E.let(F.struct(a.alias("a"), b.alias("b")), lambda p: F.array(*[place(k, p["a"], p["b"]) for k in range(d)]))


def conj(a: Column) -> Column:
    return F.transform(a, lambda x, i: F.when(i == 0, x).otherwise(-x))


def inverse_column(a: Column, eps: float = 1e-8) -> Column:
    return E.divide(conj(a), E.dot(a, a) + F.lit(eps))


def real_part(a: Column) -> Column:
    return F.get(a, F.lit(0))


def imag_part(a: Column) -> Column:
    return F.slice(a, F.lit(2), F.size(a) - 1)


def from_real(x: Column, d: int) -> Column:
    return F.concat(F.array(x), F.array_repeat(F.lit(0.0), d - 1))


def commutator_column(a: Column, b: Column, d: int) -> Column:
    return E.minus(product(a, b, d), product(b, a, d))


def associator_column(a: Column, b: Column, c: Column, d: int) -> Column:
    return E.minus(product(product(a, b, d), c, d), product(a, product(b, c, d), d))


def associator_norm_column(a: Column, b: Column, c: Column, d: int, eps: float = 1e-8) -> Column:
    """|[a, b, c]| over |a| |b| |c| + eps."""
    return E.norm(associator_column(a, b, c, d)) / (E.norm(a) * E.norm(b) * E.norm(c) + F.lit(eps))


def sandwich_column(r: Column, v: Column) -> Column:
    """r v reverse(r) in Cl(3,0)."""
    back = F.transform(r, lambda x, i: F.when(i >= 4, -x).otherwise(x))
    return product(product(r, v, 8, "clifford"), back, 8, "clifford")


def product_sql(a: str, b: str, d: int, kind: str = "doubling") -> str:
    """The same product as SQL text; a and b are names of lists."""
    places = []
    for k in range(d):
        t = "".join(f"{' + ' if s > 0 else ' - '}{a}[{i + 1}] * {b}[{j + 1}]" for s, i, j in terms(kind, d)[k])
        places.append(t[3:] if t.startswith(" + ") else t)
    return "[" + ", ".join(places) + "]"
