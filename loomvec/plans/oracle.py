"""Pieces of DuckDB SQL that the registered queries are held against."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np


def num(x: float) -> str:
    """A double literal: an exponent keeps DuckDB from reading a decimal."""
    s = repr(float(x))
    return s if "e" in s else f"{s}e0"


def arr(v: Sequence[float]) -> str:
    return "[" + ", ".join(num(x) for x in v) + "]"


def mat(m: np.ndarray) -> str:
    return "[" + ", ".join(arr(r) for r in m) + "]"


#: vectors (vec_id, label, vec) and keys (b, h, s, k_id, vec) as CTEs.
V = "v as (select vec_id, label, [x::double for x in embedding] as vec from embeddings)"
KV = V + ", k as (select 0 as b, label as h, row_number() over (partition by label order by vec_id) - 1 as s, vec_id as k_id, vec from v)"


def dot(a: str, b: str) -> str:
    return f"list_sum([{a}[i] * {b}[i] for i in range(1, len({a}) + 1)])"


def norm(a: str) -> str:
    return f"sqrt({dot(a, a)})"


def matvec(m: str, v: str) -> str:
    """m is the name of a list of lists."""
    return f"[list_sum([r[i] * {v}[i] for i in range(1, len(r) + 1)]) for r in {m}]"


def count_above(x: str, bounds: Sequence[float]) -> str:
    return "(" + " + ".join(f"({x} > {num(b)})::int" for b in bounds) + ")"


def r6(x: str, name: str) -> str:
    return f"round({x}, 6) + 0.0 as {name}"
