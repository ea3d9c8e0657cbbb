"""Column expressions on vectors (array<double>), all inside Catalyst.

A value that a lambda uses for every element is bound once with let(): the optimizer would
otherwise compute it again for each element.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def doubles(v: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double"))


def literal(values: Sequence[float]) -> Column:
    return F.array(*[F.lit(float(x)) for x in values])


def total(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda a, x: a + x)


def dot(a: Column, b: Column) -> Column:
    return total(F.zip_with(a, b, lambda x, y: x * y))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def _with(v: Column, by: Column, f: Callable[[Column, Column], Column]) -> Column:
    """f(x, by) of every element, with by computed once. Lambdas aren't nested: what Arrow functions read must not hold any that are."""
    return F.zip_with(v, F.array_repeat(by, F.size(v)), f)


def scale(v: Column, by: Column) -> Column:
    return _with(v, by, lambda x, s: x * s)


def divide(v: Column, by: Column) -> Column:
    return _with(v, by, lambda x, s: x / s)


def unit(v: Column, eps: float = 1e-12) -> Column:
    """v / max(|v|, eps)."""
    return divide(v, F.greatest(norm(v), F.lit(eps)))


def unit_plus(v: Column, eps: float = 1e-8) -> Column:
    """v / (|v| + eps)."""
    return divide(v, norm(v) + F.lit(eps))


def cosine(a: Column, b: Column, eps: float = 1e-8) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(eps)) * F.greatest(norm(b), F.lit(eps)))


def plus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x + y)


def minus(a: Column, b: Column) -> Column:
    return F.zip_with(a, b, lambda x, y: x - y)


def clamp(x: Column, most: float = 65504.0) -> Column:
    """Into the range of 16-bit floats."""
    return F.greatest(F.lit(-most), F.least(F.lit(most), x))


def blocks(v: Column, size: int) -> Column:
    """array<array>: consecutive blocks; the length must be a multiple of size."""
    return let(v, lambda w: F.transform(F.sequence(F.lit(0), (F.size(w) / size).cast("int") - 1), lambda i: F.slice(w, i * size + 1, F.lit(size))))


def head(v: Column, size: int) -> Column:
    """The first `size` elements, zeros where v is shorter."""
    return F.slice(F.concat(v, F.array_repeat(F.lit(0.0), size)), 1, size)


def matvec(rows: Sequence[Sequence[float]], v: Column) -> Column:
    """A constant matrix times v."""
    m = F.array(*[literal(r) for r in rows])
    return let(v, lambda w: F.transform(m, lambda r: dot(r, w)))


def hadamard(v: Column, d: int) -> Column:
    """Fast Walsh-Hadamard transform of a vector of d = 2^k elements, divided by sqrt(d)."""
    places = F.sequence(F.lit(0), F.lit(d - 1))

    def level(v: Column, h: int) -> Column:
        pair = lambda w, i: F.when(i.bitwiseAND(F.lit(h)) == 0, F.get(w, i) + F.get(w, i + h)).otherwise(F.get(w, i - h) - F.get(w, i))
        return let(v, lambda w: F.transform(places, lambda i: pair(w, i)))

    h = 1
    while h < d:
        v = level(v, h)
        h *= 2
    return F.transform(v, lambda x: x / F.lit(float(d) ** 0.5))


def boundary_count(x: Column, bounds: Sequence[float]) -> Column:
    """How many boundaries x exceeds; a value on a boundary belongs below it."""
    out = F.lit(0)
    for b in bounds:
        out = out + F.when(x > F.lit(float(b)), 1).otherwise(0)
    return out


def boundary_counts(v: Column, bounds: Sequence[float]) -> Column:
    return F.transform(v, lambda x: boundary_count(x, bounds))


def look_up(idx: Column, table: Sequence[float]) -> Column:
    t = literal(table)
    return F.transform(idx, lambda i: F.element_at(t, (i + 1).cast("int")))


def signs(v: Column) -> Column:
    """1 where an element is at least zero, else -1."""
    return F.transform(v, lambda x: F.when(x >= 0, 1).otherwise(-1).cast("tinyint"))


def pack_signs(s: Column, d: int, width: int = 64) -> Column:
    """Words of `width` bits, lowest bit first, 1 for a positive sign; the last is filled with zeros."""
    words = []
    for w in range(-(-d // width)):
        here = min(width, d - w * width)
        part = F.slice(s, w * width + 1, here)
        bits = F.zip_with(part, F.sequence(F.lit(0), F.lit(here - 1)), lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long")))
        words.append(F.aggregate(bits, F.lit(0).cast("long"), lambda a, b: a.bitwiseOR(b)))
    return F.array(*words)


def unpack_signs(words: Column, d: int, width: int = 64) -> Column:
    def bit(w: Column, i: Column) -> Column:
        return F.call_function("shiftrightunsigned", F.get(w, (i / width).cast("int")), (i % width).cast("int")).bitwiseAND(F.lit(1).cast("long"))

    return let(words, lambda w: F.transform(F.sequence(F.lit(0), F.lit(d - 1)), lambda i: F.when(bit(w, i) == 1, 1).otherwise(-1).cast("tinyint")))


def packed_dot(words: Column, v: Column, d: int, width: int = 64) -> Column:
    """Sum of signs times values: twice the sum at positive signs less the whole sum."""
    positive = F.zip_with(unpack_signs(words, d, width), v, lambda s, x: F.when(s > 0, x).otherwise(0.0))
    return 2 * total(positive) - total(v)


def sketch_dot(words: Column, projected: Column, size: Column, m: int, width: int = 64) -> Column:
    """The inner product that a sketch of m signs stands for: the packed dot times |r| sqrt(pi / 2) / m."""
    return size * F.lit(math.sqrt(math.pi / 2) / m) * packed_dot(words, projected, m, width)


def packed_bytes(d: int, width: int = 64) -> int:
    return -(-d // width) * (width // 8)


def unpacked_bytes(d: int) -> int:
    return d


def packing_ratio(d: int) -> float:
    return unpacked_bytes(d) / packed_bytes(d)


def require_dim(df, column: str, multiple: int = 1, power_of_two: bool = False) -> int:
    """The length of the first vector; ValueError if it doesn't fit. An empty table has length 0."""
    row = df.select(F.size(column).alias("d")).where("d >= 0").first()
    d = row["d"] if row else 0
    if d % multiple or power_of_two and d & (d - 1):
        raise ValueError(f"vectors of length {d} don't fit: {'a power of two' if power_of_two else f'a multiple of {multiple}'} is needed")
    return d
