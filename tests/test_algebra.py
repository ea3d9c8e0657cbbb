import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from loomvec.functions import algebra as A
from loomvec.functions import expr as E

numbers = st.floats(-4, 4, allow_nan=False, width=32)


def vectors(n):
    return st.lists(numbers, min_size=n, max_size=n).map(np.array)


def doubled(a, b):
    """The doubling rule written as recursion."""
    n = len(a)
    if n == 1:
        return a * b
    h = n // 2
    conj = lambda x: np.concatenate([x[:1], -x[1:]])
    x, y, z, w = a[:h], a[h:], b[:h], b[h:]
    return np.concatenate([doubled(x, z) - doubled(conj(w), y), doubled(w, x) + doubled(y, conj(z))])


@pytest.mark.parametrize("n", [1, 2, 4, 8, 16, 32])
def test_sign_table_is_the_doubling_rule(n):
    rng = np.random.default_rng(n)
    a, b = rng.standard_normal((2, n))
    assert np.allclose(A.multiply(a, b), doubled(a, b))


@settings(max_examples=50, deadline=None)
@given(vectors(8), vectors(8))
def test_norm_is_multiplicative_up_to_eight(a, b):
    size = lambda x: np.sqrt((x * x).sum())
    assert np.isclose(size(A.multiply(a, b)), size(a) * size(b), atol=1e-6)
    assert (A.conjugate(A.conjugate(a)) == a).all()


def test_quaternions_associate_and_octonions_do_not():
    rng = np.random.default_rng(0)
    q, o = rng.standard_normal((3, 4)), rng.standard_normal((3, 8))
    assert np.allclose(A.associator(*q), 0) and not np.allclose(A.associator(*o), 0)


def test_zero_divisors_of_sixteen():
    e = np.eye(16)
    assert A.is_zero_divisor_pair(e[1] + e[10], e[5] + e[14])
    assert not A.is_zero_divisor_pair(e[1], e[2])


def test_matrices_and_inverse():
    rng = np.random.default_rng(1)
    a, x = rng.standard_normal((2, 8))
    assert np.allclose(A.left_matrix(a) @ x, A.multiply(a, x)) and np.allclose(A.right_matrix(a) @ x, A.multiply(x, a))
    assert np.allclose(A.multiply(A.inverse(a), a), np.eye(8)[0], atol=1e-6)
    with pytest.raises(ValueError):
        A.check_dim(12)


def test_rotor_keeps_lengths():
    m = A.rotor_matrix(A.rotor(np.random.default_rng(2)))
    assert np.allclose(m @ m.T, np.eye(3))


def test_columns_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((2, 20, 8))
    t = spark.createDataFrame([(a.tolist(), b.tolist()) for a, b in zip(x, y, strict=True)], "a array<double>, b array<double>")
    for kind in ("doubling", "clifford"):
        got = np.array([r[0] for r in t.select(A.product(F.col("a"), F.col("b"), 8, kind)).collect()])
        assert np.allclose(got, A.multiply(x, y, kind))
    got = np.array([r[0] for r in t.select(A.inverse_column(F.col("a"))).collect()])
    assert np.allclose(got, A.inverse(x))


@settings(max_examples=25, deadline=None)
@given(st.lists(st.sampled_from([-1, 1]), min_size=1, max_size=130))
def test_packing_rule(signs):
    """The words' bits in Python, as pack_signs() lays them out."""
    words = [sum(1 << i for i, s in enumerate(signs[lo : lo + 64]) if s > 0) for lo in range(0, len(signs), 64)]
    assert [1 if words[i // 64] >> (i % 64) & 1 else -1 for i in range(len(signs))] == signs


@pytest.mark.parametrize(("d", "width"), [(10, 64), (64, 64), (100, 64), (128, 32), (50, 32)])
def test_pack_and_unpack(spark, d, width):
    rng = np.random.default_rng(d)
    rows = [(rng.choice([-1, 1], d).tolist(), rng.standard_normal(d).tolist()) for _ in range(10)] + [([1] * d, [1.0] * d)]
    t = spark.createDataFrame(rows, "s array<int>, v array<double>").withColumn("w", E.pack_signs(F.col("s"), d, width))
    out = t.select(E.unpack_signs(F.col("w"), d, width).alias("u"), E.packed_dot(F.col("w"), F.col("v"), d, width).alias("x"), F.size("w").alias("n")).collect()
    for (s, v), r in zip(rows, out, strict=True):
        assert r["u"] == s and np.isclose(r["x"], np.dot(s, v)) and r["n"] == -(-d // width)
