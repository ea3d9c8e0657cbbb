"""Positions, halos and transforms against one window or NumPy for all."""

import numpy as np
import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from loomvec.operators import analytics as Y
from loomvec.operators import sequences as H


def table(spark, n=120, d=8, seed=0):
    rng = np.random.default_rng(seed)
    ids = rng.permutation(n * 7)[:n]
    rows = [(0, int(i % 3) if i % 11 else None, int(i), rng.standard_normal(d).tolist()) for i in ids]
    return spark.createDataFrame(rows, "b int, h int, k long, a array<double>").repartition(4)


@pytest.mark.parametrize("chunk", [1, 16, 100_000])
def test_positions(spark, chunk):
    t = table(spark)
    got = H.numbered(t, "k", ("b", "h"), "s", chunk)
    want = t.withColumn("s", (F.row_number().over(W.partitionBy("b", "h").orderBy("k")) - 1).cast("long"))
    assert got.columns == want.columns and got.exceptAll(want).count() == 0 and got.count() == 120
    assert [r["s"] for r in H.numbered(t, "k", chunk=chunk).orderBy("k").collect()] == list(range(120))
    same = spark.createDataFrame([(1,), (1,), (None,), (5,)], "k int")
    assert sorted(r["s"] for r in H.numbered(same, "k", chunk=chunk).collect()) == [0, 1, 2, 3] and H.numbered(same.limit(0), "k").count() == 0


@pytest.mark.parametrize("block", [2, 3, 7, 1000])
def test_halos_reach_into_the_next_blocks(spark, block):
    t = H.numbered(table(spark), "k", ("b", "h"), "s")
    w = W.partitionBy("b", "h").orderBy("s")
    got = H.following(t, ("a",), "s", ("b", "h"), block)
    want = t.withColumn("a1", F.lead("a", 1).over(w)).withColumn("a2", F.lead("a", 2).over(w))
    assert got.count() == 120 and got.exceptAll(want.select(*got.columns)).count() == 0
    got = H.trailing_sum(t.withColumn("x", F.col("k").cast("double")), "x", "s", ("b", "h"), 2, "y", block)
    want = t.withColumn("x", F.col("k").cast("double")).withColumn("y", F.sum("x").over(w.rowsBetween(-2, 0)))
    assert got.exceptAll(want.select(*got.columns)).count() == 0 and got.count() == 120


@pytest.mark.parametrize("n", [1, 2, 12, 36, 100, 131])
def test_transforms_of_any_length(spark, n):
    """131 is a prime that goes by way of the chirp."""
    x = np.random.default_rng(n).standard_normal((n, 3))
    t = spark.createDataFrame([(i * 5, v.tolist()) for i, v in enumerate(x)], "vec_id long, vec array<double>").repartition(3)
    got = H.spectrum(t, "vec_id", chunk=64).orderBy("freq").collect()
    want = np.abs(np.fft.rfft(x, axis=0)) ** 2 / n
    assert [r["freq"] for r in got] == list(range(n // 2 + 1)) and np.allclose([r["power"] for r in got], want)


def test_a_spectrum_by_channel_and_of_nothing(spark):
    t = spark.createDataFrame([(i, [1.0, float(i)]) for i in range(6)] + [(9, None)], "vec_id long, vec array<double>")
    rows = {(r["ch"], r["freq"]): r["power"] for r in Y.coordinate_spectrum(t).collect()}
    assert len(rows) == 8 and rows[0, 0] == pytest.approx(6) and rows[1, 0] == pytest.approx(225 / 6)
    assert H.spectrum(t.limit(0), "vec_id").count() == 0
