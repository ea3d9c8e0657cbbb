"""Water-filling, measured curves and structure factors."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.functions import algebra as A
from loomvec.operators import allocation as B


@pytest.mark.parametrize(("seed", "budget"), [(0, 3.1), (1, 2.0), (2, 5.9), (3, 0.5), (4, 9.0)])
def test_one_level_of_water(spark, seed, budget):
    rng = np.random.default_rng(seed)
    rows = [(i, int(rng.integers(1, 9)), float(np.exp(rng.normal() * 3)) if i else 0.0) for i in range(60)]
    t = spark.createDataFrame(rows, "region int, n int, variance double").repartition(3)
    got = B.fill(t, budget, 1, 6).orderBy("region").toPandas()
    n, goal = got.n.to_numpy(), got.goal.to_numpy()
    total = min(max(budget, 1), 6) * n.sum()
    assert (n * goal).sum() == pytest.approx(total) and goal.min() >= 1 and goal.max() <= 6
    level = goal - B.OPTIMAL_SLOPE * np.log(np.maximum(got.variance, 1e-30))
    mid = (goal > 1 + 1e-9) & (goal < 6 - 1e-9)
    if mid.any():
        water = level[mid].mean()
        assert np.allclose(level[mid], water) and (level[goal <= 1 + 1e-9] >= water - 1e-9).all() and (level[goal >= 6 - 1e-9] <= water + 1e-9).all()
    # Whole bits: floors, and one more in the order of what was cut off while it fits.
    base = np.floor(goal + 1e-9)
    frac, left, spent = np.round(np.maximum(goal - base, 0), 9), np.floor(total + 1e-6) - (n * base).sum(), 0
    for i in sorted(range(60), key=lambda i: (-frac[i], i)):
        spent += n[i] if frac[i] > 0 else 0
        base[i] += frac[i] > 0 and spent <= left
    assert (base == got.bits).all()


def test_one_region_equal_ones_and_none(spark):
    t = spark.createDataFrame([(i, 4, 1.0) for i in range(5)], "region int, n int, variance double")
    assert [r["bits"] for r in B.fill(t, 2.4).orderBy("region").collect()] == [3, 3, 2, 2, 2]
    assert B.fill(t.where("region = 0"), 3.0).first()["bits"] == 3 and B.fill(t.limit(0), 3.0).count() == 0


def test_measured_levels(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 16)) * np.linspace(0.1, 1, 16)
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(v.tolist(),) for v in x] + [(None,)], "vec array<double>").repartition(3)
    curve = B.level_curve(t).toPandas()
    assert len(curve) == 3 * 4 and (curve.sort_values("bits").groupby("level").mse.diff().dropna() < 0).all()
    table = {(r.level, r.bits): r.mse for r in curve.itertuples()}
    got = {r["level"]: r["bits"] for r in B.by_curve(B.level_curve(t), 16 * 3).collect()}
    error = lambda bits: sum(d * table[k, b] for k, (d, b) in enumerate(zip((4, 4, 8), bits, strict=True)))
    best = min(error(b) for b in itertools.product((2, 3, 4, 5), repeat=3) if sum(d * x for d, x in zip((4, 4, 8), b, strict=True)) <= 48)
    assert error([got[k] for k in range(3)]) <= best * 1.2 and sum(d * got[k] for k, d in enumerate((4, 4, 8))) <= 48
    m = {r["method"]: r for r in B.compare_with_uniform(t).collect()}
    assert set(m) == {"uniform", "variance", "curve"} and m["uniform"]["gain"] == 0 and m["curve"]["mse"] <= m["variance"]["mse"] + 1e-12 and m["curve"]["bits"] <= 3


def test_every_block_is_in_a_triplet(spark):
    rng = np.random.default_rng(2)
    x = rng.standard_normal((30, 32))
    t = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "k int, vec array<double>").repartition(4)
    r = B.structure_factors(t, 16, deal=F.col("k")).first()
    want = [A.associator(*x[3 * i : 3 * i + 3, 16 * j : 16 * j + 16]) for i in range(10) for j in range(2)]
    norms = [np.prod([np.linalg.norm(x[3 * i + k, 16 * j : 16 * j + 16]) for k in range(3)]) for i in range(10) for j in range(2)]
    assert r["triplets"] == 20 and r["assoc"] == pytest.approx(np.mean([np.linalg.norm(w) / (s + 1e-8) for w, s in zip(want, norms, strict=True)]))
    assert r["factor"] > 1 and r["error"] > 0 and B.structure_factor(t, 8) == 1.0 and B.structure_factor(t.limit(2), 16) == 1.0
    assert B.structure_factors(t, 16).first()["triplets"] == 20
