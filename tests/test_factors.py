"""Low-rank factors and trained codebooks."""

import numpy as np
from pyspark.sql import functions as F

from loomvec.operators import clustering as G
from loomvec.operators import factors as U
from loomvec.operators import quantizers as Q

SCHEMA = "b int, h int, k_id long, vec array<double>"


def low_rank(spark, n=90, d=12, rank=3, noise=0.0, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.standard_normal((n, rank)) @ rng.standard_normal((rank, d)) + noise * rng.standard_normal((n, d))
    return x, spark.createDataFrame([(0, i % 2, i, v.tolist()) for i, v in enumerate(x)] + [(0, 0, 1000, None)], SCHEMA).repartition(3)


def test_pairs_against_numpy_and_their_residuals(spark):
    x, t = low_rank(spark, noise=0.3)
    p = U.eigenpairs(U.grams(t)).orderBy("h", "k").toPandas()
    for h in (0, 1):
        part = p[p.h == h]
        want = np.linalg.svd(x[h::2])[1] ** 2
        assert np.allclose(part.value, want) and np.allclose(part.total, want.sum()) and (part.residual < 1e-9 * want.sum()).all() and (part.n == 45).all()
    shares = U.explained(U.eigenpairs(U.grams(t), rank=4), of_all=False).orderBy("h", "k").toPandas()
    assert np.allclose(shares[shares.k == 4].share, 1.0) and (shares.groupby("h").share.diff().dropna() >= 0).all()


def test_scores_from_factors(spark):
    x, t = low_rank(spark)
    rows, factors = U.factorize(t, 3)
    q = np.random.default_rng(5).standard_normal((2, 12))
    queries = spark.createDataFrame([(0, h, i, v.tolist()) for h in (0, 1) for i, v in enumerate(q)], "b int, h int, q_id int, q array<double>")
    got = U.factor_scores(queries, rows, factors).collect()
    assert len(got) == 180 and all(abs(r["score"] - q[r["q_id"]] @ x[r["k_id"]]) < 1e-9 for r in got)
    assert "vec" not in rows.columns and {len(r["u"]) for r in rows.collect()} == {3}
    r = U.ratio(rows, factors, 4).first()
    assert (r["original"], r["compressed"]) == (45 * 12 * 16, (45 * 3 + 3 * 12) * 4)
    # More directions than there is variance: those without any add nothing.
    rows, factors = U.factorize(t, 8)
    assert all(abs(r["score"] - q[r["q_id"]] @ x[r["k_id"]]) < 1e-6 for r in U.factor_scores(queries, rows, factors).collect())


def test_rank_within_a_budget(spark):
    x, t = low_rank(spark, noise=0.2)
    p = U.eigenpairs(U.grams(t))
    for metric in ("mse", "cosine"):
        for budget in (100, 400, 900, 3000):
            got = {r["h"]: r for r in U.rank_and_bits(p, budget, (2, 4, 8), metric=metric).collect()}
            for h in (0, 1):
                u, s, v = np.linalg.svd(x[h::2], full_matrices=False)
                best, choice = np.inf, (2, 1)
                for r in (2, 4, 8):
                    y = u[:, :r] * s[:r] @ v[:r]
                    e = ((x[h::2] - y) ** 2).mean() if metric == "mse" else 1 - (x[h::2] * y).sum() / np.linalg.norm(x[h::2]) / np.linalg.norm(y)
                    for b in (1, 2, 3, 4):
                        if (45 + 12) * r * b <= budget and e < best - 1e-9:
                            best, choice = e, (r, b)
                assert (got[h]["rank"], got[h]["bits"]) == choice


def test_training_on_a_table_finds_its_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.standard_normal((6, 8)) * 5
    x = centres[rng.integers(0, 6, 400)] + 0.05 * rng.standard_normal((400, 8))
    t = spark.createDataFrame([(i, np.concatenate([x[2 * i], x[2 * i + 1]]).tolist()) for i in range(200)] + [(999, None)], "vec_id int, vec array<double>").repartition(3)
    c, errors = G.train(t, 6, rounds=10)
    assert len(c) == 6 and max(np.linalg.norm(centres - v, axis=1).min() for v in c) < 0.1 and errors[-1] <= errors[0]
    again, _ = G.train(t.repartition(5), 6, rounds=10)
    assert np.allclose(np.sort(c, axis=0), np.sort(again, axis=0))
    q = Q.trained_codebook(t, 6)
    worst = t.where("vec is not null").withColumn("y", q.round_trip(F.col("vec"))).select(F.max(F.transform(F.zip_with("vec", "y", lambda a, b: F.abs(a - b)), lambda z: z)[0])).first()[0]
    assert worst < 0.5


def test_few_different_points(spark):
    t = spark.createDataFrame([(i, [float(i % 2)] * 8) for i in range(30)], "vec_id int, vec array<double>")
    c, errors = G.train(t, 5)
    assert len(c) == 2 and errors[-1] == 0
