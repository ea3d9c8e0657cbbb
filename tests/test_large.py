"""Composite queries that met the findings on large tables: the same figures as the plain forms, and what they leave to shuffle."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomvec.functions import expr as E
from loomvec.operators import analytics as Y
from loomvec.operators import compressors as P
from loomvec.operators import packed as K
from loomvec.operators import quantizers as Q
from loomvec.operators import rotations as R
from loomvec.operators import scoring as S
from loomvec.plans import evaluation
from loomvec.plans import trials as T

D = 16


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def vectors(spark, n=300, d=D, copies=1):
    x = np.random.default_rng(5).standard_normal((n, d))
    rows = [(i + n * c, v.tolist()) for c in range(copies) for i, v in enumerate(x)] + [(10_000, None)]
    return spark.createDataFrame(rows, "vec_id long, vec array<double>").repartition(3)


def test_quantizers_make_no_pairs(spark):
    t = vectors(spark)
    got = {r["quantizer"]: r for r in evaluation.quantizer_benchmark(t, ("scalar", "e8")).collect()}
    rows = t.where("vec is not null")
    for name, bits in (("scalar", 3), ("e8", 1)):
        m = P.Mse(D, bits, "wht", name, 42).fit(rows)
        r = m.transform(rows).orderBy("vec_id").toPandas()
        k, y = np.stack(r["vec"].to_numpy()), np.stack(r["restored"].to_numpy())
        q = k[r["vec_id"].to_numpy() % 50 == 0]
        a, b = (q @ k.T).ravel(), (q @ y.T).ravel()
        want = {"mse": ((k - y) ** 2).mean(), "bias": (b - a).mean(), "rmse": np.sqrt(((b - a) ** 2).mean()), "corr": np.corrcoef(a, b)[0, 1]}
        assert all(got[name][c] == pytest.approx(w, abs=1e-10) for c, w in want.items())
    plan = plan_of(evaluation.quantizer_benchmark(t, ("scalar",)))
    assert "block" not in plan and E.require_dim(t, "vec") == D
    none = evaluation.quantizer_benchmark(t.where("vec_id % 50 > 0"), ("scalar",)).first()
    assert none["mse"] > 0 and none["bias"] is None


def grouped(spark, n=400, copies=1, heads=3):
    t = vectors(spark, n, copies=copies).selectExpr("0 as b", f"cast(vec_id % {heads} as int) as h", "vec_id as k_id", "vec")
    return t, t.where("k_id % 50 = 0").selectExpr("b", "h", "k_id as q_id", "vec as q")


def brute(k, q, c, scaled=False):
    """By query: (sum of exact, of estimated scores, whether best keys agree, whether the exact best is among five) from whole matrices."""
    x, y = q @ k.T, q @ c.rows(k, scaled).T
    best = x.round(10).argmax(axis=1)
    above = (y > y[np.arange(len(q)), best][:, None] + 1e-12).sum(axis=1)
    return x.sum(axis=1), y.sum(axis=1), (y.round(10).argmax(axis=1) == best).astype(float), (above < 5).astype(float), (x * y).sum(axis=1) / np.sqrt((x * x).sum(axis=1) * (y * y).sum(axis=1))


@pytest.fixture
def small_tiles(monkeypatch):
    """A group is many tiles, and a task has some."""
    monkeypatch.setattr(K, "KEYS", 7)
    monkeypatch.setattr(K, "QUERIES", 3)


def test_attention_over_many_tiles_and_copies(spark, small_tiles):
    k, q = grouped(spark, copies=2)
    settings = {b: T.setting(D, int(b)) for b in "24"}
    got = {(r["setting"], r["q_id"]): r for r in T.trials(k, q.withColumn("target", F.col("q_id")), settings, ("b", "h")).collect()}
    rows = k.where("vec is not null").orderBy("k_id").toPandas()
    for h in range(3):
        x, ids = np.stack(rows[rows["h"] == h]["vec"].to_numpy()), rows[rows["h"] == h]["k_id"].to_numpy()
        at = ids % 50 == 0
        for b, c in settings.items():
            for i, *want in zip(ids[at], *brute(x, x[at], c), strict=True):
                r = got[b, int(i)]
                assert [r[f] for f in ("x", "y", "top1", "top5", "cos")] == pytest.approx(want, abs=1e-9) and r["n"] == len(x)
    # No pair of vectors is a row: what meets are tiles.
    plan = plan_of(T.trials(k, q.withColumn("target", F.col("q_id")), settings, ("b", "h")))
    assert "q_ids" in plan and "max_by" not in plan


def test_ablation_is_one_pass(spark, small_tiles):
    k, q = grouped(spark, 300)
    k = k.withColumn("vec", F.transform("vec", lambda x, i: F.when(i == 3, x * 10).otherwise(x)))
    got = {(r["step"], r["h"]): r for r in evaluation.ablation(k, q).collect()}
    assert len(got) == 5 * 3
    rows, queries = k.where("vec is not null").orderBy("k_id").toPandas(), q.where("q is not null").orderBy("q_id").toPandas()
    mean = T.setting(D, 3).fit(k).mean
    for i, (name, rotation, nsn) in enumerate((("haar", "haar", False), ("wht", "wht", False), ("nsn", "wht", True), ("packing", "wht", True), ("scaling", "wht", True))):
        c = T.setting(D, 3, rotation, nsn)
        c.mean = mean if nsn else None
        for h in range(3):
            x, y = (np.stack(t[t["h"] == h][v].to_numpy()) for t, v in ((rows, "vec"), (queries, "q")))
            _, _, top1, top5, cos = brute(x, y, c, name == "scaling")
            r = got[f"{i} {name}", h]
            assert [r["cosine"], r["top1"], r["top5"]] == pytest.approx([cos.mean(), top1.mean(), top5.mean()], abs=1e-9)
    plan = plan_of(evaluation.ablation(k, q))
    assert plan.split("Initial Plan")[-1].count("q_ids") and plan.count("Union") == 0  # five steps, one pass


def test_best_keys_are_those_of_scores_with_copies_in_order(spark, small_tiles):
    k, q = grouped(spark, 150, copies=3)
    c = P.KeyCompressor(D, 3, "wht")
    packed = c.compress(k.where("vec is not null"))
    want = {}
    for r in c.scores(q.where("q is not null"), packed).collect():
        want.setdefault(r["q_id"], []).append((-round(r["score"], 10), r["k_id"]))
    found = c.best(q, packed, 5)
    got = {(r["q_id"], r["rank"]): (r["k_id"], r["score"]) for r in found.collect()}
    assert len(got) == 5 * len(want)
    for i, rows in want.items():
        for rank, (s, key) in enumerate(sorted(rows)[:5], 1):
            assert got[i, rank][0] == key and got[i, rank][1] == pytest.approx(-s, abs=1e-9)
    assert "q_ids" in plan_of(found)


def test_best_of_takes_the_lesser_ids_of_equal_scores():
    s, ids = np.array([[1.0, 2.0, 2.0, 2.0, np.nan], [0.0, 0.0, 0.0, 0.0, 0.0]]), np.array([5, 4, 3, 2, 1])
    assert ids[K.best_of(s, ids, 2)].tolist() == [[2, 3], [1, 2]] and K.best_of(s, ids, 9).shape == (2, 5) and K.best_of(s[:0], ids, 2).shape == (0, 2)


def test_quality_makes_no_pairs(spark, tmp_path):
    from loomvec.plans import queries as core

    x = np.random.default_rng(9).standard_normal((300, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    t = spark.createDataFrame([(i, v.tolist(), i % 3) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int")
    t.write.parquet(f"{tmp_path}/embeddings.parquet")
    found = core.queries()["estimate_quality"](spark, str(tmp_path))
    k, q = core.key_queries(spark, str(tmp_path))
    exact, c = S.all_scores(q, k.withColumnRenamed("vec", "k")), P.KeyCompressor(64, 4, "wht")
    est = c.scores(q, c.compress(k))
    want = S.errors(exact, est).crossJoin(S.top1_match(exact, est)).crossJoin(S.recall(exact, est)).first()
    got = found.first()
    assert all(got[n] == pytest.approx(want[n], abs=1e-6) for n in ("bias", "rmse", "corr", "top1_match", "recall"))
    assert "q_ids" in plan_of(found) and "Window" not in plan_of(found)


def test_rotations_of_heads_in_one_pass_over_batches(spark):
    t = vectors(spark, 60).selectExpr("'h' || vec_id % 3 as h", "7 * vec_id as s", "vec").unionByName(spark.createDataFrame([("few", i, [1.0] * D) for i in range(2)], "h string, s long, vec array<double>"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 4)
    try:
        got = {r["h"]: r for r in Y.per_head_rotation(t, ("wht", "haar")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert set(got) == {"h0", "h1", "h2", "few"} and got["few"]["rotation"] == "wht" and got["few"]["score"] is None
    want = {}
    for name in ("wht", "haar"):
        rot, q = R.make(name, D, 42), Q.Scalar(D, 3)
        x = t.where("vec is not null").select("h", "s", E.unit(F.col("vec")).alias("x")).withColumn("y", rot.column(q.round_trip(rot.column(F.col("x"))), True))
        cos = {r["h"]: r["c"] for r in x.groupBy("h").agg(F.avg(E.cosine(F.col("x"), F.col("y"))).alias("c")).collect()}
        f = Y.fidelity(Y.in_blocks(x, 8, {"x": "a", "y": "q"}, ("h", "s")), 8, group=("h", "block")).groupBy("h").agg(F.avg("ratio").alias("f"))
        for r in f.collect():
            want[r["h"], name] = 0.3 * (1 - min(abs(r["f"] - 1), 1)) + 0.7 * cos[r["h"]]
    for h in ("h0", "h1", "h2"):
        best = max(("wht", "haar"), key=lambda n: want[h, n])
        assert got[h]["rotation"] == best and got[h]["score"] == pytest.approx(want[h, best], abs=1e-9)
    # One pass for all candidates, and no block of eight is a row of a window.
    assert str(Y.per_head_rotation(t)._jdf.queryExecution().analyzed().toString()).count("MapInArrow") == 1


def test_scores_of_one_group_are_dealt_to_many_tasks(spark, small_tiles):
    t = vectors(spark, 200).selectExpr("0 as g", "vec_id as k_id", "vec")
    q = t.where("k_id % 50 = 0").selectExpr("g", "k_id as q_id", "vec as q")
    c = K.PackedKeys(D, 3, use_nsn=False, unit=False, norm_types="<f8")
    found = c.scores(q, c.compress(t), ("g",), places=5)
    got = {(r["q_id"], r["k_id"]): r["score"] for r in found.collect()}
    x = np.stack(t.where("vec is not null").orderBy("k_id").toPandas()["vec"].to_numpy())
    want = x[::50] @ c.rows(x).T
    assert len(got) == want.size == 4 * 200 and all(got[50 * i, j] == pytest.approx(want[i, j], abs=1.1e-5) and got[50 * i, j] == round(got[50 * i, j], 5) for i in range(4) for j in range(200))
    assert found.select(F.spark_partition_id()).distinct().count() > 1
