"""Trials against the operators that they put together."""

import numpy as np
import pytest

from loomvec.operators import compressors as P
from loomvec.operators import scoring as S
from loomvec.plans import evaluation
from loomvec.plans import trials as T

D = 16


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(3)
    x = rng.standard_normal((200, D))
    keys = spark.createDataFrame([(i % 2, i % 3, i, v.tolist()) for i, v in enumerate(x)] + [(0, 0, 999, None)], "layer int, head int, k_id long, vec array<double>").repartition(3)
    q = keys.where("k_id in (0, 1, 2, 3, 4, 5, 12)").selectExpr("layer", "head", "k_id as q_id", "vec as q", "k_id as target")
    return keys, q


def test_one_setting_is_what_the_compressor_gives(spark, tables):
    keys, q = tables
    one = {"a": T.setting(D, 3)}
    t = T.trials(keys, q, one)
    rows = {r["q_id"]: r for r in t.collect()}
    k2, q2 = keys.where("vec is not null").withColumnsRenamed({"layer": "b", "head": "h"}), q.withColumnsRenamed({"layer": "b", "head": "h"}).drop("target")
    want = {(r["b"], r["h"]): r for r in evaluation.attention_fidelity(k2, q2, (3,)).collect()}
    got = {(r["layer"], r["head"]): r for r in T.summary(t, one, levels=(("layer", "head"),)).collect()}
    assert set(got) == set(want) and all(got[k][c] == pytest.approx(want[k][c]) for k in want for c in ("cosine", "top1", "top5"))
    c = P.KeyCompressor(D, 3, "wht")
    e = S.errors(S.all_scores(q2, k2.withColumnRenamed("vec", "k")), c.scores(q2, c.compress(k2))).first()
    whole = T.summary(t, one, levels=((),)).first()
    assert whole["queries"] == 7 and all(whole[k] == pytest.approx(e[k], abs=1e-9) for k in ("bias", "rmse", "corr"))
    assert rows[0]["n"] in (33, 34) and {r["hit"] for r in rows.values()} <= {0.0, 1.0}


def test_settings_side_by_side_and_groupings(spark, tables):
    keys, q = tables
    two = {"2": T.setting(D, 2), "4": T.setting(D, 4, "haar", False)}
    s = T.summary(T.trials(keys, q, two), two).collect()
    assert len(s) == 2 * (6 + 2 + 1) and {r["ratio"] for r in s} == {16 * D / (D * 2 + 32), 16 * D / (D * 4 + 32)}
    whole = {r["setting"]: r for r in s if r["layer"] is None}
    assert whole["4"]["rmse"] < whole["2"]["rmse"] and whole["4"]["corr"] > whole["2"]["corr"]
    assert T.trials(keys, q.limit(0), two).count() == 0
