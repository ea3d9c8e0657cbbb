import numpy as np
import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from loomvec.operators import quantizers as Q
from loomvec.operators import rotations as R
from loomvec.sources import vectors as X
from loomvec.streaming import cache as S
from loomvec.streaming.stateful import first_batch_ranges

D = 16


def rows(spark, n, seed=0):
    rng = np.random.default_rng(seed)
    return spark.createDataFrame([(i, rng.standard_normal(D).tolist(), rng.standard_normal(D).tolist()) for i in range(n)], "pos int, k array<double>, v array<double>")


def test_stream_equals_batch(spark, tmp_path):
    t = rows(spark, 60)
    t.where("pos < 30").write.mode("append").parquet(str(tmp_path / "in"))
    t.where("pos >= 30").write.mode("append").parquet(str(tmp_path / "in"))
    a, b = S.Cache(spark, str(tmp_path / "a"), D), S.Cache(spark, str(tmp_path / "b"), D)
    source = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    a.stream(source, str(tmp_path / "check")).awaitTermination()
    b.append(t, 0)
    assert len(a) == len(b) == 60 and a.memory_bits() == b.memory_bits()
    q = np.random.default_rng(1).standard_normal(D).tolist()
    x, y = ({r["pos"]: r["score"] for r in c.scores(q).collect()} for c in (a, b))
    assert x.keys() == y.keys() and all(abs(x[i] - y[i]) < 1e-9 for i in x)
    assert a.rows().select("chunk_id").distinct().count() > 1
    assert a.get_values().count() == 60
    assert a.windowed(4, 20).where("quantized").count() == 36


def test_chunks_of_a_stream_and_of_append_on_one_path(spark, tmp_path):
    t = rows(spark, 40)
    t.where("pos >= 20").coalesce(1).write.parquet(str(tmp_path / "in"))
    c = S.Cache(spark, str(tmp_path / "c"), D)
    c.append(t.where("pos < 20"), 0)
    source = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    with pytest.raises(Exception, match="is there already"):
        c.stream(source, str(tmp_path / "check0")).awaitTermination()
    assert len(c) == 20
    for _ in range(2):  # a stream that is started again on its checkpoint adds nothing twice
        c.stream(source, str(tmp_path / "check1"), first=1).awaitTermination()
        assert len(c) == 40 and {r["pos"] for r in c.rows().collect()} == set(range(40))
    with pytest.raises(AnalysisException):
        c.append(t, 1)
    with pytest.raises(Exception, match="another stream"):
        c.stream(source, str(tmp_path / "check2"), first=1).awaitTermination()
    m = c.memory().first()
    assert m["key_bits"] == 40 * 8 * c.keys.layout.size == 40 * (D * 2 + D + 16) and m["value_bits"] == 40 * D * 3 and m["ratio"] == 2 * D * 16 / (D * 6 + 16)


def test_first_batch_fits_the_scale(spark, tmp_path):
    t = rows(spark, 20).select("pos", F.col("k").alias("vec"))
    for i in range(2):
        t.where(F.col("pos") % 2 == i).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    S.fit_on_first(spark, source, str(tmp_path / "out"), str(tmp_path / "check"), Q.E8(), R.make("wht", D)).awaitTermination()
    assert X.load_constants(spark, str(tmp_path / "out/model"))["scale"] > 0
    assert spark.read.parquet(str(tmp_path / "out/rows")).count() == 20


def test_statistics_of_each_batch_and_running_totals(spark, tmp_path):
    t = rows(spark, 20).select("pos", F.col("k").alias("vec"))
    t.coalesce(1).write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema(t.schema).parquet(str(tmp_path / "in"))
    S.normalize_batches(source, str(tmp_path / "out"), str(tmp_path / "check"), 3).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out/rows")).select("mean").distinct().count() == 1
    q = S.running_totals(source.withColumn("g", F.col("pos") % 2), "g").writeStream.outputMode("complete").format("memory").queryName("totals").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.sql("select g, rows, elements from totals").collect()} == {(0, 10, 160), (1, 10, 160)}


def test_ranges_live_in_the_state_of_a_query(spark, tmp_path):
    def run(rows):
        spark.createDataFrame(rows, "label int, vec_id long, vec array<double>").write.mode("append").parquet(str(tmp_path / "in"))
        source = spark.readStream.schema("label int, vec_id long, vec array<double>").parquet(str(tmp_path / "in"))
        first_batch_ranges(source, bits=2).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
        return {r["vec_id"]: (r["codes"], r["lo"], r["hi"], r["before"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}

    got = run([(1, 0, [0.0, 3.0]), (1, 1, [1.0, 2.0]), (2, 2, [5.0, 5.0]), (3, 3, None), (None, 4, [1.0, 1.0])])
    assert got == {0: ([0, 3], 0.0, 3.0, 0), 1: ([1, 2], 0.0, 3.0, 0), 2: ([0, 0], 5.0, 5.0, 0)}
    # Later: what lies outside is clamped, and a key that had no values yet gets its range now.
    got = run([(1, 5, [-9.0, 9.0]), (1, 6, None), (3, 7, [1.0, 4.0])])
    assert got[5] == ([0, 3], 0.0, 3.0, 2) and got[7] == ([0, 3], 1.0, 4.0, 0) and 6 not in got and len(got) == 5
    assert run([(1, 8, [2.0, 2.0])])[8] == ([2, 2], 0.0, 3.0, 3)


def test_affine_codes(spark):
    q = Q.Affine(0.5, 3, 3)
    t = spark.createDataFrame([([-9.0, -0.25, 0.25, 0.75, 0.6, 9.0],)], "v array<double>").select(q.quantize(F.col("v")).alias("i"))
    r = t.select("i", q.dequantize(F.col("i")).alias("v")).first()
    assert r["i"] == [0, 3, 3, 5, 4, 7] and r["v"] == [-1.5, 0.0, 0.0, 1.0, 0.5, 2.0]
