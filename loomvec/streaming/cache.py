"""An append-only cache of compressed keys and values, fed by Structured Streaming.

Compression of a chunk needs nothing from others (the scalar quantizer is fixed beforehand), so the
stream is a map without state and its sink a table. Quantizers with a fitted scale and normalisation
over a chunk run in foreachBatch: the first batch fits, later ones use the stored model.
"""

from __future__ import annotations

import json

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import normalize as N
from ..operators import quantizers as Q
from ..operators import rotations as R
from ..operators.packed import PackedKeys
from ..sources.vectors import load_constants, save_constants


class Cache:
    """Keys with a sketched residual and values, both as packed records; chunks in folders of <path>/rows.

    A record has a key's codes, the signs of its sketch and the norm of its residual, and a value's codes;
    vectors are taken to be of unit norm.
    """

    def __init__(self, spark: SparkSession, path: str, d: int, bits: int = 3, seed: int = 42, rotation: str = "wht", norm_type: str = "<f2") -> None:
        self.spark, self.path, self.d, self.bits = spark, path.rstrip("/"), d, bits
        self.keys = PackedKeys(d, bits, rotation, seed, use_nsn=False, unit=False, norm_types=norm_type, sketch_seed=seed + 1)
        self.values = PackedKeys(d, bits, rotation, seed + 100, use_nsn=False, use_qjl=False, unit=False)

    def compress(self, chunk: DataFrame) -> DataFrame:
        """(pos, k, v, ...) -> (pos, ..., key, value): narrow maps, the same for a batch and a stream."""
        return self.values.compress(self.keys.compress(chunk, "k", "key"), "v", "value")

    def _folder(self, chunk_id: int) -> str:
        return f"{self.path}/rows/chunk_id={chunk_id}"

    @staticmethod
    def _first(read) -> Row | None:
        """The first row of a table that may not be there."""
        try:
            return read().first()
        except AnalysisException:
            return None

    def append(self, chunk: DataFrame, chunk_id: int) -> None:
        """Adds a chunk under its number; a number that is there already is an error."""
        self.compress(chunk).write.mode("errorifexists").parquet(self._folder(chunk_id))

    def stream(self, source: DataFrame, checkpoint: str, first: int = 0) -> StreamingQuery:
        """Appends every micro-batch of a streaming (pos, k, v); the chunk is the batch's number, counted from `first`.

        A batch that is retried after a failure replaces its own chunk. Beside append() or another
        stream on one path, `first` keeps numbers apart; a new stream whose first chunk is there is an error.
        """

        def write(batch: DataFrame, number: int) -> None:
            chunk, mark = self._folder(first + number), f"{self.path}/marks/chunk_id={first + number}"
            owner = self._first(lambda: self.spark.read.schema("value string").json(mark))
            if owner is None and self._first(lambda: self.spark.read.parquet(chunk)) is not None:
                raise ValueError(f"chunk {first + number} is there already")
            if owner is not None and owner["value"] != checkpoint:
                raise ValueError(f"chunk {first + number} belongs to another stream")
            # The mark comes first: whatever a failed try left under it may be replaced.
            self.spark.createDataFrame([(checkpoint,)], "value string").coalesce(1).write.mode("overwrite").json(mark)
            self.compress(batch).write.mode("overwrite").parquet(chunk)

        return source.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

    def rows(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/rows")

    def scores(self, query: list[float]) -> DataFrame:
        """(chunk_id, pos, score) of one query over all chunks so far, by its tables."""
        return self.rows().select("chunk_id", "pos", self.keys.score(query, F.col("key")).alias("score"))

    def get_values(self) -> DataFrame:
        """(chunk_id, pos, v): values restored, in the order of chunks and positions for whoever sorts by them."""
        return self.rows().select("chunk_id", "pos", self.values.rebuild(F.col("value")).alias("v"))

    def __len__(self) -> int:
        return self.rows().count()

    def memory(self) -> DataFrame:
        """One row: rows, bits of keys and of values as stored, those of 16-bit floats, and the ratio."""
        bits = lambda c: F.coalesce(F.sum(F.length(c).cast("long")) * 8, F.lit(0))
        t = self.rows().agg(F.count("*").alias("rows"), bits("key").alias("key_bits"), bits("value").alias("value_bits"))
        t = t.withColumn("half_bits", F.col("rows") * (2 * self.d * 16))
        total = F.col("key_bits") + F.col("value_bits")
        return t.withColumn("ratio", F.when(total > 0, F.col("half_bits") / total).otherwise(0.0))

    def memory_bits(self) -> int:
        row = self.memory().first()
        return row["key_bits"] + row["value_bits"]

    def windowed(self, sink: int = N.SINK, recent: int = N.RECENT) -> DataFrame:
        """rows() with whether each position is read quantized. The window moves as the stream grows, so it is applied when reading."""
        total = len(self)
        return self.rows().withColumn("quantized", N.quantizes(F.col("pos"), F.lit(total), sink, recent))


def running_totals(stream: DataFrame, key: str) -> DataFrame:
    """Rows and vector elements by key over a stream so far (complete mode)."""
    return stream.groupBy(key).agg(F.count("*").alias("rows"), F.sum(F.size("vec")).alias("elements"))


def fit_on_first(spark: SparkSession, stream: DataFrame, path: str, checkpoint: str, quantizer: Q.E8 | Q.Codebook, rotation: R.Rotation, column: str = "vec") -> StreamingQuery:
    """Streams vectors through a quantizer whose scale the first batch fits; the scale is stored beside the rows."""

    def write(batch: DataFrame, number: int) -> None:
        t = R.rotate(batch, rotation, column, "_rot")
        if number == 0:
            save_constants(spark, f"{path}/model", scale=quantizer.fit(t, "_rot").scale)
        scale = load_constants(spark, f"{path}/model")["scale"]
        fitted = Q.E8(scale, quantizer.method, quantizer.mode) if isinstance(quantizer, Q.E8) else Q.Codebook(quantizer.kind, quantizer.size, scale)
        t.withColumn("restored", rotation.column(fitted.round_trip(F.col("_rot")), back=True)).drop("_rot").write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def normalize_batches(stream: DataFrame, path: str, checkpoint: str, bits: int, column: str = "vec") -> StreamingQuery:
    """Streams vectors through normalisation and per-channel ranges of each batch; the batch's statistics are stored with its number."""

    def write(batch: DataFrame, number: int) -> None:
        t, mean = N.nsn(batch, column)
        Q.quantize_channels(t, "normalized", bits).withColumn("mean", F.lit(json.dumps(mean))).write.mode("overwrite").parquet(f"{path}/rows/batch_id={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
