"""Token counts from the exact histogram of document lengths.

Documents are encoded once and counted by length, first within each batch, then over all; the
histogram has one row for each length that occurs. Sums from the longest length down answer every
question about a context limit: documents and tokens at or above it, tokens left when each document
is cut at it, quantiles. The sums run over blocks of lengths, so no task sees the whole histogram.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, narrow, read_table
from .tokens import encoder, paths

#: Lengths to a block of the two-step sums.
BLOCK = 1024


def histogram(docs: DataFrame, text: str = "text", tokenizer: tuple[str, str] | None = None) -> DataFrame:
    """(length long, n_docs long): how many texts have how many tokens. Null and empty texts have length 0; repeated rows count each."""
    files = tokenizer or paths()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = encoder(*files)
        seen: dict[int, int] = {}
        for batch in batches:
            for t in batch.column(0):
                n = len(code.encode(t.as_py()))
                seen[n] = seen.get(n, 0) + 1
        lengths = np.array(sorted(seen), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(lengths), pa.array([seen[int(n)] for n in lengths], pa.int64())], names=["length", "n_docs"])

    counted = narrow(docs, text=text).mapInArrow(run, "length long, n_docs long")
    return counted.groupBy("length").agg(F.sum("n_docs").alias("n_docs"))


def with_sums(hist: DataFrame) -> DataFrame:
    """The histogram with, for each length taken as a limit: docs_at_least, tokens_at_least, tokens_below, truncated_total, docs_total, tokens_total, rank (share of documents up to this length).

    hist is read twice; a table (see cut()) spares encoding twice. A limit between two lengths has the
    sums of the next longer one, its truncated total being tokens_below + limit * docs_at_least of that
    row; above the longest length it is tokens_total. truncated_totals() does so for given limits.
    Columns are hist's two; others of it are ignored, so names can't clash.
    """
    hist = hist.select("length", "n_docs")
    h = hist.withColumn("n_tokens", F.col("length") * F.col("n_docs")).withColumn("block", F.floor(F.col("length") / BLOCK))
    blocks = h.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    above = W.orderBy(F.col("block").desc()).rowsBetween(W.unboundedPreceding, -1)
    everything = W.partitionBy()
    blocks = blocks.select("block", *[F.coalesce(F.sum(c).over(above), F.lit(0)).alias(f"{c}_above") for c in "dt"], F.sum("d").over(everything).alias("docs_total"), F.sum("t").over(everything).alias("tokens_total"))
    inside = W.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(W.unboundedPreceding, 0)
    h = h.join(blocks, "block")
    h = h.withColumn("docs_at_least", F.sum("n_docs").over(inside) + F.col("d_above")).withColumn("tokens_at_least", F.sum("n_tokens").over(inside) + F.col("t_above"))
    below = F.col("tokens_total") - F.col("tokens_at_least")
    rank = (F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")) / F.col("docs_total")
    return h.select("length", "n_docs", "n_tokens", "docs_at_least", "tokens_at_least", below.alias("tokens_below"), (below + F.col("length") * F.col("docs_at_least")).alias("truncated_total"), "docs_total", "tokens_total", rank.alias("rank"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """(limit, tokens) for given context limits: tokens left when each document is cut at the limit."""
    cut_at = [F.sum(F.least(F.col("length"), F.lit(n)) * F.col("n_docs")).cast("long").alias(str(n)) for n in limits]
    pairs: list[Column] = [F.struct(F.lit(n).cast("long").alias("limit"), F.coalesce(F.col(str(n)), F.lit(0)).alias("tokens")) for n in limits]
    return hist.agg(*cut_at).select(F.explode(F.array(*pairs)).alias("x")).select("x.*")


def quantile(hist: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the smallest length that at least this share of the documents don't exceed; no row for an empty table."""
    h = with_sums(hist)
    return h.select(F.explode(F.array(*[F.struct(F.lit(s).alias("share"), F.when(F.col("rank") >= s, F.col("length")).alias("length")) for s in shares])).alias("x")).groupBy("x.share").agg(F.min("x.length").alias("length")).where("length is not null")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_sums(cut(histogram(read_table(spark, sf_dir, "documents"))))
