"""The corpus pipeline: toxicity, near-duplicates, secrets, mixing, packing.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with the columns of
documents; the last returns the pieces of the packed sequences. run() writes every stage's result to
the shared folder and reads it again as the next stage's input.

In every stage null and empty texts are documents without words, texts of any length are worked on
whole, repeated rows are rows of their own (near-duplicates keeps one of them), an empty table gives an
empty table, and columns beside doc_id, text, source and n_chars pass through untouched, whatever their
names. What a stage does with ties is in the docstring of its operator.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomvec.llm import mixing, packing, secrets, similar, toxicity
from loomvec.llm.common import cut, private, read_table


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the grammar rejects go; it learns from labelled rows of these documents."""
    return toxicity.keep_clean(docs, toxicity.learn(docs, read_table(spark, sf_dir, "labels")))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one with the least id.

    Groups are SimHash's over five words: copies and the nearest of near copies. Fingerprints of 64 bits
    can't hold apart what has a similarity of 0.8 (about ten bits differ), so groups are also linked by
    the Jaccard similarity of five-word shingles, 0.8 or more, verified on whole texts.
    """
    return similar.keep_one(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document stays; reported spans are replaced by a mark, and n_chars follows the text."""
    out = secrets.redact(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns) if "n_chars" in docs.columns else out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: not at all, once or twice."""
    row, taken_row, copies, copy = (private(docs.columns, k) for k in ("row", "taken", "copies", "copy"))
    t = cut(docs.withColumn(row, F.monotonically_increasing_id()))
    taken = mixing.mix(t, row=row).where("copies > 0").select(F.col("row").alias(taken_row), F.col("copies").alias(copies))
    t = t.join(taken, F.col(row) == F.col(taken_row))
    return t.withColumn(copy, F.explode(F.sequence(F.lit(1), F.col(copies).cast("int")))).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents and their places in sequences of at most 2048 tokens."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", toxicity_filter),
    ("near_duplicates", near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]
#: The toxicity grammar, fingerprints and packing aren't SQL; tests/llm/test_pipeline.py holds run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over the documents in sf_dir."""
    docs = read_table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir))
    return docs
