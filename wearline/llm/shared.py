"""Small helpers of the training-data operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# White space of the word rule: blank and the controls from tab to carriage return.
SPACES = r"[ \t\n\x0B\f\r]+"
WORD = r"[^ \t\n\x0B\f\r]+"
BATCH_BYTES = 4 << 20


def limit_batches(spark: SparkSession) -> None:
    """Bound what one Arrow batch holds, so that very long texts don't meet in one task's memory."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def wrap(docs: DataFrame) -> DataFrame:
    """All columns in one struct ``doc``, so that a caller's column names never clash with ours."""
    limit_batches(docs.sparkSession)
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"))


def text_of(name: str = "doc.text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def let(value: Column, body) -> Column:
    """``body(value)`` with the value computed once, also inside lambda functions."""
    return F.transform(F.array(value), body)[0]


def read_documents(spark: SparkSession, sf_dir: str, name: str = "documents") -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
