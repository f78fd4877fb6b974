"""Wikipedia XML dumps, split by page."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_PAGE = "title string, revision struct<text: string>"


def read_wikipedia(spark: SparkSession, path: str) -> DataFrame:
    """(title, text). A text with attributes, as in real dumps, and one without are both read."""
    read = lambda schema: spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return read(_PAGE).select("title", F.col("revision.text").alias("text"))


def parse_dump(spark: SparkSession, path: str, out: str, files: int = 50) -> None:
    read_wikipedia(spark, path).coalesce(files).write.mode("overwrite").parquet(out)
