"""Corpus statistics of an index."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.operators.index import SearchIndex


def document_counts(index: SearchIndex) -> DataFrame:
    """(field, doc_count): documents with a term in the field."""
    spark = index.docs.sparkSession
    return spark.createDataFrame([(f, s.doc_count) for f, s in index.stats.items()], "field string, doc_count long")


def term_counts(index: SearchIndex) -> DataFrame:
    """(field, term, count): occurrences in all documents."""
    return index.term_totals()


def term_idfs(index: SearchIndex) -> DataFrame:
    """(field, term, idf) by occurrences: ln(1 + (N - count + 0.5) / (count + 0.5))."""
    own = index.configured(index.config.but(idf="ttf", similarity="bm25"))
    counts = term_counts(index)
    return counts.select("field", "term", own.idf(F.col("field"), F.col("count"), F.col("count")).alias("idf"))


def top_terms(index: SearchIndex, field: str, k: int) -> DataFrame:
    return term_counts(index).where(F.col("field") == field).orderBy(F.desc("count"), "term").limit(k)


def indices_info(index: SearchIndex) -> DataFrame:
    """(partition, postings, terms, bytes) of each partition of the postings; bytes are those of terms and numbers."""
    p = index.postings.withColumn("partition", F.spark_partition_id())
    size = F.octet_length("term") + F.lit(24) + F.coalesce(F.size("positions"), F.lit(0)) * 4
    return p.groupBy("partition").agg(F.count("*").alias("postings"), F.countDistinct("field", "term").alias("terms"), F.sum(size).alias("bytes"))


def pretty(info: DataFrame) -> str:
    rows = info.orderBy("partition").collect()
    lines = [f"partition {r.partition}: {r.postings:,} postings of {r.terms:,} terms, {r.bytes:,} bytes" for r in rows]
    return "\n".join([f"{len(rows)} partitions, {sum(r.postings for r in rows):,} postings, {sum(r.bytes for r in rows):,} bytes", *lines])
