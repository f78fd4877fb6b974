"""A training corpus from `documents`: quality filter, exact and near deduplication, decontamination, packing.

Every stage takes (spark, docs, sf_dir), where docs is the table that the stage before it wrote. All but the last return
the columns of `documents`; the last returns where each piece of each document goes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from fathomgrid.deploy import bounded, ship
from fathomgrid.llm.common import fresh_path, table
from fathomgrid.llm.decontaminate import decontaminate
from fathomgrid.llm.exact_dedup import exact_dedup
from fathomgrid.llm.near_dedup import near_dedup
from fathomgrid.llm.packing import packed
from fathomgrid.llm.quality import quality_filter


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical classifier keeps."""
    ship(spark)
    bounded(spark)
    return quality_filter(docs, table(spark, sf_dir, "labels"))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each text: the least doc_id."""
    ship(spark)
    bounded(spark)
    return exact_dedup(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the least doc_id."""
    ship(spark)
    bounded(spark)
    return near_dedup(docs)


def clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no item of `benchmark`."""
    ship(spark)
    bounded(spark)
    return decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The bin of 2,048 words that each piece of a document goes into."""
    ship(spark)
    bounded(spark)
    return packed(docs)


STAGES = [
    ("quality classifier", quality),
    ("exact dedup", exact),
    ("SimHash near-dedup", near),
    ("benchmark decontamination", clean),
    ("best-fit packing", pack),
]

#: The classifier is trained, and fingerprints and a linear program follow: no SQL states these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        path = fresh_path(spark, f"stage-{i}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
