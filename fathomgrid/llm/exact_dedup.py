"""Exact deduplication of a document stream over disk-backed keyed state.

A streaming aggregation keyed by the SHA-256 of the text keeps, in a RocksDB state store and with no watermark (so no
entry ever expires), the stable identifier and the content locator (file and row) of the first document by id, and the
count. The stream is JVM-side, and copies of one text combine before they are shuffled. Each micro-batch writes the
entries that it changed to the shared folder; the last version of an entry is the state. With a `checkpoint` of one's
own, state lasts from run to run: a later run reads new files only and meets the documents of earlier ones.

A hit is a digest with more than one document. Digests and locators alone say which rows hit; then the contents of these
rows are fetched by their locators and compared in full: where all texts of a digest are one text, its rows are copies,
and where they are not, each distinct text keeps its own first document. No text but those of hits is moved, and of
these only distinct ones, combined before the shuffle. A digest of more than `hot` rows meets them by a broadcast of
such digests, of which there are at most a `hot`-th of the rows.

Cases: null texts equal each other no more than SQL nulls do: they are all kept. Empty texts are equal texts, and a text
of any length is compared whole. Of rows that repeat the doc_id too, the first by locator stays, so ties are of no
account. A null doc_id sorts last. Empty tables give empty results. Columns of the table with any other name, those that
look like internal or metadata columns included, are carried, never read. A table that is not files as they lie (a
filter, some files of a folder, several folders) is written to the shared folder first.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fathomgrid.llm.common import columns, fitted, free, fresh_path, written
from fathomgrid.llm.locate import fetched, file_key, is_scan, row_groups, row_key

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
HOT = 1 << 20
_FIRST = "struct<none: boolean, id: bigint, f: bigint, row: bigint>"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text, 256))


def _located(df: DataFrame, digest) -> DataFrame:
    """(digest, id, f, row) of the rows that have a text."""
    return df.where(df["text"].isNotNull()).select(digest(df["text"]).alias("digest"), df["doc_id"].cast("long").alias("id"), file_key(df).alias("f"), row_key(df).alias("row"))


def _key() -> Column:
    return F.struct(F.col("id").isNull().alias("none"), "id", "f", "row")


def dedup_state(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None, checkpoint: str | None = None) -> DataFrame:
    """(digest, first, n) after all files of `path` have gone through the stateful stream, once each."""
    schema = spark.read.parquet(path).schema
    if spark.read.parquet(path).inputFiles() == [_uri(path)]:
        path = f"{path[:-1]}[{path[-1]}]"  # a stream takes one file only as a pattern
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch or 1 << 30).parquet(path)
    state = _located(stream, digest).groupBy("digest").agg(F.min(_key()).alias("first"), F.count("*").alias("n"))
    at = checkpoint or fresh_path(spark, "dedup-state")
    provider = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)

    def sink(changed: DataFrame, batch: int) -> None:
        changed.withColumn("batch", F.lit(batch)).write.mode("overwrite").parquet(f"{at}/changes/at={batch:09d}")

    try:
        query = state.writeStream.outputMode("update").option("checkpointLocation", f"{at}/stream").foreachBatch(sink).trigger(availableNow=True).start()
        query.awaitTermination()
    finally:
        if provider is None:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
        else:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", provider)
    folder = spark._jvm.org.apache.hadoop.fs.Path(f"{at}/changes")
    if not folder.getFileSystem(spark._jsc.hadoopConfiguration()).exists(folder):  # no batch ran: the input has no files
        return spark.createDataFrame([], f"digest binary, first {_FIRST}, n bigint")
    changes = spark.read.schema(f"digest binary, first {_FIRST}, n bigint, batch int").parquet(f"{at}/changes")
    if checkpoint is None and query.lastProgress is not None and query.lastProgress["batchId"] == 0:
        return changes.select("digest", "first", "n")
    return changes.groupBy("digest").agg(F.max_by(F.struct("first", "n"), "batch").alias("v")).select("digest", "v.first", "v.n")


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def _resolved(spark: SparkSession, path: str, digest, files_per_batch: int | None, checkpoint: str | None, hot: int) -> DataFrame:
    """(id, f, row, keep_id) of every row that is a verified copy of another that stays."""
    hits = dedup_state(spark, path, digest, files_per_batch, checkpoint).where("n > 1")
    docs = spark.read.parquet(path)
    rows = _located(docs, digest)
    if not hits.where(F.col("n") > hot).isEmpty():
        many = written(hits.where(F.col("n") > hot), "dedup-hot")
        some = rows.join(fitted(many), "digest")
        rest = rows.join(fitted(many.select("digest")), "digest", "left_anti").join(hits.where(F.col("n") <= hot), "digest")
        met = some.unionByName(rest)
    else:
        met = rows.join(hits, "digest")
    met = written(met.select("digest", "id", "f", "row", "first"), "dedup-met")

    def visit(part: pa.RecordBatch, has, which):
        yield pa.RecordBatch.from_arrays([*part.columns[:4], has["text"].take(pa.array(which))], ["digest", "id", "f", "row", "text"])

    texts = fetched(met.select("digest", "id", "f", "row"), row_groups(docs), visit, "digest binary, id long, f long, row long, text string")
    each = written(texts.groupBy("digest", "text").count().select("digest", "count"), "dedup-texts")
    if (each.agg(F.sum("count")).first()[0] or 0) != met.count():
        raise RuntimeError("the table changed while it was read")
    apart = each.groupBy("digest").count().where("count > 1").select("digest")
    pairs = met.where(_key() != F.col("first")).select("digest", "id", "f", "row", F.col("first.id").alias("keep_id"))
    if apart.isEmpty():
        return pairs.drop("digest")
    odd = texts.join(apart, "digest")
    keep = odd.groupBy("digest", "text").agg(F.min(_key()).alias("keep"))
    odd = odd.join(keep, ["digest", "text"]).where(_key() != F.col("keep")).select("id", "f", "row", F.col("keep.id").alias("keep_id"))
    return pairs.join(apart, "digest", "left_anti").drop("digest").unionByName(odd)


def exact_duplicates(spark: SparkSession, path: str, digest=sha256, files_per_batch: int | None = None, checkpoint: str | None = None, hot: int = HOT) -> DataFrame:
    """(doc_id, keep_id): each row to remove and the row that stays, of the Parquet table at `path`."""
    return _resolved(spark, path, digest, files_per_batch, checkpoint, hot).select(F.col("id").alias("doc_id"), "keep_id")


def exact_dedup(docs: DataFrame, digest=sha256, files_per_batch: int | None = None, hot: int = HOT) -> DataFrame:
    """docs without the copies; docs may be any DataFrame with doc_id and text."""
    path = _whole(docs) if is_scan(docs) else None
    if path is None:
        docs = written(docs.select(columns(docs)), "dedup-in")
        path = docs.inputFiles()[0].rpartition("/")[0]
    at = free(docs, "at_f"), free(docs, "at_row")
    gone = written(_resolved(docs.sparkSession, path, digest, files_per_batch, None, hot).select("f", "row"), "dedup-gone")
    rows = docs.select(*columns(docs), file_key(docs).alias(at[0]), row_key(docs).alias(at[1]))
    return rows.join(fitted(gone.toDF(*at)), [*at], "left_anti").select(columns(docs))


def _whole(docs: DataFrame) -> str | None:
    """The path that a stream must read to see the rows of docs and no others, or None."""
    files = set(docs.inputFiles())
    folders = {f.rpartition("/")[0] for f in files}
    if len(folders) != 1:
        return None
    folder = next(iter(folders))
    if re.search(r"[\[\]{}*?\\%]", folder):
        return None
    if len(files) == 1 and not re.search(r"[\[\]{}*?\\%]", file := next(iter(files))):
        return file
    return folder if set(docs.sparkSession.read.parquet(folder).inputFiles()) == files else None
