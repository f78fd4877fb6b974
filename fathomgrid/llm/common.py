"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, one is made for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="fathomgrid-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


_made: list[str] = []


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the shared folder; swept() deletes it."""
    _made.append(f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}")
    return _made[-1]


def made() -> int:
    """How many paths fresh_path() has given: a mark for swept()."""
    return len(_made)


def swept(spark: SparkSession, since: int = 0, keep: tuple[str, ...] = ()) -> None:
    """Deletes what was written in the shared folder since the mark, once the results that read it are themselves written."""
    for p in _made[since:]:
        if p not in keep:
            _deleted(spark, p)
    _made[since:] = [p for p in _made[since:] if p in keep]


def _deleted(spark: SparkSession, path: str) -> None:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)


def written(df: DataFrame, label: str) -> DataFrame:
    """df as a table in the shared folder: lineage ends there, and a lost executor costs nothing of it."""
    spark = df.sparkSession
    path = fresh_path(spark, label)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(df: DataFrame) -> None:
    """Deletes a table that written() made, once nothing reads it any more."""
    for p in {f.rpartition("/")[0] for f in df.inputFiles()}:
        _deleted(df.sparkSession, p)


#: Rows of a table of keys that may be broadcast: under 100 MB as a hash relation. A larger one is joined by shuffle.
SMALL = 1 << 20


def fitted(keys: DataFrame, most: int = SMALL) -> DataFrame:
    """keys, which is a written table, to be broadcast if its counted rows are at most `most`, and never if they are more."""
    return F.broadcast(keys) if keys.count() <= most else keys.hint("merge")


def columns(df: DataFrame) -> list:
    """The columns of df, whatever characters their names have."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns]


def free(df: DataFrame, name: str) -> str:
    """A column name that df does not have, in any case."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def without(docs: DataFrame, gone: DataFrame, key: str = "doc_id") -> DataFrame:
    """docs without the rows whose key is in the one column of `gone`, a written table; a null key stays. A small `gone` is broadcast."""
    mark = free(docs, "gone")
    gone = fitted(gone.toDF(mark))
    return docs.join(gone, docs[key] == F.col(mark), "left_anti").select(columns(docs))


def text_slices(batch: pa.RecordBatch, column: str, most: int = 1 << 20):
    """Slices of a batch that hold about `most` bytes of text each; a longer text is a slice of its own."""
    col = batch.column(batch.schema.get_field_index(column))
    if batch.num_rows == 0:
        return
    sizes = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to


def connected_components(edges: DataFrame) -> DataFrame:
    """(id, root) of every id in edges (a, b): root is the least id of its component.

    Alternates the large-star and the small-star step (Kiveris et al. 2014), each an aggregation and an equi-join, until
    no edge changes. The table of each round is written to the shared folder and the one before it is deleted. Empty
    edges give an empty result; self loops give the id itself; repeated edges count once.
    """
    loops = written(edges.where("a is not null and b is not null").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc")
    now, was = loops.where("u <> v"), None
    keep = loops
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        made = written(small, "cc")
        n, s = made.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if was is not None:
            dropped(was)
        now = was = made
        if (n, s) == mark:
            break
        mark = (n, s)
    ids = keep.select(F.explode(F.array("u", "v")).alias("id")).distinct()
    return ids.join(now.select(F.col("u").alias("id"), "v"), "id", "left").select("id", F.coalesce("v", "id").alias("root"))
