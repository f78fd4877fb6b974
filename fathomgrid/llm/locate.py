"""Rows of Parquet tables by locator: the hash of the file's path and the row's number in it.

`fetched` brings the contents of the rows that a table of locators names to that table, one task a row group or more, by
reading the files. The table of contents itself goes through no shuffle, whatever its size.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomgrid.llm.common import columns, written


def is_scan(df: DataFrame) -> bool:
    """Whether df is a Parquet table as it lies, no filter or column left out."""
    plan = df._jdf.queryExecution().optimizedPlan()
    return plan.getClass().getSimpleName() == "LogicalRelation" and "HadoopFsRelation" in plan.relation().getClass().getSimpleName() and "Parquet" in plan.relation().fileFormat().getClass().getSimpleName()


def on_files(docs: DataFrame, label: str) -> DataFrame:
    """docs if it is a Parquet table as it lies, else a copy of it in the shared folder."""
    return docs if is_scan(docs) else written(docs.select(columns(docs)), label)


def file_key(df: DataFrame) -> Column:
    return F.xxhash64(df.metadataColumn("_metadata")["file_path"])


def row_key(df: DataFrame) -> Column:
    return df.metadataColumn("_metadata")["row_index"]


def _open(uri: str):
    scheme, _, path = uri.partition(":")
    system, at = fs.FileSystem.from_uri(f"{scheme}:///{path.lstrip('/')}" if scheme == "file" else uri)
    return system.open_input_file(at)


def row_groups(docs: DataFrame) -> DataFrame:
    """(f, file, grp, first, n, no) of each row group of a table's files, out of their footers; no counts from 0."""

    def run(batches):
        for b in batches:
            for file in b.column(0).to_pylist():
                with _open(file) as source:
                    meta = pq.read_metadata(source)
                n = np.array([meta.row_group(i).num_rows for i in range(meta.num_row_groups)], np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([file] * len(n), pa.string()), pa.array(np.arange(len(n), dtype=np.int32)), pa.array(np.cumsum(n) - n), pa.array(n)], ["file", "grp", "first", "n"])

    files = docs.select(docs.metadataColumn("_metadata")["file_path"].alias("file")).distinct()
    groups = files.mapInArrow(run, "file string, grp int, first long, n long").select(F.xxhash64("file").alias("f"), "file", "grp", "first", "n")
    groups = groups.withColumn("no", F.row_number().over(W.orderBy("f", "grp")) - 1)  # a few rows a file
    return written(groups, "row-groups")


Visit = Callable[[pa.RecordBatch, dict[str, pa.Array], np.ndarray], Iterator[pa.RecordBatch]]


def fetched(rows: DataFrame, groups: DataFrame, visit: Visit, kind: str, contents: tuple[str, ...] = ("text",), chunk: int = 512) -> DataFrame:
    """What visit makes of rows (f, row and more) and the contents that their locators name.

    visit gets some of the rows, the wanted columns of the documents that these name, each document once, and for each
    row the number of its document. The rows are sorted by locator; those of one document may come in several calls.
    """
    spark = rows.sparkSession
    names = rows.columns
    parts = max(1, min(groups.count(), 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))))
    near = rows.join(groups, "f").where("row >= first and row < first + n").select(*names, "file", "grp", "first", (F.col("no") % parts).cast("int").alias("part"))
    near = near.repartitionById(parts, "part").sortWithinPartitions("f", "grp", "row")
    f, r, width = names.index("f"), names.index("row"), len(names)

    def run(batches):
        held = source = None
        for b in batches:
            if not b.num_rows:
                continue
            key, grp, row = b.column(f).to_numpy(), b.column(width + 1).to_numpy(), b.column(r).to_numpy()
            cut = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (grp[1:] != grp[:-1])])
            for s, e in zip(cut, [*cut[1:], b.num_rows]):
                if held is None or held[:2] != (key[s], grp[s]):
                    if source is not None:
                        source.close()
                    source = _open(b.column(width)[int(s)].as_py())
                    stream = pq.ParquetFile(source, pre_buffer=False).iter_batches(chunk, row_groups=[int(grp[s])], columns=list(contents))
                    held = (key[s], grp[s], stream, int(b.column(width + 2)[int(s)].as_py()), None)
                at = int(s)
                while at < e:
                    _, _, stream, first, texts = held
                    while texts is None or row[at] >= first + texts.num_rows:
                        first += texts.num_rows if texts is not None else 0
                        texts = next(stream)
                    held = (*held[:3], first, texts)
                    to = at + int(np.searchsorted(row[at:e], first + texts.num_rows))
                    wanted, which = np.unique(row[at:to] - first, return_inverse=True)
                    took = texts.take(pa.array(wanted))
                    yield from visit(b.slice(at, to - at), {c: took.column(took.schema.get_field_index(c)) for c in contents}, which)
                    at = to
        if source is not None:
            source.close()

    return near.mapInArrow(run, kind)
