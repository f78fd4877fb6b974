"""Token counts by a separator scan over flat token files.

`write_tokens` writes documents as flat files of little-endian uint16 token ids, each document followed by the
end-of-document id and nothing else: no index, no lengths. `document_lengths` reads such files by blocks of bytes, any
number of tasks a file. A block's task finds the separators with one vectorised comparison and emits their absolute
positions; a prefix scan over the blocks of a file (count of separators, greatest separator position so far) then gives
every block the ordinal of its first document and the place where that document began, blocks before it included.

Cases: a null or empty text is a document of no tokens. Ids (null, repeated) are carried beside the files as the order
of documents within a file and joined back by ordinal, so repeated rows keep their own counts. Text of separator look is
ordinary text: its bytes are encoded, never read as a separator. A file that does not end in a separator ends in a
document that is not closed, which counts. An empty file has no documents; an empty table has an empty result.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomgrid.llm.common import fresh_path, written

SEPARATOR = 50256
BLOCK = 4 << 20
#: Tasks of a scan for each core.
SPREAD = 4
_encoders: dict[str, object] = {}


def encoder(folder: str, name: str = "byte_bpe_multi_50k.tiktoken"):
    """A byte-level BPE without special tokens; ids below SEPARATOR."""
    path = f"{folder}/{name}"
    if path not in _encoders:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
        _encoders[path] = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    return _encoders[path]


def write_tokens(docs: DataFrame, path: str, folder: str = "/opt/tokenizers", separator: int = SEPARATOR) -> DataFrame:
    """Writes the flat files under `path`; returns (file, seq, doc_id), the documents' order, once all are written.

    A task writes a file of its own attempt and reports it only when it is complete, so a lost executor leaves at most a
    file that nothing refers to.
    """

    def run(batches):
        import uuid

        system, root = fs.FileSystem.from_uri(path)
        system.create_dir(root, recursive=True)
        name = f"{uuid.uuid4().hex}.bin"
        enc, seq, ids = encoder(folder), 0, []
        with system.open_output_stream(f"{root}/{name}") as out:
            for b in batches:
                for text in b.column(1):
                    text = text.as_py()
                    tokens = enc.encode_ordinary(text) if text else []
                    out.write(np.array([*tokens, separator], "<u2").tobytes())
                ids.append((seq, b.column(0)))
                seq += b.num_rows
        for at, col in ids:
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(col), pa.string()), pa.array(np.arange(at, at + len(col))), col], ["file", "seq", "doc_id"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return written(docs.select("doc_id", "text").mapInArrow(run, f"file string, seq long, doc_id {kind}"), "token-order")


def blocks(order_or_files: DataFrame, path: str, block: int = BLOCK) -> DataFrame:
    """(file, block, start, bytes): the blocks of each file that column `file` names; `block` is even, as a token is two bytes."""
    if block < 2 or block % 2:
        raise ValueError("a block must hold whole tokens of two bytes")

    def run(batches):
        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            for f in b.column(0).to_pylist():
                size = system.get_file_info(f"{root}/{f}").size
                at = np.arange(0, size, block)
                yield pa.RecordBatch.from_arrays([pa.array([f] * len(at), pa.string()), pa.array(np.arange(len(at))), pa.array(at), pa.array(np.minimum(block, size - at))], ["file", "block", "start", "bytes"])

    return order_or_files.select("file").distinct().mapInArrow(run, "file string, block long, start long, bytes long")


def scan(parts: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(file, block, first, size, ends): the positions of the separators in each block, counted in tokens from the file's start."""

    def run(batches):
        system, root = fs.FileSystem.from_uri(path)
        for b in batches:
            file, no, start, size = (c.to_pylist() for c in b.columns)
            for f, k, at, n in zip(file, no, start, size):
                with system.open_input_file(f"{root}/{f}") as source:
                    source.seek(at)
                    ids = np.frombuffer(source.read(n), "<u2")
                ends = np.flatnonzero(ids == separator) + at // 2
                yield pa.RecordBatch.from_arrays([pa.array([f]), pa.array([k]), pa.array([at // 2]), pa.array([len(ids)]), pa.array([ends], pa.list_(pa.int64()))], ["file", "block", "first", "size", "ends"])

    # The list of blocks is small and would be one task; the work behind it is not. An explicit count keeps the tasks apart.
    parts = parts.repartition(parts.sparkSession.sparkContext.defaultParallelism * SPREAD, "file", "block")
    return parts.mapInArrow(run, "file string, block long, first long, size long, ends array<long>")


def document_lengths(parts: DataFrame, path: str, separator: int = SEPARATOR) -> DataFrame:
    """(file, seq, start, n_tokens) of every document in the files, without their separators."""
    found = written(scan(parts, path, separator), "separators")
    before = W.partitionBy("file").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    carried = found.select("file", "block", F.size("ends").alias("n"), F.array_max("ends").alias("last"))
    carried = carried.select("file", "block", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("seq0"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begin"))
    starts = F.concat(F.array("begin"), F.transform(F.slice("ends", F.lit(1), F.size("ends") - 1), lambda x: x + 1))
    closed = found.where("size(ends) > 0").join(carried, ["file", "block"]).select("file", "seq0", F.posexplode(F.arrays_zip(starts.alias("start"), F.col("ends").alias("end"))).alias("i", "at"))
    closed = closed.select("file", (F.col("seq0") + F.col("i")).alias("seq"), F.col("at.start").alias("start"), (F.col("at.end") - F.col("at.start")).alias("n_tokens"))
    tail = found.groupBy("file").agg(F.sum(F.size("ends")).cast("long").alias("seq"), (F.coalesce(F.max(F.array_max("ends")), F.lit(-1)) + 1).alias("start"), F.max(F.col("first") + F.col("size")).alias("end"))
    tail = tail.where("end > start").select("file", "seq", "start", (F.col("end") - F.col("start")).alias("n_tokens"))
    return closed.unionByName(tail)


def token_counts(docs: DataFrame, folder: str = "/opt/tokenizers", block: int = BLOCK, path: str | None = None) -> DataFrame:
    """(doc_id, n_tokens), one row a document: written as flat token files in the shared folder, then counted by the scan."""
    path = path or _uri(fresh_path(docs.sparkSession, "tokens"))
    order = write_tokens(docs, path, folder)
    lengths = document_lengths(blocks(order, path, block), path)
    return order.join(lengths.select("file", "seq", "n_tokens"), ["file", "seq"]).select("doc_id", "n_tokens")


def _uri(path: str) -> str:
    return path if "://" in path else f"file://{path.removeprefix('file:')}"


def files_under(spark: SparkSession, path: str) -> DataFrame:
    """(file) of the .bin files in a folder."""
    system, root = fs.FileSystem.from_uri(path)
    names = [f.base_name for f in system.get_file_info(fs.FileSelector(root)) if f.base_name.endswith(".bin")]
    return spark.createDataFrame([(n,) for n in names], "file string")
