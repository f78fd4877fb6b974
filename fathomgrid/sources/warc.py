"""WARC archives, plain or gzipped, a row a record. A file is read as a stream by one task, never whole in memory."""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator
from typing import IO

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SCHEMA = "record_number long, warc_type string, warc_date string, record_id string, content_type string, content_length long, metadata map<string, string>, content binary, path string"
_KNOWN = {"warc-type": 0, "warc-date": 1, "warc-record-id": 2, "content-type": 3}


def records(source: IO[bytes]) -> Iterator[tuple[list, int, dict[str, str], bytes]]:
    """([type, date, id, content type], length, other headers, content) of each record. What stands before a version line is skipped."""
    while True:
        line = source.readline()
        if not line:
            return
        if not line.startswith(b"WARC/"):
            continue
        known: list = [None] * 4
        length, rest = None, {}
        while line := source.readline():
            text = line.decode("utf-8", "replace").strip()
            if not text:
                if length is not None:
                    break
                continue  # a blank line before the length does not end the header
            name, colon, value = text.partition(":")
            value = value.strip()
            if not colon:
                continue
            low = name.strip().lower()
            if low == "content-length":
                length = int(value)
            elif low in _KNOWN:
                known[_KNOWN[low]] = value
            else:
                rest[name.strip()] = value
        if length is None:
            return
        yield known, length, rest, source.read(length)


def read_warc(spark: SparkSession, path: str, batch: int = 16 << 20) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path")
    kind = pa.schema([("record_number", pa.int64()), *((n, pa.string()) for n in ("warc_type", "warc_date", "record_id", "content_type")), ("content_length", pa.int64()), ("metadata", pa.map_(pa.string(), pa.string())), ("content", pa.binary()), ("path", pa.string())])

    def run(batches):
        for b in batches:
            for p in b.column(0).to_pylist():
                system, at = fs.FileSystem.from_uri(p if "://" in p else "file://" + p.removeprefix("file:"))
                with system.open_input_stream(at, compression=None) as raw:
                    source = gzip.open(raw) if p.endswith(".gz") else io.BufferedReader(raw, 1 << 20)
                    rows, held = [], 0
                    for n, (known, length, rest, content) in enumerate(records(source), 1):
                        rows.append((n, *known, length, list(rest.items()), content, p))
                        held += len(content)
                        if held >= batch:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)
                            rows, held = [], 0
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows), kind)], schema=kind)

    return files.repartition("path").mapInArrow(run, SCHEMA)


def html_responses(warc: DataFrame) -> DataFrame:
    """(target_uri, trec_id, html) of the response records, without their HTTP headers."""
    text = F.decode("content", "UTF-8")
    body = F.regexp_replace(text, r"(?s)\A.*?\r?\n\r?\n", "")
    return warc.where(F.lower("warc_type") == "response").select(F.col("metadata")["WARC-Target-URI"].alias("target_uri"), F.col("metadata")["WARC-TREC-ID"].alias("trec_id"), F.when(text.startswith("HTTP/"), body).otherwise(text).alias("html"))
