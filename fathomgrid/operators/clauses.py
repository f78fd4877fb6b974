"""The best hits of many flat queries in one pass over the documents, which keeps the k best of each query as it goes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from fathomgrid.deploy import bounded
from fathomgrid.operators.index import SearchIndex, formula

#: Rows of clauses that come to the driver and go to every task (a few MB); more are joined with the postings by term.
MOST = 1 << 17
#: Pairs of a document and a query, or of a posting and a clause, that a task holds at once.
PAIRS = 1 << 20


class _Counted:
    """Postings of an Arrow batch of documents: row, place of the term among the wanted ones, tf and dl."""

    def __init__(self, fields: list[tuple[int, str]], words: dict[str, pa.Array]):
        self.fields, self.words = fields, words
        self.base = dict(zip((f for _, f in fields), np.cumsum([0, *(len(words[f]) for _, f in fields)]).tolist()))

    def __call__(self, batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        parts = []
        for n, (i, f) in enumerate(self.fields):
            col = batch.column(batch.schema.get_field_index(f"__t{i}"))
            row = pc.list_parent_indices(col).to_numpy(zero_copy_only=False).astype(np.int64)
            term = pc.fill_null(pc.index_in(col.flatten(), value_set=self.words[f], skip_nulls=True), -1).to_numpy(zero_copy_only=False).astype(np.int64)
            size = len(self.words[f])
            met = term >= 0
            key, tf = np.unique(row[met] * size + term[met], return_counts=True)
            at = key // size
            dl = pc.fill_null(batch.column(batch.schema.get_field_index(f"__n{i}")), 0).to_numpy(zero_copy_only=False)
            parts.append((at, key % size + self.base[f], tf, dl[at], np.full(len(at), n)))
        row, term, tf, dl, of = (np.concatenate(x) for x in zip(*parts))
        if len(parts) > 1:
            order = np.argsort(row, kind="stable")
            row, term, tf, dl, of = row[order], term[order], tf[order], dl[order], of[order]
        return row, term, tf, dl, of


def _rounded(x: np.ndarray) -> np.ndarray:
    """To six places, halves away from zero, as SQL does."""
    return np.copysign(np.floor(np.abs(x) * 1e6 + 0.5) / 1e6, x)


class _Best:
    """The k best rows (query, score, doc_id) of each query so far."""

    def __init__(self, queries: int, k: int):
        self.k, self.least = k, np.full(queries, -np.inf)
        self.query, self.score, self.doc = np.empty(0, np.int64), np.empty(0), None

    def add(self, query: np.ndarray, score: np.ndarray, doc: pa.Array) -> None:
        self.query, self.score = np.concatenate([self.query, query]), np.concatenate([self.score, score])
        self.doc = doc if self.doc is None else pa.concat_arrays([self.doc, doc])
        place = np.empty(len(self.doc), np.int64)
        place[pc.sort_indices(self.doc).to_numpy()] = np.arange(len(self.doc))
        order = np.lexsort((place, -self.score, self.query))
        q = self.query[order]
        first = np.searchsorted(q, q)
        rank = np.arange(len(q)) - first
        last = order[rank == self.k - 1]
        self.least[self.query[last]] = self.score[last]
        order = order[rank < self.k]
        self.query, self.score, self.doc = self.query[order], self.score[order], self.doc.take(pa.array(order))


def best(clauses: DataFrame, index: SearchIndex, k: int) -> DataFrame | None:
    """(query_id, doc_id, score): of each query its k best hits in each partition of the documents.

    None where the clauses are too many, the index has no tokens or scores are a caller's expression. A task holds a few
    steps of PAIRS numbers and k rows a query, whatever the documents; nothing is shuffled but those rows.
    """
    if index.source is None or callable(index.config.similarity):
        return None
    rows = clauses.select("query_id", "field", "term", "qtf", "need").limit(MOST + 1).toArrow().combine_chunks()
    if rows.num_rows > MOST:
        return None
    spark = index.docs.sparkSession
    bounded(spark)
    texts = rows.column("field").to_pylist(), rows.column("term").to_pylist()
    fields = [(i, f) for i, f in enumerate(index.text_fields) if f in set(texts[0])]
    kind = StructType([StructField("query_id", clauses.schema["query_id"].dataType), StructField("doc_id", index.docs.schema["doc_id"].dataType), StructField("score", DoubleType())])
    if not fields:
        return spark.createDataFrame([], kind)
    coded = rows.column("query_id").combine_chunks() if isinstance(rows.column("query_id"), pa.ChunkedArray) else rows.column("query_id")
    coded = coded.dictionary_encode(null_encoding="encode")
    names, query = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    many = len(names)
    need = np.zeros(many, np.int64)
    given = rows.column("need").to_numpy().astype(np.int64)
    np.maximum.at(need, query, given)
    if (need[query] != given).any():
        return None
    words = {f: pa.array(sorted({t for g, t in zip(*texts) if g == f and t is not None}), pa.string()) for _, f in fields}
    counted = _Counted(fields, words)
    place = {(f, t): counted.base[f] + n for _, f in fields for n, t in enumerate(words[f].to_pylist())}
    term = np.array([place.get(x, -1) for x in zip(*texts)], np.int64)
    total = len(place)
    source = index.source.select("doc_id", *(c for i, _ in fields for c in (f"__t{i}", f"__n{i}")))

    def frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, ttf = np.zeros(total, np.int64), np.zeros(total, np.int64)
        for batch in batches:
            _, t, tf, _, _ = counted(batch)
            df += np.bincount(t, minlength=total)
            ttf += np.bincount(t, weights=tf, minlength=total).astype(np.int64)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(df[at]), pa.array(ttf[at])], names=["at", "df", "ttf"])

    seen = source.mapInArrow(frequencies, "at long, df long, ttf long").groupBy("at").agg(F.sum("df").alias("df"), F.sum("ttf").alias("ttf"))
    of = F.lit(None).cast("string")
    for _, f in fields:
        of = F.when(F.col("at") >= counted.base[f], f).otherwise(of)
    idf = np.zeros(total)
    for r in seen.select("at", index.idf(of, F.col("df"), F.col("ttf")).alias("idf")).collect():
        idf[r["at"]] = r["idf"]

    # Clauses in order of term: those of term t lie from start[t] to start[t + 1].
    order = np.argsort(term, kind="stable")
    order = order[term[order] >= 0]
    start = np.searchsorted(term[order], np.arange(total + 1))
    asks, times = query[order], rows.column("qtf").to_numpy()[order]
    average = np.array([index.stats[f].avgdl for _, f in fields])
    config, least = index.config, np.maximum(need, 1)

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = _Best(many, k)
        for batch in batches:
            row, t, tf, dl, field = counted(batch)
            if not len(row):
                continue
            weight = formula(config, tf.astype(float), dl.astype(float), average[field], idf[t], np.sqrt)
            degree = start[t + 1] - start[t]
            cost = np.maximum(np.bincount(row, weights=degree, minlength=batch.num_rows), many)
            ends = np.cumsum(cost)
            docs, low = batch.column(batch.schema.get_field_index("doc_id")), 0
            while low < batch.num_rows:
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, side="right")))
                a, b = np.searchsorted(row, [low, high])
                n = degree[a:b]
                at = np.arange(n.sum()) + np.repeat(start[t[a:b]] - (np.cumsum(n) - n), n)
                pair = np.repeat(row[a:b] - low, n) * many + asks[at]
                score = np.bincount(pair, weights=np.repeat(weight[a:b], n) * times[at], minlength=(high - low) * many).reshape(-1, many)
                met = np.bincount(pair, minlength=(high - low) * many).reshape(-1, many)
                score = _rounded(score)
                good = (met >= least) & (score >= found.least)
                if high - low > k:
                    held = np.where(good, score, -np.inf)
                    good &= score >= np.partition(held, high - low - k, axis=0)[high - low - k]
                r, q = np.nonzero(good)
                if len(r):
                    found.add(q, score[r, q], docs.take(pa.array(r + low)))
                low = high
        if found.doc is not None:
            yield pa.RecordBatch.from_arrays([names.take(pa.array(found.query)), found.doc, pa.array(found.score)], names=["query_id", "doc_id", "score"])

    return source.mapInArrow(hits, kind)
