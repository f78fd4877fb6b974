"""Ranked search: one query, many queries, and lookups by id. Hits are ordered by score, ties by doc_id."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomgrid.operators.clauses import MOST, best
from fathomgrid.operators.index import SearchIndex
from fathomgrid.plans import query as Q
from fathomgrid.plans.compile import resolved, scored

def _order() -> tuple[Column, Column]:
    return F.col("score").desc(), F.col("doc_id").asc()


def _checked(k: int, per_partition: int | None) -> None:
    if k < 1:
        raise ValueError("max_hits must be at least 1")
    if per_partition is not None and not 1 <= per_partition <= k:
        raise ValueError("max_hits_per_partition must be from 1 to max_hits")


def light_search(index: SearchIndex, query: Q.Query, max_hits: int, max_hits_per_partition: int | None = None) -> DataFrame:
    """(doc_id, score) of the best hits. With a limit a partition, hits beyond it are dropped before they meet."""
    _checked(max_hits, max_hits_per_partition)
    hits = scored(query, index)
    if max_hits_per_partition is not None:
        rank = F.row_number().over(W.partitionBy("__p").orderBy(*_order()))
        hits = hits.withColumn("__p", F.spark_partition_id()).withColumn("__r", rank).where(F.col("__r") <= max_hits_per_partition).select("doc_id", "score")
    return hits.orderBy(*_order()).limit(max_hits)


def with_documents(hits: DataFrame, index: SearchIndex) -> DataFrame:
    return hits.join(index.stored(), "doc_id")


def search(index: SearchIndex, query: Q.Query, max_hits: int, max_hits_per_partition: int | None = None, transform: list[Column] | None = None) -> DataFrame:
    """The best hits with their documents' stored columns, or with the columns that `transform` makes of them."""
    out = with_documents(light_search(index, query, max_hits, max_hits_per_partition), index).orderBy(*_order())
    return out.select("doc_id", "score", *transform) if transform is not None else out


def aggregating_search(index: SearchIndex, query: Q.Query, max_hits: int, **options) -> list:
    """search(), collected."""
    return search(index, query, max_hits, **options).collect()


Queries = Iterable[tuple[int, Q.Query]]


def ranked(hits: DataFrame, k: int) -> DataFrame:
    """The k best of each query_id, with their rank."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*_order()))).where(F.col("rank") <= k)


def clause_hits(clauses: DataFrame, index: SearchIndex) -> DataFrame:
    """(query_id, doc_id, score) for rows (query_id, field, term, qtf, need): one equi-join on terms, one aggregation."""
    postings = index.postings.select("field", "term", "doc_id", "tf", "dl")
    used = clauses.join(index.terms(), ["field", "term"]).withColumn("idf", index.idf(F.col("field"), F.col("df"), F.col("ttf"))).select("query_id", "field", "term", "qtf", "need", "idf")
    one = index.weight(F.col("tf"), F.col("dl"), F.col("idf"), F.col("field")) * F.col("qtf")
    met = used.join(postings, ["field", "term"]).groupBy("query_id", "doc_id").agg(F.round(F.sum(one), 6).alias("score"), F.count("*").alias("met"), F.max("need").alias("need"))
    return met.where("met >= need").select("query_id", "doc_id", "score")


def clause_best(clauses: DataFrame, index: SearchIndex, k: int) -> tuple[DataFrame, bool]:
    """(query_id, doc_id, score) among which are the k best of each query, and whether those came without a join."""
    hits = best(clauses, index, k)
    return (clause_hits(clauses, index), False) if hits is None else (hits, True)


def listed(hits: DataFrame, index: SearchIndex, few: bool, transform: list[Column] | None) -> DataFrame:
    """(query_id, hits) of ranked hits: arrays of structs with the documents' columns. Few hits go to the documents, which stay where they are."""
    rows = (F.broadcast(hits) if few else hits).join(index.stored(), "doc_id")
    value = transform if transform is not None else [F.col(f"`{c}`") for c in index.stored().columns if c != "doc_id"]
    return rows.groupBy("query_id").agg(F.sort_array(F.collect_list(F.struct("rank", "doc_id", "score", *value))).alias("hits"))


def flat(q: Q.Query) -> bool:
    return isinstance(q, Q.Terms)


def clause_rows(query_id: int, q: Q.Terms) -> list[tuple]:
    return [(query_id, q.field, t, float(q.terms.count(t)), q.minimum) for t in sorted(set(q.terms))]


CLAUSES = "query_id long, field string, term string, qtf double, need int"


def light_batch_search(index: SearchIndex, queries: Queries, max_hits: int) -> DataFrame:
    """(query_id, doc_id, score, rank). Flat queries share one plan; others have one each, united."""
    _checked(max_hits, None)
    spark = index.docs.sparkSession
    trees = [(i, resolved(q, index)) for i, q in queries]
    rows = [r for i, q in trees if flat(q) for r in clause_rows(i, q)]
    parts = [clause_best(spark.createDataFrame(rows, CLAUSES), index, max_hits)[0]] if rows else []
    parts += [scored(q, index).select(F.lit(i).cast("long").alias("query_id"), "doc_id", "score") for i, q in trees if not flat(q)]
    hits = spark.createDataFrame([], f"query_id long, doc_id {dict(index.docs.dtypes)['doc_id']}, score double") if not parts else parts[0]
    for p in parts[1:]:
        hits = hits.unionByName(p)
    return ranked(hits, max_hits)


def batch_search(index: SearchIndex, queries: Queries, max_hits: int, transform: list[Column] | None = None) -> DataFrame:
    """(query_id, hits): an array of structs, best first; empty for a query without hits."""
    queries = list(queries)
    lists = listed(light_batch_search(index, queries, max_hits), index, len(queries) * max_hits <= MOST, transform)
    ids = index.docs.sparkSession.createDataFrame([(i,) for i, _ in queries], "query_id long")
    out = ids.join(lists, "query_id", "left")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))


def batch_search_raw(index: SearchIndex, queries: Iterable[tuple[int, str]], max_hits: int, constructor: Callable[[str], Q.Query] | None = None, transform: list[Column] | None = None) -> DataFrame:
    return batch_search(index, [(i, Q.raw(t, constructor)) for i, t in queries], max_hits, transform)


def light_batch_search_raw(index: SearchIndex, queries: Iterable[tuple[int, str]], max_hits: int, constructor: Callable[[str], Q.Query] | None = None) -> DataFrame:
    return light_batch_search(index, [(i, Q.raw(t, constructor)) for i, t in queries], max_hits)


def get_element(index: SearchIndex, doc_id) -> DataFrame:
    """The document of that id: one row, or none."""
    return index.stored().where(F.col("doc_id") == F.lit(doc_id))


def get_elements(index: SearchIndex, ids: Iterable) -> DataFrame:
    """A row an id; the columns of an id that is not there are null."""
    kind = dict(index.docs.dtypes)["doc_id"]
    return index.docs.sparkSession.createDataFrame([(i,) for i in ids], f"doc_id {kind}").join(index.stored().withColumn("found", F.lit(True)), "doc_id", "left").withColumn("found", F.coalesce("found", F.lit(False)))
