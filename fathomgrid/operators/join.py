"""Query joins: every row of a table with its best hits in an index, by its terms instead of a product."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.operators.index import SearchIndex
from fathomgrid.operators.search import clause_best, clause_hits, listed, ranked
from fathomgrid.plans import query as Q


def text_clauses(left: DataFrame, key: str, field: str, text: Column, index: SearchIndex, every: bool = False) -> DataFrame:
    """Clause rows of match_text (or match_all_text) of a column's value on each row."""
    tokens = left.select(F.col(key).alias("query_id"), F.explode(index.config.at_query.tokens(text)).alias("term")).where("term is not null")
    rows = tokens.groupBy("query_id", "term").agg(F.count("*").cast("double").alias("qtf"))
    if every:
        need = tokens.groupBy("query_id").agg(F.countDistinct("term").cast("int").alias("need"))
        rows = rows.join(need, "query_id")
    else:
        rows = rows.withColumn("need", F.lit(1))
    return rows.select("query_id", F.lit(field).alias("field"), "term", "qtf", "need")


def generated_clauses(left: DataFrame, key: str, make: Callable[[dict], Q.Query]) -> DataFrame:
    """Clause rows of the queries that a Python function makes of each row; they must be flat, on terms as they are."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for row in batch.to_dict("records"):
                q = make(row)
                if not isinstance(q, Q.Terms):
                    raise TypeError("a generated query must be of terms: match_term, match_any, match_all or match_min")
                out += [(row[key], q.field, t, float(q.terms.count(t)), q.minimum) for t in sorted(set(q.terms))]
            yield pd.DataFrame(out, columns=["query_id", "field", "term", "qtf", "need"])

    kind = dict(left.dtypes)[key]
    return left.mapInPandas(run, f"query_id {kind}, field string, term string, qtf double, need int")


def _joined(clauses: DataFrame, index: SearchIndex, max_hits: int, exclude_self: bool) -> tuple[DataFrame, bool]:
    if exclude_self:
        # A document is one of its own hits at most.
        same = clauses.schema["query_id"].dataType == index.docs.schema["doc_id"].dataType
        hits, direct = clause_best(clauses, index, max_hits + 1) if same else (clause_hits(clauses, index), False)
        hits = hits.where("query_id <> doc_id")
    else:
        hits, direct = clause_best(clauses, index, max_hits)
    return ranked(hits, max_hits), direct


def light_query_join(clauses: DataFrame, index: SearchIndex, max_hits: int, exclude_self: bool = False) -> DataFrame:
    """(query_id, doc_id, score, rank)."""
    return _joined(clauses, index, max_hits, exclude_self)[0]


def query_join(left: DataFrame, key: str, clauses: DataFrame, index: SearchIndex, max_hits: int, how: str = "left", transform: list[Column] | None = None, exclude_self: bool = False) -> DataFrame:
    """left with an array `hits`, best first; rows without hits have an empty one, or go with how="inner"."""
    if how not in ("left", "inner"):
        raise ValueError("how must be left or inner")
    hits, direct = _joined(clauses, index, max_hits, exclude_self)
    lists = listed(hits, index, direct and max_hits <= 10, transform)
    out = left.join(lists, F.col(key) == F.col("query_id"), how).drop("query_id")
    return out.withColumn("hits", F.coalesce("hits", F.array().cast(lists.schema["hits"].dataType)))
