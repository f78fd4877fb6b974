"""Document quality by hierarchical empirical Bayes.

A logistic regression over nineteen surface features of the whole text gives each document its own evidence p. Sites come
next: grouped sums over all documents give each host and each path below it a count n and a sum s of evidence. The
hosts' rates s / n have a beta prior whose mean and strength come from the hosts by the method of moments; a host's
posterior rate is (s + strength * mean) / (n + strength). A path's posterior is taken likewise with its host's posterior
as the mean, its own document left out of both counts, so a sparse site shrinks to the global rate. The decision adds
the log-odds: logit(p) + `site_weight` * (logit(path posterior) - logit(global mean)); a document is kept at a final
posterior of `threshold` or more.

The regression is fitted on a bounded sample of the labelled documents (`sample`, the least hashes of doc_id, so any
partitioning draws the same ones); everything else covers all documents.

Cases: a null text counts as an empty one, which has no words and is rejected unless the fit says otherwise by its
features; a null host or path is a site of its own. Labels that are null are not used; with labels of one class only,
or none, every document is kept (p = 0.5 and a threshold of 0.5). Repeated rows count as often as they occur. Empty
tables give empty results; extra columns, of whatever name, are carried.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.common import text_slices, without, written
from fathomgrid.llm.textvec import Words, mix

FEATURES = 19
_UPPER, _DIGIT, _SPACE, _LINE, _OTHER, _HIGH = range(6)
_KIND = np.full(256, _OTHER, np.int8)
_KIND[65:91], _KIND[48:58], _KIND[[9, 13, 32]], _KIND[10], _KIND[128:] = _UPPER, _DIGIT, _SPACE, _LINE, _HIGH
_KIND[97:123] = 6
_MARKS = [b"|", b"!", b"#", b"$", b"%", b"&", b"*", b"@"]


def features(texts: pa.Array) -> np.ndarray:
    """One row a text, over all of it."""
    w = Words(texts, lower=False)
    n, chars = len(w.count), np.diff(w.offsets)
    text_of = np.repeat(np.arange(n), chars)
    kinds = np.bincount(text_of * 7 + _KIND[w.raw], minlength=n * 7).reshape(n, 7)
    upper8 = np.zeros(n)
    if len(w.raw) > 1:  # accented capitals: C3 80 to C3 9E
        at = np.flatnonzero((w.raw[:-1] == 0xC3) & (w.raw[1:] >= 0x80) & (w.raw[1:] <= 0x9E))
        upper8 = np.bincount(text_of[at], minlength=n)
    size, words = np.maximum(chars, 1), np.maximum(w.count, 1)
    doc = w.doc()
    length = w.end - w.start
    mean = np.bincount(doc, length, n) / words
    key = np.sort((doc.astype(np.uint64) << np.uint64(40)) | (w.hash >> np.uint64(24)))
    new = np.r_[True, key[1:] != key[:-1]][: len(key)]
    at = np.flatnonzero(new)
    owner = (key[at] >> np.uint64(40)).astype(np.int64)
    tf = np.diff(np.r_[at, len(key)])
    distinct = np.bincount(owner, minlength=n)
    top = np.zeros(n)
    np.maximum.at(top, owner, tf)
    same = np.zeros(len(doc), bool)
    same[1:] = (w.hash[1:] == w.hash[:-1]) & (doc[1:] == doc[:-1])
    pair, ok = w.grams(2)
    pair = np.sort((doc[ok].astype(np.uint64) << np.uint64(40)) | (pair[ok] >> np.uint64(24)))
    pairs = np.bincount((pair[np.r_[True, pair[1:] != pair[:-1]][: len(pair)]] >> np.uint64(40)).astype(np.int64), minlength=n)
    marks = np.zeros((n, len(_MARKS)))
    other = np.flatnonzero(_KIND[w.raw] == _OTHER)
    for i, m in enumerate(_MARKS):
        marks[:, i] = np.bincount(text_of[other[w.raw[other] == m[0]]], minlength=n) / words
    return np.column_stack([
        np.log1p(w.count), mean, (kinds[:, _UPPER] + upper8) / size, kinds[:, _DIGIT] / size, kinds[:, _OTHER] / size, kinds[:, _LINE] / words,
        np.log1p(distinct) - np.log1p(w.count), top / words, np.bincount(doc, same, n) / words, np.log1p(pairs) - np.log1p(w.count), (length[:0].sum() + np.bincount(doc, length <= 3, n)) / words, *marks.T,
    ])


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1e-3, rounds: int = 40) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Logistic regression on x and its squares by Newton's method: (mean, scale, weights with the constant last)."""
    x = np.column_stack([x, x**2])
    mean, scale = x.mean(0), x.std(0) + 1e-6
    z = np.column_stack([np.clip((x - mean) / scale, -8, 8), np.ones(len(x))])
    b = np.zeros(z.shape[1])
    penalty = np.full(len(b), ridge * len(x))
    penalty[-1] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
        step = np.linalg.solve((z * (p * (1 - p))[:, None]).T @ z + np.diag(penalty), z.T @ (y - p) - penalty * b)
        b = b + step
        if np.abs(step).max() < 1e-6:
            break
    return mean, scale, b


def evidence(model, x: np.ndarray) -> np.ndarray:
    """Probability of good quality."""
    if model is None:
        return np.full(len(x), 0.5)
    mean, scale, b = model
    z = np.clip((np.column_stack([x, x**2]) - mean) / scale, -8, 8)
    return 1 / (1 + np.exp(-np.clip(z @ b[:-1] + b[-1], -30, 30)))


def trained(docs: DataFrame, labels: DataFrame, sample: int = 20_000):
    """The model of evidence(), or None where the labels are of fewer than two classes."""
    wanted = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(1), pa.array(list(features(part.column(0))), pa.list_(pa.float64()))], ["quality", "x"])

    rows = docs.select("doc_id", "text").join(F.broadcast(wanted), "doc_id").select("text", F.col("quality").cast("double").alias("quality"))
    rows = rows.mapInArrow(run, "quality double, x array<double>").toArrow()
    y = rows.column("quality").to_numpy()
    if len(np.unique(y)) < 2:
        return None
    return fit(np.array(rows.column("x").to_pylist()), y)


def _logit(p: Column) -> Column:
    p = F.greatest(F.lit(1e-6), F.least(F.lit(1 - 1e-6), p))
    return F.log(p / (1 - p))


def _shrunk(groups: DataFrame, mean: Column, name: str) -> Column:
    return (F.col(f"{name}_s") + F.col("strength") * mean) / (F.col(f"{name}_n") + F.col("strength"))


def scored(docs: DataFrame, labels: DataFrame, host: Column | None = None, path: Column | None = None, site_weight: float = 1.0, threshold: float = 0.5, sample: int = 20_000) -> DataFrame:
    """(_host, _path, doc_id, _row, evidence, site, posterior, keep), one a document. Without a host, `source` is the host and its languages are the paths."""
    host = F.col("source") if host is None else host
    path = F.concat_ws("/", F.coalesce(host, F.lit("")), F.coalesce(F.col("lang"), F.lit(""))) if path is None else path
    model = trained(docs, labels, sample)

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(evidence(model, features(part.column(3))))], ["doc_id", "_host", "_path", "evidence"])

    kinds = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, _host string, _path string, evidence double"
    seen = written(docs.select("doc_id", F.coalesce(host, F.lit("")).alias("_host"), F.coalesce(path, F.lit("")).alias("_path"), "text").mapInArrow(run, kinds), "evidence")
    paths = seen.groupBy("_host", "_path").agg(F.count("*").alias("path_n"), F.sum("evidence").alias("path_s"))
    hosts = paths.groupBy("_host").agg(F.sum("path_n").alias("host_n"), F.sum("path_s").alias("host_s"))
    rate = F.col("host_s") / F.col("host_n")
    world = hosts.agg((F.sum("host_s") / F.sum("host_n")).alias("m"), F.coalesce(F.var_samp(rate), F.lit(0.0)).alias("v"), F.avg(1 / F.col("host_n")).alias("inv"))
    # Method of moments: the variance between hosts is what is left of that of their rates without that of sampling.
    between = F.greatest(F.col("v") - F.col("m") * (1 - F.col("m")) * F.col("inv"), F.lit(1e-6))
    world = world.select("m", F.greatest(F.lit(1.0), F.least(F.lit(1e4), F.col("m") * (1 - F.col("m")) / between - 1)).alias("strength"))
    sites = paths.join(hosts, "_host").crossJoin(F.broadcast(world))  # one row
    own = F.col("evidence")
    host_rate = (F.col("host_s") - own + F.col("strength") * F.col("m")) / (F.col("host_n") - 1 + F.col("strength"))
    path_rate = (F.col("path_s") - own + F.col("strength") * host_rate) / (F.col("path_n") - 1 + F.col("strength"))
    logit = _logit(own) + F.lit(site_weight) * (_logit(F.col("site")) - _logit(F.col("m")))
    out = seen.join(sites, ["_host", "_path"]).withColumn("site", path_rate).withColumn("posterior", 1 / (1 + F.exp(-logit)))
    return out.select("doc_id", "_host", "_path", "evidence", "site", "posterior", (F.col("posterior") >= threshold).alias("keep"))


def quality_filter(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """docs of which scored() keeps the doc_id. Rows that repeat a doc_id stay if every one of them is kept; a null doc_id stays."""
    return without(docs, written(scored(docs, labels, **options).where("not keep").select("doc_id").distinct(), "rejected"))
