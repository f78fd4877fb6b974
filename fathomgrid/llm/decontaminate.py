"""Benchmark decontamination by SimHash over item-sized windows.

Similarity is the weighted Jaccard coefficient of two-word shingles; a shingle weighs log(1 + N / df) over the N
benchmark items, df counted by `slots` hashed slots (a fixed-size table, whatever the benchmark), log(1 + N) if in no item.
1. Every document is slid over, word by word, by a window of each item size. A window that reaches similarity t with
   some item of its size covers shingles of the benchmark that weigh at least t times the lightest such item; one
   cumulative sum gives that bound for all windows, and those below it, which cannot match, go no further.
2. The others get a 64-bit SimHash of their words and shingles. Four blocks of 16 bits are the multi-index: two
   fingerprints within 15 bits agree up to 3 bits in some block, so items are listed under every key within 3 bits and
   windows under their own; an equi-join finds all fingerprints within the radius.
3. Candidates within the radius are verified by their exact similarity; the best window of each document and item stays.

A document shorter than an item is one window. Cases: null texts, null ids and items of fewer than two words match
nothing; empty tables give empty results; of tied windows the first, then the shortest, is reported; repeated rows of
either table report once; extra columns are not read, whatever their names.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.common import text_slices, without, written
from fathomgrid.llm.textvec import Words, mix

RADIUS, SLOTS = 15, 1 << 20
_MASKS = [sum(1 << b for b in c) for k in range(4) for c in combinations(range(16), k)]


def _bits(h: np.ndarray) -> np.ndarray:
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1).astype(np.int8) * np.int8(2) - np.int8(1)


def _running(h: np.ndarray) -> np.ndarray:
    out = np.zeros((len(h) + 1, 64), np.int32)
    np.cumsum(_bits(h), axis=0, out=out[1:])
    return out


def window_prints(words: np.ndarray, pairs: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
    """SimHash of the n words, and the n - 1 pairs, from each start on."""
    a, b = _running(mix(words, 11)), _running(mix(pairs, 12))
    s = a[start + n] - a[start] + b[start + n - 1] - b[start]
    return np.packbits(s > 0, axis=1).view(np.uint64)[:, 0]


def _items(bench: DataFrame) -> DataFrame:
    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(part.column(1))
                pairs, _ = w.grams(2)
                keep = np.flatnonzero(w.count > 1)
                first, n = w.first[keep], w.count[keep]
                fp = window_prints(w.hash, pairs, first, n) if len(keep) else np.zeros(0, np.uint64)
                sh = [pairs[i : i + k - 1].view(np.int64) for i, k in zip(first, n)]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep)), pa.array(n.astype(np.int32)), pa.array(fp.view(np.int64)), pa.array(sh, pa.list_(pa.int64()))], ["item_id", "n", "fp", "shingles"])

    rows = bench.select(F.col("item_id").cast("long").alias("item_id"), "text").where("item_id is not null and text is not null").distinct()
    return rows.mapInArrow(run, "item_id long, n int, fp long, shingles array<long>")


def _weights(items: DataFrame, slots: int) -> tuple[np.ndarray, list]:
    """Weight by slot, and (size, least weight of an item of that size)."""
    total = items.select("item_id").distinct().count()
    df = items.select("item_id", F.explode("shingles").alias("s")).groupBy(F.col("s").bitwiseAND(F.lit(slots - 1)).alias("slot")).agg(F.countDistinct("item_id").alias("df"))
    rows = df.toArrow()  # at most `slots` rows
    weight = np.full(slots, np.log1p(total), np.float32)
    live = np.zeros(slots, bool)
    at = rows.column("slot").to_numpy()
    weight[at] = np.log1p(total / rows.column("df").to_numpy())
    live[at] = True
    by_slot = np.where(live, weight, -weight)  # the sign says whether the benchmark has the slot
    return by_slot, total


def leaks(docs: DataFrame, bench: DataFrame, similarity: float = 0.6, slots: int = SLOTS) -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity): each item that a document holds, with its best window."""
    spark = docs.sparkSession
    items = written(_items(bench), "items")
    by_slot, _ = _weights(items, slots)
    shared = spark.sparkContext.broadcast(by_slot)  # 4 bytes a slot
    mask = np.uint64(slots - 1)

    def item_weight(batches):
        w = np.abs(shared.value)
        for b in batches:
            sh = b.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([float(w[(np.unique(np.array(s)).view(np.uint64) & mask).astype(np.int64)].sum()) for s in sh], pa.float64())], ["n", "w"])

    sizes = items.select("shingles", "n").mapInArrow(item_weight, "n int, w double").groupBy("n").agg(F.min("w").alias("w")).orderBy("n").collect()  # one row a size
    sizes = [(r.n, r.w * similarity * (1 - 1e-5)) for r in sizes]
    kinds = "doc_id long, pairs array<long>, windows array<struct<start: int, m: int, n: int, fp: bigint>>"

    def scan(batches):
        table = shared.value
        struct = pa.struct([("start", pa.int32()), ("m", pa.int32()), ("n", pa.int32()), ("fp", pa.int64())])
        low, most = (min(w for _, w in sizes), max(n for n, _ in sizes)) if sizes else (0, 0)
        for batch in batches:
            for part in text_slices(batch, "text") if sizes else ():
                w = Words(part.column(1))
                pairs, ok = w.grams(2)
                if not len(pairs):
                    continue
                gain = np.where(ok, np.maximum(table[(pairs & mask).astype(np.int64)], 0), 0).astype(np.float64)
                total = np.r_[0.0, np.cumsum(gain)]
                reach = total[np.minimum(np.arange(len(gain)) + most - 1, len(gain))] - total[:-1]
                hot = np.unique(np.repeat(np.arange(len(w.count)), w.count)[reach >= low])  # a superset: windows may run over the end
                ids, out = part.column(0), []
                for d in hot:
                    a, k = w.first[d], w.count[d]
                    if k < 2:
                        continue
                    t = total[a : a + k] - total[a]
                    found = []
                    for n, need in sizes:
                        m = min(n, k)
                        s = np.flatnonzero(t[m - 1 :] - t[: k - m + 1] >= need)
                        if len(s):
                            found.append(np.stack([s, np.full(len(s), m), np.full(len(s), n)], 1))
                    if found:
                        out.append((d, np.concatenate(found)))
                if not out:
                    continue
                rows, docs_at = [], []
                for d, f in out:
                    a, k = w.first[d], w.count[d]
                    fp = window_prints(w.hash[a : a + k], pairs[a : a + k], f[:, 0], f[:, 1]).view(np.int64)
                    rows.append((f, fp))
                    docs_at.append(d)
                f = np.concatenate([r[0] for r in rows]).astype(np.int32)
                fp = np.concatenate([r[1] for r in rows])
                ends = np.r_[0, np.cumsum([len(r[1]) for r in rows])].astype(np.int32)
                windows = pa.ListArray.from_arrays(pa.array(ends), pa.StructArray.from_arrays([pa.array(f[:, 0]), pa.array(f[:, 1]), pa.array(f[:, 2]), pa.array(fp)], fields=list(struct)))
                sh = pa.array([pairs[w.first[d] : w.first[d] + w.count[d] - 1].view(np.int64) for d in docs_at], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(docs_at)), sh, windows], ["doc_id", "pairs", "windows"])

    live = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null")
    live = written(live.mapInArrow(scan, kinds).withColumn("row", F.monotonically_increasing_id()), "windows")
    key = lambda block, x: F.expr(f"n * 262144L + {block} * 65536L + {x}")
    block = lambda b: f"(shiftrightunsigned(fp, {16 * b}) & 65535L)"
    win = live.select("row", F.inline("windows"))  # one row a window: a row of `live` has each start and size once
    win = win.withColumn("key", F.explode(F.array(*(key(b, block(b)) for b in range(4)))))
    masks = "array(" + ",".join(map(str, _MASKS)) + ")"
    probe = items.select("item_id", "n", "fp", F.expr(f"explode({masks})").alias("mask"))
    probe = probe.select("item_id", F.col("fp").alias("item_fp"), F.explode(F.array(*(key(b, f"({block(b)} ^ mask)") for b in range(4)))).alias("key"))
    near = win.join(probe, "key").where(F.bit_count(F.col("fp").bitwiseXOR(F.col("item_fp"))) <= RADIUS).select("row", "start", "m", "item_id").distinct()
    near = near.join(live.select("row", "doc_id", "pairs"), "row").join(items.select("item_id", "shingles").dropDuplicates(["item_id", "shingles"]), "item_id")
    near = near.select("doc_id", "item_id", "start", "m", F.slice("pairs", F.col("start") + 1, F.col("m") - 1).alias("a"), F.col("shingles").alias("b"))

    def verify(batches):
        weight = np.abs(shared.value).astype(np.float64)

        def distinct(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
            of = np.repeat(np.arange(len(col), dtype=np.int64), col.value_lengths().to_numpy(zero_copy_only=False))
            both = np.stack([of, col.flatten().to_numpy(zero_copy_only=False)], 1)
            both = np.unique(both, axis=0)
            return both, weight[both[:, 1] & (slots - 1)]

        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.num_rows
            (a, wa), (b, wb) = distinct(batch.column(4)), distinct(batch.column(5))
            both = np.concatenate([a, b])
            order = np.lexsort((both[:, 1], both[:, 0]))
            twice = np.flatnonzero((both[order][1:] == both[order][:-1]).all(1))
            common = np.bincount(both[order[twice], 0], np.concatenate([wa, wb])[order[twice]], n)
            sim = common / (np.bincount(a[:, 0], wa, n) + np.bincount(b[:, 0], wb, n) - common)
            ok = pa.array(sim >= similarity)
            yield pa.RecordBatch.from_arrays([*(batch.column(i).filter(ok) for i in range(4)), pa.array(sim).filter(ok)], ["doc_id", "item_id", "start", "m", "similarity"])

    sure = near.mapInArrow(verify, "doc_id long, item_id long, start int, m int, similarity double")
    best = sure.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.round("similarity", 6).alias("s"), (-F.col("start")).alias("a"), (-F.col("m")).alias("m"))).alias("x"))
    return best.select("doc_id", "item_id", (-F.col("x.a")).alias("start_word"), (-F.col("x.m")).alias("n_words"), F.col("x.s").alias("similarity"))


def decontaminate(docs: DataFrame, bench: DataFrame, **options) -> DataFrame:
    """docs without those that hold a benchmark item; a null doc_id stays."""
    return without(docs, written(leaks(docs, bench, **options).select("doc_id").distinct(), "leaks"))
