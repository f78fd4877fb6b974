"""Best-fit packing of documents into bins of `capacity` words through a configuration linear program.

Texts longer than a bin are cut into full pieces and a rest. The pieces' length histogram (at most `capacity` counts,
whatever the corpus) goes to the driver. There, a configuration is a multiset of lengths that fits one bin, and the
program takes as few configurations as cover all counts: multiplicative weights keep a price for each length, a knapsack
dynamic program finds the configuration worth most at these prices, and the prices of the lengths that it covers fall.
The fractional solution is rounded down, and what is left over is packed by best fit, a configuration at a time.
Configurations are then dealt out in Spark: a piece's rank among those of its length (a row number within a hash
bucket plus the counts of the buckets before it) falls into one configuration's interval and so into one bin.

Cases: texts that are null or have no words have no pieces. Rows that repeat a doc_id (or have none) are pieces of
their own. Ties are dealt in order of doc_id. Empty tables give an empty result. Other columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomgrid.llm.common import written


def knapsack(price: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of each length (ascending) in a configuration of the greatest price, by dynamic programming over room.

    A second pass lowers counts above `most` and gives the room to the next best lengths.
    """
    best = np.zeros(capacity + 1)
    pick = np.full(capacity + 1, -1)
    for room in range(int(lengths[0]), capacity + 1):
        k = np.searchsorted(lengths, room, side="right")
        value = best[room - lengths[:k]] + price[:k]
        i = int(value.argmax())
        if value[i] > best[room - 1]:
            best[room], pick[room] = value[i], i
        else:
            best[room] = best[room - 1]
    count = np.zeros(len(lengths), np.int64)
    room = capacity
    while room > 0:
        i = pick[room]
        if i < 0:
            room -= 1
            continue
        count[i] += 1
        room -= int(lengths[i])
    count = np.minimum(count, most)
    return filled(count, lengths, most, capacity)


def filled(count: np.ndarray, lengths: np.ndarray, most: np.ndarray, capacity: int) -> np.ndarray:
    """count with the room that is left given to the longest lengths that fit."""
    room = capacity - int(count @ lengths)
    for i in range(np.searchsorted(lengths, room, side="right") - 1, -1, -1):
        if lengths[i] <= room:
            k = min(int(most[i] - count[i]), room // int(lengths[i]))
            count[i] += k
            room -= k * int(lengths[i])
        if room < lengths[0]:
            break
    return count


def solve(lengths: np.ndarray, counts: np.ndarray, capacity: int, rounds: int = 200, step: float = 0.25) -> list[tuple[np.ndarray, int]]:
    """Configurations and how many bins each fills; together they hold each count exactly."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    need, cover = counts.astype(float), np.zeros(len(lengths))
    found: dict[bytes, float] = {}
    if len(lengths):
        base = lengths / capacity  # a length's fair share of a bin
        for _ in range(rounds):
            part = cover / need
            if part.min() >= 1:
                break
            price = base * np.exp(-8 * np.clip(part, 0, 1)) * (part < 1)
            c = knapsack(price, lengths, counts, capacity)
            used = c > 0
            times = max(1.0, step * float((need[used] / c[used]).min()))
            cover[used] += times * c[used]
            found[c.tobytes()] = found.get(c.tobytes(), 0) + times
    left, out = counts.copy(), []
    for key, times in sorted(found.items(), key=lambda x: (-x[1], x[0])):
        c = np.frombuffer(key, np.int64)
        used = c > 0
        n = min(int(times), int((left[used] // c[used]).min()))
        if n:
            out.append((c, n))
            left = left - n * c
    while left.any():
        i = int(np.flatnonzero(left)[-1])
        c = np.zeros(len(lengths), np.int64)
        c[i] = 1
        c = filled(c, lengths, left, capacity)
        n = int((left[c > 0] // c[c > 0]).min())
        out.append((c, n))
        left = left - n * c
    return [(c, n) for c, n in out]


def pieces(docs: DataFrame, capacity: int, length: Column | None = None, buckets: int = 64) -> DataFrame:
    """(doc_id, piece, start, length, bucket)."""
    n = F.regexp_count("text", F.lit(r"\S+")) if length is None else length
    rows = docs.select("doc_id", n.cast("long").alias("n")).where("n > 0")
    rows = rows.select("doc_id", "n", F.explode(F.sequence(F.lit(0), ((F.col("n") - 1) / capacity).cast("int"))).alias("piece"))
    start = F.col("piece").cast("long") * capacity
    return rows.select("doc_id", "piece", start.alias("start"), F.least(F.lit(capacity), F.col("n") - start).cast("int").alias("length"), F.pmod(F.xxhash64("doc_id", "piece"), F.lit(buckets)).cast("int").alias("bucket"))


def packed(docs: DataFrame, capacity: int = 2048, length: Column | None = None, buckets: int = 64) -> DataFrame:
    """(doc_id, piece, start, length, bin): where each piece goes; no bin holds more than `capacity`."""
    rows = written(pieces(docs, capacity, length, buckets), "pieces")
    hist = written(rows.groupBy("length", "bucket").count(), "lengths")
    total = hist.groupBy("length").agg(F.sum("count").alias("n")).orderBy("length").collect()  # at most `capacity` rows
    lengths, counts = np.array([r.length for r in total], np.int64), np.array([r.n for r in total], np.int64)
    # A full piece fills a bin: nothing to choose.
    some = lengths < capacity
    plan = solve(lengths[some], counts[some], capacity)
    table: dict[int, list] = {}
    at, begun = 0, {}
    sizes = lengths[some]
    for c, n in plan:
        for i in np.flatnonzero(c):
            k, r = int(sizes[i]), begun.get(int(sizes[i]), 0)
            table.setdefault(k, []).append((r, at, int(c[i])))
            begun[k] = r + n * int(c[i])
        at += n
    if (~some).any():
        table[capacity] = [(0, at, 1)]
    lookup = {k: tuple(np.array(x, np.int64) for x in zip(*v)) for k, v in table.items()}
    before = F.sum("count").over(W.partitionBy("length").orderBy("bucket").rowsBetween(W.unboundedPreceding, -1))
    offset = hist.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    rank = F.row_number().over(W.partitionBy("length", "bucket").orderBy("doc_id", "piece")) - 1
    ranked = rows.withColumn("rank", rank).join(offset, ["length", "bucket"]).select("doc_id", "piece", "start", "length", (F.col("rank") + F.col("before")).alias("rank"))

    def deal(batches):
        for b in batches:
            length, rank = b.column(3).to_numpy(), b.column(4).to_numpy()
            out = np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            cut = np.flatnonzero(np.r_[True, length[order][1:] != length[order][:-1]]) if len(length) else []
            for s, e in zip(cut, [*cut[1:], len(length)]):
                i = order[s:e]
                first, base, per = lookup[int(length[i[0]])]
                j = np.searchsorted(first, rank[i], side="right") - 1
                out[i] = base[j] + (rank[i] - first[j]) // per[j]
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in range(4)), pa.array(out)], ["doc_id", "piece", "start", "length", "bin"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return ranked.mapInArrow(deal, f"doc_id {kind}, piece int, start long, length int, bin long")
