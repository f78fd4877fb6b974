"""SimHash near-duplicate removal over an inverted index of fingerprint blocks that misses no pair.

Each text gets `TABLES` independent 64-bit SimHashes of its bag of words (weight: four times the square root of the term frequency, 15 at most).
Two texts are a pair if their fingerprints differ in at most `MOST` bits over all the tables. Some table then differs in
at most MOST // TABLES bits; it is cut into SAME more blocks than that, so at least SAME blocks of it are equal. The
index is keyed by all sets of SAME blocks. Only the first block of a set is a key of the shuffle; the lists of the others
are sorted where a first block's list lies, so a fingerprint moves once a first block and not once a set. Pairs that
meet are verified by their Hamming distance. Connected components of the verified pairs are the groups, just those that
comparing all pairs would give; the least doc_id of a group stays.

Identical fingerprints are merged before the index; pairs that a list has connected before are not compared again, and
in long lists the greatest cluster isn't compared with itself: the components are those of all pairs, at linear cost for groups of
thousands of copies. Chance meetings (2,145 sets of about 20 bits) grow with the square of the corpus.

Cases: a null or wordless text (and a null doc_id) is in no group. Rows that repeat a doc_id are one document. Ties for
the document that stays go to the least doc_id. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.common import connected_components, text_slices, without, written
from fathomgrid.llm.textvec import Words, mix

TABLES, MOST, SAME = 3, 28, 4
#: Bits within which `triples` of bytes meet; the index above reaches MOST and doesn't use them.
RADIUS = 4
_SMALL = 64
#: A byte's eight bits, each in a byte of its own: one 64-bit addition counts eight bits.
_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]


def triples(matches: int) -> list[tuple[int, int, int]]:
    """Triples of the positions 0 to 7 of which any `matches` positions contain one."""
    if matches == 5:
        return [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
    if matches == 4:
        a = [(0, 1, 2), (3, 4, 5), (6, 7)]
        return [t for g in a for t in combinations(g, 3)] + [(*p, x) for i in range(3) for p in combinations(a[i], 2) for x in a[(i + 1) % 3]]
    if matches == 3:
        return list(combinations(range(8), 3))
    raise ValueError("matches must be 3, 4 or 5")


def simhash(words: Words, tables: int = TABLES) -> np.ndarray:
    """One row of `tables` 64-bit fingerprints a text; a text without words has zeros."""
    out = np.zeros((len(words.count), tables), np.uint64)
    if not len(words.hash):
        return out
    key = np.sort((words.doc().astype(np.uint64) << np.uint64(40)) | (words.hash >> np.uint64(24)))
    new = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    tf = np.diff(np.r_[new, len(key)])
    key = key[new]
    weight = np.minimum(15, np.rint(4 * np.sqrt(tf))).astype(np.uint64)
    doc = (key >> np.uint64(40)).astype(np.int64)
    at = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
    size = np.diff(np.r_[at, len(doc)])
    sub = np.flatnonzero((np.arange(len(doc)) - np.repeat(at, size)) % 16 == 0)  # 16 terms of weight 15 fit a byte
    of = np.searchsorted(sub, at)
    half = np.add.reduceat(weight, at).astype(np.int64)
    term = key & np.uint64(2**40 - 1)
    for t in range(tables):
        code = mix(term, t + 1).view(np.uint8).reshape(-1, 8)
        sums = np.empty((len(sub), 8), np.uint64)
        for b in range(8):
            sums[:, b] = np.add.reduceat(_LANES[code[:, b]] * weight, sub)
        sums = np.add.reduceat(sums.view(np.uint8), of, axis=0, dtype=np.int32)
        out[doc[at], t] = np.packbits(2 * sums > half[:, None], axis=1, bitorder="little").view(np.uint64)[:, 0]
    return out


def fingerprints(docs: DataFrame, tables: int = TABLES) -> DataFrame:
    """(doc_id, f0, f1, ...) of the documents that have words."""
    names = [f"f{t}" for t in range(tables)]

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(part.column(1))
                has = w.count > 0
                f = simhash(w, tables)[has]
                yield pa.RecordBatch.from_arrays([part.column(0).filter(pa.array(has)), *(pa.array(f[:, t].view(np.int64)) for t in range(tables))], ["doc_id", *names])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("doc_id is not null and text is not null").mapInArrow(run, "doc_id long, " + ", ".join(f"{n} long" for n in names))


def blocks(n: int) -> list[tuple[int, int]]:
    """(first bit, bits) of n blocks of a table, as equal as can be."""
    cut = [64 * i // n for i in range(n + 1)]
    return [(lo, hi - lo) for lo, hi in zip(cut, cut[1:])]


def _joined(label: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """label after the edges have connected its rows."""
    root: dict[int, int] = {}

    def find(i: int) -> int:
        while (up := root.get(i, i)) != i:
            i = up
        return i

    for a, b in label[edges].tolist():
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    to = np.arange(len(label))
    for i in root:
        to[i] = find(i)
    return to[label]


def _edges(f: np.ndarray, own: np.ndarray, after: list[tuple[int, int]], most: int) -> np.ndarray:
    """Edges that connect what all pairs of rows of f within `most` bits and with SAME - 1 equal blocks `after` in `own` connect."""
    n = len(f)
    sets = [*combinations(range(len(after)), SAME - 1)]
    label, out = np.arange(n), []

    def linked(x, y):
        return np.bitwise_count(f[x] ^ f[y]).sum(-1, dtype=np.int64) <= most

    def cross(y: np.ndarray) -> None:
        """All rows of y against those that aren't in its greatest cluster."""
        nonlocal label
        name, size = np.unique(label[y], return_counts=True)
        if len(name) < 2:
            return
        x = y[label[y] != name[size.argmax()]]
        g = np.ascontiguousarray(f[y].T)
        step = max(1, 500_000 // len(y))
        for at in range(0, len(x), step):
            part = x[at : at + step]
            away = sum(np.bitwise_count(f[part, t][:, None] ^ g[t]).astype(np.uint16 if len(g) > 3 else np.uint8) for t in range(len(g)))
            i, j = np.nonzero(away <= most)
            i, j = part[i], y[j]
            while len(i):
                new = label[i] != label[j]
                i, j = i[new], j[new]
                one = np.unique(i, return_index=True)[1]  # an edge a row, then those that are still apart
                if len(one):
                    out.append(np.stack([i[one], j[one]], 1))
                    label = _joined(label, out[-1])

    def meet(order: np.ndarray, new: np.ndarray) -> None:
        """Rows in order; new marks the first of each run."""
        nonlocal label
        start = np.flatnonzero(new)
        size = np.diff(np.r_[start, n])
        if len(start) == n:
            return
        lab = label[order]
        mixed = (size > 1) & (np.minimum.reduceat(lab, start) != np.maximum.reduceat(lab, start))
        found = []
        short = mixed & (size <= _SMALL)
        at = np.flatnonzero(np.repeat(short, size))
        left = np.repeat(start + size, size)[at] - at
        d = 1
        while True:
            at, left = at[left > d], left[left > d]
            if not len(at):
                break
            i = at[lab[at] != lab[at + d]]
            x, y = order[i], order[i + d]
            ok = linked(x, y)
            found.append(np.stack([x[ok], y[ok]], 1))
            d += 1
        found = np.concatenate(found) if found else np.zeros((0, 2), np.int64)
        if len(found):
            out.append(found)
            label = _joined(label, found)
        for k in np.flatnonzero(mixed & (size > _SMALL)):
            cross(order[start[k] : start[k] + size[k]])

    if n * n < 3000 * len(sets):  # fewer pairs than the sets would cost
        x, y = np.triu_indices(n, 1)
        ok = linked(x, y)
        return np.stack([x[ok], y[ok]], 1)
    part = [(own >> np.uint64(lo)) & np.uint64((1 << bits) - 1) for lo, bits in after]
    kind = np.uint16 if 3 * max(bits for _, bits in after) <= 16 else np.uint64  # 16 bits have a radix sort
    part = [p.astype(kind) for p in part]
    for s in sets:
        key = np.zeros(n, kind)
        for i in s:
            key = (key << kind(after[i][1])) | part[i]
        order = np.argsort(key, kind="stable")
        key = key[order]
        meet(order, np.r_[True, key[1:] != key[:-1]])
    return np.concatenate(out) if out else np.zeros((0, 2), np.int64)


def verified_pairs(groups: DataFrame, tables: int = TABLES, most: int = MOST) -> DataFrame:
    """(a, b) of representatives within `most` bits; they connect what all such pairs connect."""
    cut = blocks(most // tables + SAME)
    firsts = range(len(cut) - SAME + 1)
    entries = ", ".join(
        f"int({(t * len(cut) + i) << 16}L + (shiftrightunsigned(f{t}, {cut[i][0]}) & {(1 << cut[i][1]) - 1}L))" for t in range(tables) for i in firsts
    )
    names = [f"f{t}" for t in range(tables)]

    def run(batches):
        held, seen = None, []

        def pairs(b: pa.Table):
            key, rep = b.column("key").to_numpy(), b.column("rep").to_numpy()
            f = np.stack([b.column(n).to_numpy() for n in names], 1).view(np.uint64)
            start = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
            for s, e in zip(start, [*start[1:], len(key)]):
                t, first = divmod(int(key[s]) >> 16, len(cut))
                if e - s > 1:
                    seen.append(np.sort(rep[s:e][_edges(f[s:e], f[s:e, t], cut[first + 1 :], most)], 1))

        def flush():
            e = np.unique(np.concatenate(seen), axis=0)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(e[:, 0]), pa.array(e[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            last = batch.column("key")[-1].as_py()
            cut_at = int(np.searchsorted(batch.column("key").to_numpy(), last))  # the last list may go on in the next batch
            if held is not None and held.column("key")[0].as_py() == last:
                held = pa.concat_tables([held, t])
                continue
            done = t.slice(0, cut_at)
            done = pa.concat_tables([held, done]) if held is not None else done
            held = t.slice(cut_at)
            if done.num_rows:
                pairs(done.combine_chunks())
            if sum(map(len, seen)) > 200_000:
                yield flush()
        if held is not None:
            pairs(held.combine_chunks())
        if seen:
            yield flush()

    rows = groups.select(F.expr(f"explode(array({entries})) AS key"), "rep", *names)
    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, tables: int = TABLES, most: int = MOST) -> DataFrame:
    """(doc_id, keep_id, hamming): each document to remove, the one of its group that stays, their distance in bits."""
    names = [f"f{t}" for t in range(tables)]
    prints = written(fingerprints(docs, tables), "simhash")
    groups = prints.groupBy(*names).agg(F.min("doc_id").alias("rep"))
    roots = written(connected_components(verified_pairs(groups, tables, most)), "simhash-roots")
    groups = groups.join(roots, groups.rep == roots.id, "left").select(*names, F.coalesce("root", "rep").alias("keep_id"))
    member = prints.join(groups, names)
    kept = groups.groupBy("keep_id").agg(F.count("*").alias("n")).where("n > 1").select("keep_id")
    of_keeper = kept.join(prints, kept.keep_id == prints.doc_id).groupBy("keep_id").agg(*(F.min(n).alias(f"k{n}") for n in names))
    away = sum((F.bit_count(F.col(n).bitwiseXOR(F.col(f"k{n}"))) for n in names), F.lit(0))
    return member.where("doc_id <> keep_id").join(of_keeper, "keep_id", "left").groupBy("doc_id").agg(F.min("keep_id").alias("keep_id"), F.min(F.coalesce(away, F.lit(0))).cast("int").alias("hamming"))


def near_dedup(docs: DataFrame, **options) -> DataFrame:
    """docs without the documents that near_duplicates() removes."""
    return without(docs, written(near_duplicates(docs, **options).select("doc_id"), "near-gone"))
