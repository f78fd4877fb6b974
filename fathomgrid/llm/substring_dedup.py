"""Repeated spans of at least `LEAST` words by De Bruijn graph compaction.

An edge is a token k-mer with k = `least` words, so every repeated edge is a repeated span by itself and a path of
edges is a longer one.
1. A k-mer's minimizer is the least hashed q-gram in it (of equal ones the last), which its words alone decide. The
   minimizers of all k-mers are counted; k-mers whose minimizer has one place only repeat nowhere and are not made.
2. The others are made from the texts, which are fetched by locator and never shuffled. Neighbouring k-mers of one
   minimizer travel together, as one row keyed by the minimizer: their hashes, and those of the k-mers beside them.
3. Edges of a minimizer meet by hash. One with a single place is dropped. A link to the next edge is kept where two
   places or more make it, and is nonbranching where it is the one kept link out of its edge and the one kept link into
   the next. A minimizer of more than `hot` places meets k-mer by k-mer instead, through aggregations that combine
   before the shuffle, so that no list of its places comes together in a task.
4. Runs over nonbranching links compact within each document first. Joins of the runs' parts with the first place
   (source coordinates) of the same edges then tie runs of one path together; their components are the paths.
5. Verification is at the source coordinates: the words of every repeated stretch are fetched, combined where they are
   equal, and compared with the words at the first place of their edges. Should any differ, a hash has collided, and all
   is done again with other hashes: what is returned repeats word by word.

Result: a row for each run, (doc_id, start_word, n_words, path_id, places). Overlapping rows are pieces of one longer
repeat. Cases: null or short texts and null ids have no spans; a text of any length is read whole; an empty table gives
an empty result; a span that repeats within one document counts; rows that repeat a doc_id are one document, so equal
words at equal positions of theirs are one place. Ties go to the least (doc_id, position). Extra columns of any name
are not read, and `repeats_removed` carries them.
"""

from __future__ import annotations

from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from fathomgrid.llm.common import columns, connected_components, dropped, fitted, free, text_slices, written
from fathomgrid.llm.locate import fetched, file_key, on_files, row_groups, row_key
from fathomgrid.llm.textvec import U, Words, mix, powers, sliding_min

LEAST, GRAM, HOT = 50, 20, 1 << 17
_BYTE, _WORD = 0xA0761D6478BD642F, 0xE7037ED1A0B428DB
_LOW = U(2**24 - 1)
_KMER = np.dtype([("h", "<i8"), ("check", "<i4")])
_CARRIED = "m long, doc long, f long, row long, at int, back long, ahead long, kmers binary"
_STRETCH = "doc long, f long, row long, at int, edges int, places int, joins int, ff long, frow long, fat int"
_RUN = "kind int, doc long, f long, row long, at int, edges int, places int, ff long, frow long, fat int"


def minimizers(w: Words, q: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash of the q-gram at each word; for the k words from each word on, whether a text has them and the place of their minimizer."""
    h, _ = w.grams(q)
    n, window = len(h), k - q + 1
    whole = np.arange(n) + k <= np.repeat(w.first[1:], w.count)
    place = np.zeros(n, np.int64)
    for a in range(0, max(n - window + 1, 0), 1 << 23):
        x = h[a : a + (1 << 23) + window - 1]
        low = sliding_min((x & ~_LOW) | (_LOW - np.arange(len(x), dtype=U)), window)
        place[a : a + len(low)] = a + (_LOW - (low & _LOW)).astype(np.int64)
    return h, whole, place


def _second(w: Words, k: int) -> np.ndarray:
    """A hash of the k words from each word on that shares nothing with Words.grams."""
    up, down = powers(_BYTE ^ (w.seed << 16), len(w.raw) + 1)
    total = np.zeros(len(w.raw) + 1, U)
    np.cumsum((w.raw.astype(U) + U(257)) * down[: len(w.raw)], out=total[1:])
    word = mix((total[w.end] - total[w.start]) * up[w.start], 21)
    n = len(word)
    up, down = powers(_WORD ^ (w.seed << 16), n + 1)
    total = np.zeros(n + 1, U)
    np.cumsum(word * down[:n], out=total[1:])
    out = np.zeros(n, U)
    if n >= k:
        out[: n - k + 1] = mix((total[k:] - total[: n - k + 1]) * up[: n - k + 1], 22)
    return out


def _plain(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all words, each followed by a space, and where each word begins among them (one end more)."""
    size = w.end - w.start
    off = np.r_[0, np.cumsum(size + 1)]
    out = np.full(int(off[-1]), 32, np.uint8)
    inner = np.arange(int(size.sum())) + np.repeat(np.arange(len(size)), size)
    out[inner] = w.raw[np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size) + np.repeat(w.start, size)]
    return out, off


def _places(rows: DataFrame, least: int, gram: int, seed: int) -> DataFrame:
    """(h, f, row, at) of every minimizer."""

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                w = Words(part.column(2), seed=seed)
                h, whole, place = minimizers(w, gram, least)
                at = np.unique(place[whole])
                d = np.searchsorted(w.first, at, side="right") - 1
                yield pa.RecordBatch.from_arrays([pa.array(h[at].view(np.int64)), pa.array(part.column(0).to_numpy()[d]), pa.array(part.column(1).to_numpy()[d]), pa.array((at - w.first[d]).astype(np.int32))], ["h", "f", "row", "at"])

    return rows.mapInArrow(run, "h long, f long, row long, at int")


def _carried(places: DataFrame, groups: DataFrame, least: int, gram: int, seed: int) -> DataFrame:
    """Rows of neighbouring k-mers that have one minimizer, of the minimizers at `places` (f, row, at)."""

    def visit(part: pa.RecordBatch, has, which):
        w = Words(has["text"], seed=seed)
        h, whole, place = minimizers(w, gram, least)
        mark = np.zeros(len(h), bool)
        mark[w.first[which] + part.column(2).to_numpy()] = True
        s = np.flatnonzero(whole)
        s = s[mark[place[s]]]
        if not len(s):
            return
        k, _ = w.grams(least)
        new = np.flatnonzero(np.r_[True, (place[s[1:]] != place[s[:-1]]) | (s[1:] != s[:-1] + 1)])
        last = s[np.r_[new[1:] - 1, len(s) - 1]]
        kmers = np.empty(len(s), _KMER)
        kmers["h"], kmers["check"] = k[s].view(np.int64), (_second(w, least)[s] >> U(32)).astype(np.uint32).view(np.int32)
        off = (np.r_[new, len(s)] * _KMER.itemsize).astype(np.int32)
        d = np.searchsorted(w.first, s[new], side="right") - 1
        small = (mix(k, 7) >> U(32)).astype(np.int64)
        back = np.where(s[new] > w.first[d], small[np.maximum(s[new] - 1, 0)], -1)
        after = np.minimum(last + 1, len(k) - 1)
        ahead = np.where((last + 1 < len(k)) & whole[after] & (last + 1 < w.first[d + 1]), small[after], -1)
        rows = np.zeros(len(w.count), np.int64)
        rows[which] = part.column(1).to_numpy()
        files = np.zeros(len(w.count), np.int64)
        files[which] = part.column(0).to_numpy()
        ids = has["doc_id"].cast(pa.int64()).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([
            pa.array(h[place[s[new]]].view(np.int64)), pa.array(ids[d]), pa.array(files[d]), pa.array(rows[d]), pa.array((s[new] - w.first[d]).astype(np.int32)),
            pa.array(back), pa.array(ahead), pa.Array.from_buffers(pa.binary(), len(new), [None, pa.py_buffer(off), pa.py_buffer(kmers)]),
        ], ["m", "doc", "f", "row", "at", "back", "ahead", "kmers"])

    return fetched(places.select("f", "row", "at"), groups, visit, _CARRIED, ("doc_id", "text"))


def _whole_keys(batches, key: int, work):
    """work on tables that hold all rows of their keys; the rows come sorted by column `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        k = batch.column(key).to_numpy()
        cut = int(np.searchsorted(k, k[-1]))
        if cut or (held and held[-1].column(key)[-1].as_py() != k[0]):
            held.append(batch.slice(0, cut))
            yield work(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(cut))
    if held:
        yield work(pa.Table.from_batches(held))


def _met(t: pa.Table) -> pa.RecordBatch:
    """The stretches of repeated edges in rows sorted by minimizer, document and position."""
    t = t.combine_chunks()
    doc, f, row, at0, back0, ahead0 = (t.column(c).to_numpy() for c in ("doc", "f", "row", "at", "back", "ahead"))
    col = t.column("kmers")
    col = col.chunk(0) if isinstance(col, pa.ChunkedArray) else col
    size = np.diff(np.frombuffer(col.buffers()[1], np.int32, len(col) + 1, col.offset * 4)) // _KMER.itemsize
    kmers = np.frombuffer(b"".join(col.to_pylist()), _KMER)
    h, check = np.ascontiguousarray(kmers["h"]), np.ascontiguousarray(kmers["check"])
    n, end = len(h), np.cumsum(size)
    of = np.repeat(np.arange(len(size)), size)
    at = at0[of] + np.arange(n) - (end - size)[of]
    small = (mix(h.view(U), 7) >> U(32)).astype(np.int64)
    back, ahead = np.r_[-1, small[:-1]][:n], np.r_[small[1:], -1][:n]
    back[end - size], ahead[end - 1] = back0, ahead0
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    if (same & (check[order][1:] != check[order][:-1])).any():
        order = np.lexsort((check, h))
        same = (h[order][1:] == h[order][:-1]) & (check[order][1:] == check[order][:-1])
    # The same place twice is a repeated row of the table, not a repeated span.
    again = np.r_[False, same & (doc[of[order]][1:] == doc[of[order]][:-1]) & (at[order][1:] == at[order][:-1])][:n]
    lead = np.r_[True, ~same][:n]
    order, lead = order[~again], lead[~again]
    start = np.flatnonzero(lead)
    places = np.diff(np.r_[start, len(order)])
    keep = np.repeat(places > 1, places)
    order, places = order[keep], places[places > 1]
    start = np.cumsum(places) - places
    edge = np.repeat(np.arange(len(places)), places)
    joins = np.zeros(len(order), np.int32)
    for bit, value in ((1, back[order]), (2, ahead[order])):
        has = np.flatnonzero(value >= 0)
        key = (edge[has] << 32) | value[has]
        kinds, inverse, times = np.unique(key, return_inverse=True, return_counts=True)
        kept = times > 1
        ways = np.bincount(kinds[kept] >> 32, minlength=len(places))
        joins[has] |= np.where(kept[inverse] & (ways[edge[has]] == 1), bit, 0).astype(np.int32)
    # Back to the order of the documents.
    turn = np.argsort(order)
    i, first = order[turn], order[start][edge][turn]
    joins, many = joins[turn], places[edge][turn]
    ff, frow, fat = f[of[first]], row[of[first]], at[first]
    if not len(i):
        return _stretches(*([np.zeros(0, np.int64)] * 10))
    tied = (of[i[1:]] == of[i[:-1]]) & (i[1:] == i[:-1] + 1) & (joins[:-1] & 2 > 0) & (joins[1:] & 1 > 0) & (ff[1:] == ff[:-1]) & (frow[1:] == frow[:-1]) & (fat[1:] == fat[:-1] + 1)
    a = np.flatnonzero(np.r_[True, ~tied])
    b = np.r_[a[1:], len(i)] - 1
    r = of[i[a]]
    return _stretches(doc[r], f[r], row[r], at[i[a]], b - a + 1, np.minimum.reduceat(many, a), (joins[a] & 1) | (joins[b] & 2), ff[a], frow[a], fat[a])


def _stretches(*cols: np.ndarray) -> pa.RecordBatch:
    kinds = [np.int64 if c.endswith("long") else np.int32 for c in _STRETCH.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c.astype(k)) for c, k in zip(cols, kinds)], [c.split()[0] for c in _STRETCH.split(", ")])


def _hot(carried: DataFrame) -> DataFrame:
    """What _met makes, an edge a stretch, by aggregations over k-mers."""

    def run(batches):
        for b in batches:
            for i in range(b.num_rows):
                k = np.frombuffer(b.column(7)[i].as_py(), _KMER)
                n = len(k)
                h = np.ascontiguousarray(k["h"])
                small = (mix(h.view(U), 7) >> U(32)).astype(np.int64)
                whole = lambda c, n=n, i=i: pa.array(np.full(n, b.column(c)[i].as_py(), np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(np.ascontiguousarray(k["check"])), *(whole(c) for c in (1, 2, 3)), pa.array((b.column(4)[i].as_py() + np.arange(n)).astype(np.int32)), pa.array(np.r_[b.column(5)[i].as_py(), small[:-1]]), pa.array(np.r_[small[1:], b.column(6)[i].as_py()])], ["h", "check", "doc", "f", "row", "at", "back", "ahead"])

    rows = carried.mapInArrow(run, "h long, check int, doc long, f long, row long, at int, back long, ahead long")
    rows = rows.groupBy("h", "check", "doc", "at").agg(F.min(F.struct("f", "row", "back", "ahead")).alias("x")).select("h", "check", "doc", "at", "x.*")
    rows = written(rows, "hot-edges")
    edges = rows.groupBy("h", "check").agg(F.count("*").cast("int").alias("places"), F.min(F.struct("doc", "at", "f", "row")).alias("first")).where("places > 1")
    ways = rows.select("h", "check", F.inline(F.array(*(F.struct(F.lit(b).alias("side"), F.col(c).alias("v")) for b, c in ((1, "back"), (2, "ahead")))))).where("v >= 0")
    ways = ways.groupBy("h", "check", "side", "v").count().where("count > 1").groupBy("h", "check", "side").agg(F.count("*").alias("ways"), F.max("v").alias("v")).where("ways = 1")
    ways = ways.groupBy("h", "check").agg(F.max(F.when(F.col("side") == 1, F.col("v"))).alias("in"), F.max(F.when(F.col("side") == 2, F.col("v"))).alias("out"))
    edges = fitted(written(edges.join(ways, ["h", "check"], "left"), "hot-stats"))
    joins = F.when(F.col("back") == F.col("in"), 1).otherwise(0) + F.when(F.col("ahead") == F.col("out"), 2).otherwise(0)
    return rows.join(edges, ["h", "check"]).select("doc", "f", "row", "at", F.lit(1).alias("edges"), "places", joins.alias("joins"), F.col("first.f").alias("ff"), F.col("first.row").alias("frow"), F.col("first.at").alias("fat"))


def _runs(t: pa.Table) -> pa.RecordBatch:
    """Of the stretches of some documents in order: runs (kind 0), what copies one other place (kind 1) or is the first place (kind 2), and, under its run's position, each later part of a run that copies another place than the part before it (kind 3)."""
    doc, f, row, at, edges, places, joins, ff, frow, fat = (t.column(c.split()[0]).to_numpy() for c in _STRETCH.split(", "))
    n = len(doc)
    on = (f[1:] == f[:-1]) & (row[1:] == row[:-1]) & (at[1:] == at[:-1] + edges[:-1])
    linked, copied = on & (joins[:-1] & 2 > 0) & (joins[1:] & 1 > 0), on & (ff[1:] == ff[:-1]) & (frow[1:] == frow[:-1]) & (fat[1:] == fat[:-1] + edges[:-1])
    out = []
    for kind, tied in ((0, linked), (1, copied)):
        a = np.flatnonzero(np.r_[True, ~tied][:n])
        own = np.where((ff[a] == f[a]) & (frow[a] == row[a]) & (fat[a] == at[a]), 2, 1) if kind else np.zeros(len(a))
        out.append((own, doc[a], f[a], row[a], at[a], np.add.reduceat(edges, a) if n else edges, np.minimum.reduceat(places, a) if n else places, ff[a], frow[a], fat[a]))
    a = 1 + np.flatnonzero(linked & ~copied)
    run = np.flatnonzero(np.r_[True, ~linked][:n])
    run = run[np.searchsorted(run, a, side="right") - 1] if n else a
    out.append((np.full(len(a), 3), doc[a], f[a], row[a], at[run], edges[a], places[a], ff[a], frow[a], fat[a]))
    kinds = [np.int64 if c.endswith("long") else np.int32 for c in _RUN.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(k)) for c, k in zip(zip(*out), kinds)], [c.split()[0] for c in _RUN.split(", ")])


def _graph(base: DataFrame, groups: DataFrame, least: int, gram: int, hot: int, seed: int) -> DataFrame:
    """Runs, copies, first places and parts of runs of the table, as _runs has them, written."""
    rows = base.where(base["doc_id"].isNotNull() & base["text"].isNotNull()).select(file_key(base).alias("f"), row_key(base).alias("row"), base["text"].alias("text"))
    places = written(_places(rows, least, gram, seed), "minimizers")
    counts = places.groupBy("h").count().where("count > 1")
    twice = places.join(counts, "h").select("f", "row", "at", "count")
    met = _carried(twice.where(F.col("count") <= hot), groups, least, gram, seed)
    met = met.repartition("m").sortWithinPartitions("m", "doc", "at", "f", "row").mapInArrow(lambda b: _whole_keys(b, 0, _met), _STRETCH)
    if not counts.where(F.col("count") > hot).isEmpty():
        met = met.unionByName(_hot(_carried(twice.where(F.col("count") > hot), groups, least, gram, seed)))
    runs = met.repartition("doc").sortWithinPartitions("doc", "f", "row", "at").mapInArrow(lambda b: _whole_keys(b, 0, _runs), _RUN)
    out = written(runs, "runs")
    dropped(places)
    return out


def _verified(runs: DataFrame, groups: DataFrame, least: int, seed: int) -> bool:
    """Whether the words of all copies are those at their first places."""

    def words(part: pa.RecordBatch, has, which):
        w = Words(has["text"], seed=seed)
        text, off = _plain(w)
        a = w.first[which] + part.column(2).to_numpy()
        b = a + part.column(3).to_numpy() + (least - 1)
        yield pa.RecordBatch.from_arrays([*part.columns[4:7], pa.array([text[i:j].tobytes() for i, j in zip(off[a], off[b])], pa.binary())], ["f", "row", "at", "words"])

    def differ(part: pa.RecordBatch, has, which):
        w = Words(has["text"], seed=seed)
        text, off = _plain(w)
        a = off[w.first[which] + part.column(2).to_numpy()]
        text = text.tobytes()
        bad = sum(not text.startswith(x, i) for i, x in zip(a.tolist(), part.column(3).to_pylist()))
        yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int64())], ["bad"])

    copies = runs.where("kind = 1").select("f", "row", "at", "edges", "ff", "frow", "fat")
    said = fetched(copies, groups, words, "f long, row long, at int, words binary").distinct()
    return not fetched(said, groups, differ, "bad long").agg(F.sum("bad")).first()[0]


def _sound(docs: DataFrame, least: int, gram: int, hot: int, seed: int = 0) -> tuple[DataFrame, DataFrame]:
    """(the documents on files, what _graph makes of them, verified)."""
    base = on_files(docs, "repeats-in")
    groups = row_groups(base)
    for s in count(seed):
        runs = _graph(base, groups, least, min(gram, least), hot, s)
        if _verified(runs, groups, least, s):
            return base, runs
        dropped(runs)
    raise AssertionError


def repeated_spans(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """(doc_id, start_word, n_words, path_id, places) of each run."""
    _, all_runs = _sound(docs, least, gram, hot)
    parts = all_runs.where("kind in (0, 3)").withColumn("run", F.xxhash64("f", "row", "at"))
    runs = parts.where("kind = 0")
    # Each part of a run is joined with the run that holds the first place of its edges: the last one to begin before it.
    firsts = parts.select("run", F.col("ff").alias("f"), F.col("frow").alias("row"), F.col("fat").alias("at"))
    line = runs.select("f", "row", "at", F.lit(0).alias("point"), F.col("run").alias("held")).unionByName(firsts.select("f", "row", "at", F.lit(1).alias("point"), F.lit(None).cast("long").alias("held")).distinct())
    line = line.withColumn("held", F.last("held", ignorenulls=True).over(W.partitionBy("f", "row").orderBy("at", "point").rowsBetween(W.unboundedPreceding, 0))).where("point = 1")
    # Runs that share an edge share the holder of its first place, so all of a path are tied. A run hangs on the least of
    # its holders, and each holder is one of its own: the graph that remains is of holders alone.
    held = written(firsts.join(line.select("f", "row", "at", "held"), ["f", "row", "at"]).select("run", "held").distinct(), "holders")
    tied = held.groupBy("run").agg(F.min("held").alias("a"))
    links = held.join(tied, "run").where("a <> held").select("a", F.col("held").alias("b")).distinct()
    paths = connected_components(links)
    return runs.join(tied, "run").join(paths, F.col("a") == paths.id, "left").select(
        F.col("doc").alias("doc_id"), F.col("at").alias("start_word"), (F.col("edges") + (least - 1)).alias("n_words"), F.coalesce("root", "a").alias("path_id"), "places"
    )


def repeats_removed(docs: DataFrame, least: int = LEAST, gram: int = GRAM, hot: int = HOT) -> DataFrame:
    """docs with the words of repeated spans taken out of their texts, but for the first place of each k-mer, which stays whole.

    A null text stays null; a text of copies alone becomes an empty one. Rows that repeat a doc_id keep the text of the
    row that stands for them, or theirs.
    """
    base, runs = _sound(docs, least, gram, hot)
    parts = runs.where("kind in (1, 2)").groupBy("f", "row").agg(F.collect_list(F.struct("kind", "at", (F.col("at") + F.col("edges") + (least - 1)).alias("to"))).alias("parts"))

    @F.pandas_udf("string")
    def cut(texts, parts):
        import pandas as pd

        out = []
        for text, some in zip(texts, parts):
            if some is None or not len(some):
                out.append(text)
                continue
            w = Words(pa.array([text], pa.string()), lower=False)
            gone, stays = np.zeros(len(w.start) + 1, bool), np.zeros(len(w.start) + 1, bool)
            for p in some:
                (gone if p["kind"] == 1 else stays)[p["at"] : p["to"]] = True
            gone &= ~stays
            a = np.flatnonzero(gone & ~np.r_[False, gone[:-1]])
            b = np.flatnonzero(~gone & np.r_[False, gone[:-1]])
            raw, at, kept = w.raw.tobytes(), 0, []
            for i, j in zip(a, b):
                kept.append(raw[at : w.start[i]])
                at = int(w.start[j]) if j < len(w.start) else int(w.end[j - 1])
            out.append(b"".join([*kept, raw[at:]]).decode())
        return pd.Series(out, dtype=object)

    f, row, to = free(base, "at_f"), free(base, "at_row"), free(base, "at_parts")
    rows = base.select(*columns(base), file_key(base).alias(f), row_key(base).alias(row)).join(parts.toDF(f, row, to), [f, row], "left")
    return rows.select(*(cut(F.col("text"), F.col(to)).alias("text") if c == "text" else F.col(f"`{c}`") for c in base.columns))
