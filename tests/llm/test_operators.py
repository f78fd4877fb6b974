import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fathomgrid.llm import html_extraction, packing, pii, quality, token_counts
from fathomgrid.llm.decontaminate import decontaminate, leaks
from fathomgrid.llm.exact_dedup import exact_dedup
from fathomgrid.llm.licenses import licenses
from fathomgrid.llm.near_dedup import RADIUS, near_dedup, near_duplicates, triples
from fathomgrid.llm.substring_dedup import repeated_spans

KIND = "doc_id long, text string, lang string, source string, n_chars long, start int, length int, count long, bin string"
RNG = np.random.default_rng(3)
VOCABULARY = ["".join(RNG.choice(list("abcdefghij"), 6)) for _ in range(900)]


def prose(n: int) -> str:
    return " ".join(RNG.choice(VOCABULARY, n))


LONG = prose(30_000)
PASSAGE = prose(70)
ITEM = prose(25)
BASE = prose(200)
TEXTS = [
    BASE, BASE, BASE.replace(BASE.split()[40], "changed", 1), None, "", "   ", "x", LONG, f"{prose(60)} {PASSAGE} {prose(60)}", f"{prose(30)}\n{PASSAGE}",
    f"{prose(80)} {ITEM} {prose(80)}", f"{prose(40)}\nReleased under the MIT License.", f"{prose(20)} ann.lee@mail.example.org {prose(20)} +1 (743) 555-3824 x", prose(90),
]
ROWS = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i != 5 else None, None, 1, 2, 3, "z") for i, t in enumerate(TEXTS)] + [(None, "no id", None, None, None, 1, 2, 3, "z"), (13, TEXTS[13], "en", "s1", None, 1, 2, 3, "z")]


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    at = str(tmp_path_factory.mktemp("llm") / "docs")
    spark.createDataFrame(ROWS, KIND).write.parquet(at)
    return spark.read.parquet(at)


@pytest.fixture(scope="module")
def none(spark, docs):
    return spark.createDataFrame([], docs.schema)


def test_exact_dedup(docs, none):
    got = exact_dedup(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect() if r.doc_id is not None) == [0, *range(2, 14)]
    assert exact_dedup(none).count() == 0


def test_exact_dedup_checks_bytes_where_digests_collide(docs):
    got = exact_dedup(docs, digest=lambda t: F.unhex(F.lit("00")))
    assert got.count() == exact_dedup(docs).count()


def test_near_dedup(docs, none):
    pairs = {(r.doc_id, r.keep_id) for r in near_duplicates(docs).collect()}
    assert pairs == {(1, 0), (2, 0)}
    kept = near_dedup(docs)
    assert kept.columns == docs.columns and kept.count() == len(ROWS) - 2
    assert near_duplicates(none).count() == 0


def test_near_duplicates_are_those_of_all_pairs(spark):
    from fathomgrid.llm.near_dedup import MOST, fingerprints

    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    prints = sorted(fingerprints(docs).collect())
    ids, f = np.array([r[0] for r in prints]), np.array([r[1:] for r in prints], np.int64).view(np.uint64)
    pairs = np.concatenate([np.stack([np.full(len(j), i), j], 1) for i in range(len(f)) if len(j := i + 1 + np.flatnonzero(np.bitwise_count(f[i] ^ f[i + 1 :]).sum(1) <= MOST))])
    root = np.arange(len(f))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    want = np.array([find(i) for i in range(len(f))])
    keep = {r.doc_id: r.keep_id for r in near_duplicates(docs).collect()}
    got = np.array([keep.get(i, i) for i in ids.tolist()])
    words = {r.doc_id: r.n for r in docs.select("doc_id", F.regexp_count("text", F.lit(r"\S+")).alias("n")).collect()}
    short = np.array([min(words[ids[a]], words[ids[b]]) < 100 for a, b in pairs])
    two = np.bincount(want)[want[pairs[:, 0]]] == 2
    met = got[pairs[:, 0]] == got[pairs[:, 1]]
    recall = {k: (int(met[m].sum()), int(m.sum())) for k, m in {"all": met | True, "short": short, "long": ~short, "two": two}.items()}
    print(recall)
    assert all(n and hit >= 0.9 * n for hit, n in recall.values()), recall
    assert (ids[want] == got).all(), recall


def test_pairs_at_the_greatest_distance_meet(spark):
    from fathomgrid.llm.near_dedup import MOST, verified_pairs

    rng = np.random.default_rng(5)
    f = rng.integers(0, 2**63, (3000, 3), dtype=np.uint64)
    for i in range(0, 3000, 2):  # groups of two
        f[i + 1] = f[i]
        for bit in rng.choice(192, MOST, replace=False):
            f[i + 1, bit // 64] ^= np.uint64(1) << np.uint64(bit % 64)
    rows = spark.createDataFrame([(*map(int, x), i) for i, x in enumerate(f.view(np.int64))], "f0 long, f1 long, f2 long, rep long")
    assert {(r.a, r.b) for r in verified_pairs(rows).collect()} == {(i, i + 1) for i in range(0, 3000, 2)}


def test_every_set_of_matches_holds_a_triple():
    from itertools import combinations

    for matches in (3, 4, 5):
        assert all(any(set(t) <= set(c) for t in triples(matches)) for c in combinations(range(8), matches))
    assert 8 - RADIUS == 4


def test_decontaminate(spark, docs, none):
    bench = spark.createDataFrame([(1, ITEM), (1, ITEM), (2, None), (3, ""), (4, prose(25)), (None, ITEM)], "item_id long, text string")
    got = leaks(docs, bench).collect()
    assert [(r.doc_id, r.item_id, r.start_word, r.n_words, r.similarity) for r in got] == [(10, 1, 80, 25, 1.0)]
    assert decontaminate(docs, bench).count() == len(ROWS) - 1
    assert leaks(none, bench).count() == leaks(docs, bench.limit(0)).count() == 0


def test_windows_are_not_aggregated(docs):
    bench = docs.selectExpr("doc_id as item_id", "text").where("doc_id = 13")
    plan = leaks(docs, bench)._jdf.queryExecution().optimizedPlan().toString()
    assert "fp#" in plan and not [line for line in plan.split("\n") if "Aggregate" in line and "fp#" in line]


def test_pipeline_bounds_the_bytes_of_a_batch(spark, tmp_path):
    import corpus_pipeline

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    spark.createDataFrame([(i, "some words " * 20_000) for i in range(40)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"])

    try:
        assert corpus_pipeline.clean(spark, docs, str(tmp_path)).count() == 40
        rows = [r.n for r in docs.mapInArrow(sizes, "n long").collect()]
        assert sum(rows) == 40 and max(rows) <= 12  # 220 kB a text
    finally:
        spark.conf.unset(key)


def test_packing(docs, none):
    rows = packing.packed(docs, capacity=128).collect()
    load, words = {}, {}
    for r in rows:
        load[r.bin] = load.get(r.bin, 0) + r.length
        words[r.doc_id] = words.get(r.doc_id, 0) + r.length
    assert max(load.values()) <= 128
    assert words[7] == 30_000 and words[0] == 200 and words[13] == 180 and 3 not in words and 4 not in words
    total = sum(load.values())
    assert len(load) <= 1.1 * total / 128 + 2
    assert packing.packed(none).count() == 0


def test_packing_is_near_the_bound():
    lengths, counts = np.arange(1, 100), np.full(99, 40)
    plan = packing.solve(lengths, counts, 256)
    assert (sum(c * n for c, n in plan) == counts).all() and all(c @ lengths <= 256 for c, _ in plan)
    assert sum(n for _, n in plan) <= np.ceil(counts @ lengths / 256) * 1.02 + 1


def test_substring_against_brute_force(docs, none):
    import re

    seen: dict[tuple, set] = {}
    for i, t in {(r[0], r[1]) for r in ROWS if r[0] is not None and r[1]}:
        w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", t.lower())
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p : p + 50]), set()).add((i, p))
    want = {p for v in seen.values() if len(v) > 1 for p in v}
    got = {(r.doc_id, r.start_word + i) for r in repeated_spans(docs).collect() for i in range(r.n_words - 49)}
    assert got == want and {i for i, _ in got} == {0, 1, 2, 8, 9}
    assert repeated_spans(none).count() == 0


def test_substring_copies_are_compared_with_their_first_places(docs):
    from fathomgrid.llm.locate import row_groups
    from fathomgrid.llm.substring_dedup import GRAM, HOT, LEAST, _graph, _verified

    groups = row_groups(docs)
    runs = _graph(docs, groups, LEAST, GRAM, HOT, 0)
    assert {r.doc for r in runs.where("kind = 1").collect()} == {1, 2, 9} and _verified(runs, groups, LEAST, 0)
    assert not _verified(runs.withColumn("fat", F.col("fat") + 1), groups, LEAST, 0)


def test_substring_paths_are_the_nonbranching_paths_of_the_graph(spark):
    from collections import Counter

    x, y = prose(300).split(), prose(20).split()
    # The first document holds the middle of a path only, so no end of the others' runs has its first place there.
    texts = [x[20:80], x[:100], x[:100], [*x[200:290], *y, *x[210:270]], [*y, *x[190:300], *y[:9]], x[190:300]]
    edges = [[tuple(t[i : i + 50]) for i in range(len(t) - 49)] for t in texts]
    places = Counter(e for t in edges for e in t)
    kept = [link for link, n in Counter(link for t in edges for link in zip(t, t[1:])).items() if n > 1]
    out, into = Counter(a for a, _ in kept), Counter(b for _, b in kept)
    root = {e: e for e, n in places.items() if n > 1}

    def find(e):
        while root[e] != e:
            e = root[e]
        return e

    for a, b in kept:
        if out[a] == into[b] == 1:
            root[find(a)] = find(b)
    want = {(i, p): find(e) for i, t in enumerate(edges) for p, e in enumerate(t) if e in root}
    docs = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id long, text string")
    for hot in (1 << 17, 1):
        rows = repeated_spans(docs, hot=hot).collect()
        got = {(r.doc_id, r.start_word + i): r.path_id for r in rows for i in range(r.n_words - 49)}
        assert set(got) == set(want) and all(r.places == min(places[edges[r.doc_id][r.start_word + i]] for i in range(r.n_words - 49)) for r in rows)
        assert len(set(got.values())) == len(set(want.values())) == len({(got[k], want[k]) for k in got})


def test_licenses(spark, docs, none):
    assert [(r.doc_id, r.license, r.cosine) for r in licenses(docs).collect()] == [(11, "MIT", 1.0)]
    rows = [(1, "a/LICENSE", "Licensed under the Apache License, Version 2.0."), (2, "a/b/c.py", prose(20)), (3, "a/d/COPYING.txt", "Released under the MIT License."), (4, "a/d/e/f.py", None), (5, "g/h.py", prose(5)), (6, "a/d/own.py", "This work is licensed under the GNU General Public License, version 3."), (7, None, prose(5))]
    got = licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()
    assert {r.doc_id: (r.license, r["from"]) for r in got} == {1: ("Apache-2.0", None), 2: ("Apache-2.0", "a"), 3: ("MIT", None), 4: ("MIT", "a/d"), 6: ("GPL-3.0", None)}
    assert licenses(none).count() == 0


def test_licenses_finds_every_line_that_is_planted(spark):
    from collections import Counter

    from fathomgrid.llm.queries import op8_license_scans

    lines = {"GPL-3.0": "licensed under the GNU General Public License, version 3.", "LicenseRef-Proprietary": "All rights reserved.", "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "MIT": "Released under the MIT License.", "Apache-2.0": "Licensed under the Apache License, Version 2.0."}
    rows = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text").where("text is not null").collect()
    want = Counter((r.doc_id, name) for r in rows for name, line in lines.items() if line in r.text)
    got = Counter((r.doc_id, r.license) for r in op8_license_scans(spark, "/root/testdata/sf0.1").collect() if r["from"] is None)
    assert got == want and {name for _, name in want} == set(lines)


def test_licenses_creative_commons_and_notices(spark):
    texts = {
        "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.", "CC-BY-NC-SA-3.0": "Licensed under CC BY-NC-SA 3.0.", "CC-BY-ND-4.0": "SPDX-License-Identifier: CC-BY-ND-4.0", "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "CC-BY-NC-ND-4.0": "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License.", "CC-BY-SA-2.0": "see https://creativecommons.org/licenses/by-sa/2.0/", "LicenseRef-Proprietary": "Copyright 2020 the authors. All rights reserved.", "MIT": "All rights reserved. Released under the MIT License",
    }
    rows = [(i, str(i), f"{prose(20)}\n{t}\n{prose(20)}") for i, t in enumerate(texts.values())]
    got = licenses(spark.createDataFrame(rows, "doc_id long, path string, text string"), F.col("path")).collect()
    assert {r.doc_id: r.license for r in got} == dict(enumerate(texts))


def test_pii(docs, none):
    got = pii.personal_data(docs).collect()
    assert [(r.doc_id, r.kind, TEXTS[12][r.start : r.end]) for r in sorted(got, key=lambda r: r.start)] == [(12, "email", "ann.lee@mail.example.org"), (12, "phone", "+1 (743) 555-3824")]
    assert pii.personal_data(none).count() == 0


def test_pii_on_held_out_texts():
    detector = pii.trained()
    right = found = true = 0
    for text, spans in pii.labelled(700, seed=123):
        got = {(a, b, k) for a, b, k, _ in pii.redactions(text, detector)}
        right, found, true = right + len(got & spans), found + len(got), true + len(spans)
    assert right / found > 0.95 and right / true > 0.95
    assert pii.redactions("", detector) == [] and pii.redactions("1" * 100_000, detector) == []


def test_pii_redacted_text(spark):
    row = spark.createDataFrame([("call me now", [(0, 4, "phone"), (8, 11, "ip")])], "text string, spans array<struct<start: int, end: int, kind: string>>")
    assert row.select(pii.redacted(F.col("text"), F.col("spans")).alias("t")).first().t == "[phone] me [ip]"


def test_html_blocks():
    page = "lead<p>a <b>b</b> <a href=x>c d</a><br>e<!-- <p>no --><script>if (a<b) {}</script><li>&amp; f<title>gone</title><a>g"
    assert html_extraction.blocks(page) == [("lead", 1, 0), ("a b c d e", 5, 2), ("& f g", 3, 1)]
    for rest in ("<script>never closed", "<style>.x{color:red}", "<!-- never > closed", "<!-- never closed"):
        assert html_extraction.blocks(f"<p>a{rest}") == [("a", 1, 0)]
    assert html_extraction.blocks("a < b<p>c < d") == [("a < b", 3, 0), ("c < d", 3, 0)]


def test_pii_takes_the_whole_address():
    address = "a.b@one.two.three.four.five.six.seven.eight.nine.ten.example.com"
    text = f"write {address}."
    assert [text[a:b] for a, b, kind in pii.candidates(text) if kind == 0] == [address]


def test_token_scan_has_many_tasks(spark, docs, tmp_path):
    path = f"file://{tmp_path}/tokens"
    order = token_counts.write_tokens(docs, path)
    parts = token_counts.blocks(order, path, 1 << 10)
    scanned = token_counts.scan(parts, path)
    n = parts.count()
    assert n > 8 and scanned.select(F.spark_partition_id()).distinct().count() > 4
    assert scanned.count() == n
    with pytest.raises(ValueError):
        token_counts.blocks(order, path, 3)
    assert html_extraction.blocks("<" * 50_000) == [("<" * 50_000, 1, 0)]


def test_html_main_text(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    truth = pages.select("page_id", F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1).alias("a"))
    right = said = true = 0
    for r in html_extraction.main_text(pages).join(truth, "page_id").collect():
        want, got = {b[0] for b in html_extraction.blocks(r.a)}, set(r.text.split("\n"))
        right, said, true = right + len(want & got), said + len(got), true + len(want)
    assert right / said > 0.95 and right / true > 0.95
    odd = spark.createDataFrame([(1, None, None), (2, "u", ""), (2, "u", "plain words only"), (None, None, "<p>")], "page_id long, url string, html string")
    assert [r.n_blocks for r in html_extraction.main_text(odd).orderBy("page_id", "html" if False else "n_blocks").collect()] == [0, 0, 0, 1]
    assert html_extraction.main_text(odd.limit(0)).count() == 0


def test_token_counts(docs, none):
    enc = token_counts.encoder("/opt/tokenizers")
    want = sorted((r[0] is not None, r[0] or 0, len(enc.encode_ordinary(r[1])) if r[1] else 0) for r in ROWS)
    got = token_counts.token_counts(docs, block=1000).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.n_tokens) for r in got) == want
    assert token_counts.token_counts(none).count() == 0


def test_quality(spark, docs, none):
    train = [(i, prose(80), "en", f"s{i % 4}") for i in range(60)] + [(100 + i, "!! ## $$ " * 30 + " A" * 40, "en", "junk") for i in range(60)]
    rows = spark.createDataFrame(train, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, 1 if i < 100 else 0, 0) for i, *_ in train] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in quality.quality_filter(rows, labels).collect()}
    assert kept == set(range(60))
    assert quality.quality_filter(docs, labels.limit(0)).count() == len(ROWS)
    assert quality.quality_filter(none, labels).count() == 0
    assert quality.features(pa.array([None, ""], pa.string())).shape == (2, quality.FEATURES)
