import gzip

import duckdb
import pytest
from pyspark.sql import functions as F

from fathomgrid import queries
from fathomgrid.config import SearchConfig
from fathomgrid.functions.analysis import analyzer
from fathomgrid.functions.stems import italian_light_stem, porter_stem
from fathomgrid.operators import join as J
from fathomgrid.operators import search as S
from fathomgrid.operators.index import SearchIndex
from fathomgrid.plans import query as Q
from fathomgrid.plans.compile import scored
from fathomgrid.plans.parser import QuerySyntaxError, parse
from fathomgrid.plans.query import field
from fathomgrid.sources.html_links import outlinks
from fathomgrid.sources.warc import html_responses, read_warc
from fathomgrid.sources.wikipedia import read_wikipedia

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SLOW = {"tokenize", "term_counts", "term_idf"}
ROWS = [(1, "the cat sat", 3, ["a b", "c"]), (2, "the cat the dog", None, ["b"]), (3, "a dog ran, the dog", 7, None), (4, "", 5, []), (5, None, None, ["cat"])]


@pytest.fixture(scope="module")
def tiny(spark):
    return SearchIndex.build(spark.createDataFrame(ROWS, "id int, text string, n int, tags array<string>"), "id", ("text", "tags")).persist()


def ids(q, at):
    return sorted(r.doc_id for r in scored(q, at).collect())


T = field("text")


def test_booleans(tiny):
    cat, dog = T.match_term("cat"), T.match_term("dog")
    assert ids(cat & dog, tiny) == [2]
    assert ids(cat | dog, tiny) == [1, 2, 3]
    assert ids(~cat, tiny) == [3, 4, 5]
    assert ids(~~cat, tiny) == [1, 2]
    assert ids(dog & ~cat, tiny) == [3]
    assert ids(T.exists(), tiny) == [1, 2, 3]
    assert ids(T.missing(), tiny) == [4, 5]
    assert ids(field("tags").eq("b"), tiny) == [1, 2]
    assert ids(field("n").exists(), tiny) == [1, 3, 4]
    assert ids(field("n").missing(), tiny) == [2, 5]


def test_terms(tiny):
    assert ids(T.match_all("cat", "dog"), tiny) == [2]
    assert set(ids(T.match_all("cat", "dog", "the"), tiny)) <= set(ids(T.match_min(2, "cat", "dog", "the"), tiny)) <= set(ids(T.match_any("cat", "dog", "the"), tiny))
    assert ids(T.match_text("?!"), tiny) == ids(T.match_text("") & Q.all_docs(), tiny) == []
    assert ids(T.match_term("Cat"), tiny) == []
    assert ids(T.match_min(3, "cat", "dog"), tiny) == []


def test_phrases(tiny):
    assert ids(T.match_phrase("the cat"), tiny) == [1, 2]
    assert ids(T.match_phrase("the dog"), tiny) == [2, 3]
    assert ids(T.match_phrase("cat dog"), tiny) == []
    assert ids(T.match_phrase("cat dog", slop=1), tiny) == [2]
    assert ids(T.match_phrase("the cat the"), tiny) == [2]


def test_filters_refuse_bad_input(tiny):
    with pytest.raises(ValueError):
        field("n").between(None, 1)
    with pytest.raises(ValueError):
        field("n").is_in()
    with pytest.raises(ValueError):
        S.light_search(tiny, T.match_term("cat"), 5, 6)
    assert ids(field("n").between(3, 5), tiny) == [1, 4]


def test_batch_keeps_queries_without_hits(tiny):
    rows = {r.query_id: [h.doc_id for h in r.hits] for r in S.batch_search(tiny, [(1, T.match_term("cat")), (2, T.match_term("zz")), (3, ~T.match_term("cat"))], 2).collect()}
    assert rows[2] == [] and sorted(rows[1]) == [1, 2] and rows[3] == [3, 4]
    assert S.light_batch_search(tiny, [], 3).count() == 0


def test_search_orders_and_limits(tiny):
    got = [r.doc_id for r in S.search(tiny, Q.all_docs(), 3).collect()]
    assert got == [1, 2, 3]
    assert len(S.light_search(tiny, Q.all_docs(), 3, 1).collect()) <= 3


def test_generated_query_join(spark, tiny):
    left = spark.createDataFrame([(1, "cat"), (2, "zz")], "k int, w string")
    clauses = J.generated_clauses(left, "k", lambda row: T.match_any(row["w"]))
    got = {r.k: len(r.hits) for r in J.query_join(left, "k", clauses, tiny, 5).collect()}
    assert got == {1: 2, 2: 0}
    assert [r.k for r in J.query_join(left, "k", clauses, tiny, 5, "inner").collect()] == [1]


def test_partitioning_changes_no_score(spark, tiny):
    many = SearchIndex.build(spark.createDataFrame(ROWS, "id int, text string, n int, tags array<string>").repartition(5), "id", ("text", "tags"))
    q = T.match_text("the dog")
    assert sorted(scored(q, many).collect()) == sorted(scored(q, tiny).collect()) == sorted(scored(q, tiny.partitioned(3)).collect())


def test_save_and_load(spark, tiny, tmp_path):
    back = tiny.save(str(tmp_path / "index"))
    assert ids(T.match_phrase("the cat"), back) == [1, 2]
    assert [r.text for r in S.get_element(back, 1).collect()] == ["the cat sat"]
    assert S.get_element(back, 99).count() == 0


def test_positions_can_be_left_out(spark):
    at = SearchIndex.build(spark.createDataFrame([(1, "a b")], "id int, text string"), "id", ("text",), no_positions=("text",))
    assert ids(T.match_phrase("a b"), at) == [] and ids(T.match_term("a"), at) == [1]


def test_empty_table(spark):
    at = SearchIndex.build(spark.createDataFrame([], "id int, text string"), "id", ("text",))
    assert ids(Q.all_docs(), at) == ids(T.match_text("a"), at) == []


def test_parser():
    assert parse("a b", "f") == Q.Bool(should=(Q.Text("f", "a"), Q.Text("f", "b")))
    assert parse("a AND b", "f") == Q.Bool(must=(Q.Text("f", "a"), Q.Text("f", "b")))
    assert parse("+a -g:b", "f") == Q.Bool(must=(Q.Text("f", "a"),), must_not=(Q.Text("g", "b"),))
    assert parse('"a b"~3^2', "f") == Q.Boost(Q.Phrase("f", "a b", 3), 2.0)
    assert parse("g:(a OR b)", "f") == Q.Bool(should=(Q.Text("g", "a"), Q.Text("g", "b")))
    assert parse("[a TO *}", "f") == Q.Pattern("f", "range", ("a", None, True, False))
    assert parse("/a.b/", "f") == Q.Pattern("f", "regex", "a.b")
    assert parse("abc~1", "f") == Q.Pattern("f", "fuzzy", "abc", 1)
    assert parse("*:*", "f") == Q.All()
    assert parse("well-known", "f") == Q.Text("f", "well-known")
    for bad in ("(a", "a)", "*a", "AND a", "", "a AND", '"a'):
        with pytest.raises(QuerySyntaxError):
            parse(bad, "f")


def test_porter():
    pairs = "caresses caress ponies poni cats cat feed feed agreed agre plastered plaster motoring motor sing sing conflated conflat hopping hop falling fall filing file happy happi sky sky relational relat conditional condit rational ration digitizer digit triplicate triplic hopeful hope goodness good revival reviv adjustment adjust adoption adopt probate probat rate rate controll control roll roll".split()
    assert [porter_stem(w) for w in pairs[::2]] == pairs[1::2]


def test_italian():
    assert [italian_light_stem(w) for w in ("libri", "ragazzi", "amiche", "famiglia", "università")] == ["libri", "ragazz", "amic", "famigl", "universit"]


def test_analyzers(spark):
    at = analyzer("english")
    assert at.analyze(spark, "The dogs' owner's running") == [(1, "dog"), (2, "owner"), (3, "run")]
    assert at.with_words(stops=(), keep=("running",)).analyze(spark, "the running") == [(0, "the"), (1, "running")]
    assert analyzer("italian").analyze(spark, "l'amiche della casa") == [(0, "amic"), (2, "casa")]
    wiki = [t for _, t in analyzer("english_wiki").analyze(spark, "== Head ==\n'''Bold''' [[Link|shown]] {{tpl|x}} [[Category:Cats]] <ref>gone</ref>")]
    assert wiki == ["head", "bold", "shown", "cat"]
    assert analyzer("default").analyze(spark, None) == []


def test_config(monkeypatch):
    monkeypatch.setenv("FATHOMGRID_K1", "2")
    assert SearchConfig.from_env().k1 == 2.0
    assert SearchConfig.from_dict({"index_analyzer": "english"}).at_query.name == "english"
    for bad in ({"b": 2}, {"idf": "x"}, {"nothing": 1}, {"similarity": "x"}):
        with pytest.raises(ValueError):
            SearchConfig.from_dict(bad)


RECORD = "WARC/1.0\r\nWARC-Type: {t}\r\nWARC-Target-URI: http://a.b/c\r\n\r\nContent-Length: {n}\r\n\r\n{c}\r\n\r\n"


def test_warc(spark, tmp_path):
    body = "HTTP/1.1 200 OK\r\nX: y\r\n\r\n<a href='d'>d</a>"
    data = "".join(RECORD.format(t=t, n=len(body), c=body) for t in ("warcinfo", "response", "request")).encode()
    (tmp_path / "a.warc").write_bytes(data)
    (tmp_path / "b.warc.gz").write_bytes(gzip.compress(data.replace(b"\r\n", b"\n").replace(f"Content-Length: {len(body)}".encode(), f"Content-Length: {len(body) - 3}".encode())))
    (tmp_path / "empty.warc").write_bytes(b"")
    rows = read_warc(spark, str(tmp_path)).orderBy("path", "record_number").collect()
    assert [(r.record_number, r.warc_type) for r in rows] == [(1, "warcinfo"), (2, "response"), (3, "request")] * 2
    pages = html_responses(read_warc(spark, str(tmp_path))).collect()
    assert {p.html for p in pages} == {"<a href='d'>d</a>"} and {p.target_uri for p in pages} == {"http://a.b/c"}


def test_wikipedia(spark, tmp_path):
    (tmp_path / "d.xml").write_text("<mediawiki><page><title>A</title><revision><text>x &lt; y</text></revision></page><page><title>B</title><revision><text>z</text></revision></page></mediawiki>")
    assert sorted(read_wikipedia(spark, str(tmp_path / "d.xml")).collect()) == [("A", "x < y"), ("B", "z")]


def test_outlinks(spark):
    html = '<A HREF="x?q=1">x</A><a href=\'/y#z\'>y</a><frame src=w><a href="mailto:a@b.c">m</a><a href="">s</a><a href="p">self</a><a href="x">again</a>'
    rows = spark.createDataFrame([(1, "http://h.com/d/p", html), (2, None, None)], "page_id int, url string, html string")
    assert sorted(r.link for r in outlinks(rows).collect()) == ["http://h.com/d/w", "http://h.com/d/x", "http://h.com/y"]


@pytest.mark.parametrize("name", sorted(set(queries.ORACLE_SQL) - SLOW))
def test_against_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    made = con.execute(queries.ORACLE_SQL[name])
    cols = [d[0] for d in made.description]
    assert sorted(cols) == sorted(df.columns)
    tidy = lambda row: tuple(round(v, 5) if isinstance(v, float) else v for v in row)
    key = lambda row: [(v is None, v) for v in row]
    assert sorted((tidy(r) for r in df.select(cols).collect()), key=key) == sorted(map(tidy, made.fetchall()), key=key)


def test_rows_only(spark):
    for name in set(queries.QUERIES) - set(queries.ORACLE_SQL):
        assert queries.QUERIES[name](spark, SF).count() > 0 or name == "italian_stem"
    assert queries.QUERIES["tokenize"](spark, SF).agg(F.count("*")).first()[0] > 0


def test_a_string_range_is_met_by_one_term(spark):
    index = SearchIndex.build(spark.createDataFrame([(1, "a z", "b"), (2, "m", "lb"), (3, "k", "z")], "id int, text string, tag string"), "id", ("text",)).persist()
    assert ids(T.between("k", "n"), index) == [2, 3]
    assert ids(field("tag").between("b", "m"), index) == [1, 2]
    assert ids(field("no such").eq(1), index) == []


def test_a_search_shuffles_a_row_a_document(spark):
    index = queries.index(spark, SF)
    assert not index.postings.is_cached
    for q in (T.parse("the^2.5 OR text:der"), T.match_all("the", "of"), T.match_text("the and der")):
        assert scored(q, index)._jdf.queryExecution().executedPlan().toString().count("Exchange ") == 1
    assert "Exchange " not in index.postings._jdf.queryExecution().executedPlan().toString()


def test_clauses_keep_the_best_of_each_query_as_they_go(spark):
    rows = [(i, " ".join("abcd"[(i * j) % 4] for j in range(1, 2 + i % 5)), ["a"] if i % 3 else None) for i in range(60)]
    df = spark.createDataFrame(rows, "id int, text string, tags array<string>").repartition(3)
    for config in (SearchConfig(), SearchConfig(similarity="tfidf"), SearchConfig(idf="ttf")):
        fresh, kept = (SearchIndex.build(df, "id", ("text", "tags"), config=config) for _ in "12")
        kept = kept.persist()
        clauses = spark.createDataFrame([(1, "text", "a", 1.0, 1), (1, "text", "b", 2.0, 1), (1, "tags", "a", 1.0, 1), (2, "text", "c", 1.0, 2), (2, "text", "d", 1.0, 2), (3, "text", "zz", 1.0, 1), (None, "text", "b", 1.0, 1)], "query_id int, field string, term string, qtf double, need int")
        for alone in (False, True):
            out = J.light_query_join(clauses, fresh, 4, alone)
            assert sorted(map(str, out.collect())) == sorted(map(str, J.light_query_join(clauses, kept, 4, alone).collect()))
            assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
        kept.unpersist()


def test_only_words_near_a_stem_go_to_python(spark):
    ends = "s es ed ing ational tional enci anci izer bli alli entli eli ousli ization ation ator alism iveness fulness ousness aliti iviti biliti logi icate ative alize iciti ical ful ness al ance ement ment ion y ies e i ii chi ghe io ia à".split()
    words = sorted({b + e for b in ("licens", "conform", "hop", "fiss", "radic", "perché", "sk", "possi", "amic") for e in ends} | {b + e + f for b in ("conform", "oper", "sens") for e in ends for f in ends})
    for name, stem in (("english", porter_stem), ("italian", italian_light_stem)):
        at = analyzer(name)
        rows = spark.createDataFrame([(stem(w), w) for w in words], "stem string, word string")
        for s in sorted({stem(w) for w in words})[::40]:
            kept = {w for r in rows.select(at.nearby(F.array("word"), [s]).alias("k")).collect() for w in r.k}
            assert {w for w in words if stem(w) == s} <= kept < set(words)
    docs = spark.createDataFrame([(1, "the licenses' versions"), (2, "licensing"), (3, None)], "id int, text string")
    index = SearchIndex.build(docs, "id", ("text",), config=SearchConfig(index_analyzer=analyzer("english")))
    q = T.match_text("license version")
    assert sorted(scored(q, index).collect()) == sorted(scored(q, index.configured(index.config).partitioned(2)).collect()) and ids(q, index) == [1, 2]
    assert "startswith" in scored(q, index)._jdf.queryExecution().optimizedPlan().toString().lower()
