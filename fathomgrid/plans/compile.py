"""A query to one DataFrame of (doc_id, score): one scan for its terms and one aggregation, whatever the query's shape."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.operators.index import Pick, SearchIndex, any_of
from fathomgrid.plans import query as Q
from fathomgrid.plans.parser import parse

_OPS = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b}
NONE = Q.Bool(should=(), must=(), must_not=(Q.All(),))


def resolved(q: Q.Query, index: SearchIndex) -> Q.Query:
    """Analysed texts as terms, query strings as trees, text filters as patterns."""
    if isinstance(q, Q.Parsed):
        return resolved(parse(q.text, q.field), index)
    if isinstance(q, Q.Bool):
        return Q.Bool(*(tuple(resolved(x, index) for x in part) for part in (q.must, q.should, q.must_not)))
    if isinstance(q, (Q.Not, Q.Boost)):
        return replace(q, query=resolved(q.query, index))
    if isinstance(q, Q.Text):
        terms = tuple(t for _, t in index.config.at_query.analyze(index.docs.sparkSession, q.text))
        return Q.Terms(q.field, terms, len(set(terms)) if q.every else 1) if terms else NONE
    if isinstance(q, Q.Terms) and (not q.terms or q.minimum > len(set(q.terms))):
        return NONE
    if isinstance(q, Q.Compare) and q.field in index.text_fields:
        if q.op == "=":
            return Q.Boost(Q.Terms(q.field, (str(q.value),)), 0.0)
        low = (str(q.value), None) if q.op[0] == ">" else (None, str(q.value))
        return Q.Boost(Q.Pattern(q.field, "range", (*low, q.op == ">=", q.op == "<=")), 0.0)
    if isinstance(q, Q.Between):
        if q.field in index.text_fields:
            return Q.Boost(Q.Pattern(q.field, "range", (q.low, q.high, True, True)), 0.0)
        return Q.Bool(must=(Q.Compare(q.field, ">=", q.low), Q.Compare(q.field, "<=", q.high)))
    if isinstance(q, Q.InSet) and q.field in index.text_fields:
        return Q.Boost(Q.Terms(q.field, tuple(map(str, q.values))), 0.0)
    return q


class _Compiled:
    def __init__(self, q: Q.Query, index: SearchIndex):
        self.index, self.root = index, resolved(q, index)
        self.aggs: list[Column] = []
        self.picks: dict[str, list[Pick]] = {}
        self.on_docs = self.positions = self.patterns = False
        self.words: dict[str, set[str]] = {}
        self._gather(self.root)
        self.known = self._known()

    def _gather(self, q: Q.Query) -> None:
        if isinstance(q, Q.Terms):
            self.words.setdefault(q.field, set()).update(q.terms)
        elif isinstance(q, Q.Phrase):
            self.words.setdefault(q.field, set()).update(t for _, t in self._phrase(q))
        elif isinstance(q, Q.Bool):
            for x in (*q.must, *q.should, *q.must_not):
                self._gather(x)
        elif isinstance(q, (Q.Not, Q.Boost)):
            self._gather(q.query)

    def _phrase(self, q: Q.Phrase) -> list[tuple[int, str]]:
        return self.index.config.at_query.analyze(self.index.docs.sparkSession, q.text)

    def _known(self) -> dict[tuple[str, str], float]:
        """Inverse document frequencies of the query's own terms: as many rows as the query has terms."""
        if not self.words:
            return {}
        mine = self.index.some({f: lambda t, w=tuple(terms): t.isin(*w) for f, terms in self.words.items()}, words=self.words)
        rows = mine.groupBy("field", "term").agg(F.count("*").alias("df"), F.sum("tf").alias("ttf"))
        idf = self.index.idf(F.col("field"), F.col("df"), F.col("ttf"))
        return {(r.field, r.term): r.idf for r in rows.select("field", "term", idf.alias("idf")).collect()}

    def _add(self, agg: Column) -> Column:
        self.aggs.append(agg.alias(f"__a{len(self.aggs)}"))
        return F.col(f"__a{len(self.aggs) - 1}")

    def _want(self, field: str, pick: Pick) -> Column:
        self.picks.setdefault(field, []).append(pick)
        return (F.col("field") == field) & pick(F.col("term"))

    def build(self, q: Q.Query, top: bool = False) -> tuple[Column, Column]:
        """(whether it matches, score) over the aggregated row of a document."""
        yes, zero = F.lit(True), F.lit(0.0)
        if isinstance(q, Q.All):
            self.on_docs = True
            return yes, F.lit(1.0)
        if isinstance(q, Q.Not):
            self.on_docs = True
            m, _ = self.build(q.query)
            return ~m, F.lit(1.0 if top else 0.0)
        if isinstance(q, Q.Boost):
            m, s = self.build(q.query)
            return m, s * q.by
        if isinstance(q, Q.Bool):
            must, should, bad = ([self.build(x) for x in part] for part in (q.must, q.should, q.must_not))
            if not must and not should:
                self.on_docs = True
            match = yes if must or not should else F.lit(False)
            score = zero
            for m, s in must:
                match, score = match & m, score + s
            for m, s in should:
                match = match if must else match | m
                score = score + F.when(m, s).otherwise(0.0)
            for m, _ in bad:
                match = match & ~m
            return match, score
        if isinstance(q, Q.Terms):
            return self._terms(q)
        if isinstance(q, Q.Phrase):
            return self._in_a_row(q)
        if isinstance(q, Q.Pattern):
            return self._pattern(q)
        self.on_docs = True
        if q.field not in self.index.text_fields and q.field not in self.index.docs.columns:
            return F.lit(False), zero
        if isinstance(q, Q.Exists):
            c = self.index.length(q.field) > 0 if q.field in self.index.text_fields else F.col(f"`{q.field}`").isNotNull()
            return c, zero
        col = F.col(f"`{q.field}`")
        if dict(self.index.docs.dtypes)[q.field].startswith("timestamp"):
            col = F.date_trunc("second", col)
        if isinstance(q, Q.Compare):
            return F.coalesce(_OPS[q.op](col, F.lit(q.value)), F.lit(False)), zero
        if isinstance(q, Q.InSet):
            return F.coalesce(col.isin(*q.values), F.lit(False)), zero
        raise TypeError(f"not a query: {q!r}")

    def _terms(self, q: Q.Terms) -> tuple[Column, Column]:
        times = {t: n for t, n in Counter(q.terms).items() if (q.field, t) in self.known}
        if len(times) < q.minimum:
            return F.lit(False), F.lit(0.0)
        cond = self._want(q.field, lambda t: t.isin(*times))
        table = F.create_map(*(F.lit(x) for t, n in times.items() for x in (t, self.known[q.field, t])))
        count = F.create_map(*(F.lit(x) for t, n in times.items() for x in (t, float(n))))
        one = self.index.weight(F.col("tf"), F.col("dl"), table[F.col("term")], F.lit(q.field)) * count[F.col("term")]
        met = self._add(F.count(F.when(cond, 1)))
        return F.coalesce(met, F.lit(0)) >= q.minimum, F.coalesce(self._add(F.sum(F.when(cond, one))), F.lit(0.0))

    def _in_a_row(self, q: Q.Phrase) -> tuple[Column, Column]:
        terms = self._phrase(q)
        if not terms or any((q.field, t) not in self.known for _, t in terms):
            return F.lit(False), F.lit(0.0)
        idf = sum(self.known[q.field, t] for _, t in terms)
        if len(terms) == 1:
            return self._terms(Q.Terms(q.field, (terms[0][1],)))
        self.positions = True
        mine = self._want(q.field, lambda x: x.isin(*{t for _, t in terms}))
        empty = F.array().cast("array<int>")
        at = {t: F.coalesce(self._add(F.max(F.when((F.col("field") == q.field) & (F.col("term") == t), F.col("positions")))), empty) for t in {t for _, t in terms}}
        dl = self._add(F.max(F.when(mine, F.col("dl"))))
        start = terms[0][0]
        moved = [_moved(at[t], p - start) for p, t in terms]
        if q.slop:
            # Each further term lies within `slop` positions of its place in all.
            n = at[terms[0][1]]
            freq = F.size(F.filter(n, lambda x: F.aggregate(F.array(*(F.array_min(F.transform(m, lambda y: F.abs(y - x))) for m in moved[1:])), F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(1 << 20))) <= q.slop))
        else:
            both = moved[0]
            for m in moved[1:]:
                both = F.array_intersect(both, m)
            freq = F.size(both)
        freq = freq.cast("double")
        return freq > 0, F.when(freq > 0, self.index.weight(freq, dl, F.lit(idf), F.lit(q.field))).otherwise(0.0)

    def _pattern(self, q: Q.Pattern) -> tuple[Column, Column]:
        def pick(term: Column) -> Column:
            if q.kind == "range":
                low, high, with_low, with_high = q.value
                c = F.lit(True)
                if low is not None:
                    c = c & (term >= low if with_low else term > low)
                if high is not None:
                    c = c & (term <= high if with_high else term < high)
                return c
            if q.kind == "fuzzy":
                return F.levenshtein(term, F.lit(q.value)) <= q.edits
            p = q.value if q.kind == "regex" else "".join({"*": ".*", "?": "."}.get(x, re.escape(x)) for x in q.value)
            return term.rlike(f"^(?:{p})$")

        self.patterns = True
        cond = self._want(q.field, pick)
        return F.coalesce(self._add(F.count(F.when(cond, 1))), F.lit(0)) > 0, F.lit(1.0)


def _moved(positions: Column, by: int) -> Column:
    return F.transform(positions, lambda x: x - by)


def scored(q: Q.Query, index: SearchIndex) -> DataFrame:
    """(doc_id, score) of all documents that match."""
    plan = _Compiled(q, index)
    match, score = plan.build(plan.root, top=True)
    hits = None
    if plan.picks:
        some = index.some({f: any_of(p) for f, p in plan.picks.items()}, plan.positions, None if plan.patterns else plan.words)
        hits = some.groupBy("doc_id").agg(*plan.aggs)
    if plan.on_docs or hits is None:
        rows = index.docs if hits is None else index.docs.join(hits, "doc_id", "left")
    else:
        rows = hits
    return rows.where(match).select("doc_id", F.round(score, 6).alias("score"))
