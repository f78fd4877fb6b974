"""The query language: field("text").match_text("a b") & ~field("n").gt(3), and so on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass


class Query:
    def __and__(self, other: Query) -> Query:
        return Bool(must=(self, other))

    def __or__(self, other: Query) -> Query:
        return Bool(should=(self, other))

    def __invert__(self) -> Query:
        return Not(self)


@dataclass(frozen=True)
class All(Query):
    """Every document, at score 1."""


@dataclass(frozen=True)
class Bool(Query):
    """All of must, none of must_not, and one of should where there is no must; scores add up."""

    must: tuple[Query, ...] = ()
    should: tuple[Query, ...] = ()
    must_not: tuple[Query, ...] = ()


@dataclass(frozen=True)
class Not(Query):
    """The complement, at score 1 as a whole query and 0 within one."""

    query: Query


@dataclass(frozen=True)
class Boost(Query):
    query: Query
    by: float


@dataclass(frozen=True)
class Terms(Query):
    """Documents with at least `minimum` of the terms as they are; a repeated term counts in the score each time."""

    field: str
    terms: tuple[str, ...]
    minimum: int = 1


@dataclass(frozen=True)
class Text(Query):
    """Analysed text: any of its tokens, or all."""

    field: str
    text: str
    every: bool = False


@dataclass(frozen=True)
class Phrase(Query):
    """Analysed text, its tokens in a row; with slop, within so many positions of that."""

    field: str
    text: str
    slop: int = 0


@dataclass(frozen=True)
class Compare(Query):
    """field op value, op one of = > >= < <=; on a text field against its terms. Adds nothing to the score."""

    field: str
    op: str
    value: object


@dataclass(frozen=True)
class Between(Query):
    """low <= field <= high; on a text field, one term lies within both bounds. Adds nothing to the score."""

    field: str
    low: str
    high: str


@dataclass(frozen=True)
class InSet(Query):
    field: str
    values: tuple


@dataclass(frozen=True)
class Exists(Query):
    field: str


@dataclass(frozen=True)
class Pattern(Query):
    """Terms by kind: wildcard, regex, fuzzy (`edits`) or range (low, high, with or without each), at a constant score."""

    field: str
    kind: str
    value: str | tuple
    edits: int = 2


@dataclass(frozen=True)
class Parsed(Query):
    """A query string, `field` being its default field."""

    field: str
    text: str


@dataclass(frozen=True)
class field:  # noqa: N801
    name: str

    def match_text(self, text: str) -> Query:
        return Text(self.name, text)

    def match_all_text(self, text: str) -> Query:
        return Text(self.name, text, True)

    def match_phrase(self, text: str, slop: int = 0) -> Query:
        return Phrase(self.name, text, slop)

    def match_term(self, term: str) -> Query:
        return Terms(self.name, (term,))

    def match_any(self, *terms: str) -> Query:
        return Terms(self.name, terms)

    def match_all(self, *terms: str) -> Query:
        return Terms(self.name, terms, len(set(terms)))

    def match_min(self, n: int, *terms: str) -> Query:
        return Terms(self.name, terms, n)

    def parse(self, text: str) -> Query:
        return Parsed(self.name, text)

    def eq(self, value) -> Query:
        return Compare(self.name, "=", value)

    def gt(self, value) -> Query:
        return Compare(self.name, ">", value)

    def ge(self, value) -> Query:
        return Compare(self.name, ">=", value)

    def lt(self, value) -> Query:
        return Compare(self.name, "<", value)

    def le(self, value) -> Query:
        return Compare(self.name, "<=", value)

    def between(self, low, high) -> Query:
        if low is None or high is None:
            raise ValueError("a range needs both bounds")
        if isinstance(low, str) and isinstance(high, str):
            return Between(self.name, low, high)
        return self.ge(low) & self.le(high)

    def is_in(self, *values) -> Query:
        if not values:
            raise ValueError("a set of values must not be empty")
        return InSet(self.name, values)

    def exists(self) -> Query:
        return Exists(self.name)

    def missing(self) -> Query:
        return Bool(must=(Boost(All(), 0.0),), must_not=(Exists(self.name),))


def all_docs() -> Query:
    return All()


def raw(text: str, constructor: Callable[[str], Query] | None = None) -> Query:
    """A query from plain text: match_text on the field `text`, or what the constructor makes of it."""
    return (constructor or field("text").match_text)(text)
