"""Search configuration."""

from __future__ import annotations

import os
from collections.abc import Callable, Mapping
from dataclasses import dataclass, fields, replace

from fathomgrid.functions.analysis import Analyzer, analyzer


@dataclass(frozen=True)
class SearchConfig:
    """BM25 parameters, analysers and similarity; immutable, and picklable where `similarity` is.

    `idf` is "df" (documents that hold the term) or "ttf" (its occurrences in the corpus). `similarity` is "bm25",
    "tfidf", or a callable (tf, dl, avgdl, idf) -> Column.
    """

    k1: float = 1.2
    b: float = 0.75
    index_analyzer: Analyzer = analyzer("default")
    query_analyzer: Analyzer | None = None
    idf: str = "df"
    similarity: str | Callable = "bm25"

    def __post_init__(self):
        if self.k1 < 0 or not 0 <= self.b <= 1:
            raise ValueError("k1 must be at least 0 and b from 0 to 1")
        if self.idf not in ("df", "ttf"):
            raise ValueError("idf must be df or ttf")
        if not callable(self.similarity) and self.similarity not in ("bm25", "tfidf"):
            raise ValueError("similarity must be bm25, tfidf or a callable")

    @property
    def at_query(self) -> Analyzer:
        return self.query_analyzer or self.index_analyzer

    def but(self, **changes) -> SearchConfig:
        return replace(self, **changes)

    @classmethod
    def from_dict(cls, options: Mapping[str, object]) -> SearchConfig:
        known = {f.name for f in fields(cls)}
        if odd := set(options) - known:
            raise ValueError(f"unknown options: {', '.join(sorted(odd))}")
        made = dict(options)
        for name in ("index_analyzer", "query_analyzer"):
            if isinstance(made.get(name), str):
                made[name] = analyzer(made[name])
        for name in ("k1", "b"):
            if name in made:
                made[name] = float(made[name])
        return cls(**made)

    @classmethod
    def from_env(cls, prefix: str = "FATHOMGRID_") -> SearchConfig:
        return cls.from_dict({f.name: v for f in fields(cls) if (v := os.environ.get(prefix + f.name.upper()))})
