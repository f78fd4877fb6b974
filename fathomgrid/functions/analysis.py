"""Text analysers: a column of text to an array of tokens, null where a stop word leaves a gap in the positions."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from fathomgrid.functions.stems import ITALIAN_PLAIN, italian_light_stem, porter_stem

ENGLISH_STOPS = frozenset("a an and are as at be but by for if in into is it no not of on or such that the their then there these they this to was will with".split())
ITALIAN_STOPS = frozenset(
    "ad al allo ai agli all agl alla alle con col coi da dal dallo dai dagli dall dagl dalla dalle di del dello dei degli dell degl della delle in nel nello nei negli nell negl nella nelle su sul sullo sui sugli sull sugl sulla sulle per tra contro io tu lui lei noi voi loro mio mia miei mie tuo tua tuoi tue suo sua suoi sue nostro nostra nostri nostre vostro vostra vostri vostre mi ti ci vi lo la li le gli ne il un uno una ma ed se perché anche come dov dove che chi cui non più quale quanto quanti quanta quante quello quelli quella quelle questo questi questa queste si tutto tutti a c e i l o ho hai ha abbiamo avete hanno sono sei è siamo siete era erano fu furono sia stato stata stati state".split()  # noqa: E501
)
ELISIONS = ("c", "l", "all", "dall", "dell", "nell", "sull", "coll", "pell", "gl", "agl", "dagl", "degl", "negl", "sugl", "un", "m", "t", "s", "v", "d")
_STANDARD = r"[\p{L}\p{M}\p{N}_]+(?:['’.][\p{L}\p{M}\p{N}_]+)*"
#: Wiki markup to plain text, in order.
WIKI = [
    (r"(?s)<!--.*?-->", " "), (r"(?s)<ref[^>/]*/>|<ref[^>]*>.*?</ref>", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"(?s)\{\{[^{}]*\}\}", " "), (r"(?s)\{\|.*?\|\}", " "),
    (r"(?i)\[\[(?:category|categoria|file|image|immagine):([^\]|]*)[^\]]*\]\]", " $1 "), (r"\[\[[^\]|]*\|([^\]]*)\]\]", "$1"), (r"\[\[([^\]]*)\]\]", "$1"), (r"\[https?://\S+ ?([^\]]*)\]", "$1"),
    (r"https?://\S+", " "), (r"'{2,5}", ""), (r"(?m)^=+\s*(.*?)\s*=+\s*$", "$1"), (r"<[^>]*>", " "),
]


@dataclass(frozen=True)
class Analyzer:
    """`steps` are JVM expressions from text to tokens; `stem` works on the distinct tokens of an Arrow batch."""

    name: str
    steps: Callable[[Column], Column]
    stops: frozenset[str] = frozenset()
    stem: Callable[[str], str] | None = None
    keep: frozenset[str] = field(default=frozenset())  # never stemmed
    #: Whether a word may have a stem: true of all that have it, and cheap. Without it every word goes to Python.
    near: Callable[[Column, str], Column] | None = None

    def tokens(self, text: Column) -> Column:
        return self.stemmed(self.words(text))

    def words(self, text: Column) -> Column:
        """Tokens before stemming, which neither adds nor removes any."""
        out = self.steps(text)
        if self.stops:
            stops = sorted(self.stops)
            out = F.transform(out, lambda t: F.when(~t.isin(*stops), t))
        return out

    def nearby(self, words: Column, stems: Iterable[str]) -> Column:
        """The words that may have one of the stems; their places are lost."""
        if not (self.stem and self.near):
            return words

        def some(word: Column) -> Column:
            out = F.lit(False)
            for s in sorted(stems):
                out = out | self.near(word, s)
            return word.isNotNull() & out

        return F.filter(words, some)

    def stemmed(self, words: Column) -> Column:
        if not self.stem:
            return words
        stem, keep = self.stem, self.keep

        @F.arrow_udf("array<string>")
        def run(column: pa.Array) -> pa.Array:
            ends = pc.cast(column.offsets, pa.int32())
            coded = column.values.slice(ends[0].as_py(), ends[-1].as_py() - ends[0].as_py()).dictionary_encode()
            known = pa.array([t if t is None or t in keep else stem(t) for t in coded.dictionary.to_pylist()], pa.string())
            return pa.ListArray.from_arrays(pc.subtract(ends, ends[0]), known.take(coded.indices), mask=column.is_null())

        return run(words)

    def analyze(self, spark, text: str | None) -> list[tuple[int, str]]:
        """(position, token) of one text: a query's, by the same expressions as the index's."""
        row = spark.range(1).select(self.tokens(F.lit(text).cast("string")).alias("t")).first()
        return [(i, t) for i, t in enumerate(row.t or []) if t is not None]

    def with_words(self, stops=None, keep=()) -> Analyzer:
        """The same with other stop words and with words that are never stemmed."""
        return Analyzer(self.name, self.steps, self.stops if stops is None else frozenset(stops), self.stem, frozenset(keep), self.near)


def _letters(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda t: t != "")


def _standard(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(f"({_STANDARD})"), F.lit(1))


def _quoted(token: Column, pattern: str) -> Column:
    """The token without what the pattern, which holds an apostrophe, matches; most tokens have none and are not tried."""
    return F.when(token.contains("'") | token.contains("’"), F.regexp_replace(token, pattern, "")).otherwise(token)


def _english(text: Column) -> Column:
    return F.transform(_standard(text), lambda t: _quoted(t, "['’]s$"))


def _italian(text: Column) -> Column:
    return F.transform(_standard(text), lambda t: _quoted(t, "^(?:" + "|".join(ELISIONS) + ")['’]"))


def plain_wiki(text: Column) -> Column:
    for pattern, put in WIKI:
        text = F.regexp_replace(text, pattern, put)
    return text


def _near_english(word: Column, stem: str) -> Column:
    # Porter's steps cut a word's end and put at most two letters there (biliti, ble), so that the rest begins the word.
    return word.startswith(stem[:-3])


def _near_italian(word: Column, stem: str) -> Column:
    # A stem begins its word, accents apart.
    plain = dict(zip(*ITALIAN_PLAIN))
    return F.translate(word, *ITALIAN_PLAIN).startswith("".join(plain.get(c, c) for c in stem))


_ALL = {
    "default": Analyzer("default", _letters),
    "english": Analyzer("english", _english, ENGLISH_STOPS, porter_stem, near=_near_english),
    "italian": Analyzer("italian", _italian, ITALIAN_STOPS, italian_light_stem, near=_near_italian),
    "english_wiki": Analyzer("english_wiki", lambda t: _english(plain_wiki(t)), ENGLISH_STOPS, porter_stem, near=_near_english),
    "italian_wiki": Analyzer("italian_wiki", lambda t: _italian(plain_wiki(t)), ITALIAN_STOPS, italian_light_stem, near=_near_italian),
}


def analyzer(name: str) -> Analyzer:
    if name not in _ALL:
        raise ValueError(f"no analyser {name}: {', '.join(_ALL)}")
    return _ALL[name]
