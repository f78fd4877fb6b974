"""Query strings in the classic syntax: terms, "phrases"~2, field:x, AND OR NOT + - && || !, (groups), ^boost, wild*cards, /regex/, fuzzy~1, [a TO b], {a TO b}, *:*."""

from __future__ import annotations

import re

from fathomgrid.plans.query import All, Bool, Boost, Exists, Pattern, Phrase, Query, Text

_TOKEN = re.compile(
    r"""\s*(?:(?P<op>&&|\|\||AND(?=[\s(]|$)|OR(?=[\s(]|$)|NOT(?=[\s(]|$)|[+\-!](?=\S))|(?P<paren>[()])|(?P<phrase>"(?:\\.|[^"\\])*")(?:~(?P<slop>\d+))?
    |/(?P<regex>(?:\\.|[^/\\])*)/|(?P<range>[\[{]\s*(?P<low>"[^"]*"|\S+)\s+TO\s+(?P<high>"[^"]*"|[^\s\]}]+)\s*[\]}])|(?P<boost>\^[0-9.]+)
    |(?P<field>(?:\\.|[\w.$*])+):|(?P<word>(?:\\.|[^\s()\[\]{}"^~:/\\+\-!&|]|(?<=[^\s()"])[+\-!&|/])+)(?P<fuzzy>~[0-9.]*)?)""",
    re.X,
)


class QuerySyntaxError(ValueError):
    pass


def parse(text: str, default: str) -> Query:
    tokens, at = [], 0
    text = text.rstrip()
    while at < len(text):
        m = _TOKEN.match(text, at)
        if not m or m.end() == at:
            raise QuerySyntaxError(f"cannot read {text[at:]!r}")
        tokens.append(m)
        at = m.end()
    parser = _Parser(tokens)
    out = parser.group(default)
    if parser.at < len(tokens):
        raise QuerySyntaxError("a closing parenthesis too many")
    return out


class _Parser:
    def __init__(self, tokens):
        self.tokens, self.at = tokens, 0

    def peek(self):
        return self.tokens[self.at] if self.at < len(self.tokens) else None

    def group(self, name: str) -> Query:
        clauses: list[list] = []  # [occur, query]
        while (m := self.peek()) and m["paren"] != ")":
            joint, occur = "", "should"
            while (m := self.peek()) and m["op"]:
                op = {"&&": "AND", "||": "OR", "!": "NOT"}.get(m["op"], m["op"])
                if op in ("AND", "OR"):
                    if joint or not clauses or occur != "should":
                        raise QuerySyntaxError(f"{op} stands in the wrong place")
                    joint = op
                else:
                    occur = "must" if op == "+" else "must_not"
                self.at += 1
            if joint == "AND":
                if clauses[-1][0] == "should":
                    clauses[-1][0] = "must"
                if occur == "should":
                    occur = "must"
            clauses.append([occur, self.clause(name)])
        if not clauses:
            raise QuerySyntaxError("a query or group is empty")
        if len(clauses) == 1 and clauses[0][0] != "must_not":
            return clauses[0][1]
        return Bool(**{k: tuple(q for o, q in clauses if o == k) for k in ("must", "should", "must_not")})

    def clause(self, name: str) -> Query:
        m = self.peek()
        if m is None:
            raise QuerySyntaxError("a clause is missing at the end")
        self.at += 1
        if m["field"]:
            if m["field"] == "*" and (n := self.peek()) and n["word"] == "*":
                self.at += 1
                return self.boosted(All())
            return self.clause(_bare(m["field"]))
        if m["paren"] == "(":
            out = self.group(name)
            if not (n := self.peek()) or n["paren"] != ")":
                raise QuerySyntaxError("a closing parenthesis is missing")
            self.at += 1
        elif m["phrase"]:
            out = Phrase(name, _bare(m["phrase"][1:-1]), int(m["slop"] or 0))
        elif m["regex"] is not None:
            out = Pattern(name, "regex", m["regex"])
        elif m["range"]:
            low, high = (None if v == "*" else _bare(v.strip('"')) for v in (m["low"], m["high"]))
            out = Pattern(name, "range", (low, high, m["range"][0] == "[", m["range"][-1] == "]"))
        elif m["word"]:
            word = m["word"]
            if m["fuzzy"]:
                given = m["fuzzy"][1:]
                out = Pattern(name, "fuzzy", _bare(word).lower(), min(2, int(float(given))) if given and float(given) >= 1 else 2)
            elif word == "*":
                out = Exists(name)
            elif re.search(r"(?<!\\)[*?]", word):
                if word[0] in "*?":
                    raise QuerySyntaxError("a leading wildcard is not allowed")
                out = Pattern(name, "wildcard", word.lower())
            else:
                out = Text(name, _bare(word))
        else:
            raise QuerySyntaxError(f"unexpected {m[0]!r}")
        return self.boosted(out)

    def boosted(self, q: Query) -> Query:
        if (m := self.peek()) and m["boost"]:
            self.at += 1
            return Boost(q, float(m["boost"][1:]))
        return q


def _bare(s: str) -> str:
    return re.sub(r"\\(.)", r"\1", s)
