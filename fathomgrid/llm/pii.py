"""Personal data by candidate generation and gradient boosting.

Generators of high recall propose spans of each kind, and the spans of different kinds may overlap. Boosted trees score a
span by its format (length, character classes, entropy, checksum, octets, separators) and its context (words shortly
before it, neighbouring characters, overlap with spans of other kinds). An isotonic fit on held-out spans calibrates the
scores; for each kind the threshold is the lowest one at which the held-out precision is `precision`. Of accepted spans
that overlap, the most probable stays. The trees are trained on a labelled table that `labelled` composes from a seed:
`sample` sentences with real forms and with look-alikes (versions, order numbers, dates, checksums, failed check digits).

A text without any digit or @ has no candidates and is filtered out in the scan. Cases: a null or empty text has no
spans; repeated rows have their spans each; a tie between overlapping spans goes to the longer, then the earlier one; an
empty table gives an empty result; a null doc_id is carried; other columns than doc_id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fathomgrid.llm.common import text_slices
from fathomgrid.llm.trees import Boosted, boost, isotonic

KINDS = ("email", "phone", "card", "ip", "national_id", "iban", "secret")
_LOCAL = re.compile(r"[\w.+%'-]{1,64}\Z")
_DOMAIN = re.compile(r"[\w-]{1,63}(?:\.[\w-]{1,63})*+")
_FORMS = {
    "phone": re.compile(r"(?<![0-9A-Za-z])(?:\+[ ]?|\(|00)?[0-9](?:[ ().\-/]{0,2}[0-9]){6,16}(?![0-9])"),
    "card": re.compile(r"(?<![0-9])[0-9](?:[ -]?[0-9]){11,18}(?![0-9])"),
    "ip": re.compile(r"(?<![0-9])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9])|(?<![0-9a-f:])[0-9a-f]{0,4}(?::{1,2}[0-9a-f]{1,4}){3,7}(?![0-9a-f:])", re.I),
    "national_id": re.compile(r"(?<![0-9])[0-9]{3}[- ][0-9]{2}[- ][0-9]{4}(?![0-9])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "secret": re.compile(r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{16,}+"),
}
#: Two numbers side by side look like one longer number; this form ends where a usual grouping ends.
_GROUPED = re.compile(r"(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])")
_HINTS = [
    ("mail", "contact", "write"), ("tel", "phone", "call", "mobile", "fax", "ring"), ("card", "visa", "pay", "credit", "charge"), ("ip", "host", "server", "from", "address", "login"), ("ssn", "social", "national"),
    ("iban", "account", "bank", "transfer"), ("token", "key", "secret", "password", "passwd", "bearer", "auth"), ("version", "release", "v", "build", "section", "chapter"), ("order", "invoice", "isbn", "sku", "id", "number", "no", "ref", "part", "tracking"), ("commit", "checksum", "md5", "sha1", "sha256", "hash", "digest", "etag", "uuid", "revision"),
]
_HINT = [re.compile(r"(?<![a-z])(?:" + "|".join(h) + r")(?![a-z])") for h in _HINTS]


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind) of every span that a generator proposes."""
    out = []
    at = text.find("@")
    while at >= 0:
        a, b = _LOCAL.search(text, max(0, at - 64), at), _DOMAIN.match(text, at + 1)
        if a and b:
            out.append((a.start(), b.end(), 0))
        at = text.find("@", at + 1)
    for k, kind in enumerate(KINDS[1:], 1):
        for m in _FORMS[kind].finditer(text):
            a, b = m.span()
            if kind != "secret" or any("0" <= c <= "9" for c in text[a : min(b, a + 4096)]) or re.search("[0-9]", text[a:b]):
                out.append((a, b, k))
    known = set(out)
    return out + [(*m.span(), 1) for m in _GROUPED.finditer(text) if (*m.span(), 1) not in known]


def _luhn(digits: str) -> bool:
    return 12 <= len(digits) <= 19 and sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(reversed(digits))) % 10 == 0


def _mod97(s: str) -> bool:
    s = s.replace(" ", "")
    s = s[4:] + s[:4]
    return len(s) <= 40 and int("".join(str(int(c, 36)) for c in s)) % 97 == 1


def features(text: str, spans: list[tuple[int, int, int]]) -> np.ndarray:
    """One row a span."""
    out = np.zeros((len(spans), 40), np.float32)
    shape = [sum(a < e and s < b for s, e, _ in spans) for a, b, _ in spans] if len(spans) <= 64 else _overlaps(spans)
    for i, (a, b, kind) in enumerate(spans):
        s = text[a:b]
        n = len(s)
        digits = "".join(c for c in s if "0" <= c <= "9")
        count = Counter(s)
        before = text[max(0, a - 32) : a]
        low = before.lower()
        marks = [c for c in s if not c.isalnum()]
        octets = s.split(".")
        four = len(octets) == 4 and all(o.isdigit() for o in octets)
        tail = s.rpartition(".")[2]
        out[i] = [
            kind, n, len(digits), len(digits) / n, sum(map(str.isupper, s)) / n, sum(map(str.islower, s)) / n, sum(c in "0123456789abcdefABCDEF" for c in s) / n,
            len(count) / min(n, 64), -sum(v / n * math.log2(v / n) for v in count.values()), _luhn(digits) if kind in (1, 2) else 0,
            all(int(o) < 256 and (len(o) == 1 or o[0] != "0") for o in octets) if four else -1, int(octets[0][:6]) if four else -1, len(marks), len(set(marks)), s[0] in "+(", s.startswith("00"),
            "." in s.partition("@")[2] if kind == 0 else -1, len(tail) if kind == 0 else 0, tail.isalpha() if kind == 0 else 0, s[0].isalnum(), s[-1].isalnum(),
            _mod97(s) if kind == 5 else 0, bool(re.match(r"(?:19|20)[0-9]{2}[-/. ]?[01][0-9]", s)), a > 0 and text[a - 1].isalnum(), a > 0 and text[a - 1] in "\"'`:=", a > 0 and text[a - 1] in ".-/#$€_@",
            b < len(text) and text[b].isalnum(), b + 1 < len(text) and text[b] in ".-/:@" and text[b + 1].isalnum(), shape[i], s[:3] in ("000", "666") or s[0] == "9" if kind == 4 else 0,
            *(bool(h.search(low)) for h in _HINT),
        ]
    return out


def _overlaps(spans: list[tuple[int, int, int]]) -> list[int]:
    a, b = np.array([s[0] for s in spans]), np.array([s[1] for s in spans])
    return (np.searchsorted(np.sort(a), b, side="left") - np.searchsorted(np.sort(b), a, side="right")).tolist()


def labelled(sample: int, seed: int = 7) -> list[tuple[str, set[tuple[int, int, int]]]]:
    """`sample` texts with the spans that are personal, composed from a seed."""
    rng = np.random.default_rng(seed)
    pick = lambda *x: x[int(rng.integers(len(x)))]
    some = lambda n, of="0123456789": "".join(of[i] for i in rng.integers(len(of), size=n))
    letters, hexa = "abcdefghijklmnopqrstuvwxyz", "0123456789abcdef"
    word = lambda: some(int(rng.integers(2, 11)), letters)

    def words() -> str:
        w = [word() for _ in range(int(rng.integers(1, 7)))]
        return " ".join(pick(x, x, x.capitalize()) for x in w)

    def digit(s: str, good: bool) -> str:
        ok = [d for d in "0123456789" if _luhn(s + d) == good]
        return s + pick(*ok)

    def grouped(s: str) -> str:
        sep = pick("", "", "", " ", "-")
        return sep.join(s[i : i + 4] for i in range(0, len(s), 4))

    def iban(good: bool) -> str:
        land, body = pick("DE", "FR", "GB", "ES", "IT", "NL"), some(18)
        check = next(f"{c:02d}" for c in range(2, 99) if _mod97(land + f"{c:02d}" + body))
        return grouped(land + (check if good else f"{(int(check) + 7) % 97:02d}") + body)

    octet = lambda: str(int(rng.integers(256)))
    yes = {
        "email": lambda: (pick("", "", "mail ", "contact: ", "write to "), word() + pick("", ".", "_", "+") + pick(word(), some(2)) + "@" + pick("", "mail" + some(1) + ".") + word() + "." + pick("com", "org", "net", "de", "co.uk", "io"), ""),
        "phone": lambda: (
            pick("", "", "", "call ", "phone: ", "tel. "),
            pick(lambda: f"+{rng.integers(1, 99)} ({some(3)}) {some(3)}-{some(4)}", lambda: f"({some(3)}) {some(3)}-{some(4)}", lambda: f"+{rng.integers(1, 99)} {some(2)} {some(4)} {some(4)}", lambda: f"+{rng.integers(1, 99)}-{some(3)}-{some(3)}-{some(4)}", lambda: f"{some(3)}-{some(3)}-{some(4)}", lambda: f"0{some(2)} {some(3)} {some(4)}", lambda: f"+{rng.integers(1, 99)}{some(10)}")(),
            "",
        ),
        "card": lambda: (pick("", "", "", "card ", "visa: ", "paid by "), grouped(digit(pick("4", "5", "3", some(1), some(1), some(1)) + some(14), True)), ""),
        "ip": lambda: (pick("", "", "", "from ", "host ", "login from "), pick(".".join(octet() for _ in range(4)), ".".join(octet() for _ in range(4)), ":".join(some(4, hexa) for _ in range(8))), ""),
        "national_id": lambda: (pick("", "", "ssn ", "social security "), f"{pick('1', '2', '3', '4', '5', '7', '8')}{some(2)}-{some(2)}-{some(4)}", ""),
        "iban": lambda: (pick("", "", "iban ", "account "), iban(True), ""),
        "secret": lambda: (pick("token = ", "key: ", "secret=", "password: ", "api_key=", "token ", "bearer "), pick(lambda: some(40, hexa), lambda: some(32, hexa), lambda: "sk-" + some(32, letters + letters.upper() + "0123456789"), lambda: "AKIA" + some(16, letters.upper() + "0123456789"), lambda: "ghp_" + some(36, letters + letters.upper() + "0123456789"), lambda: some(24, letters + letters.upper() + "0123456789_-") + "7")(), ""),
    }
    no = [
        lambda: (pick("version ", "release ", "v", "section ", "build "), ".".join(str(rng.integers(1, 30)) for _ in range(4)), ""),
        lambda: ("", f"{rng.integers(256, 999)}.{octet()}.{octet()}.{octet()}", ""),
        lambda: ("", f"{octet()}.{octet()}.{octet()}.{rng.integers(256, 999)}", ""),
        lambda: (pick("", "", "order ", "invoice no ", "isbn ", "id "), digit(some(int(rng.integers(11, 18))), False), ""),
        lambda: (pick("", "order ", "id "), grouped(digit(some(15), False)), ""),
        lambda: (pick("", "order ", "ref ", "id ", "part no "), some(int(rng.integers(7, 12))), ""),
        lambda: ("", f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", pick("", f" {some(2)}:{some(2)}:{some(2)}")),
        lambda: ("", f"{rng.integers(1900, 2030)}-{rng.integers(1900, 2030)}", ""),
        lambda: ("", f"{rng.integers(1, 29):02d}.{rng.integers(1, 13):02d}.{rng.integers(1900, 2030)}", ""),
        lambda: (pick("commit ", "checksum ", "md5 ", "sha1: ", "etag "), some(pick(32, 40, 64), hexa), ""),
        lambda: ("", word() + "@" + word(), ""),
        lambda: ("@", word() + some(2), ""),
        lambda: ("", pick(word() * 5 + "1", "a1" * 12, "0" * 20, "1" * 16, some(1) * int(rng.integers(12, 30))), ""),
        lambda: ("", "-".join(word() for _ in range(5)) + some(1), ""),
        lambda: ("", f"{some(3)} {some(2)} {some(3)} {some(4)} {some(2)}", ""),
        lambda: (pick("iban ", ""), iban(False), ""),
        lambda: ("", f"{pick('000', '666')}-{some(2)}-{some(4)}", ""),
        lambda: ("uuid ", f"{some(8, hexa)}-{some(4, hexa)}-{some(4, hexa)}-{some(4, hexa)}-{some(12, hexa)}", ""),
        lambda: ("http://" + word() + ".com/", "/".join(word() for _ in range(3)) + some(3), ""),
        lambda: ("$", f"{some(3)}.{some(3)}.{some(3)}", ""),
    ]
    out = []
    for i in range(sample):
        text, spans = words() + pick(" ", "\n", ", "), set()
        for _ in range(int(rng.integers(1, 3))):
            kind = KINDS[i % len(KINDS)]
            good = bool(rng.integers(2))
            lead, core, rest = yes[kind]() if good else pick(*no)()
            quote = pick("", "", '"') if kind == "secret" or not good else ""
            text += lead + quote
            if good:
                spans.add((len(text), len(text) + len(core), KINDS.index(kind)))
            text += core + quote + rest + pick("", "", ".", ",", "###", "!!") + " " + pick("", "", words() + " ")
        out.append((text.upper() if i % 9 == 0 else text, spans))
    return out


@dataclass
class Detector:
    model: Boosted
    scores: np.ndarray
    chances: np.ndarray
    threshold: np.ndarray

    def __call__(self, x: np.ndarray) -> np.ndarray:
        """Calibrated probability of each row."""
        return np.interp(self.model(x), self.scores, self.chances)


def _table(texts) -> tuple[np.ndarray, np.ndarray]:
    xs, ys = [], []
    for text, true in texts:
        spans = candidates(text)
        if spans:
            xs.append(features(text, spans))
            ys += [s in true for s in spans]
    return np.concatenate(xs), np.array(ys, float)


@cache
def trained(sample: int = 4000, precision: float = 0.98, seed: int = 7) -> Detector:
    """Two thirds of the labelled texts train the trees, one third calibrates. Kept a process: the same options give the same model."""
    texts = labelled(sample, seed)
    x, y = _table(texts[: sample * 2 // 3])
    model = boost(x, y)
    cx, cy = _table(texts[sample * 2 // 3 :])
    raw = model(cx)
    scores, chances = isotonic(raw, cy)
    p = np.interp(raw, scores, chances)
    threshold = np.ones(len(KINDS))
    for k in range(len(KINDS)):
        own = cx[:, 0] == k
        order = np.argsort(-p[own], kind="stable")
        good = np.cumsum(cy[own][order]) / np.arange(1, own.sum() + 1)
        ok = np.flatnonzero(good >= precision)
        threshold[k] = max(0.3, p[own][order][ok[-1]]) if len(ok) else 1.0
    return Detector(model, scores, chances, threshold)


def redactions(text: str, detector: Detector) -> list[tuple[int, int, int, float]]:
    """(start, end, kind, probability) of the spans to redact, in order; none overlap."""
    return _chosen(candidates(text), detector, lambda spans: detector(features(text, spans)))


def _chosen(spans, detector, score):
    if not spans:
        return []
    p = score(spans)
    left = [(-q, a - b, a, b, k) for (a, b, k), q in zip(spans, p) if q >= detector.threshold[k]]
    out: list[tuple[int, int, int, float]] = []
    if left:
        import bisect

        starts: list[int] = []
        for q, _, a, b, k in sorted(left):
            i = bisect.bisect(starts, a)
            if (i == 0 or out[i - 1][1] <= a) and (i == len(out) or out[i][0] >= b):
                starts.insert(i, a)
                out.insert(i, (a, b, k, -q))
    return out


def personal_data(docs: DataFrame, detector: Detector | None = None) -> DataFrame:
    """(doc_id, start, end, kind, probability) of every span to redact, in characters of the text."""
    detector = detector or trained()

    def run(batches):
        for batch in batches:
            for part in text_slices(batch, "text"):
                at, rows = [], []
                texts = part.column(1).to_pylist()
                spans = [candidates(t) for t in texts]
                x = [features(t, s) for t, s in zip(texts, spans) if s]
                p = detector(np.concatenate(x)) if x else np.zeros(0)
                done = 0
                for i, s in enumerate(spans):
                    own = p[done : done + len(s)]
                    done += len(s)
                    found = _chosen(s, detector, lambda _, own=own: own)
                    at += [i] * len(found)
                    rows += found
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(at, pa.int64())), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int32()), pa.array([KINDS[r[2]] for r in rows], pa.string()), pa.array([round(float(r[3]), 6) for r in rows], pa.float64())],
                    ["doc_id", "start", "end", "kind", "probability"],
                )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").where(F.col("text").rlike("[0-9@]")).mapInArrow(run, f"doc_id {kind}, start int, end int, kind string, probability double")


def redacted(text: Column, spans: Column) -> Column:
    """The text with each span of an array of (start, end, kind) in order replaced by its kind in brackets."""
    first = F.struct(F.lit(0).alias("at"), F.lit("").alias("made"))
    step = lambda acc, s: F.struct(s["end"].alias("at"), F.concat(acc["made"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["kind"], F.lit("]")).alias("made"))
    return F.aggregate(spans, first, step, lambda acc: F.concat(acc["made"], F.substring(text, acc["at"] + 1, F.length(text))))
