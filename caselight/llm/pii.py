"""Personal data by weak supervision.

Fixed patterns give the base spans. Wider patterns give candidates, on which regex, gazetteer and context labelers
vote. Expectation-maximisation over the counts of vote patterns estimates how reliable each labeler is, its
posteriors label the candidates, and a logistic classifier over span features, trained on them, decides.
"""

from __future__ import annotations

import re
from bisect import bisect_left, insort
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied

BASE = ("email", "ip", "card", "phone")
ADDED = ("account", "national_id", "phone_local", "email_masked", "person")
KINDS = BASE + ADDED
LABELERS = ("pattern", "check", "gazetteer", "context", "counter_context", "neighbour")
#: Characters of context on each side that labelers read, and the distance at which another span counts as near.
CONTEXT, NEAR = 40, 80
ACCEPT = 0.5

# ---------------------------------------------------------------- base spans

_DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
_CHAIN = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile("[0-9]")
_NOT_DIGIT = re.compile("[^0-9]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = ord(c) - 48
        total += v if i % 2 == 0 else v * 2 - 9 * (v > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Spans of addresses, from one @ to the next, so that long runs without one are not tried from every place."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans (kind, start, end) by kind, then start."""
    out = [("email", a, b) for a, b in emails(text)]
    if _DIGIT.search(text):
        out += [("ip", *m.span()) for m in _IP.finditer(text) if all(map(small, m[0].split(".")))]
        for m in _CHAIN.finditer(text):
            digits = _NOT_DIGIT.sub("", m[0])
            if 13 <= len(digits) <= 19 and luhn(digits):
                out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15]
    return out


# ---------------------------------------------------------------- candidates and votes

_TITLES = r"(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|Monsieur|Madame|Sr|Sra|Señor|Señora)"
_WIDE = {
    "account": re.compile(r"(?<![0-9A-Za-z])[0-9]{8,19}(?![0-9A-Za-z])"),
    "national_id": re.compile(r"(?<![0-9A-Za-z-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z-])"),
    "phone_local": re.compile(r"(?<![0-9A-Za-z+-])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z-])"),
    "email_masked": re.compile(r"(?<![A-Za-z0-9._+-])[A-Za-z0-9._+-]{1,64} ?[\[({] ?at ?[\])}] ?[A-Za-z0-9-]{1,63}(?: ?(?:[\[({] ?dot ?[\])}]|\.) ?[A-Za-z0-9-]{1,63}){1,8}"),
    "person": re.compile(rf"{_TITLES}\.? [A-ZÄÖÜÉÈÑ]\w{{1,30}}(?: [A-ZÄÖÜÉÈÑ]\w{{1,30}})?"),
}
_STRICT = {
    "account": re.compile(r"[0-9]{13,19}\Z"),
    "national_id": re.compile(r"(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}\Z"),
    "phone_local": re.compile(r"(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[.-])[2-9][0-9]{2}[.-][0-9]{4}\Z"),
    "email_masked": re.compile(r"[A-Za-z][A-Za-z0-9._+-]* ?[\[({]"),
    "person": re.compile(rf"{_TITLES}\.? \S+ \S+\Z"),
}
_GAZETTEER = {
    "email_masked": re.compile(r"(?:com|org|net|edu|de|fr|es|example|mail|gmail)\Z", re.I),
    "person": re.compile(r"\b(?:Anna|Carlos|David|Elena|Hans|James|Jean|John|José|Klaus|Luis|Maria|María|Marie|Mary|Michael|Paul|Peter|Pierre|Robert|Sophie|Thomas|William)\b"),
}
_FOR = {
    "account": r"account|iban|card|konto|karte|compte|carte|cuenta|tarjeta|acct",
    "national_id": r"ssn|social security|tax id|passport|national id",
    "phone_local": r"phone|tel|call|mobile|fax|telefon|téléphone|teléfono",
    "email_masked": r"mail|contact|write|reach",
    "person": r"name|dear|contact|born|patient|signed",
}
_FOR = {k: re.compile(rf"\b(?:{v})", re.I) for k, v in _FOR.items()}
_AGAINST = re.compile(r"\b(?:isbn|issn|invoice|order|version|page|figure|table|total|price|serial|part no|model|id:|hash|commit)", re.I)


def _repeats(digits: str) -> bool:
    return len(set(digits)) <= 2


def check_vote(kind: str, text: str) -> int:
    """Whether digits can be what they look like: a check sum, or not a counter or a run of one digit."""
    digits = _NOT_DIGIT.sub("", text)
    if kind == "account":
        return 1 if 13 <= len(digits) <= 19 and luhn(digits) and not _repeats(digits) else -1
    if kind in ("national_id", "phone_local"):
        return -1 if _repeats(digits) else 0
    return 0


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[str, int, int, int, int]]:
    """Candidates (kind, start, end, votes code, features code) that touch no base span nor an earlier candidate."""
    taken = sorted((a, b) for _, a, b in base)
    found: list[tuple[str, int, int]] = []
    digits, brackets = _DIGIT.search(text) is not None, any(c in text for c in "[({")
    for kind in ADDED:
        if kind == "email_masked" and not brackets or kind in ("account", "national_id", "phone_local") and not digits:
            continue
        found += [(kind, *m.span()) for m in _WIDE[kind].finditer(text) if kind != "person" or m.start() == 0 or not text[m.start() - 1].isalnum()]
    if not found:
        return []
    out, used = [], _Taken(taken)
    for kind, a, b in found:
        if used.touches(a, b):
            continue
        used.add(a, b)
        out.append((kind, a, b, votes_code(votes(text, kind, a, b, taken)), features(text, kind, a, b)))
    return out


class _Taken:
    """Sorted spans without overlaps, for look-up."""

    def __init__(self, spans):
        self.spans: list[tuple[int, int]] = []
        for a, b in spans:
            if self.spans and a < self.spans[-1][1]:
                self.spans[-1] = (self.spans[-1][0], max(b, self.spans[-1][1]))
            else:
                self.spans.append((a, b))

    def touches(self, a: int, b: int) -> bool:
        i = bisect_left(self.spans, (a, a))
        return i > 0 and self.spans[i - 1][1] > a or i < len(self.spans) and self.spans[i][0] < b

    def add(self, a: int, b: int) -> None:
        insort(self.spans, (a, b))


def votes(text: str, kind: str, a: int, b: int, base: list[tuple[int, int]]) -> tuple[int, ...]:
    """Votes of the labelers: 1 for, -1 against, 0 abstains."""
    span, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    i = bisect_left(base, (a, a))
    near = any(x - b < NEAR and a - y < NEAR for x, y in base[max(0, i - 1) : i + 1])
    known = _GAZETTEER.get(kind)
    return (
        1 if _STRICT[kind].match(span) else -1,
        check_vote(kind, span),
        0 if known is None else 1 if known.search(span) else -1,
        1 if _FOR[kind].search(before) or _FOR[kind].search(after) else 0,
        -1 if _AGAINST.search(before) else 0,
        1 if near else 0,
    )


def votes_code(v: tuple[int, ...]) -> int:
    code = 0
    for x in v:
        code = code * 3 + x + 1
    return code


def decoded(code: int) -> tuple[int, ...]:
    out = []
    for _ in LABELERS:
        code, x = divmod(code, 3)
        out.append(x - 1)
    return tuple(reversed(out))


FEATURES = ("valid", "long", "separated", "upper", "line_start", "line_end", "cue", "counter_cue")


def features(text: str, kind: str, a: int, b: int) -> int:
    """Features of a span as bits; the classifier sees these and the kind, not the votes."""
    span = text[a:b]
    bits = (
        check_vote(kind, span) >= 0, b - a >= 16, bool(re.search(r"[ .()-]", span)), span[:1].isupper(),
        a == 0 or text[a - 1] == "\n", b == len(text) or text[b] == "\n",
        bool(_FOR[kind].search(text[max(0, a - CONTEXT) : a])), bool(_AGAINST.search(text[max(0, a - CONTEXT) : a])),
    )
    return sum(1 << i for i, x in enumerate(bits) if x)


# ---------------------------------------------------------------- label model and classifier

def label_model(table: list[tuple[str, int, float]], rounds: int = 60) -> dict[tuple[str, int], float]:
    """Posterior of each (kind, votes code), from the counts of all of them.

    Two classes, a prior for each kind, and for each labeler a table of vote probabilities by class, shared by the kinds. Starts from
    the view that labelers are right more often than not; pseudo-counts keep rare votes from certainty.
    """
    kinds = sorted({k for k, _, _ in table})
    kind = np.array([kinds.index(k) for k, _, _ in table])
    cast = np.array([decoded(c) for _, c, _ in table]) + 1
    n = np.array([c for _, _, c in table], float)
    p = np.clip(0.5 + 0.2 * (cast - 1).sum(1), 0.05, 0.95)
    for _ in range(rounds):
        prior = (np.bincount(kind, n * p, len(kinds)) + 1) / (np.bincount(kind, n, len(kinds)) + 2)
        odds = np.log(prior / (1 - prior))[kind]
        for j in range(len(LABELERS)):
            yes = np.bincount(cast[:, j], n * p, 3) + np.array([0.5, 1.0, 1.5])
            no = np.bincount(cast[:, j], n * (1 - p), 3) + np.array([1.5, 1.0, 0.5])
            odds += (np.log(yes / yes.sum()) - np.log(no / no.sum()))[cast[:, j]]
        p = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
    return {(k, c): float(x) for (k, c, _), x in zip(table, p)}


def classifier(rows: list[tuple[str, int, float, float]], rounds: int = 300, penalty: float = 0.1) -> dict[str, np.ndarray]:
    """Logistic weights per kind from (kind, features code, weight, soft label), by Newton steps of the whole table."""
    def row(kind, code):
        bits = [code >> i & 1 for i in range(len(FEATURES))]
        return np.array([*(float(k == kind) for k in ADDED), *bits, *(b * (k == kind) for k in ADDED for b in bits)])

    if not rows:
        return {"weights": np.zeros(0)}
    x = np.array([row(k, c) for k, c, _, _ in rows])
    n, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    n = n / max(1.0, n.max() / 1e4)  # keeps steps well conditioned, ratios stay
    w = np.zeros(x.shape[1])
    for _ in range(min(rounds, 50)):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (n * (p - y)) + penalty * w
        step = np.linalg.solve(x.T @ (x * (n * p * (1 - p))[:, None]) + penalty * np.eye(len(w)), gradient)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    codes = range(1 << len(FEATURES))
    return {k: 1 / (1 + np.exp(-np.clip(np.array([row(k, c) for c in codes]) @ w, -30, 30))) for k in ADDED}


COUNTS = "array<struct<kind:string,votes:int,features:int,n:long>>"


def learn(docs: DataFrame, text: str = "text") -> dict[str, list[float]]:
    """Acceptance probability per kind and features code, learned from the candidates of all documents.

    A document is reduced to counts of (kind, votes, features) where it is read; what is summed and reaches the driver
    is at most kinds x vote patterns x feature patterns rows.
    """
    def run(texts: pa.Array) -> pa.Array:
        total: Counter = Counter()
        for t in texts.to_pylist():
            if t:
                total.update((k, v, f) for k, _, _, v, f in candidates(t, base_spans(t)))
        first = [{"kind": k, "votes": v, "features": f, "n": n} for (k, v, f), n in sorted(total.items())]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("votes", pa.int32()), ("features", pa.int32()), ("n", pa.int64())]))
        return pa.array([first if i == 0 else None for i in range(len(texts))], kind)  # one row stands for its batch

    counts = docs.select(F.explode(applied(docs, run, COUNTS, text)).alias("c")).groupBy("c.kind", "c.votes", "c.features").agg(F.sum("c.n").alias("n"))
    table = sorted((r["kind"], r["votes"], r["features"], float(r["n"])) for r in counts.collect())
    if not table:
        return {}
    by_votes: Counter = Counter()
    for k, v, _, n in table:
        by_votes[k, v] += n
    posterior = label_model([(k, v, n) for (k, v), n in sorted(by_votes.items())])
    by_features: dict = {}
    for k, v, f, n in table:
        a, b = by_features.get((k, f), (0.0, 0.0))
        by_features[k, f] = (a + n, b + n * posterior[k, v])
    model = classifier([(k, f, n, s / n) for (k, f), (n, s) in sorted(by_features.items())])
    return {k: v.tolist() for k, v in model.items()}


def find_spans(text: str | None, model: dict[str, list[float]]) -> list[tuple[str, int, int]]:
    """Base spans by kind and start, then accepted candidates by kind and start."""
    if not text:
        return []
    base = base_spans(text)
    more = [(k, a, b) for k, a, b, _, f in candidates(text, base) if k in model and model[k][f] >= ACCEPT]
    return base + sorted(more, key=lambda s: (KINDS.index(s[0]), s[1]))


SPANS = "array<struct<kind:string,start:int,end:int>>"
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def find(docs: DataFrame, model: dict[str, list[float]], text: str = "text", column: str = "spans") -> DataFrame:
    """Add an array column of spans (kind, start, end) in code points, end exclusive: base kinds first.

    Null and empty texts have none. Base spans of different kinds may overlap; added ones touch no other. Without a
    candidate anywhere, or for an empty table, only base spans are found. A column named like ``column`` is replaced.
    """
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in find_spans(t, model)] for t in texts.to_pylist()], _SPANS)

    return docs.withColumn(column, applied(docs, run, SPANS, text))


def masked(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """The text with every span replaced by its kind in brackets; spans that overlap become one, named after the first."""
    if not text or not spans:
        return text
    out, at, last = [], 0, -1
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a < last:
            last = max(last, b)
            at = last
            continue
        out += [text[at:a], f"[{kind.upper()}]"]
        at = last = b
    return "".join([*out, text[at:]])


def mask(docs: DataFrame, model: dict[str, list[float]], text: str = "text") -> DataFrame:
    """Replace ``text`` by its masked form; null stays null."""
    def run(texts: pa.Array) -> pa.Array:
        return pa.array([masked(t, find_spans(t, model)) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, applied(docs, run, "string", text))
