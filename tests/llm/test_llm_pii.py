"""Personal data: base spans against the plain patterns, the label model, masking, odd rows."""

import random
import re

import pytest

from caselight.llm import pii

PLAIN = {
    "email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    "card": re.compile(r"[0-9]([\x20-]?[0-9])+"),
    "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]"),
}


def good(kind, found):
    digits = [int(c) for c in found if c.isdigit() and c.isascii()]
    if kind == "ip":
        return all(int(x) <= 255 for x in found.split("."))
    if kind == "card":
        doubled = [d if i % 2 == 0 else sum(divmod(d * 2, 10)) for i, d in enumerate(reversed(digits))]
        return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0
    return 9 <= len(digits) <= 15 if kind == "phone" else True


def plain_spans(text):
    return [(k, *m.span()) for k, p in PLAIN.items() for m in p.finditer(text) if good(k, m[0])]


def test_base_spans_follow_the_patterns():
    rng = random.Random(4)
    bits = ["@", "a", "b.c", ".", "_", "%", "d-e", "1", "23", "255", "256", "0001", " ", "-", "+", "(", ")", "4111111111111111", "+1 (702) 555-0742", "x@y.zz", "1.2.3.4", "é", "\n"]
    for _ in range(6000):
        text = "".join(rng.choices(bits, k=rng.randint(1, 14)))
        assert pii.base_spans(text) == plain_spans(text), text


@pytest.mark.parametrize("text", ["a" * 300000, "1" * 300000, "a@" * 100000, "+1" + " " * 300000, "1.1." * 80000, "1 " * 200000, "Mr. A" * 60000, "[at]" * 60000, "a [at] b " * 30000])
def test_long_runs_take_linear_time(text):
    assert pii.find_spans(text, {}) is not None


def test_label_model_finds_reliable_labelers():
    rng = random.Random(1)
    table = {}
    for _ in range(20000):
        y = rng.random() < 0.4
        v = tuple((1 if y else -1) if rng.random() < r else (-1 if y else 1) for r in (0.9, 0.85, 0.6, 0.8, 0.7, 0.5))
        table[v, y] = table.get((v, y), 0) + 1
    counts = {}
    for (v, _), n in table.items():
        counts[v] = counts.get(v, 0) + n
    post = pii.label_model([("account", pii.votes_code(v), n) for v, n in counts.items()])
    right = sum(n for (v, y), n in table.items() if (post["account", pii.votes_code(v)] > 0.5) == y)
    assert right / 20000 > 0.9
    assert all(pii.decoded(pii.votes_code(v)) == v for v in counts)


def test_masked():
    assert pii.masked("mail a@b.cc now", [("email", 5, 11)]) == "mail [EMAIL] now"
    assert pii.masked("abcdef", [("card", 1, 4), ("ip", 2, 6)]) == "a[CARD]"
    assert pii.masked("abcdef", [("card", 0, 2), ("ip", 2, 6)]) == "[CARD][IP]"
    assert pii.masked(None, []) is None


CARD = "4532015112830366"


def corpus():
    rows = [f"call me, phone (415) 555-26{i:02d} or account {CARD} today" for i in range(30)]
    rows += [f"version 123-45-67{i:02d} and order 99887766{i:02d} plain words" for i in range(30)]
    rows += [f"ssn 123-45-67{i:02d} passport holder" for i in range(10)]
    rows += [f"x 71.129.171.132 {CARD} y", None, "", "Dr. Anna Smith wrote john [at] mail [dot] com", f"+1 (578) 555-6437 {CARD}"]
    return rows


def test_find_adds_spans_and_keeps_base_ones(spark):
    rows = [(i, t, "x") for i, t in enumerate(corpus())] + [(0, corpus()[0], "x"), (None, "a@b.cc", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, spans string")
    model = pii.learn(df)
    got = {r["doc_id"]: r for r in pii.find(df, model).collect()}
    assert pii.find(df, model).count() == len(rows)
    for i, t, _ in rows:
        spans = [(s["kind"], s["start"], s["end"]) for s in got[i]["spans"]]
        base = plain_spans(t or "")
        assert spans[: len(base)] == base
        assert all(t[a:b].strip() for _, a, b in spans)
    joined = got[70]["text"]
    assert any(s["kind"] == "account" and joined[s["start"] : s["end"]] == CARD for s in got[70]["spans"])
    assert CARD not in pii.mask(df.where("doc_id = 70"), model).first()["text"]
    assert pii.mask(df.where("doc_id = 71"), model).first()["text"] is None


def test_no_candidates_and_empty_table(spark):
    df = spark.createDataFrame([(1, "plain words, a@b.cc")], "doc_id long, text string")
    assert pii.learn(df) == {} and pii.learn(df.limit(0)) == {}
    assert [tuple(s) for s in pii.find(df, {}).first()["spans"]] == [("email", 13, 19)]
    assert pii.find(df.limit(0), {}).collect() == []
