"""Secret scans against plain code."""

import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from caselight.llm import secrets

ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)


def base(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    return out + [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]


def window_kind(w):
    n = Counter(w)
    entropy = -sum(c / len(w) * math.log2(c / len(w)) for c in n.values())
    digit, low, up = (any(f(c) for c in w) for f in (str.isdigit, str.islower, str.isupper))
    plain, limits = all(c.isalnum() for c in w), list(secrets.ADDED.values())
    is_hex = plain and digit and (low != up) and all(c in "0123456789abcdefABCDEF" for c in w)
    if is_hex and entropy > limits[0]:
        return 3
    if not is_hex and plain and not up and sum(c.isdigit() for c in w) > 2 and sum(c.islower() for c in w) > 2 and entropy > limits[1]:
        return 4
    return 5 if digit and low and up and entropy > limits[2] else None


def windows(text):
    out = []
    for i in range(len(text) - secrets.WINDOW + 1):
        kind = window_kind(text[i : i + secrets.WINDOW])
        if kind is None:
            continue
        if out and out[-1][1] == kind and i <= out[-1][2]:
            out[-1] = (out[-1][0], kind, i + secrets.WINDOW)
        else:
            out.append((i, kind, i + secrets.WINDOW))
    return out


def plain(text):
    text = text or ""
    found = base(text)
    added = []
    for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text):
        s = m[0]
        if not any(c.isdigit() for c in s) or any(re.search(p.replace(r"\z", r"\Z"), s) for p in secrets.ALLOWED):
            continue
        if any(a <= m.start() and b >= m.end() for a, _, b in found):
            continue
        for a, k, b in windows(s):
            a, b = a + m.start(), b + m.start()
            if not any(x < b and y > a for x, _, y in found):
                added.append((a, k, b))
    return [(secrets.KINDS[k], a, b) for a, k, b in sorted(found + added)]


def texts():
    rng = random.Random(8)
    bits = ["password", "PassWD", "token:", "secret =", 'api_key="', "apiKEY'", ":", "=", " ", "  ", "'", '"', "\n", "é", "\U0001f600", "AKIA", "AKIAIOSFODNN7", "0123456789abcdef", "deadbeef", "x", "Zz9", "abcdefghijkl", "-", "_", ".", "/", "+"]
    alphabets = ["0123456789abcdef", "0123456789ABCDEF", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "aaab1", "01"]
    out = [None, "", "a", "token token = 'abcdefghijklm' secret", "KEY: api_key=short password: 123456789012", "token:secret:ABCDEFGHIJKLMNOP", "ſecret=abcdefghijklmnop to\u212aen=abcdefghijklmnop",
           "id 123e4567-e89b-12d3-a456-426614174000 end", "see https://host/blog-2020-some_words-here-77 and example0123456789abcdefABCDEF", "abcdefghijklmnopqrstuvwxyz and ABCDEFGHIJKLMNOPQRSTUVWXYZ123"]
    for _ in range(300):
        out.append("".join(rng.choices(bits, k=rng.randint(1, 12))))
    for _ in range(250):
        words = ["".join(rng.choices(rng.choice(alphabets), k=rng.randint(8, 60))) for _ in range(4)]
        out.append(rng.choice([" ", "é ", "\n", "-"]).join(words))
    return out


def test_against_plain_code(spark):
    rows = [(i, t, "x") for i, t in enumerate(texts())] + [(3, texts()[3], "x"), (None, texts()[3], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, secrets string").repartition(8)
    got = secrets.scan(df).collect()
    assert len(got) == len(rows)
    kinds = Counter()
    for r in got:
        spans = [(s["kind"], s["start"], s["end"]) for s in r["secrets"]]
        assert spans == plain(r["text"]), r["text"]
        kinds.update(k for k, _, _ in spans)
    assert all(kinds[k] > 0 for k in secrets.KINDS), kinds


def test_thresholds_are_no_possible_entropy():
    def parts(n, most):
        if n == 0:
            yield ()
        for k in range(min(n, most), 0, -1):
            for rest in parts(n - k, k):
                yield (k, *rest)

    found = {round(-sum(k / 20 * math.log2(k / 20) for k in p), 12) for p in parts(20, 20)}
    for limit in secrets.ADDED.values():
        assert min(abs(limit - x) for x in found) > 1e-5


def test_no_python_in_the_plan(spark):
    df = spark.createDataFrame([(1, "token = abcdefghijklmnop")], "doc_id long, text string")
    plan = secrets.scan(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_long_texts(spark):
    rng = random.Random(1)
    blob = "".join(rng.choices("ABCDEFabcdef0123456789+/xyz", k=20000))
    many = " ".join(f"token=abcdef{i:08d}gh" for i in range(3000))
    df = spark.createDataFrame([(1, blob), (2, many), (3, "z" * 300000), (4, " " * 300000), (5, "token" + " " * 300000)], "doc_id long, text string")
    sizes = {r["doc_id"]: r["n"] for r in secrets.scan(df).select("doc_id", F.size("secrets").alias("n")).collect()}
    assert sizes[1] >= 1 and sizes[2] == 3000 and sizes[3] == sizes[4] == sizes[5] == 0


def test_running():
    from pyspark.sql import SparkSession

    spark = SparkSession.getActiveSession()
    for n in (0, 1, 127, 128, 129, 700):
        df = spark.createDataFrame([([*range(n)],)], "a array<int>")
        assert df.select(secrets.running(F.col("a"))).first()[0] == [sum(range(i)) for i in range(n)]


def test_columns_that_clash_with_those_used_on_the_way(spark):
    names = ["__text", "__assign", "__access", "__hex", "__candidate", "__base", "__added", "__found", "__gaps", "__sizes", "__BEFORE"]
    t = "token = abcdefghijklmnop and 0123456789abcdef01"
    df = spark.createDataFrame([(1, t, *names), (2, None, *names)], "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    rows = sorted(secrets.scan(df, column="__sizes2").collect())
    assert [[r[n] for n in names] for r in rows] == [names, names]
    for column in ("__text", "__base", "__found"):
        got = {r["doc_id"]: [(s["kind"], s["start"], s["end"]) for s in r[column]] for r in secrets.scan(df, column=column).collect()}
        assert got == {1: plain(t), 2: []}


def test_empty_table(spark):
    assert secrets.scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []
