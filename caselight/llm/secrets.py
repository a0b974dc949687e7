"""Secret scanning with Spark's own functions.

Fixed patterns give the base spans. Candidate strings, which are long runs of key characters, are also scanned with a sliding window
whose Shannon entropy is kept up to date from character counts; windows whose character class has more entropy than it
may have add spans, unless an allow-list knows the string.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import free

#: Fixed patterns of the base kinds, and the least length of what they match (of group 2 for assign).
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
ASSIGN_LEAST = 12

#: Characters in a window.
WINDOW = 20
#: Candidate strings: whole runs of key characters, long enough for a window, with a digit in them.
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{%d,}" % WINDOW
#: Digits, a-f, g-z, A-F, G-Z, signs: a character's number tells its class.
ALPHABET = "0123456789abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ+/_-"
#: Added kinds with the entropy, in bits, above which a window of their class is taken.
ADDED = {"window_hex": 2.87, "window_lower": 3.37, "window_mixed": 3.57}
KINDS = ("assign", "access", "hex", *ADDED)
#: Strings that are no secrets: UUIDs, published examples, paths and names in which words and numbers alternate, counters.
ALLOWED = (
    r"\A[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\z",
    r"(?i)example|sample|changeme|placeholder|xxxxxx|000000|123456789",
    r"\A[0-9+/_-]+\z",
    r"\A(?:[A-Za-z]{3,}|[0-9]{1,4})(?:[/_+-](?:[A-Za-z]{3,}|[0-9]{1,4}))+\z",
    r"\A[A-Za-z]+[0-9]{1,4}\z",
)


def running(lengths: Column, block: int = 128) -> Column:
    """Sums of the elements before each element.

    Sums of whole blocks are reused, so an element adds up its own block and the blocks before it, not all elements.
    """
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    n = F.size(lengths)
    numbers = lambda last: F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))
    sums = F.transform(numbers(F.floor((n - 1) / block).cast("int")), lambda b: total(F.slice(lengths, b * block + 1, F.lit(block))))
    before = F.transform(numbers(F.size(sums) - 1), lambda b: F.when(b > 0, total(F.slice(sums, F.lit(1), b))).otherwise(F.lit(0)))
    return F.transform(
        numbers(n - 1),
        lambda i: F.element_at(before, F.floor(i / block).cast("int") + 1)
        + F.when(i % block > 0, total(F.slice(lengths, F.floor(i / block).cast("int") * block + 1, i % block))).otherwise(F.lit(0)),
    )


_SPAN = "array<struct<start:int,kind_number:int,end:int,found:string>>"


def matches(docs: DataFrame, text: str, kind: str, pattern: str, column: str) -> DataFrame:
    """Add an array of (start, kind_number, end, found) of a pattern's matches, in code points.

    Places follow from the lengths of what lies between matches; a text without a match is read once.
    """
    found, gaps, sizes, before = free(docs.withColumn(column, F.lit(None)), "__found", "__gaps", "__sizes", "__before")
    some, at = F.size(found) > 0, lambda name, i: F.element_at(name, i + 1)
    docs = docs.withColumn(found, F.regexp_extract_all(F.col(text), F.lit(pattern), F.lit(0)))
    docs = docs.withColumn(gaps, F.when(some, F.transform(F.split(F.col(text), pattern, -1), F.length)))
    docs = docs.withColumn(sizes, F.when(some, F.transform(F.col(found), lambda s, i: at(gaps, i) + F.length(s))))
    docs = docs.withColumn(before, F.when(some, running(F.col(sizes))))
    spans = F.transform(
        F.col(found),
        lambda s, i: F.struct(
            (at(before, i) + at(gaps, i)).alias("start"), F.lit(KINDS.index(kind) if kind in KINDS else -1).alias("kind_number"),
            (at(before, i) + at(gaps, i) + F.length(s)).alias("end"), s.alias("found"),
        ),
    )
    return docs.withColumn(column, F.when(some, spans).otherwise(F.array().cast(_SPAN))).drop(found, gaps, sizes, before)


def _weight(n: Column) -> Column:
    return F.when(n > 1, n * F.log2(n.cast("double"))).otherwise(F.lit(0.0))


def window_spans(text: Column) -> Column:
    """Array of (start, kind_number, end) of the windows of one candidate string that have too much entropy, joined where they overlap.

    One pass: the state holds a count for each character, the counts of classes and the sum of n log2 n. A step takes
    the entering and the leaving character's counts and changes the sum by their difference, it adds nothing up anew.
    The entropy of a window is log2 of its length less that sum divided by the length.
    """
    codes = F.transform(F.slice(F.split(text, ""), F.lit(1), F.length(text)), lambda c: F.instr(F.lit(ALPHABET), c))
    kind_of = {
        "digit": lambda c: c <= 10, "hex_low": lambda c: (c > 10) & (c <= 16), "low": lambda c: (c > 10) & (c <= 36),
        "hex_up": lambda c: (c > 36) & (c <= 42), "up": lambda c: (c > 36) & (c <= 62), "sign": lambda c: c > 62,
    }
    start = F.struct(
        F.array_repeat(F.lit(0), len(ALPHABET) + 1).alias("n"), F.lit(0.0).alias("s"), *[F.lit(0).alias(k) for k in kind_of],
        F.lit(-1).alias("start"), F.lit(-1).alias("kind"), F.lit(-1).alias("end"), F.array().cast("array<struct<start:int,kind_number:int,end:int>>").alias("done"),
    )

    def step(codes: Column):
        def run(state: Column, i: Column) -> Column:
            enter = F.element_at(codes, i)
            leave = F.when(i > WINDOW, F.element_at(codes, F.greatest(i - WINDOW, F.lit(1)))).otherwise(F.lit(0))
            moved = leave != enter
            more, less = F.element_at(state["n"], enter + 1), F.when(leave > 0, F.element_at(state["n"], leave + 1)).otherwise(F.lit(0))
            change = F.when(moved, _weight(more + 1) - _weight(more) + F.when(leave > 0, _weight(less - 1) - _weight(less)).otherwise(F.lit(0.0))).otherwise(F.lit(0.0))
            counts = F.transform(state["n"], lambda x, k: x + F.when(k == enter, 1).otherwise(0) - F.when((k == leave) & (leave > 0), 1).otherwise(0))
            inside = {k: state[k] + F.when(f(enter), 1).otherwise(0) - F.when((leave > 0) & f(leave), 1).otherwise(0) for k, f in kind_of.items()}
            return F.struct((F.when(moved, counts).otherwise(state["n"])).alias("n"), (state["s"] + change).alias("s"), *[v.alias(k) for k, v in inside.items()], state["start"].alias("start"), state["kind"].alias("kind"), state["end"].alias("end"), state["done"].alias("done"))

        return run

    def judge(state: Column, i: Column) -> Column:
        entropy = F.lit(math.log2(WINDOW)) - state["s"] / WINDOW
        plain = state["sign"] == 0
        is_hex = plain & (state["digit"] > 0) & (((state["low"] > 0) & (state["up"] == 0) & (state["low"] == state["hex_low"])) | ((state["up"] > 0) & (state["low"] == 0) & (state["up"] == state["hex_up"])))
        is_lower = plain & (state["digit"] > 2) & (state["low"] > 2) & (state["up"] == 0)
        is_mixed = (state["digit"] > 0) & (state["low"] > 0) & (state["up"] > 0)
        base = len(KINDS) - len(ADDED)
        limits = list(ADDED.values())
        kind = (
            F.when(i < WINDOW, -1).when(is_hex & (entropy > limits[0]), base).when(~is_hex & is_lower & (entropy > limits[1]), base + 1)
            .when(is_mixed & (entropy > limits[2]), base + 2).otherwise(-1)
        )
        apart = (kind >= 0) & ((state["kind"] != kind) | (i - WINDOW > state["end"]))
        closed = F.when(apart & (state["kind"] >= 0), F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["kind"].alias("kind_number"), state["end"].alias("end"))))).otherwise(state["done"])
        return F.struct(
            state["n"].alias("n"), state["s"].alias("s"), *[state[k].alias(k) for k in kind_of],
            F.when(apart, i - WINDOW).otherwise(state["start"]).alias("start"), F.when(kind >= 0, kind).otherwise(state["kind"]).alias("kind"),
            F.when(kind >= 0, i).otherwise(state["end"]).alias("end"), closed.alias("done"),
        )

    def finish(state: Column) -> Column:
        return F.when(state["kind"] >= 0, F.concat(state["done"], F.array(F.struct(state["start"].alias("start"), state["kind"].alias("kind_number"), state["end"].alias("end"))))).otherwise(state["done"])

    # a lambda over a one-element array binds the codes once for all steps
    bound = F.transform(
        F.array(codes),
        lambda c: F.aggregate(F.sequence(F.lit(1), F.size(c)), start, lambda state, i: _then(step(c)(state, i), i, judge), finish),
    )
    return F.element_at(bound, 1)


def _then(state: Column, i: Column, judge) -> Column:
    """Apply a second function to a state without writing the first one's expression out at each use."""
    return F.element_at(F.transform(F.array(state), lambda s: judge(s, i)), 1)


def scan(docs: DataFrame, text: str = "text", column: str = "secrets") -> DataFrame:
    """Add an array of (start, kind, end) of secrets, by start and then kind, in code points, end exclusive.

    Null and empty texts have none. Base spans of different kinds may overlap and all stay; an added span is left out if
    it touches a base span. A column named like ``column`` is replaced; others stay, whatever
    they are called. Very long texts are scanned whole; equal texts have equal spans.
    """
    whole, assign, access, hexes, candidate, base, more = free(docs.withColumn(column, F.lit(None)), "__text", "__assign", "__access", "__hex", "__candidate", "__base", "__added")
    own = docs.withColumn(whole, F.coalesce(F.col(text), F.lit("")))
    own = matches(own, whole, "assign", ASSIGN, assign)
    own = matches(own, whole, "access", ACCESS, access)
    own = matches(own, whole, "hex", HEX, hexes)
    own = matches(own, whole, "candidate", CANDIDATE, candidate)
    long = F.filter(assign, lambda s: F.length(F.regexp_extract(s["found"], ASSIGN, 2)) >= ASSIGN_LEAST)
    own = own.withColumn(base, F.transform(F.concat(long, F.col(access), F.col(hexes)), lambda s: s.dropFields("found")))
    allowed = lambda s: F.lit(False) if not ALLOWED else _any([s["found"].rlike(p) for p in ALLOWED])
    loose = F.filter(candidate, lambda c: ~allowed(c) & ~F.exists(base, lambda b: (b["start"] <= c["start"]) & (b["end"] >= c["end"])))
    windows = F.flatten(F.transform(loose, lambda c: F.transform(window_spans(c["found"]), lambda w: F.struct((w["start"] + c["start"]).alias("start"), w["kind_number"].alias("kind_number"), (w["end"] + c["start"]).alias("end")))))
    added = F.filter(windows, lambda w: ~F.exists(base, lambda b: (b["start"] < w["end"]) & (b["end"] > w["start"])))
    own = own.withColumn(more, F.when(F.size(candidate) > 0, added).otherwise(F.array().cast("array<struct<start:int,kind_number:int,end:int>>")))
    names = F.array(*[F.lit(k) for k in KINDS])
    listed = F.transform(F.array_sort(F.concat(base, more)), lambda s: F.struct(s["start"].alias("start"), F.element_at(names, s["kind_number"] + 1).alias("kind"), s["end"].alias("end")))
    return own.withColumn(column, listed).drop(whole, assign, access, hexes, candidate, base, more)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out
