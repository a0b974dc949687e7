"""Labelled fields from report text, and cases from line listings.

Each label has a column with its values; a label that the text does not hold costs one search for plain text. A field takes the first of
its labels that yields a value. All of it is Spark SQL without a shuffle.
"""

from __future__ import annotations

import itertools
import re

from pyspark.sql import Column, DataFrame, functions as F

from caselight.functions.presence import long_enough, strip, strip_value
from caselight.functions.quality import checked_quality, clean_text, is_binary_junk, text_confidence
from caselight.functions.sql import SPACE as _SPACE, quote, regex as _rx, strip as _strip
from caselight.functions.text import code_to_bool, normalize_gender
from caselight.schemas import (
    CASE_LABELS,
    CASE_RULES,
    DRUG_LABELS,
    MIN_TEXT_CHARS,
    MONTH_NAME,
    NUMERIC_DATE,
    ONSET_LABELS,
    REACTION_LABELS,
    REPORT_DATE_LABELS,
    REPORT_FIELDS,
    REPORTER_LABELS,
    VALUE_FORMATS,
)

CASE_MARKER = r"Case(?:\s+ID)?\s*:?\s*([A-Z0-9\-]+)"
_SENTINEL = "\ue0ff"
_MARKER = CASE_MARKER.replace(r"\s", _SPACE)
KNOWN_LABELS = [*DRUG_LABELS, *REPORTER_LABELS, *ONSET_LABELS, *REPORT_DATE_LABELS, *(x for f in REPORT_FIELDS.values() if f for x in f[0])]


def _extract(text: str, pattern: str, flags: str = "di", group: int = 1) -> str:
    return f"regexp_extract({text}, {_rx(pattern, flags)}, {group})"


def _usable(value: str, test: str) -> str:
    """``value`` where it passes a test on ``v``, else null; the value is computed once."""
    return f"get(filter(array({value}), v -> {test}), 0)"



# ---------------------------------------------------------------- labels

def _choice(words: set[str]) -> str:
    """A regex for any of the words, the longest that fits first; words share the pattern of a common beginning."""
    ways = [re.escape(c) + _choice({w[1:] for w in words if w[:1] == c}) for c in sorted({w[0] for w in words if w})]
    if not ways:
        return ""
    one = ways[0] if len(ways) == 1 and "" not in words else f"(?:{'|'.join(ways)})"
    return one + "?" if "" in words else one




def _found_sql(text: str, labels: list[str], whole_word: bool) -> str:
    """Every place of a label before a value, in order: the label in lower case, and the value in each layout it has there.

    Layouts are a separator, the next line, and a dash. A place may have two of them, when the next line begins with a separator.
    """
    names = {label.lower() for label in labels}
    sp = _SPACE
    firsts = "".join(sorted({re.escape(c) for n in names for c in (n[0], n[0].upper())}))
    bound = r"(?<![A-Za-z0-9_])" if whole_word else ""
    # Every match is empty, so that a value is searched for labels, too.
    place = rf"{bound}(?=[{firsts}])(?=({_choice(names)}(?:{sp}*+[:=\-]|{sp}*\n){sp}*[^\n]+))"
    odd = "".join(re.escape(n) + "|" for n in sorted(names, key=len, reverse=True) if re.search("[:=-]", n))
    rx = lambda pattern: f'r"(?di){pattern}"'
    label = rx(rf"^({odd}[^:=\-\n]*?){sp}*[:=\-\n]")
    after, below, sep = rx(rf"^{sp}*[:=\-]{sp}*([^\n]+)"), rx(rf"^{sp}*\n{sp}*([^\n]+)"), rx(rf"^{sp}*([:=\-])")
    tidy = _rx(r"\s+(?:and|or|a|the|with)\s+[A-Z][a-z]+\s*:")

    def tidied(v: str) -> str:
        return f"CASE WHEN contains({v}, ':') THEN {_strip(f'regexp_replace({_strip(v)}, {tidy}, {quote(chr(32))})')} ELSE {_strip(v)} END"

    named = f"transform(regexp_extract_all({text}, {rx(place)}, 1), p -> named_struct('p', p, 'label', lower(regexp_extract(p, {label}, 1))))"
    rest = f"transform({named}, p -> named_struct('label', p.label, 'r', substr(p.p, length(p.label) + 1)))"
    cut = (
        f"transform({rest}, p -> named_struct('label', p.label, 'sep', regexp_extract(p.r, {sep}, 1), 'after', regexp_extract(p.r, {after}, 1), "
        f"'below', CASE WHEN contains(p.r, '\\n') THEN regexp_extract(p.r, {below}, 1) ELSE '' END))"
    )
    return (
        f"transform({cut}, p -> named_struct('label', p.label, 'colon', CASE WHEN p.sep IN (':', '=') AND p.after <> '' THEN {tidied('p.after')} END, "
        f"'below', CASE WHEN p.below <> '' THEN {tidied('p.below')} END, 'dash', CASE WHEN p.sep = '-' AND p.after <> '' THEN {tidied('p.after')} END))"
    )


def _column(label: str) -> str:
    """The column of ``with_labels`` that holds a label's values."""
    return f"_label_{label.lower()}"


def _places_sql(text: str, label: str, whole_word: bool) -> str:
    """The first value of a label in each layout, as written; empty where it has none, null where the label is not in the text.

    Layouts are a separator, the next line, and a dash. Only labels that the text holds are searched with a regex.
    """
    head = (r"(?<![A-Za-z0-9_])" if whole_word else "") + re.escape(label)
    values = ", ".join(f"regexp_extract({text}, r\"(?di){head}{_SPACE}*{mark}{_SPACE}*([^\n]+)\", 1)" for mark in ("[:=]", r"\n", "-"))
    return f"CASE WHEN contains(_lowered, {quote(label)}) THEN array({values}) END"


def _tidied_sql(found: str) -> str:
    """The values of one label as an array, without white space around them and without a label that follows inside them."""
    tidy = _rx(r"\s+(?:and|or|a|the|with)\s+[A-Z][a-z]+\s*:")
    inner = f"CASE WHEN contains(v, ':') THEN {_strip(f'regexp_replace({_strip("v")}, {tidy}, {quote(chr(32))})')} WHEN v <> '' THEN {_strip('v')} END"
    return f"transform({found}, v -> {inner})"


def with_labels(df: DataFrame, text: str = "text", whole_word: bool = False, labels: list[str] | None = None) -> DataFrame:
    """The frame with what field expressions read: a lower-case copy of its text, ``_lowered``, and a column of values for each label.

    ``_found`` lists every place of a label, in order, and ``_names`` the labels found. ``whole_word`` keeps labels from matching inside
    longer words. Without ``labels`` all known ones are looked for. Columns that no later step reads cost nothing, as Spark drops them.
    """
    wanted = labels or KNOWN_LABELS
    places = {_column(label): F.expr(_places_sql(f"`{text}`", label.lower(), whole_word)) for label in wanted}
    values = {name: F.expr(_tidied_sql(f"`{name}`")) for name in places}
    none = {_column(label): F.lit(None).cast("array<string>") for label in KNOWN_LABELS}
    out = df.withColumn("_lowered", F.lower(F.col(text))).withColumn("_found", F.expr(_found_sql(f"`{text}`", wanted, whole_word)))
    return out.withColumn("_names", F.array_distinct("_found.label")).withColumns(places).withColumns({**none, **values})


def _field_sql(labels: list[str], kind: str | None, min_chars: int, full_year: bool) -> str:
    columns = [f"`{_column(label)}`" for label in dict.fromkeys(label.lower() for label in labels)]
    if kind is None:
        values = [f"get({c}, {layout})" for c in columns for layout in range(3)]
        return f"substring(coalesce({', '.join(f'CASE WHEN length({v}) >= {min_chars} THEN {v} END' for v in values)}), 1, 500)"

    fmt = VALUE_FORMATS[kind]
    if kind == "date" and full_year:
        fmt = rf"(?:\d{{4}}-\d{{2}}-\d{{2}}|{fmt})"
    fmt = _rx(fmt)
    present = f"filter(array({', '.join(columns)}), p -> p IS NOT NULL)"
    usable = f"filter(p, v -> length(v) >= {min_chars})"
    typed = f"transform({usable}, v -> named_struct('hit', substring(v, 1, 500) rlike {fmt}, 'v', {_strip(f'regexp_extract(substring(v, 1, 500), {fmt}, 0)')}))"
    # A match that is blank after trimming is no candidate at all. The first label with candidates is closed by a first one that misses.
    candidates = f"filter(transform({present}, p -> filter({typed}, s -> NOT s.hit OR s.v <> '')), c -> size(c) > 0)"
    return (
        f"get(transform(array({candidates}), c -> CASE WHEN get(get(c, 0), 0).hit THEN get(get(c, 0), 0).v "
        f"ELSE get(filter(flatten(slice(c, 2, {len(labels)})), s -> s.hit), 0).v END), 0)"
    )


def labelled_field(labels: list[str], kind: str | None = None, min_chars: int = 2, full_year: bool = False) -> Column:
    """Value of the first label that yields one; null when none does.

    It reads the columns of ``with_labels``, which must have looked for these labels. A typed field takes the first value whose format matches. The very first value that does not
    match closes its own label, so later layouts of that label are not looked at. ``full_year`` keeps four-digit years whole.
    """
    return F.expr(_field_sql(labels, kind, min_chars, full_year))


# ---------------------------------------------------------------- fields

def drug_name(text: str, lowered: str, **options) -> Column:
    """Labels, else the first Drug-code or run of capitalised words, else a marked line's value."""
    body = F.col(text)
    run = F.expr(_extract(text, r"\b(Drug-[A-Z0-9]+|[A-Z][a-z]+(?:\s+[A-Z][a-z]+)*)\b", "d"))
    lines = F.filter(F.split(body, "\n"), lambda l: F.upper(l).rlike("DRUG|MEDICATION|SUSPECT"))
    values = F.transform(lines, lambda l: strip(F.regexp_extract(l, r"(?s)[:=\-](.*)$", 1)))
    marked = F.get(F.filter(values, lambda v: F.length(v).between(3, 99)), 0)
    return F.coalesce(labelled_field(DRUG_LABELS, **options), F.nullif(run, F.lit("")), marked)


def adverse_reaction(text: str, lowered: str) -> Column:
    """Line after a reaction label, at least five characters and not starting like a date."""
    stops = [r"(?=\n(?:Event|Date|Severity|Outcome|Drug|Report|Patient)|\z)", r"(?:\n|$)"]
    test = "length(v) >= 5 AND NOT v rlike " + _rx(r"^\d{4}[-/]\d{2}")
    values = []
    for label in REACTION_LABELS:
        tried = [
            _usable(_strip(_extract(text, rf"{re.escape(label)}\s*:?\s*([^\n]+?){stop}", "dims")), test) for stop in stops
        ]
        values.append(f"CASE WHEN contains({lowered}, '{label.lower()}') THEN coalesce({', '.join(tried)}) END")
    return F.expr(f"coalesce({', '.join(values)})")


def reporter_name(text: str, lowered: str, **options) -> Column:
    """Labels, then titled names, then a title and the rest of its line."""
    title = "Dr|Mr|Ms|Prof|Mrs"
    name = rf"(?:[A-Za-z.]|{_SPACE})+?"
    patterns = [
        rf"(?:Reporter|Submitted|Contact|Investigator).*?:\s*((?:{title})\.\s+{name})(?:\n|,|$)",
        rf"(?:{title})\.\s+({name})(?:\n|,|$)",
        rf"Reporter\s*:\s*({name})(?:\n|$)",
        rf"Submitted\s+By\s*:\s*({name})(?:\n|$)",
        rf"(?:{title})\s+({name})(?:\n|\z)",
    ]
    test = "length(v) BETWEEN 3 AND 99 AND lower(v) NOT IN ('dr', 'mr', 'ms', 'prof', 'mrs')"
    named = ", ".join(_usable(_strip(_extract(text, p)), test) for p in patterns)
    return F.coalesce(labelled_field(REPORTER_LABELS, **options), F.expr(f"coalesce({named})"))


def _context_date(text: str, lowered: str, labels: list[str], before: str, after: str, last: bool, **options) -> Column:
    # The characters that a word may begin with are looked for first, which costs less than to try each word everywhere.
    firsts = "".join(sorted({x for word in before.split("|") for x in (word[0].lower(), word[0].upper())}))
    word = rf"(?=[{firsts}])(?:{before})"
    named = [
        rf"{word}.*?(\d{{1,2}}\s+{MONTH_NAME}\s+\d{{4}})",
        rf"{word}.*?({MONTH_NAME}\s+\d{{1,2}},?\s+\d{{4}})",
    ]
    numeric = [
        rf"{word}\D{{0,20}}({NUMERIC_DATE})",
        rf"({NUMERIC_DATE})\D{{0,30}}(?:{after})",
    ]
    by_name, by_number = (", ".join(_usable(_extract(text, p), "v <> ''") for p in patterns) for patterns in (named, numeric))
    # A date with the name of its month has a letter, white space and the year, with or without a day between.
    near = f"CASE WHEN {text} rlike {_rx(r'[a-z]\s+(?:\d{1,2},?\s+)?\d{4}', 'di')} THEN coalesce({by_name}) END, {by_number}"
    anywhere = f"try_element_at(regexp_extract_all({text}, {_rx(NUMERIC_DATE)}, 0), {-1 if last else 1})"
    return F.coalesce(labelled_field(labels, "date", **options), F.expr(f"coalesce({near}, {anywhere})"))


def onset_date(text: str, lowered: str, **options) -> Column:
    words = "Onset|Reaction|Symptom|Adverse"
    return _context_date(text, lowered, ONSET_LABELS, words, words.lower(), False, **options)


def report_date(text: str, lowered: str, **options) -> Column:
    return _context_date(
        text, lowered, REPORT_DATE_LABELS, "Report|Submitted|Filed", "report|submit|filed", True, **options
    )


def parse_reports(df: DataFrame, text: str = "text", short_fields_min_chars: int = 2, whole_word: bool = False, full_year: bool = False) -> DataFrame:
    """Add the thirty report fields; texts under 100 characters give none.

    ``short_fields_min_chars=1`` keeps one-character genders and ages.
    """
    readable = F.when(long_enough(F.col(text), MIN_TEXT_CHARS), F.col(text))
    prepared = with_labels(df.withColumn("_text", readable), "_text", whole_word)
    plain = {"min_chars": 2, "full_year": full_year}
    special = {
        "drug_name": drug_name("_text", "_lowered", **plain),
        "adverse_reaction": adverse_reaction("_text", "_lowered"),
        "onset_date": onset_date("_text", "_lowered", **plain),
        "reporter_name": reporter_name("_text", "_lowered", **plain),
        "report_date": report_date("_text", "_lowered", **plain),
    }

    def value(name: str) -> Column:
        if name in special:
            return special[name]
        labels, kind = REPORT_FIELDS[name]
        short = name in ("patient_gender", "patient_age")
        return labelled_field(labels, kind, **(plain | {"min_chars": short_fields_min_chars if short else 2}))

    fields = {name: F.nullif(value(name), F.lit("")) for name in REPORT_FIELDS}
    return prepared.withColumns(fields).drop("_text", "_lowered", "_found", "_names", *[_column(label) for label in KNOWN_LABELS])


def split_cases(df: DataFrame, text: str = "text") -> DataFrame:
    """One row per case marker: the block up to the next marker, with its id and position.

    The text before the first marker is dropped. ``pos`` counts from 0 inside a document.
    """
    # A sentinel that the text itself holds is told apart by what follows it.
    held = F.col(text).contains(_SENTINEL)
    own = F.when(held, F.replace(F.col(text), F.lit(_SENTINEL), F.lit(_SENTINEL + "0"))).otherwise(F.col(text))
    marked = F.regexp_replace(own, f"(?di)({_MARKER})", f"{_SENTINEL}1$1")
    blocks = F.split(marked, _SENTINEL + "1")
    blocks = F.when(held, F.transform(blocks, lambda b: F.replace(b, F.lit(_SENTINEL + "0"), F.lit(_SENTINEL)))).otherwise(blocks)
    rest = F.slice(blocks, 2, 1 << 30)  # all but the first; their number would have the text split a second time
    # Short texts give no blocks. Said inside the generator, a text computed upstream is not
    # computed a second time for a pushed-down filter.
    readable = F.when(long_enough(F.col(text), MIN_TEXT_CHARS), rest)
    out = df.select(*[c for c in df.columns if c != text], F.posexplode(readable).alias("pos", "block"))
    return out.withColumn("marker_id", F.regexp_extract("block", f"(?di)^{_MARKER}", 1))


def _deciding(labels: list[tuple[str, str]]) -> list[tuple[str, str]]:
    """The listed labels without those whose presence never decides, because a part of them does: an earlier label, or a later one of the same field."""
    out: list[tuple[str, str]] = []
    for i, (label, target) in enumerate(labels):
        if any(earlier in label for earlier, _ in labels[:i]):
            continue
        same = itertools.takewhile(lambda x: x[1] == target, labels[i + 1 :])
        if not any(later in label for later, _ in same):
            out.append((label, target))
    return out


def _case_lines(block: str) -> Column:
    """The ``name: value`` lines of a block, last first, with the field that each name stands for.

    The first listed label contained in the name decides.
    """
    lines = f"reverse(filter(split({block}, '\\n'), l -> contains(l, ':')))"
    whens = " ".join(f"WHEN contains(n, '{label}') THEN '{target}'" for label, target in _deciding(CASE_LABELS))
    field = f"get(transform(array(lower(substring_index(l, ':', 1))), n -> CASE {whens} END), 0)"
    return F.expr(f"transform(array({lines}), ls -> named_struct('lines', ls, 'fields', transform(ls, l -> {field})))")


def parse_cases(df: DataFrame, text: str = "text", min_fields: int = 8) -> DataFrame:
    """Line listing cases with at least eight of the eleven fields present.

    A later line of a field overwrites an earlier one. The lines come out of a generator, so that the filter on present fields cannot be
    pushed below it and read the block again; the values have neither generator nor lambda around them, so that Spark compiles them.
    """
    blocks = split_cases(df, text)
    kept = [c for c in blocks.columns if c not in ("block", "marker_id")]
    named = blocks.select(*kept, "marker_id", F.explode(_case_lines("block")).alias("c"))

    def last(name: str) -> Column:
        line = F.get("c.lines", (F.array_position("c.fields", name) - 1).cast("int"))
        return strip_value(F.substr(line, F.instr(line, ":") + 1))

    values = {name: last(name) for name in CASE_RULES}
    gender = values["patient_gender"]
    values["case_id"] = F.coalesce(values["case_id"], F.col("marker_id"))
    values["patient_gender"] = F.when(gender.isNotNull(), normalize_gender(gender))
    values["dechallenge_performed"] = code_to_bool(values["dechallenge_performed"])
    present = [
        F.coalesce(F.col(n) if rule["type"] == "boolean" else F.col(n) != "", F.lit(False)).cast("int") for n, rule in CASE_RULES.items()
    ]
    return named.select(*kept, *[v.alias(n) for n, v in values.items()]).where(sum(present, F.lit(0)) >= min_fields)


def first_usable_text(df: DataFrame, key: str = "doc_id", rank: str = "method_rank", text: str = "text", min_chars: int = MIN_TEXT_CHARS) -> DataFrame:
    """Per document the text of the best-ranked method that gave enough characters, with ``status`` and ``reason``.

    A document none of whose texts was usable stays, without a text and with the failure status. One aggregation finds both.
    """
    others = [c for c in df.columns if c != key]
    best = F.min_by(F.struct(*others), F.when(long_enough(F.col(text), min_chars), F.col(rank))).alias("best")
    failed = F.col("best").isNull()
    return df.groupBy(key).agg(best).select(
        key, *[F.col(f"best.{c}").alias(c) for c in others],
        F.when(failed, "EXTRACTION_FAILED").otherwise("SUCCESS").alias("status"),
        F.when(failed, "Could not extract readable text from PDF").alias("reason"),
    )


def checked_extraction(df: DataFrame, key: str = "doc_id", rank: str = "method_rank", text: str = "text", quality: str = "quality") -> DataFrame:
    """One row per document: the first usable text, cleaned, rated and blanked when its quality is low.

    ``df`` has a row per document and method, with ``quality`` as the method rates itself. The best text is cleaned, the cleaned text's
    length may lower the rating, and a text of low quality is withheld with an error. The first method, which states no confidence, gets
    the text's own. A document without usable text stays, with an error.
    """
    usable = long_enough(F.col(text), MIN_TEXT_CHARS)
    best = F.min_by(F.struct(rank, text, quality), F.when(usable, F.col(rank))).alias("_b")
    found = df.groupBy(key).agg(best).select(key, F.col(f"_b.{rank}").alias(rank), clean_text(F.col(f"_b.{text}")).alias("_clean"), F.col(f"_b.{quality}").alias("_q"))
    rated = found.withColumn("quality", F.when(F.col(rank).isNull(), "low").otherwise(checked_quality(F.col("_clean"), F.col("_q"))))
    low = F.col("quality") == "low"
    error = F.when(F.col(rank).isNull(), "No text extracted from document").when(low, "Extraction quality too low - document may be corrupted or unreadable")
    confidence = F.when(F.col(rank) == 1, text_confidence(F.col("_clean"))).otherwise(F.lit(0.0))
    return rated.select(key, rank, "quality", confidence.alias("confidence"), error.alias("error"), F.when(low, "").otherwise(F.col("_clean")).alias(text))


def roll_up_pages(df: DataFrame, key: str = "doc_id", page: str = "page_no", text: str = "text", ocr: str | None = None) -> DataFrame:
    """Join a document's readable pages in order and measure how many were readable."""
    readable = ~is_binary_junk(F.col(text))
    aggregates = [
        F.array_sort(F.collect_list(F.when(readable, F.struct(F.col(page).alias("page"), F.col(text).alias("text"))))).alias("_pages"),
        F.count_if(readable).alias("pages_extracted"),
        F.count(F.lit(1)).alias("total_pages"),
    ]
    if ocr is not None:
        aggregates.append((F.avg(F.when(F.col(ocr) > 0, F.col(ocr))) / 100).alias("ocr_confidence"))
    out = df.groupBy(key).agg(*aggregates)
    joined = F.array_join(F.transform("_pages", lambda p: F.concat(p["text"], F.lit("\n"))), "")
    return out.withColumns(
        {"text": joined, "confidence": F.col("pages_extracted") / F.col("total_pages")}
    ).drop("_pages")
