"""Registered queries of the subpackage and their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from caselight.llm import decontaminate, langid, lines, merkle, packing, pii, quality, search, secrets, simhash, sketch, toxicity, urls
from caselight.llm.common import LOWER, UPPER, read, remainder


RULES = [
    urls.Rule(True, "org", "/"), urls.Rule(False, "example.org", "/es/"), urls.Rule(False, "example.org", "/en/1"), urls.Rule(True, "com", "/fr/"), urls.Rule(False, "com", "/de/"),
]
#: A url with this parameter puts its host and path on the list; other urls of the same page are then blocked, too.
TRACKED = r"\?(?:[^#]*&)?utm_source="


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = read(spark, folder, "pages", "page_id", "url")
    tracked = pages.where(F.col("url").rlike(TRACKED))
    return urls.judge(pages, tracked.select(F.concat(urls.host(F.col("url")), urls.path(F.col("url"))).alias("key")), RULES)


OP1 = r"""
WITH p AS (SELECT page_id, url, translate(coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
                  coalesce(regexp_extract(url, '^(?s:.*?)://[^/?#]*([^?#]*)', 1), '') AS path FROM pages),
r(name, allow, h, pre) AS (VALUES ('org/', true, 'org', '/'), ('example.org/es/', false, 'example.org', '/es/'), ('example.org/en/1', false, 'example.org', '/en/1'),
                                  ('com/fr/', true, 'com', '/fr/'), ('com/de/', false, 'com', '/de/')),
listed AS (SELECT DISTINCT host || path AS key FROM p WHERE regexp_matches(url, '\?([^#]*&)?utm_source=') AND host || path != ''),
best AS (SELECT p.*, (SELECT max_by(struct_pack(name := name, allow := allow), length(name)) FROM r WHERE (p.host = r.h OR ends_with(p.host, '.' || r.h)) AND starts_with(p.path, r.pre)) AS rule FROM p)
SELECT page_id, host, path, rule.name AS rule,
       CASE WHEN rule IS NOT NULL THEN CASE WHEN rule.allow THEN 'allow' ELSE 'block' END WHEN host || path IN (SELECT key FROM listed) THEN 'block' ELSE 'allow' END AS verdict
FROM best
"""


def scored(found: DataFrame, parts: int, held: int) -> DataFrame:
    return found.select("doc_id", (remainder(F.col("doc_id"), parts) == held).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    model = toxicity.learn(docs, read(spark, folder, "labels", "doc_id", "toxic"), remainder(F.col("doc_id"), 4) != 2)
    return scored(toxicity.score(docs, model), 4, 2)


def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    model = quality.learn(docs, read(spark, folder, "labels", "doc_id", "quality"), remainder(F.col("doc_id"), 5) != 0)
    return scored(quality.score(docs, model), 5, 0)


def op4_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.scan(read(spark, folder, "documents", "doc_id", "text"), column="spans")
    return found.select(
        "doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(listed(("assign", "access", "hex")), 256).alias("base_sha256"), listed(secrets.KINDS).alias("spans"),
    )


def _found_sql(kind: str, number: int, pattern: str, extra: str = "TRUE") -> str:
    """Matches of a pattern with their places, from the lengths of matches and of what lies between them."""
    return f"""SELECT r, {number} AS k, s, s + length(m) AS e, m FROM (
  SELECT r, unnest(ms) AS m, unnest(list_transform(ms, lambda x, i: list_sum(list_transform(gs[1:i], lambda g: length(g))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda g: length(g))), 0))) AS s
  FROM (SELECT r, regexp_extract_all(t, '{pattern}') AS ms, string_split_regex(t, '{pattern}') AS gs FROM d)) WHERE {extra}"""


def _op4_sql() -> str:
    assign = secrets.ASSIGN.replace("'", "''")
    candidate = "[A-Za-z0-9+/_-]{%d,}" % secrets.WINDOW
    allowed = " AND ".join(f"NOT regexp_matches(m, '{p}')" for p in secrets.ALLOWED)
    hex_limit, lower_limit, mixed_limit = secrets.ADDED.values()
    names = "[" + ", ".join(f"'{k}'" for k in secrets.KINDS) + "]"
    w = secrets.WINDOW
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
base AS (SELECT r, k, s, e FROM ({_found_sql("assign", 0, assign, f"length(regexp_extract(m, '{assign}', 2)) >= {secrets.ASSIGN_LEAST}")})
  UNION ALL SELECT r, k, s, e FROM ({_found_sql("access", 1, secrets.ACCESS)}) UNION ALL SELECT r, k, s, e FROM ({_found_sql("hex", 2, secrets.HEX)})),
cand AS (SELECT row_number() OVER () AS c, * FROM ({_found_sql("candidate", -1, candidate, f"regexp_matches(m, '[0-9]') AND {allowed}")}) f
  WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = f.r AND b.s <= f.s AND b.e >= f.e)),
win AS (SELECT c, r, s, i, substr(m, i + 1, {w}) AS w FROM (SELECT *, unnest(range(0, length(m) - {w - 1})) AS i FROM cand)),
entropy AS (SELECT c, i, log2({w}) - sum(n * log2(n)) / {w} AS h FROM (SELECT c, i, ch, count(*) AS n FROM (SELECT c, i, unnest(string_split(w, '')) AS ch FROM win) GROUP BY ALL) GROUP BY ALL),
kinds AS (SELECT c, r, s, i, CASE
    WHEN regexp_matches(w, '^([0-9a-f]+|[0-9A-F]+)$') AND regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-fA-F]') THEN CASE WHEN h > {hex_limit} THEN 3 END
    WHEN regexp_matches(w, '^[0-9a-z]+$') AND length(regexp_replace(w, '[^0-9]', '', 'g')) > 2 AND length(regexp_replace(w, '[^a-z]', '', 'g')) > 2 AND h > {lower_limit} THEN 4
    WHEN regexp_matches(w, '[0-9]') AND regexp_matches(w, '[a-z]') AND regexp_matches(w, '[A-Z]') AND h > {mixed_limit} THEN 5 END AS k
  FROM win JOIN entropy USING (c, i)),
marked AS (SELECT *, CASE WHEN lag(k) OVER o = k AND i <= lag(i) OVER o + {w} THEN 0 ELSE 1 END AS fresh FROM kinds WHERE k IS NOT NULL WINDOW o AS (PARTITION BY c ORDER BY i)),
islands AS (SELECT *, sum(fresh) OVER (PARTITION BY c ORDER BY i) AS g FROM marked),
added AS (SELECT r, any_value(k) AS k, any_value(s) + min(i) AS s, any_value(s) + max(i) + {w} AS e FROM islands GROUP BY c, r, g),
spans AS (SELECT * FROM base UNION ALL SELECT * FROM added a WHERE NOT EXISTS (SELECT 1 FROM base b WHERE b.r = a.r AND b.s < a.e AND b.e > a.s)),
listed AS (SELECT r, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  string_agg(({names})[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) FILTER (k < 3) AS base, string_agg(({names})[k + 1] || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, k, e) AS spans FROM spans GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN listed USING (r)"""


def op7_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return sketch.compared(read(spark, folder, "documents", "doc_id", "text"))


def listed(kinds: tuple[str, ...]) -> Column:
    """Spans of the kinds as kind:start:end, comma-joined in the order they have."""
    chosen = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    return F.array_join(F.transform(chosen, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def op5_pii(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    found = pii.find(docs, pii.learn(docs))
    return found.select(
        "doc_id", *[count_of("spans", k).alias(f"n_{k}") for k in pii.BASE],
        F.sha2(listed(pii.BASE), 256).alias("base_sha256"), listed(pii.KINDS).alias("spans"),
    )


def op6_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text", "lang")
    model = langid.learn(docs.where(remainder(F.col("doc_id"), 5) != 0))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select(
        "doc_id", (remainder(F.col("doc_id"), 5) == 0).alias("held_out"), F.col("language.lang").alias("lang_pred"),
        F.col("language.score").alias("score"), F.col("language.margin").alias("margin"), F.col("language.accepted").alias("accepted"),
    )


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def op9_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(read(spark, folder, "documents", "doc_id", "text"))


def op10_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "text")
    c = decontaminate.contamination(docs, read(spark, folder, "benchmark", "item_id", "text"))
    return c.select(
        "doc_id", F.col("contamination.n_words").alias("n_words"), F.col("contamination.n_hit").alias("n_hit"),
        F.size("contamination.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("contamination.items", ","), 256).alias("items_sha256"), (F.col("contamination.n_hit") > 0).alias("contaminated"),
    )


#: Words of a column and all runs of its windows' sizes, joined with the benchmark's windows.
OP10 = r"""
WITH item AS (SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS gram
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
gram AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS gram
         FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM doc, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
hit AS (SELECT r, i, gram.k AS k, item_id FROM gram JOIN win ON gram.gram = win.gram AND gram.k = win.k),
words AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + k)) AS p FROM hit) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM hit WHERE item_id IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(words.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(items.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items.ids, '')) AS items_sha256, coalesce(words.n, 0) > 0 AS contaminated
FROM doc LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


def op11_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.without_repeats(read(spark, folder, "documents", "doc_id", "text"))
    return found.select("doc_id", "deduplicated.n_lines", "deduplicated.n_dropped", F.sha2("deduplicated.text", 256).alias("kept_sha256"))


OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT r, doc_id, i, ls[i] AS line, trim(translate(ls[i], '{UPPER}', '{LOWER}'), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS k FROM (SELECT r, doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM d)),
g AS (SELECT k, max(doc_id) AS top FROM (SELECT DISTINCT r, doc_id, k FROM l WHERE length(k) >= {lines.CHARS}) GROUP BY k HAVING count(*) >= {lines.LEAST}),
m AS (SELECT l.r, l.doc_id, l.i, l.line, coalesce(g.top IS DISTINCT FROM l.doc_id AND g.top IS NOT NULL, false) AS gone FROM l LEFT JOIN g USING (k))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""


def op12_lexical_search(spark: SparkSession, folder: str) -> DataFrame:
    return search.ranked(read(spark, folder, "documents", "doc_id", "text"), read(spark, folder, "benchmark", "item_id", "text"))


_TERMS = rf"regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
OP12 = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents WHERE text IS NOT NULL),
total AS (SELECT count(*)::BIGINT AS n_docs, sum(len(w))::BIGINT AS n_terms FROM d WHERE len(w) > 0),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(w) AS term FROM d) GROUP BY r, term),
item AS (SELECT row_number() OVER () AS q, item_id, list_distinct({_TERMS}) AS w FROM benchmark WHERE text IS NOT NULL),
wanted AS (SELECT q, item_id, unnest(w) AS term FROM item),
idf AS (SELECT term, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS weight FROM tf, total WHERE term IN (SELECT term FROM wanted) GROUP BY term, n_docs),
doc AS (SELECT r, doc_id, 100 - {search.SLOPE} + ({search.SLOPE} * len(w)::BIGINT * n_docs) // n_terms AS m FROM d, total WHERE len(w) > 0),
gain AS (SELECT r, doc_id, term, weight * ((1000000000 * tf) // (1000 * tf + 8 * m)) AS gain FROM tf JOIN idf USING (term) JOIN doc USING (r)),
score AS (SELECT q, any_value(item_id) AS item_id, r, any_value(doc_id) AS doc_id, sum(gain)::BIGINT AS score FROM wanted JOIN gain USING (term) GROUP BY q, r),
best AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM score WHERE score > 0)
SELECT item_id, rank::INT AS rank, doc_id, score FROM best WHERE rank <= {search.TOP}
"""


def lowered(text: Column) -> Column:
    return F.translate(text, UPPER, LOWER)


def op13_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    docs = read(spark, folder, "documents", "doc_id", "source", "lang", "n_chars", "text")
    values = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    changed = F.when(hit, merkle.leaf(*values, lowered(F.col("text"))))
    found = merkle.manifest(docs, "doc_id", "source", [*values, F.col("text")], {"changed": changed})
    folded = merkle.folded(F.coalesce("changed", "leaf"), F.col("path"))
    found = found.select("doc_id", "leaf", "subroot", "root", F.sha2(merkle.siblings(F.col("path")), 256).alias("proof_sha256"), folded.alias("folded_root"))
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))


def _op13_sql() -> str:
    """Trees of up to eight levels, each level a grouping of the one below; a document's way up, level by level."""
    value = lambda c: f"CASE WHEN {c} IS NULL THEN '-' ELSE strlen({c}::VARCHAR)::VARCHAR || ':' || {c}::VARCHAR END"
    row = lambda text: "sha256(" + " || ".join(map(value, ["doc_id", "source", "lang", "n_chars", text])) + ")"
    steps = "list_concat([4294967295::BIGINT], flatten(list_transform(string_split(doc_id::VARCHAR, ''), lambda c: [unicode(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])))"
    crc = f"xor(list_reduce({steps}, lambda c, e: CASE WHEN e >= 0 THEN xor(c, e) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295::BIGINT)"
    w = merkle.WIDTH
    sql = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, {row("text")} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc} % 5 = 0 THEN {row(f"translate(text, '{UPPER}', '{LOWER}')")} END AS changed FROM documents),
s0 AS (SELECT r, doc_id, leaf, coalesce(changed, leaf) AS fold, '' AS proof, leaf AS own, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS k FROM d)"""

    def climb(prefix: str, nodes: str, rows: str, count: int) -> tuple[str, str, str]:
        out = f",\n{prefix}n0 AS ({nodes}),\n{prefix}d0 AS ({rows})"
        for i in range(count):
            n, d = f"{prefix}n{i}", f"{prefix}d{i}"
            out += f""",
{prefix}n{i + 1} AS (SELECT tree, k // {w} AS k, sha256(string_agg(h, '' ORDER BY k)) AS h FROM {n} WHERE tree IN (SELECT tree FROM {n} GROUP BY tree HAVING count(*) > 1) GROUP BY ALL),
{prefix}b{i} AS (SELECT a.r, string_agg(n.h, '' ORDER BY n.k) FILTER (n.k < a.pos) AS lft, string_agg(n.h, '' ORDER BY n.k) FILTER (n.k > a.pos) AS rgt, any_value(up.h) AS up
  FROM {d} a JOIN {n} n ON n.tree = a.tree AND n.k // {w} = a.pos // {w} JOIN {prefix}n{i + 1} up ON up.tree = a.tree AND up.k = a.pos // {w} GROUP BY a.r),
{prefix}d{i + 1} AS (SELECT a.* EXCLUDE (pos, fold, proof, own), a.pos // {w} AS pos, CASE WHEN b.r IS NULL THEN fold ELSE sha256(coalesce(lft, '') || fold || coalesce(rgt, '')) END AS fold, proof || coalesce(lft, '') || coalesce(rgt, '') AS proof, coalesce(b.up, own) AS own FROM {d} a LEFT JOIN {prefix}b{i} b USING (r))"""
        return out, f"{prefix}n{count}", f"{prefix}d{count}"

    part, _, low = climb("l", "SELECT tree, k, leaf AS h FROM s0", "SELECT *, k AS pos FROM s0", 6)
    sql += part
    sql += f",\nsub AS (SELECT tree, any_value(own) AS h FROM {low} GROUP BY tree)"
    part, _, high = climb("t", "SELECT 0 AS tree, tree AS k, h FROM sub", f"SELECT r, doc_id, leaf, own AS subroot, fold, proof, own, 0 AS tree, tree AS pos FROM {low}", 4)
    sql += part
    return sql + f"\nSELECT doc_id, leaf, subroot, own AS root, sha256(proof) AS proof_sha256, fold AS folded_root, fold = own AS verified FROM {high}"


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_url_filter": op1_url_filter,
    "op2_toxicity": op2_toxicity,
    "op3_quality": op3_quality,
    "op4_secrets": op4_secrets,
    "op5_pii": op5_pii,
    "op6_language_id": op6_language_id,
    "op7_fingerprints": op7_fingerprints,
    "op8_simhash": op8_simhash,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_line_dedup": op11_line_dedup,
    "op12_lexical_search": op12_lexical_search,
    "op13_merkle_manifest": op13_merkle_manifest,
    "pipeline": corpus_pipeline.run,
}
ORACLES: dict[str, str] = {"op1_url_filter": OP1, "op4_secrets": _op4_sql(), "op10_decontamination": OP10, "op11_line_dedup": OP11, "op12_lexical_search": OP12, "op13_merkle_manifest": _op13_sql()}
