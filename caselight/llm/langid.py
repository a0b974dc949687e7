"""Language identification by compression.

A language is learned as a zstandard raw-content dictionary made of the commonest words of some of its texts. A text,
reduced to lower-case words, is compressed with each dictionary, in blocks, and gets the language that makes it smallest.
"""

from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied, cached, shares

#: Sampled texts per language and characters taken of each, for learning.
TEXTS, CHARS = 200, 4096
#: Bytes of a dictionary.
DICTIONARY = 32768
#: A text is compressed in blocks of this many bytes, so that its own repeats do not hide the dictionary's help.
BLOCK = 4096
#: A text is accepted if the second smallest result is larger than the smallest by this share.
MARGIN = 0.002
#: Turns compressed bytes per byte of text into a probability.
SHARPNESS = 60.0
UNKNOWN = "und"

#: Keeps ASCII letters and all bytes of other characters; the rest becomes a space.
_WORDS = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))
#: Ends each dictionary and each block: its one long match makes a short block worth compressing, so that sizes differ.
_TAIL = b" " + hashlib.sha512(b"tail").hexdigest().encode() * 2
RESULT = "struct<lang:string,score:double,margin:double,accepted:boolean>"


def reduced(text: str) -> bytes:
    """Lower-case words of a text, separated by one space."""
    return b" ".join(text.lower().encode().translate(_WORDS).split())


def learn(labelled: DataFrame, text: str = "text", lang: str = "lang", texts: int = TEXTS, chars: int = CHARS) -> dict[str, bytes]:
    """Dictionary bytes per language from about ``texts`` distinct texts of each.

    The sample takes the texts with the smallest hashes, at the share that gives ``texts`` per language, and of a
    text ``chars`` characters from a place that its hash chooses. Rows with a null text or language are left out.
    What reaches the driver is bounded by languages x texts x chars. The commonest words stand last, where
    references to them are short.
    """
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null and t != ''")
    rows = rows.withColumn("h", F.xxhash64("t")).withColumn("s", shares([F.lit(7), F.col("t")]))
    counts = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return {}
    limit = F.create_map(*[F.lit(x) for k, n in sorted(counts.items()) for x in (k, min(1.0, texts / max(1, n)))])
    start = 1 + F.pmod("h", F.greatest(F.length("t") - chars, F.lit(0)) + 1).cast("int")
    picked = rows.where(F.col("s") < limit[F.col("l")]).groupBy("l", "h").agg(F.min(F.substring("t", start, F.lit(chars))).alias("t"))
    words: dict[str, Counter] = {k: Counter() for k in counts}
    for r in picked.toLocalIterator():
        words[r["l"]].update(reduced(r["t"]).split())
    return {k: dictionary(v) for k, v in sorted(words.items()) if v}


def dictionary(words: Counter, size: int = DICTIONARY) -> bytes:
    """The commonest words that fit into ``size`` bytes, rarest first."""
    ranked, used = [], 0
    for word, _ in sorted(words.items(), key=lambda x: (-x[1], x[0])):
        used += len(word) + 1
        if used > size:
            break
        ranked.append(word)
    return b" ".join(reversed(ranked)) + _TAIL


def compressors(model: dict[str, bytes]):
    import zstandard as z

    how = z.ZstdCompressionParameters(window_log=17, chain_log=15, hash_log=15, search_log=2, min_match=3, target_length=16, strategy=z.STRATEGY_GREEDY)
    return [z.ZstdCompressor(dict_data=z.ZstdCompressionDict(raw, dict_type=z.DICT_TYPE_RAWCONTENT), compression_params=how) for raw in model.values()]


def classify(text: str | None, names: list[str], tools: list, margin: float = MARGIN) -> tuple[str, float, float, bool]:
    """Language, score, margin and acceptance of one text."""
    if not text or not tools or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0, 0.0, False
    raw = reduced(text)
    blocks = [raw[i : i + BLOCK] + _TAIL for i in range(0, len(raw), BLOCK)]
    sizes = np.array([sum(len(c.compress(b)) for b in blocks) for c in tools], float)
    best = int(sizes.argmin())
    weights = np.exp(-(sizes - sizes[best]) / len(raw) * SHARPNESS)
    gap = float(np.delete(sizes, best).min() / sizes[best] - 1) if len(sizes) > 1 else 1.0
    return names[best], float(1 / weights.sum()), gap, gap >= margin


def identify(docs: DataFrame, model: dict[str, bytes], text: str = "text", column: str = "language", margin: float = MARGIN) -> DataFrame:
    """Add a struct ``column`` with lang, score (0 to 1), margin and accepted.

    Every whole text is compressed, in blocks, with every dictionary. Texts that are null, empty or without a letter (Unicode category L)
    get ``und``, score 0 and are not accepted; so does every text if nothing was learned. Ties between languages go
    to the first in alphabetical order and, as their margin is 0, are not accepted. Other columns stay as they are; a column
    named like ``column`` is replaced.
    """
    names, sent = list(model), docs.sparkSession.sparkContext.broadcast(model)
    key = hashlib.sha256(b"".join(k.encode() + v for k, v in model.items())).hexdigest()

    def score(texts: pa.Array) -> pa.Array:
        tools = cached(("langid", key), lambda: compressors(sent.value))
        rows = [classify(t, names, tools, margin) for t in texts.to_pylist()]
        kinds = (pa.string(), pa.float64(), pa.float64(), pa.bool_())
        return pa.StructArray.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["lang", "score", "margin", "accepted"])

    return docs.withColumn(column, applied(docs, score, RESULT, text))
