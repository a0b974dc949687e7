"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text are dealt to bins. Each feature has a table with a value for each bin, learned by boosting shallow trees on
one feature after the other; the pairs of features that explain most of what is left get tables of two dimensions in
the same way. A score is a sum of table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied, buffers, slabs, span_hashes, word_spans
from caselight.llm.training import labelled, sample, texts_of

#: Labelled documents that the model is fitted to, at most.
TRAIN = 20000
BINS, PAIR_BINS, PAIRS = 32, 8, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.1, 4
#: A leaf's value is its gradient over its weight plus this.
SHRINK = 2.0
SLAB = 1 << 20

FEATURES = (
    "log_words", "word_length", "letter_share", "upper_share", "digit_share", "punctuation_share", "symbol_share", "pipe_share", "exclamation_share",
    "other_byte_share", "stops_per_word", "words_per_line", "distinct_words", "commonest_word", "repeated_lines", "byte_entropy", "space_share", "longest_word",
)

_SPACES = [32, *range(9, 14)]
_WORD = np.ones(256, bool)
_WORD[_SPACES] = False
_LINE = np.ones(256, bool)
_LINE[[10, 13]] = False


def _indicator(codes) -> np.ndarray:
    out = np.zeros(256)
    out[list(codes)] = 1
    return out


_CLASSES = np.stack(
    [
        _indicator(_SPACES), _indicator([*range(65, 91), *range(97, 123), *range(128, 256)]), _indicator(range(65, 91)), _indicator([*range(65, 91), *range(97, 123)]),
        _indicator(range(48, 58)), _indicator(b".,;:'\"()-"), _indicator(b"#$%&*@+=<>[]{}\\^_`~/"), _indicator(b"|"), _indicator(b"!?"),
        _indicator(range(128, 256)), _indicator(b".!?"),
    ],
    axis=1,
)


def _repeats(key: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each document's keys: how many, how many different, how often the commonest."""
    total = np.bincount(doc, minlength=n)
    if not len(key):
        return total, total.copy(), total.copy()
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (d[1:] != d[:-1])))
    runs = np.diff(np.append(new, len(k)))
    most = np.zeros(n, np.int64)
    np.maximum.at(most, d[new], runs)
    return total, np.bincount(d[new], minlength=n), most


def features(texts: pa.Array) -> np.ndarray:
    """A row of features for every whole text; null and empty texts have zeros."""
    raw, offsets = buffers(texts)
    out = np.zeros((len(texts), len(FEATURES)))
    for a, b in slabs(offsets, SLAB):
        out[a:b] = _features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
    return out


def _features(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    n, size = len(off) - 1, np.diff(off)
    owner = np.repeat(np.arange(n), size)
    counts = np.bincount(owner * 256 + raw, minlength=n * 256).reshape(n, 256)
    space, letter, upper, ascii_letter, digit, punctuation, symbol, pipe, exclamation, other, stops = (counts @ _CLASSES).T
    start, stop, doc = word_spans(raw, off, _WORD)
    words, different, most = _repeats(span_hashes(raw, start, stop), doc, n)
    longest = np.zeros(n)
    np.maximum.at(longest, doc, (stop - start).astype(float))
    begin, end, line_doc = word_spans(raw, off, _LINE)
    lines, different_lines, _ = _repeats(span_hashes(raw, begin, end), line_doc, n)
    solid = np.maximum(size - space, 1)
    share = counts / np.maximum(size, 1)[:, None]
    entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(1)
    w, ln = np.maximum(words, 1), np.maximum(lines, 1)
    return np.stack(
        [
            np.log1p(words), solid * (words > 0) / w, letter / solid, upper / np.maximum(ascii_letter, 1), digit / solid, punctuation / solid, symbol / solid, pipe / solid,
            exclamation / solid, other / solid, stops / w, np.log1p(words / ln), np.log(np.maximum(different, 1)) / np.log(np.maximum(words, 2)), most / w,
            (lines - different_lines) / ln, entropy, space / np.maximum(size, 1), np.log1p(longest),
        ],
        axis=1,
    )


# ---------------------------------------------------------------- fitting

def _leaf_split(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, int]:
    """Gain and place of the best cut of consecutive bins in two."""
    g, w = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
    if not len(g):
        return 0.0, 0
    total_g, total_w = gradient.sum(), weight.sum()
    gain = g**2 / (w + SHRINK) + (total_g - g) ** 2 / (total_w - w + SHRINK) - total_g**2 / (total_w + SHRINK)
    best = int(gain.argmax())
    return float(gain[best]), best + 1


def tree(gradient: np.ndarray, weight: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Values for consecutive bins of a shallow tree: the leaf whose cut gains most is cut, until there are enough."""
    parts = [(0, len(gradient))]
    while len(parts) < leaves:
        cuts = [(*_leaf_split(gradient[a:b], weight[a:b]), a, b) for a, b in parts]
        gain, at, a, b = max(cuts, key=lambda c: c[0])
        if gain <= 1e-9:
            break
        parts.remove((a, b))
        parts += [(a, a + at), (a + at, b)]
    out = np.zeros(len(gradient))
    for a, b in parts:
        out[a:b] = gradient[a:b].sum() / (weight[a:b].sum() + SHRINK)
    return out


def pair_tree(gradient: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, float]:
    """Values and gain of a tree on a square of bins: a cut of one feature and then, on each side, of the other; the better order."""
    best, gain = np.zeros_like(gradient), -1.0
    for flip in (False, True):
        g, w = (gradient.T, weight.T) if flip else (gradient, weight)
        for at in range(1, len(g)):
            values, won = np.zeros_like(g), 0.0
            for rows in (slice(0, at), slice(at, len(g))):
                side_g, side_w = g[rows].sum(0), w[rows].sum(0)
                line = tree(side_g, side_w, 2)
                values[rows] = line
                won += float((2 * side_g * line - (side_w + SHRINK / len(line)) * line**2).sum())
            if won > gain:
                best, gain = (values.T if flip else values), won
    return best, gain


def fit(x: np.ndarray, y: np.ndarray) -> dict:
    """Bin edges, tables and pair tables. Without both labels every text gets the mean label, or one half without any."""
    n, many = len(y), x.shape[1]
    mean = float(np.clip((y.sum() + 0.5) / (n + 1), 1e-4, 1 - 1e-4))
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(many)]
    coarse = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, PAIR_BINS + 1)[1:-1])) if n else np.zeros(0) for j in range(many)]
    model = {"intercept": float(np.log(mean / (1 - mean))), "edges": edges, "coarse": coarse, "tables": [np.zeros(len(e) + 1) for e in edges], "pairs": []}
    if not n or y.min() == y.max():
        return model
    bins = [np.searchsorted(edges[j], x[:, j], "right") for j in range(many)]
    small = [np.searchsorted(coarse[j], x[:, j], "right") for j in range(many)]
    score = np.full(n, model["intercept"])

    def residual():
        p = 1 / (1 + np.exp(-score))
        return y - p, np.maximum(p * (1 - p), 1e-4)

    for _ in range(ROUNDS):
        for j in range(many):  # one feature after the other, so that none takes what others explain as well
            r, h = residual()
            size = len(model["tables"][j])
            step = RATE * tree(np.bincount(bins[j], r, size), np.bincount(bins[j], h, size))
            model["tables"][j] += step
            score += step[bins[j]]
    r, h = residual()
    found = []
    for i in range(many):
        for j in range(i):
            square = (len(coarse[i]) + 1, len(coarse[j]) + 1)
            cell = small[i] * square[1] + small[j]
            g, w = (np.bincount(cell, v, square[0] * square[1]).reshape(square) for v in (r, h))
            found.append((pair_tree(g, w)[1], i, j))
    chosen = [(i, j, np.zeros((len(coarse[i]) + 1, len(coarse[j]) + 1))) for gain, i, j in sorted(found, key=lambda f: (-f[0], f[1:]))[:PAIRS] if gain > 0]
    for _ in range(PAIR_ROUNDS):
        for i, j, table in chosen:
            r, h = residual()
            cell = small[i] * table.shape[1] + small[j]
            g, w = (np.bincount(cell, v, table.size).reshape(table.shape) for v in (r, h))
            step = RATE * pair_tree(g, w)[0]
            table += step
            score += step[small[i], small[j]]
    model["pairs"] = chosen
    return model


def predict(model: dict, x: np.ndarray) -> np.ndarray:
    """Probability of label 1 for rows of features."""
    score = np.full(len(x), model["intercept"])
    for j, (edges, table) in enumerate(zip(model["edges"], model["tables"])):
        score += table[np.searchsorted(edges, x[:, j], "right")]
    for i, j, table in model["pairs"]:
        score += table[np.searchsorted(model["coarse"][i], x[:, i], "right"), np.searchsorted(model["coarse"][j], x[:, j], "right")]
    return 1 / (1 + np.exp(-score))


# ---------------------------------------------------------------- Spark

def learn(docs: DataFrame, labels: DataFrame, keep, label: str = "quality", id: str = "doc_id", text: str = "text", most: int = TRAIN) -> dict:
    """Fit to at most ``most`` labelled documents that ``keep`` (a condition on labels) admits; the sample is taken by hashes of ids.

    Features are computed where the documents are; what reaches the driver is one row of numbers per sampled document.
    """
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(list(features(texts)), pa.list_(pa.float64()))

    chosen = sample(labelled(labels, keep, label, id), most)
    rows = texts_of(docs, chosen, F.coalesce(F.col(text), F.lit("")).alias("text"), id=id)
    table = rows.select("id", "y", applied(rows, run, "array<double>", "text").alias("x")).orderBy("id").toArrow()
    x = np.array(table.column("x").to_pylist(), float).reshape(-1, len(FEATURES))
    return fit(x, table.column("y").to_numpy())


def score(docs: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """Add the probability that a whole text has label 1.

    Null and empty texts are scored by features of zero. Equal texts have equal scores, whatever their other columns. A column
    named like ``column`` is replaced, others stay; an empty table stays empty.
    """
    def run(texts: pa.Array) -> pa.Array:
        return pa.array(predict(model, features(texts)))

    return docs.withColumn(column, applied(docs, run, "double", text))
