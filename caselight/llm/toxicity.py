"""Toxicity: a bidirectional gated recurrent network with attention pooling over words and their characters.

A word's input is an embedding of the word and the sum of embeddings of its character sequences. Two gated recurrent
units read a window of words in either direction, attention weighs their states, and the pooled state gives the window's
logit. A text is cut into overlapping windows that cover all of it; its score follows from its worst window.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from caselight.llm.common import applied, buffers, cached, slabs, span_hashes, word_spans
from caselight.llm.training import labelled, sample, texts_of

#: Words of a window, words between the windows of a text, and between those that the network is fitted to.
WINDOW, STRIDE, FIT_STRIDE = 32, 8, 24
BUCKETS, HIDDEN, WORD_SIZE, GRAM_SIZE = 1 << 15, 8, 8, 8
#: Labelled documents of each label that the model is fitted to, at most, and characters that such a document may have.
TRAIN, TRAIN_CHARS = 3000, 12000
EPOCHS, BATCH, STEP = 8, 256, 0.01
SLAB, CHUNK = 1 << 18, 1024

_INSIDE = np.zeros(256, bool)
_INSIDE[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[65:91] += 32


# ---------------------------------------------------------------- inputs

def inputs(raw: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """Words of several documents: bucket of the word, buckets of its character sequences (flat, with offsets), document.

    The sequences are all runs of four bytes, or the whole of a shorter word, and the first five bytes marked as a beginning.
    """
    start, stop, doc = word_spans(raw, offsets, _INSIDE)
    length = stop - start
    low = np.concatenate([_FOLD[raw], np.zeros(5, np.uint32)])
    four = low[:-4] | low[1:-3] << 8 | low[2:-2] << 16 | low[3:-1] << 24
    n = np.maximum(length - 3, 1)
    offset = np.concatenate([[0], np.cumsum(n + 1)])
    flat = np.arange(offset[-1]) - np.repeat(offset[:-1], n + 1)
    head = flat == 0
    code = four[np.repeat(start, n + 1) + np.maximum(flat - 1, 0)]
    short = length < 4
    if short.any():  # bytes beyond a short word's end do not count
        mask = np.where(short, (np.uint32(1) << (np.minimum(length, 3) * 8).astype(np.uint32)) - np.uint32(1), np.uint32(0xFFFFFFFF))
        code = code & np.repeat(mask, n + 1)
    fifth = np.where(length > 4, low[np.minimum(start + 4, len(low) - 1)], np.uint32(0)).astype(np.uint32)
    code[head] = code[head] * np.uint32(31) + fifth + np.uint32(0x5BD1E995)
    grams = (code * np.uint32(2654435761)) >> np.uint32(17)
    word = (span_hashes(raw, start, stop) >> np.uint64(49)).astype(np.int64) if len(start) else np.zeros(0, np.int64)
    return {"word": word.astype(np.uint16), "grams": grams.astype(np.uint16), "offset": offset, "doc": doc}


def joined(texts: pa.Array) -> dict[str, np.ndarray]:
    """Inputs of all texts in one table, made slab by slab."""
    raw, offsets = buffers(texts)
    parts = [(a, inputs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in slabs(offsets, SLAB)]
    if not parts:
        return inputs(raw, offsets)
    sizes = np.concatenate([np.diff(w["offset"]) for _, w in parts])
    return {
        "word": np.concatenate([w["word"] for _, w in parts]), "grams": np.concatenate([w["grams"] for _, w in parts]),
        "offset": np.concatenate([[0], np.cumsum(sizes)]), "doc": np.concatenate([w["doc"] + a for a, w in parts]),
    }


def windows(doc: np.ndarray, n: int, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, end word and document of windows that cover every word of each document, overlapping by window - stride words."""
    words = np.bincount(doc, minlength=n)
    base = np.cumsum(words) - words
    many = np.where(words > 0, np.maximum(-(-(words - window) // stride), 0) + 1, 0)
    owner = np.repeat(np.arange(n), many)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
    first = base[owner] + number * stride
    return first, np.minimum(first + window, base[owner] + words[owner]), owner


def embedded(model: dict, word: np.ndarray, grams: np.ndarray, offset: np.ndarray) -> np.ndarray:
    """Input rows of words."""
    if not len(word):
        return np.zeros((0, WORD_SIZE + GRAM_SIZE), np.float32)
    return np.concatenate([model["words"][word], np.add.reduceat(model["grams"][grams], offset[:-1], axis=0)], axis=1)


# ---------------------------------------------------------------- network

def initial(seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    size, h = WORD_SIZE + GRAM_SIZE, HIDDEN
    shapes = {
        "words": (BUCKETS, WORD_SIZE, 0.1), "grams": (BUCKETS, GRAM_SIZE, 0.1), "input": (size, 6 * h, 0.4), "input_bias": (6 * h,), "gates_f": (h, 2 * h, 0.3), "state_f": (h, h, 0.3),
        "gates_b": (h, 2 * h, 0.3), "state_b": (h, h, 0.3), "attention": (2 * h, 0.3), "output": (2 * h, 0.3), "output_bias": (1,),
    }
    return {k: (rng.normal(0, s[-1], s[:-1]) if isinstance(s[-1], float) else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}


def _sigmoid(x):
    return 1 / (1 + np.exp(-x))


def _unit(projected, at, mask, gates, state, backward, keep):
    """Run one gated recurrent unit over windows; states per place, and what the gradient needs."""
    many, length = at.shape
    h = np.zeros((many, HIDDEN), projected.dtype)
    states = np.zeros((many, length, HIDDEN), projected.dtype)
    saved = []
    for t in range(length - 1, -1, -1) if backward else range(length):
        p, m = projected[at[:, t]], mask[:, t, None]
        zr = _sigmoid(p[:, : 2 * HIDDEN] + h @ gates)
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        q = h @ state
        n = np.tanh(p[:, 2 * HIDDEN :] + r * q)
        if keep:
            saved.append((t, h, z, r, q, n, m))
        h = np.where(m, n + z * (h - n), h)
        states[:, t] = h
    return states, saved


def forward(model: dict, x: np.ndarray, at: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows; ``at`` (windows x places) points to rows of x, ``mask`` marks the places that are words."""
    projected = x @ model["input"] + model["input_bias"]
    half = 3 * HIDDEN
    f, saved_f = _unit(np.ascontiguousarray(projected[:, :half]), at, mask, model["gates_f"], model["state_f"], False, keep)
    b, saved_b = _unit(np.ascontiguousarray(projected[:, half:]), at, mask, model["gates_b"], model["state_b"], True, keep)
    states = np.concatenate([f, b], axis=2)
    energy = np.where(mask, states @ model["attention"], -1e9)
    weight = np.exp(energy - energy.max(1, keepdims=True))
    weight /= weight.sum(1, keepdims=True)
    pooled = np.einsum("bt,bth->bh", weight, states)
    return pooled @ model["output"] + model["output_bias"][0], (states, weight, pooled, saved_f, saved_b)


def _states(projected: np.ndarray, first: np.ndarray, end: np.ndarray, gates: np.ndarray, state: np.ndarray, backward: bool, out: np.ndarray) -> None:
    """States of one gated recurrent unit over windows, written to ``out`` (places x units x windows)."""
    h = np.zeros((HIDDEN, len(first)), projected.dtype)
    gates, state = np.ascontiguousarray(gates.T), np.ascontiguousarray(state.T)
    ragged = (end - first).min() < len(out)
    for t in range(len(out) - 1, -1, -1) if backward else range(len(out)):
        at = first + t
        p = projected[np.minimum(at, len(projected) - 1)].T
        zr = gates @ h
        zr += p[: 2 * HIDDEN]
        zr = _sigmoid(zr)
        n = state @ h
        n *= zr[HIDDEN:]
        n += p[2 * HIDDEN :]
        np.tanh(n, out=n)
        new = (h - n) * zr[:HIDDEN] + n
        h = np.where(at < end, new, h) if ragged else new
        out[t] = h


def logits(model: dict, projected: np.ndarray, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """What ``forward`` gives for windows of consecutive words, from the words' projected inputs, with windows along the last axis."""
    half = 3 * HIDDEN
    states = np.empty((WINDOW, 2 * HIDDEN, len(first)), projected.dtype)
    _states(projected[:, :half], first, end, model["gates_f"], model["state_f"], False, states[:, :HIDDEN])
    _states(projected[:, half:], first, end, model["gates_b"], model["state_b"], True, states[:, HIDDEN:])
    energy, value = np.moveaxis(np.stack([model["attention"], model["output"]]) @ states, 1, 0)
    energy = np.where(first + np.arange(WINDOW)[:, None] < end, energy, -1e9)
    weight = np.exp(energy - energy.max(0))
    return (weight * value).sum(0) / weight.sum(0) + model["output_bias"][0]


def _unit_gradient(saved, d_states, gates, state):
    d = np.zeros((len(d_states), HIDDEN), d_states.dtype)
    d_gates, d_state = np.zeros_like(gates), np.zeros_like(state)
    d_projected = np.zeros((*d_states.shape[:2], 3 * HIDDEN), d_states.dtype)
    for t, h, z, r, q, n, m in reversed(saved):
        d = d + d_states[:, t]
        new = d * m
        d = d * ~m + new * z
        d_n = new * (1 - z) * (1 - n * n)
        d_q = d_n * r
        d_zr = np.concatenate([new * (h - n) * z * (1 - z), d_n * q * r * (1 - r)], axis=1)
        d += d_zr @ gates.T + d_q @ state.T
        d_gates += h.T @ d_zr
        d_state += h.T @ d_q
        d_projected[:, t] = np.concatenate([d_zr, d_n], axis=1)
    return d_projected, d_gates, d_state


def gradients(model: dict, words: dict, at: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict]:
    """Mean log loss of windows and its gradient by every parameter."""
    x = embedded(model, words["word"], words["grams"], words["offset"])
    logit, (states, weight, pooled, saved_f, saved_b) = forward(model, x, at, mask, True)
    p = _sigmoid(logit)
    loss = float(np.mean(np.logaddexp(0, logit) - y * logit))
    d = ((p - y) / len(y)).astype(x.dtype)
    out = {"output": pooled.T @ d, "output_bias": np.array([d.sum()], x.dtype)}
    d_pooled = d[:, None] * model["output"]
    d_weight = np.einsum("bth,bh->bt", states, d_pooled)
    d_energy = weight * (d_weight - (weight * d_weight).sum(1, keepdims=True))
    out["attention"] = np.einsum("bt,bth->h", d_energy, states)
    d_states = weight[:, :, None] * d_pooled[:, None, :] + d_energy[:, :, None] * model["attention"]
    pf, out["gates_f"], out["state_f"] = _unit_gradient(saved_f, np.ascontiguousarray(d_states[:, :, :HIDDEN]), model["gates_f"], model["state_f"])
    pb, out["gates_b"], out["state_b"] = _unit_gradient(saved_b, np.ascontiguousarray(d_states[:, :, HIDDEN:]), model["gates_b"], model["state_b"])
    d_projected = np.zeros((len(x), 6 * HIDDEN), x.dtype)
    places = at[mask]
    np.add.at(d_projected, places, np.concatenate([pf, pb], axis=2)[mask])
    out["input"], out["input_bias"] = x.T @ d_projected, d_projected.sum(0)
    d_x = d_projected @ model["input"].T
    out["words"], out["grams"] = np.zeros_like(model["words"]), np.zeros_like(model["grams"])
    np.add.at(out["words"], words["word"], d_x[:, :WORD_SIZE])
    np.add.at(out["grams"], words["grams"], np.repeat(d_x[:, WORD_SIZE:], np.diff(words["offset"]), axis=0))
    return loss, out


def window_logits(model: dict, words: dict, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logits of windows of consecutive words."""
    out = np.zeros(len(first), np.float32)
    if not len(first):
        return out
    x = embedded(model, words["word"], words["grams"], words["offset"])
    projected = x @ model["input"] + model["input_bias"]
    order = np.argsort(end - first, kind="stable")  # whole windows, which need no mask, come together
    for a in range(0, len(first), CHUNK):
        pick = order[a : a + CHUNK]
        out[pick] = logits(model, projected, first[pick], end[pick])
    return out


def document_logits(model: dict, texts: pa.Array) -> np.ndarray:
    """The largest window logit of every whole text; a text without words has the logit of no evidence."""
    raw, offsets = buffers(texts)
    out = np.full(len(texts), -20.0)
    for a, b in slabs(offsets, SLAB):
        words = inputs(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
        first, end, owner = windows(words["doc"], b - a)
        np.maximum.at(out[a:b], owner, window_logits(model, words, first, end).astype(float))
    return out


# ---------------------------------------------------------------- fitting

def _picked(words: dict, first: np.ndarray, end: np.ndarray) -> tuple[dict, np.ndarray, np.ndarray]:
    """The words of some windows as a table of their own, and places in it."""
    at = first[:, None] + np.arange(WINDOW)
    mask = at < end[:, None]
    used, place = np.unique(np.where(mask, at, first[:, None]), return_inverse=True)
    start, n = words["offset"][used], np.diff(words["offset"])[used]
    offset = np.concatenate([[0], np.cumsum(n)])
    flat = np.repeat(start - offset[:-1], n) + np.arange(offset[-1])
    return {"word": words["word"][used], "grams": words["grams"][flat], "offset": offset}, place.reshape(at.shape), mask


def _logits(model: dict, words: dict, first: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Logits of many windows, with the inputs of a few thousand at a time in memory."""
    out = np.zeros(len(first), np.float32)
    for a in range(0, len(first), CHUNK):
        table, at, mask = _picked(words, first[a : a + CHUNK], end[a : a + CHUNK])
        out[a : a + CHUNK] = forward(model, embedded(model, table["word"], table["grams"], table["offset"]), at, mask)[0]
    return out


def fit(texts: pa.Array, y: np.ndarray, seed: int = 1) -> dict:
    """Network parameters from labelled texts.

    Which windows make a text toxic is not known. The first epoch takes windows by chance; later ones take, of a toxic text, the windows
    that the network finds worst, and of another text its worst one and some by chance.
    """
    rng = np.random.default_rng(seed)
    model = initial(seed)
    words = joined(texts)
    first, end, owner = windows(words["doc"], len(y), stride=FIT_STRIDE)
    toxic = y[owner] > 0.5
    moment = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in model.items()}
    count = 0
    for epoch in range(EPOCHS if len(first) else 0):
        noise = rng.random(len(first))
        worst = noise if epoch == 0 else -_logits(model, words, first, end)
        rank = _rank(owner, worst)
        chance = _rank(owner, noise)
        chosen = np.flatnonzero(np.where(toxic, rank < (4 if epoch == 0 else 2), (rank < 1) | (chance < 3)))
        rng.shuffle(chosen)
        for a in range(0, len(chosen), BATCH):
            pick = chosen[a : a + BATCH]
            table, at, mask = _picked(words, first[pick], end[pick])
            _, grad = gradients(model, table, at, mask, toxic[pick].astype(np.float32))
            count += 1
            for k, g in grad.items():
                m, v = moment[k]
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                model[k] -= STEP * (m / (1 - 0.9**count)) / (np.sqrt(v / (1 - 0.999**count)) + 1e-6)
    return model


def _rank(owner: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rank of each window among those of its document, smallest value first; ``owner`` is sorted."""
    order = np.lexsort((value, owner))
    out = np.empty(len(owner), np.int64)
    starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1])) if len(owner) else np.zeros(0, int)
    out[order] = np.arange(len(owner)) - np.repeat(starts, np.diff(np.append(starts, len(owner))))
    return out


def calibrate(logit: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and shift that turn logits into log odds, by logistic regression with softened labels."""
    z = np.clip(logit, -20, 20)
    n1, n0 = (weight * y).sum(), (weight * (1 - y)).sum()
    target = np.where(y > 0.5, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    x, w = np.stack([z, np.ones_like(z)], axis=1), np.array([1.0, 0.0])
    for _ in range(50):
        p = _sigmoid(np.clip(x @ w, -30, 30))
        gradient = x.T @ (weight * (p - target)) + np.array([1e-3, 0]) * (w - [1, 0])
        hessian = x.T @ (x * (weight * np.maximum(p * (1 - p), 1e-6))[:, None]) + np.diag([1e-3, 1e-6])
        step = np.linalg.solve(hessian, gradient)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-7:
            break
    return max(float(w[0]), 0.05), float(w[1])


# ---------------------------------------------------------------- Spark

def learn(docs: DataFrame, labels: DataFrame, keep, label: str = "toxic", id: str = "doc_id", text: str = "text", most: int = TRAIN, chars: int = TRAIN_CHARS) -> dict:
    """Fit to at most ``most`` documents of each label, of at most ``chars`` characters, that ``keep`` (a condition on labels) admits.

    The samples are taken by hashes of ids; scores are calibrated to the label's share among all admitted labels. Without both
    labels the network stays as it starts and the score is the mean label.
    """
    marked = labelled(labels, keep, label, id)
    n1, n = marked.agg(F.sum((F.col("y") > 0.5).cast("long")), F.count("*")).first()
    n1, n = n1 or 0, n or 0
    length = F.length(F.col(text))
    parts = [texts_of(docs.where(length <= chars), sample(marked.where(side), most), F.col(text).alias("text"), id=id) for side in ("y > 0.5", "y <= 0.5")]
    table = parts[0].unionByName(parts[1]).orderBy("id").toArrow()
    texts, y = table.column("text").combine_chunks(), (table.column("y").to_numpy() > 0.5).astype(np.float64)
    if not len(y) or y.min() == y.max():
        share = (n1 + 0.5) / (n + 1)
        return {"network": initial(), "slope": 0.0, "shift": float(np.log(share / (1 - share)))}
    network = fit(texts, y)
    weight = np.where(y > 0.5, n1 / max(1, y.sum()), (n - n1) / max(1, (1 - y).sum()))
    slope, shift = calibrate(document_logits(network, texts), y, weight * len(y) / weight.sum())
    return {"network": network, "slope": slope, "shift": shift}


def score(docs: DataFrame, model: dict, text: str = "text", column: str = "score") -> DataFrame:
    """Add the probability that a whole text is toxic.

    Windows of 32 words begin every 8 words, so that a passage of up to 25 words lies whole in one, and all of them are scored, however long the text. Null, empty and wordless texts get the score of no evidence. Equal texts have equal scores. A column named like
    ``column`` is replaced, others stay; an empty table stays empty. The model that is sent to the workers has a fixed size.
    """
    raw = pickle.dumps(model)
    sent, key = docs.sparkSession.sparkContext.broadcast(raw), hashlib.sha256(raw).hexdigest()

    def run(texts: pa.Array) -> pa.Array:
        m = cached(("toxicity", key), lambda: pickle.loads(sent.value))
        return pa.array(_sigmoid(np.clip(m["slope"] * np.clip(document_logits(m["network"], texts), -20, 20) + m["shift"], -40, 40)))

    return docs.withColumn(column, applied(docs, run, "double", text))
