"""Language identification by a bidirectional gated recurrent network over bytes.

Both directions read windows of ``WINDOW`` bytes of the UTF-8 text with ``UNITS`` units each:

    a = X[byte] + U h      z = (1 + s(a_z)) / 2      c = s(a_c)      h' = h + z (c - h)      s(x) = x / (1 + |x|)

Every position gets a probability of each language from both states there; a document's probabilities are
the means over all its positions. Windows start with empty states, so any text is a set of independent
windows, of which a bounded number is in memory. The network is trained in numpy by backpropagation through
time (``train``) on a bounded sample: at most about ``SAMPLE_DOCS`` documents of each language, drawn by a
hash of doc_id, and at most ``SAMPLE_WINDOWS`` windows of each; a text shorter than a window is a padded one. Each window counts
the same. Every text is then labelled whole.

Nulls: a null text, and one without a letter, is ``und`` with score 0; rows with a null lang or doc_id are not
learned from. Ties between languages go to the first in alphabetical order. Repeated rows count as often
as they come. Other columns are ignored. Without any labelled row of a text that isn't empty every text is ``und``.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNKNOWN = "und"
WINDOW = 128
UNITS = 8
SAMPLE_DOCS = 600
SAMPLE_WINDOWS = 6
#: Steps of training, of ``_BATCH`` windows each; as many for any size of the sample.
STEPS = 240
_BATCH = 256
_AT_ONCE = 1_024
_LETTER = re.compile(r"[^\W\d_]")


@dataclass
class Network:
    """``inputs`` (2, 2 * UNITS, 256), ``recurrent`` (2, 2 * UNITS, UNITS), ``output`` (languages, 2 * UNITS), ``bias``."""

    languages: list[str]
    inputs: np.ndarray
    recurrent: np.ndarray
    output: np.ndarray
    bias: np.ndarray


def _states(inputs: np.ndarray, recurrent: np.ndarray, data: np.ndarray, mask: np.ndarray | None) -> np.ndarray:
    """States (time, unit, window) of one direction over ``data`` (time, window); masked steps leave none."""
    steps, n = data.shape
    units = recurrent.shape[1]
    out = np.empty((steps, units, n), np.float32)
    a, x = np.empty((2 * units, n), np.float32), np.empty((2 * units, n), np.float32)
    h = np.zeros((units, n), np.float32)
    for t in range(steps):
        np.matmul(recurrent, h, out=a)
        inputs.take(data[t], axis=1, out=x, mode="clip")
        a += x
        np.abs(a, out=x)
        x += 1
        a /= x
        z, c = a[:units], a[units:]
        z *= 0.5
        z += 0.5
        c -= h
        c *= z
        h = np.add(h, c, out=out[t])
        if mask is not None:
            h *= mask[t]
    return out


def _probabilities(net: Network, data: np.ndarray, mask: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each position (time, language, window), with the states of both directions."""
    forward = _states(net.inputs[0], net.recurrent[0], data, mask)
    backward = _states(net.inputs[1], net.recurrent[1], data[::-1], None if mask is None else mask[::-1])[::-1]
    units = net.recurrent.shape[2]
    p = np.matmul(net.output[:, :units], forward)
    p += np.matmul(net.output[:, units:], backward)
    p += net.bias[:, None]
    p -= p.max(axis=1, keepdims=True)
    np.exp(p, out=p)
    p /= p.sum(axis=1, keepdims=True)
    return p, forward, backward


def _gradients(
    inputs: np.ndarray,
    recurrent: np.ndarray,
    data: np.ndarray,
    states: np.ndarray,
    d_states: np.ndarray,
    mask: np.ndarray | None,
) -> tuple[np.ndarray, np.ndarray]:
    """Backpropagation through time of one direction: gradients of ``inputs`` and ``recurrent``."""
    steps, units, n = states.shape
    d_a = np.empty((steps, 2 * units, n), np.float32)
    d_recurrent = np.zeros_like(recurrent)
    d_h = np.zeros((units, n), np.float32)
    for t in range(steps - 1, -1, -1):
        before = states[t - 1] if t else np.zeros((units, n), np.float32)
        a = recurrent @ before + inputs[:, data[t]]
        a /= 1 + np.abs(a)
        gate, c = a[:units], a[units:]
        z = 0.5 + 0.5 * gate
        d_h = d_h + d_states[t]
        if mask is not None:
            d_h *= mask[t]
        d_a[t, :units] = d_h * (c - before) * 0.5 * (1 - np.abs(gate)) ** 2
        d_a[t, units:] = d_h * z * (1 - np.abs(c)) ** 2
        d_recurrent += d_a[t] @ before.T
        d_h = d_h * (1 - z) + recurrent.T @ d_a[t]
    flat = data.ravel()
    d_inputs = np.stack([np.bincount(flat, d_a[:, k].ravel(), 256) for k in range(2 * units)])
    return d_inputs.astype(np.float32), d_recurrent


def loss_and_gradients(
    net: Network, data: np.ndarray, target: np.ndarray, mask: np.ndarray | None = None
) -> tuple[float, list[np.ndarray]]:
    """Mean over windows of the mean cross entropy at positions of ``data`` (time, window), and gradients of the four arrays.

    Positions where ``mask`` is 0 count nowhere.
    """
    p, forward, backward = _probabilities(net, data, mask)
    units, rows = net.recurrent.shape[2], np.arange(data.shape[1])
    losses = -np.log(np.maximum(p[:, target, rows], 1e-12))
    p[:, target, rows] -= 1
    if mask is None:
        loss = float(losses.mean())
        p /= p.shape[0] * p.shape[2]
    else:
        share = mask / (mask.sum(axis=0) * p.shape[2])
        loss = float((losses * share).sum())
        p *= share[:, None]
    both = np.concatenate([forward, backward], axis=1)
    d_output = np.einsum("tlw,tuw->lu", p, both, optimize=True)
    d_both = np.matmul(net.output.T, p)
    f = _gradients(net.inputs[0], net.recurrent[0], data, forward, d_both[:, :units], mask)
    b = _gradients(net.inputs[1], net.recurrent[1], data[::-1], backward[::-1], d_both[::-1, units:], None if mask is None else mask[::-1])
    return loss, [np.stack([f[0], b[0]]), np.stack([f[1], b[1]]), d_output, p.sum(axis=(0, 2))]


def train(
    windows: np.ndarray,
    target: np.ndarray,
    languages: list[str],
    steps: int = STEPS,
    seed: int = 7,
    sizes: np.ndarray | None = None,
) -> Network:
    """A network from ``windows`` (n, WINDOW) of bytes and the index of each window's language.

    ``sizes`` are the numbers of bytes that belong to texts, from the start of each window on; None if all do.
    """
    rng = np.random.default_rng(seed)
    scale = lambda *shape: (rng.standard_normal(shape) * 0.3).astype(np.float32)
    net = Network(
        languages,
        scale(2, 2 * UNITS, 256),
        scale(2, 2 * UNITS, UNITS),
        scale(len(languages), 2 * UNITS),
        np.zeros(len(languages), np.float32),
    )
    arrays = [net.inputs, net.recurrent, net.output, net.bias]
    mean, square, step = [np.zeros_like(a) for a in arrays], [np.zeros_like(a) for a in arrays], 0
    order = np.empty(0, np.int64)
    while step < steps:
        while len(order) < min(_BATCH, len(windows)):
            order = np.concatenate([order, rng.permutation(len(windows))])
        chosen, order = order[:_BATCH], order[_BATCH:]
        data = np.ascontiguousarray(windows[chosen].T).astype(np.intp)
        mask = None
        if sizes is not None and sizes[chosen].min() < data.shape[0]:
            mask = (np.arange(data.shape[0])[:, None] < sizes[chosen]).astype(np.float32)
        _, gradients = loss_and_gradients(net, data, target[chosen], mask)
        step += 1
        rate = 0.03 * (1 - 0.9 * step / steps)
        for a, g, m, v in zip(arrays, gradients, mean, square, strict=True):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            a -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-7)
    return net


def document_probabilities(net: Network, texts: list[str | None]) -> np.ndarray:
    """Mean of the probabilities at all positions, by text and language; zeros for an empty text."""
    sums = np.zeros((len(texts), len(net.languages)))
    sizes = np.zeros(len(texts))
    held: list[np.ndarray] = []
    owners: list[np.ndarray] = []
    rests: list[tuple[int, np.ndarray]] = []
    waiting = 0

    def flush() -> None:
        nonlocal waiting
        if held:
            windows, owner = np.concatenate(held), np.concatenate(owners)
            for at in range(0, len(windows), _AT_ONCE):
                data = np.ascontiguousarray(windows[at : at + _AT_ONCE].T).astype(np.intp)
                np.add.at(sums, owner[at : at + _AT_ONCE], _probabilities(net, data, None)[0].sum(axis=0).T)
            held.clear()
            owners.clear()
        waiting = 0

    for i, text in enumerate(texts):
        data = np.frombuffer((text or "").encode("utf-8", "replace"), np.uint8)
        sizes[i] = len(data)
        full = len(data) // WINDOW
        for at in range(0, full, _AT_ONCE):
            part = data[at * WINDOW : min(full, at + _AT_ONCE) * WINDOW].reshape(-1, WINDOW)
            held.append(part)
            owners.append(np.full(len(part), i))
            waiting += len(part)
            if waiting >= 4 * _AT_ONCE:
                flush()
        if len(data) % WINDOW:
            rests.append((i, data[full * WINDOW :]))
    flush()
    for at in range(0, len(rests), _AT_ONCE):
        part = rests[at : at + _AT_ONCE]
        data, mask = np.zeros((WINDOW, len(part)), np.intp), np.zeros((WINDOW, len(part)), np.float32)
        for k, (_, rest) in enumerate(part):
            data[: len(rest), k] = rest
            mask[: len(rest), k] = 1
        p = _probabilities(net, data, mask)[0] * mask[:, None, :]
        np.add.at(sums, [i for i, _ in part], p.sum(axis=0).T)
    return sums / np.maximum(sizes, 1)[:, None]


def _label(net: Network | None, column: pa.Array) -> tuple[list[str], list[float]]:
    """Language and score of each text; a few hundred texts at a time keep the memory of long ones low."""
    languages, scores = [], []
    for at in range(0, len(column), 256):
        texts = column.slice(at, 256).to_pylist()
        known = [bool(net and t and _LETTER.search(t)) for t in texts]
        if net is not None:
            p = document_probabilities(net, [t if k else None for t, k in zip(texts, known, strict=True)])
            best = p.argmax(axis=1)
        for i, k in enumerate(known):
            languages.append(net.languages[best[i]] if k else UNKNOWN)
            scores.append(min(1.0, float(p[i, best[i]])) if k else 0.0)
    return languages, scores


def _predict(net: Network | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            languages, scores = _label(net, batch.column("text"))
            columns = [batch.column("doc_id"), pa.array(languages, pa.string()), pa.array(scores, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "lang_pred", "score"])

    return run


def held_out() -> Column:
    """The rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def _sample_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        languages, windows = [], []
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text"), strict=True):
            data = text.as_py().encode("utf-8", "replace")
            # Spread over the text, the last one at its end.
            starts = np.linspace(0, max(0, len(data) - WINDOW), SAMPLE_WINDOWS).astype(int)
            for start in sorted(set(starts.tolist())) if data else []:
                languages.append(lang)
                windows.append(data[start : start + WINDOW])
        yield pa.RecordBatch.from_arrays([pa.array(languages, pa.string()), pa.array(windows, pa.binary())], ["lang", "bytes"])


def fit(labelled: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Network | None:
    """Train on a bounded sample of ``labelled`` (doc_id, text, lang)."""
    usable = labelled.filter("lang is not null and doc_id is not null and text is not null").select("doc_id", "lang", "text")
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not counts:
        return None
    # A language with few documents gives all, others a share by a hash of doc_id.
    share = F.lit(0)
    for lang, n in counts.items():
        share = F.when(F.col("lang") == lang, min(1_000_000, -(-sample_docs * 1_000_000 // n))).otherwise(share)
    chosen = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("language sample")), F.lit(1_000_000)) < share)
    rows = chosen.mapInArrow(_sample_windows, "lang string, bytes binary").collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    rows.sort(key=lambda r: (r["lang"], bytes(r["bytes"])))  # the order of partitions must not matter
    sizes = np.array([len(r["bytes"]) for r in rows])
    windows = np.frombuffer(b"".join(bytes(r["bytes"]).ljust(WINDOW, b"\0") for r in rows), np.uint8).reshape(-1, WINDOW)
    index = {lang: i for i, lang in enumerate(languages)}
    return train(windows, np.array([index[r["lang"]] for r in rows]), languages, sizes=sizes)


def identify(documents: DataFrame, net: Network | None) -> DataFrame:
    """doc_id with lang_pred and score of every whole text."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_predict(net), f"doc_id {kind}, lang_pred string, score double")


def keep_documents(documents: DataFrame, net: Network | None, least_score: float) -> DataFrame:
    """The rows of ``documents`` (text, ...) in a learned language with at least this score; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = zip(*_label(net, batch.column("text")), strict=True)
            yield batch.filter(pa.array([lang != UNKNOWN and s >= least_score for lang, s in found], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
