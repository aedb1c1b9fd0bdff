"""Toxicity by a factorization machine over hashed terms.

A document's terms are its distinct words (runs of letters, lower-cased) and their proper prefixes of
``PREFIXES`` letters, hashed to ``2**HASH_BITS`` places. The score of the present terms is

    sigmoid(w0 + sum w_i + sum over pairs <v_i, v_j>)

where the pairs, such as an insult with a mention of a group, cost no more than the terms:
half of (sum v)^2 - sum v^2. The machine is fitted on a bounded sample of labelled rows (about ``SAMPLE_DOCS``,
drawn by a hash of doc_id): Spark counts every term of the sample by label, the terms whose count in toxic
documents departs from chance enough (``LEAST_Z``) are kept, ``MAX_TERMS`` at most, and only those reach the
driver, where numpy fits weights and factors by adaptive gradient steps. Every text is then scored whole.

Nulls: a null or wordless text has no terms and gets the score of w0; null labels and doc_ids are not learned from.
Ties among terms go to the smaller hash. Repeated rows count as often as they come, as do several labels of a
document. Other columns are ignored. Without labels every score is 0.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import write_table

HASH_BITS = 20
PREFIXES = (4, 5, 6, 7, 8)
SAMPLE_DOCS = 20_000
MAX_TERMS = 20_000
LEAST_Z = 3.5
LEAST_DOCS = 4
FACTORS = 6
EPOCHS = 30
_WORD = re.compile(r"[^\W\d_]+")
_CACHED = 250_000
_PLACES = 1 << HASH_BITS


def held_out() -> Column:
    """The rows whose labels are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0


def word_terms(word: str) -> list[int]:
    """Places of a word and its proper prefixes; a prefix differs from the same letters as a word."""
    parts = [word, *(word[:n] + "*" for n in PREFIXES if len(word) > n)]
    return [xxhash.xxh32_intdigest(p.encode("utf-8", "replace")) & (_PLACES - 1) for p in parts]


class TermReader:
    """Distinct terms of texts, as numbers that ``number`` gives to hash places (below 0: of no interest)."""

    def __init__(self, number: np.ndarray | None = None):
        self._number = number
        self._known: dict[str, bytes] = {}

    def _numbers(self, word: str) -> bytes:
        found = np.array(word_terms(word), np.int32)
        if self._number is not None:
            found = self._number[found]
            found = found[found >= 0]
        data = found.tobytes()
        if len(self._known) >= _CACHED:
            self._known.clear()
        self._known[word] = data
        return data

    def read(self, text: str | None) -> np.ndarray:
        words = set(_WORD.findall(text.lower())) if text else ()
        known = self._known.get
        data = b"".join([x if (x := known(w)) is not None else self._numbers(w) for w in words])
        return np.unique(np.frombuffer(data, np.int32))


@dataclass
class Machine:
    """``places`` of the kept terms, ascending; bias ``w0``, weights ``w`` and factors ``v`` (terms, FACTORS)."""

    places: np.ndarray
    w0: float
    w: np.ndarray
    v: np.ndarray

    def numbering(self) -> np.ndarray:
        number = np.full(_PLACES, -1, np.int32)
        number[self.places] = np.arange(len(self.places), dtype=np.int32)
        return number

    def score(self, terms: np.ndarray) -> float:
        v = self.v[terms]
        pairs = 0.5 * float((v.sum(axis=0) ** 2).sum() - (v**2).sum())
        return float(_sigmoid(self.w0 + float(self.w[terms].sum()) + pairs))


def _sigmoid(x: np.ndarray | float) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def train(rows: list[np.ndarray], target: np.ndarray, terms: int, epochs: int = EPOCHS, seed: int = 5):
    """Bias, weights and factors from the term numbers of each document and its 0/1 label."""
    rng = np.random.default_rng(seed)
    w0 = np.array([np.log((target.sum() + 0.5) / (len(target) - target.sum() + 0.5))])
    w, v = np.zeros(terms), rng.normal(0, 0.05, (terms, FACTORS))
    past = [np.full_like(a, 1e-3) for a in (w0, w, v)]
    for epoch in range(epochs):
        rate = 0.1 * (1 - 0.9 * epoch / epochs)
        order = rng.permutation(len(rows))
        for at in range(0, len(order), 128):
            chosen = order[at : at + 128]
            sizes = np.array([len(rows[i]) for i in chosen])
            ids = np.concatenate([rows[i] for i in chosen]) if sizes.sum() else np.empty(0, np.int64)
            owner = np.repeat(np.arange(len(chosen)), sizes)
            sums = np.zeros((len(chosen), FACTORS))
            np.add.at(sums, owner, v[ids])
            squares = np.bincount(owner, (v[ids] ** 2).sum(axis=1), len(chosen))
            linear = np.bincount(owner, w[ids], len(chosen))
            error = _sigmoid(w0 + linear + 0.5 * ((sums**2).sum(axis=1) - squares)) - target[chosen]
            error /= len(chosen)
            seen, place = np.unique(ids, return_inverse=True)
            g_w = np.bincount(place, error[owner], len(seen)) + 1e-5 * w[seen]
            g_v = np.zeros((len(seen), FACTORS))
            np.add.at(g_v, place, error[owner, None] * (sums[owner] - v[ids]))
            g_v += 1e-4 * v[seen]
            for a, p, k, g in ((w0, past[0], slice(None), error.sum()), (w, past[1], seen, g_w), (v, past[2], seen, g_v)):
                p[k] += g * g
                a[k] -= rate * g / np.sqrt(p[k])
    return float(w0[0]), w, v


def _term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    reader, docs, toxic = TermReader(), np.zeros(_PLACES, np.int64), np.zeros(_PLACES, np.int64)
    for batch in batches:
        for text, label in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            terms = reader.read(text.as_py())
            docs[terms] += 1
            toxic[terms] += label
    found = np.flatnonzero(docs)
    yield pa.RecordBatch.from_arrays(
        [pa.array(found, pa.int64()), pa.array(docs[found]), pa.array(toxic[found])], ["place", "docs", "toxic"]
    )


def _kept_terms(places: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(Machine(places, 0.0, None, None).numbering())
        for batch in batches:
            terms = [reader.read(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("toxic"), pa.array(terms, pa.list_(pa.int32()))],
                ["doc_id", "toxic", "terms"],
            )

    return run


def fit(documents: DataFrame, labels: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Machine | None:
    """Fit on about ``sample_docs`` of the rows of ``labels`` (doc_id, toxic) and their ``documents`` (doc_id, text)."""
    usable = labels.filter("doc_id is not null and toxic in (0, 1)").select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")
    )
    n = usable.count()
    if not n:
        return None
    share = min(1_000_000, -(-sample_docs * 1_000_000 // n))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("toxicity sample")), F.lit(1_000_000)) < share)
    drawn = write_table(drawn.coalesce(1), "toxicity-labels")  # bounded by the sample's size
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").filter("text is not null")
    sample = write_table(texts.join(F.broadcast(drawn), "doc_id").repartition(12, "doc_id"), "toxicity-sample")
    totals = sample.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    if not totals["n"] or not totals["toxic"]:
        return None
    rate = totals["toxic"] / totals["n"]
    counts = (
        sample.select("text", "toxic")
        .mapInArrow(_term_counts, "place long, docs long, toxic long")
        .groupBy("place")
        .agg(F.sum("docs").alias("docs"), F.sum("toxic").alias("toxic"))
    )
    z = F.abs(F.col("toxic") - F.col("docs") * rate) / F.sqrt(F.col("docs") * rate * (1 - rate) + 1e-9)
    kept = (
        counts.withColumn("z", z)
        .filter((F.col("docs") >= LEAST_DOCS) & (F.col("z") >= LEAST_Z))
        .orderBy(F.desc("z"), "place")
        .limit(MAX_TERMS)
        .select("place")
        .collect()
    )
    places = np.array(sorted(r["place"] for r in kept), np.int64)
    rows = sample.mapInArrow(_kept_terms(places), "doc_id long, toxic int, terms array<int>").collect()
    rows.sort(key=lambda r: (r["doc_id"], r["toxic"]))  # the order of partitions must not matter
    terms = [np.array(r["terms"], np.int64) for r in rows]
    w0, w, v = train(terms, np.array([r["toxic"] for r in rows], float), len(places))
    return Machine(places, w0, w, v)


def _score(machine: Machine | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = TermReader(machine.numbering()) if machine else None
        for batch in batches:
            scores = [machine.score(reader.read(t.as_py())) if machine else 0.0 for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores, pa.float64())], ["doc_id", "score"])

    return run


def score(documents: DataFrame, machine: Machine | None) -> DataFrame:
    """doc_id and score of every whole text."""
    kind = dict(documents.dtypes)["doc_id"]
    return documents.select("doc_id", "text").mapInArrow(_score(machine), f"doc_id {kind}, score double")
