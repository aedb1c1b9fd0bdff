"""Periodic runs of words, found by recursive frequency splitting and a lag scan of what survives.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of length at least
``max(MIN_LENGTH, MIN_EXPONENT * q)``, that no neighbouring word extends with period q. Every word of such a run occurs
at least ``MIN_EXPONENT`` times inside it (each residue class modulo q of the run holds that many positions). So a word
that occurs fewer times within a segment lies in no run contained in that segment and splits it; runs never cross a
split. Splitting repeats on every piece, with counts of the piece alone, until no piece changes; pieces shorter than
``MIN_LENGTH`` are dropped. Each surviving piece is then scanned for every lag q up to a quarter of its length: the
maximal stretches where word i equals word i + q. A stretch long enough whose words also repeat at a proper divisor
of q belongs to that smaller period and is not counted twice. A maximal stretch of a piece is maximal in the whole
text, since a longer one would be a run that the splitting had kept whole, so the result is exact.

Words are dropped from a collapsed text if any run contains them after its first q words, leaving one period of every
run.

Scale: each document is one row of a ``mapInPandas`` task; nothing is shuffled, whatever the sources. The work of a
text is linear in its words for the splitting, and the lag scan costs the piece's length times a quarter of it in
vectorised comparisons, for pieces in which every word is frequent.

Odd rows: a null text has no words; null, empty or word-less texts have no runs (``n_runs`` 0, the best run's four
columns null, digests of the empty string). The planted rewrite of the contract needs a doc_id; a null doc_id is left
as it is. Ties between runs of equal length / period go to the smallest start, then period. Repeated rows are each
computed; only ``doc_id`` and ``text`` are read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MIN_LENGTH = 6
MIN_EXPONENT = 4
PLANT_EVERY = 10

RESULT = T.StructType(
    [
        T.StructField("doc_key", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_runs", T.LongType()),
        T.StructField("start", T.LongType()),
        T.StructField("length", T.LongType()),
        T.StructField("period", T.LongType()),
        T.StructField("exponent_milli", T.LongType()),
        T.StructField("runs_sha256", T.StringType()),
        T.StructField("collapsed_sha256", T.StringType()),
        T.StructField(
            "runs",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("start", T.LongType()),
                        T.StructField("length", T.LongType()),
                        T.StructField("period", T.LongType()),
                    ]
                )
            ),
        ),
        T.StructField("collapsed", T.StringType()),
    ]
)


def words(text: str | None) -> list[bytes]:
    """Runs of bytes other than ``[\\x20\\x09-\\x0D]`` of the UTF-8 text: ``bytes.split`` knows exactly these, and no
    other character's encoding holds them."""
    return text.encode("utf-8").split() if text else []


def planted(doc_id: str | None, found: list[bytes]) -> list[bytes]:
    """The contract's rewrite: in one document of ``PLANT_EVERY`` by crc32 of its decimal id, a periodic tail."""
    n = len(found)
    if doc_id is None or n == 0:
        return found
    h = zlib.crc32(doc_id.encode())
    if h % PLANT_EVERY:
        return found
    g = h // PLANT_EVERY
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return found[:a] + [found[a + (i - a) % p] for i in range(a, n)]


def _pieces(ids: np.ndarray) -> list[tuple[int, int]]:
    """Half-open pieces of ``ids`` that may hold runs, split at words too rare within their piece."""
    todo, done = [(0, len(ids))], []
    while todo:
        lo, hi = todo.pop()
        if hi - lo < MIN_LENGTH:
            continue
        part = ids[lo:hi]
        _, inverse, counts = np.unique(part, return_inverse=True, return_counts=True)
        rare = counts[inverse] < MIN_EXPONENT
        if not rare.any():
            done.append((lo, hi))
            continue
        cuts = np.flatnonzero(rare)
        edges = np.concatenate(([-1], cuts, [hi - lo]))
        todo.extend((lo + a + 1, lo + b) for a, b in zip(edges[:-1], edges[1:]) if b - a - 1 >= MIN_LENGTH)
    return sorted(done)


def _divisors(q: int) -> list[int]:
    return [d for d in range(1, q // 2 + 1) if q % d == 0]


def find_runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of the id sequence, by start, then period."""
    found = []
    for lo, hi in _pieces(ids):
        part = ids[lo:hi]
        m = hi - lo
        for q in range(1, m // MIN_EXPONENT + 1):
            need = max(MIN_LENGTH, MIN_EXPONENT * q) - q
            same = np.concatenate(([False], part[:-q] == part[q:], [False]))
            edges = np.flatnonzero(same[1:] != same[:-1])
            for a, b in zip(edges[::2], edges[1::2]):
                if b - a < need:
                    continue
                stretch = part[a : b + q]
                if any(np.array_equal(stretch[:-d], stretch[d:]) for d in _divisors(q)):
                    continue
                found.append((lo + int(a), int(b - a) + q, q))
    return sorted(found)


def describe(doc_id: str | None, text: str | None) -> tuple:
    """The result row of one text (see ``RESULT``); ``doc_id`` is the decimal id."""
    raw = planted(doc_id, words(text))
    runs = find_runs(pd.factorize(np.array(raw, dtype=object))[0].astype(np.int64) if raw else np.empty(0, np.int64))
    drop = np.zeros(len(raw) + 1, np.int32)
    for start, length, period in runs:
        drop[start + period] += 1
        drop[start + length] -= 1
    kept = np.cumsum(drop[:-1]) == 0
    collapsed = b" ".join(w for w, k in zip(raw, kept) if k)
    listing = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    best = None
    if runs:
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]))
    return (
        doc_id,
        len(raw),
        len(runs),
        *(best if best else (None, None, None)),
        (1000 * best[1]) // best[2] if best else None,
        hashlib.sha256(listing.encode()).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(),
        [{"start": s, "length": n, "period": q} for s, n, q in runs],
        collapsed.decode("utf-8"),
    )


def find_periodic_runs(documents: DataFrame) -> DataFrame:
    """Per document row: doc_id, n_words, n_runs, the best run's start, length, period and exponent_milli, the digests
    runs_sha256 and collapsed_sha256, all runs and the collapsed text."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.name for f in RESULT.fields]
        for batch in batches:
            rows = [describe(d, t) for d, t in zip(batch["doc_key"], batch["text"], strict=True)]
            out = pd.DataFrame(rows, columns=names)
            for name in ("start", "length", "period", "exponent_milli"):
                out[name] = out[name].astype("Int64")
            yield out

    # ids travel as their decimal text: pandas would turn a column of longs with nulls into doubles
    keyed = documents.select(F.col("doc_id").cast("long").cast("string").alias("doc_key"), F.col("text").cast("string"))
    found = keyed.mapInPandas(run, RESULT)
    return found.select(F.col("doc_key").cast("long").alias("doc_id"), *[c for c in found.columns if c != "doc_key"])
