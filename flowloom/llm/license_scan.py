"""Licence notices in texts, by a trained paragraph classifier that templates confirm.

A paragraph is a block of lines up to a blank one (after comment marks and other signs are taken off), its lines joined,
so wrapped notices are whole. A notice is a window of a paragraph, somewhat longer than a template at most, that
holds at least ``LEAST_COMMON`` of the word one- and two-grams of that template. Every such window of every template is found,
wherever it is in a text of any length, and multinomial logistic regression over its hashed grams alone, whatever
surrounds it, must give the template's licence family rather than another one or unknown, with a calibrated probability
of at least ``LEAST_PROBABILITY``. Windows that overlap are one notice, that which holds most of its template.

The classifier is trained in numpy on varied notices of each family (``TEMPLATES`` with words left out, replaced and
surrounded by words of the corpus) and, as unknown, on a bounded sample of the corpus' own lines: up to
``SAMPLE_LINES`` of each of about ``SAMPLE_DOCS`` documents, drawn by a hash of doc_id, without those that resemble a template. A
fifth of the examples is held out to calibrate the probabilities by a temperature.

Nulls: a null text has no paragraph; rows with a null doc_id are scanned like others. Ties between families go to the
first in alphabetical order, between notices to the first. ``paragraph`` is the line on which the surest notice begins. Repeated rows are scanned each. Other columns are ignored. An
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Common wordings of licence notices, fixed values.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "agpl": (
        "licensed under the GNU Affero General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
    ),
    "apache": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org/licenses/LICENSE-2.0",
    ),
    "bsd": (
        "Licensed under the BSD 3-Clause License",
        "released under the BSD license",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    ),
    "cc-by": (
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    ),
    "cc-by-sa": (
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
    ),
    "cc0": (
        "dedicated to the public domain under CC0 1.0",
        "waived all copyright under the Creative Commons CC0 1.0 Universal Public Domain Dedication",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "released under the GNU GPL v3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
    ),
    "lgpl": (
        "licensed under the GNU Lesser General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT license",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction",
    ),
    "mpl": (
        "licensed under the Mozilla Public License, version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    ),
    "proprietary": (
        "All rights reserved",
        "No part of this publication may be reproduced or distributed without the prior written permission of the publisher",
    ),
}
UNKNOWN = "unknown"
#: Sentences with words of licences that are none.
NOT_LICENCES = (
    "the driver lost a license last year",
    "you need a license to fish in this lake",
    "version 2.0 of the software is released today",
    "the general public may use the library",
    "permission to enter was granted by the mayor",
    "apache helicopters and the mit campus",
    "the foundation published free software",
    "creative people work in the commons",
)
HASH_BITS = 16
SAMPLE_DOCS = 2_000
SAMPLE_LINES = 8
VARIANTS = 120
EPOCHS = 6
LEAST_PROBABILITY = 0.5
LEAST_COMMON = 0.6
_PLACES = 1 << HASH_BITS
_BREAK = b"\x01"
_CLEAN = bytes(
    c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or 48 <= c <= 57 or c >= 128 or c in (10, 46) else 32
    for c in range(256)
)


def text_grams(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Places of the words of a text, of the pairs that they begin (-1 at the end of a paragraph), and each word's line."""
    data = text.encode("utf-8", "replace").translate(_CLEAN).replace(b".\n", b"\n").replace(b". ", b" ")
    tokens = data.replace(b"\n", b" \x01 ").split()
    if tokens:
        tokens[-1] = tokens[-1].rstrip(b".") or b"."
    hashes = np.fromiter(map(xxhash.xxh32_intdigest, tokens), np.uint32, len(tokens))
    ends = hashes == np.uint32(xxhash.xxh32_intdigest(_BREAK))
    line = np.cumsum(ends)[~ends]
    hashes = hashes[~ends]
    pairs = hashes[:-1] * np.uint32(0x9E3779B1) + hashes[1:]
    pairs ^= pairs >> np.uint32(15)
    second = np.full(len(hashes), -1, np.int64)
    second[:-1] = np.where(np.diff(line) > 1, -1, (pairs & np.uint32(_PLACES - 1)).astype(np.int64))
    return (hashes & np.uint32(_PLACES - 1)).astype(np.int64), second, line


def _window_grams(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Places of the grams of a window within one paragraph."""
    return np.unique(np.concatenate([first, second[:-1]]))


def _grams(line: str) -> np.ndarray:
    first, second, _ = text_grams(line.replace("\n", " "))
    return _window_grams(first, second)


@dataclass
class Classifier:
    """``weights`` (_PLACES, families), ``bias`` and the temperature of its probabilities."""

    families: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def classify(self, text: str) -> list[tuple[int, str, float, float]]:
        """(line, family, probability, part of its template it holds) of all notices, by their place."""
        first, second, line = text_grams(text)
        found = []
        for start, end, family, common in _windows(first, second, line):
            grams = _window_grams(first[start:end], second[start:end])
            z = self.weights[grams].sum(axis=0) / np.sqrt(len(grams)) + self.bias
            if self.families[z.argmax()] == family:
                z = z.astype(float) / self.temperature
                p = np.exp(z - z.max())
                found.append((-common, -float(p.max() / p.sum()), start, end, family))
        notices = []
        taken = np.zeros(len(first), bool)
        for common, p, start, end, family in sorted(found):
            if not taken[start:end].any():
                taken[start:end] = True
                notices.append((start, int(line[start]), family, -p, -common))
        return [n[1:] for n in sorted(notices)]


@dataclass
class _Templates:
    """Of each template its family, number of grams and longest window; ``holds`` (_PLACES, templates), their grams."""

    families: list[str]
    sizes: np.ndarray
    longest: list[int]
    holds: np.ndarray
    any_holds: np.ndarray


_templates: list[_Templates] = []


def _all_templates() -> _Templates:
    if not _templates:
        both = [(f, t) for f, ts in sorted(TEMPLATES.items()) for t in ts]
        holds = np.zeros((_PLACES, len(both)), bool)
        for k, (_, t) in enumerate(both):
            holds[_grams(t), k] = True
        # A quarter more words than the template has, and some for short ones, may stand between its own.
        longest = [n + n // 4 + 2 for n in (len(t.split()) for _, t in both)]
        _templates.append(_Templates([f for f, _ in both], holds.sum(axis=0), longest, holds, holds.any(axis=1)))
    return _templates[0]


def _windows(first: np.ndarray, second: np.ndarray, line: np.ndarray) -> list[tuple[int, int, str, float]]:
    """(start, end, family, part) of windows of a paragraph that hold enough of a template; those of one don't overlap."""
    known = _all_templates()
    at_first = np.flatnonzero(known.any_holds[first])
    at_second = np.flatnonzero((second >= 0) & known.any_holds[second])
    grams, index = np.unique(np.concatenate([first[at_first], second[at_second]]), return_inverse=True)
    # Only a text that has enough of a template anywhere can have a window with it.
    possible = np.flatnonzero(known.holds[grams].sum(axis=0) >= LEAST_COMMON * known.sizes - 1e-9)
    if not len(possible):
        return []
    # Word by word: where it begins and the last word it needs, which is the next one for pairs.
    start = np.concatenate([at_first, at_second])
    last = np.concatenate([at_first, at_second + 1])
    order = np.lexsort((last, start))
    start, last, index = start[order], last[order], index[order]
    # Words of different paragraphs are too far from each other to share a window.
    far = np.cumsum(np.diff(line, prepend=line[:1]) > 1) * 1_000
    found = []
    for k in possible:
        own = known.holds[grams[index], k]
        begins, ends, gram = start[own], last[own], index[own]
        spread = begins + far[begins]
        least, longest = int(np.ceil(LEAST_COMMON * known.sizes[k] - 1e-9)), known.longest[k]
        # The grams from each hit on that lie in a window; only where they are enough can they be distinct enough.
        until = np.searchsorted(spread, spread + longest)
        windows = []
        for i in np.flatnonzero(until - np.arange(len(begins)) >= least):
            inside = ends[i : until[i]] + far[ends[i : until[i]]] < spread[i] + longest
            distinct, at = np.unique(gram[i : until[i]][inside], return_index=True)
            if len(distinct) >= least:
                # It ends with the first occurrence of the last of its grams.
                end = int(ends[i : until[i]][inside][at].max()) + 1
                windows.append((-len(distinct), end - int(begins[i]), int(begins[i]), end))
        taken: set[int] = set()
        for n, _, a, b in sorted(windows):
            if taken.isdisjoint(range(a, b)):
                taken.update(range(a, b))
                found.append((a, b, known.families[k], -n / int(known.sizes[k])))
    return found


_template_grams: dict[str, list[np.ndarray]] = {}


def _common(grams: np.ndarray, family: str) -> float:
    """The largest part of a template of the family whose grams are among ``grams``."""
    if not _template_grams:
        _template_grams.update({f: [_grams(t) for t in ts] for f, ts in TEMPLATES.items()})
    return max(len(np.intersect1d(t, grams)) / len(t) for t in _template_grams[family])


def train(corpus_lines: list[str], seed: int = 3) -> Classifier:
    """Train on varied templates, and on ``corpus_lines`` that resemble none as unknown."""
    rng = np.random.default_rng(seed)
    plain = [x for x in corpus_lines if max(_common(_grams(x), f) for f in TEMPLATES) < 0.5]
    filler = [w for x in plain[:500] for w in x.split()[:20]] or ["text"]
    families = [*sorted(TEMPLATES), UNKNOWN]
    rows: list[np.ndarray] = []
    target: list[int] = []
    for k, family in enumerate(families[:-1]):
        for template in TEMPLATES[family]:
            words = template.split()
            for _ in range(VARIANTS):
                kept = [w for w in words if rng.random() > 0.06]
                kept = [filler[rng.integers(len(filler))] if rng.random() < 0.02 else w for w in kept]
                before, after = rng.integers(0, 6, 2) * (rng.random(2) < 0.5)
                extra = [filler[i] for i in rng.integers(0, len(filler), before + after)]
                rows.append(_grams(" ".join([*extra[:before], *kept, *extra[before:]])))
                target.append(k)
    for line in [*plain, *NOT_LICENCES * 20]:
        rows.append(_grams(line))
        target.append(len(families) - 1)
    y = np.array(target)
    held = rng.random(len(rows)) < 0.2
    weights = np.zeros((_PLACES, len(families)), np.float32)
    past = np.full((_PLACES, len(families)), 1e-3, np.float32)
    bias = np.zeros(len(families), np.float32)

    def logits(i: int) -> np.ndarray:
        return weights[rows[i]].sum(axis=0) / np.sqrt(max(1, len(rows[i]))) + bias

    fitted = np.flatnonzero(~held)
    for _ in range(EPOCHS):
        for i in rng.permutation(fitted):
            z = logits(i)
            g = np.exp(z - z.max())
            g /= g.sum()
            g[y[i]] -= 1
            step = g / np.sqrt(max(1, len(rows[i])))
            past[rows[i]] += step * step
            weights[rows[i]] -= 0.3 * step / np.sqrt(past[rows[i]])
            bias -= 0.01 * g
    z = np.array([logits(i) for i in np.flatnonzero(held)]).reshape(-1, len(families))

    def loss(temperature: float) -> float:
        s = z / temperature
        s -= s.max(axis=1, keepdims=True)
        return float(-(s[np.arange(len(s)), y[held]] - np.log(np.exp(s).sum(axis=1))).mean()) if len(s) else 0.0

    temperature = min((0.25 * 1.15**i for i in range(30)), key=loss)
    return Classifier(families, weights, bias, temperature)


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        lines = []
        for text in batch.column("text"):
            own = [x[:2000] for x in text.as_py().split("\n") if x.strip()]
            lines += own[:: max(1, len(own) // SAMPLE_LINES)][:SAMPLE_LINES]
        yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], ["line"])


def fit(documents: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Classifier:
    """Train with a bounded sample of paragraphs of ``documents`` (doc_id, text) as the unknown class."""
    usable = documents.filter("doc_id is not null and text is not null").select("doc_id", "text")
    share = -(-sample_docs * 1_000_000 // max(1, usable.select("doc_id").count()))
    drawn = usable.filter(F.pmod(F.xxhash64("doc_id", F.lit("licence sample")), F.lit(1_000_000)) < share)
    lines = [r["line"] for r in drawn.mapInArrow(_lines, "line string").collect()]
    return train(sorted(lines))


def _scan(classifier: Classifier) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                found = classifier.classify(text.as_py() or "")
                sure = [x for x in found if x[2] >= LEAST_PROBABILITY and x[3] >= LEAST_COMMON]
                best = max(sure, key=lambda x: x[2], default=(None, UNKNOWN, 0.0, 0.0))
                rows.append((best[1], best[2], best[3], best[0], len(sure), sorted({x[1] for x in sure})))
            kinds = [pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.int64(), pa.list_(pa.string())]
            names = ["family", "score", "similarity", "paragraph", "n_notices", "families"]
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            found = [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *found], ["doc_id", *names])

    return run


def scan(documents: DataFrame, classifier: Classifier) -> DataFrame:
    """Of every whole text: the surest confirmed family (or unknown), its figures and paragraph, and all families."""
    schema = (
        f"doc_id {dict(documents.dtypes)['doc_id']}, family string, score double, similarity double, paragraph long, "
        "n_notices long, families array<string>"
    )
    return documents.select("doc_id", "text").mapInArrow(_scan(classifier), schema)
