"""Benchmark decontamination: one Aho-Corasick automaton over the normalised windows of all test items.

Texts are normalised by lower-casing A-Z and taking words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` (ASCII letters
and digits, and every character beyond ASCII). An item of ``WINDOW`` words or more gives all its windows of ``WINDOW``
consecutive words; an item with fewer, but some, words is one window of all of them. Each window becomes one pattern,
its words joined by single spaces and framed by a space on each side, so a pattern matches the equally framed
normalised document exactly where its words occur consecutively. Identical windows of several items are one pattern
that names all of them.

Every document is scanned once, in its Spark task, by one automaton over all patterns. Match ends are mapped back to
word numbers and from those to character offsets of the original text (lower-casing A-Z keeps offsets). A document
word is hit if it lies in any occurrence of a window.

Scale: documents are never shuffled. The automaton is built from the benchmark on each Python worker once; the
patterns reach the executors as a broadcast whose size is measured first. If it exceeds ``SHARD_BYTES``, the windows
are split by a hash into as many shards as needed, every document is scanned once per shard, and the hit spans of all
shards are merged per document: exact at any size, with no window left out.

Odd rows: a null or empty text, or one without word characters, has no words and no hits. A null item text has no
windows; items with a null ``item_id`` are ignored. Repeated items (same text, several ids) each count; repeated
documents are each scanned. Only ``doc_id`` and ``text`` of documents and ``item_id`` and ``text`` of the benchmark are
read, so further columns of any name don't matter. An empty benchmark hits nothing; empty documents give an empty
result.
"""

from __future__ import annotations

import hashlib
import math
import re
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import write_table

WINDOW = 10
#: Largest total size of pattern text that one scan takes at once; larger benchmarks are scanned in shards.
SHARD_BYTES = 256 * 1024 * 1024

#: Word characters and lower-casing of the contract, fixed values.
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
RESULT = T.StructType(
    [
        T.StructField("row", T.LongType()),
        T.StructField("doc_key", T.StringType()),
        T.StructField("n_words", T.LongType()),
        T.StructField("n_hit", T.LongType()),
        T.StructField("spans", T.ArrayType(SPAN)),
        T.StructField("word_spans", T.ArrayType(SPAN)),
        T.StructField("item_ids", T.ArrayType(T.LongType())),
    ]
)


def normalised_words(text: str | None) -> list[str]:
    return WORD.findall(text.translate(LOWER)) if text else []


def item_windows(text: str | None, size: int = WINDOW) -> set[str]:
    """The framed patterns of one item's windows."""
    found = normalised_words(text)
    if not found:
        return set()
    if len(found) < size:
        return {f" {' '.join(found)} "}
    return {f" {' '.join(found[i : i + size])} " for i in range(len(found) - size + 1)}


def _windows(benchmark: DataFrame, size: int) -> DataFrame:
    """(pattern, item_ids) of all items, one row per distinct window."""

    @F.udf(T.ArrayType(T.StringType()))
    def windows(text):
        return sorted(item_windows(text, size))

    return (
        benchmark.filter(F.col("item_id").isNotNull())
        .select(F.col("item_id").cast("long").alias("item_id"), F.explode(windows("text")).alias("pattern"))
        .groupBy("pattern")
        .agg(F.array_sort(F.collect_set("item_id")).alias("item_ids"))
    )


_automata: dict[str, object] = {}


def _automaton(key: str, patterns: list[tuple[str, list[int]]]):
    import ahocorasick

    if key not in _automata:
        _automata.clear()
        machine = ahocorasick.Automaton()
        for pattern, items in patterns:
            machine.add_word(pattern, (pattern.count(" ") - 1, tuple(items)))
        if patterns:
            machine.make_automaton()
        _automata[key] = machine
    return _automata[key]


def scan_text(text: str | None, machine, empty: bool) -> tuple[int, list[tuple[int, int]], list[tuple[int, int]], list[int]]:
    """(n_words, hit spans as character offsets of ``text``, hit spans as word numbers, item ids) of one text."""
    found = normalised_words(text)
    if not found or empty:
        return len(found), [], [], []
    framed = f" {' '.join(found)} "
    starts = np.cumsum([1] + [len(w) + 1 for w in found[:-1]])
    hit = np.zeros(len(found) + 1, np.int32)
    items: set[int] = set()
    for end, (size, ids) in machine.iter(framed):
        last = int(np.searchsorted(starts, end - 1, side="right")) - 1
        hit[last - size + 1] += 1
        hit[last + 1] -= 1
        items.update(ids)
    covered = np.cumsum(hit[:-1]) > 0
    if not covered.any():
        return len(found), [], [], []
    edges = np.flatnonzero(np.diff(np.concatenate(([0], covered.astype(np.int8), [0]))))
    word_spans = [(int(a), int(b)) for a, b in zip(edges[::2], edges[1::2])]
    offsets = [m.span() for m in WORD.finditer(text.translate(LOWER))]
    spans = [(offsets[a][0], offsets[b - 1][1]) for a, b in word_spans]
    return len(found), spans, word_spans, sorted(items)


def _scan(documents: DataFrame, patterns: list[tuple[str, list[int]]]) -> DataFrame:
    spark = documents.sparkSession
    shipped = spark.sparkContext.broadcast(patterns)
    key = uuid.uuid4().hex

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        machine = _automaton(key, shipped.value)
        empty = not shipped.value
        for batch in batches:
            rows = [scan_text(t, machine, empty) for t in batch["text"]]
            yield pd.DataFrame(
                {
                    "row": batch["row"],
                    "doc_key": batch["doc_key"],
                    "n_words": [r[0] for r in rows],
                    "n_hit": [sum(b - a for a, b in r[2]) for r in rows],
                    "spans": [[{"start": a, "end": b} for a, b in r[1]] for r in rows],
                    "word_spans": [[{"start": a, "end": b} for a, b in r[2]] for r in rows],
                    "item_ids": [r[3] for r in rows],
                }
            )

    found = documents.mapInPandas(run, RESULT)
    return found.select("row", F.col("doc_key").cast("long").alias("doc_id"), *found.columns[2:])


def find_contamination(documents: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, n_hit, spans and word_spans (hit stretches, [start, end) offsets of the original
    text and word numbers), item_ids (sorted ids of items with a window that occurs), contaminated."""
    windows = _windows(benchmark, size)
    total = windows.select(F.sum(F.length("pattern") + 8 * F.size("item_ids")).alias("n")).first()["n"] or 0
    shards = max(1, math.ceil(total / SHARD_BYTES))
    documents = documents.select(
        F.lit(0).cast("long").alias("row"),
        F.col("doc_id").cast("long").cast("string").alias("doc_key"),  # pandas would make longs with nulls doubles
        F.col("text").cast("string"),
    )
    if shards > 1:  # every scan must see the same row numbers
        documents = write_table(documents.withColumn("row", F.monotonically_increasing_id()), "decontamination-docs")
    parts = []
    for shard in range(shards):
        chosen = windows if shards == 1 else windows.filter(F.pmod(F.xxhash64("pattern"), F.lit(shards)) == shard)
        patterns = [(r.pattern, list(r.item_ids)) for r in chosen.toLocalIterator()]
        parts.append(_scan(documents, patterns))
    found = parts[0] if shards == 1 else _merge(parts)
    return found.drop("row").withColumn("contaminated", F.col("n_hit") > 0)


def _merge(parts: list[DataFrame]) -> DataFrame:
    """Hits of several shards, merged per document: overlapping or touching spans become one."""
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    docs = every.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("item_ids")
    )
    spans = every.select(
        "row", F.explode(F.arrays_zip("spans", "word_spans")).alias("s")
    ).select("row", F.col("s.spans").alias("c"), F.col("s.word_spans").alias("w"))
    order = Window.partitionBy("row").orderBy(F.col("w.start"), F.col("w.end"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    grouped = spans.withColumn(
        "group", F.sum((F.coalesce(F.max("w.end").over(before), F.lit(-1)) < F.col("w.start")).cast("int")).over(order)
    )
    merged = (
        grouped.groupBy("row", "group")
        .agg(
            F.min("w.start").alias("ws"), F.max("w.end").alias("we"), F.min("c.start").alias("cs"), F.max("c.end").alias("ce")
        )
        .groupBy("row")
        .agg(
            F.sum(F.col("we") - F.col("ws")).alias("n_hit"),
            F.array_sort(F.collect_list(F.struct(F.col("cs").alias("start"), F.col("ce").alias("end")))).alias("spans"),
            F.array_sort(F.collect_list(F.struct(F.col("ws").alias("start"), F.col("we").alias("end")))).alias("word_spans"),
        )
    )
    return docs.join(merged, "row", "left").select(
        "row",
        "doc_id",
        "n_words",
        F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"),
        F.coalesce("spans", F.array().cast(T.ArrayType(SPAN))).alias("spans"),
        F.coalesce("word_spans", F.array().cast(T.ArrayType(SPAN))).alias("word_spans"),
        "item_ids",
    )


def items_digest(item_ids: list[int]) -> str:
    return hashlib.sha256(",".join(sorted(str(i) for i in item_ids)).encode()).hexdigest()
