"""Packing of token sequences by shortest-pack-first over the histogram of their lengths.

Documents are cut into pieces of ``capacity`` tokens and a last one. Only the histogram of piece lengths,
at most ``capacity`` numbers, reaches the planner: lengths are placed longest first, each into the pack
with the most room, and packs of one pattern are counted, not listed. Patterns then meet documents by
rank: the k-th piece of a length takes the k-th slot planned for it. Ranks come from counts per written
partition, so no piece is sorted and no length, however frequent, is one task.

Nulls: a null text is an empty one (its end id is one token); a null doc_id stays null. Ties: pieces of a
length are ranked in the order of their partition, which changes no pack's length. Repeated rows are
documents of their own. Other columns are ignored. An empty table gives no piece.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table
from .tokens import encoder

CAPACITY = 2048
#: Pieces a worker keeps encoded, twice as many at most: it keeps them after its tasks, beside the heap of its executor.
CACHE_ENTRIES = 60_000
PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, part int, nth long"


def _cut(path: str, rule: str, end_id: int, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens = TaskContext.get().partitionId(), encoder(path, rule, CACHE_ENTRIES)
        end, seen = np.uint32(end_id).tobytes(), np.zeros(capacity + 1, np.int64)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"), strict=True):
                data = tokens.encode(text.as_py()) + end
                n = len(data) // 4
                for start in range(0, n, capacity):
                    piece = data[4 * start : 4 * (start + capacity)]
                    length = len(piece) // 4
                    row = (doc_id, start, length, zlib.crc32(piece), n, part, int(seen[length]))
                    rows.append((*row, piece) if keep_ids else row)
                    seen[length] += 1
            kinds = [pa.int64()] * 5 + [pa.int32(), pa.int64()] + [pa.binary()] * keep_ids
            names = [c.split()[0] for c in PIECE_SCHEMA.split(", ")] + ["ids"] * keep_ids
            columns = zip(*rows, strict=True) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names)

    return run


def cut_documents(
    documents: DataFrame, tokenizer: str, rule: str, end_id: int = 1, capacity: int = CAPACITY, keep_ids: bool = False
) -> DataFrame:
    """The pieces of all documents with their place ``nth`` among the equal lengths of their ``part``.

    ``keep_ids`` adds the ids as little-endian unsigned 32-bit integers. Write the result before ranking it.
    """
    schema = PIECE_SCHEMA + ", ids binary" * keep_ids
    return documents.select("doc_id", "text").mapInArrow(_cut(tokenizer, rule, end_id, capacity, keep_ids), schema)


def plan_packs(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Slots (length, rank of the first piece, packs, first pack, offset): runs of equal packs.

    Pieces of a length with ranks ``first..first+packs-1`` lie at ``offset`` of packs ``first pack...``.
    """
    open_packs: dict[int, list[tuple[int, tuple[int, ...]]]] = defaultdict(list)  # by room: packs, their lengths
    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        placed: list[tuple[int, int, tuple[int, ...]]] = []
        for room in sorted((r for r in open_packs if r >= length), reverse=True):
            while left and open_packs[room]:
                packs, lengths = open_packs[room].pop()
                # As many of this length as fit into one of these packs, into as many of them as needed.
                each = min(room // length, -(-left // packs))
                used = min(packs, left // each)
                placed.append((room - each * length, used, (*lengths, *[length] * each)))
                left -= used * each
                if packs > used:
                    open_packs[room].append((packs - used, lengths))
            if not left:
                break
        each = capacity // length
        if left >= each:
            placed.append((capacity - each * length, left // each, (length,) * each))
        if left % each:
            placed.append((capacity - left % each * length, 1, (length,) * (left % each)))
        for room, packs, lengths in placed:
            open_packs[room].append((packs, lengths))
    ranks: dict[int, int] = defaultdict(int)
    slots, first_pack = [], 0
    for room in sorted(open_packs):
        for packs, lengths in open_packs[room]:
            offset = 0
            for length in lengths:
                slots.append((length, ranks[length], packs, first_pack, offset))
                ranks[length] += packs
                offset += length
            first_pack += packs
    return slots


def _place(slots: list[tuple[int, int, int, int, int]]):
    """Give each ranked piece its pack and offset; ``slots`` is bounded by the number of lengths, not of pieces."""
    table = np.array(sorted(slots), np.int64).reshape(-1, 5)
    lengths, firsts = table[:, 0], table[:, 1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
            for value in np.unique(length):
                at = np.flatnonzero(length == value)
                low, high = np.searchsorted(lengths, value), np.searchsorted(lengths, value, "right")
                row = low + np.searchsorted(firsts[low:high], rank[at], "right") - 1
                sequence[at] = table[row, 3] + rank[at] - table[row, 1]
                offset[at] = table[row, 4]
            names = [n for n in batch.schema.names if n != "rank"]
            columns = [batch.column(n) for n in names] + [pa.array(sequence), pa.array(offset)]
            yield pa.RecordBatch.from_arrays(columns, [*names, "sequence_id", "offset"])

    return run


def pack(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Written pieces (of ``cut_documents``) with ``sequence_id`` and ``offset``, gapless in each sequence."""
    counts = pieces.groupBy("length", "part").agg(F.count("*").alias("n"))
    counts = write_table(counts, "piece-counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    earlier = Window.partitionBy("length").orderBy("part")
    before = counts.select("length", "part", (F.sum("n").over(earlier) - F.col("n")).alias("before"))
    ranked = (
        pieces.join(before, ["length", "part"])
        .withColumn("rank", F.col("before") + F.col("nth"))
        .drop("before", "part", "nth")
    )
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in ranked.schema.fields if f.name != "rank")
    return ranked.mapInArrow(_place(plan_packs(histogram, capacity)), f"{schema}, sequence_id long, offset long")


def sequence_lengths(packed: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Tokens and padded size of each sequence: a power of two stays as it is, others go up to the capacity."""
    used = F.col("tokens")
    return (
        packed.groupBy("sequence_id")
        .agg(F.sum("length").alias("tokens"))
        .withColumn("padded", F.when(used.bitwiseAND(used - 1) == 0, used).otherwise(F.lit(capacity)))
    )
