"""Token ids of documents in files of Simple-8b blocks.

File format: Parquet files whose rows are blocks of at most ``block_ids`` ids, in ascending doc_id
order over files (``part``) and rows (``block_start``, the ids of this part before the block). ``words``
holds little-endian 64-bit words: the top four bits select how many ids of how many bits fill the other
sixty (``SELECTORS``); selector 0 is an escape, whose next word is an id of 2**60 or more as it is.
``doc_ids``, ``doc_rows``, ``doc_tokens`` (ids in this block) and ``doc_sizes`` (all ids) say whose ids a block holds. A document lies in one block
unless it has more than ``block_ids`` ids. Parquet is only the container: it lets Spark write to any store
and lets readers skip to single blocks.

Nulls: a null text is an empty one, a null doc_id comes first. Ties and repeated rows: each row is a
document of its own, equal doc_ids in the order of their texts' hashes. Other columns are ignored. An
empty table gives files without blocks.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .tokens import encoder

#: Ids a word holds and bits of each, by selector; the format's fixed values. 0 is the escape.
SELECTORS = {
    1: (60, 1), 2: (30, 2), 3: (20, 3), 4: (15, 4), 5: (12, 5), 6: (10, 6), 7: (8, 7),
    8: (7, 8), 9: (6, 10), 10: (5, 12), 11: (4, 15), 12: (3, 20), 13: (2, 30), 14: (1, 60),
}
_ESCAPE_FROM = 1 << 60
BLOCK_IDS = 65_536

BLOCK_SCHEMA = (
    "part int, block_start long, n_ids int, doc_ids array<long>, doc_rows array<long>, doc_tokens array<int>, "
    "doc_sizes array<long>, words binary"
)
PIECE_SCHEMA = "part int, doc_row long, doc_id long, start long, n_ids long, n_tokens long, ids_crc32 long"


def encode(ids: np.ndarray) -> np.ndarray:
    """Simple-8b words of unsigned ids: each word takes as many of the next ids as any selector can."""
    ids = np.asarray(ids, np.uint64)
    n = len(ids)
    if not n:
        return np.empty(0, np.uint64)
    width = np.zeros(n + 60, np.uint8)  # padding has no bits
    width[:n] = np.frexp(ids.astype(np.float64))[1]
    wide = np.flatnonzero(ids >> np.uint64(52))  # floats may round these up to a power of two
    width[wide] = [int(x).bit_length() for x in ids[wide]]
    widest = {1: width}  # of the next so many ids
    choice = np.zeros(n, np.uint8)
    for selector in sorted(SELECTORS, reverse=True):
        count, bits = SELECTORS[selector]
        if count > 1:
            half = max(c for c in widest if 2 * c >= count and c < count) if count > 2 else 1
            widest[count] = np.maximum(widest[half][: -(count - half)], widest[half][count - half :])
        np.copyto(choice, selector, where=widest[count][:n] <= bits)
    step = np.ones(16, np.int64)
    for selector, (count, _) in SELECTORS.items():
        step[selector] = count
    # Follow the words eight at a time, then fill in those between.
    after = np.minimum(np.append(np.arange(n) + step[choice], n), n)
    two = after[after]
    four = two[two]
    eights, starts, i = four[four].tolist(), [], 0
    while i < n:
        starts.append(i)
        i = eights[i]
    starts = np.array(starts)
    for jump in (four, two, after):
        starts = np.stack([starts, jump[starts]], axis=1).ravel()
    starts = starts[starts < n]
    chosen = choice[starts]
    words = np.zeros(len(starts), np.uint64)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for selector, (count, bits) in SELECTORS.items():
        rows = np.flatnonzero(chosen == selector)
        if len(rows):
            first, word = starts[rows], np.full(len(rows), selector << 60, np.uint64)
            for k in range(count):
                word |= padded[first + k] << np.uint64(k * bits)
            words[rows] = word
    escapes = np.flatnonzero(chosen == 0)
    return np.insert(words, escapes + 1, ids[starts[escapes]]) if len(escapes) else words


def decode(words: np.ndarray, n: int) -> np.ndarray:
    """The first ``n`` ids of Simple-8b words, all words of a selector at once."""
    words = np.asarray(words, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    # An escaped id has high bits, so it is never taken for an escape; it follows one.
    escaped = np.zeros(len(words), bool)
    escaped[1:] = selector[:-1] == 0
    step = np.zeros(16, np.int64)
    for s, (count, _) in SELECTORS.items():
        step[s] = count
    counts = np.where(escaped, 1, step[selector])
    ends = np.cumsum(counts)
    out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint64)
    for s, (count, bits) in SELECTORS.items():
        rows = np.flatnonzero((selector == s) & ~escaped)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            values = (words[rows][:, None] >> shifts) & np.uint64((1 << bits) - 1)
            out[(ends[rows] - count)[:, None] + np.arange(count)] = values
    out[ends[escaped] - 1] = words[escaped]
    return out[:n]


def _blocks(path: str, rule: str, end_id: int, block_ids: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, tokens = TaskContext.get().partitionId(), encoder(path, rule)
        end = np.uint32(end_id).tobytes()
        done = row = 0  # ids before the open block, documents
        held, docs = [], []  # ids of the open block, and whose they are
        size = 0

        def block() -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(held), "<u4")
            doc_ids, rows, counts, sizes = zip(*docs, strict=True)
            words = encode(ids).astype("<u8").tobytes()
            return pa.RecordBatch.from_pydict(
                {
                    "part": pa.array([part], pa.int32()),
                    "block_start": pa.array([done], pa.int64()),
                    "n_ids": pa.array([len(ids)], pa.int32()),
                    "doc_ids": pa.array([doc_ids], pa.list_(pa.int64())),
                    "doc_rows": pa.array([rows], pa.list_(pa.int64())),
                    "doc_tokens": pa.array([counts], pa.list_(pa.int32())),
                    "doc_sizes": pa.array([sizes], pa.list_(pa.int64())),
                    "words": pa.array([words], pa.binary()),
                }
            )

        for batch in batches:
            ids_of = batch.column("doc_id").to_pylist()
            for doc_id, text in zip(ids_of, batch.column("text"), strict=True):
                data = tokens.encode(text.as_py()) + end
                for at in range(0, len(data), 4 * block_ids):
                    piece = data[at : at + 4 * block_ids]
                    n = len(piece) // 4
                    if size and size + n > block_ids:
                        yield block()
                        done, size = done + size, 0
                        held, docs = [], []
                    held.append(piece)
                    docs.append((doc_id, row, n, len(data) // 4))
                    size += n
                row += 1
        if size:
            yield block()

    return run


def write_token_files(
    documents: DataFrame, out: str, tokenizer: str, rule: str, end_id: int = 1, block_ids: int = BLOCK_IDS
) -> None:
    """Write the ids of ``text``, each document with ``end_id`` after it, in ascending doc_id order."""
    n = int(documents.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    (
        documents.select("doc_id", "text")
        .repartitionByRange(n, "doc_id")
        .sortWithinPartitions("doc_id", F.xxhash64("text"))
        .mapInArrow(_blocks(tokenizer, rule, end_id, block_ids), BLOCK_SCHEMA)
        .write.option("compression", "none")
        .parquet(out)
    )


def read_blocks(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(BLOCK_SCHEMA).parquet(path)


def block_ids_of(block: dict) -> list[tuple[int | None, int, np.ndarray]]:
    """Of a block read as a row: doc_id, place in the part and ids of each document in it."""
    ids = decode(np.frombuffer(block["words"], "<u8"), block["n_ids"])
    ends = np.cumsum(np.array(block["doc_tokens"], np.int64))
    cuts = np.split(ids, ends[:-1])
    starts = block["block_start"] + ends - block["doc_tokens"]
    return list(zip(block["doc_ids"], starts.tolist(), cuts, strict=True))


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for x in batch.to_pylist():
            found = block_ids_of(x)
            k = len(found)
            columns = (
                pa.array([x["part"]] * k, pa.int32()),
                pa.array(x["doc_rows"], pa.int64()),
                pa.array(x["doc_ids"], pa.int64()),
                pa.array([start for _, start, _ in found], pa.int64()),
                pa.array(x["doc_tokens"], pa.int64()),
                pa.array(x["doc_sizes"], pa.int64()),
                pa.array([zlib.crc32(ids.astype("<u4").tobytes()) for _, _, ids in found], pa.int64()),
            )
            names = ["part", "doc_row", "doc_id", "start", "n_ids", "n_tokens", "ids_crc32"]
            yield pa.RecordBatch.from_arrays(list(columns), names)


def _times(matrix: list[int], vector: int) -> int:
    total = 0
    for row in matrix:
        if not vector:
            break
        total ^= row if vector & 1 else 0
        vector >>= 1
    return total


def crc32_combine(first: int, second: int, second_bytes: int) -> int:
    """The CRC-32 of two byte strings, one after the other, from theirs: ``first`` moves on by zero bytes."""
    matrix = [0xEDB88320, *(1 << n for n in range(31))]  # one zero bit
    for _ in range(3):
        matrix = [_times(matrix, row) for row in matrix]  # one zero byte
    while second_bytes:
        if second_bytes & 1:
            first = _times(matrix, first)
        matrix = [_times(matrix, row) for row in matrix]
        second_bytes >>= 1
    return first ^ second


def _joined_crc(pieces) -> int:
    crc = 0
    for p in pieces:
        crc = crc32_combine(crc, p["ids_crc32"], 4 * p["n_ids"])
    return crc


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """One row per document in the files: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    Only documents over ``block_ids`` ids are put together again from pieces; each has few of them.
    """
    blocks = read_blocks(spark, path)
    parts = (
        blocks.groupBy("part")
        .agg(F.sum("n_ids").alias("ids"))
        .select("part", (F.sum("ids").over(Window.orderBy("part")) - F.col("ids")).alias("before"))
    )
    pieces = blocks.mapInArrow(_pieces, PIECE_SCHEMA).withColumn("whole", F.col("n_ids") == F.col("n_tokens"))
    columns = ["part", "doc_id", "start", "n_tokens", "ids_crc32"]
    split = (
        pieces.filter("not whole")
        .groupBy("part", "doc_row")
        .agg(
            F.first("doc_id").alias("doc_id"),
            F.first("n_tokens").alias("n_tokens"),
            F.sort_array(F.collect_list(F.struct("start", "n_ids", "ids_crc32"))).alias("pieces"),
        )
        .select(
            "part", "doc_id", F.col("pieces")[0]["start"].alias("start"), "n_tokens",
            F.udf(_joined_crc, LongType())("pieces").alias("ids_crc32"),
        )
    )
    return (
        pieces.filter("whole")
        .select(columns)
        .unionByName(split.select(columns))
        .join(parts, "part")
        .select("doc_id", (F.col("before") + F.col("start")).alias("start"), "n_tokens", "ids_crc32")
    )
