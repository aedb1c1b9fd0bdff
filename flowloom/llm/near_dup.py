"""Near-duplicate documents by min-max hashing, with links confirmed on full shingle sets.

Every document becomes its set of distinct five-word shingles. Equal sets are one class. Each of
``PERMUTATIONS`` hash functions gives two values of a class, its least and its greatest shingle, so a
signature of twice as many values costs half the hashing, and the two agree with the other set's less
alike than two independent ones would, which lowers the variance. ``ROWS`` values make a band; classes that
share a band are candidates. At the linking similarity of 0.75 a pair shares none of the bands with
probability (1 - 0.75**6)**72, under one in a million.

Candidates of a band are not paired with each other but with a hub, the class that shares the most bands with
others: in a group of copies that is one with few edits, to which nearly all are linked. At first every class is paired with
the foremost hub of its bands only, one pair a class; then, for bands whose classes still lie in different components,
with the foremost hub of each other component that its bands' hubs lie in. Such pairs bring the members' whole texts to
their hub, large groups in portions, and count common shingles exactly: a link needs 100 * intersection >= 75 * union.
Components of links grow by alternating stars. Bands whose classes even then lie in different components are
searched in full: blocks of their classes compare signatures, one byte per value, of classes in different
components only, and a pair goes on to the exact count if its estimated similarity is at least
``LEAST_ESTIMATE``, more than four standard errors below 0.75. No pair that fails the estimate leaves its task.

Every step is written to the shared folder, so that lost executors repeat one step only.

Nulls: a null or wordless text has an empty set and is linked with nothing; a row with a null doc_id is its
own, with a null component, and kept. Ties: the smallest doc_id stands for a component. Repeated rows: rows of one
doc_id count as one document; differing texts under it are all linked with it. Other columns are carried along by
``deduplicate`` and ignored else. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import write_table
from .text import mix, shingle_set

SHINGLE_WORDS = 5
PERCENT = 75
#: Values in a band: the least and the greatest under three hash functions.
ROWS = 6
BANDS = 72
PERMUTATIONS = BANDS * ROWS // 2
#: Members that one portion of a hub's group has, and classes in a block of a band.
PORTION = 256
BLOCK = 512
LEAST_ESTIMATE = 0.66
#: Size of the table of hashes that rows pass before a join: a value, at most, and a part that is one row (fixed by Spark).
FILTER_BITS = 16
MOST_FILTER_BITS = 1 << 26
_FILTER_PART = 8 * 4_096
#: Shingles hashed at once, which bounds the memory for very long texts.
_AT_ONCE = 2_048

_random = np.random.default_rng(20)
_FIRST = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_SECOND = _random.integers(0, 2**32, PERMUTATIONS, dtype=np.uint32) | np.uint32(1)
_BAND_SEEDS = _random.integers(0, 2**63, BANDS, dtype=np.uint64)

SKETCH_SCHEMA = "doc_id long, n_shingles long, set_high long, set_low long, bands array<long>, signature binary"


def signature(shingles: np.ndarray) -> np.ndarray:
    """Least and greatest value of a non-empty set under each hash function: (PERMUTATIONS, 2)."""
    folded = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    low = np.full(PERMUTATIONS, 2**32 - 1, np.uint32)
    high = np.zeros(PERMUTATIONS, np.uint32)
    for at in range(0, len(folded), _AT_ONCE):
        # Two multiplications modulo 2**32 with a shift between them are a permutation.
        x = folded[None, at : at + _AT_ONCE] * _FIRST[:, None]
        x ^= x >> np.uint32(15)
        x *= _SECOND[:, None]
        np.minimum(low, x.min(axis=1), out=low)
        np.maximum(high, x.max(axis=1), out=high)
    return np.stack([low, high], axis=1)


def band_keys(values: np.ndarray) -> np.ndarray:
    """One key per band of a signature; the band's number is part of it."""
    values = values.reshape(BANDS, ROWS).astype(np.uint64)
    keys = _BAND_SEEDS.copy()
    for k in range(ROWS):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + values[:, k])
    return keys.view(np.int64)


def _sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes, highs, lows, bands, signatures = [], [], [], [], []
        for text in batch.column("text"):
            shingles = shingle_set(text.as_py(), SHINGLE_WORDS)
            digest = np.frombuffer(xxhash.xxh3_128_digest(shingles.tobytes()), np.int64)
            sizes.append(len(shingles))
            highs.append(digest[0])
            lows.append(digest[1])
            values = signature(shingles) if len(shingles) else np.empty((0, 2), np.uint32)
            bands.append(band_keys(values) if len(shingles) else np.empty(0, np.int64))
            signatures.append((values >> np.uint32(12)).astype(np.uint8).tobytes())
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("doc_id"),
                pa.array(sizes, pa.int64()),
                pa.array(highs, pa.int64()),
                pa.array(lows, pa.int64()),
                pa.array(bands, pa.list_(pa.int64())),
                pa.array(signatures, pa.binary()),
            ],
            ["doc_id", "n_shingles", "set_high", "set_low", "bands", "signature"],
        )


def alike(roots: np.ndarray, blocks: np.ndarray, signatures: np.ndarray, earlier: list[set[int]]) -> list[tuple[int, int]]:
    """Places of pairs of different roots, of the two ``blocks`` if there are two, whose estimate is high enough.

    A byte agrees by chance once in 256 times. The most common root is only compared with the others. A pair
    that shares a band of those ``earlier`` searched is named there.
    """
    least = LEAST_ESTIMATE * signatures.shape[1]
    names, place, counts = np.unique(roots, return_inverse=True, return_counts=True)
    common = place == counts.argmax()
    two = blocks.min() != blocks.max()
    found = []
    for i in np.flatnonzero(~common):
        # Pairs among the others come once, from the first of them.
        other = (place != place[i]) & (common | (np.arange(len(roots)) > i))
        if two:
            other &= blocks != blocks[i]
        rows = np.flatnonzero(other)
        agree = np.count_nonzero(signatures[rows] == signatures[i], axis=1)
        found += [(int(i), int(k)) for k in rows[agree >= least] if earlier[i].isdisjoint(earlier[k])]
    return found


def _search_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by band and pair of blocks; at most two blocks are held."""
    current, held = None, []

    def flush() -> pa.RecordBatch:
        reps, roots, blocks, signatures, earlier = zip(*held, strict=True)
        table = np.stack([np.frombuffer(x, np.uint8) for x in signatures])
        pairs = alike(np.array(roots), np.array(blocks), table, [set(x) for x in earlier])
        hubs = [min(reps[a], reps[b]) for a, b in pairs]
        members = [max(reps[a], reps[b]) for a, b in pairs]
        return pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(members, pa.int64())], ["hub", "member"])

    for batch in batches:
        keys = [batch.column(c).to_pylist() for c in ("band", "first", "second")]
        rows = [batch.column(c).to_pylist() for c in ("rep", "root", "block", "signature", "earlier")]
        for key, row in zip(zip(*keys, strict=True), zip(*rows, strict=True), strict=True):
            if key != current and held:
                yield flush()
                held = []
            current = key
            held.append(row)
    if held:
        yield flush()


def _partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def linked(a: np.ndarray, b: np.ndarray) -> bool:
    """100 * intersection >= 75 * union, of two sorted sets; never for an empty one."""
    small, large = sorted((a, b), key=len)
    if not len(small):
        return False
    place = np.minimum(np.searchsorted(large, small), len(large) - 1)
    common = int(np.count_nonzero(large[place] == small))
    return 100 * common >= PERCENT * (len(a) + len(b) - common)


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come sorted by hub and portion, the hub's own first (several, if its doc_id has several texts)."""
    current, hub = None, []
    for batch in batches:
        hubs, members = [], []
        columns = [batch.column(c).to_pylist() for c in ("hub", "portion", "member")]
        for group_hub, portion, member, text in zip(*columns, batch.column("text"), strict=True):
            shingles = shingle_set(text.as_py(), SHINGLE_WORDS)
            if member == group_hub:
                hub = [*hub, shingles] if current == (group_hub, portion) else [shingles]
                current = (group_hub, portion)
            elif current != (group_hub, portion):
                raise ValueError(f"the text of document {group_hub} is missing")
            elif any(linked(shingles, other) for other in hub):
                hubs.append(group_hub)
                members.append(member)
        yield pa.RecordBatch.from_arrays([pa.array(hubs, pa.int64()), pa.array(members, pa.int64())], ["hub", "member"])


def confirm_links(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The (hub, member) pairs of written ``pairs`` that are links, on the whole ``texts`` (doc_id, text)."""
    portions = pairs.groupBy("hub").agg(F.ceil(F.count("*") / PORTION).alias("portions"))
    members = pairs.join(portions, "hub").select(
        F.col("member").alias("doc_id"),
        F.struct("hub", F.pmod(F.xxhash64("member"), "portions").alias("portion")).alias("group"),
    )
    hubs = portions.select(
        F.col("hub").alias("doc_id"),
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("portions") - 1)).alias("portion"),
    ).select("doc_id", F.struct(F.col("doc_id").alias("hub"), "portion").alias("group"))
    return (
        members.unionByName(hubs)
        .join(texts, "doc_id")
        .select("group.hub", "group.portion", F.col("doc_id").alias("member"), "text")
        .repartition(_partitions(pairs.sparkSession), "hub", "portion")
        .sortWithinPartitions("hub", "portion", F.col("member") != F.col("hub"))
        .mapInArrow(_confirm, "hub long, member long")
    )


def among(rows: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """The ``rows`` whose long ``key`` is one of the distinct values of ``wanted``.

    The join shuffles wide rows, so those whose hash no wanted value has are left out before it. The table of
    hashes has about ``FILTER_BITS`` bits a value and never more than ``MOST_FILTER_BITS``: beyond that more rows are shuffled.
    """
    bits = min(MOST_FILTER_BITS, _FILTER_PART * math.ceil(max(1, wanted.count()) * FILTER_BITS / _FILTER_PART))
    place = F.pmod(F.xxhash64(key), F.lit(bits))
    part, at = F.floor(place / _FILTER_PART), place % _FILTER_PART
    table = wanted.select(part.alias("_part"), at.alias("_at")).groupBy("_part").agg(F.bitmap_construct_agg("_at").alias("_bits"))
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = F.call_function("shiftright", byte, (at % 8).cast("int")).bitwiseAND(F.lit(1)) == 1
    near = rows.withColumn("_part", part).join(F.broadcast(table), "_part").filter(is_set).select(*rows.columns)
    # Not a semi join, which the planner would move below the filter.
    return near.join(wanted.hint("merge"), key).select(*rows.columns)


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of ``links`` (hub, member): the smallest node it can reach.

    Alternating stars: first all larger neighbours of a node move to its least neighbour, then the smaller ones
    do; the number of rounds grows with the logarithm of the longest chain.
    """
    edges = write_table(
        links.select(F.greatest("hub", "member").alias("high"), F.least("hub", "member").alias("low")).distinct(),
        "links",
    )
    while True:
        both = edges.unionByName(edges.select(F.col("low").alias("high"), F.col("high").alias("low")))
        least = both.groupBy("high").agg(F.least(F.min("low"), F.col("high")).alias("least"))
        large = (
            both.join(least, "high")
            .filter("low > high")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .distinct()
        )
        large = write_table(large, "large-stars")
        least = large.groupBy("high").agg(F.min("low").alias("least"))
        small = (
            large.join(least, "high")
            .filter("low <> least")
            .select(F.col("low").alias("high"), F.col("least").alias("low"))
            .unionByName(least.select("high", F.col("least").alias("low")))
            .distinct()
        )
        small = write_table(small, "small-stars")
        if _fingerprint(small) == _fingerprint(edges):
            break
        edges = small
    roots = edges.select(F.col("low").alias("node")).distinct().withColumn("root", F.col("node"))
    return edges.select(F.col("high").alias("node"), F.col("low").alias("root")).unionByName(roots)


def _fingerprint(edges: DataFrame) -> tuple:
    """Equal edge sets have equal counts and sums; stars that stay the same are done."""
    h = F.xxhash64("high", "low")
    return tuple(edges.agg(F.count("*"), F.sum(h.cast("decimal(38,0)")), F.bit_xor(h)).first())


def _roots(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` with the component ``root`` of ``rep``, itself where it has no link."""
    found = members.join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    return found.withColumn("root", F.coalesce("root", "rep"))


def find_components(documents: DataFrame) -> DataFrame:
    """doc_id, n_shingles and component_id of every row of ``documents`` (doc_id, text)."""
    spark = documents.sparkSession
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sketches = write_table(texts.mapInArrow(_sketch, SKETCH_SCHEMA), "sketches")
    named = sketches.filter("doc_id is not null and n_shingles > 0")
    # Equal sets are one class, which its smallest doc_id stands for.
    classes = named.groupBy("set_high", "set_low").agg(F.min(F.struct("doc_id", "bands")).alias("least"))
    classes = write_table(
        classes.select("set_high", "set_low", F.col("least.doc_id").alias("rep"), "least.bands"), "classes"
    )
    same = write_table(
        named.select("doc_id", "set_high", "set_low")
        .join(classes.select("set_high", "set_low", "rep"), ["set_high", "set_low"])
        .select("doc_id", "rep"),
        "class-members",
    )
    # Dealt by band once, for the counts and for the classes themselves.
    banded = classes.select("rep", F.explode("bands").alias("band")).repartition("band")
    shared = banded.groupBy("band").agg(F.count("*").alias("n"), F.min("rep").alias("a"), F.max("rep").alias("b"))
    members = write_table(banded.join(shared.filter("a < b").select("band", "n"), "band"), "band-members")
    # Texts of classes that share a band are all that comparisons need; texts are shuffled once, here.
    candidates = write_table(members.select(F.col("rep").alias("doc_id")).distinct(), "candidates")
    texts = texts.filter("doc_id is not null and text is not null")
    texts = write_table(among(texts, "doc_id", candidates), "candidate-texts")
    sizes = named.groupBy(F.col("doc_id").alias("rep")).agg(F.min("n_shingles").alias("least"), F.max("n_shingles").alias("most"))
    ranks = members.groupBy("rep").agg(F.sum("n").alias("degree")).join(sizes, "rep")
    ranks = ranks.select("rep", F.struct("degree", (-F.col("rep")).alias("place"), "least", "most").alias("rank"))
    members = write_table(members.join(ranks, "rep"), "ranked-members")
    # Rows of one doc_id with differing texts lie in several classes, which they link.
    several = same.groupBy("doc_id").agg(F.min("rep").alias("hub"), F.max("rep").alias("last")).filter("hub < last")
    several = several.join(same, "doc_id").filter("rep <> hub").select("hub", F.col("rep").alias("member"))
    offers = _offers(members.withColumn("root", F.col("rep")))
    pairs = write_table(_foremost(offers, "member"), "pairs")
    links = confirm_links(pairs, texts).unionByName(several)
    links = write_table(links, "confirmed")
    roots = write_table(components(links), "roots")
    # Classes whose bands have hubs in other components try the foremost hub of each such component.
    offers = _foremost(_offers(_mixed(members, roots)), "member", "hub_root")
    others = write_table(offers.join(pairs, ["hub", "member"], "left_anti"), "other-pairs")
    pairs = pairs.unionByName(others)
    found = write_table(confirm_links(others, texts), "other-links")
    if not found.isEmpty():
        links = links.unionByName(found)
        roots = write_table(components(links), "roots")
    # Bands whose classes are not all in one component yet are searched in full.
    mixed = write_table(_mixed(members, roots), "mixed-bands")
    more = write_table(_search(mixed, named).join(pairs, ["hub", "member"], "left_anti"), "more-pairs")
    found = write_table(confirm_links(more, texts), "more-links")
    if not found.isEmpty():
        roots = write_table(components(links.unionByName(found)), "roots")
    # Every doc_id has the root of its first class; others of the same doc_id are linked with it.
    component = _roots(same.groupBy("doc_id").agg(F.min("rep").alias("rep")), roots).select(
        "doc_id", F.col("root").alias("component_id")
    )
    return (
        sketches.select("doc_id", "n_shingles")
        .join(component, "doc_id", "left")
        .withColumn("component_id", F.coalesce("component_id", "doc_id"))
    )


def _search(rooted: DataFrame, named: DataFrame) -> DataFrame:
    """Distinct (hub, member) of bands (band, rep, n, root) that may be linked and lie in different components.

    A class goes to a band with its signature and the smaller keys of its bands here only.
    """
    classes = rooted.groupBy("rep").agg(F.sort_array(F.collect_list(F.struct("band", "n", "root"))).alias("places"))
    signatures = among(named.select(F.col("doc_id").alias("rep"), "signature"), "rep", rooted.select("rep").distinct())
    blocks = F.ceil(F.col("n") / BLOCK)
    return (
        classes.join(signatures.distinct(), "rep")
        .select("rep", "signature", F.col("places.band").alias("all"), F.posexplode("places").alias("nth", "at"))
        .select("rep", "signature", "at.*", F.slice("all", F.lit(1), F.col("nth")).alias("earlier"))
        .withColumn("block", F.pmod(F.xxhash64("rep"), blocks))
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
        .withColumn("first", F.least("block", "other"))
        .withColumn("second", F.greatest("block", "other"))
        .select("band", "first", "second", "rep", "root", "block", "signature", "earlier")
        .repartition(_partitions(rooted.sparkSession), "band", "first", "second")
        .sortWithinPartitions("band", "first", "second")
        .mapInArrow(_search_blocks, "hub long, member long")
        .distinct()
    )


def _mixed(members: DataFrame, roots: DataFrame) -> DataFrame:
    """``members`` (band, rep, ...) with their root, of the bands whose classes lie in different components."""
    rooted = _roots(members, roots)
    mixed = rooted.groupBy("band").agg(F.min("root").alias("a"), F.max("root").alias("b")).filter("a < b")
    return rooted.join(mixed.select("band"), "band")


def _offers(rooted: DataFrame) -> DataFrame:
    """(member, degree, place, hub_root) for each band of (band, rep, rank, root): classes of other components than its hub's.

    Sets whose sizes differ by more than the similarity allows can't be linked and are left out.
    """
    hubs = rooted.groupBy("band").agg(F.max(F.struct("rank", "root")).alias("hub"))
    hub, own = F.col("hub.rank"), F.col("rank")
    return (
        rooted.join(hubs, "band")
        .filter(F.col("root") != F.col("hub.root"))
        .filter((100 * hub["most"] >= PERCENT * own["least"]) & (100 * own["most"] >= PERCENT * hub["least"]))
        .select(F.col("rep").alias("member"), hub["degree"].alias("degree"), hub["place"].alias("place"), F.col("hub.root").alias("hub_root"))
    )


def _foremost(offers: DataFrame, *keys: str) -> DataFrame:
    """(hub, member) with the hub of the highest rank for each value of ``keys``."""
    best = offers.groupBy(*keys).agg(F.max(F.struct("degree", "place")).alias("best"))
    return best.select((-F.col("best.place")).alias("hub"), "member")


def deduplicate(documents: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose doc_id stands for its component, one for each doc_id."""
    found = find_components(documents).filter("doc_id = component_id").select("doc_id").distinct()
    unnamed = documents.filter("doc_id is null")
    return documents.join(found, "doc_id", "left_semi").dropDuplicates(["doc_id"]).unionByName(unnamed)
