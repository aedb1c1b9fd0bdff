"""Exact top-k search among binary codes by incremental multi-index hashing.

A vector's code has one bit per dimension, set where the value is above 0. Codes are cut into segments of about
log2(number of codes / ``PER_VALUE``) bits, and an index holds every distinct code under each of its segments. A search looks
up all segment values at radius 0 of the query's, then 1, 2 and so on, one segment after the other. A code not met up to radius r
in segment j differs in r + 1 bits or more in the segments up to j and in r or more in the others, so all codes within
``segments * r + j`` were met; a query is done once its k-th verified distance is no more than that. Only
unfinished queries go on, and they take no code that lies beyond the k-th distance they have. A pair is verified once: in
the first step that meets it.

A probe is a row that is made, shuffled and sorted, a code it meets is a comparison in the join. Segments so
narrow that a value has several codes therefore cost less than those of log2(number of codes) bits, whose probes multiply with the
radius.

Equal vectors share a code, of which the index needs the ``k`` smallest ids only, so a very common vector costs no more than
others. Results are ordered by distance, then id; a query row finds itself as well.

Nulls: rows with a null id, or whose vector is null, empty or has a null or NaN, have no code: they neither search nor are found.
Ties in distance go to smaller ids. Repeated rows are found as often as they come. Other columns are ignored. An
empty table gives an empty result; fewer than k rows give them all.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import write_table

BITS = 64
K = 10
#: Codes that a segment value has on average, about.
PER_VALUE = 8


def code(vector: Column | str) -> Column:
    """The code of a vector of at most ``BITS`` dimensions as a long; null for one that has none."""
    v = F.col(vector) if isinstance(vector, str) else vector
    bits = F.aggregate(
        F.transform(v, lambda x, i: F.when(x > 0, F.call_function("shiftleft", F.lit(1).cast("long"), i)).otherwise(F.lit(0).cast("long"))),
        F.lit(0).cast("long"),
        lambda a, b: a.bitwiseOR(b),
    )
    sound = (F.size(v) > 0) & (F.size(v) <= BITS) & ~F.exists(v, lambda x: x.isNull() | F.isnan(x))
    return F.when(v.isNotNull() & sound, bits)


def segment_bounds(codes: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of segments of about log2(codes / PER_VALUE) bits."""
    n = max(1, min(bits // 8, round(bits / math.log2(max(2, codes / PER_VALUE)))))
    ends = [bits * i // n for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:], strict=False)]


def _segment(value: Column, first: int, width: int) -> Column:
    mask = (1 << width) - 1 if width < 64 else -1
    return F.shiftrightunsigned(value, first).bitwiseAND(F.lit(mask).cast("long"))


def _apart(a: Column, b: Column, first: int, width: int) -> Column:
    return F.bit_count(_segment(a.bitwiseXOR(b), first, width))


def search(codes: DataFrame, queries: DataFrame, k: int = K) -> DataFrame:
    """query_id, rank (from 1), neighbor_id and distance; ``codes`` and ``queries`` have id and code."""
    by_id = Window.partitionBy("code").orderBy("id")
    entries = (
        codes.filter("id is not null and code is not null")
        .withColumn("nth", F.row_number().over(by_id))
        .filter(F.col("nth") <= k)
        .groupBy("code")
        .agg(F.sort_array(F.collect_list("id")).alias("ids"))
        .withColumn("least", F.col("ids")[0])
    )
    entries = write_table(entries, "codes")
    bounds = segment_bounds(entries.count())
    parts = [F.struct(F.lit(j).alias("segment"), _segment(F.col("code"), *b).alias("value")) for j, b in enumerate(bounds)]
    index = write_table(entries.select("code", "least", F.explode(F.array(*parts)).alias("s")).select("s.*", "code", "least"), "code-index")
    asked = queries.filter("id is not null and code is not null")
    # Until a query has k rows no distance is too far.
    open_queries = asked.select(F.col("code").alias("query"), F.lit(BITS).alias("bound")).distinct()
    open_queries = write_table(open_queries, "open-queries")
    best = None
    by_distance = Window.partitionBy("query").orderBy("distance", "least")
    nearer = Window.partitionBy("query").orderBy("distance").rangeBetween(Window.unboundedPreceding, 0)
    wanted = min(k, entries.agg(F.sum(F.size("ids"))).first()[0] or 0)
    every = list(range(len(bounds)))
    # Low radii take few probes, so all segments at once; later ones go segment by segment.
    steps = [(0, every), (1, every)]
    steps += [(r, [j]) for r in range(2, max(w for _, w in bounds) + 1) for j in every]
    for radius, segments in steps:
        # Masks of ``radius`` bits: each bit is below the one before it, so every mask comes once.
        own = [
            F.struct(F.lit(j).alias("segment"), _segment(F.col("query"), *bounds[j]).alias("value"), F.lit(bounds[j][1]).alias("low"))
            for j in segments
        ]
        probes = open_queries.select("query", "bound", F.explode(F.array(*own)).alias("s")).select("query", "bound", "s.*")
        for _ in range(radius):
            probes = probes.filter("low > 0").select(
                "query", "bound", "segment", "value", F.explode(F.sequence(F.lit(0), F.col("low") - 1)).alias("low")
            )
            probes = probes.withColumn("value", F.expr("value ^ shiftleft(1L, low)"))
        # Probes are many more than the planner can see, so none of the sides may be broadcast.
        met = probes.hint("merge").join(index.filter(F.col("segment").isin(segments)), ["segment", "value"])
        is_new = F.lit(True)
        for i, b in enumerate(bounds):
            least = F.when(F.col("segment") > i, radius + 1).otherwise(radius)
            is_new = is_new & (_apart(F.col("query"), F.col("code"), *b) >= least)
        distance = F.bit_count(F.col("query").bitwiseXOR(F.col("code"))).cast("int")
        found = met.filter(is_new & (distance <= F.col("bound"))).select("query", "code", "least", distance.alias("distance"))
        if best is not None:
            found = found.unionByName(best)
        # Codes beyond the first k can't be among the k nearest rows.
        found = found.withColumn("nth", F.row_number().over(by_distance)).filter(F.col("nth") <= k).drop("nth")
        best = write_table(found, "nearest")
        rows = best.join(entries.select("code", F.size("ids").alias("rows")), "code")
        covered = len(bounds) * radius + segments[-1]
        reached = rows.withColumn("so_far", F.sum("rows").over(nearer)).filter(F.col("so_far") >= wanted)
        reached = reached.groupBy("query").agg(F.min("distance").alias("kth"))
        # Fewer than k rows are all there is; else the k-th has to be covered.
        done = F.coalesce((F.col("kth") <= covered) | F.lit(wanted < k), F.lit(False))
        open_queries = open_queries.select("query").join(reached, "query", "left").filter(~done)
        open_queries = write_table(open_queries.select("query", F.coalesce("kth", F.lit(BITS)).alias("bound")), "open-queries")
        if open_queries.isEmpty():
            break
    ranked = (
        best.join(entries, "code")
        .select("query", "distance", F.explode("ids").alias("neighbor_id"))
        .withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor_id")))
        .filter(F.col("rank") <= k)
    )
    return asked.select(F.col("id").alias("query_id"), F.col("code").alias("query")).join(ranked, "query").select(
        "query_id", "rank", "neighbor_id", "distance"
    )
