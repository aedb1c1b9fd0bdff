"""Searches of codes take few probes, and no code beyond the k-th distance."""

import numpy as np

from flowloom.llm import code_search


def test_segments_hold_several_codes():
    # Probes of one radius multiply with the width; these sizes had 4 and 2 segments of 16 and 32 bits.
    assert len(code_search.segment_bounds(50_125)) == 5
    assert len(code_search.segment_bounds(77_000_000)) == 3
    for n in (0, 1, 2, 10, 1_000, 10**6, 10**9):
        bounds = code_search.segment_bounds(n)
        assert sum(w for _, w in bounds) == 64 and bounds[0][0] == 0


def test_search_of_far_neighbours_and_ties(spark):
    rng = np.random.default_rng(8)
    ids = range(400)
    bits = {i: int(rng.integers(0, 2**63)) for i in ids}
    bits[3] = bits[0] ^ (2**20 - 1)
    codes = spark.createDataFrame(list(bits.items()), "id long, code long")
    found = code_search.search(codes, codes.filter("id % 100 = 0"), k=5)
    want = set()
    for q in (0, 100, 200, 300):
        near = sorted(((bits[q] ^ b).bit_count(), i) for i, b in bits.items())[:5]
        want |= {(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)}
    assert {tuple(r) for r in found.collect()} == want
