"""Members of a group of near copies are paired with few hubs, and every link is still found."""

import random

from flowloom.llm import near_dup
from flowloom.llm.text import shingle_set


def test_pairs_of_a_group_of_near_copies(spark, monkeypatch):
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(150):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randint(1, 3)):
            words[at] = f"x{i}-{at}"
        rows.append((i, " ".join(words)))
    rows += [(1000 + i, " ".join(f"y{i}-{k}" for k in range(30))) for i in range(20)]
    counts, confirm = [], near_dup.confirm_links

    def counted(pairs, texts):
        counts.append(pairs.count())
        return confirm(pairs, texts)

    monkeypatch.setattr(near_dup, "confirm_links", counted)
    documents = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.component_id for r in near_dup.find_components(documents).collect()}
    sets = {i: set(shingle_set(t, near_dup.SHINGLE_WORDS).tolist()) for i, t in rows}
    root = {i: i for i in sets}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for k in sets:
            if i < k and 100 * len(sets[i] & sets[k]) >= 75 * len(sets[i] | sets[k]):
                a, b = sorted((top(i), top(k)))
                root[b] = a
    assert found == {i: top(i) for i in sets}
    assert sum(counts) <= 300
