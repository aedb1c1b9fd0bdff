"""Periodic runs, whitening and decontamination against brute force, with odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import SMALL

import __spark_entry__ as entry
from flowloom.llm import decontamination, periodic_runs, whitening
from flowloom.session import ship_package

DOCUMENTS = "doc_id long, text string, n_runs long, n_hit long, x string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


# periodic runs


def brute_runs(seq):
    """Every maximal stretch of every lag, kept if long enough and if no smaller period holds on it."""
    n, found = len(seq), set()
    for q in range(1, n + 1):
        i = 0
        while i + q < n:
            if seq[i] != seq[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and seq[j] == seq[j + q]:
                j += 1
            start, length = i, j - i + q
            stretch = seq[start : start + length]
            smallest = min(p for p in range(1, q + 1) if all(stretch[k] == stretch[k + p] for k in range(length - p)))
            if smallest == q and length >= max(6, 4 * q):
                found.add((start, length, q))
            i = j + 1
    return sorted(found)


def brute_row(doc_id, text):
    raw = text.encode().split() if text else []
    raw = periodic_runs.planted(None if doc_id is None else str(doc_id), raw)
    runs = brute_runs(raw)
    dropped = {i for s, n, q in runs for i in range(s + q, s + n)}
    collapsed = b" ".join(w for i, w in enumerate(raw) if i not in dropped)
    best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
    return (
        len(runs),
        best,
        hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
        hashlib.sha256(collapsed).hexdigest(),
    )


@pytest.mark.parametrize("seed", range(40))
def test_runs_are_those_of_brute_force(seed):
    rng = random.Random(seed)
    alphabet = rng.randint(1, 4)
    seq = [rng.randrange(alphabet) for _ in range(rng.randint(0, 70))]
    if seed % 3 == 0:  # a planted period amid noise
        q = rng.randint(1, 6)
        seq[10:10] = [100 + k % q for k in range(rng.randint(4 * q, 6 * q))]
    assert periodic_runs.find_runs(np.array(seq, np.int64)) == brute_runs(seq)


def test_a_run_that_spans_rare_words_of_its_neighbours():
    seq = [7, 8, 9] + [1, 2, 3] * 5 + [4, 5] + [1, 2, 3] * 2
    assert periodic_runs.find_runs(np.array(seq, np.int64)) == brute_runs(seq) == [(3, 15, 3)]


def test_planted_documents_follow_the_contract():
    doc_id = next(d for d in range(1000) if zlib.crc32(str(d).encode()) % 10 == 0)
    text = " ".join(f"w{i}" for i in range(200))
    row = periodic_runs.describe(str(doc_id), text)
    assert row[2] >= 1 and (row[2], tuple(row[3:6]), row[7], row[8]) == (
        brute_row(doc_id, text)[0],
        brute_row(doc_id, text)[1],
        *brute_row(doc_id, text)[2:],
    )


def test_periodic_runs_of_odd_rows(spark):
    long_text = ("la li lo " * 3000) + " ".join(f"u{i}" for i in range(5000))  # brute force would take hours
    rows = [
        (1, None),
        (2, ""),
        (3, " \t\n "),
        (4, "A a A a A a A a"),
        (5, "x y x y x y x y x y x y z"),
        (5, "x y x y x y x y x y x y z"),
        (None, "p q p q p q p q p q"),
        (9, long_text),
        (6, "q r s t u v w x y z a b c d e f g h i j"),
        (7, "ab ab ab ab ab ab ab ab"),
        (8, "é è é è é è é è é è"),
    ]
    frame = spark.createDataFrame([(*r, 9, 9, "x") for r in rows], DOCUMENTS)
    found = periodic_runs.find_periodic_runs(frame).collect()
    assert len(found) == len(rows)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in rows:
        if text == long_text:
            continue
        expected = brute_row(doc_id, text)
        got = [(r.n_runs, None if r.start is None else (r.start, r.length, r.period), r.runs_sha256, r.collapsed_sha256) for r in by_id[doc_id]]
        assert expected in got, (doc_id, text[:40] if text else text)
    empty = hashlib.sha256(b"").hexdigest()
    assert [(r.n_runs, r.start, r.runs_sha256, r.collapsed_sha256) for r in by_id[1]] == [(0, None, empty, empty)]
    assert by_id[9][0].collapsed.startswith("la li lo u0")
    assert (by_id[9][0].n_runs, by_id[9][0].start, by_id[9][0].length, by_id[9][0].period) == (1, 0, 9000, 3)
    assert by_id[6][0].collapsed.endswith("e f e f e f")  # planted, crc32 of "6" ends in 0; three periods are no run
    assert periodic_runs.find_periodic_runs(frame.limit(0)).count() == 0


def test_periodic_runs_query_is_brute_force(spark):
    found = {r.doc_id: r for r in entry.queries()["op11_periodic_runs"](spark, SMALL).collect()}
    docs = pq.read_table(f"{SMALL}/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    assert len(found) == len(docs)
    planted = 0
    for d in docs:
        r = found[d["doc_id"]]
        raw = periodic_runs.planted(str(d["doc_id"]), periodic_runs.words(d["text"]))
        planted += zlib.crc32(str(d["doc_id"]).encode()) % 10 == 0
        runs = periodic_runs.find_runs(np.unique(np.array(raw, dtype=object), return_inverse=True)[1] if raw else np.array([]))
        assert r.n_runs == len(runs)
        if len(raw) <= 400:  # the quadratic brute force on the shorter texts
            assert (r.n_runs, None if r.start is None else (r.start, r.length, r.period), r.runs_sha256, r.collapsed_sha256) == brute_row(
                d["doc_id"], d["text"]
            )
        if r.start is not None:
            assert r.exponent_milli == 1000 * r.length // r.period
    assert planted and sum(r.n_runs > 0 for r in found.values()) >= planted // 2


# whitening


@pytest.mark.parametrize(
    "values", [[5, 2, 2 + 1e-9, 2 - 1e-9, 1, 0], [3, 3, 3, 1, 1, 0], [6, 5, 4, 3, 2, 1], [1e-3, 1e-9, 1e-9, 0, 0, 0]]
)
def test_refinement_of_clustered_eigenvalues(values):
    rng = np.random.default_rng(3)
    q, _ = np.linalg.qr(rng.normal(size=(6, 6)))
    values = np.array(values, np.float64)
    a = (q * values) @ q.T
    start = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    lam, x = whitening.refine(a, start)
    x = x.astype(np.float64)
    tiny = values[1] <= 1e-6 * values[0]  # a cluster far below the norm: orthogonal to its share of it
    assert np.abs(x.T @ x - np.eye(6)).max() < (1e-10 if tiny else 1e-15)
    assert np.abs(a @ x - x * lam.astype(np.float64)).max() < 1e-15 * values[0] * 10
    assert np.allclose(lam.astype(np.float64), np.sort(values)[::-1], rtol=0, atol=1e-14 * values[0])


def brute_whitening(rows):
    kept = [
        (v, np.floor(np.array(e, np.float64) * 256).astype(np.int64))
        for v, e in rows
        if e is not None and all(c is not None and np.isfinite(c) for c in e)
    ]
    sizes = {}
    for _, x in kept:
        sizes[len(x)] = sizes.get(len(x), 0) + 1
    d = min(sizes, key=lambda k: (-sizes[k], k))
    kept = [(v, x) for v, x in kept if len(x) == d]
    fit = np.array(sorted({tuple(x) for _, x in kept}), np.float64)
    n = len(fit)
    s = fit.sum(0)
    cov = (fit - s / n).T @ (fit - s / n) / n
    e, vec = np.linalg.eigh(cov)
    return kept, n, s, e[::-1], vec[:, ::-1]


def check_whitened(found, rows):
    kept, n, s, e, vec = brute_whitening(rows)
    assert len(found) == len(kept) * min(4, len(s))
    got = {}
    for r in found:
        got.setdefault((r.vec_id, r.component), []).append(r)
    for vid, x in kept:
        for c in range(min(4, len(s))):
            r = got[vid, c + 1][0]
            assert r.n == n and r.deviation == int(((n * x - s.astype(np.int64)) ** 2).sum())
            assert abs(abs(r.whitened) - abs((x - s / n) @ vec[:, c] / np.sqrt(e[c]))) < 1e-9
            assert abs(r.explained - e[c] / e.sum()) <= 1e-4 * e[c] / e.sum()
            assert r.identity_error <= 1e-4


def test_whitening_of_odd_rows(spark):
    rng = np.random.default_rng(5)
    base = [rng.normal(size=3) * [3, 1, 0.2] for _ in range(30)]
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(base)]
    rows += [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 1.0, 2.0]), (103, [float("inf"), 0.0, 0.0])]
    rows += [(104, [1.0, 2.0]), (105, rows[0][1]), (None, rows[1][1]), (106, [-0.001, 0.0, 0.5])]
    frame = spark.createDataFrame(
        [(v, e, "clash", 1) for v, e in rows], "vec_id long, embedding array<float>, whitened string, n int"
    )
    cast = [(v, None if e is None else [None if c is None else float(np.float32(c)) for c in e]) for v, e in rows]
    check_whitened(whitening.whiten(frame).collect(), cast)
    assert whitening.whiten(frame.limit(0)).count() == 0
    one = whitening.whiten(frame.filter("vec_id in (0, 105)")).collect()
    assert {(r.whitened, r.explained) for r in one} == {(None, None)}


def test_whitening_query_is_brute_force(spark):
    found = entry.queries()["op12_whitening"](spark, SMALL).collect()
    table = pq.read_table(f"{SMALL}/embeddings.parquet").to_pylist()
    check_whitened(found, [(r["vec_id"], r["embedding"]) for r in table])


# decontamination

WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def brute_contamination(text, items):
    words = WORD.findall((text or "").translate(decontamination.LOWER))
    hit, named = set(), set()
    for item_id, item in items:
        if item_id is None:
            continue
        iw = WORD.findall((item or "").translate(decontamination.LOWER))
        if not iw:
            continue
        k = min(10, len(iw))
        grams = {tuple(iw[i : i + k]) for i in range(len(iw) - k + 1)}
        for i in range(len(words) - k + 1):
            if tuple(words[i : i + k]) in grams:
                hit.update(range(i, i + k))
                named.add(item_id)
    return len(words), len(hit), sorted(named)


ITEMS = [
    (1, "What is the capital of France? The capital of France is Paris, a city on the Seine."),
    (2, "Short item: two plus two"),
    (3, "What is the capital of France? The capital of France is Paris, a city on the Seine."),
    (4, None),
    (None, "two plus two is four and more words to make ten of them"),
    (5, "!!! ???"),
    (6, "Ünïcödé wörds ärë wörds tóo, ÄND ÜPPER stays, one two three four five"),
]


def test_contamination_of_odd_rows(spark, monkeypatch):
    texts = [
        (1, "Quiz: WHAT is the capital of france?? the capital of France is Paris, a city on the Seine!"),
        (2, None),
        (3, ""),
        (4, "nothing to see here " * 5000),
        (5, "they said: short item; two plus two."),
        (5, "they said: short item; two plus two."),
        (None, "short item two plus two"),
        (6, "ünïcödé wörds ärë wörds tóo, ÄND ÜPPER stays one two three four five six"),
        (7, "is the capital of France is Paris a city on the"),
    ]
    docs = spark.createDataFrame([(*t, 1, 1, "y") for t in texts], DOCUMENTS)
    bench = spark.createDataFrame([(*i, "clash") for i in ITEMS], "item_id long, text string, n_hit string")
    found = decontamination.find_contamination(docs, bench).collect()
    assert len(found) == len(texts)
    by_id = {}
    for r in found:
        by_id.setdefault(r.doc_id, []).append(r)
    for doc_id, text in texts:
        n_words, n_hit, named = brute_contamination(text, ITEMS)
        assert any((r.n_words, r.n_hit, r.item_ids, r.contaminated) == (n_words, n_hit, named, n_hit > 0) for r in by_id[doc_id])
        for r in by_id[doc_id]:
            for span in r.spans:  # offsets of the original text
                assert WORD.findall(text[span.start : span.end].translate(decontamination.LOWER))
    assert by_id[1][0].item_ids == [1, 3] and by_id[7][0].n_hit == 10  # the last ten words are a window
    monkeypatch.setattr(decontamination, "SHARD_BYTES", 200)
    sharded = {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in decontamination.find_contamination(docs, bench).collect()}
    assert sharded == {(r.doc_id, r.n_words, r.n_hit, tuple(r.item_ids)) for r in found}
    assert decontamination.find_contamination(docs, bench.limit(0)).filter("contaminated").count() == 0
    assert decontamination.find_contamination(docs.limit(0), bench).count() == 0


def test_items_digest():
    assert decontamination.items_digest([10, 9]) == hashlib.sha256(b"10,9").hexdigest()
