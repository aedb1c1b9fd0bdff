"""The registered text queries and the pipeline on the small tables, against brute force where SQL can't express them."""

import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from conftest import SMALL
from test_text_operators import brute_components, brute_counts

import __spark_entry__ as entry
import corpus_pipeline
from flowloom.llm import quality_rules
from flowloom.session import write_table


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}


@pytest.fixture(scope="module")
def labels(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}


def rows_of(spark, name):
    return entry.queries()[name](spark, SMALL).collect()


def token_ids(name, texts):
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(public_tokenizers.path(name)).encode_batch(texts, add_special_tokens=False)
    return [np.array([*x.ids, 1], "<u4") for x in found]


def test_all_are_registered():
    names = {f"op{n}" for n in range(1, 14)}
    assert {n.split("_")[0] for n in entry.queries() if n.startswith("op")} == names
    assert "pipeline" in entry.queries()


def test_token_files(spark, docs):
    found = {r.doc_id: r for r in rows_of(spark, "op4_token_files")}
    start = 0
    for doc_id, ids in zip(sorted(docs), token_ids("word_bpe_49k.json", [docs[d].text for d in sorted(docs)]), strict=True):
        r = found.pop(doc_id)
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    assert not found


def check_packed(rows, expected):
    """``expected`` counts (doc_id, ids as bytes) of the documents to pack."""
    texts = {d: np.frombuffer(b, "<u4") for d, b in expected}
    starts = Counter((r.doc_id, r.start) for r in rows)
    for (doc_id, data), n in expected.items():
        size, at = len(data) // 4, 0
        assert n == starts[doc_id, 0]
        while at < size:
            own = {(r.length, r.ids_crc32, r.doc_tokens) for r in rows if r.doc_id == doc_id and r.start == at}
            ((length, crc, total),) = own
            assert total == size and crc == zlib.crc32(texts[doc_id][at : at + length].tobytes())
            assert starts[doc_id, at] == n
            at += length
        assert at == size
    fill = {}
    for r in rows:
        fill.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in fill.values():
        assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
        assert sum(n for _, n in places) <= 2048
    return sum(r.length for r in rows) / (2048 * len(fill))


def test_packing(spark, docs):
    ids = token_ids("byte_bpe_50k.json", [d.text for d in docs.values()])
    expected = Counter((d, i.tobytes()) for d, i in zip(docs, ids, strict=True))
    assert check_packed(rows_of(spark, "op5_packing"), expected) > 0.97


def test_quality_rules(spark, docs):
    found = rows_of(spark, "op10_quality_rules")
    assert len(found) == len(docs)
    for r in found:
        want = brute_counts(docs[r.doc_id].text)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert not (r.base_failed and r.kept)


def test_language(spark, docs):
    found = rows_of(spark, "op3_language_id")
    held = [r for r in found if r.held_out]
    assert {r.doc_id for r in held} == {d for d in docs if zlib.crc32(str(d).encode()) % 4 == 2}
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in held]) > 0.95
    assert all(0 <= r.score <= 1 for r in found) and len(found) == len(docs)


def test_toxicity(spark, docs, labels):
    found = {r.doc_id: r for r in rows_of(spark, "op7_toxicity")}
    assert set(found) == set(docs)
    for doc_id, r in found.items():
        assert r.held_out == (zlib.crc32(str(doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == (r.score >= 0.5)
    learned = [(found[d].score, x.toxic) for d, x in labels.items() if not found[d].held_out and x.toxic is not None]
    toxic, clean = ([s for s, t in learned if t == k] for k in (1, 0))
    assert np.mean(toxic) > np.mean(clean)


def test_licences(spark, docs):
    known = {"mit": "MIT License", "apache": "Apache License", "cc-by-nc": "CC BY-NC", "gpl": "GNU General Public"}
    for r in rows_of(spark, "op2_license_scan"):
        want = {f for f, words in known.items() if words in docs[r.doc_id].text}
        assert set(filter(None, r.families.split(","))) - {"proprietary"} == want


def test_pipeline(spark, docs):
    """Each stage against its own input."""
    names, tables = [], [spark.read.parquet(f"{SMALL}/documents.parquet")]
    columns = tables[0].columns
    for name, stage in corpus_pipeline.STAGES:
        names.append(name)
        tables.append(write_table(stage(spark, tables[-1], SMALL), "stage"))
        assert name == corpus_pipeline.STAGES[-1][0] or tables[-1].columns == columns
    raw, good, spoken, single, mixed, packed = [t.collect() for t in tables]
    # No label proves a cutoff on so few documents: the base rules decide.
    def base(text):
        words, *_, repeated = brute_counts(text)
        return words >= 10 and 100 * repeated <= 20 * words

    assert sorted(r.doc_id for r in good) == sorted(r.doc_id for r in raw if base(r.text))
    assert {r.doc_id for r in spoken} == {r.doc_id for r in good if re.search(r"[^\W\d_]", r.text)}
    groups = brute_components([(r.doc_id, r.text) for r in spoken])
    assert sorted(r.doc_id for r in single) == sorted(d for d, root in groups.items() if d == root)
    times = Counter(r.doc_id for r in mixed)
    assert set(times) <= {r.doc_id for r in single}
    by_source = {}
    for r in single:
        by_source.setdefault(r.source, []).append(times[r.doc_id])
    assert all(max(t) - min(t) <= 1 for t in by_source.values())  # full passes and a part of one more
    texts = {r.doc_id: r.text for r in mixed}
    ids = dict(zip(texts, token_ids("byte_bpe_50k.json", list(texts.values())), strict=True))
    check_packed(packed, Counter({(d, ids[d].tobytes()): n for d, n in times.items()}))


def test_kept_documents_are_those_that_the_rules_judge(spark, docs):
    table = spark.read.parquet(f"{SMALL}/documents.parquet")
    cutoffs = {("en", "symbols"): 40, ("fr", "upper"): 500, ("de", "marks"): 80, (None, "lines"): 400}
    judged = quality_rules.judge(quality_rules.count_texts(table), cutoffs).filter("kept").select("doc_id").collect()
    kept = quality_rules.keep_documents(table, cutoffs).select("doc_id").collect()
    assert sorted(r.doc_id for r in judged) == sorted(r.doc_id for r in kept)
