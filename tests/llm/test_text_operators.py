"""Each operator on small tables with odd rows: nulls, empty and long texts, ties, repeats, clashing names."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from flowloom.llm import (
    code_search,
    language_id,
    license_scan,
    mixing,
    near_dup,
    packing,
    quality_rules,
    revisits,
    token_files,
    tokens,
    toxicity,
)
from flowloom.session import scratch_path, ship_package, write_table

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long, words string, row string"


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    ship_package(spark)


def documents(spark, rows):
    """Rows (doc_id, text[, lang[, source]]) with further columns whose names the operators use themselves."""
    full = [(*r, *(None,) * (4 - len(r)), None, "x", "y") for r in rows]
    return spark.createDataFrame(full, DOCUMENTS).coalesce(2)


def text_of(*numbers):
    return " ".join(f"w{n}" for n in numbers)


# Near duplicates

NEAR = [
    (5, text_of(*range(40))),
    (3, text_of(*range(39), 99)),  # near 5
    (9, text_of(*range(40)).upper()),  # equal to 5 but for case
    (9, text_of(*range(40)).upper()),  # repeated row
    (7, text_of(*range(100, 140))),
    (1, None),
    (2, ""),
    (4, " \n\t "),
    (6, "Too few words"),
    (8, "too  few\nwords"),  # equal to 6
    (None, text_of(*range(40))),
    (10, "x" * 100_000),
]


def brute_components(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        if doc_id is not None:
            words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate({c: c + 32 for c in range(65, 91)}))
            size = min(5, len(words)) or 1
            sets.setdefault(doc_id, []).append({tuple(words[i : i + size]) for i in range(len(words) - size + 1)})
    root = {d: d for d in sets}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and any(
                x and y and 100 * len(x & y) >= 75 * len(x | y) for x in sets[a] for y in sets[b]
            ):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: find(d) for d in ids}


def test_near_duplicates(spark):
    found = near_dup.find_components(documents(spark, NEAR)).collect()
    assert len(found) == len(NEAR)
    assert {r.doc_id: r.component_id for r in found if r.doc_id is not None} == brute_components(NEAR)
    sizes = {r.doc_id: r.n_shingles for r in found}
    assert (sizes[1], sizes[2], sizes[4], sizes[6], sizes[5], sizes[10]) == (0, 0, 0, 1, 36, 1)
    kept = near_dup.deduplicate(documents(spark, NEAR))
    assert kept.columns == documents(spark, NEAR).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 2, 3, 4, 6, 7, 10]


def test_near_duplicates_beyond_the_hub(spark):
    """Two pairs of which no one is like the hub of their bands, and a doc_id with two texts that links them."""
    rng = np.random.default_rng(0)
    base = list(range(200))
    rows = []
    for k in range(30):  # a chain: neighbours are alike, the ends are not
        rows.append((100 + k, text_of(*base[k * 5 : k * 5 + 100])))
    rows += [(200, text_of(*rng.integers(0, 10_000, 50))), (200, text_of(*range(500, 560)))]
    rows += [(201, text_of(*range(500, 561)))]
    found = {r.doc_id: r.component_id for r in near_dup.find_components(documents(spark, rows)).collect()}
    assert found == brute_components(rows)


def test_near_duplicates_of_nothing(spark):
    assert near_dup.find_components(documents(spark, [])).collect() == []
    assert near_dup.deduplicate(documents(spark, [])).collect() == []


def test_min_and_max_estimate_the_similarity():
    rng = np.random.default_rng(1)
    values = rng.integers(0, 2**64, 400, dtype=np.uint64)
    a, b = np.unique(values[:300]), np.unique(values[100:])
    same = (near_dup.signature(a) == near_dup.signature(b)).mean()
    assert abs(same - 0.5) < 0.08


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 90)], "hub long, member long")
    found = {r.node: r.root for r in near_dup.components(links).collect()}
    assert found == {i: 0 for i in range(41)} | {90: 90, 100: 90}


# Licences


@pytest.fixture(scope="module")
def classifier():
    rng = np.random.default_rng(2)
    return license_scan.train([text_of(*rng.integers(0, 500, 12)) for _ in range(400)])


def test_licences(spark, classifier):
    notice = "Released under the MIT License."
    rows = [
        (1, f"{text_of(*range(30))}\n{notice}\n{text_of(*range(9))}"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, "Licensed under CC BY 4.0."),
        (4, text_of(*range(50))),
        (5, None),
        (6, ""),
        (7, "the license of the driver\nthe general public"),
        (8, "x " * 50_000 + "\n" + notice + "\nThis work is licensed under the GNU General Public License, version 3."),
        (1, notice),
        (None, notice),
    ]
    found = license_scan.scan(documents(spark, rows), classifier).collect()
    got = sorted((r.doc_id or 0, r.family, r.n_notices) for r in found)
    assert got == [
        (0, "mit", 1), (1, "mit", 1), (1, "mit", 1), (2, "cc-by-nc", 1), (3, "cc-by", 1), (4, "unknown", 0),
        (5, "unknown", 0), (6, "unknown", 0), (7, "unknown", 0), (8, got[9][1], 2),
    ]
    assert next(r.families for r in found if r.doc_id == 8) == ["gpl", "mit"]
    assert next(r.paragraph for r in found if r.doc_id == 1 and r.paragraph) == 1
    assert license_scan.scan(documents(spark, []), classifier).collect() == []


GPL = """
# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License, or
# (at your option) any later version."""
MIT = """
 * Permission is hereby granted, free of charge, to any person obtaining
 * a copy of this software and associated documentation files (the
 * "Software"), to deal in the Software without restriction, including
 * without limitation the rights to use, copy, modify, merge, publish"""
BSD = """
// Redistribution and use in source and binary forms, with or
// without modification, are permitted provided that the following
// conditions are met:"""


def test_wrapped_licences_and_those_within_long_lines(spark, classifier):
    rng = np.random.default_rng(5)
    long = [text_of(*rng.integers(0, 500, 2_500)) for _ in range(2)]
    notice = "This work is licensed under the GNU General Public License, version 3."
    rows = [
        (1, "x = 1" + GPL),
        (2, "/*" + MIT),
        (3, BSD + "\n\ny = 2"),
        (4, f"{long[0]} {notice} {long[1]}"),
        (5, f"{long[0]}\n{GPL}\n\n{long[1]}\n{MIT}\n\n{BSD}"),
        # Words of a notice that blank lines or other words keep apart are none.
        (6, "\n\n".join(notice.split())),
        (7, f" {text_of(*range(60))} ".join(notice.split())),
        (8, f"{notice}\n" * 3),
    ]
    found = {r.doc_id: r for r in license_scan.scan(documents(spark, rows), classifier).collect()}
    want = {1: ["gpl"], 2: ["mit"], 3: ["bsd"], 4: ["gpl"], 5: ["bsd", "gpl", "mit"], 6: [], 7: [], 8: ["gpl"]}
    assert {d: r.families for d, r in found.items()} == want
    assert [found[d].n_notices for d in sorted(found)] == [1, 1, 1, 1, 3, 0, 0, 3]
    assert found[3].paragraph == 1 and found[4].paragraph == 0


def test_licences_without_a_corpus(spark):
    assert license_scan.fit(documents(spark, [])).classify("Licensed under CC BY 4.0.")[0][1] == "cc-by"


# Language


def language_rows(n=160):
    rng = np.random.default_rng(3)
    kinds = {"aa": ["kala", "mato", "suri"], "bb": ["strungt", "plimpf", "grotzk"]}
    return [
        (i, " ".join(kinds[lang][j] for j in rng.integers(0, 3, 60)), lang)
        for i in range(n)
        for lang in [["aa", "bb"][i % 2]]
    ]


def test_language(spark):
    rows = language_rows() + [(1000, None, "aa"), (1001, "123 456", "aa"), (1002, "kala", None), (None, "kala mato", "bb")]
    rows += [(1003, "strungt " * 20_000, None), (1003, "strungt " * 20_000, None), (1004, "", None)]
    table = documents(spark, rows)
    net = language_id.fit(table)
    assert net.languages == ["aa", "bb"]
    found = language_id.identify(table, net).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: (r.lang_pred, r.score) for r in found}
    assert all(by_id[i][0] == lang for i, _, lang in language_rows())
    assert by_id[1000] == by_id[1001] == by_id[1004] == ("und", 0.0)
    assert by_id[1003][0] == "bb" and 0.9 < by_id[1003][1] <= 1
    kept = language_id.keep_documents(table, net, 0.5)
    assert kept.columns == table.columns and kept.count() == len(rows) - 3
    assert language_id.fit(documents(spark, [])) is None
    assert [r.lang_pred for r in language_id.identify(table.limit(3), None).collect()] == ["und"] * 3
    assert language_id.identify(documents(spark, []), net).collect() == []


def test_language_gradients():
    rng = np.random.default_rng(1)
    windows = rng.integers(0, 255, (6, language_id.WINDOW)).astype(np.uint8)
    target = np.array([0, 1, 2, 0, 1, 2])
    net = language_id.train(windows, target, ["a", "b", "c"], steps=3)
    data = np.ascontiguousarray(windows.T[:12]).astype(np.intp)
    _, gradients = language_id.loss_and_gradients(net, data, target)
    for array, gradient in zip((net.inputs, net.recurrent, net.output, net.bias), gradients, strict=True):
        flat = array.reshape(-1)
        at = int(np.abs(np.asarray(gradient)).argmax())
        old, step = flat[at], 0.05
        flat[at] = old + step
        up, _ = language_id.loss_and_gradients(net, data, target)
        flat[at] = old - step
        down, _ = language_id.loss_and_gradients(net, data, target)
        flat[at] = old
        assert (up - down) / (2 * step) == pytest.approx(float(np.asarray(gradient).reshape(-1)[at]), rel=0.05)


def test_languages_of_short_texts_are_learned(spark):
    """A corpus whose second language has only texts of 40 bytes, and one with nothing else."""
    rows = [(i, text if lang == "aa" else text[:40], lang) for i, text, lang in language_rows()]
    short = [(i, text[:40], lang) for i, text, lang in rows]
    for table in (documents(spark, rows), documents(spark, short)):
        net = language_id.fit(table)
        assert net.languages == ["aa", "bb"]
        found = {r.doc_id: r.lang_pred for r in language_id.identify(table, net).collect()}
        assert found == {i: lang for i, _, lang in rows}
        assert language_id.keep_documents(table, net, 0.5).count() == len(rows)


def test_padding_changes_no_gradient():
    rng = np.random.default_rng(6)
    net = language_id.train(rng.integers(0, 255, (6, 128)).astype(np.uint8), np.arange(6) % 3, ["a", "b", "c"], steps=3)
    data, target = rng.integers(0, 255, (9, 6)), np.arange(6) % 3
    padded = np.concatenate([data, rng.integers(0, 255, (5, 6))])
    mask = (np.arange(14)[:, None] < np.full(6, 9)).astype(np.float32)
    loss, want = language_id.loss_and_gradients(net, data, target)
    with_padding, found = language_id.loss_and_gradients(net, padded, target, mask)
    assert with_padding == pytest.approx(loss, rel=1e-5)
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(want, found, strict=True))


def test_windows_do_not_depend_on_other_texts():
    rng = np.random.default_rng(4)
    net = language_id.train(rng.integers(0, 255, (20, 128)).astype(np.uint8), np.arange(20) % 2, ["a", "b"], steps=3)
    texts = ["short", "x" * 128, "y" * 1000, None, "z" * 300_000]
    together = language_id.document_probabilities(net, texts)
    for i, text in enumerate(texts):
        assert np.allclose(together[i], language_id.document_probabilities(net, [text])[0], atol=1e-4)
    assert np.allclose(together[[0, 1, 2, 4]].sum(axis=1), 1, atol=1e-3)


# Token ids

ODD_TEXTS = [
    "", "a  b", "  x\n\n y \t z", "don't  we'll\n\n\n", "x\x85y", "é́ ́z", "A B", "<|endoftext|> a<|endoftext|>b <|ENDOFTEXT|>",
    "ΑΣ ΣΑΣ.", "12 345 6", "\n", " ", "a \n b", "Straße İx", "🙂🙂 ok", "AÁ'S 'S don'T ... a.,b ½ x²", "\x1cq w\x00e", "a" * 500,
    "\xa0x \xa0 y", "tab\there\r\nand  there ", "ﬁ Ⅷ ａｂｃ",
]


@pytest.mark.parametrize("name, rule", [("word_bpe_49k.json", tokens.WORDS), ("byte_bpe_50k.json", tokens.SPACED)])
def test_cached_ids_are_the_library_ids(spark, name, rule):
    from conftest import SMALL
    from tokenizers import Tokenizer

    path = public_tokenizers.path(name)
    plain, cached = Tokenizer.from_file(path), tokens.CachedEncoder(path, rule, cache_entries=50)
    texts = [r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("text").limit(60).collect()]
    for text in ODD_TEXTS + texts + ["".join(ODD_TEXTS)]:
        want = np.array(plain.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        assert cached.encode(text) == want, text
    assert cached.encode(None) == b""


def test_simple8b():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n, bits = int(rng.integers(0, 400)), int(rng.integers(1, 65))
        ids = rng.integers(0, 2**64, n, dtype=np.uint64) >> rng.integers(64 - bits, 64, n).astype(np.uint64)
        assert (token_files.decode(token_files.encode(ids), n) == ids).all()
    assert len(token_files.encode(np.ones(600, np.uint64))) == 10
    big = np.array([2**64 - 1, 0, 2**60, 2**60 - 1], np.uint64)
    assert (token_files.decode(token_files.encode(big), 4) == big).all()
    a, b = b"some bytes", b"and more of them"
    assert token_files.crc32_combine(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)


ROWS = [(4, "one two"), (2, None), (9, "long " * 3_000), (2, "again"), (7, ""), (None, "no id"), (4, "one two")]


def ids_of(name, text):
    from tokenizers import Tokenizer

    ids = Tokenizer.from_file(public_tokenizers.path(name)).encode(text or "", add_special_tokens=False).ids
    return np.array([*ids, 1], "<u4")


def test_token_files(spark):
    out = scratch_path(spark, "test-files")
    path = public_tokenizers.path("word_bpe_49k.json")
    token_files.write_token_files(documents(spark, ROWS), out, path, tokens.WORDS, block_ids=500)
    found = sorted(token_files.read_documents(spark, out).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == [None, 2, 2, 4, 4, 7, 9]
    start = 0
    for r in found:
        assert r.start == start
        start += r.n_tokens
    want = sorted((len(i), zlib.crc32(i.tobytes())) for i in (ids_of("word_bpe_49k.json", t) for _, t in ROWS))
    assert sorted((r.n_tokens, r.ids_crc32) for r in found) == want
    blocks = token_files.read_blocks(spark, out)
    assert blocks.agg(F.max("n_ids")).first()[0] <= 500
    whole = [ids for b in blocks.orderBy("part", "block_start").collect() for *_, ids in token_files.block_ids_of(b.asDict())]
    assert sum(map(len, whole)) == start
    empty = scratch_path(spark, "test-empty")
    token_files.write_token_files(documents(spark, []), empty, path, tokens.WORDS)
    assert token_files.read_documents(spark, empty).collect() == []


# Packing


def test_packing(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    pieces = write_table(packing.cut_documents(documents(spark, ROWS), path, tokens.SPACED, keep_ids=True), "pieces")
    packed = packing.pack(pieces).collect()
    want = sorted(len(ids_of("byte_bpe_50k.json", t)) for _, t in ROWS)
    assert sorted(r.doc_tokens for r in packed if r.start == 0) == want
    assert sum(r.length for r in packed) == sum(want)
    by_sequence = {}
    for r in packed:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for places in by_sequence.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= packing.CAPACITY
    lengths = packing.sequence_lengths(packing.pack(pieces)).collect()
    assert all(r.padded in (r.tokens, packing.CAPACITY) and r.padded & (r.padded - 1) == 0 for r in lengths)
    empty = write_table(packing.cut_documents(documents(spark, []), path, tokens.SPACED), "pieces")
    assert packing.pack(empty).collect() == []


def test_plan_places_every_piece_once():
    rng = np.random.default_rng(0)
    for _ in range(30):
        histogram = {int(n): int(rng.integers(1, 50)) for n in rng.integers(1, 101, 40)}
        slots, ranks, fill = packing.plan_packs(histogram, 100), {}, {}
        for length, first, packs, pack, offset in slots:
            for k in range(packs):
                ranks.setdefault(length, []).append(first + k)
                fill.setdefault(pack + k, []).append((offset, length))
        assert {n: sorted(r) for n, r in ranks.items()} == {n: list(range(c)) for n, c in histogram.items()}
        for places in fill.values():
            assert sum(n for _, n in places) <= 100
            assert [o for o, _ in sorted(places)] == [sum(n for _, n in sorted(places)[:i]) for i in range(len(places))]
    assert packing.plan_packs({}) == []


# Mixing


def test_mixing(spark):
    rows = [(i, text_of(*range(20)), None, "big" if i < 80 else "small" if i < 95 else None) for i in range(100)]
    rows += [(200, None, None, "big"), (201, "", None, "new"), (None, "a b c", None, "small"), (3, text_of(*range(20)), None, "big")]
    table = documents(spark, rows).withColumnRenamed("n_chars", "tokens")  # a name used inside
    draws, quotas = mixing.mixture(table, entropy=0.9, repeats=3.0)
    plan = {r.source_key: r for r in quotas.collect()}
    assert set(plan) == {"s:big", "s:small", "n"}
    shares = np.array([plan[k].weight for k in sorted(plan)])
    assert shares.sum() == pytest.approx(1)
    entropy = -(shares * np.log(shares)).sum() / np.log(3)
    assert entropy >= 0.9 - 1e-9 or max(r.quota / r.tokens for r in plan.values()) == pytest.approx(3.0, rel=0.02)
    assert max(r.quota / r.tokens for r in plan.values()) <= 3.0 + 1e-9
    got = draws.collect()
    for key, r in plan.items():
        own = sorted((d.tokens_before, d.n_tokens) for d in got if d.source_key == key)
        assert [b for b, _ in own] == list(np.cumsum([0, *[n for _, n in own]])[:-1])
        assert own[-1][0] < r.quota <= own[-1][0] + own[-1][1]
    mixed = mixing.mix(table, entropy=0.9, repeats=3.0)
    assert mixed.columns == table.columns
    # Both rows of document 3 are drawn whenever it is.
    assert mixed.count() == len(got) + sum(d.doc_id == 3 for d in got)
    assert mixing.mix(documents(spark, [])).collect() == []


def test_mixing_runs_no_python(spark):
    draws, _ = mixing.mixture(documents(spark, [(1, "a b", None, "s")]))
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


# Toxicity


def test_toxicity(spark):
    rng = np.random.default_rng(5)
    rows, labels = [], []
    for i in range(400):
        group, insult = rng.random(2) < 0.4
        words = [f"v{k}" for k in rng.integers(0, 50, 20)] + ["groupword"] * int(group) + ["insultword"] * int(insult)
        rows.append((i, " ".join(words)))
        labels.append((i, int(group and insult), 1))
    rows += [(1000, None), (1001, ""), (None, "insultword groupword"), (1002, "insultword groupword " * 20_000), (1002, "x")]
    labels += [(None, 1, 1), (5, None, 1)]
    table = documents(spark, rows)
    machine = toxicity.fit(table, spark.createDataFrame(labels, "doc_id long, toxic int, text int"))
    found = toxicity.score(table, machine).collect()
    assert len(found) == len(rows) and all(0 <= r.score <= 1 for r in found)
    scores = {}
    for r in found:
        scores.setdefault(r.doc_id, []).append(r.score)
    truth = {i: t for i, t, _ in labels[:400]}
    assert np.mean([(scores[i][0] >= 0.5) == bool(t) for i, t in truth.items()]) > 0.98
    assert scores[None][0] > 0.5 and max(scores[1002]) > 0.5 and scores[1000] == scores[1001]
    nothing = toxicity.fit(table, spark.createDataFrame([], "doc_id long, toxic int"))
    assert nothing is None and {r.score for r in toxicity.score(table, nothing).collect()} == {0.0}
    assert toxicity.score(documents(spark, []), machine).collect() == []


# Revisits

RECORD = "record_id long, record_type string, target_uri string, warc_date timestamp, http_headers string, payload_digest string, payload string, url int, at int"


def test_revisits(spark):
    from datetime import datetime, timedelta

    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    full = "HTTP/1.1 200 OK\r\nETag: W/\"a\"\r\nContent-Length: 9\r\nX-Old: 1\r\n"
    rows = [
        (1, "response", "http://www.Host.org/p/?b=2&a=1&utm_source=x#f", day(0), full, "d1"),
        (2, "response", "https://host.org:443/p?a=1&b=2", day(5), full.replace("W/\"a\"", '"b"'), "d2"),
        (3, "response", "https://host.org/p?a=1&b=2", day(6), "HTTP/1.1 404 Not Found\r\n", "d3"),
        (10, "revisit", "host.org/p?b=2&a=1", day(3), "HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\nContent-Length: 0\r\nX-Old: 2\r\nDate: now\r\n", None),
        (11, "revisit", "http://host.org/p?b=2&a=1", day(9), "HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\n", None),
        (12, "revisit", "http://host.org/p?b=2&a=1", day(9), None, None),
        (13, "revisit", "http://host.org/p?b=2&a=1", day(0), None, None),
        (14, "revisit", None, day(9), None, None),
        (15, "revisit", "http://host.org/p?b=2&a=1", None, None, None),
        (16, "revisit", "http://other.org/", day(9), None, None),
        (10, "revisit", "host.org/p?b=2&a=1", day(3), "HTTP/1.1 304 Not Modified\r\nETag: \"a\"\r\nContent-Length: 0\r\nX-Old: 2\r\nDate: now\r\n", None),
    ]
    records = spark.createDataFrame([(*r, "body", 1, 2) for r in rows], RECORD)
    found = {}
    for r in revisits.resolve(records).collect():
        found.setdefault(r.record_id, []).append((r.referred_id, r.status, r.payload_digest))
        if r.record_id == 10:
            assert r.headers == 'content-length: 9\ndate: now\netag: "a"\nx-old: 2'
    assert found == {
        10: [(1, "resolved", "d1")] * 2,
        11: [(2, "validator_mismatch", None)],
        12: [(2, "no_validator", "d2")],
        13: [(None, "no_earlier_response", None)],
        14: [(None, "no_earlier_response", None)],
        15: [(None, "no_earlier_response", None)],
        16: [(None, "no_earlier_response", None)],
    }
    bodies = revisits.with_payloads(revisits.resolve(records), records)
    assert {r.payload for r in bodies.filter("referred_id is not null").collect()} == {"body"}
    assert revisits.resolve(records.limit(0)).collect() == []


# Code search


def test_code_search(spark):
    rng = np.random.default_rng(6)
    centres = rng.normal(size=(5, 16))
    rows = [(i, (centres[i % 5] + rng.normal(size=16) * 0.6).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)]  # one very common vector
    rows += [(7, rows[7][1]), (None, rows[1][1]), (2000, None), (2001, []), (2002, [float("nan")] * 16), (2003, [None] * 16)]
    vectors = spark.createDataFrame(rows, "id long, v array<float>")
    codes = vectors.select("id", code_search.code("v").alias("code"), F.lit(1).alias("segment"))
    found = code_search.search(codes, codes.filter("id % 50 = 0"), k=7)
    bits = [(i, np.array(v) > 0) for i, v in rows if i is not None and v and v[0] is not None and v[0] == v[0]]
    want = set()
    for q, x in bits:
        if q % 50 == 0:
            near = sorted((int((x != y).sum()), i) for i, y in bits)[:7]
            want |= {(q, rank + 1, i, d) for rank, (d, i) in enumerate(near)}
    assert {tuple(r) for r in found.collect()} == want
    few = codes.filter("id < 3")
    assert code_search.search(few, few, k=7).count() == 9
    assert code_search.search(few.limit(0), few).collect() == []


# Quality rules


def brute_counts(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def test_counts():
    texts = [None, "", " \n ", "a b", "é ü\n\né ü\n é ü", "a b c d e f a b c d e g a b c d e", "#x $$ <>|&%*", "x " * 30, "a\x1cb\x85c \x0bd"]
    for text in texts:
        assert quality_rules.text_counts(text)[:5] == brute_counts(text), text


def test_binomial():
    from math import comb

    for n, p in ((30, 0.1), (7, 0.5)):
        for k in range(n + 1):
            want = sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
            assert quality_rules.binomial_at_most(k, n, p) == pytest.approx(want, abs=1e-9)
    assert quality_rules.binomial_at_most(0, 2000, 0.002) == pytest.approx(0.998**2000)


def test_cutoffs_are_proven():
    rejected = lambda *ks: [*ks, *[10**6] * 20]
    counts = {
        ("en", r): (20_000, rejected(0, 1, 5, 60)[: len(quality_rules.RULES[r][2])]) for r in quality_rules.RULES
    } | {("xx", "symbols"): (100, [0] * 9)}
    chosen = quality_rules.choose_cutoffs(counts)
    # 20000 * 0.01 / 5 are 40 allowed false rejections: 5 are proof, 60 are not; 100 labels prove nothing.
    assert chosen == {("en", r): quality_rules.RULES[r][2][2] for r in quality_rules.RULES}


def test_quality_rules(spark):
    rng = np.random.default_rng(7)
    rows, labels = [], []
    for i in range(9000):
        good = i % 5 > 0
        words = [f"w{k}" for k in rng.integers(0, 10_000, 14)]
        rows.append((i, " ".join(words if good else [w + "###" for w in words]), "en"))
        labels.append((i, int(good)))
    rows += [(20_000, None, "en"), (20_001, "", None), (20_002, text_of(*range(50)) + " ### ###", None), (None, text_of(*range(50)), "en")]
    rows += [(20_003, text_of(*range(20)) * 2, "de"), (20_003, text_of(*range(20)), "de")]
    table = documents(spark, rows)
    judged = spark.createDataFrame([(*x, 9) for x in labels + [(None, 1), (3, None)]], "doc_id long, quality int, lang int")
    counted = write_table(quality_rules.count_texts(table), "counts")
    cutoffs = quality_rules.fit_cutoffs(counted, judged)
    assert ("en", "symbols") in cutoffs and {s for s, _ in cutoffs} == {"en"}
    kept = {}
    for r in quality_rules.judge(counted, cutoffs).collect():
        kept.setdefault(r.doc_id, []).append(r.kept)
    assert all(kept[i] == [bool(g)] for i, g in labels)
    assert kept[20_000] == kept[20_001] == [False] and kept[20_002] == [True] == kept[None]
    assert sorted(kept[20_003]) == [False, True]
    rest = quality_rules.keep_documents(table, cutoffs)
    assert rest.columns == table.columns
    assert rest.count() == sum(sum(k) for k in kept.values())
    assert quality_rules.fit_cutoffs(counted, judged.limit(0)) == {}
    assert quality_rules.keep_documents(documents(spark, []), cutoffs).collect() == []


def test_few_labels_prove_cutoffs_of_symbols(spark):
    """A language with 500 good labels and one with 2,000, whose cutoffs take effect; 350 labels prove nothing beside them."""
    rows, labels = [], []
    for lang, n in (("en", 2000), ("fr", 500), ("es", 350)):
        for k in range(n + 40):
            marked = k >= n or (lang == "fr" and k < 2)  # two good ones that a strict cutoff rejects
            words = [f"w{k}x{j}" for j in range(14)]
            rows.append((len(rows), " ".join(w + ("#" if k < n else "###") if marked else w for w in words), lang))
            labels.append((len(labels), int(k < n)))
    counted = write_table(quality_rules.count_texts(documents(spark, rows)), "counts")
    cutoffs = quality_rules.fit_cutoffs(counted, spark.createDataFrame(labels, "doc_id long, quality int"))
    assert {s for s, _ in cutoffs} == {"en", "fr"} and cutoffs["en", "symbols"] == 40 and cutoffs["fr", "symbols"] == 200
    kept = {r.doc_id: r.kept for r in quality_rules.judge(counted, cutoffs).collect()}
    assert [kept[i] for i, g in labels if rows[i][2] != "es"] == [bool(g) for i, g in labels if rows[i][2] != "es"]
    assert all(kept[i] for i, _ in labels if rows[i][2] == "es")


def test_joint_cutoffs_keep_to_the_whole_risk():
    none = tuple(len(c) for _, _, c in quality_rules.RULES.values())
    # All cutoffs from the strictest of symbols on have 30 of 20,000 false rejections, other rules 90 each at their strictest.
    profiles = {none: 20_000 - 30 - 4 * 90, (8, *none[1:]): 30}
    for i in range(1, 5):
        profiles[(*none[:i], none[i] - 1, *none[i + 1 :])] = 90
    chosen = quality_rules.choose_joint_cutoffs({"en": profiles})
    taken = [quality_rules.RULES[r][2].index(chosen["en", r]) + 1 for r in quality_rules.RULES]
    k = quality_rules._false_rejections(profiles, taken)
    assert k == 120 and set(chosen) == {("en", r) for r in quality_rules.RULES}
    assert quality_rules.choose_joint_cutoffs({"en": {none: 300}}) == {}
