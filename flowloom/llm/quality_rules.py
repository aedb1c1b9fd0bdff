"""Quality rules whose thresholds carry a guarantee.

A few fixed base rules reject at once. Further rules compare a share of each text with a cutoff, and the
cutoffs are chosen for each stratum (``lang``) on all labelled documents, which serve as holdout: nothing
else is fitted to them. A combination of cutoffs, at most one for each rule, is taken if so few false rejections (good
documents that any of its cutoffs rejects, among all good ones) are improbable at the rate ``risk``; equivalently, if their
exact (Clopper-Pearson) upper bound is at most ``risk``. Two families of tests share a stratum's level:

- the ladder, with ``LADDER`` of it: from no cutoff on, the rules in the order of ``RULES``, and of each the cutoffs from the
  mildest, are added one by one. False rejections can only become more, the order is fixed, and testing ends at the
  first that fails, so one level serves all steps. Where labels are few this reaches as far as the symbols go.
- all combinations of cutoffs, with the rest of it divided by their number. Where labels are many this goes on from the
  end of the ladder, past a cutoff that fails, to further rules.

The level is divided by the number of strata that have enough good labels for a test (Bonferroni; how many labels there are
tells nothing of false rejections). With probability ``1 - level`` at most ``risk`` of the good documents of every stratum are
then rejected by these rules. A stratum with too few labels gets no rule. Labels are counted by Spark; only one count per
stratum and combination of exceeded cutoffs reaches the driver, at most 17,640 a stratum, and a stratum with fewer good labels
than any test needs is not among them.

Nulls: a null text has no words and fails the base rules; a null lang is a stratum of its own; a null label
counts nowhere, nor does a label of a null doc_id. Repeated rows: each is judged; several labels of a document
count as several. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import window_hashes, word_hashes, words

#: Characters that count as symbols, a fixed value.
SYMBOLS = b"#*$%&|<>"
WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
RISK = 0.01
LEVEL = 0.05
#: The ladder's part of a stratum's level.
LADDER = 0.9

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_marks", "n_upper", "n_lines")
#: For each rule the counts whose per-mille share it bounds, and its cutoffs from the mildest.
RULES: dict[str, tuple[str, str, tuple[int, ...]]] = {
    "symbols": ("n_symbols", "word_chars", (500, 300, 200, 150, 100, 80, 60, 50, 40)),
    "marks": ("n_marks", "word_chars", (500, 300, 200, 150, 100, 80)),
    "upper": ("n_upper", "word_chars", (900, 800, 700, 600, 500)),
    "repeats": ("n_repeat_words", "n_words", (190, 170, 150, 130, 110, 90)),
    "lines": ("n_dup_lines", "n_lines", (800, 700, 600, 500, 400)),
}

_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_UPPER = (np.arange(256) >= 65) & (np.arange(256) <= 90)


def text_counts(text: str | None) -> tuple[int, ...]:
    """``COUNTS`` of a whole text: ``n_marks`` are exclamation and question marks, ``n_upper`` letters A-Z."""
    data = (text or "").encode("utf-8", "replace")
    tokens = words(data)
    n = len(tokens)
    if not n:
        return (0,) * len(COUNTS)
    per_byte = np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    # A code point has one byte that doesn't continue another.
    chars = int(per_byte[:128].sum() + per_byte[192:].sum() - per_byte[_SPACE].sum())
    lines = [x for x in data.split(b"\n") if x.strip(b" \t\n\r\x0b\x0c")]
    repeated = 0
    if n >= WINDOW:
        windows = window_hashes(word_hashes(tokens), WINDOW)
        _, place, counts = np.unique(windows, return_inverse=True, return_counts=True)
        change = np.zeros(n + 1, np.int64)
        again = np.flatnonzero(counts[place] > 1)
        if len(again):
            change[: len(windows)][again] += 1
            np.subtract.at(change, again + WINDOW, 1)
            repeated = int(np.count_nonzero(np.cumsum(change[:n])))
    return (
        n,
        chars,
        int(per_byte[_SYMBOL].sum()),
        len(lines) - len(set(lines)),
        repeated,
        int(per_byte[33] + per_byte[63]),
        int(per_byte[_UPPER].sum()),
        len(lines),
    )


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = [n for n in batch.schema.names if n != "text"]
        rows = np.array([text_counts(t.as_py()) for t in batch.column("text")], np.int64).reshape(-1, len(COUNTS))
        columns = [batch.column(n) for n in names] + [pa.array(rows[:, k]) for k in range(len(COUNTS))]
        yield pa.RecordBatch.from_arrays(columns, [*names, *COUNTS])


def count_texts(documents: DataFrame) -> DataFrame:
    """doc_id, lang and ``COUNTS`` of every whole text."""
    kinds = dict(documents.dtypes)
    schema = f"doc_id {kinds['doc_id']}, lang string, " + ", ".join(f"{c} long" for c in COUNTS)
    chosen = documents.select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    return chosen.mapInArrow(_count, schema)


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def _exceeds(rule: str, cutoff: Column | int) -> Column:
    part, whole, _ = RULES[rule]
    return 1000 * F.col(part) > cutoff * F.col(whole)


def binomial_at_most(k: int, n: int, p: float) -> float:
    """P(X <= k) for X ~ Binomial(n, p), exact up to rounding."""
    if k >= n:
        return 1.0
    logs = [
        math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p) + (n - i) * math.log1p(-p)
        for i in range(k + 1)
    ]
    return min(1.0, math.fsum(map(math.exp, logs)))


def choose_cutoffs(
    counts: dict[tuple[str | None, str], tuple[int, list[int]]], risk: float = RISK, level: float = LEVEL
) -> dict[tuple[str | None, str], int]:
    """The strictest cutoff by (stratum, rule) that counts of single rules prove, each with an equal part of risk and level.

    ``choose_joint_cutoffs`` proves more where documents can be counted by all rules together. ``counts`` has the good documents of the stratum and, by cutoff, how many of them it rejects.
    """
    share = risk / len(RULES)
    each = level / max(1, len(counts))
    chosen = {}
    for (stratum, rule), (good, rejected) in counts.items():
        for cutoff, k in zip(RULES[rule][2], rejected, strict=True):
            # More false rejections than the rate allows on average can't be evidence below it.
            if k > good * share or binomial_at_most(k, good, share) > each:
                break
            chosen[stratum, rule] = cutoff
    return chosen


def least_good(strata: int, risk: float = RISK, level: float = LEVEL) -> float:
    """Good labels that the ladder's tests need without a false rejection, if the level is divided by ``strata``."""
    return math.log(LADDER * level / strata) / math.log1p(-risk)


def _false_rejections(profiles: dict[tuple[int, ...], int], taken: list[int]) -> int:
    return sum(n for profile, n in profiles.items() if any(t > first for t, first in zip(taken, profile, strict=True)))


def choose_joint_cutoffs(
    profiles: dict[str | None, dict[tuple[int, ...], int]], risk: float = RISK, level: float = LEVEL
) -> dict[tuple[str | None, str], int]:
    """The strictest proven cutoffs by (stratum, rule).

    ``profiles`` has, for each stratum, the number of good documents by the place of the mildest cutoff of each rule that
    they exceed (the number of cutoffs if none).
    """
    good = {s: sum(p.values()) for s, p in profiles.items()}
    # As many strata as can all be tested, those with the most labels.
    sizes = sorted(good.values(), reverse=True)
    strata = max((m for m in range(1, len(sizes) + 1) if sizes[m - 1] >= least_good(m, risk, level)), default=0)
    if not strata:
        return {}
    ladder = LADDER * level / strata
    combinations = math.prod(len(cutoffs) + 1 for _, _, cutoffs in RULES.values())
    any_of_all = (1 - LADDER) * level / strata / combinations
    chosen = {}
    for stratum, of_stratum in profiles.items():
        n = good[stratum]
        if n < least_good(strata, risk, level):
            continue

        def proven(taken: list[int], each: float, n: int = n, of_stratum: dict[tuple[int, ...], int] = of_stratum) -> bool:
            k = _false_rejections(of_stratum, taken)
            # More false rejections than the rate allows on average can't be evidence below it.
            return k <= n * risk and binomial_at_most(k, n, risk) <= each

        taken, on_ladder = [0] * len(RULES), True
        for i, (_, _, cutoffs) in enumerate(RULES.values()):
            for c in range(1, len(cutoffs) + 1):
                stricter = [*taken[:i], c, *taken[i + 1 :]]
                on_ladder = on_ladder and proven(stricter, ladder)
                if not on_ladder and not proven(stricter, any_of_all):
                    break
                taken = stricter
        chosen |= {(stratum, r): RULES[r][2][t - 1] for r, t in zip(RULES, taken, strict=True) if t}
    return chosen


def fit_cutoffs(
    counted: DataFrame, labels: DataFrame, risk: float = RISK, level: float = LEVEL
) -> dict[tuple[str | None, str], int]:
    """Cutoffs from all labelled rows of ``counted`` (``count_texts``) that pass the base rules."""
    good = labels.filter("quality = 1 and doc_id is not null").select("doc_id")
    firsts = [
        reduce(lambda found, c, r=r: found - _exceeds(r, c).cast("int"), cutoffs, F.lit(len(cutoffs))).alias(f"first_{r}")
        for r, (_, _, cutoffs) in RULES.items()
    ]
    names = [f"first_{r}" for r in RULES]
    rows = (
        counted.filter(~base_failed())
        .join(good, "doc_id")
        .select("lang", *firsts)
        .groupBy("lang", *names)
        .agg(F.count("*").alias("n"))
        .groupBy("lang")
        .agg(F.sum("n").alias("good"), F.collect_list(F.struct(*names, "n")).alias("profiles"))
        .filter(F.col("good") >= least_good(1, risk, level))
        .collect()
    )
    profiles = {row["lang"]: {tuple(p[:-1]): p["n"] for p in row["profiles"]} for row in rows}
    return choose_joint_cutoffs(profiles, risk, level)


def judge(counted: DataFrame, cutoffs: dict[tuple[str | None, str], int]) -> DataFrame:
    """``counted`` with base_failed and kept."""
    failed = base_failed()
    rejected = F.lit(False)
    for rule in RULES:
        of_rule = {s: c for (s, r), c in cutoffs.items() if r == rule}
        named = {s: c for s, c in of_rule.items() if s is not None}
        cutoff = F.lit(None).cast("int")
        if named:
            table = F.create_map(*map(F.lit, chain.from_iterable(named.items())))
            cutoff = F.try_element_at(table, F.col("lang"))
        if None in of_rule:
            cutoff = F.when(F.col("lang").isNull(), F.lit(of_rule[None])).otherwise(cutoff)
        rejected = rejected | F.coalesce(_exceeds(rule, cutoff), F.lit(False))
    return counted.withColumn("base_failed", failed).withColumn("kept", ~failed & ~rejected)


def passes(counts: tuple[int, ...], lang: str | None, cutoffs: dict[tuple[str | None, str], int]) -> bool:
    """The verdict of ``judge`` on the counts of one text."""
    c = dict(zip(COUNTS, counts, strict=True))
    if c["n_words"] < MIN_WORDS or 100 * c["n_repeat_words"] > MAX_REPEAT_PERCENT * c["n_words"]:
        return False
    found = ((c[part], c[whole], cutoffs.get((lang, rule))) for rule, (part, whole, _) in RULES.items())
    return not any(cutoff is not None and 1000 * n > cutoff * of for n, of, cutoff in found)


def keep_documents(documents: DataFrame, cutoffs: dict[tuple[str | None, str], int]) -> DataFrame:
    """The rows of ``documents`` (text, lang, ...) that pass; nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            both = zip(batch.column("text"), batch.column("lang").to_pylist(), strict=True)
            yield batch.filter(pa.array([passes(text_counts(t.as_py()), lang, cutoffs) for t, lang in both], pa.bool_()))

    return documents.mapInArrow(run, documents.schema)
