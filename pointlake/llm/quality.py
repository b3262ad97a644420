"""Document quality by weak supervision: rules vote or abstain, and a posterior decides instead of all-must-pass."""

from __future__ import annotations

from collections import Counter
from itertools import product

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointlake.llm.common import by_bytes, ids_and_texts, kept_names, kept_schema, session, staged

BATCH_BYTES = 8 << 20
SYMBOLS = "#*$%&|<>"
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper_words", "n_distinct_words"]

#: (rule, value, good up to, bad from): a value at or below the first votes good, at or above the second bad, between
#: them the rule abstains; None: the rule never votes so.
RULES = [
    ("symbols", ("n_symbols", "n_words"), 0.05, 0.25),
    ("repeated_lines", ("n_dup_lines", "n_lines"), 0.1, 0.5),
    ("repeated_words", ("n_repeat_words", "n_words"), 0.2, 0.4),
    ("shouting", ("n_upper_words", "n_words"), 0.1, 0.3),
    ("long_words", ("word_chars", "n_words"), 10.0, 20.0),
    ("few_words", ("n_words", "n_distinct_words"), 6.0, 40.0),
]
#: Pseudo-documents behind each class and each rule's chances in it.
PRIOR_COUNT = 2.0
#: Bounds of a rule's chance to condemn a good document, and a document with the fault it looks for.
MOST_FALSE, LEAST_CAUGHT = 0.01, 0.5
ROUNDS, TOLERANCE = 200, 1e-7


def count_text(text: str) -> tuple[int, ...]:
    """The counts of COUNTS for one text."""
    words = text.encode().split()  # splits at the six ASCII white-space bytes only
    n = len(words)
    spaces = sum(map(text.count, " \t\n\v\f\r"))
    lines = [line for line in text.split("\n") if line.strip(" \t\v\f\r")]
    repeated = 0
    if n > 3:
        windows = Counter(zip(words, words[1:], words[2:]))
        if len(windows) < n - 2:
            end = 0
            for i, w in enumerate(zip(words, words[1:], words[2:])):
                if windows[w] > 1:
                    repeated += i + 3 - max(i, end)
                    end = i + 3
    upper = sum(map(bytes.isupper, words))
    return (n, len(text) - spaces, sum(map(text.count, SYMBOLS)), len(lines) - len(set(lines)), repeated, len(lines), upper, len(set(words)))


def text_counts(rows: DataFrame) -> DataFrame:
    """(doc_id, counts..., kept columns) of (doc_id, text, kept columns) in one narrow Arrow pass."""
    session(rows)
    kept = kept_names(rows)

    def run(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            counts = np.array([count_text(t) for t in batch.column("text").to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, counts.T), *(batch.column(c) for c in kept)], ["doc_id", *COUNTS, *kept]
            )

    return rows.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + kept_schema(rows))


def votes() -> dict[str, Column]:
    """1 (good), 0 (bad) or 2 (abstains) of each rule; a text without words makes all abstain."""
    out = {}
    for rule, (value, per), good, bad in RULES:
        ratio = F.col(value) / F.nullif(F.col(per), F.lit(0))
        out[rule] = F.when(ratio <= good, 1).when(ratio >= bad, 0).otherwise(2)
    return out


def fit(patterns: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(log share per class, log chance per class, rule and vote) by expectation-maximisation over vote patterns.

    Class 0 is good; each rule has a class of its own for the kind of fault it looks for, so that faults which exclude
    each other need not share one class. In each class a rule that votes has a probability of voting bad: its accuracy;
    abstaining says nothing. The search starts from: good unless a rule says bad, else of the kinds of the rules that say so.
    """
    rules = len(RULES)
    classes = np.arange(1, rules + 1)
    if not len(counts):
        patterns, counts = np.ones((1, rules), np.int64), np.ones(1)
    total = counts.sum()
    bad = patterns == 0
    found = bad.sum(1, keepdims=True)
    belongs = np.concatenate([np.where(found, 0.05, 0.95), np.where(found, 0.95 * bad / np.maximum(found, 1), 0.05 / rules)], 1)
    prior_chance = np.tile([0.4, 0.6], (rules + 1, rules, 1))
    prior_chance[0] = [0.002, 0.998]
    prior_chance[classes, classes - 1] = [0.95, 0.05]
    likelihood = None
    for _ in range(ROUNDS):
        weight = counts[:, None] * belongs
        share = (weight.sum(0) + PRIOR_COUNT) / (total + PRIOR_COUNT * (rules + 1))
        chance = np.stack([weight.T @ (patterns == v) for v in range(2)], 2) + PRIOR_COUNT * prior_chance
        chance /= chance.sum(2, keepdims=True)
        # Rules are written to be better than chance; without these bounds classes could swap.
        chance[0, :, 0] = np.minimum(chance[0, :, 0], MOST_FALSE)
        chance[classes, classes - 1, 0] = np.maximum(chance[classes, classes - 1, 0], LEAST_CAUGHT)
        chance[:, :, 1] = 1 - chance[:, :, 0]
        log = np.concatenate([np.log(chance), np.zeros((rules + 1, rules, 1))], 2)
        joint = np.log(share) + sum(log[:, r, patterns[:, r]].T for r in range(rules))
        top = joint.max(1, keepdims=True)
        belongs = np.exp(joint - top)
        new = float(counts @ (top[:, 0] + np.log(belongs.sum(1)))) / total
        belongs /= belongs.sum(1, keepdims=True)
        if likelihood is not None and abs(new - likelihood) < TOLERANCE:
            break
        likelihood = new
    return np.log(share), log


def score_quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: list[str] = ()) -> DataFrame:
    """(doc_id, counts, base_failed, quality, kept) per row, and the columns ``keep`` as keep_0, keep_1, ....

    The vote patterns of all documents (at most 3 to the number of rules) are counted, the rules' accuracies fitted to
    these counts, and every document gets the posterior probability that it is good. Counts are staged once, or with
    columns to keep, which may be the texts, found again rather than copied with them.
    ``kept``: not base_failed and a posterior of at least one half. Null and empty texts have no words and fail the base;
    repeated rows each count and give a row, a null id stays null, an empty table gives none; other columns are
    never read.
    """
    counts = text_counts(ids_and_texts(df, id_col, text_col, keep))
    if keep:
        return judged(counts, text_counts(ids_and_texts(df, id_col, text_col)))
    return judged(staged(counts))


def judged(counts: DataFrame, fitted: DataFrame | None = None) -> DataFrame:
    """The counts with base_failed, quality (posterior) and kept; the rules are fitted to these counts or to ``fitted``."""
    vote = votes()
    seen = (counts if fitted is None else fitted).groupBy(*(c.alias(r) for r, c in vote.items())).count().collect()  # at most 3 ** len(RULES) rows
    share, chance = fit(np.array([r[:-1] for r in seen], np.int64).reshape(-1, len(RULES)), np.array([r[-1] for r in seen], float))
    every = np.array(list(product(range(3), repeat=len(RULES))))
    joint = share + sum(chance[:, r, every[:, r]].T for r in range(len(RULES)))
    good = 1 / np.exp(joint - joint[:, :1]).sum(1)
    code = sum((c * 3 ** (len(RULES) - 1 - r) for r, c in enumerate(vote.values())), F.lit(1))
    quality = F.element_at(F.array(*map(F.lit, good.tolist())), code)
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    out = counts.withColumn("base_failed", failed).withColumn("quality", quality)
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("quality") >= 0.5))
