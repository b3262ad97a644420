"""Quality counts and verdicts, licence places and labels, against plain Python."""

import math
import re
from collections import Counter

import duckdb
import numpy as np

from pointlake.llm import licenses, quality


def plain_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(i, i + 3)}
    seen, dup, lines = set(), 0, 0
    for line in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            lines += 1
            dup += line in seen
            seen.add(line)
    upper = sum(w.encode().isupper() for w in words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered), lines, upper, len(set(words)))


def test_counts_and_base(hard, hard_rows):
    out = quality.score_quality(hard, keep=["lang", "kept"])
    got = Counter((r.doc_id, *(r[c] for c in quality.COUNTS), r.base_failed) for r in out.collect())
    want = Counter()
    for i, t in hard_rows:
        c = plain_counts(t)
        want[(i, *c, c[0] < 50 or 100 * c[4] > 50 * c[0])] += 1
    assert got == want
    assert not any(r.kept and r.base_failed for r in out.collect()) and {"keep_0", "keep_1"} <= set(out.columns)
    assert quality.score_quality(hard.where("false")).collect() == []


def test_verdicts_agree_with_labels(spark):
    """Held-out accuracy: the labels are never read by the operator."""
    folder = "/root/testdata/sf0.01"
    docs = quality.score_quality(spark.read.parquet(f"{folder}/documents.parquet"))
    rows = docs.join(spark.read.parquet(f"{folder}/labels.parquet"), "doc_id").where("NOT base_failed").collect()
    good = [r.kept for r in rows if r.quality_1 == 1] if "quality_1" in docs.columns else None
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r.doc_id: r.kept for r in docs.where("NOT base_failed").collect()}
    good = [kept[d] for d, q in labels.items() if q == 1 and d in kept]
    bad = [kept[d] for d, q in labels.items() if q == 0 and d in kept]
    assert sum(good) >= 0.99 * len(good) and sum(bad) <= 0.1 * len(bad) and rows is not None


def test_fit_separates_faults_and_bears_few_rows():
    rules = len(quality.RULES)
    clean = np.ones((1, rules), np.int64)
    faults = np.ones((rules, rules), np.int64)
    np.fill_diagonal(faults, 0)
    for scale in (1, 1000):
        patterns, counts = np.concatenate([clean, faults]), np.array([90.0] + [5.0] * rules) * scale
        share, log = quality.fit(patterns, counts)
        joint = share + sum(log[:, r, patterns[:, r]].T for r in range(rules))
        good = 1 / np.exp(joint - joint[:, :1]).sum(1)
        assert good[0] > 0.9 and (good[1:] < 0.5).all()
    share, log = quality.fit(np.zeros((0, rules), np.int64), np.zeros(0))
    assert all(map(math.isfinite, share))
    # All documents alike and good, or without any vote: they stay.
    for value in (1, 2):
        share, log = quality.fit(np.full((1, rules), value), np.array([50.0]))
        assert share[0] > max(share[1:])


NOTICES = [
    "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "GNU GENERAL PUBLIC LICENSE",
    "mit license mit LICENSE", "general\npublic-license é mit\tlicense", "mitlicense", "mit é license", "Licensed under CC BY-NC 4.0.",
    "This work is licensed under the GNU General Public License, version 3.", "permission is hereby granted, free of charge, to any person obtaining a copy",
    "licensed the under apache license", "apache apache license license", "", None, "MIT", "general public license general public license",
]


def plain_base(text):
    lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)
    places = []
    for phrase, label in [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]:
        want = phrase.split()
        places += [(i, label) for i in range(len(words)) if words[i : i + len(want)] == want]
    starts = [i for i, _ in places]
    return (len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places})))


def test_base_places(spark, hard, hard_rows):
    rows = hard_rows + [(1000 + i, t) for i, t in enumerate(NOTICES)]
    df = hard.select("doc_id", "text").union(spark.createDataFrame([(1000 + i, t) for i, t in enumerate(NOTICES)], "doc_id long, text string"))
    df = df.selectExpr("*", "'x' AS label", "'y' AS row", "1 AS start")
    out = licenses.scan_licenses(df).collect()
    assert Counter((r.doc_id, r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in out) == Counter((i, *plain_base(t)) for i, t in rows)
    assert all(set(filter(None, r.base_labels.split(","))) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1 for r in out)
    labels = {r.doc_id: r.labels for r in out if r.doc_id is not None and r.doc_id >= 1000}
    assert [labels[1000 + i] for i in (0, 1, 2, 7, 8, 9, 10)] == ["mit", "apache", "gpl", "cc-by-nc", "gpl", "mit", "apache"]
    assert licenses.scan_licenses(df.where("false")).collect() == []


def test_same_rows_as_sql(spark, tmp_path):
    every = " and ".join(n for _, n, _ in licenses.NOTICES)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*NOTICES * 2, every, every[:400]])], "doc_id long, text string")
    docs.toPandas().to_parquet(tmp_path / "d.parquet")
    want = duckdb.sql(licenses.oracle(f"read_parquet('{tmp_path}/d.parquet')")).fetchall()
    assert Counter(want) == Counter(tuple(r) for r in licenses.scan_licenses(docs).collect())


def test_file_of_many_licences(spark):
    """Each notice of a file that lists them all is found, as it is alone."""
    notices = [n for _, n, _ in licenses.NOTICES]
    rows = [(0, " filler words here ".join(notices)), *((i, n) for i, n in enumerate(notices, 1))]
    out = {r.doc_id: r for r in licenses.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert out[0].labels == ",".join(sorted({label for label, _, _ in licenses.NOTICES})) and out[0].score == 1
    assert all(label in out[i].labels.split(",") for i, (label, _, _) in enumerate(licenses.NOTICES, 1))
