"""The similarity join of shingle sets against all pairs."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from pointlake.llm import jaccard


def plain_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def plain_components(rows, width, percent):
    """(doc, size, smallest id) per row by comparing all pairs."""
    sets = [plain_set(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and min(len(a), len(b)) * 100 >= percent * max(len(a), len(b)):
                both = len(a & b)
                if 100 * both >= percent * (len(a) + len(b) - both):
                    parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return Counter((doc, len(sets[i]), smallest.get(root(i)) if sets[i] else doc) for i, (doc, _) in enumerate(rows))


def found(df, **how):
    return Counter((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.similar_documents(df, **how).collect())


def families(rng, count=60, boilerplate=True):
    """Texts with copies at all distances, some made of passages that very many of them share."""
    words = [f"w{k}" for k in range(400)]
    passage = rng.choices(words, k=150)
    out = []
    for f in range(count):
        base = passage[:] + rng.choices(words, k=rng.randint(0, 25)) if boilerplate and f % 2 else rng.choices(words, k=rng.choice([5, 9, 12, 30, 80, 200, 330]))
        for _ in range(rng.randint(1, 8)):
            copy = base[:]
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randint(0, 1)] = rng.choices(words, k=rng.randint(0, 2))
            out.append(" ".join(w.upper() if rng.random() < 0.1 else w for w in copy))
    return out


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (1, 60)])
def test_components_equal_all_pairs(hard, hard_rows, width, percent):
    assert found(hard, width=width, percent=percent) == plain_components(hard_rows, width, percent)


def test_components_of_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == plain_components([(r.doc_id, r.text) for r in docs.collect()], 3, 90)


@pytest.mark.parametrize("hot", [False, True])
def test_families_with_frequent_tokens(spark, monkeypatch, hot):
    """Tokens in more than 64 sets are indexed by pairs; with low limits also those that are never dealt out."""
    rows = list(enumerate(families(random.Random(8))))
    if hot:
        monkeypatch.setattr(jaccard, "HOT_LEAST", 3)
        monkeypatch.setattr(jaccard, "HOT_SHARE", 100)
        monkeypatch.setattr(jaccard, "HELD_TOKENS", 3000)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert found(df) == plain_components(rows, 3, 90)


def test_nothing_and_blanks(spark):
    schema = "doc_id long, text string, key int, n string"
    assert found(spark.createDataFrame([], schema)) == Counter()
    rows = [(1, None, 0, ""), (2, "", 0, ""), (2, " \n", 0, ""), (None, "", 0, "")]
    assert found(spark.createDataFrame(rows, schema)) == Counter([(1, 0, 1), (2, 0, 2), (2, 0, 2), (None, 0, None)])


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_similar_sets_share_an_entry(monkeypatch, percent):
    """Over random sets with frequent, rare and hot tokens."""
    monkeypatch.setattr(jaccard, "RARE_UPTO", 5)
    rng = np.random.default_rng(percent)
    kept = 0
    for _ in range(600):
        size = int(rng.integers(8, 400))
        a = rng.choice(3000, size, replace=False).astype(np.uint64)
        drop = int(rng.integers(0, max(1, (100 - percent) * size // 150) + 1))
        b = np.unique(np.concatenate([a[drop:], rng.choice(3000, int(rng.integers(0, drop + 1)), replace=False).astype(np.uint64) + np.uint64(5000)]))
        a = np.unique(a)
        if not jaccard.similar(a, b, percent) or np.array_equal(a, b):
            continue
        kept += 1
        seen_of = rng.integers(2, 12, 9000)
        seen_of[rng.random(9000) < 0.3] = jaccard.HOT
        entries = []
        for x in (a, b):
            seen = seen_of[x.astype(np.int64)]
            seen[x >= 5000] = 1
            own = seen > 1
            entries.append(set(jaccard.prefix_signatures(x[own], seen[own], len(x), int((seen == jaccard.HOT).sum()), percent).tolist()))
        assert entries[0] & entries[1]
    assert kept > 100


def test_hashes_do_not_depend_on_batches(monkeypatch):
    texts = ["The quick  brown\tfox", "", "the QUICK brown fox", " x ", "ähre Ähre ÄHRE " * 50, "one " * 3000 + "two " * 500, "\xa0 a\x0bb\x0cc"]
    whole = list(jaccard.shingle_sets(pa.array(texts), 3))
    assert [len(x) for x in whole] == [len(plain_set(t, 3)) for t in texts]
    assert np.array_equal(whole[0], whole[2])
    jaccard._powers.cache_clear()
    monkeypatch.setattr(jaccard, "PIECE_BYTES", 200)
    cut = [x for t in texts for x in jaccard.shingle_sets(pa.array([t]), 3)]
    jaccard._powers.cache_clear()
    assert all(np.array_equal(a, b) for a, b in zip(whole, cut))
