"""SimHash components and removal of repeated passages against plain Python."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from xxhash import xxh64_intdigest

from pointlake.llm import simhash, suffix


def plain_fingerprint(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))
    shingles = [" ".join(words[i : i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(rows, width, radius):
    """Smallest id per row by comparing all pairs of fingerprints."""
    prints = [plain_fingerprint(t, width) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if bin(prints[i] ^ prints[j]).count("1") <= radius:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return Counter((doc, prints[i], smallest.get(root(i))) for i, (doc, _) in enumerate(rows))


@pytest.mark.parametrize("radius", [0, 4, 12])
def test_components_equal_all_pairs(hard, hard_rows, radius):
    rows = simhash.near_duplicates(hard, width=4, radius=radius).collect()
    assert Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in rows) == plain_components(hard_rows, 4, radius)
    assert Counter(r.component_id for r in rows if r.stays) == Counter({r.component_id for r in rows})


def test_components_of_real_documents(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    got = Counter((r.doc_id, r.fp & (1 << 64) - 1, r.component_id) for r in simhash.near_duplicates(docs).collect())
    assert got == plain_components(rows, 4, 4)


def test_components_with_small_tiles(spark, monkeypatch):
    """A chain of near fingerprints over many tiles and parts."""
    rng = random.Random(4)
    chains = []
    for _ in range(20):
        x = rng.getrandbits(64)
        for _ in range(30):
            chains.append(x)
            for _ in range(rng.randint(1, 4)):
                x ^= 1 << rng.randrange(64)
    signed = [x - (1 << 64) if x >> 63 else x for x in set(chains)]
    monkeypatch.setattr(simhash, "TILE", 3)
    fps = spark.createDataFrame([(x,) for x in signed], "fp long")
    parent = {x: x for x in signed}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in simhash.links(fps, 4).collect():
        assert bin((r.src ^ r.dst) & (1 << 64) - 1).count("1") <= 4
        parent[root(r.src)] = root(r.dst)
    for i, a in enumerate(signed):
        for b in signed[:i]:
            if bin((a ^ b) & (1 << 64) - 1).count("1") <= 4:
                assert root(a) == root(b)


def test_similarity_confirms_links(spark):
    rng = random.Random(8)
    words = [f"w{i}" for i in range(5000)]
    base = rng.choices(words, k=300)
    near = base[:150] + ["new"] + base[151:]
    far = base[:150] + rng.choices(words, k=150)
    other = rng.choices(words, k=300)
    df = spark.createDataFrame([(3, " ".join(base)), (1, " ".join(near)), (2, " ".join(far)), (4, " ".join(other))], "doc_id long, text string")
    out = {r.doc_id: (r.component_id, r.stays, r.keep_0) for r in simhash.near_duplicates(df, width=5, radius=40, least_similarity=0.8, keep=["text"]).collect()}
    assert out[3][:2] == (1, False) and out[1][:2] == (1, True)
    assert {out[2][0], out[4][0]} == {2, 4} and out[2][1] and out[4][1] and out[2][2] == " ".join(far)
    assert simhash.similarity("a b", "a b", 5) == 1 and simhash.similarity("", " ", 5) == 1 and simhash.similarity("a", "b", 5) == 0


def plain_similar(rows, width, least):
    """Smallest id per row by the similarity of all pairs of texts."""
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if simhash.similarity(rows[i][1], rows[j][1], width) >= least:
                parent[root(i)] = root(j)
    smallest = {}
    for i, (doc, _) in enumerate(rows):
        smallest[root(i)] = min(doc, smallest.get(root(i), doc))
    return {doc: smallest[root(i)] for i, (doc, _) in enumerate(rows)}


def test_similar_texts_equal_all_pairs(spark):
    """Groups of variants around the least similarity, many beyond 12 bits or nearer to ones that are not similar."""
    rng = random.Random(12)
    words = [f"w{i}" for i in range(3000)]
    texts = ["", "one", "one two"]
    for _ in range(40):
        base = rng.choices(words, k=rng.randint(40, 200))
        for edits in (0, *rng.choices(range(1, 6), k=4)):
            new = list(base)
            for k in rng.sample(range(len(new)), max(1, edits * len(new) // 200) if edits else 0):
                new[k] = rng.choice(words)
            texts.append(" ".join(new))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = plain_similar(rows, 5, 0.8)
    out = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), width=5, radius=12, least_similarity=0.8)
    assert {r.doc_id: r.component_id for r in out.collect()} == want and len(set(want.values())) < len(rows) - 20


def test_parities_bound_the_difference():
    rng = np.random.default_rng(3)
    for n in (0, 1, 50, 3000):
        a = rng.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.unique(np.concatenate([a[n // 10 :], rng.integers(0, 1 << 63, 20).astype(np.uint64)]))
        differ = len(np.setxor1d(a, b))
        bits = sum(((x ^ y) & (1 << 64) - 1).bit_count() for x, y in zip(simhash._parities(np.unique(a)), simhash._parities(b)))
        assert bits <= differ and bits % 2 == differ % 2


def test_failed_links_are_replaced(spark, monkeypatch):
    """The forest has A-C and B-C only, which are not similar; A and B are."""
    rng = random.Random(9)
    a = [f"w{i}" for i in range(200)]
    b = [f"x{i}" if i in (20, 60, 100, 140) else w for i, w in enumerate(a)]
    texts = [" ".join(x) for x in (a, b, rng.choices(["p", "q", "r"], k=200))]
    fa, fb, fc = (simhash.fingerprint(t, 5) for t in texts)
    monkeypatch.setattr(simhash, "links", lambda fps, radius: fps.sparkSession.createDataFrame([(fa, fc), (fb, fc)], "src long, dst long"))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = simhash.near_duplicates(df, width=5, radius=12, least_similarity=0.8).collect()
    assert {r.doc_id: r.component_id for r in out} == {0: 0, 1: 0, 2: 2}


def plain_removal(rows, length):
    big = 1 << 70
    seen = {}
    for doc, text in rows:
        data = text.encode()
        for i in range(len(data) - length + 1):
            key = data[i : i + length]
            seen[key] = min(big if doc is None else doc, seen.get(key, big + 1))
    out = Counter()
    for doc, text in rows:
        data = text.encode()
        gone = bytearray(len(data))
        for i in range(len(data) - length + 1):
            if seen[data[i : i + length]] < (big if doc is None else doc):
                gone[i : i + length] = b"\1" * length
        runs = len(re.findall(rb"\x01+", gone))
        out[doc, len(data), sum(gone), runs, bytes(b for b, g in zip(data, gone) if not g)] += 1
    return out


def removed(df, length, **more):
    rows = suffix.remove_repeats(df, length=length, **more).collect()
    assert all(len(r.spans) == r.n_spans and sum(s.end - s.start for s in r.spans) == r.n_removed for r in rows)
    return Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in rows)


@pytest.mark.parametrize("hot", [20_000, 1])
def test_removal_equals_plain_search(hard, hard_rows, hot, monkeypatch):
    monkeypatch.setattr(suffix, "HOT_DOCUMENTS", hot)
    assert removed(hard, 50) == plain_removal(hard_rows, 50)


def test_removal_of_generated_texts(spark):
    rng = random.Random(6)
    parts = ["".join(rng.choices("ab c", k=rng.randint(5, 90))) for _ in range(8)] + ["é" * 40, "x" * 200, "\x00" * 60]
    rows = [(rng.randint(0, 30), "".join(rng.choices(parts, k=rng.randint(0, 6)))) for _ in range(120)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for length in (32, 50, 57):
        assert removed(df, length) == plain_removal(rows, length)


def test_kept_columns_and_text(spark):
    same = "é" * 60
    df = spark.createDataFrame([(1, same, "a"), (2, "x" + same + "y", "b"), (3, None, None)], "doc_id long, text string, `odd name` string")
    rows = {r.doc_id: r for r in suffix.remove_repeats(df, keep=["odd name", "text"], as_text=True).collect()}
    assert rows[2].kept == "xy" and rows[2].keep_0 == "b" and rows[2].keep_1 == "x" + same + "y" and rows[3].kept == "" and rows[3].keep_1 is None
    assert suffix.remove_repeats(df.where("false")).collect() == []
    with pytest.raises(ValueError):
        suffix.remove_repeats(df, length=20)


def test_suffix_array_is_sorted():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 50):
        for symbols in (1, 2, 5):
            for _ in range(10):
                t = np.append(rng.integers(1, symbols + 1, n), 0).astype(np.int16)
                assert suffix.suffix_array(t).tolist() == sorted(range(n + 1), key=lambda i: t[i:].tolist())
    long = np.append(np.tile(np.array([2, 1, 2, 2, 1]), 3000), 0).astype(np.int16)
    got = suffix.suffix_array(long)
    assert sorted(got.tolist()) == list(range(len(long)))
    text = long.tobytes()
    some = got[:: len(got) // 200]
    assert all(long[a:].tolist() < long[b:].tolist() for a, b in zip(some[:-1], some[1:])) and text
