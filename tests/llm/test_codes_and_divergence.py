"""Vector codes and the audit of sources against plain Python and SQL."""

import math
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest

from pointlake.llm import codes, divergence

# -- vector codes ----------------------------------------------------------------------------------------------------


def plain_codes(rows, parts, entries, rounds, scale=256):
    """(vec_id, code, error, label_error) by comparing every part with every entry."""
    kept = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    whole = [(i, [math.floor(scale * x) for x in v], label) for i, v, label in kept]
    whole.sort(key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    whole = [r for r in whole if len(r[1]) == len(whole[0][1])]
    size = len(whole[0][1]) // parts if whole else 0
    cut = [[tuple(v[p * size : (p + 1) * size]) for p in range(parts)] for _, v, _ in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def assign():
        return [[min((sum((a - b) ** 2 for a, b in zip(c[p], e)), k) for k, e in enumerate(books[p])) for p in range(parts)] for c in cut]

    for _ in range(rounds):
        found = assign()
        for p in range(parts):
            members = defaultdict(list)
            for c, f in zip(cut, found):
                members[f[p][1]].append(c[p])
            for k, m in members.items():
                books[p][k] = tuple(sum(x) // len(m) for x in zip(*m))
    found = assign()
    errors = [sum(d for d, _ in f) for f in found]
    by_label = Counter()
    for (_, _, label), e in zip(whole, errors):
        by_label[label] += e
    return Counter((i, "".join(f"{k:02x}" for _, k in f), e, by_label[label]) for (i, _, label), f, e in zip(whole, found, errors)), books


def vectors(n, dim, rng):
    rows = [(rng.randrange(n), [rng.gauss(0, 1) for _ in range(dim)], rng.choice([None, 0, 1, 2])) for _ in range(n)]
    rows += rows[:5] + [(None, [0.5] * dim, 1), (None, [0.25] * dim, None), (3, None, 0), (4, [None] + [1.0] * (dim - 1), 0)]
    rows += [(5, [float("nan")] * dim, 0), (6, [float("inf")] * dim, 0), (7, [], 0), (8, [1.0] * (dim - 4), 0), (1, [1.0] * dim, 9)]
    return rows


@pytest.mark.parametrize("n,entries", [(120, 16), (6, 64)])
def test_codes_equal_plain_search(spark, n, entries):
    rng = random.Random(n)
    rows = [(i, [0.25] * 8, label) for i, _, label in vectors(4, 8, rng) if i is not None][:2] + vectors(n, 8, rng)
    rng.shuffle(rows)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "vec_id long, embedding array<double>, label int, code string, v int").repartition(4)
    got, books = codes.compress_vectors(df, parts=4, entries=entries, rounds=2)
    want, plain_books = plain_codes(rows, 4, entries, 2)
    assert Counter((r.vec_id, r.code, r.error, r.label_error) for r in got.collect()) == want
    assert [[tuple(e) for e in b.tolist()] for b in books] == plain_books


def test_codes_of_nothing_and_refusals(spark):
    schema = "vec_id long, embedding array<float>, label string"
    empty, books = codes.compress_vectors(spark.createDataFrame([(1, None, "a")], schema))
    assert empty.count() == 0 and all(len(b) == 0 for b in books)
    with pytest.raises(ValueError):
        codes.compress_vectors(spark.createDataFrame([(1, [1.0] * 10, "a")], schema))
    with pytest.raises(ValueError):
        codes.compress_vectors(spark.createDataFrame([(1, [1e9] * 16, "a")], schema))


def test_equal_average_search_keeps_ties():
    rng = np.random.default_rng(2)
    parts, entries = rng.integers(-3, 4, (500, 4)), rng.integers(-3, 4, (40, 4))
    index, distance = codes.nearest(parts, entries)
    table = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (distance == table.min(1)).all() and (index == table.argmin(1)).all()


# -- divergence of sources -------------------------------------------------------------------------------------------


def plain_audit(rows, least, top):
    """Rows of the audit from (lang, source, text) by counting."""
    docs = [(l or "", s or "", re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))) for l, s, t in rows]
    out = []
    for lang in {d[0] for d in docs}:
        held, total, counts = Counter(), Counter(), defaultdict(Counter)
        for l, s, terms in docs:
            if l == lang:
                held.update(set(terms))
                total.update(terms)
                counts[s].update(terms)
        kept = [t for t, n in held.items() if n >= least]
        share = lambda c, n: 1 + 10**9 * (c + 5) // (n + 5 * len(kept))
        sums = {s: sum(c[t] for t in kept) for s, c in counts.items()}
        shares = {s: {t: share(c[t], sums[s]) for t in kept} for s, c in counts.items()}
        common = {t: share(total[t], sum(total[t] for t in kept)) for t in kept}
        for s in counts:
            pair = [(sum(abs(shares[s][t] - shares[o][t]) for t in kept), o) for o in counts if o != s]
            term = [(shares[s][t] - common[t], t) for t in kept if counts[s][t] and shares[s][t] > common[t]]
            for part, found in (("pair", pair), ("term", term)):
                for rank, (v, item) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1):
                    if part == "pair" or rank <= top:
                        out.append((lang, s, part, item, v, rank))
    return Counter(out)


@pytest.fixture(scope="module")
def audited():
    rng = random.Random(11)
    words = [f"{a}{b}" for a in "kläglich Wort ähre x été".split() for b in ("", "e", "n", "日本", "Z")]
    rows = []
    for i in range(220):
        source = rng.choice([f"s{k}" for k in range(7)] + ["hot"] * 5 + [None])
        rows.append((rng.choice(["en", "en", "de", None]), source, " ".join(rng.choices(words, [1 / (k + 1) for k in range(len(words))], k=rng.randint(0, 60)))))
    rows += [("xx", "a", "lonely words"), ("xx", "b", None), ("xx", None, "12 34 ##"), ("yy", "only", "one")]
    return rows + rows[:9] + [("en", "long", "A1b " * 20000 + "ähre-wort\x00x y " * 3000)]


@pytest.mark.parametrize("limits", [{}, {"BLOCK_TERMS": 3, "BLOCK_SOURCES": 2, "COLUMNS": 4, "HELD_TERMS": 10, "PIECE_BYTES": 50}])
def test_audit_equals_counting(spark, audited, monkeypatch, limits):
    """Whole and in many small blocks."""
    for name, value in limits.items():
        monkeypatch.setattr(divergence, name, value)
    df = spark.createDataFrame([(*r, 1, "x") for r in audited], "lang string, source string, text string, term int, item string").repartition(5)
    got = divergence.audit_sources(df, least_docs=4, top=6)
    assert Counter(tuple(r) for r in got.select("lang", "source", "part", "item", "value", "rank").collect()) == plain_audit(audited, 4, 6)


def test_audit_sql_on_the_same_rows(spark, audited):
    import pandas as pd

    documents = pd.DataFrame(audited, columns=["lang", "source", "text"])  # noqa: F841  read by duckdb
    con = duckdb.connect()
    con.register("documents", documents)
    cur = con.execute(divergence.oracle("documents", 4, 6))
    names = [d[0] for d in cur.description]
    want = Counter(tuple(r[names.index(c)] for c in ("lang", "source", "part", "item", "value", "rank")) for r in cur.fetchall())
    assert want == plain_audit(audited, 4, 6)


def test_audit_of_nothing(spark):
    assert divergence.audit_sources(spark.createDataFrame([], "lang string, source string, text string")).count() == 0


def test_level_products_are_joint_tables():
    rng = np.random.default_rng(1)
    a, b = rng.integers(0, 9, (300, 6)), rng.integers(0, 5, (300, 4))
    shares = lambda c, k: c * 7 + np.arange(c.shape[1]) * k  # noqa: E731  one price per source and count
    got = divergence.distances((a, shares(a, 3)), (b, shares(b, 5)))
    assert (got == np.abs(shares(a, 3)[:, :, None] - shares(b, 5)[:, None, :]).sum(0)).all()
