"""Token counts, packing and SentencePiece against the libraries, row by row."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from pointlake.llm import packing, spm, tokens

FILE = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(FILE)


def expected_ids(library, text):
    return library.encode(text, add_special_tokens=False).ids


def test_token_counts(hard, hard_rows, library):
    got = Counter((r.doc_id, r.n_bytes, r.n_tokens, r.over_limit) for r in tokens.token_counts(hard, limit=20).collect())
    want = Counter()
    for i, t in hard_rows:
        n = len(expected_ids(library, t))
        want[i, len(t.encode()), n, n > 20] += 1
    assert got == want


def test_other_tokenizer_goes_through_the_library(hard, hard_rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    own = Tokenizer.from_file(path)
    own.no_truncation()
    got = Counter((r.doc_id, r.n_tokens) for r in tokens.token_counts(hard, tokenizer=path).collect())
    assert got == Counter((i, len(own.encode(t, add_special_tokens=False).ids)) for i, t in hard_rows)


def test_safe_pieces_keep_the_tokens(texts, library):
    enc = tokens.Encoder(FILE)
    for text in texts:
        pieces = tokens.safe_pieces(text, 20)
        assert "".join(pieces) == text
        assert [i for p in pieces for i in enc._ids(p)] == expected_ids(library, text)


def test_packing_is_complete_and_gapless(hard, hard_rows, library):
    rows = packing.pack_documents(hard, limit=64, end_id=0).collect()
    want = Counter()
    for i, t in hard_rows:
        ids, start = np.array([*expected_ids(library, t), 0], "<u4"), 0
        sizes = [len(ids)] if len(ids) <= 64 else [len(ids) % 64] * (len(ids) % 64 > 0) + [64] * (len(ids) // 64)
        for k, n in enumerate(sizes):
            want[i, k, start, n, zlib.crc32(ids[start : start + n].tobytes())] += 1
            start += n
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    check_sequences(rows, 64)


def check_sequences(rows, limit):
    by_sequence = defaultdict(list)
    for r in rows:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= limit
    total = sum(r.length for r in rows)
    assert len(by_sequence) <= -(-total // limit) + 1 + len(by_sequence) // 50
    return by_sequence


def test_later_rounds_merge_open_sequences(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(40)
    rows = packing.pack_documents(docs, limit=2048).collect()
    assert len(check_sequences(rows, 2048)) - -(-sum(r.length for r in rows) // 2048) <= 1


def test_partitions_of_different_lengths_meet(spark, library):
    """Half of the partitions hold long documents, half ones that fit into the room these leave."""
    assert len(expected_ids(library, " a" * 10)) == 10
    rows = [(i, " a" * (10 if i < 12_000 else 8)) for i in range(24_000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize(rows, 4), "doc_id long, text string")
    out = packing.pack_documents(df, limit=20, end_id=0).collect()
    # 11 and 9 ids fill a sequence of 20.
    assert Counter((r.doc_id, r.length) for r in out) == Counter((i, 11 if i < 12_000 else 9) for i in range(24_000))
    assert len({r.sequence_id for r in out}) == 12_000 and all(r.offset + r.length <= 20 for r in out)


def test_local_search_goes_on_after_failures():
    """Here more than a dozen donors in a row fail before one can be emptied."""
    rng = np.random.default_rng(122)
    sizes = np.concatenate([rng.integers(51, 75, 30), rng.integers(20, 50, rng.integers(10, 60))])
    out = packing.local_search([[i] for i in range(len(sizes))], sizes, 100)
    assert sorted(i for b in out for i in b) == list(range(len(sizes))) and all(sizes[b].sum() <= 100 for b in out)
    assert len(out) == 30


def test_local_search_empties_bins():
    rng = np.random.default_rng(3)
    for sizes in (rng.integers(1, 100, 300), rng.integers(20, 60, 300), np.full(30, 60)):
        first = packing.best_fit(sizes, 100)
        # The worst start: every piece alone.
        alone = packing.local_search([[i] for i in range(len(sizes))], sizes, 100)
        for bins in (first, packing.local_search(first, sizes, 100), alone):
            assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
            assert all(sizes[b].sum() <= 100 for b in bins)
        assert len(packing.local_search(first, sizes, 100)) <= len(first)
        assert len(alone) < len(sizes) or sizes.min() > 50


def test_sentencepiece_equals_the_library(hard, hard_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    pieces = spm.encode_pieces(hard)
    got = Counter((r.doc_id, tuple(r.ids)) for r in pieces.collect())
    assert got == Counter((i, tuple(lib.encode(t, add_eos=True))) for i, t in hard_rows)
    decoded = Counter((r.doc_id, r.text) for r in spm.decode_pieces(pieces.select("doc_id", "ids")).collect())
    assert decoded == Counter((i, lib.decode(lib.encode(t, add_eos=True))) for i, t in hard_rows)


def test_digests_equal_the_library(hard, hard_rows):
    lib = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = Counter()
    for i, t in hard_rows:
        ids = lib.encode(t, add_eos=True)
        want[i, len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids)), len(t.encode())] += 1
    assert Counter(tuple(r) for r in spm.piece_digests(hard).collect()) == want


def test_long_texts_in_pieces(texts, monkeypatch):
    model = spm.Model("piece_bpe_32k.model")
    whole = [ids.tolist() for ids, _, _ in model.encode(texts)]
    monkeypatch.setattr(spm, "PIECE_CHARS", 7)
    assert [ids.tolist() for ids, _, _ in model.encode(texts)] == whole


def test_spans_cover_the_original_bytes(texts):
    model = spm.Model("piece_bpe_32k.model")
    for text, (ids, starts, ends) in zip(texts, model.encode(texts)):
        data = text.encode()
        assert ids[-1] == model.end_id and starts[-1] == ends[-1] == len(data)
        if data:
            assert starts[0] == 0 and (ends[:-1] == starts[1:]).all()
            assert b"".join(data[a:b] for a, b in zip(starts, ends)) == data


def test_character_map_takes_the_longest_prefix_and_aligns():
    """A hand-made double array for a -> X, ab -> YZ: root 0, children at offset xor byte, leaves at offset xor 0."""
    units = [0] * 512
    offset_bits = lambda n: n << 10
    units[0] = offset_bits(256)
    a = 256 ^ ord("a")
    units[a] = offset_bits(128) | 1 << 8 | ord("a")
    leaf = a ^ 128
    units[leaf] = 1 << 31 | 0
    b = leaf ^ ord("b")
    units[b] = offset_bits(7) | 1 << 8 | ord("b")
    units[b ^ 7] = 1 << 31 | 2
    blob = (4 * len(units)).to_bytes(4, "little") + b"".join(u.to_bytes(4, "little") for u in units) + b"X\0YZ\0"
    table = spm.CharsMap(blob)
    assert table.longest(b"abc", 0) == (2, b"YZ")
    assert table.longest(b"acb", 0) == (1, b"X")
    assert table.longest(b"ba", 0) is None and table.longest(b"ba", 1) == (1, b"X")
    model = spm.Model("piece_bpe_32k.model")
    model.map, model.dummy = table, False
    out, align = model.normalise("éaab")
    assert out.decode() == "éXYZ" and align.tolist() == [0, 0, 2, 3, 3, 5]


def test_empty_tables(hard):
    none = hard.where("false")
    assert tokens.token_counts(none).collect() == [] and packing.pack_documents(none).collect() == [] and spm.encode_pieces(none).collect() == []


def test_nearly_full_sequences_meet_across_tasks(spark, tmp_path, monkeypatch):
    """One file of texts that leave room for those of another file only: as many sequences as the sum of ids asks for."""
    enc = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    long, short = "a" + " a" * 1928, "a" + " a" * 116
    assert [len(enc.encode(t, add_special_tokens=False).ids) for t in (long, short)] == [1929, 117]
    for k, t in enumerate((long, short)):
        spark.createDataFrame([(100 * k + i, t) for i in range(60)], "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/d", mode="append")
    rows = packing.pack_documents(spark.read.parquet(f"{tmp_path}/d"), limit=2048, end_id=0).collect()
    assert len({r.sequence_id for r in rows}) == 60
    check_sequences(rows, 2048)
