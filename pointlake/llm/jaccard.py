"""Exact similarity join of word-shingle sets with token-combination prefixes.

All sets are ordered alike, rare tokens first. Of two sets that are similar enough, whatever prefix of one misses few
enough tokens of the other; so if prefixes are long enough, they share a token, or ``k`` tokens of a class whose prefix
part is ``k - 1`` tokens longer. Rare tokens are indexed singly. Frequent ones fall into classes that are indexed by pairs
of tokens, which far fewer sets have in common. What shares an index entry is verified.

Tokens are counted exactly: every task deals its tokens to shards by value, a shard returns those that stand in two or
more sets to the shards of the sets. Tokens in more than a thousandth of the rows, found by counts of the tasks, are
never dealt out, so no shard gets a long list for one token.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from pointlake.llm.common import by_bytes, discard, ids_and_texts, kept_names, kept_schema, packed, session, staged, unpacked
from pointlake.operators.graph import components

BATCH_BYTES, PIECE_BYTES = 2 << 20, 2 << 20
#: Most bits of a token where prefixes are found (sets themselves have 64-bit hashes; tokens that meet only cost work), and
#: how many more it has than the number of all tokens.
TOKEN_BITS, SPARE_BITS = 48, 7
#: Tokens of a shard and sets of a shard, on average; tokens a task collects before it deals them out.
SHARD_TOKENS, SHARD_SETS, HELD_TOKENS = 2_000_000, 20_000, 2_000_000
#: Shards there are at least, if each gets so many tokens and sets.
SHARDS, LEAST_TOKENS, LEAST_SETS = 64, 50_000, 1000
#: Tokens in at most so many sets are rare. Sizes below SMALL index every token singly.
RARE_UPTO, SMALL = 64, 32
#: Tasks report tokens in more than a 500th of the rows they hold; hot are those whose reports exceed a thousandth of all
#: rows, and 256. Other tokens are in at most three thousandths, hot ones at most a thousand times the mean size of a set.
REPORTED, HOT_SHARE, HOT_LEAST = 500, 1000, 256
HOT = 0xFFFF
#: Bits of the map of sets that are candidates, and of a set's parities.
MAP_BITS, PARITIES = 1 << 26, 1024
ODD = np.uint64(0x9E3779B97F4A7C15)
#: Bytes of a set's key, and what a blob has: tokens, hot tokens that need no counting, or sizes of sets.
KEY_BYTES = 10
COUNTED, PASSED, SIZES = 0, 1, 2


# -- shingles --------------------------------------------------------------------------------------------------------


def _mix(x: np.ndarray) -> np.ndarray:
    """Scrambles 64-bit numbers one to one."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@functools.cache
def _numbers() -> np.ndarray:
    """A number for each byte, A-Z as a-z, 0 for white space."""
    numbers = _mix(np.arange(1, 257, dtype=np.uint64) * ODD)
    numbers[65:91] = numbers[97:123]
    numbers[[9, 10, 11, 12, 13, 32]] = 0
    return numbers


@functools.cache
def _powers(base: int) -> np.ndarray:
    """Powers of the base by place."""
    powers = np.full(PIECE_BYTES + 1, base, np.uint64)
    powers[0] = 1
    return np.multiply.accumulate(powers)


def word_hashes(raw: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, words before each bound) of the texts raw[bounds[i]:bounds[i+1]], at most PIECE_BYTES in all."""
    if not len(raw):
        return np.zeros(0, np.uint64), np.zeros(len(bounds), np.int64)
    values = _numbers()[raw]
    solid = values != 0
    edge = np.zeros(len(raw) + 1, bool)
    edge[bounds] = True
    begins = solid.copy()
    begins[1:] &= ~solid[:-1] | edge[1:-1]
    ends = solid
    ends[:-1] &= ~solid[1:] | edge[1:-1]
    begin, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values * _powers(int(ODD))[: len(raw)])])
    hashes = _mix((sums[end] - sums[begin]) * _powers(pow(int(ODD), -1, 1 << 64))[begin] + (end - begin).astype(np.uint64))
    return hashes, np.searchsorted(begin, bounds)


def _shingled(words: np.ndarray, at: np.ndarray, width: int) -> Iterator[np.ndarray]:
    """Distinct shingle hashes, ascending, of each text with the words words[at[i]:at[i+1]]."""
    joined = np.zeros(max(len(words) - width + 1, 0), np.uint64)
    for k in range(width):
        joined = joined * ODD + words[k : k + len(joined)]
    joined = _mix(joined)
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s >= width:
            yield np.unique(joined[s : e - width + 1])
        elif e > s:
            whole = np.full(1, e - s, np.uint64)  # fewer words than a shingle has: the whole sequence is one
            for k in range(s, e):
                whole = whole * ODD + words[k]
            yield _mix(whole)
        else:
            yield joined[:0]


def _long_words(text: bytes) -> np.ndarray:
    """Word hashes of a text longer than a piece, cut behind white space (or inside a word longer than a piece)."""
    found, at, gaps = [], 0, (b" ", b"\n", b"\t", b"\r", b"\x0b", b"\x0c")
    while at < len(text):
        cut = min(at + PIECE_BYTES, len(text))
        if cut < len(text):
            cut = max(text.rfind(g, at, cut) for g in gaps) + 1 or cut
        found.append(word_hashes(np.frombuffer(text, np.uint8, cut - at, at), np.array([0, cut - at]))[0])
        at = cut
    return np.concatenate(found)


def shingle_sets(texts: pa.Array, width: int) -> Iterator[np.ndarray]:
    """Distinct hashes of the ``width``-word shingles of each text, ascending; words are lower-cased in A-Z only."""
    plain = texts.cast(pa.large_binary()).to_pylist()
    sizes = np.array([len(x) for x in plain], np.int64)
    start = 0
    while start < len(plain):
        stop, total = start, 0
        while stop < len(plain) and (stop == start or total + sizes[stop] <= PIECE_BYTES):
            total += sizes[stop]
            stop += 1
        if total > PIECE_BYTES:
            words = _long_words(plain[start])
            at = np.array([0, len(words)])
        else:
            bounds = np.concatenate([[0], np.cumsum(sizes[start:stop])])
            words, at = word_hashes(np.frombuffer(b"".join(plain[start:stop]), np.uint8), bounds)
        yield from _shingled(words, at, width)
        start = stop


def set_key(tokens: np.ndarray) -> bytes:
    """Bytes that stand for a set."""
    from xxhash import xxh3_128_digest

    return xxh3_128_digest(tokens.tobytes())[:KEY_BYTES]


def similar(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


# -- rows, hot tokens ------------------------------------------------------------------------------------------------


def set_rows(df: DataFrame, id_col: str, text_col: str, width: int, mark: Callable[[str], int] | None = None) -> DataFrame:
    """(doc_id, key, n, mark) per row: key and size of its set, and a number ``mark`` finds for the text.

    Also (token, times): the tokens of many of the rows a task holds, and of how many.
    """
    rows = ids_and_texts(df, id_col, text_col)
    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.binary()), ("n", pa.int64()), ("mark", pa.int64()), ("token", pa.int64()), ("times", pa.int64())])

    def batch_of(**columns):
        count = len(next(iter(columns.values())))
        arrays = [pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(count, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(arrays, schema=schema)

    def run(batches):
        held, count, found = 0, 0, []
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            sets = list(shingle_sets(batch.column("text"), width))
            marks = {} if mark is None else {"mark": list(map(mark, batch.column("text").to_pylist()))}
            yield batch_of(doc_id=batch.column("doc_id"), key=[set_key(x) for x in sets], n=[len(x) for x in sets], **marks)
            found += sets
            held += len(sets)
            count += sum(map(len, sets))
            if count > HELD_TOKENS:
                yield batch_of(**_often(found, held))
                held, count, found = 0, 0, []
        if found:
            yield batch_of(**_often(found, held))

    return rows.mapInArrow(run, "doc_id long, key binary, n long, mark long, token long, times long")


def with_keys(rows: DataFrame, width: int) -> DataFrame:
    """The rows (doc_id, text, keep_0, ...) with the key of each text's set instead of the text."""
    kept = kept_names(rows)

    def run(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            keys = pa.array([set_key(x) for x in shingle_sets(batch.column("text"), width)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), keys, *(batch.column(c) for c in kept)], ["doc_id", "key", *kept])

    return rows.mapInArrow(run, "doc_id long, key binary" + kept_schema(rows))


def _often(sets: list[np.ndarray], held: int) -> dict:
    """Tokens of more than a share of the held rows, and of how many."""
    tokens, times = np.unique(np.concatenate(sets) >> np.uint64(64 - TOKEN_BITS), return_counts=True)
    some = (times * REPORTED > held) & (times > 1)
    return {"token": tokens[some].astype(np.int64), "times": times[some]}


def hot_tokens(rows: DataFrame, count: int) -> np.ndarray:
    """Tokens whose reported counts exceed a share of the rows; their number is bounded by that share and the mean set size."""
    often = rows.where("token IS NOT NULL").groupBy("token").agg(F.sum("times").alias("times"))
    often = often.where((F.col("times") * HOT_SHARE > count) & (F.col("times") > HOT_LEAST))
    return np.sort(np.array([r.token for r in often.select("token").collect()], np.uint64))


# -- exact counts, prefixes, signatures ------------------------------------------------------------------------------


BLOB = "kind int, nodes binary, tokens binary, owners binary, seen binary"
BLOB_NAMES = ["shard", "kind", "nodes", "tokens", "owners", "seen"]


def _keys(data: bytes) -> np.ndarray:
    return np.frombuffer(data, [("a", "<u8"), ("b", "<u2")])


def _small(data: bytes) -> np.ndarray:
    """The small numbers of ``_as_planes``."""
    raw = zlib.decompress(data)
    return np.frombuffer(raw, np.uint8).reshape(4, -1).T.copy().view("<u4").reshape(-1).astype(np.int64)


def _as_planes(numbers: np.ndarray) -> bytes:
    """Numbers below 2^32 by byte planes, compressed."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def _blobs(kind: int, shard: np.ndarray, nodes: np.ndarray, tokens: np.ndarray, owners: np.ndarray, seen: np.ndarray | None) -> list[tuple]:
    """(shard, kind, nodes, tokens, owners, seen) per shard; rows are in the order of shards and, within, of tokens."""
    out = []
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    for s, e in zip(first.tolist(), [*first[1:].tolist(), len(shard)]):
        used, owner = np.unique(owners[s:e], return_inverse=True)
        out.append((int(shard[s]), kind, nodes[used].tobytes(), packed(tokens[s:e]), _as_planes(owner), b"" if seen is None else _as_planes(seen[s:e])))
    return out


def _sizes(shard: np.ndarray, nodes: np.ndarray, n: np.ndarray, hot: np.ndarray) -> list[tuple]:
    """Blobs that say how many tokens sets have, and how many of them are not counted."""
    order = np.argsort(shard, kind="stable")
    shard, nodes, n, hot = shard[order], nodes[order], n[order], hot[order]
    first = np.flatnonzero(np.diff(shard, prepend=-1))
    ends = [*first[1:].tolist(), len(shard)]
    return [(int(shard[s]), SIZES, nodes[s:e].tobytes(), b"", _as_planes(n[s:e]), _as_planes(hot[s:e])) for s, e in zip(first.tolist(), ends)]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * 4]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], BLOB_NAMES)


def _single(nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions of distinct keys, number of each row's key among them)."""
    order = np.lexsort((nodes["b"], nodes["a"]))
    ranked = nodes[order]
    new = np.ones(len(order), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[new], number


def _opened(found: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(nodes, tokens, owners, seen) of token blobs, with every node once and each token of a node once, by token."""
    nodes, tokens, owners, seen, base = [], [], [], [], 0
    for n, t, o, s in zip(*(found.column(c).to_pylist() for c in ("nodes", "tokens", "owners", "seen"))):
        n, o = _keys(n), _small(o)
        nodes.append(n)
        owners.append(o + base)
        tokens.append(unpacked(t, len(o)))
        seen.append(_small(s) if s else np.zeros(len(o), np.int64))
        base += len(n)
    nodes, owners, tokens, seen = map(np.concatenate, (nodes, owners, tokens, seen))
    some, number = _single(nodes)
    owners = number[owners]
    order = np.lexsort((owners, tokens))
    tokens, owners, seen = tokens[order], owners[order], seen[order]
    new = np.ones(len(tokens), bool)
    new[1:] = (tokens[1:] != tokens[:-1]) | (owners[1:] != owners[:-1])
    return nodes[some], tokens[new], owners[new], seen[new]


def _of_kind(found: pa.Table, *kinds: int) -> pa.Table:
    return found.filter(pa.array(np.isin(found.column("kind").to_numpy(), kinds)))


def _dealt(df: DataFrame, id_col: str, text_col: str, width: int, percent: int, bits: int, shards: int, hot: np.ndarray) -> DataFrame:
    """(shard, kind, ...): the tokens of all sets, dealt by value; each task sends a set once.

    Hot tokens stay behind, but for sets that need them for a prefix; these, and the sizes of the sets, pass through a shard.
    """
    least = -(-percent // max(100 - percent, 1)) if percent < 100 else 1 << 62  # smaller sets have no different partner

    def run(batches):
        sets, keys, known, size = [], [], set(), 0

        def flush():
            nonlocal sets, keys, size
            if not sets:
                return
            nodes = _keys(b"".join(keys))
            n = np.array([len(x) for x in sets])
            owners = np.repeat(np.arange(len(sets)), n)
            full = np.concatenate(sets) >> np.uint64(64 - bits)
            keep = np.ones(len(full), bool)
            keep[1:] = (full[1:] != full[:-1]) | (owners[1:] != owners[:-1])  # tokens that meet in a set count once
            full, owners = full[keep], owners[keep]
            is_hot = np.zeros(len(full), bool)
            if len(hot):
                place = np.minimum(np.searchsorted(hot, full), len(hot) - 1)
                is_hot = hot[place] == full
            hots = np.bincount(owners[is_hot], minlength=len(sets))
            uncounted = hots + n - np.bincount(owners, minlength=len(sets))  # and tokens that met
            spread = int(nodes["a"][0] % np.uint64(shards))
            yield _batch(_sizes(np.full(len(sets), spread), nodes, n, uncounted))
            # Prefixes take hot tokens last, and of those no more than make a prefix alone.
            slack = (100 - percent) * n // 100
            wanted = np.where(n - uncounted < slack + 1, slack + 1 + _classes(np.maximum(_band(n), SMALL), percent), 0)
            some = np.flatnonzero(is_hot)
            rank = np.arange(len(some)) - np.repeat(np.cumsum(hots) - hots, hots)
            some = some[rank < wanted[owners[some]]]
            some = some[np.argsort(full[some], kind="stable")]
            if len(some):
                yield _batch(_blobs(PASSED, np.full(len(some), spread), nodes, full[some], owners[some], None))
            order = np.argsort(full[~is_hot], kind="stable")
            tokens, owners = full[~is_hot][order], owners[~is_hot][order]
            top = min(bits, 32)
            shard = ((tokens >> np.uint64(bits - top)) * np.uint64(shards) >> np.uint64(top)).astype(np.int64)
            rows = _blobs(COUNTED, shard, nodes, tokens, owners, None)
            for at in range(0, len(rows), 64):
                yield _batch(rows[at : at + 64])
            sets, keys, size = [], [], 0

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            for tokens in shingle_sets(batch.column("text"), width):
                if len(tokens) < least:
                    continue
                key = set_key(tokens)
                if key in known:
                    continue
                known.add(key)
                sets.append(tokens)
                keys.append(key)
                size += len(tokens)
                if size > HELD_TOKENS:
                    yield from flush()
            if len(known) > 1_000_000:
                known.clear()
        yield from flush()

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, f"shard long, {BLOB}")


def _returned(sets: int):
    """From all tokens of a shard: those in two sets or more, with how many, to the shards of the sets."""

    def run(key, found):
        out = []
        for kind in (COUNTED, PASSED):
            part = _of_kind(found, kind)
            if not len(part):
                continue
            nodes, tokens, owners, _ = _opened(part)
            first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
            counts = np.diff(np.append(first, len(tokens)))
            seen = np.repeat(np.full(len(first), HOT) if kind == PASSED else np.minimum(counts, HOT - 1), counts)
            keep = seen > 1
            tokens, owners, seen = tokens[keep], owners[keep], seen[keep]
            shard = (nodes["a"][owners] % np.uint64(sets)).astype(np.int64)
            order = np.argsort(shard, kind="stable")
            out += _blobs(COUNTED, shard[order], nodes, tokens[order], owners[order], seen[order])
        for n, o, s in zip(*(_of_kind(found, SIZES).column(c).to_pylist() for c in ("nodes", "owners", "seen"))):
            n = _keys(n)
            out += _sizes((n["a"] % np.uint64(sets)).astype(np.int64), n, _small(o), _small(s))
        return pa.Table.from_batches([_batch(out)])

    return run


def _band(n):
    """Largest power of two that is no larger."""
    return 1 << (np.frexp(np.maximum(n, 1))[1] - 1).astype(np.int64)


def _classes(band, percent: int):
    """Classes of frequent tokens among sets of this band: about a third as many as tokens may be missing."""
    return np.maximum((100 - percent) * band // 100 // 3, 1)


def prefix_signatures(tokens: np.ndarray, seen: np.ndarray, n: int, hot: int, percent: int) -> np.ndarray:
    """Index entries of a set of size ``n``, given its tokens in two or more sets and in how many; ``hot`` of all are hot.

    ``slack`` tokens may be missing in a partner. Tokens of no other set come first and are surely missing. If they are not
    enough, rare tokens follow singly, then frequent ones, until classes have more than ``slack`` tokens beyond the one
    that a class may share without sharing a pair. Entries of frequent tokens are made for the size band of the set and,
    as partners may be smaller, for those of smaller partners.
    """
    slack = (100 - percent) * n // 100
    need = slack + 1 - (n - hot - int((seen < HOT).sum()))
    if need <= 0:
        return np.zeros(0, np.uint64)
    order = np.lexsort((tokens, seen))
    tokens, seen = tokens[order], seen[order]
    rare = tokens[seen <= RARE_UPTO][:need]
    out = [_mix(rare + np.uint64(1))]
    need -= len(rare)
    frequent = tokens[seen > RARE_UPTO]
    if need > 0 and len(frequent):
        band, last = int(_band(-(-percent * n // 100))) // 2, int(_band(n))
        while band < last:
            band *= 2
            salt = _mix(np.full(1, band + 2, np.uint64))
            if band < SMALL:
                out.append(_mix(frequent[:need] * ODD + salt))
                continue
            kinds = int(_classes(band, percent))
            kind = (frequent * ODD >> np.uint64(33)).astype(np.int64) % kinds
            # A class adds nothing with its first token and one with each further token.
            order = np.argsort(kind, kind="stable")
            repeated = np.zeros(len(kind), bool)
            repeated[order[1:]] = kind[order][1:] == kind[order][:-1]
            upto = int(np.searchsorted(np.cumsum(repeated), need)) + 1
            some, kind = frequent[:upto], kind[:upto]
            order = np.lexsort((some, kind))
            some, kind = some[order], kind[order]
            for step in range(1, upto):
                same = np.flatnonzero(kind[step:] == kind[:-step])
                if not len(same):
                    break
                out.append(_mix((some[same] * ODD + some[same + step]) * ODD + salt))
    return np.unique(np.concatenate(out))


def signatures(df: DataFrame, rows: DataFrame, id_col: str, text_col: str, width: int, percent: int) -> DataFrame:
    """(sig, key, n): index entries of all sets that can have a different partner, each once; staged."""
    count, total = rows.where("token IS NULL").agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    bits = min(TOKEN_BITS, int(total).bit_length() + SPARE_BITS)
    shards = max(total // SHARD_TOKENS, min(SHARDS, total // LEAST_TOKENS)) + 1
    sets = max(count // SHARD_SETS, min(SHARDS, count // LEAST_SETS)) + 1
    # Tokens that differ in the bits left out are counted together.
    hot = np.unique(hot_tokens(rows, count) >> np.uint64(TOKEN_BITS - bits))
    dealt = _dealt(df, id_col, text_col, width, percent, bits, shards, hot)
    returned = dealt.groupBy("shard").applyInArrow(_returned(sets), f"shard long, {BLOB}")

    def index(key, found):
        tables = [[_keys(n), _small(o), _small(s)] for n, o, s in zip(*(_of_kind(found, SIZES).column(c).to_pylist() for c in ("nodes", "owners", "seen")))]
        counted = _of_kind(found, COUNTED)
        if not len(counted):
            return pa.Table.from_arrays([pa.array([], pa.int64()), pa.array([], pa.binary()), pa.array([], pa.int64())], ["sig", "key", "n"])
        nodes, tokens, owners, seen = _opened(counted)
        known, sizes, uncounted = (np.concatenate(x) for x in zip(*tables))
        some, number = _single(np.concatenate([known, nodes]))
        # Every node has its sizes, and the first row of a key is the one that has them.
        own = some[number[len(known) :]]
        order = np.lexsort((tokens, owners))
        tokens, owners, seen = tokens[order], owners[order], seen[order]
        at = np.searchsorted(owners, np.arange(len(nodes) + 1))
        made = [prefix_signatures(tokens[s:e], seen[s:e], n, h, percent) for s, e, n, h in zip(at[:-1], at[1:], sizes[own].tolist(), uncounted[own].tolist())]
        lengths = [len(x) for x in made]
        arrays = [
            pa.array(np.concatenate([np.zeros(0, np.uint64), *made]).view(np.int64)),
            pa.array([k for k, c in zip((x.tobytes() for x in nodes), lengths) for _ in range(c)], pa.binary()), pa.array(np.repeat(sizes[own], lengths), pa.int64()),
        ]
        return pa.Table.from_arrays(arrays, ["sig", "key", "n"])

    return staged(returned.groupBy("shard").applyInArrow(index, "sig long, key binary, n long"))


def shared_entries(sigs: DataFrame) -> DataFrame:
    """The entries (sig, key, n) that several sets have."""
    several = sigs.groupBy("sig").agg(F.count(F.lit(1)).alias("c")).where("c > 1").select("sig")
    return sigs.join(several, "sig", "left_semi")


# -- candidates and links --------------------------------------------------------------------------------------------


def candidate_sets(df: DataFrame, nodes: DataFrame, id_col: str, text_col: str, width: int) -> DataFrame:
    """(v, n, odd, tokens) of the nodes (v, key), made anew from the texts; a bit map leaves out most other texts."""
    session(df)
    wanted = df.sparkSession.sparkContext.broadcast(_key_map(nodes))

    def run(batches):
        bits, known = wanted.value, set()
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            keys, sizes, odd, found = [], [], [], []
            for tokens in shingle_sets(batch.column("text"), width):
                key = set_key(tokens)
                place = int.from_bytes(key[:4], "little") % MAP_BITS
                if not len(tokens) or not bits[place >> 3] >> (place & 7) & 1 or key in known:
                    continue
                known.add(key)
                keys.append(key)
                sizes.append(len(tokens))
                odd.append(parities(tokens))
                found.append(tokens.tobytes())
            if len(known) > 1_000_000:
                known.clear()
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.binary()), pa.array(sizes, pa.int64()), pa.array(odd, pa.list_(pa.int64())), pa.array(found, pa.binary())],
                ["key", "n", "odd", "tokens"],
            )

    found = ids_and_texts(df, id_col, text_col).mapInArrow(run, "key binary, n long, odd array<long>, tokens binary")
    found = found.join(nodes.select("key", "v"), "key").groupBy("v").agg(F.first("n").alias("n"), F.first("odd").alias("odd"), F.first("tokens").alias("tokens"))
    return staged(found)


def _key_map(nodes: DataFrame) -> np.ndarray:
    """Bytes of a bit map over the first four bytes of the nodes' keys; its size does not depend on their number."""
    hexes = F.hex("key")
    number = F.conv(F.concat(*(F.substring(hexes, 2 * i + 1, 2) for i in (3, 2, 1, 0))), 16, 10).cast("long")
    rows = nodes.select(F.pmod(number, F.lit(MAP_BITS)).alias("place")).select(F.expr("bitmap_bucket_number(place + 1)").alias("at"), F.expr("bitmap_bit_position(place + 1)").alias("bit"))
    out = np.zeros(MAP_BITS // 8 + 8192, np.uint8)
    for at, bits in rows.groupBy("at").agg(F.expr("bitmap_construct_agg(bit)").alias("bits")).collect():
        out[(at - 1) * 4096 : at * 4096] = np.frombuffer(bits, np.uint8)
    return out


def parities(tokens: np.ndarray) -> list[int]:
    """Of each of PARITIES classes of tokens, whether an odd number of them is there."""
    odd = np.bincount((tokens % np.uint64(PARITIES)).astype(np.int64), minlength=PARITIES) & 1
    return np.packbits(odd.astype(bool)).view(">i8").tolist()


def _possible(a: str, b: str, percent: int) -> Column:
    """Whether two sets can be similar enough by their sizes and parities, of the rows with these aliases.

    An element of one set only changes one parity; similar sets differ in at most (100 - p) / (100 + p) of their sizes' sum.
    """
    n, m = F.col(f"{a}.n"), F.col(f"{b}.n")
    differ = sum((F.bit_count(F.col(f"{a}.odd")[i].bitwiseXOR(F.col(f"{b}.odd")[i])) for i in range(PARITIES // 64)), F.lit(0))
    return (n * 100 >= m * percent) & (m * 100 >= n * percent) & (differ * (100 + percent) <= (n + m) * (100 - percent))


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (src, dst) of the sets (v, n, odd, tokens) that are similar enough; sizes and parities decide most."""
    few = pairs
    for c in ("src", "dst"):
        few = few.join(sets.select(F.col("v").alias(c), F.struct("n", "odd").alias(f"of_{c}")), c)
    few = few.where(_possible("of_src", "of_dst", percent)).select("src", "dst")
    for c in ("src", "dst"):
        few = few.join(sets.select(F.col("v").alias(c), F.col("tokens").alias(f"set_{c}")), c)

    def run(batches):
        for batch in batches:
            sides = (batch.column(c).to_pylist() for c in ("set_src", "set_dst"))
            near = [similar(np.frombuffer(a, np.uint64), np.frombuffer(b, np.uint64), percent) for a, b in zip(*sides)]
            yield batch.select(["src", "dst"]).filter(pa.array(near, pa.bool_()))

    return few.mapInArrow(run, "src long, dst long")


def labels(edges: DataFrame) -> DataFrame:
    """(v, label) of all ends of the links."""
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()
    graph = F.lit(0).alias("graph")
    return components(ends.select(graph, "v"), edges.select(graph, "src", "dst"), ["graph"], mode="weak").select("v", "label")


def _labelled(index: DataFrame, edges: DataFrame | None) -> DataFrame:
    """The index with the component of each set, which is its own number if it has no link."""
    if edges is None:
        return index.withColumn("label", F.col("v"))
    return index.join(labels(edges), "v", "left").withColumn("label", F.coalesce("label", "v"))


def links(index: DataFrame, sets: DataFrame, percent: int, known: DataFrame | None = None) -> DataFrame:
    """(src, dst): links that connect what similar enough sets connect, from the index (sig, v, n) and ``known`` links.

    First every set meets one hub: of the sets that share most entries with all others in its entries, the one with which
    it shares most. That joins nearly all of a group of variants. Then whatever shares an entry and is still in different
    components is paired, if sizes and parities allow it, and verified, so no link is missed. The most frequent component
    of an entry meets the others there but never itself.
    """
    counts = index.groupBy("sig").agg(F.count(F.lit(1)).alias("members"))
    weights = index.join(counts, "sig").groupBy("v").agg(F.sum("members").alias("weight"))
    weighed = staged(_labelled(index, known).join(weights, "v"))
    hubs = weighed.groupBy("sig").agg(F.max_by(F.struct("v", "label", "weight"), F.struct("weight", "v")).alias("hub"))
    near = weighed.join(hubs, "sig").where(F.col("label") != F.col("hub.label")).select("v", "hub")
    best = near.groupBy("v", "hub").agg(F.count(F.lit(1)).alias("times")).groupBy("v").agg(F.max_by("hub.v", F.struct("times", "hub.weight", "hub.v")).alias("hub"))
    edges = staged(verified(best.select(F.least("v", "hub").alias("src"), F.greatest("v", "hub").alias("dst")).distinct(), sets, percent))
    edges = edges if known is None else edges.unionByName(known)
    labelled = staged(_labelled(index, edges))
    discard(weighed)
    kinds = labelled.groupBy("sig", "label").agg(F.count(F.lit(1)).alias("c"))
    major = kinds.groupBy("sig").agg(F.max_by("label", F.struct("c", "label")).alias("major"), F.count(F.lit(1)).alias("kinds"))
    left = labelled.join(major.where("kinds > 1").select("sig", "major"), "sig").join(sets.select("v", "odd"), "v")
    left = staged(left.select("sig", "v", "n", "label", "major", "odd"))
    discard(labelled)
    a, b = left.where("label <> major").alias("a"), left.alias("b")
    meet = (F.col("a.sig") == F.col("b.sig")) & (F.col("a.label") != F.col("b.label")) & ((F.col("b.label") == F.col("b.major")) | (F.col("a.v") < F.col("b.v")))
    pairs = a.join(b, meet & _possible("a", "b", percent)).select(F.least("a.v", "b.v").alias("src"), F.greatest("a.v", "b.v").alias("dst"))
    return edges.unionByName(staged(verified(pairs.distinct(), sets, percent)))


def similar_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, percent: int = 90) -> DataFrame:
    """(doc_id, n_shingles, component_id) per row: size of its shingle set and smallest id reachable over links.

    Words are runs of characters other than the six ASCII white-space ones, lower-cased in A-Z; a set has the distinct
    shingles of ``width`` words (of fewer words, the whole sequence) as 64-bit hashes. Two rows link if the intersection is
    at least ``percent`` of the union. Null, empty and blank texts have an empty set, link with nothing and keep their own
    id; equal sets are one node whatever their number; a row with a null id gets the smallest id of its component, null if
    there is none; repeated rows each give a row; an empty table gives none; other columns are never read.
    """
    session(df)
    rows = staged(set_rows(df, id_col, text_col, width))
    docs = rows.where("token IS NULL").select("doc_id", "key", "n")
    sigs = signatures(df, rows, id_col, text_col, width, percent)
    shared = shared_entries(sigs)
    nodes = staged(shared.select("key").distinct().withColumn("v", F.monotonically_increasing_id()))
    index = staged(shared.join(nodes, "key").select("sig", "v", "n"))
    discard(sigs)
    sets = candidate_sets(df, nodes, id_col, text_col, width)
    edges = staged(links(index, sets, percent).distinct())
    discard(index, sets)
    first = docs.where("n > 0").groupBy("key").agg(F.min("doc_id").alias("first"))
    member = nodes.join(labels(edges), "v").select("key", "label")
    smallest = member.join(first, "key").groupBy("label").agg(F.min("first").alias("component_id"))
    joined = member.join(smallest, "label").select("key", "component_id")
    named = first.join(joined, "key", "left").select("key", F.coalesce("component_id", "first").alias("component_id"))
    return docs.join(named, "key", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")
    )
