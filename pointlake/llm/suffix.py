"""Removal of repeated passages with suffix arrays, exact at the byte.

Which 50-byte strings can repeat at all is found first with minimisers: every string of LENGTH bytes has one K-byte
word of smallest hash, equal strings have the same, and consecutive strings that share theirs form a run of text. Runs
whose word occurs in one document only hold no repeat. The others go to the shard of their word. There, runs without a
string whose hash another document has as well hold no repeat either, and a suffix array over the distinct runs that are
left, built by induced sorting, finds the equal strings and the smallest document of each.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import by_bytes, ids_and_texts, kept_schema, packed, partitions, session, staged, unpacked
from pointlake.session import shared_dir

#: Bytes of the documents that are read together, and of the runs of a suffix array.
CHUNK_BYTES, SHARD_BYTES = 3 << 20, 4 << 20
#: Bytes of the word that stands for a string, a multiple of eight.
K = 24
#: Characters of a text that place it among the others.
OPENING = 64
#: Words in more documents than this send single strings, of which the smallest document is found by aggregation.
HOT_DOCUMENTS = 5_000
#: Bits of a word's hash, and words of a shard where they are counted, on average. Words that meet only cost work.
WORD_BITS, SHARD_WORDS = 48, 4_000_000
LAST_ID = (1 << 63) - 1


# -- suffix arrays ---------------------------------------------------------------------------------------------------


def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one (the last is)."""
    n = len(t)
    differs = np.flatnonzero(t[:-1] != t[1:])
    smaller = t[differs] < t[differs + 1]
    out = np.ones(n, bool)
    lengths = np.diff(np.concatenate([[-1], differs]))
    out[: differs[-1] + 1] = np.repeat(smaller, lengths)
    return out


def _place(sa: np.ndarray, at: np.ndarray, chars: np.ndarray, where: np.ndarray, step: int) -> None:
    """Puts ``at``, in its order, into the buckets of ``chars``, each filled from ``where`` upwards or downwards."""
    if not len(at):
        return
    order = np.argsort(chars, kind="stable")
    sorted_chars = chars[order]
    first = np.flatnonzero(np.concatenate([[True], sorted_chars[1:] != sorted_chars[:-1]]))
    counts = np.diff(np.append(first, len(order)))
    rank = np.arange(len(order)) - np.repeat(first, counts)
    keys = sorted_chars[first]
    base = np.repeat(where[keys], counts)
    sa[base + rank if step > 0 else base - 1 - rank] = at[order]
    where[keys] += step * counts


def induce(t: np.ndarray, small: np.ndarray, leftmost: np.ndarray, size: int) -> np.ndarray:
    """All suffixes in the order that the given order of the leftmost-smaller ones induces.

    Larger suffixes are induced from left to right, smaller ones from right to left, a bucket of equal first symbols at
    a time; symbols that repeat make a bucket grow while it is read.
    """
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    begins = ends - counts
    sa = np.full(len(t), -1, np.int64)
    tails = ends.copy()
    _place(sa, leftmost[::-1], t[leftmost[::-1]], tails, -1)
    symbols = np.flatnonzero(counts)
    heads = begins.copy()

    def larger(part):
        before = part[part > 0] - 1
        before = before[~small[before]]
        _place(sa, before, t[before], heads, 1)

    for c in symbols.tolist():
        at = begins[c]
        while at < heads[c]:
            upto = heads[c]
            larger(sa[at:upto].copy())
            at = upto
        larger(sa[tails[c] : ends[c]])
    tails = ends.copy()

    def smaller(part):
        before = part[part > 0] - 1
        before = before[small[before]]
        _place(sa, before, t[before], tails, -1)

    # The last symbol is the smallest one and the only suffix that nothing induces.
    last = len(t) - 1
    _place(sa, np.array([last]), t[last:], tails, -1)
    for c in symbols[::-1].tolist():
        at = ends[c]
        while at > tails[c]:
            downto = tails[c]
            smaller(sa[downto:at][::-1].copy())
            at = downto
        smaller(sa[begins[c] : heads[c]][::-1])
    return sa


def _names(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """Rank of each leftmost-smaller substring among the distinct ones, in text order."""
    induced = induce(t, small, lms, size)
    is_lms = np.zeros(len(t), bool)
    is_lms[lms] = True
    order = induced[is_lms[induced]]
    length = np.zeros(len(t), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    todo, offset = np.flatnonzero(same), 0
    while len(todo):
        todo = todo[length[a[todo]] > offset]
        unequal = t[a[todo] + offset] != t[b[todo] + offset]
        same[todo[unequal]] = False
        todo = todo[~unequal]
        offset += 1
    names = np.zeros(len(t), np.int64)
    names[order] = np.concatenate([[0], np.cumsum(~same)])
    return names[lms]


def _sorted_ranks(names: np.ndarray, depth: int) -> np.ndarray:
    """Order of the suffixes of the reduced text up to ``depth`` names, by ranks of twice as many names each time."""
    rank, reach = names, 1
    while True:
        order = np.argsort(rank, kind="stable")
        top = rank[order]
        if reach >= depth or (top[1:] != top[:-1]).all():
            return order
        follow = np.zeros(len(rank), np.int64)
        follow[:-reach] = rank[reach:] + 1
        key = rank * (int(rank.max()) + 2) + follow
        order = np.argsort(key, kind="stable")
        key = key[order]
        rank = np.empty(len(rank), np.int64)
        rank[order] = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        reach *= 2


def suffix_array(t: np.ndarray, depth: int | None = None) -> np.ndarray:
    """Suffix array of ``t``, whose last symbol occurs once and is the smallest; with ``depth``, sorted by so many symbols.

    Leftmost-smaller substrings are sorted and named by one induction; the text of their names is sorted in turn, and a
    second induction gives all suffixes from it.
    """
    if len(t) < 3:
        return np.argsort(t, kind="stable")
    small = _types(t)
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    size = int(t.max()) + 1
    names = _names(t, small, lms, size)
    order = _sorted_ranks(names, len(lms) if depth is None else depth)
    return induce(t, small, lms[order], size)


def common_prefix(raw: np.ndarray, sa: np.ndarray, length: int) -> np.ndarray:
    """True at i where suffixes sa[i-1] and sa[i] agree in ``length`` bytes; ``raw`` is padded by as many.

    The common prefixes are permuted: computed in text order, each suffix against the one before it in the array, eight
    bytes at a time.
    """
    n = len(raw)
    words = np.lib.stride_tricks.as_strided(raw[: n // 8 * 8].view(np.uint64), (n - 7,), (1,))
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    at = np.flatnonzero(before >= 0)
    for offset in [*range(0, length - 8, 8), length - 8]:
        at = at[words[at + offset] == words[before[at] + offset]]
    agree = np.zeros(n, bool)
    agree[at] = True
    return agree[sa]


def first_holders(texts: list[bytes], docs: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(text, offset) of each string of ``length`` bytes that also starts in a text of a smaller document."""
    sizes = np.array([len(x) for x in texts])
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(b"\0".join(texts) + b"\0" * (length + 9), np.uint8)
    n = int(sizes.sum()) + len(sizes)
    t = raw[:n].astype(np.uint16) + 2
    t[starts + sizes] = 1  # between texts
    sa = suffix_array(np.append(t, np.uint16(0)).astype(np.int16), depth=length)[1:]
    owner = np.repeat(np.arange(len(texts)), sizes + 1)
    whole = np.arange(n) + length <= (starts + sizes)[owner]
    sa = sa[whole[sa]]
    if not len(sa):
        return sa, sa
    group = np.flatnonzero(~common_prefix(raw, sa, length))
    counts = np.diff(np.append(group, len(sa)))
    smallest = np.repeat(np.minimum.reduceat(docs[owner[sa]], group), counts)
    found = np.sort(sa[docs[owner[sa]] > smallest])
    return owner[found], found - starts[owner[found]]


# -- runs of text with the same minimiser ----------------------------------------------------------------------------


def minimiser_runs(data: bytes, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, last, word hash, document) of each run of strings with the same minimiser; documents are bounds[i]..bounds[i+1].

    ``first`` and ``last`` are the starts of the first and last string of the run.
    """
    empty = np.zeros(0, np.int64)
    n = len(data)
    if n < length:
        return empty, empty, empty.astype(np.uint64), empty
    raw = np.frombuffer(data + b"\0" * (K + 8), np.uint8)
    words = np.lib.stride_tricks.as_strided(raw[: len(raw) // 8 * 8].view(np.uint64), (n + K,), (1,))
    key = words[:n] * np.uint64(0x9E3779B97F4A7C15)
    for offset in range(8, K, 8):
        key ^= key >> np.uint64(29)
        key += words[offset : n + offset]
        key *= np.uint64(0xBF58476D1CE4E5B9)
    full = key >> np.uint64(64 - WORD_BITS)
    key &= np.uint64(0xFFFFFFFF00000000)
    key |= np.arange(n, dtype=np.uint64)
    width, span = length - K + 1, 1
    while 2 * span <= width:
        key[: n - span] = np.minimum(key[: n - span], key[span:])
        span *= 2
    starts = n - length + 1
    best = np.minimum(key[:starts], key[width - span : starts + width - span])
    word_at = (best & np.uint64(0xFFFFFFFF)).astype(np.int64)
    sizes = np.diff(bounds)
    left = np.repeat(bounds[1:], sizes)[:starts] - np.arange(starts)
    valid = left >= length
    new = np.concatenate([[True], (word_at[1:] != word_at[:-1]) | ~valid[:-1]])
    first = np.flatnonzero(new & valid)
    stop = np.flatnonzero(valid & np.append(new[1:] | ~valid[1:], True))
    return first, stop, full[word_at[first]], np.searchsorted(bounds, first, "right") - 1


def _chunks(df: DataFrame, id_col: str, text_col: str, keep: list[str]) -> DataFrame:
    """Documents packed into rows of about CHUNK_BYTES: (chunk, ids, sizes, digests, data, rest), bucketed by chunk.

    The bucketed table is read by several joins on ``chunk``, and none of them deals the texts out again.
    """
    spark = session(df)
    rows = ids_and_texts(df, id_col, text_col, keep)
    # In order of their beginnings, most copies meet in one chunk; the id splits what begins alike.
    opening = F.substring("text", 1, OPENING)
    rows = rows.repartitionByRange(partitions(df), opening, "doc_id").sortWithinPartitions(opening, "doc_id")

    def pack(batches):
        number = TaskContext.get().partitionId() << 32
        parts, size = [], 0

        def flush():
            nonlocal number, parts, size
            whole = pa.Table.from_batches(parts).combine_chunks()
            texts = whole.column("text").cast(pa.large_binary()).combine_chunks()
            data = [x.as_py() for x in texts]
            sink = pa.BufferOutputStream()
            rest = whole.drop_columns(["doc_id", "text"])
            with pa.ipc.new_stream(sink, rest.schema) as writer:
                writer.write_table(rest)
            out = pa.RecordBatch.from_pydict(
                {
                    "chunk": pa.array([number], pa.int64()), "ids": pa.array([whole.column("doc_id").to_pylist()], pa.list_(pa.int64())),
                    "sizes": pa.array([[len(x) for x in data]], pa.list_(pa.int64())),
                    "digests": pa.array([[hashlib.blake2b(x, digest_size=16).digest() for x in data]], pa.list_(pa.binary())), "data": pa.array([b"".join(data)], pa.binary()),
                    "rest": pa.array([sink.getvalue().to_pybytes()], pa.binary()),
                }
            )
            number, parts, size = number + 1, [], 0
            return out

        for batch in by_bytes(batches, "text", CHUNK_BYTES):
            if parts and size + batch.nbytes > CHUNK_BYTES:
                yield flush()
            parts.append(batch)
            size += batch.nbytes
        if parts:
            yield flush()

    packed = rows.mapInArrow(pack, "chunk long, ids array<long>, sizes array<long>, digests array<binary>, data binary, rest binary")
    name = f"chunks_{uuid.uuid4().hex}"
    folder = f"{shared_dir(spark).rstrip('/')}/{name}"
    writer = packed.write.bucketBy(partitions(df), "chunk").option("path", folder).option("compression", "zstd")
    writer.saveAsTable(name)
    return spark.table(name)


def _bounds(sizes) -> np.ndarray:
    return np.concatenate([[0], np.cumsum(sizes.values.to_numpy())]).astype(np.int64)


def _ranks(ids) -> np.ndarray:
    """Order of documents: by id, without an id last."""
    return np.array([LAST_ID if x is None else x for x in ids.as_py()], np.int64)


def _copies(chunks: DataFrame, length: int) -> DataFrame:
    """(chunk, copies): places in the chunk of documents whose whole text a smaller document has as well."""
    docs = chunks.select("chunk", "ids", "sizes", F.posexplode("digests").alias("place", "digest")).where(F.col("sizes")[F.col("place")] >= length)
    docs = docs.select("chunk", "place", "digest", F.coalesce(F.col("ids")[F.col("place")], F.lit(LAST_ID)).alias("doc"))
    first = docs.groupBy("digest").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last")
    copies = docs.join(first.select("digest", "first"), "digest").where("doc > first")
    return copies.groupBy("chunk").agg(F.collect_list("place").alias("copies"))


def _is_copy(n: int, copies) -> np.ndarray:
    out = np.zeros(n, bool)
    if copies.is_valid:
        out[copies.values.to_numpy()] = True
    return out


def _shared_words(chunks: DataFrame, length: int, total: int) -> DataFrame:
    """(chunk, words, hot): hashes of the words of a chunk that two or more documents have, whole copies aside.

    A chunk deals its distinct words, with the number of its documents that have them, to shards by value; a shard returns
    to each chunk its words that are shared, and whether very many documents share them.
    """
    shards = max(total // 12 // SHARD_WORDS, min(partitions(chunks), total >> 16)) + 1

    def deal(batches):
        for batch in batches:
            for chunk, sizes, data, copies in zip(*(batch.column(c) for c in ("chunk", "sizes", "data", "copies"))):
                _, _, words, docs = minimiser_runs(data.as_py(), _bounds(sizes), length)
                own = ~_is_copy(len(sizes), copies)[docs]
                words, docs = words[own], docs[own]
                order = np.lexsort((docs, words))
                words, docs = words[order], docs[order]
                new = np.ones(len(words), bool)
                new[1:] = (words[1:] != words[:-1]) | (docs[1:] != docs[:-1])
                words, n = np.unique(words[new], return_counts=True)
                shard = (words * np.uint64(shards) >> np.uint64(WORD_BITS)).astype(np.int64) if shards < 1 << 16 else ((words >> np.uint64(16)) * np.uint64(shards) >> np.uint64(WORD_BITS - 16)).astype(np.int64)
                first = np.flatnonzero(np.diff(shard, prepend=-1)).tolist()
                cuts = list(zip(first, [*first[1:], len(words)]))
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([int(shard[s]) for s, _ in cuts], pa.int64()), pa.array([chunk.as_py()] * len(cuts), pa.int64()),
                        pa.array([packed(words[s:e]) for s, e in cuts], pa.binary()),
                        pa.array([zlib.compress(np.minimum(n[s:e], 1 << 30).astype("<u4").tobytes(), 1) for s, e in cuts], pa.binary()),
                    ],
                    ["shard", "chunk", "words", "n"],
                )

    def count(key, found):
        n = [np.frombuffer(zlib.decompress(x), "<u4") for x in found.column("n").to_pylist()]
        sizes = [len(x) for x in n]
        words = np.concatenate([unpacked(x, k) for x, k in zip(found.column("words").to_pylist(), sizes)])
        order = np.argsort(words, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], words[order[1:]] != words[order[:-1]]]))
        totals = np.add.reduceat(np.concatenate(n)[order].astype(np.int64), first)
        every = np.empty(len(words), np.int64)
        every[order] = np.repeat(totals, np.diff(np.append(first, len(words))))
        out = []
        for chunk, s, e in zip(found.column("chunk").to_pylist(), np.cumsum([0, *sizes[:-1]]).tolist(), np.cumsum(sizes).tolist()):
            held = np.flatnonzero(every[s:e] > 1) + s
            if len(held):
                out.append((chunk, words[held].astype(np.int64), every[held] > HOT_DOCUMENTS))
        return pa.Table.from_arrays(
            [pa.array([c for c, _, _ in out], pa.int64()), pa.array([w for _, w, _ in out], pa.list_(pa.int64())), pa.array([h for _, _, h in out], pa.list_(pa.bool_()))],
            ["chunk", "words", "hot"],
        )

    dealt = chunks.select("chunk", "sizes", "data", "copies").mapInArrow(deal, "shard long, chunk long, words binary, n binary")
    found = dealt.groupBy("shard").applyInArrow(count, "chunk long, words array<long>, hot array<boolean>")
    return found.groupBy("chunk").agg(F.flatten(F.collect_list("words")).alias("words"), F.flatten(F.collect_list("hot")).alias("hot"))


def _anywhere(chunk: int, at: np.ndarray) -> np.ndarray:
    """Keys that spread rows evenly."""
    return (at * 0x9E3779B1 + chunk) & ((1 << 44) - 1)


def _run_rows(key, texts, doc, chunk, at, upto) -> pa.RecordBatch:
    columns = [np.asarray(key, np.int64), None, doc, np.full(len(doc), chunk, np.int64), at, upto]
    arrays = [pa.array([None] * len(doc) if texts is None else texts, pa.binary()) if c is None else pa.array(c, pa.int64()) for c in columns]
    return pa.RecordBatch.from_arrays(arrays, ["key", "text", "doc", "chunk", "at", "upto"])


def _runs(held: DataFrame, length: int, single: bool = False) -> DataFrame:
    """(key, text, doc, chunk, at, upto) for the runs of the words given; rows without text are known to be repeats.

    Equal runs of a chunk are sent once, with the chunk's smallest document; the later documents hold repeats only. With
    ``single``, every string is a run of its own, and whole copies, which the other rows have, are left out.
    """

    def cut(batches):
        for batch in batches:
            columns = (batch.column(c) for c in ("chunk", "ids", "sizes", "data", "copies", "words"))
            for chunk, ids, sizes, data, copies, words in zip(*columns):
                chunk, data, ranks, bounds = chunk.as_py(), data.as_py(), _ranks(ids), _bounds(sizes)
                copied = _is_copy(len(sizes), copies)
                if not single:
                    yield _run_rows(_anywhere(chunk, bounds[:-1][copied]), None, ranks[copied], chunk, bounds[:-1][copied], bounds[1:][copied])
                if not words.is_valid:
                    continue
                first, last, word, doc = minimiser_runs(data, bounds, length)
                own = ~copied[doc]
                first, last, word, doc = first[own], last[own], word[own], doc[own]
                shared = np.sort(words.values.to_numpy().astype(np.uint64))
                if not len(shared):
                    continue
                where = np.searchsorted(shared, word)
                where[where == len(shared)] = 0
                held = shared[where] == word
                first, last, word, doc = first[held], last[held], word[held], ranks[doc[held]]
                if single:
                    n = last - first + 1
                    first = last = np.repeat(first, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                    word, doc = np.repeat(word, n), np.repeat(doc, n)
                smallest: dict[bytes, int] = {}
                texts = [data[a : b + length] for a, b in zip(first.tolist(), last.tolist())]
                for text, d in zip(texts, doc.tolist()):
                    if d < smallest.get(text, LAST_ID + 1):
                        smallest[text] = d
                known = np.array([smallest[text] for text in texts], np.int64) < doc
                # Runs overlap, so the known ones of a document mostly join into one stretch.
                low, high = first[known], np.maximum.accumulate(last[known] + length)
                begin = np.flatnonzero(np.append(True, low[1:] > high[:-1])) if len(low) else np.zeros(0, np.int64)
                low, high, of = low[begin], high[np.append(begin[1:], len(high)) - 1] if len(begin) else high, doc[known][begin]
                yield _run_rows(_anywhere(chunk, low), None, of, chunk, low, high)
                sent = np.flatnonzero(~known)
                rows = [texts[i] for i in sent.tolist()]
                yield _run_rows(word[sent].astype(np.int64), rows, doc[sent], chunk, first[sent], last[sent] + length)

    return held.mapInArrow(cut, "key long, text binary, doc long, chunk long, at long, upto long")


def _window_hashes(raw: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of every string of ``length`` bytes inside the texts raw[bounds[i]:bounds[i+1]]."""
    sizes = np.diff(bounds)
    n = np.maximum(sizes - length + 1, 0)
    text = np.repeat(np.arange(len(n)), n)
    at = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(bounds[:-1], n)
    words = _eights(raw)
    key = np.zeros(len(at), np.uint64)
    for offset in [*range(0, length - 8, 8), length - 8]:
        key = (key ^ words[at + offset]) * np.uint64(0x9E3779B97F4A7C15)
        key ^= key >> np.uint64(32)
    return key, text


def _eights(raw: np.ndarray) -> np.ndarray:
    """The eight bytes at each place of ``raw`` as a number, past its end zeros."""
    padded = np.zeros(len(raw) // 8 * 8 + 24, np.uint8)
    padded[: len(raw)] = raw
    return np.lib.stride_tricks.as_strided(padded.view(np.uint64), (len(raw) + 1,), (1,))


def _with_repeats(rows: pa.Table, length: int) -> np.ndarray:
    """Numbers of the rows that have a string whose hash a row of another document has as well."""
    texts = rows.column("text").combine_chunks()
    texts = texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts
    offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]] if texts.buffers()[2] else np.zeros(0, np.uint8)
    key, row = _window_hashes(raw, offsets - offsets[0], length)
    if not len(key):
        return np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    key, doc = key[order], rows.column("doc").to_numpy()[row[order]]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    apart = np.minimum.reduceat(doc, first) < np.maximum.reduceat(doc, first)
    return np.unique(row[order[np.repeat(apart, np.diff(np.append(first, len(key))))]])


def _solved(rows: pa.Table, length: int) -> pa.RecordBatch:
    """Repeats among the runs of some keys, each complete."""
    rows = rows.take(pa.array(_with_repeats(rows, length)))
    if not len(rows):
        return pa.RecordBatch.from_arrays([pa.array([], pa.int64())] * 3, ["chunk", "at", "upto"])
    keys, texts, docs = rows.column("key").to_numpy(), rows.column("text").to_pylist(), rows.column("doc").to_numpy()
    chunks, at = rows.column("chunk").to_numpy(), rows.column("at").to_numpy()
    number: dict[bytes, int] = {}
    which = np.array([number.setdefault(x, len(number)) for x in texts], np.int64)
    distinct = list(number)
    smallest = np.full(len(distinct), LAST_ID, np.int64)
    np.minimum.at(smallest, which, docs)
    sizes = np.array([len(x) for x in distinct], np.int64)
    copies = docs > smallest[which]
    # Equal strings have equal keys: a run that is alone under its key shares nothing with another run.
    first = np.zeros(len(distinct), np.int64)
    first[which[::-1]] = np.arange(len(which))[::-1]
    _, group, members = np.unique(keys[first], return_inverse=True, return_counts=True)
    shared = np.flatnonzero(members[group] > 1)
    text, offset = first_holders([distinct[i] for i in shared.tolist()], smallest[shared], length) if len(shared) else (shared, shared)
    # Marked strings as intervals of each distinct run, then at every place of that run.
    new = np.concatenate([[True], (text[1:] != text[:-1]) | (offset[1:] != offset[:-1] + 1)]) if len(text) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    stop = np.append(begin[1:], len(text)) - 1 if len(begin) else begin
    owner, low, high = shared[text[begin]], offset[begin], offset[stop] + length
    own = np.flatnonzero(~copies)
    own = own[np.argsort(which[own], kind="stable")]
    from_, upto = np.searchsorted(owner, which[own], "left"), np.searchsorted(owner, which[own], "right")
    n = upto - from_
    pick = np.repeat(from_, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    rows_ = np.repeat(own, n)
    out = (
        np.concatenate([chunks[copies], chunks[rows_]]), np.concatenate([at[copies], at[rows_] + low[pick]]),
        np.concatenate([at[copies] + sizes[which[copies]], at[rows_] + high[pick]]),
    )
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["chunk", "at", "upto"])


def _hot_repeats(strings: DataFrame) -> DataFrame:
    """(chunk, at, upto): single strings that a smaller document has; a string is in one row per chunk at most.

    Tasks aggregate first, so a string that every chunk has is not brought together; the join back is split if it is skewed.
    """
    firsts = strings.where("text IS NOT NULL").groupBy("text").agg(F.min("doc").alias("first"), F.max("doc").alias("last")).where("first < last").select("text", "first")
    later = strings.join(firsts, "text").where("doc > first").select("chunk", "at", "upto")
    return later.unionByName(strings.where("text IS NULL").select("chunk", "at", "upto"))


def _repeats(runs: DataFrame, length: int) -> DataFrame:
    """(chunk, at, upto): bytes that are repeats, from the runs of each key."""
    dealt = runs.repartition(partitions(runs), "key").sortWithinPartitions("key")
    names = ["chunk", "at", "upto"]

    def search(batches):
        waiting, size = [], 0
        for batch in batches:
            known = batch.filter(batch.column("text").is_null())
            yield pa.RecordBatch.from_arrays([known.column(c) for c in names], names)
            waiting.append(batch.filter(batch.column("text").is_valid()))
            size += waiting[-1].nbytes
            if size > SHARD_BYTES:
                whole = pa.Table.from_batches(waiting).combine_chunks()
                keys = whole.column("key").to_numpy()
                complete = int(np.searchsorted(keys, keys[-1], "left"))  # the last key may go on
                if complete:
                    yield _solved(whole.slice(0, complete), length)
                    whole = whole.slice(complete)
                waiting, size = whole.to_batches(), whole.nbytes
        if size:
            yield _solved(pa.Table.from_batches(waiting).combine_chunks(), length)

    return dealt.mapInArrow(search, "chunk long, at long, upto long")


def remove_repeats(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 50, keep: list[str] = (),
    as_text: bool = False,
) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, spans, kept) per row, and the columns ``keep`` as keep_0, keep_1, ....

    Removed is each byte covered by a string of ``length`` bytes (at least 24) that also starts in a document with a
    smaller id; matches stay within documents and strings are judged on the input. ``spans`` are the maximal removed
    runs as start and end, ``kept`` the other bytes; with ``as_text`` as a string, without the bytes of characters that
    a span cuts. Null and empty texts are empty. Rows with the same id are the same
    document: none removes from another. Rows without an id come last and do not remove from each other. An empty table
    gives no rows; other columns are never read.
    """
    if length < K + 8:
        raise ValueError(f"length must be at least {K + 8}")
    keep = list(keep)
    chunks = _chunks(df, id_col, text_col, keep)
    texts = chunks.select("chunk", "ids", "sizes", "data").join(_copies(chunks, length), "chunk", "left")
    total = chunks.select(F.sum(F.length("data"))).first()[0] or 0
    shared = staged(_shared_words(texts, length, total))
    chosen = lambda hot: F.transform(F.filter(F.arrays_zip("words", "hot"), lambda x: x["hot"] == hot), lambda x: x["words"])
    runs = _runs(texts.join(shared.select("chunk", chosen(False).alias("words")), "chunk", "left"), length)
    strings = staged(_runs(texts.join(shared.where(F.exists("hot", lambda x: x)).select("chunk", chosen(True).alias("words")), "chunk"), length, single=True))
    repeats = _repeats(runs, length).unionByName(_hot_repeats(strings)).groupBy("chunk").agg(
        F.collect_list("at").alias("at"), F.collect_list("upto").alias("upto")
    )
    found = chunks.join(repeats, "chunk", "left")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, spans array<struct<start: long, end: long>>, kept " + ("string" if as_text else "binary")
    schema += kept_schema(ids_and_texts(df, id_col, text_col, keep))
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def apply(batches):
        for batch in batches:
            columns = (batch.column(c) for c in ("ids", "sizes", "data", "rest", "at", "upto"))
            for ids, sizes, data, rest, at, upto in zip(*columns):
                raw, bounds = np.frombuffer(data.as_py(), np.uint8), _bounds(sizes)
                depth = np.zeros(len(raw) + 1, np.int64)
                if at.is_valid:
                    np.add.at(depth, at.values.to_numpy(), 1)
                    np.add.at(depth, upto.values.to_numpy(), -1)
                gone = np.cumsum(depth[:-1]) > 0
                rows = {"doc_id": ids.values, "n_bytes": [], "n_removed": [], "n_spans": [], "spans": [], "kept": []}
                for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
                    part = gone[a:b]
                    edges = np.flatnonzero(np.diff(np.concatenate([[False], part, [False]]).astype(np.int8)))
                    spans = [{"start": s, "end": e} for s, e in edges.reshape(-1, 2).tolist()]
                    removed = int(part.sum())
                    text = raw[a:b][~part].tobytes() if removed else raw[a:b].tobytes()
                    for name, value in zip(list(rows)[1:], (b - a, removed, len(spans), spans, text)):
                        rows[name].append(value)
                carried = pa.ipc.open_stream(rest.as_py()).read_all().combine_chunks()
                if as_text:
                    rows["kept"] = [x.decode("utf-8", "ignore") for x in rows["kept"]]
                kinds = [pa.int64()] * 4 + [span, pa.string() if as_text else pa.binary()]
                arrays = [pa.array(v, k) if isinstance(v, list) else v for v, k in zip(rows.values(), kinds)]
                arrays += [carried.column(i).combine_chunks() for i in range(carried.num_columns)]
                yield pa.RecordBatch.from_arrays(arrays, [*rows, *carried.column_names])

    return found.mapInArrow(apply, schema)
