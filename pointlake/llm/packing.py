"""Packing of tokenised documents into sequences of fixed length: best fit, then swap-based local search."""

from __future__ import annotations

import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import by_bytes, ids_and_texts, session, staged
from pointlake.llm.tokens import BATCH_BYTES, encoder

#: Pieces that are packed together in a task, about so many in later rounds.
BLOCK_PIECES = 20_000
COLUMNS = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long, free long, grp long"
#: Deals in a row that may save nothing before packing ends.
USELESS_DEALS = 2


def cut_lengths(total: int, limit: int) -> list[int]:
    """Lengths of the pieces of a document: as it is, or pieces of ``limit`` behind a first one with the rest."""
    if total <= limit:
        return [total]
    rest = total % limit
    return [rest] * (rest > 0) + [limit] * (total // limit)


def best_fit(sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Bins of indices: longest first, each into the fullest bin that still holds it. ``mask`` has a bit per free size."""
    free_bins: dict[int, list[int]] = {}
    mask, bins = 0, []
    lengths = sizes.tolist()
    for i in np.argsort(-sizes, kind="stable").tolist():
        size = lengths[i]
        fitting = mask >> size
        if fitting:
            free = size + (fitting & -fitting).bit_length() - 1
            k = free_bins[free].pop()
            if not free_bins[free]:
                mask ^= 1 << free
            bins[k].append(i)
        else:
            free, k = limit, len(bins)
            bins.append([i])
        if left := free - size:
            free_bins.setdefault(left, []).append(k)
            mask |= 1 << left
    return bins


def _exchange(taker: list[int], donor: list[int], size: list[int], free: int) -> tuple[int, tuple, tuple]:
    """(gain, of donor, of taker) of the move or exchange that fills ``taker`` most; gain 0 if there is none."""
    best = (0, (), ())
    for x, i in enumerate(donor):
        gain = size[i]
        if best[0] < gain <= free:
            best = (gain, (i,), ())
        for j in taker:
            if best[0] < (one := gain - size[j]) <= free:
                best = (one, (i,), (j,))
            if one > free:  # two of the taker for one
                for k in taker:
                    if k != j and best[0] < one - size[k] <= free:
                        best = (one - size[k], (i,), (j, k))
            else:  # one of the taker for two
                for k in donor[x + 1 :]:
                    if best[0] < one + size[k] <= free:
                        best = (one + size[k], (i, k), (j,))
        if best[0] == free:
            break
    return best


def local_search(bins: list[list[int]], sizes: np.ndarray, limit: int) -> list[list[int]]:
    """Moves and exchanges between underfull bins, each raising the sum of squared fills, until no bin can be emptied.

    The emptiest bin gives to the others, those with most room first. Ends at the bound of total length, or when every
    open bin has failed to be emptied. Bins with the same lengths are tried once.
    """
    size = sizes.tolist()
    fill = [sum(size[i] for i in b) for b in bins]
    least = -(-sum(fill) // limit)
    bins = [list(b) for b in bins]
    numbers: dict[tuple, int] = {}

    def kind(k):
        return numbers.setdefault(tuple(sorted(size[i] for i in bins[k])), len(numbers))

    kinds = [kind(k) for k in range(len(bins))]
    # Kinds of donors that no bin can take anything from, until a bin changes.
    alive, stuck, settled = len(bins), set(), set()
    while alive > least:
        open_bins = [k for k in range(len(bins)) if 0 < fill[k] < limit and k not in stuck]
        open_bins.sort(key=fill.__getitem__)
        stuck.update(done := [k for k in open_bins if kinds[k] in settled])
        if done:
            continue
        if len(open_bins) < 2:
            break
        donor, takers = open_bins[0], open_bins[1:]
        moved, ever, useless = True, False, set()
        while moved and fill[donor]:
            moved = False
            for k in takers:
                if not fill[donor]:
                    break
                free = limit - fill[k]
                if not free or fill[k] < fill[donor] or kinds[k] in useless:
                    continue
                gain, given, back = _exchange(bins[k], bins[donor], size, free)
                if not gain:
                    useless.add(kinds[k])
                    continue
                moved = ever = True
                bins[k] = [i for i in bins[k] if i not in back] + list(given)
                bins[donor] = [i for i in bins[donor] if i not in given] + list(back)
                fill[k] += gain
                fill[donor] -= gain
                kinds[k], kinds[donor] = kind(k), kind(donor)
                useless.clear()
        if ever:
            settled.clear()
        if fill[donor]:
            stuck.add(donor)
            settled.add(kinds[donor])
        else:
            alive -= 1
    return [b for b in bins if b]


def _packed(rows: pd.DataFrame, limit: int, group: int, base: int) -> pd.DataFrame:
    """The pieces with sequence, offset and the room that their sequence leaves.

    Pieces that have sequences keep them if these are not fewer afterwards.
    """
    sizes = rows["length"].to_numpy(np.int64)
    bins = local_search(best_fit(sizes, limit), sizes, limit)
    if "sequence_id" in rows and rows["sequence_id"].nunique() <= len(bins):
        order = np.lexsort((rows["offset"].to_numpy(np.int64), rows["sequence_id"].to_numpy(np.int64)))
        ids = rows["sequence_id"].to_numpy(np.int64)[order]
        bins = [b.tolist() for b in np.split(order, np.flatnonzero(np.diff(ids)) + 1)]
    seq, offset = np.empty(len(rows), np.int64), np.empty(len(rows), np.int64)
    free = np.zeros(len(rows), np.int64)
    for k, members in enumerate(bins):
        ends = np.cumsum(sizes[members])
        seq[members], offset[members] = base + k, ends - sizes[members]
        free[members] = limit - ends[-1]
    return rows.assign(sequence_id=seq, offset=offset, free=free, grp=np.int64(group))


def pieces_of(ids: list[int], end_id: int, limit: int) -> Iterator[tuple[int, int, int, int]]:
    """(piece, start, length, crc32) of a document's ids with the end id."""
    words = array("I", [*ids, end_id])
    if sys.byteorder == "big":
        words.byteswap()
    data, start = memoryview(words).cast("B"), 0
    for k, n in enumerate(cut_lengths(len(ids) + 1, limit)):
        yield k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])
        start += n


def _again(carried: DataFrame, limit: int, level: int, groups: int) -> DataFrame:
    """The sequences dealt into so many groups, other ones at each level, and packed again in each."""

    def run(key, found):
        rows, group = found.to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get), key[0].as_py()
        out = _packed(rows, limit, group, (level << 50) + (group << 26))
        return pa.Table.from_pandas(out[ARROW.names], schema=ARROW, preserve_index=False)

    dealt = carried.withColumn("grp", F.pmod(F.xxhash64("sequence_id", F.lit(level)), F.lit(groups)).cast("long"))
    return dealt.groupBy("grp").applyInArrow(run, COLUMNS)


def pack_documents(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json",
    limit: int = 2048, end_id: int = 0,
) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): every piece of every row and its place.

    Each task tokenises its documents and packs them in blocks (best fit, then local search) without a shuffle. All
    sequences that leave any room are dealt by hash into groups and packed again, in rounds, until
    their number is that of their ids over the limit, all were in one group, or two deals in a row saved nothing. Blocks and groups are cut by count, so one hot source or id is as good as any. Every table between rounds is written to the shared
    folder. Null and empty texts are one end id; rows with a null id or a repeated id are packed like any other; an
    empty table gives no rows; other columns are never read.
    """
    session(df)
    names = [c.split()[0] for c in COLUMNS.split(", ")]

    def first(batches):
        enc, group = encoder(tokenizer), TaskContext.get().partitionId()
        rows, count, base = [], 0, group << 26

        def flush():
            nonlocal rows, base
            table = pd.DataFrame(rows, columns=names[:5])
            table["doc_id"] = table["doc_id"].astype("Int64")
            rows, out = [], _packed(table, limit, group, base)
            base += len(out)
            return pa.RecordBatch.from_pandas(out[names], schema=ARROW, preserve_index=False)

        for batch in by_bytes(batches, "text", BATCH_BYTES):
            doc_ids = batch.column("doc_id").to_pylist()
            for doc_id, ids in zip(doc_ids, enc.ids(batch.column("text").to_pylist())):
                rows.extend((doc_id, *piece) for piece in pieces_of(ids, end_id, limit))
                if len(rows) >= BLOCK_PIECES:
                    yield flush()
        if rows:
            yield flush()

    out = staged(ids_and_texts(df, id_col, text_col).mapInArrow(first, COLUMNS))
    done, level, useless = [], 1, 0
    sequences = F.coalesce(F.sum((F.col("offset") == 0).cast("long")), F.lit(0))
    while True:
        carried, full = out.where("free > 0"), out.where("free = 0")
        pieces, before, total = carried.agg(F.count(F.lit(1)), sequences, F.coalesce(F.sum("length"), F.lit(0))).first()
        done.append(full)
        groups = -(-pieces // BLOCK_PIECES)
        if before <= -(-total // limit):
            out = carried
            break
        out = staged(_again(carried, limit, level, groups))
        after = out.agg(sequences).first()[0]
        useless = 0 if after < before else useless + 1
        if groups == 1 or useless == USELESS_DEALS or after <= -(-total // limit):
            break
        level += 1
    for rows in done:
        out = out.unionByName(rows)
    return out.drop("free", "grp")


ARROW = pa.schema([
    ("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()),
    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("free", pa.int64()), ("grp", pa.int64()),
])
