"""Near-duplicates by SimHash: 64-bit fingerprints compared exactly, tile against tile; by shingle sets on demand."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window as W, functions as F

from pointlake.llm import jaccard
from pointlake.llm.common import by_bytes, discard, ids_and_texts, kept_names, kept_schema, session, staged
from pointlake.llm.jaccard import parities as _parities  # noqa: F401
from pointlake.operators.graph import components
from pointlake.session import is_empty

BATCH_BYTES = 8 << 20
SEED = 42
#: Most fingerprints of a tile, and rows of one that are compared at once.
TILE, STRIP = 16_384, 64
#: Widest radius for which tiles are told apart by both halves' counts; wider ones would make too many of them meet.
HALVES_UPTO = 6
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17


def shingles(text: str, width: int) -> np.ndarray:
    """Hashes of a text's word shingles in their order, repeats included; none without words."""
    from xxhash import xxh64_intdigest

    words = text.encode().lower().split()  # A-Z only, and the six ASCII white-space bytes only
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words]) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = max(len(words) - width + 1, 1)
    starts, ends = starts[:last].tolist(), ends[min(width, len(words)) - 1 :].tolist()
    return np.fromiter((xxh64_intdigest(joined[s:e], SEED) for s, e in zip(starts, ends)), np.uint64, last)


def _print(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        bits = np.unpackbits(hashes[at : at + CHUNK].astype(">u8").view(np.uint8)).reshape(-1, 64)
        ones += bits.sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes)).view(">i8")[0])


def fingerprint(text: str, width: int) -> int:
    """Signed 64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    return _print(shingles(text, width))


def fingerprints(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, keep: list[str] = ()) -> DataFrame:
    """(doc_id, fp) and the kept columns per row in one narrow pass."""
    session(df)
    rows = ids_and_texts(df, id_col, text_col, keep)
    kept = kept_names(rows)

    def run(batches):
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = [fingerprint(t, width) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(found, pa.int64()), *(batch.column(c) for c in kept)], ["doc_id", "fp", *kept])

    return rows.mapInArrow(run, "doc_id long, fp long" + kept_schema(rows))


def _join_roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> list[np.ndarray]:
    """Unites the sets of a[i] and b[i]; returns the pairs that united two sets, earlier ones first.

    Every entry of ``parent`` points to the smallest of its set before and afterwards.
    """
    used, index = [], np.arange(len(a))
    while True:
        ra, rb = parent[a[index]], parent[b[index]]
        apart = ra != rb
        if not apart.any():
            return used
        index, ra, rb = index[apart], ra[apart], rb[apart]
        low, high = np.minimum(ra, rb), np.maximum(ra, rb)
        moved, first = np.unique(high, return_index=True)
        parent[moved] = low[first]
        used.append(index[first])
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent[:] = up


def linked(a: np.ndarray, b: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """(from, to): links between two tiles, or within one if they are the same, thinned to a spanning forest.

    All pairs are compared by exclusive or and bit counts, but for strips whose first 16 bits hold counts too far apart.
    Closer pairs of a strip enter the forest first.
    """
    same = a is b
    nodes = a if same else np.concatenate([a, b])
    ka, kb = (np.bitwise_count((x.view(np.uint64) >> np.uint64(48)).astype(np.uint16)) for x in (a, b))
    oa, ob = np.argsort(ka, kind="stable"), np.argsort(kb, kind="stable")
    ka, kb = ka[oa].astype(np.int64), kb[ob].astype(np.int64)
    sa, sb = a[oa].view(np.uint64), b[ob].view(np.uint64)  # of negative numbers, numpy counts the bits of the absolute value
    parent = np.arange(len(nodes))
    src, dst = [], []
    for at in range(0, len(sa), STRIP):
        rows = sa[at : at + STRIP]
        low, high = ka[at], ka[min(at + STRIP, len(sa)) - 1]
        begin, end = np.searchsorted(kb, low - radius, "left"), np.searchsorted(kb, high + radius, "right")
        if same:
            begin = max(begin, at)
        bits = np.bitwise_count(rows[:, None] ^ sb[None, begin:end])
        i, j = np.nonzero(bits <= radius)
        if len(i):
            order = np.argsort(bits[i, j], kind="stable")
            x, y = oa[at + i[order]], ob[begin + j[order]] + (0 if same else len(a))
            for used in _join_roots(parent, x, y):
                src.append(nodes[x[used]])
                dst.append(nodes[y[used]])
    empty = np.zeros(0, np.int64)
    return np.concatenate([empty, *src]), np.concatenate([empty, *dst])


def links(fps: DataFrame, radius: int) -> DataFrame:
    """(src, dst): links of distinct fingerprints within ``radius`` bits, thinned to forests that connect the same.

    A tile holds the fingerprints with the same bit counts in the upper and in the lower half (for a wide radius, the
    same count in all), cut into parts of TILE. Tiles whose counts differ by more than the radius cannot hold a link and
    never meet; all others do, as whole blocks.
    """
    session(fps)
    halves = radius <= HALVES_UPTO
    upper = F.shiftrightunsigned("fp", 32) if halves else F.col("fp")
    lower = F.bit_count(F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))) if halves else F.lit(0)
    rows = fps.select("fp", F.bit_count(upper).cast("int").alias("up"), lower.cast("int").alias("low"))
    # At most 33 x 33 tiles.
    tiles = rows.groupBy("up", "low").agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    blocks = staged(
        rows.join(F.broadcast(tiles), ["up", "low"]).groupBy("up", "low", part.alias("part"))
        .agg(F.collect_list("fp").alias("fps"))
    )
    steps = [(u, v) for u in range(-radius, radius + 1) for v in (range(-radius, radius + 1) if halves else [0]) if abs(u) + abs(v) <= radius]
    around = F.explode(F.array(*(F.struct((F.col("up") + u).alias("up"), (F.col("low") + v).alias("low")) for u, v in steps)))
    meets = blocks.select(F.struct("up", "low", "part").alias("own"), "fps", around.alias("near")).select("own", "fps", "near.up", "near.low")
    meets = meets.join(F.broadcast(tiles), ["up", "low"]).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    other = F.struct("up", "low", "part")
    pairs = meets.select(F.least("own", other).alias("a"), F.greatest("own", other).alias("b"), "fps")
    pairs = pairs.groupBy("a", "b").agg(F.collect_list("fps").alias("fps")).select("fps")

    def compare(batches):
        for batch in batches:
            for blocks in batch.column("fps"):
                arrays = [blocks.values[k].values.to_numpy() for k in range(len(blocks.values))]
                src, dst = linked(arrays[0], arrays[-1], radius)
                yield pa.RecordBatch.from_arrays([pa.array(src, pa.int64()), pa.array(dst, pa.int64())], ["src", "dst"])

    return pairs.mapInArrow(compare, "src long, dst long")


def similarity(a: str, b: str, width: int) -> float:
    """Jaccard similarity of two texts' sets of word shingles; 1 for two texts without words."""
    sets = []
    for text in (a, b):
        words = text.encode().lower().split()
        sets.append({tuple(words[i : i + width]) for i in range(max(len(words) - width + 1, 1))} if words else set())
    union = sets[0] | sets[1]
    return len(sets[0] & sets[1]) / len(union) if union else 1.0


def _labels(edges: DataFrame) -> DataFrame:
    """(v, label) of all ends of the links (src, dst)."""
    ends = edges.select(F.col("src").alias("v")).unionByName(edges.select(F.col("dst").alias("v"))).distinct()
    graph = F.lit(0).alias("graph")
    return components(ends.select(graph, "v"), edges.select(graph, "src", "dst"), ["graph"], mode="weak").select("v", "label")


def near_duplicates(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 4, radius: int = 4, keep: list[str] = (),
    least_similarity: float | None = None,
) -> DataFrame:
    """(doc_id, fp, component_id, stays) per row: the smallest id reachable over links of at most ``radius`` bits.

    Equal fingerprints are one node, whatever their number; nodes are compared tile by tile, each pair of tiles returns a
    forest of its links, and components follow from these by rounds of joins. With ``least_similarity``, nodes are distinct
    shingle sets and the links are exactly the pairs that are that similar (in whole percents); the fingerprints within
    ``radius`` only find most of them early. ``stays`` is true for one row of each component, one with its smallest id. The
    columns ``keep`` follow as keep_0, keep_1, .... Null and empty texts have fingerprint zero and are linked like any
    other; repeated rows each give a row; a row with a null id gets the smallest id of its component, null if there is
    none; an empty table gives none; other columns are never read.
    """
    if least_similarity is not None:
        return _similar_rows(df, id_col, text_col, width, radius, list(keep), round(100 * least_similarity))
    docs = staged(fingerprints(df, id_col, text_col, width, keep).withColumn("row", F.monotonically_increasing_id()))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "row")
    nodes = docs.groupBy("fp").agg(F.min(own).alias("first")).withColumn("v", F.col("fp"))
    edges = staged(links(nodes.select("fp"), radius))
    labelled = nodes.join(_labels(edges), "v", "left").withColumn("label", F.coalesce("label", "v"))
    smallest = labelled.groupBy("label").agg(F.min("first").alias("smallest"))
    named = labelled.select("fp", "label").join(smallest, "label").select("fp", "smallest")
    return docs.join(named, "fp").select(
        "doc_id", "fp", F.col("smallest.doc_id").alias("component_id"), (F.col("row") == F.col("smallest.row")).alias("stays"),
        *(f"keep_{i}" for i in range(len(keep))),
    )


def _similar_rows(df: DataFrame, id_col: str, text_col: str, width: int, radius: int, keep: list[str], percent: int) -> DataFrame:
    """``near_duplicates`` by the similarity of shingle sets; texts are read again in the end instead of being copied.

    The fingerprints' forests are verified first and join most of what is similar. The exact join of the sets adds what
    they miss: pairs beyond the radius, and those whose way in the forest led over a text that is not similar.
    """
    session(df)
    rows = staged(jaccard.set_rows(df, id_col, text_col, width, mark=lambda t: fingerprint(t, width)))
    docs = rows.where("token IS NULL").select("doc_id", "key", "n", F.col("mark").alias("fp"))
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id")
    nodes = docs.groupBy("key").agg(F.min(own).alias("first"), F.min("fp").alias("fp"), F.min("n").alias("n"))
    nodes = staged(nodes.withColumn("v", F.monotonically_increasing_id()))
    first = nodes.where("n > 0").groupBy("fp").agg(F.min("v").alias("v"))
    near = links(first.select("fp"), radius)
    for c in ("src", "dst"):
        near = near.join(first.select(F.col("fp").alias(c), F.col("v").alias(f"v_{c}")), c)
    near = staged(near.select(F.least("v_src", "v_dst").alias("src"), F.greatest("v_src", "v_dst").alias("dst")).distinct())
    sigs = jaccard.signatures(df, rows, id_col, text_col, width, percent)
    index = staged(jaccard.shared_entries(sigs).join(nodes.select("key", "v"), "key").select("sig", "v", "n"))
    discard(sigs)
    needed = index.select("v").unionByName(near.select(F.col("src").alias("v"))).unionByName(near.select(F.col("dst").alias("v"))).distinct()
    sets = jaccard.candidate_sets(df, staged(nodes.join(needed, "v").select("v", "key")), id_col, text_col, width)
    known = staged(jaccard.verified(near, sets, percent))
    edges = staged(jaccard.links(index, sets, percent, known).distinct())
    discard(index, sets, near, known)
    labelled = staged(nodes.join(_labels(edges), "v", "left").select("key", "first", "fp", F.coalesce("label", "v").alias("label")))
    smallest = labelled.groupBy("label").agg(F.min(F.struct("first", "key")).alias("smallest"))
    named = staged(labelled.join(smallest, "label").select(
        "key", "fp", F.col("smallest.first.doc_id").alias("component_id"), (F.col("smallest.key") == F.col("key")).alias("names")
    ))
    chosen = F.col("names") & F.col("doc_id").eqNullSafe(F.col("component_id"))
    # Rows with one id and one set, of which a single one stays: mostly none.
    twice = staged(docs.join(named, "key").where(chosen).groupBy("key").count().where("count > 1").select("key"))
    discard(nodes, labelled, edges, rows)
    source = jaccard.with_keys(ids_and_texts(df, id_col, text_col, keep), width)
    kept = [f"keep_{i}" for i in range(len(keep))]
    names = ["doc_id", "fp", "component_id", "stays", *kept]
    if is_empty(twice):
        return source.join(named, "key").withColumn("stays", chosen).select(*names)
    single = source.join(twice, "key", "left_anti").join(named, "key").withColumn("stays", chosen)
    number = F.row_number().over(W.partitionBy("key", "doc_id").orderBy(F.xxhash64(*kept) if kept else F.lit(0)))
    others = source.join(twice, "key", "left_semi").join(named, "key").withColumn("stays", chosen & (number == 1))
    return single.select(*names).unionByName(others.select(*names))
