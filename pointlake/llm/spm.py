"""SentencePiece encoding with byte offsets into the original text, and decoding.

A model file is read for its normaliser: a compiled character map (a double-array trie over byte strings and a pool of
replacements), white-space rules and pieces. Normalisation takes the longest prefix the map knows, and records for each
normalised byte the original byte it comes from; so every piece of the encoded text has a span of original bytes.
"""

from __future__ import annotations

import hashlib
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import by_bytes, ids_and_texts, session, tokenizer_path

BATCH_BYTES = 1 << 20
DECODE_ROWS = 50
#: Characters of a long text that are encoded at once, up to the next word.
PIECE_CHARS = 1 << 16
SPACE = "▁"
SPACE_BYTES = SPACE.encode()


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol-buffer message."""
    i = 0

    def varint():
        nonlocal i
        value = shift = 0
        while True:
            byte = data[i]
            i += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while i < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        else:
            size = varint() if kind == 2 else {1: 8, 5: 4}[kind]
            yield key >> 3, data[i : i + size]
            i += size


class CharsMap:
    """Longest-prefix replacement of byte strings by a compiled character map; an empty map replaces nothing."""

    def __init__(self, blob: bytes):
        self.units, self.pool = (), b""
        if blob:
            (size,) = struct.unpack_from("<I", blob)
            self.units = struct.unpack_from(f"<{size // 4}I", blob, 4)
            self.pool = blob[4 + size :]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length of the longest known prefix of data[at:], its replacement)."""
        if not self.units:
            return None
        found, node = None, 0
        unit = self.units[0]
        node ^= _offset(unit)
        for i in range(at, len(data)):
            node ^= data[i]
            if node >= len(self.units):
                break
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - at, self.units[node] & 0x7FFFFFFF
        if found is None:
            return None
        length, start = found
        return length, self.pool[start : self.pool.index(b"\0", start)]


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


class Model:
    """A SentencePiece model: its own normalisation with alignment, the library's merges."""

    def __init__(self, name: str):
        path = tokenizer_path(name)
        with open(path, "rb") as f:
            top = list(_fields(f.read()))
        spec = {n: v for number, value in top if number == 3 for n, v in _fields(value)}
        trainer = {n: v for number, value in top if number == 2 for n, v in _fields(value)}
        self.map = CharsMap(spec.get(2, b""))
        self.dummy, self.squeeze = bool(spec.get(3, 1)), bool(spec.get(4, 1))
        self.escape, self.suffix = bool(spec.get(5, 1)), bool(trainer.get(24, 0))
        pieces = [dict(_fields(value)) for number, value in top if number == 1]
        texts = [p[1].decode() for p in pieces]
        self.end_id = next(i for i, t in enumerate(texts) if t == trainer.get(47, b"</s>").decode())
        # Byte pieces stand for one byte each, all others for their own text.
        self.byte_ids = np.array([p.get(3, 1) == 6 for p in pieces])
        self.sizes = np.array([1 if p.get(3, 1) == 6 else len(t.encode()) for p, t in zip(pieces, texts)], np.int64)
        # Merges stay within a word if no piece has a space mark behind another character.
        plain = {t for p, t in zip(pieces, texts) if p.get(3, 1) == 1}
        byte_fallback = bool(trainer.get(35, 0))
        self.by_word = (
            trainer.get(3, 1) == 2 and byte_fallback and not self.suffix and self.escape
            and not any(SPACE in t.lstrip(SPACE) for t in plain) and not any(p.get(3, 1) == 4 for p in pieces)
        )
        # What a word is encoded with: the same model, fed with text that is normalised already.
        self.inner = _identity(path, top)

    def normalise(self, text: str) -> tuple[bytes, np.ndarray]:
        """(normalised bytes, for each of them and for the end the original byte they come from)."""
        data = text.encode()
        if not self.map.units and not self.squeeze:
            raw = np.frombuffer(data, np.uint8)
            spaces = raw == 32 if self.escape else np.zeros(len(raw), bool)
            align = np.repeat(np.arange(len(raw)), np.where(spaces, len(SPACE_BYTES), 1))
            out = data.replace(b" ", SPACE_BYTES) if self.escape else data
        else:
            parts, sources, at = [], [], 0
            while at < len(data):
                known = self.map.longest(data, at)
                length, new = known if known else (_char_bytes(data[at]), None)
                parts.append(data[at : at + length] if new is None else new)
                sources.append((at, length))
                at += length
            if self.squeeze:
                parts = _squeezed(parts)
            if self.escape:
                parts = [p.replace(b" ", SPACE_BYTES) for p in parts]
            out = b"".join(parts)
            align = np.repeat(np.array([s for s, _ in sources], np.int64), [len(p) for p in parts]) if parts else np.zeros(0, np.int64)
        if self.dummy and out:
            mark = SPACE_BYTES if self.escape else b" "
            out = out + mark if self.suffix else mark + out
            edge = np.full(len(mark), len(data) if self.suffix else (align[0] if len(align) else 0))
            align = np.concatenate([align, edge] if self.suffix else [edge, align])
        return out, np.concatenate([align, [len(data)]]).astype(np.int64)

    def ids(self, normalised: list[str]) -> Iterator[np.ndarray]:
        """Ids of normalised texts; long ones in pieces of whole words where merges cannot cross words."""
        pieces = [self._pieces(t) for t in normalised]
        found = iter(self.inner.encode(list(chain.from_iterable(pieces)), num_threads=1))
        for cut in pieces:
            yield np.concatenate([np.array(next(found), np.int32) for _ in cut]) if len(cut) > 1 else np.array(next(found), np.int32)

    def _pieces(self, text: str) -> list[str]:
        if len(text) <= PIECE_CHARS or not self.by_word:
            return [text]
        out, at = [], 0
        while len(text) - at > PIECE_CHARS:
            # A word begins at a space mark behind another character.
            cut = next((m.start() + 1 for m in _BORDER.finditer(text, at + PIECE_CHARS)), len(text))
            out.append(text[at:cut])
            at = cut
        return out + [text[at:]]

    def encode(self, texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, starts, ends) of each text with the end id; spans are original bytes, the end id's is empty."""
        normal = [self.normalise(t) for t in texts]
        for ids, (_, align) in zip(self.ids([out.decode() for out, _ in normal]), normal):  # ids first: it ends itself
            sizes = self.sizes[ids]
            ends = np.cumsum(sizes)
            starts, stops, n = align[ends - sizes], align[ends], align[-1:]
            yield np.append(ids, np.int32(self.end_id)), np.concatenate([starts, n]), np.concatenate([np.maximum(starts, stops), n])


_BORDER = re.compile(f"[^{SPACE}]{SPACE}")


def _char_bytes(first: int) -> int:
    return 1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4


def _squeezed(parts: list[bytes]) -> list[bytes]:
    """Without spaces at the ends and behind another space."""
    out, space = [], True
    for part in parts:
        kept = bytearray()
        for b in part:
            if b != 32 or not space:
                kept.append(b)
            space = b == 32
        out.append(bytes(kept))
    for i in range(len(out) - 1, -1, -1):
        if out[i]:
            out[i] = out[i].rstrip(b" ")
            if out[i]:
                break
    return out


def _varint(value: int) -> bytes:
    out = bytearray()
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    return bytes([*out, value])


def _identity(path: str, top: list):
    """The library's processor for the same pieces with a normaliser that changes nothing."""
    import sentencepiece

    plain = b"\x0a\x08identity" + b"".join(_varint(n << 3) + b"\x00" for n in (3, 4, 5))
    body = b""
    for number, value in top:
        value = plain if number == 3 else value
        if isinstance(value, bytes):
            body += _varint(number << 3 | 2) + _varint(len(value)) + value
    out = sentencepiece.SentencePieceProcessor()
    out.LoadFromSerializedProto(body)
    return out


_MODELS: dict[str, Model] = {}
_LIBRARIES: dict = {}


def library(name: str):
    """The library's own processor, one per worker process and file."""
    import sentencepiece

    if name not in _LIBRARIES:
        _LIBRARIES[name] = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(name))
    return _LIBRARIES[name]


def model(name: str) -> Model:
    """One model per worker process and file."""
    if name not in _MODELS:
        _MODELS[name] = Model(name)
    return _MODELS[name]


def encode_pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, ids, starts, ends) per row: the ids of the whole text with the end id, and the original byte span of each.

    One narrow pass over batches cut by bytes. Null and empty texts give the end id alone; repeated rows each give a
    row, a null id stays null, an empty table gives none; other columns are never read.
    """
    session(df)

    def run(batches):
        m = model(model_file)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            found = list(m.encode(batch.column("text").to_pylist()))
            offsets = pa.array(np.concatenate([[0], np.cumsum([len(ids) for ids, _, _ in found])]), pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(np.concatenate([f[k] for f in found]), kind)) for k, kind in enumerate((pa.int32(), pa.int64(), pa.int64()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *lists], ["doc_id", "ids", "starts", "ends"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, ids array<int>, starts array<long>, ends array<long>")


def decode_pieces(df: DataFrame, model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """The table with ``ids`` replaced by ``text``, what the library decodes them to; a null list gives a null text."""
    session(df)
    kept = [c for c in df.columns if c != "ids"]
    schema = ", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "ids") + ", text string"

    def run(batches):
        processor = library(model_file)
        for whole in batches:
            for at in range(0, len(whole), DECODE_ROWS):
                batch = whole.slice(at, DECODE_ROWS)
                texts = [None if x is None else processor.decode(x) for x in batch.column("ids").to_pylist()]
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string())], [*kept, "text"])

    return df.mapInArrow(run, schema)


def piece_digests(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_file: str = "piece_bpe_32k.model") -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, covered) per row, in one pass that sends no ids to the JVM.

    Digests are of the decimal ids with the end id, joined by a space, and of the text the library decodes them to;
    ``covered`` counts the original bytes that the pieces' spans cover. Null and empty texts have the end id alone; repeated
    rows each give a row, a null id stays null, an empty table gives none; other columns are never read.
    """
    session(df)

    def run(batches):
        m, processor = model(model_file), library(model_file)
        decimal = np.array([str(i) for i in range(len(m.sizes))], object)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            n, ids_digests, decoded, covered = [], [], [], []
            for ids, starts, ends in m.encode(batch.column("text").to_pylist()):
                n.append(len(ids))
                ids_digests.append(hashlib.sha256(" ".join(decimal[ids].tolist()).encode()).hexdigest())
                decoded.append(hashlib.sha256(processor.decode(ids.tolist()).encode()).hexdigest())
                # Spans ascend; what lies before the furthest end so far is covered already.
                reach = np.maximum.accumulate(np.concatenate([[0], ends]))[:-1]
                covered.append(int(np.maximum(ends - np.maximum(starts, reach), 0).sum()))
            columns = [pa.array(n, pa.int64()), pa.array(ids_digests, pa.string()), pa.array(decoded, pa.string()), pa.array(covered, pa.int64())]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "covered"])

    return ids_and_texts(df, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, covered long")
