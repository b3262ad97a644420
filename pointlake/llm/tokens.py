"""Token counts by batch encoding in Arrow functions that return lengths only."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from pointlake.llm.common import by_bytes, ids_and_texts, session, tokenizer_path

#: Bytes of text that are encoded together.
BATCH_BYTES = 4 << 20
#: Characters of a long text that are encoded at once.
LONG_CHARS = 1 << 16
#: A piece without a safe boundary beyond this goes to the tokenizers library, whose merging bears any length.
LONG_WORD = 1 << 17
#: The pre-tokenisation of byte-level BPE files that have `use_regex`.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

# A space between two visible characters always begins a pre-token, so a text may be cut there.
_SAFE = re.compile(r"(?<=\S)(?= \S)")


def safe_pieces(text: str, size: int = LONG_CHARS) -> list[str]:
    """The text cut at safe boundaries into pieces of about ``size`` characters; their tokens together are the text's."""
    if len(text) <= size:
        return [text]
    out, start = [], 0
    while len(text) - start > size:
        found = _SAFE.search(text, start + size)
        if not found:
            break
        out.append(text[start : found.start()])
        start = found.start()
    return [*out, text[start:]]


class Encoder:
    """Ids of whole texts as the tokenizers library gives them for a .json file.

    A byte-level BPE whose ids are its merge ranks is encoded from the same vocabulary by tiktoken, which gives the
    same ids faster; any other file by the tokenizers library.
    """

    def __init__(self, name: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        path = tokenizer_path(name)
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.ranks = _rank_encoding(path)
        self.special = [] if self.ranks is None else sorted(self.ranks.special_tokens_set)

    def _ids(self, text: str) -> list[int]:
        if self.ranks is None or len(text) > LONG_WORD:
            return self.library.encode(text, add_special_tokens=False).ids
        if any(x in text for x in self.special):
            return self.ranks.encode(text, allowed_special="all")
        return self.ranks.encode_ordinary(text)

    def ids(self, texts: list[str]) -> Iterator[list[int]]:
        if self.ranks is None:
            for found in self.library.encode_batch_fast(texts, add_special_tokens=False):
                yield found.ids
            return
        for text in texts:
            pieces = safe_pieces(text)
            yield self._ids(text) if len(pieces) == 1 else [i for piece in pieces for i in self._ids(piece)]


def _rank_encoding(path: str):
    """The file as a rank encoding, or None if it says anything else than byte-level BPE in the order of its ids."""
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = (
        model.get("type", "BPE") == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True)
        and not pre.get("add_prefix_space") and not spec.get("normalizer") and not model.get("dropout")
        and not model.get("ignore_merges") and not model.get("byte_fallback") and not model.get("continuing_subword_prefix")
        and not model.get("end_of_word_suffix")
    )
    added = spec.get("added_tokens") or []
    if not plain or any(" " in t["content"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
        return None
    # Printable stand-ins of the bytes: visible Latin-1 characters stand for themselves, the others follow from U+0100.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in visible]
    byte_of = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}
    special = {t["content"]: t["id"] for t in added}
    vocab = {t: i for t, i in model["vocab"].items() if t not in special}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
    if None in merged or merged != sorted(set(merged)) or len(merged) + 256 != len(vocab):
        return None
    ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items()}
    return tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)


_ENCODERS: dict[str, Encoder] = {}


def encoder(name: str) -> Encoder:
    """One encoder per worker process and file."""
    if name not in _ENCODERS:
        _ENCODERS[name] = Encoder(name)
    return _ENCODERS[name]


def token_counts(
    df: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = "byte_bpe_50k.json", limit: int = 1024
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row.

    One narrow pass: each Arrow batch is cut to ``BATCH_BYTES`` of text and encoded together, and only lengths go back. Long
    texts are cut before words. Null and empty texts have 0 tokens, a null id stays null, repeated rows each give a row, an empty
    table gives none; other columns are never read. Special strings inside a text count as the library's default says.
    """
    session(df)

    def count(batches):
        enc = encoder(tokenizer)
        for batch in by_bytes(batches, "text", BATCH_BYTES):
            lengths = [len(ids) for ids in enc.ids(batch.column("text").to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("n_bytes"), pa.array(lengths, pa.int64())],
                ["doc_id", "n_bytes", "n_tokens"],
            )

    rows = ids_and_texts(df, id_col, text_col).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = rows.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > F.lit(limit))
