"""Encoding of the whole corpus with a public byte-level tokenizer.

Method: tiktoken with a local rank file. Long texts are cut at safe boundaries before encoding, so
that no text needs time or stack beyond its length, and ids are decoded by joining raw bytes.

Defined ids: null and empty texts give an empty list. Special tokens are never produced; their names
in a text are ordinary text. Any other text is encoded whole, whatever its length.

The rank file and split pattern are parameters (``TokenizerSpec``); each Python worker reads the file
once. Encoding is a narrow step: no shuffle (but for a table of fewer files than task slots, which
is spread first).
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqloom.session import spread

#: The published split pattern of this tokenizer.
GPT_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Letters of a stretch that is encoded at once, and of a blank run that is encoded by itself.
STRETCH, LONG_BLANK = 100_000, 5_000
#: Output rows are sent on when they hold about so many ids.
IDS_PER_BATCH = 2_000_000

_SAFE = regex.compile(r"(?<=\S)(?=\s)")
_SAFE_WITHIN_WORD = regex.compile(r"(?<=\p{L})(?=[^\s\p{L}\p{N}'])|(?<=[^\s\p{L}\p{N}'])(?=[\p{L}\p{N}])|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_BLANKS = regex.compile(r"\s{%d,}" % LONG_BLANK)


@dataclass(frozen=True)
class TokenizerSpec:
    rank_file: str = "/opt/tokenizers/byte_bpe_50k.tiktoken"
    pattern: str = GPT_PATTERN


_LOADED: dict = {}


def encoding(spec: TokenizerSpec):
    """The tiktoken encoding, made once in each process."""
    if spec not in _LOADED:
        import tiktoken

        with open(spec.rank_file, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}
        _LOADED[spec] = tiktoken.Encoding(os.path.basename(spec.rank_file), pat_str=spec.pattern, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[spec]


def stretches(text: str, size: int = STRETCH) -> Iterator[str]:
    """Cut a text where the pattern splits in any case: before white space, else at a change of class."""
    at = 0
    while len(text) - at > size:
        found = _SAFE.search(text, at + size) if size else None
        near = _SAFE_WITHIN_WORD.search(text, at + size, found.start() if found else len(text)) if not found or found.start() > at + 2 * size else None
        cut_at = (near or found).start() if near or found else len(text)
        yield text[at:cut_at]
        at = cut_at
    if at < len(text):
        yield text[at:]


def _encode_stretch(enc, text: str) -> list[np.ndarray]:
    """Long runs of blanks are one piece of the pattern, but for the last blank before a word."""
    out, at = [], 0
    for m in _BLANKS.finditer(text) if len(text) > LONG_BLANK else ():
        end = m.end() - (m.end() < len(text))
        if m.start() > at:
            out.append(enc.encode_to_numpy(text[at : m.start()], disallowed_special=()))
        out.append(np.asarray(enc._encode_single_piece(text[m.start() : end]), np.uint32))
        at = end
    if at < len(text):
        out.append(enc.encode_to_numpy(text[at:], disallowed_special=()))
    return out


def encode(text: str | None, spec: TokenizerSpec = TokenizerSpec()) -> np.ndarray:
    if not text:
        return np.zeros(0, np.uint32)
    enc = encoding(spec)
    if len(text) <= LONG_BLANK:
        return enc.encode_to_numpy(text, disallowed_special=())
    parts = [ids for stretch in stretches(text) for ids in _encode_stretch(enc, stretch)]
    return np.concatenate(parts) if len(parts) > 1 else parts[0]


def decode(ids, spec: TokenizerSpec = TokenizerSpec()) -> str:
    """Text of a list of ids. The bytes of all tokens are joined first: one letter may span tokens."""
    return encoding(spec).decode_bytes(list(ids)).decode("utf-8", "replace")


def token_ids(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: TokenizerSpec = TokenizerSpec()) -> DataFrame:
    """(id, ids): the token ids of each row's text; repeated ids stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, held, n, since = batch.column(0), [], 0, 0
            for i, text in enumerate(batch.column(1)):
                held.append(encode(text.as_py(), spec))
                n += len(held[-1])
                if n >= IDS_PER_BATCH or i == batch.num_rows - 1:
                    offsets = np.concatenate(([0], np.cumsum([len(x) for x in held]))).astype(np.int32)
                    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(held).astype(np.int32)))
                    yield pa.RecordBatch.from_arrays([keys.slice(since, len(held)), lists], names=[id_col, "ids"])
                    held, n, since = [], 0, i + 1

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", spec: TokenizerSpec = TokenizerSpec()) -> DataFrame:
    """(id, n_tokens). Only counts leave the Python workers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes = [len(encode(text.as_py(), spec)) for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], names=[id_col, "n_tokens"])

    kind = df.schema[id_col].dataType.simpleString()
    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, f"`{id_col}` {kind}, n_tokens long")


def decoded(df: DataFrame, ids_col: str = "ids", spec: TokenizerSpec = TokenizerSpec()) -> DataFrame:
    """Add ``text`` decoded from the ids; null ids give null."""
    keep = [f for f in df.schema.fields if f.name != "text"]
    names = [f.name for f in keep]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x.as_py() is None else decode(x.as_py(), spec) for x in batch.column(names.index(ids_col))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*names, "text"])

    from pyspark.sql.types import StringType, StructField, StructType

    return df.select(*names).mapInArrow(run, StructType([*keep, StructField("text", StringType())]))
