"""Encoding of texts with a public byte-level tokenizer, and decoding back to the raw bytes."""

from __future__ import annotations

import base64
import threading
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Folder of the rank files; a parameter of every function here.
FOLDER = "/opt/tokenizers"
# Fixed value: the pre-splitting pattern of the byte-level vocabularies.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The pattern that each vocabulary is made for; ids under another one would be wrong.
PATTERNS = {"byte_bpe_50k": PATTERN, "byte_bpe_multi_50k": PATTERN}
#: Texts longer than this many characters are split at safe boundaries first.
PIECE = 20_000

_SAFE = regex.compile(r"(?<=\P{White_Space})(?=\p{White_Space})|(?<=\p{L})(?=\p{N})|(?<=\p{N})(?=\p{L})")
_LOADED: dict[tuple[str, str], tiktoken.Encoding] = {}
_LOCK = threading.Lock()


def encoder(name: str, folder: str = FOLDER, pattern: str | None = None) -> tiktoken.Encoding:
    """The encoding of ``folder/name.tiktoken``, read once per process.

    pattern: the pre-splitting pattern of a vocabulary that PATTERNS doesn't name; without one such a vocabulary raises ValueError.
    """
    pattern = pattern or PATTERNS.get(name)
    if pattern is None:
        raise ValueError(f"no pre-splitting pattern is known for {name}; pass it")
    path = f"{folder}/{name}.tiktoken"
    with _LOCK:
        if (path, pattern) not in _LOADED:
            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
            _LOADED[path, pattern] = tiktoken.Encoding(name, pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        return _LOADED[path, pattern]


def pieces(text: str, size: int = PIECE) -> Iterator[str]:
    """``text`` in pieces of about ``size`` characters, cut only where no pre-token of PATTERN can span.

    A pre-token holds white space only in front, and never a letter beside a number: between
    what isn't space and a space, and between letter and number, one always ends. Without such a place
    (one word of any length) the piece is as long as it must be.
    """
    at = 0
    while len(text) - at > size:
        cut = _SAFE.search(text, at + size)
        if cut is None:
            break
        yield text[at : cut.start()]
        at = cut.start()
    yield text[at:]


def encode(text: str | None, tokenizer: tiktoken.Encoding) -> list[int]:
    """Ids of ``text`` without special tokens (their strings are ordinary text); none for an empty or null one."""
    if not text:
        return []
    if len(text) <= PIECE or tokenizer._pat_str != PATTERN:  # safe places are known for PATTERN
        return tokenizer.encode_ordinary(text)
    return [i for p in pieces(text) for i in tokenizer.encode_ordinary(p)]


def decode(ids: list[int], tokenizer: tiktoken.Encoding) -> bytes:
    """The raw bytes of ids: any cut of a valid sequence decodes, also inside a character."""
    return b"".join(tokenizer.decode_single_token_bytes(i) for i in ids)


def _texts(column: pa.Array) -> list[str | None]:
    try:
        return column.to_pylist()
    except UnicodeDecodeError:  # bytes that aren't UTF-8 count as replacement characters
        return [None if b is None else b.decode("utf-8", "replace") for b in column.cast(pa.binary()).to_pylist()]


def encoded(docs: DataFrame, key: str, text: str, name: str, folder: str = FOLDER) -> DataFrame:
    """(key, ids array<int>) of every row of ``docs``: whole texts, null and empty ones as empty arrays.

    Repeated rows and null keys each come out. No exchange: the texts are encoded where they are read.
    """
    rows = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    kind = rows.schema["key"].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(name, folder)
        for b in batches:
            ids = [encode(t, tokenizer) for t in _texts(b.column("text"))]
            sizes = np.fromiter(map(len, ids), np.int32, len(ids))
            flat = np.fromiter((i for x in ids for i in x), np.int32, int(sizes.sum()))
            lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(sizes)].astype(np.int32)), pa.array(flat))
            yield pa.RecordBatch.from_pydict({key: b.column("key"), "ids": lists})

    return rows.mapInArrow(kernel, f"`{key}` {kind}, ids array<int>")


def decoded(ids: DataFrame, key: str, name: str, folder: str = FOLDER) -> DataFrame:
    """(key, raw binary) of rows (key, ids); null ids come out as null."""
    kind = ids.schema[key].dataType.simpleString()

    def kernel(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = encoder(name, folder)
        for b in batches:
            raw = [None if x is None else decode(x, tokenizer) for x in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_pydict({key: b.column(key), "raw": pa.array(raw, pa.binary())})

    return ids.select(key, "ids").mapInArrow(kernel, f"`{key}` {kind}, raw binary")
