"""Postings as lists of ids by token, which are far fewer rows to shuffle and to sort than the postings.

A chunk (token STRING, slice BIGINT, ids ARRAY<BIGINT>) holds part of a token's
list, all of it in one range of 2**SLICE_BITS ids; a token has as many chunks
as it happens to have. No list is longer than a range has ids.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

SLICE_BITS = 20
#: Words, repeated ones too, that a task gathers before it hands on their chunks; bytes of text that it cuts into words at once.
GATHERED, TEXT_BYTES = 4_000_000, 8 << 20
CHUNKS = "token string, slice long, ids array<long>"
_FIELDS = ["token", "slice", "ids"]
#: ASCII letters lowered, digits kept, all else blank: the rule of functions.text.tokens on the bytes of UTF-8.
_WORDS = bytes(c if chr(c) in "abcdefghijklmnopqrstuvwxyz0123456789" else c + 32 if 65 <= c <= 90 else 32 for c in range(256))


def _order(*keys: np.ndarray) -> np.ndarray:
    """The stable order by whole numbers from 0 on, the last key first. 16 bits at a time, which numpy sorts by radix."""
    order = None
    for key in keys:
        for shift in range(0, int(key.max()).bit_length(), 16):
            part = (key >> shift).astype(np.uint16)
            step = np.argsort(part if order is None else part[order], kind="stable")
            order = step if order is None else order[step]
    return np.arange(len(keys[0])) if order is None else order


def _lists(tokens: pa.Array, codes: np.ndarray, rows: np.ndarray, ids: pa.Array) -> pa.RecordBatch:
    """The chunks of words, given by their places in ``tokens`` and by the places of their texts in ``ids``; each word of a text once."""
    places = pc.shift_right(ids, SLICE_BITS).dictionary_encode("encode")
    at = places.indices.to_numpy()[rows]
    order = _order(codes, at)
    codes, at, rows = codes[order], at[order], rows[order]
    new = np.append(True, (codes[1:] != codes[:-1]) | (at[1:] != at[:-1]))
    once = new | np.append(True, rows[1:] != rows[:-1])
    codes, at, rows, new = codes[once], at[once], rows[once], new[once]
    first = np.flatnonzero(new)
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(codes)), pa.int32()), ids.take(pa.array(rows)))
    return pa.RecordBatch.from_arrays([tokens.take(pa.array(codes[first])), places.dictionary.take(pa.array(at[first])), lists], _FIELDS)


def _words(texts: pa.Array) -> tuple[np.ndarray, pa.DictionaryArray]:
    """How many pieces each text has and the pieces of all; some are empty. A null has none but such."""
    held = pc.fill_null(texts.cast(pa.string()), "")
    _, ends, data = held.buffers()
    ends = np.frombuffer(ends, np.int32)[held.offset : held.offset + len(held) + 1] if len(held) else np.zeros(1, np.int32)
    plain = (data.slice(ends[0], ends[-1] - ends[0]).to_pybytes() if data else b"").translate(_WORDS)
    pieces = pc.ascii_split_whitespace(pa.StringArray.from_buffers(len(held), pa.py_buffer(ends - ends[0]), pa.py_buffer(plain)))
    return pc.list_value_length(pieces).to_numpy(), pieces.flatten().dictionary_encode()


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, pa.Array]]:
    """(ids, texts) of batches in parts of TEXT_BYTES, but a text at least."""
    for batch in batches:
        ids, texts = batch.columns[:2]
        upto = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(), dtype=np.int64)
        start = 0
        while start < len(ids):
            before = upto[start - 1] if start else 0
            end = max(start + 1, int(np.searchsorted(upto, before + TEXT_BYTES, "right")))
            yield ids[start:end], texts[start:end]
            start = end


def _gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def chunks() -> Iterator[pa.RecordBatch]:
        pieces = pa.chunked_array(words).unify_dictionaries().chunks
        tokens, codes = pieces[0].dictionary, np.concatenate([p.indices.to_numpy() for p in pieces])
        rows = np.repeat(np.arange(sum(map(len, ids)), dtype=np.int32), np.concatenate(lengths))
        if (empty := tokens.index("").as_py()) >= 0:
            codes, rows = codes[codes != empty], rows[codes != empty]
        if len(codes):
            yield _lists(tokens, codes, rows, pa.concat_arrays(ids).cast(pa.int64()))

    ids, lengths, words, held = [], [], [], 0
    for some, texts in _parts(batches):
        n, pieces = _words(texts)
        ids.append(some)
        lengths.append(n)
        words.append(pieces)
        held += len(pieces)
        if held >= GATHERED:
            yield from chunks()
            ids, lengths, words, held = [], [], [], 0
    if ids:
        yield from chunks()


def gathered(corpus: DataFrame) -> DataFrame:
    """The chunks of a corpus (doc_id, text), each token of a text once."""
    return corpus.select("doc_id", "text").mapInArrow(_gather, CHUNKS)
