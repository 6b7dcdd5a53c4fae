"""Whole columns of text to words in compiled code: one dictionary of distinct words a batch."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: ASCII letters lower-cased, every other byte as it is.
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))
#: Lower-cased, and a space for all but digits, ASCII letters and bytes of other characters.
ALNUM = bytes(c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in LOWER)


def parts(batches: Iterator[pa.RecordBatch], column: int, limit: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """The same rows in batches whose texts (in the given column) have about limit bytes, to bound memory."""
    for batch in batches:
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        cuts = [0, *(np.flatnonzero(np.diff(size // limit)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a < b:
                yield batch.slice(a, b - a)
                pa.default_memory_pool().release_unused()  # workers stay, so memory that they keep adds up


def translated(texts: pa.Array, table: bytes) -> pa.Array:
    """texts with each byte replaced by the table's; null becomes empty."""
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    texts = pa.concat_arrays([texts, pa.array([], pa.large_string())])  # its own bytes only, from offset 0
    _, offsets, data = texts.buffers()
    changed = (data.to_pybytes() if data else b"").translate(table)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(texts), [None, offsets, pa.py_buffer(changed)]).view(pa.large_string())


def words(texts: pa.Array, table: bytes = LOWER) -> tuple[np.ndarray, pa.Array]:
    """Bounds of each row's words (one more than rows), and all words in order.

    Words are what ASCII white space (space, \\t to \\r) separates.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(translated(texts, table)))
    flat = lists.flatten()
    bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).to_numpy(zero_copy_only=False))]).astype(np.int64)
    keep = pc.greater(pc.binary_length(flat), 0)
    if not pc.all(keep).as_py():  # a row without words gives one empty string
        kept = np.concatenate([[0], np.cumsum(keep.to_numpy(zero_copy_only=False))]).astype(np.int64)
        bounds, flat = kept[bounds], flat.filter(keep)
    return bounds, flat


def coded(flat: pa.Array) -> tuple[np.ndarray, list[str]]:
    """Words as numbers, and the distinct words that these count."""
    d = flat.dictionary_encode()
    return d.indices.to_numpy(zero_copy_only=False), d.dictionary.to_pylist()
