"""Words of whole texts, cut with numpy over one Arrow batch at a time.

Tasks get Arrow batches from Spark.  A batch is walked in slices of bounded
text size (:func:`slices`), and the words of a slice become one Arrow array
without a Python object per word (:func:`cut_words`): a 256-entry table says
which bytes belong to a word, word ends come from one difference, and equal
words share a dictionary code.  All word rules used here are rules on UTF-8
bytes, so no decoding is needed.
"""

from __future__ import annotations

import ctypes
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SLICE_BYTES = 1 << 20

#: ASCII white space (0x20 and 0x09 to 0x0D).
WHITE = [0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]


def white_words() -> np.ndarray:
    """Bytes of words ``[^\\x20\\x09-\\x0D]+``."""
    table = np.ones(256, dtype=bool)
    table[WHITE] = False
    return table


def alnum_words() -> np.ndarray:
    """Bytes of words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing."""
    table = np.zeros(256, dtype=bool)
    table[0x30:0x3A] = True
    table[0x61:0x7B] = True
    table[0x80:] = True
    return table


def _ascii_lower() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[0x41:0x5B] += 0x20
    return table


LOWER = _ascii_lower()


def give_back() -> None:
    """Return freed memory to the machine: workers wait for later tasks, and
    what they hold meanwhile is missing to the others of their executor."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # where the C library has it
    if trim:
        trim(0)


def lean(run):
    """A mapInArrow function that gives back its memory when a task ends."""
    @functools.wraps(run)
    def wrapped(batches):
        try:
            yield from run(batches)
        finally:
            give_back()
    return wrapped


def kept_columns(docs: DataFrame, keep: list[str]) -> Column:
    """A struct of columns that an operator hands through unread, so that
    their names cannot clash with its own and no join brings them back."""
    return F.struct(*[docs[c] for c in keep])


def rows_with_text(docs: DataFrame, keep: list[str], text_col: str) -> DataFrame:
    """(row, text): the columns ``keep`` as a struct, and the text unless it is
    among them, so that no text travels twice."""
    row = kept_columns(docs, keep).alias("row")
    if text_col in keep and docs.schema[text_col].dataType.typeName() == "string":
        return docs.select(row)
    return docs.select(row, F.col(text_col).cast("string").alias("text"))


def texts_of(batch: pa.RecordBatch, text_col: str) -> pa.Array:
    """The texts of a batch of :func:`rows_with_text`."""
    if "text" in batch.schema.names:
        return batch.column("text")
    return batch.column("row").field(text_col)


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (n + 1) of a string column; null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    if not (pa.types.is_large_string(col.type) or pa.types.is_string(col.type)):
        col = pc.cast(col, pa.string())
    if col.null_count:
        col = pc.fill_null(col, "")
    kind = np.int64 if pa.types.is_large_string(col.type) else np.int32
    _, offs, data = col.buffers()
    if len(col) == 0 or data is None:
        return np.zeros(0, np.uint8), np.zeros(len(col) + 1, np.int64)
    offsets = np.frombuffer(offs, kind, len(col) + 1, col.offset * np.dtype(kind).itemsize).astype(np.int64)
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]]
    return buf, offsets - offsets[0]


def slices(batch: pa.RecordBatch, column: str, limit: int = SLICE_BYTES,
           rows: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Slices of at most ``rows`` rows whose texts together hold at most
    ``limit`` bytes (one row at least)."""
    _, offsets = text_bytes(texts_of(batch, column))
    start = 0
    while start < batch.num_rows:
        end = int(np.searchsorted(offsets, offsets[start] + limit, side="right")) - 1
        end = min(max(end, start + 1), start + rows, batch.num_rows)
        yield batch.slice(start, end - start)
        start = end


@dataclass
class Words:
    """Words of some texts: ``codes[i]`` is the place of word i in
    ``dictionary``, ``starts`` and ``ends`` its bytes; text d owns the words
    ``first[d]:first[d + 1]``."""

    codes: np.ndarray
    dictionary: pa.LargeBinaryArray
    first: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray

    @property
    def ends(self) -> np.ndarray:
        return self.starts + self.sizes

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def owner(self) -> np.ndarray:
        """The text that each word is in."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def cut_words(buf: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool) -> Words:
    if lower:
        buf = LOWER[buf]
    inside = table[buf]
    breaks = np.zeros(len(buf), bool)
    breaks[1:] = inside[1:] & ~inside[:-1]
    breaks[:1] = inside[:1]
    heads = offsets[:-1][np.diff(offsets) > 0]
    breaks[heads] = inside[heads]
    return cut_runs(buf, offsets, inside, breaks)


def cut_runs(buf: np.ndarray, offsets: np.ndarray, inside: np.ndarray, breaks: np.ndarray) -> Words:
    """Words made of the bytes ``inside``, one beginning at each of ``breaks``."""
    starts = np.flatnonzero(breaks)
    size = np.cumsum(inside, dtype=np.int64)
    place = np.empty(len(starts) + 1, np.int64)
    place[:-1] = size[starts] - 1
    place[-1] = size[-1] if len(size) else 0
    words = pa.LargeBinaryArray.from_buffers(
        pa.large_binary(), len(starts), [None, pa.py_buffer(place), pa.py_buffer(buf[inside])])
    coded = words.dictionary_encode()
    codes = coded.indices.to_numpy(zero_copy_only=False)
    return Words(codes, coded.dictionary, np.searchsorted(starts, offsets), starts, np.diff(place))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit numbers (multiply and shift)."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(dictionary: pa.Array) -> np.ndarray:
    """A 64-bit hash of each dictionary word, the same on every machine: the
    sum of one scrambled number per (place in the word, byte)."""
    n = len(dictionary)
    if n == 0:
        return np.zeros(0, np.uint64)
    _, offs, data = dictionary.buffers()
    offsets = np.frombuffer(offs, np.int64, n + 1, dictionary.offset * 8)
    lens = np.diff(offsets)
    buf = np.frombuffer(data, np.uint8)[offsets[0]:offsets[-1]].astype(np.uint64)
    place = np.arange(len(buf)) - np.repeat(offsets[:-1] - offsets[0], lens)
    each = mix((place.astype(np.uint64) << np.uint64(8)) + buf + np.uint64(1))
    out = np.zeros(n, np.uint64)
    full = np.flatnonzero(lens)
    out[full] = np.add.reduceat(each, (offsets[:-1] - offsets[0])[full])
    return mix(out + lens.astype(np.uint64))


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """Hash of each run of ``width`` consecutive values (len(h) - width + 1 of
    them), from hashes of runs of doubling length."""
    if len(h) < width:
        return np.zeros(0, np.uint64)
    have, done, out = h, 1, None  # have: hashes of runs of `done`
    while done * 2 <= width:
        have = mix(have[:-done] * np.uint64(0x9E3779B97F4A7C15) + have[done:])
        done *= 2
    if done == width:
        return have
    out = have[: len(h) - width + 1] * np.uint64(0x9E3779B97F4A7C15) + have[width - done:]
    return mix(out + np.uint64(width))
