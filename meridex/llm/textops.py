"""Vectorised text helpers that run inside Arrow batches on the executors.

All of them work on the UTF-8 bytes of a whole batch at once: one uint8 array and the offsets of its texts.
Hashes are 64 bits wide and the same on every executor and in every run. Words are hashed eight bytes at a time, each
step mixing the whole state, so words of up to eight bytes and one length never share a hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once inside a task; a longer text is worked on alone.
CHUNK_BYTES = 1 << 20

_BASE = np.uint64(0x9E3779B97F4A7C55)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_WORD = np.ones(256, bool)
_WORD[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = False
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on 64 bits: nearby values become unrelated ones."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(kind: str, n: int) -> np.ndarray:
    got = _powers.get(kind)
    if got is None or len(got) < n:
        base = _BASE if kind == "base" else _INVERSE
        full = np.full(max(n, CHUNK_BYTES + 1), base, np.uint64)
        full[0] = 1
        got = _powers[kind] = np.multiply.accumulate(full)
    return got[:n]


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column (null: empty) and the int64 offsets of its texts, starting at 0."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, ends, raw = column.buffers()
    offsets = np.frombuffer(ends, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(raw, np.uint8)[offsets[0] : offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def chunks(batch: pa.RecordBatch, column: str = "text", limit: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with at most `limit` bytes of text each, or a single row."""
    _, offsets = text_buffers(batch.column(column))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def prefix_sums(data: np.ndarray) -> np.ndarray:
    """Sums of the bytes weighted by powers of the base; window hashes are differences of these."""
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * _power("base", len(data)), out=out[1:])
    return out


def window_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hash of the bytes from each start up to its end, the same wherever they stand."""
    return mix((sums[end] - sums[start]) * _power("inverse", len(sums))[start])


#: Words of more bytes than this are hashed one by one.
LONG_WORD = 512


def word_hash(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """The 64-bit hashes of the words from each start up to its end."""
    size = end - start
    lanes = np.ndarray((len(data) + 1,), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
    out = mix(size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    at, left, step = np.flatnonzero(size <= LONG_WORD), size[size <= LONG_WORD], 0
    while len(at):
        lane = lanes[start[at] + step]
        short = left < 8
        lane[short] &= (np.uint64(1) << (8 * left[short]).astype(np.uint64)) - np.uint64(1)
        out[at] = mix(out[at] ^ lane)
        more = left > 8
        at, left, step = at[more], left[more] - 8, step + 8
    for i in np.flatnonzero(size > LONG_WORD).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[start[i] : end[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+`, with A-Z lower-cased unless `lower` is false.

    Returns the starts, ends and 64-bit hashes of all words, and for each text the number of words before it
    (one entry more than texts).
    """
    if len(data) == 0:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
    low = _LOWER[data] if lower else data
    inside = _WORD[data]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    cut = offsets[1:][np.diff(offsets) > 0] - 1
    last[cut] = inside[cut]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    return start, end, word_hash(low, start, end), np.searchsorted(start, offsets)


def word_strings(data: np.ndarray, offsets: np.ndarray, digits: bool = True) -> tuple[pa.LargeStringArray, np.ndarray]:
    """Runs of letters, digits (unless `digits` is false) and bytes from 0x80, with A-Z lower-cased, as strings.

    Returns all of them in order, and for each text the number of words before it (one entry more than texts).
    """
    low = _LOWER[data]
    inside = ((low >= 0x61) & (low <= 0x7A)) | (low >= 0x80)
    if digits:
        inside |= (low >= 0x30) & (low <= 0x39)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cut = offsets[:-1][np.diff(offsets) > 0]
    first[cut] = inside[cut]
    starts = np.flatnonzero(first)
    letters = np.zeros(len(data) + 1, np.int64)
    np.cumsum(inside, out=letters[1:])
    ends = np.append(letters[starts], letters[-1])
    found = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(ends), pa.py_buffer(low[inside]))
    return found, np.searchsorted(starts, offsets)


def shingles(hashes: np.ndarray, before: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of n words of each text, in order, and for each text the number of shingles before it.

    A text of fewer words has its whole sequence as its one shingle; a text without words has none.
    """
    count = np.diff(before)
    number = np.where(count >= n, count - n + 1, (count > 0).astype(np.int64))
    starts = np.zeros(len(before), np.int64)
    np.cumsum(number, out=starts[1:])
    total = int(starts[-1])
    if total == 0:
        return np.zeros(0, np.uint64), starts
    text = np.repeat(np.arange(len(count)), number)
    at = before[:-1][text] + (np.arange(total) - starts[:-1][text])
    padded = np.concatenate([hashes, np.zeros(n, np.uint64)])
    length = np.minimum(count[text], n)
    value = length.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
    for k in range(n):
        weight = np.uint64(pow(0xC2B2AE3D27D4EB4F, k + 1, 1 << 64))
        value = value + np.where(k < length, padded[at + k], np.uint64(0)) * weight
    return mix(value), starts


def distinct_per_text(values: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorts the values of each text and drops repeats; returns them and their new starts."""
    values = values.copy()
    for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
        values[s:e].sort()
    keep = np.ones(len(values), bool)
    keep[1:] = values[1:] != values[:-1]
    keep[starts[:-1][np.diff(starts) > 0]] = True
    kept = np.zeros(len(values) + 1, np.int64)
    np.cumsum(keep, out=kept[1:])
    return values[keep], kept[starts]
