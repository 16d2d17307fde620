"""Words and word sequences of whole Arrow batches, hashed with NumPy inside Spark's tasks.

Words are runs of bytes other than the space and \\x09-\\x0D, so they never cross a code point. Hashes are
polynomials modulo 2^64 (Rabin-Karp): with running sums of powers, the hash of any span is one subtraction
and one multiplication, for all spans of a batch at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is a piece of its own.
PIECE_BYTES = 1 << 19
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE_VALUES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
#: Odd bases, so that they have inverses modulo 2^64.
BYTE_BASE, SEQUENCE_BASE, SECOND_BASE = 0x9E3779B97F4A7C15, 0xD1342543DE82EF95, 0xF1357AEA2E62A9C5
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def pieces(batch: pa.RecordBatch, column: str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose texts have about so many bytes together."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    group = np.cumsum(sizes) // most
    edges = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), batch.num_rows]
    for a, b in zip(edges, edges[1:]):
        yield batch.slice(a, b - a)


def content(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in a row, and where each begins and the last ends; null is empty."""
    column = pc.fill_null(column.cast(pa.large_binary()), b"")
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    buffer = column.buffers()[2]
    data = np.frombuffer(buffer, np.uint8) if buffer is not None and buffer.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the text each is in."""
    if not len(data):
        none = np.zeros(0, np.int64)
        return none, none, none
    space = SPACE[data]
    before = np.empty(len(data), bool)
    before[0], before[1:] = True, space[:-1]
    before[offsets[:-1][offsets[:-1] < len(data)]] = True
    after = np.empty(len(data), bool)
    after[-1], after[:-1] = True, space[1:]
    after[offsets[1:][offsets[1:] > 0] - 1] = True
    starts = np.flatnonzero(~space & before)
    ends = np.flatnonzero(~space & after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def powers(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """base^i and base^-i modulo 2^64, for i below n at least; those for a piece of usual size are kept."""
    if base in _powers and len(_powers[base][0]) >= n:
        return _powers[base]
    size = max(n, 1 << 16)
    made = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)])) for b in (base, pow(base, -1, 1 << 64)))
    if size <= PIECE_BYTES + (PIECE_BYTES >> 2):
        _powers[base] = made
    return made


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit over all."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, base: int) -> np.ndarray:
    """Polynomial hashes of values[start:end], mixed."""
    up, down = powers(base, len(values) + 1)
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[: len(values)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return span_hashes(_BYTE_VALUES[data], starts, ends, BYTE_BASE)


def window_starts(of: np.ndarray, k: int) -> np.ndarray:
    """The words at which k words of one text begin; of: each word's text."""
    if len(of) < k:
        return np.zeros(0, np.int64)
    return np.flatnonzero(of[: len(of) - k + 1] == of[k - 1 :])


def window_hashes(words: np.ndarray, at: np.ndarray, k: int, base: int = SEQUENCE_BASE) -> np.ndarray:
    return span_hashes(words, at, at + k, base)


def binaries(values: np.ndarray, edges: np.ndarray) -> pa.Array:
    """An Arrow binary array whose i-th value holds values[edges[i]:edges[i+1]]."""
    values = np.ascontiguousarray(values)
    offsets = (np.asarray(edges, np.int64) * values.itemsize).astype(np.int64)
    array = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(values.tobytes())])
    return array.cast(pa.binary())
