"""Terms of whole Arrow columns: runs of bytes of a class, found with NumPy, as Arrow arrays of words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from quillspark.llm.text import LOWER


def spans(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that are inside, and the text each is in; no run goes on from one text to the next."""
    n = len(inside)
    first, last = offsets[:-1][offsets[:-1] < n], offsets[1:][offsets[1:] > 0] - 1
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = inside[:-1], inside[1:]
    before[first], after[last] = False, False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(offsets, starts, "right") - 1


def lowered(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs as a binary array, with A-Z in lower case."""
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int64)
    return pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(edges.tobytes()), pa.py_buffer(LOWER[data[inside]].tobytes())])
