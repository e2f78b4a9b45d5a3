"""Words and window hashes of whole Arrow text columns, vectorised over the UTF-8 bytes.

A word is a run of bytes other than space and \\t\\n\\v\\f\\r. Hashes are 64-bit: two different word sequences agree by
chance with probability 2^-64, which the operators that use them accept (about 1e-4 collisions among 10^7 sequences
squared; the callers state where they verify).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text handled at once; a longer text is handled alone, whole.
CHUNK = 1 << 20
#: Words whose windows are hashed at once: bounds the table of powers.
RUN = 1 << 16
U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_BYTE = np.random.default_rng(20240607).integers(0, 2**64, 256, dtype=np.uint64)
_BASE, _STEP = 0x9E3779B97F4A7C15 | 1, 0xD1342543DE82EF95


def _powers(base: int, n: int) -> np.ndarray:
    a = np.full(n, base % 2**64, U)
    a[0] = 1
    return np.multiply.accumulate(a)


#: base^i for places in a word: i = 256 * high + low, so a word may have 2^24 bytes before its powers repeat.
_LOW, _HIGH = _powers(_BASE, 256), _powers(pow(_BASE, 256, 2**64), 1 << 16)
_UP, _DOWN = _powers(_STEP, 2 * RUN), _powers(pow(_STEP, -1, 2**64), 2 * RUN)


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


def text_slices(texts: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, bytes, offsets) of runs of rows of about CHUNK bytes; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    if not len(texts):
        return
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    off = np.frombuffer(texts.buffers()[1], kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(texts.buffers()[2], np.uint8) if texts.buffers()[2] is not None else np.zeros(0, np.uint8)
    i = 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(off, off[i] + CHUNK, "right")) - 1)
        yield i, data[off[i] : off[j]], off[i : j + 1] - off[i]
        i = j


def word_spans(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte starts and ends of all words, and each row's range in them."""
    n = len(data)
    is_word = np.zeros(n + 1, bool)
    is_word[:n] = ~SPACE[data]
    before = np.zeros(n + 1, bool)
    before[1:] = is_word[:-1]
    cut = off[:-1]
    before[cut] = False
    starts = np.flatnonzero(is_word & ~before)
    after = np.zeros(n + 1, bool)
    after[:n] = is_word[1:]
    last = off[1:] - 1
    after[last[last >= 0]] = False
    ends = np.flatnonzero(is_word & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each word: a polynomial of its bytes, mixed with its length."""
    if not len(starts):
        return np.zeros(0, U)
    sizes = ends - starts
    first = np.cumsum(sizes) - sizes
    place = np.arange(first[-1] + sizes[-1]) - np.repeat(first, sizes)
    value = _BYTE[data[place + np.repeat(starts, sizes)]] * _LOW[place & 255]
    if sizes.max() > 256:
        value *= _HIGH[(place >> 8) & 0xFFFF]
    return mix(np.add.reduceat(value, first) + sizes.astype(U))


def window_hashes(words: np.ndarray, ranges: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows inside rows, in order, and each row's range in them."""
    counts = np.maximum(np.diff(ranges) - (k - 1), 0)
    where = np.zeros(len(counts) + 1, np.int64)
    np.cumsum(counts, out=where[1:])
    at = np.repeat(ranges[:-1] - where[:-1], counts) + np.arange(where[-1])
    out = np.empty(len(at), U)
    cuts = np.searchsorted(at, np.arange(0, len(words) + RUN, RUN))
    for r, (s, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
        if e > s:
            some = words[r * RUN : r * RUN + RUN + k]
            total = np.zeros(len(some) + 1, U)
            np.cumsum(some * _UP[: len(some)], out=total[1:])
            here = at[s:e] - r * RUN
            out[s:e] = (total[here + k] - total[here]) * _DOWN[here]
    return mix(out + U(k)), where


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct k-word shingle hashes of each row; a row of fewer words has its whole sequence as one."""
    starts, ends, ranges = word_spans(data, off)
    words = word_hashes(data, starts, ends)
    h, where = window_hashes(words, ranges, k)
    row = np.repeat(np.arange(len(off) - 1), np.diff(where))
    n_words = np.diff(ranges)
    for short in range(1, k):
        rows = np.flatnonzero(n_words == short)
        if len(rows):
            at = ranges[rows]
            s = np.zeros(len(rows), U)
            for d in range(short):
                s = mix(s + words[at + d] + U(short))
            h, row = np.concatenate([h, s]), np.concatenate([row, rows])
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    if len(h):
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
        h, row = h[new], row[new]
    return h, np.searchsorted(row, np.arange(len(off)))
