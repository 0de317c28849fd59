"""Words and word n-grams of many texts at once, as 64-bit hashes, with numpy over a batch's bytes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

_FOLD = np.array([c + 32 if 65 <= c <= 90 else c for c in range(256)], np.uint8)
_BLANK = np.array([c == 0x20 or 0x09 <= c <= 0x0D for c in range(256)])
_MASK = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)
#: Longer words are hashed one by one.
_LONG = 64


def _mixed(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(32)
    return h


def text_slices(batch: pa.RecordBatch, column: int, most: int = 1 << 19) -> Iterator[pa.RecordBatch]:
    """The rows of a batch in slices of about ``most`` bytes of text, a row at least."""
    ends = np.frombuffer(batch.column(column).buffers()[1], np.int32)[batch.column(column).offset + 1 :][: batch.num_rows]
    first = 0
    while first < batch.num_rows:
        begin = ends[first - 1] if first else ends[0] - ends[0]
        last = max(first + 1, int(np.searchsorted(ends, begin + most, "right")))
        yield batch.slice(first, last - first)
        first = last


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of an array of strings, and where each text begins and the last ends; null is empty."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset :][: len(texts) + 1].astype(np.int64)
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8)[ends[0] : ends[-1]] if held else np.zeros(0, np.uint8)
    return data, ends - ends[0]


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of the texts, A-Z lower-cased, in order, and the number of words of each text."""
    data, ends = text_bytes(texts)
    n = len(data)
    inked = np.zeros(n + 1, bool)
    inked[:n] = ~_BLANK[data]
    edge = np.zeros(n + 1, bool)  # a text begins here
    edge[ends] = True
    starts = np.flatnonzero(inked & (edge | ~np.concatenate([[False], inked[:-1]])))
    stops = np.flatnonzero(inked[:n] & (edge[1:] | ~inked[1:])) + 1
    size = stops - starts
    padded = np.zeros(n + 8, np.uint8)
    padded[:n] = _FOLD[data]
    eight = np.ndarray(n + 1, "<u8", padded, strides=(1,))  # the eight bytes from each place
    h = eight[starts] & _MASK[np.minimum(size, 8)]
    h = _mixed(h ^ (size.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)))
    for k in range(8, _LONG, 8):
        more = np.flatnonzero(size > k)
        if not len(more):
            break
        v = eight[starts[more] + k] & _MASK[np.minimum(size[more] - k, 8)]
        h[more] = _mixed((h[more] + v) * np.uint64(0xC2B2AE3D27D4EB4F))
    for w in np.flatnonzero(size > _LONG):
        h[w] = xxhash.xxh3_64_intdigest(padded[starts[w] : stops[w]].tobytes())
    return h, np.diff(np.searchsorted(starts, ends))


def shingle_sets(texts: pa.Array, size: int) -> list[np.ndarray]:
    """For each text its sorted distinct hashes of ``size`` words in a row; of all its words if it has fewer."""
    words, counts = word_hashes(texts)
    out = []
    runs = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        runs = _mixed((runs + words[k : k + len(runs)]) * np.uint64(0xA0761D6478BD642F))
    first = np.concatenate([[0], np.cumsum(counts)])
    for a, n in zip(first.tolist(), counts.tolist()):
        if n >= size:
            h = np.sort(runs[a : a + n - size + 1])
            out.append(h[np.concatenate([[True], h[1:] != h[:-1]])])
        elif n:
            h = np.full(1, n, np.uint64)
            for k in range(n):
                h = _mixed((h + words[a + k : a + k + 1]) * np.uint64(0xA0761D6478BD642F))
            out.append(h)
        else:
            out.append(np.zeros(0, np.uint64))
    return out
