"""Static range asymmetric numeral system over shared frequencies, for blocks of token ids.

All blocks share one table of frequencies that sum to ``2**scale_bits``.  A block is coded by
``lanes`` interleaved coders: symbol number i belongs to lane i mod lanes.  A lane's state is a
64-bit number in [2**31, 2**63) that gives up 32-bit words.  All lanes take a step together, so a
step is a few vector operations.  Encoding runs from the last symbol to the first, decoding the
other way.  A checkpoint holds the states of all lanes and the place in the word stream before a
step, so that a reader can start there without decoding what precedes it.

Layout of a block, little-endian: magic ``FLR1``; crc32 of all that follows it; then lanes,
symbols, words, scale_bits and checkpoints (4 bytes each); for each checkpoint its step and its
place in the words (4 bytes each) and its states (8 bytes a lane); the words, in reading order.
"""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

LOW = np.uint64(1 << 31)
MAGIC = b"FLR1"
_HEAD = struct.Struct("<4sIIIIII")


class Frequencies:
    """Counts of ids, scaled to a sum of 2**scale_bits; every id of the vocabulary keeps at least 1."""

    def __init__(self, counts: np.ndarray, scale_bits: int = 20):
        size = 1 << scale_bits
        counts = np.asarray(counts, np.float64)
        if not len(counts) or len(counts) > size // 2:
            raise ValueError("scale_bits is too small for the vocabulary")
        total = counts.sum()
        share = counts / total if total else np.full(len(counts), 1 / len(counts))
        freq = 1 + np.floor(share * (size - len(counts))).astype(np.int64)
        freq[int(np.argmax(freq))] += size - int(freq.sum())  # what rounding left
        self.scale_bits = scale_bits
        self.freq = freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
        self._symbol: np.ndarray | None = None

    @property
    def symbol(self) -> np.ndarray:
        """The id that owns each of the 2**scale_bits slots."""
        if self._symbol is None:
            self._symbol = np.repeat(np.arange(len(self.freq), dtype=np.uint32), self.freq.astype(np.int64))
        return self._symbol


def encode_block(ids: np.ndarray, table: Frequencies, lanes: int = 1024, every: int = 64) -> bytes:
    """A block of ids as bytes, with a checkpoint before each ``every``-th step."""
    ids = np.asarray(ids, np.int64)
    bits = np.uint64(table.scale_bits)
    steps = -(-len(ids) // lanes)
    state = np.full(lanes, LOW, np.uint64)
    most = (np.uint64(1 << 63) >> bits)
    words: list[np.ndarray] = []  # in the order written; a reader takes them backwards
    written, marks = 0, []
    for s in range(steps - 1, -1, -1):
        part = ids[s * lanes : (s + 1) * lanes]
        f, c = table.freq[part], table.start[part]
        x = state[: len(part)]
        full = x >= most * f
        if full.any():
            out = (x[full] & np.uint64(0xFFFFFFFF)).astype("<u4")[::-1]
            words.append(out)
            written += len(out)
            x[full] >>= np.uint64(32)
        q = x // f
        state[: len(part)] = (q << bits) + (x - q * f) + c
        if s % every == 0:
            marks.append((s, written, state.copy()))
    stream = np.concatenate(words)[::-1] if words else np.zeros(0, "<u4")
    body = [struct.pack("<IIIII", lanes, len(ids), len(stream), table.scale_bits, len(marks))]
    for s, done, x in reversed(marks):
        body += [struct.pack("<II", s, len(stream) - done), x.astype("<u8").tobytes()]
    body.append(stream.astype("<u4").tobytes())
    data = b"".join(body)
    return MAGIC + struct.pack("<I", zlib.crc32(data)) + data


def decode_block(data: bytes, table: Frequencies, first: int = 0, last: int | None = None) -> np.ndarray:
    """The ids of a block, or those of its checkpoints ``first`` up to, but not with, ``last``.

    A block that is not whole raises ValueError.
    """
    if len(data) < _HEAD.size:
        raise ValueError("the block is cut short")
    magic, crc, lanes, size, n_words, scale_bits, n_marks = _HEAD.unpack_from(data)
    if magic != MAGIC or crc != zlib.crc32(data[8:]):
        raise ValueError("the block is damaged")
    if scale_bits != table.scale_bits:
        raise ValueError("the block was written with another table")
    one = 8 + 8 * lanes
    last = n_marks if last is None else min(last, n_marks)
    if first >= last:
        return np.zeros(0, np.uint32)
    stream = np.frombuffer(data, "<u4", n_words, _HEAD.size + one * n_marks)
    step, at = struct.unpack_from("<II", data, _HEAD.size + one * first)
    state = np.frombuffer(data, "<u8", lanes, _HEAD.size + one * first + 8).copy()
    steps = -(-size // lanes)
    stop = struct.unpack_from("<I", data, _HEAD.size + one * last)[0] if last < n_marks else steps
    bits, mask = np.uint64(scale_bits), np.uint64((1 << scale_bits) - 1)
    out = np.empty(min(size, stop * lanes) - step * lanes, np.uint32)
    begin = step * lanes
    for s in range(step, stop):
        n = min(lanes, size - s * lanes)
        x = state[:n]
        slot = x & mask
        symbol = table.symbol[slot]
        out[s * lanes - begin : s * lanes - begin + n] = symbol
        x = table.freq[symbol] * (x >> bits) + slot - table.start[symbol]
        short = x < LOW
        k = int(short.sum())
        if k:
            x[short] = (x[short] << np.uint64(32)) | stream[at : at + k]
            at += k
        state[:n] = x
    return out


def checkpoint_places(data: bytes) -> list[int]:
    """The numbers of ids before each checkpoint of a block, and of all its ids."""
    _, _, lanes, size, _, _, n_marks = _HEAD.unpack_from(data)
    steps = [struct.unpack_from("<I", data, _HEAD.size + (8 + 8 * lanes) * k)[0] for k in range(n_marks)]
    return [s * lanes for s in steps] + [size] if steps else [0, size]


def _times(matrix: list[int], vector: int) -> int:
    total, i = 0, 0
    while vector:
        if vector & 1:
            total ^= matrix[i]
        vector >>= 1
        i += 1
    return total


@lru_cache(maxsize=64)
def _zeros(k: int) -> list[int]:
    """What appending 2**k zero bits does to a crc32."""
    if not k:
        return [0xEDB88320] + [1 << i for i in range(31)]
    half = _zeros(k - 1)
    return [_times(half, x) for x in half]


def crc32_combine(a: int, b: int, size_b: int) -> int:
    """The crc32 of two pieces from the crc32 of each and the second one's bytes."""
    k = 3
    while size_b:
        if size_b & 1:
            a = _times(_zeros(k), a)
        size_b, k = size_b >> 1, k + 1
    return a ^ b
