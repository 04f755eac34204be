"""An open-addressed NumPy table that gives equal byte spans of a batch one slot.

Keys are xxhash64 of the bytes, and a span takes the slot of another only after their bytes were
compared, so a collision of hashes never joins two different spans. All spans of a batch probe at
once: a round looks at one slot for every span that has none yet.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import xxhash

from ticklens.llm.common import text_bytes, word_bounds

#: Spans above this many bytes are hashed, compared and summed one at a time.
_LONG = 256
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)

# The primes of XXH64.
_P1, _P2, _P3, _P4, _P5 = (
    np.uint64(p)
    for p in (
        0x9E3779B185EBCA87,
        0xC2B2AE3D27D4EB4F,
        0x165667B19E3779F9,
        0x85EBCA77C2B2AE63,
        0x27D4EB2F165667C5,
    )
)


def _crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1)
    return table.astype(np.uint32)


_CRC = _crc_table()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


def joined_words(
    texts: pa.Array, is_word: np.ndarray, lower: bool
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All words of all texts, each followed by one space.

    Returns the bytes, the start and end of each word in them, and the number of words of each text.
    So the words i to j of a text, joined by one space, are the bytes from start i to end j.
    """
    data, offsets = text_bytes(texts)
    if lower:
        data = _LOWER[data]
    starts, ends = word_bounds(data, offsets, is_word)
    counts = np.diff(np.searchsorted(starts, offsets))
    lengths = ends - starts
    new_ends = np.cumsum(lengths + 1) - 1
    new_starts = new_ends - lengths
    out = np.full(int(new_ends[-1]) + 1 if len(new_ends) else 0, 0x20, np.uint8)
    inside = np.ones(len(out), bool)
    inside[new_ends] = False
    out[inside] = data[is_word[data]]
    return out, new_starts, new_ends, counts


def _eight(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as one little-endian number."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))


def _rotl(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _round(acc: np.ndarray, lane: np.ndarray) -> np.ndarray:
    return _rotl(acc + lane * _P2, 31) * _P1


def xxhash64(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """XXH64 with seed 0 of each span."""
    eight, lengths = _eight(data), ends - starts
    out = np.full(len(starts), _P5, np.uint64)
    at = starts.copy()
    some = np.flatnonzero((lengths >= 32) & (lengths <= _LONG))
    if len(some):
        zero = np.zeros(len(some), np.uint64)
        lanes = [zero + _P1 + _P2, zero + _P2, zero.copy(), zero - _P1]
        stripes = lengths[some] // 32
        for k in range(int(stripes.max())):
            more = np.flatnonzero(stripes > k)
            for i, lane in enumerate(lanes):
                lane[more] = _round(lane[more], eight[at[some[more]] + 32 * k + 8 * i])
        acc = _rotl(lanes[0], 1) + _rotl(lanes[1], 7) + _rotl(lanes[2], 12) + _rotl(lanes[3], 18)
        for lane in lanes:
            acc = (acc ^ _round(zero, lane)) * _P1 + _P4
        out[some] = acc
        at[some] += 32 * stripes
    out += lengths.astype(np.uint64)
    left = ends - at
    left[lengths > _LONG] = 0
    for k in range(3):
        some = np.flatnonzero(left >= 8)
        if not len(some):
            break
        lane = _round(np.uint64(0), eight[at[some]])
        out[some] = _rotl(out[some] ^ lane, 27) * _P1 + _P4
        at[some] += 8
        left[some] -= 8
    some = np.flatnonzero(left >= 4)
    lane = (eight[at[some]] & _KEEP[4]) * _P1
    out[some] = _rotl(out[some] ^ lane, 23) * _P2 + _P3
    at[some] += 4
    left[some] -= 4
    for k in range(3):
        some = np.flatnonzero(left > k)
        byte = eight[at[some] + k] & _KEEP[1]
        out[some] = _rotl(out[some] ^ (byte * _P5), 11) * _P1
    out ^= out >> np.uint64(33)
    out *= _P2
    out ^= out >> np.uint64(29)
    out *= _P3
    out ^= out >> np.uint64(32)
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes())
    return out


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of each span, all spans a byte at a time, longest first."""
    lengths = ends - starts
    order = np.argsort(-np.minimum(lengths, _LONG + 1), kind="stable")
    order = order[np.searchsorted(-lengths[order], -_LONG) :] if len(order) else order
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    acc, first, size = out[order], starts[order], lengths[order]
    alive = len(order)
    for k in range(int(size[0]) if len(size) else 0):
        alive = int(np.searchsorted(-size[:alive], -k))
        part = acc[:alive]
        byte = (part ^ data[first[:alive] + k]) & np.uint32(0xFF)
        acc[:alive] = (part >> np.uint32(8)) ^ _CRC[byte]
    out[order] = acc
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(lengths > _LONG):
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def _equal(
    data: np.ndarray, eight: np.ndarray, a: np.ndarray, b: np.ndarray, lengths: np.ndarray
) -> np.ndarray:
    """Whether the bytes from `a` and from `b` on agree over so many bytes."""
    same = np.ones(len(a), bool)
    longest = int(lengths.max()) if len(lengths) else 0
    for k in range(0, min(longest, _LONG), 8):
        some = np.flatnonzero(lengths > k) if k else slice(None)
        differ = eight[a[some] + k] ^ eight[b[some] + k]
        same[some] &= (differ & _KEEP[np.minimum(lengths[some] - k, 8)]) == 0
    for i in np.flatnonzero(lengths > _LONG):
        n = lengths[i]
        same[i] &= bool((data[a[i] : a[i] + n] == data[b[i] : b[i] + n]).all())
    return same


def intern_spans(
    data: np.ndarray, starts: np.ndarray, ends: np.ndarray, keys: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray]:
    """The slot of each span, and for each slot the number of a span in it (-1: none).

    Two spans have the same slot if and only if their bytes are equal. `keys` replaces the hashes in
    tests.
    """
    m = len(starts)
    size = 1 << max(int(2 * m - 1).bit_length(), 3)
    owner = np.full(size, -1, np.int64)
    keys = xxhash64(data, starts, ends) if keys is None else keys
    slots = (keys & np.uint64(size - 1)).astype(np.int64)
    eight, lengths = _eight(data), ends - starts
    pending = np.arange(m)
    while len(pending):
        at = slots[pending]
        free = owner[at] < 0
        owner[at[free]] = pending[free]
        held = owner[at]
        same = (keys[held] == keys[pending]) & (lengths[held] == lengths[pending])
        some = np.flatnonzero(same & (held != pending))
        mine = pending[some]
        same[some] = _equal(data, eight, starts[held[some]], starts[mine], lengths[mine])
        pending = pending[~same]
        slots[pending] = (at[~same] + 1) & (size - 1)
    return slots, owner
