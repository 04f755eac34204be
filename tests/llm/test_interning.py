"""The table of byte spans against dictionaries, xxhash and zlib."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
import xxhash

from ticklens.llm.common import ALNUM, NOT_SPACE
from ticklens.llm.interning import crc32, intern_spans, joined_words, xxhash64

LONG = ["z" * n for n in (255, 256, 257, 300, 300)]


def spans():
    drawn = random.Random(1)
    words = ["a", "é", "日本", "w" * 31, "w" * 32, "w" * 33, "x" * 70, *LONG]
    text = " ".join(drawn.choices(words, k=500))
    data, starts, ends, _ = joined_words(pa.array([text]), NOT_SPACE, lower=False)
    first = np.concatenate([np.arange(len(starts) - k) for k in range(3)])
    last = np.concatenate([np.arange(k, len(starts)) for k in range(3)])
    return data, starts[first], ends[last]


def pieces(data, starts, ends):
    whole = data.tobytes()
    return [whole[a:b] for a, b in zip(starts, ends)]


def test_hashes_equal_the_libraries():
    data, starts, ends = spans()
    want = pieces(data, starts, ends)
    assert xxhash64(data, starts, ends).tolist() == [xxhash.xxh64_intdigest(w) for w in want]
    assert crc32(data, starts, ends).tolist() == [zlib.crc32(w) for w in want]


@pytest.mark.parametrize("hashes", [None, 0, 7])
def test_equal_bytes_share_a_slot_whatever_the_hashes(hashes):
    data, starts, ends = spans()
    keys = None if hashes is None else np.arange(len(starts), dtype=np.uint64) * 0 + np.uint64(hashes)
    slots, owner = intern_spans(data, starts, ends, keys)
    of_slot: dict[int, bytes] = {}
    for slot, piece in zip(slots.tolist(), pieces(data, starts, ends)):
        assert of_slot.setdefault(slot, piece) == piece
    assert len(set(of_slot.values())) == len(of_slot) == (owner >= 0).sum()
    assert all(slots[owner[s]] == s for s in of_slot)


def test_no_spans():
    nothing = np.zeros(0, np.int64)
    slots, owner = intern_spans(np.zeros(0, np.uint8), nothing, nothing)
    assert len(slots) == 0 and (owner < 0).all()


def test_words_are_joined_by_one_space_and_stay_in_their_text():
    data, starts, ends, counts = joined_words(pa.array(["", None, " A-b\tÉx ", "Zz"]), ALNUM, True)
    assert data.tobytes().decode() == "a b Éx zz "
    assert counts.tolist() == [0, 0, 3, 1]
    assert [p.decode() for p in pieces(data, starts, ends)] == ["a", "b", "Éx", "zz"]
