"""Links of near copies against all pairs: chains, families in blocks, and the edge of the threshold."""

from __future__ import annotations

import random

import pytest

from ticklens.llm import neardup


def shingles(text):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def components(rows):
    """The smallest id that each row reaches over pairs of at least 75 in 100."""
    sets = [(i, shingles(text)) for i, text in rows]
    least = {i: i for i, _ in rows}
    links = [
        (i, j)
        for k, (i, a) in enumerate(sets)
        for j, b in sets[:k]
        if a and b and 100 * len(a & b) >= 75 * len(a | b)
    ]
    moved = True
    while moved:
        moved = False
        for i, j in links:
            low = min(least[i], least[j])
            moved = moved or least[i] != low or least[j] != low
            least[i] = least[j] = low
    return least


def found(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r["kept"] == (r["component_id"] == r["doc_id"])
    return {r["doc_id"]: r["component_id"] for r in got}


def chains(seed, families=6, length=30, n=60):
    """Each text changes a few words of the one before, so the ends of a chain have little in common."""
    drawn = random.Random(seed)
    texts = []
    for f in range(families):
        words = [f"f{f}w{drawn.randrange(200)}" for _ in range(n)]
        for _ in range(length):
            words = list(words)
            for _ in range(drawn.randrange(3)):
                words[drawn.randrange(n)] = f"x{drawn.randrange(10_000)}"
            texts.append(" ".join(words))
    texts += ["", "   ", None, *texts[:1] * 5]
    drawn.shuffle(texts)
    return list(enumerate(texts))


@pytest.mark.parametrize("small,block_u,block_v,block_shingles,hot_share",
    [(8, 256, 1024, 2_000_000, 1_000), (1, 3, 5, 2_000_000, 1), (1, 256, 1024, 300, 100)],
)
def test_chains_equal_all_pairs(spark, monkeypatch, small, block_u, block_v, block_shingles, hot_share):
    monkeypatch.setattr(neardup, "SMALL_GROUP", small)
    monkeypatch.setattr(neardup, "BLOCK_U", block_u)
    monkeypatch.setattr(neardup, "BLOCK_V", block_v)
    monkeypatch.setattr(neardup, "BLOCK_SHINGLES", block_shingles)
    monkeypatch.setattr(neardup, "HOT_SHARE", hot_share)
    rows = chains(4)
    assert found(spark, rows) == components(rows)


def test_the_edge_of_the_threshold(spark):
    """75 of 100 shingles in common link, 74 do not."""
    whole = [[f"p{k}w{i}" for i in range(104)] for k in range(40)]
    rows = [(k, " ".join(words)) for k, words in enumerate(whole)]
    rows += [(100 + k, " ".join(words[: 79 - k % 2])) for k, words in enumerate(whole)]
    got = found(spark, rows)
    assert got == components(rows)
    assert [got[100 + k] == k for k in range(40)] == [k % 2 == 0 for k in range(40)]
