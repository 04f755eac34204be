"""Periodic runs against a plain search over all periods."""

from __future__ import annotations

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ticklens.llm import ntt
from ticklens.llm.periodic import find_runs, periodic_runs, run_report
from ticklens.llm.queries import all_queries


def plain_runs(words):
    """(start, length, period) of all runs; a stretch belongs to its smallest period."""
    number: dict = {}
    ids = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    stretches: dict = {}
    for q in range(1, len(ids) // 4 + 1):
        same = np.concatenate([[0], (ids[q:] == ids[:-q]).astype(int), [0]])
        change = np.diff(same)
        for a, b in zip(np.flatnonzero(change == 1), np.flatnonzero(change == -1)):
            length = int(b - a) + q
            if length >= max(6, 4 * q):
                stretches.setdefault((int(a), length), q)
    return sorted(((a, n, q) for (a, n), q in stretches.items()), key=lambda r: (r[0], r[2]))


def plain_row(doc_id, text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", (text or "").encode())
    n = len(words)
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    best = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
    dropped = {i for s, length, q in runs for i in range(s + q, s + length)}
    listed = "".join(f"{s},{length},{q}\n" for s, length, q in runs)
    kept = b" ".join(w for i, w in enumerate(words) if i not in dropped)
    return (
        doc_id,
        len(runs),
        *best,
        1000 * best[1] // best[2] if runs else None,
        hashlib.sha256(listed.encode()).hexdigest(),
        hashlib.sha256(kept).hexdigest(),
    )


def found(df):
    names = "doc_id n_runs start length period exponent_milli runs_sha256 collapsed_sha256".split()
    return sorted(map(tuple, df.select(*names).collect()), key=repr)


@pytest.mark.parametrize("size", [1, 2, 8, 256])
@pytest.mark.parametrize("top", [2, 100, 100_000])
def test_sums_of_squared_differences(size, top):
    drawn = np.random.default_rng(size + top)
    blocks, windows = drawn.integers(0, top, (4, size)), drawn.integers(0, top, (4, 2 * size))
    windows[0, size // 2 : size // 2 + size] = blocks[0]
    want = np.array(
        [[((b - w[d : d + size]) ** 2).sum() for d in range(size)] for b, w in zip(blocks, windows)]
    )
    got = ntt.squared_differences(blocks, windows)
    assert ((got == 0) == (want == 0)).all()
    if size * top * top < ntt.PRIME:  # one digit
        assert (got == want).all()


def test_transform_inverts():
    rows = np.random.default_rng(0).integers(0, ntt.PRIME, (3, 64)).astype(np.uint64)
    back = ntt.transform(ntt.transform(rows), inverse=True)
    assert (back * np.uint64(pow(64, -1, ntt.PRIME)) % np.uint64(ntt.PRIME) == rows).all()


def test_random_texts():
    drawn = random.Random(5)
    total = 0
    for _ in range(600):
        texts = []
        for _ in range(drawn.randint(1, 6)):
            words = drawn.choices(range(drawn.choice([1, 2, 3, 30])), k=drawn.choice([0, 1, 5, 6, 7, 20, 120]))
            for _ in range(drawn.randint(0, 4) if len(words) > 8 else 0):
                at, p = drawn.randrange(len(words)), drawn.randint(1, len(words) // 5)
                for i in range(at + p, min(len(words), at + p * drawn.randint(2, 9) + drawn.randint(0, p))):
                    words[i] = words[i - p]
            texts.append(words)
        flat = np.array([w for words in texts for w in words], np.int64)
        got = find_runs(flat, np.array([len(words) for words in texts]))
        want = [plain_runs(words) for words in texts]
        assert [[tuple(r) for r in runs] for runs in got] == want
        total += sum(map(len, want))
    assert total > 500


def test_long_texts():
    n = 200_000
    same, sevens = np.zeros(n, np.int64), np.arange(n) % 7
    wide = np.arange(n) % 40_003
    assert [r[0] for r in find_runs(np.concatenate([same, sevens, wide]), np.array([n, n, n]))] == [
        (0, n, 1),
        (0, n, 7),
        (0, n, 40_003),
    ]


def test_fewer_than_four_periods_are_refused():
    with pytest.raises(ValueError):
        find_runs(np.zeros(3, np.int64), np.array([3]), exponent=3)


ODD = [
    (0, ""),
    (1, None),
    (2, " \t\n "),
    (3, "x " * 5),
    (4, "x " * 6),
    (5, "a b " * 4 + "a"),
    (5, "a b " * 4 + "a"),
    (None, "a b c " * 9),
    (None, None),
    (6, "A a " * 4),
    (7, "a a a a a a b b b b b b"),
    (8, "é ü é ü é ü é ü é ü é ü"),
    (9, "w" * 400 + " " + "v " * 20_000),
    *((i, " ".join(map(str, range(i % 50)))) for i in range(100, 200)),
]


def test_report_of_odd_rows(spark):
    rows = [(i, t, 7, [1]) for i, t in ODD]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, length bigint, runs array<int>")
    assert found(run_report(docs)) == sorted((plain_row(*r) for r in ODD), key=repr)
    assert run_report(docs.limit(0)).collect() == []
    first = periodic_runs(docs).where("doc_id = 5").first()
    assert (first.text, [tuple(r) for r in first.runs]) == ("a b", [(0, 9, 2)])


def test_query_equals_plain_search(spark):
    sf_dir = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    got = found(all_queries()["op11_periodic_runs"](spark, sf_dir))
    assert got == sorted((plain_row(*r) for r in docs), key=repr)
    assert sum(r[1] for r in got) > 0
