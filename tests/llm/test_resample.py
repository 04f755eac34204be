"""Importance resampling against plain dictionaries."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter

import pytest

from ticklens.llm.resample import bucket_counts, resample


def words(text):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [w.decode() for w in re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower)]


def buckets_of(text, ngrams, buckets):
    found = words(text)
    grams = [" ".join(found[i : i + k]) for k in range(1, ngrams + 1) for i in range(len(found) - k + 1)]
    return [zlib.crc32(g.encode()) % buckets for g in grams]


def plain(docs, target, percent, least, ngrams, buckets):
    s = Counter(b for _, t in docs for b in buckets_of(t, ngrams, buckets))
    t = Counter(b for x in target for b in buckets_of(x, ngrams, buckets))
    n_s, n_t = sum(s.values()), sum(t.values())
    gain = [
        math.floor(1000 * math.log((t[b] + 1) * (n_s + buckets) / ((s[b] + 1) * (n_t + buckets))))
        for b in range(buckets)
    ]
    rows = []
    for doc_id, text in docs:
        own = buckets_of(text, ngrams, buckets)
        weight = sum(gain[b] for b in own)
        key = "" if doc_id is None else doc_id
        h = int(hashlib.sha256(f"42:{key}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        rows.append([doc_id, len(words(text)), len(own), weight, score, None])
    rivals = sorted(
        (r for r in rows if r[1] >= least), key=lambda r: (-r[4], math.inf if r[0] is None else r[0])
    )
    for place, row in enumerate(rivals[: percent * len(rivals) // 100], 1):
        row[5] = place
    return rows


def texts():
    base = [" ".join(f"W{(i * j) % 17}" for j in range(i)) for i in range(60)]
    return [*base, "", None, "é ü日 " * 30, "-- !!", "q" * 300 + " r" * 30, "w1 w2 w3 " * 9000]


DOCS = list(enumerate(texts()))
TARGET = ["w1 w2 w3 w4", None, "", "W5 w10 é"]


def run(spark, docs, target, *settings):
    frame = spark.createDataFrame(
        [(i, t, 1, "x") for i, t in docs], "doc_id bigint, text string, weight int, bucket string"
    )
    found = resample(frame, spark.createDataFrame([(t, 5) for t in target], "text string, n int"), *settings)
    names = ["doc_id", "n_words", "n_features", "weight", "score", "rank"]
    return sorted((list(r) for r in found.select(*names).collect()), key=repr)


@pytest.mark.parametrize("settings", [(5, 20, 3, 10_000), (50, 1, 2, 7), (100, 0, 1, 1), (0, 20, 3, 100)])
def test_equals_plain_counts(spark, settings):
    assert run(spark, DOCS, TARGET, *settings) == sorted(plain(DOCS, TARGET, *settings), key=repr)


def test_repeated_rows_and_missing_ids_are_drawn_on_their_own(spark):
    docs = [*DOCS[20:50], *DOCS[30:50], *[(None, DOCS[40][1])] * 20, *[(7, DOCS[41][1])] * 20]
    settings = (40, 20, 3, 1000)
    got = run(spark, docs, TARGET, *settings)
    assert got == sorted(plain(docs, TARGET, *settings), key=repr)
    ranks = sorted(r[5] for r in got if r[5])
    assert ranks == list(range(1, 40 * len(docs) // 100 + 1))


def test_empty_tables(spark):
    assert run(spark, [], TARGET) == []
    assert run(spark, [], []) == []
    assert run(spark, DOCS, [], 5, 20, 3, 100) == sorted(plain(DOCS, [], 5, 20, 3, 100), key=repr)


def test_every_feature_is_counted(spark):
    frame = spark.createDataFrame([(t,) for _, t in DOCS], "text string")
    total = sum(r["n"] for r in bucket_counts(frame, 3, 50).collect())
    assert total == sum(len(buckets_of(t, 3, 50)) for _, t in DOCS)
