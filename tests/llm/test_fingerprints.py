"""Fingerprints against sets of anchors found by plain code."""

from __future__ import annotations

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from ticklens.llm import fingerprints as fp


def words(seed, n):
    drawn = random.Random(seed)
    return " ".join("".join(drawn.choices("abcdeé 日", k=drawn.randint(2, 9))) for _ in range(n))


def hashed(spark, pieces):
    """xxhash64 of each tuple of texts, as Spark computes it."""
    pieces = sorted(set(pieces))
    rows = spark.createDataFrame([(i, list(p)) for i, p in enumerate(pieces)], "i int, p array<string>")
    width = len(pieces[0]) if pieces else 1
    found = rows.select("i", F.xxhash64(*(F.get("p", F.lit(j)) for j in range(width))).alias("h")).collect()
    return {pieces[r.i]: r.h for r in found}


def plain_anchors(spark, texts):
    """For each text the (place, run) of its closed syncmers."""
    inner = hashed(spark, [tuple(t[i : i + fp.S]) for t in texts for i in range(len(t) - fp.S + 1)])
    found = []
    for text in texts:
        own = []
        for i in range(len(text) - fp.K + 1):
            run = text[i : i + fp.K]
            s = [inner[tuple(run[j : j + fp.S])] for j in range(fp.K - fp.S + 1)]
            if min(s[0], s[-1]) <= min(s[1:-1]):
                own.append((i, run))
        found.append(own)
    return found


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


TEXTS = [
    *(words(i, n) for i, n in enumerate([1, 2, 3, 9, 11, 12, 13, 40, 300, 900])),
    *("", None, "x", "short text", "a" * 500, "ab" * 300, "😀é" * 40, "\n\t \x00"),
]


def rows_of(spark, rows):
    docs = spark.createDataFrame([(i, t, 1, "k") for i, t in rows], "doc_id bigint, text string, n int, key string")
    return fp.edited_report(docs).collect()


def plain_edits(rows):
    """(id, text, edited, next) of every row; ids descend, missing ones and then later rows come last."""
    listed = [(i is None, -(i or 0), k) for k, (i, _) in enumerate(rows)]
    order = sorted(range(len(rows)), key=lambda k: listed[k])
    out = []
    for at, k in enumerate(order):
        text, after = rows[k][1] or "", rows[order[(at + 1) % len(order)]][1] or ""
        half = len(text) // 2
        out.append((rows[k][0], text, text[: len(text) - half] + after[:half], after))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.mark.parametrize("block", [64, 1 << 16])
def test_anchors_and_their_places(spark, monkeypatch, block):
    """Blocks neither lose anchors nor make them up."""
    monkeypatch.setattr(fp, "BLOCK", block)
    texts = [t or "" for t in TEXTS]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    got = {r.i: r.a for r in rows.select("i", fp.anchors(F.col("text")).alias("a")).collect()}
    for i, want in enumerate(plain_anchors(spark, texts)):
        assert [a.place for a in got[i]] == [place for place, _ in want]
        by_run = {}
        for a, (_, run) in zip(got[i], want):
            assert by_run.setdefault(run, a.hash) == a.hash
        assert len(set(by_run.values())) == len(by_run)


def test_report_equals_plain_code(spark):
    rows = list(enumerate(TEXTS))
    want = plain_edits(rows)
    parts = plain_anchors(spark, [t for _, *texts in want for t in texts])
    sets = [{run for _, run in found} for found in parts]
    got = {r.doc_id: r for r in rows_of(spark, rows)}
    assert len(got) == len(rows)
    for k, (doc_id, text, edited, after) in enumerate(want):
        row = got[doc_id]
        assert (row.n_chars, row.edited_sha256) == (len(text), sha(edited))
        # A text without an anchor is its own and only one.
        own, changed, following = (
            found or ({t} if t else set()) for found, t in zip(sets[3 * k : 3 * k + 3], (text, edited, after))
        )
        for value, other in ((row.near_edited, changed), (row.near_next, following)):
            exact = jaccard(own, other)
            small = len(own | other) <= fp.SKETCH
            assert abs(value - exact) <= (1e-9 if small else 4 * 0.5 / fp.SKETCH**0.5)
        assert (row.fingerprint == row.edited_fingerprint) == (text == edited)
        assert (row.fingerprint == "") == (text == "")


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    """What is put together from parts equals the fingerprint of the whole."""
    rows = list(enumerate(TEXTS))
    edits = {i: edited for i, _, edited, _ in plain_edits(rows)}
    docs = spark.createDataFrame(list(edits.items()), "doc_id bigint, text string")
    whole = {r.doc_id: r.fingerprint for r in fp.fingerprints(docs).collect()}
    assert {r.doc_id: r.edited_fingerprint for r in rows_of(spark, rows)} == whole
    plain = {r.doc_id: r.fingerprint for r in rows_of(spark, rows)}
    given = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert plain == {r.doc_id: r.fingerprint for r in fp.fingerprints(given).collect()}


def test_likeness_does_not_jump_with_the_number_of_words(spark):
    base = [f"word{i}" for i in range(14)]
    rows = [(n, " ".join(base[:n])) for n in range(8, 15)]
    found = {r.doc_id: r.near_next for r in rows_of(spark, rows)}
    assert all(found[n] > 0.75 for n in range(9, 15))


def test_every_row_is_kept(spark):
    rows = [(1, "one text of some length"), (1, "another text of it"), (None, "x y"), (None, None), (2, "")]
    got = rows_of(spark, rows)
    assert sorted((str(r.doc_id), r.n_chars) for r in got) == sorted((str(i), len(t or "")) for i, t in rows)
    assert rows_of(spark, []) == []
    one = rows_of(spark, [(5, "alone with itself")])[0]
    assert one.edited_sha256 == sha("alone wit" + "alone wi") and one.near_next == 1.0


def test_many_rows_of_one_id(spark):
    rows = [(None if i % 3 else i, f"text number {i} of many") for i in range(400)]
    assert len(rows_of(spark, rows)) == 400


def test_positional_matches(spark):
    left = words(77, 60)
    rows = [(1, 2, left, "zz" + left), (3, 4, left, words(78, 60)), (5, 6, None, left)]
    pairs = spark.createDataFrame(rows, "left_id int, right_id int, left_text string, right_text string")
    found = fp.positional_matches(pairs).collect()
    shifts = {r.shift: r.n_anchors for r in found if r.left_id == 1}
    once = {run for _, run in plain_anchors(spark, [left])[0]}
    assert shifts[2] >= 0.9 * len(once)
    assert not [r for r in found if r.left_id == 5]
