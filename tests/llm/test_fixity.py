"""The audit against a plain comparison of the pages of two replicas."""

from __future__ import annotations

from collections import defaultdict

import pytest

from ticklens.llm import fixity

PAGES = [(i, f"u{i}", f"<p>{i}</p>" * (1 + i % 7)) for i in range(0, 5000, 3)]


def audited(spark, copy, replica):
    a, b = (
        spark.createDataFrame([(*r, 1) for r in rows], "page_id bigint, url string, html string, file int")
        for rows in (copy, replica)
    )
    return sorted(((r.page_id, r.status) for r in fixity.audit(a, b).collect()), key=repr)


def plain(copy, replica):
    """Pages that differ; rows without an id are told apart by their record."""

    def by_page(rows):
        found = defaultdict(list)
        for page, url, html in rows:
            record = (url or "", html or "")
            found[page if page is not None else record].append(record)
        return {k: sorted(v) for k, v in found.items()}

    a, b = by_page(copy), by_page(replica)
    wanted = [k for k in a.keys() | b.keys() if a.get(k) != b.get(k)]
    return sorted(
        (
            (None if isinstance(k, tuple) else k, "missing" if k not in b else "extra" if k not in a else "changed")
            for k in wanted
        ),
        key=repr,
    )


def changed(rows, at, *new):
    return [*rows[:at], *new, *rows[at + 1 :]]


LOOSE = [(None, "x", "1"), (None, "x", "1"), (None, "y", None), (None, None, None)]
CASES = {
    "equal": (PAGES, PAGES[::-1]),
    "altered": (PAGES, changed(PAGES, 700, (2100, "u2100", "longer than it was" * 9))),
    "moved": (PAGES, changed(PAGES, 1, (4, "u3", PAGES[1][2]))),
    "lost and added": (PAGES[5:], [*PAGES[:-9], (10**7, "far", "away")]),
    "exchanged": (PAGES, [(0, *PAGES[7][1:]), *PAGES[1:7], (21, *PAGES[0][1:]), *PAGES[8:]]),
    "repeated": ([*PAGES, PAGES[9]], [*PAGES, PAGES[9], PAGES[9]]),
    "repeated, in another order": ([(1, "a", "x"), (1, "b", "y")], [(1, "b", "y"), (1, "a", "x")]),
    "without ids": ([*PAGES[:50], *LOOSE], [*PAGES[:50], *LOOSE[1:3], (None, "z", "2")]),
    "below zero": ([(-1, "a", "x"), (-5000, "b", "y")], [(-1, "a", "x"), (-4999, "b", "y")]),
    "empty replica": (PAGES[:40], []),
    "both empty": ([], []),
    "NULL is empty": ([(1, None, ""), (2, "", None)], [(1, "", None), (2, None, "")]),
}


@pytest.mark.parametrize("name", CASES)
def test_audit(spark, name):
    copy, replica = CASES[name]
    assert audited(spark, copy, replica) == plain(copy, replica)


def test_many_rows_of_one_page_id(spark):
    many = [(7, f"u{i}", "h") for i in range(20_000)]
    assert audited(spark, many, many[1:] + many[:1]) == []
    assert audited(spark, many, many[1:]) == [(7, "changed")]


def test_offsets_of_a_file(spark):
    rows = spark.createDataFrame([(1, "a", "x"), (0, "a", "xyz"), (1000, "b", "")], "page_id bigint, url string, html string")
    found = {r.page_id: (r.file, r.low, r.high) for r in fixity.leaves(fixity.records(rows)).collect()}
    sizes = {r.page_id: r.size for r in fixity.records(rows).collect()}
    assert found == {
        0: (0, 0, sizes[0]),
        1: (0, sizes[0], sizes[0] + sizes[1]),
        1000: (1, 0, sizes[1000]),
    }
