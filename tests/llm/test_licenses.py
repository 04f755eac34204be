"""Licence notices in lines, texts and windows of words, against a plain search of all windows."""

from __future__ import annotations

import random
import re
from collections import Counter

import pytest

from ticklens.llm import licenses

SCHEMA = "doc_id bigint, text string, unit string"
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated"
    " documentation files (the Software), to deal in the Software without restriction"
)
OWN = [
    ("short", "All rights reserved"),
    ("long", " ".join(f"clause{i} of the agreement" for i in range(40))),
    ("long", "clause1 of"),
    ("repeats", "no no no warranty no warranty of any kind"),
    ("one word", "warranty"),
    ("none", None),
    (None, "nobody asks for this notice"),
    ("short", "All rights reserved"),
]


def words_of(line):
    return re.findall("[a-z0-9]+", line.lower())


def pairs_of(words):
    return {(a, b) for a, b in zip(words, words[1:])}


def plain(text, templates):
    """All matches, by comparing every line, the text and every window with every template."""
    lines = [words_of(line) for line in (text or "").split("\n")]
    words = [(w, i + 1) for i, line in enumerate(lines) for w in line]
    out = Counter()
    for name, template in templates:
        size, m = len(words_of(template or "")), pairs_of(words_of(template or ""))
        if not m or name is None:
            continue

        def measured(part):
            b = pairs_of(part)
            return 2 * len(b & m) / (len(b) + len(m)), len(b), len(b & m)

        units = [("line", i + 1, i + 1, line) for i, line in enumerate(lines)]
        if len(lines) > 1:
            units.append(("text", 0, 0, [w for w, _ in words]))
        for unit, first, last, part in units:
            dice, n, c = measured(part)
            if dice >= 0.75:
                out[unit, first, last, name, n, c, dice] += 1
        size = min(size, len(words))
        run = []
        for at in range(len(words) - size + 2):
            part = words[at : at + size]
            dice, n, c = measured([w for w, _ in part]) if at + size <= len(words) else (0, 0, 0)
            if dice >= 0.75:
                run.append((dice, -at, ("window", part[0][1], part[-1][1], name, n, c, dice)))
            elif run:
                out[max(run)[2]] += 1
                run = []
    return out


def found_by(spark, rows, templates=None):
    docs = spark.createDataFrame([(i, t, "other") for i, t in rows], SCHEMA)
    if templates is not None:
        templates = spark.createDataFrame(templates, "license_id string, text string")
    got: dict = {i: Counter() for i, _ in rows}
    for r in licenses.license_matches(docs, templates=templates).collect():
        got[r[0]][tuple(r)[1:]] += 1
    return got


def wrapped(text, width, start=""):
    out, line = [], start
    for word in text.split():
        if len(line) + len(word) > width:
            out, line = [*out, line], start
        line += " " + word
    return "\n".join([*out, line])


def texts():
    drawn = random.Random(5)
    filler = [f"word{i}" for i in range(30)] + ["the", "of", "license", "warranty"]
    out = [
        None,
        "",
        "\n\n",
        "license",
        MIT,
        f"/*\n{wrapped(MIT, 40, ' *')}\n */\ncode here",
        wrapped(MIT, 12),
        f"{wrapped(MIT, 30)}\nsome words between\n{MIT.upper()}",
        "released under\nthe mit license",
        "Released under the MIT License by all of us, and others",
        "the MIT License",
        "Released under the MIT License. " * 5,
        "Copyright. All\nrights reserved. All rights reserved.",
        " ".join(f"clause{i} of the agreement" for i in range(6, 44)),
        wrapped(" ".join(f"clause{i} of the agreement and" for i in range(40)), 70),
        "no warranty no no no warranty of any kind no warranty",
    ]
    for _ in range(60):
        parts = []
        for _ in range(drawn.randrange(1, 6)):
            notice = drawn.choice([*licenses.TEMPLATES.values(), *(t for _, t in OWN if t)]).split()
            for _ in range(drawn.randrange(4)):
                notice[drawn.randrange(len(notice))] = drawn.choice(filler)
            parts += [*notice, *drawn.choices(filler, k=drawn.randrange(8))]
        out.append("".join(w + drawn.choice([" ", " ", " ", "\n", ", "]) for w in parts))
    return list(enumerate(out))


@pytest.mark.parametrize("templates", [None, OWN])
def test_matches_equal_a_plain_search(spark, templates):
    rows = texts()
    got = found_by(spark, rows, templates)
    for i, text in rows:
        assert got[i] == plain(text, sorted(set(templates), key=repr) if templates else licenses.TEMPLATES.items()), text


def test_wrapped_notice_is_found_with_its_lines(spark):
    text = f"/* Copyright us\n{wrapped(MIT, 40, ' *')}\n */\ncode"
    found = [k for k in found_by(spark, [(1, text)])[1] if k[0] == "window"]
    assert [(k[1], k[3]) for k in found] == [(2, "MIT-notice")] and found[0][2] > 4 and found[0][-1] > 0.9


def test_rows_without_id_and_repeated_rows(spark):
    rows = [(None, "Released under the MIT License."), (1, "Released under the MIT License."), (1, "nothing")] * 2
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], SCHEMA)
    got = Counter((r["doc_id"], r["unit"]) for r in licenses.license_matches(docs).collect())
    assert got == {(i, unit): 2 for i in (None, 1) for unit in ("line", "window")}


def test_empty_tables_and_bounds(spark, monkeypatch):
    assert found_by(spark, [(1, MIT)], [])[1] == Counter()
    docs = spark.createDataFrame([], SCHEMA)
    assert licenses.license_matches(docs).count() == 0
    many = spark.createDataFrame([("a", MIT), ("b", MIT)], "license_id string, text string")
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 1)
    with pytest.raises(ValueError, match="templates"):
        licenses.license_matches(docs, templates=many)
    monkeypatch.setattr(licenses, "MAX_TEMPLATES", 2)
    monkeypatch.setattr(licenses, "MAX_TEMPLATE_WORDS", 30)
    with pytest.raises(ValueError, match="words"):
        licenses.license_matches(docs, templates=many)


def test_long_texts_are_searched_whole(spark):
    """Some 8 MB before the notice, and the notice many times over."""
    rows = [(1, "plain words here " * 500_000 + "\nReleased under\nthe MIT License"), (2, "Released under the MIT License. Other words stand here. " * 2_000)]
    got = found_by(spark, rows)
    assert [(k[0], k[1], k[2]) for k in got[1]] == [("window", 2, 3)]
    assert sum(got[2].values()) == 2_000
