"""Operator 3: licence notices in texts, by the Dice coefficient over word bigrams.

Texts and templates are normalised (lower case, runs of anything but ASCII letters and digits become
one blank). Compared with the templates are the lines of a text, the text as a whole, and windows of as many
words as a template has, wherever lines break in them; of neighbouring windows that match the best is given. With
m bigrams in a template and n in the unit, Dice >= t needs t/(2-t) m <= n <= (2-t)/t m, and t/(2-t) m
bigrams in common. So one of its anchors, which are one bigram more than a match may lack, is in every match: texts
without the longer word of any anchor are left out at once, only templates with an anchor in the text are looked at, and
windows are laid around anchors only. Templates are a table of bounded size (MAX_TEMPLATES, MAX_TEMPLATE_WORDS; more
raise an error), so no row is shuffled. Only built-in functions are used.

Defined results: a NULL or empty text has no rows; a line of one word has no bigram and
matches nothing; repeated bigrams count once; of several templates that a unit matches all are returned; rows
that repeat an id are all returned; a text is a unit of its own only if it has several lines, and has line 0; a text of
fewer words than the template has one window, all of it; of equal windows side by side the first is given; templates
without a bigram or without an id match nothing, and repeated rows of templates count once.
"""

from __future__ import annotations

import math
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import bound, empty_text

LEAST_DICE = 0.75
MAX_TEMPLATES = 500
MAX_TEMPLATE_WORDS = 100_000
_SLACK = 1e-9

# Short notices of public licences, used where no table of templates is given: fixed values.
TEMPLATES = {
    "Apache-2.0": "Licensed under the Apache License, Version 2.0",
    "Apache-2.0-notice": "Licensed under the Apache License, Version 2.0 (the License); you may not use"
    " this file except in compliance with the License",
    "BSD-3-Clause": "Use of this source code is governed by a BSD-style license",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3",
    "GPL-3.0-notice": "This program is free software: you can redistribute it and/or modify it under the"
    " terms of the GNU General Public License as published by the Free Software Foundation, either"
    " version 3 of the License, or any later version",
    "LGPL-3.0": "This library is licensed under the GNU Lesser General Public License, version 3",
    "MIT": "Released under the MIT License",
    "MIT-notice": "Permission is hereby granted, free of charge, to any person obtaining a copy of this"
    " software and associated documentation files, to deal in the Software without restriction",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}


def line_words(text: Column) -> Column:
    """The words of each line of a text, as an array of arrays."""
    plain = F.regexp_replace(F.lower(text), "[^a-z0-9\\n]+", " ")
    return F.transform(F.split(plain, "\n", -1), lambda line: F.array_remove(F.split(line, " "), ""))


def bigrams(words: Column) -> Column:
    """The neighbouring pairs of an array of words, in their order."""

    def pairs(w: Column) -> Column:
        pair = F.transform(
            F.sequence(F.lit(0), F.size(w) - 2), lambda i: F.concat(w[i], F.lit(" "), w[i + 1])
        )
        return F.when(F.size(w) >= 2, pair).otherwise(F.array().cast("array<string>"))

    return bound(words, pairs)


def template_words(text: str) -> list[str]:
    return "".join(c if c.isascii() and c.isalnum() else " " for c in text.lower()).split()


def template_bigrams(text: str) -> list[str]:
    words = template_words(text)
    return sorted({f"{a} {b}" for a, b in zip(words, words[1:])})


def anchors(bigrams_of: list[str], least: float) -> list[str]:
    """The longest bigrams, one more than a match may lack."""
    needed = math.ceil(least / (2 - least) * len(bigrams_of) - _SLACK)
    return sorted(bigrams_of, key=lambda b: (-len(b), b))[: len(bigrams_of) - needed + 1]


def read_templates(table: DataFrame) -> list[tuple[str, str]]:
    """(license_id, text) of a table of templates; raises an error if there are too many for every task."""
    rows = table.select("license_id", "text").where("license_id is not null").distinct()
    rows = rows.limit(MAX_TEMPLATES + 1).collect()
    if len(rows) > MAX_TEMPLATES:
        raise ValueError(f"more than {MAX_TEMPLATES} templates")
    return sorted((r["license_id"], r["text"] or "") for r in rows)


def _known(templates: Iterable[tuple[str, str]], least: float) -> list[tuple]:
    """(number, id, size in words, bigrams, anchors) of the templates that have bigrams."""
    known = []
    for name, text in templates:
        if b := template_bigrams(text):
            known.append((len(known), name, len(template_words(text)), b, anchors(b, least)))
    if sum(size for _, _, size, _, _ in known) > MAX_TEMPLATE_WORDS:
        raise ValueError(f"templates of more than {MAX_TEMPLATE_WORDS} words")
    return known


def _literal(values: Iterable, kind: str) -> Column:
    """A constant array; the values hold no bar."""
    joined = "|".join(map(str, values))
    return (F.split(F.lit(joined), "\\|") if joined else F.array()).cast(f"array<{kind}>")


def license_matches(
    docs: DataFrame, least: float = LEAST_DICE, templates: DataFrame | None = None
) -> DataFrame:
    """(doc_id, unit, line_no, last_line, license_id, n_bigrams, n_shared, dice) of every match.

    `unit` is line, text or window; `templates` has license_id and text.
    """
    known = _known(TEMPLATES.items() if templates is None else read_templates(templates), least)
    kind = "number int, id string, size int, b array<string>, anchors array<string>"
    table = docs.sparkSession.createDataFrame(known, kind)
    places = [(anchor, number) for number, *_, of in known for anchor in of]
    low, high = least / (2 - least), (2 - least) / least

    telling = _literal(sorted({max(a.split(), key=len) for a, _ in places}), "string")
    texts = docs.select("doc_id", line_words(empty_text()).alias("lines"))
    texts = texts.where(F.arrays_overlap(F.flatten("lines"), telling))
    line_of = F.flatten(F.transform("lines", lambda w, i: F.array_repeat(i + 1, F.size(w))))
    texts = texts.select(
        "doc_id", "lines", bigrams(F.flatten("lines")).alias("pairs"), line_of.alias("line_of")
    )
    anchor_of, number_of = _literal((a for a, _ in places), "string"), _literal((k for _, k in places), "int")
    held = bound(
        F.array_intersect("pairs", _literal(sorted({a for a, _ in places}), "string")),
        lambda hit: F.filter(
            F.sequence(F.lit(0), F.lit(max(len(places) - 1, 0))),
            lambda k: F.array_contains(hit, F.get(anchor_of, k)),
        ),
    )
    numbers = F.array_distinct(F.transform(held, lambda k: F.get(number_of, k)))
    found = texts.withColumn("number", F.explode(numbers)).join(F.broadcast(table), "number")
    n, m = F.size("pairs"), F.size("b")
    kind = "array<struct<unit:string,line_no:int,last_line:int,n:int,shared:int,dice:double,at:int>>"

    def compared(unit: str, pairs: Column, first: Column, last: Column, at: Column) -> Column:
        def measured(b: Column) -> Column:
            def with_shared(shared: Column) -> Column:
                return F.struct(
                    F.lit(unit).alias("unit"),
                    first.cast("int").alias("line_no"),
                    last.cast("int").alias("last_line"),
                    F.size(b).alias("n"),
                    shared.alias("shared"),
                    (2.0 * shared / (F.size(b) + m)).alias("dice"),
                    at.cast("int").alias("at"),
                )

            fits = F.size(b).between(m * low - _SLACK, m * high + _SLACK)
            shared = F.when(fits, F.size(F.array_intersect(b, F.col("b")))).otherwise(0)
            return bound(shared, with_shared)

        return bound(F.array_distinct(pairs), measured)

    def matching(units: Column) -> Column:
        return F.filter(units, lambda u: (u["dice"] >= least) & (u["shared"] > 0))

    by_line = matching(
        F.transform("lines", lambda w, i: compared("line", bigrams(w), i + 1, i + 1, F.lit(0)))
    )
    whole = matching(F.array(compared("text", F.col("pairs"), F.lit(0), F.lit(0), F.lit(0))))
    whole = F.when(F.size("lines") > 1, whole).otherwise(F.array().cast(kind))

    # Windows of `size` words are `size - 1` pairs; they begin where an anchor may be in them.
    width = F.least(F.col("size") - 1, n)
    hits = F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.array_contains("anchors", F.col("pairs")[i]))
    around = F.transform(
        hits, lambda i: F.sequence(F.greatest(F.lit(0), i - width + 1), F.least(i, n - width))
    )
    starts = F.array_sort(F.array_distinct(F.flatten(around)))
    windows = matching(
        F.transform(
            starts,
            lambda s: compared(
                "window",
                F.slice("pairs", s + 1, width),
                F.get("line_of", s),
                F.get("line_of", s + width),
                s,
            ),
        )
    )

    def best(w: Column) -> Column:
        """The best of each row of neighbouring windows, of equal ones the first."""
        places = F.filter(
            F.sequence(F.lit(0), F.size(w) - 1), lambda i: (i == 0) | (w[i]["at"] != F.get(w, i - 1)["at"] + 1)
        )

        def ends(p: Column) -> Column:
            return F.transform(
                p,
                lambda first, k: F.array_max(
                    F.transform(
                        F.slice(w, first + 1, F.coalesce(F.get(p, k + 1), F.size(w)) - first),
                        lambda u: F.struct(u["dice"].alias("d"), (-u["at"]).alias("o"), u.alias("u")),
                    )
                )["u"],
            )

        return F.when(F.size(w) > 0, bound(places, ends)).otherwise(F.array().cast(kind))

    every = F.concat(by_line.cast(kind), whole.cast(kind), bound(windows.cast(kind), best))
    rows = found.select("doc_id", F.col("id").alias("license_id"), F.explode(every).alias("u"))
    return rows.select(
        "doc_id",
        "u.unit",
        "u.line_no",
        "u.last_line",
        "license_id",
        F.col("u.n").alias("n_bigrams"),
        F.col("u.shared").alias("n_shared"),
        "u.dice",
    )
