"""Operator 2: document fingerprints from closed syncmers.

The symbols of a text are its code points, whatever its length. Of each run of K of them, the hashes of its inner runs of
S are compared; the run is an anchor (a closed syncmer) if the smallest is the first or the last. That depends
on the run alone, so a shared passage has the same anchors in both texts, whatever surrounds it.
The fingerprint is the sketch of the SKETCH smallest anchor hashes; the likeness of two is the share of the
smallest hashes of both that they have in common. It estimates the Jaccard similarity J of the two sets of anchors with a
standard error of sqrt(J (1 - J) / SKETCH), 0.0625 at most, and is exact for texts with few anchors.

Long texts are worked on in blocks that overlap by K - 1 symbols: no anchor is lost or made up, and memory does not grow
with the text. For the same reason the anchors of an edited text need not be looked for anew: they are the anchors that lie in
the part that was kept, those that lie in the part that was put in, and those of the few runs across the seam.

Defined results: a NULL text is empty; an empty text has the empty fingerprint and is like
another empty one (1.0) and like nothing else; a text without an anchor, as one of fewer than K symbols, has its
whole text as the only one; equal texts have equal fingerprints. Rows that repeat an id, or have none, are all kept, and follow each
other in the order they are stored in; missing ids come after all others. Only built-in functions are used.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import bound, empty_text, partitions, stored

K = 12
S = 4
SKETCH = 64
#: Symbols of a block.
BLOCK = 1 << 16
_WIDTH = K - S + 1


def _short(*values: Column) -> Column:
    """A hash of 32 bits: half as much to shuffle as one of 64."""
    return F.shiftright(F.xxhash64(*values), 32).cast("int")


def _anchors(block: Column, start: Column) -> Column:
    """(place, hash) of the anchors of a block that starts at symbol `start` of its text."""
    none = F.array().cast("array<struct<place:int,hash:int>>")

    def of_symbols(c: Column) -> Column:
        inner = F.transform(
            F.sequence(F.lit(0), F.size(c) - S), lambda i: F.xxhash64(*(F.get(c, i + j) for j in range(S)))
        )
        return bound(inner, of_inner)

    def of_inner(s: Column) -> Column:
        ends = lambda i: F.least(F.get(s, i), F.get(s, i + _WIDTH - 1))
        between = lambda i: F.least(*(F.get(s, i + j) for j in range(1, _WIDTH - 1)))
        places = F.filter(F.sequence(F.lit(0), F.size(s) - _WIDTH), lambda i: ends(i) <= between(i))
        parts = range(0, K, S)
        return F.transform(
            places,
            lambda i: F.struct(
                (start + i).cast("int").alias("place"),
                _short(*(F.get(s, i + j) for j in parts)).alias("hash"),
            ),
        )

    symbols = F.regexp_extract_all(block, F.lit("(?s)."), F.lit(0))
    return bound(symbols, lambda c: F.when(F.size(c) >= K, of_symbols(c)).otherwise(none))


def _by_block(text: Column, use) -> Column:
    """`use` of the anchors of every block of a text, as an array."""
    starts = F.sequence(F.lit(0), F.greatest(F.char_length(text) - 1, F.lit(0)), F.lit(BLOCK))
    return F.transform(
        starts, lambda at: bound(_anchors(F.substr(text, at + 1, F.lit(BLOCK + K - 1)), at), use)
    )


def anchors(text: Column) -> Column:
    """(place, hash) of all anchors of a text, in order; none for a text of fewer than K symbols."""
    return F.flatten(_by_block(text, lambda a: a))


def _lowest(hashes: Column) -> Column:
    """The smallest distinct hashes, ascending."""
    return F.slice(F.sort_array(F.array_distinct(hashes)), 1, SKETCH)


def _or_whole(sketch: Column, text: Column) -> Column:
    """The sketch, or that of the whole text if there is no anchor in it."""
    whole = F.array(_short(text))
    empty = F.array().cast("array<int>")
    return F.when(F.size(sketch) > 0, sketch).when(text != "", whole).otherwise(empty)


def sketch(text: Column) -> Column:
    """The fingerprint of a text as an array of hashes."""
    return bound(
        _lowest(F.flatten(_by_block(text, lambda a: _lowest(a["hash"])))), lambda s: _or_whole(s, text)
    )


def part_sketches(text: Column, cuts: list[Column]) -> Column:
    """Sketches of the anchors that end before the first cut, between it and the second, and so on.

    Cuts are numbers of symbols, ascending. Together the parts hold all anchors of the text, each once.
    """
    bounds = [F.lit(-1), *(cut - K for cut in cuts), F.lit(2**31 - 1)]

    def parts(found: Column) -> Column:
        return F.array(
            *(
                _lowest(F.filter(found, lambda a: (a["place"] > low) & (a["place"] <= high))["hash"])
                for low, high in zip(bounds, bounds[1:])
            )
        )

    def merged(blocks: Column) -> Column:
        return F.array(
            *(_lowest(F.flatten(F.transform(blocks, lambda b: b[i]))) for i in range(len(cuts) + 1))
        )

    return bound(_by_block(text, parts), merged)


def as_text(hashes: Column) -> Column:
    """Eight hexadecimal digits for each hash of a sketch."""
    unsigned = lambda h: h.cast("bigint").bitwiseAND(F.lit(0xFFFFFFFF))
    return F.array_join(F.transform(hashes, lambda h: F.lpad(F.lower(F.hex(unsigned(h))), 8, "0")), "")


def likeness(a: Column, b: Column) -> Column:
    """0 to 1, from two sketches."""
    low = F.slice(F.sort_array(F.array_union(a, b)), 1, SKETCH)
    both = F.size(F.array_intersect(low, F.array_intersect(a, b)))
    return F.when(F.size(low) == 0, F.lit(1.0)).otherwise(both / F.size(low))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of each row of `docs`."""
    return docs.select("doc_id", as_text(sketch(empty_text())).alias("fingerprint"))


def positional_matches(pairs: DataFrame) -> DataFrame:
    """Anchors that two texts share, by how far one is shifted against the other.

    `pairs` has left_id, right_id, left_text and right_text; the result has a row for each pair and
    shift with the number of anchors that meet there. A hash that occurs several times in a text counts at its
    first place.
    """
    rows = pairs.select(
        "left_id",
        "right_id",
        anchors(empty_text("left_text")).alias("a"),
        anchors(empty_text("right_text")).alias("b"),
    )
    sides = [
        rows.select("left_id", "right_id", F.explode(side).alias("x"))
        .groupBy("left_id", "right_id", F.col("x.hash").alias("hash"))
        .agg(F.min("x.place").alias(side))
        for side in ("a", "b")
    ]
    met = sides[0].join(sides[1], ["left_id", "right_id", "hash"])
    shift = (F.col("b") - F.col("a")).alias("shift")
    return met.groupBy("left_id", "right_id", shift).agg(F.count("*").alias("n_anchors"))


def _placed(docs: DataFrame) -> DataFrame:
    """(file, row, doc_id, text): every row with the place it is stored at, which no other has."""
    columns = [
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.row_index").alias("row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        empty_text().alias("text"),
    ]
    try:
        return docs.select(columns)
    except AnalysisException:  # not read from files
        return stored(docs.select("doc_id", "text"), "fingerprint_texts").select(columns)


def neighbours(rows: DataFrame) -> DataFrame:
    """(file, row, key, before_key, before_n) of rows (file, row, doc_id, n).

    Keys ascend with the ids; before a row stands the one with the next larger key, before the largest the smallest.
    Rows are dealt into ranges by id and place, so no range is filled by an id that many rows share. One
    row per range passes through the driver, and neighbours meet in a join.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("file"), F.asc("row")]
    ranged = rows.repartitionByRange(partitions(rows), *order).sortWithinPartitions(*order)
    keyed = stored(ranged.withColumn("key", F.monotonically_increasing_id()), "fingerprint_keys")
    part = F.shiftright("key", 33).alias("part")
    edges = keyed.groupBy(part).agg(F.min("key").alias("first"), F.max("key").alias("last")).collect()
    edges = sorted((r["first"], r["last"]) for r in edges)
    after = [(edges[i][1], edges[(i + 1) % len(edges)][0]) for i in range(len(edges))]
    crossing = rows.sparkSession.createDataFrame(after, "key bigint, over bigint")
    linked = keyed.join(F.broadcast(crossing), "key", "left").select(
        "file", "row", "key", F.coalesce("over", F.col("key") + 1).alias("before_key")
    )
    sizes = keyed.select(F.col("key").alias("before_key"), F.col("n").alias("before_n"))
    return linked.join(sizes, "before_key")


def edited_report(docs: DataFrame) -> DataFrame:
    """Fingerprints of each row and of its edited text, and their likeness.

    The edited text has its last half replaced by the start of the next document in descending
    order of the id (after the last: the first). Every text is cut into anchors once.
    """
    placed = _placed(docs)
    sizes = placed.select("file", "row", "doc_id", F.char_length("text").alias("n"))
    near = stored(neighbours(sizes), "fingerprint_neighbours")
    text, n = F.col("text"), F.col("n")
    kept_n, tail_n = n - F.floor(n / 2).cast("int"), F.least(F.floor(F.col("before_n") / 2).cast("int"), n)
    rows = placed.join(near, ["file", "row"]).withColumn("n", F.char_length("text"))
    rows = rows.withColumns({"kept_n": kept_n, "tail_n": tail_n})
    cuts = [F.least("kept_n", "tail_n"), F.greatest("kept_n", "tail_n")]
    rows = rows.withColumn("parts", part_sketches(text, cuts))
    low, middle = F.col("parts")[0], F.col("parts")[1]
    whole = _lowest(F.flatten("parts"))
    both = _lowest(F.concat(low, middle))
    rows = rows.select(
        "key",
        "before_key",
        "doc_id",
        "n",
        _or_whole(whole, text).alias("fp"),
        F.when(F.col("kept_n") > F.col("tail_n"), both).otherwise(low).alias("in_kept"),
        F.when(F.col("tail_n") > F.col("kept_n"), both).otherwise(low).alias("in_tail"),
        F.substr(text, F.lit(1), F.col("kept_n")).alias("kept"),
        F.substr(text, F.lit(1), F.col("tail_n")).alias("tail"),
    )
    # Each row goes to its own key and to that of the row before it; two records meet at every key.
    own = F.struct(F.col("key").alias("at"), F.struct("doc_id", "n", "fp", "in_kept", "kept").alias("own"), F.lit(None).alias("other"))
    other = F.struct(F.col("before_key").alias("at"), F.lit(None).alias("own"), F.struct("fp", "in_tail", "tail").alias("other"))
    kinds = rows.select(own.alias("r")).schema["r"].dataType
    to = rows.select(other.alias("r")).schema["r"].dataType
    shape = f"struct<at:bigint,own:{kinds['own'].dataType.simpleString()},other:{to['other'].dataType.simpleString()}>"
    sent = rows.select(F.explode(F.array(own.cast(shape), other.cast(shape))).alias("r")).select("r.*")
    met = sent.groupBy("at").agg(F.max("own").alias("a"), F.max("other").alias("b"))
    met = met.withColumn("edited", F.concat("a.kept", "b.tail"))
    seam = F.concat(F.right("a.kept", F.lit(K - 1)), F.left("b.tail", F.lit(K - 1)))
    across = anchors(seam)["hash"]
    found = met.select(
        "a",
        F.col("b.fp").alias("next"),
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        _or_whole(_lowest(F.concat("a.in_kept", "b.in_tail", across)), F.col("edited")).alias("edited_fp"),
    )
    return found.select(
        F.col("a.doc_id").alias("doc_id"),
        F.col("a.n").cast("bigint").alias("n_chars"),
        "edited_sha256",
        as_text(F.col("a.fp")).alias("fingerprint"),
        as_text(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("a.fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("a.fp"), F.col("next")).alias("near_next"),
    )
