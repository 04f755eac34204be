"""Operator 8: fixity audit of WARC replicas by Merkle trees.

Pages become WARC records in files of FILE_PAGES consecutive page ids. A leaf hashes its place, its page id,
how many records it has and of what size, and their digests; FANOUT nodes in order are hashed into their parent, each
with its place and the range of offsets it covers, counted from the parent's start, up to one node per file, then
over neighbouring files. So a record that is lost, moved to another page, or of another length changes its own
branch, and not those of the records behind it. Two replicas are compared from the top down, and only
children of nodes that differ are looked at.

The digests of a leaf are added up, so their order does not matter and a page id that a third of all rows share is
aggregated where it is read; no node gathers more than FANOUT children, and offsets are added up over the pages of one file.

Defined results: NULL url or html are empty; rows with a NULL page id are dealt to the leaves of files below zero by
their digest, and reported with page_id NULL; rows that repeat a page id form one leaf; equal replicas, and empty ones,
give no rows; a page in one replica only is missing or extra. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ticklens.llm.common import empty_text, stored

FILE_PAGES = 1000
FANOUT = 16
#: Files for records without a page id.
LOOSE_FILES = 4096
_IN_FILE = 3  # FANOUT ** 3 >= FILE_PAGES


def warc_record(url: Column, html: Column) -> Column:
    """A response record as text."""
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: response\r\nWARC-Target-URI: "), url)
    size = F.octet_length(html).cast("string")
    return F.concat(head, F.lit("\r\nContent-Length: "), size, F.lit("\r\n\r\n"), html, F.lit("\r\n\r\n"))


def records(pages: DataFrame) -> DataFrame:
    """(file, at, page_id, size, digest): one row per page, without its payload."""
    record = warc_record(empty_text("url"), empty_text("html"))
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"),
        F.octet_length(record).cast("bigint").alias("size"),
        F.sha2(F.encode(record, "UTF-8"), 256).alias("digest"),
    )
    page = F.col("page_id")
    loose = F.pmod(F.conv(F.substring("digest", 1, 8), 16, 10).cast("bigint"), F.lit(LOOSE_FILES * FILE_PAGES))
    place = F.coalesce(page, -1 - loose)
    return rows.select(
        F.floor(place / FILE_PAGES).cast("bigint").alias("file"),
        F.pmod(place, F.lit(FILE_PAGES)).cast("bigint").alias("at"),
        page.alias("page_id"),
        "size",
        "digest",
    )


def _hash(*parts: Column) -> Column:
    return F.sha2(F.encode(F.concat_ws(":", *parts), "UTF-8"), 256)


def leaves(rows: DataFrame) -> DataFrame:
    """(file, at, page_id, low, high, hash): offsets in the file, the end excluded."""
    pieces = [
        F.sum(F.conv(F.substring("digest", 1 + 16 * i, 16), 16, 10).cast("decimal(20,0)")).alias(f"d{i}")
        for i in range(4)
    ]
    # A file below zero may have a page id that is below zero and records without one.
    one = rows.groupBy("file", "at").agg(
        F.max("page_id").alias("page_id"),
        F.count("page_id").alias("with_id"),
        F.count("*").alias("n"),
        F.sum("size").alias("size"),
        *pieces,
    )
    known = F.coalesce(F.col("page_id").cast("string"), F.lit("none"))
    own = _hash(F.col("file"), F.col("at"), known, *map(F.col, ("with_id", "n", "size", "d0", "d1", "d2", "d3")))
    before = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return one.withColumn("high", F.sum("size").over(before)).select(
        "file", "at", "page_id", (F.col("high") - F.col("size")).alias("low"), "high", own.alias("hash")
    )


def _parent(level: int) -> tuple[Column, Column]:
    """Coordinates of the parents of nodes of a level."""
    if level < _IN_FILE:
        return F.col("file"), F.floor(F.col("at") / FANOUT).cast("bigint")
    return F.floor(F.col("file") / FANOUT).cast("bigint"), F.lit(0).cast("bigint")


def tree(rows: DataFrame, levels: int, name: str) -> list[DataFrame]:
    """The nodes of each level, stored, leaves first."""
    found = [stored(leaves(rows), f"{name}_0")]
    for level in range(levels):
        file, at = _parent(level)
        gathered = found[-1].groupBy(file.alias("file"), at.alias("at")).agg(
            F.min("low").alias("low"),
            F.max("high").alias("high"),
            F.sort_array(F.collect_list(F.struct("file", "at", "low", "high", "hash"))).alias("children"),
        )
        # Offsets start anew in every file, so above files they are not counted from the parent's.
        start = F.col("low") if level < _IN_FILE else F.lit(0)
        ranges = F.transform(
            "children",
            lambda c: F.concat_ws(":", c["file"], c["at"], c["low"] - start, c["high"] - start, c["hash"]),
        )
        nodes = gathered.select("file", "at", "low", "high", _hash(F.array_join(ranges, ",")).alias("hash"))
        found.append(stored(nodes, f"{name}_{level + 1}"))
    return found


def _differing(a: DataFrame, b: DataFrame) -> DataFrame:
    left, right = a.alias("a"), b.alias("b")
    met = left.join(right, ["file", "at"], "full_outer")
    return met.where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))


def audit(copy: DataFrame, replica: DataFrame) -> DataFrame:
    """Pages whose records differ between two tables of pages (page_id, url, html).

    (file, page_id, status, low_a, high_a, low_b, high_b); status is changed, missing or extra.
    """
    rows = [records(copy), records(replica)]
    first, last = rows[0].union(rows[1]).agg(F.min("file"), F.max("file")).first()
    levels, width = _IN_FILE, max(last or 0, -(first or 0)) + 1
    while width > 1:
        levels, width = levels + 1, -(-width // FANOUT)
    trees = [tree(r, levels, f"merkle_{i}") for i, r in enumerate(rows)]
    wanted = _differing(trees[0][levels], trees[1][levels]).select("file", "at")
    for level in range(levels - 1, 0, -1):
        wanted = _children(trees, level, wanted).select("file", "at")
        wanted = stored(wanted, "merkle_differing")
    found = _children(trees, 0, wanted)
    status = F.when(F.col("b.hash").isNull(), "missing").when(F.col("a.hash").isNull(), "extra")
    return found.select(
        "file",
        F.coalesce("a.page_id", "b.page_id").alias("page_id"),
        status.otherwise("changed").alias("status"),
        *(F.col(f"{s}.{c}").alias(f"{c}_{s}") for s in "ab" for c in ("low", "high")),
    )


def _children(trees: list[list[DataFrame]], level: int, wanted: DataFrame) -> DataFrame:
    """Differing nodes of a level whose parents are wanted."""
    file, at = _parent(level)
    parents = wanted.select(F.col("file").alias("pf"), F.col("at").alias("pa"))
    a, b = (
        t[level].withColumn("pf", file).withColumn("pa", at).join(parents, ["pf", "pa"], "left_semi")
        for t in trees
    )
    return _differing(a.drop("pf", "pa"), b.drop("pf", "pa"))
