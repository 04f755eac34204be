"""Operator 9: words of documents that lie in passages of a benchmark, by winnowing.

Fingerprints are the smallest hash of each window of six consecutive five-word grams, so any
shared span of ten words has one in common. Fingerprints of documents are joined with
those of the items (Spark broadcasts them if they are small, else it sorts and merges); documents
that share one get the whole texts of those items and the hits are extended exactly.
Items of fewer than ten words are looked up by the hash of all their words, at every place.

Defined results: a NULL or empty text has no words and no hits; an item without words or
without an id is ignored; rows that repeat an item id belong to one item; rows that repeat
a document id are judged one by one; an empty benchmark gives no hits. Extra columns are never read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ticklens.llm.common import ALNUM, chunks, numbered, owners, ragged, stored, windows, word_hashes

SPAN = 10
GRAM = 5
WINDOW = SPAN - GRAM + 1


def winnow(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest gram of each window, without the repeats of neighbours; and their number."""
    long = counts >= SPAN
    grams, n_grams = windows(hashes, counts, GRAM)
    smallest = grams.copy()
    for j in range(1, min(WINDOW, len(grams))):
        np.minimum(smallest[: len(grams) - j], grams[j:], out=smallest[: len(grams) - j])
    owner = owners(n_grams)
    begins = np.cumsum(n_grams) - n_grams
    place = np.arange(len(grams)) - begins[owner]
    valid = long[owner] & (place + WINDOW <= n_grams[owner])
    same = np.zeros(len(grams), bool)
    same[1:] = (smallest[1:] == smallest[:-1]) & (owner[1:] == owner[:-1])
    chosen = valid & ~(same & (place > 0))
    return smallest[chosen], np.bincount(owner[chosen], minlength=len(counts))


def _of_length(hashes: np.ndarray, counts: np.ndarray, k: int):
    """Windows of exactly k words; texts of fewer have none."""
    found, n = windows(hashes, counts, k)
    keep = np.repeat(counts >= k, n)
    return found[keep], np.where(counts >= k, n, 0)


def _fingerprints(texts: pa.Array, lengths: list[int]):
    """Winnowed grams of each text, and all its windows of the given short lengths."""
    hashes, counts = word_hashes(texts, ALNUM)
    parts = [winnow(hashes, counts)]
    parts += [_of_length(hashes, counts, k) for k in lengths]
    owner = np.concatenate([owners(n) for _, n in parts])
    values = np.concatenate([v for v, _ in parts])
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new].view(np.int64), np.bincount(owner[new], minlength=len(counts))


def _item_fingerprints(texts: pa.Array):
    hashes, counts = word_hashes(texts, ALNUM)
    long, n_long = winnow(hashes, counts)
    whole, n_whole = _short_only(hashes, counts)
    owner = np.concatenate([owners(n_long), owners(n_whole)])
    values = np.concatenate([long, whole])
    order = np.argsort(owner, kind="stable")
    length = np.where(counts < SPAN, counts, 0)
    return values[order].view(np.int64), n_long + n_whole, length


def _short_only(hashes: np.ndarray, counts: np.ndarray):
    short = counts < SPAN
    keep = np.repeat(short, counts)
    n = np.where(short, counts, 0)
    return windows(hashes[keep], n, SPAN - 1)


def item_fingerprints(benchmark: DataFrame) -> DataFrame:
    """(item_id, fps, short): short is the number of words of an item of fewer than ten, else 0."""

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                values, counts, length = _item_fingerprints(part)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        ragged(values, counts),
                        pa.array(length.astype(np.int32)),
                    ],
                    ["item_id", "fps", "short"],
                )

    return benchmark.mapInArrow(rows, "item_id string, fps array<bigint>, short int")


def document_fingerprints(docs: DataFrame, lengths: list[int]) -> DataFrame:
    """(doc_id, fps) of each row."""

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                values, counts = _fingerprints(part, lengths)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, len(part)), ragged(values, counts)],
                    ["doc_id", "fps"],
                )

    return docs.mapInArrow(rows, "doc_id bigint, fps array<bigint>")


def hit_words(hashes: np.ndarray, items: dict[str, list[tuple[int, np.ndarray]]]):
    """Marks of the words inside a window of an item; ids of the items that occur.

    `items` has, by item, pairs of a window length and the hashes of its windows.
    """
    n = np.array([len(hashes)])
    marks = np.zeros(len(hashes) + 1, np.int64)
    by_length: dict[int, np.ndarray] = {}
    found = []
    for item, parts in items.items():
        any_hit = False
        for size, wanted in parts:
            if size > len(hashes):
                continue
            if size not in by_length:
                by_length[size] = windows(hashes, n, size)[0]
            at = np.flatnonzero(np.isin(by_length[size], wanted))
            np.add.at(marks, at, 1)
            np.add.at(marks, at + size, -1)
            any_hit |= len(at) > 0
        if any_hit:
            found.append(item)
    return np.cumsum(marks[:-1]) > 0, found


def _item_windows(text: str) -> tuple[int, np.ndarray] | None:
    hashes, counts = word_hashes(pa.array([text]), ALNUM)
    if not counts[0]:
        return None
    return min(int(counts[0]), SPAN), np.unique(windows(hashes, counts, SPAN)[0])


_RESULT = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("n_items", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("items_sha256", T.StringType()),
    T.StructField("contaminated", T.BooleanType()),
]


def contamination(docs: DataFrame, benchmark: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """One row per row of `docs`: doc_id (and the columns in `keep`), words, hits and items.

    `items` are the ids of the items with a window in the text, sorted as strings.
    """
    keep = keep or []
    bench = benchmark.select(F.col("item_id").cast("string").alias("item_id"), "text")
    bench = bench.where(F.col("item_id").isNotNull() & F.col("text").isNotNull())
    items = stored(item_fingerprints(bench), "bench_fingerprints")
    short = items.where("short > 0").select("short").distinct()  # nine values at most
    lengths = sorted(r["short"] for r in short.collect())
    prints = items.select("item_id", F.explode("fps").alias("fp")).distinct()
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = document_fingerprints(ids, lengths).select("doc_id", F.explode("fps").alias("fp"))
    pairs = own.join(stored(prints, "bench_prints"), "fp").select("doc_id", "item_id").distinct()
    texts = bench.groupBy("item_id").agg(F.collect_set("text").alias("texts"))
    candidates = (
        pairs.join(texts, "item_id")
        .groupBy(F.col("doc_id").alias("of_doc"))
        .agg(F.collect_list(F.struct("item_id", "texts")).alias("candidates"))
    )
    candidates = stored(candidates, "bench_candidates")
    others = [c for c in keep if c != "text"]
    joined = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", *others).join(
        candidates, F.col("doc_id").eqNullSafe(F.col("of_doc")), "left"
    )
    kept = [docs.schema[c] for c in keep]
    schema = T.StructType([T.StructField("doc_id", T.LongType()), *kept, *_RESULT])
    return joined.drop("of_doc").mapInArrow(_extend(keep), schema)


def clean_rows(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of `docs` whose own text has no passage of the benchmark, whatever their ids."""
    rows, row = numbered(docs)
    others = F.struct(*(F.col(f"`{c}`") for c in docs.columns if c != "text"))
    judged = contamination(
        rows.select(F.col(row).alias("doc_id"), "text", others.alias("others")), benchmark, ["others", "text"]
    )
    return judged.where("not contaminated").select("others.*", "text").select(docs.columns)


def _extend(keep: list[str]):
    def rows(batches):
        known: dict[str, tuple[int, np.ndarray] | None] = {}
        for batch in batches:
            others = [c for c in keep if c != "text"]
            places = [1 if c == "text" else 2 + others.index(c) for c in keep]
            for first, part in chunks(batch.column(1)):
                hashes, counts = word_hashes(part, ALNUM)
                edges = np.concatenate([[0], np.cumsum(counts)])
                wanted = batch.column(2 + len(others)).slice(first, len(part))
                hits = np.zeros(len(part), np.int64)
                names: list[list[str]] = [[] for _ in range(len(part))]
                for i in np.flatnonzero(wanted.is_valid().to_numpy(zero_copy_only=False)):
                    items = {}
                    for item in wanted[int(i)].as_py():
                        for text in item["texts"]:
                            if text not in known:
                                if len(known) > 10_000:
                                    known.clear()
                                known[text] = _item_windows(text)
                        parts = [known[t] for t in item["texts"] if known.get(t)]
                        items[item["item_id"]] = parts
                    marks, found = hit_words(hashes[edges[i] : edges[i + 1]], items)
                    hits[i] = marks.sum()
                    names[i] = sorted(found)
                digests = [hashlib.sha256(",".join(n).encode()).hexdigest() for n in names]
                columns = [batch.column(0).slice(first, len(part))]
                columns += [batch.column(at).slice(first, len(part)) for at in places]
                columns += [
                    pa.array(counts.astype(np.int64)),
                    pa.array(hits),
                    pa.array([len(n) for n in names], pa.int64()),
                    pa.array(names, pa.list_(pa.string())),
                    pa.array(digests, pa.string()),
                    pa.array(hits > 0),
                ]
                result = ["n_words", "n_hit", "n_items", "items", "items_sha256", "contaminated"]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", *keep, *result])

    return rows
