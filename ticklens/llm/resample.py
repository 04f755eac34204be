"""Importance resampling towards a target text: hashed n-grams of words, log ratios, Gumbel scores.

Every text is a bag of n-grams of words, each n-gram falls into one of `buckets` by its crc32, and a
bucket's gain is the logarithm of how much more often the target uses it than the corpus does. A
document weighs the sum of the gains of its n-grams. Adding Gumbel noise to the weights and taking the
highest sums draws without replacement with odds that grow with the weight.

Texts are cut into batches. In each batch an open-addressed table (`interning`) gives equal n-grams
one slot; crc32 is computed once for a slot, not for an occurrence. Counting adds up the slots' numbers of
occurrences by bucket; scoring lets every occurrence gather the gain of its slot. A task sends on one
count for a bucket, so counts pass through the shuffle pre-aggregated; the only thing sent to all
tasks is the array of `buckets` gains.

The draw needs a total order of all documents of enough words. Scores are dealt into ranges and each
range is counted; only ranges that begin within the draw are numbered.

Odd input: NULL and empty texts have no features and weight 0. A NULL id is hashed as an empty one and comes after
all others on ties; rows that repeat an id are all scored and drawn on their own. An empty table gives an
empty result; an empty target gives every bucket the gain of its rarity in the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticklens.llm.common import ALNUM, chunks, owners, partitions, stored
from ticklens.llm.interning import crc32, intern_spans, joined_words

NGRAMS = 3
BUCKETS = 10_000
PERCENT = 5
LEAST_WORDS = 20
SEED = 42
#: Bytes of text interned at once; its table of slots then fits a core's cache.
_BATCH = 1 << 20


def _interned(texts: pa.Array, ngrams: int, buckets: int):
    """Words of each text; bucket of each slot; slot and text of each occurrence."""
    data, starts, ends, counts = joined_words(texts, ALNUM, lower=True)
    text = owners(counts)
    last = np.cumsum(counts)[text]
    at = np.arange(len(starts))
    whole = [at[at + k < last] for k in range(ngrams)]
    first = np.concatenate(whole)
    spans = starts[first], np.concatenate([ends[i + k] for k, i in enumerate(whole)])
    slots, owner = intern_spans(data, *spans)
    used = np.flatnonzero(owner >= 0)
    bucket = np.zeros(len(owner), np.int64)
    bucket[used] = crc32(data, spans[0][owner[used]], spans[1][owner[used]]) % np.uint32(buckets)
    return counts, bucket, slots, text[first]


def bucket_counts(texts: DataFrame, ngrams: int = NGRAMS, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n): how many n-grams of all texts fall into each bucket; empty buckets have no row."""

    def rows(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, part in chunks(batch.column(0), _BATCH):
                _, bucket, slots, _ = _interned(part, ngrams, buckets)
                in_slot = np.bincount(slots, minlength=len(bucket))
                total += np.bincount(bucket, in_slot, buckets).astype(np.int64)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], ["bucket", "n"])

    counted = texts.select("text").mapInArrow(rows, "bucket bigint, n bigint")
    return counted.groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(corpus: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of every bucket, from the counts of both sides; each side is computed once."""
    both = (
        corpus.sparkSession.range(buckets)
        .withColumnRenamed("id", "bucket")
        .join(target.withColumnRenamed("n", "t"), "bucket", "left")
        .join(corpus.withColumnRenamed("n", "s"), "bucket", "left")
        .fillna(0, ["t", "s"])
    )
    both = stored(both, "bucket_counts")
    all_t, all_s = both.agg(F.sum("t"), F.sum("s")).first()
    n = float(buckets)
    ratio = ((F.col("t") + 1.0) * (all_s + n)) / ((F.col("s") + 1.0) * (all_t + n))
    gain = F.floor(F.lit(1000.0) * F.ln(ratio)).cast("bigint")
    return both.select("bucket", gain.alias("gain"))


def document_weights(
    docs: DataFrame, gains: list[int], ngrams: int = NGRAMS
) -> DataFrame:
    """doc_id, n_words, n_features and weight of each row, given the gain of each bucket."""
    by_bucket = np.array(gains, np.int64)

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1), _BATCH):
                counts, bucket, slots, text = _interned(part, ngrams, len(by_bucket))
                gained = by_bucket[bucket][slots]
                order = np.argsort(text, kind="stable")
                edges = np.searchsorted(text[order], np.arange(len(part) + 1))
                upto = np.concatenate([[0], np.cumsum(gained[order])])
                weight = upto[edges[1:]] - upto[edges[:-1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        *(pa.array(x.astype(np.int64)) for x in (counts, np.diff(edges), weight)),
                    ],
                    ["doc_id", "n_words", "n_features", "weight"],
                )

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(
        rows, "doc_id bigint, n_words bigint, n_features bigint, weight bigint"
    )


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """Standard Gumbel noise in thousandths, rounded down; the same for the same id and seed."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0)))).cast("bigint")


def _numbered(rows: DataFrame, order: list[Column], wanted: int) -> DataFrame:
    """Add `rank`: 1, 2, 3 ... in this order up to `wanted`, then NULL. No two rows may tie."""
    ranged = rows.repartitionByRange(partitions(rows), *order)
    ranged = stored(ranged.withColumn("part", F.spark_partition_id()), "ranges")
    sizes = ranged.groupBy("part").count().collect()  # one row per range
    before, offsets = 0, []
    for part, n in sorted(tuple(r) for r in sizes):
        offsets.append((part, before))
        before += n
    offsets = [(part, n) for part, n in offsets if n < wanted]
    spark = rows.sparkSession
    begin = F.broadcast(spark.createDataFrame(offsets, "part int, before bigint"))
    place = F.col("before") + F.row_number().over(Window.partitionBy("part").orderBy(*order))
    drawn = ranged.join(begin, "part").withColumn("rank", F.when(place <= wanted, place))
    rest = ranged.join(begin, "part", "left_anti")
    return drawn.drop("part", "before").unionByName(
        rest.drop("part").withColumn("rank", F.lit(None).cast("bigint"))
    )


def resample(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    ngrams: int = NGRAMS,
    buckets: int = BUCKETS,
    seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_features, weight, score and rank.

    Of the documents of at least `least_words` words, so many `percent` of the highest score are drawn and ranked from
    1 on, ties to the smaller id; the others have no rank. `target` needs a column `text` only.
    """
    corpus = bucket_counts(docs, ngrams, buckets)
    gains = bucket_gains(corpus, bucket_counts(target, ngrams, buckets), buckets)
    by_bucket = [r["gain"] for r in gains.orderBy("bucket").collect()]  # `buckets` rows
    weighed = document_weights(docs, by_bucket, ngrams)
    scored = stored(weighed.withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed)), "scored")
    # Where a row lies in the stored table keeps rows that repeat an id apart.
    scored = scored.withColumns(
        {"file": F.col("_metadata.file_name"), "row": F.col("_metadata.row_index")}
    )
    enough = F.col("n_words") >= least_words
    rivals = scored.where(enough)
    wanted = percent * rivals.count() // 100
    order = [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("file"), F.asc("row")]
    others = scored.where(~enough).withColumn("rank", F.lit(None).cast("bigint"))
    return _numbered(rivals, order, wanted).unionByName(others).drop("file", "row")
