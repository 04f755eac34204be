"""Operator 10: log10 probabilities of texts under a Katz back-off model of word pairs.

A token's probability given the token before it is the discounted share of the pair if training has
it, else the back-off weight of the history times the probability of the token alone; that is
its discounted share if training has it, else what the discounts leave over. Discounts are
Good-Turing: Turing's estimate for counts up to five, its log-linear smoothing above. The weight
of a history makes its probabilities add up to one.

Texts become blocks of token numbers, stored in a table bucketed by block. A block asks for the
training counts of its distinct words and pairs, and for the back-off weights it needs, by sending
sorted keys with its own counts to the bucket of the key, a range of keys; the bucket adds them up and answers in
the same order. So a word or pair that stands in every document arrives once per block, no
vocabulary is ever in one place, and the work per bucket is bounded. Keys travel as packed
differences. A task holds one block or bucket at a time, with numbers of 32 bits where they are places, and
works out what it needs of every pair over slices.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; each text ends
with an end token, which is also the history of its first token; a NULL or empty text is its end token alone;
a NULL id counts as training; rows that repeat an id are all scored; without training text every
probability is that of the unknown word, 1. Other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import NOT_SPACE, chunks, id_crc32, mix, partitions, stored, word_hashes
from ticklens.session import new_dir

BLOCK_BYTES = 12 << 20
#: Keys that a partition adds up, about.
KEYS_PER_BUCKET = 2_000_000
#: Elements that are worked on at once where each gives a few numbers of its own.
SLICE = 1 << 17
#: Bytes of text whose words are hashed at once.
HASHED_BYTES = 1 << 20
COUNTED = 256
TURING_UP_TO = 5
END = np.uint64(0x5851F42D4C957F2D)


def packed(values: np.ndarray) -> bytes:
    return zstandard.compress(np.ascontiguousarray(values).tobytes(), 1)


def unpacked(raw: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.decompress(raw), kind)


def packed_planes(values: np.ndarray) -> bytes:
    """First bytes of all values, then second bytes, and so on: similar bytes stand together."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.itemsize)
    return packed(raw.T)


def unpacked_planes(raw: bytes, kind) -> np.ndarray:
    size = np.dtype(kind).itemsize
    planes = unpacked(raw, np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).reshape(-1).view(kind)


def packed_keys(keys: np.ndarray) -> bytes:
    return packed_planes(np.diff(keys, prepend=np.uint64(0)))


def unpacked_keys(raw: bytes) -> np.ndarray:
    return np.cumsum(unpacked_planes(raw, np.uint64), dtype=np.uint64)


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The distinct values in order, a place of each, and for every value the number of its distinct one."""
    order = np.argsort(values)
    ordered = values[order]
    new = np.ones(len(values), bool)
    np.not_equal(ordered[1:], ordered[:-1], out=new[1:])
    found, place = ordered[new], order[new].astype(np.int32)
    del ordered
    number = np.empty(len(values), np.int32)
    number[order] = np.cumsum(new, dtype=np.int32) - np.int32(1)
    return found, place, number


def slices(n: int):
    return (slice(a, min(a + SLICE, n)) for a in range(0, n, SLICE))


_BLOCKS = "block bigint, n bigint, words binary, tokens binary, docs array<bigint>, lens array<int>, held array<boolean>"


def token_blocks(docs: DataFrame, held_out) -> DataFrame:
    """Blocks of documents as numbers of their distinct words (sorted hashes)."""

    def block(number: int, ids: pa.Array, texts: pa.Array, held: pa.Array) -> pa.RecordBatch:
        hashed = [word_hashes(part, NOT_SPACE) for _, part in chunks(texts, HASHED_BYTES)]
        counts = np.concatenate([c for _, c in hashed])
        tokens = np.empty(int(counts.sum()) + len(texts), np.uint64)
        is_end = np.zeros(len(tokens), bool)
        is_end[np.cumsum(counts + 1) - 1] = True
        tokens[is_end] = END
        tokens[~is_end] = np.concatenate([h for h, _ in hashed])
        del hashed
        words, _, at = distinct(tokens)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([number], pa.int64()),
                pa.array([len(tokens)], pa.int64()),
                pa.array([packed_keys(words)], pa.binary()),
                pa.array([packed_planes(at.view(np.uint32))], pa.binary()),
                pa.ListArray.from_arrays([0, len(texts)], ids),
                pa.ListArray.from_arrays([0, len(texts)], pa.array((counts + 1).astype(np.int32))),
                pa.ListArray.from_arrays([0, len(texts)], held),
            ],
            ["block", "n", "words", "tokens", "docs", "lens", "held"],
        )

    def rows(batches):
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for first, part in chunks(batch.column(1), BLOCK_BYTES):
                ids, held = (batch.column(c).slice(first, len(part)) for c in (0, 2))
                yield block(number, ids, part, held)
                number += 1

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", held_out.alias("held"))
    return ids.mapInArrow(rows, _BLOCKS)


class Block:
    """The tokens of a block and, on demand, its pairs in the order of their keys."""

    def __init__(self, row: dict):
        self.words = unpacked_keys(row["words"])
        self.tokens = unpacked_planes(row["tokens"], np.uint32).view(np.int32)
        self.docs, self.lens = row["docs"], np.array(row["lens"], np.int64)
        self.held = np.repeat(np.array(row["held"], bool), self.lens)

    def find_pairs(self) -> None:
        before = np.empty_like(self.tokens)
        before[0], before[1:] = np.searchsorted(self.words, END), self.tokens[:-1]
        odd = np.uint64(0x9E3779B97F4A7C15)
        keys = np.empty(len(before), np.uint64)
        for s in slices(len(before)):
            keys[s] = mix(self.words[before[s]] * odd + self.words[self.tokens[s]])
        self.pair_keys, place, self.pair = distinct(keys)
        self.history, self.word = before[place], self.tokens[place]


def answered(answers: list[dict], kind) -> np.ndarray:
    """The answers of all buckets, in the order of the keys."""
    parts = [unpacked(a["answer"], kind) for a in sorted(answers, key=lambda a: a["bucket"])]
    return np.concatenate(parts) if parts else np.zeros(0, kind)


_ASK = "bucket int, block bigint, keys binary, counts binary"
_ANSWER = "bucket int, block bigint, answer binary, stats array<bigint>"


def _asked(number: int, buckets: int, keys: np.ndarray, columns: dict[str, np.ndarray]):
    """One row per bucket that has some of the sorted keys; buckets are equal ranges of the hashes."""
    bounds = np.array([(b << 64) // buckets for b in range(1, buckets)], np.uint64)
    at = [0, *np.searchsorted(keys, bounds).tolist(), len(keys)]
    some = [b for b in range(buckets) if at[b + 1] > at[b]]
    cut = [slice(at[b], at[b + 1]) for b in some]
    arrays = [pa.array(some, pa.int32()), pa.array([number] * len(some), pa.int64())]
    arrays.append(pa.array([packed_keys(keys[c]) for c in cut], pa.binary()))
    for values in columns.values():
        arrays.append(pa.array([packed(values[c]) for c in cut], pa.binary()))
    return pa.RecordBatch.from_arrays(arrays, ["bucket", "block", "keys", *columns])


def _each_row(work):
    """A function of batches that does the work for one row at a time and keeps nothing of it."""

    def rows(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                yield work(batch.slice(at, 1).to_pylist()[0])

    return rows


def ask_counts(blocks: DataFrame, buckets: int, pairs: bool) -> DataFrame:
    """Training counts of each block's words or pairs."""

    def ask(row: dict) -> pa.RecordBatch:
        block = Block(row)
        if pairs:
            block.find_pairs()
        keys, at = (block.pair_keys, block.pair) if pairs else (block.words, block.tokens)
        counts = np.bincount(at[~block.held], minlength=len(keys)).astype(np.uint32)
        return _asked(row["block"], buckets, keys, {"counts": counts})

    return blocks.mapInArrow(_each_row(ask), _ASK)


def _merged(table: pa.Table):
    rows = sorted(table.to_pylist(), key=lambda r: r["block"])
    keys = [unpacked_keys(r["keys"]) for r in rows]
    edges = np.cumsum([0, *map(len, keys)])
    known, _, at = distinct(np.concatenate(keys))
    return rows, edges, len(known), at


def add_counts(asked: DataFrame) -> DataFrame:
    """The total of each asked key, negative where the block owns it (the first with training rows).

    A row with block -1 has the number of keys by total (1 to COUNTED), of all keys, and the sum of the totals.
    """

    def answer(table: pa.Table) -> pa.Table:
        rows, edges, known, at = _merged(table)
        counts = np.concatenate([unpacked(r["counts"], np.uint32) for r in rows])
        totals = np.bincount(at, counts, known).astype(np.int64)
        some = np.flatnonzero(counts)[::-1]
        owner = np.full(known, -1)
        owner[at[some]] = some  # of a key's places the last one written stays: its first
        out = totals[at]
        out[owner[owner >= 0]] *= -1
        kinds = np.bincount(np.minimum(totals, COUNTED + 1), minlength=COUNTED + 2)[1 : COUNTED + 1]
        stats = [*kinds.tolist(), int((totals > 0).sum()), int(totals.sum())]
        answers = [packed(out[a:b]) for a, b in zip(edges, edges[1:])]
        return pa.table(
            {
                "bucket": pa.array([r["bucket"] for r in rows] + [rows[0]["bucket"]], pa.int32()),
                "block": pa.array([r["block"] for r in rows] + [-1], pa.int64()),
                "answer": pa.array([*answers, None], pa.binary()),
                "stats": pa.array([None] * len(rows) + [stats], pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("bucket").applyInArrow(answer, _ANSWER)


def _stats(answers: DataFrame) -> np.ndarray:
    rows = answers.where("block = -1").select(F.posexplode("stats").alias("at", "n"))
    out = np.zeros(COUNTED + 2, np.int64)
    for row in rows.groupBy("at").agg(F.sum("n").alias("n")).collect():
        out[row["at"]] = row["n"]
    return out


class Discounts:
    """Good-Turing factors by count, from the number of keys that have each count."""

    def __init__(self, kinds: np.ndarray):
        seen = np.flatnonzero(kinds) + 1
        self.slope = -2.0
        if len(seen) > 1:
            gaps = np.diff(np.concatenate([[0], seen, [2 * seen[-1] - seen[-2]]]))
            level = kinds[seen - 1] / (0.5 * (gaps[:-1] + gaps[1:]))
            self.slope = min(float(np.polyfit(np.log(seen), np.log(level), 1)[0]), -1.05)
        self.small = self.smooth(np.arange(1, TURING_UP_TO + 1))
        for r in range(1, TURING_UP_TO + 1):
            if kinds[r - 1] and kinds[r]:
                turing = (r + 1) * kinds[r] / (r * kinds[r - 1])
                if 0 < turing < 1:
                    self.small[r - 1] = turing

    def smooth(self, count: np.ndarray) -> np.ndarray:
        return (1 + 1 / np.maximum(count, 1)) ** (self.slope + 1)

    def __call__(self, count: np.ndarray) -> np.ndarray:
        small = self.small[np.clip(count, 1, TURING_UP_TO) - 1]
        return np.where(count <= TURING_UP_TO, small, self.smooth(count))


class Unigrams:
    """Probabilities of single words; counts above COUNTED keep their full share."""

    def __init__(self, stats: np.ndarray):
        kinds, self.vocabulary, self.total = stats[:COUNTED], int(stats[-2]), int(stats[-1])
        self.discounts = Discounts(kinds)
        r = np.arange(1, COUNTED + 1)
        left = (kinds * r * (1 - self.discounts(r))).sum() / max(self.total, 1)
        self.scale = 1.0
        if not self.total:
            left = 1.0
        elif left <= 0:
            self.scale = self.total / (self.total + 1)
            left = 1 - self.scale
        self.unknown = left

    def __call__(self, count: np.ndarray) -> np.ndarray:
        kept = np.where(count <= COUNTED, self.discounts(count), 1.0)
        known = self.scale * kept * count / max(self.total, 1)
        return np.where(count > 0, known, self.unknown)


_WEIGH = "bucket int, block bigint, keys binary, pair_mass binary, word_mass binary, ask binary"


class Placed:
    """A block with the answers to its counts."""

    def __init__(self, row: dict, unigrams: Unigrams, pairs: Discounts):
        self.block = b = Block(row)
        b.find_pairs()
        self.count = np.abs(answered(row["word_answers"], np.int64))
        self.p_word = unigrams(self.count)
        own = answered(row["pair_answers"], np.int64)
        #: Pairs that training has; those that this block owns; those that need the weight of their history.
        self.seen, self.owned, self.backs_off = own != 0, own < 0, own == 0
        self.share = np.empty(len(own))
        for s in slices(len(own)):
            count, of_history = np.abs(own[s]), self.count[b.history[s]]
            self.share[s] = pairs(count) * count / np.maximum(of_history, 1)
            self.backs_off[s] &= of_history > 0
        self.share[~self.seen] = 0.0
        needed = np.zeros(len(b.words), bool)
        needed[b.history[self.backs_off]] = True
        given = np.zeros(len(b.words), bool)
        given[b.history[self.owned]] = True
        self.needed = needed
        self.sent = np.flatnonzero(needed | given)


def ask_weights(placed: DataFrame, buckets: int, unigrams: Unigrams, pairs: Discounts) -> DataFrame:
    """What each block's own pairs take from their histories, and the histories it asks for."""

    def ask(row: dict) -> pa.RecordBatch:
        p = Placed(row, unigrams, pairs)
        b, n, own = p.block, len(p.block.words), p.owned
        history = b.history[own]
        pair_mass = np.bincount(history, p.share[own], n)[p.sent]
        word_mass = np.bincount(history, p.p_word[b.word[own]], n)[p.sent]
        columns = {"pair_mass": pair_mass, "word_mass": word_mass, "ask": p.needed[p.sent]}
        return _asked(row["block"], buckets, b.words[p.sent], columns)

    return placed.mapInArrow(_each_row(ask), _WEIGH)


def add_weights(asked: DataFrame) -> DataFrame:
    """Back-off weights of the asked histories, in the order of the keys sent."""

    def answer(table: pa.Table) -> pa.Table:
        rows, edges, known, at = _merged(table)
        mass = [np.concatenate([unpacked(r[c], np.float64) for r in rows]) for c in ("pair_mass", "word_mass")]
        pair_mass, word_mass = (np.bincount(at, m, known) for m in mass)
        weight = (1 - pair_mass) / (1 - word_mass)
        ask = [unpacked(r["ask"], bool) for r in rows]
        out = [packed(np.where(k, weight[at[a:b]], 0.0)) for k, a, b in zip(ask, edges, edges[1:])]
        return pa.table(
            {
                "bucket": pa.array([r["bucket"] for r in rows], pa.int32()),
                "block": pa.array([r["block"] for r in rows], pa.int64()),
                "answer": pa.array(out, pa.binary()),
                "stats": pa.array([None] * len(rows), pa.list_(pa.int64())),
            }
        )

    return asked.groupBy("bucket").applyInArrow(answer, _ANSWER)


_SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, score double"


def score_blocks(placed: DataFrame, unigrams: Unigrams, pairs: Discounts) -> DataFrame:
    """Scores of the documents of each block, once all answers are there."""
    base_total = unigrams.total + unigrams.vocabulary + 1

    def scored(row: dict) -> pa.RecordBatch:
        p = Placed(row, unigrams, pairs)
        b = p.block
        weight = np.ones(len(b.words))
        weight[p.sent] = answered(row["weight_answers"] or [], np.float64)
        of_pair = p.share
        for s in slices(len(of_pair)):
            backed = p.p_word[b.word[s]] * np.where(p.backs_off[s], weight[b.history[s]], 1.0)
            of_pair[s] = np.log10(np.where(p.seen[s], of_pair[s], backed))
        of_word = np.log10((p.count + 1) / base_total)
        starts = np.cumsum(b.lens) - b.lens
        return pa.RecordBatch.from_arrays(
            [
                pa.array(b.docs, pa.int64()),
                pa.array(b.held[starts]),
                pa.array(b.lens),
                pa.array(np.add.reduceat((p.count > 0)[b.tokens], starts, dtype=np.int64)),
                pa.array(np.add.reduceat(of_word[b.tokens], starts)),
                pa.array(np.add.reduceat(of_pair[b.pair], starts)),
            ],
            ["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"],
        )

    return placed.mapInArrow(_each_row(scored), _SCORES)


def _by_block(answers: DataFrame, name: str) -> DataFrame:
    listed = F.collect_list(F.struct("bucket", "answer")).alias(name)
    return answers.where("block >= 0").groupBy("block").agg(listed)


def katz_scores(docs: DataFrame) -> DataFrame:
    """Score every row of `docs`, learning from those whose crc32(id as text) mod 7 is not 2."""
    spark = docs.sparkSession
    held_out = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(7)) == 2, F.lit(False))
    name = f"katz_blocks_{uuid.uuid4().hex}"
    writer = token_blocks(docs, held_out).write.bucketBy(partitions(docs), "block")
    writer = writer.option("path", new_dir(spark, "katz_blocks")).option("compression", "zstd")
    writer.format("parquet").saveAsTable(name)
    blocks = spark.table(name)
    buckets = max(partitions(docs), (blocks.agg(F.sum("n")).first()[0] or 0) // KEYS_PER_BUCKET + 1)
    words = stored(add_counts(ask_counts(blocks, buckets, pairs=False)), "katz_words")
    pairs = stored(add_counts(ask_counts(blocks, buckets, pairs=True)), "katz_pairs")
    unigrams, discounts = Unigrams(_stats(words)), Discounts(_stats(pairs)[:COUNTED])
    placed = blocks.join(_by_block(words, "word_answers"), "block").join(
        _by_block(pairs, "pair_answers"), "block"
    )
    weights = stored(add_weights(ask_weights(placed, buckets, unigrams, discounts)), "katz_weights")
    placed = placed.join(_by_block(weights, "weight_answers"), "block", "left")
    scores = score_blocks(placed, unigrams, discounts)
    return scores.withColumn("train_tokens", F.lit(unigrams.total).cast("bigint"))
