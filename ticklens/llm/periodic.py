"""Periodic runs of words in whole texts, by block convolution at dyadic scales.

A run is a stretch of consecutive words whose smallest period is q and that holds at least
`LEAST_EXPONENT` periods and `LEAST_LENGTH` words, as long as it can be. Scale P = 1, 2, 4, ... finds the runs with
P <= q < 2 P:

1. The text is cut into blocks of P words. Whatever its place, a run of four periods or more holds two
   neighbouring blocks together with the q words that follow each.
2. A block is looked for in the 2 P words that start P words after its own start. The sums of squared differences
   of word numbers at all P shifts come from one exact integer transform (`ntt`); a sum of 0 is an
   occurrence, its distance d a possible period.
3. Neighbouring blocks that occur at the same distance are seeds; a chain of two or more is extended to
   both sides word by word, by fewer than P words each.
4. A chain whose stretch is that of a run already found has a multiple of that run's period as distance and is
   no run of its own. Scales go up, so the smallest period comes first.

Blocks that cannot occur at any of the distances are not transformed: if the word of the block that is the rarest in the
text does not recur at one of them, the block does not either. This loses nothing. Nor are distances
looked at that are multiples of the period of a run which covers block and occurrence.

Word numbers are exact (`interning`). A text is worked on whole, in one task; time grows as n log n.

Odd input: NULL and empty texts have no words, no runs, and the hash of an empty text. Rows that repeat an id
each get a row. The rewriting of the contract leaves texts with a NULL id as they are. An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import NOT_SPACE, chunks, owners
from ticklens.llm.interning import intern_spans, joined_words
from ticklens.llm.ntt import squared_differences

LEAST_LENGTH = 6
LEAST_EXPONENT = 4
_BATCH = 1 << 20
#: Numbers transformed at once.
_CELLS = 1 << 18


class Run(NamedTuple):
    start: int
    length: int
    period: int


class _Places:
    """Where the words of all texts of a batch recur."""

    def __init__(self, ids: np.ndarray, counts: np.ndarray) -> None:
        text = owners(counts)
        self.n = len(ids)
        key = text * (int(ids.max(initial=0)) + 1) + ids
        self.order = np.argsort(key, kind="stable")
        ordered = key[self.order]
        new = np.ones(self.n, bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.cumsum(new) - 1
        #: One number per text and word, and how often the word occurs in the text.
        self.word = np.empty(self.n, np.int64)
        self.word[self.order] = group
        self.often = np.bincount(group, minlength=1)[self.word]
        first = np.concatenate([[0], np.cumsum(counts)])[:-1]
        lowest = np.zeros(len(counts), np.int64)
        some = counts > 0
        lowest[some] = np.minimum.reduceat(self.word, first[some]) if some.any() else 0
        #: Words of a text numbered from 1 on; 0 is left for "no word".
        self.local = self.word - lowest[text] + 1
        self.sorted = group * self.n + self.order

    def recurs(self, at: np.ndarray, scale: int) -> np.ndarray:
        """Whether the word at each place recurs at a distance from `scale` to 2 * `scale` - 1."""
        base = self.word[at] * self.n
        low = np.searchsorted(self.sorted, base + np.minimum(at + scale, self.n))
        found = self.sorted[np.minimum(low, self.n - 1)]
        return (low < self.n) & (found < base + np.minimum(at + 2 * scale, self.n))


def _occurrences(
    local: np.ndarray, begin: np.ndarray, end: np.ndarray, scale: int
) -> tuple[np.ndarray, np.ndarray]:
    """For blocks of `scale` words from `begin` on, in texts that end at `end`: block number and distance."""
    blocks, distances = [], []
    rows = max(1, _CELLS // (2 * scale))
    width = np.arange(2 * scale)
    for low in range(0, len(begin), rows):
        at, stop = begin[low : low + rows, None], end[low : low + rows, None]
        window = at + scale + width
        inside = window < stop
        ahead = np.where(inside, local[np.where(inside, window, 0)], 0)
        sums = squared_differences(local[at + width[:scale]], ahead)
        row, shift = np.nonzero(sums == 0)
        blocks.append(row + low)
        distances.append(shift + scale)
    return np.concatenate(blocks), np.concatenate(distances)


def _extended(ids: np.ndarray, low: int, high: int, d: int, begin: int, end: int) -> tuple[int, int]:
    """The longest stretch of period d around the words `low` to `high` + d, within `begin` to `end`."""
    step = 64
    while high + d < end:
        stop = min(high + step, end - d)
        differ = np.flatnonzero(ids[high:stop] != ids[high + d : stop + d])
        if len(differ):
            high += int(differ[0])
            break
        high, step = stop, 2 * step
    step = 64
    while low > begin:
        stop = max(low - step, begin)
        differ = np.flatnonzero(ids[stop:low] != ids[stop + d : low + d])
        if len(differ):
            low = stop + int(differ[-1]) + 1
            break
        low, step = stop, 2 * step
    return low, high + d


def find_runs(
    ids: np.ndarray,
    counts: np.ndarray,
    least_length: int = LEAST_LENGTH,
    exponent: int = LEAST_EXPONENT,
) -> list[list[Run]]:
    """The runs of each text, by start and then period; `ids` are the numbers of the words of all texts in order.

    `exponent` must be at least four, for two whole blocks of a run to recur in it.
    """
    if exponent < LEAST_EXPONENT:
        raise ValueError(f"runs need at least {LEAST_EXPONENT} periods")
    found: list[dict[tuple[int, int], int]] = [{} for _ in counts]
    if not len(ids):
        return [[] for _ in counts]
    places = _Places(ids, counts)
    begins = np.concatenate([[0], np.cumsum(counts)])
    # Blocks of all texts one after the other: how many a text has, and the rarest word of each.
    n_blocks = np.where(counts >= max(least_length, exponent), counts, 0)
    rarest = np.flatnonzero(np.repeat(n_blocks > 0, counts))
    scale = 1
    while n_blocks.any():
        first = np.concatenate([[0], np.cumsum(n_blocks)])[:-1]
        text = owners(n_blocks)
        number = np.arange(len(text)) - first[text]
        may = places.often[rarest] > 1
        may[may] = places.recurs(rarest[may], scale)
        # Only two neighbours make a chain.
        beside = np.zeros(len(may), bool)
        beside[1:] |= may[1:] & may[:-1] & (text[1:] == text[:-1])
        beside[:-1] |= beside[1:] & may[:-1] & (text[1:] == text[:-1])
        some = np.flatnonzero(may & beside)
        if len(some):
            at = begins[text[some]] + number[some] * scale
            block, d = _occurrences(places.local, at, begins[text[some] + 1], scale)
            _add_runs(places.local, begins, found, text[some], number[some], block, d, scale, least_length, exponent)
        scale *= 2
        # Two blocks become one; a text too short for four periods of this scale has no blocks.
        halved = np.where(counts >= exponent * scale, n_blocks // 2, 0)
        left = np.repeat(first, halved) + 2 * (
            np.arange(halved.sum()) - np.repeat(np.cumsum(halved) - halved, halved)
        )
        pair = rarest[left], rarest[left + 1]
        rarest = np.where(places.often[pair[0]] <= places.often[pair[1]], *pair)
        n_blocks = halved
    return [
        sorted((Run(a, b - a, q) for (a, b), q in runs.items()), key=lambda r: (r.start, r.period))
        for runs in found
    ]


def _add_runs(ids, begins, found, text, number, block, d, scale, least_length, exponent) -> None:
    """Chain occurrences of blocks, extend the chains and note new runs in `found`, places within the text."""
    block_text, place = text[block], number[block]
    # A run of at most half a block's period that covers a block is the only one to do so.
    cover_end = np.zeros(len(text), np.int64)
    cover_period = np.ones(len(text), np.int64)
    lowest = np.searchsorted(text, np.arange(len(found) + 1))
    for t in np.unique(text):
        own = slice(lowest[t], lowest[t + 1])
        for (a, b), q in found[t].items():
            if 2 * q <= scale and b - a > scale:
                inside = lowest[t] + np.searchsorted(number[own], [-(-a // scale), (b - scale) // scale + 1])
                cover_end[inside[0] : inside[1]] = b
                cover_period[inside[0] : inside[1]] = q
    known = (d % cover_period[block] == 0) & (place * scale + scale + d <= cover_end[block])
    block_text, place, d = block_text[~known], place[~known], d[~known]
    order = np.lexsort((place, d, block_text))
    block_text, place, d = block_text[order], place[order], d[order]
    joined = (block_text[1:] == block_text[:-1]) & (d[1:] == d[:-1]) & (place[1:] == place[:-1] + 1)
    edges = np.flatnonzero(np.concatenate([[True], ~joined, [True]])) if len(d) else np.zeros(1, int)
    chains = np.flatnonzero(np.diff(edges) >= 2)
    for low, high in zip(edges[chains], edges[chains + 1] - 1):
        t, distance = int(block_text[low]), int(d[low])
        begin = int(begins[t])
        a, b = _extended(
            ids,
            begin + int(place[low]) * scale,
            begin + int(place[high] + 1) * scale,
            distance,
            begin,
            int(begins[t + 1]),
        )
        if b - a >= max(least_length, exponent * distance):
            found[t].setdefault((a - begin, b - begin), distance)


def looped(n: int, doc_id: int | None) -> np.ndarray | None:
    """The contract's rewriting of a text of n words: the old number of each new word, or None if it stays."""
    h = None if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    period = 1 + (n - a) // (3 + g % 8)
    order = np.arange(n)
    order[a:] = a + (order[a:] - a) % period
    return order


def collapsed(words: list[bytes], runs: list[Run]) -> bytes:
    """The words joined by one space, without those that a run repeats."""
    keep = np.ones(len(words), bool)
    for run in runs:
        keep[run.start + run.period : run.start + run.length] = False
    return b" ".join(words[i] for i in np.flatnonzero(keep))


_FIELDS = "doc_id bigint, text string, runs array<struct<start:bigint,length:bigint,period:bigint>>"


def periodic_runs(docs: DataFrame, rewrite=None) -> DataFrame:
    """(doc_id, text, runs) of each row; `text` is the collapsed text, words joined by one space.

    `rewrite` gives, from the number of words and the id, the old number of each word of a text to be looked at
    in place of the given one, or None.
    """

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1), _BATCH):
                doc_ids = batch.column(0).slice(first, len(part))
                data, starts, ends, counts = joined_words(part, NOT_SPACE, lower=False)
                ids, _ = intern_spans(data, starts, ends)
                edges = np.concatenate([[0], np.cumsum(counts)])
                orders = {}
                for i, doc_id in enumerate(doc_ids.to_pylist() if rewrite else []):
                    order = rewrite(int(counts[i]), doc_id)
                    if order is not None:
                        orders[i] = order
                        ids[edges[i] : edges[i + 1]] = ids[edges[i] : edges[i + 1]][order]
                runs = find_runs(ids, counts)
                whole = data.tobytes()
                texts = []
                for i, n in enumerate(counts):
                    text = whole[starts[edges[i]] : ends[edges[i + 1] - 1]] if n else b""
                    if i in orders or runs[i]:
                        words = text.split(b" ")
                        text = collapsed([words[j] for j in orders[i]] if i in orders else words, runs[i])
                    texts.append(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        doc_ids,
                        pa.array(texts, pa.binary()).cast(pa.string()),
                        pa.array(
                            [[r._asdict() for r in own] for own in runs],
                            pa.list_(pa.struct([(f, pa.int64()) for f in Run._fields])),
                        ),
                    ],
                    ["doc_id", "text", "runs"],
                )

    given = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return given.mapInArrow(rows, _FIELDS)


def run_report(docs: DataFrame) -> DataFrame:
    """One row per row of `docs`, rewritten as the contract says: number of runs, the greatest run, digests."""
    found = periodic_runs(docs, looped)
    listed = F.expr(
        "array_join(transform(runs, r -> concat(r.start, ',', r.length, ',', r.period, '\\n')), '')"
    )
    # Longest first, then the smallest start and period.
    best = F.expr("array_min(transform(runs, r -> struct(-r.length AS l, r.start AS s, r.period AS p)))")
    return found.withColumn("best", best).select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        F.col("best.s").alias("start"),
        (-F.col("best.l")).alias("length"),
        F.col("best.p").alias("period"),
        F.expr("1000 * -best.l div best.p").alias("exponent_milli"),
        F.sha2(listed, 256).alias("runs_sha256"),
        F.sha2(F.col("text"), 256).alias("collapsed_sha256"),
    )
