"""What several operators share: stored intermediate tables and vectorised words."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.session import new_dir

_LONG_WORD = 256
_CHUNK = 4 << 20

SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE
#: Letters and digits of ASCII, and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20
_KEEP = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage, survives lost executors."""
    path = new_dir(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(df: DataFrame) -> int:
    """The shuffle partitions that the session is set to."""
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))


def id_crc32(doc_id: Column) -> Column:
    """crc32 of the id as text; NULL ids give NULL."""
    return F.crc32(doc_id.cast("string"))


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser (xor-shift and multiply)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All UTF-8 bytes in a row, and where each text starts and ends; NULL is empty."""
    if texts.null_count:
        texts = texts.fill_null("")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    buffers = texts.buffers()
    if not len(texts) or buffers[1] is None:
        return np.zeros(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    offsets = np.frombuffer(buffers[1], kind)[texts.offset : texts.offset + len(texts) + 1]
    offsets = offsets.astype(np.int64)
    data = np.frombuffer(buffers[2], np.uint8) if buffers[2] is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def chunks(texts: pa.Array, size: int = _CHUNK):
    """Slices of a column of about `size` bytes (a longer text is a slice of its own)."""
    lengths = np.diff(text_bytes(texts)[1])
    groups = (np.cumsum(lengths) // size) if len(lengths) else lengths
    edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(lengths)]
    for a, b in zip(edges, edges[1:]):
        if b > a:
            yield int(a), texts.slice(a, b - a)


def word_bounds(data: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
    """Start and end of each word; a word never spans two texts."""
    inside = is_word[data]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    first = offsets[:-1][offsets[:-1] < len(data)]
    starts[first] |= inside[first]
    last = offsets[1:][offsets[1:] > 0] - 1
    ends[last] |= inside[last]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, eight bytes at a time."""
    lengths = ends - starts
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    eight = np.ndarray((len(data) + 1,), "<u8", padded, strides=(1,))
    out = mix(lengths.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    longest = int(lengths.max()) if len(lengths) else 0
    for at in range(0, min(longest, _LONG_WORD), 8):
        some = np.flatnonzero(lengths > at) if at else slice(None)
        piece = eight[starts[some] + at] & _KEEP[np.minimum(lengths[some] - at, 8)]
        out[some] = mix(out[some] ^ piece)
    for i in np.flatnonzero(lengths > _LONG_WORD):
        out[i] = xxhash.xxh64_intdigest(data[starts[i] : ends[i]].tobytes(), seed=1)
    return out


def word_hashes(texts: pa.Array, is_word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts in order, A-Z lower-cased, and words per text."""
    data, offsets = text_bytes(texts)
    data = _LOWER[data]
    starts, ends = word_bounds(data, offsets, is_word)
    bounds = np.searchsorted(starts, offsets)
    return hash_spans(data, starts, ends), np.diff(bounds)


def owners(counts: np.ndarray) -> np.ndarray:
    """For each element, the row that it belongs to."""
    return np.repeat(np.arange(len(counts)), counts)


def windows(hashes: np.ndarray, counts: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all k-word windows and their number per text.

    A text of fewer words, but not none, is one window, of all its words.
    """
    begins = np.concatenate([[0], np.cumsum(counts)])[:-1]
    n = np.where(counts >= k, counts - k + 1, np.minimum(counts, 1))
    at = np.repeat(begins - np.concatenate([[0], np.cumsum(n)])[:-1], n) + np.arange(n.sum())
    size = np.repeat(np.minimum(counts, k), n)
    out = mix(size.astype(np.uint64))
    for j in range(k):
        some = slice(None) if (size > j).all() else np.flatnonzero(size > j)
        out[some] = mix(out[some] * np.uint64(0x9E3779B97F4A7C15) + hashes[at[some] + j])
    return out, n


def ragged(values: np.ndarray, counts: np.ndarray) -> pa.Array:
    """An Arrow list column from flat values and the number of them in each row."""
    offsets = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))


def numbered(docs: DataFrame, name: str = "row") -> tuple[DataFrame, str]:
    """All rows, stored with a number of their own in ascending doc_id order (missing ids last), and its name.

    Rows are dealt into ranges by id and place, so ids that many rows share do not fill a range.
    """
    while name in docs.columns:
        name += "_"
    place = name + "_place"
    order = [F.asc_nulls_last("doc_id"), F.asc(place)]
    placed = docs.withColumn(place, F.monotonically_increasing_id())
    ranged = placed.repartitionByRange(partitions(docs), *order).sortWithinPartitions(*order)
    return stored(ranged.drop(place).withColumn(name, F.monotonically_increasing_id()), "numbered"), name


def empty_text(column: str = "text") -> Column:
    return F.coalesce(F.col(column), F.lit(""))


def bound(value: Column, use) -> Column:
    """`use` of a value that is evaluated once, however often `use` refers to it."""
    return F.transform(F.array(value), use)[0]
