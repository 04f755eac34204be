"""Operator 7: token ids of documents in files of independent zstandard frames.

Documents are put into ascending order of their id by range partitions; each task encodes
its range and writes one file: a frame per document (with the content checksum of
zstandard), a skippable frame with the ids of the documents, and a seek table in the public
seekable format (sizes and a checksum of every frame). A reader fetches the table from the end
of the file and decompresses only the frames it wants.

A task that is run again writes a file of another name; only files named in the rows of the
finished tasks count. The driver sees one row per file.

Defined results: a NULL text is empty (its only token is the end id); a NULL document id comes
first and is stored as the smallest 64-bit number; rows that repeat an id are all kept, in order
of their text; an empty table gives an empty manifest and no rows.

Words repeat, so each distinct pre-token is encoded once by the tokenizer's own model and kept in
a bounded table per worker. Texts with characters beyond Latin, apostrophes before
letters, control characters or the end-of-text mark go through the tokenizer whole.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticklens.llm.common import chunks, hash_spans, partitions, stored, text_bytes
from ticklens.session import new_dir

END_ID = 2
LEVEL = 3
#: Pre-tokens that a worker keeps (about 120 bytes each).
MAX_KEPT = 500_000
NO_ID = -(2**63)

# Numbers of the public seekable format: fixed values.
SEEK_MAGIC = 0x184D2A5E
SEEK_FOOTER = 0x8F92EAB1
CHECKSUM_FLAG = 0x80
ENTRY = struct.Struct("<III")
FOOTER = struct.Struct("<IBI")
FRAME_HEAD = struct.Struct("<II")
# A user-defined skippable frame, for the document ids.
IDS_MAGIC = 0x184D2A50

_LETTER, _NUMBER, _OTHER, _BLANK = 0, 1, 2, 3


def _classes() -> tuple[np.ndarray, np.ndarray]:
    """Class of each code point below U+0250, and whether it sends a text to the slow path."""
    kind = np.full(0x250, _OTHER, np.uint8)
    odd = np.zeros(0x250, bool)
    for point in range(0x250):
        char = chr(point)
        if char.isalpha():
            kind[point] = _LETTER
        elif char.isnumeric():
            kind[point] = _NUMBER
        elif point in (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D):
            kind[point] = _BLANK
        odd[point] = point in (0x85, 0xA0, 0x7F) or point < 0x20 and kind[point] != _BLANK
    return kind, odd


_KIND, _ODD = _classes()


def pretoken_starts(data: np.ndarray, offsets: np.ndarray):
    """Where pre-tokens start, and which texts need the slow path.

    The rule: runs of letters, of numbers and of other signs, each with one blank before it;
    of several white spaces before a run the last stands apart.
    """
    n = len(data)
    kind = _KIND[np.minimum(data, 0x7F)]
    odd = _ODD[np.minimum(data, 0x7F)] & (data < 0x80)
    following = np.concatenate([data[1:], np.zeros(1, np.uint8)])
    lead = np.flatnonzero(data >= 0xC0)
    point = ((data[lead].astype(np.int64) & 0x1F) << 6) | (following[lead] & 0x3F)
    far = (data[lead] >= 0xCA) | (point >= 0x250)
    point = np.where(far, 0, point)
    kind[lead] = _KIND[point]
    kind[lead + 1] = kind[lead]
    odd[lead] = far | _ODD[point]
    begins = np.zeros(n + 1, bool)
    begins[offsets[:-1]] = True
    begins = begins[:n]
    odd |= (data == 0x27) & np.concatenate([kind[1:] == _LETTER, [False]])
    odd |= (data == 0x3C) & (following == 0x7C)
    new = begins.copy()
    new[1:] |= kind[1:] != kind[:-1]
    run = np.flatnonzero(new)
    blank = kind[run] == _BLANK
    ends = np.append(run[1:], n)
    last_of_text = np.zeros(n + 1, bool)
    last_of_text[offsets[1:]] = True
    open_end = last_of_text[ends]
    # Runs of white space before something: the last one goes to what follows, if it is a blank.
    inner = blank & ~open_end
    start = np.zeros(n + 1, bool)
    start[run[~blank]] = True
    start[run[blank & open_end]] = True
    tail = ends[inner] - 1
    attached = data[tail] == 0x20
    start[ends[inner][attached]] = False
    start[tail] = True
    start[run[inner]] = True
    slow = np.zeros(len(offsets) - 1, bool)
    slow[np.searchsorted(offsets, np.flatnonzero(odd), side="right") - 1] = True
    return np.flatnonzero(start[:n]), slow


@cache
def _byte_letters() -> dict[int, str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes columns of texts with a byte-level tokenizer; one per worker and file."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.kept: dict[int, bytes] = {}

    def _word(self, raw: bytes) -> bytes:
        letters = raw.decode("latin-1").translate(_byte_letters())
        return np.array([t.id for t in self.model.tokenize(letters)], np.uint32).tobytes()

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and their number per text."""
        data, offsets = text_bytes(texts)
        starts, slow = pretoken_starts(data, offsets)
        ends = np.append(starts[1:], len(data))
        hashes, first, inverse = np.unique(
            hash_spans(data, starts, ends), return_index=True, return_inverse=True
        )
        ids = []
        for h, i in zip(hashes.tolist(), first.tolist()):
            found = self.kept.get(h)
            if found is None:
                found = self._word(data[starts[i] : ends[i]].tobytes())
                if len(self.kept) < MAX_KEPT:
                    self.kept[h] = found
            ids.append(found)
        flat = np.frombuffer(b"".join(ids), np.uint32)
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        at = (np.cumsum(sizes) - sizes)[inverse]
        sizes = sizes[inverse]
        upto = np.concatenate([[0], np.cumsum(sizes)])
        out = flat[np.repeat(at - upto[:-1], sizes) + np.arange(upto[-1])]
        edges = upto[np.searchsorted(starts, offsets)]
        counts = np.diff(edges)
        if slow.any():
            parts = np.split(out, edges[1:-1])
            for i in np.flatnonzero(slow):
                text = texts[int(i)].as_py() or ""
                exact = self.tokenizer.encode(text, add_special_tokens=False).ids
                parts[i] = np.array(exact, np.uint32)
            counts = np.array([len(p) for p in parts], np.int64)
            out = np.concatenate(parts)
        return out, counts


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def frame_checksum(raw: bytes) -> int:
    return xxhash.xxh64_intdigest(raw) & 0xFFFFFFFF


class FrameWriter:
    """One file: frames, the ids of the documents, the seek table."""

    def __init__(self, stream):
        self.stream = stream
        self.entries: list[bytes] = []
        self.ids: list[int] = []
        self.packer = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)

    def add(self, doc_id: int | None, raw: bytes) -> None:
        packed = self.packer.compress(raw)
        self.stream.write(packed)
        self.entries.append(ENTRY.pack(len(packed), len(raw), frame_checksum(raw)))
        self.ids.append(NO_ID if doc_id is None else doc_id)

    def close(self) -> None:
        ids = np.array(self.ids, "<i8").tobytes()
        self.stream.write(FRAME_HEAD.pack(IDS_MAGIC, len(ids)) + ids)
        self.entries.append(ENTRY.pack(FRAME_HEAD.size + len(ids), 0, 0))
        table = b"".join(self.entries) + FOOTER.pack(len(self.entries), CHECKSUM_FLAG, SEEK_FOOTER)
        self.stream.write(FRAME_HEAD.pack(SEEK_MAGIC, len(table)) + table)
        self.stream.close()


class FrameReader:
    """Reads the seek table of a file, then only the frames asked for."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - FOOTER.size)
        n, flags, magic = FOOTER.unpack(source.read(FOOTER.size))
        if magic != SEEK_FOOTER or not flags & CHECKSUM_FLAG:
            raise ValueError("not a seekable file with checksums")
        source.seek(size - FOOTER.size - n * ENTRY.size)
        table = np.frombuffer(source.read(n * ENTRY.size), "<u4").reshape(n, 3)
        at = np.concatenate([[0], np.cumsum(table[:, 0].astype(np.int64))])
        source.seek(int(at[-2]) + FRAME_HEAD.size)
        self.ids = np.frombuffer(source.read(8 * (n - 1)), "<i8")
        self.at, self.table = at, table[:-1]
        self.unpacker = zstandard.ZstdDecompressor()

    def __len__(self) -> int:
        return len(self.ids)

    def frame(self, i: int) -> np.ndarray:
        """The token ids of the i-th document of the file."""
        packed, size, checksum = (int(v) for v in self.table[i])
        self.source.seek(int(self.at[i]))
        raw = self.unpacker.decompress(self.source.read(packed), max_output_size=size)
        if len(raw) != size or frame_checksum(raw) != checksum:
            raise ValueError(f"frame {i} is damaged")
        return np.frombuffer(raw, "<u4")


def _open(path: str):
    system, inner = pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}")
    return system, inner


def open_reader(path: str) -> FrameReader:
    system, inner = _open(path)
    return FrameReader(system.open_input_file(inner), system.get_file_info(inner).size)


_MANIFEST = "shard int, path string, n_docs bigint, n_tokens bigint"


def write_tokens(docs: DataFrame, tokenizer: str, target: str) -> DataFrame:
    """Write `docs` (doc_id, text) below `target`; one row per file: shard, path, sizes.

    Shards are in ascending order of the document id. `tokenizer` is a file all workers have.
    """

    def write(batches):
        shard = TaskContext.get().partitionId()
        path = f"{target}/tokens-{shard:06d}-{uuid.uuid4().hex}.zst"
        writer, total, encode = None, 0, encoder(tokenizer)
        for batch in batches:
            if writer is None and len(batch):
                system, inner = _open(path)
                system.create_dir(inner.rpartition("/")[0], recursive=True)
                writer = FrameWriter(system.open_output_stream(inner, compression=None))
            for first, part in chunks(batch.column(1)):
                ids, counts = encode(part)
                edges = np.concatenate([[0], np.cumsum(counts)])
                for i, doc_id in enumerate(batch.column(0).slice(first, len(part)).to_pylist()):
                    own = np.append(ids[edges[i] : edges[i + 1]], END_ID).astype("<u4")
                    writer.add(doc_id, own.tobytes())
                total += len(ids) + len(counts)
        if writer is not None:
            writer.close()
            row = [[shard], [path], [len(writer.ids)], [total]]
            kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64()]
            arrays = [pa.array(v, k) for v, k in zip(row, kinds)]
            yield pa.RecordBatch.from_arrays(arrays, ["shard", "path", "n_docs", "n_tokens"])

    ordered = (
        docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
        .repartitionByRange(partitions(docs), "doc_id")
        .sortWithinPartitions("doc_id", "text")
    )
    return ordered.mapInArrow(write, _MANIFEST)


def with_starts(manifest: DataFrame) -> DataFrame:
    """Add the number of tokens before each file. One row per file passes through the driver."""
    files = sorted(manifest.collect(), key=lambda r: r["shard"])
    rows, start = [], 0
    for r in files:
        rows.append((r["shard"], r["path"], r["n_docs"], r["n_tokens"], start))
        start += r["n_tokens"]
    return manifest.sparkSession.createDataFrame(rows, f"{_MANIFEST}, start bigint")


def read_tokens(files: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the files."""

    def read(frames):
        for frame in frames:
            for path, start in zip(frame["path"], frame["start"]):
                reader = open_reader(path)
                counts, sums = [], []
                for i in range(len(reader)):
                    ids = reader.frame(i)
                    counts.append(len(ids))
                    sums.append(zlib.crc32(ids.tobytes()))
                yield pd.DataFrame(
                    {
                        "doc_id": pd.array(reader.ids, "Int64"),
                        "start": int(start) + np.cumsum([0, *counts[:-1]]),
                        "n_tokens": counts,
                        "ids_crc32": np.array(sums, np.int64),
                    }
                ).assign(doc_id=lambda d: d["doc_id"].mask(d["doc_id"] == NO_ID))

    spread = files.repartition(max(1, min(partitions(files), 10_000)))
    return spread.mapInPandas(
        read, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint"
    )


def token_files(docs: DataFrame, tokenizer: str, target: str | None = None) -> DataFrame:
    """Write all documents, read the files back: one row per document."""
    target = target or new_dir(docs.sparkSession, "token_files")
    manifest = stored(write_tokens(docs, tokenizer, target), "token_manifest")
    return read_tokens(with_starts(manifest))
