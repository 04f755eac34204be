"""Operator 1: quality scores from random Fourier features, ridge and isotonic calibration.

Every text is read once and reduced to a row of statistics. Random Fourier features of the
standardised statistics approximate a Gaussian kernel; each task sums the normal
equations over its labelled rows, the sums are added and solved on the driver (their size
depends on the number of features only). Scores of labelled rows kept out of
the fit are calibrated by pool-adjacent-violators over a fixed number of score bins.

Defined results: a NULL text is scored as an empty one; a NULL id is never labelled; an id that
occurs several times is scored row by row; of several labels of an id the lowest counts; labels
that are NULL are ignored; without labels of both kinds every score is the share of label 1 (0.5
without any label). Columns other than the id and the text are never read.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import NOT_SPACE, chunks, hash_spans, id_crc32, mix, owners
from ticklens.llm.common import stored, text_bytes, word_bounds

#: At most about this many labelled rows are fitted (chosen by hash), all if there are fewer.
MAX_FIT_ROWS = 1_000_000
FEATURES = 384
BANDWIDTH = 4.0
RIDGE = 1e-3
BINS = 2_000
ROWS_PER_SUM = 100_000
SEED = 7

# Classes of bytes: fixed values.
_CLASSES = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "bang": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*@^~<>{}[]\\_=+",
    "stop": b".",
    "comma": b",;:",
    "quote": b"\"'`()-/",
    "wide": bytes(range(0x80, 0x100)),
}
_CLASS_OF = np.full(256, len(_CLASSES), np.uint8)
for _number, _bytes in enumerate(_CLASSES.values()):
    _CLASS_OF[list(_bytes)] = _number


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics for each text."""
    found = [_statistics(part) for _, part in chunks(texts)]
    return np.concatenate(found) if found else np.zeros((0, N_STATISTICS))


def _statistics(texts: pa.Array) -> np.ndarray:
    data, offsets = text_bytes(texts)
    rows = len(texts)
    kind = _CLASS_OF[data]
    starts, ends = word_bounds(data, offsets, NOT_SPACE)
    counts = np.diff(np.searchsorted(starts, offsets))
    owner = owners(counts)
    edges = np.concatenate([[0], np.cumsum(counts)])
    size = np.diff(offsets)
    by_class = []
    for number in range(len(_CLASSES)):
        running = np.concatenate([[0], np.cumsum(kind == number, dtype=np.int64)])
        by_class.append(running[offsets[1:]] - running[offsets[:-1]])
    of = dict(zip(_CLASSES, by_class))
    words = np.maximum(counts, 1)
    chars = np.maximum(size, 1)
    letters = np.maximum(of["upper"] + of["lower"] + of["wide"], 1)
    hashes = hash_spans(data, starts, ends)
    lengths = ends - starts

    def share(mask: np.ndarray) -> np.ndarray:
        running = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
        return (running[edges[1:]] - running[edges[:-1]]) / words

    def distinct(values: np.ndarray, of_row: np.ndarray) -> np.ndarray:
        order = np.lexsort((values, of_row))
        values, of_row = values[order], of_row[order]
        new = np.ones(len(values), bool)
        new[1:] = (values[1:] != values[:-1]) | (of_row[1:] != of_row[:-1])
        return np.bincount(of_row[new], minlength=rows)

    follows = np.zeros(len(hashes), bool)
    follows[1:] = owner[1:] == owner[:-1]
    repeats = follows.copy()
    repeats[1:] &= hashes[1:] == hashes[:-1]
    pairs = mix(hashes[1:] * np.uint64(3) + hashes[:-1])[follows[1:]]
    pair_owner = owner[1:][follows[1:]]
    kinds = distinct(hashes, owner)
    pair_kinds = distinct(pairs, pair_owner)
    n_pairs = np.maximum(np.bincount(pair_owner, minlength=rows), 1)
    return np.column_stack(
        [
            np.log1p(size),
            np.log1p(counts),
            size / words / 10,
            of["upper"] / letters,
            np.sqrt(of["digit"] / chars),
            of["space"] / chars,
            np.log1p(of["line"]) / np.log(2 + words),
            np.sqrt(of["bang"] / words),
            np.sqrt(of["bar"] / words),
            np.sqrt(of["symbol"] / words),
            of["stop"] / words,
            of["comma"] / words,
            np.sqrt(of["quote"] / words),
            of["wide"] / chars,
            kinds / words,
            np.log1p(kinds) / np.log(2 + words),
            pair_kinds / n_pairs,
            share(repeats),
            share(lengths <= 3),
            share(lengths >= 12),
            np.log1p(of["symbol"]),
            np.log1p(of["bang"]),
            np.log1p(of["bar"]),
            np.log1p(n_pairs - np.minimum(pair_kinds, n_pairs)),
        ]
    ).astype(np.float64)


N_STATISTICS = 24
_SCHEMA = "doc_id bigint, stats array<float>"


def document_statistics(docs: DataFrame) -> DataFrame:
    """(doc_id, stats) of each row of `docs`."""

    def rows(batches):
        for batch in batches:
            values = statistics(batch.column(1)).astype(np.float32)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(values.ravel()), N_STATISTICS)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), lists.cast(pa.list_(pa.float32()))], names=["doc_id", "stats"]
            )

    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return ids.mapInArrow(rows, _SCHEMA)


@dataclass
class QualityModel:
    """What scoring needs; its size does not depend on the data."""

    mean: np.ndarray = field(default_factory=lambda: np.zeros(N_STATISTICS))
    scale: np.ndarray = field(default_factory=lambda: np.ones(N_STATISTICS))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(FEATURES + 1))
    knots: np.ndarray = field(default_factory=lambda: np.zeros(1))
    levels: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def features(self, stats: np.ndarray) -> np.ndarray:
        """Cosines of random projections, and a constant."""
        drawn = np.random.default_rng(SEED)
        directions = drawn.normal(size=(N_STATISTICS, FEATURES)) / BANDWIDTH
        phases = drawn.uniform(0, 2 * np.pi, FEATURES)
        z = np.clip((stats - self.mean) / self.scale, -6, 6)
        waves = np.sqrt(2 / FEATURES) * np.cos(z @ directions + phases)
        return np.column_stack([waves, np.ones(len(stats))])

    def raw(self, stats: np.ndarray) -> np.ndarray:
        return self.features(stats) @ self.weights

    def score(self, stats: np.ndarray) -> np.ndarray:
        """Calibrated; a hundredth of the raw score keeps the order within a flat piece."""
        raw = self.raw(stats)
        level = np.interp(raw, self.knots, self.levels)
        return np.clip(0.99 * level + 0.01 * np.clip(raw, 0, 1), 0, 1)


def _sums(rows: DataFrame, make) -> np.ndarray | None:
    """Add up what `make` gives for each task's rows; one row per task reaches the driver.

    The caller bounds the number of tasks.
    """

    def per_task(frames):
        total = None
        for frame in frames:
            if len(frame):
                part = make(np.stack(frame["stats"].to_numpy()).astype(float), frame["label"])
                total = part if total is None else total + part
        if total is not None:
            yield pd.DataFrame({"at": [0], "total": [total.ravel().tolist()]})

    parts = rows.mapInPandas(per_task, "at int, total array<double>").collect()
    return sum(np.array(r["total"]) for r in parts) if parts else None


def isotonic(values: np.ndarray, labels: np.ndarray, counts: np.ndarray):
    """Pool adjacent violators over points sorted by value; returns knots and levels."""
    blocks: list[list[float]] = []
    for value, ones, n in zip(values, labels, counts):
        blocks.append([value * n, ones, n])
        while len(blocks) > 1 and blocks[-2][1] * blocks[-1][2] >= blocks[-1][1] * blocks[-2][2]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
    table = np.array(blocks)
    return table[:, 0] / table[:, 2], table[:, 1] / table[:, 2]


def fit(rows: DataFrame) -> QualityModel:
    """Fit on (doc_id, stats, label): four fifths for the ridge, one fifth for calibration."""
    model = QualityModel()
    head = rows.agg(
        F.count("*").alias("n"),
        F.sum("label").alias("ones"),
        *(F.avg(F.col("stats")[i]).alias(f"m{i}") for i in range(N_STATISTICS)),
        *(F.stddev_pop(F.col("stats")[i]).alias(f"s{i}") for i in range(N_STATISTICS)),
    ).first()
    n, ones = head["n"], head["ones"] or 0
    if n == 0 or ones in (0, n):
        model.levels = np.array([ones / n if n else 0.5])
        return model
    model.mean = np.array([head[f"m{i}"] for i in range(N_STATISTICS)])
    model.scale = np.array([head[f"s{i}"] or 1.0 for i in range(N_STATISTICS)])
    model.scale[model.scale < 1e-9] = 1.0
    if n > MAX_FIT_ROWS:
        share = int(MAX_FIT_ROWS / n * 10_000)
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit("fit")), F.lit(10_000)) < share)
    rows = rows.coalesce(max(1, min(n, MAX_FIT_ROWS) // ROWS_PER_SUM))
    apart = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(5)) == 0

    def normal_equations(stats: np.ndarray, label: pd.Series) -> np.ndarray:
        x = model.features(stats)
        return x.T @ np.column_stack([x, label.to_numpy(float)])

    total = _sums(rows.where(~apart), normal_equations)
    if total is None:
        model.levels = np.array([ones / n])
        return model
    total = total.reshape(FEATURES + 1, FEATURES + 2)
    penalty = RIDGE * np.eye(FEATURES + 1) * n / FEATURES
    penalty[-1, -1] = 0
    model.weights = np.linalg.solve(total[:, :-1] + penalty + 1e-9 * np.eye(len(total)), total[:, -1])

    def histogram(stats: np.ndarray, label: pd.Series) -> np.ndarray:
        raw = model.raw(stats)
        at = np.clip(((raw + 0.5) / 2 * BINS).astype(int), 0, BINS - 1)
        y = label.to_numpy(float)
        return np.stack([np.bincount(at, v, BINS) for v in (np.ones(len(y)), y, raw)])

    total = _sums(rows.where(apart), histogram)
    if total is None:
        model.knots, model.levels = np.array([0.0, 1.0]), np.array([0.0, 1.0])
        return model
    count, label, raw = total.reshape(3, BINS)
    used = count > 0
    model.knots, model.levels = isotonic((raw / np.maximum(count, 1))[used], label[used], count[used])
    return model


def fit_on(stats: DataFrame, labels: DataFrame) -> QualityModel:
    """Fit on the labelled rows of `stats` whose crc32(doc_id as text) mod 5 is not 0."""
    of_id = (
        labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").alias("label"))
        .where(F.col("doc_id").isNotNull() & F.col("label").isNotNull())
        .where(F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) != 0)
        .groupBy("doc_id")
        .agg(F.min("label").alias("label"))
    )
    return fit(stored(stats.join(of_id, "doc_id"), "quality_labelled"))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score) of each row of `docs`; see the module's text."""
    stats = stored(document_statistics(docs), "quality_stats")
    model = fit_on(stats, labels)

    def score(frames):
        for frame in frames:
            values = np.stack(frame["stats"].to_numpy()) if len(frame) else np.zeros((0, N_STATISTICS))
            yield pd.DataFrame({"doc_id": frame["doc_id"], "score": model.score(values.astype(float))})

    held_out = F.coalesce(F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) == 0, F.lit(False))
    scored = stats.mapInPandas(score, "doc_id bigint, score double")
    return scored.select("doc_id", held_out.alias("held_out"), "score")


def good_documents(docs: DataFrame, labels: DataFrame, least: float) -> DataFrame:
    """The rows of `docs` that score at least `least`, all columns; texts are not shuffled."""
    model = fit_on(document_statistics(docs), labels)
    columns = docs.columns

    def keep(batches):
        for batch in batches:
            scores = model.score(statistics(batch.column(columns.index("text"))))
            yield batch.filter(pa.array(scores >= least))

    return docs.mapInArrow(keep, docs.schema)
